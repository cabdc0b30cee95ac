"""Which of many names occur in which texts, by one automaton over all names.

The trie of the names, its failure links and the walks of all texts are worked out level by level in arrays; a transition is a place in a
sorted array of (node, letter). A text leaves its value at every node that it passes, and the values go down the failure links at the
end, so the work is linear in the letters of names and texts, however many names end alike or lie in one another.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import int_div

#: Names of one automaton and texts that walk through it in one task, at about 50 letters each.
NAMES = 50_000
TEXTS = 200_000
NOWHERE = np.iinfo(np.int64).max


def _letters(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words behind each other, where each begins, and its length."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return points, np.cumsum(lengths) - lengths, lengths


class Automaton:
    """Goto and failure links over ``names``, which are not empty."""

    def __init__(self, names: Sequence[str]):
        points, starts, lengths = _letters(names)
        self.alphabet = np.unique(points)
        self.width = len(self.alphabet) + 1
        codes = np.searchsorted(self.alphabet, points) + 1
        node = np.zeros(len(names), np.int64)  # where each name has come to
        levels, keys, size = [np.zeros(1, np.int64)], [], 1
        for depth in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > depth)
            key, child = np.unique(node[on] * self.width + codes[starts[on] + depth], return_inverse=True)
            node[on] = size + child
            levels.append(np.arange(size, size + len(key)))
            keys.append(key)
            size += len(key)
        self.ends, self.levels = node, levels
        self.targets = np.arange(1, size)  # nodes are numbered in the order of their levels
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        parents, letters = self.keys // self.width, self.keys % self.width
        order = np.argsort(self.keys)
        self.keys, self.targets = self.keys[order], self.targets[order]
        self.fail = np.zeros(size, np.int64)
        for level in levels[2:]:
            self.fail[level] = self.step(self.fail[parents[level - 1]], letters[level - 1])

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Where each node goes with its letter, by way of failure links; letter 0 is in no name."""
        out = np.zeros(len(node), np.int64)
        on = np.flatnonzero(letter > 0)
        here = node[on]
        while len(on):
            key = here * self.width + letter[on]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            out[on[found]] = self.targets[place[found]]
            left = ~found & (here > 0)
            on, here = on[left], self.fail[here[left]]
        return out

    def lowest(self, texts: Sequence[str], values: np.ndarray) -> np.ndarray:
        """For every name the lowest value of a text that holds it, ``NOWHERE`` if none does."""
        least = np.full(len(self.fail), NOWHERE, np.int64)
        points, starts, lengths = _letters(texts)
        place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1) if len(self.alphabet) else np.zeros(len(points), np.int64)
        codes = np.where(self.alphabet[place] == points, place + 1, 0) if len(self.alphabet) else place
        order = np.argsort(-lengths, kind="stable")  # texts that go on come first
        starts, lengths, values = starts[order], lengths[order], values[order]
        node = np.zeros(len(texts), np.int64)
        for at in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -at))
            node = self.step(node[:n], codes[starts[:n] + at])
            np.minimum.at(least, node, values[:n])
        for level in reversed(self.levels[1:]):
            np.minimum.at(least, self.fail[level], least[level])
        return least[self.ends]


def lowest_holder(
    names: DataFrame, texts: DataFrame, keys: Sequence[str], name: str, text: str, value: str, names_per_task: int = NAMES, texts_per_task: int = TEXTS
) -> DataFrame:
    """(keys, ``name``, ``value``): the lowest value of a text of the same keys that holds the name; names that none holds are left out.

    Keys with many names or texts are dealt out: each of their parts of ``names_per_task`` names meets each part of ``texts_per_task`` texts,
    both at about. Null and empty names and null texts take no part.
    """
    keys = list(keys)
    asked = names.filter(F.length(name) > 0).select(*keys, name).distinct()
    held = texts.filter(F.col(text).isNotNull()).groupBy(*keys, text).agg(F.min(value).cast("long").alias(value))
    parts_of = lambda n, limit: F.greatest(int_div(n + limit - 1, limit), F.lit(1))
    n_names = asked.groupBy(*keys).agg(parts_of(F.count(F.lit(1)), names_per_task).alias("_parts"))
    n_texts = held.groupBy(*keys).agg(parts_of(F.count(F.lit(1)), texts_per_task).alias("_blocks"))
    sizes = n_names.join(n_texts, keys)  # one row per key
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = asked.join(sizes, keys).select(*keys, name, F.pmod(F.xxhash64(name), "_parts").alias("_part"), other(F.col("_blocks")).alias("_block"))
    right = held.join(sizes, keys).select(*keys, text, value, other(F.col("_parts")).alias("_part"), F.pmod(F.xxhash64(text), "_blocks").alias("_block"))

    def run(group: tuple, names: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        found = Automaton(names[name].tolist()).lowest(texts[text].tolist(), texts[value].to_numpy()) if len(names) and len(texts) else np.zeros(0)
        out = names[[*keys, name]][: len(found)].assign(**{value: found})
        return out[out[value] != NOWHERE]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    by = [*keys, "_part", "_block"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, f"{fields}, `{value}` long")
    return hits.groupBy(*keys, name).agg(F.min(value).alias(value))
