"""Byte-level BPE over a trie of distinct words.

The state of a prefix is the last token of its encoding. Let ``t`` be a token that ends where the prefix ends and ``p`` the state of
what is left in front of ``t``. ``t`` is the state of the prefix exactly if the pair ``(p, t)`` stays as it is when both are merged
side by side, and one token only fits. So states follow from states of shorter prefixes, and words that begin alike share them: the
distinct words of a batch go into a trie in sorted order, which visits it depth first, and every node is computed once.

Trie and word table live in the Python worker. The trie is planted anew beyond ``MAX_NODES`` and the word table forgets what was not
used lately beyond ``MAX_WORDS``, which costs time but changes nothing; words over ``MAX_SHARED`` bytes run the same recurrence on a path of their own that is forgotten afterwards. Texts
over ``PIECE`` characters are cut where no token can lie across (before a blank between two non-blanks). No shuffle is needed.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from iotrail.llm.common import kept, quoted

#: How this family of vocabularies splits text before merging (fixed value); runs of letters come first as they are most frequent.
WORDS = r""" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_NODES = 800_000
MAX_WORDS = 200_000
MAX_PAIRS = 500_000
MAX_SHARED = 48
PIECE = 1_000_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file in JSON."""

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        letters = byte_letters()
        ids = file["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[int, int] = {}  # when a token is made; single bytes are there from the beginning
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = ids[left], ids[right], ids[left + right]
            self.merge.setdefault((a, b), n)
            if made not in self.rank:
                self.rank[made], self.parts[made] = n, (a, b)
        self.made = {pair: self.id_of[self.bytes_of[pair[0]] + self.bytes_of[pair[1]]] for pair in self.merge}
        self.longest = min(MAX_SHARED, max(map(len, self.id_of))) if self.id_of else 0
        self.long_tokens = sorted({len(b) for b in self.id_of if len(b) > self.longest}, reverse=True)
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        size = max(self.bytes_of, default=-1) + 1
        self.raw: list[bytes | None] = [self.bytes_of.get(i) for i in range(size)]  # bytes and decimal text by id
        self.decimal = [str(i) for i in range(size)]

    def merged(self, word: bytes) -> list[int]:
        """The encoding by the rule itself: the earliest merge first, from the left."""
        out = [self.id_of[bytes([b])] for b in word]
        while len(out) > 1:
            n, at = min((self.merge.get(pair, NEVER), i) for i, pair in enumerate(zip(out, out[1:])))
            if n == NEVER:
                break
            out[at : at + 2] = [self.made[out[at], out[at + 1]]]
        return out


class Encoder:
    """Encodes texts; keeps the trie and the words that it has seen lately."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(WORDS).findall
        self.cut = regex.compile(r"\S(?= \S)")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # word -> its ids, four bytes each
        self.older: dict[str, bytes] = {}
        self.plant()

    def plant(self) -> None:
        """An empty trie."""
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        self.last: list[int] = [-1]  # node -> state

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart when their bytes are merged side by side.

        The merges are followed backwards along the seam. What lies at the seam on either side can be merged across it while both
        exist, that is before either goes into a larger token of its own side; at equal ranks the left merge comes first.
        """
        rank, parts, merge = self.v.rank, self.v.parts, self.v.merge
        x, y, left_ends, right_ends = a, b, NEVER, NEVER
        while True:
            n = merge.get((x, y))
            if n is not None and n < left_ends and n <= right_ends:
                return False
            made_x, made_y = rank.get(x, -1), rank.get(y, -1)
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                left_ends, x = made_x, parts[x][1]
            else:
                right_ends, y = made_y, parts[y][0]

    def fits(self, token: int, before: int) -> bool:
        """Whether ``token`` can follow a prefix with the state ``before``; -1 is the empty prefix."""
        if before < 0:
            known = self.whole.get(token)
            if known is None:
                known = self.whole[token] = self.v.merged(self.v.bytes_of[token]) == [token]
            return known
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.stands(before, token)
        return known

    def state(self, word: bytes, end: int, states: list[int]) -> int:
        """The last token of ``word[:end]``; ``states[k]`` is the last token of ``word[:k]``."""
        find, longest = self.v.id_of.get, self.v.longest
        if end > longest:
            for size in self.v.long_tokens:
                if size <= end and (token := find(word[end - size : end])) is not None and self.fits(token, states[end - size]):
                    return token
        first = end - longest if end > longest else 0
        likely = max(first, end - 1 - len(self.v.bytes_of[states[end - 1]])) if end > 1 else 0  # the token before may just grow
        for starts in (range(likely, end), range(first, likely)):
            for start in starts:
                token = find(word[start:end])
                if token is not None and self.fits(token, states[start]):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def learn(self, words: set[str]) -> None:
        """Puts new words into the trie, depth first, and their encodings into the word table."""
        if len(self.last) > MAX_NODES:
            self.plant()
        following, last, size_of, state_of = self.next, self.last, self.v.bytes_of, self.state
        before, nodes, states = b"", [0], [-1]  # the word visited last, the nodes on its path, their states
        for raw, word in sorted((w.encode(), w) for w in words):
            same, most = 0, min(len(raw), len(before))
            while same < most and raw[same] == before[same]:
                same += 1
            del nodes[same + 1 :], states[same + 1 :]
            node = nodes[-1]
            for end in range(same + 1, len(raw) + 1):
                child = None
                if end <= MAX_SHARED:
                    child = following.get(key := node << 8 | raw[end - 1])
                    if child is None:
                        child = following[key] = len(last)
                        last.append(state_of(raw, end, states))
                    node, state = child, last[child]
                    nodes.append(node)
                else:
                    state = state_of(raw, end, states)
                states.append(state)
            before = raw[:MAX_SHARED]
            ids, end = [], len(raw)
            while end:
                ids.append(states[end])
                end -= len(size_of[states[end]])
            ids.reverse()
            self.words[word] = array("i", ids).tobytes()

    def know(self, words: set[str]) -> None:
        """Sees to it that the word table has ``words``. Of the two generations that it keeps, the older one goes when the younger is full."""
        if len(self.words) > MAX_WORDS:
            self.words, self.older = {}, self.words
        new = words.difference(self.words)
        if self.older:  # a dict is walked whole by the set operations, so its keys are asked one by one
            old = [word for word in new if word in self.older]
            self.words.update((word, self.older[word]) for word in old)
            new.difference_update(old)
        if new:
            self.learn(new)

    def pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PIECE:
            found = self.cut.search(text, start + PIECE)
            if found is None:
                break
            yield text[start : found.end()]
            start = found.end()
        yield text[start:] if start else text

    def parts(self, text: str) -> Iterator[str | int]:
        """Plain pieces of a text and the ids of the special tokens between them."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self.pieces(text[at : found.start()])
            yield self.v.special[found.group()]
            at = found.end()
        yield from self.pieces(text[at:] if at else text)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, array]]:
        """Rows and ids of their texts, in order; long texts come in several parts. Distinct words are looked at for all texts at once."""
        waiting: list[tuple[int, list[str] | int]] = []
        seen: set[str] = set()
        size = 0
        for row, text in enumerate(texts):
            for part in self.parts(text or ""):
                words = part if isinstance(part, int) else self.split(part)
                waiting.append((row, words))
                if not isinstance(part, int):
                    seen.update(words)
                    size += len(part)
                if size > PIECE:
                    yield from self.flush(waiting, seen)
                    waiting, seen, size = [], set(), 0
        yield from self.flush(waiting, seen)

    def flush(self, waiting: list[tuple[int, list[str] | int]], seen: set[str]) -> Iterator[tuple[int, array]]:
        self.know(seen)
        for row, words in waiting:
            if isinstance(words, int):
                yield row, array("i", [words])
            elif words:
                ids = array("i")
                ids.frombytes(b"".join(map(self.words.__getitem__, words)))
                yield row, ids

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.v.raw.__getitem__, ids))


def _encoder(raw: bytes) -> Encoder:
    """One encoder for a vocabulary in each Python worker."""
    return kept(f"bpe {hashlib.md5(raw).hexdigest()}", lambda: Encoder(Vocabulary(raw)))


def _rows(docs: DataFrame, work: Callable[[Encoder, list], list[pa.Array]], fields: list[T.StructField], vocabulary: str, carry: list[str], column: str) -> DataFrame:
    """Runs ``work`` on the values of ``column`` and puts its columns behind the carried ones."""
    with open(vocabulary, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file, 1.5 MB here
    names = [f.name for f in fields]
    given = [c for c in carry if c.lower() not in {n.lower() for n in names}]
    source = docs.select(*map(quoted, given), quoted(column).alias("input of the operator"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                new = work(encoder, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*given, *names])

    return source.mapInArrow(run, schema)


def _flat_ids(encoder: Encoder, texts: list) -> tuple[array, list[int]]:
    """The ids of some texts one behind the other, and where the ids of each text begin and end."""
    values, counts = array("i"), np.zeros(len(texts), np.int64)
    for row, ids in encoder.encode(texts):
        values.extend(ids)
        counts[row] += len(ids)
    return values, np.append(0, np.cumsum(counts)).tolist()


def _lists(values: array, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(values, np.int32)))


def _text_of(encoder: Encoder, ids: Sequence[int] | None) -> str:
    """What ``decode`` returns for a row."""
    return encoder.decode(ids or ()).decode("utf-8", "replace")


def _utf8_of(encoder: Encoder, ids: Sequence[int]) -> bytes:
    """The same in UTF-8; bytes that are valid already stay as they are."""
    raw = encoder.decode(ids)
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the token ids of every whole text.

    A null text counts as empty and has no ids. Strings of special tokens become their ids, others are never added. Repeated rows
    stay; columns that are called like the new one are replaced.
    """

    def work(encoder: Encoder, texts: list) -> list[pa.Array]:
        return [_lists(*_flat_ids(encoder, texts))]

    return _rows(docs, work, [T.StructField(ids, T.ArrayType(T.IntegerType()))], vocabulary, docs.columns if carry is None else carry, text)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """``tokens`` with the text that the ids stand for; broken UTF-8 turns into U+FFFD, null ids into an empty text."""

    def work(encoder: Encoder, rows: list) -> list[pa.Array]:
        return [pa.array([_text_of(encoder, r) for r in rows], pa.string())]

    return _rows(tokens, work, [T.StructField(text, T.StringType())], vocabulary, tokens.columns if carry is None else carry, ids)


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", carry: list[str] | None = None, ids: str | None = None) -> DataFrame:
    """Encodes every whole text as ``encode`` does, decodes these ids as ``decode`` does, and returns the digests of both beside the
    carried columns, and the ids themselves if ``ids`` names a column for them.

    ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the decoded text in UTF-8); a null
    text counts as empty. Both happen in one worker, so that there is one vocabulary for a task.
    """

    def work(encoder: Encoder, texts: list) -> list[pa.Array]:
        values, ends = _flat_ids(encoder, texts)
        decimal = encoder.v.decimal.__getitem__
        counts, of_ids, of_text = [], [], []
        for start, end in pairwise(ends):
            found = values[start:end].tolist()
            counts.append(end - start)
            of_ids.append(hashlib.sha256(",".join(map(decimal, found)).encode()).hexdigest())
            of_text.append(hashlib.sha256(_utf8_of(encoder, found)).hexdigest())
        return [*([_lists(values, ends)] if ids else []), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields = [*([T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []), *fields]
    return _rows(docs, work, fields, vocabulary, docs.columns if carry is None else carry, text)
