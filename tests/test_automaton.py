"""Names in texts, against a comparison of all pairs."""

import random

import numpy as np
import pytest

from iotrail.operators.automaton import NOWHERE, Automaton, lowest_holder


def words(rng, n, longest, letters="ab/é😀"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_against_all_pairs():
    rng = random.Random(4)
    for _ in range(60):
        names, texts = words(rng, rng.randint(1, 12), 5), words(rng, rng.randint(0, 30), 20, "ab/é😀xy") + [""]
        values = np.array([rng.randrange(-100, 100) for _ in texts])
        got = Automaton(names).lowest(texts, values).tolist()
        assert got == [min((int(v) for t, v in zip(texts, values) if n in t), default=NOWHERE) for n in names]


def test_shared_endings_and_nested_names():
    """Ten thousand names and ten thousand paths with one ending, and names that hold each other."""
    names = [f"{k:05d}/very/long/shared/suffix.so" for k in range(10_000)] + ["q" * k for k in range(1, 300)]
    texts = [f"/lib/{k}y{k % 7}/very/long/shared/suffix.so" for k in range(10_000)] + ["/" + "q" * 299, f"/lib/{42:05d}/very/long/shared/suffix.so"]
    got = Automaton(names).lowest(texts, np.arange(len(texts)))
    assert set(got[10_000:].tolist()) == {10_000} and got[42] == 10_001
    assert (np.delete(got[:10_000], 42) == NOWHERE).all()


@pytest.mark.parametrize("limit", [3, 1000])
def test_dealt_out(spark, limit):
    """Keys in many parts, nulls, empty names, repeated rows."""
    rng = random.Random(8)
    names = [(rng.choice([1, 1, 2, 5]), w) for w in words(rng, 60, 4)] + [(1, None), (1, ""), (None, "a"), (4, "a")]
    texts = [(rng.choice([1, 1, 2, 3]), w, rng.randrange(10**12)) for w in words(rng, 80, 15)] + [(1, None, 0), (2, "", 1)]
    n, t = spark.createDataFrame(names + names[:9], "pid long, name string"), spark.createDataFrame(texts + texts[:9], "pid long, path string, start long")
    got = {(r["pid"], r["name"]): r["start"] for r in lowest_holder(n, t, ["pid"], "name", "path", "start", limit, limit).collect()}
    want = {}
    for p, w in names:
        hits = [v for q, x, v in texts if p is not None and p == q and w and x is not None and w in x]
        if hits:
            want[p, w] = min(hits)
    assert got == want
    assert lowest_holder(n.limit(0), t, ["pid"], "name", "path", "start").count() == 0 == lowest_holder(n, t.limit(0), ["pid"], "name", "path", "start").count()
