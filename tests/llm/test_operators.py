"""Odd inputs: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from iotrail.llm import bpe, html_crf, hyperminhash, licenses, lm, mih, mixing, quality, rabitq, shards
from iotrail.llm.components import components
from iotrail.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, a long one, rows twice, one id with two texts, clashing names."""
    rows = [(1, words(80), "en", "b", 1), (2, None, None, None, None), (None, words(80), "en", "a", 2), (3, "", "de", "b", 0), (4, words(30_000, 4), "de", "a", 9), (1, words(80), "en", "b", 1)]
    rows += [(5, "one", "en", None, 3), (5, words(10, 5), "en", "b", 3), (6, " \t\n", "en", "b", 3), (7, "naïve 😀 text", "en", "b", 3)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("score", "predicted", "copies", "target", "source_size", "shard", "slot", "n_tokens", "ids", "bucket", "row", "digest", "line", "node", "s", "k"):
        frame = frame.selectExpr("*", f"doc_id as {name}")
    return frame


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd(odd, none):
    got = hyperminhash.near_duplicates(odd, 2, 80).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[6]["n_shingles"] == 0
    assert sum(r["doc_id"] == 1 and r["component_id"] == 1 for r in got) == 2
    assert hyperminhash.near_duplicates(none).count() == 0
    kept = hyperminhash.one_of_each(odd, 2, 80)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7]
    assert {r["text"] for r in kept.where("doc_id = 5").collect()} == {"one", words(10, 5)}  # unlike texts of one id both stay


def test_one_of_unlike_texts(spark):
    """Of two texts with one id, only the one that is like a kept document goes; which row of many stays is settled."""
    rows = [(5, words(50, 1), "a"), (5, words(50, 2), "b"), (3, words(50, 2) + " more", "c"), (9, words(50, 3), "d"), (9, words(50, 3), "e"), (9, words(50, 3), "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `document key` string")
    kept = [sorted(map(tuple, hyperminhash.one_of_each(frame.repartition(n)).collect())) for n in (1, 4)]
    assert kept[0] == kept[1] and [r[:2] for r in kept[0]] == sorted([(3, rows[2][1]), (5, rows[0][1]), (9, rows[3][1])])


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_families(spark, block, monkeypatch):
    """Families of copies with many changes: links that only exist between particular members are all found."""
    from .test_queries import components_by_force

    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rng, texts = random.Random(3), {}
    for family in range(4):
        base = words(60, 100 + family).split()
        for k in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(60)] = f"new{rng.randrange(1000)}"
            texts[family * 1000 + k] = " ".join(copy)
    texts |= {9000 + k: "a shared line of some words that stands everywhere " + words(rng.randint(3, 30), k) for k in range(40)}
    got = hyperminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_force(texts)


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for n, share in ((40, 0.8), (3000, 0.8), (3000, 0.5)):
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.append(common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64))) for _ in range(2)]
        true = len(common) / (2 * n - len(common))
        guess, error = hyperminhash.similarity(*(hyperminhash.registers(s).astype(np.int64)[None] for s in sets), np.array([n]), np.array([n]))
        assert abs(guess[0] - true) < 5 * max(error[0], 0.02)


def test_bpe_odd(odd, none, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    out = bpe.encode(odd, VOCABULARY)
    assert sorted(out.columns) == sorted(odd.columns)
    for r in out.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    back = bpe.decode(out, VOCABULARY).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe.encode(none, VOCABULARY).count() == bpe.round_trip(none, VOCABULARY).count() == 0
    encoder = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, "rb").read()))
    rng = random.Random(6)
    texts = ["<|endoftext|>a <|endoftext|>", "-" * 300, "x" * 500, "a  b\n\n  c\t\td ", "it's WE'LL 'tis", "日本語のテキスト " * 30, "\x1c\x85\xa0  x"]
    texts += ["".join(rng.choice("ab \n's1é日_-=😀") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    for piece in (10, 1_000_000):
        monkeypatch.setattr(bpe, "PIECE", piece)
        monkeypatch.setattr(bpe, "MAX_WORDS", 50 * piece)
        monkeypatch.setattr(bpe, "MAX_NODES", 100 * piece)
        got = [[] for _ in texts]
        for row, ids in encoder.encode(texts):
            got[row] += ids
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [encoder.decode(g).decode() for g in got] == texts


def test_mixing(spark, odd, none):
    rows = [(k, words(1 + k % 50, k), "en", s, 0) for k, s in enumerate(["a"] * 20 + ["b"] * 400 + ["c"] * 300 + [None] * 900)]
    docs = spark.createDataFrame(rows, DOCS)
    sized = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    rates = {r["source"]: r for r in mixing.source_rates(sized).collect()}
    total = sum(r["source_size"] for r in rates.values())
    assert [rates[s]["weight"] for s in ("a", "b", "c", None)] == [5, 2, 1, 5]
    assert rates["a"]["target"] == 3 * rates["a"]["source_size"]  # full; the rest share by weight
    rest = total - rates["a"]["target"]
    for s, w in (("b", 2), ("c", 1), (None, 5)):
        assert rates[s]["target"] == pytest.approx(rest * w / 8)
    taken = mixing.with_copies(sized, mixing.source_rates(sized)).toPandas()
    assert (taken["copies"] <= 3).all()
    for s, group in taken.groupby("source", dropna=False):
        assert (group["size"] * group["copies"]).sum() == pytest.approx(group["target"].iloc[0], rel=0.15)
    near = mixing.nearest_seeds(sized, mixing.source_rates(sized))
    taken = mixing.with_copies(sized.withColumn("rate", F.lit(0)).withColumn("seed", F.lit(1)), near).toPandas()
    for s, group in taken.groupby("source", dropna=False):
        assert (group["size"] * group["copies"]).sum() == pytest.approx(group["target"].iloc[0], rel=0.01)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == taken["copies"].sum()
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() > 0
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.withColumn("text", docs["text"].substr(1, 0))).count() == 0  # no words, no targets


def test_nearest_odd(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(8).tolist(), 0) for k in range(300)] + [(k, [1.0] * 8, 0) for k in range(300, 900)] + [(5, None, 1), (None, [1.0] * 8, 1), (901, [], 1), (902, [0.0] * 8, 1)]
    rows += [(903, [1.0] * 7 + [None], 1), (904, [1.0] * 7 + [float("nan")], 1), (905, [1.0] * 7 + [float("inf")], 1), (906, [1.0], 1), (300, [1.0] * 8, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = rabitq.nearest(frame, 20, 20).toPandas()
    clean = {k: np.array(v, np.float32).astype(np.float64) for k, v, _ in rows[:900]}
    assert set(got["query_id"]) == {k for k in clean if k % 20 == 0}
    near = got[got["query_id"] == 320].sort_values("rank")
    ids = np.array(sorted(clean))
    s = np.array([clean[k] @ clean[320] for k in ids])
    assert list(near["vec_id"]) == [k for k in ids[np.lexsort((ids, -np.round(s, 12)))] if k != 320][:20]  # ties to the smaller id
    few = rabitq.nearest(frame.where("vec_id in (20, 21, 22)"), 20, 20).collect()
    assert [r["rank"] for r in sorted(few)] == [1, 2]
    assert rabitq.nearest(frame.where("1 = 0")).count() == 0


def test_blocks_of_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 16))
    codes = rabitq.pin(rabitq.index(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")))
    whole = rabitq.search(codes, codes.where("vec_id % 10 = 0"), 5, sure=50.0).collect()
    parts = rabitq.search(codes, codes.where("vec_id % 10 = 0"), 5, sure=50.0, block=37).collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 250
    for r in whole:
        if r["rank"] == 1:
            s = x @ x[r["query_id"]]
            s[r["query_id"]] = -np.inf
            assert r["vec_id"] == s.argmax()


def test_codes_of_nearest_leave_few_rows(spark):
    """Of 2,000 rows a query reranks those that may reach its k-th best: a few times k, not a share of the table."""
    x = np.random.default_rng(10).standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = rabitq.index(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    codes = codes.select("vec_id", "norm", "a").orderBy("vec_id").toPandas()
    spread = (codes["norm"] * np.sqrt(1 - codes["a"] ** 2) / codes["a"] / np.sqrt(63) * rabitq.SURE).to_numpy()
    for q in range(0, 2000, 100):
        s = np.delete(x @ x[q], q)
        assert (s + np.delete(spread, q) >= np.sort(s)[-20]).sum() <= 80


def test_lengths_of_nearest(spark, monkeypatch):
    """Lengths far beyond single precision, an odd number of components, and blocks that grow with the table."""
    rng = np.random.default_rng(11)
    for scale in (1e-120, 1.0, 1e30, 1e120):
        x = rng.standard_normal((400, 7)) * scale * rng.choice([1e-3, 1.0, 1e3], (400, 1))
        frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        codes = rabitq.pin(rabitq.index(frame))
        for blocks in (64, 3):
            monkeypatch.setattr(rabitq, "BLOCKS", blocks, raising=False)
            got: dict[int, list[int]] = {}
            for r in rabitq.search(codes, codes.where("vec_id % 40 = 0"), 5, block=90).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append(r["vec_id"])
            assert sorted(got) == list(range(0, 400, 40))
            for q, found in got.items():
                s = x @ x[q]
                s[q] = -np.inf
                assert found == list(np.argsort(-s)[:5])


def test_top_k(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(5)]
    value = lambda: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 3, 9))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(k, signed(value())) for k in range(400)] + [(k, signed(centres[0])) for k in range(400, 600)]
    frame = spark.createDataFrame(rows, "vec_id long, code long")
    got = {}
    for r in mih.search(frame, frame.where("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    for q in range(0, 600, 50):
        best = sorted((bin((c ^ rows[q][1]) & ((1 << 64) - 1)).count("1"), k) for k, c in rows if k != q)[:10]
        assert sorted(got[q]) == [(i, d, k) for i, (d, k) in enumerate(best, 1)]
    assert mih.search(frame.where("1 = 0"), frame.where("1 = 0")).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, -1.0]), (1, None), (2, []), (3, [1.0, None]), (None, [1.0, 2.0]), (4, [float("nan"), 1.0]), (5, [2.0, -3.0]), (5, [2.0, -3.0])], "vec_id long, embedding array<float>")
    assert sorted(mih.sign_codes(vectors).collect()) == [(0, 1), (5, 1)]
    assert mih.nearest(vectors).collect() == [(0, 1, 5, 0)]


@pytest.mark.parametrize("longest", [65, 150])
def test_top_k_of_long_vectors(spark, longest):
    """Vectors of several words, of unlike lengths, among them copies and one that is nearest to nothing."""
    rng = random.Random(longest)
    base = [[rng.choice((-1.0, 1.0)) for _ in range(longest)] for _ in range(6)]
    rows = []
    for k in range(90):
        v = [x if rng.random() > 0.04 else -x for x in base[k % 6]]
        rows.append((k, v[: longest - k % 3 * 20] if k % 7 else base[k % 6]))
    rows += [(200, [1.0] * longest), (201, [1.0]), (202, None), (203, [float("nan")] * longest)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    signs = {i: [x > 0 for x in v] + [False] * (longest - len(v)) for i, v in rows if v and v[0] == v[0]}
    got = {}
    for r in mih.nearest(frame, every=20, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    assert set(got) == {0, 20, 40, 60, 80, 200}
    for q, found in got.items():
        best = sorted((sum(a != b for a, b in zip(signs[q], s)), i) for i, s in signs.items() if i != q)[:5]
        assert sorted(found) == [(n, d, i) for n, (d, i) in enumerate(best, 1)]


def test_shards_odd(odd, none, spark, tmp_path):
    out = shards.shard(odd, 3)
    assert sorted(out.columns) == sorted(odd.columns)
    got = out.collect()
    assert len(got) == 10 and sorted(sum(r["shard"] == s for r in got) for s in range(3)) == [3, 3, 4]
    assert shards.shard(none).count() == 0
    repeated = spark.range(1000).selectExpr("1 as doc_id", "'same' as text", "id")
    for bucket_bytes in (500, 1 << 20):
        placed = shards.shard(repeated, 7, bucket_bytes=bucket_bytes)
        assert sorted(r["id"] for r in placed.collect()) == list(range(1000))
        counts = placed.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
        assert all(r["max(slot)"] + 1 == r["count(1)"] and r["count(1)"] in (142, 143) for r in counts)
    shards.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 1000


def test_quality_odd(odd, none, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None), (4, 7), (2, 0), (2, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, words(40, k) if k % 2 else "### " * 30) for k in range(200)], "doc_id long, text string")
    trees = quality.fit(docs, labels, trees=10)
    out = quality.score(odd, trees)
    assert out.count() == 10 and all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality.accepted(odd, trees).columns == odd.columns
    assert quality.score(none, trees).count() == 0
    assert {r["predicted"] for r in quality.score(docs.where("doc_id % 2 = 0"), trees).collect()} == {0}
    blank = quality.fit(docs, labels.where("1 = 0"))
    assert {r["score"] for r in quality.score(docs, blank).collect()} == {0.5}


def test_flattened_trees():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.grow(x, y, trees=40, depth=3)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice"><p>We use cookies. Do you agree?</p></div><main><h1>On  &amp; off</h1><p>First <b>para</b>graph&nbsp;of the text, which is long enough to read.<p>Second one &lt;here&gt;, with more words in it.
<div class="advert">Buy now</div></main><div id="comments"><div class="comment"><p>Nice article, I liked it a lot.</p></div></div><aside>More</aside><script>x("<p>no</p>")</script><footer>&copy; me</footer>"""


def test_main_text_odd(spark):
    training = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    chain = html_crf.fit(training)
    rows = [(1, PAGE, "a"), (2, None, "b"), (3, "", "c"), (4, "<p", "d"), (5, "<article><p>" + "long words, of many. " * 50_000 + "</article>", "e"), (1, PAGE, "a"), (None, "<nav>a</nav>", None)]
    out = {r["page_id"]: r["text"] for r in html_crf.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), chain).collect()}
    assert out[1] == "On & off\n\nFirst paragraph of the text, which is long enough to read.\n\nSecond one <here>, with more words in it."
    assert out[2] == out[3] == "" and len(out[5]) == 50_000 * 21 - 1
    assert html_crf.extract(training.where("1 = 0"), html_crf.fit(training.where("1 = 0"))).count() == 0


def test_viterbi():
    rng = random.Random(11)
    chain = html_crf.Chain({f: (rng.gauss(0, 1), rng.gauss(0, 1)) for f in "abcdef"}, ((0.5, -0.4), (-0.3, 0.7)))
    for _ in range(30):
        rows = [rng.sample("abcdefxyz", 3) for _ in range(rng.randint(1, 7))]

        def worth(labels):
            return sum(chain.weight.get(f, (0, 0))[y] for row, y in zip(rows, labels) for f in row) + sum(chain.move[a][b] for a, b in zip(labels, labels[1:]))

        assert worth(chain.decode(rows)) == pytest.approx(max(map(worth, itertools.product((0, 1), repeat=len(rows)))))


def test_licenses(spark, odd, none):
    rows = [
        (1, "Copyright (c) 2020 Foo Bar\r\n\r\n" + licenses.MIT.lower().replace("sublicense", "sub-licence")), (2, licenses.MIT + " x"), (3, None),
        (4, "x\n  Released under the MIT Licence!\nmore"), (5, "MIT License\nCopyright © 2001 me\nAll rights reserved.\n\n" + licenses.MIT), (6, "The above copyright notice"),
    ]
    got = sorted((r["doc_id"], r["line"], r["license_id"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["license_id"])
    assert got == [(1, 0, "MIT"), (4, 2, "MIT"), (5, 0, "MIT")]
    assert licenses.scan(odd).count() == 10 and licenses.scan(none).count() == 0


def test_backoff_odd(odd, none):
    got = {r["doc_id"]: r for r in lm.scores(odd).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5, 6, 7}
    assert got[2]["log_score"] == 0 and got[2]["mean_log_score"] is None and got[1]["n_words"] == 160
    assert all(r["log_score"] < 0 for r in got.values() if r["n_words"])
    assert lm.scores(none).count() == 0
    one, four = ({r["doc_id"]: r["log_score"] for r in lm.scores(odd, passes=p).collect()} for p in (1, 4))
    assert one == pytest.approx(four)


@pytest.mark.parametrize(("order", "shared"), [(1, False), (2, False), (2, True), (3, False), (4, True)])
def test_backoff_by_force(spark, order, shared):
    """Scores by the rule itself: a gram of one document is known too unless only shared ones are."""
    rng = random.Random(12)
    texts = {k: " ".join(rng.choices("abcde", k=rng.randint(1, 30))) for k in range(12)} | {20: "x y x y x y z", 21: ""}
    padded = {k: ["<s>"] * (order - 1) + t.split() for k, t in texts.items() if t}
    count, holders = {}, {}
    for k, w in padded.items():
        for size in range(1, order + 1):
            for i in range(len(w) - size + 1):
                gram = tuple(w[i : i + size])
                count[gram] = count.get(gram, 0) + 1
                holders.setdefault(gram, set()).add(k)
    total = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))

    def score(gram):
        if len(gram) == 1:
            return np.log(count[gram] / total)
        if len(holders.get(gram, ())) >= 1 + shared:
            context = count[gram[:-1]] if gram[:-1] != ("<s>",) * (len(gram) - 1) else len(padded)
            return np.log(count[gram] / context)
        return np.log(0.4) + score(gram[1:])

    want = {k: sum(score(tuple(w[i - order + 1 : i + 1])) for i in range(order - 1, len(w))) for k, w in padded.items()} | {21: 0}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["log_score"] for r in lm.scores(frame, order=order, shared=shared).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("order", [2, 3])
def test_backoff_of_documents_that_are_not_counted(spark, order, monkeypatch):
    """Documents outside the model back off, step by step, where it doesn't know their grams; small blocks and ranges give the same."""
    rng = random.Random(13)
    texts = {k: " ".join(rng.choices("abcdef", k=rng.randint(1, 12))) for k in range(14)} | {20: "a q b c d", 21: "", 22: "q q", 23: None}
    padded = {k: ["<s>"] * (order - 1) + t.split() for k, t in texts.items() if t}
    count = {}
    for k, w in padded.items():
        for size in range(1, order + 1):
            for i in range(len(w) - size + 1 if k < 8 else 0):
                count[tuple(w[i : i + size])] = count.get(tuple(w[i : i + size]), 0) + 1
    total = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))

    def score(gram):
        if len(gram) == 1:
            return np.log(max(count.get(gram, 0), 1) / total)
        if gram in count:
            return np.log(count[gram] / (8 if gram[:-1] == ("<s>",) * (len(gram) - 1) else count[gram[:-1]]))
        return np.log(0.4) + score(gram[1:])

    want = {k: sum(score(tuple(w[i - order + 1 : i + 1])) for i in range(order - 1, len(w))) for k, w in padded.items()} | {21: 0, 23: 0}
    assert any(tuple(w[i : i + order]) not in count for k, w in padded.items() if 8 <= k < 20 for i in range(len(w) - order + 1))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    for words, grams in ((lm.BLOCK_WORDS, lm.RANGE_GRAMS), (10, 5)):
        monkeypatch.setattr(lm, "BLOCK_WORDS", words)
        monkeypatch.setattr(lm, "RANGE_GRAMS", grams)
        got = {r["doc_id"]: r["log_score"] for r in lm.scores(frame, order=order, counted=F.col("doc_id") < 8).collect()}
        assert got == pytest.approx(want)


def test_every_known_notice_in_a_text(spark):
    """Each notice is found as a line among others, whether it has the word licence or not, in any spelling."""
    known = dict.fromkeys(t for _, t in licenses.known_texts() if "\n" not in t)
    forms = [f for t in known for f in (t, f" * {t.upper()}.", t.replace("icense", "icence"))]
    frame = spark.createDataFrame([(k, f"x\r\n{f}\nthe end of it") for k, f in enumerate(forms)], "doc_id long, text string")
    got = {r["doc_id"]: r["line"] for r in licenses.scan(frame).collect() if r["license_id"]}
    assert got == {k: 3 for k in range(len(forms))}
    assert all(a[:3] == b[:3] for a, b in licenses.SPELLINGS)


def test_main_text_of_pages_with_drawings(spark):
    """Drawings without an end tag hide nothing, formulas stay, and short articles come out to the letter."""
    chain = html_crf.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    one, two = "The first paragraph of the article, which is long enough.", "The second one, with some more words in it."
    icons = ["<svg class='icon'/>", "<svg class='icon' />", "<svg viewBox=\"0 0 1 1\"><title>no</title><path d='M0'/></svg>", "<svg class='icon'>", "<math/>", "<canvas>", "<object data='x'/>"]
    pages = [f"<html><body><nav><a href='/'>{i}Home</a></nav><article>{i}<p>{one}</p><p>{i}{two}</p></article></body></html>" for i in icons]
    pages.append(f"<article><p>{one}</p><p>Here <math><mi>x</mi><mo>=</mo><semantics><mn>2</mn><annotation encoding='tex'>x=2</annotation></semantics></math> holds, as {two}</p></article>")
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_crf.extract(frame, chain).collect()}
    assert got == {k: f"{one}\n\n{two}" for k in range(len(icons))} | {len(icons): f"{one}\n\nHere x=2 holds, as {two}"}


def test_training_takes_whole_pages():
    page = f"<body><article>{''.join(f'<p>Sentence {k} of the article.</p>' for k in range(200))}</article></body>"
    assert [len(labels) for _, labels in html_crf.training_set([page])][0] == 200 and sum(html_crf.training_set([page])[1][1]) == 200


def test_main_text_broken_markup():
    """Tags without end, and very deep trees, are read in linear time; no text behind them is lost."""
    import time

    for unit in ("<a", "<b ", "<svg>", "</svg", "<div>x", '<a =">"', "<!--", "<li>x<ul>", "<p>x<table>"):
        begin = time.monotonic()
        page = unit * (1_000_000 // len(unit))
        html_crf.features(html_crf.read_blocks(page))
        assert time.monotonic() - begin < 30, unit
        if unit not in ("<!--", "</svg", "<a", "<b ", '<a =">"'):
            assert html_crf.read_blocks(page + "<p>the end</p>")[-1].text == "the end"
    deep = html_crf.read_blocks("<main>" + "<div>" * 600 + "in" + "</div>" * 600 + "<p>out</p></main><p>behind</p>")
    assert [(b.text, b.place.tag if b.place else None) for b in deep] == [("in", "div"), ("out", "p"), ("behind", "p")]
    assert [html_crf.own_labels(deep)] == [[1, 1, 0]]


def test_main_text_numbers_and_names(spark):
    text = html_crf.read_blocks("<p>&#" + "9" * 6000 + "; &#" + "0" * 6000 + "65; &amp x &lt;</p>")[0].text
    assert text == "\ufffd A & x <"
    chain = html_crf.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    body = "<p>The harbour was quiet in the morning, and nobody had yet come to the boats. So we waited for the tide.</p>" * 4
    for tag, name in (("article", "story side"), ("main", "sidebar content"), ("div", "content")):
        blocks = html_crf.read_blocks(f"<html><body><nav><a href=x>Home</a></nav><{tag} class='{name}'>{body}</{tag}><footer>Imprint</footer></body></html>")
        assert chain.decode(html_crf.features(blocks)) == [0, 1, 1, 1, 1, 0]


def test_mixing_small_sources(spark):
    """Ten documents a source still come near their targets, and every draw is the one that its source's seed gives."""
    rows = [(k, words(1 + (k * 37) % 90, k), "en", "abcde"[k % 5], 0) for k in range(50)]
    sized = spark.createDataFrame(rows, DOCS).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rates = mixing.nearest_seeds(sized, mixing.source_rates(sized))
    best = {r["source"]: r for r in rates.collect()}
    taken = mixing.with_copies(sized, rates).toPandas()
    for s, group in taken.groupby("source"):
        r, off = best[s], {}
        for seed in range(17, 17 + 64):
            draws = [int(hashlib.md5(f"{seed}|{d}".encode()).hexdigest()[:8], 16) / 2**32 for d in group["doc_id"]]
            copies = [int(r["rate"]) + (u < r["rate"] - int(r["rate"])) for u in draws]
            off[seed] = abs(float(sum(c * n for c, n in zip(copies, group["size"]))) - r["target"])
            if seed == r["seed"]:
                assert list(group["copies"]) == copies
        assert off[r["seed"]] == min(off.values()) and r["seed"] == min(k for k in off if off[k] == min(off.values()))
        assert (group["size"] * group["copies"]).sum() == pytest.approx(r["target"], rel=0.05)
