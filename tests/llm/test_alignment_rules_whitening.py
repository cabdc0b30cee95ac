"""Cross-tokenizer alignment, adaptive quality rules and whitening against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from iotrail.llm import alignment, rules, whitening
from iotrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  a", "a  b", "▁", "x ▁ y", "<|endoftext|> <s> <unk> </s>", "\x00\x01", "café 你好 \U0001f600\U0001f3fd", "é é", "　wide", "tab\tline\r\n\r\nend ",
    "same text", "same text", "word " * 3000, "ab" * 5000, " " * 3000, "\n" * 3000, "it's we'll THEY'RE 123456 ##!!",
]


def by_force(texts: dict[int, str | None]):
    """Alignment by comparing token ranges one by one."""
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters.values())}
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    found = {}
    for doc, text in texts.items():
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_raw, b_raw = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            found[doc] = ([], [], [], [])
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links, j = [], 0
        for k, (i, e) in enumerate(zip(a, a_end)):
            s = a_end[k - 1] if k else 0
            while b_end[j] <= s:
                j += 1
            m = j
            while m < len(b) and (b_end[m - 1] if m else 0) < e:
                links.append((i, b[m]))
                m += 1
        found[doc] = (a, b, groups, links)
    counts = Counter(p for _, _, _, links in found.values() for p in set(links))
    top = defaultdict(int)
    for (i, _), c in counts.items():
        top[i] = max(top[i], c)
    out = {}
    for doc, (a, b, groups, links) in found.items():
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out[doc] = (len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest)
    return out


def aligned(frame):
    rows = frame.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: tuple(r[c] for c in alignment.OUTPUT) for r in rows}


def test_alignment(spark, con):
    got = aligned(QUERIES["op11_alignment"](spark, SF))
    assert got == by_force(dict(con.sql("select doc_id, text from documents").fetchall()))


@pytest.mark.parametrize("broadcast", [0, alignment.BROADCAST])
def test_alignment_odd(spark, broadcast, monkeypatch):
    """Nulls, empty and long texts, blanks of all kinds, texts that B changes, repeated texts, few and many texts together, columns that clash."""
    monkeypatch.setattr(alignment, "SHARE", 8)  # some pairs are frequent, others are not
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(ODD)], "doc_id long, text string, n_a string, N_LINKS int")
    out = alignment.scored(alignment.groups(docs, RANKS, MODEL, shown="shown"), broadcast=broadcast)
    assert sorted(out.columns) == sorted(["doc_id", "text", "shown", *alignment.OUTPUT])
    want = by_force(dict(enumerate(ODD)))
    assert aligned(out) == want
    for r in out.collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["shown"].encode()).hexdigest() if r["shown"] else "")
    nothing = alignment.scored(alignment.groups(docs.limit(0), RANKS, MODEL))
    assert nothing.count() == 0


def test_alignment_in_pieces(monkeypatch):
    """Texts are cut where no token lies across."""
    with open(RANKS, "rb") as a, open(MODEL, "rb") as b:
        sides = alignment.Sides(a.read(), b.read())
    texts = [" ".join(t for t in ODD if t and "▁" not in t), "a  b   c d\n e f 　 g hi's " * 50]
    whole = [sides.tokens(t) for t in texts]
    monkeypatch.setattr(alignment, "PIECE", 5)
    assert len(sides.pieces(texts[1])) > 100
    assert [sides.tokens(t) for t in texts] == whole


def test_long_white_space():
    """Runs of white space that the pattern of the ranks can't take come out as the tokenizers library has them."""
    with open(RANKS, "rb") as a, open(MODEL, "rb") as b:
        sides = alignment.Sides(a.read(), b.read())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("a" + " " * 200_000 + "b", " " * 1500, "x\n" + " \n" * 60_000, "　" * 2000 + "y", " " * 999 + "\x1c" + " " * 1000 + "\x1d z"):
        assert sides.a_ids(" " + t) == library.encode(" " + t, add_special_tokens=False).ids
        assert all(sides.tokens(t))


def test_gallop():
    rng = np.random.default_rng(5)
    for _ in range(50):
        long = np.unique(rng.integers(0, 1000, rng.integers(1, 200)))
        short = np.unique(np.append(rng.integers(0, long[-1] + 1, rng.integers(1, 50)), long[-1]))
        guess = rng.integers(0, len(long), len(short))
        assert (alignment.gallop(short, long, guess) == np.searchsorted(long, short)).all()


def repeats_by_force(words):
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return len({p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)})


def test_counts():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 60))) for _ in range(200)]
    texts += ["a\nb c\n\n \na\nb c\na ", "x\x1cy   z w", "# $$ a*b % & | < > @ éé", "\n\n", "one two three four five " * 2]
    for t in texts:
        words, lines = re.findall("[^\x20\x09-\x0d]+", t), [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), repeats_by_force(words))
        assert rules.count(t.encode()) == want
    assert rules.count(None) == rules.count(b"") == (0,) * 6


def test_sketches_merge(spark):
    """Sketches of parts, added, are the sketch of the whole, and quantiles are within a hundredth."""
    rng = np.random.default_rng(9)
    values = np.floor(np.exp(rng.normal(3, 2, 5000))).astype(int)
    rows = spark.createDataFrame([(int(v), 100, k % 7) for k, v in enumerate(values)], "top long, bottom long, part int")
    measure = (rules.Measure("m", "top", "bottom", True, True, 0.0),)
    whole = {(r["measure"], r["bucket"]): r["n"] for r in rules.sketches(rows, [], measure).collect()}
    parts = {(r["measure"], r["bucket"]): r["n"] for r in rules.merged(rules.sketches(rows, ["part"], measure), []).collect()}
    assert whole == parts
    found = rules.limits(rules.sketches(rows, [], measure), [], measure, reach=1.0).first()
    exact = np.quantile(values / 100, [0.25, 0.5, 0.75], method="inverted_cdf")
    spread = min(exact[1] - exact[0], exact[2] - exact[1])
    assert found["high_m"] == pytest.approx(exact[1] + spread, rel=0.03) and found["size"] == 5000


def kept_by_force(rows, few, reach=12.0):
    """Limits from exact quartiles; the sketches are within a hundredth of them."""
    found = [(lang, source, rules.count(t.encode() if t else None)) for _, t, lang, source in rows]
    ratio = lambda m, c: c[rules.COUNTS.index(m.top)] / max(c[rules.COUNTS.index(m.bottom)], 1)
    out = []
    for lang, source, c in found:
        ok = c[0] >= 10 and 100 * c[5] <= 20 * c[0]
        own = [x for a, b, x in found if (a, b) == (lang, source) and x[0]]
        group = own if len(own) >= few else [x for a, _, x in found if a == lang and x[0]]
        group = group if len(group) >= few else [x for _, _, x in found if x[0]]
        for m in rules.MEASURES if c[0] else ():
            q1, q2, q3 = np.quantile([ratio(m, x) for x in group], [0.25, 0.5, 0.75], method="inverted_cdf")
            spread = reach * max(min(q2 - q1, q3 - q2), m.least)
            ok &= ratio(m, c) <= q2 + spread if m.high else True
            ok &= ratio(m, c) >= q2 - spread if m.low else True
        out.append(bool(ok))
    return out


@pytest.mark.parametrize("broadcast", [0, rules.BROADCAST])
def test_rules(spark, broadcast):
    """Limits follow the group: code is full of symbols and stays, prose with as many goes; small and null groups lean on larger ones."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    text = lambda n, mark="": " ".join(word() + (mark if rng.random() < 0.7 else "") for _ in range(n))
    rows = [(k, text(60), "en", "news") for k in range(40)] + [(100 + k, text(60, "<|>" * (1 + k % 3)), "en", "code") for k in range(40)]
    rows += [(200, text(60, "###"), "en", "news"), (201, text(60, "###"), None, None), (202, text(60), None, None), (203, text(60), "de", None)]
    rows += [(204, None, "en", "news"), (205, "", None, "news"), (206, "few words", "en", "news"), (207, "again and again and " * 20, "en", "news")]
    rows += [(208, "x" * 600 + " " + text(9), "en", "news"), (200, rows[80][1], "en", "news"), (209, "\n".join([text(9)] * 3 + [text(40)]), "en", "news")]
    docs = spark.createDataFrame([(*r, "mine", 1, 2) for r in rows], "doc_id int, text string, lang string, source string, N_WORDS string, salt int, kept int")
    out = rules.judged(docs, few=20, broadcast=broadcast)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "salt", *rules.COUNTS, "base_failed", "kept"])
    got = sorted((r["doc_id"], r["text"] or "", r["kept"]) for r in out.collect())
    assert got == sorted((r[0], r[1] or "", k) for r, k in zip(rows, kept_by_force(rows, 20)))
    kept = {d for d, _, k in got if k}
    assert kept >= {k for k in range(40)} | {100 + k for k in range(40)} | {202, 203} and not kept & {200, 204, 205, 206, 207, 208}
    stay = rules.accepted(docs, few=20, broadcast=broadcast)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == kept and {r["N_WORDS"] for r in stay.collect()} == {"mine"}
    assert rules.judged(docs.limit(0)).count() == 0


def test_rules_catch_what_labels_call_bad(spark, con):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op12_quality_rules"](spark, sf).toPandas()
    both = con.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df().merge(got, on="doc_id")
    good, bad = both[both["quality"] == 1], both[both["quality"] == 0]
    assert good[~good["base_failed"]]["kept"].mean() > 0.99 and bad["kept"].mean() < 0.1


def white_by_force(rows, components=4):
    """Integer sums exactly, eigenvectors by the library in double precision."""
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = {}
    for d in {len(v) for v in x.values()} - {0}:
        fit = sorted({tuple(v) for v in x.values() if len(v) == d})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        mean = np.array([float(Fraction(s, n)) for s in sums])
        y = np.array(fit, dtype=float) - mean
        e, q = np.linalg.eigh(y.T @ y / n)
        for k, v in x.items():
            if len(v) == d:
                for c in range(min(components, d)):
                    dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
                    out[k, c + 1] = (n, dev, (np.array(v, float) - mean) @ q[:, d - 1 - c] / math.sqrt(max(e[d - 1 - c], 1e-300)), e[d - 1 - c] / e.sum() if e.sum() > 0 else 0.0)
    return out


def check_white(rows, got, skip=()):
    want = white_by_force(rows)
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    signs = {}
    for r in got:
        n, dev, white, share = want[r["vec_id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, dev)
        assert r["explained"] == pytest.approx(share, rel=1e-9, abs=1e-12)
        if r["component"] not in skip and abs(white) > 1e-6:
            sign = signs.setdefault((n, r["component"]), np.sign(white * r["whitened"]))
            assert sign * r["whitened"] == pytest.approx(white, rel=1e-7, abs=1e-9)


def test_whitening(spark, con):
    rows = con.sql("select vec_id, embedding from embeddings").fetchall()
    got = QUERIES["op13_whitening"](spark, SF).collect()
    assert len(got) == 4 * len(rows) and got[0]["identity_error"] < 1e-9
    check_white(rows, got)


def test_whitening_odd(spark):
    """Nulls, empty and repeated vectors, unlike lengths, large entries, components without variance, columns that clash, nothing at all."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.normal(size=3) * [4, 2, 1]]) for k in range(40)]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (60, None), (61, []), (62, [1.0, None, 2.0]), (63, [1.0, float("nan"), 2.0]), (64, [float("inf"), 0.0, 0.0])]
    rows += [(70 + k, [float(k), 1.0]) for k in range(3)] + [(80, [5.0])]
    table = spark.createDataFrame([(k, v, "mine", 1) for k, v in rows], "vec_id int, embedding array<float>, n string, Component int")
    out = whitening.whiten(table, whitening.fit(table))
    assert sorted(out.columns) == sorted(["vec_id", "embedding", *whitening.OUTPUT])
    got = out.collect()
    flat = [r for r in got if r["vec_id"] >= 70]
    assert {r["whitened"] for r in flat if (r["vec_id"], r["component"]) in {(70, 2), (71, 2), (80, 1)}} == {None}
    check_white([r for r in rows if r[0] < 70], [r for r in got if r["vec_id"] < 70])
    large = spark.createDataFrame([(k, [2.0**40 * k, 2.0**33 - k, float(k * k)]) for k in range(9)], "vec_id int, embedding array<double>")
    for r in whitening.whiten(large, whitening.fit(large)).collect():
        x = [[256 * c for c in (2**40 * k, 2**33 - k, k * k)] for k in range(9)]
        assert int(r["deviation"]) == sum((9 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], map(sum, zip(*x))))
    assert whitening.fit(table.limit(0)) == {} and whitening.whiten(table.limit(0), {}).count() == 0


def test_refinement():
    """Eigenvalues that float32 can't tell apart come apart; equal ones give some orthonormal basis."""
    rng = np.random.default_rng(4)
    for values in ([9, 4, 2, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.1], [3, 3, 3, 1], [1, 0, 0], [7.0], [1e6, 1e-6, 1e-7]):
        q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0].astype(np.longdouble)
        for _ in range(3):
            q = q + q @ (np.eye(len(values)) - q.T @ q) / 2
        v = (q * np.array(values, np.longdouble)) @ q.T
        e, x = whitening.eigen((v + v.T) / 2)
        assert np.allclose(e, values, rtol=1e-14, atol=1e-18 * values[0]) and np.allclose(x @ x.T, np.eye(len(values)), atol=1e-15)
        if len(set(values)) == len(values):
            room = 64 * float(np.finfo(np.longdouble).eps) * values[0] / min((a - b for a, b in zip(values, values[1:])), default=1)  # what rounding leaves open
            assert np.abs(np.abs((x @ q).astype(float)) - np.eye(len(values))).max() < max(room, 1e-14)


def test_pairs_and_broadcasts_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = alignment.groups(docs, RANKS, MODEL, carry=["doc_id"])
    a, b = (aligned(alignment.scored(rows, broadcast=n)) for n in (0, 10**6))
    assert a == b
    assert alignment.pair_counts(rows).where(F.col("best")).count() > 0
