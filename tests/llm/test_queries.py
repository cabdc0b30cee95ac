"""Every query of the package against SQL, or against brute force where SQL can't express it."""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pytest

from iotrail.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(frame, columns):
    return sorted(map(tuple, frame[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def components_by_force(texts: dict[int, str | None], width: int = 2):
    sets = {}
    for i, text in texts.items():
        words = WORD.findall((text or "").translate(LOW))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, con):
    got = QUERIES["op3_near_duplicates"](spark, SF).toPandas()
    want = components_by_force(dict(con.sql("select doc_id, text from documents").fetchall()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()


def test_bpe(spark, con):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    got = {r["doc_id"]: r for r in QUERIES["op4_bpe"](spark, SF).collect()}
    for doc_id, text in con.sql("select doc_id, text from documents").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got.pop(doc_id)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


def test_main_text(spark, con):
    got = {r["page_id"]: r for r in QUERIES["op6_main_text"](spark, SF).collect()}
    right = total = 0
    for page_id, url, html in con.sql("select page_id, url, html from pages").fetchall():
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        article = re.sub(r"<(aside|nav|form|script|style)\b.*?</\1>", "", article, flags=re.S)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|h2|li|ul|div)\b[^>]*>", article)]
        text = got[page_id]["text"]
        assert got[page_id]["n_chars"] == len(text) and got[page_id]["url"] == url
        total += 1
        right += text == "\n\n".join(b for b in blocks if b)
    assert right >= 0.98 * total


def test_nearest(spark, con):
    got = QUERIES["op8_nearest"](spark, SF).toPandas()
    table = con.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], np.float64)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        best = [k for k in np.lexsort((ids, -s)) if k != q][:20]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(best) + 1))
        assert np.allclose(mine["score"], [s[np.searchsorted(ids, v)] for v in mine["vec_id"]], rtol=0, atol=1e-12)
        assert (np.diff(mine["score"]) <= 0).all()
        hits, total = hits + len(set(mine["vec_id"]) & set(ids[best])), total + len(best)
    assert hits >= 0.95 * total


def test_shards(spark, con):
    import zlib

    got = QUERIES["op9_shards"](spark, SF).toPandas()
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    assert sorted(got["doc_id"]) == sorted(texts)
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    counts = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(counts) == 24 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    again = QUERIES["op9_shards"](spark, SF).toPandas()
    assert rows(got, ["doc_id", "shard", "slot"]) == rows(again, ["doc_id", "shard", "slot"])


def test_quality(spark, con):
    got = QUERIES["op10_quality"](spark, SF.replace("0.001", "0.01")).toPandas()
    labels = con.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").df().merge(got, on="doc_id")
    unseen = labels[labels["held_out"]]
    assert len(unseen) > 50 and (unseen["quality"] == unseen["predicted"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    import zlib

    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
