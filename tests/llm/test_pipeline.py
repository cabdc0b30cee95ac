"""The pipeline's stages against brute force."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from iotrail.llm import quality
from .test_queries import components_by_force

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "mixing_to_weights", "bpe_encoding"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SF)
    assert good.columns == docs.columns
    trees = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, trees).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, s in scored.items() if s >= 0.5}
    once = stages[1](spark, good, SF)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert once.columns == docs.columns
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({c for _, c in components_by_force(texts, 5).values()})
    mixed = stages[2](spark, once, SF)
    assert mixed.columns == docs.columns
    counts = mixed.groupBy("doc_id").count()
    assert counts.where("count > 3").count() == 0 and mixed.select("doc_id").distinct().join(once, "doc_id", "left_anti").count() == 0
    tokens = stages[3](spark, mixed, SF)
    assert tokens.count() == mixed.count() and tokens.where("n_tokens > 0").count() == mixed.where("text <> ''").count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in mixed.collect())


def test_tokens_come_out(spark):
    """The product is the encoding: ids of every text, equal to the library's, beside the text."""
    from tokenizers import Tokenizer

    from iotrail.llm.queries import VOCABULARY

    library = Tokenizer.from_file(VOCABULARY)
    out = corpus_pipeline.run(spark, SF)
    assert set(spark.read.parquet(f"{SF}/documents.parquet").columns) < set(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, ids with two texts, columns that clash with the operators' own, and no rows at all."""
    text = " ".join(f"word{k} stands here" for k in range(60)) + ". "
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (None, text + "x", "en", "a", 2), (3, "", "de", "b", 0), (4, " ".join(f"other{k}" for k in range(5000)), "de", "a", 9)]
    rows += [(5, "one two", "en", None, 3), (5, text.upper()[::-1], "en", "b", 3), (6, " \t\n", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name in ("score", "predicted", "copies", "component_id", "kept", "N_TOKENS", "row", "key", "size", "target"):
        docs = docs.selectExpr("*", f"doc_id as {name}")
    for given in (docs, docs.where("1 = 0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert out.count() <= 3 * given.count() and (name == "bpe_encoding" or out.columns == docs.columns)
            if name == "minhash_near_dedup" and not given.isEmpty():
                assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted({(r[0] or 0, r[1] or "") for r in rows})
