"""The registered queries of this package and the SQL that some of them have to agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm import alignment, bpe, html_crf, hyperminhash, licenses, lm, mih, mixing, quality, rabitq, rules, shards, whitening
from iotrail.llm.common import word_count
from iotrail.session import pin

#: The vocabulary that the queries use; the operators take any path.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    low = f"replace(lower({text}), chr(13), chr(10))"
    plain = f"trim(regexp_replace(regexp_replace({low}, {_sql(licenses.COPYRIGHT_LINE)}, ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for a, b in licenses.SPELLINGS:
        plain = f"replace({plain}, {_sql(a)}, {_sql(b)})"
    return plain


OP1_SQL = f"""
with known as (
  select sha256({_canonical_sql("body")}) digest, min(license_id) license_id from (values
  {", ".join(f"({_sql(i)}, {_sql(t)})" for i, t in licenses.known_texts())}) as t(license_id, body) group by 1
), lines as (
  select doc_id, generate_subscripts(l, 1)::int line, unnest(l) body from (select doc_id, string_split(replace(text, chr(13), chr(10)), chr(10)) l from documents where text is not null)
), units as (
  select doc_id, 0 line, coalesce(text, '') body from documents
  union all
  select doc_id, line, body from lines
), digests as (
  select doc_id, line, sha256({_canonical_sql("body")}) digest from units
)
select d.doc_id, d.line, d.digest, k.license_id from digests d left join known k on d.digest = k.digest where d.line = 0 or k.license_id is not null
"""


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


OP2_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: (x > 0)::int) bits from embeddings where vec_id is not null and len(embedding) > 0
), pairs as (
  select q.vec_id query_id, r.vec_id, list_sum(list_transform(list_zip(q.bits, r.bits), lambda p: abs(coalesce(p[1], 0) - coalesce(p[2], 0))))::int distance
  from rows q join rows r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id
)
select query_id, row_number() over (partition by query_id order by distance, vec_id)::int rank, vec_id, distance
from pairs qualify rank <= 10
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, carry=["doc_id"])


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP5_SQL = """
with texts as (
  select doc_id, string_agg(t.text, ' ') text from documents t group by doc_id
), w as (
  select doc_id, unnest(l) w, generate_subscripts(l, 1) i from (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') l from texts)
), words as (
  select w, count(*) c from w group by w
), total as (
  select sum(c)::double n from words
), pairs as (
  select doc_id, coalesce(lag(w) over (partition by doc_id order by i), '') v, w from w
), known as (
  select v, w, count(*) c from pairs group by v, w
), contexts as (
  select w v, c from words union all select '', count(distinct doc_id) from w
), gains as (
  select k.v, k.w, ln(k.c / x.c::double) - ln(0.4 * y.c / n) gain from known k join contexts x on k.v = x.v join words y on k.w = y.w, total
), sums as (
  select p.doc_id, count(*) n_words, sum(ln(0.4 * y.c / n) + coalesce(g.gain, 0)) s
  from pairs p join words y on p.w = y.w left join gains g on p.v = g.v and p.w = g.w, total group by p.doc_id
)
select t.doc_id, coalesce(n_words, 0)::bigint n_words, round(coalesce(s, 0), 3) log_score, round(s / n_words, 6) mean_log_score
from texts t left join sums u on t.doc_id is not distinct from u.doc_id
"""


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_crf.extract(pages, html_crf.fit(pages), carry=["page_id", "url"])
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = pin(docs)  # texts are read once
    rates = pin(mixing.nearest_seeds(sized, mixing.source_rates(sized)))
    taken = mixing.with_copies(sized, rates)
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = """
with sized as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end size from documents
), sums as (
  select source, sum(size)::bigint source_size from sized group by source
), weighed as (
  select source, source_size, ([5, 2, 1])[1 + ((row_number() over (order by source nulls last) - 1) % 3)]::bigint weight from sums
), filled as (
  -- if the k sources with the least room per weight are full, this is the level for the rest
  select *, row_number() over w k,
         coalesce(sum(3 * source_size) over (w rows between unbounded preceding and 1 preceding), 0)::bigint full_words,
         (sum(weight) over () - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0))::bigint open_weight,
         sum(source_size) over ()::bigint total
  from weighed window w as (order by source_size::double / weight, source nulls last)
), level as (
  select total - full_words words, open_weight share from filled
  where weight * (total - full_words) <= 3 * source_size * open_weight order by k limit 1
), rates as (
  select source, source_size,
         case when weight * words > 3 * source_size * share then (3 * source_size)::double else (weight * words)::double / share::double end target
  from weighed, level
), rated as (
  select *, case when source_size > 0 then target / source_size::double else 0 end rate from rates
), tried as (
  -- what 64 seeds would take of every source
  select s.source, k seed, abs((floor(any_value(r.rate))::bigint * any_value(r.source_size) + sum(case when
    ('0x' || substr(md5(k || '|' || coalesce(s.doc_id::varchar, '')), 1, 8))::bigint::double / 4294967296.0 < r.rate - floor(r.rate) then s.size else 0 end)::bigint)::double
    - any_value(r.target)) off
  from sized s join rated r on s.source is not distinct from r.source, range(17, 81) t(k) group by s.source, k
), seeded as (
  select r.*, b.seed from rated r join (select source, arg_min(seed, (off, seed)) seed from tried group by source) b on r.source is not distinct from b.source
)
select s.doc_id, s.source, s.size, r.source_size, r.target, c.copies, s.size * c.copies taken
from sized s join seeded r on s.source is not distinct from r.source,
lateral (select floor(r.rate)::bigint
  + (('0x' || substr(md5(r.seed || '|' || coalesce(s.doc_id::varchar, '')), 1, 8))::bigint::double / 4294967296.0 < r.rate - floor(r.rate))::bigint copies) c
"""


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        shards.byte_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, trees, ["doc_id"]).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, model = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")  # the ranks of byte_bpe_50k.json
    aligned = alignment.groups(table(spark, sf_dir, "documents"), ranks, model, carry=["doc_id"])
    return alignment.scored(aligned).select("doc_id", *alignment.OUTPUT)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _value_sql(m: rules.Measure) -> str:
    return f"{m.top}::double / greatest({m.bottom}, 1)"


def _limits_sql(keys: str) -> str:
    """The limits of every group and measure from sketches, as in ``rules.limits``."""
    by, first = ("group by " + keys + ", measure", keys + ", ") if keys else ("group by measure", "")
    part = f"partition by {first}measure"
    worth = f"case when bucket is null then 0 else pow({rules.FACTOR}, bucket) * {2 / (rules.FACTOR + 1)!r} end"
    at = lambda q: f"min(v) filter (seen >= ceil(size * {q}))"
    return f"""
  select {first}measure, max(size) size, q2 - reach low, q2 + reach high from (
    select *, {12.0} * greatest(least(q2 - q1, q3 - q2), least_of) reach from (
      select {first}measure, max(size) size, max(least_of) least_of, {at(0.25)} q1, {at(0.5)} q2, {at(0.75)} q3 from (
        select *, sum(n) over ({part} order by v) seen, sum(n) over ({part}) size from (
          select {first}measure, max(least_of) least_of, {worth} v, sum(n) n from cells group by {first}measure, bucket)) {by})) {by}, q2, reach"""


OP12_SQL = f"""
with d as (
  select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents
), w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from d
), windows as (
  select rid, i, [ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]] g from (select rid, ws, unnest(range(1, len(ws) - 3)) i from w)
), again as (
  select rid, unnest(range(i, i + 5)) p from windows qualify count(*) over (partition by rid, g) > 1
), repeats as (
  select rid, count(distinct p) n from again group by rid
), counts as (
  select rid, doc_id, lang, source, len(ws) n_words, length(array_to_string(ws, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
         len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words from w left join repeats using (rid)
), cells as (
  {" union all ".join(f"select lang, source, '{m.name}' measure, {m.least} least_of, case when {m.top} > 0 then ceil(ln({_value_sql(m)}) / ln({rules.FACTOR}))::int end bucket, count(*) n from counts where n_words > 0 group by all" for m in rules.MEASURES)}
), own as ({_limits_sql("lang, source")}
), tongue as ({_limits_sql("lang")}
), whole as ({_limits_sql("")}
), picked as (
  select own.lang, own.source, own.measure, case when own.size >= 100 then own.low when tongue.size >= 100 then tongue.low else whole.low end low,
         case when own.size >= 100 then own.high when tongue.size >= 100 then tongue.high else whole.high end high
  from own join tongue on own.lang is not distinct from tongue.lang and own.measure = tongue.measure join whole on own.measure = whole.measure
), valued as (
  {" union all ".join(f"select rid, lang, source, '{m.name}' measure, {_value_sql(m)} v, {'true' if m.low else 'false'} has_low from counts where n_words > 0" for m in rules.MEASURES)}
), beyond as (
  select distinct rid from valued v join picked p on v.lang is not distinct from p.lang and v.source is not distinct from p.source and v.measure = p.measure
  where v.v > high or (has_low and v.v < low)
)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
       base_failed, not base_failed and rid not in (select rid from beyond) kept
from (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from counts)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    white = whitening.whiten(vectors, whitening.fit(vectors), carry=["vec_id"])
    return white.withColumn("deviation", F.col("deviation").try_cast("long")).select("vec_id", *whitening.OUTPUT)  # null beyond 64 bits


QUERIES = {f.__name__: f for f in (op1_licenses, op2_hamming_top_k, op3_near_duplicates, op4_bpe, op5_backoff_scores, op6_main_text, op7_mixture, op8_nearest, op9_shards, op10_quality, op11_alignment, op12_quality_rules, op13_whitening)}
ORACLE_SQL = {"op1_licenses": OP1_SQL, "op2_hamming_top_k": OP2_SQL, "op5_backoff_scores": OP5_SQL, "op7_mixture": OP7_SQL, "op12_quality_rules": OP12_SQL}
