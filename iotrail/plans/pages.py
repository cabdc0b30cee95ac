"""Page state, file heat and memory diff queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions import scalar as S
from iotrail.functions.stats import quantiles
from iotrail.operators import heat as H
from iotrail.operators import pages as G
from iotrail.operators.scan import dealt
from iotrail.operators.series import runs
from iotrail.plans.blocks import r6, rounded
from iotrail.plans.objects import nearest
from iotrail.plans.registry import Tables, query

ITERS = 2


def pages(t: Tables, vma: DataFrame | None = None) -> DataFrame:
    """All pages of all mappings in two iterations, as page-table entries.

    Mappings are dealt out by address before they become pages, so all pages of
    a mapping are in one task, and the tasks are as many as the pages need.
    """
    vma = t.vma if vma is None else vma
    size = F.col("end_addr") - F.col("start_addr")
    each = F.explode(F.sequence(F.lit(0).cast("long"), S.int_div(size, 4096) - 1))
    n = vma.agg(F.sum(S.int_div(size, 4096))).first()[0] or 0
    rows = dealt(vma, ["start_addr"], n * ITERS).withColumn("vma_bytes", size).withColumn("page_idx", each)
    rows = rows.withColumn("iter", F.explode(F.array(*[F.lit(i).cast("long") for i in range(ITERS)])))
    base, i = S.int_div(F.col("start_addr"), 1048576), F.col("page_idx")
    states = {
        "present": (base + i) % 5 != 0,
        "swapped": (base + i) % 10 == 0,
        "file_mapped": i % 3 == 0,
        "soft_dirty": (base * 7 + i * 3 + F.col("iter")) % 4 == 0,
    }
    entry = i
    for name, on in states.items():
        flag = 1 << S.PAGE_BITS[name]
        flag = flag - (1 << 64) if flag >= 1 << 63 else flag
        entry = entry.bitwiseOR(F.when(on, F.lit(flag)).otherwise(F.lit(0).cast("long")))
    return G.decoded(rows.withColumn("entry", entry))


PAGE_SQL = """
pv AS (SELECT *, end_addr - start_addr vma_bytes, start_addr // 1048576 base FROM vma),
px AS (SELECT *, unnest(range(vma_bytes // 4096)) page_idx FROM pv),
pg AS (SELECT *, (base + page_idx) % 5 <> 0 present, (base + page_idx) % 10 = 0 swapped, page_idx % 3 = 0 file_mapped,
              (base * 7 + page_idx * 3 + iter) % 4 = 0 soft_dirty FROM px, (SELECT unnest(range(2)) iter))
"""


@query(
    "page_snapshot",
    "A64 S11 M20",
    PAGE_SQL
    + """SELECT pid, iter, count(*) pages, count(*) FILTER (present) present, count(*) FILTER (soft_dirty) dirty, count(*) FILTER (swapped) swapped,
         count(*) FILTER (file_mapped) file_mapped, round(count(*) FILTER (present) * 100 / count(*), 6) resident_pct,
         round(count(*) FILTER (soft_dirty) * 100 / count(*) FILTER (present), 6) dirty_pct FROM pg GROUP BY pid, iter""",
    "vma",
)
def page_snapshot(t: Tables) -> DataFrame:
    return rounded(G.snapshot(pages(t), ["pid", "iter"]))


@query(
    "page_letters",
    "A64 A65 P41",
    PAGE_SQL
    + """SELECT start_addr, iter, page_idx // 64 stripe, string_agg(CASE WHEN present THEN CASE WHEN soft_dirty THEN 'D' WHEN file_mapped THEN 'F' ELSE 'P' END
                                 WHEN swapped THEN 'S' ELSE '.' END, '' ORDER BY page_idx) letters FROM pg GROUP BY ALL""",
    "vma",
)
def page_letters(t: Tables) -> DataFrame:
    return G.letters(pages(t), ["start_addr", "iter"], 64)


@query(
    "page_dirty_iterations",
    "A65",
    PAGE_SQL
    + """SELECT start_addr, iter, count(*) FILTER (soft_dirty) newly_dirty, min(page_idx) FILTER (soft_dirty) * 4096 first_offset,
         max(page_idx) FILTER (soft_dirty) * 4096 last_offset,
         (max(page_idx) FILTER (soft_dirty) - min(page_idx) FILTER (soft_dirty) + 1) * 4096 span_bytes FROM pg GROUP BY ALL""",
    "vma",
)
def page_dirty_iterations(t: Tables) -> DataFrame:
    return G.dirty_iterations(pages(t), ["start_addr", "iter"])


DENSITY_SQL = PAGE_SQL + """, de AS (SELECT start_addr, iter, page_idx // 8 block, count(*) pages, count(*) FILTER (soft_dirty) dirty,
         count(*) FILTER (soft_dirty) * 100 // count(*) dirty_pct FROM pg GROUP BY ALL)
"""


@query("page_dirty_density", "A66 P40", DENSITY_SQL + "SELECT * FROM de", "vma")
def page_dirty_density(t: Tables) -> DataFrame:
    return G.density(pages(t), ["start_addr", "iter"], 8)


@query(
    "block_granularity",
    "P40",
    """SELECT pid, CASE WHEN sum(end_addr - start_addr) <= 262144 THEN 4 WHEN sum(end_addr - start_addr) <= 4194304 THEN 16
         WHEN sum(end_addr - start_addr) <= 67108864 THEN 64 WHEN sum(end_addr - start_addr) <= 536870912 THEN 256 ELSE 1024 END granularity_kb FROM vma GROUP BY pid""",
    "vma",
)
def block_granularity(t: Tables) -> DataFrame:
    sizes = t.vma.groupBy("pid").agg(F.sum(F.col("end_addr") - F.col("start_addr")).alias("b"))
    return sizes.select("pid", S.block_granularity_kb(F.col("b")).alias("granularity_kb"))


@query(
    "page_dirty_rate",
    "A67 A77",
    PAGE_SQL
    + """, r AS (SELECT pid, iter, count(*) FILTER (soft_dirty) dirty FROM pg GROUP BY ALL)
      SELECT pid, CAST(sum(dirty) AS BIGINT) dirty, round(avg(dirty * 4 * 1000 / 250), 6) avg_kb_per_s, round(max(dirty * 4 * 1000 / 250), 6) peak_kb_per_s
      FROM r GROUP BY pid""",
    "vma",
)
def page_dirty_rate(t: Tables) -> DataFrame:
    rates = G.dirty_rate(pages(t), ["pid"], 250)
    return rates.groupBy("pid").agg(
        F.sum("dirty").alias("dirty"),
        r6(F.avg("kb_per_s")).alias("avg_kb_per_s"),
        r6(F.max("kb_per_s")).alias("peak_kb_per_s"),
    )


@query(
    "file_groups",
    "A68",
    """SELECT pathname, count(*) n_vmas, CAST(sum(end_addr - start_addr) // 1024 AS BIGINT) mapped_kb, min(file_offset) offset_min,
       max(file_offset + end_addr - start_addr) offset_max FROM vma GROUP BY pathname""",
    "vma",
)
def file_groups(t: Tables) -> DataFrame:
    return G.file_groups(t.vma)


@query(
    "file_dirty_totals",
    "A68 A39",
    PAGE_SQL + "SELECT pathname, iter, count(*) pages, count(*) FILTER (soft_dirty) dirty FROM pg GROUP BY ALL",
    "vma",
)
def file_dirty_totals(t: Tables) -> DataFrame:
    rows = G.snapshot(pages(t), ["pathname", "iter"])
    return rows.select("pathname", "iter", "pages", "dirty")


@query(
    "file_range_coalescing",
    "A69",
    """v AS (SELECT pathname, file_offset, start_addr, file_offset + end_addr - start_addr fe, -(end_addr - start_addr) sz FROM vma),
      r AS (SELECT *, max(fe) OVER (PARTITION BY pathname ORDER BY file_offset, sz, start_addr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM v),
      i AS (SELECT *, sum(CASE WHEN reach IS NULL OR file_offset > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pathname ORDER BY file_offset, sz, start_addr ROWS UNBOUNDED PRECEDING) island FROM r)
      SELECT pathname, min(file_offset) range_start, max(fe) range_end, count(*) n_vmas FROM i GROUP BY pathname, island""",
    "vma",
)
def file_range_coalescing(t: Tables) -> DataFrame:
    return G.coalesced(t.vma).drop("island")


@query(
    "file_heat_deduplicated",
    "A70",
    PAGE_SQL
    + """, f AS (SELECT iter, pathname, file_offset // 4096 + page_idx fp, soft_dirty,
                   row_number() OVER (PARTITION BY iter, pathname, file_offset // 4096 + page_idx ORDER BY file_offset, vma_bytes DESC, start_addr) r FROM pg)
      SELECT iter, pathname, fp // 16 block, count(*) pages, count(*) FILTER (soft_dirty) dirty, count(*) FILTER (soft_dirty) * 100 // count(*) dirty_pct
      FROM f WHERE r = 1 GROUP BY ALL""",
    "vma",
)
def file_heat_deduplicated(t: Tables) -> DataFrame:
    return G.density(G.file_pages(pages(t, G.numbered(t.vma))), ["iter", "pathname"], 16)


@query(
    "page_running_stats",
    "A74",
    PAGE_SQL
    + f""", c AS (SELECT pid, start_addr, iter, count(*) FILTER (soft_dirty) d FROM pg GROUP BY ALL)
      SELECT pid, count(*) n, {nearest('d', 0.0)} min_dirty, {nearest('d', 0.5)} p50, {nearest('d', 0.95)} p95, {nearest('d', 0.99)} p99,
             max(d) max_dirty, CAST(sum(d) // count(*) AS BIGINT) avg_dirty FROM c GROUP BY pid""",
    "vma",
)
def page_running_stats(t: Tables) -> DataFrame:
    counts = G.dirty_iterations(pages(t), ["pid", "start_addr", "iter"])
    points = {"min_dirty": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "max_dirty": 1.0}
    q = quantiles(counts, ["pid"], "newly_dirty", points, nearest=True)
    means = counts.groupBy("pid").agg(
        S.int_div(F.sum("newly_dirty"), F.count(F.lit(1))).alias("avg_dirty")
    )
    return q.join(means, "pid")


@query(
    "hottest_window",
    "W19",
    DENSITY_SQL
    + """, n AS (SELECT start_addr, iter, greatest(4, count(*) // 8) w FROM de GROUP BY ALL),
      s AS (SELECT d.start_addr, d.iter, d.block, w, (SELECT sum(x.dirty_pct) FROM de x WHERE x.start_addr = d.start_addr AND x.iter = d.iter AND x.block BETWEEN d.block AND d.block + w - 1) ws,
                   (SELECT count(*) FROM de x WHERE x.start_addr = d.start_addr AND x.iter = d.iter AND x.block BETWEEN d.block AND d.block + w - 1) c
            FROM de d JOIN n USING (start_addr, iter)),
      r AS (SELECT *, row_number() OVER (PARTITION BY start_addr, iter ORDER BY ws DESC, block) r FROM s WHERE c = w AND ws > 0)
      SELECT start_addr, iter, block start_block, w "window", CAST(ws AS BIGINT) window_sum FROM r WHERE r = 1""",
    "vma",
)
def hottest_window(t: Tables) -> DataFrame:
    return G.hottest_window(G.density(pages(t), ["start_addr", "iter"], 8), ["start_addr", "iter"])


@query(
    "dirty_runs",
    "W20",
    PAGE_SQL
    + """, d AS (SELECT start_addr, iter, page_idx, page_idx - row_number() OVER (PARTITION BY start_addr, iter ORDER BY page_idx) run FROM pg
               WHERE (page_idx // 3 + base + iter) % 2 = 0)
      SELECT start_addr, iter, min(page_idx) run_start, count(*) n FROM d GROUP BY start_addr, iter, run""",
    "vma",
)
def dirty_runs(t: Tables) -> DataFrame:
    """Runs of pages; three pages in a row share their state here."""
    base = S.int_div(F.col("start_addr"), 1048576)
    dirty = pages(t).filter((S.int_div(F.col("page_idx"), 3) + base + F.col("iter")) % 2 == 0)
    rows = runs(dirty.select("start_addr", "iter", "page_idx"), ["start_addr", "iter"], "page_idx")
    return rows.groupBy("start_addr", "iter", "run").agg(
        F.min("page_idx").alias("run_start"), F.count(F.lit(1)).alias("n")
    ).drop("run")


@query(
    "largest_file_mapping",
    "T10",
    """f AS (SELECT pid, pathname, CAST(sum(end_addr - start_addr) AS BIGINT) total, max(end_addr - start_addr) vma_bytes FROM vma GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY total DESC, pathname) r FROM f)
      SELECT r.pid, r.pathname, total, vma_bytes, min(start_addr) start_addr FROM r JOIN vma v ON v.pid = r.pid AND v.pathname = r.pathname
        AND v.end_addr - v.start_addr = vma_bytes WHERE r = 1 GROUP BY ALL""",
    "vma",
)
def largest_file_mapping(t: Tables) -> DataFrame:
    return G.largest_file_mapping(t.vma)


@query(
    "kernel_page_flags",
    "S12",
    """SELECT o_orderkey, o_orderkey & 1 > 0 locked, o_orderkey & 4 > 0 referenced, o_orderkey & 16 > 0 dirty, o_orderkey & 32 > 0 lru, o_orderkey & 64 > 0 active,
       o_orderkey & 128 > 0 slab, o_orderkey & 256 > 0 writeback, o_orderkey & 2048 > 0 mmap, o_orderkey & 8192 > 0 swapbacked FROM orders""",
)
def kernel_page_flags(t: Tables) -> DataFrame:
    flags = [(S.bit(F.col("o_orderkey"), n) == 1).alias(name) for name, n in S.KERNEL_FLAGS.items()]
    return t.orders.select("o_orderkey", *flags)


TOUCH_SQL = "tc AS (SELECT addr // 1048576 block, sample, event_id FROM touch)"


def touches(t: Tables) -> DataFrame:
    return t.touch.select(S.int_div(F.col("addr"), 1048576).alias("block"), "sample", "event_id")


HEAT_SQL = (
    TOUCH_SQL
    + """, hs AS (SELECT block, list_reduce(list_prepend({'h': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT)}, list({'h': CAST(0 AS BIGINT), 's': sample} ORDER BY sample, event_id)),
        lambda a, x: {'h': least(greatest(a.h - 2 * (x.s - a.s), 0) + 1, 36), 's': x.s}) st FROM tc GROUP BY block),
 hd AS (SELECT block, st.h points, st.s last_sample, least(greatest(st.h - 2 * (50 - st.s), 0) // 4, 9) digit FROM hs)
"""
)


@query("block_heat", "W15 P46 M22", HEAT_SQL + "SELECT * FROM hd", "touch")
def block_heat(t: Tables) -> DataFrame:
    return H.heat(touches(t), decay=2, per_level=4, now=50)


@query(
    "block_heat_zoom",
    "A73",
    HEAT_SQL + "SELECT block // 4 block, max(digit) digit, count(*) FILTER (digit > 0) hot FROM hd GROUP BY block // 4",
    "touch",
)
def block_heat_zoom(t: Tables) -> DataFrame:
    return H.zoom(H.heat(touches(t), decay=2, per_level=4, now=50), 4)


FREQUENCY_SQL = (
    TOUCH_SQL
    + """, fs AS (SELECT block, list_reduce(list_prepend({'f': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT)}, list({'f': CAST(0 AS BIGINT), 's': sample} ORDER BY sample, event_id)),
        lambda a, x: {'f': least(500 + CASE WHEN x.s - a.s >= 20 THEN 0 ELSE list_reduce(list_prepend(a.f, range(x.s - a.s)), lambda v, i: greatest(v - (v // 20 + v % 20 // 20), 0)) END, 10000), 's': x.s}) st FROM tc GROUP BY block),
 hd AS (SELECT block, st.f points, st.s last_sample, CASE WHEN 50 - st.s >= 20 THEN 0 ELSE list_reduce(list_prepend(st.f, range(50 - st.s)), lambda v, i: greatest(v - (v // 20 + v % 20 // 20), 0)) END lf FROM fs)
"""
)


@query(
    "block_frequency",
    "W16 P46",
    FREQUENCY_SQL + "SELECT block, points, CASE WHEN lf = 0 THEN 0 ELSE least(lf * 8 // 10000 + 1, 9) END digit FROM hd",
    "touch",
)
def block_frequency(t: Tables) -> DataFrame:
    return H.frequency(touches(t), window=20, now=50)


def _texts(t: Tables) -> DataFrame:
    """Page pairs of every text before and after 'e' was overwritten."""
    before = G.binary_pages(t.documents.select("doc_id", "text"), "doc_id", "text")
    changed = t.documents.select("doc_id", F.translate("text", "e", "E").alias("text"))
    after = G.binary_pages(changed, "doc_id", "text")
    pair = ["doc_id", "page_idx"]
    return before.withColumnRenamed("content", "before").join(
        after.withColumnRenamed("content", "after"), pair
    )


@query(
    "page_byte_diff",
    "A71 M21",
    """c AS (SELECT doc_id, length(text) - length(replace(text, 'e', '')) changed_bytes FROM documents)
      SELECT * FROM c WHERE changed_bytes > 0""",
)
def page_byte_diff(t: Tables) -> DataFrame:
    diff = G.page_diff(_texts(t), ["doc_id", "page_idx"], 64)
    return diff.groupBy("doc_id").agg(F.sum("changed_bytes").alias("changed_bytes"))


@query(
    "page_word_diff",
    "A72 A71",
    """b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') h FROM documents),
      x AS (SELECT doc_id, unnest(h) c, generate_subscripts(h, 1) - 1 i FROM b),
      w AS (SELECT doc_id, i // 4096 page_idx, i // 8 wd, count(*) n FROM x WHERE c = '65' GROUP BY ALL)
      SELECT doc_id, CAST(page_idx AS INTEGER) page_idx, CAST(sum(n) AS BIGINT) changed_bytes, count(*) * 8 word_bytes, CAST(max(n) AS INTEGER) busiest_block
      FROM w GROUP BY doc_id, page_idx""",
)
def page_word_diff(t: Tables) -> DataFrame:
    """Changed bytes, changed 8-byte words and the busiest sub-block of every page."""
    diff = G.page_diff(_texts(t), ["doc_id", "page_idx"], 8)
    busiest = F.array_max(F.transform("blocks", lambda b: b.changed)).alias("busiest_block")
    return diff.select(
        "doc_id", "page_idx", "changed_bytes", (F.col("changed_words") * 8).alias("word_bytes"), busiest
    )


@query(
    "page_rolling_diff",
    "A71",
    """b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') h FROM documents),
      x AS (SELECT doc_id, unnest(h) c, generate_subscripts(h, 1) - 1 i FROM b),
      y AS (SELECT doc_id, i // 4096 page_idx, i % 4096 AS "offset", c FROM x WHERE c IN ('6B', '7A', '4B')),
      s AS (SELECT *, unnest([0, 1, 2, 3]) sample FROM y),
      v AS (SELECT *, CASE WHEN sample IN (1, 2) AND c = '6B' THEN 75 WHEN sample >= 2 AND c = '7A' THEN 90 WHEN sample = 3 AND c = '4B' THEN 107
                           WHEN c = '6B' THEN 107 WHEN c = '7A' THEN 122 ELSE 75 END b FROM s WHERE sample = 0 OR (page_idx + doc_id + sample) % 3 <> 0),
      l AS (SELECT *, lag(b) OVER (PARTITION BY doc_id, page_idx, "offset" ORDER BY sample) o FROM v)
      SELECT doc_id, CAST(page_idx AS INTEGER) page_idx, sample, CAST("offset" AS INTEGER) AS "offset", CAST(o AS INTEGER) "old", CAST(b AS INTEGER) "new" FROM l WHERE o <> b""",
)
def page_rolling_diff(t: Tables) -> DataFrame:
    """Every changed byte of texts sampled four times; of the later samples only the pages that are dirty in them come."""
    text = F.col("text")
    states = [text, F.translate(text, "k", "K"), F.translate(text, "kz", "KZ"), F.translate(text, "Kz", "kZ")]
    rows = t.documents.select("doc_id", F.posexplode(F.array(*states)).alias("sample", "text"))
    pages_of = G.binary_pages(rows.select(F.struct("doc_id", "sample").alias("k"), "text"), "k", "text")
    shown = pages_of.select("k.doc_id", "k.sample", "page_idx", "content")
    dirty = shown.filter((F.col("sample") == 0) | ((F.col("page_idx") + F.col("doc_id") + F.col("sample")) % 3 != 0))
    return G.rolling_changes(dirty, ["doc_id", "page_idx"], ["sample"])
