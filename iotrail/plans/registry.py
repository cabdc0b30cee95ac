"""Registration of queries and the trace-shaped views they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.functions.scalar import int_div


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a query; ``views`` names the trace views its SQL refers to."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTRY[name] = Query(name, tuple(covers.split()), build, compose(sql, views))
        return build

    return register


def compose(sql: str | None, views: str) -> str | None:
    if sql is None:
        return None
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views.split())
    body = sql.strip()
    plain = body.upper().startswith(("SELECT", "WITH"))
    if not ctes:
        return body if plain else f"WITH {body}"
    joint = " " if plain else ", "
    return f"WITH {ctes}{joint}{body}"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Tables:
    """The driver tables of one scale and the trace-shaped views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def epoch_us(self) -> int:
        """Start of the event clock."""
        return self.events.agg(F.min(micros(F.col("ts")))).first()[0]

    @cached_property
    def blk(self) -> DataFrame:
        """Block-layer events; pairing keys repeat per user."""
        kinds = {"view": "Q", "signup": "Q", "click": "D", "purchase": "C"}
        action = F
        for kind, letter in kinds.items():
            action = action.when(F.col("event_type") == kind, letter)
        rwbs = F.when(F.col("event_id") % 3 == 0, "R").when(F.col("event_id") % 7 == 0, "WS")
        return self.events.select(
            F.lit(259).alias("major"),
            F.lit(0).alias("minor"),
            (F.col("user_id") % 4).alias("cpu"),
            F.col("event_id").alias("seq"),
            ((micros(F.col("ts")) - self.epoch_us) * 1000).alias("ts_ns"),
            (F.col("user_id") % 10 + 1000).alias("pid"),
            action.otherwise("M").alias("action"),
            rwbs.otherwise("W").alias("rwbs"),
            (F.col("user_id") * 5).alias("sector"),
            (F.col("user_id") % 24 + 1).alias("nblocks"),
        )

    @cached_property
    def blk_span_ns(self) -> int:
        return self.blk.agg(F.max("ts_ns")).first()[0]

    @cached_property
    def req(self) -> DataFrame:
        """Requests at volume."""
        return self.lineitem.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rid"),
            micros(F.col("l_shipdate")).alias("ts_us"),
            (F.col("l_partkey") * 5 + F.col("l_suppkey")).alias("sector"),
            F.col("l_quantity").cast("long").alias("nblocks"),
            (F.col("l_returnflag") == "R").alias("is_read"),
            (F.col("l_returnflag") == "N").alias("is_write"),
        )

    @cached_property
    def obj(self) -> DataFrame:
        """Object operations; the tag is the order number."""
        start = micros(F.col("o_orderdate"))
        lasting = (F.col("o_orderkey") % 97 + 1) * 86_400_000_000
        status = F.col("o_orderstatus")
        return self.orders.select(
            (F.col("o_orderkey") + 1).alias("trace_id"),
            F.col("o_custkey").alias("obj_key"),
            F.when(status == "O", "store").when(status == "F", "load").otherwise("delete").alias("op"),
            F.floor("o_totalprice").cast("long").alias("bytes"),
            (F.col("o_orderkey") * 1048576).alias("slot_offset"),
            (start * 1000).alias("ts_start_ns"),
            ((start + lasting) * 1000).alias("ts_ns"),
            F.when(F.col("o_orderkey") % 50 == 0, "EIO").alias("error"),
        )

    @cached_property
    def cmd(self) -> DataFrame:
        """Device commands carrying the tag of their object."""
        tag = (F.col("l_orderkey") + 1).cast("decimal(20,0)") * F.lit(4294967296)
        line = F.col("l_linenumber").cast("long")
        return self.lineitem.select(
            (tag + line).cast("decimal(20,0)").alias("user_data"),
            (F.col("l_orderkey") + 1).alias("tid"),
            F.when(F.col("l_returnflag") == "R", "read").otherwise("write").alias("op_name"),
            (F.col("l_orderkey") * 256 + line * 32).alias("slba"),
            (F.col("l_quantity").cast("long") * 4096).alias("bytes"),
            ((micros(F.col("l_shipdate")) + line) * 1000).alias("ts_ns"),
        )

    @cached_property
    def sysev(self) -> DataFrame:
        kinds = {"view": "read", "click": "pread64", "purchase": "pwrite64", "signup": "openat"}
        name = F
        for kind, call in kinds.items():
            name = name.when(F.col("event_type") == kind, call)
        return self.events.select(
            F.col("event_id"),
            (F.col("user_id") % 20).alias("pid"),
            F.col("user_id").alias("tid"),
            name.otherwise("lseek").alias("syscall_name"),
            (F.col("user_id") % 16).alias("fd"),
            F.floor(F.col("value") * 100).cast("long").alias("size"),
            (F.col("event_id") * 512).alias("file_offset"),
            ((micros(F.col("ts")) - self.epoch_us) * 1000).alias("ts_ns"),
        )

    @cached_property
    def vma(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.part.select(
            (key % 20).alias("pid"),
            (key * 1048576).alias("start_addr"),
            (key * 1048576 + F.col("p_size") * 16384).alias("end_addr"),
            (key % 64 * 65536).alias("file_offset"),
            F.col("p_brand").alias("pathname"),
        )

    @cached_property
    def touch(self) -> DataFrame:
        return self.events.select(
            (F.col("user_id") % 20).alias("pid"),
            (F.col("event_id") * 104729 % 209715200).alias("addr"),
            (F.col("event_id") % 50).alias("sample"),
            F.col("event_id"),
        )

    @cached_property
    def arms(self) -> DataFrame:
        """Block events split into a capture (0) and a replay (1), each from its own zero."""
        arm = (F.col("seq") % 2).cast("int")
        split = self.blk.withColumn("arm", arm)
        zero = {r["arm"]: r["z"] for r in split.groupBy("arm").agg(F.min("ts_ns").alias("z")).collect()}
        base = F.when(F.col("arm") == 0, zero.get(0, 0)).otherwise(zero.get(1, 0))
        return split.withColumn("ts_ns", F.col("ts_ns") - base)


_US0 = "(SELECT min(epoch_us(ts)) FROM events)"

VIEW_SQL = {
    "blk": f"""
        SELECT 259 major, 0 minor, user_id % 4 cpu, event_id seq,
               (epoch_us(ts) - {_US0}) * 1000 ts_ns, user_id % 10 + 1000 pid,
               CASE event_type WHEN 'view' THEN 'Q' WHEN 'signup' THEN 'Q' WHEN 'click' THEN 'D'
                               WHEN 'purchase' THEN 'C' ELSE 'M' END action,
               CASE WHEN event_id % 3 = 0 THEN 'R' WHEN event_id % 7 = 0 THEN 'WS' ELSE 'W' END rwbs,
               user_id * 5 sector, user_id % 24 + 1 nblocks
        FROM events""",
    "req": """
        SELECT l_orderkey * 8 + l_linenumber rid, epoch_us(l_shipdate) ts_us,
               l_partkey * 5 + l_suppkey sector, CAST(l_quantity AS BIGINT) nblocks,
               l_returnflag = 'R' is_read, l_returnflag = 'N' is_write
        FROM lineitem""",
    "obj": """
        SELECT o_orderkey + 1 trace_id, o_custkey obj_key,
               CASE o_orderstatus WHEN 'O' THEN 'store' WHEN 'F' THEN 'load' ELSE 'delete' END op,
               CAST(floor(o_totalprice) AS BIGINT) bytes, o_orderkey * 1048576 slot_offset,
               epoch_us(o_orderdate) * 1000 ts_start_ns,
               (epoch_us(o_orderdate) + (o_orderkey % 97 + 1) * 86400000000) * 1000 ts_ns,
               CASE WHEN o_orderkey % 50 = 0 THEN 'EIO' END error
        FROM orders""",
    "cmd": """
        SELECT CAST(l_orderkey + 1 AS HUGEINT) * 4294967296 + l_linenumber user_data,
               l_orderkey + 1 tid, CASE WHEN l_returnflag = 'R' THEN 'read' ELSE 'write' END op_name,
               l_orderkey * 256 + l_linenumber * 32 slba, CAST(l_quantity AS BIGINT) * 4096 bytes,
               (epoch_us(l_shipdate) + l_linenumber) * 1000 ts_ns
        FROM lineitem""",
    "sysev": f"""
        SELECT event_id, user_id % 20 pid, user_id tid,
               CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'pread64'
                               WHEN 'purchase' THEN 'pwrite64' WHEN 'signup' THEN 'openat'
                               ELSE 'lseek' END syscall_name,
               user_id % 16 fd, CAST(floor(value * 100) AS BIGINT) size,
               event_id * 512 file_offset, (epoch_us(ts) - {_US0}) * 1000 ts_ns
        FROM events""",
    "vma": """
        SELECT p_partkey % 20 pid, p_partkey * 1048576 start_addr,
               p_partkey * 1048576 + p_size * 16384 end_addr, p_partkey % 64 * 65536 file_offset,
               p_brand pathname
        FROM part""",
    "touch": """
        SELECT user_id % 20 pid, event_id * 104729 % 209715200 addr, event_id % 50 sample, event_id
        FROM events""",
}
VIEW_SQL["arms"] = f"""
        SELECT * REPLACE (ts_ns - min(ts_ns) OVER (PARTITION BY arm) AS ts_ns)
        FROM (SELECT *, CAST(seq % 2 AS INTEGER) arm FROM ({VIEW_SQL["blk"]}))"""

__all__ = ["REGISTRY", "Query", "Tables", "int_div", "micros", "query"]
