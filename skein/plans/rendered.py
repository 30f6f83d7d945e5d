"""Inputs that queries render from the tables, each with the same template as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.shared import spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts, of which each makes texts many times its size."""
    return spread(table(spark, d, "part"), "p_partkey")


def _by_user(rows: DataFrame, item) -> DataFrame:
    return rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", item.alias("x")))), lambda y: y["x"]).alias("items"))


def log_line():
    return F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" [INFO] "), F.col("event_type"), F.lit(" id="), F.col("event_id").cast("string"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    return _by_user(table(spark, d, "events"), log_line()).select("user_id", F.array_join("items", "\n").alias("text"))


def tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_user(table(spark, d, "events"), F.concat_ws(",", F.col("event_id").cast("string"), "event_type"))
    return rows.select("user_id", F.concat(F.lit("event_id,event_type\n"), F.array_join("items", "\n"), F.lit("\n")).alias("text"))


def lists(spark: SparkSession, d: str) -> DataFrame:
    return _by_user(table(spark, d, "events"), F.struct("event_id", "event_type"))


def prose(spark: SparkSession, d: str) -> DataFrame:
    """Line ends doubled or tripled, blanks doubled, trailing blanks."""
    gap = F.repeat(F.lit("\n"), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("  "), gap))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(text).alias("text"))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", F.concat_ws(" ", F.lit("at"), stamp, F.substring(stamp, 1, 10), F.substring(stamp, 12, 8), uuid, F.sha1(F.col("event_id").cast("string").cast("binary")), F.lit("end")).alias("text"))


def store(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), at.alias("created_at"))


def named(spark: SparkSession, d: str) -> DataFrame:
    """Names and types by id, over all that the router knows and some that it doesn't."""
    names = ["a.json", "b.py", "c.JS", "d.log", "e.csv", "f.tsv", "g.txt", ".json", "h.h", "noext", "dir.py/x", "i.tar.rs"]
    mimes = ["application/json", "text/x-log", "text/csv", "text/tab-separated-values", "text/x-python", "application/javascript", "text/plain", "x/CODE"]
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", pick(names).alias("filename"), pick(mimes).alias("mime_type"), "text")


def code(spark: SparkSession, d: str) -> DataFrame:
    """A function in Python and one in JavaScript for each part; body_py and body_js are what a token should replace."""
    body_py = F.concat(F.lit("    name = '"), F.col("p_name"), F.lit("'\n    return name * "), F.col("p_size").cast("string"))
    body_js = F.concat(F.lit(" const s = '{"), F.col("p_name"), F.lit("}'; return s.repeat("), F.col("p_size").cast("string"), F.lit("); "))
    return parts(spark, d).select(
        "p_partkey", "p_size", body_py.alias("body_py"), body_js.alias("body_js"),
        F.concat(F.lit("def f(x):\n"), body_py, F.lit("\n")).alias("py"), F.concat(F.lit("function f(x) {"), body_js, F.lit("}\n")).alias("js"),
    )


SQL = {
    "log_lines": "SELECT user_id, event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [INFO] ' || event_type || ' id=' || event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events",
    "store": "SELECT doc_id, text AS content, make_timestamp((1700000000::BIGINT + doc_id) * 1000000) AS created_at FROM documents",
    "blocks": "SELECT sha256(content) AS hash, arg_max(content, created_at) AS content, max(created_at) AS created_at FROM store WHERE content IS NOT NULL GROUP BY 1",
}
