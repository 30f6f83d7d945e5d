"""The queries of the engine and, beside each, its DuckDB formulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import api
from skein.functions.lines import lines
from skein.functions.predicates import log_anomaly, value_anomaly
from skein.operators import blocks, index, longfiles, router
from skein.operators.align import align, restore, side_table
from skein.operators.code import compress_code
from skein.operators.jsonlists import crush_json, truncate_list
from skein.operators.logs import crush_log, islands
from skein.operators.retrievable import keep_list, keep_log, keep_table
from skein.operators.tabular import crush_table
from skein.operators.text import collapse_blank_lines, compress_text
from skein.operators.typed import crush_column
from skein.plans import rendered as R
from skein.sources import corpus
from skein.sources.shared import fresh, written
from skein.streaming.store import lives, snapshot

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MARK = "regexp_matches(line, '(?i)error|fail|exception|warn|critical|fatal|traceback|caused\\s+by')"


def sql_crush(k: int) -> str:
    return f"""
WITH l AS ({R.SQL['log_lines']}), a AS (
  SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM l WHERE pos > {k} AND pos <= n - {k} AND {MARK}
), g AS (
  SELECT user_id, n, min(pos) AS first, max(pos) AS last, string_agg('[Line ' || pos || '] ' || line, chr(10) ORDER BY pos) AS body FROM a GROUP BY user_id, n, g
), h AS (
  SELECT *, first - coalesce(lag(last) OVER (PARTITION BY user_id ORDER BY first), {k}) - 1 AS gap FROM g
), parts AS (
  SELECT user_id, pos * 2 AS o, line AS s FROM l WHERE pos <= {k} OR pos > n - {k}
  UNION ALL SELECT user_id, first * 2 - 1, '... [omitted ' || gap || ' lines] ...' FROM h WHERE gap > 0
  UNION ALL SELECT user_id, first * 2, '--- Preserved anomaly/error lines ' || first || '-' || last || ' ---' || chr(10) || body FROM h
  UNION ALL SELECT user_id, (n - {k}) * 2 + 1, '... [omitted ' || (n - {k} - last) || ' lines] ...' FROM (SELECT u.user_id, u.n, coalesce(max(h.last), {k}) AS last FROM (SELECT DISTINCT user_id, n FROM l) u LEFT JOIN h USING (user_id) GROUP BY ALL) WHERE n - {k} > last
)
SELECT user_id, CASE WHEN max(n) <= {2 * k} THEN (SELECT string_agg(line, chr(10) ORDER BY pos) FROM l x WHERE x.user_id = u.user_id) ELSE (SELECT string_agg(s, chr(10) ORDER BY o) FROM parts p WHERE p.user_id = u.user_id) END AS compressed
FROM l u GROUP BY user_id"""


@query(sql_crush(20))
def log_crush(spark: SparkSession, d: str) -> DataFrame:
    return R.logs(spark, d).select("user_id", crush_log(F.col("text"), 20).alias("compressed"))


@query(sql_crush(3))
def log_crush_k3(spark: SparkSession, d: str) -> DataFrame:
    return R.logs(spark, d).select("user_id", crush_log(F.col("text"), 3).alias("compressed"))


@query(sql_crush(0))
def log_crush_k0(spark: SparkSession, d: str) -> DataFrame:
    return R.logs(spark, d).select("user_id", crush_log(F.col("text"), 0).alias("compressed"))


@query(f"WITH l AS ({R.SQL['log_lines']}) SELECT event_id, {MARK} AS anomaly FROM l")
def log_anomaly_flags(spark, d):
    return R.table(spark, d, "events").select("event_id", log_anomaly(R.log_line()).alias("anomaly"))


@query(f"WITH l AS ({R.SQL['log_lines']}) SELECT user_id, n::BIGINT AS n_lines, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos <= 5) AS head, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos > n - 5) AS tail FROM l GROUP BY user_id, n")
def log_head_tail(spark, d):
    from skein.functions.lines import head, tail

    x = R.logs(spark, d).withColumn("l", lines(F.col("text")))
    return x.select("user_id", F.size("l").cast("bigint").alias("n_lines"), F.array_join(head(F.col("l"), 5), "\n").alias("head"), F.array_join(tail(F.col("l"), 5), "\n").alias("tail"))


@query(f"WITH l AS ({R.SQL['log_lines']}), a AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM l WHERE {MARK}) SELECT user_id, min(pos) AS first, max(pos) AS last, count(*) AS n FROM a GROUP BY user_id, g")
def log_islands(spark, d):
    rows = R.logs(spark, d).select("user_id", F.posexplode(lines(F.col("text"))).alias("p", "line")).select("user_id", (F.col("p") + 1).cast("bigint").alias("pos"), log_anomaly(F.col("line")).alias("odd"))
    return islands(rows, "user_id", "pos", "odd")


@query("""WITH t AS (SELECT event_id, md5(event_id::VARCHAR) AS h, sha1(event_id::VARCHAR) AS c, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events), u AS (
  SELECT event_id, concat_ws(' ', 'at', s, s[1:10], s[12:19], concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]), c, 'end') AS x FROM t)
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\b[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\\b', '[UUID]', 'g'),
  '\\b\\d{4}-\\d{2}-\\d{2}(T| +)\\d{2}:\\d{2}:\\d{2}\\b', '[DATETIME]', 'g'), '\\b\\d{4}-\\d{2}-\\d{2}\\b', '[DATE]', 'g'), '\\b\\d{2}:\\d{2}:\\d{2}\\b', '[TIME]', 'g'), '\\b[0-9a-fA-F]{40}\\b', '[COMMIT_HASH]', 'g') AS aligned FROM u""")
def align_events(spark, d):
    return R.aligned(spark, d).select("event_id", align(F.col("text")).alias("aligned"))


@query("SELECT doc_id, regexp_replace('at ' || sha1(doc_id::VARCHAR) || ' of ' || sha256(doc_id::VARCHAR) || ' ' || sha1(doc_id::VARCHAR)[1:39] || ' ' || sha1(doc_id::VARCHAR) || 'a 2024-01-02T03:04:05.678Z 2024-01-02 03:04:05+02:00 12:34:56.7', '^at [0-9a-f]{40} of ([0-9a-f]{64} [0-9a-f]{39} [0-9a-f]{40}a) .*$', 'at [COMMIT_HASH] of \\1 [DATETIME] [DATETIME] [TIME]') AS aligned FROM documents")
def align_commit_docs(spark, d):
    """Hashes of 39, 40, 41 and 64 digits, fractions, zones and bare times."""
    key = F.col("doc_id").cast("string").cast("binary")
    text = F.concat(F.lit("at "), F.sha1(key), F.lit(" of "), F.sha2(key, 256), F.lit(" "), F.substring(F.sha1(key), 1, 39), F.lit(" "), F.sha1(key), F.lit("a 2024-01-02T03:04:05.678Z 2024-01-02 03:04:05+02:00 12:34:56.7"))
    return R.table(spark, d, "documents").select("doc_id", align(text).alias("aligned"))


@query("""WITH t AS (SELECT event_id, md5(event_id::VARCHAR) AS h, sha1(event_id::VARCHAR) AS c, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events)
SELECT event_id, concat_ws(' ', 'at', s, s[1:10], s[12:19], concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]), c, 'end') AS text, 4::BIGINT AS n_values FROM t""")
def align_round_trip(spark, d):
    """Aligned texts with their values put back from a side table."""
    rows = R.aligned(spark, d)
    side = side_table(rows, "event_id")
    back = restore(rows.withColumn("text", align(F.col("text"))), side, "event_id")
    return back.join(side.groupBy(F.col("key").alias("event_id")).agg(F.count("*").alias("n_values")), "event_id")


PROSE = """p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(x, ' ', '  ') ELSE x END AS text FROM (SELECT doc_id, replace(text, chr(10), '  ' || repeat(chr(10), (doc_id % 3 + 1)::INT)) AS x FROM documents)), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p), r AS (SELECT doc_id, i, rtrim(raw) AS t FROM l), k AS (
  SELECT doc_id, i, t, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS before, max(i) OVER (PARTITION BY doc_id) AS n FROM r), s AS (SELECT * FROM k WHERE NOT (i = n AND t = '') AND (t <> '' OR before IS NULL OR before <> ''))"""


@query(f"WITH {PROSE} SELECT doc_id, count(s.i)::BIGINT AS n_kept FROM p LEFT JOIN s USING (doc_id) GROUP BY doc_id")
def text_blank_collapse(spark, d):
    from skein.functions.lines import right_trim

    return R.prose(spark, d).select("doc_id", F.size(collapse_blank_lines(F.transform(lines(F.col("text")), right_trim))).cast("bigint").alias("n_kept"))


@query(f"WITH {PROSE} SELECT p.doc_id, CASE WHEN trim(p.text, ' ' || chr(10)) = '' THEN '' ELSE string_agg(regexp_extract(t, '^ *') || regexp_replace(ltrim(t, ' '), '[ \\t]+', ' ', 'g'), chr(10) ORDER BY i) END AS compressed FROM p LEFT JOIN s USING (doc_id) GROUP BY p.doc_id, p.text")
def text_compress(spark, d):
    return R.prose(spark, d).select("doc_id", compress_text(F.col("text")).alias("compressed"))


@query("""WITH r AS (SELECT user_id, event_id || ',' || event_type AS row, regexp_matches(event_type, '(?i)error|fail|exception|warn|critical|fatal') AS odd, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), a AS (
  SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY user_id ORDER BY pos), 5) - 1 AS gap FROM r WHERE odd AND pos > 5 AND pos <= n - 5), parts AS (
  SELECT user_id, pos * 2 AS o, row AS s FROM r WHERE pos <= 5 OR pos > n - 5
  UNION ALL SELECT user_id, pos * 2 - 1, '... [omitted ' || gap || ' rows] ...,' FROM a WHERE gap > 0
  UNION ALL SELECT user_id, pos * 2, '[Row ' || (pos + 1) || '],' || row FROM a
  UNION ALL SELECT user_id, (n - 5) * 2 + 1, '... [omitted ' || (n - 5 - last) || ' rows] ...,' FROM (SELECT u.user_id, u.n, coalesce(max(a.pos), 5) AS last FROM (SELECT DISTINCT user_id, n FROM r) u LEFT JOIN a USING (user_id) GROUP BY ALL) WHERE n - 5 > last)
SELECT user_id, 'event_id,event_type' || chr(10) || CASE WHEN max(n) <= 10 THEN (SELECT string_agg(row, chr(10) ORDER BY pos) FROM r x WHERE x.user_id = u.user_id) ELSE (SELECT string_agg(s, chr(10) ORDER BY o) FROM parts p WHERE p.user_id = u.user_id) END || chr(10) AS compressed FROM r u GROUP BY user_id""")
def csv_crush(spark, d):
    return crush_table(R.tables(spark, d), "text", 5).select("user_id", "compressed")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, n > 10 AS cut, CASE WHEN n > 10 THEN string_agg(event_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos <= 5) END AS head, CASE WHEN n > 10 THEN string_agg(event_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos > n - 5) END AS tail,
  CASE WHEN n > 10 THEN coalesce(string_agg((pos - 1)::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos > 5 AND pos <= n - 5 AND event_type LIKE '%error%'), '') END AS anomalies, CASE WHEN n > 10 THEN n - 10 END::BIGINT AS omitted FROM r GROUP BY user_id, n""")
def json_list_truncate(spark, d):
    """Lists of ten items or fewer stay whole: they are not cut, and have null parts."""
    x = R.lists(spark, d).select("user_id", truncate_list(F.col("items"), 5).alias("t"))
    ids = lambda c: F.array_join(F.transform(c, lambda y: y["event_id"].cast("string")), ",")
    anomalies = F.array_join(F.transform("t.anomalies", lambda y: y["original_index"].cast("string")), ",")
    return x.select("user_id", F.col("t").isNotNull().alias("cut"), ids(F.col("t.head")).alias("head"), ids(F.col("t.tail")).alias("tail"), anomalies.alias("anomalies"), F.col("t.omitted_count").cast("bigint").alias("omitted"))


@query("SELECT event_id, regexp_matches(event_type || ' ' || props, '(?i)error|fail|exception|warn|critical|fatal') AS anomaly FROM events")
def json_anomaly(spark, d):
    return R.table(spark, d, "events").select("event_id", value_anomaly(F.to_json(F.struct(F.col("event_type").alias("t"), "props"))).alias("anomaly"))


STORE = f"store AS ({R.SQL['store']}), blocks AS ({R.SQL['blocks']})"
def now():
    return F.timestamp_seconds(F.lit(1_700_000_500))


NOW_SQL = "make_timestamp(1700000500::BIGINT * 1000000)"


def _blocks(spark, d):
    return blocks.make_blocks(R.store(spark, d))


@query(f"WITH {STORE} SELECT hash, length(content)::BIGINT AS size, epoch(created_at)::BIGINT AS created FROM blocks")
def block_hash_dedupe(spark, d):
    return _blocks(spark, d).select("hash", F.length("content").cast("bigint").alias("size"), F.unix_timestamp("created_at").alias("created"))


@query(f"WITH {STORE} SELECT sum(greatest(0, length(content) - 80))::BIGINT AS saved_bytes FROM blocks")
def block_savings(spark, d):
    return blocks.saved(_blocks(spark, d))


@query(f"WITH {STORE}, again AS (SELECT content, created_at + INTERVAL 1000 SECOND AS created_at FROM store WHERE doc_id % 3 = 0 UNION ALL SELECT content, created_at FROM store) SELECT sha256(content) AS hash, epoch(max(created_at))::BIGINT AS created FROM again WHERE content IS NOT NULL GROUP BY 1")
def block_upsert(spark, d):
    more = R.store(spark, d).filter("doc_id % 3 = 0").withColumn("created_at", F.expr("created_at + interval 1000 second"))
    return blocks.upsert(_blocks(spark, d), blocks.make_blocks(more)).select("hash", F.unix_timestamp("created_at").alias("created"))


@query(f"WITH {STORE} SELECT hash FROM blocks WHERE created_at >= {NOW_SQL} - INTERVAL 300 SECOND")
def ttl_live(spark, d):
    return blocks.live(_blocks(spark, d), now()).select("hash")


@query(f"WITH {STORE} SELECT hash, epoch(created_at + doc_id * INTERVAL 1 HOUR)::BIGINT AS created FROM (SELECT sha256(content) AS hash, arg_max(doc_id, created_at) AS doc_id, max(created_at) AS created_at FROM store WHERE content IS NOT NULL GROUP BY 1) WHERE created_at + doc_id * INTERVAL 1 HOUR >= {NOW_SQL} + INTERVAL 200 HOUR - INTERVAL 100 HOUR")
def store_days(spark, d):
    """The live blocks of a snapshot on disk that holds a block an hour; older days aren't scanned."""
    rows = R.store(spark, d).withColumn("created_at", F.expr("created_at + doc_id * interval 1 hour"))
    path = fresh(spark, "store")
    corpus.write_blocks(blocks.make_blocks(rows), path)
    return corpus.read_blocks(spark, path, now() + F.expr("interval 200 hours"), 360_000).select("hash", F.unix_timestamp("created_at").alias("created"))


@query(f"WITH {STORE}, q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256('miss' || doc_id) END AS hash FROM documents) SELECT doc_id, blocks.hash IS NOT NULL AS hit, length(content)::BIGINT AS size FROM q LEFT JOIN blocks USING (hash)")
def retrieve_join(spark, d):
    return blocks.retrieve(_asked(spark, d), _blocks(spark, d)).select("doc_id", "hit", F.length("content").cast("bigint").alias("size"))


#: Seconds that a block of the stream's queries lives.
DAY = 86_400
SQL_LIVES = f"""WITH e AS (SELECT sha256(event_type || ' of ' || user_id) AS hash, event_type || ' of ' || user_id AS content, date_trunc('second', ts) AS ts FROM events), o AS (
  SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM e WINDOW w AS (PARTITION BY hash ORDER BY ts)
), m AS (SELECT max(ts) AS now FROM e)"""


def _streamed(spark, d) -> DataFrame:
    """All events as a stream of blocks, run to its end; what it told is a table in the shared folder."""
    table, path = R.table(spark, d, "events"), fresh(spark, "lives")
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/events.parquet*")
    content = F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string"))
    rows = stream.select(content.alias("content"), F.date_trunc("second", F.col("ts")).cast("timestamp").alias("created_at"))
    run = lives(rows, ttl=DAY).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("hash string, event string, at timestamp, content string").parquet(path)


@query(f"""{SQL_LIVES} SELECT hash, 'stored' AS event, epoch(ts)::BIGINT AS at_second, content FROM o WHERE before IS NULL OR ts - before > INTERVAL {DAY} SECOND
UNION ALL SELECT hash, 'renewed', epoch(ts)::BIGINT, NULL FROM o WHERE ts - before <= INTERVAL {DAY} SECOND
UNION ALL SELECT hash, 'expired', epoch(ts)::BIGINT + {DAY}, NULL FROM o, m WHERE coalesce(after, now) - ts > INTERVAL {DAY} SECOND""")
def stream_lives(spark, d):
    """Blocks of a stream are stored, renewed by storing again, and expire."""
    return _streamed(spark, d).select("hash", "event", F.unix_timestamp("at").alias("at_second"), "content")


@query(f"""{SQL_LIVES} SELECT hash, any_value(content) AS content, epoch(max(ts))::BIGINT AS created FROM e, m GROUP BY hash, now HAVING now - max(ts) <= INTERVAL {DAY} SECOND""")
def stream_snapshot(spark, d):
    """The store that the stream leaves."""
    return snapshot(_streamed(spark, d)).select("hash", "content", F.unix_timestamp("created_at").alias("created"))


def _asked(spark, d):
    miss = F.concat(F.lit("miss"), F.col("doc_id").cast("string"))
    return R.table(spark, d, "documents").select("doc_id", blocks.content_hash(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(miss)).alias("hash"))


@query(f"WITH {STORE} SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM store s WHERE s.doc_id % 2 = 0 AND s.content = documents.text)")
def store_new_rows(spark, d):
    half = blocks.make_blocks(R.store(spark, d).filter("doc_id % 2 = 0"))
    return blocks.new_blocks(half, _blocks(spark, d)).select("hash")


@query(f"WITH {STORE}, q AS (SELECT CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256('miss' || doc_id) END AS hash FROM documents), r AS (SELECT blocks.hash IS NOT NULL AS hit FROM q LEFT JOIN blocks USING (hash)) SELECT (SELECT count(*) FROM blocks) AS count, (SELECT sum(length(content))::BIGINT FROM blocks) AS total_bytes, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE hit) / count(*)::DOUBLE AS hit_ratio FROM r")
def store_stats(spark, d):
    b = _blocks(spark, d)
    return blocks.stats(b, blocks.retrieve(_asked(spark, d), b))


@query(f"WITH {STORE}, old AS (SELECT DISTINCT content FROM store WHERE doc_id % 2 = 0), l AS (SELECT * FROM blocks WHERE created_at >= {NOW_SQL} - INTERVAL 300 SECOND) SELECT count(*) AS count, coalesce(sum(length(content)), 0)::BIGINT AS total_bytes, 0::BIGINT AS hits, 0::BIGINT AS misses, 0.0::DOUBLE AS hit_ratio, (SELECT coalesce(sum(greatest(0, length(content) - 80)), 0)::BIGINT FROM blocks WHERE content NOT IN (SELECT content FROM old WHERE content IS NOT NULL)) AS saved_bytes FROM l")
def store_stats_saved(spark, d):
    """Figures of the live blocks with the savings of what was new; nothing has been retrieved, so the ratio is 0."""
    every, half = _blocks(spark, d), blocks.make_blocks(R.store(spark, d).filter("doc_id % 2 = 0"))
    log = spark.createDataFrame([], "hit boolean")
    return api.stats(every, log, now(), stored=blocks.new_blocks(half, every))


@query(f"WITH {STORE}, l AS (SELECT DISTINCT content FROM store WHERE doc_id % 2 = 0 AND content IS NOT NULL) SELECT count(*) AS count, coalesce(sum(length(content)), 0)::BIGINT AS total_bytes, 0::BIGINT AS hits, 0::BIGINT AS misses, 0.0::DOUBLE AS hit_ratio, coalesce(sum(greatest(0, length(content) - 80)), 0)::BIGINT AS saved_bytes FROM l")
def store_clear(spark, d):
    """A store that was emptied and then filled with half of the documents: all of them are new again, and counters begin anew."""
    left, half = api.clear(_blocks(spark, d)), blocks.make_blocks(R.store(spark, d).filter("doc_id % 2 = 0"))
    log = spark.createDataFrame([], "hit boolean")
    return api.stats(blocks.upsert(left, half), log, now(), ttl=10**9, stored=blocks.new_blocks(left, half))


LONG = "l AS (SELECT replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), '-01 ', '-01 WARN ') || ' ' || event_type || CASE WHEN event_id % 7 = 0 THEN chr(11) || 'failed ' ELSE ' ' END || event_id AS two, ts, event_id FROM events), s AS (SELECT unnest(string_split(two, chr(11))) AS line, generate_subscripts(string_split(two, chr(11)), 1) AS part, ts, event_id FROM l), n AS (SELECT line, row_number() OVER (ORDER BY ts, event_id, part) AS pos, count(*) OVER () AS n FROM s)"


def _one_log(spark, d) -> str:
    """All events as one log, in as many files as the sorted rows have partitions."""
    stamp = F.replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-01 "), F.lit("-01 WARN "))
    line = F.concat(stamp, F.lit(" "), "event_type", F.when(F.col("event_id") % 7 == 0, F.lit("\x0bfailed ")).otherwise(" "), F.col("event_id").cast("string"))
    path = fresh(spark, "log")
    R.table(spark, d, "events").orderBy("ts", "event_id").select(line).write.text(path)
    return path


@query(f"""WITH {LONG}, a AS (
  SELECT *, pos - row_number() OVER (ORDER BY pos) AS g FROM n WHERE pos > 20 AND pos <= n - 20 AND {MARK}
), g AS (SELECT min(pos) AS first, max(pos) AS last FROM a GROUP BY g), h AS (SELECT *, coalesce(lag(last) OVER (ORDER BY first), 20) AS before FROM g), z AS (SELECT max(n) - 20 AS stop, coalesce((SELECT max(last) FROM g), 20) AS last FROM n)
SELECT pos AS line_no, 2 AS kind, line AS text FROM n WHERE pos <= 20 OR pos > n - 20
UNION ALL SELECT pos, 2, '[Line ' || pos || '] ' || line FROM a
UNION ALL SELECT first, 1, '--- Preserved anomaly/error lines ' || first || '-' || last || ' ---' FROM h
UNION ALL SELECT before + 1, 0, '... [omitted ' || (first - before - 1) || ' lines] ...' FROM h WHERE first - before > 1
UNION ALL SELECT last + 1, 0, '... [omitted ' || (stop - last) || ' lines] ...' FROM z WHERE stop > last""")
def log_crush_long(spark, d):
    """One log of all events, crushed with out a task that holds more than a block of it."""
    return longfiles.crush_logs(spark, _one_log(spark, d), 20, whole_folder=True).select("line_no", "kind", "text")


LONG_ROWS = """r AS (SELECT event_id, ts, event_id || ',' || CASE event_id % 5 WHEN 0 THEN '"' || event_type || chr(10) || 'said ""' || user_id || '"", twice"' WHEN 1 THEN '"' || event_type || ', ' || user_id || '"' ELSE event_type || '"' || user_id END AS row FROM events),
n AS (SELECT row, 1 + row_number() OVER (ORDER BY ts, event_id) AS pos, 1 + count(*) OVER () AS n FROM r)"""


@query(f"""WITH {LONG_ROWS}, w AS (  -- a quote within a cell is doubled when it is written
  SELECT pos, n, CASE WHEN contains(row, ',"') THEN row ELSE regexp_replace(row, ',(.*)"(.*)', ',"\\1""\\2"') END AS row FROM n
), a AS (
  SELECT *, pos - coalesce(lag(pos) OVER (ORDER BY pos), 6) - 1 AS gap FROM w WHERE pos > 6 AND pos <= n - 5 AND regexp_matches(row, '(?i)error|fail|exception|warn|critical|fatal')
), z AS (SELECT max(n) - 5 AS stop, coalesce((SELECT max(pos) FROM a), 6) AS last FROM w)
SELECT 1 AS line_no, 2 AS kind, 'event_id,note' AS text
UNION ALL SELECT pos, 2, row FROM w WHERE pos <= 6 OR pos > n - 5
UNION ALL SELECT pos, 2, '[Row ' || pos || '],' || row FROM a
UNION ALL SELECT pos - gap, 0, '... [omitted ' || gap || ' rows] ...,' FROM a WHERE gap > 0
UNION ALL SELECT last + 1, 0, '... [omitted ' || (stop - last) || ' rows] ...,' FROM z WHERE stop > last""")
def csv_crush_long(spark, d):
    """One table of all events with quotes, commas and line ends in its cells, cut at true record ends and crushed."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    note = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), kind, F.lit('\nsaid ""'), user, F.lit('"", twice"'))).when(F.col("event_id") % 5 == 1, F.concat(F.lit('"'), kind, F.lit(", "), user, F.lit('"')))
        .otherwise(F.concat(kind, F.lit('"'), user))
    )
    rows = R.table(spark, d, "events").select(F.lit(1).alias("_o"), "ts", "event_id", F.concat(F.col("event_id").cast("string"), F.lit(","), note).alias("row"))
    head = rows.limit(1).select(F.lit(0).alias("_o"), "ts", "event_id", F.lit("event_id,note").alias("row"))
    path = fresh(spark, "table")
    head.unionByName(rows).orderBy("_o", "ts", "event_id").select("row").write.text(path)
    return longfiles.crush_tables(spark, path, 5, whole_folder=True).select("line_no", "kind", "text")


@query("SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) GROUP BY term")
def token_counts(spark, d):
    t = R.table(spark, d, "documents").select("doc_id", F.explode(blocks.tokens(F.col("text"))).alias("term"))
    each = t.groupBy("term", "doc_id").agg(F.count("*").alias("c"))
    return each.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


SQL_TERMS = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM w), m AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark)"""
SQL_BEST = SQL_TERMS + """,
s AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), m GROUP BY 1, 2)"""


def _searched(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents as a store whose order is that of doc_id, and the benchmark's whole texts as queries."""
    q = R.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.table(spark, d, "documents").select(F.col("doc_id").alias("hash"), F.col("doc_id").alias("seq"), F.col("text").alias("content")), q


@query(f"""{SQL_BEST},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def bm25_topk(spark, d):
    """The three best documents for each whole text of the benchmark."""
    out = blocks.bm25(*_searched(spark, d), 3)
    return out.select(F.col("query_id").alias("item_id"), F.col("hash").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""{SQL_BEST},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def bm25_indexed(spark, d):
    """The same by a persisted index: built of two thirds of the documents, updated with the others, searched."""
    store, asked = _searched(spark, d)
    first = index.build(store.filter("hash % 3 > 0"), fresh(spark, "index"))
    whole = index.update(first, store, fresh(spark, "index"))
    out = index.search(whole, asked, 3, store.select("hash", "seq"))
    return out.select(F.col("query_id").alias("item_id"), F.col("hash").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"{SQL_TERMS} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM df, m WHERE term IN (SELECT term FROM q)")
def bm25_df_idf(spark, d):
    return blocks.bm25_terms(*_searched(spark, d)).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"""{SQL_BEST}, t AS (SELECT sha256(text) AS hash, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1), one AS (
  SELECT item_id, sha256(text) AS hash, score FROM s JOIN documents USING (doc_id) JOIN t ON t.last = s.doc_id)
SELECT benchmark.item_id, count(one.hash) > 0 AS hit FROM benchmark LEFT JOIN one ON one.item_id = benchmark.item_id AND score > 0 GROUP BY 1""")
def retrieve_best(spark, d):
    """The facade's search over the engine's own snapshot: whether each benchmark text finds a block."""
    asked = R.table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    return api.retrieve(asked, _blocks(spark, d), now(), ttl=10**9).select("item_id", "hit")


@query("SELECT doc_id, 'see' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '  <<ccr:' || sha256('miss' || doc_id) || ',text,1>>' ELSE '  ' || text END || chr(10) || 'end' AS text FROM documents")
def decompress_docs(spark, d):
    h = blocks.content_hash(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("miss"), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    size = F.when(F.col("doc_id") % 4 == 0, F.lit(1)).otherwise(F.length("text")).cast("string")
    docs = R.table(spark, d, "documents").select("doc_id", F.concat(F.lit("see\n  <<ccr:"), h, F.lit(",text,"), size, F.lit(">>\nend")).alias("text"))
    return api.decompress(docs, _blocks(spark, d), now(), ttl=10**9)


@query(f"""{SQL_BEST}, t AS (SELECT sha256(text) AS hash, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1), one AS (SELECT DISTINCT item_id FROM s JOIN t ON t.last = s.doc_id WHERE score > 0)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN item_id IN (SELECT item_id FROM one) END AS hit, CAST(NULL AS BOOLEAN) AS hit_in_none FROM benchmark""")
def retrieve_uncounted(spark, d):
    """Searches without a word, and all searches in an empty store, count as neither hit nor miss."""
    query = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, "!? --").otherwise("")
    asked, store = R.table(spark, d, "benchmark").select("item_id", query.alias("query")), _blocks(spark, d)
    full = api.retrieve(asked, store, now(), ttl=10**9).select("item_id", "hit")
    none = api.retrieve(asked, api.clear(store), now(), ttl=10**9).select("item_id", F.col("hit").alias("hit_in_none"))
    return full.join(none, "item_id")


NESTED = """WITH RECURSIVE b AS (
  SELECT p_partkey AS id, p_partkey // 3 AS up, p_partkey % 50 = 7 AS round_, p_name AS text FROM part
), e AS (
  SELECT id, text || chr(10) || '  <<ccr:' || sha256('b' || up) || ',t,1>>' AS content, 0::BIGINT AS hits, 1::BIGINT AS misses FROM b WHERE NOT round_ AND up NOT IN (SELECT id FROM b)
  UNION ALL SELECT b.id, b.text || chr(10) || CASE WHEN starts_with(e.content, '  ') THEN '' ELSE '  ' END || e.content, e.hits + 1, e.misses FROM b JOIN e ON b.up = e.id WHERE NOT b.round_
), r AS (
  SELECT b.id AS p_partkey, 'see' || CASE WHEN starts_with(coalesce(e.content, b.text), ' ') THEN '' ELSE ' ' END
    || coalesce(e.content, b.text || chr(10) || '  <<ccr:' || sha256('b' || CASE WHEN round_ THEN b.id ELSE b.up END) || ',t,1>>') AS text, 1 + coalesce(e.hits, 0) AS hits, coalesce(e.misses, 0) AS misses
  FROM b LEFT JOIN e ON e.id = b.id
)"""


def _nested(spark, d) -> tuple[DataFrame, DataFrame]:
    """A text with a token for each part; the parts' blocks name others, up to eight deep, some of them themselves."""
    part, name = R.parts(spark, d), lambda c: F.sha2(F.concat(F.lit("b"), c.cast("string")).cast("binary"), 256)
    tok = lambda h: F.concat(F.lit("<<ccr:"), h, F.lit(",t,1>>"))
    up = F.when(F.col("p_partkey") % 50 == 7, F.col("p_partkey")).otherwise(F.expr("p_partkey div 3"))
    store = part.select(name(F.col("p_partkey")).alias("hash"), F.concat("p_name", F.lit("\n  "), tok(name(up))).alias("content"), now().alias("created_at"))
    return part.select("p_partkey", F.concat(F.lit("see "), tok(name(F.col("p_partkey")))).alias("text")), store


@query(f"{NESTED} SELECT p_partkey, sha256(text) AS text_sha256, length(text)::BIGINT AS n_chars FROM r")
def decompress_nested(spark, d):
    """Blocks within blocks, inflated to the last; what leads into a cycle stays a token."""
    done = api.decompress(*_nested(spark, d), now(), max_passes=None)
    return done.select("p_partkey", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"))


@query(f"{NESTED} SELECT (SELECT count(*) FROM b) AS count, (SELECT sum(length(text) + 79)::BIGINT FROM b) AS total_bytes, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, sum(hits) / sum(hits + misses)::DOUBLE AS hit_ratio FROM r")
def decompress_stats(spark, d):
    """The counters after that: a retrieval for each token that was looked up."""
    docs, store = _nested(spark, d)
    return api.stats(store, api.decompress_logged(docs, store, now(), to_the_last=True)[1], now())


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE sha256(text) END AS hash FROM documents")
def token_parse(spark, d):
    h = blocks.content_hash(F.col("text"))
    shape = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<<ccr:"), h, F.lit(",py,3>>"))).when(F.col("doc_id") % 3 == 1, h).otherwise(F.concat(F.lit("x"), h))
    return R.table(spark, d, "documents").select("doc_id", blocks.parse_token(shape).alias("hash"))


@query("SELECT doc_id, ['json','code','code','log','tabular','tabular',NULL,NULL,'code',NULL,NULL,'code'][doc_id % 12 + 1] AS route, [NULL,'python','js',NULL,NULL,NULL,NULL,NULL,'h',NULL,NULL,'rs'][doc_id % 12 + 1] AS lang FROM documents")
def route_by_ext(spark, d):
    return R.named(spark, d).select("doc_id", router.by_extension(F.col("filename")).alias("route"), router.language(F.col("filename")).alias("lang"))


@query("SELECT doc_id, ['json','log','tabular','tabular','code','code',NULL,'code'][doc_id % 8 + 1] AS route FROM documents")
def route_by_mime(spark, d):
    return R.named(spark, d).select("doc_id", router.by_mime(F.col("mime_type")).alias("route"))


@query("SELECT 'log' AS kind, 'log' AS route, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'table', 'tabular', count(DISTINCT user_id) FROM events UNION ALL SELECT 'json', 'json', count(DISTINCT user_id) FROM events UNION ALL SELECT 'code', 'code', count(*) FROM part")
def route_by_content(spark, d):
    kinds = {"log": R.logs(spark, d), "table": R.tables(spark, d), "json": R.lists(spark, d).select(F.to_json("items").alias("text")), "code": R.code(spark, d).select(F.col("py").alias("text"))}
    out = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("mime_type"), "text")
        out = part if out is None else out.unionByName(part)
    return router.route(out).groupBy("kind", "route").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT p_partkey, '    name = ''' || p_name || '''' || chr(10) || '    return name * ' || p_size AS body FROM part) SELECT p_partkey, 'def f(x):' || chr(10) || '    <<ccr:' || sha256(body) || ',python,' || length(body) || '>>' || chr(10) AS skeleton, sha256(body) AS hash FROM c")
def code_python_blocks(spark, d):
    c = R.code(spark, d).select("p_partkey", compress_code(F.col("py"), F.lit("python")).alias("c"))
    return c.select("p_partkey", F.col("c.skeleton").alias("skeleton"), F.col("c.blocks")[0]["hash"].alias("hash"))


@query("WITH c AS (SELECT p_partkey, ' const s = ''{' || p_name || '}''; return s.repeat(' || p_size || '); ' AS body FROM part) SELECT p_partkey, 'function f(x) {<<ccr:' || sha256(body) || ',js,' || length(body) || '>>}' || chr(10) AS skeleton, sha256(body) AS hash FROM c")
def code_brace_blocks(spark, d):
    c = R.code(spark, d).select("p_partkey", compress_code(F.col("js"), F.lit("js")).alias("c"))
    return c.select("p_partkey", F.col("c.skeleton").alias("skeleton"), F.col("c.blocks")[0]["hash"].alias("hash"))


@query("SELECT p_partkey, 'def f(x):' || chr(10) || '    name = ''' || p_name || '''' || chr(10) || '    return name * ' || p_size || chr(10) AS text FROM part")
def code_round_trip(spark, d):
    """Compress, store, decompress: the text itself."""
    rows = R.code(spark, d).select("p_partkey", F.lit("x.py").alias("filename"), F.lit(None).cast("string").alias("mime_type"), F.col("py").alias("text"))
    done = written(router.compress(rows).select("p_partkey", "compressed", "blocks"), "code")  # both the store and the texts are read from it
    return api.decompress(done.select("p_partkey", F.col("compressed").alias("text")), api.store(done, now()), now())


def sql_items(item: str, sep: str, where: str) -> str:
    return f"coalesce(string_agg({item}, {sep} ORDER BY pos) FILTER (WHERE {where}), '')"


def sql_formats() -> str:
    nl, crlf = "chr(10)", "chr(13) || chr(10)"

    def obj(pad: int) -> str:
        x = " " * pad
        return f"'{{' || chr(10) || '{x}  \"event_id\": ' || event_id || ',' || chr(10) || '{x}  \"event_type\": \"' || event_type || '\"' || chr(10) || '{x}}}'"

    def listed(item: str, pad: int, where: str) -> str:
        x = " " * pad
        some = sql_items(f"'{x}  ' || {item}", "',' || chr(10)", where)
        return f"CASE WHEN {some} = '' THEN '[]' ELSE '[' || chr(10) || {some} || chr(10) || '{x}]' END"

    head, tail, odd = "pos <= 5", "pos > n - 5", "pos > 5 AND pos <= n - 5 AND event_type LIKE '%error%'"
    found = f"'{{' || chr(10) || '      \"original_index\": ' || (pos - 1) || ',' || chr(10) || '      \"value\": ' || {obj(6)} || chr(10) || '    }}'"
    whole = " || ',' || chr(10) || ".join(f"'  \"{name}\": ' || {value}" for name, value in (("__type__", "'\"truncated_list\"'"), ("head", listed(obj(4), 2, head)), ("tail", listed(obj(4), 2, tail)), ("anomalies", listed(found, 2, odd)), ("omitted_count", "(n - 10)")))
    rows = lambda at: f"{at} || '.event_id,int,' || event_id || {crlf} || {at} || '.event_type,str,' || event_type || {crlf}"
    table = f"',truncated_list,(' || (n - 10) || ' items omitted)' || {crlf} || " + " || ".join(sql_items(rows(at), "''", w) for at, w in (("'[' || (pos - 1) || ']'", head), ("'[' || (pos - 1) || '] (ANOMALY)'", odd), ("'[tail_' || (pos - n + 4) || ']'", tail)))
    bullet = lambda at, pad: f"{at} || {nl} || '{pad}* **event_id**: ' || event_id || {nl} || '{pad}* **event_type**: ' || event_type"
    kept = {w: sql_items(bullet(f"'    * [' || {at} || ']:'", " " * 6), nl, w) for at, w in (("(pos - 1)", head), ("'Index ' || (pos - 1)", odd), ("(pos - 1)", tail))}
    marked = f"'* **List (Truncated)**: ' || (n - 10) || ' items omitted' || {nl} || '  * **Head (First 5 items):**' || {nl} || {kept[head]} || {nl} || CASE WHEN {kept[odd]} = '' THEN '' ELSE '  * **Anomalies Found:**' || {nl} || {kept[odd]} || {nl} END || '  * **Tail (Last 5 items):**' || {nl} || {kept[tail]}"
    flat = sql_items(bullet("'* [' || (pos - 1) || ']:'", "  "), nl, "true")
    short = sql_items(rows("'[' || (pos - 1) || ']'"), "''", "true")
    return f"""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CASE WHEN n > 10 THEN '{{' || chr(10) || {whole} || chr(10) || '}}' ELSE {listed(obj(2), 0, "true")} END AS json,
  'Path,Type,Value' || {crlf} || CASE WHEN n > 10 THEN {table} ELSE {short} END AS csv_schema, CASE WHEN n > 10 THEN {marked} ELSE {flat} END AS markdown_kv
FROM r GROUP BY user_id, n"""


@query(sql_formats())
def json_formats(spark, d):
    x = R.lists(spark, d).select("user_id", F.to_json("items").alias("text"))
    return x.select("user_id", *[crush_json(F.col("text"), 5, f).alias(f.replace("-", "_")) for f in ("json", "csv-schema", "markdown-kv")])


@query("""SELECT p_partkey, '{' || chr(10) || '  "name": "' || p_name || '",' || chr(10) || '  "in": {' || chr(10) || '    "items": {' || chr(10) || '      "__type__": "truncated_list",' || chr(10) || '      "head": [],' || chr(10) || '      "tail": [],' || chr(10)
  || '      "anomalies": [' || CASE WHEN p_size > 2 THEN chr(10) || '        {' || chr(10) || '          "original_index": 2,' || chr(10) || '          "value": "fatal"' || chr(10) || '        }' || chr(10) || '      ' ELSE '' END || '],' || chr(10) || '      "omitted_count": ' || p_size || chr(10) || '    }' || chr(10) || '  }' || chr(10) || '}' AS every_list,
  '{"name":' || chr(10) || ' no JSON, ' || p_name AS fallback FROM part""")
def json_nested(spark, d):
    """With K = 0 each list becomes a node, in objects too; what isn't JSON is compressed as prose."""
    numbers = F.slice(F.sequence(F.lit(0), F.col("p_size").cast("int")), F.lit(1), F.col("p_size").cast("int"))
    whole = F.array_join(F.transform(numbers, lambda i: F.when(i == 2, '"fatal"').otherwise(i.cast("string"))), ", ")
    text = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "in": {"items": ['), whole, F.lit("]}}"))
    prose = F.concat(F.lit('{"name":  \n no   JSON, '), F.regexp_replace("p_name", " ", "   "), F.lit("\t"))
    return R.parts(spark, d).select("p_partkey", crush_json(text, 0).alias("every_list"), crush_json(prose, 0).alias("fallback"))


@query("""WITH c AS (SELECT p_partkey, '    name = ''' || p_name || '''' || chr(10) || '    return name * ' || p_size AS py, ' const s = ''{' || p_name || '}''; return s.repeat(' || p_size || '); ' AS js FROM part)
SELECT p_partkey, 'def f(x):' || chr(10) || '    <<ccr:' || sha256(py) || ',python,' || length(py) || '>>' || chr(10) AS sniffed, 'def f(: function f(x) {<<ccr:' || sha256(js) || ',python,' || length(js) || '>>}' || chr(10) AS broken FROM c""")
def code_sniffed(spark, d):
    """Python that no name tells, and what is named Python but can't be parsed: the latter is cut at its braces."""
    c = R.code(spark, d)
    return c.select("p_partkey", compress_code(F.col("py"))["skeleton"].alias("sniffed"), compress_code(F.concat(F.lit("def f(: "), "js"), F.lit("python"))["skeleton"].alias("broken"))


@query("SELECT p_partkey, 'text' AS route, 'made [DATE]' || chr(10) || 'by [UUID] of ' || p_name AS compressed FROM part")
def compress_aligned(spark, d):
    """Volatile values are replaced before a document is routed and compressed."""
    h = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.concat(F.lit("made   2024-02-30  \nby "), uuid, F.lit("   of "), "p_name", F.lit("\n"))
    rows = R.parts(spark, d).select("p_partkey", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("mime_type"), text.alias("text"))
    return router.compress(rows, aligned=True).select("p_partkey", "route", "compressed")


SQL_QUOTED = """WITH r AS (SELECT doc_id, i, i || ',"a ""q"", b' || chr(10) || 'err' || CASE WHEN i = 8 THEN 'or' ELSE '' END || '"' AS row FROM documents, range(1, 16) t(i))
SELECT doc_id, 'id,note' || chr(10) || string_agg(row, chr(10) ORDER BY i) FILTER (WHERE i <= 3) || chr(10) || '... [omitted 4 rows] ...,' || chr(10) || '[Row 9],' || max(row) FILTER (WHERE i = 8) || chr(10)
  || '... [omitted 4 rows] ...,' || chr(10) || string_agg(row, chr(10) ORDER BY i) FILTER (WHERE i > 12) || chr(10) AS compressed FROM r GROUP BY doc_id"""


@query(SQL_QUOTED)
def csv_quoted(spark, d):
    rows = R.table(spark, d, "documents").select("doc_id", F.concat(F.lit("id,note\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.concat(i.cast("string"), F.lit(',"a ""q"", b\nerr'), F.when(i == 8, "or").otherwise(""), F.lit('"'))), "\n")).alias("text"))
    return crush_table(rows, "text", 3).select("doc_id", "compressed")


@query("""WITH c AS (SELECT p_partkey, 'def f(x):' || chr(10) AS head, '    name = ''' || p_name || '''' || chr(10) || '    return name * ' || p_size AS py, ' const s = ''{' || p_name || '}''; return s.repeat(' || p_size || '); ' AS js FROM part)
SELECT p_partkey || '.' || kind AS name, route, compressed, n_blocks FROM (
  SELECT p_partkey, 'py' AS kind, 'code' AS route, head || '    <<ccr:' || sha256(py) || ',python,' || length(py) || '>>' || chr(10) AS compressed, 1::BIGINT AS n_blocks FROM c
  UNION ALL SELECT p_partkey, 'js', 'code', 'function f(x) {<<ccr:' || sha256(js) || ',js,' || length(js) || '>>}' || chr(10), 1 FROM c
  UNION ALL SELECT p_partkey, 'json', 'json', '{' || chr(10) || '  "size": ' || p_size || chr(10) || '}', 0 FROM part
  UNION ALL SELECT p_partkey, 'csv', 'tabular', 'a,b' || chr(10) || p_size || ',' || p_partkey || chr(10), 0 FROM part
  UNION ALL SELECT p_partkey, 'log', 'log', string_agg('line ' || i, chr(10) ORDER BY i) FILTER (WHERE i <= 20) || chr(10) || '... [omitted 10 lines] ...' || chr(10) || string_agg('line ' || i, chr(10) ORDER BY i) FILTER (WHERE i > 30), 0 FROM part, range(1, 51) t(i) GROUP BY p_partkey
  UNION ALL SELECT p_partkey, 'txt', 'text', 'part ' || p_partkey || chr(10) || '  is of size ' || p_size, 0 FROM part
  UNION ALL SELECT p_partkey, 'none', 'empty', '', 0 FROM part)""")
def compress_routes(spark, d):
    """Each route's documents through one pass of the router."""
    c, key, size = R.code(spark, d), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    texts = {
        "py": F.col("py"), "js": F.col("js"), "json": F.concat(F.lit('{"size": '), size, F.lit("}")), "csv": F.concat(F.lit("a,b\n"), size, F.lit(","), key, F.lit("\n")),
        "log": F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n"),
        "txt": F.concat(F.lit("part "), key, F.lit("  \n  is   of size "), size, F.lit("\n")), "none": F.lit(" \n"),
    }
    known = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in texts.items()])
    rows = c.select(key.alias("key"), F.explode(known).alias("x"))
    name = F.concat("key", F.lit("."), F.col("x.kind"))
    out = router.compress(rows.select(name.alias("name"), F.when(F.col("x.kind").isin("py", "js", "log", "csv"), name).alias("filename"), F.lit(None).cast("string").alias("mime_type"), F.col("x.text").alias("text")))
    return out.select("name", "route", "compressed", F.coalesce(F.size("blocks"), F.lit(0)).cast("bigint").alias("n_blocks"))


@query()
def compress_all(spark, d):
    out = router.compress(R.named(spark, d), aligned=True)
    return out.select("doc_id", "route", "compressed", F.coalesce(F.size("blocks"), F.lit(0)).alias("n_blocks"))


def sql_kept(rows: str, key: str, k: int, kind: str, unit: str, sep: str, before: str = "''", after: str = "''") -> str:
    """Skeletons of rows (key, pos from 1, n, s, odd) whose runs out of sight are tokens, and the texts."""
    return f"""WITH r AS ({rows}), c AS (
  SELECT *, pos - row_number() OVER (PARTITION BY {key} ORDER BY pos) AS g FROM r WHERE pos > {k} AND pos <= n - {k} AND NOT odd
), g AS (
  SELECT {key}, min(pos) AS pos, count(*) AS m, string_agg(s, {sep} ORDER BY pos) AS body FROM c GROUP BY {key}, g
), parts AS (
  SELECT {key}, pos, s, 0 AS block FROM r WHERE pos <= {k} OR pos > n - {k} OR odd
  UNION ALL SELECT {key}, pos, CASE WHEN length(body) > 80 THEN '<<ccr:' || sha256(body) || ',{kind} ' || m || ' {unit},' || length(body) || '>>' ELSE body END, (length(body) > 80)::INT FROM g
), t AS (SELECT {key}, {before} || string_agg(s, {sep} ORDER BY pos) || {after} AS text FROM r GROUP BY {key})
SELECT {key}, {before} || string_agg(s, {sep} ORDER BY pos) || {after} AS skeleton, any_value(text) AS text, sum(block)::BIGINT AS n_blocks FROM parts JOIN t USING ({key}) GROUP BY {key}"""


def _put_back(rows: DataFrame, key: str) -> DataFrame:
    """Skeletons (key, c) and the texts to which they decompress. What is compressed is a table, as both the store and the texts are read from it."""
    made = written(rows, "kept").select(key, F.col("c.skeleton").alias("skeleton"), F.col("c.skeleton").alias("text"), F.col("c.blocks").alias("blocks"))
    counted = made.withColumn("n_blocks", F.size("blocks").cast("bigint")).drop("blocks")  # their contents need not go through its joins
    return api.decompress(counted, api.store(made, now()), now()).select(key, "skeleton", "text", "n_blocks")


BY_USER = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n, event_type = 'error' AS odd FROM events"


@query(sql_kept(f"SELECT *, line AS s, {MARK} AS odd FROM ({R.SQL['log_lines']})", "user_id", 3, "log", "lines", "chr(10)"))
def log_round_trip(spark, d):
    """Logs whose omitted lines are blocks, compressed, stored and decompressed."""
    return _put_back(R.logs(spark, d).select("user_id", keep_log(F.col("text"), 3).alias("c")), "user_id")


@query(sql_kept(f"SELECT user_id, event_id || ',' || event_type AS s, {BY_USER}", "user_id", 2, "table", "rows", "chr(10)", "'event_id,event_type' || chr(10)", "chr(10)"))
def table_round_trip(spark, d):
    return _put_back(R.tables(spark, d).select("user_id", keep_table(F.col("text"), 2).alias("c")), "user_id")


@query(sql_kept(f"""SELECT user_id, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}' AS s, {BY_USER}""", "user_id", 2, "json", "items", "','", "'['", "']'"))
def list_round_trip(spark, d):
    return _put_back(R.lists(spark, d).select("user_id", keep_list(F.col("items"), 2).alias("c")), "user_id")


@query(f"""SELECT d.doc_id, skeleton, coalesce(d.text, '') AS text, coalesce(n_blocks, 0) AS n_blocks FROM documents d LEFT JOIN ({sql_kept(
    f"SELECT doc_id, pos, (count(*) OVER (PARTITION BY doc_id))::BIGINT AS n, line AS s, {MARK} AS odd FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos, len(x) AS m FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE NOT (pos = m AND line = '')",
    "doc_id", 1, "log", "lines", "chr(10)")}) k USING (doc_id)""")
def document_round_trip(spark, d):
    """Every whole text with its first and last line in sight."""
    return _put_back(R.table(spark, d, "documents").select("doc_id", keep_log(F.col("text"), 1).alias("c")), "doc_id")


def sql_typed(k: int) -> str:
    def crushed(rows: str, by: str, order: str) -> str:
        """JSON of the rows (s, odd) of each group ``by``, and whether any is odd."""
        listed = lambda item, where: f"'[' || coalesce(string_agg({item}, ',' ORDER BY {order}) FILTER (WHERE {where}), '') || ']'"
        found = f"'{{\"original_index\":' || (pos - 1) || ',\"value\":' || s || '}}'"
        node = f"""'{{"__type__":"truncated_list","head":' || {listed('s', f'pos <= {k}')} || ',"tail":' || {listed('s', f'pos > n - {k}')} || ',"anomalies":' || {listed(found, f'pos > {k} AND pos <= n - {k} AND odd')} || ',"omitted_count":' || (n - {2 * k}) || '}}'"""
        numbered = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows})"
        return f"SELECT {by}, CASE WHEN n > {2 * k} THEN {node} ELSE {listed('s', 'true')} END AS made, bool_or(odd) AS odd FROM ({numbered}) GROUP BY {by}, n"

    events = """SELECT user_id, event_id % 7 AS part, ts, event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS s, event_type = 'error' AS odd FROM events"""
    parts = f"""SELECT user_id, part, '{{"part":' || part || ',"events":' || made || '}}' AS s, odd FROM ({crushed(events, "user_id, part", "ts, event_id")})"""
    return f"SELECT user_id, made AS crushed FROM ({crushed(parts, 'user_id', 'part')})"


@query(sql_typed(2))
def json_typed(spark, d):
    """Lists of lists, cut at both levels by expressions made from their type."""
    rows = R.table(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("part"), "ts", "event_id", "event_type")
    inner = rows.groupBy("user_id", "part").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    events = F.transform("x", lambda y: F.struct(y["event_id"].alias("event_id"), y["event_type"].alias("event_type")))
    outer = inner.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("part", events.alias("events")))).alias("parts"))
    return crush_column(outer, "parts", 2, "crushed").select("user_id", "crushed")
