"""The queries that apply each operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat, fim, langid, linededup, media, minhash, mixing, packing, substring, toxicity, trie, vectors, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = langid.remainder(5) == 0
    crf = langid.fit(docs.select("doc_id", "text", "lang"), ~held_out)
    return langid.predict(docs, crf, F.coalesce(held_out, F.lit(False)).alias("held_out"))


def _line_dedup(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    out = linededup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), width)
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), F.col("_text").alias("kept_text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: without later repeats of runs of two or more lines."""
    return _line_dedup(spark, sf_dir, linededup.WIDTH)


def op5_every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: without later repeats of any line."""
    return _line_dedup(spark, sf_dir, linededup.EVERY)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    log = chat.events_of_turns(turns.unionByName(chat.planted(spark)))
    return chat.digests(chat.render(chat.reconstruct(log)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.common import stage

    made = stage(media.documents_as_media(_read(spark, sf_dir, "documents")), "media")
    sequences = media.parse(made.select("doc_id", "html"), "doc_id", "html")
    elements = media.resolve(sequences, "doc_id", media.features(made))
    return elements.filter("kind = 'media'").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = langid.remainder(3) == 1
    crf = toxicity.fit(docs.select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    return toxicity.score(docs, crf, F.coalesce(held_out, F.lit(False)).alias("held_out"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder and read again."""
    import uuid

    from skein.llm.common import shared_dir

    warc.register(spark)
    path = f"{shared_dir(spark)}/skein-warc-{uuid.uuid4().hex}"
    warc.records(_read(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    archive = spark.read.format("warc").option("partitions", spark.sparkContext.defaultParallelism).schema("record_type string, record_id string, headers map<string,string>, http map<string,string>, payload binary").load(path)
    return warc.pages_of(archive.filter(F.col("record_type").isin("response", "revisit")))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations of which up to eight first turns are those of the one whose id is the multiple of five below."""
    from skein.llm.common import stage

    table = _read(spark, sf_dir, "conversations")
    turns = stage(trie.contents(table), "turns")
    ids = table.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = turns.filter((F.col("conv_id") % 5 == 0) | (F.col("turn") > first))
    near = turns.filter((F.col("conv_id") % 5 == 0) & (F.col("turn") <= 8)).withColumn("_base", F.col("conv_id"))
    near = near.withColumn("_j", F.explode(F.array(*[F.lit(j).cast("long") for j in range(-4, 5) if j]))).withColumn("conv_id", F.try_add("_base", "_j"))
    given = near.filter((F.col("conv_id") - F.col("conv_id") % 5 == F.col("_base")) & (F.col("turn") <= first)).join(ids, "conv_id", "left_semi")
    return trie.trie(own.unionByName(given.select(*own.columns)), ids)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fim.restore(F.col("output"), F.col("form"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return made.select(F.col("_row.doc_id").alias("doc_id"), "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_embedding_near_dedup, op3_source_mixing, op4_language_id, op5_line_dedup, op5_every_line_dedup, op6_chat_formatting, op7_substring_dedup, op8_media_columns, op9_toxicity, op10_minhash_near_dedup, op11_warc, op12_conversation_prefix_trie, op13_fill_in_middle)}


SQL_MIX = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM sized GROUP BY source
), w AS (
  SELECT *, CASE (nr - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight::DOUBLE, nr) AS rn FROM w
), level AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM r
), cut AS (
  SELECT words / weights::DOUBLE AS share, rn AS first FROM level WHERE 3 * source_size * weights > words * weight ORDER BY rn LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN first IS NULL OR rn < first THEN (3 * source_size)::DOUBLE ELSE weight * share END AS target FROM r LEFT JOIN cut ON true
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END::BIGINT AS whole FROM t
), b AS (
  SELECT sized.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    sum(size) OVER (PARTITION BY sized.source ORDER BY h)::BIGINT AS cum
  FROM sized JOIN p ON sized.source IS NOT DISTINCT FROM p.source
), f AS (
  SELECT source, min(cum) AS crossed FROM b WHERE cum > rest GROUP BY source
), g AS (
  SELECT b.source, f.crossed, sum(size)::BIGINT AS n FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source AND b.cum = f.crossed GROUP BY ALL
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN rest > 0 AND (cum <= rest OR (cum = crossed AND cum - rest < rest - (cum - n))) THEN 1 ELSE 0 END) AS taken
FROM b LEFT JOIN g ON b.source IS NOT DISTINCT FROM g.source
"""

SQL_LINES = """
WITH rows AS (
  SELECT doc_id, text, row_number() OVER () AS r FROM documents
), d AS (  -- equal rows are one document
  SELECT DISTINCT doc_id, text FROM documents
), k AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k FROM d
), l AS (
  SELECT k, i, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM k WHERE text IS NOT NULL)
), full_ AS (
  SELECT k, i, t, lead(t) OVER (PARTITION BY k ORDER BY i) AS t2, row_number() OVER (PARTITION BY k ORDER BY i) AS j FROM l WHERE t <> ''
), first AS (
  SELECT t, t2, min((k, i)) AS f FROM full_ WHERE t2 IS NOT NULL GROUP BY t, t2
), later AS (
  SELECT k, j FROM full_ JOIN first USING (t, t2) WHERE (k, i) > f
), gone AS (
  SELECT DISTINCT k, j + x AS j FROM later, (VALUES (0), (1)) v(x)
), fate AS (
  SELECT l.k, l.i, l.line, max(full_.j) OVER (PARTITION BY l.k ORDER BY l.i) AS j FROM l LEFT JOIN full_ USING (k, i)
), kept AS (
  SELECT k, count(*) AS n_lines, count(gone.j) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.j IS NULL) AS kept_text
  FROM fate LEFT JOIN gone USING (k, j) GROUP BY k
)
SELECT rows.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN rows.text IS NOT NULL THEN coalesce(kept_text, '') END AS kept_text
FROM rows LEFT JOIN k ON rows.doc_id IS NOT DISTINCT FROM k.doc_id AND rows.text IS NOT DISTINCT FROM k.text LEFT JOIN kept USING (k)
"""

SQL_EVERY_LINE = """
WITH rows AS (
  SELECT doc_id, text FROM documents
), k AS (  -- equal rows are one document
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k FROM (SELECT DISTINCT doc_id, text FROM documents)
), l AS (
  SELECT k, i, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM k WHERE text IS NOT NULL)
), gone AS (
  SELECT k, i, row_number() OVER (PARTITION BY t ORDER BY k, i) > 1 AS again FROM l WHERE t <> ''
), fate AS (  -- a blank line goes with the line before it
  SELECT l.k, l.i, l.line, coalesce(last_value(again IGNORE NULLS) OVER (PARTITION BY l.k ORDER BY l.i), false) AS again FROM l LEFT JOIN gone USING (k, i)
), kept AS (
  SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT again) AS kept_text FROM fate GROUP BY k
)
SELECT rows.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN rows.text IS NOT NULL THEN coalesce(kept_text, '') END AS kept_text
FROM rows LEFT JOIN k ON rows.doc_id IS NOT DISTINCT FROM k.doc_id AND rows.text IS NOT DISTINCT FROM k.text LEFT JOIN kept USING (k)
"""

SQL_CHAT = """
WITH c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]', r, '' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), e AS (
  SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 4 * (length(role) - length(replace(role, chr(10), ''))) + 17 AS n FROM c
), a AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS lost, sum(n)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost)::BIGINT AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM a
"""

SQL_WARC = """
WITH p AS (
  SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), again AS (
  SELECT payload, max(page_id) AS last FROM p GROUP BY payload HAVING count(*) > 1
)
SELECT page_id, octet_length(encode(p.payload)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN again ON p.payload = again.payload
"""

SQL_TRIE = """
WITH t AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (  -- crc32 of the decimal id, bit by bit
  SELECT c, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)
), rebuilt AS (
  SELECT ids.c, o, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND o <= h
  UNION ALL SELECT ids.c, o, role, text FROM ids JOIN t USING (c) WHERE o > h
), numbered AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, sha256(length(role) || ':' || role || text) AS turn, octet_length(encode(text)) AS b FROM rebuilt
), paths AS (
  SELECT c, d, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS node, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS up, b FROM numbered
  UNION ALL SELECT c, 0, '', NULL, 0 FROM ids
), nodes AS (
  SELECT node, min(c) AS c, min(d) AS d, coalesce(min(up), CASE WHEN min(d) > 0 THEN '' END) AS up, count(*) AS n, (count(*) - 1) * min(b) AS v FROM paths GROUP BY node
), kids AS (
  SELECT up AS node, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY 1
), sums AS (  -- a node is below those that its representative's turns name up to its depth
  SELECT p.node, sum(n.v) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves FROM nodes n JOIN paths p ON p.c = n.c AND p.d <= n.d LEFT JOIN kids ON kids.node = n.node GROUP BY 1
), ends AS (
  SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, d) AS node FROM paths GROUP BY c) GROUP BY node
)
SELECT nodes.c AS conv_id, nodes.d::BIGINT AS depth, parent.c AS parent_conv_id, nodes.n::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes parent ON parent.node = nodes.up
"""

SQL_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), r AS (
  SELECT *, len(u)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS x FROM d
), f AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r
), c AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_warc": SQL_WARC, "op12_conversation_prefix_trie": SQL_TRIE, "op13_fill_in_middle": SQL_MIDDLE, "op3_source_mixing": SQL_MIX, "op5_line_dedup": SQL_LINES, "op5_every_line_dedup": SQL_EVERY_LINE, "op6_chat_formatting": SQL_CHAT}
