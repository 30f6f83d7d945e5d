r"""Logs and tables too long for one row: files are read in blocks, by as many tasks as they have.

A document is a file, or a folder of files in the order of their names. Spark's text reader gives the
physical lines of each block of a file in order, with the place at which the block begins. What a
block needs to know of those before it, how many lines or records there were, whether a quote is
open, how the last run of anomalies ended, is a small value for each block; these are summed up over
the blocks of a document and handed back. No task holds more than a block's lines, and the lines of
a document are neither sorted nor shuffled.

The results are rows ``document, line_no, kind, text``; in the order of (line_no, kind) their texts
are the lines that ``crush_log`` or ``crush_rows`` make of the whole text. ``line_no`` is the number of
the line (for a table: of the row, the header being 1) that a row shows, or of the first one that a
mark stands for; kind is 0 for what is omitted, 1 for a run's title, 2 for a line.

Edge cases: an empty file has no row; ``\r\n`` ends a line as ``\n`` does; a log's lines also end where
``crush_log`` ends them, but if a file's last line ends so and has no ``\n``, an empty line follows. In
tables a quote opens only at the beginning of a cell, as in Python's csv module; a quote that is never
closed reaches to the end of the document.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.lines import LINE_END
from skein.functions.predicates import log_anomaly, value_anomaly
from skein.operators.tabular import write_row
from skein.sources.shared import written

BLOCK = "document string, file string, start long"


def lines_of(spark: SparkSession, path: str, whole_folder: bool = False) -> DataFrame:
    """document, file, start (of the block in its file) and value of the physical lines, in order within each block."""
    rows = spark.read.option("lineSep", "\n").text(path)
    document = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1) if whole_folder else F.col("_metadata.file_path")
    return rows.select(document.alias("document"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple, pa.RecordBatch]]:
    """(whether another block begins, its document, file and start, lines of it) in order."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file"), batch.column("start").to_numpy()
        names = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (start[1:] != start[:-1])) + 1), len(start)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (batch.column("document")[a].as_py(), file[a].as_py(), int(start[a]))
            yield key != last, key, batch.slice(a, b - a)
            last = key


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


MARKS = pa.schema([("document", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("value", pa.string())])


def _in_order():
    """The blocks of a document; one row for each."""
    return Window.partitionBy("document").orderBy("file", "start")


def _before():
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of each block of ``rows`` (with odd) the odd lines and the first and last ``k``: at (in the block, from 1), value; and a row with n, its number of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, late = None, 0, []

        def ended() -> pa.RecordBatch:
            return _table([(*key, at, None, v) for at, v in late] + [(*key, None, n, None)], MARKS)

        for new, block, lines in _blocks(batches):
            if new:
                if key:
                    yield ended()
                key, n, late = block, 0, []
            at = np.arange(n + 1, n + 1 + lines.num_rows)
            n += lines.num_rows
            shown = (at <= k) | lines.column("odd").to_numpy(zero_copy_only=False).astype(bool)
            value = lines.column("value")
            kept = [(*key, int(at[i]), None, value[i].as_py()) for i in np.flatnonzero(shown)]
            late = (late + [(int(at[i]), value[i].as_py()) for i in range(max(0, lines.num_rows - k), lines.num_rows) if not shown[i]])[-k:] if k else []
            late = [x for x in late if x[0] > n - k]
            yield _table(kept, MARKS)
        if key:
            yield ended()

    return rows.select("document", "file", "start", "value", "odd").mapInArrow(run, f"{BLOCK}, at long, n long, value string")


def crush_logs(spark: SparkSession, path: str, k: int = 20, whole_folder: bool = False) -> DataFrame:
    """``crush_log`` for documents of any length. One pass over the files; what it keeps is written once."""
    k = max(0, k)
    physical = lines_of(spark, path, whole_folder)
    each = physical.select("document", "file", "start", F.explode(F.split(F.regexp_replace("value", "\r\\z", ""), LINE_END, -1)).alias("value"))
    kept = written(_candidates(each.withColumn("odd", log_anomaly(F.col("value"))), k), "lines")
    sizes = kept.filter("n is not null").select("document", "file", "start", "n")
    base = sizes.select("document", "file", "start", F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("_base"), F.sum("n").over(Window.partitionBy("document")).alias("_all"))
    base = written(base, "numbers")
    told = kept.filter("at is not null").join(F.broadcast(base), ["document", "file", "start"])  # one row a block of the files
    line = told.select("document", "file", "start", (F.col("at") + F.col("_base")).alias("line_no"), "value", F.col("_all"), (F.col("_base") + 1).alias("_first"))
    ends = line.filter((F.col("line_no") <= k) | (F.col("line_no") > F.col("_all") - k) | (F.col("_all") <= 2 * k))
    plain = ends.select("document", "line_no", F.lit(2).alias("kind"), F.col("value").alias("text"))
    odd = line.filter(log_anomaly(F.col("value")) & (F.col("line_no") > k) & (F.col("line_no") <= F.col("_all") - k) & (F.col("_all") > 2 * F.lit(k)))

    # Runs within a block; the last odd line before a block comes from the blocks before it.
    block = Window.partitionBy("document", "file", "start").orderBy("line_no")
    lasts = odd.groupBy("document", "file", "start").agg(F.max("line_no").alias("_last"))
    carried = base.join(lasts, ["document", "file", "start"], "left").select("document", "file", "start", F.coalesce(F.max("_last").over(_before()), F.lit(k)).alias("_carried"), "_last", "_all")
    carried = written(carried, "carried")
    near = odd.join(F.broadcast(carried.select("document", "file", "start", "_carried")), ["document", "file", "start"])  # one row a block
    near = near.withColumn("_before", F.coalesce(F.lag("line_no").over(block), F.col("_carried")))
    new = (F.col("_before") < F.col("line_no") - 1) | (F.col("_before") == k)  # the carried value is k where no odd line stands before
    numbered = near.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(block))
    pieces = numbered.groupBy("document", "file", "start", "_run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.min_by("_before", "line_no").alias("before"))
    # A piece with run 0 goes on with a run of a block before it: it ends that run.
    tails = pieces.filter("_run = 0").select("document", "file", "start", F.col("last").alias("_to"))
    heads = pieces.filter("_run > 0")
    lead = heads.groupBy("document", "file", "start").agg(F.max("first").alias("first")).withColumn("_to", F.lit(None).cast("long"))
    seams = lead.unionByName(tails.withColumn("first", F.lit(None).cast("long"))).groupBy("document", "file", "start").agg(F.max("first").alias("first"), F.max("_to").alias("_to"))
    opener = seams.withColumn("_of", F.last("first", ignorenulls=True).over(_before()))  # one row a block
    longer = opener.filter("_to is not null").groupBy("document", F.col("_of").alias("first")).agg(F.max("_to").alias("_longer"))
    runs = heads.select("document", "first", "last", "before").join(longer, ["document", "first"], "left").select("document", "first", F.coalesce("_longer", "last").alias("last"), "before")

    omitted = lambda n: F.concat(F.lit("... [omitted "), n.cast("string"), F.lit(" lines] ..."))
    gaps = runs.filter(F.col("first") - F.col("before") > 1).select("document", (F.col("before") + 1).alias("line_no"), F.lit(0).alias("kind"), omitted(F.col("first") - F.col("before") - 1).alias("text"))
    titles = runs.select("document", F.col("first").alias("line_no"), F.lit(1).alias("kind"), F.concat(F.lit("--- Preserved anomaly/error lines "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(" ---")).alias("text"))
    shown = odd.select("document", "line_no", F.lit(2).alias("kind"), F.concat(F.lit("[Line "), F.col("line_no").cast("string"), F.lit("] "), "value").alias("text"))
    last = carried.groupBy("document").agg(F.max("_all").alias("_all"), F.coalesce(F.max("_last"), F.lit(k)).alias("_last"))
    left = last.filter(F.col("_all") > 2 * F.lit(k)).withColumn("_n", F.col("_all") - k - F.col("_last")).filter("_n > 0")
    end = left.select("document", (F.col("_last") + 1).alias("line_no"), F.lit(0).alias("kind"), omitted(F.col("_n")).alias("text"))
    return plain.unionByName(gaps).unionByName(titles).unionByName(shown).unionByName(end)


def _steps(value: Column, delimiter: str) -> Column:
    """What a line does to an open quote: bit 0, whether one is open after it if none was before; bit 1, if one was."""
    d = "\\t" if delimiter == "\t" else "\\x{%x}" % ord(delimiter)
    inside = '(?:[^"]++|"")*+"[^D]*+'
    cell = f'(?:"{inside}|[^"D][^D]*+|)'
    closed = lambda first: value.rlike(f"(?s)\\A{first}(?:D{cell})*+\\z".replace("D", d))
    return F.when(~value.contains('"'), 2).otherwise(F.when(closed(cell), 0).otherwise(1) + F.when(closed(inside), 0).otherwise(2)).cast("int")


def _open(steps: np.ndarray, state: int) -> np.ndarray:
    """Whether a quote is open before each line, and after the last."""
    n = len(steps)
    swaps = np.concatenate([[0], np.cumsum(steps == 1)])
    fixed = np.concatenate([[-1], np.maximum.accumulate(np.where((steps == 0) | (steps == 3), np.arange(n), -1))]) if n else np.array([-1])
    since = swaps - np.where(fixed >= 0, swaps[fixed + 1], 0)
    return (np.where(fixed >= 0, steps[fixed] == 3 if n else False, state) + since) % 2


def csv_records(spark: SparkSession, path: str, delimiter: str = ",", whole_folder: bool = False) -> DataFrame:
    """document, record (from 1), n (records of the document) and text of each record of tables with quotes, cut at true record ends.

    The files are read twice: for what each block does to an open quote, and, once that is summed up,
    for the records. Only records of several lines are shuffled.
    """
    lines = lines_of(spark, path, whole_folder).withColumn("step", _steps(F.col("value"), delimiter))
    ends = pa.schema([("document", pa.string()), ("file", pa.string()), ("start", pa.int64()), *[(c, pa.int64()) for c in ("to0", "to1", "n0", "n1")]])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, n = None, [0, 1], [0, 0]
        for new, block, rows in _blocks(batches):
            if new:
                if key:
                    yield _table([(*key, *at, *n)], ends)
                key, at, n = block, [0, 1], [0, 0]
            steps = rows.column("step").to_numpy()
            for s in (0, 1):
                states = _open(steps, at[s])
                n[s] += int((states[:-1] == 0).sum())
                at[s] = int(states[-1])
        if key:
            yield _table([(*key, *at, *n)], ends)

    # A block sets, keeps or turns the state; the last that set it and the turns since tell the state after it.
    told = written(lines.select("document", "file", "start", "step").mapInArrow(both, BLOCK + ", to0 long, to1 long, n0 long, n1 long"), "quotes")
    turns = told.withColumn("_turns", F.sum(F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0)).over(_in_order()))
    fixed = F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("s"), F.col("_turns").alias("t")))
    seen = turns.withColumn("_set", F.last(fixed, ignorenulls=True).over(_before())).withColumn("_so_far", F.coalesce(F.max("_turns").over(_before()), F.lit(0)))
    state = F.when(F.col("_set").isNull(), F.col("_so_far") % 2).otherwise((F.col("_set.s") + F.col("_so_far") - F.col("_set.t")) % 2)
    known = seen.withColumn("_state", state.cast("int")).withColumn("_n", F.when(F.col("_state") == 0, F.col("n0")).otherwise(F.col("n1")))
    known = written(known.select("document", "file", "start", "_state", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("document")).alias("n")), "states")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, record, at = 0, 0, 0
        for new, _, rows in _blocks(batches):
            if new:
                state, record, at = rows.column("_state")[0].as_py(), rows.column("_base")[0].as_py(), 0
            states = _open(rows.column("step").to_numpy(), state)
            numbers = record + np.cumsum(states[:-1] == 0)
            place = np.arange(at, at + rows.num_rows)
            state, record, at = int(states[-1]), int(numbers[-1]), at + rows.num_rows
            one = (states[:-1] == 0) & (states[1:] == 0)
            columns = [rows.column(c) for c in ("document", "file", "start", "n", "value")] + [pa.array(numbers), pa.array(place), pa.array(one)]
            yield pa.RecordBatch.from_arrays(columns, ["document", "file", "start", "n", "value", "record", "_at", "_one"])

    joined = lines.join(F.broadcast(known), ["document", "file", "start"]).select("document", "file", "start", "value", "step", "n", "_state", "_base")  # one row a block
    rows = joined.mapInArrow(number, BLOCK + ", n long, value string, record long, _at long, _one boolean")
    single = rows.filter("_one").select("document", "record", "n", F.col("value").alias("text"))
    place = F.struct("file", "start", "_at", "value")
    several = rows.filter("not _one").groupBy("document", "record").agg(F.max("n").alias("n"), F.array_join(F.sort_array(F.collect_list(place))["value"], "\n").alias("text"))
    return single.unionByName(several.select("document", "record", "n", "text"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _cells(text: pa.Array, delimiter: pa.Array) -> pa.Array:
    read = lambda t, d: next(csv.reader(io.StringIO(t, newline="\n"), delimiter=d), [])
    return pa.array([None if t is None else read(t, d) for t, d in zip(text.to_pylist(), delimiter.to_pylist(), strict=True)], pa.list_(pa.string()))


def crush_tables(spark: SparkSession, path: str, k: int = 5, delimiter: str = ",", whole_folder: bool = False) -> DataFrame:
    """``crush_rows`` for tables of any length; rows that aren't shown are dropped as soon as they are numbered."""
    k, sep = max(0, k), F.lit(delimiter)
    records = csv_records(spark, path, delimiter, whole_folder)
    raw = F.regexp_replace("text", "\r\\z", "")
    quoted = F.col("text").contains('"')
    split = F.when(raw == "", F.array().cast("array<string>")).otherwise(F.split(raw, "\\Q" + delimiter + "\\E", -1))
    cells = F.when(quoted, _cells(F.when(quoted, F.col("text")), sep)).otherwise(split)
    rows = records.withColumn("_cells", cells).withColumn("_odd", F.exists("_cells", value_anomaly))
    at, size = F.col("record") - 1, F.col("n") - 1  # of the data, without the header
    short = (size <= 2 * F.lit(k)) & F.lit(k > 0)
    ends = (at <= k) | (at > size - k) if k else at == 0
    kept = written(rows.filter(ends | short | F.col("_odd")).select("document", "record", "n", "text", "_cells", "_odd"), "rows")
    plain = kept.filter((at == 0) | ends | short).select("document", F.col("record").alias("line_no"), F.lit(2).alias("kind"), F.when(short, F.col("text")).otherwise(write_row(F.col("_cells"), sep)).alias("text"))
    odd = kept.filter(F.col("_odd") & (at > k) & (at <= size - k) & ~short)
    numbered = F.concat(F.array(F.concat(F.lit("[Row "), F.col("record").cast("string"), F.lit("]"))), "_cells")
    shown = odd.select("document", F.col("record").alias("line_no"), F.lit(2).alias("kind"), write_row(numbered, sep).alias("text"))
    heads = kept.filter("record = 1").select("document", F.greatest(F.size("_cells") - 1, F.lit(0)).alias("_pad"), "n")
    return plain.unionByName(shown).unionByName(_gaps(odd.select("document", "record"), heads, k, sep))


#: Rows of a table for each stretch in which gaps between anomalies are looked for.
STRETCH = 1 << 20


def _gaps(odd: DataFrame, heads: DataFrame, k: int, sep: Column) -> DataFrame:
    """Marks of what is omitted between anomalies: within stretches of rows, and over their borders by each stretch's first and last anomaly."""
    part = F.floor(F.col("record") / STRETCH).alias("_part")
    inner = odd.select("document", "record", part).withColumn("_before", F.lag("record").over(Window.partitionBy("document", "_part").orderBy("record")))
    sides = inner.groupBy("document", "_part").agg(F.min("record").alias("_min"), F.max("record").alias("_max"))
    order = Window.partitionBy("document").orderBy("_part")  # one row a stretch
    over = sides.select("document", F.col("_min").alias("record"), F.lag("_max").over(order).alias("_before"))
    pairs = inner.filter("_before is not null").select("document", "record", "_before").unionByName(over)
    lasts = sides.groupBy("document").agg(F.max("_max").alias("_before"))
    end = heads.join(lasts, "document", "left").filter((F.col("n") - 1 > 2 * k) | F.lit(k == 0)).select("document", (F.col("n") - k + 1).alias("record"), "_before")
    every = pairs.unionByName(end).withColumn("_before", F.coalesce("_before", F.lit(k + 1))).withColumn("_n", F.col("record") - F.col("_before") - 1).filter("_n > 0")
    mark = F.concat(F.array(F.concat(F.lit("... [omitted "), F.col("_n").cast("string"), F.lit(" rows] ..."))), F.expr("array_repeat('', _pad)"))
    return every.join(heads.select("document", "_pad"), "document").select("document", (F.col("_before") + 1).alias("line_no"), F.lit(0).alias("kind"), write_row(mark, sep).alias("text"))
