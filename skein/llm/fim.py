r"""Fill-in-middle transformation by overlapping chunks; DataFrame functions only.

A text is cut into units of ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``, but never tokenized as a
whole. A unit ends where a character that isn't white space meets one that is, so two adjacent
characters tell:

1. A text is parted into chunks of ``CHUNK`` characters, each of which also holds the first
   character of the next one. Every chunk counts the unit ends in it, by itself.
2. Sums of the counts before each chunk route a cut, given as a number of units, to the chunk that
   owns it: the first one whose units reach that number.
3. That chunk alone is scanned again for the place of the cut.

Cuts are drawn from a hash of ``doc_id``, and so is the form: ``plain`` (the text as it is), ``psm``
(``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). A text that
holds one of these signs stays plain, so that what was made can be read back. Rows are independent:
nothing is shuffled.

Nulls and edge cases: a null text is empty; an empty text has no unit and stays plain; a text of
white space alone is one unit, as is white space at the end; a null ``doc_id`` draws as the empty
string; repeated rows give repeated rows; an empty table gives an empty result; other columns pass
through whatever their names. Characters are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.lines import let
from skein.llm.common import columns

#: Characters of a chunk.
CHUNK = 4096
#: White space, and the place between a unit and the next one.
SPACE = r"\x20\x09-\x0D"
END = rf"(?<=[^{SPACE}])(?=[{SPACE}])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def chunks(text: Column, size: int = CHUNK) -> Column:
    """Pieces of ``size`` characters, each but the last with the first character of the next."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return let(pieces, lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(p, i + 1), 1, 1), F.lit("")))))


def counts(parts: Column) -> Column:
    """Ends of units within each chunk; the end of the text is none of them."""
    return F.transform(parts, lambda x: F.regexp_count(x, F.lit(f"[^{SPACE}][{SPACE}]")))


def before(numbers: Column) -> Column:
    """Their sums: ends before each chunk, and at last in all."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))


def place(parts: Column, sums: Column, rank: Column, size: int = CHUNK) -> Column:
    """Characters before the end of unit ``rank``, which is an end within the text (from 1); only the chunk that owns it is scanned."""
    owner = F.size(F.filter(sums, lambda s: s < rank)) - 1  # chunks before it have fewer ends than the rank

    def within(at: Column) -> Column:
        rest = lambda x, k: F.length(x) - F.length(F.get(F.split(x, END, k + 1), k))
        return at * size + rest(F.get(parts, at), rank - F.get(sums, at))

    return let(owner, within)


def draws(doc_id: Column, seed: str = "42") -> Column:
    """Four numbers of 32 bits by document."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return let(digest, lambda d: F.array(*[F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: str = "42", size: int = CHUNK) -> DataFrame:
    """``_row`` (the row of ``docs``: doc_id and text), ``n`` units, ``form``, ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of those with the suffix first.
    """
    rows = docs.select(columns(docs).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_t"), draws(F.col("doc_id"), seed).alias("_h"))
    parts = let(chunks(F.col("_t"), size), lambda p: F.struct(p.alias("parts"), before(counts(p)).alias("sums")))
    n = F.element_at(F.col("_c.sums"), -1) + (F.col("_t") != "").cast("int")
    marked = (F.col("_t") == "") | F.col("_t").contains(PREFIX) | F.col("_t").contains(SUFFIX) | F.col("_t").contains(MIDDLE)
    form = F.when(marked | (F.col("_h")[2] % 100 >= rate), "plain").when(F.col("_h")[3] % 100 < spm, "spm").otherwise("psm")
    cut = rows.withColumn("_c", parts).withColumn("n", n.cast("long")).withColumn("form", form)

    def at(rank: Column) -> Column:
        inner = place(F.col("_c.parts"), F.col("_c.sums"), rank, size)
        return let(rank, lambda r: F.when(r == 0, 0).when(r == F.col("n"), F.length("_t")).otherwise(inner)).cast("int")

    drawn = [(F.col("_h")[i] % (F.col("n") + 1)).cast("int") for i in (0, 1)]
    ends = F.when(F.col("form") != "plain", F.struct(at(F.least(*drawn)).alias("a"), at(F.greatest(*drawn)).alias("b")))
    placed = cut.withColumn("_e", let(ends, lambda e: e)).drop("_c", "_h")
    piece = lambda a, b: F.when(F.col("form") != "plain", F.col("_t").substr(a + 1, b - a))
    a, b = F.col("_e.a"), F.col("_e.b")
    made = placed.select("_row", "_t", "n", "form", piece(F.lit(0), a).alias("prefix"), piece(a, b).alias("middle"), piece(b, F.length("_t")).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return made.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("_t"))).drop("_t")


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no sign can begin within a piece, as pieces hold none and no sign overlaps another."""
    head, tail = F.substring_index(output, SUFFIX, 1), F.substring_index(output, SUFFIX, -1)
    suffix, after = F.substring_index(tail, PREFIX, 1), F.substring_index(tail, PREFIX, -1)
    psm = F.concat(F.substring(head, len(PREFIX) + 1, 2**31 - 1), F.substring_index(tail, MIDDLE, -1), F.substring_index(tail, MIDDLE, 1))
    spm = F.concat(F.substring_index(after, MIDDLE, 1), F.substring_index(after, MIDDLE, -1), suffix)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
