"""Chat formatting from event logs; DataFrame functions only.

A log has ``conv_id``, ``seq``, ``kind``, ``msg``, ``role`` and ``text``. Kinds: ``message`` opens
message ``msg`` with a role and a first text, ``delta`` appends streamed text, ``edit`` replaces
the text, ``regenerate`` throws it away so that later deltas build a new one, ``delete`` removes
the message until a later ``message`` opens it again. ``reconstruct`` folds a log into final
messages, ``render`` formats conversations and marks what the loss covers, ``read_back`` parses
the formatted text again.

Template: ``<|turn|>role\\ntext<|end|>\\n``. In roles and texts ``&``, ``<`` and ``[`` become
``&amp;``, ``&lt;`` and ``&#91;`` (and a line break in a role ``&#10;``), so that no control
string of this or another bracketed template survives, and all of it can be read back.

Nulls and edge cases: a null text is empty; a null role is the empty role; rows whose ``conv_id``
is null form one conversation; events order by ``seq`` (nulls first), then message, kind, role and
text, so ties are settled; repeated events apply again; events of unknown kind, or with a null
one, change nothing; an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"


def escape(c: Column) -> Column:
    for plain, sign in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        c = F.replace(c, F.lit(plain), F.lit(sign))
    return c


def unescape(c: Column) -> Column:
    for sign, plain in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return c


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Conversations of whole turns as a log: each opens a message and streams its text as one delta."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(order).cast("long"))
    text = F.lit(None).cast("string")
    both = F.array(
        F.struct((F.col("msg") * 2).alias("seq"), F.lit("message").alias("kind"), F.col("role").alias("role"), text.alias("text")),
        F.struct((F.col("msg") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"), text.alias("role"), F.col("text").alias("text")),
    )
    return rows.select("conv_id", "msg", F.explode(both).alias("e")).select("conv_id", "msg", "e.*")


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, msg, ord (from 1), role, text of the messages that are left, in the order they opened."""
    e = F.struct("seq", "kind", "role", "text")
    known = events.filter(F.col("kind").isin("message", "delta", "edit", "regenerate", "delete")).repartition("conv_id")
    logs = known.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(e)).alias("log"))

    def last(*kinds: str) -> Column:
        """1-based place of the last event of these kinds, or 0."""
        return F.size("log") - F.coalesce(
            F.nullif(F.array_position(F.transform(F.reverse("log"), lambda x: x["kind"].isin(*kinds)), F.lit(True)), F.lit(0)), F.size("log") + 1
        ) + 1

    from_ = last("message", "edit", "regenerate")
    texts = F.transform(
        F.expr("slice(log, greatest(_from, 1), size(log))"),
        lambda x: F.when(x["kind"].isin("message", "delta", "edit"), F.coalesce(x["text"], F.lit(""))).otherwise(F.lit("")),
    )
    opened = F.filter("log", lambda x: x["kind"] == "message")
    done = (
        logs.withColumn("_from", from_).withColumn("_open", last("message")).withColumn("_gone", last("delete"))
        .filter((F.col("_open") > 0) & (F.col("_open") >= F.col("_gone")))
        .select("conv_id", "msg", F.get(opened, F.lit(0))["seq"].alias("_seq"), F.coalesce(F.element_at(opened, -1)["role"], F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))
    )
    order = Window.partitionBy("conv_id").orderBy("_seq", "msg")
    return done.select("conv_id", "msg", F.row_number().over(order).cast("long").alias("ord"), "role", "text")


def render(messages: DataFrame, trained=("assistant",)) -> DataFrame:
    """conv_id, formatted and loss_spans (start from 0, length; in code points, of texts alone)."""
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = messages.select("conv_id", "ord", F.col("role").isin(*trained).alias("_loss"), head.alias("_head"), escape(F.col("text")).alias("_body"))
    whole = F.concat("_head", "_body", F.lit(END))
    before = Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "conv_id", "ord", "_loss", whole.alias("_whole"),
        (F.coalesce(F.sum(F.length(whole)).over(before), F.lit(0)) + F.length("_head")).cast("long").alias("start"), F.length("_body").cast("long").alias("length"),
    )
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "_whole", "_loss", "start", "length"))).alias("m"))
        .select("conv_id", F.array_join("m._whole", "").alias("formatted"), F.transform(F.filter("m", lambda x: x["_loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and the texts under the loss mask, parsed from ``formatted`` alone."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda x: x != "")
    turn = lambda x: F.substring(x, len(TURN) + 1, 2**31 - 1)
    role = lambda x: F.substring_index(turn(x), "\n", 1)
    turns = F.transform(parts, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(turn(x).substr(F.length(role(x)) + 2, F.length(x))).alias("text")))
    lost = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.select("conv_id", "formatted", turns.alias("turns"), lost.alias("loss_texts"))


def digests(rendered: DataFrame) -> DataFrame:
    back = read_back(rendered).withColumn("_loss", F.array_join("loss_texts", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    ok = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
