"""Connected components of a graph whose edges are a DataFrame.

Each round joins the edges with the vertices' parents, hooks both a vertex and its parent to the
least grandparent among the neighbours and shortens the paths, which takes a number of rounds
logarithmic in the size of the largest component. Minima are summed up before they are shuffled and joins on
a hub's id leave the hub on the side that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import drop, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v and component (the least vertex reachable) of every vertex that has an edge. Null ends and loops link nothing."""
    rows = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    both = stage(rows.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    parent = stage(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")), "parents")
    total = parent.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        up = parent.select(F.col("v").alias("_u"), F.col("p").alias("g"))
        grand = parent.join(up, F.col("p") == F.col("_u")).select("v", "p", "g")
        heard = both.join(grand.select(F.col("v").alias("_n"), "g"), F.col("b") == F.col("_n")).groupBy("a").agg(F.min("g").alias("m"))
        joined = grand.join(heard, F.col("v") == F.col("a"))
        told = joined.select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.least("p", "g", "m").alias("p")), F.struct(F.col("p").alias("v"), F.col("m").alias("p")))).alias("e")).select("e.*")
        nxt = stage(told.groupBy("v").agg(F.min("p").alias("p")), "parents")
        new_total = nxt.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        drop(parent)
        parent, done = nxt, new_total == total
        total = new_total
        if done:
            break
    drop(both)
    return parent.select("v", F.col("p").alias("component"))
