"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored


def lowered(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: of each node's smaller neighbours all others hang below the smallest.

    Bands name one node below very many others, a different one in each band; of those few are left.  Nothing is joined,
    but a node's smaller neighbours are gathered, so a caller's links must bound them, as bands do with one for each.
    """
    of = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    below, lowest = of.groupBy("u").agg(F.collect_set("v").alias("below")), F.array_min("below")
    others = F.array_remove(F.array_append("below", F.col("u")), lowest)
    return below.select(lowest.alias("a"), F.explode(others).alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(nid, root) of every node in ``links`` (a, b), the root being the smallest node it is connected with.

    Each round hangs the larger neighbours of a node below its smallest one, then the smaller ones, until nothing
    moves.  The smallest neighbour is an aggregate and is joined back, so a node with very many links is not gathered.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.distinct(), "edges")
    roots = edges.select(F.col("v").alias("nid"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("nid"), F.col("v").alias("root")).unionByName(roots)
