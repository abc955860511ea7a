"""Connected components as DataFrame operations.

Nothing of a component or a list of links is ever collected to the driver or held in
one task: every step is an equi-join or an aggregation with a map-side part, so Spark can
split hot keys (adaptive skew joins) and combine hot groups before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch


#: Links up to which a round's tables are broadcast and kept in few files; beyond that all joins shuffle.
MOST_SMALL = 500_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Each round hooks a node and its parent to the smallest grandparent among its neighbours and
    then shortcuts, so chains halve and stars close at once; it ends when a round moves nothing. Loops and repeated
    edges are harmless; null ends are ignored; no edges give no rows.
    """
    one = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    small = one.count() <= MOST_SMALL
    side = F.broadcast if small else lambda x: x
    few = (lambda x: x.coalesce(4)) if small else lambda x: x
    quiet = scratch.apart(small)
    both = quiet.cut(few(one.union(one.select(F.col("b"), F.col("a"))).distinct()))
    tree = quiet.cut(few(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))))
    while True:
        up = tree.join(side(tree.select(F.col("v").alias("p"), F.col("p").alias("g"))), "p")
        # What each node and each parent hears of: neighbours' grandparents, and its own.
        heard = both.join(side(up.select(F.col("v").alias("b"), "g")), "b").join(side(tree.select(F.col("v").alias("a"), "p")), "a")
        told = heard.select(F.explode(F.array("a", "p")).alias("v"), "g").union(up.select("v", "g"))
        least = told.groupBy("v").agg(F.min("g").alias("n"))
        new = quiet.cut(few(tree.join(side(least), "v").select("v", F.least("n", "p").alias("p"), (F.col("n") < F.col("p")).alias("moved"))))
        quiet.drop(tree)
        tree = new
        if new.where("moved").isEmpty():
            quiet.drop(both)
            return scratch.again(tree).select(F.col("v").alias("node"), F.col("p").alias("root"))
