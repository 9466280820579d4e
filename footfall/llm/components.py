"""Connected components of a link table, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.frames import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (``a``, ``b``); the root is the smallest node reachable.

    Every node takes the smallest label among its neighbours, then the label of its label. Both steps are
    joins and aggregates that combine before the shuffle, so a node with very many links is split by the
    skew join and met as one row a task. Labels are written to the shared folder after every round; the
    rounds grow with the logarithm of a component's diameter. The driver sees one number a round.
    Links that are NULL on a side or from a node to itself are ignored.
    """
    plain = links.select("a", "b").where("a <> b")
    both = stored(plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")),
        "labels",
    )
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("heard")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("heard").alias("heard"))
        )
        hooked = stored(
            labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root")), "labels"
        )
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = hooked.join(jump, "root").select("node", "was", F.least("root", "further").alias("root"))
        after = stored(jumped, "labels")
        if not after.where("root <> was").limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")
