"""Connected components over undirected links, kept in Spark tables."""

from pyspark.sql import DataFrame, functions as F

from workloom.session import stash


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): each node of `links` (a, b) with the least node of its component.

    Each round gives a node the least label around it and then follows its label's own label, so paths
    shrink by half; it ends when no label changes. Every round's labels are written to the shared folder.
    Groups are only ever reduced to a minimum, so a node with very many links costs no task more.
    """
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where("a <> b"), "links")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                   .select("node", F.least("node", "near").alias("label")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = hooked.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        jumped = stash(jumped, "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
