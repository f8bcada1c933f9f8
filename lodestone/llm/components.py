"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, label): the smallest node that each can reach.

    Each round gives every node the smallest label among its neighbours' and
    its own, then follows labels one step (the label of its label); it ends
    when nothing changes.  Each round's labels are written to the shared
    folder, so that a lost executor costs that round alone.  Minima are taken
    before the shuffle, so a node with very many links isn't gathered anywhere.
    Links to itself and null ends are ignored.  No links: no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        step = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(lower.join(step, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("was")).alias("changed")), "labels")
        discard(labels)
        labels = after
        if after.where("changed").isEmpty():
            discard(both)
            out = after.select("node", "label")
            out.__dict__["_stored_at"] = after.__dict__["_stored_at"]  # to be deleted by whoever has read it
            return out
