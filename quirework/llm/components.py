"""Connected components by contraction, wholly in DataFrames.

Each round points every node at its smallest neighbour, follows pointers once more,
and contracts the edges; a hub with many neighbours is one pre-aggregated row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of (a, b): comp is the smallest id that it reaches."""
    e = edges.select(F.col("a"), F.col("b")).where("a <> b").distinct()
    nodes = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
    found = checkpointed(nodes.select("id", F.col("id").alias("comp")))
    e = checkpointed(e)
    while e.limit(1).count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        far = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.a")).select(F.col("x.a").alias("at"), F.col("y.to").alias("to"))
        far = checkpointed(far)
        found = checkpointed(found.join(far, found["comp"] == far["at"], "left").select("id", F.coalesce("to", "comp").alias("comp")))
        e = e.join(far, e["a"] == far["at"]).select(F.col("to").alias("a"), "b")
        e = e.join(far, e["b"] == far["at"]).select("a", F.col("to").alias("b"))
        e = checkpointed(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found
