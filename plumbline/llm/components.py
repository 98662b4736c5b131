"""Connected components of a graph given as pairs, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut


def components(pairs: DataFrame) -> DataFrame:
    """(id, least): for every id in ``pairs`` (a, b) the least id that it is connected with.

    Each round takes the least label among neighbours and then that label's own label, so that the number of rounds
    grows with the logarithm of a component's diameter. No pair gives no row; repeated pairs and loops do no harm.
    """
    edges = cut(pairs.selectExpr("a as id", "b as other").unionByName(pairs.selectExpr("b as id", "a as other")).distinct())
    labels = cut(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("least")))
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("least").alias("heard"))
        near = labels.join(heard, "id").select("id", "least", F.least("least", "heard").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("least").alias("further"))
        new = cut(near.join(jump, "new").select("id", F.least("new", "further").alias("new"), "least"))
        changed = new.where("new <> least").limit(1).count()
        labels = new.select("id", F.col("new").alias("least"))
        if not changed:
            return labels
