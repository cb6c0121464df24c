"""Connected components of a link table, by least reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (columns a, b); the component is the least id reachable.

    Every round takes the least label of all neighbours, then the label of the
    label, so paths shrink by half; each round is written to the shared folder.
    An id with very many neighbours costs one combined row per task.
    """
    both = saved(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*").distinct(), "links")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("least"))
        own = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        over = labels.select(F.col("id").alias("at"), F.col("label").alias("beyond"))
        jumped = own.join(over, F.col("label") == F.col("at"), "left").select("id", "was", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        step = saved(jumped, "labels")
        labels = step.select("id", "label")
        if step.where("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
