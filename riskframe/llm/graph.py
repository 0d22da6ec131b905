"""Connected components of an edge table, by rounds of minimum labels."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every end of an edge; ``root`` is the smallest member
    of its component.  A round takes the smallest label among neighbours,
    then the label of that label, so the number of rounds follows the
    logarithm of a component's diameter rather than the diameter; labels
    and edges stay tables throughout."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    e = saved(e.union(e.select("b", "a")).distinct())
    lab = saved(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "v"))
    while True:
        near = (e.join(lab.select(F.col("v").alias("b"), F.col("root").alias("r")), "b")
                .groupBy("a").agg(F.min("r").alias("near")))
        step = (lab.join(near.withColumnRenamed("a", "v"), "v", "left")
                .select("v", "root", F.least("root", F.coalesce("near", "root")).alias("next")))
        jump = lab.select(F.col("v").alias("next"), F.col("root").alias("hop"))
        moved = saved(step.join(jump, "next", "left")
                      .select("v", F.least("next", F.coalesce("hop", "next")).alias("root"), (F.col("next") != F.col("root")).alias("ch"),
                              (F.coalesce("hop", "next") < F.col("next")).alias("ch2")))
        lab = moved.select("v", "root")
        if moved.where("ch or ch2").isEmpty():
            return lab
