"""Connected components of an edge table, without collecting edges or groups anywhere.

Each round maps every vertex to the smallest of itself and its neighbours, makes
those paths shorter by following them twice, and contracts the edges.  A long
chain shrinks by a constant factor a round, a star in one round.  Rounds are
written to the shared folder, so lost executors cost no more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def contracted(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def follow(step: DataFrame) -> DataFrame:
    ahead = step.select(F.col("u").alias("to"), F.col("to").alias("further"))
    return step.join(ahead, "to").select("u", F.col("further").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(u, label) for each vertex of ``edges`` (u, v: long, no nulls): the smallest vertex it is connected with.

    Loops and repeated edges change nothing; no edges give no rows.
    """
    edges = written(contracted(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = written(both.groupBy("u").agg(F.min("v").alias("to")).select("u", F.least("u", "to").alias("to")), "steps")
        step = written(follow(follow(step)), "steps")
        steps.append(step)
        left, right = step.select("u", F.col("to").alias("a")), step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        edges = written(contracted(edges.join(left, "u").join(right, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    if not steps:
        return edges.select("u", F.col("v").alias("label"))
    label = steps.pop().select("u", F.col("to").alias("label"))
    while steps:
        later = label.select(F.col("u").alias("to"), F.col("label").alias("end"))
        label = steps.pop().join(later, "to", "left").select("u", F.coalesce("end", "to").alias("label"))
    return written(label, "labels")
