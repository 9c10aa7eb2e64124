"""Connected components by minimum labels, hooks of whole trees and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace


def components(edges: DataFrame, work: Workspace, name: str, start: DataFrame | None = None) -> DataFrame:
    """(v, label): the smallest vertex reachable from each vertex of ``edges`` (a, b).

    In each round a vertex learns the smallest label around it; the vertex that is its label learns it too, and all that
    have that label with it, so whole trees move at once and long chains end after few rounds. Every round is written
    to the shared folder. What a vertex's neighbours and a label's vertices say combines before it is shuffled.

    ``start`` may hold labels (v, label) of a graph whose edges are among these, to go on from.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    most = 2 * edges.count()  # of directed edges and of vertices
    both = work.write(both, f"{name}-edges", most)
    first = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")).select(F.col("a").alias("v"), "low")
    if start is not None:
        first = first.join(start, "v", "left").select("v", F.least("low", F.coalesce("label", "low")).alias("low"))
    labels = work.write(first.select("v", F.col("low").alias("label")), f"{name}-0", most)
    k = 0
    while True:
        around = both.join(labels, both["b"] == labels["v"]).groupBy(both["a"].alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(around, "v").select("v", "label", F.least("label", "near").alias("next"))
        # what the vertices of a label have heard, and where that label's own vertex stands
        told = F.explode(F.array(F.struct(F.col("label").alias("key"), F.col("next").alias("far")), F.struct(F.col("v").alias("key"), F.col("next").alias("far"))))
        heard = step.select(told.alias("x")).groupBy("x.key").agg(F.min("x.far").alias("far"))
        new = step.join(heard, step["label"] == heard["key"], "left").select("v", F.least("next", F.coalesce("far", "next")).alias("new"), "label")
        k += 1
        written = work.write(new.select("v", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), f"{name}-{k}", most)
        moved = not written.where("moved").isEmpty()
        work.drop(f"{name}-{k - 1}")
        labels = written.select("v", "label")
        if not moved:
            work.drop(f"{name}-edges")
            return labels
