"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``a long, b long`` to ``id, component``: the smallest id of the component, for every id on an edge.

    Every round each vertex points at its smallest neighbour, if that is smaller. Pointers are doubled until they end at
    roots, then all vertices take their root's name and the edges are renamed and made distinct. Roots of a round that
    still touch go on. Nothing is gathered in one task but the minimum of a vertex, which is pre-aggregated.
    """
    edges = edges.where("a <> b")
    edges = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    first = True
    while not edges.isEmpty():
        roots = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        while True:
            above = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = cut(roots.join(above, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            roots = step.select("a", "p")
            if step.where("moved").isEmpty():
                break
        pa, pb = roots.select("a", F.col("p").alias("pa")), roots.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = cut(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        named = roots.select(F.col("a").alias("component"), "p")
        labels = named.withColumnsRenamed({"component": "id", "p": "component"}) if first else labels.join(named, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        labels, first = cut(labels), False
    return labels
