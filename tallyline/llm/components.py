"""Connected components of a link table, without gathering any component in one place.

Each round takes minimum labels over links, hooks whole trees under smaller labels, and shortens paths, so the number of
rounds follows the logarithm of the longest chain. All steps are aggregations with map-side combine and joins whose one
side has unique keys. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node that can be reached.

    An empty link table gives an empty result; repeated links and links of a node with itself change nothing.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), f"{name}-start")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        told = label.join(near, "node").select("node", "root", F.least("root", "near").alias("near"))
        hooks = told.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        hung = told.join(hooks, "node", "left").select("node", F.col("root").alias("old"), F.least("near", F.coalesce("hook", "near")).alias("root"))
        step = written(hung, f"{name}-hung")
        short = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("above")), "root").select("node", "old", F.least("root", "above").alias("root"))
        after = written(short, f"{name}-round")
        discard(step)
        discard(label)
        changed = after.filter(F.col("root") != F.col("old")).limit(1).count()
        label = after.select("node", "root")
        if not changed:
            discard(both)
            return label


def with_components(prints: DataFrame, nodes: DataFrame, root: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each row of ``prints``, given the roots of linked fingerprints."""
    rooted = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = root.join(nodes.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = rooted.join(least, "root", "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "first_doc").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")
