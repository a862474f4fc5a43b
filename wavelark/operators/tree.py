"""Paths and order of a design's scopes and nodes, as joins; a level of the tree is a step.

scopes: scope_id, parent_id, name, kind, ord. nodes: node_id, name, scope_id, parent_id, stream_id, ord.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from .changes import numbered


def _levels(roots: DataFrame, children: DataFrame, key: str, grown: dict[str, Column]) -> DataFrame:
    """roots and all below them; grown: columns of a child from its own and its parent's (as p). Each level is written to
    a scratch table and joined with the one above alone; an id that comes twice on one way down is an error."""
    spark, columns = roots.sparkSession, roots.columns

    def kept(level: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "level")
        level.write.parquet(path)
        return spark.read.schema(level.schema).parquet(path)

    level = kept(roots.withColumn("way", F.array(F.col(key))))
    levels = [level]
    while True:
        parents = level.select(F.col(key).alias("parent_id"), F.struct(*level.columns).alias("p"))
        below = children.join(parents, "parent_id").withColumns(grown)
        below = below.withColumn("way", F.when(F.array_contains("p.way", F.col(key)), F.raise_error(F.concat(F.lit("the tree has a cycle at "), F.col(key).cast("string"))).cast(level.schema["way"].dataType)).otherwise(F.concat("p.way", F.array(F.col(key)))))
        level = kept(below.select(*columns, "way"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).select(*columns)
        levels.append(level)


def scope_paths(scopes: DataFrame) -> DataFrame:
    """scopes with path (the names from the top, but for a root of kind root) and sort_key."""
    empty = F.array().cast("array<bigint>")
    roots = scopes.filter("parent_id IS NULL").withColumns({"path": F.when(F.col("kind") == "root", "").otherwise(F.col("name")), "sort_key": empty})
    path = F.when(F.col("p.kind") == "root", F.col("name")).otherwise(F.concat_ws(".", "p.path", "name"))
    key = F.concat("p.sort_key", F.array(F.lit(1).cast("bigint"), F.col("ord").cast("bigint")))
    return _levels(roots, scopes.filter("parent_id IS NOT NULL"), "scope_id", {"path": path, "sort_key": key})


def node_paths(scopes: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with path, sort_key (depth first, signals before scopes), and whether an ancestor has a stream."""
    above = scope_paths(scopes).select("scope_id", F.col("path").alias("scope_path"), F.col("sort_key").alias("scope_key"))
    top = nodes.filter("parent_id IS NULL").join(above, "scope_id")
    path = F.when(F.col("scope_path") == "", F.col("name")).otherwise(F.concat_ws(".", "scope_path", "name"))
    key = F.concat("scope_key", F.array(F.lit(0).cast("bigint"), F.col("ord").cast("bigint")))
    top = top.withColumns({"path": path, "sort_key": key, "covered": F.lit(False)}).select(*nodes.columns, "path", "sort_key", "covered")
    glue = F.when(F.col("name").startswith("["), "").otherwise(".")
    grown = {"path": F.concat("p.path", glue, "name"), "sort_key": F.concat("p.sort_key", F.array(F.col("ord").cast("bigint"))), "covered": F.col("p.covered") | F.col("p.stream_id").isNotNull()}
    return _levels(top, nodes.filter("parent_id IS NOT NULL"), "node_id", grown)


def find_nodes(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """The node of each path asked for; of nodes with one path, the first."""
    return asked.join(paths.groupBy("path").agg(F.min("node_id").alias("node_id")), "path", "left")


def leaf_order(scopes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that have a stream, below no other such node, numbered depth first."""
    leaves = node_paths(scopes, nodes).filter(F.col("stream_id").isNotNull() & ~F.col("covered"))
    return numbered(leaves, "leaf_ord", "sort_key")
