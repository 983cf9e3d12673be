"""Pruning of fitted forests, and forests of several fits in one.

Spark's trees know a smallest leaf but no smallest node to split. Nodes are
split independently of each other, so cutting a grown tree at nodes with too few
notes gives the tree that would have grown under that rule. A note drawn several
times for a tree counts as often.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, scratch_path

NO_SPLIT = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}


def _prune_tree(nodes: pd.DataFrame, least: int) -> pd.DataFrame:
    """The nodes of one tree that are left; ids are places in preorder."""
    nodes = nodes.sort_values("id", ignore_index=True)
    left, right = nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()
    inner = (left >= 0) & (nodes["rawCount"].to_numpy() >= least)
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in np.flatnonzero(inner):  # parents stand before their children
        if kept[i]:
            kept[left[i]] = kept[right[i]] = True
    place = np.cumsum(kept) - 1
    out = nodes.assign(
        id=place,
        leftChild=np.where(inner, place[left], -1),
        rightChild=np.where(inner, place[right], -1),
        gain=np.where(inner, nodes["gain"], -1.0),
        split=[s if own else NO_SPLIT for s, own in zip(nodes["split"], inner, strict=True)],
    )
    return out[kept]


def prune_nodes(nodes: DataFrame, least: int) -> DataFrame:
    """(treeID, nodeData) of saved trees, without splits of nodes below ``least`` notes."""
    flat = nodes.select("treeID", "nodeData.*")
    pruned = flat.groupBy("treeID").applyInPandas(lambda tree: _prune_tree(tree, least), flat.schema)
    fields = nodes.schema["nodeData"].dataType.fieldNames()
    return pruned.select("treeID", F.struct(*fields).alias("nodeData"))


def join_forests(
    spark: SparkSession, forests: list[RandomForestClassificationModel], least: int
) -> RandomForestClassificationModel:
    """One forest of the trees of some, without splits of nodes below ``least`` notes."""
    with scratch(spark):
        path = scratch_path(spark, "forest")
        nodes = trees = None
        n_trees = 0
        for i, forest in enumerate(forests):
            forest.write().save(f"{path}/grown-{i}")
            both = []
            for part in ("data", "treesMetadata"):
                rows = spark.read.parquet(f"{path}/grown-{i}/{part}")
                tree_id = rows.columns[0]  # its name differs
                both.append(rows.withColumn(tree_id, F.col(tree_id) + n_trees))
            nodes = both[0] if nodes is None else nodes.unionByName(both[0])
            trees = both[1] if trees is None else trees.unionByName(both[1])
            n_trees += forest.getNumTrees
        prune_nodes(nodes, least).write.parquet(f"{path}/pruned/data")
        # One row per tree, and one line.
        trees.coalesce(1).write.parquet(f"{path}/pruned/treesMetadata")
        about = json.loads(spark.read.text(f"{path}/grown-0/metadata").first()[0])
        about["numTrees"] = about["paramMap"]["numTrees"] = n_trees
        line = spark.createDataFrame([(json.dumps(about),)], "value string")
        line.coalesce(1).write.text(f"{path}/pruned/metadata")
        # The trees are now held by the driver.
        return RandomForestClassificationModel.load(f"{path}/pruned")


def prune_forest(
    spark: SparkSession, forest: RandomForestClassificationModel, least: int
) -> RandomForestClassificationModel:
    """The forest without splits of nodes that hold fewer than ``least`` notes."""
    return join_forests(spark, [forest], least)
