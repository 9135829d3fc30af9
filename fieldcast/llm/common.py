"""Helpers shared by the operators: stored frames, hot-key blocks, components."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.session import staging_path


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ..., which no helper column is called."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def as_named(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of ``df`` under the names that they have in ``like``."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, model: object) -> Callable[[], object]:
    """Broadcasts a model of bounded size; a task gets it by calling the result.

    Its class travels with it, so executors need not have this library installed.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)


# --------------------------------------------------------------------------- hot keys

def in_blocks(members: DataFrame, block_rows: int, few_keys: bool = False) -> DataFrame:
    """Lay out key-sharing rows so that no task needs a whole key.

    ``members`` has ``key`` (any struct or scalar), ``role`` and other columns.
    Rows of role 0 are the indexed side: a key's role-0 rows are dealt by
    ``spread`` (a column of hash values) over ``ceil(count / block_rows)``
    blocks, and each lies in one block (``role`` 0) and is shown as a prober
    (``role`` 1) to the lower blocks. Rows of role 1 are shown to every block.
    Each pair (role 0, role 0) or (role 0, role 1) of a key so meets in exactly
    one block. Keys without a role-0 row can't yield a pair and are dropped.
    ``few_keys`` says that the number of keys has a bound, whatever the rows, so
    that the row counts by key can be broadcast.

    The result is partitioned and sorted by (key, block, role).
    """
    counts = (members.where("role = 0").groupBy("key")
              .agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("n_blocks")))
    counts = F.broadcast(counts) if few_keys else counts
    own = F.pmod(F.col("spread"), F.col("n_blocks")).cast("int")
    last = F.when(F.col("role") == 0, own).otherwise(F.col("n_blocks") - 1)
    laid = (members.join(counts, "key")
            .withColumn("last", last)
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
            .withColumn("role", F.when((F.col("role") == 0) & (F.col("block") == F.col("last")), 0).otherwise(1)))
    return (laid.drop("spread", "n_blocks", "last")
            .repartition("key", "block").sortWithinPartitions("key", "block", "role"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest with the same components as the links u-v.

    Each node but one of a component is linked to the component's smallest
    node, so the result has fewer edges than there are nodes.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


# --------------------------------------------------------------------------- components

def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); equal roots = connected.

    Randomised contraction: each round maps every node to the neighbour (or
    itself) with the smallest round-specific hash, rewrites the edges with the
    images and drops loops, which shrinks the node count by a constant factor
    whatever the graph's shape. The per-round maps are composed backwards at
    the end, so the cost is geometric in the node count. Rounds are stored in
    the shared folder; only a flag per round reaches the driver.
    """
    here = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    here = stored(here, "cc-edges")
    maps: list[DataFrame] = []
    while not here.isEmpty():
        r = len(maps)
        both = here.select("u", "v").union(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("x"))
        best = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        image = stored(best.select(F.col("u").alias("node"), F.least("m", order("u"))["x"].alias("root")), "cc-map")
        maps.append(image)
        left = image.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = image.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = here.join(left, "u").join(right, "v").where("ru <> rv")
        here = stored(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(),
                      "cc-edges")
    if not maps:
        return here.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps.pop()
    while maps:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("later"))
        out = (maps.pop().join(later, "root", "left")
               .select("node", F.coalesce("later", "root").alias("root")))
    return out


def smallest_of_component(classes: DataFrame, links: DataFrame, key: str, low: str) -> DataFrame:
    """``classes`` (key, low) with ``component``: the smallest ``low`` reachable by ``links`` (u, v)."""
    roots = stored(connected_components(links).withColumnRenamed("node", key), "cc-roots")
    linked = roots.join(classes, key)
    lows = linked.groupBy("root").agg(F.min(low).alias("component"))
    named = linked.join(lows, "root").select(key, "component")
    return (classes.join(named, key, "left")
            .withColumn("component", F.coalesce("component", low)))
