"""Consistent-hash placement: ring positions, preference lists, balance and movement audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.hashing import hash64, hash64_column

VNODES = 150
#: Nodes of a ring that is sent to every task; a position takes 16 bytes.
MAX_NODES = 20_000


def membership(spark: SparkSession, cluster: str, nodes: int, replication_factor: int) -> DataFrame:
    """(node, node_index, replication_factor): ids ``<cluster>-node-<i>``; the factor is at most the number of nodes."""
    if not cluster.strip() or nodes < 1 or not 1 <= replication_factor <= nodes:
        raise ValueError("need a cluster name, a node, and 1 <= replication factor <= nodes")
    return spark.range(nodes).select(F.concat(F.lit(f"{cluster}-node-"), "id").alias("node"), F.col("id").cast("int").alias("node_index"), F.lit(replication_factor).alias("replication_factor"))


def build_ring(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(pos, node): each node at ``vnodes`` hashed positions; at equal positions the later node by name stands."""
    points = nodes.select("node").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
    return points.withColumn("pos", hash64_column(F.concat_ws("#", "node", "i"))).groupBy("pos").agg(F.max("node").alias("node"))


def remove_node(ring: DataFrame, node: str) -> DataFrame:
    return ring.where(F.col("node") != node)


def preference_lists(keys: DataFrame, nodes: list[str], n: int, vnodes: int = VNODES, key: str = "key") -> DataFrame:
    """``keys`` with ``nodes``: the first n distinct nodes clockwise from the key's hash, which itself counts.

    The ring depends on the nodes alone, so each position's list is made once; a key is then one binary search. A blank or
    null key fails the job, as do n < 1 and more than there are nodes.
    """
    nodes = sorted(set(nodes))
    if not 1 <= n <= len(nodes):
        raise ValueError("need 1 <= n <= number of nodes")
    if len(nodes) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    pos = np.concatenate([hash64([f"{x}#{i}" for i in range(vnodes)]) for x in nodes])
    owner = np.repeat(np.arange(len(nodes)), vnodes)
    order = np.lexsort((-owner, pos))
    pos, owner = pos[order], owner[order]
    keep = np.append(True, pos[1:] != pos[:-1])
    pos, owner = pos[keep], owner[keep]

    def walk(start: int) -> list[str]:
        out: list[int] = []
        i = start
        while len(out) < n:
            if owner[i % len(owner)] not in out:
                out.append(int(owner[i % len(owner)]))
            i += 1
        return [nodes[x] for x in out]

    lists: dict[int, list[str]] = {}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def place(hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(pos, hashes.to_numpy(np.int64), "left") % len(pos)
        return pd.Series([lists[i] if i in lists else lists.setdefault(i, walk(i)) for i in at.tolist()])

    ok = F.when(F.length(F.trim(F.col(key))) > 0, F.col(key)).otherwise(F.raise_error(F.lit("blank key")))
    return keys.withColumn("nodes", place(hash64_column(ok)))


def balance(placed: DataFrame) -> DataFrame:
    """(node, keys, share): how many keys each node owns."""
    owned = placed.groupBy(F.col("nodes")[0].alias("node")).agg(F.count(F.lit(1)).alias("keys"))
    return owned.withColumn("share", F.col("keys") / placed.select(F.count(F.lit(1)).alias("n")).scalar())


def movement(keys: DataFrame, before: list[str], after: list[str], vnodes: int = VNODES) -> DataFrame:
    """(old_owner, new_owner, keys): keys by owner before and after the nodes change; both owners come from the same row."""
    old = preference_lists(keys, before, 1, vnodes).withColumn("old_owner", F.col("nodes")[0]).drop("nodes")
    new = preference_lists(old, after, 1, vnodes).withColumn("new_owner", F.col("nodes")[0])
    return new.groupBy("old_owner", "new_owner").agg(F.count(F.lit(1)).alias("keys"))
