"""Entity linkage: connected components, groups of records that share an identifier, duplicate clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.joins import spread_join
from cohortlens.operators.similarity import star_edges
from cohortlens.session import materialise

BLOCK = 1 << 19  # edges that a task contracts at once


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a block: its components as stars around their smallest node."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ends = rank[both.indices.to_numpy()]
        a, b = ends[:table.num_rows], ends[table.num_rows:]
        root = np.arange(len(order))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        node = np.flatnonzero(root != np.arange(len(root)))
        names = both.dictionary.take(pa.array(order))
        return pa.record_batch([names.take(pa.array(node)), names.take(pa.array(root[node]))], names=["hi", "lo"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def contract(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge for each node and block of (hi, lo) edges, before any shuffle."""
    kind = dict(edges.dtypes)["hi"]
    return edges.select("hi", "lo").mapInArrow(_contracted, f"hi {kind}, lo {kind}")


def components(edges: DataFrame, nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(node, component) with component the smallest node it is connected to.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round links neighbours to the smallest
    neighbour, first the larger ones and then the smaller ones, until only stars are left; the number of rounds grows
    with the logarithm of the graph. Each round is written to the shared folder. Tasks first contract what they hold by
    union-find, so a hub comes down to one edge a block. Minima are combined before the shuffle, and a hub's edges are
    dealt over several tasks where they meet its minimum.
    """
    e = materialise(contract(edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
                             .where(F.col("lo") != F.col("hi"))).distinct(), "edges")
    mark = _fingerprint(e)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        large = (spread_join(both.where(F.col("v") > F.col("u")), low.select("u", F.least("u", "m").alias("m"), "n"), "u", "n")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        large = materialise(large, "edges")
        low2 = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (spread_join(large, low2, "hi", "n").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(low2.select("hi", F.col("m").alias("lo"))).distinct())
        e = materialise(small, "edges")
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    found = e.select(F.col("hi").alias(node), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias(node), F.col("lo").alias("component")).distinct())
    if nodes is None:
        return found
    return (nodes.select(node).join(found, node, "left")
            .select(node, F.coalesce("component", node).alias("component")))


def link_groups(df: DataFrame, keys: list[str], key: str = "image_id") -> DataFrame:
    """Adds ``group_id``: rows that share a non-blank value of any of ``keys``, directly or through others."""
    edges = None
    for c in keys:
        star = star_edges(df.where(F.col(c) != "").select(c, key), c, key)
        edges = star if edges is None else edges.unionByName(star)
    comp = components(edges).withColumnsRenamed({"node": key, "component": "_root"})
    return df.join(comp, key, "left").withColumn("group_id", F.concat(F.lit("g"), F.coalesce("_root", key))).drop("_root")


def decide_clusters(df: DataFrame, clusters: DataFrame, key: str = "image_id") -> DataFrame:
    """Adds ``dup_cluster`` (blank for a single row) and ``action``: keep, cluster, or exclude_label_conflict for every
    member of a cluster whose labels differ. ``clusters`` has (key, component)."""
    rows = df.join(clusters.select(key, "component"), key)
    facts = (rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), (F.min("label") != F.max("label")).alias("_conflict"))
             .where("_n > 1"))
    return (spread_join(rows, facts, "component", "_n", keep_all=True)
            .withColumn("dup_cluster", F.when(F.col("_n") > 1, F.concat(F.lit("dup"), F.col("component"))).otherwise(""))
            .withColumn("action", F.when(F.col("_n").isNull(), "keep").when(F.col("_conflict"), "exclude_label_conflict")
                        .otherwise("cluster")).drop("component", "_n", "_conflict"))


def decide_copies(df: DataFrame, digest: str = "sha256", key: str = "image_id") -> DataFrame:
    """The same for clusters of equal digests (text or bytes), whose rows meet nothing but the facts of their digest. A blank
    digest makes no copy. A row is sent with its digest once: as the key that it meets the facts by."""
    kind = dict(df.dtypes)[digest]
    blank = F.coalesce(F.length(digest), F.lit(0)) == 0
    same = F.when(blank, F.concat(F.lit("="), F.col(key)).cast(kind)).otherwise(F.col(digest))
    rows = df.withColumns({"_same": same, "_blank": blank, digest: F.when(blank, F.col(digest))})
    facts = (rows.groupBy("_same").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_root"), (F.min("label") != F.max("label")).alias("_conflict"))
             .where("_n > 1"))
    return (spread_join(rows, facts, "_same", "_n", keep_all=True)
            .withColumn("dup_cluster", F.when(F.col("_n") > 1, F.concat(F.lit("dup"), F.col("_root"))).otherwise(""))
            .withColumn("action", F.when(F.col("_n").isNull(), "keep").when(F.col("_conflict"), "exclude_label_conflict")
                        .otherwise("cluster"))
            .withColumn(digest, F.when(F.col("_blank"), F.col(digest)).otherwise(F.col("_same")))
            .select(*df.columns, "dup_cluster", "action"))


def isolate_test(df: DataFrame, test_sources: list[str]) -> DataFrame:
    """Drops development rows whose group touches a test source; test rows stay. Adds ``is_test``."""
    rows = df.withColumn("is_test", F.col("source").isin(test_sources))
    dev = rows.where("not is_test")
    touched = (rows.groupBy("group_id").agg(F.count_if(~F.col("is_test")).alias("_n"), F.max("is_test").alias("_touched"))
               .where("_touched and _n > 0"))
    free = spread_join(dev, touched, "group_id", "_n", keep_all=True).where(F.col("_touched").isNull())
    return rows.where("is_test").unionByName(free.select(*rows.columns))
