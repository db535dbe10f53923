"""MinHash near-dedup: many universal hash minima, banding, verification by signatures and full sets, star components.

A text's set is its distinct two-word shingles; equal sets are one node from the start, so exact copies cost nothing. MINIMA universal
hashes give a node's signature; BANDS bands of four minima each are its buckets. Two sets at the limit of 0.8 share a bucket with probability
1 - 5e-8. In a bucket every node meets the bucket's leader alone (the node of least hash, mostly the same one in all
buckets of a crowd). Pairs whose signatures agree in less than LEAST of the minima are no candidates (at 0.8 that is 5.6 standard deviations);
the others are confirmed on the full sets: first each node with the leader that it resembles most, then what still joins different
components. Links that run past a leader are found last: buckets whose nodes lie in more than one component compare these
nodes across components, signature by signature, inside a task. Such a bucket above CROWD nodes is dealt anew by bands of eight
minima (SUBBANDS of them keep a pair at 0.8), and what is still above it is cut in blocks that meet two by two, so that no task holds a crowd.

Components come from alternating large-star and small-star steps, joins over written tables.

Defined results: a text with one word has one shingle, that word; a text without words (or null) has an empty set, is linked with
nothing and names its own component; very long texts are read whole; shingles are compared by 64-bit hashes; rows with a null doc_id belong to a component but name it
only (with null) where no row of it has a doc_id; repeated rows repeat in the result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import flat_bytes, mix, row_slices, window_hashes, word_bounds, word_hashes
from .runtime import FILE, PLACE, discard, identified, stored

MINIMA, BANDS, PER_BAND = 128, 32, 4
#: Bands of eight minima for crowded buckets, nodes of a bucket above which it is dealt anew, share of minima below which a pair is no candidate.
SUBBANDS, PER_SUBBAND, CROWD, LEAST = 104, 8, 4096, 0.6
#: Shingles of a cluster's block at most.
SHINGLES = 1 << 22
#: Bytes of text that are hashed at once, and shingles whose minima are taken at once.
BYTES, STRETCH = 4 << 20, 1 << 13
_RANDOM = np.random.default_rng(11)
#: The universal family x -> (a x + b mod 2^64) / 2^32 with odd a.
A = _RANDOM.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
B = _RANDOM.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_SUBSETS = np.array([_RANDOM.choice(MINIMA, PER_SUBBAND, replace=False) for _ in range(SUBBANDS)])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = flat_bytes(texts)
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    pairs = window_hashes(words, 2)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(pairs[a : b - 1]) if b - a > 1 else mix(words[a:b]))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set that is not empty."""
    out = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(shingles), STRETCH):
        x = shingles[None, k : k + STRETCH] * A[:, None]
        x += B[:, None]
        out = np.minimum(out, (x >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, FILE, PLACE, n (the size of the set), digest (16 bytes of the set, null if it is empty) and minima of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in row_slices(batch.column("text"), BYTES):
                part = batch.slice(at, n)
                sets = shingle_sets(part.column("text"))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                minima = [signature(s).astype("<u4").tobytes() if len(s) else None for s in sets]
                columns = [part.column("doc_id").cast(pa.int64()), part.column(FILE), part.column(PLACE), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(minima, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", FILE, PLACE, "n", "digest", "minima"])

    return docs.select("doc_id", FILE, PLACE, "text").mapInArrow(run, f"doc_id long, {FILE} long, {PLACE} long, n long, digest binary, minima binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """node and its sorted shingles; docs: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in row_slices(batch.column("text"), BYTES):
                part = batch.slice(at, n)
                sets = shingle_sets(part.column("text"))
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, MINIMA)


def _keys(minima: np.ndarray, subsets: np.ndarray) -> np.ndarray:
    """A hash of the minima of each subset: a row per signature, a column per subset."""
    out = np.repeat(np.arange(1, len(subsets) + 1, dtype=np.uint64)[None, :], len(minima), axis=0)
    for k in range(subsets.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + minima[:, subsets[:, k]])
    return out.view(np.int64)


def buckets(nodes: DataFrame, subsets: np.ndarray) -> DataFrame:
    """key and node, a row per subset of the minima. nodes: node, minima, and a key to start from if they have one."""
    keyed = "key" in nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 4096) for b in batches for k in range(0, b.num_rows, 4096)):
            key = _keys(_matrix(batch.column("minima")), subsets)
            if keyed:
                key = mix(key.view(np.uint64) ^ batch.column("key").to_numpy().view(np.uint64)[:, None]).view(np.int64)
            node = np.repeat(batch.column("node").to_numpy(), len(subsets))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "minima", *(["key"] if keyed else [])).mapInArrow(run, "key long, node long")


def led(rows: DataFrame) -> DataFrame:
    """a, b: each node of a bucket with the bucket's leader, each pair once."""
    first = F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("first")
    leaders = rows.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.node").alias("a"))
    return rows.join(leaders, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and est (the share of equal minima) of the pairs that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            est = (_matrix(batch.column("x")) == _matrix(batch.column("y"))).mean(axis=1)
            keep = np.flatnonzero(est >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(est[keep])], names=["a", "b", "est"])

    left, right = (nodes.select(F.col("node").alias(c), F.col("minima").alias(m), F.col("n").alias(f"n_{c}")) for c, m in (("a", "x"), ("b", "y")))
    near = 100 * F.least("n_a", "n_b") >= 80 * F.greatest("n_a", "n_b")
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(near).select("a", "b", "x", "y").mapInArrow(run, "a long, b long, est double")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are at least 0.8 alike."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(100 * both >= 80 * (F.size("x") + F.size("y") - both)).select("a", "b")


def stars(edges: DataFrame) -> DataFrame:
    """a, root for each vertex that is not the smallest of its component, by alternating large-star and small-star. edges: a, b in any order."""
    edge = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large-star: a vertex's larger neighbours go to the least of it and its neighbours
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        # small-star: a vertex and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(edge)
        discard(large)
        edge = small
        # done where each vertex has one parent, which has none
        twice = edge.groupBy("a").count().where("count > 1").select("a")
        deep = edge.join(edge.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
        if twice.unionByName(deep).isEmpty():
            return edge.select("a", F.col("b").alias("root"))


def _alike(k: int, minima: np.ndarray, label: np.ndarray, block: np.ndarray, outer: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after k of other labels whose signatures share so many minima with k's, and how many; in a group of two blocks those of the other block."""
    rest = np.flatnonzero((label[k + 1 :] != label[k]) & ((block[k + 1 :] != block[k]) | (not outer))) + k + 1
    same = (minima[rest] == minima[k]).sum(axis=1)
    return rest[same >= least], same[same >= least]


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    node, comp, block = (table.column(c).to_numpy() for c in ("node", "comp", "block"))
    return node, comp, block, np.concatenate([_matrix(c) for c in table.column("minima").chunks]), table.column("i")[0] != table.column("j")[0]


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def forest(least: int):
    """Of a bucket's nodes that are alike across components, pairs (a, b) that connect them."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, block, minima, outer = _group(table)
        tree, found = np.arange(len(node)), []
        for k in range(len(node)):
            for x in _alike(k, minima, comp, block, outer, least)[0]:
                if tree[x] != tree[k]:
                    found.append((node[k], node[x]))
                    tree[tree == tree[x]] = tree[k]
        return _pairs(found)

    return run


def linking(least: int):
    """Links (a, b) between the components of a cluster's nodes, confirmed on their full sets; those that follow from the others are left out."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, block, minima, outer = _group(table)
        label = np.unique(comp, return_inverse=True)[1]
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("shingles")]  # sorted as unsigned numbers
        found = []
        for k in range(len(node)):
            near, same = _alike(k, minima, label, block, outer, least)
            for x in near[np.argsort(-same, kind="stable")]:
                if label[x] == label[k]:
                    continue
                a, b = (sets[k], sets[x]) if len(sets[k]) >= len(sets[x]) else (sets[x], sets[k])
                if 100 * len(b) < 80 * len(a):
                    continue
                both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    found.append((node[k], node[x]))
                    label[label == label[x]] = label[k]
        return _pairs(found)

    return run


def blocked(rows: DataFrame) -> DataFrame:
    """Rows with block, i and j: each block of a group meets each (blocks: how many a group has; most have one)."""
    blocks = F.col("blocks").cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def divided(rows: DataFrame, root: DataFrame) -> DataFrame:
    """key, node, comp and size of the buckets whose nodes lie in several components."""
    held = rows.join(root.select(F.col("a").alias("node"), "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    held = stored(held, "buckets")
    several = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
    out = stored(held.join(several, "key"), "divided")
    discard(held)
    return out


def past_leaders(rows: DataFrame, nodes: DataFrame, root: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: pairs that connect the nodes which are alike across components in some bucket."""
    minima = nodes.select("node", "minima")
    open_ = divided(rows, root)
    few = open_.where(F.col("size") <= crowd).withColumn("blocks", F.lit(1).cast("long"))
    many = open_.where(F.col("size") > crowd)
    if not many.isEmpty():
        again = divided(buckets(many.select("key", "node").join(minima, "node"), _SUBSETS).distinct(), root)
        few = few.unionByName(again.withColumn("blocks", F.ceil(F.col("size") / crowd)))
    grouped = blocked(few.select("key", "node", "comp", "blocks")).join(minima, "node").groupBy("key", "i", "j")
    return grouped.applyInArrow(forest(int(np.ceil(LEAST * MINIMA))), "a long, b long").distinct()


def cluster_links(trees: DataFrame, nodes: DataFrame, root: DataFrame, sets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links between components within each cluster. trees: a, root of the clusters' nodes."""
    members = trees.select(F.col("a").alias("node"), F.col("root").alias("cluster")).unionByName(trees.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    known = members.join(nodes.select("node", "n", "minima"), "node").join(root.select(F.col("a").alias("node"), F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = stored(known, "clusters")
    size = known.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / crowd, F.sum("n") / SHINGLES)).alias("blocks"))
    dealt = blocked(known.join(size, "cluster").select("cluster", "node", "comp", "minima", "blocks")).join(sets, "node")
    out = stored(dealt.groupBy("cluster", "i", "j").applyInArrow(linking(int(np.ceil(LEAST * MINIMA))), "a long, b long"), "cluster-links")
    discard(known)
    return out


def linked(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (described, written), nodes (node, digest, doc_id, ...; written) and a, root of the nodes that are not their component's first."""
    docs = identified(docs)
    rows = stored(described(docs), "sets")
    first = F.min(F.struct(FILE, PLACE)).alias("name")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), first, F.first("n").alias("n"), F.first("minima").alias("minima"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "doc_id", f"name.{FILE}", f"name.{PLACE}", "n", "minima"), "nodes")
    bands = stored(buckets(nodes, np.arange(BANDS * PER_BAND).reshape(BANDS, PER_BAND)), "bands")
    pairs = stored(alike(led(bands), nodes), "pairs")
    made = []

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = some.select(F.explode(F.array(*some.columns[:2])).alias("node")).distinct()
        named = nodes.join(wanted, "node", "left_semi").select("node", F.col(FILE).alias("f"), F.col(PLACE).alias("p"))
        found = docs.join(named.hint("merge"), (F.col(FILE) == F.col("f")) & (F.col(PLACE) == F.col("p")))  # grows with the documents: never broadcast
        made.append(stored(full_sets(found), "full-sets"))
        return made[-1]

    def roots(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
        old = [before.select("a", F.col("root").alias("b"))] if before is not None else []
        return stars(edges.unionByName(*old) if old else edges)

    def open_pairs(some: DataFrame, root: DataFrame) -> DataFrame:
        at = [root.select(F.col("a").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        return some.join(at[0], "a", "left").join(at[1], "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    sets = sets_of(pairs)
    best = pairs.groupBy("b").agg(F.max(F.struct("est", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    root = roots(confirmed(best, sets))
    rest = stored(open_pairs(pairs, root).join(best, ["a", "b"], "left_anti"), "open-pairs")
    if not rest.isEmpty():
        root = roots(confirmed(rest, sets), root)
    last = stored(past_leaders(bands, nodes, root, crowd), "past-leaders")
    if not last.isEmpty():
        trees = stars(last)
        made += [trees, cluster_links(trees, nodes, root, sets_of(trees), crowd)]
        root = roots(made[-1], root)
    for old in (bands, pairs, rest, last, *made):
        discard(old)
    return rows, nodes, root


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of every document."""
    rows, nodes, root = linked(docs, crowd)
    at = nodes.select("node", "digest", "doc_id").join(root.withColumnRenamed("a", "node"), "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    names = at.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stored(at.select("digest", "root").join(names, "root").select("digest", "component_id"), "named")
    discard(nodes)
    whole = rows.where("digest is not null").select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id")
    empty = rows.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
