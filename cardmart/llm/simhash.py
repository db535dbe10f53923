"""SimHash near-dedup with a Gray-order hierarchical index.

The distinct fingerprints are the index: sorted by Gray rank, where neighbours share long bit patterns, under a tree. The bits on
which all fingerprints below a node agree stand in that node; what its parent has already is factored out, so a
node holds a residual mask and pattern. Batches of neighbouring fingerprints are the queries. They descend from the root,
their differences from each node's residual pattern add up on the way, and where the sum exceeds three the node is pruned
with all that is below it. So is a node that is known to be of the batch's own component: a search links a spanning
forest, never all pairs, and a crowd of near copies costs no more for being one.

The index is range-partitioned for the cluster: with N fingerprints, about log2(N / GROUP) bits of each serve as the range.
Fingerprints that differ in at most three bits agree on one of four disjoint sets of bits (beyond sixteen bits: on two of
five), so each is in as many ranges as there are sets, and near ones meet in one of them. A range with
more than BIG fingerprints is split again by four sets of its remaining bits, for the same reason without loss, twice at most.
Equal fingerprints are one from the start.

Defined results: null text counts as the empty text; texts without words have fingerprint zero and link
like any other; with one or two words the whole sequence is the only shingle; very long texts are read whole; rows with a null doc_id
belong to a component but name it only (with null) where no row has a doc_id; repeated rows repeat in the result, and
keep_one() keeps one row of each component, whether or not its doc_id is null or repeats; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import FILE, PLACE, discard, identified, only, stored

SEED = 42
#: Fingerprints that a range of the index holds on average, and above which it is split.
GROUP, BIG = 2048, 1 << 18
#: Fingerprints of a leaf, nodes under a node, leaves that are searched for at once.
LEAF, FAN, BATCH = 8, 8, 512


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's shingles."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the row's name where there is one, and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.int64()) for c in names), pa.array(fps, pa.int64())], names=[*names, "fp"])

    named = [c for c in (FILE, PLACE) if c in docs.columns]
    return docs.select("doc_id", *named, "text").mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *named, "fp")))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Fingerprints in Gray order under a tree of shared bit patterns; levels[0] are the leaves.

    Each level has the residual masks of its nodes (the bits on which all below a node agree and that its
    parent does not hold) and the values of these bits.
    """

    def __init__(self, fps: np.ndarray):
        """fps: sorted by gray_rank()."""
        self.fps, self.met, self.pruned = fps, 0, 0
        whole: list[tuple[np.ndarray, np.ndarray]] = []
        ones, zeros, size = fps, ~fps, LEAF
        while not whole or len(ones) > 1:
            cut = np.arange(0, len(ones), size)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            whole.append((ones | zeros, ones))
            size = FAN
        self.leaves = whole[0]  # all bits on which the fingerprints of a leaf agree
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for (mask, value), above in zip(whole, [*whole[1:], None], strict=True):
            held = np.repeat(above[0], FAN)[: len(mask)] if above else np.zeros(1, np.uint64)
            self.levels.append((mask & ~held, value & ~held))

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """Level by level, the label that all below a node have, or -1."""
        low, high, out, size = label, label, [], LEAF
        for _ in self.levels:
            cut = np.arange(0, len(low), size)
            low, high, size = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), FAN
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, first: int, last: int, most: int, same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Leaves first .. last - 1 with the leaves up to each that may hold fingerprints at most so many bits away."""
        batch = np.arange(first, last)
        mask, value = self.leaves[0][batch], self.leaves[1][batch]
        query, node, apart = np.arange(len(batch)), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            residual, pattern = self.levels[depth]
            apart = apart + np.bitwise_count((value[query] ^ pattern[node]) & residual[node] & mask[query])
            known = same[depth][node]
            keep = (apart <= most) & ((known < 0) | (known != same[0][batch[query]]))
            self.met += len(keep)
            self.pruned += int(len(keep) - keep.sum())
            query, node, apart = query[keep], node[keep], apart[keep]
            if depth:
                n = len(self.levels[depth - 1][0])
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, apart = np.repeat(query, FAN), np.repeat(apart, FAN)
                ok = (node < n) & (node * FAN ** (depth - 1) <= batch[query])
                query, node, apart = query[ok], node[ok], apart[ok]
        return batch[query], node


def _union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the smallest position of its set) after linking the positions x and y."""
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(fps: np.ndarray, most: int, index: GrayIndex | None = None) -> np.ndarray:
    """For fingerprints in Gray order, the position of the first one of each one's linked set."""
    index = index or GrayIndex(fps)
    n, label = len(fps), np.arange(len(fps))
    for turn in range(0, 64, 8):  # neighbours in Gray order, whichever bits lead, come first: what they link need not be searched
        order = np.argsort(gray_rank(fps << np.uint64(turn) | fps >> np.uint64(64 - turn))) if turn else np.arange(n)
        turned = fps[order]
        for d in range(1, min(LEAF, n)):
            near = np.flatnonzero(np.bitwise_count(turned[:-d] ^ turned[d:]) <= most)
            label = _union(label, order[near], order[near + d])
    same, step = index.uniform(label), np.arange(LEAF)
    for first in range(0, -(-n // LEAF), BATCH):
        a, b = index.search(first, min(first + BATCH, -(-n // LEAF)), most, same)
        before = label.copy()
        for k in range(0, len(a), 1 << 14):
            x, y = (np.minimum(side[k : k + (1 << 14), None] * LEAF + step, n - 1) for side in (a, b))
            i, p, q = np.nonzero(np.bitwise_count(fps[x][:, :, None] ^ fps[y][:, None, :]) <= most)
            label = _union(label, x[i, p], y[i, q])
        if (label != before).any():
            same = index.uniform(label)
    return label


def group_links(most: int):
    """Links of a spanning forest of each group, for batches whose groups are together."""

    def links(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fps), key))
        key, fps = key[order], fps[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        label = np.arange(len(key))
        small = np.repeat(size <= LEAF, size)
        xs, ys = [], []
        for d in range(1, min(LEAF, int(size.max()) if len(size) else 0)):  # groups of one leaf, all at once
            near = np.flatnonzero(small[:-d] & (key[:-d] == key[d:]))
            near = near[np.bitwise_count(fps[near] ^ fps[near + d]) <= most]
            xs.append(near)
            ys.append(near + d)
        if xs:
            label = _union(label, np.concatenate(xs), np.concatenate(ys))
        for s, n in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            label[s : s + n] = forest(fps[s : s + n], most) + s
        own = np.flatnonzero(label != np.arange(len(label)))
        pair = np.unique(np.stack([fps[own], fps[label[own]]], axis=1), axis=0).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate((key, batch.column("g").to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = np.searchsorted(key, key[-1]) if len(key) else 0  # the last group may go on in the next batch
            if whole:
                yield links(key[:whole], fps[:whole])
                key, fps = key[whole:], fps[whole:]
        if len(key):
            yield links(key, fps)

    return run


def _bits(first: int, n: int) -> int:
    return ((1 << n) - 1) << first


def ranges(bits: int) -> list[int]:
    """Masks of the sets of bits that name a fingerprint's ranges: fingerprints at most three bits apart agree on one of them."""
    if bits <= 0:
        return [0]
    if bits <= 16:
        return [_bits(16 * k + 16 - bits, bits) for k in range(4)]
    half = min(-(-bits // 2), 12)
    fifths = [_bits(start + 12 - half, half) for start in (0, 13, 26, 39, 52)]
    return [x | y for x, y in combinations(fifths, 2)]


def narrower(mask: int) -> list[int]:
    """Four masks that add disjoint sets of at most eight of its free bits to a mask."""
    free = [k for k in range(63, -1, -1) if not mask >> k & 1]
    n = len(free) // 4
    return [mask | sum(1 << k for k in free[s * n : s * n + min(n, 8)]) for s in range(4)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _in_ranges(masks: list[int], offset: int = 0) -> Column:
    """A fingerprint's ranges: number of the mask and the bits under it."""
    return F.array(*(F.struct(F.lit(offset + k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)))


def partitioned(nodes: DataFrame, group: int = GROUP, big: int = BIG) -> DataFrame:
    """fp, mask, bits: the distinct fingerprints in each of their ranges of the index."""
    n = nodes.count()
    masks = ranges((-(-n // group) - 1).bit_length())
    names = ["mask", "bits"]
    ready, open_ = [], nodes.select("fp", F.explode(_in_ranges(masks)).alias("r")).select("fp", "r.mask", "r.bits")
    offset = 0
    for _ in range(2):
        crowded = stored(open_.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > big).select(*names), "crowded-ranges")
        if crowded.isEmpty():
            break
        ready.append(open_.join(crowded, names, "left_anti").select("fp", *names))
        deeper = [narrower(m) for m in masks]
        split = F.array(*(_in_ranges(four, offset + len(masks) + 4 * k) for k, four in enumerate(deeper)))
        inner = open_.join(crowded, names, "left_semi").select("fp", F.explode(F.get(split, F.col("mask") - offset)).alias("r"))
        open_, masks, offset = inner.select("fp", "r.mask", "r.bits"), [m for four in deeper for m in four], offset + len(masks)
    return reduce(DataFrame.unionByName, [*ready, open_])


def near_links(nodes: DataFrame, most: int = 3, group: int = GROUP, big: int = BIG) -> DataFrame:
    """a, b: links whose components are those of all pairs of fingerprints (column fp, distinct) at most three bits apart."""
    if not 0 <= most <= 3:
        raise ValueError("the ranges serve at most three differing bits")
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partitioned(nodes, group, big).select("fp", F.xxhash64("mask", "bits").alias("g"))
    return dealt.repartition(spread, "g").sortWithinPartitions("g").mapInArrow(group_links(most), "a long, b long")


def rooted(rows: DataFrame, most: int) -> DataFrame:
    """fp, node (the smallest doc_id) and root (the component) of each distinct fingerprint."""
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    root = components(near_links(nodes.select("fp"), most)).withColumnRenamed("a", "fp")
    out = stored(nodes.join(root, "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root")), "roots")
    discard(nodes)
    return out


def near_groups(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document."""
    rows = stored(fingerprints(docs), "fingerprints")
    roots = rooted(rows, most)
    names = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = stored(roots.join(names, "root").select("fp", "component_id"), "named")
    discard(roots)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, most: int = 3) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id's, the first such row."""
    docs = identified(docs)
    rows = stored(fingerprints(docs), "fingerprints")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", FILE, PLACE)
    first = stored(rows.groupBy("fp").agg(F.min(name).alias("top")), "first-rows")  # a fingerprint's copies are combined before they move
    roots = rooted(rows, most)
    kept = roots.join(first, "fp").groupBy("root").agg(F.min("top").alias("top")).select(f"top.{FILE}", f"top.{PLACE}")
    out = only(docs, kept)
    for old in (rows, first, roots):
        discard(old)
    return out
