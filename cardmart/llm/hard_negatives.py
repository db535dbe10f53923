"""Hard-negative mining by exact inner products over an STR-packed R-tree.

The rows are tiled by sort-tile-recursive: slabs of equal counts along the coordinate that varies most, each cut along the second; at most
TILES tiles, so that their boxes are small whatever the table. A tile is stored in chunks of about ROWS rows (by a
hash of the row, so that any number of equal vectors is spread), packed in the same way along more
coordinates down to leaves. In a node's minimum bounding box each coordinate has an interval, hence the inner product with a query has one.
A best-first queue pops the node with the highest upper bound; boxes outside all of a query's score windows, or
strictly below the kth score that it has, are pruned (equal scores stay: the smaller id may still win).

A chunk's own anchors are its queries. They search their own chunk first, which gives each window a kth score to beat; then the boxes of all tiles
say which chunks they have to see, and there they go in blocks, at most GROUP chunks' queries to a task. What they
find is merged by windows of a few rows per chunk seen. Positives are one such search, negatives a second one with a score window for each positive.

Scores are exact while every sum of products stays below 2^53, else ValueError.
Defined results: rows without label, id, vector, or with a null or non-finite component take no part; shorter vectors count as filled up with zeros;
an empty vector is all zeros; a repeated row is a row of its own, so a copy of the anchor is one of its positives, and repeated anchors
repeat in the result; equal scores come by smaller vec_id; an anchor without another row of its label, or with negative scores alone, has no rows;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, stored

#: Tiles at most, rows of a chunk, rows of a leaf, nodes under a node, chunks whose queries meet a chunk in one task.
TILES, ROWS, LEAF, FAN, GROUP = 4096, 8192, 256, 8, 256
LIMIT = 1 << 53

ROW = "row long, vec_id long, label int, tile int, chunk int, v array<long>"
HITS = "query long, no int, score long, vec_id long, label int, row long"


def cleaned(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (integers) of the rows that take part."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), shifted.cast("int").alias("label"), whole.alias("v"))


def _bucket(x: Column, bounds: list) -> Column:
    """How many bounds lie below x."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x)) if bounds else F.lit(0)


def tiled(rows: DataFrame, size: int = ROWS) -> tuple[DataFrame, list[int], int]:
    """The rows with row, tile and chunk (written), the coordinates from the most varied on, and the number of chunks of each tile as a list."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    spread = (
        rows.select(F.posexplode("v").alias("at", "x"))
        .groupBy("at")
        .agg(F.var_pop("x").alias("var"), F.max(F.abs("x")).alias("most"))
        .orderBy(F.desc("var"), "at")
        .collect()  # a row per coordinate
    )
    n, dims = rows.count(), len(spread)
    if sum(float(r["most"]) ** 2 for r in spread) >= LIMIT:
        raise ValueError("scores of these vectors exceed 2^53")
    axes = [r["at"] for r in spread]
    filled = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    tiles = min(TILES, -(-n // size))
    slabs = math.isqrt(max(tiles - 1, 0)) + 1
    per = -(-tiles // slabs)
    slab, tile = F.lit(0), F.lit(0)
    if tiles > 1 and axes:
        first, second = (F.get("v", F.lit(axes[k])) for k in (0, min(1, dims - 1)))
        cuts = [k / slabs for k in range(1, slabs)]
        bounds = filled.agg(F.percentile_approx(first, cuts, 10_000).alias("b")).first()["b"] if cuts else []
        slab = _bucket(first, bounds)
        cuts = [k / per for k in range(1, per)]
        inner = {}
        if cuts:
            inner = {r["slab"]: r["b"] for r in filled.groupBy(slab.alias("slab")).agg(F.percentile_approx(second, cuts, 10_000).alias("b")).collect()}
        table = F.array(*(F.array(*(F.lit(b).cast("long") for b in inner.get(k, [0] * len(cuts)))) for k in range(slabs))) if cuts else None
        within = F.size(F.filter(F.get(table, slab), lambda b: b < second)) if cuts else F.lit(0)
        tile = slab * per + within
    placed = filled.withColumn("tile", tile.cast("int"))
    counts = {r["tile"]: r["count"] for r in placed.groupBy("tile").count().collect()}  # TILES rows at most
    chunks = [-(-counts.get(k, 0) // size) for k in range(max(counts, default=-1) + 1)]
    many = F.get(F.array(*map(F.lit, chunks or [1])), F.col("tile"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), many).cast("int"))
    return stored(placed.select("row", "vec_id", "label", "tile", "chunk", "v"), "placed"), axes, chunks


def str_order(v: np.ndarray, axes: list[int], leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which each run of `leaf` is a leaf of an STR-packed tree over these coordinates."""
    out: list[np.ndarray] = []

    def pack(at: np.ndarray, rest: list[int]) -> None:
        leaves = -(-len(at) // leaf)
        if not rest or leaves <= 1:
            out.append(at)
            return
        at = at[np.argsort(v[at, rest[0]], kind="stable")]
        slabs = math.ceil(leaves ** (1 / len(rest)) - 1e-9)
        step = -(-leaves // slabs) * leaf
        for k in range(0, len(at), step):
            pack(at[k : k + step], rest[1:])

    pack(np.arange(len(v)), axes)
    return np.concatenate(out)


class Tree:
    """Rows in packed order under levels of boxes; levels[0] are the leaves."""

    def __init__(self, v: np.ndarray, vec_id: np.ndarray, label: np.ndarray, row: np.ndarray):
        """Sums of products of v stay below 2^53, so that doubles hold them exactly."""
        self.v, self.vec_id, self.label, self.row = v.astype(float), vec_id, label, row
        low, high, size = self.v, self.v, LEAF
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while not self.levels or len(low) > 1:
            cut = np.arange(0, len(low), size)
            low, high, size = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), FAN
            self.levels.append((low, high))
        self.met = self.read = 0

    def best(self, q: np.ndarray, label: int, same: bool, own: int, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple]]:
        """For each score window [low, high], its k best rows of the same (or another) label, not below its floor: (-score, vec_id, row, place)."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        least = np.maximum(low, floor)  # what a window's rows have to reach
        found: list[list[tuple]] = [[] for _ in low]

        def push(level: int, a: int, b: int) -> None:
            lo, hi = (side[a:b] for side in self.levels[level])
            top, bottom = hi @ up + lo @ down, lo @ up + hi @ down
            self.met += b - a
            for n in np.flatnonzero(((top[:, None] >= least) & (bottom[:, None] <= high)).any(axis=1)).tolist():
                heapq.heappush(heap, (-top[n], level, a + n, bottom[n]))

        heap: list[tuple] = []
        push(len(self.levels) - 1, 0, 1)
        while heap:
            top, level, node, bottom = heapq.heappop(heap)
            if -top < least.min():
                break
            if not ((-top >= least) & (bottom <= high)).any():
                continue
            if level:
                push(level - 1, node * FAN, min(node * FAN + FAN, len(self.levels[level - 1][0])))
                continue
            self.read += 1
            a = node * LEAF
            scores = self.v[a : a + LEAF] @ q
            fits = ((self.label[a : a + LEAF] == label) == same) & (self.row[a : a + LEAF] != own)
            near = np.flatnonzero(fits & (scores >= least.min()) & (scores <= high.max()))
            for w in np.flatnonzero(-top >= least).tolist() if len(near) else ():
                places = near[(scores[near] >= least[w]) & (scores[near] <= high[w])]
                if len(places) > k:  # the k best and what equals the last of them
                    places = places[scores[places] >= np.partition(scores[places], -k)[-k]]
                if len(places):
                    new = [(-int(scores[p]), int(self.vec_id[a + p]), int(self.row[a + p]), a + int(p)) for p in places]
                    found[w] = heapq.nsmallest(k, found[w] + new)
                    if len(found[w]) == k:
                        least[w] = max(least[w], -found[w][-1][0])
        return found


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, np.int64)])
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


PACKED = "tile int, chunk int, n int, row binary, vec_id binary, label binary, v binary"


def packed(rows: DataFrame, axes: list[int]) -> DataFrame:
    """The index: a row per chunk, its rows in packed order as little-endian arrays."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"), table.num_rows)
        order = str_order(v, axes[:4])
        arrays = [table.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("row", "vec_id", "label")]
        values = [[key[0].as_py()], [key[1].as_py()], [table.num_rows], *([x] for x in arrays), [v[order].astype("<i8").tobytes()]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(values, kinds, strict=True)], names=["tile", "chunk", "n", "row", "vec_id", "label", "v"])

    return rows.groupBy("tile", "chunk").applyInArrow(run, PACKED)


def _tree(table: pa.Table) -> Tree:
    x = table.slice(0, 1).to_pylist()[0]
    row, vec_id, label, v = (np.frombuffer(x[c], "<i8") for c in ("row", "vec_id", "label", "v"))
    return Tree(v.reshape(x["n"], -1), vec_id, label, row)


#: Queries of a chunk: who asks, the window's number, bounds and floor, and the vectors in the order of the queries.
QUERIES = "tile int, chunk int, query binary, label binary, no binary, low binary, high binary, floor binary, v binary, targets array<int>, hits array<struct<query:long,no:int,score:long,vec_id:long,label:int,row:long>>"
_PARTS = ("query", "label", "no", "low", "high", "floor")


def _answer(tree: Tree, query: np.ndarray, label: np.ndarray, no: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, v: np.ndarray, same: bool, k: int) -> list[dict]:
    """Hits of all queries; the windows of one query stand together."""
    out = []
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(query)], strict=True):
        found = tree.best(v[a].astype(float), int(label[a]), same, int(query[a]), low[a:b].copy(), high[a:b], floor[a:b], k)
        for w, hits in enumerate(found, a):
            out += [{"query": int(query[a]), "no": int(no[w]), "score": -s, "vec_id": i, "label": int(tree.label[p]), "row": r} for s, i, r, p in hits]
    return out


def search(index: DataFrame, asked: DataFrame, chunks: list[int], same: bool, k: int) -> DataFrame:
    """query, no, score, vec_id, label, row, rank (from 1): for each window its k best rows of the same or another label.

    asked: tile, chunk, query (a row of that chunk), no, low, high.
    """
    spark = index.sparkSession
    boxes = index.groupBy("tile").applyInArrow(_box, "tile int, low array<long>, high array<long>").toArrow()  # TILES rows at most
    box = spark.sparkContext.broadcast((boxes.column("tile").to_numpy(), *(_matrix(boxes.column(c), boxes.num_rows).astype(float) for c in ("low", "high"))))

    def at_home(_key: tuple, held: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = pa.schema([*(pa.field(n, pa.int32()) for n in ("tile", "chunk")), *(pa.field(n, pa.binary()) for n in (*_PARTS, "v")), pa.field("targets", pa.list_(pa.int32())), pa.field("hits", pa.list_(_HIT))])
        if not held.num_rows or not wanted.num_rows:
            return empty.empty_table()
        tree = _tree(held)
        wanted = wanted.sort_by([("query", "ascending"), ("no", "ascending")])
        query, no, low, high = (wanted.column(c).to_numpy() for c in ("query", "no", "low", "high"))
        low, high = low.astype(float), high.astype(float)
        order = np.argsort(tree.row)
        at = order[np.searchsorted(tree.row, query, sorter=order)]
        v, label, floor = tree.v[at], tree.label[at], low.copy()
        hits = _answer(tree, query, label, no, low, high, floor, v, same, k)
        seen: dict[tuple, list[int]] = {}
        for h in hits:
            seen.setdefault((h["query"], h["no"]), []).append(h["score"])
        for w, name in enumerate(zip(query.tolist(), no.tolist(), strict=True)):
            if len(got := seen.get(name, ())) == k:
                floor[w] = max(floor[w], min(got))
        tile, lo, hi = box.value
        up, down = np.maximum(v, 0), np.minimum(v, 0)
        reach = ((up @ hi.T + down @ lo.T >= np.maximum(low, floor)[:, None]) & (up @ lo.T + down @ hi.T <= high[:, None])).any(axis=0)
        first = held.slice(0, 1).to_pylist()[0]
        parts = [x.astype(t).tobytes() for x, t in zip((query, label, no, low, high, floor, v), ("<i8", "<i8", "<i8", "<f8", "<f8", "<f8", "<f8"), strict=True)]
        values = [[first["tile"]], [first["chunk"]], *([x] for x in parts), [tile[reach].tolist()], [hits]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(values, empty, strict=True)], schema=empty)

    def away(_key: tuple, held: pa.Table, guests: pa.Table) -> pa.Table:
        hits: list[dict] = []
        if held.num_rows:
            tree = _tree(held)
            for x in guests.to_pylist():
                parts = [np.frombuffer(x[c], "<i8" if c in ("query", "label", "no") else "<f8") for c in _PARTS]
                v = np.frombuffer(x["v"], "<f8").reshape(len(parts[0]), -1)
                hits += _answer(tree, *parts, v, same, k)
        return pa.Table.from_pylist(hits, pa.schema(list(_HIT)))

    home = stored(index.groupBy("tile", "chunk").cogroup(asked.groupBy("tile", "chunk")).applyInArrow(at_home, QUERIES), "queries")
    # queries in blocks against the chunks that they have to see
    blocks = -(-max(sum(chunks), 1) // GROUP)
    many = F.array(*map(F.lit, chunks or [0]))
    guests = (
        home.select(*_PARTS, "v", F.col("tile").alias("own_tile"), F.col("chunk").alias("own_chunk"), F.explode("targets").alias("tile"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(many, F.col("tile")) - 1)))
        .where((F.col("tile") != F.col("own_tile")) | (F.col("chunk") != F.col("own_chunk")))
        .withColumn("block", F.pmod(F.xxhash64("own_tile", "own_chunk"), F.lit(blocks)).cast("int"))
        .drop("own_tile", "own_chunk")
    )
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    name = ["tile", "chunk", "block"]
    others = held.groupBy(*name).cogroup(guests.groupBy(*name)).applyInArrow(away, HITS)
    hits = home.select(F.explode("hits").alias("h")).select("h.*").unionByName(others)
    order = Window.partitionBy("query", "no").orderBy(F.desc("score"), "vec_id", "row")
    out = stored(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "hits")
    discard(home)
    return out


_HIT = pa.struct([("query", pa.int64()), ("no", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("row", pa.int64())])


def _box(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The box of a tile, chunk by chunk."""
    low = high = None
    for batch in batches:
        for x in batch.select(["n", "v"]).to_pylist():
            v = np.frombuffer(x["v"], "<i8").reshape(x["n"], -1)
            least, most = v.min(axis=0), v.max(axis=0)
            low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["tile", "low", "high"])


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, size: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id is divisible by `every`."""
    placed, axes, chunks = tiled(cleaned(rows), size)
    index = stored(packed(placed, axes), "tree")
    far = float(LIMIT)
    anchors = placed.where(F.col("vec_id") % every == 0)
    everything = anchors.select("tile", "chunk", F.col("row").alias("query"), F.lit(0).alias("no"), F.lit(-far).alias("low"), F.lit(far).alias("high"))
    near = search(index, everything, chunks, True, positives)
    # half a positive's score up to 95 of its hundredths
    score = F.col("score")
    bounds = [F.expr("(50 * score + 99) div 100").cast("double").alias("low"), F.expr("95 * score div 100").cast("double").alias("high")]
    asked = anchors.select("tile", "chunk", F.col("row").alias("query")).join(near.where(score >= 0).select("query", "rank", "score"), "query")
    hard = search(index, asked.select("tile", "chunk", "query", F.col("rank").alias("no"), *bounds), chunks, False, negatives)
    known = anchors.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id")).join(near.select("query", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "query")
    out = stored(
        known.join(hard.select("query", "no", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["query", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
        "negatives",
    )
    for old in (placed, index, near, hard):
        discard(old)
    return out
