"""Substring dedup: words inside a run of words that also starts elsewhere are removed.

First pass: each window of `size` words has an anchor, the gram of half its length with the least hash
inside it. Equal windows have equal anchors at the same place, so the count of its anchor never
understates a window's count. Every task counts its anchors in a count-min sketch and gives its cells,
sparse and in blocks; the blocks are merged into the cells with a count of two or more. An anchor's hash
names its block, and both of its cells lie there. The sketch grows with the text, about seven bytes a cell.
Up to 2^max_bits cells in each of its two rows are broadcast (2^max_bits / 4 bytes); a larger sketch stays
where it was merged, in blocks of at most 2^SHARD cells, and each block is sent the anchors that it can tell about.

Second pass: only windows whose anchor is estimated repeated are grouped, exactly, by the hashes of
anchor and window (128 bits together). A row holds all windows of one anchor at one place, and windows that
recur within a few megabytes of text are settled there, so windows inside a passage that a third of all
documents share are one row per such stretch. An anchor with more than MANY windows is first settled in
parts of its rows, each of which passes on one row for each different window. Windows across the edges of
a shared passage differ from document to document and have its anchor all the same, so what is left is
dealt out by the windows' hashes: equal windows still meet, and no task holds such an anchor whole. What the
sketch overestimates is found out here, and nothing is lost.

Defined results: null text has no words; texts shorter than a window lose nothing; in rows that repeat
a document every window recurs; very long texts are read whole, one at a time; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BASE, flat_bytes, mix, row_slices, window_hashes, word_bounds, word_hashes
from .runtime import discard, stored

SIZE = 35
#: Cells of a block of the sketch (as a power of two) while it is broadcast and beyond, bytes of text handled at once, anchors kept before their cells are given out.
BLOCK, SHARD, STRETCH, HELD = 20, 26, 5 << 20, 1 << 20
#: Windows of an anchor above which it is dealt out, and the most such anchors (beyond, only those with a larger share of all windows are).
MANY, SPLIT = 1 << 12, 1 << 16


class Windows:
    """Anchors and windows of a stretch of rows."""

    def __init__(self, column: pa.Array, size: int, full: bool):
        data, offsets = flat_bytes(column)
        starts, ends, self.first = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        self.size, self.gram = size, (size + 1) // 2
        reach = size - self.gram + 1  # places of a gram inside a window
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        grams = window_hashes(words, self.gram)
        n = len(words) - size + 1
        self.start = np.flatnonzero(row[:n] == row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)  # windows inside one row
        if len(self.start):
            least, place = grams[:n].copy(), np.zeros(n, np.int8)
            for k in range(1, reach):  # the first of equal grams stays
                less = grams[k : k + n] < least
                np.copyto(least, grams[k : k + n], where=less)
                place[less] = k
            at = (np.arange(n) + place)[self.start]
        else:
            at = self.start
        self.opens = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at  # where a new anchor takes over
        self.anchor = grams[at[self.opens]]
        self.row, self.words = row, words
        self.run = np.repeat(np.arange(len(self.opens)), np.diff(np.append(self.opens, len(at)))) if len(at) else at
        if full and len(self.start):
            self.window = window_hashes(mix(words ^ BASE), size)[self.start]


class Sketch(NamedTuple):
    """Width of each row of the sketch and of its blocks, as powers of two, and the merged blocks: the first row's bits, then the second's."""

    bits: int
    block: int
    merged: DataFrame

    def broadcast(self) -> Broadcast:
        width = 1 << (self.block - 2)
        out = np.zeros((1 << (self.bits - self.block), width), np.uint8)
        for r in self.merged.toLocalIterator():
            out[r.block] = np.frombuffer(r.bits, np.uint8)
        return self.merged.sparkSession.sparkContext.broadcast(out)


def block_of(anchor: np.ndarray, bits: int, block: int) -> np.ndarray:
    """Block of each anchor, by mixed bits: anchors are least hashes, so their own high bits are mostly zero."""
    return (mix(anchor ^ BASE) >> np.uint64(64 - bits + block)).astype(np.int64) if bits > block else np.zeros(len(anchor), np.int64)


def cells(anchor: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of an anchor inside its block, in each of the two rows of the sketch."""
    low = np.uint64((1 << block) - 1)
    return (anchor & low).astype(np.int64), (mix(anchor + BASE) & low).astype(np.int64) | np.int64(1 << block)


def repeated(seen: np.ndarray, anchor: np.ndarray, at: np.ndarray | int, block: int) -> np.ndarray:
    """Which anchors the sketch estimates repeated; seen: bits of a block, or of block at of several."""
    out = np.ones(len(anchor), bool)
    for cell in cells(anchor, block):
        bits = seen[at, cell >> 3] if seen.ndim == 2 else seen[cell >> 3]
        out &= (bits >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def _sketch(size: int, bits: int, block: int):
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        anchor = np.concatenate(held)
        at = block_of(anchor, bits, block) << (block + 1)
        cell, count = np.unique(np.concatenate([at | c for c in cells(anchor, block)]), return_counts=True)
        name = cell >> (block + 1)
        packed = (cell & ((1 << (block + 1)) - 1)).astype(np.uint32) | (count > 1).astype(np.uint32) << np.uint32(31)
        cut = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        bounds = np.append(cut, len(cell)) * 4
        values = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(name[cut].astype(np.int32)), values], names=["block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            text = batch.column("text")
            for at, rows in row_slices(text, STRETCH):
                held.append(Windows(text.slice(at, rows), size, False).anchor)
                n += len(held[-1])
                if n > HELD:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _merged(block: int):
    """Bits of the cells with a count of two or more, block by block; the rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, np.zeros(0, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for name, packed in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        yield done()
                    now, count = name, np.zeros(2 << block, np.uint8)
                x = np.frombuffer(packed, np.uint32)
                cell = x & np.uint32((2 << block) - 1)  # each cell at most once in a row
                count[cell] = np.minimum(count[cell] + 1 + (x >> np.uint32(31)).astype(np.uint8), 2)
        if now is not None:
            yield done()

    return run


def sketched(rows: DataFrame, size: int, max_bits: int) -> Sketch:
    """The merged sketch of all anchors of a corpus."""
    spark = rows.sparkSession
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(int(amount / 7).bit_length(), BLOCK)
    block = BLOCK if bits <= max_bits else min(SHARD, max_bits)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select("text").mapInArrow(_sketch(size, bits, block), "block int, cells binary")
    return Sketch(bits, block, parts.repartition(spread, "block").sortWithinPartitions("block").mapInArrow(_merged(block), "block int, bits binary"))


ASKED = "block int, bits binary, key long, anchors binary, keys binary, runs binary"


def _asked(size: int, bits: int, block: int):
    """For each stretch and block its anchors, with the keys of their documents and their numbers there.

    Anchors that recur in the stretch are known to be repeated: for these, rows with a key and numbers alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, key = batch.column("text"), batch.column("key").to_numpy(zero_copy_only=False)
            for at, rows in row_slices(text, STRETCH):
                w = Windows(text.slice(at, rows), size, False)
                if not len(w.anchor):
                    continue
                owner = w.row[w.start[w.opens]]
                number = _numbers(owner)
                _, which, count = np.unique(w.anchor, return_inverse=True, return_counts=True)
                sure = count[which] > 1
                name = block_of(w.anchor, bits, block)
                for here, by in ((np.flatnonzero(sure), owner), (np.flatnonzero(~sure), name)):
                    if not len(here):
                        continue
                    here = here[np.argsort(by[here], kind="stable")]
                    cut = np.flatnonzero(np.append(True, np.diff(by[here]) != 0))
                    bounds = np.append(cut, len(here))

                    def packed(values: np.ndarray, bounds=bounds) -> pa.Array:
                        width = values.itemsize
                        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

                    none = pa.nulls(len(cut), pa.binary())
                    runs, keys = packed(number[here]), key[at : at + rows][owner[here]]
                    columns = [pa.nulls(len(cut), pa.int32()), none, pa.array(keys[cut]), none, none, runs] if by is owner else [pa.array(name[here[cut]].astype(np.int32)), none, pa.nulls(len(cut), pa.int64()), packed(w.anchor[here]), packed(keys), runs]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "bits", "key", "anchors", "keys", "runs"])

    return run


def _numbers(owner: np.ndarray) -> np.ndarray:
    """Number of each anchor in its document; owner: the document of each, in order."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return (np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))).astype(np.int32)


def _told(block: int):
    """Document keys and numbers of the anchors estimated repeated; a block's bits come before what is asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None
        for batch in batches:
            out_key, out_run = [], []
            for name, bits, anchors, keys, runs in zip(*(batch.column(c).to_pylist() for c in ("block", "bits", "anchors", "keys", "runs")), strict=True):
                if bits is not None:
                    now, seen = name, np.frombuffer(bits, np.uint8)
                elif name == now:  # else no cell of the block is repeated
                    hot = repeated(seen, np.frombuffer(anchors, np.uint64), 0, block)
                    out_key.append(np.frombuffer(keys, np.int64)[hot])
                    out_run.append(np.frombuffer(runs, np.int32)[hot])
            if out_key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_run))], names=["key", "run"])

    return run


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("runs")
        size = pc.binary_length(runs).to_numpy(zero_copy_only=False) // 4
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("key").to_numpy(zero_copy_only=False), size)), pa.array(np.frombuffer(b"".join(runs.to_pylist()), np.int32))], names=["key", "run"])


def hot_runs(rows: DataFrame, size: int, sketch: Sketch) -> DataFrame:
    """key and runs: for each document the numbers of its anchors that are estimated repeated, by blocks of the sketch."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = stored(rows.select("key", "text").mapInArrow(_asked(size, sketch.bits, sketch.block), ASKED), "asked")
    bits = sketch.merged.select("block", "bits", *(F.lit(None).cast(t).alias(n) for n, t in (("key", "long"), ("anchors", "binary"), ("keys", "binary"), ("runs", "binary"))))
    both = bits.unionByName(asked.where("key is null")).repartition(spread, "block").sortWithinPartitions("block", F.col("bits").isNull())
    told = both.mapInArrow(_told(sketch.block), "key long, run int").unionByName(asked.where("key is not null").select("key", "runs").mapInArrow(_one_by_one, "key long, run int"))
    out = stored(told.distinct().groupBy("key").agg(F.collect_list("run").alias("runs")), "hot-runs")  # a document's own numbers, few
    discard(asked)
    return out


def _candidates(size: int, bits: int, block: int, sketch: Broadcast | None):
    """Rows of the second pass: anchor, document key, first window, masks of its windows and their hashes.

    take: windows whose hash is in the row; twice: those of them that stand for several places of this
    stretch; known: windows settled here. Without a sketch, column runs has the anchors to take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, key = batch.column("text"), batch.column("key").to_numpy(zero_copy_only=False)
            for at, rows in row_slices(text, STRETCH):
                w = Windows(text.slice(at, rows), size, True)
                if not len(w.start):
                    continue
                if sketch is None:
                    hot = _listed(batch.column("runs").slice(at, rows), w.row[w.start[w.opens]])
                else:
                    hot = repeated(sketch.value, w.anchor, block_of(w.anchor, bits, block), block)
                pick = np.flatnonzero(hot[w.run])
                if not len(pick):
                    continue
                run, value, start = w.run[pick], w.window[pick], w.start[pick]
                w.run = w.window = None
                order = np.lexsort((value, w.anchor[run]))  # stable: places stay in order
                v, a = value[order], w.anchor[run[order]]
                same = (v[1:] == v[:-1]) & (a[1:] == a[:-1])
                del v, a
                again, more = np.append(False, same), np.append(same, False)  # equals the one before, the one after
                leads = np.zeros(len(pick), bool)
                leads[order] = ~again
                known = np.zeros(len(pick), bool)
                known[order] = again | more
                bit = start - w.start[w.opens[run]]
                opens = np.flatnonzero(np.append(True, run[1:] != run[:-1]))

                def mask(which: np.ndarray, bit=bit, opens=opens) -> np.ndarray:
                    return np.bitwise_or.reduceat(np.where(which, np.int64(1) << bit, 0), opens)

                first = w.start[w.opens[run[opens]]]
                owner = w.row[first]
                count = np.add.reduceat(leads.astype(np.int64), opens)
                bounds = np.concatenate(([0], np.cumsum(count))) * 8
                hashes = pa.Array.from_buffers(pa.binary(), len(opens), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(value[leads].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.anchor[run[opens]].view(np.int64)),
                        pa.array(key[at : at + rows][owner]),
                        pa.array((first - w.first[owner]).astype(np.int32)),
                        pa.array(mask(leads).astype(np.int32)),
                        pa.array(mask(leads & known).astype(np.int32)),
                        pa.array(mask(known).astype(np.int32)),
                        hashes,
                    ],
                    names=["anchor", "key", "first", "take", "twice", "known", "hashes"],
                )

    return run


def _listed(runs: pa.Array, owner: np.ndarray) -> np.ndarray:
    """Which anchors are in their document's list of numbers."""
    width = np.int64(1) << 32
    lists = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False))
    return np.isin(owner * width + _numbers(owner), lists * width + runs.flatten().to_numpy(zero_copy_only=False))


def crowded_anchors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Anchors to deal out, sorted, and into how many parts each; at most SPLIT of them."""
    counts = rows.groupBy("anchor").agg(F.sum(F.bit_count("take")).alias("n")).where(F.col("n") > MANY)
    total = rows.agg(F.sum(F.bit_count("take"))).first()[0] or 0
    many = max(MANY, total // SPLIT)
    found = sorted((r.anchor, -(-r.n // many)) for r in counts.where(F.col("n") > many).collect())
    return np.array([a for a, _ in found], np.int64), np.array([p for _, p in found], np.int64)


def _dealt(crowded: Broadcast):
    """Rows of crowded anchors as a row for each part that their windows' hashes fall in, under an anchor of its own."""
    step = np.arange(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, parts = crowded.value
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, take, twice = (batch.column(c).to_numpy() for c in ("anchor", "take", "twice"))
            value = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
            row, bit = np.nonzero((take[:, None] >> step) & 1)
            part = value % parts[np.searchsorted(anchors, anchor)].astype(np.uint64)[row]
            order = np.lexsort((bit, part, row))  # the hashes of a row stay in the order of its bits
            row, bit, part, value = row[order], bit[order], part[order], value[order]
            opens = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
            one = np.int64(1) << bit
            of = row[opens]
            own = mix(anchor[of].view(np.uint64) ^ mix(part[opens] + BASE))
            bounds = np.append(opens, len(row)) * 8
            hashes = pa.Array.from_buffers(pa.binary(), len(opens), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(value.tobytes())])
            mine = np.bitwise_or.reduceat(one, opens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), batch.column("key").take(pa.array(of)), batch.column("first").take(pa.array(of)), pa.array(mine.astype(np.int32)), pa.array((mine & twice[of]).astype(np.int32)), hashes],
                names=["anchor", "key", "first", "take", "twice", "hashes"],
            )

    return run


FOUND = "anchor long, key long, first int, take int, twice int, known int, hashes binary"


def dealt_out(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the second pass, those of crowded anchors settled in parts of their rows and dealt out by their windows' hashes
    (equal windows stay under one anchor); and what the parts have settled."""
    crowded = crowded_anchors(rows)
    if not len(crowded[0]):
        return rows, None
    spark = rows.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = F.broadcast(spark.createDataFrame([(int(a), int(p)) for a, p in zip(*crowded, strict=True)], "anchor long, parts long"))  # at most SPLIT rows
    salted = rows.join(named, "anchor").withColumn("part", F.pmod(F.xxhash64("key", "first"), "parts")).withColumn("group", F.xxhash64("anchor", "part"))
    salted = salted.select("group", *rows.columns).repartition(spread, "group").sortWithinPartitions("group")
    once = stored(salted.mapInArrow(_grouped("group", False), FOUND), "settled")
    parts = once.where("take <> 0").select(*rows.columns).mapInArrow(_dealt(spark.sparkContext.broadcast(crowded)), rows.schema)
    return rows.join(named, "anchor", "left_anti").unionByName(parts), once


def _grouped(by: str, last: bool):
    """Settles windows among the rows of a group; the rows come sorted by the column by. last: what is not settled here is unique.

    known: windows that recur; take: one row for each different window, twice: those that stand for several.
    """
    step = np.arange(32)

    def settle(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        group = t.column(by).to_numpy()
        take, twice = t.column("take").to_numpy(), t.column("twice").to_numpy()
        value = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        row, bit = np.nonzero((take[:, None] >> step) & 1)
        weight = 1 + ((twice[row] >> bit) & 1)
        order = np.lexsort((value, group[row]))
        v, g = value[order], group[row][order]
        cut = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (g[1:] != g[:-1])))
        total = np.empty(len(order), np.int64)
        total[order] = np.repeat(np.add.reduceat(weight[order], cut), np.diff(np.append(cut, len(order))))
        leads = np.zeros(len(order), bool)
        leads[order[cut]] = True

        def mask(which: np.ndarray) -> np.ndarray:
            out = np.zeros(len(group), np.int64)
            np.bitwise_or.at(out, row[which], np.int64(1) << bit[which])
            return out.astype(np.int32)

        taken, again, known = mask(leads), mask(leads & (total > 1)), mask((total > 1) & (weight == 1))
        count = np.bincount(row[leads], minlength=len(group))
        bounds = np.concatenate(([0], np.cumsum(count))) * 8
        hashes = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(value[leads].tobytes())])
        columns = [t.column(c).combine_chunks() for c in ("anchor", "key", "first")]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(taken), pa.array(again), pa.array(known), hashes], names=["anchor", "key", "first", "take", "twice", "known", "hashes"])
        return out.filter(pa.array(known != 0 if last else (taken | known) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(by).to_numpy()
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if whole or (rest and rest[-1].column(by)[-1].as_py() != group[0]):
                yield settle(pa.Table.from_batches([*rest, batch.slice(0, whole)]))
                rest = []
            rest.append(batch.slice(whole))
        if rest:
            yield settle(pa.Table.from_batches(rest))

    return run


def _cut(size: int):
    step = np.arange(32)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in row_slices(batch.column("text"), STRETCH):
                doc, text, spans = (batch.column(c).slice(at, rows) for c in ("doc_id", "text", "spans"))
                first, mask = (c.to_numpy(zero_copy_only=False) for c in spans.flatten().flatten())
                bounds = np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                out: list[tuple] = []
                for k, (name, value) in enumerate(zip(doc.to_pylist(), text, strict=True)):
                    words = value.as_buffer().to_pybytes().split()
                    n, gone = len(words), 0
                    here = slice(bounds[k], bounds[k + 1])
                    if here.start < here.stop:
                        row, bit = np.nonzero((mask[here, None] >> step) & 1)
                        opens = first[here][row] + bit
                        edge = np.bincount(opens, minlength=n + 1) - np.bincount(opens + size, minlength=n + 1)
                        stays = np.cumsum(edge[:-1]) == 0
                        words = list(compress(words, stays.tolist()))
                        gone = n - len(words)
                    out.append((name, n, gone, b" ".join(words).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeated(docs: DataFrame, size: int = SIZE, max_bits: int = 29) -> DataFrame:
    """doc_id, n_words, n_removed and the text of the words that stay, joined by one space."""
    if not 2 <= size <= 60:  # the windows of an anchor are bits of a 32-bit mask
        raise ValueError("a window has 2 to 60 words")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))
    sketch = sketched(rows, size, max_bits)
    if sketch.bits <= max_bits:
        found = rows.select("key", "text").mapInArrow(_candidates(size, sketch.bits, sketch.block, sketch.broadcast()), FOUND)
    else:
        asked = rows.select("key", "text").join(hot_runs(rows, size, sketch), "key")
        found = asked.mapInArrow(_candidates(size, sketch.bits, sketch.block, None), FOUND)
    found = stored(found, "candidates")
    taken = found.where("take <> 0").select("anchor", "key", "first", "take", "twice", "hashes")
    dealt, once = dealt_out(taken)
    grouped = dealt.repartition(spread, "anchor").sortWithinPartitions("anchor").mapInArrow(_grouped("anchor", True), FOUND)
    known = [df.where("known <> 0").select("key", "first", "known") for df in (grouped, found, once) if df is not None]
    # rows that repeat a document have one key: their masks become one before they are listed
    masks = reduce(DataFrame.unionByName, known).groupBy("key", "first").agg(F.bit_or("known").alias("mask"))
    spans = stored(masks.groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("spans")), "spans")
    discard(found)
    if once is not None:
        discard(once)
    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, text string")
