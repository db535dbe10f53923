"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are counted on flat byte and word arrays. The trees are fitted on a
bounded sample of labelled rows (`max_rows`), drawn by hash of the doc_id; they are complete trees of
one depth, flattened into one array of features and one of bins, so a batch walks each level of all
trees as one numpy gather.

Defined results: null text counts as the empty text and gets a score like any other; rows with a null
doc_id are scored and never held out; repeated rows get equal scores; with labels of one class, or none, the score
is their share (one half); an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import flat_bytes, row_slices, word_bounds, word_hashes
from .runtime import share_of, stored

STATISTICS = (
    "bytes", "words", "lines", "word_length", "upper", "digit", "symbol", "bar", "exclaim", "stop", "comma", "accent",
    "space", "lead_upper", "short_words", "long_words", "ends_symbol", "distinct_words", "twin_words", "distinct_lines", "line_words",
    "lone_symbols", "quote", "top_word",
)
STRETCH = 1 << 22
THRESHOLD = 0.3


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


CLASSES = {
    "upper": _class(range(65, 91)), "digit": _class(range(48, 58)), "symbol": _class(b"#*$%&|<>@^~=_+{}[]\\/"), "bar": _class(b"|"), "exclaim": _class(b"!?"),
    "stop": _class(b"."), "comma": _class(b",;:"), "accent": _class(range(0xC0, 0x100)), "space": _class(b" \t\n\x0b\x0c\r"), "quote": _class(b"\"'()"),
}


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))[first])


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most frequent one."""
    if not len(hashes):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    cut = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    top = np.zeros(rows)
    np.maximum.at(top, r[cut], np.diff(np.append(cut, len(h))))
    return np.bincount(r[cut], minlength=rows).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, offsets = flat_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    rows = len(column)
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(first).astype(float)
    row = np.repeat(np.arange(rows), np.diff(first))
    length = (ends - starts).astype(float)
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
    hashes = word_hashes(data, starts, ends)
    distinct, top = _distinct(hashes, row, rows)
    twin = np.append(False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) if len(hashes) else np.zeros(0, bool)
    # lines with a word: hash of a line is the wrapping sum of its words' hashes by place
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    line = feeds[starts] + row if len(starts) else np.zeros(0, np.int64)
    opens = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))) if len(line) else np.zeros(0, np.int64)
    n_lines = np.bincount(row[opens], minlength=rows).astype(float)
    if len(opens):
        place = np.arange(len(line)) - np.repeat(opens, np.diff(np.append(opens, len(line))))
        line_hash = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), opens)
        distinct_lines = _distinct(line_hash, row[opens], rows)[0]
    else:
        distinct_lines = np.zeros(rows)
    of = {k: _by_row(c[data], offsets) * per_byte for k, c in CLASSES.items()}
    if len(starts):
        last, lead = CLASSES["symbol"][data[ends - 1]], CLASSES["upper"][data[starts]]
        lone = last * (length == 1)
    else:
        last = lead = lone = np.zeros(0)
    of |= {
        "bytes": np.log1p(n_bytes), "words": np.log1p(n_words), "lines": np.log1p(n_lines), "word_length": _by_row(length, first) * per_word,
        "lead_upper": _by_row(lead, first) * per_word, "short_words": _by_row(length <= 3, first) * per_word, "long_words": _by_row(length > 12, first) * per_word,
        "ends_symbol": _by_row(last, first) * per_word, "distinct_words": distinct * per_word, "twin_words": _by_row(twin, first) * per_word,
        "distinct_lines": distinct_lines / np.maximum(n_lines, 1), "line_words": np.log1p(n_words / np.maximum(n_lines, 1)), "lone_symbols": _by_row(lone, first) * per_word,
        "top_word": top * per_word,
    }
    return np.stack([of[k] for k in STATISTICS], axis=1).astype(np.float32)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in x.T)], names=["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} float" for k in STATISTICS))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Stretches of rows with the statistics of their texts."""
    for batch in batches:
        for at, rows in row_slices(batch.column("text"), STRETCH):
            part = batch.slice(at, rows)
            yield part, statistics(part.column("text"))


@dataclass
class Trees:
    """Complete trees of one depth: row t has the features and bins of its inner nodes level by level, and the leaves' values."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        trees, inner = self.feature.shape
        depth, tree = (inner + 1).bit_length() - 1, np.arange(trees)
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            binned = self.bins(x[a : a + block])
            node = np.zeros((len(binned), trees), np.int64)
            for _ in range(depth):
                value = np.take_along_axis(binned, self.feature[tree, node], axis=1)
                node = 2 * node + 1 + (value > self.bin[tree, node])
            out[a : a + block] = self.base + self.leaf[tree, node - inner].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0) -> Trees:
    """Boosting on the logistic loss: histograms of gradients by node, feature and bin decide the splits of a level."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    inner = (1 << depth) - 1
    model = Trees([np.zeros(0)] * x.shape[1], np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = model.bins(x).astype(np.int64)
    n, m = binned.shape
    margin = np.full(n, model.base)
    features, cuts, leaves = [], [], []
    column = np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, feature, cut = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, bins)
        for level in range(depth):
            nodes, at = 1 << level, (1 << level) - 1
            cell = (((node - at) * (m * bins))[:, None] + column + binned).ravel()
            hist = [np.bincount(cell, np.repeat(v, m), nodes * m * bins).reshape(nodes, m, bins) for v in (g, h)]
            left = [np.cumsum(v, axis=2) for v in hist]
            total = [v[:, :, -1:] for v in left]
            right = [t - v for t, v in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[1] < 1) | (right[1] < 1)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            feature[at : at + nodes] = best // bins
            cut[at : at + nodes] = np.where(good, best % bins, bins)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        end = node - inner
        leaf = -rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + ridge)
        margin += leaf[end]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    model.feature, model.bin, model.leaf = np.array(features), np.array(cuts), np.array(leaves)
    return model


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows rows, by hash of the doc_id."""
    n = rows.count()
    if n > max_rows:
        rows = rows.where(share_of(F.xxhash64("doc_id")) < 0.97 * max_rows / n)
    return rows.limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 50_000) -> Trees:
    """Trees for labels.quality, from labelled rows outside the held-out fold.

    The sample is drawn from the labels, so its ids are at most max_rows and can be broadcast: the documents are
    neither shuffled nor measured beyond it.
    """
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", "quality")
    sample = stored(bounded_sample(known, max_rows), "quality-sample")
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi"))
    # an id that repeats counts once for each label, so that no more rows than the sample has come here
    names = [c for c in rows.columns if c != "doc_id"]
    one = rows.join(F.broadcast(sample.distinct()), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("x"))
    found = one.select("doc_id", "quality", "x.*").toPandas()
    found = found.iloc[np.lexsort((found["bytes"], found["doc_id"]))]
    return fit_trees(found[list(STATISTICS)].to_numpy(np.float32), found["quality"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(model.value.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns, filtered where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches):
            yield part.filter(pa.array(model.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
