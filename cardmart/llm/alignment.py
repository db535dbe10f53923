"""Alignment of the tokens that two tokenizers give the same text, and how often their ids meet.

A dictionary from end to index holds the byte ends of each side's tokens. The hash-set intersection of their keys, sorted,
is where both sides end; it slices the two id lists into groups, and the links (tokens whose bytes overlap) are
expanded per slice: one for each byte end of either side. Texts are cut before single spaces first, where both tokenizers always end a token, so that what recurs
is aligned once in a task.

Counting is three passes over one written table with a row per document (its distinct links, three small integers each): tasks
count the distinct links of their batches before the shuffle; the best partner of each A id is a maximum over the counts;
then the documents look the counts up. The most frequent links, at most HOT of them, are broadcast; the rare rest
goes through a join, in which a link meets few documents by being rare.

Defined results: texts that are null, empty or spelled differently by a side's tokens (U+2581 in the text, say) have zeros and the
empty string; special tokens' strings are plain text; very long texts are read whole, what has no
spaces is aligned as one piece in linear time; repeated rows repeat in the result and count as documents of their own, rows with a null
doc_id too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import row_slices
from .packing import Encoder, byte_alphabet
from .runtime import FILE, PLACE, discard, identified, stored

SPACE = "▁"
#: A single space between characters that are neither white space nor the space symbol.
CUT = re.compile(rf"(?<=[^\s{SPACE}]) (?=[^\s{SPACE}])")
#: A space inside a longer run of white space.
INSIDE = re.compile(r"[^\S ] [^\S ]").search
#: Pieces of text that a task remembers, the longest that it remembers, and bytes of text that it aligns at once.
CACHE, LONG, BYTES = 150_000, 48, 4 << 20
#: Links that are broadcast at most (17 bytes each).
HOT = 1 << 20
#: B ids are below this, so that a link is one number.
WIDTH = 1 << 20

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def units(text: str) -> list[str]:
    """A text cut at spaces before which both tokenizers end a token; each unit stands for itself after a space."""
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " " or INSIDE(text):
        return CUT.split(text)
    return text.split(" ")


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups' byte ends and upper bounds in either list of tokens, and the links as two arrays of indices.

    A slice's links are closed by its tokens' ends, each by one that ends on either side or on both.
    """
    at_a, at_b = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True)), dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = sorted(at_a.keys() & at_b.keys())
    bound_a, bound_b = (np.array([at[e] for e in common], np.int64) for at in (at_a, at_b))
    closing = np.union1d(ends_a, ends_b)
    return np.array(common, np.int64), bound_a, bound_b, np.searchsorted(ends_a, closing), np.searchsorted(ends_b, closing)


class Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, spelled: list[bytes]):
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.length[ids])

    def text(self, ids: np.ndarray) -> np.ndarray:
        length, ends = self.length[ids], self.ends(ids)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - length), length)]


#: What a unit without tokens has.
NOTHING = (0, 0, 0, "", b"")


class Aligner:
    """Aligns texts; what recurs is kept."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.encode_a = Encoder(byte_level, added=False)
        byte = byte_alphabet()
        spelled = {i: bytes(map(byte.__getitem__, t)) for t, i in self.encode_a.library.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        self.a = Spelling([spelled.get(i, b"") for i in range(max(spelled) + 1)])
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if len(names) > WIDTH or any("\n" in p or SPACE in p.lstrip(SPACE) for i, p in enumerate(names) if not sp.is_control(i)):
            raise ValueError("pieces of this model cross words")
        self.b = Spelling([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)])
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def units(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes] | None]:
        """Per unit: tokens of either side, groups, the groups spelled out, the links (64-bit numbers); None where a side spells another text."""
        out: list[tuple | None] = [None] * len(texts)
        bare = [k for k, t in enumerate(texts) if t and not (t[0].isspace() or t[-1].isspace()) and SPACE not in t]
        served = set(filter(lambda k: self.encode_a.ranks_serve(texts[k]), bare))
        for part in (sorted(served), [k for k in bare if k not in served]):
            at = 0
            while at < len(part):  # many in one run, as what separates them ends a token on both sides
                size, to = 0, at
                while to < len(part) and size < BYTES // 4:
                    size += len(texts[part[to]])
                    to += 1
                for k, found in zip(part[at:to], self.run([texts[k] for k in part[at:to]]), strict=True):
                    out[k] = found
                at = to
        for k in set(range(len(texts))) - set(bare):
            out[k] = self.run([texts[k]])[0] if texts[k] else NOTHING
        return out

    def run(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes] | None]:
        joined = " ".join(texts)
        whole = np.frombuffer((" " + joined).encode(), np.uint8)
        edge = np.cumsum([len(t.encode()) + 1 for t in texts])
        plain = self.encode_a.ranks_serve(joined)
        ids_a = [self.encode_a(" " + joined)] if plain else [self.encode_a(" " + t) for t in texts]
        a, b = np.frombuffer(b"".join(ids_a), np.uint32).astype(np.int64), np.array(self.sp.encode(joined, num_threads=1), np.int64)
        ends_a, ends_b = self.a.ends(a), self.b.ends(b)
        same = all(len(e) and e[-1] == len(whole) for e in (ends_a, ends_b)) and (self.a.text(a) == whole).all() and (self.b.text(b) == whole).all()
        if not same:  # one of the texts is spelled differently: on their own
            return [None] if len(texts) == 1 else [self.run([t])[0] for t in texts]
        common, bound_a, bound_b, x, y = align(ends_a, ends_b)
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spelled, i, j = [], 0, 0
        for i2, j2 in zip(bound_a.tolist(), bound_b.tolist(), strict=True):
            if i2 - i == 1 == j2 - j:
                spelled.append(f"{names_a[i]}|{names_b[j]}")
            else:
                spelled.append(f"{','.join(names_a[i:i2])}|{','.join(names_b[j:j2])}")
            i, j = i2, j2
        links = (a[x] * WIDTH + b[y]).tobytes()
        # where each unit ends among tokens, groups and links
        last = (np.searchsorted(e, edge, "right").tolist() for e in (ends_a, ends_b, common, np.minimum(ends_a[x], ends_b[y])))
        out, a0, b0, g0, l0 = [], 0, 0, 0, 0
        for a1, b1, g1, l1 in zip(*last, strict=True):
            out.append((a1 - a0, b1 - b0, g1 - g0, ";".join(spelled[g0:g1]), links[8 * l0 : 8 * l1]))
            a0, b0, g0, l0 = a1, b1, g1, l1
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, the digest of the groups, and the links as sorted numbers with how often each stands in the text."""
        rows = [units(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        known, new = self.known, []
        for u in dict.fromkeys(u for r in rows for u in r):
            if u not in known:
                if u in self.before:
                    known[u] = self.before[u]
                else:
                    new.append(u)
        fresh = dict(zip(new, self.units(new), strict=True))
        kept = {u: x for u, x in fresh.items() if len(u) <= LONG}
        known.update(kept)
        look = known if len(kept) == len(fresh) else known | fresh
        out = []
        for r in rows:
            found = [look[u] for u in r]
            if not found or None in found:
                out.append((0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            n_a, n_b, n_groups, spelled, links = zip(*found, strict=True)
            pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            digest = hashlib.sha256(";".join(spelled).encode()).hexdigest()
            out.append((sum(n_a), sum(n_b), sum(n_groups), digest, pairs, times))
        return out


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row per document: counts of tokens, groups and links, the digest of its groups, and its distinct links (a, b, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_texts = Aligner(byte_level, pieces)
        for batch in batches:
            for at, n in row_slices(batch.column("text"), BYTES):
                part = batch.slice(at, n)
                found = align_texts(part.column("text").to_pylist())
                columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
                links = pa.array([int(x[5].sum()) for x in found], pa.int64())
                lists = [_lists([x[4] // WIDTH for x in found]), _lists([x[4] % WIDTH for x in found]), _lists([x[5] for x in found])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *columns, links, pa.array([x[3] for x in found], pa.string()), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """The links of all rows of a batch as numbers."""
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    return a * WIDTH + b


def link_counts(rows: DataFrame) -> DataFrame:
    """link, n (documents that hold it) and best (whether n is the highest of its A id). Each batch is counted before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, n = np.unique(_flat(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(n.astype(np.int64))], names=["link", "n"])

    counted = stored(rows.select("a", "b").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")), "links")
    a = F.shiftright("link", WIDTH.bit_length() - 1)
    # a row per A id: no more than the vocabulary has entries
    top = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    out = stored(counted.withColumn("a", a).join(F.broadcast(top), "a").select("link", "n", (F.col("n") == F.col("most")).alias("best")), "link-counts")
    discard(counted)
    return out


def frequent(counts: DataFrame, most: int) -> int:
    """The lowest power of two such that at most so many links are counted as often."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    left, above = most, 1
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # 64 rows at most
        left -= row["count"]
        if left < 0:
            return 1 << (row["level"] + 1)
        above = 1 << row["level"]
    return above


def aligned_counts(docs: DataFrame, byte_level: str, pieces: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    rows = stored(aligned(docs, byte_level, pieces), "aligned")
    counts = link_counts(rows)
    least = frequent(counts, hot)
    known = counts.where(F.col("n") >= least).toArrow()  # at most `hot` rows
    order = np.argsort(known.column("link").to_numpy())
    table = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy(zero_copy_only=False)[order] for c in ("link", "n", "best")))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = table.value
        for batch in batches:
            links = _flat(batch)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(batch.column("a").value_lengths().to_numpy(zero_copy_only=False))))
            at = np.minimum(np.searchsorted(link, links), max(len(link) - 1, 0))
            hit = link[at] == links if len(link) else np.zeros(len(links), bool)
            sums = []
            for value in (np.where(hit, n[at] * times, 0), np.where(hit & best[at], times, 0)) if len(link) else (np.zeros(len(links), np.int64),) * 2:
                total = np.concatenate(([0], np.cumsum(value)))
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            rare = np.concatenate(([0], np.cumsum(~hit)))[ends].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rare), pa.array(v[~hit])) for v in (links, times)]
            names = [*own, FILE, PLACE]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *sums, *lists], names=[*names, "count_sum", "n_best", "rare", "rare_times"])

    kinds = [*(f"{c} {t}" for c, t in rows.select(*own).dtypes), f"{FILE} long", f"{PLACE} long", "count_sum long, n_best long, rare array<long>, rare_times array<long>"]
    found = stored(identified(rows).select(*own, FILE, PLACE, "a", "b", "times").mapInArrow(run, ", ".join(kinds)), "looked-up")
    rare = found.select(FILE, PLACE, F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select(FILE, PLACE, F.col("r.rare").alias("link"), F.col("r.rare_times").alias("times"))
    more = rare.join(counts.where(F.col("n") < least), "link").groupBy(FILE, PLACE).agg(F.sum(F.col("n") * F.col("times")).alias("sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("top"))
    more = stored(more, "rare-links")
    out = found.drop("rare", "rare_times").join(more, [FILE, PLACE], "left")
    discard(rows)
    discard(counts)
    total = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in (("n_best", "top"), ("count_sum", "sum"))]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *total, "groups_sha256")
