"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Bounded-space online best fit: a task packs the pieces of its partition as they come (a few hundred
documents at a time, the longest pieces first), with a fixed number of open bins. The open bins stand in a bitset keyed by free space, so the tightest bin
that still takes a piece is the lowest set bit at or above its length. Where all bins are open, the
fullest closes first. Tasks pack on their own, so no row is shuffled and no key can be hot; what a
task leaves part-filled is at most its open bins.

Defined results: null text counts as the empty text, whose only token is the end id; repeated rows and
equal lengths are packed like others, in input order; very long texts are encoded whole, whatever they are made of; an empty
table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: The split pattern of the byte-level vocabulary (a fixed value), and texts for which two libraries' character
#: classes are the same: printable Latin and plain white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*").fullmatch
#: Documents that a task puts in order of length before it packs them.
AHEAD = 512


#: Characters of white space in a row that the rank encoder is given at most: its pattern looks ahead from each of them, on a stack.
BLANKS = 10_000
_RUNS = re.compile(r"\s{100,}").findall


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Encoder:
    """Ids as the tokenizer file gives them, as little-endian 32-bit bytes."""

    def __init__(self, path: str, added: bool = True):
        """added: whether the strings of added tokens get these tokens' ids; else they are plain text."""
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        tokens = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(tokens) or "(?!)").search
        byte = byte_alphabet()
        # ids of this vocabulary stand in the order of its merges, so they are the ranks of the merges too
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ranks_serve(self, text: str) -> bool:
        """Not for code points outside PLAIN, whose character classes may differ in the tokenizer library, added tokens, and very long runs of white space."""
        return bool(PLAIN(text)) and not self.added(text) and (len(text) <= BLANKS or max(map(len, _RUNS(text)), default=0) <= BLANKS)

    def __call__(self, text: str) -> bytes:
        """Texts that the ranks do not serve go to the tokenizer library itself."""
        ids = self.ranked.encode_ordinary(text) if self.ranks_serve(text) else self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


class OpenBins:
    """The open bins of one task."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.limit, self.open, self.made = capacity, bins, 0, 0
        self.bits = 0  # bit f: some open bin has f tokens free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset of a piece."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if rest := free - length:
            if self.open == self.limit:  # the fullest closes
                fullest = (self.bits & -self.bits).bit_length() - 1
                if rest <= fullest:
                    return number, self.capacity - free
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def pieces(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full pieces after a first one that takes the remainder."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, bins: int = 1024) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    sequence_id holds the task's partition in its upper bits, so that a task that runs again on
    another executor numbers its sequences alike.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, open_bins = Encoder(tokenizer), OpenBins(capacity, bins)
        upper = TaskContext.get().partitionId() << 40
        for batch in (b.slice(k, AHEAD) for b in batches for k in range(0, b.num_rows, AHEAD)):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(encode(text or "") + end)
                start = 0
                for k, length in enumerate(pieces(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start += length
            rows.sort(key=lambda r: -r[3])
            rows = [(*r, upper | number, offset) for r in rows for number, offset in (open_bins.place(r[3]),)]
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
