"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The words of a batch that are not yet known are laid out as one flat array of symbols. In each round
every word finds its pair of lowest rank (a segmented minimum), merges it, leftmost first, and the array
is compacted; words without a pair left drop out. Several copies of a pair merge in one round where
no merge of their result can outrank them, else the leftmost alone does, so the rounds end where the
library's queue ends.

Words are cut where no piece of the vocabulary can cross: before runs of the space symbol and at line
feeds; long words also wherever no piece that occurs in them covers two neighbouring symbols. A round costs a
pass over the words that are not done, so what is longer than MANY symbols after all cuts goes through a
queue of pairs instead, in time n log n: texts without spaces cost about as much a character as others.
Defined results: null text counts as the empty text (the end id alone); an empty table
gives no rows; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
SEGMENT = re.compile("(?:\n|▁+)[^▁\n]*")
NONE = np.iinfo(np.int32).max
#: Words that a task remembers, and rows that it encodes at once.
CACHE = 200_000
ROWS = 512
#: Characters above which a word is cut (and not remembered), and symbols above which what is left goes through a queue.
LONG, MANY = 48, 256


#: Odd multiplier of the hash of a run of symbols.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(columns: np.ndarray) -> np.ndarray:
    """Hash of each run of symbols; columns: the first symbols of all, then the second ones, and so on."""
    code = columns[-1]
    for sym in columns[-2::-1]:
        code = sym + code * FACTOR
    return code


class Vocabulary:
    """Symbols, pair table and byte table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.end, self.size = sp.eos_id(), n
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        symbol = {names[i]: i for i in plain}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in symbol):
            raise ValueError("pieces of this model cross words")
        for c in sorted({c for i in plain for c in names[i]} - symbol.keys()):  # characters that stand in pieces only
            symbol[c] = n + len(symbol) - len(plain)
        self.count = n + len(symbol) - len(plain) + 1
        self.unknown = self.count - 1
        # rank of a piece: its place in the order of scores; equal scores share a rank
        order = np.unique(-np.array([sp.get_score(i) for i in plain]), return_inverse=True)[1]
        rank = dict(zip(plain, order.tolist(), strict=True))
        pairs = {}
        best = {i: NONE for i in plain}  # lowest rank of a merge that takes this piece in
        for i in plain:
            for k in range(1, len(names[i])):
                left, right = symbol.get(names[i][:k]), symbol.get(names[i][k:])
                if left is not None and right is not None:
                    pairs[left * self.count + right] = i
                    for s in (left, right):
                        best[s] = min(best.get(s, NONE), rank[i])
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = np.array([rank[i] for i in self.merged.tolist()], np.int32)
        #: Whether all copies of a pair may merge at once.
        self.safe = np.array([best[i] > rank[i] for i in self.merged.tolist()])
        self.rank_of = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.rank.tolist(), self.merged.tolist(), strict=True)}
        self.chars = {ord(c): s for c, s in symbol.items() if len(c) == 1}
        top = max(self.chars, default=0) + 1
        self.of_char = np.full(top + 1, self.unknown, np.int32)
        self.of_char[list(self.chars)] = list(self.chars.values())
        # hashes of the pieces' symbols, by length
        spelled: dict[int, list[list[int]]] = {}
        for i in plain:
            if len(names[i]) > 1:
                spelled.setdefault(len(names[i]), []).append([symbol[c] for c in names[i]])
        self.spelled = {n: np.unique(_hashes(np.array(rows, np.uint64).T)) for n, rows in sorted(spelled.items())}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # what each id decodes to
        surface = [b"" if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        if sp.unk_id() >= 0:
            surface[sp.unk_id()] = " ⁇ ".encode()
        self.surface_length = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.is_byte = np.array([bool(sp.is_byte(i)) for i in range(n)])
        self.leads = np.array([names[i].startswith(SPACE) and not sp.is_control(i) for i in range(n)])

    def parts(self, sym: np.ndarray) -> np.ndarray:
        """Places where a word is cut for good: no piece that occurs in it covers the symbols on both sides."""
        edge = np.zeros(len(sym) + 1, np.int64)
        code = sym.astype(np.uint64)
        for n in range(2, max(self.spelled, default=1) + 1):
            if len(sym) < n:
                break
            code = sym[: len(sym) - n + 1].astype(np.uint64) + code[1:] * FACTOR
            if n in self.spelled:
                known = self.spelled[n]
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code)
                np.add.at(edge, hit + 1, 1)  # joins symbols hit .. hit + n - 1
                np.add.at(edge, hit + n, -1)
        return np.flatnonzero(np.cumsum(edge[:-1])[1:] == 0) + 1

    def queued(self, sym: list[int], at: list[int]) -> tuple[list[int], list[int]]:
        """One long word by a queue of its pairs: the lowest rank first, then the leftmost."""
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (found := self.rank_of.get(sym[i] * self.count + sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:  # one of the two has been merged since
                continue
            sym[i], sym[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        stays = [i for i in range(n) if sym[i] >= 0]
        return [sym[i] for i in stays], [at[i] for i in stays]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (little-endian 32-bit), encoded on its own."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.of_char[np.minimum(points, len(self.of_char) - 1)]
        lengths = np.array([len(w) for w in words])
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_at = [], []
        at = np.arange(len(sym))
        cut = np.zeros(len(sym), bool)
        cut[begins] = True
        for w in np.flatnonzero(lengths > LONG).tolist():
            a, b = begins[w], begins[w] + lengths[w]
            cut[a + self.parts(sym[a:b])] = True
        word = np.cumsum(cut) - 1  # parts of words
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(sym)))
        for a, n in zip(first[size > MANY].tolist(), size[size > MANY].tolist(), strict=True):
            s, places = self.queued(sym[a : a + n].tolist(), at[a : a + n].tolist())
            done_sym.append(np.array(s, sym.dtype))
            done_at.append(np.array(places))
        if (size > MANY).any():
            keep = np.repeat(size <= MANY, size)
            sym, word, at = sym[keep], word[keep], at[keep]
        while len(sym):
            key = sym[:-1].astype(np.int64) * self.count + sym[1:]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[place] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.rank[place], NONE), NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            span = np.diff(np.append(first, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, first), span)
            over = least == NONE
            if over.any():  # these words have no pair left
                done_sym.append(sym[over])
                done_at.append(at[over])
                keep = ~over
                sym, word, at, rank, least = sym[keep], word[keep], at[keep], rank[keep], least[keep]
                place = place[keep[: len(place)]] if len(place) else place
                if not len(sym):
                    break
            spot = np.flatnonzero(rank == least)
            near = np.append(False, np.diff(spot) == 1)  # overlaps the pair before it
            run = np.arange(len(spot)) - np.maximum.accumulate(np.where(near, 0, np.arange(len(spot))))
            leftmost = np.append(True, word[spot[1:]] != word[spot[:-1]])
            spot = spot[np.where(self.safe[place[spot]], run % 2 == 0, leftmost)]
            sym[spot] = self.merged[place[spot]]
            stay = np.ones(len(sym), bool)
            stay[spot + 1] = False
            sym, word, at = sym[stay], word[stay], at[stay]
        sym, at = np.concatenate(done_sym), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        sym, at = sym[order], at[order]
        word = owner[at]
        if (sym >= self.size).any():  # characters outside the vocabulary, byte by byte
            ids, owner = [], []
            for s, w, a in zip(sym.tolist(), word.tolist(), at.tolist(), strict=True):
                new = [s] if s < self.size else [self.byte_id[b] for b in chr(points[a]).encode()]
                ids += new
                owner += [w] * len(new)
            sym, word = np.array(ids, np.int32), np.array(owner)
        bounds = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        flat = sym.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids: the first space symbol of a row falls away, control ids have no text."""
        lengths, starts = self.surface_length[ids], self.surface_start[ids]
        seen = lengths > 0
        position = np.flatnonzero(seen)
        head = np.searchsorted(position, offsets[:-1])
        rows = np.flatnonzero(head < len(position))
        head = position[head[rows]] if len(position) else head[:0]
        rows_ok = head < offsets[1:][rows] if len(position) else np.zeros(0, bool)
        head = head[rows_ok]
        head = head[self.leads[ids[head]]]
        lengths, starts = lengths.copy(), starts.copy()
        starts[head] += 1
        lengths[head] -= 1
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
        data = self.surface[take].tobytes()
        bounds = np.concatenate(([0], ends))[offsets]
        out = []
        for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(self._decode_bytes(ids[i:j], lengths[i:j], data[a:b]))
        return pa.array(out, pa.string())

    def _decode_bytes(self, ids: np.ndarray, lengths: np.ndarray, data: bytes) -> str:
        """A row whose byte pieces are no valid text: each byte that fits nowhere becomes U+FFFD."""
        out, at, run = [], 0, b""
        for i, n in zip([*ids.tolist(), None], [*lengths.tolist(), 0], strict=True):
            if i is not None and self.is_byte[i]:
                run += data[at : at + n]
            else:
                while run:
                    char, width = _first_char(run)
                    out.append(char)
                    run = run[width:]
                out.append(data[at : at + n].decode())
            at += n
        return "".join(out)


def _first_char(data: bytes) -> tuple[str, int]:
    for width in range(1, 5):
        try:
            return data[:width].decode(), width
        except UnicodeDecodeError:
            continue
    return "\ufffd", 1


class Encoder:
    """Texts to ids, batch by batch; words that recur are kept."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def units(text: str) -> list[str]:
        """Words with their space symbols; the dummy prefix goes before the first."""
        if not text:
            return []
        units = text.replace("\n", " \n").split(" ")
        if "" in units or SPACE in text or text[0] == "\n":
            return SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        return units

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with the end id, and the offsets of the rows."""
        known = self.known
        # two kinds of words: as cut at single spaces (no space symbol written), and as SEGMENT gives them
        rows = [self.units(t) for t in texts]
        new = [u for u in dict.fromkeys(u for r in rows for u in r) if u not in known]
        full = [u if u[0] == SPACE or u[0] == "\n" else SPACE + u for u in new]
        fresh = dict(zip(new, self.vocabulary.encode_words(full), strict=True))
        if len(known) + len(fresh) <= CACHE:
            known.update((u, f) for u, f in fresh.items() if len(u) <= LONG)
            look = known if all(len(u) <= LONG for u in new) else known | {u: f for u, f in fresh.items() if len(u) > LONG}
        else:
            look = {**fresh, **{u: known[u] for r in rows for u in r if u in known}}
        end = np.array([self.vocabulary.end], "<i4").tobytes()
        flat = [b"".join([look[u] for u in r]) + end for r in rows]
        offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in flat])))
        return np.frombuffer(b"".join(flat), "<i4"), offsets


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with the end id) and decoded, the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids, offsets = encoder([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists, encoder.vocabulary.decode_rows(ids, offsets)], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids (null ids: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            ids = np.array([i for x in lists for i in x], np.int64)
            texts = vocabulary.decode_rows(ids, np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), texts], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
