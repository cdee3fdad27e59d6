"""SentencePiece encoding and decoding by suffix-array matching.

A text falls into parts that no piece can cross (a run of spaces with the word after it).
The parts of a batch that are new are written one after another, and a suffix array
over them is built. Every piece of the vocabulary is searched in it by halves; the range
that it finds holds all places where the piece occurs. These edges, put in order of
position, are then relaxed. The public vocabulary is a BPE one, for which the right
result is not the best path but the best merge at every step: in each round every part
joins the two neighbours whose edge has the highest score, the leftmost of equals,
until no edge joins two.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import as_id, list_array, slices

SPACE = "▁"
LONG = 400
KEPT_PARTS = 300_000
PER_KEY = 4


class Vocabulary:
    """Pieces and scores of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.spelt: list[bytes] = [b""] * n
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.spelt[i] = bytes([int(piece[1:-1], 16)])
            elif sp.is_unknown(i):
                self.spelt[i] = " ⁇ ".encode()
            elif not (sp.is_control(i) or sp.is_unused(i)):
                self.spelt[i] = piece.replace(SPACE, " ").encode()
                plain.append((piece, i, sp.get_score(i)))
        self.single = {p: i for p, i, _ in plain if len(p) == 1}
        alphabet = sorted({c for p, _, _ in plain for c in p})
        self.code = {c: k + 2 for k, c in enumerate(alphabet)}  # 0 ends a part, 1 is any other character
        if len(alphabet) > 65_000:
            raise ValueError("too many characters for 16-bit codes")
        pieces = sorted((p, i, s) for p, i, s in plain if len(p) > 1)
        self.longest = max((len(p) for p, _, _ in pieces), default=2)
        self.ids = np.array([i for _, i, _ in pieces], np.int32)
        self.lengths = np.array([len(p) for p, _, _ in pieces], np.int32)
        scores = np.array([s for _, _, s in pieces])
        _, rank = np.unique(scores, return_inverse=True)
        self.rank = (rank + 1).astype(np.int64)  # larger is better; 0 is no edge
        self.keys = -(-self.longest // PER_KEY)
        codes = np.zeros((len(pieces), self.keys * PER_KEY), np.uint64)
        for k, (p, _, _) in enumerate(pieces):
            codes[k, : len(p)] = [self.code[c] for c in p]
        high = np.where(codes == 0, np.uint64(0xFFFF), codes)
        self.low, self.high = self._packed(codes), self._packed(high)
        self.lookup = np.ones(0x110000, np.uint16)
        for c, k in self.code.items():
            self.lookup[ord(c)] = k
        joined = {(ord(a) << 21) | ord(b) for p, _, _ in pieces for a, b in zip(p, p[1:], strict=False)}
        self.joined = np.array(sorted(joined), np.int64)  # neighbours within a piece
        crossed = any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces)
        newline = any("\n" in p for p, _, _ in pieces)
        self.part = re.compile(r"(?s).+" if crossed or newline else rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    @staticmethod
    def _packed(codes: np.ndarray) -> np.ndarray:
        shape = codes.reshape(len(codes), -1, PER_KEY)
        out = np.zeros(shape.shape[:2], np.uint64)
        for j in range(PER_KEY):
            out |= shape[:, :, j] << np.uint64(16 * (PER_KEY - 1 - j))
        return out.T.copy()

    def cut(self, part: str) -> list[str]:
        """A long part cut between neighbours that stand in no piece, where nothing can merge."""
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64)
        apart = ~np.isin(points[:-1] << 21 | points[1:], self.joined)
        ends = [0, *(np.flatnonzero(apart) + 1).tolist(), len(part)]
        return [part[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, pieces): all occurrences of pieces of two characters or more, in order of place."""
        n, width = len(codes), self.keys * PER_KEY
        padded = np.concatenate((codes.astype(np.uint64), np.zeros(width, np.uint64)))
        first = np.zeros(n + width - PER_KEY + 1, np.uint64)
        for j in range(PER_KEY):
            first |= padded[j : j + len(first)] << np.uint64(16 * (PER_KEY - 1 - j))
        keys = [first[PER_KEY * k : PER_KEY * k + n] for k in range(self.keys)]
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        begin = np.searchsorted(keys[0], self.low[0], "left")
        end = np.searchsorted(keys[0], self.high[0], "right")
        deeper = np.flatnonzero((self.lengths > PER_KEY) & (begin < end))
        begin[deeper], end[deeper] = self._narrow(keys, self.low, deeper, begin, end, False), self._narrow(keys, self.high, deeper, begin, end, True)
        sizes = np.maximum(end - begin, 0)
        pieces = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(pieces))
        places = suffixes[at]
        order = np.argsort(places, kind="stable")
        return places[order], pieces[order]

    def _narrow(self, keys: list, bound: np.ndarray, which: np.ndarray, begin: np.ndarray, end: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of the bounds of many pieces at once, over all keys of the suffixes."""
        low, high = begin[which].copy(), end[which].copy()
        wanted = [b[which] for b in bound]
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = np.minimum(mid, len(keys[0]) - 1)
            less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
            for key, b in zip(keys, wanted, strict=True):
                k = key[at]
                less |= same & (k < b)
                same &= k == b
            go = open_ & (less | same if right else less)
            low = np.where(go, mid + 1, low)
            high = np.where(open_ & ~go, mid, high)
        return low

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all parts, and how many each has."""
        text = "\0".join(parts) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        codes = self.lookup[points]
        codes[starts + lengths] = 0
        places, pieces = self.edges(codes)
        # of each place and length, the edge's rank and id
        width = self.longest + 1
        rank = np.zeros(len(codes) * width, np.int32)
        spot = places * width + self.lengths[pieces]
        rank[spot] = self.rank[pieces]
        ids = np.zeros(len(codes) * width, np.int32)
        ids[spot] = self.ids[pieces]
        inside = codes > 0
        inside[:] = True
        inside[starts + lengths] = False
        at = np.flatnonzero(inside)
        part = np.repeat(np.arange(len(parts)), lengths)
        is_long = lengths > LONG
        done_at, done_end = [], []
        for p in np.flatnonzero(is_long):
            a, e = self._merge_long(int(starts[p]), int(lengths[p]), rank, width)
            done_at.append(a)
            done_end.append(e)
        live = ~is_long[part]
        a, e = self._merge(at[live], part[live], rank, width)
        done_at.append(a)
        done_end.append(e)
        at, end = np.concatenate(done_at), np.concatenate(done_end)
        order = np.argsort(at, kind="stable")
        at, end = at[order], end[order]
        owner = np.searchsorted(starts, at, "right") - 1
        return self._ids(at, end, owner, points, ids, width, len(parts))

    def _merge(self, at: np.ndarray, part: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over all parts at once; each joins one pair in every part that still has an edge."""
        end = at + 1
        done_at, done_end = [], []
        while len(at):
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            span = np.zeros(len(at), np.int64)
            span[:-1] = np.where(part[1:] == part[:-1], end[1:] - at[:-1], 0)
            fits = (span > 0) & (span < width)
            key = np.where(fits, rank[at * width + np.where(fits, span, 0)], 0).astype(np.int64)
            best = np.maximum.reduceat((key << 32) | (0xFFFFFFFF - np.arange(len(at))), first)
            more = best >> 32 > 0
            chosen = 0xFFFFFFFF - (best[more] & 0xFFFFFFFF)
            end[chosen] = end[chosen + 1]
            keep = np.repeat(more, np.diff(np.append(first, len(at))))
            done_at.append(at[~keep])
            done_end.append(end[~keep])
            keep[chosen + 1] = False
            at, end, part = at[keep], end[keep], part[keep]
        return np.concatenate(done_at or [at]), np.concatenate(done_end or [at])

    @staticmethod
    def _merge_long(start: int, n: int, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long part, with a heap."""
        table = rank[start * width : (start + n) * width].reshape(n, width)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (size := after[j] - i) < width and (r := int(table[i, size])):
                heapq.heappush(heap, (-r, i, size))

        for i in range(n):
            push(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] - i != size:
                continue
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        at = np.flatnonzero(alive)
        return start + at, start + np.append(at[1:], n)

    def _ids(self, at: np.ndarray, end: np.ndarray, owner: np.ndarray, points: np.ndarray, ids: np.ndarray, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols; a character that is no piece becomes the ids of its bytes."""
        out = ids[at * width + (end - at)]
        alone = np.flatnonzero(end - at == 1)
        chars, inverse = np.unique(points[at[alone]], return_inverse=True)
        spelt = []
        for c in chars.tolist():
            i = self.single.get(chr(c))
            spelt.append([i] if i is not None else self.byte_ids[list(chr(c).encode())].tolist())
        count = np.ones(len(at), np.int64)
        count[alone] = np.array([len(s) for s in spelt], np.int64)[inverse] if len(alone) else 0
        out[alone] = np.array([s[0] for s in spelt], np.int32)[inverse] if len(alone) else 0
        sizes = np.bincount(owner, count, parts).astype(np.int64)
        wide = np.flatnonzero(count > 1)
        if len(wide):
            places = np.cumsum(count) - count
            full = np.repeat(out, count)
            which = np.empty(len(at), np.int64)
            which[alone] = inverse
            for k in wide.tolist():
                full[places[k] : places[k] + count[k]] = spelt[which[k]]
            out = full
        return out.astype(np.int32), sizes

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of some ids; the space that encoding puts in front goes."""
        if ids is None:
            return None
        spelt = self.spelt
        text = b"".join([spelt[i] if 0 <= i < len(spelt) else b"" for i in ids]).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes batches of texts; remembers the ids of parts, up to KEPT_PARTS of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.start, self.size = np.empty(KEPT_PARTS, np.int64), np.empty(KEPT_PARTS, np.int64)

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.number]
        if len(self.number) + len(new) > KEPT_PARTS:
            self._forget()
            new = list(parts)
        if len(new) > len(self.start):
            self.start, self.size = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        at = 0
        while at < len(new):
            to, chars = at, 0
            while to < len(new) and (to == at or chars < 250_000):
                chars += len(new[to]) + 1
                to += 1
            ids, sizes = self.v.encode_parts(new[at:to])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
            self.flat[self.used : self.used + len(ids)] = ids
            n = len(self.number)
            self.size[n : n + len(sizes)] = sizes
            self.start[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.number.update(zip(new[at:to], range(n, n + len(sizes)), strict=True))
            self.used += len(ids)
            at = to

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool | None]]:
        """(ids, sizes, same): the ids of all texts, how many each has, and whether decoding them gives it back."""
        parts: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            if t:
                own = self.v.part.findall(SPACE + t.replace(" ", SPACE))
                if max(map(len, own)) > LONG:
                    own = [x for p in own for x in (self.v.cut(p) if len(p) > LONG else (p,))]
                parts += own
            ends[k + 1] = len(parts)
        self._learn(set(parts))
        number = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        sizes = self.size[number]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.start[number] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[ends].tolist()
        same = [None if t is None else self.v.decode(ids[i:j].tolist()) == t for t, i, j in zip(texts, bounds, bounds[1:], strict=False)]
        return ids, np.diff(total[ends]), same


@lru_cache(2)
def shared_encoder(model: bytes) -> Encoder:
    """A worker's encoder, which its tasks use one after another."""
    return Encoder(Vocabulary(model))


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file, at most 64 MB, read by Spark so that it may lie in any store."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").where(f"length <= {64 << 20}").first()
    if row is None:
        raise ValueError(f"{path} is larger than 64 MB")
    return bytes(row["content"])


def encode(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip), a row for each row of ``docs``.

    ``model`` holds a SentencePiece BPE model with an identity normaliser that
    puts one space before a text. round_trip says whether decoding gives the text
    back, which it does unless the text contains the space mark U+2581; every row's ids are decoded to tell. A null or
    empty text has no tokens, and round_trip is null for a null one. Texts are encoded whole, in one task; a run of characters
    without a space, and without neighbours that no piece has, takes memory of about 480 bytes a character. Rows are independent,
    so repeated or null ids don't matter. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, sizes, same = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), list_array(ids, sizes, pa.int32()), pa.array(same, pa.bool_())], schema=schema)

    own = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: bytes, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text), a row for each row of ``tokens``: token ids back to text. A null list gives null, an empty one an empty text; null ids,
    ids outside the vocabulary and control ids give nothing. Rows are independent, so repeated or null doc_ids don't matter. Other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared_encoder(model).v
        for batch in batches:
            texts = [vocabulary.decode(x.as_py() and [i for i in x.as_py() if i is not None] if x.is_valid else None) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t if t is not None else None for t in texts], pa.string())], schema=schema)

    own = tokens.select(as_id(tokens, id_col).alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return own.mapInArrow(run, "doc_id bigint, text string")
