"""Exact removal of long repeats by recompression.

Every document is rewritten in rounds, as in Jez's recompression: the first round
names maximal runs of one symbol, and each round, with the alphabet split in two by a bit of
each symbol, names every pair of a left and a right symbol. (Runs in later rounds would make
every symbol depend on its neighbours' words, and few would then fit into a window.) A name is a 64-bit
function of what it replaces, so all tasks name alike, without an exchange. Equal
substrings therefore carry the same symbols in their interior. Beside its span, each
symbol keeps the words on which its forming depended; where those lie within a window
of ``window`` words, the symbol occurs wherever that window does.

A Spark aggregation then finds the symbols that occur twice. A window that holds
a symbol seen only once cannot repeat; the windows left over are verified by a
128-bit hash of all their words, from two independent hashes of each word, again by a distributed aggregation. Symbols decide
only what is verified, so the result is exact up to collisions of those 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, TwoHashes, as_id, mix, odd_constants, slices

ROUNDS = 6
RUN_ROUNDS = (0,)
SEEDS = odd_constants(4 * 16, 23)
BASES = odd_constants(2, 29)


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(names, low, high): symbols after ``rounds`` and the words that each depends on.

    ``words`` holds the hashes of the words of several documents, ``doc`` the document of each.
    A symbol that depends on its document's edge has a low or high beyond the document.
    """
    sym, d = words, doc
    low = np.arange(len(words), dtype=np.int64)
    high = low + 1
    for r in range(rounds):
        if len(sym) < 2:
            break
        seed = SEEDS[4 * r : 4 * r + 4]
        near = d[1:] == d[:-1]
        before = np.where(np.concatenate(([False], near)), np.concatenate((low[:1], low[:-1])), low - 1)
        after = np.where(np.concatenate((near, [False])), np.concatenate((high[1:], high[-1:])), high + 1)
        if r in RUN_ROUNDS:
            starts = np.flatnonzero(np.concatenate(([True], ~(near & (sym[1:] == sym[:-1])))))
            sizes = np.diff(np.append(starts, len(sym)))
            low, high, d = before[starts], after[starts + sizes - 1], d[starts]
            sym = np.where(sizes > 1, mix(sym[starts] * seed[0] + sizes.astype(np.uint64)), sym[starts])
            near = d[1:] == d[:-1]
            before = np.where(np.concatenate(([False], near)), np.concatenate((low[:1], low[:-1])), low - 1)
            after = np.where(np.concatenate((near, [False])), np.concatenate((high[1:], high[-1:])), high + 1)
        right = (mix(sym + seed[1]) >> np.uint64(63)).astype(bool)
        pair = np.concatenate((near & ~right[:-1] & right[1:], [False]))
        second = np.concatenate(([False], pair[:-1]))
        alone = ~pair & ~second
        at = np.flatnonzero(~second)
        follower = np.minimum(at + 1, len(sym) - 1)
        paired = pair[at]
        named = mix(mix(sym[at] * seed[2]) + sym[follower] * seed[3])
        new_low = np.where(alone[at] & right[at], np.minimum(before[at], low[at]), low[at])
        new_low = np.where(paired, np.minimum(low[at], low[follower]), new_low)
        new_high = np.where(alone[at] & ~right[at], np.maximum(after[at], high[at]), high[at])
        new_high = np.where(paired, np.maximum(high[at], high[follower]), new_high)
        sym, low, high, d = np.where(paired, named, sym[at]), new_low, new_high, d[at]
    return sym, low, high


class Chunk:
    """The words of some documents, one after another."""

    def __init__(self, packed: bytes, lengths: bytes, cache: TwoHashes, window: int):
        self.words = unpack(packed, lengths)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.window = window
        self.both = cache.of([w for doc in self.words for w in doc])
        self.hashes = self.both[0]
        self.doc = np.repeat(np.arange(len(self.words)), self.sizes)
        n = max(0, len(self.hashes) - window + 1)
        self.starts = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n else np.empty(0, np.int64)

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the symbols that fit into a window of their document, and the first and last such window."""
        names, low, high = parse(self.hashes, self.doc)
        first = np.maximum(high - self.window, 0)
        fits = (high - low <= self.window) & (low >= 0)
        return names[fits], first[fits], low[fits]

    def candidates(self, names: np.ndarray, first: np.ndarray, last: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold no symbol seen only once."""
        once = np.zeros(len(self.hashes) + 2, np.int64)
        np.add.at(once, first[~shared], 1)
        np.add.at(once, last[~shared] + 1, -1)
        return self.starts[np.cumsum(once)[self.starts] == 0]

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words of each window."""
        out = []
        for base, hashes in zip(BASES, self.both, strict=True):
            h = mix(hashes + base)
            with np.errstate(over="ignore"):
                total = h[starts] if len(starts) else np.empty(0, np.uint64)
                for j in range(1, self.window):
                    total = total * base + h[starts + j]
            out.append(mix(total))
        return out[0], out[1]


def unpack(packed: bytes, lengths: bytes) -> list[list[bytes]]:
    """The words of each text of a packed chunk."""
    data = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
    return [data[i:j].split() for i, j in zip([0, *ends], ends, strict=False)]


def _make_chunks():
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("packed", pa.binary()), ("lengths", pa.binary()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            data = b"".join(texts)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column("id")]))
            lengths = np.array([len(t) for t in texts], np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k]), ids, pa.array([pack.compress(data)], pa.binary()), pa.array([lengths], pa.binary()), pa.array([len(data)])], schema=schema)
            k += 1

    return run


def _distinct(k0: np.ndarray, k1: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order of the distinct keys' first places, each key's index among them)."""
    order = np.argsort(k0, kind="stable") if k1 is None else np.lexsort((k1, k0))
    s0 = k0[order]
    new = np.ones(len(order), bool)
    new[1:] = s0[1:] != s0[:-1]
    if k1 is not None:
        s1 = k1[order]
        new[1:] |= s1[1:] != s1[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


class Asked:
    """A chunk's distinct keys in order of their bucket; asked for in blocks, answered by bits."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray | None, buckets: int):
        places, inverse = _distinct(k0, k1)
        self.k0 = k0[places]
        self.k1 = None if k1 is None else k1[places]
        # keys ascend, so buckets that are ranges of keys are slices
        span = (1 << 64) // buckets + 1
        bucket = (self.k0 // np.uint64(span)).astype(np.int64)
        self.found, self.at = np.unique(bucket, return_index=True)
        self.inverse = inverse
        self.twice = np.bincount(inverse, minlength=len(places)) > 1

    def blocks(self) -> list[dict]:
        ends = np.append(self.at, len(self.k0))[1:]
        return [{"bucket": int(b), "k0": self.k0[i:j].tobytes(), "k1": None if self.k1 is None else self.k1[i:j].tobytes()} for b, i, j in zip(self.found, self.at, ends, strict=True)]

    def shared(self, answers: list[dict] | None) -> np.ndarray:
        """For each key asked with, whether it occurs twice or more."""
        by = {a["bucket"]: a["bits"] for a in answers or []}
        ends = np.append(self.at, len(self.k0))[1:]
        bits = [np.unpackbits(np.frombuffer(by[int(b)], np.uint8), count=j - i) for b, i, j in zip(self.found, self.at, ends, strict=True)]
        known = np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)
        return (known | self.twice)[self.inverse]


ASK = "chunk bigint, blocks array<struct<bucket:bigint,k0:binary,k1:binary>>"


def _block_type() -> pa.DataType:
    return pa.list_(pa.struct([("bucket", pa.int64()), ("k0", pa.binary()), ("k1", pa.binary())]))


def _ask_symbols(window: int, buckets: int):
    schema = pa.schema([("chunk", pa.int64()), ("blocks", _block_type())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TwoHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column("packed")[i].as_py(), batch.column("lengths")[i].as_py(), cache, window)
                asked = Asked(chunk.symbols()[0], None, buckets)
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([asked.blocks()], _block_type())], schema=schema)

    return run


def _ask_windows(window: int, buckets: int, then: int):
    schema = pa.schema([("chunk", pa.int64()), ("blocks", _block_type()), ("starts", pa.binary()), ("inverse", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TwoHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column("packed")[i].as_py(), batch.column("lengths")[i].as_py(), cache, window)
                names, first, last = chunk.symbols()
                shared = Asked(names, None, buckets).shared(batch.column("answers")[i].as_py())
                starts = chunk.candidates(names, first, last, shared)
                asked = Asked(*chunk.keys(starts), then)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk").slice(i, 1), pa.array([asked.blocks()], _block_type()), pa.array([starts.astype(np.int32).tobytes()]), pa.array([asked.inverse.astype(np.int32).tobytes()]), pa.array([np.packbits(asked.twice).tobytes()])],
                    schema=schema,
                )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket's blocks, which keys stand in two blocks or more."""
    k0 = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("k0")]
    sizes = np.array([len(x) for x in k0])
    k0 = np.concatenate(k0)
    k1 = None
    if table.column("k1").null_count == 0:
        k1 = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("k1")])
    _, inverse = _distinct(k0, k1)
    many = (np.bincount(inverse) > 1)[inverse]
    ends = np.cumsum(sizes)
    bits = [np.packbits(many[j - n : j]).tobytes() for n, j in zip(sizes, ends, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _answers(asks: DataFrame) -> DataFrame:
    blocks = asks.select("chunk", F.explode("blocks").alias("b")).select("chunk", "b.bucket", "b.k0", "b.k1")
    bits = blocks.groupBy("bucket").applyInArrow(_answer, "chunk bigint, bucket bigint, bits binary")
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = unpack(batch.column("packed")[i].as_py(), batch.column("lengths")[i].as_py())
                sizes = np.array([len(w) for w in words], np.int64)
                starts, inverse = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("starts", "inverse"))
                blocks, answers = batch.column("sizes")[i].as_py(), {a["bucket"]: a["bits"] for a in batch.column("answers")[i].as_py() or []}
                known = np.concatenate([np.unpackbits(np.frombuffer(answers[b["bucket"]], np.uint8), count=b["n"]) for b in blocks]) if blocks else np.empty(0, np.uint8)
                twice = np.unpackbits(np.frombuffer(batch.column("twice")[i].as_py(), np.uint8), count=len(known))
                hit = starts[(known | twice).astype(bool)[inverse]] if len(starts) else starts
                cover = np.zeros(int(sizes.sum()) + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                ends = np.cumsum(sizes)
                removed = np.zeros(len(words), np.int64)
                texts = []
                for k, w in enumerate(words):
                    cut = gone[ends[k] - sizes[k] : ends[k]]
                    removed[k] = int(cut.sum())
                    texts.append(b" ".join([x for x, c in zip(w, cut.tolist(), strict=True) if not c] if removed[k] else w).decode())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(sizes), pa.array(removed), pa.array(texts, pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, text), a row for each row of ``docs``.

    Words are runs of anything but ASCII white space. A word goes if some window of
    ``window`` consecutive words of its document covers it whose words also
    start anywhere else, in another row or in the same text; windows are those
    of the input. ``text`` holds the words left, joined by one space. A text that
    is null or shorter than a window keeps its words; rows without doc_id or with
    a repeated one are documents like others. Other columns are not read.

    Documents travel in packed chunks of about 1 MB of text. A chunk asks for its distinct keys (first
    symbols, then windows) in blocks, one for each range of keys, and gets
    bits back; a key that a third of the corpus shares is asked for once
    a chunk, so no task receives a group that grows with a key's frequency in rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    texts = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chunks = tables.write(texts.mapInArrow(_make_chunks(), "chunk bigint, ids array<bigint>, packed binary, lengths binary, n_bytes bigint"), "chunks")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, size // (24 << 20) + 1)
    bare = chunks.select("chunk", "packed", "lengths")
    asks = tables.write(bare.mapInArrow(_ask_symbols(window, buckets), ASK), "symbols")
    answers = tables.write(_answers(asks), "symbol-bits")
    tables.drop("symbols")
    known = bare.join(answers, "chunk", "left")
    asks = tables.write(known.mapInArrow(_ask_windows(window, buckets, buckets), f"{ASK}, starts binary, inverse binary, twice binary"), "windows")
    answers = tables.write(_answers(asks), "window-bits")
    tables.drop("symbol-bits")
    places = asks.select("chunk", "starts", "inverse", "twice", F.expr("transform(blocks, b -> struct(b.bucket, octet_length(b.k0) div 8 as n))").alias("sizes"))
    known = chunks.select("chunk", "ids", "packed", "lengths").join(places, "chunk").join(answers, "chunk", "left")
    return known.mapInArrow(_remove(window), "doc_id bigint, n_words bigint, n_removed bigint, text string")
