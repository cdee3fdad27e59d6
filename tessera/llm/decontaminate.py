"""Benchmark passages in documents by pigeonhole edit matching.

An item of m characters may occur with up to k = floor(rate * m) edits. Cut into
k + 1 pieces, at least one piece then stands unchanged in the document. An Aho-Corasick
automaton finds the pieces; each hit says where the item would lie, and Myers'
bit-parallel distance verifies that stretch of the document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_id, scratch_path, slices

BLOCK_CHARS = 2 << 20
HELD_BYTES = 8 << 20


def plain(text: str) -> str:
    """Lower case, and a space for each white-space character; as long as the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for c in "\n\t\r\v\f ":
        if c in low:
            low = low.replace(c, " ")
    return low


class Pattern:
    """An item with its bit masks for Myers' algorithm, forwards and backwards."""

    def __init__(self, text: str, budget: int):
        self.text, self.budget, self.m = text, budget, len(text)
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)
        self._masks: tuple[dict[str, int], dict[str, int]] | None = None

    def masks(self) -> tuple[dict[str, int], dict[str, int]]:
        if self._masks is None:
            there: dict[str, int] = defaultdict(int)
            back: dict[str, int] = defaultdict(int)
            for i, c in enumerate(self.text):
                there[c] |= 1 << i
                back[c] |= 1 << (self.m - 1 - i)
            self._masks = dict(there), dict(back)
        return self._masks

    def _best(self, text: str, masks: dict[str, int], anchored: bool) -> tuple[int, int]:
        """(distance, end) of the best match that ends in ``text``, the earliest of equals; it begins at 0 if ``anchored``."""
        full, top, score = self.full, self.top, self.m
        vp, vn, best, at = full, 0, self.m, 0
        carry = 1 if anchored else 0
        get = masks.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | vn
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp = vn | ~(xh | vp) & full
            hn = vp & xh
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1 | carry) & full
            vp = (hn << 1 | ~(xv | hp)) & full
            vn = hp & xv
            if score < best:
                best, at = score, j + 1
        return best, at

    def find(self, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item in ``text`` within its budget, or None."""
        if not self.budget:
            at = text.find(self.text)
            return None if at < 0 else (0, at, at + self.m)
        there, back = self.masks()
        distance, end = self._best(text, there, False)
        if distance > self.budget:
            return None
        _, size = self._best(text[max(0, end - self.m - distance) : end][::-1], back, True)
        return distance, end - size, end


class Matcher:
    """Finds many items in a text at once."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, Pattern(t, int(rate * len(t)))) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, p) in enumerate(self.items):
            k = p.budget + 1
            for j in range(k):
                a, b = p.m * j // k, p.m * (j + 1) // k
                pieces[p.text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end): the best match of each item that occurs, the earliest of equals."""
        text = plain(text)
        hits: dict[int, set[int]] = defaultdict(set)
        for end, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                hits[n].add(end - size + 1 - offset)
        out = []
        for n, places in hits.items():
            item, p = self.items[n]
            best = None
            for low, high in _merged(sorted(places), p.m):
                a = max(0, low - p.budget)
                if found := p.find(text[a : high + p.m + p.budget]):
                    found = found[0], found[1] + a, found[2] + a
                    best = min(best, found) if best else found
                    if not best[0]:
                        break
            if best:
                out.append((item, *best))
        return sorted(out)


def _merged(places: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of places that lie close together, none longer than ``most``."""
    low = high = places[0]
    for p in places[1:]:
        if p - low > most:
            yield low, high
            low = p
        high = p
    yield low, high


def _write_items(items: DataFrame, path: str) -> int:
    """Write items in blocks of about BLOCK_CHARS characters, by hash; the number of blocks."""
    n = int(items.agg((F.sum(F.length("text")) / BLOCK_CHARS).cast("long")).first()[0] or 0) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    items.withColumn("block", block).repartition(n, "block").write.partitionBy("block").parquet(path)
    return n


@lru_cache(1)
def _matcher(path: str, block: int, rate: float) -> Matcher | None:
    """The matcher of a block of items, read from the shared folder; a worker keeps its last one."""
    system, folder = fs.FileSystem.from_uri(f"{path}/block={block}")
    names = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
    if not names:
        return None
    found = dataset.dataset(names, pa.schema([("item_id", pa.int64()), ("text", pa.string())]), format="parquet", filesystem=system).to_table()
    items = [(i, plain(t.strip())) for i, t in zip(found.column("item_id").to_pylist(), found.column("text").to_pylist(), strict=True)]
    return Matcher([(i, t) for i, t in items if t], rate)


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.08) -> DataFrame:
    """(doc_id, item_id, distance, start, end): a row for each document row and item that occurs in it.

    An item occurs where the document comes within floor(rate * length) edits of it, case and
    kind of white space aside, whatever its length. ``distance``
    is the least found around intact pieces, ``start`` and ``end`` are character positions in
    the text of the earliest match with it. Items that are null, empty, or have
    no id are skipped, as are null texts, and an empty text holds none; a text is read whole, by one task, however long; repeated items and rows give rows of their own. Other
    columns are not read.

    Items lie in the shared folder in blocks of about 2 MB of text, whatever their number. The documents are passed once: a
    task holds some MB of them against one block's automaton after another.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    own = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    path = scratch_path(spark, "items")
    blocks = _write_items(wanted, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(slices(batches, "text"), HELD_BYTES):
            for block in range(blocks):
                matcher = _matcher(path, block, rate)
                for batch in held if matcher else ():
                    rows = [(i, *m) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in matcher.matches(t)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return own.mapInArrow(run, "doc_id bigint, item_id bigint, distance int, start bigint, end bigint")
