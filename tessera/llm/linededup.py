"""Line dedup by pairwise alignment of documents that share rare lines.

Lines that only one document holds never align, so a run of them is one gap, and documents
with the same shared lines and gaps are one class: what a pair aligns depends on
their classes alone. Two classes overlap if they share a rare line, one that few classes hold.
Every overlapping pair is aligned, and each class with itself: lines that stand once in both
anchor a patience diff, and the aligned common blocks go from the later document. A line that more
classes hold opens no pairs: it goes from all documents but the first that
holds it, which is all that alignment with each of its holders could take. Pairs therefore grow with
the lines, not with the square of a group, and nothing is left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import Tables, as_id, free_names, list_slices, slices

RARE = 16


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, size) of the blocks that a patience diff aligns, in order."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_a = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        pairs = [(at_a[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at_a]
        low_a, low_b = a0, b0
        for i, j in _rising(pairs):
            todo.append((low_a, i, low_b, j))
            matched.append((i, j))
            low_a, low_b = i + 1, j + 1
        if pairs:
            todo.append((low_a, a1, low_b, b1))
    blocks: list[list[int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by their second places, whose first places rise."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        before[k] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(i)
            last.append(k)
        else:
            tails[at], last[at] = i, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def text_lines(text: str) -> list[str]:
    """The lines of a text that are more than white space, trimmed."""
    return [x for x in map(str.strip, text.split("\n")) if x]


def _line_hashes() -> object:
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            lines = [text_lines(t) for t in batch.column("text").to_pylist()]
            hashes = [[xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in doc] for doc in lines]
            sizes = [[len(x) for x in doc] for doc in lines]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], schema=schema)

    return run


def _projected() -> object:
    """A document's shared lines with gaps (null, of size 0), their class, and where the lines are."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("c", pa.binary()), ("at", pa.list_(pa.int32())), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in list_slices(batches, "shared"):
            out = []
            for n, shared in zip(part.column("n").to_pylist(), part.column("shared").to_pylist(), strict=True):
                lines: list[int | None] = []
                sizes, at, then = [], [], 0
                for x in [*shared, {"pos": n}]:
                    if x["pos"] > then:
                        lines.append(None)
                        sizes.append(0)
                    if x["pos"] < n:
                        lines.append(x["line"])
                        sizes.append(x["size"])
                        at.append(x["pos"])
                    then = x["pos"] + 1
                key = repr([*zip(lines, sizes, strict=True)]).encode()
                out.append((xxhash.xxh3_128_digest(key), at, lines, sizes))
            columns = [*zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return run


def _aligned(least: int) -> object:
    """Which shared lines of a class (counted without gaps) an earlier class takes."""
    schema = pa.schema([("c", pa.binary()), ("need", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in list_slices(batches, "lines", "earlier"):
            gone = []
            for mine, sizes, theirs in zip(*(part.column(c).to_pylist() for c in ("lines", "sizes", "earlier")), strict=True):
                rank = [*accumulate(x is not None for x in mine)]
                blocks = common_blocks(mine, ["" if x is None else x for x in theirs])
                gone.append([rank[k] - 1 for i, _, n in blocks if sum(sizes[i : i + n]) >= least for k in range(i, i + n)])
            yield pa.RecordBatch.from_arrays([part.column("c"), part.column("need"), pa.array(gone, pa.list_(pa.int32()))], schema=schema)

    return run


def _deleted(text_col: str, gone_col: str, counted: tuple[str, str]) -> object:
    """Delete lines from the column ``text_col``, and count; the other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            counts, cut, texts = [], [], []
            for text, gone in zip(batch.column(text_col).to_pylist(), batch.column(gone_col).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                full = [k for k, x in enumerate(lines) if x.strip()]
                drop = {full[k] for k in gone or []}
                counts.append(len(full))
                cut.append(len(drop))
                texts.append(text if not drop else "\n".join(x for k, x in enumerate(lines) if k not in drop))
            new = {text_col: pa.array(texts, pa.string()), counted[0]: pa.array(counts, pa.int64()), counted[1]: pa.array(cut, pa.int64())}
            names = [n for n in batch.schema.names if n != gone_col]
            names += [n for n in new if n not in names]
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)

    return run


def _classes(lines: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(id, h, c, at) of the documents with shared lines; (c, first, last, lines, sizes) of their classes."""
    each = lines.select("id", "h", F.size("lines").alias("n"), F.posexplode(F.arrays_zip("lines", "sizes")).alias("pos", "x"))
    each = each.select("id", "h", "n", "pos", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    shared = each.groupBy("line").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("line")
    own = each.join(tables.write(shared, "shared").hint("merge"), "line").groupBy("id", "h", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "size"))).alias("shared"))
    members = tables.write(own.mapInArrow(_projected(), "id bigint, h bigint, c binary, at array<int>, lines array<bigint>, sizes array<int>"), "members")
    same = [F.first(c).alias(c) for c in ("lines", "sizes")]
    classes = members.groupBy("c").agg(F.min("id").alias("first"), F.max("id").alias("last"), *same)
    return members.select("id", "h", "c", "at"), tables.write(classes, "classes")


def _pairs(held: DataFrame, holders: DataFrame, rare: int) -> DataFrame:
    """(c, p): classes that share a rare line, if a document of c comes after the first of p; and a class with itself."""
    few = held.join(holders.where(f"classes > 1 and classes <= {rare}").select("line").hint("merge"), "line")
    mine, theirs = few.select("line", "c", "last"), few.select("line", F.col("c").alias("p"), "first")
    own = held.where("first < last").select("c", F.col("c").alias("p"))
    return mine.hint("merge").join(theirs, "line").where("c <> p and first < last").select("c", "p").union(own).distinct()


def _needs(classes: DataFrame, rare: int, least: int, tables: Tables) -> DataFrame:
    """(c, needs): a document of the class c loses its shared line k if its doc_id is over the ``need`` of k."""
    each = classes.select("c", "first", "last", F.posexplode(F.expr("filter(arrays_zip(lines, sizes), x -> x.lines is not null)")).alias("k", "x"))
    each = each.select("c", "first", "last", "k", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    held = tables.write(each.select("line", "c", "first", "last").distinct(), "held")
    holders = tables.write(held.groupBy("line").agg(F.count("*").alias("classes"), F.min("first").alias("need")), "holders")
    often = each.where(f"size >= {least}").join(holders.where(f"classes > {rare}").select("line", "need").hint("merge"), "line").where("need < last").select("c", "k", "need")
    pairs = tables.write(_pairs(held, holders, rare), "pairs")
    earlier = classes.select(F.col("c").alias("p"), F.col("first").alias("need"), F.col("lines").alias("earlier"))
    both = pairs.join(classes.select("c", "lines", "sizes").hint("merge"), "c").join(earlier.hint("merge"), "p").select("c", "lines", "sizes", "earlier", "need")
    gone = both.mapInArrow(_aligned(least), "c binary, need bigint, gone array<int>").select("c", F.explode("gone").alias("k"), "need")
    needs = gone.unionByName(often).groupBy("c", "k").agg(F.min("need").alias("need"))
    return tables.write(needs.groupBy("c").agg(F.collect_list(F.struct("k", "need")).alias("needs")), "needs")


def remove_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text), a row for each row of ``docs``.

    Lines are what newlines part, trimmed; those of white space only don't count. A document is
    aligned, by patience diff, with each document of smaller doc_id that shares a rare line with it or is of its class
    (the same shared lines, parted alike), both as they came in. Lines in an aligned common block of at least ``least_chars`` characters (1: of any size) go
    from the later document. A line that is not rare, because more than ``rare`` classes of documents hold it, goes from
    every document but those of its least doc_id, if it has ``least_chars`` characters itself. Other lines, and empty ones, stay as they are.
    A null or empty text stays as it is, with no lines. Rows without
    doc_id are left alone. Rows that repeat a doc_id are never aligned with each other;
    with the same text they share what is deleted. Other columns are not read. A text is read
    whole, by one task, however long.
    """
    both = docs.select(as_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = without_common_lines(both, rare=rare, least_chars=least_chars, counted=("n_lines", "n_deleted"))
    return out.select("doc_id", "n_lines", "n_deleted", "text")


def without_common_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least_chars: int = 1, counted: tuple[str, str] = ("__n_lines", "__n_deleted")
) -> DataFrame:
    """As remove_common_lines, but with all columns of ``docs`` and then the two counts, under the names ``counted`` (columns of ``docs`` that bear these are replaced)."""
    tables = Tables(docs.sparkSession)
    docs = docs.drop(*(c for c in counted if c not in (id_col, text_col)))
    if set(counted) & {id_col, text_col}:
        raise ValueError(f"{counted} are to name the counts, not columns that are read")
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(as_id(docs, id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    held = own.where("id is not null and text is not null").mapInArrow(_line_hashes(), "id bigint, h bigint, lines array<bigint>, sizes array<int>")
    lines = tables.write(held.dropDuplicates(["id", "h"]), "lines")
    members, classes = _classes(lines, tables)
    needs = _needs(classes, rare, least_chars, tables)
    key, h, gone_col = free_names(docs.columns, "id", "h", "gone")
    gone = members.join(needs.hint("merge"), "c").select(F.col("id").alias(key), F.col("h").alias(h), F.expr("transform(filter(needs, x -> x.need < id), x -> at[x.k])").alias(gone_col))
    gone = tables.write(gone.where(F.size(gone_col) > 0), "deleted")
    tables.drop("lines", "shared", "members", "classes", "held", "holders", "pairs", "needs")
    keyed = docs.withColumns({key: as_id(docs, id_col), h: F.xxhash64(text)})
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in counted)])
    return keyed.join(gone.hint("merge"), [key, h], "left").select(*(F.col(f"`{c}`") for c in docs.columns), gone_col).mapInArrow(_deleted(text_col, gone_col, counted), schema)
