"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are packed into blocks: per vector an int8 code with a scale, the norm of
the code's vector and the norm of what the code leaves out. Blocks of queries meet
strips of candidate blocks. A tile of code products gives every inner product up to
a bound (Cauchy-Schwarz on the remainders); only pairs whose upper bound reaches the
k-th largest lower bound are computed again from the original floats in double
precision. A heap for every query keeps a strip's k best, and the strips' bests are
merged by rank.

The tiles are all pairs of a query and a candidate, which the task asks for; what is
shuffled are packed blocks (queries x strips) and k rows a query and strip.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Tables, as_id

BLOCK = 1024
QUERY_BLOCKS, STRIP = 4, 16
PACKED = "block bigint, dim int, ids binary, vectors binary, codes binary, scale binary, size binary, rest binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, size, rest): x is near scale * codes, which has norm ``size``; ``rest`` bounds the norm of the difference."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    slack = 1 + 1e-9
    return codes, scale, np.linalg.norm(near, axis=1) * slack, np.linalg.norm(x - near, axis=1) * slack


def _pack(block: int, kind: type):
    names = ("block", "dim", "ids", "vectors", "codes", "scale", "size", "rest")
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32())] + [(n, pa.binary()) for n in names[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def flush(dim: int):
            nonlocal number
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            for at in range(0, len(ids), block):
                v = x[at : at + block]
                codes, scale, size, rest = quantise(v)
                parts = [ids[at : at + block], v.astype(kind), codes, scale, size, rest]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], schema=schema)
                number += 1

        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[mine], flat[starts[mine][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= block:
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return run


class Best:
    """For each query of a block, the k best so far, and a lower bound of its k-th best."""

    def __init__(self, ids: np.ndarray, k: int):
        self.k = k
        self.floor = np.full(len(ids), -np.inf)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # (score, -id), the worst on top

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Larger scores are better, then smaller ids."""
        for q, item in zip(query.tolist(), zip(score.tolist(), (-ids).tolist(), strict=True), strict=True):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.floor[q] = heap[0][0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that the heaps hold."""
        found = [(q, -minus, score) for q, heap in enumerate(self.heaps) for score, minus in heap]
        query, ids, score = zip(*found, strict=True) if found else ((), (), ())
        return np.array(query, np.int64), np.array(ids, np.int64), np.array(score, np.float64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: partial sums of int8 products over 1024 components fit a float32."""
    total = 0.0
    for j in range(0, a.shape[1], 1024):
        total = total + (a[:, j : j + 1024].astype(np.float32) @ b[:, j : j + 1024].astype(np.float32).T).astype(np.float64)
    return total


def _unpacked(table: pa.Table, i: int) -> tuple[np.ndarray, ...]:
    row = {n: table.column(n)[i].as_py() for n in ("dim", "ids", "vectors", "codes", "scale", "size", "rest")}
    shape = (-1, row["dim"])
    codes = np.frombuffer(row["codes"], np.int8).reshape(shape)
    x = np.frombuffer(row["vectors"], np.float64 if len(row["vectors"]) == 8 * codes.size else np.float32).reshape(shape).astype(np.float64)
    return np.frombuffer(row["ids"], np.int64), x, codes, *(np.frombuffer(row[c], np.float64) for c in ("scale", "size", "rest"))


def search_tile(queries: tuple, candidates: tuple, best: Best) -> None:
    """Merge a tile's survivors into ``best``."""
    qid, qx, qc, qscale, qsize, qrest = queries
    cid, cx, cc, cscale, csize, crest = candidates
    near = _code_products(qc, cc) * qscale[:, None] * cscale[None, :]
    # |<q,c> - <q',c'>| = |<q-q',c> + <q',c-c'>|, and |c| <= |c'| + |c-c'|
    off = qrest[:, None] * (csize + crest)[None, :] + qsize[:, None] * crest[None, :]
    off += 1e-12 * (np.abs(near) + off)
    own = qid[:, None] == cid[None, :]
    low = np.where(own, -np.inf, near - off)
    floor = best.floor
    if len(cid) > best.k:
        floor = np.maximum(floor, np.partition(low, len(cid) - best.k, axis=1)[:, len(cid) - best.k])
    q, c = np.nonzero((near + off >= floor[:, None]) & ~own)
    for at in range(0, len(q), 1 << 15):
        i, j = q[at : at + (1 << 15)], c[at : at + (1 << 15)]
        score = inner(qx[i], cx[j])
        good = score >= best.floor[i]
        best.add(i[good], cid[j[good]], score[good])


def _search(k: int):
    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        for i in range(queries.num_rows):
            mine = _unpacked(queries, i)
            best = Best(mine[0], k)
            for j in range(candidates.num_rows):
                search_tile(mine, _unpacked(candidates, j), best)
            query, ids, score = best.rows()
            out.append(pa.table({"query_id": mine[0][query], "vec_id": ids, "score": score}))
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *out])

    return cell


def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every query by inner product.

    Queries are the rows for which the column ``queries`` holds, candidates all rows
    with another id. Scores are in double precision on the original vectors;
    rank 1 is the largest, equal scores go to the smaller vec_id. Rows whose id or
    vector is null, or whose vector is empty, zero, or holds null, NaN or infinite
    components take no part; vectors of different length don't meet. Rows that
    repeat an id are one candidate each; as queries they share their ranks. With
    fewer than k candidates all are returned. Other columns are not read.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    single = vectors.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64  # of the originals, without loss
    own = vectors.select(as_id(vectors, id_col).alias("id"), vector.alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    sound = F.expr("id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    own = own.where(sound)
    codes = own.where("is_query").select("id", "vector").dropDuplicates(["id", "vector"])
    q = tables.write(codes.mapInArrow(_pack(block, kind), PACKED), "queries")
    c = tables.write(own.select("id", "vector").mapInArrow(_pack(block, kind), PACKED), "candidates")
    rows, columns = (df.count() // n + 1 for df, n in ((q, QUERY_BLOCKS), (c, STRIP)))
    q = q.withColumn("row", F.pmod(F.xxhash64("block"), F.lit(rows))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    c = c.withColumn("column", F.pmod(F.xxhash64("block"), F.lit(columns))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cells = [df.withColumns({n: F.col(n).cast("long") for n in ("row", "column")}).groupBy("dim", "row", "column") for df in (q, c)]
    found = cells[0].cogroup(cells[1]).applyInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
