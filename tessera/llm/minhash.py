"""Near-duplicate documents by MinHash with banding.

Minima of many universal hash functions over a document's word shingles are
banded into bucket keys. Documents that share a bucket are compared: first two
bits of every minimum (a 256-bit signature), then the whole shingle sets. The links
that hold are merged by alternating large-star and small-star.

Large groups stay linear. Equal sets are one node from the start. Each bucket
then links its members to its centre, the member that stands in the largest
buckets. Only buckets that still span several components compare members of
different components; large ones only those that the size of their intersections
with the centre, or a shared shingle beyond it, lets be similar (see _remaining).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, WordHashes, as_id, list_array, mix, odd_constants, slices
from tessera.llm.components import connected_components

HASHES = 128
MISS = 1e-7  # most probability that no band of a pair at the threshold agrees
SMALL = 96  # members of a bucket whose pairs are all compared
SKETCH = ("s0", "s1", "t0", "t1")  # two bits of each minimum


def band_rows(percent: int) -> int:
    """The most minima a band can have while a pair at the threshold is missed with probability MISS at most: 4 at 80 percent, 5e-8."""
    s = percent / 100
    return next((r for r in (8, 6, 5, 4, 3, 2) if (1 - s**r) ** (HASHES // r) <= MISS), 1)


def sketch_most(percent: int) -> int:
    """Minima in whose two bits a pair at the threshold may differ: the mean and 6.2 standard deviations, 44 of 128 at 80 percent."""
    p = 0.75 * (1 - percent / 100)
    return min(HASHES, int(HASHES * p + 6.2 * (HASHES * p * (1 - p)) ** 0.5))


class Shingler:
    """Sets of hashed word shingles of many texts at once."""

    def __init__(self, words: int):
        self.k = words
        self.weights = odd_constants(words, 7)
        self.cache = WordHashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """A sorted array of distinct 64-bit shingle hashes for each text."""
        words, ends = [], []
        for t in texts:
            if t:
                words += t.encode().lower().split()
            ends.append(len(words))
        h = self.cache.of(words)
        n = len(h) - self.k + 1
        rolled = None
        if n > 0:
            rolled = np.zeros(n, np.uint64)
            for i in range(self.k):
                rolled += mix(h[i : i + n] + self.weights[i]) * self.weights[i]
            rolled = mix(rolled)
        out, at = [], 0
        for end in ends:
            if end - at >= self.k:
                out.append(np.unique(rolled[at : end - self.k + 1]))
            elif end > at:
                out.append(np.array([xxhash.xxh3_64_intdigest(b"".join(len(w).to_bytes(8, "big") + w for w in words[at:end]), end - at)], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            at = end
        return out


def _signatures(words: int, rows: int):
    n_bands = HASHES // rows
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("bands", pa.list_(pa.int64())), *((c, pa.int64()) for c in SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        a, b = odd_constants(HASHES, 11), odd_constants(HASHES, 13)
        weights = odd_constants(rows, 17)
        shift = np.uint64(32)
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text").to_pylist())
            sizes = np.array([len(s) for s in sets], np.int64)
            has = np.flatnonzero(sizes)
            digests = np.array([(xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0) for s in sets], object)
            low = np.array([int(d) & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64)
            high = np.array([int(d) >> 64 for d in digests], np.uint64).view(np.int64)
            minima = np.zeros((HASHES, len(has)), np.uint64)
            if len(has):
                flat = np.concatenate([sets[i] for i in has])
                starts = np.zeros(len(has), np.int64)
                np.cumsum(sizes[has][:-1], out=starts[1:])
                work = np.empty_like(flat)
                for k in range(HASHES):
                    np.multiply(flat, a[k], out=work)
                    np.add(work, b[k], out=work)
                    np.right_shift(work, shift, out=work)
                    minima[k] = np.minimum.reduceat(work, starts)
            keys = np.zeros((len(has), n_bands), np.uint64)
            for r in range(rows):
                keys += mix(minima[r : n_bands * rows : rows].T + weights[r]) * weights[r]
            mixed = mix(minima)
            sketch = np.zeros((len(sets), 4), np.int64)
            if len(has):
                for bit in (0, 1):
                    bits = (mixed >> np.uint64(bit) & np.uint64(1)).astype(np.uint8)
                    sketch[has, 2 * bit : 2 * bit + 2] = np.packbits(bits, axis=0).T.copy().view(np.int64)
            bands = list_array(mix(keys).view(np.int64).ravel(), np.where(sizes > 0, n_bands, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(low), pa.array(high), bands, *(pa.array(sketch[:, j].copy()) for j in range(4))], schema=schema)

    return run


def _shingle_sets(words: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text").to_pylist())
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_array(flat, np.array([len(s) for s in sets]), pa.int64())], schema=schema)

    return run


def _member_sets(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The shingle sets of all documents that share a bucket, by the same kind of join at every size."""
    ids = members.select("id").distinct()
    return texts.hint("merge").join(ids, "id", "left_semi").mapInArrow(_shingle_sets(words), "id bigint, shingles array<bigint>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with the whole shingle sets su and sv and the size of their intersection."""
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    return pairs.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("su", "sv")).cast("long"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets are similar enough."""
    both = _with_sets(pairs.distinct(), sets)
    return both.where(F.col("common") * 100 >= (F.size("su") + F.size("sv") - F.col("common")) * percent).select("u", "v")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    A set holds the distinct ``words``-word shingles of the text, A-Z in lower
    case, words being runs of anything but ASCII white space; a shorter text is
    one shingle, and a text that is null or has no words has none and is linked
    with nothing. Sets are linked if 100 * intersection >= percent * union.
    component_id is the least doc_id that can be reached, kept marks the row that
    bears it. Rows that repeat a doc_id count as one document for the links of
    all. A row without doc_id keeps null as its component, is kept, and links with
    nothing. Other columns are not read. A text is read whole, by one task, however long.
    Bands and signatures follow ``percent`` (1 to 100): a link at the threshold is missed with
    a probability of at most MISS by the bands (but under 13 percent, where single minima are the bands), one above it with less.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be 1 to 100, not {percent}")
    spark = docs.sparkSession
    tables = Tables(spark)
    texts = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sigs = tables.write(texts.mapInArrow(_signatures(words, band_rows(percent)), "id bigint, n bigint, d0 bigint, d1 bigint, bands array<bigint>, s0 bigint, s1 bigint, t0 bigint, t1 bigint"), "signatures")
    known = sigs.where("id is not null and n > 0")
    classes = tables.write(known.groupBy("d0", "d1").agg(F.min("id").alias("rep")), "classes")
    reps = known.join(classes.withColumnRenamed("rep", "id"), ["d0", "d1", "id"], "left_semi").where(f"100 * n >= {percent} * (n + 1)")
    banded = reps.select("id", "n", *SKETCH, F.posexplode("bands").alias("band", "key"))
    buckets = tables.write(banded.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    members = tables.write(banded.join(buckets, ["band", "key"]), "members")
    centred = tables.write(_centred(members, tables), "centred")
    sets = tables.write(_member_sets(members, texts, words), "sets")

    star = centred.where(f"id <> c.id and {_alike('c', percent)}").select(F.greatest("id", "c.id").alias("u"), F.least("id", "c.id").alias("v"))
    links = tables.write(_verified(star, sets, percent), "star")
    component = tables.write(connected_components(links, tables), "components0")
    left = tables.write(_spread(centred, component, percent), "left")
    tables.drop("members", "buckets", "centred")
    if not left.isEmpty():
        links = tables.write(links.union(_verified(_remaining(left, sets, percent, tables), sets, percent)), "links")
        component = tables.write(connected_components(links, tables), "components")
    tables.drop("left", "grouped", "sets", "star", "links", "weights", "centres")

    named = classes.join(component, classes["rep"] == component["node"], "left").select("d0", "d1", F.coalesce("component", "rep").alias("root"))
    out = sigs.select("id", "n", "d0", "d1").join(tables.write(named, "named"), ["d0", "d1"], "left")
    root = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def _alike(other: str, percent: int, own: str = "") -> str:
    """Condition: sizes and signatures allow a link."""
    a = f"{own}." if own else ""
    differ = " + ".join(f"bit_count(({a}s{j} ^ {other}.s{j}) | ({a}t{j} ^ {other}.t{j}))" for j in (0, 1))
    return f"{differ} <= {sketch_most(percent)} and 100 * least({a}n, {other}.n) >= {percent} * greatest({a}n, {other}.n)"


def _centred(members: DataFrame, tables: Tables) -> DataFrame:
    """Members with their bucket's centre c: the one that stands in the largest buckets, so has least of its own."""
    weights = tables.write(members.groupBy("id").agg(F.sum("members").alias("weight")), "weights")
    weighed = members.join(weights, "id")
    centres = weighed.groupBy("band", "key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n", *SKETCH)).alias("m"))
    centres = centres.select("band", "key", F.struct((-F.col("m.minus")).alias("id"), "m.n", *(f"m.{c}" for c in SKETCH)).alias("c"))
    return members.join(tables.write(centres, "centres"), ["band", "key"])


def _spread(members: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that hold more than one component."""
    known = members.join(component, members["id"] == component["node"], "left").drop("node").withColumn("component", F.coalesce("component", "id"))
    many = known.groupBy("band", "key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("band", "key")
    return known.join(many, ["band", "key"], "left_semi")


def _remaining(left: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Pairs (u, v) that share a bucket and may be linked, though neither path through a centre has linked them.

    In buckets of up to SMALL members these are the pairs of different components whose
    signatures agree. In larger ones all members are held against the centre c first: x is the
    size of what a member shares with it, its extras are what it doesn't. A link between r and m
    needs 4/9 (n_r + n_m) common shingles (at 80 percent), so it either fits into
    min(x_r, x_m), for which both need x >= 0.8 n, or r and m share an extra. The
    latter are joined by the first extras in order of hash, as many as a link may
    leave out. One of the two is not of the centre's own component, so members of that are held only
    against the others: a large group of copies, or of texts around one passage, never meets in all pairs.
    """
    pair = (F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v"))
    apart = f"a.component <> b.component and {_alike('b', percent, 'a')}"
    differ = f"a.id < b.id and {apart}"
    plain = left.select("band", "key", "members", "id", "n", *SKETCH, "component")
    small = plain.where(f"members <= {SMALL}")
    near = small.alias("a").join(small.alias("b"), F.expr(f"a.band = b.band and a.key = b.key and {differ}")).select(*pair)

    groups = left.where(f"members > {SMALL}").select(F.col("id").alias("u"), F.col("c.id").alias("v"), "n", *SKETCH, "component").distinct()
    both = _with_sets(groups, sets)
    most = f"int(n * {100 - percent} div 100) + 1"
    extras = F.expr(f"slice(sort_array(array_except(su, sv)), 1, {most})")
    groups = tables.write(both.select(F.col("v").alias("centre"), F.col("u").alias("id"), "n", *SKETCH, "component", F.col("common").alias("x"), extras.alias("extras")), "grouped")
    own = groups.where("id = centre").select("centre", F.col("component").alias("main"))
    stranger = F.expr("component <> main")
    within = groups.drop("extras").where(f"100 * x >= {percent} * n")
    fits = f"{100 + percent} * least(a.x, b.x) >= {percent} * (a.n + b.n)"
    strangers = within.join(own, "centre").where(stranger)
    inside = strangers.alias("a").join(within.alias("b"), F.expr(f"a.centre = b.centre and {fits} and {apart}")).select(*pair)
    beyond = groups.select("centre", "id", "n", *SKETCH, "component", F.explode("extras").alias("extra"))
    strangers = beyond.join(own, "centre").where(stranger)
    shared = strangers.alias("a").join(beyond.alias("b"), F.expr(f"a.centre = b.centre and a.extra = b.extra and {apart}")).select(*pair)
    return near.union(inside).union(shared)
