"""What the operators share: scratch tables, batching, and hashing of words.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
every executor can reach, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}
_written: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from ``spark.checkpoint.dir``. Only a local master may go without that
    setting; it then gets a temporary folder, deleted at exit.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return "file://" + _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Delete all scratch tables of this driver, once the results that still read them are saved."""
    for path in [*_written]:
        delete_path(spark, path)


class Tables:
    """The intermediate tables of one run; ``drop`` deletes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back, with its lineage cut.

        The shuffle files of the write are deleted once it is done.
        """
        path = scratch_path(self.spark, name)
        was = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, was)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def give_back() -> None:
    """Return what a worker no longer uses to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the ``text`` column of each has about ``most`` bytes.

    A row is never cut: a longer text comes alone. Unused memory is given back at the end.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def list_slices(batches: Iterator[pa.RecordBatch], *lists: str, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the ``lists`` columns of each have about ``most`` items; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
        ends = np.cumsum(sizes + 1)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def free_names(taken: list[str], *names: str) -> list[str]:
    """Column names that begin with ``names`` and clash with none of ``taken``."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        k = 0
        while (free := f"__{name}{k}").lower() in low:
            k += 1
        out.append(free)
    return out


class TwoHashes(dict):
    """Words (bytes) to two independent 64-bit hashes; forgets everything between calls once it has ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        self.tables = np.empty((2, 1 << 16), np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k == self.tables.shape[1]:
            self.tables = np.concatenate((self.tables, np.empty_like(self.tables)), axis=1)
        both = xxhash.xxh3_128_intdigest(word)
        self.tables[0, k], self.tables[1, k] = both & (1 << 64) - 1, both >> 64
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        """An array with a row for each of the two hashes."""
        if len(self) >= self.most:
            self.clear()
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.tables[:, places]


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets everything when it has ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; ``bytes.split`` cuts at just these characters."""
    return text.encode().split() if text else []


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_id(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("long")
