"""Helpers that the operators of this package share."""

from __future__ import annotations

import functools
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of a few numbers that one task makes and writes as one file.
FILE_ROWS = 1 << 15

_SHIPPED: set[str] = set()
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a
    temporary folder stands in; a cluster must name one.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-llm-"))
        at = "file://" + _OWN_DIR[0]
    return at.rstrip("/")


class Scratch:
    """Tables of one operator run in the shared folder; cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t", most: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back.

        Where it is made from and has at most ``most`` (small) rows, one task makes and
        writes every ``FILE_ROWS`` of these, not one for every shuffle partition.
        """
        self.n += 1
        df = df if most is None else df.coalesce(self.tasks(most))
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def tasks(rows: int) -> int:
        """Tasks for so many (small) rows."""
        return 1 + rows // FILE_ROWS

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if folder.startswith(self.root) or self.root.removeprefix("file://") in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(conf).delete(path, True)

    def forget(self) -> None:
        """Let go of the shuffle files of earlier steps.

        Spark deletes them once the driver has collected the frames they belong to; a
        driver with memory to spare seldom does, so a long loop would hold those of all rounds.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-ship-")), "specgrid_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


#: Bits of an id filter: at most 4096 rows of 4 KB, 16 MB, whatever the data.
FILTER_BITS, _ROW_BITS = 1 << 27, 1 << 15


def id_filter(ids: DataFrame, col: str, scratch: Scratch) -> DataFrame:
    """Bitmap of hashed ids, as a written table of bounded size that may be broadcast.

    The tasks' bitmaps are merged row by row, by as many tasks as shuffles have;
    only the merged rows go to a few files.
    """
    h = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    places = ids.select(F.floor(h / _ROW_BITS).cast("int").alias("_row"), (h % _ROW_BITS).alias("_bit"))
    return scratch.keep(places.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits")).repartition(2), "filter")


def maybe_in(df: DataFrame, col: str, marks: DataFrame, name: str = "maybe") -> DataFrame:
    """``df`` with a flag that is false only for ids that are surely not in the filter.

    It keeps texts that need no join out of a shuffle; an exact join follows.
    """
    h = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    at = df.withColumns({"_at": F.floor(h / _ROW_BITS).cast("int"), "_bit": (h % _ROW_BITS).cast("int")})
    out = at.join(F.broadcast(marks), F.col("_at") == F.col("_row"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, _bit % 8) & 1") == 1, F.lit(False))
    return out.withColumn("_byte", byte).withColumn(name, hit).drop("_at", "_bit", "_row", "_bits", "_byte")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_ODD = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
#: Bytes that are hashed together; powers of an odd number up to there, and of its inverse.
_CHUNK = 1 << 18


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(_CHUNK + 1, _ODD, dtype=np.uint64)
    down = np.full(_CHUNK + 1, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of an encoded text, in order, and the bytes at which they start and end.

    A word's hash is a polynomial in the (scrambled) bytes, taken from running
    sums over pieces of the text that are cut at blanks.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=bool)
    solid[1:-1] = _SOLID[raw]
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = turns[::2], turns[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    up, down = _powers()
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            lo = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, lo + _CHUNK, side="right")))
            hi = int(ends[to - 1])
            if hi - lo > _CHUNK:  # a single word that long
                digest = xxhash.xxh3_64_intdigest(data[lo:hi])
                out[at] = np.uint64(digest)
            else:
                sums = np.zeros(hi - lo + 1, dtype=np.uint64)
                np.cumsum(_LETTER[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
                a, b = starts[at:to] - lo, ends[at:to] - lo
                out[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
            at = to
        return mix64(out), starts, ends


def starts_of(data: bytes) -> np.ndarray:
    """Bytes at which the words of an encoded text start."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[1:] = _SOLID[np.frombuffer(data, dtype=np.uint8)]
    return np.flatnonzero(solid[1:] & ~solid[:-1])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of an encoded text, in order."""
    return words_of(text)[0]


def in_slices(texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about ``size`` bytes together; a longer text stands alone."""
    at = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield at, i
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving memory back to the system when a task ends, as workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return wrapped


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    # Doubling: a hash of 2^j words from two of 2^(j-1); the parts of `size` in binary are then chained.
    out, done, power, width = None, 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                part = power[done : done + n]
                out = part.copy() if out is None else mix64(out * np.uint64(0x9E3779B97F4A7C15) + part)
                done += width
            if done == size:
                break
            power = mix64(power[:-width] * np.uint64(0x9E3779B97F4A7C15) + power[width:])
            width *= 2
        return mix64(out + np.uint64(size))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key in turn, from batches that are sorted by integer ``keys``; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys]).astype(np.int64)
        ends = [*(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        at = 0
        for end in ends:
            here = k[at].tolist()
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last, at = here, end
    if held:
        yield pa.Table.from_batches(held)
