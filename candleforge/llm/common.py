"""What the operators share: lineage cuts, exact 64-bit arithmetic on words, and forests of links."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text processed at once inside a task, so that memory does not follow the Arrow batch size.
CHUNK_BYTES = 1 << 20

#: Checkpoints after which what earlier ones took to make, and those that no plan reads any more, leave the disk.
RELEASE_EVERY = 8
#: Partitions for each core, and at least, that in_few() leaves.
FILES_PER_CORE, LEAST_FILES = 8, 32
#: Rows with whole texts that the JVM and Python exchange at once.
TEXT_ROWS = 1024

_U = np.uint64
_made = count(1)


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one is made for this
    application if all runs in one JVM, as in tests; on a cluster a folder of one machine would not do, so it raises."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder(conf.get("spark.app.id", ""))


@cache
def _own_folder(app: str) -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below shared_root(), for what need not outlive it."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return context.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there.

    A checkpoint keeps the size that was estimated for its plan, and a join's estimate is the product of its sides':
    after some rounds that is a number of millions of digits. So the rows are taken up as a table of unknown size.

    Shuffle and checkpoint files stay until the driver collects its garbage, which it may not do for many rounds; each has
    a file or more for every partition. So it is asked to from time to time; files that a plan still reads are kept.
    """
    spark = df.sparkSession
    shared_folder(spark)
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    done = df.checkpoint()._jdf
    if next(_made) % RELEASE_EVERY == 0:
        gc.collect()
        spark._jvm.System.gc()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def in_few(df: DataFrame) -> DataFrame:
    """df, where tasks take several partitions if there are many: each file that is written costs its folder's store some
    requests, on a local disk processes that the executor starts. Not for what numbers rows by the task's partition."""
    return df.coalesce(max(LEAST_FILES, FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))


def checkpointed_in_few(df: DataFrame) -> DataFrame:
    return checkpointed(in_few(df))


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside exchanges at most TEXT_ROWS rows at once with Python, so that neither side holds the texts of the
    usual 10000; the session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXT_ROWS:  # 0 or less: no limit
        spark.conf.set(name, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same with a Parquet table, for wide rows: columns can be pruned, and the table outlives the session."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts add up to about `limit` bytes; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that a task turns few texts at once into Python objects. What they took goes
    back to the system at the end, as the process lives on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def binaries(column) -> list[bytes]:
    """An Arrow binary column as bytes, null as empty."""
    return [x or b"" for x in column.to_pylist()]


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """XXH64 of each word."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), dtype=_U, count=n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Rolling:
    """Polynomial hashes, modulo 2^64, of all runs of k items, from one prefix sum; the base is odd, so it has an inverse."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                powers = np.full(n, _U(b), dtype=_U)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=_U))

    def prefix(self, items: np.ndarray) -> np.ndarray:
        """Prefix sums of items times powers, one longer than items."""
        self._grow(len(items) + 1)
        out = np.zeros(len(items) + 1, dtype=_U)
        np.cumsum(items * self._up[: len(items)], dtype=_U, out=out[1:])
        return out

    def at(self, prefix: np.ndarray, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """Mixed hash of items[s : s + k] for each start."""
        return mix((prefix[starts + k] - prefix[starts]) * self._down[starts])


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower label, whose entries name the least node known to be reachable, until the links a-b join no two names."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        least = np.minimum(la, lb)
        np.minimum.at(label, la[apart], least[apart])
        np.minimum.at(label, lb[apart], least[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) rows that connect what the links u-v connect: one for each node but the least of its component."""
    if not len(u):
        return u, v
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(names))
    _unite(label, a, b)
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]
