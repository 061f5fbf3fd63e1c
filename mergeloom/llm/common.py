"""What the operators share: tables, work files, and the packed exchange.

The packed exchange is how an operator moves millions of small keys between
partitions: a map task groups its keys by bucket and sends, per bucket, one
binary row that numpy reads back as arrays. Spark still does the shuffle
(hash on ``bucket``, spillable, recomputed when an executor is lost); only the
cost per key is that of numpy, not of a row.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one exchange bucket stands for.
BUCKET_BYTES = 10 << 20
#: Ids that are broadcast at most (8 bytes each); beyond, the join is a shuffle.
BROADCAST_IDS = 4_000_000
#: A side of a join is broadcast only when its table is measured to be smaller.
BROADCAST_BYTES = 32 << 20
BLOB = "bucket int, blob binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None
#: The temporary folder of each local application that sets none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster has
    no folder that all machines are known to share, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="mergeloom-")
        base = _own[app]
    return base


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by the time Python exits
        pass


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mergeloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    atexit.register(_delete, spark, path)
    back = spark.read.schema(schema).parquet(path)
    back._mergeloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _delete(df.sparkSession, df._mergeloom_path)


def release(*stored: DataFrame) -> None:
    """Discard stored tables, and let Spark delete the shuffle files of plans that are done: it does so when the driver collects garbage."""
    for df in stored:
        discard(df)
    if stored:
        stored[0].sparkSession._jvm.System.gc()


def table_bytes(df: DataFrame) -> int:
    """Size by Spark's statistics; for files it is their length."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, column: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for what is measured to be in ``column``; estimates of Spark's are far off after joins or on compressed files."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{column}`")))).first()[0] or 0
    return max(8, min(1 << 24, math.ceil(total / bucket_bytes)))


def ids_of(ids: DataFrame, limit: int | None = None) -> np.ndarray | None:
    """The sorted ids of a *stored* table of one long column, or None if there are more than ``limit``."""
    if ids.count() > (BROADCAST_IDS if limit is None else limit):
        return None
    return np.sort(ids.toArrow().column(0).to_numpy().astype(np.int64))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` (doc_id long, text) with a doc_id in the stored ``ids``.

    Up to BROADCAST_IDS ids go to every worker as one sorted array, and no text is
    shuffled; beyond that it is a join.
    """
    known = ids_of(ids)
    if known is None:
        return texts.join(ids, "doc_id", "left_semi")
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(among(b.column(0).to_numpy(), sent.value)))

    return texts.mapInArrow(run, texts.schema)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a *stored* table if it is small by its file size; else leave the join to a shuffle."""
    return F.broadcast(df) if table_bytes(df) * 4 <= limit else df


def bounded_batches(spark: SparkSession) -> None:
    """Cap Arrow batches by bytes too, so that very long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


# --- packed arrays -----------------------------------------------------------


def trim() -> None:
    """Give memory that this worker has freed back to the system: workers are kept, and allocators keep it for them."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that trims when a partition is done."""

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return after


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    lens = np.frombuffer(blob, "<u4", len(dtypes))
    at, out = 4 * len(dtypes), []
    for n, d in zip(lens, dtypes):
        a = np.frombuffer(blob, d, n, at)
        out.append(a)
        at += a.nbytes
    return out


def gather(blobs: Iterable[bytes], *dtypes: str) -> list[list[np.ndarray]]:
    """Unpacked blobs, transposed: one list of arrays per dtype."""
    rows = [unpack(b, *dtypes) for b in blobs]
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in dtypes]


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
        names=["bucket", "blob"],
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (((mix(key) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its entries) in bucket order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    for part in np.split(order, cut):
        yield int(bucket[part[0]]), part


def exchange(df: DataFrame, reduce: Callable[[list[bytes]], Iterable[pa.RecordBatch] | pa.Table], schema: str) -> DataFrame:
    """Bring all blobs of a bucket together and apply ``reduce`` to them."""

    def run(t: pa.Table) -> pa.Table:
        out = reduce(t.column("blob").to_pylist())
        trim()
        return out

    return df.groupBy("bucket").applyInArrow(run, schema)
