"""What several operators of this subpackage share: the shared folder, tables
written there, and the word rule of the contracts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors
    share. Where it is unset, a temporary one is set in local mode, as in tests; on a
    cluster, where executors wouldn't see it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends
    there, and a lost executor costs no more than the tasks that read the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver notice that the shuffles of finished jobs are unused, so that
    their files go before the next job writes its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark would take it for, as a URI with an authority part."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    scheme, _, rest = uri.partition(":")
    return uri if rest.startswith("//") else f"{scheme}://{rest}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than this part of the rows is hot; there are fewer than HOT_KEYS such keys.
HOT_KEYS = 2000


def keyed_join(rows: DataFrame, side: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``side``, which has a row for each key and in n how
    many of the ``total`` rows have it. Hot keys' sides, fewer than HOT_KEYS whatever the
    input, go to all tasks, so that no task gets all rows of a hot key; the rest meet by
    key. Both tables are read more than once and should be written ones."""
    most = max(1, total // HOT_KEYS)
    hot = F.broadcast(side.filter(F.col(n) > most))
    cold = rows.join(F.broadcast(side.filter(F.col(n) > most).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(side.filter(F.col(n) <= most).hint("merge"), key, how))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased; bytes know
    no other letters and no other white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the decimal text of a column, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


_forget: dict = {}


def only_memory(owner: str, forget=lambda: None) -> None:
    """Say in a Python worker that ``owner`` works now: what other operators remember in
    this worker, which Spark uses again for later stages, is forgotten by calling their
    ``forget``, and the freed memory goes back to the system."""
    others = [f for name, f in _forget.items() if name != owner]
    _forget.clear()
    _forget[owner] = forget
    if others:
        import ctypes

        for f in others:
            f()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


#: Bytes of an Arrow batch in the pipeline, about: Spark's own limit, 64 MB, holds for each copy
#: of a batch that a task has in the JVM, on its way and in the Python worker.
BATCH_BYTES = 4_000_000
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on in this session, let tasks and their Python workers exchange Arrow batches
    of some BATCH_BYTES, or one row if that has more; a limit that the session has set
    stays. It is the session's, as what a stage returns runs when its caller wants it."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def chunks(batches, size: int):
    """Arrow batches in pieces of at most ``size`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
