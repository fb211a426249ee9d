"""What all operators of this subpackage share: the shared folder, written tables, Arrow batch limits."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define words: [^\x20\x09-\x0D]+
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone: the path may be in a store only Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local folder is set for a local master; another master is an error, as a
    folder of one machine would lose rows on a cluster.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at and sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc._jsc.sc().getCheckpointDir().get()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(sc, "_tallybook_local_root", None) or tempfile.mkdtemp(prefix="tallybook-")
        sc._tallybook_local_root = at
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file:///"):
        full = "file://" + full[len("file:") :]
    return full.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def files(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and the path in it, on the driver or an executor."""
    return pafs.FileSystem.from_uri(uri)


def write_whole(fs: pafs.FileSystem, path: str, name: str, parts) -> None:
    """Writes a file under an own name, then moves it in place: a task that is run again leaves whole files only."""
    own = f"{path}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for x in parts:
            out.write(x)
    try:
        fs.move(own, f"{path}/{name}")
    except OSError:  # some stores don't move over a file: an earlier run of the task has left the same one
        fs.delete_file(f"{path}/{name}")
        fs.move(own, f"{path}/{name}")


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Arrow batches of about ``size`` bytes: a worker holds one at a time, however long the texts are.

    The setting is the session's and stays, as plans that are built now run later; set it to 1 MB or less yourself to have
    it left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(name, size)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def row_hash(columns: list[str]):
    """64 bits of all columns of a row, telling null from empty."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def parallel(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
