"""What the operators share: the shared folder, tables that cut lineage, files on it, and words."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts have it; in Java's and in Python's syntax.
WORD = r"[^\x20\x09-\x0D]+"


#: Scratch folders of this process; they go when it ends.
SCRATCH: set[str] = set()


@atexit.register
def cleared() -> None:
    """Delete the scratch folders, on a local disk or in any store that the session, if there still is one, writes to."""
    spark = SparkSession.getActiveSession()
    for path in SCRATCH:
        if is_local(path):
            shutil.rmtree(local_path(path), ignore_errors=True)
        elif spark is not None:
            deleted(spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)


def shared_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only with keep it outlives the process.

    Only where that setting is missing (tests, a notebook) one is made: below the system's temporary
    folder for a local master, below the warehouse on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="evidence_")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        SCRATCH.add(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_local(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def local_path(uri: str) -> str:
    return urlparse(uri).path if uri.startswith("file:") else uri


def open_output(uri: str):
    """A file to write, on a local or shared disk or in any store that pyarrow knows."""
    if is_local(uri):
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_input(uri: str):
    if is_local(uri):
        return open(local_path(uri), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of at most this size: a task's texts are in the JVM and in Python beside each other. The same for all operators; a limit that the user has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m"):
        spark.conf.set(name, size)


def n_words(text):
    """How many words a text has; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_out(aggregate: DataFrame) -> DataFrame:
    """An aggregate as a side of a join on its key, dealt anew before the join deals it by key.

    Joined directly, it would stay where it was added up, and Spark can split the rows of a hot key on the other
    side only if both sides come from shuffles of the join's own. The aggregate has a row a key, so it is cheap to move.
    """
    return aggregate.repartition(parallelism(aggregate.sparkSession))


def dropped(table: DataFrame) -> None:
    """Delete the files of a table of written() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        deleted(table.sparkSession, folder)
        SCRATCH.discard(folder)
