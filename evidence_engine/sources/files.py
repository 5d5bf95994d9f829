"""Files that other tools read and write: texts with their statistics, manifests, and tables as JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    of, store = _path(spark, path)
    return store.exists(of)


def write_array(df: DataFrame, path: str) -> None:
    """A table as one file with a JSON array, row by row: the driver holds a partition at most."""
    spark = df.sparkSession
    of, store = _path(spark, path)
    # others may change the file: no checksum beside it
    store.setWriteChecksum(False)
    out = store.create(of, True)
    store.setWriteChecksum(True)
    lead = "[\n"
    for row in df.toJSON().toLocalIterator():
        out.write(bytearray((lead + row).encode()))
        lead = ",\n"
    out.write(bytearray((("" if lead[0] == "," else lead) + "\n]\n").encode()))
    out.close()


def write_texts(lines: DataFrame, stats: DataFrame, folder: str) -> DataFrame:
    """<document_id>.txt and <document_id>.stats.json of every document, and manifest.json; returns the manifest, in order of name.

    lines: document_id, line_no and text; stats: document_id and counts. A document is written by the task
    that has its lines, so folder has to be one that all tasks see.
    """
    spark = lines.sparkSession
    store = folder.removeprefix("file://") if folder.startswith("file:") else folder
    bodies = lines.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("body"))
    rows = stats.join(bodies, "document_id", "left").select("document_id", F.concat(F.coalesce("body", F.lit("")), F.lit("\n")).alias("body"), F.to_json(F.struct(*[c for c in stats.columns])).alias("stats"))

    def run(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(store) if "://" in store else (fs.LocalFileSystem(), store)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for name, body, facts in zip(batch["document_id"], batch["body"], batch["stats"], strict=True):
                for suffix, text in ((".txt", body), (".stats.json", facts + "\n")):
                    with where.open_output_stream(f"{root}/{name}{suffix}") as out:
                        out.write(text.encode())
            yield batch[["document_id"]].assign(output_file=[f"{name}.txt" for name in batch["document_id"]])

    named = rows.mapInPandas(run, "document_id string, output_file string")
    # written once: what reads the manifest doesn't write the files again
    spark.createDataFrame(named.collect(), named.schema).write.mode("overwrite").parquet(f"{folder}/_names")
    manifest = spark.read.parquet(f"{folder}/_names").join(stats, "document_id").orderBy(F.lower("document_id"), "document_id")
    write_array(manifest, f"{folder}/manifest.json")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, line_no, text) of the files that a manifest names in output_file.

    A name may be a path of its own, or relative to the manifest's folder; where neither is there, the file
    of that name beside the manifest counts. One that is nowhere is an error.
    """
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    found = []
    for row in spark.read.option("multiLine", True).json(path).select("output_file").toLocalIterator():
        name = row["output_file"]
        tries = [name] if name.startswith("/") or "://" in name else [f"{folder}/{name}"]
        tries.append(f"{folder}/{name.replace(chr(92), '/').rsplit('/', 1)[-1]}")
        there = [t for t in tries if exists(spark, t)]
        if not there:
            raise FileNotFoundError(f"no file for {name} of {path}")
        found.append(there[0])
    rows = spark.read.text(found, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("document_id"), F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    rows = rows.where("text <> ''").withColumn("document_id", F.call_function("url_decode", "document_id"))
    return rows.select("document_id", (F.col("at") + 1).cast("long").alias("line_no"), "text")
