"""Files in and out: whole files as binary rows, settings dumps, picture lookup, partitioned outputs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``doc_id, path, content``: a document is one row, its id a hash of its path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def read_paths(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """``doc_id, path, content, error`` of several paths; one that isn't there is a row that says so, and no failure."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(at.getFileSystem(hadoop).globStatus(at))

    good = [p for p in paths if there(p)]
    kind = "struct<kind:string,message:string>"
    bad = spark.createDataFrame([(p, ("missing", "no such file")) for p in paths if p not in good], f"path string, error {kind}")
    rows = bad.select(F.xxhash64("path").alias("doc_id"), "path", F.lit(None).cast("binary").alias("content"), "error")
    if not good:
        return rows
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(good)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content", F.lit(None).cast(kind).alias("error")).unionByName(rows)


def write_documents(converted: DataFrame, folder: str, extension: str) -> DataFrame:
    """One file for each row of ``path, output`` that has an output: the path's last part with another extension, written
    by the executors to a folder that all of them reach. ``path, written`` says where; names that repeat get a number."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    named = export_names(converted.where("output is not null").select(F.lit(0).alias("doc_id"), F.xxhash64("path").alias("graphic_ix"), stem.alias("stem"), "path", F.col("output").cast("binary").alias("output")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            to = [f"{base}/{name}.{extension}" for name in batch["name"]]
            for path, data in zip(to, batch["output"], strict=True):
                with system.open_output_stream(path) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"path": batch["path"], "written": to})

    return named.select("path", "name", "output").mapInPandas(write, "path string, written string")


def parse_settings(data: bytes) -> dict[str, bytes]:
    """A settings dump: ``label=item,item`` lines, items hexadecimal bytes or quoted text, ``=`` at the start of a line
    goes on with the label before; the last line of a label counts; 0x1A ends the dump."""
    out: dict[str, bytes] = {}
    label = None
    for line in data.partition(b"\x1a")[0].decode("latin-1").splitlines():
        name, mark, items = line.partition("=")
        if not mark:
            continue
        fresh = bool(name.strip())
        label = name.strip() if fresh else label
        if label is None:
            continue
        found = bytearray()
        for quoted, code in re.findall(r'"([^"]*)"|([0-9A-Fa-f]{1,2})(?=\s*(?:,|$))', items):
            found += quoted.encode("latin-1") if quoted else bytes([int(code, 16)]) if code else b""
        out[label] = bytes(found) if fresh else out.get(label, b"") + bytes(found)
    return out


def read_settings(dumps: DataFrame) -> DataFrame:
    """``doc_id, label, value`` of dumps ``doc_id, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, v) for i, c in zip(batch["doc_id"], batch["content"], strict=True) for k, v in parse_settings(bytes(c or b"")).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "value"])

    return dumps.mapInPandas(run, "doc_id long, label string, value binary")


def dos_suffixes(path: Column) -> Column:
    """Lower-case suffixes of a path, the longest first: what a file may be found under."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(path, r"^[A-Za-z]:", "")), r"[\\/]+"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def resolve_pictures(graphics: DataFrame, files: DataFrame) -> DataFrame:
    """``doc_id, graphic_ix, path``: the file whose path ends with the longest suffix of the graphic's; of equally good
    ones the first by name; null where there is none. A join on the file name, so neither side is collected."""
    wanted = graphics.select("doc_id", "graphic_ix", F.posexplode(dos_suffixes(F.col("graphic"))).alias("rank", "suffix"))
    wanted = wanted.withColumn("file", F.substring_index("suffix", "/", -1))
    there = files.select(F.lower("path").alias("lower"), "path").withColumn("file", F.substring_index("lower", "/", -1))
    found = wanted.join(there, "file").where(F.col("lower").endswith(F.concat(F.lit("/"), F.col("suffix"))) | (F.col("lower") == F.col("suffix")))
    best = found.groupBy("doc_id", "graphic_ix").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return graphics.select("doc_id", "graphic_ix", "graphic").join(best, ["doc_id", "graphic_ix"], "left")


def export_names(images: DataFrame) -> DataFrame:
    """Adds ``name``: the stem, with -1, -2 ... from its second use in a document on."""
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy("doc_id", F.lower("stem")).orderBy("graphic_ix"))
    return images.withColumn("turn", turn).withColumn("name", F.concat("stem", F.when(F.col("turn") > 1, F.concat(F.lit("-"), (F.col("turn") - 1).cast("string"))).otherwise(F.lit("")))).drop("turn")


def write_outputs(converted: DataFrame, path: str) -> None:
    """One partition for what was converted, one for what was refused."""
    converted.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error")).write.partitionBy("status").mode("append").parquet(path)
