"""What several operators need: the folder that all executors share, spooled tables, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload after which an operator hands an Arrow batch on.
FLUSH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own
    (removed at exit); a cluster session is refused, since its executors share no local folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, root, True)
        sc.setCheckpointDir(f"file://{root}")
        root = f"file://{root}"
    return root


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back. It cuts lineage: a lost executor costs a reread,
    not the Python pass that made the rows."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/spool/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Removes what this application spooled. For when results are written: tables made before can't be read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/spool/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns, a null text as the empty one. Other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def utf8(text: Column | str) -> Column:
    return F.encode(text, "UTF-8")


class Rows:
    """Collects rows by column and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = FLUSH_BYTES):
        self.schema, self.limit = schema, limit
        self._clear()

    def _clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.bytes = 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.bytes += size
        if self.bytes >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self._clear()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``least`` rows or more that no group of rows with equal keys crosses. Rows come sorted by the keys;
    the caller's groups are bounded."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        last = group_starts(whole, keys)[-1]
        held, rows = [whole.slice(last)], whole.num_rows - last
        if last:
            yield whole.slice(0, last)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]


def group_starts(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """Places at which a group begins."""
    turn = np.zeros(batch.num_rows, bool)
    turn[:1] = True
    for k in keys:
        x = batch.column(k).to_numpy()
        turn[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(turn)
