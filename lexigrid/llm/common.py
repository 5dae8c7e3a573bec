"""Helpers shared by the operators: staged tables in the shared folder, bounded Arrow batches, column hygiene."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: What a Python worker takes up at a time where rows hold whole texts.  Spark bounds the bytes of the batches it sends, too.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 500
#: What Spark sends a worker at a time, where a registered query or stage asks for it.
BATCH_BYTES = 4 << 20
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (all in one process) gets a folder of its own; a cluster is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\[]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: the master is {master}")
        there = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lexigrid-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs nothing twice."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexigrid_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    drop_path(df.sparkSession, df._lexigrid_path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session has ended: nothing is left to delete with
            return


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that a worker takes up SLICE_BYTES of a column and SLICE_ROWS rows at a time, or one larger row."""
    for b in batches:
        col = b.column(column)
        sized_ = pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type)
        size = pc.fill_null(pc.binary_length(col), 0).to_pylist() if sized_ else [0] * b.num_rows
        at = held = 0
        for i, n in enumerate(size):
            if i > at and (held + n > SLICE_BYTES or i - at == SLICE_ROWS):
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def bounded_batches(spark: SparkSession) -> None:
    """For the registered queries and stages: Spark sends workers batches of BATCH_BYTES at most, by their size.

    A session's setting, so operators leave it alone; a smaller one that is set already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(name).lower())
    if not now or int(now[1]) << {"k": 10, "m": 20, "g": 30}.get(now[2], 0) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names: further columns of the input, whatever their names, play no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Bytes of a table that may be broadcast, by its own count of rows or bytes.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, row_bytes: int = 0, total: int | None = None) -> DataFrame:
    """A staged table, broadcast only if it is small as counted; else joined by a shuffle."""
    if total is None:
        total = df.count() * (row_bytes + 16)
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equality join on keys in which null equals null; the result has the left keys."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_same_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*(f"_same_{k}" for k in keys))


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the rows whose keys are in the staged table ``gone``.

    A list of few bytes, as counted, is broadcast, so texts stay where they are; a longer one is joined by a shuffle.
    """
    gone = gone.select(*keys)
    width = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(32))
    return join_same(docs, sized(gone, total=gone.agg(F.sum(width)).first()[0] or 0), keys, "left_anti")


def least_hashed(rows: DataFrame, label: str, n: int) -> DataFrame:
    """(doc_id, label, rank from 1): of each value of ``label`` the ``n`` different doc_ids of the least hash.

    Labels are counted first, and only ids below a hash that some four times ``n`` of them fall under are brought
    together: the driver ranks about that many for each label, at any size of the table.
    """
    spark, whole = rows.sparkSession, 1 << 40
    h = F.pmod(F.xxhash64("doc_id"), F.lit(whole))
    sizes = stage(rows.groupBy(label).agg(F.count("*").alias("n")), "labels")
    below = rows.join(sized(sizes, 64), label).where(h < F.lit(float(whole) * 4 * n) / F.col("n"))
    found = below.select("doc_id", label, h.alias("h")).distinct().collect()
    ranked: dict = {}
    for r in sorted(found, key=lambda r: (r["h"], str(r["doc_id"]))):
        ranked.setdefault(r[label], []).append(r["doc_id"])
    kept = [(d, value, i) for value, ids in ranked.items() for i, d in enumerate(ids[:n], 1)]
    schema = rows.select("doc_id", label).schema.add("rank", IntegerType())
    return spark.createDataFrame(kept, schema)


def free_prefix(df: DataFrame, prefix: str = "_own") -> str:
    """A prefix that no column of ``df`` has, whatever the case: names for columns on the way."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
