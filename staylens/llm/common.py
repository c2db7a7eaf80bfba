"""What several operators of this subpackage need: the shared folder, tables written there, Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the driver and all executors see.

    The folder is spark.checkpoint.dir; a local one is set only where the session names none and runs in one process,
    as in tests. Elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='staylens-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/staylens-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """A new folder as shared_dir() names it, made, and deleted when the application ends."""
    path = shared_dir(spark)
    fs, where = _at(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def write_shared(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again, which cuts its lineage. The table is deleted when the application ends."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(df: DataFrame) -> None:
    """Delete a table of write_shared() that nothing reads any more."""
    fs, where = _at(df.sparkSession, df._shared_path)
    fs.delete(where, True)


def join_common(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of rows with side, which has each key once and says in n how many of the rows have it.

    Keys of more than a ten-thousandth of the rows, of which there are less than ten thousand, are sent to all tasks, so
    that the rows of a common key stay where they are; the others are joined by a shuffle.
    """
    bound = (side.agg(F.sum(n)).first()[0] or 0) // 10_000 + 1_000
    told = [c for c in side.columns if c not in (key, n)]
    hot = side.filter(F.col(n) > bound).select(key, F.struct(*told).alias("_told"))
    met = rows.join(F.broadcast(hot), key, "left")
    cold = met.filter("_told is null").drop("_told").join(side.filter(F.col(n) <= bound).drop(n), key)
    return met.filter("_told is not null").select(*rows.columns, "_told.*").unionByName(cold.select(*rows.columns, *told))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    """Each value as str; null reads as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of flat."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def pieces(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of one text column, so that work arrays stay small; a longer value is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def field(df: DataFrame, name: str, kind: T.DataType | None = None) -> T.StructField:
    """The named column as a nullable field for an output schema."""
    return T.StructField(name, kind or df.schema[name].dataType, True)


def row_key() -> Column:
    """A 128-bit digest of doc_id and text: rows that share it are repeats. A null text reads as empty, a null doc_id as no other."""
    name = F.col("doc_id").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.length(name), F.lit(-1)).cast("string"), F.lit(" "), F.coalesce(name, F.lit("")), F.coalesce("text", F.lit("")))))


def keep_first(docs: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each component, one if it is repeated; a null doc_id comes last.

    found: _row (see row_key), doc_id and key of each row of docs; labels: key and label of keys linked to others. What
    goes is written as row keys alone, so that Spark sees its size before it chooses how to join. docs may have any
    columns but those that begin with _staylens.
    """
    firsts = found.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = write_shared(firsts.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    stands = classes.groupBy("label").agg(F.min("first")["_row"].alias("stands"))
    sided = write_shared(classes.join(stands, "label").select("key", "stands", "n"))
    judged = write_shared(join_common(found, sided, "key", "n").select("_row", (F.col("_row") == F.col("stands")).alias("stays")))
    gone = write_shared(judged.filter(~F.col("stays")).select(F.col("_row").alias("_staylens_gone")).distinct())
    again = write_shared(judged.filter("stays").groupBy(F.col("_row").alias("_staylens_again")).count().filter("count > 1").select("_staylens_again"))
    kept = without_rows(docs, gone, "_staylens_gone")
    if again.isEmpty():
        return kept.drop("_staylens_row")
    same = F.col("_staylens_row") == F.col("_staylens_again")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["_staylens_row"])).drop("_staylens_row")


#: Row keys of 16 bytes in a table that is sent to all tasks, some 20 MB.
MOST_KEYS = 200_000


def without_rows(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs with _staylens_row (see row_key), less the rows whose key is in the column `name` of gone, a table of write_shared().

    So many keys as MOST_KEYS are sent to all tasks, so that the texts stay where they are; more are joined by a shuffle.
    """
    sent = F.broadcast(gone) if gone.count() <= MOST_KEYS else gone
    return docs.withColumn("_staylens_row", row_key()).join(sent, F.col("_staylens_row") == F.col(name), "left_anti")
