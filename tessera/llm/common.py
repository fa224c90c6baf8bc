"""Shared helpers: the shared folder, Arrow text access and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode, where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "/tmp/checkpoints/tessera"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two needed columns (extra columns never clash); a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out_expr(col, modulus: int, remainder: int):
    """True where crc32(id as text) mod modulus is remainder; a null id is never held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its offsets, without a copy for each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = column.cast(pa.large_binary())
    buffers = big.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[big.offset : big.offset + len(big) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def texts_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def split_frequent(counted: DataFrame, count_col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the largest counts, `most` at most, and all others: cut by a histogram of powers of 2 ** (1 / 32).

    The histogram has a few thousand rows whatever the table, so no task sends its own best rows to the driver.
    """
    level = F.floor(F.log2(F.col(count_col)) * 32)
    sizes = counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    total, cut = 0, 1 << 40
    for r in sorted(sizes, key=lambda r: -r.level):
        if (total := total + r.n) > most:
            break
        cut = r.level
    return counted.filter(level >= cut), counted.filter(level < cut)


def most_frequent(counted: DataFrame, count_col: str, most: int) -> DataFrame:
    return split_frequent(counted, count_col, most)[0]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer in use."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def trim() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers serve many tasks, and what one held stays with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not in every C library
        ctypes.CDLL(None).malloc_trim(0)


def pack_rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected link table; root is the smallest node reachable.

    Alternating large-star and small-star contraction. Every round is a join on a node and a pre-aggregated minimum,
    written to the shared folder. Null ends are ignored; self-links and repeated links are harmless.
    """
    edges = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo is not null and hi is not null and lo <> hi").distinct()
    edges = materialize(edges, "cc")
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("m", "lo", "hi")
        nxt = small.select(F.col("m").alias("lo"), "hi").union(small.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct()
        nxt = materialize(nxt, "cc")
        discard(edges)
        edges = nxt
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
