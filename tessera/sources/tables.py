"""Entity tables and link lists: readers and writers."""

from __future__ import annotations

import os
import shutil
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import id_list

ENTITY = "entity_id STRING, business_name STRING, business_address STRING, country STRING"
TRUTH = "source1_entity_id STRING, matched_entity_ids STRING"
BASE = "source STRING, entity_id STRING, business_name STRING, business_address STRING"


def read_entities(spark: SparkSession, path: str, source: int, country: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """A tab-separated entity file with doc_idx, its line order.

    The schema is given, never inferred. doc_idx comes from the position in the file (`_metadata` block offset, then the
    order within the block), so it is the same on every read of the same file.
    """
    rows = spark.read.schema(ENTITY).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return _placed(rows, source, country, ids)


def _placed(rows: DataFrame, source: int, country: str | None, ids: DataFrame | None) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = rows.select("*", place.alias("place"))
    offsets = rows.groupBy("place.f", "place.b").agg(F.count("*").alias("n"), F.min("place.i").alias("first"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.orderBy("f", "b")) - F.col("n"))  # one row for each file block
    rows = rows.join(F.broadcast(offsets.drop("n")), (F.col("place.f") == F.col("f")) & (F.col("place.b") == F.col("b")))
    rows = rows.select("entity_id", F.lit(source).alias("source"), (F.col("before") + F.col("place.i") - F.col("first")).alias("doc_idx"), "country", "business_name", "business_address")
    if country is not None:
        rows = rows.filter(F.col("country") == country)
    return rows if ids is None else rows.join(ids.select("entity_id"), "entity_id", "left_semi")


def first_rows(entities: DataFrame, n: int, country: str | None = None) -> DataFrame:
    """The first n rows by doc_idx, of one country if named."""
    rows = entities if country is None else entities.filter(F.col("country") == country)
    return rows.orderBy("doc_idx").limit(n)


def first_rows_by_group(entities: DataFrame, limits: dict[str, int]) -> DataFrame:
    """For each country named, its first rows of every source; other countries go."""
    most = F.coalesce(*(F.when(F.col("country") == c, F.lit(n)) for c, n in limits.items()))
    place = F.row_number().over(Window.partitionBy("country", "source").orderBy("doc_idx", "entity_id"))
    return entities.filter(F.col("country").isin(list(limits))).withColumn("place", place).filter(F.col("place") <= most).drop("place")


def read_links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, universe) of a tab-separated truth file; a blank list is a query without links."""
    return links_of(spark.read.schema(TRUTH).option("sep", "\t").option("header", True).option("quote", "").csv(path))


def links_of(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = F.explode(id_list(F.col("matched_entity_ids")))
    edges = lists.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("target_id")).distinct()
    return edges, lists.select(F.col("source1_entity_id").alias("s1_id")).distinct()


def write_base(entities: DataFrame, path: str, curated: DataFrame | None = None, keep: int = 500) -> None:
    """A small stored base as JSON, by country; curated rows go before the first `keep` others of their country."""
    rows = entities.select("country", F.concat(F.lit("Source "), F.col("source").cast("string")).alias("source"), "entity_id", "business_name", "business_address", F.lit(1).alias("late"), "doc_idx")
    if curated is not None:
        place = F.row_number().over(Window.partitionBy("country").orderBy("source", "doc_idx"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= keep).drop("place")
        rows = rows.unionByName(curated.select("country", "source", "entity_id", "business_name", "business_address", F.lit(0).alias("late"), F.monotonically_increasing_id().alias("doc_idx")))
    rows.repartition("country").sortWithinPartitions("country", "late", "source", "doc_idx").drop("late").write.mode("overwrite").partitionBy("country").json(path)


def read_base(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"{BASE}, doc_idx LONG, country STRING").json(path)
    return rows


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of any shape as one row."""
    return spark.read.option("multiLine", True).json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report as a JSON file."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_upload(lines: DataFrame, limit: int = 200) -> DataFrame:
    """Queries from uploaded lines (value, doc_idx) by position: id, name, address, country; the header goes.

    Missing fields are an id from the position, and empty strings.
    """
    rows = lines.filter((F.col("doc_idx") > 0) & (F.trim("value") != "")).orderBy("doc_idx").limit(limit)
    part = F.split("value", "\t")
    field = lambda i, default: F.coalesce(F.nullif(F.trim(F.get(part, F.lit(i))), F.lit("")), default)
    number = F.concat(F.lit("Q_"), F.col("doc_idx").cast("string"))
    return rows.select(field(0, number).alias("entity_id"), field(1, F.lit("")).alias("business_name"), field(2, F.lit("")).alias("business_address"), field(3, F.lit("")).alias("country"), "doc_idx")


def id_lists(queries: DataFrame, pairs: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """(source1_entity_id, name, s1_idx): one row for every query; its targets by source and rank, comma-joined, blank if none."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("source", "rank", "target_id"))).alias("l"))
    ids = F.transform("l", lambda x: x["target_id"])
    ids = F.slice(ids, 1, most) if most else ids
    rows = queries.select(F.col("entity_id").alias("s1_id"), F.col("doc_idx").alias("s1_idx")).join(lists, "s1_id", "left")
    return rows.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.array_join(ids, ","), F.lit("")).alias(name), "s1_idx")


def write_lists(lists: DataFrame, path: str, queries: DataFrame | None = None) -> None:
    """Tab-separated with a header, in the order of the queries; given those, country by country in the order in which they first occur."""
    name = lists.columns[1]
    order = ["s1_idx"]
    if queries is not None:
        first = queries.groupBy("country").agg(F.min("doc_idx").alias("__first"))
        of = queries.select(F.col("entity_id").alias("__id"), "country").join(first.withColumnRenamed("country", "__c"), F.col("country").eqNullSafe(F.col("__c")))
        lists, order = lists.join(of, F.col("source1_entity_id") == F.col("__id")), ["__first", "s1_idx"]
    lists.orderBy(*order).select("source1_entity_id", name).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def write_entities(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_partitioned(entities: DataFrame, path: str) -> None:
    """Parquet by source and country, so that a filter on either reads only its folders; a large country has several files."""
    entities.hint("rebalance", "source", "country").write.mode("overwrite").partitionBy("source", "country").parquet(path)


def read_lists(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(source1_entity_id, name) as write_lists writes them, in the order of the file."""
    rows = spark.read.schema(f"source1_entity_id STRING, {name} STRING").option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.withColumn(name, F.coalesce(name, F.lit("")))


def placed_links(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(source1_entity_id, id, place): the links of lists as write_lists writes them, numbered from 1 in the order of the files.

    Readers deal out blocks of files by size, so the place is taken from a file's number and a block's offset in it; the
    links of each block are counted first, and no table is numbered in one task.
    """
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("file")
    rows = read_lists(spark, path, name).select(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "source1_entity_id", id_list(F.col(name)).alias("ids"))
    sizes = rows.groupBy("file", "block").agg(F.sum(F.size("ids")).alias("n"))
    ahead = sizes.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))  # a row for each block
    rows = rows.select("file", "block", "row", "source1_entity_id", F.posexplode("ids").alias("at", "id")).join(ahead, ["file", "block"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("row", "at"))
    return rows.select("source1_entity_id", "id", place.cast("long").alias("place"))


def bundle(paths: dict[str, str], target: str) -> str:
    """A deflated zip of local result folders as single files, named by the keys; and a copy of each beside it.

    For results that a person downloads: the parts of a local folder are joined on the driver, as streams.
    """
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for name, path in paths.items():
            beside = os.path.join(os.path.dirname(target), name)
            with open(beside, "wb") as whole:
                for k, part in enumerate(sorted(p for p in os.listdir(path) if p.startswith("part-"))):
                    with open(os.path.join(path, part), "rb") as f:
                        if k:
                            f.readline()
                        shutil.copyfileobj(f, whole)
            out.write(beside, name)
    return target


def source_path(folder: str, source: int, country: str | None = None) -> str:
    """The training file of a source, or the test file where there is none or for a country that only the test has."""
    train = os.path.join(folder, f"train_source{source}.tsv")
    return train if os.path.exists(train) and country != "France" else os.path.join(folder, f"test_source{source}.tsv")
