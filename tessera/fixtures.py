"""Entity views over the test tables: parts and documents read as records of three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.evaluate import Groups


def part_entities(spark: SparkSession, sf_dir: str, country: str = "p_brand") -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    source = (1 + F.col("p_partkey") % 3).cast("int")
    address = F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_brand")
    return p.select(F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"), source.alias("source"), F.col("p_partkey").cast("long").alias("doc_idx"), F.col(country).alias("country"), F.col("p_name").alias("business_name"), address.alias("business_address"))


def doc_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the name, the last one the address."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = (1 + F.col("doc_id") % 3).cast("int")
    return d.select(F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), source.alias("source"), F.col("doc_id").cast("long").alias("doc_idx"), F.col("lang").alias("country"), F.substring_index("text", "\n", 1).alias("business_name"), F.substring_index("text", "\n", -1).alias("business_address"))


def part_truth(spark: SparkSession, sf_dir: str, country: str = "p_brand") -> DataFrame:
    """(s1_id, target_id): parts of sources 2 and 3 with the same country and name."""
    queries, targets = sides(part_entities(spark, sf_dir, country))
    left = queries.select(F.col("entity_id").alias("s1_id"), "country", "business_name")
    return left.join(targets.select(F.col("entity_id").alias("target_id"), "country", "business_name"), ["country", "business_name"]).select("s1_id", "target_id")


def part_groups(spark: SparkSession, sf_dir: str, country: str = "p_brand") -> Groups:
    """part_truth as groups."""
    queries, targets = sides(part_entities(spark, sf_dir, country))
    group = F.when(F.col("country").isNotNull() & F.col("business_name").isNotNull(), F.struct("country", "business_name")).alias("group")
    return Groups(queries.select(F.col("entity_id").alias("s1_id"), group), targets.select(F.col("entity_id").alias("target_id"), group))


def doc_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, target_id): documents of sources 2 and 3 with the same language and the same text but for case and white space."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    rows = d.select((1 + F.col("doc_id") % 3).cast("int").alias("source"), F.col("doc_id").cast("string").alias("id"), "lang", mark.alias("mark"))
    left = rows.filter("source = 1").select(F.concat(F.lit("S1-"), "id").alias("s1_id"), "lang", "mark")
    right = rows.filter("source > 1").select(F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-"), "id").alias("target_id"), "lang", "mark")
    return left.join(right, ["lang", "mark"]).select("s1_id", "target_id")


def doc_groups(spark: SparkSession, sf_dir: str) -> Groups:
    """doc_truth as groups."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    group = F.when(F.col("lang").isNotNull() & F.col("text").isNotNull(), F.struct(F.col("lang"), mark.alias("mark"))).alias("group")
    source = (1 + F.col("doc_id") % 3).cast("int")
    id_ = F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    return Groups(d.filter(source == 1).select(id_.alias("s1_id"), group), d.filter(source > 1).select(id_.alias("target_id"), group))


def sides(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (source 1) and targets."""
    return entities.filter("source = 1"), entities.filter("source > 1")
