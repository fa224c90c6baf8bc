"""Pair scores, thresholds and conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.constants import BOOST, MATCH_THRESHOLD
from tessera.functions import similarity as S
from tessera.functions import text as T


def with_strings(entities: DataFrame, null_as_nan: bool = False) -> DataFrame:
    """Adds `full` and `full_compact`, computed once for each entity and not for each pair."""
    full = T.full_string(F.col("business_name"), F.col("business_address"), null_as_nan)
    return entities.withColumn("full", full).withColumn("full_compact", T.letters(F.col("full")))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions: work in Python is long for its bytes, so small data must not meet in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scored_pairs(pairs: DataFrame, queries: DataFrame, targets: DataFrame, boost: bool = True, null_as_nan: bool = False, keep: bool = False) -> DataFrame:
    """pairs with `sim`: the token set ratio of the full strings, lifted where one compact string holds the other; keep: with that fact as `held`."""
    left = with_strings(queries, null_as_nan).select(F.col("entity_id").alias("s1_id"), F.col("full").alias("a"), F.col("full_compact").alias("ac"))
    right = with_strings(targets, null_as_nan).select(F.col("entity_id").alias("target_id"), F.col("full").alias("b"), F.col("full_compact").alias("bc"))
    rows = pairs.join(left, "s1_id").join(right, "target_id")
    rows = spread(rows, "s1_id", "target_id").withColumn("sim", S.token_set_ratio(F.col("a"), F.col("b")))
    if boost:
        rows = rows.withColumn("sim", S.boosted(F.col("sim"), F.col("ac"), F.col("bc"), BOOST))
    if keep:
        rows = rows.withColumn("held", S.contains_either(F.col("ac"), F.col("bc")))
    return rows.withColumn("sim", F.round("sim", 6)).drop("a", "b", "ac", "bc")


def at_least(pairs: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    return pairs.filter(F.col("sim") >= threshold)


def one_owner(matches: DataFrame) -> DataFrame:
    """Of all queries that claim a target, the most similar one keeps it; the first query of equals."""
    owner = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("sim"), "s1_idx", "s1_id"))
    return matches.withColumn("owner", owner).filter("owner = 1").drop("owner")


def reasons(pairs: dict[str, Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(said)) for said, c in pairs.items())), lambda x: x.isNotNull())


def prefix_matches(queries: DataFrame, pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Baseline: the query's plain name begins the target's full string."""
    left = queries.select(F.col("entity_id").alias("s1_id"), T.pure_name(F.col("business_name")).alias("name"))
    right = targets.select(F.col("entity_id").alias("target_id"), T.full_string(F.col("business_name"), F.col("business_address")).alias("full"))
    rows = pairs.join(left, "s1_id").join(right, "target_id")
    return rows.filter((F.length("name") > 0) & F.startswith("full", "name")).drop("name", "full")


def stored_base(queries: DataFrame, base: DataFrame, limit: int | None = None) -> DataFrame:
    """All pairs of queries with a small stored base of records, limited to its first rows if asked.

    A nested loop by design: the base is a bounded deployment file, checked before it is broadcast.
    """
    rows = base if limit is None else base.orderBy("doc_idx").limit(limit)
    size = rows.count()
    if size > 2000:
        raise ValueError(f"a stored base of {size} records; use candidates() for more than 2000")
    name, address = T.simple_clean(F.col("business_name")), T.simple_clean(F.col("business_address"))
    full = T.phonetic(F.concat(name, F.lit(" "), address))
    right = rows.select("country", F.col("entity_id").alias("target_id"), "source", "doc_idx", T.letters(name).alias("b"), full.alias("b_full"))
    left = queries.select("country", F.col("entity_id").alias("s1_id"), F.col("doc_idx").alias("s1_idx"), T.letters(name).alias("a"), full.alias("a_full"))
    pairs = spread(left, "s1_id").join(F.broadcast(right), "country")
    score = S.boosted(S.token_set_ratio(F.col("a_full"), F.col("b_full")), F.col("a"), F.col("b"), BOOST)
    return pairs.withColumn("sim", F.round(score, 6)).select("s1_id", "s1_idx", "source", "target_id", "doc_idx", "sim")
