"""Samples, splits, training pairs and the pair classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.evaluate import Groups, hashed, true_sizes, with_hits
from tessera.operators.staging import fresh_folder


def first_by_hash(df: DataFrame, by: str, most: Column, id_col: str, seed: Column) -> DataFrame:
    """Adds `place`: the rank from 1, within the group, of rows in an order by a hash of (id, seed); null beyond the first `most`.

    The hash's high bits are counted first, so that only the rows up to the bucket in which a group's last place lies
    are sorted, whatever the size of the group.
    """
    rows = df.withColumn("__h", hashed(F.col(id_col), seed)).withColumn("__b", F.shiftright("__h", 44)).withColumn("__most", most)
    sizes = rows.groupBy(by, "__b").agg(F.count("*").alias("n"), F.max("__most").alias("most"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("__b")) - F.col("n")  # at most 65536 rows of a group
    last = sizes.withColumn("before", before).filter(F.col("before") < F.col("most")).groupBy(by).agg(F.max("__b").alias("__last"))
    rows = rows.withColumn("__by", F.col(by)).join(last.withColumnRenamed(by, "__g"), F.col("__by").eqNullSafe(F.col("__g")), "left").drop("__g")
    near = F.col("__b") <= F.coalesce("__last", F.lit(-1))
    ranked = rows.filter(near).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__h", id_col)))
    ranked = ranked.withColumn("place", F.when(F.col("place") <= F.col("__most"), F.col("place")))
    rest = rows.filter(~near).withColumn("place", F.lit(None).cast("int"))
    return ranked.unionByName(rest).drop("__h", "__b", "__most", "__by", "__last")


def stratified_sample(df: DataFrame, n: int = 20_000, by: str = "country", id_col: str = "entity_id", seed: int = 42) -> DataFrame:
    """Exactly min(n, size) rows of each group."""
    return first_by_hash(df, by, F.lit(n), id_col, F.lit(seed)).filter("place is not null").drop("place")


def placed_by_hash(df: DataFrame, id_col: str, seed: int) -> tuple[DataFrame, int]:
    """df with `place`, the rank from 1 of each row in hash order, and the number of rows; no row is ranked in one task."""
    rows = df.withColumn("__h", hashed(F.col(id_col), F.lit(seed))).withColumn("__b", F.shiftright("__h", 44))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("n"))
    ahead = sizes.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("__before"))  # at most 65536 rows
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col))
    return rows.join(F.broadcast(ahead), "__b").withColumn("place", place).drop("__h", "__b", "__before"), df.count()


def train_val_split(df: DataFrame, share: float = 0.8, id_col: str = "entity_id", seed: int = 42) -> DataFrame:
    """Adds `split`: the first `share` of all rows in hash order train, the rest validate.

    The cut is a quantile of the hashes, so no row is ranked in one task.
    """
    rows, total = placed_by_hash(df, id_col, seed)
    return rows.withColumn("split", F.when(F.col("place") <= int(total * share), "train").otherwise("val")).drop("place")


def holdout_splits(df: DataFrame, sizes: dict[str, tuple[int, int]], by: str = "country", id_col: str = "entity_id", seed: int = 42) -> DataFrame:
    """Adds `split`: by group, the first rows in hash order are hidden, the next dev, the rest train. sizes: group -> (hidden, dev)."""
    hidden = F.coalesce(*(F.when(F.col(by) == g, F.lit(h)) for g, (h, _) in sizes.items()), F.lit(0))
    dev = F.coalesce(*(F.when(F.col(by) == g, F.lit(d)) for g, (_, d) in sizes.items()), F.lit(0))
    rows = first_by_hash(df, by, hidden + dev, id_col, F.lit(seed))
    split = F.when(F.col("place") <= hidden, "hidden_test").when(F.col("place").isNotNull(), "dev").otherwise("train_pool")
    return rows.withColumn("split", split).drop("place")


def manifest(split: DataFrame, links: DataFrame, by: str = "country", id_col: str = "entity_id", seed: int = 42) -> DataFrame:
    """(split, seed, n, groups, linked): size of each split, of its groups, and how many different targets it links to."""
    sizes = split.groupBy("split", by).agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("split").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias("groups"))
    linked = split.select("split", F.col(id_col).alias("s1_id")).join(links, "s1_id").groupBy("split").agg(F.countDistinct("target_id").alias("linked"))
    return sizes.join(linked, "split", "left").select("split", F.lit(seed).alias("seed"), "n", "groups", F.coalesce("linked", F.lit(0)).alias("linked"))


def shared_links(split: DataFrame, links: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(target_id, splits): targets that more than one split links to."""
    rows = split.select("split", F.col(id_col).alias("s1_id")).join(links, "s1_id").groupBy("target_id")
    return rows.agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def labelled(found: DataFrame, truth: DataFrame | Groups) -> DataFrame:
    """found with label 1 for true links."""
    return with_hits(found, truth, "label")


def classes(entities: DataFrame, prefix: str) -> DataFrame:
    """(<prefix>_id, <prefix>_class): the least id of the records with the same country, name and address; their features are the same."""
    same = Window.partitionBy("country", "business_name", "business_address")
    return entities.select(F.col("entity_id").alias(f"{prefix}_id"), F.min("entity_id").over(same).alias(f"{prefix}_class"))


def class_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (s1_id, target_id, ..) with the class of each side; an id that isn't there is its own."""
    rows = pairs.join(left, "s1_id", "left").join(right, "target_id", "left")
    return rows.withColumn("s1_class", F.coalesce("s1_class", "s1_id")).withColumn("target_class", F.coalesce("target_class", "target_id"))


def true_class_pairs(truth: DataFrame | Groups, left: DataFrame, right: DataFrame) -> DataFrame:
    """(s1_class, target_class, weight): how many true links of left's queries two classes have; of groups no link is made."""
    if isinstance(truth, Groups):
        of = lambda df, members, c, n: df.distinct().join(members, f"{c}_id").groupBy("group", f"{c}_class").agg(F.count("*").alias(n))
        both = of(truth.queries, left, "s1", "n").join(of(truth.targets, right, "target", "m"), "group")
        return both.groupBy("s1_class", "target_class").agg(F.sum(F.col("n") * F.col("m")).alias("weight"))
    edges = truth.select("s1_id", "target_id").distinct().join(left.select("s1_id"), "s1_id", "left_semi")
    return class_pairs(edges, left, right).groupBy("s1_class", "target_class").agg(F.count("*").alias("weight"))


def nearest_wrong(found: DataFrame, truth: DataFrame | Groups, ratio: int = 4, least: int = 3) -> DataFrame:
    """The wrong candidates that hard_negatives takes; found has its labels."""
    wrong = found.filter("label = 0").join(true_sizes(truth), "s1_id", "left")
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy("rank", "source", "target_id"))
    return wrong.withColumn("place", place).filter(F.col("place") <= F.greatest(F.coalesce("n_true", F.lit(0)) * ratio, F.lit(least))).drop("place", "n_true")


def hard_negatives(found: DataFrame, truth: DataFrame, ratio: int = 4, least: int = 3) -> DataFrame:
    """(s1_id, target_id, label): all true links and, for each query, the best-ranked wrong candidates: ratio times its links, `least` at least."""
    edges = truth.select("s1_id", "target_id").distinct()
    counts = edges.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    wrong = found.join(edges, ["s1_id", "target_id"], "left_anti").join(counts, "s1_id", "left")
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy("rank", "source", "target_id"))
    wrong = wrong.withColumn("place", place).filter(F.col("place") <= F.greatest(F.coalesce("n_true", F.lit(0)) * ratio, F.lit(least)))
    return edges.withColumn("label", F.lit(1)).unionByName(wrong.select("s1_id", "target_id", F.lit(0).alias("label")))


def seed_stability(universe: DataFrame, truth: DataFrame, seeds: tuple[int, ...] = (42, 123, 456, 789, 1024), sample: int = 2000) -> DataFrame:
    """(seed, n, singletons, singleton_rate, mean_links, std_links, first_ids) of a sample drawn with each seed."""
    links = truth.select("s1_id", "target_id").distinct().groupBy("s1_id").agg(F.count("*").alias("links"))
    rows = universe.select("s1_id").join(links, "s1_id", "left").fillna(0)
    rows = rows.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    rows = first_by_hash(rows, "seed", F.lit(sample), "s1_id", F.col("seed")).filter("place is not null")
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "s1_id")))), lambda x: x["s1_id"])
    single = F.count_if(F.col("links") == 0)
    return rows.groupBy("seed").agg(F.count("*").alias("n"), single.alias("singletons"), (single / F.count("*")).alias("singleton_rate"), F.avg("links").alias("mean_links"), F.stddev_samp("links").alias("std_links"), F.array_join(first, ",").alias("first_ids"))


def stability_summary(seeds: DataFrame) -> DataFrame:
    c = F.col("mean_links")
    return seeds.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))


def distribution_shift(train: DataFrame, test: DataFrame, column: str = "country") -> DataFrame:
    """(value, n_train, n_test, p_train, p_test, shift, unseen): counts and shares of a column on both sides."""
    both = train.select(F.col(column).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(F.col(column).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    rows = both.groupBy("value").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"))
    all_ = Window.partitionBy(F.lit(1))  # one row for each value
    rows = rows.withColumn("p_train", F.col("n_train") / F.sum("n_train").over(all_)).withColumn("p_test", F.col("n_test") / F.sum("n_test").over(all_))
    return rows.withColumn("shift", F.col("p_test") - F.col("p_train")).withColumn("unseen", (F.col("n_train") == 0) & (F.col("n_test") > 0))


def empty_rate(universe: DataFrame, predictions: DataFrame, column: str = "country") -> DataFrame:
    """(column, n, n_empty, rate): queries without a prediction, by group."""
    rows = universe.join(predictions.select("s1_id", F.lit(1).alias("hit")).distinct(), "s1_id", "left")
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("n_empty")).withColumn("rate", F.col("n_empty") / F.col("n"))


def fit_classifier(train: DataFrame, names: list[str], rounds: int = 800, depth: int = 7, step: float = 0.06, seed: int = 42, least: int = 25):
    """Gradient-boosted trees over the features; an optional boolean column `validation` stops them early.

    An optional column `weight` says how many equal pairs a row stands for; a leaf then needs `least` pairs by weight.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, stepSize=step, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=seed)
    if "validation" in train.columns:
        trees = trees.setValidationIndicatorCol("validation")
    if "weight" in train.columns:
        fit_on = train.filter("not validation") if "validation" in train.columns else train
        total = fit_on.agg(F.sum("weight")).first()[0] or 1
        trees = trees.setWeightCol("weight").setMinInstancesPerNode(1).setMinWeightFractionPerNode(min((least - 0.5) / total, 0.499999))
    context = train.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():  # else the lineage grows with each round
        context.setCheckpointDir(fresh_folder(train.sparkSession))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), trees]).fit(train)


def predicted(model, rows: DataFrame) -> DataFrame:
    """rows with `prob`."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model, names: list[str], n: int = 12) -> list[tuple[str, float]]:
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def save_model(model, path: str, names: list[str], **facts: float) -> None:
    """The pipeline model, and beside it one JSON row with the feature names, threshold and validation figures."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(names, {k: float(v) for k, v in facts.items()})], "names array<string>, facts map<string,double>").coalesce(1).write.mode("overwrite").json(f"{path}/facts")


def load_model(spark, path: str):
    from pyspark.ml import PipelineModel

    facts = spark.read.schema("names array<string>, facts map<string,double>").json(f"{path}/facts").first()
    return PipelineModel.load(f"{path}/model"), facts.names, facts.facts
