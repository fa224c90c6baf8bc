"""Retrieval, matching, evaluation and learning on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from tessera.fixtures import part_entities, sides
from tessera.operators import blocking as B
from tessera.operators import evaluate as E
from tessera.operators import features as X
from tessera.operators import learn as L
from tessera.operators import match as M
from tessera.plans import linkage as P
from tessera.sources import tables as IO

SF = "/root/testdata/sf0.001"
ENTITY = "entity_id string, source int, doc_idx long, country string, business_name string, business_address string"

CASES = [
    ({"a", "b"}, {"a", "b"}, 1.0), ({"a"}, {"a"}, 1.0), (set(), set(), 1.0), ({"a"}, set(), 0.0), (set(), {"a"}, 0.0), ({"a", "x"}, {"a"}, 5 / 9), ({"a"}, {"a", "b"}, 5 / 6), ({"a", "b", "x"}, {"a", "b", "c"}, 2 / 3),
]


def edges(spark, sets):
    return spark.createDataFrame([(f"q{i}", t) for i, s in enumerate(sets) for t in s] or [(None, None)], "s1_id string, target_id string").filter("s1_id is not null")


def test_metric_cases(spark):
    universe = spark.createDataFrame([(f"q{i}",) for i in range(len(CASES))], "s1_id string")
    counts = E.entity_counts(predictions=edges(spark, [p for p, _, _ in CASES]), ground_truth=edges(spark, [t for _, t, _ in CASES]), universe=universe)
    rows = E.entity_scores(counts).orderBy("s1_id").collect()
    for r, (_, _, want) in zip(rows, CASES, strict=True):
        assert abs(r.f05 - want) < 1e-12 and abs(r.f05_direct - r.f05) < 1e-12


def test_predicting_nothing_has_recall_of_the_singletons(spark):
    truth = edges(spark, [{"a"}, set(), {"b", "c"}, set()])
    universe = spark.createDataFrame([(f"q{i}",) for i in range(4)], "s1_id string")
    r = E.report(predictions=truth.limit(0), ground_truth=truth, universe=universe).first()
    assert (r.macro_recall, r.macro_precision, r.fp_links, r.fn_links, r.singleton_correct) == (0.5, 0.5, 0, 3, 2) and r.score_counts["1.0"] == 2


@pytest.fixture(scope="module")
def parts(spark):
    return sides(part_entities(spark, SF))


def test_linkage_invariants(spark, parts):
    queries, targets = parts
    out = P.link(queries, targets)
    found, matched = out.candidates.select("s1_id", "target_id").collect(), out.matches.collect()
    assert {(r.s1_id, r.target_id) for r in matched} <= {tuple(r) for r in found}
    assert len({r.target_id for r in matched}) == len(matched) and all(r.sim >= 74 for r in matched)
    lists = IO.id_lists(queries, out.matches, "matched_entity_ids").collect()
    assert sorted(r.source1_entity_id for r in lists) == sorted(r.entity_id for r in queries.collect())
    again = P.link(queries.repartition(3), targets.repartition(7)).matches.select("s1_id", "target_id", "sim").collect()
    assert sorted(map(tuple, again)) == sorted((r.s1_id, r.target_id, r.sim) for r in matched)


def test_nulls_and_countries(spark):
    rows = [
        ("S1-1", 1, 1, "US", "Acme Widgets", "12 Oak Street"), ("S1-2", 1, 2, None, "Acme Widgets", "12 Oak"), ("S1-3", 1, 3, "US", None, None), ("S2-1", 2, 1, "US", "Acme Widgets Inc", "12 Oak St"),
        ("S2-2", 2, 2, "FR", "Acme Widgets", "12 Oak"), ("S2-3", 2, 3, "US", None, None), ("S3-1", 3, 1, "US", "acmewidgets.com", "12 Oak"),
    ]
    queries, targets = sides(spark.createDataFrame(rows, ENTITY))
    out = P.link(queries, targets)
    assert {(r.s1_id, r.target_id) for r in out.matches.collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    lists = {r.source1_entity_id: r.matched_entity_ids for r in IO.id_lists(queries, out.matches, "matched_entity_ids").collect()}
    assert lists == {"S1-1": "S2-1,S3-1", "S1-2": "", "S1-3": ""}
    assert P.batch_counts(queries, out.matches).first() == (3, 1, 2)
    r = {r.s1_id: r for r in P.resolve(queries, targets, 0).collect()}
    assert r["S1-1"].matches_count == 2 and r["S1-3"].is_singleton and r["S1-2"].country == "US"


def test_owner_ties_go_to_the_first_query(spark):
    rows = spark.createDataFrame([("b", 2, "t", 90.0), ("a", 1, "t", 90.0), ("c", 0, "t", 80.0)], "s1_id string, s1_idx long, target_id string, sim double")
    assert M.one_owner(rows).first().s1_id == "a"


def test_caps_and_slices(spark):
    rows = [(f"S2-{i}", 2, i, "US", "common rare%d" % (i % 2), "") for i in range(30)]
    targets = spark.createDataFrame(rows, ENTITY)
    index = B.MULTI_CHANNEL.with_sizes(name=(20, 3))
    got = B.postings(targets, index).filter("channel = 'name'").collect()
    assert {r.key for r in got} == {"rare0", "rare1"} and len(got) == 6 and {r.df for r in got} == {15}


def test_features(spark, parts):
    queries, targets = parts
    pairs = B.candidates(queries, targets, B.DUAL).select("s1_id", "target_id").limit(20)
    got = X.pair_features(pairs, queries, targets)
    assert got.columns == ["s1_id", "target_id", *X.NAMES] and len(X.NAMES) == 35 and {k for _, k in got.dtypes[2:]} == {"float"}
    same = X.pair_features(spark.createDataFrame([("S1-3", "S1-3"), ("S1-3", "none")], "s1_id string, target_id string"), queries, queries, kind="double").collect()
    one = next(r for r in same if r.target_id == "S1-3").asDict()
    assert one["name_word_jaccard"] == one["name_fuzz_ratio"] == one["combined_confidence_score"] == 1.0 and one["name_diff_tokens_count"] == 0
    assert next(r for r in same if r.target_id == "none").name_either_empty == 1.0


def test_learning_and_models(spark, tmp_path, parts):
    queries, targets = parts
    truth = queries.select("country", "business_name", F.col("entity_id").alias("s1_id")).join(targets.select("country", "business_name", F.col("entity_id").alias("target_id")), ["country", "business_name"]).select("s1_id", "target_id")
    model, threshold, table, scored = P.train(queries, targets, truth, rounds=3, names=X.SET_BASED)
    assert 0.2 <= threshold < 0.9 and table.count() == 14 and scored.filter("prob between 0 and 1").count() == scored.count()
    L.save_model(model, str(tmp_path / "m"), X.SET_BASED, threshold=threshold)
    loaded, names, facts = L.load_model(spark, str(tmp_path / "m"))
    assert names == X.SET_BASED and facts["threshold"] == threshold and len(L.importances(loaded, names)) == 12


def test_splits_are_disjoint_and_exact(spark):
    df = spark.createDataFrame([(f"e{i}", "ab"[i % 3 == 0]) for i in range(200)], "entity_id string, country string")
    split = L.holdout_splits(df, {"a": (20, 10), "b": (5, 5)})
    assert {(r.country, r.split): r.n for r in split.groupBy("country", "split").agg(F.count("*").alias("n")).collect()} == {("a", "hidden_test"): 20, ("a", "dev"): 10, ("a", "train_pool"): 103, ("b", "hidden_test"): 5, ("b", "dev"): 5, ("b", "train_pool"): 57}
    assert {r.split: r.n for r in L.train_val_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 160, "val": 40}
    assert L.stratified_sample(df, 30).count() == 60


def test_files(spark, tmp_path, parts):
    queries, targets = parts
    rows = targets.orderBy("doc_idx").select("entity_id", "business_name", "business_address", "country")
    path = str(tmp_path / "t.tsv")
    with open(path, "w") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows.collect()))
    got = IO.read_entities(spark, path, 2).orderBy("doc_idx").collect()
    assert [r.entity_id for r in got] == [r.entity_id for r in rows.collect()] and [r.doc_idx for r in got] == list(range(len(got)))
    lists = IO.id_lists(queries, B.candidates(queries, targets), "candidate_entity_ids")
    IO.write_lists(lists, str(tmp_path / "c"))
    name = IO.bundle({"candidate_pairs.tsv": str(tmp_path / "c")}, str(tmp_path / "out" / "all.zip"))
    import zipfile

    text = zipfile.ZipFile(name).read("candidate_pairs.tsv").decode().splitlines()
    assert text[0] == "source1_entity_id\tcandidate_entity_ids" and len(text) == queries.count() + 1
    IO.write_partitioned(targets, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("source = 2").count() == targets.filter("source = 2").count()
    IO.write_base(targets, str(tmp_path / "base"))
    assert IO.read_base(spark, str(tmp_path / "base")).count() == targets.count()
    up = spark.createDataFrame([("entity_id\tname", 0), ("x\tA\tB\tUS", 1), ("\tonly", 2), ("", 3)], "value string, doc_idx long")
    assert [(r.entity_id, r.business_name, r.country) for r in IO.read_upload(up).orderBy("doc_idx").collect()] == [("x", "A", "US"), ("Q_2", "only", "")]


def test_stream_of_queries(spark, tmp_path, parts):
    from tessera.streaming.micro_batches import link_stream

    queries, targets = parts
    queries.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    link_stream(spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in")), targets, lambda df, _: seen.extend(df.select("s1_id", "target_id").collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, seen)) == sorted((r.s1_id, r.target_id) for r in P.link(queries, targets).matches.collect())


def test_command_line(spark, tmp_path, parts):
    import json
    import zipfile

    from tessera.__main__ import main

    queries, targets = parts
    every = queries.unionByName(targets)
    for k in (1, 2, 3):
        rows = every.filter(F.col("source") == k).orderBy("doc_idx").limit(40).select("entity_id", "business_name", "business_address", "country").collect()
        (tmp_path / f"train_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))
        if k == 1:
            (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{r.entity_id}\t\n" for r in rows))
    main(["link", str(tmp_path), str(tmp_path / "out")])
    with zipfile.ZipFile(tmp_path / "out" / "results.zip") as z:
        assert [len(z.read(n).decode().splitlines()) for n in sorted(z.namelist())] == [41, 41]
    main(["evaluate", str(tmp_path), str(tmp_path / "report")])
    (part,) = (tmp_path / "report").glob("part-*")
    assert json.loads(part.read_text())["singleton_total"] == 40


def test_links_are_placed_in_the_order_of_the_files(spark, tmp_path):
    """Readers take large files first, and large files in blocks."""
    lines = [[f"q{k},x{k}" for k in range(n)] for n in (3, 2000, 40)]
    want = []
    for k, part in enumerate(lines):
        rows = [line.split(",") for line in part]
        (tmp_path / f"part-{k:05d}-z.csv").write_text("source1_entity_id\tids\n" + "".join(f"{k}{q}\t{x},y\n" for q, x in rows))
        want += [(f"{k}{q}", t) for q, x in rows for t in (x, "y")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = IO.placed_links(spark, str(tmp_path), "ids").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.source1_entity_id, r.id) for r in got] == want and [r.place for r in got] == list(range(1, len(want) + 1))


def test_pairs_of_a_frequent_name_stay_within_the_best(spark):
    """A name that all have: the best k are those of other channels too, wherever in the list, then the first ones."""
    rows = [(f"S1-{i}", 1, i, "US", "Blue Ring", f"{10 + i % 7} Oak Hill") for i in range(40)]
    rows += [(f"S{2 + i % 2}-{i}", 2 + i % 2, i, "US", "Blue Ring" if i % 5 else "Red Ring", f"{10 + i % 11} Elm Hill") for i in range(300)]
    queries, targets = sides(spark.createDataFrame(rows, ENTITY))
    index = B.MULTI_CHANNEL.with_sizes(k=4, numaddr=(1500, 20), name=(250, 6))
    listed = B.postings(targets, index).collect()
    keys = {}
    for r in B.tall_keys(queries, index).collect():
        keys.setdefault(r.entity_id, set()).add((r.channel, r.key))
    want = set()
    for q, own in keys.items():
        for source in (2, 3):
            score = {}
            for r in listed:
                if r.source == source and (r.channel, r.key) in own:
                    score[r.doc_idx, r.entity_id] = score.get((r.doc_idx, r.entity_id), 0.0) + r.weight
            best = sorted((-round(x, 9), *t) for t, x in score.items())[:4]
            want |= {(q, source, t, round(-x, 6), k + 1) for k, (x, _, t) in enumerate(best)}
    found = B.candidates(queries, targets, index)
    assert {(r.s1_id, r.source, r.target_id, round(r.score, 6), r["rank"]) for r in found.collect()} == want
    assert any(int(t.split("-")[1]) > 20 for _, _, t, _, _ in want)
    # No plan's rows are the pairs of queries and targets: they are summed within a block.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(weight" not in plan


def test_truth_as_groups_counts_what_its_links_count(spark):
    """Repeated edges, ids without a group, queries outside the universe; and no link is made."""
    truth = E.Groups(
        spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", None), ("q4", "a"), ("q5", "z")], "s1_id string, `group` string"),
        spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "b"), ("t4", None)], "target_id string, `group` string"),
    )
    predictions = spark.createDataFrame([("q1", "t1"), ("q1", "t1"), ("q1", "t3"), ("q2", None), ("q3", "t4"), ("q6", "t1"), ("q4", "t9")], "s1_id string, target_id string")
    universe = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q5",), ("q6",)], "s1_id string")
    got, want = (E.entity_counts(predictions=predictions, ground_truth=t, universe=universe) for t in (truth, truth.links()))
    rows = lambda df: sorted(map(tuple, df.select("s1_id", "n_pred", "n_true", "tp").collect()))
    assert rows(got) == rows(want) == [("q1", 2, 2, 1), ("q2", 0, 1, 0), ("q3", 1, 0, 0), ("q5", 0, 0, 0), ("q6", 1, 0, 0)]


def test_draws_are_those_of_the_hash(spark):
    import hashlib

    import numpy as np

    from tessera.operators import draws

    for lo, hi in ((0, 1), (7, 12), (98, 1005), (999_999_990, 1_000_000_010)):
        for head in (b"42|0|", b"42|17|", b"42|999|", b"-1|1000|"):
            got = np.concatenate([draws.md5_head(head, x) for x in draws.runs_of_digits(lo, hi)])
            assert got.tolist() == [int(hashlib.md5(head + str(k).encode()).hexdigest()[:15], 16) for k in range(lo, hi)]
    n, repeats = 9000, 60  # more than one unit of work each way
    values = [None if k % 11 == 0 else k % 7 / 7 for k in range(n)]
    rows = spark.createDataFrame(list(enumerate(values)), "at long, v double")
    got = [{r.rep: r.m for r in draws.resampled_means(rows, n, repeats, 42, most).collect()} for most in (n, n - 1)]
    assert len(got[0]) == len(got[1]) == repeats and all(abs(got[0][k] - got[1][k]) < 1e-12 for k in got[0])
    for rep in (0, 49, 59):
        drawn = [values[int(hashlib.md5(f"42|{rep}|{k}".encode()).hexdigest()[:15], 16) % n] for k in range(n)]
        drawn = [x for x in drawn if x is not None]
        assert abs(sum(drawn) / len(drawn) - got[0][rep]) < 1e-12


def test_a_million_draws_take_a_second():
    import time

    import pyarrow as pa

    from tessera.operators import draws

    began = time.process_time()
    units = [pa.RecordBatch.from_arrays([pa.array([0, 1, 2])], ["id"])]
    assert sum(len(at) for _, at in draws._units(iter(units), 8192, 150, 42)) == 150 * 8192
    assert time.process_time() - began < 2


def test_counts_of_groups_on_both_sides(spark):
    """Equal to those of their links; 20,000 queries and as many targets under one name have 4 * 10 ** 8 links, none of which is made."""
    from tessera.operators import evaluate as E

    queries = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "y"), ("e", "z")], "s1_id string, group string")
    targets = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None), ("4", "y"), (None, "y")], "target_id string, group string")
    truth = E.Groups(spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "s1_id string, group int"), spark.createDataFrame([("1", 1), ("2", 2), ("3", 2), ("5", 3)], "target_id string, group int"))
    guess, universe = E.Groups(queries, targets), queries.select("s1_id")
    got, want = (sorted(map(tuple, E.entity_counts(predictions=p, ground_truth=t, universe=universe).collect())) for p, t in ((guess, truth), (guess.links(), truth.links())))
    assert got == want == [("a", 2, 1, 1), ("b", 2, 2, 1), ("c", 0, 2, 0), ("d", 1, 1, 0), ("e", 0, 0, 0)]
    ids = spark.range(20_000)
    one = E.Groups(ids.selectExpr("string(id) s1_id", "'n' group"), ids.selectExpr("string(id) target_id", "'n' group"))
    assert E.entity_counts(predictions=one, ground_truth=one, universe=one.queries).filter("tp = 20000").count() == 20_000


def test_every_pair_that_shares_a_key_is_counted(spark, monkeypatch):
    """One name and number for many: no partner is cut off, copies count, frequent keys go through several cells; equal to brute force."""
    from tessera.operators import classes as C

    monkeypatch.setattr(C, "CELL", 8)  # of the driver, which deals the cells out
    rows = [(f"S{1 + i % 3}-{i}", 1 + i % 3, i, "US" if i % 29 else None, ["Blue Ring", "Red Ring", "Azure Bolt", None, "Ringworks"][i % 5], f"{10 + i % 4} Oak Hill {'x' * (i % 6)}" if i % 31 else None) for i in range(150)]
    rows += [(f"S{1 + i % 3}-{i}", 1 + i % 3, i, "US", "Blue Ring", "77 Long " + " ".join(f"w{k}{i % 3}" for k in range(40))) for i in range(150, 160)]
    entities = spark.createDataFrame(rows, ENTITY)
    queries, targets = sides(entities)
    got = {r.entity_id: (r.class_id, r.n_links, r.best_sim) for r in C.link_counts(queries, targets).collect()}
    keys = {}
    for r in B.tall_keys(entities, B.MULTI_CHANNEL).collect():
        keys.setdefault(r.entity_id, set()).add((r.country, r.channel, r.key))
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[1] == 1 < b[1] and keys.get(a[0], set()) & keys.get(b[0], set())]
    sims = M.at_least(M.scored_pairs(spark.createDataFrame(pairs, "s1_id string, target_id string"), queries, targets)).collect()
    first, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        first.setdefault((r[3], r[4] or "", r[5] or ""), r[0])
    for r in rows:
        near = [x.sim for x in sims if r[0] in (x.s1_id, x.target_id)]
        want[r[0]] = (first[r[3], r[4] or "", r[5] or ""], len(near), max(near, default=None))
    assert got == want and max(n for _, n, _ in got.values()) > 20


def test_part_links_have_no_cap(spark):
    """Three a source and five a key were all that a query could have."""
    from tessera import queries as Q

    rows = Q.CATALOGUE["match_threshold"][0](spark, SF).collect()
    assert len(rows) == 200 and max(r.n_links for r in rows) > 6
    assert sum(r.n_links for r in rows if r.source == 1) == sum(r.n_links for r in rows if r.source > 1)


def test_training_on_classes_is_training_on_pairs(spark):
    """Copies are one row with a weight, and truth as groups gives the rows that its links give."""
    from tessera.operators.evaluate import Groups

    rows = [(f"S{1 + i % 3}-{i}", 1 + i % 3, i, "US", ["Blue Ring", "Red Ring", "Old Plate"][i % 5 % 3], f"{10 + i % 4} Oak Hill") for i in range(90)]
    queries, targets = sides(spark.createDataFrame(rows, ENTITY))
    group = F.col("business_name").alias("group")
    truth = Groups(queries.select(F.col("entity_id").alias("s1_id"), group), targets.select(F.col("entity_id").alias("target_id"), group))
    left, right = L.classes(queries, "s1"), L.classes(targets, "target")
    got, want = ({(r.s1_class, r.target_class): r.weight for r in L.true_class_pairs(t, left, right).collect()} for t in (truth, truth.links()))
    assert got == want and sum(got.values()) == truth.links().count() > len(got)
    found = B.candidates(queries, targets, B.DUAL)
    lists = [sorted((r.s1_id, r.target_id) for r in df.collect()) for df in (L.nearest_wrong(L.labelled(found, truth), truth), L.hard_negatives(found, truth.links()).filter("label = 0"))]
    assert lists[0] == lists[1]
    tables = [P.train(queries, targets, t, rounds=2)[2:] for t in (truth, truth.links())]
    assert tables[0][0].count() == 14 and len({tuple(map(tuple, t.collect())) for t, _ in tables}) == 1
    # 25 pairs make a leaf, though they are two rows.
    rows = spark.createDataFrame([(0.0, 0, 40.0), (1.0, 1, 40.0)], "x double, label int, weight double")
    probs = [r.prob for r in L.predicted(L.fit_classifier(rows, ["x"], rounds=1), rows).orderBy("x").collect()]
    assert probs[0] < 0.5 < probs[1]
