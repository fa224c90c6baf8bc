"""python -m tessera link|train|evaluate: the batch plans over tab-separated files.

link FOLDER OUT      candidate_pairs and matching_results of all countries, and both as a zip
train FOLDER OUT     fits the pair classifier and saves it with its threshold
evaluate FOLDER OUT  the report of the link plan against the truth, as JSON
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import features as X
from tessera.operators import learn as L
from tessera.plans import linkage as P
from tessera.sources import tables as IO


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("plan", choices=["link", "train", "evaluate"])
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--threshold", type=float, default=None)
    parser.add_argument("--rounds", type=int, default=60)
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"tessera-{asked.plan}").getOrCreate()
    queries = IO.read_entities(spark, IO.source_path(asked.folder, 1), 1)
    targets = IO.read_entities(spark, IO.source_path(asked.folder, 2), 2).unionByName(IO.read_entities(spark, IO.source_path(asked.folder, 3), 3))
    if asked.plan == "link":
        out = P.link(queries, targets, threshold=asked.threshold or P.MATCH_THRESHOLD)
        names = {"candidate_pairs.tsv": (out.candidates, "candidate_entity_ids"), "matching_results.tsv": (out.matches, "matched_entity_ids")}
        paths = {}
        for name, (pairs, column) in names.items():
            paths[name] = os.path.join(asked.out, name.removesuffix(".tsv"))
            IO.write_lists(IO.id_lists(queries, pairs, column), paths[name], queries)
        IO.bundle(paths, os.path.join(asked.out, "results.zip"))
        return
    truth, universe = IO.read_links(spark, os.path.join(asked.folder, "train_ground_truth.tsv"))
    if asked.plan == "train":
        model, threshold, table, _ = P.train(queries, targets, truth, rounds=asked.rounds)
        L.save_model(model, asked.out, X.NAMES, threshold=threshold, val_f05=table.agg(F.max("f05")).first()[0] or 0.0)
        return
    IO.write_report(E.report(predictions=P.link(queries, targets).matches, ground_truth=truth, universe=universe), asked.out)


if __name__ == "__main__":
    main()
