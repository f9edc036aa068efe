"""Command line: ``python -m samewise.cli prepare|block|train|resolve|validate ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from samewise.config import Decision, ErConfig, Prune
from samewise.operators import evaluate
from samewise.operators.validate import validate_outputs
from samewise.plans import resolve as plan
from samewise.sources import sinks, tables


def _prepared(spark: SparkSession, root: str, split: str):  # noqa: ANN202
    sources = [tables.load_prepared(spark, f"{root}/{split}_s{k}") for k in (1, 2, 3)]
    return sources[0], tables.pool(*sources[1:])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="samewise")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("prepare", "block", "train", "resolve"):
        c = sub.add_parser(name)
        c.add_argument("--data", required=True, help="folder with the sources")
        c.add_argument("--work", required=True, help="folder for prepared tables and models")
        c.add_argument("--split", default="test" if name == "resolve" else "train")
        c.add_argument("--out", default="output")
        c.add_argument("--rounds", type=int, default=40)
    v = sub.add_parser("validate")
    v.add_argument("-m", "--matching", required=True)
    v.add_argument("-c", "--candidates")
    v.add_argument("-t", "--test-dir", required=True)
    v.add_argument("--check-ids", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("samewise").getOrCreate()
    cfg = ErConfig.from_env()

    if a.command == "validate":
        required = tables.read_id_set(spark, f"{a.test_dir}/test_source1.tsv")
        valid = None
        if a.check_ids:
            valid = tables.read_id_set(spark, f"{a.test_dir}/test_source2.tsv").union(tables.read_id_set(spark, f"{a.test_dir}/test_source3.tsv"))
        errors, warnings = validate_outputs(spark, a.matching, required, a.candidates, valid)
        for kind, lines in (("error", errors), ("warning", warnings)):
            for line in lines:
                print(f"{kind}: {line}")
        print("FAIL" if errors else "PASS")
        return int(bool(errors))

    for k in (1, 2, 3):
        path = tables.find_source(spark, a.data, a.split, k)
        if path is None:
            print(f"no {a.split}_source{k}.tsv below {a.data}", file=sys.stderr)
            return 1
        tables.write_prepared(tables.read_tsv(spark, path), f"{a.work}/{a.split}_s{k}", cfg.variant)
    if a.command == "prepare":
        return 0
    index, pool = _prepared(spark, a.work, a.split)
    if a.command in ("block", "train"):
        labels = tables.read_truth(spark, f"{a.data}/{a.split}/{a.split}_ground_truth.tsv")
        truth, known = evaluate.truth_pairs(labels), labels.select(F.col("source1_entity_id").alias("s1")).distinct()
        if a.command == "block":
            print(plan.evaluate_blocking(index, pool, truth, known, cfg).first())
        else:
            print(json.dumps(plan.train(index, pool, truth, cfg, a.rounds, a.work)[1], indent=1))
        return 0
    meta = sinks.read_metadata(f"{a.work}/model_meta.json")
    cfg = ErConfig(k=meta["K"], prune=Prune(**meta["prune"]), decision=Decision(**meta["decision"]), rerank=cfg.rerank)
    lists = plan.resolve(index, pool, PipelineModel.load(f"{a.work}/model"), cfg)
    sinks.write_id_lists(lists, f"{a.out}/matching_results", order="s1")
    pairs = plan.candidates(index, pool, cfg).groupBy("s1").agg(F.array_sort(F.collect_list("cand")).alias("ids"))
    every = index.select(F.col("entity_id").alias("s1")).join(pairs, "s1", "left").select("s1", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    sinks.write_id_lists(every, f"{a.out}/candidate_pairs", "candidate_entity_ids", order="s1")
    return 0


if __name__ == "__main__":
    sys.exit(main())
