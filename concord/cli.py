"""Command line: python -m concord.cli candidates | features | train | infer | validate."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from concord.plans import linkage
from concord.schema import SPLITS, BlockingConfig
from concord.sources import tsv


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="concord")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        p.add_argument("--data-root", default="data/tsv")
        for flag, kind in options:
            p.add_argument(flag, **kind)

    text = lambda default: {"default": default}
    split = {"choices": SPLITS, "default": "test"}
    most = {"type": int, "default": 500, "help": "0 for no limit"}
    switch = {"action": "store_true"}
    command("candidates", ("--split", split), ("--output", text("output/candidate_pairs.tsv")), ("--max-candidates", most))
    command(
        "features", ("--split", split), ("--candidate-path", text("output/candidate_pairs.tsv")), ("--output", text("output/pair_features.parquet")), ("--idf-path", text("output/idf")), ("--fit-idf-split", split | {"default": "train"})
    )
    command(
        "train", ("--features", text("output/train_features.parquet")), ("--ground-truth", text("data/tsv/train/train_ground_truth.tsv")), ("--model", text("output/model")), ("--max-samples-per-class", {"type": int, "default": 250_000}),
        ("--validation-fraction", {"type": float, "default": 0.2}), ("--max-iter", {"type": int, "default": 160}), ("--seed", {"type": int, "default": 42}),
    )
    command(
        "infer", ("--candidates", text("output/candidate_pairs.tsv")), ("--features", text("output/pair_features.parquet")), ("--model", text("output/model")), ("--idf", text("output/idf")), ("--output", text("output/matching_results.tsv")),
        ("--max-candidates", most), ("--max-matches", {"type": int, "default": 0, "help": "0 for no limit"}), ("--regenerate-candidates", switch), ("--regenerate-features", switch),
    )
    command("validate", ("--matching", {"required": True}), ("--candidate", {"required": True}))
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("concord").getOrCreate()
    config = replace(BlockingConfig(), max_candidates=getattr(args, "max_candidates", 500) or None)
    if args.command == "candidates":
        print(linkage.generate_candidates(spark, args.data_root, args.output, args.split, config))
    elif args.command == "features":
        print(linkage.generate_features(spark, args.data_root, args.candidate_path, args.output, args.idf_path, args.split, args.fit_idf_split, config))
    elif args.command == "train":
        _, summary = linkage.train(tsv.read_features(spark, args.features), tsv.read_truth(spark, args.ground_truth), args.model, args.max_samples_per_class, args.validation_fraction, args.max_iter, args.seed)
        print(summary)
    elif args.command == "infer":
        print(linkage.infer(spark, args.data_root, args.candidates, args.features, args.model, args.idf, args.output, args.max_matches or None, config, args.regenerate_candidates, args.regenerate_features))
    else:
        found = linkage.accept(spark, args.data_root, args.candidate, args.matching).collect()
        for row in found:
            print(f"{row.rule}: {row.key} {row.detail}")
        print("FAILED" if found else "PASS")
        return int(bool(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
