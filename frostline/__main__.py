"""Commands over Parquet tables and text files, for spark-submit or `python -m frostline`.

Scores are (video_id, frame_num, ts_s, hash_distance, motion, distinct_conf), frames (video_id, frame_num, value),
pictures (video_id, frame_num, width, height, data).
"""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import datasets, faults, logs, matcher, patching, sequences
from .params import REPAIR, VALIDATE, MatcherParams
from .sources import frames as S
from .sources.images import pair_name, write_pictures
from .sources.staging import stage_table


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="frostline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, matching: bool = False) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for path in paths:
            sub.add_argument(path)
        for f in fields(MatcherParams) if matching else ():
            sub.add_argument(f"--{f.name.replace('_', '-')}", type=type(getattr(REPAIR, f.name)))
        return sub

    command("find", "scores", "out", matching=True)
    command("fix", "frames", "scores", "out", matching=True)
    command("validate", "scores", "lags", "out", matching=True)
    insert = command("insert-lags", "frames", "out")
    insert.add_argument("--inserts", type=int, default=3)
    insert.add_argument("--max-length", type=int, default=8)
    insert.add_argument("--seed", type=int, default=1)
    similar = command("extract-similar", "pairs", "out")
    similar.add_argument("--min", type=float, default=0.0001)
    similar.add_argument("--max", type=float, required=True)
    command("view-log", "log", "out")
    motion = command("split-motion", "samples", "out")
    motion.add_argument("--split", type=float, default=0.25)
    motion.add_argument("--seed", type=int, default=42)
    command("boundary-pictures", "chains", "pictures", "out")
    build = command("build-dataset", "images", "out")
    build.add_argument("--split", type=float, default=0.25)
    build.add_argument("--seed", type=int, default=1337)
    return parser


def _params(args: argparse.Namespace, default: MatcherParams) -> MatcherParams:
    return replace(default, **{f.name: v for f in fields(MatcherParams) if (v := getattr(args, f.name)) is not None})


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    read = spark.read.parquet
    if args.command == "find":
        steps = stage_table(matcher.match_steps(read(args.scores), _params(args, REPAIR)))
        _write(matcher.chains(steps), f"{args.out}/chains")
        S.write_log(logs.log_lines(steps), f"{args.out}/log")
    elif args.command == "fix":
        chains = stage_table(matcher.chains(matcher.match_steps(read(args.scores), _params(args, REPAIR))))
        frames = read(args.frames)
        _write(patching.interpolation_jobs(chains), f"{args.out}/jobs")
        _write(patching.patched(frames, patching.interpolated(chains, frames)), f"{args.out}/frames")
    elif args.command == "validate":
        found = matcher.duplicates(matcher.match_steps(read(args.scores), _params(args, VALIDATE)))
        counts = stage_table(faults.confusion(read(args.lags), found))
        _write(faults.scores(counts, "video_id"), f"{args.out}/videos")
        _write(faults.scores(counts), f"{args.out}/all")
    elif args.command == "insert-lags":
        frames = read(args.frames)
        lags = stage_table(faults.inject_lags(frames.groupBy("video_id").agg(F.count("*").alias("n_frames")), args.inserts, args.max_length, args.seed))
        _write(lags, f"{args.out}/lags")
        _write(faults.injected_frames(frames, lags), f"{args.out}/frames")
    elif args.command == "extract-similar":
        _write(sequences.similar_frames(read(args.pairs), args.min, args.max), args.out)
    elif args.command == "split-motion":
        samples = stage_table(S.read_motion_samples(spark, args.samples).withColumn("key", F.monotonically_increasing_id()))
        S.write_motion_parts(datasets.train_validation(samples, "key", args.split, args.seed), args.out)
    elif args.command == "boundary-pictures":
        found = sequences.boundary_frames(read(args.chains), read(args.pictures))
        write_pictures(found.withColumn("name", pair_name(F.col("chain_i"), F.col("name"))), args.out)
    elif args.command == "build-dataset":
        samples = stage_table(datasets.samples(datasets.adjacent_groups(datasets.variation_groups(S.list_images(spark, args.images, augmented=True)))))
        parts = stage_table(datasets.train_validation(samples.withColumn("key", F.monotonically_increasing_id()), "key", args.split, args.seed))
        for name, chosen in (("val", F.col("is_validation")), ("train", ~F.col("is_validation"))):
            S.write_duplicate_samples(parts.where(chosen), f"{args.out}/{name}")
    else:
        lines = S.read_log(spark, args.log).select(F.lit(0).cast("long").alias("video_id"), F.monotonically_increasing_id().alias("step"), F.col("value").alias("line"))
        _write(logs.color_ranges(logs.painted_frames(logs.painted_ranges(logs.parse_log(lines)))), args.out)


if __name__ == "__main__":
    main()
