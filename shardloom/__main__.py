"""Command line: the reference's programs as Spark jobs.

  python -m shardloom prepare  --dataset PATH --keys text [--order doc_id] ... --out DIR
  python -m shardloom train    --shards DIR --model DIR [--B 8 --T 256 --N 1]
  python -m shardloom test     --shards DIR --model DIR
  python -m shardloom generate --shards DIR --model DIR --prompts PATH [--max-length 2048] --out DIR
  python -m shardloom resplit  --shards DIR --split 7,2,1
  python -m shardloom curves   --logs PATH --out DIR

A session comes from ``SparkSession.builder.getOrCreate()`` (spark-submit
settings apply); results go to the given folders.
"""

from __future__ import annotations

import argparse
import sys
from typing import Optional, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DatasetSpec, PackSpec, SplitRatio, WindowSpec
from .operators.telemetry import loss_curve
from .plans import corpus as J
from .session import ensure_checkpoint_dir
from .sources.telemetry import read_training_logs


def _ratio(text: str) -> SplitRatio:
    parts = [int(p) for p in text.split(",")]
    if len(parts) != 3:
        raise argparse.ArgumentTypeError("split must be three integers, e.g. 8,1,1")
    return SplitRatio(*parts)


def _bool(text: str) -> bool:
    """Typed flag (the reference accepted any string as true, quirk Q13)."""
    low = text.strip().lower()
    if low in ("1", "true", "yes", "y"):
        return True
    if low in ("0", "false", "no", "n"):
        return False
    raise argparse.ArgumentTypeError(f"not a boolean: {text!r}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shardloom")
    sub = p.add_subparsers(dest="cmd", required=True)

    pr = sub.add_parser("prepare", help="datasets -> packed, split-labelled shards")
    pr.add_argument("--dataset", action="append", required=True, help="table path (repeat, in order)")
    pr.add_argument("--keys", action="append", required=True, help="comma-separated text columns per dataset")
    pr.add_argument("--order", action="append", help="order column per dataset (default doc_ord)")
    pr.add_argument("--where", action="append", help="row filter per dataset")
    pr.add_argument("--out", required=True)
    pr.add_argument("--data-name", default="corpus")
    pr.add_argument("--tokenizer", default="word", choices=["word", "bytes", "bpe"])
    pr.add_argument("--ranks-file")
    pr.add_argument("--shard-tokens", type=int, default=PackSpec().shard_tokens)
    pr.add_argument("--split", type=_ratio, default=SplitRatio())
    pr.add_argument("--allow-empty-split", type=_bool, default=False)

    helps = {"train": "count model on the training split",
             "test": "cross-entropy of a count model on the testing split",
             "generate": "seeded top-k text for a prompts table"}
    for name in ("train", "test", "generate"):
        sp = sub.add_parser(name, help=helps[name])
        sp.add_argument("--shards", required=True)
        sp.add_argument("--model", required=True)
        sp.add_argument("--B", type=int, default=8)
        sp.add_argument("--T", type=int, default=256)
        sp.add_argument("--N", type=int, default=1)
        sp.add_argument("--data-name", help="needed when the store holds several")
        sp.add_argument("--ranks-file", help="ranks of a bpe corpus")
        if name == "generate":
            sp.add_argument("--prompts", required=True, help="table with item_id, text")
            sp.add_argument("--run", default="count-model")
            sp.add_argument("--max-length", type=int, default=2048)
            sp.add_argument("--out", required=True)

    rs = sub.add_parser("resplit", help="label a corpus's shards again with another ratio")
    rs.add_argument("--shards", required=True)
    rs.add_argument("--split", type=_ratio, required=True)
    rs.add_argument("--data-name")
    rs.add_argument("--allow-empty-split", type=_bool, default=False)

    cu = sub.add_parser("curves", help="loss curves from training logs")
    cu.add_argument("--logs", required=True)
    cu.add_argument("--out", required=True)
    return p


def main(argv: Optional[Sequence[str]] = None, spark: Optional[SparkSession] = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"shardloom-{args.cmd}").getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.cmd == "prepare":
        n = len(args.dataset)
        if len(args.keys) != n:
            raise SystemExit("give --keys once per --dataset")
        orders = args.order or [None] * n          # numbered in file and row order
        wheres = args.where or [None] * n
        specs = [DatasetSpec(path=d, data_keys=k.split(","), order_col=o, where=w)
                 for d, k, o, w in zip(args.dataset, args.keys, orders, wheres)]
        extra = {"ranks_path": args.ranks_file} if args.ranks_file else {}
        man = J.prepare_corpus(spark, specs, args.out, args.tokenizer,
                               PackSpec(args.data_name, args.shard_tokens), args.split,
                               args.allow_empty_split, **extra)
        man.groupBy("split").agg(F.count(F.lit(1)).alias("shards"), F.sum("n_tokens").alias("tokens")).show()
        return 0
    if args.cmd == "resplit":
        man = J.resplit(spark, args.shards, args.split, args.data_name, args.allow_empty_split)
        man.groupBy("split").agg(F.count(F.lit(1)).alias("shards"), F.sum("n_tokens").alias("tokens")).show()
        return 0
    if args.cmd == "curves":
        curve = loss_curve(read_training_logs(spark, args.logs))
        curve.write.mode("overwrite").parquet(args.out)
        return 0
    spec = WindowSpec(B=args.B, T=args.T, N=args.N)
    if args.cmd == "train":
        J.train_count_model(spark, args.shards, spec, args.model, args.data_name)
        return 0
    extra = {"ranks_path": args.ranks_file} if args.ranks_file else {}
    tok = J.load_tokenizer(spark, args.shards, **extra)
    counts = spark.read.parquet(args.model)
    if args.cmd == "test":
        J.evaluate(spark, args.shards, counts, spec, tok.vocab_size, args.data_name).show()
        return 0
    prompts = spark.read.parquet(args.prompts).select("item_id", "text")
    resp = J.generate_responses(prompts, tok, counts, [args.run], args.max_length)
    resp.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
