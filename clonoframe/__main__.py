"""``python -m clonoframe FLOW ...``: the flows from files to tables. A cluster's session is used where there is one; else a local one is started."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import workflows
from .session import local_session
from .sources import repertoire


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clonoframe", description="Immune-repertoire tables as Spark jobs.")
    flows = p.add_subparsers(dest="flow", required=True)

    def flow(name: str, text: str) -> argparse.ArgumentParser:
        f = flows.add_parser(name, help=text, description=text)
        f.add_argument("--out", required=True, help="folder to write; an existing one is an error without --overwrite")
        f.add_argument("--overwrite", action="store_true")
        return f

    f = flow("reconstruct", "Full sequences from V, J and CDR3 columns.")
    f.add_argument("tables", nargs="+")
    f.add_argument("--v-fasta", required=True)
    f.add_argument("--j-fasta", required=True)
    for c in ("v", "j", "cdr3"):
        f.add_argument(f"--{c}", default=c, help="name of the column")
    f.add_argument("--compat", action="store_true", help="the last record that contains a gene's name")
    f = flow("space", "Reference clusters from a file with one sequence a line.")
    f.add_argument("sequences")
    f.add_argument("--clusters", type=int, default=1024)
    f.add_argument("--functional", type=int, default=96)
    f.add_argument("--gamma", type=float, default=0.1)
    f.add_argument("--seed", type=int, default=0)
    f.add_argument("--column", choices=("full_seq", "cdr3"), default="full_seq")
    f = flow("encode", "Samples of repertoire files as counts and sums in the clusters of a space.")
    f.add_argument("dataset")
    f.add_argument("--space", required=True, help="what the flow space wrote")
    for c in ("neg-dir", "pos-dir", "unlabeled-dir"):
        f.add_argument(f"--{c}")
    f.add_argument("--top", type=int, help="most abundant rows of each sample")
    f.add_argument("--keep-failures", action="store_true")
    f.add_argument("--column", choices=("full_seq", "cdr3"), default="full_seq")
    for name, text in (("compare", "Metrics of every two encoded datasets."), ("correct", "All correction methods on two encoded datasets.")):
        f = flow(name, text)
        f.add_argument("encoded", nargs="+", help="what the flow encode wrote, two or more")
        f.add_argument("--space", required=True)
        f.add_argument("--mode", choices=("concatenate", "abundance", "diversity"), default="concatenate")
    return p


def _features(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    mapping = spark.read.parquet(f"{args.space}/mapping")
    width, k = mapping.count(), mapping.select("func").distinct().count()
    out = {}
    for path in args.encoded:
        encoded, samples = repertoire.read_encoded(spark, f"{path}/encoded"), spark.read.parquet(f"{path}/samples")
        name = samples.agg(F.first("dataset")).first()[0]
        out[name] = workflows.dataset_features(encoded, samples, mapping, width, k, args.mode)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    mode = "overwrite" if args.overwrite else "errorifexists"
    if args.flow == "reconstruct":
        names = {c: getattr(args, c) for c in ("v", "j", "cdr3")}
        workflows.reconstruct_files(spark, args.tables, args.v_fasta, args.j_fasta, args.out, names, args.compat, args.overwrite)
    elif args.flow == "space":
        sequences = repertoire.read_sequences(spark, args.sequences)
        built = workflows.build_space(sequences, args.clusters, args.functional, gamma=args.gamma, seed=args.seed, column=args.column)
        for name, table in built.items():
            table.write.mode(mode).parquet(f"{args.out}/{name}")
    elif args.flow == "encode":
        config = workflows.EncodeConfig(args.dataset, args.neg_dir, args.pos_dir, args.unlabeled_dir, not args.keep_failures, args.top, args.column)
        encoded, samples = workflows.encode_dataset(spark, config, spark.read.parquet(f"{args.space}/centroids"))
        repertoire.write_encoded(encoded, f"{args.out}/encoded", args.overwrite)
        samples.write.mode(mode).parquet(f"{args.out}/samples")
    else:
        features = _features(spark, args)
        if args.flow == "compare":
            table = workflows.compare(features)
        elif len(features) == 2:
            table = workflows.correct_and_compare(*(features[n] for n in sorted(features)))
        else:
            raise SystemExit("correct takes two datasets")
        table.coalesce(1).write.mode(mode).csv(args.out, sep="\t", header=True)


if __name__ == "__main__":
    main()
