"""Counting from the command line: ``python -m basewise count INPUT... --out FOLDER``, and ``heavy``, ``check``, ``stats`` and ``estimate``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, counting, stats
from .operators.solidity import Solidity
from .plans import run as runs
from .sources import banks, counts, ranges


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("basewise", description="K-mer counting on Spark")
    p.add_argument("task", choices=["count", "heavy", "check", "stats", "estimate"], help="count: k-mers, histogram and properties; heavy: k-mers seen --low times at least, counts stopping at 255; check: the counter behind super-k-mers against the plain one; stats: lengths and k-mers of each bank; estimate: a bank's size from the heads of its files")
    p.add_argument("input", nargs="+", help="FASTA, FASTQ, packed files, Parquet or albums; each is a bank")
    p.add_argument("--out", help="a folder that does not exist yet; without it only numbers are printed")
    p.add_argument("-k", "--kmer-size", type=int, default=31)
    p.add_argument("-m", "--minimizer-size", type=int, default=10)
    p.add_argument("--low", type=int, default=None, help="least count; without it, found from the histogram")
    p.add_argument("--high", type=int, default=None)
    p.add_argument("--solidity", choices=[x.value for x in Solidity if x is not Solidity.CUSTOM], default="sum")
    p.add_argument("--policy", choices=["skip", "replace_a"], default="skip", help="what to do with letters that are no bases")
    p.add_argument("--order", choices=["ACGT", "ACTG"], default="ACGT", help="the order in which the smaller strand is chosen")
    p.add_argument("--pieces", action="store_true", help="read FASTA in pieces, for records of many million bases")
    p.add_argument("--sorted", action="store_true", help="write k-mers in order")
    p.add_argument("--sep", choices=["tab", "space"], default="tab")
    return p


def _bank(spark: SparkSession, uri: str, args: argparse.Namespace) -> DataFrame:
    found = ranges.read_pieces(spark, uri, args.kmer_size - 1) if args.pieces else banks.read_bank(spark, uri)
    return found.select("seq", F.lit(uri).alias("bank"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, object]:
    """Runs a command and returns the numbers that it prints."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("basewise").getOrCreate()
    k, sep = args.kmer_size, "\t" if args.sep == "tab" else " "
    if args.task == "estimate":
        said = banks.estimate_files(spark, ",".join(args.input)).first().asDict()
    else:
        seqs = _bank(spark, args.input[0], args)
        for uri in args.input[1:]:
            seqs = seqs.unionByName(_bank(spark, uri, args))
        said = _run(spark, seqs, args, k, sep)
    print(json.dumps(said, sort_keys=True, default=str))
    return said


def _run(spark: SparkSession, seqs: DataFrame, args: argparse.Namespace, k: int, sep: str) -> dict[str, object]:
    if args.task == "stats":
        return {r["bank"]: {c: r[c] for c in r.asDict() if c != "bank"} for r in stats.bank_stats(seqs, k, ["bank"], args.policy).collect()}
    if args.task == "check":
        wrong = compare.disagreements(counting.count_through_super_kmers(seqs, k, min(args.minimizer_size, k), args.order, args.policy), counting.count_kmers(seqs, k, args.policy, args.order))
        return {"disagreements": wrong.count()}
    if args.task == "heavy":
        found = counting.heavy_hitters(seqs, k, args.low or 4, policy=args.policy)
        if not args.out:
            return {"n_kmers": found.count()}
        counts.write_counts(found, args.out, sep, ordered=args.sorted)
        return {"n_kmers": counts.read_counts(spark, args.out).count()}
    thresholds = "auto" if args.low is None else [(args.low, args.high)]
    many = len(args.input) > 1
    done = runs.run(seqs, k, "bank" if many else None, list(args.input) if many else None, args.solidity, thresholds, policy=args.policy, order=args.order)
    if args.out:
        counts.write_counts(done.solid.select("kmer", F.col("total").alias("n")), f"{args.out}/counts", sep, ordered=args.sorted)
        counts.write_histogram(done.histogram, f"{args.out}/histogram")
        counts.write_properties(spark, done.properties, f"{args.out}/properties")
    return done.properties


if __name__ == "__main__":
    main(sys.argv[1:])
