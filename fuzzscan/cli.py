"""spark-submit fuzzscan/cli.py search|guides|selftest"""

from __future__ import annotations

import argparse
import random
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from fuzzscan.operators.guides import search_guides
from fuzzscan.operators.kernel import all_ends
from fuzzscan.operators.search import search
from fuzzscan.sources.readers import inline_pattern, read_fasta, read_fastx, read_guides, read_patterns
from fuzzscan.sources.writers import search_table, write_tsv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fuzzscan", description=__doc__)
    kinds = top.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("search", help="patterns in the records of FASTA or FASTQ files")
    what = one.add_mutually_exclusive_group(required=True)
    what.add_argument("-p", "--pattern")
    what.add_argument("-f", "--pattern-fasta")
    one.add_argument("-k", type=int, required=True)
    one.add_argument("-a", "--alphabet", default="ascii", choices=["ascii", "ascii_ci", "dna", "iupac"])
    one.add_argument("--mode", default="local", choices=["local", "all"])
    one.add_argument("--alpha", type=float)
    two = kinds.add_parser("guides", help="guides with a common PAM, one a line, all matches")
    two.add_argument("-g", "--guide", required=True)
    two.add_argument("-k", "--k", type=int, required=True)
    two.add_argument("--max-n-frac", type=float, default=1.0)
    two.add_argument("--allow-pam-edits", action="store_true")
    for x in (one, two):
        x.add_argument("--no-rc", action="store_true")
        x.add_argument("-o", "--output")
        x.add_argument("-j", "--threads", type=int, help="local threads, where no master is set")
        x.add_argument("path")
    kinds.add_parser("selftest", help="throughput of the kernel on this machine")
    return top


def selftest(n: int = 100_000, m: int = 23, k: int = 1) -> float:
    """Searches a random pattern in a random DNA text; MB of text a second, one core."""
    rng = random.Random(1)
    text, pattern = (bytes(rng.choice(b"ACGT") for _ in range(size)) for size in (n, m))
    all_ends([text], [pattern], k, "dna")
    began, rounds = time.perf_counter(), 20
    for _ in range(rounds):
        all_ends([text], [pattern], k, "dna")
    return rounds * n / (time.perf_counter() - began) / 1e6


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "selftest":
        print(f"{selftest():.0f} MB/s", file=sys.stderr)
        return 0
    if spark is None:
        build = SparkSession.builder.appName("fuzzscan")
        spark = (build.master(f"local[{args.threads}]") if args.threads else build).getOrCreate()
    fastq = any(x in args.path.lower() for x in (".fq", ".fastq"))
    texts = (read_fastx if fastq else read_fasta)(spark, args.path)
    if args.command == "search":
        patterns = inline_pattern(args.pattern) if args.pattern is not None else read_patterns(spark, args.pattern_fasta)
        rc = args.alphabet in ("dna", "iupac") and not args.no_rc
        made = search_table(search(texts, patterns, args.k, alphabet=args.alphabet, rc=rc, alpha=args.alpha, mode=args.mode))
    else:
        made = search_guides(texts, read_guides(spark, args.guide), args.k, max_n_frac=args.max_n_frac, allow_pam_edits=args.allow_pam_edits, rc=not args.no_rc)
    _put(made, args.output)
    return 0


def _put(made: DataFrame, output: str | None) -> None:
    if output:
        write_tsv(made, output)
        return
    print("\t".join(made.columns))
    for row in made.toLocalIterator():
        print("\t".join(map(str, row)))


if __name__ == "__main__":
    sys.exit(main())
