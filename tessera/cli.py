"""Batch verbs: python -m tessera.cli VERB ...

apply, create, reverse and info read a Parquet table of jobs and write one; signature and decompress read a folder of files.
gen writes a suite of cases; report reads result documents and the cases, and writes scores or buckets of failures.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tessera.functions.kernels import functions
from tessera.kernels import hashes, manifests
from tessera.operators import bytes_ops, cases, jobs, report
from tessera.session import bounded_batches, get_spark
from tessera.sources.files import binary_files, cached_base, read_jobs, read_results, write_cases, write_files

ALGORITHMS = {"md5": hashes.MD5, "sha1": hashes.SHA1, "sha256": hashes.SHA256}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, what in (
        ("apply", "targets of jobs with reference and delta"),
        ("create", "deltas of jobs with reference and target"),
        ("reverse", "targets, and deltas back, of jobs with reference and delta"),
        ("info", "header fields of jobs with delta"),
        ("signature", "digests of files"),
        ("decompress", "compressed manifests of a folder, given their base"),
        ("gen", "a suite of cases, SOURCE being its seed"),
        ("report", "scores of the result documents in a folder"),
    ):
        p = verbs.add_parser(verb, help=what)
        p.add_argument("source")
        p.add_argument("output")
        if verb == "create":
            p.add_argument("--version", choices=("PA30", "PA31"), default="PA30")
            p.add_argument("--hash", choices=sorted(ALGORITHMS))
            p.add_argument("--codec", choices=("lzx", "bsdiff"), default="lzx")
            p.add_argument("--auto", action="store_true", help="treat pairs of executables as such")
        if verb == "signature":
            p.add_argument("--hash", choices=sorted(ALGORITHMS), default="sha256")
            p.add_argument("--normalise", action="store_true", help="without timestamps and checksums of executables")
        if verb == "decompress":
            p.add_argument("--base", help="a base manifest, or the library that holds it; without one, that of the cache")
            p.add_argument("--cache", help="a folder that keeps the base")
        if verb in ("apply", "decompress"):
            p.add_argument("--files", action="store_true", help="write one file a row")
        if verb == "gen":
            p.add_argument("--count", type=int, default=8, help="cases of each category")
            p.add_argument("--domain", default="tessera")
        if verb == "report":
            p.add_argument("--cases", help="job documents; results of no known case are dropped")
            p.add_argument("--by", choices=("score", "buckets", "pivot"), default="score")
    return top


def _base(arguments: argparse.Namespace, spark) -> bytes:
    given = None
    if arguments.base:
        content = bytes(binary_files(spark, arguments.base).first().content)
        given = manifests.extract_base(content) if content[:2] == b"MZ" else content
    if arguments.cache:
        return cached_base(spark, arguments.cache, given)
    if given is None:
        raise SystemExit("decompress: --base or --cache is needed")
    return given


def _report(arguments: argparse.Namespace, spark):
    results = read_results(spark, arguments.source).withColumn("category", F.lit(""))
    if arguments.cases:
        results = report.with_cases(results, read_jobs(spark, arguments.cases))
    found = report.classified(results)
    if arguments.by == "score":
        return report.scores(found, ["dll", "direction", "category"])
    return report.buckets(found, "id", "id") if arguments.by == "buckets" else report.pivoted(found, "id")


def run(arguments: argparse.Namespace, spark) -> None:
    bounded_batches(spark)
    f = functions()
    if arguments.verb == "gen":
        write_cases(cases.suite(spark, int(arguments.source), arguments.count), arguments.output, arguments.domain, int(arguments.source))
        return
    if arguments.verb == "report":
        out = _report(arguments, spark)
    elif arguments.verb == "signature":
        files = binary_files(spark, arguments.source)
        data = f["delta_normalise"]("content") if arguments.normalise else F.col("content")
        out = files.select("path", bytes_ops.signature(data, ALGORITHMS[arguments.hash]).alias("signature"))
    elif arguments.verb == "decompress":
        base = F.lit(_base(arguments, spark))  # at most a megabyte
        decoded = binary_files(spark, arguments.source).select("path", f["manifest_decompress"](base, "content").alias("content"))
        out = decoded.withColumn("looks_like_manifest", bytes_ops.looks_like_manifest(F.col("content")))
    else:
        rows = spark.read.parquet(arguments.source)
        if arguments.verb == "create":
            words = [w for w in (arguments.hash, "bsdiff" if arguments.codec == "bsdiff" else "", "auto" if arguments.auto else "") if w]
            out = jobs.create(rows, arguments.version, " ".join(words))
        else:
            out = {"apply": jobs.try_apply, "reverse": jobs.apply_reverse, "info": jobs.info}[arguments.verb](rows)
    if getattr(arguments, "files", False):
        data = out.select(F.col("id").cast("string").alias("path"), F.col("result").alias("content")) if arguments.verb == "apply" else out
        write_files(data, arguments.output).count()
    else:
        out.write.parquet(arguments.output)


def main(argv: list[str] | None = None) -> int:
    run(parser().parse_args(argv), get_spark("tessera-cli"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
