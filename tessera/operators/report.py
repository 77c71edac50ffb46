"""Scoring of test runs: verdicts, totals, buckets of failures, and smaller inputs that still fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES, LEAST_LENGTH, MESSAGE = 5, 8, 60
# Smaller inputs by label: kind, and the share that is kept (or cut out) as a fraction.
SHRINKS = (
    ("prefix", 7, 8), ("prefix", 3, 4), ("prefix", 1, 2), ("prefix", 1, 4), ("prefix", 1, 8),
    ("suffix", 3, 4), ("suffix", 1, 2), ("excise_mid", 1, 2), ("excise_mid", 1, 4),
)


def normalised_error(message: Column) -> Column:
    """The error code if there is one, a name for a null output, or the message's first characters."""
    code = F.regexp_extract(message, r'(GetLastError=[^"\\]*)', 1)
    return F.when(code != "", code).when(F.contains(message, F.lit("Object reference not set")), "null-output (empty target)").otherwise(F.left(message, F.lit(MESSAGE)))


def verdict(status: Column) -> Column:
    return F.when(status.isNull(), "skipped").when(status.isin("PASS", "OK"), "pass").when(status == "FAIL", "fail").otherwise("error")


def classified(results: DataFrame) -> DataFrame:
    """results(status, got_sha, got_len, message, ...) with `verdict` and `detail`."""
    v = verdict(F.col("status"))
    got = F.concat(F.lit("got "), F.left("got_sha", F.lit(12)), F.lit(" ("), F.col("got_len").cast("string"), F.lit("B)"))
    return results.withColumn("verdict", v).withColumn("detail", F.when(v == "fail", got).when(v == "error", normalised_error(F.col("message"))))


def with_cases(results: DataFrame, cases: DataFrame, columns: tuple[str, ...] = ("category",)) -> DataFrame:
    """Results with columns of their case, by `id`; results of no known case are dropped."""
    return results.drop(*columns).join(cases.select("id", *columns), "id")


def scores(results: DataFrame, by: list[str]) -> DataFrame:
    """passed and total by group, without what was skipped."""
    run = results.filter("verdict <> 'skipped'")
    return run.groupBy(*by).agg(F.count_if(F.col("verdict") == "pass").alias("passed"), F.count("*").alias("total"))


def buckets(results: DataFrame, order: str, example: str) -> DataFrame:
    """signature, failures, and the first examples in order. Examples are cut before rows meet, so no group is gathered."""
    failed = results.filter("verdict in ('fail', 'error')")
    signature = F.concat_ws("|", "direction", "dll", "category", F.concat_ws(" ", F.upper("verdict"), "detail"))
    rows = failed.select(signature.alias("signature"), F.col(order).alias("o"), F.col(example).cast("string").alias("e"))
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("o"), F.lit(64)))
    some = parts.groupBy("signature", "_part").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("o", "e"))), 1, EXAMPLES).alias("some"))
    all_ = F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, EXAMPLES), lambda s: s["e"])
    return some.groupBy("signature").agg(F.sum("n").alias("failures"), all_.alias("examples"))


def pivoted(results: DataFrame, case: str) -> DataFrame:
    """One row a case: its verdicts by dll and direction, as a map. Of several of one key the worst counts: error, fail, pass, skipped."""
    each = results.groupBy(case, F.concat_ws("/", "dll", "direction").alias("key")).agg(F.min("verdict").alias("value"))
    return each.groupBy(case).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("verdicts"))


def shrink_candidates(inputs: DataFrame, key: str, data: str) -> DataFrame:
    """(key, label, length, candidate): smaller inputs, one of each length, from the shortest."""
    n = F.octet_length(data)
    made = []
    for k, (kind, a, b) in enumerate(SHRINKS):
        size = F.floor(n * a / b).cast("int")
        if kind == "prefix":
            candidate = F.substring(data, F.lit(1), size)
        elif kind == "suffix":
            candidate = F.substring(data, n - size + 1, size)
        else:
            low = F.floor((n - size) / 2).cast("int")
            candidate = F.concat(F.substring(data, F.lit(1), low), F.substring(data, low + size + 1, n))
        made.append(F.struct(F.lit(k).alias("_rank"), F.lit(f"{kind}_{a}_{b}").alias("label"), candidate.alias("candidate")))
    rows = inputs.filter(n > LEAST_LENGTH).select(key, n.alias("_n"), F.explode(F.array(*made)).alias("c"))
    rows = rows.select(key, "_n", "c.*").withColumn("length", F.octet_length("candidate"))
    rows = rows.filter((F.col("length") >= LEAST_LENGTH) & (F.col("length") < F.col("_n")))
    best = rows.groupBy(key, "length").agg(F.min_by(F.struct("label", "candidate"), "_rank").alias("c"))
    return best.select(key, "c.label", "length", "c.candidate")


def minimised(inputs: DataFrame, key: str, data: str, fails, rounds: int = 16) -> DataFrame:
    """(key, data): for each failing input the smallest found by taking the shortest failing candidate, round by round.

    fails(DataFrame with key and `candidate`) returns the rows that fail. Stops when no input got smaller.
    """
    current, held = inputs.select(key, F.col(data)), []
    for _ in range(rounds):
        failing = fails(shrink_candidates(current, key, data)).groupBy(key).agg(F.min_by("candidate", F.octet_length("candidate")).alias("_smaller"))
        following = current.join(failing, key, "left").withColumn("_less", F.col("_smaller").isNotNull())
        following = following.select(key, F.coalesce("_smaller", data).alias(data), "_less").cache()
        changed = not following.filter("_less").isEmpty()
        current = following.drop("_less")
        held.append(following)
        if len(held) > 2:
            held.pop(0).unpersist()  # the last two are what the next round reads
        if not changed:
            break
    return current
