"""Quality rules of documents and of the hosts (``source``) they come from, in DataFrame functions alone.

A document is measured within its own row. Failures of each rule are counted by host (partial counts meet, so a host
with a third of all rows costs no more than others), a beta prior is fitted to the hosts' failure rates by moments, and
each host's rates are shrunk towards it: a host with few documents is judged mostly by the prior. A host vouches for its
documents in a rule if it fails that rule credibly less often than the corpus does, by one posterior standard deviation.
The hosts' verdicts are joined back to the documents by host and salt, so that a hot host is spread over tasks; Spark
broadcasts the hosts only where it has measured them to be small.

A document goes if it fails the base rules, if it fails two or more rules, or if it fails one rule in which its host does
not vouch for it. One that fails no rule stays, whatever its host.

Null text counts as empty and so fails; a null source is a host of its own; repeated rows are each judged, and each
counts for the host; an empty table gives no rows; all columns pass through ``keep`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
RULES = ("short", "repeats", "symbols", "lines", "word_length")
#: A host vouches where its shrunk failure rate is so many posterior standard deviations below the mean.
VOUCH = 1.0
#: How many tasks share the documents of a host in the join, at least.
SALT = 16
#: A document that fails so many rules goes, whatever its host.
OWN_FAILURES = 2


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct __quality of counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__quality_words", common.words(F.col("text").cast("string")))
    w, n = F.col("__quality_words"), F.size("__quality_words")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    out = out.withColumn("__quality_windows", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(window))
    h = F.col("__quality_windows")
    pairs = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("__quality_pairs", F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(pairs))
    p = F.col("__quality_pairs")
    # equal windows are neighbours once sorted; get() gives null outside the array
    twice = F.filter(p, lambda x, k: (x["h"] == F.coalesce(F.get(p, k - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get(p, k + 1)["h"], F.bitwise_not(x["h"]))))
    out = out.withColumn("__quality_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at, m = F.col("__quality_at"), F.size("__quality_at")
    steps = F.zip_with(F.slice(at, F.lit(2), m - 1), F.slice(at, F.lit(1), m - 1), lambda b, a: F.least(F.lit(3), b - a))
    covered = F.when(m == 0, 0).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x))
    out = out.withColumn("__quality_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, common.SPACE + "+", "")) > 0))
    lines = F.col("__quality_lines")
    counts = {"n_words": n, "word_chars": F.length(F.regexp_replace(text, common.SPACE + "+", "")), "n_symbols": F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": covered, "n_lines": F.size(lines)}
    temporary = ("words", "windows", "pairs", "at", "lines")
    return out.withColumn("__quality", F.struct(*(c.cast("bigint").alias(k) for k, c in counts.items()))).drop(*(f"__quality_{x}" for x in temporary))


def failures(q: Column) -> dict[str, Column]:
    """What a document fails; the first two are the base rules."""
    return {
        "short": q["n_words"] < 50,
        "repeats": 100 * q["n_repeat_words"] > 50 * q["n_words"],
        "symbols": 10 * q["n_symbols"] > q["n_words"],
        "lines": 10 * q["n_dup_lines"] > 3 * q["n_lines"],
        "word_length": (q["word_chars"] < 2 * q["n_words"]) | (q["word_chars"] > 12 * q["n_words"]),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """One row per host: how many documents, for each rule the shrunk failure rate, and whether the host vouches."""
    fails = failures(F.col("__quality"))
    hosts = measured.groupBy(F.col("source").alias("__quality_host")).agg(F.count("*").alias("host_docs"), *(F.sum(fails[r].cast("bigint")).alias(r) for r in RULES))
    hosts = common.written(hosts, "hosts")
    rate = {r: F.col(r) / F.col("host_docs") for r in RULES}
    mean = {r: F.sum(r) / F.sum("host_docs") for r in RULES}
    # one row: the moments of each rule's rates over the hosts
    row = hosts.agg(F.avg(1 / F.col("host_docs")).alias("noise"), *(m.alias(f"{r}_mean") for r, m in mean.items()), *(F.avg(x * x).alias(f"{r}_square") for r, x in rate.items()), *(F.avg(x).alias(f"{r}_rate") for r, x in rate.items())).first()
    shrunk, vouches = [], []
    for r in RULES:
        mean_r = row[f"{r}_mean"] or 0.0
        spread = mean_r * (1 - mean_r)
        between = (row[f"{r}_square"] or 0.0) - 2 * mean_r * (row[f"{r}_rate"] or 0.0) + mean_r * mean_r - spread * (row["noise"] or 0.0)
        strength = min(1e6, max(1.0, spread / between - 1)) if between > 0 else 1e6
        posterior = (F.col(r) + mean_r * strength) / (F.col("host_docs") + strength)
        deviation = F.sqrt(posterior * (1 - posterior) / (F.col("host_docs") + strength + 1))
        shrunk.append(posterior.alias(r))
        vouches.append((posterior + VOUCH * deviation < mean_r).alias(f"{r}_vouched"))
    return hosts.select("__quality_host", "host_docs", *shrunk, *vouches)


def judged(measured: DataFrame) -> DataFrame:
    """measured with the struct __quality_verdict: base_failed, n_failed, host_rate (the highest rate of a failed rule),
    kept, and host_rejected (whether it goes for nothing but that its host does not vouch for it)."""
    fails = failures(F.col("__quality"))
    hosts = host_verdicts(measured).select("__quality_host", F.struct(*RULES, *(f"{r}_vouched" for r in RULES)).alias("__quality_rates"))
    hosts = hosts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__quality_side"))
    out = measured.withColumn("__quality_salt", F.pmod(F.xxhash64("doc_id", "__quality"), F.lit(SALT)).cast("int"))
    out = out.join(hosts, out["source"].eqNullSafe(hosts["__quality_host"]) & (out["__quality_salt"] == hosts["__quality_side"]), "left")
    rates = F.col("__quality_rates")
    base = fails["short"] | fails["repeats"]
    failed = sum((fails[r].cast("int") for r in RULES), F.lit(0))
    worst = F.greatest(*(F.when(fails[r], rates[r]).otherwise(0.0) for r in RULES))
    alone = F.lit(False)
    for r in RULES:
        alone = alone | (fails[r] & ~rates[f"{r}_vouched"])
    rejected = ~base & (failed < OWN_FAILURES) & alone
    kept = ~base & (failed < OWN_FAILURES) & ~alone
    verdict = F.struct(base.alias("base_failed"), failed.alias("n_failed"), worst.alias("host_rate"), kept.alias("kept"), rejected.alias("host_rejected"))
    return out.withColumn("__quality_verdict", verdict).drop("__quality_host", "__quality_rates", "__quality_salt", "__quality_side")


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed, n_failed, host_rate, kept and host_rejected."""
    rows = common.written(measured(docs.select("doc_id", "source", "text")).select("doc_id", "source", "__quality"), "quality")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(rows).select("doc_id", *(F.col("__quality")[c].alias(c) for c in counts), "__quality_verdict.*")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, all their columns unchanged, whatever their names."""
    row = docs.select("doc_id", "source", "text", F.struct("*").alias("__quality_row"))
    rows = common.written(measured(row).drop("text"), "quality")
    return judged(rows).filter("__quality_verdict.kept").select("__quality_row.*")
