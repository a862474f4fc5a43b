"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, ctw, fingerprints, langid, packing, quality, sharding, simhash, tokenfiles
from .common import documents


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 6))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = chat.formatted(chat.answered_by_neighbours(turns))
    learned = lambda side: F.aggregate(f"{side}_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    spans = lambda side: F.array_join(F.transform(f"{side}_spans", lambda x: F.concat(x["start"], F.lit("-"), x["end"])), " ")
    sides = [c for side in ("chosen", "rejected") for c in (F.length(f"{side}_completion").cast("bigint").alias(f"{side}_chars"), F.md5(f"{side}_completion").alias(f"{side}_md5"), F.size(f"{side}_spans").cast("bigint").alias(f"{side}_answers"), learned(side).alias(f"{side}_learned"), spans(side).alias(f"{side}_spans"))]
    return out.select("conv_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"), F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"), *sides)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = documents(spark, sf_dir)
    return tokenfiles.read(spark, tokenfiles.write(docs, path("word_bpe_49k.json")), docs.schema["doc_id"].dataType.simpleString())


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN, path

    return bpe.digests(documents(spark, sf_dir), path("byte_bpe_50k.tiktoken"), PATTERN, cut=True)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(documents(spark, sf_dir))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_scoring, op2_quality_rules, op3_chat_formatting, op4_language_id, op5_sharding, op6_token_files, op7_best_fit_packing, op8_byte_bpe, op9_simhash_dedup, op10_document_fingerprints)
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"
_RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}


def _quality_sql() -> str:
    moments = ", ".join(f"sum({r}) / sum(n) AS {r}_m, avg(({r} / n) * ({r} / n)) AS {r}_q, avg({r} / n) AS {r}_a" for r in _RULES)
    between = ", ".join(f"{r}_m, {r}_m * (1 - {r}_m) AS {r}_s, {r}_q - 2 * {r}_m * {r}_a + {r}_m * {r}_m - {r}_m * (1 - {r}_m) * noise AS {r}_b" for r in _RULES)
    strength = ", ".join(f"{r}_m, CASE WHEN {r}_b > 0 THEN least(1e6, greatest(1, {r}_s / {r}_b - 1)) ELSE 1e6 END AS {r}_k" for r in _RULES)
    rates = ", ".join(f"({r} + {r}_m * {r}_k) / (n + {r}_k) AS {r}_rate, {r}_rate + sqrt({r}_rate * (1 - {r}_rate) / (n + {r}_k + 1)) < {r}_m AS {r}_vouched" for r in _RULES)
    alone = " OR ".join(f"({r} AND NOT {r}_vouched)" for r in _RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM p),
v AS (SELECT r, count(DISTINCT i + k) AS n FROM q, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY r),
m AS (
    SELECT r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
    FROM w LEFT JOIN v USING (r)
),
f AS (SELECT *, {", ".join(f"({x}) AS {r}" for r, x in _RULES.items())} FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"sum({r}::INT)::DOUBLE AS {r}" for r in _RULES)} FROM f GROUP BY source),
g AS (SELECT avg(1 / n) AS noise, {moments} FROM h),
b AS (SELECT {between} FROM g),
k AS (SELECT {strength} FROM b),
s AS (SELECT source, {rates} FROM h, k),
j AS (
    SELECT f.*, short OR repeats AS base_failed, {" + ".join(f"{r}::INT" for r in _RULES)} AS n_failed,
        greatest({", ".join(f"CASE WHEN {r} THEN {r}_rate ELSE 0 END" for r in _RULES)}) AS host_rate, ({alone}) AS alone
    FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed::INTEGER AS n_failed, round(host_rate, 6) AS host_rate,
    NOT base_failed AND n_failed < 2 AND NOT alone AS kept, NOT base_failed AND n_failed < 2 AND alone AS host_rejected
FROM j
"""


def _chat_sql() -> str:
    rendered = "string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k)"
    side = lambda x: f"coalesce(length({x}.s), 0)::BIGINT AS {x}_chars, md5(coalesce({x}.s, '')) AS {x}_md5, coalesce({x}.a, 0)::BIGINT AS {x}_answers, coalesce({x}.n, 0)::BIGINT AS {x}_learned, coalesce({x}.spans, '') AS {x}_spans"
    # a turn is '<|' role '|>' newline text '<|end|>' newline: its words begin after 5 characters and the role, and end with it
    upto = "sum(length(role) + length(text) + 13) OVER (PARTITION BY conv_id ORDER BY k)"
    rest = lambda x: f"""SELECT conv_id, {rendered} AS s, count(*) FILTER (role = 'assistant') AS a, sum(length(text) + 8) FILTER (role = 'assistant') AS n,
        string_agg((upto - length(text) - 8)::BIGINT || '-' || upto::BIGINT, ' ' ORDER BY k) FILTER (role = 'assistant') AS spans
    FROM (SELECT conv_id, role, text, k, {upto} AS upto FROM {x} JOIN p USING (conv_id) WHERE k > prompt_turns) GROUP BY conv_id"""  # noqa: E731
    return f"""
WITH c AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
),
l AS (SELECT conv_id, max(k) AS k FROM c WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT xor(conv_id, 1) AS conv_id, text FROM c JOIN l USING (conv_id, k)),
x AS (
    SELECT c.conv_id, c.role, c.text, c.k FROM c LEFT JOIN l USING (conv_id) WHERE l.k IS NULL OR c.k < l.k
    UNION ALL
    SELECT l.conv_id, 'assistant', a.text, l.k FROM l JOIN a USING (conv_id)
),
p AS (
    SELECT conv_id, coalesce(min(k) FILTER (c.role IS DISTINCT FROM x.role OR c.text IS DISTINCT FROM x.text) - 1, max(k)) AS prompt_turns
    FROM c FULL JOIN x USING (conv_id, k) GROUP BY conv_id
),
prompt AS (SELECT conv_id, {rendered} AS s FROM c JOIN p USING (conv_id) WHERE k <= prompt_turns GROUP BY conv_id),
chosen AS ({rest("c")}),
rejected AS ({rest("x")})
SELECT p.conv_id, prompt_turns::BIGINT AS prompt_turns, coalesce(length(prompt.s), 0)::BIGINT AS prompt_chars, md5(coalesce(prompt.s, '')) AS prompt_md5, {side("chosen")}, {side("rejected")}
FROM p LEFT JOIN prompt USING (conv_id) LEFT JOIN chosen USING (conv_id) LEFT JOIN rejected USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    """For the two operators that SQL can express; the others are tested against brute force."""
    return {"op2_quality_rules": _quality_sql(), "op3_chat_formatting": _chat_sql()}
