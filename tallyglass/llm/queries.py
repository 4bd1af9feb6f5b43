"""Registered queries of the operators, and SQL that gives the same rows where it can."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    best_fit,
    bpe,
    exact_dedup,
    license_scan,
    near_dups,
    packing,
    periodic_runs,
    quality_model,
    quality_rules,
    spelling,
    token_counts,
    toxicity,
    url_filter,
)
from .labelled import held_out

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"
# Smallest score of a document of good quality.
LEAST_QUALITY = 0.3
LEAST_TOXICITY = 0.5

# The rules every URL is judged by.
URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)
# What the rules leave open: hosts that sell, track or farm links.
URL_GLOBS = (
    url_filter.Glob("block", "*.cheap-*"),
    url_filter.Glob("block", "*.free-*"),
    url_filter.Glob("block", "*.ads-*"),
    url_filter.Glob("block", "*spam*"),
    url_filter.Glob("block", "*casino*"),
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@functools.cache
def vocabulary(file: str) -> str:
    return public_tokenizers.path(file)


@query("op1_bpe_codec")
def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(WORD_FILE)
    coded = bpe.encode(texts(spark, sf_dir), path, keep=["doc_id"])
    decoded = bpe.decode(coded, path, keep=["doc_id", "ids"])
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_LIKE = " OR ".join(f"'.' || host || path LIKE '{g.pattern.replace('*', '%')}'" for g in URL_GLOBS)


@query(
    "op2_url_filter",
    f"""
    WITH parts AS (
        SELECT page_id,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    judged AS (
        SELECT *, CASE
            WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
        FROM parts)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
        WHEN rule IS NOT NULL THEN 'allow'
        WHEN {_LIKE} THEN 'block' ELSE 'allow' END AS verdict
    FROM judged
    """,
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, URL_RULES, URL_GLOBS, keep=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


_FAILED = " + ".join(
    f"CASE WHEN {sql} THEN {quality_rules.bit(name)} ELSE 0 END"
    for name, sql in quality_rules.RULES.items()
)


_LEDGER = rf"""
    WITH words AS (
        SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    windows AS (
        SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
    again AS (
        SELECT doc_id, i FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows)
        WHERE n >= 2),
    covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n
        FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
    lines AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    measured AS (
        SELECT doc_id, len(w)::BIGINT AS n_words,
            length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT
                AS word_chars,
            length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT
                AS n_symbols,
            coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
            coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
            coalesce(lines.n_lines, 0)::BIGINT AS n_lines
        FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    ledger AS (SELECT *, ({_FAILED})::BIGINT AS failed_bits FROM measured)
"""


@query(
    "op3_quality_rules",
    _LEDGER
    + f"""
    SELECT *, failed_bits & {quality_rules.mask_of("base")} != 0 AS base_failed,
        failed_bits & {quality_rules.mask_of("2")} = 0 AS kept
    FROM ledger
    """,
)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(texts(spark, sf_dir), keep=["doc_id"])
    return rows.withColumns(
        {"base_failed": quality_rules.fails("base"), "kept": ~quality_rules.fails("2")}
    )


_POLICY_RULES = ", ".join(
    f"('{policy}', '{rule}', {quality_rules.bit(rule)}, {quality_rules.mask_of(names)})"
    for policy, names in quality_rules.POLICIES.items()
    for rule in names
)


@query(
    "quality_ablations",
    _LEDGER
    + f"""
    SELECT policy, rule, sum((failed_bits & own != 0)::INT)::BIGINT AS failed,
        sum((failed_bits & whole = own)::INT)::BIGINT AS only,
        sum((failed_bits & whole != 0)::INT)::BIGINT AS rejected
    FROM ledger, (VALUES {_POLICY_RULES}) AS p(policy, rule, own, whole) GROUP BY policy, rule
    """,
)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(texts(spark, sf_dir), keep=[]))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(texts(spark, sf_dir), vocabulary(WORD_FILE), keep=["doc_id"])
    packed = packing.pack(coded, keep=["doc_id"])
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(texts(spark, sf_dir)).drop("spans")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        texts(spark, sf_dir), vocabulary(BYTE_FILE), limit=512, keep=["doc_id"]
    )


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the training folds: nothing is learned from a held-out row."""
    return table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = toxicity.fit(docs, train_labels(spark, sf_dir), "toxic")
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_TOXICITY).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query(
    "op8_exact_dedup",
    r"""
    WITH bodies AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
            regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
        FROM documents),
    ranked AS (
        SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
            count(*) OVER (PARTITION BY body) AS group_size
        FROM bodies WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST))
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256
    FROM ranked
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.dedup(texts(spark, sf_dir))
    return decided.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op9_dart_minhash")
def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(texts(spark, sf_dir))
    return found.withColumnRenamed("id", "doc_id")


@query("op10_quality_model")
def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = quality_model.fit(docs, train_labels(spark, sf_dir), "quality")
    return quality_model.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"),
    )


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeats(texts(spark, sf_dir))
    found = periodic_runs.periodic_runs(docs, keep=["doc_id"])
    return found.select("doc_id", *[c.alias(n) for n, c in periodic_runs.digests().items()])


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.frequent_words(texts(spark, sf_dir), every=199)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_best_fit")
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(texts(spark, sf_dir), vocabulary(WORD_FILE), keep=["doc_id"])
    return best_fit.pack(coded, keep=["doc_id"]).drop("ids")
