"""The registered queries of the training-data operators, one opN_<name> each, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lines, lm, media, mixing, packing, pii, quality, secrets, simhash


#: The registered query's key; a real run passes its own.
KEY = b"surrogates of the registered query"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(_documents(spark, sf_dir))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "lines_before", "lines_cut", "text")


def op3_pack_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir), KEY)


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_documents(spark, sf_dir))
    base = F.sha2(secrets.span_text(F.col("base_spans")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"), "n_linked")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).drop("parts")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir)).drop("media")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_pack_mixture": op3_pack_mixture,
    "op4_quality_rules": op4_quality_rules,
    "op5_surrogates": op5_surrogates,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_mix_sources": op9_mix_sources,
    "op10_media_columns": op10_media_columns,
}

#: op6 in DuckDB, whose patterns can't look around: runs of base64 letters start where they start anyway, and addresses are cut out of
#: runs of digits and dots, of which the wrong ones go.
_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ("ident", r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@._-]{3,})""", 1, 3),
    ("opaque", "[A-Za-z0-9+/_=-]{20,}", 0, 20), ("endpoint", r"""[a-z][a-z0-9+.:-]*://[^\x20\x09-\x0D"''<>]+|[0-9.]+(?::[0-9]+)?""", 0, 4),
)
_ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$"
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS no, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS part, string_split_regex(text, '{pattern}') AS gaps FROM t"
    for i, (kind, pattern, group, least) in enumerate(_KINDS)
)
_NEAR = "EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.role = '{0}' AND o.b >= p.a - 200 AND o.a <= p.b + 200)"
OP6_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({_FOUND}),
r AS (SELECT doc_id, no, kind, least, u.range AS n, whole[u.range + 1] AS whole, part[u.range + 1] AS part, gaps[u.range + 1] AS gap FROM f, LATERAL (SELECT range FROM range(len(whole))) u),
e AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, no ORDER BY n ROWS UNBOUNDED PRECEDING) AS b FROM r),
p AS (SELECT doc_id, no, kind, CASE WHEN kind IN ('assign', 'hex', 'opaque') THEN 'secret' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'identifier' END AS role, CAST(b - length(whole) AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM e WHERE length(part) >= least
AND (kind <> 'opaque' OR (regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]'))) AND (kind <> 'endpoint' OR contains(part, '://') OR regexp_matches(part, '{_ADDRESS}'))),
s AS (SELECT * FROM p WHERE no < 3 OR (NOT EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.no < 3 AND o.a = p.a AND o.b = p.b)
AND CASE kind WHEN 'ident' THEN {_NEAR.format("secret")} WHEN 'opaque' THEN {_NEAR.format("identifier")} ELSE {_NEAR.format("secret")} AND {_NEAR.format("identifier")} END)),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, count(*) FILTER (no > 2) AS n_linked,
string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) FILTER (no < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""

ORACLE_SQL: dict[str, str] = {"op6_linked_secrets": OP6_SQL}
