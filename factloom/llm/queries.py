"""Queries of the llm subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import abuse, encoding, mixing, names, scan_noise, survivors, tokenizer
from factloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.defects(table(spark, d, "parts"))


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.restored(table(spark, d, "parts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "data_facts"), table(spark, d, "slot_values")).select("subject_id", "property", "fact_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    r = survivors.records(table(spark, d, "data_facts"), table(spark, d, "slot_values"))
    return r.select("subject_id", F.to_json("fields").alias("fields"), F.to_json("facts").alias("facts"), "n_fields", "trust")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "parts"), table(spark, d, "extracted_facts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("record_kind", "record_id").distinct()


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(names.spellings(table(spark, d, "classifications"), table(spark, d, "extracted_facts"), table(spark, d, "logins")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(p5_entities(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p6_vocabulary_use(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.vocabulary_use(p6_ids(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.counted(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.counted(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def p7_budget_shares(spark: SparkSession, d: str) -> DataFrame:
    """As many tokens as the sources with a target have: the exponent is bisected until the repetition limits hold."""
    sizes, targets = mixing.counted(table(spark, d, "documents")), table(spark, d, "mix_targets")
    n = sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").dropDuplicates(["doc_id"]).agg(F.sum("n_tokens")).first()[0]
    return mixing.mix(sizes, targets, budget=n or 0)[1]


def p7_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """Tempered token shares, as even among each other as the targets: the exponent is bisected to their entropy."""
    sizes, targets = mixing.counted(table(spark, d, "documents")), table(spark, d, "mix_targets")
    used = targets.filter("target_share > 0").join(sizes.filter("n_tokens > 0").select("source").distinct(), "source", "left_semi")
    goal = {r["source"]: r["target_share"] for r in used.limit(100_000).collect()}
    return mixing.mix(sizes, targets, target_entropy=mixing.entropy(mixing.tempered(goal, 1.0)))[1]


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.cases(p8_scores(spark, d))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


QUERIES = {
    "p1_found": p1_found, "p1_restored": p1_restored, "p3_found": p3_found, "p3_records": p3_records, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_entities": p5_entities, "p6_ids": p6_ids, "p6_vocabulary_use": p6_vocabulary_use, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_budget_shares": p7_budget_shares, "p7_entropy_shares": p7_entropy_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
}

_P3 = r"""
WITH f AS (SELECT subject_id, trim(lower(property), E' \t\n\r') AS property, fact_id, any_value(value_id) AS value_id, any_value(value) AS value, any_value(conflict) AS conflict, any_value(recent) AS recent
           FROM data_facts WHERE subject_id IS NOT NULL AND property IS NOT NULL AND fact_id IS NOT NULL GROUP BY ALL),
t AS (SELECT value_id, min(row(rank, -c)) AS k FROM (
        SELECT value_id, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS c,
               CASE regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') WHEN 'user' THEN 1 WHEN 'checksum' THEN 2 WHEN 'typesafe' THEN 3 WHEN 'openai_grounded' THEN 4 ELSE 5 END AS rank
        FROM (SELECT DISTINCT value_id, confidence, source FROM slot_values WHERE value_id IS NOT NULL)) GROUP BY value_id),
u AS (SELECT f.*, coalesce(regexp_replace(lower(value), '[\s. ]+', '', 'g') NOT IN ({words}), false) AS ok,
             coalesce(conflict, false) AS bad, coalesce(k[1], 5) AS rank, coalesce(k[2], 2.0) AS mc FROM f LEFT JOIN t USING (value_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, property ORDER BY NOT ok, bad, rank, mc, coalesce(recent, -1) DESC, fact_id) AS rn,
             count(*) OVER (PARTITION BY subject_id, property) AS n FROM u)
SELECT subject_id, property, fact_id FROM r WHERE rn = 1 AND n >= 2 AND ok"""

ORACLE = {
    "p3_found": _P3.replace("{words}", ", ".join("'" + w + "'" for w in dict.fromkeys(survivors.NOTHING))),
}
