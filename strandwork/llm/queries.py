"""One query an operator, with production parameters, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import backoff, decontaminate, fingerprints, jaccard, licenses, linededup, mixing, pii, quality, resampling, secrets, spelling, toxicity
from strandwork.llm.common import table

#: The key of the query's surrogates where the session sets none: an example, no secret.
EXAMPLE_KEY = "example"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation_report(table(spark, sf_dir, "documents"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.place_report(table(spark, sf_dir, "documents"))


def secret_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.place_report(table(spark, sf_dir, "documents"))


def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weight_report(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_report(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.strandwork.surrogate.key", EXAMPLE_KEY)
    return pii.pii_report(table(spark, sf_dir, "documents"), key)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_lm_scoring,
        op3_decontamination,
        op4_license_scan,
        op5_line_dedup,
        op6_quality_rules,
        op7_source_mixing,
        op8_jaccard_join,
        op9_pii_surrogates,
        op10_secret_scan,
        op11_spelling_variants,
        op12_importance_resampling,
        op13_fingerprints,
        quality_ablations,
        license_places,
        secret_places,
        source_weights,
    )
}
ORACLES = {
    "op2_lm_scoring": backoff.SQL,
    "op3_decontamination": decontaminate.SQL,
    "op5_line_dedup": linededup.SQL,
    "op6_quality_rules": quality.SQL,
    "quality_ablations": quality.ABLATION_SQL,
    "license_places": licenses.PLACE_SQL,
    "secret_places": secrets.PLACE_SQL,
    "source_weights": mixing.WEIGHT_SQL,
    "op8_jaccard_join": jaccard.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_fingerprints": fingerprints.SQL,
}
