"""Queries of problem 4: the flat tables of ``cases`` and the evidence links that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.shred import latest, record_table, repeated_table
from folioflow.sources.tables import pruned_table


def _cases(spark: SparkSession, folder: str, *paths: str) -> DataFrame:
    return latest(pruned_table(spark, folder, "cases", ["case_id", "received_at", *paths]), "case_id", "received_at")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """A row per case."""
    paths = ["case_schema_version", "source", "manuscript.title", "manuscript.language", "created_at"]
    return record_table(_cases(spark, folder, *paths), "case_id").withColumnRenamed("key", "case_id")


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """A row per paragraph; (case_id, paragraph_no) is its key."""
    t = repeated_table(_cases(spark, folder, "manuscript.paragraphs"), "case_id", "manuscript.paragraphs")
    return t.select(F.col("key").alias("case_id"), F.col("i1").alias("paragraph_no"), "section", "paragraph_id", "text")


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """A row per issue; (case_id, issue_no) is its key."""
    t = repeated_table(_cases(spark, folder, "gold.issues.id", "gold.issues.severity", "gold.issues.category"), "case_id", "gold.issues")
    return t.select(F.col("key").alias("case_id"), F.col("i1").alias("issue_no"), F.col("id").alias("issue_id"), "severity", "category")


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """A row per acceptable category of an issue."""
    t = repeated_table(_cases(spark, folder, "gold.issues.acceptable_categories"), "case_id", "gold.issues.acceptable_categories")
    return t.select(F.col("key").alias("case_id"), F.col("i1").alias("issue_no"), F.col("i2").alias("category_no"), F.col("value").alias("category"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """A row per entry of an issue's evidence list, null and repeated entries included."""
    t = repeated_table(_cases(spark, folder, "gold.issues.evidence_paragraph_ids"), "case_id", "gold.issues.evidence_paragraph_ids")
    return t.select(F.col("key").alias("case_id"), F.col("i1").alias("issue_no"), F.col("i2").alias("entry_no"), F.col("value").alias("paragraph_id"))


def human_references(spark: SparkSession, folder: str) -> DataFrame:
    """A row per human reference."""
    t = repeated_table(_cases(spark, folder, "human_references"), "case_id", "human_references")
    return t.select(F.col("key").alias("case_id"), F.col("i1").alias("reference_no"), "review_id", "text", "rating")


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A row per acceptable verdict of a case."""
    t = repeated_table(_cases(spark, folder, "gold.acceptable_verdicts"), "case_id", "gold.acceptable_verdicts")
    return t.select(F.col("key").alias("case_id"), F.col("i1").alias("verdict_no"), F.col("value").alias("verdict"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence links whose id, exactly as written, names no paragraph of the case."""
    both = _cases(spark, folder, "gold.issues.id", "gold.issues.evidence_paragraph_ids", "manuscript.paragraphs.paragraph_id")
    links = repeated_table(both.select("case_id", "gold"), "case_id", "gold.issues.evidence_paragraph_ids").filter("value is not null")
    ids = repeated_table(both.select("case_id", "gold"), "case_id", "gold.issues").select("key", "i1", F.col("id").alias("issue_id"))
    there = repeated_table(both.select("case_id", "manuscript"), "case_id", "manuscript.paragraphs").select("key", F.col("paragraph_id").alias("value"))
    lost = links.join(there, ["key", "value"], "left_anti").join(ids, ["key", "i1"])
    return lost.select(F.col("key").alias("case_id"), "issue_id", F.col("value").alias("paragraph_id")).distinct()


QUERIES = {
    "p4_found": found,
    "p4_cases": cases,
    "p4_paragraphs": paragraphs,
    "p4_issues": issues,
    "p4_categories": categories,
    "p4_evidence": evidence,
    "p4_human_references": human_references,
    "p4_verdicts": verdicts,
}

_LATEST = "(SELECT * FROM cases WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC) = 1)"


def _unnested(what: str, alias: str) -> str:
    return f"(SELECT case_id, unnest({what}) AS {alias}, generate_subscripts({what}, 1) - 1 AS no FROM {_LATEST})"


ORACLE = {
    "p4_found": f"""
        SELECT DISTINCT case_id, issue_id, paragraph_id
        FROM (SELECT case_id, e.id AS issue_id, unnest(e.evidence_paragraph_ids) AS paragraph_id FROM {_unnested("gold.issues", "e")}) l
        WHERE paragraph_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM {_unnested("manuscript.paragraphs", "p")} p WHERE p.case_id = l.case_id AND p.p.paragraph_id = l.paragraph_id)""",
    "p4_cases": f"""
        SELECT case_id, case_schema_version, source.kind AS source_kind, source.dataset AS source_dataset, source.split AS source_split,
               source.forum_id AS source_forum_id, source.venue_id AS source_venue_id, source.year AS source_year,
               manuscript.title AS manuscript_title, manuscript.language AS manuscript_language, created_at, received_at
        FROM {_LATEST}""",
    "p4_paragraphs": f"SELECT case_id, CAST(no AS INTEGER) AS paragraph_no, p.section AS section, p.paragraph_id AS paragraph_id, p.text AS text FROM {_unnested('manuscript.paragraphs', 'p')}",
    "p4_issues": f"SELECT case_id, CAST(no AS INTEGER) AS issue_no, e.id AS issue_id, e.severity AS severity, e.category AS category FROM {_unnested('gold.issues', 'e')}",
    "p4_categories": f"SELECT case_id, CAST(no AS INTEGER) AS issue_no, CAST(generate_subscripts(e.acceptable_categories, 1) - 1 AS INTEGER) AS category_no, unnest(e.acceptable_categories) AS category FROM {_unnested('gold.issues', 'e')}",
    "p4_evidence": f"SELECT case_id, CAST(no AS INTEGER) AS issue_no, CAST(generate_subscripts(e.evidence_paragraph_ids, 1) - 1 AS INTEGER) AS entry_no, unnest(e.evidence_paragraph_ids) AS paragraph_id FROM {_unnested('gold.issues', 'e')}",
    "p4_human_references": f"SELECT case_id, CAST(no AS INTEGER) AS reference_no, h.review_id AS review_id, h.text AS text, h.rating AS rating FROM {_unnested('human_references', 'h')}",
    "p4_verdicts": f"SELECT case_id, CAST(no AS INTEGER) AS verdict_no, v AS verdict FROM {_unnested('gold.acceptable_verdicts', 'v')}",
}
