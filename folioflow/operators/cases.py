"""Building cases out of papers: numbered paragraphs, excerpts and inputs within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import packed_sentences, redact_plain

# The sections wanted first, by words in their headings.
CASE_PRIORITY = "abstract introduction method approach experiment evaluation result discussion limitation conclusion".split()
EXCERPT_PRIORITY = "abstract method approach experiment evaluation result discussion limitation conclusion introduction".split()
# Sections that are left out.
LEFT_OUT = r"(?i)acknowledg|references|bibliography|appendix"


def chapters(markdown: Column) -> Column:
    """Array of ``(heading, body)`` at headings of one to three marks, headings masked and cut to 280 characters; without those left out."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(markdown, F.lit(""))), r"\n(?=#{1,3}\s+\S)"), lambda x: x.rlike(r"^#{1,3}\s+\S"))
    split = F.transform(parts, lambda x: F.struct(F.left(redact_plain(F.regexp_extract(x, r"^#{1,3}\s+([^\n]*)", 1)), F.lit(280)).alias("heading"), F.regexp_replace(x, r"^[^\n]*\n?", "").alias("body")))
    return F.filter(split, lambda x: ~x["heading"].rlike(LEFT_OUT))


def blocks(body: Column) -> Column:
    """The masked texts between empty lines, empty ones left out."""
    return F.filter(F.transform(F.split(body, r"\n\s*\n"), redact_plain), lambda x: x != "")


def priority(heading: Column, words: list[str]) -> Column:
    """The place of the first word that a heading has, the number of words for none."""
    low, out = F.lower(heading), None
    for i, w in enumerate(words):
        out = F.when(F.contains(low, F.lit(w)), i) if out is None else out.when(F.contains(low, F.lit(w)), i)
    return out.otherwise(len(words))


def case_paragraphs(df: DataFrame, key: str, markdown: str, budget: int = 24_000, most: int = 80, least: int = 60, longest: int = 1200, pack: int = 1000) -> DataFrame:
    """``(key, place, section, paragraph_id, text)``: the paragraphs of a paper, wanted sections first, within a budget of characters.

    Blocks under ``least`` characters are left out, those over ``longest`` split into
    packs of sentences. Sections are numbered among those that have blocks; a paper
    without sections is one under the name Manuscript. Paragraphs go on while at least ``least``
    characters and a place are left; the last is cut. A null text gives no rows.
    """
    of = lambda body: F.flatten(F.transform(F.filter(blocks(body), lambda x: F.length(x) >= least), lambda x: packed_sentences(x, longest, pack)))
    made = F.filter(F.transform(chapters(F.col(markdown)), lambda x: F.struct(x["heading"].alias("heading"), of(x["body"]).alias("blocks"))), lambda x: F.size(x["blocks"]) > 0)
    whole = F.array(F.struct(F.lit("Manuscript").alias("heading"), of(F.col(markdown)).alias("blocks")))
    parts = df.select(key, F.posexplode(F.when(F.size(made) > 0, made).otherwise(whole)).alias("no", "s"))
    rows = parts.select(key, "no", F.col("s.heading").alias("section"), F.posexplode("s.blocks").alias("p", "text"))
    order = Window.partitionBy(key).orderBy(priority(F.col("section"), CASE_PRIORITY), "no", "p")
    used = F.coalesce(F.sum(F.least(F.length("text"), F.lit(longest))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_used", used).withColumn("place", F.row_number().over(order)).filter((F.lit(budget) - F.col("_used") >= least) & (F.col("place") <= most))
    cut = F.left("text", F.least(F.lit(longest), F.lit(budget) - F.col("_used")).cast("int"))
    return rows.select(key, "place", "section", F.format_string("section-%02d-p%03d", F.col("no") + 1, F.col("p") + 1).alias("paragraph_id"), cut.alias("text"))


def alignment_paragraphs(df: DataFrame, key: str, markdown: str, longer_than: int = 700, pack: int = 650, least: int = 80, most: int = 900) -> DataFrame:
    """``(key, section, paragraph_id, text)``: all paragraphs of at least ``least`` characters, cut to ``most``, numbered as they stand before short ones are left out."""
    parts = df.select(key, F.posexplode(chapters(F.col(markdown))).alias("no", "s"))
    rows = parts.select(key, "no", F.col("s.heading").alias("section"), F.posexplode(F.flatten(F.transform(blocks(F.col("s.body")), lambda x: packed_sentences(x, longer_than, pack)))).alias("p", "text"))
    return rows.filter(F.length("text") >= least).select(key, "section", F.format_string("section-%02d-p%03d", F.col("no") + 1, F.col("p") + 1).alias("paragraph_id"), F.left("text", F.lit(most)).alias("text"))


def excerpt(markdown: Column, budget: int, sections: int = 8, least: int = 160) -> Column:
    """The most wanted sections, each with an equal share of the budget (but ``least``), as Markdown; empty without any text."""
    made = F.filter(F.transform(chapters(markdown), lambda x: F.struct(x["heading"].alias("heading"), redact_plain(x["body"]).alias("body"))), lambda x: x["body"] != "")
    plain = redact_plain(markdown)
    whole = F.when(plain != "", F.array(F.struct(F.lit("Manuscript").alias("heading"), plain.alias("body"))))
    parts = F.when(F.size(made) > 0, made).otherwise(F.coalesce(whole, F.slice(made, 1, 0)))
    ranked = F.array_sort(F.transform(parts, lambda x, i: F.struct(priority(x["heading"], EXCERPT_PRIORITY).alias("a"), i.alias("b"), x["heading"].alias("heading"), x["body"].alias("body"))))
    chosen = F.slice(ranked, 1, sections)
    share = F.greatest(F.lit(least), F.floor(F.lit(budget) / F.greatest(F.size(chosen), F.lit(1)))).cast("int")
    return F.left(F.array_join(F.transform(chosen, lambda x: F.concat(F.lit("## "), x["heading"], F.lit("\n"), F.left(x["body"], share))), "\n\n"), F.lit(budget))


def document_paragraphs(text: Column, least: int = 20, most: int = 80) -> Column:
    """The squeezed blocks between empty lines of at least ``least`` characters, the first ``most``."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.filter(parts, lambda x: F.length(x) >= least), 1, most)


def within_budget(df: DataFrame, key: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """``df`` with ``taken``: whether a row is in the longest beginning of its key's rows that keeps within the budget; the first always is, counted as at most the budget."""
    w = Window.partitionBy(key).orderBy(order)
    counted = F.when(F.row_number().over(w) == 1, F.least(F.col(size), F.lit(budget))).otherwise(F.col(size))
    rows = df.withColumn("_size", counted).withColumn("_rn", F.row_number().over(w))
    total = F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("taken", (total <= budget) & (F.col("_rn") <= most)).withColumn("counted", F.col("_size")).drop("_size", "_rn")
