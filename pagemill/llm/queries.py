"""Queries of the operators for training text, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import load
from . import consistent, lines, mixture, near, noise, spans, tokens, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("p2_found")
def _(spark, folder):
    found = consistent.changed_lines(load(spark, folder, "page_results"), "result_id", "markdown").withColumn("field", F.lit("markdown"))
    names = consistent.changed_names(load(spark, folder, "book_contexts")).withColumn("field", F.lit("proper_names"))
    return found.unionByName(names).select("field", "rec_id", "item_no")


@query("p2_consistent_pages")
def _(spark, folder):
    return load(spark, folder, "page_results").select("result_id", consistent.consistent_form(F.col("markdown")).alias("markdown"))


@query("p2_consistent_names")
def _(spark, folder):
    return consistent.consistent_names(load(spark, folder, "book_contexts"))


@query("p3_found")
def _(spark, folder):
    pairs = near.similar_pairs(load(spark, folder, "page_results"), "result_id", "markdown")
    return pairs.select(F.col("id_a").alias("result_id_a"), F.col("id_b").alias("result_id_b"))


@query("p3_groups")
def _(spark, folder):
    return near.similar_groups(load(spark, folder, "page_results"), "result_id", "markdown").withColumnRenamed("id", "result_id")


@query("p4_found")
def _(spark, folder):
    return spans.shared_spans(load(spark, folder, "page_results"), "result_id", "markdown").select(F.col("id").alias("result_id"), F.col("span_start").cast("long").alias("span_start"), F.col("span_chars").cast("long").alias("span_chars"))


@query("p4_shared_shares")
def _(spark, folder):
    return spans.shared_shares(load(spark, folder, "page_results"), "result_id", "markdown").withColumnRenamed("id", "result_id")


@query("p5_found")
def _(spark, folder):
    return lines.repeated_lines(load(spark, folder, "page_results"), "result_id", "scan_site", "markdown").withColumnRenamed("id", "result_id")


@query("p5_cleaned_pages")
def _(spark, folder):
    cleaned = lines.without_repeated_lines(load(spark, folder, "page_results"), "result_id", "scan_site", "markdown")
    return cleaned.select(F.col("id").alias("result_id"), F.col("text").alias("markdown"))


@query("p6_ids")
def _(spark, folder):
    return tokens.encode_corpus(load(spark, folder, "documents"))


@query("p6_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def _(spark, folder):
    """All texts from their ids; a null text comes back empty."""
    ids = tokens.encode_corpus(load(spark, folder, "documents"))
    return ids.select("doc_id", tokens.decode_ids(F.col("ids")).alias("text"))


@query("p8_found")
def _(spark, folder):
    return truncation.truncated(load(spark, folder, "documents"))


@query("p8_rates")
def _(spark, folder):
    docs = load(spark, folder, "documents")
    return truncation.truncation_rates(docs, truncation.truncated(docs))


@query("p8_stages")
def _(spark, folder):
    """By source: how many texts each stage judged, and how many of them it found cut."""
    docs = load(spark, folder, "documents")
    sources = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source").distinct()
    judged = truncation.verdicts(docs).join(sources, "doc_id")
    return judged.groupBy("source", "stage").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut"))


def _noise_inputs(spark, folder):
    return (load(spark, folder, name) for name in ("page_results", "books", "book_contexts", "correction_overrides"))


@query("p1_found")
def _(spark, folder):
    return noise.line_noise(*_noise_inputs(spark, folder))


@query("p1_repaired_pages")
def _(spark, folder):
    records, books, contexts, overrides = _noise_inputs(spark, folder)
    cleaned = lines.without_repeated_lines(records, "result_id", "scan_site", "markdown")
    cleaned = records.drop("markdown").join(cleaned.select(F.col("id").alias("result_id"), F.col("text").alias("markdown")), "result_id")
    return noise.repaired_pages(cleaned, books, contexts, overrides)


@query("p7_mixture")
def _(spark, folder):
    return mixture.mixture(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))


@query(
    "p7_invariants",
    "SELECT source, true AS within_repeats, true AS once_a_repeat, true AS whole_share FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '') ORDER BY source",
)
def _(spark, folder):
    """What holds for each source of the mixture, whatever the documents: none is used more often than its limit, each
    document comes once in each repeat, and the shares sum to 1."""
    docs, targets = load(spark, folder, "documents"), load(spark, folder, "mix_targets")
    rows = mixture.mixture(docs, targets)
    per = rows.groupBy("source").agg(F.max("repeat").alias("most"), F.count("*").alias("n"), F.count_distinct("doc_id", "repeat").alias("once"), F.sum("n_tokens").alias("used"))
    # one row a source, which are few
    every = Window.partitionBy(F.lit(0))
    shared = per.withColumn("share", F.col("used") / F.sum("used").over(every)).withColumn("whole", F.sum("share").over(every))
    return shared.join(targets.select("source", "max_repeats"), "source").select(
        "source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.col("n") == F.col("once")).alias("once_a_repeat"), (F.abs(F.col("whole") - 1) < 1e-9).alias("whole_share")
    )


@query("p7_shares")
def _(spark, folder):
    return mixture.share_report(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))
