"""Exact and near duplicates of pages."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions.text import plain
from ..session import materialize

THRESHOLD, OFFSET, LEAST = 0.985, 64, 80


def exact_groups(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of pages with the same text (text_sha256, first_page, n_pages). Null texts form no group."""
    return (
        pages.where(F.col(text).isNotNull())
        .groupBy(F.sha2(text, 256).alias("text_sha256"))
        .agg(F.min(key).alias("first_page"), F.count("*").alias("n_pages"))
        .where("n_pages > 1")
    )


def equal_images(pages: DataFrame) -> DataFrame:
    """Images that several pages share: (archive_sha256, n_pages, n_volumes); a page that is listed twice counts once.
    Rows without a digest or page have none."""
    once = pages.where("archive_sha256 is not null and source_page is not null").select("book_id", "volume", "source_page", "archive_sha256").distinct()
    counted = once.groupBy("archive_sha256").agg(F.count("*").alias("n_pages"), F.count_distinct("book_id", "volume").alias("n_volumes"))
    return counted.where("n_pages > 1")


#: Characters are counted by their code points modulo BINS; pairs that share a count can only be taken for more alike.
BINS = 128


@F.pandas_udf(types.ArrayType(types.IntegerType()))
def _counts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % BINS, minlength=BINS).astype(np.int32))


def measured(pages: DataFrame, keys: list[str], page: str, text: str, least: int = LEAST) -> DataFrame:
    """Pages of at least least letters and digits: (keys, p, n, digest, counts): their number, and what bounds the
    similarity of two texts, so that the texts themselves need not meet."""
    rows = pages.select(*keys, F.col(page).alias("p"), plain(F.col(text)).alias("t")).where(F.length("t") >= least)
    return rows.select(*keys, "p", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"), _counts("t").alias("counts"))


def _in_band(rows: DataFrame, keys: list[str], threshold: float, offset: int) -> DataFrame:
    """Pairs a, b of rows of one key, at most offset pages apart, whose lengths allow the similarity. A page belongs to
    one bucket of offset pages and meets the pages of its own and the next one, so that each pair meets once, in an
    equi-join."""
    a = rows.select(*keys, F.struct(*(c for c in rows.columns if c not in keys)).alias("a"), F.floor(F.col("p") / offset).alias("bucket"))
    b = rows.select(*keys, F.struct(*(c for c in rows.columns if c not in keys)).alias("b"), F.explode(F.array(F.floor(F.col("p") / offset), F.floor(F.col("p") / offset) - 1)).alias("bucket"))
    near = (F.col("b.p") - F.col("a.p")).between(1, offset)
    lengths = 2.0 * F.least("a.n", "b.n") / (F.col("a.n") + F.col("b.n")) >= threshold
    return a.join(b, [*keys, "bucket"]).where(near & lengths).drop("bucket")


def band_pairs(pages: DataFrame, keys: list[str], page: str, text: str, threshold: float = THRESHOLD, offset: int = OFFSET, least: int = LEAST) -> DataFrame:
    """Pairs of pages of one key that lie at most offset pages apart, have at least least letters and digits, and whose
    lengths allow the similarity: (keys, first, duplicate, first_chars, duplicate_chars)."""
    rows = pages.select(*keys, F.col(page).alias("p"), F.length(plain(F.col(text))).alias("n")).where(F.col("n") >= least)
    pairs = _in_band(rows, keys, threshold, offset)
    return pairs.select(*keys, F.col("a.p").alias("first"), F.col("b.p").alias("duplicate"), F.col("a.n").cast("long").alias("first_chars"), F.col("b.n").cast("long").alias("duplicate_chars"))


def bounded_pairs(pages: DataFrame, keys: list[str], page: str, text: str, threshold: float = THRESHOLD, offset: int = OFFSET, least: int = LEAST) -> DataFrame:
    """Pairs of band_pairs whose characters allow the similarity too: (keys, first, duplicate, common, equal): common is
    the most characters that both may share, equal tells that the texts are the same."""
    pairs = _in_band(measured(pages, keys, page, text, least), keys, threshold, offset)
    common = F.aggregate(F.zip_with("a.counts", "b.counts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x).cast("long")
    pairs = pairs.withColumn("common", common).where(2.0 * F.col("common") / (F.col("a.n") + F.col("b.n")) >= threshold)
    return pairs.select(*keys, F.col("a.p").alias("first"), F.col("b.p").alias("duplicate"), "common", (F.col("a.digest") == F.col("b.digest")).alias("equal"))


def _ratios(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("first_text").to_pylist(), batch.column("duplicate_text").to_pylist(), strict=True)
            values = [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
            names = [*keys, "first", "duplicate"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, pa.float64())], [*names, "similarity"])

    return run


def near_pairs(pages: DataFrame, keys: list[str], page: str, text: str, threshold: float = THRESHOLD, offset: int = OFFSET, least: int = LEAST) -> DataFrame:
    """Pairs whose matching-blocks ratio reaches threshold: (keys, first, duplicate, similarity). pages has one row a
    key and page. Lengths and counts of characters leave few pairs; equal texts are settled by their digests, and only
    the texts of the others meet."""
    bounded = materialize(bounded_pairs(pages, keys, page, text, threshold, offset, least), "bounded")
    same = bounded.where("equal").select(*keys, "first", "duplicate", F.lit(1.0).alias("similarity"))
    others = bounded.where("not equal").select(*keys, "first", "duplicate")
    wanted = others.select(*keys, F.explode(F.array("first", "duplicate")).alias("p")).distinct()
    texts = pages.select(*keys, F.col(page).alias("p"), F.col(text).alias("t")).join(wanted, [*keys, "p"], "left_semi").withColumn("t", plain(F.col("t")))
    a, b = texts.withColumnsRenamed({"p": "first", "t": "first_text"}), texts.withColumnsRenamed({"p": "duplicate", "t": "duplicate_text"})
    asked = others.join(a, [*keys, "first"]).join(b, [*keys, "duplicate"]).select(*keys, "first", "duplicate", "first_text", "duplicate_text")
    fields = ", ".join(f"{n} {asked.schema[n].dataType.simpleString()}" for n in [*keys, "first", "duplicate"])
    return same.unionByName(asked.mapInArrow(_ratios(keys), f"{fields}, similarity double").where(F.col("similarity") >= threshold))


def islands(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of pairs in which both pages advance by one, in the order of (first, duplicate): (keys, first_start,
    first_end, duplicate_start, duplicate_end, length) and, if pairs has a similarity, similarity_min and similarity_max
    to four places. Pairs of one key are few: the output of a threshold."""
    w = Window.partitionBy(*keys).orderBy("first", "duplicate")
    goes_on = (F.col("first") == F.lag("first").over(w) + 1) & (F.col("duplicate") == F.lag("duplicate").over(w) + 1)
    marked = pairs.withColumn("new", F.coalesce((~goes_on).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = [F.min("first").alias("first_start"), F.max("first").alias("first_end"), F.min("duplicate").alias("duplicate_start"), F.max("duplicate").alias("duplicate_end"), F.count("*").alias("length")]
    likeness = [F.bround(F.min("similarity"), 4).alias("similarity_min"), F.bround(F.max("similarity"), 4).alias("similarity_max")] if "similarity" in pairs.columns else []
    return numbered.groupBy(*keys, "island").agg(*ranges, *likeness).drop("island")


def duplicate_report(images: DataFrame, pages: DataFrame, keys: list[str], page: str, image: str, text: str) -> DataFrame:
    """images: (keys, page, image digest); pages: (keys, page, text). What is told of a book, of which nothing is taken
    out: (keys, kind, first_start, first_end, duplicate_start, duplicate_end, length, similarity_min, similarity_max): a
    row of kind exact for each page whose image an earlier one has, with the first such page, and one of kind near for
    each run of near-duplicate texts."""
    once = images.where(F.col(image).isNotNull()).select(*keys, F.col(page).alias("duplicate"), F.col(image).alias("image")).distinct()
    first = once.withColumn("first", F.min("duplicate").over(Window.partitionBy(*keys, "image"))).where("duplicate > first")
    exact = first.select(*keys, F.lit("exact").alias("kind"), F.col("first").alias("first_start"), F.col("first").alias("first_end"), F.col("duplicate").alias("duplicate_start"), F.col("duplicate").alias("duplicate_end"), F.lit(1).cast("long").alias("length"), F.lit(1.0).alias("similarity_min"), F.lit(1.0).alias("similarity_max"))
    near = islands(near_pairs(pages, keys, page, text), keys).withColumn("kind", F.lit("near"))
    return exact.unionByName(near.select(exact.columns))
