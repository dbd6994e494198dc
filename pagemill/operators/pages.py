"""Inventories of pages: latest rows, conservation checks, ordering, sampling and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOLUME = ["book_id", "volume"]
# States and forms of pages.
STATES = ["ok", "blank", "unsupported", "failed", "ambiguous", "pending"]
FORMS = ["reflow", "hybrid", "image", "pending"]


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order; ties must be broken by it."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def page_violations(pages: DataFrame) -> DataFrame:
    """Rows of an inventory that break a rule of a single page: (book_id, volume, source_page, rule). A row that breaks
    several rules is given for each; a null state, form or number of attempts breaks its rule."""
    state, form = F.col("ocr_state"), F.col("representation")
    rules = {
        "state": ~F.coalesce(state.isin(STATES), F.lit(False)),
        "form": ~F.coalesce(form.isin(FORMS), F.lit(False)),
        "pending-form": (state == "pending") & (form != "pending"),
        "ok-form": (state == "ok") & ~form.isin("reflow", "hybrid"),
        "other-form": state.isin("blank", "unsupported", "failed", "ambiguous") & (form != "image"),
        "attempts": ~F.coalesce(F.col("attempts").between(0, 6), F.lit(False)),
        "archive-path": ~safe_relative_path(F.col("archive_image")),
        "ocr-path": ~safe_relative_path(F.col("ocr_image")),
    }
    broken = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items())))
    return pages.select(*VOLUME, "source_page", F.explode(broken).alias("rule"))


def safe_relative_path(path: Column) -> Column:
    """A path that is relative and has no empty or parent part. A null path is not safe."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~F.exists(parts, lambda p: p.isin("", "..", ".")) & ~path.contains("\\"), F.lit(False))


def volume_violations(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Volumes whose header contradicts itself or its pages: (book_id, volume, rule)."""
    head = books.select(*VOLUME, F.col("schema_version").alias("version"), "source_pdf.page_count", "source_pdf.included_pages", "source_pdf.excluded_pages")
    excluded = F.transform("excluded_pages", lambda x: x["page"])
    every = F.when(F.col("page_count") >= 1, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    listed = pages.groupBy(*VOLUME).agg(F.sort_array(F.collect_set("source_page")).alias("listed"), F.count("source_page").alias("rows"))
    rules = {
        "version": F.coalesce(F.col("version") != 1, F.lit(True)),
        "page-count": F.coalesce(F.col("page_count") < 1, F.lit(True)),
        "included-order": F.col("included_pages") != F.array_sort(F.array_distinct("included_pages")),
        "excluded-reason": F.exists("excluded_pages", lambda x: F.coalesce(F.trim(x["reason"]) == "", F.lit(True))),
        "excluded-range": F.exists(excluded, lambda p: (p < 1) | (p > F.col("page_count"))),
        "excluded-twice": F.size(F.array_distinct(excluded)) != F.size(excluded),
        "conservation": F.col("included_pages") != F.array_except(every, excluded),
        "pages-listed": F.coalesce(F.col("included_pages") != F.col("listed"), F.lit(True)),
        "page-twice": F.col("rows") > F.size("listed"),
    }
    broken = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items())))
    return head.join(listed, VOLUME, "left").select(*VOLUME, F.explode(broken).alias("rule"))


def expected_pages(books: DataFrame) -> DataFrame:
    """The pages 1..page_count of each volume without the excluded ones: (book_id, volume, source_page)."""
    every = books.where("source_pdf.page_count >= 1").select(*VOLUME, F.explode(F.sequence(F.lit(1), F.col("source_pdf.page_count"))).alias("source_page"))
    gone = books.select(*VOLUME, F.explode("source_pdf.excluded_pages.page").alias("source_page"))
    return every.join(gone, [*VOLUME, "source_page"], "left_anti")


def missing_and_extra(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: (keys, side: missing or extra), once each."""
    left, right = expected.select(*keys).distinct(), found.select(*keys).distinct()
    missing = left.join(right, keys, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("extra")))


def natural_key(name: Column) -> Column:
    """All runs of digits of a file's stem as numbers, and then the stem: page_9 comes before page_10."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.struct(F.transform(F.regexp_extract_all(stem, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint")).alias("numbers"), stem.alias("stem"))


def natural_order(files: DataFrame, keys: list[str], name: str) -> DataFrame:
    """files with their place from 1 in natural order within keys (place); equal names share no order, their full names
    decide."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(natural_key(F.col(name)), F.col(name))))


def representative(pages: DataFrame, keys: list[str], order: str, count: int = 7) -> DataFrame:
    """Pages spread evenly over each key's order, first and last included: the places round((n - 1) * i / (count - 1)),
    halves to the even one. All pages where a key has no more than count."""
    w = Window.partitionBy(*keys)
    placed = pages.withColumn("_place", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround((F.col("_n") - 1) * i / F.lit(count - 1)).cast("int"))
    return placed.where(F.array_contains(wanted, F.col("_place"))).drop("_place", "_n")


def front_middle_end(pages: DataFrame, keys: list[str], order: str, front: int = 7, middle: int = 4, end: int = 4) -> DataFrame:
    """Of each key the first pages, some from the middle, and the last; all where there are no more than their sum."""
    w = Window.partitionBy(*keys)
    placed = pages.withColumn("_place", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    start = F.floor((F.col("_n") - middle) / 2)
    wanted = (F.col("_n") <= front + middle + end) | (F.col("_place") < front) | F.col("_place").between(start, start + middle - 1) | (F.col("_place") >= F.col("_n") - end)
    return placed.where(wanted).drop("_place", "_n")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by order, for a report; ties must be broken by it. Each task keeps n rows, and so does the end."""
    return rows.orderBy(*order).limit(n)


def page_numbers(ranges: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lists such as "1,5-8" as rows (keys, page), each page once. Parts that are no range of positive numbers in order
    have none."""
    part = ranges.select(*keys, F.explode(F.split(text, ",")).alias("part")).select(*keys, F.trim("part").alias("part"))
    bounds = part.select(*keys, F.regexp_extract("part", r"^(\d{1,6})(?:\s*-\s*(\d{1,6}))?$", 1).alias("a"), F.regexp_extract("part", r"^(\d{1,6})(?:\s*-\s*(\d{1,6}))?$", 2).alias("b"))
    numbers = bounds.where("a <> ''").select(*keys, F.col("a").cast("int").alias("a"), F.when(F.col("b") == "", F.col("a")).otherwise(F.col("b")).cast("int").alias("b"))
    return numbers.where("a >= 1 and b >= a").select(*keys, F.explode(F.sequence("a", "b")).alias("page")).distinct()
