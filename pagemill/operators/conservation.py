"""Checks that nothing is lost between inventories, ledgers, results and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ledger import attempts_per_page

VOLUME = ["book_id", "volume"]
PAGE = [*VOLUME, "source_page"]

# Kinds of pages of a book and what became of their texts; kinds of which the image is kept.
PAGE_TYPES = ["text", "chart", "complex_table", "failed", "review"]
TEXT_STATES = ["ok", "blank", "failed", "missing"]
IMAGE_TYPES = ["chart", "complex_table", "failed", "review"]


def stem(path: str | Column) -> Column:
    """The name of a file without folder and ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def known_attempts(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """(book_id, volume, source_page, attempts, ledger_attempts, lost): the greater number of attempts of inventory and
    ledger; lost where the inventory knows more than the ledger, which then is not whole. Of several rows of a page the
    greatest number counts; nulls count as 0."""
    listed = pages.groupBy(*PAGE).agg(F.max(F.coalesce("attempts", F.lit(0))).cast("long").alias("listed"))
    counted = attempts_per_page(ledger).select(*VOLUME, F.col("page").cast("int").alias("source_page"), F.col("attempts").alias("counted"))
    joined = listed.join(counted, PAGE, "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return joined.select(*PAGE, F.greatest("listed", "counted").alias("attempts"), F.col("counted").alias("ledger_attempts"), (F.col("listed") > F.col("counted")).alias("lost"))


def last_failures(results: DataFrame) -> DataFrame:
    """(book_id, volume, source_page, error): of each page the error of its last failed result, by time and id."""
    failed = results.where("error is not null")
    return failed.groupBy(*PAGE).agg(F.max_by("error", F.struct("finished_at", "result_id")).alias("error"))


def matched_covers(contexts: DataFrame, pages: DataFrame) -> DataFrame:
    """(context_id, cover_page, source_page, matches): the page of its volume whose image a context names as the cover;
    source_page is null unless there is exactly one. A context without a cover has no row."""
    named = pages.select(*PAGE, F.regexp_extract("ocr_image", r"([^/]*)$", 1).alias("cover_page")).distinct()
    joined = contexts.where("cover_page is not null").select("context_id", *VOLUME, "cover_page").join(named, [*VOLUME, "cover_page"], "left")
    found = joined.groupBy("context_id", "cover_page").agg(F.count("source_page").alias("matches"), F.min("source_page").alias("only"))
    return found.select("context_id", "cover_page", F.when(F.col("matches") == 1, F.col("only")).alias("source_page"), "matches")


def cache_mismatches(records: DataFrame, texts: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """records: (key, stem, image_sha256, text_sha256); texts: (key, stem, text_sha256); images: (key, stem,
    image_sha256). A full outer join of the three: (key, stem, rule): no-record for a text that nothing records, no-text,
    no-image, text-changed, image-changed. Several texts or images of a stem: one that fits is enough."""
    at = [*key, "stem"]
    r = records.groupBy(*at).agg(F.collect_set("image_sha256").alias("ri"), F.collect_set("text_sha256").alias("rt"))
    t = texts.groupBy(*at).agg(F.collect_set("text_sha256").alias("tt"))
    i = images.groupBy(*at).agg(F.collect_set("image_sha256").alias("ii"))
    sides = r.join(t, at, "full").join(i, at, "full").where("rt is not null or tt is not null")
    rules = {
        "no-record": F.col("rt").isNull(),
        "no-text": F.col("tt").isNull(),
        "no-image": F.col("ii").isNull(),
        "text-changed": F.col("rt").isNotNull() & F.col("tt").isNotNull() & ~F.arrays_overlap("rt", "tt"),
        "image-changed": F.col("ri").isNotNull() & F.col("ii").isNotNull() & ~F.arrays_overlap("ri", "ii"),
    }
    met = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items())))
    return sides.select(*at, F.explode(met).alias("rule"))


def without(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys of left that right lacks, once each: files that nothing refers to, inputs without an output."""
    return left.select(*key).distinct().join(right.select(*key).distinct(), key, "left_anti")


def repeated_stems(files: DataFrame, key: list[str], path: str) -> DataFrame:
    """(key, stem, n) of stems that several files of a key have."""
    once = files.where(F.col(path).isNotNull()).select(*key, F.col(path).alias("path")).distinct()
    return once.groupBy(*key, stem("path").alias("stem")).agg(F.count("*").alias("n")).where("n > 1")


def matched_stems(pages: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """pages, images: (key, path). (key, stem, images): stems of pages with the number of images of the same stem; only
    one is right."""
    counted = images.select(*key, "path").distinct().groupBy(*key, stem("path").alias("stem")).agg(F.count("*").alias("images"))
    return pages.select(*key, stem("path").alias("stem")).distinct().join(counted, [*key, "stem"], "left").select(*key, "stem", F.coalesce("images", F.lit(0)).cast("long").alias("images"))


def listed_images(listing: DataFrame, line: str) -> DataFrame:
    """listing: a column of lines of a listing of embedded images. (its other columns, page, number, kind, encoding);
    lines of fewer than nine fields or without numbers in the first two are none."""
    fields = F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")
    rows = listing.withColumn("_f", fields).where((F.size("_f") >= 9) & F.get("_f", F.lit(0)).rlike(r"^\d+$") & F.get("_f", F.lit(1)).rlike(r"^\d+$"))
    f = lambda i: F.get("_f", F.lit(i))
    return rows.select(*(c for c in listing.columns if c != line), f(0).cast("int").alias("page"), f(1).cast("int").alias("number"), F.lower(f(2)).alias("kind"), F.lower(f(8)).alias("encoding"))


def import_plans(pages: DataFrame, images: DataFrame, key: list[str], least: float = 0.8) -> DataFrame:
    """pages: (key, page) of all pages; images: (key, page, kind, encoding). How each page is taken over (key, page,
    plan): jpeg or png where its only image is a scan, render elsewhere; whole for all pages of a key of which fewer
    than least have one only, or of which an image lies on an unknown page."""
    per_page = images.groupBy(*key, "page").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("encoding").alias("encoding"))
    joined = pages.select(*key, "page").distinct().join(per_page, [*key, "page"], "left")
    joined = joined.withColumn("simple", F.coalesce((F.col("n") == 1) & (F.col("kind") == "image"), F.lit(False)))
    unknown = without(images, pages, [*key, "page"]).select(*key).distinct().withColumn("unknown", F.lit(True))
    share = joined.groupBy(*key).agg(F.avg(F.col("simple").cast("double")).alias("share")).join(unknown, key, "left")
    plan = F.when((F.col("share") < least) | F.coalesce("unknown", F.lit(False)), "whole").when(~F.col("simple"), "render").when(F.col("encoding") == "jpeg", "jpeg").otherwise("png")
    return joined.join(share, key).select(*key, "page", plan.alias("plan"))


def page_kinds(pages: DataFrame) -> DataFrame:
    """pages: (book_id, volume, source_page, ocr_state, representation). What a page is in a book: (…, page_type,
    ocr_status)."""
    kind = F.when(F.col("representation") == "reflow", "text").when(F.col("representation") == "hybrid", "complex_table").otherwise("failed")
    status = F.when(F.col("representation").isin("reflow", "hybrid"), "ok").when(F.col("ocr_state") == "blank", "blank").otherwise("failed")
    return pages.select(*PAGE, kind.alias("page_type"), status.alias("ocr_status"))


def book_page_violations(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """pages: (book_id, volume, source_page, page_type, ocr_status, text); expected: (book_id, volume, source_page).
    (book_id, volume, source_page, rule): number, twice, type, status, failed-ok, no-text, unwanted-text, and missing or
    extra pages. A null breaks its rule; a page that failed may have the text of a failed or blank page only."""
    text = T.stripped(F.coalesce("text", F.lit("")))
    dead = (text == "") | (text == T.BLANK_PAGE) | F.startswith(text, F.lit(T.FAILED_PAGE))
    once = Window.partitionBy(*PAGE)
    rules = {
        "number": F.coalesce(F.col("source_page") < 1, F.lit(True)),
        "twice": F.count("*").over(once) > 1,
        "type": ~F.coalesce(F.col("page_type").isin(PAGE_TYPES), F.lit(False)),
        "status": ~F.coalesce(F.col("ocr_status").isin(TEXT_STATES), F.lit(False)),
        "failed-ok": (F.col("ocr_status") == "ok") & F.col("page_type").isin("failed", "review"),
        "no-text": (F.col("ocr_status") == "ok") & dead,
        "unwanted-text": (F.col("ocr_status") != "ok") & ~dead,
    }
    marked = pages.select(*PAGE, *(condition.alias(f"_{name}") for name, condition in rules.items()))
    met = F.array_compact(F.array(*(F.when(F.col(f"_{name}"), F.lit(name)) for name in rules)))
    broken = marked.select(*PAGE, F.explode(met).alias("rule"))
    missing = without(expected, pages, PAGE).withColumn("rule", F.lit("missing"))
    return broken.unionByName(missing).unionByName(without(pages, expected, PAGE).withColumn("rule", F.lit("extra")))


def book_counts(pages: DataFrame) -> DataFrame:
    """pages: (book_id, volume, source_page, page_type, ocr_status). (book_id, volume, source_pages, ocr_pages,
    image_pages, failed_pages, review_pages)."""
    many = lambda condition, name: F.sum(F.coalesce(condition, F.lit(False)).cast("long")).alias(name)
    ok = F.col("ocr_status") == "ok"
    return pages.groupBy(*VOLUME).agg(
        F.count("*").alias("source_pages"),
        many(ok, "ocr_pages"),
        many(F.col("page_type").isin(IMAGE_TYPES) | ~ok, "image_pages"),
        many(F.col("ocr_status").isin("failed", "missing"), "failed_pages"),
        many(F.col("page_type") == "review", "review_pages"),
    )


def batch_summary(results: DataFrame, key: list[str]) -> DataFrame:
    """(key, results, ok, blank, dead, failed, prompt_tokens, completion_tokens, unknown_billing): counts of results and
    their tokens, of whatever they became; unknown_billing says that the sums are lower bounds."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    many = lambda condition, name: F.sum(condition.cast("long")).alias(name)
    failed = F.col("error").isNotNull()
    return results.groupBy(*key).agg(
        F.count("*").alias("results"),
        many(~failed & ~flag("is_blank") & ~flag("is_dead"), "ok"),
        many(flag("is_blank") & ~failed, "blank"),
        many(flag("is_dead"), "dead"),
        many(failed & ~flag("is_dead"), "failed"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.max(flag("billing_unknown")).alias("unknown_billing"),
    )


def unbound_contexts(contexts: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """expected: (book_id, volume, fields). (context_id, field): fields of a context that none of the expected values of
    its volume equals. A null is none."""
    rows = contexts.select("context_id", *VOLUME, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("context_id", *VOLUME, "x.field", "x.value")
    wanted = expected.select(*VOLUME, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select(*VOLUME, "x.field", "x.value").distinct()
    return rows.join(wanted, [*VOLUME, "field", "value"], "left_anti").select("context_id", "field")


def reconciled_states(pages: DataFrame, texts: DataFrame, failures: DataFrame) -> DataFrame:
    """texts: (book_id, volume, source_page, text); failures: of last_failures. (book_id, volume, source_page, state,
    form): what the pages' texts say, before any limit on attempts: a text beats a failure, a failure a pending state;
    pages with neither keep what they have."""
    text = T.stripped(F.col("text"))
    joined = pages.select(*PAGE, "ocr_state", "representation").join(texts.select(*PAGE, "text"), PAGE, "left").join(failures, PAGE, "left")
    found = F.coalesce(text, F.lit("")) != ""
    state = F.when(found & (text == T.BLANK_PAGE), "blank").when(found & F.startswith(text, F.lit(T.FAILED_PAGE)), "failed").when(found, "ok").when(F.col("error").contains("unsupported"), "unsupported").when(F.col("error").rlike("timeout|network"), "ambiguous").when(F.col("error").isNotNull(), "failed").otherwise(F.col("ocr_state"))
    form = F.when(state == "ok", F.when(found & T.wants_image(text), "hybrid").when(found, "reflow").otherwise(F.col("representation"))).when(state == "pending", "pending").when(state.isNull(), F.col("representation")).otherwise("image")
    return joined.select(*PAGE, state.alias("state"), form.alias("form"))
