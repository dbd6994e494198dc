"""Lines that repeat within one site.

A line's key are its letters in the consistent form and lower case. For keys that can reach the limits, the records of
each variant of the line are kept as bitmaps (of 32,768 records each, so that a bitmap of few records shrinks to little
when it is moved or written), those of the variants are united, and the exact cardinality decides. A line of a record
goes if the record's bit is set in its key's bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .consistent import consistent_form

LEAST_LETTERS, LEAST_RECORDS, LEAST_SHARE = 8, 5, 0.04


def letters(text: Column) -> Column:
    """The letters of a text, in lower case."""
    return F.lower(F.regexp_replace(text, r"\P{L}+", ""))


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def keyed_lines(records: DataFrame, id_column: str, site_column: str, text_column: str, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(site, id, line_no from 1, key, variant) of the lines with enough letters; key and variant are hashes."""
    form = consistent_form(F.col(text_column))
    rows = records.where(F.col(text_column).isNotNull() & (F.col(text_column) != "") & F.col(site_column).isNotNull() & F.col(id_column).isNotNull())
    lines = rows.select(F.col(site_column).alias("site"), F.col(id_column).cast("long").alias("id"), F.posexplode(F.split(form, "\n")).alias("at", "line"))
    return (
        lines.withColumn("letters", letters(F.col("line")))
        .where(F.length("letters") >= least_letters)
        .select("site", "id", (F.col("at") + 1).cast("long").alias("line_no"), F.xxhash64("letters").alias("key"), F.xxhash64("line").alias("variant"))
    )


def line_bitmaps(lines: DataFrame, totals: DataFrame, least_records: int = LEAST_RECORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """lines: of keyed_lines; totals: (site, total). Keys over the limits with their bitmaps (site, key, records,
    bucket, bitmap)."""
    limit = F.greatest(F.lit(least_records), F.ceil(F.lit(least_share) * F.col("total") - 1e-9))
    # no more records than lines: this leaves few keys, and is summed before it moves
    possible = lines.groupBy("site", "key").agg(F.count("*").alias("n")).join(totals, "site").where(F.col("n") >= limit).select("site", "key", "total")
    variants = (
        lines.join(possible.select("site", "key"), ["site", "key"], "left_semi")
        .groupBy("site", "key", "variant", F.bitmap_bucket_number("id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))
    )
    united = materialize(variants.groupBy("site", "key", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")), "bitmaps")
    counts = united.groupBy("site", "key").agg(F.sum(F.bitmap_count("bitmap")).alias("records"))
    enough = counts.join(totals, "site").where(F.col("records") >= limit).select("site", "key", "records")
    return united.join(enough, ["site", "key"])


def _prepared(records: DataFrame, id_column: str, site_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    lines = materialize(keyed_lines(records, id_column, site_column, text_column), "lines")
    filled = records.where(F.col(text_column).isNotNull() & (F.col(text_column) != ""))
    totals = filled.groupBy(F.col(site_column).alias("site")).agg(F.count_distinct(id_column).alias("total"))
    return lines, materialize(line_bitmaps(lines, totals), "repeated")


def repeated_lines(records: DataFrame, id_column: str, site_column: str, text_column: str) -> DataFrame:
    """(id, line_no) of lines that occur, within one site, in at least LEAST_RECORDS records and in LEAST_SHARE of the
    site's records with a text. Lines are the same if their letters agree in the consistent form and lower case; lines
    with fewer than LEAST_LETTERS letters are none. Rows with a null site, id or text have no lines; a row given twice
    counts once."""
    lines, repeated = _prepared(records, id_column, site_column, text_column)
    placed = lines.withColumn("bucket", F.bitmap_bucket_number("id")).join(repeated, ["site", "key", "bucket"])
    return placed.where(_bit(F.col("bitmap"), F.bitmap_bit_position("id"))).select("id", "line_no").distinct()


def line_report(records: DataFrame, id_column: str, site_column: str, text_column: str) -> DataFrame:
    """The repeated lines of each site (site, key, records): in how many of its records each occurs."""
    _, repeated = _prepared(records, id_column, site_column, text_column)
    return repeated.select("site", "key", "records").distinct()


def without_repeated_lines(records: DataFrame, id_column: str, site_column: str, text_column: str) -> DataFrame:
    """(id, text): each record's text without its site's repeated lines; null stays null."""
    gone = repeated_lines(records, id_column, site_column, text_column).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", (i + 1).cast("long")))
    return (
        records.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        .join(gone, "id", "left")
        .select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    )
