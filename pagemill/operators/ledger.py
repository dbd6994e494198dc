"""Request ledgers: events of attempts, delivered late, twice or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_number(name: str) -> Column:
    """The first run of digits in a column; null where there is none."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).cast("bigint")


def events_once(ledger: DataFrame) -> DataFrame:
    """One row of each event of an attempt (ledger_id, event) with all its columns: the one that arrived first; of
    several that arrived together, one that a hash of their plain columns chooses. Rows without an id or event are left
    out."""
    plain = [f.name for f in ledger.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.struct(*(F.col(c) for c in ledger.columns if c not in ("ledger_id", "event")))
    kept = ledger.where("ledger_id is not null and event is not null").groupBy("ledger_id", "event").agg(F.min_by(row, F.struct("ingested_at", F.xxhash64(*plain))).alias("row"))
    return kept.select("ledger_id", "event", "row.*")


def attempts_per_page(ledger: DataFrame) -> DataFrame:
    """(book_id, volume, page, attempts): distinct started attempts of the stage ocr."""
    started = ledger.where("event = 'started' and stage = 'ocr' and ledger_id is not null")
    return started.groupBy("book_id", "volume", page_number("page").alias("page")).agg(F.count_distinct("ledger_id").alias("attempts")).where("page is not null")


def attempt_pairs(ledger: DataFrame) -> DataFrame:
    """One row an attempt: (ledger_id, book_id, volume, page, started, finished, outcome, elapsed_ms). outcome is the
    finished event's status, or lost where there is none, or orphan where only that is left. Repeated deliveries count
    once; the earliest time of each event stands."""
    at = F.to_timestamp("ts_utc")
    return (
        ledger.where("ledger_id is not null and event in ('started', 'finished')")
        .groupBy("ledger_id")
        .agg(
            F.min("book_id").alias("book_id"),
            F.min("volume").alias("volume"),
            F.min(page_number("page")).alias("page"),
            F.min(F.when(F.col("event") == "started", at)).alias("started"),
            F.min(F.when(F.col("event") == "finished", at)).alias("finished"),
            F.min(F.when(F.col("event") == "finished", F.col("status"))).alias("status"),
        )
        .select(
            "ledger_id",
            "book_id",
            "volume",
            "page",
            "started",
            "finished",
            F.when(F.col("finished").isNull(), "lost").when(F.col("started").isNull(), "orphan").otherwise(F.col("status")).alias("outcome"),
            (F.unix_millis("finished") - F.unix_millis("started")).alias("elapsed_ms"),
        )
    )


def usage_totals(ledger: DataFrame) -> DataFrame:
    """Tokens of the finished attempts of each volume and model, each attempt once: (book_id, volume, model, attempts,
    prompt_tokens, completion_tokens, unknown_billing). Missing usage counts nothing."""
    finished = ledger.where("event = 'finished' and ledger_id is not null")
    once = finished.groupBy("ledger_id").agg(
        F.min("book_id").alias("book_id"),
        F.min("volume").alias("volume"),
        F.min("model").alias("model"),
        F.max("usage.prompt_tokens").alias("prompt"),
        F.max("usage.completion_tokens").alias("completion"),
        F.max(F.coalesce((F.col("billing_status") == "unknown").cast("int"), F.lit(0))).alias("unknown"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_tokens")
    return once.groupBy("book_id", "volume", "model").agg(F.count("*").alias("attempts"), total("prompt"), total("completion"), F.sum("unknown").cast("long").alias("unknown_billing"))


def error_class(message: Column) -> Column:
    """A message without what varies between calls: the body snippet goes, and each run of digits becomes #."""
    return F.regexp_replace(F.split(message, " \\| body\\[:", 2)[0], "[0-9]+", "#")


def error_streaks(results: DataFrame) -> DataFrame:
    """Longest run of results with the same class of error, one after the other, of each page: (book_id, volume,
    source_page, error_class, streak). Results are in order of attempt and id; one without an error ends a run."""
    w = Window.partitionBy("book_id", "volume", "source_page").orderBy("attempt", "result_id")
    rows = results.select("book_id", "volume", "source_page", "attempt", "result_id", F.coalesce(error_class(F.col("error")), F.lit("")).alias("error_class"))
    changed = F.coalesce((F.lag("error_class").over(w) != F.col("error_class")).cast("int"), F.lit(1))
    runs = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = runs.where("error_class <> ''").groupBy("book_id", "volume", "source_page", "error_class", "run").agg(F.count("*").alias("n"))
    return lengths.groupBy("book_id", "volume", "source_page", "error_class").agg(F.max("n").alias("streak"))


def delivery_delay(ledger: DataFrame) -> DataFrame:
    """By day of the event: (day, events, copies, late): distinct events, further deliveries of them, and those that
    first arrived more than an hour after their time."""
    at = F.to_timestamp("ts_utc")
    once = ledger.where("ledger_id is not null").groupBy("ledger_id", "event").agg(F.min(at).alias("at"), F.min("ingested_at").alias("arrived"), F.count("*").alias("n"))
    late = F.coalesce((F.unix_millis("arrived") - F.unix_millis("at") > 3_600_000).cast("long"), F.lit(0))
    return once.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.sum(F.col("n") - 1).alias("copies"), F.sum(late).alias("late"))


# The shapes of texts that a ledger may hold, the words that its states may be, and its numbers.
SHAPES = {"ledger_id": r"^[0-9a-f]{32}$", "page": r"(?i)^page_[0-9]+\.(?:png|jpe?g|webp|heic|heif)$", "model": r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}$", "error_type": r"^[A-Za-z_][A-Za-z0-9_]{0,99}$"}
ENUMS = {
    "event": ["started", "finished"],
    "stage": ["ocr", "context", "cover"],
    "status": ["started", "succeeded", "failed", "timeout_unknown"],
    "result_status": ["unknown", "known", "failed"],
    "billing_status": ["unknown", "known"],
    "finish_reason": ["stop", "length", "content_filter", "tool_calls", "function_call"],
    "thinking_type_requested": ["enabled", "disabled", "omitted"],
    "reasoning_effort_requested": ["low", "high", "max"],
}
DIGESTS = ["page_sha256", "prompt_sha256", "context_sha256", "response_id_sha256"]
NUMBERS = ["max_tokens", "reasoning_length", "timeout_s", "stream_idle_timeout_s", "estimated_cost_usd", "elapsed_s"]
PARTS = {
    **{name: f"usage.{name}" for name in ("prompt_tokens", "completion_tokens", "total_tokens", "input_tokens", "output_tokens")},
    **{f"budget_{name}": f"budget_snapshot.{name}" for name in ("requests", "image_attachments", "elapsed_s", "estimated_cost_usd")},
}
IMAGE_TYPES = ["image/png", "image/jpeg", "image/webp", "image/heic", "image/heif"]
MOST_IMAGES = 1000


def clean_events(ledger: DataFrame) -> DataFrame:
    """The ledger with its allowed fields in their allowed shapes only: identifiers, states, digests in small letters,
    numbers that are finite and not negative, the counters of usage and budget, and of the first images that are whole
    their number and bytes. A value of another shape becomes null; rows keep their number."""
    number = lambda c: (F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double")) & (F.col(c).cast("double") < float("inf"))
    digest = "^[0-9a-f]{64}$"
    images = F.filter(F.slice("images", 1, MOST_IMAGES), lambda x: F.lower(x["sha256"]).rlike(digest) & x["mime"].isin(IMAGE_TYPES) & (x["bytes"] >= 0))
    return ledger.select(
        *(F.when(F.col(c).rlike(shape), F.col(c)).alias(c) for c, shape in SHAPES.items()),
        *(F.when(F.col(c).isin(values), F.col(c)).alias(c) for c, values in ENUMS.items()),
        *(F.when(F.lower(c).rlike(digest), F.lower(c)).alias(c) for c in DIGESTS),
        *(F.when(number(c), F.col(c)).alias(c) for c in NUMBERS),
        *(F.when(number(field), F.col(field)).alias(name) for name, field in PARTS.items()),
        "stream",
        F.when(F.col("http_status").between(100, 599), F.col("http_status")).alias("http_status"),
        F.when(F.col("images").isNotNull(), F.size(images)).cast("long").alias("image_count"),
        F.aggregate(images, F.lit(0).cast("long"), lambda a, x: a + x["bytes"]).alias("image_bytes"),
    )
