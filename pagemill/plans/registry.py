"""All queries by name, and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, duplicates, ledger, pages
from ..streaming import ledger as stream
from ..tables import load
from .catalog import EXPECTED, QUERIES, SQL, TEXTS, query
from .catalog import texts as _texts

# -- inventories -------------------------------------------------------------------------------------------------


@query("g01_exact_duplicate_groups", "SELECT sha256(text) AS text_sha256, min(doc_id) AS first_page, count(*) AS n_pages FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(spark, folder):
    return duplicates.exact_groups(load(spark, folder, "documents"), "doc_id", "text")


@query(
    "g01_equal_images",
    """SELECT archive_sha256, count(*) AS n_pages, count(DISTINCT book_id || '/' || volume) AS n_volumes FROM (SELECT DISTINCT book_id, volume, source_page, archive_sha256
       FROM manifest_pages WHERE archive_sha256 IS NOT NULL AND source_page IS NOT NULL) GROUP BY 1 HAVING count(*) > 1""",
)
def _(spark, folder):
    return duplicates.equal_images(load(spark, folder, "manifest_pages"))


@query(
    "w10_latest_page_rows",
    """SELECT book_id, volume, source_page, ocr_state, representation, attempts FROM (SELECT *, row_number() OVER (PARTITION BY book_id, volume, source_page
       ORDER BY loaded_at DESC NULLS LAST, attempts DESC NULLS LAST, ocr_state ASC NULLS FIRST, representation ASC NULLS FIRST) AS k FROM manifest_pages) WHERE k = 1""",
)
def _(spark, folder):
    order = [F.desc("loaded_at"), F.desc("attempts"), F.asc("ocr_state"), F.asc("representation")]
    rows = load(spark, folder, "manifest_pages").select("book_id", "volume", "source_page", "ocr_state", "representation", "attempts", "loaded_at")
    return pages.latest(rows, ["book_id", "volume", "source_page"], order).drop("loaded_at")


_PATH = "NOT coalesce({0} <> '' AND NOT contains({0}, chr(92)) AND NOT list_has_any(string_split({0}, '/'), ['', '.', '..']), false)"
_PAGE_RULES = {
    "state": "NOT coalesce(ocr_state IN ('ok','blank','unsupported','failed','ambiguous','pending'), false)",
    "form": "NOT coalesce(representation IN ('reflow','hybrid','image','pending'), false)",
    "pending-form": "ocr_state = 'pending' AND representation <> 'pending'",
    "ok-form": "ocr_state = 'ok' AND representation NOT IN ('reflow','hybrid')",
    "other-form": "ocr_state IN ('blank','unsupported','failed','ambiguous') AND representation <> 'image'",
    "attempts": "NOT coalesce(attempts BETWEEN 0 AND 6, false)",
    "archive-path": _PATH.format("archive_image"),
    "ocr-path": _PATH.format("ocr_image"),
}


@query("c01_page_violations", " UNION ALL ".join(f"SELECT book_id, volume, source_page, '{name}' AS rule FROM manifest_pages WHERE {rule}" for name, rule in _PAGE_RULES.items()))
def _(spark, folder):
    return pages.page_violations(load(spark, folder, "manifest_pages"))


_HEAD = """head AS (SELECT b.*, list_transform(excluded, lambda x: x.page) AS gone FROM (
    SELECT book_id, volume, schema_version AS version, source_pdf.page_count AS n, source_pdf.included_pages AS included, source_pdf.excluded_pages AS excluded FROM books) b),
  listed AS (SELECT book_id, volume, list_sort(list(DISTINCT source_page)) AS listed, count(source_page) AS listings FROM manifest_pages GROUP BY 1, 2),
  both_sides AS (SELECT h.*, l.listed, l.listings FROM head h LEFT JOIN listed l ON h.book_id = l.book_id AND h.volume = l.volume)"""
_VOLUME_RULES = {
    "version": "coalesce(version <> 1, true)",
    "page-count": "coalesce(n < 1, true)",
    "included-order": "included <> list_sort(list_distinct(included))",
    "excluded-reason": "len(list_filter(excluded, lambda x: coalesce(trim(x.reason) = '', true))) > 0",
    "excluded-range": "len(list_filter(gone, lambda p: p < 1 OR p > n)) > 0",
    "excluded-twice": "len(list_distinct(gone)) <> len(gone)",
    "conservation": "included <> list_filter(range(1, n + 1), lambda p: NOT list_contains(gone, p))",
    "pages-listed": "coalesce(included <> listed, true)",
    "page-twice": "listings > len(listed)",
}


@query("c01_volume_violations", f"WITH {_HEAD} " + " UNION ALL ".join(f"SELECT book_id, volume, '{name}' AS rule FROM both_sides WHERE {rule}" for name, rule in _VOLUME_RULES.items()))
def _(spark, folder):
    return pages.volume_violations(load(spark, folder, "books"), load(spark, folder, "manifest_pages"))


@query("expected_pages_p02", f"WITH {EXPECTED} SELECT * FROM expected")
def _(spark, folder):
    return pages.expected_pages(load(spark, folder, "books"))


@query(
    "u02_missing_and_extra_pages",
    f"""WITH {EXPECTED}, found AS (SELECT DISTINCT book_id, volume, source_page FROM page_results)
        SELECT *, 'missing' AS side FROM (SELECT * FROM expected EXCEPT SELECT * FROM found)
        UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM found EXCEPT SELECT * FROM expected)""",
)
def _(spark, folder):
    return pages.missing_and_extra(pages.expected_pages(load(spark, folder, "books")), load(spark, folder, "page_results"), ["book_id", "volume", "source_page"])


@query(
    "o01_natural_order",
    r"""SELECT book_id, volume, ocr_image, CAST(row_number() OVER (PARTITION BY book_id, volume ORDER BY list_transform(regexp_extract_all(stem, '(\d+)', 1), lambda x: CAST(x AS BIGINT)), stem, ocr_image) AS INT) AS place
        FROM (SELECT *, regexp_replace(regexp_extract(ocr_image, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM (SELECT DISTINCT book_id, volume, ocr_image FROM manifest_pages WHERE ocr_image IS NOT NULL))""",
)
def _(spark, folder):
    files = load(spark, folder, "manifest_pages").where("ocr_image is not null").select("book_id", "volume", "ocr_image").distinct()
    return pages.natural_order(files, ["book_id", "volume"], "ocr_image")


@query(
    "w03_representative_pages",
    f"""WITH {EXPECTED}, placed AS (SELECT *, row_number() OVER (PARTITION BY book_id, volume ORDER BY source_page) - 1 AS place, count(*) OVER (PARTITION BY book_id, volume) AS n FROM expected)
        SELECT book_id, volume, source_page FROM placed
        WHERE list_contains(list_transform(range(0, 7), lambda i: CAST(round_even((n - 1) * i / 6.0, 0) AS BIGINT)), place)""",
)
def _(spark, folder):
    return pages.representative(pages.expected_pages(load(spark, folder, "books")), ["book_id", "volume"], "source_page")


@query(
    "w04_front_middle_end",
    f"""WITH {EXPECTED}, placed AS (SELECT *, row_number() OVER (PARTITION BY book_id, volume ORDER BY source_page) - 1 AS place, count(*) OVER (PARTITION BY book_id, volume) AS n FROM expected)
        SELECT book_id, volume, source_page FROM placed WHERE n <= 15 OR place < 7 OR place >= n - 4 OR place BETWEEN (n - 4) // 2 AND (n - 4) // 2 + 3""",
)
def _(spark, folder):
    return pages.front_middle_end(pages.expected_pages(load(spark, folder, "books")), ["book_id", "volume"], "source_page")


# -- ledger ------------------------------------------------------------------------------------------------------


@query(
    "g03_attempts_per_page",
    """SELECT book_id, volume, CAST(regexp_extract(page, '([0-9]+)', 1) AS BIGINT) AS page, count(DISTINCT ledger_id) AS attempts FROM request_ledger
       WHERE event = 'started' AND stage = 'ocr' AND ledger_id IS NOT NULL AND regexp_matches(page, '[0-9]') GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    return ledger.attempts_per_page(load(spark, folder, "request_ledger"))


@query(
    "w09_attempt_pairs",
    """SELECT ledger_id, book_id, volume, page, CASE WHEN finished IS NULL THEN 'lost' WHEN started IS NULL THEN 'orphan' ELSE status END AS outcome, epoch_ms(finished) - epoch_ms(started) AS elapsed_ms FROM (
       SELECT ledger_id, min(book_id) AS book_id, min(volume) AS volume, min(CAST(nullif(regexp_extract(page, '([0-9]+)', 1), '') AS BIGINT)) AS page,
         min(CASE WHEN event = 'started' THEN CAST(ts_utc AS TIMESTAMPTZ) END) AS started, min(CASE WHEN event = 'finished' THEN CAST(ts_utc AS TIMESTAMPTZ) END) AS finished,
         min(CASE WHEN event = 'finished' THEN status END) AS status
       FROM request_ledger WHERE ledger_id IS NOT NULL AND event IN ('started', 'finished') GROUP BY 1)""",
)
def _(spark, folder):
    return ledger.attempt_pairs(load(spark, folder, "request_ledger")).drop("started", "finished")


@query(
    "g06_usage_totals",
    """SELECT book_id, volume, model, count(*) AS attempts, coalesce(sum(prompt), 0.0) AS prompt_tokens, coalesce(sum(completion), 0.0) AS completion_tokens, CAST(sum(unknown) AS BIGINT) AS unknown_billing FROM (
       SELECT ledger_id, min(book_id) AS book_id, min(volume) AS volume, min(model) AS model, max(usage.prompt_tokens) AS prompt, max(usage.completion_tokens) AS completion,
         max(CASE WHEN billing_status = 'unknown' THEN 1 ELSE 0 END) AS unknown
       FROM request_ledger WHERE event = 'finished' AND ledger_id IS NOT NULL GROUP BY 1) GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    return ledger.usage_totals(load(spark, folder, "request_ledger"))


@query(
    "s11_events_once",
    """SELECT ledger_id, event, status, ts_utc, usage.total_tokens AS total_tokens, CAST(len(images) AS INT) AS images, budget_snapshot.requests AS requests FROM (
       SELECT *, row_number() OVER (PARTITION BY ledger_id, event ORDER BY ingested_at) AS k FROM request_ledger WHERE ledger_id IS NOT NULL AND event IS NOT NULL) WHERE k = 1""",
)
def _(spark, folder):
    once = ledger.events_once(load(spark, folder, "request_ledger"))
    counts = [F.col("usage.total_tokens").alias("total_tokens"), F.when(F.col("images").isNotNull(), F.size("images")).alias("images"), F.col("budget_snapshot.requests").alias("requests")]
    return once.select("ledger_id", "event", "status", "ts_utc", *counts)


@query(
    "w11_error_streaks",
    r"""WITH r AS (SELECT *, coalesce(regexp_replace(string_split(error, ' | body[:')[1], '[0-9]+', '#', 'g'), '') AS error_class FROM page_results),
        c AS (SELECT *, CASE WHEN lag(error_class) OVER w = error_class THEN 0 ELSE 1 END AS changed FROM r WINDOW w AS (PARTITION BY book_id, volume, source_page ORDER BY attempt NULLS FIRST, result_id)),
        g AS (SELECT *, sum(changed) OVER (PARTITION BY book_id, volume, source_page ORDER BY attempt NULLS FIRST, result_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
        SELECT book_id, volume, source_page, error_class, max(n) AS streak FROM (SELECT book_id, volume, source_page, error_class, run, count(*) AS n FROM g WHERE error_class <> '' GROUP BY ALL) GROUP BY ALL""",
)
def _(spark, folder):
    return ledger.error_streaks(load(spark, folder, "page_results"))


@query(
    "x01_delivery_delay",
    """SELECT strftime(sent, '%Y-%m-%d') AS day, count(*) AS events, CAST(sum(n - 1) AS BIGINT) AS copies, CAST(sum(CASE WHEN epoch_ms(arrived) - epoch_ms(sent) > 3600000 THEN 1 ELSE 0 END) AS BIGINT) AS late FROM (
       SELECT ledger_id, event, min(CAST(replace(ts_utc, 'Z', '') AS TIMESTAMP)) AS sent, min(ingested_at) AS arrived, count(*) AS n FROM request_ledger WHERE ledger_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, folder):
    return ledger.delivery_delay(load(spark, folder, "request_ledger"))


@query(
    "x04_streamed_event_days",
    "SELECT substr(ts_utc, 1, 10) AS day, event, CAST(count(DISTINCT ledger_id) AS BIGINT) AS n FROM request_ledger WHERE ledger_id IS NOT NULL AND ts_utc IS NOT NULL GROUP BY 1, 2",
)
def _(spark, folder):
    return stream.counted_days(spark, folder)


# -- duplicates and audits ---------------------------------------------------------------------------------------

_PLAIN = """plain AS (SELECT book_id, volume, source_page AS p, t, length(t) AS n FROM (SELECT *, lower(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '[^0-9A-Za-z㐀-鿿]+', '', 'g')) AS t FROM texts) WHERE length(t) >= 80)"""


@query(
    "j07_band_length_bound",
    f"""WITH {TEXTS}, {_PLAIN} SELECT a.book_id, a.volume, a.p AS first, b.p AS duplicate, CAST(a.n AS BIGINT) AS first_chars, CAST(b.n AS BIGINT) AS duplicate_chars FROM plain a
        JOIN plain b ON a.book_id = b.book_id AND a.volume = b.volume AND b.p - a.p BETWEEN 1 AND 64 WHERE CAST(2.0 AS DOUBLE) * least(a.n, b.n) / (a.n + b.n) >= CAST(0.985 AS DOUBLE)""",
)
def _(spark, folder):
    return duplicates.band_pairs(_texts(spark, folder), ["book_id", "volume"], "source_page", "text")


@query(
    "j07_band_multiset_bound",
    f"""WITH {TEXTS}, {_PLAIN}, counts AS (SELECT book_id, volume, p, n, c, count(*) AS k FROM (SELECT *, unnest(list_transform(string_split(t, ''), lambda x: unicode(x) % 128)) AS c FROM plain) GROUP BY ALL),
        pairs AS (SELECT a.book_id, a.volume, a.p AS first, b.p AS duplicate, a.n + b.n AS total, a.t = b.t AS equal FROM plain a
          JOIN plain b ON a.book_id = b.book_id AND a.volume = b.volume AND b.p - a.p BETWEEN 1 AND 64 WHERE CAST(2.0 AS DOUBLE) * least(a.n, b.n) / (a.n + b.n) >= CAST(0.985 AS DOUBLE))
        SELECT p.book_id, p.volume, p.first, p.duplicate, CAST(sum(least(a.k, b.k)) AS BIGINT) AS common, p.equal FROM pairs p
          JOIN counts a ON a.book_id = p.book_id AND a.volume = p.volume AND a.p = p.first JOIN counts b ON b.book_id = p.book_id AND b.volume = p.volume AND b.p = p.duplicate AND b.c = a.c
        GROUP BY p.book_id, p.volume, p.first, p.duplicate, p.equal, p.total HAVING CAST(2.0 AS DOUBLE) * sum(least(a.k, b.k)) / p.total >= CAST(0.985 AS DOUBLE)""",
)
def _(spark, folder):
    return duplicates.bounded_pairs(_texts(spark, folder), ["book_id", "volume"], "source_page", "text")


@query("j07_near_duplicate_pages")
def _(spark, folder):
    return duplicates.near_pairs(_texts(spark, folder), ["book_id", "volume"], "source_page", "text")


#: Runs of pages whose neighbours' lengths allow a similarity, in place of a similarity that SQL has not.
@query(
    "g09_island_summary",
    f"""WITH {TEXTS}, {_PLAIN}, pairs AS (SELECT a.book_id, a.volume, a.p AS first, b.p AS duplicate, CAST(2.0 AS DOUBLE) * least(a.n, b.n) / (a.n + b.n) AS similarity FROM plain a
          JOIN plain b ON a.book_id = b.book_id AND a.volume = b.volume AND b.p - a.p BETWEEN 1 AND 64 WHERE CAST(2.0 AS DOUBLE) * least(a.n, b.n) / (a.n + b.n) >= CAST(0.985 AS DOUBLE)),
        marked AS (SELECT *, CASE WHEN first = lag(first) OVER w + 1 AND duplicate = lag(duplicate) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM pairs WINDOW w AS (PARTITION BY book_id, volume ORDER BY first, duplicate)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY book_id, volume ORDER BY first, duplicate ROWS UNBOUNDED PRECEDING) AS island FROM marked)
        SELECT book_id, volume, min(first) AS first_start, max(first) AS first_end, min(duplicate) AS duplicate_start, max(duplicate) AS duplicate_end, count(*) AS length,
          round_even(min(similarity), 4) AS similarity_min, round_even(max(similarity), 4) AS similarity_max FROM numbered GROUP BY book_id, volume, island""",
)
def _(spark, folder):
    pairs = duplicates.band_pairs(_texts(spark, folder), ["book_id", "volume"], "source_page", "text")
    a, b = F.col("first_chars"), F.col("duplicate_chars")
    return duplicates.islands(pairs.withColumn("similarity", 2.0 * F.least(a, b) / (a + b)), ["book_id", "volume"])


@query("w02_duplicate_islands")
def _(spark, folder):
    return duplicates.islands(duplicates.near_pairs(_texts(spark, folder), ["book_id", "volume"], "source_page", "text"), ["book_id", "volume"])


@query("f02_duplicate_report")
def _(spark, folder):
    return duplicates.duplicate_report(load(spark, folder, "manifest_pages"), _texts(spark, folder), ["book_id", "volume"], "source_page", "archive_sha256", "text")


# -- further checks -----------------------------------------------------------------------------------------------


@query(
    "c08_digest_mismatches",
    """SELECT DISTINCT m.book_id, m.volume, m.source_page, m.text_sha256 FROM manifest_pages m WHERE m.text_sha256 IS NOT NULL AND NOT EXISTS (
       SELECT 1 FROM page_results p WHERE p.book_id = m.book_id AND p.volume = m.volume AND p.source_page = m.source_page AND sha256(p.markdown) = m.text_sha256)""",
)
def _(spark, folder):
    return assembly.digest_mismatches(load(spark, folder, "manifest_pages"), load(spark, folder, "page_results"))


@query("g02_page_form_counts", "SELECT book_id, volume, ocr_state, representation, count(*) AS n FROM manifest_pages GROUP BY ALL")
def _(spark, folder):
    return load(spark, folder, "manifest_pages").groupBy("book_id", "volume", "ocr_state", "representation").agg(F.count("*").alias("n"))


_SHAPES = {name: f"CASE WHEN regexp_matches({name}, '{shape}') THEN {name} END AS {name}" for name, shape in ledger.SHAPES.items()}
_ENUMS = {name: f"CASE WHEN {name} IN ({', '.join(chr(39) + v + chr(39) for v in values)}) THEN {name} END AS {name}" for name, values in ledger.ENUMS.items()}
_DIGESTS = {name: f"CASE WHEN regexp_matches(lower({name}), '^[0-9a-f]{{64}}$') THEN lower({name}) END AS {name}" for name in ledger.DIGESTS}
_NUMBERS = {name: f"CASE WHEN {name} >= 0 AND NOT isinf(CAST({name} AS DOUBLE)) AND NOT isnan(CAST({name} AS DOUBLE)) THEN {name} END AS {name}" for name in ledger.NUMBERS}
_PARTS = [f"CASE WHEN {field} >= 0 AND NOT isinf(CAST({field} AS DOUBLE)) AND NOT isnan(CAST({field} AS DOUBLE)) THEN {field} END AS {name}" for name, field in ledger.PARTS.items()]


@query(
    "clean_events_p14",
    f"""SELECT {', '.join([*_SHAPES.values(), *_ENUMS.values(), *_DIGESTS.values(), *_NUMBERS.values(), *_PARTS])}, stream, CASE WHEN http_status BETWEEN 100 AND 599 THEN http_status END AS http_status, CAST(len(kept) AS BIGINT) AS image_count,
         CASE WHEN kept IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(kept, lambda x: x.bytes)), 0) AS BIGINT) END AS image_bytes
       FROM (SELECT *, list_filter(images[1:1000], lambda x: regexp_matches(lower(x.sha256), '^[0-9a-f]{{64}}$') AND x.mime IN ('image/png', 'image/jpeg', 'image/webp', 'image/heic', 'image/heif') AND x.bytes >= 0) AS kept FROM request_ledger)""",
)
def _(spark, folder):
    return ledger.clean_events(load(spark, folder, "request_ledger"))


from . import audits as _audit_queries  # noqa: E402, F401
from . import texts as _text_queries  # noqa: E402, F401
