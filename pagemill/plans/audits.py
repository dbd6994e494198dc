"""Queries of audits: secrets, paths, markup, references, and what is kept between inventories, ledgers and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, audit, conservation, markup, pages
from ..tables import load
from .catalog import EXPECTED, MARKED, PAGES, TEXTS, lines, marked, query, stripped, texts

PAGE, VOLUME = conservation.PAGE, conservation.VOLUME

_TOKEN = r"(^|[^A-Za-z0-9_])"
_RULES = {
    "private-key": r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github-token": _TOKEN + r"gh[pousr]_[A-Za-z0-9_]{20,}($|[^A-Za-z0-9_])",
    "cloud-access-key": _TOKEN + r"AKIA[0-9A-Z]{16}($|[^A-Za-z0-9_])",
    "sk-token": r"\bsk-(live-|test-)?[A-Za-z0-9_-]{20,}\b",
    "pypi-token": r"\bpypi-[A-Za-z0-9_-]{30,}\b",
    "npm-token": r"\bnpm_[A-Za-z0-9]{30,}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "generic-secret-assignment": audit.RULES["generic-secret-assignment"].replace("(?dim)", "(?im)"),
    "bearer-value": r"(?i)\bBearer[ \t\n\v\f\r]+[A-Za-z0-9._~+/=-]{12,}",
    "mac-home-path": r"/Users/([^/\sefnr]|e([^/\sx]|/)|[fnr][^/\sou])[^/\s]*/",
}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("f01_secret_findings", f"WITH {MARKED} " + " UNION ALL ".join(f"SELECT result_id, '{name}' AS rule FROM texts WHERE regexp_matches(text, '{_quoted(rule)}')" for name, rule in _RULES.items()))
def _(spark, folder):
    return audit.secret_findings(marked(spark, folder), "result_id", "text")


@query("j16_known_names_in_documents", "SELECT DISTINCT doc_id, name FROM documents d JOIN (SELECT DISTINCT name FROM (SELECT unnest(proper_names).seen AS name FROM book_contexts) WHERE length(name) > 0) n ON contains(d.text, n.name)")
def _(spark, folder):
    names = load(spark, folder, "book_contexts").select(F.explode("proper_names.seen").alias("name")).where("name is not null")
    return audit.known_values(load(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", names, "name", least=1).withColumnRenamed("value", "name")


_LIST = lambda values: ", ".join(f"'{v}'" for v in values)
_NAME = r"regexp_extract(lower(path), '([^/]*)$', 1)"
_DENIED = f"""CASE WHEN {_NAME} IN ({_LIST(audit.DENIED_NAMES)}) OR regexp_extract({_NAME}, '.(\\.[^.]*)$', 1) IN ({_LIST(audit.DENIED_ENDINGS)}) THEN 'denied-artifact-path'
  WHEN list_has_any(string_split(lower(path), '/'), [{_LIST(audit.DENIED_PARTS)}]) THEN 'denied-runtime-directory' WHEN ends_with(path, '{audit.DENIED_STATE}') THEN 'denied-artifact-path' END"""
_PATHS = """paths AS (SELECT DISTINCT path FROM (SELECT page_path AS path FROM page_results UNION ALL SELECT archive_image FROM manifest_pages UNION ALL SELECT ocr_image FROM manifest_pages
  UNION ALL SELECT source_pdf.filename FROM books UNION ALL SELECT 'pages/' || page FROM request_ledger) WHERE path IS NOT NULL)"""


@query("p12_denied_paths", f"WITH {_PATHS} SELECT path, {_DENIED} AS rule FROM paths")
def _(spark, folder):
    inventory = load(spark, folder, "manifest_pages")
    paths = (
        load(spark, folder, "page_results").select(F.col("page_path").alias("path"))
        .union(inventory.select("archive_image"))
        .union(inventory.select("ocr_image"))
        .union(load(spark, folder, "books").select("source_pdf.filename"))
        .union(load(spark, folder, "request_ledger").select(F.concat(F.lit("pages/"), "page")))
    )
    return paths.where("path is not null").distinct().select("path", audit.denied_path(F.col("path")).alias("rule"))


#: The images that the ledger knows, each event's once.
_IMAGES = """images AS (SELECT DISTINCT book_id, volume, TRY_CAST(nullif(regexp_extract(page, '([0-9]+)', 1), '') AS INT) AS page, i.sha256 AS sha256, i.mime AS mime, i.bytes AS bytes FROM (SELECT book_id, volume, page, unnest(images) AS i FROM request_ledger))"""


def _images(spark, folder):
    rows = load(spark, folder, "request_ledger").select(*VOLUME, F.nullif(F.regexp_extract("page", "([0-9]+)", 1), F.lit("")).cast("int").alias("page"), F.explode("images").alias("i"))
    return rows.select(*VOLUME, "page", F.col("i.sha256").alias("sha256"), F.col("i.mime").alias("mime"), F.col("i.bytes").alias("bytes")).distinct()


#: Limits that the images of a volume meet.
_MOST, _TOTAL = 900_000, 10_000_000


@query(
    "w08_archive_limits",
    f"""WITH {_IMAGES}, summed AS (SELECT *, sum(coalesce(bytes, 0)) OVER (PARTITION BY book_id, volume ORDER BY page NULLS FIRST, sha256 NULLS FIRST, bytes NULLS FIRST, mime NULLS FIRST ROWS UNBOUNDED PRECEDING) AS so_far FROM images)
        SELECT book_id, volume, page, sha256, bytes, 'archive-size-limit' AS rule FROM summed WHERE bytes > {_MOST} OR so_far > {_TOTAL}""",
)
def _(spark, folder):
    found = audit.size_findings(_images(spark, folder), VOLUME, ["page", "sha256", "bytes", "mime"], "bytes", _MOST, _TOTAL)
    return found.where("rule is not null").select(*VOLUME, "page", "sha256", "bytes", "rule")


# -- markup ------------------------------------------------------------------------------------------------------


@query(
    "t26_markup_references",
    rf"""WITH {MARKED} SELECT DISTINCT result_id, ref, regexp_matches(ref, '^([A-Za-z][A-Za-z0-9+.\-]*:|/)') AS external FROM (SELECT result_id, unnest(regexp_extract_all(text, '!?\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1)) AS ref FROM texts)""",
)
def _(spark, folder):
    return audit.markup_findings(marked(spark, folder), "result_id", "text")


_TAGS = rf"""tags AS (SELECT result_id, unnest(regexp_extract_all(text, '{_quoted(markup._TAG)}', 1)) AS tag FROM texts),
  parts AS (SELECT result_id, lower(regexp_replace(regexp_extract(tag, '^(\S+)', 1), '^.*:', '')) AS element, unnest(list_concat(regexp_extract_all(tag, '{_quoted(markup._ATTRIBUTE)}'), CAST([NULL] AS VARCHAR[]))) AS raw FROM tags),
  attributes AS (SELECT result_id, element, lower(regexp_replace(regexp_extract(raw, '^\s*([^\s=]+)', 1), '^.*:', '')) AS name, trim(regexp_replace(regexp_extract(raw, '(?s)^[^=]*=\s*(.*)$', 1), '^["'']|["'']$', '', 'g')) AS value FROM parts)"""


@query(
    "t26_markup_rules",
    rf"""WITH {MARKED}, {_TAGS} SELECT DISTINCT result_id, 'active-element' AS rule FROM attributes WHERE element IN ('script', 'iframe', 'object', 'embed')
        UNION ALL SELECT DISTINCT result_id, 'event-attribute' FROM attributes WHERE starts_with(name, 'on') UNION ALL SELECT DISTINCT result_id, 'style-attribute' FROM attributes WHERE name = 'style'
        UNION ALL SELECT DISTINCT result_id, 'external-reference' FROM attributes WHERE name IN ('href', 'src', 'poster', 'data') AND regexp_matches(value, '^([A-Za-z][A-Za-z0-9+.\-]*:|/)')
        UNION ALL SELECT DISTINCT result_id, 'css-expression' FROM attributes WHERE name = 'style' AND regexp_matches(value, '(?i)expression\s*\(|javascript\s*:')""",
)
def _(spark, folder):
    return markup.markup_rules(markup.elements(marked(spark, folder), ["result_id"], "text"), ["result_id"])


@query(
    "j12_broken_references",
    rf"""WITH {MARKED}, refs AS (SELECT DISTINCT book_id, volume, 'text/page_' || source_page || '.md' AS base, unnest(regexp_extract_all(text, '!?\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1)) AS reference, source_page FROM texts),
        meant AS (SELECT book_id, volume, base, reference, CASE WHEN starts_with(reference, '../ocr/') THEN substr(reference, 4) ELSE 'text/' || regexp_replace(reference, '#.*$', '') END AS member FROM refs WHERE NOT starts_with(reference, 'https:')),
        members AS (SELECT book_id, volume, 'text/page_' || source_page || '.md' AS member FROM texts UNION SELECT book_id, volume, 'ocr/page_' || source_page || '.png' FROM manifest_pages WHERE ends_with(ocr_image, '.png'))
        SELECT book_id, volume, base, reference, 'broken' AS rule FROM meant m WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.book_id = m.book_id AND x.volume = m.volume AND x.member = m.member)""",
)
def _(spark, folder):
    page = marked(spark, folder)
    file = F.concat(F.lit("text/page_"), F.col("source_page").cast("string"), F.lit(".md"))
    refs = page.select(*VOLUME, file.alias("base"), F.explode(F.regexp_extract_all("text", F.lit(r"!?\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)).alias("reference"))
    scans = load(spark, folder, "manifest_pages").where("ocr_image like '%.png'").select(*VOLUME, F.concat(F.lit("ocr/page_"), F.col("source_page").cast("string"), F.lit(".png")).alias("member"))
    members = texts(spark, folder).select(*VOLUME, file.alias("member")).unionByName(scans)
    return markup.broken_references(refs, members, VOLUME)


_TOC = "toc AS (SELECT book_id, volume, CAST(e.page AS INT) AS ref FROM (SELECT book_id, volume, unnest(table_of_contents) AS e FROM book_contexts) WHERE e.page IS NOT NULL)"
_INCLUDED = "included AS (SELECT book_id, volume, unnest(source_pdf.included_pages) AS source_page FROM books)"


def _included(spark, folder):
    return load(spark, folder, "books").select(*VOLUME, F.explode("source_pdf.included_pages").alias("source_page"))


@query(
    "j11_dangling_entries",
    f"""WITH {TEXTS}, {_TOC}, {_INCLUDED} SELECT DISTINCT t.book_id, t.volume, t.ref, CASE WHEN i.source_page IS NULL THEN 'no-item' ELSE 'no-member' END AS rule FROM toc t
        LEFT JOIN included i ON i.book_id = t.book_id AND i.volume = t.volume AND i.source_page = t.ref LEFT JOIN texts x ON x.book_id = t.book_id AND x.volume = t.volume AND x.source_page = t.ref WHERE i.source_page IS NULL OR x.source_page IS NULL""",
)
def _(spark, folder):
    """Pages of tables of contents that are none of the volume's, or have no text."""
    refs = load(spark, folder, "book_contexts").select(*VOLUME, F.explode("table_of_contents.page").alias("ref")).withColumn("ref", F.col("ref").cast("int"))
    items = _included(spark, folder).select(*VOLUME, F.col("source_page").alias("ref"), F.col("source_page").alias("member"))
    return markup.dangling(refs, items, texts(spark, folder).select(*VOLUME, F.col("source_page").alias("member")), VOLUME)


@query(
    "j09_anchor_violations",
    f"""WITH {_INCLUDED}, anchors AS (SELECT book_id, volume, source_page AS page, result_id AS place FROM page_results),
        counted AS (SELECT book_id, volume, page, count(*) AS n FROM anchors GROUP BY ALL),
        sides AS (SELECT coalesce(i.book_id, c.book_id) AS book_id, coalesce(i.volume, c.volume) AS volume, coalesce(i.source_page, c.page) AS page, CASE WHEN c.n IS NULL THEN 'missing' WHEN i.source_page IS NULL THEN 'extra' WHEN c.n > 1 THEN 'repeated' END AS rule
          FROM included i FULL JOIN counted c ON i.book_id = c.book_id AND i.volume = c.volume AND i.source_page = c.page),
        turned AS (SELECT book_id, volume, page, 'order' AS rule FROM (SELECT *, lag(page) OVER (PARTITION BY book_id, volume ORDER BY place, page) AS before FROM anchors) WHERE before > page)
        SELECT book_id, volume, rule, array_to_string(list_sort(list(DISTINCT page))[1:20], ',') AS pages FROM (SELECT * FROM sides WHERE rule IS NOT NULL UNION ALL SELECT * FROM turned) GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    """Results as anchors of the volume's pages, in the order of their ids."""
    anchors = load(spark, folder, "page_results").select(*VOLUME, F.col("source_page").alias("page"), F.col("result_id").alias("place"))
    found = markup.anchor_violations(_included(spark, folder).withColumnRenamed("source_page", "page"), anchors, VOLUME)
    return found.withColumn("pages", F.array_join("pages", ","))


_KEPT = "kept AS (SELECT DISTINCT book_id, volume, source_page AS page, ocr_sha256 AS sha256 FROM manifest_pages WHERE representation IN ('hybrid', 'image') AND ocr_sha256 IS NOT NULL)"


def _kept(spark, folder):
    return load(spark, folder, "manifest_pages").where("representation in ('hybrid', 'image') and ocr_sha256 is not null").select(*VOLUME, F.col("source_page").alias("page"), F.col("ocr_sha256").alias("sha256")).distinct()


@query(
    "j10_misplaced_images",
    f"""WITH {_KEPT}, {_IMAGES}, docs AS (SELECT book_id, volume, source_page AS page, page_path AS document FROM (SELECT *, row_number() OVER (PARTITION BY book_id, volume, source_page ORDER BY result_id DESC) AS k FROM page_results) WHERE k = 1)
        SELECT k.book_id, k.volume, k.page FROM kept k LEFT JOIN docs d ON d.book_id = k.book_id AND d.volume = k.volume AND d.page = k.page WHERE d.document IS NULL OR NOT EXISTS (
          SELECT 1 FROM images i WHERE i.book_id = k.book_id AND i.volume = k.volume AND i.sha256 = k.sha256 AND TRY_CAST(regexp_extract(d.document, '([0-9]+)', 1) AS INT) = i.page)""",
)
def _(spark, folder):
    """Kept images of pages that the ledger did not send with the page's own document."""
    number = F.nullif(F.regexp_extract("page_path", "([0-9]+)", 1), F.lit("")).cast("int")
    anchors = load(spark, folder, "page_results").select(*VOLUME, F.col("source_page").alias("page"), number.alias("document"), F.col("result_id").alias("place"))
    media = _images(spark, folder).select(*VOLUME, F.col("page").alias("document"), "sha256")
    return markup.misplaced_images(_kept(spark, folder), anchors, media, VOLUME)


@query(
    "u02_media_differences",
    f"""WITH {_KEPT}, {_IMAGES}, e AS (SELECT DISTINCT book_id, volume, sha256 FROM kept), f AS (SELECT DISTINCT book_id, volume, sha256 FROM images), a AS (SELECT book_id, volume, sha256 FROM e UNION SELECT book_id, volume, ocr_sha256 FROM manifest_pages WHERE representation = 'reflow'),
        sides AS (SELECT coalesce(e.book_id, f.book_id) AS book_id, coalesce(e.volume, f.volume) AS volume, coalesce(e.sha256, f.sha256) AS sha256, e.sha256 IS NOT NULL AS wanted, f.sha256 IS NOT NULL AS there FROM e FULL JOIN f ON e.book_id = f.book_id AND e.volume = f.volume AND e.sha256 = f.sha256)
        SELECT s.book_id, s.volume, CASE WHEN wanted AND there THEN 'found' WHEN wanted THEN 'missing' ELSE 'extra' END AS side, count(*) AS n FROM sides s LEFT JOIN a ON a.book_id = s.book_id AND a.volume = s.volume AND a.sha256 = s.sha256 WHERE wanted OR a.sha256 IS NULL GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    reflowed = load(spark, folder, "manifest_pages").where("representation = 'reflow'").select(*VOLUME, F.col("ocr_sha256").alias("sha256"))
    expected = _kept(spark, folder).select(*VOLUME, "sha256")
    return markup.media_differences(expected, _images(spark, folder), expected.union(reflowed), VOLUME)


@query(
    "w07_empty_anchors",
    f"""WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, volume, source_page ORDER BY result_id) AS k FROM page_results) WHERE k = 1)
        SELECT book_id, volume, source_page AS page FROM first WHERE markdown IS NULL OR len(list_filter({lines('markdown')}, lambda x: {stripped('x')} <> '')) = 0""",
)
def _(spark, folder):
    """Pages of the first results of a volume, one after the other, that leave their anchor empty."""
    first = load(spark, folder, "page_results").groupBy(*PAGE).agg(F.min_by("markdown", "result_id").alias("markdown"))
    anchor = F.array(F.struct(F.lit("anchor").alias("kind"), F.lit(0).alias("line")))
    filled = F.filter(T.lines(F.coalesce("markdown", F.lit(""))), lambda x: T.stripped(x) != "")
    content = F.transform(filled, lambda x, i: F.struct(F.when(x.rlike("^# "), "heading").otherwise("content").alias("kind"), (i + 1).alias("line")))
    rows = first.select(*PAGE, F.explode(F.concat(anchor, content)).alias("r"))
    place = F.struct("source_page", "r.line")
    return markup.empty_anchors(rows.select(*VOLUME, place.alias("place"), "r.kind", F.col("source_page").alias("page")), VOLUME)


@query(
    "g14_text_sizes",
    f"WITH {TEXTS}, {_IMAGES} SELECT t.book_id, t.volume, largest, pages, media FROM (SELECT book_id, volume, CAST(max(octet_length(encode(text))) AS BIGINT) AS largest, count(DISTINCT source_page) AS pages FROM texts GROUP BY 1, 2) t LEFT JOIN (SELECT book_id, volume, count(DISTINCT sha256) AS media FROM images GROUP BY 1, 2) i ON i.book_id = t.book_id AND i.volume = t.volume",
)
def _(spark, folder):
    sizes = texts(spark, folder).groupBy(*VOLUME).agg(F.max(F.octet_length("text")).cast("long").alias("largest"), F.count_distinct("source_page").alias("pages"))
    return sizes.join(_images(spark, folder).groupBy(*VOLUME).agg(F.count_distinct("sha256").alias("media")), VOLUME, "left")


# -- inventories, ledgers, caches --------------------------------------------------------------------------------

_COUNTED = "counted AS (SELECT book_id, volume, CAST(regexp_extract(page, '([0-9]+)', 1) AS INT) AS source_page, count(DISTINCT ledger_id) AS n FROM request_ledger WHERE event = 'started' AND stage = 'ocr' AND ledger_id IS NOT NULL AND regexp_matches(page, '[0-9]') GROUP BY 1, 2, 3)"


@query(
    "c06_known_attempts",
    f"""WITH {_COUNTED}, listed AS (SELECT {PAGES}, CAST(max(coalesce(attempts, 0)) AS BIGINT) AS n FROM manifest_pages GROUP BY 1, 2, 3)
        SELECT {PAGES}, greatest(l.n, coalesce(c.n, 0)) AS attempts, coalesce(c.n, 0) AS ledger_attempts, l.n > coalesce(c.n, 0) AS lost FROM listed l LEFT JOIN counted c USING ({PAGES})""",
)
def _(spark, folder):
    return conservation.known_attempts(load(spark, folder, "manifest_pages"), load(spark, folder, "request_ledger"))


@query("j04_last_failures", f"SELECT {PAGES}, error FROM (SELECT *, row_number() OVER (PARTITION BY {PAGES} ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS k FROM page_results WHERE error IS NOT NULL) WHERE k = 1")
def _(spark, folder):
    return conservation.last_failures(load(spark, folder, "page_results"))


@query(
    "j06_matched_covers",
    """WITH named AS (SELECT DISTINCT book_id, volume, source_page, regexp_extract(ocr_image, '([^/]*)$', 1) AS cover_page FROM manifest_pages)
       SELECT c.context_id, c.cover_page, CASE WHEN count(n.source_page) = 1 THEN min(n.source_page) END AS source_page, count(n.source_page) AS matches FROM book_contexts c
       LEFT JOIN named n ON n.book_id = c.book_id AND n.volume = c.volume AND n.cover_page = c.cover_page WHERE c.cover_page IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, folder):
    return conservation.matched_covers(load(spark, folder, "book_contexts"), load(spark, folder, "manifest_pages"))


_STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_CACHE = f"""r AS (SELECT book_id, volume, {_STEM.format('ocr_image')} AS stem, list(DISTINCT ocr_sha256) FILTER (WHERE ocr_sha256 IS NOT NULL) AS ri, list(DISTINCT text_sha256) FILTER (WHERE text_sha256 IS NOT NULL) AS rt FROM manifest_pages WHERE ocr_image IS NOT NULL AND text_sha256 IS NOT NULL GROUP BY 1, 2, 3),
  t AS (SELECT book_id, volume, {_STEM.format('page_path')} AS stem, list(DISTINCT sha256(markdown)) AS tt FROM page_results WHERE markdown <> '' AND page_path IS NOT NULL GROUP BY 1, 2, 3),
  i AS (SELECT book_id, volume, {_STEM.format('page')} AS stem, list(DISTINCT page_sha256) FILTER (WHERE page_sha256 IS NOT NULL) AS ii FROM request_ledger WHERE page IS NOT NULL AND page_sha256 IS NOT NULL GROUP BY 1, 2, 3),
  sides AS (SELECT book_id, volume, stem, ri, rt, tt, ii FROM r FULL JOIN t USING (book_id, volume, stem) FULL JOIN i USING (book_id, volume, stem) WHERE rt IS NOT NULL OR tt IS NOT NULL)"""


@query(
    "j08_cache_mismatches",
    f"""WITH {_CACHE} SELECT book_id, volume, stem, 'no-record' AS rule FROM sides WHERE rt IS NULL UNION ALL SELECT book_id, volume, stem, 'no-text' FROM sides WHERE tt IS NULL UNION ALL SELECT book_id, volume, stem, 'no-image' FROM sides WHERE ii IS NULL
        UNION ALL SELECT book_id, volume, stem, 'text-changed' FROM sides WHERE NOT list_has_any(rt, tt) UNION ALL SELECT book_id, volume, stem, 'image-changed' FROM sides WHERE NOT list_has_any(ri, ii)""",
)
def _(spark, folder):
    s = conservation.stem
    records = load(spark, folder, "manifest_pages").where("ocr_image is not null and text_sha256 is not null").select(*VOLUME, s("ocr_image").alias("stem"), F.col("ocr_sha256").alias("image_sha256"), "text_sha256")
    found = load(spark, folder, "page_results").where("markdown <> '' and page_path is not null").select(*VOLUME, s("page_path").alias("stem"), F.sha2("markdown", 256).alias("text_sha256"))
    images = load(spark, folder, "request_ledger").where("page is not null and page_sha256 is not null").select(*VOLUME, s("page").alias("stem"), F.col("page_sha256").alias("image_sha256"))
    return conservation.cache_mismatches(records, found, images, VOLUME)


@query("u06_unknown_results", f"SELECT DISTINCT {PAGES} FROM page_results p WHERE NOT EXISTS (SELECT 1 FROM manifest_pages m WHERE m.book_id = p.book_id AND m.volume = p.volume AND m.source_page = p.source_page AND m.text_sha256 = sha256(p.markdown))")
def _(spark, folder):
    """Pages with a result whose text the inventory does not refer to."""
    results = load(spark, folder, "page_results").select(*PAGE, F.sha2("markdown", 256).alias("text_sha256"))
    orphans = results.join(load(spark, folder, "manifest_pages").select(*PAGE, "text_sha256").distinct(), [*PAGE, "text_sha256"], "left_anti")
    return orphans.select(*PAGE).distinct()


@query(
    "s08_pending_pages",
    f"""WITH {TEXTS}, files AS (SELECT DISTINCT {PAGES}, ocr_image FROM manifest_pages m WHERE ocr_image IS NOT NULL AND NOT EXISTS (SELECT 1 FROM texts t WHERE t.book_id = m.book_id AND t.volume = m.volume AND t.source_page = m.source_page))
        SELECT book_id, volume, ocr_image, CAST(row_number() OVER (PARTITION BY book_id, volume ORDER BY list_transform(regexp_extract_all({_STEM.format('ocr_image')}, '(\\d+)', 1), lambda x: CAST(x AS BIGINT)), {_STEM.format('ocr_image')}, ocr_image) AS INT) AS place FROM files""",
)
def _(spark, folder):
    """Images without a text, in natural order."""
    files = load(spark, folder, "manifest_pages").where("ocr_image is not null").join(texts(spark, folder).select(*PAGE), PAGE, "left_anti").select(*VOLUME, "ocr_image").distinct()
    return pages.natural_order(files, VOLUME, "ocr_image")


@query("o03_first_pending", f"WITH {TEXTS} SELECT DISTINCT {PAGES} FROM manifest_pages m WHERE NOT EXISTS (SELECT 1 FROM texts t WHERE t.book_id = m.book_id AND t.volume = m.volume AND t.source_page = m.source_page) ORDER BY {PAGES} LIMIT 20")
def _(spark, folder):
    """A report of the first pages that have no text yet."""
    return pages.first_rows(conservation.without(load(spark, folder, "manifest_pages"), texts(spark, folder), PAGE), PAGE, 20)


@query("s28_repeated_stems", f"SELECT book_id, volume, {_STEM.format('path')} AS stem, count(*) AS n FROM (SELECT DISTINCT book_id, volume, ocr_image AS path FROM manifest_pages UNION SELECT DISTINCT book_id, volume, archive_image FROM manifest_pages) WHERE path IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(spark, folder):
    inventory = load(spark, folder, "manifest_pages")
    both = inventory.select(*VOLUME, F.col("ocr_image").alias("path")).unionByName(inventory.select(*VOLUME, F.col("archive_image").alias("path")))
    return conservation.repeated_stems(both, VOLUME, "path")


@query(
    "j17_matched_stems",
    f"""WITH p AS (SELECT DISTINCT book_id, volume, {_STEM.format('page_path')} AS stem FROM page_results WHERE page_path IS NOT NULL), i AS (SELECT book_id, volume, {_STEM.format('archive_image')} AS stem, count(DISTINCT archive_image) AS n FROM manifest_pages WHERE archive_image IS NOT NULL GROUP BY 1, 2, 3)
        SELECT book_id, volume, stem, CAST(coalesce(n, 0) AS BIGINT) AS images FROM p LEFT JOIN i USING (book_id, volume, stem)""",
)
def _(spark, folder):
    found = load(spark, folder, "page_results").where("page_path is not null").select(*VOLUME, F.col("page_path").alias("path"))
    images = load(spark, folder, "manifest_pages").where("archive_image is not null").select(*VOLUME, F.col("archive_image").alias("path"))
    return conservation.matched_stems(found, images, VOLUME)


#: The images of the ledger as a listing of embedded ones; lines of other shapes stand between.
_LISTED = f"""{_IMAGES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id, volume ORDER BY page NULLS FIRST, sha256 NULLS FIRST, bytes NULLS FIRST, mime NULLS FIRST) - 1 AS number FROM images)"""


def _listing(spark, folder):
    number = F.row_number().over(Window.partitionBy(*VOLUME).orderBy("page", "sha256", "bytes", "mime")) - 1
    rows = _images(spark, folder).withColumn("number", number)
    line = F.concat(F.lit("  "), F.col("page").cast("string"), F.lit("   "), F.col("number").cast("string"), F.lit("  Image 100 200 gray 1 8 "), F.upper(F.regexp_extract("mime", r"/(.*)$", 1)), F.lit(" no"))
    return rows.select(*VOLUME, F.explode(F.array(line, F.lit("page num type"), F.lit("-----"), F.concat(F.col("page").cast("string"), F.lit(" x image")))).alias("line"))


@query("s13_listed_images", f"WITH {_LISTED} SELECT book_id, volume, page, CAST(number AS INT) AS number, 'image' AS kind, lower(regexp_extract(mime, '/(.*)$', 1)) AS encoding FROM ranked WHERE page IS NOT NULL AND mime IS NOT NULL")
def _(spark, folder):
    return conservation.listed_images(_listing(spark, folder), "line")


@query(
    "g12_import_plans",
    f"""WITH {_INCLUDED}, {_LISTED}, per AS (SELECT book_id, volume, page AS source_page, count(*) AS n, min(lower(regexp_extract(mime, '/(.*)$', 1))) AS encoding FROM ranked WHERE page IS NOT NULL AND mime IS NOT NULL GROUP BY 1, 2, 3),
        j AS (SELECT DISTINCT i.book_id, i.volume, i.source_page, coalesce(p.n = 1, false) AS simple, p.encoding FROM included i LEFT JOIN per p USING ({PAGES})),
        s AS (SELECT book_id, volume, avg(CAST(simple AS DOUBLE)) AS share FROM j GROUP BY 1, 2), u AS (SELECT DISTINCT book_id, volume, true AS odd FROM per p WHERE NOT EXISTS (SELECT 1 FROM included i WHERE i.book_id = p.book_id AND i.volume = p.volume AND i.source_page = p.source_page))
        SELECT j.book_id, j.volume, j.source_page AS page, CASE WHEN share < 0.8 OR coalesce(odd, false) THEN 'whole' WHEN NOT simple THEN 'render' WHEN encoding = 'jpeg' THEN 'jpeg' ELSE 'png' END AS plan FROM j JOIN s USING (book_id, volume) LEFT JOIN u USING (book_id, volume)""",
)
def _(spark, folder):
    every = _included(spark, folder).withColumnRenamed("source_page", "page")
    return conservation.import_plans(every, conservation.listed_images(_listing(spark, folder), "line"), VOLUME)


_KINDS = f"""kinds AS (SELECT {PAGES}, CASE representation WHEN 'reflow' THEN 'text' WHEN 'hybrid' THEN 'complex_table' ELSE 'failed' END AS page_type,
  CASE WHEN representation IN ('reflow', 'hybrid') THEN 'ok' WHEN ocr_state = 'blank' THEN 'blank' ELSE 'failed' END AS ocr_status FROM manifest_pages)"""


@query(
    "c03_book_page_violations",
    f"""WITH {TEXTS}, {EXPECTED}, {_KINDS}, joined AS (SELECT k.*, {stripped("coalesce(t.text, '')")} AS body, count(*) OVER (PARTITION BY k.book_id, k.volume, k.source_page) AS n FROM kinds k LEFT JOIN texts t USING ({PAGES})),
        judged AS (SELECT *, body IN ('', '{T.BLANK_PAGE}') OR starts_with(body, '{T.FAILED_PAGE}') AS dead FROM joined)
        SELECT {PAGES}, 'twice' AS rule FROM judged WHERE n > 1 UNION ALL SELECT {PAGES}, 'no-text' FROM judged WHERE ocr_status = 'ok' AND dead UNION ALL SELECT {PAGES}, 'unwanted-text' FROM judged WHERE ocr_status <> 'ok' AND NOT dead
        UNION ALL SELECT *, 'missing' FROM (SELECT {PAGES} FROM expected EXCEPT SELECT {PAGES} FROM kinds) UNION ALL SELECT *, 'extra' FROM (SELECT {PAGES} FROM kinds EXCEPT SELECT {PAGES} FROM expected)""",
)
def _(spark, folder):
    kinds = conservation.page_kinds(load(spark, folder, "manifest_pages")).join(texts(spark, folder).select(*PAGE, "text"), PAGE, "left")
    return conservation.book_page_violations(kinds, pages.expected_pages(load(spark, folder, "books")))


@query(
    "g13_book_counts",
    f"""WITH {_KINDS} SELECT book_id, volume, count(*) AS source_pages, count(*) FILTER (WHERE ocr_status = 'ok') AS ocr_pages, count(*) FILTER (WHERE page_type IN ('chart', 'complex_table', 'failed', 'review') OR ocr_status <> 'ok') AS image_pages,
        count(*) FILTER (WHERE ocr_status IN ('failed', 'missing')) AS failed_pages, count(*) FILTER (WHERE page_type = 'review') AS review_pages FROM kinds GROUP BY 1, 2""",
)
def _(spark, folder):
    return conservation.book_counts(conservation.page_kinds(load(spark, folder, "manifest_pages")))


@query(
    "g05_batch_summary",
    """SELECT scan_site, lang, count(*) AS results, count(*) FILTER (WHERE error IS NULL AND NOT coalesce(is_blank, false) AND NOT coalesce(is_dead, false)) AS ok, count(*) FILTER (WHERE error IS NULL AND coalesce(is_blank, false)) AS blank, count(*) FILTER (WHERE coalesce(is_dead, false)) AS dead,
       count(*) FILTER (WHERE error IS NOT NULL AND NOT coalesce(is_dead, false)) AS failed, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, bool_or(coalesce(billing_unknown, false)) AS unknown_billing FROM page_results GROUP BY 1, 2""",
)
def _(spark, folder):
    return conservation.batch_summary(load(spark, folder, "page_results"), ["scan_site", "lang"])


@query(
    "p20_unbound_contexts",
    """WITH x AS (SELECT context_id, book_id, volume, '_context_model' AS field, _context_model AS value FROM book_contexts UNION ALL SELECT context_id, book_id, volume, '_context_prompt_sha256', _context_prompt_sha256 FROM book_contexts)
       SELECT context_id, field FROM x WHERE NOT EXISTS (SELECT 1 FROM request_ledger r WHERE r.book_id = x.book_id AND r.volume = x.volume AND (x.field = '_context_model' AND r.model = x.value OR x.field = '_context_prompt_sha256' AND r.prompt_sha256 = x.value))""",
)
def _(spark, folder):
    used = load(spark, folder, "request_ledger").select(*VOLUME, F.col("model").alias("_context_model"), F.col("prompt_sha256").alias("_context_prompt_sha256")).distinct()
    return conservation.unbound_contexts(load(spark, folder, "book_contexts"), used, ["_context_model", "_context_prompt_sha256"])


@query(
    "f08_reconciled_states",
    f"""WITH {TEXTS}, failures AS (SELECT {PAGES}, error FROM (SELECT *, row_number() OVER (PARTITION BY {PAGES} ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS k FROM page_results WHERE error IS NOT NULL) WHERE k = 1),
        j AS (SELECT m.{PAGES.replace(', ', ', m.')}, ocr_state, representation, error, t.text, {stripped("coalesce(t.text, '')")} AS body FROM manifest_pages m LEFT JOIN texts t USING ({PAGES}) LEFT JOIN failures f USING ({PAGES})),
        s AS (SELECT *, CASE WHEN body = '{T.BLANK_PAGE}' THEN 'blank' WHEN starts_with(body, '{T.FAILED_PAGE}') THEN 'failed' WHEN body <> '' THEN 'ok' WHEN contains(error, 'unsupported') THEN 'unsupported' WHEN contains(error, 'timeout') OR contains(error, 'network') THEN 'ambiguous' WHEN error IS NOT NULL THEN 'failed' ELSE ocr_state END AS state FROM j)
        SELECT {PAGES}, state, CASE WHEN state = 'ok' THEN CASE WHEN body <> '' AND list_contains(list_transform({lines('body')}, lambda x: {stripped('x')}), '{T.MARKER}') THEN 'hybrid' WHEN body <> '' THEN 'reflow' ELSE representation END
          WHEN state = 'pending' THEN 'pending' WHEN state IS NULL THEN representation ELSE 'image' END AS form FROM s""",
)
def _(spark, folder):
    return conservation.reconciled_states(load(spark, folder, "manifest_pages"), texts(spark, folder), conservation.last_failures(load(spark, folder, "page_results")))


# -- contexts and responses --------------------------------------------------------------------------------------


def _line(x: str, limit: int) -> str:
    return f"length({x}) BETWEEN 1 AND {limit} AND NOT regexp_matches({x}, '[\\p{{Cc}}\\x{{2028}}\\x{{2029}}]')"


_CONTEXT_RULES = {
    **{f"field-{name}": f"NOT ({_line(name, limit)})" for name, limit in audit.FIELD_LIMITS.items()},
    "cover-name": r"regexp_matches(cover_page, '[/\\]|\.\.')",
    "content": "NOT coalesce(content_type IN ('verse', 'prose', 'mixed'), false)",
    **{f"array-{name}": f"len({name}) > {most} OR len(list_filter({name}, lambda x: NOT coalesce({_line('x', longest)}, false))) > 0" for name, (most, longest) in audit.ARRAY_LIMITS.items()},
    "toc": f"len(table_of_contents) > 80 OR len(list_filter(table_of_contents, lambda x: NOT coalesce({_line('x.title', 120)} AND x.page BETWEEN 1 AND 1000000, false))) > 0",
    "names": f"len(proper_names) > 40 OR len(list_filter(proper_names, lambda x: NOT coalesce({_line('x.seen', 80)} AND x.canonical = x.seen, false))) > 0",
    "layout": "NOT coalesce(supported_layout, false)",
    "pages-per-image": "NOT coalesce(pages_per_image IN (1, 2), false)",
    "spread-order": "pages_per_image = 2 AND NOT coalesce(spread_order = 'left-to-right', false) OR pages_per_image = 1 AND NOT coalesce(spread_order = 'not-applicable', false)",
}


@query("c05_context_violations", " UNION ALL ".join(f"SELECT context_id, '{name}' AS rule FROM book_contexts WHERE {rule}" for name, rule in _CONTEXT_RULES.items()))
def _(spark, folder):
    return audit.context_violations(load(spark, folder, "book_contexts"))


#: Fields of a context besides the keys of its row.
_ALLOWED = ["title", "author", "translator", "publisher", "pub_year", "supported_layout", "unsupported_reason", "pages_per_image", "spread_order", "cover_page", "content_type", "table_of_contents", "proper_names", "terminology", "layout_notes", "footnote_convention", "ocr_pitfalls", "_generated_by", "lang", "_source_scan_sha256", "_context_model", "_context_prompt_sha256"]


@query(
    "u07_unknown_fields",
    " UNION ALL ".join(f"SELECT context_id, '{c}' AS field FROM book_contexts WHERE {c} IS NOT NULL" for c in ("context_id", "book_id", "volume", "created_at")),
)
def _(spark, folder):
    contexts = load(spark, folder, "book_contexts")
    raw = contexts.select("context_id", F.to_json(F.struct(*contexts.columns)).alias("raw"))
    return audit.unknown_fields(raw, "context_id", "raw", _ALLOWED)


@query("t20_context_blocks")
def _(spark, folder):
    contexts = load(spark, folder, "book_contexts")
    return contexts.select("context_id", assembly.context_block(contexts).alias("block"))


@query("s20_parsed_responses", "SELECT result_id, markdown || '!' AS text, 'stop' AS finish_reason, CAST(length(page_path) AS BIGINT) AS reasoning_length FROM page_results WHERE markdown IS NOT NULL")
def _(spark, folder):
    """Results as a provider sends them, in parts and within a fence, read again."""
    part = lambda c: F.struct(c.alias("text"))
    content = F.array(part(F.col("markdown")), part(F.lit(None).cast("string")), part(F.lit("!")))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content"), F.col("page_path").alias("reasoning")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices")))
    sent = load(spark, folder, "page_results").where("markdown is not null").select("result_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"))
    read = sent.select("result_id", T.response_content(T.json_body(F.col("raw"))).alias("r"))
    return read.select("result_id", "r.text", "r.finish_reason", "r.reasoning_length")


@query("t18_redacted_errors", "SELECT result_id, substr(replace(error || ' for ' || book_id, book_id, '[REDACTED]'), 1, 30) AS message FROM page_results WHERE error IS NOT NULL")
def _(spark, folder):
    failed = load(spark, folder, "page_results").where("error is not null")
    return failed.select("result_id", T.redacted(F.concat("error", F.lit(" for "), "book_id"), F.col("book_id"), 30).alias("message"))


@query("t15_unsupported_layouts")
def _(spark, folder):
    """Whether a text asks not to be read; the texts of results with an unsupported layout get the marker, in full width."""
    results = load(spark, folder, "page_results")
    said = F.when(F.coalesce("is_unsupported_zh", F.lit(False)), F.lit("［［Scan2Ebook_Unsupported_ZH_Layout］］")).otherwise(F.col("markdown"))
    return results.select("result_id", T.unsupported_layout(said).alias("unsupported"))


@query(
    "t23_page_files",
    f"SELECT DISTINCT {PAGES}, 'page_' || lpad(CAST(source_page AS VARCHAR), CAST(greatest(6, length(CAST(source_page AS VARCHAR))) AS INT), '0') || '.md' AS file, CASE WHEN regexp_matches(lower(ocr_image), '\\.jpe?g$') THEN 'image/jpeg' WHEN ends_with(lower(ocr_image), '.webp') THEN 'image/webp' ELSE 'image/png' END AS mime FROM manifest_pages WHERE source_page IS NOT NULL AND ocr_image IS NOT NULL",
)
def _(spark, folder):
    rows = load(spark, folder, "manifest_pages").where("source_page is not null and ocr_image is not null")
    return rows.select(*PAGE, T.page_file(F.col("source_page")).alias("file"), T.mime_type(F.col("ocr_image")).alias("mime")).distinct()


@query("f03_book_audit")
def _(spark, folder):
    """All findings on the volumes as (book_id, volume, rule, n): anchors, images, texts and markup."""
    marked_up = marked(spark, folder)
    rules = markup.markup_rules(markup.elements(marked_up, [*VOLUME, "result_id"], "text"), [*VOLUME, "result_id"])
    secrets = audit.secret_findings(marked_up.withColumn("key", F.struct(*VOLUME, "result_id")), "key", "text").select("key.*", "rule")
    anchors = load(spark, folder, "page_results").select(*VOLUME, F.col("source_page").alias("page"), F.col("result_id").alias("place"))
    kept = markup.anchor_violations(_included(spark, folder).withColumnRenamed("source_page", "page"), anchors, VOLUME)
    counted = rules.unionByName(secrets).groupBy(*VOLUME, "rule").agg(F.count("*").alias("n"))
    media = markup.media_differences(_kept(spark, folder).select(*VOLUME, "sha256"), _images(spark, folder), _images(spark, folder), VOLUME).where("side <> 'found'")
    return (
        counted.unionByName(kept.select(*VOLUME, F.concat(F.lit("anchor-"), "rule").alias("rule"), F.size("pages").cast("long").alias("n")))
        .unionByName(media.select(*VOLUME, F.concat(F.lit("image-"), "side").alias("rule"), "n"))
    )
