"""Queries on page texts: cleaning, code, footnotes, headings, navigation, corrections, books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly
from ..tables import load
from .catalog import FOLD, MARKED, NOTES, PAGES, TEXTS, S, changed_lines, lines, marked, query, stripped, texts

PAGE = assembly.PAGE

CANDIDATES = rf"""lined AS (SELECT {PAGES}, text, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS line FROM (SELECT *, {lines('text')} AS l FROM texts)),
  titled AS (SELECT *, nullif({stripped("regexp_extract(" + stripped('raw') + ", '^#{1,6}([^#].*)$', 1)")}, '') AS title FROM lined),
  found AS (SELECT *, count(*) OVER (PARTITION BY {PAGES}) AS n FROM titled
    WHERE regexp_matches({stripped("regexp_replace(" + stripped('title') + ", '^#+|#+$', '', 'g')")}, '^(第[{T.NUMERALS}]+[章节篇卷部].*|({T.NAMED})([{S}].*)?)$')),
  candidates AS (SELECT {PAGES}, CAST(line AS BIGINT) AS line, title, CAST(length(regexp_replace(text, '[{S}]+', '', 'g')) AS BIGINT) AS body_chars,
    CASE WHEN n >= 2 THEN 'toc-suspect' ELSE 'candidate' END AS status FROM found)"""


@query("t01_plain_text", "SELECT doc_id, lower(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '[^0-9A-Za-z㐀-鿿]+', '', 'g')) AS plain FROM documents")
def _(spark, folder):
    return load(spark, folder, "documents").select("doc_id", T.plain(F.col("text")).alias("plain"))


def _sanitized_sql() -> str:
    value = f"regexp_replace(text, '(?i)<[{S}]*br[{S}]*/?[{S}]*>', '  ' || chr(10), 'g')"
    for tag in ("script", "style", "iframe", "object", "embed"):
        value = rf"regexp_replace({value}, '(?is)<[{S}]*{tag}\b[^>]*>.*?<[{S}]*/[{S}]*{tag}[{S}]*>', '', 'g')"
    value = rf"regexp_replace({value}, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g')"
    value = rf"regexp_replace({value}, '\[([^\]]+)\]\([^)]*\)', '\1', 'g')"
    value = rf"regexp_replace({value}, '(?m)^[{S}]*\[[^\]\^][^\]]*\]:[{S}]*[^{S}]+.*$', '', 'g')"
    value = rf"regexp_replace({value}, '(?m)^[{S}]*:{{3,}}.*$', '', 'g')"
    value = rf"regexp_replace(regexp_replace({value}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')"
    joined = f"array_to_string(list_transform({lines('value')}, lambda x: regexp_replace(x, '\\t+$', '')), chr(10))"
    return f"WITH {MARKED} SELECT {PAGES}, {stripped(joined)} AS text FROM (SELECT {PAGES}, replace({value}, chr(0), '') AS value FROM texts)"


@query("t02_sanitized_pages", _sanitized_sql())
def _(spark, folder):
    return marked(spark, folder).select(*PAGE, T.sanitized(F.col("text")).alias("text"))


@query("t02_sanitized_results")
def _(spark, folder):
    return load(spark, folder, "page_results").select("result_id", T.sanitized(F.col("markdown")).alias("markdown"))


_FENCED = "CASE WHEN source_page < 3 THEN text ELSE '```markdown' || chr(10) || text || chr(10) || '```' || chr(10) || 'gone' END"


@query(
    "t03_without_outer_fence",
    rf"""WITH {TEXTS}, fenced AS (SELECT {PAGES}, {_FENCED} AS text FROM texts), split AS (SELECT *, {lines('text')} AS l FROM fenced),
      ends AS (SELECT *, list_max(list_transform(range(2, len(l) + 1), lambda i: CASE WHEN regexp_matches(l[i], '^```[{S}]*$') THEN i END)) AS last FROM split)
      SELECT {PAGES}, CASE WHEN regexp_matches(l[1], '^```(markdown|md)?[{S}]*$') THEN array_to_string(l[2:coalesce(last - 1, len(l))], chr(10)) ELSE text END AS text FROM ends""",
)
def _(spark, folder):
    """Texts in a fence, with words behind it; the first pages of a volume have none."""
    fenced = F.when(F.col("source_page") < 3, F.col("text")).otherwise(F.concat(F.lit("```markdown\n"), F.col("text"), F.lit("\n```\ngone")))
    return texts(spark, folder).select(*PAGE, T.without_outer_fence(fenced).alias("text"))


@query("w06_code_lines", f"WITH RECURSIVE {MARKED}, {FOLD} SELECT t.{PAGES.replace(', ', ', t.')}, CAST(n AS BIGINT) AS code_lines FROM texts t JOIN (SELECT result_id, count(*) FILTER (WHERE code) AS n FROM fold GROUP BY 1) f ON t.result_id = f.result_id")
def _(spark, folder):
    code = F.size(F.filter(T.code_lines(F.col("text")), lambda x: x)).cast("long")
    return marked(spark, folder).select(*PAGE, code.alias("code_lines"))


@query("w01_footnote_offsets", f"WITH RECURSIVE {MARKED}, {FOLD}, {NOTES} SELECT {PAGES}, highest, shift FROM shifts")
def _(spark, folder):
    return assembly.footnote_offsets(marked(spark, folder))


_MOVED = r"""array_to_string(list_transform(string_split(line, '[^'), lambda p, i: CASE WHEN i > 1 AND regexp_matches(p, '^[0-9]+\]') AND TRY_CAST(regexp_extract(p, '^([0-9]+)\]', 1) AS BIGINT) IS NOT NULL
  THEN CAST(TRY_CAST(regexp_extract(p, '^([0-9]+)\]', 1) AS BIGINT) + s.shift AS VARCHAR) || substr(p, position(']' IN p)) ELSE p END), '[^')"""


@query("t04_renumbered_notes", changed_lines(_MOVED, f", {NOTES}"))
def _(spark, folder):
    return assembly.renumbered_pages(marked(spark, folder))


_DEFINED = rf"^([{S}]*)\[\^([0-9]+)\]:[{S}]?(.*)$"
_ORPHANS = rf"""used AS (SELECT DISTINCT result_id, TRY_CAST(n AS BIGINT) AS n FROM (SELECT result_id, unnest(regexp_extract_all(line, '\[\^([0-9]+)\]', 1)) AS n FROM fold WHERE NOT code AND NOT regexp_matches(line, '{_DEFINED}'))),
  defined AS (SELECT result_id, pos, line, code, CASE WHEN NOT code THEN TRY_CAST(nullif(regexp_extract(line, '{_DEFINED}', 2), '') AS BIGINT) END AS n FROM fold),
  orphans AS (SELECT d.result_id, d.pos, d.n FROM defined d WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM used u WHERE u.result_id = d.result_id AND u.n = d.n))"""


@query("t05_orphan_notes", f"WITH RECURSIVE {MARKED}, {FOLD}, {_ORPHANS} SELECT DISTINCT t.{PAGES.replace(', ', ', t.')}, o.n AS note FROM orphans o JOIN texts t ON t.result_id = o.result_id")
def _(spark, folder):
    return marked(spark, folder).select(*PAGE, F.explode(T.orphan_notes(F.col("text"))).alias("note"))


_LABEL = "CASE WHEN regexp_matches(lower(coalesce(nullif(trim(t.lang), ''), 'vi')), '^(zh|ja)') THEN '脚注 ' || o.n || '：' ELSE 'Chú thích ' || o.n || ':' END"
_SHOWN = f"regexp_replace(regexp_extract(d.line, '{_DEFINED}', 1) || {_LABEL} || ' ' || regexp_extract(d.line, '{_DEFINED}', 3), '[{S}]+$', '')"


@query(
    "t05_shown_orphans",
    f"""WITH RECURSIVE {MARKED}, {FOLD}, {_ORPHANS} SELECT t.{PAGES.replace(', ', ', t.')}, string_agg(CASE WHEN o.n IS NOT NULL THEN {_SHOWN} ELSE d.line END, chr(10) ORDER BY d.pos) AS text
        FROM defined d JOIN texts t ON t.result_id = d.result_id LEFT JOIN orphans o ON o.result_id = d.result_id AND o.pos = d.pos GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    return marked(spark, folder).select(*PAGE, T.shown_orphans(F.col("text"), F.col("lang")).alias("text"))


def _spaced(x: str) -> str:
    return rf"regexp_replace({x}, '^(#{{1,6}})([^#{S}])', '\1 \2')"


def _dashed(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^[{S}]*-([{S}]*-){{2,}}[{S}]*$') THEN '* * *' ELSE {x} END"


@query("t06_normalized_pages", changed_lines(_dashed(_spaced("line"))))
def _(spark, folder):
    return marked(spark, folder).select(*PAGE, T.normalized_lines(F.col("text")).alias("text"))


_HEAD = T.heading_pattern(S, r"\p{Nd}").replace("'", "''")


def _chapter(x: str) -> str:
    return f"(length({stripped(x)}) <= {T.LONGEST} AND regexp_matches({stripped(x)}, '{_HEAD}'))"


_TIDY = _spaced(stripped("line"))
_INNER = stripped(f"substr({_TIDY}, 4)")
_UPGRADED = f"""CASE WHEN starts_with({_TIDY}, '## ') AND {_chapter(_INNER)} THEN '# ' || {_INNER} WHEN starts_with({_TIDY}, '# ') OR starts_with({_TIDY}, '## ') THEN {_TIDY}
  WHEN {_chapter(_TIDY)} THEN '# ' || {_TIDY} ELSE line END"""


@query("t09_chapter_headings", changed_lines(_UPGRADED))
def _(spark, folder):
    return marked(spark, folder).select(*PAGE, T.chapter_headings(F.col("text")).alias("text"))


@query(
    "t08_chapter_lines",
    f"WITH {MARKED} SELECT {PAGES}, CAST(len(list_filter({lines('text')}, lambda x: {_chapter('x')})) AS BIGINT) AS chapter_lines FROM texts",
)
def _(spark, folder):
    found = F.size(F.filter(T.lines(F.col("text")), T.is_chapter_heading)).cast("long")
    return marked(spark, folder).select(*PAGE, found.alias("chapter_lines"))


@query("s22_book_pages")
def _(spark, folder):
    return assembly.book_pages(marked(spark, folder)).select(*PAGE, assembly.anchored(F.col("text"), F.col("source_page")).alias("text"))


@query(
    "image_marker_pages_p05",
    f"SELECT result_id, len(list_filter({lines('markdown')}, lambda x: {stripped('x')} = '{T.MARKER}')) > 0 AS wants_image FROM page_results WHERE markdown IS NOT NULL UNION ALL SELECT result_id, NULL FROM page_results WHERE markdown IS NULL",
)
def _(spark, folder):
    return load(spark, folder, "page_results").select("result_id", T.wants_image(F.col("markdown")).alias("wants_image"))


@query(
    "unmarked_pages_p06",
    f"SELECT result_id, {stripped(f'array_to_string(list_filter({lines('markdown')}, lambda x: {stripped('x')} <> {chr(39)}{T.MARKER}{chr(39)}), chr(10))')} AS markdown FROM page_results WHERE markdown IS NOT NULL",
)
def _(spark, folder):
    return load(spark, folder, "page_results").where("markdown is not null").select("result_id", T.without_marker(F.col("markdown")).alias("markdown"))


@query(
    "t14_language_tags",
    """SELECT tag, count(*) AS n FROM (SELECT CASE WHEN lower(parts[1]) = 'zh' THEN array_to_string(list_concat(['zh'], list_transform(parts[2:], lambda p:
         CASE WHEN lower(p) IN ('hans', 'hant') THEN upper(lower(p)[1]) || lower(p)[2:] WHEN regexp_matches(lower(p), '^([a-z]{2}|[0-9]{3})$') THEN upper(p) ELSE lower(p) END)), '-') ELSE raw END AS tag
       FROM (SELECT raw, string_split(replace(raw, '_', '-'), '-') AS parts FROM (SELECT coalesce(nullif(trim(lang), ''), 'vi') AS raw FROM documents))) GROUP BY 1""",
)
def _(spark, folder):
    return load(spark, folder, "documents").select(T.language_tag(F.col("lang")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("t11_heading_candidates", f"WITH {TEXTS}, {CANDIDATES} SELECT * FROM candidates")
def _(spark, folder):
    return assembly.heading_candidates(texts(spark, folder))


@query(
    "g04_navigation_entries",
    f"""WITH {TEXTS}, {CANDIDATES} SELECT {PAGES}, title, CASE WHEN count(*) OVER (PARTITION BY book_id, volume, title) = 1 THEN 'verified-candidate' ELSE 'ambiguous-duplicate' END AS status
        FROM candidates WHERE status = 'candidate'""",
)
def _(spark, folder):
    return assembly.navigation_entries(assembly.heading_candidates(texts(spark, folder)))


#: The entries of the latest context's table of contents, by hand; of several for a page all.
_TOC = """toc AS (SELECT book_id, volume, CAST(e.page AS INT) AS source_page, e.title AS title FROM (SELECT book_id, volume, unnest(table_of_contents) AS e FROM book_contexts))"""


def _toc(spark, folder):
    rows = load(spark, folder, "book_contexts").select("book_id", "volume", F.explode("table_of_contents").alias("e"))
    return rows.select("book_id", "volume", F.col("e.page").cast("int").alias("source_page"), F.col("e.title").alias("title"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("status"))


_VALID = f"coalesce(length({stripped('title')}) BETWEEN 1 AND 200 AND NOT regexp_matches({stripped('title')}, '[\\p{{Cc}}\\x{{2028}}\\x{{2029}}]'), false)"


@query(
    "c02_navigation_violations",
    f"""WITH {TEXTS}, {_TOC}, counted AS (SELECT *, count(*) OVER (PARTITION BY {PAGES}) AS pages, count(title) OVER (PARTITION BY book_id, volume, {stripped('title')}) AS titles FROM toc)
        SELECT {PAGES}, title, 'page' AS rule FROM counted c WHERE NOT EXISTS (SELECT 1 FROM texts t WHERE t.book_id = c.book_id AND t.volume = c.volume AND t.source_page = c.source_page)
        UNION ALL SELECT {PAGES}, title, 'title' FROM counted WHERE NOT {_VALID} UNION ALL SELECT {PAGES}, title, 'page-twice' FROM counted WHERE pages > 1 UNION ALL SELECT {PAGES}, title, 'title-twice' FROM counted WHERE titles > 1""",
)
def _(spark, folder):
    return assembly.navigation_violations(_toc(spark, folder), texts(spark, folder))


_ESCAPED = "regexp_replace(title, '([" + "".join("\\" + m for m in T.MARKDOWN) + r"])', '\\\1', 'g')"


@query(
    "t12_applied_entries",
    f"""WITH {TEXTS}, {_TOC}, entry AS (SELECT {PAGES}, min({stripped('title')}) AS title FROM toc WHERE {_VALID} GROUP BY 1, 2, 3),
        joined AS (SELECT t.*, e.title, {_ESCAPED} AS shown, {lines('t.text')} AS l FROM texts t LEFT JOIN entry e USING ({PAGES})),
        placed AS (SELECT *, list_position(list_transform(l, lambda x: {stripped("regexp_extract(" + stripped('x') + ", '^#{1,6}([^#].*)$', 1)")}), title) AS pos FROM joined)
        SELECT {PAGES}, CASE WHEN title IS NULL THEN text WHEN pos > 0 THEN array_to_string(list_transform(l, lambda x, i: CASE WHEN i = pos THEN '# ' || shown ELSE x END), chr(10))
          ELSE {stripped("'# ' || shown || chr(10) || chr(10) || text")} END AS text FROM placed""",
)
def _(spark, folder):
    return assembly.applied_entries(texts(spark, folder), _toc(spark, folder))


_NO_META = r"\p{Cc}|!\s*\[|\[[^\]\n]*\]\([^\n)]*\)|<[^>\n]+>|[\x{7b}\x{7d}\x{2028}\x{2029}]"


def _meta(x: str, limit: int) -> str:
    return f"CASE WHEN length({x}) BETWEEN 1 AND {limit} AND NOT regexp_matches({x}, '{_NO_META}') THEN {x} END"


def _yaml(name: str, value: str) -> str:
    return f"""'{name}: "' || replace(replace({value}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""


@query(
    "t13_front_matter",
    f"""WITH m AS (SELECT context_id, {_meta(stripped('title'), 500)} AS title, {_meta(stripped('author'), 500)} AS author, {_meta(stripped('pub_year'), 40)} AS year,
          CASE WHEN lower(coalesce(lang, '')) = 'zh' THEN 'zh' ELSE coalesce(nullif(trim(lang), ''), 'vi') END AS lang FROM book_contexts)
        SELECT context_id, CASE WHEN title IS NOT NULL THEN array_to_string(list_filter(['---', {_yaml('title', 'title')}, {_yaml('author', 'author')}, {_yaml('lang', 'lang')}, {_yaml('date', 'year')}, '---'], lambda x: x IS NOT NULL), chr(10)) || chr(10) END AS head FROM m""",
)
def _(spark, folder):
    contexts = load(spark, folder, "book_contexts")
    return contexts.select("context_id", T.front_matter(F.col("title"), F.col("author"), F.col("lang"), F.col("pub_year")).alias("head"))


@query(
    "g10_assembled_volumes",
    f"""WITH {TEXTS}, bodies AS (SELECT {PAGES}, {stripped('text')} AS body FROM texts)
        SELECT book_id, volume, count(*) AS pages, string_agg(body, chr(10) || chr(10) ORDER BY source_page) AS body FROM bodies WHERE body <> '' GROUP BY 1, 2""",
)
def _(spark, folder):
    return assembly.assembled(texts(spark, folder))


@query("g08_text_fingerprints")
def _(spark, folder):
    return assembly.text_fingerprint(texts(spark, folder))


@query("f05_navigation_states")
def _(spark, folder):
    """What the texts of first attempts left, against those of the last ones."""
    first = assembly.page_texts(load(spark, folder, "page_results").where("attempt = 1"))
    return assembly.navigation_states(assembly.text_fingerprint(first), assembly.text_fingerprint(texts(spark, folder)), _toc(spark, folder))


@query(
    "g11_line_counts",
    rf"""WITH {MARKED}, split AS (SELECT *, {lines('text')} AS ls FROM texts)
        SELECT book_id, volume, CAST(sum(len(list_filter(ls, lambda x: regexp_matches(x, '^# ')))) AS BIGINT) AS chapters, CAST(sum(len(list_filter(ls, lambda x: regexp_matches(x, '^## ')))) AS BIGINT) AS sections,
          CAST(sum(len(list_filter(ls, lambda x: regexp_matches(x, '^\[\^[^\]]+\]:')))) AS BIGINT) AS footnotes, count(*) FILTER (WHERE list_contains(list_transform(ls, lambda x: {stripped('x')}), '{T.MARKER}')) AS images,
          CAST(sum(length(text)) AS BIGINT) AS chars FROM split GROUP BY 1, 2""",
)
def _(spark, folder):
    return assembly.line_counts(marked(spark, folder))


_FITS = "n = 1 AND sha256(p.markdown) = o.source_sha256 AND sha256(o.markdown) = o.markdown_sha256"


@query(
    "j01_overridden_results",
    f"""WITH o AS (SELECT *, count(*) OVER (PARTITION BY result_id) AS n, row_number() OVER (PARTITION BY result_id) AS k FROM correction_overrides)
       SELECT p.result_id, CASE WHEN {_FITS} THEN o.markdown ELSE p.markdown END AS text, CASE WHEN n IS NULL THEN 'raw' WHEN n > 1 THEN 'duplicate' WHEN {_FITS} THEN 'override' ELSE 'stale' END AS state
       FROM page_results p LEFT JOIN o ON p.result_id = o.result_id AND o.k = 1""",
)
def _(spark, folder):
    return assembly.with_overrides(load(spark, folder, "page_results"), load(spark, folder, "correction_overrides"))


#: Each name of a volume's contexts whose canonical spelling is another one, once.
_SPELLINGS = """named AS (SELECT book_id, volume, unnest(proper_names) AS name, unnest(range(0, len(proper_names))) AS ordinal FROM book_contexts),
  spelling AS (SELECT book_id, volume, name.seen AS old, CAST(min(ordinal) AS INT) AS ordinal, min(name.canonical) AS new FROM named WHERE name.canonical <> name.seen AND length(name.seen) > 0 GROUP BY 1, 2, 3)"""


def _spellings(spark, folder):
    names = load(spark, folder, "book_contexts").select("book_id", "volume", F.posexplode("proper_names").alias("ordinal", "name"))
    changed = names.where("name.canonical is not null and name.seen <> name.canonical and length(name.seen) > 0")
    return changed.groupBy("book_id", "volume", F.col("name.seen").alias("old")).agg(F.min("ordinal").alias("ordinal"), F.min("name.canonical").alias("new"))


@query("j02_canonical_names_put_in")
def _(spark, folder):
    """Names of a volume's context that a page has exactly once in another spelling are replaced there, in order."""
    pages = texts(spark, folder).select(*PAGE, "text")
    own = pages.join(_spellings(spark, folder), ["book_id", "volume"]).where(F.contains("text", "old"))
    asked = own.select(*PAGE, "ordinal", "old", "new", F.lit(1).alias("expected"))
    return assembly.replaced_in_order(pages, asked, PAGE)


@query(
    "j02_replacement_counts",
    f"""WITH {TEXTS}, {_SPELLINGS} SELECT t.{PAGES.replace(', ', ', t.')}, s.old, CAST((length(t.text) - length(replace(t.text, s.old, ''))) / length(s.old) AS BIGINT) AS n
        FROM texts t JOIN spelling s ON t.book_id = s.book_id AND t.volume = s.volume WHERE contains(t.text, s.old)""",
)
def _(spark, folder):
    own = texts(spark, folder).join(_spellings(spark, folder), ["book_id", "volume"]).where(F.contains("text", "old"))
    return own.select(*PAGE, "old", ((F.length("text") - F.length(F.replace("text", "old", F.lit("")))) / F.length("old")).cast("long").alias("n"))


@query("f04_corrected_results")
def _(spark, folder):
    """Overrides of proofread results, then canonical spellings in results that have the other one once, then what is
    shown."""
    results = load(spark, folder, "page_results")
    overrides = load(spark, folder, "correction_overrides")
    first = assembly.with_overrides(results, overrides).join(results.select("result_id", "book_id", "volume"), "result_id")
    asked = first.join(_spellings(spark, folder), ["book_id", "volume"]).where(F.contains("text", "old")).select("result_id", "ordinal", "old", "new", F.lit(1).alias("expected"))
    return assembly.corrected(results, overrides, asked)
