"""What the modules of queries share: the register, parts of SQL, and the marked-up page texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly
from ..tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


#: White space and breaks of lines in SQL, and the last results with a text.
S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TEXTS = """texts AS (SELECT book_id, volume, source_page, result_id, lang, markdown AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id, volume, source_page ORDER BY attempt DESC NULLS LAST, result_id DESC) AS k
  FROM page_results WHERE markdown IS NOT NULL AND markdown <> '' AND error IS NULL) WHERE k = 1)"""
EXPECTED = """expected AS (SELECT * FROM (SELECT book_id, volume, CAST(unnest(range(1, source_pdf.page_count + 1)) AS INT) AS source_page FROM books) e
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT book_id, volume, unnest(source_pdf.excluded_pages).page AS page FROM books) x
    WHERE x.book_id = e.book_id AND x.volume = e.volume AND x.page = e.source_page))"""


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def lines(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE string_split_regex(regexp_replace({x}, '(?:{BREAK})$', ''), '{BREAK}') END"


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.page_texts(load(spark, folder, "page_results"))


#: Marks that page texts of scans seldom have; each page's text with all of them behind it, and the page's number in
#: them, is the input of the queries on code, footnotes, headings and markup.
BLOCK = """

##Chương {p}: Đầu
Phần lớn là văn xuôi {p}.
Phần thứ hai
# Plain {p}
###Deep
---
- - -
-- -
see[^1] and[^3], [^{p}]
[^3]: third
  [^77]: orphan {p}
```text
[^7] # no
---
```
~~~
[^8]
```
~~~~
```x``` [^2] y
    [^901] indented
\t[^902] tab
<br/>line<BR >two
<script>bad({p})</script><b OnClick="go()" style="x:y">bold</b> <img src="https://host/{p}.png"/>
![alt {p}](../ocr/page_{p}.png) [link](https://host/{p}) [next](page_{p}.md#a)
　[ref]: http://host/{p}
　::: box {p}
<!-- note {p} -->
export API_KEY='abcdefgh{p}ijklmnop'
use sk-live-aaaaaaaaaaaaaaaaaaaa{p} or npm_{p}abcdefghijklmnopqrstuvwxyzabcdef
a\u2028b\x0bc"""
_QUOTED = BLOCK.replace("'", "''")
MARKED = TEXTS.replace("texts AS", "bare AS") + f", texts AS (SELECT book_id, volume, source_page, result_id, lang, text || replace('{_QUOTED}', '{{p}}', CAST(source_page AS VARCHAR)) AS text FROM bare)"


def marked(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).withColumn("text", F.concat("text", F.replace(F.lit(BLOCK), F.lit("{p}"), F.col("source_page").cast("string"))))


_MARK = r"regexp_extract({x}, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1)"
_OPENS = r"regexp_matches({x}, '^ {{0,3}}(`{{3,}}[^`]*|~{{3,}}.*)$')"
_CLOSES = r"regexp_matches({x}, '^ {{0,3}}(`{{3,}}|~{{3,}})[ \t]*$')"
_INDENT = r"regexp_matches({x}, '^( {{4}}| {{0,3}}\t)')"


def _of(pattern: str, x: str) -> str:
    return pattern.format(x=x)


#: Lines of texts with whether they are code (result_id, pos, line, fence, code), one after the other; texts is before it.
FOLD = f"""ls AS MATERIALIZED (SELECT result_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT result_id, {lines('text')} AS l FROM texts)),
  fold AS (SELECT result_id, pos, line, CASE WHEN {_of(_OPENS, 'line')} THEN {_of(_MARK, 'line')} ELSE '' END AS fence, {_of(_OPENS, 'line')} OR {_of(_INDENT, 'line')} AS code FROM ls WHERE pos = 1
    UNION ALL SELECT n.result_id, n.pos, n.line,
      CASE WHEN f.fence <> '' THEN CASE WHEN {_of(_CLOSES, 'n.line')} AND starts_with({_of(_MARK, 'n.line')}, f.fence) THEN '' ELSE f.fence END WHEN {_of(_OPENS, 'n.line')} THEN {_of(_MARK, 'n.line')} ELSE '' END,
      f.fence <> '' OR {_of(_OPENS, 'n.line')} OR {_of(_INDENT, 'n.line')}
    FROM fold f JOIN ls n ON n.result_id = f.result_id AND n.pos = f.pos + 1)"""
NOTES = r"""notes AS (SELECT t.book_id, t.volume, t.source_page, t.result_id, coalesce(h.highest, 0) AS highest FROM texts t LEFT JOIN (
    SELECT result_id, max(TRY_CAST(n AS BIGINT)) AS highest FROM (SELECT result_id, unnest(regexp_extract_all(line, '\[\^([0-9]+)\]', 1)) AS n FROM fold WHERE NOT code) GROUP BY 1) h ON t.result_id = h.result_id),
  shifts AS (SELECT *, CAST(coalesce(sum(highest) OVER (PARTITION BY book_id, volume ORDER BY source_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM notes)"""
PAGES = "book_id, volume, source_page"


def changed_lines(line: str, more: str = "") -> str:
    """SQL of (book_id, volume, source_page, text) with each line that is no code as the expression says."""
    return f"""WITH RECURSIVE {MARKED}, {FOLD}{more} SELECT t.book_id, t.volume, t.source_page, n.text FROM texts t JOIN (
      SELECT f.result_id, string_agg(CASE WHEN code THEN line ELSE {line} END, chr(10) ORDER BY pos) AS text FROM fold f {'JOIN shifts s ON f.result_id = s.result_id' if more else ''} GROUP BY 1) n ON t.result_id = n.result_id"""
