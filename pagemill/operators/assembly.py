"""From page texts to a book: footnotes, navigation, corrections, fingerprints, ordered concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import VOLUME

PAGE = [*VOLUME, "source_page"]


def page_texts(results: DataFrame) -> DataFrame:
    """The text of each page: (book_id, volume, source_page, result_id, lang, text) of its last result, by attempt
    and id, that has one. Only that result's text moves."""
    filled = results.where("markdown is not null and markdown <> '' and error is null")
    best = filled.groupBy(*PAGE).agg(F.max(F.struct("attempt", "result_id")).alias("last")).select(F.col("last.result_id").alias("result_id"))
    return filled.join(best, "result_id", "left_semi").select(*PAGE, "result_id", "lang", F.col("markdown").alias("text"))


def with_footnote_shift(pages: DataFrame) -> DataFrame:
    """pages with highest, the highest footnote number of the page (0 if it has none; code has none), and shift, the sum
    of those of all earlier pages of the volume."""
    w = Window.partitionBy(*VOLUME).orderBy("source_page").rowsBetween(Window.unboundedPreceding, -1)
    marked = pages.withColumn("highest", F.coalesce(F.array_max(T.note_numbers(F.col("text"))), F.lit(0).cast("long")))
    return marked.withColumn("shift", F.coalesce(F.sum("highest").over(w), F.lit(0).cast("long")))


def footnote_offsets(pages: DataFrame) -> DataFrame:
    """(book_id, volume, source_page, highest, shift) of each page."""
    return with_footnote_shift(pages).select(*PAGE, "highest", "shift")


def renumbered_pages(pages: DataFrame) -> DataFrame:
    """pages with the footnotes of a volume numbered through: (book_id, volume, source_page, text)."""
    return with_footnote_shift(pages).select(*PAGE, T.renumbered(F.col("text"), F.col("shift")).alias("text"))


def book_pages(pages: DataFrame) -> DataFrame:
    """pages: (book_id, volume, source_page, text, lang). The texts as a book holds them: without the image's marker and
    an outer fence, footnotes numbered through, those without a reference shown, chapters as headings of the first
    level, breaks of dashes as stars. Null texts stay null."""
    bare = pages.withColumn("text", T.stripped(T.without_outer_fence(T.without_marker(F.col("text")))))
    shifted = with_footnote_shift(bare)
    text = T.shown_orphans(T.renumbered(F.col("text"), F.col("shift")), F.col("lang"))
    dashed = T.outside_code(T.chapter_headings(text), T.broken_dashes)
    return shifted.select(*PAGE, T.stripped(dashed).alias("text"))


def anchored(text: Column, page: Column) -> Column:
    """A page's text with its anchor: in front, or behind a heading of the first level that starts the page."""
    heading = F.regexp_extract(text, r"^(# [^\n]+)", 1)
    rest = F.regexp_replace(text, r"^# [^\n]+\n*", "")
    name = F.concat(F.lit('<span id="source-page-'), page.cast("string"))
    behind = F.concat_ws("\n\n", heading, F.concat(name, F.lit('" class="source-page-heading-anchor"></span>')), F.nullif(T.stripped(rest), F.lit("")))
    return F.when(heading != "", behind).otherwise(F.concat_ws("\n\n", F.concat(name, F.lit('"></span>')), F.nullif(text, F.lit(""))))


def assembled(pages: DataFrame) -> DataFrame:
    """One text a volume: (book_id, volume, pages, body): the page texts in order, joined by an empty line; blank ones
    are skipped. A volume is the unit of output, and has as many pages as one book."""
    kept = pages.withColumn("body", T.stripped(F.col("text"))).where("body <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("source_page", "body")))
    return kept.groupBy(*VOLUME).agg(F.count("*").alias("pages"), F.array_join(F.transform(ordered, lambda x: x["body"]), "\n\n").alias("body"))


def text_fingerprint(pages: DataFrame) -> DataFrame:
    """(book_id, volume, fingerprint): a digest of page numbers and text digests, in order of pages."""
    piece = F.concat(F.encode(F.col("source_page").cast("string"), "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.sha2("text", 256)), F.unhex(F.lit("0A")))
    ordered = F.array_sort(F.collect_list(F.struct("source_page", piece.alias("piece"))))
    joined = F.aggregate(F.transform(ordered, lambda x: x["piece"]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    return pages.where("text is not null").groupBy(*VOLUME).agg(F.sha2(joined, 256).alias("fingerprint"))


def heading_candidates(pages: DataFrame) -> DataFrame:
    """Headings that are chapter titles: (book_id, volume, source_page, line, title, body_chars, status). On a page with
    several they are suspected to be a table of contents."""
    rows = pages.select(*PAGE, T.body_chars(F.col("text")).alias("body_chars"), F.posexplode(T.lines(F.col("text"))).alias("at", "raw"))
    found = rows.withColumn("title", T.heading_title(F.col("raw"))).where("title is not null").where(T.is_chapter_title(F.col("title")))
    several = F.count("*").over(Window.partitionBy(*PAGE)) >= 2
    return found.select(*PAGE, (F.col("at") + 1).cast("long").alias("line"), "title", "body_chars", F.when(several, "toc-suspect").otherwise("candidate").alias("status"))


def navigation_entries(candidates: DataFrame) -> DataFrame:
    """(book_id, volume, source_page, title, status): titles with exactly one usable heading are verified; those with
    several stay ambiguous."""
    usable = candidates.where("status = 'candidate'")
    n = F.count("*").over(Window.partitionBy(*VOLUME, "title"))
    return usable.select(*PAGE, "title", F.when(n == 1, "verified-candidate").otherwise("ambiguous-duplicate").alias("status"))


def with_overrides(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """(result_id, text, state): the proofread text where the digests of the text that it replaces and of itself agree
    (override), the result's own text otherwise: stale where an override was refused, duplicate where there are several,
    which is refused too, raw where there is none."""
    one = overrides.groupBy("result_id").agg(F.max(F.struct("markdown_sha256", "source_sha256", "markdown")).alias("o"), F.count("*").alias("n"))
    joined = results.select("result_id", "markdown").join(one, "result_id", "left")
    fits = (F.col("n") == 1) & (F.sha2("markdown", 256) == F.col("o.source_sha256")) & (F.sha2("o.markdown", 256) == F.col("o.markdown_sha256"))
    return joined.select(
        "result_id",
        F.when(fits, F.col("o.markdown")).otherwise(F.col("markdown")).alias("text"),
        F.when(F.col("n").isNull(), "raw").when(F.col("n") > 1, "duplicate").when(fits, "override").otherwise("stale").alias("state"),
    )


def corrected(results: DataFrame, overrides: DataFrame, replacements: DataFrame) -> DataFrame:
    """results: (result_id, markdown); overrides as in with_overrides; replacements: (result_id, ordinal, old, new,
    expected). One row a result: (result_id, text, override, applied, refused, sanitized, before_sha256, after_sha256):
    overrides first, then the replacements in order, then only what is shown. sanitized says whether that took something
    away. A null text stays null."""
    first = with_overrides(results, overrides).withColumnRenamed("state", "override")
    replaced = replaced_in_order(first.select("result_id", "text"), replacements, ["result_id"])
    shown = replaced.withColumn("shown", T.sanitized(F.col("text")))
    before = results.select("result_id", F.sha2("markdown", 256).alias("before_sha256"))
    return (
        shown.join(first.select("result_id", "override"), "result_id")
        .join(before, "result_id")
        .select("result_id", F.col("shown").alias("text"), "override", "applied", "refused", (F.col("shown") != T.stripped(F.col("text"))).alias("sanitized"), "before_sha256", F.sha2("shown", 256).alias("after_sha256"))
    )


def replaced_in_order(pages: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """pages: keys, text; replacements: keys, ordinal, old, new, expected. (keys, text, applied, refused): the
    replacements of a page are applied one after the other to the text as it then is; one whose count is not the
    expected one is refused."""
    steps = F.array_sort(F.collect_list(F.struct("ordinal", "old", "new", "expected")))
    asked = replacements.where("old <> ''").groupBy(*keys).agg(steps.alias("steps"))

    def step(state: Column, r: Column) -> Column:
        n = (F.length(state["text"]) - F.length(F.replace(state["text"], r["old"], F.lit("")))) / F.length(r["old"])
        fits = n == r["expected"]
        return F.struct(
            F.when(fits, F.replace(state["text"], r["old"], r["new"])).otherwise(state["text"]).alias("text"),
            (state["applied"] + fits.cast("int")).alias("applied"),
            (state["refused"] + (~fits).cast("int")).alias("refused"),
        )

    start = F.struct(F.col("text").alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))
    none = F.array().cast("array<struct<ordinal:int,old:string,new:string,expected:int>>")
    done = pages.join(asked, keys, "left").withColumn("done", F.aggregate(F.coalesce("steps", none), start, step))
    return done.select(*keys, "done.text", "done.applied", "done.refused")


def line_counts(pages: DataFrame) -> DataFrame:
    """(book_id, volume, chapters, sections, footnotes, images, chars) of the page texts; images are the pages that ask
    for theirs."""
    count = lambda p: F.size(F.filter(T.lines(F.col("text")), lambda x: x.rlike(p)))
    return pages.groupBy(*VOLUME).agg(
        F.sum(count(r"^# ")).cast("long").alias("chapters"),
        F.sum(count(r"^## ")).cast("long").alias("sections"),
        F.sum(count(r"^\[\^[^\]]+\]:")).cast("long").alias("footnotes"),
        F.sum(T.wants_image(F.col("text")).cast("long")).alias("images"),
        F.sum(F.length("text")).cast("long").alias("chars"),
    )


# Fixed value: the note below a title that a lost page leaves without its start.
RECOVERED = "*原始章节起始页缺失；此处为首个存续页面的恢复导航锚点。*"


def with_entry(text: Column, title: Column, recovered: Column) -> Column:
    """A page's text under an entry of the navigation: its first heading with the entry's title becomes one of the first
    level; a page without it gets one in front, with a note if its start is lost. All marks of the title are escaped."""

    def of(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, T.heading_title), title)
        chapter = F.concat(F.lit("# "), T.escaped(title))
        put = T.joined(F.transform(ls, lambda x, i: F.when(i + 1 == at, chapter).otherwise(x)))
        note = F.when(recovered, F.lit("\n\n" + RECOVERED)).otherwise(F.lit(""))
        return F.when(at > 0, put).otherwise(T.stripped(F.concat(chapter, note, F.lit("\n\n"), text)))

    return F.when(title.isNull(), text).otherwise(T.let(T.lines(text), of))


def applied_entries(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages with their entries as chapters: (book_id, volume, source_page, text). entries: (book_id, volume,
    source_page, title) with an optional source; titles that are none are left out, and of several entries of a page,
    which navigation_violations tells, the least title counts."""
    recovered = F.col("source") == "recovery-anchor" if "source" in entries.columns else F.lit(False)
    valid = entries.select(*PAGE, T.valid_title(F.col("title")).alias("title"), F.coalesce(recovered, F.lit(False)).alias("recovered")).where("title is not null")
    one = valid.groupBy(*PAGE).agg(F.min(F.struct("title", "recovered")).alias("entry"))
    joined = pages.select(*PAGE, "text").join(one, PAGE, "left")
    return joined.select(*PAGE, with_entry(F.col("text"), F.col("entry.title"), F.col("entry.recovered")).alias("text"))


# Where an entry may come from, and the state of one for a chapter whose start is lost.
ENTRY_SOURCES = ["auto-heading", "manual", "recovery-anchor"]
LOST_START = "source-start-missing"


def navigation_violations(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """entries: (book_id, volume, source_page, title, source, status). (book_id, volume, source_page, title, rule) of
    entries that break a rule: page (it is none of the volume's with a text), title, source, lost-start, page-twice,
    title-twice. A row is given for each rule that it breaks; a null breaks its rule."""
    present = pages.select(*PAGE).distinct().withColumn("present", F.lit(True))
    marked = entries.join(present, PAGE, "left")
    stripped = T.stripped(F.col("title"))
    per_page, per_title = Window.partitionBy(*PAGE), Window.partitionBy(*VOLUME, stripped)
    rules = {
        "page": F.col("present").isNull(),
        "title": T.valid_title(F.col("title")).isNull(),
        "source": ~F.coalesce(F.col("source").isin(ENTRY_SOURCES), F.lit(False)),
        "lost-start": (F.col("source") == "recovery-anchor") & ~F.coalesce(F.col("status") == LOST_START, F.lit(False)),
        "page-twice": F.count("*").over(per_page) > 1,
        "title-twice": F.count("title").over(per_title) > 1,
    }
    marked = marked.select(*PAGE, "title", *(F.coalesce(condition, F.lit(False)).alias(f"_{name}") for name, condition in rules.items()))
    broken = F.array_compact(F.array(*(F.when(F.col(f"_{name}"), F.lit(name)) for name in rules)))
    return marked.select(*PAGE, "title", F.explode(broken).alias("rule"))


def navigation_states(stored: DataFrame, current: DataFrame, entries: DataFrame) -> DataFrame:
    """stored, current: (book_id, volume, fingerprint); entries: (book_id, volume, source). What is done with a volume's
    navigation (book_id, volume, action): keep it where the texts are the same, adopt it where no fingerprint is stored,
    make a new one where the texts changed, refuse that if an entry was made by hand."""
    by_hand = entries.groupBy(*VOLUME).agg(F.max(F.col("source").isin("manual", "recovery-anchor")).alias("by_hand"))
    sides = current.select(*VOLUME, F.col("fingerprint").alias("now")).join(stored.select(*VOLUME, F.lit(True).alias("known"), F.col("fingerprint").alias("then")), VOLUME, "left").join(by_hand, VOLUME, "left")
    action = F.when(F.col("known").isNull(), "generate").when(F.col("then").isNull(), "adopt").when(F.col("then") == F.col("now"), "keep").when(F.coalesce("by_hand", F.lit(False)), "refuse").otherwise("generate")
    return sides.select(*VOLUME, action.alias("action"))


def digest_mismatches(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Inventory rows whose text digest is that of no result of the page: (book_id, volume, source_page, text_sha256).
    Rows without a digest are none; the texts do not move, only their digests."""
    found = results.where("markdown is not null").select(*PAGE, F.sha2("markdown", 256).alias("text_sha256")).distinct()
    return pages.where("text_sha256 is not null").select(*PAGE, "text_sha256").distinct().join(found, [*PAGE, "text_sha256"], "left_anti")


def context_block(contexts: DataFrame) -> Column:
    """What is known of a volume as lines of text: title, people, publisher, pages of an image, contents, names, terms,
    notes; fields that are null or empty are left out. Of Chinese volumes only the layout is told, since their free
    fields may hold anything."""
    c = contexts
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    row = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    several = lambda x: F.when(F.size(x) > 0, F.array_join(x, "; "))
    people = F.concat_ws(", ", filled(c["author"]), filled(c["translator"]))
    printed = F.concat_ws(", ", filled(c["publisher"]), filled(c["pub_year"]))
    toc = F.transform(F.filter(c["table_of_contents"], lambda x: x["title"].isNotNull()), lambda x: F.concat_ws(" ", x["title"], x["page"].cast("string")))
    names = F.transform(F.filter(c["proper_names"], lambda x: x["seen"].isNotNull() & x["canonical"].isNotNull()), lambda x: F.concat(x["seen"], F.lit("→"), x["canonical"]))
    layout = F.array(row("content", F.when(c["content_type"].isin("verse", "mixed"), c["content_type"])), row("pages of an image", F.coalesce(c["pages_per_image"], F.lit(1)).cast("string")), row("order", F.when(c["pages_per_image"] >= 2, c["spread_order"])))
    free = F.array(
        row("title", filled(c["title"])), row("by", F.nullif(people, F.lit(""))), row("printed", F.nullif(printed, F.lit(""))), row("contents", several(toc)), row("names", several(F.slice(names, 1, NAMES_SHOWN))),
        row("terms", several(F.filter(c["terminology"], lambda x: x != ""))), row("layout", filled(c["layout_notes"])), row("footnotes", filled(c["footnote_convention"])), row("beware", several(F.filter(c["ocr_pitfalls"], lambda x: x != ""))),
    )
    chinese = F.lower(T.language_tag(c["lang"])).rlike("^zh")
    return T.joined(F.array_compact(F.when(chinese, layout).otherwise(F.concat(free, layout))))


#: Names that a context's block shows.
NAMES_SHOWN = 40
