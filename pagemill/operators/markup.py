"""Checks of marked-up documents: active elements, references to files, spines, anchors, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import external_reference

# Elements that act, attributes that name a resource.
ACTIVE = ["script", "iframe", "object", "embed"]
RESOURCES = ["href", "src", "poster", "data"]
_TAG = r"<([A-Za-z][^\s<>/]*(?:\s+[^<>\s=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*)\s*/?>"
_ATTRIBUTE = r"\s([^<>\s=/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)"
_URL = r"(?i)(?:url\s*\(\s*['\"]?([^)'\"\s]+)|@import\s+['\"]?([^)'\"\s;]+))"


def _local(name: Column) -> Column:
    """A name without its prefix, in lower case."""
    return F.lower(F.regexp_replace(name, r"^.*:", ""))


def elements(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, place from 1, element, attributes ARRAY<STRUCT<name, value>>) of the start tags of a text. Visible words
    that only look like an attribute are none, and an attribute without a value has none."""
    tags = F.regexp_extract_all(F.col(text), F.lit(_TAG), 1)
    rows = texts.select(*key, F.posexplode(tags).alias("at", "tag"))

    def attribute(raw: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(raw, r"(?s)^[^=]*=\s*(.*)$", 1), r"^[\"']|[\"']$", "")
        return F.struct(_local(F.regexp_extract(raw, r"^\s*([^\s=]+)", 1)).alias("name"), F.trim(value).alias("value"))

    attributes = F.transform(F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), 0), attribute)
    return rows.select(*key, (F.col("at") + 1).cast("long").alias("place"), _local(F.regexp_extract("tag", r"^(\S+)", 1)).alias("element"), attributes.alias("attributes"))


def markup_rules(found: DataFrame, key: list[str]) -> DataFrame:
    """found: of elements. (key, rule) once each: active-element, event-attribute, style-attribute, external-reference,
    css-expression, css-external."""
    rows = found.select(*key, "element", F.explode_outer("attributes").alias("a"))
    style = F.when(F.col("a.name") == "style", F.col("a.value"))
    url = F.coalesce(F.nullif(F.regexp_extract(style, _URL, 1), F.lit("")), F.nullif(F.regexp_extract(style, _URL, 2), F.lit("")))
    rules = {
        "active-element": F.col("element").isin(ACTIVE),
        "event-attribute": F.startswith(F.col("a.name"), F.lit("on")),
        "style-attribute": F.col("a.name") == "style",
        "external-reference": F.col("a.name").isin(RESOURCES) & (F.col("a.value") != "") & external_reference(F.col("a.value")),
        "css-expression": style.rlike(r"(?i)expression\s*\(|javascript\s*:"),
        "css-external": external_reference(url) & ~F.startswith(F.lower(url), F.lit("data:")),
    }
    met = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items())))
    return rows.select(*key, F.explode(met).alias("rule")).distinct()


def resolved(base: Column, reference: Column) -> Column:
    """The member that a reference in the member base means: null for one with a scheme or host, empty for one that is
    absolute or leaves the root, base itself for one that is only a fragment. %-codes are decoded, a plus is none."""
    path = F.regexp_replace(reference, r"[?#].*$", "")
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.split(F.concat(folder, F.coalesce(decoded, path)), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return (
        F.when(reference.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|//)"), F.lit(None).cast("string"))
        .when(path == "", base)
        .when(F.startswith(path, F.lit("/")) | F.startswith(joined, F.lit("../")) | (joined == ".."), F.lit(""))
        .otherwise(joined)
    )


def broken_references(references: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """references: (key, base, reference); members: (key, member). (key, base, reference, rule): broken where the
    meant member is missing, escaping where it lies outside. External references are none."""
    asked = references.where("reference <> ''").select(*key, "base", "reference", resolved(F.col("base"), F.col("reference")).alias("member")).where("member is not null").distinct()
    escaping = asked.where("member = ''").select(*key, "base", "reference", F.lit("escaping").alias("rule"))
    broken = asked.where("member <> ''").join(members.select(*key, "member").distinct(), [*key, "member"], "left_anti")
    return escaping.unionByName(broken.select(*key, "base", "reference", F.lit("broken").alias("rule")))


def dangling(references: DataFrame, items: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """references: (key, ref); items: (key, ref, member); members: (key, member). (key, ref, rule): references that no
    item has, and those whose item has no member. Chained anti joins."""
    wanted = references.select(*key, "ref").where("ref is not null").distinct()
    named = items.select(*key, "ref", "member").distinct()
    no_item = wanted.join(named, [*key, "ref"], "left_anti").select(*key, "ref", F.lit("no-item").alias("rule"))
    no_member = wanted.join(named, [*key, "ref"]).join(members.select(*key, "member").distinct(), [*key, "member"], "left_anti").select(*key, "ref", F.lit("no-member").alias("rule"))
    return no_item.unionByName(no_member.distinct())


def anchor_violations(expected: DataFrame, anchors: DataFrame, key: list[str], report: int = 20) -> DataFrame:
    """expected: (key, page) in the order of pages; anchors: (key, page, place). (key, rule, pages): missing, extra and
    repeated anchors, and order if they do not stand in that of the pages. pages are the first report ones, by page. A
    key's pages are those of one volume."""
    left, right = expected.select(*key, "page").distinct(), anchors.groupBy(*key, "page").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    sides = left.withColumn("wanted", F.lit(True)).join(right, [*key, "page"], "full")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "repeated")
    counts = sides.withColumn("rule", rule).where("rule is not null")
    w = Window.partitionBy(*key).orderBy("place", "page")
    turned = anchors.withColumn("before", F.lag("page").over(w)).where("before > page").withColumn("rule", F.lit("order"))
    every = counts.select(*key, "rule", "page").unionByName(turned.select(*key, "rule", "page"))
    return every.groupBy(*key, "rule").agg(F.slice(F.sort_array(F.collect_set("page")), 1, report).alias("pages"))


def misplaced_images(pages: DataFrame, anchors: DataFrame, media: DataFrame, key: list[str]) -> DataFrame:
    """pages: (key, page, sha256) whose image is kept; anchors: (key, page, document, place), of which the last one of a
    page counts; media: (key, document, sha256). (key, page) whose image is not in the document of its anchor."""
    last = anchors.groupBy(*key, "page").agg(F.max_by("document", F.struct("place", "document")).alias("document"))
    placed = pages.select(*key, "page", "sha256").distinct().join(last, [*key, "page"], "left")
    return placed.join(media.select(*key, "document", "sha256").distinct(), [*key, "document", "sha256"], "left_anti").select(*key, "page")


def media_differences(expected: DataFrame, found: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """expected, found, allowed: (key, sha256). (key, side, n): hashes that are found, missing, or extra: neither expected
    nor allowed."""
    sides = (
        expected.select(*key, "sha256").distinct().withColumn("e", F.lit(1))
        .join(found.select(*key, "sha256").distinct().withColumn("f", F.lit(1)), [*key, "sha256"], "full")
        .join(allowed.select(*key, "sha256").distinct().withColumn("a", F.lit(1)), [*key, "sha256"], "left")
    )
    side = F.when(F.col("e").isNotNull() & F.col("f").isNotNull(), "found").when(F.col("e").isNotNull(), "missing").when(F.col("a").isNull(), "extra")
    return sides.withColumn("side", side).where("side is not null").groupBy(*key, "side").agg(F.count("*").alias("n"))


def empty_anchors(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows: (key, place, kind: anchor, heading-anchor, heading or content, page). (key, page) of anchors behind which
    no content stands before the next anchor; the heading before a heading-anchor, with no anchor between, is content.
    Sums over the rows of one document."""
    w = Window.partitionBy(*key).orderBy("place")
    is_anchor = F.col("kind").isin("anchor", "heading-anchor")
    group = F.sum(is_anchor.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.select(*key, "place", "kind", "page", group.alias("part"))
    parts = grouped.groupBy(*key, "part").agg(
        F.max(F.when(F.col("kind").isin("anchor", "heading-anchor"), F.col("page"))).alias("page"),
        F.max((F.col("kind") == "heading-anchor").cast("int")).alias("by_heading"),
        F.max((~F.col("kind").isin("anchor", "heading-anchor")).cast("int")).alias("filled"),
        F.max((F.col("kind") == "heading").cast("int")).alias("heading"),
    )
    before = F.lag("heading").over(Window.partitionBy(*key).orderBy("part"))
    marked = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    return marked.where("page is not null and filled = 0 and not (by_heading = 1 and before = 1)").select(*key, "page")


def spine_documents(members: DataFrame) -> DataFrame:
    """members: (path, member, content BINARY) of books in archives. (path, place from 1, ref, document): the documents
    of each book in reading order; document is null where a reference has no item."""
    text = members.select("path", "member", F.decode("content", "UTF-8").alias("xml"))
    root = text.where("member = 'META-INF/container.xml'").select("path", F.get(F.xpath("xml", F.lit("//*[local-name()='rootfile']/@full-path")), F.lit(0)).alias("member"))
    package = text.join(root, ["path", "member"])

    def attributes(element: str, name: str) -> Column:
        return F.xpath("xml", F.lit(f"//*[local-name()='{element}']/@{name}"))

    items = package.select("path", "member", F.explode(F.arrays_zip(attributes("manifest']/*[local-name()='item", "id").alias("ref"), attributes("manifest']/*[local-name()='item", "href").alias("href"))).alias("i"))
    named = items.select("path", F.col("i.ref").alias("ref"), resolved(F.col("member"), F.col("i.href")).alias("document"))
    refs = package.select("path", F.posexplode(attributes("spine']/*[local-name()='itemref", "idref")).alias("at", "ref"))
    return refs.join(named, ["path", "ref"], "left").select("path", (F.col("at") + 1).alias("place"), "ref", "document")
