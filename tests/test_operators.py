"""Small cases of the operators."""

import hashlib

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import assembly, audit, duplicates, ledger, pages


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def test_sanitized(spark):
    text = 'a<br/>b ![alt](/secret/p.png) [link](https://x.y) <script>bad()</script><b>bold</b>\n[ref]: http://z\n[^1]: kept\n::: box\n<!-- gone -->'
    got = one(spark, text, T.sanitized)
    assert "  \nb alt link" in got and "bold" in got and "[^1]: kept" in got
    assert not any(x in got for x in ("secret", "https", "bad()", "<", "[ref]", ":::", "gone"))
    assert one(spark, None, T.sanitized) is None


def test_marker(spark):
    text = f"a\n {T.MARKER} \nb"
    assert one(spark, text, T.wants_image) is True
    assert one(spark, text, T.without_marker) == "a\nb"
    assert one(spark, "a", T.wants_image) is False


def test_language_tags(spark):
    for raw, tag in (("zh_hans_cn", "zh-Hans-CN"), ("ZH", "zh"), ("en", "en"), (None, "vi"), (" ", "vi")):
        assert one(spark, raw, T.language_tag) == tag


def test_chapter_titles(spark):
    for title, yes in (("第一章 开始", True), ("## 第12节", True), ("序", True), ("前言 一", True), ("第一", False), ("序曲", False)):
        assert one(spark, title, T.is_chapter_title) is yes


def test_natural_order(spark):
    names = ["page_10.png", "page_5.png", "page_80.png", "page_9.png", "page_13.png", "page_6.png"]
    rows = spark.createDataFrame([("b", n) for n in names], "book string, name string")
    got = [r["name"] for r in pages.natural_order(rows, ["book"], "name").orderBy("place").collect()]
    assert got == ["page_5.png", "page_6.png", "page_9.png", "page_10.png", "page_13.png", "page_80.png"]


def test_page_numbers(spark):
    rows = spark.createDataFrame([("a", "1, 5-8"), ("b", "3-1,0,x"), ("c", None)], "k string, r string")
    got = sorted((r["k"], r["page"]) for r in pages.page_numbers(rows, ["k"], "r").collect())
    assert got == [("a", 1), ("a", 5), ("a", 6), ("a", 7), ("a", 8)]


def test_representative(spark):
    for n in (1, 2, 5, 9, 11, 20, 37, 100):
        rows = spark.range(1, n + 1).withColumn("k", F.lit("b"))
        got = sorted(r["id"] for r in pages.representative(rows, ["k"], "id").collect())
        assert got == sorted({round((n - 1) * i / 6) + 1 for i in range(7)}) if n > 7 else got == sorted({round((n - 1) * i / 6) + 1 for i in range(7)})


def test_page_rules(spark):
    schema = "book_id string, volume int, source_page int, archive_image string, ocr_image string, ocr_state string, attempts int, representation string"
    good = ("b", 1, 1, "a/1.png", "o/1.png", "ok", 1, "reflow")
    bad = [
        ("b", 1, 2, "a/1.png", "o/1.png", "pending", 0, "reflow"),
        ("b", 1, 3, "a/1.png", "o/1.png", "ok", 1, "image"),
        ("b", 1, 4, "a/1.png", "o/1.png", "failed", 1, "reflow"),
        ("b", 1, 5, "../1.png", None, None, 7, "image"),
    ]
    got = sorted((r["source_page"], r["rule"]) for r in pages.page_violations(spark.createDataFrame([good, *bad], schema)).collect())
    assert got == [(2, "pending-form"), (3, "ok-form"), (4, "other-form"), (5, "archive-path"), (5, "attempts"), (5, "ocr-path"), (5, "state")]


def test_footnotes_are_numbered_through(spark):
    rows = spark.createDataFrame([("b", 1, 1, "x[^1] y[^2]\n[^2]: n"), ("b", 1, 2, "z[^1]\n[^1]: m"), ("b", 1, 3, "none")], "book_id string, volume int, source_page int, text string")
    got = {r["source_page"]: r["text"] for r in assembly.renumbered_pages(rows).collect()}
    assert got == {1: "x[^1] y[^2]\n[^2]: n", 2: "z[^3]\n[^3]: m", 3: "none"}


def test_fingerprint(spark):
    texts = {1: "a", 2: "乙", 10: ""}
    rows = spark.createDataFrame([("b", 1, p, t) for p, t in texts.items()], "book_id string, volume int, source_page int, text string")
    digest = hashlib.sha256()
    for p, t in sorted(texts.items()):
        digest.update(str(p).encode() + b"\0" + hashlib.sha256(t.encode()).digest() + b"\n")
    assert assembly.text_fingerprint(rows).first()["fingerprint"] == digest.hexdigest()


def test_replacements_follow_each_other(spark):
    texts = spark.createDataFrame([(1, "aXbX"), (2, "q"), (3, None)], "k int, text string")
    steps = spark.createDataFrame([(1, 0, "X", "Y", 2), (1, 1, "Yb", "Z", 1), (1, 2, "a", "c", 5), (2, 0, "", "c", 1)], "k int, ordinal int, old string, new string, expected int")
    got = {r["k"]: (r["text"], r["applied"], r["refused"]) for r in assembly.replaced_in_order(texts, steps, ["k"]).collect()}
    assert got == {1: ("aZY", 2, 1), 2: ("q", 0, 0), 3: (None, 0, 0)}


def test_near_pairs_and_islands(spark):
    a, b = "first phrase of words " * 20, "another phrase here " * 20
    rows = spark.createDataFrame([("b", 1, a), ("b", 2, b), ("b", 3, a), ("b", 4, b), ("b", 200, a), ("b", 5, None), ("b", 6, "")], "book string, p int, t string")
    pairs = duplicates.near_pairs(rows, ["book"], "p", "t", offset=3)
    assert sorted((r["first"], r["duplicate"]) for r in pairs.collect()) == [(1, 3), (2, 4)]
    island = duplicates.islands(pairs, ["book"]).collect()
    assert [(r["first_start"], r["first_end"], r["duplicate_start"], r["duplicate_end"], r["length"]) for r in island] == [(1, 2, 3, 4, 2)]
    cut = spark.createDataFrame([("b", 1, 3), ("b", 1, 5), ("b", 2, 4)], "book string, first int, duplicate int")
    assert duplicates.islands(cut, ["book"]).count() == 3


def test_secrets_and_known_values(spark):
    rows = spark.createDataFrame([(1, "x\nexport API_KEY='abcdefghijklmnop'\n"), (2, "中sk-" + "a" * 24), (3, "Bearer abc"), (4, None)], "id int, text string")
    got = sorted((r["id"], r["rule"]) for r in audit.secret_findings(rows, "id", "text").collect())
    assert got == [(1, "generic-secret-assignment"), (2, "sk-token")]
    values = spark.createDataFrame([("abcdefghijklmnop",), ("short",), (None,)], "v string")
    assert [(r["id"], r["value"]) for r in audit.known_values(rows, "id", "text", values, "v").collect()] == [(1, "abcdefghijklmnop")]


def test_attempts(spark):
    schema = "ledger_id string, event string, stage string, status string, page string, book_id string, volume int, ts_utc string"
    t = "2024-01-01T00:00:0{}.000Z"
    rows = [("a", "started", "ocr", "started", "page_000001.png", "b", 1, t.format(1)), ("a", "started", "ocr", "started", "page_000001.png", "b", 1, t.format(1)), ("a", "finished", "ocr", "succeeded", "page_000001.png", "b", 1, t.format(3)), ("c", "started", "ocr", "started", "page_000001.png", "b", 1, t.format(2)), (None, "started", "ocr", "started", "page_000001.png", "b", 1, t.format(2))]
    events = spark.createDataFrame(rows, schema)
    assert [(r["page"], r["attempts"]) for r in ledger.attempts_per_page(events).collect()] == [(1, 2)]
    got = {r["ledger_id"]: (r["outcome"], r["elapsed_ms"]) for r in ledger.attempt_pairs(events).collect()}
    assert got == {"a": ("succeeded", 2000), "c": ("lost", None)}
    assert ledger.attempt_pairs(events.limit(0)).count() == 0


def test_code_is_left_alone(spark):
    text = "#Title\n---\n```\n#no\n---\n```\n    #indented\n- - -\n-- -x\n~~~~\n```\n#in\n~~~~~\n##Last\n```x``` y\n#After"
    want = "# Title\n* * *\n```\n#no\n---\n```\n    #indented\n* * *\n-- -x\n~~~~\n```\n#in\n~~~~~\n## Last\n```x``` y\n# After"
    assert one(spark, text, T.normalized_lines) == want
    assert one(spark, None, T.normalized_lines) is None and one(spark, "", T.normalized_lines) == ""
    assert one(spark, "```\n#a", T.code_lines) == [True, True]
    assert one(spark, "", T.code_lines) == []


def test_lines_end_at_every_break(spark):
    for text in ("a\r\nb\x0bc\x0cd\x1ce\x85f\u2028g\u2029h\n", "\n", "", "a\n\n", "a\rb"):
        assert one(spark, text, T.lines) == text.splitlines()
    assert one(spark, None, T.lines) is None


def test_notes_outside_code(spark):
    rows = [("b", 1, 1, "x[^1]\n```\n[^9]\n```\n    [^7]"), ("b", 1, 2, "z[^1] [^2]\n[^2]: m"), ("b", 1, 3, "n[^123456789012345678901]"), ("b", 1, 4, None), ("b", 1, 5, "[^3]")]
    pages_ = spark.createDataFrame(rows, "book_id string, volume int, source_page int, text string")
    got = {r["source_page"]: r["text"] for r in assembly.renumbered_pages(pages_).collect()}
    assert got == {1: rows[0][3], 2: "z[^2] [^3]\n[^3]: m", 3: rows[2][3], 4: None, 5: "[^6]"}


def test_orphan_notes(spark):
    text = "a[^1]\n[^1]: used\n[^2]: orphan[^3] \n```\n[^9]: code\n```\n  [^3]: indented\n[^x]: no number"
    assert one(spark, text, T.orphan_notes) == [2, 3]
    assert one(spark, text, lambda c: T.shown_orphans(c, F.lit("ja"))).split("\n")[2:7] == ["脚注 2： orphan[^3]", "```", "[^9]: code", "```", "  脚注 3： indented"]
    assert one(spark, "[^4]: only", lambda c: T.shown_orphans(c, F.lit(None).cast("string"))) == "Chú thích 4: only"
    assert one(spark, "", T.orphan_notes) == [] and one(spark, None, T.orphan_notes) is None


def test_chapter_headings(spark):
    yes = ["Chương IV", "CHƯƠNG 12: Đầu", "Phần thứ hai", "Hồi nhất — Mở", "Quyển 3.  Sông", "  Thiên mười"]
    no = ["Phần lớn là", "Phần thứ hai của sách", "Hồi đó", "Chương 1: nhỏ", "chương 1", "Chương 1: " + "Đ" * 80]
    for line in yes + no:
        assert one(spark, line, T.is_chapter_heading) is (line in yes), line
    assert one(spark, "##Chương 1\nChương 2\n##x\n###y\n    Chương 3", T.chapter_headings) == "# Chương 1\n# Chương 2\n## x\n###y\n    Chương 3"


def test_outer_fence(spark):
    for text, want in (("```md\na\n```\nb\n```\nc", "a\n```\nb"), ("```\na\nb", "a\nb"), ("x\n```", "x\n```"), ("```python\na\n```", "```python\na\n```"), ("", ""), (None, None)):
        assert one(spark, text, T.without_outer_fence) == want


def test_wide_spaces_hide_no_reference(spark):
    assert one(spark, "\u3000[ref]: http://x.y\n\u3000::: box\nkept", T.sanitized) == "kept"


def test_metadata(spark):
    for value, want in ((" a ", "a"), ("", None), ("a\nb", None), ("![x](y)", None), ("a{b", None), ("x" * 501, None), (None, None)):
        assert one(spark, value, T.metadata_text) == want
    head = one(spark, 'a "b" \\', lambda c: T.front_matter(c, F.lit(None).cast("string"), F.lit("zh_cn"), F.lit("1999")))
    assert head == '---\ntitle: "a \\"b\\" \\\\"\nlang: "zh-CN"\ndate: "1999"\n---\n'


def test_responses(spark):
    assert one(spark, ' ```json\nhi {"a":1} x\n```', T.json_body) == '{"a":1}'
    assert one(spark, "none", T.json_body) == "none"
    whole = one(spark, '{"choices":[{"message":{"content":"x","reasoning":"abc"},"finish_reason":"stop"}]}', T.response_content)
    assert tuple(whole) == ("x", "stop", 3)
    parts = one(spark, '{"choices":[{"message":{"content":[{"text":"a"},{"x":1},{"text":"b"}]}}]}', T.response_content)
    assert parts["text"] == "ab"
    assert one(spark, "[1]", T.response_content) is None and one(spark, None, T.response_content) is None
    assert one(spark, "{" + " " * 50 + "}", lambda c: T.response_content(c, 10)) is None


def test_redaction_comes_before_the_cut(spark):
    assert one(spark, "x secret y", lambda c: T.redacted(c, F.lit("secret"), 6)) == "x [RED"
    assert one(spark, "x secret y", lambda c: T.redacted(c, F.lit(None).cast("string"), 6)) == "x secr"


def test_layout_marker_in_any_width(spark):
    assert one(spark, "a ［［scan2ebook_unsupported_zh_ layout］］", T.unsupported_layout) is True
    assert one(spark, "a", T.unsupported_layout) is False and one(spark, None, T.unsupported_layout) is None


def test_entries_become_chapters(spark):
    rows = spark.createDataFrame([("b", 1, 1, "## 第一章 [x]\ntext"), ("b", 1, 2, "## 第一章 y\n## 第二章"), ("b", 1, 3, None)], "book_id string, volume int, source_page int, text string")
    entries = assembly.navigation_entries(assembly.heading_candidates(rows)).where("status = 'verified-candidate'")
    got = {r["source_page"]: r["text"] for r in assembly.applied_entries(rows, entries).collect()}
    assert got == {1: "# 第一章 \\[x\\]\ntext", 2: "## 第一章 y\n## 第二章", 3: None}


def test_known_values_of_any_length(spark):
    texts = spark.createDataFrame([(1, "芷穗认为云口很远"), (2, "Ann met Bartholomew"), (3, None), (4, "A")], "doc_id long, text string")
    values = spark.createDataFrame([("芷穗",), ("Ann",), ("Bartholomew",), ("Bartholomeus",), ("",), (None,)], "name string")
    got = audit.known_values(texts, "doc_id", "text", values, "name", least=1)
    assert sorted(map(tuple, got.collect())) == [(1, "芷穗"), (2, "Ann"), (2, "Bartholomew")]


def test_entries_without_a_heading(spark):
    rows = spark.createDataFrame([("b", 1, 1, "text"), ("b", 1, 2, "a\n## T\n## T"), ("b", 1, 3, "x")], "book_id string, volume int, source_page int, text string")
    entries = spark.createDataFrame([("b", 1, 1, "A_b", "recovery-anchor"), ("b", 1, 2, "T", "manual"), ("b", 1, 3, " ", "manual")], "book_id string, volume int, source_page int, title string, source string")
    got = {r["source_page"]: r["text"] for r in assembly.applied_entries(rows, entries).collect()}
    assert got == {1: "# A\\_b\n\n" + assembly.RECOVERED + "\n\ntext", 2: "a\n# T\n## T", 3: "x"}
    wrong = entries.withColumn("status", F.lit(None).cast("string"))
    found = sorted((r["source_page"], r["rule"]) for r in assembly.navigation_violations(wrong.unionByName(wrong.where("source_page = 2")), rows.where("source_page < 3")).collect())
    assert found == [(1, "lost-start"), (2, "page-twice"), (2, "page-twice"), (2, "title-twice"), (2, "title-twice"), (3, "page"), (3, "title")]


def test_corrections_in_order(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    results = spark.createDataFrame([(1, "old <b>x</b>"), (2, "two"), (3, None), (4, "four")], "result_id long, markdown string")
    overrides = spark.createDataFrame([(1, "new aa", sha("old <b>x</b>"), sha("new aa")), (2, "x", "bad", sha("x")), (4, "p", sha("four"), sha("p")), (4, "q", sha("four"), sha("q"))], "result_id long, markdown string, source_sha256 string, markdown_sha256 string")
    steps = spark.createDataFrame([(1, 0, "aa", "<i>bb</i>", 1), (1, 1, "bb", "c", 2), (9, 0, "a", "b", 1)], "result_id long, ordinal int, old string, new string, expected int")
    got = {r["result_id"]: (r["text"], r["override"], r["applied"], r["refused"], r["sanitized"]) for r in assembly.corrected(results, overrides, steps).collect()}
    assert got == {1: ("new bb", "override", 1, 1, True), 2: ("two", "stale", 0, 0, False), 3: (None, "raw", 0, 0, None), 4: ("four", "duplicate", 0, 0, False)}


def test_navigation_states(spark):
    side = lambda rows: spark.createDataFrame(rows, "book_id string, volume int, fingerprint string")
    stored, current = side([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, None)]), side([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "y"), ("d", 1, "y"), ("e", 1, "y")])
    entries = spark.createDataFrame([("a", 1, "manual"), ("b", 1, "manual"), ("c", 1, "auto-heading")], "book_id string, volume int, source string")
    assert {r["book_id"]: r["action"] for r in assembly.navigation_states(stored, current, entries).collect()} == {"a": "keep", "b": "refuse", "c": "generate", "d": "adopt", "e": "generate"}


def test_pairs_share_counts_of_characters(spark):
    base = "abcdefghij" * 30
    rows = spark.createDataFrame([("b", 1, base), ("b", 2, base[:-2] + "zz"), ("b", 3, "klmnopqrst" * 30), ("b", 4, base), ("b", 5, None)], "book string, p int, t string")
    got = {(r["first"], r["duplicate"]): (r["common"], r["equal"]) for r in duplicates.bounded_pairs(rows, ["book"], "p", "t").collect()}
    assert got == {(1, 2): (298, False), (1, 4): (300, True), (2, 4): (298, False)}
    near = {(r["first"], r["duplicate"]): round(r["similarity"], 4) for r in duplicates.near_pairs(rows, ["book"], "p", "t").collect()}
    assert near == {(1, 2): 0.9933, (1, 4): 1.0, (2, 4): 0.9933}
    images = spark.createDataFrame([("b", 1, "i"), ("b", 2, "i"), ("b", 3, None), ("b", 2, "i")], "book string, p int, image string")
    report = duplicates.duplicate_report(images, rows, ["book"], "p", "image", "t")
    assert sorted((r["kind"], r["first_start"], r["duplicate_end"], r["length"]) for r in report.collect()) == [("exact", 1, 2, 1), ("near", 1, 2, 1), ("near", 1, 4, 1), ("near", 2, 4, 1)]
    assert duplicates.near_pairs(rows.limit(0), ["book"], "p", "t").count() == 0
