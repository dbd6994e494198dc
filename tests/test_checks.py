"""Small cases of the checks on markup, paths, archives and inventories, and of files as tables."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.operators import audit, conservation, markup
from pagemill.sources import files


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_markup_rules(spark):
    texts = spark.createDataFrame([(1, "<SVG:SCRIPT/><p OnLoad='x()' STYLE=\"a:url(http://h/x)\">"), (2, "visible onclick= words"), (3, "<a href='page.html#x'><img src=//host/y>"), (4, None), (5, "")], "id int, text string").withColumn("place", F.lit(0))
    found = markup.markup_rules(markup.elements(texts, ["id"], "text"), ["id"])
    assert rows(found, "id", "rule") == [(1, "active-element"), (1, "css-external"), (1, "event-attribute"), (1, "style-attribute"), (3, "external-reference")]


def test_resolved_references(spark):
    cases = [("a/b.x", "../c.png", "c.png"), ("a/b.x", "../../c", ""), ("a/b.x", "/c", ""), ("a/b.x", "http://h/c", None), ("a/b.x", "#f", "a/b.x"), ("a/b.x", "c%20d+e?q#f", "a/c d+e"), ("b.x", "./c/../d", "d"), ("a/b.x", "bad%", "a/bad%")]
    got = spark.createDataFrame(cases, "base string, ref string, want string").withColumn("got", markup.resolved(F.col("base"), F.col("ref")))
    assert [(r["ref"], r["got"]) for r in got.collect()] == [(r, w) for _, r, w in cases]


def test_anchors(spark):
    expected = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "k string, page int")
    anchors = spark.createDataFrame([("b", 3, 1), ("b", 1, 2), ("b", 1, 3), ("b", 9, 4)], "k string, page int, place int")
    got = {r["rule"]: list(r["pages"]) for r in markup.anchor_violations(expected, anchors, ["k"]).collect()}
    assert got == {"missing": [2], "repeated": [1], "extra": [9], "order": [1]}
    assert markup.anchor_violations(expected.limit(0), anchors.limit(0), ["k"]).count() == 0


def test_empty_anchors(spark):
    table = [("d", 1, "heading", None), ("d", 2, "heading-anchor", 1), ("d", 3, "anchor", 2), ("d", 4, "content", None), ("d", 5, "anchor", 3), ("d", 6, "heading-anchor", 4)]
    found = markup.empty_anchors(spark.createDataFrame(table, "k string, place int, kind string, page int"), ["k"])
    assert rows(found, "page") == [(3,), (4,)]


def test_paths(spark):
    cases = [(".env", "denied-artifact-path"), ("a/x.PDF", "denied-artifact-path"), ("Work/a.txt", "denied-runtime-directory"), ("a/b.budget-state.json", "denied-artifact-path"), ("a/b.txt", None), (".pdf", None), (None, None)]
    got = spark.createDataFrame([(p,) for p, _ in cases], "p string").select(audit.denied_path(F.col("p")).alias("r")).collect()
    assert [r["r"] for r in got] == [r for _, r in cases]
    names = [("a/b", False, False), ("a/", True, False), ("a//", True, True), ("../a", False, True), ("/a", False, True), ("", False, True), ("a\\b", False, True), (None, False, True)]
    got = spark.createDataFrame(names, "n string, d boolean, want boolean").select(audit.unsafe_member(F.col("n"), F.col("d")).alias("u"), "want").collect()
    assert all(r["u"] == r["want"] for r in got)


def test_size_limit_counts_members_that_are_too_large(spark):
    members = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("b", 1, 100), ("b", 2, 1), ("c", 1, None)], "path string, ordinal int, size long")
    found = audit.size_findings(members, ["path"], ["ordinal"], "size", 50, 7)
    assert rows(found.where("rule is not null"), "path", "ordinal") == [("a", 2), ("b", 1), ("b", 2)]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x", "y")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok/", "")
        z.writestr("ok/t.txt", "token gh" + "p_" + "a" * 24)
        z.writestr("../up", "x")
        z.writestr("n.zip", inner.getvalue())
        z.writestr("work/s", "x")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        link = tarfile.TarInfo("l")
        link.type = tarfile.SYMTYPE
        t.addfile(link)
    (tmp_path / "plain.txt").write_text("Bearer " + "a" * 20)
    (tmp_path / "._plain.txt").write_text("junk")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04broken")
    members = files.archive_members(spark, str(tmp_path))
    got = rows(files.archive_findings(members).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).fillna("", ["member"]), "name", "member", "rule")
    assert got == [("a.zip", "../up", "unsafe-archive-path"), ("a.zip", "n.zip", "nested-archive-not-allowed"), ("a.zip", "ok/t.txt", "github-token"), ("a.zip", "work/s", "denied-runtime-directory"), ("b.tgz", "l", "archive-link-not-allowed"), ("plain.txt", "", "bearer-value")]


def test_files(spark, tmp_path):
    for name, text in (("page_10.png", "x"), ("page_9.png", "y"), ("page_2.jpg", "z"), ("._page_9.png", "junk"), ("page_2.md", "done"), ("page_9.md", "")):
        (tmp_path / name).write_text(text)
    images, texts = files.files(spark, str(tmp_path), "*.png,*.jpg"), files.files(spark, str(tmp_path), "*.md")
    assert rows(files.pending_files(images, texts), "place", "name") == [(1, "page_9.png"), (2, "page_10.png")]
    assert rows(files.pending_files(images, texts, first=1), "name") == [("page_9.png",)]
    assert rows(files.page_texts(spark, str(tmp_path)), "source_page", "text")[0] == (2, "done")
    assert files.file_digests(spark, str(tmp_path), "*.jpg").first()["sha256"] == "594e519ae499312b29433b7dd8a97ff068defcba9755b6d5d00e84c524d67b06"


def test_ledgers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"event":"started","ledger_id":"a"}\n{broken\n')
    got = files.read_ledger(spark, str(tmp_path / "l.jsonl"), refuse=False).collect()
    assert [(r["ledger_id"], r["broken"]) for r in got] == [("a", None), (None, "{broken")]
    with pytest.raises(Exception):
        files.read_ledger(spark, str(tmp_path / "l.jsonl")).collect()


def test_inventories(spark, tmp_path):
    page = {"source_page": 1, "archive_image": "a/1.png", "ocr_image": "o/1.png", "ocr_state": "ok", "attempts": 1, "representation": "reflow"}
    head = {"schema_version": 1, "project": "p", "source_pdf": {"filename": "f", "page_count": 1, "included_pages": [1], "excluded_pages": []}, "pages": [page]}
    (tmp_path / "in" / "b").mkdir(parents=True)
    (tmp_path / "in" / "b" / "1.json").write_text(json.dumps(head))
    books, listed = files.read_manifests(spark, str(tmp_path / "in"))
    assert rows(books, "book_id", "volume") == [("b", 1)] and listed.count() == 1
    files.write_manifests(books, listed, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    with pytest.raises(FileExistsError):
        files.write_manifests(books, listed, str(tmp_path / "out"))
    head["pages"][0]["attempts"] = 7
    (tmp_path / "in" / "b" / "1.json").write_text(json.dumps(head))
    with pytest.raises(ValueError):
        files.read_manifests(spark, str(tmp_path / "in"))


def test_book_pages(spark):
    table = [("b", 1, 1, "text", "ok", "words"), ("b", 1, 2, "complex_table", "ok", "words"), ("b", 1, 3, "failed", "failed", None), ("b", 1, 4, "review", "ok", "words"), ("b", 1, 5, "text", "ok", "<!-- blank page -->"), ("b", 1, 6, "chart", "failed", "words")]
    pages = spark.createDataFrame(table, "book_id string, volume int, source_page int, page_type string, ocr_status string, text string")
    expected = spark.createDataFrame([("b", 1, p) for p in range(1, 8)], "book_id string, volume int, source_page int")
    assert rows(conservation.book_page_violations(pages, expected), "source_page", "rule") == [(4, "failed-ok"), (5, "no-text"), (6, "unwanted-text"), (7, "missing")]
    counts = conservation.book_counts(pages.where("source_page < 4")).first()
    assert tuple(counts)[2:] == (3, 2, 2, 1, 0)


def test_cache(spark):
    side = lambda table, more: spark.createDataFrame(table, f"k string, stem string, {more}")
    records = side([("b", "p1", "i1", "t1"), ("b", "p2", "i2", "t2"), ("b", "p4", "i4", "t4")], "image_sha256 string, text_sha256 string")
    texts, images = side([("b", "p1", "t1"), ("b", "p2", "changed"), ("b", "p3", "t3")], "text_sha256 string"), side([("b", "p1", "changed"), ("b", "p2", "i2"), ("b", "p3", "i3"), ("b", "p9", "i9")], "image_sha256 string")
    assert rows(conservation.cache_mismatches(records, texts, images, ["k"]), "stem", "rule") == [("p1", "image-changed"), ("p2", "text-changed"), ("p3", "no-record"), ("p4", "no-image"), ("p4", "no-text")]


def test_import_plans(spark):
    pages = spark.createDataFrame([(k, p) for k in "abc" for p in range(1, 11)], "k string, page int")
    listed = [("a", p, "image", "jpeg" if p % 2 else "png") for p in range(1, 9)] + [("a", 9, "image", "png"), ("a", 9, "smask", "png")] + [("b", p, "image", "jpeg") for p in range(1, 8)] + [("c", p, "image", "jpeg") for p in range(1, 12)]
    plans = {(r["k"], r["page"]): r["plan"] for r in conservation.import_plans(pages, spark.createDataFrame(listed, "k string, page int, kind string, encoding string"), ["k"]).collect()}
    assert plans["a", 1] == "jpeg" and plans["a", 2] == "png" and plans["a", 9] == plans["a", 10] == "render"
    assert {plans["b", p] for p in range(1, 11)} == {plans["c", p] for p in range(1, 11)} == {"whole"}


def test_unknown_fields(spark):
    raw = spark.createDataFrame([(1, '{"title":1,"x":2}'), (2, "no"), (3, None)], "id int, raw string")
    assert rows(audit.unknown_fields(raw, "id", "raw", ["title"]), "id", "field") == [(1, "x")]


def test_scratch_is_deleted(spark, tmp_path):
    with session.scratch(spark):
        kept = session.materialize(spark.range(3), "kept")
        assert kept.count() == 3
        (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_stream_of_late_and_repeated_rows(spark, tmp_path):
    from pagemill.streaming import ledger as stream

    for i, table in enumerate([[("a", "started", "2024-01-05T00:00:00Z")], [("a", "started", "2024-01-05T00:00:00Z"), ("b", "started", "2023-01-01T00:00:00Z"), (None, "started", "2024-01-05T00:00:00Z")]]):
        spark.createDataFrame(table, "ledger_id string, event string, ts_utc string").coalesce(1).write.mode("append").parquet(str(tmp_path / "request_ledger.parquet"))
    assert rows(stream.counted_days(spark, str(tmp_path)), "day", "event", "n") == [("2023-01-01", "started", 1), ("2024-01-05", "started", 1)]
