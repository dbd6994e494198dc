"""Consistent form, page noise, repeated lines, truncation: small cases."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import consistent, lines, noise, truncation

LOOKS = [
    ("Ｃｈương １２", "Chương 12"),
    ("ｶｻﾞﾄ", "カザト"),
    ("⿊乡的⼈", "黑乡的人"),
    ("diﬃcult ﬁnd", "difficult find"),
    ("a b c", "a b c"),
    ("Lin​te‍︀r", "Linter"),
    ("Lіnthufеn", "Linthufen"),
    ("ngôi", "ngôi"),
    ("Gɑrtan", "Gartan"),
]
SAME = ["Вельмара", "Λυκαρόνη", "“引号”——……", "全角，标点：；　空格", "plain text", "各　々", "naïve café", "", "ا‌ب"]


@pytest.mark.parametrize(("text", "form"), LOOKS)
def test_form(text, form):
    assert consistent.consistent(text) == form
    assert consistent.consistent(form) == form


@pytest.mark.parametrize("text", SAME)
def test_unchanged(text):
    assert consistent.consistent(text) == text


def test_mapping_has_no_conflicts():
    for source, target in consistent.TABLE.items():
        assert not any(c in consistent.TABLE for c in target)
        assert unicodedata.normalize("NFC", target) == target, source
    for source, target in consistent.COMPOSED.items():
        assert unicodedata.normalize("NFC", source) == target and target not in consistent.COMPOSED


def test_clusters_are_composed_in_any_order():
    for form in ("ậ", "ữ", "ế", "ǭ", "각", "ガ"):
        parts = unicodedata.normalize("NFD", form)
        assert consistent.consistent(parts) == form
        assert consistent.consistent("x" + "\u200b".join(parts) + "y") == f"x{form}y"
    assert consistent.consistent("a\u0302\u0323") == "ậ" and consistent.consistent("â\u0323") == "ậ"
    assert consistent.consistent("q\u0302\u0323") == consistent.consistent("q\u0323\u0302")
    assert consistent.consistent("K Å") == "K Å"


def test_texts_of_a_batch_do_not_touch():
    texts = ["", "a", "\u0301b", "​", "ﬁ", "\0", "a" * 5, "Lіn", "", "ｶ", "ﾞ"]
    assert consistent.consistent_texts(texts) == [consistent.consistent(t) for t in texts]
    twice = consistent.consistent_texts(consistent.consistent_texts(texts))
    assert twice == consistent.consistent_texts(texts)


def test_changed_lines(spark):
    rows = [(1, "ok\nｂad\n\nfi​ne"), (2, None), (3, ""), (4, "plain\nВельмара"), (1, None), (5, "x y")]
    pages = spark.createDataFrame(rows, "result_id long, markdown string").withColumn("rec_id", F.lit("clash")).withColumn("after", F.lit(1))
    got = sorted((r["rec_id"], r["item_no"]) for r in consistent.changed_lines(pages, "result_id", "markdown").collect())
    assert got == [(1, 2), (1, 4), (5, 1)]
    assert consistent.changed_lines(pages.limit(0), "result_id", "markdown").count() == 0
    form = {r["result_id"]: r["f"] for r in pages.where("result_id in (2, 5)").select("result_id", consistent.consistent_form(F.col("markdown")).alias("f")).collect()}
    assert form == {2: None, 5: "x y"}


def test_changed_names(spark):
    rows = [(7, [("A", "A"), ("Ｂ", None), (None, "C​"), (None, None)]), (8, None), (9, [])]
    contexts = spark.createDataFrame(rows, "context_id long, proper_names array<struct<seen:string,canonical:string>>")
    assert sorted((r["rec_id"], r["item_no"]) for r in consistent.changed_names(contexts).collect()) == [(7, 2), (7, 3)]


def test_repeated_lines(spark):
    note = "Share this page: {}"
    rows = [(i, "a", f"own text of page number {'abcdefghijkl'[i]}\n{note.format(i)}\nnext") for i in range(12)]
    rows += [(100 + i, "b", note.format(i)) for i in range(4)]  # too few records
    rows += [(200, "a", None), (201, None, note.format(1)), (202, "a", ""), (0, "a", rows[0][2]), (33000, "a", "ＳＨＡＲＥ ｔｈｉｓ page")]
    pages = spark.createDataFrame(rows, "id long, site string, text string").withColumn("key", F.lit(0)).withColumn("bucket", F.lit(0))
    got = sorted((r["id"], r["line_no"]) for r in lines.repeated_lines(pages, "id", "site", "text").collect())
    assert got == [(i, 2) for i in range(12)] + [(33000, 1)]
    cleaned = {r["id"]: r["text"] for r in lines.without_repeated_lines(pages, "id", "site", "text").where("id in (1, 200, 100)").collect()}
    assert cleaned == {1: "own text of page number b\nnext", 200: None, 100: note.format(0)}
    assert lines.repeated_lines(pages.limit(0), "id", "site", "text").count() == 0


def test_share_of_a_site(spark):
    rows = [(i, "a", "a line that is repeated" if i < 5 else f"{chr(97 + i % 26)}{chr(97 + i // 26)} is a line of its own") for i in range(130)]
    pages = spark.createDataFrame(rows, "id long, site string, text string")
    assert lines.repeated_lines(pages, "id", "site", "text").count() == 0  # 5 of 130 are under 4 %
    assert lines.repeated_lines(pages.limit(125), "id", "site", "text").count() == 5


def test_viterbi_agrees_with_all_paths():
    rng = np.random.default_rng(1)
    draw = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = noise.Model(draw(5), draw(5, 5), draw(5), draw(5, noise.SYMBOLS))
    pages = [list(rng.integers(0, noise.SYMBOLS, n)) for n in (1, 2, 4, 0, 3)]

    def best(page):
        from itertools import product

        score = lambda s: model.first[s[0]] + sum(model.then[a, b] for a, b in zip(s, s[1:])) + sum(model.emits[a, y] for a, y in zip(s, page, strict=True)) + model.last[s[-1]]
        return max(product(range(5), repeat=len(page)), key=score) if page else ()

    assert [tuple(x) for x in model.label(pages)] == [best(p) for p in pages]


NOISE_ROWS = [
    (1, "b", 1, "The Long Road\n\nthe traveller walked along the ri-\nver and the tra¬\nveller slept.\n\n- 12 -"),
    (2, "b", 1, "The L0ng Road\n\nthe river was wide.\n\n13"),
    (3, "b", 1, None),
    (4, "b", 1, ""),
    (5, None, None, "# The Long Road\nthe end of the river.\nit was wide.\nit was slow.\n2\nthe traveller\nslept there.\nthe end came."),
]


def noise_tables(spark, rows):
    pages = spark.createDataFrame(rows, "result_id long, book_id string, volume int, markdown string").withColumn("scan_site", F.lit(None).cast("string")).withColumn("text", F.lit("clash"))
    books = spark.createDataFrame([("b", 1, "The Long Road"), ("c", 1, None)], "book_id string, volume int, title string")
    contexts = spark.createDataFrame([("b", 1, None, None)], "book_id string, volume int, title string, table_of_contents array<struct<title:string,page:int>>")
    overrides = spark.createDataFrame([], "result_id long, markdown string")
    return pages, books, contexts, overrides


def test_labels_come_from_the_proofread_text():
    """A number that stays in its place is body, whatever its shape, and a title's line that was dropped a header."""
    lines = ["The Long Road", "the traveller walked along the river and slept.", "12", "the wind came from the east that night.", "", "Share this page with friends", "13"]
    proof = "the traveller walked along the river and slept. 12 the wind came from the east that night."
    states = noise.known_labels(lines, ["thelongroad"], proof)
    assert states == [noise.HEADER, noise.BODY, noise.BODY, noise.BODY, noise.BREAK, noise.NOTICE, noise.NUMBER]
    assert noise.known_labels([""], [], "") == [noise.BREAK]


def test_line_noise(spark):
    got = sorted((r["result_id"], r["line_no"], r["kind"]) for r in noise.line_noise(*noise_tables(spark, NOISE_ROWS)).collect())
    assert got == [(1, 1, "header"), (1, 3, "hyphen"), (1, 4, "hyphen"), (1, 7, "page_number"), (2, 1, "header"), (2, 5, "page_number")]


def test_misread_words_and_repair(spark):
    rows = [(i, "b", 1, "the traveller walked along the river and the traveller slept.") for i in range(30)] + [(99, "b", 1, "the travel1er walked along thc river."), (100, "b", 1, None)]
    tables = noise_tables(spark, rows)
    found = [(r["result_id"], r["line_no"], r["kind"]) for r in noise.line_noise(*tables).collect()]
    assert found == [(99, 1, "misread")]
    repaired = {r["result_id"]: r["markdown"] for r in noise.repaired_pages(*tables).where("result_id >= 99").collect()}
    assert repaired == {99: "the traveller walked along the river.", 100: None}
    empty = noise_tables(spark, NOISE_ROWS[2:4])
    assert noise.line_noise(*empty).count() == 0


def test_truncated(spark):
    whole = "The river was wide and slow. The traveller walked along it for many days."
    rows = [(1, whole), (2, whole[:50]), (3, whole[:50] + "…"), (4, whole + "\n\n### A heading"), (5, None), (6, ""), (7, " \n"), (8, whole + " (The end.)"), (9, "关于云口的计划，芷穗认为它比灯塔更"), (10, "关于云口的计划，芷穗认为它比灯塔更高大。"), (11, whole[:-8] + "&#"), (12, whole + "\n\nOllodra, Sorolbri, 1958")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("cut", F.lit("clash"))
    found = truncation.truncated(docs)
    assert sorted(r["doc_id"] for r in found.collect()) == [2, 3, 9, 11]
    assert truncation.truncated(docs.limit(0)).count() == 0
    rate = truncation.truncation_rates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")), found).first()
    assert (rate["source"], rate["texts"], rate["truncated"]) == (None, 9, 4)


def test_near_copy_that_ends_early(spark):
    body = " ".join(f"word{i} goes here." for i in range(60))
    docs = spark.createDataFrame([(1, "- " + body.replace(".", "") + " and then more words"), (2, "- " + body.replace(".", "") + " and then")], "doc_id long, text string")
    assert [r["doc_id"] for r in truncation.early_ends(docs).where("early").collect()] == [2]


def test_equal_cut_texts_have_one_verdict(spark):
    body = "- " + " ".join(f"word{i} goes here" for i in range(60))
    docs = spark.createDataFrame([(1, body + " and then more words."), (2, body + " and then"), (3, body + " and then"), (4, body + " and then")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in truncation.early_ends(docs).where("early").collect()) == [2, 3, 4]
    assert sorted(r["doc_id"] for r in truncation.truncated(docs).collect()) == [2, 3, 4]


def test_both_stages_decide(spark):
    """A cut list item and a whole one by their near copies, prose by the marks that close its lines."""
    item = "- " + " ".join(f"word{i} goes here" for i in range(60))
    prose = [(100 + i, f"The river {i} was wide, and slow. It was late, they said!\nIt was early; the wind was cold.") for i in range(40)]
    cut = [(1, item + " and then it goes here"), (2, item + " and then it"), (3, "It was late. The traveller, they said,"), (4, "It was late. The traveller slept"), (5, "It was late. They slept!")]
    docs = spark.createDataFrame(prose + cut, "doc_id long, text string").withColumn("stage", F.lit("clash"))
    got = {r["doc_id"]: (r["cut"], r["stage"]) for r in truncation.verdicts(docs).where("doc_id < 100").collect()}
    assert got == {1: (False, "closing-word"), 2: (True, "alignment"), 3: (True, "closing-word"), 4: (True, "closing-word"), 5: (False, "closing-word")}
    scores = {r["doc_id"]: r["terminality"] for r in truncation.verdicts(docs).collect()}
    assert scores[3] < truncation.TERMINAL and scores[4] < truncation.TERMINAL < scores[100]


def test_fragments_by_rates(spark):
    """A fragment that other texts hold too, at the end of a verse line and of a heading."""
    rows = [(i, f"They came home from the adventure number {i} near the river.\nIt was late.") for i in range(300)]
    rows += [(1000, "They told the adventur of old.\nIt was late."), (1001, "Soft blows the wind\nand long is the adventur"), (1002, "It was late.\n\n# The Long Adventur"), (1003, "It was late.\n\n# The Long River"), (1004, "Soft blows the wind\nand long is the river")]
    rows += [(1005, rows[-4][1])]
    found = truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == [1001, 1002, 1005]


def test_alignment_of_ends():
    verse = "\n".join(f"- the {a} wind blows over the {b} hill" for a in ("cold", "warm", "old", "young", "slow") for b in ("green", "grey", "white"))
    refrain = "\n- and nobody knows where it goes"
    copy = verse + refrain + " again tonight\n- the sun is high above us" + refrain
    assert truncation.stops_early(verse + refrain, copy) is True  # the refrain returns at the copy's end
    assert truncation.stops_early(verse + "\n- and nobody knaws wher", copy) is True  # an edit near the end
    assert truncation.stops_early(verse + "\n- and nobody knaws where it goes again tonight", copy) is False
    assert truncation.stops_early(copy, verse + refrain) is None
    assert truncation.stops_early(verse, verse) is None


def test_soft_hyphens_at_line_ends(spark):
    text = "the traveller walked along the tra\u00ad\nveller river. the end\u00ad\n\nthe ri\u00adver was wide."
    tables = noise_tables(spark, [(1, None, None, text)])
    assert [(r["result_id"], r["line_no"], r["kind"]) for r in noise.line_noise(*tables).collect()] == [(1, 1, "hyphen")]
    assert noise.repaired_pages(*tables).first()["markdown"] == "the traveller walked along the traveller river. the end\n\nthe river was wide."


def test_numbers_beyond_the_broadcast_ones(spark):
    """cast is a word though east is far more frequent; eart is a misread cart, which is rare itself."""
    lines = ["the wind came from the east."] * 400 + ["a cast came."] * 14 + ["my cart rolls."] * 13 + ["my eart rolls."]
    tables = noise_tables(spark, [(i, None, None, line) for i, line in enumerate(lines)])
    whole = sorted(map(tuple, noise.line_noise(*tables).collect()))
    assert sorted(map(tuple, noise.line_noise(*tables, limit=5).collect())) == whole
    assert not {400, 413} & {r[0] for r in whole}
    repaired = sorted(map(tuple, noise.repaired_pages(*tables).collect()))
    assert sorted(map(tuple, noise.repaired_pages(*tables, limit=5).collect())) == repaired


def test_numbers_of_sections_have_other_features_than_page_numbers():
    titles = ["chapteronetheriver"]
    page = ["Chapter one: the river", "", "12", "", "It was late.", "", "3", "", "No one came.", "", "— 13 —"]
    symbols = noise.line_symbols(page, titles)
    shape_near = {i: divmod((symbols[i] - 1) // 2, 4) for i in (0, 2, 6, 10)}
    # the title at the edge does not move the number from it; the section's number is two lines away
    assert shape_near == {0: (2, 0), 2: (1, 0), 6: (1, 2), 10: (7, 0)}
    assert all(0 <= s < noise.SYMBOLS for s in symbols)
    assert noise.line_symbols(["", "7", ""], []) == [0, 1 + (1 * 4 + 0) * 2 + 1, 0]
