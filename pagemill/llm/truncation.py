"""Texts that were cut off.

Near copies are found through MinHash bands on word shingles and aligned from their ends: of a pair in which one text
goes on where the other stops, the latter ended early. All other texts are judged by the terminality of their closing
word: of all places where a word with the same marks behind it stands in lines of the same kind (prose, heading, list
item, short line), the share at which it closes the line. It is learned from all lines of the corpus that another one
follows, and that are whole therefore.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .arrays import WindowHash, chunks, code_points
from .near import similar_classes

SIMILARITY, WORDS = 0.8, 5
#: Characters of the windows that anchor an alignment.
ANCHOR = 12
#: A fragment stands as a word of its own in at most FRAGMENT of the words that begin like it, and closes a line in at
#: most CLOSING of them; fewer than EVIDENCE such words tell nothing.
FRAGMENT, CLOSING, EVIDENCE = 0.01, 0.002, 8
#: A closing word of less terminality breaks off. Before any line is seen, marks that end a sentence and words without
#: marks in lines that are no prose have LIKELY, others UNLIKELY, which counts as PRIOR places.
TERMINAL, LIKELY, UNLIKELY, PRIOR = 0.01, 0.25, 0.005, 20

# Marks that end a sentence, marks that may follow them, and notes behind an ended text.
STOPS = "。！？．｡.!?‼⁇⁈⁉؟।…"
CLOSERS = "”’\"'»›」』）)]】》〉〕*_`~"
END_NOTES = r"[(（\[【]\s*(?:完|终|終|全文完|未完待续|おわり|了|the end\.?|end|fin|hết|\d{1,3})\s*[)）\]】]"

#: What a cut may leave behind the text: half an entity, half a tag, broken bytes, a sign of the cut, white space.
REMAINS = re.compile(
    r"(?:&#?\w{0,8}|</?[A-Za-z]?[^<>\n]{0,80}|�+|\s+|(?<![…‥])[…‥]|(?<!\.)\.{3}|\[(?:…|\.{3}|truncated|cut|more)?\]?|[（(](?:more|continued|cut|未完|续|truncated)[）)]?)$",
    re.IGNORECASE,
)
_NOTE = re.compile(rf"{END_NOTES}$", re.IGNORECASE)
_LIST = re.compile(r"(?:[-*+•·–—]|\d{1,3}[.)、]|[(（]?[一二三四五六七八九十]{1,3}[)）、])\s*\S")
_NOTE_LINE = re.compile(r"\[\^[^\]]{1,12}\]:")
_SIGNED = re.compile(r"(?<!\d)1[5-9]\d\d(?!\d)|(?<!\d)20\d\d(?!\d)")
_PAUSE = re.compile(r"[，。；：、！？,;:!?「」“”]|\.\s")
_LAST = re.compile(r"[^\W_]+\W*$")

PROSE, HEADING, ITEM, SHORT = range(4)


def line_kind(line: str, short_text: bool) -> int:
    """short_text: most lines of the text are short and unpunctuated, as in verse."""
    body = line.strip()
    if body.startswith("#"):
        return HEADING
    if _NOTE_LINE.match(body):
        return PROSE
    if _LIST.match(body) and not re.search(r"[。！？!?]|\.\s", body):
        return ITEM
    if not _PAUSE.search(body.replace(", ", " ")) and len(body) <= 60 and (short_text or _SIGNED.search(body)):
        return SHORT
    if len(body) <= 60 and _SIGNED.search(body) and not re.search(r"[。！？!?“”「」]|\.\s", body) and len(re.findall(r"[,，、]", body)) <= 2 and line_is_signature(body):
        return SHORT
    return PROSE


def line_is_signature(body: str) -> bool:
    """A name, a place and a year: no word of it starts with a small letter, but for the word for the year."""
    words = re.findall(r"[^\W\d_]+", body)
    return len(words) <= 9 and sum(w[0].islower() for w in words) <= 1


def closing_word(line: str) -> str:
    """The last word with the marks behind it; of a script without spaces, its last two characters."""
    body = line.rstrip()
    found = _LAST.search(body)
    word = found[0] if found else body[-2:]
    if found:
        letters = re.match(r"[^\W_]+", word)[0]
        if letters[-1] > "⺀":
            word = letters[-2:] + word[len(letters) :]
    return word[-40:].casefold()


def ended(text: str) -> bool:
    """Whether the text ends in a mark that ends a sentence, or in a note that only follows an ended text."""
    body, noted = without_notes(text)
    return noted or stops(body)


def stops(text: str) -> bool:
    """Whether a mark that ends a sentence stands at the end, before marks that close something."""
    body = text.rstrip()
    while body and body[-1] in CLOSERS:
        body = body[:-1].rstrip()
    return bool(body) and body[-1] in STOPS


def without_notes(text: str) -> tuple[str, bool]:
    """The text without notes at its end, and whether they follow an ended text."""
    body, noted = text.rstrip(), False
    while note := _NOTE.search(body.rstrip(CLOSERS) if not _NOTE.search(body) else body):
        body = body[: note.start()].rstrip()
        noted |= bool(body) and body[-1] not in ",，、;；:："
    return body, noted


_MARK_RUN = re.compile(r"[^\w\s]{1,3}(?=\s*\w)")
_TAIL = re.compile(r"[^\w\s]{0,3}$")


def marks_of(line: str) -> tuple[str, bool]:
    """The last marks of a line, and whether its last letter is of a script without spaces."""
    body = line.rstrip()
    found = _LAST.search(body)
    letter = re.match(r"[^\W_]+", found[0])[0][-1] if found else body[-1:]
    return _TAIL.search(body)[0], letter > "⺀"


def without_remains(text: str) -> tuple[str, bool]:
    """The text without what a cut left behind it, and whether that was more than white space."""
    body, marked = text, False
    while body and (found := REMAINS.search(body)):
        marked |= bool(found[0].strip())
        body = body[: found.start()]
    return body, marked


def _lines_of(text: str) -> tuple[list[str], bool]:
    lines = [x for x in text.split("\n") if x.strip()]
    short = sum(len(x) <= 40 and not _PAUSE.search(x) for x in lines if not x.startswith(("#", "-")))
    return lines, short * 2 > max(1, sum(not x.startswith(("#", "-")) for x in lines))


_ENDS_SCHEMA = "doc_id long, kind int, word string, tail string, wide boolean, noted boolean, stops boolean, marked boolean, small boolean, closes long, occurs long"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to those of their ends (doc_id, kind, word, tail, wide, noted, stops, marked, small), and,
    without a doc_id, of all lines that another line follows: (kind, word, closes), and for the marks of their words
    (kind, tail, wide, closes, occurs)."""
    names = [part.split()[0] for part in _ENDS_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    for batch in batches:
        rows: list[tuple] = []
        words: dict[tuple[int, str], int] = {}
        closes: Counter = Counter()
        occurs: Counter = Counter()
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            body, marked = without_remains(text)
            lines, short = _lines_of(body)
            if not lines:
                continue
            whole = lines if body.endswith("\n") and not marked else lines[:-1]
            for line in whole:
                kind = line_kind(line, short)
                if kind != PROSE:
                    key = (kind, closing_word(line))
                    words[key] = words.get(key, 0) + 1
                tail, wide = marks_of(line)
                closes[kind, tail, wide] += 1
                occurs[kind, "", wide] += len(line) if wide else line.count(" ") + 1
                for run in _MARK_RUN.findall(line):
                    occurs[kind, run, wide] += 1
            last, noted = without_notes(lines[-1])
            tail, wide = marks_of(last)
            small = bool(re.search(r"[^\W\d_]+\W*$", lines[-1]) and lines[-1].split()[-1][:1].islower())
            rows.append((i, line_kind(lines[-1], short), closing_word(lines[-1]), tail, wide, noted, stops(last), marked, small, 0, 0))
        rows += [(None, kind, word, None, None, None, None, None, None, n, None) for (kind, word), n in words.items()]
        for kind, tail, wide in occurs | closes:
            n = closes[kind, tail, wide]
            # the mark at a line's end is one of its places
            rows.append((None, kind, None, tail, wide, None, None, None, None, n, occurs[kind, tail, wide] + n))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to hashes of words and of their beginnings, in scripts without spaces of two characters: how often
    they occur, how often no letter follows, and how often longer words begin so: (hash, n, whole, longer). The last
    one of each text is not counted, since a cut may have made it."""
    for batch in batches:
        column = batch.column("text").to_pylist()
        for lo, hi in chunks(column):
            points, starts, _ = code_points([t.casefold() for t in column[lo:hi]])
            wide = points >= 0x2E80
            alnum = _alnum()[np.minimum(points, 0xFFFF)]
            narrow = alnum & ~wide
            start = narrow.copy()
            start[1:] &= ~narrow[:-1]
            end = narrow.copy()
            end[:-1] &= ~narrow[1:]
            pair = _without_last(np.flatnonzero(wide[1:] & wide[:-1] & alnum[1:] & alnum[:-1]), starts)
            h = WindowHash(points)
            words, ends = _without_last(np.flatnonzero(start), starts), _without_last(np.flatnonzero(end) + 1, starts + 1)
            word_hashes, first, times = np.unique(h.of(words, ends), return_index=True, return_counts=True)
            # each beginning of each distinct word
            size = (ends - words)[first] - 1
            at = np.repeat(words[first], size)
            length = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + 1
            hashes = np.concatenate([word_hashes, h.of(pair, pair + 2), h.of(at, at + length)]).view(np.int64)
            none = np.zeros(len(at), np.int64)
            # every text ends in a 0, so that a character behind a pair exists
            counts = [
                np.concatenate([times, np.ones(len(pair), np.int64), none]),
                np.concatenate([times, ~alnum[pair + 2], none]),
                np.concatenate([np.zeros(len(times) + len(pair), np.int64), np.repeat(times, size)]),
            ]
            found, back = np.unique(hashes, return_inverse=True)
            sums = [np.bincount(back, weights=c, minlength=len(found)).astype(np.int64) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], ["hash", "n", "whole", "longer"])


def _without_last(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """places without the last one of each text."""
    text = np.searchsorted(starts, places, "right")
    return places[:-1][text[1:] == text[:-1]]


_ALNUM: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000))
    return _ALNUM[0]


@F.pandas_udf(T.LongType())
def _word_hash(words: pd.Series) -> pd.Series:
    """The hash of the letters of closing words, as in _words."""
    letters = [m[0] if (m := re.match(r"[^\W_]+", w)) else "" for w in words]
    points, starts, lengths = code_points(letters)
    return pd.Series(WindowHash(points).of(starts, starts + lengths).view(np.int64))


def judged_ends(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). (doc_id, cut, terminality): whether the text breaks off, by its closing word."""
    facts = materialize(docs.select("doc_id", "text").mapInArrow(_facts, _ENDS_SCHEMA), "ends")
    ends = facts.where("doc_id is not null").drop("closes", "occurs")
    of_marks = ["kind", "wide", "tail"]
    marks = facts.where("doc_id is null and word is null").groupBy(*of_marks).agg(F.sum("closes").alias("mark_closes"), F.sum("occurs").alias("mark_occurs"))
    prior = F.when(F.col("stops") | ((F.col("kind") != PROSE) & (F.col("tail") == "")), LIKELY).otherwise(UNLIKELY)
    terminality = (F.coalesce("mark_closes", F.lit(0)) + PRIOR * prior) / (F.coalesce("mark_occurs", F.lit(0)) + PRIOR)
    scored = ends.join(marks, of_marks, "left").withColumn("terminality", terminality)
    # a note stands behind an ended text only, and a mark that ends a sentence behind a whole word
    closed = F.col("noted") | (F.col("stops") & (F.col("terminality") >= TERMINAL))
    open_ends = scored.where(~closed)
    closes = facts.where("doc_id is null and word is not null").groupBy("word").agg(F.sum("closes").alias("closes"))
    asked = open_ends.where(F.col("terminality") >= TERMINAL).select("word").distinct().withColumn("hash", _word_hash("word"))
    counted = docs.select("text").mapInArrow(_words, "hash long, n long, whole long, longer long").groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("n", "whole", "longer")))
    rated = open_ends.join(closes, "word", "left").join(counted.join(asked, "hash").drop("hash"), "word", "left").fillna(0, ["closes", "n", "whole", "longer"])
    # a closing word of little terminality breaks off; another one does, if a sign of the cut stands behind it, or if it
    # hardly ever closes a line and is a part of longer words, or is no word at all; all by rates, which do not depend on
    # the corpus's size. A single capital letter may be an initial
    part = (F.col("n") >= EVIDENCE) & (F.col("whole") < F.col("n") * 0.01) & (F.col("closes") <= F.col("n") * CLOSING) & ~F.col("alphabetic")
    fragment = F.col("alphabetic") & (F.col("longer") >= EVIDENCE) & (F.col("n") <= F.col("longer") * FRAGMENT) & (F.col("closes") <= F.col("longer") * CLOSING) & (F.col("small") | (F.length("word") > 1))
    unknown = F.col("alphabetic") & (F.col("kind") != HEADING) & (F.col("n") == 0) & (F.col("closes") == 0) & F.col("small")
    rated = rated.withColumn("alphabetic", F.col("word").rlike("^[\\p{L}\\p{M}&&[\\u0000-\\u2E7F]]+$"))
    cut = (F.col("terminality") < TERMINAL) | F.col("marked") | part | fragment | unknown
    return rated.select("doc_id", cut.alias("cut"), "terminality").unionByName(scored.where(closed).select("doc_id", F.lit(False).alias("cut"), "terminality"))


def aligned_end(own: str, other: str) -> tuple[int, bool] | None:
    """Where own ends in other, and whether the last characters are equal. Windows that occur once in each text are
    anchors, of which the longest chain in the order of both counts; what own has behind the last one is aligned with
    the least number of edits. None if the end has no counterpart."""
    if other.startswith(own):
        return len(own), True
    points, starts, lengths = code_points([own, other])
    if lengths.min() < ANCHOR:
        return None
    windows = WindowHash(points).windows(ANCHOR)
    once = []
    for at, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        found, first, times = np.unique(windows[at : at + n - ANCHOR + 1], return_index=True, return_counts=True)
        once.append((found[times == 1], first[times == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    if not len(i):
        return None
    mine, theirs = once[0][1][i], once[1][1][j]
    order = np.argsort(mine)
    last = _chain_end(theirs[order])
    a, b = int(mine[order][last]) + ANCHOR, int(theirs[order][last]) + ANCHOR
    while a < len(own) and b < len(other) and own[a] == other[b]:
        a, b = a + 1, b + 1
    rest = own[a:]
    if not rest:
        return b, True
    if len(rest) > max(4 * ANCHOR, len(own) // 4):  # more than near copies differ in
        return None
    row = np.arange(min(len(other) - b, 2 * len(rest)) + 1)
    against, steps = points[starts[1] + b : starts[1] + b + len(row) - 1], np.arange(len(row))
    for c in map(ord, rest):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (against != c))
        row = np.minimum.accumulate(new - steps) + steps
    least = int(row.min())
    return (b + int(np.flatnonzero(row == least)[-1]), False) if least * 2 <= max(len(rest), 6) else None


def _chain_end(places: np.ndarray) -> int:
    """The index of the last one of a longest rising chain of places."""
    if (places[1:] > places[:-1]).all():
        return len(places) - 1
    tops: list[int] = []
    ends: list[int] = []
    for k, place in enumerate(places.tolist()):
        at = bisect_left(tops, place)
        if at == len(tops):
            tops.append(place)
            ends.append(k)
        else:
            tops[at], ends[at] = place, k
    return ends[-1]


def stops_early(own: str, other: str) -> bool | None:
    """Whether own stops where its near copy goes on within a sentence; None if the copy does not tell: the end is not
    found in it, it ends at the same place, or a line of prose goes on in the next one."""
    body, _ = without_remains(own)
    found = aligned_end(body, other)
    if not body or found is None:
        return None
    at, equal = found
    rest = other[at:]
    if not without_remains(rest)[0].strip():
        return None
    line = rest.split("\n", 1)[0]
    if line.strip() and (equal or len(re.findall(r"[^\W_]", line)) > 1):
        return not ended(body)
    lines, short = _lines_of(body)
    return None if line.strip() or re.match(r"[^\S\n]*\n\S", rest) and line_kind(lines[-1], short) == PROSE else False


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id_a, id_b, text_a, text_b) of near copies to (doc_id, early): whether the text stops where its copy goes
    on within a sentence."""
    for batch in batches:
        out: list[tuple[int, bool]] = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("id_a", "id_b", "text_a", "text_b")), strict=True):
            for i, own, other in ((a, x, y), (b, y, x)):
                if (early := stops_early(own, other)) is not None:
                    out.append((i, early))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([e for _, e in out], pa.bool_())], ["doc_id", "early"])


def early_ends(docs: DataFrame, classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """docs: (doc_id, text). (doc_id, early) of texts with a near copy in which their end was found; equal texts have
    the verdict of their class. classes: those of docs, if they are known (similar_classes)."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    members, pairs = classes or near_copies(docs)
    pairs = materialize(pairs.select("id_a", "id_b"), "copies")
    wanted = texts.join(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "id", "left_semi")
    verdicts = (
        pairs.join(wanted.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
        .join(wanted.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
        .select("id_a", "id_b", "text_a", "text_b")
        .mapInArrow(_aligned, "doc_id long, early boolean")
        .groupBy("doc_id")
        .agg(F.bool_or("early").alias("early"))
    )
    return of_all_members(materialize(verdicts, "early"), members)


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return similar_classes(docs.select(F.col("doc_id").alias("id"), "text"), SIMILARITY, "words", WORDS)


def of_all_members(verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """verdicts: (doc_id, ...) of the first texts of classes; the same of each text of these classes."""
    others = members.where("id <> class_id").distinct()
    return verdicts.unionByName(verdicts.withColumnRenamed("doc_id", "class_id").join(others.withColumnRenamed("id", "doc_id"), "class_id").drop("class_id"))


def verdicts(docs: DataFrame) -> DataFrame:
    """docs: doc_id BIGINT, text. (doc_id, cut, stage, terminality) of every text that is not blank: whether it breaks
    off inside a word or sentence, decided by the stage alignment where an alignment with a near copy finds its end,
    either way, and by the stage closing-word else; equal texts are judged and counted once. Null, empty and blank texts
    have none; a row given twice has one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text rlike '\\\\S'")
    members, pairs = near_copies(texts)
    firsts = texts.join(members.where("id <> class_id").select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    found = judged_ends(firsts).join(early_ends(firsts, (members.limit(0), pairs)), "doc_id", "full")
    stage = F.when(F.col("early").isNotNull(), "alignment").otherwise("closing-word")
    judged = found.select("doc_id", F.coalesce("early", "cut").alias("cut"), stage.alias("stage"), "terminality").dropDuplicates(["doc_id"])
    return of_all_members(materialize(judged, "cut"), members)


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id) of texts that break off, by verdicts."""
    return verdicts(docs).where("cut").select("doc_id")


def truncation_rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each source (null is one): (source, texts, truncated, rate) among its documents with a text."""
    texts = docs.where("text rlike '\\\\S'").select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    marked = texts.join(found.withColumn("cut", F.lit(1)), "doc_id", "left")
    return marked.groupBy("source").agg(F.count("*").alias("texts"), F.coalesce(F.sum("cut"), F.lit(0)).cast("long").alias("truncated")).withColumn("rate", F.col("truncated") / F.col("texts"))
