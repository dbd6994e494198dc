"""One consistent form of text that looks the same.

A transducer over grapheme clusters, compiled from tables that the Unicode data give by rule:

- single characters become others (widths, ligatures, ideograph variants, spaces, letters that stand for others), or go
  if they cannot be seen: its alphabet;
- a base with its marks, in canonical order, becomes the composed character: a trie, of which the longest match counts;
- a word that mixes scripts gets the look-alike letters of one.

The tables are checked for conflicts: a source has one target, and no target is a source again, so that a second pass
changes nothing. All texts of a batch run through it as one array of code points; only clusters with marks are looked up
in the trie, each distinct one once. Typographic quotes, dashes, the ellipsis, full-width punctuation and the
ideographic space stay, and so does a word that is wholly of another script. Line breaks stay, so that lines keep their
numbers.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks, code_points

# Latin letters and the Cyrillic and Greek ones that look the same.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲιυα", "ABEZHIKMNOPTYXovciua", strict=True))
VARIANTS = {"ɑ": "a", "ɡ": "g"}

# Characters without a look of their own besides category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))

#: Scripts in which joiners change the look of letters: Arabic, Syriac, the Indic ones and Mongolian.
JOINING = "؀-ࣿऀ-෿᠀-᢯"


LAST = 0x110000


def _single() -> dict[str, str]:
    """Single characters and what they become."""
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"two targets for {source!r}")

    for cp in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF61, 0xFFA0), *range(0xFB00, 0xFB07)]:
        if chr(cp) not in INVISIBLE:
            put(chr(cp), unicodedata.normalize("NFKC", chr(cp)))
    for cp in [*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)]:
        target = unicodedata.normalize("NFKC", chr(cp))
        if target != chr(cp):
            put(chr(cp), target)
    for cp in range(0x80, 0x3000):  # letters that are others by definition
        if chr(cp).isalpha() and len(target := unicodedata.normalize("NFC", chr(cp))) == 1 and target != chr(cp):
            put(chr(cp), target)
    for cp in range(0x80, 0x3001):
        if unicodedata.category(chr(cp)) in ("Zs", "Zl", "Zp") and cp != 0x3000:
            put(chr(cp), " ")
    for cp in [*range(0x80, 0x3000), 0xFEFF, *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE0080)]:
        if unicodedata.category(chr(cp)) == "Cf" and not 0x600 <= cp <= 0x8FF:
            put(chr(cp), "")
    for c in INVISIBLE:
        put(c, "")
    return table


def _composed() -> dict[str, str]:
    """Bases with their marks, and Hangul letters, to the composed characters; marks stand in canonical order, and some
    may be composed with the base already."""
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"two targets for {source!r}")

    for cp in [*range(0xC0, 0x3100)]:
        whole = chr(cp)
        parts = unicodedata.normalize("NFD", whole)
        if len(parts) < 2 or not parts[0].isalnum() or unicodedata.normalize("NFC", whole) != whole:
            continue
        for marks in set(permutations(parts[1:])):
            ordered = unicodedata.normalize("NFD", parts[0] + "".join(marks))
            if unicodedata.normalize("NFC", ordered) != whole:
                continue
            for k in range(len(ordered) - 1):
                first = unicodedata.normalize("NFC", ordered[: k + 1])
                if len(first) == 1:
                    put(first + ordered[k + 1 :], whole)
    for lead in range(19):
        for vowel in range(21):
            syllable = chr(0xAC00 + (lead * 21 + vowel) * 28)
            put(chr(0x1100 + lead) + chr(0x1161 + vowel), syllable)
            for last in range(1, 28):
                put(chr(0x1100 + lead) + chr(0x1161 + vowel) + chr(0x11A7 + last), chr(ord(syllable) + last))
                put(syllable + chr(0x11A7 + last), chr(ord(syllable) + last))
    return table


TABLE = _single()
COMPOSED = _composed()
_TO_LATIN = {**CYRILLIC, **GREEK, **VARIANTS}
_FROM_LATIN = {"Cyrillic": {v: k for k, v in CYRILLIC.items()}, "Greek": {v: k for k, v in GREEK.items()}}


def _check() -> None:
    """No target is a source again, and every target is composed."""
    for source, target in TABLE.items():
        if any(c in TABLE for c in target) or unicodedata.normalize("NFC", target) != target:
            raise ValueError(f"{source!r} does not become a last form")
        if source in _TO_LATIN and target:
            raise ValueError(f"{source!r} is a look-alike and another form")
    for source, target in COMPOSED.items():
        if target in TABLE or target in COMPOSED or any(c in TABLE for c in source):
            raise ValueError(f"{source!r} does not become a last form")
    for back in (CYRILLIC, GREEK):
        if len(set(back.values())) != len(back):
            raise ValueError("two letters of one script look like the same one")
    for target in _TO_LATIN.values():
        if target in TABLE or target in _TO_LATIN:
            raise ValueError(f"{target!r} is changed again")


_check()

# -- compiled ----------------------------------------------------------------------------------------------------

_KEEP, _GONE = 0, LAST  # of _MAP: the character stays; it goes; over LAST: a row of _LONG
_MAP = np.zeros(LAST, np.uint32)
_LONG: list[np.ndarray] = []
for _source, _target in TABLE.items():
    if len(_target) == 1:
        _MAP[ord(_source)] = ord(_target)
    elif _target:
        _LONG.append(np.array([ord(c) for c in _target], np.uint32))
        _MAP[ord(_source)] = LAST + len(_LONG)
    else:
        _MAP[ord(_source)] = _GONE

#: Canonical classes of marks; 0 for all else.
_CLASS = np.zeros(LAST, np.uint8)
for _cp in [*range(0x300, 0x3100), *range(0xA66F, 0xABEE), *range(0xFB1E, 0xFB1F), *range(0xFE20, 0xFE30)]:
    _CLASS[_cp] = unicodedata.combining(chr(_cp))

#: Characters that may go on a cluster in the trie.
_FOLLOWS = np.zeros(LAST, bool)
_FOLLOWS[list({ord(c) for source in COMPOSED for c in source[1:]})] = True

Node = dict


def _trie() -> Node:
    """Nested maps; the target of a source stands under the empty key of its node."""
    root: Node = {}
    for source, target in COMPOSED.items():
        node = root
        for c in source:
            node = node.setdefault(c, {})
        node[""] = target
    return root


_TRIE = _trie()


@lru_cache(maxsize=200_000)
def _composed_cluster(cluster: str) -> str:
    """The cluster with its longest matches composed, from its parts in canonical order; a mark that stays does not keep
    the ones behind it, of another class, from the base. Only letters and digits are bases."""
    if not cluster[0].isalnum():
        return cluster
    cluster = unicodedata.normalize("NFD", cluster)
    out = [cluster[0]]
    left: list[str] = []
    at, node = 1, _TRIE.get(cluster[0], {})
    while at < len(cluster):
        if left and not unicodedata.combining(cluster[at]):
            break
        # the longest path from here
        best, here, k = None, node, at
        while k < len(cluster) and cluster[k] in here:
            here, k = here[cluster[k]], k + 1
            if "" in here:
                best = k, here[""]
        if best:
            at, out[0] = best
            node = _TRIE.get(out[0], {})
        else:
            mark = cluster[at]
            if not unicodedata.combining(mark):
                break
            left.append(mark)
            at += 1
            # a mark of the same class as one that stays is cut off from the base
            while at < len(cluster) and unicodedata.combining(cluster[at]) == unicodedata.combining(left[-1]):
                left.append(cluster[at])
                at += 1
    return out[0] + "".join(left) + cluster[at:]


_NONE, _LATIN, _CYRILLIC, _GREEK, _VARIANT, _OTHER = 0, 1, 2, 4, 8, 16


def _scripts() -> np.ndarray:
    """The script of each letter of the alphabetic scripts that have look-alikes, as one bit."""
    out = np.zeros(LAST, np.uint8)
    for lo, hi in ((0x41, 0x2B0), (0x1E00, 0x1F00), (0xA78C, 0xA78D)):
        for cp in range(lo, hi):
            if chr(cp).isalpha():
                out[cp] = _LATIN
    for lo, hi, script in ((0x370, 0x400, _GREEK), (0x1F00, 0x2000, _GREEK), (0x400, 0x530, _CYRILLIC)):
        for cp in range(lo, hi):
            if chr(cp).isalpha():
                out[cp] = script
    for c in VARIANTS:
        out[ord(c)] = _VARIANT
    return out


_SCRIPT = _scripts()
_LOOKS_LATIN = np.zeros(LAST, np.uint32)
for _source, _target in _TO_LATIN.items():
    _LOOKS_LATIN[ord(_source)] = ord(_target)
_LOOKS = {}
for _name, _bit in (("Cyrillic", _CYRILLIC), ("Greek", _GREEK)):
    _LOOKS[_bit] = np.zeros(LAST, np.uint32)
    for _source, _target in _FROM_LATIN[_name].items():
        _LOOKS[_bit][ord(_source)] = ord(_target)

_JOINED = np.zeros(LAST, bool)
for _lo, _hi in ((0x600, 0x900), (0x900, 0xE00), (0x1800, 0x18B0)):
    _JOINED[_lo:_hi] = True


def _alphabet(points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their texts' numbers after the single characters are replaced."""
    to = _MAP[points]
    joiner = np.flatnonzero((points == 0x200C) | (points == 0x200D))
    if len(joiner):  # between letters that it joins or parts
        inner = joiner[(joiner > 0) & (joiner < len(points) - 1)]
        to[inner[_JOINED[points[inner - 1]] & _JOINED[points[inner + 1]]]] = _KEEP
    if not to.any():
        return points, text
    points = np.where((to > 0) & (to < LAST), to, points)
    size = np.ones(len(points), np.int64)
    size[to == _GONE] = 0
    long = np.flatnonzero(to > LAST)
    size[long] = [len(_LONG[i - LAST - 1]) for i in to[long].tolist()]
    out = np.repeat(points, size)
    start = np.cumsum(size) - size
    for at, row in zip(start[long].tolist(), to[long].tolist(), strict=True):
        out[at : at + len(_LONG[row - LAST - 1])] = _LONG[row - LAST - 1]
    return out, np.repeat(text, size)


def _compose(points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters with marks composed."""
    marks = _CLASS[points]
    turned = (marks[:-1] > marks[1:]) & (marks[1:] > 0)
    if turned.any():  # marks of a run in canonical order, equal classes as they stand
        run = np.cumsum(marks == 0)
        points = points[np.lexsort((marks, run))]
    follows = _FOLLOWS[points]
    if not follows.any():
        return points, text
    # a cluster: a character that does not follow, and those that do behind it
    lone = np.flatnonzero(~follows)
    nexts = np.append(lone[1:], len(points))
    several = nexts - lone > 1
    pieces: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    done = 0
    for a, b in zip(lone[several].tolist(), nexts[several].tolist(), strict=True):
        cluster = points[a:b].tobytes().decode("utf-32-le", "surrogatepass")
        new = _composed_cluster(cluster)
        if new != cluster:
            pieces += [points[done:a], np.frombuffer(new.encode("utf-32-le", "surrogatepass"), np.uint32)]
            owners += [text[done:a], np.full(len(new), text[a], text.dtype)]
            done = b
    if not pieces:
        return points, text
    return np.concatenate([*pieces, points[done:]]), np.concatenate([*owners, text[done:]])


def _look_alikes(points: np.ndarray) -> np.ndarray:
    """Letters of words that mix scripts, in one script: Latin if all others look like its letters, else the other one
    if all Latin ones do."""
    script = _SCRIPT[points]
    inside = (script > 0) | (_CLASS[points] > 0)
    odd = (script & ~np.uint8(_LATIN)) > 0
    if not odd.any():
        return points
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    bounds = np.stack([start, end], 1).ravel()
    bounds = bounds[bounds < len(points)]
    kinds = np.bitwise_or.reduceat(script, bounds)[::2]
    mixed = ((kinds & _LATIN > 0) & (kinds & (_CYRILLIC | _GREEK | _VARIANT) > 0)) | ((kinds & _VARIANT > 0) & (kinds == _VARIANT))
    if not mixed.any():
        return points
    points = points.copy()
    for a, b in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
        word, own = points[a:b], script[a:b]
        latin, other = own == _LATIN, (own > 0) & (own != _LATIN)
        if (_LOOKS_LATIN[word[other]] > 0).all():
            points[a:b][other] = _LOOKS_LATIN[word[other]]
            continue
        for bit, back in _LOOKS.items():
            if (own == bit).any() and (back[word[latin]] > 0).all():
                points[a:b][latin] = back[word[latin]]
                break
    return points


def consistent_texts(texts: list[str]) -> list[str]:
    """The consistent forms. Applied twice they change nothing more."""
    out: list[str] = []
    for lo, hi in chunks(texts):
        points, _, lengths = code_points(texts[lo:hi])
        text = np.repeat(np.arange(hi - lo), lengths + 1)
        points, text = _alphabet(points, text)
        points, text = _compose(points, text)
        points = _look_alikes(points)
        # a look-alike may be the base of marks
        points, text = _compose(points, text)
        ends = np.searchsorted(text, np.arange(hi - lo), "right") - 1  # at the 0 behind each text
        starts = np.concatenate([[0], ends[:-1] + 1])
        out += [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return out


def consistent(text: str) -> str:
    """The consistent form of one text."""
    return text if text.isascii() else consistent_texts([text])[0]


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    out = texts.copy()
    filled = texts.notna()
    out[filled] = consistent_texts(texts[filled].tolist())
    return out


def consistent_form(text: Column) -> Column:
    """The consistent form of a text column; null stays null."""
    return _consistent(text)


def changed_lines(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Lines (rec_id, item_no from 1) that the consistent form changes, empty lines counted. Null texts have none."""
    rows = records.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("rec_id"), F.col(text_column).alias("before"))
    rows = rows.withColumn("after", _consistent("before")).where("before <> after")
    lines = rows.select("rec_id", F.posexplode(F.arrays_zip(F.split("before", "\n").alias("before"), F.split("after", "\n").alias("after"))).alias("at", "line"))
    return lines.where(F.col("line.before") != F.col("line.after")).select("rec_id", (F.col("at") + 1).cast("long").alias("item_no"))


def changed_names(contexts: DataFrame) -> DataFrame:
    """contexts: context_id, proper_names ARRAY<STRUCT<seen, canonical>>. Names (rec_id, item_no from 1) of which the
    consistent form changes the seen or the canonical spelling. Null arrays, names and spellings have none."""
    names = contexts.select(F.col("context_id").alias("rec_id"), F.posexplode("proper_names").alias("at", "name"))
    names = names.select("rec_id", "at", F.col("name.seen").alias("seen"), F.col("name.canonical").alias("canonical"))
    names = names.select("rec_id", "at", "seen", "canonical", _consistent("seen").alias("seen2"), _consistent("canonical").alias("canonical2"))
    return names.where((F.col("seen") != F.col("seen2")) | (F.col("canonical") != F.col("canonical2"))).select("rec_id", (F.col("at") + 1).cast("long").alias("item_no"))


def consistent_names(contexts: DataFrame) -> DataFrame:
    """(context_id, item_no, seen, canonical) of all names in the consistent form."""
    names = contexts.select("context_id", F.posexplode("proper_names").alias("at", "name"))
    return names.select("context_id", (F.col("at") + 1).cast("long").alias("item_no"), consistent_form(F.col("name.seen")).alias("seen"), consistent_form(F.col("name.canonical")).alias("canonical"))
