"""Noise in the text of scanned pages: running headers, page numbers, words cut at line ends, misread characters.

Lines are labelled by a hidden Markov model with the states body, break, header, page number and notice. Its emissions
are layout features of a line (shape, distance to the page's edge, agreement with a title of the book), and it is
fitted on a bounded sample of pages for which a proofread text exists: whether a line stayed in that text, between the
lines around it, says whether it is body, whatever its features. The states are written once. The same pages show which characters are taken
for which others. A word (in scripts without spaces, a character with its neighbours) is misread if it is rare in the
whole corpus and becomes a far more frequent one when such a character is put back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import WindowHash, code_points
from .consistent import consistent, consistent_form

#: Most proofread pages that the model is fitted on.
SAMPLE = 2500
#: Most words and character pairs, the most frequent ones, whose numbers all tasks know. If there are more that occur
#: twice, the numbers of rarer ones are joined to the pages whose verdicts may depend on them.
KNOWN = 1_500_000
#: Lines at a page's edges that may be notices of its site.
EDGE = 8
#: A misread word is RATIO times rarer than the word it stands for, and occurs once, or in RARE of the other's number;
#: of two neighbours in a script without spaces, one at least is as rare, and the right ones occur LEAST times.
RATIO, RARE, LEAST = 12, 0.01, 5

BODY, BREAK, HEADER, NUMBER, NOTICE = range(5)
STATES = 5

# a printed page number, in which letters may stand for digits; a year alone is none
_DIGITS = r"(?=[OolI]{0,3}[0-9])(?!(?:1[5-9]|20)[0-9][0-9]\W*\Z)[0-9OolI]{1,4}|[0-9](?:\s[0-9]){1,3}"
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_CORE = rf"(?:{_DIGITS}|{_ROMAN}|[〇零一二三四五六七八九十百]{{1,6}})"
_NUMBER = re.compile(
    rf"{_CORE}|[-–—~·•*|_.]+\s*{_CORE}\s*[-–—~·•*|_.]+|[\[(（〔【<「]\s*{_CORE}\s*[\])）〕】>」]"
    rf"|(?:第|page|pg?\.?|trang|tr\.|頁|页|s\.)\s*{_CORE}\s*(?:页|頁|ページ)?|{_CORE}\s*(?:页|頁|ページ)"
    rf"|(?:page\s*|trang\s*|第\s*)?[0-9OolI]{{1,4}}\s*(?:[/／|]|of|共)\s*[0-9OolI]{{1,4}}\s*[页頁]?",
    re.IGNORECASE,
)
_PLAIN = re.compile(r"[0-9OolI\s]+")
_LETTERS = re.compile(r"[\W\d_]+")
_ENDS = frozenset("。．.!?！？；;，,：:、」”\"'’)）")
_MARKS = frozenset("-‐‑¬­⁃–=")
SOFT = "\xad"
_BLANKS = " \t\r​‌‍⁠﻿‎　"


def cut_word(line: str, following: str) -> bool:
    """Whether the line ends in a word that a mark breaks off, and the following one goes on with letters."""
    end = line.rstrip(_BLANKS)
    return end[-1:] in _MARKS and end[-2:-1].isalpha() and following.lstrip(_BLANKS)[:1].isalpha() if end else False


def letters(line: str) -> str:
    return _LETTERS.sub("", line).lower()


def agrees(own: str, titles: list[str]) -> bool:
    """Whether the letters of a line are those of a title, but for few misread ones."""
    for title in titles:
        if own == title:
            return True
        n, m = len(own), len(title)
        if m < 4 or abs(n - m) > max(1, m // 12) or n < 4:
            continue
        if n == m and sum(a != b for a, b in zip(own, title, strict=True)) <= max(1, m // 6):
            return True
        i = 0
        while i < min(n, m) and own[i] == title[i]:
            i += 1
        j = 0
        while j < min(n, m) - i and own[n - 1 - j] == title[m - 1 - j]:
            j += 1
        if max(n, m) - i - j <= max(2, m // 6):
            return True
        pairs, other = {own[k : k + 2] for k in range(n - 1)}, {title[k : k + 2] for k in range(m - 1)}
        if len(pairs & other) >= 0.66 * max(len(pairs), len(other)):
            return True
    return False


def line_symbols(lines: list[str], titles: list[str], notices: frozenset[str] = frozenset()) -> list[int]:
    """The emission of each line: its shape by its distance to the nearer edge of the page, counted in lines with text
    that are no notices of the site, nor, for a number, titles."""
    bodies = [x.strip() for x in lines]
    noted = set()
    if notices:
        noted = {i for i, x in enumerate(bodies) if x and letters(x) in notices and not agrees(letters(x), titles)}
    filled = [i for i, x in enumerate(bodies) if x and i not in noted]
    edge = {i: min(k, len(filled) - 1 - k, 3) for k, i in enumerate(filled)}
    titled = {i for i in [*filled[:3], *filled[-3:]] if not bodies[i].startswith("#") and not _NUMBER.fullmatch(bodies[i]) and agrees(letters(bodies[i]), titles)}
    # a title at the edge does not move a number from it, as a line of the body does
    inner = [i for i in filled if i not in titled]
    depth = {i: min(k, len(inner) - 1 - k, 3) for k, i in enumerate(inner)}
    out = []
    for i, body in enumerate(bodies):
        if not body:
            out.append(0)
            continue
        near = edge.get(i, 0)
        if i in noted:
            shape = 6
        elif body.startswith("#"):
            shape = 0
        elif _NUMBER.fullmatch(body):
            # sections have plain numbers, too
            shape, near = 1 if _PLAIN.fullmatch(body) else 7, depth[i]
        elif i in titled:
            shape = 2
        elif body[-1] in _ENDS:
            shape = 3
        else:
            shape = 4 if len(body) <= 48 else 5
        bare = (i == 0 or not bodies[i - 1]) and (i == len(lines) - 1 or not bodies[i + 1])
        out.append(1 + (shape * 4 + near) * 2 + bare)
    return out


SYMBOLS = 1 + 8 * 4 * 2


@dataclass
class Model:
    """Logarithms of the chances of the first state, of transitions, of the last state and of emissions; the strings
    that are recognised wrongly, with what they stand for."""

    first: np.ndarray
    then: np.ndarray
    last: np.ndarray
    emits: np.ndarray
    confused: dict[str, list[str]] = field(default_factory=dict)

    def label(self, pages: list[list[int]]) -> list[np.ndarray]:
        """The likeliest states of each page's lines, for all pages together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        for lo in range(0, len(order), 512):
            group = order[lo : lo + 512]
            n = np.array([len(pages[i]) for i in group])
            longest = int(n.max()) if len(n) else 0
            if not longest:
                continue
            seen = np.zeros((len(group), longest), np.int64)
            for row, i in enumerate(group):
                seen[row, : len(pages[i])] = pages[i]
            score = self.first + self.emits[:, seen[:, 0]].T
            back = np.zeros((len(group), longest, STATES), np.int8)
            final = np.where((n == 1)[:, None], score + self.last, 0.0)
            for t in range(1, longest):
                step = score[:, :, None] + self.then
                back[:, t] = step.argmax(axis=1)
                score = step.max(axis=1) + self.emits[:, seen[:, t]].T
                final = np.where((n == t + 1)[:, None], score + self.last, final)
            state = final.argmax(axis=1)
            path = np.zeros((len(group), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                state = np.where(n - 1 == t, final.argmax(axis=1), state)
                path[:, t] = state
                state = back[np.arange(len(group)), t, state]
            for row, i in enumerate(group):
                out[i] = path[row, : len(pages[i])]
        return out


def known_labels(lines: list[str], titles: list[str], proof: str) -> list[int]:
    """The states of a page's lines, by its proofread text: a line is body if it is there in its place, between those
    that long lines before and behind it have; another one was dropped, and is a page number if it has no letters but
    those of numerals, a header if it agrees with a title, a notice else. A heading is body in any case, and what the
    text has only as a heading is not the place of a line without its marks."""
    target = "".join(proof.split())
    bodies = ["".join(consistent(line).split()).rstrip("-‐‑¬­⁃–=") for line in lines]
    # places of long lines, in order: the start or the end of one is found as it stands, or a part within
    begin, end = [-1] * len(lines), [-1] * len(lines)
    at = 0
    for i, body in enumerate(bodies):
        if len(body) < 12:
            continue
        for offset in (0, len(body) - 12, len(body) // 3):
            found = target.find(body[offset : offset + 12], max(0, at - 12))
            if 0 <= found <= at + 400 + 2 * len(body) and (body[0] == "#" or "#" not in target[max(found - offset - 1, 0) : found]):
                begin[i], end[i] = max(found - offset, 0), min(found - offset + len(body), len(target))
                at = end[i]
                break
    behind = len(target)
    nexts = [behind] * len(lines)
    for i in range(len(lines) - 1, -1, -1):
        nexts[i] = behind
        if begin[i] >= 0:
            behind = begin[i]
    out, at = [], 0
    for i, (line, body) in enumerate(zip(lines, bodies, strict=True)):
        if not line.strip():
            out.append(BREAK)
            continue
        here = -1 if begin[i] >= 0 or not body else target.find(body, max(at - 2, 0), max(nexts[i] + 2, at))
        if here > 0 and target[here - 1] == "#" and body[0] != "#":
            here = -1
        if begin[i] >= 0 or here >= 0 or line.lstrip().startswith("#"):
            out.append(BODY)
            at = end[i] if begin[i] >= 0 else max(at, here + len(body))
        elif _NUMBER.fullmatch(line.strip()):
            out.append(NUMBER)
        elif agrees(letters(line), titles):
            out.append(HEADER)
        else:
            # a line of running text whose characters were misread too often to be found is no notice
            out.append(NOTICE if len(body) > 3 and nexts[i] - at < max(len(body) // 2, 4) else BODY)
    return out


def confusions(text: str, proof: str) -> Counter:
    """(read, right) of short unequal stretches between equal ones, in two texts without white space."""
    out: Counter = Counter()
    i = j = 0
    n, m = len(text), len(proof)
    sizes = [(1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (2, 3)]
    while i < n and j < m:
        if text[i] == proof[j]:
            i += 1
            j += 1
            continue
        for a, b in sizes:
            if text[i + a : i + a + 5] == proof[j + b : j + b + 5] and i + a + 5 <= n:
                out[(text[i : i + a], proof[j : j + b])] += 1
                i, j = i + a, j + b
                break
        else:  # lost: go on where the next characters are found
            at = proof.find(text[i + 8 : i + 20], j) if i + 20 <= n else -1
            if 0 <= at < j + 200:
                i, j = i + 8, at
            else:
                i += 8
                if i + 12 <= n and (at := proof.find(text[i : i + 12])) >= 0:
                    j = at
    return out


def word_confusions(words: list[str], right: list[str]) -> Counter:
    """(read, right) of at most two letters each, by which a word that the proofread text lacks differs from one that
    only that has."""
    mine, theirs = Counter(words), Counter(right)
    missing = [w for w in theirs if theirs[w] > mine[w] and len(w) >= 3]
    out: Counter = Counter()
    for word in mine:
        if word in theirs or len(word) < 3:
            continue
        options = set()
        for w in missing:
            if abs(len(w) - len(word)) > 1:
                continue
            i = 0
            while i < min(len(w), len(word)) and w[i] == word[i]:
                i += 1
            j = 0
            while j < min(len(w), len(word)) - i and w[-1 - j] == word[-1 - j]:
                j += 1
            read, target = word[i : len(word) - j], w[i : len(w) - j]
            if 1 <= len(read) <= 2 and 1 <= len(target) <= 2:
                options.add((read, target))
            elif 0 in (len(read), len(target)) and len(read) + len(target) == 1 and i:
                # a letter more or less: together with the one before it, as rn for m
                options.add((word[i - 1 : len(word) - j], w[i - 1 : len(w) - j]))
        if len(options) == 1:
            out.update(options)
    return out


# Letters and digits that recognition takes for others in Latin print; read, right.
LATIN = [("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("u", "n"), ("n", "u"), ("l", "t"), ("l", "i"), ("i", "l"), ("ri", "n"), ("n", "ri"), ("q", "g")]


def page_counts(text: str, proof: str, titles: list[str], notices: frozenset[str] = frozenset()) -> Counter:
    """What a proofread page counts for: (what, a, b). text: in the consistent form."""
    out: Counter = Counter()
    lines = text.split("\n")
    symbols = line_symbols(lines, titles, notices)
    states = known_labels(lines, titles, proof)
    out["first", str(states[0]), ""] += 1
    out["last", str(states[-1]), ""] += 1
    for a, b in zip(states, states[1:]):
        out["then", str(a), str(b)] += 1
    for state, symbol in zip(states, symbols, strict=True):
        out["emits", str(state), str(symbol)] += 1
    right = consistent(proof)
    body, _ = body_text(lines, np.array(states))
    for (read, put), n in confusions("".join(body.split()), "".join(right.split())).items():
        # of scripts without spaces, one character for another, in which a mark is none
        if len(read) == len(put) == 1 and read > "⺀" and put > "⺀" and read.isalpha() and put.isalpha():
            out["wide", read, put] += n
    for (read, put), n in word_confusions(_WORD.findall(body.casefold()), _WORD.findall(right.casefold())).items():
        out["narrow", read, put] += n
    return out


def fit(counts: dict[tuple[str, str, str], int]) -> Model:
    """counts: the sums of page_counts."""
    first, last = np.full(STATES, 0.5), np.full(STATES, 0.5)
    then = np.full((STATES, STATES), 0.5)
    emits = np.full((STATES, SYMBOLS), 0.02)
    # without any page: what a line's shape alone says
    for near in range(4):
        for bare in range(2):
            number, title, marked = (1 + (shape * 4 + near) * 2 + bare for shape in (1, 2, 7))
            # a plain number behind a line of the body is a section's, unless pages say otherwise
            for symbol, inside in ((number, 0.05), (marked, 0.5)):
                emits[NUMBER, symbol] += 2 if near == 0 else inside if near < 3 else 0.05
                emits[BODY, symbol] += 0.02 if near == 0 else 0.2 if near < 3 else 1
            emits[HEADER, title] += 2 if near < 3 else 0.05
            emits[NOTICE, 1 + (24 + near) * 2 + bare] += 3
            for shape in (0, 3, 4, 5):
                emits[BODY, 1 + (shape * 4 + near) * 2 + bare] += 1
            emits[NOTICE, 1 + (4 * 4 + near) * 2 + bare] += 0.3 if near < 2 and bare else 0.02
    emits[BREAK] = 1e-6
    emits[:, 0] = 1e-6
    emits[BREAK, 0] = 1
    confused: dict[str, list[str]] = {}
    for read, right in LATIN:
        confused.setdefault(read, []).append(right)
    for (what, a, b), n in sorted(counts.items()):
        if what == "first":
            first[int(a)] += n
        elif what == "last":
            last[int(a)] += n
        elif what == "then":
            then[int(a), int(b)] += n
        elif what == "emits":
            emits[int(a), int(b)] += n
        elif what == "wide" or n >= 2:
            # what looks alike does so both ways
            for read, right in ((a, b), (b, a)):
                if right not in confused.setdefault(read, []):
                    confused[read].append(right)
    log = lambda x, axis=None: np.log(x / x.sum(axis=axis, keepdims=axis is not None))
    return Model(log(first), log(then, 1), log(last), log(emits, 1), confused)


# -- words of a page ---------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_ぁ-ヿ㐀-鿿豈-﫿가-힣]+(?:['’][^\W_ぁ-ヿ㐀-鿿豈-﫿가-힣]+)?")
_WIDE = re.compile(r"[ぁ-ヿ㐀-鿿]")


def body_text(lines: list[str], states: np.ndarray) -> tuple[str, list[int]]:
    """The body's lines as one text, words that a line end cuts made whole, and the line number of each character.
    Lines of scripts without spaces are joined as they are."""
    parts: list[str] = []
    owner: list[int] = []

    def add(piece: str, line: int) -> None:
        parts.append(piece)
        owner.extend([line] * len(piece))

    before = -2
    for i, (line, state) in enumerate(zip(lines, states, strict=True)):
        if state != BODY:
            continue
        body = line.strip()
        last = parts[-1] if parts else ""
        if parts and before == i - 1 and cut_word(last, body):
            parts[-1] = last.rstrip(_BLANKS)[:-1]
            del owner[len(owner) - (len(last) - len(parts[-1])) :]
            add(body, i)
            before = i
            continue
        if last.endswith(SOFT):  # no letters follow, so that it cuts no word
            parts[-1] = last = last.rstrip(SOFT)
            del owner[sum(map(len, parts)) :]
        if parts and not (before == i - 1 and last and _WIDE.match(last[-1]) and body and _WIDE.match(body[0])):
            add(" ", before)
        add(body, i)
        before = i
    body = "".join(parts).rstrip(SOFT)
    return body, owner[: len(body)]


def wide_pairs(points: np.ndarray) -> np.ndarray:
    """Places of neighbours of which one is a character of a script without spaces."""
    wide = (points >= 0x3041) & (points < 0x3100) | (points >= 0x3400) & (points < 0xA000)
    return np.flatnonzero((wide[:-1] | wide[1:]) & (points[:-1] > 0) & (points[1:] > 0))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 21) | b.astype(np.int64)


def _word_keys(words: list[str]) -> np.ndarray:
    points, starts, lengths = code_points(words)
    return -1 - (WindowHash(points).of(starts, starts + lengths) >> np.uint64(1)).view(np.int64)


@dataclass
class Numbers:
    """How often words and character pairs occur: sorted keys and their numbers. A key that is not among them occurs
    ceiling times at most, and as often as more says."""

    keys: np.ndarray
    counts: np.ndarray
    ceiling: int = 0
    more: Numbers | None = None

    def of(self, keys: np.ndarray, missing: int = 0) -> np.ndarray:
        rest = self.more.of(keys, missing) if self.more else np.full(len(keys), missing, np.int64)
        if not len(self.keys):
            return rest
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], rest)

    def with_those_of(self, batch: pa.RecordBatch) -> Numbers:
        """With the numbers that were joined to a batch's pages."""
        if "keys" not in batch.schema.names:
            return self
        keys, first = np.unique(batch.column("keys").flatten().to_numpy(zero_copy_only=False), return_index=True)
        return Numbers(self.keys, self.counts, self.ceiling, Numbers(keys, batch.column("counts").flatten().to_numpy(zero_copy_only=False)[first]))


def asked_keys(bodies: list[str], model: Model, numbers: Numbers) -> np.ndarray:
    """Keys that numbers lacks and on which a verdict on a word or character of the bodies may depend."""
    asked: list[np.ndarray] = []
    misread_characters(code_points(bodies)[0], model, numbers, asked)
    words = sorted({m[0].casefold() for b in bodies for m in _WORD.finditer(b)})
    own = _word_keys(words) if words else np.zeros(0, np.int64)
    # a word that numbers has is at least as frequent as any that it lacks
    rare = [(w, k) for w, k, n in zip(words, own.tolist(), numbers.of(own, -1).tolist(), strict=True) if n < 0 and (len(w) > 1 or not w.isalpha())]
    cases = [(k, right) for w, k in rare for right in replaced(w, model.confused) if right]
    if cases:
        keys, options = np.array([k for k, _ in cases], np.int64), _word_keys([right for _, right in cases])
        likely = numbers.of(options, numbers.ceiling) >= RATIO
        asked += [keys[likely], options[likely & (numbers.of(options, -1) < 0)]]
    return np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.int64)


def replaced(word: str, confused: dict[str, list[str]]) -> list[str]:
    """The word with each part that may be misread put right, one at a time."""
    out = []
    for size in (1, 2):
        for i in range(len(word) - size + 1):
            for right in confused.get(word[i : i + size], ()):
                out.append(word[:i] + right.casefold() + word[i + size :])
    return out


def misread_words(words: set[str], model: Model, numbers: Numbers, known: dict[str, str | None]) -> None:
    """Puts into known, for each word that it lacks, what the word stands for, or None if it is not misread."""
    new = [w for w in words if w not in known]
    own = numbers.of(_word_keys(new)) if new else np.zeros(0, np.int64)
    cases, options = [], []
    for word, n in zip(new, own.tolist(), strict=True):
        known[word] = None
        if len(word) > 1 or not word.isalpha():
            for right in replaced(word, model.confused):
                cases.append((word, n))
                options.append(right)
    best: dict[str, int] = {}
    for (word, n), right, m in zip(cases, options, numbers.of(_word_keys(options)).tolist() if options else [], strict=True):
        if right and m >= RATIO * max(1, n) and n <= 1 + RARE * m and m > best.get(word, 0):
            best[word], known[word] = m, right


def misread_characters(points: np.ndarray, model: Model, numbers: Numbers, asked: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of misread characters of scripts without spaces, and the right ones. points: texts, each between zeros.
    With asked, keys that numbers lacks are taken for as frequent as they may be, and those that count go to asked."""
    options = [(ord(c), ord(r)) for c, rights in model.confused.items() if len(c) == 1 and c > "⺀" for r in rights]
    if len(points) < 3 or not options:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    # the k-th right character of each
    tables: list[np.ndarray] = []
    for c, r in options:
        for table in tables:
            if not table[c]:
                table[c] = r
                break
        else:
            tables.append(np.zeros(0x10000, np.uint32))
            tables[-1][c] = r
    small = np.minimum(points, 0xFFFF)
    place = np.flatnonzero(tables[0][small] > 0)
    place = place[(place > 0) & (place < len(points) - 1)]
    before, here, after = points[place - 1], points[place], points[place + 1]
    most = numbers.ceiling if asked is not None else 0
    left, right = numbers.of(_pair_key(before, here)), numbers.of(_pair_key(here, after))
    best, chosen = np.zeros(len(place)), np.zeros(len(place), np.uint32)
    for table in tables:
        new = table[small[place]]
        left2, right2 = numbers.of(_pair_key(before, new), most), numbers.of(_pair_key(new, after), most)
        gain = np.log((left2 + 0.5) / (left + 0.5)) + np.log((right2 + 0.5) / (right + 0.5))
        weak = np.minimum(left, right) * RATIO <= np.minimum(left2, right2)
        good = (new > 0) & (gain >= np.log(RATIO * 4.0)) & (np.maximum(left2, right2) >= LEAST) & weak
        if asked is not None:
            keys = np.concatenate([_pair_key(x[good], y[good]) for x, y in ((before, here), (here, after), (before, new), (new, after))])
            asked.append(keys[numbers.of(keys, -1) < 0])
        good &= gain > best
        best, chosen = np.where(good, gain, best), np.where(good, new, chosen)
    return place[chosen > 0], chosen[chosen > 0]


# -- Spark -------------------------------------------------------------------------------------------------------


def volume_titles(books: DataFrame, contexts: DataFrame, records: DataFrame) -> DataFrame:
    """Letters of the titles of each volume, its chapters and its pages' headings: (book_id, volume, titles)."""
    heading = records.where("markdown like '%#%'").select("book_id", "volume", F.explode(F.split("markdown", "\n")).alias("title")).where(r"title rlike '^\\s*#{1,6}\\s'")
    every = (
        books.select("book_id", "volume", "title")
        .unionByName(contexts.select("book_id", "volume", "title"))
        .unionByName(contexts.select("book_id", "volume", F.explode("table_of_contents.title").alias("title")))
        .unionByName(heading)
    )
    plain = F.lower(F.regexp_replace(consistent_form(F.col("title")), r"[^\p{L}\p{M}]+", ""))
    return every.where("title is not null").select("book_id", "volume", plain.alias("t")).where(F.length("t") >= 3).groupBy("book_id", "volume").agg(F.collect_set("t").alias("titles"))


def _form_of_lines(text: Column) -> Column:
    """The consistent form, in which soft hyphens behind a line's last letter stay; a noncharacter stands for them."""
    kept = F.regexp_replace(text, r"(?<=[\p{L}\p{M}\p{Cf}])\u00AD(?=[ \t\r\p{Z}\p{Cf}&&[^\u00AD]]*\n)", "\ufdd0")
    return F.translate(consistent_form(kept), "\ufdd0", SOFT)


def prepared(records: DataFrame, books: DataFrame, contexts: DataFrame) -> DataFrame:
    """(result_id, site, text in the consistent form but for soft hyphens at lines' ends, titles) of all records with a text."""
    rows = records.where("markdown is not null and markdown <> '' and result_id is not null")
    rows = rows.select(F.col("result_id").cast("long").alias("result_id"), "book_id", "volume", F.coalesce("scan_site", F.lit("")).alias("site"), _form_of_lines(F.col("markdown")).alias("text"))
    return rows.join(volume_titles(books, contexts, records), ["book_id", "volume"], "left").select("result_id", "site", "text", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def site_notices(pages: DataFrame, least: int = 5, share: float = 0.04) -> DataFrame:
    """(site, notices ARRAY<STRING>): the letters of lines that stand near the edges of at least least pages and of share
    of the pages of a site. No more than EDGE / share lines of a site can."""
    filled = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    ends = F.concat(F.slice(filled, F.lit(1), F.lit(EDGE // 2)), F.slice(filled, F.greatest(F.size(filled) - EDGE // 2 + 1, F.lit(1)), F.lit(EDGE // 2)))
    found = pages.where("site <> ''").select("site", F.explode(F.array_distinct(F.transform(ends, lambda x: F.lower(F.regexp_replace(x, r"\P{L}+", ""))))).alias("letters"))
    counts = found.where(F.length("letters") >= 6).groupBy("site", "letters").agg(F.count("*").alias("n"))
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    often = counts.join(totals, "site").where((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))
    return often.groupBy("site").agg(F.collect_set("letters").alias("notices"))


def fitted(pages: DataFrame, overrides: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most `sample` proofread pages, chosen by the hash of their id. pages: (result_id, text, titles,
    notices)."""
    chosen = overrides.where("markdown is not null").select(F.col("result_id").cast("long").alias("result_id"), F.col("markdown").alias("proof"))
    chosen = chosen.orderBy(F.xxhash64("result_id"), "result_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for text, proof, titles, notices in zip(*(batch.column(c).to_pylist() for c in ("text", "proof", "titles", "notices")), strict=True):
                sums.update(page_counts(text, proof, titles, frozenset(notices or ())))
        columns = list(zip(*sums, strict=True)) if sums else [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(sums.values(), pa.int64())], ["what", "a", "b", "n"])

    pairs = pages.join(chosen, "result_id").select("text", "proof", "titles", "notices").repartition(pages.sparkSession.sparkContext.defaultParallelism)
    # as many rows as states, symbols and characters allow
    rows = pairs.mapInArrow(run, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return fit({(r["what"], r["a"], r["b"]): r["n"] for r in rows})


def labelled(pages: DataFrame, model: Model) -> DataFrame:
    """pages: (result_id, text, titles, notices). (result_id, text, states ARRAY<TINYINT>) with the state of each line."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lines = [t.split("\n") for t in part.column("text").to_pylist()]
                titles, notices = part.column("titles").to_pylist(), part.column("notices").to_pylist()
                states = shared.value.label([line_symbols(x, t, frozenset(n or ())) for x, t, n in zip(lines, titles, notices, strict=True)])
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in states])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(states).astype(np.int8)))
                yield pa.RecordBatch.from_arrays([part.column("result_id"), part.column("text"), column], ["result_id", "text", "states"])

    return pages.select("result_id", "text", "titles", "notices").mapInArrow(run, "result_id long, text string, states array<tinyint>")


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple[int, list[str], np.ndarray]]]:
    """Groups of pages: their ids, lines and states."""
    for lo in range(0, batch.num_rows, 512):
        part = batch.slice(lo, 512)
        states = part.column("states")
        flat, bounds = states.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(states.value_lengths().to_numpy())])
        lines = (t.split("\n") for t in part.column("text").to_pylist())
        yield [(i, x, flat[a:b]) for i, x, a, b in zip(part.column("result_id").to_pylist(), lines, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def word_numbers(pages: DataFrame) -> DataFrame:
    """(key, n) of all words and character pairs of the bodies. pages: of labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            bodies: list[str] = []
            size = 0

            def out() -> pa.RecordBatch:
                points, _, _ = code_points(bodies)
                at = wide_pairs(points)
                keys, n = np.unique(_pair_key(points[at], points[at + 1]), return_counts=True)
                mine = _word_keys(list(words)) if words else np.zeros(0, np.int64)
                counts = np.fromiter(words.values(), np.int64, len(words))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, mine])), pa.array(np.concatenate([n, counts]))], ["key", "n"])

            for group in _groups(batch):
                for _, lines, states in group:
                    body, _ = body_text(lines, states)
                    bodies.append(body)
                    size += len(body)
                    words.update(_WORD.findall(body.casefold()))
                if size > 1 << 19:
                    yield out()
                    words.clear()
                    bodies.clear()
                    size = 0
            yield out()

    return pages.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def known_numbers(numbers: DataFrame, limit: int = KNOWN) -> Numbers:
    rows = numbers.where("n >= 2").orderBy(F.desc("n"), "key").limit(limit).toArrow().sort_by("key")
    counts = rows["n"].to_numpy()
    return Numbers(rows["key"].to_numpy(), counts, int(counts.min()) if len(counts) == limit else 0)


def _noise_parts(pages: DataFrame, overrides: DataFrame, bodies: Callable, limit: int):
    """The pages with their states, with rarer keys' numbers if there are any, and the broadcast model and numbers.
    bodies: of a page's lines and states, the texts that are judged."""
    # as a table whose size is known, so that a small one is broadcast and the texts stay where they are
    pages = pages.join(materialize(site_notices(pages), "notices"), "site", "left")
    model = fitted(pages, overrides)
    pages = materialize(labelled(pages, model), "labelled")
    counted = materialize(word_numbers(pages).where("n >= 2"), "numbers")
    numbers = known_numbers(counted, limit)
    shared = pages.sparkSession.sparkContext.broadcast((model, numbers))
    if not numbers.ceiling:
        return pages, shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers = shared.value
        for batch in batches:
            for group in _groups(batch):
                keys = [asked_keys(bodies(lines, states), model, numbers) for _, lines, states in group]
                ids = np.repeat(np.array([g[0] for g in group], np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(keys))], ["result_id", "key"])

    asked = pages.mapInArrow(run, "result_id long, key long")
    found = asked.join(counted.where(F.col("n") <= numbers.ceiling), "key").groupBy("result_id").agg(F.collect_list(F.struct("key", "n")).alias("found"))
    return pages.join(found, "result_id", "left").withColumn("keys", F.col("found.key")).withColumn("counts", F.col("found.n")).drop("found"), shared


def line_noise(records: DataFrame, books: DataFrame, contexts: DataFrame, overrides: DataFrame, limit: int = KNOWN) -> DataFrame:
    """(result_id, line_no from 1, kind) of all noise: hyphen, misread, header, page_number. Records without a text have
    none; without proofread pages the model knows only the lines' shapes, and no misread characters."""
    pages = materialize(prepared(records, books, contexts), "pages")
    pages, shared = _noise_parts(pages, overrides, lambda lines, states: [body_text(lines, states)[0]], limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, most = shared.value
        known: dict[str, str | None] = {}
        for batch in batches:
            numbers = most.with_those_of(batch)
            for group in _groups(batch):
                ids, lines, kinds = [], [], []
                for i, noise in zip([g[0] for g in group], noise_of(group, model, numbers, known), strict=True):
                    for k, kind in noise:
                        ids.append(i)
                        lines.append(k + 1)
                        kinds.append(kind)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(kinds, pa.string())], ["result_id", "line_no", "kind"])

    return pages.mapInArrow(run, "result_id long, line_no long, kind string").distinct()


def noise_of(group: list[tuple[int, list[str], np.ndarray]], model: Model, numbers: Numbers, known: dict[str, str | None]) -> list[list[tuple[int, str]]]:
    """(line from 0, kind) of each page of a group (id, lines, states). known: words judged so far."""
    out: list[list[tuple[int, str]]] = []
    bodies, owners = [], []
    for _, lines, states in group:
        found: list[tuple[int, str]] = []
        for k, (line, state) in enumerate(zip(lines, states.tolist(), strict=True)):
            if state == HEADER and not line.lstrip().startswith("#"):
                found.append((k, "header"))
            elif state == NUMBER:
                found.append((k, "page_number"))
            elif state == BODY and k + 1 < len(lines) and states[k + 1] == BODY and cut_word(line, lines[k + 1]):
                found.append((k, "hyphen"))
        out.append(found)
        body, owner = body_text(lines, states)
        bodies.append(body)
        owners.append(owner)
    points, starts, lengths = code_points(bodies)
    place, _ = misread_characters(points, model, numbers)
    page = np.searchsorted(starts, place, "right") - 1
    misread: list[set[int]] = [set() for _ in group]
    for p, at in zip(page.tolist(), (place - starts[page]).tolist(), strict=True):
        misread[p].add(owners[p][at])
    words = [set(_WORD.findall(b)) for b in bodies]
    misread_words({w.casefold() for page_words in words for w in page_words}, model, numbers, known)
    for p, page_words in enumerate(words):
        wrong = {w for w in page_words if known[w.casefold()] is not None}
        if wrong:
            misread[p] |= {owners[p][m.start()] for m in _WORD.finditer(bodies[p]) if m[0] in wrong}
        out[p] += [(k, "misread") for k in sorted(misread[p]) if not group[p][1][k].lstrip().startswith("#")]
    return out


def repaired_pages(records: DataFrame, books: DataFrame, contexts: DataFrame, overrides: DataFrame, limit: int = KNOWN) -> DataFrame:
    """(result_id, markdown): each record's text in continuous paragraphs, one line each: without headers, page numbers
    and notices, cut words whole, misread characters put right. Null and empty texts stay as they are."""
    pages = materialize(prepared(records, books, contexts), "pages")
    pages, shared = _noise_parts(pages, overrides, page_bodies, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, most = shared.value
        known: dict[str, str | None] = {}
        for batch in batches:
            numbers = most.with_those_of(batch)
            for group in _groups(batch):
                texts = [page_paragraphs(lines, states, model, numbers, known) for _, lines, states in group]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array(texts, pa.string())], ["result_id", "markdown"])

    done = pages.mapInArrow(run, "result_id long, markdown string")
    rest = records.where("markdown is null or markdown = ''").select(F.col("result_id").cast("long").alias("result_id"), "markdown")
    return done.unionByName(rest)


_OWN_LINE = re.compile(r"\s*(?:#|[-*+>•]\s|\[\^|\d{1,3}[.)]\s|\||【)")


def page_paragraphs(lines: list[str], states: np.ndarray, model: Model, numbers: Numbers, known: dict[str, str | None]) -> str:
    return "\n".join(_corrected(body, model, numbers, known) for body in page_bodies(lines, states))


def page_bodies(lines: list[str], states: np.ndarray) -> list[str]:
    """The page's paragraphs, with empty ones between."""
    paragraphs: list[str] = []
    run: list[int] = []

    def flush() -> None:
        if run:
            body, _ = body_text([lines[i] for i in run], np.zeros(len(run), np.int64))
            paragraphs.append(body)
            run.clear()

    for i, (line, state) in enumerate(zip(lines, states, strict=True)):
        if state == BREAK:
            flush()
            if paragraphs and paragraphs[-1]:
                paragraphs.append("")
        elif state == BODY:
            if _OWN_LINE.match(line):
                flush()
            run.append(i)
    flush()
    while paragraphs and not paragraphs[-1]:
        paragraphs.pop()
    return paragraphs


def _corrected(body: str, model: Model, numbers: Numbers, known: dict[str, str | None]) -> str:
    misread_words({m[0].casefold() for m in _WORD.finditer(body)}, model, numbers, known)

    def put(m: re.Match) -> str:
        right = known.get(m[0].casefold())
        return m[0] if right is None else right.capitalize() if m[0][0].isupper() else right

    points, _, _ = code_points([body])
    place, new = misread_characters(points, model, numbers)
    chars = list(body)
    for at, right in zip(place.tolist(), new.tolist(), strict=True):
        chars[at] = chr(right)
    return _WORD.sub(put, "".join(chars))
