"""Near-duplicate records by b-bit MinHash.

A record's shingles are hashed into BINS bins, VIEWS times each; a bin keeps its least hash, and an empty bin borrows
that of another one (one permutation hashing with densification), so that a record costs one sort. Of the minima, full
ones make the keys of BANDS bands, and the lowest bit of each makes a packed signature. Records with a band in common
are candidates; the count of equal bits, corrected for those that are equal by chance, estimates their similarity
inside the join, so that only likely pairs leave it. The shingle sets of these are then compared exactly.

Equal texts are one class from the start: only its first record takes part, and the pairs of the others are joined at
the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import WindowHash, chunks, code_points, mix

BINS, VIEWS = 256, 2
#: A pair of similarity 0.75 is missed by all 40 bands of 6 with a chance of 0.0004, one of 0.8 with 0.000005.
BANDS, ROWS = 40, 6
#: Bits of the packed signature (the first bins), in longs of 64.
LONGS = 2
#: An estimate this far under the limit still is a candidate; its error is 0.06.
SLACK = 0.26

WHITE = r"\p{IsWhite_Space}+"


def squeezed(text: Column) -> Column:
    """text without any Unicode white space."""
    return F.regexp_replace(text, WHITE, "")


def minima(shingles: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Hashes of shingles with their documents' numbers; the (n, BINS) least hashes, of 42 bits, dense.
    A document without shingles has only zeros."""
    full = np.full((n, BINS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, n, 1 << 14):
        own = (doc >= lo) & (doc < lo + (1 << 14)) if n > 1 << 14 else slice(None)
        base = (doc[own] - lo).astype(np.uint64) << np.uint64(50)
        keys = [base | (mix(shingles[own] + np.uint64(v)) >> np.uint64(14)) for v in range(VIEWS)]
        keys = np.sort(np.concatenate(keys))
        cell = keys >> np.uint64(42)
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        at = cell[first].astype(np.int64)
        full[lo + (at >> 8), at & 255] = keys[first] & np.uint64((1 << 42) - 1)
    empty = full == np.iinfo(np.uint64).max
    none = empty.all(axis=1)
    full[none] = 0
    empty[none] = False
    turn = 0
    source = full.copy()
    while empty.any():  # borrow from a bin that the empty bin's number and the turn choose, the same in every document
        row, col = np.nonzero(empty)
        turn += 1
        pick = (mix(col.astype(np.uint64) * np.uint64(1000003) + np.uint64(turn)) % np.uint64(BINS)).astype(np.int64)
        value = source[row, pick]
        good = value != np.iinfo(np.uint64).max
        full[row[good], col[good]] = value[good] + np.uint64(turn)
        empty[row[good], col[good]] = False
        if turn > 64:  # very few shingles: the least of all bins
            full[row, col] = np.where(empty[row, col], source[row].min(axis=1), full[row, col])
            break
    return full


def pack(low: np.ndarray) -> np.ndarray:
    """The lowest bits of the first 64 * LONGS minima as (n, LONGS) longs."""
    bits = (mix(low[:, : 64 * LONGS]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).reshape(len(low), LONGS)


def band_keys(low: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of ROWS minima each."""
    key = np.zeros((len(low), BANDS), np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + low[:, r : BANDS * ROWS : ROWS] + np.uint64(r + 1))
    key = mix(key + np.arange(BANDS, dtype=np.uint64))
    return key.view(np.int64)


def character_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k characters, with their texts' numbers."""
    points, starts, lengths = code_points(texts)
    n = np.maximum(lengths - k + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + starts[doc]
    return WindowHash(points).windows(k)[at], doc


def word_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, with their texts' numbers. A word is a run of letters and digits; in scripts
    without spaces each character is one. A text of fewer words is one shingle."""
    points, starts, lengths = code_points(texts)
    cjk = (points >= 0x2E80) & (points < 0xE000) | (points >= 0xF900) & (points < 0xFB00) | (points >= 0x20000)
    word = _word_table()[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    start = word.copy()
    start[1:] &= ~word[:-1] | cjk[1:] | cjk[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cjk[1:] | cjk[:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = WindowHash(points).of(a, b)
    doc = np.searchsorted(starts, a, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + first[owner]
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        inside = i < n_words[owner]
        h = np.where(inside, mix(h * np.uint64(0x100000001B3) + words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else h), h)
    return h, owner


_TABLE: list[np.ndarray] = []


def _word_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000))
    return _TABLE[0]


SHINGLES = {"characters": character_shingles, "words": word_shingles}


def signatures(texts: DataFrame, kind: str, k: int) -> DataFrame:
    """texts: (id, text). One row a text: (id, bands ARRAY<BIGINT>, low0, low1, ...)."""
    shingle = SHINGLES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").to_pylist()
            for lo, hi in chunks(column):
                low = minima(*shingle(column[lo:hi], k), hi - lo)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(low).ravel()), BANDS).cast(pa.list_(pa.int64()))
                packed = pack(low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), bands, *(pa.array(packed[:, i]) for i in range(LONGS))], ["id", "bands", *(f"low{i}" for i in range(LONGS))]
                )

    lows = ", ".join(f"low{i} long" for i in range(LONGS))
    return texts.select("id", "text").mapInArrow(run, f"id long, bands array<long>, {lows}")


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of equal bits, less those that are equal by chance."""
    unequal = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.low{i}").bitwiseXOR(F.col(f"{b}.low{i}"))) for i in range(LONGS)))
    return 1 - 2 * unequal / F.lit(64 * LONGS)


#: Records of one band that meet in one task; larger bands are split.
BLOCK = 500


def _banded(signed: DataFrame) -> DataFrame:
    """One row a record and band: (id, low0, ..., band)."""
    lows = [f"low{i}" for i in range(LONGS)]
    return signed.select(*(c for c in signed.columns if c in ("id", "part")), *lows, F.explode("bands").alias("band"))


def _likely(left: DataFrame, right: DataFrame, limit: float, more: Column) -> DataFrame:
    """Pairs (id_a < id_b) of rows of left and right with a band in common whose estimate is not far under limit, once
    each. Of a large band, each left row has one of several salts, and each right one comes with all."""
    # as a table whose size is known, so that a small one is broadcast
    large = left.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("salts"))
    large = materialize(large, "large")
    near = (estimate("a", "b") >= limit - SLACK) & more
    pair = (F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))
    a, b = (side.join(large, "band", "left_anti").alias(name) for side, name in ((left, "a"), (right, "b")))
    small = a.join(b, (F.col("a.band") == F.col("b.band")) & near).select(*pair)
    a = left.join(large, "band").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).alias("a")
    b = right.join(large, "band").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    split = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.salt") == F.col("b.salt")) & near).select(*pair)
    return small.unionByName(split).distinct()


def candidates(signed: DataFrame, limit: float) -> DataFrame:
    """Pairs (id_a < id_b) with a band in common whose estimate is not far under limit, once each."""
    banded = _banded(signed)
    return _likely(banded, banded, limit, F.col("a.id") < F.col("b.id"))


def _jaccard(kind: str, k: int):
    shingle = SHINGLES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            for lo, hi in chunks([x + y for x, y in zip(left, right, strict=True)], 1 << 19):
                sets = []
                for column in (left, right):
                    h, doc = shingle(column[lo:hi], k)
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    sets.append((h[new], doc[new]))
                (ha, da), (hb, db) = sets
                h, doc = np.concatenate([ha, hb]), np.concatenate([da, db])
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
                both = np.bincount(doc[1:][same], minlength=hi - lo)
                union = np.bincount(doc, minlength=hi - lo) - both
                value = np.divide(both, union, out=np.zeros(hi - lo), where=union > 0)
                yield pa.RecordBatch.from_arrays([batch.column("id_a").slice(lo, hi - lo), batch.column("id_b").slice(lo, hi - lo), pa.array(value)], ["id_a", "id_b", "similarity"])

    return run


def checked(pairs: DataFrame, texts: DataFrame, limit: float, kind: str, k: int) -> DataFrame:
    """pairs: (id_a, id_b); texts: (id, text). (id_a, id_b, similarity) of those of at least limit."""
    wanted = texts.join(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "id", "left_semi")
    return (
        pairs.join(wanted.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
        .join(wanted.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
        .select("id_a", "id_b", "text_a", "text_b")
        .mapInArrow(_jaccard(kind, k), "id_a long, id_b long, similarity double")
        .where(F.col("similarity") >= limit)
    )


def signed_classes(texts: DataFrame, kind: str, k: int) -> tuple[DataFrame, DataFrame]:
    """texts: (id BIGINT, text). Members of the classes of equal texts (id, class_id: its least id), and the signatures
    of one text of each class."""
    keyed = texts.select("id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.length("text").alias("n"))
    firsts = keyed.groupBy("h1", "h2", "n").agg(F.min("id").alias("class_id"), F.max("id").alias("last"))
    several = firsts.where("class_id < last").drop("last")
    members = materialize(keyed.join(several, ["h1", "h2", "n"]).select("id", "class_id"), "members")
    others = members.where("id <> class_id").select("id")
    return members, materialize(signatures(texts, kind, k).join(others, "id", "left_anti"), "signatures")


def similar_classes(texts: DataFrame, limit: float, kind: str, k: int) -> tuple[DataFrame, DataFrame]:
    """texts: (id BIGINT, text). Members of the classes of equal texts (id, class_id: its least id), and pairs of class
    ids (id_a, id_b, similarity) of at least limit."""
    members, signed = signed_classes(texts, kind, k)
    pairs = materialize(candidates(signed, limit), "candidates")
    return members, checked(pairs, texts, limit, kind, k)


def linked_classes(texts: DataFrame, limit: float, kind: str, k: int) -> tuple[DataFrame, DataFrame]:
    """texts: (id BIGINT, text). Members of the classes of equal texts (id, class_id), and (id, root) of class ids that
    chains of similar pairs connect: the parts that all pairs would give, by few of them.

    First each text is compared with the least one of each of its bands. What that connects is one part already; within
    a band only texts of other parts than the one that most of its texts belong to meet the rest, so that a band full of
    near copies takes as many comparisons as it has texts, not pairs."""
    members, signed = signed_classes(texts, kind, k)
    banded = _banded(signed)
    least = banded.groupBy("band").agg(F.min("id").alias("low_id"), F.count("*").alias("n")).where("n > 1").select("band", "low_id")
    stars = banded.join(least, "band").where("id > low_id").select(F.col("low_id").alias("id_a"), F.col("id").alias("id_b")).distinct()
    near = materialize(checked(materialize(stars, "stars"), texts, limit, kind, k).select("id_a", "id_b"), "near")
    roots = components(near)
    # one part a text: its root, or itself
    parted = materialize(signed.join(roots, "id", "left").withColumn("part", F.coalesce("root", "id")).drop("root"), "parted")
    banded = _banded(parted)
    sizes = banded.groupBy("band", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("band", "most")
    several = banded.join(most, "band")
    others = several.where("part <> most").drop("most")
    # two texts outside the band's main part meet once, one outside meets all inside
    once = (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.most")) | (F.col("a.id") < F.col("b.id")))
    more = materialize(_likely(others, several, limit, once), "candidates")
    found = checked(more, texts, limit, kind, k).select("id_a", "id_b")
    return members, components(near.unionByName(materialize(found, "near")))


def similar_pairs(records: DataFrame, id_column: str, text_column: str, limit: float = 0.7, k: int = 5, least: int = 200) -> DataFrame:
    """Pairs (id_a < id_b) of records whose texts, without white space, have at least least characters each and sets
    of k-character substrings with a Jaccard similarity of at least limit. Null texts have no pairs; rows with an id
    that is null have none; a row given twice counts once."""
    texts = _texts(records, id_column, text_column, least)
    members, pairs = similar_classes(texts, limit, "characters", k)
    pairs = materialize(pairs.select("id_a", "id_b"), "pairs")
    every = members.select(F.col("class_id").alias("c"), "id")
    # all records of the two classes of each pair, and the pairs within a class
    between = (
        pairs.join(every.withColumnsRenamed({"c": "id_a", "id": "x"}), "id_a", "left")
        .join(every.withColumnsRenamed({"c": "id_b", "id": "y"}), "id_b", "left")
        .select(F.coalesce("x", "id_a").alias("x"), F.coalesce("y", "id_b").alias("y"))
    )
    within = every.alias("p").join(every.alias("q"), (F.col("p.c") == F.col("q.c")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("x"), F.col("q.id").alias("y"))
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _texts(records: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    text = squeezed(F.col(text_column))
    return records.select(F.col(id_column).cast("long").alias("id"), text.alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))


def similar_groups(records: DataFrame, id_column: str, text_column: str, limit: float = 0.7, k: int = 5, least: int = 200) -> DataFrame:
    """One row a record with a text of at least least characters: (id, group_id): the least id of all records that a
    chain of similar pairs connects it with. A row given twice comes twice."""
    texts = _texts(records, id_column, text_column, least)
    members, roots = linked_classes(texts, limit, "characters", k)
    return (
        texts.select("id")
        .join(members.distinct(), "id", "left")
        .withColumn("class_id", F.coalesce("class_id", "id"))
        .join(roots.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select("id", F.coalesce("root", "class_id").alias("group_id"))
    )


def components(pairs: DataFrame) -> DataFrame:
    """pairs: (id_a, id_b). (id, root) with the least id of each connected component, by alternating large-star and
    small-star steps: each node links its greater neighbours, then its lesser ones, to the least node around it, until
    no link changes and each component is a star. Each step is a join and is written, so that the plan stays short.
    Whatever the order of the ids, the number of turns grows with the square of the logarithm of their number at most."""
    ends = pairs.where("id_a <> id_b").select(F.greatest("id_a", "id_b").alias("high"), F.least("id_a", "id_b").alias("low"))
    links = materialize(ends.distinct(), "links")
    state = _digest(links)
    while True:
        links = materialize(_small_star(materialize(_large_star(links), "links")), "links")
        before, state = state, _digest(links)
        if state == before:
            break
    return links.select(F.col("high").alias("id"), F.col("low").alias("root")).unionByName(links.select(F.col("low").alias("id"), F.col("low").alias("root")).distinct())


def _digest(links: DataFrame) -> tuple[int, int, int]:
    """The number of links with two sums of hashes, which tell whether any link moved."""
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("high", "low").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)), F.coalesce(F.sum(F.hash("low", "high").cast("long")), F.lit(0))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """The greater neighbours of each node, linked to the least of the node and all its neighbours."""
    both = links.select(F.col("high").alias("id"), F.col("low").alias("other")).unionByName(links.select(F.col("low").alias("id"), F.col("high").alias("other")))
    least = both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("low"))
    return links.select(F.col("low").alias("id"), "high").join(least, "id").select("high", "low").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours, linked to the least of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return least.select("high", F.col("least").alias("low")).unionByName(moved).distinct()
