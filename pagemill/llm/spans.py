"""Long exact spans that several records share, by prefix-partitioned suffix trees.

Every stretch of `least` characters holds a window of KEY characters whose hash is the least of all such windows in
it; equal stretches choose equal windows at equal places. Only suffixes from these places (two in a hundred) are kept,
and those whose first KEY characters, the prefix that partitions them, occur in one record alone are dropped by a
count. The rest meet by prefix: sorted, with the lengths of their common beginnings, they are the leaves and inner
nodes of that prefix's suffix subtree, and the nodes, lengthened to the left, are the repeats.

The prefixes have the length that leaves their groups small. A prefix of more than GROUP suffixes is lengthened by half
of what is missing to `least` characters, once to the right and once to the left, since each stretch around it holds one
of the two; what is still too large is lengthened to all windows of `least` characters around it. Suffixes that agree in
those are repeats already, and need no tree but a count with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import WindowHash, chunks, code_points, mix

KEY = 100
#: Most suffixes of one prefix that are sorted in one task.
GROUP = 48
#: Suffixes that a task looks at together.
BLOCK = 4000
_PLACE = np.uint64((1 << 24) - 1)


def _anchors(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose window of key characters has the least hash (the leftmost of several) of all windows of some
    stretch of least characters, with their texts' numbers. h: the windows' hashes by place."""
    width = least - key + 1
    docs = np.flatnonzero(lengths >= least)
    if not len(docs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who = np.repeat(np.arange(len(docs)), n)
        return who, np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)

    # all places of the long texts in whole blocks of width: the hash's upper bits, and the place to break ties
    n = lengths[docs] - key + 1
    padded = -(-n // width) * width + width
    base = np.concatenate([[0], np.cumsum(padded)])
    who, inside = spread(n)
    flat = np.full(base[-1], np.iinfo(np.uint64).max, np.uint64)
    flat[base[who] + inside] = h[starts[docs][who] + inside] & ~_PLACE | inside.astype(np.uint64) & _PLACE
    blocks = flat.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()  # least from the block's start to here
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()  # least from here to the block's end
    who, at = spread(lengths[docs] - least + 1)
    here = base[who] + at
    low = np.minimum(behind[here], ahead[here + width - 1])
    place = at + (((low & _PLACE).astype(np.int64) - at) & int(_PLACE))
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (who[1:] != who[:-1])
    doc = docs[who[new]]
    return place[new] + starts[doc], doc


def suffixes(texts: DataFrame, key: int, least: int) -> DataFrame:
    """texts: (id, text). The kept suffixes: (prefix, id, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("text").to_pylist(), batch.column("id").to_numpy()
            for lo, hi in chunks(column):
                points, starts, lengths = code_points(column[lo:hi])
                h = WindowHash(points).windows(key)
                place, doc = _anchors(h, starts, lengths, key, least)
                yield pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array((place - starts[doc]).astype(np.int32))], ["prefix", "id", "at"])

    return texts.select("id", "text").mapInArrow(run, "prefix long, id long, at int")


def _contexts(key: int, least: int):
    """Rows (id, text, suffixes ARRAY<STRUCT<prefix, at, hot>>) to (prefix, hot, id, at, left, right): the up to
    least - key characters before the suffix, reversed, and its up to least first ones."""
    side = least - key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "hot", "id", "at", "left", "right"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = []
                part = batch.slice(lo, 1000)
                for i, text, found in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                    for s in found:
                        at = s["at"]
                        rows.append((s["prefix"], s["hot"], i, at, text[max(0, at - side) : at][::-1], text[at : at + least]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _matrix(texts: list[str], width: int) -> np.ndarray:
    """(n, width) code points; behind a text's end stand numbers that differ from row to row."""
    points, starts, lengths = code_points(texts)
    n = len(texts)
    col = np.arange(width)
    out = np.broadcast_to((np.arange(n, dtype=np.uint32) + np.uint32(0x200000))[:, None], (n, width)).copy()
    inside = col[None, :] < lengths[:, None]
    at = starts[:, None] + col[None, :]
    out[inside] = points[at[inside]]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each two rows."""
    unequal = a != b
    return np.where(unequal.any(axis=1), unequal.argmax(axis=1), a.shape[1])


def subtree_repeats(prefix: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, key: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by prefix. For each, how far to the left and right of its start reach the repeats in other
    records of at least `least` characters around its prefix (0, 0: there are none). Each such repeat holds the prefix,
    so that together they are one stretch."""
    n = len(prefix)
    # within a prefix, the order of the leaves of its suffix tree
    order = _leaf_order(prefix, right)
    p, i, lt, rt = prefix[order], ids[order], left[order], right[order]
    reach_left, reach_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # depth of the node above each two neighbouring leaves
    depth = np.zeros(n, np.int64)
    if n > 1:
        depth[:-1] = np.where(p[1:] == p[:-1], _common(rt[1:], rt[:-1]), 0)
    over = depth.copy()
    for step in range(1, n):
        # over: the depth of the lowest node above leaf x and leaf x + step
        x = np.flatnonzero(over[: n - step] >= key)
        if not len(x):
            break
        y = x + step
        x, y = x[i[x] != i[y]], y[i[x] != i[y]]
        r = over[x]
        back = _common(lt[x], lt[y])
        good = r + back >= least
        x, y, r, back = x[good], y[good], r[good], back[good]
        for side in (x, y):
            np.maximum.at(reach_left, side, back)
            np.maximum.at(reach_right, side, r)
        over[: n - step - 1] = np.minimum(over[: n - step - 1], depth[step : n - 1])
        over[n - step - 1 :] = 0
    out_left, out_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_left[order], out_right[order] = reach_left, reach_right
    return out_left, out_right


def _leaf_order(prefix: np.ndarray, right: np.ndarray) -> np.ndarray:
    rows = np.concatenate([prefix.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(len(prefix), 8), right.astype(">u4").view(np.uint8).reshape(len(right), -1)], axis=1)
    return np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")


def _trees(key: int, least: int):
    """Rows (prefix, id, at, left, right), all of one prefix together, to stretches (id, start, end)."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        at = rows["at"].to_numpy().astype(np.int64)
        ids = rows["id"].to_numpy()
        left, right = subtree_repeats(
            rows["prefix"].to_numpy(), ids, _matrix(rows["left"].to_pylist(), least - key), _matrix(rows["right"].to_pylist(), least), key, least
        )
        found = right > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array((at - left)[found]), pa.array((at + right)[found])], ["id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                kept.append(batch.slice(lo, BLOCK))
                rows = pa.Table.from_batches(kept)
                prefix = rows["prefix"].to_numpy()
                # the last prefix may go on in the next rows
                cut = int(np.searchsorted(prefix, prefix[-1])) if len(prefix) else 0
                if cut:
                    yield work(rows.slice(0, cut))
                kept = rows.slice(cut).to_batches()
        if kept:
            yield work(pa.Table.from_batches(kept))

    return run


def _windows(key: int, least: int):
    """Rows of a large prefix to all windows around their suffixes: (window, id, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                before, after = part.column("left").to_pylist(), part.column("right").to_pylist()
                texts = [x[::-1] + y for x, y in zip(before, after, strict=True)]
                points, starts, lengths = code_points(texts)
                h = WindowHash(points).windows(least)
                n = np.maximum(lengths - least + 1, 0)
                row = np.repeat(np.arange(len(texts)), n)
                offset = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                begin = part.column("at").to_numpy().astype(np.int64) - np.fromiter(map(len, before), np.int64, len(before))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(h[starts[row] + offset]).view(np.int64)), pa.array(part.column("id").to_numpy()[row]), pa.array(begin[row] + offset)], ["window", "id", "start"]
                )

    return run


def _lengthen(key: int, least: int):
    """Rows (prefix, id, at, left, right) of prefixes of key characters to the same of longer ones: those that start at
    the same place, and those that end there."""
    longer = key + -(-(least - key) // 2)
    more, side = longer - key, least - longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                rows = []
                for i, at, left, right in zip(*(part.column(c).to_pylist() for c in ("id", "at", "left", "right")), strict=True):
                    if len(right) >= longer:
                        rows.append((i, at, left[:side], right))
                    if len(left) >= more:
                        rows.append((i, at - more, left[more : more + side], (left[:more][::-1] + right)[:least]))
                if not rows:
                    continue
                ids, places, lefts, rights = map(list, zip(*rows, strict=True))
                points, starts, _ = code_points(rights)
                prefix = WindowHash(points).windows(longer)[starts]
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["prefix", "id", "at", "left", "right"])

    return run, longer


def shared_stretches(texts: DataFrame, least: int, key: int = KEY, group: int = GROUP) -> DataFrame:
    """texts: (id BIGINT, unique; text, not null). Stretches (id, start, end) of at least `least` characters that also
    occur in another record; their union is complete, while single ones may overlap."""
    if key > least:
        raise ValueError("the prefix is longer than the spans")
    # equal texts: each is shared as a whole, and one of them stands for all
    keyed = texts.select("id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.length("text").alias("n")).where(F.col("n") >= least)
    copies = keyed.groupBy("h1", "h2", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = materialize(keyed.join(copies, ["h1", "h2", "n"]).select("id", "n", (F.col("id") == F.col("first")).alias("first")), "copies")
    kept = materialize(suffixes(texts.where(F.length("text") >= least), key, least).join(members.where("not first").select("id"), "id", "left_anti"), "suffixes")
    repeated = kept.groupBy("prefix").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("prefix", (F.col("n") > group).alias("hot"))
    found = kept.join(repeated, "prefix").groupBy("id").agg(F.collect_list(F.struct("prefix", "at", "hot")).alias("found"))
    around = materialize(
        texts.join(found, "id").select("id", "text", "found").mapInArrow(_contexts(key, least), "prefix long, hot boolean, id long, at int, left string, right string"), "contexts"
    )
    columns = ["prefix", "id", "at", "left", "right"]

    def trees(rows: DataFrame, length: int) -> DataFrame:
        return rows.select(columns).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees(length, least), "id long, start long, end long")

    cold = trees(around.where("not hot"), key)
    run, longer = _lengthen(key, least)
    grown = materialize(around.where("hot").select(columns).mapInArrow(run, "prefix long, id long, at int, left string, right string"), "longer")
    sizes = grown.groupBy("prefix").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("prefix", (F.col("n") > group).alias("hot"))
    sized = materialize(grown.join(sizes, "prefix"), "sized")
    warm = trees(sized.where("not hot"), longer)
    windows = sized.where("hot").select(columns).mapInArrow(_windows(longer, least), "window long, id long, start long")
    often = windows.groupBy("window").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("window")
    hot = windows.join(often, "window").select("id", "start", (F.col("start") + least).alias("end"))
    whole = members.select("id", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    return cold.unionByName(warm).unionByName(hot).unionByName(whole)


def runs(stretches: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a record joined: (id, start, end)."""
    w = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        stretches.distinct()
        .withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("run")
    )


def shared_spans(records: DataFrame, id_column: str, text_column: str, least: int = 200) -> DataFrame:
    """The maximal runs (id, span_start, span_chars) of characters of a record's text in which every character lies in
    some stretch of `least` characters that also occurs in another record's text. Null texts and ids take no part; a row
    given twice is one record. Texts under `least` characters and empty tables have no spans."""
    texts = records.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    return runs(shared_stretches(texts, least)).select("id", F.col("start").alias("span_start"), (F.col("end") - F.col("start")).alias("span_chars"))


def shared_shares(records: DataFrame, id_column: str, text_column: str, least: int = 200) -> DataFrame:
    """Of every record: (id, n_chars, n_spans, shared_chars, shared_share). A null or empty text has the share 0."""
    spans = shared_spans(records, id_column, text_column, least).groupBy("id").agg(F.count("*").alias("n_spans"), F.sum("span_chars").alias("shared_chars"))
    return (
        records.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.length(text_column), F.lit(0)).cast("long").alias("n_chars"))
        .join(spans, "id", "left")
        .select(
            "id",
            "n_chars",
            F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
            F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"),
            F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_share"),
        )
    )
