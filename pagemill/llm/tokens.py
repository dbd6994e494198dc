"""Ids of a whole corpus under a byte-level BPE of ranked merges.

The text is split by the vocabulary's pattern, and once more behind every character that no token of the vocabulary
reaches across. The second cut changes no id, since a merge never crosses it, and leaves few distinct pieces, also in
scripts that write without spaces. Only distinct pieces are encoded: Spark's higher-order functions fold the ranked
merges over the bytes of a piece, the ranks being a literal of the plan. The ids of the pieces then go to the
documents: those of the most frequent pieces, up to head_limit, by broadcast; where a text has others, a mark stands for
each, and only these pieces are joined and put in. They are rare, so that no key of the join is hot.
"""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import WindowHash, chunks, code_points

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most pieces that are sent to the executors at once (about 60 MB); only others, if there are any, are joined.
HEAD_LIMIT = 400_000
#: A piece of more bytes is merged by a task's own heap, not by the fold, whose work grows with the square.
FOLD_BYTES = 96
#: Buckets of the rank literal; each is a map of about a dozen entries.
BUCKETS = 4096
#: White space of the pattern (the Unicode property, which has no file separators).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(folder: str | None = None) -> str:
    """folder: where the public vocabularies lie; without it, the installed package public_tokenizers tells."""
    if folder:
        return f"{folder.rstrip('/')}/{VOCABULARY}"
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Classes of characters in the pattern.
OTHER, LETTER, CUT, NUMBER, WHITE, END = range(6)


@lru_cache(maxsize=4)
def character_classes(path: str) -> np.ndarray:
    """The class of every code point; CUT is a letter behind which a letter run may be cut, since no token of the
    vocabulary reaches across its end."""
    ranks = read_ranks(path)
    # what stands in some token before the start of a character: as a whole, for parts of one, and its last characters
    before = {t[:k] for t in ranks for k in range(1, len(t)) if t[k - 1] >= 0x80 and (t[k] < 0x80 or t[k] >= 0xC0)}
    last = {u[-n:] for u in before for n in (2, 3, 4)}
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "N":
            out[cp] = NUMBER
        elif kind == "L":
            b = chr(cp).encode()
            inside = len(b) == 1 or b in last or any(b[i:] in before for i in range(1, len(b)))
            out[cp] = LETTER if inside else CUT
    out[[ord(c) for c in SPACE]] = WHITE
    return out


def split_pieces(points: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts that are each followed by one END (a 0 at the places given in classes).

    The pattern in terms of neighbours: a run of one class is a piece; a blank before it belongs to it; of several
    white characters before a run, the last stands alone or, as a blank, belongs to the run; a short form behind an
    apostrophe that starts a piece is one; behind a CUT letter a run is cut."""
    n = len(points)
    run = classes.copy()
    run[classes == CUT] = LETTER
    start = np.ones(n, bool)
    start[1:] = run[1:] != run[:-1]
    solid = (run != WHITE) & (run != END)
    white_then_solid = np.zeros(n, bool)  # at the last white character before a run
    white_then_solid[:-1] = (run[:-1] == WHITE) & solid[1:]
    start |= white_then_solid
    blank = white_then_solid & (points == 0x20)
    start[1:][blank[:-1]] = False
    start[1:] |= (classes[:-1] == CUT) & (run[1:] == LETTER)
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (run[1:] == LETTER))
    if len(quote):
        at = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = at[quote + 1], at[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for places, k in ((quote[single], 1), (quote[double], 2)):
            start[places + 1] = False
            start[places + 1 + k] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = classes[starts] != END
    return starts[keep], ends[keep]


def _latin(piece: Column) -> Column:
    """A piece as text of one character a byte."""
    return F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array of maps: token, one character a byte, to its rank; the array's place is the
    token's CRC-32 modulo BUCKETS, since a lookup in one large map would read it from its start."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def fold_merges(piece: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a piece: of all neighbours that form a token, the pair of lowest rank (the leftmost of several) becomes
    one, as often as there is one. An empty piece has no ids; null stays null."""
    # the aggregate over one value only names the literal, so that the plan holds it once
    return F.aggregate(F.array(rank_literal(ranks)), F.array().cast("array<int>"), lambda _, table: _folded(piece, table))


def _folded(piece: Column, table: Column) -> Column:
    none = F.lit(1 << 30)

    def rank(token: Column) -> Column:
        bucket = F.get(table, (F.crc32(token) % BUCKETS).cast("int"))
        return F.coalesce(bucket[token], none)

    def merged(state: Column) -> Column:
        """The state after the merge of the lowest rank; at: its place, from 1. Only the ranks beside it change."""
        parts, ranks_, at = state["parts"], state["ranks"], state["at"]
        token = F.concat(F.get(parts, at - 1), F.get(parts, at))
        left = F.when(at > 1, F.array(rank(F.concat(F.get(parts, at - 2), token)))).otherwise(F.array().cast("array<int>"))
        right = F.when(at + 1 < F.size(parts), F.array(rank(F.concat(token, F.get(parts, at + 1))))).otherwise(F.array().cast("array<int>"))
        rest = F.size(parts) - at - 1
        return state_of(
            F.concat(F.slice(parts, F.lit(1), at - 1), F.array(token), F.slice(parts, at + 2, F.greatest(rest, F.lit(0)))),
            F.concat(F.slice(ranks_, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks_, at + 2, F.greatest(rest - 1, F.lit(0)))),
        )

    def state_of(parts: Column, ranks_: Column) -> Column:
        return F.struct(parts.alias("parts"), ranks_.alias("ranks"))

    def placed(state: Column) -> Column:
        low = F.array_min(state["ranks"])
        at = F.when(low < none, F.array_position(state["ranks"], low)).otherwise(0).cast("int")
        return F.struct(state["parts"].alias("parts"), state["ranks"].alias("ranks"), at.alias("at"))

    def step(state: Column, _: Column) -> Column:
        # the aggregate over one value only names it, so that it is computed once
        return F.aggregate(F.array(placed(state)), state, lambda now, s: F.when(s["at"] > 0, merged(s)).otherwise(now))

    parts = F.filter(F.split(_latin(piece), ""), lambda c: c != "")
    first = F.aggregate(
        F.array(parts),
        state_of(F.array().cast("array<string>"), F.array().cast("array<int>")),
        lambda _, p: state_of(p, F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: rank(F.concat(x, F.get(p, i + 1))))),
    )
    turns = F.sequence(F.lit(1), F.greatest(F.octet_length(piece), F.lit(1)))
    return F.transform(F.aggregate(turns, first, step)["parts"], rank)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long piece, with a heap of pairs."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    alive = [True] * n
    while heap:
        r, i, stop = heappop(heap)
        if not alive[i] or end[i] >= n or not (j := end[i]) < n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (s := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (s, i, end[stop]))
        if (h := before[i]) >= 0 and (s := ranks.get(piece[h:stop])) is not None:
            heappush(heap, (s, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _pieces(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """Of each piece its text's number, start, end and hash; starts count in the joined text, which comes last."""
    points, at, lengths = code_points(texts)
    classes = table[points]
    classes[at + lengths] = END
    starts, ends = split_pieces(points, classes)
    return np.searchsorted(at, starts, "right") - 1, starts, ends, WindowHash(points).of(starts, ends).view(np.int64), points.tobytes()


def count_pieces(texts: DataFrame, path: str) -> DataFrame:
    """texts: column text. Distinct pieces with their 64-bit hash and number (hash, piece, n)."""
    shared = texts.sparkSession.sparkContext.broadcast(character_classes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_pylist()
            for lo, hi in chunks(column):
                _, starts, ends, hashes, raw = _pieces(column[lo:hi], shared.value)
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                names = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(names, pa.string()), pa.array(n)], ["hash", "piece", "n"])

    found = texts.select("text").mapInArrow(run, "hash long, piece string, n long")
    return found.groupBy("hash").agg(F.min("piece").alias("piece"), F.sum("n").alias("n"))


def encode_pieces(pieces: DataFrame, path: str) -> DataFrame:
    """pieces: (hash, piece, n). Adds ids."""
    ranks = read_ranks(path)
    shared = pieces.sparkSession.sparkContext.broadcast(ranks)
    short = F.octet_length("piece") <= FOLD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [merge_long(p.encode(), shared.value) for p in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("hash"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["hash", "n", "ids"])

    folded = pieces.where(short).select("hash", "n", fold_merges(F.col("piece"), ranks).alias("ids"))
    return folded.unionByName(pieces.where(~short).select("hash", "piece", "n").mapInArrow(run, "hash long, n long, ids array<int>"))


def _assemble(texts: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray, counts_only: bool) -> DataFrame:
    """texts: (row, doc_id, text). head: sorted hashes of pieces, bounds of their ids, and these. (row, doc_id, value, missing): the ids
    or their number, with -1 in place of each piece that head lacks (which counts nothing), and the hashes of these."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((head, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, bounds, flat), classes = shared.value
        sizes = np.append(np.diff(bounds), 0 if counts_only else 1)  # the last one: a piece that head lacks
        begins = np.append(bounds[:-1], len(flat))
        values = np.append(flat, np.int32(-1))
        for batch in batches:
            column = batch.column("text").to_pylist()
            for lo, hi in chunks(column):
                doc, _, _, hashes, _ = _pieces(column[lo:hi], classes)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                at = np.where(hit, at, len(known))
                n = sizes[at]
                per = np.bincount(doc, weights=n, minlength=hi - lo).astype(np.int64)
                gone = np.bincount(doc[~hit], minlength=hi - lo)
                missing = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(gone)]), pa.int32()), pa.array(hashes[~hit]))
                if counts_only:
                    value = pa.array(per, pa.int64())
                else:
                    total = int(n.sum())
                    places = np.arange(total) + np.repeat(begins[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if total else np.zeros(0, np.int64)
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(values[places]))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), value, missing], ["row", "doc_id", "value", "missing"])

    key = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"row long, doc_id {key}, value {'long' if counts_only else 'array<int>'}, missing array<long>")


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, value, found ARRAY<STRUCT<k, ids>>) to (doc_id, value) with the ids of the k-th missing piece in place of
    the k-th mark."""
    for batch in batches:
        out = []
        for value, found in zip(batch.column("value"), batch.column("found"), strict=True):
            ids = value.values.to_numpy()
            parts = sorted(((x["k"], x["ids"]) for x in found.as_py()), key=lambda x: x[0])
            cuts = np.flatnonzero(ids == -1)
            pieces = [x for a, b, (_, own) in zip(np.append(-1, cuts[:-1]) + 1, cuts, parts, strict=True) for x in (ids[a:b], np.array(own, np.int32))]
            out.append(np.concatenate([*pieces, ids[cuts[-1] + 1 :]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "value"])


def _head(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most head_limit pieces, for the broadcast."""
    rows = pieces.select("hash", "ids").toArrow().sort_by("hash")
    ids = rows["ids"].combine_chunks()
    flat = ids.flatten().to_numpy().astype(np.int32)
    return rows["hash"].to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64), flat


def encode_corpus(docs: DataFrame, folder: str | None = None, counts_only: bool = False, head_limit: int = HEAD_LIMIT) -> DataFrame:
    """docs: doc_id (any type, need not be unique), text; other columns are ignored. One row a row of docs:
    (doc_id, ids ARRAY<INT>), or with counts_only (doc_id, n_tokens). Names of special tokens are plain text. An empty
    and a null text have the empty list. An empty table gives an empty table."""
    path = vocabulary_path(folder)
    table = character_classes(path)
    name = "n_tokens" if counts_only else "ids"
    known = materialize(encode_pieces(count_pieces(docs.select("text"), path), path), "pieces")
    head = _head(known.orderBy(F.desc("n"), "hash").limit(head_limit))
    # the rows' numbers are drawn once, and kept by the table
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    first = materialize(_assemble(rows, head, table, counts_only), "first")
    rare = first.where(F.size("missing") > 0)
    asked = rare.select("row", F.posexplode("missing").alias("k", "hash")).join(known.select("hash", "ids"), "hash")
    if counts_only:
        more = asked.groupBy("row").agg(F.sum(F.size("ids")).alias("more"))
        done = rare.join(more, "row").select("doc_id", (F.col("value") + F.col("more")).alias("value"))
    else:
        found = asked.groupBy("row").agg(F.collect_list(F.struct("k", "ids")).alias("found"))
        key = first.schema["doc_id"].dataType.simpleString()
        done = rare.join(found, "row").select("doc_id", "value", "found").mapInArrow(_filled, f"doc_id {key}, value array<int>")
    return first.where(F.size("missing") == 0).select("doc_id", "value").unionByName(done).withColumnRenamed("value", name)


def decode_ids(ids: Column, folder: str | None = None) -> Column:
    """The text of ids: the pieces' bytes, concatenated. Null stays null, an unknown id has no bytes."""
    ranks = read_ranks(vocabulary_path(folder))
    hexes = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        hexes[rank] = token.hex()
    table = F.from_json(F.lit(json.dumps(hexes)), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")), "UTF-8")
