"""Near duplicates, shared spans, encoding and mixing, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixture, near, queries, spans, tokens

DATA = "/root/testdata/sf0.001"


def shingles(text: str) -> set[str]:
    body = "".join(text.split())
    return {body[i : i + 5] for i in range(len(body) - 4)}


def variants(seed: int = 5) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
    rows: list[tuple[int, str | None]] = []
    for g in range(12):
        base = rng.choices(words, k=120)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "short", rows[0][1], rows[0][1].replace(" ", " \n　")])]
    return rows


def test_similar_pairs(spark):
    rows = variants()
    sets = {i: shingles(t) for i, t in rows if t and len("".join(t.split())) >= 200}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    records = spark.createDataFrame([*rows, rows[3]], "id long, text string").withColumn("band", F.lit("clash")).withColumn("class_id", F.lit(0))
    got = [(r["id_a"], r["id_b"]) for r in near.similar_pairs(records, "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["id"]: r["group_id"] for r in near.similar_groups(records, "id", "text").distinct().collect()}
    assert groups == parts(sets, want)
    assert near.similar_pairs(records.limit(0), "id", "text").count() == 0


def parts(ids, pairs):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_groups_of_hot_bands(spark, monkeypatch):
    """Many unequal copies of one page, and pages that only some of these are near to, with bands of a few records."""
    monkeypatch.setattr(near, "BLOCK", 5)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    base = rng.choices(words, k=60)
    rows = []
    for i in range(60):  # copies drift away from the base, so that links are chains
        copy = list(base)
        for j in range(i // 4):
            copy[j] = words[(i * 7 + j) % 300]
        rows.append((1000 - i, " ".join(copy)))
    rows += [(i, " ".join(rng.choices(words, k=60))) for i in range(10)]
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    records = spark.createDataFrame(rows, "id long, text string")
    assert {(r["id_a"], r["id_b"]) for r in near.similar_pairs(records, "id", "text").collect()} == want
    assert {r["id"]: r["group_id"] for r in near.similar_groups(records, "id", "text").collect()} == parts(sets, want)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.7, 0.9):
        got = []
        for t in range(40):
            common = rng.integers(0, 1 << 62, int(800 * share))
            a = np.concatenate([common, rng.integers(0, 1 << 62, (800 - len(common)) // 2)]).astype(np.uint64)
            b = np.concatenate([common, rng.integers(0, 1 << 62, (800 - len(common)) // 2)]).astype(np.uint64)
            low = near.minima(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            x, y = near.pack(low)
            got.append(1 - 2 * sum(int(u ^ v).bit_count() if u ^ v >= 0 else int((u ^ v) & ((1 << 64) - 1)).bit_count() for u, v in zip(x.tolist(), y.tolist(), strict=True)) / 128)
        assert abs(np.mean(got) - share) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102)]
    got = {r["id"]: r["root"] for r in near.components(spark.createDataFrame(chain, "id_a long, id_b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_components_of_a_long_chain(spark):
    """The least id stands at the far end of a chain of rising ids."""
    ids = [*range(5, 301), 0]
    chain = list(zip(ids, ids[1:]))
    got = {r["id"]: r["root"] for r in near.components(spark.createDataFrame(chain, "id_a long, id_b long")).collect()}
    assert got == dict.fromkeys(ids, 0)


def brute_spans(rows, least):
    seen: dict[str, set[int]] = {}
    for i, t in rows:
        for p in range(len(t) - least + 1):
            seen.setdefault(t[p : p + least], set()).add(i)
    out = set()
    for i, t in rows:
        covered = [False] * (len(t) + 1)
        for p in range(len(t) - least + 1):
            if len(seen[t[p : p + least]]) > 1:
                covered[p : p + least] = [True] * least
        start = None
        for p, c in enumerate(covered):
            if c and start is None:
                start = p
            elif not c and start is not None:
                out.add((i, start, p - start))
                start = None
    return out


@pytest.mark.parametrize("group", [2, 5, 12, 48])
def test_shared_spans(spark, group):
    rng = random.Random(group)
    text = lambda n: "".join(rng.choices("abcd 汉字𠀀\n", k=n))
    shared = [text(n) for n in (30, 41, 75, 120, 29)]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(shared) + text(rng.randint(0, 60)) + rng.choice(shared)) for i in range(25)]
    rows += [(50, rows[0][1]), (51, ""), (52, "ab" * 60), (53, "ba" * 70)]
    records = spark.createDataFrame([*rows, (54, None), rows[1]], "id long, text string")
    texts = records.where("text is not null")
    stretches = spans.shared_stretches(texts, 30, key=15, group=group)
    got = {(r["id"], r["start"], r["end"] - r["start"]) for r in spans.runs(stretches).collect()}
    assert got == brute_spans(rows, 30)


def test_shared_shares(spark):
    passage = "".join(random.Random(1).choices("abcdefgh", k=250))
    records = spark.createDataFrame([(1, "x" + passage), (2, passage + "yy"), (3, None), (4, "z")], "id long, text string").withColumn("prefix", F.lit(0))
    got = {r["id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_shares(records, "id", "text").collect()}
    assert got == {1: (251, 250), 2: (252, 250), 3: (0, 0), 4: (1, 0)}


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers
    import tiktoken

    ranks = tokens.read_ranks(tokens.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "  a", "it's we'll 'tis ''s don't'", "中文，标点。 空 格\n\n\t x", "<|endoftext|>", "ab" * 300, "a  \n b   ", "１２３ x²", "龍喚士 裏覚醒", "カラナギの軽い渡し場", "Không có thì", "​⁠x", "🙂👍🏽é", "'", " '", "'sx", "　中 x"]


@pytest.mark.parametrize("head", [100_000, 5, 0])
def test_ids(spark, encoder, head):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(docs, head_limit=head).collect()}
    assert got == {i: encoder.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.encode_corpus(docs, counts_only=True, head_limit=head).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_decode(spark, encoder):
    rows = [(t, encoder.encode_ordinary(t)) for t in TEXTS if t is not None] + [(None, None)]
    back = spark.createDataFrame(rows, "text string, ids array<int>").select("text", tokens.decode_ids(F.col("ids")).alias("back")).collect()
    assert [r["back"] for r in back] == [r["text"] for r in back]


def test_long_pieces(encoder):
    ranks = tokens.read_ranks(tokens.vocabulary_path())
    rng = random.Random(3)
    for _ in range(50):
        piece = "".join(rng.choices("abehlortn", k=rng.randint(1, 400)))
        assert tokens.merge_long(piece.encode(), ranks) == encoder.encode_ordinary(piece)


def test_empty_corpus(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shares():
    assert mixture.shares([(0.5, 1), (0.5, 1)], [100, 100]) == [100, 100]
    given = mixture.shares([(0.6, 1), (0.3, 4), (0.1, 1)], [100, 20, 80])
    assert abs(sum(given) - 200) < 1e-6 and given[0] == 100 and given[1] <= 80 and given[2] <= 80
    assert mixture.shares([(1.0, 1)], [0]) == [0.0]


def test_mixture(spark):
    words = lambda n, i: " ".join(f"w{i}x{k}" for k in range(n))
    docs = [(i, words(40, i), "big" if i % 4 else "small") for i in range(200)] + [(900, None, "big"), (901, "", "small"), (902, "other", "else"), (903, "none", None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("slot", F.lit(0)).withColumn("tokens", F.lit(0))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows = mixture.mixture(table, targets, block=400).collect()
    used: dict = {}
    for r in rows:
        used.setdefault(r["source"], []).append((r["doc_id"], r["repeat"]))
    assert set(used) == {"big", "small"}
    assert all(len(x) == len(set(x)) for x in used.values()) and max(k for _, k in used["small"]) == 2
    total = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in used}
    assert abs(total["big"] / sum(total.values()) - 0.5) < 0.01
    # every stretch of slots has about the shares
    n = max(r["slot"] for r in rows) + 1
    half = {s: sum(r["n_tokens"] for r in rows if r["source"] == s and r["slot"] < n / 2) for s in used}
    assert abs(half["big"] / sum(half.values()) - 0.5) < 0.1
    report = {r["source"]: r for r in mixture.share_report(table, targets).collect()}
    assert report["absent"]["actual_share"] == 0 and report["small"]["most_repeats"] == 2


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark):
    frame = queries.QUERIES[name](spark, DATA)
    assert frame.count() >= 0 and frame.columns
