"""One mixture of several sources with target shares of its tokens.

The mixture has as many tokens as its sources taken once. A source gets its target share, but no more than its own
tokens times max_repeats; what that leaves over goes to the others in proportion to their targets. Its documents, in a
new shuffled order for each repeat, make a stream that is cut into blocks of equal tokens. Golden-ratio points, mapped
through the cumulative shares, say which source each slot of the mixture takes; the k-th slot of a source is joined
with its k-th block, so that every stretch of the mixture has about the target shares.

Running sums over a source run in two levels, within buckets of bounded size and over the buckets' sums, so that no
source, however large, comes together in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import encode_corpus

#: Tokens of a block.
BLOCK = 8192
#: Documents of a bucket and slots of a chunk, about.
BUCKET = 50_000
GOLDEN = (math.sqrt(5) - 1) / 2


def shares(targets: list[tuple[float, int]], available: list[int]) -> list[float]:
    """targets: share and most repeats of each source; available: its tokens. The tokens that each source gives, of as
    many as there are: proportional to the shares, where none gives more than its repeats allow."""
    total = float(sum(available))
    most = [a * max(0, r) for a, (_, r) in zip(available, targets, strict=True)]
    given = [0.0] * len(targets)
    free = {i for i, (t, _) in enumerate(targets) if t > 0 and most[i] > 0}
    left = min(total, float(sum(most[i] for i in free)))
    while free and left > 0:
        weight = sum(targets[i][0] for i in free)
        full = {i for i in free if left * targets[i][0] / weight >= most[i]}
        if not full:
            for i in free:
                given[i] = left * targets[i][0] / weight
            break
        for i in full:
            given[i] = float(most[i])
        left -= sum(given[i] for i in full)
        free -= full
    return given


def _running(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows of the group before them, by bucket and then order."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inner", inner).join(before, [*group, bucket]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def sized(docs: DataFrame, targets: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the targets' sources that have tokens."""
    wanted = targets.where("source is not null").select("source").distinct()
    own = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").join(wanted, "source", "left_semi"), "mixed")
    keyed = own.select(F.struct("doc_id", "source").alias("key"), "text")
    counts = encode_corpus(keyed.select(F.to_json("key").alias("doc_id"), "text"), folder, counts_only=True)
    parsed = counts.select(F.from_json("doc_id", "doc_id long, source string").alias("key"), "n_tokens")
    return materialize(parsed.where("n_tokens > 0").select("key.doc_id", "key.source", "n_tokens"), "sized")


def plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One row a source of the targets, which are few: what it has and what it gives."""
    have = {r["source"]: (r["tokens"], r["docs"]) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    rows = targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("r")).orderBy("source").collect()
    given = shares([(r["t"], r["r"] or 0) for r in rows], [have.get(r["source"], (0, 0))[0] for r in rows])
    return [
        {"source": r["source"], "target_share": r["t"], "max_repeats": r["r"] or 0, "available": have.get(r["source"], (0, 0))[0], "docs": have.get(r["source"], (0, 0))[1], "wanted": g}
        for r, g in zip(rows, given, strict=True)
    ]


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(
        [(r["source"], r["available"], r["wanted"], math.ceil(r["wanted"] / r["available"] - 1e-9) if r["available"] else 0) for r in rows],
        "source string, available long, wanted double, passes int",
    )


def streams(sizes: DataFrame, rows: list[dict], seed: int = 0) -> DataFrame:
    """(source, doc_id, repeat from 1, n_tokens, at): the documents that each source gives, with their place in the
    source's stream of tokens. A document at the end is taken if more than half of it fits."""
    total = sum(r["docs"] for r in rows)
    buckets = max(1, math.ceil(total / BUCKET))
    used = sizes.join(F.broadcast(_table(sizes.sparkSession, rows)), "source").where("passes > 0")
    used = used.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    used = used.withColumn("order", F.xxhash64(F.lit(seed), "repeat", "doc_id")).withColumn("bucket", F.floor(F.pmod(F.shiftrightunsigned("order", 20), F.lit(1 << 40)) / F.lit((1 << 40) / buckets)).cast("int"))
    placed = _running(used, ["source", "repeat"], "bucket", ["order", "doc_id"], F.col("n_tokens"), "before")
    placed = placed.withColumn("at", (F.col("repeat") - 1) * F.col("available") + F.col("before"))
    return placed.where(F.col("at") + F.col("n_tokens") / 2 <= F.col("wanted")).select("source", "doc_id", "repeat", "n_tokens", "at")


def schedule(spark: SparkSession, rows: list[dict], block: int = BLOCK) -> DataFrame:
    """(slot, source, block): golden-ratio points through the cumulative shares."""
    total = sum(r["wanted"] for r in rows)
    n = math.ceil(total / block)
    part = F.lit(None).cast("string")
    edge = total
    for r in reversed(rows):  # from the last source's upper edge down
        part = F.when(F.col("point") * total < edge, F.lit(r["source"])).otherwise(part)
        edge -= r["wanted"]
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(n).withColumn("point", point).select(F.col("id").alias("slot"), part.alias("source"), F.floor(F.col("id") / BUCKET).alias("chunk"))
    return _running(slots, ["source"], "chunk", ["slot"], F.lit(1), "block").select("slot", "source", "block")


def mixture(docs: DataFrame, targets: DataFrame, folder: str | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs: doc_id, text, source; targets: source, target_share, max_repeats. The mixture in order of (slot, at):
    (slot, at, doc_id, source, repeat, n_tokens). Documents without tokens take no part, and neither do null sources.
    A source's last blocks may find no slot of their own; they come at the end."""
    sizes = sized(docs, targets, folder)
    rows = plan(sizes, targets)
    taken = streams(sizes, rows, seed).withColumn("block", F.floor(F.col("at") / block))
    slots = schedule(docs.sparkSession, rows, block)
    last = math.ceil(sum(r["wanted"] for r in rows) / block)
    joined = taken.join(slots, ["source", "block"], "left")
    return joined.select(F.coalesce("slot", F.lit(last) + F.col("block")).alias("slot"), "at", "doc_id", "source", "repeat", "n_tokens")


def share_report(docs: DataFrame, targets: DataFrame, folder: str | None = None, seed: int = 0) -> DataFrame:
    """One row a source of the targets: (source, target_share, max_repeats, available_tokens, used_tokens,
    most_repeats, actual_share)."""
    sizes = sized(docs, targets, folder)
    rows = plan(sizes, targets)
    used = streams(sizes, rows, seed).groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max("repeat").alias("most"))
    named = docs.sparkSession.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["available"]) for r in rows], "source string, target_share double, max_repeats int, available_tokens long")
    joined = named.join(used, "source", "left").fillna(0, ["used", "most"])
    # one row a source, which are few
    total = F.sum("used").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("total", total).select(
        "source", "target_share", "max_repeats", "available_tokens", F.col("used").alias("used_tokens"), F.col("most").alias("most_repeats"), F.when(F.col("total") > 0, F.col("used") / F.col("total")).otherwise(0.0).alias("actual_share")
    )
