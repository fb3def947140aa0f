"""Problem 9: mixing sources to target weights.

Each source's documents are laid end to end (prefix sums in two levels) and cut into blocks of
a fixed number of tokens. Every output shard draws how many of its slots each source gets from
the multinomial law, by a seed of its own, so shards are planned where they are made. Prefix sums
over shards number each source's slots; the few that a source was drawn above its target pass to
the sources drawn below theirs. A source's k-th slot takes the block that a pseudorandom
permutation of the block indices names, a fresh permutation for every pass, and slots meet blocks
in one join by index. A slot for which every source has run out of repeats stays empty, and the
shares that come out are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import merged
from scorelake.llm.tokens import with_token_counts
from scorelake.session import cut_lineage


def permuted(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of [0, n) at k, by seed: a Feistel network with cycle walking."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64))
    half = (bits + 1) // 2
    mask = (np.uint64(1) << half.astype(np.uint64)) - np.uint64(1)
    x, todo = k.astype(np.uint64), np.ones(len(k), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x >> half.astype(np.uint64), x & mask
            for r in range(6):
                f = right + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)
                f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
            x = np.where(todo, (left << half.astype(np.uint64)) | right, x)
            todo = todo & (x >= n.astype(np.uint64))
    return x.astype(np.int64)


def usable_shares(blocks: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Shares of the sources that have blocks; those of the others are spread over them."""
    usable = {s: share for s, (share, repeats) in targets.items() if blocks.get(s, 0) > 0 and share > 0 and repeats > 0}
    total = sum(usable.values())
    return {s: share / total for s, share in usable.items()}


def mix_size(blocks: dict[str, int], targets: dict[str, tuple[float, int]], shortage: float) -> int:
    """Slots of the largest mix of which at most ``shortage`` is wanted from sources that have run out.

    A scarce source bounds the mix only as far as it matters: one with next to no stock and a
    share below ``shortage`` bounds nothing.
    """
    share = usable_shares(blocks, targets)
    most = {s: blocks[s] * targets[s][1] for s in share}
    short = lambda n: sum(max(0.0, share[s] * n - most[s]) for s in share)
    lo, hi = 0, sum(most.values())
    while lo < hi:  # the missing part grows with the size
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if short(middle) <= shortage * middle + 1e-9 else (lo, middle - 1)
    return lo


def quotas(share: dict[str, float], most: dict[str, int], slots: int) -> dict[str, int]:
    """Slots of each source: its share, rounded by largest remainder, at most what its repeats give."""
    floor = {s: int(share[s] * slots + 1e-9) for s in share}
    rest = slots - sum(floor.values())
    for s in sorted(share, key=lambda s: (floor[s] - share[s] * slots, s))[:rest]:
        floor[s] += 1
    return {s: min(n, most[s]) for s, n in floor.items()}


def drawn_counts(spark: SparkSession, share: dict[str, float], slots: int, per_shard: int, seed: int) -> DataFrame:
    """``(shard, source, first, count)``: how many slots of each shard each source gets, and the number of the first.

    Shards are rows of a range and draw by ``(seed, shard)``, so a lost task draws the same again.
    Numbers are prefix sums over ranges of shards, then within a range.
    """
    names = sorted(share)
    p = np.array([share[s] for s in names])
    shards = -(-slots // per_shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            sizes = np.minimum(per_shard, slots - ids * per_shard)
            counts = np.array([np.random.default_rng((seed, int(i))).multinomial(n, p) for i, n in zip(ids, sizes)]).reshape(len(ids), len(names))
            yield pd.DataFrame({"shard": np.repeat(ids, len(names)), "source": names * len(ids), "count": counts.ravel()})

    counts = cut_lineage(spark.range(shards).mapInPandas(draw, "shard bigint, source string, count bigint").where("count > 0"))
    ranged = counts.withColumn("range", F.floor(F.col("shard") / 1024))
    base = ranged.groupBy("source", "range").agg(F.sum("count").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("source", "range", F.coalesce(F.sum("n").over(before("source").orderBy("range")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("count").over(before("source", "range").orderBy("shard")), F.lit(0))
    return ranged.withColumn("inside", inside).join(merged(base), ["source", "range"]).select(
        "shard", "source", (F.col("base") + F.col("inside")).alias("first"), "count"
    )


def segments(documents: DataFrame, block: int, per_range: int, vocabulary: str | None) -> DataFrame:
    """``(source, block, doc_id, start_token, n_tokens)``: the pieces of documents in each block.

    Offsets are prefix sums over hash ranges of about ``per_range`` documents, then within a
    range, so a source with a third of all rows is spread over all ranges.
    """
    texts = documents.where("source is not null and text <> '' and doc_id is not null").select(
        "doc_id", "text", F.lower(F.trim("source")).alias("source")
    )
    counted = cut_lineage(with_token_counts(texts, ["doc_id", "source"], vocabulary).where("n_tokens > 0"))
    ranges = max(1, -(-counted.count() // per_range))
    spread = counted.withColumn("range", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ranges)))
    base = (
        spread.groupBy("source", "range").agg(F.sum("n_tokens").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("source", "range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        spread.withColumn("stop", F.sum("n_tokens").over(inside))
        .join(merged(base), ["source", "range"])
        .select("source", "doc_id", (F.col("base") + F.col("stop")).alias("stop"), "n_tokens")
        .withColumn("start", F.col("stop") - F.col("n_tokens"))
    )
    first, last = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("start", F.col("block") * block), F.least("stop", (F.col("block") + 1) * block)
    return cut.select(
        "source", "block", "doc_id", (lo - F.col("start")).cast("int").alias("start_token"), (hi - lo).cast("int").alias("n_tokens")
    )


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeats of each source. Null or non-positive targets draw nothing; equal sources add up and keep the least repeats."""
    wanted: dict[str, tuple[float, int]] = {}
    for row in targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").collect():
        if row["source"] is None or not (row["target_share"] or 0) > 0 or not (row["max_repeats"] or 0) > 0:
            continue
        share, repeats = wanted.get(row["source"], (0.0, row["max_repeats"]))
        wanted[row["source"]] = share + row["target_share"], min(repeats, row["max_repeats"])
    return wanted


def selection(
    documents: DataFrame,
    targets: DataFrame,
    block: int = 1024,
    per_shard: int = 4096,
    slots: int | None = None,
    shortage: float = 0.001,
    seed: int = 11,
    per_range: int = 100_000,
    vocabulary: str | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """The mix of :func:`mix`, and how many of the slots each source was wanted for stay empty."""
    spark = documents.sparkSession
    pieces = cut_lineage(segments(documents, block, per_range, vocabulary))
    wanted = read_targets(targets)
    names = sorted(wanted)
    # a row for each source of the small table of targets
    stock = pieces.where(F.col("source").isin(names)).groupBy("source").agg((F.max("block") + 1).alias("n"))
    blocks = {r["source"]: r["n"] for r in stock.collect()}
    share = usable_shares(blocks, wanted)
    total = (mix_size(blocks, wanted, shortage) if slots is None else slots) if share else 0
    plan = cut_lineage(drawn_counts(spark, share, total, per_shard, seed))
    slot_rows, quota = levelled(plan, share, {s: blocks[s] * wanted[s][1] for s in share}, total)
    known = spark.createDataFrame([(s, blocks[s], names.index(s)) for s in sorted(share)], "source string, n bigint, code int")

    @F.pandas_udf("bigint")
    def index(k: pd.Series, n: pd.Series, code: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series(permuted(k.to_numpy(), n.to_numpy(), (seed * 1_000_003 + code * 10_007 + turn).to_numpy()))

    drawn = (
        slot_rows.join(F.broadcast(known), "source")
        .withColumn("pass", F.floor(F.col("k") / F.col("n")).cast("int"))
        .withColumn("block", index(F.pmod("k", "n"), F.col("n"), F.col("code"), F.col("pass")))
        .withColumn("slot", F.xxhash64("source", "k", F.lit(seed)))
    )
    order = Window.partitionBy("shard").orderBy("slot", "source", "k")  # a shard has per_shard slots
    slotted = drawn.withColumn("slot", (F.row_number().over(order) - 1).cast("int"))
    chosen = slotted.join(merged(pieces), ["source", "block"]).select(
        "shard", "slot", "source", "pass", F.col("block").cast("bigint").alias("block"), "doc_id", "start_token", "n_tokens"
    )
    return chosen, {s: max(0, round(share[s] * total) - quota[s]) for s in share}


def levelled(plan: DataFrame, share: dict[str, float], most: dict[str, int], slots: int) -> tuple[DataFrame, dict[str, int]]:
    """``(shard, source, k)``: the slots of a plan, each source with the numbers from 0 to its quota, and the quotas.

    A source's slots numbered beyond its quota are passed on in order: all of them, source after
    source, meet the numbers that other sources lack. Where nothing is lacking a slot stays empty.
    """
    quota = quotas(share, most, slots)
    drawn = {r["source"]: r["n"] for r in plan.groupBy("source").agg(F.sum("count").alias("n")).collect()}  # a row a source
    over, under, given, lacking = [], [], 0, 0
    for s in sorted(share):
        surplus = drawn.get(s, 0) - quota[s]
        over.append((s, quota[s], given))
        if surplus > 0:
            given += surplus
        elif surplus < 0:
            under.append(F.struct(F.lit(lacking).cast("bigint").alias("lo"), F.lit(lacking - surplus).cast("bigint").alias("hi"), F.lit(s).alias("to"), F.lit(drawn.get(s, 0)).cast("bigint").alias("base")))
            lacking -= surplus
    known = plan.sparkSession.createDataFrame(over, "source string, quota bigint, given bigint")
    rows = plan.join(F.broadcast(known), "source").withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    kept = rows.where("k < quota").select("shard", "source", "k")
    if not under:
        return kept, quota
    passed = rows.where("k >= quota").withColumn("i", F.col("given") + F.col("k") - F.col("quota"))
    passed = passed.withColumn("x", F.get(F.filter(F.array(*under), lambda x: (F.col("i") >= x["lo"]) & (F.col("i") < x["hi"])), F.lit(0)))
    return kept.unionByName(
        passed.where("x is not null").select("shard", F.col("x.to").alias("source"), (F.col("x.base") + F.col("i") - F.col("x.lo")).alias("k"))
    ), quota


def mix(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """``(shard, slot, source, pass, block, doc_id, start_token, n_tokens)``: the selection.

    ``slots`` is the number of blocks drawn; by default the largest mix of which no more than
    ``shortage`` must stay empty because sources have run out. Sources are equal regardless of
    case. A block, and so every token of a document, is drawn at most ``max_repeats`` times.
    Documents without source or tokens, and sources without target, are not drawn. The last block
    of a source may be short. Targets are a small table: they are read by the driver, as are the
    numbers of blocks of their sources.
    """
    return selection(documents, targets, **options)[0]


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """``(source, target_share, share, n_tokens, n_documents, most_repeats, empty_slots)`` of every target.

    Shares differ from the targets by less than a block, by short last blocks and by the slots
    that stayed empty, which are spread over the others where a source has no documents.
    """
    drawn, missing = selection(documents, targets, **options)
    per_source = drawn.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_documents"), (F.max("pass") + 1).alias("most_repeats")
    )
    per_source = cut_lineage(per_source)
    empty = targets.sparkSession.createDataFrame(sorted(missing.items()), "source string, empty bigint")
    total = per_source.agg(F.sum("n_tokens").alias("total"))
    wanted = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    return (
        wanted.join(per_source, "source", "left")
        .join(empty, "source", "left")
        .join(F.broadcast(total))
        .select(
            "source", "target_share",
            F.round(F.coalesce(F.try_divide(F.col("n_tokens"), F.col("total")), F.lit(0.0)), 6).alias("share"),
            F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
            F.coalesce("n_documents", F.lit(0)).cast("bigint").alias("n_documents"),
            F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"),
            F.coalesce("empty", F.lit(0)).cast("bigint").alias("empty_slots"),
        )
    )


def audit(documents: DataFrame, targets: DataFrame, tolerance: float = 0.02, **options) -> DataFrame:
    """``(source, target_share, met, over_repeats)`` of every target, read off the selection itself.

    ``over_repeats`` counts blocks drawn more often than allowed; ``met`` tells if the share of the
    tokens is within ``tolerance`` of the target among the sources that have tokens.
    """
    drawn = cut_lineage(mix(documents, targets, **options))
    most = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("most"))
    often = drawn.groupBy("source", "block", "doc_id", "start_token").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("tokens"))
    per = often.join(F.broadcast(most), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("times") > F.col("most")).alias("over"))
    total = drawn.agg(F.sum("n_tokens").alias("total"))
    stocked = F.sum(F.when(F.col("tokens").isNotNull(), F.col("target_share"))).over(Window.partitionBy())  # a row a source
    near = F.abs(F.col("tokens") / F.col("total") - F.col("target_share") / F.col("stocked")) <= tolerance
    return (
        most.join(per, "source", "left").withColumn("stocked", stocked).join(F.broadcast(total))
        .select("source", "target_share", F.coalesce(near, F.lit(False)).alias("met"), F.coalesce("over", F.lit(0)).cast("bigint").alias("over_repeats"))
    )
