"""Problem 7: splits that keep related records together.

Pieces linked by a work id or a source path form components. The components' weights are
balanced into many equal bins by largest differencing (the two heaviest partial solutions are
combined again and again, heaviest bin against lightest), and whole bins go to the splits in
proportion to the targets.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import merged, present_split
from scorelake.operators.components import connected_components
from scorelake.session import cut_lineage

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def work_key(column: Column) -> Column:
    """A work id regardless of case, outer blanks and how its words are parted; null if empty."""
    plain = F.trim(F.lower(F.regexp_replace(column, r"[\s_.\-]+", " ")))
    return F.when(plain != "", plain)


def piece_groups(prepared: DataFrame) -> DataFrame:
    """``(piece_id, group_id)``: pieces linked by equal work ids or source paths, also through others.

    Null and empty ids link nothing, so such a piece may be a group of its own. A piece
    delivered several times carries the ids of all its rows. A hub of any size is fine: links
    run from a piece to an id, never between the pieces of an id.
    """
    rows = prepared.where("piece_id is not null").select("piece_id", "canonical_work_id", "source_path")
    piece = F.concat(F.lit("p:"), "piece_id")
    links = (
        rows.select(piece.alias("src"), F.concat(F.lit("w:"), work_key(F.col("canonical_work_id"))).alias("dst"))
        .union(rows.where("source_path <> ''").select(piece, F.concat(F.lit("s:"), "source_path")))
        .union(rows.select(piece, piece))
        .where("dst is not null")
    )
    labels = connected_components(links)
    return labels.where("node like 'p:%'").select(
        F.expr("substring(node, 3)").alias("piece_id"), F.col("component").alias("group_id")
    )


def largest_differencing(weights: dict[int, int], bins: int) -> list[dict[int, int]]:
    """Balance items of the given weights (weight -> how many) into ``bins`` bins.

    Returns for each bin how many items of each weight it holds. A partial solution is a row of
    bin loads; the two with the largest spread are merged, heaviest bin on lightest. Equal
    items are dealt round in whole rounds first, which leaves every spread unchanged.
    """
    held: list[dict[int, int]] = [{} for _ in range(bins)]
    heap: list[tuple[int, int, list[tuple[int, dict[int, int]]]]] = []
    serial = 0
    for weight, count in sorted(weights.items(), reverse=True):
        for b in held:
            if count >= bins:
                b[weight] = count // bins
        for _ in range(count % bins):
            loads = [(0, {}) for _ in range(bins - 1)] + [(weight, {weight: 1})]
            heapq.heappush(heap, (-weight, serial, loads))
            serial += 1
    while len(heap) > 1:
        (_, _, x), (_, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        merged = []
        for (a, items_a), (b, items_b) in zip(sorted(x, key=lambda t: t[0]), sorted(y, key=lambda t: -t[0])):
            items = dict(items_a)
            for w, c in items_b.items():
                items[w] = items.get(w, 0) + c
            merged.append((a + b, items))
        merged.sort(key=lambda t: t[0])
        low = merged[0][0]
        # only differences matter for the next merge
        heapq.heappush(heap, (-(merged[-1][0] - low), serial, merged))
        serial += 1
    for b, (_, items) in zip(held, heap[0][2] if heap else [(0, {})] * bins):
        for w, c in items.items():
            b[w] = b.get(w, 0) + c
    return held


def allocate(weights: dict[int, int], bins: int = 20, targets: dict[str, float] = TARGETS) -> pd.DataFrame:
    """How many components of each weight go to each split: ``(weight, split, from_rank, to_rank)``.

    A component heavier than a bin makes its bin overweight; bins are therefore handed out
    heaviest first, each to the split furthest below its target.
    """
    held = largest_differencing(weights, bins)
    load = lambda b: sum(w * c for w, c in b.items())
    total = sum(w * c for w, c in weights.items())
    room = {s: t * total for s, t in targets.items()}
    counts: dict[tuple[int, str], int] = {}
    for b in sorted(held, key=load, reverse=True):
        split = max(room, key=lambda s: (room[s], s))
        room[split] -= load(b)
        for w, c in b.items():
            counts[w, split] = counts.get((w, split), 0) + c
    rows, at = [], {}
    for (w, split), c in sorted(counts.items()):
        rows.append((w, split, at.get(w, 0), at.get(w, 0) + c))
        at[w] = at.get(w, 0) + c
    return pd.DataFrame(rows, columns=["weight", "split", "from_rank", "to_rank"])


def assign(prepared: DataFrame, bins: int = 20, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``(piece_id, group_id, new_split)`` for every piece, groups kept whole.

    Only the histogram of component sizes reaches the driver (at most sqrt(2 * pieces) distinct
    sizes). Components of one size are told apart by their rank in a hash order, which is found
    without a global sort: counts per hash range give each range its first rank.
    """
    groups = cut_lineage(piece_groups(prepared))
    sized = cut_lineage(
        groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("h", F.xxhash64("group_id")).withColumn("range", F.shiftright("h", 52))
    )
    histogram = {r["weight"]: r["count"] for r in sized.groupBy("weight").count().collect()}
    spark = prepared.sparkSession
    if not histogram:
        return groups.select("piece_id", "group_id", F.lit(None).cast("string").alias("new_split"))
    plan = spark.createDataFrame(allocate(histogram, bins, targets), "weight bigint, split string, from_rank bigint, to_rank bigint")
    per_range = sized.groupBy("weight", "range").agg(F.count(F.lit(1)).alias("n"))
    base = per_range.withColumn(
        "base",
        F.coalesce(F.sum("n").over(Window.partitionBy("weight").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("n")
    ranked = (
        sized.withColumn("local", F.row_number().over(Window.partitionBy("weight", "range").orderBy("h", "group_id")) - 1)
        .join(merged(base), ["weight", "range"])
        .withColumn("rank", F.col("base") + F.col("local"))
    )
    # the plan has at most as many rows as sizes times splits
    placed = ranked.join(F.broadcast(plan), "weight").where("rank >= from_rank and rank < to_rank").select("group_id", "split")
    return groups.join(merged(placed), "group_id").select("piece_id", "group_id", F.col("split").alias("new_split"))


def audited(prepared: DataFrame, records: DataFrame, **options) -> DataFrame:
    """``(piece_id, group_id, group_size, present_split, n_present, new_split, n_new)`` for every piece.

    ``n_present`` and ``n_new`` count the different present and new splits in the piece's group; a
    piece without present split counts for none but belongs to its group like the others. Pieces
    that only the records name are none. Empty tables give an empty result.
    """
    placed = cut_lineage(assign(prepared, **options))
    split = present_split(records.select("piece_id", "split", "registered_at")).withColumnRenamed("split", "present_split")
    rows = cut_lineage(placed.join(merged(split), "piece_id", "left"))
    # distinct splits are few: one row a group and split before they are counted
    per = rows.groupBy("group_id", "present_split", "new_split").agg(F.count(F.lit(1)).alias("n"))
    of_group = per.groupBy("group_id").agg(
        F.sum("n").alias("group_size"), F.size(F.collect_set("present_split")).alias("n_present"), F.size(F.collect_set("new_split")).alias("n_new")
    )
    return rows.join(merged(of_group), "group_id").select(
        "piece_id", "group_id", "group_size", "present_split", "n_present", "new_split", "n_new"
    )


def found(prepared: DataFrame, records: DataFrame) -> DataFrame:
    """Pieces whose group is now in more than one split, as the new assignment's audit shows them."""
    return audited(prepared, records).where("n_present > 1").select("piece_id")


def split_report(prepared: DataFrame, **options) -> DataFrame:
    """``(new_split, n_pieces, n_groups, share)``."""
    out = assign(prepared, **options)
    total = out.agg(F.count(F.lit(1)).alias("total"))
    return (
        out.groupBy("new_split")
        .agg(F.count(F.lit(1)).alias("n_pieces"), F.countDistinct("group_id").alias("n_groups"))
        .join(F.broadcast(total))
        .select("new_split", "n_pieces", "n_groups", F.round(F.col("n_pieces") / F.col("total"), 6).alias("share"))
    )


def audit_columns(prepared: DataFrame, records: DataFrame) -> DataFrame:
    """``(piece_id, group_size, present_split, n_present, n_new)``: the audit without names of groups and new splits."""
    return audited(prepared, records).select("piece_id", "group_size", "present_split", "n_present", "n_new")
