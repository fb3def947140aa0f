"""Problem 1: the same or nearly the same records in more than one split.

Exact prefix-filter bipartite join. Shingles are ordered from rare to frequent. If an evaluation
piece with n shingles has c of them in a training piece, then at least k of its first
n - c + k are there; only these prefixes are indexed. Training pieces probe with all their
shingles, and pairs that are too short, or that meet fewer than k times, are dropped. What
remains is verified on the whole shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import copies, merged, pieces, present_split, with_shingles
from scorelake.session import cut_lineage

EVALUATION = ("validation", "test")


def needed(n: Column, share: float) -> Column:
    """Smallest count that is at least ``share`` of ``n`` (guarded against rounding)."""
    return F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int")


def split_overlap(prepared: DataFrame, records: DataFrame, share: float = 0.8, width: int = 5, meets: int = 4) -> DataFrame:
    """Pairs ``(train_id, eval_id, eval_split, common, n_eval)`` of pieces across splits.

    A pair is reported if at least ``share`` of the evaluation piece's distinct shingles occur
    in the training piece. Pieces with equal tokens are joined once, as a class. A piece
    without present split, or with fewer than ``width`` tokens, is in no pair. ``meets`` is how
    often a pair must meet in the prefix (fewer where fewer shingles are needed at all); it moves
    work from verification to the index and changes no result. Columns beyond those named are
    ignored; empty tables give an empty result; no pair is dropped or capped.
    """
    items = pieces(prepared.select("piece_id", "tokens", "prepared_at")).where(F.size("tokens") >= width)
    split = present_split(records.select("piece_id", "split", "registered_at")).where(
        F.col("split").isin("train", *EVALUATION)
    )
    classes, members = copies(items.join(merged(split), "piece_id"))
    members = cut_lineage(members)
    roles = members.groupBy("class_id").agg(
        F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval")
    )
    sets = cut_lineage(
        with_shingles(classes.select("class_id", "tokens").join(merged(roles), "class_id"), width).withColumn("n", F.size("shingles"))
    )
    frequency = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    evals = sets.where("in_eval").withColumn("c", needed(F.col("n"), share)).withColumn("k", F.least(F.lit(meets), F.col("c")))
    # rare first: a hot shingle is indexed only by pieces that have nothing rarer
    ranked = (
        evals.select(F.col("class_id").alias("e"), F.explode("shingles").alias("shingle"))
        .join(merged(frequency), "shingle")
        .groupBy("e")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "shingle"))), lambda x: x["shingle"]).alias("ranked"))
    )
    index = cut_lineage(
        ranked.join(merged(evals.select(F.col("class_id").alias("e"), "n", "c", "k")), "e").select(
            "e", "c", "k", F.explode(F.slice("ranked", F.lit(1), F.col("n") - F.col("c") + F.col("k"))).alias("shingle")
        )
    )
    probe = sets.where("in_train").select(F.col("class_id").alias("t"), F.col("n").alias("t_n"), F.explode("shingles").alias("shingle"))
    candidates = (
        probe.join(merged(index), "shingle")
        .where((F.col("t_n") >= F.col("c")) & (F.col("e") != F.col("t")))
        .groupBy("e", "t")
        .agg(F.count(F.lit(1)).alias("met"), F.min("k").alias("k"))
        .where("met >= k")
        .select("e", "t")
    )
    verified = (
        candidates.join(merged(sets.select(F.col("class_id").alias("e"), F.col("shingles").alias("e_set"))), "e")
        .join(merged(sets.select(F.col("class_id").alias("t"), F.col("shingles").alias("t_set"))), "t")
        .select("e", "t", F.size("e_set").alias("n_eval"), F.size(F.array_intersect("e_set", "t_set")).alias("common"))
        .where(F.col("common") >= needed(F.col("n_eval"), share))
    )
    both = sets.where("in_eval and in_train").select(
        F.col("class_id").alias("e"), F.col("class_id").alias("t"), F.col("n").alias("n_eval"), F.col("n").alias("common")
    )
    of_evals = members.where(F.col("split") != "train").select(
        F.col("class_id").alias("e"), F.col("piece_id").alias("eval_id"), F.col("split").alias("eval_split")
    )
    of_trains = members.where(F.col("split") == "train").select(
        F.col("class_id").alias("t"), F.col("piece_id").alias("train_id")
    )
    return (
        cut_lineage(verified.unionByName(both))
        .join(merged(of_evals), "e")
        .join(merged(of_trains), "t")
        .select("train_id", "eval_id", "eval_split", "common", "n_eval")
    )


def found(prepared: DataFrame, records: DataFrame, share: float = 0.8) -> DataFrame:
    """The pairs alone, smaller id first."""
    pairs = split_overlap(prepared, records, share)
    return pairs.select(
        F.least("train_id", "eval_id").alias("piece_id_a"), F.greatest("train_id", "eval_id").alias("piece_id_b")
    )


def report(prepared: DataFrame, records: DataFrame, share: float = 0.8) -> DataFrame:
    """Overlaps per evaluation split and source of the evaluation piece (its id's first folder)."""
    pairs = split_overlap(prepared, records, share)
    return (
        pairs.groupBy(F.col("eval_split").alias("split"), F.substring_index("eval_id", "/", 1).alias("source"))
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.countDistinct("eval_id").alias("n_eval_pieces"),
            F.countDistinct("train_id").alias("n_train_pieces"),
            F.sum((F.col("common") == F.col("n_eval")).cast("long")).alias("n_contained"),
        )
    )
