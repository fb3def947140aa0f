"""Problem 3: near-duplicate records with small edits.

Chosen-path set similarity join. Every record is embedded as minwise tokens of its shingle
set. A tree starts with all records in one node; a node picks a few embedding positions by a
hash of its own path and sends each record to the child named by the record's minwise token
there. Nodes of at most ``node_limit`` records are compared exhaustively, larger ones branch
again. Independent trees are repeated until the target recall is met. Candidates are verified
on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import as_list, copies, flat, in_parts, merged, pieces, with_shingles
from scorelake.operators.components import connected_components
from scorelake.session import cut_lineage

#: Recall at the threshold: a pair with Jaccard 0.6 shares a child of a tree with two branches
#: with probability 1 - 0.4^2 = 0.84 a level; eight trees miss it with 0.16^8 at one level and
#: with 0.3^8 = 7e-5 at three.
TREES, BRANCHES, POSITIONS, NODE_LIMIT, MAX_DEPTH = 8, 2, 64, 32, 10


def minwise(values: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minwise tokens of non-empty sets laid end to end: sets by seeds (splitmix-style mixing of 64-bit values)."""
    begin = np.cumsum(lengths) - lengths
    x0, out = values.astype(np.uint64), np.empty((len(lengths), len(seeds)), dtype=np.int64)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(seeds):
            x = x0 ^ seed
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(31)), begin).view(np.int64)
    return out


def embedded(sets: DataFrame, positions: int, seed: int) -> DataFrame:
    """``(id, n, minwise, sketch_a, sketch_b)`` of ``(id, shingles)``; sets must not be empty.

    A sketch packs one bit of each of 64 minwise tokens, so equal tokens give equal bits and
    others differ in half.
    """
    seeds = np.random.default_rng(seed).integers(0, 2**63, positions, dtype=np.uint64)
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("minwise", T.ArrayType(T.LongType())),
         T.StructField("sketch_a", T.LongType()), T.StructField("sketch_b", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, "shingles"):
            values, lengths = flat(part.column("shingles"))
            m = minwise(values, lengths, seeds)
            bits = m[:, np.arange(64) % positions].astype(np.uint64)
            place = np.arange(64, dtype=np.uint64)
            sketch = [((bits >> np.uint64(at)) & np.uint64(1)) << place for at in (7, 8)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(lengths.astype(np.int32)), as_list(m.ravel(), np.full(len(m), positions)),
                 *(pa.array(np.bitwise_or.reduce(x, axis=1).view(np.int64)) for x in sketch)],
                schema.names,
            )

    return sets.select("id", "shingles").mapInArrow(run, schema)


def most_different(threshold: float, positions: int) -> int:
    """Bits of both sketches in which a pair at the threshold differs at most, to five deviations.

    A position differs with 1 - J and then in two fair bits; a pair at the threshold exceeds the
    bound with about 1e-6. At fewer than 64 positions bits repeat and nothing is filtered.
    """
    if positions < 64:
        return 128
    miss = 1.0 - threshold
    return int(np.ceil(64 * miss + 5 * np.sqrt(64 * (1.5 * miss - miss**2))))


def chosen_path_candidates(
    embedded: DataFrame,
    threshold: float,
    trees: int = TREES,
    branches: int = BRANCHES,
    positions: int = POSITIONS,
    node_limit: int = NODE_LIMIT,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Pairs ``(a, b)`` with a < b that share a small node; ``embedded`` as made above.

    Nodes that are still large at ``max_depth`` hold records alike in every choice; they are
    compared too, in pairs of chunks of at most about ``node_limit`` records, so none is met by
    one task.
    """
    apart = most_different(threshold, positions)

    def close(a: Column, b: Column) -> Column:
        sizes = F.least(a["n"], b["n"]) >= threshold * F.greatest(a["n"], b["n"]) - 1e-9
        bits = F.bit_count(a["sketch_a"].bitwiseXOR(b["sketch_a"])) + F.bit_count(a["sketch_b"].bitwiseXOR(b["sketch_b"]))
        return (a["id"] != b["id"]) & sizes & (bits <= apart)

    def within(chunks: DataFrame, left: str, right: str, same: Column) -> DataFrame:
        """Close pairs of two lists of members; of a list with itself each pair once."""
        pairs = chunks.select(F.posexplode(left).alias("i", "a"), right, same.alias("same")).select(
            "a", F.explode(F.when(F.col("same"), F.slice(right, F.col("i") + 2, F.size(right))).otherwise(F.col(right))).alias("b")
        )
        return pairs.where(close(F.col("a"), F.col("b"))).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))

    member = F.struct("id", "n", "sketch_a", "sketch_b")
    rows = embedded.withColumn("node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trees - 1).cast("bigint"))))
    candidates = None
    for depth in range(max_depth):
        picks = F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.lit(2 * branches)),
                lambda k: F.pmod(F.xxhash64(F.col("node"), F.lit(depth), k), F.lit(positions)).cast("int"),
            )
        )
        children = cut_lineage(
            rows.withColumn("pick", F.explode(F.slice(picks, 1, branches))).select(
                F.xxhash64("node", "pick", F.element_at("minwise", F.col("pick") + 1)).alias("node"), "id", "n", "sketch_a", "sketch_b"
            )
        )
        sizes = cut_lineage(children.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        small = children.join(merged(sizes.where(f"size <= {node_limit}").select("node")), "node")
        lists = small.groupBy("node").agg(F.collect_list(member).alias("m"))
        found = within(lists, "m", "m", F.lit(True))
        candidates = found if candidates is None else candidates.unionByName(found)
        large = sizes.where(f"size > {node_limit}")
        if large.isEmpty():
            break
        rest = children.join(merged(large), "node")
        if depth == max_depth - 1:
            chunk = F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("size") / node_limit))
            chunks = cut_lineage(rest.dropDuplicates(["node", "id"]).groupBy("node", chunk.alias("chunk")).agg(F.collect_list(member).alias("m")))
            other = chunks.select("node", F.col("chunk").alias("to"), F.col("m").alias("o"))
            met = chunks.join(merged(other), "node").where("chunk <= to")
            candidates = candidates.unionByName(within(met, "m", "o", F.col("chunk") == F.col("to")))
        else:
            rows = rest.select("node", "id").distinct().join(merged(embedded), "id")
    return candidates.distinct()


def similar_sets(sets: DataFrame, threshold: float, seed: int = 7, **tree) -> DataFrame:
    """``(a, b, common, either)`` of all found pairs of ``sets(id, shingles)`` at or above the threshold."""
    sets = sets.where(F.size("shingles") > 0)
    candidates = chosen_path_candidates(cut_lineage(embedded(sets, tree.get("positions", POSITIONS), seed)), threshold, **tree)
    common = F.size(F.array_intersect("s", "t"))
    return (
        candidates.join(merged(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))), "a")
        .join(merged(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))), "b")
        .select("a", "b", (F.size("s") + F.size("t")).alias("total"), common.alias("common"))
        .select("a", "b", "common", (F.col("total") - F.col("common")).alias("either"))
        .where(F.col("common") >= F.col("either") * threshold - 1e-9)
    )


def similar_classes(prepared: DataFrame, threshold: float = 0.6, width: int = 5, seed: int = 7, **tree) -> tuple[DataFrame, DataFrame]:
    """``(links(class_a, class_b, common, either), members(class_id, piece_id))``.

    Links join classes of equal tokens whose shingle sets have a Jaccard similarity of at least
    ``threshold``; copies are members of one class and are not expanded into pairs. Pieces with
    fewer than ``width`` tokens or without id or tokens are like nothing, null tokens equal each
    other, repeated deliveries are one piece, other columns are ignored and an empty table gives
    an empty result.
    """
    items = pieces(prepared.select("piece_id", "tokens", "prepared_at")).where(F.size("tokens") >= width)
    classes, members = copies(items)
    sets = cut_lineage(with_shingles(classes.select(F.col("class_id").alias("id"), "tokens"), width))
    links = similar_sets(sets, threshold, seed, **tree)
    return links.withColumnsRenamed({"a": "class_a", "b": "class_b"}), members


def found(prepared: DataFrame, threshold: float = 0.6, **tree) -> DataFrame:
    """All pairs of pieces at or above the threshold, smaller id first, copies included."""
    links, members = similar_classes(prepared, threshold, **tree)
    members, links = cut_lineage(members), cut_lineage(links)
    left = members.select(F.col("class_id").alias("class_a"), F.col("piece_id").alias("p"))
    right = members.select(F.col("class_id").alias("class_b"), F.col("piece_id").alias("q"))
    across = links.join(merged(left), "class_a").join(merged(right), "class_b").select("p", "q")
    same = left.join(merged(right.withColumnRenamed("class_b", "class_a")), "class_a").where("p < q").select("p", "q")
    return across.unionByName(same).select(F.least("p", "q").alias("piece_id_a"), F.greatest("p", "q").alias("piece_id_b"))


def groups(prepared: DataFrame, threshold: float = 0.6, **tree) -> DataFrame:
    """``(piece_id, group_id, n_links)``: every piece with its group of alike pieces.

    Groups are the connected components of the links, named by their smallest piece; a piece
    that is like no other is a group of its own. ``n_links`` counts linked classes of different
    tokens.
    """
    links, members = similar_classes(prepared, threshold, **tree)
    links, members = cut_lineage(links.select("class_a", "class_b")), cut_lineage(members)
    component = connected_components(links, "class_a", "class_b")
    degree = (
        links.select("class_a").union(links.select("class_b")).groupBy(F.col("class_a").alias("class_id")).count()
    )
    placed = (
        members.join(merged(component.withColumnRenamed("node", "class_id")), "class_id", "left")
        .join(merged(degree), "class_id", "left")
        .withColumn("component", F.coalesce("component", "class_id"))
    )
    names = placed.groupBy("component").agg(F.min("piece_id").alias("group_id"))
    return placed.join(merged(names), "component").select(
        "piece_id", "group_id", F.coalesce("count", F.lit(0)).cast("long").alias("n_links")
    )
