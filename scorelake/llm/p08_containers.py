"""Problem 8: filling fixed-capacity containers with items.

Conflict-constrained best fit, largest items first. Bins are kept by the room they have left;
the search starts at the least room that holds the item and goes on to the next until a bin
without conflict is found. A bin carries a bitmap of its sources and one of its clusters of
duplicates: copies and near copies of one text (five-word shingles, Jaccard similarity of 0.8)
never share a container, nor do sources declared apart. Items are dealt to shards by a hash, so each shard sees the whole mix of sizes and only its last
few bins stay open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import merged, numbered, shingles_of_rows
from scorelake.llm.p03_near_duplicates import similar_sets
from scorelake.llm.tokens import with_token_counts
from scorelake.operators.components import connected_components
from scorelake.session import cut_lineage


def best_fit(
    items: list[tuple[int, int, int]], capacity: int, apart: dict[int, int] | None = None
) -> tuple[list[int], list[int]]:
    """Bins of ``items`` (size, source, cluster): the bin of each item and the room left in each bin.

    ``apart`` maps a source to the bitmap of sources it may not share a bin with.
    """
    apart = apart or {}
    copies: dict[int, int] = {}
    for _, _, cluster in items:
        copies[cluster] = copies.get(cluster, 0) + 1
    bit = {c: 1 << i for i, c in enumerate(c for c, n in copies.items() if n > 1)}  # only these can clash
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][2], i))
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: some bin has room r
    room: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    placed = [0] * len(items)
    resume: tuple[int, int, int, int] | None = None  # cluster, size, room and place where its last copy went
    for i in order:
        size, source, cluster = items[i]
        mine, foes = bit.get(cluster, 0), apart.get(source, 0)
        found, r, at = -1, size, 0
        # all tighter bins already hold a copy: go on where the last copy was put
        if mine and resume and resume[:2] == (cluster, size):
            r, at = resume[2], resume[3]
        while r <= capacity:
            ahead = open_rooms >> r
            if not ahead:
                break
            step = (ahead & -ahead).bit_length() - 1
            if step:
                r, at = r + step, 0
            bins = by_room[r]
            while at < len(bins):
                b = bins[at]
                if not clusters[b] & mine and not sources[b] & foes:
                    found = b
                    break
                at += 1
            if found >= 0:
                break
            r, at = r + 1, 0
        if found < 0:
            found = len(room)
            room.append(capacity)
            sources.append(0)
            clusters.append(0)
            r = capacity
            resume = (cluster, size, capacity + 1, 0)
        else:
            bins = by_room[r]
            bins[at] = bins[-1]
            bins.pop()
            if not bins:
                open_rooms &= ~(1 << r)
            resume = (cluster, size, r, at)
        room[found] -= size
        sources[found] |= 1 << source
        clusters[found] |= mine
        by_room.setdefault(room[found], []).append(found)
        open_rooms |= 1 << room[found]
        # a bin that got a copy may now lie at or after the resume point: it is skipped there by its bitmap
        placed[i] = found
    return placed, room


def word_shingles(texts: DataFrame, width: int = 5) -> DataFrame:
    """``(id, shingles)`` of ``(id, text)``: distinct runs of words (case and marks mean nothing) as 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code: dict[str, int] = {}  # of the words of one batch
            rows, sizes = [], []
            for text in batch["text"]:
                words = re.findall(r"\w+", text.lower())
                rows += [code.setdefault(w, len(code)) for w in words]
                sizes.append(len(words))
            named = np.array([xxhash.xxh64_intdigest(w) >> 12 for w in code], dtype=np.int64)
            values, lengths = shingles_of_rows(named[np.array(rows, dtype=np.int64)], np.array(sizes, dtype=np.int64), width)
            yield pd.DataFrame({"id": batch["id"], "shingles": np.split(values, np.cumsum(lengths)[:-1])})

    return texts.select("id", "text").mapInPandas(run, "id bigint, shingles array<bigint>")


def duplicate_clusters(documents: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``(doc_id, cluster)``: texts that are copies or near copies, also through others, have one cluster.

    Copies (equal but for case and white space) are one class; classes are linked by a chosen-path
    similarity join of their word shingles and gathered by components. A text below ``width``
    words has copies only. Null texts have no cluster.
    """
    plain = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    rows = documents.where("text is not null").select("doc_id", plain.alias("plain"))
    classes = numbered(rows.groupBy("plain").agg(F.count(F.lit(1)).alias("n")), "id")
    sets = cut_lineage(word_shingles(classes.where("plain <> ''").select("id", F.col("plain").alias("text")), width))
    links = similar_sets(sets, threshold).select("a", "b")
    component = connected_components(links, "a", "b")
    named = classes.join(merged(component.withColumnRenamed("node", "id")), "id", "left").select("plain", F.coalesce("component", "id").alias("cluster"))
    return rows.join(merged(named), "plain").select("doc_id", "cluster")


def fill(
    documents: DataFrame,
    capacity: int = 1024,
    per_shard: int = 50_000,
    apart: list[tuple[str, str]] | None = None,
    vocabulary: str | None = None,
) -> DataFrame:
    """``(doc_id, part, start_token, n_tokens, container, room_left)`` of every text.

    A text above ``capacity`` is cut into full containers and a last part; no other text is
    divided. Texts of one cluster of duplicates and sources named in ``apart`` (pairs, case means
    nothing) never share a container. An empty text goes where there is room; a null text has no
    container. ``per_shard`` bounds what one task packs.
    """
    counted = cut_lineage(
        with_token_counts(documents.select("doc_id", "text", F.lower("source").alias("source")), ["doc_id", "source"], vocabulary)
        .join(merged(duplicate_clusters(documents)), "doc_id", "left")
    )
    n_parts = F.greatest(F.ceil(F.col("n_tokens") / F.lit(capacity)), F.lit(1)).cast("int")
    parts = (
        counted.where("n_tokens is not null")
        .withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
        .withColumn("start_token", F.col("part") * capacity)
        .withColumn("size", F.least(F.col("n_tokens") - F.col("start_token"), F.lit(capacity)))
    )
    full = parts.where(F.col("size") == capacity).select(
        "doc_id", "part", "start_token", F.col("size").alias("n_tokens"),
        F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"),
        F.lit(0).alias("room_left"),
    )
    rest = parts.where(F.col("size") < capacity).select("doc_id", "part", "start_token", "size", "source", "cluster")
    shards = max(1, -(-counted.count() // per_shard))
    named = sorted({s.lower() for pair in apart or [] for s in pair})
    number = {s: i for i, s in enumerate(named)}
    foes: dict[int, int] = {}
    for a, b in apart or []:
        foes[number[a.lower()]] = foes.get(number[a.lower()], 0) | 1 << number[b.lower()]
        foes[number[b.lower()]] = foes.get(number[b.lower()], 0) | 1 << number[a.lower()]

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "part"], ignore_index=True)
        source = [number.get(s, len(named)) for s in shard["source"]]
        placed, room = best_fit(list(zip(shard["size"].tolist(), source, shard["cluster"].tolist())), capacity, foes)
        prefix = f"s{int(shard['shard'].iloc[0])}-"
        return pd.DataFrame(
            {
                "doc_id": shard["doc_id"], "part": shard["part"], "start_token": shard["start_token"], "n_tokens": shard["size"],
                "container": [prefix + str(b) for b in placed], "room_left": [room[b] for b in placed],
            }
        )

    columns = "doc_id bigint, part int, start_token int, n_tokens int, container string, room_left int"
    packed = (
        rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(pack, columns)
    )
    none = counted.where("n_tokens is null").select(
        "doc_id", F.lit(0).alias("part"), F.lit(0).alias("start_token"), F.lit(0).alias("n_tokens"),
        F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("room_left"),
    )
    return packed.unionByName(full).unionByName(none)


def summary(documents: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """``(n_texts, n_parts, n_containers, total_tokens, total_room, room_share)``."""
    out = fill(documents, capacity, **options)
    bins = out.where("container is not null").groupBy("container").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.sum((F.col("part") == 0).cast("int")).alias("texts")
    )
    tokens, n = F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))
    return bins.agg(
        F.coalesce(F.sum("texts"), F.lit(0)).alias("n_texts"), F.coalesce(F.sum("parts"), F.lit(0)).alias("n_parts"),
        n.alias("n_containers"), tokens.alias("total_tokens"), (n * capacity - tokens).alias("total_room"),
        F.round(F.try_divide(n * capacity - tokens, n * capacity), 6).alias("room_share"),
    )


def audit(documents: DataFrame, capacity: int = 1024, apart: list[tuple[str, str]] | None = None, **options) -> DataFrame:
    """One row of counts that tell if the filling keeps its rules.

    ``(n_documents, n_without_text, n_divided_small, n_wrong_room, n_duplicates_together,
    n_apart_together)``: texts without container, texts within the capacity that were divided,
    containers whose tokens and room do not make up the capacity, containers with two texts of one
    cluster, and containers with two sources declared apart.
    """
    out = cut_lineage(fill(documents, capacity, apart=apart, **options))
    per_text = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"), F.max("container").alias("c"))
    texts = per_text.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("c").isNull()).alias("n_without_text"),
        F.count_if((F.col("parts") > 1) & (F.col("n") <= capacity)).alias("n_divided_small"),
    )
    known = documents.select("doc_id", F.lower("source").alias("source")).join(merged(duplicate_clusters(documents)), "doc_id", "left")
    inside = out.where("container is not null").join(merged(known), "doc_id")
    per_bin = inside.groupBy("container").agg(
        F.sum("n_tokens").alias("n"), F.max("room_left").alias("room"), (F.count("cluster") - F.countDistinct("cluster")).alias("again"),
        F.collect_set("source").alias("sources"),
    )
    together = F.lit(False)
    for a, b in apart or []:
        together = together | (F.array_contains("sources", a.lower()) & F.array_contains("sources", b.lower()))
    bins = per_bin.agg(
        F.count_if(F.col("n") + F.col("room") != capacity).alias("n_wrong_room"), F.count_if(F.col("again") > 0).alias("n_duplicates_together"),
        F.count_if(together).alias("n_apart_together"),
    )
    return texts.crossJoin(bins)  # a row each
