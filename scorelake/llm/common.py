"""Relations that several operators share: pieces, present splits, shingles, copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.session import cut_lineage

#: Tokens below this bound are packed without loss, five to a long; others are hashed.
PACK_BASE = 4096


def pieces(prepared: DataFrame) -> DataFrame:
    """One row per piece: ``(piece_id, tokens)`` of the latest delivery.

    Rows without piece_id or tokens are no pieces. Ties of ``prepared_at`` are broken by the
    larger token array, so the result does not depend on row order.
    """
    return (
        prepared.where("piece_id is not null and tokens is not null")
        .groupBy("piece_id")
        .agg(F.max(F.struct("prepared_at", "tokens")).alias("last"))
        .select("piece_id", "last.tokens")
    )


def present_split(records: DataFrame) -> DataFrame:
    """``(piece_id, split)`` of the row in force; null where that row names no split.

    The latest ``registered_at`` is in force (null counts as oldest); exact ties are broken by
    the larger split string. Case and outer blanks mean nothing; val and valid mean validation;
    an empty string is no split.
    """
    plain = F.lower(F.trim("split"))
    named = F.when(plain.isin("val", "valid"), "validation").when(plain != "", plain)
    return (
        records.where("piece_id is not null")
        .groupBy("piece_id")
        .agg(F.max(F.struct(F.col("registered_at"), named.alias("split"))).alias("last"))
        .select("piece_id", "last.split")
    )


def whole(tokens) -> np.ndarray:
    """Tokens as an integer array; a null token is the symbol -1."""
    a = np.asarray(tokens)
    if a.dtype.kind == "O":
        a = np.array([-1 if t is None else t for t in a], dtype=np.int64)
    return (np.where(np.isnan(a), -1, a) if a.dtype.kind == "f" else a).astype(np.int64)


def shingles(tokens, width: int = 5) -> np.ndarray:
    """Distinct runs of ``width`` consecutive tokens as longs, sorted; none below ``width`` tokens.

    Five tokens in 0..4094 are packed exactly (12 bits each); other runs are hashed to 64 bits.
    """
    t = whole(tokens)
    return shingles_of_rows(t, np.array([len(t)]), width)[0]


def as_list(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Rows of the given lengths from values laid end to end."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def flat(column: pa.Array, null: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end and the length of each row; null rows are empty, null values ``null``."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.fill_null(column.flatten(), null).to_numpy(zero_copy_only=False), lengths


def in_parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most`` values in each, which bounds the work tables."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def shingles_of_rows(values: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingles` of many records laid end to end: values end to end and the number of each record."""
    t = values.astype(np.int64) + 1
    if len(t) < width:
        return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
    stop = np.repeat(np.cumsum(lengths), lengths)
    whole_run = np.flatnonzero(np.arange(len(t)) + width <= stop)
    key = np.zeros(len(whole_run), np.int64)
    low, high = np.full(len(whole_run), t.max()), np.zeros(len(whole_run), np.int64)
    hashed = np.full(len(whole_run), width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            x = t[whole_run + k]
            key = key * PACK_BASE + x
            low, high = np.minimum(low, x), np.maximum(high, x)
            hashed = (hashed ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashed ^= hashed >> np.uint64(32)
    fits = (low >= 0) & (high < PACK_BASE) & (width <= 5)
    key = np.where(fits, key, (hashed | np.uint64(1 << 63)).view(np.int64))  # negative: apart from the packed
    owner = np.repeat(np.arange(len(lengths)), lengths)[whole_run]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][: len(key)]
    return key[fresh], np.bincount(owner[fresh], minlength=len(lengths))


def with_shingles(records: DataFrame, width: int = 5) -> DataFrame:
    """``records`` with ``shingles`` in place of ``tokens``: each record's distinct runs, sorted."""
    keep = [c for c in records.columns if c != "tokens"]
    schema = T.StructType([*records.select(*keep).schema, T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, "tokens"):
            made = as_list(*shingles_of_rows(*flat(part.column("tokens")), width))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], [*keep, "shingles"])

    return records.select(*keep, "tokens").mapInArrow(run, schema)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that may grow with the data: joined by sorted merge, never broadcast."""
    return df.hint("merge")


def numbered(items: DataFrame, name: str) -> DataFrame:
    """``items`` with a number for each row, written once so that the numbers stay."""
    return cut_lineage(items.withColumn(name, F.monotonically_increasing_id()))


def copies(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of pieces with equal tokens: ``(classes(class_id, tokens, n_copies), members(class_id, *others))``.

    ``items`` has ``tokens`` and columns that name its rows. Classes are numbered; a class is
    found by map-side combined aggregates, so any number of copies may exist.
    """
    rows = numbered(items, "row")
    classes = cut_lineage(rows.groupBy("tokens").agg(F.min("row").alias("class_id"), F.count(F.lit(1)).alias("n_copies")))
    members = rows.join(merged(classes.select("tokens", "class_id")), "tokens").drop("tokens", "row")
    return classes.select("class_id", "tokens", "n_copies"), members
