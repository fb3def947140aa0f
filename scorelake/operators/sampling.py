"""Order statistics, hash-ordered samples and splits that give the same result in any engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, value: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: the value at each 0-based position of the sorted column, a function of the count.

    Counts of each value are ranked instead of rows, so nothing is sorted in one task but the
    distinct values.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up_to = counts.select("v", F.sum("n").over(Window.orderBy("v")).alias("stop"), F.sum("n").over(Window.partitionBy()).alias("total"))
    picks = [F.min(F.when(F.col("stop") > at(F.col("total")), F.col("v"))).alias(name) for name, at in positions.items()]
    return up_to.agg(*picks)


def hash_order(seed: int, *columns: str) -> Column:
    """A key that orders rows pseudorandomly, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement: those first in hash order."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def nested_fractions(df: DataFrame, stratum: str, key: str, fractions: list[float], seed: int) -> DataFrame:
    """``(stratum, key, frac)``: prefixes of one permutation, so a smaller fraction lies inside a larger."""
    by = Window.partitionBy(stratum)
    rows = df.select(stratum, key).distinct().withColumn("p", F.row_number().over(by.orderBy(hash_order(seed, key), key))).withColumn("n", F.count(F.lit(1)).over(by))
    grid = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    return rows.withColumn("frac", grid).where(F.col("p") <= F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("frac") * F.col("n"))))).select(stratum, key, "frac")


def stratified_split(df: DataFrame, stratum: list[str], key: str, test: float, validation: float, seed: int) -> DataFrame:
    """Adds ``split``: within each stratum in hash order, first test, then validation, then train.

    Counts are rounded half to even; a stratum of four has at least one test row and, with three
    left, one for validation.
    """
    by = Window.partitionBy(*stratum)
    rows = df.withColumn("p", F.row_number().over(by.orderBy(hash_order(seed, key), key))).withColumn("n", F.count(F.lit(1)).over(by))
    raw_test = F.bround(F.col("n") * test).cast("int")
    rows = rows.withColumn("n_test", raw_test).withColumn("left", F.col("n") - F.col("n_test"))
    v = F.least(F.col("left"), F.bround(F.col("left") * (validation / (1 - test))).cast("int"))
    rows = rows.withColumn("n_val", F.when((F.col("left") >= 3) & (v == 0), 1).otherwise(v))
    forced = (F.col("n") >= 4) & (F.col("n_test") == 0)
    rows = rows.withColumn("n_val", F.when(forced & (F.col("n_val") >= F.col("left")), F.greatest(F.lit(0), F.col("left") - 1)).otherwise(F.col("n_val"))).withColumn(
        "n_test", F.when(forced, 1).otherwise(F.col("n_test"))
    )
    split = F.when(F.col("p") <= F.col("n_test"), "test").when(F.col("p") <= F.col("n_test") + F.col("n_val"), "validation").otherwise("train")
    return rows.withColumn("split", split).drop("p", "n", "n_test", "left", "n_val")


def ratio_counts(total: Column, ratios: dict[str, float]) -> dict[str, Column]:
    """Parts of ``total``: floors, at least one each, the rest to the largest remainders in order of the ratios."""
    names = list(ratios)
    floors = {n: F.greatest(F.floor(total * ratios[n] + 1e-9).cast("int"), F.when(total >= len(names), 1).otherwise(0)) for n in names}
    rest = total - sum(floors.values())
    remainder = {n: F.round(total * ratios[n] - F.floor(total * ratios[n] + 1e-9), 9) for n in names}
    out = {}
    for i, n in enumerate(names):
        ahead = sum(
            (F.when((remainder[m] > remainder[n]) | ((remainder[m] == remainder[n]) & F.lit(j < i)), 1).otherwise(0) for j, m in enumerate(names) if m != n),
            F.lit(0),
        )
        out[n] = floors[n] + F.when(ahead < rest, 1).otherwise(0)
    return out
