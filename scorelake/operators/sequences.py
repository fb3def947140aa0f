"""Operators on ordered sequences: runs, windows, slices, counts of neighbours.

Every operator takes a frame in long form, a key column (the sequence) and an order column,
and windows within the key only, so a partition is never larger than one sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.scalars import uniform


def intervals(df: DataFrame, key: str, order: str, value: str, most: int = 12) -> DataFrame:
    """Adds ``interval`` (difference to the one before, clamped to +-most) and ``token``; the first is START, token 0."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    clamped = F.when(step.isNotNull(), F.greatest(F.least(step, F.lit(most)), F.lit(-most)))  # least alone would drop the null
    return df.withColumn("interval", clamped).withColumn("token", F.coalesce(clamped + most + 1, F.lit(0)).cast("int"))


def segments(df: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """``(key, state, start, stop)``: stretches of one state, stop exclusive (gaps and islands)."""
    by = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(state).eqNullSafe(F.lag(state).over(by)) & F.lag(order).over(by).isNotNull(), 0).otherwise(1)
    return (
        df.select(key, order, state).withColumn("change", change).withColumn("run", F.sum("change").over(by))
        .groupBy(key, "run")
        .agg(F.first(state).alias("state"), F.min(order).alias("start"), (F.max(order) + 1).alias("stop"))
        .drop("run")
    )


def segment_statistics(df: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Per sequence: number, mean and median length of its segments."""
    n = F.col("stop") - F.col("start")
    return segments(df, key, order, state).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_segments"), F.round(F.avg(n), 6).alias("mean_length"), F.round(F.percentile(n, 0.5), 6).alias("median_length")
    )


def dwell_times(df: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Per state: visits, mean and median dwell, longest stay."""
    n = F.col("stop") - F.col("start")
    return segments(df, key, order, state).groupBy("state").agg(
        F.count(F.lit(1)).alias("n_visits"), F.round(F.avg(n), 6).alias("mean_dwell"),
        F.round(F.percentile(n, 0.5), 6).alias("median_dwell"), F.max(n).alias("longest"),
    )


def train_windows(lengths: DataFrame, n: str = "n", length: int = 128, stride: int = 64, least: int = 32) -> DataFrame:
    """Adds one row per training window ``[start, stop)``.

    Windows step by ``stride`` until one reaches the end; windows shorter than ``least`` are dropped.
    """
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(stride)))
    return (
        lengths.where(F.col(n) > 0).withColumn("start", start)
        .where((F.col("start") == 0) | (F.col("start") - stride + length < F.col(n)))
        .withColumn("stop", F.least(F.col("start") + length, F.col(n)))
        .where(F.col("stop") - F.col("start") >= least)
    )


def eval_slices(lengths: DataFrame, n: str = "n", length: int = 128) -> DataFrame:
    """Adds one row per evaluation slice: abutting, with the exact tail."""
    return (
        lengths.where(F.col(n) > 0).withColumn("start", F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(length))))
        .withColumn("stop", F.least(F.col("start") + length, F.col(n)))
    )


def exposure(lengths: DataFrame, key: str, n: str = "n", length: int = 128, stride: int = 64, least: int = 32) -> DataFrame:
    """``(times, n_events)``: how many events are seen how often by the training windows."""
    seen = train_windows(lengths, n, length, stride, least).select(key, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("t"))
    return seen.groupBy(key, "t").agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("n_events"))


def slice_context(df: DataFrame, key: str, order: str, token: str, length: int, depth: int, bos: int) -> DataFrame:
    """Adds ``slice`` and ``context``: the last ``depth`` symbols of BOS and the slice's tokens before this one."""
    by = Window.partitionBy(key, "slice").orderBy(order)
    before = F.collect_list(token).over(by.rowsBetween(-depth, -1))
    padded = F.when(F.size(before) < depth, F.concat(F.array(F.lit(bos)), before)).otherwise(before)
    return df.withColumn("slice", F.floor(F.col(order) / length).cast("int")).withColumn("context", padded)


def bos_shift(df: DataFrame, key: str, order: str, token: str, bos: int) -> DataFrame:
    """``(input, target)``: the token before (BOS first) and the token."""
    return df.withColumn("input", F.lag(token, 1, bos).over(Window.partitionBy(key).orderBy(order))).withColumn("target", F.col(token))


def transitions(df: DataFrame, key: str, order: str, state: str, n_states: int | None = None) -> DataFrame:
    """``(i, j, n)`` counts of neighbours, never across sequences; a full grid with zeros if ``n_states`` is given."""
    pairs = (
        df.select(F.col(state).alias("i"), F.lead(state).over(Window.partitionBy(key).orderBy(order)).alias("j"))
        .where("i is not null and j is not null").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    )
    if n_states is None:
        return pairs
    ids = df.sparkSession.range(n_states)
    grid = ids.select(F.col("id").cast("int").alias("i")).crossJoin(ids.select(F.col("id").cast("int").alias("j")))
    return grid.join(pairs, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"))


def ngram_counts(df: DataFrame, key: str, order: str, token: str, depth: int, bos: int) -> DataFrame:
    """``(k, context, token, n)``: counts of every order 0..depth, BOS standing before each sequence.

    A context of order k needs k symbols before the token, BOS being one of them. Contexts are
    built from lags and exploded below one aggregation that combines map-side.
    """
    by = Window.partitionBy(key).orderBy(order)
    lags = [F.lag(token, k).over(by) for k in range(1, depth + 1)]
    framed = df.select(
        F.col(token).alias("token"), (F.row_number().over(by) - 1).alias("p"), *[c.alias(f"l{k}") for k, c in enumerate(lags, 1)]
    )
    contexts = []
    for k in range(depth + 1):
        symbols = [F.when(F.col("p") == j - 1, F.lit(bos)).otherwise(F.col(f"l{j}")).cast("string") for j in range(k, 0, -1)]
        contexts.append(F.when(F.col("p") + 1 >= k, F.struct(F.lit(k).alias("k"), F.concat_ws(",", *symbols).alias("context"))))
    return (
        framed.select("token", F.explode(F.array(*contexts)).alias("c")).where("c is not null")
        .groupBy("c.k", "c.context", "token").agg(F.count(F.lit(1)).alias("n"))
    )


def dense_ids(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Adds ``id``: the dense rank from 0 of the value (or tuple of values) among those of the sequence."""
    return df.withColumn("id", F.dense_rank().over(Window.partitionBy(key).orderBy(*values)) - 1)


def nearest_bin(value: Column, bins: list[float]) -> Column:
    """Index of the bin closest to the value, the first declared of equals."""
    return F.array_min(F.array(*[F.struct(F.abs(value - F.lit(float(b))).alias("d"), F.lit(i).alias("i")) for i, b in enumerate(bins)]))["i"]


def metrical_class(beat: Column) -> Column:
    """downbeat, beat, offbeat, subbeat or unknown, within a thousandth."""
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(1e-3), 1e-9 * F.greatest(F.abs(x), F.abs(y)))
    return (
        F.when(beat.isNull(), "unknown").when(near(beat, F.lit(1.0)), "downbeat").when(near(beat, F.bround(beat)), "beat")
        .when(near(beat * 2, F.bround(beat * 2)), "offbeat").otherwise("subbeat")
    )


def fingerprint(tokens: Column, length: int = 32) -> Column:
    """First ``length`` differences, hashed: the same for a melody moved by a constant; null below two tokens."""
    head = F.slice(tokens, 1, length + 1)
    steps = F.transform(F.slice(head, 2, length), lambda x, i: (x - F.element_at(head, i + 1)).cast("string"))
    return F.when(F.size(tokens) >= 2, F.substring(F.sha2(F.array_join(steps, ","), 256), 1, 16))


def stability(df: DataFrame, position: str, state: str) -> DataFrame:
    """Mean over positions of the share of the commonest state."""
    counts = df.groupBy(position, state).agg(F.count(F.lit(1)).alias("n"))
    share = counts.groupBy(position).agg((F.max("n") / F.sum("n")).alias("share"))
    return share.agg(F.count(F.lit(1)).alias("n_positions"), F.round(F.avg("share"), 6).alias("stability"))


def best_so_far(df: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Adds ``best`` (running minimum), ``improved`` (strictly below all before) and ``patience`` (rows since)."""
    by = Window.partitionBy(key).orderBy(order)
    before = F.min(score).over(by.rowsBetween(Window.unboundedPreceding, -1))
    improved = F.coalesce(F.col(score) < before, F.col(score).isNotNull())
    rn = F.row_number().over(by)
    out = df.withColumn("best", F.min(score).over(by)).withColumn("improved", improved).withColumn("rn", rn)
    last = F.max(F.when(F.col("improved"), F.col("rn"))).over(by)
    return out.withColumn("patience", (F.col("rn") - last).cast("int")).drop("rn")


def stick_breaking(df: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """Adds ``weight`` = v times the product of (1 - v) before it."""
    before = F.sum(F.ln(1 - F.col(v))).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("weight", F.col(v) * F.exp(F.coalesce(before, F.lit(0.0))))


def padded(df: DataFrame, key: str, tokens: str, width: int, pad: int) -> DataFrame:
    """Token arrays cut or padded to one width, with the number of real tokens."""
    body = F.slice(tokens, 1, width)
    return df.select(
        key, F.concat(body, F.array_repeat(F.lit(pad), F.lit(width) - F.size(body))).alias("padded"), F.size(body).alias("n_real")
    )


def length_batches(df: DataFrame, key: str, n: str, cells: int) -> DataFrame:
    """``df`` with ``class``, ``range`` and ``batch``: rows of like length together, at most ``cells`` padded cells a batch.

    Lengths of a class lie between two powers of two. Batches are cut within ranges of the key's
    hash, so a class with most of the rows is numbered in many tasks. Empty rows are in no batch.
    """
    h = F.md5(key)
    rows = df.where(F.col(n) > 0).withColumn("class", F.ceil(F.log2(n)).cast("int")).withColumn("range", F.substring(h, 1, 1))
    place = F.row_number().over(Window.partitionBy("class", "range").orderBy(h, key)) - 1
    most = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.pow(F.lit(2), F.col("class"))))
    return rows.withColumn("batch", F.floor(place / most).cast("bigint"))


def gumbel_draws(keys: DataFrame, key: str, weights: DataFrame, value: str, weight: str, seed: int, top: int, temperature: float) -> DataFrame:
    """``(key, value)``: a draw for each key from the ``top`` heaviest values, by the largest log weight plus Gumbel noise.

    ``weights`` is a vocabulary: it is sent to every task. Lower temperatures sharpen the weights.
    """
    order = Window.orderBy(F.desc(weight), value)
    few = weights.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select(value, (F.ln(weight) / temperature).alias("logit"))
    noise = -F.ln(-F.ln(uniform(seed, key, F.col(value).cast("string"))))
    scored = keys.crossJoin(F.broadcast(few)).withColumn("score", F.round(F.col("logit") + noise, 9))
    return scored.groupBy(key).agg(F.max_by(value, F.struct("score", -F.col(value))).alias(value))
