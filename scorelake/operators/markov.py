"""Variable-order Markov model with interpolated back-off, all in built-in expressions.

The model is the table of n-gram counts. A distribution depends on the context alone, so it is
made once for each distinct context and joined to the events that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.sequences import ngram_counts, slice_context

ALPHA, BACKOFF = 0.5, 1.0


def fit(tokens: DataFrame, depth: int, bos: int) -> DataFrame:
    """Counts of every order up to ``depth`` over ``(piece_id, t, token)``."""
    return ngram_counts(tokens, "piece_id", "t", "token", depth, bos)


def contexts(counts: DataFrame) -> DataFrame:
    """``(k, context, total, seen)``: per context its total and the count of each next token (at most one a symbol)."""
    return counts.groupBy("k", "context").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("seen")
    )


def distributions(needed: DataFrame, model: DataFrame, symbols: int, alpha: float = ALPHA, backoff: float = BACKOFF) -> DataFrame:
    """``(context, p)`` for each distinct ``context`` (array of symbols): P of every symbol 0..symbols-1.

    Orders whose context was never seen are skipped; without any counts P is uniform.
    """
    distinct = needed.select("context").distinct()
    suffix = F.array_join(F.slice("context", F.size("context") - F.col("k") + 1, F.col("k")), ",")
    asked = distinct.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("context")))).withColumn(
        "suffix", F.when(F.col("k") == 0, "").otherwise(suffix)
    )
    met = asked.join(model.withColumnRenamed("context", "suffix"), ["k", "suffix"])
    orders = F.array_sort(F.collect_list(F.struct("k", "total", "seen")), lambda a, b: a["k"] - b["k"])
    grouped = distinct.join(met.groupBy("context").agg(orders.alias("orders")), "context", "left")
    ids = F.sequence(F.lit(0), F.lit(symbols - 1))

    def step(p: Column, order: Column) -> Column:
        total = order["total"].cast("double")
        w = F.when(order["k"] == 0, 1.0).otherwise(total / (total + backoff))
        return F.transform(
            ids, lambda i: w * (F.coalesce(F.element_at(order["seen"], i), F.lit(0)) + alpha) / (total + alpha * symbols) + (1 - w) * F.get(p, i)
        )

    uniform = F.array_repeat(F.lit(1.0 / symbols), symbols)
    return grouped.select("context", F.aggregate(F.coalesce("orders", F.array().cast(grouped.schema["orders"].dataType)), uniform, step).alias("p"))


def score(test: DataFrame, model: DataFrame, depth: int, bos: int, length: int) -> DataFrame:
    """``(piece_id, t, token, p, probability, best, brier)`` of every event, contexts starting anew in each slice.

    ``best`` is the likeliest symbol, the lowest of equals; ``brier`` the squared distance to the
    one that came.
    """
    framed = slice_context(test, "piece_id", "t", "token", length, depth, bos).select("piece_id", "t", "token", "context")
    known = distributions(framed, contexts(model), bos + 1)
    q = F.get("p", F.col("token"))
    squares = F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)
    return framed.join(known, "context").select(
        "piece_id", "t", "token", q.alias("probability"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("best"),
        (squares - 2 * q + 1).alias("brier"), "p",
    )


def evaluate(scored: DataFrame, *keys: str) -> DataFrame:
    """Per key: events, NLL, perplexity, accuracy and Brier score."""
    nll = F.avg(-F.ln(F.greatest("probability", F.lit(1e-12))))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.round(nll, 6).alias("nll"), F.round(F.exp(nll), 6).alias("perplexity"),
        F.round(F.avg((F.col("best") == F.col("token")).cast("double")), 6).alias("accuracy"), F.round(F.avg("brier"), 6).alias("brier"),
    )


def select_order(train: DataFrame, validation: DataFrame, orders: list[int], bos: int, length: int) -> DataFrame:
    """``(depth, nll, cells)`` of each candidate order on the validation pieces.

    The probability of the token that came needs no whole distribution, only how often its contexts
    and they with it were met. Train and validation tokens are laid out once beside the symbols
    before them, in two sort orders, and counted by windows; pairs of symbols alone are broadcast.
    """
    top, symbols = max(1, *orders), bos + 1
    lags, trained = [f"l{k}" for k in range(1, top + 1)], F.when(~F.col("held"), 1).otherwise(0)
    known = _before(train, ["piece_id"], top, bos, held=False)
    asked = _before(validation.withColumn("slice", F.floor(F.col("t") / length)), ["piece_id", "slice"], top, bos, held=True)
    rows = known.unionByName(asked)
    over = lambda *by: F.sum("n1").over(Window.partitionBy(*by))
    seen = F.collect_set(F.when(F.col("n1") > 0, F.col("token"))).over(Window.partitionBy(F.lit(0)))
    pairs = (
        rows.groupBy("l1", "token").agg(F.sum(trained).alias("n1")).withColumns({"t1": over("l1"), "n0": over("token"), "t0": over(F.lit(0))})
        .withColumns({"c0": F.size(seen), "c1": F.count(F.when(F.col("n1") > 0, 1)).over(Window.partitionBy(F.lit(0)))})
    )
    laid = rows.repartition(*lags[:2]).sortWithinPartitions(*lags)
    for k in range(2, top + 1):
        laid = laid.withColumn(f"t{k}", F.sum(trained).over(Window.partitionBy(*lags[:k])))
    laid = laid.sortWithinPartitions("token", *lags, "held")
    for k in range(2, top + 1):
        laid = laid.withColumn(f"n{k}", F.sum(trained).over(Window.partitionBy("token", *lags[:k])))
    # the train row before, to count each cell at its first
    by = Window.partitionBy("token", *lags[:2]).orderBy(*lags[2:], "held").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("last", F.last(F.when(~F.col("held"), F.struct(*lags)), ignorenulls=True).over(by))

    def terms(k: int) -> tuple[Column, Column]:
        n, total = F.col(f"n{k}"), F.col(f"t{k}").cast("double")
        met = (total > 0) & (F.lit(True) if k == 0 else F.col(f"l{k}").isNotNull())
        w = F.lit(1.0) if k == 0 else total / (total + BACKOFF)
        return F.when(met, w * (n + ALPHA) / (total + ALPHA * symbols)).otherwise(0.0), F.when(met, 1 - w).otherwise(1.0)

    def loss(depth: int) -> Column:
        p = F.lit(1.0 / symbols)
        for k in range(depth + 1):
            here, rest = terms(k)
            p = here + rest * p
        able = F.col("token").between(0, bos)
        return F.avg(F.when(F.col("held"), -F.ln(F.greatest(F.when(able, p), F.lit(1e-12)))))

    def cells(k: int) -> Column:
        if k < 2:
            return F.coalesce(F.max(f"c{k}"), F.lit(0))
        same = F.col("last").isNotNull()
        for x in lags[2:k]:
            same = same & F.col(x).eqNullSafe(F.col(f"last.{x}"))
        return F.coalesce(F.sum(F.when(~F.col("held") & F.col(f"l{k}").isNotNull() & ~same, 1).otherwise(0)), F.lit(0))

    found = laid.join(F.broadcast(pairs), ["l1", "token"]).agg(
        *[F.round(loss(d), 6).alias(f"nll{d}") for d in orders], *[cells(k).alias(f"cells{k}") for k in range(top + 1)]
    ).first()
    out = [(d, found[f"nll{d}"], sum(found[f"cells{k}"] for k in range(d + 1))) for d in orders]
    return train.sparkSession.createDataFrame(out, "depth int, nll double, cells long")


def _before(tokens: DataFrame, keys: list[str], depth: int, bos: int, held: bool) -> DataFrame:
    """``(token, l1..., held)``: each token with the ``depth`` symbols before it, nearest first; BOS stands before each sequence, null before that."""
    by = Window.partitionBy(*keys).orderBy("t")
    token = F.coalesce("token", F.raise_error(F.lit("a token is null")).cast("int"))
    rows = tokens.select(*keys, "t", token.alias("token")).withColumn("p", F.row_number().over(by))
    symbols = [F.when(F.col("p") == k, F.lit(bos)).otherwise(F.lag("token", k).over(by)).alias(f"l{k}") for k in range(1, depth + 1)]
    return rows.select("token", *symbols, F.lit(held).alias("held"))


def generate(model: DataFrame, prompts: DataFrame, steps: int, depth: int, bos: int) -> DataFrame:
    """``(piece_id, tokens)``: each prompt (array of tokens) continued greedily, special symbols left out."""
    state = prompts.select("piece_id", F.col("tokens"))
    table = contexts(model)
    for _ in range(steps):
        framed = state.withColumn("context", F.slice("tokens", F.greatest(F.size("tokens") - depth + 1, F.lit(1)), depth))
        known = distributions(framed, table, bos + 1)
        music = F.slice("p", 1, bos)
        token = (F.array_position(music, F.array_max(music)) - 1).cast("int")
        state = framed.join(known, "context").select("piece_id", F.concat("tokens", F.array(token)).alias("tokens"))
    return state
