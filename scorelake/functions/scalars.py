"""Scalar functions of models and labels as built-in expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Representations of events as tokens.
REPRESENTATIONS = ("pitch_class", "pitch_class_duration", "event_pitch_duration_metrical")


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in (0, 1) from the hash of a key, the same in every engine."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def dirichlet_log_density(shares: Column, alpha: list[float]) -> Column:
    """Log density of an array of shares under Dirichlet weights; the constant is made once, here."""
    constant = math.lgamma(sum(alpha)) - sum(map(math.lgamma, alpha))
    terms = [(a - 1.0) * F.ln(F.get(shares, F.lit(i))) for i, a in enumerate(alpha)]
    return reduce(lambda x, y: x + y, terms, F.lit(constant))


def relative_bucket(distance: Column, buckets: int = 32, furthest: int = 128) -> Column:
    """Bucket of a distance back in a sequence: the near half one by one, the rest by logarithm, the last open."""
    exact = max(1, buckets // 2)
    d = F.greatest(distance, F.lit(0))
    slope = (buckets - exact) / math.log(max(furthest / exact, 1.0001))
    far = exact + F.floor(F.ln(F.greatest(d, F.lit(1)) / float(exact)) * slope).cast("int")
    return F.when(d < exact, d.cast("int")).otherwise(F.least(far, F.lit(buckets - 1)))


def vocabulary_size(representation: str, durations: int, levels: int) -> int:
    """Tokens of a representation with so many duration bins and metrical levels; the largest also has a rest."""
    sizes = {"pitch_class": 12, "pitch_class_duration": 12 * durations, "event_pitch_duration_metrical": 13 * durations * levels}
    if representation not in sizes:
        raise ValueError(f"no such representation: {representation}")
    return sizes[representation]


def hmm_parameters(states: Column, symbols: Column) -> Column:
    """Free parameters of a hidden Markov model: every row of probabilities has one less than its entries."""
    return (states - 1) + states * (states - 1) + states * (symbols - 1)


def transformer_parameters(symbols: Column, width: int, layers: int, inner: int, positions: int, tied: bool = True) -> Column:
    """About how many weights a decoder has: embeddings, and for each layer attention, feed-forward and norms."""
    layer = 4 * width * width + 2 * width * inner + 8 * width + inner + symbols
    own = F.lit(0) if tied else width * symbols + symbols
    return symbols * width + positions * width + layers * layer + own


def interval_label(interval: Column) -> Column:
    """An interval with its sign, as a vocabulary writes it."""
    return F.format_string("INT_%+d", interval.cast("int"))


def short_number(value: Column) -> Column:
    """A number from 0.0001 to 999999 with six significant digits and no trailing zeros."""
    x = F.abs(value)
    digits = F.bround(value, 9)
    for top, places in ((1e-3, 9), (1e-2, 8), (1e-1, 7), (1e0, 6), (1e1, 5), (1e2, 4), (1e3, 3), (1e4, 2), (1e5, 1), (1e6, 0)):
        digits = F.when(x >= top / 10, F.bround(value, places)).otherwise(digits)
    return F.regexp_replace(F.regexp_replace(digits.cast("decimal(20,9)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def config_issues() -> Column:
    """Array of what is wrong with a row of settings of representation, windows and split."""
    r, bins, levels = F.col("representation"), F.col("duration_bins"), F.col("metrical_levels")
    rules = [
        (~r.isin(*REPRESENTATIONS), "representation not supported"),
        (F.col("alternative").isNotNull() & ~F.col("alternative").isin(*REPRESENTATIONS), "alternative representation not supported"),
        (F.array_sort(bins) != bins, "duration bins not increasing"),
        (F.size(levels) == 0, "no metrical level"),
        (F.size(F.array_distinct(levels)) != F.size(levels), "metrical levels repeat"),
        (F.col("context") <= 1, "context not above one"),
        ((F.col("train_stride") <= 0) | (F.col("eval_stride") <= 0), "stride not positive"),
        (F.col("least_window") > F.col("context"), "least window above the context"),
        (F.abs(F.col("train_ratio") + F.col("validation_ratio") + F.col("test_ratio") - 1.0) > 1e-9, "ratios do not sum to one"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
