"""Audits: denominators, reconciliation, coverage, leakage, canonical identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a canonical work id leaves out, and labels that name nothing.
NOISE = ("easy", "beginner", "fingered", "arrangement", "arrg", "solo", "piano", "pedagogical", "annotated", "version")
GENERIC = ("untitled", "unknown", "score", "sheet music", "no title", "sin titulo")


def denominators(metrics: DataFrame) -> DataFrame:
    """Per model: rows, those without score or work, scored files and works, and files absorbed by works."""
    both = F.col("nll").isNotNull() & F.col("work").isNotNull()
    files, works = F.countDistinct(F.when(both, F.col("piece_id"))), F.countDistinct(F.when(F.col("nll").isNotNull(), F.col("work")))
    return metrics.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("nll").isNull()).alias("no_score"), F.count_if(F.col("work").isNull()).alias("no_work"),
        files.alias("n_files"), works.alias("n_works"), (files - works).alias("absorbed"),
    )


def reconcile(raw: DataFrame, published: DataFrame, keys: list[str], value: str, runs: str, tolerance: float = 1e-6) -> DataFrame:
    """``(keys, reason)``: a full outer join of a summary with what the raw rows give."""
    r = raw.select(*keys, F.col(value).alias("r_value"), F.col(runs).alias("r_runs"), F.lit(True).alias("has_raw"))
    p = published.select(*keys, F.col(value).alias("p_value"), F.col(runs).alias("p_runs"), F.lit(True).alias("has_summary"))
    reason = (
        F.when(F.col("has_raw").isNull(), "no_raw_rows").when(F.col("has_summary").isNull(), "missing_summary_row")
        .when(F.abs(F.col("r_value") - F.col("p_value")) > tolerance, "mean_test_nll").when(F.col("r_runs") != F.col("p_runs"), "runs").otherwise("ok")
    )
    return r.join(p, keys, "full_outer").select(*keys, reason.alias("reason"))


def stem(text: Column) -> Column:
    """What a path library calls the stem: after the last slash, before the last dot that isn't first."""
    name = F.regexp_extract(F.regexp_replace(text, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def suffix(text: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(text, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)


def canonical_work(label: Column) -> Column:
    """Stem in lower case, its words parted by blanks, without the noise words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(stem(label)), r"[_.\-]+", " "), r"\s+", " "))
    return F.array_join(F.filter(F.split(plain, " "), lambda w: ~w.isin(*NOISE)), " ")


def coverage(expected: DataFrame, scored: DataFrame, key: str, n: str, index: str) -> DataFrame:
    """Per key: scored indices that repeat, lie outside ``range(n)`` or are missing; ``ok`` if none."""
    counts = scored.join(expected.select(key, n), key).groupBy(key, n, index).agg(F.count(F.lit(1)).alias("times"))
    inside = (F.col(index) >= 0) & (F.col(index) < F.col(n))
    seen = counts.groupBy(key).agg(
        F.sum(F.col("times") - 1).alias("duplicate"), F.count_if(~inside).alias("out_of_range"), F.count_if(inside).alias("covered")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = expected.join(seen, key, "left").select(
        key, zero(F.col("duplicate")).alias("duplicate"), zero(F.col("out_of_range")).alias("out_of_range"), (F.col(n) - zero(F.col("covered"))).cast("bigint").alias("omitted")
    )
    return out.withColumn("ok", (F.col("duplicate") == 0) & (F.col("out_of_range") == 0) & (F.col("omitted") == 0))


def leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows lie in more than one split."""
    return (
        df.where(F.col(group).isNotNull() & F.col(split).isNotNull()).groupBy(group)
        .agg(F.countDistinct(split).alias("n_splits"), F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits")).where("n_splits > 1")
    )


def protocol_costs(runs: DataFrame) -> DataFrame:
    """``runs`` with ``total`` and ``cost_status``.

    Columns ``selection``, ``selected_fit``, ``selected_validation``, ``evaluation`` and ``legacy``
    are seconds or null. A measured selection is the cost of choosing a model, else its parts
    that were measured, else the old undivided total, else nothing; evaluation comes on top.
    """
    selection, fit, validation, legacy = (F.col(c) for c in ("selection", "selected_fit", "selected_validation", "legacy"))
    parts = fit.isNotNull() | validation.isNotNull()
    nothing = F.lit(0.0)
    chosen = F.when(selection.isNotNull(), selection).when(parts, F.coalesce(fit, nothing) + F.coalesce(validation, nothing)).otherwise(F.coalesce(legacy, nothing))
    status = (
        F.when(selection.isNotNull() & fit.isNotNull(), "separated").when(selection.isNotNull() | parts, "partially_separated")
        .when(legacy.isNotNull(), "unseparated_legacy_total").otherwise("unmeasured")
    )
    return runs.withColumn("total", chosen + F.coalesce("evaluation", nothing)).withColumn("cost_status", status)


def resource_fields(df: DataFrame, selection: str, evaluation: str, condition: str) -> DataFrame:
    """Two observations (structs) of one run side by side; what was not measured apart says so.

    A condition other than isolated, contended or unknown is null, and only isolated runs are usable.
    """
    memory = ("peak_process_rss_bytes", "peak_process_tree_rss_bytes", "peak_cuda_allocated_bytes", "peak_cuda_reserved_bytes")
    status = {"process_memory_status": "resource_status", "cuda_memory_status": "cuda_resource_status"}
    flat = {}
    for name, column in (("selection", selection), ("evaluation", evaluation)):
        flat |= {f"{name}_{f}": F.col(f"{column}.{f}") for f in memory} | {f"{name}_{to}": F.col(f"{column}.{f}") for f, to in status.items()}
    known = F.when(F.col(condition).isin("isolated", "contended", "unknown"), F.col(condition))
    none = F.lit(None).cast("bigint")
    flat |= {
        "selected_fit_peak_process_tree_rss_bytes": none, "selected_fit_peak_cuda_allocated_bytes": none, "selected_fit_resource_status": F.lit("not_measured_separately"),
        "resource_sample_interval_s": F.greatest(f"{selection}.sample_interval_s", f"{evaluation}.sample_interval_s"),
        "resource_measurement_condition": known, "resource_cost_usable": F.coalesce(known == "isolated", F.lit(False)),
    }
    return df.withColumns(flat)
