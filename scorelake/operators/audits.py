"""Audits of runs and requirements over the artifacts they left: each check is one row, the worst decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses from best to worst.
ORDER = ("passed", "partial", "incomplete", "failed")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``(name, text)`` of what stands below ``root``: an artifact is a folder of one text file and named after it."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("name"), F.col("value").alias("text"))


def _one(name: str, frame: DataFrame, status: Column, advisory: bool = False) -> DataFrame:
    return frame.select(F.lit(name).alias("check_name"), status.alias("status"), F.lit(advisory).alias("advisory"))


def _text(files: DataFrame, name: str) -> Column:
    return F.max(F.when(F.col("name") == name, F.col("text")))


def _numbers(text: Column, field: str) -> Column:
    return F.from_json(F.get_json_object(text, f"$.{field}"), "array<double>")


def _table(files: DataFrame, name: str, *columns: str) -> DataFrame:
    """Rows of a CSV artifact, columns by its header; an artifact that is missing has none."""
    lines = files.where(F.col("name") == name).select(F.split("text", "\r?\n").alias("l"))
    cells = lines.select(F.split(F.get("l", F.lit(0)), ",").alias("head"), F.explode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("line")).where("line <> ''")
    cells = cells.withColumn("cell", F.split("line", ","))
    return cells.select(*[F.get("cell", (F.array_position("head", F.lit(c)) - 1).cast("int")).alias(c) for c in columns])


def worst(checks: DataFrame) -> DataFrame:
    """The checks with a last row ``overall``, the worst status of those that are not advisory."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("status"))
    top = checks.where("not advisory").agg(F.get(F.array(*[F.lit(x) for x in ORDER]), (F.max(rank) - 1).cast("int")).alias("s"))
    return checks.unionByName(_one("overall", top, F.coalesce("s", F.lit("passed"))))


def audit_run(files: DataFrame, required: list[str], json_names: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``(check_name, status, advisory)`` of one run's artifacts ``(name, text)``.

    Are the required artifacts there, do the JSON ones parse, are the configured cells done, does
    the summary follow from the raw rows, do the raw rows match the configured grid, and, for
    advice only, was a run summary written. A check whose inputs are missing is incomplete.
    """
    files = files.cache()
    have = files.agg(F.collect_set("name").alias("have"))
    present = _one("artifacts_present", have, F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in required]), "have")) > 0, "incomplete").otherwise("passed"))
    broken = files.where(F.col("name").isin(json_names)).agg(F.count_if(F.try_parse_json("text").isNull()).alias("n"))
    parsable = _one("json_parsable", broken, F.when(F.col("n") > 0, "failed").otherwise("passed"))
    config = files.agg(_text(files, "config.json").alias("c"), F.get_json_object(_text(files, "protocol_audit.json"), "$.status").alias("p"), _text(files, "run_summary.json").alias("s"))
    config = config.select("p", "s", _numbers(F.col("c"), "data_seeds").alias("seeds"), _numbers(F.col("c"), "train_fractions").alias("fracs"))
    lines = files.where("name = 'checkpoint.jsonl'").select(F.explode(F.split("text", "\r?\n")).alias("l"))
    cells = lines.agg(F.count_distinct(F.get_json_object("l", "$.cell")).alias("done")).crossJoin(config)  # a row each
    expected = F.size("seeds") * F.size("fracs")
    status = F.when((F.col("done") == 0) | F.col("seeds").isNull() | F.col("fracs").isNull(), "incomplete").when(F.col("done") < expected, "incomplete").when(F.col("done") > expected, "failed").otherwise("passed")
    status = F.when((status == "passed") & (F.coalesce("p", F.lit("passed")) != "passed"), "incomplete").otherwise(status)
    completed = _one("cells_completed", cells, status)
    number = lambda c: F.col(c).try_cast("double")
    raw = _table(files, "results_raw.csv", "model", "frac", "data_seed", "test_nll").select("model", number("frac").alias("frac"), number("data_seed").alias("data_seed"), number("test_nll").alias("nll"))
    means = raw.where("frac is not null and nll is not null").groupBy("model", "frac").agg(F.avg("nll").alias("mean"), F.count(F.lit(1)).alias("runs"))
    summary = _table(files, "results_summary.csv", "model", "frac", "mean_test_nll", "runs").select("model", number("frac").alias("frac"), number("mean_test_nll").alias("told"), number("runs").alias("told_runs"))
    held = summary.where("frac is not null").withColumn("in_summary", F.lit(1)).join(means, ["model", "frac"], "full_outer")
    wrong = F.col("mean").isNull() | F.col("in_summary").isNull() | F.col("told").isNull() | (F.abs(F.col("told") - F.col("mean")) > tolerance) | (F.col("told_runs") != F.col("runs"))
    follows = held.agg(F.count_if(wrong).alias("n"), F.count("mean").alias("k"), F.count("in_summary").alias("m"))
    matches = _one("summary_matches_raw", follows, F.when((F.col("k") == 0) | (F.col("m") == 0), "incomplete").when(F.col("n") > 0, "failed").otherwise("passed"))
    seen = raw.agg(F.collect_set("data_seed").alias("s"), F.collect_set("frac").alias("f")).withColumnRenamed("s", "seen_seeds").crossJoin(config)
    extra = (F.size(F.array_except("seen_seeds", "seeds")) > 0) | (F.size(F.array_except("f", "fracs")) > 0)
    lacking = (F.size(F.array_except("seeds", "seen_seeds")) > 0) | (F.size(F.array_except("fracs", "f")) > 0)
    grid = _one("config_matches_rows", seen, F.when(F.col("seeds").isNull() | F.col("fracs").isNull() | (F.size("f") == 0), "incomplete").when(extra, "failed").when(lacking, "incomplete").otherwise("passed"))
    told = _one("run_summary_present", config, F.when(F.col("s").isNull(), "incomplete").when(F.try_parse_json("s").isNull(), "failed").otherwise("passed"), advisory=True)
    return worst(reduce(DataFrame.unionByName, [present, parsable, completed, matches, grid, told]))


def _any_contains(texts: Column, fragment: str) -> Column:
    return F.exists(texts, lambda x: F.contains(x, F.lit(fragment)))


def requirement(rule: dict, context: dict[str, DataFrame | None]) -> DataFrame:
    """``(requirement, status)`` of one rule; evidence that is missing gives the rule's ``missing_status``.

    ``context`` holds the evidence: ``files (name, text)``, ``package (status)`` of a manifest
    comparison, ``runs (run, name, text)``, ``costs`` and ``scenarios (cost)``. Rule types:
    ``context_file_exists``, ``package_verified``, ``files_in_each_run``, ``json_field_in_each_run``,
    ``test_report_passed``, ``resource_costs_complete`` and ``cost_scenarios_computed``.
    """
    kind, missing = rule["type"], rule.get("missing_status", "partial")
    if missing not in ORDER:
        raise ValueError(f"no such status: {missing}")
    source = {"context_file_exists": "files", "package_verified": "package", "test_report_passed": "files", "resource_costs_complete": "costs", "cost_scenarios_computed": "scenarios"}.get(kind, "runs")
    df, good = context.get(source), lambda on: F.when(on, "passed")
    if df is None:
        spark = next(x for x in context.values() if x is not None).sparkSession
        return spark.createDataFrame([(rule["name"], missing)], "requirement string, status string")
    if kind == "context_file_exists":
        row = df.agg(good(F.count_if(F.col("name") == rule["file"]) > 0).otherwise(missing).alias("status"))
    elif kind == "package_verified":
        row = df.agg(good((F.count_if(F.col("status") != "ok") == 0) & (F.count(F.lit(1)) > 0)).otherwise("failed").alias("status"))
    elif kind in ("files_in_each_run", "json_field_in_each_run"):
        mine = F.col("name") == rule["file"]
        per = df.groupBy("run").agg(F.max(F.when(mine, F.col("text"))).alias("text"))
        value = F.get_json_object("text", f"$.{rule.get('field', '')}") if kind == "json_field_in_each_run" else F.lit(None)
        bad = F.col("text").isNotNull() & ~F.coalesce(value.isin(rule.get("allowed", [])), F.lit(False)) if kind == "json_field_in_each_run" else F.lit(False)
        row = per.agg(F.when((F.count(F.lit(1)) == 0) | (F.count_if(bad) > 0), "failed").when(F.count_if(F.col("text").isNull()) > 0, missing).otherwise("passed").alias("status"))
    elif kind == "test_report_passed":
        report = df.agg(_text(df, rule["file"]).alias("t"))
        ids = F.from_json(F.get_json_object("t", "$.test_ids"), "array<string>")
        ran = (F.get_json_object("t", "$.status") == "passed") & (F.get_json_object("t", "$.tests_run").try_cast("int") > 0) & (F.size(ids) > 0)
        named = reduce(lambda a, b: a & b, [_any_contains(ids, f) for f in rule.get("fragments", [])], F.lit(True))
        row = report.select(F.when(F.col("t").isNull(), missing).when(~F.coalesce(ran, F.lit(False)), "failed").when(~named, missing).otherwise("passed").alias("status"))
    elif kind == "resource_costs_complete":
        usable = df.where("frac = 1.0 and resource_measurement_condition = 'isolated' and resource_cost_usable")
        gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule["fields"]])
        row = usable.agg(good((F.size(F.array_except(F.array(*[F.lit(m) for m in rule["models"]]), F.collect_set("model"))) == 0) & (F.count_if(gap) == 0)).otherwise(missing).alias("status"))
    elif kind == "cost_scenarios_computed":
        row = df.agg(good((F.count(F.lit(1)) > 0) & (F.count_if(F.col("cost").isNull()) == 0)).otherwise(missing).alias("status"))
    else:
        raise ValueError(f"no such rule: {kind}")
    return row.select(F.lit(rule["name"]).alias("requirement"), "status")
