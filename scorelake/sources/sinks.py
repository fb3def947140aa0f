"""Writing tables and run artifacts: strict JSON, idempotent cells, clean copies, sealed archives."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a folder of CSV with header."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def strict_json(df: DataFrame) -> DataFrame:
    """One column ``value`` of JSON objects in which no number is NaN or infinite: such become null."""
    clean = [
        F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def finite_payload(value: object) -> object:
    """A driver-side payload with non-finite numbers as null and paths as text, at any depth."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): finite_payload(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [finite_payload(v) for v in value]
    return str(value) if isinstance(value, Path) else value


def write_cells(df: DataFrame, path: str, *keys: str) -> None:
    """Append cells so that a repeated run replaces its own and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def pending(planned: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Cells that a resumed run still has to do."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines checkpoint; a torn line is dropped."""
    rows = spark.read.schema(f"{schema}, _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.where("_torn is null").drop("_torn")


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(path, bytes, sha256)`` of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_manifests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(path, status)``: ok, changed, missing or unexpected."""
    a = expected.select("path", F.col("sha256").alias("e"))
    b = actual.select("path", F.col("sha256").alias("a"))
    status = F.when(F.col("e").isNull(), "unexpected").when(F.col("a").isNull(), "missing").when(F.col("e") != F.col("a"), "changed").otherwise("ok")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


ABSOLUTE = re.compile(r"(?<![\w:/.])(?:/[\w.~-]+){2,}/?|\b[A-Za-z]:\\[^\s\"']+")


def redact_text(text: str) -> str:
    """Absolute paths as a mark."""
    return ABSOLUTE.sub("<path>", text)


def safe_relative(name: str) -> bool:
    parts = Path(name).parts
    return bool(parts) and not name.startswith(("/", "\\")) and ".." not in parts and not re.match(r"^[A-Za-z]:", name)


def export_package(runs: dict[str, str], target: str) -> dict:
    """A clean copy of local run folders with a manifest of hashes; the target must be new or empty.

    Text files lose absolute paths; other files are copied as they are.
    """
    out = Path(target)
    if out.exists() and any(out.iterdir()):
        raise FileExistsError(f"{target} is not empty")
    entries = []
    for name, source in sorted(runs.items()):
        if not re.fullmatch(r"[\w.-]+", name) or name in (".", ".."):
            raise ValueError(f"unsafe name {name!r}")
        for file in sorted(p for p in Path(source).rglob("*") if p.is_file()):
            relative = f"{name}/{file.relative_to(source).as_posix()}"
            data = file.read_bytes()
            if file.suffix.lower() in (".json", ".jsonl", ".csv", ".md", ".txt"):
                data = redact_text(data.decode("utf-8", "replace")).encode()
            place = out / relative
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(data)
            entries.append({"path": relative, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    manifest = {"files": entries, "runs": sorted(runs)}
    (out / "manifest.json").write_text(json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


def verify_package(folder: str) -> list[str]:
    """What is wrong with a package: unsafe, changed, missing or unexpected files, absolute paths left."""
    root, issues = Path(folder), []
    listed = {e["path"]: e for e in json.loads((root / "manifest.json").read_text())["files"]}
    found = {p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file()} - {"manifest.json"}
    for path, e in sorted(listed.items()):
        if not safe_relative(path):
            issues.append(f"unsafe: {path}")
        elif path not in found:
            issues.append(f"missing: {path}")
        elif hashlib.sha256((data := (root / path).read_bytes())).hexdigest() != e["sha256"]:
            issues.append(f"changed: {path}")
        elif ABSOLUTE.search(data.decode("utf-8", "replace")) and path.endswith((".json", ".jsonl", ".csv", ".md", ".txt")):
            issues.append(f"absolute path: {path}")
    return issues + [f"unexpected: {p}" for p in sorted(found - set(listed))]


def seal(folder: str, archive: str) -> str:
    """A zip that depends on contents and names alone; returns its hash."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
            info = zipfile.ZipInfo(file.relative_to(folder).as_posix(), (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, file.read_bytes())
    return hashlib.sha256(Path(archive).read_bytes()).hexdigest()


def write_csv(df: DataFrame, folder: str) -> None:
    """A table as CSV with header and without index."""
    df.write.mode("overwrite").csv(folder, header=True)


def write_json(spark: SparkSession, folder: str, payload: object) -> None:
    """A small payload as one indented JSON document; numbers that are not finite become null."""
    text = json.dumps(finite_payload(payload), indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def _cells(df: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.format_string("%.3f", c) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]


def latex_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One ``line`` a row, as a table to be typeset has it; numbers with three decimals, nothing escaped."""
    return df.select(F.concat(F.concat_ws(" & ", *_cells(df, columns)), F.lit(" \\\\")).alias("line"))


def markdown_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One ``line`` a row of a report's table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(df, columns)), F.lit(" |")).alias("line"))
