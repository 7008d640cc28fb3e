"""Sinks: run-partitioned Parquet, CSV, models, JSON and Markdown reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class RunWriter:
    """Writes Parquet to output/run_date=.../run_id=.... Nothing is written for an empty table; no write follows finalize."""

    def __init__(self, output: str, run_id: str, run_date: str, compression: str = "snappy") -> None:
        self.root, self.path, self.compression, self.done = output, f"{output}/run_date={run_date}/run_id={run_id}", compression, False

    def write(self, df: DataFrame) -> None:
        if self.done:
            raise RuntimeError("the run is finalized")
        if not df.isEmpty():
            df.write.mode("append").option("compression", self.compression).parquet(self.path)

    def write_sample(self, df: DataFrame, key: str, rows: int) -> str:
        out = f"{self.path}/_sample"
        df.orderBy(key).limit(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(out)
        return out

    def write_summary(self, summary: dict) -> str:
        return write_text(f"{self.path}/_summary.json", json.dumps(summary, indent=2, default=str))

    def finalize(self) -> str:
        """Mark the run's folder as whole, also where nothing was written."""
        self.done = True
        return write_text(f"{self.path}/_SUCCESS", "")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in a folder."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def write_text(path: str, text: str) -> str:
    """Write a small file to any file system that Spark knows, as it resolves the path; without a session, to the local one."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        at = Path(path)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
        return str(at)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def markdown_table(header: list[str], rows: list[list]) -> str:
    if not rows:
        return "_(no rows)_"
    cell = lambda x: "-" if x is None or x != x else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(header) + " |", "|" + " --- |" * len(header)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def _pair(path: str, title: str, passed: bool, header: list[str], rows: list[list], more: dict) -> tuple[str, str]:
    base = path.removesuffix(".json").removesuffix(".md")
    records = [dict(zip(header, [None if x != x else x for x in r], strict=True)) for r in rows]
    text = f"# {title}\n\nResult: {'passed' if passed else 'failed'}\n\n{markdown_table(header, rows)}\n"
    return write_text(f"{base}.json", json.dumps({"passed": passed, **more, "rows": records}, indent=2)), write_text(f"{base}.md", text)


def schema_report(issues: DataFrame, path: str) -> bool:
    """JSON and Markdown of the issues (a row for each failed rule); whether no error is among them."""
    rows = [list(r) for r in issues.orderBy("column", "rule").collect()]
    ok = all(r[2] != "error" for r in rows)
    _pair(path, "Contract report", ok, issues.columns, rows, {"n_issues": len(rows)})
    return ok


def drift_report(report: DataFrame, path: str) -> bool:
    """JSON and Markdown of the features; whether none failed."""
    rows = [list(r)[1:] for r in report.orderBy("position").collect()]
    status = report.columns.index("status") - 1
    failed, warned = (sum(r[status] == s for r in rows) for s in ("fail", "warn"))
    _pair(path, "Drift report", not failed, report.columns[1:], rows, {"n_failures": failed, "n_warnings": warned})
    return not failed
