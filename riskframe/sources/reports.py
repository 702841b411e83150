"""Metric reports as text: one per model, rendered from and parsed back into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.functions.text import captured_number, section, strip
from riskframe.operators.profile import mark_best

# --- fixed values: report layout ------------------------------------------------------
METRIC_LINES = {
    "accuracy": "Accuracy:  ", "precision": "Precision: ", "recall": "Recall:    ",
    "f1_score": "F1-score:  ", "roc_auc": "ROC AUC:   ", "average_precision": "PR AUC:    ",
}
METRIC_PATTERNS = {
    "precision": [r"Precision:\s+(\d\.\d+)", r"Canceled \(1\)\s+(\d\.\d+)\s+\d\.\d+\s+\d\.\d+"],
    "recall": [r"Recall:\s+(\d\.\d+)", r"Canceled \(1\)\s+\d\.\d+\s+(\d\.\d+)\s+\d\.\d+"],
    "f1_score": [r"F1-score:\s+(\d\.\d+)", r"Canceled \(1\)\s+\d\.\d+\s+\d\.\d+\s+(\d\.\d+)"],
    "pr_auc": [r"PR AUC:\s+(\d\.\d+)", r"Underlying PR AUC of the model:\s+(\d\.\d+)"],
    "roc_auc": [r"ROC AUC:\s+(\d\.\d+)"],
}
REPORT_PATTERN = r"(?s)(Classification Report:.*?)\n\s*(?:CM:|Confusion Matrix:)"
MATRIX_PATTERN = r"(?s)(?:CM:|Confusion Matrix:)[^\n]*\n(.*?)(?:\n\s*\n|$)"
COMPARED = ["precision", "recall", "f1_score", "pr_auc", "roc_auc"]


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def render(evaluated: DataFrame, name: str) -> DataFrame:
    """Evaluation rows (see `evaluate.evaluate`) as report texts: rows (name, value)."""
    title = F.concat(F.lit("--- "), F.col(name).cast("string"), F.lit(" Evaluation Metrics ---"))
    lines = [title, *[F.concat(F.lit(head), _fixed(F.col(m), 4)) for m, head in METRIC_LINES.items()]]
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    width = F.greatest(*[F.length(c.cast("string")) for c in (tn, fp, fn, tp)])
    padded = lambda c: F.lpad(c.cast("string"), width, F.lit(" "))
    matrix = F.concat(
        F.lit("[["), padded(tn), F.lit(", "), padded(fp), F.lit("],\n ["), padded(fn), F.lit(", "), padded(tp), F.lit("]]")
    )
    positive = F.concat(
        F.lit("    Canceled (1)       "), _fixed(F.col("precision"), 2), F.lit("      "), _fixed(F.col("recall"), 2),
        F.lit("      "), _fixed(F.col("f1_score"), 2), F.lit("  "), F.lpad((tp + fn).cast("string"), 8, " "),
    )
    head = F.lit("Classification Report:\n                  precision    recall  f1-score   support\n\n")
    value = F.concat_ws("\n", *lines, F.lit(""), F.concat(head, positive), F.lit(""), F.lit("CM:"), matrix)
    return evaluated.select(F.col(name).cast("string").alias("name"), value.alias("value"))


def write_reports(reports: DataFrame, path: str) -> str:
    """One folder per report name."""
    reports.write.mode("overwrite").partitionBy("name").text(path)
    return path


def read_reports(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Report files, each as one row (name, value). The name is the folder written by
    `write_reports`, or else the file name without its ending."""
    files = spark.read.text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    name = F.col("name").cast("string") if "name" in files.columns else stem
    return files.select(name.alias("name"), "value")


def parse(reports: DataFrame) -> DataFrame:
    """Add precision, recall, f1_score, pr_auc and roc_auc of the positive class, the report
    section and the matrix text. The four-decimal lines count before the two-decimal table."""
    metrics = {
        name: F.coalesce(*[captured_number("value", p) for p in patterns])
        for name, patterns in METRIC_PATTERNS.items()
    }
    return reports.withColumns({
        **metrics,
        "report_text": section("value", REPORT_PATTERN),
        "matrix_text": strip(section("value", MATRIX_PATTERN)),
    })


def compare(parsed: DataFrame, metrics: Sequence[str] = COMPARED) -> DataFrame:
    """The models side by side, with a mark at the best value of each metric."""
    return mark_best(parsed.select("name", *metrics), metrics)
