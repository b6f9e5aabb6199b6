"""Evaluation reports: sinks for a frame of metrics, found by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Reporter = Callable[[DataFrame, str], None]


def json_report(metrics: DataFrame, path: str) -> None:
    metrics.write.json(path)


def csv_report(metrics: DataFrame, path: str) -> None:
    metrics.write.option("header", True).csv(path)


def markdown_report(metrics: DataFrame, path: str) -> None:
    """A table row for each metric row, in the frame's order within a file."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in metrics.columns]
    metrics.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.text(path)


#: The extension point: name -> reporter.
REPORTERS: dict[str, Reporter] = {"json": json_report, "csv": csv_report, "markdown": markdown_report}


def report(metrics: DataFrame, path: str, names: list[str]) -> None:
    """The same metrics through each reporter, under its name."""
    odd = set(names) - set(REPORTERS)
    if odd:
        raise ValueError(f"no such reporters: {sorted(odd)}")
    for name in names:
        REPORTERS[name](metrics, f"{path}/{name}")
