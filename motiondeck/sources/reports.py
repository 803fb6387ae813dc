"""Small results as Markdown or JSON text: verdicts, summaries, top tables. For tables whose size is bounded by their meaning."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motiondeck.sources.corpus import atomic_write


def native(value):
    """A value as JSON has it: rows as objects, what is not finite as null."""
    if hasattr(value, "asDict"):
        return {k: native(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): native(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [native(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value if isinstance(value, (int, float, str, bool)) or value is None else str(value)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The first rows of df as a table; figures with four significant digits."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"| {' | '.join(df.columns)} |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *(f"| {' | '.join(cell(v) for v in r)} |" for r in df.limit(most).collect())]) + "\n"


def write_report(path: str, verdicts: DataFrame, checks: DataFrame) -> None:
    """path.json and path.md of a graded report; each file is seen whole or not at all."""
    head, body = verdicts.collect(), checks.orderBy(F.desc("severity"), "metric")
    atomic_write(f"{path}.json", json.dumps({"verdicts": native(head), "checks": native(body.collect())}, sort_keys=True, indent=1))
    atomic_write(f"{path}.md", f"# {', '.join(str(r.verdict) for r in head)}\n\n{markdown_table(body.select('metric', 'value', 'grade', 'informational'))}")


def missing_products(sources: DataFrame, products: DataFrame) -> DataFrame:
    """Sources (stem) with their product's path, NULL where none was made."""
    return sources.join(products.select("stem", F.col("path").alias("product")), "stem", "left")
