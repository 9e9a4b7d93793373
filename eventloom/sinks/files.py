"""Results as files; every writer replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True)


def write_text(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Column ``value``, with a folder for each value of ``by``."""
    out = rows.select("value", *([by] if by else [])).write.mode("overwrite")
    (out.partitionBy(by) if by else out).text(path)


def write_parquet(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    out = rows.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def count_lines(rows: DataFrame, name: str = "bench", n: str = "n") -> DataFrame:
    """``value``: ``name - n`` lines."""
    return rows.select(F.concat_ws(" - ", F.col(name), F.col(n).cast("string")).alias("value"))


def paired_text(rows: DataFrame) -> DataFrame:
    """``value``: a paragraph for each benchmark of its means, test and effect size."""
    lines = [F.concat(F.lit("Benchmark: "), F.col("bench"))]
    for title, column in (("Default Mean", "a_mean"), ("Instrumented Mean", "b_mean"), ("P-value", "p_value"), ("Will statistic", "w"), ("Cohen d", "d")):
        lines.append(F.concat(F.lit(f"    {title}: "), F.coalesce(F.col(column).cast("string"), F.lit("nan"))))
    return rows.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def points(rows: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """metric, key, value of all values above 0, as scatter charts of all metrics show them; in one pass."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select(key, F.explode(pairs).alias("p")).select("p.metric", key, "p.value").where("value > 0")


def chart_data(rows: DataFrame, metrics: list[str], key: str, n: int = 30) -> dict[str, DataFrame]:
    """For each metric the rows with the largest values, as a bar chart shows them."""
    return {m: rows.select(key, m).where(F.col(m) > 0).orderBy(F.desc(m), key).limit(n) for m in metrics}
