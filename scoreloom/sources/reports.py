"""Sinks for people: tables as Markdown, models and files as plain records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value) -> str:
    """A value in a table; nothing for a missing one."""
    return "" if value is None else str(value)


def summary_text(n, median, low, high, least, most) -> Column:
    """One line of a summary (n, median, quartiles, range); a dash without values."""
    c = lambda x: F.col(x).cast("string")
    text = F.concat(F.lit("n="), c(n), F.lit(" · med="), c(median), F.lit(" (p25="), c(low), F.lit(", p75="), c(high), F.lit(") · range=["), c(least), F.lit(", "), c(most), F.lit("]"))
    return F.when(F.coalesce(F.col(n), F.lit(0)) == 0, "—").otherwise(text)


def tally(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """How many rows have each of ``values``, 0 for those that none has."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def markdown(title: str, sections: Sequence[tuple[str, DataFrame]], most: int = 200) -> str:
    """A report: each section a table, at most ``most`` rows of it, with a note of how
    many more there are. The tables are small summaries; only those rows are gathered."""
    out = [f"# {title}"]
    for heading, df in sections:
        rows = df.limit(most + 1).collect()
        out += ["", f"## {heading}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(cell(x).replace("|", "\\|") for x in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            out += ["", f"… and {df.count() - most} more"]
    return "\n".join(out) + "\n"


def model_record(spark, features: Sequence[str], classes: Sequence[int], coef: Sequence[Sequence[float]], intercept: Sequence[float], mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """A model as one row of plain arrays: written as JSON it needs no library to read."""
    schema = "features array<string>, classes array<int>, coef array<array<double>>, intercept array<double>, mean array<double>, std array<double>"
    return spark.createDataFrame([(list(features), list(classes), [list(map(float, c)) for c in coef], list(map(float, intercept)), list(map(float, mean)), list(map(float, std)))], schema)


def normalized_files(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, name, sha256, size, content): the files as records of a table, named by their
    id; a table of them replaces a folder of small files."""
    from ..functions.exprs import safe_filename

    body = F.col(content).cast("binary")
    return files.where(F.col(content).isNotNull()).select(F.col(id_col).alias("id"), F.concat(safe_filename(id_col), F.lit(".musicxml")).alias("name"), F.sha2(body, 256).alias("sha256"), F.length(body).alias("size"), body.alias("content"))
