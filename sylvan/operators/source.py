"""Source text of files and of definitions, by line. Lines are counted from 1; a null or missing line gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X
from sylvan.operators.tree import is_named_definition

KINDS = {"function": "DEFINITION_FUNCTION", "class": "DEFINITION_CLASS", "variable": "DEFINITION_VARIABLE", "module": "DEFINITION_MODULE"}


def _lines(content: Column | str) -> Column:
    return F.split(F.col(content) if isinstance(content, str) else content, "\n", -1)


def _column(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def _within(content: Column | str, start: Column | str | int, last: Column | str | int) -> tuple[Column, Column, Column]:
    """The lines, and the first and last number asked for that exist."""
    lines = _lines(content)
    return lines, F.greatest(_column(start), F.lit(1)), F.least(_column(last), F.size(lines))


def get_source(content: Column | str, start: Column | str | int, last: Column | str | int) -> Column:
    """Lines start .. last of a text."""
    lines, a, b = _within(content, start, last)
    return F.when(a <= b, F.array_join(F.slice(lines, a, b - a + 1), "\n", ""))


def get_source_numbered(content: Column | str, start: Column | str | int, last: Column | str | int) -> Column:
    """The same with each line's number before it, four places wide."""
    lines, a, b = _within(content, start, last)
    numbered = F.transform(F.sequence(a, F.greatest(a, b)), lambda k: F.format_string("%4d: %s", k, F.get(lines, k - 1)))
    return F.when(a <= b, F.array_join(numbered, "\n"))


def get_source_line(content: Column | str, line: Column | str | int) -> Column:
    """One line of a text."""
    return F.get(_lines(content), _column(line) - 1)


def read_text(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """(file_path, content) of files, folders and globs; a file is one row."""
    from sylvan.sources.reader import file_rows

    return file_rows(spark, files).select("file_path", F.col("content").cast("string").alias("content"))


def source_of(nodes: DataFrame, texts: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Definitions of a name with their numbered source. texts: (file_path, content); only files that define the name meet it."""
    if kind is not None and kind not in (*KINDS, "type"):
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}, type")
    base, told = X.bits("semantic_type", 0xFC), F.lit("other")
    for k, code in KINDS.items():
        told = F.when(base == X.CODES[code], k).otherwise(told)
    found = nodes.filter(is_named_definition() & (F.col("name") == name)).withColumn("definition_kind", told)
    if kind is not None:  # the taxonomy has no code for types, so that kind is never found
        found = found.filter(F.col("definition_kind") == kind)
    rows = found.select("file_path", "name", "definition_kind", "start_line", "end_line").join(texts.select("file_path", "content"), "file_path")
    return rows.withColumn("source", get_source_numbered("content", "start_line", "end_line")).drop("content").orderBy("file_path", "start_line")
