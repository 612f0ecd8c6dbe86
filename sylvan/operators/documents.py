"""Node tables as document blocks: a heading for each definition, its text or a line about it, and a block about the file.

How deep a definition nests is a running sum over where definitions open and close, so the cost is one sort of the
definitions by file; nothing is joined by ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X
from sylvan.operators.tree import end, is_named_definition

STYLES = ("outline", "summary", "flat")
KINDS = {"function": "DEFINITION_FUNCTION", "class": "DEFINITION_CLASS", "variable": "DEFINITION_VARIABLE", "module": "DEFINITION_MODULE"}


def _parameter(p: Column) -> Column:
    name, kind = F.coalesce(p["name"], F.lit("")), F.coalesce(p["type"], F.lit(""))
    return F.when(name == "", kind).when(kind == "", name).otherwise(F.concat(name, F.lit(": "), kind))


def _definitions(nodes: DataFrame) -> DataFrame:
    """Named definitions without the variables of functions, with kind, signature, nesting and whether they hold others."""
    base = X.bits("semantic_type", 0xFC)
    local = (base == X.CODES["DEFINITION_VARIABLE"]) & (F.coalesce(F.col("scope.function"), F.lit(0)) != 0)
    kind = F.lit("other")
    for name, code in KINDS.items():
        kind = F.when(base == X.CODES[code], name).otherwise(kind)
    found = nodes.filter(is_named_definition() & ~local).withColumn("_kind", kind)
    function, said = F.col("_kind") == "function", F.coalesce(F.col("signature_type"), F.lit(""))
    signature = F.concat(
        F.col("name"), F.when(function, F.concat(F.lit("("), F.coalesce(F.array_join(F.transform("parameters", _parameter), ", "), F.lit("")), F.lit(")"))).otherwise(""),
        F.when((said != "") & (F.lower(said) != F.col("_kind")), F.concat(F.when(function, " -> ").otherwise(": "), said)).otherwise(""),
    )
    columns = ("file_path", "language", "node_id", "_kind", "_signature", "start_line", "end_line", "peek", "_last")
    d = found.withColumn("_signature", signature).withColumn("_last", end()).select(*columns)
    # A definition opens at its number and closes behind its last node; closings come first.
    opens = d.select("*", F.col("node_id").alias("_at"), F.lit(1).alias("_step"))
    closes = d.select("file_path", *(F.lit(None).cast(d.schema[c].dataType).alias(c) for c in columns[1:]), (F.col("_last") + 1).alias("_at"), F.lit(-1).alias("_step"))
    order = Window.partitionBy("file_path").orderBy("_at", "_step")
    depth = F.coalesce(F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nested = opens.union(closes).withColumn("_depth", depth).filter("_step = 1")
    following = F.lead("node_id").over(Window.partitionBy("file_path").orderBy("node_id"))
    return nested.withColumn("_leaf", F.coalesce(following > F.col("_last"), F.lit(True)))


def to_blocks(nodes: DataFrame, style: str = "outline", include_bodies: bool = True, include_metadata: bool = True, base_heading_level: int = 1, max_heading_level: int = 6) -> DataFrame:
    """(file_path, element_order, block) by file and order; a block is kind, element_type, content, level, encoding, attributes
    and element_order. A file without definitions has its metadata only."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; one of {', '.join(STYLES)}")
    for name, value in (("base_heading_level", base_heading_level), ("max_heading_level", max_heading_level)):
        if not 1 <= value <= 6:
            raise ValueError(f"{name} must be in 1 .. 6, not {value}")
    defs = _definitions(nodes)
    bodies = include_bodies and style != "summary"
    if bodies and defs.filter("peek is not null").isEmpty() and not defs.isEmpty():
        raise ValueError("bodies are asked for, but the peek column is null throughout; parse with peek='full' or leave bodies out")
    nothing = F.create_map().cast("map<string,string>")

    def part(rows: DataFrame, node: Column, place: int, kind: str, content: Column, level: Column, encoding: str, attributes: Column) -> DataFrame:
        return rows.select("file_path", node.cast("long").alias("_node"), F.lit(place).alias("_place"), F.lit(kind).alias("element_type"), content.alias("content"), level.cast("int").alias("level"), F.lit(encoding).alias("encoding"), attributes.alias("attributes"))

    at, none = F.col("node_id"), F.lit(None)
    level = F.lit(min(base_heading_level, max_heading_level)) if style == "flat" else F.least(F.col("_depth") + base_heading_level, F.lit(max_heading_level))
    parts = [part(defs, at, 0, "heading", F.col("_signature"), none, "text", F.create_map(F.lit("heading_level"), level.cast("string")))]
    if style == "summary":
        line = F.concat("_kind", F.lit(" "), "_signature", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
        parts.append(part(defs, at, 1, "paragraph", line, none, "text", nothing))
    if bodies:
        parts.append(part(defs if style == "flat" else defs.filter("_leaf"), at, 2, "code", F.col("peek"), none, "text", F.create_map(F.lit("language"), F.coalesce("language", F.lit("unknown")))))
    if include_metadata:
        counts = defs.groupBy("file_path").agg(F.count("*").alias("_n"), F.count_if(F.col("_kind") == "function").alias("_f"), F.count_if(F.col("_kind") == "class").alias("_c"))
        files = nodes.groupBy("file_path").agg(F.max("language").alias("language")).join(counts, "file_path", "left")
        told = {"file_path": F.col("file_path"), "language": F.coalesce("language", F.lit("unknown"))} | {k: F.coalesce(c, F.lit(0)).cast("string") for k, c in (("definitions", "_n"), ("functions", "_f"), ("classes", "_c"))}
        parts.append(part(files, F.lit(-1), 0, "metadata", F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in told.items())), F.lit(0), "yaml", nothing))
    order = (F.row_number().over(Window.partitionBy("file_path").orderBy("_node", "_place")) - 1).cast("int")
    rows = reduce(lambda a, b: a.union(b), parts).withColumn("element_order", order)
    block = F.struct(F.lit("block").alias("kind"), "element_type", "content", "level", "encoding", "attributes", "element_order")
    return rows.select("file_path", "element_order", block.alias("block")).orderBy("file_path", "element_order")


def blocks_of_files(spark: SparkSession, files: str | list[str], language: str | None = None, **given) -> DataFrame:  # noqa: ANN003
    """to_blocks of files, parsed with their whole text."""
    from sylvan.sources.reader import read_ast

    return to_blocks(read_ast(spark, files, language, peek="full"), **given)


def blocks_list(spark: SparkSession, files: str | list[str], language: str | None = None, **given) -> DataFrame:  # noqa: ANN003
    """(file_path, blocks): one row for each file, its blocks in order."""
    rows = blocks_of_files(spark, files, language, **given)
    packed = rows.groupBy("file_path").agg(F.array_sort(F.collect_list("block"), lambda a, b: a["element_order"] - b["element_order"]).alias("blocks"))
    return packed.orderBy("file_path")
