"""Queries that parse: sources written from the driver's tables go through the front-ends, and SQL knows what they say.

A customer is a Python file with an import and a function for each of its orders; an event is a JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X
from sylvan.operators import analysis as A
from sylvan.operators import documents as D
from sylvan.operators import matching as M
from sylvan.operators import patching as P
from sylvan.operators.selectors import select_from
from sylvan.plans.sizes import parts_for
from sylvan.sources.nodes import extraction
from sylvan.sources.reader import hierarchical, parse_column, parse_list, parse_rows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, content): the functions of a customer's orders in the order of their keys."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    key = F.col("o_orderkey")
    text = F.format_string("def f%d(x):\n    for i in x:\n        if i:\n            g%d(i, %d)\n    return h%d(x)\n\n", key, key % 7, key % 100, key % 5)
    bodies = table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("text")))), lambda s: s["text"]), "").alias("body"))
    files = table("customer").join(bodies, "c_custkey", "left")
    return files.select(F.format_string("c%d.py", "c_custkey").alias("file_path"), F.concat(F.format_string("import lib%d as nat\n\n", "c_nationkey"), F.coalesce("body", F.lit(""))).alias("content"))


#: Kilobytes of the files of orders that one task parses.
PART_KB = 512
#: What most questions ask of a node.
_PLACE = ("file_path", "node_id", "type", "semantic_type", "flags", "name", "start_line", "end_line", "parent_id", "depth", "sibling_index", "descendant_count", "scope")


def dealt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with their language. A file's text is small and its parse is long, so files are dealt by the number of functions:
    PART_KB of the table of orders hold about 29,000 of them. A count of one's own is not merged again by the size of the texts."""
    parts = parts_for(spark.read.parquet(f"{sf_dir}/orders.parquet"), PART_KB)
    return python_files(spark, sf_dir).repartition(parts, "file_path").withColumn("language", F.lit("python"))


def python_nodes(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = _PLACE, keep: Callable[[dict], list[bool]] | None = None, **given) -> DataFrame:  # noqa: ANN003
    """The nodes of the files that keep tells of, with the columns asked for. Their joins merge: many tables that are just small
    enough to be sent to all tasks are together more than a driver holds."""
    return parse_rows(dealt_files(spark, sf_dir), extraction(**given), columns=columns, keep=keep).hint("merge")


def _add(name: str, apply, sql: str, columns: tuple[str, ...] = _PLACE, keep: Callable[[dict], list[bool]] | None = None, once: bool = False, **given) -> None:  # noqa: ANN001, ANN003
    """keep: the nodes that the question is about; once: its plan reads them once, so they are not kept."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = python_nodes(spark, sf_dir, columns, keep, **given)
        return apply(nodes if once else nodes.persist().hint("merge"))

    QUERIES[f"source_{name}"] = query
    ORACLE_SQL[f"source_{name}"] = sql


def _base(*kinds: str) -> Callable[[dict], list[bool]]:
    codes = {X.CODES[k] for k in kinds}
    return lambda c: [st & 0xFC in codes for st in c["semantic_type"]]


def _definitions(c: dict) -> list[bool]:
    return [f & 6 == X.NAME_DEFINITION for f in c["flags"]]


def _of_type(*types: str) -> Callable[[dict], list[bool]]:
    return lambda c: [t in types for t in c["type"]]


def _either(*keeps: Callable[[dict], list[bool]]) -> Callable[[dict], list[bool]]:
    return lambda c: [any(x) for x in zip(*(k(c) for k in keeps), strict=True)]


def _within(keep: Callable[[dict], list[bool]]) -> Callable[[dict], list[bool]]:
    """Such nodes and all below them."""

    def inside(c: dict) -> list[bool]:
        out, last = [], -1
        for i, (mark, below) in enumerate(zip(keep(c), c["descendant_count"], strict=True)):
            last = max(last, i + below) if mark else last
            out.append(i <= last)
        return out

    return inside


def _deepest(c: dict) -> list[bool]:
    """The first of the deepest nodes of each function's own scope."""
    best: dict[int, int] = {}
    for i, (scope, depth) in enumerate(zip(c["scope"], c["depth"], strict=True)):
        f = scope[1]
        if f is not None and (f not in best or depth > c["depth"][best[f]]):
            best[f] = i
    found = set(best.values())
    return [i in found for i in range(len(c["depth"]))]


def _called(c: dict) -> list[bool]:
    """The first children of calls."""
    calls = _base("COMPUTATION_CALL")(c)
    return [k == 0 and p is not None and calls[p] for k, p in zip(c["sibling_index"], c["parent_id"], strict=True)]


_FILE = "'c' || o_custkey || '.py' as file_path"
_add(
    "metrics", A.function_metrics,
    f"""select {_FILE}, 'f' || o_orderkey as name, 'python' as language, cast(3 + 6 * (row_number() over (partition by o_custkey order by o_orderkey) - 1) as int) as start_line, cast(7 + 6 * (row_number() over (partition by o_custkey order by o_orderkey) - 1) as int) as end_line,
5 as lines, cast(1 as bigint) as return_count, cast(1 as bigint) as conditionals, cast(1 as bigint) as loops, cast(3 as bigint) as cyclomatic, 9 as max_depth from orders""",
    ("file_path", "node_id", "type", "semantic_type", "flags", "name", "language", "start_line", "end_line", "depth", "scope"),
    _either(_base("DEFINITION_FUNCTION", "FLOW_CONDITIONAL", "FLOW_LOOP"), _of_type("return_statement"), _deepest),
)
# A graph of calls has neither the callers' qualified names nor the calls' text, so those are not made.
_add("call_graph", lambda t: A.call_graph(t.withColumns({"qualified_name": F.lit(None), "peek": F.lit(None)})), f"select {_FILE}, 'f' || o_orderkey as caller, n.name || case n.name when 'g' then o_orderkey % 7 else o_orderkey % 5 end as callee, 'function' as call_type, cast(1 as bigint) as call_count from orders, (values ('g'), ('h')) n(name)",
     ("file_path", "node_id", "type", "semantic_type", "flags", "name", "language", "start_line", "parent_id", "sibling_index", "scope"), _either(_base("DEFINITION_FUNCTION", "COMPUTATION_CALL"), _called))
_add("imports", A.imports, "select 'c' || c_custkey || '.py' as file_path, 'lib' || c_nationkey as source_module, 'nat' as imported_name, 'import_statement' as import_type, 1 as start_line from customer", ("file_path", "node_id", "type", "semantic_type", "flags", "name", "start_line", "parent_id", "descendant_count"), _within(_base("EXTERNAL_IMPORT")))
_SELECTED = ("file_path", "node_id", "type", "semantic_type", "flags", "name", "descendant_count")
_add("select", lambda t: select_from(t, "function_definition:has(call#g3):not(:has(call#h2))", ordered=False).select("file_path", "name"), f"select {_FILE}, 'f' || o_orderkey as name from orders where o_orderkey % 7 = 3 and o_orderkey % 5 <> 2", _SELECTED, _of_type("function_definition", "call"), once=True)
_add("parent_definition", lambda t: select_from(t, "call#g1::parent-definition", ordered=False).select("file_path", "name", "type"), f"select {_FILE}, 'f' || o_orderkey as name, 'function_definition' as type from orders where o_orderkey % 7 = 1", _SELECTED, _either(_of_type("call"), _definitions))
QUERIES["source_match"] = lambda spark, sf_dir: M.match_sources(dealt_files(spark, sf_dir), "__F__(__X__, __Y__)").select("file_path", F.col("captures")["F"][0]["name"].alias("called"), F.col("captures")["Y"][0]["peek"].alias("second"))
# A wildcard that finds nothing is no capture: calls of one argument match too.
ORACLE_SQL["source_match"] = f"select {_FILE}, 'g' || o_orderkey % 7 as called, cast(o_orderkey % 100 as varchar) as second from orders union all select {_FILE}, 'h' || o_orderkey % 5, null from orders"
_add(
    "outline", lambda t: D.to_blocks(t, include_bodies=False, include_metadata=False).select("file_path", "element_order", F.col("block.content").alias("content"), F.col("block.attributes")["heading_level"].alias("level")),
    f"select {_FILE}, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as element_order, 'f' || o_orderkey || '(x)' as content, '1' as level from orders",
    (*_PLACE, "language", "signature_type", "parameters", "peek"), lambda c: [st & 0xF0 == 0xF0 for st in c["semantic_type"]], peek="none+schema",
)
_add("nested", lambda t: hierarchical(t).filter("type = 'integer'").select("source.file_path", "context.name", "structure.children_count"), f"select {_FILE}, cast(o_orderkey % 100 as varchar) as name, 0 as children_count from orders", (*_PLACE, "language", "children_count"), _of_type("integer"), once=True)


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of g1 renamed, and the digest of what comes out."""
    nodes = python_nodes(spark, sf_dir, ("file_path", "type", "name", "start_line", "start_column", "end_line", "end_column"), _of_type("identifier"), source="full", peek="none")
    edits = nodes.filter("type = 'identifier' and name = 'g1'").select(P.node_edit("replace", "renamed").alias("e")).select("e.*")
    return P.patch(edits, python_files(spark, sf_dir)).select("file_path", F.md5("patched_source").alias("digest"))


QUERIES["source_patch"] = patched
ORACLE_SQL["source_patch"] = f"""with f as (
  select o_custkey, string_agg(printf('def f%d(x):\n    for i in x:\n        if i:\n            %s(i, %d)\n    return h%d(x)\n\n', o_orderkey, case when o_orderkey % 7 = 1 then 'renamed' else 'g' || o_orderkey % 7 end, o_orderkey % 100, o_orderkey % 5), '' order by o_orderkey) as body,
    max(case when o_orderkey % 7 = 1 then 1 else 0 end) as hit from orders group by o_custkey
) select {_FILE}, md5('import lib' || c_nationkey || ' as nat\n\n' || body) as digest from f join customer on c_custkey = o_custkey where hit = 1"""
QUERIES["source_json"] = lambda spark, sf_dir: parse_column(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props", "json").filter("type = 'number'").select("event_id", F.col("peek").cast("int").alias("k"))
ORACLE_SQL["source_json"] = "select event_id, cast(json_extract(props, '$.k') as int) as k from events"
QUERIES["source_list"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.size(F.filter(parse_list("props", F.lit("json")), lambda n: n["type"] == "pair")).alias("pairs"))
ORACLE_SQL["source_list"] = "select event_id, cast(len(json_keys(props)) as int) as pairs from events"
