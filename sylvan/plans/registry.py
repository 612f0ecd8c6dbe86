"""Queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X
from sylvan.operators import tree as N
from sylvan.plans.relational import TREE_SQL, relational_tree

COLUMNS = "file_path, node_id, type, name, depth, parent_id, descendant_count, sibling_index"
#: Taxonomy codes 0 .. 255 as they occur in part.
CODES_SQL = "select p_partkey, cast((p_size * 5 + p_partkey) % 256 as smallint) as st from {part}"
SECRETS = ["password", "secret", "@", "license"]


def _tree(apply):  # noqa: ANN001, ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply(relational_tree(spark, sf_dir))

    return query


def _where(condition: str) -> str:
    return f"{TREE_SQL} select {COLUMNS} from tree a where {condition}"


_BELOW = "exists (select 1 from tree d where d.file_path = a.file_path and d.node_id > a.node_id and d.node_id <= a.node_id + a.descendant_count and {})"
_ABOVE = "exists (select 1 from tree d where d.file_path = a.file_path and a.node_id > d.node_id and a.node_id <= d.node_id + d.descendant_count and {})"
_SIBLING = "exists (select 1 from tree d where d.file_path = a.file_path and d.parent_id = a.parent_id and {})"
_ROOT = "exists (select 1 from tree r where r.file_path = a.file_path and r.node_id = 1 and {})"


def taxonomy_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.sql(CODES_SQL, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    base = X.semantic_type_base("st")
    return codes.select("p_partkey", base.cast("int").alias("base"), X.is_definition("st").alias("definition"), X.is_call("st").alias("call"), X.is_control_flow("st").alias("control_flow"), X.is_punctuation("st").alias("punctuation"), X.get_kind("st").alias("kind"))


def text_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.string_contains_any("text", SECRETS).alias("found"), X.string_contains_any_i("text", SECRETS).alias("found_i"))


_KIND_CASE = "case cast(st as int) >> 4 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(X.KINDS)) + " end"

QUERIES: dict = {
    "tree_nodes": _tree(lambda t: t),
    "tree_has": _tree(lambda t: N.has(t, "customer", "lineitem", "R", few_files=True)),
    "tree_not_has": _tree(lambda t: N.not_has(t, "orders", "lineitem", "R", few_files=True)),
    "tree_inside": _tree(lambda t: N.inside(t, "lineitem", "orders", "F", "A", few_files=True)),
    "tree_precedes": _tree(lambda t: N.precedes(t, "lineitem", "lineitem", "R")),
    "tree_follows": _tree(lambda t: N.follows(t, "orders", "orders", "P")),
    "tree_children": _tree(lambda t: N.children(t, 0)),
    "tree_descendants": _tree(lambda t: N.descendants(t, 1, few_files=True)),
    "tree_ancestors": _tree(lambda t: N.ancestors(t, 100)),
    "tree_siblings": _tree(lambda t: N.siblings(t, 1, few_files=True)),
    "tree_own_scope": _tree(lambda t: N.own_scope(t, 1, F.col("type") == "orders", few_files=True)),
    "tree_members": _tree(lambda t: N.outermost(t, 1, F.col("type").isin("orders", "lineitem"), few_files=True)),
    "tree_depth_profile": _tree(lambda t: N.depth_profile(t, "customer", few_files=True)),
    "taxonomy_scalars": taxonomy_scalars,
    "text_contains": text_contains,
}
ORACLE_SQL: dict = {
    "tree_nodes": f"{TREE_SQL} select {COLUMNS} from tree",
    "tree_has": _where("a.type = 'customer' and " + _BELOW.format("d.type = 'lineitem' and d.name = 'R'")),
    "tree_not_has": _where("a.type = 'orders' and not " + _BELOW.format("d.type = 'lineitem' and d.name = 'R'")),
    "tree_inside": _where("a.type = 'lineitem' and a.name = 'A' and " + _ABOVE.format("d.type = 'orders' and d.name = 'F'")),
    "tree_precedes": _where("a.type = 'lineitem' and " + _SIBLING.format("d.sibling_index > a.sibling_index and d.type = 'lineitem' and d.name = 'R'")),
    "tree_follows": _where("a.type = 'orders' and " + _SIBLING.format("d.sibling_index < a.sibling_index and d.type = 'orders' and d.name = 'P'")),
    "tree_children": _where("a.parent_id = 0"),
    "tree_descendants": _where(_ROOT.format("a.node_id > 1 and a.node_id <= 1 + r.descendant_count")),
    "tree_ancestors": _where("a.node_id <= 100 and a.node_id + a.descendant_count >= 100"),
    "tree_siblings": f"{TREE_SQL} select " + ", ".join(f"a.{c}" for c in COLUMNS.split(", ")) + " from tree a join tree r on r.file_path = a.file_path and r.parent_id = a.parent_id and r.node_id = 1 where a.node_id <> 1",
    "tree_own_scope": _where(_ROOT.format("a.node_id > 1 and a.node_id <= 1 + r.descendant_count") + " and not " + _ABOVE.format("d.type = 'orders'")),
    "tree_members": _where("a.type = 'orders' and " + _ROOT.format("a.node_id > 1 and a.node_id <= 1 + r.descendant_count")),
    "tree_depth_profile": f"""{TREE_SQL} select a.file_path, a.node_id, a.name, count(*) as total_nodes, cast(max(d.depth - a.depth) as bigint) as max_depth, round(avg(d.depth - a.depth), 2) as avg_depth
from tree a join tree d on d.file_path = a.file_path and d.node_id > a.node_id and d.node_id <= a.node_id + a.descendant_count where a.type = 'customer' group by all""",
    "taxonomy_scalars": "with c as (" + CODES_SQL.replace("{part}", "part") + f""") select p_partkey, cast(st & 252 as int) as base, (st & 240) = 240 as definition, (st & 252) in (208, 136) as call, (st & 240) = 144 as control_flow,
(st & 252) in (4, 8) as punctuation, {_KIND_CASE} as kind from c""",
    "text_contains": "select doc_id, " + " or ".join(f"contains(text, '{s}')" for s in SECRETS) + " as found, " + " or ".join(f"contains(lower(text), '{s}')" for s in SECRETS) + " as found_i from documents",
}

# The code-shaped table's queries stand beside these.
from sylvan.plans import code_queries  # noqa: E402

QUERIES |= code_queries.QUERIES
ORACLE_SQL |= code_queries.ORACLE_SQL
from sylvan.plans import library_queries  # noqa: E402

QUERIES |= library_queries.QUERIES
ORACLE_SQL |= library_queries.ORACLE_SQL
from sylvan.plans import source_queries  # noqa: E402

QUERIES |= source_queries.QUERIES
ORACLE_SQL |= source_queries.ORACLE_SQL
