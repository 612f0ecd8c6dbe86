"""Queries of the library, of document blocks, patches and patterns over the code-shaped table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators import documents as D
from sylvan.operators import patching as P
from sylvan.operators import source as C
from sylvan.plans import library as L
from sylvan.plans.code import CODE_SQL, code_tree

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_STATUS = "case when node_count % 10 = 0 then 'stale' when node_count % 10 = 1 then 'deleted' else 'current' end"
#: Files and the nodes of current ones.
_KNOWN = CODE_SQL + f""", sized as (select file_path, max(language) as language, max(end_line) as line_count, count(*) as node_count from code group by file_path),
files as (select *, {_STATUS} as status from sized), known as (select c.*, f.line_count from code c join files f on f.file_path = c.file_path where f.status = 'current')
"""
_USAGE = "case when (semantic_type & 240) = 240 then 'DEFINITION' when type = 'call' then 'CALL' when type = 'identifier' then 'REFERENCE' else 'OTHER' end as usage_type"
_FUNCTION = "type = 'function_definition' and (semantic_type & 240) = 240 and name <> ''"


def library(spark: SparkSession, sf_dir: str) -> L.Library:
    nodes = code_tree(spark, sf_dir)
    sizes = nodes.groupBy(F.col("file_path").alias("id")).agg(F.count("*").alias("node_count"))
    files = L.files_of(nodes).drop("status").join(sizes, "id").withColumn("status", F.expr(_STATUS))
    return L.Library(L.index_nodes(nodes), files, nodes.filter("semantic_type = 208").select(F.lit("calls").alias("relationship_type")))


def _ask(name: str, apply, sql: str) -> None:  # noqa: ANN001
    QUERIES[f"library_{name}"] = lambda spark, sf_dir: apply(library(spark, sf_dir))
    ORACLE_SQL[f"library_{name}"] = _KNOWN + sql


_ask(
    "db_status", L.Library.db_status,
    """select 'files' as table_name, count(*) as record_count, count(*) filter (status = 'current') as current_files, count(*) filter (status = 'stale') as stale_files, count(*) filter (status = 'deleted') as deleted_files from files
union all select 'nodes', count(*), count(distinct file_path), null, null from code union all select 'relationships', count(*), case when count(*) > 0 then 1 else 0 end, null, null from code where semantic_type = 208""",
)
_ask("db_stats", lambda x: x.db_stats().drop("last_update"), "select count(distinct file_path) as total_files, count(distinct language) as languages, count(*) as total_nodes, count(*) filter ((semantic_type & 240) = 240) as definitions, count(*) filter (type = 'function_definition') as functions, count(*) filter (type = 'class_definition') as classes, avg(descendant_count) as avg_complexity from known")
_ask(
    "search", lambda x: x.search("F12", limit=None),
    f"""select file_path, language, name, type, {_USAGE}, start_line, end_line, descendant_count, peek as source_text, case when lower(name) = 'f12' then 1.0 when starts_with(lower(name), 'f12') then 0.9 when contains(lower(name), 'f12') then 0.8 else 0.7 end::double as similarity_score
from known where name <> '' and (contains(lower(name), 'f12') or levenshtein(name, 'F12') <= 2)""",
)
_ask("find_exact", lambda x: x.find_exact("f7", "func"), f"select file_path, language, name, type, {_USAGE}, start_line, end_line, descendant_count, peek as source_text from known where name = 'f7' and contains(lower(type), 'func')")
_ask("find_functions", lambda x: x.find_functions("F2", None), f"select file_path, language, name as function_name, type, start_line, end_line, end_line - start_line + 1 as line_count, children_count, descendant_count as complexity, peek as source_text from known where {_FUNCTION} and contains(lower(name), 'f2')")
_ask("find_classes", lambda x: x.find_classes(None, None), "select file_path, language, name as class_name, type, start_line, end_line, children_count as member_count, descendant_count as complexity, peek as source_text from known where type = 'class_definition' and name <> ''")
_ask("find_variables", lambda x: x.find_variables("v", None), "select file_path, language, name as variable_name, type, start_line, depth, peek as source_text from known where type = 'assignment' and contains(lower(name), 'v')")
_ask("complex_functions", lambda x: x.complex_functions(10, None), f"select file_path, language, name as function_name, type, start_line, end_line, end_line - start_line + 1 as line_count, children_count, descendant_count as total_nodes, round(descendant_count / (end_line - start_line + 1), 2) as nodes_per_line, peek as source_text from known where {_FUNCTION} and descendant_count >= 10")
_ask(
    "file_complexity", lambda x: x.file_complexity().drop("size_bytes"),
    """select file_path, language, line_count, count(*) as total_nodes, count(*) filter ((semantic_type & 240) = 240) as definitions, count(*) filter (type = 'function_definition') as functions, count(*) filter (type = 'class_definition') as classes,
count(*) filter (type in ('if_statement', 'for_statement')) as control_structures, max(depth) as max_nesting_depth, round(avg(depth), 2) as avg_depth, max(descendant_count) as max_function_complexity,
round(avg(descendant_count) filter (type = 'function_definition'), 2) as avg_function_complexity, round(count(*) / line_count, 2) as nodes_per_line from known group by file_path, language, line_count""",
)
_ask(
    "hotspots", lambda x: x.hotspots(8, None),
    f"""select file_path, language, name as function_name, start_line, end_line, descendant_count as complexity, coalesce(k.n, 0) as call_count, cast(round(descendant_count * 0.7 + coalesce(k.n, 0) * 0.3, 2) as double) as hotspot_score, peek as source_text
from known left join (select name as called, count(*) as n from known where type = 'call' group by name) k on k.called = name where {_FUNCTION} and descendant_count >= 8""",
)
_ask(
    "find_calls", lambda x: x.find_calls("print"),
    """select distinct c.file_path, c.name as called_function, c.start_line, c.type as call_type, c.depth, (select max_by(f.name, f.start_line) from known f where f.file_path = c.file_path and f.type = 'function_definition' and f.start_line <= c.start_line and f.end_line >= c.end_line) as calling_function, c.peek as context
from known c where c.type = 'call' and c.name = 'print'""",
)
_ask("find_references", lambda x: x.find_references("v4"), f"select file_path, language, name as symbol, type as node_type, start_line, end_line, depth, {_USAGE}, peek as context from known where name = 'v4'")
_ask(
    "get_context", lambda x: x.get_context("md5", 3),
    """select s.file_path, s.name as target_symbol, s.start_line as target_line, s.type as target_type, n.name as context_symbol, n.type as context_type, n.start_line, n.end_line, n.depth, abs(n.start_line - s.start_line) as distance, n.peek as source_text
from known s join known n on n.file_path = s.file_path and n.start_line between s.start_line - 3 and s.end_line + 3 where s.name = 'md5' and n.name <> ''""",
)
_ask("find_imports", lambda x: x.find_imports("customer1%"), "select file_path, language, name as imported_symbol, type as import_type, start_line, peek as import_statement from known where type = 'import_statement' and file_path like 'customer1%'")
_ask("find_importers", lambda x: x.find_importers("LIB3"), "select file_path, language, name as imported_symbol, type as import_type, start_line, peek as source_text from known where type = 'import_statement' and contains(lower(peek), 'lib3')")
_ask("file_structure", lambda x: x.file_structure("customer10"), "select name, type as node_type, start_line, end_line, depth, children_count, descendant_count, case when (semantic_type & 240) = 240 then 'DEFINITION' when (semantic_type & 240) = 144 then 'FLOW_CONTROL' else 'OTHER' end as semantic_category from known where file_path = 'customer10' and depth <= 3 and name <> '' and ((semantic_type & 240) = 240 or type in ('if_statement', 'for_statement'))")
_ask("file_summary", lambda x: x.file_summary("customer10"), "select type as construct_type, name, start_line, end_line - start_line + 1 as lines, case when (semantic_type & 240) = 240 then 'DEFINITION' else 'IMPORT' end as category from known where file_path = 'customer10' and depth <= 2 and name <> '' and ((semantic_type & 240) = 240 or type = 'import_statement')")
_ask("languages", L.Library.languages, "select language, count(distinct file_path) as file_count, count(*) as total_nodes, count(*) filter ((semantic_type & 240) = 240) as definitions from known group by language")
_ask("coupled_files", lambda x: x.coupled_files(3), "select file_path, language, count(*) as import_count from known where type = 'import_statement' group by all having count(*) >= 3")
_ask("unused_functions", L.Library.unused_functions, f"select file_path, name as function_name, start_line, descendant_count from known where {_FUNCTION} and name not in (select name from known where type = 'call')")


def _measure(name: str, apply, sql: str) -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, sf_dir: apply(code_tree(spark, sf_dir))
    ORACLE_SQL[name] = CODE_SQL + sql


_LINES = "end_line - start_line + 1"
_measure("measure_functions", L.functions_of_file, f"select file_path, node_id, name, start_line, end_line, {_LINES} as line_count, children_count, descendant_count from code where type = 'function_definition'")
_measure("measure_summary", L.summarize_functions, f"select file_path, count(*) as function_count, avg({_LINES}) as avg_lines, max({_LINES}) as max_lines, cast(sum({_LINES}) as bigint) as total_lines, avg(descendant_count) as avg_complexity from code where type = 'function_definition' group by file_path")
_measure("measure_large_functions", lambda t: L.large_functions(t, 9, 12), f"select file_path, name, start_line, {_LINES} as line_count, descendant_count, round(descendant_count / ({_LINES}), 2) as density from code where type = 'function_definition' and ({_LINES} >= 9 or descendant_count >= 12)")
_measure("measure_classes", L.analyze_classes, f"select file_path, name as class_name, {_LINES} as line_count, descendant_count from code where type = 'class_definition'")
_measure("measure_imports", L.get_imports, "select distinct file_path, name as import_name, type, start_line from code where type = 'import_statement'")
_measure(
    "measure_files", L.file_metrics,
    """select file_path, count(*) as total_nodes, max(depth) as max_depth, round(avg(depth), 2) as avg_depth, count(distinct type) as unique_node_types, array_to_string(list_sort(list(distinct type))[1:5], ', ') as example_types, count(*) filter ((semantic_type & 240) = 240) as declarations,
count(*) filter ((semantic_type & 240) in (128, 144)) as statements, count(*) filter ((semantic_type & 240) in (192, 208)) as expressions, count(*) filter (type = 'function_definition') as functions, count(*) filter (type = 'class_definition') as classes from code group by file_path""",
)
_measure(
    "measure_shares", L.semantic_shares,
    """select file_path, case semantic_type & 240 when 240 then 'DEFINITION' when 208 then 'COMPUTATION_NODE' when 144 then 'FLOW_CONTROL' when 80 then 'NAME' when 48 then 'EXTERNAL' end as semantic_category, count(*) as node_count,
round(100.0 * count(*) / sum(count(*)) over (partition by file_path), 2) as percentage from code group by 1, 2""",
)

# ---- blocks, patches and source over the tables ----


def _flat_blocks(t: DataFrame, style: str) -> DataFrame:
    b = F.col("block")
    return D.to_blocks(t, style=style, max_heading_level=3).select("file_path", "element_order", b["element_type"].alias("element_type"), b["content"].alias("content"), b["level"].alias("level"), b["encoding"].alias("encoding"), b["attributes"]["heading_level"].alias("heading"), b["attributes"]["language"].alias("language"))


_BLOCKS = """, defs as (select *, case semantic_type when 240 then 'function' when 248 then 'class' when 244 then 'variable' else 'module' end as kind from code where semantic_type >= 240 and name <> '' and not (semantic_type = 244 and coalesce(scope_function, 0) <> 0)),
infos as (
  select d.*, (select count(*) from defs a where a.file_path = d.file_path and a.node_id < d.node_id and d.node_id <= a.node_id + a.descendant_count) as nest,
    not exists (select 1 from defs c where c.file_path = d.file_path and c.node_id > d.node_id and c.node_id <= d.node_id + d.descendant_count) as leaf,
    name || case when semantic_type = 240 then '()' else '' end || case when note = 'int' then case when semantic_type = 240 then ' -> int' else ': int' end else '' end as signature from defs d
), parts as (
  select c.file_path, -1 as node, 0 as place, 'metadata' as element_type, 'file_path: ' || c.file_path || chr(10) || 'language: ' || max(c.language) || chr(10) || 'definitions: ' || count(d.node_id) || chr(10) || 'functions: ' || count(case when d.kind = 'function' then 1 end) || chr(10) || 'classes: ' || count(case when d.kind = 'class' then 1 end) as content,
    0 as level, 'yaml' as encoding, null as heading, null as language from code c left join defs d on d.file_path = c.file_path and d.node_id = c.node_id group by c.file_path
  union all select file_path, node_id, 0, 'heading', signature, null, 'text', cast({level} as varchar), null from infos
  union all select file_path, node_id, 2, 'code', peek, null, 'text', null, language from infos where {bodies}
  union all select file_path, node_id, 1, 'paragraph', kind || ' ' || signature || ' (lines ' || start_line || '-' || end_line || ')', null, 'text', null, null from infos where {lines}
) select file_path, cast(row_number() over (partition by file_path order by node, place) - 1 as int) as element_order, element_type, content, level, encoding, heading, language from parts"""
for _style, _level, _bodies, _lines in (("outline", "least(1 + nest, 3)", "leaf", "false"), ("flat", "1", "true", "false"), ("summary", "least(1 + nest, 3)", "false", "true")):
    _measure(f"blocks_{_style}", (lambda s: lambda t: _flat_blocks(t, s))(_style), _BLOCKS.format(level=_level, bodies=_bodies, lines=_lines))


def patch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three bytes of every document that has ASCII there, and of some the next two, replaced and put before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text rlike '^[A-Za-z]{6}'").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    place = lambda a, b: (F.lit(1).alias("start_line"), F.lit(a).alias("start_column"), F.lit(1).alias("end_line"), F.lit(b).alias("end_column"))
    edits = docs.select("file_path", *place(1, 4), F.lit("replace").alias("edit_kind"), F.lit("<é>").alias("new_text"))
    edits = edits.union(docs.filter("cast(file_path as long) % 2 = 0").select("file_path", *place(4, 6), F.lit("insert_after"), F.lit("|")))
    return P.patch(edits, docs).select("file_path", F.md5("patched_source").alias("digest"), F.length("patched_source").alias("size"))


QUERIES["patch_documents"] = patch_documents
ORACLE_SQL["patch_documents"] = """with p as (select cast(doc_id as varchar) as file_path, '<é>' || case when doc_id % 2 = 0 then substr(text, 4, 2) || '|' || substr(text, 6) else substr(text, 4) end as t from documents where regexp_matches(text, '^[A-Za-z]{6}'))
select file_path, md5(t) as digest, cast(length(t) as int) as size from p"""
QUERIES["source_lines"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", C.get_source("text", 1, 2).alias("two"), C.get_source_numbered("text", 2, 3).alias("numbered"), C.get_source_line("text", 3).alias("third"))
ORACLE_SQL["source_lines"] = """with s as (select doc_id, string_split(text, chr(10)) as l from documents) select doc_id, array_to_string(l[1:2], chr(10)) as two,
case when len(l) >= 2 then array_to_string(list_transform(list_zip(range(2, least(3, len(l)) + 1), l[2:3]), lambda x: printf('%4d: %s', x[1], x[2])), chr(10)) end as numbered, l[3] as third from s"""
