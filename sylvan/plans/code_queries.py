"""Queries over the code-shaped table (see sylvan.plans.code), by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X
from sylvan.operators import analysis as A
from sylvan.operators import tree as N
from sylvan.operators.selectors import select_from
from sylvan.plans.code import CODE_SQL, PLAIN, code_tree

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name: str, apply, sql: str, flat: bool = True) -> None:  # noqa: ANN001
    """apply(code tree) -> DataFrame; flat: only the PLAIN columns are told."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = apply(code_tree(spark, sf_dir))
        return out.selectExpr(*PLAIN.split(", ")) if flat else out

    QUERIES[name] = query
    ORACLE_SQL[name] = CODE_SQL + sql


def _where(condition: str, alias: str = "a") -> str:
    return "select " + ", ".join(f"{alias}.{c}" for c in PLAIN.split(", ")) + f" from code {alias} where {condition}"


_BELOW = "exists (select 1 from code d where d.file_path = a.file_path and d.node_id > a.node_id and d.node_id <= a.node_id + a.descendant_count and {})"
_ABOVE = "exists (select 1 from code d where d.file_path = a.file_path and a.node_id > d.node_id and a.node_id <= d.node_id + d.descendant_count and {})"
_SIBLING = "exists (select 1 from code d where d.file_path = a.file_path and d.parent_id = a.parent_id and {})"
_PARENT = "exists (select 1 from code d where d.file_path = a.file_path and d.node_id = a.parent_id and {})"
_FUNCTION = "(semantic_type & 252) = 240 and (flags & 1) = 0"
#: Named functions, under the alias f.
_FUNCTIONS = f"select * from code where {_FUNCTION} and name <> ''"

# ---- structure ----

_add("code_nodes", lambda t: t, _where("true"))
_add("code_containing_line", lambda t: N.containing_line(t, 12), _where("a.start_line <= 12 and a.end_line >= 12"))
_add("code_in_range", lambda t: N.in_range(t, 5, 20), _where("a.start_line >= 5 and a.end_line <= 20"))
_add("code_siblings", lambda t: N.siblings(t, 2), "select " + ", ".join(f"a.{c}" for c in PLAIN.split(", ")) + " from code a join code r on r.file_path = a.file_path and r.parent_id = a.parent_id and r.node_id = 2 where a.node_id <> 2")
_add("code_function_scope", lambda t: N.own_scope(t, 1), _where("exists (select 1 from code r where r.file_path = a.file_path and r.node_id = 1 and a.node_id > 1 and a.node_id <= 1 + r.descendant_count) and not " + _ABOVE.format("d.node_id > 1 and (d.flags & 6) = 6 and (d.semantic_type & 252) = 240")))
_add(
    "code_class_members", lambda t: N.class_members(t, 1),
    f"""select {', '.join(f'a.{c}' for c in N.MEMBER)} from code a join code r on r.file_path = a.file_path and r.node_id = 1 and a.node_id > 1 and a.node_id <= 1 + r.descendant_count
where (a.semantic_type & 240) = 240 and (a.flags & 1) = 0 and a.name <> '' and not """ + _ABOVE.format("d.node_id > 1 and (d.semantic_type & 240) = 240 and (d.flags & 1) = 0 and d.name <> ''"), False,
)
_KIND = "case (d.semantic_type & 252) when 240 then 'DEFINITION_FUNCTION' when 244 then 'DEFINITION_VARIABLE' when 248 then 'DEFINITION_CLASS' else 'DEFINITION_MODULE' end"
_add(
    "code_definition_parent", N.definition_parent,
    f"""select d.file_path, d.node_id, d.name as def_name, {_KIND} as kind, p.name as parent_def_name, {_KIND.replace('d.', 'p.')} as parent_def_kind, p.node_id as parent_def_node_id
from code d join code p on p.file_path = d.file_path and d.node_id > p.node_id and d.node_id <= p.node_id + p.descendant_count and (p.semantic_type & 240) = 240
where (d.semantic_type & 240) = 240 and (d.flags & 1) = 0 and d.name <> '' and d.depth >= 1 qualify row_number() over (partition by d.file_path, d.node_id order by p.depth desc) = 1""", False,
)
_add(
    "code_definitions", lambda t: A.definitions(t).withColumn("semantic_type", F.col("semantic_type").cast("int")),
    """select name, case (semantic_type & 252) when 240 then 'function' when 248 then 'class' when 244 then 'variable' when 252 then 'module' else 'other' end as definition_type,
language, file_path, start_line, end_line, node_id, type, semantic_type from code where (semantic_type & 240) = 240 and (flags & 1) = 0 and name <> ''""", False,
)

# ---- analysis ----

_add(
    "code_function_metrics", A.function_metrics,
    f"""select f.file_path, f.name, f.language, f.start_line, f.end_line, f.end_line - f.start_line + 1 as lines, count(case when n.type = 'return_statement' then 1 end) as return_count,
count(case when (n.semantic_type & 252) = 144 and n.type like '%_statement' then 1 end) as conditionals, count(case when (n.semantic_type & 252) = 148 and n.type like '%_statement' then 1 end) as loops,
count(case when (n.semantic_type & 252) in (144, 148) and n.type like '%_statement' then 1 end) + 1 as cyclomatic, coalesce(max(n.depth) - f.depth, 0) as max_depth
from ({_FUNCTIONS}) f left join code n on n.file_path = f.file_path and n.scope_function = f.node_id group by f.file_path, f.node_id, f.name, f.language, f.start_line, f.end_line, f.depth""", False,
)
_add(
    "code_functions_containing", lambda t: A.functions_containing(t, "for_statement"),
    f"select f.file_path, f.name, f.language, f.start_line, f.end_line from ({_FUNCTIONS}) f where exists (select 1 from code n where n.file_path = f.file_path and n.scope_function = f.node_id and n.type = 'for_statement')", False,
)
_add(
    "code_nesting", A.nesting_analysis,
    f"""select f.file_path, f.name, f.language, f.start_line, f.end_line, max(n.depth - f.depth) as max_depth, round(avg(n.depth - f.depth), 2) as avg_depth,
count(case when n.depth - f.depth > 5 then 1 end) as deep_nodes, count(*) as total_nodes
from ({_FUNCTIONS}) f join code n on n.file_path = f.file_path and n.scope_function = f.node_id group by f.file_path, f.node_id, f.name, f.language, f.start_line, f.end_line""", False,
)
_RISK = " union all ".join(f"select '{p}' as pattern, '{c}' as category, '{level}' as level, '{d}' as finding" for p, c, level, d in A.RISKS)
_add(
    "code_security_audit", A.security_audit,
    f"""select c.file_path, c.language, c.start_line, coalesce(nullif(f.name, ''), '<module>') as function_name, r.category as risk_category, r.level as risk_level, r.finding, c.name as matched_pattern, c.peek as context
from code c join ({_RISK}) r on c.name = r.pattern or ends_with(c.name, '.' || r.pattern) or starts_with(c.name, r.pattern || '.') or contains(c.peek, r.pattern)
left join code f on f.file_path = c.file_path and f.node_id = c.scope_function and (f.semantic_type & 252) = 240 where (c.semantic_type & 252) = 208 and c.name <> ''""", False,
)
_add(
    "code_dead_code", A.dead_code,
    """select d.file_path, d.name, d.language, d.start_line, d.end_line, d.type, case when (d.semantic_type & 252) = 248 then 'class' else 'function' end as definition_type, 'Never referenced in codebase' as reason
from code d where ((d.semantic_type & 252) = 248 or ((d.semantic_type & 252) = 240 and not starts_with(d.name, '__') and d.name not in ('main', 'setup', 'teardown', 'init', 'constructor'))) and (d.flags & 1) = 0 and d.name <> ''
and d.name not in (select name from code where (semantic_type & 252) = 208 and name <> '') and d.name not in (
  select u.name from code u where (u.semantic_type & 252) in (80, 84, 88) and u.name <> '' and not exists (select 1 from code h where h.file_path = u.file_path and h.node_id = u.parent_id and (h.semantic_type & 252) in (240, 248)))""", False,
)
_CALLS = """select c.file_path, coalesce(f.name, '<module>') as caller_name, c.name as called_name, c.peek as call_expression, 'function' as call_type, c.language, c.start_line, c.node_id, c.scope_function as caller_node_id
from code c left join code f on f.file_path = c.file_path and f.node_id = c.scope_function and (f.semantic_type & 252) = 240 where (c.semantic_type & 252) = 208 and c.name <> ''"""
_add("code_get_calls", A.get_calls, _CALLS, False)
_add("code_call_graph", A.call_graph, f"select file_path, caller_name as caller, called_name as callee, call_type, count(*) as call_count from ({_CALLS}) group by all", False)
_add("code_exports", A.exports, _where("(a.flags & 6) = 6 and (a.flags & 16) <> 0 and coalesce(a.scope_current, 0) = 0"))
_IMPORT = "select * from code i where (semantic_type & 252) = 48 and (flags & 1) = 0 and descendant_count > 0 and name <> '' and not exists (select 1 from code p where p.file_path = i.file_path and p.node_id = i.parent_id and (p.semantic_type & 252) = 48)"
_add("code_imports", A.imports, f"select file_path, name as source_module, name as imported_name, type as import_type, start_line from ({_IMPORT})", False)
#: Scopes around each node, from inside out: its own frames are the module, the order and the inner function.
_FRAMES = """select file_path, node_id, scope_module as frame, 1 as hop from code where scope_module is not null
union all select n.file_path, n.node_id, coalesce(n.scope_class, case when n.depth = 2 then n.parent_id when n.depth = 3 then p.parent_id end), 2 from code n left join code p on p.file_path = n.file_path and p.node_id = n.parent_id where n.depth >= 2
union all select n.file_path, n.node_id, n.parent_id, 3 from code n join code p on p.file_path = n.file_path and p.node_id = n.parent_id where n.depth = 3 and (p.flags & 8) <> 0"""
_add(
    "code_resolve", lambda t: A.resolve(t).drop("def_qualified_name"),
    f"""select r.node_id as ref_node_id, r.name as ref_name, r.type as ref_type, r.start_line as ref_line, r.file_path, d.node_id as def_node_id, d.type as def_type, d.start_line as def_line, s.hop as scope_hops
from code r join ({_FRAMES}) s on s.file_path = r.file_path and s.node_id = r.node_id join code d on d.file_path = r.file_path and d.scope_current = s.frame and d.name = r.name and (d.flags & 6) = 6
where (r.flags & 6) = 2 and r.name <> '' qualify row_number() over (partition by r.file_path, r.node_id order by s.hop desc, d.node_id) = 1""", False,
)
_add(
    "code_callees", lambda t: A.callees(t).drop("caller_qualified"),
    """select f.name as caller, f.start_line as caller_line, c.file_path, c.name as callee, c.start_line as callee_line, c.peek as call_peek from code c join code f on f.file_path = c.file_path and f.node_id = c.scope_function
where (c.semantic_type & 252) = 208 and c.name <> '' and (f.semantic_type & 252) = 240 and f.name <> ''""", False,
)
_add(
    "code_callers", A.callers,
    """select coalesce(f.name, '<module>') as caller, coalesce(f.start_line, 0) as caller_line, c.name as callee, c.start_line as call_line, c.file_path from code c
left join code f on f.file_path = c.file_path and f.node_id = c.scope_function and (f.semantic_type & 252) = 240 where (c.semantic_type & 252) = 208 and c.name <> ''""", False,
)
_add(
    "code_find_references", lambda t: A.find_references(t, "v3"),
    f"""select * from (with uses as (
  select r.*, d.node_id as def_id from code r join ({_FRAMES}) s on s.file_path = r.file_path and s.node_id = r.node_id join code d on d.file_path = r.file_path and d.scope_current = s.frame and d.name = 'v3' and (d.flags & 6) = 6
  left join code p on p.file_path = r.file_path and p.node_id = r.parent_id where r.name = 'v3' and (r.flags & 6) = 2 and not coalesce((p.flags & 4) <> 0, false)
  qualify row_number() over (partition by r.file_path, r.node_id order by s.hop desc, d.node_id) = 1
)
select d.file_path, d.name, 'definition' as ref_kind, d.type as node_type, d.start_line, d.peek, coalesce(f.name, '<module>') as scope_name, d.node_id as def_node_id
from code d left join code f on f.file_path = d.file_path and f.node_id = d.scope_function where d.name = 'v3' and (d.flags & 6) = 6
union select u.file_path, u.name, case when (p.semantic_type & 252) = 208 then 'call' else 'reference' end, case when (p.semantic_type & 252) = 208 then p.type else u.type end,
  case when (p.semantic_type & 252) = 208 then p.start_line else u.start_line end, p.peek, coalesce(f.name, '<module>'), u.def_id
from uses u join code p on p.file_path = u.file_path and p.node_id = u.parent_id left join code f on f.file_path = u.file_path and f.node_id = u.scope_function)""", False,
)

# ---- selectors ----

SELECTORS = {
    "type": ("function", "starts_with(a.type, 'function')"),
    "name": ("#f3", "a.name = 'f3'"),
    "class": (".call#print", "a.name = 'print' and (a.semantic_type & 252) = 208 and (a.flags & 1) = 0"),
    "descendant": ("class_definition call", "a.type = 'call' and " + _ABOVE.format("d.type = 'class_definition'")),
    "chain": ("class_definition function_definition call", "a.type = 'call' and " + _ABOVE.format("d.type = 'function_definition' and exists (select 1 from code e where e.file_path = d.file_path and d.node_id > e.node_id and d.node_id <= e.node_id + e.descendant_count and e.type = 'class_definition')")),
    "child": ("if_statement > identifier", "a.type = 'identifier' and " + _PARENT.format("d.type = 'if_statement'")),
    "sibling": ("for_statement ~ return_statement", "a.type = 'return_statement' and " + _SIBLING.format("d.sibling_index < a.sibling_index and d.type = 'for_statement'")),
    "adjacent": ("assignment + call", "a.type = 'call' and " + _SIBLING.format("d.sibling_index = a.sibling_index - 1 and d.type = 'assignment'")),
    "has": ("function_definition:has(#eval)", "a.type = 'function_definition' and " + _BELOW.format("d.name = 'eval'")),
    "not_has": ("function_definition:not(:has(for_statement)):has(call)", "a.type = 'function_definition' and " + _BELOW.format("d.type = 'call'") + " and not " + _BELOW.format("d.type = 'for_statement'")),
    "attributes": ("call[name^=f][language=python]", "a.type = 'call' and starts_with(a.name, 'f') and a.language = 'python'"),
    "modifier": ("function_definition[modifier=static]:not(:exported)", "a.type = 'function_definition' and a.note = 'static' and (a.flags & 16) = 0"),
    "async": (":async:named", "a.note = 'async' and a.name <> ''"),
    "nth_child": ("call:nth-child(2)", "a.type = 'call' and a.sibling_index = 1"),
    "last_child": ("identifier:last-child", "a.type = 'identifier' and not " + _SIBLING.format("d.sibling_index > a.sibling_index")),
    "empty": (":empty:definition", "a.children_count = 0 and (a.flags & 6) = 6"),
    "root": (":root:scope", "a.depth = 0 and (a.flags & 8) <> 0"),
    "typed": ("function_definition:typed:not(:void)", "a.type = 'function_definition' and a.note = 'int'"),
    "calls": ("class_definition:calls(m5)", "a.type = 'class_definition' and " + _BELOW.format("d.name = 'm5' and (d.semantic_type & 252) = 208")),
    "called_by": ("call:called-by(m7)", "a.type = 'call' and exists (select 1 from code d where d.file_path = a.file_path and d.node_id = a.scope_function and d.name = 'm7')"),
    "is_called": ("function_definition:is-called", "a.type = 'function_definition' and exists (select 1 from code d where d.file_path = a.file_path and d.name = a.name and d.node_id <> a.node_id and (d.semantic_type & 252) = 208) and a.name <> ''"),
    "is_referenced": ("assignment:not(:is-referenced)", "a.type = 'assignment' and not exists (select 1 from code d where d.file_path = a.file_path and d.name = a.name and d.node_id <> a.node_id and (d.flags & 6) = 2)"),
    "scope_of": ("identifier:scope(class)", "a.type = 'identifier' and " + _ABOVE.format("starts_with(d.type, 'class')")),
    "precedes": ("call:precedes(return)", "a.type = 'call' and " + _SIBLING.format("d.sibling_index > a.sibling_index and starts_with(d.type, 'return')")),
    "follows": ("return:follows(assignment)", "a.type = 'return_statement' and " + _SIBLING.format("d.sibling_index < a.sibling_index and starts_with(d.type, 'assignment')")),
}
for _name, (_selector, _condition) in SELECTORS.items():
    _add(f"select_{_name}", (lambda s: lambda t: select_from(t, s, ordered=False))(_selector), _where(_condition))
_LED = "select {distinct} " + ", ".join(f"a.{c}" for c in PLAIN.split(", ")) + " from code m join code a on a.file_path = m.file_path and {on} where {m}"
for _element, _selector, _m, _on, _distinct in (
    ("parent", "call#eval::parent", "m.type = 'call' and m.name = 'eval'", "a.node_id = m.parent_id", ""),
    ("scope", "return_statement::scope", "m.type = 'return_statement'", "a.node_id = m.scope_current", ""),
    ("next_sibling", "assignment::next-sibling", "m.type = 'assignment'", "a.parent_id = m.parent_id and a.sibling_index = m.sibling_index + 1", ""),
    ("prev_sibling", "for_statement::previous-sibling", "m.type = 'for_statement'", "a.parent_id = m.parent_id and a.sibling_index = m.sibling_index - 1", ""),
    ("callees", "class_definition#C4::callees", "m.type = 'class_definition' and m.name = 'C4'", "a.node_id > m.node_id and a.node_id <= m.node_id + m.descendant_count and (a.semantic_type & 252) = 208 and a.name <> ''", "distinct"),
):
    _add(f"select_to_{_element}", (lambda s: lambda t: select_from(t, s, ordered=False))(_selector), _LED.format(distinct=_distinct, on=_on, m=_m))
_add(
    "select_to_callers", lambda t: select_from(t, "function_definition#f5::callers", ordered=False),
    "select distinct " + ", ".join(f"a.{c}" for c in PLAIN.split(", ")) + """ from code m join code c on c.file_path = m.file_path and c.name = m.name and c.node_id <> m.node_id and (c.semantic_type & 252) = 208
join code a on a.file_path = c.file_path and a.node_id = c.scope_function where m.type = 'function_definition' and m.name = 'f5'""",
)
_add(
    "select_to_parent_definition", lambda t: select_from(t, "identifier#v2::parent-definition", ordered=False),
    "select distinct * from (select " + ", ".join(f"a.{c}" for c in PLAIN.split(", ")) + """ from code m join code a on a.file_path = m.file_path and m.node_id > a.node_id and m.node_id <= a.node_id + a.descendant_count and (a.flags & 6) = 6 and a.name <> ''
where m.type = 'identifier' and m.name = 'v2' qualify row_number() over (partition by m.file_path, m.node_id order by a.depth desc) = 1)""",
)

# ---- scalars ----

_STRINGS = lambda names: "case {} " + " ".join(f"when {k} then '{n}'" for k, n in names) + " end"
_ST = "select cast(range as int) as st from range(256)"


def taxonomy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = spark.range(256).select(F.col("id").cast("int").alias("st"))
    name = X.semantic_type_to_string("st")
    rows = st.select("st", name.alias("name"), X.get_kind("st").alias("kind"), X.get_super_kind("st").alias("super_kind"), X.semantic_type_base("st").cast("int").alias("base"))
    return rows.select("*", X.semantic_type_code("name").cast("int").alias("code"), X.kind_code("kind").cast("int").alias("of_kind"), F.array_contains(X.get_searchable_types(), F.col("base").cast("short")).alias("searchable"))


QUERIES["taxonomy_names"] = taxonomy_names
ORACLE_SQL["taxonomy_names"] = f"""with s as ({_ST}) select st, {_STRINGS(enumerate(X.TYPES)).format('st >> 2')} as name, {_STRINGS(enumerate(X.KINDS)).format('st >> 4')} as kind, {_STRINGS(enumerate(X.SUPER_KINDS)).format('st >> 6')} as super_kind,
st & 252 as base, st & 252 as code, st & 240 as of_kind, (st & 252) in (240, 244, 248, 252, 208, 212, 80, 84, 48, 52, 64, 68, 144, 148, 160, 32) as searchable from s"""

# What each named predicate tests.
TESTS = {
    "is_function_definition": "(st & 252) = 240", "is_class_definition": "(st & 252) = 248", "is_variable_definition": "(st & 252) = 244", "is_module_definition": "(st & 252) = 252", "is_type_definition": "false",
    "is_function_call": "(st & 252) = 208", "is_member_access": "(st & 252) = 212", "is_string_literal": "(st & 252) = 68", "is_number_literal": "(st & 252) = 64", "is_boolean_literal": "false", "is_literal": "(st & 240) = 64",
    "is_conditional": "(st & 252) = 144", "is_loop": "(st & 252) = 148", "is_jump": "(st & 252) = 152", "is_block": "(st & 252) = 176", "is_list": "(st & 252) = 180", "is_assignment": "(st & 252) = 204",
    "is_comparison": "(st & 252) = 200", "is_arithmetic": "(st & 252) = 192", "is_logical": "(st & 252) = 196", "is_import": "(st & 252) = 48", "is_export": "(st & 252) = 52", "is_foreign": "(st & 252) = 56",
    "is_comment": "(st & 252) = 32", "is_annotation": "(st & 252) = 36", "is_directive": "(st & 252) = 40", "is_type_primitive": "(st & 252) = 112", "is_type_composite": "(st & 252) = 116",
    "is_type_reference": "(st & 252) = 120", "is_type_generic": "(st & 252) = 124",
}
QUERIES["taxonomy_predicates"] = lambda spark, sf_dir: spark.range(256).select(F.col("id").cast("int").alias("st")).select(
    "st", *(X.named_predicate(n, "st").alias(n) for n in TESTS), X.is_definition("st").alias("d"), X.is_call("st").alias("c"), X.is_control_flow("st").alias("f"), X.is_identifier("st").alias("i"), X.is_parser_specific("st").alias("p"),
    X.is_punctuation("st").alias("u"), X.is_kind("st", "LITERAL").alias("k"), X.is_kind("st", "NOTHING").alias("n"),
)
ORACLE_SQL["taxonomy_predicates"] = f"with s as ({_ST}) select st, " + ", ".join(f"{t} as {n}" for n, t in TESTS.items()) + ", (st & 240) = 240 as d, (st & 252) in (208, 136) as c, (st & 240) = 144 as f, (st & 252) in (80, 84, 88) as i, (st & 240) = 0 as p, (st & 252) in (4, 8) as u, (st & 240) = 64 as k, false as n from s"
# Aliases and what they test.
ALIASES = {"FN": "(st & 252) = 240", "STRUCT": "(st & 252) = 248", "COMPUTATION": "(st & 192) = 192", "ACCESS": "(st & 240) = 192", "COMP": "(st & 252) = 224", "BLOCK": "(st & 240) = 176", "VALUE": "(st & 240) = 64", "SELF": "(st & 252) = 88", "fn": "false", "FLOW_LOOP": "(st & 252) = 148"}
QUERIES["taxonomy_aliases"] = lambda spark, sf_dir: spark.range(256).select(F.col("id").cast("int").alias("st")).select("st", *(X.is_semantic_type("st", a).alias(f"a{k}") for k, a in enumerate(ALIASES)))
ORACLE_SQL["taxonomy_aliases"] = f"with s as ({_ST}) select st, " + ", ".join(f"{t} as a{k}" for k, t in enumerate(ALIASES.values())) + " from s"
QUERIES["taxonomy_flags"] = lambda spark, sf_dir: spark.range(64).select(F.col("id").cast("int").alias("b")).select(
    "b", X.is_syntax_only("b").alias("syntax"), X.is_construct("b").alias("construct"), X.is_name_definition("b").alias("defines"), X.is_name_declaration("b").alias("declares"), X.is_name_reference("b").alias("refers"),
    X.binds_name("b").alias("binds"), X.name_role("b").alias("role"), X.is_scope("b").alias("scope"), X.is_exported("b").alias("exported"), X.is_declaration_only("b").alias("only"), X.has_body("b").alias("body"), X.is_embodied("b").alias("embodied"),
)
ORACLE_SQL["taxonomy_flags"] = """with s as (select cast(range as int) as b from range(64)) select b, (b & 1) <> 0 as syntax, (b & 1) = 0 as construct, (b & 6) = 6 as defines, (b & 6) = 4 as declares, (b & 6) = 2 as refers, (b & 4) <> 0 as binds,
(b & 6) >> 1 as role, (b & 8) <> 0 as scope, (b & 16) <> 0 as exported, (b & 6) = 4 as only, (b & 6) = 6 as body, (b & 6) = 6 as embodied from s"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PATTERNS_SQL, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))


PATTERNS_SQL = """select n_nationkey as k, concat(case when n_nationkey % 4 = 3 then '' else '__' end, case when n_nationkey % 5 = 4 then lower(n_name) when n_nationkey % 7 = 6 then '' else replace(upper(n_name), ' ', '_') end, case when n_nationkey % 4 = 3 or n_nationkey % 7 = 6 then '' else '__' end) as word,
concat('%__<', case when n_nationkey % 6 = 5 then '' else replace(upper(n_name), ' ', '_') end, case n_nationkey % 6 when 0 then '*' when 1 then '+' when 2 then '?' when 3 then '**' when 4 then '~' else '' end, ' type=identifier min-children=', cast(n_nationkey as string), '>__%(x)') as wild from {nation}"""
QUERIES["pattern_scalars"] = lambda spark, sf_dir: _patterns(spark, sf_dir).withColumn("w", X.parse_html_wildcard("wild")).select(
    "k", X.is_pattern_wildcard("word").alias("is_wildcard"), X.wildcard_capture_name("word").alias("capture"), X.clean_pattern("wild").alias("cleaned"), X.pattern_has_variadic("wild").alias("variadic"), X.pattern_has_recursive("wild").alias("recursive"),
    "w.name", "w.variadic_star", "w.variadic_plus", "w.optional", "w.negate", F.col("w.recursive").alias("deep"), "w.type_constraint", "w.min_children", "w.max_children",
)
ORACLE_SQL["pattern_scalars"] = "with p as (" + PATTERNS_SQL.replace("{nation}", "nation").replace("as string)", "as varchar)") + """)
select k, (word = '__' or regexp_full_match(word, '__[A-Z][A-Z0-9_]*__')) as is_wildcard, case when regexp_full_match(word, '__[A-Z][A-Z0-9_]*__') then word[3:-3] end as capture,
regexp_replace(regexp_replace(wild, '%__<([A-Z_][A-Z0-9_]*)[^>]*>__%', '__\\1__', 'g'), '%__<[^>]+>__%', '__', 'g') as cleaned, k % 6 <> 5 as variadic, regexp_matches(wild, '%__<[A-Z_]*\\*\\*') as recursive, coalesce(nullif(regexp_extract(wild, '<([A-Z_][A-Z0-9_]*)', 1), ''), '_') as name,
k % 6 = 0 as variadic_star, k % 6 = 1 as variadic_plus, k % 6 = 2 as optional, k % 6 = 4 as negate, k % 6 = 3 as deep, 'identifier' as type_constraint, cast(k as int) as min_children, cast(null as int) as max_children from p"""
QUERIES["taxonomy_pattern_column"] = lambda spark, sf_dir: spark.range(256).crossJoin(spark.createDataFrame([(a,) for a in ("FN", "ACCESS", "VALUE", "FLOW_LOOP", "nothing", None)], "a string")).select(F.col("id").cast("int").alias("st"), F.coalesce("a", F.lit("null")).alias("a"), X.is_semantic_type(F.col("id"), F.col("a")).alias("is"))
ORACLE_SQL["taxonomy_pattern_column"] = f"with s as ({_ST}) select st, coalesce(a, 'null') as a, case a when 'FN' then (st & 252) = 240 when 'ACCESS' then (st & 240) = 192 when 'VALUE' then (st & 240) = 64 when 'FLOW_LOOP' then (st & 252) = 148 when 'nothing' then false end as is from s, (values ('FN'), ('ACCESS'), ('VALUE'), ('FLOW_LOOP'), ('nothing'), (null)) t(a)"
_LISTS = "select doc_id, text, array('license', cast(null as string), source, lang) as words from {documents}"
QUERIES["text_contains_column"] = lambda spark, sf_dir: spark.sql(_LISTS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", X.string_contains_any("text", F.col("words")).alias("found"), X.string_contains_any_i("text", F.col("words")).alias("found_i"), X.ast_peek_contains_any("text", F.col("words")).alias("peek"))
ORACLE_SQL["text_contains_column"] = """select doc_id, contains(text, 'license') or coalesce(contains(text, source), false) or coalesce(contains(text, lang), false) as found,
contains(lower(text), 'license') or coalesce(contains(lower(text), lower(source)), false) or coalesce(contains(lower(text), lower(lang)), false) as found_i, contains(text, 'license') or coalesce(contains(text, source), false) or coalesce(contains(text, lang), false) as peek from documents"""
QUERIES["qualified_names"] = lambda spark, sf_dir: code_tree(spark, sf_dir).select("file_path", "node_id", X.qualified_name_as_string("qualified_name").alias("qualified"), X.ast_capture(F.create_map(F.lit("X"), F.array("name", "type")), "X").alias("captured"))
ORACLE_SQL["qualified_names"] = CODE_SQL + "select file_path, node_id, case semantic_type when 240 then 'F[' || name || ']' when 244 then 'V[' || name || ']' when 248 then 'C[' || name || ']' when 252 then 'M[' || name || ']' end as qualified, name as captured from code"
