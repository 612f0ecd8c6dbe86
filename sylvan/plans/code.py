"""A node table in the shape of source code, made of the driver's tables: one file for each customer.

    module (customer) > class or function (order) > statement, call or inner function (line item) > identifier, call

Orders of status F are classes, whose line items are methods; other orders are functions. Names come from keys, so calls and
references meet definitions. DuckDB makes the table by the SQL text. Spark keeps one short row for each order, dealt by file, and writes
its nodes out where they are read: their numbers follow from those of the order, so no node is shuffled, sorted or kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.plans.sizes import keep_dealt, parts_for

TABLES = ("customer", "orders", "lineitem")
_TEXT = """
with line as (
  select l_orderkey as ok, l_partkey as part, l_suppkey as supp, l_returnflag as mark, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as ln from {lineitem}
), o as (
  select o_orderkey as ok, o_custkey as ck, o_orderkey % 37 as num, o_orderstatus = 'F' as is_class, case when substring(o_orderpriority, 1, 1) = '1' then 16 else 0 end as shown from {orders}
), item as (
  select o.ck, o.ok, line.ln, line.mark, o.is_class, line.part, line.supp, (o.is_class or line.ln = 4) as is_function from line join o on line.ok = o.ok
), part as (
  select c_custkey as ck, cast(-1 as bigint) as ok, -1 as ln, -1 as leaf, 0 as depth, 'module' as type, c_name as name, 252 as st, 8 as flags, false as is_class, false as is_function, '' as note from {customer}
  union all select ck, ok, -1, -1, 1, case when is_class then 'class_definition' else 'function_definition' end, concat(case when is_class then 'C' else 'f' end, cast(num as string)),
    case when is_class then 248 else 240 end, 14 + shown, is_class, false, case when num % 3 = 0 then 'int' else '' end from o
  union all select ck, ok, ln, -1, 2,
    case when is_function then 'function_definition' when ln = 1 then 'assignment' when ln = 2 then 'call' when ln = 3 then 'if_statement' when ln = 5 then 'for_statement' when ln = 6 then 'return_statement' else 'import_statement' end,
    case when is_function then concat('m', cast(part % 31 as string)) when ln = 1 then concat('v', cast(part % 7 as string))
      when ln = 2 then case part % 8 when 0 then 'eval' when 1 then 'print' when 2 then 'md5' else concat('f', cast(part % 31 as string)) end when ln = 7 then concat('lib', cast(part % 9 as string)) else '' end,
    case when is_function then 240 when ln = 1 then 244 when ln = 2 then 208 when ln = 3 then 144 when ln = 5 then 148 when ln = 6 then 152 else 48 end,
    case when is_function then 14 when ln = 1 then 6 when ln = 2 then 2 else 0 end, is_class, is_function, case when mark = 'A' then 'static' when mark = 'R' then 'async' else '' end from item
  union all select ck, ok, ln, 0, 3, 'identifier', concat('v', cast(supp % 7 as string)), 80, 2, is_class, is_function, '' from item
  union all select ck, ok, ln, 1, 3, 'call', concat(case when part % 2 = 0 then 'm' else 'f' end, cast(part % 31 as string)), 208, 2, is_class, is_function, '' from item where is_function
), numbered as (
  select *, cast(row_number() over (partition by ck order by ok, ln, leaf) - 1 as bigint) as node_id from part
), sized as (
  select *, min(node_id) over (partition by ck, ok) as order_id, min(node_id) over (partition by ck, ok, ln) as line_id,
    cast(case depth when 0 then count(*) over (partition by ck) when 1 then count(*) over (partition by ck, ok) when 2 then count(*) over (partition by ck, ok, ln) else 1 end - 1 as bigint) as descendant_count,
    cast(case depth when 0 then sum(case when depth = 1 then 1 else 0 end) over (partition by ck) when 1 then sum(case when depth = 2 then 1 else 0 end) over (partition by ck, ok)
      when 2 then sum(case when depth = 3 then 1 else 0 end) over (partition by ck, ok, ln) else 0 end as bigint) as children_count
  from numbered
), placed as (
  select *, case depth when 1 then cast(0 as bigint) when 2 then order_id when 3 then line_id end as parent_id from sized
)
select concat('customer', cast(ck as string)) as file_path, node_id, type, st as semantic_type, flags, name, depth, parent_id, descendant_count, children_count,
  cast(row_number() over (partition by ck, parent_id order by node_id) - 1 as bigint) as sibling_index,
  node_id + 1 as start_line, node_id + descendant_count + 1 as end_line, concat(type, ' ', name) as peek, case when ck % 4 = 0 then 'javascript' else 'python' end as language, note,
  case depth when 0 then cast(null as bigint) when 1 then cast(0 as bigint) when 2 then order_id else case when is_function then line_id else order_id end end as scope_current,
  case when depth = 2 and not is_class then order_id when depth = 3 and is_function then line_id when depth = 3 and not is_class then order_id end as scope_function,
  case when depth >= 2 and is_class then order_id end as scope_class, case when depth >= 1 then cast(0 as bigint) end as scope_module
from placed
"""
#: The same for DuckDB, as a common table expression named code.
CODE_SQL = "with code as materialized (" + _TEXT.replace("{", "").replace("}", "").replace("as string)", "as varchar)") + ")\n"


#: Kilobytes of lineitem's files that one partition of the table stands for: about half a million nodes.
PART_KB = 2048
#: All that a line item's names take from its part: a remainder of 7, 8, 9 or 31 is also one of this one's.
_PART_MOD = 7 * 8 * 9 * 31
#: From an order to its nodes, step by step: its line items, what they are, the nodes of each, their columns.
_STEPS = (
    ("*", "posexplode(parts) as (ln, part)"),
    (
        "*",
        "supps[ln] as supp",
        "marks[ln] as mark",
        "ln > 0 and (is_class or ln = 4) as is_function",
        "order_id + 1 + case when is_class then 3 * (ln - 1) else 2 * (ln - 1) + case when ln > 4 then 1 else 0 end end as line_id",
    ),
    ("*", "explode(case when ln = 0 then array(-1) when is_function then array(-1, 0, 1) else array(-1, 0) end) as leaf"),
    (
        "*",
        "case when ln = 0 then order_id else line_id + leaf + 1 end as node_id",
        "case when ln = 0 then top when leaf < 0 then 2 else 3 end as depth",
        "case when ln = 0 then case top when 0 then 'module' else case when is_class then 'class_definition' else 'function_definition' end end when leaf = 0 then 'identifier' when leaf = 1 then 'call' when is_function then 'function_definition' when ln = 1 then 'assignment' when ln = 2 then 'call' when ln = 3 then 'if_statement' when ln = 5 then 'for_statement' when ln = 6 then 'return_statement' else 'import_statement' end as type",
        "case when ln = 0 then case top when 0 then module else concat(case when is_class then 'C' else 'f' end, cast(num as string)) end when leaf = 0 then concat('v', cast(supp as string)) when leaf = 1 then concat(case when part % 2 = 0 then 'm' else 'f' end, cast(part % 31 as string)) when is_function then concat('m', cast(part % 31 as string)) when ln = 1 then concat('v', cast(part % 7 as string)) when ln = 2 then case part % 8 when 0 then 'eval' when 1 then 'print' when 2 then 'md5' else concat('f', cast(part % 31 as string)) end when ln = 7 then concat('lib', cast(part % 9 as string)) else '' end as name",
        "case when ln = 0 then case top when 0 then 252 else case when is_class then 248 else 240 end end when leaf = 0 then 80 when leaf = 1 then 208 when is_function then 240 when ln = 1 then 244 when ln = 2 then 208 when ln = 3 then 144 when ln = 5 then 148 when ln = 6 then 152 else 48 end as st",
        "case when ln = 0 then case top when 0 then 8 else 14 + shown end when leaf >= 0 then 2 when is_function then 14 when ln = 1 then 6 when ln = 2 then 2 else 0 end as flags",
        "case when ln = 0 then case when top = 1 and num % 3 = 0 then 'int' else '' end when leaf >= 0 then '' when mark = 1 then 'static' when mark = 2 then 'async' else '' end as note",
        "case when ln = 0 then case top when 1 then cast(0 as bigint) end when leaf < 0 then order_id else line_id end as parent_id",
        "case when ln = 0 then order_below when leaf >= 0 then cast(0 as bigint) when is_function then cast(2 as bigint) else cast(1 as bigint) end as descendant_count",
        "case when ln = 0 then order_children when leaf >= 0 then cast(0 as bigint) when is_function then cast(2 as bigint) else cast(1 as bigint) end as children_count",
        "case when ln = 0 then order_place when leaf < 0 then cast(ln - 1 as bigint) + case when order_id = 0 then 1 else 0 end else cast(leaf as bigint) end as sibling_index",
    ),
    (
        "file_path",
        "node_id",
        "type",
        "st as semantic_type",
        "flags",
        "name",
        "depth",
        "parent_id",
        "descendant_count",
        "children_count",
        "sibling_index",
        "node_id + 1 as start_line",
        "node_id + descendant_count + 1 as end_line",
        "concat(type, ' ', name) as peek",
        "case when ck % 4 = 0 then 'javascript' else 'python' end as language",
        "note",
        "case depth when 0 then cast(null as bigint) when 1 then cast(0 as bigint) when 2 then order_id else case when is_function then line_id else order_id end end as scope_current",
        "case when depth = 2 and not is_class then order_id when depth = 3 and is_function then line_id when depth = 3 and not is_class then order_id end as scope_function",
        "case when depth >= 2 and is_class then order_id end as scope_class",
        "case when depth >= 1 then cast(0 as bigint) end as scope_module",
    ),
)


def code_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each module (top 0) and order (top 1): its file, number and place, and what its line items are made of.

    The arrays begin with a null for the row's own node; a line item stands at its number. An order without its customer's row lies
    in a file without a module, whose first order is node 0: its line items and the later orders are then siblings."""
    customer, orders, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("mark"))
    lines = lineitem.groupBy(F.col("l_orderkey").alias("ok")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    array = lambda of, kind: F.concat(F.array(F.lit(None).cast(kind)), F.transform("x", of))
    lines = lines.select(
        "ok", array(lambda x: (x["l_partkey"] % _PART_MOD).cast("int"), "int").alias("parts"), array(lambda x: (x["l_suppkey"] % 7).cast("byte"), "byte").alias("supps"), array(lambda x: x["mark"].cast("byte"), "byte").alias("marks")
    )
    own = lambda c, kind: F.coalesce(c, F.array(F.lit(None).cast(kind)))
    above = orders.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), (F.col("o_orderkey") % 37).cast("byte").alias("num"), F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)).alias("is_class"), F.when(F.substring("o_orderpriority", 1, 1) == "1", 16).otherwise(0).alias("shown"))
    above = above.join(lines, "ok", "left").select("ck", "ok", F.lit(1).alias("top"), F.lit(None).cast("string").alias("module"), "num", "is_class", "shown", own("parts", "int").alias("parts"), own("supps", "byte").alias("supps"), own("marks", "byte").alias("marks"))
    none = lambda kind: F.array(F.lit(None).cast(kind))
    modules = customer.select(F.col("c_custkey").alias("ck"), F.lit(-1).cast("long").alias("ok"), F.lit(0).alias("top"), F.col("c_name").alias("module"), F.lit(None).cast("byte").alias("num"), F.lit(False).alias("is_class"), F.lit(0).alias("shown"), none("int").alias("parts"), none("byte").alias("supps"), none("byte").alias("marks"))
    count = F.size("parts").cast("long") - 1
    size = 1 + F.when(F.col("is_class"), 3 * count).otherwise(2 * count + F.when(count >= 4, 1).otherwise(0))
    rows = modules.unionByName(above).withColumn("file_path", F.concat(F.lit("customer"), F.col("ck").cast("string"))).repartition(parts_for(lineitem, PART_KB), "file_path")
    file = Window.partitionBy("file_path")
    order = file.orderBy("ok", "top")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_size", size).withColumn("order_id", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_place", F.coalesce(F.sum(F.lit(1) - F.col("top")).over(before), F.lit(0))).withColumn("_after", F.coalesce(F.sum("top").over(before), F.lit(0)))
    # Line items of an order that is node 0, before the orders after it.
    rows = rows.withColumn("_strays", F.coalesce(F.max(F.when((F.col("top") == 1) & (F.col("order_id") == 0), count)).over(before), F.lit(0)))
    rows = rows.withColumn("_all", F.sum("_size").over(whole)).withColumn("_orders", F.sum("top").over(whole))
    return rows.select(
        "file_path", "ck", "top", "module", "num", "is_class", "shown", "order_id", F.when(F.col("top") == 0, F.col("_all")).otherwise(F.col("_size")).alias("_n"), F.when(F.col("top") == 0, F.col("_orders")).otherwise(count).alias("order_children"),
        F.when(F.col("top") == 0, F.col("_place")).otherwise(F.col("_after") + F.col("_strays")).alias("order_place"), "parts", "supps", "marks",
    ).withColumn("order_below", F.col("_n") - 1).drop("_n")


def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain columns of the text, and scope, modifiers, parameters, signature_type, annotations and qualified_name; dealt by file_path."""
    # Only the orders are kept, for the plans that read the table several times and for other queries.
    keep_dealt(spark, lambda s: code_orders(s, sf_dir))
    rows = reduce(lambda df, step: df.selectExpr(*step), _STEPS, code_orders(spark, sf_dir))
    frame = lambda ident, kind: F.struct(ident.cast("long").alias("id"), kind.cast("short").alias("kind"))
    own = F.when(F.expr("flags & 8 <> 0"), frame(F.col("node_id"), F.col("semantic_type")))
    module = F.when(F.col("depth") >= 1, frame(F.lit(0), F.lit(252)))
    order = F.when(F.col("depth") >= 2, frame(F.coalesce("scope_class", F.when(F.col("depth") == 2, F.col("parent_id"))), F.when(F.col("scope_class").isNotNull(), 248).otherwise(240)))
    stack = F.when(own.isNotNull(), F.filter(F.array(module, order, own), lambda x: x.isNotNull()))
    scope = F.struct(F.col("scope_current").alias("current"), F.col("scope_function").alias("function"), F.col("scope_class").alias("class"), F.col("scope_module").alias("module"), stack.alias("stack"))
    none = F.array().cast("array<string>")
    modifier = F.when(F.col("note").isin("static", "async"), F.array("note")).otherwise(none)
    segment = F.struct(F.col("semantic_type").cast("short").alias("semantic_type"), F.col("name"), F.lit(1).alias("index"))
    return rows.select(
        "*", scope.alias("scope"), modifier.alias("modifiers"), F.array().cast("array<struct<name:string,type:string>>").alias("parameters"), F.when(F.col("note") == "int", "int").alias("signature_type"),
        F.lit(None).cast("string").alias("annotations"), F.when(F.col("semantic_type") >= 240, F.array(segment)).alias("qualified_name"),
    )


PLAIN = "file_path, node_id, type, name, depth, parent_id, descendant_count, sibling_index"
