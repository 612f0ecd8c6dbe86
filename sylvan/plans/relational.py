"""A node table of the driver's tables: region > nation > customer > orders > lineitem, numbered as parsers number trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.plans.sizes import parts_for

#: Customers' keys of one slice.
SLICE = 1 << 14
LEVELS = ("region", "nation", "customer", "orders", "lineitem")

_KEYED = """
with line as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ln from {lineitem}
), keyed as (
  select r_regionkey as rk, cast(-1 as int) as nk, cast(-1 as bigint) as ck, cast(-1 as bigint) as ok, cast(-1 as int) as ln, 0 as depth, 'region' as type, r_name as name from {region}
  union all select n_regionkey, n_nationkey, cast(-1 as bigint), cast(-1 as bigint), -1, 1, 'nation', n_name from {nation}
  union all select n_regionkey, n_nationkey, c_custkey, cast(-1 as bigint), -1, 2, 'customer', c_name from {customer} join {nation} on c_nationkey = n_nationkey
  union all select n_regionkey, n_nationkey, c_custkey, o_orderkey, -1, 3, 'orders', o_orderstatus
    from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
  union all select n_regionkey, n_nationkey, c_custkey, o_orderkey, cast(ln as int), 4, 'lineitem', l_returnflag
    from line join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
), numbered as (
  select *, cast(row_number() over (partition by rk order by nk, ck, ok, ln) - 1 as bigint) as node_id from keyed
), sized as (
  select *,
    cast(case depth when 0 then count(*) over (partition by rk) when 1 then count(*) over (partition by rk, nk)
      when 2 then count(*) over (partition by rk, nk, ck) when 3 then count(*) over (partition by rk, nk, ck, ok) else 1 end - 1 as bigint) as descendant_count,
    case depth when 1 then min(node_id) over (partition by rk) when 2 then min(node_id) over (partition by rk, nk)
      when 3 then min(node_id) over (partition by rk, nk, ck) when 4 then min(node_id) over (partition by rk, nk, ck, ok) end as parent_id
  from numbered
)
select concat('region', cast(rk as string)) as file_path, node_id, type, name, depth, parent_id, descendant_count,
  cast(row_number() over (partition by rk, parent_id order by node_id) - 1 as bigint) as sibling_index
from sized
"""

#: The same for DuckDB, as a common table expression named tree.
TREE_SQL = "with tree as materialized (" + _KEYED.replace("{", "").replace("}", "").replace("as string)", "as varchar)") + ")\n"


#: Kilobytes of lineitem's files that one partition of the table stands for: about three hundred thousand nodes.
PART_KB = 4096


def relational_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, node_id, type, name, depth, parent_id, descendant_count, sibling_index); one file for each region.

    A region is far more than one task holds, so no window runs over it. Sizes are summed from line items upwards; a customer's number
    is the sum of the sizes before it, in slices of customers: sums of slices first, then within each. Orders and line items
    are numbered within their customer."""
    region, nation, customer, orders, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in LEVELS)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("name"))
    lines = lineitem.groupBy(F.col("l_orderkey").alias("ok")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["name"]).alias("marks"))
    none = F.array().cast("array<string>")
    order = orders.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), "o_orderstatus").join(lines, "ok", "left").withColumn("marks", F.coalesce("marks", none))
    dealt = order.repartition(parts_for(lineitem, PART_KB), "ck")
    # Within a customer: an order's number from the customer's, and the customer's size.
    by_customer = Window.partitionBy("ck")
    before = by_customer.orderBy("ok").rowsBetween(Window.unboundedPreceding, -1)
    size = 1 + F.size("marks").cast("long")
    dealt = dealt.withColumn("_from", 1 + F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("_place", (F.row_number().over(by_customer.orderBy("ok")) - 1).cast("long"))
    known = nation.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), "n_name")
    sizes = dealt.groupBy("ck").agg(F.sum(size).alias("_below"))
    clients = customer.select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk"), "c_name").join(F.broadcast(known.drop("n_name")), "nk").join(sizes, "ck", "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    clients = clients.withColumn("_slice", F.floor(F.col("ck") / SLICE))
    cut = ["rk", "nk", "_slice"]
    slices = clients.groupBy(*cut).agg(F.sum(1 + F.col("_below")).alias("_n"), F.count("*").alias("_k"))
    # A few rows for each nation: of slices, then of nations.
    ahead = Window.partitionBy("rk", "nk").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).withColumn("_places", F.coalesce(F.sum("_k").over(ahead), F.lit(0)))
    nations = known.join(slices.groupBy("rk", "nk").agg(F.sum("_n").alias("_n")), ["rk", "nk"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    first = Window.partitionBy("rk").orderBy("nk").rowsBetween(Window.unboundedPreceding, -1)
    regions = region.select(F.col("r_regionkey").alias("rk"), "r_name", F.lit(1).cast("long").alias("_root"))
    nations = nations.join(regions, "rk", "left").withColumn("_root", F.coalesce("_root", F.lit(0)))
    nations = nations.withColumn("node", F.col("_root") + F.coalesce(F.sum(1 + F.col("_n")).over(first), F.lit(0))).withColumn("_place", (F.row_number().over(Window.partitionBy("rk").orderBy("nk")) - 1).cast("long"))
    within = Window.partitionBy(*cut).orderBy("ck")
    clients = clients.join(F.broadcast(slices.select(*cut, "_before", "_places")), cut).join(F.broadcast(nations.select("rk", "nk", F.col("node").alias("_nation"))), ["rk", "nk"])
    clients = clients.withColumn("node", F.col("_nation") + 1 + F.col("_before") + F.coalesce(F.sum(1 + F.col("_below")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    clients = clients.withColumn("_place", F.col("_places") + F.row_number().over(within) - 1)

    # Customers and orders are kept, for plans that read the table twice and for other queries.
    clients = clients.persist()

    def rows(df: DataFrame, node, type_: str, name, depth: int, parent, below, place) -> DataFrame:  # noqa: ANN001
        return df.select(
            F.concat(F.lit("region"), F.col("rk").cast("string")).alias("file_path"), node.cast("long").alias("node_id"), F.lit(type_).alias("type"), name.alias("name"), F.lit(depth).alias("depth"),
            parent.cast("long").alias("parent_id"), below.cast("long").alias("descendant_count"), place.cast("long").alias("sibling_index"),
        )

    c, zero = F.col, F.lit(0)
    held = regions.join(nations.groupBy("rk").agg(F.sum(1 + F.col("_n")).alias("_n")), "rk", "left")
    out = rows(held, zero, "region", c("r_name"), 0, F.lit(None), F.coalesce("_n", zero), zero)
    out = out.union(rows(nations, c("node"), "nation", c("n_name"), 1, zero, c("_n"), c("_place")))
    out = out.union(rows(clients, c("node"), "customer", c("c_name"), 2, c("_nation"), c("_below"), c("_place")))
    of = dealt.join(clients.select("ck", "rk", c("node").alias("_customer")), "ck").withColumn("_order", c("_customer") + c("_from")).select("rk", "_customer", "_order", "o_orderstatus", "_place", "marks").persist()
    # An order and its line items come of one row: the order is item 0.
    items = of.select("rk", "_customer", "_order", "o_orderstatus", "_place", F.size("marks").alias("_m"), F.posexplode(F.concat(F.array("o_orderstatus"), "marks")).alias("_i", "name"))
    own = c("_i") == 0
    return out.union(
        items.select(
            F.concat(F.lit("region"), c("rk").cast("string")), c("_order") + c("_i"), F.when(own, "orders").otherwise("lineitem"), c("name"), F.when(own, 3).otherwise(4), F.when(own, c("_customer")).otherwise(c("_order")),
            F.when(own, c("_m")).otherwise(0).cast("long"), F.when(own, c("_place")).otherwise(c("_i") - 1).cast("long"),
        )
    )
