"""Navigation and structure of node tables.

Every operator works on many files at once: node numbers are unique within file_path only, and subtrees are the intervals
node_id .. node_id + descendant_count. As these intervals nest, containment needs no join: one running extreme over a
file's nodes in order answers it, so the cost is one shuffle and sort by (file_path, node_id), whatever the data hold.
Null names, repeated rows and empty tables are allowed; columns beyond those named are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X

def end() -> Column:
    """The last node number of the subtree."""
    return F.col("node_id") + F.col("descendant_count")


def _matches(type_: str | None, name: str | None) -> Column:
    """Nodes of the type and name given; None allows any."""
    found = F.lit(True) if type_ is None else F.col("type") == type_
    return found if name is None else found & F.coalesce(F.col("name") == name, F.lit(False))


#: Node numbers of one slice of a large file.
SLICE = 1 << 18


def _running(nodes: DataFrame, extreme, value: Column, into: str, back: bool = False, few_files: bool = False) -> DataFrame:  # noqa: ANN001
    """The least or greatest (extreme: F.min, F.max) of the values before each node of its file, or behind it if back.

    few_files: the files are few and large, so each is cut into slices of node numbers; what lies in the slices before comes from
    a table of one row for each slice."""
    order = F.desc if back else F.asc
    before = lambda by, key: Window.partitionBy(*by).orderBy(order(key)).rowsBetween(Window.unboundedPreceding, -1)
    if not few_files:
        return nodes.withColumn(into, extreme(value).over(before(["file_path"], "node_id")))
    key = ["file_path", "_slice"]
    cut = nodes.withColumn("_slice", F.floor(F.col("node_id") / SLICE))
    slices = cut.groupBy(*key).agg(extreme(value).alias("_own"))
    carried = slices.withColumn("_carried", extreme("_own").over(before(["file_path"], "_slice"))).select(*key, "_carried")
    found = cut.withColumn(into, extreme(value).over(before(key, "node_id"))).join(F.broadcast(carried), key, "left")
    own, other = F.col(into), F.col("_carried")
    nearer = own <= other if extreme is F.min else own >= other
    return found.withColumn(into, F.when(other.isNull() | nearer, own).otherwise(other)).select(*nodes.columns, into)


def holds(nodes: DataFrame, match: Column, into: str, few_files: bool = False) -> DataFrame:
    """Whether a matching node lies below: the next match in document order falls into the node's interval."""
    rows = _running(nodes, F.min, F.when(match, F.col("node_id")), into, True, few_files)
    return rows.withColumn(into, F.coalesce(F.col(into) <= end(), F.lit(False)))


def lies_in(nodes: DataFrame, match: Column, into: str, few_files: bool = False) -> DataFrame:
    """Whether a matching node lies above: the furthest end of the matches before is not yet passed."""
    rows = _running(nodes, F.max, F.when(match, end()), into, False, few_files)
    return rows.withColumn(into, F.coalesce(F.col(into) >= F.col("node_id"), F.lit(False)))


def enclosing(nodes: DataFrame, match: Column, held: DataFrame) -> DataFrame:
    """(file_path, node_id, holder_id): the nearest matching node around each node of held; nodes without one give no row.

    Matching nodes nest, so one is left where its end is passed: how many are open at a node is a running sum over where they
    open and close, and the nearest one around the node is the last that opened at that depth."""
    none = F.lit(None).cast("long")
    opens = nodes.filter(match).select("file_path", F.col("node_id").alias("_def"), end().alias("_end"))
    marks = opens.select("file_path", F.col("_def").alias("_at"), F.lit(1).alias("_order"), F.lit(1).alias("_step"), "_def", none.alias("_held"))
    marks = marks.union(opens.select("file_path", F.col("_end") + 1, F.lit(-1), F.lit(-1), none, none))
    marks = marks.union(held.select("file_path", "node_id", F.lit(0), F.lit(0), none, F.col("node_id")).distinct())
    run = Window.partitionBy("file_path").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    depth = Window.partitionBy("file_path", "_level").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    level = marks.withColumn("_level", F.sum("_step").over(run)).withColumn("_near", F.last("_def", ignorenulls=True).over(depth))
    return level.filter("_held is not null and _level > 0").select("file_path", F.col("_held").alias("node_id"), F.col("_near").alias("holder_id"))


def _only(nodes: DataFrame, *matches: Column) -> DataFrame:
    """The nodes that a question is about; all others are gone before its shuffle."""
    kept = F.lit(False)
    for m in matches:
        kept = kept | m
    return nodes.filter(kept)


def has(nodes: DataFrame, ancestor_type: str, descendant_type: str | None = None, descendant_name: str | None = None, few_files: bool = False) -> DataFrame:
    """Nodes of ancestor_type with a descendant of the type and name."""
    above, below = _matches(ancestor_type, None), _matches(descendant_type, descendant_name)
    return holds(_only(nodes, above, below), below, "_has", few_files).filter(F.col("_has") & above).drop("_has")


def not_has(nodes: DataFrame, ancestor_type: str, descendant_type: str | None = None, descendant_name: str | None = None, few_files: bool = False) -> DataFrame:
    """Nodes of ancestor_type without a descendant of the type and name."""
    above, below = _matches(ancestor_type, None), _matches(descendant_type, descendant_name)
    return holds(_only(nodes, above, below), below, "_has", few_files).filter(~F.col("_has") & above).drop("_has")


def inside(nodes: DataFrame, descendant_type: str, ancestor_type: str, ancestor_name: str | None = None, descendant_name: str | None = None, few_files: bool = False) -> DataFrame:
    """Nodes of descendant_type below a node of ancestor_type."""
    above, below = _matches(ancestor_type, ancestor_name), _matches(descendant_type, descendant_name)
    return lies_in(_only(nodes, above, below), above, "_in", few_files).filter(F.col("_in") & below).drop("_in")


def precedes(nodes: DataFrame, type_: str, before_type: str, before_name: str | None = None) -> DataFrame:
    """Nodes of the type with a later sibling of before_type."""
    last = F.max(F.when(_matches(before_type, before_name), F.col("sibling_index"))).over(Window.partitionBy("file_path", "parent_id"))
    return _only(nodes, _matches(type_, None), _matches(before_type, before_name)).filter("parent_id is not null").withColumn("_last", last).filter((F.col("sibling_index") < F.col("_last")) & _matches(type_, None)).drop("_last")


def follows(nodes: DataFrame, type_: str, after_type: str, after_name: str | None = None) -> DataFrame:
    """Nodes of the type with an earlier sibling of after_type."""
    first = F.min(F.when(_matches(after_type, after_name), F.col("sibling_index"))).over(Window.partitionBy("file_path", "parent_id"))
    return _only(nodes, _matches(type_, None), _matches(after_type, after_name)).filter("parent_id is not null").withColumn("_first", first).filter((F.col("sibling_index") > F.col("_first")) & _matches(type_, None)).drop("_first")


def children(nodes: DataFrame, node_id: int) -> DataFrame:
    """Direct children of the node of that number, in every file."""
    return nodes.filter(F.col("parent_id") == node_id)


def _of(nodes: DataFrame, node_id: int, *columns: str) -> DataFrame:
    """One row for each file: the interval and the columns of its node of that number."""
    return nodes.filter(F.col("node_id") == node_id).select(F.col("file_path").alias("_file"), end().alias("_end"), *(F.col(c).alias(f"_{c}") for c in columns))


def _joined(nodes: DataFrame, node_id: int, *columns: str, few_files: bool = False) -> DataFrame:
    root = _of(nodes, node_id, *columns)
    root = F.broadcast(root) if few_files else root
    return nodes.join(root, F.col("file_path") == F.col("_file"))


def descendants(nodes: DataFrame, node_id: int, few_files: bool = False) -> DataFrame:
    """The subtree below the node, without it."""
    return _joined(nodes.filter(F.col("node_id") >= node_id), node_id, few_files=few_files).filter((F.col("node_id") > node_id) & (F.col("node_id") <= F.col("_end"))).select(*nodes.columns)


def ancestors(nodes: DataFrame, node_id: int) -> DataFrame:
    """The path from the root to the node, which is included; no row where a file has no such node."""
    known = nodes.filter(F.col("node_id") == node_id).select("file_path").distinct()
    return nodes.filter((F.col("node_id") <= node_id) & (end() >= node_id)).join(known, "file_path", "left_semi").select(*nodes.columns)


def siblings(nodes: DataFrame, node_id: int, few_files: bool = False) -> DataFrame:
    """Nodes of the same parent, without the node; a root has none."""
    return _joined(nodes, node_id, "parent_id", few_files=few_files).filter((F.col("parent_id") == F.col("_parent_id")) & (F.col("node_id") != node_id)).select(*nodes.columns)


def own_scope(nodes: DataFrame, node_id: int, nested: Column | None = None, few_files: bool = False) -> DataFrame:
    """Descendants without the contents of nested functions; these functions themselves stay."""
    nested = X.is_name_definition("flags") & (X.semantic_type_base("semantic_type") == 240) if nested is None else nested
    return lies_in(descendants(nodes, node_id, few_files), nested, "_in", few_files).filter(~F.col("_in")).drop("_in")


def is_named() -> Column:
    return F.coalesce(F.col("name"), F.lit("")) != ""


def is_named_definition() -> Column:
    return X.is_definition("semantic_type") & X.is_construct("flags") & is_named()


def outermost(nodes: DataFrame, node_id: int, member: Column | None = None, few_files: bool = False) -> DataFrame:
    """Named definitions below the node that lie in no other one below it."""
    member = is_named_definition() if member is None else member
    return lies_in(descendants(nodes, node_id, few_files), member, "_in", few_files).filter(~F.col("_in") & member).drop("_in")


MEMBER = ("node_id", "descendant_count", "name", "type", "semantic_type", "start_line", "end_line", "depth", "parent_id", "peek", "file_path", "language")


def class_members(nodes: DataFrame, class_id: int) -> DataFrame:
    """The columns MEMBER of the definitions that lie directly in a class."""
    return outermost(nodes, class_id).select(*MEMBER)


def definition_parent(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Each named definition below the root with the nearest definition around it, over at most `most` other nodes."""
    found = nodes.filter(is_named_definition() & (F.col("depth") >= 1))
    pairs = enclosing(nodes, X.is_definition("semantic_type"), found)
    about = nodes.select("file_path", F.col("node_id").alias("holder_id"), F.col("name").alias("parent_def_name"), X.semantic_type_to_string("semantic_type").alias("parent_def_kind"), F.col("depth").alias("_depth"))
    whole = found.join(pairs, ["file_path", "node_id"]).join(about, ["file_path", "holder_id"]).filter(F.col("depth") - F.col("_depth") - 1 <= most)
    return whole.select("file_path", "node_id", F.col("name").alias("def_name"), X.semantic_type_to_string("semantic_type").alias("kind"), "parent_def_name", "parent_def_kind", F.col("holder_id").alias("parent_def_node_id"))


def containing_line(nodes: DataFrame, line: int) -> DataFrame:
    """Nodes whose lines hold the line, smallest first."""
    return nodes.filter((F.col("start_line") <= line) & (F.col("end_line") >= line)).orderBy(F.col("end_line") - F.col("start_line"), F.desc("depth"), "file_path", "node_id")


def in_range(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Nodes whose lines lie in first .. last."""
    return nodes.filter((F.col("start_line") >= first) & (F.col("end_line") <= last))


def call_arguments(nodes: DataFrame, call_id: int) -> DataFrame:
    """Children of the call's first argument list without punctuation, with arg_position from 0."""
    lists = nodes.filter((F.col("parent_id") == call_id) & F.col("type").isin("argument_list", "arguments", "call_arguments", "value_arguments"))
    first = lists.groupBy(F.col("file_path").alias("_file")).agg(F.min("node_id").alias("_list"))
    found = nodes.join(first, (F.col("file_path") == F.col("_file")) & (F.col("parent_id") == F.col("_list"))).filter(~F.col("type").isin("(", ")", ",", "[", "]", "{", "}"))
    return found.select(*nodes.columns, (F.row_number().over(Window.partitionBy("file_path").orderBy("node_id")) - 1).cast("long").alias("arg_position"))


def depth_profile(nodes: DataFrame, owner_type: str, few_files: bool = False) -> DataFrame:
    """Subtrees of owner_type that hold no other of it: nodes, deepest and mean relative depth; one running pass finds each node's owner."""
    owner = F.when(F.col("type") == owner_type, F.struct("node_id", "name", "depth", end().alias("end")))
    held = _running(nodes, F.max, owner, "_o", False, few_files).filter(F.col("node_id") <= F.col("_o.end")).select("file_path", "_o", (F.col("depth") - F.col("_o.depth")).alias("_d"))
    rows = held.groupBy("file_path", F.col("_o.node_id").alias("node_id"), F.col("_o.name").alias("name"))
    return rows.agg(F.count("*").alias("total_nodes"), F.max("_d").cast("long").alias("max_depth"), F.round(F.avg("_d"), 2).alias("avg_depth"))
