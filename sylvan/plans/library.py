"""Questions over an index of code: a table of files and one of nodes.

files: id, file_path, language, status (current, stale, deleted), line_count, size_bytes, updated_at. nodes: file_id and the
columns of node tables, with source_text. Definitions are told by their kind in the taxonomy. Only current files answer. A limit is part of the question
(the first so many in an order), and None asks for all. Names are compared without case where a term is searched for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X

# Node types by what the questions look for.
FUNCTIONS = ("function_definition", "method_definition")
FUNCTION_LIKE = (*FUNCTIONS, "function_declarator")
CLASSES = ("class_definition", "class_declaration", "struct_declaration", "interface_declaration")
VARIABLES = ("variable_declaration", "assignment", "const_declaration", "let_declaration", "var_declaration")
CALLS = ("call_expression", "function_call", "method_invocation", "call")
REFERENCES = ("identifier", "variable_name")
IMPORTS = ("import_statement", "import_from_statement", "import_declaration", "preproc_include", "include_statement")
CONTROL = ("if_statement", "for_statement", "while_statement", "switch_statement")
ENTRY_POINTS = ("main", "__init__", "__del__", "setup", "teardown")
HELP = [
    ("search", "search(term, type, language, limit)", "Symbols by likeness of name"),
    ("search", "find_exact(name, type)", "Symbols of a name"),
    ("search", "find_functions(term, limit)", "Function definitions"),
    ("search", "find_classes(term, limit)", "Class definitions"),
    ("search", "find_variables(term, limit)", "Variable definitions"),
    ("analysis", "complex_functions(least, limit)", "Large functions"),
    ("analysis", "file_complexity()", "Measures of files"),
    ("analysis", "hotspots(least, limit)", "Large functions that are called often"),
    ("analysis", "unused_functions()", "Functions that nothing calls"),
    ("navigation", "find_calls(name)", "Calls and the functions they lie in"),
    ("navigation", "find_references(name)", "All uses of a name"),
    ("navigation", "get_context(name, lines)", "What lies about a symbol"),
    ("imports", "find_imports(pattern)", "Import statements"),
    ("imports", "find_importers(module)", "Files that import a module"),
    ("imports", "coupled_files(least)", "Files with many imports"),
    ("structure", "file_structure(path)", "Outline of a file"),
    ("structure", "file_summary(path)", "Definitions and imports of a file"),
    ("utilities", "db_status(), db_stats(), languages()", "What the index holds"),
]


def _definition() -> Column:
    return X.is_definition("semantic_type")


def _named() -> Column:
    return F.coalesce(F.col("name"), F.lit("")) != ""


def _usage() -> Column:
    return F.when(_definition(), "DEFINITION").when(F.col("type").isin(*CALLS), "CALL").when(F.col("type").isin(*REFERENCES), "REFERENCE").otherwise("OTHER")


def _has(column: str | Column, term: str | None) -> Column:
    return F.lit(True) if term is None else F.lower(F.col(column) if isinstance(column, str) else column).contains(term.lower())


def _first(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def files_of(nodes: DataFrame) -> DataFrame:
    """A files table for a node table; the path is the id."""
    rows = nodes.groupBy("file_path").agg(F.max("language").alias("language"), F.max("end_line").alias("line_count"))
    return rows.select(F.col("file_path").alias("id"), "file_path", "language", F.lit("current").alias("status"), F.col("line_count").cast("long").alias("line_count"), F.lit(None).cast("long").alias("size_bytes"), F.current_timestamp().alias("updated_at"))


def index_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumnRenamed("file_path", "file_id").withColumnRenamed("peek", "source_text").drop("language")


class Library:
    def __init__(self, nodes: DataFrame, files: DataFrame, relationships: DataFrame | None = None) -> None:
        self.nodes, self.files, self.relationships = nodes, files, relationships
        #: Nodes of current files with their file's path and language.
        self.known = nodes.join(files.filter("status = 'current'").select(F.col("id").alias("file_id"), "file_path", "language", "line_count", "size_bytes", "updated_at"), "file_id")

    def info(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([("name", "sylvan library"), ("categories", ", ".join(dict.fromkeys(c for c, _, _ in HELP))), ("functions", str(len(HELP)))], "property string, value string")

    def help(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(HELP, "category string, function_signature string, description string").orderBy("category", "function_signature")

    def db_status(self) -> DataFrame:
        """Rows of each table; files by status, files that have nodes, kinds of relationships."""
        columns = ("table_name", "record_count", "current_files", "stale_files", "deleted_files")
        of = lambda s: F.count_if(F.col("status") == s)
        none = F.lit(None).cast("long")
        out = self.files.agg(F.count("*"), of("current"), of("stale"), of("deleted")).select(F.lit("files"), "*").toDF(*columns)
        out = out.union(self.nodes.agg(F.count("*"), F.countDistinct("file_id")).select(F.lit("nodes"), "*", none, none))
        if self.relationships is not None:
            out = out.union(self.relationships.agg(F.count("*"), F.countDistinct("relationship_type")).select(F.lit("relationships"), "*", none, none))
        return out

    def db_stats(self) -> DataFrame:
        return self.known.agg(
            F.countDistinct("file_path").alias("total_files"), F.countDistinct("language").alias("languages"), F.count("*").alias("total_nodes"), F.count_if(_definition()).alias("definitions"), F.count_if(F.col("type").isin(*FUNCTIONS)).alias("functions"),
            F.count_if(F.col("type").isin("class_definition", "struct_declaration")).alias("classes"), F.avg("descendant_count").alias("avg_complexity"), F.max("updated_at").alias("last_update"),
        )

    def search(self, term: str, type_: str | None = None, language: str | None = None, limit: int | None = 50) -> DataFrame:
        """Names like the term: 1 for equal, 0.9 for a prefix, 0.8 for a part, 0.7 for at most two changes."""
        low, distance = F.lower("name"), F.levenshtein("name", F.lit(term))
        score = F.when(low == term.lower(), 1.0).when(low.startswith(term.lower()), 0.9).when(low.contains(term.lower()), 0.8).when(distance <= 2, 0.7)
        found = self.known.filter(_named() & _has("type", type_) & (F.lit(True) if language is None else F.col("language") == language)).withColumn("similarity_score", score).filter("similarity_score is not null")
        rows = found.select("file_path", "language", "name", "type", _usage().alias("usage_type"), "start_line", "end_line", "descendant_count", "source_text", "similarity_score")
        return _first(rows, limit, F.desc("similarity_score"), "name", "file_path", "start_line")

    def find_exact(self, name: str, type_: str | None = None) -> DataFrame:
        rows = self.known.filter((F.col("name") == name) & _has("type", type_))
        return rows.select("file_path", "language", "name", "type", _usage().alias("usage_type"), "start_line", "end_line", "descendant_count", "source_text").orderBy("file_path", "start_line")

    def _defined(self, types: tuple[str, ...], term: str | None) -> DataFrame:
        return self.known.filter(F.col("type").isin(*types) & _definition() & _named() & _has("name", term))

    def find_functions(self, term: str | None = None, limit: int | None = 50) -> DataFrame:
        rows = self._defined(FUNCTION_LIKE, term).select("file_path", "language", F.col("name").alias("function_name"), "type", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("line_count"), "children_count", F.col("descendant_count").alias("complexity"), "source_text")
        return _first(rows, limit, "file_path", "start_line")

    def find_classes(self, term: str | None = None, limit: int | None = 50) -> DataFrame:
        rows = self._defined(CLASSES, term).select("file_path", "language", F.col("name").alias("class_name"), "type", "start_line", "end_line", F.col("children_count").alias("member_count"), F.col("descendant_count").alias("complexity"), "source_text")
        return _first(rows, limit, "file_path", "start_line")

    def find_variables(self, term: str | None = None, limit: int | None = 50) -> DataFrame:
        rows = self._defined(VARIABLES, term).select("file_path", "language", F.col("name").alias("variable_name"), "type", "start_line", "depth", "source_text")
        return _first(rows, limit, "file_path", "start_line")

    def complex_functions(self, least: int = 100, limit: int | None = 50) -> DataFrame:
        lines = F.col("end_line") - F.col("start_line") + 1
        rows = self._defined(FUNCTION_LIKE, None).filter(F.col("descendant_count") >= least)
        rows = rows.select("file_path", "language", F.col("name").alias("function_name"), "type", "start_line", "end_line", lines.alias("line_count"), "children_count", F.col("descendant_count").alias("total_nodes"), F.round(F.col("descendant_count") / lines, 2).alias("nodes_per_line"), "source_text")
        return _first(rows, limit, F.desc("total_nodes"), "file_path", "start_line")

    def file_complexity(self) -> DataFrame:
        function = F.col("type").isin(*FUNCTIONS)
        rows = self.known.groupBy("file_path", "language", "line_count", "size_bytes").agg(
            F.count("*").alias("total_nodes"), F.count_if(_definition()).alias("definitions"), F.count_if(function).alias("functions"), F.count_if(F.col("type").isin("class_definition", "struct_declaration", "interface_declaration")).alias("classes"),
            F.count_if(F.col("type").isin(*CONTROL)).alias("control_structures"), F.max("depth").alias("max_nesting_depth"), F.round(F.avg("depth"), 2).alias("avg_depth"), F.max("descendant_count").alias("max_function_complexity"),
            F.round(F.avg(F.when(function, F.col("descendant_count"))), 2).alias("avg_function_complexity"),
        )
        return rows.withColumn("nodes_per_line", F.round(F.col("total_nodes") / F.nullif("line_count", F.lit(0)), 2)).orderBy(F.desc("total_nodes"), "file_path")

    def hotspots(self, least: int = 100, limit: int | None = 25) -> DataFrame:
        """Calls are counted by name before they meet the functions."""
        calls = self.known.filter(F.col("type").isin(*CALLS)).groupBy("name").agg(F.count("*").alias("_calls"))
        rows = self._defined(FUNCTIONS, None).filter(F.col("descendant_count") >= least).join(calls, "name", "left").withColumn("call_count", F.coalesce("_calls", F.lit(0)))
        score = F.round(F.col("descendant_count") * 0.7 + F.col("call_count") * 0.3, 2).cast("double")
        rows = rows.select("file_path", "language", F.col("name").alias("function_name"), "start_line", "end_line", F.col("descendant_count").alias("complexity"), "call_count", score.alias("hotspot_score"), "source_text")
        return _first(rows, limit, F.desc("hotspot_score"), "file_path", "start_line")

    def find_calls(self, name: str) -> DataFrame:
        """Calls with the last function that begins before them and ends after them, by lines."""
        calls = self.known.filter(F.col("type").isin(*CALLS) & (F.col("name") == name)).select("file_path", F.col("name").alias("called_function"), "start_line", F.col("end_line").alias("_end"), F.col("type").alias("call_type"), "depth", F.col("source_text").alias("context"), F.monotonically_increasing_id().alias("_k"))
        owners = self.known.filter(F.col("type").isin(*FUNCTIONS) & _definition()).select("file_path", F.col("name").alias("_name"), F.col("start_line").alias("_from"), F.col("end_line").alias("_to"))
        inside = (calls["file_path"] == owners["file_path"]) & (F.col("_from") <= F.col("start_line")) & (F.col("_to") >= F.col("_end"))
        held = calls.join(owners, inside, "left").drop(owners["file_path"])
        rows = held.groupBy("file_path", "called_function", "start_line", "call_type", "depth", "context", "_k").agg(F.max_by("_name", "_from").alias("calling_function"))
        return rows.select("file_path", "called_function", "start_line", "call_type", "depth", "calling_function", "context").distinct().orderBy("file_path", "start_line")

    def find_references(self, name: str) -> DataFrame:
        rows = self.known.filter(F.col("name") == name).select("file_path", "language", F.col("name").alias("symbol"), F.col("type").alias("node_type"), "start_line", "end_line", "depth", _usage().alias("usage_type"), F.col("source_text").alias("context"))
        return rows.orderBy("file_path", "start_line")

    def get_context(self, name: str, lines: int = 5) -> DataFrame:
        """Named nodes that begin within so many lines of a symbol: the join is by file, which few symbols share."""
        at = self.known.filter(F.col("name") == name).select("file_path", F.col("name").alias("target_symbol"), F.col("start_line").alias("target_line"), F.col("end_line").alias("_to"), F.col("type").alias("target_type"))
        near = F.col("start_line").between(F.col("target_line") - lines, F.col("_to") + lines)
        rows = self.known.filter(_named()).join(at, "file_path").filter(near)
        rows = rows.select("file_path", "target_symbol", "target_line", "target_type", F.col("name").alias("context_symbol"), F.col("type").alias("context_type"), "start_line", "end_line", "depth", F.abs(F.col("start_line") - F.col("target_line")).alias("distance"), "source_text")
        return rows.orderBy("file_path", "target_line", "distance", "start_line")

    def find_imports(self, pattern: str | None = None) -> DataFrame:
        rows = self.known.filter(F.col("type").isin(*IMPORTS) & (F.lit(True) if pattern is None else F.col("file_path").like(pattern)))
        return rows.select("file_path", "language", F.col("name").alias("imported_symbol"), F.col("type").alias("import_type"), "start_line", F.col("source_text").alias("import_statement")).orderBy("file_path", "start_line")

    def find_importers(self, module: str) -> DataFrame:
        rows = self.known.filter(F.col("type").isin(*IMPORTS) & (F.coalesce(F.col("name") == module, F.lit(False)) | F.coalesce(_has("source_text", module), F.lit(False))))
        return rows.select("file_path", "language", F.col("name").alias("imported_symbol"), F.col("type").alias("import_type"), "start_line", "source_text").orderBy("file_path", "start_line")

    def file_structure(self, path: str) -> DataFrame:
        category = F.when(_definition(), "DEFINITION").when(X.is_kind("semantic_type", "EXECUTION"), "EXECUTION").when(X.is_control_flow("semantic_type"), "FLOW_CONTROL").otherwise("OTHER")
        rows = self.known.filter((F.col("file_path") == path) & (F.col("depth") <= 3) & _named() & (_definition() | F.col("type").isin("class_definition", "function_definition", "if_statement", "for_statement", "while_statement")))
        return rows.select("name", F.col("type").alias("node_type"), "start_line", "end_line", "depth", "children_count", "descendant_count", category.alias("semantic_category")).orderBy("depth", "start_line")

    def file_summary(self, path: str) -> DataFrame:
        imports = F.col("type").isin("import_statement", "import_from_statement", "include_statement")
        rows = self.known.filter((F.col("file_path") == path) & (F.col("depth") <= 2) & _named() & (_definition() | imports | (F.col("type") == "preproc_include")))
        return rows.select(F.col("type").alias("construct_type"), "name", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.when(_definition(), "DEFINITION").when(imports, "IMPORT").otherwise("OTHER").alias("category")).orderBy("start_line")

    def languages(self) -> DataFrame:
        return self.known.groupBy("language").agg(F.countDistinct("file_path").alias("file_count"), F.count("*").alias("total_nodes"), F.count_if(_definition()).alias("definitions")).orderBy(F.desc("file_count"), "language")

    def coupled_files(self, least: int = 6) -> DataFrame:
        rows = self.known.filter(F.col("type").isin(*IMPORTS)).groupBy("file_path", "language").agg(F.count("*").alias("import_count"))
        return rows.filter(F.col("import_count") >= least).orderBy(F.desc("import_count"), "file_path")

    def unused_functions(self) -> DataFrame:
        called = self.known.filter(F.col("type").isin(*CALLS) & F.col("name").isNotNull()).select("name").distinct()
        rows = self._defined(FUNCTIONS, None).filter(~F.col("name").isin(*ENTRY_POINTS)).join(called, "name", "left_anti")
        return rows.select("file_path", F.col("name").alias("function_name"), "start_line", "descendant_count").orderBy(F.desc("descendant_count"), "file_path", "start_line")


# ---- measures of node tables ----


def _lines() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def _function_like(nodes: DataFrame) -> DataFrame:
    return nodes.filter(_definition() & F.col("type").isin(*FUNCTION_LIKE))


def functions_of_file(nodes: DataFrame) -> DataFrame:
    return _function_like(nodes).select("file_path", "node_id", "name", "start_line", "end_line", _lines().alias("line_count"), "children_count", "descendant_count")


def summarize_functions(nodes: DataFrame) -> DataFrame:
    n = _lines()
    rows = _function_like(nodes).groupBy("file_path").agg(F.count("*").alias("function_count"), F.avg(n).alias("avg_lines"), F.max(n).alias("max_lines"), F.sum(n).alias("total_lines"), F.avg("descendant_count").alias("avg_complexity"))
    return rows.orderBy(F.desc("function_count"), "file_path")


def large_functions(nodes: DataFrame, min_lines: int, min_descendants: int) -> DataFrame:
    rows = _function_like(nodes).filter((_lines() >= min_lines) | (F.col("descendant_count") >= min_descendants))
    return rows.select("file_path", "name", "start_line", _lines().alias("line_count"), "descendant_count", F.round(F.col("descendant_count") / F.greatest(_lines(), F.lit(1)), 2).alias("density")).orderBy(F.desc("descendant_count"), "file_path", "start_line")


def analyze_classes(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter(_definition() & F.col("type").isin("class_declaration", "class_definition"))
    return rows.select("file_path", F.col("name").alias("class_name"), _lines().alias("line_count"), "descendant_count").orderBy(F.desc("descendant_count"), "file_path")


def get_imports(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter(F.col("type").isin("include_directive", *IMPORTS) & X.named_predicate("is_import", "semantic_type"))
    return rows.select("file_path", F.col("name").alias("import_name"), "type", "start_line").distinct().orderBy("file_path", "start_line")


def file_metrics(nodes: DataFrame) -> DataFrame:
    """Measures of each file, with its first five node types by name."""
    kind = lambda k: X.is_kind("semantic_type", k)
    rows = nodes.groupBy("file_path").agg(
        F.count("*").alias("total_nodes"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 2).alias("avg_depth"), F.countDistinct("type").alias("unique_node_types"), F.array_join(F.slice(F.sort_array(F.collect_set("type")), 1, 5), ", ").alias("example_types"),
        F.count_if(_definition()).alias("declarations"), F.count_if(kind("EXECUTION") | kind("FLOW_CONTROL")).alias("statements"), F.count_if(kind("COMPUTATION_NODE") | kind("OPERATOR")).alias("expressions"),
        F.count_if(F.col("type").isin(*FUNCTION_LIKE)).alias("functions"), F.count_if(F.col("type").isin("class_declaration", "class_definition")).alias("classes"),
    )
    return rows.orderBy("file_path")


def semantic_shares(nodes: DataFrame) -> DataFrame:
    """How many nodes of each kind a file has, and their share."""
    rows = nodes.groupBy("file_path", X.get_kind("semantic_type").alias("semantic_category")).agg(F.count("*").alias("node_count"))
    return rows.withColumn("percentage", F.round(100.0 * F.col("node_count") / F.sum("node_count").over(Window.partitionBy("file_path")), 2)).orderBy("file_path", F.desc("node_count"))


def find_todos(nodes: DataFrame) -> DataFrame:
    text = F.upper("peek")
    kind = F.lit("XXX")
    for word in ("HACK", "FIXME", "TODO"):
        kind = F.when(text.contains(word), word).otherwise(kind)
    return nodes.filter((F.col("type") == "comment") & text.rlike("TODO|FIXME|HACK|XXX")).select("file_path", "start_line", "peek", kind.alias("comment_type")).orderBy("file_path", "start_line")
