"""Code analysis over node tables of any number of files.

Parsers note each node's nearest function in scope.function, so what lies in a function, without the contents of nested ones, is an
equality on (file_path, scope.function) that aggregates before the shuffle; no range join is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X

AT = ("file_path", "_func")


def _named() -> Column:
    return F.coalesce(F.col("name"), F.lit("")) != ""


def _base(kind: str) -> Column:
    return X.bits("semantic_type", 0xFC) == X.CODES[kind]


def _function() -> Column:
    return _base("DEFINITION_FUNCTION") & X.is_construct("flags")


def _ends(*tails: str) -> Column:
    out = F.lit(False)
    for tail in tails:
        out = out | F.col("type").endswith(tail)
    return out


def functions(nodes: DataFrame) -> DataFrame:
    """Named functions; _func is their node."""
    return nodes.filter(_function() & _named()).withColumn("_func", F.col("node_id"))


def _owned(nodes: DataFrame) -> DataFrame:
    return nodes.filter("scope.function is not null").withColumn("_func", F.col("scope.function"))


def definitions(nodes: DataFrame) -> DataFrame:
    """Named constructs with what they define."""
    kinds = {"function": "DEFINITION_FUNCTION", "class": "DEFINITION_CLASS", "variable": "DEFINITION_VARIABLE", "module": "DEFINITION_MODULE"}
    kind = F.lit("other")
    for name, code in kinds.items():
        kind = F.when(_base(code), name).otherwise(kind)
    found = nodes.filter(X.is_definition("semantic_type") & X.is_construct("flags") & _named())
    return found.select("name", kind.alias("definition_type"), "language", "file_path", "start_line", "end_line", "node_id", "type", "semantic_type")


def function_metrics(nodes: DataFrame) -> DataFrame:
    """Lines, returns, conditionals, loops, cyclomatic complexity and depth of each function's own scope."""
    conditional = _base("FLOW_CONDITIONAL") & _ends("_statement", "_clause", "_expression", "_arm", "_case", "_branch")
    loop = _base("FLOW_LOOP") & _ends("_statement", "_expression", "_loop")
    counts = _owned(nodes).groupBy(*AT).agg(F.count_if(F.col("type") == "return_statement").alias("r"), F.count_if(conditional).alias("c"), F.count_if(loop).alias("l"), F.max("depth").alias("d"))
    r, c, n = (F.coalesce(x, F.lit(0)) for x in ("r", "c", "l"))
    return functions(nodes).join(counts, list(AT), "left").select(
        "file_path", "name", "language", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), r.alias("return_count"), c.alias("conditionals"), n.alias("loops"),
        (c + n + 1).alias("cyclomatic"), F.coalesce(F.col("d") - F.col("depth"), F.lit(0)).alias("max_depth"),
    )


def functions_containing(nodes: DataFrame, target_type: str) -> DataFrame:
    """Functions whose own scope holds a node of the type."""
    return functions(nodes).join(_owned(nodes.filter(F.col("type") == target_type)).select(*AT), list(AT), "left_semi").select("file_path", "name", "language", "start_line", "end_line")


def nesting_analysis(nodes: DataFrame) -> DataFrame:
    """Deepest, mean and deep (over 5) relative depths of each function's own scope.

    Nodes are counted by function and depth before they meet their function, so the join sees few rows of each."""
    counts = _owned(nodes).groupBy(*AT, F.col("depth").alias("_depth")).agg(F.count("*").alias("_n"))
    own = functions(nodes).join(counts, list(AT)).withColumn("_d", F.col("_depth") - F.col("depth"))
    rows = own.groupBy(*AT, "name", "language", "start_line", "end_line")
    return rows.agg(
        F.max("_d").alias("max_depth"), F.round(F.sum(F.col("_d") * F.col("_n")) / F.sum("_n"), 2).alias("avg_depth"), F.sum(F.when(F.col("_d") > 5, F.col("_n")).otherwise(0)).alias("deep_nodes"), F.sum("_n").alias("total_nodes")
    ).drop("_func")


def _calls(nodes: DataFrame) -> DataFrame:
    return nodes.filter((X.bits("semantic_type", 0xFC) == X.CODES["COMPUTATION_CALL"]) & _named())


def _with_caller(calls: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    callers = nodes.filter(_function()).select("file_path", F.col("node_id").alias("_func"), F.col("name").alias("_caller"), F.col("start_line").alias("_line"), F.col("qualified_name").alias("_qualified"))
    return calls.withColumn("_func", F.col("scope.function")).join(callers, list(AT), how)


# Node types by the kind of call they make.
CONSTRUCTORS = ("new_expression", "object_creation_expression", "constructor_invocation", "init_expression", "composite_literal", "struct_expression")
METHODS = ("attribute", "member_expression", "field_expression", "selector_expression", "navigation_expression", "field_access")


def get_calls(nodes: DataFrame) -> DataFrame:
    """Call sites with their caller (<module> outside functions) and the kind of call."""
    target = nodes.filter("sibling_index = 0 and parent_id is not null").select("file_path", F.col("parent_id").alias("node_id"), F.col("type").alias("_target"))
    kind = F.when(F.col("type").isin(*CONSTRUCTORS), "constructor").when(F.col("type") == "macro_invocation", "macro").when(F.col("_target").isin(*METHODS), "method").otherwise("function")
    calls = _with_caller(_calls(nodes), nodes, "left").join(target, ["file_path", "node_id"], "left")
    return calls.select(
        "file_path", F.coalesce("_caller", F.lit("<module>")).alias("caller_name"), F.col("name").alias("called_name"), F.col("peek").alias("call_expression"), kind.alias("call_type"),
        "language", "start_line", "node_id", F.col("_func").alias("caller_node_id"),
    )


def call_graph(nodes: DataFrame) -> DataFrame:
    edges = get_calls(nodes).groupBy("file_path", F.col("caller_name").alias("caller"), F.col("called_name").alias("callee"), "call_type")
    return edges.agg(F.count("*").alias("call_count"))


def callees(nodes: DataFrame) -> DataFrame:
    found = _with_caller(_calls(nodes), nodes, "inner").filter("_caller <> ''")
    return found.select(F.col("_caller").alias("caller"), F.col("_qualified").alias("caller_qualified"), F.col("_line").alias("caller_line"), "file_path", F.col("name").alias("callee"), F.col("start_line").alias("callee_line"), F.col("peek").alias("call_peek"))


def callers(nodes: DataFrame) -> DataFrame:
    found = _with_caller(_calls(nodes), nodes, "left")
    return found.select(F.coalesce("_caller", F.lit("<module>")).alias("caller"), F.coalesce("_line", F.lit(0)).alias("caller_line"), F.col("name").alias("callee"), F.col("start_line").alias("call_line"), "file_path")


def dead_code(nodes: DataFrame) -> DataFrame:
    """Functions and classes whose name no call and no identifier outside a definition's head uses, in any file."""
    base = X.bits("semantic_type", 0xFC)
    function = (base == X.CODES["DEFINITION_FUNCTION"]) & ~F.col("name").startswith("__") & ~F.col("name").isin("main", "setup", "teardown", "init", "constructor")
    found = nodes.filter((function | (base == X.CODES["DEFINITION_CLASS"])) & _named() & X.is_construct("flags"))
    heads = nodes.filter(base.isin(X.CODES["DEFINITION_FUNCTION"], X.CODES["DEFINITION_CLASS"])).select("file_path", F.col("node_id").alias("parent_id"))
    uses = nodes.filter(X.is_identifier("semantic_type") & _named()).join(heads, ["file_path", "parent_id"], "left_anti").select("name")
    used = _calls(nodes).select("name").unionByName(uses).distinct()
    kind = F.when(base == X.CODES["DEFINITION_CLASS"], "class").otherwise("function")
    return found.join(used, "name", "left_anti").select("file_path", "name", "language", "start_line", "end_line", "type", kind.alias("definition_type"), F.lit("Never referenced in codebase").alias("reason"))


def exports(nodes: DataFrame) -> DataFrame:
    """Visible definitions outside every scope but the module's."""
    return nodes.filter(X.is_name_definition("flags") & X.is_exported("flags") & (F.coalesce(F.col("scope.current"), F.lit(0)) == 0))


def resolve(nodes: DataFrame) -> DataFrame:
    """Each reference with the definition of its name in the innermost enclosing scope that has one; scope_hops counts from outside."""
    scopes = nodes.filter(X.is_scope("flags")).select("file_path", F.col("node_id").alias("_scope"), F.col("scope.stack").alias("_stack"))
    refs = nodes.filter(X.is_name_reference("flags") & _named()).withColumn("_scope", F.col("scope.current")).join(scopes, ["file_path", "_scope"])
    search = refs.select("file_path", F.col("node_id").alias("ref_node_id"), F.col("name").alias("ref_name"), F.col("type").alias("ref_type"), F.col("start_line").alias("ref_line"), F.posexplode("_stack").alias("_hop", "_frame"))
    defs = nodes.filter(X.is_name_definition("flags")).select("file_path", F.col("scope.current").alias("_in"), F.col("name").alias("ref_name"), F.col("node_id").alias("def_node_id"), F.col("type").alias("def_type"), F.col("start_line").alias("def_line"), F.col("qualified_name").alias("def_qualified_name"))
    found = search.withColumn("_in", F.col("_frame.id")).join(defs, ["file_path", "_in", "ref_name"]).withColumn("scope_hops", F.col("_hop") + 1)
    best = Window.partitionBy("file_path", "ref_node_id").orderBy(F.desc("scope_hops"), "def_node_id")
    return found.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("ref_node_id", "ref_name", "ref_type", "ref_line", "file_path", "def_node_id", "def_type", "def_line", "def_qualified_name", "scope_hops")


# Call names, what they risk, how much, and what is told of it.
RISKS = [
    ("eval", "Code Injection", "high", "Dynamic code evaluation"),
    ("exec", "Code Injection", "high", "Dynamic code execution"),
    ("compile", "Code Injection", "high", "Dynamic code compilation"),
    ("Function", "Code Injection", "high", "Dynamic function creation"),
    ("setInterval", "Code Injection", "medium", "Potential code injection via string"),
    ("setTimeout", "Code Injection", "medium", "Potential code injection via string"),
    ("system", "Command Injection", "high", "Shell command execution"),
    ("popen", "Command Injection", "high", "Shell command execution"),
    ("spawn", "Command Injection", "high", "Process spawning"),
    ("execSync", "Command Injection", "high", "Synchronous command execution"),
    ("execFile", "Command Injection", "high", "File execution"),
    ("ShellExecute", "Command Injection", "high", "Windows shell execution"),
    ("pickle.load", "Deserialization", "high", "Unsafe pickle deserialization"),
    ("pickle.loads", "Deserialization", "high", "Unsafe pickle deserialization"),
    ("yaml.load", "Deserialization", "high", "Unsafe YAML loading"),
    ("unserialize", "Deserialization", "high", "PHP unsafe deserialization"),
    ("Marshal.load", "Deserialization", "high", "Ruby unsafe deserialization"),
    ("readObject", "Deserialization", "medium", "Java deserialization"),
    ("execute", "SQL Injection", "medium", "SQL execution - verify parameterized"),
    ("executemany", "SQL Injection", "medium", "SQL execution - verify parameterized"),
    ("raw", "SQL Injection", "medium", "Raw SQL query"),
    ("rawQuery", "SQL Injection", "medium", "Raw SQL query"),
    ("readFile", "Path Traversal", "medium", "File read - verify path sanitization"),
    ("writeFile", "Path Traversal", "medium", "File write - verify path sanitization"),
    ("unlink", "Path Traversal", "medium", "File deletion - verify path sanitization"),
    ("rmdir", "Path Traversal", "medium", "Directory deletion - verify path"),
    ("md5", "Weak Crypto", "medium", "MD5 is cryptographically weak"),
    ("sha1", "Weak Crypto", "medium", "SHA1 is cryptographically weak"),
    ("DES", "Weak Crypto", "medium", "DES encryption is weak"),
    ("RC4", "Weak Crypto", "medium", "RC4 encryption is weak"),
    ("console.log", "Debug Code", "low", "Debug logging in code"),
    ("print", "Debug Code", "low", "Print statement - may leak info"),
    ("debugger", "Debug Code", "low", "Debugger statement"),
    ("assert", "Debug Code", "low", "Assert statement"),
]


def security_audit(nodes: DataFrame) -> DataFrame:
    """Calls whose name is, ends in or begins with a risky one, or whose text holds it: one row for each call and risk.

    The risks are literals of the plan: a call is tested against them where it lies, without a join."""
    risks = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("pattern", "category", "level", "finding"), r, strict=True))) for r in RISKS))
    name, peek = F.col("name"), F.coalesce(F.col("peek"), F.lit(""))

    def fits(r: Column) -> Column:
        p = r["pattern"]
        return (name == p) | name.endswith(F.concat(F.lit("."), p)) | name.startswith(F.concat(p, F.lit("."))) | F.contains(peek, p)

    found = _with_caller(_calls(nodes), nodes, "left").withColumn("_r", F.explode(F.filter(risks, fits)))
    rows = found.select(
        "file_path", "language", "start_line", F.when(F.coalesce("_caller", F.lit("")) != "", F.col("_caller")).otherwise("<module>").alias("function_name"), F.col("_r.category").alias("risk_category"),
        F.col("_r.level").alias("risk_level"), F.col("_r.finding").alias("finding"), name.alias("matched_pattern"), F.col("peek").alias("context"),
    )
    return rows.orderBy(F.when(F.col("risk_level") == "high", 1).when(F.col("risk_level") == "medium", 2).otherwise(3), "file_path", "start_line")


# Node types that name what an import brings in.
SPECIFIERS = ("import_specifier", "import_default_specifier", "namespace_import", "aliased_import", "import_spec")


def imports(nodes: DataFrame) -> DataFrame:
    """What each import statement brings in: names behind a from-import's keyword, specifiers and aliases, default imports,
    the last name of a scoped path, the names of a use list, else the module itself. Joins are equalities on parents; what
    lies anywhere in a statement is found by the last statement that began before it."""
    columns = ("file_path", "source_module", "imported_name", "import_type", "start_line")
    base = X.bits("semantic_type", 0xFC) == X.CODES["EXTERNAL_IMPORT"]
    inner = nodes.filter(base).select("file_path", F.col("node_id").alias("parent_id"))
    stated = nodes.filter(base & X.is_construct("flags") & (F.col("descendant_count") > 0) & _named()).join(inner, ["file_path", "parent_id"], "left_anti")
    i = stated.select("file_path", F.col("node_id").alias("_import"), F.col("name").alias("source_module"), F.col("type").alias("import_type"), F.col("start_line").alias("start_line"), (F.col("node_id") + F.col("descendant_count")).alias("_end"))
    other = F.col("import_type") != "import_from_statement"
    child = nodes.select("file_path", F.col("parent_id").alias("_parent"), "node_id", "type", "name")
    of = lambda key: child.withColumnRenamed("_parent", key)
    under = i.join(of("_import"), ["file_path", "_import"])
    first = F.min(F.when(F.col("type").isin("import", "use"), F.col("node_id"))).over(Window.partitionBy("file_path", "_import"))
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    out = lambda df: df.select("file_path", "source_module", F.col("name").alias("imported_name"), "import_type", "start_line")
    from_names = out(under.withColumn("_keyword", first).filter(~other & named & F.col("type").isin("dotted_name", "identifier") & (F.col("node_id") > F.col("_keyword"))))
    # Specifiers and use lists lie anywhere below: statements do not nest, so the last one before decides.
    deep = i.select("file_path", F.col("_import").alias("_at"), F.struct("_import", "source_module", "import_type", "start_line", "_end").alias("_i"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("name"))
    deep = deep.union(nodes.filter(F.col("type").isin(*SPECIFIERS, "use_list")).select("file_path", "node_id", F.lit(None), "type", "name"))
    last = F.last("_i", ignorenulls=True).over(Window.partitionBy("file_path").orderBy("_at", F.col("_i").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    below = deep.withColumn("_l", last).filter("type is not null and _at <= _l._end").select("file_path", F.col("_at").alias("_node"), "type", "name", "_l.source_module", "_l.import_type", "_l.start_line").filter(other)
    specifiers = out(below.filter(named & (F.col("type") != "use_list")))
    lists = out(below.filter("type = 'use_list'").drop("type", "name").join(of("_node"), ["file_path", "_node"]).filter(named & (F.col("type") == "identifier")))
    clause = under.filter(other & (F.col("type") == "import_clause")).select("file_path", "source_module", "import_type", "start_line", F.col("node_id").alias("_clause"))
    defaults = out(clause.join(of("_clause"), ["file_path", "_clause"]).filter(named & (F.col("type") == "identifier")))
    scoped = under.filter(other & (F.col("type") == "scoped_identifier")).select("file_path", "source_module", "import_type", "start_line", F.col("node_id").alias("_path")).join(of("_path"), ["file_path", "_path"]).filter("type = 'identifier'")
    tail = F.max("node_id").over(Window.partitionBy("file_path", "_path"))
    paths = out(scoped.withColumn("_last", tail).filter((F.col("node_id") == F.col("_last")) & named))
    bare = i.select("file_path", "source_module", F.col("source_module").alias("imported_name"), "import_type", "start_line")
    # A default import counts where its line has no specifiers, the module itself where it has nothing else. What a line has is seen in
    # one pass, so no part is made twice.
    every = reduce(DataFrame.union, (df.withColumn("_rank", F.lit(rank)) for df, rank in ((from_names, 0), (paths, 0), (lists, 0), (specifiers, 1), (defaults, 2), (bare, 3))))
    line = Window.partitionBy("file_path", "start_line")
    has = lambda *ranks: F.max(F.col("_rank").isin(*ranks)).over(line) & F.col("file_path").isNotNull() & F.col("start_line").isNotNull()
    rank = F.col("_rank")
    seen = every.withColumn("_out", F.when(rank == 2, has(1)).when(rank == 3, has(0, 1, 2)).otherwise(F.lit(False)))
    return seen.filter(~F.col("_out")).select(*columns).orderBy("file_path", "start_line", "imported_name")


def find_references(nodes: DataFrame, name: str) -> DataFrame:
    """Where a name is defined and used: each use goes to the definition in the innermost enclosing scope that has one; a use
    that is what a call calls is told as the call. Rows of equal columns are one."""
    nodes = nodes.withColumn("_f", F.col("scope.function"))
    holder = nodes.filter(_named() | _function()).select("file_path", F.col("node_id").alias("_f"), F.col("name").alias("_in"))
    scope_name = F.coalesce("_in", F.lit("<module>")).alias("scope_name")
    columns = ("file_path", "name", "ref_kind", "node_type", "start_line", "peek", "scope_name", "def_node_id")
    own = nodes.filter(F.col("name") == name)
    defs = own.filter(X.is_name_definition("flags"))
    sites = defs.join(holder, ["file_path", "_f"], "left").select("file_path", "name", F.lit("definition").alias("ref_kind"), F.col("type").alias("node_type"), "start_line", "peek", scope_name, F.col("node_id").alias("def_node_id"))
    scopes = nodes.filter("scope.stack is not null").select("file_path", F.col("node_id").alias("_scope"), F.col("scope.stack").alias("_stack"))
    parents = nodes.select("file_path", F.col("node_id").alias("parent_id"), F.col("flags").alias("_flags"), F.col("semantic_type").alias("_st"), F.col("type").alias("_type"), F.col("start_line").alias("_line"), F.col("peek").alias("_peek"))
    refs = own.filter(X.is_name_reference("flags")).withColumn("_scope", F.col("scope.current")).join(scopes, ["file_path", "_scope"]).join(parents, ["file_path", "parent_id"], "left")
    refs = refs.filter(~F.coalesce(X.binds_name("_flags"), F.lit(False)))
    spread = refs.select("*", F.posexplode("_stack").alias("_hop", "_frame")).withColumn("_within", F.col("_frame.id"))
    near = spread.join(defs.select("file_path", F.col("scope.current").alias("_within"), F.col("node_id").alias("def_node_id")), ["file_path", "_within"])
    best = Window.partitionBy("file_path", "node_id").orderBy(F.desc("_hop"), "def_node_id")
    uses = near.withColumn("_k", F.row_number().over(best)).filter("_k = 1").join(holder, ["file_path", "_f"], "left")
    called = F.coalesce(X.named_predicate("is_function_call", "_st"), F.lit(False))
    rows = uses.select("file_path", "name", F.when(called, "call").otherwise("reference").alias("ref_kind"), F.when(called, F.col("_type")).otherwise(F.col("type")).alias("node_type"), F.when(called, F.col("_line")).otherwise(F.col("start_line")).alias("start_line"), F.coalesce("_peek", "peek").alias("peek"), scope_name, "def_node_id")
    return sites.union(rows).select(*columns).distinct().orderBy("file_path", "start_line", "ref_kind")
