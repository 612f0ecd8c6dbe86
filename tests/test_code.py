"""Selectors, patterns, patches, blocks, references and sources over parsed Python."""

import pytest
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X
from sylvan.operators import analysis as A
from sylvan.operators import documents as D
from sylvan.operators import matching as M
from sylvan.operators import patching as P
from sylvan.operators import selectors as S
from sylvan.operators import source as C
from sylvan.operators import tree as N
from sylvan.sources import reader as R
from sylvan.sources import registry as G
from sylvan.sources.nodes import Raw

REFS = """x = 10

def process(x):
    y = x + 1
    return y

def transform(data):
    x = data * 2
    result = process(x)
    return result

class Service:
    def __init__(self, db):
        self.db = db

    def fetch(self, query):
        return self.db.execute(query)

    def run(self):
        data = self.fetch("SELECT 1")
        return process(data)

def main():
    svc = Service("postgres")
    result = svc.run()
    print(result)
"""
RISKY = """import os
import pickle
def dangerous_eval(user_input):
    result = eval(user_input)
    return result
def run_command(cmd):
    os.system(cmd)
def load_data(filename):
    with open(filename, "rb") as f:
        return pickle.load(f)
def safe_function():
    return 42
"""
CALLS = """def add_numbers(x, y):
    return x + y
def greet(name):
    print("Hello")
    return name
result = add_numbers(1, 2)
eval(user_input)
exec(dangerous_code)
"""
STARS = """def simple(x):
    return x
def multi(x):
    print(x)
    return x
"""
EQUAL = "a == a\na == b\nb + b\nc + d\nx == x\n"
DEMO = """def greet(name):
    return "hello " + name

def unused():
    pass

total = 1 + 2
"""
SHAPES = """CONST = 1

class Shape:
    def area(self):
        return 0

    class Inner:
        def deep(self):
            return 1

def top(x: int, y: int) -> int:
    return x + y
"""
STAR = "def __F__(__):\n    %__<BODY{}>__%\n    return __Y__"


def selected(nodes, selector):
    return [(r.type, r.name, r.start_line) for r in S.select_from(nodes, selector).collect()]


@pytest.fixture(scope="module")
def refs(spark):
    return R.parse_ast(spark, REFS, "python", peek="full").cache()


def test_selectors(spark, refs):
    assert [x[1] for x in selected(refs, ".func")] == ["process", "transform", "__init__", "fetch", "run", "main"]
    assert [x[1] for x in selected(refs, "class function")] == ["__init__", "fetch", "run"]
    assert selected(refs, "function_definition:has(call#process)") == [("function_definition", "transform", 7), ("function_definition", "run", 19)]
    assert [x[1] for x in selected(refs, "function:not(:has(call)):named")] == ["process", "__init__"]
    assert [x[1] for x in selected(refs, "function[name*=roc]")] == ["process"]
    assert [x[1] for x in selected(refs, "function_definition[params=2]")] == ["__init__", "fetch"]
    assert [x[1] for x in selected(refs, "#process::callers")] == ["transform", "run"]
    assert [x[1] for x in selected(refs, "function#main::callees")] == ["Service", "run", "print"]
    assert [x[1] for x in selected(refs, "call#execute::parent-definition")] == ["fetch"]
    assert [x[1] for x in selected(refs, "function:is-called")] == ["process", "fetch", "run"]
    assert [x[1] for x in selected(refs, "call:called-by(main)")] == ["Service", "run", "print"]
    assert selected(refs, "call:match('process(___)')") == [("call", "process", 9), ("call", "process", 21)]
    assert [x[1] for x in selected(refs, "function:contains('process(data)')")] == ["run"]
    assert selected(refs, "function#nothing") == [] and selected(refs.limit(0), "function:has(call)") == []
    assert [x[0] for x in selected(refs, "if > else")] == []


@pytest.mark.parametrize(
    "bad",
    [":nonsense", "[colour=red]", "a::somewhere", "call:has(a > b)", "call:has([name=x])", "[type*=x]", "[modifier^=x]", "a > ", "", ":nth-child", "call:match('a'):contains('b')", "call:not(x)", "#a > .b"],
)
def test_selectors_that_cannot_be_read(spark, refs, bad):
    with pytest.raises(ValueError):
        S.select_from(refs, bad)
    with pytest.raises(ValueError):
        S.select_from(refs.limit(0), bad)


def test_own_predicates_and_rules(spark, refs):
    S.register_predicate("longer", lambda n: F.length("name") > int(n))
    assert [x[1] for x in selected(refs, "function:longer(7)")] == ["transform", "__init__"]
    assert [x[1] for x in selected(refs, "function:not(:longer(4))")] == ["run", "main"]
    rows = S.select_list(refs, "/* all */ class_definition { color: red; weight: bold } function#nothing {} call#print, call#execute { a: b }").collect()
    assert [(r.rule_index, r.selector, len(r.matches)) for r in rows] == [(0, "class_definition", 1), (1, "function#nothing", 0), (2, "call#print", 1), (3, "call#execute", 1)]
    assert rows[0].declarations == {"color": "red", "weight": "bold"} and rows[0].matches[0].name == "Service"
    with pytest.raises(ValueError):
        S.select_from(R.parse_ast(spark, "a = 1", "python", peek="none+schema"), "[peek*=a]")


def test_references(spark, refs):
    found = [(r.ref_kind, r.node_type, r.start_line, r.scope_name) for r in A.find_references(refs, "x").collect()]
    assert found == [("definition", "assignment", 1, "<module>"), ("reference", "identifier", 3, "process"), ("reference", "identifier", 4, "process"), ("definition", "assignment", 8, "transform"), ("reference", "identifier", 9, "transform")]
    assert [(r.ref_kind, r.start_line, r.scope_name) for r in A.find_references(refs, "result").collect()] == [("definition", 9, "transform"), ("reference", 10, "transform"), ("definition", 25, "main"), ("reference", 26, "main")]
    assert [(r.ref_kind, r.start_line) for r in A.find_references(refs, "Service").collect()] == [("definition", 12), ("call", 24)]


def test_security_audit(spark):
    rows = A.security_audit(R.parse_ast(spark, RISKY, "python", peek="full")).filter("risk_level = 'high'").collect()
    assert sorted({(r.function_name, r.risk_category) for r in rows}) == [("dangerous_eval", "Code Injection"), ("load_data", "Deserialization"), ("run_command", "Command Injection")]
    assert [r.matched_pattern for r in rows if r.function_name == "run_command"] == ["system"]


def test_imports(spark):
    code = "import os\nimport numpy as np\nfrom a.b import c, d as e\nfrom . import f\nfrom g import *\n"
    rows = [(r.source_module, r.imported_name, r.start_line) for r in A.imports(R.parse_ast(spark, code, "python")).collect()]
    assert ("os", "os", 1) in rows and ("numpy", "np", 2) in rows and ("a.b", "c", 3) in rows and all(r[1] for r in rows)


def test_metrics_and_definitions(spark, refs):
    assert {r.name: r.definition_type for r in A.definitions(refs).filter("definition_type <> 'variable'").collect()}["Service"] == "class"
    assert {(r.def_name, r.parent_def_name) for r in N.definition_parent(refs).collect()} >= {("fetch", "Service"), ("svc", "main")}
    service = refs.filter("name = 'Service' and type = 'class_definition'").first().node_id
    members = N.class_members(refs, service).collect()
    assert [m.name for m in sorted(members, key=lambda m: m.node_id)] == ["__init__", "fetch", "run"] and tuple(members[0].asDict()) == N.MEMBER
    call = refs.filter("type = 'call' and name = 'Service'").first().node_id
    assert [(r.type, r.arg_position) for r in N.call_arguments(refs, call).collect()] == [("string", 0)]


def counted(spark, code, pattern, **given):
    return M.match_nodes(R.parse_ast(spark, code, "python", peek="full"), pattern, **given).orderBy("root_node_id").collect()


def test_patterns(spark):
    assert len(counted(spark, CALLS, "__F__(__X__)")) == 4
    assert len(counted(spark, CALLS, "def __F__(__): return __Y__")) == 1
    both = counted(spark, CALLS, STAR.format("*"))
    assert [(r.captures["F"][0].name, r.captures["Y"][0].peek, len(r.captures["BODY"])) for r in both] == [("add_numbers", "x + y", 0), ("greet", "name", 1)]
    assert len(counted(spark, CALLS, "def __F__(__):\n    %__<*>__%\n    return __Y__")) == 2
    assert [r.captures["F"][0].name for r in counted(spark, STARS, STAR.format("+"))] == ["multi"]
    assert [r.captures["F"][0].name for r in counted(spark, STARS, "def __F__(__):\n    %__BODY<*>__%\n    return __Y__")] == ["simple", "multi"]
    assert [r.captures["F"][0].name for r in counted(spark, STARS, STAR.format("~"))] == ["simple"]
    assert (len(counted(spark, EQUAL, "__X__ == __X__")), len(counted(spark, EQUAL, "__X__ + __X__")), len(counted(spark, EQUAL, "__X__ == __Y__"))) == (2, 1, 3)
    assert len(counted(spark, CALLS, "__F__(__X__)", match_by="semantic_type")) == 4
    assert counted(spark, "", "__F__(__X__)") == []
    found = M.numbered(M.match_nodes(R.parse_ast(spark, EQUAL, "python", peek="full"), "__X__ == __Y__")).orderBy("match_id")
    assert [r.match_id for r in found.collect()] == [1, 2, 3]
    assert found.select(X.ast_capture("captures", "X").alias("x")).first().x.peek == "a"
    assert [(r.is_wildcard, r.capture_name) for r in M.ast_pattern(spark, "foo(__X__)", "python").filter("is_wildcard").collect()] == [(True, "X")]
    assert len(M.ast_pattern_list(spark, "foo(__X__)", "python").first().pattern) > 3


def test_patching(spark, tmp_path):
    (tmp_path / "demo.py").write_text(DEMO)
    (tmp_path / "uni.py").write_text("# é\ncafé = 1\n")
    path, texts = str(tmp_path / "demo.py"), C.read_text(spark, str(tmp_path))
    nodes = R.read_ast(spark, str(tmp_path / "demo.py"), source="full", peek="none")
    name = nodes.filter("type = 'identifier' and name = 'greet'").first()
    assert (name.start_line, name.start_column, name.end_line, name.end_column) == (1, 5, 1, 10)
    edits = lambda where, kind, text=None: nodes.filter(where).select(P.node_edit(kind, text).alias("e")).select("e.*")
    done = lambda e: [r.patched_source for r in P.patch(e, texts).collect()]
    assert done(edits("type = 'pass_statement'", "replace", "return 42")) == [DEMO.replace("pass", "return 42")]
    assert done(edits("type = 'pass_statement'", "delete")) == [DEMO.replace("pass", "")]
    both = edits("name = 'greet' and type = 'identifier'", "insert_before", "_").union(edits("type = 'pass_statement'", "insert_after", "  # nothing"))
    assert done(both) == [DEMO.replace("greet", "_greet").replace("pass", "pass  # nothing")]
    assert done(edits("false", "delete")) == []
    assert [r.patched_source for r in P.replace(spark, str(tmp_path / "uni.py"), "identifier[name=café]", "tea").collect()] == ["# é\ntea = 1\n"]
    out = P.write_patched(P.patch(edits("type = 'pass_statement'", "replace", "return 42"), texts), str(tmp_path / "out")).collect()
    assert len(out) == 1 and open(out[0].written).read() == DEMO.replace("pass", "return 42")
    place = f"'{path}' as file_path, 1 as start_line, 1 as start_column, 1 as end_line, 3 as end_column"
    for bad in (f"{place}, 'turn' as edit_kind, 'x' as new_text", f"{place}, 'replace' as edit_kind, null as new_text", "'no.py' as file_path, 1 as start_line, 1 as start_column, 1 as end_line, 3 as end_column, 'delete' as edit_kind, '' as new_text",
                f"'{path}' as file_path, 99 as start_line, 1 as start_column, 99 as end_line, 3 as end_column, 'delete' as edit_kind, '' as new_text", f"{place}, 'delete' as edit_kind, '' as new_text union all select {place}, 'insert_before', 'x'"):
        with pytest.raises(Exception, match="patch: "):
            done(spark.sql(f"select {bad}"))


def test_blocks(spark):
    nodes = R.parse_ast(spark, SHAPES, "python", peek="full")
    rows = [(r.element_order, r.block.element_type, r.block.content if r.block.element_type == "heading" else r.block.attributes.get("heading_level", "-")) for r in D.to_blocks(nodes).collect()]
    assert rows[0] == (0, "metadata", "-") and [r[0] for r in rows] == list(range(len(rows)))
    assert [r[2] for r in rows if r[1] == "heading"] == ["CONST", "Shape", "area(self)", "Inner", "deep(self)", "top(x: int, y: int) -> int"]
    assert sum(r[1] == "code" for r in rows) == 4
    levels = [r.block.attributes["heading_level"] for r in D.to_blocks(nodes, max_heading_level=2).collect() if r.block.element_type == "heading"]
    assert levels == ["1", "1", "2", "2", "2", "1"]
    assert {r.block.element_type for r in D.to_blocks(nodes, style="summary", include_metadata=False).collect()} == {"heading", "paragraph"}
    assert sum(r.block.element_type == "code" for r in D.to_blocks(nodes, style="flat").collect()) == 6
    bare = R.parse_ast(spark, SHAPES, "python", peek="none+schema")
    for wrong in (lambda: D.to_blocks(nodes, style="odd"), lambda: D.to_blocks(nodes, base_heading_level=7), lambda: D.to_blocks(bare)):
        with pytest.raises(ValueError):
            wrong()
    assert D.to_blocks(bare, include_bodies=False).count() == 7
    assert [r.block.element_type for r in D.to_blocks(R.parse_ast(spark, "1\n", "python", peek="full")).collect()] == ["metadata"]


def test_sources(spark, tmp_path):
    (tmp_path / "a" / "x" / "t").mkdir(parents=True)
    (tmp_path / "a" / "y" / "u").mkdir(parents=True)
    (tmp_path / "a" / "x" / "t" / "one.py").write_text(DEMO)
    (tmp_path / "a" / "y" / "u" / "two.py").write_text(RISKY)
    (tmp_path / "a" / "c.txt").write_text("text")
    names = lambda files: sorted(r.file_path.rsplit("/", 1)[1] for r in R.file_rows(spark, files).select("file_path").collect())
    base = str(tmp_path / "a")
    assert names(f"{base}/**/t/*.py") == ["one.py"]
    assert names([f"{base}/**/*.py", f"{base}/x/t/one.py", base]) == ["one.py", "two.py"]
    assert names(f"{base}/**/[ot]*.{{py,js}}") == ["one.py", "two.py"]
    assert names(f"{base}/*.txt") == ["c.txt"]
    for wrong in ([], [None], 5, [""]):
        with pytest.raises(ValueError):
            R.file_rows(spark, wrong)
    texts = C.read_text(spark, f"{base}/x/t/one.py")
    got = texts.select(C.get_source("content", 4, 5).alias("a"), C.get_source_numbered("content", 4, 5).alias("b"), C.get_source_line("content", 7).alias("c"), C.get_source_line("content", 99).alias("d"), C.get_source("content", 90, 99).alias("e")).first()
    assert tuple(got) == ("def unused():\n    pass", "   4: def unused():\n   5:     pass", "total = 1 + 2", None, None)
    found = C.source_of(R.read_ast(spark, f"{base}/x"), texts, "unused", "function").collect()
    assert [(r.definition_kind, r.start_line, r.source) for r in found] == [("function", 4, "   4: def unused():\n   5:     pass")]
    assert C.source_of(R.read_ast(spark, f"{base}/x"), texts, "unused", "class").count() == 0


def test_shapes_of_node_tables(spark):
    lists = spark.createDataFrame([("a = 1", "python"), (None, "python"), ("[1, 2]", "json"), ("x", None)], "code string, language string").select(R.parse_list("code", "language").alias("n")).collect()
    assert lists[0].n[0].type == "module" and lists[1].n is None and lists[2].n[0].type == "document" and lists[3].n is None
    nested = R.parse_ast_hierarchical(spark, "def f(): pass", "python")
    assert nested.columns == ["node_id", "type", "source", "structure", "context", "peek"]
    row = nested.filter("type = 'function_definition'").first()
    assert (row.context.name, row.source.start_column, row.context.native.modifiers, row.structure.parent_id) == ("f", 1, [], 0)
    assert R.semantic_type_codes(spark).count() == 64 and R.semantic_type_codes(spark).filter("code = 252").first().full_name == "DEFINITION_MODULE"
    kinds = R.type_map(spark, "python")
    assert kinds.filter("node_type = 'function_definition'").first().name_role == "definition" and len(kinds.columns) == 9
    assert R.supported_languages(spark).count() >= 3
    R.register_sql(spark)
    assert spark.sql("select count(*) as n from parse_ast('a = 1', 'python') where type = 'assignment'").first().n == 1
    assert spark.sql("select t.k, n.type from values (1, 'def f(): pass'), (2, 'x') t(k, code), lateral parse_ast(t.code, 'python') n where n.type = 'function_definition'").collect() == [(1, "function_definition")]


def test_index(spark, tmp_path):
    nodes = lambda code, path: R.parse_ast(spark, code, "python").withColumn("file_path", F.lit(path))
    first = str(tmp_path / "index")
    R.write_index(nodes("a = 1", "a.py").unionByName(nodes("b = 1", "b.py")), first)
    second = R.update_index(spark, nodes("c = 2\nd = 3", "a.py"), first)
    assert {(r.file_path, r.name) for r in spark.read.parquet(second).filter("type = 'assignment'").collect()} == {("a.py", "c"), ("a.py", "d"), ("b.py", "b")}
    assert spark.read.parquet(first).filter("file_path = 'a.py' and type = 'assignment'").count() == 1


def test_index_table(spark, tmp_path):
    R.save_index(R.parse_ast(spark, REFS, "python"), "code_index", 4, str(tmp_path / "table"))
    try:
        plan = S.select_from(spark.table("code_index"), "function:has(call)", ordered=False)
        assert "hashpartitioning(file_path" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 4
    finally:
        spark.sql("drop table code_index")


def test_languages_of_ones_own(spark):
    def words(code):
        root, at = Raw("document", 0, len(code)), 0
        for w in code.split(b" "):
            root.children.append(Raw("word", at, at + len(w)))
            at += len(w) + 1
        return root

    config = '{"language": "words", "node_types": {"document": {"semantic_type": "DEFINITION_MODULE", "flags": ["IS_SCOPE"]}, "word": {"semantic_type": "NAME_IDENTIFIER", "refinement": 1, "name_strategy": "node_text", "flags": ["NAME_REFERENCE"]}}}'
    with pytest.raises(PermissionError):
        G.register_language(spark, "words", words, config)
    spark.conf.set(G.SETTING, "true")
    try:
        assert G.register_language(spark, "words", words, config, ("wrd",), ("w",)).first().node_type_count == 2
        rows = R.parse_ast(spark, "one two", "w").orderBy("node_id").collect()
        assert [(r.type, r.name, r.semantic_type, r.flags) for r in rows] == [("document", "", 252, 8), ("word", "one", 81, 2), ("word", "two", 81, 2)]
        with pytest.raises(ValueError):
            G.register_language(spark, "words", words, config)
        with pytest.raises(ValueError):
            G.register_language(spark, "other", words, None, ("py",))
        with pytest.raises(ValueError):
            G.register_language(spark, "python", words, None, overwrite=True)
    finally:
        G.unregister_language("words")
        spark.conf.unset(G.SETTING)


@pytest.mark.parametrize(
    "config",
    [
        "{", "[]", "{}", '{"node_types": {}, "extra": true}', '{"language": "b", "node_types": {}}', '{"node_types": {"d": {"semantic_type": "DEFINITION_MODULE", "name_strategy": "CUSTOM"}}}', '{"node_types": {"d": {"name_strategy": "NODE_TEXT"}}}',
        '{"node_types": {"d": {"semantic_type": "DEFINITION_MODULE", "native_strategy": "X"}}}', '{"node_types": {"d": {"semantic_type": "LITERAL_STRING", "refinement": 4}}}', '{"node_types": {"d": {"semantic_type": "LITERAL_STRING", "flags": ["NO"]}}}',
        '{"node_types": {"d": {"semantic_type": "LITERAL_STRING", "name_strategy": "MADE_UP"}}}', '{"node_types": {"d": {"semantic_type": "NO"}}}',
    ],
)
def test_bad_language_descriptions(config):
    with pytest.raises(ValueError):
        G.read_config(config, "a")


def test_code_table_keeps_its_dealing(spark, tmp_path):
    """Joins and windows by file over the code-shaped table shuffle no nodes; orders without their customer's row are numbered as SQL numbers them."""
    import duckdb

    from sylvan.operators import tree as N
    from sylvan.plans.code import CODE_SQL, PLAIN, code_tree

    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    table("customer").filter("c_custkey % 3 <> 1").write.parquet(f"{tmp_path}/customer.parquet")
    table("orders").write.parquet(f"{tmp_path}/orders.parquet")
    table("lineitem").filter("l_orderkey % 5 <> 2").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes = code_tree(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    columns = f"{PLAIN}, semantic_type, flags, children_count, note, peek, language, scope_current, scope_function, scope_class"
    want = con.execute(f"{CODE_SQL} select {columns} from code").fetchall()
    assert sorted(map(repr, map(tuple, nodes.select(*columns.split(", ")).collect()))) == sorted(map(repr, want))
    plan = N.holds(nodes, N._matches("call", None), "_has").join(nodes.select("file_path", "parent_id"), ["file_path", "parent_id"])
    text = plan._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning" not in text and "Window" in text


def test_large_files_are_cut_into_slices(spark, monkeypatch):
    """A region is one file; with slices of 50 nodes the questions about it have the answers of whole files, and no window runs over a file."""
    from sylvan.operators import tree as N
    from sylvan.plans import relational as R

    monkeypatch.setattr(N, "SLICE", 50)
    monkeypatch.setattr(R, "SLICE", 7)
    t = R.relational_tree(spark, "/root/testdata/sf0.001").persist()
    for apply in (
        lambda **k: N.has(t, "customer", "lineitem", "R", **k), lambda **k: N.inside(t, "lineitem", "orders", "F", "A", **k), lambda **k: N.depth_profile(t, "customer", **k),
        lambda **k: N.own_scope(t, 1, N.F.col("type") == "orders", **k), lambda **k: N.descendants(t, 1, **k),
    ):
        whole, cut = apply(), apply(few_files=True)
        assert whole.columns == cut.columns
        assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty() and not whole.isEmpty()
    assert N.descendants(t, 1, few_files=True)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].count("SortMergeJoin") == 0
