"""Parsed sources and the analyses over them."""

import pytest

from sylvan.operators import analysis as A
from sylvan.operators import tree as N
from sylvan.sources.reader import detect_language, parse_ast, read_ast

CODE = """
def outer():
    x = 1
    def inner():
        return x
    return inner()
"""
BRANCHES = """
def plain():
    return 1

def branchy(n):
    if n > 0:
        for i in range(n):
            if i % 2:
                show(i)
    else:
        while n < 0:
            n += 1
    return n

def unused():
    pass

class Lonely:
    pass

branchy(plain())
obj.run()
"""


def test_numbers_follow_document_order(spark):
    nodes = parse_ast(spark, CODE, "python")
    ids = {r.name: r.node_id for r in nodes.filter("type = 'function_definition'").collect()}
    assert ids == {"outer": 1, "inner": 14}
    assert {r.node_id for r in N.children(nodes, 0).collect()} == {1}
    assert [r.type for r in N.ancestors(nodes, 14).orderBy("node_id").collect()] == ["module", "function_definition", "block", "function_definition"]
    own = {r.node_id for r in N.own_scope(nodes, 1).collect()}
    assert 14 in own and 15 not in own


def test_structure(spark):
    nodes = parse_ast(spark, CODE, "python").cache()
    assert {r.name for r in N.has(nodes, "function_definition", "call").collect()} == {"outer"}
    assert {r.name for r in N.not_has(nodes, "function_definition", "call").collect()} == {"inner"}
    assert N.inside(nodes, "return_statement", "function_definition", "inner").count() == 1
    assert [r.type for r in N.containing_line(nodes, 5).collect()][-1] == "module"


def test_metrics_calls_and_dead_code(spark):
    nodes = parse_ast(spark, BRANCHES, "python").cache()
    found = {r.name: (r.lines, r.return_count, r.conditionals, r.loops, r.cyclomatic) for r in A.function_metrics(nodes).collect()}
    assert found["plain"] == (2, 1, 0, 0, 1)
    # two if statements and one else clause; for and while
    assert found["branchy"] == (9, 1, 3, 2, 6)
    assert {(r.name, r.definition_type) for r in A.dead_code(nodes).collect()} == {("unused", "function"), ("Lonely", "class")}
    assert {(r.caller, r.callee, r.call_type) for r in A.call_graph(nodes).collect()} == {
        ("branchy", "range", "function"), ("branchy", "show", "function"), ("<module>", "branchy", "function"), ("<module>", "plain", "function"), ("<module>", "run", "method"),
    }
    assert {r.name for r in A.functions_containing(nodes, "while_statement").collect()} == {"branchy"}


def test_references_resolve_to_the_innermost_scope(spark):
    rows = A.resolve(parse_ast(spark, CODE, "python")).filter("ref_name = 'x' and ref_line = 5").collect()
    assert [(r.def_type, r.def_line) for r in rows] == [("assignment", 3)]


def test_files_and_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text(CODE)
    (tmp_path / "b.py").write_text(BRANCHES)
    (tmp_path / "c.txt").write_text("no source")
    found = read_ast(spark, f"{tmp_path}/**/*.py")
    assert {r.file_path.rsplit("/", 1)[1] for r in found.select("file_path").distinct().collect()} == {"a.py", "b.py"}
    assert A.function_metrics(found).count() == 5
    assert read_ast(spark, f"{tmp_path}/*.txt", ignore_errors=True).count() == 0
    with pytest.raises(ValueError):
        parse_ast(spark, "x", "nolanguage")
    with pytest.raises(ValueError):
        parse_ast(spark, "x", "python", prune="nothing")
    assert parse_ast(spark, "def f(:", "python").filter("type = 'ERROR'").count() == 1
    paths = spark.createDataFrame([("s3://b/x.PY",), ("a.html@rev1",), ("noext",), (None,)], "p string")
    assert [r[0] for r in paths.select(detect_language("p")).collect()] == ["python", "html", None, None]


def test_what_does_not_compile_is_an_error_node(spark):
    broken = "def good(a):\n    return a\n\ndef bad(:\n    pass\n\nclass Late:\n    x = 1\n"
    nodes = parse_ast(spark, broken, "python").cache()
    assert {r.name for r in nodes.filter("type in ('function_definition', 'class_definition')").collect()} == {"good", "Late"}
    errors = nodes.filter("type = 'ERROR'").collect()
    assert len(errors) == 1 and errors[0].start_line == 4 and errors[0].children_count > 3
    assert parse_ast(spark, "x = (1,\ny = 2\n", "python").filter("type = 'ERROR'").count() >= 1
    assert parse_ast(spark, "@\ndef f(): pass\n", "python").filter("type = 'ERROR'").count() == 1
    assert parse_ast(spark, "", "python").count() == 1


def test_parses_are_dealt_by_functions(spark, tmp_path):
    """The files' texts are small, but their parse is long: it has a task for each core at least, and more with more orders."""
    from sylvan.plans.sizes import parts_for
    from sylvan.plans.source_queries import python_files, python_nodes

    nodes = python_nodes(spark, "/root/testdata/sf0.001", ("file_path", "scope"))
    assert nodes.columns == ["file_path", "scope"]
    assert nodes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert nodes.select("file_path").distinct().count() == python_files(spark, "/root/testdata/sf0.001").count()
    few, many = (parts_for(spark.read.parquet(f"/root/testdata/{s}/orders.parquet"), 64) for s in ("sf0.01", "sf0.1"))
    assert few < 10 < many
