"""Parses by shape against whole parses, and what the queries over written sources send around."""

import random
from dataclasses import replace
from itertools import compress

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylvan.operators import matching as M
from sylvan.plans import source_queries as S
from sylvan.sources import python_source
from sylvan.sources.nodes import emit_columns, extraction, schema_for
from sylvan.sources.python_source import PYTHON
from sylvan.sources.reader import _batch, _batches, parse_rows
from sylvan.sources.shapes import Shapes

TEXTS = [
    "", "\n\n", "  \n\nx = 1", "x = 1; y = 2\nz=3", "def f1(x):\n    return g(x, 10)\n\n\ndef f22(yy):\n    return gggg(yy, 7)\n",
    "@staticmethod\n@abc.x(1)\ndef f(a:int, *b, c:List[int]=3, **d)->Dict[str,int]:\n    return a.b.c[1:2, 3](x, *y, **z)\nclass A(B, metaclass=C):\n    x: int = 1\n    def __init__(self): pass\n    async def go(self): await self.x\n",
    "import a.b as c, d\nfrom . import x\nfrom ..y import (z, w as q)\nfrom m import *\n", "match x:\n    case A(b, c=1) if d > 2: pass\n    case [1, *_]: pass\n    case _: y = 2\n",
    "try:\n    f()\nexcept (A, B) as e:\n    pass\nexcept:\n    raise X from y\nelse:\n    z\nfinally:\n    w\nelsewhere = 1\n", "x = [i for i in range(10) if i if j]\ny = {a: b for a, b in c}\nz = {**a, b: 1}\nf(x for x in y)\n",
    "x = 1.5e3 + .5 + 1_000 + 0x1F + 1j + 00 + 1e+5 + 12345678901234567890\nx = -1 ** 2\nassert x, y\n", "if a:\n  b\nelif c:\n  d\nelse:\n  e\nfor i, (j, k) in z: continue\nelse: pass\n",
    "def f(\n  a,\n  b=1\n):\n    return (a,\n            b)\n", f"def {'long' * 20}(x):\n    return {'g' * 60}(x)\n",
]
LEFT = ["x = (1,\n2)\n", "x = 'a'\n", "x = 1  # one\n", "x = \\\n1\n", "é = 1\n", "def f(:\n", "  x = 1\n", "x = (1,\n", "from __future__ import annotations\n", "@\nx = 1\n"]


def functions(n, seed=5):
    rng = random.Random(seed)
    return "".join(f"def f{rng.randrange(10**6)}(x):\n    for i in x:\n        if i:\n            g{i % 7}(i, {rng.randrange(1000)})\n    return h{i % 5}(x)\n\n" for i in range(n))


def schema_of(e):
    return to_arrow_schema(T.StructType([f for f in schema_for(e).fields if f.name != "qualified_name"]))


def by_shape(texts, e, keep=None, lang=PYTHON):
    schema = schema_of(e)
    shapes = Shapes(lang, e, schema.names, keep)
    read = [shapes.add(f"{i}", t.encode(), None) for i, t in enumerate(texts)]
    return read, pa.Table.from_batches(_batches(shapes, schema, None), schema)


def whole(texts, e, keep=None):
    schema, out = schema_of(e), []
    for i, t in enumerate(texts):
        found = emit_columns(PYTHON.parse(t.encode()), t.encode(), PYTHON, f"{i}", e, frozenset(schema.names))
        if keep is not None:
            marks = keep(found)
            found = {k: list(compress(v, marks)) for k, v in found.items()}
        if found["type"]:
            out.append(_batch(found, schema, 0, len(found["type"])))
    return pa.Table.from_batches(out, schema)


@pytest.mark.parametrize("peek", ["smart", "full", 7, "none+schema"])
def test_shapes_give_the_nodes_of_a_whole_parse(peek):
    e, texts = extraction(source="full", peek=peek), [*TEXTS, functions(30), "\n".join(TEXTS[3:9])]
    read, found = by_shape(texts, e)
    assert all(read)
    assert found.to_pylist() == whole(texts, e).to_pylist()


@pytest.mark.parametrize("keep", [S._deepest, S._called, S._definitions, S._within(S._base("EXTERNAL_IMPORT")), S._either(S._of_type("call"), S._base("FLOW_LOOP"))])
def test_kept_nodes_are_those_of_a_whole_parse(keep):
    e = extraction(source="full")
    assert by_shape([*TEXTS, functions(5)], e, keep)[1].to_pylist() == whole([*TEXTS, functions(5)], e, keep).to_pylist()


def test_what_shapes_cannot_tell_is_left_to_the_front_end(spark):
    read, found = by_shape(LEFT, extraction())
    assert not any(read) and not found.num_rows
    rows = [(f"{i}", t, "python") for i, t in enumerate([*LEFT, *TEXTS])]
    nodes = parse_rows(spark.createDataFrame(rows, "file_path string, content string, language string").repartition(2), extraction(), columns=("file_path", "node_id", "type"))
    assert {r.file_path: r.n for r in nodes.groupBy("file_path").agg({"*": "count"}).toDF("file_path", "n").collect()} == {p: len(emit_columns(PYTHON.parse(t.encode()), t.encode(), PYTHON, p, extraction())["type"]) for p, t, _ in rows}
    with pytest.raises(ValueError, match="more than 20 nodes"):
        by_shape([functions(3)], extraction(max_parse_nodes=20))


def test_functions_of_one_shape_are_parsed_once(monkeypatch):
    """The queries' seconds were those of a parse for each of their files."""
    parses = []
    monkeypatch.setattr(python_source, "parse", lambda code, real=python_source.parse: parses.append(len(code)) or real(code))
    lang = replace(PYTHON, parse=python_source.parse)
    read, found = by_shape([functions(10, seed) for seed in range(50)], extraction(), lang=lang)
    assert all(read) and found.num_rows > 50 * 10 * 30
    assert len(parses) <= 3 and max(parses) < 300


@pytest.mark.parametrize("pattern", ["__F__(__X__, __Y__)", "__F__(__X__)", "g3(__X__, __)", "h1(x)", "return __X__", "__A__ = __B__", "for __I__ in x: __BODY__", "def __F__(x): __B__"])
@pytest.mark.parametrize("by", ["type", "semantic_type"])
def test_columns_meet_patterns_as_single_nodes_do(pattern, by):
    e = extraction()
    nodes = whole([t for t in TEXTS if t.strip()] + [functions(20)], e).select(M.NEEDED)
    schema = to_arrow_schema(M.FOUND)
    for syntax, fuzz in ((False, 0), (True, 0), (False, 1)):
        matcher = M.Matcher(M.signed_parts(pattern, "python", syntax), pattern, syntax, by == "semantic_type", fuzz)
        assert matcher.plain
        got = matcher.found(nodes, schema).to_pylist()
        matcher.plain = False
        expected = matcher.found(nodes, schema).to_pylist()
        plain = lambda rows: sorted(repr({**r, "captures": r["captures"] and sorted(r["captures"], key=repr)}) for r in rows)
        assert plain(got) == plain(expected)
        if by == "type" and not fuzz and pattern in ("__F__(__X__, __Y__)", "h1(x)"):
            assert got


def test_matches_in_the_parse_are_those_of_the_nodes(spark):
    rows = [(f"{i}", t, "python") for i, t in enumerate([*TEXTS, "s = f(1, 'x')\n", functions(20)])]
    sources = spark.createDataFrame(rows, "file_path string, content string, language string").repartition(3)
    for pattern in ("__F__(__X__, __Y__)", "def __F__(x): %__BODY<*>__%"):
        of = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
        assert of(M.match_sources(sources, pattern)) == of(M.match_nodes(parse_rows(sources, extraction()), pattern))


@pytest.mark.parametrize("name", ["source_imports", "source_call_graph", "source_parent_definition", "source_metrics"])
def test_no_join_of_nodes_is_sent_to_all_tasks(spark, name):
    """Many tables that are just small enough to be broadcast took more memory than the driver has."""
    df = S.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    below = plan.split("InMemoryRelation")[0] if "InMemoryRelation" in plan else plan
    assert "BroadcastHashJoin" not in below
