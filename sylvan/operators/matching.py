"""Code patterns with wildcards: code is found by code.

A pattern is code in which __X__ stands for anything (captured as X), __ for anything at all, and %__<X*>__% for any number of
siblings (+ at least one, ? at most one, ~ none, ** any depth). It is read on the driver into a few rows. Files that hold no
node of the pattern's root type are left out by a semi join; each other file is searched in one task by itself, as a match
lies in one file. Nodes that a pattern can meet are found by type and name once a file, and then by bisection within each
candidate's interval.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions import taxonomy as X

# Node types that only hold a piece of code that stands alone.
AROUND = ("module", "expression_statement", "program", "source_file", "compilation_unit", "document", "source", "script")
WRAPPERS = ("expression_statement", "expression")
NEVER = 999
#: Nodes within candidates that are looked at at once.
PAIRS = 1 << 20
PATTERN = "pattern_node_id long, rel_depth int, sibling_index int, pattern_type string, pattern_name string, pattern_semantic_type int, descendant_count int, is_wildcard boolean, capture_name string, is_syntax boolean, wraps_wildcard boolean, parent_is_wildcard boolean, is_recursive boolean"


@dataclass(frozen=True)
class Part:
    """A node of a pattern."""

    pattern_node_id: int
    rel_depth: int
    sibling_index: int
    pattern_type: str
    pattern_name: str | None
    pattern_semantic_type: int
    descendant_count: int
    is_wildcard: bool
    capture_name: str | None
    is_syntax: bool
    wraps_wildcard: bool
    parent_is_wildcard: bool
    is_recursive: bool = False
    is_variadic: bool = False
    least: int | None = None
    most: int | None = None


def _is_wildcard(name: str | None) -> bool:
    return name is not None and (name == "__" or re.fullmatch("__[A-Z][A-Z0-9_]*__", name) is not None)


def _clean(pattern: str) -> str:
    for form, plain in X.CLEANED:
        pattern = re.sub(form, plain.replace("$1", r"\1"), pattern)
    return pattern


def pattern_parts(pattern: str, language: str) -> list[Part]:
    """The nodes of a pattern without signs, from its outermost node that is code of its own."""
    from sylvan.sources.nodes import extraction
    from sylvan.sources.reader import nodes_of_text

    rows = nodes_of_text(pattern, language, extraction(peek="none"))
    top = min((r["depth"] for r in rows if r["type"] not in AROUND), default=None)
    if top is None:
        return []
    by_id = {r["node_id"]: r for r in rows}
    holders = {r["parent_id"] for r in rows if _is_wildcard(r["name"])}
    out = []
    for r in rows:
        if r["depth"] >= top:
            name, wild = r["name"], _is_wildcard(r["name"])
            parent = by_id.get(r["parent_id"])
            out.append(Part(
                r["node_id"], r["depth"] - top, r["sibling_index"], r["type"], name, r["semantic_type"], r["descendant_count"], wild, name[2:-2] if wild and len(name) > 4 else None, bool(r["flags"] & X.IS_SYNTAX_ONLY),
                not wild and r["type"] in WRAPPERS and r["node_id"] in holders, parent is not None and _is_wildcard(parent["name"]),
            ))
    return out


def ast_pattern(spark: SparkSession, pattern: str, language: str) -> DataFrame:
    """pattern_parts as rows."""
    columns = [c.split()[0] for c in PATTERN.split(", ")]
    return spark.createDataFrame([tuple(getattr(p, c) for c in columns) for p in pattern_parts(pattern, language)], PATTERN)


def ast_pattern_list(spark: SparkSession, pattern: str, language: str) -> DataFrame:
    """One row: the same as a list of structs."""
    rows = ast_pattern(spark, pattern, language).withColumnRenamed("descendant_count", "pattern_descendant_count")
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), lambda a, b: (a["pattern_node_id"] - b["pattern_node_id"]).cast("int")).alias("pattern"))


def signed_parts(pattern: str, language: str, match_syntax: bool) -> list[Part]:
    """pattern_parts of a pattern with signs."""
    parts = pattern_parts(_clean(pattern), language)
    deep = any(re.search(r, pattern) for r in X.RECURSIVE)
    wrapped = {p.rel_depth + 1 for p in parts if p.wraps_wildcard}

    def sign_of(name: str) -> str:
        m = re.search(rf"%__{name}<(\*\*|[*+?~])>__%|%__<{name}(\*\*|[*+?~])[^>]*>__%", pattern)
        return "" if m is None else m[1] or m[2]

    out = []
    for p in parts:
        if p.is_syntax and not match_syntax:
            continue
        if p.capture_name is not None:
            sign = sign_of(p.capture_name)
            p = replace(p, is_recursive=sign == "**", is_variadic=sign in ("*", "+", "?", "~"), least={"+": 1, "*": 0, "?": 0, "~": 0}.get(sign), most={"?": 1, "~": 0}.get(sign))
        elif p.is_wildcard and deep and p.rel_depth > 0 and p.rel_depth in wrapped:
            p = replace(p, is_recursive=True)
        out.append(p)
    return out


CAPTURE = T.StructType([T.StructField("capture", T.StringType()), T.StructField("node_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("type", "name", "peek")), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType())])
FOUND = T.StructType([
    T.StructField("root_node_id", T.LongType()), T.StructField("file_path", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("peek", T.StringType()),
    T.StructField("captures", T.MapType(T.StringType(), T.ArrayType(CAPTURE))),
])
NEEDED = ("node_id", "file_path", "type", "semantic_type", "flags", "name", "start_line", "end_line", "parent_id", "depth", "sibling_index", "descendant_count", "peek")


class Matcher:
    def __init__(self, parts: list[Part], pattern: str, match_syntax: bool, by_meaning: bool, fuzz: int) -> None:
        self.parts, self.syntax, self.by_meaning, self.fuzz = parts, match_syntax, by_meaning, fuzz
        self.variadic = any(re.search(r, pattern) for r in X.VARIADIC)
        self.deep = any(re.search(r, pattern) for r in X.RECURSIVE)
        self.root = next((p for p in parts if p.rel_depth == 0), None)
        recursive = {p.rel_depth for p in parts if p.is_recursive}
        self.below = min((p.rel_depth for p in parts if p.wraps_wildcard and p.rel_depth + 1 in recursive), default=NEVER)
        self.fixed = [p for p in parts if not (p.is_wildcard or p.is_variadic or p.is_recursive or p.wraps_wildcard)]
        self.single = [p for p in parts if p.is_wildcard and p.capture_name is not None and not (p.is_variadic or p.is_recursive or p.parent_is_wildcard)]
        #: Whether every part has one place and every name one part: such patterns are met column by column, within a candidate alone.
        self.plain = self.root is not None and not (self.variadic or self.deep or any(p.is_variadic or p.is_recursive for p in parts)) and len({p.capture_name for p in self.single}) == len(self.single)

    def fits(self, p: Part, t: dict[str, Any]) -> bool:
        """Whether a node is of the part's type (or meaning) and name."""
        if self.by_meaning and not (p.pattern_semantic_type & 0xF0 == 192 and p.descendant_count == 0):
            same = t["semantic_type"] & 0xFC == p.pattern_semantic_type & 0xFC
        else:
            same = t["type"] == p.pattern_type
        return same and (not p.pattern_name or p.is_wildcard or t["name"] == p.pattern_name)

    def free(self, p: Part) -> bool:
        """Whether the part may stand anywhere below its depth."""
        return self.deep and p.rel_depth >= self.below

    def placed(self, p: Part, t: dict[str, Any], depth: int) -> bool:
        d = t["depth"] - depth
        if not (d >= p.rel_depth if self.free(p) else abs(d - p.rel_depth) <= self.fuzz):
            return False
        return p.rel_depth == 0 or self.variadic or p.parent_is_wildcard or self.free(p) or t["sibling_index"] == p.sibling_index

    def search(self, nodes: list[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        """Matches in one file's nodes, in order."""
        if self.root is None:
            return
        nodes.sort(key=lambda n: n["node_id"])
        at = {n["node_id"]: n for n in nodes}
        children: dict[int, list[dict]] = {}
        for n in nodes:
            children.setdefault(n["parent_id"], []).append(n)
        ids = [n["node_id"] for n in nodes]
        meets = {p: [n["node_id"] for n in nodes if self.fits(p, n)] for p in self.fixed}
        for c in nodes:
            if not self.fits(self.root, c) or (self.root.descendant_count and not c["descendant_count"]):
                continue
            low, high, depth = c["node_id"], c["node_id"] + c["descendant_count"], c["depth"]

            def within(known: list[int]) -> Iterator[dict]:
                return (at[i] for i in known[bisect_left(known, low) : bisect_right(known, high)])

            if not all(any(self.placed(p, t, depth) for t in within(meets[p])) for p in self.fixed):
                continue
            captures = self.captured(c, within, ids, meets, at, children)
            if captures is not None:
                yield {"root_node_id": low, "file_path": c["file_path"], "start_line": c["start_line"], "end_line": c["end_line"], "peek": c["peek"], "captures": [(k, [self.told(k, t) for t in v]) for k, v in captures.items()] or None}

    def captured(self, c: dict, within: Any, ids: list[int], meets: dict, at: dict, children: dict) -> dict[str, list[dict]] | None:
        depth, best, by_place = c["depth"], {}, {}
        for p in self.single:
            for t in within(ids):
                if self.placed(p, t, depth):
                    rank = (abs(t["sibling_index"] - p.sibling_index), -t["node_id"])
                    for table, key in ((best, p.capture_name), (by_place, (p.capture_name, p.rel_depth, p.sibling_index))):
                        if key not in table or rank < table[key][0]:
                            table[key] = (rank, t)
        for name in {k[0] for k in by_place}:  # a name that stands in several places stands for one text
            if sum(p.capture_name == name and p.rel_depth > 0 for p in self.single) > 1 and len({t["peek"] for k, (_, t) in by_place.items() if k[0] == name and k[1] > 0}) > 1:
                return None
        out = {name: [t] for name, (_, t) in best.items()}
        taken = {t["node_id"] for _, t in best.values()}
        for p in self.parts:
            if p.capture_name is None or p.capture_name in out or not (p.is_variadic or p.is_recursive):
                continue
            above = [q for q in self.parts if q.rel_depth == p.rel_depth - 1 and not q.is_wildcard and not q.wraps_wildcard]
            scopes = {t["parent_id"] for q in above if q in meets for t in within(meets[q]) if abs(t["depth"] - depth - q.rel_depth) <= self.fuzz} - {None}
            if p.is_variadic:
                fixed = [q for q in above if not q.is_variadic]
                held = [t for s in sorted(scopes) for t in children.get(s, []) if not any(self.fits(q, t) for q in fixed)]
                held.sort(key=lambda t: t["sibling_index"])
            else:
                held = [at[i] for s in sorted(scopes) if s in at for i in ids[bisect_right(ids, s) : bisect_right(ids, s + at[s]["descendant_count"])]]
                held = list({t["node_id"]: t for t in held}.values())
            held = [t for t in held if t["node_id"] not in taken and (self.syntax or not t["flags"] & X.IS_SYNTAX_ONLY)]
            if p.is_variadic and (len(held) < (p.least or 0) or (p.most is not None and len(held) > p.most)):
                return None
            out[p.capture_name] = held
        return out

    @staticmethod
    def told(name: str, t: dict) -> dict:
        return {"capture": name} | {k: t[k] for k in ("node_id", "type", "name", "peek", "start_line", "end_line")}

    # ---- many files at once ----

    def found(self, nodes: pa.Table, schema: pa.Schema) -> pa.Table:
        """The matches in whole files' nodes."""
        if self.root is None or not nodes.num_rows:
            return schema.empty_table()
        nodes = nodes.combine_chunks()
        file = nodes["file_path"].combine_chunks().dictionary_encode()
        if file.null_count or not self.plain or any(nodes[c].null_count for c in ("node_id", "depth", "descendant_count")):
            rows: dict[str, list[dict]] = {}
            for n in nodes.to_pylist():
                rows.setdefault(n["file_path"], []).append(n)
            return pa.Table.from_pylist([m for own in rows.values() for m in self.search(own)], schema)
        number = lambda c: nodes[c].fill_null(-1).to_numpy().astype(np.int64)
        place = (file.indices.to_numpy().astype(np.int64) << 40) + number("node_id")
        if (place[1:] < place[:-1]).any():
            order = np.argsort(place, kind="stable")
            nodes, place = nodes.take(pa.array(order)), place[order]
        own = {c: number(c) for c in ("depth", "descendant_count", "sibling_index", "semantic_type")}
        candidates = np.flatnonzero(self._fit(self.root, nodes, own) & ((own["descendant_count"] > 0) | (not self.root.descendant_count)))
        ends = np.searchsorted(place, place[candidates] + own["descendant_count"][candidates], "right")
        fits = {p: self._fit(p, nodes, own) for p in self.fixed}
        out, total = [], np.cumsum(ends - candidates)
        at = 0
        while at < len(candidates):  # as many as hold a bounded number of nodes
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            out.append(self._met(nodes, own, fits, candidates[at:to], ends[at:to], schema))
            at = to
        return pa.concat_tables(out) if out else schema.empty_table()

    def _fit(self, p: Part, nodes: pa.Table, own: dict[str, np.ndarray]) -> np.ndarray:
        """fits for all nodes."""
        equal = lambda c, x: pc.equal(nodes[c], x).fill_null(False).to_numpy()
        if self.by_meaning and not (p.pattern_semantic_type & 0xF0 == 192 and p.descendant_count == 0):
            same = own["semantic_type"] & 0xFC == p.pattern_semantic_type & 0xFC
        else:
            same = equal("type", p.pattern_type)
        return same if not p.pattern_name or p.is_wildcard else same & equal("name", p.pattern_name)

    def _met(self, nodes: pa.Table, own: dict[str, np.ndarray], fits: dict[Part, np.ndarray], candidates: np.ndarray, ends: np.ndarray, schema: pa.Schema) -> pa.Table:
        sizes = ends - candidates
        which = np.repeat(np.arange(len(candidates)), sizes)
        row = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - candidates, sizes)
        deep, sibling = own["depth"][row] - own["depth"][candidates][which], own["sibling_index"][row]

        def placed(p: Part) -> np.ndarray:
            there = np.abs(deep - p.rel_depth) <= self.fuzz
            return there if p.rel_depth == 0 or p.parent_is_wildcard else there & (sibling == p.sibling_index)

        good = np.ones(len(candidates), bool)
        for p in self.fixed:
            good &= np.bincount(which[placed(p) & fits[p][row]], minlength=len(candidates)) > 0
        holder, part, held = [], [], []
        for k, p in enumerate(self.single):
            i = np.flatnonzero(placed(p) & good[which])
            # The nearest sibling, the later one of two.
            i = i[np.lexsort((-row[i], np.abs(sibling[i] - p.sibling_index), which[i]))]
            first = np.ones(len(i), bool)
            first[1:] = which[i][1:] != which[i][:-1]
            i = i[first]
            holder.append(which[i])
            part.append(np.full(len(i), k))
            held.append(row[i])
        none = np.empty(0, np.int64)
        holder, part, held = (np.concatenate([none, *x]) for x in (holder, part, held))
        order = np.lexsort((part, holder))
        holder, part, held = holder[order], part[order], held[order]
        chosen = np.flatnonzero(good)
        root, kept = nodes.take(pa.array(candidates[chosen])), nodes.take(pa.array(held))
        offsets = np.searchsorted(holder, np.append(chosen, len(candidates))).astype(np.int32)
        names = pa.array([p.capture_name for p in self.single], pa.string()).take(pa.array(part))
        item = schema.field("captures").type.item_type.value_type
        told = pa.StructArray.from_arrays([names, *(kept[f.name].combine_chunks().cast(f.type) for f in list(item)[1:])], fields=list(item))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32)), told)
        captures = pa.MapArray.from_arrays(pa.array(offsets), names, lists, mask=pa.array(offsets[1:] == offsets[:-1]))
        columns = {"root_node_id": root["node_id"], "captures": captures} | {c: root[c] for c in ("file_path", "start_line", "end_line", "peek")}
        return pa.table({f.name: columns[f.name].cast(f.type) for f in schema}, schema)


def match_nodes(nodes: DataFrame, pattern: str, language: str = "python", match_syntax: bool = False, match_by: str = "type", depth_fuzz: int = 0) -> DataFrame:
    """(root_node_id, file_path, start_line, end_line, peek, captures) of each match in a node table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if match_by not in ("type", "semantic_type"):
        raise ValueError(f"match_by is type or semantic_type, not {match_by!r}")
    matcher = Matcher(signed_parts(pattern, language, match_syntax), pattern, match_syntax, match_by == "semantic_type", depth_fuzz)
    schema = to_arrow_schema(FOUND)
    own = nodes.select(*NEEDED)
    if matcher.root is not None and not matcher.by_meaning:
        own = own.join(own.filter(F.col("type") == matcher.root.pattern_type).select("file_path").distinct(), "file_path", "left_semi").select(*NEEDED)

    return own.groupBy("file_path").applyInArrow(lambda table: matcher.found(table, schema), FOUND)


def match_sources(sources: DataFrame, pattern: str, language: str = "python", match_syntax: bool = False, match_by: str = "type", depth_fuzz: int = 0, **given) -> DataFrame:  # noqa: ANN003
    """match_nodes of (file_path, content, language) rows, in the task that parses a file: no node leaves it. Of a plain pattern only
    candidates and what is below them are looked at."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from sylvan.sources.nodes import extraction
    from sylvan.sources.reader import parse_rows

    if match_by not in ("type", "semantic_type"):
        raise ValueError(f"match_by is type or semantic_type, not {match_by!r}")
    matcher = Matcher(signed_parts(pattern, language, match_syntax), pattern, match_syntax, match_by == "semantic_type", depth_fuzz)
    schema = to_arrow_schema(FOUND)

    def candidates(c: dict) -> list[bool]:
        out, last = [], -1
        for i, (kind, below) in enumerate(zip(c["type"], c["descendant_count"], strict=True)):
            last = max(last, i + below) if kind == matcher.root.pattern_type else last
            out.append(i <= last)
        return out

    keep = candidates if matcher.plain and not matcher.by_meaning else None
    return parse_rows(sources, extraction(**given), columns=NEEDED, keep=keep, then=(lambda nodes: matcher.found(nodes, schema), FOUND))


def match(spark: SparkSession, files: str | list[str], pattern: str, language: str = "python", **given) -> DataFrame:  # noqa: ANN003
    """match_nodes over files, with match_id from 1 by file and place."""
    from sylvan.sources.reader import read_ast

    return numbered(match_nodes(read_ast(spark, files, language, peek="full"), pattern, language, **given)).orderBy("match_id")


def numbered(found: DataFrame) -> DataFrame:
    """Adds match_id, from 1 by file and place: each file's matches are counted and numbered by themselves, so that only one
    row for each file meets in one place."""
    counts = found.groupBy("file_path").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file_path", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("file_path").orderBy("root_node_id"))
    return found.withColumn("_own", own).join(starts, "file_path").select((F.col("_before") + F.col("_own")).alias("match_id"), *FOUND.names)
