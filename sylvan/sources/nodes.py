"""Syntax nodes: schema, extraction settings, and the emitter that numbers a parsed tree."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from sylvan.functions import taxonomy as X


class Raw:
    """A node as a front-end makes it: type and byte span; children in order."""

    __slots__ = ("children", "end", "info", "name", "start", "type")

    def __init__(self, type_: str, start: int, end: int, children: list[Raw] | None = None, name: str | None = None, **info: Any) -> None:
        self.type, self.start, self.end, self.children, self.name, self.info = type_, start, end, children or [], name, info


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    parse: Callable[[bytes], Raw]
    #: type -> (semantic type with refinement, flags)
    types: dict[str, tuple[int, int]] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()
    #: (type, name, node) -> whether the definition is visible from outside
    exported: Callable[[Raw, str], bool] = lambda node, name: True
    parser_type: str = "hand-written"
    #: type -> how a node without a name gets one; see sylvan.sources.registry
    strategies: dict[str, str] = field(default_factory=dict)
    #: For sylvan.sources.shapes: a text's statements, each a tree of its own (None: not told); their tree, None where they do not
    #: compile; and the words that decide on a tree.
    cut: Callable[[str], list[str] | None] | None = None
    compiled: Callable[[bytes], Raw | None] | None = None
    fixed: frozenset[str] = frozenset()


PRUNE = ("syntax", "comments", "literals", "imports", "types", "punctuation", "unnamed", "leaves", "internal")


@dataclass(frozen=True)
class Extraction:
    """What to extract; see parse arguments in sylvan.sources.reader."""

    context: str = "native"
    source: str = "lines_only"
    structure: str = "full"
    peek: str | int = "smart"
    keep: frozenset[str] = frozenset()  # levels given with +schema: full columns, no data
    max_depth: int = -1
    prune: tuple[str, ...] = ()
    ignore_errors: bool = False
    max_source_bytes: int = 50 << 20
    max_parse_nodes: int = 10_000_000
    parse_timeout_ms: int = 30_000


LEVELS = {
    "context": ("none", "node_types_only", "normalized", "native"),
    "source": ("none", "path", "lines_only", "full"),
    "structure": ("none", "minimal", "full"),
    "peek": ("none", "smart", "full", "custom"),
}


def extraction(**given: Any) -> Extraction:
    """Checks and reads parse arguments; the legacy peek_size and peek_mode override peek."""
    if given.get("peek_size") is not None:
        given["peek"] = given["peek_size"]
    elif given.get("peek_mode") is not None:
        given["peek"] = given["peek_mode"]
    batch = given.pop("batch_size", 1)
    if batch is not None and batch < 1:
        raise ValueError("batch_size must be at least 1")
    given.pop("peek_size", None)
    given.pop("peek_mode", None)
    keep, out = set(), {}
    for level, allowed in LEVELS.items():
        value = given.pop(level, None)
        if value is None:
            continue
        if level == "peek" and (isinstance(value, int) or str(value).isdigit()):
            out[level] = int(value)
            continue
        value = str(value).lower()
        if value.endswith("+schema"):
            keep.add(level)
            value = value.removesuffix("+schema")
        value = {"lines": "lines_only"}.get(value, value) if level == "source" else value
        if value not in allowed:
            raise ValueError(f"unknown {level} level {value!r}; one of {', '.join(allowed)}")
        out[level] = value
    prune = given.pop("prune", None) or ()
    prune = tuple(p.strip().lower() for p in (prune.split(",") if isinstance(prune, str) else prune))
    if bad := [p for p in prune if p not in PRUNE]:
        raise ValueError(f"unknown prune category {bad[0]!r}; one of {', '.join(PRUNE)}")
    return replace(Extraction(), **out, keep=frozenset(keep), prune=prune, **{k: v for k, v in given.items() if v is not None})


SEGMENT = T.StructType([T.StructField("semantic_type", T.ShortType()), T.StructField("name", T.StringType()), T.StructField("index", T.IntegerType())])
PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
FRAME = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.ShortType())])
SCOPE = T.StructType([*(T.StructField(x, T.LongType()) for x in ("current", "function", "class", "module")), T.StructField("stack", T.ArrayType(FRAME))])


def schema_for(e: Extraction) -> T.StructType:
    """The columns that these settings give; known before anything is read."""
    at = {k: LEVELS[k].index(getattr(e, k)) if isinstance(getattr(e, k), str) else 3 for k in LEVELS}
    at |= {k: len(LEVELS[k]) - 1 for k in e.keep}
    s, i, n = T.StringType(), T.IntegerType(), T.LongType()
    fields: list[tuple[str, T.DataType]] = [("node_id", n), ("type", s)]
    if at["context"] >= 1:
        fields += [("semantic_type", T.ShortType()), ("flags", T.ShortType())]
    if at["context"] >= 2:
        fields += [("name", s), ("qualified_name", T.ArrayType(SEGMENT))]
    if at["context"] >= 3:
        fields += [("signature_type", s), ("parameters", T.ArrayType(PARAMETER)), ("modifiers", T.ArrayType(s)), ("annotations", s)]
    if at["source"] >= 1:
        fields += [("file_path", s), ("language", s)]
    if at["source"] >= 2:
        fields += [("start_line", i), ("end_line", i)]
    if at["source"] >= 3:
        fields += [("start_column", i), ("end_column", i)]
    if at["structure"] >= 1:
        fields += [("parent_id", n), ("depth", i)]
    if at["structure"] >= 2:
        fields += [("sibling_index", i), ("children_count", i), ("descendant_count", i), ("scope", SCOPE)]
    if at["peek"] >= 1:
        fields += [("peek", s)]
    return T.StructType([T.StructField(k, t) for k, t in fields])


SEGMENT_KINDS = {240: "F", 244: "V", 248: "C", 252: "M", 48: "I", 52: "E"}
FRAME_KINDS = (240, 244, 248, 252)


def peek_of(text: bytes, mode: str | int) -> str | None:
    if mode == "none":
        return None
    if isinstance(mode, int) or mode == "custom":
        out = text[: mode if isinstance(mode, int) else 120].decode("utf-8", "ignore")
    else:
        out = text.decode("utf-8", "replace")
        if mode == "smart" and len(text) > 50:
            out = out.split("\n", 1)[0]
            out = out[:77] + "..." if len(out) > 80 else out
    return out or None


def pruned(node: Raw, lang: Language, e: Extraction) -> str:
    """What becomes of a node: keep, drop (children move up) or cut (with all below it)."""
    st, flags = lang.types.get(node.type, (0, 0))
    base, kind = st & 0xFC, st & 0xF0
    for p in e.prune:
        if (p == "comments" and kind == 32) or (p == "imports" and base == 48) or (p == "types" and kind == 112):
            return "cut"
        if (
            (p == "syntax" and (flags & X.IS_SYNTAX_ONLY or base in (4, 8))) or (p == "punctuation" and (base in (4, 8) or not re.search(r"\w", node.type))) or (p == "literals" and kind == 64)
            or (p == "unnamed" and not node.name) or (p == "leaves" and not node.children) or (p == "internal" and node.children)
        ):
            return "drop"
    return "keep"


def emit_columns(root: Raw, code: bytes, lang: Language, path: str, e: Extraction, wanted: frozenset[str] | None = None) -> dict[str, list]:
    """Columns of the nodes in depth-first order. wanted names those that are asked for: others may be missing. A scope is given
    as a tuple of its first four fields, and its stack as a column of its own."""
    from bisect import bisect_right
    from time import monotonic

    starts = [0]
    at = code.find(b"\n")
    while at >= 0:
        starts.append(at + 1)
        at = code.find(b"\n", at + 1)
    asked = lambda *names: wanted is None or any(n in wanted for n in names)
    with_peek, with_qualified, smart = asked("peek") and e.peek != "none", asked("qualified_name"), e.peek == "smart"
    late = monotonic() + e.parse_timeout_ms / 1000 if e.parse_timeout_ms > 0 else float("inf")
    most = e.max_parse_nodes if e.max_parse_nodes > 0 else float("inf")
    types, semantic, flag_list, names, qualifieds, infos = [], [], [], [], [], []
    parents, depths, siblings, counts, descendants, scopes, stacks = [], [], [], [], [], [], []
    begins, ends, peeks = [], [], []
    frames: list[tuple[int, int]] = []
    slots: list[tuple] = [(None, None, None, None)]
    segments: list[tuple[list[dict], dict[tuple[int, str], int]]] = [([], {})]
    known = lang.types
    # (node, parent, depth, sibling), or (None, own number, is a frame, is a segment) where a subtree ends.
    stack: list[tuple] = [(root, None, 0, 0)]
    push, pop, ident = stack.append, stack.pop, 0
    while stack:
        node, parent, depth, sibling = pop()
        if node is None:
            descendants[parent] = ident - 1 - parent
            if depth:
                frames.pop()
                slots.pop()
            if sibling:
                segments.pop()
            continue
        if ident >= most:
            raise ValueError(f"{path}: more than {e.max_parse_nodes} nodes")
        if ident % 1024 == 1023 and monotonic() > late:
            raise ValueError(f"{path}: not done in {e.parse_timeout_ms} ms")
        info = node.info
        st, flags = known.get(node.type, (0, 0))
        if info:
            st = info.get("semantic_type", st)
            if info.get("syntax"):
                flags |= X.IS_SYNTAX_ONLY
        base = st & 0xFC
        if base == 4 or base == 8:
            flags |= X.IS_SYNTAX_ONLY
        name = node.name or ""
        if flags & 4 and name and lang.exported(node, name):
            flags |= X.IS_EXPORTED
        here = slots[-1]
        scopes.append(here)
        framed, named, qualified = bool(flags & X.IS_SCOPE), False, None
        if framed:
            frames.append((ident, st))
            slots.append((ident, ident if base == 240 else here[1], ident if base == 248 else here[2], ident if base == 252 else here[3]))
            stacks.append([{"id": i, "kind": k} for i, k in frames])
        else:
            stacks.append(None)
        if with_qualified and name and base in SEGMENT_KINDS:
            trail, seen = segments[-1]
            seen[st, name] = seen.get((st, name), 0) + 1
            qualified = [*trail, {"semantic_type": st, "name": name, "index": seen[st, name]}]
            if base in FRAME_KINDS:
                segments.append((qualified, {}))
                named = True
        start, end = node.start, node.end
        types.append(node.type)
        semantic.append(st)
        flag_list.append(flags)
        names.append(name)
        qualifieds.append(qualified)
        infos.append(info)
        parents.append(parent)
        depths.append(depth)
        siblings.append(sibling)
        begins.append(start)
        ends.append(end)
        if with_peek:
            peeks.append((code[start:end].decode("utf-8", "replace") or None) if smart and end - start <= 50 else peek_of(code[start:end], e.peek))
        children = node.children
        if 0 <= e.max_depth <= depth:
            children = []
        elif e.prune and children:
            todo, children = list(reversed(children)), []
            while todo:
                c = todo.pop()
                fate = pruned(c, lang, e)
                if fate == "keep":
                    children.append(c)
                elif fate == "drop":
                    todo.extend(reversed(c.children))
        descendants.append(0)
        counts.append(len(children))
        if children or framed or named:
            push((None, ident, framed, named))
            depth += 1
            for k in range(len(children) - 1, -1, -1):
                push((children[k], ident, depth, k))
        ident += 1
    first = [bisect_right(starts, a) for a in begins]
    last = [bisect_right(starts, b if b > a else a) for a, b in zip(begins, ends, strict=True)]
    out = {
        "begin": begins, "end": ends, "node_id": range(ident), "type": types, "semantic_type": semantic, "flags": flag_list, "name": names, "qualified_name": qualifieds, "file_path": [path] * ident, "language": [lang.name] * ident, "start_line": first, "end_line": last,
        "parent_id": parents, "depth": depths, "sibling_index": siblings, "children_count": counts, "descendant_count": descendants, "scope": scopes, "stack": stacks, "peek": peeks if with_peek else [None] * ident,
    }
    if asked("start_column", "end_column"):
        out["start_column"] = [a - starts[n - 1] + 1 for a, n in zip(begins, first, strict=True)]
        out["end_column"] = [b - starts[n - 1] + 1 for b, n in zip(ends, last, strict=True)]
    if asked("signature_type", "parameters", "modifiers", "annotations"):
        out |= {"signature_type": [i.get("signature") or None for i in infos], "parameters": [i.get("parameters", []) for i in infos], "modifiers": [i.get("modifiers", []) for i in infos], "annotations": [i.get("annotations") or None for i in infos]}
    empty = {"context": ("semantic_type", "flags", "name", "qualified_name", "signature_type", "parameters", "modifiers", "annotations"), "source": ("file_path", "language", "start_line", "end_line", "start_column", "end_column"), "structure": ("parent_id", "depth", "sibling_index", "children_count", "descendant_count", "scope"), "peek": ("peek",)}
    data = set(schema_for(replace(e, keep=frozenset())).names) if e.keep else ()
    for level in e.keep:
        out |= {c: [None] * ident for c in empty[level] if c not in data}
    return out


def emit(root: Raw, code: bytes, lang: Language, path: str, e: Extraction) -> Iterator[dict[str, Any]]:
    """Node rows in depth-first order."""
    columns = emit_columns(root, code, lang, path, e)
    columns["scope"] = [None if s is None else dict(zip(SCOPE.names, (*s, stack), strict=True)) for s, stack in zip(columns["scope"], columns["stack"], strict=True)]
    names = schema_for(e).names
    for values in zip(*(columns[n] for n in names), strict=True):
        yield dict(zip(names, values, strict=True))
