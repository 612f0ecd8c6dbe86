"""Parses by shape: statements that differ only in their names and plain numbers have one tree.

A text that its front-end can cut into statements (Language.cut) is read statement by statement. A statement's shape is its text with
a mark in place of each name and plain number. A shape is parsed once, with words of its own in these places, and kept as columns of
nodes; another statement of the shape has the same nodes with its own words, lengths and numbers put in, for many statements
at once. A shape that does not compile, and all other texts, are left to the front-end as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from time import monotonic
from typing import Any

import numpy as np
import pyarrow as pa

from sylvan.sources.nodes import FRAME, Extraction, Language, emit_columns, peek_of

#: Shapes that are kept hold so many nodes together, and a statement with a shape has so many characters at most.
MOST_NODES, LONGEST = 500_000, 4096
NAME, NUMBER = "\1", "\2"
#: Names, and numbers of any form; a plain number is one of at most 18 digits without leading zeros.
WORD = re.compile(r"([A-Za-z_][A-Za-z0-9_]*|\.?[0-9](?:[eE][+-]?|[A-Za-z0-9_.])*)")
_WIDTH = 12
_SCOPES = ("current", "function", "class", "module")


def _tag(word: str, fixed: frozenset[str]) -> str:
    if word in fixed or word[0] == "_":
        return word
    if word[0] > "9":
        return NAME
    return NUMBER if word.isdigit() and len(word) <= 18 and (word[0] != "0" or word == "0") else word


class Shape:
    """The nodes of a statement as columns; numbers of nodes count from 1, as 0 is the module."""

    __slots__ = ("columns", "frames", "infos", "kept", "lines", "mixed", "names", "own", "positions", "size", "tops")


class Shapes:
    """Rows of texts, gathered until they are taken as a batch. keep tells of a text's columns which nodes to give; it looks at types
    and structure, not at words or places, and at one top-level statement at a time."""

    def __init__(self, lang: Language, e: Extraction, wanted: Iterable[str], keep: Callable[[dict], list[bool]] | None = None) -> None:
        self.lang, self.e, self.keep = lang, e, keep
        self.wanted = frozenset(wanted)
        self.peeks = "peek" in self.wanted and e.peek != "none"
        self.placed = self.peeks or bool({"start_column", "end_column"} & self.wanted)
        self.told = bool({"signature_type", "parameters", "modifiers", "annotations"} & self.wanted)
        self.known: dict[str, Shape | None] = {}
        self.held = 0
        self.root = self._module()
        self._clear()

    @staticmethod
    def can(lang: Language, e: Extraction, wanted: Iterable[str]) -> bool:
        """Whether these columns can be given by shapes: nothing is left out, and no name counts the equal ones before it."""
        return lang.cut is not None and not e.prune and e.max_depth < 0 and e.keep <= {"peek"} and "qualified_name" not in wanted

    def _clear(self) -> None:
        self.shapes: list[Shape] = []  # one for each statement, the module's before them
        self.base, self.line, self.top, self.file, self.word = [], [], [], [], []  # what its numbers count from
        self.offset: list[int] = []
        self.texts: list[str] = []
        self.words: list[str] = []
        self.files: list[tuple[str, Any]] = []
        self.modules: list[tuple[int, int, int, int, int, str]] = []
        self.rows = 0

    # ---- one shape ----

    def _shape(self, parts: list[str]) -> Shape | None:
        """parts: a statement's text, words at odd places, the marked ones as marks."""
        if sum(map(len, parts)) > LONGEST:
            return None
        parts, words, at = list(parts), {}, 0
        begins: list[int] = []  # of the marked words
        for i, p in enumerate(parts):
            if p in (NAME, NUMBER):
                parts[i] = f"q{len(words):0{_WIDTH - 2}d}z" if p == NAME else f"{10 ** (_WIDTH - 1) + len(words)}"
                words[parts[i]] = len(words)
                begins.append(at)
            at += len(parts[i])
        text = "".join(parts)
        root = self.lang.compiled(text.encode())
        if root is None:
            return None
        found = emit_columns(root, text.encode(), self.lang, "", self.e)
        return self._kept(found, text, words, np.array(begins, np.int64))

    def _module(self) -> Shape:
        root = self.lang.compiled(b"")
        return self._kept(emit_columns(root, b"", self.lang, "", self.e), "", {}, np.empty(0, np.int64), module=True)

    def _kept(self, found: dict, text: str, words: dict[str, int], begins: np.ndarray, module: bool = False) -> Shape | None:
        s = Shape()
        n = len(found["type"])
        s.size, s.tops, s.lines = n - 1, found["children_count"][0], text.count("\n")
        keep = np.ones(n, bool) if self.keep is None else np.array(self.keep(found), bool)
        keep[0] &= module
        keep[1:] &= not module
        s.kept = rows = np.flatnonzero(keep)
        pick = lambda c: np.array([found[c][i] for i in rows], np.int64)
        number = lambda x: -1 if x is None else x
        depth, sibling = pick("depth"), pick("sibling_index")
        # Positions: what they are with no marked word before them, and how many are before them.
        places = np.array([[found[c][i] for i in rows] for c in ("begin", "end")], np.int64).reshape(2, -1)
        starts = np.array([0, *(m.end() for m in re.finditer("\n", text))], np.int64)
        lines = np.array([[found[c][i] for i in rows] for c in ("start_line", "end_line")], np.int64).reshape(2, -1)
        places = np.concatenate([places, starts[lines - 1]])
        before = np.searchsorted(begins, places, "left")
        if begins.size and (places < begins[np.maximum(before - 1, 0)] + _WIDTH)[before > 0].any():
            return None  # a node ends within a word
        s.positions = np.concatenate([places - _WIDTH * before, before])
        parent = np.array([number(found["parent_id"][i]) for i in rows], np.int64)
        scope = np.array([[number(found["scope"][i][k]) for i in rows] for k in range(len(_SCOPES))], np.int64).reshape(len(_SCOPES), -1)
        s.columns = np.concatenate([np.array([rows, parent, depth, sibling, (depth == 1).astype(np.int64), pick("children_count"), pick("descendant_count"), pick("semantic_type"), pick("flags"), *lines]).reshape(11, -1), scope])
        s.own = pa.array([found["type"][i] for i in rows], pa.string())
        s.frames = [None if found["stack"][i] is None else [(f["id"], f["kind"]) for f in found["stack"][i]] for i in rows]
        # A name is one marked word (its number), or text (-1) that may hold some.
        s.names, s.mixed = np.full(len(rows), -1, np.int64), []
        for k, i in enumerate(rows):
            name = self._template(found["name"][i], words)
            if name[0] == "" and len(name) == 3 and name[2] == "":
                s.names[k] = name[1]
            elif len(name) > 1 or name[0]:
                s.mixed.append((k, name))
        s.infos = [(k, i, self._info(found, i, words)) for k, i in enumerate(rows)] if "signature_type" in found else []
        s.infos = [(k, x) for k, _, x in s.infos if any(x)]
        return s

    @staticmethod
    def _template(text: str, words: dict[str, int]) -> tuple:
        """Texts with numbers of marked words between them."""
        out: list = [""]
        for i, p in enumerate(WORD.split(text)):
            if i % 2 and p in words:
                out += [words[p], ""]
            else:
                out[-1] += p
        return tuple(out)

    def _info(self, found: dict, i: int, words: dict[str, int]) -> tuple:
        text = lambda x: None if x is None else self._template(x, words)
        return text(found["signature_type"][i]), [{k: text(v) for k, v in p.items()} for p in found["parameters"][i]], [text(x) for x in found["modifiers"][i]], text(found["annotations"][i])

    # ---- texts ----

    def add(self, path: str, data: bytes, carried: Any = None) -> bool:
        """Whether the text could be read by shapes; its rows are then held."""
        try:
            text = data.decode("ascii")
        except UnicodeDecodeError:
            return False
        parts = self.lang.cut(text)
        if parts is None:
            return False
        known, fixed, split = self.known, self.lang.fixed, WORD.split
        shapes, slots, sizes = [], [], []
        most = self.e.max_parse_nodes if self.e.max_parse_nodes > 0 else float("inf")
        late = monotonic() + self.e.parse_timeout_ms / 1000 if self.e.parse_timeout_ms > 0 else float("inf")
        for part in parts:
            cut = split(part)
            words = cut[1::2]
            tags = [w if w in fixed or w[0] == "_" else NAME if w[0] > "9" else _tag(w, fixed) for w in words]
            cut[1::2] = tags
            key = "".join(cut)
            shape = known.get(key, 0)
            if shape == 0:
                if self.held > MOST_NODES:
                    known.clear()
                    self.held = 0
                shape = known[key] = self._shape(cut)
                self.held += 64 if shape is None else 64 + shape.size
            if shape is None:
                return False
            shapes.append(shape)
            own = [w for w, t in zip(words, tags, strict=True) if t < "\3"]
            slots.append(own)
            sizes.append(len(own))
            if monotonic() > late:
                raise ValueError(f"{path}: not done in {self.e.parse_timeout_ms} ms")
        total = 1 + sum(s.size for s in shapes)
        if total > most:
            raise ValueError(f"{path}: more than {self.e.max_parse_nodes} nodes")
        file = len(self.files)
        self.files.append((path, carried))
        first = len(text) - len(text.lstrip(" \n")) if parts else 0
        line, node, top, at = text.count("\n", 0, first), 1, 0, first
        self._put(self.root, 0, line, 0, file, at, "")
        if len(self.root.kept):
            self.modules.append((len(self.shapes) - 1, total - 1, sum(s.tops for s in shapes), first, len(text), text))
        for shape, own, part in zip(shapes, slots, parts, strict=True):
            if len(shape.kept):
                self._put(shape, node, line, top, file, at, part)
                self.words += own
            node, line, top, at = node + shape.size, line + shape.lines, top + shape.tops, at + len(part)
        return True

    def _put(self, shape: Shape, node: int, line: int, top: int, file: int, at: int, text: str) -> None:
        self.shapes.append(shape)
        self.base.append(node)
        self.line.append(line)
        self.top.append(top)
        self.file.append(file)
        self.word.append(len(self.words))
        if self.placed:
            self.offset.append(at)
            self.texts.append(text)
        self.rows += len(shape.kept)

    # ---- batches ----

    def take(self) -> dict[str, pa.Array]:
        """The columns of all rows held, of the names wanted; carried values as the column carried."""
        which: dict[int, int] = {}
        distinct: list[Shape] = []
        for s in self.shapes:
            if id(s) not in which:
                which[id(s)] = len(distinct)
                distinct.append(s)
        of = np.array([which[id(s)] for s in self.shapes], np.int64)
        counts = np.array([len(s.kept) for s in distinct], np.int64)
        first = np.cumsum(counts) - counts
        n = counts[of]
        begin = np.cumsum(n) - n
        total = int(n.sum())
        within = np.repeat(np.arange(len(of)), n)  # the statement of a row
        at = np.arange(total) - np.repeat(begin - first[of], n)  # its row among those of the distinct shapes
        rel, parent, depth, sibling, is_top, children, below, semantic, flags, start, end, *scopes = np.concatenate([s.columns for s in distinct], 1)
        base = np.array(self.base, np.int64)[within] - 1

        def absolute(x: np.ndarray) -> np.ndarray:
            x = x[at]
            return np.where(x > 0, x + base, x)

        line = np.array(self.line, np.int64)[within]
        out: dict[str, Any] = {"node_id": absolute(rel), "depth": depth[at], "sibling_index": sibling[at] + is_top[at] * np.array(self.top, np.int64)[within], "children_count": children[at], "descendant_count": below[at], "semantic_type": semantic[at], "flags": flags[at], "start_line": start[at] + line, "end_line": end[at] + line}
        places = self._places(distinct, at, within, n) if self.placed else None
        for k, size, tops, a, b, text in self.modules:
            row = begin[k]
            out["children_count"][row], out["descendant_count"][row] = tops, size
            out["end_line"][row] = text.count("\n") + 1
            if places is not None:
                places[:, row] = a, b, text.rfind("\n", 0, a) + 1, text.rfind("\n", 0, b) + 1
        wanted = self.wanted
        if "parent_id" in wanted:
            above = absolute(parent)
            out["parent_id"] = pa.array(above, mask=above < 0)
        if "type" in wanted:
            out["type"] = pa.concat_arrays([s.own for s in distinct]).take(pa.array(at))
        if "name" in wanted:
            out["name"] = self._names(distinct, of, begin, at, within)
        file = pa.array(np.array(self.file, np.int64)[within])
        if "file_path" in wanted:
            out["file_path"] = pa.array([p for p, _ in self.files], pa.string()).take(file)
        if "language" in wanted:
            out["language"] = pa.array([self.lang.name], pa.string()).take(pa.array(np.zeros(total, np.int64)))
        if "scope" in wanted:
            out["scope"] = self._scope(distinct, at, base, [absolute(x) for x in scopes])
        if places is not None:
            out["start_column"], out["end_column"] = places[0] - places[2] + 1, places[1] - places[3] + 1
        if self.peeks:
            out["peek"] = self._peeks(places, within, begin)
        elif "peek" in wanted:
            out["peek"] = pa.nulls(total, pa.string())
        if self.told:
            out |= self._infos(distinct, of, begin, total)
        out["carried"] = [c for _, c in self.files], file
        self._clear()
        return out

    def _places(self, distinct: list[Shape], at: np.ndarray, within: np.ndarray, n: np.ndarray) -> np.ndarray:
        """In the file: where a row starts and ends, and where the lines of these places start."""
        every = np.concatenate([s.positions for s in distinct], 1)[:, at]
        lengths = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        word = np.array(self.word, np.int64)[within]
        return every[:4] + lengths[word + every[4:]] - lengths[word] + np.array(self.offset, np.int64)[within]

    def _word(self, template: tuple, at: int) -> str:
        return "".join(self.words[at + p] if k % 2 else p for k, p in enumerate(template))

    def _names(self, distinct: list[Shape], of: np.ndarray, begin: np.ndarray, at: np.ndarray, within: np.ndarray) -> pa.Array:
        slot = np.concatenate([s.names for s in distinct])[at]
        pool, index = ["", *self.words], np.where(slot >= 0, slot + 1 + np.array(self.word, np.int64)[within], 0)
        for kind, s in enumerate(distinct):
            if s.mixed:
                own = np.flatnonzero(of == kind)
                for k, template in s.mixed:
                    if len(template) == 1:
                        index[begin[own] + k] = len(pool)
                        pool.append(template[0])
                    else:
                        index[begin[own] + k] = len(pool) + np.arange(len(own))
                        pool += [self._word(template, self.word[j]) for j in own]
        return pa.array(pool, pa.string()).take(pa.array(index))

    def _scope(self, distinct: list[Shape], at: np.ndarray, base: np.ndarray, parts: list[np.ndarray]) -> pa.Array:
        frames = [f for s in distinct for f in s.frames]
        sizes = np.array([0 if f is None else len(f) for f in frames], np.int64)
        flat = np.array([x for f in frames if f is not None for x in f], np.int64).reshape(-1, 2)
        first = np.cumsum(sizes) - sizes
        n = sizes[at]
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        pick = np.arange(int(n.sum())) - np.repeat(offsets[:-1] - first[at], n)
        ids = flat[pick, 0]
        ids = np.where(ids > 0, ids + np.repeat(base, n), ids)
        frame = pa.StructArray.from_arrays([pa.array(ids), pa.array(flat[pick, 1].astype(np.int16))], names=FRAME.names)
        none = pa.array(np.array([f is None for f in frames], bool)[at])
        stack = pa.ListArray.from_arrays(pa.array(offsets), frame, mask=none)
        return pa.StructArray.from_arrays([*(pa.array(x, mask=x < 0) for x in parts), stack], names=[*_SCOPES, "stack"])

    def _peeks(self, places: np.ndarray, within: np.ndarray, begin: np.ndarray) -> pa.Array:
        own = {k: text for k, *_, text in self.modules}
        mode, texts, offset = self.e.peek, self.texts, self.offset
        out = []
        for j, a, b in zip(within.tolist(), places[0].tolist(), places[1].tolist(), strict=True):
            text = own[j][a:b] if j in own else texts[j][a - offset[j] : b - offset[j]]
            out.append((text or None) if mode == "full" or (mode == "smart" and len(text) <= 50) else peek_of(text.encode(), mode))
        return pa.array(out, pa.string())

    def _infos(self, distinct: list[Shape], of: np.ndarray, begin: np.ndarray, total: int) -> dict[str, list]:
        signature, parameters, modifiers, annotations = [None] * total, [[]] * total, [[]] * total, [None] * total
        for kind, s in enumerate(distinct):
            if s.infos:
                for j in np.flatnonzero(of == kind).tolist():
                    at = self.word[j]
                    text = lambda x: None if x is None else self._word(x, at)  # noqa: B023, E731
                    for k, (said, given, marks, notes) in s.infos:
                        row = int(begin[j]) + k
                        signature[row], annotations[row] = text(said), text(notes)
                        parameters[row], modifiers[row] = [{c: text(v) for c, v in p.items()} for p in given], [text(m) for m in marks]
        return {"signature_type": signature, "parameters": parameters, "modifiers": modifiers, "annotations": annotations}
