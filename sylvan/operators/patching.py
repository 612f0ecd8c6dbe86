"""Edits of source text by byte positions: edits and files meet by path, and each file is put together anew in one pass.

An edit is (file_path, start_line, start_column, end_line, end_column, edit_kind, new_text): lines and columns from 1, columns
in bytes, the end column excluded. Kinds are replace, delete, insert_before and insert_after. Every edit refers to the
text as it was, so their order does not matter. An edit that cannot be applied as it stands fails the whole job: an unknown
kind, a null where none may be, a file that is not there, a position outside the text, or edits of one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ("start_line", "start_column", "end_line", "end_column")
EDIT = ("file_path", *PLACE, "edit_kind", "new_text")
KINDS = ("replace", "delete", "insert_before", "insert_after")


def node_edit(kind: str, text: str | Column | None = None, prefix: str = "") -> Column:
    """The struct of an edit of a node, from its columns."""
    new = text if isinstance(text, Column) else F.lit(text).cast("string")
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in EDIT[:5]), F.lit(kind).alias("edit_kind"), new.alias("new_text"))


def _offset(starts: list[int], size: int, line: int, column: int, path: str) -> int:
    last = starts[line] - 1 if 0 < line < len(starts) else size
    if not 1 <= line <= len(starts) or not 1 <= column or starts[line - 1] + column - 1 > last:
        raise ValueError(f"patch: {path} has no place {line}:{column}")
    return starts[line - 1] + column - 1


def apply_edits(path: str, content: str, edits: list[dict]) -> str:
    """One file's text with its edits."""
    data = content.encode()
    lines = data.split(b"\n")
    starts = [0, *(x + k for k, x in enumerate(accumulate(map(len, lines[:-1])), 1))]
    found = []
    for e in edits:
        a, b = (_offset(starts, len(data), e[f"{side}_line"], e[f"{side}_column"], path) for side in ("start", "end"))
        if b < a:
            raise ValueError(f"patch: an edit of {path} ends before it starts")
        kind = e["edit_kind"]
        a, b = (b, b) if kind == "insert_after" else (a, a) if kind == "insert_before" else (a, b)
        found.append((a, b, b"" if kind == "delete" else e["new_text"].encode()))
    found.sort()
    out, at = [], 0
    for k, (a, b, text) in enumerate(found):
        if k and (a < found[k - 1][1] or a == found[k - 1][0]):
            raise ValueError(f"patch: edits of {path} overlap at byte {a}")
        out += [data[at:a], text]
        at = b
    return b"".join([*out, data[at:]]).decode()


def _checked(path: str | None, content: str | None, edits: list[dict]) -> None:
    for e in edits:
        if e["edit_kind"] not in KINDS:
            raise ValueError(f"patch: unknown edit_kind {e['edit_kind']!r}; one of {', '.join(KINDS)}")
        if path is None or path == "<inline>":
            raise ValueError("patch: an edit names no file")
        if any(e[c] is None for c in PLACE):
            raise ValueError(f"patch: an edit of {path} has no place; parse with source='full'")
        if e["new_text"] is None and e["edit_kind"] != "delete":
            raise ValueError(f"patch: an edit of {path} has no new text")
    if content is None:
        raise ValueError(f"patch: {path} is not among the files")


def patch(edits: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_path, patched_source) for each file with edits. texts: (file_path, content), of which only those files are read on."""
    own = edits.select(*(F.col(c).cast("int" if c in PLACE else "string").alias(c) for c in EDIT))
    by_file = own.groupBy("file_path").agg(F.collect_list(F.struct(*EDIT[1:])).alias("edits"))
    rows = by_file.join(texts.select("file_path", F.col("content").cast("string").alias("content")), "file_path", "left").select("file_path", "content", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, content, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _checked(path, content, changes)
                done.append(apply_edits(path, content, changes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["file_path", "patched_source"])

    return rows.mapInArrow(run, "file_path string, patched_source string").orderBy("file_path")


def replace(spark: SparkSession, files: str | list[str], selector: str, text: str, language: str | None = None) -> DataFrame:
    """patch of every node that the selector matches by the text."""
    from sylvan.operators.selectors import select_from
    from sylvan.operators.source import read_text
    from sylvan.sources.reader import read_ast

    nodes = read_ast(spark, files, language, source="full", peek="full" if "[peek" in selector else "none+schema")
    edits = select_from(nodes, selector, ordered=False).select(node_edit("replace", text).alias("e")).select("e.*").distinct()
    return patch(edits, read_text(spark, files))


def write_patched(patched: DataFrame, folder: str) -> DataFrame:
    """Writes each patched text below folder, at its path without the leading slash; (file_path, written, bytes) for each. A
    file is written under another name first and then renamed, so a task that runs twice leaves one whole file."""
    import os
    import posixpath
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            told = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = posixpath.join(folder, path.split("://", 1)[-1].lstrip("/"))
                system, at = fs.FileSystem.from_uri(target if "://" in target else "file://" + os.path.abspath(target))
                system.create_dir(posixpath.dirname(at), recursive=True)
                with system.open_output_stream(temp := f"{at}.{uuid.uuid4().hex}") as out:
                    out.write(data := text.encode())
                system.move(temp, at)
                told.append((path, target, len(data)))
            yield pa.RecordBatch.from_pylist([dict(zip(("file_path", "written", "bytes"), t, strict=True)) for t in told], pa.schema([("file_path", pa.string()), ("written", pa.string()), ("bytes", pa.int64())]))

    return patched.select("file_path", "patched_source").mapInArrow(run, "file_path string, written string, bytes long")
