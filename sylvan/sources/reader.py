"""Node tables from files, strings and columns: parsing runs inside tasks, one file at a time."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylvan.functions import taxonomy as X
from sylvan.sources.markup import HTML, JSON
from sylvan.sources.nodes import SCOPE, Extraction, Language, emit, emit_columns, extraction, schema_for
from sylvan.sources.python_source import PYTHON
from sylvan.sources.shapes import Shapes

LANGUAGES: dict[str, Language] = {x.name: x for x in (PYTHON, HTML, JSON)}
#: Node rows that one Arrow batch holds.
BATCH_ROWS = 4096


def language_of(name: str, known: dict[str, Language] | None = None) -> Language:
    known = LANGUAGES if known is None else known
    found = known.get(name.lower()) or next((x for x in known.values() if name.lower() in x.aliases), None)
    if found is None:
        raise ValueError(f"unsupported language {name!r}; one of {', '.join(sorted(known))}")
    return found


def extensions() -> dict[str, str]:
    return {ext: x.name for x in LANGUAGES.values() for ext in x.extensions}


def detect_language(path: Column | str) -> Column:
    """The language of a path's extension, without scheme or revision (@rev); null where none is known."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.lower(F.regexp_extract(p, r"(\.[A-Za-z0-9]+)(?:@[^/.]*)?$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in extensions().items() for x in pair)), ext)


def supported_languages(spark: SparkSession) -> DataFrame:
    rows = [(x.name, list(x.extensions), x.parser_type, len(x.types)) for x in LANGUAGES.values()]
    return spark.createDataFrame(rows, "language string, extensions array<string>, parser_type string, node_type_count int").orderBy("language")


def _parsed(give, path: str, code: str | bytes, language: str | None, e: Extraction, known: dict[str, Language], *rest):  # noqa: ANN001, ANN202
    """What give (emit or emit_columns) makes of one text; None for one that fails, if errors are ignored."""
    try:
        if language is None:
            raise ValueError(f"{path}: no language is known for this extension")
        data = code.encode() if isinstance(code, str) else bytes(code)
        if 0 < e.max_source_bytes < len(data):
            raise ValueError(f"{path}: {len(data)} bytes, more than {e.max_source_bytes}")
        lang = language_of(language, known)
        out = give(lang.parse(data), data, lang, path, e, *rest)
        return out if isinstance(out, dict) else list(out)
    except Exception:
        if not e.ignore_errors:
            raise
        return None


def _nodes(path: str, code: str | bytes, language: str | None, e: Extraction, known: dict[str, Language]) -> Iterator[dict]:
    yield from _parsed(emit, path, code, language, e, known) or ()


def nodes_of_text(code: str, language: str, e: Extraction) -> list[dict]:
    """The rows of one short text, on the driver: for patterns."""
    return list(_nodes("<inline>", code, language, e, LANGUAGES))


def _batch(columns: dict[str, list], schema: pa.Schema, lo: int, hi: int) -> pa.RecordBatch:
    """Rows lo .. hi - 1 of columns of nodes; structs are put together of whole columns, not row by row."""
    out = []
    for field in schema:
        values = columns[field.name][lo:hi]
        if field.name == "scope" and hi > lo and values[0] is not None:
            parts = [*zip(*values, strict=True), columns["stack"][lo:hi]]
            out.append(pa.StructArray.from_arrays([pa.array(p, field.type.field(i).type) for i, p in enumerate(parts)], fields=[field.type.field(i) for i in range(len(SCOPE))]))
        else:
            out.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def _cast(values, kind: pa.DataType) -> pa.Array:  # noqa: ANN001
    """An array of the kind; given arrays are changed as a whole."""
    found = values if isinstance(values, pa.Array) else pa.array(values, None if isinstance(values, np.ndarray) else kind)
    return found if found.type == kind else found.cast(kind)


def _batches(shapes: Shapes, schema: pa.Schema, carry: str | None, then: Callable[[pa.Table], pa.Table] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows that are held, in batches, or what then makes of them."""
    if not shapes.rows:
        return
    found = shapes.take()
    if carry is not None:
        given, file = found["carried"]
        found[carry] = pa.array(given, schema.field(carry).type).take(file)
    whole = pa.RecordBatch.from_arrays([_cast(found[f.name], f.type) for f in schema], schema=schema)
    if then is not None:
        yield from then(pa.Table.from_batches([whole])).to_batches()
        return
    for lo in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(lo, BATCH_ROWS)


def parse_rows(sources: DataFrame, e: Extraction, carry: str | None = None, columns: Iterable[str] | None = None, keep: Callable[[dict], list[bool]] | None = None, then: tuple[Callable[[pa.Table], pa.Table], T.StructType] | None = None) -> DataFrame:
    """Nodes of (file_path, content, language) rows; null contents give none. carry names a column that every node keeps;
    columns names those that are made, all if None; keep tells which nodes are given (see sylvan.sources.shapes.Shapes). then has
    what is made of the nodes of whole files, in the same task, and its schema."""
    fields = [f for f in schema_for(e).fields if columns is None or f.name in columns]
    if carry is not None:
        fields = [T.StructField(carry, sources.schema[carry].dataType), *fields]
    schema = T.StructType(fields)
    arrow, known = to_arrow_schema(schema), dict(LANGUAGES)  # tasks get the registered languages too
    wanted = frozenset(schema.names)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in [*schema.names, "stack"]}
        kept = schema.names[0]
        by_shape: dict[str, Shapes] = {}

        def shaped(path: str, code: str | bytes, lang: Language, carried) -> bool:  # noqa: ANN001
            if not Shapes.can(lang, e, wanted):
                return False
            data = code.encode() if isinstance(code, str) else bytes(code)
            if 0 < e.max_source_bytes < len(data):
                return False  # said by _parsed
            if lang.name not in by_shape:
                by_shape[lang.name] = Shapes(lang, e, wanted, keep)
            return by_shape[lang.name].add(path, data, carried)

        def add(path: str, code: str | bytes, language: str | None, carried) -> None:  # noqa: ANN001
            try:
                if language is not None and shaped(path, code, language_of(language, known), carried):
                    return
            except Exception:
                if not e.ignore_errors:
                    raise
                return
            found = _parsed(emit_columns, path, code, language, e, known, wanted)
            if found is None:
                return
            if carry is not None:
                found[carry] = [carried] * len(found["node_id"])
            marks = None if keep is None else keep(found)
            for n, values in held.items():
                values.extend(found[n] if marks is None else compress(found[n], marks))

        for batch in batches:
            given = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                code = given["content"][i].as_py()
                if code is None:
                    continue
                collects = gc.isenabled()
                gc.disable()  # a file's nodes make no cycles and are all gone when it is done
                try:
                    add(given["file_path"][i].as_py(), code, given["language"][i].as_py(), None if carry is None else given[carry][i].as_py())
                finally:
                    if collects:
                        gc.enable()
                size = len(held[kept])
                if size >= BATCH_ROWS:
                    yield from given_out(held, size)
                    held.update({n: [] for n in held})
                for shapes in by_shape.values():
                    if shapes.rows >= BATCH_ROWS:
                        yield from _batches(shapes, arrow, carry, made)
        if held[kept]:
            yield from given_out(held, len(held[kept]))
        for shapes in by_shape.values():
            yield from _batches(shapes, arrow, carry, made)

    def given_out(held: dict[str, list], size: int) -> Iterator[pa.RecordBatch]:
        batches = (_batch(held, arrow, lo, min(lo + BATCH_ROWS, size)) for lo in range(0, size, BATCH_ROWS))
        yield from batches if made is None else made(pa.Table.from_batches(batches, arrow)).to_batches()

    made, schema_out = (None, schema) if then is None else then
    return sources.mapInArrow(parsed, schema_out)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression of whole paths: ** goes through folders, * and ? stay within one."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "[" and "]" in glob[k + 2 :]:
            last = glob.index("]", k + 2)
            inner = glob[k + 1 : last]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", last + 1
        elif c == "{" and "}" in glob[k:]:
            last = glob.index("}", k)
            out, k = out + "(?:" + "|".join(glob_pattern(x) for x in glob[k + 1 : last].split(",")) + ")", last + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return out


def file_rows(spark: SparkSession, files: str | list[str], language: str | None = None) -> DataFrame:
    """(file_path, content) of files, folders (of known extensions, or all for a given language) and globs, each file once.

    Spark lists and reads the files; a file that an earlier pattern took is left out of the later ones by its path, so nothing
    is shuffled to find repeats."""
    patterns = [files] if isinstance(files, str) else files
    if not isinstance(patterns, list | tuple) or not patterns:
        raise ValueError("files must be a path or a list of at least one path")
    if any(not isinstance(x, str) or not x for x in patterns):
        raise ValueError("every path must be a string that is not empty")
    parts, taken = [], []
    for given in patterns:
        path = given if "://" in given else os.path.abspath(given)
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        wild = re.search(r"[*?\[{]", path)
        if wild is None:
            folder = os.path.isdir(path) if "://" not in path else os.path.splitext(path.rstrip("/"))[1] == ""
            if folder and language is None:
                reader = reader.option("pathGlobFilter", "*{" + ",".join(sorted(extensions())) + "}")
            whole, base = re.escape(path.rstrip("/")) + ("/.*" if folder else ""), path
        else:
            base = path[: path.rindex("/", 0, wild.start())] or "/"
            tail = path.rsplit("/", 1)[-1]
            if "**" not in tail:
                reader = reader.option("pathGlobFilter", tail)
            whole = glob_pattern(path)
        rows = reader.load(base).select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), "content")
        rows = rows.filter(F.col("file_path").rlike(f"^(?:{whole})$"))
        for other in taken:
            rows = rows.filter(~F.col("file_path").rlike(other))
        parts.append(rows)
        taken.append(f"^(?:{whole})$")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_ast(spark: SparkSession, files: str | list[str], language: str | None = None, **given) -> DataFrame:  # noqa: ANN003
    """Nodes of files, folders and globs (** looks below); one task holds one file at a time. An unknown language fails unless ignore_errors."""
    e = extraction(**given)
    if language is not None:
        language_of(language)
    return parse_rows(file_rows(spark, files, language).withColumn("language", F.lit(language) if language else detect_language("file_path")), e)


read_ast_flat = read_ast


def parse_ast(spark: SparkSession, code: str, language: str, **given) -> DataFrame:  # noqa: ANN003
    """Nodes of one string."""
    language_of(language)
    sources = spark.createDataFrame([("<inline>", code, language)], "file_path string, content string, language string")
    return parse_rows(sources, extraction(**given))


def parse_column(df: DataFrame, key: str, content: str, language: str, **given) -> DataFrame:  # noqa: ANN003
    """Nodes of a column of strings, with the row's key as text for file_path and as itself."""
    language_of(language)
    sources = df.select(F.col(key), F.col(key).cast("string").alias("file_path"), F.col(content).alias("content"), F.lit(language).alias("language"))
    return parse_rows(sources, extraction(**given), carry=key)


def parse_list(code: Column | str, language: Column | str, **given) -> Column:  # noqa: ANN003
    """The nodes of a text as a list of structs, for columns of texts and languages; a null in either gives null."""
    e, known = extraction(**given), dict(LANGUAGES)
    kind = T.ArrayType(schema_for(e))
    arrow = to_arrow_schema(T.StructType([T.StructField("x", kind)])).field("x").type

    @F.arrow_udf(kind)
    def parsed(codes: pa.Array, languages: pa.Array) -> pa.Array:
        pairs = zip(codes.to_pylist(), languages.to_pylist(), strict=True)
        return pa.array([None if c is None or k is None else list(_nodes("<inline>", c, k, e, known)) for c, k in pairs], arrow)

    return parsed(code, language)


#: Columns of the nested schemas, by their struct.
NESTED = {
    "source": ("file_path", "language", "start_line", "end_line", "start_column", "end_column"),
    "structure": ("parent_id", "depth", "sibling_index", "children_count", "descendant_count", "scope"),
    "context": ("name", "qualified_name", "semantic_type", "flags"),
}
NATIVE = ("signature_type", "parameters", "modifiers", "annotations")


def hierarchical(nodes: DataFrame) -> DataFrame:
    """node_id, type, source, structure, context (with native) and peek; columns that nodes lack are left out of their struct."""
    have = set(nodes.columns)
    native = [c for c in NATIVE if c in have]
    parts = {name: [F.col(c) for c in columns if c in have] for name, columns in NESTED.items()}
    if native:
        parts["context"].append(F.struct(*native).alias("native"))
    return nodes.select("node_id", "type", *(F.struct(*c).alias(n) for n, c in parts.items() if c), *(["peek"] if "peek" in have else []))


def read_ast_hierarchical(spark: SparkSession, files: str | list[str], language: str | None = None, **given) -> DataFrame:  # noqa: ANN003
    return hierarchical(read_ast(spark, files, language, **{"source": "full"} | given))


def parse_ast_hierarchical(spark: SparkSession, code: str, language: str, **given) -> DataFrame:  # noqa: ANN003
    return hierarchical(parse_ast(spark, code, language, **{"source": "full"} | given))


def type_map(spark: SparkSession, language: str | None = None) -> DataFrame:
    """Node types of the front-ends with what they mean, by language, kind and type."""
    kinds = {0xF0: "definition", 0x40: "literal", 0x50: "name", 0x70: "type", 0x90: "flow"}
    roles = ("none", "reference", "declaration", "definition")
    rows = []
    for x in [language_of(language)] if language else LANGUAGES.values():
        for name, (st, flags) in x.types.items():
            kind = kinds.get(st & 0xF0, X.KINDS[st >> 4].lower())
            rows.append((x.name, name, X.TYPES[st >> 2], kind, roles[flags >> 1 & 3], flags, bool(flags & X.IS_SCOPE), bool(flags & X.IS_SYNTAX_ONLY), x.strategies.get(name, "none").lower()))
    schema = "language string, node_type string, semantic_type string, kind string, name_role string, flags int, is_scope boolean, is_syntax boolean, name_strategy string"
    return spark.createDataFrame(rows, schema).orderBy("language", "kind", "node_type")


def semantic_type_codes(spark: SparkSession) -> DataFrame:
    """The 64 codes of the taxonomy with the names of their parts."""
    code = F.col("code")
    return spark.range(64).select((F.col("id") * 4).cast("short").alias("code")).select(
        "code", X.get_super_kind(code).alias("super_kind_name"), X.get_kind(code).alias("kind_name"), X.semantic_type_to_string(code).alias("super_type_name"), X.semantic_type_to_string(code).alias("full_name")
    )


def register_sql(spark: SparkSession) -> None:
    """The SQL table functions parse_ast(code, language), also for LATERAL joins, and read_ast(TABLE(...)) over (path, content)
    rows, such as those of binaryFile."""
    schema, known, e = schema_for(Extraction()), dict(LANGUAGES), Extraction()
    names = schema.names
    by_extension = {x: lang.name for lang in known.values() for x in lang.extensions}

    class ParseAst:
        def eval(self, code: str, language: str):  # noqa: ANN202
            if code is not None and language is not None:
                for row in _nodes("<inline>", code, language, e, known):
                    yield tuple(row[n] for n in names)

    class ReadAst:
        def eval(self, row):  # noqa: ANN001, ANN202
            path = re.sub("^file:/*", "/", row["path"])
            language = by_extension.get(os.path.splitext(path)[1].lower())
            if language is not None and row["content"] is not None:
                for node in _nodes(path, bytes(row["content"]), language, e, known):
                    yield tuple(node[n] for n in names)

    spark.udtf.register("parse_ast", F.udtf(ParseAst, returnType=schema))
    spark.udtf.register("read_ast", F.udtf(ReadAst, returnType=schema))


def write_index(nodes: DataFrame, path: str) -> None:
    """A node table as compressed Parquet, by language and in file order, so that scans of a file or a span skip row groups."""
    nodes.repartition("language", "file_path").sortWithinPartitions("language", "file_path", "node_id").write.partitionBy("language").option("compression", "zstd").mode("overwrite").parquet(path)


def save_index(nodes: DataFrame, name: str, buckets: int = 64, path: str | None = None) -> None:
    """A node table as a catalogue table, bucketed by file and in file order: joins and windows by file need no shuffle."""
    writer = nodes.repartition(buckets, "file_path").write.format("parquet").bucketBy(buckets, "file_path").sortBy("file_path", "node_id").option("compression", "zstd").mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def update_index(spark: SparkSession, nodes: DataFrame, path: str) -> str:
    """The index at path with the files of nodes replaced; it is written beside the old one, whose readers are not disturbed,
    and the new place is returned. Old rows are kept by an anti join on the few new paths, so they are not sorted anew."""
    import uuid

    old = spark.read.parquet(path)
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    kept = old.join(nodes.select("file_path").distinct(), "file_path", "left_anti").select(*nodes.columns)
    write_index(kept.unionByName(nodes), fresh)
    return fresh
