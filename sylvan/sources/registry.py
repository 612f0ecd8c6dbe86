"""Languages of one's own: a parser and a JSON description of what its node types mean.

A parser takes the bytes of a file and gives a tree of Raw nodes; Spark ships it to the tasks. Registration is off until
spark.sylvan.registerLanguages is true, as it runs foreign code.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylvan.functions import taxonomy as X
from sylvan.sources.nodes import Language, Raw
from sylvan.sources.reader import LANGUAGES, extensions

# Flag names, and how a node without a name may get one.
FLAGS = {"IS_SYNTAX_ONLY": X.IS_SYNTAX_ONLY, "NAME_REFERENCE": X.NAME_REFERENCE, "NAME_DECLARATION": X.NAME_DECLARATION, "NAME_DEFINITION": X.NAME_DEFINITION, "IS_SCOPE": X.IS_SCOPE, "IS_EXPORTED": X.IS_EXPORTED}
STRATEGIES = ("NONE", "NODE_TEXT", "FIRST_CHILD", "FIND_IDENTIFIER", "FIND_PROPERTY", "FIND_ASSIGNMENT_TARGET", "FIND_QUALIFIED_IDENTIFIER", "FIND_IN_DECLARATOR", "FIND_CALL_TARGET")
ENTRY = ("semantic_type", "refinement", "name_strategy", "flags")
#: Languages that come with the package cannot be replaced.
BUILT_IN = frozenset(LANGUAGES)
SETTING = "spark.sylvan.registerLanguages"


def read_config(text: str, name: str) -> tuple[dict[str, tuple[int, int]], dict[str, str]]:
    """(type: (semantic type, flags)), (type: strategy) of a description; anything unknown raises ValueError."""
    try:
        config = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"config: not JSON: {error}") from error
    if not isinstance(config, dict):
        raise ValueError("config: must be an object")
    if unknown := set(config) - {"language", "node_types"}:
        raise ValueError(f"config: unknown key {sorted(unknown)[0]!r}")
    if config.get("language", name) != name:
        raise ValueError(f"config: is for language {config['language']!r}, not {name!r}")
    if not isinstance(config.get("node_types"), dict):
        raise ValueError("config: node_types is missing or not an object")
    types, strategies = {}, {}
    for kind, entry in config["node_types"].items():
        types[kind], strategies[kind] = _entry(kind, entry)
    return types, strategies


def _entry(kind: str, entry: object) -> tuple[tuple[int, int], str]:
    def wrong(what: str) -> ValueError:
        return ValueError(f"config: node type {kind!r}: {what}")

    if not isinstance(entry, dict):
        raise wrong("must be an object")
    if "native_strategy" in entry:
        raise wrong("native_strategy needs a built-in language")
    if unknown := set(entry) - set(ENTRY):
        raise wrong(f"unknown key {sorted(unknown)[0]!r}")
    if entry.get("semantic_type") not in X.CODES:
        raise wrong(f"semantic_type {entry.get('semantic_type')!r} is missing or unknown")
    refinement = entry.get("refinement", 0)
    if not isinstance(refinement, int) or isinstance(refinement, bool) or not 0 <= refinement <= 3:
        raise wrong(f"refinement {refinement!r} is not in 0 .. 3")
    strategy = str(entry.get("name_strategy", "NONE")).upper()
    if strategy not in STRATEGIES:
        raise wrong(f"name_strategy {strategy!r} is unknown or needs native code")
    flags = 0
    for flag in entry.get("flags", []):
        if flag not in FLAGS:
            raise wrong(f"unknown flag {flag!r}")
        flags |= FLAGS[flag]
    return (X.CODES[entry["semantic_type"]] | refinement, flags), strategy


def named(root: Raw, code: bytes, strategies: dict[str, str]) -> Raw:
    """Gives names to nodes that have none, by their type's strategy."""

    def text(n: Raw | None) -> str | None:
        return None if n is None else code[n.start : n.end].decode("utf-8", "replace")

    def first(n: Raw, *ends: str) -> Raw | None:
        return next((c for c in n.children if c.type.endswith(ends)), None)

    stack: list[tuple[Raw, Raw | None]] = [(root, None)]
    while stack:
        n, parent = stack.pop()
        stack += [(c, n) for c in n.children]
        how = strategies.get(n.type, "NONE")
        if n.name is not None or how == "NONE":
            continue
        if how == "NODE_TEXT":
            n.name = text(n)
        elif how == "FIRST_CHILD":
            n.name = text(n.children[0]) if n.children else None
        elif how == "FIND_IDENTIFIER":
            n.name = text(first(n, "identifier"))
        elif how == "FIND_PROPERTY":
            n.name = text(first(n, "property_identifier"))
        elif how == "FIND_ASSIGNMENT_TARGET":
            n.name = text(first(parent, "identifier")) if parent is not None else None
        elif how == "FIND_QUALIFIED_IDENTIFIER":
            found = first(n, "qualified_identifier", "scoped_identifier")
            n.name = text(([c for c in found.children if c.type.endswith("identifier")] or [found])[-1]) if found else text(first(n, "identifier"))
        elif how == "FIND_IN_DECLARATOR":
            inner: Raw | None = n
            while inner is not None and first(inner, "declarator") is not None:
                inner = first(inner, "declarator")
            n.name = text(first(inner, "identifier")) if inner is not None else None
        else:  # what is called: the last name of the first child
            target = n.children[0] if n.children else None
            while target is not None and target.children:
                target = next((c for c in reversed(target.children) if c.type.endswith("identifier") or c.children), None)
            n.name = text(target)
    return root


def register_language(spark: SparkSession, name: str, parser: Callable[[bytes], Raw], config: str | None = None, extensions_: tuple[str, ...] = (), aliases: tuple[str, ...] = (), overwrite: bool = False) -> DataFrame:
    """Adds a language and gives one row that sums it up; the parser is tried on an empty text."""
    if spark.conf.get(SETTING, "false").lower() != "true":
        raise PermissionError(f"languages can be registered only where {SETTING} is true")
    if not name or not callable(parser):
        raise ValueError("a language needs a name and a parser")
    if name in BUILT_IN or (name in LANGUAGES and not overwrite):
        raise ValueError(f"language {name!r} is known already")
    dotted = tuple("." + x.lower().lstrip(".") for x in extensions_)
    if "." in dotted:
        raise ValueError("extensions cannot be empty")
    for other in LANGUAGES.values():
        if other.name != name and (clash := (set(aliases) | {name}) & {other.name, *other.aliases}):
            raise ValueError(f"alias {sorted(clash)[0]!r} belongs to {other.name!r}")
    taken = {x: lang for x, lang in extensions().items() if lang != name}
    if clash := set(dotted) & set(taken):
        raise ValueError(f"extension {sorted(clash)[0]!r} belongs to {taken[sorted(clash)[0]]!r}")
    types, strategies = read_config(config, name) if config is not None else ({}, {})
    parse = lambda code: named(parser(code), code, strategies)
    parse(b"")
    LANGUAGES[name] = Language(name, dotted, parse, types, aliases, parser_type="registered", strategies=strategies)
    return spark.createDataFrame([(name, list(dotted), list(aliases), len(types))], "language string, extensions array<string>, aliases array<string>, node_type_count int")


def unregister_language(name: str) -> None:
    if name not in BUILT_IN:
        LANGUAGES.pop(name, None)
