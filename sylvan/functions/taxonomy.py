"""The semantic taxonomy of syntax nodes: byte codes, names, aliases, and predicates as column expressions.

A code has four two-bit fields: super-kind, kind, super-type, refinement. Everything here compiles to bit arithmetic or a
literal map, so filters stay inside generated code and can be pushed into scans.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the 16 kinds, and of the 4 types of each, from code 0 on in steps of 16 and 4.
KINDS = """PARSER_SPECIFIC RESERVED METADATA EXTERNAL LITERAL NAME PATTERN TYPE EXECUTION FLOW_CONTROL ERROR_HANDLING
ORGANIZATION OPERATOR COMPUTATION_NODE TRANSFORM DEFINITION""".split()
TYPES = """PARSER_CONSTRUCT PARSER_DELIMITER PARSER_PUNCTUATION PARSER_SYNTAX
RESERVED_FUTURE1 RESERVED_FUTURE2 RESERVED_FUTURE3 RESERVED_FUTURE4
METADATA_COMMENT METADATA_ANNOTATION METADATA_DIRECTIVE METADATA_DEBUG
EXTERNAL_IMPORT EXTERNAL_EXPORT EXTERNAL_FOREIGN EXTERNAL_EMBED
LITERAL_NUMBER LITERAL_STRING LITERAL_ATOMIC LITERAL_STRUCTURED
NAME_IDENTIFIER NAME_QUALIFIED NAME_SCOPED NAME_ATTRIBUTE
PATTERN_DESTRUCTURE PATTERN_COLLECT PATTERN_TEMPLATE PATTERN_MATCH
TYPE_PRIMITIVE TYPE_COMPOSITE TYPE_REFERENCE TYPE_GENERIC
EXECUTION_STATEMENT EXECUTION_DECLARATION EXECUTION_STATEMENT_CALL EXECUTION_MUTATION
FLOW_CONDITIONAL FLOW_LOOP FLOW_JUMP FLOW_SYNC
ERROR_TRY ERROR_CATCH ERROR_THROW ERROR_FINALLY
ORGANIZATION_BLOCK ORGANIZATION_LIST ORGANIZATION_SECTION ORGANIZATION_CONTAINER
OPERATOR_ARITHMETIC OPERATOR_LOGICAL OPERATOR_COMPARISON OPERATOR_ASSIGNMENT
COMPUTATION_CALL COMPUTATION_ACCESS COMPUTATION_EXPRESSION COMPUTATION_CLOSURE
TRANSFORM_QUERY TRANSFORM_ITERATION TRANSFORM_PROJECTION TRANSFORM_AGGREGATION
DEFINITION_FUNCTION DEFINITION_VARIABLE DEFINITION_CLASS DEFINITION_MODULE""".split()
SUPER_KINDS = "META_EXTERNAL DATA_STRUCTURE CONTROL_EFFECTS COMPUTATION".split()
# Aliases of types, kinds and super-kinds in selectors; ACCESS means the operator kind.
TYPE_ALIASES = {
    240: "FUNCTION FUNC FN METHOD", 208: "CALL INVOKE", 248: "CLASS CLS STRUCT TRAIT INTERFACE", 80: "IDENTIFIER ID IDENT", 252: "MODULE MOD PACKAGE NAMESPACE NS",
    244: "VARIABLE VAR LET CONST", 144: "CONDITIONAL COND IF", 148: "LOOP FOR WHILE", 152: "JUMP RETURN BREAK CONTINUE YIELD", 212: "MEMBER ATTR FIELD PROP",
    48: "IMPORT REQUIRE USE", 52: "EXPORT PUB", 160: "TRY", 164: "CATCH EXCEPT RESCUE", 168: "THROW RAISE", 172: "FINALLY ENSURE DEFER", 68: "STR STRING",
    64: "NUM NUMBER", 72: "BOOL BOOLEAN", 76: "COLL LIST DICT ARRAY MAP SET TUPLE", 84: "QUALIFIED DOTTED", 88: "SELF THIS", 92: "LABEL", 192: "ARITH MATH",
    200: "CMP COMPARISON", 196: "LOGIC LOGICAL", 224: "COMP COMPREHENSION",
}
KIND_ALIASES = {
    240: "DEFINITION DEF", 64: "LITERAL LIT VALUE", 80: "NAME", 144: "FLOW CONTROL", 48: "EXTERNAL EXT", 160: "ERROR ERR", 192: "OPERATOR OP ACCESS", 112: "TYPEDEF TYPE",
    96: "PATTERN PAT", 176: "BLOCK", 128: "STATEMENT STMT", 0: "SYNTAX SYN", 224: "TRANSFORM XFORM", 32: "COMMENT",
}
SUPER_KIND_ALIASES = {192: "COMPUTATION"}
# The types that are worth a search.
SEARCHABLE = [240, 244, 248, 252, 208, 212, 80, 84, 48, 52, 64, 68, 144, 148, 160, 32]

CODES = {name: 4 * i for i, name in enumerate(TYPES)}
KIND_CODES = {name: 16 * i for i, name in enumerate(KINDS)}
#: Name or alias -> (mask, code).
PATTERNS = (
    {name: (0xFC, code) for name, code in CODES.items()}
    | {a: (0xC0, code) for code, names in SUPER_KIND_ALIASES.items() for a in names.split()}
    | {a: (0xF0, code) for code, names in KIND_ALIASES.items() for a in names.split()}
    | {a: (0xFC, code) for code, names in TYPE_ALIASES.items() for a in names.split()}
)

IS_SYNTAX_ONLY, NAME_REFERENCE, NAME_DECLARATION, NAME_DEFINITION, IS_SCOPE, IS_EXPORTED = 0x01, 0x02, 0x04, 0x06, 0x08, 0x10


def code(name: str) -> int:
    return CODES[name]


def _map(pairs: dict[int, str] | dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def bits(st: Column | str, mask: int) -> Column:
    return (F.col(st) if isinstance(st, str) else st).cast("int").bitwiseAND(mask)


def semantic_type_to_string(st: Column | str) -> Column:
    return F.try_element_at(_map({v: k for k, v in CODES.items()}), bits(st, 0xFC))


def get_kind(st: Column | str) -> Column:
    return F.try_element_at(_map({v: k for k, v in KIND_CODES.items()}), bits(st, 0xF0))


def get_super_kind(st: Column | str) -> Column:
    return F.try_element_at(_map({64 * i: k for i, k in enumerate(SUPER_KINDS)}), bits(st, 0xC0))


def semantic_type_code(name: Column | str) -> Column:
    return F.try_element_at(_map(CODES), F.col(name) if isinstance(name, str) else name).cast("short")


def kind_code(name: Column | str) -> Column:
    return F.try_element_at(_map(KIND_CODES), F.col(name) if isinstance(name, str) else name).cast("short")


def semantic_type_base(st: Column | str) -> Column:
    return bits(st, 0xFC).cast("short")


def is_semantic_type(st: Column | str, pattern: str | Column) -> Column:
    """pattern: a full name or an alias, case-sensitive; an unknown one is never true. A column of patterns is looked up in a
    literal map; a null one gives null."""
    if isinstance(pattern, Column):
        test = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.struct(F.lit(m).alias("mask"), F.lit(v).alias("code"))) for k, (m, v) in PATTERNS.items())), pattern)
        whole = (F.col(st) if isinstance(st, str) else st).cast("int")
        return F.when(pattern.isNotNull(), F.coalesce(whole.bitwiseAND(test["mask"]) == test["code"], F.lit(False)))
    if pattern not in PATTERNS:
        return F.lit(False)
    mask, value = PATTERNS[pattern]
    return bits(st, mask) == value


def is_kind(st: Column | str, kind: str) -> Column:
    return bits(st, 0xF0) == KIND_CODES[kind] if kind in KIND_CODES else F.lit(False)


def is_definition(st: Column | str) -> Column:
    return bits(st, 0xF0) == 240


def is_call(st: Column | str) -> Column:
    return bits(st, 0xFC).isin(208, 136)


def is_control_flow(st: Column | str) -> Column:
    return bits(st, 0xF0) == 144


def is_identifier(st: Column | str) -> Column:
    return bits(st, 0xFC).isin(80, 84, 88)


def is_parser_specific(st: Column | str) -> Column:
    return bits(st, 0xF0) == 0


def is_punctuation(st: Column | str) -> Column:
    return bits(st, 0xFC).isin(4, 8)


def get_searchable_types() -> Column:
    return F.array(*(F.lit(x).cast("short") for x in SEARCHABLE))


def is_syntax_only(flags: Column | str) -> Column:
    return bits(flags, IS_SYNTAX_ONLY) != 0


def is_construct(flags: Column | str) -> Column:
    return bits(flags, IS_SYNTAX_ONLY) == 0


def is_name_definition(flags: Column | str) -> Column:
    return bits(flags, 6) == NAME_DEFINITION


def is_name_declaration(flags: Column | str) -> Column:
    return bits(flags, 6) == NAME_DECLARATION


def is_name_reference(flags: Column | str) -> Column:
    return bits(flags, 6) == NAME_REFERENCE


def binds_name(flags: Column | str) -> Column:
    return bits(flags, 4) != 0


def name_role(flags: Column | str) -> Column:
    return F.shiftright(bits(flags, 6), 1)


def is_scope(flags: Column | str) -> Column:
    return bits(flags, IS_SCOPE) != 0


def is_exported(flags: Column | str) -> Column:
    return bits(flags, IS_EXPORTED) != 0


is_declaration_only, has_body, is_embodied = is_name_declaration, is_name_definition, is_name_definition


# Predicate names and the taxonomy names they test; a name outside the taxonomy is never true.
NAMED_PREDICATES = {
    "is_function_definition": "DEFINITION_FUNCTION", "is_class_definition": "DEFINITION_CLASS", "is_variable_definition": "DEFINITION_VARIABLE", "is_module_definition": "DEFINITION_MODULE",
    "is_type_definition": "DEFINITION_TYPE", "is_function_call": "COMPUTATION_CALL", "is_member_access": "COMPUTATION_ACCESS", "is_string_literal": "LITERAL_STRING",
    "is_number_literal": "LITERAL_NUMBER", "is_boolean_literal": "LITERAL_BOOLEAN", "is_literal": "LITERAL", "is_conditional": "FLOW_CONDITIONAL", "is_loop": "FLOW_LOOP", "is_jump": "FLOW_JUMP",
    "is_block": "ORGANIZATION_BLOCK", "is_list": "ORGANIZATION_LIST", "is_assignment": "OPERATOR_ASSIGNMENT", "is_comparison": "OPERATOR_COMPARISON", "is_arithmetic": "OPERATOR_ARITHMETIC",
    "is_logical": "OPERATOR_LOGICAL", "is_import": "EXTERNAL_IMPORT", "is_export": "EXTERNAL_EXPORT", "is_foreign": "EXTERNAL_FOREIGN", "is_comment": "METADATA_COMMENT",
    "is_annotation": "METADATA_ANNOTATION", "is_directive": "METADATA_DIRECTIVE", "is_type_primitive": "TYPE_PRIMITIVE", "is_type_composite": "TYPE_COMPOSITE",
    "is_type_reference": "TYPE_REFERENCE", "is_type_generic": "TYPE_GENERIC",
}


def named_predicate(name: str, st: Column | str) -> Column:
    return is_semantic_type(st, NAMED_PREDICATES[name])


for _name in NAMED_PREDICATES:
    globals()[_name] = (lambda n: lambda st: named_predicate(n, st))(_name)


# ---- strings ----


def string_contains_any(s: Column | str, patterns: Column | list[str]) -> Column:
    """Whether s holds any of the patterns; null for a null s or list, null patterns are skipped."""
    s = F.col(s) if isinstance(s, str) else s
    if isinstance(patterns, list):  # known patterns: plain contains, which stays in generated code
        known = [p for p in patterns if p is not None]
        return F.when(s.isNotNull(), reduce(lambda a, b: a | b, (s.contains(p) for p in known), F.lit(False)))
    return F.when(s.isNotNull() & patterns.isNotNull(), F.exists(F.filter(patterns, lambda p: p.isNotNull()), lambda p: F.contains(s, p)))


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def string_contains_any_i(s: Column | str, patterns: Column | list[str]) -> Column:
    """The same without regard to ASCII case."""
    low = lambda x: F.translate(x, ASCII_UPPER, ASCII_LOWER)
    s = F.col(s) if isinstance(s, str) else s
    if isinstance(patterns, list):  # one pass over the text; without (?u) Java disregards the case of ASCII letters only
        known = [re.escape(p) for p in patterns if p is not None]
        return F.when(s.isNotNull(), s.rlike(f"(?i){'|'.join(known)}") if known else F.lit(False))
    return F.element_at(F.transform(F.array(low(s)), lambda t: string_contains_any(t, F.transform(patterns, low))), 1)


ast_peek_contains_any = string_contains_any


def qualified_name_as_string(qn: Column | str) -> Column:
    """Segments as C[Foo] F[bar] V[x][2]; null for an empty or null list."""
    qn = F.col(qn) if isinstance(qn, str) else qn
    letter = lambda st: F.try_element_at(_map({240: "F", 244: "V", 248: "C", 252: "M", 48: "I", 52: "E"}), bits(st, 0xFC))
    part = lambda s: F.concat(F.coalesce(letter(s["semantic_type"]), F.lit("?")), F.lit("["), s["name"], F.lit("]"), F.when(s["index"] > 1, F.concat(F.lit("["), s["index"].cast("string"), F.lit("]"))).otherwise(""))
    return F.when(F.size(qn) > 0, F.array_join(F.transform(qn, part), " "))


# ---- pattern text ----


def is_pattern_wildcard(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce((name == "__") | name.rlike("^__[A-Z][A-Z0-9_]*__$"), F.lit(False))


def wildcard_capture_name(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(is_pattern_wildcard(name) & (F.length(name) > 4), name.substr(F.lit(3), F.length(name) - 4))


# The forms of wildcards with signs, %__NAME<sign>__% and %__<NAME sign attribute=value ...>__%.
CLEANED = (
    (r"%__([A-Z][A-Z0-9_]*)<[^>]+>__%", "__$1__"),
    (r"%__<([A-Z_][A-Z0-9_]*)[^>]*>__%", "__$1__"),
    (r"%__<[^>]+>__%", "__"),
)
VARIADIC = (r"%__[A-Z]*<[^>]*[*+?~][^>]*>__%",)
RECURSIVE = (r"%__[A-Z]*<\*\*>__%", r"%__<[A-Z_]*\*\*[^*>]*>__%")
#: Attributes of an extended wildcard: field, expression, whether it is a number.
WILDCARD_ATTRIBUTES = (
    ("type_constraint", r"[ ]type=([A-Za-z_][A-Za-z0-9_]*)", False), ("not_type_constraint", r"not-type=([A-Za-z_][A-Za-z0-9_]*)", False), ("name_constraint", r"[ ]name=([A-Za-z_][A-Za-z0-9_]*)", False),
    ("name_pattern", r"name-pattern=([^ >]+)", False), ("semantic_constraint", r"semantic=([A-Z_]+)", False), ("min_descendants", r"min-descendants=([0-9]+)", True), ("max_descendants", r"max-descendants=([0-9]+)", True),
    ("min_children", r"min-children=([0-9]+)", True), ("max_children", r"max-children=([0-9]+)", True),
)


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_pattern(pattern: Column | str) -> Column:
    """Wildcards with signs as identifiers: %__<X* type=t>__% becomes __X__, a nameless one __."""
    p = _text(pattern)
    for form, plain in CLEANED:
        p = F.regexp_replace(p, form, plain)
    return p


def parse_html_wildcard(text: Column | str) -> Column:
    """The 15 fields of an extended wildcard: name (_ for a nameless one), signs and attributes."""
    t = _text(text)
    part = lambda r: F.nullif(F.regexp_extract(t, r, 1), F.lit(""))
    signs = {"variadic_star": t.contains("*") & ~t.contains("**"), "variadic_plus": t.contains("+"), "negate": t.contains("~"), "optional": t.contains("?"), "recursive": t.contains("**")}
    attributes = ((part(r).try_cast("int") if number else part(r)).alias(k) for k, r, number in WILDCARD_ATTRIBUTES)
    return F.struct(F.coalesce(part("<([A-Z_][A-Z0-9_]*)"), F.lit("_")).alias("name"), *(v.alias(k) for k, v in signs.items()), *attributes)


def pattern_has_variadic(pattern: Column | str) -> Column:
    return reduce(lambda a, b: a | b, (_text(pattern).rlike(r) for r in VARIADIC))


def pattern_has_recursive(pattern: Column | str) -> Column:
    return reduce(lambda a, b: a | b, (_text(pattern).rlike(r) for r in RECURSIVE))


def ast_capture(captures: Column | str, name: str) -> Column:
    """The first capture of that name."""
    c = F.col(captures) if isinstance(captures, str) else captures
    return F.get(F.try_element_at(c, F.lit(name)), F.lit(0))
