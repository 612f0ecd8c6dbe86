"""CSS-style selectors over node tables: a selector becomes column conditions, running extremes and equality joins.

A selector is read on the driver (it is one short string) and gives a plan, never a loop over rows:

* types, names, classes, attributes and most pseudo-classes are plain conditions that reach the scan;
* `A B`, :has, :calls, :scope(t) ask whether a node lies in or around another, which is one running extreme over a file's
  nodes in order; nodes that are neither candidates nor what they are compared with are filtered out before that shuffle;
* siblings are extremes by (file_path, parent_id), `A > B` and the pseudo-elements are equality joins.

Rules: a bare type also stands for all longer types with it as a prefix; `.class` is a semantic class without syntax tokens;
the operands of a combinator are their types alone (#id and .class inside them are not looked at), and what follows the last
compound filters the result; unknown names raise ValueError before anything runs. Null attributes never match, so their
negation does. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.functions import taxonomy as X
from sylvan.operators.tree import enclosing, end

#: Predicates of one's own: name -> (argument or None) -> condition. See register_predicate.
PREDICATES: dict[str, Callable[[str | None], Column]] = {}

TEXT = r"\"([^\"]*)\"|'([^']*)'"
COMPOUND = re.compile(r"(?P<element>::[\w-]+)|(?P<pseudo>:[\w-]+)|\#(?P<id>[^\s.#:\[\]()>~+,\"']+)|\.(?P<cls>[\w-]+)|(?P<attr>\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\])|(?P<type>[A-Za-z_][\w-]*|\*)")
GAP = re.compile(r"\s*([>~+])\s*|\s+")
ATTRIBUTE = re.compile(rf"\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:{TEXT}|([^\]\s]+))\s*)?\]")

# Names of attributes, pseudo-classes and pseudo-elements.
TEXT_ATTRIBUTES = {"name": "name", "annotation": "annotations", "signature": "signature_type", "peek": "peek", "qualified": "qualified_name"}
EXACT_ATTRIBUTES = ("type", "language", "semantic", "params")
MODIFIERS = {"async": ("async",), "static": ("static",), "abstract": ("abstract",), "const": ("const", "final"), "public": ("public",), "private": ("private",), "protected": ("protected",)}
ELEMENTS = ("parent", "scope", "next-sibling", "prev-sibling", "previous-sibling", "callers", "callees", "parent-definition")


@dataclass
class Compound:
    type: str | None = None
    name: str | None = None
    cls: str | None = None


@dataclass
class Selector:
    chain: list[tuple[str, Compound]] = field(default_factory=list)  # (combinator before it, compound); "" for the first
    attributes: list[tuple[str, str, str]] = field(default_factory=list)
    pseudo: list[tuple[str, str | None, bool]] = field(default_factory=list)  # name, argument, negated
    has: list[tuple[Compound, bool]] = field(default_factory=list)
    element: str | None = None


def _argument(text: str, at: int) -> tuple[str | None, int]:
    """The text between brackets at `at`, without quotes around it, and where it ends."""
    if not text.startswith("(", at):
        return None, at
    depth, quote, k = 0, "", at
    while k < len(text):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                inner = text[at + 1 : k].strip()
                whole = re.fullmatch(TEXT, inner)
                return (inner if whole is None else whole[1] if whole[1] is not None else whole[2]), k + 1
        k += 1
    raise ValueError(f"selector: a bracket is not closed in {text!r}")


def _simple(text: str, where: str) -> Compound:
    """The argument of :has: a type, #name and .class, nothing else."""
    out, at = Compound(), 0
    while at < len(text):
        m = COMPOUND.match(text, at)
        if m is None or m["attr"] or m["pseudo"] or m["element"]:
            raise ValueError(f"selector: {where} takes a type, #name and .class only, not {text!r}")
        _put(out, m)
        at = m.end()
    return out


def _put(c: Compound, m: re.Match) -> None:
    if m["type"]:
        c.type = None if m["type"] == "*" else m["type"]
    elif m["id"]:
        c.name = m["id"]
    elif m["cls"]:
        c.cls = m["cls"]


def parse_selector(text: str) -> Selector:
    out, at, text = Selector(), 0, text.strip()
    now: Compound | None = None
    sign = ""
    while at < len(text):
        gap = GAP.match(text, at)
        if gap and now is not None:
            sign, at, now = gap[1] or " ", gap.end(), None
            continue
        m = COMPOUND.match(text, at)
        if m is None:
            raise ValueError(f"selector: cannot read {text[at:]!r}")
        if now is None and not m["element"]:
            now = Compound()
            out.chain.append((sign, now))
        at = m.end()
        if m["attr"]:
            a = ATTRIBUTE.fullmatch(m["attr"])
            if a is None:
                raise ValueError(f"selector: cannot read {m['attr']!r}")
            value = next((v for v in a.groups()[2:] if v is not None), None)
            if value is None:
                raise ValueError(f"selector: attribute {a[1]!r} needs a value")
            out.attributes.append((a[1], a[2], value))
        elif m["element"]:
            out.element = m["element"][2:]
        elif m["pseudo"]:
            argument, at = _argument(text, at)
            _pseudo(out, m["pseudo"][1:], argument)
        else:
            _put(now, m)
    if not out.chain or now is None:
        raise ValueError(f"selector: {text!r} selects nothing")
    _check(out)
    return out


def _pseudo(out: Selector, name: str, argument: str | None) -> None:
    if name == "has":
        out.has.append((_simple(argument or "", ":has"), False))
    elif name == "not":
        inner = re.fullmatch(r":([\w-]+)(\(.*\))?", (argument or "").strip(), re.S)
        if inner is None:
            raise ValueError(f"selector: :not takes a pseudo-class, not {argument!r}")
        held, _ = _argument(inner[2] or "", 0)
        if inner[1] == "has":
            out.has.append((_simple(held or "", ":has"), True))
        else:
            out.pseudo.append((inner[1], held, True))
    else:
        out.pseudo.append((name, argument, False))


def _check(s: Selector) -> None:
    """Everything that is unknown raises here, whatever the data hold."""
    if len(s.chain) > 1 and any(c.type is None for _, c in s.chain):
        raise ValueError("selector: the operands of a combinator need a type")
    for name, op, value in s.attributes:
        if name not in TEXT_ATTRIBUTES and name not in EXACT_ATTRIBUTES and name != "modifier":
            raise ValueError(f"selector: unknown attribute {name!r}")
        if name in EXACT_ATTRIBUTES and op != "=":
            raise ValueError(f"selector: attribute {name!r} allows = only, not {op!r}")
        if op not in (("=", "*=") if name == "modifier" else ("=", "*=", "^=", "$=")):
            raise ValueError(f"selector: attribute {name!r} does not allow {op!r}")
        if name == "params" and not value.strip().isdigit():
            raise ValueError(f"selector: params needs a number, not {value!r}")
    for name, argument, _ in s.pseudo:
        if name not in PSEUDO and name not in PREDICATES:
            raise ValueError(f"selector: unknown pseudo-class {name!r}")
        if name in ("nth-child", "precedes", "follows", "match", "contains") and not argument:
            raise ValueError(f"selector: {name!r} needs an argument")
    if sum(n in ("match", "contains") for n, _, _ in s.pseudo) > 1:
        raise ValueError("selector: one of :match and :contains is allowed")
    if s.element is not None and s.element not in ELEMENTS:
        raise ValueError(f"selector: unknown pseudo-element {s.element!r}")


# ---- conditions ----


def of_type(type_: str | None) -> Column:
    """The type, or a longer one that begins with it."""
    return F.lit(True) if type_ is None else F.col("type").startswith(type_)


def _class(name: str) -> Column:
    return X.is_semantic_type("semantic_type", name.upper()) & X.is_construct("flags")


def _compound(c: Compound, exact: bool = False) -> Column:
    found = (F.lit(True) if c.type is None else F.col("type") == c.type) if exact else of_type(c.type)
    if c.name is not None:
        found = found & (F.col("name") == c.name)
    return found & _class(c.cls) if c.cls is not None else found


def _attribute(name: str, op: str, value: str) -> Column:
    if name in ("type", "language"):
        return F.col(name) == value
    if name == "semantic":
        return X.is_semantic_type("semantic_type", value.upper())
    if name == "params":
        return F.size("parameters") == int(value)
    if name == "modifier":
        return F.array_contains("modifiers", value)
    text = X.qualified_name_as_string("qualified_name") if name == "qualified" else F.col(TEXT_ATTRIBUTES[name])
    return {"=": lambda: text == value, "*=": lambda: text.contains(value), "^=": lambda: text.startswith(value), "$=": lambda: text.endswith(value)}[op]()


def _named() -> Column:
    return F.coalesce(F.col("name"), F.lit("")) != ""


def is_call_node() -> Column:
    return X.bits("semantic_type", 0xFC) == X.CODES["COMPUTATION_CALL"]


def _is_function() -> Column:
    return X.bits("semantic_type", 0xFC) == X.CODES["DEFINITION_FUNCTION"]


def _modifier(*names: str) -> Column:
    return reduce(lambda a, b: a | b, (F.array_contains("modifiers", n) for n in names))


#: Pseudo-classes that look at their own node only.
PLAIN: dict[str, Callable[[str | None], Column]] = {
    "first-child": lambda _: F.col("sibling_index") == 0,
    "nth-child": lambda k: F.col("sibling_index") == int(k) - 1,
    "empty": lambda _: F.col("children_count") == 0,
    "root": lambda _: F.col("depth") == 0,
    "named": lambda _: _named(),
    "syntax": lambda _: X.is_syntax_only("flags"),
    "definition": lambda _: X.is_name_definition("flags"),
    "reference": lambda _: X.is_name_reference("flags"),
    "declaration": lambda _: X.is_name_declaration("flags"),
    "exported": lambda _: X.is_exported("flags"),
    "decorated": lambda _: F.coalesce(F.col("annotations"), F.lit("")) != "",
    "typed": lambda _: F.coalesce(F.col("signature_type"), F.lit("")) != "",
    "void": lambda _: F.coalesce(F.col("signature_type"), F.lit("")).isin("", "void", "None"),
    "variadic": lambda _: F.exists("parameters", lambda p: F.coalesce(p["name"].contains("*") | p["name"].contains("..."), F.lit(False)) | F.coalesce(p["type"].contains("*") | p["type"].contains("..."), F.lit(False))),
} | {name: (lambda names: lambda _: _modifier(*names))(names) for name, names in MODIFIERS.items()}
#: Those that look at others.
RELATED = ("last-child", "calls", "called-by", "is-called", "is-referenced", "match", "contains", "scope", "precedes", "follows")
PSEUDO = (*PLAIN, *RELATED)


def register_predicate(name: str, condition: Callable[[str | None], Column]) -> None:
    """A pseudo-class of one's own: condition(argument) over the columns of a node."""
    if name in PSEUDO:
        raise ValueError(f"{name!r} is a pseudo-class already")
    PREDICATES[name] = condition


# ---- the plan ----


class _Plan:
    """Columns that answer questions about other nodes; all running extremes of one order share a shuffle and a sort."""

    def __init__(self, nodes: DataFrame) -> None:
        self.columns, self.nodes = nodes.columns, nodes
        self.asked: list[tuple[str, Column]] = []  # columns by window
        self.partners: list[Column] = []  # what must stay for them
        self.joins: list[Callable[[DataFrame], DataFrame]] = []

    def _name(self) -> str:
        return f"_s{len(self.asked) + len(self.joins)}"

    def ask(self, partner: Column, answer: Column) -> Column:
        name = self._name()
        self.partners.append(partner)
        self.asked.append((name, answer))
        return F.coalesce(F.col(name), F.lit(False))

    def below(self, match: Column) -> Column:
        after = Window.partitionBy("file_path").orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)
        return self.ask(match, F.min(F.when(match, F.col("node_id"))).over(after) <= end())

    def above(self, match: Column) -> Column:
        before = Window.partitionBy("file_path").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
        return self.ask(match, F.max(F.when(match, end())).over(before) >= F.col("node_id"))

    def sibling(self, match: Column, answer: Callable[[Column, Column], Column]) -> Column:
        """answer(least, greatest place of a matching sibling)"""
        family, place = Window.partitionBy("file_path", "parent_id"), F.when(match, F.col("sibling_index"))
        return self.ask(match, F.col("parent_id").isNotNull() & answer(F.min(place).over(family), F.max(place).over(family)))

    def beside(self, match: Column) -> Column:
        """Whether the sibling just before matches."""
        before = Window.partitionBy("file_path", "parent_id").orderBy("sibling_index").rangeBetween(-1, -1)
        return self.ask(match, F.col("parent_id").isNotNull() & F.coalesce(F.max(match.cast("int")).over(before) == 1, F.lit(False)))

    def joined(self, other: DataFrame, keys: list[str], answer: Column) -> Column:
        """A left join by equality; other has one row for each key."""
        name = self._name()
        self.joins.append(lambda df: df.join(other, keys, "left").withColumn(name, answer).drop(*(c for c in other.columns if c not in keys)))
        return F.coalesce(F.col(name), F.lit(False))

    def run(self, base: Column, rest: Column) -> DataFrame:
        df = self.nodes
        if self.asked:
            # Windows of one order are neighbours, so they share their sort.
            df = df.filter(reduce(lambda a, b: a | b, self.partners, base))
            for name, answer in self.asked:
                df = df.withColumn(name, answer)
        df = df.filter(base)
        for join in self.joins:
            df = join(df)
        return df.filter(rest).select(*self.columns)


def _uses(nodes: DataFrame, match: Column) -> DataFrame:
    """How often a name is used in a file, and where first."""
    found = nodes.filter(match & _named())
    return found.groupBy("file_path", "name").agg(F.count("*").alias("_uses"), F.min("node_id").alias("_first"))


def pattern_starts(nodes: DataFrame, pattern: list[tuple[str, str | None]]) -> DataFrame:
    """(file_path, node_id) where the nodes from there on have the types and names of the pattern, one after the other.

    An equality join with the pattern's few rows and a count by the place the match would begin at."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i, t, n or None) for i, (t, n) in enumerate(pattern)], "_i int, type string, _n string")
    name_fits = F.col("_n").isNull() | (F.col("_n") == "___") | (F.col("name") == F.col("_n"))
    hits = nodes.select("file_path", "node_id", "type", "name").join(F.broadcast(wanted), "type").filter(F.coalesce(name_fits, F.lit(False)))
    starts = hits.groupBy("file_path", (F.col("node_id") - F.col("_i")).alias("node_id")).agg(F.count("*").alias("_k"))
    return starts.filter(F.col("_k") == len(pattern)).select("file_path", "node_id")


def _related(plan: _Plan, nodes: DataFrame, name: str, argument: str | None, code: Callable[[str], list[tuple[str, str | None]]]) -> Column:
    by_name = F.lit(True) if argument is None else F.col("name") == argument
    if name == "last-child":
        return plan.sibling(F.lit(True), lambda least, most: F.col("sibling_index") == most) | F.col("parent_id").isNull()
    if name == "calls":
        return plan.below(F.coalesce(is_call_node() & by_name, F.lit(False)))
    if name == "called-by":
        if argument is None:
            return plan.above(_is_function())
        owners = nodes.filter(_is_function()).select("file_path", F.col("node_id").alias("_owner"), (F.col("name") == argument).alias("_is"))
        plan_name = plan._name()
        plan.joins.append(lambda df: df.withColumn("_owner", F.col("scope.function")).join(owners, ["file_path", "_owner"], "left").withColumnRenamed("_is", plan_name).drop("_owner"))
        return F.coalesce(F.col(plan_name), F.lit(False))
    if name in ("is-called", "is-referenced"):
        uses = _uses(nodes, is_call_node() if name == "is-called" else X.is_name_reference("flags"))
        return X.is_name_definition("flags") & _named() & plan.joined(uses, ["file_path", "name"], (F.col("_uses") > 1) | (F.col("_first") != F.col("node_id")))
    if name == "scope":
        return X.is_scope("flags") if argument is None else plan.above(of_type(argument))
    if name == "precedes":
        return plan.sibling(of_type(argument), lambda least, most: F.col("sibling_index") < most)
    if name == "follows":
        return plan.sibling(of_type(argument), lambda least, most: F.col("sibling_index") > least)
    pattern = code(argument)
    if not pattern:
        return F.lit(False)
    starts = pattern_starts(nodes, pattern).withColumn("_starts", F.lit(True))
    plan.nodes = plan.nodes.join(starts, ["file_path", "node_id"], "left")
    fits = F.coalesce(F.col("_starts"), F.lit(False))
    if name == "match":
        return fits & (F.col("descendant_count") >= len(pattern) - 1)
    after = Window.partitionBy("file_path").orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, 0)
    return plan.ask(fits, F.min(F.when(fits, F.col("node_id"))).over(after) + (len(pattern) - 1) <= end())


def code_of(nodes: DataFrame, text: str) -> list[tuple[str, str | None]]:
    """Types and names of a piece of code, read as the language of the first row."""
    from sylvan.sources.nodes import extraction
    from sylvan.sources.reader import nodes_of_text

    first = nodes.select("language").filter("language is not null").first()
    if first is None:
        return []
    rows = nodes_of_text(text, first[0], extraction(peek="none"))
    # What surrounds the code only because it stands alone is no part of the pattern.
    while len(rows) > 1 and rows[0]["type"] in ("module", "program", "source_file", "document", "expression_statement") and rows[0]["descendant_count"] == len(rows) - 1 and rows[0]["children_count"] == 1:
        rows = rows[1:]
    return [(r["type"], r["name"] or None) for r in rows]


def select_from(nodes: DataFrame, selector: str, ordered: bool = True) -> DataFrame:
    """Nodes that the selector matches, or those its pseudo-element leads to, by file and number."""
    s = parse_selector(selector)
    plan = _Plan(nodes)
    (sign, last), base = s.chain[-1], F.lit(True)
    base = _compound(last) if len(s.chain) == 1 else of_type(last.type)
    tests: list[Column] = []
    for name, op, value in s.attributes:
        base = base & F.coalesce(_attribute(name, op, value), F.lit(False))
    for name, argument, negated in s.pseudo:
        if name in PLAIN or name in PREDICATES:
            found = F.coalesce((PLAIN.get(name) or PREDICATES[name])(argument), F.lit(False))
            base = base & (~found if negated else found)
        else:
            found = _related(plan, nodes, name, argument, lambda text: code_of(nodes, text))
            tests.append(~found if negated else found)
    for held, negated in s.has:
        found = plan.below(F.coalesce(_compound(held, exact=True), F.lit(False)))
        tests.append(~found if negated else found)
    if len(s.chain) == 2:
        left = of_type(s.chain[0][1].type)
        if sign == " ":
            tests.append(plan.above(left))
        elif sign == "~":
            tests.append(plan.sibling(left, lambda least, most: F.col("sibling_index") > least))
        elif sign == "+":
            tests.append(plan.beside(left))
        else:
            parents = nodes.filter(left).select("file_path", F.col("node_id").alias("parent_id")).withColumn("_p", F.lit(True))
            tests.append(plan.joined(parents, ["file_path", "parent_id"], F.col("_p")))
    elif len(s.chain) > 2:
        tests.append(_in_chain(plan, nodes, s.chain))
    if any(n == "peek" for n, _, _ in s.attributes) and "peek" in nodes.columns and nodes.filter("peek is not null").isEmpty() and not nodes.isEmpty():
        raise ValueError("selector: [peek] needs source text, and the peek column is null throughout; parse with peek='full'")
    matched = plan.run(F.coalesce(base, F.lit(False)), reduce(lambda a, b: a & b, tests, F.lit(True)))
    out = _led_to(nodes, matched, s.element) if s.element else matched
    return out.orderBy("file_path", "node_id") if ordered else out


def _in_chain(plan: _Plan, nodes: DataFrame, chain: list[tuple[str, Compound]]) -> Column:
    """A chain of more than two compounds is resolved from the left: each step's matches are what the next is compared with."""
    first = chain[0][1].type
    kept = nodes.filter(of_type(first))
    for k, (sign, c) in enumerate(chain[1:], 1):
        marked = nodes.join(kept.select("file_path", "node_id").withColumn("_in", F.lit(True)), ["file_path", "node_id"], "left")
        left, step = F.coalesce(F.col("_in"), F.lit(False)), _Plan(marked)
        if sign == " ":
            found = step.above(left)
        elif sign == "~":
            found = step.sibling(left, lambda least, most: F.col("sibling_index") > least)
        elif sign == "+":
            found = step.beside(left)
        else:
            found = step.joined(kept.select("file_path", F.col("node_id").alias("parent_id")).withColumn("_p", F.lit(True)), ["file_path", "parent_id"], F.col("_p"))
        kept = step.run(of_type(c.type), found).drop("_in")
    return plan.joined(kept.select("file_path", "node_id").withColumn("_q", F.lit(True)), ["file_path", "node_id"], F.col("_q"))


def _led_to(nodes: DataFrame, matched: DataFrame, element: str) -> DataFrame:
    """The nodes that a pseudo-element names, from the matched ones."""
    names = nodes.columns
    if element in ("callers", "callees"):
        calls = nodes.filter(is_call_node() & _named())
        if element == "callers":
            m = matched.filter(_named()).select("file_path", "name", F.col("node_id").alias("_m"))
            sites = calls.select("file_path", "name", "node_id", F.col("scope.function").alias("_f")).join(m, ["file_path", "name"]).filter("node_id <> _m and _f is not null")
            keys = sites.select("file_path", F.col("_f").alias("node_id")).distinct()
            return nodes.join(keys, ["file_path", "node_id"], "left_semi").select(*names)
        keys = matched.select("file_path", "node_id").withColumn("_in", F.lit(True))
        plan = _Plan(nodes.join(keys, ["file_path", "node_id"], "left"))
        found = plan.above(F.coalesce(F.col("_in"), F.lit(False)))
        return plan.run(is_call_node() & _named(), found).select(*names)
    if element == "parent-definition":
        keys = enclosing(nodes, X.is_name_definition("flags") & _named(), matched).select("file_path", F.col("holder_id").alias("node_id")).distinct()
        return nodes.join(keys, ["file_path", "node_id"], "left_semi").select(*names)
    m = matched.alias("m")
    n = nodes.alias("n")
    same = F.col("m.file_path") == F.col("n.file_path")
    on = {
        "parent": F.col("n.node_id") == F.col("m.parent_id"),
        "scope": F.col("n.node_id") == F.col("m.scope.current"),
        "next-sibling": (F.col("n.parent_id") == F.col("m.parent_id")) & (F.col("n.sibling_index") == F.col("m.sibling_index") + 1),
        "prev-sibling": (F.col("n.parent_id") == F.col("m.parent_id")) & (F.col("n.sibling_index") == F.col("m.sibling_index") - 1),
    }
    return m.join(n, same & on["prev-sibling" if element == "previous-sibling" else element]).select("n.*")


def select(spark: SparkSession, files: str | list[str], selector: str, language: str | None = None, **given) -> DataFrame:  # noqa: ANN003
    """select_from over files; source text is kept only where the selector asks for it."""
    from sylvan.sources.reader import read_ast

    given.setdefault("peek", "full" if "[peek" in selector else "none+schema")
    return select_from(read_ast(spark, files, language, **given), selector)


# ---- rules ----

RULE = re.compile(r"([^{}]+)\{([^{}]*)\}", re.S)


def parse_rules(css: str) -> list[tuple[int, str, dict[str, str]]]:
    """(number, selector, declarations) of each rule; a rule with several selectors gives one for each."""
    css = re.sub(r"/\*.*?\*/", " ", css, flags=re.S)
    out = []
    for m in RULE.finditer(css):
        declared = {k.strip(): v.strip() for k, _, v in (d.partition(":") for d in m[2].split(";") if ":" in d)}
        out += [(s, declared) for s in (x.strip() for x in re.split(r",(?![^(\[]*[)\]])", m[1])) if s]
    return [(i, s, d) for i, (s, d) in enumerate(out)]


def select_rules(nodes: DataFrame, css: str) -> DataFrame:
    """(rule_index, selector, declarations, and the columns of nodes) for each rule and match; a rule without a match has one
    row of nulls. Rules are few: each is a branch of one union over the same nodes."""
    rules = parse_rules(css)
    for _, s, _ in rules:
        parse_selector(s)
    dim = nodes.sparkSession.createDataFrame(rules, "rule_index int, selector string, declarations map<string,string>")
    parts = [select_from(nodes, s, ordered=False).withColumn("rule_index", F.lit(i)) for i, s, _ in rules]
    if not parts:
        return dim.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    return dim.join(found, "rule_index", "left").select("rule_index", "selector", "declarations", *nodes.columns)


def select_list(nodes: DataFrame, css: str) -> DataFrame:
    """One row for each rule, its matches as a list by file and number."""
    rows = select_rules(nodes, css)
    key = F.struct("file_path", "node_id", *(c for c in nodes.columns if c not in ("file_path", "node_id")))
    packed = rows.groupBy("rule_index", "selector").agg(F.first("declarations").alias("declarations"), F.sort_array(F.collect_list(F.when(F.col("node_id").isNotNull(), key))).alias("matches"))
    return packed.orderBy("rule_index")
