"""Front-end for Python source: grammar nodes with all tokens, from the standard library's parser and tokenizer.

The parser gives the spans of statements and expressions. Nodes of the grammar that it has no object for (blocks, clauses,
parameter lists) are made around them, and every token that no node covers becomes a leaf of the innermost node around it.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from bisect import bisect_left
from collections.abc import Sequence

from sylvan.functions import taxonomy as X
from sylvan.sources.nodes import Language, Raw

T = X.CODES
D, S = X.NAME_DEFINITION, X.IS_SCOPE
# Grammar node types by their semantic type; refinements are added in the low bits.
BY_TYPE = {
    T["DEFINITION_FUNCTION"]: "function_definition", T["DEFINITION_CLASS"]: "class_definition", T["DEFINITION_MODULE"]: "module", T["DEFINITION_VARIABLE"]: "assignment named_expression",
    T["DEFINITION_VARIABLE"] + 2: "typed_parameter default_parameter typed_default_parameter", T["COMPUTATION_CALL"]: "call", T["COMPUTATION_CLOSURE"]: "lambda",
    T["OPERATOR_ARITHMETIC"]: "binary_operator unary_operator", T["OPERATOR_COMPARISON"]: "comparison_operator", T["OPERATOR_LOGICAL"]: "boolean_operator not_operator",
    T["OPERATOR_ASSIGNMENT"]: "augmented_assignment", T["NAME_IDENTIFIER"]: "identifier", T["NAME_QUALIFIED"]: "dotted_name", T["COMPUTATION_ACCESS"]: "attribute subscript slice",
    T["LITERAL_STRING"]: "string string_content concatenated_string interpolation", T["LITERAL_NUMBER"]: "integer", T["LITERAL_NUMBER"] + 1: "float", T["LITERAL_ATOMIC"]: "true false none ellipsis",
    T["LITERAL_STRUCTURED"]: "list tuple", T["LITERAL_STRUCTURED"] + 1: "dictionary pair", T["LITERAL_STRUCTURED"] + 2: "set", T["FLOW_CONDITIONAL"]: "if_statement else_clause elif_clause if_clause",
    T["FLOW_CONDITIONAL"] + 1: "conditional_expression", T["FLOW_CONDITIONAL"] + 2: "match_statement case_clause", T["FLOW_LOOP"] + 1: "for_statement", T["FLOW_LOOP"] + 2: "while_statement",
    T["FLOW_LOOP"]: "for_in_clause", T["FLOW_JUMP"]: "return_statement yield", T["FLOW_JUMP"] + 1: "break_statement", T["FLOW_JUMP"] + 2: "continue_statement", T["ERROR_TRY"]: "try_statement",
    T["ERROR_CATCH"]: "except_clause", T["ERROR_FINALLY"]: "finally_clause", T["ERROR_THROW"]: "raise_statement assert_statement",
    T["EXTERNAL_IMPORT"]: "import_statement import_from_statement aliased_import relative_import import_prefix wildcard_import future_import_statement", T["TYPE_REFERENCE"]: "type ->",
    T["TYPE_GENERIC"]: "generic_type", T["METADATA_COMMENT"]: "comment", T["METADATA_ANNOTATION"]: "decorator decorated_definition", T["ORGANIZATION_BLOCK"]: "block",
    T["ORGANIZATION_LIST"]: "parameters argument_list expression_list lambda_parameters", T["TRANSFORM_ITERATION"]: "list_comprehension set_comprehension dictionary_comprehension generator_expression",
    T["PATTERN_DESTRUCTURE"]: "pattern_list tuple_pattern list_pattern", T["PATTERN_COLLECT"]: "list_splat dictionary_splat list_splat_pattern dictionary_splat_pattern", T["PATTERN_MATCH"]: "case_pattern",
    T["EXECUTION_STATEMENT"]: "expression_statement pass_statement delete_statement with_statement with_clause with_item", T["EXECUTION_DECLARATION"]: "global_statement nonlocal_statement",
    T["COMPUTATION_EXPRESSION"]: "parenthesized_expression", T["FLOW_SYNC"]: "await", T["NAME_ATTRIBUTE"]: "keyword_argument", T["PARSER_PUNCTUATION"]: "( ) [ ] { } , . ; :", T["PARSER_DELIMITER"]: "string_start string_end",
}
FLAGS = {"function_definition": D | S, "class_definition": D | S, "module": S, "for_statement": S, "while_statement": S, "lambda": S, "assignment": D, "named_expression": D, "typed_parameter": D, "default_parameter": D, "typed_default_parameter": D, "identifier": X.NAME_REFERENCE, "attribute": X.NAME_REFERENCE, "type": X.NAME_REFERENCE}
TYPES = {name: (st, FLAGS.get(name, 0)) for st, names in BY_TYPE.items() for name in names.split()}
TYPES |= {k: (T["PARSER_SYNTAX"], X.IS_SYNTAX_ONLY) for k in [*keyword.kwlist, "=", "+", "-", "*", "/", "//", "%", "**", "@", "==", "!=", "<", ">", "<=", ">=", "&", "|", "^", "~", "<<", ">>", ":=", "+=", "-=", "*=", "/="] if k not in TYPES}

#: Types whose text is their name.
TEXT_NAMED = frozenset("identifier attribute string concatenated_string integer float true false none ellipsis type generic_type".split())
#: Nodes that have their own parentheses.
OWN_PARENTHESES = frozenset("parameters argument_list tuple generator_expression tuple_pattern import_from_statement with_clause call case_pattern".split())


class Builder:
    def __init__(self, code: bytes) -> None:
        self.code, self.text = code, code.decode("utf-8", "replace")
        self.lines = [0]
        for line in code.split(b"\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.tokens: list[tuple[int, int, str, str]] = []  # start, end, type, text
        rows = self.text.split("\n")
        skip = {tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
        plain = self.text.isascii() and code.isascii()
        try:
            for t in tokenize.generate_tokens(io.StringIO(self.text).readline):
                if t.type not in skip and t.string:
                    (r, c), (r2, c2) = t.start, t.end
                    a = self.lines[r - 1] + (c if plain else len(rows[r - 1][:c].encode()))
                    b = self.lines[r2 - 1] + (c2 if plain else len(rows[r2 - 1][:c2].encode()))
                    self.tokens.append((a, b, tokenize.tok_name[t.type], t.string))
        except (tokenize.TokenError, SyntaxError, IndentationError):
            pass
        self.starts = [t[0] for t in self.tokens]

    def at(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.at(n.lineno, n.col_offset), self.at(n.end_lineno, n.end_col_offset)

    def find(self, text: str, start: int, end: int) -> int:
        """Where a token of that text starts, outside brackets opened after start; -1 if nowhere."""
        depth, i = 0, bisect_left(self.starts, start)
        while i < len(self.tokens) and self.tokens[i][0] < end:
            s = self.tokens[i][3]
            if depth == 0 and s == text:
                return self.tokens[i][0]
            depth += (s in "([{") - (s in ")]}") if len(s) == 1 else 0
            i += 1
        return -1

    def back(self, text: str, start: int) -> int:
        """Where the nearest token of that text before start starts."""
        i = bisect_left(self.starts, start) - 1
        while i >= 0 and self.tokens[i][3] != text:
            i -= 1
        return self.tokens[i][0] if i >= 0 else start

    def close(self, start: int) -> int:
        """End of the bracket that opens at start."""
        depth, i = 0, bisect_left(self.starts, start)
        while i < len(self.tokens):
            s = self.tokens[i][3]
            depth += (s in "([{") - (s in ")]}") if len(s) == 1 else 0
            if depth == 0:
                return self.tokens[i][1]
            i += 1
        return len(self.code)

    # ---- statements ----

    def block(self, body: Sequence[ast.stmt]) -> Raw:
        items = [self.statement(s) for s in body]
        return Raw("block", items[0].start, items[-1].end, items)

    def clause(self, type_: str, word: str, body: Sequence[ast.stmt], *before: Raw) -> Raw:
        block = self.block(body)
        first = self.back(word, before[0].start if before else block.start)
        return Raw(type_, first, block.end, [*before, block])

    def statement(self, n: ast.stmt) -> Raw:
        a, b = self.span(n)
        kind = type(n).__name__
        if kind in ("FunctionDef", "AsyncFunctionDef", "ClassDef"):
            inner = self.definition(n, a, b)
            if not n.decorator_list:
                return inner
            marks = []
            for d in n.decorator_list:
                e = self.expression(d)
                marks.append(Raw("decorator", self.back("@", e.start), e.end, [e]))
            inner.info["annotations"] = ", ".join(self.code[m.start : m.end].decode() for m in marks)
            return Raw("decorated_definition", marks[0].start, b, [*marks, inner])
        if kind == "Expr":
            e = self.expression(n.value)
            return Raw("expression_statement", min(a, e.start), max(b, e.end), [e])
        if kind in ("Assign", "AnnAssign", "AugAssign"):
            return Raw("expression_statement", a, b, [self.assignment(n, a, b)])
        if kind in ("For", "AsyncFor", "While"):
            head = [self.target(n.target), self.expression(n.iter, bare="expression_list")] if kind != "While" else [self.expression(n.test)]
            tail = [self.clause("else_clause", "else", n.orelse)] if n.orelse else []
            return Raw("while_statement" if kind == "While" else "for_statement", a, b, [*head, self.block(n.body), *tail])
        if kind == "If":
            return Raw("if_statement", a, b, [self.expression(n.test), self.block(n.body), *self.otherwise(n)])
        if kind in ("With", "AsyncWith"):
            items = []
            for i in n.items:
                e = self.expression(i.context_expr)
                if i.optional_vars is not None:
                    v = self.target(i.optional_vars)
                    e = Raw("as_pattern", e.start, v.end, [e, Raw("as_pattern_target", v.start, v.end, [v])])
                items.append(Raw("with_item", e.start, e.end, [e]))
            return Raw("with_statement", a, b, [Raw("with_clause", items[0].start, items[-1].end, items), self.block(n.body)])
        if kind in ("Try", "TryStar"):
            parts = [self.block(n.body)]
            for h in n.handlers:
                s, e = self.span(h)
                inner = []
                if h.type is not None:
                    t = self.expression(h.type)
                    if h.name:
                        i = self.find(h.name, self.find("as", t.end, e), e)
                        t = Raw("as_pattern", t.start, i + len(h.name.encode()), [t, Raw("as_pattern_target", i, i + len(h.name.encode()), [Raw("identifier", i, i + len(h.name.encode()))])])
                    inner = [t]
                parts.append(Raw("except_clause", s, e, [*inner, self.block(h.body)]))
            if n.orelse:
                parts.append(self.clause("else_clause", "else", n.orelse))
            if n.finalbody:
                parts.append(self.clause("finally_clause", "finally", n.finalbody))
            return Raw("try_statement", a, b, parts)
        if kind in ("Import", "ImportFrom"):
            return self.imports(n, a, b)
        if kind == "Match":
            cases = []
            for c in n.cases:
                pattern = Raw("case_pattern", *self.span(c.pattern))
                guard = [Raw("if_clause", self.back("if", g.start), g.end, [g])] if c.guard is not None and (g := self.expression(c.guard)) else []
                cases.append(self.clause("case_clause", "case", c.body, pattern, *guard))
            return Raw("match_statement", a, b, [self.expression(n.subject), Raw("block", cases[0].start, cases[-1].end, cases)])
        name = {"Return": "return_statement", "Delete": "delete_statement", "Raise": "raise_statement", "Assert": "assert_statement", "Pass": "pass_statement", "Break": "break_statement", "Continue": "continue_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement"}.get(kind, kind.lower())
        return Raw(name, a, b, [self.expression(c, bare="expression_list") for c in ast.iter_child_nodes(n) if isinstance(c, ast.expr)])

    def otherwise(self, n: ast.If) -> list[Raw]:
        out: list[Raw] = []
        while n.orelse:
            rest = n.orelse
            if len(rest) == 1 and isinstance(rest[0], ast.If) and self.code.startswith(b"elif", self.span(rest[0])[0]):
                n = rest[0]
                block = self.block(n.body)
                out.append(Raw("elif_clause", self.span(n)[0], block.end, [self.expression(n.test), block]))
            else:
                out.append(self.clause("else_clause", "else", rest))
                break
        return out

    def definition(self, n: ast.stmt, a: int, b: int) -> Raw:
        body = self.block(n.body)
        inside: list[Raw] = []
        if isinstance(n, ast.ClassDef):
            opened = self.find("(", a, body.start)
            if opened >= 0:
                inside.append(self.arguments(n.bases, n.keywords, opened, self.close(opened)))
            info = {"parameters": [{"name": ast.unparse(x), "type": None} for x in n.bases]}
            return Raw("class_definition", a, b, [*inside, body], n.name, **info)
        opened = self.find("(", a, body.start)
        inside.append(self.parameters(n.args, opened, self.close(opened), "parameters"))
        signature = None
        if n.returns is not None:
            e = self.expression(n.returns)
            signature = ast.unparse(n.returns)
            inside.append(Raw("type", e.start, e.end, [e]))
        asynchronous = isinstance(n, ast.AsyncFunctionDef)
        plain = [x.attr if isinstance(x, ast.Attribute) else getattr(x, "id", "") for x in n.decorator_list]
        modifiers = ["async"] * asynchronous + [m for d, m in (("staticmethod", "static"), ("classmethod", "class"), ("abstractmethod", "abstract"), ("property", "property")) if d in plain]
        every = [(x, "") for x in [*n.args.posonlyargs, *n.args.args]] + [(x, "*") for x in [n.args.vararg] if x] + [(x, "") for x in n.args.kwonlyargs] + [(x, "**") for x in [n.args.kwarg] if x]
        listed = [{"name": star + x.arg, "type": ast.unparse(x.annotation) if x.annotation else None} for x, star in every]
        st = T["DEFINITION_FUNCTION"] + (3 if asynchronous else 2 if n.name == "__init__" else 0)
        return Raw("function_definition", a, b, [*inside, body], n.name, signature=signature, parameters=listed, modifiers=modifiers, semantic_type=st)

    def parameters(self, args: ast.arguments, a: int, b: int, type_: str) -> Raw:
        out = []
        plain = [*args.posonlyargs, *args.args]
        default = dict(zip((id(x) for x in plain[len(plain) - len(args.defaults) :]), args.defaults, strict=True)) | {id(x): d for x, d in zip(args.kwonlyargs, args.kw_defaults, strict=True) if d is not None}
        for x in [*plain, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
            s, e = self.span(x)
            word = Raw("identifier", s, s + len(x.arg.encode()))
            if x is args.vararg or x is args.kwarg:
                star = self.back("*" if x is args.vararg else "**", s)
                word = Raw("list_splat_pattern" if x is args.vararg else "dictionary_splat_pattern", star, word.end, [word], x.arg)
            kind, inner, end = "identifier", [word], e
            if x.annotation is not None:
                t = self.expression(x.annotation)
                inner.append(Raw("type", t.start, t.end, [t]))
                kind = "typed_parameter"
            if id(x) in default:
                d = self.expression(default[id(x)])
                inner.append(d)
                kind, end = ("typed_default_parameter" if x.annotation is not None else "default_parameter"), d.end
            out.append(word if kind == "identifier" else Raw(kind, inner[0].start, end, inner, x.arg))
        out.sort(key=lambda r: r.start)
        return Raw(type_, a, b, out)

    def arguments(self, args: Sequence[ast.expr], keywords: Sequence[ast.keyword], a: int, b: int) -> Raw:
        out = [self.expression(x) for x in args]
        for k in keywords:
            s, e = self.span(k)
            v = self.expression(k.value)
            out.append(Raw("keyword_argument", s, max(e, v.end), [Raw("identifier", s, s + len(k.arg.encode())), v], k.arg) if k.arg else Raw("dictionary_splat", s, max(e, v.end), [v]))
        out.sort(key=lambda r: r.start)
        return Raw("argument_list", a, b, out)

    def assignment(self, n: ast.stmt, a: int, b: int) -> Raw:
        if isinstance(n, ast.Assign):
            right = self.expression(n.value, bare="expression_list")
            for t in reversed(n.targets):
                left = self.target(t)
                right = Raw("assignment", left.start, max(b, right.end), [left, right], self.text_of(left) if left.type == "identifier" else None)
            return right
        left = self.target(n.target)
        if isinstance(n, ast.AugAssign):
            return Raw("augmented_assignment", a, b, [left, self.expression(n.value, bare="expression_list")])
        t = self.expression(n.annotation)
        rest = [self.expression(n.value)] if n.value is not None else []
        return Raw("assignment", a, b, [left, Raw("type", t.start, t.end, [t]), *rest], self.text_of(left) if left.type == "identifier" else None, signature=ast.unparse(n.annotation))

    def imports(self, n: ast.stmt, a: int, b: int) -> Raw:
        children: list[Raw] = []
        at, name = a, None
        if isinstance(n, ast.ImportFrom):
            at = self.find("import", a, b)
            name = "." * n.level + (n.module or "")
            first = next((t for t in self.tokens[bisect_left(self.starts, a) + 1 :]), None)
            last = self.tokens[bisect_left(self.starts, at) - 1]
            if n.module == "__future__" and not n.level:
                pass
            elif n.level:
                dots = first[0]
                end = dots
                for t in self.tokens[bisect_left(self.starts, dots) :]:
                    if set(t[3]) != {"."}:
                        break
                    end = t[1]
                inner = [Raw("import_prefix", dots, end)]
                if n.module:
                    inner.append(self.dotted(end, last[1]))
                children.append(Raw("relative_import", dots, last[1], inner))
            else:
                children.append(self.dotted(first[0], last[1]))
            if n.names[0].name == "*":
                star = self.find("*", at, b)
                return Raw("import_from_statement", a, b, [*children, Raw("wildcard_import", star, star + 1)], name)
        else:
            name = n.names[0].name
        for x in n.names:
            s, e = self.span(x)
            whole = self.dotted(s, s + len(x.name.encode()))
            if x.asname:
                i = e - len(x.asname.encode())
                whole = Raw("aliased_import", s, e, [whole, Raw("identifier", i, e)], x.asname)
            children.append(whole)
        future = isinstance(n, ast.ImportFrom) and n.module == "__future__" and not n.level
        return Raw("future_import_statement" if future else "import_from_statement" if isinstance(n, ast.ImportFrom) else "import_statement", a, b, children, name)

    def dotted(self, a: int, b: int) -> Raw:
        return Raw("dotted_name", a, b, [], self.code[a:b].decode("utf-8", "replace"))

    # ---- expressions ----

    def target(self, n: ast.expr) -> Raw:
        if isinstance(n, ast.Tuple | ast.List):
            a, b = self.span(n)
            opened = self.code[a : a + 1]
            kind = "list_pattern" if isinstance(n, ast.List) else "tuple_pattern" if opened == b"(" and self.close(a) == b else "pattern_list"
            return Raw(kind, a, b, [self.target(x) for x in n.elts])
        if isinstance(n, ast.Starred):
            return Raw("list_splat_pattern", *self.span(n), [self.target(n.value)])
        return self.expression(n)

    def expression(self, n: ast.expr, bare: str = "tuple") -> Raw:
        a, b = self.span(n)
        e = self.expression
        kind = type(n).__name__
        if kind == "Name":
            return Raw("identifier", a, b)
        if kind == "Constant":
            return self.constant(n, a, b)
        if kind in ("JoinedStr", "TemplateStr"):
            return Raw("string", a, b, [Raw("interpolation", *self.span(v), [e(v.value)]) for v in n.values if isinstance(v, ast.FormattedValue)])
        if kind == "Attribute":
            return Raw("attribute", a, b, [e(n.value)])
        if kind == "Call":
            f = e(n.func)
            name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
            opened = self.back("(", b) if not (n.args or n.keywords) else self.find("(", f.end, b)
            while self.close(opened) < b:  # parentheses around the callee
                opened = self.find("(", self.close(opened), b)
            return Raw("call", a, b, [f, self.arguments(n.args, n.keywords, opened, b)], name)
        if kind == "Subscript":
            s = n.slice.elts if isinstance(n.slice, ast.Tuple) and n.slice.elts and self.code[self.span(n.slice)[0] : self.span(n.slice)[0] + 1] != b"(" else [n.slice]
            return Raw("subscript", a, b, [e(n.value), *(e(x) for x in s)])
        if kind == "BoolOp":
            out = e(n.values[0])
            for v in n.values[1:]:
                right = e(v)
                out = Raw("boolean_operator", out.start, right.end, [out, right])
            return Raw("boolean_operator", a, b, out.children)
        if kind == "UnaryOp":
            return Raw("not_operator" if isinstance(n.op, ast.Not) else "unary_operator", a, b, [e(n.operand)])
        if kind == "NamedExpr":
            return Raw("named_expression", a, b, [e(n.target), e(n.value)], n.target.id)
        if kind == "Lambda":
            body = e(n.body)
            colon = self.find(":", a, body.start)
            first = self.tokens[bisect_left(self.starts, a) + 1]
            inner = [self.parameters(n.args, first[0], self.tokens[bisect_left(self.starts, colon) - 1][1], "lambda_parameters")] if first[0] != colon else []
            return Raw("lambda", a, b, [*inner, body])
        if kind == "Dict":
            pairs = [Raw("dictionary_splat", self.back("**", x.start), x.end, [x]) if k is None else Raw("pair", y.start, x.end, [y, x]) for k, v in zip(n.keys, n.values, strict=True) for x in [e(v)] for y in [e(k) if k is not None else x]]
            return Raw("dictionary", a, b, pairs)
        if kind in ("ListComp", "SetComp", "GeneratorExp", "DictComp"):
            head = Raw("pair", self.span(n.key)[0], self.span(n.value)[1], [e(n.key), e(n.value)]) if kind == "DictComp" else e(n.elt)
            clauses = []
            for g in n.generators:
                t, i = self.target(g.target), e(g.iter)
                clauses.append(Raw("for_in_clause", self.back("async", t.start) if g.is_async else self.back("for", t.start), i.end, [t, i]))
                clauses += [Raw("if_clause", self.back("if", c.start), c.end, [c]) for c in map(e, g.ifs)]
            return Raw({"ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension"}.get(kind, "generator_expression"), a, b, [head, *clauses])
        if kind == "Tuple":
            parenthesised = self.code[a : a + 1] == b"(" and self.close(a) == b
            return Raw("tuple" if parenthesised else bare, a, b, [e(x) for x in n.elts])
        name = {"BinOp": "binary_operator", "Compare": "comparison_operator", "IfExp": "conditional_expression", "Set": "set", "List": "list", "Starred": "list_splat", "Await": "await", "Yield": "yield", "YieldFrom": "yield", "Slice": "slice"}.get(kind, kind.lower())
        children = [n.body, n.test, n.orelse] if kind == "IfExp" else [c for c in ast.iter_child_nodes(n) if isinstance(c, ast.expr)]
        return Raw(name, a, b, [e(c, bare="expression_list") if kind.startswith("Yield") else e(c) for c in children])

    def constant(self, n: ast.Constant, a: int, b: int) -> Raw:
        v = n.value
        if isinstance(v, str | bytes):
            parts = [t for t in self.tokens[bisect_left(self.starts, a) : bisect_left(self.starts, b)] if t[2] == "STRING"]
            if len(parts) > 1:
                return Raw("concatenated_string", a, b, [self.string(s, e) for s, e, _, _ in parts])
            return self.string(a, b)
        if v is Ellipsis or isinstance(v, bool) or v is None:
            return Raw("ellipsis" if v is Ellipsis else str(v).lower(), a, b)
        return Raw("integer" if isinstance(v, int) else "float", a, b)

    def string(self, a: int, b: int) -> Raw:
        raw = self.code[a:b]
        quote = min((i for i in (raw.find(b'"'), raw.find(b"'")) if i >= 0), default=0)
        size = 3 if raw[quote : quote + 3] in (b'"""', b"'''") and len(raw) >= quote + 6 else 1
        s, e = a + quote + size, b - size
        middle = [Raw("string_content", s, e)] if e > s else []
        return Raw("string", a, b, [Raw("string_start", a, s), *middle, Raw("string_end", e, b)])

    def text_of(self, r: Raw) -> str:
        return self.code[r.start : r.end].decode("utf-8", "replace")

    # ---- tokens ----

    def leaf(self, t: tuple[int, int, str, str]) -> Raw:
        a, b, kind, text = t
        if kind == "NAME":
            return Raw(text if keyword.iskeyword(text) and text not in ("True", "False", "None") else {"True": "true", "False": "false", "None": "none"}.get(text, "identifier"), a, b)
        if kind == "NUMBER":
            return Raw("integer", a, b)
        if kind == "STRING":
            return self.string(a, b)
        return Raw({"COMMENT": "comment", "FSTRING_START": "string_start", "FSTRING_MIDDLE": "string_content", "FSTRING_END": "string_end"}.get(kind, text), a, b)

    def fill(self, root: Raw) -> None:
        """Puts every uncovered token into the innermost node around it, wraps parentheses, names the nodes."""
        stack = [root]
        while stack:
            node = stack.pop()
            if node.type in TEXT_NAMED and node.name is None:
                node.name = self.text_of(node)
            if node.type in ("identifier", "integer", "float", "true", "false", "none", "ellipsis", "string_start", "string_content", "string_end", "comment", "import_prefix", "wildcard_import"):
                continue
            if node.type == "ERROR" or (node.type == "string" and node.children and node.children[0].type == "string_start"):
                continue
            whole, at = [], node.start
            for c in [*node.children, None]:
                end = c.start if c is not None else node.end
                lo, hi = bisect_left(self.starts, at), bisect_left(self.starts, end)
                whole += [self.leaf(t) for t in self.tokens[lo:hi] if (t[0], t[1]) != (node.start, node.end) or node.type in ("type", "dotted_name", "case_pattern", "keyword")]
                if c is not None:
                    whole.append(c)
                    at = max(at, c.end)
            if node.type not in OWN_PARENTHESES:
                i = 0
                while i + 2 < len(whole):
                    x, y, z = whole[i : i + 3]
                    if x.type == "(" and z.type == ")" and y.type not in ("(", ")"):
                        whole[i : i + 3] = [Raw("parenthesized_expression", x.start, z.end, [y])]
                        i = max(0, i - 1)
                    else:
                        i += 1
            elif node.type == "argument_list" and len(whole) == 1 and whole[0].type == "generator_expression":
                node.type, node.children = "generator_expression", whole[0].children
                stack.append(node)
                continue
            node.children = whole
            for c in whole:
                c.info.setdefault("syntax", c.type in TYPES and TYPES[c.type][1] & 1)
            stack.extend(whole)


#: Lines that go on with what the lines before began, also where they are not indented.
GOES_ON = ("else", "elif", "except", "finally", ")", "]", "}", " ", "\t", "\n", "\r", "#")


def stretches(text: str) -> list[tuple[int, str]]:
    """(lines before it, text) of the parts of a module that can stand alone: each begins with an unindented line."""
    out: list[tuple[int, list[str]]] = []
    decorated = False
    for k, line in enumerate(text.split("\n")):
        if out and (decorated or not line or line.startswith(GOES_ON)):
            out[-1][1].append(line)
        else:
            out.append((k, [line]))
        decorated = line.startswith("@") or (decorated and not line.strip())
    return [(k, "\n".join(lines)) for k, lines in out]


def recovered(b: Builder) -> list[Raw]:
    """The statements of a module that does not compile as a whole: a part that does not compile is an ERROR node of its
    tokens, the others are read as they are."""
    out: list[Raw] = []
    for k, text in stretches(b.text):
        try:
            out += [b.statement(s) for s in ast.parse("\n" * k + text).body]
        except (SyntaxError, ValueError, RecursionError):
            low, high = b.lines[k], b.lines[min(k + text.count("\n") + 1, len(b.lines) - 1)]
            tokens = b.tokens[bisect_left(b.starts, low) : bisect_left(b.starts, high)]
            if tokens:
                out.append(Raw("ERROR", tokens[0][0], tokens[-1][1], [b.leaf(t) for t in tokens]))
    return out


def parse(code: bytes) -> Raw:
    """The module; parts that do not compile become ERROR nodes of their tokens."""
    b = Builder(code)
    first = b.tokens[0][0] if b.tokens else 0
    try:
        body = [b.statement(s) for s in ast.parse(b.text).body]
    except (SyntaxError, ValueError, RecursionError):
        body = recovered(b)
    if not body and b.text.strip() and not b.tokens:  # nothing that could be read at all
        body = [Raw("ERROR", 0, len(code))]
    root = Raw("module", first, len(code), body)
    b.fill(root)
    return root


def compiled(code: bytes) -> Raw | None:
    """The module of a text that compiles as a whole."""
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None
    return parse(code)


#: Texts whose every sign stands for itself: without strings, comments and lines that go on.
PLAIN = re.compile(r"[\n !$-&(-\[\]-~]*")
BEGINS = re.compile(r"^(?=[^\s)\]}])(?!else|elif|except|finally)", re.M)


def cut(text: str) -> list[str] | None:
    """The statements of a module, if each begins with an unindented line for certain; they make the module if each compiles."""
    if PLAIN.fullmatch(text) is None or "__future__" in text:
        return None
    at = [m.start() for m in BEGINS.finditer(text)]
    if not at or text[: at[0]].strip():
        return None if text.strip() else []
    out = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
    if text.startswith("@") or "\n@" in text:  # what decorators stand before
        out, decorated = [], False
        for a, b in zip(at, [*at[1:], len(text)], strict=True):
            if decorated:
                out[-1] += text[a:b]
            else:
                out.append(text[a:b])
            decorated = text[a] == "@"
    return out


#: Words that a tree depends on; names that begin with an underscore are taken as such, too.
FIXED = frozenset([*keyword.kwlist, *keyword.softkwlist, "print", "exec", "staticmethod", "classmethod", "abstractmethod", "property"])

PYTHON = Language("python", (".py", ".pyi", ".pyw"), parse, TYPES, ("py", "python3"), lambda node, name: not name.startswith("_"), cut=cut, compiled=compiled, fixed=FIXED)
