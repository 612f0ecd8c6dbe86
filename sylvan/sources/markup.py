"""Front-ends for HTML and JSON. Both accept anything: what does not close is closed where its parent ends."""

from __future__ import annotations

import re

from sylvan.functions import taxonomy as X
from sylvan.sources.nodes import Language, Raw

T = X.CODES
# Elements without content, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT = {"script": "script_element", "style": "style_element"}
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
HTML_TYPES = {
    "document": (T["DEFINITION_MODULE"], X.IS_SCOPE), "element": (T["DEFINITION_CLASS"], X.NAME_DEFINITION), "script_element": (T["EXTERNAL_EMBED"], 0), "style_element": (T["EXTERNAL_EMBED"], 0),
    "start_tag": (T["PARSER_SYNTAX"], 0), "end_tag": (T["PARSER_SYNTAX"], 0), "self_closing_tag": (T["PARSER_SYNTAX"], 0), "tag_name": (T["NAME_IDENTIFIER"], X.NAME_REFERENCE), "attribute": (T["DEFINITION_VARIABLE"], X.NAME_DEFINITION),
    "attribute_name": (T["NAME_ATTRIBUTE"], X.NAME_REFERENCE), "attribute_value": (T["LITERAL_STRING"], 0), "quoted_attribute_value": (T["LITERAL_STRING"], 0), "text": (T["LITERAL_STRING"], 0), "raw_text": (T["LITERAL_STRING"], 0),
    "comment": (T["METADATA_COMMENT"], 0), "doctype": (T["METADATA_DIRECTIVE"], 0), "erroneous_end_tag": (T["PARSER_CONSTRUCT"], 0),
} | {k: (T["PARSER_PUNCTUATION"], X.IS_SYNTAX_ONLY) for k in ("<", ">", "</", "/>", "=", '"', "'")}
MARK = re.compile(rb"<!--.*?(?:-->|\Z)|<![^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)", re.S)
ATTRIBUTE = re.compile(rb"\s*(?:(/?>)|([^\s=/>]+)(?:(\s*=\s*)(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?|/)")


def text(code: bytes, a: int, b: int) -> list[Raw]:
    inner = code[a:b]
    if not inner.strip():
        return []
    a += len(inner) - len(inner.lstrip())
    return [Raw("text", a, a + len(inner.strip()))]


def tag(code: bytes, at: int, name_end: int) -> tuple[list[Raw], int, bool]:
    """Children of a start tag, its end, and whether it closes itself."""
    name = code[at + 1 : name_end].decode("utf-8", "replace")
    children = [Raw("<", at, at + 1), Raw("tag_name", at + 1, name_end, [], name)]
    end = name_end
    while m := ATTRIBUTE.match(code, end):
        if m.end() == end:
            break
        end = m.end()
        if m[1] is not None:
            children.append(Raw(m[1].decode(), m.start(1), m.end(1)))
            return children, end, m[1] == b"/>"
        if m[2] is None:
            continue
        key = Raw("attribute_name", m.start(2), m.end(2), [], m[2].decode("utf-8", "replace"))
        parts = [key]
        if m[3] is not None:
            sign = m.start(3) + m[3].index(b"=")
            parts.append(Raw("=", sign, sign + 1))
            group = next(g for g in (4, 5, 6) if m[g] is not None)
            value = [Raw("attribute_value", m.start(group), m.end(group), [], m[group].decode("utf-8", "replace"))] if m[group] else []
            if group == 6:
                parts += value
            else:
                quote = '"' if group == 4 else "'"
                closing = [Raw(quote, m.end(group), m.end())] if m.end() > m.end(group) else []
                parts.append(Raw("quoted_attribute_value", m.start(group) - 1, m.end(), [Raw(quote, m.start(group) - 1, m.start(group)), *value, *closing]))
        children.append(Raw("attribute", m.start(2), m.end(), parts, key.name))
    return children, end, False


def parse_html(code: bytes) -> Raw:
    root = Raw("document", 0, len(code))
    open_: list[Raw] = [root]

    def close(until: int, end: int) -> None:
        while len(open_) > until:
            open_.pop().end = end

    at = 0
    while m := MARK.search(code, at):
        open_[-1].children += text(code, at, m.start())
        at = m.end()
        if m[2] is not None:
            name = m[2].decode("utf-8", "replace").lower()
            children, at, alone = tag(code, m.start(), m.end(2))
            if name in CLOSES and open_[-1].name in CLOSES[name]:
                close(len(open_) - 1, m.start())
            start = Raw("self_closing_tag" if alone else "start_tag", m.start(), at, children)
            element = Raw(RAW_TEXT.get(name, "element"), m.start(), at, [start], name)
            open_[-1].children.append(element)
            if name in RAW_TEXT and not alone:
                stop = re.compile(rb"</" + re.escape(name.encode()) + rb"\s*>", re.I).search(code, at)
                end = stop.start() if stop else len(code)
                if end > at:
                    element.children.append(Raw("raw_text", at, end))
                at = stop.end() if stop else len(code)
                if stop:
                    element.children.append(closing(code, stop.start(), at))
                element.end = at
            elif not alone and name not in VOID:
                open_.append(element)
        elif m[1] is not None:
            name = m[1].decode("utf-8", "replace").lower()
            level = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].name == name), 0)
            if level:
                close(level + 1, m.start())
                open_[-1].children.append(closing(code, m.start(), at))
                close(level, at)
            else:
                open_[-1].children.append(Raw("erroneous_end_tag", m.start(), at, [], name))
        else:
            open_[-1].children.append(Raw("comment" if m.group().startswith(b"<!--") else "doctype", m.start(), at))
    open_[-1].children += text(code, at, len(code))
    close(1, len(code))
    return root


def closing(code: bytes, a: int, b: int) -> Raw:
    m = re.compile(rb"</([^\s>]*)").match(code, a)
    end = [Raw(">", b - 1, b)] if code[b - 1 : b] == b">" else []
    return Raw("end_tag", a, b, [Raw("</", a, a + 2), Raw("tag_name", a + 2, m.end(), [], m[1].decode("utf-8", "replace")), *end])


HTML = Language("html", (".html", ".htm"), parse_html, HTML_TYPES, ())

JSON_TYPES = {
    "document": (T["DEFINITION_MODULE"], X.IS_SCOPE), "object": (T["LITERAL_STRUCTURED"] + 1, 0), "array": (T["LITERAL_STRUCTURED"], 0), "pair": (T["DEFINITION_VARIABLE"], X.NAME_DEFINITION), "string": (T["LITERAL_STRING"], 0),
    "string_content": (T["LITERAL_STRING"], 0), "number": (T["LITERAL_NUMBER"], 0), "true": (T["LITERAL_ATOMIC"], 0), "false": (T["LITERAL_ATOMIC"], 0), "null": (T["LITERAL_ATOMIC"], 0), "comment": (T["METADATA_COMMENT"], 0), "ERROR": (0, 0),
} | {k: (T["PARSER_PUNCTUATION"], X.IS_SYNTAX_ONLY) for k in ("{", "}", "[", "]", ":", ",", '"')}
JSON_TOKEN = re.compile(rb"\"(?:[^\"\\]|\\.)*\"?|-?[0-9][0-9.eE+-]*|true|false|null|[{}\[\]:,]|//[^\n]*|[^\s{}\[\]:,\"]+", re.S)


def parse_json(code: bytes) -> Raw:
    root = Raw("document", 0, len(code))
    open_ = [root]

    def add(node: Raw) -> None:
        top = open_[-1]
        if top.type == "pair" and len(top.children) == 2:
            top.children.append(node)
            top.end = node.end
            if node.type not in ("object", "array"):
                open_.pop()
        else:
            top.children.append(node)

    for m in JSON_TOKEN.finditer(code):
        a, b, token = m.start(), m.end(), m.group()
        if token in (b"{", b"["):
            node = Raw("object" if token == b"{" else "array", a, b, [Raw(token.decode(), a, b)])
            add(node)
            open_.append(node)
        elif token in (b"}", b"]"):
            want = "object" if token == b"}" else "array"
            if not any(x.type == want for x in open_):
                add(Raw("ERROR", a, b))
                continue
            while open_[-1].type != want:
                open_.pop()
            done = open_.pop()
            done.children.append(Raw(token.decode(), a, b))
            done.end = b
            if open_[-1].type == "pair":
                open_.pop().end = b
        elif token == b":" and open_[-1].type == "object" and open_[-1].children[-1].type == "string":
            key = open_[-1].children.pop()
            pair = Raw("pair", key.start, b, [key, Raw(":", a, b)], code[key.start + 1 : key.end - 1].decode("utf-8", "replace"))
            open_[-1].children.append(pair)
            open_.append(pair)
        elif token in (b":", b","):
            if open_[-1].type == "pair" and len(open_[-1].children) == 2:
                open_.pop()
            open_[-1].children.append(Raw(token.decode(), a, b))
        elif token[:1] == b'"':
            closed = len(token) > 1 and token[-1:] == b'"'
            inner = [Raw("string_content", a + 1, b - closed)] if b - closed > a + 1 else []
            add(Raw("string", a, b, [Raw('"', a, a + 1), *inner, *([Raw('"', b - 1, b)] if closed else [])], token.decode("utf-8", "replace")))
        elif token[:2] == b"//":
            open_[-1].children.append(Raw("comment", a, b))
        else:
            kind = token.decode("utf-8", "replace") if token in (b"true", b"false", b"null") else "number" if re.fullmatch(rb"-?[0-9][0-9.eE+-]*", token) else "ERROR"
            add(Raw(kind, a, b, [], token.decode("utf-8", "replace")))
    return root


JSON = Language("json", (".json", ".geojson"), parse_json, JSON_TYPES, ("jsonc",))
