"""Languages with braces, and a few without, by one tokenizer and declaration patterns.

Comments and string contents are blanked first (positions stay), so patterns
see code only; brackets are matched once. Rules are those of a parser in kind,
not in every corner of each grammar.
"""

from __future__ import annotations

import bisect
import re

from loomgraph.extract.base import Found
from loomgraph.functions.signatures import arguments

_SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?""", re.S)
_SKIP_HASH = re.compile(r"""\#[^\n]*|"(?:\\.|[^"\\])*"?|'[^'\n]*'?""", re.S)
_SKIP_RUST = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\\n])'""", re.S)
_WORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "new", "throw", "typeof", "function", "await", "case", "delete", "in", "of", "using", "lock", "fixed", "match", "func", "fn", "defer", "range", "select", "super", "defined", "constructor", "try", "when", "nameof", "static_assert", "alignof", "decltype", "synchronized", "assert", "void", "class"}
_ID = r"[A-Za-z_$][\w$]*"


class Code:
    """Text with comments and strings blanked, line starts, and matching brackets."""

    def __init__(self, text: str, language: str) -> None:
        self.text = text
        skip = _SKIP_HASH if language == "bash" else _SKIP_RUST if language == "rust" else _SKIP
        self.comments: list[tuple[int, int]] = []

        def blank(m: re.Match) -> str:
            s = m[0]
            if s.startswith(("//", "/*", "#")):
                self.comments.append(m.span())
                return re.sub(r"[^\n]", " ", s)
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s

        self.code = skip.sub(blank, text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m[0]
            if c in "([{":
                stack.append(m.start())
            else:
                while stack and self.code[stack[-1]] != pairs[c]:
                    stack.pop()
                if stack:
                    self.match[stack.pop()] = m.start()
        self.holders: list[tuple[int, int, int]] = []  # (start, end, symbol)
        self.declared: set[int] = set()  # where names of callables are declared

    def at(self, pos: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, pos)
        return line, pos - self.lines[line - 1]

    def body_end(self, pos: int) -> int:
        """The end of a declaration: of its braces, or of the statement."""
        m = re.compile(r"[{;]").search(self.code, pos)
        if not m:
            return len(self.code)
        return self.match.get(m.start(), len(self.code) - 1) + 1 if m[0] == "{" else m.start()

    def doc(self, pos: int) -> str | None:
        """The comments right above a declaration, markers stripped, 500 characters at most."""
        line_start = self.text.rfind("\n", 0, pos) + 1
        parts, end = [], line_start
        for a, b in reversed(self.comments):
            if b <= end and not self.text[b:end].strip():
                parts.append(re.sub(r"(?m)^[ \t]*(?:///?|/\*+|\*+/|\*|#)[ \t]?|\*/", "", self.text[a:b]).strip())
                end = self.text.rfind("\n", 0, a) + 1
            elif b <= end:
                break
        return "\n".join(reversed(parts))[:500].strip() or None

    def signature(self, start: int, pos: int) -> str:
        return re.sub(r"\s+", " ", self.text[start:pos]).strip()[:512]

    def holder(self, pos: int) -> int:
        best = [(b - a, s) for a, b, s in self.holders if a <= pos < b]
        return min(best)[1] if best else -1


def _declare(c: Code, found: Found, kind: str, name: str, start: int, end: int, signed: bool = False, head_end: int | None = None, qualname: str | None = None) -> int:
    while start < end and c.text[start].isspace():
        start += 1
    signature = c.signature(start, head_end if head_end is not None else end) if signed else None
    i = found.symbol(kind, name, c.at(start), c.at(end), signature, c.doc(start), qualname)
    if i >= 0 and kind not in ("variable", "field", "property", "event", "macro", "typedef", "type_alias"):
        c.holders.append((start, end, i))
    return i


def _head(c: Code, open_paren: int) -> int:
    """Where a callable's head ends: before its brace, arrow or semicolon."""
    close = c.match.get(open_paren, open_paren)
    m = re.compile(r"\{|;|=>|\Z").search(c.code, close)
    return m.start()


def _types(c: Code, found: Found, words: dict[str, str]) -> None:
    for m in re.finditer(rf"\b({'|'.join(words)})\s+(?:class\s+|struct\s+)?({_ID}(?:(?:::|\.){_ID})*)", c.code):
        rest = c.code[m.end() : m.end() + 1]
        after = re.compile(r"\s*(?:<[^{};()]*>)?\s*(?::[^{};]*|extends[^{;]*|implements[^{;]*|where[^{;]*|final\s*|\([^()]*\)[^{;]*)?\{").match(c.code, m.end())
        if not after and not (words[m[1]] in ("delegate",) or rest == ";"):
            continue
        if after:
            _declare(c, found, words[m[1]], m[2], m.start(), c.match.get(after.end() - 1, len(c.code) - 1) + 1)


def _calls(c: Code, found: Found, callee: str, last_only: bool = False, hint=None) -> None:
    for m in re.finditer(rf"({callee})\s*(?:<[\w\s,.\[\]<>|]*>)?\(", c.code):
        name = re.sub(r"\s+", "", m[1])
        bare = re.split(r"\.|::|->", name)[-1]
        if bare == name and bare in _WORDS or not bare or m.start(1) in c.declared:
            continue
        holder = c.holder(m.start(1))
        if holder >= 0 and found.symbols[holder]["kind"] == "interface":
            continue  # a method's declaration
        open_paren = m.end() - 1
        close = c.match.get(open_paren)
        if close is None:
            continue
        count, pattern = arguments(c.text[open_paren + 1 : close])
        receiver = re.sub(r"(?:\.|::|->)[^.:>]*$", "", name) if bare != name else ""
        found.ref("call", bare if last_only else name, c.at(m.start(1)), c.at(close + 1), c.holder(m.start(1)), "call_expression", count, pattern, hint(c, receiver, m.start(1)) if hint and receiver else None)




# ---- languages


def c_family(text: str, found: Found) -> None:
    c = Code(text, "cpp")
    for m in re.finditer(r'(?m)^[ \t]*#\s*include\s*(<[^>\n]*>|"[^"\n]*")', text):
        found.ref("include", m[1], c.at(m.start()), c.at(m.end()), -1, "preproc_include")
    for m in re.finditer(rf"(?m)^[ \t]*#\s*define\s+({_ID})", c.code):
        _declare(c, found, "macro", m[1], m.start(), m.end())
    code = c.code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), c.code)
    for m in re.finditer(rf"\bnamespace\s+({_ID}(?:::{_ID})*)\s*\{{", code):
        _declare(c, found, "namespace", m[1], m.start(), c.match.get(m.end() - 1, len(code) - 1) + 1)
    for m in re.finditer(rf"\b(class|struct|enum(?:\s+class)?)\s+(?:alignas\([^)]*\)\s*)?({_ID})\s*(?:final\s*)?(?::([^{{;]*))?\{{", code):
        kind = m[1].split()[0]
        i = _declare(c, found, kind, m[2], m.start(), c.match.get(m.end() - 1, len(code) - 1) + 1)
        if kind != "enum" and m[3]:
            for b in re.finditer(rf"(?:\b(?:public|private|protected|virtual)\s+)*((?:{_ID}::)*{_ID})(?:\s*<[^,{{]*>)?", m[3]):
                if b[1] not in ("public", "private", "protected", "virtual"):
                    found.ref("inherit", b[1], c.at(m.start(3) + b.start(1)), c.at(m.start(3) + b.end(1)), i, "base_class_clause")
    for m in re.finditer(rf"\btypedef\b[^;]*?({_ID})\s*;", code):
        _declare(c, found, "typedef", m[1], m.start(), m.end())
    function = re.compile(rf"(?:^|(?<=[;{{}}\s]))((?:[\w:<>,*&~\[\]]+[\s*&]+)+)?((?:{_ID}::)*~?{_ID}|operator\s*\S+)\s*\(", re.M)
    for m in function.finditer(code):
        name, open_paren = m[2], m.end() - 1
        close = c.match.get(open_paren)
        if close is None or name.split("::")[-1] in _WORDS or (not m[1] and "::" not in name):
            continue
        before = (m[1] or "").strip()
        if before in ("return", "new", "else", "throw", "delete", "case", "goto") or before.endswith(("=", "return", "new")):
            continue
        tail = re.compile(r"\s*(?:const|noexcept|override|final|->\s*[\w:<>*&\s]+|\s)*\s*(?::[^{;]*)?(\{|;)").match(code, close + 1)
        if not tail:
            continue
        inner = c.holder(m.start())
        if tail[1] == ";" and inner >= 0 and found.symbols[inner]["kind"] == "function":
            continue  # a call or a local variable
        end = c.match.get(tail.end() - 1, len(code) - 1) + 1 if tail[1] == "{" else tail.end()
        c.declared.add(m.start(2))
        _declare(c, found, "function", name, m.start(), end, True, close + 1)
    for a, b, i in list(c.holders):
        if found.symbols[i]["kind"] in ("class", "struct"):
            body = code.find("{", a)
            for m in re.finditer(rf"(?m)^[ \t]*(?:(?:static|const|mutable|constexpr|inline|volatile)\s+)*[\w:<>,*& ]+?[\s*&]({_ID})(?:\s*\[[^\]]*\])?(?:\s*=[^;{{}}()]*)?;", code[body:b]):
                if c.holder(body + m.start(1)) == i and not m[0].strip().startswith(("return", "using", "typedef", "friend")):
                    _declare(c, found, "field", m[1], body + m.start(), body + m.end())
    for m in re.finditer(rf"(?m)^(?:(?:static|const|constexpr|extern|inline)\s+)*[\w:<>*&]+[\s*&]+({_ID})\s*(?:=[^;()]*)?;", code):
        if c.holder(m.start()) < 0 and not m[0].startswith(("return", "using", "typedef", "class", "struct", "enum", "}")):
            _declare(c, found, "variable", m[1], m.start(), m.end())
    _calls(c, found, rf"(?:{_ID}\s*(?:\.|->|::)\s*)*{_ID}", last_only=True)
    for m in re.finditer(rf"(?<![\w.])({_ID})(?=[\s*&]+{_ID}\s*[;=,)({{])", code):
        if m[1][0].isupper():
            found.ref("type_ref", m[1], c.at(m.start()), c.at(m.end()), c.holder(m.start()), "type_identifier")


_MODIFIERS = r"(?:(?:public|private|protected|internal|static|async|readonly|abstract|override|virtual|sealed|partial|export|default|declare|final|synchronized|native|extern|unsafe|new|const|get|set)\s+)*"


def csharp(text: str, found: Found) -> None:
    c = Code(text, "csharp")
    for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", c.code):
        found.ref("include", m[1], c.at(m.start(1)), c.at(m.end(1)), -1, "using_directive")
    for m in re.finditer(r"\bnamespace\s+([\w.]+)\s*([{;])", c.code):
        _declare(c, found, "namespace", m[1], m.start(), c.match.get(m.end() - 1, len(c.code) - 1) + 1 if m[2] == "{" else len(c.code))
    for m in re.finditer(rf"{_MODIFIERS}\b(class|interface|struct|enum|record)\s+({_ID})(?:\s*<[^>{{]*>)?(?:\s*\([^)]*\))?\s*(?::([^{{;]*))?\s*(?:where[^{{;]*)?[{{;]", c.code):
        end = c.match.get(m.end() - 1, m.end() - 1) + 1
        i = _declare(c, found, "class" if m[1] == "record" else m[1], m[2], m.start(), end)
        if m[3] and m[1] != "enum":
            for b in re.finditer(r"[\w.]+(?:<[^<>]*(?:<[^<>]*>)?[^<>]*>)?", re.sub(r"\bwhere\b.*", "", m[3], flags=re.S)):
                found.ref("inherit", b[0], c.at(m.start(3) + b.start()), c.at(m.start(3) + b.end()), i, "base_list")
    for m in re.finditer(rf"{_MODIFIERS}\bdelegate\s+[\w<>\[\],.?]+\s+({_ID})\s*\([^)]*\)\s*;", c.code):
        c.declared.add(m.start(1))
        _declare(c, found, "delegate", m[1], m.start(), m.end())
    for m in re.finditer(rf"{_MODIFIERS}\bevent\s+[\w<>\[\],.?]+\s+({_ID})\s*[;{{=]", c.code):
        _declare(c, found, "event", m[1], m.start(), m.end())
    _members(c, found, rf"(?:[\w<>\[\],.?]+\s+)?({_ID})", "method")
    for m in re.finditer(rf"(?m)^\s*{_MODIFIERS}(?:[\w<>\[\],.?]+)\s+({_ID})\s*(?:\{{\s*(?:(?:public|private|protected|internal)\s+)?(?:get|set|init)\b|=>)", c.code):
        if c.holder(m.start(1)) >= 0:
            brace = c.code.find("{", m.end(1), m.end())
            _declare(c, found, "property", m[1], m.start(), c.match.get(brace, m.end()) + 1 if brace >= 0 else c.body_end(m.end()))
    for m in re.finditer(rf"(?m)^\s*{_MODIFIERS}(?:[\w<>\[\],.?]+)\s+({_ID})\s*(?:=[^;{{}}]*)?;", c.code):
        i = c.holder(m.start(1))
        if i >= 0 and found.symbols[i]["kind"] in ("class", "struct") and not m[0].strip().startswith(("return", "using", "throw", "var ", "await")):
            _declare(c, found, "field", m[1], m.start(), m.end())
    _calls(c, found, rf"(?<!new )(?<![\w.])(?:{_ID}\s*\??\.\s*)*{_ID}")
    for m in re.finditer(r"\bnew\s+([\w.]+(?:<[^<>()]*>)?)\s*\(", c.code):
        count, pattern = arguments(c.text[m.end() : c.match.get(m.end() - 1, m.end())])
        found.ref("call", m[1], c.at(m.start()), c.at(c.match.get(m.end() - 1, m.end()) + 1), c.holder(m.start()), "object_creation_expression", count, pattern)


def _members(c: Code, found: Found, head: str, kind: str, constructor: str | None = None) -> None:
    """Callables in type bodies: a name, a parameter list, then a body, an arrow or a semicolon."""
    bodies = [(a, b, i) for a, b, i in c.holders if found.symbols[i]["kind"] in ("class", "interface", "struct", "enum")]
    for m in re.finditer(rf"(?m)(?:^|(?<=[{{}};]))\s*{_MODIFIERS}(?:<[^>]*>\s*)?{head}\s*(?:<[^>()]*>)?\(", c.code):
        name, open_paren = m[1], m.end() - 1
        close = c.match.get(open_paren)
        if close is None or name in _WORDS - {"constructor"} or not any(a <= m.start(1) < b for a, b, _ in bodies):
            continue
        inner = c.holder(m.start(1))
        if inner >= 0 and found.symbols[inner]["kind"] in ("method", "function"):
            continue
        tail = re.compile(r"\s*(?::\s*[^{;=]+|throws\s+[\w.,\s]+|where[^{;]*)?\s*(\{|=>|;)").match(c.code, close + 1)
        if not tail:
            continue
        end = c.match.get(tail.end() - 1, len(c.code) - 1) + 1 if tail[1] == "{" else c.code.find(";", tail.start()) + 1 or len(c.code)
        c.declared.add(m.start(1))
        owner = found.symbols[inner]["name"] if inner >= 0 else ""
        _declare(c, found, constructor if constructor and name == owner else kind, name, m.start(), end, True, tail.start(1))


def infer_type(c: Code, receiver: str, pos: int) -> str | None:
    """The declared or constructed type of a receiver, from the text before a use."""
    name = receiver.split(".")[-1]
    if not re.fullmatch(_ID, name) or name in ("this", "self"):
        return None
    before = c.code[max(0, pos - 65536) : pos]
    typed = [(m.start(), m[1]) for m in re.finditer(rf"(?<![\w$]){re.escape(name)}\s*[?!]?\s*:\s*(?:readonly\s+)?([A-Za-z_$][\w$.]*)", before)]
    made = [(m.start(), m[1]) for m in re.finditer(rf"(?<![\w$]){re.escape(name)}\s*(?::[^=;]*)?=\s*new\s+([A-Za-z_$][\w$.]*)", before)]
    wrapped = [(m.start(), m[1]) for m in re.finditer(rf"\{{[^{{}}]*\b{re.escape(name)}\b[^{{}}]*\}}\s*:\s*\{{[^{{}}]*\b{re.escape(name)}\s*\??:\s*([A-Za-z_$][\w$.]*)", before)]
    best = max(wrapped + made + typed, default=None)
    return best[1].split(".")[-1] if best and best[1] not in ("string", "number", "boolean", "any", "unknown", "true", "false", "null", "async", "function") else None


def javascript(text: str, found: Found) -> None:
    c = Code(text, "javascript")
    for m in re.finditer(r"(?m)^[ \t]*import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?", c.text):
        if c.code[m.start() :].lstrip().startswith("import"):
            found.ref("include", m[0].strip(), c.at(m.start()), c.at(m.end()), -1, "import_statement")
    for m in re.finditer(rf"{_MODIFIERS}\b(class|interface|enum)\s+({_ID})[^{{;]*\{{", c.code):
        _declare(c, found, m[1], m[2], m.start(), c.match.get(m.end() - 1, len(c.code) - 1) + 1)
    for m in re.finditer(rf"{_MODIFIERS}\btype\s+({_ID})(?:\s*<[^=]*>)?\s*=", c.code):
        end = re.compile(r";|\n(?=\s*(?:export|type|interface|const|let|class|function)\b)|\Z").search(c.code, m.end()).end()
        _declare(c, found, "type_alias", m[1], m.start(), end)

    def fields(i: int, name: str, body: int) -> None:
        end = c.match.get(body, len(c.code) - 1)
        inner = [(m.end() - 1, c.match.get(m.end() - 1, end)) for m in re.finditer(r"\bfunction\b[^{]*\{", c.code[body + 1 : end])]
        inner = [(a + body + 1, c.match.get(a + body + 1, end)) for a, _ in inner]
        seen: set[str] = set()
        for m in re.finditer(rf"\bthis\.({_ID})\s*=(?!=)", c.code[body:end]):
            at = body + m.start()
            if m[1] not in seen and not any(a < at < b for a, b in inner):
                seen.add(m[1])
                j = _declare(c, found, "field", m[1], at, at + len(f"this.{m[1]}"), qualname=f"{name}._fields.{m[1]}")
                if i >= 0 and j >= 0:
                    found.edges.append({"src": i, "dst": j, "kind": "contains", "confidence": 1.0, "evidence": "constructor_field"})

    def builds(name: str, body: int) -> bool:
        if not name[:1].isupper():
            return False
        end = c.match.get(body, len(c.code) - 1)
        inner = [(body + 1 + m.end() - 1, c.match.get(body + 1 + m.end() - 1, end)) for m in re.finditer(r"\bfunction\b[^{]*\{", c.code[body + 1 : end])]
        return any(not any(a < body + m.start() < b for a, b in inner) for m in re.finditer(rf"\bthis\.{_ID}\s*=(?!=)", c.code[body:end]))

    for m in re.finditer(rf"\b(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})\s*(?:<[^>]*>)?\(", c.code):
        line = c.code[c.code.rfind("\n", 0, m.start()) + 1 : m.start()]
        head = _head(c, m.end() - 1)
        if c.code[head : head + 1] != "{" or re.search(r"=\s*$", line):
            continue
        c.declared.add(m.start(1))
        constructs = builds(m[1], head)
        i = _declare(c, found, "constructor_fn" if constructs else "function", m[1], m.start(), c.match.get(head, len(c.code) - 1) + 1, True, head)
        if constructs:
            fields(i, m[1], head)
    for m in re.finditer(rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=;]+)?(=(?!=)|;|$)", c.code, re.M):
        value = re.compile(r"\s*(?:async\s+)?function\b[^({]*\(").match(c.code, m.end())
        if value and builds(m[1], _head(c, value.end() - 1)):
            head = _head(c, value.end() - 1)
            i = _declare(c, found, "constructor_fn", m[1], m.start(), c.match.get(head, len(c.code) - 1) + 1, True, head)
            fields(i, m[1], head)
        else:
            _declare(c, found, "variable", m[1], m.start(), c.body_end(m.end()) if m[2] == "=" else m.end())
    for m in re.finditer(rf"(?<![\w$.])((?:{_ID}\s*\.\s*)*({_ID}))\s*=\s*((?:(?:{_ID}\s*\.\s*)*{_ID}\s*=\s*)*)(?:async\s+)?function\b\s*({_ID})?\s*\(", c.code):
        if re.search(r"\b(?:const|let|var)\s*$", c.code[: m.start()][-8:]):
            continue
        head = _head(c, m.end() - 1)
        names = [m[2], *(re.split(r"\.", re.sub(r"\s|=", "", part))[-1] for part in m[3].split("=") if part.strip())]
        name = m[4] or next((n for n in names if n[:1].isupper()), m[2])
        if builds(name, head):
            i = _declare(c, found, "constructor_fn", name, m.start(), c.match.get(head, len(c.code) - 1) + 1, True, head)
            fields(i, name, head)
    _members(c, found, rf"\*?({_ID})", "method")
    _calls(c, found, rf"(?<![\w$.])(?<!new )(?:{_ID}(?:\([^()]*\))?\s*[?!]?\.\s*)*{_ID}", hint=infer_type)
    for m in re.finditer(rf"\bthis\.({_ID})\b(?!\s*\()", c.code):
        write = re.compile(r"\s*(?:[-+*/|&^%]|\|\||&&|\?\?|<<|>>)?=(?![=>])").match(c.code, m.end())
        found.ref("field_access", m[1], c.at(m.start()), c.at(m.end()), c.holder(m.start()), "this_member_write" if write else "this_member_read")


def java(text: str, found: Found) -> None:
    c = Code(text, "java")
    for m in re.finditer(r"(?m)^\s*import\b[^;]*;", c.code):
        found.ref("include", m[0].strip(), c.at(m.start()), c.at(m.end()), -1, "import_declaration")
    for m in re.finditer(rf"{_MODIFIERS}(@interface|\bclass|\binterface|\benum)\s+({_ID})[^{{;]*\{{", c.code):
        _declare(c, found, "annotation" if m[1] == "@interface" else m[1], m[2], m.start(), c.match.get(m.end() - 1, len(c.code) - 1) + 1)
    _members(c, found, rf"(?:[\w<>\[\],.?]+\s+)?({_ID})", "method", constructor="function")
    for m in re.finditer(rf"(?m)^\s*{_MODIFIERS}[\w<>\[\],.?]+\s+({_ID})\s*(?:=[^;{{}}]*)?;", c.code):
        i = c.holder(m.start(1))
        if i >= 0 and found.symbols[i]["kind"] in ("class", "enum", "interface") and not m[0].strip().startswith(("return", "import", "throw")):
            _declare(c, found, "field", m[1], m.start(), m.end())
    _calls(c, found, rf"(?<!new )(?:{_ID}\s*\.\s*)*{_ID}", last_only=True)


def go(text: str, found: Found) -> None:
    c = Code(text, "go")
    for m in re.finditer(rf"(?m)^package\s+({_ID})", c.code):
        _declare(c, found, "package", m[1], m.start(), m.end())
    for m in re.finditer(r"(?m)^import\s*(?:\((?:[^)]*)\)|[^\n]+)", c.text):
        found.ref("include", m[0].strip(), c.at(m.start()), c.at(m.end()), -1, "import_declaration")
    for m in re.finditer(rf"(?m)^(?:type\s+|\s+)({_ID})\s+(struct|interface)?\s*(\{{)?", c.code):
        if c.code[m.start() : m.start() + 4] == "type":
            end = c.match.get(m.end() - 1, m.end()) + 1 if m[3] else c.code.find("\n", m.end()) % (len(c.code) + 1)
            _declare(c, found, m[2] or "type_alias", m[1], m.start(), end)
    for m in re.finditer(rf"(?m)^func\s*(\([^)]*\))?\s*({_ID})\s*(?:\[[^\]]*\])?\(", c.code):
        close = c.match.get(m.end() - 1, m.end())
        brace = c.code.find("{", close)
        c.declared.add(m.start(2))
        _declare(c, found, "method" if m[1] else "function", m[2], m.start(), c.match.get(brace, len(c.code) - 1) + 1, True, brace)
    _calls(c, found, rf"(?<![\w.])(?:{_ID}\s*\.\s*)*{_ID}")


def rust(text: str, found: Found) -> None:
    c = Code(text, "rust")
    for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s[^;]*;", c.code):
        found.ref("include", m[0].strip(), c.at(m.start()), c.at(m.end()), -1, "use_declaration")
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "type_alias", "const": "variable", "static": "variable"}
    for m in re.finditer(rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern)\s+)*\b(fn|struct|enum|trait|mod|type|const|static)\s+(?:mut\s+)?({_ID})", c.code):
        c.declared.add(m.start(2))
        end = c.body_end(m.end())
        _declare(c, found, kinds[m[1]], m[2], m.start(), end, m[1] == "fn", min(x for x in (c.code.find("{", m.end()), c.code.find(";", m.end()), len(c.code)) if x >= 0))
    for m in re.finditer(rf"\bimpl(?:\s*<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?({_ID})[^{{]*\{{", c.code):
        _declare(c, found, "impl", m[1], m.start(), c.match.get(m.end() - 1, len(c.code) - 1) + 1)
    for m in re.finditer(rf"\bmacro_rules!\s*({_ID})", c.code):
        _declare(c, found, "macro", m[1], m.start(), c.body_end(m.end()))
    _calls(c, found, rf"(?<![\w.])(?:{_ID}\s*(?:\.|::)\s*)*{_ID}")


def bash(text: str, found: Found) -> None:
    c = Code(text, "bash")
    for m in re.finditer(r"(?m)^\s*(?:function\s+([\w-]+)\s*(?:\(\))?|([\w-]+)\s*\(\))\s*\{", c.code):
        _declare(c, found, "function", m[1] or m[2], m.start(), c.match.get(m.end() - 1, len(c.code) - 1) + 1, True, m.end() - 1)
    for m in re.finditer(r"(?m)^\s*(?:export\s+|local\s+|readonly\s+|declare\s+)?([A-Za-z_]\w*)=", c.code):
        _declare(c, found, "variable", m[1], m.start(), m.end())
    for m in re.finditer(r"(?m)^\s*(?:source|\.)\s+(\S+)", c.text):
        found.ref("include", m[0].strip(), c.at(m.start(1)), c.at(m.end(1)), c.holder(m.start(1)), "source_command")
    for m in re.finditer(r"(?m)(?:^|[;&|(]|\bthen\b|\bdo\b|\belse\b)[ \t]*([A-Za-z_][\w./-]*)(?=[ \t\n;&|)]|$)(?![ \t]*\()", c.code):
        if m[1] not in {"echo", "cd", "exit", "if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "local", "export", "readonly", "declare", "source", "return"}:
            found.ref("call", m[1], c.at(m.start(1)), c.at(m.end(1)), c.holder(m.start(1)), "command")


def yaml(text: str, found: Found) -> None:
    for n, line in enumerate(text.splitlines(), 1):
        m = re.match(r"""^(\s*(?:-\s+)*)(?:"([^"]+)"|'([^']+)'|([^\s#'"\[\]{},&*!|>%@`-][^:#]*?))\s*:(?=\s|$)""", line)
        if m:
            found.symbol("mapping_key", m[2] or m[3] or m[4], (n, len(m[1])), (n, len(line)))


EXTRACTORS = {"c": c_family, "cpp": c_family, "csharp": csharp, "typescript": javascript, "javascript": javascript, "java": java, "go": go, "rust": rust, "bash": bash, "yaml": yaml}
