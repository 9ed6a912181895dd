"""Units and measurements of sources whose blocks stand in braces: C, C++, C#, Go, Java, JavaScript, PHP, Rust, TypeScript.

A source is cut into tokens, brackets are paired, and statements are read one after the other; no grammar is kept. What a
language counts stands in one row of LANGUAGES. Boolean operators are met in the order of their expression tree (the
operators of a chain before what they join). Preprocessor lines, types and generics are passed over. A source with brackets
that do not pair raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lang:
    """else_: none, clause (an else is an event), held (an if with a plain else has it). elif_: whether an else-if joins its
    if or nests in it. default: what a default label is."""

    name: str
    else_: str = "clause"
    joined: bool = True
    switch_decides: bool = True
    default: str = "none"
    catch: bool = True
    parens: bool = True
    arrow: str | None = None
    header_counts: bool = False
    lambda_name: str = "closure"
    classes: frozenset = frozenset({"class", "interface", "enum", "struct", "record", "trait", "namespace", "impl", "mod", "union"})


LANGUAGES = {x.name: x for x in (
    Lang("c", else_="none", joined=False, switch_decides=False, default="decides", catch=False),
    Lang("cpp", else_="none", joined=False, switch_decides=False, default="decides", catch=False, lambda_name="lambda"),
    Lang("csharp", else_="held", default="decides", arrow="=>", lambda_name="lambda"),
    Lang("go", else_="held", default="plain", parens=False, header_counts=True, catch=False),
    Lang("java", else_="held", default="decides", arrow="->", lambda_name="lambda"),
    Lang("javascript", arrow="=>", header_counts=False),
    Lang("php", default="plain", joined=False, arrow="=>"),
    Lang("rust", joined=False, switch_decides=False, parens=False, catch=False),
    Lang("typescript", arrow="=>"))}
EXTENSIONS = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "go": "go",
              "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "php": "php",
              "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript"}

_STRINGS = {
    "rust": r"""r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^']*|[^'\\])'""",
    "go": r'''`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''',
    "csharp": r'''\$?@"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''',
    "java": r'''""".*?"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''',
    "js": r'''`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''',
    "php": r'''"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*\'''',
    "c": r'''"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\''''}
_OPS = r"=>|->|&&|\|\||\?\?=?|\?\.|::|:=|<-|\.\.\.|[-+*/%&|^!=<>]=|\+\+|--|[^\s\w]"
_JS = ("javascript", "typescript")


def _lexer(lang: str) -> re.Pattern:
    s = _STRINGS["js" if lang in _JS else "c" if lang == "cpp" else lang]
    hash_ = r"|#(?!\[)[^\n]*" if lang == "php" else r"|(?m:^[ \t]*#(?:\\\n|[^\n])*)" if lang in ("c", "cpp", "csharp") else ""
    return re.compile(rf"(?P<skip>//[^\n]*|/\*.*?\*/{hash_}|<\?php|\?>)|(?P<str>{s})|(?P<life>'\w+)|(?P<num>\d[\w.]*)|(?P<id>[$@]?[^\W\d]\w*|\$\w+)|(?P<op>{_OPS})", re.S)


_LEXERS = {name: _lexer(name) for name in LANGUAGES}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_FLOW = {"if", "for", "foreach", "while", "do", "switch", "match", "loop", "select", "try", "unsafe"}
_LEAVE = {"return", "throw", "break", "continue", "goto", "yield", "fallthrough", "echo"}
#: A slash after one of these begins a pattern, not a division.
_BEFORE_PATTERN = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "+"}


@dataclass
class _Meter:
    cognitive: int = 0
    decisions: int = 0
    statements: int = 0
    deepest: int = 0
    run: str | None = None

    def structural(self, depth: int, decides: bool = True) -> int:
        self.cognitive, self.decisions, self.run = self.cognitive + 1 + depth, self.decisions + decides, None
        self.deepest = max(self.deepest, depth + 1)
        return depth + 1

    def alternative(self, decides: bool) -> None:
        self.cognitive, self.decisions, self.run = self.cognitive + 1, self.decisions + decides, None

    def boolean(self, op: str) -> None:
        self.decisions += 1
        if self.run != op:
            self.cognitive, self.run = self.cognitive + 1, op

    def statement(self, jump: bool = False) -> None:
        self.statements, self.run = self.statements + 1, None
        if jump:
            self.alternative(False)


@dataclass
class _Reader:
    source: str
    lang: Lang
    tokens: list = field(default_factory=list)
    kinds: list = field(default_factory=list)
    lines: list = field(default_factory=list)
    pair: dict = field(default_factory=dict)
    units: list = field(default_factory=list)

    def __post_init__(self) -> None:
        ends = [m.start() for m in re.finditer("\n", self.source)]
        lexer, at, stack, last = _LEXERS[self.lang.name], 0, [], 0
        soft = self.lang.name == "go" or self.lang.name in _JS
        while at < len(self.source):
            if self.lang.name in _JS and self.source[at] == "/" and self.source[at:at + 2] not in ("//", "/*") and (
                    not self.tokens or self.tokens[-1] in _BEFORE_PATTERN):
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(self.source, at)
                kind = "str"
            else:
                m = lexer.match(self.source, at)
                kind = m.lastgroup if m else None
            if m is None:
                at += 1
                continue
            text, at = m[0], m.end()
            if kind == "skip":
                continue
            line = bisect_right(ends, m.start() - 1) + 1 if m.start() else 1
            if soft and self.tokens and line > last and (not stack or self.tokens[stack[-1]] == "{") and self._ends(text, kind):
                self._add(";", "soft", last)
            if text in _OPEN:
                stack.append(len(self.tokens))
            elif text in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]]] != text:
                    raise ValueError(f"line {line}: {text} without its pair")
                self.pair[stack.pop()] = len(self.tokens)
            self._add(text, "op" if kind == "op" else kind, line)
            last = line + text.count("\n")
        if stack:
            raise ValueError("a bracket is not closed")
        self._add(";", "soft", last)

    def _ends(self, text: str, kind: str) -> bool:
        """Whether a line that ends here ends a statement."""
        prev, kind_before = self.tokens[-1], self.kinds[-1]
        if self.lang.name == "go":
            return kind_before in ("id", "num", "str") and prev not in ("func", "if", "for", "switch", "else", "case", "var", "const", "import", "package", "type") or (
                prev in (")", "]", "}", "++", "--"))
        return (kind_before in ("id", "num", "str") and prev not in ("return", "else", "case", "typeof", "new", "in", "of", "await", "export", "default")
                or prev in (")", "]", "++", "--") or prev == "return" or prev == "}") and (
                kind in ("id", "num", "str") and text not in ("in", "of", "instanceof", "as") or text in ("{", "@", "#", "}"))

    def _add(self, text: str, kind: str, line: int) -> None:
        self.tokens.append(text)
        self.kinds.append(kind)
        self.lines.append(line)

    # Places.

    def close(self, i: int) -> int:
        return self.pair[i]

    def skip(self, i: int, hi: int) -> int:
        while i < hi and self.tokens[i] == ";" and self.kinds[i] == "soft":
            i += 1
        return i

    def find(self, i: int, hi: int, *what: str) -> int:
        """The first of these tokens in [i, hi) outside of brackets that open there; hi if none."""
        while i < hi:
            if self.tokens[i] in what:
                return i
            i = self.close(i) + 1 if i in self.pair else i + 1
        return hi

    # Declarations.

    def declarations(self, i: int, hi: int, box: str | None, parent: int | None, in_class: bool) -> None:
        """Members of a file, class or module: functions with bodies become units, fields are read for units inside."""
        while i < hi:
            if self.tokens[i] == "namespace" and self.lang.name in ("csharp", "php") and self.tokens[self.find(i, hi, ";", "{")] == ";":
                stop = self.find(i, hi, ";")
                box, i = self._box_name(i, stop), stop + 1
                continue
            i = self.declaration(i, hi, box, parent, in_class)

    def declaration(self, i: int, hi: int, box: str | None, parent: int | None, in_class: bool) -> int:
        t, name = self.tokens[i], self.lang.name
        if t == ";":
            return i + 1
        if name == "cpp" and t in ("public", "private", "protected") and self.tokens[i + 1] == ":":
            return i + 2
        if i in self.pair and t != "(":
            if t == "{":
                self.declarations(i + 1, self.close(i), box, parent, in_class)
            return self.close(i) + 1
        stop = self.find(i, hi, ";", "{")
        head = range(i, min(stop + 1, hi))
        boxed = next((k for k in head if self.tokens[k] in self.lang.classes and self.kinds[k] == "id" and (k == i or self.tokens[k - 1] not in (".", "::"))), None)
        if boxed is not None and stop < hi and self.tokens[stop] == "{" and self.find(i, stop, "(", "=") in (stop, *range(boxed, stop)) and not (
                name in ("c", "cpp", "rust") and self.find(i, stop, "(") < stop and self.tokens[boxed] != "impl" and name != "rust"):
            inner = self._box_name(boxed, stop)
            if box and name in ("csharp", "php"):
                inner = f"{box}.{inner}"
            kind = self.tokens[boxed]
            self.declarations(stop + 1, self.close(stop), inner, parent, kind not in ("namespace", "mod"))
            return self.close(stop) + 1
        fn = self._function(i, hi, in_class)
        if fn:
            label, left, body, kind, own = fn
            return self.unit(label, own or box, kind, i, left, body, parent, hi)
        end = self.find(i, hi, ";")
        if stop < end and self.find(i, stop, "=") == stop and name not in _JS and name != "go":
            # A block that belongs to no function: properties and initialisers.
            self._accessors(i, stop, box, parent)
            return self.close(stop) + 1
        if name in _JS or self.find(i, end, "=") < end:
            self.expression(self.find(i, end, "=") if in_class and self.find(i, end, "=") < end else i, end, 0, _Meter(), box, parent, name=self._field(i, end))
        return end + 1

    def _field(self, i: int, end: int) -> str | None:
        eq = self.find(i, end, "=", ":")
        names = [k for k in range(i, eq) if self.kinds[k] == "id"]
        return self.tokens[names[-1]] if names else None

    def _accessors(self, i: int, stop: int, box: str | None, parent: int | None) -> None:
        if self.lang.name != "csharp":
            self.block(stop, 0, _Meter(), box, parent)
            return
        k, hi = stop + 1, self.close(stop)
        while k < hi:
            if self.tokens[k] in ("get", "set", "init", "add", "remove") and self.tokens[k + 1] == "{":
                k = self.unit(self.tokens[k], box, "method", k, None, k + 1, parent, hi)
            else:
                k += 1

    def _box_name(self, k: int, stop: int) -> str:
        names = [j for j in range(k + 1, stop) if self.kinds[j] == "id" and self.tokens[j] not in ("class", "final")]
        if self.tokens[k] == "impl":
            at = self.find(k + 1, stop, "for")
            names = [j for j in names if j > at] or names
            return self.tokens[names[0]] if names else "<anonymous>"
        if not names:
            return "<anonymous>"
        label = self.tokens[names[0]]
        j = names[0] + 1
        while self.lang.name in ("csharp", "php") and self.tokens[k] == "namespace" and self.tokens[j] in (".", "\\"):
            label, j = f"{label}.{self.tokens[j + 1]}", j + 2
        return label

    def _function(self, i: int, hi: int, in_class: bool) -> tuple | None:
        """(name, place of the parameters or None, place of the body or of an arrow, kind, container) of a function at i."""
        name, tok = self.lang.name, self.tokens
        if name == "go":
            if tok[i] != "func":
                return None
            k, own = i + 1, None
            if tok[k] == "(":
                names = [j for j in range(k, self.close(k)) if self.kinds[j] == "id"]
                own = tok[names[-1]] if names else None
                k = self.close(k) + 1
            left = self.find(k, hi, "(")
            body = self._go_body(self.close(left) + 1, hi)
            return (tok[k], left, body, "method" if own else "function", own) if body < hi and tok[body] == "{" else None
        if name == "rust":
            k = self.find(i, hi, "fn", ";", "{", "=")
            if k >= hi or tok[k] != "fn" or any(self.kinds[j] == "num" for j in range(i, k)):
                return None
            left = self.find(k, hi, "(")
            body = self.find(self.close(left) + 1, hi, "{", ";")
            return tok[k + 1], left, body, "method" if in_class else "function", None
        if name in _JS or name == "php":
            k = i
            while k < hi and tok[k] in ("export", "default", "async", "static", "public", "private", "protected", "abstract", "final", "get", "set", "readonly", "override", "*", "#", "declare") and tok[k + 1] not in ("(", "=", ";"):
                k += 1
            if k < hi and tok[k] == "function":
                k += 1
                while tok[k] in ("*", "&"):
                    k += 1
                if self.kinds[k] != "id":
                    return None
            elif not (in_class and name in _JS) or self.kinds[k] not in ("id", "str") and tok[k] != "[":
                return None
            label = tok[k]
            left = self.close(k) + 1 if tok[k] == "[" else k + 1
            if tok[left] == "<":
                left = self.find(left, hi, "(")
            if left >= hi or tok[left] != "(":
                return None
            body = self.find(self.close(left) + 1, hi, "{", ";", "=")
            return (label, left, body, "method" if in_class else "function", None) if body < hi and tok[body] == "{" else None
        left = self.find(i, hi, "(", ";", "{", "=")
        while left < hi and tok[left] == "(" and (left == i or self.kinds[left - 1] != "id" and tok[left - 1] not in (">", "]")):
            left = self.find(self.close(left) + 1, hi, "(", ";", "{", "=")
        if left >= hi or tok[left] != "(" or tok[left - 1] in ("if", "for", "while", "switch", "return", "catch"):
            return None
        k = self.close(left) + 1
        body = self.find(k, hi, "{", ";", "=", "=>") if name != "csharp" else self.find(k, hi, "{", ";", "=>")
        if body >= hi or tok[body] in (";", "="):
            return None
        at = next((j for j in range(left - 1, i - 1, -1) if self.kinds[j] == "id"), i)
        return tok[at], left, body, "method" if in_class or name in ("java", "csharp") else "function", None

    def _go_body(self, k: int, hi: int) -> int:
        """The brace of a body behind a result: types may hold braces of their own."""
        while True:
            k = self.find(k, hi, "{", ";")
            if k < hi and self.tokens[k] == "{" and self.tokens[k - 1] in ("struct", "interface"):
                k = self.close(k) + 1
                continue
            return k

    # Units.

    def unit(self, label: str, box: str | None, kind: str, start: int, left: int | None, body: int, parent: int | None, hi: int,
             stop: int | None = None) -> int:
        """Read a unit; returns the place behind it. body: a brace, an arrow, or the semicolon of a signature."""
        n, m = len(self.units), _Meter()
        self.units.append(None)
        params = self.parameters(left) if isinstance(left, int) else 0
        if isinstance(left, int):
            self.expression(left + 1, self.close(left), 0, m, box, n)
        if self.tokens[body] == "{":
            end = self.close(body)
            self.block(body, 0, m, box, n)
        elif self.tokens[body] == ";":
            end = body
        else:
            at = body + 1
            end = (self.find(at, hi, ";") if stop is None else stop) - 1
            if self.tokens[at] == "{":
                end = self.close(at)
                self.block(at, 0, m, box, n)
            else:
                if self.lang.name in ("csharp", "php") and kind in ("method", "function") or self.lang.name == "php":
                    m.statement()
                self.expression(at, end + 1, 0, m, box, n)
        text = " ".join(self.tokens[start:end + 1])
        self.units[n] = {
            "ordinal": n, "name": label, "container": box, "kind": kind, "start_line": self.lines[start], "end_line": self.lines[end],
            "parent_ordinal": parent, "cognitive": m.cognitive, "cyclomatic": 1 + m.decisions, "logical_lines": m.statements,
            "max_nesting": m.deepest, "parameter_count": params, "fingerprint": hashlib.sha256(text.encode()).hexdigest()}
        return end + 1

    def parameters(self, left: int) -> int:
        hi, n, k = self.close(left), 0, left + 1
        if self.lang.name in ("c", "cpp") and hi == left + 2 and self.tokens[k] == "void":
            return 0
        while k < hi:
            end = k
            depth = 0
            while end < hi and (self.tokens[end] != "," or depth > 0):
                depth += (self.tokens[end] == "<") - (self.tokens[end] == ">")
                end = self.close(end) + 1 if end in self.pair else end + 1
            n += end > k
            k = end + 1
        return n

    # Statements.

    def block(self, i: int, depth: int, m: _Meter, box: str | None, n: int | None) -> None:
        self.statements(i + 1, self.close(i), depth, m, box, n)

    def statements(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> None:
        while i < hi:
            i = self.statement(i, hi, depth, m, box, n)

    def statement(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> int:
        i = self.skip(i, hi)
        if i >= hi:
            return hi
        t, name = self.tokens[i], self.lang.name
        if t == ";":
            return i + 1
        if t == "{":
            self.block(i, depth, m, box, n)
            return self.close(i) + 1
        if self.kinds[i] == "life" and self.tokens[i + 1] == ":" or (
                self.kinds[i] == "id" and t not in ("case", "default") and i + 2 < hi and self.tokens[i + 1] == ":" and self.tokens[i + 2] in _FLOW):
            return self.statement(i + 2, hi, depth, m, box, n)
        if t in _FLOW and self.kinds[i] == "id" and (self.lang.name != "php" or t != "match"):
            end = self.flow(i, hi, depth, m, box, n)
            if end is not None:
                return end
        if t in ("class", "interface", "enum", "struct", "trait", "impl", "mod") and self.kinds[i] == "id" and self.find(i, hi, "{") < self.find(i, hi, ";", "=", "("):
            return self.declaration(i, hi, box, n, False)
        fn = None
        if name in _JS and (t == "function" or t == "async" and self.tokens[i + 1] == "function") or name == "php" and t == "function" and self.kinds[i + 1] == "id" \
                or name == "rust" and t in ("fn", "pub", "const", "async") and self.find(i, hi, "fn", ";", "=", "{") < hi and self.tokens[self.find(i, hi, "fn", ";", "=", "{")] == "fn":
            fn = self._function(i, hi, False)
        elif name == "csharp" and self.kinds[i] == "id" and t not in _LEAVE and self.kinds[i + 1] == "id" and self.tokens[i + 2] == "(":
            fn = self._function(i, hi, False)
        if fn:
            return self.unit(fn[0], box, "function", i, fn[1], fn[2], n, hi)
        return self.simple(i, hi, depth, m, box, n)

    def simple(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> int:
        """An expression or declaration up to its end."""
        t, name = self.tokens[i], self.lang.name
        end = self.find(i, hi, ";")
        if name == "rust":
            if t == "let" or t in ("use", "type", "static"):
                if t == "let":
                    m.statement()
                self.expression(i + 1, end, depth, m, box, n, name=None)
                return end + 1
            if end < hi:
                m.statement()
            self.expression(i, end, depth, m, box, n)
            return end + 1
        if name == "go" and t in ("var", "const"):
            if self.tokens[i + 1] == "(":
                k, stop = i + 2, self.close(i + 1)
                while k < stop:
                    e = self.find(k, stop, ";")
                    if e > k:
                        m.statement()
                        self.expression(k, e, depth, m, box, n)
                    k = e + 1
                return self.close(i + 1) + 1
            m.statement()
            self.expression(i + 1, end, depth, m, box, n)
            return end + 1
        if t in ("package", "import", "use", "using", "typedef", "type") and name != "javascript":
            return end + 1
        m.statement()
        start = i + 1 if t in _LEAVE else i
        self.expression(start, end, depth, m, box, n, name=None if t in _LEAVE else self._target(i, end))
        return end + 1

    def _target(self, i: int, end: int) -> str | None:
        eq = self.find(i, end, "=", ":=")
        if eq == end:
            return None
        stop = self.find(i, eq, ":") if self.lang.name == "typescript" else eq
        names = [k for k in range(i, stop) if self.kinds[k] == "id"]
        return self.tokens[names[-1]] if names else None

    def header(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None, loop: bool) -> tuple[int, int]:
        """(end of the header, place behind it). Its parts are read: declarations in it are statements."""
        if self.lang.parens:
            left = i
            if self.tokens[left] != "(":
                return i, i
            lo, stop, after = left + 1, self.close(left), self.close(left) + 1
        else:
            stop = self.find(i, hi, "{")
            lo, after = i, stop
        parts, k = [], lo
        while k <= stop:
            e = self.find(k, stop, ";")
            parts.append((k, e))
            k = e + 1
        for p, (a, b) in enumerate(parts):
            if a >= b:
                continue
            if self.lang.name == "go":
                if len(parts) > 1 and p != (1 if loop else len(parts) - 1) and self.find(a, b, "range") == b:
                    m.statement()
            elif len(parts) > 1 and p == 0 and self._declares(a, b):
                m.statement()
            self.expression(a, b, depth, m, box, n)
        return stop, after

    def _declares(self, a: int, b: int) -> bool:
        if self.lang.name in _JS:
            return self.tokens[a] in ("let", "const", "var")
        if self.lang.name in ("php", "csharp", "rust"):
            return False
        return self.kinds[a] == "id" and (self.kinds[a + 1] == "id" or self.tokens[a + 1] in ("*", "<", "[", "::", "&"))

    def body(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> int:
        i = self.skip(i, hi)
        return self.statement(i, hi, depth, m, box, n) if i < hi else hi

    def flow(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> int | None:
        t, lang = self.tokens[i], self.lang
        if t == "unsafe" or t == "try" and self.tokens[i + 1] == "{":
            if self.tokens[i + 1] != "{":
                return None
            self.block(i + 1, depth, m, box, n)
            return self._handlers(self.close(i + 1) + 1, hi, depth, m, box, n)
        if t == "try":
            if self.tokens[i + 1] == "(":
                self.expression(i + 2, self.close(i + 1), depth, m, box, n)
                b = self.close(i + 1) + 1
                self.block(b, depth, m, box, n)
                return self._handlers(self.close(b) + 1, hi, depth, m, box, n)
            return None
        if lang.parens and t not in ("do", "loop") and self.tokens[i + 1] != "(" and not (t == "for" and self.tokens[i + 1] in ("await", "each")):
            return None
        if t == "if":
            return self._if(i, hi, depth, m, box, n, joined=False)
        if t == "do":
            inner = m.structural(depth)
            k = self.skip(self.body(i + 1, hi, inner, m, box, n), hi)
            if k < hi and self.tokens[k] == "while":
                self.expression(k + 2, self.close(k + 1), inner, m, box, n)
                k = self.close(k + 1) + 1
            return k
        if t in ("switch", "select") or t == "match":
            return self._switch(i, hi, depth, m, box, n)
        inner = m.structural(depth)
        at = i + 1
        while lang.parens and self.tokens[at] != "(":
            at += 1
        _, after = self.header(at, hi, inner, m, box, n, True) if t != "loop" else (i + 1, i + 1)
        return self.body(after, hi, inner, m, box, n)

    def _handlers(self, k: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> int:
        k = self.skip(k, hi)
        while k < hi and self.tokens[k] in ("catch", "finally"):
            inner = depth
            if self.tokens[k] == "catch" and self.lang.catch:
                inner = m.structural(depth)
            b = self.find(k, hi, "{")
            self.block(b, inner, m, box, n)
            k = self.skip(self.close(b) + 1, hi)
        return k

    def _if(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None, joined: bool) -> int:
        """joined: this if continues an else of the one before, at the depth that depth already is."""
        lang = self.lang
        inner = depth if joined else depth + 1
        if joined:
            m.alternative(True)
        else:
            m.structural(depth)
        at = i + 1
        if lang.else_ == "held" and self._plain_else(i, hi):
            m.alternative(False)
        _, after = self.header(at, hi, inner, m, box, n, False)
        k = self.skip(self.body(after, hi, inner, m, box, n), hi)
        if k >= hi or self.tokens[k] not in ("else", "elseif"):
            return k
        follows = self.tokens[k + 1] == "if" and self.tokens[k] == "else"
        if self.tokens[k] == "elseif":
            return self._if(k, hi, inner, m, box, n, joined=True)
        if follows and lang.joined:
            return self._if(k + 1, hi, inner, m, box, n, joined=True)
        if lang.else_ == "clause":
            m.alternative(False)
        if follows:
            return self._if(k + 1, hi, inner, m, box, n, joined=False)
        return self.body(k + 1, hi, inner, m, box, n)

    def _plain_else(self, i: int, hi: int) -> bool:
        """Whether the else of the if at i is no if."""
        after = self.close(i + 1) + 1 if self.lang.parens else self.find(i + 1, hi, "{")
        k = self.skip(self._behind(self.skip(after, hi), hi), hi)
        return k < hi and self.tokens[k] == "else" and self.tokens[k + 1] != "if"

    def _behind(self, i: int, hi: int) -> int:
        """The place behind a statement, without reading it."""
        keep, self.units = self.units, []
        try:
            return self.statement(i, hi, 0, _Meter(), None, None)
        finally:
            self.units = keep

    def _switch(self, i: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> int:
        inner, lang = m.structural(depth, self.lang.switch_decides), self.lang
        _, after = self.header(i + 1, hi, inner, m, box, n, False)
        after = self.skip(after, hi)
        k, stop = after + 1, self.close(after)
        if lang.name == "rust":
            while k < stop:
                arrow = self.find(k, stop, "=>")
                if arrow == stop:
                    break
                m.alternative(True)
                guard = self.find(k, arrow, "if")
                if guard < arrow:
                    self.expression(guard + 1, arrow, inner, m, box, n)
                k = arrow + 1
                end = self.close(k) + 1 if self.tokens[k] == "{" else self.find(k, stop, ",")
                if self.tokens[k] == "{":
                    self.block(k, inner, m, box, n)
                else:
                    self.expression(k, end, inner, m, box, n)
                k = end + (end < stop and self.tokens[end] == ",")
            return stop + 1
        labelled = False
        while k < stop:
            k = self.skip(k, stop)
            if k >= stop:
                break
            t = self.tokens[k]
            if t in ("case", "default") and self.kinds[k] == "id":
                plain = t == "default"
                if not (labelled and lang.name == "csharp"):
                    if not plain or lang.default == "decides":
                        m.alternative(True)
                    elif lang.default == "plain":
                        m.alternative(False)
                end = self.find(k, stop, ":", "->", "=>")
                self.expression(k + 1, end, inner, m, box, n)
                k, labelled = end + 1, True
            else:
                labelled = False
                k = self.statement(k, stop, inner, m, box, n)
        return stop + 1

    # Expressions.

    def expression(self, lo: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None, name: str | None = None) -> None:
        k = lo
        while k < hi:
            end = self._item(k, hi)
            self.item(k, end, depth, m, box, n, name)
            k = end + 1

    def _item(self, k: int, hi: int) -> int:
        if self.lang.name != "rust":
            return self.find(k, hi, ",")
        end = self.find(k, hi, ",", "|", "||")
        while end < hi and self.tokens[end] != ",":
            if self._opens_closure(end):
                return hi  # the commas of its parameters end nothing
            end = self.find(end + 1, hi, ",", "|", "||")
        return end

    def _opens_closure(self, k: int) -> bool:
        return k == 0 or self.tokens[k - 1] in ("(", ",", "=", "=>", "{", ";", "return", "move", "else", "&&", "||")

    def item(self, lo: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None, name: str | None) -> None:
        if lo >= hi:
            return
        lang, tok = self.lang, self.tokens
        eq = self.find(lo, hi, "=", ":=", "+=", "-=", "*=", "/=", "|=", "&=", "??=")
        arrow = self.find(lo, hi, lang.arrow) if lang.arrow else hi
        if eq < min(hi, arrow):
            left = [j for j in range(lo, eq) if self.kinds[j] == "id"]
            if lang.name == "typescript" and self.find(lo, eq, ":") < eq:
                left = [j for j in left if j < self.find(lo, eq, ":")]
            self.chain(lo, eq, depth, m, box, n)
            self.item(eq + 1, hi, depth, m, box, n, tok[left[-1]] if left else name)
            return
        if arrow < hi and lang.name != "php":
            start = arrow - 1
            if tok[start] == ")":
                start = next(a for a, b in self.pair.items() if b == start)
            elif lang.name == "typescript" and self.find(lo, arrow, ")") == arrow:
                open_ = self.find(lo, arrow, "(")
                start = open_ if open_ < arrow else start
            if start > lo and tok[start - 1] == "async":
                start -= 1
            left = start + 1 if tok[start] == "async" else start
            head = self.find(lo, start, ":") if lang.name in _JS else start
            label = tok[head - 1] if lang.name in _JS and head < start and head > lo else name
            if lang.lambda_name == "lambda" and lang.name != "csharp" or label is None:
                label = f"<{lang.lambda_name} {self.lines[start]}>"
            self.chain(lo, start, depth, m, box, n)
            before = len(self.units)
            if tok[left] == "(":
                self.unit(label, box, lang.lambda_name, start, left, arrow, n, hi, stop=hi)
            else:
                self.unit(label, box, lang.lambda_name, start, None, arrow, n, hi, stop=hi)
                self.units[before]["parameter_count"] = 1
            return
        if lang.name == "php" and tok[lo] in ("fn", "function", "static"):
            self.primary(lo, hi, depth, m, box, n, name)
            return
        self.ternary(lo, hi, depth, m, box, n, name)

    def ternary(self, lo: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None, name: str | None = None) -> None:
        if self.lang.name not in ("rust", "go"):
            q = self.find(lo, hi, "?")
            while q < hi and self.tokens[q + 1] in (":", ",", ")", ";", ">", "[", "."):  # types and optional marks
                q = self.find(q + 1, hi, "?")
            if q < hi:
                level, c = 0, q + 1
                while c < hi:
                    if self.tokens[c] == "?":
                        level += 1
                    elif self.tokens[c] == ":":
                        if not level:
                            break
                        level -= 1
                    c = self.close(c) + 1 if c in self.pair else c + 1
                if c < hi:
                    inner = m.structural(depth)
                    self.chain(lo, q, inner, m, box, n)
                    self.ternary(q + 1, c, inner, m, box, n)
                    self.ternary(c + 1, hi, inner, m, box, n)
                    return
        self.chain(lo, hi, depth, m, box, n, name)

    def chain(self, lo: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None, name: str | None = None) -> None:
        for op in ("||", "&&"):
            if op == "||" and self.lang.name == "rust" and (self.tokens[lo] in ("||", "|", "move") if lo < hi else True):
                break
            parts, k = [lo], lo
            while (k := self.find(k, hi, op)) < hi:
                parts.append(k + 1)
                k += 1
            if len(parts) > 1:
                for _ in parts[1:]:
                    m.boolean(op)
                for a, b in zip(parts, [*(p - 1 for p in parts[1:]), hi]):
                    self.chain(a, b, depth, m, box, n)
                return
        self.primary(lo, hi, depth, m, box, n, name)

    def primary(self, k: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None, name: str | None) -> None:
        lang, tok = self.lang, self.tokens
        while k < hi:
            t = tok[k]
            if lang.name == "rust" and t in ("|", "||") and self._opens_closure(k):
                right = k if t == "||" else self.find(k + 1, hi, "|")
                at = len(self.units)
                arrow = right
                if tok[right + 1] == "->":
                    arrow = self.find(right, hi, "{") - 1
                self.unit(f"<closure {self.lines[k]}>", box, "closure", k - (tok[k - 1] == "move"), None, arrow, n, hi, stop=hi)
                self.units[at]["parameter_count"] = 0 if t == "||" else self._listed(k + 1, right)
                return
            if lang.name == "rust" and t in ("return", "break", "continue"):
                labelled = t != "return" and any(self.kinds[j] == "life" for j in range(k, hi))
                m.statement(jump=labelled)
            elif t in _FLOW and self.kinds[k] == "id" and (lang.name == "rust" or t in ("switch", "match") and lang.name in ("java", "php")):
                end = self.flow(k, hi, depth, m, box, n)
                if end is not None:
                    k = end
                    continue
            elif lang.name == "csharp" and t == "switch" and k + 1 < hi and tok[k + 1] == "{":
                inner, a, stop = m.structural(depth), k + 2, self.close(k + 1)
                while a < stop:
                    arrow, e = self.find(a, stop, "=>"), self.find(a, stop, ",")
                    m.alternative(True)
                    self.ternary(arrow + 1, e, inner, m, box, n)
                    a = e + 1
                k = stop + 1
                continue
            elif t == "func" and lang.name == "go" or t == "function" and (lang.name in _JS or lang.name == "php") or t == "fn" and lang.name == "php":
                left = self.find(k, hi, "(")
                if left < hi:
                    own = tok[left - 1] if self.kinds[left - 1] == "id" and left - 1 > k else None
                    label = own or (name if lang.name != "javascript" and lang.name != "typescript" else None) or f"<closure {self.lines[k]}>"
                    body = self._go_body(self.close(left) + 1, hi) if lang.name == "go" else self.find(self.close(left) + 1, hi, "{", "=>")
                    if body < hi:
                        k = self.unit(label, box, "closure" if lang.name not in _JS else "function", k, left, body, n, hi, stop=hi if tok[body] == "=>" else None)
                        continue
            elif t == "class" and lang.name in _JS and self.find(k, hi, "{") < hi:
                b = self.find(k, hi, "{")
                self.declarations(b + 1, self.close(b), self._box_name(k, b), n, True)
                k = self.close(b) + 1
                continue
            elif t == "[" and lang.name == "cpp" and (k == 0 or self.kinds[k - 1] not in ("id",) and tok[k - 1] not in (")", "]")):
                left = self.close(k) + 1
                body = self.find(left, hi, "{")
                if body < hi:
                    k = self.unit(f"<lambda {self.lines[k]}>", box, "lambda", k, left if tok[left] == "(" else None, body, n, hi)
                    continue
            if k in self.pair:
                e = self.close(k)
                if t == "{" and lang.name == "java" and tok[k - 1] == ")":
                    self.declarations(k + 1, e, box, n, True)
                elif t == "{" and lang.name == "rust":
                    if self.find(k, e, ";") < e or tok[k - 1] in ("else", "{", "=", "=>", "(") or self.kinds[k - 1] != "id":
                        self.block(k, depth, m, box, n)
                    else:
                        self.expression(k + 1, e, depth, m, box, n)
                elif t == "{" and lang.name in _JS:
                    self._object(k + 1, e, depth, m, box, n)
                else:
                    self.expression(k + 1, e, depth, m, box, n)
                k = e + 1
                continue
            k += 1

    def _listed(self, a: int, b: int) -> int:
        n, k = 0, a
        while k < b:
            e = self.find(k, b, ",")
            n += e > k
            k = e + 1
        return n

    def _object(self, lo: int, hi: int, depth: int, m: _Meter, box: str | None, n: int | None) -> None:
        k = lo
        while k < hi:
            end = self.find(k, hi, ",")
            fn = self._function(k, end, True)
            if fn and self.find(k, end, ":", "=>", "?") > fn[1]:
                self.unit(fn[0], box, "method", k, fn[1], fn[2], n, end)
            else:
                colon = self.find(k, end, ":")
                self.item(colon + 1 if colon < end else k, end, depth, m, box, n, self.tokens[colon - 1] if k < colon < end else None)
            k = end + 1


def units(source: str, language: str) -> list[dict]:
    """Units in the order of their text; ValueError for a source whose brackets do not pair."""
    r = _Reader(source, LANGUAGES[language])
    try:
        r.declarations(0, len(r.tokens), None, None, False)
    except (IndexError, KeyError, StopIteration) as e:
        raise ValueError(f"not readable as {language}") from e
    return [u for u in r.units if u is not None]


# Import statements of each language: the first group with a match is the target.
_IMPORTS = {
    "c": r'^[ \t]*#[ \t]*include[ \t]*(?:<([^>\n]+)>|"([^"\n]+)")',
    "csharp": r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;",
    "java": r"(?:^|;)[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;",
    "javascript": r"""(?:^|[;\s])(?:import|export)\s+(?:[\w*{}$,\s]+?\s+from\s+)?["']([^"'\n]+)["']|\b(?:require|import)\(\s*["']([^"'\n]+)["']\s*\)""",
    "php": r"""^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?([\w\\]+)|\b(?:require|include)(?:_once)?[ \t(]+["']([^"'\n]+)["']""",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:use[ \t]+([\w:]+)|mod[ \t]+(\w+)[ \t]*;)"}
_IMPORTS |= {"cpp": _IMPORTS["c"], "typescript": _IMPORTS["javascript"]}
_GO_IMPORT = re.compile(r'^[ \t]*import[ \t]*(?:\(([^)]*)\)|(?:[\w.]+[ \t]+)?"([^"\n]+)")', re.M)


def imports(source: str, language: str) -> list[tuple[str, int]]:
    """(target, line) of every import, as it is written, without comments."""
    clean = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]) if "://" not in source[m.start() - 1:m.start() + 2] else m[0], source, flags=re.S)
    line = lambda at: clean.count("\n", 0, at) + 1
    if language == "go":
        out = []
        for m in _GO_IMPORT.finditer(clean):
            if m[2]:
                out.append((m[2], line(m.start(2))))
            else:
                out += [(x[1], line(m.start(1) + x.start(1))) for x in re.finditer(r'"([^"\n]+)"', m[1])]
        return out
    found = re.finditer(_IMPORTS[language], clean, re.M)
    return [(("self::" if language == "rust" and m.lastindex == 2 else "") + m[m.lastindex], line(m.start(m.lastindex))) for m in found if m.lastindex]
