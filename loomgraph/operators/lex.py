"""Tokens and declarations of languages with brackets.

`tokens` reads a text once, with a stack of modes: a hole in a template or an interpolated string is read like code, and its closing
bracket goes on with the string. Comments, raw strings, text blocks, lifetimes and regular expressions are told apart by language.
`outline` goes over the tokens once, with a stack of the brackets that are open and what each holds (a file, a type's body, an
object, a block): what a name followed by a bracket means depends on that. Types aren't checked and macros aren't expanded.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

SCRIPTS = ("typescript", "tsx", "javascript")
NAME, STRING, OTHER, INCLUDE = "name", "string", "other", "include"


class Token(NamedTuple):
    kind: str
    value: str
    start: int
    end: int
    line: bool  # the first one of its line


PLAIN = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: Strings by language: what is read whole.
STRINGS = {
    "rust": r"[bc]?r(?P<mark>#*)\".*?\"(?P=mark)|[bc]?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])'",
    "go": r"`[^`]*`|" + PLAIN,
    "java": r"\"\"\"(?:\\.|[^\\])*?\"\"\"|" + PLAIN,
    "csharp": r"\$*(?P<mark>\"{3,}).*?(?P=mark)|(?:@\$?|\$@)\"(?:\"\"|[^\"])*\"|" + PLAIN,
    "cpp": r"(?:u8|[uUL])?R\"(?P<mark>[^()\\\s]{0,16})\(.*?\)(?P=mark)\"|(?:u8|[uUL])?(?:" + PLAIN + ")",
}
#: Quote that opens a string with holes, what goes on inside it, what opens a hole.
HOLES = {**dict.fromkeys(SCRIPTS, ("`", re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S), "${")), "csharp": ('$"', re.compile(r"(?:\\.|\{\{|\}\}|[^\"\\{\n])*"), "{")}
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
DIRECTIVE = re.compile(r"#(?:\\\r?\n|[^\n])*")
INCLUDED = re.compile(r"#\s*include\s*[<\"]([^>\"\n]*)[>\"]")
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}


@cache
def _reader(lang: str) -> re.Pattern:
    parts = [r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"]
    if lang == "rust":
        parts[0] = r"(?P<skip>\s+|//[^\n]*|'[A-Za-z_]\w*(?!\w*'))"
    parts += [rf"(?P<string>{STRINGS.get(lang, PLAIN)})", r"(?P<name>(?:r\#)?[^\W\d][\w$]*|\$[\w$]*)" if lang == "rust" else r"(?P<name>[^\W\d][\w$]*|[$@][\w$]+)", r"(?P<number>\d(?:[\w.]|'(?=\w))*)", r"(?P<other>=>|->|::|==|!=|<=|>=|&&|\|\||\?\.|.)"]
    return re.compile("|".join(parts), re.S)


def _comment_end(text: str, at: int) -> int:
    """Behind a comment that may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def tokens(text: str, lang: str) -> list[Token]:
    reader, (quote, inside, hole) = _reader(lang), HOLES.get(lang, ("\0", re.compile(""), ""))
    out: list[Token] = []
    modes: list[int] = []  # brackets that were open where a hole opened
    at, depth, line, n = 0, 0, True, len(text)

    def literal(start: int, at: int) -> int:
        """Read a string with holes from behind its quote or a hole; emits what is read."""
        at = inside.match(text, at).end()
        if text.startswith(hole, at):
            modes.append(depth)
            at += len(hole)
        else:
            at = min(n, at + 1)
        out.append(Token(STRING, "", start, at, line))
        return at

    while at < n:
        if modes and modes[-1] == depth and text[at] == "}":
            modes.pop()
            at = literal(at, at + 1)
            continue
        if text.startswith(quote, at):
            at, line = literal(at, at + len(quote)), False
            continue
        if lang == "rust" and text.startswith("/*", at):
            at = _comment_end(text, at)
            continue
        if lang in SCRIPTS and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (not out or (out[-1].kind == OTHER and out[-1].value not in (")", "]", "}")) or out[-1].value in BEFORE_PATTERN):
            m = PATTERN.match(text, at)
            if m:
                out.append(Token(STRING, "", at, m.end(), line))
                at, line = m.end(), False
                continue
        if lang == "cpp" and text[at] == "#" and line:
            m = DIRECTIVE.match(text, at)
            if INCLUDED.match(m[0]):
                out.append(Token(INCLUDE, m[0], at, m.end(), line))
            at = m.end()
            continue
        m = reader.match(text, at)
        kind, value = m.lastgroup, m[0]
        if kind == "mark":
            kind = "string"
        if kind == "skip":
            line = line or "\n" in value
        else:
            value = value.removeprefix("r#") if lang == "rust" and kind == "name" else value
            out.append(Token({"name": NAME, "string": STRING}.get(kind, OTHER if kind == "other" else "number"), value, at, m.end(), line))
            depth += (value in ("(", "[", "{")) - (value in (")", "]", "}")) if kind == "other" else 0
            line = False
        at = m.end()
    return out


CLOSES = {")": "(", "]": "[", "}": "{"}


def pairs(toks: list[Token]) -> list[int]:
    """For each opening bracket the index of its closing one (the last token's where there is none); for others, their own."""
    out, open_ = list(range(len(toks))), []
    for i, t in enumerate(toks):
        if t.kind == OTHER:
            if t.value in ("(", "[", "{"):
                open_.append(i)
            elif t.value in CLOSES and any(toks[j].value == CLOSES[t.value] for j in open_[-3:]):
                while toks[open_[-1]].value != CLOSES[t.value]:
                    out[open_.pop()] = i
                out[open_.pop()] = i
    for j in open_:
        out[j] = len(toks) - 1
    return out


#: Words that a bracket can follow without a call, in all languages and by language.
COMMON = {"if", "for", "while", "switch", "return", "else", "do", "case"}
OWN_WORDS = {
    "rust": {"fn", "match", "in", "as", "pub", "crate", "self", "Self", "where", "let", "loop", "unsafe", "async", "await", "move", "mut", "ref", "dyn", "impl", "use", "super"},
    "go": {"func", "range", "select", "go", "defer", "type", "const", "var", "import", "interface", "struct", "map", "chan"},
    "java": {"catch", "new", "super", "this", "try", "synchronized", "throw", "assert"},
    "csharp": {"catch", "foreach", "new", "base", "this", "try", "lock", "fixed", "using", "nameof", "typeof", "sizeof", "default", "throw", "when", "is", "and", "or", "not", "checked", "unchecked", "await", "in", "out"},
    "cpp": {"catch", "sizeof", "decltype", "alignof", "noexcept", "throw", "new", "delete", "operator", "this", "alignas", "requires", "static_assert", "explicit"},
    **dict.fromkeys(SCRIPTS, {"catch", "function", "new", "await", "typeof", "super", "import", "require", "constructor", "this", "throw", "in", "of", "void", "delete", "yield", "async", "with"}),
}
MODIFIERS = {"export", "default", "declare"}
GOES_ON = {".", "?.", "+", "-", "*", "/", "%", "=", "=>", "?", ":", "&&", "||", ",", "&", "|", "<", ">", "==", "!=", "<=", ">=", "^"}


class Outline:
    """Definitions (kind, name, start, end), references (name, kind, start, end) and imports (specifier, position) of one text."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.words = COMMON | OWN_WORDS[lang]
        self.t = tokens(text, lang)
        self.pair = pairs(self.t)
        self.defs: list[tuple[str, str, int, int]] = []
        self.refs: list[tuple[str, str, int, int]] = []
        self.imports: list[tuple[str, int]] = []
        self.heads: set[int] = set()  # names that are declared, not called
        self.holds: dict[int, str] = {}  # what the block behind an opening bracket holds
        self.read()

    # Looking at tokens

    def at(self, i: int) -> str:
        """A token's text; strings have none."""
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind != STRING else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == NAME

    def past_angles(self, i: int) -> int:
        """Behind a list in angle brackets that starts at i; i itself where none does."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < min(len(self.t), i + 400):
            x = self.at(j)
            depth += (x == "<") - (x == ">")
            if x == ";" or x in CLOSES:
                break
            if not depth:
                return j + 1
            j = self.pair[j] + 1 if x in ("(", "[", "{") else j + 1
        return i

    def statement_end(self, i: int, block: bool, lines: bool = False) -> tuple[int, int]:
        """(position, index of the block or -1): where what goes on at i ends: at a block, if it may have one, else at a semicolon, at the bracket around it, or, with `lines`, at the end of a line that nothing goes on."""
        j = i
        while j < len(self.t):
            x = self.at(j)
            if x == ";":
                return self.t[j].end, -1
            if x in CLOSES:
                break
            if lines and j > i and self.t[j].line and x not in GOES_ON and self.at(j - 1) not in GOES_ON and x != "{":
                break
            if x == "{" and block:
                return self.t[self.pair[j]].end, j
            j = self.pair[j] + 1 if x in ("(", "[", "{") else j + 1
        return (self.t[j - 1].end if j else 0), -1

    def define(self, kind: str, i: int, first: int, holds: str, block: bool = True, lines: bool = False, name: str | None = None, frm: int | None = None) -> None:
        """A declaration whose name stands at i and whose first token is `first`; the block it has holds `holds`."""
        end, brace = self.statement_end(i if frm is None else frm, block, lines)
        if brace >= 0:
            self.holds[brace] = holds
        self.heads.add(i)
        self.defs.append((kind, name or self.at(i), self.t[first].start, end))

    def uses(self, i: int, start: int, end: int) -> None:
        if self.named(i):
            self.refs.append((self.at(i), "uses", start, end))

    # One pass

    def read(self) -> None:
        t, frames, first, i = self.t, [], 0, 0
        step = getattr(self, f"_{'script' if self.lang in SCRIPTS else self.lang}")
        assigned = False
        while i < len(t):
            x = self.at(i)
            while frames and i > frames[-1][0]:
                frames.pop()
            if frames and i == frames[-1][0]:
                kind = frames.pop()[1]
                if x == "}" and kind != "arguments":
                    first, assigned = i + 1, False
            elif x in ("(", "[", "{"):
                held = self.holds.get(i, "object" if x == "{" and self._is_object(i) else "block" if x == "{" else "arguments")
                skipped = self._attribute(i, x)
                if skipped:
                    i = first = skipped
                    continue
                if self.lang == "csharp" and x == "[" and i == first:
                    self.heads |= set(range(i, self.pair[i]))
                frames.append((self.pair[i], held))
                if x == "{":
                    first, assigned = i + 1, False
            elif x == ";" or (x == "," and frames and frames[-1][1] == "object"):
                first, assigned = i + 1, False
            elif x == "=":
                assigned = True
            elif x == ":" and self.at(i - 1) in ("public", "private", "protected"):
                first = i + 1
            elif t[i].kind in (NAME, INCLUDE):
                if self.lang in (*SCRIPTS, "go") and t[i].line and i > first and (not frames or frames[-1][1] != "arguments") and self.at(i - 1) not in GOES_ON and self.at(i - 1) not in ("(", "["):
                    first, assigned = i, False
                while self.at(first) in MODIFIERS and self.lang in SCRIPTS and first < i:
                    first += 1
                where = frames[-1][1] if frames else "file"
                step(i, x, min(first, i), where, assigned)
                if where != "fields":
                    self._call(i, x)
            i += 1

    def _attribute(self, i: int, x: str) -> int:
        """Where a declaration can begin behind a Rust attribute that opens at i; 0: it is none."""
        if self.lang == "rust" and x == "[" and (self.at(i - 1) == "#" or (self.at(i - 1) == "!" and self.at(i - 2) == "#")):
            return self.pair[i] + 1
        return 0

    def _is_object(self, i: int) -> bool:
        return self.lang in SCRIPTS and (self.at(i - 1) in ("=", "(", ",", ":", "[", "?", "return", "default", "&&", "||"))

    def _call(self, i: int, x: str) -> None:
        if self.t[i].kind != NAME or i in self.heads or x[0] == "@" or self.at(i - 1) == "~":
            return
        before, j = self.at(i - 1), i + 1
        if before == "new" and self.lang != "rust":
            while self.at(j) == "." and self.named(j + 1):
                i, j = j + 1, j + 2
            end = self.past_angles(j)
            self.uses(i, self.t[i].start, self.t[self.pair[end]].end if self.at(end) == "(" else self.t[i].end)
            self.heads.add(i)
            return
        if self.lang == "rust" and self.at(j) == "!" and self.at(j + 1) in ("(", "[", "{"):
            j += 1
        elif x in self.words or (before == "::" and self.lang in ("rust", "cpp")):
            return
        if self.at(j) == "(" or (self.lang == "rust" and self.at(j - 1) == "!" and j > i + 1):
            self.refs.append((x, "calls", self.t[i].start, self.t[self.pair[j]].end))

    # Languages

    def _rust(self, i: int, x: str, first: int, where: str, assigned: bool) -> None:
        if self.at(i - 1) in (".", "::"):
            return
        if x == "fn" and self.named(i + 1):
            self.define("function", i + 1, first, "block")
        elif x in ("struct", "enum", "type") and self.named(i + 1) or (x == "union" and self.named(i + 1) and self.at(i + 2) in ("{", "<")):
            self.define("class", i + 1, first, "fields", block=x != "type")
        elif x == "trait" and self.named(i + 1):
            self.define("interface", i + 1, first, "type")
        elif x == "mod" and self.named(i + 1):
            self.define("module", i + 1, first, "file")
            self.imports.append((self.at(i + 1), self.t[i + 1].start))
        elif x == "macro_rules" and self.at(i + 1) == "!":
            self.define("macro", i + 2, first, "macro")
        elif x in ("const", "static"):
            j = i + 1 + (self.at(i + 1) == "mut")
            if self.named(j) and self.at(j + 1) == ":":
                self.define("constant", j, first, "block", block=False)
        elif x == "use" and not assigned:
            end = i + 1
            while end < len(self.t) and self.at(end) != ";":
                end += 1
            if end > i + 1:
                self.imports.append((self.text[self.t[i + 1].start : self.t[end - 1].end], self.t[i + 1].start))
        elif x == "impl" and where in ("file", "block") and first <= i and self.at(i - 1) not in ("->", ":", "(", "<", "&", ","):
            self._impl(i, first)

    def _impl(self, i: int, first: int) -> None:
        """impl<…> Trait<…> for Type<…> where …: the type's name, and the trait as what it uses."""
        j, name, trait = self.past_angles(i + 1), -1, -1
        while j < len(self.t) and self.at(j) not in ("{", ";", "where"):
            if self.at(j) == "for" and self.at(j + 1) != "<":
                trait, name = name, -1
            elif self.at(j) == "<":
                past = self.past_angles(j)
                j = past if past > j else j + 1
                continue
            elif self.named(j) and self.at(j) not in ("dyn", "mut", "const", "unsafe"):
                name = j
            j = self.pair[j] + 1 if self.at(j) in ("(", "[") else j + 1
        if name >= 0:
            self.define("class", name, first, "type", frm=j)
            if trait >= 0:
                self.uses(trait, *self.defs[-1][2:])

    def _go(self, i: int, x: str, first: int, where: str, assigned: bool) -> None:
        if where not in ("file", "block", "group"):
            return
        if x == "func" and where == "file" and self.named(i + 1):
            self.define("function", i + 1, first, "block")
        elif x == "func" and where == "file" and self.at(i + 1) == "(":
            j = self.pair[i + 1] + 1
            if self.named(j) and self.at(j + 1) == "(":
                self.define("method", j, first, "block")
        elif x in ("type", "const", "import") and self.t[i].line:
            rows = [i + 1]
            if self.at(i + 1) == "(":
                end = self.pair[i + 1]
                rows, j = [], i + 2
                while j < end:  # a row's first token, brackets passed over
                    if self.t[j].line or j == i + 2:
                        rows.append(j)
                    j = self.pair[j] + 1
            for j in rows:
                if x == "import":
                    j += self.t[j].kind != STRING if j < len(self.t) else 0
                    if j < len(self.t) and self.t[j].kind == STRING:
                        self.imports.append((self.t[j].value[1:-1], self.t[j].start))
                elif self.named(j):
                    self.define("type" if x == "type" else "constant", j, j, "fields", block=False, lines=True)
                    brace = next((k for k in range(j, len(self.t)) if self.at(k) == "{" or self.t[k].start >= self.defs[-1][3]), -1)
                    if x == "type" and self.at(brace) == "{":
                        self.holds[brace] = "fields"

    def _member(self, i: int, x: str, first: int, where: str, assigned: bool) -> bool:
        """Whether a name in a type's body is a method: behind a type, before arguments and a body or its absence."""
        before = self.at(i - 1)
        j = self.past_angles(i + 1)
        if where != "type" or assigned or self.at(j) != "(" or x in self.words:
            return False
        if self.at(self.pair[j] + 1) in ("{", "throws", ":") and (i == first or self.at(i - 1) == ")" or self.at(i - 1) in ("public", "private", "protected", "internal", "static")):
            self.heads.add(i)  # a constructor
            return False
        if i == first or not (self.named(i - 1) or before in (">", "]", "?", "*", "&")) or before in ("new", "return", "throw", "else"):
            return False
        return self.at(self.pair[j] + 1) in ("{", ";", "=>", "throws", "where", "default")

    def _typed(self, i: int, x: str, first: int, where: str, assigned: bool) -> bool:
        """A class or interface of Java or C#, with what it extends."""
        if x not in ("class", "record", "enum", "struct", "interface") or not self.named(i + 1) or self.at(i - 1) in (".", "new") or assigned or self.at(i + 1) in ("class", "struct"):
            return x in ("class", "struct") and self.at(i - 1) == "record"
        if x in ("record", "enum", "struct") and self.at(self.past_angles(i + 2)) not in ("(", "{", ":", "implements", "where", ";"):
            return False
        self.define("interface" if x == "interface" else "class", i + 1, first, "type")
        j, names = i + 2, False
        while j < len(self.t) and self.at(j) not in ("{", ";", "where"):
            names = names or self.at(j) in (":", "extends", "implements")
            if self.at(j) in ("(", "<"):
                past = self.pair[j] + 1 if self.at(j) == "(" else self.past_angles(j)
                j = max(past, j + 1)
                continue
            if names and self.named(j) and self.at(j) not in ("extends", "implements", "permits") and self.at(j + 1) != ".":
                self.uses(j, self.t[j].start, self.t[j].end)
            j += 1
        return True

    def _java(self, i: int, x: str, first: int, where: str, assigned: bool) -> None:
        if x == "import" and i == first:
            j = i + 1 + (self.at(i + 1) == "static")
            end = j
            while self.named(end) and self.at(end + 1) == "." and self.named(end + 2):
                end += 2
            self.imports.append((self.text[self.t[j].start : self.t[end].end], self.t[j].start) if j < len(self.t) else ("", 0))
        elif not self._typed(i, x, first, where, assigned) and self._member(i, x, first, where, assigned):
            self.define("method", i, first, "block")

    def _csharp(self, i: int, x: str, first: int, where: str, assigned: bool) -> None:
        if x == "using" and i == first and where in ("file", "block"):
            j = i + 1 + (self.at(i + 1) == "static")
            j += 2 if self.at(j + 1) == "=" else 0
            end = j
            while self.named(end) and self.at(end + 1) == "." and self.named(end + 2):
                end += 2
            if self.named(j) and self.at(end + 1) == ";":
                self.imports.append((self.text[self.t[j].start : self.t[end].end], self.t[j].start))
        elif x == "namespace" and self.named(i + 1):
            end = i + 1
            while self.at(end + 1) == "." and self.named(end + 2):
                end += 2
            if self.at(end + 1) == "{":
                self.define("module", i + 1, first, "file", name=self.text[self.t[i + 1].start : self.t[end].end], frm=end + 1)
        elif not self._typed(i, x, first, where, assigned) and self._member(i, x, first, where, assigned):
            self.define("method", i, first, "block")

    def _cpp(self, i: int, x: str, first: int, where: str, assigned: bool) -> None:
        if self.t[i].kind == INCLUDE:
            self.imports.append((INCLUDED.match(x)[1].strip(), self.t[i].start))
            return
        if x == "namespace" or (x == "extern" and i + 1 < len(self.t) and self.t[i + 1].kind == STRING):
            j = i + 1
            while j < len(self.t) and (self.named(j) or self.at(j) == "::" or self.t[j].kind == STRING):
                j += 1
            if self.at(j) == "{":
                self.holds[j] = "file"
        elif x in ("class", "struct", "union", "enum") and self.at(i - 1) not in ("<", ",", "enum"):
            j = i + 1 + (x == "enum" and self.at(i + 1) in ("class", "struct"))
            end, brace = self.statement_end(j, True)
            if self.named(j) and brace >= 0 and self.at(j + 1) in ("{", ":", "final", "<") and "(" not in [self.at(k) for k in range(j, brace)]:
                self.define("type" if x == "enum" else "class", j, first, "fields" if x == "enum" else "type")
        elif where in ("file", "type") and not assigned and self.at(i + 1) == "(" and x not in self.words and self.at(i - 1) not in ("~", "operator", ".", "->", ":", ","):
            close = self.pair[i + 1]
            j = close + 1
            if (i + 2 < len(self.t) and self.t[i + 2].kind in (STRING, "number")) or (i == first and where == "file"):
                return
            while self.at(j) in ("const", "noexcept", "override", "final", "&", "volatile"):
                j += 1
            if self.at(j) in ("{", ";", "->", ":", "=", "try"):
                if self.at(j) == ":":  # members' first values: name(…) or name{…}
                    while j < len(self.t) and self.at(j) != ";" and not (self.at(j) == "{" and not self.named(j - 1)):
                        self.heads |= {j} if self.named(j) else set()
                        j = self.pair[j] + 1 if self.at(j) in ("(", "[", "{") else j + 1
                self.define("method" if self.at(i - 1) == "::" else "function", i, first, "block", frm=j)

    def _arrow(self, j: int) -> int:
        """Index where the body of a function that is a value at j begins; -1: no function."""
        j += self.at(j) == "async" and self.at(j + 1) != "=>"
        if self.at(j) == "function":
            return j
        j = self.past_angles(j)
        if self.named(j) and self.at(j + 1) == "=>":
            return j + 2
        if self.at(j) == "(":
            k = self.pair[j] + 1
            if self.at(k) == ":":
                while k < len(self.t) and self.at(k) not in ("=>", ";", ",", "="):
                    past = self.past_angles(k)
                    k = past if past > k else self.pair[k] + 1 if self.at(k) in ("(", "[", "{") else k + 1
            return k + 1 if self.at(k) == "=>" else -1
        return -1

    def _script(self, i: int, x: str, first: int, where: str, assigned: bool) -> None:
        if self.at(i - 1) in (".", "?."):
            # a.b = function …
            if self.at(i + 1) == "=" and not assigned and where != "arguments" and self._arrow(i + 2) >= 0:
                self.define("function", i, first, "block", block=False, lines=True)
            return
        if x in ("class", "interface") and self.named(i + 1) and self.at(i + 1) not in ("extends", "implements"):
            start = i - (self.at(i - 1) == "abstract")
            self.define("class" if x == "class" else "interface", i + 1, start, "type" if x == "class" else "signatures")
            self._heritage(i + 2)
        elif x in ("namespace", "module") and self.named(i + 1) and self.at(i + 2) in ("{", ".") and i == first:
            self.define("module", i + 1, i, "file")
        elif x == "function":
            j = i + 1 + (self.at(i + 1) == "*")
            if self.named(j) and self.at(self.past_angles(j + 1)) == "(":
                close = self.pair[self.past_angles(j + 1)]
                self.define("function", j, i - (self.at(i - 1) == "async"), "block", lines=True, frm=close + 1)
        elif x in ("const", "let", "var") and self.named(i + 1):
            j = i + 2
            if self.at(j) == ":":
                while j < len(self.t) and self.at(j) not in ("=", ";", "of", "in"):
                    j = self.pair[j] + 1 if self.at(j) in ("(", "[", "{") else j + 1
            if self.at(j) == "=" and self._arrow(j + 1) >= 0:
                self.define("function", i + 1, i, "block", block=False, lines=True)
        elif where in ("type", "object", "signatures") and not assigned and x not in ("get", "set", "async", "static", "public", "private", "protected", "readonly", "override", "abstract"):
            self._property(i, x, first, where)
        elif x == "import" or (x == "from" and self._quoted(i + 1)):
            k = i + 1 + (x == "import" and self.at(i + 1) == "(")
            if self._quoted(k) and (self.at(i + 1) != "(" or self.at(k + 1) in (")", ",")):
                self.imports.append((self.t[k].value[1:-1], self.t[k].start))
        elif x == "require" and self.at(i + 1) == "(" and self._quoted(i + 2):
            self.imports.append((self.t[i + 2].value[1:-1], self.t[i + 2].start))

    def _quoted(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == STRING and len(self.t[i].value) > 2

    def _heritage(self, j: int) -> None:
        names = False
        while j < len(self.t) and self.at(j) not in ("{", ";"):
            names = names or self.at(j) in ("extends", "implements")
            past = self.past_angles(j)
            if past > j:
                j = past
                continue
            if names and self.named(j) and self.at(j) not in ("extends", "implements") and self.at(j + 1) not in (".", "("):
                self.uses(j, self.t[j].start, self.t[j].end)
            j += 1

    def _property(self, i: int, x: str, first: int, where: str) -> None:
        """A method, a method's signature or a property that is a function."""
        j = i + 1 + (self.at(i + 1) in ("?", "!"))
        j = self.past_angles(j)
        if self.at(j) == "(":
            end, brace = self.statement_end(self.pair[j] + 1, True, lines=True)
            after = self.at(self.pair[j] + 1)
            signature = brace < 0 and where in ("type", "signatures") and self.lang != "javascript" and after in (":", ";", "}", "")
            if x == "constructor" or x in self.words:
                if brace >= 0:
                    self.heads.add(i)
            elif (brace >= 0 and after in ("{", ":")) or signature or (where == "signatures" and self.t[self.pair[j] + 1].line):
                self.define("method", i, min(first, i), "block", lines=True, frm=self.pair[j] + 1)
        elif where == "type" and self.lang != "javascript":
            if self.at(j) == ":":
                while j < len(self.t) and self.at(j) not in ("=", ";", "}") and not (self.t[j].line and self.at(j - 1) not in GOES_ON):
                    j = self.pair[j] + 1 if self.at(j) in ("(", "[", "{") else j + 1
            if self.at(j) == "=" and self._arrow(j + 1) >= 0:
                self.define("method", i, min(first, i), "block", block=False, lines=True)
        elif where == "object" and self.at(j) == ":" and self._arrow(j + 1) >= 0:
            end = j + 1
            while end < len(self.t) and self.at(end) != "," and self.at(end) not in CLOSES:
                end = self.pair[end] + 1 if self.at(end) in ("(", "[", "{") else end + 1
            self.heads.add(i)
            self.defs.append(("function", x, self.t[i].start, self.t[end - 1].end))
