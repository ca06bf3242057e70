"""Tokens of brace languages with matched brackets, and walks over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Syntax:
    """What tells the tokens of a language apart."""

    #: Quotes of strings that end on their line, of raw strings that may not, and of templates with ${...} inside.
    quotes: str = "\"'"
    raw: tuple[str, ...] = ()
    templates: bool = False
    regexes: bool = False
    #: Whether a line end can end a statement.
    line_ends: bool = False


@dataclass
class Token:
    kind: str  # word, string, number, op, comment
    text: str
    start: int
    end: int
    line_before: bool = False  # a line end lies between the last token and this one


_WORD = re.compile(r"[#]?[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"\d(?:[\w.]|(?<=[eE])[+-])*")
_OPS = re.compile(r"\.\.\.|=>|->|<-|\?\.|:=|::|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|[^\s]")
#: After these a slash starts a regular expression rather than a division.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "do", "else", "throw", "new", "await", "yield"}
PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}"}


@dataclass
class Tokens:
    """A text's tokens without comments, the comment directly before each, and where brackets end or begin."""

    text: str
    syntax: Syntax
    all: list[Token] = field(default_factory=list)
    comment: dict[int, Token] = field(default_factory=dict)
    match: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._scan(0, len(self.text), None)
        open_: list[int] = []
        for i, t in enumerate(self.all):
            if t.kind != "op":
                continue
            if t.text in PAIRS:
                open_.append(i)
            elif t.text in ")]}":
                # a bracket that nothing fits is passed over, as a reader who recovers from an error would
                fits = next((k for k in range(len(open_) - 1, -1, -1) if PAIRS[self.all[open_[k]].text] == t.text), None)
                if fits is not None:
                    self.match[open_[fits]], self.match[i] = i, open_[fits]
                    del open_[fits:]

    def _scan(self, at: int, end: int, inside: str | None) -> int:
        """Read tokens from ``at``; inside a template's ${ up to its closing brace."""
        text, syntax, depth, held, fresh = self.text, self.syntax, 0, None, False
        while at < end:
            c = text[at]
            if c.isspace():
                fresh |= c == "\n"
                at += 1
                continue
            if text.startswith("//", at):
                stop = text.find("\n", at)
                held = Token("comment", text[at : end if stop < 0 else stop], at, end if stop < 0 else stop)
                at = held.end
                continue
            if text.startswith("/*", at):
                stop = text.find("*/", at + 2)
                held = Token("comment", text[at : end if stop < 0 else stop + 2], at, end if stop < 0 else stop + 2)
                fresh |= "\n" in held.text
                at = held.end
                continue
            token, stop = self._next(at)
            if inside and token.kind == "op":
                depth += (token.text == "{") - (token.text == "}")
                if depth < 0:
                    self._add(Token("op", "}", at, at + 1, fresh), held)
                    return at + 1
            token.line_before = fresh
            self._add(token, held)
            held, fresh = None, False
            at = stop
            if token.kind == "string" and token.text.endswith("${"):
                at = self._template(at)
        return at

    def _add(self, token: Token, held: Token | None) -> None:
        if held:
            self.comment[len(self.all)] = held
        self.all.append(token)

    def _template(self, at: int) -> int:
        """The rest of a template whose first piece ended in ${."""
        text = self.text
        while True:
            self.all.append(Token("op", "${", at - 2, at))
            at = self._scan(at, len(text), "}")
            m = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*(`|\$\{|$)", re.S).match(text, at)
            self.all.append(Token("string", text[at : m.end()], at, m.end()))
            at = m.end()
            if m[1] != "${":
                return at

    def _next(self, at: int) -> tuple[Token, int]:
        text, syntax = self.text, self.syntax
        for quote in syntax.raw:
            if text.startswith(quote, at):
                stop = text.find(quote, at + len(quote))
                stop = len(text) if stop < 0 else stop + len(quote)
                return Token("string", text[at:stop], at, stop), stop
        c = text[at]
        if c == "`" and syntax.templates:
            m = re.compile(r"`(?:\\.|\$(?!\{)|[^\\`$])*(?:`|\$\{|$)", re.S).match(text, at)
            return Token("string", m[0], at, m.end()), m.end()
        if c in syntax.quotes:
            m = re.compile(rf"{c}(?:\\.|[^{c}\\\n])*{c}?", re.S).match(text, at)
            return Token("string", m[0], at, m.end()), m.end()
        if c == "/" and syntax.regexes and self._regex_may_start():
            m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*").match(text, at)
            if m:
                return Token("string", m[0], at, m.end()), m.end()
        for kind, pattern in (("word", _WORD), ("number", _NUMBER), ("op", _OPS)):
            if m := pattern.match(text, at):
                return Token(kind, m[0], at, m.end()), m.end()
        return Token("op", c, at, at + 1), at + 1

    def _regex_may_start(self) -> bool:
        if not self.all:
            return True
        last = self.all[-1]
        return last.text in _BEFORE_REGEX if last.kind == "word" else last.kind == "op" and last.text not in ")]}"

    # walks; positions outside have no text

    def at(self, i: int) -> str:
        return self.all[i].text if 0 <= i < len(self.all) else ""

    def kind(self, i: int) -> str:
        return self.all[i].kind if 0 <= i < len(self.all) else ""

    def is_word(self, i: int, *words: str) -> bool:
        return self.kind(i) == "word" and (not words or self.at(i) in words)

    def close(self, i: int) -> int:
        """The bracket that closes the one at i; the last token where none does."""
        return self.match.get(i, len(self.all) - 1)

    def open(self, i: int) -> int:
        return self.match.get(i, i)

    def source(self, i: int, j: int) -> str:
        """The text from token i to token j, both included."""
        return self.text[self.all[i].start : self.all[j].end] if 0 <= i <= j < len(self.all) else ""

    def doc(self, i: int) -> str | None:
        """What the comment directly before a token says."""
        held = self.comment.get(i)
        return (held.text.lstrip("/#- ").strip() or None) if held else None

    def angle(self, i: int) -> int | None:
        """The > that closes the type arguments which open at i, None where there are none."""
        depth = 0
        for j in range(i, min(i + 200, len(self.all))):
            t = self.at(j)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j
            elif t in ("(", "[", "{"):
                if t == "{" and not (self.syntax.templates and depth):
                    return None
            elif t in (";", "&&", "||", "==", "+") or self.kind(j) == "string" and not self.syntax.templates:
                return None
        return None

    def angle_back(self, i: int) -> int | None:
        """The < that opens the type arguments which close at i."""
        depth = 0
        for j in range(i, max(i - 200, -1), -1):
            t = self.at(j)
            depth += (t == ">") - (t == "<")
            if not depth:
                return j
            if t in (";", "{", "}"):
                return None
        return None

    def primary(self, i: int, dots: tuple[str, ...] = (".",)) -> int:
        """The first token of the member expression whose last name is at i: names, calls and subscripts joined by dots."""
        while self.at(i - 1) in dots:
            j = i - 2
            if self.at(j) == "!":
                j -= 1
            while self.at(j) in (")", "]") and j in self.match:
                j = self.open(j) - 1
                if self.at(j) in dots:  # ?.( or ?.[
                    j -= 1
            if self.kind(j) in ("word", "string", "number"):
                if self.kind(j) == "string" and self.at(j).endswith("`") and not self.at(j).startswith("`"):
                    return j
                i = j
                continue
            return j + 1 if j + 1 < i - 1 else i
        return i
