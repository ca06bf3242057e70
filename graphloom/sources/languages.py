"""Definitions and references of Java, Scala, Go, JavaScript and TypeScript, read off their tokens; Bash by commands.

Each reader goes through the tokens once, level by level of brackets, and knows
three places: a type's body, where members stand, a block of code, and a header.
"""

from __future__ import annotations

import re

from graphloom.sources.lexer import Syntax, Tokens

Def = tuple[str, str, int, int, str, str | None]
Ref = tuple[str, int, str, list[str]]

_PREFIX = re.compile(r"^[a-zA-Z]{0,3}(?=['\"`])")


def literal(text: str) -> str:
    """A string's contents, without a prefix of up to three letters and its quotes."""
    body = text.strip()[len(_PREFIX.match(text.strip())[0]) if _PREFIX.match(text.strip()) else 0 :]
    for quote in ('"""', "'''", '"', "'", "`"):
        if body.startswith(quote) and body.endswith(quote) and len(body) >= 2 * len(quote):
            return body[len(quote) : -len(quote)].strip()
    return text.strip()


class Reader:
    """What the readers share: collecting, and calls by the names before parentheses."""

    syntax = Syntax()
    dots: tuple[str, ...] = (".",)
    no_call: frozenset[str] = frozenset()

    def __init__(self, text: str) -> None:
        self.t = Tokens(text, self.syntax)
        self.defs: list[Def] = []
        self.refs: list[Ref] = []

    def read(self) -> tuple[list[Def], list[Ref]]:
        self.code(0, len(self.t.all))
        return self.defs, self.refs

    def define(self, kind: str, name: int, first: int, last: int, params: str = "") -> None:
        t = self.t
        if 0 <= first <= last < len(t.all):
            self.defs.append((kind, t.at(name), t.all[first].start, t.all[last].end, t.at(name) + params, t.doc(first)))

    def refer(self, kind: str, i: int, target: str) -> None:
        if target:
            self.refs.append((kind, self.t.all[i].start, target, []))

    def code(self, i: int, end: int) -> None:
        raise NotImplementedError


# --- Java ---


class Java(Reader):
    syntax = Syntax(raw=('"""',))
    types = ("class", "interface", "enum", "record")
    no_call = frozenset("if for while switch catch return new super this do else try throw case synchronized assert yield instanceof".split())

    def read(self) -> tuple[list[Def], list[Ref]]:
        self.members(0, len(self.t.all), top=True)
        return self.defs, self.refs

    def annotation(self, i: int) -> int:
        """The first token after an annotation at i; its arguments are code."""
        t = self.t
        i += 2
        while t.at(i) == "." and t.is_word(i + 1):
            i += 2
        if t.at(i) == "(":
            self.code(i + 1, t.close(i))
            i = t.close(i) + 1
        return i

    def members(self, i: int, end: int, top: bool = False) -> None:
        """Fields, methods and types, one after another."""
        t = self.t
        while i < end:
            first = i
            while i < end and t.at(i) == "@" and t.at(i + 1) != "interface":
                i = self.annotation(i)
            if top and t.is_word(i, "package", "import"):
                stop = next((k for k in range(i, end) if t.at(k) == ";"), end)
                if t.at(i) == "import":
                    j = i + 1 + t.is_word(i + 1, "static")
                    name = t.source(j, stop - 1).removesuffix(".*").removesuffix(". *") if stop > j else ""
                    if "." in name:
                        self.refer("IMPORTS", i, re.sub(r"\s", "", name))
                i = stop + 1
                continue
            j = i
            while j < end:
                word = t.at(j)
                if word == "@" and t.at(j + 1) != "interface":
                    j = self.annotation(j)
                    continue
                if (t.is_word(j, *self.types) and t.is_word(j + 1) and (word != "record" or t.at(j + 2) in ("(", "<"))) or (word == "@" and t.at(j + 1) == "interface"):
                    j = self.type(first, j, end)
                    break
                if word == "<":
                    j = (t.angle(j) or j) + 1
                    continue
                if word == "(" and t.is_word(j - 1):
                    j = self.method(first, j, end)
                    break
                if word == "=":
                    stop = self.statement(j + 1, end)
                    self.code(j + 1, stop)
                    j = stop + 1
                    break
                if word == "{":  # an initialiser, or the body of a compact constructor
                    self.code(j + 1, t.close(j))
                    j = t.close(j) + 1
                    break
                j += 1
                if word == ";":
                    break
            i = max(j, first + 1)

    def statement(self, i: int, end: int) -> int:
        """The semicolon that ends what starts at i."""
        t = self.t
        while i < end and t.at(i) != ";":
            i = t.close(i) + 1 if t.at(i) in ("(", "[", "{") and i in t.match else i + 1
        return i

    def method(self, first: int, paren: int, end: int) -> int:
        t = self.t
        i = t.close(paren) + 1
        while i < end and t.at(i) not in ("{", ";", "}"):
            i += 1
        last = t.close(i) if t.at(i) == "{" else i
        if last >= len(t.all):
            last = len(t.all) - 1
        self.define("method", paren - 1, first, last, t.source(paren, t.close(paren)))
        if t.at(i) == "{":
            self.code(i + 1, t.close(i))
        return last + 1

    def type(self, first: int, keyword: int, end: int) -> int:
        """A type declaration whose modifiers start at ``first``; the first token after it."""
        t = self.t
        word = t.at(keyword)
        name = keyword + 1 if word != "@" else keyword + 2
        i = name + 1
        parts: list[tuple[str, int, int]] = []  # extends or implements, and the types that follow
        if t.at(i) == "(":
            i = t.close(i) + 1
        while i < end and t.at(i) not in ("{", ";"):
            if t.at(i) == "<":
                i = (t.angle(i) or i) + 1
            elif t.is_word(i, "extends", "implements", "permits"):
                stop = i + 1
                while stop < end and t.at(stop) not in ("{", ";") and not t.is_word(stop, "extends", "implements", "permits"):
                    stop = (t.angle(stop) or stop) + 1 if t.at(stop) == "<" else stop + 1
                parts.append((t.at(i), i + 1, stop))
                i = stop
            else:
                i += 1
        last = t.close(i) if t.at(i) == "{" else min(i, len(t.all) - 1)
        if word in ("class", "interface", "enum"):
            self.define("class", name, first, last)
        for how, a, b in parts:
            if how != "permits" and (word in ("class", "interface")):
                # a plain name between commas; a type with arguments or a qualifier isn't one
                for k in range(a, b):
                    if t.is_word(k) and t.at(k - 1) in ("extends", "implements", ",") and (k + 1 == b or t.at(k + 1) == ","):
                        self.refer("INHERITS", k, t.at(k))
        if t.at(i) == "{":
            start = i + 1
            if word == "enum":  # constants come first: arguments are code, bodies have members
                while start < last and t.at(start) != ";":
                    if t.at(start) == "(":
                        self.code(start + 1, t.close(start))
                        start = t.close(start)
                    elif t.at(start) == "{":
                        self.members(start + 1, t.close(start))
                        start = t.close(start)
                    start += 1
                start += 1
            self.members(start, last)
        return last + 1

    def code(self, i: int, end: int) -> None:
        t = self.t
        while i < end:
            if t.at(i) == "@" and t.is_word(i + 1):
                i = self.annotation(i)
                continue
            if t.is_word(i, *self.types) and t.is_word(i + 1) and t.at(i - 1) not in (".", "::") and (t.at(i) != "record" or t.at(i + 2) in ("(", "<")):
                first = i
                while t.is_word(first - 1, "final", "abstract", "static", "strictfp", "sealed"):
                    first -= 1
                i = self.type(first, i, end)
                continue
            if t.is_word(i, "new") and t.is_word(i + 1):
                k = i + 1
                while t.at(k + 1) == "." and t.is_word(k + 2):
                    k += 2
                after = k + 1
                plain = k == i + 1
                if t.at(after) == "<":
                    plain, after = False, (t.angle(after) or after) + 1
                if t.at(after) == "(":
                    if plain:
                        self.refer("CALLS", k, t.at(k))
                    body = t.close(after) + 1
                    self.code(after + 1, t.close(after))
                    if t.at(body) == "{":
                        self.members(body + 1, t.close(body))
                        body = t.close(body) + 1
                    i = body
                    continue
                i = after
                continue
            if t.is_word(i) and t.at(i + 1) == "(" and t.at(i) not in self.no_call:
                self.refer("CALLS", i, t.at(i))
            i += 1


# --- JavaScript and TypeScript ---


class Script(Reader):
    syntax = Syntax(templates=True, regexes=True, line_ends=True)
    dots = (".", "?.")
    typed = False
    no_call = frozenset("if for while switch catch return function new typeof super do else await yield throw case import with void delete in of instanceof".split())
    modifiers = ("public", "private", "protected", "static", "async", "get", "set", "override", "readonly", "declare", "accessor")

    def params_end(self, paren: int) -> int:
        """The last token of a parameter list and, in typed code, of the result's type."""
        t, i = self.t, self.t.close(paren)
        if self.typed and t.at(i + 1) == ":":
            k = i + 2
            while k < len(t.all):
                if t.at(k) == "<":
                    k = (t.angle(k) or k) + 1
                elif t.at(k) in ("(", "["):
                    k = t.close(k) + 1
                elif t.at(k) == "{":
                    # a type in braces is followed by something that goes on with the header
                    after = t.close(k) + 1
                    if t.at(k - 1) in (":", "|", "&", "is", "=>") and t.at(after) in ("{", "=>", ";", "|", "&", "["):
                        k = after
                    else:
                        break
                elif t.at(k) in ("=>", ";", "=", ",", ")", "}"):
                    if t.at(k) == "=>" and t.at(k - 1) == ")" and t.at(t.open(k - 1) - 1) in (":", "|", "&"):
                        k += 1  # the type of a function
                        continue
                    break
                elif t.all[k].line_before and t.at(k - 1) not in (":", "|", "&", ".") and t.at(k) not in ("|", "&", "."):
                    break
                else:
                    k += 1
            return k - 1
        return i

    def function(self, first: int, i: int, name: int | None, kind: str, declared: bool) -> int:
        """A function whose parameters (or type parameters) start at i; the first token after it. ``name`` None: it isn't listed."""
        t = self.t
        if t.at(i) == "<":
            i = (t.angle(i) or i) + 1
        if t.at(i) != "(":
            return i
        close, body = t.close(i), self.params_end(i) + 1
        self.code(i + 1, close)
        if t.at(body) != "{":
            return body  # an overload or an abstract method
        if name is not None:
            self.define(kind, name, first, t.close(body), t.source(i, close))
        self.code(body + 1, t.close(body))
        return t.close(body) + 1

    def expression_end(self, i: int, end: int) -> int:
        """The last token of an arrow function's expression that starts at i."""
        t, k = self.t, i
        while k < end:
            if t.at(k) in PAIRS_OPEN and k in t.match:
                k = t.close(k) + 1
                continue
            if t.at(k) in (",", ";", ")", "]", "}"):
                break
            if k > i and t.all[k].line_before and t.kind(k) in ("word", "number", "string") and (t.kind(k - 1) != "op" or t.at(k - 1) in (")", "]", "}")) and not t.is_word(k, "in", "of", "instanceof", "as"):
                break
            k += 1
        return k - 1

    def declarator(self, name: int, end: int) -> None:
        """A variable whose value is an arrow function with a parameter list, or a function expression."""
        t, i = self.t, name + 1
        if self.typed and t.at(i) == ":":
            while i < end and t.at(i) not in ("=", ";", ","):
                i = (t.angle(i) or i) + 1 if t.at(i) == "<" else t.close(i) + 1 if t.at(i) in PAIRS_OPEN else i + 1
        if t.at(i) != "=":
            return
        i += 1
        if t.is_word(i, "async"):
            i += 1
        if t.is_word(i, "function"):
            if t.at(i + 1) != "*":
                i += 1 + t.is_word(i + 1)
                if t.at(i) == "<":
                    i = (t.angle(i) or i) + 1
                body = self.params_end(i) + 1 if t.at(i) == "(" else -1
                if t.at(body) == "{":
                    self.define("function", name, name, t.close(body), t.source(i, t.close(i)))
            return
        if t.at(i) == "<":
            i = (t.angle(i) or i) + 1
        if t.at(i) == "(":
            arrow = self.params_end(i) + 1
            if t.at(arrow) == "=>":
                last = t.close(arrow + 1) if t.at(arrow + 1) == "{" else self.expression_end(arrow + 1, len(t.all))
                self.define("function", name, name, last, t.source(i, t.close(i)))

    def class_(self, first: int, keyword: int, listed: bool) -> int:
        t = self.t
        i = keyword + 1
        name = i if t.is_word(i) and t.at(i) not in ("extends", "implements") else None
        i += name is not None
        if t.at(i) == "<":
            i = (t.angle(i) or i) + 1
        heritage = None
        if t.is_word(i, "extends"):
            heritage = i + 1
        while i < len(t.all) and t.at(i) != "{":
            if t.at(i) == "(":
                self.code(i + 1, t.close(i))
            i = (t.angle(i) or i) + 1 if t.at(i) == "<" else t.close(i) + 1 if t.at(i) in ("(", "[") else i + 1
        last = t.close(i)
        if listed and name is not None:
            self.define("class", name, first, last)
            if heritage and t.is_word(heritage) and t.at(heritage + 1) in ("{", "implements", *(("<",) if self.typed else ())):
                self.refer("INHERITS", heritage, t.at(heritage))
        self.members(i + 1, last, True)
        return last + 1

    def member(self, i: int, end: int) -> tuple[int, int | None]:
        """(name, parameters) where a method starts at i; parameters None where it is something else."""
        t, j = self.t, i
        while j < end and t.is_word(j, *self.modifiers) and (t.is_word(j + 1) or t.at(j + 1) in ("*", "[") or t.kind(j + 1) == "string"):
            j += 1
        if t.at(j) == "*":
            j += 1
        name = j
        if t.at(j) == "[":
            j = t.close(j)
        j += 1
        if t.at(j) == "?":
            j += 1
        if t.at(j) == "<":
            j = (t.angle(j) or j) + 1
        return name, j if t.at(j) == "(" and t.kind(name) in ("word", "string", "number") or t.at(name) == "[" and t.at(j) == "(" else None

    def members(self, i: int, end: int, of_class: bool) -> None:
        """A class's members up to ``end``; fields are code."""
        t = self.t
        while i < end:
            first = i
            while t.at(i) == "@" and i < end:  # decorators
                k = i + 2
                while t.at(k) == "." and t.is_word(k + 1):
                    k += 2
                stop = t.close(k) + 1 if t.at(k) == "(" else k
                self.code(i + 1, stop)
                i = stop
            if t.at(i) in (";", ","):
                i += 1
                continue
            if t.is_word(i, "static") and t.at(i + 1) == "{":
                self.code(i + 2, t.close(i + 1))
                i = t.close(i + 1) + 1
                continue
            if t.is_word(i, "abstract"):
                i += 1
                abstract = True
            else:
                abstract = False
            name, paren = self.member(i, end)
            if paren is not None:
                listed = t.is_word(name) and not t.at(name).startswith("#") and not abstract
                i = max(self.function(i if first != i and not listed else first, paren, name if listed else None, "method", True), i + 1)
                continue
            stop = i
            while stop < end and t.at(stop) != ";" and not (stop > i and t.all[stop].line_before and self.member(stop, end)[1] is not None and t.at(stop - 1) not in ("=", "=>", "+", "(", ",", "&&", "||", "?", ":")):
                stop = t.close(stop) + 1 if t.at(stop) in PAIRS_OPEN and stop in t.match else stop + 1
                if stop < end and t.all[stop].line_before and t.is_word(stop, *self.modifiers) and t.at(stop - 1) != "=":
                    break
            self.code(i, stop)
            i = max(stop, i + 1)

    def object(self, i: int, end: int) -> None:
        """An object's entries: methods in short form are listed, the rest is code."""
        t = self.t
        while i < end:
            name, paren = self.member(i, end)
            if paren is not None and t.at(self.params_end(paren) + 1) == "{":
                listed = t.is_word(name)
                i = self.function(i, paren, name if listed else None, "method", True)
                continue
            stop = i
            while stop < end and t.at(stop) != ",":
                stop = t.close(stop) + 1 if t.at(stop) in PAIRS_OPEN and stop in t.match else stop + 1
            self.code(i, stop)
            i = stop + 1

    def is_object(self, i: int) -> bool:
        """Whether the brace at i opens an object rather than a block."""
        before = self.t.at(i - 1)
        return before in ("(", "=", ",", "[", "?", ":", "&&", "||", "...", "${") or self.t.is_word(i - 1, "return", "yield", "default", "in", "of")

    def code(self, i: int, end: int) -> None:
        t = self.t
        while i < end:
            if t.kind(i) != "word":
                if t.at(i) == "{" and self.is_object(i) and i in t.match and t.close(i) < end:
                    self.object(i + 1, t.close(i))
                    i = t.close(i) + 1
                    continue
                i += 1
                continue
            dotted = t.at(i - 1) in self.dots
            word = t.at(i)
            if not dotted and word == "import" and t.at(i + 1) not in ("(", "."):
                stop = i + 1
                while stop < end and t.kind(stop) != "string" and t.at(stop) != ";":
                    stop += 1
                if t.kind(stop) == "string":
                    self.refer("IMPORTS", i, literal(t.at(stop)))
                i = stop + 1
                continue
            if not dotted and word == "class" and (t.is_word(i + 1) or t.at(i + 1) == "{"):
                before = t.at(i - 1)
                declared = i == 0 or before in (";", "{", "}", ")", "abstract", "export", "default") or t.all[i].line_before and before not in ("=", "(", ",", "return", ":")
                i = self.class_(i, i, declared and before != "abstract")
                continue
            if self.typed and not dotted and word == "interface" and t.is_word(i + 1) and t.at(i + 2) in ("{", "<", "extends"):
                k = i + 2
                while k < end and t.at(k) != "{":
                    k = (t.angle(k) or k) + 1 if t.at(k) == "<" else k + 1
                self.define("class", i + 1, i, t.close(k))
                i = t.close(k) + 1
                continue
            if self.typed and not dotted and word == "type" and t.is_word(i + 1) and t.at(i + 2) in ("=", "<"):
                i += 2
                while i < end and t.at(i) != ";" and not (t.all[i].line_before and t.kind(i) == "word" and t.at(i - 1) not in ("=", "|", "&")):
                    i = t.close(i) + 1 if t.at(i) in PAIRS_OPEN else i + 1
                continue
            if not dotted and word == "function":
                first = i - 1 if t.is_word(i - 1, "async") else i
                star = t.at(i + 1) == "*"
                name = i + 1 + star
                before = t.at(first - 1)
                statement = first == 0 or before in (";", "{", "}", ")", "export", "default") or t.all[first].line_before and before not in ("=", "(", ",", "return", ":", "=>")
                listed = statement and t.is_word(name) and not star
                i = max(self.function(first, name + t.is_word(name), name if listed else None, "function", True), i + 1)
                continue
            if not dotted and word in ("const", "let", "var") and t.is_word(i + 1):
                k = i + 1
                while k < end:  # several variables of one statement
                    if t.is_word(k) and t.at(k - 1) in (word, ","):
                        self.declarator(k, end)
                    if t.at(k) in (";", "}", ")") or t.is_word(k, "of", "in") or k > i + 1 and t.all[k].line_before and t.at(k - 1) not in (",", "=", "=>", "+", "?", ":", "&&", "||") and t.kind(k) == "word":
                        break
                    k = t.close(k) + 1 if t.at(k) in PAIRS_OPEN and k in t.match else k + 1
                i += 2
                continue
            if not dotted and word == "new" and t.is_word(i + 1):
                i += 2
                while t.at(i) in self.dots and t.is_word(i + 1):
                    i += 2
                if t.at(i) == "<" and self.typed:
                    i = (t.angle(i) or i) + 1
                if t.at(i) == "(":  # the arguments go on as code
                    self.code(i + 1, t.close(i))
                    i = t.close(i) + 1
                continue
            after = i + 1
            if self.typed and t.at(after) == "<" and (a := t.angle(after)) and t.at(a + 1) == "(":
                after = a + 1
            if t.at(after) == "?." and t.at(after + 1) == "(":
                after += 1
            template = t.kind(after) == "string" and t.at(after).startswith("`")
            arrow = word == "async" and t.at(after) == "(" and t.at(t.close(after) + 1) in ("=>", ":")
            if (t.at(after) == "(" or template) and not arrow and (dotted or word not in self.no_call) and not (word.startswith("#") and not dotted):
                start = t.primary(i, self.dots) if dotted else i
                self.refer("CALLS", start, t.source(start, i))
                if word == "require" and not dotted and t.at(after) == "(":
                    for k in range(after + 1, t.close(after)):
                        if t.kind(k) == "string" and t.at(k - 1) in ("(", ","):
                            self.refer("IMPORTS", i, literal(t.at(k)))
            i += 1


PAIRS_OPEN = ("(", "[", "{", "${")


class TypeScript(Script):
    typed = True


# --- Go ---


class Go(Reader):
    syntax = Syntax(raw=("`",), line_ends=True)
    no_call = frozenset("if for switch return func select go defer range case type struct interface map chan else var const import package".split())

    def code(self, i: int, end: int) -> None:
        t = self.t
        while i < end:
            word = t.at(i)
            if t.is_word(i, "import") and t.at(i - 1) != ".":
                grouped = t.at(i + 1) == "("
                last = t.close(i + 1) if grouped else next((k for k in range(i + 1, min(i + 4, end)) if t.kind(k) == "string"), i)
                for k in range(i + 1, last + 1):
                    if t.kind(k) == "string" and t.at(k).startswith('"'):
                        self.refer("IMPORTS", k, literal(t.at(k)))
                i = last + 1
                continue
            if t.is_word(i, "type") and t.at(i - 1) != "." and (t.is_word(i + 1) or t.at(i + 1) == "("):
                i = self.type(i, end)
                continue
            if t.is_word(i, "func"):
                i = self.function(i, end)
                continue
            if t.is_word(i) and t.at(i + 1) == "(" and word not in self.no_call:
                start = t.primary(i)
                self.refer("CALLS", start, t.source(start, i))
            i += 1

    def type(self, i: int, end: int) -> int:
        """A declaration of one type or a group; a group is one range, so its first type names it."""
        t = self.t
        spans = []
        if t.at(i + 1) == "(":
            last = k = t.close(i + 1)
            j = i + 2
            while j < k:
                spans.append(j)
                j += 1
                while j < k and not t.all[j].line_before:
                    j = t.close(j) + 1 if t.at(j) in PAIRS_OPEN and j in t.match else j + 1
        else:
            spans, last = [i + 1], i + 1
        for name in spans:
            j = name + 1
            if t.at(j) == "[" and t.is_word(j + 1) and t.at(j + 2) != "]":
                j = t.close(j) + 1  # type parameters
            if t.is_word(j, "struct", "interface") and t.at(j + 1) == "{":
                stop = t.close(j + 1)
                self.define("class", name, i, last if t.at(i + 1) == "(" else stop)
            else:
                stop = j
                while stop + 1 < end and not t.all[stop + 1].line_before:
                    stop = t.close(stop + 1) if t.at(stop + 1) in PAIRS_OPEN and stop + 1 in t.match else stop + 1
            last = max(last, stop)
        return last + 1

    def function(self, i: int, end: int) -> int:
        t = self.t
        j, kind = i + 1, "function"
        if t.at(j) == "(" and t.is_word(t.close(j) + 1) and t.at(t.close(j) + 2) in ("(", "["):
            j, kind = t.close(j) + 1, "method"
        name = j if t.is_word(j) else None
        if name is not None:
            j += 1
            if t.at(j) == "[":
                j = t.close(j) + 1
        if t.at(j) != "(":
            return i + 1
        params = t.source(j, t.close(j))
        k = t.close(j) + 1
        # the result: names, pointers, brackets; then the body, or nothing for a type or an outside function
        while k < end and not (t.all[k].line_before and t.at(k) != "{"):
            if t.at(k) == "{" and not t.is_word(k - 1, "struct", "interface"):
                break
            if t.at(k) in (",", ")", ";", "]", "}", "="):
                return k
            k = t.close(k) + 1 if t.at(k) in PAIRS_OPEN and k in t.match else k + 1
        if t.at(k) != "{":
            if name is not None:
                self.define(kind, name, i, k - 1, params)
            return k
        if name is not None:
            self.define(kind, name, i, t.close(k), params)
        self.code(k + 1, t.close(k))
        return t.close(k) + 1


# --- Scala ---


class Scala(Reader):
    syntax = Syntax(raw=('"""',), quotes='"', line_ends=True)
    no_call = frozenset("if for while match case return new this super do else try catch yield throw extends with def val var".split())
    modifiers = ("private", "protected", "override", "final", "abstract", "sealed", "implicit", "lazy", "case", "inline", "open", "transparent", "opaque")

    def first_of(self, i: int) -> int:
        """Where the modifiers and annotations before i start."""
        t = self.t
        while True:
            if t.is_word(i - 1, *self.modifiers):
                i -= 1
            elif t.at(i - 1) == "]" and t.is_word(t.open(i - 1) - 1, "private", "protected"):
                i = t.open(i - 1) - 1
            elif t.is_word(i - 1) and t.at(i - 2) == "@":
                i -= 2
            elif t.at(i - 1) == ")" and t.is_word(t.open(i - 1) - 1) and t.at(t.open(i - 1) - 2) == "@":
                i = t.open(i - 1) - 2
            else:
                return i

    def expression_end(self, i: int, end: int) -> int:
        """The last token of the expression that starts at i: of its line, or of the lines that it goes on over."""
        t, k = self.t, i
        while k < end:
            if t.at(k) in PAIRS_OPEN and k in t.match:
                k = t.close(k) + 1
                continue
            if t.at(k) in (")", "]", "}", ";", ","):
                break
            if k > i and t.all[k].line_before:
                goes_on = t.at(k) in (".", "+", "-", "*", "/", "&&", "||", "::", "|") or t.is_word(k, "else", "match", "yield", "with", "catch", "finally")
                held = t.kind(k - 1) == "op" and t.at(k - 1) not in (")", "]", "}", "_") or t.is_word(k - 1, "else", "yield", "match", "if", "new")
                if not goes_on and not held:
                    break
            k += 1
        return k - 1

    def code(self, i: int, end: int) -> None:
        t = self.t
        while i < end:
            if t.kind(i) != "word":
                i += 1
                continue
            dotted, word = t.at(i - 1) == ".", t.at(i)
            if not dotted and word == "import":
                stop = i + 1
                while stop + 1 < end and t.at(stop + 1) != ";" and not t.all[stop + 1].line_before:
                    stop = t.close(stop + 1) if t.at(stop + 1) == "{" else stop + 1
                self.refer("IMPORTS", i, t.source(i + 1, stop))
                i = stop + 1
                continue
            if not dotted and word in ("class", "object", "trait") and t.is_word(i + 1):
                i = self.type(i, end)
                continue
            if not dotted and word == "def" and (t.is_word(i + 1) or t.kind(i + 1) == "op"):
                i = self.function(i, end)
                continue
            if not dotted and word == "new":
                i += 2
                continue
            if t.at(i + 1) == "(" and not t.all[i + 1].line_before and (dotted or word not in self.no_call) and t.at(i - 1) != "@":
                start = t.primary(i) if dotted else i
                self.refer("CALLS", start, t.source(start, i))
                if dotted:
                    self.data(i, start)
            i += 1

    def data(self, i: int, start: int) -> None:
        """Reads and writes of named tables and paths."""
        t = self.t
        strings = [t.at(k) for k in range(i + 2, t.close(i + 1)) if t.kind(k) == "string" and t.at(k - 1) in ("(", ",") and t.at(k + 1) in (")", ",")]
        owner = t.at(i - 2) if t.is_word(i - 2) and t.at(i - 3) == "." else ""
        for text in strings:
            for kind, fits in (("PRODUCES", t.is_word(i, "saveAsTable", "insertInto")), ("PRODUCES", owner == "write"), ("CONSUMES", t.is_word(i, "table")), ("CONSUMES", owner == "read")):
                if fits:
                    self.refer(kind, start, literal(text))

    def type(self, i: int, end: int) -> int:
        t = self.t
        first, j = self.first_of(i), i + 2
        last = i + 1
        while j < end:
            if t.at(j) == "[" or (t.at(j) == "(" and not t.all[j].line_before):
                self.code(j + 1, t.close(j))
                last = t.close(j)
                j = last + 1
            elif t.is_word(j, *self.modifiers) and t.at(j + 1) in ("(", "["):
                j += 1
            else:
                break
        if t.is_word(j, "extends"):
            base = j + 1
            if t.is_word(base) and t.at(base + 1) != ".":
                if t.at(base + 1) != "[" or t.at(i) == "class":
                    self.refer("INHERITS", base, t.at(base))
            j += 1
            while j < end and t.at(j) not in ("{", ";", "}") and not (t.all[j].line_before and t.at(j) not in ("with", "{", "extends") and t.at(j - 1) not in ("with", "extends")):
                if t.at(j) == "(":
                    self.code(j + 1, t.close(j))
                last = t.close(j) if t.at(j) in ("(", "[") else j
                j = last + 1
        if t.at(j) == "{":
            last = t.close(j)
            self.define("class", i + 1, first, last)
            self.code(j + 1, last)
            return last + 1
        self.define("class", i + 1, first, min(last, len(t.all) - 1))
        return j

    def function(self, i: int, end: int) -> int:
        t = self.t
        first, name, j = self.first_of(i), i + 1, i + 2
        params = ""
        if t.at(j) == "[":
            j = t.close(j) + 1
        while t.at(j) == "(" and not (t.all[j].line_before and params):
            params = params or t.source(j, t.close(j))
            self.code(j + 1, t.close(j))
            j = t.close(j) + 1
        if t.at(j) == ":":  # the result's type
            j += 1
            while j < end and t.at(j) not in ("=", "{", "}", ";") and not (t.all[j].line_before and t.at(j - 1) not in ("=>", ":", "with")):
                j = t.close(j) + 1 if t.at(j) in ("(", "[") else j + 1
        if t.at(j) == "=":
            body = j + 1
            if t.at(body) == "{":
                last = t.close(body)
            else:
                last = self.expression_end(body, end)
        elif t.at(j) == "{" and not t.all[j].line_before:
            body, last = j, t.close(j)
        else:
            return j  # declared only
        self.define("function", name, first, last, params)
        self.code(body, last + 1)
        return last + 1


# --- Bash ---


_RESERVED = frozenset("if then elif else fi case esac for while until do done in select ! { } [[ ]] [ function coproc time".split())
_DECLARES = frozenset("export local declare readonly typeset unset let".split())
_COMMAND = re.compile(r"[\w./+:@%,^~-]+")


class Bash:
    """Functions and commands of a shell script, character by character."""

    def __init__(self, text: str) -> None:
        self.s = text
        self.defs: list[Def] = []
        self.refs: list[Ref] = []
        self.heredocs: list[tuple[str, bool]] = []
        self.comment: str | None = None

    def read(self) -> tuple[list[Def], list[Ref]]:
        self.commands(0, "")
        return self.defs, self.refs

    def commands(self, i: int, until: str) -> int:
        """Commands from i up to the character ``until``; the place after it."""
        s, fresh, comment, cases, pattern = self.s, True, None, 0, False
        while i < len(s):
            c = s[i]
            if pattern and not c.isspace() and c != "#":
                pattern = False
                if not re.compile(r"esac\b").match(s, i):
                    i += s.startswith("(", i)
                    while i < len(s) and s[i] != ")":
                        i = self.piece(i)
                    i, fresh = i + 1, True
                continue
            if c == "\n":
                i = self.after_line(i + 1)
                fresh = True
            elif c in " \t\r":
                i += 1
            elif c == "\\":
                i += 2
            elif c == "#" and (i == 0 or s[i - 1] in " \t\n;(){}&|`"):
                stop = s.find("\n", i)
                stop = len(s) if stop < 0 else stop
                comment = s[i:stop].lstrip("/#- ").strip() or None
                i = stop
            elif until and c == until:
                return i + 1
            elif c in ";&|":
                pattern = cases > 0 and s.startswith((";;", ";&"), i)
                i += 2 if pattern else 1
                fresh = True
            elif c == "(":
                i, fresh = (self.skip(i, "((", "))") if s.startswith("((", i) else self.commands(i + 1, ")")), True
            elif c == ")":
                i, fresh = i + 1, True
            elif c in "<>":
                i = self.redirect(i)
            elif fresh:
                before = cases
                i, fresh, comment, cases = self.command(i, comment, cases)
                pattern = cases > before
            else:
                i = self.word(i)
        return i

    def command(self, i: int, comment: str | None, cases: int) -> tuple[int, bool, str | None, int]:
        """What starts at i: a function, a reserved word, an assignment or a command; (place, whether a command may follow, comment, open cases)."""
        s = self.s
        m = re.compile(r"(?:function[ \t]+([^\s(){}]+)[ \t]*(?:\([ \t]*\))?|([A-Za-z_][\w.:-]*)[ \t]*\([ \t]*\))\s*(?=[{(])").match(s, i)
        if m:
            name, body = m[1] or m[2], m.end()
            at = len(self.defs)
            self.defs.append(None)  # type: ignore[arg-type]
            end = self.commands(body + 1, "}" if s[body] == "{" else ")")
            self.defs[at] = ("function", name, i, end, name, comment)
            return end, False, None, cases
        m = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=").match(s, i)
        if m:
            i = m.end()
            if i < len(s) and s[i] == "(":
                return self.commands_in_list(i + 1), True, None, cases
            return (self.word(i) if i < len(s) and s[i] not in " \t\n;" else i), True, None, cases
        m = _COMMAND.match(s, i) or re.compile(r"[{}!\[\]]+").match(s, i)
        word = m[0] if m else ""
        stop = m.end() if m else i
        if word in ("[[", "["):
            close = "]]" if word == "[[" else "]"
            return self.skip(i, word, close), False, None, cases
        if word in _RESERVED:
            if word in ("for", "select"):
                line = re.compile(r"\s+\w+\s*(?:in\b)?").match(s, stop)
                return (line.end() if line else stop), False, None, cases
            if word == "case":
                inside = re.compile(r"\s+").match(s, stop)
                at = self.word(inside.end() if inside else stop)
                keyword = re.compile(r"\s+in\b").match(s, at)
                return (keyword.end() if keyword else at), False, None, cases + 1
            if word == "esac":
                return stop, True, None, max(0, cases - 1)
            return stop, True, None, cases
        if m and (stop == len(s) or s[stop] in " \t\n;&|<>()`"):
            if word not in _DECLARES and not (stop < len(s) and s[stop] in "<>" and word.isdigit()):
                self.refs.append(("CALLS", i, word, []))
            return stop, False, None, cases
        return max(self.word(i), i + 1), False, None, cases

    def commands_in_list(self, i: int) -> int:
        """The words of an array up to its closing parenthesis."""
        while i < len(self.s) and self.s[i] != ")":
            i = i + 1 if self.s[i].isspace() else max(self.word(i), i + 1)
        return i + 1

    def word(self, i: int) -> int:
        """The end of a word; commands inside substitutions are read."""
        s = self.s
        while i < len(s) and s[i] not in " \t\n;&|<>()":
            i = self.piece(i)
        return i

    def piece(self, i: int) -> int:
        s = self.s
        if s[i] == "\\":
            return i + 2
        if s[i] == "'":
            stop = s.find("'", i + 1)
            return len(s) if stop < 0 else stop + 1
        if s[i] == '"':
            i += 1
            while i < len(s) and s[i] != '"':
                i = self.piece(i) if s[i] in "\\$`" else i + 1
            return i + 1
        if s.startswith("$((", i):
            return self.skip(i, "((", "))")
        if s.startswith("$(", i):
            return self.commands(i + 2, ")")
        if s.startswith("${", i):
            i += 2
            while i < len(s) and s[i] != "}":
                i = self.piece(i) if s[i] in "\\$`'\"" else i + 1
            return i + 1
        if s[i] == "`":
            return self.commands(i + 1, "`")
        return i + 1

    def skip(self, i: int, opening: str, closing: str) -> int:
        """Past the closing mark; substitutions on the way are read."""
        s = self.s
        i = s.find(opening, i) + len(opening)
        while i < len(s) and not s.startswith(closing, i) and not (s[i] == "\n" and closing == "]"):
            i = self.piece(i) if s[i] in "\\$`'\"" and not s.startswith("$((", i) else i + 1
        return i + len(closing)

    def redirect(self, i: int) -> int:
        """Past a redirection and its target; here-documents are remembered for the line's end."""
        s = self.s
        m = re.compile(r"<<(-?)\s*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([\w.-]+))").match(s, i)
        if m and not s.startswith("<<<", i):
            self.heredocs.append((m[2] or m[3] or m[4], bool(m[1])))
            return m.end()
        if s.startswith(("<(", ">("), i):
            return self.commands(i + 2, ")")
        m = re.compile(r"[<>&|]+[ \t]*").match(s, i)
        return self.word(m.end())

    def after_line(self, i: int) -> int:
        """Past the here-documents that start on the line that has ended."""
        for mark, tabs in self.heredocs:
            m = re.compile(rf"(?:.*\n)*?{'[	]*' if tabs else ''}{re.escape(mark)}(?:\n|$)").match(self.s, i)
            i = m.end() if m else len(self.s)
        self.heredocs = []
        return i
