"""Path and argument templates, compiled to column expressions.

Text with actions in double braces: a field (``.Year``, ``.`` for the value at hand, ``$.Year`` from
inside a block), a literal, or a call of ``and or not eq ne lt le gt ge len print printf``, piped if
need be; ``if``, ``else if``, ``else``, ``with``, ``range`` and ``end``; comments; and ``{{-`` and
``-}}``, which take the white space beside them. A template is read when the configuration is, and
what it can't say fails there: unknown fields, unclosed blocks, comparisons of unlike values,
variables, and formats other than ``%s %v %d %q %%`` in a literal.

Everything compiles: ``if`` to CASE, ``range`` to a transformation of an array; nothing is parsed or
branched in a task but by Spark's own expressions. Null values count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACTION = re.compile(r"\{\{(-\s)?\s*((?:\"(?:\\.|[^\"\\])*\"|`[^`]*`|/\*.*?\*/|[^}\"`]|\}(?!\}))*?)\s*(\s-)?\}\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>\"(?:\\.|[^\"\\])*\"|`[^`]*`)|(?P<number>-?\d+)|(?P<field>\$?\.[A-Za-z_]\w*|\$|\.)|(?P<word>[A-Za-z_]\w*)|(?P<sign>[|()]))")
_FORMAT = re.compile(r"%(.)")

#: What a value is: a text, a whole number, a truth, a list of texts, or one of several of these,
#: of which only the truth is known.
TEXT, NUMBER, TRUTH, LIST, MIXED = "text", "number", "truth", "list", "mixed"


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    kind: str
    column: Column

    def true(self) -> Column:
        if self.kind in (TRUTH, MIXED):
            return self.column
        return {TEXT: self.column != "", NUMBER: self.column != 0, LIST: F.size(self.column) > 0}[self.kind]

    def text(self) -> Column:
        if self.kind == LIST:
            return F.concat(F.lit("["), F.array_join(self.column, " "), F.lit("]"))
        return self.column if self.kind == TEXT else self.column.cast("string")


#: A scope: the value at hand, and the fields by name.
Scope = tuple[Value | None, Mapping[str, Value]]
Expression = Callable[[Scope], Value]
Node = Callable[[Scope], Column]


@dataclass(frozen=True)
class Template:
    """A template's text, the fields that it names ('' the whole value), and what it compiles to."""

    text: str
    names: frozenset[str]
    lists: frozenset[str] = frozenset()
    _node: Node = field(repr=False, compare=False, default=None)

    @classmethod
    def parse(cls, text: str, fields: Sequence[str], where: str, lists: Sequence[str] = ()) -> Template:
        """``fields`` are the names it may use, '' for the value itself; ``lists`` those that are lists."""
        reader = _Reader(text, fields, f"{where} {text!r}", frozenset(lists))
        node = reader.block(())
        return cls(text, frozenset(reader.names), frozenset(lists), node)

    def rendered(self, values: Mapping[str, Column]) -> Column:
        """The text as a column; null values render as nothing, never as a missing piece."""
        known = {}
        for name, column in values.items():
            known[name] = Value(LIST, F.coalesce(column, F.array().cast("array<string>"))) if name in self.lists else Value(TEXT, F.coalesce(column, F.lit("")))
        return self._node((known.get(""), known))


def _joined(parts: list[Node]) -> Node:
    def made(scope: Scope) -> Column:
        columns = [p(scope) for p in parts]
        return F.lit("") if not columns else columns[0] if len(columns) == 1 else F.concat(*columns)

    return made


class _Reader:
    """Recursive descent over the pieces of a template."""

    def __init__(self, text: str, fields: Sequence[str], where: str, lists: frozenset[str]):
        self.fields, self.where, self.lists, self.names = fields, where, lists, set()
        self.pieces, self.at = self._pieces(text), 0
        #: What ``.`` is: the fields, or the kind of the value at hand.
        self.dot: str | None = TEXT if "" in fields else None

    def fail(self, why: str):
        raise TemplateError(f"{self.where}: {why}")

    def _pieces(self, text: str) -> list[tuple[bool, str]]:
        out, at, trim = [], 0, False
        for m in _ACTION.finditer(text):
            plain = text[at : m.start()]
            plain = plain.lstrip() if trim else plain
            out.append((False, plain.rstrip() if m[1] else plain))
            out.append((True, m[2].strip()))
            at, trim = m.end(), bool(m[3])
        rest = text[at:]
        out.append((False, rest.lstrip() if trim else rest))
        if any("{{" in piece for action, piece in out if not action):
            self.fail("unclosed action")
        return out

    # ------------------------------------------------------------ blocks

    def block(self, ends: tuple[str, ...]) -> Node:
        """Everything up to one of ``ends``, which is left for the caller; () for the whole text."""
        parts: list[Node] = []
        while self.at < len(self.pieces):
            action, piece = self.pieces[self.at]
            if not action:
                self.at += 1
                if piece:
                    parts.append(lambda scope, piece=piece: F.lit(piece))
                continue
            word = re.match(r"[a-z]*", piece)[0]
            if word in ("end", "else"):
                if word not in ends:
                    self.fail(f"unexpected {{{{{piece}}}}}")
                return _joined(parts)
            self.at += 1
            if re.fullmatch(r"/\*.*\*/", piece, re.S):
                continue
            if word in ("if", "with", "range"):
                parts.append(self.branch(word, piece[len(word) :]))
            else:
                kind, value = self.pipeline(piece)
                if kind == MIXED:
                    self.fail("what is written must be of one kind")
                parts.append(lambda scope, value=value: value(scope).text())
        if ends:
            self.fail("a block has no {{end}}")
        return _joined(parts)

    def branch(self, word: str, said: str) -> Node:
        kind, value = self.pipeline(said)
        outer = self.dot
        if word == "range" and kind != LIST:
            self.fail("only a list has a range")
        if word != "if":
            self.dot = TEXT if word == "range" else kind
        then = self.block(("else", "end"))
        self.dot = outer
        other = self.otherwise()

        def made(scope: Scope) -> Column:
            v = value(scope)
            if word == "range":
                each = F.array_join(F.transform(v.column, lambda x: then((Value(TEXT, F.coalesce(x, F.lit(""))), scope[1]))), "")
                return F.when(v.true(), each).otherwise(other(scope))
            return F.when(v.true(), then((v, scope[1]) if word == "with" else scope)).otherwise(other(scope))

        return made

    def otherwise(self) -> Node:
        piece = self.pieces[self.at][1]
        self.at += 1
        if piece == "end":
            return _joined([])
        said = piece[len("else") :].strip()
        for word in ("if", "with"):
            if re.match(rf"{word}\b", said):
                return self.branch(word, said[len(word) :])
        if said:
            self.fail(f"unexpected {{{{{piece}}}}}")
        other = self.block(("end",))
        self.at += 1
        return other

    # ------------------------------------------------------------ expressions

    def pipeline(self, said: str) -> tuple[str, Expression]:
        tokens, at = [], 0
        said = said.strip()
        while at < len(said):
            m = _TOKEN.match(said, at)
            if not m:
                self.fail(f"{said[at:]!r} is not understood")
            tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens, self.next = tokens, 0
        out = self.piped()
        if self.next < len(tokens):
            self.fail(f"{tokens[self.next][1]!r} is not expected in {{{{{said}}}}}")
        return out

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.next] if self.next < len(self.tokens) else ("", "")

    def piped(self) -> tuple[str, Expression]:
        out = self.command(None)
        while self._peek() == ("sign", "|"):
            self.next += 1
            if self._peek()[0] != "word":
                self.fail("a value can only be piped into a function")
            out = self.command(out)
        return out

    def command(self, last: tuple[str, Expression] | None) -> tuple[str, Expression]:
        kind, said = self._peek()
        if kind != "word" or said in ("true", "false"):
            return self.operand()
        self.next += 1
        given = []
        while self._peek()[0] and self._peek() not in (("sign", "|"), ("sign", ")")):
            given.append(self.operand())
        return self.call(said, given if last is None else [*given, last])

    def operand(self) -> tuple[str, Expression]:
        kind, said = self._peek()
        self.next += 1
        if kind == "text":
            plain = said[1:-1] if said[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), said[1:-1])
            return TEXT, _Literal(TEXT, plain)
        if kind == "number":
            return NUMBER, _Literal(NUMBER, int(said))
        if kind == "word" and said in ("true", "false"):
            return TRUTH, _Literal(TRUTH, said == "true")
        if (kind, said) == ("sign", "("):
            out = self.piped()
            if self._peek() != ("sign", ")"):
                self.fail("a parenthesis isn't closed")
            self.next += 1
            return out
        if kind == "field":
            return self.named(said)
        self.fail(f"{said!r} is no value" if said else "an action lacks a value")

    def named(self, said: str) -> tuple[str, Expression]:
        if said == ".":
            if self.dot is None:
                self.fail(f". is no field; known are {', '.join('.' + f for f in self.fields)}")
            if "" in self.fields:
                self.names.add("")
            return self.dot, lambda scope: scope[0]
        name = said.removeprefix("$").removeprefix(".")
        if name not in self.fields or not name or (said[0] != "$" and self.dot is not None):
            self.fail(f"{said} is not a field; known are {', '.join('.' + f for f in self.fields)}")
        self.names.add(name)
        return (LIST if name in self.lists else TEXT), lambda scope: scope[1][name]

    def call(self, name: str, given: list[tuple[str, Expression]]) -> tuple[str, Expression]:
        kinds, values = [k for k, _ in given], [v for _, v in given]
        if name in ("and", "or") and given:
            if len(set(kinds)) > 1 or MIXED in kinds:

                def held(scope: Scope) -> Value:
                    out = values[0](scope).true()
                    for v in values[1:]:
                        out = out & v(scope).true() if name == "and" else out | v(scope).true()
                    return Value(MIXED, out)

                return MIXED, held

            def chosen(scope: Scope) -> Value:
                met = [v(scope) for v in values]
                out = met[-1].column
                for v in reversed(met[:-1]):
                    out = F.when(v.true(), out if name == "and" else v.column).otherwise(v.column if name == "and" else out)
                return Value(kinds[0], out)

            return kinds[0], chosen
        if name == "not" and len(given) == 1:
            return TRUTH, lambda scope: Value(TRUTH, ~values[0](scope).true())
        if name in ("eq", "ne", "lt", "le", "gt", "ge") and (len(given) == 2 or name == "eq" and len(given) > 2):
            if len(set(kinds)) > 1 or kinds[0] in (LIST, MIXED) or kinds[0] == TRUTH and name not in ("eq", "ne"):
                self.fail(f"{name} of values that don't compare")
            return TRUTH, lambda scope: _compared(name, [v(scope).column for v in values])
        if name == "len" and len(given) == 1 and kinds[0] in (TEXT, LIST):
            return NUMBER, lambda scope: Value(NUMBER, F.octet_length(values[0](scope).column) if kinds[0] == TEXT else F.size(values[0](scope).column))
        if name == "print" and MIXED not in kinds:
            return TEXT, lambda scope: Value(TEXT, _printed([v(scope) for v in values]))
        if name == "printf" and given and isinstance(values[0], _Literal) and kinds[0] == TEXT:
            return TEXT, self.format(values[0].plain, given[1:])
        self.fail(f"{name} is no function, or not of these values")

    def format(self, form: str, given: list[tuple[str, Expression]]) -> Expression:
        wanted = [m[1] for m in _FORMAT.finditer(form) if m[1] != "%"]
        fits = {"s": (TEXT,), "q": (TEXT,), "d": (NUMBER,), "v": (TEXT, NUMBER, TRUTH, LIST)}
        if len(wanted) != len(given) or any(k not in fits.get(w, ()) for w, (k, _) in zip(wanted, given, strict=False)):
            self.fail(f"the format {form!r} doesn't fit its values")

        def made(scope: Scope) -> Value:
            rest, parts, at = [v(scope) for _, v in given], [], 0
            for m in _FORMAT.finditer(form):
                parts.append(F.lit(form[at : m.start()]))
                at = m.end()
                if m[1] == "%":
                    parts.append(F.lit("%"))
                    continue
                text = rest.pop(0).text()
                parts.append(F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"')) if m[1] == "q" else text)
            return Value(TEXT, F.concat(*parts, F.lit(form[at:])))

        return made


@dataclass(frozen=True)
class _Literal:
    kind: str
    plain: str | int | bool

    def __call__(self, scope: Scope) -> Value:
        return Value(self.kind, F.lit(self.plain))


def _compared(name: str, columns: list[Column]) -> Value:
    a, b = columns[:2]
    if name == "eq":
        out = a == b
        for other in columns[2:]:
            out = out | (a == other)
    else:
        out = {"ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[name]
    return Value(TRUTH, out)


def _printed(values: list[Value]) -> Column:
    """One after another, with a blank between two that are both no text."""
    parts = []
    for k, v in enumerate(values):
        if k and TEXT not in (v.kind, values[k - 1].kind):
            parts.append(F.lit(" "))
        parts.append(v.text())
    return F.concat(*parts) if parts else F.lit("")
