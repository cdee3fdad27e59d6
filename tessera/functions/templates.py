"""Text templates that become Column expressions.

A template holds {{ expressions }}, {% if %} / {% elif %} / {% else %} / {% endif %} and
{% for a, b in items %} / {% endfor %}; a minus beside a bracket takes the white space on that side. Expressions join
names, fields (a.b), strings and numbers by ``~``, with the filters trim, upper, lower, length, join('x') and
default('x'), the method split('x'), comparisons, ``not``, ``and`` and ``or``. In a loop, loop.index, loop.first and
loop.last are known. A name that isn't given is a KeyError; a null renders as nothing and is false. Rendering runs in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, MapType, NumericType, StringType, StructType

TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
WORD = re.compile(r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\d+|[A-Za-z_]\w*|==|!=|[~|.(),])""")


@dataclass
class Value:
    """A column and its type."""

    column: Column
    kind: DataType

    def text(self) -> Column:
        return F.coalesce(self.column.cast("string"), F.lit(""))

    def truth(self) -> Column:
        if isinstance(self.kind, (ArrayType, MapType)):
            out = F.size(self.column) > 0
        elif isinstance(self.kind, StringType):
            out = self.column != ""
        elif isinstance(self.kind, NumericType):
            out = self.column != 0
        elif isinstance(self.kind, BooleanType):
            out = self.column
        else:
            out = self.column.isNotNull()
        return F.coalesce(out, F.lit(False))


Scope = dict[str, Value]


class Expression:
    """A parsed expression, evaluated in a scope."""

    def __init__(self, source: str):
        self.words, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := WORD.match(source, at)):
                raise ValueError(f"can't read {source[at:]!r} in {source!r}")
            self.words.append(m[1])
            at = m.end()
        self.source, self.at = source, 0

    def value(self, scope: Scope) -> Value:
        self.at = 0
        out = self._either(scope)
        if self.at < len(self.words):
            raise ValueError(f"{self.words[self.at]!r} is too much in {self.source!r}")
        return out

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.words) and (not wanted or self.words[self.at] in wanted):
            self.at += 1
            return self.words[self.at - 1]
        return None

    def _need(self, word: str) -> None:
        if not self._next(word):
            raise ValueError(f"{word!r} is missing in {self.source!r}")

    def _either(self, scope: Scope) -> Value:
        out = self._both(scope)
        while self._next("or"):
            out = Value(out.truth() | self._both(scope).truth(), BooleanType())
        return out

    def _both(self, scope: Scope) -> Value:
        out = self._negated(scope)
        while self._next("and"):
            out = Value(out.truth() & self._negated(scope).truth(), BooleanType())
        return out

    def _negated(self, scope: Scope) -> Value:
        if self._next("not"):
            return Value(~self._negated(scope).truth(), BooleanType())
        left = self._joined(scope)
        if op := self._next("==", "!="):
            same = F.equal_null(left.column, self._joined(scope).column)
            return Value(same if op == "==" else ~same, BooleanType())
        return left

    def _joined(self, scope: Scope) -> Value:
        out = self._filtered(scope)
        while self._next("~"):
            out = Value(F.concat(out.text(), self._filtered(scope).text()), StringType())
        return out

    def _string(self) -> str:
        word = self._next()
        if not word or word[0] not in "'\"":
            raise ValueError(f"a string is missing in {self.source!r}")
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])

    def _filtered(self, scope: Scope) -> Value:
        out = self._place(scope)
        while self._next("|"):
            name = self._next()
            argument = None
            if self._next("("):
                argument = self._string()
                self._need(")")
            out = _filter(name, out, argument)
        return out

    def _place(self, scope: Scope) -> Value:
        word = self._next()
        if word == "(":
            out = self._either(scope)
            self._need(")")
            return out
        if word and word[0] in "'\"":
            self.at -= 1
            return Value(F.lit(self._string()), StringType())
        if word and word.isdigit():
            return Value(F.lit(int(word)), IntegerType())
        name = word
        while self._next("."):
            part = self._next()
            if part == "split" and self._next("("):
                mark = self._string()
                self._need(")")
                return Value(F.split(scope_value(scope, name).text(), re.escape(mark)), ArrayType(StringType()))
            name = f"{name}.{part}"
        return scope_value(scope, name)


def scope_value(scope: Scope, name: str | None) -> Value:
    if name in scope:
        return scope[name]
    head, _, rest = (name or "").partition(".")
    if head in scope and rest and isinstance(scope[head].kind, StructType):
        return Value(scope[head].column[rest], scope[head].kind[rest].dataType)
    raise KeyError(f"the template's {name!r} is not given; there are {', '.join(sorted(scope))}")


def _filter(name: str | None, value: Value, argument: str | None) -> Value:
    text = {"trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), "upper": F.upper, "lower": F.lower}
    if name in text:
        return Value(text[name](value.text()), StringType())
    if name == "length":
        return Value(F.size(value.column) if isinstance(value.kind, ArrayType) else F.length(value.text()), IntegerType())
    if name == "join":
        return Value(F.array_join(F.transform(value.column, lambda x: F.coalesce(x.cast("string"), F.lit(""))), argument or ""), StringType())
    if name == "default":
        return Value(F.coalesce(value.column.cast("string"), F.lit(argument or "")), StringType())
    raise ValueError(f"no filter {name!r}")


@dataclass
class Node:
    """Text, an expression, a choice of (condition, nodes), or a loop."""

    text: str = ""
    shown: Expression | None = None
    choices: list[tuple[Expression | None, list[Node]]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    items: Expression | None = None
    body: list[Node] = field(default_factory=list)

    def column(self, scope: Scope) -> Column:
        if self.shown:
            return self.shown.value(scope).text()
        if self.choices:
            out = None
            for condition, nodes in self.choices:
                then = _all(nodes, scope)
                test = F.lit(True) if condition is None else condition.value(scope).truth()
                out = F.when(test, then) if out is None else out.when(test, then)
            return out.otherwise("")
        if self.items:
            items = self.items.value(scope)
            if not isinstance(items.kind, ArrayType):
                raise TypeError(f"{self.items.source!r} is no array")
            size, kind = F.size(items.column), items.kind.elementType

            def once(x: Column, i: Column) -> Column:
                loop = {"loop.index": Value(i + 1, IntegerType()), "loop.first": Value(i == 0, BooleanType()), "loop.last": Value(i == size - 1, BooleanType())}
                if len(self.names) == 1:
                    return _all(self.body, scope | loop | {self.names[0]: Value(x, kind)})
                fields = zip(self.names, kind.fields, strict=True)
                return _all(self.body, scope | loop | {n: Value(x[f.name], f.dataType) for n, f in fields})

            return F.coalesce(F.array_join(F.transform(items.column, once), ""), F.lit(""))
        return F.lit(self.text)


def _all(nodes: list[Node], scope: Scope) -> Column:
    columns = [n.column(scope) for n in nodes]
    return F.concat(*columns) if columns else F.lit("")


class Template:
    """A parsed template."""

    def __init__(self, source: str):
        pieces = TAG.split(source.removesuffix("\n"))
        for i in range(1, len(pieces), 2):
            if pieces[i][2:3] == "-":
                pieces[i - 1] = pieces[i - 1].rstrip()
            if pieces[i][-3:-2] == "-":
                pieces[i + 1] = pieces[i + 1].lstrip()
        self._pieces, self._at = pieces, 0
        self.nodes, end = self._nodes()
        if end:
            raise ValueError(f"{end!r} closes nothing")

    def _nodes(self) -> tuple[list[Node], str | None]:
        """Nodes up to a tag that ends or parts a block, and that tag."""
        out = []
        while self._at < len(self._pieces):
            piece, tag = self._pieces[self._at], self._at % 2
            self._at += 1
            if not tag:
                out += [Node(text=piece)] if piece else []
            elif piece.startswith("{{"):
                out.append(Node(shown=Expression(piece[2:-2].strip("-"))))
            elif piece.startswith("{%"):
                says = piece[2:-2].strip("-").strip()
                word, _, rest = says.partition(" ")
                if word == "if":
                    out.append(self._choice(rest))
                elif word == "for":
                    names, _, items = rest.partition(" in ")
                    body, end = self._nodes()
                    if end != "endfor":
                        raise ValueError("a loop has no end")
                    out.append(Node(names=[n.strip() for n in names.split(",")], items=Expression(items), body=body))
                else:
                    return out, says
        return out, None

    def _choice(self, condition: str) -> Node:
        choices, test = [], Expression(condition)
        while True:
            nodes, end = self._nodes()
            choices.append((test, nodes))
            word, _, rest = (end or "").partition(" ")
            if word == "elif":
                test = Expression(rest)
            elif word == "else":
                test = None
            elif word == "endif":
                return Node(choices=choices)
            else:
                raise ValueError("a condition has no end")

    def column(self, scope: Scope) -> Column:
        return _all(self.nodes, scope)


def scope_of(df: DataFrame, **params: str | int | bool) -> Scope:
    """The columns of ``df`` and some literals, as a template sees them."""
    kinds = {bool: BooleanType(), int: IntegerType(), str: StringType()}
    return {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema} | {k: Value(F.lit(v), kinds[type(v)]) for k, v in params.items()}


def rendered(df: DataFrame, source: str, **params: str | int | bool) -> Column:
    return Template(source).column(scope_of(df, **params))


def apply_prompts(df: DataFrame, pipe: list[dict], params: dict | None = None, flags: dict | None = None) -> DataFrame:
    """``df`` with input_sequence rendered by each prompt in turn, the next one seeing what the last one made.

    A prompt is {"template", "params", "flags"}; ``params`` and ``flags`` go over its own. A flag that bears the name of a
    column is a KeyError, as is a missing input_sequence.
    """
    if "input_sequence" not in df.columns:
        raise KeyError("input_sequence")

    def step(now: DataFrame, prompt: dict) -> DataFrame:
        own = {**prompt.get("flags", {}), **(flags or {})}
        if clash := set(own) & set(now.columns):
            raise KeyError(f"flags that are columns: {', '.join(sorted(clash))}")
        given = {**prompt.get("params", {}), **(params or {}), **own}
        return now.withColumn("input_sequence", rendered(now, prompt["template"], **given))

    return reduce(step, pipe, df)
