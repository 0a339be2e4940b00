"""Statements of the MySQL dialect to trees. Operator precedence as documented for the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class SqlError(ValueError):
    """A statement that cannot be parsed or is not supported."""


@dataclass(frozen=True)
class Node:
    """kind: lit, col, star, call, op, case, cast, in, between, null, truth, like, regexp, interval, var, param."""

    kind: str
    value: object = None
    args: tuple = ()
    text: str = field(default="", compare=False)


_TOKEN = re.compile(
    r"""\s+|(?:--\s|\#)[^\n]*|/\*.*?\*/|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)(?![A-Za-z_0-9])
    |(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<quoted>`[^`]+`)|(?P<var>@@?[A-Za-z_.0-9]+)
    |(?P<word>[A-Za-z_$\u0080-￿0-9][A-Za-z_$\u0080-￿0-9]*)|(?P<op><=>|<<|>>|<=|>=|<>|!=|:=|&&|\|\||[-+*/%^=<>!~&|(),.;?@])""",
    re.S | re.X,
)
#: Escapes in string literals.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
#: Words that end an expression or an alias.
RESERVED = frozenset(
    "select from where group by having order limit offset and or not xor in is null like rlike regexp between case when then else end as asc desc distinct "
    "div mod on set values into union join left right inner cross natural using update delete insert for use ignore force index key duplicate interval true false".split()
)
_BINARY = {
    "or": 1, "||": 1, "xor": 2, "and": 3, "&&": 3, "=": 6, "<=>": 6, ">=": 6, ">": 6, "<=": 6, "<": 6, "<>": 6, "!=": 6,
    "|": 7, "&": 8, "<<": 9, ">>": 9, "-": 10, "+": 10, "*": 11, "/": 11, "div": 11, "%": 11, "mod": 11, "^": 12,
}
_NAMES = {"||": "or", "&&": "and", "<>": "!=", "mod": "%"}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"cannot read {sql[at : at + 20]!r}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()
    return out


def unquote(text: str) -> str:
    q = text[0]
    body = text[1:-1].replace(q + q, q)
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_" else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i, self.params = sql, tokenize(sql), 0, 0

    # Tokens

    def peek(self, *words: str) -> bool:
        """Whether the next tokens are these words or signs."""
        return all(self.i + k < len(self.tokens) and self.tokens[self.i + k].kind in ("word", "op") and self.tokens[self.i + k].text.lower() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"{' '.join(words).upper()} expected near {self.near()!r}")

    def near(self) -> str:
        return self.sql[self.tokens[self.i].at :][:30] if self.i < len(self.tokens) else "the end"

    def done(self) -> bool:
        return self.i >= len(self.tokens)

    def name(self) -> str:
        if self.done() or self.tokens[self.i].kind not in ("word", "quoted"):
            raise SqlError(f"a name is expected near {self.near()!r}")
        t = self.tokens[self.i]
        self.i += 1
        return t.text.strip("`")

    def table_name(self) -> str:
        out = self.name()
        while self.take("."):
            out += "." + self.name()
        return out

    def integer(self) -> int:
        t = self.tokens[self.i] if not self.done() else None
        if t is None or t.kind != "num" or not t.text.isdigit():
            raise SqlError(f"a whole number is expected near {self.near()!r}")
        self.i += 1
        return int(t.text)

    def list_of(self, item) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    # Expressions

    def expression(self, least: int = 0) -> Node:
        start = self.i
        left = self._not() if least <= 4 else self._unary()
        while True:
            if self.done():
                return left
            word = self.tokens[self.i].text.lower() if self.tokens[self.i].kind in ("word", "op") else ""
            level = _BINARY.get(word)
            if level is not None and level >= least:
                self.i += 1
                right = self.expression(level + 1)
                left = Node("op", _NAMES.get(word, word), (left, right), self._text(start))
            elif least <= 6 and (more := self._predicate(left, start)) is not None:
                left = more
            else:
                return left

    def _text(self, start: int) -> str:
        return self.sql[self.tokens[start].at : self.tokens[self.i - 1].end]

    def _not(self) -> Node:
        start = self.i
        if self.take("not"):
            return Node("op", "not", (self.expression(4),), self._text(start))
        return self._unary()

    def _predicate(self, left: Node, start: int) -> Node | None:
        if self.take("is"):
            negated = self.take("not")
            for word, kind in (("null", "null"), ("true", "truth"), ("false", "truth")):
                if self.take(word):
                    out = Node(kind, word, (left,), self._text(start))
                    return Node("op", "not", (out,), out.text) if negated else out
            raise SqlError(f"NULL, TRUE or FALSE expected near {self.near()!r}")
        negated = self.peek("not") and any(self.tokens[self.i + 1].text.lower() == w for w in ("in", "between", "like", "regexp", "rlike")) if self.i + 1 < len(self.tokens) else False
        if negated:
            self.i += 1
        out = None
        if self.take("in"):
            self.need("(")
            if self.peek("select"):
                raise SqlError("subqueries are not supported")
            items = self.list_of(self.expression)
            self.need(")")
            out = Node("in", None, (left, *items))
        elif self.take("between"):
            low = self.expression(7)
            self.need("and")
            out = Node("between", None, (left, low, self.expression(7)))
        elif self.take("like"):
            right = self.expression(7)
            escape = unquote(self.tokens[self.i - 1].text) if self.take("escape") and self._step() else "\\"
            out = Node("like", escape, (left, right))
        elif self.take("regexp") or self.take("rlike"):
            out = Node("regexp", None, (left, self.expression(7)))
        if out is None:
            return None
        out = Node(out.kind, out.value, out.args, self._text(start))
        return Node("op", "not", (out,), out.text) if negated else out

    def _step(self) -> bool:
        self.i += 1
        return True

    def _unary(self) -> Node:
        start = self.i
        for sign, name in (("-", "neg"), ("+", "pos"), ("~", "~"), ("!", "not")):
            if self.take(sign):
                inner = self._unary()
                if name == "neg" and inner.kind == "lit" and isinstance(inner.value, (int, float, str)) and not isinstance(inner.value, (bool, str)):
                    return Node("lit", -inner.value, (), self._text(start))
                return inner if name == "pos" else Node("op", name, (inner,), self._text(start))
        return self._primary()

    def _primary(self) -> Node:
        if self.done():
            raise SqlError("an expression is expected at the end")
        start, t = self.i, self.tokens[self.i]
        self.i += 1
        if t.kind == "num":
            value = int(t.text) if t.text.isdigit() else t.text
            return Node("lit" if isinstance(value, int) else "number", value, (), t.text)
        if t.kind == "str":
            return Node("lit", unquote(t.text), (), t.text)
        if t.kind == "var":
            return Node("var", t.text.lower(), (), t.text)
        if t.text == "?":
            self.params += 1
            return Node("param", self.params - 1, (), "?")
        if t.text == "(":
            if self.peek("select"):
                raise SqlError("subqueries are not supported")
            inner = self.expression()
            self.need(")")
            return Node(inner.kind, inner.value, inner.args, self._text(start))
        if t.text == "*":
            return Node("star", None, (), "*")
        word = t.text.lower()
        if t.kind == "word":
            if word in ("null", "true", "false"):
                return Node("lit", {"null": None, "true": True, "false": False}[word], (), t.text)
            if word == "case":
                return self._case(start)
            if word == "interval" and not self.peek("("):
                amount = self.expression()
                return Node("interval", self.name(), (amount,), self._text(start))
            if word in ("cast", "convert") and self.take("("):
                inner = self.expression()
                if not self.take("as"):
                    self.need(",")
                kind = self._type()
                self.need(")")
                return Node("cast", kind, (inner,), self._text(start))
            if word == "exists":
                raise SqlError("subqueries are not supported")
            if word in ("date", "timestamp", "time") and not self.done() and self.tokens[self.i].kind == "str":
                self.i += 1
                return Node("cast", {"date": "date", "timestamp": "datetime", "time": "time"}[word], (Node("lit", unquote(self.tokens[self.i - 1].text)),), self._text(start))
            if self.take("("):
                return self._call(word, start)
            if word in ("current_date", "current_timestamp", "localtime", "localtimestamp", "current_time", "utc_date", "utc_timestamp"):
                return Node("call", word, (), t.text)
            if word in RESERVED:
                raise SqlError(f"an expression is expected near {self.sql[t.at : t.at + 30]!r}")
        parts = [t.text.strip("`")]
        while self.take("."):
            if self.take("*"):
                return Node("star", ".".join(parts), (), self._text(start))
            parts.append(self.name())
        return Node("col", tuple(parts), (), self._text(start))

    def _call(self, word: str, start: int) -> Node:
        distinct, args, extra = self.take("distinct"), [], None
        if word in ("extract",):
            unit = self.name()
            self.need("from")
            args = [Node("lit", unit), self.expression()]
        elif word in ("timestampadd", "timestampdiff", "get_format"):
            args = [Node("lit", self.name())]
            while self.take(","):
                args.append(self.expression())
        elif word == "position":
            needle = self.expression(7)
            self.need("in")
            args = [needle, self.expression()]
        elif word == "trim":
            side = next((s for s in ("both", "leading", "trailing") if self.take(s)), None)
            first = None if self.peek("from") else self.expression()
            args = [Node("lit", side or "both"), first, self.expression()] if self.take("from") else [first]
        elif word in ("substring", "substr", "mid"):
            args = [self.expression()]
            if self.take("from"):
                args.append(self.expression())
                if self.take("for"):
                    args.append(self.expression())
            while self.take(","):
                args.append(self.expression())
        elif not self.peek(")"):
            args = self.list_of(self.expression)
            if word == "group_concat" and self.take("separator"):
                self.i += 1
                extra = unquote(self.tokens[self.i - 1].text)
        self.need(")")
        if self.peek("over"):
            raise SqlError("window functions are not supported")
        return Node("call", word, (("distinct" if distinct else None), extra, *args), self._text(start))

    def _case(self, start: int) -> Node:
        operand = None if self.peek("when") else self.expression()
        whens = []
        while self.take("when"):
            test = self.expression()
            self.need("then")
            whens.append((test, self.expression()))
        otherwise = self.expression() if self.take("else") else None
        self.need("end")
        return Node("case", None, (operand, tuple(whens), otherwise), self._text(start))

    def _type(self) -> str:
        start = self.i
        self.i += 1
        if self.take("("):
            while not self.take(")"):
                self.i += 1
        while self.take("unsigned") or self.take("signed") or self.take("zerofill") or self.take("integer"):
            pass
        return self._text(start)

    # Clauses

    def alias(self) -> str | None:
        if self.take("as"):
            t = self.tokens[self.i]
            self.i += 1
            return unquote(t.text) if t.kind == "str" else t.text.strip("`")
        if not self.done() and (self.tokens[self.i].kind == "quoted" or self.tokens[self.i].kind == "word" and self.tokens[self.i].text.lower() not in RESERVED):
            return self.name()
        return None

    def order_by(self) -> list[tuple[Node, bool]]:
        def item():
            e = self.expression()
            return (e, True) if self.take("desc") else (e, self.take("asc") and False)

        return self.list_of(item) if self.take("order", "by") else []

    def limit(self) -> tuple[int, int] | None:
        """(offset, count)."""
        if not self.take("limit"):
            return None
        a = self._count()
        if self.take(","):
            return a, self._count()
        if self.take("offset"):
            return self._count(), a
        return 0, a

    def _count(self):
        if self.take("?"):
            self.params += 1
            return Node("param", self.params - 1)
        return self.integer()

    def hints(self) -> None:
        """USE, IGNORE and FORCE INDEX are accepted; there is no index to choose."""
        while self.peek("use") or self.peek("ignore") or self.peek("force"):
            self.i += 1
            if not (self.take("index") or self.take("key")):
                raise SqlError("INDEX expected")
            if self.take("for"):
                while not self.peek("("):
                    self.i += 1
            self.need("(")
            while not self.take(")"):
                self.i += 1
            self.take(",")

    def select(self) -> dict:
        self.need("select")
        distinct = self.take("distinct")
        self.take("all")
        items = self.list_of(lambda: (self.expression(), self.alias()))
        out = {"kind": "select", "distinct": distinct, "items": items, "table": None, "alias": None, "where": None, "group": [], "having": None}
        if self.take("from"):
            if self.peek("("):
                raise SqlError("derived tables are not supported")
            if not self.take("dual"):
                out["table"], out["alias"] = self.table_name(), self.alias()
                self.hints()
            if self.peek(",") or any(self.peek(w) for w in ("join", "left", "right", "inner", "cross", "natural")):
                raise SqlError("join queries are not supported")
        if self.take("where"):
            out["where"] = self.expression()
        if self.take("group", "by"):
            out["group"] = self.list_of(lambda: (self.expression(), self.take("desc") or self.take("asc"))[0])
            if self.take("with"):
                raise SqlError("GROUP BY ... WITH ROLLUP is not supported")
        if self.take("having"):
            out["having"] = self.expression()
        out["order"], out["limit"] = self.order_by(), self.limit()
        self.take("for", "update")
        if self.peek("union"):
            raise SqlError("UNION is not supported")
        return out

    def insert(self) -> dict:
        self.need("insert")
        self.take("into")
        out = {"kind": "insert", "table": self.table_name(), "columns": None, "update": []}
        if self.take("("):
            out["columns"] = self.list_of(self.name)
            self.need(")")
        if not (self.take("values") or self.take("value")):
            raise SqlError("INSERT needs VALUES")

        def row():
            self.need("(")
            values = [] if self.peek(")") else self.list_of(lambda: Node("default") if self.take("default") else self.expression())
            self.need(")")
            return values

        out["rows"] = self.list_of(row)
        if self.take("on", "duplicate", "key", "update"):
            out["update"] = self.list_of(self.assignment)
        return out

    def assignment(self) -> tuple[str, Node]:
        column = self.table_name().rpartition(".")[2]
        self.need("=")
        return column, Node("default") if self.take("default") else self.expression()

    def update(self) -> dict:
        self.need("update")
        table, alias = self.table_name(), self.alias() if not self.peek("set") else None
        self.need("set")
        out = {"kind": "update", "table": table, "alias": alias, "set": self.list_of(self.assignment)}
        return out | self._where("UPDATE")

    def delete(self) -> dict:
        self.need("delete")
        self.need("from")
        out = {"kind": "delete", "table": self.table_name(), "alias": None}
        if self.peek(","):
            raise SqlError("DELETE from several tables is not supported")
        return out | self._where("DELETE")

    def _where(self, what: str) -> dict:
        if not self.take("where"):
            raise SqlError(f"{what} needs WHERE")
        return {"where": self.expression(), "order": self.order_by(), "limit": self.limit()}


def split_statements(sql: str) -> list[str]:
    """Statements between top-level semicolons."""
    out, start = [], 0
    for t in tokenize(sql):
        if t.text == ";":
            out.append(sql[start : t.at])
            start = t.end
    return [s for s in (*out, sql[start:]) if s.strip()]
