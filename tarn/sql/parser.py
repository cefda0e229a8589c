"""Text to syntax tree, by recursive descent."""

from __future__ import annotations

import re
import sys

from tarn import expr as x
from tarn.errors import EngineError, type_error, unsupported
from tarn.plans.spec import Order
from tarn.sql.ast import AggCall, Describe, InQuery, Join, ScalarQuery, Select, Star, Table

MOST_CHARACTERS, MOST_DEPTH = 128_000, 128
TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")+")"""
    r"""|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<param>\$\d+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<op><=|>=|<>|!=|::|\|\||[-+*/%^=<>(),.;])""",
    re.DOTALL,
)
AGGREGATES = set("count sum avg min max median mode first last any var variance var_samp var_pop stddev stddev_samp stddev_pop quantile quantile_cont approx_count_distinct".split())
# Words that end an expression or an alias.
RESERVED = set("select from where group having order limit offset join inner left right full cross on using and or not in like ilike between is null as by asc desc nulls union intersect except window case when then else end with distinct natural outer".split())
COMPARE = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise EngineError("PARSE_ERROR", f"cannot read {text[at : at + 20]!r}", position=at)
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
    return out


class Parser:
    def __init__(self, text: str, parameters: tuple = ()):
        if len(text) > MOST_CHARACTERS:
            raise EngineError("PARSE_ERROR", f"more than {MOST_CHARACTERS} characters")
        self.tokens, self.at, self.parameters, self.depth = tokenize(text), 0, parameters, 0

    # Tokens.

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.lower() if kind == "name" else ""

    def take(self, *words: str) -> bool:
        """Takes a run of keywords or operators if all of it is next."""
        for i, w in enumerate(words):
            kind, text = self.peek(i)
            if kind not in ("name", "op") or text.lower() != w:
                return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise EngineError("PARSE_ERROR", f"{' '.join(words).upper()} expected, not {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind == "quoted":
            self.at += 1
            return text[1:-1].replace('""', '"')
        if kind != "name" or text.lower() in RESERVED:
            raise EngineError("PARSE_ERROR", f"a name expected, not {text!r}")
        self.at += 1
        return text

    # Statements.

    def statement(self):
        if self.take("describe"):
            out = Describe(self.name())
        else:
            if self.word() not in ("select", "with"):
                if self.word() in ("insert", "update", "delete", "create", "drop", "alter", "copy", "merge", "truncate", "explain"):
                    raise unsupported(f"{self.word().upper()} statements are not supported")
                raise EngineError("PARSE_ERROR", f"SELECT expected, not {self.peek()[1]!r}")
            out = self.with_query()
        if self.take(";") and self.peek()[0] != "end":
            raise unsupported("one statement at a time")
        if self.peek()[0] != "end":
            if self.word() in ("union", "intersect", "except"):
                raise unsupported("set operations are not supported")
            if self.word() == "window":
                raise unsupported("WINDOW is not supported")
            raise EngineError("PARSE_ERROR", f"unexpected {self.peek()[1]!r}")
        return out

    def with_query(self) -> Select:
        if not self.take("with"):
            return self.select()
        if self.take("recursive"):
            raise unsupported("recursive CTEs are not supported")
        name = self.name()
        self.need("as")
        self.need("(")
        if self.word() != "select":
            raise unsupported("a CTE holds a SELECT")
        body = self.select()
        self.need(")")
        if self.take(","):
            raise unsupported("one CTE at most")
        if body.join or self.has_query(body):
            raise unsupported("a CTE's body reads one table")
        out = self.select()
        if out.join or out.table.name != name:
            raise unsupported("the CTE must be the one table of the query")
        return Select(**{**out.__dict__, "cte": (name, body)})

    def has_query(self, s: Select) -> bool:
        from tarn.sql.run import walk

        roots = [e for e, _ in s.items] + [s.where, s.having]
        return any(isinstance(e, (ScalarQuery, InQuery)) for r in roots if r is not None for e in walk(r))

    def select(self) -> Select:
        self.enter()
        self.need("select")
        distinct = self.take("distinct")
        if distinct and self.take("on"):
            raise unsupported("DISTINCT ON is not supported")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        if not self.take("from"):
            raise unsupported("FROM is needed")
        table = self.table()
        join = self.join(table)
        where = self.expression() if self.take("where") else None
        group, having, orders, limit, offset = [], None, [], None, 0
        if self.take("group", "by"):
            group = [self.column_name("GROUP BY")]
            while self.take(","):
                group.append(self.column_name("GROUP BY"))
        if self.take("having"):
            having = self.expression()
        if self.word() == "window":
            raise unsupported("WINDOW is not supported")
        if self.take("order", "by"):
            orders = [self.order()]
            while self.take(","):
                orders.append(self.order())
        while self.word() in ("limit", "offset"):
            if self.take("limit"):
                limit = self.whole("LIMIT")
            else:
                self.need("offset")
                offset = self.whole("OFFSET")
        self.depth -= 1
        return Select(tuple(items), table, join, where, tuple(group), having, tuple(orders), limit, offset, distinct)

    def item(self) -> tuple[x.Expr, str | None]:
        if self.take("*"):
            if self.word() == "as" or (self.peek()[0] in ("name", "quoted") and self.word() not in RESERVED):
                raise unsupported("* takes no alias")
            return Star(), None
        e = self.expression()
        alias = self.name() if self.take("as") or self.peek()[0] == "quoted" or (self.peek()[0] == "name" and self.word() not in RESERVED) else None
        if alias is None and not isinstance(e, (x.Col, AggCall)):
            raise unsupported("a computed column needs an alias")
        if alias is None and isinstance(e, AggCall):
            alias = e.op if e.arg is None else f"{e.op}_{e.arg.name}" if isinstance(e.arg, x.Col) else None
            if alias is None:
                raise unsupported("an aggregate of an expression needs an alias")
        return e, alias

    def table(self) -> Table:
        if self.take("("):
            raise unsupported("a subquery is no table here")
        name = self.name()
        alias = self.name() if self.take("as") or self.peek()[0] == "quoted" or (self.peek()[0] == "name" and self.word() not in RESERVED) else name
        return Table(name, alias)

    def join(self, left: Table) -> Join | None:
        if self.take(","):
            raise unsupported("tables are joined by JOIN")
        for kind in ("right", "full", "cross", "natural"):
            if self.word() == kind:
                raise unsupported(f"{kind.upper()} JOIN is not supported")
        how = "inner"
        if self.take("left"):
            self.take("outer")
            how = "left"
        elif not self.take("inner") and self.word() != "join":
            return None
        self.need("join")
        right = self.table()
        if self.take("using"):
            self.need("(")
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            self.need(")")
            out = Join(right, how, tuple((n, n) for n in names), tuple(names))
        else:
            self.need("on")
            pairs = []
            for e in x.conjuncts(self.expression()):
                if not (isinstance(e, x.Compare) and e.op == "eq" and isinstance(e.left, x.Col) and isinstance(e.right, x.Col)):
                    raise unsupported("a join condition is an equality of two columns")
                sides = {}
                for c in (e.left.name, e.right.name):
                    alias, dot, column = c.partition(".")
                    if not dot or alias not in (left.alias, right.alias):
                        raise unsupported("join keys are qualified by their table")
                    sides[alias] = column
                if len(sides) != 2:
                    raise unsupported("a join key pair names both tables")
                pairs.append((sides[left.alias], sides[right.alias]))
            out = Join(right, how, tuple(pairs))
        if self.word() in ("join", "inner", "left", "right", "full", "cross", "natural") or self.peek()[1] == ",":
            raise unsupported("two tables at most")
        return out

    def column_name(self, where: str) -> str:
        e = self.expression()
        if not isinstance(e, x.Col):
            raise unsupported(f"{where} takes columns")
        return e.name

    def order(self) -> Order:
        name = self.column_name("ORDER BY")
        descending = self.take("desc") or (self.take("asc") and False)
        nulls = None
        if self.take("nulls"):
            nulls = self.take("first")
            if not nulls:
                self.need("last")
        return Order(name, bool(descending), nulls)

    def whole(self, what: str) -> int:
        negative = self.take("-")
        kind, text = self.peek()
        self.at += 1
        value = self.parameter(text) if kind == "param" else text
        if kind == "number" and text.isdigit():
            value = int(text)
        if negative or not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise type_error(f"{what} takes a whole number of 0 or more")
        return value

    # Expressions, loosest first.

    def enter(self) -> None:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise EngineError("PARSE_ERROR", f"nested more than {MOST_DEPTH} deep")

    def expression(self) -> x.Expr:
        self.enter()
        parts = [self.conjunction()]
        while self.take("or"):
            parts.append(self.conjunction())
        self.depth -= 1
        return parts[0] if len(parts) == 1 else x.or_(*parts)

    def conjunction(self) -> x.Expr:
        parts = [self.negation()]
        while self.take("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else x.and_(*parts)

    def negation(self) -> x.Expr:
        if self.take("not"):
            self.enter()
            inner = self.negation()
            self.depth -= 1
            return x.not_(inner)
        return self.predicate()

    def predicate(self) -> x.Expr:
        left = self.sum()
        while True:
            kind, text = self.peek()
            if kind == "op" and text in COMPARE:
                self.at += 1
                left = x.Compare(COMPARE[text], self.single(left), self.single(self.sum()))
            elif self.take("is"):
                negated = self.take("not")
                self.need("null")
                left = x.NullCheck(self.single(left), negated)
            elif self.word() in ("in", "like", "ilike", "between") or (self.word() == "not" and self.word(1) in ("in", "like", "ilike", "between")):
                negated = self.take("not")
                made = self.suffix(left, negated)
                left = made if isinstance(made, (x.In, InQuery)) or not negated else x.not_(made)
            else:
                return self.single(left)

    def single(self, e) -> x.Expr:
        if isinstance(e, tuple):
            raise unsupported("a row of values stands only before IN")
        return e

    def suffix(self, left, negated: bool) -> x.Expr:
        if self.take("in"):
            self.need("(")
            if self.word() == "select":
                query = self.select()
                self.need(")")
                keys = left if isinstance(left, tuple) else (left,)
                return InQuery(keys, query, negated)
            values = [self.expression()]
            while self.take(","):
                values.append(self.expression())
            self.need(")")
            return x.In(self.single(left), tuple(values), negated)
        if self.take("between"):
            low = self.single(self.sum())
            self.need("and")
            return x.Between(self.single(left), low, self.single(self.sum()))
        insensitive = not self.take("like")
        if insensitive:
            self.need("ilike")
        pattern = self.single(self.sum())
        if not isinstance(pattern, x.Lit) or not isinstance(pattern.value, str):
            raise unsupported("a LIKE pattern is a literal")
        return x.Like(self.single(left), pattern.value, insensitive)

    def sum(self):
        """A sum, or a row of values in parentheses."""
        left = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.peek()[1]
            self.at += 1
            left = x.Arith("add" if op == "+" else "sub", self.single(left), self.single(self.product()))
        if self.peek()[1] in ("^", "||", "::"):
            raise unsupported(f"operator {self.peek()[1]} is not supported")
        return left

    def product(self):
        left = self.unary()
        while self.peek() in (("op", "*"), ("op", "/"), ("op", "%")):
            op = {"*": "mul", "/": "div", "%": "mod"}[self.peek()[1]]
            self.at += 1
            left = x.Arith(op, self.single(left), self.single(self.unary()))
        return left

    def unary(self):
        if self.take("-"):
            self.enter()
            inner = self.single(self.unary())
            self.depth -= 1
            if isinstance(inner, x.Lit) and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool):
                return x.Lit(-inner.value)
            return x.Arith("mul", x.Lit(-1), inner)
        if self.take("+"):
            raise unsupported("unary + is not supported")
        return self.primary()

    def parameter(self, text: str):
        i = int(text[1:])
        if not 1 <= i <= len(self.parameters):
            raise unsupported(f"{text} has no value")
        value = self.parameters[i - 1]
        if not isinstance(value, x.Scalar):
            raise unsupported(f"{text} is not a scalar")
        return value

    def primary(self):
        kind, text = self.peek()
        if kind == "number":
            self.at += 1
            return x.Lit(int(text) if text.isdigit() else float(text))
        if kind == "string":
            self.at += 1
            return x.Lit(text[1:-1].replace("''", "'"))
        if kind == "param":
            self.at += 1
            return x.Lit(self.parameter(text))
        if self.take("("):
            if self.word() == "select":
                query = self.select()
                self.need(")")
                return ScalarQuery(query)
            parts = [self.expression()]
            while self.take(","):
                parts.append(self.expression())
            self.need(")")
            return parts[0] if len(parts) == 1 else tuple(parts)
        for word, value in (("null", None), ("true", True), ("false", False)):
            if self.take(word):
                return x.Lit(value)
        if self.take("case"):
            return self.case()
        if kind == "name" and self.peek(1)[1] == "(" and self.word() not in RESERVED:
            return self.call()
        name = self.name()
        while self.take("."):
            if self.take("*"):
                raise unsupported("qualified * is not supported")
            name += "." + self.name()
        return x.Col(name)

    def case(self) -> x.Expr:
        if self.word() != "when":
            raise unsupported("CASE x WHEN is not supported")
        whens, otherwise = [], None
        while self.take("when"):
            condition = self.expression()
            self.need("then")
            whens.append((condition, self.expression()))
        if self.take("else"):
            otherwise = self.expression()
        self.need("end")
        return x.Case(tuple(whens), otherwise)

    def call(self) -> x.Expr:
        name = self.name().lower()
        self.need("(")
        distinct = self.take("distinct")
        args: list[x.Expr] = []
        star = self.take("*")
        if not star and self.peek()[1] != ")":
            args.append(self.expression())
            while self.take(","):
                args.append(self.expression())
        self.need(")")
        if self.word() in ("over", "filter"):
            raise unsupported(f"{self.word().upper()} is not supported")
        if name not in AGGREGATES:
            if distinct or star:
                raise unsupported(f"{name} takes plain arguments")
            return x.Call(name, tuple(args))
        if distinct and (name != "count" or star or len(args) != 1):
            raise unsupported("DISTINCT is supported in count(DISTINCT x)")
        if star:
            if name != "count":
                raise unsupported(f"{name}(*) is not supported")
            return AggCall("count")
        if name in ("quantile", "quantile_cont"):
            if len(args) != 2 or not isinstance(args[1], x.Lit) or not isinstance(args[1].value, (int, float)) or not 0 <= args[1].value <= 1:
                raise type_error(f"{name} takes a value and a literal from 0 to 1")
            return AggCall("quantile", args[0], False, float(args[1].value))
        if len(args) != 1:
            raise unsupported(f"{name} takes one argument")
        return AggCall("count_distinct" if distinct else name, args[0])


def parse(text: str, parameters: tuple = ()):
    most = sys.getrecursionlimit()
    sys.setrecursionlimit(max(most, 40 * MOST_DEPTH))  # a level of nesting takes about ten calls
    try:
        return Parser(text, parameters).statement()
    finally:
        sys.setrecursionlimit(most)
