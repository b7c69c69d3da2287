"""A SPARQL subset, planned onto DataFrames.

SELECT [DISTINCT] with GROUP BY, aggregates, HAVING, ORDER BY, LIMIT and OFFSET; CONSTRUCT; ASK; groups
of triple patterns, FILTER (comparisons, logic, regex, bound, EXISTS), OPTIONAL, UNION, MINUS, BIND,
VALUES; property paths `^p`, `p/q`, `p|q` and `p+`. Patterns with more constants are joined first.

A variable ?x is two columns while a query is planned: `x`, its text, and `x!`, its kind (`i`, `b` or
`l|datatype|language`), so that a literal never joins an IRI of the same text. Results have the text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.persist import materialise
from ..plans.context import RDF_TYPE, XSD

_TOKEN = re.compile(r"""\s*(?:(?P<iri><[^>\s]*>)|(?P<var>[?$]\w+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w./-]*[\w/-]|[A-Za-z_][\w-]*:|:[\w-]+)|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,*/|^+=<>!@-]))""")
_IRI, _BLANK, _PLAIN = "i", "b", "l||"
_NUMERIC = "^l\\|" + re.escape(XSD) + "(integer|decimal|double|float|long|int)\\|"


def _kind(name: str) -> str:
    return f"{name}!"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _node_kind(c: Column) -> Column:
    return F.when(c.startswith("_:"), _BLANK).otherwise(_IRI)


def _object_kind() -> Column:
    literal = F.concat(F.lit("l|"), F.when(F.col("datatype") != XSD + "string", F.col("datatype")).otherwise(""), F.lit("|"), F.coalesce("lang", F.lit("")))
    literal = F.coalesce(literal, F.concat(F.lit("l||"), F.coalesce("lang", F.lit(""))))
    return F.when(F.col("o_kind") == "literal", literal).when(F.col("o_kind") == "bnode", _BLANK).otherwise(_IRI)


def _visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.endswith("!")]


class Value:
    """An expression: its text or truth, and its kind, each of a frame."""

    def __init__(self, value, kind=None, number: bool = False):
        self.value, self.kind, self.number = value, kind or (lambda df: F.lit(_PLAIN)), number


class Parser:
    def __init__(self, graph, text: str):
        self.graph, self.prefixes = graph, dict(graph.prefixes)
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"SPARQL: cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def is_word(self, *words: str) -> bool:
        return self.peek().upper() in words

    def take(self, what: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or what and self.peek().upper() != what:
            raise ValueError(f"SPARQL: {what or 'more'} expected, not {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def accept(self, what: str) -> bool:
        if self.peek().upper() == what:
            self.at += 1
            return True
        return False

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return text[1:-1]
        if text == "a":
            return RDF_TYPE
        prefix, _, rest = text.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"SPARQL: unknown prefix {prefix!r}")
        return self.prefixes[prefix] + rest

    def term(self) -> tuple[str, str]:
        kind, text = self.take()
        if kind == "var":
            return "var", text[1:]
        if kind == "string":
            datatype = lang = ""
            if self.accept("^^"):
                datatype = self.iri(*self.take())
            elif self.accept("@"):
                lang = self.take()[1]
            datatype = "" if datatype == XSD + "string" else datatype
            return f"l|{datatype}|{lang}", re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "number":
            return f"l|{XSD}{'decimal' if '.' in text else 'integer'}|", text
        return "iri", self.iri(kind, text)

    # Paths: ("iri", x) | ("inv", p) | ("seq", [p]) | ("alt", [p]) | ("plus", p) | ("var", x)
    def path(self):
        parts = [self.sequence()]
        while self.accept("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = [self.step()]
        while self.accept("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def step(self):
        if self.accept("^"):
            return ("inv", self.step())
        if self.accept("("):
            p = self.path()
            self.take(")")
        else:
            p = self.term()
        return ("plus", p) if self.accept("+") else p

    def group(self) -> DataFrame | None:
        self.take("{")
        df: DataFrame | None = None
        triples: list = []
        filters: list = []

        def flush() -> None:
            nonlocal df
            if triples:
                df = natural(df, bgp(self.graph, triples))
                triples.clear()

        while not self.accept("}"):
            if self.is_word("FILTER"):
                self.take()
                filters.append(self.filter())
            elif self.accept("OPTIONAL"):
                flush()
                df = natural(df, self.group(), "left")
            elif self.accept("MINUS"):
                flush()
                df = natural(df, self.group(), "left_anti")
            elif self.accept("BIND"):
                flush()
                self.take("(")
                e = self.expression()
                self.take("AS")
                name = self.take()[1][1:]
                self.take(")")
                df = df.withColumns({name: e.value(df), _kind(name): e.kind(df)})
            elif self.accept("VALUES"):
                flush()
                name = self.take()[1][1:]
                self.take("{")
                values = []
                while not self.accept("}"):
                    kind, text = self.term()
                    values.append((text, _IRI if kind == "iri" else kind))
                df = natural(df, self.graph.df.sparkSession.createDataFrame(values, f"`{name}` string, `{_kind(name)}` string"))
            elif self.peek() == "{":
                flush()
                part = self.group()
                while self.accept("UNION"):
                    part = part.unionByName(self.group(), allowMissingColumns=True)
                df = natural(df, part)
            else:
                s = self.term()
                while True:
                    p = self.path()
                    while True:
                        triples.append((s, p, self.term()))
                        if not self.accept(","):
                            break
                    if not self.accept(";"):
                        break
            self.accept(".")
        flush()
        for f in filters:
            df = f(df)
        return df

    def filter(self):
        negative = self.accept("NOT")
        if self.accept("EXISTS"):
            inner = self.group()
            return lambda df: exists(df, inner, negative)
        e = self.expression() if self.peek() != "(" else self.primary()
        return lambda df: df.where(e.value(df))

    def expression(self) -> Value:
        left = self.conjunction()
        while self.accept("||"):
            a, b = left, self.conjunction()
            left = Value(lambda df, a=a, b=b: a.value(df) | b.value(df))
        return left

    def conjunction(self) -> Value:
        left = self.comparison()
        while self.accept("&&"):
            a, b = left, self.comparison()
            left = Value(lambda df, a=a, b=b: a.value(df) & b.value(df))
        return left

    def comparison(self) -> Value:
        a = self.primary()
        if self.peek() not in ("=", "!=", "<", "<=", ">", ">="):
            return a
        op = self.take()[1]
        b = self.primary()

        def compare(df: DataFrame) -> Column:
            x, y = a.value(df), b.value(df)
            p, q = x.try_cast("double"), y.try_cast("double")
            if a.number or b.number:
                other = b if a.number else a
                p, q = (p, F.when(other.kind(df).startswith("l"), q)) if a.number else (F.when(other.kind(df).startswith("l"), p), q)
                return {"=": p == q, "!=": p != q, "<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op]
            numbers = a.kind(df).rlike(_NUMERIC) & b.kind(df).rlike(_NUMERIC)
            alike = F.when(numbers, p == q).otherwise((x == y) & (a.kind(df) == b.kind(df)))
            if op in ("=", "!="):
                return alike if op == "=" else ~alike
            order = {"<": lambda u, v: u < v, "<=": lambda u, v: u <= v, ">": lambda u, v: u > v, ">=": lambda u, v: u >= v}[op]
            return F.when(numbers, order(p, q)).otherwise(order(x, y))

        return Value(compare)

    def primary(self) -> Value:
        if self.accept("("):
            e = self.expression()
            self.take(")")
            return e
        if self.accept("!"):
            e = self.primary()
            return Value(lambda df: ~e.value(df))
        if self.is_word("BOUND", "REGEX", "STR", "STRSTARTS", "CONTAINS", "LCASE", "UCASE", "STRLEN", "LANG", "DATATYPE", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            name = self.take()[1].upper()
            self.take("(")
            args = [self.expression()]
            while self.accept(","):
                args.append(self.expression())
            self.take(")")
            if name in ("LANG", "DATATYPE"):
                return Value(lambda df: F.split_part(args[0].kind(df), F.lit("|"), F.lit(3 if name == "LANG" else 2)))
            if name.startswith("IS"):
                return Value(lambda df: args[0].kind(df).startswith(name[2].lower() if name != "ISURI" else "i"))
            make = {"BOUND": lambda x: x.isNotNull(), "REGEX": lambda x, y: F.regexp_like(x, y), "STR": lambda x: x, "STRSTARTS": lambda x, y: x.startswith(y), "CONTAINS": lambda x, y: x.contains(y), "LCASE": F.lower, "UCASE": F.upper, "STRLEN": F.char_length}[name]
            return Value(lambda df: make(*(x.value(df) for x in args)), number=name == "STRLEN")
        kind, text = self.term()
        if kind == "var":
            return Value(lambda df: _col(text), lambda df: _col(_kind(text)))
        kind = _IRI if kind == "iri" else kind
        return Value(lambda df: F.lit(text), lambda df: F.lit(kind), number=kind.startswith(f"l|{XSD}"))

    def query(self) -> DataFrame:
        while self.accept("PREFIX"):
            name = self.take()[1]
            self.prefixes[name.rstrip(":")] = self.iri(*self.take())
        if self.accept("ASK"):
            df = self.group()
            return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if self.accept("CONSTRUCT"):
            return self.construct()
        self.take("SELECT")
        distinct, names, aggregates = self.accept("DISTINCT"), [], []
        while not self.is_word("WHERE", "{"):
            if self.accept("*"):
                continue
            if self.accept("("):
                aggregates.append(self.aggregate())
                names.append(aggregates[-1][0])
            else:
                names.append(self.take()[1][1:])
        self.accept("WHERE")
        df = self.group()
        if self.accept("GROUP"):
            self.take("BY")
            by = []
            while self.peek()[:1] in "?$" and self.peek():
                by.append(self.take()[1][1:])
            df = df.groupBy(*by, *map(_kind, by)).agg(*(c for _, c in aggregates))
        elif aggregates:
            df = df.agg(*(c for _, c in aggregates))
        if self.accept("HAVING"):
            condition = self.primary()
            # An aggregate is a number, or text.
            for name, _ in aggregates:
                df = df.withColumn(_kind(name), F.lit(f"l|{XSD}double|") if df.schema[name].dataType.typeName() != "string" else F.lit(_PLAIN))
            df = df.where(condition.value(df))
        order = []
        if self.accept("ORDER"):
            self.take("BY")
            while self.peek() and not self.is_word("LIMIT", "OFFSET"):
                down = self.is_word("DESC")
                if self.is_word("ASC", "DESC"):
                    self.take()
                    self.take("(")
                c = F.col(self.take()[1][1:])
                self.accept(")")
                order.append(c.desc() if down else c.asc())
        names = names or _visible(df)
        if distinct:
            df = df.select(*names, *(k for k in map(_kind, names) if k in df.columns)).distinct()
        if order:
            df = df.orderBy(*order)
        df = df.select(*names)
        for _ in range(2):
            if self.accept("LIMIT"):
                df = df.limit(int(self.take()[1]))
            elif self.accept("OFFSET"):
                df = df.offset(int(self.take()[1]))
        return df

    def aggregate(self) -> tuple[str, Column]:
        kind = self.take()[1].upper()
        self.take("(")
        distinct = self.accept("DISTINCT")
        name = None if self.accept("*") else self.take()[1][1:]
        c = _col(name) if name else F.lit(1)
        self.take(")")
        self.take("AS")
        out_name = self.take()[1][1:]
        self.take(")")
        number = c.try_cast("double") if kind in ("SUM", "AVG") else c
        out = F.count_distinct(c, *([_col(_kind(name))] if name else [])) if kind == "COUNT" and distinct else {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "SAMPLE": F.min, "GROUP_CONCAT": lambda x: F.array_join(F.sort_array(F.collect_list(x)), " ")}[kind](number)
        return out_name, out.alias(out_name)

    def construct(self) -> DataFrame:
        self.take("{")
        template = []
        while not self.accept("}"):
            template.append((self.term(), self.term(), self.term()))
            self.accept(".")
        self.take("WHERE")
        df = self.group()

        def value(t: tuple) -> tuple[Column, Column]:
            return (_col(t[1]), _col(_kind(t[1]))) if t[0] == "var" else (F.lit(t[1]), F.lit(_IRI if t[0] == "iri" else t[0]))

        def triple(s: tuple, p: tuple, o: tuple) -> Column:
            (text, kind), part = value(o), lambda k: F.nullif(F.split_part(value(o)[1], F.lit("|"), F.lit(k)), F.lit(""))
            o_kind = F.when(kind.startswith("l"), "literal").when(kind == _BLANK, "bnode").otherwise("iri")
            made = F.struct(value(s)[0].alias("s"), value(p)[0].alias("p"), text.alias("o"), o_kind.alias("o_kind"), part(2).alias("datatype"), part(3).alias("lang"))
            # What isn't bound, or a literal where none may stand, makes no triple.
            return F.when(value(s)[0].isNotNull() & value(p)[0].isNotNull() & text.isNotNull() & ~value(s)[1].startswith("l") & (value(p)[1] == _IRI), made)

        rows = F.array_compact(F.array(*(triple(*t) for t in template)))
        return df.select(F.explode(rows).alias("t")).select("t.*").distinct()


_EDGE = ["s", "s!", "o", "o!"]


def _ends(t: DataFrame) -> DataFrame:
    return t.select("s", _node_kind(F.col("s")).alias("s!"), "o", _object_kind().alias("o!"))


def _edges(graph, path, start: Column | None = None) -> DataFrame:
    """s and o of a path, with their kinds. start: a condition on s that a transitive path begins with."""
    kind, what = path
    if kind == "iri":
        return _ends(graph.scan(what))
    if kind == "inv":
        return _edges(graph, what).select(F.col("o").alias("s"), F.col("o!").alias("s!"), F.col("s").alias("o"), F.col("s!").alias("o!"))
    if kind == "alt":
        return reduce(DataFrame.unionByName, (_edges(graph, p) for p in what))
    if kind == "seq":
        out = _edges(graph, what[0])
        for p in what[1:]:
            out = _step(out, _edges(graph, p))
        return out
    edges = materialise(_edges(graph, what).distinct())
    seen = front = edges if start is None else edges.where(start)
    # Rounds end when no new edge is found; each is written, so that none runs again.
    while not front.isEmpty():
        front = materialise(_step(front, edges).distinct().join(seen, _EDGE, "left_anti"))
        seen = seen.unionByName(front)
    return seen


def _step(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.withColumnsRenamed({"s": "_m", "s!": "_m!", "o": "_o", "o!": "_o!"})
    met = a.join(b, (_col("o") == _col("_m")) & (_col("o!") == _col("_m!")))
    return met.select("s", "s!", F.col("_o").alias("o"), _col("_o!").alias("o!"))


def pattern(graph, s, p, o) -> DataFrame:
    """One pattern: its variables as columns; constants become filters on the scan."""
    if p[0] == "var":
        df = graph.df.select("s", _node_kind(F.col("s")).alias("s!"), F.col("p").alias("_p"), F.lit(_IRI).alias("_p!"), "o", _object_kind().alias("o!"))
    else:
        df = _edges(graph, p, F.col("s") == s[1] if s[0] == "iri" else None)
    first: dict[str, str] = {}
    for c, t in (("s", s), ("_p", p), ("o", o)):
        if c == "_p" and p[0] != "var":
            continue
        if t[0] != "var":
            df = df.where((F.col(c) == t[1]) & (_col(_kind(c)) == (_IRI if t[0] == "iri" else t[0])))
        elif t[1] in first:
            df = df.where((_col(first[t[1]]) == _col(c)) & (_col(_kind(first[t[1]])) == _col(_kind(c))))
        else:
            first[t[1]] = c
    return df.select(*(x for v, c in first.items() for x in (_col(c).alias(v), _col(_kind(c)).alias(_kind(v)))))


def bgp(graph, triples: list) -> DataFrame:
    """Patterns joined from those with most constants on, connected ones first."""
    bound = lambda t: sum(x[0] != "var" for x in (t[0], t[2]))
    left, out, have = sorted(triples, key=bound, reverse=True), None, set()
    while left:
        names = lambda t: {x[1] for x in t if x[0] == "var"}
        t = next((t for t in left if names(t) & have), left[0])
        left.remove(t)
        out = natural(out, pattern(graph, *t))
        have |= names(t)
    return out


def natural(a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the variables of both, by text and kind. Without any: each with each (inner), each with each or none (left), a as it is (left_anti, of MINUS)."""
    if a is None:
        return b
    on = [c for c in b.columns if c in a.columns]
    if on:
        return a.join(b, on, how)
    if how == "left_anti":
        return a
    return a.join(b, F.lit(True), how)


def exists(a: DataFrame, b: DataFrame, negative: bool) -> DataFrame:
    """The rows of a for which b has a row, or has none; without common variables b as a whole decides."""
    on = [c for c in b.columns if c in a.columns]
    how = "left_anti" if negative else "left_semi"
    if on:
        return a.join(b, on, how)
    return a.join(F.broadcast(b.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), how)  # one row


def run(graph, text: str) -> DataFrame:
    return Parser(graph, text).query()
