"""A read-only subset of Cypher as DataFrame plans.

MATCH and OPTIONAL MATCH with node and relationship patterns, property maps,
WHERE, WITH, RETURN [DISTINCT], aggregates, ORDER BY, SKIP, LIMIT and UNION
[ALL]. A pattern becomes joins on the node and edge tables; Catalyst orders
them and pushes the filters down. Anything that writes is refused.

    run(graph, "MATCH (a:Class)-[r:CALLS]->(b) WHERE r.confidence >= 0.9
                RETURN a.name AS name, count(*) AS n ORDER BY n DESC LIMIT 5")
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph

_TOKEN = re.compile(
    r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+|\d+)|(?P<name>\$?[A-Za-z_][A-Za-z0-9_]*|`[^`]+`)|(?P<op><>|<=|>=|=~|->|<-|\.\.|[-+*/%=<>()\[\]{}.,:|]))""",
    re.DOTALL,
)
_CLAUSES = ("MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "ORDER", "SKIP", "LIMIT", "UNION")
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
_WRITES = re.compile(r"(?i)(?<!:)\b(?:create|delete|detach|set|merge|remove|drop|alter|copy|foreach|install|load)\b")


class CypherError(ValueError):
    pass


@dataclass
class Node:
    name: str
    label: list[str]
    props: dict[str, object]


@dataclass
class Edge:
    name: str
    types: list[str]
    props: dict[str, object]
    direction: str
    low: int = 1
    high: int = 1


@dataclass
class State:
    df: DataFrame | None
    nodes: set[str] = field(default_factory=set)
    edges: set[str] = field(default_factory=set)
    values: set[str] = field(default_factory=set)


class Parser:
    def __init__(self, text: str, params: dict[str, object]):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = re.sub(r"//[^\n]*", "", text).strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if text[at:].strip():
                    raise CypherError(f"unexpected {text[at:at + 12]!r}")
                break
            self.tokens.append((m.lastgroup or "", m[m.lastgroup]))
            at = m.end()
        self.at, self.params, self.fresh = 0, params, 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        for i, w in enumerate(words):
            k = self.at + i
            if k >= len(self.tokens) or self.tokens[k][0] != "name" or self.tokens[k][1].upper() != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.at += len(words)
            return True
        return False

    def op(self, *ops: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            raise CypherError(f"expected {op!r}, found {self.peek()!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or value.startswith("$"):
            raise CypherError(f"expected a name, found {value!r}")
        self.at += 1
        return value.strip("`")

    def literal(self) -> object:
        if self.op("["):
            out = []
            while not self.op("]"):
                out.append(self.literal())
                self.op(",")
            return out
        negative = self.op("-")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "num":
            n = float(value) if "." in value else int(value)
            return -n if negative else n
        low = value.lower()
        if low in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[low]
        if value.startswith("$"):
            if value[1:] not in self.params:
                raise CypherError(f"no parameter {value}")
            return self.params[value[1:]]
        raise CypherError(f"expected a value, found {value!r}")

    def props(self) -> dict[str, object]:
        out: dict[str, object] = {}
        if self.op("{"):
            while not self.op("}"):
                key = self.name()
                self.need(":")
                out[key] = self.literal()
                self.op(",")
        return out

    def _free(self) -> str:
        self.fresh += 1
        return f"_x{self.fresh}"

    def node(self) -> Node:
        self.need("(")
        name = self._free() if self.peek() in (":", ")", "{") else self.name()
        labels = []
        if self.op(":"):
            labels.append(self.name())
            while self.op("|"):
                self.op(":")
                labels.append(self.name())
        n = Node(name, labels, self.props())
        self.need(")")
        return n

    def edge(self) -> Edge:
        left = self.op("<-")
        if not left:
            self.need("-")
        e = Edge(self._free(), [], {}, "both")
        if self.op("["):
            if self.peek() not in (":", "]", "{", "*"):
                e.name = self.name()
            if self.op(":"):
                e.types.append(self.name())
                while self.op("|"):
                    self.op(":")
                    e.types.append(self.name())
            if self.op("*"):
                e.low, e.high = 1, 8
                if self.tokens[self.at][0] == "num":
                    e.low = e.high = int(self.literal())
                if self.op(".."):
                    e.high = int(self.literal()) if self.tokens[self.at][0] == "num" else 8
            e.props = self.props()
            self.need("]")
        right = self.op("->")
        if not right:
            self.need("-")
        e.direction = "both" if left == right else "in" if left else "out"
        return e

    def patterns(self) -> list[list[Node | Edge]]:
        out = []
        while True:
            chain: list[Node | Edge] = [self.node()]
            while self.peek() in ("-", "<-"):
                chain += [self.edge(), self.node()]
            out.append(chain)
            if not self.op(","):
                return out

    # expressions

    def expression(self, s: State) -> Column:
        x = self._and(s)
        while self.take("OR"):
            x = x | self._and(s)
        return x

    def _and(self, s: State) -> Column:
        x = self._not(s)
        while self.take("AND"):
            x = x & self._not(s)
        return x

    def _not(self, s: State) -> Column:
        return ~self._not(s) if self.take("NOT") else self._compare(s)

    def _compare(self, s: State) -> Column:
        x = self._sum(s)
        for op, f in {"=": Column.__eq__, "<>": Column.__ne__, "<=": Column.__le__, ">=": Column.__ge__, "<": Column.__lt__, ">": Column.__gt__}.items():
            if self.op(op):
                return f(x, self._sum(s))
        if self.op("=~"):
            return x.rlike(f"^(?:{self.literal()})$")
        if self.take("STARTS", "WITH"):
            return x.startswith(self._sum(s))
        if self.take("ENDS", "WITH"):
            return x.endswith(self._sum(s))
        if self.take("CONTAINS"):
            return x.contains(self._sum(s))
        if self.take("IN"):
            values = self.literal() if self.peek() == "[" or self.peek().startswith("$") else None
            return x.isin(list(values)) if values is not None else F.array_contains(self._sum(s), x)
        if self.take("IS", "NOT", "NULL"):
            return x.isNotNull()
        if self.take("IS", "NULL"):
            return x.isNull()
        return x

    def _sum(self, s: State) -> Column:
        x = self._product(s)
        while self.peek() in ("+", "-") and self.tokens[self.at][0] == "op":
            x = x + self._product(s) if self.op("+") else x - self._product(s) if self.op("-") else x
        return x

    def _product(self, s: State) -> Column:
        x = self._atom(s)
        while self.peek() in ("*", "/", "%") and self.tokens[self.at][0] == "op":
            op = self.peek()
            self.at += 1
            y = self._atom(s)
            x = x * y if op == "*" else x / y if op == "/" else x % y
        return x

    def _atom(self, s: State) -> Column:
        if self.op("("):
            x = self.expression(s)
            self.need(")")
            return x
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or value.startswith("$") or value.lower() in ("true", "false", "null"):
            v = self.literal()
            return F.array(*(F.lit(i) for i in v)) if isinstance(v, list) else F.lit(v)
        if self.peek(1) == "(":
            return self._call(s)
        name = self.name()
        if self.op("."):
            return F.col(f"{name}__{self.name()}")
        if name in s.nodes:
            return F.col(f"{name}__id")
        if name in s.values:
            return F.col(f"`{name}`")
        raise CypherError(f"unknown name {name}")

    def _call(self, s: State) -> Column:
        f = self.name().lower()
        self.need("(")
        if f in ("labels", "label", "type"):
            n = self.name()
            self.need(")")
            c = F.col(f"{n}__{'type' if f == 'type' else 'label'}")
            if f == "labels" and self.op("["):
                self.literal()
                self.need("]")
            return c
        if f in _AGGREGATES:
            if f == "count" and self.op("*"):
                self.need(")")
                return F.count(F.lit(1))
            distinct = self.take("DISTINCT")
            x = F.struct(*self._struct(s)) if self.peek() == "{" else self.expression(s)
            self.need(")")
            if f == "count":
                return F.countDistinct(x) if distinct else F.count(x)
            if f == "collect":
                return F.sort_array(F.collect_set(x) if distinct else F.collect_list(x))
            g = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[f]
            return g(x)
        args = []
        while not self.op(")"):
            args.append(self.expression(s))
            self.op(",")
        table = {"tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "size": F.char_length, "trim": F.trim, "coalesce": F.coalesce, "abs": F.abs, "round": F.round, "list_contains": F.array_contains, "tostring": lambda x: x.cast("string")}
        if f not in table:
            raise CypherError(f"unknown function {f}")
        return table[f](*args)

    def _struct(self, s: State) -> list[Column]:
        self.need("{")
        out = []
        while not self.op("}"):
            key = self.name()
            self.need(":")
            out.append(self.expression(s).alias(key))
            self.op(",")
        return out


class Compiler:
    def __init__(self, graph: PropertyGraph, text: str, params: dict[str, object] | None = None):
        if _WRITES.search(re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text)):
            raise CypherError("the query would write")
        self.graph = graph
        self.p = Parser(text, params or {})

    def _nodes(self, n: Node) -> DataFrame:
        df = self.graph.nodes
        if n.label:
            df = df.filter(F.col("label").isin(*n.label))
        for k, v in n.props.items():
            df = df.filter(F.col(k).isNull() if v is None else F.col(k) == F.lit(v))
        return df.select(*(F.col(c).alias(f"{n.name}__{c}") for c in df.columns))

    def _edges(self, e: Edge) -> DataFrame:
        df = self.graph.edges
        if e.types:
            df = df.filter(F.col("type").isin(*e.types))
        for k, v in e.props.items():
            df = df.filter(F.col(k) == F.lit(v))
        rest = [c for c in df.columns if c not in ("src", "dst")]
        out = df.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), *(F.col(c).alias(f"{e.name}__{c}") for c in rest))
        back = df.select(F.col("dst").alias("_a"), F.col("src").alias("_b"), *(F.col(c).alias(f"{e.name}__{c}") for c in rest))
        one = out if e.direction == "out" else back if e.direction == "in" else out.unionByName(back)
        if (e.low, e.high) == (1, 1):
            return one
        step = one.select("_a", "_b").distinct()
        paths, found = step, (step if e.low <= 1 else None)
        for k in range(2, e.high + 1):
            paths = paths.select("_a", F.col("_b").alias("_m")).join(step.select(F.col("_a").alias("_m"), "_b"), "_m").select("_a", "_b").distinct()
            if k >= e.low:
                found = paths if found is None else found.unionByName(paths)
        return found.distinct()

    def _chain(self, s: State, chain: list[Node | Edge]) -> State:
        """Joins a chain of nodes and edges to what is bound already."""
        first = chain[0]
        if s.df is None:
            s = State(self._nodes(first), {first.name}, set(), set(s.values))
        elif first.name not in s.nodes:
            shared = [n for n in chain if isinstance(n, Node) and n.name in s.nodes]
            if shared and len(chain) > 1 and chain[-1].name in s.nodes:
                flip = {"in": "out", "out": "in", "both": "both"}
                turned = [Edge(x.name, x.types, x.props, flip[x.direction], x.low, x.high) if isinstance(x, Edge) else x for x in reversed(chain)]
                return self._chain(s, turned)
            s = State(s.df.crossJoin(self._nodes(first)), s.nodes | {first.name}, set(s.edges), set(s.values))
        at = first.name
        for e, n in zip(chain[1::2], chain[2::2]):
            df = s.df.join(self._edges(e).withColumnRenamed("_a", f"{at}__id"), f"{at}__id")
            if n.name in s.nodes:
                df = df.filter(F.col("_b") == F.col(f"{n.name}__id")).drop("_b")
            else:
                df = df.withColumnRenamed("_b", f"{n.name}__id").join(self._nodes(n), f"{n.name}__id")
            s = State(df, s.nodes | {n.name}, s.edges | {e.name}, set(s.values))
            at = n.name
        return s

    def _match(self, s: State, optional: bool) -> State:
        patterns = self.p.patterns()
        if not optional or s.df is None:
            for chain in patterns:
                s = self._chain(s, chain)
            if self.p.take("WHERE"):
                s.df = s.df.filter(self.p.expression(s))
            return s
        keys = [f"{n}__id" for n in sorted(s.nodes)]
        inner = State(s.df.select(*(F.col(f"`{c}`") for c in s.df.columns)), set(s.nodes), set(s.edges), set(s.values))
        for chain in patterns:
            inner = self._chain(inner, chain)
        if self.p.take("WHERE"):
            inner.df = inner.df.filter(self.p.expression(inner))
        new = [c for c in inner.df.columns if c not in s.df.columns]
        found = inner.df.select(*(F.col(f"`{c}`") for c in keys + new)).distinct()
        return State(s.df.join(found, keys, "left"), inner.nodes, inner.edges, set(s.values))

    def _project(self, s: State, last: bool) -> State:
        p = self.p
        distinct = p.take("DISTINCT")
        items: list[tuple[str, Column, bool]] = []
        nodes: set[str] = set()
        while True:
            start = p.at
            only_name = p.tokens[p.at][0] == "name" and (p.peek(1) in ("", ",") or p.peek(1).upper() in ("AS", *_CLAUSES))
            x = p.expression(s)
            text = "".join(t for _, t in p.tokens[start : p.at])
            alias = p.name() if p.take("AS") else text
            calls = any(t.lower() in _AGGREGATES and p.tokens[i + 1][1] == "(" for i, (_, t) in enumerate(p.tokens[:-1]) if start <= i < p.at)
            if only_name and text in s.nodes and not last:
                nodes.add(text if alias == text else alias)
                items += [(f"{alias}__{c.split('__', 1)[1]}", F.col(c), False) for c in s.df.columns if c.startswith(f"{text}__")]
            else:
                items.append((alias, x, calls))
            if not p.op(","):
                break
        if any(a for *_, a in items):
            keys = [x.alias(n) for n, x, a in items if not a]
            grouped = s.df.groupBy(*keys).agg(*(x.alias(n) for n, x, a in items if a))
            df = grouped.select(*(F.col(f"`{n}`") for n, *_ in items))
        else:
            df = s.df.select(*(x.alias(n) for n, x, _ in items))
        values = {n for n, *_ in items if n.split("__")[0] not in nodes}
        out = State(df.distinct() if distinct else df, nodes, set(), values)
        if p.take("WHERE"):
            out.df = out.df.filter(p.expression(out))
        if p.take("ORDER", "BY"):
            keys = []
            while True:
                if p.peek(1) == "." and f"{p.peek()}.{p.peek(2)}" in out.values:
                    x = F.col(f"`{p.peek()}.{p.peek(2)}`")
                    p.at += 3
                else:
                    x = p.expression(out)
                keys.append(x.desc() if p.take("DESC") or p.take("DESCENDING") else (p.take("ASC"), x.asc())[1])
                if not p.op(","):
                    break
            out.df = out.df.orderBy(*keys)
        if p.take("SKIP"):
            out.df = out.df.offset(int(p.literal()))
        if p.take("LIMIT"):
            out.df = out.df.limit(int(p.literal()))
        return out

    def _single(self) -> DataFrame:
        s = State(None)
        p = self.p
        while True:
            if p.take("OPTIONAL", "MATCH"):
                s = self._match(s, True)
            elif p.take("MATCH"):
                s = self._match(s, False)
            elif p.take("WITH"):
                s = self._project(s, False)
            elif p.take("RETURN"):
                return self._project(s, True).df
            else:
                raise CypherError(f"expected a clause, found {p.peek()!r}")

    def compile(self) -> DataFrame:
        out = self._single()
        while self.p.take("UNION"):
            all_ = self.p.take("ALL")
            out = out.unionByName(self._single())
            out = out if all_ else out.distinct()
        if self.p.at < len(self.p.tokens):
            raise CypherError(f"unexpected {self.p.peek()!r}")
        return out


def run(graph: PropertyGraph, text: str, **params: object) -> DataFrame:
    """The result of a query; names are aliases or the expressions' text."""
    return Compiler(graph, text, params).compile()


def markdown(df: DataFrame, limit: int = 100) -> str:
    """The first rows as a Markdown table."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
