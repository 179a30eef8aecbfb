"""Web code: fetches, routes, tools, ORM calls, response shapes, middleware,
message topics and RPC contracts.

What a single expression can say is a column function; nested forms are read
in Arrow batches by ``records``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


_MARKS = "[\"']"
_QUOTED = {"<S>": _MARKS + "([^\"']+)" + _MARKS, "<E>": _MARKS + "([^\"']*)" + _MARKS, "<W>": _MARKS + "(\\w+)" + _MARKS}


def _re(pattern: str) -> str:
    """A pattern with <S>, <E>, <W> spelt out: a quoted string, one that may be
    empty, a quoted word; each is a group."""
    for short, long in _QUOTED.items():
        pattern = pattern.replace(short, long)
    return pattern


def _all(content: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col(content), F.lit(_re(pattern)), F.lit(group))


def fetch_calls(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, url) of fetch, axios and similar calls and of form actions."""
    pattern = r"""(?:\bfetch|\baxios(?:\.\w+)?|\$\.(?:get|post|ajax)|\bhttp\.(?:get|post|put|delete))\(\s*(['"`][^'"`]+['"`])"""
    form = r"""<form[^>]*\baction\s*=\s*["'](/[^"']*)["']"""
    urls = F.concat(F.transform(_all(content, pattern), lambda u: F.regexp_replace(u, "^['\"]|['\"]$", "")), _all(content, form))
    return files.select("file", F.explode(urls).alias("url")).distinct()


def accessed_keys(content: str = "content") -> Column:
    """Keys read of a response: data.x, { x } = await r.json(), result['x']."""
    dotted = _all(content, r"\b(?:data|result|response|json|body|payload)\??\.([A-Za-z_]\w*)")
    index = _all(content, r"""\b(?:data|result|response|json|body|payload)\[<W>\]""")
    destructured = F.flatten(F.transform(_all(content, r"(?:const|let|var)\s*\{([^{}]*)\}\s*=\s*await\s+\w+\.json\(\)"), lambda g: F.transform(F.split(g, ","), lambda k: F.trim(F.element_at(F.split(k, ":"), 1)))))
    own = ["json", "then", "catch", "map", "filter", "length", "forEach", "ok", "status", "headers", "text", "find", "reduce", "push", "join", "slice", "some", "every"]
    return F.array_sort(F.array_distinct(F.filter(F.concat(dotted, index, destructured), lambda k: (k != "") & ~k.isin(*own))))


def orm_calls(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, orm, model, method) of Prisma and Supabase calls."""
    def found(orm: str, pattern: str) -> DataFrame:
        hit = F.explode(_all(content, pattern, 0)).alias("hit")
        x = files.select("file", hit)
        return x.select("file", F.lit(orm).alias("orm"), F.regexp_extract("hit", _re(pattern), 1).alias("model"), F.regexp_extract("hit", _re(pattern), 2).alias("method"))

    prisma = found("prisma", r"\bprisma\.(\w+)\.(find\w*|create\w*|update\w*|delete\w*|upsert|count|aggregate|groupBy)\s*\(")
    supabase = found("supabase", r"""\bsupabase(?:\.\w+)*\.from\(\s*<W>\s*\)\s*\.(delete|insert|select|update|upsert)\s*\(""")
    return prisma.unionByName(supabase).distinct()


def tool_definitions(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, name, description) of tool lists: files named for tools that
    hold input schemas; the first file of a name wins."""
    pattern = r"""name:\s*['"]([\w-]+)['"]\s*,\s*description:\s*(?:\n\s*)?[`'"]([^`'"]*)"""
    x = files.filter(F.lower("file").contains("tool") & F.col(content).contains("inputSchema")).select("file", F.explode(_all(content, pattern, 0)).alias("hit"))
    x = x.select("file", F.regexp_extract("hit", _re(pattern), 1).alias("name"), F.left(F.regexp_extract("hit", _re(pattern), 2), F.lit(200)).alias("description"))
    return x.groupBy("name").agg(F.min_by("description", "file").alias("description"), F.min("file").alias("file")).select("file", "name", "description")


TOPICS = (
    ("kafka", "producer", r"""\.send\(\s*\{\s*topic:\s*<S>"""),
    ("kafka", "consumer", r"""\.subscribe\(\s*\{\s*topics?:\s*\[?\s*<S>"""),
    ("kafka", "consumer", r"""@KafkaListener\([^)]*topics\s*=\s*\{?\s*"([^"]+)\""""),
    ("kafka", "producer", r"""(?:kafkaTemplate|producer)\.send\(\s*<S>"""),
    ("kafka", "consumer", r"""KafkaConsumer\(\s*<S>"""),
    ("rabbitmq", "producer", r"""\.(?:sendToQueue|publish|basic_publish)\(\s*(?:exchange=)?<S>"""),
    ("rabbitmq", "consumer", r"""\.(?:consume|basic_consume)\(\s*(?:queue=)?<S>"""),
    ("rabbitmq", "consumer", r"""@RabbitListener\([^)]*queues\s*=\s*\{?\s*"([^"]+)\""""),
    ("nats", "producer", r"""\bn(?:c|ats)\.[Pp]ublish\(\s*<S>"""),
    ("nats", "consumer", r"""\bn(?:c|ats)\.[Ss]ubscribe\(\s*<S>"""),
)


def topic_contracts(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, contractId, role, broker): producers provide, consumers consume."""
    out = None
    for broker, role, pattern in TOPICS:
        x = files.select("file", F.explode(_all(content, pattern)).alias("topic"))
        x = x.select("file", F.concat(F.lit("topic::"), F.lower(F.trim("topic"))).alias("contractId"), F.lit("provider" if role == "producer" else "consumer").alias("role"), F.lit(broker).alias("broker"))
        out = x if out is None else out.unionByName(x)
    return out.distinct()


def grpc_rows(path: str, text: str) -> list[tuple[str, str, str]]:
    """(contractId, role, name) of .proto services and of stubs in code."""
    out = []
    if path.endswith(".proto"):
        package = re.search(r"^[ \t]*package\s+([\w.]+)", text, re.MULTILINE)
        for m in re.finditer(r"\bservice\s+(\w+)\s*\{(.*?)\n\}", text, re.DOTALL):
            full = f"{package[1]}.{m[1]}" if package else m[1]
            out += [(f"grpc::{full.lower()}/{r}", "provider", r) for r in re.findall(r"\brpc\s+(\w+)\s*\(", m[2])]
    for pattern, role in (
        (r"\bRegister(\w+)Server\(", "provider"), (r"\bNew(\w+)Client\(", "consumer"), (r"\bextends\s+(\w+)Grpc\.\w+ImplBase", "provider"), (r"\b(\w+)Grpc\.new\w*Stub\(", "consumer"),
        (r"\badd_(\w+)Servicer_to_server\(", "provider"), (r"\b\w+_pb2_grpc\.(\w+)Stub\(", "consumer"), (r"@GrpcMethod\(\s*<W>", "provider"), (r"\.getService<\w+>\(\s*<W>", "consumer"),
    ):
        out += [(f"grpc::{m.lower()}", role, m) for m in re.findall(_re(pattern), text)]
    return list(dict.fromkeys(out))


def _block(text: str, at: int) -> str:
    """The {...} that begins at or after a place."""
    start = text.find("{", at)
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return text[start + 1 : i]
    return ""


def top_keys(body: str) -> list[str]:
    """Keys of an object literal's own level."""
    out, depth, part = [], 0, ""
    for c in body + ",":
        depth += {"{": 1, "[": 1, "(": 1, "}": -1, "]": -1, ")": -1}.get(c, 0)
        if c == "," and depth == 0:
            m = re.match(r"\s*(?:['\"]([\w-]+)['\"]|([A-Za-z_]\w*))\s*(?::|$)", part)
            if m:
                out.append(m[1] or m[2])
            part = ""
        else:
            part += c
    return out


def response_shapes(text: str) -> tuple[list[str], list[str]]:
    """Keys of success and of error responses: a status of 400 or more, in the
    call's options or before it, makes an error."""
    good: list[str] = []
    bad: list[str] = []
    for m in re.finditer(r"(?:\bNextResponse|\bResponse|\bres(?:\.status\((\d+)\))?)\.json\(\s*(?=\{)", text):
        body = _block(text, m.end() - 1)
        after = text[m.end() + len(body) : m.end() + len(body) + 80]
        status = int(m[1]) if m[1] else int(s[1]) if (s := re.match(r"[^;)]*?status\s*:\s*(\d+)", after)) else 200
        (bad if status >= 400 else good).extend(top_keys(body))
    for m in re.finditer(r"json_encode\(\s*\[(.*?)\]\s*\)", text, re.DOTALL):
        keys = re.findall(_re(r"<W>\s*=>"), m[1])
        code = re.findall(r"http_response_code\((\d+)\)", text[: m.start()])
        (bad if code and int(code[-1]) >= 400 else good).extend(keys)
    return list(dict.fromkeys(good)), list(dict.fromkeys(bad))


def middleware_chain(text: str) -> list[str]:
    """Names of wrappers around an exported handler, the outermost first; one
    wrapper counts only where its name begins with 'with'."""
    m = re.search(r"export\s+(?:default\s+|const\s+(?:GET|POST|PUT|PATCH|DELETE)\s*=\s*)((?:[A-Za-z_]\w*\()+)", text)
    names = re.findall(r"([A-Za-z_]\w*)\(", m[1]) if m else []
    names = [n for n in names if n not in ("async", "function")]
    return names if len(names) >= 2 or names and re.match(r"with[A-Z]", names[0]) else []


def laravel_routes(text: str) -> list[tuple[str, str, str]]:
    """(method, path, handler) of Laravel routes with group prefixes and
    resource routes spelt out."""
    out: list[tuple[str, str, str]] = []

    def walk(part: str, prefix: str) -> None:
        at = 0
        for m in re.finditer(_re(r"Route::(?:middleware\([^)]*\)\s*->\s*)?prefix\(\s*<E>\s*\)[^;{]*?->group\("), part):
            if m.start() < at:
                continue
            body = _block(part, m.end())
            single(part[at : m.start()], prefix)
            walk(body, f"{prefix}/{m[1].strip('/')}")
            at = part.find(body, m.end()) + len(body)
        single(part[at:], prefix)

    def single(part: str, prefix: str) -> None:
        join = lambda p: "/" + "/".join(x for x in f"{prefix}/{p}".split("/") if x)
        for m in re.finditer(_re(r"Route::(get|post|put|patch|delete|any)\(\s*<E>\s*,\s*(\[?[^)]*)"), part):
            out.append((m[1].upper(), join(m[2]), m[3].strip()))
        for m in re.finditer(_re(r"Route::(?:api)?[Rr]esource\(\s*<E>\s*,\s*(\w+)"), part):
            one = join(m[1]) + "/{" + m[1].rstrip("s").split("/")[-1] + "}"
            out.extend([("GET", join(m[1]), f"{m[2]}@index"), ("POST", join(m[1]), f"{m[2]}@store"), ("GET", one, f"{m[2]}@show"), ("PUT", one, f"{m[2]}@update"), ("DELETE", one, f"{m[2]}@destroy")])

    walk(text, "")
    return out


def decorator_routes(text: str) -> list[tuple[str, str]]:
    """(method, path) of route decorators and annotations."""
    out = [(m[1].upper(), m[2]) for m in re.finditer(_re(r"@\w*\.?(get|post|put|patch|delete)\(\s*<E>"), text, re.IGNORECASE)]
    out += [("GET" if not m[2] else m[2].upper(), m[1]) for m in re.finditer(_re(r"@\w+\.route\(\s*<S>(?:[^)]*methods\s*=\s*\[\s*<W>)?"), text)]
    out += [(m[1].upper(), m[2]) for m in re.finditer(r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"", text)]
    return list(dict.fromkeys(out))


SCHEMA = "file string, kind string, name string, value string"


def records(files: DataFrame) -> DataFrame:
    """(file, kind, name, value) of what needs more than one expression:
    response and error keys, middleware, Laravel and decorator routes, gRPC."""
    ship(files.sparkSession)

    def of(path: str, text: str) -> list[tuple[str, str, str, str]]:
        good, bad = response_shapes(text)
        out = [(path, "response", k, "") for k in good] + [(path, "error", k, "") for k in bad]
        out += [(path, "middleware", n, str(i)) for i, n in enumerate(middleware_chain(text))]
        out += [(path, "route", p, m) for m, p, _ in laravel_routes(text)] + [(path, "route", p, m) for m, p in decorator_routes(text)]
        return out + [(path, f"grpc-{role}", cid, name) for cid, role, name in grpc_rows(path, text)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["file"], f["content"]) for r in of(p, t or "")], columns=["file", "kind", "name", "value"])

    return files.select("file", "content").mapInPandas(run, SCHEMA)


def vue_components(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, component) of PascalCase tags in templates, confidence 0.9."""
    template = F.regexp_extract(content, r"(?s)<template[^>]*>(.*)</template>", 1)
    return files.select("file", F.explode(F.array_distinct(F.regexp_extract_all(template, F.lit(r"<([A-Z]\w*)"), F.lit(1)))).alias("component"), F.lit(0.9).alias("confidence"))
