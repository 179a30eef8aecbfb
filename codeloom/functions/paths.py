"""Path, route and contract-id columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c, base_name

LANGUAGES = {
    "c": "c", "cbl": "cobol", "cc": "cpp", "cjs": "javascript", "cob": "cobol", "cobol": "cobol", "cpp": "cpp", "cpy": "cobol", "cs": "csharp",
    "cts": "typescript", "cxx": "cpp", "dart": "dart", "gemspec": "ruby", "go": "go", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "java": "java", "js": "javascript", "jsx": "javascript", "kt": "kotlin", "kts": "kotlin", "mjs": "javascript", "mts": "typescript",
    "php": "php", "php3": "php", "php4": "php", "php5": "php", "php8": "php", "phtml": "php", "py": "python", "rake": "ruby", "rb": "ruby",
    "rs": "rust", "swift": "swift", "ts": "typescript", "tsx": "typescript", "vue": "vue",
}
RUBY_FILES = ("Brewfile", "Gemfile", "Guardfile", "Rakefile", "Vagrantfile")


def language_of(path: ColumnOrName) -> Column:
    """Language by extension, or of Ruby's files without one; else null."""
    ext = F.lower(F.regexp_extract(_c(path), r"\.([^.]*)$", 1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, ext), F.when(base_name(path).isin(*RUBY_FILES), "ruby"))


def prefixes(path: ColumnOrName) -> Column:
    """Every leading part of a path, the whole of it last."""
    parts = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def suffixes(path: ColumnOrName) -> Column:
    """Every trailing part of a path, the whole of it first."""
    parts = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def join_relative(base_dir: ColumnOrName, relative: ColumnOrName) -> Column:
    """base_dir/relative with '.' and '..' worked out; '..' at the top is lost."""
    parts = F.filter(F.concat(F.split(_c(base_dir), "/"), F.split(_c(relative), "/")), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def in_package(path: ColumnOrName, suffix: ColumnOrName) -> Column:
    """Whether a file lies directly in a directory that ends in ``suffix``."""
    p, s = F.concat(F.lit("/"), _c(path)), F.concat(F.lit("/"), _c(suffix), F.lit("/"))
    at = F.instr(p, s)
    return (at > 0) & ~F.contains(F.substr(p, at + F.char_length(s)), F.lit("/"))


def _no_groups(path: Column) -> Column:
    return F.regexp_replace(path, r"\([^)]+\)/?", "")


def _unix(path: ColumnOrName) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def next_route(path: ColumnOrName) -> Column:
    """URL of a Next.js API route file (app or pages router), or null."""
    p = _unix(path)
    app = F.regexp_extract(p, r"app/(.+?)/route\.[jt]sx?$", 1)
    bare = _no_groups(app)
    page = F.regexp_extract(p, r"pages/(api/.+?)\.[jt]sx?$", 1)
    found = F.when((app != "") & ((bare == "api") | bare.startswith("api/")), F.concat(F.lit("/"), bare))
    return F.when(app != "", found).when(page != "", F.concat(F.lit("/"), F.regexp_replace(page, "/index$", "")))


def expo_route(path: ColumnOrName) -> Column:
    """URL of an Expo router screen or API file, or null."""
    p = _unix(path)
    inner = F.regexp_extract(p, r"app/(.+)\.[jt]sx?$", 1)
    name = base_name(inner)
    hidden = p.rlike(r"\.d\.tsx?$") | (inner == "") | name.startswith("_") | (name.startswith("+") & ~name.startswith("+api"))
    route = F.concat(F.lit("/"), _no_groups(F.regexp_replace(inner, r"\+api$", "")))
    route = F.when(route == "/index", "/").otherwise(F.regexp_replace(route, "/index$", ""))
    return F.when(~hidden, F.when(route == "", "/").otherwise(route))


def php_route(path: ColumnOrName) -> Column:
    """URL of a PHP file directly served from api/, or null."""
    inner = F.regexp_extract(_unix(path), r"^(api/.+?)\.php$", 1)
    name = base_name(inner)
    helper = name.startswith("_") | name.rlike("(^|_)(bootstrap|config|fixture|helper|mock|setup|test)(_|$)")
    return F.when((inner != "") & ~helper, F.concat(F.lit("/"), inner))


def fetch_url(url: ColumnOrName) -> Column:
    """A fetched URL made comparable with routes; null if it isn't static."""
    u = F.element_at(F.split(_c(url), r"\?"), 1)
    u = F.regexp_replace(u, r"\$\{[^}]+\}", "[param]")
    u = F.regexp_replace(F.regexp_replace(u, "^`|`$", ""), r"\.(aspx?|cgi|jsp|php)$", "")
    return F.when(~u.contains("+") & ~u.contains("(") & u.startswith("/"), u)


def http_path(path: ColumnOrName) -> Column:
    """Trimmed, lower case, without query and final slashes, parameters as {param}."""
    p = F.lower(F.element_at(F.split(F.trim(_c(path)), r"\?"), 1))
    p = F.regexp_replace(p, "/+$", "")
    for pattern in (r":\w+", r"\{[^}]+\}", r"\[[^\]]+\]"):
        p = F.regexp_replace(p, pattern, "{param}")
    return p


def contract_key(id: ColumnOrName) -> Column:
    """Normal form of a contract id by its type."""
    c = _c(id)
    kind, rest = F.substring_index(c, "::", 1), F.substr(c, F.instr(c, "::") + 2)
    method, path = F.substring_index(rest, "::", 1), F.substr(rest, F.instr(rest, "::") + 2)
    slash = F.instr(rest, "/")
    http = F.when(rest.contains("::"), F.concat(F.lit("http::"), F.upper(method), F.lit("::"), F.regexp_replace(path, "/+$", ""))).otherwise(c)
    grpc = (
        F.when(slash > 1, F.concat(F.lower(F.substr(rest, F.lit(1), slash - 1)), F.substr(rest, slash)))
        .when(slash == 1, rest)
        .otherwise(F.lower(rest))
    )
    return (
        F.when(~c.contains("::"), c)
        .when(kind == "http", http)
        .when(kind == "grpc", F.concat(F.lit("grpc::"), grpc))
        .when(kind == "topic", F.concat(F.lit("topic::"), F.lower(F.trim(rest))))
        .when(kind == "lib", F.concat(F.lit("lib::"), F.lower(rest)))
        .otherwise(c)
    )


def segments(url: ColumnOrName) -> Column:
    return F.filter(F.split(_c(url), "/"), lambda s: s != "")


def route_matches(fetch: ColumnOrName, route: ColumnOrName) -> Column:
    """Whether a fetched URL fits a route; [x] on either side fits any segment,
    a final [...x] any number of them."""
    f, r = segments(fetch), segments(route)
    n = F.size(r)
    tail = F.coalesce(F.try_element_at(r, n), F.lit(""))
    rest = tail.startswith("[...") | tail.startswith("[[...")
    wanted = F.when(rest, n - 1).otherwise(n)
    head_f, head_r = F.slice(f, 1, wanted), F.slice(r, 1, wanted)
    fits = F.forall(F.zip_with(head_f, head_r, lambda a, b: a.startswith("[") | b.startswith("[") | (a == b)), lambda x: x)
    long_enough = F.when(rest, F.size(f) >= n - 1).otherwise(F.size(f) == n)
    return long_enough & fits


def reason_keys(reason: ColumnOrName) -> Column:
    """Keys in an edge's reason (|keys:a,b), none if it has none."""
    keys = F.regexp_extract(_c(reason), r"\|keys:([^|]+)", 1)
    return F.filter(F.split(keys, ","), lambda k: k != "")


def reason_fetches(reason: ColumnOrName) -> Column:
    return F.coalesce(F.regexp_extract(_c(reason), r"\|fetches:(\d+)", 1).try_cast("int"), F.lit(1))
