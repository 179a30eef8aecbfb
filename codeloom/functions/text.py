"""Text columns: cleaning, escaping, snippets, tokens, names and predicates.

All are built-in expressions, so they stay in the JVM and in code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize(x: ColumnOrName) -> Column:
    """Unix line ends; no control characters but tab and newline, no U+FFFE/F."""
    unix = F.replace(F.replace(_c(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(unix, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFE\\uFFFF]", "")


def csv_field(x: ColumnOrName) -> Column:
    return F.concat(F.lit('"'), F.replace(sanitize(F.coalesce(_c(x), F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_number(x: ColumnOrName, missing: int = -1) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(str(missing)))


def is_binary(x: ColumnOrName) -> Column:
    """More than a tenth of the first 1000 characters are control characters."""
    head = F.left(_c(x), F.lit(1000))
    left = F.regexp_replace(head, "[\\x00-\\x08\\x0E-\\x1F\\x7F]", "")
    return F.coalesce((F.char_length(head) - F.char_length(left)) > F.char_length(head) * 0.1, F.lit(False))


def lines(x: ColumnOrName) -> Column:
    return F.split(_c(x), "\n")


def snippet(content: ColumnOrName, start: ColumnOrName, end: ColumnOrName, margin: int = 2, most: int = 5000) -> Column:
    """Lines start - margin to end + margin (0-based), cut at ``most``."""
    n = F.size(lines(content))
    first = F.greatest(F.lit(0), _c(start) - margin)
    last = F.least(n - 1, _c(end) + margin)
    text = F.array_join(F.slice(lines(content), first + 1, F.greatest(F.lit(0), last - first + 1)), "\n")
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n... [truncated]"))).otherwise(text)


def file_slice(content: ColumnOrName, start: int, end: int) -> Column:
    """Lines start to end, 0-based and inclusive."""
    return F.array_join(F.slice(lines(content), start + 1, end - start + 1), "\n")


def clean_code(x: ColumnOrName) -> Column:
    """Unix line ends, at most one blank line, no spaces at line ends."""
    unix = F.replace(_c(x), F.lit("\r\n"), F.lit("\n"))
    dense = F.regexp_replace(unix, "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(dense, "[ \t]+(\n|$)", "$1"), "^[ \t\n]+|[ \t\n]+$", "")


def truncate_words(x: ColumnOrName, most: int) -> Column:
    """At most so many characters and '...', at a space in the last fifth if there is one."""
    text = _c(x)
    head = F.left(text, F.lit(most))
    space = F.char_length(head) - F.coalesce(F.nullif(F.instr(F.reverse(head), " "), F.lit(0)), F.char_length(head) + 1)
    cut = F.when(space > most * 0.8, F.left(head, space.cast("int"))).otherwise(head)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def base_name(path: ColumnOrName) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dir_name(path: ColumnOrName) -> Column:
    parts = F.split(_c(path), "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def embedding_text(label: ColumnOrName, name: ColumnOrName, path: ColumnOrName, content: ColumnOrName, most: int = 500) -> Column:
    """What is embedded of a node; files show at most 300 characters."""
    kind, text = _c(label), clean_code(content)
    body = lambda n: F.when(F.coalesce(_c(content), F.lit("")) != "", F.concat(F.lit("\n\n"), truncate_words(text, n))).otherwise("")
    folder = F.when(dir_name(path) != "", F.concat(F.lit("\nDirectory: "), dir_name(path))).otherwise("")
    symbol = F.concat(kind, F.lit(": "), _c(name), F.lit("\nFile: "), base_name(path), folder, body(most))
    whole = F.concat(F.lit("File: "), _c(name), F.lit("\nPath: "), _c(path), body(min(most, 300)))
    other = F.concat(kind, F.lit(": "), _c(name), F.lit("\nPath: "), _c(path))
    return F.when(kind == "File", whole).when(kind.isin("Function", "Class", "Method", "Interface"), symbol).otherwise(other)


def tokens(x: ColumnOrName) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more."""
    return F.filter(F.split(F.lower(_c(x)), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 1)


def fingerprint(x: ColumnOrName) -> Column:
    return F.left(F.sha2(_c(x), 256), F.lit(16))


def capitalize(x: ColumnOrName) -> Column:
    return F.concat(F.upper(F.left(_c(x), F.lit(1))), F.substr(_c(x), F.lit(2)))


def sanitize_id(x: ColumnOrName) -> Column:
    """For ids: other than letters and digits become _, 20 characters, lower case."""
    return F.lower(F.left(F.regexp_replace(_c(x), "[^a-zA-Z0-9]", "_"), F.lit(20)))


def slugify(x: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-|-$", "")


def common_prefix(low: ColumnOrName, high: ColumnOrName) -> Column:
    """Common prefix of two strings (of all strings, given their min and max)."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(_c(low)))), lambda i: F.left(_c(low), i) == F.left(_c(high), i))
    n = F.size(F.filter(same, lambda s: s))
    return F.when(F.char_length(_c(low)) == 0, "").otherwise(F.left(_c(low), n))


def make_id(label: ColumnOrName, name: ColumnOrName) -> Column:
    return F.concat_ws(":", _c(label), _c(name))


def repo_suffix(path: ColumnOrName) -> Column:
    """Six characters of the URL-safe base64 of a path, for equal names."""
    return F.left(F.translate(F.base64(F.encode(_c(path), "UTF-8")), "+/", "-_"), F.lit(6))


_WRITE_WORDS = ("ALTER", "COPY", "CREATE", "DELETE", "DETACH", "DROP", "FOREACH", "INSTALL", "LOAD", "MERGE", "REMOVE", "SET")


def is_write_query(x: ColumnOrName) -> Column:
    """A writing keyword that isn't a label (after a colon)."""
    return F.coalesce(_c(x).rlike(r"(?i)(?<!:)\b(" + "|".join(_WRITE_WORDS) + r")\b"), F.lit(False))


def _path_test(x: ColumnOrName, contains: list[str], ends: list[str]) -> Column:
    p = F.lower(F.replace(_c(x), F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for s in contains:
        out = out | p.contains(s)
    for s in ends:
        out = out | p.endswith(s)
    return F.coalesce(out, F.lit(False))


_COMMON = [f"/{d}/" for d in ("testing", "tests", "test")] + ["__mocks__/", "__tests__/", ".spec.", ".test."]
#: Substrings and endings by predicate: impact filter, entry points, web tools.
TEST_PATHS = {
    "impact": (_COMMON + ["/conftest.", "/fixtures/", "/spec/", "/test_"], [f"_{k}.{e}" for e, k in (("rb", "test"), ("rb", "spec"), ("py", "test"), ("go", "test"))]),
    "entry": (
        _COMMON + ["/test_", "/spec/", "/testproject/", "uitests/", ".unittests/", ".integrationtests/", ".test/", ".tests/"],
        [f"{k}.{e}" for e in ("swift", "cs") for k in ("test", "tests")] + ["spec.php", "test.php"] + [f"_{k}.{e}" for e, k in (("rb", "test"), ("rb", "spec"), ("py", "test"), ("go", "test"))],
    ),
    "web": (["__mocks__", "__tests__", ".spec.", ".test."], []),
}


def is_test_path(x: ColumnOrName, kind: str = "impact") -> Column:
    return _path_test(x, *TEST_PATHS[kind])
