"""Definitions, imports, calls and heritage of source files.

Python is read with its own parser; other languages with regular expressions
that know their declarations, which finds top-level structure but not every
nested form. ``extract`` runs in Arrow batches and gives long tables.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

SCHEMA = "filePath string, record string, name string, owner string, line int, endLine int, label string, target string, args int, required int, exported boolean, extra string"
Row = dict


def _row(path: str, record: str, name: str, **more) -> Row:
    base = dict.fromkeys(("owner", "line", "endLine", "label", "target", "args", "required", "exported", "extra"))
    return {"filePath": path, "record": record, "name": name, **base, **more}


def python_rows(path: str, text: str) -> list[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[Row] = []

    def dotted(n: ast.AST) -> str | None:
        parts = []
        while isinstance(n, ast.Attribute):
            parts.append(n.attr)
            n = n.value
        return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else None

    def visit(body: list[ast.stmt], owner: str | None, cls: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                rows.append(_row(path, "def", n.name, owner=owner, line=n.lineno, endLine=n.end_lineno, label="Class", exported=not n.name.startswith("_")))
                for b in n.bases:
                    if d := dotted(b):
                        rows.append(_row(path, "heritage", n.name, target=d.split(".")[-1], line=n.lineno, extra="extends"))
                visit(n.body, n.name, True)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = n.args
                names = [x.arg for x in a.posonlyargs + a.args]
                skip = 1 if cls and names[:1] in (["self"], ["cls"]) else 0
                variadic = a.vararg or a.kwarg
                rows.append(
                    _row(
                        path, "def", n.name, owner=owner, line=n.lineno, endLine=n.end_lineno, label="Method" if cls else "Function",
                        args=None if variadic else len(names) - skip + len(a.kwonlyargs), required=max(0, len(names) - skip - len(a.defaults)), exported=not n.name.startswith("_"),
                        extra=ast.unparse(n.returns) if n.returns else None,
                    )
                )
                calls(n, n.name)
                visit([x for x in n.body if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))], n.name, False)
            elif isinstance(n, ast.Import):
                rows.extend(_row(path, "import", x.asname or x.name, target=x.name, line=n.lineno, extra="module") for x in n.names)
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                rows.extend(_row(path, "import", x.asname or x.name, target=base, line=n.lineno, extra=x.name) for x in n.names)
            elif cls and isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                rows.append(_row(path, "def", n.target.id, owner=owner, line=n.lineno, endLine=n.end_lineno, label="Property", exported=True, extra=ast.unparse(n.annotation)))
            else:
                calls(n, owner)

    def calls(n: ast.AST, owner: str | None) -> None:
        for x in ast.walk(n):
            if isinstance(x, ast.Call) and (d := dotted(x.func)):
                head, _, last = d.rpartition(".")
                form = "member" if head else "constructor" if last[:1].isupper() else "free"
                rows.append(_row(path, "call", last, owner=owner, line=x.lineno, target=head or None, args=len(x.args) + len(x.keywords), extra=form))
            elif isinstance(x, (ast.Assign, ast.AugAssign)):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, ast.Attribute) and (d := dotted(t.value)):
                        rows.append(_row(path, "write", t.attr, owner=owner, line=x.lineno, target=d))

    visit(tree.body, None, False)
    return rows


_W = r"[A-Za-z_$][\w$]*"
#: By language: (label, pattern); the groups are name, and bases where there are any.
DEFINITIONS = {
    "javascript": [
        ("Class", rf"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+({_W})(?:\s+extends\s+([\w$.]+))?"),
        ("Function", rf"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*({_W})"),
        ("Function", rf"^\s*(?:export\s+)?const\s+({_W})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_W})\s*(?::[^=]+)?=>"),
        ("Interface", rf"^\s*(?:export\s+)?interface\s+({_W})(?:\s+extends\s+([\w$., ]+))?"),
        ("Enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+({_W})"),
        ("TypeAlias", rf"^\s*(?:export\s+)?type\s+({_W})\s*[=<]"),
    ],
    "java": [
        ("Class", rf"^\s*(?:(?:public|protected|private|abstract|final|static)\s+)*class\s+({_W})[^{{\n]*?(?:\s+extends\s+([\w.]+))?"),
        ("Interface", rf"^\s*(?:(?:public|protected|private|static)\s+)*interface\s+({_W})(?:\s+extends\s+([\w., ]+))?"),
        ("Enum", rf"^\s*(?:(?:public|protected|private)\s+)*enum\s+({_W})"),
        ("Record", rf"^\s*(?:public\s+)?record\s+({_W})"),
        ("Method", rf"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized|override|virtual|async)\s+)+[\w<>\[\], .?]+\s+({_W})\s*\("),
    ],
    "go": [("Function", rf"^func\s+({_W})\s*\("), ("Method", rf"^func\s+\([^)]*\)\s*({_W})\s*\("), ("Struct", rf"^type\s+({_W})\s+struct"), ("Interface", rf"^type\s+({_W})\s+interface")],
    "rust": [
        ("Function", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+({_W})"),
        ("Method", rf"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+({_W})"),
        ("Struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+({_W})"),
        ("Enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+({_W})"),
        ("Trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+({_W})"),
        ("Impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?({_W})"),
    ],
    "ruby": [("Class", r"^\s*class\s+([A-Z]\w*)(?:\s*<\s*([\w:]+))?"), ("Module", r"^\s*module\s+([A-Z]\w*)"), ("Method", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)")],
    "php": [("Class", rf"^\s*(?:abstract\s+|final\s+)?class\s+({_W})(?:\s+extends\s+([\w\\]+))?"), ("Interface", rf"^\s*interface\s+({_W})"), ("Trait", rf"^\s*trait\s+({_W})"), ("Function", rf"^\s*(?:(?:public|private|protected|static)\s+)*function\s+({_W})")],
    "c": [("Struct", rf"^\s*(?:typedef\s+)?struct\s+({_W})"), ("Class", rf"^\s*class\s+({_W})(?:\s*:\s*(?:public|private|protected)\s+([\w:]+))?"), ("Function", rf"^[A-Za-z_][\w\s*&:<>]*?\s[*&]?({_W})\s*\([^;]*\)\s*(?:const\s*)?\{{"), ("Macro", rf"^#define\s+({_W})")],
    "swift": [("Class", rf"^\s*(?:\w+\s+)*class\s+({_W})(?:\s*:\s*([\w, ]+))?"), ("Struct", rf"^\s*(?:\w+\s+)*struct\s+({_W})"), ("Interface", rf"^\s*(?:\w+\s+)*protocol\s+({_W})"), ("Function", rf"^\s*(?:\w+\s+)*func\s+({_W})")],
    "dart": [("Class", rf"^\s*(?:abstract\s+)?class\s+({_W})(?:\s+extends\s+([\w]+))?"), ("Function", rf"^\s*[\w<>?]+\s+({_W})\s*\([^)]*\)\s*(?:async\s*)?\{{")],
    "kotlin": [("Class", rf"^\s*(?:(?:data|open|abstract|sealed|internal|public|private)\s+)*class\s+({_W})"), ("Interface", rf"^\s*(?:\w+\s+)*interface\s+({_W})"), ("Function", rf"^\s*(?:(?:override|suspend|private|public|internal|inline)\s+)*fun\s+(?:[\w<>.]+\.)?({_W})")],
}
DEFINITIONS["typescript"] = DEFINITIONS["vue"] = DEFINITIONS["javascript"]
DEFINITIONS["csharp"] = DEFINITIONS["java"]
DEFINITIONS["cpp"] = DEFINITIONS["c"]
IMPORTS = {
    "javascript": [r"""import\s+(?:[^'"]*?from\s+)?<S>""", r"""require\(\s*<S>\s*\)"""],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.*]+)"], "kotlin": [r"^\s*import\s+([\w.*]+)"], "csharp": [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"],
    "go": [r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"'], "rust": [r"^\s*(?:pub\s+)?use\s+([^;]+);", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;"],
    "ruby": [r"""^\s*require(?:_relative)?\s+<S>"""], "php": [r"^\s*use\s+([\w\\]+)", r"""(?:require|include)(?:_once)?\s*\(?\s*<S>"""],
    "c": [r'^\s*#include\s*[<"]([^>"]+)[>"]'], "swift": [r"^\s*import\s+(\w+)"], "dart": [r"""^\s*import\s+<S>"""],
}
_MARKS = "[\"']"
IMPORTS = {k: [p.replace("<S>", _MARKS + "([^\"']+)" + _MARKS) for p in v] for k, v in IMPORTS.items()}
IMPORTS |= {"typescript": IMPORTS["javascript"], "vue": IMPORTS["javascript"], "cpp": IMPORTS["c"]}
_CALL = re.compile(rf"(?:({_W})\s*(?:\.|->|::)\s*)?({_W})\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function sizeof typeof await new super constructor elif unless until fn func def fun class match in not and or else do try with".split())


def is_exported(language: str, name: str, line: str) -> bool:
    """By the language's rule: a leading capital, underscore or keyword."""
    if language == "go":
        return name[:1].isupper()
    if language in ("python", "dart"):
        return not name.startswith("_")
    if language in ("javascript", "typescript", "vue"):
        return bool(re.match(r"\s*export\b", line))
    if language == "rust":
        return bool(re.match(r"\s*pub\b", line))
    if language in ("java", "csharp"):
        return bool(re.search(r"\bpublic\b", line))
    if language in ("kotlin", "swift", "php"):
        return not re.search(r"\b(?:private|internal|fileprivate|protected)\b", line)
    if language in ("c", "cpp"):
        return not re.match(r"\s*static\b", line)
    return True


def regex_rows(path: str, language: str, text: str) -> list[Row]:
    rows: list[Row] = []
    lines = text.split("\n")
    defs: list[tuple[int, str, str]] = []
    for label, pattern in DEFINITIONS.get(language, []):
        for m in re.finditer(pattern, text, re.MULTILINE):
            line = text.count("\n", 0, m.start(1)) + 1
            if any(d[0] == line for d in defs):
                continue
            defs.append((line, m[1], label))
            if m.re.groups > 1 and m[2]:
                rows += [_row(path, "heritage", m[1], target=b.strip().split(".")[-1], line=line, extra="extends") for b in m[2].split(",") if b.strip()]
    for pattern in IMPORTS.get(language, []):
        rows += [_row(path, "import", m[1].split("/")[-1], target=m[1], line=text.count("\n", 0, m.start()) + 1, extra="module") for m in re.finditer(pattern, text, re.MULTILINE)]
    defs.sort()
    owner = None
    for i, (line, name, label) in enumerate(defs):
        end = defs[i + 1][0] - 1 if i + 1 < len(defs) else len(lines)
        if label in ("Class", "Struct", "Interface", "Trait", "Impl", "Module"):
            owner = name
        inner = label == "Method" or (label == "Function" and lines[line - 1][:1].isspace())
        m = re.search(rf"{re.escape(name)}[^(\n]*\(([^)]*)\)", lines[line - 1]) if label in ("Function", "Method") else None
        args = len([a for a in m[1].split(",") if a.strip() and a.strip() not in ("self", "&self", "&mut self")]) if m else None
        rows.append(_row(path, "def", name, owner=owner if inner else None, line=line, endLine=end, label="Method" if inner and label == "Function" and owner else label, args=args, required=args, exported=is_exported(language, name, lines[line - 1])))
        if label in ("Function", "Method"):
            for k in range(line, end):
                for c in _CALL.finditer(lines[k]):
                    if c[2] not in _KEYWORDS:
                        form = "member" if c[1] else "constructor" if re.search(rf"\bnew\s+{re.escape(c[2])}\s*\(", lines[k]) else "free"
                        rows.append(_row(path, "call", c[2], owner=name, line=k + 1, target=c[1], extra=form))
    return rows


def file_rows(path: str, language: str | None, text: str) -> list[Row]:
    if not text or not language:
        return []
    if language == "python":
        return python_rows(path, text)
    if language == "cobol":
        from .cobol import cobol_rows

        return cobol_rows(path, text)
    if language == "vue":
        text = "\n".join(re.findall(r"<script[^>]*>(.*?)</script>", text, re.DOTALL))
    return regex_rows(path, language, text)


def extract(files: DataFrame) -> DataFrame:
    """Records (``SCHEMA``) of files (filePath, language, content)."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, lang, t in zip(f["filePath"], f["language"], f["content"]) for r in file_rows(p, lang, t)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("line", "endLine", "args", "required"):
                out[c] = out[c].astype("Int32")
            out["exported"] = out["exported"].astype("boolean")
            yield out

    return files.select("filePath", "language", "content").mapInPandas(run, SCHEMA)


def to_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and DEFINES, HAS_METHOD, HAS_PROPERTY edges of the definitions."""
    d = records.filter("record = 'def'")
    label = F.when(F.col("label") == "Impl", "Class").otherwise(F.col("label"))
    qualified = F.concat_ws(".", "owner", "name")
    tail = F.when(F.col("args").isNotNull() & F.col("label").isin("Method"), F.concat(F.lit("#"), F.col("args").cast("string"))).otherwise("")
    nodes = d.select(F.concat(label, F.lit(":"), "filePath", F.lit(":"), qualified, tail).alias("id"), label.alias("label"), "name", "filePath", F.col("line").alias("startLine"), "endLine", F.col("exported").alias("isExported"), "owner", F.col("args").alias("parameterCount"), "required", F.col("extra").alias("returnType"))
    nodes = nodes.dropDuplicates(["id"])
    edge = lambda src, dst, t: (src.alias("src"), dst.alias("dst"), F.lit(t).alias("type"), F.lit(1.0).alias("confidence"))
    defines = nodes.select(*edge(F.concat(F.lit("File:"), "filePath"), F.col("id"), "DEFINES"))
    owners = nodes.filter(F.col("label").isin("Class", "Interface", "Struct", "Trait", "Module")).select(F.col("id").alias("oid"), F.col("name").alias("owner"), "filePath")
    inner = nodes.filter("owner is not null").join(owners, ["owner", "filePath"])
    member = inner.select(F.col("oid").alias("src"), F.col("id").alias("dst"), F.when(F.col("label") == "Property", "HAS_PROPERTY").otherwise("HAS_METHOD").alias("type"), F.lit(1.0).alias("confidence"))
    return nodes, defines.unionByName(member)
