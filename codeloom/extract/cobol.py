"""COBOL and JCL by regular expressions: programs, sections, paragraphs, data,
calls, copies and job steps; COPY expansion with REPLACING."""

from __future__ import annotations

import re

_NAME = r"[A-Z0-9][A-Z0-9-]*"
DEPTH = 10


def logical_lines(text: str) -> list[tuple[int, str]]:
    """(number, code) without sequence areas, comments and continuation marks."""
    out: list[tuple[int, str]] = []
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip("\r")
        fixed = len(line) > 6 and (line[:6].strip() == "" or line[:6].isdigit())
        mark = line[6:7] if fixed else ""
        if mark in ("*", "/", "D", "d") or line.lstrip().startswith("*>"):
            continue
        code = line[7:72] if fixed else line
        code = re.sub(r"\*>.*$", "", code)
        if mark == "-" and out:
            number, before = out[-1]
            out[-1] = (number, before.rstrip() + code.strip().lstrip("'\""))
        elif code.strip():
            out.append((n, code.rstrip()))
    return out


def parse_replacing(clause: str) -> list[tuple[str, str, str]]:
    """(kind, from, to) of a REPLACING clause; kind is exact, leading or trailing."""
    token = r"==(.*?)==|'([^']*)'|\"([^\"]*)\"|(\S+)"
    out = []
    for m in re.finditer(rf"(?:(LEADING|TRAILING)\s+)?(?:{token})\s+BY\s+(?:{token})", clause, re.IGNORECASE):
        a = next((x for x in m.groups()[1:5] if x is not None), "").strip()
        b = next((x for x in m.groups()[5:9] if x is not None), "").strip()
        out.append(((m[1] or "exact").lower(), a, b))
    return out


def expand_copies(text: str, books: dict[str, str], depth: int = DEPTH, seen: tuple[str, ...] = ()) -> str:
    """The text with COPY statements replaced by their books, at most ``depth``
    deep; unknown and recursive books stay as they are."""

    def put(m: re.Match) -> str:
        name = m[1].strip("'\"").upper()
        if name not in books or name in seen or depth <= 0:
            return m[0]
        body = books[name]
        for kind, a, b in parse_replacing(m[2] or ""):
            word = re.escape(a)
            pattern = rf"(?<![\w-]){word}(?![\w-])" if kind == "exact" and re.fullmatch(r"[\w-]+", a) else word if kind == "exact" else rf"(?<![\w-]){word}(?=[\w-])" if kind == "leading" else rf"(?<=[\w-]){word}(?![\w-])"
            body = re.sub(pattern, lambda _: b, body, flags=re.IGNORECASE)
        return expand_copies(body, books, depth - 1, (*seen, name))

    return re.sub(rf"\bCOPY\s+('?\"?{_NAME}'?\"?)(?:\s+REPLACING\s+(.*?))?\s*\.", put, text, flags=re.IGNORECASE | re.DOTALL)


def cobol_rows(path: str, text: str) -> list[dict]:
    from .source import _row

    rows: list[dict] = []
    program = section = paragraph = None
    division = ""
    for n, code in logical_lines(text):
        up = code.upper()
        if m := re.search(rf"\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION", up):
            division = m[1]
            if division == "PROCEDURE":
                section = paragraph = None
        if m := re.search(rf"\bPROGRAM-ID\s*\.\s*'?\"?({_NAME})", up):
            program = m[1]
            rows.append(_row(path, "def", program, line=n, label="Module", exported=True))
        for m in re.finditer(rf"\bCOPY\s+'?\"?({_NAME})", up):
            rows.append(_row(path, "import", m[1], target=m[1], line=n, extra="copy"))
        if division == "DATA":
            if m := re.match(rf"\s*(\d\d)\s+({_NAME})\b(.*)", up):
                pic = re.search(r"\bPIC(?:TURE)?(?:\s+IS)?\s+(\S+?)\.?(?:\s|$)", m[3])
                rows.append(_row(path, "def", m[2], owner=program, line=n, label="Property", exported=False, extra=f"{m[1]} {pic[1]}" if pic else m[1]))
            if m := re.match(rf"\s*[FS]D\s+({_NAME})", up):
                rows.append(_row(path, "def", m[1], owner=program, line=n, label="CodeElement", exported=False, extra="file"))
        if division != "PROCEDURE":
            continue
        if m := re.match(rf"\s{{0,4}}({_NAME})\s+SECTION\s*\.", up):
            section, paragraph = m[1], None
            rows.append(_row(path, "def", section, owner=program, line=n, label="Namespace", exported=False))
        elif (m := re.match(rf"\s{{0,3}}({_NAME})\s*\.\s*$", up)) and m[1] not in ("EXIT", "GOBACK", "END-IF", "END-PERFORM", "CONTINUE"):
            paragraph = m[1]
            rows.append(_row(path, "def", paragraph, owner=section or program, line=n, label="Function", exported=False))
        at = paragraph or section or program
        for m in re.finditer(r"\bCALL\s+['\"]([^'\"]+)['\"]", up):
            rows.append(_row(path, "call", m[1], owner=at, line=n, extra="program"))
        for m in re.finditer(rf"\bCALL\s+({_NAME})", up):
            rows.append(_row(path, "call", m[1], owner=at, line=n, extra="dynamic"))
        for m in re.finditer(rf"\bPERFORM\s+({_NAME})(?:\s+THR(?:OUGH|U)\s+({_NAME}))?", up):
            if m[1] not in ("UNTIL", "VARYING", "TIMES", "WITH"):
                rows.append(_row(path, "call", m[1], owner=at, line=n, target=m[2], extra="perform"))
        for m in re.finditer(rf"\bGO\s+TO\s+({_NAME})", up):
            rows.append(_row(path, "call", m[1], owner=at, line=n, extra="goto"))
        for m in re.finditer(rf"\bCANCEL\s+['\"]?({_NAME})", up):
            rows.append(_row(path, "call", m[1], owner=at, line=n, extra="cancel"))
        for m in re.finditer(rf"\bMOVE\s+({_NAME}|'[^']*'|\"[^\"]*\")\s+TO\s+({_NAME})", up):
            rows.append(_row(path, "write", m[2], owner=at, line=n, target=m[1]))
        if m := re.search(r"\bEXEC\s+(SQL|CICS|DLI)\b\s*(.*?)(?:END-EXEC|$)", up):
            body = re.search(rf"\b(?:FROM|INTO|UPDATE|TABLE|PROGRAM|TRANSID)\s*\(?\s*'?({_NAME})", m[2])
            rows.append(_row(path, "call", body[1] if body else m[2].split(" ")[0], owner=at, line=n, extra=f"exec-{m[1].lower()}"))
    return rows


def resolve_programs(calls, programs):
    """Calls (src, name, kind) of programs (name, id): (src, dst, confidence);
    unknown targets keep a made-up id. 0.95, cancelled programs 0.9."""
    from pyspark.sql import functions as F

    p = programs.groupBy("name").agg(F.min("id").alias("id"))
    j = calls.join(p, "name", "left")
    return j.select("src", F.coalesce("id", F.concat(F.lit("<unresolved>:"), "name")).alias("dst"), F.when(F.col("kind") == "cancel", 0.9).otherwise(0.95).alias("confidence"))


def jcl_rows(path: str, text: str) -> list[dict]:
    """Jobs, steps, the programs and procedures they run, data sets, includes."""
    from .source import _row

    rows: list[dict] = []
    job = step = None
    joined = re.sub(r",[ \t]*\n//[ \t]+", ",", text)
    for n, line in enumerate(joined.split("\n"), 1):
        if not line.startswith("//") or line.startswith("//*"):
            continue
        m = re.match(r"//(\S*)\s+(JOB|EXEC|DD|PROC|INCLUDE|SET|PEND)\b\s*(.*)", line)
        if not m:
            continue
        name, kind, rest = m[1], m[2], m[3]
        if kind == "JOB":
            job = name
            rows.append(_row(path, "def", name, line=n, label="CodeElement", exported=True, extra="jcl-job"))
        elif kind == "PROC":
            rows.append(_row(path, "def", name, owner=job, line=n, label="CodeElement", exported=True, extra="jcl-proc"))
        elif kind == "EXEC":
            step = name
            rows.append(_row(path, "def", name, owner=job, line=n, label="CodeElement", exported=False, extra="jcl-step"))
            pgm = re.search(r"\bPGM=([\w$#@]+)", rest)
            proc = re.search(r"\bPROC=([\w$#@]+)|^([\w$#@]+)(?:,|\s|$)", rest)
            if pgm:
                rows.append(_row(path, "call", pgm[1], owner=step, line=n, extra="jcl-program"))
            elif proc:
                rows.append(_row(path, "call", proc[1] or proc[2], owner=step, line=n, extra="jcl-proc"))
        elif kind == "DD" and (d := re.search(r"\bDSN(?:AME)?=([^,\s]+)", rest)):
            rows.append(_row(path, "write" if re.search(r"DISP=\(?(?:NEW|MOD)", rest) else "read", d[1], owner=step, line=n, target=name))
        elif kind == "INCLUDE" and (d := re.search(r"MEMBER=([\w$#@]+)", rest)):
            rows.append(_row(path, "import", d[1], target=d[1], line=n, extra="jcl-include"))
    return rows
