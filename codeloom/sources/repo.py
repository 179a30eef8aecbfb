"""Source trees: scanning, ignoring, folders, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language_of, prefixes
from ..functions.text import base_name, dir_name
from ..schema import MAX_FILE_BYTES

#: Directories, by what makes them, whose files aren't source.
IGNORED_DIRS = frozenset(
    "bower_components eggs env jspm_packages lib64 node_modules parts sdist site-packages vendor venv wheels "  # dependencies
    "__mocks__ __tests__ coverage htmlcov "
    "_build bin build dist obj out output target "
    "cache log logs temp tmp".split()
)
IGNORED_SUFFIXES = tuple(
    ".7z .a .avi .bin .bmp .bz2 .class .dll .doc .docx .dylib .eot .exe .flac .gif .gz .ico .jar .jpeg .jpg .lock .log .map .min.css .min.js .mov .mp3 .mp4 "
    ".o .ogg .otf .pdf .png .pyc .rar .so .sqlite .svg .tar .tiff .ttf .wasm .wav .webm .webp .woff .woff2 .xls .xlsx .xz .zip".split()
)
IGNORED_FILES = frozenset("Cargo.lock Gemfile.lock composer.lock go.sum package-lock.json pnpm-lock.yaml poetry.lock yarn.lock".split())


def ignored(path: Column | str, patterns: list[str] | None = None) -> Column:
    """Hidden, or by directory, suffix or file; patterns are further regexes."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    out = F.exists(parts, lambda x: x.startswith("."))
    out = out | F.arrays_overlap(F.split(F.coalesce(dir_name(p), F.lit("")), "/"), F.array(*(F.lit(d) for d in sorted(IGNORED_DIRS))))
    out = out | F.lower(p).rlike("(" + "|".join(s.replace(".", r"\.") for s in IGNORED_SUFFIXES) + ")$") | base_name(p).isin(*sorted(IGNORED_FILES))
    for x in patterns or []:
        out = out | p.rlike(x)
    return F.coalesce(out, F.lit(True))


def gitignore_regex(line: str) -> str | None:
    """A regex on relative paths for one line of an ignore file, or None."""
    import re

    s = line.strip()
    if not s or s.startswith(("#", "!")):
        return None
    rooted, only_dir = "/" in s.rstrip("/"), s.endswith("/")
    s = s.strip("/")
    body = re.escape(s).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if rooted else "(?:^|/)") + body + ("/" if only_dir else "(?:/|$)")


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """(filePath, size, content, language, modified) of a tree's text files.

    Larger files and ignored ones are dropped before their content is read
    further; unreadable files are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", "^.*?" + base.replace("file://", "").replace(".", r"\.") + "/", "")
    files = files.filter(F.col("length") <= limit).select(rel.alias("filePath"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"))
    return files.filter(~ignored("filePath", patterns)).withColumn("language", language_of("filePath"))


def folder_tree(files: DataFrame) -> DataFrame:
    """(id, label, name, path, parent): every folder and file of the paths."""
    x = files.select("filePath", F.explode(prefixes("filePath")).alias("path")).select("path", (F.col("path") == F.col("filePath")).alias("leaf"))
    x = x.groupBy("path").agg(F.max("leaf").alias("leaf"))
    label = F.when(F.col("leaf"), "File").otherwise("Folder")
    return x.select(F.concat_ws(":", label, "path").alias("id"), label.alias("label"), base_name("path").alias("name"), "path", dir_name("path").alias("parent"))


def contains_edges(tree: DataFrame) -> DataFrame:
    """CONTAINS edges from each folder to what lies in it."""
    p = tree.filter("label = 'Folder'").select(F.col("path").alias("parent"), F.col("id").alias("src"))
    return tree.select(F.col("id").alias("dst"), "parent").join(p, "parent").select("src", "dst", F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of two states (path, hash): added, changed, removed or
    unchanged; one full outer join."""
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full")
    return j.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged").alias("state"))
