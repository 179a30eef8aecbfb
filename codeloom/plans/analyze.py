"""From a source tree to a stored graph, end to end.

Scan, extract, resolve, link, cluster, trace and store; each stage is a
DataFrame of the last ones, with checkpoints between those that are read more
than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.markdown import links as markdown_links
from ..extract.source import extract, to_graph
from ..operators import community, mro, process, resolve
from ..operators.graph import PropertyGraph
from ..operators.traverse import traces
from ..session import checkpoint
from ..sources.graph_store import GraphStore
from ..sources.repo import contains_edges, folder_tree, scan

NODE_COLUMNS = ("id", "label", "name", "filePath", "startLine", "endLine", "isExported", "content", "returnType", "parameterCount", "size")
_KIND = {"id": "string", "label": "string", "name": "string", "filePath": "string", "startLine": "int", "endLine": "int", "isExported": "boolean", "content": "string", "returnType": "string", "parameterCount": "int", "size": "long"}


def _nodes(df: DataFrame) -> DataFrame:
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(_KIND[c]).alias(c) for c in NODE_COLUMNS))


def _edges(df: DataFrame, src: str, dst: str, type: Column, confidence: Column, reason: Column | None = None, step: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.col(src).alias("src"), F.col(dst).alias("dst"), type.alias("type"), confidence.cast("double").alias("confidence"),
        (none if reason is None else reason).cast("string").alias("reason"), (none if step is None else step).cast("int").alias("step"),
    )


def import_path(language: Column, target: Column) -> Column:
    """An import as a path: dots, double colons and backslashes are slashes; a
    Python module's leading dots are directories."""
    dots = F.char_length(F.regexp_extract(target, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(target, r"^\.*", ""), F.lit("."), F.lit("/"))
    python = F.when(dots == 0, rest).otherwise(F.concat(F.when(dots == 1, "./").otherwise(F.repeat(F.lit("../"), dots - 1)), rest))
    return (
        F.when(language == "python", python)
        .when(language.isin("java", "kotlin", "csharp"), F.replace(F.regexp_replace(target, r"\.\*$", ""), F.lit("."), F.lit("/")))
        .when(language == "rust", F.regexp_replace(F.replace(target, F.lit("::"), F.lit("/")), r"^(?:crate|self|super)/|/?\{.*$", ""))
        .when(language == "php", F.replace(target, F.lit("\\"), F.lit("/")))
        .otherwise(target)
    )


def resolve_imports(records: DataFrame, files: DataFrame) -> DataFrame:
    """(file, local, source, exported): imports with the file they mean."""
    imp = records.filter("record = 'import'").join(files.select("filePath", "language"), "filePath")
    base = import_path(F.col("language"), F.col("target"))
    member = F.when((F.col("extra") != "module") & (F.col("extra") != "copy"), F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.col("extra")))
    tried = F.filter(F.array(F.struct(F.lit(0).alias("rank"), member.alias("path")), F.struct(F.lit(1).alias("rank"), F.regexp_replace(base, "/$", "").alias("path"))), lambda x: x["path"].isNotNull() & (x["path"] != ""))
    x = imp.select(F.col("filePath").alias("from_file"), "name", "extra", F.explode(tried).alias("t")).select("from_file", "name", "extra", "t.rank", "t.path")
    x = checkpoint(x.withColumn("import_id", F.concat_ws("|", "from_file", "name", "extra", "path")).distinct())
    known = files.select(F.col("filePath").alias("file")).withColumn("seq", F.col("file"))
    hit = resolve.resolve_relative(x, known).unionByName(resolve.resolve_suffix(x.filter("path not like '.%'"), known))
    found = x.join(hit, "import_id")
    best = found.withColumn("_b", F.min("rank").over(_per("from_file", "name", "extra"))).filter("rank = _b")
    return best.select(F.col("from_file").alias("file"), F.col("name").alias("local"), F.col("file").alias("source"), F.when(F.col("rank") == 1, F.col("extra")).otherwise("*").alias("exported")).distinct()


def _per(*keys: str):
    from pyspark.sql import Window as W

    return W.partitionBy(*keys)


def build(spark: SparkSession, root: str, patterns: list[str] | None = None) -> PropertyGraph:
    files = checkpoint(scan(spark, root, patterns))
    records = checkpoint(extract(files))
    tree = folder_tree(files)
    symbols, defined = to_graph(records)
    symbols = checkpoint(symbols)
    s = symbols.select("id", "name", F.col("filePath").alias("file"), F.col("label").alias("type"), F.col("parameterCount").alias("parameters"), "required", "owner", F.col("isExported").alias("exported"))
    file_id = lambda c: F.concat(F.lit("File:"), c)

    imports = checkpoint(resolve_imports(records, files))
    targets = imports.select("file", F.col("source").alias("target")).distinct()
    edges = [contains_edges(tree).select("src", "dst", "type", "confidence", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("step"))]
    edges.append(_edges(defined, "src", "dst", F.col("type"), F.col("confidence")))
    edges.append(_edges(targets.filter("file <> target").select(file_id(F.col("file")).alias("src"), file_id(F.col("target")).alias("dst")), "src", "dst", F.lit("IMPORTS"), F.lit(1.0)))
    md = markdown_links(files.filter(F.lower("filePath").endswith(".md")), "filePath")
    edges.append(_edges(md.select(file_id(F.col("filePath")).alias("src"), file_id(F.col("target")).alias("dst")), "src", "dst", F.lit("IMPORTS"), F.lit(0.8)))

    # calls
    calls = records.filter("record = 'call'").withColumn("ref", F.concat_ws("|", "filePath", "line", "owner", "name", "target", "args"))
    refs = checkpoint(calls.select("ref", F.col("filePath").alias("file"), "name", "args", F.col("extra").alias("form"), F.col("owner").alias("caller")).dropDuplicates(["ref"]))
    named = resolve.apply_named_imports(imports.filter("exported not in ('*', 'module')"))
    hits = resolve.resolve_names(refs.select("ref", "file", "name"), s, targets, named=named)
    about = s.select(F.col("id").alias("symbol"), "type", "parameters", "required", F.col("file").alias("def_file"))
    cand = hits.join(about, "symbol").join(refs.select("ref", "args", "form"), "ref").withColumnRenamed("def_file", "file")
    called = checkpoint(resolve.resolve_calls(cand))
    here = s.filter(F.col("type").isin(*resolve.CALLABLE)).groupBy("file", F.col("name").alias("caller")).agg(F.min("id").alias("caller_id"))
    src = refs.join(here, ["file", "caller"], "left").select("ref", F.coalesce("caller_id", file_id(F.col("file"))).alias("src"))
    found = called.join(src, "ref").filter("src <> symbol").groupBy("src", "symbol").agg(F.max("confidence").alias("c"))
    edges.append(_edges(found, "src", "symbol", F.lit("CALLS"), F.col("c")))

    # inheritance
    h = records.filter("record = 'heritage'").select(F.col("name").alias("cls"), F.col("filePath").alias("file"), F.col("target").alias("parent"), F.col("extra").alias("kind"))
    up = checkpoint(resolve.heritage(h, s.filter(F.col("type").isin("Class", "Interface", "Struct", "Trait"))))
    edges.append(_edges(up, "child", "parent", F.col("type"), F.col("confidence")))
    parents = up.select(F.col("child").alias("src"), F.col("parent").alias("dst"), "type", F.lit(0).alias("ord"))
    owned = defined.filter("type = 'HAS_METHOD'").join(symbols.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("owner"), "name", F.col("dst").alias("method"))
    won = mro.overrides(parents, owned, parents.select(F.col("src").alias("id")).distinct())
    edges.append(_edges(won, "root", "method", F.lit("METHOD_OVERRIDES"), F.col("confidence")))

    # communities and flows
    base = _nodes(tree.withColumnRenamed("path", "filePath").join(files.select("filePath", "content", "size"), "filePath", "left")).unionByName(_nodes(symbols))
    linked = edges[0]
    for e in edges[1:]:
        linked = linked.unionByName(e)
    linked = checkpoint(linked.distinct())
    pairs = checkpoint(community.clustering_graph(base, linked))
    member = checkpoint(community.communities(pairs))
    named_c = community.labels(member, base).join(community.cohesion(pairs, member), "community")
    cid = F.concat(F.lit("comm_"), "community")
    nodes = base.unionByName(_nodes(named_c.select(cid.alias("id"), F.lit("Community").alias("label"), F.col("label").alias("name"), F.col("size").cast("long").alias("size"))))
    kept = member.join(named_c.select("community"), "community").select("id", cid.alias("dst"))
    linked = linked.unionByName(_edges(kept, "id", "dst", F.lit("MEMBER_OF"), F.lit(1.0), F.lit("local-moving")))
    strong = linked.filter("type = 'CALLS' and confidence >= 0.5").select("src", "dst", (-F.col("confidence")).alias("rank"))
    code = base.filter(F.col("label").isin("Function", "Method"))
    starts = process.entry_points(code, strong)
    chosen = checkpoint(process.select_traces(traces(strong, starts.select("id")), code.count()))
    rows, steps = process.process_rows(chosen, base, member)
    nodes = nodes.unionByName(_nodes(rows.select(F.col("process").alias("id"), F.lit("Process").alias("label"), F.col("label").alias("name"), F.col("type").alias("returnType"), F.col("steps").cast("long").alias("size"))))
    linked = linked.unionByName(_edges(steps, "id", "process", F.lit("STEP_IN_PROCESS"), F.lit(1.0), F.lit("trace"), F.col("step")))
    return PropertyGraph(checkpoint(nodes.dropDuplicates(["id"])), checkpoint(linked))


def analyze(spark: SparkSession, root: str, store: str, commit: str = "", patterns: list[str] | None = None) -> dict:
    """Builds and stores the graph of a tree; nothing if the stored one is of
    the same commit. The new version's metadata."""
    target = GraphStore(spark, store)
    if target.up_to_date(commit):
        return target.meta() or {}
    return target.write(build(spark, root, patterns), commit)


def register_views(graph: PropertyGraph, prefix: str = "") -> None:
    """Temporary views for SQL: nodes, edges, communities, processes, steps."""
    graph.nodes.createOrReplaceTempView(f"{prefix}nodes")
    graph.edges.createOrReplaceTempView(f"{prefix}edges")
    graph.label("Community").createOrReplaceTempView(f"{prefix}communities")
    graph.label("Process").createOrReplaceTempView(f"{prefix}processes")
    graph.typed(["STEP_IN_PROCESS"]).createOrReplaceTempView(f"{prefix}steps")
