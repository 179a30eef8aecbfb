"""Text and path function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators.graph import first_by
from ..operators.tools import grep, rename_preview
from ..sources.tables import fetches, part_nodes, routes, table, with_
from .registry import query

_CTRL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
_SAN = f"regexp_replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{_CTRL}', '', 'g')"
_DIRTY = "(select doc_id, text || chr(13) || chr(10) || 'a' || chr(7) || '\"q\"' || chr(13) || 'z' as x from documents)"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat("text", F.lit("\r\na\x07\"q\"\rz"))
    return table(spark, d, "documents").select("doc_id", x.alias("x"))


@query("sanitize_text", f"select doc_id, md5({_SAN}) as digest from {_DIRTY}")
def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("doc_id", F.md5(T.sanitize("x").cast("binary")).alias("digest"))


@query("csv_escape", f"select doc_id, md5('\"' || replace({_SAN}, '\"', '\"\"') || '\"') as digest, coalesce(cast(nullif(doc_id % 3, 0) as varchar), '-1') as num from {_DIRTY}")
def csv_escape(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("doc_id", F.md5(T.csv_field("x").cast("binary")).alias("digest"), T.csv_number(F.nullif(F.col("doc_id") % 3, F.lit(0))).alias("num"))


@query(
    "binary_flag",
    "select doc_id, (length(h) - length(regexp_replace(h, '[\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g'))) > length(h) * 0.1 as bin from (select doc_id, left(case when doc_id % 4 = 0 then repeat(chr(1), 150) || text else text end, 1000) as h from documents)",
)
def binary_flag(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 4 == 0, F.concat(F.repeat(F.lit("\x01"), F.lit(150)), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.is_binary(x).alias("bin"))


@query(
    "snippet",
    """with s as (select doc_id, string_split(text, chr(10)) as l, cast(doc_id % 5 as int) as a from documents),
    t as (select doc_id, array_to_string(l[greatest(0, a - 2) + 1 : least(len(l) - 1, a + 1 + 2) + 1], chr(10)) as x from s)
    select doc_id, md5(case when length(x) > 500 then left(x, 500) || chr(10) || '... [truncated]' else x end) as digest from t""",
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("doc_id") % 5).cast("int")
    return table(spark, d, "documents").select("doc_id", F.md5(T.snippet("text", a, a + 1, most=500).cast("binary")).alias("digest"))


@query("file_slice", "select doc_id, md5(array_to_string(l[2:4], chr(10))) as digest, cast(len(l) as int) as lines from (select doc_id, string_split(text, chr(10)) as l from documents)")
def file_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.file_slice("text", 1, 3).cast("binary")).alias("digest"), F.size(T.lines("text")).alias("lines"))


@query("fingerprint16", "select doc_id, left(sha256(text), 16) as fp from documents")
def fingerprint16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fingerprint("text").alias("fp"))


@query(
    "token_counts",
    "select lang, cast(sum(len(w)) as bigint) as tokens, cast(max(len(w)) as bigint) as longest from (select lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) > 1) as w from documents) group by lang",
)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(T.tokens("text")).cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(n).alias("tokens"), F.max(n).alias("longest"))


@query(
    "embed_text",
    f"""{with_('parts')} select id, label || ': ' || name || chr(10) || 'File: ' || string_split(filePath, '/')[-1] || chr(10) || 'Directory: ' || array_to_string(string_split(filePath, '/')[:-2], '/')
      || chr(10) || chr(10) || 'made of ' || name as text from parts""",
)
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    n = part_nodes(spark, d).withColumn("content", F.concat(F.lit("made of "), "name", F.lit("  \r\n")))
    return n.select("id", T.embedding_text("label", "name", "filePath", "content").alias("text"))


@query(
    "truncate_words",
    """with h as (select doc_id, text, left(text, 100) as h from documents),
    s as (select doc_id, text, h, case when contains(h, ' ') then length(h) - instr(reverse(h), ' ') else -1 end as p from h)
    select doc_id, case when length(text) <= 100 then text else case when p > 80 then left(h, cast(p as bigint)) else h end || '...' end as cut from s""",
)
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate_words("text", 100).alias("cut"))


@query("names_and_ids", "select p_partkey as id, 'Function:' || p_name as node, lower(left(regexp_replace(p_name, '[^a-zA-Z0-9]', '_', 'g'), 20)) as safe, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug, upper(left(p_name, 1)) || substr(p_name, 2) as cap from part")
def names_and_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), T.make_id(F.lit("Function"), "p_name").alias("node"), T.sanitize_id("p_name").alias("safe"), T.slugify(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), T.capitalize("p_name").alias("cap"))


@query("name_prefix", "select p_brand, min(p_name) as lo, max(p_name) as hi, left(min(p_name), cast(list_sum(list_transform(generate_series(1, length(min(p_name))), lambda i: case when left(min(p_name), i) = left(max(p_name), i) then 1 else 0 end)) as bigint)) as prefix from (select p_brand, 'x_' || p_name as p_name from part) group by p_brand")
def name_prefix(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").select("p_brand", F.concat(F.lit("x_"), "p_name").alias("n")).groupBy("p_brand").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return g.select("p_brand", "lo", "hi", T.common_prefix("lo", "hi").alias("prefix"))


_LANG_CASE = "case lower(regexp_extract(f, '\\.([^.]*)$', 1)) " + " ".join(f"when '{e}' then '{v}'" for e, v in P.LANGUAGES.items()) + " end"
_FILES = "(select p_partkey as id, 'lib/' || replace(p_name, ' ', '_') || ['.py', '.TS', '.kt', '', '.md', '.h'][p_partkey % 6 + 1] as f from part union all select -1, 'x/Rakefile')"


def _files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*(F.lit(x) for x in (".py", ".TS", ".kt", "", ".md", ".h"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("lib/"), F.replace("p_name", F.lit(" "), F.lit("_")), ext).alias("f"))
    return f.unionByName(spark.createDataFrame([(-1, "x/Rakefile")], "id long, f string"))


@query("language_of_file", f"select id, coalesce({_LANG_CASE}, case when string_split(f, '/')[-1] in ('Brewfile', 'Gemfile', 'Guardfile', 'Rakefile', 'Vagrantfile') then 'ruby' end) as lang from {_FILES}")
def language_of_file(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", P.language_of("f").alias("lang"))


_PATHS = "(select p_partkey as id, ['src/a.test.ts', 'src/tests/' || p_name, 'pkg/x_test.go', 'app/spec/m.rb', 'lib/UITests/a.swift', 'src/' || p_name || '.py', 'a\\b\\__mocks__\\c.js', 'x/conftest.py'][p_partkey % 8 + 1] as f from part)"


def _any(contains: list[str], ends: list[str]) -> str:
    p = "lower(replace(f, '\\', '/'))"
    return " or ".join([f"contains({p}, '{c}')" for c in contains] + [f"ends_with({p}, '{e}')" for e in ends])


@query("test_paths", f"select id, {', '.join(f'({_any(*v)}) as {k}' for k, v in T.TEST_PATHS.items())} from {_PATHS}")
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    options = F.array(F.lit("src/a.test.ts"), F.concat(F.lit("src/tests/"), "p_name"), F.lit("pkg/x_test.go"), F.lit("app/spec/m.rb"), F.lit("lib/UITests/a.swift"), F.concat(F.lit("src/"), "p_name", F.lit(".py")), F.lit("a\\b\\__mocks__\\c.js"), F.lit("x/conftest.py"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(options, (F.col("p_partkey") % 8 + 1).cast("int")).alias("f"))
    return f.select("id", *(T.is_test_path("f", k).alias(k) for k in T.TEST_PATHS))


@query("write_guard", "select turn, count(*) filter (regexp_matches(q, '(?i)(^|[^:\\w])(alter|copy|create|delete|detach|drop|foreach|install|load|merge|remove|set)\\b')) as writes from (select turn, ['MATCH (n:Set) RETURN n', 'match (n) set n.x = 1', 'CREATE (n)', 'MATCH (n) RETURN n.created'][turn % 4 + 1] || ' ' || role as q from conversations) group by turn")
def write_guard(spark: SparkSession, d: str) -> DataFrame:
    options = F.array(F.lit("MATCH (n:Set) RETURN n"), F.lit("match (n) set n.x = 1"), F.lit("CREATE (n)"), F.lit("MATCH (n) RETURN n.created"))
    q = table(spark, d, "conversations").select("turn", F.concat_ws(" ", F.element_at(options, (F.col("turn") % 4 + 1).cast("int")), "role").alias("q"))
    return q.groupBy("turn").agg(F.count(F.when(T.is_write_query("q"), 1)).alias("writes"))


@query("grep_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(generate_series(1, len(string_split(text, chr(10))))) as line from documents) select doc_id as file, cast(line as int) as line, left(trim(text, ' '), 200) as text from l where regexp_matches(text, '(?i)licen[sc]e') order by file, line limit 50")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return grep(table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")), "licen[sc]e", 50)


@query("rename_preview", "with l as (select doc_id, unnest(string_split(text, chr(10))) as b, unnest(generate_series(1, len(string_split(text, chr(10))))) as line from documents) select doc_id as file, cast(line as int) as line, md5(regexp_replace(b, '\\bLicense\\b', 'Permit', 'g')) as after from l where regexp_matches(b, '\\bLicense\\b')")
def rename_query(spark: SparkSession, d: str) -> DataFrame:
    x = rename_preview(table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")), "License", "Permit")
    return x.select("file", "line", F.md5(F.col("after").cast("binary")).alias("after"))


@query(
    "folder_tree",
    f"""{with_('parts')}, p as (select distinct string_split(filePath, '/') as a from parts),
    n as (select a, unnest(generate_series(1, len(a))) as i from p)
    select distinct case when i = len(a) then 'File' else 'Folder' end as label, array_to_string(a[1:i], '/') as path, array_to_string(a[1:i-1], '/') as parent from n""",
)
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.repo import folder_tree as tree

    return tree(part_nodes(spark, d).select("filePath")).select("label", "path", "parent")


_MD = "(select doc_id, list_transform(string_split(text, chr(10)), lambda s, i: case when i % 3 = 1 then repeat('#', cast(1 + (i + doc_id) % 3 as int)) || ' ' || left(s, 12) else s end) as l from documents)"


@query(
    "md_sections",
    f"""with l as (select doc_id, unnest(l) as s, unnest(generate_series(1, len(l))) as line, len(l) as n from {_MD}),
    h as (select doc_id, line, n, length(regexp_extract(s, '^(#{{1,6}})\\s+', 1)) as level from l where regexp_matches(s, '^#{{1,6}}\\s+\\S'))
    select doc_id, cast(line as int) as line, cast(level as int) as level,
      cast(coalesce((select min(line) - 1 from h b where b.doc_id = h.doc_id and b.line > h.line and b.level <= h.level), n) as int) as end_line,
      cast(coalesce((select max(line) from h b where b.doc_id = h.doc_id and b.line < h.line and b.level < h.level), 0) as int) as parent_line
    from h""",
)
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    from ..extract.markdown import sections

    i = lambda k: k + 1
    marked = F.transform(F.split("text", "\n"), lambda s, k: F.when(i(k) % 3 == 1, F.concat(F.repeat(F.lit("#"), (1 + (i(k) + F.col("doc_id")) % 3).cast("int")), F.lit(" "), F.left(s, F.lit(12)))).otherwise(s))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("content"))
    return sections(docs, "doc_id").select("doc_id", "line", "level", "end_line", F.coalesce("parent_line", F.lit(0)).alias("parent_line"))


_ROUTE_URL = """case when regexp_extract(file, 'app/(.+?)/route\\.[jt]sx?$', 1) <> '' then '/' || regexp_replace(regexp_extract(file, 'app/(.+?)/route\\.[jt]sx?$', 1), '\\([^)]+\\)/?', '', 'g') end"""


@query("route_urls", f"{with_('routes')} select ord, url from routes")
def route_urls(spark: SparkSession, d: str) -> DataFrame:
    return routes(spark, d).select("ord", P.next_route("file").alias("url"))


@query("url_normalize", f"{with_('fetches')} select file, url, count(*) as n from fetches group by all")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    f = fetches(spark, d).select("file", P.fetch_url("url").alias("url"), "reason").distinct()
    return f.groupBy("file", "url").agg(F.count("*").alias("n"))


@query("http_paths", "select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(string_split(trim('/' || u), '?')[1]), '/+$', ''), ':\\w+', '{param}', 'g'), '\\{[^}]+\\}', '{param}', 'g'), '\\[[^\\]]+\\]', '{param}', 'g') as path from (select page_id, array_to_string(string_split(url, '/')[4:], '/') || case page_id % 3 when 0 then '/:ID/' when 1 then '/{Key}' else '/[slug]?x=1' end as u from pages)")
def http_paths(spark: SparkSession, d: str) -> DataFrame:
    tail = F.array_join(F.slice(F.split("url", "/"), 4, 100), "/")
    end = F.when(F.col("page_id") % 3 == 0, "/:ID/").when(F.col("page_id") % 3 == 1, "/{Key}").otherwise("/[slug]?x=1")
    return table(spark, d, "pages").select("page_id", P.http_path(F.concat(F.lit("/"), tail, end)).alias("path"))


@query("web_links", "select host, count(*) as links, count(distinct href) as targets from (select regexp_extract(url, '^https?://([^/]+)', 1) as host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) group by host")
def web_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return p.groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query("first_per_key", "select c_mktsegment, c_custkey from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from customer) where r = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return first_by(table(spark, d, "customer"), ["c_mktsegment"], F.desc("c_acctbal"), "c_custkey").select("c_mktsegment", "c_custkey")


@query("repo_suffix", "select s_suppkey, left(translate(base64(encode('/repos/' || s_name)), '+/', '-_'), 16)[1:6] as suffix from supplier")
def repo_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", T.repo_suffix(F.concat(F.lit("/repos/"), "s_name")).alias("suffix"))
