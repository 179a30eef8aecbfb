import textwrap

import pytest
from pyspark.sql import functions as F

from codeloom.extract import cobol, markdown, source, web
from codeloom.functions import paths as P
from codeloom.functions import text as T
from codeloom.operators import contracts, resolve, routes
from codeloom.operators.graph import PropertyGraph
from codeloom.sources import repo
from codeloom.sources.graph_store import GraphStore, keep_vectors
from codeloom.streaming.incremental import CHANGE, file_changes, upsert_stream, window_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("path,url", [("app/(admin)/api/x/[id]/route.ts", "/api/x/[id]"), ("src/app/page/route.ts", None), ("pages/api/a/index.js", "/api/a"), ("pages/b.ts", None), ("app\\api\\route.ts", "/api")])
def test_next_routes(spark, path, url):
    assert one(spark, P.next_route(F.lit(path))) == url


@pytest.mark.parametrize("path,url", [("app/users/[id].tsx", "/users/[id]"), ("app/(tabs)/index.tsx", "/"), ("app/_layout.tsx", None), ("app/users+api.ts", "/users"), ("app/+not-found.tsx", None), ("app/x.d.ts", None)])
def test_expo_routes(spark, path, url):
    assert one(spark, P.expo_route(F.lit(path))) == url


@pytest.mark.parametrize("path,url", [("api/upload.php", "/api/upload"), ("api/_x.php", None), ("api/test_a.php", None), ("api/contest.php", "/api/contest"), ("lib/a.php", None)])
def test_php_routes(spark, path, url):
    assert one(spark, P.php_route(F.lit(path))) == url


@pytest.mark.parametrize("fetch,route,fits", [("/api/a/1", "/api/a/[id]", True), ("/api/a", "/api/a/[id]", False), ("/x/1/2", "/x/[...all]", True), ("/x", "/x/[[...all]]", True), ("/y/1", "/x/[...all]", False), ("/a/[param]", "/a/b", True)])
def test_route_matching(spark, fetch, route, fits):
    assert one(spark, P.route_matches(F.lit(fetch), F.lit(route))) is fits


@pytest.mark.parametrize("url,norm", [("`/api/${x}/y`?q", "/api/[param]/y"), ("/a.php?x", "/a"), ("http://x", None), ("/a" + "+b", None)])
def test_fetch_url(spark, url, norm):
    assert one(spark, P.fetch_url(F.lit(url))) == norm


@pytest.mark.parametrize("id,key", [("http::get::/A/", "http::GET::/A"), ("grpc::Pkg.S/Do", "grpc::pkg.s/Do"), ("grpc::/X", "grpc::/X"), ("grpc::ABC", "grpc::abc"), ("topic:: A ", "topic::a"), ("lib::X", "lib::x"), ("odd", "odd"), ("zz::A", "zz::A")])
def test_contract_key(spark, id, key):
    assert one(spark, P.contract_key(F.lit(id))) == key


def test_small_functions(spark):
    assert one(spark, P.join_relative(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d"
    assert one(spark, T.common_prefix(F.lit("handleA"), F.lit("handleB"))) == "handle"
    assert one(spark, T.clean_code(F.lit("a  \r\n\n\n\nb "))) == "a\n\nb"
    assert one(spark, T.is_binary(F.lit("\x01" * 20 + "a" * 50))) is True and one(spark, T.is_binary(F.lit(""))) is False
    assert one(spark, P.reason_keys(F.lit("m|keys:a,b|fetches:2"))) == ["a", "b"] and one(spark, P.reason_fetches(F.lit("m"))) == 1
    for q, w in (("match (n) set n.x=1", True), ("MATCH (n:Set) RETURN n", False), ("n.created", False), ("foreach (x)", True)):
        assert one(spark, T.is_write_query(F.lit(q))) is w


def test_markdown(spark):
    text = "# A\ntext\n## B\n[x](../c/d.md#k) [y](http://z)\n### C\n## D\n# E\nend"
    f = spark.createDataFrame([("docs/a.md", text)], "file string, content string")
    got = [(r.title, r.line, r.end_line, r.parent_line) for r in markdown.sections(f, "file").orderBy("line").collect()]
    assert got == [("A", 1, 6, None), ("B", 3, 5, 1), ("C", 5, 5, 3), ("D", 6, 6, 1), ("E", 7, 8, None)]
    assert [r.target for r in markdown.links(f, "file").collect()] == ["c/d.md"]


PY = textwrap.dedent(
    """
    import os.path as op
    from .base import Base, helper as h

    class Child(Base):
        size: int = 0

        def run(self, a, b=1) -> str:
            self.size = a
            return h(a, b)

        def _hidden(self): ...

    def main(*args):
        c = Child()
        c.run(1)
    """
)


def test_extract_graph(spark):
    files = spark.createDataFrame([("pkg/child.py", "python", PY), ("a.go", "go", "package a\nfunc Run(x int) {\n  help(x)\n}\ntype S struct {\n}\n"), ("b.ts", "typescript", "import x from './y'\nexport class A extends B {\n}\nconst f = (a) => a\n"), ("bad.py", "python", "def ("), ("n.txt", None, None)], "filePath string, language string, content string")
    rec = source.extract(files).cache()
    d = {(r.filePath, r.name): r for r in rec.filter("record = 'def'").collect()}
    assert d["pkg/child.py", "run"].label == "Method" and d["pkg/child.py", "run"].args == 2 and d["pkg/child.py", "run"].required == 1
    assert not d["pkg/child.py", "_hidden"].exported and d["pkg/child.py", "main"].args is None
    assert d["a.go", "Run"].exported and d["a.go", "S"].label == "Struct" and d["b.ts", "A"].exported and not d["b.ts", "f"].exported
    assert {(r.name, r.target) for r in rec.filter("record = 'heritage'").collect()} == {("Child", "Base"), ("A", "B")}
    assert ("h", ".base", "helper") in {(r.name, r.target, r.extra) for r in rec.filter("record = 'import'").collect()}
    assert ("size", "self") in {(r.name, r.target) for r in rec.filter("record = 'write'").collect()}
    assert {"h", "Child", "run", "help"} <= {r.name for r in rec.filter("record = 'call'").collect()}
    nodes, edges = source.to_graph(rec)
    assert {r.type for r in edges.collect()} == {"DEFINES", "HAS_METHOD", "HAS_PROPERTY"} and nodes.count() == len(d)


def test_cobol_and_jcl():
    text = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAY.\n       DATA DIVISION.\n       01 TOTAL PIC 9(4).\n      * COPY NOT.\n       COPY BOOK REPLACING ==X== BY ==Y==.\n       PROCEDURE DIVISION.\n       MAIN-PARA.\n           PERFORM SUB-PARA\n           CALL 'TAX'\n           MOVE 1 TO TOTAL.\n       SUB-PARA.\n           EXEC SQL SELECT A FROM EMP END-EXEC."
    rows = cobol.cobol_rows("p.cbl", text)
    assert {(r["name"], r["label"]) for r in rows if r["record"] == "def"} == {("PAY", "Module"), ("TOTAL", "Property"), ("MAIN-PARA", "Function"), ("SUB-PARA", "Function")}
    assert {(r["name"], r["extra"]) for r in rows if r["record"] == "call"} == {("SUB-PARA", "perform"), ("TAX", "program"), ("EMP", "exec-sql")}
    assert [r["name"] for r in rows if r["record"] == "import"] == ["BOOK"]
    books = {"BOOK": "01 X-NAME. 01 X. COPY BOOK.", "DEEP": "COPY BOOK."}
    assert cobol.expand_copies("COPY DEEP REPLACING ==X== BY ==Y==.", {"DEEP": "05 X. 05 XY."}) == "05 Y. 05 XY."
    assert cobol.expand_copies("COPY BOOK REPLACING LEADING ==X== BY ==Z==.", books) == "01 Z-NAME. 01 X. COPY BOOK."
    jcl = "//PAYJOB JOB (A)\n//* note\n//S1 EXEC PGM=PAY\n//IN DD DSN=A.B,DISP=SHR\n//OUT DD DSN=C.D,\n//    DISP=(NEW,CATLG)\n//S2 EXEC CLEAN"
    got = {(r["record"], r["name"], r["extra"]) for r in cobol.jcl_rows("j.jcl", jcl)}
    assert {("def", "PAYJOB", "jcl-job"), ("call", "PAY", "jcl-program"), ("call", "CLEAN", "jcl-proc"), ("read", "A.B", None), ("write", "C.D", None)} <= got


def test_web(spark):
    code = """export const GET = withAuth(withLog(async () => { if (x) return NextResponse.json({ error: 'no' }, { status: 404 });
      return NextResponse.json({ data: rows, page: { n: 1 } }) }))
      const r = await fetch(`/api/items/${id}`); const { data, total: t } = await r.json(); await prisma.user.findMany({}); supabase.from('jobs').select('*')
      producer.send({ topic: 'Orders' }); x = data.name; <form action="/api/save">"""
    f = spark.createDataFrame([("a.ts", code), ("api.proto", "package p.v1;\nservice Pay {\n rpc Do (A) returns (B);\n}"), ("tools.ts", "inputSchema: 1, name: 'query', description: 'Finds it'")], "file string, content string")
    assert web.response_shapes(code) == (["data", "page"], ["error"]) and web.middleware_chain(code) == ["withAuth", "withLog"]
    assert {r.url for r in web.fetch_calls(f).collect()} == {"`/api/items/${id}`", "/api/save"}
    assert {(r.orm, r.model, r.method) for r in web.orm_calls(f).collect()} == {("prisma", "user", "findMany"), ("supabase", "jobs", "select")}
    assert f.filter("file = 'a.ts'").select(web.accessed_keys().alias("k")).first().k == ["data", "name", "total"]
    assert [(r.contractId, r.role) for r in web.topic_contracts(f).collect()] == [("topic::orders", "provider")]
    assert [r.name for r in web.tool_definitions(f).collect()] == ["query"]
    assert ("grpc-provider", "grpc::p.v1.pay/Do") in {(r.kind, r.name) for r in web.records(f).collect()}
    php = "Route::get('/a', [X::class, 'i']); Route::prefix('admin')->group(function () { Route::post('b', 'Y@z'); Route::resource('users', UserController::class); });"
    assert ("POST", "/admin/b") in {(m, p) for m, p, _ in web.laravel_routes(php)} and ("GET", "/admin/users/{user}") in {(m, p) for m, p, _ in web.laravel_routes(php)}
    assert web.decorator_routes('@app.get("/x")\n@bp.route("/y", methods=["POST"])\n@GetMapping("/z")') == [("GET", "/x"), ("POST", "/y"), ("GET", "/z")]


def test_resolution(spark):
    s = spark.createDataFrame([("1", "run", "a.py"), ("2", "run", "b.py"), ("3", "run", "c.py"), ("4", "only", "d.py"), ("5", "real", "b.py")], "id string, name string, file string")
    refs = spark.createDataFrame([("r1", "a.py", "run"), ("r2", "x.py", "run"), ("r3", "x.py", "only"), ("r4", "z.py", "run"), ("r5", "x.py", "alias")], "ref string, file string, name string")
    imports = spark.createDataFrame([("x.py", "b.py")], "file string, target string")
    named = spark.createDataFrame([("x.py", "alias", "re.py", "mid"), ("re.py", "mid", "b.py", "real")], "file string, local string, source string, exported string")
    got = {}
    for r in resolve.resolve_names(refs, s, imports, named=named).collect():
        got.setdefault((r.ref, r.tier), set()).add(r.symbol)
    assert got == {("r1", "same-file"): {"1"}, ("r2", "import"): {"2"}, ("r3", "global"): {"4"}, ("r4", "global"): {"1", "2", "3"}, ("r5", "import"): {"5"}}
    b = spark.createDataFrame([("f", "a", "x", "a"), ("f", "a", "y", "a"), ("f", "b", "x", "b")], "file string, local string, source string, exported string")
    assert [r.local for r in resolve.apply_named_imports(b).collect()] == ["b"]
    c = spark.createDataFrame([("r", "m1", "Method", 2, 1, 1, "free", "f", 0.9), ("r", "m2", "Function", 0, 0, 1, "free", "f", 0.9), ("q", "k", "Class", None, None, 2, "constructor", "long/f", 0.5), ("q", "k2", "Class", None, None, 2, "constructor", "f", 0.5), ("q", "v", "Variable", None, None, 2, "constructor", "f", 0.5)], "ref string, symbol string, type string, parameters int, required int, args int, form string, file string, confidence double")
    assert {(r.ref, r.symbol) for r in resolve.resolve_calls(c).collect()} == {("r", "m1"), ("q", "k2")}
    known = spark.createDataFrame([("s", "a", "User")], "scope string, var string, type string")
    pend = spark.createDataFrame([("s", "b", "copy", "a", None, 1), ("s", "c", "field", "b", "home", 2), ("s", "d", "method", "c", "city", 3), ("s", "e", "call", "make", None, 4), ("s", "f", "copy", "nope", None, 5)], "scope string, var string, kind string, base string, member string, seq int")
    ret = spark.createDataFrame([(None, "make", "Car"), ("Home", "city", "City")], "owner string, name string, type string")
    fld = spark.createDataFrame([("User", "home", "Home")], "owner string, name string, type string")
    assert {r.var: r.type for r in resolve.propagate_types(known, pend, ret, fld).collect()} == {"a": "User", "b": "User", "c": "Home", "d": "City", "e": "Car"}
    h = spark.createDataFrame([("A", "a.py", "Base", "extends"), ("A", "a.py", "IThing", "extends"), ("A", "a.py", "A", "extends")], "cls string, file string, parent string, kind string")
    sy = spark.createDataFrame([("Class:A", "A", "a.py", "Class"), ("Class:Base", "Base", "b.py", "Class")], "id string, name string, file string, type string")
    assert {(r.parent, r.type, r.confidence) for r in resolve.heritage(h, sy).collect()} == {("Class:Base", "EXTENDS", 0.689202), ("Interface:IThing", "IMPLEMENTS", 0.689202)}
    files = spark.createDataFrame([("src/a/b.ts", 1), ("lib/b.ts", 2), ("src/a/index.ts", 3)], "file string, seq int")
    imp = spark.createDataFrame([("i1", "a/b"), ("i2", "b"), ("i3", "@x/A"), ("i4", "none")], "import_id string, path string")
    assert {r.import_id: r.file for r in resolve.resolve_suffix(imp, files).collect()} == {"i1": "src/a/b.ts", "i2": "src/a/b.ts", "i3": "src/a/index.ts"}
    rel = spark.createDataFrame([("r1", "src/x/c.ts", "../a/b"), ("r2", "src/c.ts", "./a")], "import_id string, from_file string, path string")
    assert {r.import_id: r.file for r in resolve.resolve_relative(rel, files).collect()} == {"r1": "src/a/b.ts", "r2": "src/a/index.ts"}


def test_contracts_and_models(spark):
    c = spark.createDataFrame([("a", "http::GET::/x", "provider", "s1"), ("a", "http::get::/x/", "consumer", "s2"), ("a", "http::GET::/x", "consumer", "s1"), ("b", "http::*::/x", "consumer", None), ("b", "topic::q", "provider", None)], "repo string, contractId string, role string, service string")
    m = contracts.match(c)
    assert {(r.consumer_repo, r.consumer_service) for r in m.collect()} == {("a", "s2"), ("b", None)}
    assert {(r.repo, r.contractId) for r in contracts.unmatched(c, m).collect()} == {("a", "http::GET::/x"), ("b", "topic::q")}
    q = spark.createDataFrame([("f", "prisma", "user", "find"), ("f", "prisma", "user", "find"), ("f", "prisma", "x", "find")], "file string, orm string, model string, method string")
    n = spark.createDataFrame([("I1", "Interface", "user"), ("C1", "Class", "user")], "id string, label string, name string")
    assert {r.target for r in routes.model_links(q, n).collect()} == {"C1", "CodeElement:prisma:x"}
    rules = spark.createDataFrame([("auth", "prefix", "/api"), ("log", "exact", "/x"), ("re", "regex", "^/a.*z$")], "name string, kind string, pattern string")
    u = spark.createDataFrame([("/api/u",), ("/apix",), ("/x",), ("/abz",)], "url string")
    assert {(r.url, r.name) for r in routes.middleware_routes(rules, u).collect()} == {("/api/u", "auth"), ("/x", "log"), ("/abz", "re")}


def test_scan_and_ignore(spark, tmp_path):
    for p, t in {"src/a.py": "x = 1", "node_modules/m.js": "1", ".git/c": "1", "dist/o.js": "1", "img.png": "1", "src/gen/b.py": "2", "yarn.lock": "1", "big.py": "y" * 600_000}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = repo.scan(spark, f"file://{tmp_path}", [repo.gitignore_regex("gen/")])
    assert [(r.filePath, r.language, r.content) for r in got.collect()] == [("src/a.py", "python", "x = 1")]
    tree = repo.folder_tree(got)
    assert {r.id for r in tree.collect()} == {"File:src/a.py", "Folder:src"} and repo.contains_edges(tree).count() == 1


def test_store_and_stream(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "File", "a", "a.py"), ("1", "File", "later", "a.py"), ("2", "Function", "b", "b.py")], "id string, label string, name string, filePath string").withColumn("seq", F.monotonically_increasing_id())
    edges = spark.createDataFrame([("1", "2", "CALLS", 0.5), ("1", "9", "CALLS", 0.5)], "src string, dst string, type string, confidence double")
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert store.meta() is None and not store.up_to_date("c1")
    assert store.write(PropertyGraph(nodes, edges), "c1", first_wins="seq")["stats"] == {"nodes": 2, "edges": 1}
    assert store.up_to_date("c1") and not store.up_to_date("")
    store.export_csv(f"file://{tmp_path}/csv")
    changes = [(1, "upsert", "3", "Class", "K", "k.py"), (2, "upsert", "2", "Function", "old", "b.py"), (3, "upsert", "2", "Function", "new", "b.py"), (4, "delete", "1", "File", "a", "a.py")]
    spark.createDataFrame(changes, CHANGE).write.parquet(f"file://{tmp_path}/in")
    stream = file_changes(spark, f"file://{tmp_path}/in", CHANGE)
    upsert_stream(stream, store, f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    g = store.read()
    assert {(r.id, r.name) for r in g.nodes.collect()} == {("2", "new"), ("3", "K")} and g.edges.count() == 0
    v = spark.createDataFrame([("2", [1.0, 2.0]), ("2", [1.0]), ("7", [1.0, 2.0])], "nodeId string, embedding array<float>")
    assert keep_vectors(v, g.nodes, 2).count() == 1


def test_window_counts_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(f"file://{tmp_path}/e")
    s = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/e")
    window_counts(s, late="999 days").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("wc").agg(F.sum("n")).first()[0] == e.count()
