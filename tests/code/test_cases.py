"""Literal cases of the operators' behaviour."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from prismata.functions import text as T
from prismata.plans import index_queries
from prismata.plans.registry import QUERIES
from prismata.sources.projection import Repo
from prismata.operators import chunks, control, evaluation, evidence, lookup, ranking, retrieval, review, summary
from prismata.sources import files, java, store
from prismata.sources.java_syntax import Outline
from prismata.streaming import ledger


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long'}" for k, v in values.items()) or "x string") if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize("text, want", [("R.success", ["success"]), ("MusicService#uploadMusic", ["MusicService", "uploadMusic"]), ("查询 订单 列表", ["查询", "订单", "列表"]), ("R a b", []), ("介绍一下x1", ["x1", "介绍", "绍一", "一下"]), ("单 ab", ["ab", "单"])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text))) == want


def test_relaxed(spark):
    pick = lambda *w: one(spark, T.relaxed(F.array(*map(F.lit, w))))
    assert pick("deleteAddressBook", "方法", "调用") == ["deleteAddressBook"] and pick("方法", "调用") == ["方法", "调用"]


@pytest.mark.parametrize("name, want", [("com.x.Service#submit/1", "submit"), ("com.x.Service", "Service"), (None, None)])
def test_simple_name(spark, name, want):
    assert one(spark, T.simple_name(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("谁调用了 submit", "CALLERS"), ("who calls submit", "CALLERS"), ("submit 调用了谁", "CALLEES"), ("what does submit call", "CALLEES"), ("A 有哪些实现", "IMPLEMENTATIONS"), ("A 有哪些方法", "STRUCTURE"), ("A 在哪定义", "LOCATE"), ("where is A defined", "LOCATE"), ("how are orders paid", "SEMANTIC")])
def test_routes(spark, text, want):
    assert one(spark, T.route(F.lit(text))) == want


def test_identifiers_and_intents(spark):
    assert one(spark, T.identifiers(F.lit("who calls the submit method of R"))) == ["submit", "R"]
    assert one(spark, T.is_chain(F.lit("间接调用"))) and not one(spark, T.is_chain(F.lit(" ")))
    assert one(spark, T.is_summary(F.lit("what does this project do"))) and not one(spark, T.is_summary(F.lit("who calls a")))


@pytest.mark.parametrize("signature, want", [("f()", 0), ("f(int a, int b)", 2), ("f(Map<String, List<Integer>> a, int b, Map<K, V> c, int d)", 4), ("f", 0)])
def test_parameter_count(spark, signature, want):
    assert one(spark, T.parameter_count(F.lit(signature))) == want


def test_visit_keys_are_one_edge(spark):
    key = lambda a, b: one(spark, T.visit_key(F.lit(a), F.lit(b).cast("string")))
    assert len({key("findCallers", "R.success"), key("find_callers", "R.success()"), key("FIND-CALLERS", " r.success ")}) == 1
    assert key("t", "Outer$Inner") == key("t", "Outer.Inner") and key("t", None) == "t()"


def test_names_keys_and_clips(spark):
    assert one(spark, T.archive_name(F.lit("a\\b/My Repo.zip"))) == "My-Repo" and one(spark, T.archive_name(F.lit("---"))) == "uploaded-repo"
    assert one(spark, T.clip(F.lit("abcdefghij"), 8)) == "abcde..." and one(spark, T.severity(F.lit("Odd"))) == "unknown"
    assert one(spark, T.percent(F.lit(250), F.lit(100))) == 100 and one(spark, T.percent(F.lit(5), F.lit(0))) == 0
    assert one(spark, T.lines(F.lit("a\r\nb\n"))) == ["a", "b"] and one(spark, T.line_slice(T.lines(F.lit("a\nb\nc")), F.lit(2), F.lit(9))) == "b\nc"


def test_bad_searches(spark):
    c = spark.createDataFrame([(1, "f", "some text")], "id long, file_path string, content string")
    for q in ("", "a"):
        with pytest.raises(ValueError):
            retrieval.search(c, q)
    assert retrieval.search(c, "unknownIdentifier").count() == 0 and retrieval.search(c, "TEXT").count() == 1
    with pytest.raises(ValueError):
        lookup.find_symbols(c, c, " ")
    assert lookup.clamp(0) == 1 and lookup.clamp(999) == 200


def test_support_check_is_bounded_and_never_passes_by_failing(spark):
    files = spark.createDataFrame([("a.py", "\n".join(f"line {k} " + "x" * 50 for k in range(1, 200))), ("b.py", "short")], "path string, content string")
    claims = spark.createDataFrame([(k, "why?", a) for k, a in enumerate(["yes", "no", "maybe", "odd", "boom", "no json", " ", "uncited", None])], "id long, question string, answer string")
    rows = [(k, p, "a.py", 3 * p, 3 * p + 90, "seen") for k in range(7) for p in range(9)] + [(0, 100, "b.py", 1, 1, None), (1, -1, "c\\none.py", 1, 2, ""), (2, -1, "b.py", 5, 9, "")]
    cited = spark.createDataFrame(rows, "claim_id long, place long, file string, start_line long, end_line long, why string")
    shown = evidence.material(cited, files)
    got = {(r.claim_id, r.place): r for r in shown.collect()}
    assert len([1 for k, _ in got if k == 0]) == evidence.MOST_EVIDENCES and got[0, 0].more == 4 and got[3, 0].more == 3
    assert got[1, -1].code == got[2, -1].code == evidence.UNREADABLE and got[1, -1].location == "c/none.py:1-2"
    code = got[0, 1].code.split("\n")
    assert code[0].startswith("3: line 3 ") and len(code) - 1 <= evidence.MOST_LINES and evidence.MOST_CHARS <= len(got[0, 1].code) < evidence.MOST_CHARS + 70
    longest = max(len(r.prompt) for r in evidence.prompts(claims, shown).collect())
    assert longest < evidence.MOST_EVIDENCES * (evidence.MOST_CHARS + 150) + 200

    def checker(prompts):
        if any("Conclusion: boom" in p for p in prompts):
            raise ConnectionError("down")
        said = {"yes": "supported", "no": " Unsupported", "maybe": "UNKNOWN", "odd": "sure"}
        of = [p.split("Conclusion: ")[1].split("\n")[0] for p in prompts]
        return ["nothing" if x == "no json" else '```{"verdict": "%s", "reason": "r"}```' % said[x] for x in of]

    status = {r.id: (r.status, r.reason) for r in evidence.judged(claims, cited, files, checker, 1).collect()}
    assert {k: v[0] for k, v in status.items()} == {0: "SUPPORTED", 1: "UNSUPPORTED", 2: "UNKNOWN", 3: "UNAVAILABLE", 4: "UNAVAILABLE", 5: "UNAVAILABLE", 6: "NOT_CHECKED", 7: "NOT_CHECKED", 8: "NOT_CHECKED"}
    assert "ConnectionError" in status[4][1] and "no JSON" in status[5][1] and "sure" in status[3][1] and "evidence" in status[7][1]
    assert {r.status for r in evidence.judged(claims, cited, files, None).collect()} == {"UNAVAILABLE", "NOT_CHECKED"}


def test_context_selection():
    row = lambda f, s, text="x", n=10: (f, s, s + 1, text, n)
    assert ranking.choose([row("a", 1, "p"), row("a", 1, "q"), row("b", 1, "p"), row("a", 5, "r"), row("a", 9, "s")], 100, 9, 2) == ["KEPT", "SAME_PLACE", "SAME_CONTENT", "KEPT", "FILE_CAP"]
    assert ranking.choose([row("a", 1, "p", 9000)], 250, 9, 2) == ["KEPT"]
    assert ranking.choose([row("a", 1, "p"), row("b", 1, "q", 9000), row("c", 1, "r", 95)], 10000, 9, 2)[1:] == ["OVERSIZE", "KEPT"][0:1] + ["KEPT"]
    assert ranking.choose([row("a", 1, "p", 200), row("b", 1, "q", 100)], 250, 9, 2)[1] == "BUDGET"
    assert ranking.choose([row("a", 1, "p"), row("b", 1, "q")], 250, 1, 2)[1] == "FULL" and ranking.choose([], 1, 1, 1) == []


def test_evidence_cases(spark):
    f = spark.createDataFrame([("a/B.java", 3, "class B {\n  void submitOrder(int a) {}\n}\n")], "path string, loc long, content string")
    rows = [(1, "a/B.java", 1, 3, None), (2, "a/C.java", 1, 2, None), (3, "a/B.java", 900, 920, None), (4, "a/B.java", 1, 3, "this was invented by a model"), (5, "a/B.java", 2, 2, "2: void submitOrder(int a) {}"), (6, "../../../etc/passwd", 1, 1, None), (7, None, 1, 1, None), (8, "a\\B.java", 1, 1, "x")]
    e = spark.createDataFrame(rows, "id long, file string, start_line long, end_line long, snippet string")
    got = {r.id: r.failure for r in evidence.verified(e, f, snippet=True).collect()}
    assert got == {1: "OK", 2: "FILE_NOT_FOUND", 3: "LINE_OUT_OF_RANGE", 4: "CONTENT_MISMATCH", 5: "OK", 6: "PATH_ESCAPES_REPO", 7: "FILE_NOT_FOUND", 8: "OK"}


def test_grading(spark):
    rows = [(1, "LOCATE", ["A:10"], ["A:10"]), (2, "LOCATE", ["A:10"], ["A:10", "B:1"]), (3, "LOCATE", ["A:10"], ["B:1"]), (4, "CALLERS", ["a", "b", "c"], ["a"]), (5, "CALLERS", ["a", "b", "c"], ["a", "b", "c", "d"]), (6, "CALLERS", ["a"], ["a"]), (7, "CALLERS", [], ["a"])]
    g = {r.id: r for r in evaluation.graded(spark.createDataFrame(rows, "id long, qtype string, truth array<string>, claimed array<string>")).collect()}
    assert [g[i].hit for i in range(1, 8)] == [True, True, False, False, False, True, False]
    assert g[4].precision == 1 and g[4].recall == pytest.approx(1 / 3) and g[5].precision == 0.75 and g[5].recall == 1 and g[6].f1 == 1


def test_budget_dimensions(spark):
    s = spark.createDataFrame([(1, i, 100, 1000, 0) for i in range(6)], "s long, i long, ms long, prompt_tokens long, completion_tokens long")
    said = lambda *a: [r.stopped_by for r in control.budgeted(s, "s", "i", *a).orderBy("i").collect()]
    assert said(3, 9999, 99999, 9.0, 1.0, 1.0) == [None] * 3 + ["ROUNDS"] * 3
    assert said(99, 200, 1500, 9.0, 1.0, 1.0) == [None] * 2 + ["DURATION"] * 4
    assert said(99, 9999, 99999, 0.002, 1.0, 1.0) == [None] * 2 + ["COST"] * 4 and said(99, 9999, 99999, 0.0, 0.0, 0.0) == [None] * 6


def test_model_json(spark):
    p = lambda raw: one(spark, control.parsed(F.lit(raw), "answer string")["answer"])
    assert p('```json\n{"answer": "x"}\n```') == "x" and p('so: {"answer": "a\\d"} ok') == "ad" and p("nothing") is None
    e = spark.createDataFrame([("A.java:12-20", None, None), ("B.java", 3, 2), ("C.java", 1, 2), ("", 1, 2), ("D.java:7", None, None)], "file string, start_line long, end_line long")
    assert sorted(tuple(r) for r in control.cited(e).select("file", "start_line", "end_line").collect()) == [("A.java", 12, 20), ("C.java", 1, 2), ("D.java", 7, 7)]


def test_empty_catch_lines(spark):
    source = "try {\n a();\n} catch (IOException e) {\n  // nothing\n}\ntry { b(); } catch (E e) { log(e); }"
    assert one(spark, review.empty_catch_lines(F.lit(source))) == [2]


def test_prefixes():
    assert summary.package_prefix(["a.b.c", "a.b.d", "a.b"]) == "a.b" and summary.package_prefix(["a", "b"]) == "" and summary.package_prefix([]) == ""
    assert summary.choose_prefix(["a.b.x.p", "a.b.x.q", "a.b.x.r", "a.b.y"]) == "a.b.x"
    assert summary.key_type_pattern("a.b", "a.b") == "^a[.]b[.][A-Za-z0-9_$]+$" and summary.key_type_pattern(None, "") is None


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in retrieval.vector_search(v, [1.0, 0.0], 3).collect()]
    assert got == [(1, 1.0), (3, 1.0), (2, 0.0)]
    with pytest.raises(ValueError):
        retrieval.vector_search(v, [1.0], 3)
    assert retrieval.unpack(retrieval.pack([1.0, -2.5])) == [1.0, -2.5] and retrieval.java_hash("hello") == 99162322
    with pytest.raises(ValueError):
        retrieval.unpack(b"abc")


JAVA = """package com.x;
import java.util.*;
/** Orders. { */
public class Service extends Base implements Api, Closeable {
    private final Repo repo = new Repo();
    public Service(int a) { this.run(a); }
    /** go } */
    public static void main(String[] args) { new Service(1).submit("x", 2); }
    List<String> submit(String s, int n) {
        repo.save(s);
        helper(n, s); // call(1)
        return null;
    }
    void run(int a) { System.out.println("catch ("); }
    private void helper(int a, String b) {}
    enum Color { RED, GREEN; int code() { return 1; } }
}
interface Api { void run(int a); }
"""


def test_java_outline():
    found = Outline(JAVA)
    keys = {s["qualified_name"]: s for s in found.symbols}
    assert {"com.x.Service", "com.x.Service#<init>/1", "com.x.Service#main/1", "com.x.Service#submit/2", "com.x.Service#helper/2", "com.x.Service.repo", "com.x.Service.Color", "com.x.Service.Color#code/0", "com.x.Api", "com.x.Api#run/1"} <= set(keys)
    assert keys["com.x.Service#<init>/1"]["name"] == "Service" and keys["com.x.Service"]["start_line"] == 4 and keys["com.x.Service"]["parent_key"] is None
    assert keys["com.x.Service"]["javadoc"] == "Orders. {" and keys["com.x.Service#submit/2"]["return_type"] == "List<String>"
    assert {(c["caller_key"], c["base"], c["ref"], c["name"], c["arity"]) for c in found.nodes} >= {("com.x.Service#submit/2", "TYPE", "Repo", "save", 1), ("com.x.Service#submit/2", "LEXICAL", None, "helper", 2), ("com.x.Service#main/1", "TYPE", "Service", "<init>", 1)}
    assert {(s["super_raw"], s["kind"]) for s in found.supers} == {("Base", "EXTENDS"), ("Api", "IMPLEMENTS"), ("Closeable", "IMPLEMENTS")}


@pytest.mark.parametrize(("body", "want"), [
    ("if (a < b && c > (d)) f(g(1, h()));", {"f/1", "g/2", "h/0"}),
    ("x.<A, B>f(new HashMap<A, List<B>>() {{ put(1, 2); }}, y -> y.z());", {"x#f/2", "HashMap/0", "put/2", "y#z/0"}),
    ("class L { L(int a) { m(a); } <T> void m(T t) {} } new L(1).m(2);", {"m/1", "L/1", "new L(1)#m/1"}),
    ("switch (o) { case P(int a, Q(var b)) when t(a) -> f(b); case R r -> r.g(); default -> throw e(\"}\"); }", {"t/1", "f/1", "r#g/0", "e/1"}),
    ("int[] a = {f(1), g()}, b = new int[h()]; this.c[0].d().e();", {"f/1", "g/0", "h/0", "this.c[0]#d/0", "this.c[0].d()#e/0"}),
    ("try (var s = open()) { s.read(); } catch (E | F e) { e.log(\"\"\"\n  {\"x\"}\"\"\"); } finally { synchronized (lock()) { super.f(); } }", {"open/0", "s#read/0", "e#log/1", "lock/0", "super#f/0"}),
    ("@SuppressWarnings(value = {\"a\"}) final var x = (String) y.get(); assert ok() : '\"' + bad('{');", {"y#get/0", "ok/0", "bad/1"}),
    ("return c ? this::f : a.b.C.d(e -> { return g(e); }, Outer.this.h());", {"a.b.C#d/2", "g/1", "Outer.this#h/0"}),
])
def test_calls_of_bodies(body, want):
    found = Outline("class A { String[] c; void run(int p) {\n" + body + "\n} int after() { return last(); } }")
    assert {n["raw"] for n in found.nodes if n["call_kind"] != "FIELD" and n["caller_key"] == "A#run/1"} == want
    assert [n["raw"] for n in found.nodes if n["caller_key"] == "A#after/0"] == ["last/0"]


@pytest.mark.parametrize("text", ["class A {", "class A { void f( }", "class A { void f() }", "class A } {"])
def test_broken_files_are_errors(text):
    with pytest.raises(SyntaxError):
        Outline(text)


def _units(spark, *sources):
    return java.parsed(spark.createDataFrame([(f"F{i}.java", s.encode()) for i, s in enumerate(sources)], "path string, content binary"))


def _edges(units):
    return {(r.caller_key.split(".")[-1], r.callee_raw): r.callee_key or r.reason for r in java.resolved_calls(units).collect()}


def test_members_are_looked_up_along_the_hierarchy(spark):
    edges = _edges(_units(
        spark,
        "package p; public class A { A a() { return this; } void f(String s) {} void f(int n, Object... more) {} static void s() {} int x; }",
        "package p; interface I { default void d() {} I i(); } interface J extends I { J j(); }",
        "package q; import p.*; class B extends A implements J { A inner; void f(Object o) {} void run(B b) { this.f(\"s\"); f(1); f(1, 2, 3); d(); i().d(); j().i(); b.a().f(null); inner.a().f(\"s\"); A.s(); b.zz(); toString(); } }",
        "package q; class C extends B { C a() { return this; } void run() { a().f(2); super.a().a(); new C().run(); new C(1); this.inner.a(); } class D { void run2() { run(); f(this); a().run(); } } }",
        "class Loop1 extends Loop2 { void f() { g(); h(); } } class Loop2 extends Loop1 { void g() {} }",
    ))
    assert edges == {
        ("B#run/1", "this#f/1"): "p.A#f/1", ("B#run/1", "f/1"): "q.B#f/1", ("B#run/1", "f/3"): "p.A#f/2", ("B#run/1", "d/0"): "p.I#d/0", ("B#run/1", "i/0"): "p.I#i/0", ("B#run/1", "i()#d/0"): "p.I#d/0", ("B#run/1", "j/0"): "p.J#j/0", ("B#run/1", "j()#i/0"): "p.I#i/0",
        ("B#run/1", "b#a/0"): "p.A#a/0", ("B#run/1", "b.a()#f/1"): "p.A#f/1", ("B#run/1", "inner#a/0"): "p.A#a/0", ("B#run/1", "inner.a()#f/1"): "p.A#f/1", ("B#run/1", "A#s/0"): "p.A#s/0", ("B#run/1", "b#zz/0"): "UNSOLVED", ("B#run/1", "toString/0"): "EXTERNAL",
        ("C#run/0", "a/0"): "q.C#a/0", ("C#run/0", "a()#f/1"): "q.B#f/1", ("C#run/0", "super#a/0"): "p.A#a/0", ("C#run/0", "super.a()#a/0"): "p.A#a/0", ("C#run/0", "C/0"): "EXTERNAL", ("C#run/0", "new C()#run/0"): "q.C#run/0", ("C#run/0", "C/1"): "EXTERNAL", ("C#run/0", "this.inner#a/0"): "p.A#a/0",
        ("D#run2/0", "run/0"): "q.C#run/0", ("D#run2/0", "f/1"): "q.B#f/1", ("D#run2/0", "a/0"): "q.C#a/0", ("D#run2/0", "a()#run/0"): "q.C#run/0",
        ("Loop1#f/0", "g/0"): "Loop2#g/0", ("Loop1#f/0", "h/0"): "UNSOLVED",
    }


def test_overloads_are_ranked_by_arguments(spark):
    edges = _edges(_units(
        spark,
        "package p; class Animal {} class Dog extends Animal {} class Plant {} class R1 { void one() {} } class R2 { void two() {} }",
        "package p; class Base { R1 f(Plant p) { return null; } R1 g(String s) { return null; } }",
        "package p; class Sub extends Base { R2 f(Animal a) { return null; } R2 g(int n) { return null; } void run(Dog d) { f(d).two(); f(new Plant()).one(); g(\"s\").one(); g(1).two(); g(true ? 1 : 2).two(); } }",
    ))
    assert edges["Sub#run/1", "f/1"] in ("p.Sub#f/1", "p.Base#f/1")  # one text, two calls
    want = {"f(d)#two/0": "p.R2#two/0", "f(new Plant())#one/0": "p.R1#one/0", 'g("s")#one/0': "p.R1#one/0", "g(1)#two/0": "p.R2#two/0"}
    assert {k: edges["Sub#run/1", k] for k in want} == want


def test_names_mean_the_nearest_scope(spark):
    units = _units(
        spark,
        "package a; public class X { public static class In {} }", "package b; public class X {}", "package c; public class X {} class Y {}",
        "package d; import a.X; import c.*; class P extends X implements X.In, Y {} class Z extends d.e.W {}",
        "package b; class Q extends X { class X {} class R extends X {} } class S extends a.X {}",
        "package c; import java.util.*; class T extends List<X> {} class V extends x.y.X {} class U<X2> extends Missing {}",
        "package e; import other.X; import b.*; class N extends X {}",
    )
    got = {(r.sub_key, r.super_raw): r.super_key for r in java.resolved_supers(units).collect()}
    assert got == {("d.P", "X"): "a.X", ("d.P", "X.In"): "a.X.In", ("d.P", "Y"): "c.Y", ("d.Z", "d.e.W"): None, ("b.Q", "X"): "b.X", ("b.Q.R", "X"): "b.Q.X", ("b.S", "a.X"): "a.X", ("c.T", "List<X>"): None, ("c.V", "x.y.X"): None, ("c.U", "Missing"): None, ("e.N", "X"): None}


def test_nothing_to_resolve(spark):
    units = _units(spark, "package p; class Empty {}", "class Bad {")
    assert java.resolved_calls(units).count() == 0 and java.resolved_supers(units).count() == 0
    assert {(r.path, r.parsed_ok) for r in units.collect()} == {("F0.java", True), ("F1.java", False)}
    assert java.resolved_calls(units.limit(0)).count() == 0


@pytest.fixture()
def checkout(tmp_path):
    for path, text in {"src/main/java/com/x/Service.java": JAVA, "src/main/java/com/x/Repo.java": "package com.x;\npublic class Repo { void save(String s) {} }\n", "target/src/main/java/Gen.java": "class Gen {}", "node_modules/a.js": "x", "README.md": "# t\n" * 130, "app.yml": "a: 1\n", "yarn.lock": "x", "bad.txt": b"\xff\xfe\x00", "big.json": "y" * 3000}.items():
        to = tmp_path / "repo" / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path / "repo")


def test_scan_and_build(spark, checkout, tmp_path):
    found = files.scanned(spark, checkout)
    assert [r.path for r in files.java_files(found).collect()] == ["src/main/java/com/x/Repo.java", "src/main/java/com/x/Service.java"]
    text = {r.path: r for r in files.text_files(found, max_kb=1).collect()}
    assert set(text) == {"README.md", "app.yml", "bad.txt", "big.json"} and text["big.json"].parse_error == "over 1 KB" and text["bad.txt"].parse_error == "not UTF-8"
    tables, orphans = store.built(spark, checkout, 5)
    tables = {k: v.cache() for k, v in tables.items()}
    assert orphans.count() == 0
    edges = {(r.callee_raw, r.resolved) for r in tables["call_edge"].collect()}
    assert ("repo#save/1", True) in edges and any(not ok for _, ok in edges)
    prints = [evaluation.fingerprint(t["symbol"], t["source_file"]).first() for t in (tables, store.built(spark, checkout, 6)[0])]
    assert prints[0] == prints[1]
    kinds = {r.kind for r in tables["chunk"].collect()}
    assert kinds == {"SYMBOL", "FILE_HEADER", "TEXT"} and tables["chunk"].where("file_path = 'README.md'").count() == 3
    base = str(tmp_path / "index")
    store.store(tables, base)
    store.store({k: v.withColumn("repo_id", F.lit(6).cast("long")) for k, v in tables.items()}, base)
    store.store(tables, base)
    back = spark.read.parquet(f"{base}/symbol")
    assert back.where("repo_id = 5").count() == back.where("repo_id = 6").count() == tables["symbol"].count()
    assert store.without_repo(back, 5).where("repo_id = 5").isEmpty() and store.rollup(tables).first()["file_count"] == 6
    members = tables["symbol"].where("parent_key is not null and parent_id is null")
    assert members.isEmpty()
    tools = control.repository_tools(tables["symbol"].withColumn("start_line", F.col("start_line").cast("long")), tables["source_file"], tables["call_edge"].withColumn("resolved", F.col("resolved").cast("int")), tables["type_relation"], tables["chunk"])
    rows, miss = tools.call("find_callers", {"name": "Service.helper"})
    assert not miss and rows.count() == 1
    assert tools.call("nope")[0] is None and tools.call("findDefinition", '{"name": "Missing"}')[1]
    assert "2: " in tools.call("read-symbol", {"name": "Repo#save"})[0].first()["text"]


def test_landing_steps(tmp_path):
    assert files.archive_url("https://github.com/a/b.git") == "https://codeload.github.com/a/b/zip/HEAD"
    for bad in ("http://github.com/a/b", "https://example.com/a/b", "https://github.com/a"):
        with pytest.raises(ValueError):
            files.archive_url(bad)

    def packed(names):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for n in names:
                z.writestr(n, "x" * 10)
        return data.getvalue()

    assert files.fetched("https://github.com/a/b", str(tmp_path / "z"), lambda u: packed(["top/a.txt", "top/s/b.txt"])) == ["a.txt", "s/b.txt"]
    with pytest.raises(ValueError):
        files.extracted(packed(["../evil.txt", "a/b"]), str(tmp_path / "y"))
    with pytest.raises(ValueError):
        files.extracted(packed(["a", "b"]), str(tmp_path / "x"), limit=15)
    (tmp_path / "g/.git/refs").mkdir(parents=True)
    (tmp_path / "g/.git/HEAD").write_text("ref: refs/m\n")
    (tmp_path / "g/.git/refs/m").write_text("abc\n")
    assert files.commit_hash(str(tmp_path / "g")) == "abc" and files.commit_hash(str(tmp_path)) is None


def test_file_window(spark):
    f = spark.createDataFrame([("a.txt", "\n".join(map(str, range(1000))), "h")], "path string, content string, content_hash string")
    rows = chunks.window(f, "a.txt", 5).collect()
    assert len(rows) == 400 and rows[0].line == 5 and rows[0].changed
    with pytest.raises(ValueError):
        chunks.window(f, "../a.txt")


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "2024-01-01 00:00:00", "QUEUED", 0, 10, ""), (1, "2024-01-01 00:01:00", "RUNNING", 5, 10, ""), (2, "2024-01-01 00:00:00", "QUEUED", 0, 0, "")]
    schema = "job_id long, at string, status string, done long, total long, message string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    ledger.append(ledger.answers(spark, src, schema), out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    ledger.job_states(ledger.answers(spark, src, schema), str(tmp_path / "jobs"), str(tmp_path / "c2")).awaitTermination()
    last = sorted(os.listdir(tmp_path / "jobs"))[-1]
    assert {(r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "jobs" / last)).collect()} == {(1, "RUNNING"), (2, "QUEUED")}
    timed = ledger.answers(spark, src, schema).withColumn("at", F.to_timestamp("at")).withColumn("mode", F.col("status")).withColumn("refused", F.lit(0))
    assert ledger.first_answers(timed, "job_id", "at").isStreaming and ledger.usage_by_hour(timed, "at").columns == ["hour", "mode", "n", "refusals"]
    good, bad = ledger.split_bad(spark.createDataFrame([('{"a": 1}',), ("x",)], "v string"), "v", "a int")
    assert good.count() == 1 and bad.count() == 1


def test_component_rows_and_text():
    def broken():
        raise RuntimeError("down")

    assert control.component_status({"a": lambda: "fine", "b": broken}) == [("a", True, "fine"), ("b", False, "RuntimeError: down")]
    assert "and 1 more" in control.summary_text("r", {"files": 1, "symbols": 2}, list("abcdefghi"), ["h"])


def test_store_helpers(spark):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    assert store.with_columns(df, {"kind": F.lit("JAVA")}).first()["kind"] == "JAVA"
    assert control.latest(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k long, t long, v string"), ["k"], "t").first()["v"] == "b"


def _rows_of_joins(df):
    """The rows that each join of an executed plan made."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().length())]
    return out


def test_equal_references_are_resolved_once(spark):
    n = 300
    symbols = spark.createDataFrame([(k, "same", f"a.T{k % 9}#same/0", "METHOD", k % 9) for k in range(n)], "id long, name string, qualified_name string, kind string, parent_id long")
    refs = symbols.select("id", F.lit(" `same()` ").alias("ref")).unionByName(spark.createDataFrame([(-1, None), (-2, "a.T3#same/0")], "id long, ref string"))
    got = ranking.resolved_refs(refs, symbols)
    rows = {r.id: (r.tier, r.symbol_ids, r.ambiguous) for r in got.collect()}
    assert len(rows) == n + 1 and rows[7] == (3, "0,1,2,3,4,5", True) and rows[-2][0] == 1
    assert max(_rows_of_joins(got)) <= 2 * n  # not n * n


def test_files_are_parsed_in_many_tasks_and_once(spark, sf_dir):
    r = Repo(spark, sf_dir)
    for made in (index_queries._files(r), index_queries._shapes(r)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for name in ("c6_resolved_calls", "c8_imports", "c8_type_relations"):
        assert "MapInArrow" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_reverse_search_joins_a_call_once_for_many_seeds(spark):
    from prismata.operators import graph

    n = 150
    calls = spark.createDataFrame([(a, 10_000 + b, 7 + b % 3) for a in range(n) for b in range(40)] + [(a + 1, a, 5) for a in range(n - 1)] + [(3, None, None)], "callee_symbol_id long, caller_symbol_id long, call_line long")
    seeds = spark.createDataFrame([(k,) for k in range(n)], "seed long")
    got = {(x.seed, x.node): x.hops for x in graph.reverse_search(calls, seeds, 2).collect()}
    want = {(a, 10_000 + b): 1 for a in range(n) for b in range(40)} | {(a, a - d): d for a in range(n) for d in (1, 2) if a >= d}
    assert got == want
    # all seeds reach one hub: its callers meet it once, not once for each seed
    hub = spark.createDataFrame([(k, 5_000, 1) for k in range(n)] + [(5_000, 10_000 + b, 1) for b in range(40)], calls.schema)
    told = graph.chain_only(hub, seeds, 2)
    assert {(x.truth, x.direct, x.chain) for x in told.collect()} == {(41, 1, 40)}
    assert max(_rows_of_joins(told)) <= 3 * hub.count()


def _symbols_named(spark, names, each):
    """`each` methods of every name, and a type."""
    rows = [(1, 0, "CLASS", "Owner", "p.Owner", None, 1)] + [(1000 * (k + 1) + i, 0, "METHOD", n, f"p.Owner#{n}/{i}", 1, i) for k, n in enumerate(names) for i in range(each)]
    return spark.createDataFrame(rows, "id long, file_id long, kind string, name string, qualified_name string, parent_id long, start_line long")


def test_answers_of_many_questions_are_spelled_out_last(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELL_QUESTIONS", 4)
    monkeypatch.setattr(ranking, "CELL_EVIDENCE", 3)
    symbols = _symbols_named(spark, ["alpha", "beta"], 20)
    questions = spark.createDataFrame([(k, f"who calls {'alpha' if k % 2 else 'beta'}") for k in range(30)] + [(90, "where is alpha defined"), (91, "what does alpha call")], "id long, text string")
    source = spark.createDataFrame([(0, "a.java")], "id long, path string")
    calls = spark.createDataFrame([(2000 + i, 1000, 7 * i) for i in range(20)] * 2, "caller_symbol_id long, callee_symbol_id long, call_line long")
    none = spark.createDataFrame([], "sub_symbol_id long, super_symbol_id long")
    before = [spark.conf.get(f"spark.sql.{k}autoBroadcastJoinThreshold", None) for k in ("", "adaptive.")]
    out = ranking.answers(questions, symbols, source, calls, none)
    assert [spark.conf.get(f"spark.sql.{k}autoBroadcastJoinThreshold", None) for k in ("", "adaptive.")] == before
    assert "explode(ids" in out._jdf.queryExecution().toString()
    want = [(k, "CALLERS", "a.java", 7 * i, f"p.Owner#beta/{i}") for k in range(1, 30, 2) for i in range(20)] + [(k, "CALLERS", "a.java", 0, "p.Owner#beta/0") for k in range(0, 30, 2)]
    want += [(90, "LOCATE", "a.java", i, f"p.Owner#alpha/{i}") for i in range(20)] + [(91, "CALLEES", "a.java", 0, "p.Owner#alpha/0")]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_a_file_of_routed_targets_keeps_each_list_once(spark, tmp_path):
    names = [f"name{chr(97 + k // 8)}{chr(97 + k % 8)}" for k in range(64)]
    questions = spark.createDataFrame([(k, f"where is {names[k * 7 % 64]} defined") for k in range(1280)], "id long, text string")
    at = str(tmp_path / "routed")
    symbols = spark.createDataFrame([(n,) for n in names], "name string").crossJoin(spark.range(2500)).select((F.xxhash64("name", "id") % (1 << 40)).alias("id"), F.lit("METHOD").alias("kind"), "name", F.concat(F.lit("p.A#"), "name").alias("qualified_name"), F.lit(1).cast("long").alias("parent_id"))
    ranking.routed(questions, symbols).write.parquet(at)
    whole = spark.read.parquet(at).agg(F.sum(F.length("target_ids"))).first()[0]
    stored = sum(f.stat().st_size for f in (tmp_path / "routed").glob("*.parquet"))
    assert whole > 30e6 and stored < whole / 10


def test_heavy_lists_of_targets_meet_their_questions_in_tasks_of_their_own(spark, monkeypatch):
    symbols = _symbols_named(spark, ["alpha", "beta"], 50)
    questions = spark.createDataFrame([(k, ("who calls alpha", "where is beta defined", "an overview", "where is Owner defined")[k % 4]) for k in range(400)], "id long, text string")
    light = sorted(map(tuple, ranking.routed(questions, symbols).collect()))
    monkeypatch.setattr(ranking, "HEAVY_BYTES", 1000)
    monkeypatch.setattr(ranking, "TASK_BYTES", 5000)
    out = ranking.routed(questions, symbols)
    assert sorted(map(tuple, out.collect())) == light and len(light) == 400
    one = out.where("length(target_ids) > 1").groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("target_ids").alias("lists"), F.sum(F.length("target_ids")).alias("bytes")).collect()
    assert len(one) == 10 and {r.lists for r in one} == {1} and max(r.bytes for r in one) < 10_000


def _plans(monkeypatch):
    """Plans of what java.py checkpoints and of the tables written as Parquet, as made before they run."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, kept, put = {"checkpoint": [], "table": []}, java.checkpointed, DataFrameWriter.parquet
    said = lambda kind, df: plans[kind].append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(java, "checkpointed", lambda df: (said("checkpoint", df), kept(df))[1])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (said("table", self._df), put(self, *a, **b))[1])
    return plans


def test_calls_are_resolved_without_broadcasts_by_estimate(spark, sf_dir, monkeypatch):
    plans = _plans(monkeypatch)
    QUERIES["c6_hierarchy"](spark, sf_dir)
    assert len(plans["checkpoint"]) > 8 and not any("BroadcastHashJoin" in p for p in plans["checkpoint"])


def test_tables_are_committed_without_broadcasts_by_estimate(spark, sf_dir, monkeypatch):
    plans = _plans(monkeypatch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    QUERIES["b7_committed"](spark, sf_dir)
    assert len(plans["table"]) == 5 and not any("BroadcastHashJoin" in p for p in plans["table"])
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before != "-1"
