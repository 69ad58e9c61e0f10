"""The indexing dataflow over made-up checkouts: Java files for each supplier, from one
template (T), and from three that use each other and more of the language (shapes)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import checkpointed, shared_folder
from ..sources import java, store
from ..sources.projection import Repo
from .registry import query

#: The text of file T<i>; the next file's type is its dependency. `|` ends a line.
LINES = (
    "package com.acme;", "/* class Not { void no() {} } */", "public class T# extends Base# implements Api, T@.Hook {", "  private final T@ dep = new T@(\"{\");", "  public T#(String s) { super(); }",
    "  public static int run(int a, String b) {", "    dep.go(a, \"x, y\"); // dep.no()", "    helper();", "    missing(a);", "    return new T@(b).size();", "  }",
    "  void go(int a, String b) { this.helper(); }", "  private void helper() {", "  }", "  interface Hook { void hook(); }", "}", "",
)
I, NEXT = "CAST(s_suppkey AS VARCHAR)", "CAST(s_suppkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS VARCHAR)"
FILES = f"SELECT s_suppkey AS i, {I} AS a, {NEXT} AS b, concat('src/main/java/com/acme/T', {I}, '.java') AS path FROM supplier"


def _dealt(r: Repo) -> DataFrame:
    """The suppliers' keys over all tasks: the table is a small file, but each row becomes files that are parsed."""
    spread = max(r.spark.sparkContext.defaultParallelism, int(r.spark.conf.get("spark.sql.shuffle.partitions")))
    return r.supplier.select("s_suppkey").repartition(spread, "s_suppkey")


def _files(r: Repo) -> DataFrame:
    """(path, content as bytes); every tenth file is no UTF-8."""
    last = r.supplier.agg(F.max("s_suppkey").alias("n"))
    s = _dealt(r).join(F.broadcast(last))
    own, other = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % F.col("n") + 1).cast("string")
    text = F.replace(F.replace(F.lit("\n".join(LINES)), F.lit("#"), own), F.lit("@"), other)
    bad = F.concat(F.lit(b"\xff"), text.cast("binary"))
    return s.select(F.concat(F.lit("src/main/java/com/acme/T"), own, F.lit(".java")).alias("path"), F.when(F.col("s_suppkey") % 10 == 0, bad).otherwise(text.cast("binary")).alias("content"))


def _units(r: Repo) -> DataFrame:
    return java.parsed(_files(r))


def _joined(units: DataFrame) -> DataFrame:
    """Outlines that several joins read: files are parsed once, not again for each of them."""
    return checkpointed(units)


@query("a6_decoded_files", f"SELECT path, i % 10 <> 0 AS parsed_ok, CASE WHEN i % 10 <> 0 THEN 16 ELSE 0 END AS loc FROM ({FILES})")
def _(r: Repo) -> DataFrame:
    return _units(r).select("path", "parsed_ok", "loc")


GOOD = f"g AS ({FILES} WHERE s_suppkey % 10 <> 0)"
SYMBOLS = """SELECT path, 'CLASS' AS kind, concat('com.acme.T', a) AS key, CAST(NULL AS VARCHAR) AS parent, 3 AS first, 16 AS last, 'public' AS modifiers FROM g
UNION ALL SELECT path, 'FIELD', concat('com.acme.T', a, '.dep'), concat('com.acme.T', a), 4, 4, 'private final' FROM g
UNION ALL SELECT path, 'CONSTRUCTOR', concat('com.acme.T', a, '#<init>/1'), concat('com.acme.T', a), 5, 5, 'public' FROM g
UNION ALL SELECT path, 'METHOD', concat('com.acme.T', a, '#run/2'), concat('com.acme.T', a), 6, 11, 'public static' FROM g
UNION ALL SELECT path, 'METHOD', concat('com.acme.T', a, '#go/2'), concat('com.acme.T', a), 12, 12, '' FROM g
UNION ALL SELECT path, 'METHOD', concat('com.acme.T', a, '#helper/0'), concat('com.acme.T', a), 13, 14, 'private' FROM g
UNION ALL SELECT path, 'INTERFACE', concat('com.acme.T', a, '.Hook'), concat('com.acme.T', a), 15, 15, '' FROM g
UNION ALL SELECT path, 'METHOD', concat('com.acme.T', a, '.Hook#hook/0'), concat('com.acme.T', a, '.Hook'), 15, 15, '' FROM g"""


def _symbols(r: Repo, *kinds: str) -> DataFrame:
    own = java.symbol_rows(_units(r)).where(F.col("kind").isin(*kinds))
    return own.select("path", "kind", F.col("qualified_name").alias("key"), F.col("parent_key").alias("parent"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), "modifiers")


@query("c3_types", f"WITH {GOOD}, s AS ({SYMBOLS}) SELECT * FROM s WHERE kind IN ('CLASS', 'INTERFACE')")
def _(r: Repo) -> DataFrame:
    return _symbols(r, "CLASS", "INTERFACE")


@query("c4_callables", f"WITH {GOOD}, s AS ({SYMBOLS}) SELECT * FROM s WHERE kind IN ('METHOD', 'CONSTRUCTOR')")
def _(r: Repo) -> DataFrame:
    return _symbols(r, "METHOD", "CONSTRUCTOR")


@query("c5_fields", f"WITH {GOOD}, s AS ({SYMBOLS}) SELECT * FROM s WHERE kind = 'FIELD'")
def _(r: Repo) -> DataFrame:
    return _symbols(r, "FIELD")


#: Calls of run/2 and go/2; the file of the dependency may be one that could not be read.
CALLS = """x AS (SELECT g.*, (SELECT count(*) FROM g h WHERE h.a = g.b) > 0 AS there FROM g),
e AS (SELECT path, concat('com.acme.T', a, '#run/2') AS caller, CASE WHEN there THEN concat('com.acme.T', b, '#go/2') END AS callee, 7 AS line FROM x
UNION ALL SELECT path, concat('com.acme.T', a, '#run/2'), concat('com.acme.T', a, '#helper/0'), 8 FROM x
UNION ALL SELECT path, concat('com.acme.T', a, '#run/2'), NULL, 9 FROM x
UNION ALL SELECT path, concat('com.acme.T', a, '#run/2'), CASE WHEN there THEN concat('com.acme.T', b, '#<init>/1') END, 10 FROM x
UNION ALL SELECT path, concat('com.acme.T', a, '#run/2'), NULL, 10 FROM x
UNION ALL SELECT path, concat('com.acme.T', a, '#go/2'), concat('com.acme.T', a, '#helper/0'), 12 FROM x)"""


def _calls(r: Repo) -> DataFrame:
    return java.resolved_calls(_joined(_units(r))).select("path", F.col("caller_key").alias("caller"), F.col("callee_key").alias("callee"), F.col("call_line").alias("line"))


@query("c6_resolved_calls", f"WITH {GOOD}, {CALLS} SELECT * FROM e")
def _(r: Repo) -> DataFrame:
    return _calls(r)


@query("c7_inside_and_outside", f"WITH {GOOD}, {CALLS} SELECT callee IS NOT NULL AS inside, count(*) AS n FROM e GROUP BY 1")
def _(r: Repo) -> DataFrame:
    return _calls(r).groupBy(F.col("callee").isNotNull().alias("inside")).agg(F.count("*").alias("n"))


@query("c8_type_relations", f"""WITH {GOOD} SELECT concat('com.acme.T', a) AS sub, concat('Base', a) AS super, CAST(NULL AS VARCHAR) AS target, 'EXTENDS' AS kind FROM g
UNION ALL SELECT concat('com.acme.T', a), 'Api', NULL, 'IMPLEMENTS' FROM g
UNION ALL SELECT concat('com.acme.T', a), concat('T', b, '.Hook'), CASE WHEN (SELECT count(*) FROM g h WHERE h.a = g.b) > 0 THEN concat('com.acme.T', b, '.Hook') END, 'IMPLEMENTS' FROM g""")
def _(r: Repo) -> DataFrame:
    return java.resolved_supers(_joined(_units(r))).select(F.col("sub_key").alias("sub"), F.col("super_raw").alias("super"), F.col("super_key").alias("target"), "kind")


#: Three files a supplier: a base class, its user, and a helper that shares a name with a class of the user's package.
SHAPES = {
    "src/main/java/com/shapes/base#/Base#.java": """package com.shapes.base#;
/** Base of # (see {@link Use#}). */
@SuppressWarnings({"unused", "}"})
public abstract class Base# implements com.shapes.other.Named, AutoCloseable {
  protected int[] sizes = {1, 2}, more[];
  static { System.out.println("not { a callable"); }
  public Base# self() { return this; }
  public Base# with(int n) { return n < 0 ? this : with(-n); }
  protected void inherited(Object o) { toString(); }
  protected static class Part { Base# whole() { return null; } }
}
""",
    "src/main/java/com/shapes/use#/Use#.java": """package com.shapes.use#;
import com.shapes.base#.Base#;
import com.shapes.other.Helper#;
import static com.shapes.other.Helper#.go;
public class Use# extends Base# implements Runnable {
  enum Mode { ON { int code() { return start(); } }, OFF; int code() { return start(); } static int start() { return 0; } }
  record Pair<A>(A a, String b) implements java.util.function.Supplier<A> { Pair { go(1); } public A get() { return a(); } }
  @interface Mark { String value() default "{"; int[] at() default {}; }
  private final Helper# helper = new Helper#();
  public Use#(int n) { super(); go(n); }
  public Use# with(String s) { return this; }
  Use# own() { return this; }
  public <T extends Comparable<T>> void generic(T t, java.util.Map<String, T>... rest) { inherited(t); }
  @Override
  public void run() {
    self().with(1).inherited(null);
    with("s").own();
    with(1)
      .self();
    Runnable r = () -> helper.help(1, (a, b) -> a.x());
    Runnable q = new Runnable() { public void run() { local(); helper.help("s", null); own(); } void local() {} };
    for (var p = new Pair<String>("a, b", "c"); p.get() != null;) { p.get().length(); }
    Mode.OFF.code(); // Mode.ON.code()
    go(2);
    super.with(3);
    new Part().whole().self();
    if (q instanceof Use# u && u.own() != null) u.<String>generic("x");
    missing.call();
    new Thread(this::own, String.valueOf('"')).start();
  }
}
class Helper# { void help(int n, Object o) {} }
""",
    "src/main/java/com/shapes/other/Helper#.java": """package com.shapes.other;
public class Helper# { public void help(int n, Runnable r) {} public void help(String s, Object o) {} public static void go(int n) {} }
interface Named extends Comparable<Named> { default String title() { return getClass().getName(); } }
""",
}
NAMED = "src/main/java/com/shapes/other/Helper#.java"
U, B, O = "com.shapes.use#.Use#", "com.shapes.base#.Base#", "com.shapes.other.Helper#"  # noqa: E741


def _shapes(r: Repo) -> DataFrame:
    """Three files a supplier; Named, of the first supplier's helper file only, is a type of all."""
    own = F.col("s_suppkey").cast("string")
    first = r.supplier.agg(F.min("s_suppkey").alias("f"))
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in SHAPES.items()])).alias("k")
    s = _dealt(r).join(F.broadcast(first)).select("s_suppkey", "f", kinds)
    text = F.when((F.col("k.p") == NAMED) & (F.col("s_suppkey") != F.col("f")), F.regexp_replace("k.t", r"interface Named.*\n", "")).otherwise(F.col("k.t"))
    return s.select(F.replace("k.p", F.lit("#"), own).alias("path"), F.replace(text, F.lit("#"), own).cast("binary").alias("content"))


def _rows(columns: str, rows: list[tuple], extra: list[tuple] = ()) -> str:
    """SQL: the rows for every supplier, `extra` for the first one; # is the supplier's number."""
    names = columns.split(", ")
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = lambda x: ", ".join("(" + ", ".join(map(said, v)) + ")" for v in x)
    put = ", ".join(c if isinstance(rows[0][k], int) else f"replace({c}, '#', {I}) AS {c}" for k, c in enumerate(names))
    sql = f"SELECT {put} FROM supplier, (VALUES {values(rows)}) AS v({columns})"
    return sql + (f" UNION ALL SELECT {put} FROM supplier, (VALUES {values(extra)}) AS v({columns}) WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)" if extra else "")


DECLARED = [
    ("CLASS", B, 3, 11, "public abstract class Base#"), ("FIELD", B + ".sizes", 5, 5, "protected int sizes"), ("FIELD", B + ".more", 5, 5, "protected int more"), ("METHOD", B + "#self/0".replace("#", "~"), 7, 7, "public Base# self()"),
    ("METHOD", B + "~with/1", 8, 8, "public Base# with(int)"), ("METHOD", B + "~inherited/1", 9, 9, "protected void inherited(Object)"), ("CLASS", B + ".Part", 10, 10, "protected static class Part"), ("METHOD", B + ".Part~whole/0", 10, 10, " Base# whole()"),
    ("CLASS", U, 5, 31, "public class Use#"), ("ENUM", U + ".Mode", 6, 6, " enum Mode"), ("METHOD", U + ".Mode~code/0", 6, 6, " int code()"), ("METHOD", U + ".Mode~start/0", 6, 6, "static int start()"),
    ("RECORD", U + ".Pair", 7, 7, " record Pair"), ("METHOD", U + ".Pair~get/0", 7, 7, "public A get()"), ("ANNOTATION", U + ".Mark", 8, 8, " annotation Mark"), ("FIELD", U + ".helper", 9, 9, "private final Helper# helper"),
    ("CONSTRUCTOR", U + "~<init>/1", 10, 10, "public <init>(int)"), ("METHOD", U + "~with/1", 11, 11, "public Use# with(String)"), ("METHOD", U + "~own/0", 12, 12, " Use# own()"), ("METHOD", U + "~generic/2", 13, 13, "public void generic(T, java.util.Map<String, T>...)"),
    ("METHOD", U + "~run/0", 14, 30, "public void run()"), ("CLASS", "com.shapes.use#.Helper#", 32, 32, " class Helper#"), ("METHOD", "com.shapes.use#.Helper#~help/2", 32, 32, " void help(int, Object)"),
    ("CLASS", O, 2, 2, "public class Helper#"), ("METHOD", O + "~help/2", 2, 2, "public void help(int, Runnable)"), ("METHOD", O + "~help/2", 2, 2, "public void help(String, Object)"), ("METHOD", O + "~go/1", 2, 2, "public static void go(int)"),
]
DECLARED_ONCE = [("INTERFACE", "com.shapes.other.Named", 3, 3, " interface Named"), ("METHOD", "com.shapes.other.Named~title/0", 3, 3, "default String title()")]
#: `~` is the sign between a type and its member; # is the supplier.
_KEYED = "SELECT kind, replace(key, '~', '#') AS key, first, last, signature FROM ({})"


@query("c4_syntax", _KEYED.format(_rows("kind, key, first, last, signature", DECLARED, DECLARED_ONCE)))
def _(r: Repo) -> DataFrame:
    own = java.symbol_rows(java.parsed(_shapes(r)))
    return own.select("kind", F.col("qualified_name").alias("key"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), "signature")


RUN = U + "~run/0"
EDGES = [
    (B + "~with/1", B + "~with/1", 8, "with/1", ""), (B + "~inherited/1", None, 9, "toString/0", "EXTERNAL"), (U + ".Mode~code/0", U + ".Mode~start/0", 6, "start/0", ""), (U + ".Pair~get/0", None, 7, "a/0", "EXTERNAL"),
    (U + "~<init>/1", O + "~go/1", 10, "go/1", ""), (U + "~generic/2", B + "~inherited/1", 13, "inherited/1", ""),
    (RUN, B + "~self/0", 16, "self/0", ""), (RUN, B + "~with/1", 16, "self()~with/1", ""), (RUN, B + "~inherited/1", 16, "self().with(1)~inherited/1", ""),
    (RUN, U + "~with/1", 17, "with/1", ""), (RUN, U + "~own/0", 17, "with(\"s\")~own/0", ""), (RUN, B + "~with/1", 18, "with/1", ""), (RUN, B + "~self/0", 19, "with(1)~self/0", ""),
    (RUN, O + "~help/2", 20, "helper~help/2", ""), (RUN, None, 20, "a~x/0", "UNSOLVED"),
    (RUN, None, 21, "Runnable/0", "EXTERNAL"), (RUN, None, 21, "local/0", "UNSOLVED"), (RUN, O + "~help/2", 21, "helper~help/2", ""), (RUN, U + "~own/0", 21, "own/0", ""),
    (RUN, None, 22, "Pair/2", "EXTERNAL"), (RUN, U + ".Pair~get/0", 22, "p~get/0", ""), (RUN, U + ".Pair~get/0", 22, "p~get/0", ""), (RUN, None, 22, "p.get()~length/0", "UNSOLVED"),
    (RUN, U + ".Mode~code/0", 23, "Mode.OFF~code/0", ""), (RUN, O + "~go/1", 24, "go/1", ""), (RUN, B + "~with/1", 25, "super~with/1", ""),
    (RUN, None, 26, "Part/0", "EXTERNAL"), (RUN, B + ".Part~whole/0", 26, "new Part()~whole/0", ""), (RUN, B + "~self/0", 26, "new Part().whole()~self/0", ""),
    (RUN, U + "~own/0", 27, "u~own/0", ""), (RUN, U + "~generic/2", 27, "u~generic/1", ""), (RUN, None, 28, "missing~call/0", "UNSOLVED"),
    (RUN, None, 29, "Thread/2", "EXTERNAL"), (RUN, None, 29, "String~valueOf/1", "EXTERNAL"), (RUN, None, 29, "new Thread(this::own, String.valueOf('\"'))~start/0", "EXTERNAL"),
]
EDGES_ONCE = [("com.shapes.other.Named~title/0", None, 3, "getClass/0", "EXTERNAL"), ("com.shapes.other.Named~title/0", None, 3, "getClass()~getName/0", "EXTERNAL")]


@query("c6_hierarchy", "SELECT replace(caller, '~', '#') AS caller, replace(callee, '~', '#') AS callee, line, replace(raw, '~', '#') AS raw, reason FROM (" + _rows("caller, callee, line, raw, reason", EDGES, EDGES_ONCE) + ")")
def _(r: Repo) -> DataFrame:
    edges = java.resolved_calls(_joined(java.parsed(_shapes(r))))
    return edges.select(F.col("caller_key").alias("caller"), F.col("callee_key").alias("callee"), F.col("call_line").alias("line"), F.col("callee_raw").alias("raw"), F.coalesce("reason", F.lit("")).alias("reason"))


RELATIONS = [(B, "com.shapes.other.Named", "com.shapes.other.Named", "IMPLEMENTS"), (B, "AutoCloseable", None, "IMPLEMENTS"), (U, "Base#", B, "EXTENDS"), (U, "Runnable", None, "IMPLEMENTS"), (U + ".Pair", "java.util.function.Supplier<A>", None, "IMPLEMENTS")]


@query("c8_imports", _rows("sub, super, target, kind", RELATIONS, [("com.shapes.other.Named", "Comparable<Named>", None, "EXTENDS")]))
def _(r: Repo) -> DataFrame:
    return java.resolved_supers(_joined(java.parsed(_shapes(r)))).select(F.col("sub_key").alias("sub"), F.col("super_raw").alias("super"), F.col("super_key").alias("target"), "kind")


@query("b7_committed", """SELECT 'source_file' AS name, 3 * count(*) AS n FROM supplier UNION ALL SELECT 'symbol', 27 * count(*) + 2 FROM supplier
UNION ALL SELECT 'call_edge', 35 * count(*) + 2 FROM supplier UNION ALL SELECT 'type_relation', 5 * count(*) + 1 FROM supplier UNION ALL SELECT 'orphans', 0""")
def _(r: Repo) -> DataFrame:
    """The shapes' index, committed as one version and read back through its manifest."""
    files = checkpointed(_shapes(r))
    sources = files.select("path", F.col("content").cast("string").alias("content"))
    text = r.spark.createDataFrame([], "path string, content_hash string, loc long, parsed_ok boolean, parse_error string, content string")
    tables, orphans = store.assembled(checkpointed(java.parsed(files)), sources, text, 7)
    base = f"{shared_folder(r.spark)}/store-{uuid.uuid4().hex}"
    manifest = store.commit(tables, orphans, base, 7)
    pinned = store.Pinned(r.spark, base)
    counts = [pinned.table(t).groupBy(F.lit(t).alias("name")).agg(F.count("*").alias("n")) for t in ("source_file", "symbol", "call_edge", "type_relation")]
    out = r.spark.range(1).select(F.lit("orphans").alias("name"), F.lit(manifest["orphan_edge_count"]).cast("long").alias("n"))
    for c in counts:
        out = out.unionByName(c)
    return out
