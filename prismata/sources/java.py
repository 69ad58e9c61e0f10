"""From Java files to symbols, supertypes and calls: one narrow pass a file, then joins.

parsed() outlines each file by itself (java_syntax.py); a failure is an outcome row. What a
name means is decided by joins over all files:

- a type name by ranked scopes (enclosing types, single imports, own package, wildcard
  imports, a full name): every scope proposes one key, and the least rank that exists wins;
- the ancestors of a type by doubling paths of the supertype relation;
- a member by the nearest ancestor that has it, overloads by what the arguments show. Calls
  go round by round: a round types the receivers of the next link of a chain.

What cannot be told stays an unresolved edge with its reason: EXTERNAL where the receiver
is a type of the platform or the member comes from one, else UNSOLVED.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_type
from ..operators.checkpoints import checkpointed, measured_joins
from .java_syntax import Outline

#: Types of java.lang, and the members that every object, or an enum, has.
PLATFORM = "Object String Integer Long Double Float Short Byte Character Boolean Number Math System Thread Runnable Iterable Comparable CharSequence Exception RuntimeException IllegalArgumentException IllegalStateException UnsupportedOperationException NullPointerException Error Throwable StringBuilder StringBuffer Class Enum Record Void Process Runtime AutoCloseable Cloneable ThreadLocal".split()
OBJECT_MEMBERS = "toString equals hashCode getClass notify notifyAll wait clone finalize".split()
ENUM_MEMBERS = "values valueOf name ordinal compareTo getDeclaringClass".split()
#: What a value of the left type may be passed as, nearest first.
PASSES = {
    "int": "int long float double Integer Number", "long": "long float double Long Number", "short": "short int long float double Short Number", "byte": "byte short int long float double Byte Number", "char": "char int long float double Character",
    "float": "float double Float Number", "double": "double Double Number", "boolean": "boolean Boolean", "String": "String CharSequence Comparable Serializable",
}
SYMBOL = "struct<kind:string,name:string,qualified_name:string,parent_key:string,start_line:int,end_line:int,modifiers:string,signature:string,return_type:string,javadoc:string,type_name:string,params:array<string>,varargs:boolean>"
NODE = "struct<id:int,caller_key:string,owner:string,levels:array<string>,base:string,ref:string,on_node:int,name:string,arity:int,args:array<string>,call_line:int,call_kind:string,raw:string,depth:int>"
SCHEMA = (
    "path string, loc long, parsed_ok boolean, parse_error string, content_hash string, package string, "
    f"symbols array<{SYMBOL}>, supers array<struct<sub_key:string,super_raw:string,super_name:string,kind:string>>, imports array<struct<name:string,wildcard:boolean,static:boolean>>, implied array<struct<owner:string,name:string,arity:int,type_name:string>>, nodes array<{NODE}>"
)
#: Files, and their bytes, whose outcomes are handed on together.
AT_ONCE, AT_ONCE_BYTES = 64, 1 << 20
#: Ranks of scopes; enclosing types come first, the innermost at 0.
IMPORTED, SAME_PACKAGE, ON_DEMAND, FULL = 100, 200, 300, 400


def parsed(files: DataFrame) -> DataFrame:
    """files: path, content (binary) -> one outcome row a file, with what was found in it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def outcome(path: str, content: bytes) -> dict:
        row = {"path": path, "loc": 0, "parsed_ok": False, "content_hash": "", "package": "", "symbols": [], "supers": [], "imports": [], "implied": [], "nodes": []}
        try:
            source = content.decode("utf-8")
            row |= {"loc": source.count("\n") + (not source.endswith("\n") and bool(source)), "content_hash": hashlib.sha256(content).hexdigest()}
            found = Outline(source)
        except Exception as e:  # noqa: BLE001
            return row | {"parse_error": f"{type(e).__name__}: {e}"[:500]}
        return row | {"parsed_ok": True, "package": found.package, "symbols": found.symbols, "supers": found.supers, "imports": found.imports, "implied": found.implied, "nodes": found.nodes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(outcome(path, bytes(content)))
                size += len(content)
                if len(held) >= AT_ONCE or size >= AT_ONCE_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def symbol_rows(units: DataFrame) -> DataFrame:
    own = units.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return own.drop("type_name", "params", "varargs")


def _simple(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def _types(units: DataFrame) -> DataFrame:
    own = units.select(F.explode("symbols").alias("s")).where(is_type(F.col("s.kind")))
    return own.groupBy(F.col("s.qualified_name").alias("key")).agg(F.min("s.kind").alias("kind"))


def named_types(units: DataFrame, refs: DataFrame) -> DataFrame:
    """refs: path, owner (the enclosing type, null at the top), raw -> distinct, with key or null, and outside.

    outside: no type of the repository, and the file shows that it is one of the platform.
    """
    files = units.select("path", "package", "imports")
    rows = refs.where("raw is not null").distinct().join(files, "path")
    raw, owner, package = F.col("raw"), F.coalesce("owner", F.lit("")), F.col("package")
    first = F.substring_index(raw, ".", 1)
    rest = F.substr(raw, F.length(first) + 1)
    scope = lambda rank, key: F.struct(rank.cast("int").alias("rank"), key.alias("key"))
    inner = F.when(package == "", owner).otherwise(F.substr(owner, F.length(package) + 2))
    levels = F.when(owner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"\."))
    prefix = lambda k: F.concat(F.when(package == "", "").otherwise(F.concat(package, F.lit("."))), F.array_join(F.slice(levels, F.lit(1), F.size(levels) - k), "."))
    depths = F.when(owner == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(levels) - 1))
    around = F.flatten(F.transform(depths, lambda k: F.array(scope(2 * k, F.concat(prefix(k), F.lit("."), raw)), scope(2 * k + 1, F.when(_simple(prefix(k)) == first, F.concat(prefix(k), rest))))))
    single = F.filter("imports", lambda i: ~i["wildcard"] & (_simple(i["name"]) == first))
    named = F.transform(single, lambda i: scope(F.lit(IMPORTED), F.concat(i["name"], rest)))
    near = F.array(scope(F.lit(SAME_PACKAGE), F.when(package == "", raw).otherwise(F.concat(package, F.lit("."), raw))))
    wild = F.transform(F.filter("imports", lambda i: i["wildcard"]), lambda i: scope(F.lit(ON_DEMAND), F.concat(i["name"], F.lit("."), raw)))
    full = F.array(scope(F.lit(FULL), F.when(raw.contains("."), raw)))
    later = F.when(F.size(single) > 0, named).otherwise(F.concat(near, wild, full))
    platform = lambda c: c.startswith("java.") | c.startswith("javax.")
    shown = F.when(F.size(single) > 0, F.exists(single, lambda i: platform(i["name"]))).otherwise(raw.isin(*PLATFORM, *PASSES) | platform(raw) | F.exists("imports", lambda i: i["wildcard"] & platform(i["name"])))
    rows = rows.select("path", "owner", "raw", shown.alias("outside"), F.filter(F.concat(around, later), lambda s: s["key"].isNotNull()).alias("scopes"))
    hits = rows.select("path", F.coalesce("owner", F.lit("")).alias("owner"), "raw", F.explode("scopes").alias("s")).select("path", "owner", "raw", "s.*")
    best = hits.join(_types(units).select("key"), "key").groupBy("path", "owner", "raw").agg(F.min_by("key", "rank").alias("key"))
    out = rows.select("path", F.coalesce("owner", F.lit("")).alias("owner"), "raw", "outside").join(best, ["path", "owner", "raw"], "left")
    return out.withColumn("outside", F.col("key").isNull() & F.col("outside"))


def _supers(units: DataFrame) -> DataFrame:
    parents = units.select(F.explode("symbols").alias("s")).where(is_type(F.col("s.kind"))).groupBy(F.col("s.qualified_name").alias("sub_key")).agg(F.max("s.parent_key").alias("owner"))
    raw = units.select("path", F.explode("supers").alias("s")).select("path", "s.*").join(parents, "sub_key").withColumn("owner", F.coalesce("owner", F.lit("")))
    found = named_types(units, raw.select("path", "owner", F.col("super_name").alias("raw"))).withColumnRenamed("raw", "super_name")
    return raw.join(found, ["path", "owner", "super_name"], "left")


def resolved_supers(units: DataFrame) -> DataFrame:
    """Supertypes with super_key, or external."""
    return _supers(units).select("sub_key", "super_raw", F.col("key").alias("super_key"), "kind", F.col("key").isNotNull().alias("resolved"), F.col("key").isNull().alias("external"))


def ancestors(units: DataFrame, supers: DataFrame) -> DataFrame:
    """(type, anc, iface, dist): itself and all supertypes; iface where the way leads over an interface.

    Paths double in length each round, so the rounds are the logarithm of the depth; a pair
    keeps its least way, so circles end as well.
    """
    types = _types(units)
    base = supers.where("key is not null").select(F.col("sub_key").alias("type"), F.col("key").alias("anc")).join(types.select(F.col("key").alias("anc"), (F.col("kind") == "INTERFACE").alias("iface")), "anc")
    base = base.select("type", "anc", "iface", F.lit(1).alias("dist"))
    ways = types.select(F.col("key").alias("type"), F.col("key").alias("anc"), F.lit(False).alias("iface"), F.lit(0).alias("dist")).unionByName(base)
    least = F.min(F.struct("iface", "dist")).alias("way")
    short = lambda df: df.groupBy("type", "anc").agg(least).select("type", "anc", "way.*")
    ways, total = checkpointed(short(ways)), -1
    while (n := ways.agg(F.count("*"), F.sum("dist")).first()) != total:
        total = n
        further = ways.select(F.col("type").alias("anc"), F.col("anc").alias("_a"), F.col("iface").alias("_i"), F.col("dist").alias("_d"))
        ways = checkpointed(short(ways.join(further, "anc").select("type", F.col("_a").alias("anc"), (F.col("iface") | F.col("_i")).alias("iface"), (F.col("dist") + F.col("_d")).alias("dist"))))
    return ways


def _members(units: DataFrame, scope: DataFrame) -> DataFrame:
    """(owner, name, arity, key, params, varargs, type, outside): fields have arity -1."""
    own = units.select("path", F.explode("symbols").alias("s")).select("path", "s.*").where(F.col("kind").isin("METHOD", "CONSTRUCTOR", "FIELD"))
    field = F.col("kind") == "FIELD"
    own = own.select("path", F.col("parent_key").alias("owner"), F.when(F.col("kind") == "CONSTRUCTOR", "<init>").otherwise(F.col("name")).alias("name"), F.when(field, -1).otherwise(F.size("params")).alias("arity"), F.col("qualified_name").alias("key"), "params", F.coalesce("varargs", F.lit(False)).alias("varargs"), F.col("type_name").alias("raw"))
    # enum constants and record components are members without a symbol
    implied = units.select("path", F.explode("implied").alias("s")).select("path", "s.*").withColumnRenamed("type_name", "raw")
    own = own.unionByName(implied.withColumn("varargs", F.lit(False)), allowMissingColumns=True)
    return own.join(scope, ["path", "owner", "raw"], "left").select("owner", "name", "arity", F.col("key").alias("member"), "params", "varargs", F.col("type_key").alias("result"), F.coalesce("outside", F.lit(False)).alias("result_outside"))


def _starts(units: DataFrame, nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """(path, id, level, type, outside, least distance): where the search for a first link begins."""
    none = F.lit(None).cast("string")
    place = lambda level, key, raw: F.struct(F.lit(level).cast("int").alias("level") if isinstance(level, int) else level.cast("int").alias("level"), key.alias("key"), raw.alias("raw"))
    of = lambda x: (F.when(x.startswith("="), F.substr(x, F.lit(2))), F.when(x.startswith("~"), F.substr(x, F.lit(2))))
    outer = lambda i, x: F.transform(F.sequence(F.lit(0), F.size(F.split(x, r"\.")) - 1), lambda k: place(100 * i + k, F.when(x.startswith("="), F.substr(F.array_join(F.slice(F.split(x, r"\."), F.lit(1), F.size(F.split(x, r"\.")) - k), "."), F.lit(2))), F.when((k == 0) & x.startswith("~"), F.substr(x, F.lit(2)))))
    lexical = F.flatten(F.transform("levels", lambda x, i: outer(i, x)))
    static = F.transform(F.filter("imports", lambda i: i["static"] & (i["wildcard"] | (_simple(i["name"]) == F.col("name")))), lambda i: place(1 << 20, F.when(i["wildcard"], i["name"]).otherwise(F.substr(i["name"], F.lit(1), F.length(i["name"]) - F.length(_simple(i["name"])) - 1)), none))
    first = F.element_at("levels", 1)
    places = F.when(F.col("base") == "LEXICAL", F.concat(lexical, static)).when(F.col("base").isin("THIS", "SUPER"), F.array(place(0, *of(first)))).when(F.col("base") == "TYPE", F.array(place(0, none, F.col("ref"))))
    rows = nodes.where("depth = 0").join(units.select("path", "imports"), "path").withColumn("p", F.explode(places)).select("path", "id", "owner", (F.col("base") == "SUPER").cast("int").alias("beyond"), "p.*").where("key is not null or raw is not null")
    rows = rows.join(scope, ["path", "owner", "raw"], "left")
    return rows.select("path", "id", "level", "beyond", F.coalesce("key", "type_key").alias("type"), F.coalesce("outside", F.lit(False)).alias("outside"))


def _passes(nodes: DataFrame, scope: DataFrame, ways: DataFrame) -> DataFrame:
    """(path, id, fits): for each argument of a known type what it may be passed as, nearest first."""
    known = nodes.where(F.exists("args", lambda a: a.isNotNull())).select("path", "id", "owner", F.posexplode("args").alias("pos", "raw")).where("raw is not null")
    simple = ways.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "iface", _simple(F.col("anc")).alias("name")))), lambda x: x["name"]).alias("names"))
    named = known.join(scope.where("type_key is not null"), ["path", "owner", "raw"]).join(simple.withColumnRenamed("type", "type_key"), "type_key")
    table = F.create_map(*[F.lit(x) for k, v in PASSES.items() for x in (k, v)])
    plain = known.where(F.col("raw").isin(*PASSES)).select("path", "id", "pos", F.split(F.element_at(table, F.col("raw")), " ").alias("names"))
    both = named.select("path", "id", "pos", "names").unionByName(plain)
    return both.groupBy("path", "id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "names"))).alias("fits"))


def _inherited(scope: DataFrame, ways: DataFrame, types: DataFrame) -> DataFrame:
    """Names that no scope has may be member types of an ancestor of the enclosing type."""
    open_names = scope.where("type_key is null and owner <> ''").select("path", "owner", "raw")
    nested = open_names.join(ways.where("dist > 0"), F.col("owner") == F.col("type")).withColumn("key", F.concat("anc", F.lit("."), "raw")).join(types.select("key"), "key")
    found = nested.groupBy("path", "owner", "raw").agg(F.min_by("key", F.struct("iface", "dist")).alias("_key"))
    out = scope.join(found, ["path", "owner", "raw"], "left")
    return out.select("path", "owner", "raw", F.coalesce("type_key", "_key").alias("type_key"), (F.col("outside") & F.col("_key").isNull()).alias("outside"))


def accesses(units: DataFrame) -> DataFrame:
    """All nodes with member (its key), result (the type it gives), and the state of what was not found."""
    with measured_joins(units.sparkSession):
        return _accessed(units)


def _accessed(units: DataFrame) -> DataFrame:
    nodes = units.select("path", F.explode("nodes").alias("n")).select("path", "n.*")
    symbols = units.select("path", F.explode("symbols").alias("s")).where("s.type_name is not null").select("path", F.col("s.parent_key").alias("owner"), F.col("s.type_name").alias("raw"))
    implied = units.select("path", F.explode("implied").alias("s")).where("s.type_name is not null").select("path", "s.owner", F.col("s.type_name").alias("raw"))
    levels = nodes.select("path", "owner", F.explode("levels").alias("raw")).where("raw like '~%'").withColumn("raw", F.substr("raw", F.lit(2)))
    args = nodes.select("path", "owner", F.explode("args").alias("raw"))
    refs = symbols.unionByName(implied).unionByName(levels).unionByName(args).unionByName(nodes.select("path", "owner", F.col("ref").alias("raw")))
    scope = checkpointed(named_types(units, refs).withColumnRenamed("key", "type_key"))
    supers = checkpointed(_supers(units))
    ways = ancestors(units, supers)
    types = checkpointed(_types(units))
    scope = checkpointed(_inherited(scope, ways, types))
    members = checkpointed(_members(units, scope))
    beyond = supers.where("key is null").groupBy(F.col("sub_key").alias("anc")).agg(F.max("outside").alias("outside"))
    open_types = ways.join(beyond, "anc").groupBy("type").agg(F.max("outside").alias("from_outside"))
    nodes = checkpointed(nodes.join(_passes(nodes, scope, ways), ["path", "id"], "left"))  # read anew by every round
    starts = _starts(units, nodes, scope)
    done, deepest = None, units.agg(F.max(F.array_max(F.transform("nodes", lambda n: n["depth"])))).first()[0]
    for depth in range((-1 if deepest is None else deepest) + 1):
        own = nodes.where(F.col("depth") == depth)
        if depth:
            starts = own.join(last.select("path", F.col("id").alias("on_node"), F.col("result").alias("type"), F.col("result_outside").alias("outside")), ["path", "on_node"]).select("path", "id", F.lit(0).alias("level"), F.lit(0).alias("beyond"), "type", "outside")
        last = checkpointed(_found(own, starts, ways, members, types, open_types))
        done = last if done is None else done.unionByName(last)
    return done if done is not None else _found(nodes, starts, ways, members, types, open_types)


def _found(own: DataFrame, starts: DataFrame, ways: DataFrame, members: DataFrame, types: DataFrame, open_types: DataFrame) -> DataFrame:
    """One round: the nearest fitting member of each node of `own`."""
    want = own.select("path", "id", "name", "arity", "call_kind", "fits")
    near = starts.join(want, ["path", "id"]).join(ways, "type").where((F.col("dist") >= F.col("beyond")) & ((F.col("call_kind") != "CONSTRUCTOR") | (F.col("dist") == 0)))
    n, m = F.col("arity"), F.col("m_arity")
    fits = (n == m) | (F.col("m_varargs") & (F.col("call_kind") != "CONSTRUCTOR") & (n >= m - 1) & (n >= 0) & (m > 0))
    pairs = near.join(members.select(*[F.col(c).alias(f"m_{c}") for c in members.columns]), (F.col("anc") == F.col("m_owner")) & (F.col("name") == F.col("m_name")) & fits)
    # an argument of known type clashes with a parameter that it cannot be passed as
    param = lambda i: _simple(F.regexp_replace(F.get(F.col("m_params"), i), r"\[\]", ""))
    cost = F.aggregate(
        F.map_entries(F.coalesce("fits", F.create_map().cast("map<int,array<string>>"))),
        F.struct(F.lit(0).alias("clash"), F.lit(0).alias("far")),
        lambda a, e: F.struct(
            (a["clash"] + F.coalesce((param(e["key"]) != "Object") & (F.array_position(e["value"], param(e["key"])) == 0), F.lit(False)).cast("int")).alias("clash"),
            (a["far"] + F.coalesce(F.when(F.array_position(e["value"], param(e["key"])) == 0, 90).otherwise(F.array_position(e["value"], param(e["key"])) - 1).cast("int"), F.lit(50))).alias("far"),
        ),
    )
    rank = F.struct("level", cost["clash"].alias("clash"), (n != m).alias("spread"), cost["far"].alias("far"), "iface", "dist", F.col("m_member").alias("member"))
    best = pairs.groupBy("path", "id").agg(F.min_by(F.struct(F.col("m_member").alias("member"), F.col("m_result").alias("result"), F.col("m_result_outside").alias("result_outside")), rank).alias("b"))
    from_object = F.col("name").isin(*OBJECT_MEMBERS)
    implied = ((F.col("kind") == "ENUM") & F.col("name").isin(*ENUM_MEMBERS)) | ((F.col("kind") == "RECORD") & (n == 0)) | (F.col("call_kind") == "CONSTRUCTOR")
    placed = starts.join(want, ["path", "id"]).join(types.select(F.col("key").alias("type"), "kind"), "type", "left").join(open_types, "type", "left")
    state = placed.groupBy("path", "id").agg(F.max(F.coalesce(F.col("outside") | F.col("type").isNotNull() & (from_object | implied | (F.col("call_kind") != "FIELD") & F.coalesce("from_outside", F.lit(False))), F.lit(False))).alias("seen_outside"))
    out = own.drop("fits", "args", "levels").join(best, ["path", "id"], "left").join(state, ["path", "id"], "left")
    gone = F.col("b").isNull() & F.coalesce("seen_outside", F.lit(False))
    return out.select(*[c for c in own.columns if c not in ("fits", "args", "levels")], F.col("b.member").alias("member"), F.col("b.result").alias("result"), F.coalesce("b.result_outside", gone).alias("result_outside"), (gone | F.col("b").isNotNull() & F.col("b.member").isNull()).alias("external"))


def resolved_calls(units: DataFrame) -> DataFrame:
    """Edges with callee_key, or the reason there is none."""
    calls = accesses(units).where("call_kind <> 'FIELD'")
    # what a creation names is the constructor of so many arguments
    return calls.select("path", "caller_key", F.col("member").alias("callee_key"), F.col("raw").alias("callee_raw"), "call_line", "call_kind", F.col("member").isNotNull().alias("resolved"), F.when(F.col("member").isNotNull(), None).when(F.col("external"), "EXTERNAL").otherwise("UNSOLVED").alias("reason"))
