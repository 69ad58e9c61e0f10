"""Queries over the symbol, call and relation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, graph, lookup, review, summary
from ..sources.projection import Repo
from .registry import query

TYPES = "('CLASS','INTERFACE','ENUM','RECORD','ANNOTATION')"
NOT_TRIVIAL = "NOT (name LIKE 'get%' OR name LIKE 'set%' OR name LIKE 'is%' OR name IN ('toString','equals','hashCode','main','close','flush','run','apply','accept','compareTo'))"
KEYWORD = "Supplier_00000000"
SEEDS = "SELECT DISTINCT 1000000 + (l_partkey * 7 + l_suppkey) % 200 AS seed FROM lineitem "
REACH = f"""WITH seeds AS ({SEEDS}),
e AS (SELECT DISTINCT callee_symbol_id AS a, caller_symbol_id AS n FROM call_edge WHERE callee_symbol_id IS NOT NULL AND caller_symbol_id <> callee_symbol_id),
h1 AS (SELECT DISTINCT seed, n FROM seeds JOIN e ON a = seed WHERE n <> seed),
h2 AS (SELECT DISTINCT seed, e.n FROM h1 JOIN e ON a = h1.n WHERE e.n <> seed EXCEPT SELECT seed, n FROM h1),
r AS (SELECT seed, n AS node, 1 AS hops FROM h1 UNION ALL SELECT seed, n, 2 FROM h2)"""


def seeds(r: Repo) -> DataFrame:
    return r.lineitem.select((1000000 + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 200).alias("seed")).distinct()


@query("d1_top_level_types", f"SELECT name, qualified_name, path, start_line, end_line FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE parent_id IS NULL AND s.kind IN {TYPES} ORDER BY qualified_name LIMIT 50")
def _(r: Repo) -> DataFrame:
    return lookup.top_level_types(r.symbol, r.source_file, 50)


@query("d2_most_called_methods", f"""SELECT s.id, s.kind, name, qualified_name, path, n FROM symbol s JOIN source_file f ON f.id = s.file_id
JOIN (SELECT callee_symbol_id AS c, count(*) AS n FROM call_edge WHERE resolved = 1 GROUP BY 1) ON c = s.id WHERE s.kind = 'METHOD' AND {NOT_TRIVIAL} ORDER BY n DESC, s.id LIMIT 30""")
def _(r: Repo) -> DataFrame:
    return lookup.most_called_methods(r.symbol, r.source_file, r.call_edge, 30)


@query("d3_most_implemented", """SELECT s.id, s.kind, name, qualified_name, path, n FROM symbol s JOIN source_file f ON f.id = s.file_id
JOIN (SELECT super_symbol_id AS c, count(*) AS n FROM type_relation WHERE resolved = 1 GROUP BY 1) ON c = s.id WHERE s.kind = 'INTERFACE' ORDER BY n DESC, s.id LIMIT 10""")
def _(r: Repo) -> DataFrame:
    return lookup.most_implemented(r.symbol, r.source_file, r.type_relation, 10)


@query("d4_repos", """SELECT *, CASE WHEN file_count > 0 THEN parsed_ok_count / file_count ELSE 0 END AS parse_rate,
CASE WHEN call_edge_count > 0 THEN call_resolved_count / call_edge_count ELSE 0 END AS resolve_rate FROM repo""")
def _(r: Repo) -> DataFrame:
    return lookup.repos(r.repo)


@query("d5_latest_ready", "SELECT id FROM repo WHERE status = 'READY' ORDER BY indexed_at DESC NULLS LAST, id DESC LIMIT 1")
def _(r: Repo) -> DataFrame:
    return lookup.latest_ready(r.repo)


@query("d6_repo_by_path", "SELECT * FROM repo WHERE root_path = '/srv/asia' ORDER BY id DESC LIMIT 1")
def _(r: Repo) -> DataFrame:
    return lookup.repo_by_path(r.repo, "/srv/asia")


@query("d7_find_symbols", f"""SELECT s.id, s.kind, name, qualified_name, path, CASE WHEN name = '{KEYWORD}' THEN 0 WHEN qualified_name = '{KEYWORD}' THEN 1 ELSE 2 END AS rank
FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE name = '{KEYWORD}' OR contains(qualified_name, '{KEYWORD}') ORDER BY rank, strlen(qualified_name), qualified_name, s.id LIMIT 100""")
def _(r: Repo) -> DataFrame:
    return lookup.find_symbols(r.symbol, r.source_file, KEYWORD, 100)


@query("d8_content_hash", "SELECT content_hash FROM source_file WHERE path = 'src/nation_6.java'")
def _(r: Repo) -> DataFrame:
    return r.source_file.where("path = 'src/nation_6.java'").select("content_hash")


@query("d9_members_in_type", """SELECT s.id, s.kind, s.name, s.qualified_name, path FROM symbol s JOIN symbol o ON o.id = s.parent_id JOIN source_file f ON f.id = s.file_id
WHERE s.name = 'main' AND o.qualified_name = (SELECT qualified_name FROM symbol WHERE id = 3)""")
def _(r: Repo) -> DataFrame:
    owner = r.symbol.where("id = 3").select("qualified_name").first()
    return lookup.members_in_type(r.symbol, r.source_file, owner[0] if owner else "", "main")


@query("d10_children", "SELECT id, kind, name, start_line FROM symbol WHERE parent_id = 3")
def _(r: Repo) -> DataFrame:
    return lookup.children(r.symbol, 3)


@query("d11_symbol_by_id", "SELECT s.*, path FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE s.id = 1000007")
def _(r: Repo) -> DataFrame:
    return lookup.symbol_by_id(r.symbol, r.source_file, 1000007)


@query("d12_callers", """SELECT callee_symbol_id, caller_symbol_id, qualified_name AS caller_name, path AS caller_path, call_line FROM call_edge e
JOIN symbol s ON s.id = e.caller_symbol_id JOIN source_file f ON f.id = s.file_id WHERE callee_symbol_id IS NOT NULL""")
def _(r: Repo) -> DataFrame:
    return lookup.callers(r.symbol, r.source_file, r.call_edge)


@query("d13_callees", """SELECT caller_symbol_id, cf.path AS caller_path, call_line, callee_symbol_id, t.qualified_name AS callee_name, tf.path AS callee_path, callee_raw, resolved, reason
FROM call_edge e JOIN symbol c ON c.id = e.caller_symbol_id JOIN source_file cf ON cf.id = c.file_id LEFT JOIN symbol t ON t.id = e.callee_symbol_id LEFT JOIN source_file tf ON tf.id = t.file_id""")
def _(r: Repo) -> DataFrame:
    return lookup.callees(r.symbol, r.source_file, r.call_edge)


@query("d14_implementations", """SELECT super_symbol_id, sub_symbol_id, qualified_name, path, t.kind FROM type_relation t JOIN symbol s ON s.id = t.sub_symbol_id JOIN source_file f ON f.id = s.file_id WHERE super_symbol_id >= 0""")
def _(r: Repo) -> DataFrame:
    return lookup.implementations(r.symbol, r.source_file, r.type_relation, F.col("super_symbol_id") >= 0)


@query("d16_kinds", f"SELECT kind, kind IN {TYPES} AS is_type, kind IN ('METHOD','CONSTRUCTOR') AS is_callable, count(*) AS n FROM symbol GROUP BY kind")
def _(r: Repo) -> DataFrame:
    return r.symbol.groupBy("kind").agg(F.count("*").alias("n")).select("kind", T.is_type(F.col("kind")).alias("is_type"), T.is_callable(F.col("kind")).alias("is_callable"), "n")


@query("d17_ratios", "SELECT id, CASE WHEN call_edge_count > 0 THEN call_resolved_count / call_edge_count ELSE 0 END AS resolve_rate FROM repo")
def _(r: Repo) -> DataFrame:
    return r.repo.select("id", T.ratio(F.col("call_resolved_count"), F.col("call_edge_count")).alias("resolve_rate"))


@query("e1_vitals", "SELECT count(*) FILTER (kind IN ('CLASS','ENUM','RECORD')) AS classes, count(*) FILTER (kind = 'INTERFACE') AS interfaces, count(*) FILTER (kind = 'METHOD') AS methods, count(*) AS total FROM symbol")
def _(r: Repo) -> DataFrame:
    return summary.vitals(r.symbol)


@query("e2_entry_points", """SELECT s.id, qualified_name, path FROM symbol s JOIN source_file f ON f.id = s.file_id
WHERE EXISTS (SELECT 1 FROM symbol m WHERE m.parent_id = s.id AND m.kind = 'METHOD' AND m.name = 'main' AND m.modifiers LIKE '%static%') ORDER BY path, s.id LIMIT 10""")
def _(r: Repo) -> DataFrame:
    return summary.entry_points(r.symbol, r.source_file)


@query("e3_call_hubs", """SELECT s.id, s.qualified_name, path, count(*) AS n FROM call_edge e JOIN symbol c ON c.id = e.callee_symbol_id JOIN symbol s ON s.id = coalesce(c.parent_id, c.id)
JOIN source_file f ON f.id = s.file_id WHERE resolved = 1 GROUP BY ALL ORDER BY n DESC, s.qualified_name, s.id LIMIT 10""")
def _(r: Repo) -> DataFrame:
    return summary.call_hubs(r.symbol, r.source_file, r.call_edge)


@query("e4_top_methods", f"""SELECT s.id, qualified_name, path, count(*) AS n FROM call_edge e JOIN symbol s ON s.id = e.callee_symbol_id JOIN source_file f ON f.id = s.file_id
WHERE resolved = 1 AND s.kind = 'METHOD' AND {NOT_TRIVIAL} GROUP BY ALL ORDER BY n DESC, qualified_name, s.id LIMIT 10""")
def _(r: Repo) -> DataFrame:
    return summary.top_methods(r.symbol, r.source_file, r.call_edge)


@query("e5_implementation_ranking", """SELECT s.id, qualified_name, path, count(*) AS n FROM type_relation t JOIN symbol s ON s.id = t.super_symbol_id JOIN source_file f ON f.id = s.file_id
WHERE t.kind = 'IMPLEMENTS' AND resolved = 1 GROUP BY ALL ORDER BY n DESC, qualified_name, s.id LIMIT 10""")
def _(r: Repo) -> DataFrame:
    return summary.implementation_ranking(r.symbol, r.source_file, r.type_relation)


@query("e6_uncalled_classes", """SELECT s.id, qualified_name, path FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE s.kind IN ('CLASS','ENUM','RECORD')
AND NOT EXISTS (SELECT 1 FROM symbol m JOIN call_edge e ON e.callee_symbol_id = m.id AND e.resolved = 1 WHERE m.parent_id = s.id AND m.kind = 'METHOD' AND m.name <> 'main') ORDER BY path, s.id LIMIT 60""")
def _(r: Repo) -> DataFrame:
    return summary.uncalled_classes(r.symbol, r.source_file, r.call_edge, 60)


@query("e7_key_types", r"""SELECT s.id, s.qualified_name, path, count(m.id) AS members FROM symbol s LEFT JOIN symbol m ON m.parent_id = s.id AND m.kind IN ('METHOD','CONSTRUCTOR') JOIN source_file f ON f.id = s.file_id
WHERE s.parent_id IS NULL AND regexp_matches(s.qualified_name, '^com[.]acme[.]m3[.].+$') GROUP BY ALL ORDER BY members DESC, s.qualified_name LIMIT 6""")
def _(r: Repo) -> DataFrame:
    return summary.key_types(r.symbol, r.source_file, summary.key_type_pattern("com.acme.m3", "com.acme"))


@query("e8_exact_names", "SELECT DISTINCT name FROM symbol WHERE name IN ('main', 'Supplier_000000003', 'no_such')")
def _(r: Repo) -> DataFrame:
    return summary.exact_names(r.symbol, ["main", "Supplier_000000003", "no_such"])


SCALES = """SELECT path, loc, s.qualified_name AS type_name, (SELECT count(*) FROM symbol x WHERE x.file_id = f.id) AS symbols FROM source_file f LEFT JOIN symbol s ON s.file_id = f.id AND s.parent_id IS NULL WHERE f.kind = 'JAVA'"""


@query("e9_file_scales", SCALES)
def _(r: Repo) -> DataFrame:
    return summary.file_scales(r.symbol, r.source_file)


@query("e10_reasons", "SELECT coalesce(reason, 'UNKNOWN') AS reason, count(*) AS n FROM call_edge WHERE resolved = 0 GROUP BY 1")
def _(r: Repo) -> DataFrame:
    return summary.reasons(r.call_edge)


@query("e11_relation_reasons", "SELECT CASE WHEN external = 1 THEN 'EXTERNAL' ELSE 'RESOLVED' END AS status, count(*) AS n FROM type_relation GROUP BY 1")
def _(r: Repo) -> DataFrame:
    return summary.relation_reasons(r.type_relation)


@query("e17_structure", """WITH hubs AS (SELECT s.id, s.qualified_name AS q, count(*) AS n FROM call_edge e JOIN symbol c ON c.id = e.callee_symbol_id JOIN symbol s ON s.id = coalesce(c.parent_id, c.id) WHERE resolved = 1 GROUP BY ALL),
methods AS (SELECT s.id, qualified_name AS q, count(*) AS n FROM call_edge e JOIN symbol s ON s.id = e.callee_symbol_id WHERE resolved = 1 AND s.kind = 'METHOD' AND """ + NOT_TRIVIAL + """ GROUP BY ALL),
impl AS (SELECT s.id, qualified_name AS q, count(*) AS n FROM type_relation t JOIN symbol s ON s.id = t.super_symbol_id WHERE t.kind = 'IMPLEMENTS' AND resolved = 1 GROUP BY ALL),
entries AS (SELECT s.id, qualified_name AS q, path FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE EXISTS (SELECT 1 FROM symbol m WHERE m.parent_id = s.id AND m.kind = 'METHOD' AND m.name = 'main' AND m.modifiers LIKE '%static%')),
uncalled AS (SELECT s.id, qualified_name AS q, path FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE s.kind IN ('CLASS','ENUM','RECORD')
    AND NOT EXISTS (SELECT 1 FROM symbol m JOIN call_edge e ON e.callee_symbol_id = m.id AND e.resolved = 1 WHERE m.parent_id = s.id AND m.kind = 'METHOD' AND m.name <> 'main')),
every AS (SELECT 'hubs' AS section, row_number() OVER (ORDER BY n DESC, q, id) AS place, q AS name, n FROM hubs
    UNION ALL SELECT 'methods', row_number() OVER (ORDER BY n DESC, q, id), q, n FROM methods
    UNION ALL SELECT 'implementations', row_number() OVER (ORDER BY n DESC, q, id), q, n FROM impl
    UNION ALL SELECT 'entries', row_number() OVER (ORDER BY path, id), q, 0 FROM entries
    UNION ALL SELECT 'uncalled', row_number() OVER (ORDER BY path, id), q, 0 FROM uncalled)
SELECT * FROM every WHERE place <= 10""")
def _(r: Repo) -> DataFrame:
    return summary.structure(r.symbol, r.source_file, r.call_edge, r.type_relation)


@query("e19_symbol_chunks", "SELECT count(*) AS n FROM chunk WHERE kind = 'SYMBOL'")
def _(r: Repo) -> DataFrame:
    return r.chunk.where("kind = 'SYMBOL'").agg(F.count("*").alias("n"))


PACKAGE = "regexp_replace(qualified_name, '\\.[^.]*$', '')"


@query("f1_packages", f"SELECT DISTINCT {PACKAGE} AS package FROM symbol WHERE parent_id IS NULL")
def _(r: Repo) -> DataFrame:
    return r.symbol.where("parent_id is null").select(T.package_of(F.col("qualified_name")).alias("package")).distinct()


@query("f2_common_prefix", f"""WITH m AS (SELECT min(string_split({PACKAGE}, '.')) AS a, max(string_split({PACKAGE}, '.')) AS b FROM symbol WHERE parent_id IS NULL)
SELECT array_to_string(a[1:(SELECT coalesce(max(k), 0) FROM range(1, 20) t(k) WHERE k <= least(len(a), len(b)) AND a[1:k] = b[1:k])], '.') AS prefix FROM m""")
def _(r: Repo) -> DataFrame:
    return summary.common_prefix(r.symbol.where("parent_id is null").select(T.package_of(F.col("qualified_name")).alias("package")))


@query("f3_chosen_prefix", f"""WITH RECURSIVE s AS (SELECT DISTINCT {PACKAGE} AS package, string_split({PACKAGE}, '.') AS seg FROM symbol WHERE parent_id IS NULL AND {PACKAGE} IS NOT NULL),
m AS (SELECT min(seg) AS a, max(seg) AS b, count(*) AS total FROM s),
c AS (SELECT coalesce(max(k), 0) AS k FROM (SELECT a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS k FROM m) WHERE a[1:k] = b[1:k]),
lv AS (SELECT array_to_string(seg[1:k], '.') AS prefix, seg[k + 1] AS next, k + 1 < len(seg) AS deeper FROM (SELECT seg, unnest(range(0, len(seg) + 1)) AS k FROM s)),
nd AS (SELECT prefix, CASE WHEN prefix = '' THEN count(DISTINCT next) ELSE count(DISTINCT next) + any_value(total) - count(next) END AS modules FROM lv, m GROUP BY prefix),
bs AS (SELECT prefix, next FROM (SELECT prefix, next, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, next) AS r FROM lv WHERE deeper GROUP BY prefix, next) WHERE r = 1),
ch AS (SELECT array_to_string(a[1:k], '.') AS prefix FROM m, c UNION ALL
    SELECT CASE WHEN ch.prefix = '' THEN next ELSE ch.prefix || '.' || next END FROM ch JOIN nd ON nd.prefix = ch.prefix JOIN bs ON bs.prefix = ch.prefix WHERE modules < 3)
SELECT prefix FROM ch ORDER BY length(prefix) DESC LIMIT 1""")
def _(r: Repo) -> DataFrame:
    return summary.chosen_prefix(r.symbol.where("parent_id is null").select(T.package_of(F.col("qualified_name")).alias("package")))


@query("f6_module_patterns", f"SELECT DISTINCT {PACKAGE} AS package, concat('^', replace({PACKAGE}, '.', '[.]'), '[.].+$') AS pattern FROM symbol WHERE parent_id IS NULL")
def _(r: Repo) -> DataFrame:
    p = r.symbol.where("parent_id is null").select(T.package_of(F.col("qualified_name")).alias("package")).distinct()
    return p.withColumn("pattern", F.concat(F.lit("^"), F.replace("package", F.lit("."), F.lit("[.]")), F.lit("[.].+$")))


@query("f4_module_names", f"SELECT DISTINCT {PACKAGE} AS package, split_part({PACKAGE}, '.', 3) AS module FROM symbol WHERE parent_id IS NULL")
def _(r: Repo) -> DataFrame:
    p = r.symbol.where("parent_id is null").select(T.package_of(F.col("qualified_name")).alias("package")).distinct()
    return p.withColumn("module", T.module_name(F.col("package"), "com.acme"))


@query("f5_modules", f"""WITH t AS ({SCALES}), p AS (SELECT path, max(type_name) AS qualified_name FROM t GROUP BY path),
m AS (SELECT p.path, CASE WHEN qualified_name IS NULL THEN '(没有顶层类型)' ELSE split_part({PACKAGE}, '.', 3) END AS module FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY path) AS r FROM m),
g AS (SELECT module, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(symbols) AS BIGINT) AS symbols FROM t JOIN m ON m.path = t.path GROUP BY module)
SELECT g.*, (SELECT string_agg(path, ',' ORDER BY path) FROM k WHERE k.module = g.module AND r <= 5) AS sample_paths FROM g ORDER BY symbols DESC, module LIMIT 40""")
def _(r: Repo) -> DataFrame:
    return summary.modules(summary.file_scales(r.symbol, r.source_file), "com.acme")


@query("f7_material_types", """SELECT name, min(qualified_name) AS first FROM symbol WHERE parent_id IS NULL AND contains(qualified_name, '.m1.') AND starts_with(qualified_name, 'com.acme.m1.n1.') AND NOT contains(substr(qualified_name, 16), '.') GROUP BY name ORDER BY first LIMIT 30""")
def _(r: Repo) -> DataFrame:
    return summary.domain_types(r.symbol.where("parent_id is null"), "com.acme.m1.n1")


@query("g1_reverse_search", REACH + " SELECT seed, node, hops FROM r")
def _(r: Repo) -> DataFrame:
    return graph.reverse_search(r.call_edge, seeds(r), 2)


@query("g2_transitive_callers", REACH + " SELECT DISTINCT node FROM r")
def _(r: Repo) -> DataFrame:
    return graph.transitive_callers(r.call_edge, seeds(r), 2)


@query("g3_chain_call_sites", REACH + """, near AS (SELECT seed, node, hops FROM r UNION ALL SELECT seed, seed, 0 FROM seeds),
s AS (SELECT near.seed, c.caller_symbol_id AS caller, call_line, q.qualified_name, path, row_number() OVER (PARTITION BY near.seed, c.caller_symbol_id ORDER BY path, call_line) AS k
    FROM near JOIN call_edge c ON c.callee_symbol_id = near.node JOIN r ON r.seed = near.seed AND r.node = c.caller_symbol_id AND r.hops = near.hops + 1
    JOIN symbol q ON q.id = c.caller_symbol_id JOIN source_file f ON f.id = q.file_id)
SELECT seed, concat(path, ':', call_line) AS site, string_agg(DISTINCT qualified_name, ',' ORDER BY qualified_name) AS callers FROM s WHERE k = 1 GROUP BY 1, 2""")
def _(r: Repo) -> DataFrame:
    return graph.chain_call_sites(r.call_edge, r.symbol, r.source_file, seeds(r), 2)


@query("g4_direct_callers", REACH + " SELECT seed, n AS node FROM h1")
def _(r: Repo) -> DataFrame:
    return graph.direct_callers(r.call_edge, seeds(r))


@query("g5_chain_only", REACH + " SELECT seed, count(*) AS truth, count(*) FILTER (hops = 1) AS direct, count(*) FILTER (hops > 1) AS chain FROM r GROUP BY seed")
def _(r: Repo) -> DataFrame:
    return graph.chain_only(r.call_edge, seeds(r), 2)


@query("g6_chain_questions")
def _(r: Repo) -> DataFrame:
    return graph.chain_questions(r.call_edge, 7, 20, depth=2)


@query("g7_cycle_guard", """WITH k AS (SELECT id, user_id, concat(replace(replace(lower(mode), '_', ''), '-', ''), '(', replace(lower(question), '$', '.'), ')') AS visit_key FROM answer_log)
SELECT id, user_id, visit_key, row_number() OVER (PARTITION BY user_id, visit_key ORDER BY id) AS visit FROM k""")
def _(r: Repo) -> DataFrame:
    steps = r.answer_log.select("id", "user_id", T.visit_key(F.col("mode"), F.concat(F.lit(" "), F.col("question"), F.lit("()"))).alias("visit_key"))
    return graph.first_visits(steps, "user_id", "visit_key", "id")


@query("l1_long_methods", "SELECT 'LONG_METHOD' AS rule, 'low' AS severity, id AS symbol_id, start_line, end_line, end_line - start_line + 1 AS value FROM symbol WHERE kind IN ('METHOD','CONSTRUCTOR') AND end_line - start_line + 1 >= 60")
def _(r: Repo) -> DataFrame:
    return review.long_methods(r.symbol)


PARAMETERS = "CASE WHEN trim(regexp_replace(regexp_replace(regexp_extract(signature, '\\((.*)\\)', 1), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g')) = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace(regexp_extract(signature, '\\((.*)\\)', 1), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), ',')) END"
MANY = f"SELECT 'MANY_PARAMS' AS rule, 'low' AS severity, id AS symbol_id, start_line, end_line, CAST({PARAMETERS} AS BIGINT) AS value FROM symbol WHERE kind IN ('METHOD','CONSTRUCTOR') AND signature IS NOT NULL AND {PARAMETERS} > 4"


@query("l2_many_parameters", MANY)
def _(r: Repo) -> DataFrame:
    return review.many_parameters(r.symbol)


@query("l3_parameter_count", f"SELECT id, CAST({PARAMETERS} AS INTEGER) AS n FROM symbol WHERE signature IS NOT NULL")
def _(r: Repo) -> DataFrame:
    return r.symbol.where("signature is not null").select("id", T.parameter_count(F.col("signature")).alias("n"))


@query("l4_empty_catch", """WITH s AS (SELECT p_partkey AS id, p_partkey % 4 AS k FROM part)
SELECT 'EMPTY_CATCH' AS rule, 'medium' AS severity, id AS symbol_id, CAST(CASE WHEN k = 0 THEN 11 ELSE 12 END AS BIGINT) AS start_line, CAST(CASE WHEN k = 0 THEN 11 ELSE 12 END AS BIGINT) AS end_line, CAST(1 AS BIGINT) AS value FROM s WHERE k IN (0, 1)""")
def _(r: Repo) -> DataFrame:
    bodies = {0: "a();\ntry { b(); } catch (E e) { }", 1: "try {\n b();\n} catch (E e) {\n // why\n\n}\nc();", 2: "try {\n} catch (E e) {\n log(e);\n}", 3: "catchAll();\nreturn;"}
    text = F.lit(None).cast("string")
    for k, body in bodies.items():
        text = F.when(F.col("p_partkey") % 4 == k, F.lit(body)).otherwise(text)
    return review.empty_catches(r.part.select(F.col("p_partkey").alias("id"), F.lit(10).cast("long").alias("start_line"), text.alias("content")))


GOD = "SELECT 'GOD_CLASS' AS rule, 'low' AS severity, s.id AS symbol_id, s.start_line, s.end_line, count(*) AS value FROM symbol s JOIN symbol m ON m.parent_id = s.id GROUP BY s.id, s.start_line, s.end_line HAVING count(*) > 25"
UNRESOLVED = "SELECT 'UNRESOLVED_CALLS' AS rule, 'info' AS severity, s.id AS symbol_id, s.start_line, s.end_line, count(*) FILTER (resolved = 0) AS value FROM symbol s JOIN symbol m ON m.parent_id = s.id AND m.kind IN ('METHOD','CONSTRUCTOR') JOIN call_edge e ON e.caller_symbol_id = m.id GROUP BY s.id, s.start_line, s.end_line HAVING count(*) >= 5 AND count(*) FILTER (resolved = 0) / count(*) >= 0.5"
LONG = "SELECT 'LONG_METHOD' AS rule, 'low' AS severity, id AS symbol_id, start_line, end_line, end_line - start_line + 1 AS value FROM symbol WHERE kind IN ('METHOD','CONSTRUCTOR') AND end_line - start_line + 1 >= 60"


@query("l5_god_classes", GOD)
def _(r: Repo) -> DataFrame:
    return review.god_classes(r.symbol)


@query("l6_unresolved_calls", "WITH edge AS (SELECT * REPLACE (CASE WHEN caller_symbol_id % 10 < 3 THEN 0 ELSE resolved END AS resolved) FROM call_edge) " + UNRESOLVED.replace("JOIN call_edge e", "JOIN edge e"))
def _(r: Repo) -> DataFrame:
    return review.unresolved_calls(r.symbol, r.call_edge.withColumn("resolved", F.when(F.col("caller_symbol_id") % 10 < 3, 0).otherwise(F.col("resolved"))))


@query("l7_all_rules", f"{LONG} UNION ALL {MANY} UNION ALL {GOD} UNION ALL {UNRESOLVED}")
def _(r: Repo) -> DataFrame:
    return review.inspected(r.symbol, r.call_edge)


@query("l8_class_callers", "SELECT DISTINCT m.parent_id AS owner_id, caller_symbol_id, call_line FROM call_edge e JOIN symbol m ON m.id = e.callee_symbol_id AND m.kind IN ('METHOD','CONSTRUCTOR') WHERE m.parent_id IS NOT NULL")
def _(r: Repo) -> DataFrame:
    return review.class_callers(r.symbol, r.call_edge)


@query("l9_resolve_type", "SELECT * FROM symbol WHERE id = 3")
def _(r: Repo) -> DataFrame:
    return lookup.resolve_type(r.symbol, "Supplier_000000003")


@query("k9_fingerprint", """WITH l AS (SELECT md5(concat_ws(':', s.kind, s.qualified_name, path, s.start_line, coalesce(p.qualified_name, '-'))) AS h FROM symbol s JOIN source_file f ON f.id = s.file_id LEFT JOIN symbol p ON p.id = s.parent_id)
SELECT count(*) AS symbols, CAST(sum(CAST('0x' || h[1:8] AS BIGINT)) AS BIGINT) AS low, CAST(sum(CAST('0x' || h[9:16] AS BIGINT)) AS BIGINT) AS high FROM l""")
def _(r: Repo) -> DataFrame:
    return evaluation.fingerprint(r.symbol, r.source_file)


@query("k2_unique_names", "SELECT id, name FROM symbol WHERE name IN (SELECT name FROM symbol GROUP BY name HAVING count(*) = 1)")
def _(r: Repo) -> DataFrame:
    return evaluation.unique_names(r.symbol).select("id", "name")


@query("k2_identifiable", f"""SELECT s.id, o.name AS owner_name FROM symbol s JOIN symbol o ON o.id = s.parent_id AND o.kind IN {TYPES}
WHERE (SELECT count(*) FROM symbol x WHERE x.parent_id = s.parent_id AND x.name = s.name) = 1 AND (SELECT count(*) FROM symbol x WHERE x.name = o.name AND x.kind IN {TYPES}) = 1""")
def _(r: Repo) -> DataFrame:
    return evaluation.identifiable(r.symbol).select("id", "owner_name")


@query("k1_questions")
def _(r: Repo) -> DataFrame:
    return evaluation.questions(r.symbol, r.source_file, r.call_edge, r.type_relation, 20260918, 20).withColumn("truth", F.array_join("truth", ","))


@query("k3_sample")
def _(r: Repo) -> DataFrame:
    return graph.sampled(r.symbol.select("id", "name"), "id", 11, 25)
