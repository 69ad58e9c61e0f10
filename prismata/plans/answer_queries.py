"""Queries over chunks, questions, evidence, the ledger and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, control, evaluation, evidence, ranking, retrieval, summary
from ..operators.checkpoints import shared_folder
from ..sources.projection import Repo
from ..sources.text_index import TextIndex, write_segment
from .registry import query

USAGE = """SELECT count(*) AS questions, CAST(sum(refused) AS BIGINT) AS refusals, CAST(sum(cache_hit) AS BIGINT) AS cache_hits,
CAST(sum(CASE WHEN cache_hit = 0 THEN prompt_tokens ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN cache_hit = 0 THEN completion_tokens ELSE 0 END) AS BIGINT) AS completion_tokens,
CAST(sum(CASE WHEN cache_hit = 0 THEN support_prompt_tokens + support_completion_tokens ELSE 0 END) AS BIGINT) AS support_tokens,
CAST(sum(CASE WHEN cache_hit = 0 THEN cost ELSE 0 END) AS DOUBLE) AS cost,
CAST(sum(CASE WHEN cache_hit = 1 THEN prompt_tokens + completion_tokens + support_prompt_tokens + support_completion_tokens ELSE 0 END) AS BIGINT) AS saved_tokens,
CAST(sum(CASE WHEN cache_hit = 1 THEN cost ELSE 0 END) AS DOUBLE) AS saved_cost, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency, max(latency_ms) AS max_latency,
CAST(sum(evidence_verified) AS BIGINT) AS verified, CAST(sum(evidence_rejected) AS BIGINT) AS rejected FROM answer_log WHERE source = 'USER'"""


@query("e12_usage", f"WITH u AS ({USAGE}) SELECT *, refusals / questions AS refusal_rate, prompt_tokens + completion_tokens + support_tokens AS total_tokens FROM u")
def _(r: Repo) -> DataFrame:
    return summary.usage(r.answer_log)


@query("e12_usage_of_repo", f"WITH u AS ({USAGE} AND repo_id = 2) SELECT *, refusals / questions AS refusal_rate, prompt_tokens + completion_tokens + support_tokens AS total_tokens FROM u")
def _(r: Repo) -> DataFrame:
    return summary.usage(r.answer_log, 2)


@query("e13_usage_by_mode", "SELECT mode, count(*) AS n, CAST(sum(refused) AS BIGINT) AS refusals, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency FROM answer_log WHERE source = 'USER' GROUP BY mode")
def _(r: Repo) -> DataFrame:
    return summary.usage_by_mode(r.answer_log)


@query("e14_usage_derived", "SELECT repo_id, sum(refused) / count(*) AS refusal_rate, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens FROM answer_log GROUP BY repo_id")
def _(r: Repo) -> DataFrame:
    g = r.answer_log.groupBy("repo_id").agg(F.sum("refused").alias("x"), F.count("*").alias("n"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    return g.select("repo_id", T.ratio(F.col("x"), F.col("n")).alias("refusal_rate"), "tokens")


RESULTS = "SELECT mode AS qtype, CASE WHEN refused = 1 THEN 'REFUSED' WHEN id % 13 = 0 THEN 'FAILED' ELSE 'ANSWERED' END AS status, id % 2 = 0 AS hit, (id % 4) / 4.0 AS f1, latency_ms, user_id FROM answer_log"


def results(r: Repo) -> DataFrame:
    status = F.when(F.col("refused") == 1, "REFUSED").when(F.col("id") % 13 == 0, "FAILED").otherwise("ANSWERED")
    return r.answer_log.select(F.col("mode").alias("qtype"), status.alias("status"), (F.col("id") % 2 == 0).alias("hit"), (F.col("id") % 4 / 4.0).alias("f1"), "latency_ms", "user_id")


@query("e15_eval_report", f"""WITH x AS ({RESULTS}) SELECT coalesce(qtype, 'ALL') AS qtype, count(*) AS total, count(*) FILTER (status = 'ANSWERED') AS answered, count(*) FILTER (status = 'REFUSED') AS refused,
count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'ANSWERED' AND hit) AS hits, count(*) FILTER (status = 'ANSWERED' AND hit) / count(*) AS hit_rate,
CAST(coalesce(avg(f1) FILTER (status = 'ANSWERED'), 0) AS DOUBLE) AS avg_f1, avg(latency_ms) AS avg_latency FROM x GROUP BY ROLLUP (qtype)""")
def _(r: Repo) -> DataFrame:
    return evaluation.report(results(r))


@query("e16_comparison", """SELECT coalesce(mode, 'ALL') AS qtype, count(*) AS n, avg((id % 4) / 4.0) AS vector_recall, avg((id % 8) / 8.0) AS route_recall FROM answer_log GROUP BY ROLLUP (mode)""")
def _(r: Repo) -> DataFrame:
    return evaluation.comparison(r.answer_log.select(F.col("mode").alias("qtype"), (F.col("id") % 4 / 4.0).alias("vector_recall"), (F.col("id") % 8 / 8.0).alias("route_recall")))


@query("e18_job_counts", "SELECT status, count(*) AS n FROM index_job GROUP BY status")
def _(r: Repo) -> DataFrame:
    return summary.job_counts(r.index_job)


@query("s1_reconciled", "SELECT CASE WHEN status IN ('QUEUED', 'RUNNING') THEN 'FAILED' ELSE status END AS status, count(*) AS n FROM index_job GROUP BY 1")
def _(r: Repo) -> DataFrame:
    return summary.job_counts(summary.reconciled(r.index_job, durable=False))


@query("s1_requeued", "SELECT CASE WHEN status = 'RUNNING' THEN 'QUEUED' ELSE status END AS status, count(*) AS n FROM index_job GROUP BY 1")
def _(r: Repo) -> DataFrame:
    return summary.job_counts(summary.reconciled(r.index_job, durable=True))


@query("s2_stale_jobs", "SELECT id, repo_id FROM index_job WHERE status = 'QUEUED' AND updated_at < TIMESTAMP '1997-06-01 00:00:00' - INTERVAL 30 MINUTES")
def _(r: Repo) -> DataFrame:
    return summary.stale(r.index_job, F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"), 30).select("id", "repo_id")


@query("s3_latest_jobs", "SELECT repo_id, max(id) AS id, max_by(status, id) AS status, CAST(max_by(CASE WHEN total > 0 THEN least(100, floor(done * 100 / total)) ELSE 0 END, id) AS INTEGER) AS percent FROM index_job GROUP BY repo_id")
def _(r: Repo) -> DataFrame:
    return summary.latest_jobs(r.index_job)


@query("s4_percent", "SELECT id, CAST(CASE WHEN total > 0 THEN least(100, floor(done * 100 / total)) ELSE 0 END AS INTEGER) AS percent FROM index_job")
def _(r: Repo) -> DataFrame:
    return r.index_job.select("id", T.percent(F.col("done"), F.col("total")).alias("percent"))


@query("s5_cached_semantics", "SELECT id AS repo_id, id % 2 = 0 AS hit FROM repo")
def _(r: Repo) -> DataFrame:
    note = F.when(F.col("id") % 2 == 0, F.lit('{"overview": "x"}')).otherwise(F.lit("{broken"))
    have = r.repo.select(F.col("id").alias("repo_id"), F.lit("t").alias("indexed_at"), F.lit("m").alias("model"), note.alias("notes"))
    return control.cached_semantics(have, have.drop("notes")).select("repo_id", "hit")


# ---- retrieval

OCCURS = "CAST((length(content) - length(replace(lower(content), '{0}', ''))) / {1} AS BIGINT)"


def _phrases(words: list[str], every: bool, limit: int) -> str:
    cols = ", ".join(f"{OCCURS.format(w, len(w))} AS n{k}" for k, w in enumerate(words))
    hit = (" AND " if every else " OR ").join(f"n{k} > 0" for k in range(len(words)))
    score = " + ".join(f"n{k} * pow(log10((SELECT count(*) FROM x) / greatest(1, (SELECT count(*) FROM x WHERE n{k} > 0))), 2)" for k in range(len(words)))
    return f"WITH x AS (SELECT id, file_path, {cols} FROM chunk) SELECT id, file_path, round({score}, 9) AS score FROM x WHERE {hit} ORDER BY {score} DESC, id LIMIT {limit}"


@query("h4_all_phrases", _phrases(["the", "and of"], True, 100000))
def _(r: Repo) -> DataFrame:
    return retrieval.search_phrases(r.chunk, ["the", "and of"], True, 100000).withColumn("score", F.round("score", 9))


@query("h4_any_phrase", _phrases(["idiot", "sh ou"], False, 100000))
def _(r: Repo) -> DataFrame:
    return retrieval.search_phrases(r.chunk, ["idiot", "sh ou"], False, 100000).withColumn("score", F.round("score", 9))


@query("h5_search_falls_back", _phrases(["idiot"], False, 20))
def _(r: Repo) -> DataFrame:
    return retrieval.search(r.chunk, "idiot 不存", 20).withColumn("score", F.round("score", 9))


SQL_BATCH = r"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_$]+'), lambda x: length(x) >= 2))) AS w FROM benchmark),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1), d AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{Nd}_$]{2,}'))) AS w FROM chunk),
h AS (SELECT query_id, id, count(*) AS have FROM q JOIN d ON d.w = q.w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY have DESC, id) AS rank FROM h),
f AS (SELECT r.*, need, max(CASE WHEN have = need THEN 1 ELSE 0 END) OVER (PARTITION BY r.query_id) = 1 AS full_one FROM r JOIN need ON need.query_id = r.query_id WHERE rank <= 5)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, NOT full_one AS relaxed FROM f WHERE NOT full_one OR have = need"""


@query("h5_search_batch", SQL_BATCH)
def _(r: Repo) -> DataFrame:
    return retrieval.search_batch(r.chunk, r.benchmark.select(F.col("item_id").alias("id"), "text"))


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def _index(r: Repo) -> TextIndex:
    """The text index of a table's chunks; built at its first use in a session."""
    key = (r.spark.sparkContext.applicationId, r.dir)
    if key not in _INDEXES:
        base = f"{shared_folder(r.spark)}/text-index-{uuid.uuid4().hex}"
        write_segment(r.chunk, base, 0, 8)
        _INDEXES[key] = TextIndex(r.spark, base, 8)
    return _INDEXES[key]


@query("h4_index_all", _phrases(["the", "and of"], True, 100000))
def _(r: Repo) -> DataFrame:
    return _index(r).search_phrases(r.chunk, ["the", "and of"], True, 100000).withColumn("score", F.round("score", 9))


@query("h4_index_any", _phrases(["idiot", "sh ou"], False, 100000))
def _(r: Repo) -> DataFrame:
    return _index(r).search_phrases(r.chunk, ["idiot", "sh ou"], False, 100000).withColumn("score", F.round("score", 9))


@query("h5_index_falls_back", _phrases(["idiot"], False, 20))
def _(r: Repo) -> DataFrame:
    return _index(r).search(r.chunk, "idiot 不存", 20).withColumn("score", F.round("score", 9))


@query("h5_index_batch", SQL_BATCH)
def _(r: Repo) -> DataFrame:
    return _index(r).search_batch(r.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("b14_terms", r"""SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{Nd}_$]+')) AS term FROM chunk) GROUP BY term""")
def _(r: Repo) -> DataFrame:
    return _index(r).terms()


#: Tokens of a question in SQL: distinct words of two letters or more in their order, then what its Han bigrams fill up to eight.
TOKENS = r"""WITH w AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_$]+'), 1) AS p FROM question),
words AS (SELECT id, w, min(p) AS p FROM w WHERE length(w) >= 2 GROUP BY id, w), n AS (SELECT id, count(*) AS n FROM words GROUP BY id),
runs AS (SELECT id, unnest(regexp_extract_all(text, '\p{Han}+')) AS h, generate_subscripts(regexp_extract_all(text, '\p{Han}+'), 1) AS p FROM question),
pairs AS (SELECT id, CASE WHEN length(h) = 1 THEN h ELSE substr(h, k, 2) END AS w, min(p * 1000 + k) AS p FROM runs, range(1, 100) t(k) WHERE k <= greatest(1, length(h) - 1) GROUP BY 1, 2),
room AS (SELECT pairs.id, w, 100000 + p AS p, row_number() OVER (PARTITION BY pairs.id ORDER BY p) AS r, coalesce(n, 0) AS n FROM pairs LEFT JOIN n ON n.id = pairs.id),
t AS (SELECT id, w, p FROM words UNION ALL SELECT id, w, p FROM room WHERE r <= greatest(0, 8 - n))"""


@query("h1_tokens", TOKENS + " SELECT q.id, coalesce(string_agg(w, ',' ORDER BY p), '') AS t FROM question q LEFT JOIN t ON t.id = q.id GROUP BY q.id")
def _(r: Repo) -> DataFrame:
    return r.question.select("id", F.array_join(T.tokens(F.col("text")), ",").alias("t"))


@query("h2_han", "SELECT doc_id AS id, false AS han FROM documents UNION ALL SELECT id, id % 9 IN (5, 6, 8) FROM question")
def _(r: Repo) -> DataFrame:
    return r.documents.select(F.col("doc_id").alias("id"), F.col("text").rlike(r"\p{IsHan}").alias("han")).unionByName(r.question.select("id", F.col("text").rlike(r"\p{IsHan}").alias("han")))


@query("h3_relaxed", TOKENS + """, k AS (SELECT id, bool_or(regexp_matches(w, '[A-Za-z]')) AS named FROM t GROUP BY id), x AS (SELECT t.* FROM t JOIN k ON k.id = t.id WHERE NOT named OR regexp_matches(w, '[A-Za-z]'))
SELECT q.id, coalesce(string_agg(w, ',' ORDER BY p), '') AS t FROM question q LEFT JOIN x ON x.id = q.id GROUP BY q.id""")
def _(r: Repo) -> DataFrame:
    return r.question.select("id", F.array_join(T.relaxed(T.tokens(F.col("text"))), ",").alias("t"))


@query("h6_symbol_chunks", "SELECT c.id, path, qualified_name, c.start_line, c.end_line FROM chunk c JOIN source_file f ON f.id = c.file_id LEFT JOIN symbol s ON s.id = c.symbol_id WHERE c.kind = 'SYMBOL'")
def _(r: Repo) -> DataFrame:
    return retrieval.symbol_chunks(r.chunk, r.source_file, r.symbol)


VECTOR = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("h7_cosine", f"SELECT e.vec_id, round({VECTOR}, 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q")
def _(r: Repo) -> DataFrame:
    q = r.embeddings.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return r.embeddings.join(F.broadcast(q)).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 9).alias("score"))


@query("h8_vector_top_k", f"SELECT e.vec_id, round({VECTOR}, 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY {VECTOR} DESC, e.vec_id LIMIT 8")
def _(r: Repo) -> DataFrame:
    q = r.embeddings.where("vec_id = 3").select("embedding").first()[0]
    return retrieval.vector_search(r.embeddings, list(q), 8).withColumn("score", F.round("score", 9))


@query("h8_vector_batch", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {VECTOR} AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8""")
def _(r: Repo) -> DataFrame:
    return retrieval.vector_search_batch(r.embeddings, r.embeddings.where("vec_id % 100 = 0"), 8).withColumn("score", F.round("score", 9))


@query("h9_vector_load", "SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64")
def _(r: Repo) -> DataFrame:
    return r.embeddings.where(F.size("embedding") == 64).agg(F.count("*").alias("n"))


@query("h10_missing_vectors", "SELECT id FROM chunk WHERE trim(content) <> '' AND id % 3 <> 1")
def _(r: Repo) -> DataFrame:
    stored = r.chunk.where("id % 3 > 0").select(F.col("id").alias("chunk_id"), F.lit("m").alias("model"), F.lit(64).alias("dimensions"), F.when(F.col("id") % 3 == 1, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return retrieval.missing_vectors(r.chunk, stored, "m", 64).select("id")


@query("h11_backfill")
def _(r: Repo) -> DataFrame:
    return retrieval.embedded(r.chunk, "bag", 32).withColumn("vector", F.transform("vector", lambda x: F.round(x, 5)))


# ---- routing and selection

#: Sentences that say each alternative of the question patterns, and some that say none.
SAID = (
    "Foo 被谁调用", "哪些地方调用 Foo", "Foo 的调用点", "Foo 的调用者", "the callers of Foo", "CALLER OF foo", "Who Calls foo", "foo 调用了谁", "foo 调用了哪些", "foo 依赖了哪些", "foo 会调用什么", "What does foo call",
    "Foo 有哪些实现", "Foo 的实现类", "谁实现了 Foo", "Foo 有几个实现", "an implementation", "is it implemented by Foo", "Foo 有哪些方法", "哪些方法", "Foo 有哪些字段", "Foo 有哪些成员", "Foo 有哪些属性", "Foo 的方法列表", "字段列表", "What methods has Foo", "what fields",
    "Foo 在哪定义", "定义在哪", "Foo 在哪个类", "在哪实现", "在哪里实现", "Foo 的位置", "定义在", "Where is Foo defined", "直接或间接", "调用链", "链路上", "向下游", "最终会被调用", "一路", "追溯到", "追到哪", "它从哪来", "哪里来的", "谁传进来", "参数的来源", "参数是由谁",
    "影响面", "会影响哪", "改一个字段的影响", "完整的链路", "完整流程", "整条链", "Transitive use", "the call  chain", "UPSTREAM of it", "who ends up", "who end up here", "项目是做什么的", "仓库干嘛", "代码库有哪些功能", "系统的用途", "介绍一下项目", "概述这个仓库", "说说系统", "项目的架构", "工程概览", "仓库有哪些模块",
    "整体的架构", "大致情况", "有哪些模块", "模块怎么划分", "分了哪些模块", "What does this repo", "what's is the big project", "whats do the repository", "Overview of this project", "summarize the codebase", "introduce repo", "", "   ", "一段普通的话", "an ordinary sentence", "what else is there",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASKED = "(SELECT id, text FROM question UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - k}, {_quoted(x)})" for k, x in enumerate(SAID)) + ") t(id, text))"
KINDS = "CASE " + " ".join(f"WHEN regexp_matches(text, {_quoted(pattern)}, 'i') THEN '{name}'" for name, pattern in T.ROUTES) + " ELSE 'SEMANTIC' END"


def _any(patterns: tuple[str, ...]) -> str:
    return "trim(text) <> '' AND (" + " OR ".join(f"regexp_matches(text, {_quoted(p)})" for p in patterns) + ")"


def _asked(r: Repo) -> DataFrame:
    return r.question.select("id", "text").unionByName(r.spark.createDataFrame([(-1 - k, x) for k, x in enumerate(SAID)], "id long, text string"))


@query("i4_routes", f"SELECT id, {KINDS} AS route FROM {ASKED}")
def _(r: Repo) -> DataFrame:
    return _asked(r).select("id", T.route(F.col("text")).alias("route"))


STOPS = "('the','and','for','what','which','where','who','why','how','call','calls','called','caller','callers','method','methods','class','classes','implementation','implementations','defined','definition','a','an','is','to','of','in','on','it','by','or','do','as','at','be','we','no','so','if','me','my','up','us')"


@query("i5_identifiers", f"""WITH w AS (SELECT id, generate_subscripts(l, 1) AS p, unnest(l) AS w FROM (SELECT id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*') AS l FROM question)),
f AS (SELECT id, w, min(p) AS p FROM w WHERE lower(w) NOT IN {STOPS} GROUP BY id, w)
SELECT q.id, coalesce(string_agg(w, ',' ORDER BY p), '') AS names FROM question q LEFT JOIN f ON f.id = q.id GROUP BY q.id""")
def _(r: Repo) -> DataFrame:
    return r.question.select("id", F.array_join(T.identifiers(F.col("text")), ",").alias("names"))


TYPES = "('CLASS','INTERFACE','ENUM','RECORD','ANNOTATION')"
ROUTED = f"""q AS (SELECT id, {KINDS} AS wanted, text FROM question), l AS (SELECT id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*') AS l FROM question),
ww AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM l), c AS (SELECT id, w, min(p) AS pos FROM ww WHERE lower(w) NOT IN {STOPS} GROUP BY id, w), n AS (SELECT id, string_agg(w, ',' ORDER BY pos) AS names FROM c GROUP BY id),
h AS (SELECT c.id, pos, w, s.id AS sid, s.kind, s.parent_id, s.qualified_name, CASE WHEN wanted IN ('IMPLEMENTATIONS', 'STRUCTURE') THEN s.kind IN {TYPES} WHEN wanted IN ('CALLERS', 'CALLEES') THEN s.kind IN ('METHOD', 'CONSTRUCTOR') ELSE true END AS fits
    FROM c JOIN q ON q.id = c.id JOIN symbol s ON s.name = c.w),
o AS (SELECT id, sid AS osid, w AS oname FROM h WHERE kind IN {TYPES} QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, strlen(qualified_name), qualified_name, sid) = 1),
b AS (SELECT h.id, 0 AS tier, pos, sid FROM h JOIN o ON o.id = h.id WHERE fits AND parent_id = osid AND w <> oname UNION ALL SELECT id, 1, pos, sid FROM h WHERE fits),
m AS (SELECT id, min(tier * 1000 + pos) AS best FROM b GROUP BY id), t AS (SELECT b.id, list_sort(list(DISTINCT sid)) AS sids FROM b JOIN m ON m.id = b.id WHERE tier * 1000 + pos = best GROUP BY b.id),
routed AS (SELECT q.id, CASE WHEN wanted <> 'SEMANTIC' AND sids IS NULL THEN 'SEMANTIC' ELSE wanted END AS route, coalesce(names, '') AS names, sids FROM q LEFT JOIN t ON t.id = q.id LEFT JOIN n ON n.id = q.id)"""


@query("i6_routed_targets", f"WITH {ROUTED} SELECT id, route, names, coalesce(array_to_string(sids, ','), '') AS target_ids FROM routed")
def _(r: Repo) -> DataFrame:
    return ranking.routed(r.question, r.symbol)


@query("i7_routed_counts", f"""WITH q AS (SELECT id, {KINDS} AS wanted, text FROM question), w AS (SELECT id, wanted, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM q),
h AS (SELECT DISTINCT w.id FROM w JOIN symbol s ON s.name = w.w WHERE lower(w) NOT IN {STOPS} AND CASE WHEN wanted IN ('IMPLEMENTATIONS', 'STRUCTURE') THEN s.kind IN ('CLASS','INTERFACE','ENUM','RECORD','ANNOTATION') WHEN wanted IN ('CALLERS', 'CALLEES') THEN s.kind IN ('METHOD','CONSTRUCTOR') ELSE true END)
SELECT CASE WHEN h.id IS NULL THEN 'SEMANTIC' ELSE wanted END AS route, count(*) AS n FROM q LEFT JOIN h ON h.id = q.id GROUP BY 1""")
def _(r: Repo) -> DataFrame:
    return ranking.routes(r.question, r.symbol).groupBy("route").agg(F.count("*").alias("n"))


@query("i8_chain_intent", f"SELECT id, {_any(T.CHAIN)} AS chain FROM {ASKED}")
def _(r: Repo) -> DataFrame:
    return _asked(r).select("id", T.is_chain(F.col("text")).alias("chain"))


@query("i9_summary_intent", f"SELECT id, {_any(T.SUMMARY)} AS summary FROM {ASKED}")
def _(r: Repo) -> DataFrame:
    return _asked(r).select("id", T.is_summary(F.col("text")).alias("summary"))


@query("i10_resolved_refs")
def _(r: Repo) -> DataFrame:
    refs = r.symbol.select("id", F.when(F.col("id") % 2 == 0, F.col("qualified_name")).otherwise(F.concat(F.lit(" `"), F.col("name"), F.lit("()` "))).alias("ref"))
    return ranking.resolved_refs(refs, r.symbol)


@query("i11_scope", "SELECT id FROM chunk WHERE contains(file_path, 'src3/')")
def _(r: Repo) -> DataFrame:
    return ranking.in_scope(r.chunk, "src3/").select("id")


@query("i13_answers", f"""WITH {ROUTED}, x AS (SELECT id, route, unnest(CASE WHEN route = 'LOCATE' THEN sids ELSE sids[1:1] END) AS tid FROM routed WHERE route <> 'SEMANTIC'),
place AS (SELECT s.id AS nid, path AS file, start_line AS line, qualified_name AS why, parent_id FROM symbol s JOIN source_file f ON f.id = s.file_id),
found AS (SELECT x.id, route, file, call_line AS line, why FROM x JOIN call_edge e ON e.callee_symbol_id = tid JOIN place ON nid = e.caller_symbol_id WHERE route = 'CALLERS'
    UNION ALL SELECT x.id, route, file, line, why FROM x JOIN call_edge e ON e.caller_symbol_id = tid JOIN place ON nid = e.callee_symbol_id WHERE route = 'CALLEES'
    UNION ALL SELECT x.id, route, file, line, why FROM x JOIN place ON place.parent_id = tid WHERE route = 'STRUCTURE'
    UNION ALL SELECT x.id, route, file, line, why FROM x JOIN type_relation r ON r.super_symbol_id = tid JOIN place ON nid = r.sub_symbol_id WHERE route = 'IMPLEMENTATIONS')
SELECT DISTINCT * FROM found UNION SELECT x.id, route, file, line, why FROM x JOIN place ON nid = tid WHERE x.id NOT IN (SELECT id FROM found)""")
def _(r: Repo) -> DataFrame:
    return ranking.answers(r.question, r.symbol, r.source_file, r.call_edge, r.type_relation)


def _hits(r: Repo) -> DataFrame:
    """Every chunk as a candidate of a made-up question, ten by ten."""
    own = r.chunk.select(F.floor(F.col("id") / 10).alias("question_id"), "id", "file_path", "start_line", "end_line", "content", "token_estimate", F.lit("main").alias("question"), F.when(F.col("id") % 4 == 0, F.lit("a.B#main/0")).otherwise(F.lit("a.B#other/0")).alias("qualified_name"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("id")))


@query("i1_selected_context")
def _(r: Repo) -> DataFrame:
    return ranking.select_context(_hits(r), 1500, 5, 2)


@query("i2_promoted", """WITH h AS (SELECT CAST(floor(id / 10) AS BIGINT) AS question_id, id, row_number() OVER (PARTITION BY CAST(floor(id / 10) AS BIGINT) ORDER BY id) AS rank FROM chunk)
SELECT question_id, id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END, rank) AS INTEGER) AS place FROM h""")
def _(r: Repo) -> DataFrame:
    return ranking.promoted(_hits(r)).select("question_id", "id", "place")


@query("i3_simple_names", r"SELECT id, CASE WHEN contains(qualified_name, '#') THEN regexp_extract(qualified_name, '#([^/]*)', 1) ELSE regexp_extract(qualified_name, '([^.]*)$', 1) END AS n FROM symbol")
def _(r: Repo) -> DataFrame:
    return r.symbol.select("id", T.simple_name(F.col("qualified_name")).alias("n"))


# ---- evidence

CHECKED = """SELECT e.id, e.question_id, e.file, e.start_line, e.end_line, CASE WHEN e.file = '' THEN 'FILE_NOT_FOUND' WHEN starts_with(e.file, '..') THEN 'PATH_ESCAPES_REPO' WHEN f.path IS NULL THEN 'FILE_NOT_FOUND'
WHEN e.start_line < 1 OR e.end_line < e.start_line OR e.end_line > f.loc THEN 'LINE_OUT_OF_RANGE' ELSE 'OK' END AS failure FROM evidence e LEFT JOIN source_file f ON f.path = e.file"""


@query("j1_verified", CHECKED)
def _(r: Repo) -> DataFrame:
    return evidence.verified(r.evidence, r.source_file)


@query("j1_failures", f"WITH c AS ({CHECKED}) SELECT failure, count(*) AS n FROM c GROUP BY failure")
def _(r: Repo) -> DataFrame:
    return evidence.failures(evidence.verified(r.evidence, r.source_file))


@query("j2_snippets", """WITH q AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(regexp_replace(x, '\\s+', ' ', 'g'))) >= 12)) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN false WHEN doc_id % 3 = 0 AND n > 0 THEN true END AS ok FROM q""")
def _(r: Repo) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, "no such words at all here").otherwise("short")
    return r.documents.select("doc_id", evidence.snippet_matches(said, F.col("text")).alias("ok"))


@query("j3_normalised", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def _(r: Repo) -> DataFrame:
    return r.documents.select("doc_id", F.md5(T.squeezed(F.col("text"))).alias("h"))


def _given(r: Repo) -> DataFrame:
    return r.source_file.select(F.col("path").alias("g_file"), F.lit(40).cast("long").alias("g_start"), F.col("loc").cast("long").alias("g_end"))


@query("j4_repaired", f"""WITH c AS ({CHECKED}), g AS (SELECT DISTINCT question_id AS q, path, loc FROM evidence JOIN source_file ON path = 'src/nation_6.java'),
m AS (SELECT c.*, g.path, g.loc FROM c LEFT JOIN g ON q = question_id AND ((failure = 'LINE_OUT_OF_RANGE' AND path = file) OR (failure = 'FILE_NOT_FOUND' AND (ends_with(path, file) OR ends_with(file, path)))))
SELECT id, question_id, CASE WHEN failure = 'OK' OR path IS NULL THEN file ELSE path END AS file, CASE WHEN failure = 'OK' OR path IS NULL THEN start_line ELSE 1 END AS start_line,
CASE WHEN failure = 'OK' OR path IS NULL THEN end_line ELSE CAST(loc AS BIGINT) END AS end_line, CASE WHEN failure = 'OK' THEN 'KEPT' WHEN path IS NULL THEN 'DROPPED' WHEN failure = 'LINE_OUT_OF_RANGE' THEN 'RANGE_FIXED' ELSE 'PATH_FIXED' END AS action FROM m""")
def _(r: Repo) -> DataFrame:
    file = r.source_file.where("path = 'src/nation_6.java'").select(F.col("path").alias("file_path"), F.lit(1).cast("long").alias("start_line"), F.col("loc").cast("long").alias("end_line"), F.lit(1).alias("rank"))
    given = r.evidence.select("question_id").distinct().join(F.broadcast(file))
    return evidence.repaired(evidence.verified(r.evidence, r.source_file), given)


@query("j5_covered", "SELECT e.id, e.file FROM evidence e JOIN source_file f ON f.path = e.file WHERE e.start_line >= 40 AND e.end_line <= f.loc")
def _(r: Repo) -> DataFrame:
    return evidence.covered(r.evidence, evidence.merged_ranges(_given(r).unionByName(_given(r)))).select("id", "file")


@query("j6_spans", """WITH k AS (SELECT DISTINCT question_id, concat(file, ':', start_line) AS key, file, start_line FROM evidence WHERE file <> '')
SELECT k.question_id, key, e.id AS hit_id FROM k JOIN evidence e ON e.question_id = k.question_id AND e.file = k.file AND k.start_line BETWEEN e.start_line AND e.end_line""")
def _(r: Repo) -> DataFrame:
    keys = r.evidence.where("file <> ''").select("question_id", F.concat_ws(":", "file", F.col("start_line").cast("string")).alias("key")).distinct()
    return evidence.spans(keys, r.evidence.withColumnRenamed("file", "file_path"))


@query("j7_review_ranges", """WITH g AS (SELECT path, start_line AS a, least(end_line, start_line + 249) AS b FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE s.id = 3
UNION ALL SELECT path, start_line, end_line FROM symbol s JOIN source_file f ON f.id = s.file_id WHERE s.parent_id = 3)
SELECT e.id FROM evidence e WHERE EXISTS (SELECT 1 FROM g WHERE g.path = e.file AND g.a <= e.start_line AND g.b >= e.end_line)""")
def _(r: Repo) -> DataFrame:
    s = r.symbol.join(r.source_file.select(F.col("id").alias("file_id"), "path"), "file_id")
    ranges = evidence.review_ranges(s.where("id = 3"), s.where("parent_id = 3"), r.call_edge.where("false").select(F.lit("").alias("path"), "call_line"))
    return evidence.covered(r.evidence, ranges).select("id")


@query("j8_support", "SELECT id, CASE id % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'UNSUPPORTED' WHEN 2 THEN 'UNKNOWN' ELSE 'UNAVAILABLE' END AS verdict FROM answer_log")
def _(r: Repo) -> DataFrame:
    said = F.element_at(F.array(F.lit(" Supported"), F.lit("unsupported"), F.lit("UNKNOWN "), F.lit("sure!")), (F.col("id") % 4 + 1).cast("int"))
    return r.answer_log.select("id", evidence.support(said).alias("verdict"))


#: Every evidence cites lines of a document; limits as in evidence.material.
MATERIAL = r"""WITH c AS (SELECT question_id AS claim_id, id AS place, concat('doc/', CAST(question_id % 200 AS VARCHAR)) AS path, id % 5 AS s, id % 5 + id % 60 AS e,
    row_number() OVER (PARTITION BY question_id ORDER BY id) AS r, count(*) OVER (PARTITION BY question_id) AS total FROM evidence),
f AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS path, regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS ls FROM documents),
x AS (SELECT c.claim_id, c.r, k, concat(CAST(k AS VARCHAR), ': ', ls[k], chr(10)) AS one FROM c JOIN f USING (path), unnest(range(greatest(1, s), least(e, greatest(1, s) + 39, len(ls)) + 1)) AS t(k) WHERE r <= 6),
y AS (SELECT *, coalesce(sum(length(one)) OVER (PARTITION BY claim_id, r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
z AS (SELECT claim_id, r, string_agg(one, '' ORDER BY k) AS code FROM y WHERE before < 1500 GROUP BY ALL)
SELECT c.claim_id, c.place, concat(path, ':', CAST(s AS VARCHAR), '-', CAST(e AS VARCHAR)) AS location, md5(coalesce(code, '(no code can be read here)')) AS code, total - least(total, 6) AS more
FROM c LEFT JOIN z ON z.claim_id = c.claim_id AND z.r = c.r WHERE c.r <= 6"""


@query("j8_material", MATERIAL)
def _(r: Repo) -> DataFrame:
    n = F.col("id")
    cited = r.evidence.select(F.col("question_id").alias("claim_id"), n.alias("place"), F.concat(F.lit("doc/"), (F.col("question_id") % 200).cast("string")).alias("file"), (n % 5).alias("start_line"), (n % 5 + n % 60).alias("end_line"), F.lit("").alias("why"))
    files = r.documents.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return evidence.material(cited, files).select("claim_id", "place", "location", F.md5("code").alias("code"), "more")


@query("j9_prose_check", f"""WITH w AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM question), u AS (SELECT DISTINCT id, w FROM w WHERE lower(w) NOT IN {STOPS} AND length(w) > 1 AND w NOT IN (SELECT name FROM symbol))
SELECT q.id, coalesce(string_agg(w, ',' ORDER BY w), '') AS unknown FROM question q LEFT JOIN u ON u.id = q.id GROUP BY q.id""")
def _(r: Repo) -> DataFrame:
    return evidence.prose_check(r.question, r.symbol).select("id", "unknown")


@query("j10_stale", "SELECT id FROM chunk WHERE id % 5 = 0")
def _(r: Repo) -> DataFrame:
    return r.chunk.where(F.md5("content") != F.when(F.col("id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash"))).select("id")


# ---- grading

KEYS = "SELECT l_partkey AS id, CASE WHEN l_partkey % 5 = 0 THEN 'LOCATE' ELSE 'CALLERS' END AS qtype, list(DISTINCT l_suppkey) FILTER (l_linenumber % 2 = 0) AS t, list(DISTINCT l_suppkey) FILTER (CASE WHEN l_partkey % 3 = 0 THEN l_linenumber % 2 = 0 ELSE l_linenumber < 4 END) AS c FROM lineitem GROUP BY l_partkey"


@query("k4_graded", f"""WITH k AS (SELECT id, qtype, coalesce(t, []) AS t, coalesce(c, []) AS c FROM ({KEYS})),
x AS (SELECT *, len(list_intersect(t, c)) AS b FROM k), y AS (SELECT *, CASE WHEN len(c) > 0 THEN b / len(c) ELSE 0 END AS p, CASE WHEN len(t) > 0 THEN b / len(t) ELSE 0 END AS r FROM x),
z AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM y)
SELECT id, CASE WHEN len(t) = 0 THEN false WHEN qtype = 'LOCATE' THEN r = 1 ELSE f >= 0.999 END AS hit, round(CASE WHEN len(t) = 0 THEN 0 WHEN qtype = 'LOCATE' THEN CASE WHEN r = 1 THEN 1 ELSE 0 END ELSE f END, 9) AS f1 FROM z""")
def _(r: Repo) -> DataFrame:
    pick = lambda on: F.collect_set(F.when(on, F.col("l_suppkey")))
    k = r.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(pick(F.col("l_linenumber") % 2 == 0).alias("truth"), pick(F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber") % 2 == 0).otherwise(F.col("l_linenumber") < 4)).alias("claimed"))
    k = k.withColumn("qtype", F.when(F.col("id") % 5 == 0, "LOCATE").otherwise("CALLERS"))
    return evaluation.graded(k).select("id", "hit", F.round("f1", 9).alias("f1"))


@query("k5_span_scores", """WITH k AS (SELECT DISTINCT question_id, file, start_line FROM evidence WHERE file <> '' AND start_line <= 90), h AS (SELECT * FROM evidence WHERE file <> ''),
s AS (SELECT k.question_id, k.file, k.start_line, h.id FROM k JOIN h ON h.question_id = k.question_id AND h.file = k.file AND k.start_line BETWEEN h.start_line AND h.end_line)
SELECT s.question_id, count(DISTINCT concat(s.file, ':', s.start_line)) / any_value(m.n) AS recall, count(DISTINCT s.id) / any_value(g.n) AS precision FROM s JOIN (SELECT question_id, count(*) AS n FROM k GROUP BY 1) m ON m.question_id = s.question_id
JOIN (SELECT question_id, count(DISTINCT id) AS n FROM h GROUP BY 1) g ON g.question_id = s.question_id GROUP BY s.question_id""")
def _(r: Repo) -> DataFrame:
    own = r.evidence.where("file <> ''")
    keys = own.where("start_line <= 90").select("question_id", F.concat_ws(":", "file", F.col("start_line").cast("string")).alias("key")).distinct()
    return evaluation.span_scores(keys, own.withColumnRenamed("file", "file_path"))


@query("k7_eval_runs", f"SELECT status, count(*) AS n FROM ({RESULTS}) GROUP BY status")
def _(r: Repo) -> DataFrame:
    return results(r).groupBy("status").agg(F.count("*").alias("n"))


@query("k8_chain_metrics", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'single' ELSE 'multi' END AS mode, count(*) AS n, avg(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 1 END) AS recall, avg(o_orderkey % 8) AS seconds FROM orders GROUP BY 1")
def _(r: Repo) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    runs = r.orders.select(F.when(even, "single").otherwise("multi").alias("mode"), F.array(F.lit(1), F.lit(2)).alias("truth"), F.when(even, F.array(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(2), F.lit(1))).alias("found"), (F.col("o_orderkey") % 8).alias("seconds"))
    return evaluation.chain_metrics(runs)


# ---- chunks and small functions


@query("c11_text_chunks", """WITH l AS (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM documents WHERE text <> ''), s AS (SELECT doc_id, l, unnest(range(0, len(l), 3)) AS s FROM l),
c AS (SELECT doc_id, s + 1 AS start_line, least(s + 3, len(l)) AS end_line, array_to_string(l[s + 1:s + 3], chr(10)) AS content FROM s)
SELECT CAST(doc_id AS VARCHAR) AS path, start_line, end_line, sha256(content) AS content_hash, greatest(1, CAST(floor(length(content) / 3) AS BIGINT)) AS token_estimate FROM c WHERE regexp_replace(content, '\\s+', '', 'g') <> ''""")
def _(r: Repo) -> DataFrame:
    return chunks.text_chunks(r.documents.where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), 3).drop("content")


@query("c12_token_estimates", "SELECT doc_id, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS code, greatest(1, CAST(floor(length(text) / 3) AS BIGINT)) AS plain FROM documents")
def _(r: Repo) -> DataFrame:
    return r.documents.select("doc_id", T.token_estimate(F.col("text")).alias("code"), T.token_estimate(F.col("text"), 3).alias("plain"))


@query("c13_hashes", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(r: Repo) -> DataFrame:
    return r.documents.select("doc_id", F.sha2("text", 256).alias("h"))


@query("c14_clip", "SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 77), '...') ELSE text END AS t FROM documents")
def _(r: Repo) -> DataFrame:
    return r.documents.select("doc_id", T.clip(F.col("text"), 80).alias("t"))


@query("c15_javadoc", "SELECT doc_id, CASE WHEN length(trim(text)) > 500 THEN concat(substr(trim(text), 1, 500), '...') ELSE trim(text) END AS t FROM documents")
def _(r: Repo) -> DataFrame:
    return r.documents.select("doc_id", T.clip_javadoc(F.col("text")).alias("t"))


@query("c16_keys", "SELECT s_suppkey AS id, concat('a.b.', s_name, '#run/', CAST(s_nationkey AS VARCHAR)) AS k FROM supplier")
def _(r: Repo) -> DataFrame:
    return r.supplier.select(F.col("s_suppkey").alias("id"), T.method_key(T.type_key(F.lit("a.b"), F.col("s_name")), F.lit("run"), F.col("s_nationkey")).alias("k"))


@query("a9_archive_names", "SELECT c_custkey AS id, concat('My-Repo-', CAST(c_custkey AS VARCHAR)) AS n FROM customer")
def _(r: Repo) -> DataFrame:
    return r.customer.select(F.col("c_custkey").alias("id"), T.archive_name(F.concat(F.lit("up\\load/ My Repo "), F.col("c_custkey").cast("string"), F.lit(".ZIP"))).alias("n"))


@query("a11_file_window", "WITH l AS (SELECT unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS line FROM documents WHERE doc_id = 11) SELECT line, text, false AS changed FROM l WHERE line BETWEEN 2 AND 5")
def _(r: Repo) -> DataFrame:
    files = r.documents.where("doc_id = 11").select(F.lit("d.txt").alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"))
    return chunks.window(files, "d.txt", 2, 5)


@query("m10_budgets", """WITH x AS (SELECT *, count(*) OVER w AS r, coalesce(sum(latency_ms) OVER w, 0) AS d, coalesce(sum(prompt_tokens + completion_tokens) OVER w, 0) AS t FROM answer_log WINDOW w AS (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT id, user_id, CASE WHEN r >= 12 THEN 'ROUNDS' WHEN d >= 900 THEN 'DURATION' WHEN t >= 500 THEN 'TOKENS' END AS now FROM x)
SELECT id, user_id, first_value(now IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped_by FROM y""")
def _(r: Repo) -> DataFrame:
    steps = r.answer_log.select("id", "user_id", F.col("latency_ms").alias("ms"), "prompt_tokens", "completion_tokens")
    return control.budgeted(steps, "user_id", "id", 12, 900, 500, 1.0, 0.0, 0.0).select("id", "user_id", "stopped_by")


@query("m11_no_progress", """WITH a AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id, mode ORDER BY id) > 1 AS repeat FROM answer_log), b AS (SELECT *, sum(CASE WHEN repeat THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY id) AS g FROM a),
c AS (SELECT *, sum(CAST(repeat AS INTEGER)) OVER (PARTITION BY user_id, g ORDER BY id) AS n FROM b) SELECT id, repeat, bool_or(n >= 3) OVER (PARTITION BY user_id ORDER BY id) AS halted FROM c""")
def _(r: Repo) -> DataFrame:
    return control.no_progress(r.answer_log, "user_id", "id", "mode").select("id", "repeat", "halted")


@query("m12_compacted", """SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 2 THEN text ELSE CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 120
THEN concat(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 117), '...') ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END END AS text FROM conversations""")
def _(r: Repo) -> DataFrame:
    return control.compacted(r.conversations, "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "text")


@query("m13_cache_keys", "SELECT id, concat('answer:', CAST(repo_id AS VARCHAR), ':t:', sha256(concat('e', chr(10), 'm', chr(10), mode, chr(10), question))) AS k FROM answer_log")
def _(r: Repo) -> DataFrame:
    return r.answer_log.select("id", T.cache_key(F.col("repo_id"), F.lit("t"), F.lit("e"), F.lit("m"), F.col("mode"), F.col("question")).alias("k"))


@query("m13_cached_answers")
def _(r: Repo) -> DataFrame:
    return control.cached(r.answer_log.select("id", "question", "ts"), "question", "ts", 60).select("id", "hit")


@query("m14_ledger_rows", "SELECT id, CAST((prompt_tokens * 2.5 + completion_tokens * 10) / 1000000 AS DECIMAL(12,6)) AS cost FROM answer_log")
def _(r: Repo) -> DataFrame:
    own = r.answer_log.withColumn("refusal_reason", F.lit(None).cast("string"))
    return control.ledger_row(own, 2.5, 10.0).select("id", "cost")


@query("m15_route_json", "SELECT id, concat('{\"route\":\"', mode, '\",\"targets\":[\"', question, '\"],\"deep\":true}') AS j FROM answer_log")
def _(r: Repo) -> DataFrame:
    return r.answer_log.select("id", control.route_json(F.col("mode"), F.array("question"), F.lit(True)).alias("j"))


@query("m16_tolerant_json", "SELECT id, question AS answer FROM answer_log")
def _(r: Repo) -> DataFrame:
    raw = F.concat(F.lit('```json\n{"answer": "'), F.col("question"), F.lit('", "x": "a\\d"}\n```'))
    return r.answer_log.select("id", control.parsed(raw, "answer string")["answer"].alias("answer"))


@query("m17_cited", "SELECT id, file, start_line, end_line FROM evidence WHERE file <> '' AND end_line >= start_line")
def _(r: Repo) -> DataFrame:
    own = r.evidence.select("id", F.when(F.col("file") == "", "").otherwise(F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))).alias("file"), F.lit(None).cast("long").alias("start_line"), F.lit(None).cast("long").alias("end_line"))
    return control.cited(own)


@query("m18_summary_evidence", """WITH t AS (SELECT kind, qualified_name, row_number() OVER (PARTITION BY kind ORDER BY id) AS place FROM symbol WHERE kind IN ('CLASS', 'INTERFACE', 'ENUM'))
SELECT DISTINCT qualified_name AS location FROM t WHERE place <= CASE WHEN kind = 'ENUM' THEN 4 ELSE 3 END""")
def _(r: Repo) -> DataFrame:
    """Places in order of ids: classes as entry points, interfaces as hubs, enums as key types."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    types = r.symbol.where("kind in ('CLASS', 'INTERFACE', 'ENUM')").select("kind", place.alias("place"), F.col("qualified_name").alias("location"))
    some = lambda k: types.where(F.col("kind") == k).select("place", "location")
    return control.summary_evidence(some("CLASS"), some("INTERFACE"), some("ENUM")).select("location")


@query("m24_token_bucket", """WITH RECURSIVE e AS (SELECT id, user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), id) AS k FROM answer_log),
b AS (SELECT id, user_id, sec, k, CAST(5 AS DOUBLE) AS level FROM e WHERE k = 1
    UNION ALL SELECT e.id, e.user_id, e.sec, e.k, least(CAST(5 AS DOUBLE), CASE WHEN level >= 1 THEN level - 1 ELSE level END + (e.sec - b.sec) * CAST(0.001 AS DOUBLE)) FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT id, user_id, sec AS "at", level >= 1 AS allowed FROM b""")
def _(r: Repo) -> DataFrame:
    own = r.answer_log.select("id", "user_id", F.unix_timestamp("ts").cast("double").alias("at"))
    return control.allowed(own, "user_id", "at", 5.0, 0.001, "id")


@query("m25_severities", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'unknown' END AS s FROM events")
def _(r: Repo) -> DataFrame:
    return r.events.select(F.col("event_id").alias("id"), T.severity(F.when(F.col("event_id") % 3 == 0, "HIGH").otherwise(F.col("event_type"))).alias("s"))


@query("m26_client_keys", "SELECT user_id AS id, concat('ip:', CASE WHEN user_id % 2 = 0 THEN '10.0.0.1' ELSE 'remote' END) AS k FROM events")
def _(r: Repo) -> DataFrame:
    return r.events.select(F.col("user_id").alias("id"), T.client_key(F.when(F.col("user_id") % 2 == 0, " 10.0.0.1 , 10.0.0.2"), F.lit("remote")).alias("k"))


@query("m27_messages", "SELECT doc_id, substr(text, 1, 240) AS t FROM documents")
def _(r: Repo) -> DataFrame:
    return r.documents.select("doc_id", F.substring("text", 1, 240).alias("t"))


@query("m29_lock_keys", "SELECT id, concat('lock:', substr(sha256(path), 1, 16)) AS k FROM source_file")
def _(r: Repo) -> DataFrame:
    return r.source_file.select("id", T.lock_key(F.col("path")).alias("k"))


@query("b9_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE label END AS label FROM embeddings")
def _(r: Repo) -> DataFrame:
    from ..sources.store import upsert

    old = r.embeddings.select("vec_id", "label")
    return upsert(old, old.where("vec_id % 2 = 0").withColumn("label", F.lit(1)), ["vec_id"])


@query("b7_orphan_edges", "SELECT count(*) AS n FROM call_edge WHERE caller_symbol_id NOT IN (SELECT id FROM symbol)")
def _(r: Repo) -> DataFrame:
    return r.call_edge.join(r.symbol.select(F.col("id").alias("caller_symbol_id")), "caller_symbol_id", "left_anti").agg(F.count("*").alias("n"))


@query("b13_job_states", "SELECT o_custkey % 50 AS job_id, max(o_orderkey) AS updated_at, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def _(r: Repo) -> DataFrame:
    from ..sources.store import jobs

    e = r.orders.select((F.col("o_custkey") % 50).alias("job_id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("done"), F.lit(0).alias("total"), F.lit("").alias("message"))
    return jobs(e).select("job_id", "updated_at", "status")


# ---- files by path, schema defaults, two-stage retrieval


PATHS = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN concat('m', CAST(c_custkey % 5 AS VARCHAR), '/src/main/java/x/A', CAST(c_custkey AS VARCHAR), '.java') WHEN 1 THEN concat('target/src/main/java/G', CAST(c_custkey AS VARCHAR), '.java')
WHEN 2 THEN concat('doc/n', CAST(c_custkey AS VARCHAR), '.md') WHEN 3 THEN concat('web/node_modules/x', CAST(c_custkey AS VARCHAR), '.js') WHEN 4 THEN 'web/yarn.lock' WHEN 5 THEN concat('conf/a', CAST(c_custkey AS VARCHAR), '.YML')
WHEN 6 THEN concat('bin/t', CAST(c_custkey AS VARCHAR)) ELSE concat('m', CAST(c_custkey % 5 AS VARCHAR), '/src/test/java/T', CAST(c_custkey AS VARCHAR), '.java') END AS path FROM customer"""


def _paths(r: Repo) -> DataFrame:
    return r.spark.sql(PATHS.replace("VARCHAR", "STRING").replace("FROM customer", "FROM {customer}"), customer=r.customer)


@query("a1_source_roots", f"SELECT DISTINCT regexp_extract(path, '^((?:.*/)?src/main/java)/', 1) AS root FROM ({PATHS}) WHERE regexp_matches(path, '^(?:.*/)?src/main/java/') AND NOT starts_with(path, 'target/')")
def _(r: Repo) -> DataFrame:
    from ..sources.files import excluded, source_roots

    return source_roots(_paths(r).where(~excluded(F.col("path"))))


@query("a2_java_files", f"SELECT id, path FROM ({PATHS}) WHERE id % 8 = 0")
def _(r: Repo) -> DataFrame:
    from ..sources.files import excluded, java_files

    return java_files(_paths(r).where(~excluded(F.col("path"))))


@query("a3_excluded", f"SELECT id, id % 8 IN (1, 3) AS excluded FROM ({PATHS})")
def _(r: Repo) -> DataFrame:
    from ..sources.files import excluded

    return _paths(r).select("id", excluded(F.col("path")).alias("excluded"))


@query("a4_text_paths", f"SELECT id, id % 8 IN (2, 3, 5) AS text_file FROM ({PATHS})")
def _(r: Repo) -> DataFrame:
    from ..sources.files import is_text_path

    return _paths(r).select("id", is_text_path(F.col("path")).alias("text_file"))


@query("a5_size_guards", """SELECT concat('d', CAST(doc_id AS VARCHAR), '.md') AS path, strlen(text) // 1024 <= 4 AND (length(text) = 0 OR len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) <= 6) AS parsed_ok FROM documents""")
def _(r: Repo) -> DataFrame:
    from ..sources.files import text_files

    own = r.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return text_files(own, max_kb=4, max_lines=6).select("path", "parsed_ok")


@query("b15_defaults", "SELECT event_id AS id, 'USER' AS origin FROM events")
def _(r: Repo) -> DataFrame:
    from ..sources.store import with_columns

    return with_columns(r.events.select(F.col("event_id").alias("id")), {"origin": F.lit("USER")})


@query("b12_latest_semantics", "SELECT user_id, event_type AS model, max(event_id) AS id FROM events GROUP BY ALL")
def _(r: Repo) -> DataFrame:
    rows = r.events.select("user_id", F.col("event_type").alias("model"), F.col("event_id").alias("id"))
    return control.latest(rows, ["user_id", "model"], "id")


@query("c9_symbol_chunks", """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM documents WHERE text <> ''),
c AS (SELECT path, 'SYMBOL' AS kind, CAST(2 AS BIGINT) AS start_line, CAST(3 AS BIGINT) AS end_line, array_to_string(l[2:3], chr(10)) AS content FROM d WHERE len(l) >= 2 UNION ALL SELECT path, 'FILE_HEADER', 1, 1, l[1] FROM d)
SELECT path, kind, start_line, end_line, sha256(content) AS content_hash FROM c WHERE trim(content) <> ''""")
def _(r: Repo) -> DataFrame:
    own = r.documents.where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    members = own.select("path", F.lit("METHOD").alias("kind"), F.lit("a.B#f/0").alias("qualified_name"), F.lit(2).cast("long").alias("start_line"), F.lit(3).cast("long").alias("end_line"))
    return chunks.symbol_chunks(own, members).select("path", "kind", "start_line", "end_line", "content_hash")


@query("c10_line_slices", "SELECT doc_id, nullif(array_to_string(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))[2:4], chr(10)), '') AS t FROM documents WHERE text <> ''")
def _(r: Repo) -> DataFrame:
    cut = T.line_slice(T.lines(F.col("text")), F.lit(2), F.lit(4))
    return r.documents.where("text <> ''").select("doc_id", F.when(cut != "", cut).alias("t"))


@query("i12_two_stages")
def _(r: Repo) -> DataFrame:
    found = retrieval.search_batch(r.chunk, r.benchmark.select(F.col("item_id").alias("id"), "text"), 20)
    own = found.join(r.chunk, "id").join(r.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    hits = own.select(F.col("query_id").alias("question_id"), "id", "rank", "question", F.lit(None).cast("string").alias("qualified_name"), "file_path", "start_line", "end_line", "content", "token_estimate")
    return ranking.select_context(hits, 3000, 5, 3)


@query("k6_compared", "SELECT id AS question_id, mode AS qtype, (id % 4) / 4.0 AS vector_recall, (id % 8) / 8.0 AS route_recall FROM answer_log")
def _(r: Repo) -> DataFrame:
    side = lambda n: r.answer_log.select(F.col("id").alias("question_id"), F.col("mode").alias("qtype"), (F.col("id") % n / float(n)).alias("recall"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("f1"), "latency_ms")
    return evaluation.compared(side(4), side(8)).select("question_id", "qtype", "vector_recall", "route_recall")
