"""The queries of this subpackage: thin reports over the operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, conversations, decontaminate, gam, hilbert, lines, pii, secret_scan, simhash, toxicity, url_filter
from .common import crc_mod, table


def tokenizer_path() -> str:
    """Where the word-end BPE file is; PRISMATA_TOKENIZER overrides it."""
    if named := os.environ.get("PRISMATA_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), ids=False, digest=True).drop("text")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 3) == 1
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), "toxic", out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "h")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crc_mod("doc_id", 5) == 0
    scored = gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op8_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lines.dedup(docs, counts=True)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Fixed values of the URL report: rules as (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Site names whose URLs make up the listed URLs of the report.
LISTED_SITES = ("spam-farm", "cheap-pills", "adult-x", "free-bets")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is every distinct canonical URL of a listed site; it grows with the table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.split(url_filter.canonical(F.col("url")), r"\.")[0].isin(*LISTED_SITES)).select("url")
    return url_filter.judge(pages, RULES, listed)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return codes.digest(*codes.compress(vectors))


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, g, len(g) AS size FROM
    (SELECT item, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: w[k:k + 9])) AS g FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT doc_id, k, size, w[k:k + size - 1] AS g FROM
    (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, k, win.size, item FROM pos JOIN win ON pos.g = win.g),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_REST = "CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END"
_FIT = "((host = '{1}' OR ends_with(host, '.{1}')) AND starts_with(path, '{2}'))"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP10_SQL = f"""
WITH r AS (SELECT page_id, {_REST} AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
c AS (SELECT *, regexp_replace(host, '^(?:www|m|blog)\\.', '') || regexp_replace(regexp_replace(path, '\\.html$', ''), '/+$', '') AS key FROM p),
l AS (SELECT *, key <> '' AND key IN (SELECT key FROM c WHERE split_part(key, '.', 1) IN {LISTED_SITES}) AS listed FROM c)
SELECT page_id, host, path,
    CASE {' '.join(f"WHEN {_FIT.format(*r)} THEN '{r[1] + r[2]}'" for r in _BY_LENGTH)} END AS rule,
    CASE {' '.join(f"WHEN {_FIT.format(*r)} THEN '{r[0]}'" for r in _BY_LENGTH)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM l
"""

def _crc_table() -> list[int]:
    """The 256 remainders of the byte-wise CRC-32, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: Costs are eight digits in front of the audit so far: the least string is the cheapest, then the first.
_PLUS = "lpad(CAST(CAST({0}[1:8] AS INT) + {1} AS VARCHAR), 8, '0') || {0}[9:] || '{2}'"
_AFTER_S = "least(" + ", ".join(_PLUS.format(m, "{0}", "{1}") for m in ("m0", "m1", "m3")) + ")"
_AFTER_U = _PLUS.format("m2", "{0}", "{1}")
_CUT = "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
_STAYS = "fault IN ('', 'truncated')"
OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT {_crc_table()}::UBIGINT[] AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS b FROM conversations),
c AS (SELECT o.*, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(b, lambda x: CAST(ascii(x) AS UBIGINT))), lambda r, x: xor(r >> 8, t[CAST((xor(r, x) & 255) AS INT) + 1])), 4294967295::UBIGINT) % 20 AS INT) AS crc FROM o, t),
d AS (SELECT conv_id, turn, CASE WHEN crc = 4 THEN 'user' ELSE role END AS role, CASE crc WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT * FROM c WHERE crc > 0 UNION ALL SELECT * FROM c WHERE crc = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM d),
x AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
p AS (SELECT conv_id, 0::BIGINT AS k, '00000000' AS m0, NULL::VARCHAR AS m1, '00000005I' AS m2, '00000010II' AS m3 FROM conversations GROUP BY conv_id
    UNION ALL SELECT conv_id, k, m0, m1, n2, least(m3, {_PLUS.format("n2", 5, "I")}) FROM (
        SELECT *, least(m2, {_AFTER_S.format(5, "I")}) AS n2 FROM (
            SELECT p.conv_id, x.k, least({_PLUS.format("m0", 2, "D")}, CASE WHEN {_STAYS} AND i = '' THEN {_PLUS.format("m0", _CUT, "K")} END) AS m0,
                least({_PLUS.format("m1", 2, "D")}, CASE WHEN {_STAYS} AND i = '' THEN {_PLUS.format("m1", _CUT, "K")} WHEN {_STAYS} AND i = 's' THEN {_PLUS.format("m0", _CUT, "K")} END) AS m1,
                least({_PLUS.format("m2", 2, "D")}, CASE WHEN {_STAYS} AND i = '' THEN {_PLUS.format("m2", _CUT, "K")} WHEN {_STAYS} AND i = 'u' THEN {_AFTER_S.format(_CUT, "K")} END, CASE WHEN {_STAYS} THEN {_AFTER_S.format(f"1 + {_CUT}", "R")} END) AS m2,
                least({_PLUS.format("m3", 2, "D")}, CASE WHEN {_STAYS} AND i = '' THEN {_PLUS.format("m3", _CUT, "K")} WHEN {_STAYS} AND i = 'a' THEN {_AFTER_U.format(_CUT, "K")} END, CASE WHEN {_STAYS} THEN {_AFTER_U.format(f"1 + {_CUT}", "R")} END) AS m3
            FROM p JOIN x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.k = p.k + 1))),
best AS (SELECT conv_id, arg_max(least(m0, m3), k) AS m FROM p GROUP BY conv_id),
e AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY spot) AS k FROM
    (SELECT conv_id, unnest(string_split(m[9:], '')) AS letter, unnest(range(1, len(m) - 7)) AS spot FROM best WHERE len(m) > 8)),
y AS (SELECT e.conv_id, spot, letter, role, text, i, sum(CASE WHEN letter = 'K' AND i = '' THEN 0 ELSE 1 END) OVER w AS j, first_value(letter = 'K' AND i = 's') OVER w AS led
    FROM e LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.k = e.k AND letter <> 'I' WHERE letter <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY letter = 'K' AND i = '', spot)),
z AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot) AS out FROM y GROUP BY conv_id),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM x) GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(m[1:8] AS BIGINT) AS cost, m[9:] AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM best b LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM b.conv_id
"""

_MOVED = """a{0} AS MATERIALIZED (SELECT rid, p, min(d * 16 + entry) AS best FROM
    (SELECT rid, c.p, entry, sum((q - v) * (q - v)) AS d FROM c JOIN e{0} USING (p, j) GROUP BY ALL) GROUP BY ALL),
m{0} AS (SELECT a.p, CAST(best % 16 AS BIGINT) AS entry, j, sum(q) AS s, count(*) AS n FROM a{0} a JOIN c USING (rid, p) GROUP BY ALL),
e{1} AS MATERIALIZED (SELECT e.p, e.entry, e.j, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM e{0} e LEFT JOIN m{0} m ON e.p = m.p AND e.entry = m.entry AND e.j = m.j)"""
OP13_SQL = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT (max(len(v)) + 7) // 8 AS w FROM k),
c AS MATERIALIZED (SELECT rid, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor(coalesce(CAST(v[i] AS DOUBLE), 0) * 4096) AS HUGEINT) AS q
    FROM (SELECT rid, v, w, unnest(range(1, 8 * w + 1)) AS i FROM k, size)),
e0 AS (SELECT p, CAST(rid - 1 AS BIGINT) AS entry, j, q AS v FROM c WHERE rid <= 16),
{", ".join(_MOVED.format(i, i + 1) for i in range(6))},
f AS (SELECT rid, p, min(d * 16 + entry) AS best FROM (SELECT rid, c.p, entry, sum((q - v) * (q - v)) AS d FROM c JOIN e6 USING (p, j) GROUP BY ALL) GROUP BY ALL),
r AS (SELECT rid, string_agg(lpad(lower(hex(CAST(best % 16 AS BIGINT))), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM f GROUP BY rid),
b AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, entry, j)) AS codebooks_sha256 FROM e6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (rid), b
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_bpe, op3_pii, op4_toxicity, op5_hilbert_shards, op6_quality, op7_simhash, op8_multiprobe, op9_fuzzy_lines, op10_url_filter, op11_conversation_repair, op12_secret_field, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op10_url_filter": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_vector_codes": OP13_SQL}
