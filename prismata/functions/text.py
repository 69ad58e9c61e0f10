"""Scalar functions over columns; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION")
CALLABLE_KINDS = ("METHOD", "CONSTRUCTOR")

#: Method names that say little about a code base.
TRIVIAL_NAMES = ("toString", "equals", "hashCode", "main", "close", "flush", "run", "apply", "accept", "compareTo")
TRIVIAL_PREFIXES = ("get", "set", "is")

#: Words of a question that are no symbol names.
STOP_WORDS = tuple(
    "the and for what which where who why how call calls called caller callers method methods class classes implementation implementations defined definition a an is to of in on it by or do as at be we no so if me my up us".split()
)

#: Question patterns by route, tried in this order.
ROUTES = (
    ("CALLERS", "谁调用|被谁调用|哪些地方调用|调用点|调用者|who calls|callers? of"),
    ("CALLEES", "调用了谁|调用了哪些|依赖了哪些|会调用什么|what does .* call"),
    ("IMPLEMENTATIONS", "有哪些实现|实现类|谁实现了|有几个实现|implementations?|implemented by"),
    ("STRUCTURE", "有哪些方法|哪些方法|有哪些字段|有哪些成员|有哪些属性|方法列表|字段列表|what methods|which methods|what fields|members of"),
    ("LOCATE", "在哪定义|定义在哪|在哪个类|在哪实现|在哪里实现|的位置|定义在|where is .* defined"),
)
#: Patterns of questions about call chains, and about the repository as a whole.
CHAIN = (
    "间接|直接或间接", "调用链|链路上|上游|向下游|下游", "最终.{0,4}调用|一路|追溯到|追到哪", "从哪来|从哪来|哪里来的|谁传进来|参数.{0,6}(来源|由谁)",
    "影响面|会影响哪|改.{0,8}影响", "完整.{0,4}(链路|路径|流程)|整条链", "(?i)transitive|call\\s*chain|upstream|downstream|who\\s+ends?\\s+up",
)
SUMMARY = (
    "(项目|仓库|代码库|工程|系统|整体).{0,8}(是做什么|做什么的|干什么|干嘛|有哪些功能|有什么功能|用途|是什么东西)",
    "(介绍|概述|概括|概览|说说|讲讲|总结).{0,6}(这个)?(项目|仓库|代码库|工程|系统)",
    "(项目|仓库|代码库|工程).{0,6}(介绍|概述|概览|全貌|架构|模块划分|有哪些模块)",
    "(整体|总体|大致).{0,4}(架构|结构|设计|情况|作用)",
    "有哪些模块|模块.{0,4}(划分|怎么分|如何分|有哪些)|分了哪些模块",
    "(?i)(what|whats|what's)\\s+(does|do|is)\\s+(this|the)\\s+.{0,12}(project|repo|repository|codebase)",
    "(?i)(overview|summary|summarize|introduce)\\s+(of\\s+)?(this|the)?\\s*(project|repo|repository|codebase)",
)


def is_type(kind: Column) -> Column:
    return kind.isin(*TYPE_KINDS)


def is_callable(kind: Column) -> Column:
    return kind.isin(*CALLABLE_KINDS)


def is_trivial(name: Column) -> Column:
    out = name.isin(*TRIVIAL_NAMES)
    for p in TRIVIAL_PREFIXES:
        out = out | name.startswith(p)
    return out


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, zero where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def token_estimate(text: Column, per_token: int = 4) -> Column:
    """At least one; code counts four characters a token, plain text three."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / per_token)).cast("long")


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def clip_javadoc(text: Column, limit: int = 500) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def lines(text: Column) -> Column:
    """Lines without a closing empty one, whatever the line ends."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def line_slice(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included) joined; null where nothing is left."""
    first = F.greatest(F.lit(1), start).cast("int")
    last = F.least(F.size(all_lines), end).cast("int")
    return F.when(last >= first, F.array_join(F.slice(all_lines, first, last - first + 1), "\n"))


def simple_name(qualified: Column) -> Column:
    """Between # and /, or else after the last dot."""
    member = F.regexp_extract(qualified, "#([^/]*)", 1)
    return F.when(qualified.contains("#"), member).otherwise(F.substring_index(qualified, ".", -1))


def method_key(type_key: Column, name: Column, arity: Column) -> Column:
    return F.concat(type_key, F.lit("#"), name, F.lit("/"), arity.cast("string"))


def type_key(outer: Column, name: Column) -> Column:
    return F.concat_ws(".", outer, name)


def package_of(qualified: Column) -> Column:
    """What stands before the last dot; empty if there is none."""
    return F.when(qualified.contains("."), F.regexp_replace(qualified, r"\.[^.]*$", "")).when(qualified.isNotNull(), F.lit(""))


def module_name(package: Column, prefix: str) -> Column:
    head = lambda c: F.when(F.instr(c, ".") > 1, F.substring_index(c, ".", 1)).otherwise(c)
    if not prefix:
        return head(package)
    rest = F.substring(package, len(prefix) + 2, 1 << 20)
    return F.when(package == prefix, "(根包)").when(package.startswith(prefix + "."), head(rest)).otherwise(F.concat(F.lit("(其他包) "), package))


def tokens(query: Column, most: int = 8) -> Column:
    """Search words: letter and digit runs of two or more first, then bigrams of Han runs up to `most` in all."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(query, F.lit(r"((?:(?!\p{IsHan})[\p{L}\p{Nd}_$])+)"), 1), lambda w: F.length(w) >= 2))
    runs = F.regexp_extract_all(query, F.lit(r"(\p{IsHan}+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    room = F.greatest(F.lit(0), F.lit(most) - F.size(words))
    return F.concat(words, F.slice(F.array_distinct(pairs), F.lit(1), room))


def relaxed(words: Column) -> Column:
    """Only the words with an ASCII letter, if there are any."""
    named = F.filter(words, lambda w: w.rlike("[A-Za-z]"))
    return F.when(F.size(named) > 0, named).otherwise(words)


def route(question: Column) -> Column:
    out = F.lit("SEMANTIC")
    for name, pattern in reversed(ROUTES):
        out = F.when(question.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return F.coalesce(hit & (F.trim(text) != ""), F.lit(False))


def is_chain(question: Column) -> Column:
    return matches_any(question, CHAIN)


def is_summary(question: Column) -> Column:
    return matches_any(question, SUMMARY)


def identifiers(question: Column) -> Column:
    """Names a question may mean, in order, without stop words."""
    found = F.regexp_extract_all(question, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), 1)
    return F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(*STOP_WORDS)))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_line_number(line: Column) -> Column:
    return F.regexp_replace(line, r"^\d{1,7}\s*[:|]\s*", "")


def visit_key(tool: Column, args: Column) -> Column:
    """One key for all spellings of the same step."""

    def norm(c: Column) -> Column:
        t = F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", ""), "$", ".")
        return F.regexp_replace(t, r"(\(\))+$", "")

    return F.concat(F.translate(norm(tool), "_-", ""), F.lit("("), norm(args), F.lit(")"))


def parameter_count(signature: Column) -> Column:
    """Parameters between the outer parentheses; commas inside <...> do not count."""
    inside = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    for _ in range(4):
        inside = F.regexp_replace(inside, "<[^<>]*>", "")
    return F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ","))).cast("int")


def severity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("high", "medium", "low"), low).otherwise("unknown")


def client_key(forwarded: Column, remote: Column) -> Column:
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.concat(F.lit("ip:"), F.when(first != "", first).otherwise(remote))


def lock_key(path: Column, prefix: str = "lock:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(path, 256), 1, 16))


def cache_key(repo: Column, indexed_at: Column, engine: Column, model: Column, mode: Column, question: Column, prefix: str = "answer") -> Column:
    return F.concat_ws(":", F.lit(prefix), repo.cast("string"), indexed_at, F.sha2(F.concat_ws("\n", engine, model, mode, question), 256))


def archive_name(name: Column) -> Column:
    base = F.regexp_replace(F.substring_index(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/", -1), r"(?i)\.zip$", "")
    clean = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]", "-"), "^-+|-+$", "")
    return F.when(F.trim(clean) == "", "uploaded-repo").otherwise(clean)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(F.lit(0)).cast("int")
