"""Aggregations for the repository summary, the usage ledger and the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_trivial, module_name, package_of, percent, ratio
from .lookup import with_file
from .checkpoints import checkpointed

NO_TYPE = "(没有顶层类型)"
#: Parts of package names that hold domain types; mapping annotations.
DOMAIN_HINTS = (".entity.", ".domain.", ".model.", ".po.", ".dto.", ".vo.")
MAPPING = r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?\"([^\"]+)\""


def vitals(symbols: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return symbols.agg(F.count_if(kind.isin("CLASS", "ENUM", "RECORD")).alias("classes"), F.count_if(kind == "INTERFACE").alias("interfaces"), F.count_if(kind == "METHOD").alias("methods"), F.count("*").alias("total"))


def entry_points(symbols: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    mains = symbols.where((F.col("kind") == "METHOD") & (F.col("name") == "main") & F.col("modifiers").contains("static")).select(F.col("parent_id").alias("id"))
    return with_file(symbols.join(mains, "id", "left_semi"), files).select("id", "qualified_name", "path").orderBy("path", "id").limit(limit)


def _top(symbols: DataFrame, files: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    return with_file(symbols.join(counts, "id"), files).select("id", "qualified_name", "path", "n").orderBy(F.desc("n"), "qualified_name", "id").limit(limit)


def call_hubs(symbols: DataFrame, files: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    """Types by resolved calls of themselves or their members; calls are counted by callee first."""
    per = calls.where("resolved = 1").groupBy(F.col("callee_symbol_id").alias("callee")).agg(F.count("*").alias("c"))
    owner = symbols.select(F.col("id").alias("callee"), F.coalesce("parent_id", "id").alias("id"))
    return _top(symbols, files, per.join(owner, "callee").groupBy("id").agg(F.sum("c").alias("n")), limit)


def top_methods(symbols: DataFrame, files: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    per = calls.where("resolved = 1").groupBy(F.col("callee_symbol_id").alias("id")).agg(F.count("*").alias("n"))
    return _top(symbols.where((F.col("kind") == "METHOD") & ~is_trivial(F.col("name"))), files, per, limit)


def implementation_ranking(symbols: DataFrame, files: DataFrame, relations: DataFrame, limit: int = 10) -> DataFrame:
    per = relations.where("kind = 'IMPLEMENTS' and resolved = 1").groupBy(F.col("super_symbol_id").alias("id")).agg(F.count("*").alias("n"))
    return _top(symbols, files, per, limit)


def uncalled_classes(symbols: DataFrame, files: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    """Classes none of whose methods, but for main, is called."""
    methods = symbols.where("kind = 'METHOD' and name <> 'main' and parent_id is not null").select("id", "parent_id")
    called = methods.join(calls.where("resolved = 1").select(F.col("callee_symbol_id").alias("id")), "id", "left_semi").select(F.col("parent_id").alias("id"))
    own = symbols.where(F.col("kind").isin("CLASS", "ENUM", "RECORD")).join(called, "id", "left_anti")
    return with_file(own, files).select("id", "qualified_name", "path").orderBy("path", "id").limit(limit)


def key_types(symbols: DataFrame, files: DataFrame, pattern: str | None, limit: int = 6) -> DataFrame:
    members = symbols.where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("m"))
    own = symbols.where(F.col("parent_id").isNull() & (F.lit(False) if not pattern else F.col("qualified_name").rlike(pattern)))
    return with_file(own.join(members, "id", "left"), files).select("id", "qualified_name", "path", F.coalesce("m", F.lit(0)).alias("members")).orderBy(F.desc("members"), "qualified_name").limit(limit)


def exact_names(symbols: DataFrame, names: list[str]) -> DataFrame:
    return symbols.where(F.col("name").isin(*names)).select("name").distinct()


def file_scales(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each top-level type of a JAVA file (one without a type for a file that has none): lines and number of symbols of the file."""
    per = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("symbols"))
    tops = symbols.where("parent_id is null").select(F.col("file_id").alias("id"), F.col("qualified_name").alias("type_name"))
    return files.where("kind = 'JAVA'").join(per, "id", "left").join(tops, "id", "left").select("path", "loc", "type_name", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def reasons(calls: DataFrame) -> DataFrame:
    return calls.where("resolved = 0").groupBy(F.coalesce("reason", F.lit("UNKNOWN")).alias("reason")).agg(F.count("*").alias("n")).orderBy("reason")


def relation_reasons(relations: DataFrame) -> DataFrame:
    return relations.groupBy(F.when(F.col("external") == 1, "EXTERNAL").otherwise("RESOLVED").alias("status")).agg(F.count("*").alias("n"))


def _user(log: DataFrame, repo_id: int | None) -> DataFrame:
    own = log.where("source = 'USER'")
    return own if repo_id is None else own.where(F.col("repo_id") == repo_id)


def usage(log: DataFrame, repo_id: int | None = None) -> DataFrame:
    """Totals of the answers to users, with what cached answers saved kept apart."""
    fresh, cached = F.col("cache_hit") == 0, F.col("cache_hit") == 1
    support = F.col("support_prompt_tokens") + F.col("support_completion_tokens")
    total = lambda c, on: F.coalesce(F.sum(F.when(on, c).otherwise(0)), F.lit(0))
    every = F.lit(True)
    out = _user(log, repo_id).agg(
        F.count("*").alias("questions"),
        total(F.col("refused"), every).alias("refusals"),
        total(F.col("cache_hit"), every).alias("cache_hits"),
        total(F.col("prompt_tokens"), fresh).alias("prompt_tokens"),
        total(F.col("completion_tokens"), fresh).alias("completion_tokens"),
        total(support, fresh).alias("support_tokens"),
        total(F.col("cost"), fresh).cast("double").alias("cost"),
        total(F.col("prompt_tokens") + F.col("completion_tokens") + support, cached).alias("saved_tokens"),
        total(F.col("cost"), cached).cast("double").alias("saved_cost"),
        F.coalesce(F.round(F.avg("latency_ms")), F.lit(0)).cast("long").alias("avg_latency"),
        F.coalesce(F.max("latency_ms"), F.lit(0)).alias("max_latency"),
        total(F.col("evidence_verified"), every).alias("verified"),
        total(F.col("evidence_rejected"), every).alias("rejected"),
    )
    return out.withColumns({"refusal_rate": ratio(F.col("refusals"), F.col("questions")), "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens") + F.col("support_tokens")})


def usage_by_mode(log: DataFrame, repo_id: int | None = None) -> DataFrame:
    return _user(log, repo_id).groupBy("mode").agg(F.count("*").alias("n"), F.sum("refused").alias("refusals"), F.round(F.avg("latency_ms")).cast("long").alias("avg_latency")).orderBy(F.desc("n"), "mode")


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


# ---- modules


def package_prefix(packages: list[str]) -> str:
    """The longest common run of leading segments."""
    if not packages:
        return ""
    low, high = min(p.split(".") for p in packages), max(p.split(".") for p in packages)
    same = 0
    while same < min(len(low), len(high)) and low[same] == high[same]:
        same += 1
    return ".".join(low[:same])


def common_prefix(types: DataFrame, column: str = "package") -> DataFrame:
    """package_prefix as one aggregate: of the least and the greatest segment list."""
    ends = types.where(F.col(column).isNotNull()).agg(F.min(F.split(column, r"\.")).alias("a"), F.max(F.split(column, r"\.")).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice("a", F.lit(1), k) == F.slice("b", F.lit(1), k))
    longest = F.coalesce(F.array_max(same), F.lit(0))
    return ends.select(F.coalesce(F.array_join(F.slice("a", F.lit(1), longest), "."), F.lit("")).alias("prefix"))


def _module(package: str, prefix: str) -> str:
    if not prefix:
        return package.split(".")[0] or package
    if package == prefix:
        return "(root)"
    return package[len(prefix) + 1 :].split(".")[0] if package.startswith(prefix + ".") else "(other) " + package


def choose_prefix(packages: list[str], least: int = 3) -> str:
    """The common prefix, lengthened by its most frequent next segment till there are `least` modules.

    Works on the distinct packages, a short list; ties go to the alphabetically first.
    """
    prefix = package_prefix(packages)
    while len({_module(p, prefix) for p in packages}) < least:
        inside = [p[len(prefix) + 1 :] if prefix else p for p in packages if not prefix or p.startswith(prefix + ".")]
        nexts = [r.split(".")[0] for r in inside if "." in r]
        if not nexts:
            break
        best = min(set(nexts), key=lambda s: (-nexts.count(s), s))
        prefix = f"{prefix}.{best}" if prefix else best
    return prefix


def chosen_prefix(packages: DataFrame, column: str = "package", least: int = 3) -> DataFrame:
    """choose_prefix over a table of packages: its trie is counted by level, and one way down it is followed.

    A node of the trie knows the packages below it, their next segments and the most
    frequent one that goes deeper; a step looks up one row. No list of packages is collected.
    """
    own = packages.where(F.col(column).isNotNull()).select(F.col(column).alias("package")).distinct()
    seg = F.split("package", r"\.")
    k = F.col("k")
    level = own.select("package", seg.alias("seg")).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("seg"))))
    level = level.select(F.array_join(F.slice("seg", F.lit(1), k), ".").alias("prefix"), F.get("seg", k).alias("next"), (k + 1 < F.size("seg")).alias("deeper"))
    steps = level.groupBy("prefix", "next").agg(F.count("*").alias("n"), F.count_if("deeper").alias("deep"))
    ranked = F.min(F.when(F.col("next").isNotNull() & (F.col("deep") > 0), F.struct((-F.col("deep")).alias("n"), F.col("next").alias("next"))))
    inside, whole = F.col("next").isNotNull(), F.col("next").isNull()
    node = steps.groupBy("prefix").agg(F.count_if(inside).alias("nexts"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("below"), F.max(whole.cast("int")).alias("self"), ranked.getField("next").alias("best"))
    node = checkpointed(node)
    total = own.count()
    prefix = common_prefix(own).first()["prefix"]
    while row := node.where(F.col("prefix") == prefix).first():
        groups = row["nexts"] if not prefix else row["nexts"] + total - row["below"]
        if groups >= least or row["best"] is None:
            break
        prefix = f"{prefix}.{row['best']}" if prefix else row["best"]
    return packages.sparkSession.createDataFrame([(prefix,)], "prefix string")


def key_type_pattern(package: str | None, prefix: str) -> str | None:
    if package is None or package.startswith("(其他包)"):
        return None
    return "^" + package.replace(".", "[.]") + ("[.][A-Za-z0-9_$]+$" if package == prefix else "[.].+$")


def modules(scales: DataFrame, prefix: str | None = None, limit: int = 40, samples: int = 5) -> DataFrame:
    """File scales summed by module, the largest first, with a few sample paths.

    A file belongs to the package of one of its types, the last by name, and counts once a type.
    """
    of_file = F.max("type_name").over(Window.partitionBy("path"))
    own = scales.withColumn("package", package_of(of_file))
    if prefix is None:
        prefix = choose_prefix(sorted(r["package"] for r in own.where("package is not null").select("package").distinct().collect()))
    named = own.withColumn("module", F.when(F.col("package").isNull(), NO_TYPE).otherwise(module_name(F.col("package"), prefix)))
    grouped = named.groupBy("module").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("symbols").alias("symbols"))
    first = named.select("module", "path").distinct().withColumn("r", F.row_number().over(Window.partitionBy("module").orderBy("path"))).where(F.col("r") <= samples)
    paths = first.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("sample_paths"))
    return grouped.join(paths, "module").orderBy(F.desc("symbols"), "module").limit(limit)


def domain_types(types: DataFrame, prefix: str, limit: int = 30) -> DataFrame:
    """Types in domain packages; without any, the types right in the root package."""
    name = F.col("qualified_name")
    hinted = F.lit(False)
    for h in DOMAIN_HINTS:
        hinted = hinted | name.contains(h)
    direct = name.startswith(prefix + ".") & ~F.substring(name, len(prefix) + 2, 1 << 20).contains(".") if prefix else F.lit(False)
    ranked = types.withColumn("tier", F.when(hinted, 0).when(direct, 1)).where("tier is not null")
    best = ranked.agg(F.min("tier").alias("tier"))
    return ranked.join(F.broadcast(best), "tier").groupBy("name").agg(F.min("qualified_name").alias("first")).orderBy("first").limit(limit)


def controllers(types: DataFrame, limit: int = 20) -> DataFrame:
    return types.where(F.col("name").endswith("Controller") | F.col("qualified_name").contains(".controller.")).orderBy("qualified_name").limit(limit)


def mapped_paths(sources: DataFrame, text: str = "content", limit: int = 30) -> DataFrame:
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(MAPPING), 1))
    return sources.select(found.alias("path")).distinct().orderBy("path").limit(limit)


def structure(symbols: DataFrame, files: DataFrame, calls: DataFrame, relations: DataFrame, limit: int = 10) -> DataFrame:
    """The rankings of a summary as rows (section, place, name, n)."""
    parts = {
        "hubs": call_hubs(symbols, files, calls, limit),
        "methods": top_methods(symbols, files, calls, limit),
        "implementations": implementation_ranking(symbols, files, relations, limit),
        "entries": entry_points(symbols, files, limit).withColumn("n", F.lit(0).cast("long")),
        "uncalled": uncalled_classes(symbols, files, calls, limit).withColumn("n", F.lit(0).cast("long")),
    }
    out = None
    for section, df in parts.items():
        order = ["path", "id"] if section in ("entries", "uncalled") else [F.desc("n"), "qualified_name", "id"]
        own = df.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.col("qualified_name").alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


# ---- jobs


def reconciled(jobs: DataFrame, durable: bool) -> DataFrame:
    """Statuses after a restart: unfinished jobs fail, or go back to the durable queue."""
    s = F.col("status")
    new = F.when(s == "RUNNING", "QUEUED").otherwise(s) if durable else F.when(s.isin("QUEUED", "RUNNING"), "FAILED").otherwise(s)
    return jobs.withColumn("status", new)


def stale(jobs: DataFrame, now: Column, minutes: int) -> DataFrame:
    return jobs.where((F.col("status") == "QUEUED") & (F.col("updated_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each repository."""
    return jobs.groupBy("repo_id").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"), F.max_by(percent(F.col("done"), F.col("total")), "id").alias("percent"))
