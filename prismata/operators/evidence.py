"""Checking cited evidence against file lines and given ranges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, lines, squeezed, without_line_number

MIN_SNIPPET = 12
MATCH_PERCENT = 50


def normal_path(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"))


def escapes(path: Column) -> Column:
    """Does a relative path leave its root? Each .. must have a segment before it."""
    parts = F.filter(F.split(normal_path(path), "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")))
    return normal_path(path).startswith("/") | (depth["low"] < 0)


def snippet_matches(snippet: Column, disk: Column) -> Column:
    """Do enough of the quoted lines stand on disk? Null if nothing can be compared."""
    normal = lambda c: F.filter(F.transform(lines(F.coalesce(c, F.lit(""))), squeezed), lambda x: x != "")
    long_enough = lambda a: F.filter(a, lambda x: F.length(x) >= MIN_SNIPPET)
    quoted = long_enough(F.transform(long_enough(normal(snippet)), without_line_number))
    there = normal(disk)
    matched = F.size(F.filter(quoted, lambda q: F.exists(there, lambda d: d.contains(q))))
    return F.when(F.size(quoted) > 0, matched * 100 >= F.size(quoted) * MATCH_PERCENT)


def verified(evidence: DataFrame, files: DataFrame, snippet: bool = False) -> DataFrame:
    """Evidence with failure: OK or why it fails. files: path, loc and, with snippets, content."""
    f = files.select(F.col("path").alias("_path"), F.col("loc").alias("_loc"), *([F.col("content").alias("_content")] if snippet else []))
    own = evidence.join(f, normal_path(F.col("file")) == F.col("_path"), "left")
    bad_lines = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("_loc"))
    failure = F.when(F.trim(F.coalesce("file", F.lit(""))) == "", "FILE_NOT_FOUND").when(escapes(F.col("file")), "PATH_ESCAPES_REPO").when(F.col("_path").isNull(), "FILE_NOT_FOUND").when(bad_lines, "LINE_OUT_OF_RANGE")
    if snippet:
        from ..functions.text import line_slice

        disk = line_slice(lines(F.col("_content")), F.col("start_line"), F.col("end_line"))
        own = own.withColumn("snippet_matches", F.when(failure.isNull(), snippet_matches(F.col("snippet"), F.coalesce(disk, F.lit("")))))
        failure = failure.when(F.col("snippet_matches") == F.lit(False), "CONTENT_MISMATCH")
    return own.withColumn("failure", failure.otherwise("OK")).drop("_path", "_loc", "_content")


def failures(checked: DataFrame) -> DataFrame:
    return checked.groupBy("failure").agg(F.count("*").alias("n"))


def repaired(checked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Failed citations moved to what was given: same file, or a path that ends alike.

    Chunks: question_id, file_path, start_line, end_line, rank. `action` is KEPT,
    RANGE_FIXED, PATH_FIXED or DROPPED.
    """
    c = chunks.select(F.col("question_id").alias("q"), normal_path(F.col("file_path")).alias("cp"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"), F.col("rank").alias("cr"))
    own = checked.withColumn("np", normal_path(F.col("file")))
    near = F.when(F.col("failure") == "LINE_OUT_OF_RANGE", F.col("cp") == F.col("np")).when(F.col("failure") == "FILE_NOT_FOUND", F.col("cp").endswith(F.col("np")) | F.col("np").endswith(F.col("cp"))).otherwise(F.lit(False))
    # what is cited in one question fails and is mended alike, however often it is cited
    by = ["question_id", "np", "failure"]
    asked = own.where(F.col("failure").isin("LINE_OUT_OF_RANGE", "FILE_NOT_FOUND")).select(*by).distinct()
    first = asked.join(c, (F.col("question_id") == F.col("q")) & near).groupBy(*by).agg(F.min_by(F.struct("cp", "cs", "ce"), "cr").alias("m"))
    out = own.join(first, by, "left")
    ok, fixed = F.col("failure") == "OK", F.col("m").isNotNull()
    action = F.when(ok, "KEPT").when(fixed & (F.col("failure") == "LINE_OUT_OF_RANGE"), "RANGE_FIXED").when(fixed, "PATH_FIXED").otherwise("DROPPED")
    pick = lambda a, b: F.when(ok | ~fixed, F.col(a)).otherwise(F.col(f"m.{b}"))
    return out.select("id", "question_id", pick("file", "cp").alias("file"), pick("start_line", "cs").alias("start_line"), pick("end_line", "ce").alias("end_line"), action.alias("action"))


def covered(evidence: DataFrame, ranges: DataFrame) -> DataFrame:
    """Evidence inside one given range (columns g_file, g_start, g_end) of its file."""
    inside = (F.col("file") == F.col("g_file")) & (F.col("g_start") <= F.col("start_line")) & (F.col("g_end") >= F.col("end_line"))
    return evidence.join(ranges, inside, "left_semi")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Given ranges of each file that overlap or touch, as one; fewer rows to search.

    Only maximal ranges matter for containment, so dominated ones go first.
    """
    order = Window.partitionBy("g_file").orderBy("g_start", F.desc("g_end"))
    ahead = F.max("g_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("a", ahead).where(F.col("a").isNull() | (F.col("a") < F.col("g_end"))).drop("a")


def parsed_key(key: Column) -> tuple[Column, Column]:
    """file and line of a key written file:line."""
    return F.regexp_extract(key, r"^(.+):(\d+)$", 1), F.regexp_extract(key, r"^(.+):(\d+)$", 2).try_cast("long")


def spans(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, key, hit_id): truth keys file:line that lie inside a hit of their question."""
    file, line = parsed_key(F.col("key"))
    k = keys.select("question_id", "key", file.alias("kf"), line.alias("kl"))
    h = hits.select(F.col("question_id").alias("hq"), F.col("id").alias("hit_id"), "file_path", "start_line", "end_line")
    return k.join(h, (F.col("question_id") == F.col("hq")) & (F.col("kf") == F.col("file_path")) & F.col("kl").between(F.col("start_line"), F.col("end_line"))).select("question_id", "key", "hit_id")


def review_ranges(target: DataFrame, members: DataFrame, sites: DataFrame, cap: int = 250) -> DataFrame:
    """Ranges a review may cite: the class source (its first `cap` lines), members, call lines."""
    own = target.select(F.col("path").alias("g_file"), F.col("start_line").alias("g_start"), F.least("end_line", F.col("start_line") + cap - 1).alias("g_end"))
    kids = members.select(F.col("path").alias("g_file"), F.col("start_line").alias("g_start"), F.col("end_line").alias("g_end"))
    at = sites.select(F.col("path").alias("g_file"), F.col("call_line").alias("g_start"), F.col("call_line").alias("g_end"))
    return own.unionByName(kids).unionByName(at)


def support(verdict: Column) -> Column:
    """A model's verdict; anything unexpected is no pass."""
    v = F.lower(F.trim(verdict))
    return F.when(v == "supported", "SUPPORTED").when(v == "unsupported", "UNSUPPORTED").when(v == "unknown", "UNKNOWN").otherwise("UNAVAILABLE")


#: Evidences, lines and characters that a support check may be shown.
MOST_EVIDENCES, MOST_LINES, MOST_CHARS = 6, 40, 1500
UNREADABLE = "(no code can be read here)"


def material(cited: DataFrame, files: DataFrame) -> DataFrame:
    """(claim_id, place, location, why, code, more): the code of a claim's first evidences, from the files themselves.

    cited: claim_id, place (its order), file, start_line, end_line, why; files: path, content.
    A place's code is its numbered lines, MOST_LINES at most, till they have MOST_CHARS
    characters; only files that are cited move, and places cited alike are cut out once, so a
    file's text does not go with every citation. `more` evidences of the claim are left out.
    """
    order = Window.partitionBy("claim_id").orderBy("place")
    own = cited.withColumns({"r": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy("claim_id"))}).where(F.col("r") <= MOST_EVIDENCES)
    first = F.greatest(F.lit(1), F.col("start_line")).cast("int")
    last = F.least(F.col("end_line").cast("int"), first + MOST_LINES - 1)
    clean = F.replace("file", F.lit("\\"), F.lit("/"))
    own = own.select("claim_id", "place", clean.alias("path"), first.alias("a"), last.alias("b"), "start_line", "end_line", "why", (F.col("total") - F.least(F.col("total"), F.lit(MOST_EVIDENCES))).alias("more"))
    text = files.join(own.select("path").distinct(), "path", "left_semi").select("path", lines(F.col("content")).alias("_lines"))
    met = own.select("path", "a", "b").distinct().join(text, "path")
    shown = F.transform(F.slice("_lines", F.col("a"), F.greatest(F.lit(0), F.col("b") - F.col("a") + 1)), lambda x, i: F.concat((F.col("a") + i).cast("string"), F.lit(": "), x, F.lit("\n")))
    grown = F.aggregate(shown, F.lit(""), lambda t, x: F.when(F.length(t) < MOST_CHARS, F.concat(t, x)).otherwise(t))
    code = F.when(F.coalesce(F.length(grown), F.lit(0)) > 0, grown).otherwise(UNREADABLE)
    told = met.select("path", "a", "b", code.alias("code"))
    met = own.join(told, ["path", "a", "b"], "left").withColumn("code", F.coalesce("code", F.lit(UNREADABLE)))
    return met.select("claim_id", "place", F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("location"), "why", "code", "more")


def prompts(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, prompt) of claims (id, question, answer) that have an answer and evidence; a prompt is bounded by the limits above."""
    why = F.when(F.trim(F.coalesce("why", F.lit(""))) != "", F.concat(F.lit("  cited because: "), F.col("why"))).otherwise("")
    one = F.concat(F.lit("\n["), F.row_number().over(Window.partitionBy("claim_id").orderBy("place")).cast("string"), F.lit("] "), F.col("location"), why, F.lit("\n"), F.col("code"))
    packed = shown.withColumn("one", one).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("place", "one"))).alias("e"), F.max("more").alias("more"))
    rest = F.when(F.col("more") > 0, F.concat(F.lit("\n(and "), F.col("more").cast("string"), F.lit(" more that are not shown)"))).otherwise("")
    said = claims.where(F.trim(F.coalesce("answer", F.lit(""))) != "").join(packed, F.col("id") == F.col("claim_id"))
    body = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\n\nConclusion: "), F.col("answer"), F.lit("\n\nCited code:\n"), F.array_join(F.transform("e", lambda x: x["one"]), ""), rest)
    return said.select("id", body.alias("prompt"))


def judged(claims: DataFrame, cited: DataFrame, files: DataFrame, checker: Callable[[list[str]], list[str]] | None, batch: int = 16) -> DataFrame:
    """(id, status, reason) of every claim: what a model says of its conclusion, given the cited code.

    `checker` takes up to `batch` prompts and gives as many answers, JSON with verdict and
    reason. A claim without an answer or evidence is NOT_CHECKED; no checker, a failing
    call, an answer that is no JSON or another word than agreed are UNAVAILABLE, never a pass.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                out = []
                try:
                    said = checker(part["prompt"].tolist())
                    if len(said) != len(part):
                        raise ValueError(f"{len(said)} answers to {len(part)} prompts")
                except Exception as e:  # noqa: BLE001
                    out = [(None, f"the call failed ({type(e).__name__})")] * len(part)
                else:
                    for text in said:
                        try:
                            found = json.loads(text[text.index("{") : text.rindex("}") + 1])
                            out.append((str(found.get("verdict") or ""), str(found.get("reason") or "").strip() or "(no reason given)"))
                        except Exception:  # noqa: BLE001
                            out.append((None, "the answer is no JSON"))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "verdict": [v for v, _ in out], "reason": [r for _, r in out]})

    own = prompts(claims, material(cited, files))
    if checker is None:
        told = own.select("id", F.lit(None).cast("string").alias("verdict"), F.lit("there is no checker").alias("reason"))
    else:
        told = own.mapInPandas(ask, f"id {claims.schema['id'].dataType.simpleString()}, verdict string, reason string")
    out = claims.select("id", (F.trim(F.coalesce("answer", F.lit(""))) == "").alias("silent")).join(told, "id", "left")
    known = F.lower(F.trim("verdict")).isin("supported", "unsupported", "unknown")
    reason = F.when(F.col("verdict").isNotNull() & ~known, F.concat(F.lit("unknown verdict: "), F.substring("verdict", 1, 80))).otherwise(F.col("reason"))
    status = F.when(F.col("reason").isNull(), "NOT_CHECKED").otherwise(support(F.col("verdict")))
    return out.select("id", status.alias("status"), F.when(F.col("reason").isNotNull(), reason).when(F.col("silent"), "there is no conclusion").otherwise("there is no evidence").alias("reason"))


def prose_check(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, unknown, digits, ok): names in prose that no symbol has, and numbers in it."""
    named = notes.select("id", "text", F.filter(identifiers(F.col("text")), lambda w: F.length(w) > 1).alias("names"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)).alias("digits"))
    words = named.select("id", F.explode("names").alias("name"))
    unknown = words.join(symbols.select("name").distinct(), "name", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("unknown"))
    out = named.join(unknown, "id", "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    return out.select("id", F.array_join("unknown", ",").alias("unknown"), F.array_join("digits", ",").alias("digits"), ((F.size("unknown") == 0) & (F.size("digits") == 0)).alias("ok"))
