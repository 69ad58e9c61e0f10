"""Control-plane operators: budgets, loops, caches, rate limits, tolerant JSON, tool answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, lines

# ---- budgets over the steps of a session


def budgeted(steps: DataFrame, session: str, order: str, rounds: int, duration_ms: int, tokens: int, cost: float, input_price: float, output_price: float) -> DataFrame:
    """Steps with running usage and stopped_by: the first limit that was reached before the step.

    Columns: ms, prompt_tokens, completion_tokens. The first limit sticks; limits are looked
    at in the order rounds, duration, tokens, cost. Prices are per million tokens.
    """
    ahead = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    spent = F.greatest(F.col("prompt_tokens"), F.lit(0)) * F.lit(input_price / 1e6) + F.greatest(F.col("completion_tokens"), F.lit(0)) * F.lit(output_price / 1e6)
    out = steps.withColumns({"used_rounds": F.count("*").over(ahead), "used_ms": so_far("ms"), "used_tokens": so_far(F.greatest("prompt_tokens", F.lit(0)) + F.greatest("completion_tokens", F.lit(0))), "used_cost": so_far(spent)})
    now = F.when(F.col("used_rounds") >= rounds, "ROUNDS").when(F.col("used_ms") >= duration_ms, "DURATION").when(F.col("used_tokens") >= tokens, "TOKENS")
    if input_price or output_price:  # without prices the cost never stops anything
        now = now.when(F.col("used_cost") >= cost, "COST")
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("now", now).withColumn("stopped_by", F.first("now", ignorenulls=True).over(upto)).drop("now")


def no_progress(steps: DataFrame, session: str, order: str, key: str, repeats: int = 3) -> DataFrame:
    """Steps with repeat (the key was seen) and halted: `repeats` repeats in a row came by then."""
    by = Window.partitionBy(session).orderBy(order)
    seen = F.row_number().over(Window.partitionBy(session, key).orderBy(order)) > 1
    own = steps.withColumn("repeat", seen)
    island = F.sum(F.when(F.col("repeat"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("_island", island)
    run = F.sum(F.col("repeat").cast("int")).over(Window.partitionBy(session, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("_run", run)
    return own.withColumn("halted", F.max(F.col("_run") >= repeats).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_island", "_run")


def compacted(results: DataFrame, session: str, order: str | list[str], keep: int = 2, width: int = 120) -> DataFrame:
    """Tool results, all but the last `keep` of a session cut to one line of `width`."""
    by = [order] if isinstance(order, str) else order
    late = F.row_number().over(Window.partitionBy(session).orderBy(*[F.desc(x) for x in by]))
    one_line = clip(F.trim(F.regexp_replace("text", r"\s+", " ")), width)
    return results.withColumn("r", late).withColumn("text", F.when(F.col("r") <= keep, F.col("text")).otherwise(one_line)).drop("r")


def allowed(requests: DataFrame, client: str, at: str, capacity: float, per_second: float, *then: str) -> DataFrame:
    """Token bucket per client over its requests in time order (of equal times, by `then`); `at` is in seconds.

    Level after each request is a running fold, so a client's requests are handled in
    order in one task; clients are spread over tasks.
    """
    schema = requests.schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values([at, *then], kind="stable")
        level, last, out = capacity, None, []
        for t in f[at]:
            level = capacity if last is None else min(capacity, level + (t - last) * per_second)
            last = t
            out.append(level >= 1)
            level -= 1 if level >= 1 else 0
        return f.assign(allowed=out)

    return requests.groupBy(client).applyInPandas(run, f"{', '.join(f'{x.name} {x.dataType.simpleString()}' for x in schema.fields)}, allowed boolean")


# ---- ledger and cache


def ledger_row(answers: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Answers as ledger rows: clipped texts, estimated cost as decimal(12,6)."""
    ell = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(F.col(c))
    cost = (F.col("prompt_tokens") * F.lit(input_price) + F.col("completion_tokens") * F.lit(output_price)) / F.lit(1_000_000)
    clipped = {"question": 512, "route_json": 1024, "refusal_reason": 512}
    return answers.withColumns({**{c: ell(c, n) for c, n in clipped.items() if c in answers.columns}, "cost": cost.cast("decimal(12,6)")})


def cached(answers: DataFrame, key: str, at: str, ttl_minutes: int = 1440) -> DataFrame:
    """Answers with cache_hit: an equal key was answered afresh at most the TTL ago.

    A fresh answer starts a new period, so periods are a fold over each key's answers.
    """
    schema = answers.schema
    span = pd.Timedelta(minutes=ttl_minutes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(at)
        start, out = None, []
        for t in f[at]:
            hit = start is not None and t - start <= span
            start = start if hit else t
            out.append(hit)
        return f.assign(hit=out)

    return answers.groupBy(key).applyInPandas(run, f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in schema.fields)}, hit boolean")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last written: upsert by union and this."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def cached_semantics(summaries: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (repo_id, indexed_at, model) with their notes; unreadable ones are a miss."""
    ok = summaries.where(F.get_json_object("notes", "$.overview").isNotNull())
    return requests.join(ok, ["repo_id", "indexed_at", "model"], "left").withColumn("hit", F.col("notes").isNotNull())


def route_json(route: Column, targets: Column, deep: Column) -> Column:
    return F.to_json(F.struct(route.alias("route"), targets.alias("targets"), deep.alias("deep")))


# ---- what a model said

FENCE = re.compile(r"^```[^\n]*\n(.*)```", re.S)


def json_object(raw: Column) -> Column:
    """The outermost {...} of a reply, out of its fence, with illegal backslashes dropped."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    inner = F.when(text.startswith("```"), F.trim(F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```", 1))).otherwise(text)
    found = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(found, r"\\(?![\"\\/bfnrtu])(?<!\\\\)", "")


def parsed(raw: Column, schema: str) -> Column:
    return F.from_json(json_object(raw), schema)


def cited(evidence: DataFrame) -> DataFrame:
    """Evidence with `file:12-20` taken apart; rows without a valid range go."""
    pattern = r"^(.*?):(\d+)(?:-(\d+))?$"
    first, last = F.regexp_extract("file", pattern, 2), F.regexp_extract("file", pattern, 3)
    a = F.coalesce("start_line", F.when(first != "", first.try_cast("long")))
    b = F.coalesce("end_line", F.when(last != "", last.try_cast("long")), a)
    out = evidence.withColumns({"start_line": a, "end_line": b, "file": F.when(first != "", F.regexp_extract("file", pattern, 1)).otherwise(F.col("file"))})
    return out.where((F.trim("file") != "") & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")))


def summary_evidence(entries: DataFrame, hubs: DataFrame, key_types: DataFrame, most: int = 10) -> DataFrame:
    """Up to three entries, three hubs and one key type a module, each place once."""
    cut = lambda df, tier, n: df.orderBy("place").limit(n).select(F.lit(tier).alias("tier"), "place", "location")
    every = cut(entries, 0, 3).unionByName(cut(hubs, 1, 3)).unionByName(cut(key_types, 2, most))
    return every.groupBy("location").agg(F.min(F.struct("tier", "place")).alias("o")).orderBy("o").limit(most)


def summary_text(name: str, scale: dict, modules: list[str], hubs: list[str]) -> str:
    shown = ", ".join(modules[:8]) + (f" and {len(modules) - 8} more" if len(modules) > 8 else "")
    parts = [f"{name}: {scale['files']} files, {scale['symbols']} symbols.", f"Modules: {shown}." if modules else "", f"Most called: {', '.join(hubs)}." if hubs else ""]
    return " ".join(p for p in parts if p)


def component_status(checks: dict[str, Callable[[], str]]) -> list[tuple[str, bool, str]]:
    """One row a component: name, ok, detail; a failing check is a row, not an error."""
    out = []
    for name, check in checks.items():
        try:
            out.append((name, True, check()))
        except Exception as e:  # noqa: BLE001
            out.append((name, False, f"{type(e).__name__}: {e}"))
    return out


class Tools:
    """Named table functions with tolerant names; a failing or unknown one is a miss."""

    def __init__(self):
        self.known: dict[str, Callable[..., DataFrame]] = {}

    @staticmethod
    def canonical(name: str) -> str:
        return re.sub(r"[\s_-]", "", (name or "").lower())

    def add(self, name: str, f: Callable[..., DataFrame]) -> None:
        self.known[self.canonical(name)] = f

    def call(self, name: str, args: dict | str | None = None) -> tuple[DataFrame | None, str]:
        f = self.known.get(self.canonical(name))
        if f is None:
            return None, f"no tool {name}; there are {', '.join(sorted(self.known))}"
        try:
            return f(**(json.loads(args) if isinstance(args, str) else args or {})), ""
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"


def repository_tools(symbols: DataFrame, files: DataFrame, calls: DataFrame, relations: DataFrame, chunks: DataFrame) -> Tools:
    """The six built-in tools over one index."""
    from . import lookup, ranking, retrieval

    spark = symbols.sparkSession

    def ids(name: str) -> list[int]:
        found = ranking.resolved_refs(spark.createDataFrame([(0, name)], "id long, ref string"), symbols).first()
        if found is None or found["ambiguous"]:
            raise lookup.NotFound(f"{name}: {'ambiguous' if found else 'unknown'}")
        return [int(x) for x in found["symbol_ids"].split(",")]

    tools = Tools()
    tools.add("findDefinition", lambda name: lookup.with_file(symbols.where(F.col("id").isin(*ids(name))), files))
    tools.add("findCallers", lambda name: lookup.callers(symbols, files, calls, F.col("callee_symbol_id").isin(*ids(name)), 200))
    tools.add("findCallees", lambda name: lookup.callees(symbols, files, calls, F.col("caller_symbol_id").isin(*ids(name)), 200))
    tools.add("findImplementations", lambda name: lookup.implementations(symbols, files, relations, F.col("super_symbol_id").isin(*ids(name))))
    tools.add("readSymbol", lambda name: numbered_source(chunks.where(F.col("symbol_id").isin(*ids(name)[:3]))))
    tools.add("textSearch", lambda query: snippets(retrieval.search(chunks, query, 5), chunks))
    return tools


def snippets(hits: DataFrame, chunks: DataFrame, most_chars: int = 1600, most_lines: int = 40) -> DataFrame:
    """Hits with their places, of `most_lines` lines at most, and the beginnings of their texts."""
    own = hits.join(chunks.select("id", "start_line", "end_line", "content"), "id")
    last = F.least("end_line", F.col("start_line") + most_lines - 1)
    return own.select("id", "file_path", "start_line", last.alias("end_line"), F.substring("content", 1, most_chars).alias("content"), "score").orderBy(F.desc("score"), "id")


def numbered_source(chunks: DataFrame, most: int = 160) -> DataFrame:
    """Chunk texts with `line: ` before each line, `most` lines each."""
    own = F.slice(lines(F.col("content")), 1, most)
    text = F.array_join(F.transform(own, lambda x, i: F.concat((F.col("start_line") + i).cast("string"), F.lit(": "), x)), "\n")
    return chunks.select("id", text.alias("text"))
