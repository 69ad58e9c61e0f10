"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans come from four strict patterns and always stay. Looser patterns propose further
candidates (addresses and numbers written out, bracketed or without a country code). Each
candidate, base ones included, gets a vote (for, against, none) from five labelers: the
strict pattern, the form (lengths, checksums, ranges), a gazetteer (domain endings, calling
codes, issuer digits, reserved networks), the words before it and the words against it.

Counts of equal vote patterns over the whole corpus go to the driver: their number is
bounded by the labelers, not by the data. Expectation-maximisation on them (one latent
class a kind, labelers independent given it) estimates each labeler's reliability and the
posterior of each pattern. A corpus may hold no look-alike at all, which would leave the
class "no" empty; so ANCHORS made-up candidates of each class, planted by a seeded rule
(written-out forms; amounts, dates, part numbers, times, sequences that fail their check),
take part with a known class. A logistic regression over votes, shape and what stands
beside the span, by kind, trained on the counts with the posteriors as labels, is the final
span classifier. Loose candidates that overlap a base span of any kind are none; those it
gives 0.5 or more are added.

A null text is empty and has no spans; whole texts are read. Repeated rows, ties and other
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import renamed, bound_batches, checkpointed, lean

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
STRICT = {
    # a match never starts inside a run of digits, so such starts are skipped
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
AT = r"(?:\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s(?:at|AT)\s|\s?@\s?)"
DOT = r"(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)"
LOOSE = {
    "email": re.compile(rf"{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+"),  # what follows the name
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[(]\.?(?:dot)?[\])]\s?[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/]|\x20-\x20)[0-9]{4}(?:(?:[._/]|\x20-\x20)[0-9]{4})(?:[._/]|\x20-\x20)[0-9]{4}(?![0-9]|\.[0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"),
}
#: Common ends of domain names, first digits of card issuers, calling codes.
ENDINGS = frozenset("com org net edu gov io info biz de fr es it nl eu uk us ca ch at be pl pt se no dk fi jp cn in br mx au".split())
ISSUERS = ("34", "37", "35", "36", "38", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "60", "62", "64", "65")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "81", "82", "86", "90", "91", "351", "353", "358", "420")
#: Words that stand before personal data, and before numbers of other kinds.
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|addr|login|from|client)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:version|ver|v|isbn|issn|doi|order|invoice|section|chapter|page|token|password|hash|id|part|serial|ref|no|total|sum|amount|eur|usd|price|date|lot|build|opens|starts|ends|look|see|fig|item|row|code)\b[\s:=#.\"']*(?:at\s)?$")
REACH = 40
LABELERS = 5
#: Made-up candidates of each class that the estimate is anchored by.
ANCHORS, SEED = 600, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in re.findall("[0-9]+", s))


def _strict(kind: str, found: str) -> bool:
    if kind == "ip":
        return _octets(found)
    n = len(d := _digits(found))
    return 16 <= n <= 19 and luhn(d) if kind == "card" else 8 <= n <= 15


def _named(domain: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Addresses: each match of the domain pattern with the name characters before it."""
    out, last = [], 0
    for m in domain.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped, not retried."""
    out = {"email": _named(DOMAIN, text) if "@" in text else []}
    for kind, pattern in STRICT.items():
        if kind == "phone" and "+" not in text:
            out[kind] = []
            continue
        out[kind] = [m.span() for m in pattern.finditer(text) if _strict(kind, m[0])]
    return out


def _form(kind: str, found: str) -> int:
    """Vote of the form labeler: 1 for, 2 against."""
    d = _digits(found)
    if kind == "email":
        name = re.split(AT, found)[0]
        return 1 if 2 <= len(name) <= 64 and len(found) <= 254 else 2
    if kind == "ip":
        return 1 if _octets(found) else 2
    if kind == "card":
        return 1 if 13 <= len(d) <= 19 and luhn(d) else 2
    return 1 if 8 <= len(d) <= 15 and len(set(d)) > 2 else 2


def _listed(kind: str, found: str, strict: bool) -> int:
    """Vote of the gazetteer: 0 where its lists say nothing; a written-out address needs a known ending."""
    d = _digits(found)
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", found.rstrip("])} "))[-1].lower() in ENDINGS else 0 if strict else 2
    if kind == "ip":
        return 2 if d.startswith("0") or len(d) < 5 else 0
    if kind == "card":
        return 1 if d.startswith(ISSUERS) else 2
    if found.startswith("+") or found.startswith("00"):
        return 1 if d.lstrip("0").startswith(CODES) else 2
    return 0


def candidates(text: str | None) -> Iterator[tuple[int, int, int, bool, tuple[int, ...], int]]:
    """(kind, start, end, base, votes, shape) of every candidate span."""
    if not text:
        return
    base = base_spans(text)
    taken = sorted(x for own in base.values() for x in own)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, np.int64)
    found = [(k, a, b, True) for k, kind in enumerate(KINDS) for a, b in base[kind]]
    loosely: list[tuple[int, int]] = []
    for k, kind in enumerate(KINDS):
        # every loose address holds an @, at or AT
        if kind == "email" and not ("@" in text or "at" in text or "AT" in text):
            continue
        for a, b in _named(LOOSE[kind], text) if kind == "email" else [m.span() for m in LOOSE[kind].finditer(text)]:
            at = bisect.bisect_left(taken, (b, -1))  # base spans that begin before its end
            if (not at or ends[at - 1] <= a) and not any(p < b and a < q for p, q in loosely):
                found.append((k, a, b, False))
        loosely += [(a, b) for j, a, b, strict in found if j == k and not strict]
    for k, a, b, strict in sorted(found):
        kind, value, ahead = KINDS[k], text[a:b], text[max(0, a - REACH) : a]
        votes = (1 if strict else 0, _form(kind, value), _listed(kind, value, strict), 1 if CUES[kind].search(ahead) else 0, 2 if AGAINST.search(ahead) else 0)
        beside = (ahead[-1:] in "" or ahead[-1].isspace()) * 2 + (text[b : b + 1] in "" or not text[b].isalnum())
        shape = (min(3, (b - a) // 8) * 4 + min(3, 4 * len(_digits(value)) // max(1, b - a))) * 4 + beside
        yield k, a, b, strict, votes, shape


def planted(right: bool, n: int, seed: int) -> list[tuple[str, str]]:
    """n made-up texts, each with one written-out span (or one look-alike), and the span."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))
    octet = lambda top: str(r.randrange(1, top))

    def card() -> str:
        body = r.choice(ISSUERS)
        body += d(15 - len(body))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def value() -> tuple[str, str]:
        kind = r.randrange(4)
        if right:
            if kind == 0:
                at, dot = r.choice(((" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "."), (" (at) ", " (dot) "), (" AT ", " DOT "), (" {at} ", ".")))
                return "email", f"{word()}.{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}"
            if kind == 1:
                return "ip", r.choice(("[.]", "(dot)", "[dot]", " [.] ")).join(octet(256) for _ in range(4))
            if kind == 2:
                c = card()
                return "card", r.choice((".", "_", "/", " - ")).join(c[i : i + 4] for i in range(0, 16, 4))
            return "phone", r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{r.choice(CODES[:30])} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"))
        if kind == 0:
            return "email", f"{word()} at {r.choice((f'{d(2)}.{d(2)}', f'{word()}.{d(1)}', f'v{d(1)}.{d(1)}.{d(1)}', f'{word()}.{word()}'))}"
        if kind == 1:
            return "ip", r.choice(("[.]", "(dot)", "[dot]")).join([str(r.randrange(256, 999)), *(octet(999) for _ in range(3))])
        if kind == 2:
            return "card", r.choice((".", "_", "/", " - ")).join(d(4) for _ in range(4))
        return "phone", r.choice((f"{d(2)}.{d(3)}.{d(3)}", f"{d(2)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(3)}"))

    cues = {"email": ("mail", "e-mail:", "contact", "write to", "reach me:"), "ip": ("ip", "host", "server", "login from", "address"), "card": ("card", "visa", "credit card:", "debit"), "phone": ("call", "tel", "phone:", "mobile", "fax", "call me on")}
    against = ("order", "total", "part no", "serial", "version", "page", "ref", "invoice", "amount", "lot", "code", "opens", "see")
    out = []
    for _ in range(n):
        kind, v = value()
        lead = r.choice(cues[kind]) if right and r.random() < 0.85 else r.choice(against) if not right and r.random() < 0.75 else word()
        out.append((f"{word()} {word()} {lead} {v}{r.choice((' ', '. ', ', '))}{word()} {word()}", v))
    return out


def _anchors() -> tuple[list[tuple[int, tuple[int, ...], int]], list[int]]:
    rows, truth = [], []
    for right in (True, False):
        for text, v in planted(right, ANCHORS, SEED + right):
            for k, a, b, strict, votes, shape in candidates(text):
                if not strict:
                    rows.append((k, votes, shape))
                    truth.append(int(right and text[a:b] == v))
    return rows, truth


def reliabilities(patterns: np.ndarray, weights: np.ndarray, known: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: P(vote | class) by labeler, and each pattern's posterior.

    patterns: n x LABELERS of 0, 1, 2; weights: how often each occurs; known: the class of
    anchors, else -1. Classes: 0 no, 1 yes.
    """
    known = np.full(len(patterns), -1) if known is None else known
    theta = np.empty((LABELERS, 2, 3))
    theta[:, 1] = (0.35, 0.6, 0.05)
    theta[:, 0] = (0.35, 0.15, 0.5)
    prior = 0.5
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.zeros((len(patterns), 2))
        for j in range(LABELERS):
            log += np.log(theta[j][:, patterns[:, j]]).T
        log += np.log([1 - prior, prior])
        post = np.where(known >= 0, known, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
        total = weights.sum()
        prior = float(np.clip((post * weights).sum() / total, 0.02, 0.98))
        for j in range(LABELERS):
            for c, w in ((0, weights * (1 - post)), (1, weights * post)):
                # the start counts as a few votes, so that rare kinds keep their meaning
                start = np.array((0.35, 0.6, 0.05) if c else (0.35, 0.15, 0.5)) * 20
                counts = np.bincount(patterns[:, j], weights=w, minlength=3) + start
                theta[j, c] = counts / counts.sum()
    return theta, post


def _features(kind: np.ndarray, votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """One-hot by kind: each labeler's vote, the shape, what stands beside."""
    n, k = len(kind), len(KINDS)
    blocks = [(kind, k), *((kind * 3 + votes[:, j], 3 * k) for j in range(LABELERS)), (kind * 16 + shape // 4, 16 * k), (kind * 4 + shape % 4, 4 * k)]
    x = np.zeros((n, 1 + sum(size for _, size in blocks)))
    x[:, 0], start = 1, 1
    for at, size in blocks:
        x[np.arange(n), start + at] = 1
        start += size
    return x


def classifier(kind: np.ndarray, votes: np.ndarray, shape: np.ndarray, weights: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; returns the coefficients."""
    x = _features(kind, votes, shape)
    w = np.zeros(x.shape[1])
    scale = np.minimum(weights, 50 * np.sqrt(weights))  # frequent patterns of a large corpus do not drown the others
    scale = scale / max(1.0, scale.mean())
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - target)) + 0.1 * w
        hessian = (x * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(spans: DataFrame) -> np.ndarray | None:
    """The final classifier from all candidates of a corpus; None if there are none."""
    rows = spans.groupBy("kind", "votes", "shape").count().collect()  # at most 4 * 3^5 * 64 rows
    if not rows:
        return None
    anchors, truth = _anchors()
    kind = np.array([r["kind"] for r in rows] + [k for k, _, _ in anchors])
    votes = np.array([[r["votes"] // 3**j % 3 for j in range(LABELERS)] for r in rows] + [list(v) for _, v, _ in anchors])
    shape = np.array([r["shape"] for r in rows] + [x for _, _, x in anchors])
    weights = np.array([r["count"] for r in rows] + [1] * len(anchors), dtype=float)
    known = np.array([-1] * len(rows) + truth)
    target = np.zeros(len(kind))
    for k in range(len(KINDS)):
        own = kind == k
        _, target[own] = reliabilities(votes[own], weights[own], known[own])
    return classifier(kind, votes, shape, weights, target)


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end", "base", "votes", "shape")]))


def _find(text_at: int):
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "base", "votes", "shape")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(text_at).to_pylist():
                found.append([{"kind": k, "start": a, "end": b, "base": int(s), "votes": sum(v * 3**j for j, v in enumerate(votes)), "shape": shape} for k, a, b, s, votes, shape in candidates(text)])
            cols = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], names=[f"c{i}" for i in range(len(cols) + 1)])

    return run


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with found: array of (kind, start, end, base) in text order by kind.

    Offsets count code points, ends are exclusive.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)], T.StructField(f"c{len(rest)}", SPAN)])
    seen = checkpointed(docs.mapInArrow(lean(_find(docs.columns.index(text))), schema))
    spans = f"c{len(rest)}"
    weights = fit(seen.select(F.explode(spans).alias("s")).select("s.*"))
    shared = spark.sparkContext.broadcast(weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = []
            for own in batch.column(batch.num_columns - 1).to_pylist():
                got = []
                if own:
                    votes = np.array([[s["votes"] // 3**j % 3 for j in range(LABELERS)] for s in own])
                    score = _features(np.array([s["kind"] for s in own]), votes, np.array([s["shape"] for s in own])) @ w
                    got = [s for s, v in zip(own, score) if s["base"] or v >= 0]
                out.append([(s["kind"], s["start"], s["end"], s["base"]) for s in got])
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "base")]))
            listed = [[dict(zip(("kind", "start", "end", "base"), s)) for s in x] for x in out]
            cols = [*batch.columns[:-1], pa.array(listed, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    short = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end", "base")]))
    out = seen.mapInArrow(lean(keep), T.StructType([*schema.fields[:-1], T.StructField(spans, short)]))
    return renamed(out, docs.drop(text), "found")


def digest(found: DataFrame) -> DataFrame:
    """The per-document report of the query: counts and digest of base spans, all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter("found", lambda s: s["base"] == 1)
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    ordered = F.array_sort("found")
    counts = [F.size(_of_kind(base, k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.array_sort(base)), 256).alias("base_sha256"), listed(ordered).alias("spans"))


def _of_kind(spans, k: int):
    return F.filter(spans, lambda s: s["kind"] == k)


def brute_base(text: str | None) -> tuple[Counter, str]:
    """Plain reference for the base spans of one text: counts by kind, digest."""
    text = text or ""
    found = []
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    found += [("email", *m.span()) for m in email.finditer(text)]
    for kind in ("ip", "card", "phone"):
        found += [(kind, *m.span()) for m in STRICT[kind].finditer(text) if _strict(kind, m[0])]
    return Counter(k for k, _, _ in found), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
