"""Secrets in whole texts: three strict patterns, and a linear-chain conditional random field.

Base spans (assignments to a secret's name, access keys, long hexadecimal runs) always stay.
Beyond them a conditional random field tags the tokens of each line as begin, inside or
outside of a secret. Its features are the token's shape (length, classes of characters,
changes between them, shares of digits and vowels, first characters), the neighbouring
words and signs, and the file (digits, signs of assignment, mixed tokens in it). Tagged
spans that touch no base span are added under the kind `secret`.

The model is trained here, on a bounded sample: SAMPLE lines of the corpus, some with base
spans, others into which secrets and look-alikes (versions, dates, order numbers, paths,
identifiers, short hashes) are planted by a seeded rule; the gradient is the exact one of
the forward-backward algorithm. Only the sample and the model pass the driver.

Scoring is vectorised over slices of about 1 MB: one gather of weights a feature. Lines in
which no token can gain by leaving `outside`, whatever its neighbours, are outside as a
whole; that bound is exact. The other lines are decoded by Viterbi, whole.

Defined results: a null text is empty and has no spans. Whole texts are read; a line of any
length is one sequence. Repeated rows, ties and other columns do not matter; an empty table
gives no rows. A column named `found` gives way to the result. Without any line to learn
from, only base spans are returned.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, bound_batches, lean, renamed, slices, utf8

KINDS = ("assign", "access", "hex", "secret")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "api")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
#: Lines that the model learns from: clean ones, and ones with a base span. A line is cut to LINE characters.
SAMPLE, SAMPLE_BASE, LINE = 2000, 200, 160
ROUNDS, RATE, RIDGE, SEED = 120, 0.15, 0.02, 12
OUT, BEGIN, IN = range(3)
NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns; failing matches are dropped, not retried."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    return out + [(2, *m.span()) for m in HEX.finditer(text)]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


TOKEN = ALNUM.copy()
TOKEN[list(b"_-+/")] = True
DIGIT, UPPER, LOWER, SIGN = _mask(string.digits), _mask(string.ascii_uppercase), _mask(string.ascii_lowercase), _mask("_-+/")
VOWEL, HEXED, SPACE = _mask("aeiouyAEIOUY"), _mask("0123456789abcdefABCDEF"), _mask(" \t\n\x0b\x0c\r")
SETS, QUOTED = _mask("=:"), _mask("\"'`")
HIGH = np.arange(256) >= 128
#: What stands beside a token: nothing, white space, quote, sign of assignment, slash or dot, bracket, other, sign of passwords.
BESIDE = np.full(256, 6, np.int64)
for _code, _chars in ((1, " \t\n\x0b\x0c\r"), (2, "\"'`"), (3, "=:"), (4, "./\\"), (5, "()[]{}<>"), (7, "!@#$%^&*~")):
    BESIDE[list(_chars.encode())] = _code
LENGTHS = np.array([4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
WORDS, FIRSTS = 4096, 1024
#: Size of each feature's block of weights, in the order in which features() makes them.
SIZES = (1, 44, 128, 32, 32, 40, 16, 40, 128, 32, WORDS, WORDS, WORDS, FIRSTS, 64, 16, 64)
STARTS = np.cumsum((0, *SIZES))
TABLE = int(STARTS[-1])


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of maximal runs of a mask, cut at the rows' bounds."""
    left, right = mask.copy(), mask.copy()
    left[1:] &= ~mask[:-1]
    right[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    first, last = inner[inner < len(mask)], inner[inner > 0] - 1
    left[first] = mask[first]
    right[last] = mask[last]
    return np.flatnonzero(left), np.flatnonzero(right) + 1


class Tokens:
    """The tokens of some rows: byte bounds, row, line and features of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        words = Words(data, offsets, TOKEN)
        self.start, self.end, self.row, self.hash = words.start, words.end, words.row, words.hash
        n = len(self.start)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 10, out=breaks[1:])
        fresh = np.ones(n, bool)
        if n:
            fresh[1:] = (self.row[1:] != self.row[:-1]) | (breaks[self.start[1:]] != breaks[self.start[:-1]])
        #: First token of each line, and the end.
        self.lines = np.append(np.flatnonzero(fresh), n)
        self.fresh = fresh

    def features(self) -> np.ndarray:
        """(features, tokens): a place in the table of weights each."""
        data, start, end, n = self.data, self.start, self.end, len(self.start)
        size = end - start

        def many(mask: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(mask, out=sums[1:])
            return sums

        def within(mask: np.ndarray) -> np.ndarray:
            sums = many(mask)
            return sums[end] - sums[start]

        digit, upper, lower = DIGIT[data], UPPER[data], LOWER[data]
        letter = upper | lower
        n_digit, n_upper, n_lower, n_sign, n_high = within(digit), within(upper), within(lower), within(SIGN[data]), within(HIGH[data])
        turn, rise = np.zeros(len(data), bool), np.zeros(len(data), bool)
        turn[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
        rise[1:] = upper[1:] & (lower[:-1] | digit[:-1])
        # a change counts for the token that it lies in; the first byte's change is another's
        n_turn = within(turn) - turn[start] if n else np.zeros(0, np.int32)
        n_rise = within(rise) - rise[start] if n else np.zeros(0, np.int32)
        vowels, hexed = within(VOWEL[data]), within(HEXED[data]) == size
        long = np.minimum(3, size // 8)
        classes = (n_lower > 0) + 2 * (n_upper > 0) + 4 * (n_digit > 0) + 8 * (n_sign > 0) + 16 * (n_high > 0)
        before = np.where(self.fresh, 0, BESIDE[data[np.maximum(start - 1, 0)]])
        last = self.offsets[self.row + 1] if n else np.zeros(0, np.int64)
        after = np.where(end < last, BESIDE[data[np.minimum(end, max(0, len(data) - 1))]], 0)
        spaces, sets, quotes = many(SPACE[data]), many(SETS[data]), many(QUOTED[data])
        gap = np.where(self.fresh, start, np.append(0, end[:-1])) if n else start
        joined = ~self.fresh & (spaces[start] == spaces[gap])
        assigned, quoted = sets[start] > sets[gap], quotes[start] > quotes[gap]
        word = (self.hash % np.uint64(WORDS)).astype(np.int64)
        back = np.where(self.fresh, 0, np.append(0, word[:-1])) if n else word
        second = np.append(True, self.fresh[:-1]) | self.fresh if n else self.fresh
        further = np.where(second, 0, np.append((0, 0), word[:-2])[:n]) if n else word
        ahead = np.where(np.append(self.fresh[1:], True), 0, np.append(word[1:], 0)) if n else word
        head = np.zeros(n, np.uint64)
        for k in range(4):
            at = np.minimum(start + k, max(0, len(data) - 1))
            head = head * np.uint64(257) + np.where(start + k < end, data[at], 0).astype(np.uint64)
        head = (head * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
        mixed = (n_digit > 0) & (n_upper + n_lower > 0)
        file = self._file(sets, n_digit, mixed)
        columns = (
            np.zeros(n, np.int64),
            np.searchsorted(LENGTHS, size, side="right") * 4 + np.minimum(3, n_sign),
            classes * 4 + long,
            np.minimum(7, n_turn) * 4 + long,
            np.minimum(7, n_rise) * 4 + long,
            8 * n_digit // np.maximum(1, size) * 4 + long,
            (hexed * 2 + mixed) * 4 + long,
            8 * vowels // np.maximum(1, n_lower + n_upper) * 4 + long,
            (before * 8 + after) * 2 + joined,
            ((joined * 2 + assigned) * 2 + quoted) * 4 + long,
            back,
            further,
            ahead,
            head,
            file[self.row] * 4 + long if n else word,
            (mixed * 2 + assigned) * 4 + long,
            np.where(self.fresh, 0, np.append(0, classes[:-1])) * 2 + joined if n else word,
        )
        return np.array([np.minimum(c, s - 1) + o for c, s, o in zip(columns, SIZES, STARTS)])

    def _file(self, sets: np.ndarray, n_digit: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """One of sixteen kinds of texts: by signs of assignment and by tokens of digits and letters."""
        rows = len(self.offsets) - 1
        tokens = np.maximum(1, np.bincount(self.row, minlength=rows))
        signs = sets[self.offsets[1:]] - sets[self.offsets[:-1]]
        level = lambda x: np.minimum(3, np.floor(20 * x / tokens)).astype(np.int64)
        return level(signs) * 4 + level(np.bincount(self.row, weights=mixed, minlength=rows))


class Field:
    """Weights of features by tag, of pairs of tags, and of a first tag."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.emit, self.move, self.first = emit, move, first
        # what one token can gain at most on both sides by not being outside
        finite = [x for x in (*(move - move[OUT, OUT]).ravel(), *(first - first[OUT])) if x > NEVER / 2]
        self.slack = 2 * max(0.0, *finite)

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), np.float32)
        for f in features:
            out += self.emit[f]
        return out

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi over one line."""
        move, first = self.move.tolist(), self.first.tolist()
        o, b, i = (first[k] + s for k, s in enumerate(scores[0].tolist()))
        back = []
        for so, sb, si in scores[1:].tolist():
            po = max((o + move[OUT][OUT], OUT), (b + move[BEGIN][OUT], BEGIN), (i + move[IN][OUT], IN))
            pb = max((o + move[OUT][BEGIN], OUT), (b + move[BEGIN][BEGIN], BEGIN), (i + move[IN][BEGIN], IN))
            pi = max((o + move[OUT][IN], OUT), (b + move[BEGIN][IN], BEGIN), (i + move[IN][IN], IN))
            back.append((po[1], pb[1], pi[1]))
            o, b, i = po[0] + so, pb[0] + sb, pi[0] + si
        tags = [max((o, -OUT), (b, -BEGIN), (i, -IN))[1] * -1]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def spans(self, tokens: Tokens) -> Iterator[tuple[int, int, int]]:
        """(row, start, end) in bytes of the tagged spans."""
        if not len(tokens.start):
            return
        scores = self.scores(tokens.features())
        hot = scores[:, 1:].max(axis=1) - scores[:, OUT] + self.slack > 0
        for line in np.unique(np.searchsorted(tokens.lines, np.flatnonzero(hot), side="right") - 1):
            lo, hi = tokens.lines[line], tokens.lines[line + 1]
            at = -1
            for k, tag in enumerate([*self.decode(scores[lo:hi]), OUT]):
                if tag != IN and at >= 0:
                    end = int(tokens.end[lo + k - 1])
                    last = tokens.offsets[tokens.row[lo] + 1]
                    for _ in range(2):  # the padding of base64
                        end += bool(end < last and tokens.data[end] == 61)
                    yield int(tokens.row[lo]), int(tokens.start[at]), end
                    at = -1
                if tag == BEGIN:
                    at = lo + k


def _lines(texts: list[str], spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, tags, lines) of training lines; spans are in characters."""
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    tokens = Tokens(np.frombuffer(b"".join(raw), np.uint8), offsets)
    tags = np.zeros(len(tokens.start), np.int64)
    for r, (text, own) in enumerate(zip(texts, spans)):
        for a, b in own:
            lo, hi = (offsets[r] + len(text[:x].encode()) for x in (a, b))
            at = np.flatnonzero((tokens.start < hi) & (tokens.end > lo))
            tags[at] = IN
            tags[at[:1]] = BEGIN
    return tokens.features(), tags, tokens.lines


def trained(texts: list[str], spans: list[list[tuple[int, int]]]) -> Field:
    """Maximum conditional likelihood with a ridge, by adaptive steps on the exact gradient."""
    features, tags, lines = _lines(texts, spans)
    sizes = np.diff(lines)
    order = np.argsort(-sizes, kind="stable")
    sizes, heads = sizes[order], lines[:-1][order]
    steps, n = int(sizes.max()), len(sizes)
    alive = [int((sizes > t).sum()) for t in range(steps)]
    at = [heads[:m] + t for t, m in enumerate(alive)]
    barred = np.zeros((3, 3))
    barred[OUT, IN] = NEVER
    shape = [(TABLE, 3), (3, 3), (3,)]
    params, sums, squares = ([np.zeros(s) for s in shape] for _ in range(3))
    first_bar = np.array([0.0, 0.0, NEVER])
    seen = np.bincount(features.ravel(), minlength=TABLE) > 0

    for rounds in range(1, ROUNDS + 1):
        score = np.zeros((len(tags), 3))
        for f in features:
            score += params[0][f]
        # forward and backward in probabilities, each step scaled to a sum of one
        here, move = np.exp(score - score.max(axis=1, keepdims=True)), np.exp(params[1] + barred)
        alpha, beta, scale = np.zeros_like(here), np.ones_like(here), np.ones((len(tags), 1))
        for t in range(steps):
            a = (alpha[at[t] - 1] @ move if t else np.exp(params[2] + first_bar)) * here[at[t]]
            scale[at[t]] = a.sum(axis=1, keepdims=True)
            alpha[at[t]] = a / scale[at[t]]
        for t in range(steps - 1, 0, -1):
            beta[at[t] - 1] = (here[at[t]] * beta[at[t]] / scale[at[t]]) @ move.T
        miss = alpha * beta
        miss[np.arange(len(tags)), tags] -= 1
        grads = [np.zeros(s) for s in shape]
        for block, size, f in zip(STARTS, SIZES, features):
            for k in (BEGIN, IN):  # the three sum up to nothing
                grads[0][block : block + size, k] = np.bincount(f - block, weights=miss[:, k], minlength=size)
        grads[0][:, OUT] = -grads[0][:, BEGIN] - grads[0][:, IN]
        for t in range(1, steps):
            grads[1] += move * (alpha[at[t] - 1].T @ (here[at[t]] * beta[at[t]] / scale[at[t]]))
            np.add.at(grads[1], (tags[at[t] - 1], tags[at[t]]), -1)
        grads[2] = miss[at[0]].sum(axis=0)
        for p, g, m, v in zip(params, grads, sums, squares):
            g += RIDGE * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**rounds)) / (np.sqrt(v / (1 - 0.99**rounds)) + 1e-8)
        params[0][~seen] = 0
    return Field(params[0].astype(np.float32), params[1] + barred, params[2] + first_bar)


#: Openings of well-known credentials, with alphabets and lengths of what follows.
_ALNUM = string.ascii_letters + string.digits
OPENINGS = (
    ("ghp_", _ALNUM, 36), ("gho_", _ALNUM, 36), ("glpat-", _ALNUM + "_-", 20), ("sk_live_", _ALNUM, 24), ("rk_live_", _ALNUM, 24), ("sk-", _ALNUM, 40), ("AIza", _ALNUM + "_-", 35),
    ("npm_", _ALNUM, 36), ("pypi-", _ALNUM + "_-", 60), ("dop_v1_", "0123456789abcdef", 22), ("shpat_", "0123456789abcdefABCDEF", 32), ("hf_", _ALNUM, 34), ("SK", "0123456789abcdefABCDEF", 32),
)
#: What stands before secrets, and before look-alikes; {} is the value.
CLUES = (
    "key {}", "key: {}", 'key="{}"', "key = '{}'", "pwd={}", "pwd: {}", "pass: {}", "pass={}", "passphrase {}", "passphrase: {}", "Bearer {}", "Authorization: Bearer {}", "Authorization: Basic {}", "credential {}", "credentials: {}",
    "private key {}", "access key {}", "the access key is {}", "auth: {}", "auth={}", "x-auth: {}", "signature={}", "login admin {}", "login with {}", "export AWS_KEY={}", "client_key={}", "PRIVATE_KEY={}", "clave: {}", "mot de passe : {}", "Kennwort {}", "Kennwort: {}", "contraseña {}",
    "password is {}", "secret is {}", "token {}", "bearer {}",
)
HARMLESS = ("version {}", "order {}", "order no. {}", "id {}", "id: {}", "see {}", "file {}", "file: {}", "on {}", "commit {}", "build {}", "build={}", "page {}", "page: {}", "part {}", "call {}", "from {}", "release {}", "name={}", "name: {}", "url: {}", "tracking {}", "request {}", "size={}", "date: {}", "({})", "\"{}\"", "time = {}", "model {}", "color: {}", "total={}")


def _some(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


def secret(r: random.Random) -> tuple[str, bool]:
    """A made-up secret, and whether it shows without words beside it."""
    kind = min(6, r.randrange(8))
    if kind == 0:
        return _some(r, _ALNUM, r.randrange(16, 49)), True
    if kind == 1:
        return _some(r, _ALNUM + "+/", r.randrange(24, 65)) + "=" * r.randrange(3), True
    if kind == 2:
        opening, alphabet, n = r.choice(OPENINGS)
        return opening + _some(r, alphabet, n), True
    if kind == 3:
        return ".".join(("eyJ" + _some(r, _ALNUM + "_-", r.randrange(17, 40)), "eyJ" + _some(r, _ALNUM + "_-", r.randrange(20, 90)), _some(r, _ALNUM + "_-", 43))), True
    if kind == 4:
        return _some(r, "0123456789ABCDEF", r.choice((16, 32, 40, 64))), True
    if kind == 5:
        return _some(r, "0123456789abcdef", r.randrange(14, 23)), False
    word = "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))
    form = r.randrange(4)
    end = _some(r, "!#$%*@&^", 1) + _some(r, _ALNUM, r.randrange(1, 5)) if form > 1 else _some(r, string.ascii_letters, r.randrange(3))
    return (word.capitalize() if form else word) + _some(r, string.digits, r.randrange(2, 5)) + end, False


def look_alike(r: random.Random, words: list[str]) -> str:
    """A made-up value of a harmless kind."""
    d, word = lambda n: _some(r, string.digits, n), lambda: r.choice(words)
    return r.choice((
        lambda: f"v{r.randrange(30)}.{r.randrange(30)}.{r.randrange(30)}-rc{r.randrange(9)}", lambda: f"{r.randrange(30)}.{r.randrange(30)}.{r.randrange(99)}", lambda: f"20{d(2)}-0{r.randrange(1, 9)}-{r.randrange(10, 28)}T{r.randrange(10, 23)}:{d(2)}:{d(2)}Z",
        lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"ORD-20{d(2)}-{d(6)}", lambda: f"INV{d(r.randrange(4, 9))}", lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: d(r.randrange(4, 20)), lambda: " ".join(d(4) for _ in range(4)), lambda: ".".join(d(2) for _ in range(4)),
        lambda: ":".join(_some(r, "0123456789ABCDEF", 2) for _ in range(6)), lambda: f"{word()}.{word()}{d(2)}@{word()}.com", lambda: f"https://www.{word()}.com/{word()}/{word()}-{word()}-{d(r.randrange(1, 6))}.html", lambda: f"https://{word()}.org/{word()}?{word()}={d(3)}&{word()}={word()}",
        lambda: f"IMG_20{d(6)}_{d(6)}.jpg", lambda: word() + word().capitalize() + word().capitalize() + r.choice(("", d(1))), lambda: "_".join(word() for _ in range(r.randrange(2, 5))), lambda: "-".join(word() for _ in range(r.randrange(2, 6))), lambda: "_".join(word().upper() for _ in range(3)) + r.choice(("", "_2")),
        lambda: _some(r, "0123456789abcdef", r.randrange(6, 13)), lambda: f"{_some(r, string.ascii_uppercase, 2)}-{d(4)}{_some(r, string.ascii_uppercase, 1)}", lambda: word() + d(r.randrange(1, 4)), lambda: f"/{word()}/{word()}/{word()}_{d(2)}.{word()[:3]}", lambda: f"#{_some(r, '0123456789abcdef', 6)}",
        lambda: f"{_some(r, '0123456789abcdef', 8)}-{_some(r, '0123456789abcdef', 4)}-4{_some(r, '0123456789abcdef', 3)}-a{_some(r, '0123456789abcdef', 3)}-{_some(r, '0123456789abcdef', 12)}", lambda: f"{d(2)}th", lambda: f"x{d(2)}_{d(2)}", lambda: word().capitalize() + d(4), lambda: f"{d(4)}{_some(r, string.ascii_uppercase, 1)}{d(3)}",
    ))()


def planted(lines: list[str], seed: int) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Training lines: secrets in two of five lines, look-alikes in two, nothing in one."""
    r = random.Random(seed)
    texts, spans = [], []
    words = [w for x in lines for w in re.findall(r"[a-z]{3,9}", x)][:5000] or ["word"]
    for line in lines:
        own = [m.span(2) if kind == 0 else (a, b) for kind, a, b in base_spans(line) for m in [ASSIGN.match(line, a)] if kind or m]
        form = r.randrange(5)
        if not own and form < 4:
            if form < 2:
                value, bare = secret(r)
                frame = "{}" if bare and r.random() < 0.35 else r.choice(CLUES)
            else:
                value, frame = look_alike(r, words), r.choice(("{}", *HARMLESS)) if r.random() < 0.7 else "{}"
            spaces = [0, *[m.end() for m in re.finditer(" ", line)], len(line)]
            at = r.choice(spaces)
            ahead = line[:at] + (" " if at == len(line) and line else "") + frame[: frame.index("{}")]
            own = [(len(ahead), len(ahead) + len(value))] if form < 2 else []
            line = ahead + value + frame[frame.index("{}") + 2 :] + r.choice((" ", " ", ". ", ", ")) + line[at:]
        texts.append(line)
        spans.append(own)
    return texts, spans


def fit(docs: DataFrame, text: str = "text") -> Field | None:
    """The model from a bounded sample of a corpus's lines; None where there are none.

    A text's hash decides whether it is in the sample and which line it gives, so that equal
    texts count once.
    """
    h = F.xxhash64(text)
    n = docs.where(F.col(text).isNotNull()).count()
    share = max(1, n // (8 * (SAMPLE + SAMPLE_BASE)))
    some = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), h.alias("h")).where(F.pmod("h", F.lit(share)) == 0)
    parts = F.split("t", "\n")
    line = F.substring(F.element_at(parts, (F.pmod(F.shiftright("h", 20), F.size(parts)) + 1).cast("int")), 1, LINE)
    clean = some.select("h", line.alias("line")).where("length(trim(line)) > 0").groupBy("h").agg(F.min("line").alias("line")).orderBy("h").limit(SAMPLE)
    known = docs.where(F.col(text).rlike("(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]")).select(h.alias("h"), F.regexp_extract(text, "(?i)[^\n]{0,120}(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=][^\n]{0,120}", 0).alias("line"))
    known = known.where(F.pmod("h", F.lit(max(1, share // 8))) == 0).groupBy("h").agg(F.min("line").alias("line")).orderBy("h").limit(SAMPLE_BASE)
    lines = [r.line for r in clean.collect()] + [r.line for r in known.collect()]
    lines = [x for x in lines if x.strip()]
    return trained(*planted(lines, SEED)) if lines else None


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end", "base")]))
_KIND = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "base")]))


def scanned(column: pa.Array, field: Field | None) -> list[list[dict]]:
    """All spans of each text, by start and then kind."""
    data, offsets = utf8(column)
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(column))]
    if len(data):
        tagged: dict[int, list[tuple[int, int]]] = {}
        if field is not None:
            for row, a, b in field.spans(Tokens(data, offsets)):
                tagged.setdefault(row, []).append((a, b))
        a, b = _runs(_mask("0123456789abcdef")[data], offsets)
        keen = set(np.searchsorted(offsets, a[b - a >= SHORTEST["hex"]], side="right") - 1)
        raw = data.tobytes().lower()
        for name in (*NAMES, "akia"):
            at = raw.find(name.encode())
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right") - 1)
                keen.add(row)
                at = raw.find(name.encode(), int(offsets[row + 1]))
        for row in sorted(keen | tagged.keys()):
            own = data[offsets[row] : offsets[row + 1]].tobytes()
            base = base_spans(own.decode()) if row in keen else []
            got = [(k, x, y, 1) for k, x, y in base]
            for x, y in tagged.get(int(row), []):
                x, y = (len(own[: z - offsets[row]].decode()) for z in (x, y))
                if all(q <= x or y <= p for _, p, q in base):
                    got.append((KINDS.index("secret"), x, y, 0))
            found[row] = sorted(got, key=lambda s: (s[1], s[0]))
    return [[dict(zip(("kind", "start", "end", "base"), s)) for s in own] for own in found]


def _scan(at: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            found = [s for lo, hi in slices(column) for s in scanned(column.slice(lo, hi - lo), shared.value)]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, _KIND)], names=[f"c{i}" for i in range(len(rest) + 1)])

    return run


def find(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """`docs` without the text, with found: array of (kind, start, end, base) by start, then kind.

    Offsets count code points, ends are exclusive. Without a model one is fitted to `docs`.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text))
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)], T.StructField(f"c{len(rest)}", SPAN)])
    return renamed(docs.mapInArrow(lean(_scan(docs.columns.index(text), shared)), schema), docs.drop(text), "found")


def digest(found: DataFrame) -> DataFrame:
    """The per-document report of the query: counts and digest of base spans, all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter("found", lambda s: s["base"] == 1)
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(3)]
    counts = [(F.size(kinds) - c).cast("long").alias(f"n_{name}") for c, name in zip(counts, KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
