"""Brute force, held-out accuracy and edge cases for the learned and searching operators."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.llm import ann, components, gam, groups, lines, minhash, pii, queries, toxicity

from .test_text_ops import DOC, ODD


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def _plain_base(text):
    text = text or ""
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def _random_texts(n):
    r = random.Random(5)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (204) 555-2971", "+49", "é", " ", "..", "12", "+", "a@b", "x@y.z@w.v", "00", "-", "99999999999999999999"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(n)]


def test_pii_base_equals_plain_patterns(spark, odd, sf_dir):
    texts = _random_texts(1500) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [None, "", "1" * 50_000, "a" * 50_000 + "@"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import hashlib

    for r in pii.digest(pii.find(docs)).collect():
        want = _plain_base(texts[r.doc_id]) if len(texts[r.doc_id] or "") < 50_000 else []
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))  or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_added_spans_are_right_on_planted_texts(spark):
    """Other made-up texts than those that anchor the estimate: precision, recall, rejections."""
    right, wrong = pii.planted(True, 600, 901), pii.planted(False, 600, 902)
    rows = [(i, t) for i, (t, _) in enumerate(right + wrong)] + [(5000 + i, f"host 10.2.{i}.124, 248.167.124.{i} and +1 204 555 29{i:02d} or a{i}@b.org") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.found for r in pii.find(docs).collect()}
    added = lambda i, t: [t[s["start"] : s["end"]] for s in found[i] if not s["base"]]
    hits = sum(v in added(i, t) for i, (t, v) in enumerate(right))
    total = sum(len(added(i, t)) for i, (t, _) in enumerate(right + wrong))
    assert hits >= 0.9 * len(right) and hits >= 0.95 * total
    # look-alikes are candidates and are rejected, not merely unseen
    seen = sum(any(not c[3] for c in pii.candidates(t)) for t, _ in wrong)
    assert seen > 400 and sum(len(added(600 + i, t)) for i, (t, _) in enumerate(wrong)) < 0.05 * seen
    for spans in found.values():
        base = [s for s in spans if s["base"]]
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in spans if not a["base"] for b in base)
    assert not any(added(5000 + i, t) for i, (_, t) in enumerate(rows[1200:]))


def test_pii_estimate_moves_both_classes():
    rows, truth = pii._anchors()
    for k in range(len(pii.KINDS)):
        own = [i for i, r in enumerate(rows) if r[0] == k]
        theta, _ = pii.reliabilities(np.array([rows[i][1] for i in own]), np.ones(len(own)), np.array([truth[i] for i in own]))
        start = np.array([(0.35, 0.15, 0.5), (0.35, 0.6, 0.05)])
        assert (np.abs(theta - start).max(axis=(0, 2)) > 0.1).all()


def test_pii_adds_written_out_forms(spark):
    rows = [(i, f"please call me on 204-555-29{i:02d} or mail jane.doe{i} [at] mail [dot] com, also x{i}@a.org and +1 204 555 29{i:02d}") for i in range(40)]
    rows += [(100 + i, "the order of the words at the dot and on the line is fine") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(docs)).collect()}
    assert all(got[i] == "" for i in range(100, 140))
    assert all(got[i].count("email") == 2 and got[i].count("phone") == 2 for i in range(40))


def test_em_tells_good_labelers_from_bad():
    r = np.random.default_rng(0)
    truth = r.random(5000) < 0.5
    good = np.where(r.random((5000, 3)) < 0.9, truth[:, None], ~truth[:, None])
    votes = np.column_stack([np.where(good, 1, 2), r.integers(0, 3, (5000, 2))])
    u, n = np.unique(votes, axis=0, return_counts=True)
    theta, post = pii.reliabilities(u, n.astype(float))
    assert (theta[:3, 1, 1] > 0.8).all() and (theta[:3, 0, 2] > 0.8).all()
    said = dict(zip(map(tuple, u), post > 0.5))
    assert np.mean([said[tuple(v)] == t for v, t in zip(votes, truth)]) > 0.95


@pytest.mark.parametrize("query, label, line", [(queries.op4_toxicity, "toxic", 0.7), (queries.op6_quality, "quality", 0.3)])
def test_held_out_accuracy(spark, query, label, line):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= line) for r in rows)
    assert np.mean([p == y for p, y in held]) > 0.93


def test_scores_of_odd_rows_and_missing_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int, text string")
    no = F.lit(False)
    assert [r.score for r in toxicity.score(odd, none, "toxic", no).collect()] == [0.5] * len(ODD)
    assert [r.score for r in gam.score(odd, none, "quality", no).collect()] == [0.5] * len(ODD)
    some = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 1, "x"), (3, 0, 0, None), (4, 0, 0, None), (None, 1, 1, None), (9, None, None, "")], none.schema)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, some, "toxic", no).collect())
    assert all(0 <= r.score <= 1 for r in gam.score(odd, some, "quality", no).collect())
    assert toxicity.score(odd.limit(0), some, "toxic", no).count() == 0


def test_string_kernel_tolerates_gaps():
    k = toxicity.Kernel(toxicity.coded(["pathetic", "scum"]))
    near = k.near(["pathetic", "pa-the-tic", "patxhetic", "pathtic", "scum", "sc.um", "window", "pathology", "x" * 100])
    assert near["pathetic"][0] == pytest.approx(1, abs=1e-5) and near["pa-the-tic"][0] == pytest.approx(1, abs=1e-5)
    assert near["patxhetic"][0] > 0.6**toxicity.POWER and near["pathtic"][0] > 0.6**toxicity.POWER
    assert "window" not in near and "x" * 100 not in near
    assert "idiot" in toxicity.words_of("you i d i o t there") and toxicity.words_of(None) == set()


def test_document_kernel_equals_brute_force():
    from itertools import combinations

    def spectrum(word):
        w = "^" + word + "$"
        out = Counter()
        for at in combinations(range(len(w)), 3):
            if at[2] - at[0] < toxicity.SPAN:
                out[tuple(w[i] for i in at)] += toxicity.DECAY ** (at[2] - at[0] - 2)
        return out

    def kernel(a, b):
        x, y = spectrum(a), spectrum(b)
        value = sum(x[k] * y[k] for k in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return value**toxicity.POWER if value > toxicity.FLOOR else 0.0

    landmarks = ["pathetic", "idiot", "scumbag"]
    k = toxicity.Kernel(toxicity.coded(landmarks))
    texts = ["a pathetic idiot, id-iot idioot", "scum scumbags scumbag", "nothing of the kind", "", None, "pathetically idiotic"]
    want = [[sum(kernel("".join(c for c in w if c.isalpha()), m) for w in toxicity.words_of(t)) for m in landmarks] for t in texts]
    assert np.allclose(k.represent(texts), want, atol=1e-4) and np.allclose(k.gram, [[kernel(a, b) for b in landmarks] for a in landmarks], atol=1e-4)


def test_gam_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.Model(x[:3000], y[:3000])
    assert np.mean((m.score(x[3000:]) > 0.5) == y[3000:]) > 0.9
    assert (1, 0) in m.pairs


def test_nearest_neighbours_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(600, 16)) * r.uniform(0.5, 2, size=(600, 1))
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # a vector that many rows hold
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0, None] + [0.0] * 14), (3080, []), (3100, [1.0] * 3), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for x in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    valid = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in valid if i % 20 == 0}
    share = []
    for q, own in got.items():
        own.sort()
        best = sorted((-float(np.cumsum(valid[q] * v)[-1]), i) for i, v in valid.items() if i != q)[:20]
        assert [x[0] for x in own] == list(range(1, 21)) and own == sorted(own, key=lambda x: (-x[2], x[1]))
        assert all(s == float(np.cumsum(valid[q] * valid[i])[-1]) and i != q for _, i, s in own)
        share.append(len({i for _, i, _ in own} & {i for _, i in best}) / 20)
    assert np.mean(share) >= 0.9
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("norms", ["one long", "log-normal", "few rows"])
def test_nearest_neighbours_of_unequal_norms(spark, sf_dir, norms):
    r = np.random.default_rng(11)
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").toPandas()
    x = np.array(own["embedding"].tolist(), dtype=np.float64)
    ids = own["vec_id"].to_numpy()
    if norms == "one long":
        x[5] *= 10
    elif norms == "log-normal":
        x *= r.lognormal(0, 0.7, size=(len(x), 1))
    else:
        x, ids = x[:30], np.arange(30)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for row in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[row.query_id].add(row.vec_id)
    share = []
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        s = x @ x[q]
        best = [int(ids[k]) for k in np.argsort(-s, kind="stable") if k != q][:20]
        assert len(got[int(ids[q])]) == min(20, len(x) - 1)
        share.append(len(got[int(ids[q])] & set(best)) / len(best))
    assert np.mean(share) >= 0.9, np.mean(share)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = random.Random(4)
    for _ in range(400):
        a = "".join(r.choice("abcé ") for _ in range(r.randrange(30)))
        b = "".join(r.choice("abcé ") for _ in range(r.randrange(30))) if r.random() < 0.5 else a[: r.randrange(30)] + r.choice(["", "x", "ab"]) + a[r.randrange(30) :]
        assert lines.distance(a, b) == _distance(a, b)
    word = lambda n: "".join(r.choice("abcdeé 不😀") for _ in range(n))
    pairs = [(word(r.choice([0, 1, 5, 63, 64, 65, 128, 130, 200])), word(r.choice([0, 3, 64, 90, 129, 200]))) for _ in range(300)]
    pairs += [(a, a[:40] + word(3) + a[45:]) for a, _ in pairs]
    pairs += [(a, "".join(c for c in a if r.random() < 0.9) + word(9)) for a, _ in pairs]
    for part in (0.1, 0.2, 0.5, 1.0):
        room = np.array([part * max(len(a), len(b)) + 1e-9 for a, b in pairs])
        assert lines.within(pairs, room).tolist() == [lines.distance(a, b) <= k for (a, b), k in zip(pairs, room)]
        alone, lines.ALONE = lines.ALONE, 20
        assert lines.within(pairs, room).tolist() == [lines.distance(a, b) <= k for (a, b), k in zip(pairs, room)]
        lines.ALONE = alone
    assert all(lines.at_most(a, b) >= lines.distance(a, b) for a, b in pairs)
    assert not len(lines.within([], np.zeros(0)))


def _brute_lines(rows):
    """(kept text, lines, removed) of each row, by comparing all distinct lines with each other."""
    at = []
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0])):
        for k, line in enumerate(t.split("\n")):
            w = re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", line)
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).strip(" ")
            if w:
                at.append(((i is not None, i, k), t, w))
    texts = sorted({w for _, _, w in at})
    parent = {x: x for x in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = [w for w in texts if len(w.split()) >= 5 or len(w) >= 20]
    for i, a in enumerate(long):
        for b in long[:i]:
            room = 0.2 * max(len(a), len(b)) + 1e-9
            if abs(len(a) - len(b)) <= room and sum((Counter(a) - Counter(b)).values()) <= room and root(a) != root(b) and lines.distance(a, b) <= room:
                parent[root(a)] = root(b)
    first = {}
    for place, t, w in at:
        first[root(w)] = min(first.get(root(w), (place, t)), (place, t))
    gone = {(place, t) for place, t, w in at if first[root(w)] != (place, t)}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        own = t.split("\n")
        keep = [x for k, x in enumerate(own) if ((i is not None, i, k), t) not in gone]
        out.append((i, "\n".join(keep), len(own), len(own) - len(keep)))
    return out


def test_line_dedup_equals_brute_force(spark, odd, monkeypatch):
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(80)]
    base = [[r.choice(vocab) for _ in range(r.randrange(3, 60))] for _ in range(25)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(r.randrange(0, 6)):
            w = list(r.choice(base))
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(vocab)
            own.append(r.choice(["", "  "]) + " ".join(w).capitalize() + r.choice(["", ".", "!"]))
        rows.append((d, "\n".join(own + [""] * r.randrange(3))))
    rows += [rows[3], (4, "same id, another text with enough words here"), (None, rows[5][1])] + [(x[0], x[1]) for x in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("line"), F.lit("z").alias("h"))
    got = lines.dedup(docs, counts=True)
    assert got.columns == ["doc_id", "text", "line", "h", "n_lines", "n_removed"]
    have = Counter((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got.collect())
    assert have == Counter(_brute_lines(rows))
    assert sum(x[3] for x in have) > 30
    assert lines.dedup(docs.limit(0)).count() == 0
    for name, small in (("LED", 2), ("PIECE", 3), ("HELD", 50)):  # frequent keys, groups in pieces
        monkeypatch.setattr(minhash, name, small)
    monkeypatch.setattr(groups, "CELL", 2)
    monkeypatch.setattr(lines, "FREQUENT", 3)
    monkeypatch.setattr(components, "FEW", 1)  # and rounds of joins
    assert Counter((x.doc_id, x.text, x.n_lines, x.n_removed) for x in lines.dedup(docs, counts=True).collect()) == have


def test_pipeline_of_small_documents(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.collect()}
    lib = Tokenizer.from_file(queries.tokenizer_path())
    # the same stages one after the other, by their plain counterparts
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf).select("doc_id", "text").collect()
    cut = {i: t for i, t, _, _ in _brute_lines([(r.doc_id, r.text) for r in kept])}
    from .test_text_ops import _component_ids, _fingerprint

    names = sorted(cut)
    stay = {c for c in _component_ids(names, [_fingerprint(cut[i]) for i in names])}
    assert set(ids) == stay
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from prismata.llm import decontaminate

    hit = {r[0]: r[5] for r in decontaminate.brute([(i, cut[i]) for i in stay], bench)}
    for r in out:
        if not hit[r.doc_id]:
            assert r.ids == lib.encode(cut[r.doc_id], add_special_tokens=False).ids
        else:
            assert r.n_tokens < len(lib.encode(cut[r.doc_id], add_special_tokens=False).ids)


def test_quality_scores_are_plain_sums_of_table_entries(spark, sf_dir, monkeypatch):
    """Each score again by loops: a bin by counting edges, table entries added one by one."""
    import math

    made = []

    begin = gam.Model.__init__
    monkeypatch.setattr(gam.Model, "__init__", lambda self, x, y: made.append(self) or begin(self, x, y))
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {r.doc_id: r.score for r in gam.score(docs, labels, "quality", out).collect()}
    model = made[0]
    for r in docs.collect():
        values = gam.features(r.text)
        total = model.bias
        places = [sum(float(edge) <= v for edge in edges) for v, edges in zip(values, model.edges)]
        for table, at in zip(model.tables, places):
            total += table[at]
        for (a, b), table in zip(model.pairs, model.pair_tables):
            total += table[places[a] * gam.COARSE // gam.BINS][places[b] * gam.COARSE // gam.BINS]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-40, min(40, total))))) < 1e-9
    # a first tree is the best of all single cuts, tried one by one
    g, h = np.array([0.5, 0.4, -0.2, -0.9, 0.1]), np.array([1.0, 0.5, 0.7, 1.1, 0.3])
    best = max(range(1, 5), key=lambda c: g[:c].sum() ** 2 / (h[:c].sum() + 2) + g[c:].sum() ** 2 / (h[c:].sum() + 2))
    tree = gam.Model._tree(g, h, 1)
    assert np.allclose(tree[:best], g[:best].sum() / (h[:best].sum() + 2)) and np.allclose(tree[best:], g[best:].sum() / (h[best:].sum() + 2))
