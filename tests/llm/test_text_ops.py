"""Small fixtures against brute force for the operators of the text subpackage."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from prismata.llm import bpe, components, decontaminate, gam, hilbert, lines, near_copies, pii, queries, simhash, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "Alpha beta gamma", "en", None, 3), (1, "Alpha beta gamma", "en", None, 3), (2, None, None, "s", None), (3, "", "en", "s", 0), (None, "x y z", "en", "s", 5), (4, "the " * 30_000, "en", "s", 1), (5, "... !!! \n\t", "en", "s", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def test_fm_index_finds_every_occurrence():
    r = np.random.default_rng(0)
    for _ in range(30):
        text = r.integers(0, 6, size=r.integers(1, 200))
        index = decontaminate.FMIndex(text)
        for _ in range(10):
            m = r.integers(1, 4)
            p = r.integers(1, 7, size=m)
            row = np.zeros((1, 5), int)
            row[0, 5 - m :] = p
            which, lo, hi = index.search(row, np.array([m]))
            got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(which) else []
            assert got == [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]


def _benchmark(spark):
    return spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven"), (8, "Beta, GAMMA"), (9, None), (10, "..."), (None, "z"), (8, "é one")], "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 24, 20])
def test_decontamination_equals_brute_force(spark, odd, block):
    more = [(20, "a one two three four five six seven eight nine ten ELEVEN twelve. beta gamma", "en", "s", 1), (21, "one two three four five six seven eight nine", "en", "s", 1), (22, "x É-one", "en", "s", 1)]
    docs = odd.unionByName(spark.createDataFrame(more, DOC))
    bench = _benchmark(spark)
    got = decontaminate.digest(decontaminate.find(docs, bench, block_bytes=block)).collect()
    want = decontaminate.brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert Counter(map(tuple, got)) == Counter(want)
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, block_bytes=block).collect()}
    assert cut[20] == "a  twelve. " and cut[2] is None and cut[21] == more[1][1]


def test_decontamination_of_empty_tables(spark, odd):
    bench = _benchmark(spark)
    assert decontaminate.find(odd.limit(0), bench).count() == 0
    assert not any(r.items for r in decontaminate.find(odd, bench.limit(0)).collect())


def test_bpe_equals_library(spark, odd, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    r = random.Random(1)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), 32, 10, 0x3A3, 0x130, 0x1F600])) for _ in range(r.randrange(80))) for _ in range(300)]
    texts += ["a<|endoftext|>b<|startoftext|>", "*" * 3000, "ab" * 900, "I'LL don't"] + [x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    for row in bpe.encode(docs, path).collect():
        ids = lib.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.decoded == lib.decode(ids, skip_special_tokens=False) == bpe.decode(bpe.load(path), ids)


def test_hilbert_curve_visits_every_cell_in_unit_steps(spark):
    cells = [r.cell for r in hilbert.curve(spark).orderBy("h").collect()]
    assert sorted(cells) == list(range(4096))
    at = [(c >> 8, c >> 4 & 15, c & 15) for c in cells]
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(at, at[1:]))


@pytest.mark.parametrize("n", [16, 3, 50])
def test_shards_are_even_and_gapless(spark, odd, sf_dir, n):
    docs = odd.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = hilbert.shards(docs, n).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) == set(range(n)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    last = -1
    for s in sorted(by):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        for r in sorted(by[s], key=lambda r: r.slot):
            assert r.h >= last
            last = r.h
    assert hilbert.shards(odd.limit(0)).count() == 0
    assert hilbert.shards(odd.limit(1), n).collect()[0].shard == 0


def _plain_shards(rows, n):
    """(doc_id, shard, slot) with multiplicity, by loops: cuts by rank, the curve bit by bit, one sort of all rows."""
    import math
    import struct

    def cuts(values, parts):
        values = sorted(values)
        return sorted({values[max(0, math.ceil(k / parts * len(values)) - 1)] for k in range(1, parts)}) if values else []

    def levels(values):
        raw = [None if v is None else v.encode() for v in values]
        known = sorted({v for v in raw if v is not None})
        if not known:
            return [0] * len(raw)
        skip = next((k for k, (x, y) in enumerate(zip(known[0], known[-1])) if x != y), min(len(known[0]), len(known[-1])))
        number = lambda v: int.from_bytes(v[skip : skip + 7].ljust(7, b"\0"), "big")
        at = cuts({number(v) for v in known}, 15)
        return [0 if v is None else sum(c < number(v) for c in at) * 14 // len(at) + 1 for v in raw]

    def along(x):
        """The curve index of a point of three times four bits."""
        x, q = list(x), 8
        while q > 1:
            for i in range(3):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0], x[i] = x[0] ^ t, x[i] ^ t
            q >>= 1
        x[1] ^= x[0]
        x[2] ^= x[1]
        t = 0
        for q in (8, 4, 2):
            if x[2] & q:
                t ^= q - 1
        x = [v ^ t for v in x]
        return int("".join(str(v >> b & 1) for b in (3, 2, 1, 0) for v in x), 2)

    sizes = [len((r.text or "").encode()) + 1 for r in rows]
    size_cuts = cuts(sizes, 16)
    points = zip(levels([r.source for r in rows]), levels([r.lang for r in rows]), [sum(c < s for c in size_cuts) for s in sizes])

    def key(r, point):
        crc = zlib.crc32((r.text or "").encode())
        h = xxhash.xxh64_intdigest(struct.pack("<q", crc), seed=42)
        h = h if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), seed=h)
        signed = h - (1 << 64) if h >> 63 else h
        return along(point), signed % 512, crc, r.doc_id is not None, r.doc_id or 0

    order = sorted(range(len(rows)), key=[key(r, p) for r, p in zip(rows, points)].__getitem__)
    out, base, more, at = Counter(), len(rows) // n, len(rows) % n, 0
    for shard in range(n):
        for slot in range(base + (shard < more)):
            out[rows[order[at]].doc_id, shard, slot] += 1
            at += 1
    return out


@pytest.mark.parametrize("n", [16, 5])
def test_shards_equal_one_sort_of_all_rows(spark, odd, sf_dir, n):
    docs = odd.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = Counter((r.doc_id, r.shard, r.slot) for r in hilbert.shards(docs, n).collect())
    assert got == _plain_shards(docs.collect(), n)


def test_shards_prune_by_each_dimension(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randrange(4000), r.choice(["de", "en", "es", "fr"]), f"site-{min(r.randrange(40), 25):03d}", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOC)
    own = hilbert.shards(docs, 16).join(docs.select("doc_id", "lang", "source"), "doc_id")
    ranges = own.groupBy("shard").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("lang", "source", "size") for f in (F.min, F.max)]).collect()

    def read(column, values):
        return sum(s[f"{column}_min"] <= v <= s[f"{column}_max"] for v in values for s in ranges) / (16 * len(values))

    print([round(read(*x), 2) for x in (("source", [f"site-{k:03d}" for k in range(26)]), ("lang", ["de", "en", "es", "fr"]), ("size", range(100, 4000, 100)))])
    assert read("source", [f"site-{k:03d}" for k in range(26)]) < 0.5
    assert read("lang", ["de", "en", "es", "fr"]) < 0.7
    assert read("size", range(100, 4000, 100)) < 0.7
    assert read("source", ["site-025"]) >= 0.3  # a third of the rows


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def _component_ids(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[root(i)] = min(x, low.get(root(i), x))
    return [low.get(root(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, odd, sf_dir):
    docs = odd.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = simhash.groups(docs).collect()
    rows = docs.collect()
    fps = [_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], _component_ids([r.doc_id for r in rows], fps)))
    assert Counter(map(tuple, got)) == want
    stay = simhash.kept(docs).select("doc_id").collect()
    assert {r.doc_id for r in stay if r.doc_id is not None} == {c for _, _, c in want if c is not None}
    assert simhash.groups(odd.limit(0)).count() == 0


def test_anchors_cover_all_differences_up_to_three(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {f for x in base for f in [x] + [x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 3, 3, 4, 5) for _ in range(6)]}
    big = r.getrandbits(64)  # one heavy anchor: many codes within two bits of each other
    fps |= {big ^ (1 << a) ^ (1 << b) for a in range(32, 64) for b in range(40)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(signed, "fp long, node long")
    roots = {x.node: x.root for x in components.components(simhash.links(nodes)).collect()}
    want = _component_ids(list(range(len(fps))), fps)
    assert [roots.get(i, i) for i in range(len(fps))] == want


def test_split_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "grid", lambda rows, key, salt, probes: __import__("prismata.llm.groups", fromlist=["grid"]).grid(rows, key, salt, probes, cell=5))
    test_anchors_cover_all_differences_up_to_three(spark)


def test_results_replace_columns_of_the_same_name(spark):
    names = ["doc_id", "text", "items", "n_words", "word_spans", "n_tokens", "ids", "found", "score", "n_lines", "x", "node", "key", "id", "c0", "c1"]
    docs = spark.createDataFrame([(k, t, *["own"] * 14) for k, t in enumerate(["beta gamma", None, ""])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    bench = _benchmark(spark)
    found = decontaminate.find(docs, bench)
    assert Counter(found.columns) == Counter(names) and [r.contaminated for r in decontaminate.digest(found).orderBy("doc_id").collect()] == [True, False, False]
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == names and {(r.text, r.items, r.n_words, r.c0) for r in clean.collect()} == {("", "own", "own", "own"), (None, "own", "own", "own")}
    coded = bpe.encode(docs, queries.tokenizer_path(), digest=True)
    assert set(coded.columns) == {*names, "decoded", "ids_sha256", "decoded_sha256"} and {r.n_tokens for r in coded.collect()} == {2, 0}
    assert {r.n_ip for r in pii.digest(pii.find(docs)).collect()} == {0}
    labels = spark.createDataFrame([(0, 1, 1, "z"), (1, 0, 0, "z")], "doc_id long, toxic int, quality int, score string")
    assert all(0 <= r.score <= 1 and r.found == "own" for r in toxicity.score(docs, labels, "toxic", F.lit(False)).collect())
    assert all(0 <= r.score <= 1 for r in gam.score(docs, labels, "quality", F.lit(False)).collect())
    assert len(simhash.groups(docs).collect()) == 3 and len(hilbert.shards(docs).collect()) == 3
    assert near_copies.kept(docs).columns == names and near_copies.kept(docs).count() == 2
    cut = lines.dedup(docs, counts=True)
    assert Counter(cut.columns) == Counter([*names, "n_removed"]) and {r.n_lines for r in cut.collect()} == {1, 0}
    assert lines.dedup(docs).columns == names


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for out in (
        bpe.encode(none, queries.tokenizer_path(), digest=True), pii.digest(pii.find(none)), toxicity.score(none, labels, "toxic", F.lit(False)), gam.score(none, labels, "quality", F.lit(False)),
        hilbert.shards(none), simhash.groups(none), lines.dedup(none), near_copies.kept(none), decontaminate.clean(none, none.select("doc_id", "text"), item_id="doc_id"),
    ):
        assert out.count() == 0


def test_simhash_of_larger_thresholds_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1, 1)], "fp long, node long"), threshold=4)


def test_components_of_a_path_a_star_and_a_ring(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 900)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(5, 5), (None, 3)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    monkeypatch.setattr(components, "FEW", 10)  # by rounds of joins
    assert {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == roots
    assert roots == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 900)}, **{1000 + i: 1000 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [1 << 26, 0])
def test_url_filter_edges(spark, small, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", small)
    pages = [(1, None), (2, "no scheme"), (3, "http://A.Example.com/en/7x?q#f"), (4, "http://x.com"), (5, "https://www.bad.org/p/1.html#z"), (5, "https://www.bad.org/p/1.html#z"), (6, "http://bad.org/p/1/"), (7, "http://bad.org/p/2"), (8, "http://com/en/"), (9, "http://xcom/en/"), (10, "a://b://c")]
    listed = spark.createDataFrame([("http://BAD.org/p/1",), (None,), ("http://other.org/",)], "url string")
    df = spark.createDataFrame([(*p, "x", False) for p in pages], "page_id long, url string, rule string, listed boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in url_filter.judge(df, queries.RULES, listed).collect()}
    assert got == {
        1: ("", "", None, "allow", False), 2: ("", "", None, "allow", False), 3: ("a.example.com", "/en/7x", "example.com/en/7", "allow", False),
        4: ("x.com", "", None, "allow", False), 5: ("www.bad.org", "/p/1.html", None, "block", True), 6: ("bad.org", "/p/1/", None, "block", True),
        7: ("bad.org", "/p/2", None, "allow", False), 8: ("com", "/en/", "com/en/", "block", False), 9: ("xcom", "/en/", None, "allow", False), 10: ("b:", "//c", None, "allow", False),
    }
    assert url_filter.judge(df.limit(0), queries.RULES, listed).count() == 0
    assert url_filter.judge(df, queries.RULES, listed.limit(0)).where("listed").count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    urls = ["http://a.net/de/7", "http://example.net/de/9", "http://example.net/de/8", "http://b.com/en/7", "http://example.com/en/7", "http://c.org/es/", "http://c.org/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, queries.RULES, pages.limit(0)).orderBy("page_id").select("rule", "verdict").collect()
    assert [tuple(r) for r in got] == [
        ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow"),
    ]
