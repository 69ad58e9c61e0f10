"""Cases that earlier versions of the operators left out."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prismata.llm import common, lines, minhash, near_copies, pii


def test_similar_lines_are_joined_whatever_their_words(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 8)))
    rows, want = [], 0
    for n in (5, 8, 12, 20, 50):
        for _ in range(40):
            own = [word() for _ in range(n)]
            other = own.copy()
            other[r.randrange(n)] = word()
            a, b = " ".join(own), " ".join(other)
            if lines.similar(a, b):
                rows += [(len(rows), a), (len(rows) + 1, b)]
                want += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in lines.dedup(docs, counts=True).collect()}
    assert all(got[i] == 0 for i in range(0, len(rows), 2))  # the first of each pair stays
    assert sum(got.values()) >= 0.97 * want and want > 150


def test_lines_of_spread_edits_are_joined(spark):
    """Recall by kind of edit, of pairs that are 0.8 alike by a plain edit distance."""
    r = random.Random(11)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(4, 8)))

    def replaced(n, k):
        own = [word() for _ in range(n)]
        other = own.copy()
        for i in r.sample(range(n), k):
            other[i] = word()
        return " ".join(own), " ".join(other)

    def typed(n, share):
        own = " ".join(word() for _ in range(n))
        return own, "".join(r.choice(letters) if c != " " and r.random() < share else c for c in own)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    # typos all over a line are a known loss (README): their floor is what is measured, less a margin
    kinds = [(lambda: replaced(6, 1), 0.9), (lambda: replaced(20, 3), 0.9), (lambda: replaced(30, 4), 0.9), (lambda: replaced(30, 5), 0.9), (lambda: replaced(50, 8), 0.9), (lambda: typed(12, 0.03), 0.85), (lambda: typed(40, 0.03), 0.85), (lambda: typed(20, 0.05), 0.6)]
    rows, kind_of = [], {}
    for k, (made, _) in enumerate(kinds):
        for _ in range(60):
            a, b = made()
            if a != b and plain(a, b) <= 0.2 * max(len(a), len(b)):
                kind_of[len(rows) + 1] = k
                rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {x.doc_id: x.n_removed for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    for k, (_, least) in enumerate(kinds):
        own = [got[i] for i in kind_of if kind_of[i] == k]
        assert len(own) > 30 and sum(own) >= least * len(own), (k, sum(own), len(own))


def test_near_copy_stage_equals_exact_jaccard(spark):
    import corpus_pipeline

    r = random.Random(9)
    rows = []
    for _ in range(40):
        own = [f"w{r.randrange(5000)}" for _ in range(r.randrange(40, 200))]
        rows.append((len(rows), " ".join(own)))
        for n in (1, 2, 4):
            other = own.copy()
            for _ in range(n):
                other[r.randrange(len(other))] = "changed"
            rows.append((len(rows), "  ".join(other)))
    rows += [(1000, ""), (1001, None), (1002, "few words"), (1003, "Few  words"), (1004, "few others"), (None, rows[0][1]), (3, "same id, another text of other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    near = [(i, cut(t)) for i, t in rows if i is not None]
    group = list(range(len(near)))
    for i, (_, a) in enumerate(near):
        for j, (_, b) in enumerate(near[:i]):
            if a == b or (a | b and len(a & b) / len(a | b) >= 0.8):
                group = [group[j] if g == group[i] else g for g in group]
    stay = {min(i for (i, _), h in zip(near, group) if h == g) for g in group}
    got = corpus_pipeline.near_copy_stage(spark, docs, "").collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter(x for x in rows if x[0] is None or x[0] in stay)
    assert len(stay) < 120


def test_pipeline_stages_keep_columns_and_odd_rows(spark, sf_dir):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "_toxic", "items", "n_words", "n_tokens", "ids", "node", "key", "c0", "id"]
    long = "many words " * 20_000
    rows = [(1, "one line of words\nread more", "en"), (1, "one line of words\nread more", "en"), (2, None, None), (3, "", "en"), (None, "read more", "en"), (4, long, "en"), (5, "... \n\t", "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), *["own"] * 9) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names[5:]))
    for own in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, sf_dir)
            assert own.columns == names and own.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
            assert all(r.items == "own" and (r.text is None or r.n_chars == len(r.text)) for r in own.collect())
        last = corpus_pipeline.STAGES[-1][1](spark, own, sf_dir).collect()
        assert all(r.n_tokens == len(r.ids) for r in last)
        if not own.isEmpty():
            assert {r.doc_id for r in last} == {1, 2, 4, 5, None}  # 3 has no words, as 2


def test_written_out_addresses_need_no_other_sign():
    for form in ("jane.doe [at] mail.com", "jane.doe (at) mail.com", "jane.doe at mail.com", "jane.doe AT mail [DOT] com", "jane.doe[at]mail{dot}com", "jane.doe {at} mail[ dot ]com"):
        text = f"write to {form}"
        assert [text[a:b] for k, a, b, *_ in pii.candidates(text) if pii.KINDS[k] == "email"] == [form], form
    assert not list(pii.candidates("a line with nothing of the kind"))


def test_short_lines_and_lines_without_spaces_are_deduplicated(spark):
    long = "今日は天気がとても良いので公園まで散歩に行きました、楽しかった。"
    texts = ["read more\n\n" + long, "Read more!\n\nown", long.replace("公園", "学校") + "\nread less", "ok\n...", "OK\n..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_removed) for x in lines.dedup(docs, counts=True).collect()}
    assert got == {0: (texts[0], 0), 1: ("\nown", 1), 2: ("read less", 1), 3: (texts[3], 0), 4: ("...", 1)}


def test_lines_that_share_a_passage_are_not_moved_pair_by_pair(spark):
    """Lines 0.7-0.8 alike: their pairs are packed in blocks, in which a text is a row once."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(5, 8)))
    passage = [word() for _ in range(40)]
    texts = [" ".join([word() for _ in range(8)] + passage + [word() for _ in range(8)]) for _ in range(150)]
    nodes = list(range(1, len(texts) + 1))
    cells = spark.createDataFrame([(5, n, len(t), 0, n, False, True) for n, t in zip(nodes, texts)], minhash.CELLS)
    norms = spark.createDataFrame(list(zip(nodes, texts)), "node long, norm string")
    none = spark.createDataFrame([], "node long, root long")
    blocks = minhash.rest(cells, none, lines.CLOSE)
    near = [(a, b) for a in nodes for b in nodes if a > b and lines.CLOSE(len(texts[a - 1]), 0, len(texts[b - 1]), 0)]
    told = {(int(a), int(b)) for x in blocks.where("pairs is not null").collect() for a, b in np.frombuffer(x.pairs, np.int64).reshape(-1, 2)}
    assert told == set(near) and blocks.count() < len(near) / 20
    assert blocks.groupBy("block", "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    like = {(a, b) for a, b in near if lines.similar(texts[a - 1], texts[b - 1])}
    found = {(x.a, x.b) for x in minhash.tested(blocks, norms, lines._same).collect()}
    assert found <= like and _joined(found) == _joined(like)


def _joined(pairs):
    """The groups that some pairs join."""
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(a)] = find(b)
    groups = {}
    for x in {x for ab in pairs for x in ab}:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Near texts are joined by the anchors of their SimHash, without a band of minima."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for k in range(6):
        own = [word() for _ in range(1500)]
        rows += [(10 * k, " ".join(own)), (10 * k + 1, " ".join([*own[:-1], word()]))]
    docs = spark.createDataFrame([*rows, (90, None), (91, " ")], "doc_id long, text string")
    monkeypatch.setattr(minhash, "linked", lambda cells, norms, close, same, roots=None: roots)
    got = {x.doc_id for x in near_copies.kept(docs).collect()}
    assert got == {10 * k for k in range(6)} | {90}


def test_most_pairs_are_told_apart_without_their_distance(monkeypatch):
    r = random.Random(31)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    pairs = [(line(n), line(n)) for n in [5, 8, 11, 14] * 50]
    room = (1 - lines.SIMILARITY) * np.array([max(len(a), len(b)) for a, b in pairs])
    asked = []
    monkeypatch.setattr(lines, "_banded", lambda a, b, k: asked.extend(a) or np.zeros(len(a), bool))
    monkeypatch.setattr(lines, "_steps", lambda a, b, *k: asked.append(a) or 10**6)
    assert not lines.within(pairs, room).any() and len(asked) < len(pairs) / 20


def test_blocks_beside_each_other_give_the_distances_of_single_pairs():
    r = random.Random(32)
    pairs = []
    for n in [1, 40, 64, 65, 128, 129, 300, 700, 1300] * 12:
        a = "".join(r.choice("abcä ") for _ in range(n))
        b = list(a if r.random() < 0.7 else a[n // 3 :] + a[: n // 3])
        for _ in range(r.randrange(n // 2 + 1)):
            b[r.randrange(len(b))] = r.choice(["", "x", "ab", "漢"])
        pairs.append(tuple(sorted((a, "".join(b) or "y"), key=len)))
    for part in (0.05, 0.2, 0.4):
        room = part * np.array([len(b) for _, b in pairs])
        told = [lines.distance(a, b) <= k for (a, b), k in zip(pairs, room)]
        assert lines.within(pairs, room).tolist() == told
        near = [k for k, (a, b) in enumerate(pairs) if len(b) - len(a) <= room[k]]
        got = lines._banded([pairs[k][0] for k in near], [pairs[k][1] for k in near], room[near])
        assert got.tolist() == [told[k] for k in near] and 0 < got.sum() < len(near)


def test_keys_led_together_have_the_leaders_of_each_alone():
    r = np.random.default_rng(33)
    count = r.integers(1, 9, 200)
    rows = np.zeros(int(count.sum()), minhash.ROW)
    rows["key"], rows["node"] = np.repeat(np.arange(len(count)), count), r.permutation(len(rows))
    rows["size"], rows["sketch"] = r.integers(40, 60, len(rows)), r.integers(0, 4, len(rows)).astype(np.uint64) * np.uint64(0x5555555)
    end = np.cumsum(count)
    alone = np.concatenate([minhash._led(rows[b - n : b], lines.CLOSE) for n, b in zip(count, end)])
    assert (minhash._led_together(rows, count, lines.CLOSE) == alone).all() and 0 < alone["ok"].sum() < len(rows)


def test_rows_kept_in_columns_are_the_rows(spark):
    rows = spark.sql("select * from values (1L, array(1L, null), 'a'), (null, null, null), (2L, array(), 'ä') as t(id, nodes, x)")
    kept = common.stored(rows)
    assert kept.schema == rows.schema and Counter(map(str, kept.collect())) == Counter(map(str, rows.collect()))
    assert common.stored(rows.limit(0)).count() == 0
    assert common.stored(rows.withColumn("none", F.lit(None))).count() == 3
