"""Near duplicates, passages, embeddings, search and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bm25, common, jaccard_join, near_vectors, shingles, substring_dedup


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            text = rng.choice(out).split()
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 8, 9, 30, 100, 300]))]
        out.append(" ".join(text))
    return [(i, t) for i, t in enumerate(out)] + [(n, None), (n + 1, " \t "), (n + 2, "A b C d E"), (n + 3, "a B c D e"), (n + 3, "a B c D e")]


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400 + i) for i in range(1, 50)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots({x for e in links for x in e}, links)
    assert got == {k: v for k, v in expected.items() if k in got} and all(k in got or v == k for k, v in expected.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(spark):
    rows = corpus()
    sets = word_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(sets, links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.near_duplicates(df).collect()))
    assert got == sorted((i, len(sets[i]), expected[i]) for i, _ in rows) and len(links) > 50
    assert jaccard_join.near_duplicates(df.where("false")).count() == 0


def test_signatures_meet():
    """Every two sets that link share a signature, at sizes where parts are often empty too."""
    rng = np.random.default_rng(1)
    for n in [4, 5, 6, 7, 8, 9, 10, 13, 14, 20, 33, 60, 61, 88, 200, 700]:
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.permutation(n)[: n - rng.integers(0, n // 4 + 1)]], rng.integers(0, 2**63, rng.integers(0, n // 5 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(x) != both != len(y) and 5 * both >= 4 * (len(x) + len(y) - both):
                assert len(np.intersect1d(jaccard_join.signatures(x), jaccard_join.signatures(y))), n


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 100, 3000):
        x, y = (np.unique(rng.integers(0, 2**63, n + k).astype(np.uint64)) for k in (0, n // 2))
        y = np.unique(np.concatenate([x[: n // 2], y[: n // 3]]))
        bits = [jaccard_join.parity(v).view(np.uint64)[None] for v in (x, y)]
        width = min(v.shape[1] for v in bits)
        folded = [jaccard_join.folded(v, width) for v in bits]
        assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= len(np.setxor1d(x, y))
        z = np.unique(np.concatenate([x[: -(n // 10) or None], rng.integers(0, 2**63, n // 12).astype(np.uint64)]))
        assert jaccard_join.can_link(np.array([len(x)]), np.array([len(z)]), bits[0], jaccard_join.parity(z).view(np.uint64)[None]).all()


def test_large_groups_in_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    rows = corpus(120, 9)
    sets = word_sets(rows)
    expected = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_pairs_meet_once_in_a_run_of_signatures(spark):
    """Sets that have a signature and the one before it in common are given where they met first, in small and in large groups; others at each."""
    rows = [(1, 0, a) for a in (10, 11)] + [(2, 1, a) for a in (10, 11)] + [(3, 1, 10), (3, 7, 11)] + [(4, 0, 10), (4, 0, 12)]
    rows += [(5, 0, a) for a in range(20, 40)] + [(6, 5, a) for a in range(20, 40)] + [(8, 5, a) for a in range(20, 30)] + [(8, 9, 99)]
    found = [tuple(r) for r in jaccard_join.grouped(spark.createDataFrame(rows, "signature long, before long, doc_id long").coalesce(1)).collect()]
    assert {x[1:] for x in found if x[0] is None} == {(10, 11), (10, 12), (20, 99)} | {(20, a) for a in range(21, 40)}
    held = {}
    for g, a, b in found:
        if g is not None:
            held.setdefault(g, set()).add(a)
    assert {frozenset(x) for x in held.values()} == {frozenset([*range(20, 30), 99]), frozenset(range(20, 40))}


def test_compact_windows():
    rng = np.random.default_rng(3)
    values = rng.permutation(60)
    found = substring_dedup.compact_windows(values, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            c = i + int(values[i : j + 1].argmin())
            assert sum(lo <= i <= at <= j <= hi for lo, at, hi in found) == 1
            assert any(lo <= i and j <= hi and at == c for lo, at, hi in found)


def test_stretches():
    rng = random.Random(6)
    for _ in range(200):
        match = np.array([rng.random() < 0.7 for _ in range(rng.randrange(40))], bool)
        found = substring_dedup.stretches(match, 4.0, 3)
        fits = lambda s, e: match[s:e].sum() >= 4 * (~match[s:e]).sum()
        assert all(match[s] and match[e - 1] and fits(s, e) for s, e in found)
        longest = max([0, *(e - s for s in range(len(match)) for e in range(s + 3, len(match) + 1) if match[s] and match[e - 1] and fits(s, e))])
        assert max([0, *(e - s for s, e in found)]) == longest


def test_roles():
    rng = random.Random(41)
    seen = set()
    for _ in range(300):
        n = rng.randrange(1, 30)
        tokens = np.array([rng.randrange(rng.choice([3, 50])) for _ in range(n)], np.int32)
        common = {x for x in tokens.tolist() if rng.random() < rng.choice([0.5, 0.9])}
        shared, at, width = np.array([x in common for x in tokens.tolist()], bool), rng.randrange(n), rng.randrange(2, 14)
        later = earlier = False
        for i in range(at + 1):
            for j in range(at + 1, n + 1):
                part, both = tokens[i:j].tolist(), int(shared[i:j].sum())
                if both >= 0.8 * (j - i) - 1e-9 and len(set(part) & common) >= 0.8 * len(set(part)) - 1e-9:
                    later, earlier = later or j - i >= width, earlier or both >= 0.8 * width - 1e-9
        assert substring_dedup.roles(shared, tokens, at, width) == (later, earlier)
        seen.add((later, earlier))
    assert len(seen) == 3


def test_a_shared_line_makes_no_pairs(spark):
    """Documents that share lines of 20 and 25 words or a word that repeats do not meet; those with 49 of 50 words of a passage do."""
    rng = random.Random(43)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line, other, both = fresh(20), fresh(25), [fresh(22), fresh(27)]
    texts = [fresh(70) + line + fresh(70) + other + fresh(70) for _ in range(80)] + [fresh(60) + ["so"] * 20 + fresh(60) for _ in range(20)]
    texts += [fresh(60) + both[0] + fresh(1) + both[1] + fresh(60) for _ in range(3)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    windows = substring_dedup.window_rows(docs, 50).select("key", "doc", "lo", "c", "hi")
    assert windows.groupBy("key").count().agg(F.max("count")).first()[0] >= 80
    able = substring_dedup.promising(windows, docs, 46, 0.8).collect()
    assert {r.doc for r in able if r.later} == {r.doc for r in able if r.earlier} == {100, 101, 102}
    assert {(r.doc_id, r.match_id) for r in substring_dedup.repeats(docs).collect()} >= {(101, 100), (102, 100)}


def test_windows_that_look_alike_are_judged_once(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    copy, other = rng.sample(words, 80), rng.sample(words, 60)
    rows = [(k, " ".join(copy)) for k in range(30)] + [(50 + k, " ".join(other + rng.sample(words, 20))) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    windows = common.save(substring_dedup.window_rows(docs, 50).select("key", "doc", "lo", "c", "hi"), "windows")
    near = substring_dedup.surroundings(windows.withColumn("root", F.col("doc")), docs, 69)
    assert near.where("doc < 50").select("key", "look").distinct().count() * 30 == near.where("doc < 50").count()
    assert near.groupBy("key", "look").agg(F.count_distinct("near", F.col("c") - F.greatest("lo", F.col("c") - 69)).alias("n")).where("n > 1").isEmpty()
    some = sorted(map(tuple, substring_dedup.promising(windows, docs, 46, 0.8).collect()))
    kept = {}
    monkeypatch.setattr(substring_dedup, "MANY", 1)
    monkeypatch.setattr(substring_dedup, "save", lambda df, name: kept.setdefault(name, (out := common.save(df, name), out.count()))[0] if name == "looks" else common.save(df, name))
    assert sorted(map(tuple, substring_dedup.promising(windows, docs, 46, 0.8).collect())) == some
    assert kept["looks"][1] < near.count() / 4  # a window of each look; every window's tokens were joined before


def test_sides_and_possible_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(8)
    for case in range(300):
        n, width = int(rng.integers(1, 14)), 6
        tokens = rng.integers(0, 4, n) if case % 2 else rng.permutation(20)[:n]
        shared = rng.random(n) < (1 if case % 5 == 0 else 0.8)
        at, fits = int(rng.integers(0, n)), []
        for s in range(at + 1):
            for e in range(at + 1, n + 1):
                kinds, kept = len(set(tokens[s:e])), len(set(tokens[s:e][shared[s:e]]))
                good = shared[s:e].sum()
                if case % 2 and any(shared[i] != shared[j] for i in range(n) for j in range(n) if tokens[i] == tokens[j]):
                    continue
                if good >= 0.8 * (e - s) - 1e-9 and kept >= 0.8 * kinds - 1e-9 and (e - s >= width or good >= 0.8 * width - 1e-9):
                    fits.append((s, e, e - s >= width, good >= 0.8 * width - 1e-9))
        if fits:
            want = any(x[2] for x in fits), any(x[3] for x in fits), min(x[0] for x in fits), max(x[1] for x in fits)
            assert substring_dedup.sides(shared, tokens, at, width) == want
        match = rng.random(40) < 0.85
        assert substring_dedup.possible(match, 12) or not substring_dedup.stretches(match, 0.8 / (1 - 0.8), 12)


def test_large_signatures_are_judged_alike(spark, monkeypatch):
    """Windows of large signatures meet token by token and come to the same; what is shuffled next is written first, and no table stays but the result."""
    rng = random.Random(44)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line, whole = fresh(20), fresh(60)
    texts = [fresh(60) + line + fresh(60) for _ in range(4)] + [fresh(60) + whole + fresh(60) for _ in range(4)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    windows = common.save(substring_dedup.window_rows(docs, 50).select("key", "doc", "lo", "c", "hi"), "windows")
    assert hasattr(substring_dedup.surroundings(windows.withColumn("root", F.col("doc")), docs, 69), "_lectern_path")
    some = sorted(map(tuple, substring_dedup.promising(windows, docs, 46, 0.8).collect()))
    kept, save, drop = [], common.save, common.drop
    monkeypatch.setattr(substring_dedup, "MANY", 1)
    monkeypatch.setattr(substring_dedup, "save", lambda df, name: kept.append((out := save(df, name), name)) or out)
    monkeypatch.setattr(substring_dedup, "drop", lambda spark, *frames: [kept.remove(next(x for x in kept if x[0] is f)) for f in frames] and drop(spark, *frames))
    assert sorted(map(tuple, substring_dedup.promising(windows, docs, 46, 0.8).collect())) == some
    assert {r[1] for r in some} == {4, 5, 6, 7} and {name for _, name in kept} == {"promising"}


def test_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    shared, short = fresh(60), fresh(30)
    near = list(shared)
    near[30] = "changed"
    rows = [(1, fresh(80) + shared + fresh(10)), (2, fresh(20) + shared + fresh(90)), (3, near + fresh(70)), (4, fresh(50) + short), (5, short + fresh(50)), (6, fresh(200)), (7, fresh(3)), (8, [])]
    rows = [(i, " ".join(t)) for i, t in rows] + [(9, None), (10, rows and " ".join(shared).upper()), (None, " ".join(shared))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeats(df)
    got = {}
    for r in found.collect():
        assert r.match_id < r.doc_id and r.similarity >= 0.8
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert set(got) == {2, 3, 10} and got[2] == set(range(20, 80)) and len(got[3] & set(range(60))) >= 55 and got[10] == set(range(60))
    left = {r.doc_id: r.text for r in substring_dedup.cut(df, found).collect()}
    assert 10 not in left and len(left[2].split()) == 110 and left[1] == rows[0][1] and left[9] is None and len(left) == len(rows) - 1
    assert substring_dedup.repeats(df.where("false")).count() == 0


def test_recall_at_the_least_similarity(spark):
    """Passages of the least length with one word changed: 41 of 51 shingles are shared, 0.804."""
    rng = random.Random(17)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(400):
        shared = fresh(50)
        near = shared[:25] + fresh(1) + shared[26:]
        rows += [(2 * i, " ".join(fresh(40) + shared + fresh(40))), (2 * i + 1, " ".join(fresh(25) + near + fresh(60)))]
    got = {(r.doc_id, r.match_id): (r.start_word, r.end_word) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2 * i + 1, 2 * i): (25, 75) for i in range(400)}


def test_form_text_with_shared_slots(spark):
    """A form that many documents fill in: only those with the same two values are similar, whoever else has the form."""
    rng = random.Random(23)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    form = fresh(50)
    values = [fresh(2) for _ in range(60)]
    for i in range(12):
        values[59 - i] = values[10 + i]
    rows = []
    for i, (x, y) in enumerate(values):
        text = list(form)
        text[17], text[34] = x, y
        rows.append((i, " ".join(fresh(30) + text + fresh(30))))
    got = {(r.doc_id, r.match_id) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(59 - i, 10 + i) for i in range(12)}


def test_windows_of_documents_one_after_another():
    rng = np.random.default_rng(5)

    def nodes(values, width):
        out, todo = [], [(0, len(values))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo >= width:
                c = lo + int(values[lo:hi].argmin())
                out.append((lo, c, hi - 1))
                todo += [(lo, c), (c + 1, hi)]
        return out

    for _ in range(100):
        parts = [rng.integers(0, rng.choice([3, 20, 10**9]), rng.integers(0, 120)).astype(np.uint64) for _ in range(4)]
        width, ends = int(rng.integers(1, 30)), np.cumsum([len(x) for x in parts])
        expected = [(lo + at, c + at, hi + at) for x, at in zip(parts, ends - [len(x) for x in parts]) for lo, c, hi in nodes(x, width)]
        assert sorted(map(tuple, substring_dedup.compact_windows(np.concatenate(parts), width, ends).tolist())) == sorted(expected)


def test_signatures_do_not_depend_on_the_surroundings():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**62, 120).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 2**62, n).astype(np.uint64), shared, rng.integers(0, 2**62, m).astype(np.uint64)]) for n, m in ((0, 70), (300, 0), (13, 5))]
    rows = substring_dedup.signed(np.concatenate(texts), np.cumsum([len(x) for x in texts]), 46)
    of = [{tuple(r[:3]): tuple(r[4:]) for r in rows[rows[:, 3] == k].tolist()} for k in range(3)]
    both = [x for x in of[0] if x in of[1] and x[1] and x[2]]
    assert both and all(of[0][x][1] + 300 == of[1][x][1] for x in both)
    assert all(0 <= lo <= c <= hi < len(texts[k]) for k in range(3) for lo, c, hi in of[k].values())


def test_rows_that_repeat_an_id(spark):
    """Equal texts are one document; of different ones a single text takes part and is cut, the others stay."""
    rng = random.Random(37)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = fresh(70)
    rows = [(1, shared + " " + fresh(30)), (5, fresh(20) + " " + shared), (5, fresh(100)), (6, fresh(9) + " " + shared)]
    rows += [rows[-1], (7, None), (7, fresh(80)), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit("x"), "spans": F.lit(1), "id": F.lit(2)})
    found = substring_dedup.repeats(df)
    left = substring_dedup.cut(df, found)
    assert left.columns == df.columns
    got = sorted((r.doc_id, len((r.text or "").split())) for r in left.collect())
    assert got in ([(1, 100), (5, 20), (5, 100), (6, 9), (6, 9), (7, 0), (7, 80), (8, 0)], [(1, 100), (5, 90), (5, 100), (6, 9), (6, 9), (7, 0), (7, 80), (8, 0)])
    assert (5, 100) in got


def test_insertions_on_either_side(spark):
    """90 words, and the same with 9 more in the middle: 82 of 99 shingles are shared, 0.828, whichever comes first."""
    rng = random.Random(29)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, expected = [], {}
    for i in range(20):
        short = fresh(90)
        both = [short, short[:45] + fresh(9) + short[45:]]
        for j, text in enumerate(both if i % 2 else both[::-1]):
            rows.append((2 * i + j, " ".join(fresh(30) + text + fresh(30))))
        expected[2 * i + 1, 2 * i] = (30, 129 if i % 2 else 120)
    got = {(r.doc_id, r.match_id): (r.start_word, r.end_word) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_tails_of_overlapping_passages(spark):
    """A text whose start one document has and whose end another has goes whole."""
    rng = random.Random(31)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(40):
        x = fresh(75)
        rows += [(3 * i + j, " ".join(fresh(20) + t + fresh(20))) for j, t in enumerate((x[:60], x[15:], x))]
    got = {}
    for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i in range(40):
        assert got[3 * i + 2] == set(range(20, 95)), i


def test_links_with_documents_that_are_not_alike(spark):
    """60 words, and the same with the word at 12 or at 47 changed: both are like the first (0.84), but not like each other (0.71); in every order."""
    rng = random.Random(47)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, expected = [], set()
    for k, order in enumerate([(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)] * 8):
        middle = fresh(60)
        one, two = middle[:12] + fresh(1) + middle[13:], middle[:47] + fresh(1) + middle[48:]
        ids = [3 * k + x for x in order]  # of one, middle and two
        rows += [(i, " ".join(fresh(30) + t + fresh(30))) for i, t in zip(ids, (one, middle, two))]
        expected |= {(max(i, ids[1]), min(i, ids[1])) for i in (ids[0], ids[2])}
    got = {(r.doc_id, r.match_id) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def brute_vectors(rows):
    links = Counter()
    pairs = []
    good = [(i, np.array(v, float), l) for i, v, l in rows if v is not None and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    for k, (i, v, l) in enumerate(good):
        for j, w, m in good[k + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    return links, pairs


@pytest.mark.parametrize("block,size", [(2048, 512), (4, 3)])
def test_embeddings(spark, monkeypatch, block, size):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "LIST_SIZE", size)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])], int(rng.integers(3))) for i in range(160)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, [1e30 * x for x in rows[0][1]], rows[0][2]), (205, [1.0, None], 1), (206, [1.0, 2.0], 1), (207, [1.0, 2.0], 1), (208, [float("inf")] * 16, 0)]
    links, pairs = brute_vectors(rows)
    expected = roots([r[0] for r in rows], pairs)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df).collect()}
    assert got == {i: (links[i], expected[i], i == expected[i]) for i, _, _ in rows} and len(pairs) > 100


def test_embeddings_empty(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_bm25(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(400)] + [(400, None), (401, "w1"), (402, "W1!"), (None, "w1")]
    queries = [(0, "w1 w2 w3 w3 w9 w40"), (1, ""), (2, "nothing"), (3, " ".join(words[:80])), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = common.save(bm25.build(df, shard_words=900), "index")
    got = {}
    for r in bm25.search(index, spark.createDataFrame(queries, "query_id long, text string"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    held = [(i, Counter(bm25.terms(t))) for i, t in rows if i is not None]
    n, average = len(held), sum(sum(x.values()) for _, x in held) / len(held)
    df_ = Counter(t for _, x in held for t in x)
    for q, text in queries:
        asked, best = Counter(bm25.terms(text)), []
        for i, x in held:
            length = sum(x.values())
            s = sum(w * math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5)) * x[t] * 2.2 / (x[t] + 1.2 * (0.25 + 0.75 * length / average)) for t, w in sorted(asked.items()) if t in x)
            if s:
                best.append((-s, i))
        best = sorted(best)[:7]
        assert [i for i, _ in got.get(q, [])] == [i for _, i in best]
        assert all(math.isclose(-s, v) for (s, _), (_, v) in zip(best, got.get(q, [])))


def test_bm25_asks_every_twentieth_document(spark, data, monkeypatch):
    """Every document whose id is divisible by 20 is a query, in blocks; summing up and WAND find the same."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 20 = 0").collect()}
    monkeypatch.setattr(bm25, "QUERIES", 4)
    got = sorted(map(tuple, bm25.op8_bm25(spark, data).collect()))
    asked = {i for i, t in texts.items() if bm25.terms(t)}
    assert {r[0] for r in got} == asked and len(asked) > 8
    assert any(len(set(bm25.terms(texts[i]))) > bm25.LONG for i in asked)
    monkeypatch.setattr(bm25, "LONG", 400)
    again = sorted(map(tuple, bm25.op8_bm25(spark, data).collect()))
    assert again == got


def test_bm25_adds_up_queries_together(monkeypatch):
    """Whole documents as queries: their scores are brought near for all together, none is added up alone, and the best are WAND's to the last bit."""
    import numpy as np

    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(300)] + ["w1 w2 w3"] * 40
    lists, names = [], []
    for t in texts:
        lists.append([names.index(w) if w in names else names.append(w) or len(names) - 1 for w in (x.encode() for x in bm25.terms(t))])
    average = sum(map(len, lists)) / len(lists)
    shard = bm25.Shard(next(iter(bm25.shard_rows(0, list(range(len(texts))), lists, names))).to_pylist()[0], average)
    place = {t: k for k, t in enumerate(sorted(names))}
    asked = [sorted((place[t.encode()], c) for t, c in Counter(bm25.terms(x)).items()) for x in texts[:60] + texts[-2:]]
    idf = np.log(1 + (len(texts) - shard.n + 0.5) / (shard.n + 0.5))
    query = np.repeat(np.arange(len(asked)), list(map(len, asked)))
    term, count = np.array([x for q in asked for x in q]).T
    monkeypatch.setattr(bm25, "CELLS", 3000)
    shard.prepare(np.unique(term))
    assert 0 < len(shard.matrix) < len(np.unique(term))
    of, docs, scores = shard.summed(query, term, count * idf[term], len(asked), 7, np.zeros(len(asked)))
    of, docs, scores, _ = bm25.best(of, docs, scores, 7)
    for i, q in enumerate(asked):
        want = bm25.wand([(float(c * idf[t]), *shard.lists(t)) for t, c in q], shard.lengths, 7, average)
        assert list(zip(scores[of == i].tolist(), docs[of == i].tolist())) == want


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.save(stage(spark, docs, sf), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "near_duplicates":
            sets = word_sets(before.items())
            expected = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
            assert set(after) == {i for i in before if expected[i] == i}
        if name == "repeated_passages":
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    rows = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == set(after)


def test_shingles_of_short_texts():
    assert len(shingles.shingle_set("a b")) == 1 and len(shingles.shingle_set("a b c d e f")) == 2 and len(shingles.shingle_set(None)) == 0


def test_settling_a_pair_needs_no_sort_where_tokens_differ(monkeypatch):
    rng = random.Random(17)
    hidden = lambda tokens: (_ for _ in ()).throw(AssertionError("sorted"))
    found = 0
    for _ in range(200):
        base = rng.sample(range(1000), 60)
        b = np.array([x for x in base if rng.random() < 0.95] + rng.sample(range(1000, 2000), 20), np.uint64)
        a = np.array(rng.sample(range(2000, 3000), 15) + [x for x in base if rng.random() < 0.95], np.uint64)
        want = substring_dedup.passages(b, a, [(0, len(b))], 20, 0.8)
        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "distinct", hidden)  # two sorts and a third of both together, each pair, before
            ranked = substring_dedup.ranks(a)
            assert substring_dedup.passages(b, a, [(0, len(b))], 20, 0.8, ranked, substring_dedup.places_in(b, ranked[1]), True) == want
        for s, e, lo, hi, value in want:
            x, y = ({*t[i : j - shingles.WORDS + 1].tolist()} for t, i, j in ((b, s, e), (a, lo, hi)))
            assert abs(len(x & y) / len(x | y) - value) < 1e-12
        found += len(want)
    assert found > 100


def test_runs_gone_through_one_by_one_give_the_same_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(300):
        runs = substring_dedup.turns(rng.random(rng.integers(1, 150)) < rng.choice([0.5, 0.8, 0.95]))
        for penalty in (4.0, 8.0):
            few = substring_dedup.among_few(*(x.tolist() for x in runs), penalty, 6)
            with monkeypatch.context() as m:
                m.setattr(substring_dedup, "FEW", -1)
                assert substring_dedup.among(*runs, penalty, 6) == few


def test_surroundings_of_many_windows_of_a_text(spark):
    """Near tokens and looks are cut out for all windows of a document together, in parts of SOME."""
    import xxhash

    rng = random.Random(23)
    texts = {k: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(400)) for k in (1, 2)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    rows = [(k, d, lo, c, hi, -d) for k in range(1500) for d in texts for lo in [rng.randrange(150)] for c in [lo + rng.randrange(100)] for hi in [c + rng.randrange(140)]]
    found = substring_dedup.surroundings(spark.createDataFrame(rows, "key long, doc long, lo int, c int, hi int, root long"), docs, 69).collect()
    assert sorted((r.key, r.doc, r.lo, r.c, r.hi, r.root) for r in found) == sorted(rows)
    tokens = {k: (shingles.mix(shingles.sequence(shingles.word_hashes(shingles.words(t)))) >> np.uint64(32)).astype(np.uint32).view(np.int32) for k, t in texts.items()}
    for r in found:
        start = max(r.lo, r.c - 69)
        near = tokens[r.doc][start : min(r.hi, r.c + 69) + 1]
        assert r.near == near.tolist()
        assert r.look == np.array([xxhash.xxh3_64_intdigest(near.tobytes(), r.c - start)], np.uint64).view(np.int64)[0]
