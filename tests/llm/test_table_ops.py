"""Whitening, Merkle manifest and token counts against brute force."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle, registry, token_counts, whitening

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    n = row["n_chars"]
    values = [row["doc_id"], row["source"], row["lang"], None if n is None else n + more, row["text"]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def run_up(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, i):
    out = []
    for row in levels[:-1]:
        out.append((i % 2, row[i ^ 1] if i ^ 1 < len(row) else None))
        i //= 2
    return out


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[x] = run_up([leaf(r) for r in by[x]])
    top = run_up([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = way(trees[x], i) + way(top, k)
            chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r, int(chosen))
            for right, other in path:
                now = h((other or "") + now) if right else h(now + (other or ""))
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], top[-1][0], h("".join(o for _, o in path if o)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def documents(n, seed=5):
    rng = random.Random(seed)
    rows = [dict(doc_id=rng.choice([i, i, i - 1, -i]), text=rng.choice(["", "a", "é|b:c", "x" * 3000, None]), lang=rng.choice(["en", "en", "en", "", "Zz", "zz", "é", None]), source=rng.choice(["s", None, ""]), n_chars=rng.choice([i, None, 2**63 - 1])) for i in range(n)]
    return rows + [dict(doc_id=None, text=None, lang=None, source=None, n_chars=None)] * 2 + rows[:5]


FOUND = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("height, n", [(1, 60), (2, 301), (8, 700)])
def test_manifest(spark, height, n):
    """Nulls, ties, repeated rows, langs that differ in case and one that is empty, tampering at the largest long."""
    rows = documents(n)
    df = spark.createDataFrame(rows, DOCUMENT).repartition(5).select("*", *[F.lit(1).alias(c) for c in ("named", "grp", "key", "leaf", "here", "tie", "digest")])
    got = sorted(map(tuple, merkle.manifest(df, height).select(*FOUND).collect()), key=repr)
    assert got == brute_manifest(rows)
    assert {True, False} == {x[-1] for x in got}


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCUMENT)).count() == 0
    rows = [dict(doc_id=3, text="t", lang="en", source="s", n_chars=1)]
    for case in (rows, rows * 2, [rows[0], rows[0] | {"lang": None}], [rows[0] | {"lang": str(i)} for i in range(9)]):
        got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(case, DOCUMENT), 1).select(*FOUND).collect()), key=repr)
        assert got == brute_manifest(case)
    assert brute_manifest(rows)[0][4] == h("")


def test_one_group_spans_partitions(spark):
    """Equal rows as one group: their places are dealt over partitions by the row's number."""
    rows = [dict(doc_id=7, text="t", lang="en", source="s", n_chars=1)] * 500
    df = spark.createDataFrame(rows, DOCUMENT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out, before, most = merkle.placed(merkle.leaves(df))
        assert out.select("pid").distinct().count() > 1 and most == 500 and max(before.values()) < 500
        got = sorted(map(tuple, merkle.manifest(df, 3).select(*FOUND).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_manifest(rows)


def brute_whitening(vectors, most=16):
    """From the definition: exact integers, a full eigendecomposition."""
    x = [[int(np.floor(64 * float(v))) + 1_000_000 for v in row] for row in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, total = len(fit), fit.sum(0)
    c = ((fit * n - total) / n).astype(float)
    cov = c.T @ c / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
    deviations = [int(((np.array(r, object) * n - total) ** 2).sum()) for r in x]
    return n, deviations, ((np.array(x, object) * n - total) / n).astype(float), values, turn, values / np.trace(cov)


def check_whitening(df, vectors, ids, most=16, count=None):
    n, deviations, rows, values, turn, explained = brute_whitening(vectors, most)
    count = len(values) if count is None else count
    found = {}
    for r in df.collect():
        found.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(found) == set(ids)
    signs = {}
    for i, k in sorted((i, k) for i in found for k in found[i]):
        where = [j for j, x in enumerate(ids) if x == i]
        assert len(found[i][k]) == len(where)
        for r, d in zip(sorted(found[i][k], key=lambda r: r.deviation), sorted(deviations[j] for j in where)):
            assert r.n == n and r.deviation == d and r.identity_error <= 1e-9
            assert abs(r.explained / explained[k - 1] - 1) < 1e-9
        if len(where) == 1:
            want = rows[where[0]] @ turn[:, k - 1] / np.sqrt(values[k - 1])
            if abs(want) > 1e-3:
                assert signs.setdefault(k, np.sign(want * found[i][k][0].whitened)) == np.sign(want * found[i][k][0].whitened)
            assert abs(abs(want) - abs(found[i][k][0].whitened)) < 1e-6
    assert all(sorted(x) == list(range(1, count + 1)) for x in found.values())


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_whitening_of_a_flat_spectrum(spark):
    """40 dimensions of about equal variance: the block has to be expanded to the full dimension."""
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 40)) * 3).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    df = vectors_table(spark, rows + [(900, None, 1), (901, [1.0] * 39 + [None], 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] * 40, 1)]).repartition(3)
    check_whitening(whitening.whitened(df.withColumn("x", F.lit(1)).withColumn("n", F.lit(1))), vectors, list(range(300)))
    fit = df.where(whitening.usable("embedding")).select(whitening.whole("embedding").alias("x"))
    assert whitening.pairs(fit, *whitening.sums(fit))[3] == 40


def test_whitening_within_the_range_found(spark):
    """50 dimensions, 12 of them with variance: the random block of 26 columns holds them all and is not expanded."""
    rng = np.random.default_rng(4)
    vectors = np.zeros((200, 50), np.float32)
    vectors[:, :12] = rng.standard_normal((200, 12)) * np.geomspace(50, 1, 12)
    vectors[150:] = vectors[:50]  # repeated vectors count once in the fit
    df = vectors_table(spark, [(i, v.tolist(), 1) for i, v in enumerate(vectors)]).repartition(3)
    check_whitening(whitening.whitened(df), vectors, list(range(200)), count=12)
    fit = df.select(whitening.whole("embedding").alias("x")).distinct()
    values, components, trace, width = whitening.pairs(fit, *whitening.sums(fit))
    assert width == 26 and abs(values[:12].sum() / trace - 1) < 1e-12


def test_whitening_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert whitening.whitened(empty).count() == 0
    assert whitening.whitened(vectors_table(spark, [(1, [], 1), (2, [], 1)])).count() == 0
    assert whitening.whitened(vectors_table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    # Lengths of vectors are tables of their own; repeated rows and ids repeat; a null id stays.
    two = [(1, [1.0, 2.0], 1), (2, [3.0, -1.0], 1), (2, [3.0, -1.0], 1), (None, [0.0, 5.0], 1)]
    got = whitening.whitened(vectors_table(spark, [*two, (5, [1.0], 1), (6, [4.0], 1)])).collect()
    assert sorted((r.vec_id or -1, r.component, r.n) for r in got) == [(-1, 1, 3), (-1, 2, 3), (1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 1, 3), (2, 2, 3), (2, 2, 3), (5, 1, 2), (6, 1, 2)]
    assert {r.deviation for r in got if r.component == 1 and r.vec_id in (5, 6)} == {192**2}


def test_whitening_of_large_entries(spark):
    """Sums and deviations beyond 64 bits are exact, or null; entries beyond 2^56 drop the row."""
    far = spark.createDataFrame([(i, [float(2**50 + 2**20 * i), float(i * i)]) for i in range(5)] + [(9, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whitened(far).collect()}
    x = [(64 * (2**50 + 2**20 * i) + 10**6, 64 * i * i + 10**6) for i in range(5)]
    total = [sum(v) for v in zip(*x)]
    want = [sum((5 * v - t) ** 2 for v, t in zip(r, total)) for r in x]
    assert {k: r.deviation for k, r in got.items()} == {(i, c): want[i] for i in range(5) for c in (1, 2)}
    huge = spark.createDataFrame([(1, [2.0**55]), (2, [-(2.0**55)])], "vec_id long, embedding array<double>")
    assert [(r.deviation, round(abs(r.whitened), 9)) for r in whitening.whitened(huge).collect()] == [(None, 1.0)] * 2


def test_op11_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    check_whitening(registry.queries()["op11_whitening"](spark, data), [r.embedding for r in rows], [r.vec_id for r in rows])


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    alphabet = ["a", "b", "é", "e", "́", " ", " ", "  ", "\n", "1", "2", "'", "s", "'s", "t", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "你", "。", "▁", "Σ", "ſ", "İ", "!", "\t", "ﬁ", "　", "﻿", "\x00", "😀", "\r", "<s>", " x", " y"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def library(name):
    path = token_counts.tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda x: len(model.encode(x))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda x: len(model.encode(x, add_special_tokens=False))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    """Also with stretches of a few bytes, so that cuts fall everywhere they may."""
    count, counter = library(name), token_counts.kind(path := token_counts.tokenizer_path(name))(path, entries=50)
    cases = texts() + ["", " ", "  ", "a" * 5000, "你好" * 3000, "a1 " * 3000, "word " * 9000 + " end"]
    for stretch, most in ((5, 40), (1000, 5000)):
        got = [0] * len(cases)
        for rows, held in token_counts.batches([x.encode() for x in cases], counter.safe, stretch, most):
            for i, n in zip(rows, counter.count(held)):
                got[i] += n
        assert got == [count(x) for x in cases]
    rows = list(enumerate(cases)) + [(None, "a b"), (7, None), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("x")).withColumn("n_tokens", F.lit("x"))
    found = sorted(map(tuple, token_counts.counts(df, path=path, limit=20).collect()), key=repr)
    assert found == sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 20) for i, t in rows), key=repr)


def test_stretches_are_bounded():
    safe = token_counts.Dropped.safe
    text = b"ab cd " * 1000
    assert b" ".join(token_counts.stretches(text, safe, 50)) == text and max(map(len, token_counts.stretches(text, safe, 50))) <= 53
    assert list(token_counts.stretches(b"a" * 100, safe, 10)) == [b"a" * 100]
    sizes = [sum(map(len, held)) for _, held in token_counts.batches([text] * 10, safe, 500, 2000)]
    assert max(sizes) <= 2000 and min(sizes[:-1]) >= 1400


def test_unknown_files_go_whole(tmp_path):
    """A file whose words may hold spaces, or whose special strings hold one, has no safe boundaries."""
    path = token_counts.tokenizer_path()
    assert token_counts.kind(path) is token_counts.Dropped
    with open(path, encoding="utf-8") as file:
        what = json.load(file)

    def changed(**new):
        at = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        at.write_text(json.dumps(what | {"model": {}} | new))
        return token_counts.kind(str(at))

    assert changed() is token_counts.Dropped
    split = json.loads(json.dumps(what["pre_tokenizer"]))
    split["pretokenizers"][0]["pattern"]["Regex"] = r"[^\p{N}]+"
    assert changed(pre_tokenizer=split) is token_counts.Whole
    assert changed(added_tokens=[what["added_tokens"][0] | {"content": "<a b>"}]) is token_counts.Whole
    assert changed(normalizer={"type": "NFKC"}) is token_counts.Whole
    assert changed(pre_tokenizer=None) is token_counts.Whole


def test_op13_query(spark, data):
    count = library("word_bpe_49k.json")
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = sorted(map(tuple, registry.queries()["op13_token_counts"](spark, data).collect()))
    assert got == sorted((r.doc_id, len(r.text.encode()), count(r.text), count(r.text) > 2048) for r in rows)


@pytest.mark.parametrize("name", ["op11_whitening", "op12_merkle", "op13_token_counts"])
def test_empty_tables_with_clashing_columns(spark, data, tmp_path, name):
    for t in ("documents", "embeddings"):
        rows = spark.read.parquet(f"{data}/{t}.parquet").where("false")
        rows.select("*", *[F.lit(1).alias(c) for c in ("x", "n", "component", "leaf", "key", "grp", "n_tokens")]).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0
