"""HTML text, url rules, tokenizers, packing, toxicity and WARC against brute force and on edge cases."""

import hashlib
import random
import zlib
from array import array

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import html_text, packing, pieces, toxicity, url_filter, warc

ODD = ["", " ", "  a  b ", "▁a▁", "a\nb\t c", "é é ﬁ", "<|endoftext|> x", "it's 'd don't—9a,b", "x" * 5000, "THE, the. The!", "日本語 テキスト", "\x00a", None, "a b c " * 3000]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_pieces_equal_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r for r in pieces.digests(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_pieces_round_trip(spark):
    encoded = pieces.encode(docs(spark, ["a  b ", None]))
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {0: "a  b ", 1: ""}
    assert pieces.digests(docs(spark, [])).count() == 0


def test_chunk_table_is_emptied():
    table = pieces.ChunkTable(pieces.load(pieces.model_path()), entries=2)
    for text in ("a b c", "d e f", "a"):
        words = pieces.chunks(text)
        table.add([words])
        assert table.join(words) == array("I", table.model.encode(text)).tobytes()


def test_packing_looks_up_a_word_once():
    """The ids of texts encoded together are the tokenizer's, and each different word is looked up once."""
    from tokenizers import Tokenizer

    class Counting(dict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    table = packing.WordTable(Tokenizer.from_file(packing.tokenizer_path()))
    table.ids = Counting(table.ids)
    texts = ["One two  three, two\n" * 200, "", "two <|endoftext|> one", "one \u00c4b\u00e9 " * 100]
    assert table.encode(texts) == [array("I", table.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]
    assert table.ids.asked < 20 and table.encode([]) == []


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = packing.pack(docs(spark, texts).coalesce(1), gather=30_000).collect()
    found, sequences = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
        at = 0
        for r in sorted(found[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(sum(r.length for r in own) < 2048 for own in sequences.values()) <= 1


def test_plan_on_random_lengths():
    rng = random.Random(5)
    for n in (0, 1, 2, 50, 3000):
        rests = [rng.randrange(1, 2048) for _ in range(n)]
        full, rest = packing.plan(rests)
        used = sorted(x for s in [*full, rest] for x in s)
        assert all(sum(x[2] for x in s) == 2048 for s in full)
        for i, length in enumerate(rests):
            at = 0
            for _, start, take in (x for x in used if x[0] == i):
                assert start == at
                at += take
            assert at == length


def test_nnls_reaches_the_histogram():
    combos = packing.combinations(np.array([48, 1000, 1048, 2000]), np.array([5, 7, 7, 5]))
    histogram = np.zeros(2049, int)
    histogram[[48, 1000, 1048, 2000]] = [5, 7, 7, 5]
    x = packing.solve(combos, histogram, 400)
    assert (x >= 0).all() and abs(x.sum() - 12) < 0.2


def test_toxicity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(600):
        text = [word() for _ in range(rng.randrange(5, 200))]
        bad = i % 5 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["Vilecur", "scoundrel"]))
        rows.append((i, " ".join(text), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 400").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(got[i] >= toxicity.THRESHOLD) == bool(bad) for i, _, bad in rows[400:]]
    assert sum(held) >= 0.97 * len(held)
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (0, 12)}) == 1
    assert toxicity.filtered(df, model, toxicity.THRESHOLD).columns == df.columns


def test_toxicity_without_labels(spark):
    df = docs(spark, ["a", "b"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(0, 1), (1, None), (1, 7)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.train(df, none)).collect()} == {0.5}
    assert min(r.score for r in toxicity.score(df, toxicity.train(df, one)).collect()) > 0.9


def test_presence_of_long_texts():
    text = "".join(random.Random(2).choice("abc d") for _ in range(50_000))
    whole = toxicity.present(text)
    assert (whole == toxicity.present(text, stretch=7000)).all() and (whole == toxicity.present(text, stretch=7)).all()
    grams = {(" " + text + " ").encode()[i : i + n] for n in toxicity.ORDERS for i in range(len(text) + 3 - n)}
    assert set(whole) == {int(toxicity.buckets(g, (len(g),))[0]) for g in grams}


def test_toxicity_does_not_depend_on_the_layout(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["abc", "defg", "hij", "klmno", "vile" if i % 4 == 0 else "mild"]) for _ in range(40)), int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    models = [toxicity.train(df.repartition(n), df.select("doc_id", "toxic")) for n in (1, 7)]
    assert len(models[0][0]) and all((np.asarray(x) == np.asarray(y)).all() for x, y in zip(*models))
    # log-count ratios and an independent fit: gradient of the penalised mean loss is zero at the weights
    kept, weights, bias = models[0]
    present = [set(toxicity.present(t).tolist()) for _, t, _ in rows]
    x = np.array([[k in p for k in kept.tolist()] for p in present], float)
    y = np.array([r[2] for r in rows], float)
    scores = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert ((scores >= 0.5) == (y == 1)).all() and abs((scores - y).mean()) < 0.01


def test_op9_query(spark, data):
    from lectern.llm import registry

    rows = registry.queries()["op9_toxicity"](spark, data).collect()
    docs_ = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert {r.doc_id for r in rows} == docs_ and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r.predicted == toxic[r.doc_id] for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    assert sum(held) >= 0.9 * len(held)


PAGE = """<!doctype html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header><h2>Site</h2></header>
<nav><a href=/>home</a></nav><div class="cookie-notice">we use cookies here</div><main><article><header><h1>The  Head&amp;line</h1></header>
<p>First &lt;b&gt; <b>bold</b> text of the story goes on for a while.<p>Short.<div class="advert">buy a lot of things now</div>
<ul><li>one<li>two</ul><form><input>sign up now</form></article></main><aside>related things to read</aside>
<section id="comments"><p>I do not agree with any of the things that this page says at all</p></section><footer>&copy; us</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>only <i>this</i>\n one"), (5, "u", "no tags &amp;amp; here"), (6, "u", "<nav>a b</nav>"), (7, "u", "<p>" * 3000 + "deep text"), (8, "u", "<" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    text = "The Head&line\nFirst <b> bold text of the story goes on for a while.\nShort.\none\ntwo"
    assert got[1] == (text, len(text))
    assert got[2] == got[3] == got[6] == ("", 0) and got[4][0] == "only this one" and got[5][0] == "no tags &amp; here" and got[7][0] == "deep text"


def test_html_links_in_text():
    story = "the council met on monday to hear how the old road would be mended and who would pay for it this year. "
    links = '<ul><li><a href=/1>Home page</a></li><li><a href=/2>All news</a></li></ul><div><a href=/3>Terms</a> | <a href=/4>About us</a></div>'
    page = f'<body>{links}<div class="txt"><h1>{story}</h1><p>Read <a href=x>the <b>report</b></a> today. {story * 4}</p><p>{story}<a href=y>More here</a> {story}</p></div>{links}</body>'
    text = html_text.extract(page, html_text.default_weights())
    s = story.strip()
    assert text == f"{s}\nRead the report today. {' '.join([s] * 4)}\n{s} More here {s}"
    article = page.replace('<div class="txt">', "<article>").replace(f"</div>{links}</body>", f"</article>{links}</body>")
    assert html_text.extract(article, html_text.default_weights()) == text
    headline = article.replace(f"<h1>{story}</h1>", f"<h1><a href=/s>{story}</a></h1>")
    assert html_text.extract(headline, html_text.default_weights()) == text


def test_html_best_region():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.randrange(-3, 4) for _ in range(rng.randrange(12))]
        s, e = html_text.best_region(x)
        best = max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])
        assert sum(x[s:e]) == best


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/x", "https://example.com/en/7#t", "//example.com/en/", "http://example.net/de/8?q", "http://x.example.net/de/9", "http://org/es/", "http://borg/es/", "x", None, "http://example.org?a=/es/", "ftp://h"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, labels).collect()}
    assert got == {
        0: ("a.example.com", "/en/x", "com/en/", "block"), 1: ("example.com", "/en/7", "example.com/en/7", "allow"), 2: ("", "", None, "allow"),
        3: ("example.net", "/de/8", "example.net/de/8", "block"), 4: ("x.example.net", "/de/9", "net/de/", "allow"), 5: ("org", "/es/", "org/es/", "block"),
        6: ("borg", "/es/", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("example.org", "", None, "allow"), 10: ("h", "", None, "allow"),
    }


def test_url_templates(spark):
    rows = [(i, f"http://h.test/{'spam' if i % 3 == 0 else 'news'}/{i}.html") for i in range(300)] + [(1000 + i, f"http://g.test/{i}") for i in range(40)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(1, 1)]
    got = {r.page_id: (r.verdict, r.template) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad int"), ()).collect()}
    assert all(got[i] == (("block", "h.test/spam/*/*") if i % 3 == 0 else ("allow", None)) or got[i][0] == ("block" if i % 3 == 0 else "allow") for i in range(300))
    assert all(got[1000 + i][0] == "allow" for i in range(2, 40))


def test_url_templates_below_three_levels(spark):
    part = lambda i: "spam" if i % 5 == 0 else "news"
    rows = [(i, f"http://h.test/en/blog/{part(i)}/{i}.html") for i in range(300)] + [(1000 + i, f"http://g.test/a/b/v1.2/c/{part(i)}/x/{1000 + i}") for i in range(300)]
    labels = [(i, int(i % 5 == 0)) for i in [*range(0, 300, 2), *range(1000, 1300, 2)]]
    bad = spark.createDataFrame(labels, "doc_id long, bad int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.template) for r in url_filter.judge(pages, bad, ()).collect()}
    assert {i: v for i, (v, _) in got.items()} == {i: "block" if i % 5 == 0 else "allow" for i, _ in rows}
    assert got[0][1] == "h.test/en/blog/spam/*"


def test_warc(spark, tmp_path):
    big = "é\r\n" * 40_000 + "\r"
    rows = [(1, "http://a b/\n", big), (2, None, None), (3, "u", "x" * 1000), (5, "u", "x" * 1000), (4, "u", "x" * 1000), (6, "u", "y" * 999), (7, "u", "y" * 999), (None, "u", "x" * 1000), (8, "u", "WARC/1.0\r\n\r\n0\r\n\r\n"), (9, "u", "\r"), (5, "u", "x" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), chunk=1000)
    got = sorted(map(tuple, warc.read(spark, str(tmp_path / "w")).collect()), key=repr)
    kind = lambda i: ("revisit", 5) if i in (3, 4) else ("response", None)
    assert got == sorted(((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *kind(i)) for i, _, h in rows), key=repr)
    parts = warc.read_chunks(spark, str(tmp_path / "w")).where("page_id = 1").orderBy("chunk").collect()
    assert len(parts) > 50 and b"".join(r.data for r in parts) == big.encode() and all(len(r.data) <= 1000 for r in parts)
    assert parts[9].digest == hashlib.sha1(big.encode()[:10_000]).hexdigest()
    warc.write(df.where("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_any_bytes_at_chunk_ends(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "u", "".join(rng.choice(["\r", "\n", "\r\n", "é", "日", "a", "\x00"]) for _ in range(rng.randrange(3000)))) for i in range(60)]
    rows += [(i, "u", "\r" * n) for i, n in enumerate((6, 7, 8, 70_000), 60)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, payload string, chunk int")
    chunks = warc.chunk_rows(warc.records(df), ["page_id"], 7)
    sizes = chunks.groupBy("page_id").agg(F.sum(F.octet_length("data")).alias("n"), F.max(F.octet_length("data")).alias("most"), F.sum(F.col("last").cast("int")).alias("ends")).collect()
    assert {r.page_id: r.n for r in sizes} == {i: len(h.encode()) for i, _, h in rows} and all(r.most <= 7 and r.ends == 1 for r in sizes)
    warc.write(df, str(tmp_path / "w"), chunk=7)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}


def test_warc_query(spark, data, duck):
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    assert sorted(map(tuple, warc.op7_warc(spark, data).select(*columns.split(", ")).collect())) == sorted(duck.sql(f"SELECT {columns} FROM ({warc.ORACLE})").fetchall())


def test_main_text_of_hostile_pages():
    import time

    weights = html_text.default_weights()
    pages = ["<a<a" * 50_000, "<div>word" * 20_000, "<b>w" * 8000 + "<div>" * 8000, '<a "' * 50_000 + ">", "<" * 100_000, "<ul>" + "<div>" * 8000 + "<li>x" * 8000, "<!--" * 100_000, "<p><b>" * 20_000]
    for page in pages:
        began = time.time()
        html_text.extract(page, weights)
        assert time.time() - began < 10


def test_main_text_without_known_names(spark):
    say = "the council met on tuesday to hear how the new bridge would be paid for and who would build it. "
    story = f"<h1>Head</h1><p>{say * 3}</p><p>Short.</p><p>{say}</p>"
    weights = html_text.default_weights()
    for name in ("user-feedback", "opinions", "talkback", "top-strip", "zone-3"):
        text = html_text.extract(f'<body><div>{story}</div><div class="{name}"><p>zebra {say}</p></div></body>', weights)
        assert text.startswith("Head\nthe council") and "Short." in text and "zebra" not in text
    boxed = html_text.extract(f'<body><div class="w7"><div id="q">{story}</div></div><div class="footer">zebra</div></body>', weights)
    assert boxed.startswith("Head\nthe council") and "zebra" not in boxed
    page = f"<article>{story}</article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    rows = html_text.main_text(df).collect()
    assert len(rows) == 4 and sum(r.n_chars > 0 for r in rows) == 2 and {r.text for r in rows if r.page_id > 1} == {""}
    assert html_text.main_text(df.where("false")).count() == 0
