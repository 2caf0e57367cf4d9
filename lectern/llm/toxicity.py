"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of byte n-grams (UTF-8, A-Z lower-cased) of a few orders, hashed into a fixed number
of buckets. Each feature is scaled by its log-count ratio r = log((p + a) / |p|) - log((q + a) / |q|), p and q
being its document counts in the two classes, and a logistic regression with an L2 penalty is fitted on the
scaled features. It is fitted on a bounded, deterministic sample of labelled rows (SAMPLE), whose n-grams are counted
by Spark, and on all features that depend on the class (SIGNIFICANT); the model is a function of the sample and not of how
its rows lie in files. Scoring covers every whole text in one pass without a shuffle.

Defined results: a null or empty text has no features and scores as the intercept; labels other than 0 and 1
are left out, a document labelled both ways counts as 1; repeated rows score alike, and each counts in training; with no
labels of one class every score is the share of label 1 (0.5 without labels), and an empty table gives no rows; very long
texts are read whole, in stretches; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (4, 5, 6)
BITS = 20
#: Most labelled rows the classifier is fitted on, and tasks that read them.
SAMPLE, TASKS = 20_000, 16
#: Least chi-square statistic of a feature's presence and the class: about one in 2**BITS independent features has it by chance.
SIGNIFICANT = 24.0
THRESHOLD = 0.3
#: Bytes of a text that are hashed at a time, and rows that are scored at a time.
STRETCH, ROWS = 1 << 20, 256


def buckets(data: bytes, orders: tuple[int, ...] = ORDERS, bits: int = BITS):
    """The bucket of every n-gram of ``data``, repeats included."""
    import numpy as np

    data = np.frombuffer(data, np.uint8).astype(np.uint64)
    out, rolled = [], data.copy()
    for n in range(2, max(orders) + 1):
        if len(data) < n:
            break
        rolled = rolled[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in orders:
            out.append(((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def present(text: str | None, kept=None, stretch: int = STRETCH):
    """The distinct buckets of a text with a space before and after, those that ``kept`` marks if it is given."""
    import numpy as np

    data = b" " + text.encode().lower() + b" " if text else b""
    found = []
    for i in range(0, max(1, len(data)), stretch):  # each n-gram begins in one stretch and is read to its end
        b = buckets(data[i : i + stretch + max(ORDERS) - 1])
        found.append(np.unique(b if kept is None else b[kept[b]]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def fit(rows, labels, scale, penalty: float = 1e-3, rounds: int = 300, block: int = 1 << 18):
    """Weights and intercept; ``rows`` are lists of feature numbers, scaled by ``scale``. Rows are gone through in blocks of about ``block`` features."""
    import numpy as np

    y, sizes = np.asarray(labels, float), np.array([len(x) for x in rows])
    edges, cuts = np.concatenate([[0], np.cumsum(sizes)]), [0]
    while cuts[-1] < len(rows):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(edges, edges[cuts[-1]] + block, side="right")) - 1))
    parts = [(s, e, np.concatenate([*rows[s:e], np.zeros(0, np.int32)]).astype(np.int32), np.repeat(np.arange(e - s, dtype=np.int32), sizes[s:e])) for s, e in zip(cuts, cuts[1:])]
    w, bias, n = np.zeros(len(scale)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), len(y)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        g, gb, scaled = np.zeros_like(w), 0.0, w * scale
        for s, e, index, at in parts:
            score = np.bincount(at, scaled[index], e - s) + bias
            gap = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[s:e]
            g += np.bincount(index, gap[at], len(scale))
            gb += gap.sum()
        g, gb = g * scale / n + penalty * w, gb / n
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * (1 - k / rounds) + 0.002
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return w * scale, bias


def chi_square(n0: int, n1: int):
    """The chi-square statistic between a feature's presence (document counts c0 and c1) and the class."""
    a, b = F.col("c1").cast("double"), F.col("c0").cast("double")
    there, away = a + b, F.lit(float(n0 + n1)) - a - b
    return F.lit(float(n0 + n1)) * (a * (F.lit(float(n0)) - b) - b * (F.lit(float(n1)) - a)) ** 2 / F.greatest(there * away * F.lit(float(n0) * n1), F.lit(1.0))


def counted(rows: DataFrame) -> DataFrame:
    """(bucket, c0, c1): in how many texts of each class of ``rows`` (toxic, text) a bucket is present."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[label, present(text.as_py())] += 1
        there = np.flatnonzero(counts.any(0))
        for i in range(0, len(there), 1 << 16):
            at = there[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "c0", "c1"])

    return rows.mapInArrow(run, "bucket int, c0 long, c1 long").groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, significant: float = SIGNIFICANT, smooth: float = 1.0) -> tuple:
    """(buckets, weights, intercept) from ``labels`` (doc_id, toxic) and the texts of ``docs``.

    At most ``sample`` labelled ids are used, the ones with the smallest hash of doc_id.
    """
    import numpy as np
    import pyarrow as pa

    from .common import save

    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    rows = save(rows.repartition(TASKS), "toxicity")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        share = float(next(iter(sizes), 0.5))
        share = min(max(share, 1e-9), 1 - 1e-9)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
    counts = save(counted(rows), "counts")
    q, p = (x + smooth * (1 << BITS) for x in counts.agg(F.sum("c0"), F.sum("c1")).first())
    found = counts.where(chi_square(sizes[0], sizes[1]) >= significant).orderBy("bucket").collect()
    kept = np.array([r.bucket for r in found], np.int64)
    scale = np.array([np.log((r.c1 + smooth) / p) - np.log((r.c0 + smooth) / q) for r in found], float)
    marked = np.zeros(1 << BITS, bool)
    marked[kept] = True

    def features(batches):
        for batch in batches:
            found = [np.searchsorted(kept, present(x.as_py(), marked)).astype(np.int32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["toxic", "found"])

    held = sorted((r.toxic, bytes(r.found)) for r in rows.mapInArrow(features, "toxic int, found binary").collect())
    weights, bias = fit([np.frombuffer(x, np.int32) for _, x in held], [y for y, _ in held], scale)
    return kept, weights, bias


def scorer(model: tuple):
    """A function from an Arrow array of texts to their scores."""
    import numpy as np

    kept, weights, bias = model
    marked, table = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
    marked[kept], table[kept] = True, weights
    return lambda texts: 1 / (1 + np.exp(-np.clip(np.array([table[present(x.as_py(), marked)].sum() for x in texts]) + bias, -500, 500)))


def parts(batches):
    """The batches in stretches of at most ROWS rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def score(docs: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    import pyarrow as pa

    def run(batches):
        scores = scorer(model)
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, score double")


def filtered(docs: DataFrame, model: tuple, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``; scored and filtered in one pass."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches):
        scores = scorer(model)
        for batch in parts(batches):
            yield batch.filter(pa.array(scores(batch.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_toxicity(spark, sf_dir):
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
