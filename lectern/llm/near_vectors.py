"""Near-duplicate embeddings by product quantisation, within each label.

Equal vectors are counted as one with a weight. Vectors of a label go to the inverted list of their nearest
coarse centroid; the residual is coded per subspace against small codebooks, and its quantisation error is
kept. A vector probes every list that can hold a neighbour within the distance r that the cosine bound means
for unit vectors: y lies in the list of c only if x is at most r from the plane between its own centroid and
c. In a probed list the asymmetric distance to a code, looked up
in per-subspace tables, can be under the true one by the code's error at most, so no neighbour is passed over;
what is left is settled by exact cosines in double precision.

A list is compared in cells of bounded size. Counts per vector and a spanning forest of links leave a task,
never all pairs of a group.

Centroids and codebooks are fitted on a bounded, deterministic sample (SAMPLE); every vector is indexed.

Defined results: vectors that are null, of norm zero, or hold a null or non-finite component, and rows with a
null label or vec_id, link with nothing; vectors of different lengths link with nothing of another length; repeated rows
(one vec_id twice with one vector) count as other vectors; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COSINE = 0.93
#: Vectors that codebooks are fitted on, vectors a list should hold, and most lists of a label.
SAMPLE, LIST_SIZE, MOST_LISTS = 16_384, 512, 1024
#: Subspaces and codewords of each; rows of a block.
SUBSPACES, CODEWORDS, BLOCK = 16, 64, 2048


def kmeans(points, k: int, rounds: int = 12, seed: int = 7):
    """At most ``k`` centroids of ``points`` by Lloyd's steps from a seeded choice of distinct rows."""
    import numpy as np

    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = points[np.sort(np.random.default_rng(seed).choice(len(points), k, replace=False))]
    for _ in range(rounds):
        near = nearest(points, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points, centres):
    import numpy as np

    out = np.empty(len(points), np.int64)
    half = (centres**2).sum(1) / 2
    for i in range(0, len(points), 4096):
        out[i : i + 4096] = np.argmax(points[i : i + 4096] @ centres.T - half, 1)
    return out


class Quantizer:
    """Coarse centroids of each (label, dimension), and residual codebooks of each dimension."""

    def __init__(self, coarse: dict, books: dict, subspaces: int = SUBSPACES):
        self.coarse, self.books, self.subspaces = coarse, books, subspaces

    @classmethod
    def fit(cls, rows: list[tuple], counts: dict, list_size: int = LIST_SIZE) -> Quantizer:
        """rows: (label, unit vector); counts: vectors of each (label, dimension)."""
        import numpy as np

        by: dict = {}
        for label, vector in rows:
            by.setdefault((label, len(vector)), []).append(vector)
        coarse, rests = {}, {}
        for key, vectors in sorted(by.items()):
            points = np.array(vectors)
            lists = min(MOST_LISTS, max(1, counts.get(key, 0) // list_size), max(1, len(points) // 4))
            coarse[key] = kmeans(points, lists)
            rests.setdefault(key[1], []).append(points - coarse[key][nearest(points, coarse[key])])
        books = {}
        for size, parts in rests.items():
            cuts = np.array_split(np.arange(size), min(SUBSPACES, size))
            books[size] = [kmeans(np.concatenate(parts)[:, c], CODEWORDS) for c in cuts]
        return cls(coarse, books)

    def cuts(self, size: int):
        import numpy as np

        return np.array_split(np.arange(size), min(self.subspaces, size))

    def centres(self, label, size: int):
        """A label that the sample has not met has one list around the origin."""
        import numpy as np

        return self.coarse.get((label, size), np.zeros((1, size)))

    def codebooks(self, size: int) -> list:
        import numpy as np

        return self.books.get(size) or [np.zeros((1, len(c))) for c in self.cuts(size)]

    def encode(self, rests, size: int):
        """(codes, error): the codewords of each residual, and how far it is from them."""
        import numpy as np

        books = self.codebooks(size)
        codes = np.empty((len(rests), len(books)), np.uint8)
        left = np.zeros(len(rests))
        for j, (c, book) in enumerate(zip(self.cuts(size), books)):
            codes[:, j] = nearest(rests[:, c], book)
            left += ((rests[:, c] - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def probes(self, x, label, r: float):
        """(vector, list) numbers of all lists that can hold a vector within ``r`` of a row of ``x``, and the home lists."""
        import numpy as np

        centres = self.centres(label, x.shape[1])
        squares = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))
        home = np.argmin(squares, 1)
        between = np.sqrt(np.maximum(0, ((centres[:, None, :] - centres[None]) ** 2).sum(2) if len(centres) <= 64 else (centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres @ centres.T))
        gap = squares - squares[np.arange(len(x)), home][:, None]
        return np.nonzero(gap <= 2 * (r + 1e-9) * between[home] + 1e-9), home


def radius(cosine: float) -> float:
    return (2 - 2 * cosine) ** 0.5


def usable():
    """Whether a vector takes part: finite components, not all zero, and a label."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def as_doubles():
    return F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(rep, label, vector array<double>, n): equal vectors of a label as one, named by the smallest vec_id.

    Equality is that of the components as doubles, 0.0 and -0.0 being one; a hot vector is combined before the shuffle.
    """
    return rows.where(usable()).select("vec_id", "label", as_doubles().alias("vector")).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


def _unit(vectors):
    import numpy as np

    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(1))[:, None]


def routed(vectors: DataFrame, quantizer: Quantizer, cosine: float = COSINE) -> DataFrame:
    """(label, size, list, own, rep, n, unit): each vector in its home list (own) and in the others that it probes."""
    import pyarrow as pa

    r = radius(cosine)

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            reps, labels, found, weights = (batch.column(k).to_pylist() for k in range(4))
            groups: dict = {}
            for i, (label, vector) in enumerate(zip(labels, found)):
                groups.setdefault((label, len(vector)), []).append(i)
            for (label, size), at in groups.items():
                for i in range(0, len(at), 1024):
                    some = at[i : i + 1024]
                    x = _unit([found[k] for k in some])
                    (row, where), home = quantizer.probes(x, label, r)
                    raw = [v.tobytes() for v in x]
                    rows = [(label, size, int(home[k]), True, reps[some[k]], weights[some[k]], raw[k]) for k in range(len(some))]
                    rows += [(label, size, int(c), False, reps[some[k]], weights[some[k]], raw[k]) for k, c in zip(row, where) if c != home[k]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["label", "size", "list", "own", "rep", "n", "unit"])

    vectors = vectors.select("rep", F.col("label").cast("long").alias("label"), "vector", "n")
    return vectors.mapInArrow(run, "label long, size int, list int, own boolean, rep long, n long, unit binary")


def blocked(rows: DataFrame) -> DataFrame:
    """Deal the rows of each list into cells (block, turn): a cell has BLOCK of the list's vectors and 8 BLOCK probing ones, about.

    Every pair of a list's vector and a probing one meets in one cell, so lists of any size are compared in
    bounded cells and in as many tasks.
    """
    at = ["label", "size", "list"]
    sizes = rows.groupBy(*at).agg(F.ceil(F.count(F.when(F.col("own"), 1)) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("turns")).where("blocks > 0")
    rows = rows.join(sizes, at)
    rows = rows.withColumns({"home": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "turn": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("turns")).cast("int")})
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asks = F.transform(steps("blocks"), lambda b: F.struct(b.alias("block"), F.col("turn").alias("turn"), F.lit(True).alias("asks"), F.lit(False).alias("holds")))
    held = F.transform(steps("turns"), lambda t: F.struct(F.col("home").alias("block"), t.alias("turn"), F.lit(False).alias("asks"), F.lit(True).alias("holds")))
    cells = rows.select(*at, "rep", "n", "unit", F.explode(F.when(F.col("own"), F.concat(asks, held)).otherwise(asks)).alias("cell"))
    return cells.select(*at, "rep", "n", "unit", "cell.*")


def compare(cells: DataFrame, quantizer: Quantizer, cosine: float = COSINE) -> DataFrame:
    """(rep, others, a, b): how many vectors a rep is linked with in a cell, or (others 0) a link of the spanning forest."""
    import numpy as np
    import pandas as pd

    r = radius(cosine)

    def run(key, frame):
        label, size, number = key[:3]
        frame = frame.sort_values("rep", kind="stable")
        own, asking = frame[frame["holds"]], frame[frame["asks"]]
        reps, others, forest = [], [], []
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(own) and len(asking):
            unit = lambda f: np.frombuffer(b"".join(f["unit"]), np.float64).reshape(len(f), size)
            y, y_reps, y_n = unit(own), own["rep"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
            centre = quantizer.centres(label, size)[number]
            codes, error = quantizer.encode(y - centre, size)
            books, cuts = quantizer.codebooks(size), quantizer.cuts(size)
            for i in range(0, len(asking), 256):
                some = asking.iloc[i : i + 256]
                x, x_reps = unit(some), some["rep"].to_numpy(np.int64)
                rest = x - centre
                distance = np.zeros((len(x), len(y)))
                for j, (c, book) in enumerate(zip(cuts, books)):
                    distance += ((rest[:, c][:, None, :] - book[None]) ** 2).sum(2)[:, codes[:, j]]
                near_x, near_y = np.nonzero(np.sqrt(distance) <= r + error[None, :] + 1e-6)
                found = np.zeros(len(x), np.int64)
                for k in range(0, len(near_x), 65536):
                    p, q = near_x[k : k + 65536], near_y[k : k + 65536]
                    good = ((x[p] * y[q]).sum(1) >= cosine) & (x_reps[p] != y_reps[q])
                    p, q = p[good], q[good]
                    np.add.at(found, p, y_n[q])
                    for a, b in zip(x_reps[p].tolist(), y_reps[q].tolist()):
                        u, v = find(a), find(b)
                        if u != v:
                            parent[max(u, v)] = min(u, v)
                            forest.append((max(a, b), min(a, b)))
                reps += x_reps[found > 0].tolist()
                others += found[found > 0].tolist()
        none = [None] * len(forest)
        return pd.DataFrame({"rep": pd.array(reps + none, "Int64"), "others": pd.array(others + [0] * len(forest), "Int64"), "a": pd.array([None] * len(reps) + [x[0] for x in forest], "Int64"), "b": pd.array([None] * len(reps) + [x[1] for x in forest], "Int64")})

    return cells.groupBy("label", "size", "list", "block", "turn").applyInPandas(run, "rep long, others long, a long, b long")


def fitted(vectors: DataFrame, sample: int = SAMPLE) -> Quantizer:
    """A quantizer fitted on the ``sample`` distinct vectors with the smallest hashes, with lists by all vectors' counts."""
    spark = vectors.sparkSession
    held = vectors.orderBy(F.xxhash64("rep", "label"), "rep").limit(sample).select("label", "vector").collect()
    if not held:
        return Quantizer({}, {})
    labels = spark.createDataFrame([(x,) for x in sorted({int(r.label) for r in held})], "label long")
    counts = vectors.groupBy(F.col("label").cast("long").alias("label"), F.size("vector").alias("size")).count().join(F.broadcast(labels), "label").collect()
    units = [(int(r.label), _unit([r.vector])[0]) for r in held]
    return Quantizer.fit(units, {(r.label, r["size"]): r["count"] for r in counts})


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, label)."""
    from .common import components, save

    good = rows.select("vec_id", "label", "embedding", usable().alias("good"), F.when(usable(), as_doubles()).alias("vector"))
    vectors = save(distinct_vectors(rows), "vectors")
    quantizer = fitted(vectors)
    found = save(compare(blocked(save(routed(vectors, quantizer, cosine), "routed")), quantizer, cosine), "links")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("others").alias("others"))
    roots = components(found.where("a is not null").select("a", "b"))
    of = vectors.join(counts, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    of = of.select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("root"))
    joined = good.where("good").join(of, ["label", "vector"]).select("vec_id", "n_links", F.col("root").alias("component_id"))
    lone = good.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embeddings(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (
  SELECT vec_id, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM r JOIN l ON r.vec_id = l.a
)
SELECT x.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, x.vec_id = c AS kept
FROM embeddings x
JOIN (SELECT vec_id, min(root) AS c FROM r GROUP BY vec_id) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
