"""Whitening of embeddings: randomised range finder, power passes over all rows, Rayleigh-Ritz.

Entries become whole numbers first (floor(64 c) + 1000000), so sums and deviations are exact. The fit list holds every
distinct vector once. A random block Q of ``most`` + OVERSAMPLE columns is multiplied by the covariance V in
repeated passes over all centred rows of the fit list; V itself is never formed for it. Each pass also gives the
Rayleigh-Ritz pairs of the block that went in, and their residuals |V u - e u|. Where these are not down to TOLERANCE
of the largest eigenvalue after POWER passes, the block is expanded to the full dimension, and one pass gives the
pairs to rounding. A last pass over the fit list measures the covariance of the whitened values.

Per task a pass leaves one matrix of (dimension x columns) partial sums, added up by Spark; the driver holds matrices of
(dimension x columns), never rows. Duplicates fall together before the shuffle, so a frequent vector is no hot key.

Defined results: rows are dropped whose vector is null or holds a null, a non-finite or an entry beyond 2^56 (whose whole
number would not fit); vectors of each length are a table of their own, with its own fit; there are as many components
as the dimension has, ``most`` at most, and directions without variance (under RANK of the largest eigenvalue: vectors
all equal, or fewer distinct ones than dimensions) give none, so an empty table, vectors of length 0 and a single distinct vector give no rows;
equal eigenvalues may take any basis of their space; a deviation that does not fit in 64 bits is null; a null id stays null;
repeated rows give repeated rows and count once in the fit; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST, OVERSAMPLE, POWER, SEED = 16, 10, 3, 11
#: Residual of a pair and least eigenvalue of a component, both as a share of the largest eigenvalue.
TOLERANCE, RANK = 1e-13, 1e-12
SCALE, SHIFT = 64, 1_000_000


def usable(vector: str) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= F.lit(2.0**56)))
    return F.coalesce(ok, F.lit(False))


def whole(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))


def _matrix(column):
    """The vectors of an Arrow list column, all of one length, as an array of 64-bit integers."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.int64).reshape(len(column), -1)


def centred(x, n: int, sums: list[int]):
    """x - S/n in double precision: the difference n x - S is exact, whatever its size, and divided once."""
    import numpy as np

    return _difference(x, n, sums).astype(np.float64) / n


def _difference(x, n: int, sums: list[int]):
    """n x - S exactly: 64-bit where it fits, else Python's integers."""
    import numpy as np

    if max(n * int(abs(x).max(initial=0)), *map(abs, sums)) < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, exact sum of each dimension) of the fit list (x)."""
    import pyarrow as pa

    def run(batches):
        from decimal import Decimal

        import numpy as np

        n, total = 0, None
        for b in batches:
            if len(b):
                x = _matrix(b.column(0))
                high, low = x >> 20, x & 0xFFFFF  # halves, so that 64-bit sums of a batch cannot overflow
                part = high.sum(0).astype(object) * 2**20 + low.sum(0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if n:
            out = [n, *total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)) - 1, pa.int64()), pa.array([Decimal(int(v)) for v in out], pa.decimal128(38, 0))], names=["i", "v"])

    found = dict(fit.select("x").mapInArrow(run, "i long, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)")).collect())
    return int(found.pop(-1, 0)), [int(found[i]) for i in range(len(found))]


def _added(fit: DataFrame, part, shape: tuple[int, int]):
    """The sum over all batches of the matrices (``shape``) that ``part`` makes of a batch's vectors."""
    import numpy as np
    import pyarrow as pa

    rows, columns = shape

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += part(_matrix(b.column(0)))
        at = np.arange(rows * columns)
        for k in range(0, len(at), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 65536]), pa.array(total.ravel()[k : k + 65536])], names=["i", "v"])

    out = np.zeros(rows * columns)
    for i, v in fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out.reshape(shape)


def pairs(fit: DataFrame, n: int, total: list[int], most: int = MOST, oversample: int = OVERSAMPLE, power: int = POWER, tolerance: float = TOLERANCE):
    """(eigenvalues, components as columns, trace of V, columns of the last block): the ``most`` leading pairs of V."""
    import numpy as np

    size = len(total)

    def times(q):
        """V q and the trace of V, by one pass over the fit list."""
        def part(x):
            c = centred(x, n, total)
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), (c * c).sum())])

        out = _added(fit, part, (size + 1, q.shape[1])) / n
        return out[:-1], out[-1, 0]

    random = np.random.default_rng(SEED)
    width, passes = min(size, most + oversample), 0
    q = np.linalg.qr(random.standard_normal((size, width)))[0]
    while True:
        image, trace = times(q)
        passes += 1
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
        components = q @ turn
        left = np.linalg.norm(image @ turn - components * values, axis=0).max(initial=0)
        if width == size or left <= tolerance * max(values[0], 0):
            return values, components, trace, width
        if passes < power + 1:
            q = np.linalg.qr(image)[0]
        else:
            width = size
            q = np.linalg.qr(np.hstack([components, random.standard_normal((size, size - components.shape[1]))]))[0]


class Model:
    """What whitens vectors of one length: n, sums, eigenvalues, components as columns, share of the trace, identity_error."""

    def __init__(self, n: int, total: list[int], values, components, trace: float):
        good = values > RANK * max(values[0], 0) if len(values) else values > 0
        self.n, self.total, self.values, self.components = n, total, values[good], components[:, good]
        self.explained = self.values / trace if len(self.values) else self.values
        self.error = 0.0

    def whiten(self, x):
        import numpy as np

        return centred(x, self.n, self.total) @ self.components / np.sqrt(self.values)

    def deviations(self, x) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2 of each row."""
        d = _difference(x, self.n, self.total)
        if d.dtype == object or d.shape[1] * float(abs(d).max(initial=0)) ** 2 >= 2.0**62:
            return [v if v < 2**63 else None for v in map(int, (d.astype(object) ** 2).sum(1))]
        return (d * d).sum(1).tolist()


def fit_model(fit: DataFrame, **settings) -> Model | None:
    """The model of the fit list (x), vectors of one length that are distinct; None if it has no vectors."""
    import numpy as np

    n, total = sums(fit)
    if not n or not total:
        return None
    values, components, trace, _ = pairs(fit, n, total, **settings)
    model = Model(n, total, values, components, trace)
    k = len(model.values)
    if k:
        def part(x):
            w = model.whiten(x)
            return np.vstack([w.T @ w, w.sum(0)])

        moments = _added(fit, part, (k + 1, k)) / n
        model.error = float(abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(k)).max())
    return model


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row per vector and component."""
    import pyarrow as pa

    spark = rows.sparkSession
    common.ship(spark)
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = rows.where(usable(vector)).select(key, whole(vector).alias("x"))
    fit = common.save(kept.select("x").distinct(), "fit_list")
    out = spark.createDataFrame([], schema)
    for (size,) in sorted(fit.select(F.size("x")).distinct().collect()):  # lengths of vectors, one as a rule
        model = fit_model(fit.where(F.size("x") == size), **settings)
        if model is None or not len(model.values):
            continue

        def run(batches, model=model):
            import numpy as np

            k = len(model.values)
            for b in batches:
                if not len(b):
                    continue
                x = _matrix(b.column(1))
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), model.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        out = out.unionByName(kept.where(F.size("x") == size).select(key, "x").mapInArrow(run, schema))
    return out


def op11_whitening(spark, sf_dir):
    return whitened(common.table(spark, sf_dir, "embeddings"))
