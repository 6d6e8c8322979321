"""Whitening of embeddings: covariance over distinct vectors, weighted by multiplicity.

Vectors are brought to whole numbers, x = floor(256 c), and equal ones become one row with
its number of copies. Copies are combined before the shuffle, so a vector that a third of
the rows share costs no more than another. The covariance is a matrix product of centred
vectors times weights, summed per task and then per matrix row: d rows of d numbers reach
the driver, whose size the embeddings' dimension sets. Every distinct vector is whitened
once and joined back; the few that very many rows share are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from solvenza.llm.common import map_rows, unused, written

GRID = 256
COMPONENTS = 4
COMMON = 512                # a vector of over one in so many rows is joined by broadcast
_LIMIT = float(1 << 63)


# --- vectors ----------------------------------------------------------------------

def on_grid(vector: Column) -> Column:
    """floor(GRID c) of every entry; NULL for vectors with entries that are no numbers."""
    whole = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    number = lambda c: F.floor(F.least(F.greatest(
        c.cast("double") * GRID, F.lit(-_LIMIT)), F.lit(np.nextafter(_LIMIT, 0)))).cast("bigint")
    return F.when(whole, F.transform(vector, number))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x, copies, d): every distinct vector once."""
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(d, positions, x, weights) of the vectors of each dimension in a batch (x, d, weight)."""
    vectors, dims, weights = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        flat = vectors.take(pa.array(at)).flatten().to_numpy()
        yield int(d), at, flat.reshape(len(at), d), weights[at]


def _summed(partial: DataFrame) -> DataFrame:
    """Arrays (d, i, values) added up per (d, i); one fixed-size sum is held for each."""
    def rows(batches: Iterator[list[list]]) -> Iterator[tuple]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for d, i, values in zip(*batch):
                sums[d, i] = sums[d, i] + values if (d, i) in sums else np.array(values)
        yield from ((d, i, s.tolist()) for (d, i), s in sums.items())

    return map_rows(partial.repartition("d", "i").sortWithinPartitions("d", "i"), partial.schema, rows)


# --- fit --------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Fit of one dimension: the exact sums, and as rows the components by eigenvalue."""
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])    # rounded once, from whole numbers

    @property
    def usable(self) -> np.ndarray:
        """Components with a spread that rounding does not explain."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0)


def _totals(vectors: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Weight and exact sums per dimension d."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for d, _, x, w in _matrices(batch):
                for i, total in enumerate(_weighted_sums(x, w)):
                    yield d, i, int(w.sum()), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for d, i, n, total in rows(batches):
            held = sums.setdefault((d, i), [0, 0])
            held[0] += n
            held[1] += total
        if sums:
            yield pa.RecordBatch.from_pylist([
                {"d": d, "i": i, "n": n, "high": t >> 40, "low": t & (1 << 40) - 1}
                for (d, i), (n, t) in sums.items()
            ], schema=pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))

    parts = vectors.mapInArrow(run, "d int, i int, n bigint, high bigint, low bigint")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found: dict[int, list] = {}
    for r in parts.groupBy("d", "i").agg(exact("n"), exact("high"), exact("low")).orderBy("d", "i").toLocalIterator():
        found.setdefault(r.d, []).append((int(r.n), (int(r.high) << 40) + int(r.low)))
    return {d: (rows[0][0], tuple(s for _, s in rows)) for d, rows in found.items()}


def _weighted_sums(x: np.ndarray, weights: np.ndarray) -> list[int]:
    """Exact sum of weights times x for each column: whole numbers of 64 bits in parts, so
    that no sum of a batch leaves 64 bits."""
    sums = [0] * x.shape[1]
    for up in (0, 16):
        half = (weights >> up & 0xFFFF if up == 0 else weights >> up)[:, None]
        for shift in (0, 20, 40):
            part = x >> shift if shift == 40 else x >> shift & (1 << 20) - 1
            sums = [s + (t << up + shift) for s, t in zip(sums, (half * part).sum(axis=0).tolist())]
    return sums


def _covariances(vectors: DataFrame, totals: dict[int, tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x, w in _matrices(batch):
                centred = x - means[d]
                product = (centred * w[:, None]).T @ centred
                products[d] = products[d] + product if d in products else product
        for d, product in products.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()),
                pa.array(product.tolist(), pa.list_(pa.float64())),
            ], names=["d", "i", "values"])

    parts = vectors.mapInArrow(run, "d int, i int, values array<double>")
    found = {d: np.zeros((d, d)) for d in totals}
    for r in _summed(parts).toLocalIterator():
        found[r.d][r.i] = r["values"]
    return {d: m / totals[d][0] for d, m in found.items()}


def fit(distinct: DataFrame, components: int = COMPONENTS, counts: bool = False) -> dict[int, Model]:
    """A model for each dimension of the (x, copies, d) rows. Each distinct vector weighs
    one, or with ``counts`` its number of copies."""
    weight = F.col("copies") if counts else F.lit(1).cast("bigint")
    vectors = distinct.filter("d > 0").select("x", "d", weight.alias("w"))
    totals = _totals(vectors)
    models = {}
    for d, cov in _covariances(vectors, totals).items():
        values, axes = np.linalg.eigh((cov + cov.T) / 2)
        first = np.argsort(-values, kind="stable")[:components]
        n, sums = totals[d]
        models[d] = Model(n, sums, axes[:, first].T, np.maximum(values[first], 0), float(np.trace(cov)))
    return models


# --- whitening --------------------------------------------------------------------

def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Exact sum of (n x - S)^2; None where it leaves 64 bits."""
    n, most = model.n, int(max(x.max(), -x.min(), 1)) if x.size else 1
    largest = n * most + max(map(abs, model.sums), default=0)
    if largest * largest * max(1, len(model.sums)) < 1 << 63:
        apart = n * x - np.array(model.sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, model.sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened_vectors(distinct: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(x, copies, d, deviation, whitened): every distinct vector once; NULL stands for
    components without spread."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            deviation, values = [None] * len(dims), [[] for _ in dims]
            for d, at, x, _ in _matrices(batch.select([0, 2, 1])):
                model = models.get(d)
                if model is None:
                    continue
                scale = np.sqrt(np.where(model.usable, model.values, 1))
                projected = (x - model.mean) @ model.axes.T / scale
                for k, n, row in zip(at.tolist(), _deviations(x, model), projected.tolist()):
                    deviation[k] = n
                    values[k] = [v if ok else None for v, ok in zip(row, model.usable)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(deviation, pa.int64()), pa.array(values, pa.list_(pa.float64()))],
                names=["x", "copies", "d", "deviation", "whitened"])

    return distinct.select("x", "copies", "d").mapInArrow(
        run, "x array<bigint>, copies bigint, d int, deviation bigint, whitened array<double>")


def identity_errors(whitened: DataFrame, models: dict[int, Model], counts: bool = False) -> dict[int, float | None]:
    """Per dimension the largest entry of the whitened vectors' covariance minus identity."""
    most = max((len(m.values) for m in models.values()), default=0)
    if not most:
        return {}
    w = F.col("copies") if counts else F.lit(1)
    each = [F.get("whitened", F.lit(k)) for k in range(most)]
    mean = whitened.groupBy("d").agg(*[
        (F.sum(w * c) / F.sum(F.when(c.isNotNull(), w))).alias(f"m{k}") for k, c in enumerate(each)])
    pairs = [(a, b) for a in range(most) for b in range(a, most)]
    centred = [c - F.col(f"m{k}") for k, c in enumerate(each)]
    entries = [(F.sum(w * centred[a] * centred[b]) / F.sum(w)).alias(f"c{a}_{b}") for a, b in pairs]
    out: dict[int, float | None] = {}
    for r in whitened.filter("d > 0").join(F.broadcast(mean), "d").groupBy("d").agg(*entries).toLocalIterator():
        apart = [abs(v - (a == b)) for a, b in pairs if (v := r[f"c{a}_{b}"]) is not None]
        out[r.d] = max(apart, default=None)
    return out


def whitened(
    embeddings: DataFrame, components: int = COMPONENTS, counts: bool = False, vector: str = "embedding"
) -> DataFrame:
    """The rows and columns of ``embeddings`` that hold numbers only, for each component
    up to ``components``, with ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    The fit is over the distinct vectors x = floor(256 c), each with weight one, or with
    ``counts`` its number of rows; n is the sum of weights. Components are unit
    eigenvectors of the covariance, by falling eigenvalue e; ``whitened`` is the centred
    vector's projection over sqrt(e), ``explained`` e over the trace, ``deviation`` the sum
    of (n x - S)^2. Equal eigenvalues come in any order, the same for all rows.

    Vectors that are NULL or hold NULL or non-finite entries have no rows, nor have empty
    ones. Vectors of different dimensions are fitted apart. Entries beyond 64 bits on the
    grid become the nearest number that fits; a ``deviation`` beyond 64 bits is NULL.
    Components without spread, as with one distinct vector, have whitened NULL and
    explained 0, and do not count in ``identity_error``, which is NULL if there are no
    others. Rows that repeat are returned as often. An empty table gives an empty result.
    Columns of the same names are replaced, others pass through.
    """
    results = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    names = [c for c in embeddings.columns if c.lower() not in results]
    own = unused(embeddings, "_x")
    rows = embeddings.select(*names, on_grid(F.col(vector)).alias(own)).filter(F.col(own).isNotNull())

    distinct = written(distinct_vectors(rows.select(F.col(own).alias("x"))), "white-distinct")
    models = fit(distinct, components, counts)
    each = written(whitened_vectors(distinct, models), "white-vectors")
    errors = identity_errors(each, models, counts)

    result = unused(embeddings, "_result")
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()
    values = each.select(F.col("x").alias(f"{own}_to"), "copies", F.struct("d", "deviation", "whitened").alias(result))
    # At most COMMON vectors can hold more than one in COMMON rows each.
    common = F.broadcast(values.filter(F.col("copies") * COMMON > total).drop("copies"))
    rare = values.filter(F.col("copies") * COMMON <= total).drop("copies")
    same = F.col(own) == F.col(f"{own}_to")
    joined = rows.join(common, same).unionByName(rows.join(common, same, "left_anti").join(rare, same))
    return _with_models(joined.select(*names, result), names, result, models, errors)


def _with_models(
    joined: DataFrame, names: list[str], result: str, models: dict[int, Model], errors: dict[int, float | None]
) -> DataFrame:
    spark = joined.sparkSession
    fitted = [(
        d, m.n, [float(v / m.trace) if ok else 0.0 for v, ok in zip(m.values, m.usable)], errors.get(d),
    ) for d, m in models.items()]
    # One row for each dimension that vectors have.
    of = spark.createDataFrame(fitted, "_d int, _n bigint, _explained array<double>, _error double")
    of = of.select(F.struct(*of.columns).alias(f"{result}_of"))
    joined = joined.join(F.broadcast(of), F.col(f"{result}.d") == F.col(f"{result}_of._d"))
    k = F.posexplode(f"{result}.whitened").alias(f"{result}_k", f"{result}_w")
    joined = joined.select(*names, result, f"{result}_of", k)
    at = F.col(f"{result}_k")
    return joined.select(
        *names, (at + 1).cast("int").alias("component"), F.col(f"{result}_of._n").alias("n"),
        F.col(f"{result}.deviation").alias("deviation"), F.col(f"{result}_w").alias("whitened"),
        F.get(F.col(f"{result}_of._explained"), at).alias("explained"),
        F.col(f"{result}_of._error").alias("identity_error"),
    )
