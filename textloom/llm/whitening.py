"""PCA whitening of embeddings by MLlib's computeSVD on centred distributed rows.

Entries become integers, so that sums are exact: rows are centred as n * x - S, and the total variance
is the sum of these integers' squares, apart from the decomposition. computeSVD of the centred rows
gives the components; a squared singular value over the number of rows is a component's variance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

#: Entries beyond it take no part, like those that aren't finite: their integers would leave 63 bits.
LARGEST = float(2**40)
#: Of the largest variance: products of doubles don't tell less from zero.
NOTHING = 1e-12


@dataclass
class Whitening:
    """What ``fit`` has learnt: rows, sums of the integers, components as columns, their variances."""

    n: int
    sums: list[int]
    components: object
    variances: object


def _finite(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.coalesce(F.forall(vector, good), F.lit(False)))


def _matrix(np, column: pa.Array, scale: int, shift: int):
    """floor(scale * c) + shift of a batch's vectors, as an integer matrix."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(scale * c).astype(np.int64) + shift).reshape(len(column), -1)


def _centred(np, x, n: int, sums):
    """n * x - S without overflow: machine integers where they hold it, else Python's."""
    big = n * max(int(np.abs(x).max()), 1) + max(map(abs, sums), default=0) >= 2**62
    return (x.astype(object) if big else x) * n - np.array(sums, object if big else np.int64)


def _squares(np, d) -> list[int]:
    """The exact sum of the squares of each row."""
    if d.dtype != object and int(np.abs(d).max()) ** 2 * d.shape[1] >= 2**63:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(1)]


def sums_of(df: DataFrame, vector: str, scale: int, shift: int) -> tuple[int, list[int]]:
    """(n, S): rows and sums by dimension, each task's partial sums added up in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n, total = 0, None
        for b in batches:
            if b.num_rows:
                own = _matrix(np, b.column(0), scale, shift).sum(0).astype(object)
                n, total = n + b.num_rows, own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.decimal128(38, 0))], ["n", "i", "s"])

    rows = df.select(vector).mapInArrow(partial, "n long, i int, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0].n if rows else 0), [int(r.s) for r in rows]


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> Whitening:
    """The whitening of all vectors of one length, none of them null or not finite.

    The rows are centred by the exact sums before anything is multiplied. All components are asked of
    computeSVD, which then decomposes a matrix of the dimensions' size with LAPACK, to double precision;
    that matrix (dimensions squared, at most 15,000 of them) is all that the driver holds. Components
    whose variance is below ``NOTHING`` of the largest are rounding and left out. Each component's largest
    entry is positive.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    n, sums = sums_of(vectors, vector, scale, shift)
    if not n:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            if b.num_rows:
                d = _centred(np, _matrix(np, b.column(0), scale, shift), n, sums)
                flat = pa.array((d.astype(np.float64) / n).reshape(-1), pa.float64())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([rows], ["row"])

    centred = vectors.select(vector).mapInArrow(centre, "row array<double>")
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("row").alias("row")), "row")
    found = RowMatrix(rows, n, len(sums)).computeSVD(len(sums), False)
    components, variances = found.V.toArray(), found.s.toArray() ** 2 / n
    some = variances > NOTHING * variances[0]
    components, variances = components[:, some], variances[some]
    signs = np.sign(components[np.abs(components).argmax(0), np.arange(components.shape[1])])
    return Whitening(n, sums, components * signs, variances)


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(key, n, deviation, whitened array, explained array, identity_error) for every row that takes part.

    Rows whose vector is null or empty, or holds a null, a NaN, an infinity or an entry beyond ``LARGEST``
    take no part; where lengths differ, vectors of the commonest length do (of ties, the largest). An entry
    c counts as floor(scale * c) + shift. deviation, decimal: the exact sum over dimensions of (n * x - S)^2.
    whitened: the centred row projected on the first ``components`` components, each over the root of its
    variance; fewer where the vectors span fewer dimensions, none where all are equal. explained: the
    components' shares of the total variance. identity_error: the largest entry of the covariance of
    whitened less the identity, null without components.

    A null key stays; repeated rows count and are returned each. Empty input: no rows. Other columns are ignored.
    """
    import numpy as np

    spark = df.sparkSession
    rows = _finite(df.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")), "_vector")
    longest = rows.groupBy(F.size("_vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("_vector") == (longest.d if longest else 0))
    model = fit(rows, "_vector", scale, shift)
    k = min(components, len(model.variances))
    n, sums = model.n, model.sums
    basis = np.asarray(model.components)[:, :k] / np.sqrt(np.asarray(model.variances)[:k])
    shared = spark.sparkContext.broadcast(basis.reshape(-1).tolist())  # dimensions x components numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        flat = np.array(shared.value, float)
        for b in batches:
            if b.num_rows:
                d = _centred(np, _matrix(np, b.column(1), scale, shift), n, sums)
                w = (d.astype(np.float64) / n) @ flat.reshape(d.shape[1], k)
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.reshape(-1), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_squares(np, d), pa.decimal128(38, 0)), out], ["_key", "deviation", "whitened"])

    kind = df.schema[key].dataType.simpleString()
    out = Stage(spark, "whitening").put(rows.select("_key", "_vector").mapInArrow(project, f"_key {kind}, deviation decimal(38,0), whitened array<double>"))
    w = [F.col("whitened")[i] for i in range(k)]
    wrong = [F.abs(F.covar_pop(w[i], w[j]) - float(i == j)) for i in range(k) for j in range(i + 1)]
    squares, error = out.agg(F.sum("deviation"), F.array_max(F.array(*wrong)) if wrong else F.lit(None).cast("double")).first()
    shares = F.array(*[F.lit(float(e) * n**3 / int(squares)) for e in model.variances[:k]]) if k else F.expr("cast(array() as array<double>)")
    return out.select(F.col("_key").alias(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
