"""Whitening of embeddings by shifted CholeskyQR.

Rows become whole numbers, and each distinct row counts once. The centred rows A (whole numbers over n, so that nothing is lost
where a large offset goes) are orthogonalised without ever being moved: a pass over them sums the Gram matrix of A R^-1, a few
numbers a task; its Cholesky factor, shifted in the first pass so that it exists however ill-conditioned A is, is composed with R;
and the next pass solves with the new R. When the Gram matrix is the identity, A = QR, and the singular values and right vectors
of the small matrix R are those of A. Squaring happens only to what is nearly orthogonal already, so that small eigenvalues keep
their digits, unlike those of a covariance matrix summed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, narrow, ship, stage, table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Passes that end the orthogonalisation at the latest; two follow the shifted one where A has full rank.
PASSES = 6
#: Entries are held within what doubles count exactly.
LARGEST = 1 << 53
#: Singular values below this share of the largest are taken for zero.
RANK = 1e-10
#: Rows that a task handles at once, and partial matrices that are added up in one group.
ROWS = 4096
FAN = 64


def grid(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000 of every entry, as longs."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, equal for equal rows: two bytes an entry where all entries lie near the offset, else eight."""
    near = x - OFFSET
    small = (np.abs(near) < 1 << 15).all(axis=1)
    two, eight = near.astype("<i2"), x.astype("<i8")
    return [b"\x02" + two[k].tobytes() if small[k] else b"\x08" + eight[k].tobytes() for k in range(len(x))]


def _unpacked(rows: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(rows), size), np.int64)
    for k, row in enumerate(rows):
        out[k] = np.frombuffer(row, "<i2", offset=1).astype(np.int64) + OFFSET if row[:1] == b"\x02" else np.frombuffer(row, "<i8", offset=1)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding: rows whose vector is not null, not empty, has no null or non-finite entry, and has the usual length."""
    given = narrow(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = given.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    lengths = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return good.where(F.size("embedding") == (lengths[0]["d"] if lengths else 0))


@dataclass
class Whitening:
    """n distinct rows of `sums`; components (columns) and eigenvalues of their covariance, its trace, and the identity error."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: longs hold it for n times the spread below 2**63."""
        return self.n * (x - self.sums // self.n) - self.sums % self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x) / self.n @ self.components / np.sqrt(self.values)


def _total(df: DataFrame, run, kind: str, size: int) -> np.ndarray:
    """The sum of the arrays (index, values) that the tasks of run yield, by way of groups of a bounded number of partial sums."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        rows = sum(np.stack([np.asarray(v) for v in part["values"].iloc[k : k + FAN]]).sum(axis=0) for k in range(0, len(part), FAN))
        return pd.DataFrame({"index": [part["index"].iloc[0]], "values": [rows]})

    columns = f"index int, values array<{kind}>"
    made = df.mapInPandas(run, columns + ", lot int")
    some = made.groupBy("index", "lot").applyInPandas(lambda p: add(p), columns)
    rows = some.groupBy("index").applyInPandas(lambda p: add(p), columns).collect()
    out = np.zeros((max((r["index"] for r in rows), default=-1) + 1, size), np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["index"]] = r["values"]
    return out


def _partial(made: np.ndarray) -> pd.DataFrame:
    """A task's sums, a row of the matrix each; lots spread what will be added up."""
    from pyspark import TaskContext

    lot = TaskContext.get().partitionId() // FAN
    return pd.DataFrame({"index": np.arange(len(made), dtype=np.int32), "values": list(made), "lot": np.full(len(made), lot, np.int32)})


def _gram(fit: DataFrame, size: int, of) -> tuple[np.ndarray, np.ndarray]:
    """YᵀY and the sums of Y, the rows of which are of(x) for the distinct rows x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                y = of(_unpacked(batch["x"].iloc[at : at + ROWS].tolist(), size))
                here = np.vstack([y.T @ y, y.sum(axis=0)])
                made = here if made is None else made + here
        if made is not None:
            yield _partial(made)

    width = of(np.zeros((1, size), np.int64)).shape[1]
    found = _total(fit, run, "double", width)
    return found[:-1], found[-1]


def _solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows R^-1 by substitution, column after column."""
    out = np.empty_like(rows)
    for k in range(upper.shape[0]):
        out[:, k] = (rows[:, k] - out[:, :k] @ upper[:k, k]) / upper[k, k]
    return out


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable vectors; None where there are no two distinct rows.

    Only matrices of the vectors' length squared pass the driver.
    """
    ship(vectors.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"x": _packed(grid(np.stack(batch["embedding"].to_numpy())))})

    rows = stage(vectors.select("embedding").mapInPandas(pack, "x binary").distinct(), "distinct")
    n = rows.count()
    if n < 2:
        return None
    size = int(vectors.select(F.size("embedding")).first()[0])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = np.zeros((1, size), np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                made += _unpacked(batch["x"].iloc[at : at + ROWS].tolist(), size).sum(axis=0)
        yield _partial(made)

    sums = _total(rows, add, "long", size)[0]
    whole = Whitening(n, sums, np.eye(size), np.ones(size), 0.0, 0.0)
    # a dimension that never changes has no part in any component
    spread, _ = _gram(rows, size, lambda x: (whole.deviations(x) / n))
    live = np.flatnonzero(np.diag(spread) > 0)
    if not len(live):
        return None
    gram, unit = spread[np.ix_(live, live)], np.finfo(np.float64).eps / 2
    upper = np.eye(len(live))
    shift = 11 * (n * len(live) + len(live) * (len(live) + 1)) * unit * np.linalg.norm(gram, 2)
    for turn in range(PASSES):
        if turn:
            gram, _ = _gram(rows, size, lambda x, r=upper: _solve(whole.deviations(x)[:, live] / n, r))
            if np.abs(gram - np.eye(len(live))).max() < 1e-14 * len(live):
                break
            shift = 0.0
        try:
            factor = np.linalg.cholesky(gram + shift * np.eye(len(live))).T
        except np.linalg.LinAlgError:
            # rows of lower rank than their length: what is left of the Gram matrix goes into the singular values below
            break
        upper = factor @ upper
        gram = np.eye(len(live))
    # A = QR with QᵀQ = gram: its root, times R, has the singular values and right vectors of A
    value, vector = np.linalg.eigh(gram)
    _, sigma, right = np.linalg.svd(np.sqrt(np.maximum(value, 0))[:, None] * vector.T @ upper)
    kept = np.flatnonzero(sigma > RANK * sigma[0])[:most]
    components = np.zeros((size, len(kept)))
    components[live] = right[kept].T
    found = Whitening(n, sums, components, sigma[kept] ** 2 / n, float(np.sum(sigma**2)) / n, 0.0)
    second, first = _gram(rows, size, found.apply)
    found.error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(len(kept))).max())
    drop(rows)
    return found


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows of null vectors, of vectors with null or non-finite entries and of empty ones are left out, and so are those of another
    length than most rows have (of equally many, the longer). Repeated rows and ids stay, each with its own result; equal vectors
    have equal results. Components without variance can't be whitened: where the distinct rows have fewer directions than
    `most`, there are fewer components, and none where all rows are equal or the table is empty. Other columns are not looked at.
    """
    good = usable(vectors)
    model = fit(good, most)
    columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return good.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")]).where("false")

    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in vectors:
            if len(batch):
                x = grid(np.stack(batch.to_numpy()))
                yield pd.DataFrame({"deviation": (model.deviations(x) ** 2).sum(axis=1), "values": list(model.apply(x))})

    run.__annotations__ = {"vectors": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = good.select("vec_id", F.pandas_udf(run, "deviation long, values array<double>")("embedding").alias("w"))
    flat = made.select("vec_id", F.col("w.deviation").alias("deviation"), F.posexplode("w.values").alias("k", "whitened"))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return flat.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(model.error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
