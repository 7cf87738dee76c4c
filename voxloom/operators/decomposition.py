"""Block matrices, PCA, randomised SVD, independent components, group ICA.

A tall matrix is a table of rows (row_id, values array<double>): voxels down, time or
components across. Products with a small matrix are Arrow batches; cross products are summed
in each task first, so what reaches the driver is one small square matrix a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .sums import summed


def _stack(batch: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(batch[column].to_numpy()).astype(float)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of arrays of one length as the rows of a matrix, without an object for each row."""
    values = batch.column(batch.schema.get_field_index(column))
    length = values.value_lengths().to_numpy(zero_copy_only=False)
    if values.null_count or (length != length[0]).any():
        raise ValueError(f"arrays of one length are expected in {column}")
    return values.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(values), -1)


def _arrays(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The rows of a matrix as a column of arrays."""
    out = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))
    return out.cast(kind) if kind else out


def _sums(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), _arrays(total)], ["i", "sums"])


def right_multiply(rows: DataFrame, m: np.ndarray, column: str = "values") -> DataFrame:
    """Each row times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = batch.schema.get_field_index(column)
                product = _arrays(_matrix(batch, column) @ m, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays([product if j == k else c for j, c in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def cross_product(rows: DataFrame, width: int, column: str = "values", other: str | None = None, other_width: int | None = None) -> np.ndarray:
    """Sum over rows of outer products (A'A, or A'B with a second column), summed in tasks, then by Spark."""
    second, w2 = other or column, other_width or width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, w2))
        for batch in batches:
            if batch.num_rows:
                a = _matrix(batch, column)
                total += a.T @ (a if other is None else _matrix(batch, second))
        yield _sums(total)

    parts = rows.select(*dict.fromkeys((column, second))).mapInArrow(run, "i int, sums array<double>")
    return summed(parts, w2, width)


def covariance(df: DataFrame, column: str, width: int, centered: bool = True) -> np.ndarray:
    """Covariance (or cross product) of a column's coordinates, by one pass: a coordinate of ones gives sums and count."""
    whole = cross_product(df.select(F.array_append(F.col(column).cast("array<double>"), F.lit(1.0)).alias("values")), width + 1)
    cross, n = whole[:-1, :-1], whole[-1, -1]
    if not centered:
        return cross
    mean = whole[:-1, -1] / n
    return (cross - n * np.outer(mean, mean)) / (n - 1)


#: Rows and columns of a dense block (32 KB), and products that a task adds up before it gives them on.
BLOCK, HELD = 64, 512
BLOCKS = "bi long, bj long, values array<double>"


def blocks(matrix: DataFrame, size: int = BLOCK) -> DataFrame:
    """(i, j, v) entries as dense blocks (bi, bj, values: the rows of a block one behind the other); entries that are absent are 0."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, size))
        np.add.at(out, (rows["i"].to_numpy() % size, rows["j"].to_numpy() % size), rows["v"].to_numpy())
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "values": [out.ravel()]})

    rows = matrix.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    return rows.withColumns({"bi": at("i"), "bj": at("j")}).groupBy("bi", "bj").applyInPandas(fill, BLOCKS)


def block_entries(blocked: DataFrame, n_rows: int, n_columns: int, size: int = BLOCK) -> DataFrame:
    """(i, j, v) of every entry of the blocks that lies within the matrix."""
    out = blocked.select("bi", "bj", F.posexplode("values").alias("k", "v"))
    out = out.select((F.col("bi") * size + F.floor(F.col("k") / size)).cast("long").alias("i"), (F.col("bj") * size + F.col("k") % size).cast("long").alias("j"), "v")
    return out.filter((F.col("i") < n_rows) & (F.col("j") < n_columns))


def block_multiply(a: DataFrame, b: DataFrame, size: int = BLOCK) -> DataFrame:
    """Product of two matrices of dense blocks.

    Blocks (i, k) and (k, j) meet by an equi-join on k (a small side is broadcast by adaptive
    execution); a task multiplies them and adds up what belongs to one block, and these partial
    sums, at most one a task and block, are shuffled and added up.
    """
    left = a.select("bi", F.col("bj").alias("bk"), F.col("values").alias("x"))
    right = b.select(F.col("bi").alias("bk"), "bj", F.col("values").alias("y"))

    def out(held: dict) -> pd.DataFrame:
        return pd.DataFrame({"bi": [k[0] for k in held], "bj": [k[1] for k in held], "values": [v.ravel() for v in held.values()]})

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for bi, bj, x, y in zip(batch["bi"], batch["bj"], batch["x"], batch["y"], strict=True):
                z = np.reshape(x, (size, size)) @ np.reshape(y, (size, size))
                held[bi, bj] = held[bi, bj] + z if (bi, bj) in held else z
                if len(held) >= HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "values": [np.sum(np.stack(rows["values"].to_numpy()), axis=0)]})

    parts = left.join(right, "bk").select("bi", "bj", "x", "y").mapInPandas(multiply, BLOCKS)
    return parts.groupBy("bi", "bj").applyInPandas(add, BLOCKS)


def sparse_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) product of two matrices of entries: equi-join on the inner index, partial sums."""
    met = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return met.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def pca(rows: DataFrame, width: int, share: float = 1.0, most: int | None = None, column: str = "values") -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Singular values, right vectors and scores (U·S); the data isn't centred.

    Kept are components until their singular values sum to the share of the total.
    """
    s2, v = np.linalg.eigh(cross_product(rows, width, column))
    s, v = np.sqrt(np.maximum(s2[::-1], 0)), v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(s), share * s.sum() * (1 - 1e-12)) + 1)
    k = min(max(1, k), most or width, int((s > s[0] * 1e-12).sum()) or 1)
    return s[:k], v[:, :k], right_multiply(rows, v[:, :k], column)


def randomized_svd(rows: DataFrame, width: int, rank: int, power: int = 2, column: str = "values", seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors by a randomised range finder.

    Each power step is one pass A'(A·Q); the matrix is never gathered.
    """
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(width, min(width, rank + 8))))[0]
    for _ in range(power + 1):
        both = rows.select(column)
        product = _with_product(both, q, column)
        q = np.linalg.qr(cross_product(product, width, column, "_product", q.shape[1]))[0]
    small = cross_product(_with_product(rows.select(column), q, column), q.shape[1], "_product")
    s2, w = np.linalg.eigh(small)
    return np.sqrt(np.maximum(s2[::-1], 0))[:rank], (q @ w[:, ::-1])[:, :rank]


def _with_product(rows: DataFrame, q: np.ndarray, column: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({column: batch[column], "_product": list(_stack(batch, column) @ q)})

    return rows.mapInPandas(run, f"{column} array<double>, _product array<double>")


def truncate_rank(s: np.ndarray, least_share: float = 0.0, total_share: float = 1.0, most: int | None = None) -> int:
    """Components until their sum passes the share of the total or one falls below its share of the first."""
    for k, x in enumerate(s):
        if x < least_share * s[0] or (k and s[:k].sum() >= total_share * s.sum()):
            return min(k, most or k)
    return min(len(s), most or len(s))


def _contrast(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(-u * u / 2)
    return u * e, (1 - u * u) * e


def symmetric_ica(x: np.ndarray, rounds: int = 2000, tolerance: float = 1e-6, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FastICA with symmetric decorrelation of whitened columns; (components, unmixing)."""
    n, k = x.shape
    mean = x.mean(0)
    u, s, v = np.linalg.svd(x - mean, full_matrices=False)
    white = u * np.sqrt(n)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g, dg = _contrast(white @ w)
        new = white.T @ g / n - w * dg.mean(0)
        a, _, b = np.linalg.svd(new)
        new = a @ b
        close = np.abs(np.abs((new * w).sum(0)) - 1).max()
        w = new
        if close < tolerance:
            break
    return white @ w, (v.T / s * np.sqrt(n)) @ w


def deflation_ica(x: np.ndarray, rounds: int = 2000, tolerance: float = 1e-8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FastICA one component after the other."""
    n, k = x.shape
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    white = u * np.sqrt(n)
    rng, found = np.random.default_rng(seed), np.zeros((k, 0))
    for _ in range(k):
        w = rng.normal(size=k)
        for _ in range(rounds):
            w -= found @ (found.T @ w)
            w /= np.linalg.norm(w)
            g, dg = _contrast(white @ w)
            new = white.T @ g / n - w * dg.mean()
            new -= found @ (found.T @ new)
            new /= np.linalg.norm(new)
            done = abs(abs(new @ w) - 1) < tolerance
            w = new
            if done:
                break
        found = np.column_stack([found, w])
    return white @ found, (v.T / s * np.sqrt(n)) @ found


def whiten(rows: DataFrame, width: int, most: int | None = None, column: str = "values") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows as uncorrelated columns of unit variance (populations), the matrix that makes them of centred rows, and the mean."""
    whole = cross_product(rows.select(F.array_append(F.col(column).cast("array<double>"), F.lit(1.0)).alias("values")), width + 1)
    n, mean = whole[-1, -1], whole[:-1, -1] / max(whole[-1, -1], 1.0)
    value, vector = np.linalg.eigh(whole[:-1, :-1] / max(n, 1.0) - np.outer(mean, mean))
    value, vector = value[::-1], vector[:, ::-1]
    k = min(most or width, int((value > max(value[0], 0.0) * 1e-12).sum()))
    m = vector[:, :k] / np.sqrt(value[:k])
    shifted = rows.withColumn(column, F.zip_with(F.col(column).cast("array<double>"), F.lit([float(x) for x in mean]), lambda x, c: x - c))
    return right_multiply(shifted, m, column), m, mean


def independent_components(rows: DataFrame, width: int, most: int | None = None, rounds: int = 200, tolerance: float = 1e-6, symmetric: bool = True, column: str = "values", seed: int = 1) -> tuple[DataFrame, np.ndarray, np.ndarray, bool]:
    """(rows as components, unmixing matrix, mean, whether it converged): FastICA over rows of any number.

    A round is one aggregate of k x k sums over the stored white rows; symmetric turns all
    components together, otherwise they follow one another, each held apart from those found.
    """
    white, m, mean = whiten(rows, width, most, column)
    white, k = settled(white), m.shape[1]
    rng = np.random.default_rng(seed)

    def turned(w: np.ndarray) -> np.ndarray:
        """Mean of z g(w'z) less w times the mean of g'(w'z), for each column of w."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 2, w.shape[1]))
            for batch in batches:
                if batch.num_rows:
                    z = _matrix(batch, column)
                    g, dg = _contrast(z @ w)
                    total += np.vstack([z.T @ g, dg.sum(0), np.full(w.shape[1], len(z))])
            yield _sums(total)

        s = summed(white.select(column).mapInArrow(run, "i int, sums array<double>"), w.shape[1])
        return (s[:k] - w * s[k]) / np.maximum(s[k + 1], 1.0)

    w, done = np.linalg.qr(rng.normal(size=(k, k)))[0] if k else np.zeros((0, 0)), not k
    if symmetric and k:
        for _ in range(rounds):
            a, _, b = np.linalg.svd(turned(w))
            new = a @ b
            done = np.abs(np.abs((new * w).sum(0)) - 1).max() < tolerance
            w = new
            if done:
                break
    elif k:
        found, done = np.zeros((k, 0)), True
        for j in range(k):
            one = w[:, j]
            for _ in range(rounds):
                one = one - found @ (found.T @ one)
                one /= np.linalg.norm(one)
                new = turned(one[:, None])[:, 0]
                new -= found @ (found.T @ new)
                new /= np.linalg.norm(new)
                close = abs(abs(new @ one) - 1) < tolerance
                one = new
                if close:
                    break
            done &= close
            found = np.column_stack([found, one])
        w = found
    return right_multiply(white, w, column), m @ w, mean, bool(done)


# ---- group ICA: three stages with stored tables between them -----------------------


def reorganize(packed: DataFrame, mask: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """(row_id, img_id, x, y, z, values): masked voxel series, z-scored, all runs of a voxel in one row set.

    row_id is a hash of image and voxel: no global numbering, no single sort.
    """
    rows = packed.join(mask.filter("v > 0").select("x", "y", "z"), ["x", "y", "z"], "left_semi") if mask is not None else packed
    n = F.size("ts")
    mean = F.aggregate("ts", F.lit(0.0), lambda a, v: a + v) / n
    sd = F.sqrt(F.try_divide(F.aggregate("ts", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), n - 1))
    z = F.when(F.coalesce(sd, F.lit(0.0)) > 2.220446049250313e-16, F.transform("ts", lambda v: (v - mean) / sd)).otherwise(F.transform("ts", lambda v: F.lit(0.0)))
    return settled(rows.select(F.xxhash64("img_id", "x", "y", "z").alias("row_id"), "img_id", "x", "y", "z", (z if normalize else F.col("ts")).alias("values")))


def reduce_full(matrix: DataFrame, width: int, total_share: float = 0.99, most: int | None = None):
    s2, v = np.linalg.eigh(cross_product(matrix, width))
    s, v = np.sqrt(np.maximum(s2[::-1], 0)), v[:, ::-1]
    k = truncate_rank(s, 0.0, total_share, most)
    return s[:k], v[:, :k]


def reduce_randomized(matrix: DataFrame, width: int, rank: int, power: int = 2, total_share: float = 0.99):
    s, v = randomized_svd(matrix, width, rank, power)
    k = truncate_rank(s, 0.0, total_share, rank)
    return s[:k], v[:, :k]


def temporal_components(matrix: DataFrame, s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Independent time courses, their maps (t values of each voxel), shares of variance in falling order."""
    from .regression import glm

    courses, _ = symmetric_ica(v * s)
    maps = glm(matrix, courses, ["row_id", "img_id", "x", "y", "z"], "values")
    strength = np.array(maps.agg(F.array(*[F.sum(F.get("bhat", F.lit(k)) * F.get("bhat", F.lit(k))) for k in range(courses.shape[1])])).first()[0])
    order = np.argsort(-strength)
    pick = lambda c: F.array(*[F.get(c, F.lit(int(k))) for k in order]).alias(c)
    return courses[:, order], maps.select("row_id", "img_id", "x", "y", "z", pick("bhat"), pick("t")), strength[order] / strength.sum()


def spatial_components(matrix: DataFrame, s: np.ndarray, v: np.ndarray, rounds: int = 200, tolerance: float = 1e-5, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Independent maps over voxels: FastICA whose every round is one aggregate over the rows.

    Rows are projected on the kept components and whitened; the driver holds k x k matrices.
    """
    n = matrix.count()
    k = len(s)
    white = settled(right_multiply(matrix, v / s * np.sqrt(n)))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        current = w.copy()

        def run(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            total, slope = np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                if len(batch):
                    x = _stack(batch, "values")
                    g, dg = _contrast(x @ current)
                    total += x.T @ g
                    slope += dg.sum(0)
            yield pd.DataFrame({"i": np.arange(k + 1), "sums": list(np.vstack([total, slope]))})

        sums = summed(white.select("values").mapInPandas(run, "i int, sums array<double>"), k) / n
        a, _, b = np.linalg.svd(sums[:k] - w * sums[k])
        new = a @ b
        close = np.abs(np.abs((new * w).sum(0)) - 1).max()
        w = new
        if close < tolerance:
            break
    return right_multiply(white, w), w


def standardized_maps(maps: DataFrame, count: int, column: str = "values") -> DataFrame:
    """(row key, comp, z): maps as z-scores over all voxels, for thresholding."""
    long = maps.select("row_id", F.posexplode(column).alias("comp", "value"))
    one = long.groupBy("comp").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return long.join(one, "comp").select("row_id", "comp", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


def rank_components(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score))))  # as many rows as components
