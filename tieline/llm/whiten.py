"""Whitening of spectra: principal components scaled to unit variance.

The fit list holds each distinct spectrum once. Its sums and its centred covariance are added up by Spark from one small
row a task; the covariance matrix (bands x bands, bounded by MAX_BANDS) is then brought to tridiagonal form by
Householder reflections, its leading eigenvalues are found by bisection on Sturm counts, and their vectors by inverse
iteration, in which vectors of a cluster of eigenvalues are made orthogonal to one another. The components (k x bands)
are broadcast and every spectrum is projected.

Works on the project's cubes (product_id, line, sample, spectrum) and likewise on any table of equally long vectors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import map_batches, stored

COMPONENTS, SCALE, MAX_BANDS = 4, 256, 2048
LEAST_SHARE = 1e-12


class Whitening(NamedTuple):
    """A fitted transform: n distinct spectra, their exact sums per band, components (k x bands), eigenvalues, trace of
    the covariance, and the largest deviation of the whitened covariance from the identity."""

    n: int
    sums: list[int]
    components: list[list[float]]
    values: list[float]
    trace: float
    identity_error: float


# ---- eigenvalues of a symmetric matrix

def tridiagonal(a):
    """Householder reduction of a symmetric matrix: (diagonal, off-diagonal, reflectors). Column j of the reflectors is
    the unit vector of step j (zero where nothing had to be done)."""
    import numpy as np

    a = np.array(a, np.float64)
    n = len(a)
    reflectors = np.zeros((n, max(n - 2, 0)))
    for j in range(n - 2):
        x = a[j + 1:, j].copy()
        size = np.linalg.norm(x)
        if not np.any(x[1:]):
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        reflectors[j + 1:, j] = v
        p = a[j + 1:, j + 1:] @ v
        w = 2.0 * (p - (v @ p) * v)
        a[j + 1:, j + 1:] -= np.outer(v, w) + np.outer(w, v)
        a[j + 1:, j] -= 2.0 * v * (v @ a[j + 1:, j])
        a[j, j + 1:] = a[j + 1:, j]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_count(diag, off, x: float) -> int:
    """How many eigenvalues of the tridiagonal matrix are below x: negative terms of the Sturm sequence."""
    count, q = 0, 1.0
    tiny = 2.2e-308
    for i, d in enumerate(diag):
        q = d - x - (off[i - 1] * off[i - 1] / q if i else 0.0)
        if q == 0.0:
            q = -tiny
        count += q < 0
    return count


def leading_values(diag, off, k: int) -> list[float]:
    """The k largest eigenvalues, falling, by bisection to the last bit."""
    diag, off = [float(d) for d in diag], [float(e) for e in off]
    n = len(diag)
    reach = [abs(a) + abs(b) for a, b in zip([0.0, *off], [*off, 0.0])]
    low, high = min(d - r for d, r in zip(diag, reach)), max(d + r for d, r in zip(diag, reach))
    span = max(abs(low), abs(high), 1e-300)
    low, high = low - 1e-12 * span, high + 1e-12 * span
    out = []
    for j in range(min(k, n)):
        a, b = low, high if not out else min(high, out[-1] + 1e-12 * span)
        while a < (m := a + (b - a) / 2) < b:
            if sturm_count(diag, off, m) <= n - 1 - j:
                a = m
            else:
                b = m
        out.append(a + (b - a) / 2)
    return out


def solve_shifted(diag, off, shift: float, rhs, tiny: float):
    """Solve (T - shift) x = rhs by elimination with row exchanges; a vanishing pivot becomes `tiny`."""
    import numpy as np

    n = len(diag)
    d, up, up2, b = diag - shift, np.append(off, 0.0), np.zeros(n), rhs.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(d[i]):
            f = d[i] / low
            d[i], d[i + 1], up[i] = low, up[i] - f * d[i + 1], d[i + 1]
            up2[i], up[i + 1] = (up[i + 1], -f * up[i + 1]) if i < n - 2 else (0.0, 0.0)
            b[i], b[i + 1] = b[i + 1], b[i] - f * b[i + 1]
        else:
            if abs(d[i]) < tiny:
                d[i] = tiny
            f = low / d[i]
            d[i + 1] -= f * up[i]
            b[i + 1] -= f * b[i]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        rest = b[i] - (up[i] * x[i + 1] if i < n - 1 else 0.0) - (up2[i] * x[i + 2] if i < n - 2 else 0.0)
        x[i] = rest / (d[i] if abs(d[i]) >= tiny else np.copysign(tiny, d[i]))
    return x


def leading_vectors(diag, off, values: list[float], rounds: int = 6, close: float = 1e-3):
    """Unit vectors of the given eigenvalues (falling) by inverse iteration. A vector whose value lies within
    close * norm of the one before belongs to its cluster and is made orthogonal to the cluster's earlier vectors."""
    import numpy as np

    n = len(diag)
    norm = float(np.max(np.abs(diag))) + 2 * float(np.max(np.abs(off), initial=0.0)) or 1.0
    tiny = np.finfo(float).eps * norm
    out, start = np.zeros((len(values), n)), 0
    shift = None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close * norm:
            start = j
        # equal values need different shifts, or all would lead to the same vector
        shift = value if j == start else min(value, shift - 4 * tiny)
        x = np.random.Generator(np.random.PCG64(j + 1)).standard_normal(n)
        for _ in range(rounds):
            for _ in range(2):
                x -= out[start:j].T @ (out[start:j] @ x)
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x), tiny)
            x /= np.max(np.abs(x))
        for _ in range(2):
            x -= out[start:j].T @ (out[start:j] @ x)
            x /= np.linalg.norm(x)
        out[j] = x
    return out


def leading_components(cov, k: int):
    """(values, vectors as rows) of the k largest eigenvalues of a symmetric matrix, falling."""
    import numpy as np

    diag, off, reflectors = tridiagonal(cov)
    values = leading_values(diag, off, k)
    vectors = leading_vectors(diag, off, values).T
    for j in range(reflectors.shape[1] - 1, -1, -1):
        v = reflectors[:, j]
        vectors -= 2.0 * np.outer(v, v @ vectors)
    vectors = (vectors / np.linalg.norm(vectors, axis=0)).T
    return values, vectors


# ---- fitting

def whole_steps(cube: DataFrame, keys: list[str], spectrum: str = "spectrum", scale: int = SCALE) -> DataFrame:
    """Key columns and `steps` array<bigint>: floor(scale * value) of every band. Spectra that are null or hold a null
    or a value that is not finite are left out, and so are those without a band or beyond MAX_BANDS."""
    x = F.col(f"`{spectrum}`")
    values = F.transform(x, lambda v: v.cast("double"))
    good = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = cube.where(x.isNotNull() & F.coalesce(good, F.lit(False)) & F.size(x).between(1, MAX_BANDS))
    return rows.select(*[F.col(f"`{c}`") for c in keys], F.transform(values, lambda v: F.floor(v * scale).cast("bigint")).alias("steps"))


def _matrix(column):
    """Rows of an Arrow list column of equal lengths as an int64 matrix."""
    import numpy as np

    return np.asarray(column.flatten()).reshape(len(column), -1)


def _block_sums(batches):
    import numpy as np
    import pyarrow as pa

    n, total = 0, None
    for b in batches:
        if b.num_rows:
            part = _matrix(b.column(0)).sum(0)
            n, total = n + b.num_rows, part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.asarray(total).tolist()], pa.list_(pa.int64()))], ["n", "total"])


def _block_products(center):
    """Task rows (i, products with bands i..) of centred values."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                c = _matrix(part.column(0)) - center.value
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([np.ascontiguousarray(r[i:]).tolist() for i, r in enumerate(total)], pa.list_(pa.float64()))], ["i", "row"])

    return run


def _block_moments(model):
    """One task row: count, means and centred products of the whitened values."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        center, project = model.value
        n, mean, m2 = 0, 0.0, 0.0
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                w = (_matrix(b.slice(lo, 4096).column(0)) - center) @ project
                if len(w):
                    m, c = w.mean(0), w - w.mean(0)
                    gap, both = m - mean, n + len(w)
                    m2 = m2 + c.T @ c + np.outer(gap, gap) * (n * len(w) / both)
                    mean, n = mean + gap * (len(w) / both), both
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "m2"])

    return run


def fit_whitening(cube: DataFrame, spectrum: str = "spectrum", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Fit on the distinct spectra, in whole steps of 1/scale.

    All spectra must have one number of bands, else it is an error. Components with an eigenvalue below 1e-12 of the
    trace carry rounding noise only and are left out, so fewer than `components` may come back (none for an empty table
    or a single distinct spectrum). A hot spectrum is dropped to one row per task before anything is shuffled."""
    import numpy as np

    fit = stored(whole_steps(cube, [], spectrum, scale).distinct(), "spectra")
    shape = fit.select(F.count("*").alias("n"), F.min(F.size("steps")).alias("least"), F.max(F.size("steps")).alias("bands")).first()
    n, bands = shape["n"], shape["bands"]
    if not n:
        return Whitening(0, [], [], [], 0.0, 0.0)
    if shape["least"] != bands:
        raise ValueError(f"spectra of {shape['least']} and of {bands} bands")
    sums = map_batches(fit, _block_sums, "n bigint, total array<bigint>").select(F.posexplode("total").alias("i", "s"))
    sums = {r["i"]: int(r["s"]) for r in sums.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    sums = [sums[i] for i in range(bands)]
    sc = cube.sparkSession.sparkContext
    center = np.array([s / n for s in sums])
    rows = map_batches(fit, _block_products(sc.broadcast(center)), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "p"))
    rows = rows.groupBy("i", "j").agg(F.sum("p").alias("p")).toArrow()
    i = np.asarray(rows["i"])
    j = i + np.asarray(rows["j"])
    cov = np.zeros((bands, bands))
    cov[i, j] = cov[j, i] = np.asarray(rows["p"]) / n
    trace = float(np.trace(cov))
    values, vectors = leading_components(cov, components)
    kept = [k for k, e in enumerate(values) if e > LEAST_SHARE * trace]
    values, vectors = [values[k] for k in kept], vectors[kept]
    error = _identity_error(fit, center, values, vectors) if kept else 0.0
    return Whitening(n, sums, vectors.tolist(), values, trace, error)


def _identity_error(fit: DataFrame, center, values, vectors) -> float:
    import numpy as np

    k = len(values)
    model = fit.sparkSession.sparkContext.broadcast((center, vectors.T / np.sqrt(values)))
    parts = map_batches(fit, _block_moments(model), "n bigint, mean array<double>, m2 array<double>")
    first = [F.sum(F.col("mean")[i] * F.col("n")).alias(f"m{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(k)]
    second = [F.sum(F.col("m2")[i * k + j] + F.col("n") * F.col("mean")[i] * F.col("mean")[j]).alias(f"c{i}_{j}") for i, j in pairs]
    r = parts.agg(F.sum("n").alias("n"), *first, *second).first()
    return max(abs(r[f"c{i}_{j}"] / r["n"] - r[f"m{i}"] * r[f"m{j}"] / r["n"] ** 2 - (i == j)) for i, j in pairs)


def whiten_spectra(cube: DataFrame, model: Whitening, keys: list[str] | None = None, spectrum: str = "spectrum", scale: int = SCALE) -> DataFrame:
    """One row per spectrum and component: the key columns (product_id, line, sample if not named), component (from 1),
    n, deviation, whitened, explained and identity_error.

    whitened = (steps - sums/n) . component / sqrt(eigenvalue). deviation = the sum over bands of (n*steps - sums)^2,
    exact; null if it does not fit 64 bits. explained = eigenvalue / trace. Rows that repeat a key or a spectrum each get
    theirs; spectra that whole_steps leaves out get none, and of another number of bands than the model's neither."""
    import numpy as np

    keys = keys or ["product_id", "line", "sample"]
    k, bands = len(model.values), len(model.sums)
    sent = cube.sparkSession.sparkContext.broadcast((np.array(model.sums, dtype=object), np.array([s / model.n for s in model.sums]) if model.n else np.zeros(0),
                                                     (np.array(model.components).reshape(k, bands) / np.sqrt(np.array(model.values))[:, None]).T))
    n = model.n

    def run(batches):
        import pyarrow as pa

        sums, center, project = sent.value
        largest = max((abs(int(s)) for s in sums), default=0)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = _matrix(part.column(part.num_columns - 1))
                top = int(max(abs(int(x.min())), abs(int(x.max()))))
                if bands * (n * top + largest) ** 2 < 1 << 63:
                    gap = n * x - sums.astype(np.int64)
                    deviation = (gap * gap).sum(1).tolist()
                else:
                    whole = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
                    deviation = [d if d < 1 << 63 else None for d in whole]
                made = [pa.array(deviation, pa.int64()), pa.array(((x - center) @ project).tolist(), pa.list_(pa.float64()))]
                fields = [part.schema.field(i) for i in range(part.num_columns - 1)] + [pa.field("deviation", pa.int64()), pa.field("_w_", pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], schema=pa.schema(fields))

    rows = whole_steps(cube, keys, spectrum, scale).where(F.size("steps") == bands)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    out = map_batches(rows, run, f"{kept}deviation bigint, _w_ array<double>")
    shares = F.array(*[F.lit(e / model.trace) for e in model.values]) if k else F.array().cast("array<double>")
    out = out.select(*[F.col(f"`{c}`") for c in keys], "deviation", F.posexplode("_w_").alias("_i_", "whitened"))
    return out.select(*[F.col(f"`{c}`") for c in keys], (F.col("_i_") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                      shares[F.col("_i_")].alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"))
