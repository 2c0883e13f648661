"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

``A`` is the fit list (each distinct integer vector once), centred.  Each
step takes a block of right vectors ``V_j``, forms ``A V_j`` and the
transposed product, orthogonalises both sides against all earlier vectors
(twice), and so builds ``A V = U B`` with a small block-bidiagonal ``B``.
The SVD of ``B`` gives the components (``V`` times its right vectors) and
their deviations; the coupling to the next block bounds what is still missing.

Left vectors have one entry per row of the table, so none is ever stored:
``U_j = A P_j`` for a small ``P_j``, and ``U_i' A X = (A' U_i)' X`` needs only
the small ``Z_i = A' U_i`` of earlier steps.  One pass over the table, in
which a task multiplies its centred rows by ``P`` and the result by their
transpose, thus does both products of a step.  What the driver holds is
``dimensions x steps`` numbers, whatever the number of rows.

A block holds one vector more than components are asked for, so equal
eigenvalues are found with their multiplicity.  After the steps converge, two
passes over the table measure the residual of each component and the
covariance of the whitened fit list; where the residual is not down to
rounding, the components start another round of steps.

Equal vectors are merged by a partial aggregate before the shuffle, so a hot
vector is one row per task.  The fit list is a table in the shared folder;
every pass is a job of its own over it, so a lost executor costs its tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import tasks

#: Entries are scaled by this and rounded down.
SCALE = 256.0
LONG = (-(1 << 63), (1 << 63) - 1)

COMPONENTS = 4
#: Residual, as a share of the greatest singular value, that counts as nought,
#: and the rounds of steps after which a residual is accepted as it is.
TOLERANCE = 1e-13
ROUNDS = 4
#: Eigenvalues below this share of the greatest are nought to double precision.
NOUGHT = 1e-13


# -- integer vectors ------------------------------------------------------------

def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows kept, all their entries as longs, and their offsets.  Dropped are
    null vectors and those with a null, infinite or NaN entry."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    off = np.zeros(1, np.int64)
    if not len(column):
        return np.empty(0, np.int64), np.empty(0, np.int64), off
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    values = column.values.slice(off[0], off[-1] - off[0])
    c = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    off = off - off[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    good = (bad[off[1:]] == bad[off[:-1]]) & ~np.asarray(column.is_null())
    sizes = np.diff(off)
    x = np.floor(SCALE * c[np.repeat(good, sizes)])
    top = x >= 2.0 ** 63
    out = np.where(top | (x < -2.0 ** 63), 0, x).astype(np.int64)
    out[top], out[x < -2.0 ** 63] = LONG[1], LONG[0]
    return np.flatnonzero(good), out, np.concatenate([[0], np.cumsum(sizes[good])])


def packed(x: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each row's longs as bytes, without copying them one by one."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(off) - 1,
        [None, pa.py_buffer((off * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]
    ).cast(pa.binary())


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as a matrix of longs, short ones filled up with 0."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) and np.all(np.diff(off) == 8 * width):
        raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]]
        return raw.view(np.int64).reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    for i, b in enumerate(column.to_pylist()):
        out[i, :len(b) // 8] = np.frombuffer(b, np.int64)
    return out


def matrices(batches, width: int):
    """Record batches in parts of bounded bytes, each with its ``x`` column as
    a matrix."""
    step = max(1, tasks.STEP_BYTES // (8 * max(1, width)))
    for batch in batches:
        x = batch.column(batch.schema.get_field_index("x"))
        for i in range(0, len(x), step):
            yield batch.slice(i, step), rows_of(x.slice(i, step), width)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x)`` of the rows that remain, vectors packed."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, x, off = scaled(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)),
                                              packed(x, off)], ["vec_id", "x"])

    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).mapInArrow(
        run, f"vec_id {kind}, x binary")


# -- passes over the fit list -----------------------------------------------------

@dataclass
class Fit:
    """The fit list with its size, width and exact sums per dimension."""
    table: DataFrame
    n: int
    width: int
    sums: list[int]

    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit_list(vectors: DataFrame) -> Fit:
    """Distinct ``x`` of ``vectors(vec_id, x)`` as a written table."""
    table, n = session.write_counted(vectors.select("x").distinct(), "vectors")
    width = (table.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 8 if n else 0

    def run(batches):
        for _, x in matrices(batches, width):  # high and low halves add up without overflow
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width)), pa.array((x >> 32).sum(0)),
                 pa.array((x & 0xFFFFFFFF).sum(0))], ["at", "high", "low"])

    if not width:
        return Fit(table, n, 0, [])
    total = table.mapInArrow(run, "at bigint, high bigint, low bigint").groupBy("at").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    sums = [0] * width
    for r in total.collect():  # one row a dimension
        sums[r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    return Fit(table, n, width, sums)


def both_products(fit: Fit, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``A'(A P)`` and ``(A P)'(A P)`` for the centred rows ``A``: one row a
    dimension and column reaches the driver."""
    width, b, centre = fit.width, right.shape[1], fit.centre()
    names = [f"c{i}" for i in range(b)]

    def run(batches):
        total = np.zeros((width + b, b))
        for _, x in matrices(batches, width):
            a = x - centre
            left = a @ right
            total[:width] += a.T @ left
            total[width:] += left.T @ left
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width + b)), *[pa.array(total[:, i]) for i in range(b)]],
            ["at", *names])

    got = fit.table.mapInArrow(run, "at bigint, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((width + b, b))
    for r in got.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["at"]] = [r[c] for c in names]
    return out[:width], out[width:]


# -- bidiagonalisation --------------------------------------------------------------

def _orthonormal(x: np.ndarray, basis: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``x = q s`` with ``q`` orthonormal, and orthogonal to ``basis`` (which
    ``x`` already is but for rounding); directions of a length up to ``least``
    are left out of ``q``."""
    left, size, right = np.linalg.svd(x, full_matrices=False)
    kept = size > least
    q = left[:, kept]
    q, r = np.linalg.qr(q - basis @ (basis.T @ q))
    return q, r @ (size[kept, None] * right[kept])


def _against(x, basis):
    """``x`` less its parts along the orthonormal ``basis``, taken out twice."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


class Bidiagonal:
    """``A V = U B`` with ``U = A P``, grown a block at a time."""

    def __init__(self, fit: Fit, start: np.ndarray):
        d = fit.width
        self.fit, self.scale = fit, 0.0   # greatest length seen
        self.v = np.zeros((d, 0))        # right vectors
        self.p = np.zeros((d, 0))        # left vectors as combinations of the rows
        self.z = np.zeros((d, 0))        # A' U
        self.b = np.zeros((0, 0))
        self.block, _ = _orthonormal(start, self.v, 0.0)
        self.trail = np.zeros((0, 0))    # couples the last left block to the next right one

    def step(self) -> None:
        """One block: a pass over the table."""
        v, old = self.block, self.b.shape
        coef = self.z.T @ v              # U' A V: only the last block in exact arithmetic
        p = v - self.p @ coef
        more = self.z.T @ p
        p, coef = p - self.p @ more, coef + more
        y, gram = both_products(self.fit, p)
        size, turn = np.linalg.eigh((gram + gram.T) / 2)
        self.scale = max(self.scale, float(np.sqrt(max(size[-1], 0.0))))
        kept = size > max((TOLERANCE * self.scale) ** 2, NOUGHT * size[-1])
        length = np.sqrt(size[kept])
        p, z = p @ (turn[:, kept] / length), y @ (turn[:, kept] / length)
        grown = np.zeros((old[0] + len(length), old[1] + v.shape[1]))
        grown[:old[0], :old[1]] = self.b
        grown[:old[0], old[1]:] = coef
        grown[old[0]:, old[1]:] = length[:, None] * turn[:, kept].T
        self.v, self.b = np.hstack([self.v, v]), grown
        self.p, self.z = np.hstack([self.p, p]), np.hstack([self.z, z])
        rest = _against(z, self.v)
        self.block, self.trail = _orthonormal(rest, self.v, TOLERANCE * self.scale)

    def restart(self, rng) -> None:
        """Go on from a new vector: the old block has led to nothing new."""
        fresh = _against(rng.standard_normal((self.fit.width, 1)), self.v)
        self.block, _ = _orthonormal(fresh, self.v, 0.0)
        self.trail = np.zeros((1, 0))

    def best(self, r: int):
        """Greatest ``r`` singular values, right vectors, residual bounds."""
        left, size, right = np.linalg.svd(self.b, full_matrices=False)
        last = left[left.shape[0] - self.trail.shape[1]:, :r]
        missing = np.linalg.norm(self.trail @ last, axis=0) if self.trail.size else np.zeros(len(size[:r]))
        return size[:r], self.v @ right[:r].T, missing

    def done(self, r: int) -> bool:
        size, _, missing = self.best(r)
        full = self.v.shape[1] == self.fit.width or not self.block.shape[1]
        return full or (len(size) == r and bool(np.all(missing <= TOLERANCE * size[0])))


@dataclass
class Components:
    """Unit vectors (columns) by falling eigenvalue, all over the fit list."""
    n: int
    width: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int


def _trace(fit: Fit) -> float:
    """Sum of the squared distances to the centre, over ``n``."""
    width, centre = fit.width, fit.centre()

    def run(batches):
        total = 0.0
        for _, x in matrices(batches, width):
            total += float(((x - centre) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["t"])

    return (fit.table.mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0) / fit.n


def components(fit: Fit, want: int = COMPONENTS, block: int | None = None) -> Components:
    """The first ``want`` components, fewer where the fit list varies in fewer
    directions.  ``block`` is the number of right vectors a step takes."""
    d, found, passes = fit.width, np.zeros((fit.width, 0)), 0
    none = Components(fit.n, d, fit.sums, found, np.zeros(0), 0.0, 0.0, 0)
    if not d:
        return none
    trace = _trace(fit)
    if not trace > 0.0:
        return none
    block = min(d, want + 1 if block is None else block)
    rng = np.random.default_rng(7)
    start, error = rng.standard_normal((d, block)), 0.0
    for _ in range(ROUNDS):
        run = Bidiagonal(fit, start)
        while True:
            run.step()
            passes += 1
            if run.done(want):
                # a block narrower than the components may miss equal eigenvalues
                if block >= want or run.block.shape[1] or run.v.shape[1] == d:
                    break
                run.restart(rng)
        size, vectors, _ = run.best(want)
        vectors, _ = np.linalg.qr(vectors[:, size > TOLERANCE * size[0]])
        # the table's own word on the components
        y, gram = both_products(fit, vectors)
        value, turn = np.linalg.eigh((gram + gram.T) / 2)
        there = value[::-1] > NOUGHT * d * value[-1]
        turn, value = turn[:, ::-1][:, there], value[::-1][there]
        vectors, y = vectors @ turn, y @ turn
        _, cov = both_products(fit, vectors / np.sqrt(value / fit.n))
        error = float(np.abs(cov / fit.n - np.eye(len(value))).max())
        passes += 2
        residual = np.linalg.norm(y - vectors * value, axis=0)
        if np.all(residual <= 100 * TOLERANCE * value[0]):
            break
        spare = rng.standard_normal((d, max(0, block - vectors.shape[1])))
        start = np.hstack([vectors, _against(spare, vectors)])
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Components(fit.n, d, fit.sums, vectors * sign, value / fit.n, trace, error, passes)


# -- whitened rows -------------------------------------------------------------------

def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Exact ``sum((n * x - S)**2)`` of each row; None beyond a long."""
    far = [max(abs(n * int(hi) - s), abs(n * int(lo) - s))
           for hi, lo, s in zip(x.max(0), x.min(0), sums, strict=True)] if len(x) else []
    if sum(f * f for f in far) <= LONG[1] and all(abs(s) <= LONG[1] for s in sums):
        gap = x * np.int64(n) - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [e if e <= LONG[1] else None for e in exact]


def whiten(vectors: DataFrame, want: int = COMPONENTS, block: int | None = None,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``: a row for each remaining row and component.

    Dropped are rows with a null vector or a null, infinite or NaN entry.
    Entries beyond a long after scaling become the nearest long; a vector
    shorter than the longest is filled up with 0.  Components without
    variance are left out, so a table of equal vectors, or an empty one, gives
    an empty result.  ``deviation`` is exact, and null where it exceeds a
    long.  Null and repeated ids are kept, equal rows are whitened alike;
    other columns are ignored, whatever their names.
    """
    tasks.prepare(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = integer_vectors(vectors, id_col, vec_col)
    with session.work(vectors.sparkSession):
        c = components(fit_list(rows), want, block)
    r, centre = c.vectors.shape[1], np.array([s / c.n for s in c.sums]) if c.n else None
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for part, x in matrices(batches, c.width):
            white = (x - centre) @ c.vectors / np.sqrt(c.eigenvalues)
            m = len(x)
            every = np.repeat(np.arange(m), r)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(every)),
                 pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * r, c.n, np.int64)),
                 pa.array(deviations(x, c.n, c.sums), pa.int64()).take(pa.array(every)),
                 pa.array(white.ravel()),
                 pa.array(np.tile(c.eigenvalues / c.trace, m)),
                 pa.array(np.full(m * r, c.identity_error))], names)

    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    return (rows if r else rows.limit(0)).mapInArrow(run, schema)
