"""Fidelity kernels: closed-form state embedding, explicit feature maps, Nystrom, invariants, a content-addressed cache.

The kernel of two rows is |<a|b>|^2 of their states of 2^q amplitudes. It is the plain dot product of
the explicit maps of 4^q features, so training never needs a matrix of all pairs.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_STATE_BYTES = 500 * 1024 * 1024


def _signs(q: int) -> np.ndarray:
    """The Walsh-Hadamard matrix without its scale."""
    i = np.arange(2**q)
    return 1 - 2 * (np.bitwise_count(i[:, None] & i[None, :]) % 2).astype(int)


def phases(x: np.ndarray) -> np.ndarray:
    """Of each row and basis state: twice the sum of set bits' angles, and of (pi - x)(pi - x') for neighbours that differ."""
    q = x.shape[1]
    bit = (np.arange(2**q)[:, None] >> np.arange(q)) & 1
    pair = (np.pi - x[:, :-1]) * (np.pi - x[:, 1:])
    return 2 * (x @ bit.T) + 2 * (pair @ (bit[:, :-1] ^ bit[:, 1:]).T)


def states(x: np.ndarray, reps: int = 2) -> np.ndarray:
    """Unit states, row x 2^q, for q features of two or more."""
    x = np.asarray(x, float)
    if x.ndim != 2 or x.shape[1] < 2 or reps < 1:
        raise ValueError("two or more features and one or more repetitions are needed")
    q = x.shape[1]
    h, turn = _signs(q) / 2 ** (q / 2), np.exp(1j * phases(x))
    psi = np.zeros((len(x), 2**q), complex)
    psi[:, 0] = 1
    for _ in range(reps):
        psi = turn * (psi @ h)
    if len(x) and np.abs(np.linalg.norm(psi, axis=1) - 1).max() > 1e-10:
        raise ValueError("a state is not of unit length")
    return psi


def fidelity(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """The kernel of two sets of states; of one set with itself, with a unit diagonal and exact symmetry."""
    other = a if b is None else b
    if a.shape[1] != other.shape[1]:
        raise ValueError("states of different dimension")
    k = np.abs(a.conj() @ other.T) ** 2
    if b is None:
        k = (k + k.T) / 2
        np.fill_diagonal(k, 1.0)
    return k.clip(0, 1)


def explicit_map(psi: np.ndarray) -> np.ndarray:
    """Features whose dot product is the kernel: squared moduli, and root two times the parts of psi_i conj(psi_j), i < j."""
    i, j = np.triu_indices(psi.shape[1], 1)
    cross = psi[:, i] * psi[:, j].conj() * math.sqrt(2)
    return np.concatenate([np.abs(psi) ** 2, cross.real, cross.imag], axis=1)


def sampled_kernel(k: np.ndarray, shots: int = 1024, seed: int = 42, project: bool = True) -> np.ndarray:
    """A kernel estimated from so many shots, made positive semidefinite if asked."""
    rng = np.random.default_rng(seed)
    got = rng.binomial(shots, k.clip(0, 1)) / shots
    got = np.triu(got, 1)
    got = got + got.T + np.eye(len(k))
    if project:
        values, vectors = np.linalg.eigh(got)
        got = (vectors * values.clip(min=0)) @ vectors.T
    return got


def state_columns(angles: list[str], reps: int = 2) -> tuple[Column, Column]:
    """Real and imaginary amplitudes as array columns, in column expressions alone."""
    q, d = len(angles), 2 ** len(angles)
    sign = _signs(q)
    bit = lambda j, k: (j >> k) & 1
    phi = []
    for j in range(d):
        terms = [F.lit(2.0) * F.col(a) for k, a in enumerate(angles) if bit(j, k)]
        terms += [F.lit(2.0) * (F.lit(math.pi) - F.col(angles[k])) * (F.lit(math.pi) - F.col(angles[k + 1])) for k in range(q - 1) if bit(j, k) ^ bit(j, k + 1)]
        phi.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    turn_re, turn_im = F.array(*(F.cos(p) for p in phi)), F.array(*(F.sin(p) for p in phi))
    scale = 1 / 2 ** (q / 2)
    re, im = F.transform(turn_re, lambda x: x * scale), F.transform(turn_im, lambda x: x * scale)

    def mixed(v: Column) -> Column:
        rows = F.array(*(F.array(*(F.lit(float(s)) for s in r)) for r in sign))
        return F.transform(rows, lambda r: F.aggregate(F.zip_with(r, v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) * scale)

    for _ in range(reps - 1):
        p, m = mixed(re), mixed(im)
        re = F.zip_with(F.zip_with(p, turn_re, lambda a, b: a * b), F.zip_with(m, turn_im, lambda a, b: a * b), lambda a, b: a - b)
        im = F.zip_with(F.zip_with(p, turn_im, lambda a, b: a * b), F.zip_with(m, turn_re, lambda a, b: a * b), lambda a, b: a + b)
    return re, im


def embed(df: DataFrame, angles: list[str], reps: int = 2, fast: bool = True) -> DataFrame:
    """df with re and im. Fast: in Arrow batches; otherwise by column expressions."""
    if not fast:
        re, im = state_columns(angles, reps)
        return df.withColumns({"re": re, "im": im})

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def made(*cols: pd.Series) -> pd.DataFrame:
        psi = states(np.stack([c.to_numpy(float) for c in cols], axis=1), reps)
        return pd.DataFrame({"re": list(psi.real), "im": list(psi.imag)})

    return df.withColumn("_psi", made(*(F.col(a) for a in angles))).withColumns({"re": F.col("_psi.re"), "im": F.col("_psi.im")}).drop("_psi")


def mapped(df: DataFrame, angles: list[str], reps: int = 2) -> DataFrame:
    """df with `features`, the explicit map as an ML vector."""
    from pyspark.ml.functions import array_to_vector

    @F.pandas_udf("array<double>")
    def made(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(explicit_map(states(np.stack([c.to_numpy(float) for c in cols], axis=1), reps))))

    return df.withColumn("features", array_to_vector(made(*(F.col(a) for a in angles))))


def overlap(re_a: Column, im_a: Column, re_b: Column, im_b: Column) -> Column:
    """|<a|b>|^2 of states in array columns, within [0, 1]."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    re, im = dot(re_a, re_b) + dot(im_a, im_b), dot(re_a, im_b) - dot(im_a, re_b)
    return F.least(F.greatest(re * re + im * im, F.lit(0.0)), F.lit(1.0))


def kernel_rows(df: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, mark, k): every row of df (re, im) against a sample of landmarks, whose size the caller sets."""
    m = marks.select(F.col(key).alias("mark"), F.col("re").alias("m_re"), F.col("im").alias("m_im"))
    met = df.select(key, "re", "im").crossJoin(F.broadcast(m))  # rows by landmarks, the kernel's own shape
    return met.select(key, "mark", overlap(F.col("re"), F.col("im"), F.col("m_re"), F.col("m_im")).alias("k"))


def nystrom(rows: np.ndarray, marks: np.ndarray, rcond: float = 1e-15) -> np.ndarray:
    """Features whose dot products approximate the kernel: rows (n x m) times the root of the pseudo-inverse of marks (m x m)."""
    values, vectors = np.linalg.eigh((marks + marks.T) / 2)
    ok = values > rcond * max(values.max(initial=0.0), 0.0)
    return rows @ (vectors[:, ok] / np.sqrt(values[ok]))


def nystrom_errors(k: np.ndarray, m: int, seed: int = 42) -> dict[str, float]:
    """Relative Frobenius and spectral error of m landmarks, the first of one permutation, and the landmarks' condition number."""
    marks = np.sort(np.random.default_rng(seed).permutation(len(k))[:m])
    w = k[np.ix_(marks, marks)]
    f = nystrom(k[:, marks], w)
    gap = k - f @ f.T
    return {"m": m, "frobenius": float(np.linalg.norm(gap) / np.linalg.norm(k)), "spectral": float(np.linalg.norm(gap, 2) / np.linalg.norm(k, 2)), "condition": float(np.linalg.cond(w))}


def nystrom_features(df: DataFrame, marks: np.ndarray, angles: list[str], reps: int = 2) -> DataFrame:
    """df with `features` for landmarks at the given angles; the landmarks are the caller's bounded sample."""
    from pyspark.ml.functions import array_to_vector

    own = states(marks, reps)
    w = fidelity(own)

    @F.pandas_udf("array<double>")
    def made(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(nystrom(fidelity(states(np.stack([c.to_numpy(float) for c in cols], axis=1), reps), own), w)))

    return df.withColumn("features", array_to_vector(made(*(F.col(a) for a in angles))))


def invariants(k: np.ndarray, diagonal: float = 1e-6, symmetry: float = 1e-10, inside: float = 1e-6, least: float = -1e-8) -> dict[str, float]:
    """The checked figures of a kernel; ValueError that lists all that fail."""
    k = np.asarray(k, float)
    if k.ndim != 2 or k.shape[0] != k.shape[1]:
        raise ValueError("not square")
    got = {"diagonal": float(np.abs(np.diag(k) - 1).max()), "asymmetry": float(np.abs(k - k.T).max()), "low": float(k.min()), "high": float(k.max()), "least_eigenvalue": float(np.linalg.eigvalsh((k + k.T) / 2).min())}
    failed = [n for n, bad in (("diagonal", got["diagonal"] > diagonal), ("symmetry", got["asymmetry"] > symmetry), ("range", got["low"] < -inside or got["high"] > 1 + inside), ("positive semidefinite", got["least_eigenvalue"] < least)) if bad]
    if failed:
        raise ValueError(f"not a kernel: {', '.join(failed)}; {got}")
    return got


def entry_invariants(entries: DataFrame) -> DataFrame:
    """One row for entries (i, j, k): size, worst diagonal, worst asymmetry, range."""
    a, b = entries.alias("a"), entries.alias("b")
    met = a.join(b, (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i")), "left")
    return met.agg(F.count("*").alias("entries"), F.round(F.max(F.when(F.col("a.i") == F.col("a.j"), F.abs(F.col("a.k") - 1))), 6).alias("diagonal"), F.round(F.max(F.abs(F.col("a.k") - F.col("b.k"))), 6).alias("asymmetry"), F.sum(F.when(F.col("b.k").isNull(), 1).otherwise(0)).alias("unpaired"), F.round(F.min("a.k"), 6).alias("low"), F.round(F.max("a.k"), 6).alias("high"))


def cache_key(split: str, sizes: dict, seed: int, features: list[str], hashes: list[str]) -> str:
    return hashlib.sha256("|".join([split, repr(sorted(sizes.items())), str(seed), ",".join(sorted(features)), *hashes]).encode()).hexdigest()


class KernelCache:
    """Kernel entries under a content key, as Parquet in a shared folder; a hit must prove its size, hashes and diagonal."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, key: str, entries: DataFrame, meta: dict[str, str]) -> str:
        """Written whole under a fresh name before the key points to it."""
        path = f"{self.folder}/{key}/{uuid.uuid4().hex}"
        entries.select("i", "j", "k").write.parquet(path)
        self.spark.createDataFrame([(path, repr(sorted(meta.items())))], "path string, meta string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{key}/current")
        return path

    def get(self, key: str, meta: dict[str, str], rows: int, columns: int, tolerance: float = 1e-5) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            now = self.spark.read.parquet(f"{self.folder}/{key}/current").first()
            entries = self.spark.read.parquet(now.path)
        except AnalysisException:
            return None
        if now.meta != repr(sorted(meta.items())):
            return None
        got = entries.agg(F.count("*").alias("n"), F.max("i").alias("i"), F.max("j").alias("j"), F.sum(F.when(F.col("k").isNull() | F.isnan("k") | (F.abs("k") == float("inf")), 1).otherwise(0)).alias("bad"), F.max(F.when(F.col("i") == F.col("j"), F.abs(F.col("k") - 1))).alias("off")).first()
        whole = got.n == rows * columns and got.i == rows - 1 and got.j == columns - 1 and not got.bad
        return entries if whole and (rows != columns or (got.off or 0.0) <= tolerance) else None


def chunked_states(batches: Iterator[np.ndarray], reps: int = 2) -> Iterator[np.ndarray]:
    for b in batches:
        yield states(b, reps)


def fits(rows: int, qubits: int, limit: int = MAX_STATE_BYTES) -> bool:
    """Whether states and kernel of so many rows stay within the limit."""
    return 2 * rows * 2**qubits * 16 + 8 * rows * rows + 10 * 1048576 <= limit
