"""Sequence encoders: functions from sequences to vectors, applied in Arrow batches.

Pretrained networks are injected: any callable from a list of strings to a matrix can be given to ``encode_column``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strings import ALPHABET

# BLOSUM62 (Henikoff and Henikoff 1992), lower triangle in the order of ALPHABET without the gap.
_ORDER = "ARNDCQEGHILKMFPSTWYV"
_LOWER = """4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4"""


def substitution_matrix(lower: str = _LOWER, order: str = _ORDER) -> np.ndarray:
    """A lower triangle as a symmetric 21 x 21 matrix in ALPHABET's order: shifted to be positive, scaled to 1; the gap's diagonal is the least."""
    n = len(order)
    m = np.zeros((n, n))
    for i, line in enumerate(lower.strip().splitlines()):
        m[i, : i + 1] = [float(x) for x in line.split()]
    m = m + np.tril(m, -1).T
    at = [order.index(a) for a in ALPHABET[:-1]]
    m = m[np.ix_(at, at)]
    m += abs(m.min()) + 1
    m /= m.max()
    out = np.zeros((n + 1, n + 1))
    out[:n, :n] = m
    out[n, n] = m.diagonal().min()
    return out


def principal_code(matrix: np.ndarray, d: int) -> np.ndarray:
    """The first ``d`` principal components of a matrix's rows; each component's largest entry is positive."""
    c = matrix - matrix.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt[:d] * np.sign(vt[np.arange(d), np.abs(vt[:d]).argmax(axis=1)])[:, None]
    return c @ vt.T


def gap_padded(seq: str, length: int) -> str:
    if len(seq) > length:
        raise ValueError(f"a sequence of {len(seq)} residues is longer than {length}")
    left = (len(seq) + 1) // 2
    return seq[:left] + "-" * (length - len(seq)) + seq[left:]


def substitution_encoder(length: int = 30, d: int = 4, code: np.ndarray | None = None) -> Callable[[list[str]], np.ndarray]:
    """Gap-padded sequences as concatenated residue codes (length * d numbers). Null, unknown residues and sequences longer than ``length`` give NaN, which ``encode_column`` makes null."""
    table = principal_code(substitution_matrix(), d) if code is None else code
    place = {a: k for k, a in enumerate(ALPHABET)}

    def encode(seqs: list[str]) -> np.ndarray:
        at = np.full((len(seqs), length), -1)
        for i, s in enumerate(seqs):
            if s is not None and len(s) <= length:
                at[i] = [place.get(a, -1) for a in gap_padded(s, length)]
        out = table[at].reshape(len(seqs), -1)
        out[(at < 0).any(axis=1)] = np.nan
        return out

    return encode


def factor_encoder(factors: dict[str, list[float]], length: int) -> Callable[[list[str]], np.ndarray]:
    """Residue factors (a table with one row a residue), cut or zero-padded to ``length``; unknown residues are zeros."""
    d = len(next(iter(factors.values())))

    def encode(seqs: list[str]) -> np.ndarray:
        out = np.zeros((len(seqs), length, d))
        for i, s in enumerate(seqs):
            for k, a in enumerate((s or "")[:length]):
                out[i, k] = factors.get(a, [0.0] * d)
        return out.reshape(len(seqs), -1)

    return encode


def mean_pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token vectors (n, t, d) over the true entries of ``mask`` (n, t), special tokens included if the mask has them."""
    m = mask[..., None].astype(float)
    return (tokens * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def encode_column(df: DataFrame, seq: str, encoder: Callable[[list[str]], np.ndarray], out: str = "vec", batch: int = 2048) -> DataFrame:
    """``df`` with the encoder's vectors as array<double>; the encoder gets at most ``batch`` sequences at a time. Null sequences and rows that the encoder fills with NaN are null."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            seqs, rows = col.to_pylist(), []
            for i in range(0, len(seqs), batch):
                part = seqs[i : i + batch]
                given = [s for s in part if s is not None]
                got = iter(np.asarray(encoder(given), float) if given else [])
                vectors = [None if s is None else next(got) for s in part]
                rows += [None if v is None or (len(v) and np.isnan(v).all()) else v for v in vectors]
            yield pa.array(rows, pa.list_(pa.float64()))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "array<double>")(F.col(seq)))


#: Residues that the default encoder takes, by the column that it encodes: the longest CDR3, and the longest variable domain of either chain.
DEFAULT_LENGTH = {"cdr3": 30, "full_seq": 160}


def default_encoder(column: str = "full_seq") -> Callable[[list[str]], np.ndarray]:
    return substitution_encoder(DEFAULT_LENGTH[column])
