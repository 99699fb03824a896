"""Batch correction between two datasets of feature vectors (id, vec): covariance alignment, soft clustering, mutual neighbours, panorama."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..state import checkpointed
from . import blocks
from .metrics import apply_affine, moments
from .neighbors import mutual_nn
from .soft import soft_align


@dataclass
class Corrected:
    """Both sides after correction, and the features that took part (None: all)."""

    source: DataFrame
    target: DataFrame
    features: list[int] | None = None


def _arrays(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("vec").cast("array<double>").alias("vec"))


def _width(df: DataFrame) -> int:
    row = df.select(F.size("vec").alias("n")).first()
    return row["n"] if row else 0


# --- highly variable features ----------------------------------------------------------------------------------------


def feature_stats(rows: DataFrame) -> DataFrame:
    """feature, mean, var (population) over all rows, in long form."""
    return rows.select(F.posexplode(F.col("vec").cast("array<double>")).alias("feature", "x")).groupBy("feature").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def unit_rows(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row, ``unit``: whether every row's squared length is 1 within ``tolerance``; true for an empty table, and rows without a vector don't count."""
    return rows.agg(F.coalesce(F.bool_and(F.abs(V.dot(F.col("vec"), F.col("vec")) - 1) < tolerance), F.lit(True)).alias("unit"))


def highly_variable(rows: DataFrame, n: int, bins: int = 20) -> DataFrame:
    """feature, dispersion of the ``n`` features with the highest dispersion: variance against the variances of features with like means.

    Features without variance don't count. Bins are of equal width, closed on the right; a bin of one feature gives 0; ties go to the lower
    feature. Where means can't be binned (no feature varies, or a mean isn't finite) features rank by their variance alone, which then stands
    in ``dispersion``; variances that aren't numbers come last. n above the width is a ValueError.
    """
    if n > _width(rows):
        raise ValueError("more features wanted than there are")
    inf = float("inf")
    stats = feature_stats(rows)
    varies = F.nanvl("var", F.lit(inf)) > 0
    ends = stats.where(varies).agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    ends = ends.withColumn("binned", F.coalesce((F.abs(F.nanvl("lo", F.lit(inf))) < inf) & (F.abs(F.nanvl("hi", F.lit(inf))) < inf), F.lit(False)))
    s = stats.join(ends, F.lit(True)).where(varies | ~F.col("binned"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * (F.col("hi") - F.col("lo")) / bins))
    placed = s.withColumn("bin", F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < F.col("mean"))) - 1))
    w = Window.partitionBy("bin")
    z = (F.col("var") - F.avg("var").over(w)) / (F.stddev_samp("var").over(w) + 1e-6)
    score = F.when(F.col("binned"), F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0))).otherwise(F.nanvl("var", F.lit(-1.0)))
    return placed.withColumn("dispersion", score).orderBy(F.desc("dispersion"), "feature").limit(n).select("feature", "dispersion")


def _chosen(both: DataFrame, hvg: int | None) -> list[int] | None:
    return None if hvg is None else sorted(r["feature"] for r in highly_variable(both, hvg).collect())


def _take(df: DataFrame, features: list[int] | None) -> DataFrame:
    df = _arrays(df)
    return df if features is None else df.select("id", F.array(*[F.get("vec", F.lit(i)) for i in features]).alias("vec"))


def _paste(whole: DataFrame, part: DataFrame, features: list[int] | None) -> DataFrame:
    """Corrected features back into copies of the whole vectors."""
    if features is None:
        return part
    at = F.create_map(*[F.lit(x) for k, i in enumerate(features) for x in (i, k)])
    both = _arrays(whole).join(part.select("id", F.col("vec").alias("_p")), "id")
    return both.select("id", F.transform("vec", lambda x, i: F.coalesce(F.get("_p", F.try_element_at(at, i)), x)).alias("vec"))


# --- covariance alignment --------------------------------------------------------------------------------------------


def coral(source: DataFrame, target: DataFrame, eps: float = 1e-8) -> Corrected:
    """Source whitened by its covariance and coloured by the target's; means likewise. Moments on the executors, two eigenproblems on the driver."""
    if _width(source) != _width(target):
        raise ValueError("widths differ")

    def root(cov: np.ndarray, inverse: bool) -> np.ndarray:
        values, vectors = np.linalg.eigh(cov)
        values = np.maximum(values, 0)
        return (vectors * (1 / np.sqrt(values + eps) if inverse else np.sqrt(values))) @ vectors.T

    (n, ms, cs), (m, mt, ct) = moments(source), moments(target)
    cs, ct = (c * k / max(k - 1, 1) + eps * np.eye(len(c)) for c, k in ((cs, n), (ct, m)))
    return Corrected(apply_affine(_arrays(source), ms, root(cs, True) @ root(ct, False), mt), _arrays(target))


# --- mutual nearest neighbours ---------------------------------------------------------------------------------------


def cosine_rows(df: DataFrame) -> DataFrame:
    return df.select("id", V.l2_normalize(F.col("vec")).alias("vec"))


def _sum_vectors(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """key, s (sum of vec by position), n (rows, or sum of weights)."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    x = F.col("x") if weight is None else F.col("x") * F.col(weight)
    long = rows.select(key, *([weight] if weight else []), F.posexplode("vec").alias("pos", "x"))
    per = long.groupBy(key, "pos").agg(F.sum(x).alias("s"), n.alias("n"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("a"), F.max("n").alias("n")).select(key, F.transform("a", lambda e: e["s"]).alias("s"), "n")


def gathered(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, vec): for every row of ``rows`` the sum of w times the vector of j over its links (i, j, w); zeros without any."""
    rows = _arrays(rows)
    pulled = links.join(rows.select(F.col("id").alias("j"), "vec"), "j").select("i", "w", "vec")
    per = _sum_vectors(pulled, "i", "w").select(F.col("i").alias("id"), "s")
    return rows.join(per, "id", "left").select("id", F.coalesce("s", F.transform("vec", lambda x: x * 0)).alias("vec"))


def rescaled(rows: DataFrame) -> DataFrame:
    """(id, vec): z-scores of each feature over all rows (zero for a constant one), then rows of length 1."""
    moments_ = feature_stats(rows).agg(F.array_sort(F.collect_list(F.struct("feature", "mean", F.sqrt("var").alias("sd")))).alias("m"))
    z = F.zip_with("vec", "m", lambda x, f: F.when(f["sd"] > 0, (x - f["mean"]) / f["sd"]).otherwise(F.lit(0.0)))
    return _arrays(rows).join(F.broadcast(moments_)).select("id", V.l2_normalize(z).alias("vec"))


def mnn_vectors(ref: DataFrame, new: DataFrame, k: int, sigma: float = 1.0, sizes: tuple[int, int] | None = None) -> DataFrame:
    """id, corr: smoothed correction of each row of ``new`` from the mutual neighbours of two cosine-normalised sides.

    Pair vectors are averaged for each matched row; every row takes their mean with weights exp(-(1 - cosine) / sigma). Without any pair it is zero.
    """
    pairs = mutual_nn(ref, new, k, k, sizes=sizes)
    diff = pairs.join(ref.select(F.col("id").alias("i"), F.col("vec").alias("a")), "i").join(new.select(F.col("id").alias("j"), F.col("vec").alias("b")), "j")
    matched = _sum_vectors(diff.select("j", F.zip_with("a", "b", lambda x, y: x - y).alias("vec")), "j").select("j", F.transform("s", lambda x: x / F.col("n")).alias("c"))
    # Position and mean pair vector of each matched row travel as one vector.
    points = new.join(matched, new["id"] == matched["j"]).select("id", F.concat("vec", "c").alias("vec"))
    d = _width(new)

    def smooth(ids, x):
        total, weight = np.zeros(x.shape), np.zeros(len(x))

        def add(_, y, __):
            for s in blocks.strips(len(x), len(y)):
                w = np.exp(-(1 - x[s] @ y[:, :d].T) / sigma)
                total[s] += w @ y[:, d:]
                weight[s] += w.sum(axis=1)

        return add, lambda: [(ids, list(total), weight)]

    kind = "long" if dict(new.dtypes)["id"] in ("bigint", "int") else "string"
    points = checkpointed(points)
    parts, whole = blocks.swept(new, points, smooth, f"id {kind}, vec array<double>, w double", id_type=kind, sizes=(sizes[1] if sizes else new.count(), points.count()))
    if not whole:
        long = parts.select("id", "w", F.posexplode("vec").alias("pos", "x")).groupBy("id", "pos").agg(F.sum("x").alias("s"), F.sum("w").alias("w"))
        per = long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("a"), F.max("w").alias("w"))
        parts = per.select("id", F.transform("a", lambda e: e["s"]).alias("vec"), "w")
    smooth_rows = parts.select("id", F.transform("vec", lambda s: s / F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1.0))).alias("c"))
    zero = F.array_repeat(F.lit(0.0), d)
    return new.select("id").join(smooth_rows, "id", "left").select("id", F.coalesce("c", zero).alias("corr"))


#: Bins of the first pass of the weighted quantile, and of each further one.
FIRST_BINS, QUANTILE_BINS = 128, 64


def _exactly(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, by the same sums for equal rows wherever they lie."""
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 14):
        s = slice(a, a + (1 << 14))
        out[s] = (x[i[s]] * y[j[s]]).sum(axis=1)
    return out


def _apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows."""
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 14):
        s = slice(a, a + (1 << 14))
        out[s] = ((x[i[s]] - y[j[s]]) ** 2).sum(axis=1)
    return out


class _Lines:
    """A block of rows with a direction of length 1 each: where other rows lie along it, and how much they weigh, exp(-squared distance from the line / sigma).

    Places come from one matrix product, which rounds a pair differently from block to block; where ``slack`` decides, they are found again by ``_exactly``.
    """

    def __init__(self, base: np.ndarray, direction: np.ndarray, sigma: float):
        self.base, self.direction, self.sigma = base, np.ascontiguousarray(direction), sigma
        self.own, self.room = (self.direction * base).sum(axis=1), blocks.Room()
        self._left = np.hstack([2 * base, -(base * base).sum(axis=1)[:, None], np.full((len(base), 1), -1.0)]) / sigma
        self._along = np.hstack([self.direction, -self.own[:, None]])

    def met(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, tuple, float, slice]]:
        """Parts of some right rows, what their products need, their slack, and slices of this block: together small enough for a core's cache, as each number is touched some ten times."""
        for a in range(0, len(y), 512):
            part = y[a : a + 512]
            right, slack = self.step(part), self.slack(part)
            for i in range(0, len(self.base), 128):
                yield part, right, slack, slice(i, min(len(self.base), i + 128))

    def slack(self, y: np.ndarray) -> float:
        return 1e-14 * (y.shape[1] + 10) * float(np.sqrt((y * y).sum(axis=1).max(initial=0)) + np.abs(self.own).max(initial=0))

    def step(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the products of this block with some right rows need."""
        one = np.ones((len(y), 1))
        return np.hstack([y, one, (y * y).sum(axis=1)[:, None]]).T.copy(), np.hstack([y, one]).T.copy()

    def along(self, s: slice, right: tuple) -> np.ndarray:
        """Places beyond the rows' own."""
        return self.room.product(self._along[s], right[1], "along")

    def weights(self, s: slice, right: tuple, along: np.ndarray) -> np.ndarray:
        w = self.room.product(self._left[s], right[0], "weights")
        squares = np.multiply(along, along, out=self.room.get(*w.shape, "squares"))
        if self.sigma != 1:
            squares /= self.sigma
        w += squares
        np.minimum(w, 0, out=w)
        return np.exp(w, out=w)


def adjust_variance(ref: DataFrame, new: DataFrame, corr: DataFrame, sigma: float = 1.0) -> DataFrame:
    """``corr`` scaled, by 1 at least, to the reference's quantile at each row's weighted rank along its correction. Both sides are cosine-normalised.

    Nothing is collected or broadcast: a block of rows keeps its ranks and weighted histograms while all rows of the new side and then of the reference pass by, and knows then which of
    ``FIRST_BINS`` bins holds the wanted weight. Each further sweep of the reference looks into the rows' bins only, by ``QUANTILE_BINS`` bins that keep their least and greatest place,
    for the rows that aren't settled yet; a row is settled when its bin holds one value.
    """
    kind = "long" if dict(new.dtypes)["id"] in ("bigint", "int") else "string"
    length = V.norm(F.col("corr"))
    rows = new.join(corr, "id").withColumn("length", length).where("length > 0")
    lined = checkpointed(rows.select("id", F.concat("vec", F.transform("corr", lambda x: x / F.col("length")), F.array("length")).alias("vec")))
    n_rows, n_new = lined.count(), new.count()
    n_ref, reach = ref.agg(F.count(F.lit(1)), F.max(V.norm(F.col("vec")))).first()
    d = _width(new)
    edges = np.linspace(-1, 1, FIRST_BINS + 1) * ((reach or 1.0) * (1 + 1e-9))
    # A row's vector goes on with its correction's direction and length, then what is known of its quantile: goal, weight below the ends, ends.
    ddl, goal_at = f"id {kind}, vec array<double>", 2 * d + 1

    def first(ids, x):
        lines = _Lines(x[:, :d], x[:, d : 2 * d], sigma)
        below, among, weight = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x) * FIRST_BINS)
        per_unit = FIRST_BINS / (edges[-1] - edges[0])

        def add(_, rows, tag):
            for y, right, slack, s in lines.met(rows):
                along = lines.along(s, right)
                w = lines.weights(s, right, along)
                if not tag:
                    among[s] += w.sum(axis=1)
                    i, j = blocks.hits(np.abs(along) <= slack)
                    if len(i):
                        along[i, j] = np.where(_exactly(lines.direction[s], y, i, j) <= lines.own[s][i], -1.0, 1.0)
                    w *= along <= 0
                    below[s] += w.sum(axis=1)
                    continue
                along += lines.own[s, None] - edges[0]
                along *= per_unit
                cell = lines.room.get(*along.shape, "cell", np.int64)
                np.copyto(cell, along, casting="unsafe")
                along -= cell
                along -= 0.5
                np.abs(along, out=along)
                i, j = blocks.hits(along >= 0.5 - slack * per_unit)
                if len(i):
                    cell[i, j] = np.searchsorted(edges, _exactly(lines.direction[s], y, i, j), side="right") - 1
                cell += np.arange(s.stop - s.start)[:, None] * FIRST_BINS
                weight[s.start * FIRST_BINS : s.stop * FIRST_BINS] += np.bincount(cell.ravel(), w.ravel(), (s.stop - s.start) * FIRST_BINS)

        def done():
            up = np.cumsum(weight.reshape(-1, FIRST_BINS), axis=1)
            goal = below / among * up[:, -1]
            passed = up > goal[:, None]
            bin_ = passed.argmax(axis=1)
            before = np.where(bin_ > 0, up[np.arange(len(x)), np.maximum(bin_ - 1, 0)], 0)
            found = np.column_stack([goal, before, edges[bin_], np.nextafter(edges[bin_ + 1], -np.inf)])
            # Where rounding leaves no bin beyond the goal, it is the greatest value of all.
            found[~passed.any(axis=1)] = np.inf, 0, edges[0], edges[-1]
            yield ids, list(np.hstack([x, found]))

        return add, done

    def narrowed(ids, x):
        lines, size = _Lines(x[:, :d], x[:, d : 2 * d], sigma), QUANTILE_BINS + 1
        goal, before, lo, hi = x[:, goal_at:].T
        weight, low, high = np.zeros(len(x) * size), np.full(len(x) * size, np.inf), np.full(len(x) * size, -np.inf)

        def add(_, rows, __):
            for y, right, slack, s in lines.met(rows):
                along = lines.along(s, right)
                i, j = blocks.hits((along >= (lo - lines.own - slack)[s, None]) & (along <= (hi - lines.own + slack)[s, None]))
                p = _exactly(lines.direction[s], y, i, j)
                i += s.start
                ok = (p >= lo[i]) & (p <= hi[i])
                i, j, p = i[ok], j[ok], p[ok]
                w = np.exp(-np.maximum(_apart(lines.base, y, i, j) - (p - lines.own[i]) ** 2, 0) / sigma)
                at = np.clip(((p - lo[i]) / (hi[i] - lo[i]) * QUANTILE_BINS).astype(np.int64), 0, QUANTILE_BINS - 1)
                # The greatest value has a bin of its own, so that every pass parts the ends.
                cell = (i - s.start) * size + np.where(p == hi[i], QUANTILE_BINS, at)
                part = slice(s.start * size, s.stop * size)
                weight[part] += np.bincount(cell, w, (s.stop - s.start) * size)
                np.minimum.at(low[part], cell, p)
                np.maximum.at(high[part], cell, p)

        def done():
            shape, every = (len(x), size), np.arange(len(x))
            up = before[:, None] + np.cumsum(weight.reshape(shape), axis=1)
            passed = up > goal[:, None]
            none = ~passed.any(axis=1)
            bin_ = passed.argmax(axis=1)
            least, most = low.reshape(shape), high.reshape(shape)
            greatest = most.max(axis=1)
            under = np.where(bin_ > 0, up[every, np.maximum(bin_ - 1, 0)], before)
            ends = np.where(none, greatest, least[every, bin_]), np.where(none, greatest, most[every, bin_])
            yield ids, list(np.column_stack([x[:, :goal_at], goal, under, *ends]))

        return add, done

    def swept(left: DataFrame, right: DataFrame, fold: Callable, sizes: tuple[int, int]) -> DataFrame:
        return checkpointed(blocks.swept(left, right, fold, ddl, id_type=kind, sizes=sizes, whole=True)[0])

    # The new side passes by first.
    as_kind = lambda df, tag: df.select(F.col("id").cast(kind).alias("id"), "vec", F.lit(tag).alias("tag"))
    state = swept(lined, as_kind(new, 0).unionByName(as_kind(ref, 1)), first, (n_rows, n_new + n_ref))
    lo, hi = F.get("vec", F.lit(goal_at + 2)), F.get("vec", F.lit(goal_at + 3))
    done = None
    while True:
        vec, own_dir = F.slice("vec", 1, d), F.slice("vec", d + 1, d)
        ready = state.where(lo == hi).select("id", ((lo - V.dot(own_dir, vec)) / F.get("vec", F.lit(2 * d))).alias("beyond"))
        done = ready if done is None else done.unionByName(ready)
        state = state.where(lo < hi)
        left = state.count()
        if not left:
            break
        state = swept(state, ref, narrowed, (left, n_ref))
    scale = done.select("id", F.greatest("beyond", F.lit(1.0)).alias("scale"))
    return corr.join(scale, "id", "left").select("id", F.transform("corr", lambda x: x * F.coalesce("scale", F.lit(1.0))).alias("corr"))


def _without_bio(corr: DataFrame, span: np.ndarray) -> DataFrame:
    """Corrections without their part in the span of some directions (columns, orthonormal)."""
    return apply_affine(corr, np.zeros(len(span)), np.eye(len(span)) - span @ span.T, vec="corr")


def bio_span(rows: DataFrame, n: int) -> np.ndarray:
    """The first ``n`` principal directions of a side."""
    _, _, cov = moments(rows)
    values, vectors = np.linalg.eigh(cov)
    return vectors[:, np.argsort(-values)[:n]]


def mnn(reference: DataFrame, moved: DataFrame, k: int = 20, sigma: float = 1.0, hvg: int | None = None, variance: bool = True, svd_dim: int | None = None) -> Corrected:
    """Mutual-nearest-neighbour correction: the reference stays, the other side moves; both come back cosine-normalised.

    With ``hvg`` only that many features take part and are pasted into the original vectors. k is cut to the sides' sizes.
    """
    features = _chosen(_arrays(reference).unionByName(_arrays(moved)), hvg)
    ref, new = (checkpointed(cosine_rows(_take(x, features))) for x in (reference, moved))
    sizes = ref.count(), new.count()
    k = max(1, min(k, *sizes))
    corr = checkpointed(mnn_vectors(ref, new, k, sigma, sizes))
    if svd_dim:
        for side in (ref, new):
            corr = _without_bio(corr, bio_span(side, svd_dim))
    if variance:
        corr = adjust_variance(ref, new, corr, sigma)
    out = new.join(corr, "id").select("id", F.zip_with("vec", "corr", lambda x, y: x + y).alias("vec"))
    return Corrected(_paste(reference, ref, features), _paste(moved, out, features), features)


def mnn_many(batches: list[DataFrame], order: list[int] | None = None, **kw) -> list[DataFrame]:
    """Several batches: the first in ``order`` is the reference, which grows by each corrected batch. Ids must differ between batches."""
    order = order or list(range(len(batches)))
    if sorted(order) != list(range(len(batches))):
        raise ValueError("order must name every batch once")
    out: dict[int, DataFrame] = {}
    grown = _arrays(batches[order[0]])
    for i in order[1:]:
        got = mnn(grown, batches[i], **kw)
        out.setdefault(order[0], got.source)
        out[i] = got.target
        grown = got.source.unionByName(got.target)
    return [out.get(i, _arrays(batches[i])) for i in range(len(batches))]


# --- panorama --------------------------------------------------------------------------------------------------------


def panorama(datasets: list[DataFrame], k: int = 20, alpha: float = 0.1, hvg: int | None = None, lexical_columns: bool = False) -> tuple[list[DataFrame], list[int] | None]:
    """Every dataset's rows step towards their mutual neighbours (cosine) in all other datasets: x += alpha * sum(partner - x), from the original positions at once.

    Rows are L2-normalised. Each two datasets are matched once (k is cut to their sizes); all steps are summed in one pass over the links, keyed by
    dataset and id, so ids may repeat between datasets. Without mutual neighbours nothing moves; one dataset alone is only normalised.
    ``lexical_columns`` pastes features in the order of their numbers as text, as a scrambled table would have them; the default keeps each in its place.
    Returns the corrected datasets and the features that took part (None: all).
    """
    features = None
    if hvg is not None:
        pool = _arrays(datasets[0])
        for d in datasets[1:]:
            pool = pool.unionByName(_arrays(d))
        features = _chosen(pool, hvg)
    units = [checkpointed(cosine_rows(_take(d, features))) for d in datasets]
    sizes = [u.count() for u in units]
    tagged = [u.select(F.struct(F.lit(n).alias("ds"), "id").alias("key"), "vec") for n, u in enumerate(units)]
    rows, links = tagged[0], None
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    for i, j in combinations(range(len(units)), 2):
        near = max(1, min(k, sizes[i], sizes[j]))
        one, other = F.struct(F.lit(i).alias("ds"), F.col("i").alias("id")), F.struct(F.lit(j).alias("ds"), F.col("j").alias("id"))
        met = mutual_nn(units[i], units[j], near, near, metric="cosine", sizes=(sizes[i], sizes[j])).select(F.explode(F.array(F.struct(one.alias("me"), other.alias("you")), F.struct(other.alias("me"), one.alias("you")))).alias("l")).select("l.*")
        links = met if links is None else links.unionByName(met)
    moved = rows
    if links is not None:
        pairs = links.join(rows.select(F.col("key").alias("me"), F.col("vec").alias("x")), "me").join(rows.select(F.col("key").alias("you"), F.col("vec").alias("y")), "you")
        steps = _sum_vectors(pairs.select("me", F.zip_with("x", "y", lambda x, y: y - x).alias("vec")), "me").select(F.col("me").alias("key"), "s")
        moved = rows.join(steps, "key", "left").select("key", F.coalesce(F.zip_with("vec", "s", lambda x, y: x + F.lit(alpha) * y), F.col("vec")).alias("vec"))
    out = [moved.where(F.col("key.ds") == n).select("key.id", "vec") for n in range(len(units))]
    if lexical_columns and features is not None:
        place = sorted(range(len(features)), key=str)
        out = [x.select("id", F.array(*[F.get("vec", F.lit(i)) for i in place]).alias("vec")) for x in out]
    return [_paste(d, x, features) for d, x in zip(datasets, out, strict=True)], features


def scanorama(source: DataFrame, target: DataFrame, **kw) -> Corrected:
    """``panorama`` of two sides."""
    (x, y), features = panorama([source, target], **kw)
    return Corrected(x, y, features)


# --- soft clustering -------------------------------------------------------------------------------------------------


def harmony(source: DataFrame, target: DataFrame, **kw) -> Corrected:
    """Maximum-diversity soft clustering of both sides with linear correction (``soft.soft_align``'s options), over any number of rows."""
    side = lambda df, n: _arrays(df).select(F.struct(F.lit(n).alias("side"), "id").alias("key"), F.lit(n).alias("batch"), "vec")
    got = soft_align(side(source, "0").unionByName(side(target, "1")), **kw).rows
    return Corrected(*(got.where(F.col("key.side") == n).select("key.id", "vec") for n in ("0", "1")))


#: Correction methods by name; each takes (source, target, **options).
METHODS: dict[str, Callable[..., Corrected]] = {"CORAL": coral, "Harmony": harmony, "MNN": mnn, "Scanorama": scanorama}
