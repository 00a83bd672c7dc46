"""Array work on one item at a time: curves, grids, spectra, peaks, components. Each function works on numpy arrays; the
DataFrame functions apply it to the rows of a key with Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of curves and points that a task takes at once.
BUCKET_ROWS = 1 << 18


def pchip_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the nodes of a monotone cubic: weighted harmonic means, one-sided at the ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(d) == 1:
        return np.array([d[0], d[0]])
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if m * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(m) > 3 * abs(d0) else m

    return np.concatenate(([end(h[0], h[1], d[0], d[1])], inner, [end(h[-1], h[-2], d[-1], d[-2])]))


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The monotone cubic at ``at``; beyond the ends the outer pieces go on."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    m, k = pchip_slopes(x, y), np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    t = (at - x[k]) / h
    return (2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * h * m[k] + (3 * t**2 - 2 * t**3) * y[k + 1] + (t**3 - t**2) * h * m[k + 1]


def pchip_all(x: np.ndarray, y: np.ndarray, first: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``pchip`` of many curves at once: curve c has the nodes first[c] to first[c + 1], and at[i] is a place on curve of[i]."""
    size = np.diff(first)
    order = np.lexsort((np.repeat((0, 1), (len(x), len(at))), np.concatenate((x, at)), np.concatenate((np.repeat(np.arange(len(size)), size), of))))
    before = np.empty(len(order), dtype=np.int64)  # nodes of this curve and those before it that are not beyond a place
    before[order] = np.cumsum(order < len(x))
    k = np.maximum(first[of], np.minimum(before[len(x) :] - 1, first[of + 1] - 2))
    m = np.zeros(len(x))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        h = np.diff(x)
        d = np.diff(y) / h
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        m[1:-1] = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        two, more = first[:-1][size == 2], size > 2
        m[two] = m[two + 1] = d[two]
        for node, i, j in ((first[:-1][more], 0, 1), (first[1:][more] - 1, -1, -2)):
            h0, h1, d0, d1 = h[node + i], h[node + j], d[node + i], d[node + j]
            end = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[node] = np.where(end * d0 <= 0, 0.0, np.where((d0 * d1 <= 0) & (abs(end) > 3 * abs(d0)), 3 * d0, end))
        n = np.minimum(k + 1, len(x) - 1)
        h = x[n] - x[k]
        t = (at - x[k]) / h
        out = (2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * h * m[k] + (3 * t**2 - 2 * t**3) * y[n] + (t**3 - t**2) * h * m[n]
    return np.where(size[of] == 1, y[first[of]], out)


def resample_curves(nodes: DataFrame, points: DataFrame, *, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, x, y): each key's curve through its nodes, at its points. Of nodes at one place that of the least y counts.

    Keys meet in buckets of about BUCKET_ROWS rows, whose curves are taken at once.
    """
    kind = dict(nodes.dtypes)[key]
    nodes = nodes.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = points.select(F.col(key).cast(kind).alias("k"), F.col(x).cast("double").alias("x"))
    buckets = 1 + (nodes.count() + points.count()) // BUCKET_ROWS
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("bucket")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        codes = pa.chunked_array([*left.column("k").chunks, *right.column("k").chunks], left.schema.field("k").type).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        curve, of = codes[:n].astype(np.int64), codes[n:].astype(np.int64)
        at, px, py = (c.to_numpy().astype(float) for c in (right.column("x"), left.column("x"), left.column("y")))
        order = np.lexsort((py, px, curve))
        curve, px, py = curve[order], px[order], py[order]
        same = (curve[1:] == curve[:-1]) & ((px[1:] == px[:-1]) | (np.isnan(px[1:]) & np.isnan(px[:-1])))
        one = np.concatenate((np.ones(min(n, 1), bool), ~same))
        curve, px, py = curve[one], px[one], py[one]
        first = np.searchsorted(curve, np.arange(codes.max(initial=-1) + 2))
        have = np.flatnonzero(np.diff(first)[of] > 0)
        values = pchip_all(px, py, first, at[have], of[have]) if len(have) else np.zeros(0)
        return pa.table([right.column("k").take(pa.array(have)), pa.array(at[have]), pa.array(values)], names=[key, x, y])

    return nodes.select(bucket, "*").groupBy("bucket").cogroup(points.select(bucket, "*").groupBy("bucket")).applyInArrow(run, f"`{key}` {kind}, `{x}` double, `{y}` double")


def spline_coefficients(values: np.ndarray) -> np.ndarray:
    """Control points of the uniform cubic B-spline through ``values`` along the first axis, with natural ends: two more."""
    n = len(values)
    if n == 1:
        return np.concatenate([values] * 3)
    a = np.zeros((n + 2, n + 2))
    for i in range(n):
        a[i + 1, i : i + 3] = (1 / 6, 2 / 3, 1 / 6)
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    right = np.concatenate((np.zeros((1, *values.shape[1:])), values, np.zeros((1, *values.shape[1:]))))
    return np.linalg.solve(a, right.reshape(n + 2, -1)).reshape(right.shape)


def _weights(at: np.ndarray, n: int, margin: float) -> np.ndarray:
    """Weights of the n + 2 control points at places of the unit interval."""
    u = (at - margin) / (1 - 2 * margin) * (n - 1)
    k = np.clip(np.floor(u).astype(int), 0, n - 2)
    t = u - k
    w = np.stack(((1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3), axis=1) / 6
    out = np.zeros((len(at), n + 2))
    np.put_along_axis(out, k[:, None] + np.arange(4), w, axis=1)
    return out


def spline_grid(values: np.ndarray, at: np.ndarray, margins: tuple[float, ...] = (0.0, 0.0, 0.0)) -> np.ndarray:
    """A parameter grid (z, y, x) at rows x, y, z of the unit cube. Axes of one node don't matter."""
    c, out = values.astype(float), None
    weights = []
    for axis, n in enumerate(values.shape):
        if n > 1:
            c = np.moveaxis(spline_coefficients(np.moveaxis(c, axis, 0)), 0, axis)
            weights.append(_weights(at[:, 2 - axis], n, margins[2 - axis]))
        else:
            weights.append(np.ones((len(at), 1)))
    out = np.einsum("pi,pj,pk,ijk->p", *weights, c, optimize=True)
    return out


def resize_grid(values: np.ndarray, dims: tuple[int, int, int], margins: tuple[float, ...] = (0.0, 0.0, 0.0)) -> np.ndarray:
    """The grid sampled at i / (n - 1) along each axis."""
    axes = [np.linspace(0, 1, n) if n > 1 else np.array([0.5]) for n in dims]
    z, y, x = np.meshgrid(*axes, indexing="ij")
    return spline_grid(values, np.stack((x.ravel(), y.ravel(), z.ravel()), axis=1), margins).reshape(dims)


def shells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fourier shell correlation of two cubic maps, up to half their size."""
    n = a.shape[0]
    fa, fb = np.fft.rfftn(a), np.fft.rfftn(b)
    axes = [np.fft.fftfreq(n) * n] * (a.ndim - 1) + [np.fft.rfftfreq(n) * n]
    r = np.sqrt(sum(x**2 for x in np.meshgrid(*axes, indexing="ij")))
    inside = r < n // 2
    r, fa, fb = r[inside], fa[inside], fb[inside]
    low = r.astype(int)
    w = r - low

    def sums(v: np.ndarray) -> np.ndarray:
        return np.bincount(low, v * (1 - w), n // 2 + 1) + np.bincount(low + 1, v * w, n // 2 + 1)

    return (sums((fa * fb.conj()).real) / np.maximum(1e-6, np.sqrt(sums(abs(fa) ** 2) * sums(abs(fb) ** 2))))[: n // 2]


def corrected_fsc(masked: np.ndarray, randomised: np.ndarray, from_shell: int) -> np.ndarray:
    """(m - r) / (1 - r) from two shells after the first randomised one on."""
    out = masked.astype(float).copy()
    k = np.arange(len(out)) >= from_shell + 2
    out[k] = ((masked - randomised) / np.where(randomised == 1, 1e-9, 1 - randomised))[k]
    return out


def randomise_phases(volume: np.ndarray, from_shell: int, seed: int) -> np.ndarray:
    """Phases beyond the shell replaced by random ones, amplitudes kept."""
    f = np.fft.rfftn(volume)
    n = volume.shape[0]
    axes = [np.fft.fftfreq(n) * n] * (volume.ndim - 1) + [np.fft.rfftfreq(n) * n]
    r = np.sqrt(sum(x**2 for x in np.meshgrid(*axes, indexing="ij")))
    phase = np.random.default_rng(seed).uniform(0, 2 * np.pi, f.shape)
    return np.fft.irfftn(np.where(r > from_shell, abs(f) * np.exp(1j * phase), f), volume.shape, axes=range(volume.ndim))


def guinier(resolution: np.ndarray, amplitude: np.ndarray, low: float, high: float) -> float:
    """B factor: four times the slope of ln(amplitude) over 1 / d^2 between two resolutions in Angstroms."""
    keep = (resolution <= low) & (resolution >= high) & (amplitude > 0)
    return float(4 * np.polyfit(1 / resolution[keep] ** 2, np.log(amplitude[keep]), 1)[0])


def local_peaks(image: np.ndarray, reach: int, threshold: float) -> np.ndarray:
    """Places, a row each, that are over the threshold and greater than all within ``reach``; of equal ones the first."""
    flat = np.arange(image.size).reshape(image.shape)
    best = np.ones(image.shape, dtype=bool)
    for step in np.ndindex(*(2 * reach + 1,) * image.ndim):
        d = np.array(step) - reach
        if not d.any() or (d**2).sum() > reach**2:
            continue
        here = tuple(slice(max(0, -k), n - max(0, k)) for k, n in zip(d, image.shape, strict=True))
        there = tuple(slice(max(0, k), n - max(0, -k)) for k, n in zip(d, image.shape, strict=True))
        best[here] &= (image[here] > image[there]) | ((image[here] == image[there]) & (flat[here] < flat[there]))
    return np.argwhere(best & (image > threshold))


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 on of the pixels' components, joined by edges, in order of their first pixel; 0 outside."""
    label = np.where(mask > 0, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for axis in range(mask.ndim):
            a, b = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
            a[axis], b[axis] = slice(None, -1), slice(1, None)
            a, b = tuple(a), tuple(b)
            both = (new[a] > 0) & (new[b] > 0)
            low = np.minimum(new[a], new[b])
            new[a] = np.where(both, low, new[a])
            new[b] = np.where(both, np.minimum(low, new[b]), new[b])
        flat = np.concatenate(([0], new.ravel()))
        new = np.where(new > 0, flat[new], 0)  # to the root of the root
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1].reshape(mask.shape) + (0 if (label == 0).any() else 1)


def find_peaks(slices: DataFrame, *, key: str, width: str, data: str, reach: int, threshold: float) -> DataFrame:
    """(key, x, y, value) of the local peaks of each row's image."""
    kind = dict(slices.dtypes)[key]

    def run(frames):
        for frame in frames:
            out = []
            for k, w, d in zip(frame[key], frame[width], frame[data], strict=True):
                image = np.asarray(d, dtype=float).reshape(-1, w)
                out += [(k, int(x), int(y), float(image[y, x])) for y, x in local_peaks(image, reach, threshold)]
            yield pd.DataFrame(out, columns=[key, "x", "y", "value"])

    return slices.select(key, width, data).mapInPandas(run, f"`{key}` {kind}, x int, y int, value double")


def search_defocus(frequency: np.ndarray, power: np.ndarray, *, voltage: float, cs: float, amplitude: float, low: float, high: float, step: float = 0.01) -> tuple[float, float]:
    """Defocus in micrometres, and score, of the curve that best fits a background-free power spectrum."""
    from math import pi

    v = voltage * 1e3
    wave = 12.2643247 / np.sqrt(v * (1 + 0.978466e-6 * v))
    target = (power - power.mean()) / max(power.std(), 1e-12)
    best = (low, -np.inf)
    for d in np.arange(low, high + step / 2, step):
        arg = pi * wave * (-d * 1e4) * frequency**2 + pi / 2 * cs * 1e7 * wave**3 * frequency**4
        curve = abs(amplitude * np.cos(arg) - np.sqrt(1 - amplitude**2) * np.sin(arg))
        score = float((target * (curve - curve.mean()) / max(curve.std(), 1e-12)).mean())
        if score > best[1]:
            best = (float(d), score)
    return best


def fit_defocus(spectra: DataFrame, *, key: str, frequency: str, power: str, nodes: int = 6, **settings: float) -> DataFrame:
    """(key, defocus, score): for each spectrum, a background through means of its parts is taken off, then the search."""
    kind = dict(spectra.dtypes)[key]

    def run(frames):
        for frame in frames:
            out = []
            for k, f, p in zip(frame[key], frame[frequency], frame[power], strict=True):
                f, p = np.asarray(f, float), np.asarray(p, float)
                parts = np.array_split(np.arange(len(f)), nodes)
                background = pchip(np.array([f[x].mean() for x in parts]), np.array([p[x].mean() for x in parts]), f)
                out.append((k, *search_defocus(f, p - background, **settings)))
            yield pd.DataFrame(out, columns=[key, "defocus", "score"])

    return spectra.select(key, frequency, power).mapInPandas(run, f"`{key}` {kind}, defocus double, score double")


def composite(voxels: DataFrame, *, voxel: str = "voxel", worst: float = 1000.0) -> DataFrame:
    """(voxel, map_id, half1, half2): each voxel from the map of best local resolution, the lower id of equal ones."""
    rows = voxels.filter(F.col("resolution") < worst)
    pick = F.min_by(F.struct("map_id", "half1", "half2"), F.struct("resolution", "map_id"))
    return rows.groupBy(voxel).agg(pick.alias("_b")).select(voxel, "_b.*")


def principal_components(points: DataFrame, *, vector: str, n: int, rounds: int = 20) -> np.ndarray:
    """The first components of centred vectors, one at a time, orthogonal to earlier ones.

    Every round is one aggregation: scores and their weighted sums are added up in Spark, only a vector comes back.
    """
    size = len(points.select(vector).first()[0])
    mean = np.array(points.agg(F.array(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in range(size)]).alias("m")).first()["m"])
    out = np.zeros((0, size))
    rng = np.random.default_rng(42)
    for _ in range(n):
        v = rng.normal(size=size)
        for _ in range(rounds):
            v -= out.T @ (out @ v)
            v /= np.linalg.norm(v)
            score = F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, v.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - F.lit(float(mean @ v))
            sums = points.select(score.alias("s"), vector).agg(F.array(*[F.sum(F.col("s") * (F.get(F.col(vector), F.lit(i)) - F.lit(float(mean[i])))) for i in range(size)]).alias("v")).first()["v"]
            v = np.array(sums)
        v -= out.T @ (out @ v)
        out = np.vstack((out, v / np.linalg.norm(v)))
    return out
