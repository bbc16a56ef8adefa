"""Geometric verification of matched pairs: seeded RANSAC with a homography or an affine model."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs with fewer matches have no inliers.
LEAST_MATCHES = 5
MODELS = {"homography": 4, "affine": 3}


def fit_affine(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """The affine map of ``p`` to ``q`` in least squares, as a 3 x 3 matrix."""
    a = np.c_[p, np.ones(len(p))]
    if np.linalg.matrix_rank(a) < 3:
        return None
    m = np.linalg.lstsq(a, q, rcond=None)[0]
    return np.vstack([m.T, [0, 0, 1]])


def fit_homography(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """The homography of ``p`` to ``q`` by the direct linear transform on normalised points."""

    def normal(x: np.ndarray) -> np.ndarray | None:
        c = x.mean(axis=0)
        s = np.sqrt(((x - c) ** 2).sum(axis=1)).mean()
        return None if s < 1e-9 else np.array([[np.sqrt(2) / s, 0, -np.sqrt(2) / s * c[0]], [0, np.sqrt(2) / s, -np.sqrt(2) / s * c[1]], [0, 0, 1]])

    t, u = normal(p), normal(q)
    if t is None or u is None:
        return None
    x, y = (np.c_[p, np.ones(len(p))] @ t.T), (np.c_[q, np.ones(len(q))] @ u.T)
    zero = np.zeros_like(x)
    rows = np.concatenate([np.c_[zero, -x, y[:, 1:2] * x], np.c_[x, zero, -y[:, 0:1] * x]])
    _, s, v = np.linalg.svd(rows)
    if len(s) >= 8 and s[7] < 1e-9:
        return None  # points on a line do not fix the map
    h = np.linalg.inv(u) @ v[-1].reshape(3, 3) @ t
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def residuals(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each mapped point to its counterpart."""
    x = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.sqrt(((x[:, :2] / x[:, 2:3] - q) ** 2).sum(axis=1))
    return np.where(np.isfinite(r), r, np.inf)


def ransac(p: np.ndarray, q: np.ndarray, model: str = "homography", threshold: float = 5.0, max_trials: int = 1000, seed: int = 0) -> np.ndarray:
    """Inlier mask of the best model found; all false below ``LEAST_MATCHES`` or if no model fits."""
    n, need = len(p), MODELS[model]
    none = np.zeros(n, bool)
    if n < LEAST_MATCHES:
        return none
    fit = fit_homography if model == "homography" else fit_affine
    rng = np.random.default_rng(seed)
    best, trials, at = none, max_trials, 0
    while at < trials:
        at += 1
        pick = rng.choice(n, need, replace=False)
        h = fit(p[pick], q[pick])
        if h is None:
            continue
        ok = residuals(h, p, q) <= threshold
        if ok.sum() > best.sum():
            best = ok
            share = min(max((ok.sum() / n) ** need, 1e-12), 1 - 1e-12)
            trials = min(max_trials, int(np.ceil(np.log(0.005) / np.log(1 - share))) + at)
    if best.sum() >= need:
        h = fit(p[best], q[best])
        if h is not None:
            again = residuals(h, p, q) <= threshold
            best = again if again.sum() >= best.sum() else best
    return best


def _verify(model: str, threshold: float, max_trials: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        table = table.sort_by([("query_idx", "ascending"), ("train_idx", "ascending")])
        p = np.c_[table.column("xa").to_numpy(), table.column("ya").to_numpy()].astype(float)
        q = np.c_[table.column("xb").to_numpy(), table.column("yb").to_numpy()].astype(float)
        key = int.from_bytes(hashlib.blake2b(f"{seed}|{a}|{b}".encode(), digest_size=8).digest())
        n = int(ransac(p, q, model, threshold, max_trials, key).sum())
        return pa.table([pa.array([a]), pa.array([b]), pa.array([len(p)], pa.int32()), pa.array([n], pa.int32())], names=["a", "b", "n_matches", "n_inliers"])

    return run


def with_keypoints(matched: DataFrame, keypoints: DataFrame) -> DataFrame:
    """``matched`` with ``xa, ya, xb, yb`` of ``keypoints (image_name, idx, x, y)``.

    A match with a keypoint that is null, NaN or infinite has no place and is left out.
    """
    finite = lambda c: F.abs(F.col(c)) < float("inf")  # noqa: E731 - false for NaN, which Spark orders last
    k = keypoints.select("image_name", "idx", "x", "y").filter(finite("x") & finite("y"))
    a = k.select(F.col("image_name").alias("a"), F.col("idx").alias("query_idx"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = k.select(F.col("image_name").alias("b"), F.col("idx").alias("train_idx"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    return matched.join(a, ["a", "query_idx"]).join(b, ["b", "train_idx"])


def verify(pairs: DataFrame, matched: DataFrame, keypoints: DataFrame, model: str = "homography", threshold: float = 5.0, max_trials: int = 1000, seed: int = 0, min_inliers: int | None = None) -> DataFrame:
    """``(a, b, sim, n_matches, n_inliers)`` of every pair ``(a, b, sim)``; no matches mean no inliers.

    A group holds the matches of one pair of images, at most as many as one of them has
    descriptors. Seeds come from the names, so the result does not depend on partitioning.
    ``min_inliers`` filters the result if given.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {tuple(MODELS)}")
    points = with_keypoints(matched, keypoints).select("a", "b", "query_idx", "train_idx", "xa", "ya", "xb", "yb")
    done = points.groupBy("a", "b").applyInArrow(_verify(model, threshold, max_trials, seed), "a string, b string, n_matches int, n_inliers int")
    full = pairs.select("a", "b", "sim").join(done, ["a", "b"], "left").fillna(0, ["n_matches", "n_inliers"])
    return full if min_inliers is None else full.filter(F.col("n_inliers") >= min_inliers)


def model_inliers(matched: DataFrame, keypoints: DataFrame, h: list[list[float]], threshold: float = 5.0) -> DataFrame:
    """``(a, b, n_matches, n_inliers)``: matches a given 3 x 3 map sends within ``threshold``, by expressions alone."""
    rows = with_keypoints(matched, keypoints)
    x, y = F.col("xa").cast("double"), F.col("ya").cast("double")
    u, v, w = (F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) for r in h)
    du, dv = u / w - F.col("xb").cast("double"), v / w - F.col("yb").cast("double")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(du * du + dv * dv <= threshold * threshold).alias("n_inliers"))


def resize_dims(images: DataFrame, longer: int = 1200) -> DataFrame:
    """``images (w, h)`` with ``new_w, new_h``: the longer side becomes ``longer``, the other is rounded half to even."""
    wide = F.col("w") > F.col("h")
    other_h = F.bround(F.col("h") * longer / F.col("w")).cast("int")
    other_w = F.bround(F.col("w") * longer / F.col("h")).cast("int")
    return images.withColumn("new_w", F.when(wide, F.lit(longer)).otherwise(other_w)).withColumn("new_h", F.when(wide, other_h).otherwise(F.lit(longer)))
