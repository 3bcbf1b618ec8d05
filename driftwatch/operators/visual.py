"""Comparison of decoded images held as one row with red, green and blue arrays.

An image row has ``width``, ``height`` and ``r``, ``g``, ``b`` (arrays of 0-255
in row order). All measures are computed inside the row, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.html import let
from driftwatch.functions.text import fixed

CHANNELS = ("r", "g", "b")

# Thresholds and weights of the comparison.
SENSITIVITY = 0.1
MIN_REGION_PIXELS = 100
SIGNIFICANT_BELOW = 0.8
PIXEL_WEIGHT, HISTOGRAM_WEIGHT = 0.7, 0.3


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma of a pixel as an integer."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def grey_values(r: Column, g: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: grey(p["r"], p["g"], p["b"]))


def _difference(channel: str) -> Column:
    return F.zip_with(F.col(f"old_{channel}"), F.col(f"new_{channel}"), lambda a, b: F.abs(a - b))


def pixel_similarity(pairs: DataFrame) -> DataFrame:
    """Adds ``pixel_similarity``: 1 minus the mean channel difference over 255."""
    means = [_sum(F.transform(_difference(c), lambda d: d.cast("double"))) / F.size(f"old_{c}") for c in CHANNELS]
    return pairs.withColumn("pixel_similarity", 1.0 - (means[0] + means[1] + means[2]) / 3 / 255.0)


def histogram(values: Column) -> Column:
    """Counts of the values 0-255 of one channel, from the runs of its sorted values."""
    ordered = F.concat(F.array_sort(values), F.array(F.lit(256)))
    start = F.struct(
        F.lit(-1).alias("value"), F.lit(0).alias("n"), F.array().cast("array<struct<value:int,n:int>>").alias("runs")
    )

    def step(acc: Column, v: Column) -> Column:
        same = acc["value"] == v
        return F.struct(
            v.alias("value"),
            F.when(same, acc["n"] + 1).otherwise(1).alias("n"),
            F.when(same | (acc["value"] < 0), acc["runs"])
            .otherwise(F.concat(acc["runs"], F.array(F.struct(acc["value"].alias("value"), acc["n"].alias("n")))))
            .alias("runs"),
        )

    counts = F.map_from_entries(F.aggregate(ordered, start, step, lambda acc: acc["runs"]))
    every = F.sequence(F.lit(0), F.lit(255))
    return let(counts, lambda m: F.transform(every, lambda v: F.coalesce(F.element_at(m, v), F.lit(0))))


def histograms(images: DataFrame) -> DataFrame:
    """Adds ``histogram``: the counts of the three channels one after another."""
    return images.withColumn("histogram", F.concat(*[histogram(F.col(c)) for c in CHANNELS]))


def _centred(values: Column) -> Column:
    return let(values, lambda a: let(_sum(a) / F.size(a), lambda m: F.transform(a, lambda x: x - m)))


def _correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays, null where one is constant."""

    def score(x: Column, y: Column) -> Column:
        across = _sum(F.zip_with(x, y, lambda p, q: p * q))
        spread = _sum(F.transform(x, lambda p: p * p)) * _sum(F.transform(y, lambda q: q * q))
        return let(spread, lambda d: F.when(d > 0, across / F.sqrt(d)))

    return let(_centred(a), lambda x: let(_centred(b), lambda y: score(x, y)))


def histogram_correlation(pairs: DataFrame) -> DataFrame:
    """Adds ``histogram_correlation``: correlation of the normalised histograms, 0 to 1."""

    def shares(side: str) -> Column:
        counts = F.concat(*[histogram(F.col(f"{side}_{c}")) for c in CHANNELS])
        return F.transform(counts, lambda x: x.cast("double") / (3 * F.size(f"{side}_r")))

    score = _correlation(shares("old"), shares("new"))
    return pairs.withColumn("histogram_correlation", F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))


def label_regions(mask: np.ndarray, min_pixels: int) -> list[dict[str, int]]:
    """Connected components (by edges) of a row-by-column mask with more than ``min_pixels`` pixels.

    Rows are cut into runs of marked pixels; runs of neighbouring rows that overlap are joined by union-find, so the
    time is linear in the pixels but for a logarithm.
    """
    height, width = mask.shape
    step = width + 1
    marks = np.zeros((height, step), np.int8)  # an unmarked column parts the rows
    marks[:, :width] = mask
    edges = np.diff(marks.ravel(), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    low = np.searchsorted(ends, starts + step, side="right")
    met = np.maximum(np.searchsorted(starts, ends + step, side="left") - low, 0)
    upper = np.repeat(np.arange(len(starts)), met)
    lower = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(low, met)
    root = np.arange(len(starts))
    while True:
        one, other = root[upper], root[lower]
        apart = one != other
        if not apart.any():
            break
        upper, lower, one, other = upper[apart], lower[apart], one[apart], other[apart]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root != root[root]).any():
            root = root[root]
    _, label = np.unique(root, return_inverse=True)
    n = int(label.max()) + 1 if len(label) else 0
    y, left, right = starts // step, starts % step, ends - 1 - starts // step * step
    area = np.bincount(label, ends - starts, n).astype(np.int64)
    x0, y0, x1, y1 = np.full(n, width), np.full(n, height), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.minimum.at(x0, label, left), np.minimum.at(y0, label, y), np.maximum.at(x1, label, right), np.maximum.at(y1, label, y)
    kept = sorted(np.flatnonzero(area > min_pixels).tolist(), key=lambda k: (y0[k], x0[k]))
    return [
        {"x": int(x0[k]), "y": int(y0[k]), "width": int(x1[k] - x0[k]), "height": int(y1[k] - y0[k]), "area": int(area[k])}
        for k in kept
    ]


def changed_regions(
    pairs: DataFrame, min_pixels: int = MIN_REGION_PIXELS, sensitivity: float = SENSITIVITY
) -> DataFrame:
    """Adds ``changed_regions``: connected shapes of more than ``min_pixels`` changed pixels, from the top down.

    Each region has the bounding box of its pixels and their number. Pixels are connected by edges. Only the marks of
    changed pixels leave the JVM. Images without pixels, or null ones, have no regions.
    """

    @F.pandas_udf("array<struct<x:int,y:int,width:int,height:int,area:int>>")
    def regions(marks: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for row, w in zip(marks, width):
            empty = row is None or not len(row) or not w > 0
            out.append([] if empty else label_regions(np.asarray(row, bool).reshape(-1, int(w)), min_pixels))
        return pd.Series(out)

    differences = grey_values(*[_difference(c) for c in CHANNELS])
    changed = F.transform(differences, lambda v: F.coalesce(v > int(255 * sensitivity), F.lit(False)))
    return pairs.withColumn("changed_regions", regions(changed, F.col("width")))


def visual_diff(pairs: DataFrame, min_pixels: int = MIN_REGION_PIXELS) -> DataFrame:
    """Adds similarity, difference, significance and a summary of each image pair."""
    measured = changed_regions(histogram_correlation(pixel_similarity(pairs)), min_pixels)
    blend = F.col("pixel_similarity") * PIXEL_WEIGHT + F.col("histogram_correlation") * HISTOGRAM_WEIGHT
    scored = measured.withColumn("similarity_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))).withColumn(
        "difference_percentage", (1.0 - F.col("similarity_score")) * 100
    )
    s = F.col("similarity_score")
    share = F.concat(F.lit(" visual changes detected ("), fixed(F.col("difference_percentage"), 1), F.lit("% difference"))
    counted = F.concat(share, F.lit(", "), F.size("changed_regions").cast("string"), F.lit(" regions)"))
    summary = (
        F.when(s >= 0.99, "No significant visual changes detected")
        .when(s >= 0.95, F.concat(F.lit("Minor"), share, F.lit(")")))
        .when(s >= 0.8, F.concat(F.lit("Moderate"), counted))
        .when(s >= 0.5, F.concat(F.lit("Significant"), counted))
        .otherwise(F.concat(F.lit("Major"), counted))
    )
    return scored.withColumns({"has_significant_change": s < SIGNIFICANT_BELOW, "change_summary": summary})


def visual_fingerprint(images: DataFrame) -> DataFrame:
    """Adds size, channel means, brightness and contrast of each image."""

    def mean(values: Column) -> Column:
        return _sum(F.transform(values, lambda v: v.cast("double"))) / F.size(values)

    staged = images.withColumns(
        {
            "aspect_ratio": F.col("width") / F.col("height"),
            "total_pixels": F.col("width") * F.col("height"),
            **{f"{c}_mean": mean(F.col(c)) for c in CHANNELS},
            "_grey": grey_values(*[F.col(c) for c in CHANNELS]),
        }
    )
    variance = let(
        mean(F.col("_grey")), lambda m: _sum(F.transform("_grey", lambda v: (v - m) * (v - m))) / F.size("_grey")
    )
    return staged.withColumns(
        {
            "brightness": (F.col("r_mean") + F.col("g_mean") + F.col("b_mean")) / 3 / 255,
            "contrast": F.sqrt(variance) / 255,
        }
    ).drop("_grey")


def viewport_pairs(current: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Current captures beside their baseline per site and viewport; none gives nulls."""
    fields = [*CHANNELS, "width", "height"]
    old = baselines.select(*keys, *[F.col(c).alias(f"old_{c}") for c in fields])
    new = current.select(*keys, *[F.col(c).alias(f"new_{c}") for c in CHANNELS], "width", "height")
    return new.join(old, keys, "left")


def screenshot_hash(content: Column) -> Column:
    """Digest of the bytes of a screenshot."""
    return F.sha2(content, 256)
