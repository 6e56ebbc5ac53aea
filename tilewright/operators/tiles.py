"""Tile grids, quality gates and their reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.hashing import require_columns


def tile_grid(slides: DataFrame, tile: int = 256, overlap: int = 0, magnification: float = 20.0) -> DataFrame:
    """All tile origins of each slide (``slide_id, width, height, objective_power``); the range's end is exclusive.

    A slide exactly one tile wide has none. An unknown objective power counts as the target's.
    """
    require_columns(slides, "slide_id", "width", "height", "objective_power")
    ds = F.coalesce(F.col("objective_power").cast("double") / F.lit(float(magnification)), F.lit(1.0))
    sized = slides.withColumn("t", F.floor(F.lit(tile) * ds).cast("int")).withColumn("s", F.floor(F.lit(tile - overlap) * ds).cast("int"))
    sized = sized.where((F.col("width") > F.col("t")) & (F.col("height") > F.col("t")))
    along = lambda extent: F.explode(F.sequence(F.lit(0), F.col(extent) - F.col("t") - 1, F.col("s")))
    return sized.withColumn("x", along("width")).withColumn("y", along("height")).select("slide_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def tile_name(slide: str = "slide_id", x: str = "x", y: str = "y") -> Column:
    return F.format_string("%s_%d_%d.png", F.col(slide).cast("string"), x, y)


def keep_tile(df: DataFrame, min_tissue: float = 0.5, min_laplacian: float = 15.0) -> DataFrame:
    """The tiling gate: tissue first, then sharpness."""
    return df.where((F.col("tissue_fraction") >= min_tissue) & (F.col("laplacian_var") >= min_laplacian))


def reject_reason(max_background: float = 0.8, min_laplacian: float = 15.0, max_pen: float | None = 0.05) -> Column:
    """The first rule that fails (background, blur, pen), or NULL."""
    out = F.when(F.col("background_fraction") > max_background, "background").when(F.col("laplacian_var") < min_laplacian, "blur")
    return out if max_pen is None else out.when(F.col("pen_fraction") > max_pen, "pen")


def quality_filter(df: DataFrame, max_background: float = 0.8, min_laplacian: float = 15.0, max_pen: float | None = 0.05) -> DataFrame:
    """Rows that no rule rejects."""
    return df.where(reject_reason(max_background, min_laplacian, max_pen).isNull())


def quality_stats(df: DataFrame, *by: str, **limits) -> DataFrame:
    """``total``, ``kept`` and ``filtered`` in one pass."""
    reason = reject_reason(**limits)
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(reason.isNull()).alias("kept"), F.count_if(reason.isNotNull()).alias("filtered"))


def reject_counts(df: DataFrame, **limits) -> DataFrame:
    return df.groupBy(F.coalesce(reject_reason(**limits), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def normalize_report(df: DataFrame, error: str = "error", **limits) -> DataFrame:
    """``processed, filtered, normalized, errors``: a row with an error is neither filtered nor normalised."""
    bad, reason = F.col(error).isNotNull(), reject_reason(**limits)
    return df.agg(F.count("*").alias("processed"), F.count_if(~bad & reason.isNotNull()).alias("filtered"), F.count_if(~bad & reason.isNull()).alias("normalized"), F.count_if(bad).alias("errors"))


def norm_coords(df: DataFrame, most: float = 10000.0) -> DataFrame:
    return df.withColumns({"nx": F.col("x") / F.lit(float(most)), "ny": F.col("y") / F.lit(float(most))})


def _metrics(rgb: np.ndarray) -> tuple[float, float, float, float]:
    """Tissue, sharpness, background and pen marks of one (h, w, 3) image."""
    c = rgb.astype(np.float64)
    gray = np.round(c @ [0.299, 0.587, 0.114])
    high, low = c.max(axis=2), c.min(axis=2)
    spread = high - low
    sat = np.round(np.divide(spread * 255, high, out=np.zeros_like(high), where=high > 0))
    safe = np.where(spread > 0, spread, 1)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    hue = np.where(high == r, (g - b) / safe % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 30
    hue = np.where(spread > 0, np.round(hue), 0)
    p = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray
    pen = (sat > 150) & (((hue > 100) & (hue < 130)) | ((hue > 40) & (hue < 80)) | (hue < 10) | (hue > 170))
    return float((sat > 15).mean()), float(laplacian.var()), float((gray > 240).mean()), float(pen.mean())


def pixel_metrics(images: DataFrame) -> DataFrame:
    """Quality metrics of images of Spark's image source (``image`` struct, channels blue, green, red)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for origin, h, w, n, data in pdf.itertuples(index=False):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rows.append((origin, *_metrics(px[..., [0, 0, 0]] if n == 1 else px[..., 2::-1])))
            yield pd.DataFrame(rows, columns=["origin", "tissue_fraction", "laplacian_var", "background_fraction", "pen_fraction"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "origin string, tissue_fraction double, laplacian_var double, background_fraction double, pen_fraction double")
