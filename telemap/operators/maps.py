"""Map tables: placed points, labels and colours on them, and map alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.functions.text import UNLABELLED
from telemap.operators.bags import number_rows


def valid_points(points: DataFrame) -> DataFrame:
    return points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def placement(points: DataFrame) -> DataFrame:
    """Whether any point is unplaced, and how many are placed."""
    return points.agg(
        F.coalesce(F.bool_or(F.col("x").isNull() & F.col("y").isNull()), F.lit(False)).alias(
            "any_unplaced"
        ),
        F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n_placed"),
        F.count(F.lit(1)).alias("n_points"),
    )


def search_points(points: DataFrame, text: str, col: str = "hover_text") -> DataFrame:
    return points.filter(F.lower(col).contains(text.lower()))


def label_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Cluster labels onto points; points without one are unlabelled."""
    return points.join(labels.select("cluster", F.col("label").alias("_l")), "cluster", "left").select(
        *points.columns, F.coalesce(F.nullif("_l", F.lit("")), F.lit(UNLABELLED)).alias("label")
    )


def label_dictionary(top: DataFrame, col: str) -> DataFrame:
    """Label to colour rank, in the order of ``top``; the unlabelled bucket comes last.

    ``top`` is a top-k report: k rows.
    """
    ranked = number_rows(top.orderBy(F.desc("n"), F.asc(col)), "rank").select(
        F.col(col).alias("label"), F.col("rank").cast("long").alias("rank")
    )
    rest = ranked.agg(F.count(F.lit(1)).alias("rank")).select(
        F.lit(UNLABELLED).alias("label"), F.col("rank")
    )
    return ranked.unionByName(rest)


def rank_points(points: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Colour rank of each point's label."""
    return points.join(dictionary.select("label", "rank"), "label", "left")


def common_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points placed in both maps, side by side."""
    return (
        valid_points(a)
        .select("id", F.col("x").alias("x1"), F.col("y").alias("y1"))
        .join(valid_points(b).select("id", F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    )


def procrustes_moments(common: DataFrame) -> DataFrame:
    """Counts, means, squared norms and cross products of two maps, in one aggregate."""
    n = F.count(F.lit(1))
    return common.agg(
        n.alias("n"),
        F.avg("x1").alias("mean_x1"),
        F.avg("y1").alias("mean_y1"),
        F.avg("x2").alias("mean_x2"),
        F.avg("y2").alias("mean_y2"),
        (n * (F.var_pop("x1") + F.var_pop("y1"))).alias("norm2_a"),
        (n * (F.var_pop("x2") + F.var_pop("y2"))).alias("norm2_b"),
        (n * F.covar_pop("x1", "x2")).alias("cross_xx"),
        (n * F.covar_pop("x1", "y2")).alias("cross_xy"),
        (n * F.covar_pop("y1", "x2")).alias("cross_yx"),
        (n * F.covar_pop("y1", "y2")).alias("cross_yy"),
    )


def procrustes(a: DataFrame, b: DataFrame, scale_to: str = "first") -> DataFrame:
    """Align map ``b`` to map ``a``: ``(id, x1, y1, x2, y2)``.

    Both are centred and brought to unit norm, ``b`` is rotated (a reflection is
    allowed), and both are scaled to the norm of the map ``scale_to`` names.  The
    driver sees eleven numbers; the maps are rewritten by one affine select.
    """
    common = common_points(a, b)
    m = procrustes_moments(common).first()
    norm_a, norm_b = np.sqrt(m["norm2_a"]), np.sqrt(m["norm2_b"])
    if not (norm_a > 0 and norm_b > 0):
        raise ValueError("both maps need at least two distinct common points")
    cross = np.array([[m["cross_xx"], m["cross_xy"]], [m["cross_yx"], m["cross_yy"]]])
    left, _, right = np.linalg.svd(cross)
    turn = left @ right
    size = {"first": norm_a, "second": norm_b, "unit": 1.0}[scale_to]
    sa, sb = float(size / norm_a), float(size / norm_b)
    dx, dy = F.col("x2") - m["mean_x2"], F.col("y2") - m["mean_y2"]
    return common.select(
        "id",
        ((F.col("x1") - m["mean_x1"]) * sa).alias("x1"),
        ((F.col("y1") - m["mean_y1"]) * sa).alias("y1"),
        ((dx * float(turn[0, 0]) + dy * float(turn[0, 1])) * sb).alias("x2"),
        ((dx * float(turn[1, 0]) + dy * float(turn[1, 1])) * sb).alias("y2"),
    )


def map_table(
    points: DataFrame,
    labels: DataFrame,
    hover: DataFrame,
    colour: DataFrame | None = None,
) -> DataFrame:
    """Everything a viewer needs for one map: id, x, y, label, hover text, colour value."""
    out = (
        valid_points(points)
        .join(labels.select("id", "label"), "id", "left")
        .join(hover.select("id", "hover_text"), "id", "left")
        .withColumn("label", F.coalesce("label", F.lit(UNLABELLED)))
    )
    if colour is None:
        return out.select("id", "x", "y", "label", "hover_text", F.lit(None).cast("double").alias("colour"))
    return out.join(colour.select("id", "colour"), "id", "left").select(
        "id", "x", "y", "label", "hover_text", "colour"
    )


def compare_maps(a: DataFrame, b: DataFrame, meta: DataFrame, scale_to: str = "first") -> DataFrame:
    """Two aligned maps side by side with labels and hover text."""
    return procrustes(a, b, scale_to).join(meta.select("id", "label", "hover_text"), "id", "left")
