"""Image quality: score, class, problems and processing plan from measured metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import QUALITY as Q


def suggested_scale(glyph: Column) -> Column:
    return F.coalesce(F.least(F.greatest(Q["glyph"] / F.nullif(glyph, F.lit(0.0)), F.lit(1.0)), F.lit(Q["max_scale"])), F.lit(1.0))


def illumination_spread(pixels: DataFrame, keys: list[str], tiles: int = 4) -> DataFrame:
    """Population deviation of the tiles' 90th percentiles; pixels: keys, pos, n (places of the image), value."""
    tile = F.floor(F.col("pos") * tiles / F.col("n")).cast("int")
    return pixels.withColumn("tile", tile).groupBy(*keys, "tile").agg(F.percentile("value", 0.9).alias("p90")).groupBy(*keys).agg(F.stddev_pop("p90").alias("illumination"))


def quality_score(metrics: DataFrame) -> DataFrame:
    """Adds quality_score and quality_level to rows with glyph, blur, contrast, noise, skew, illumination."""
    glyph, skew = F.col("glyph"), F.abs("skew")
    lost = (
        F.when(glyph < 8, 30).when(glyph < 16, 15).otherwise(0) + F.when(F.col("blur") < Q["severe_blur"], 25).when(F.col("blur") < Q["blur"], 10).otherwise(0)
        + F.when(F.col("contrast") < Q["contrast"], 20).otherwise(0) + F.when(F.col("noise") > Q["noise"], 15).otherwise(0)
        + F.when(skew > 5, 10).when(skew > Q["skew"], 5).otherwise(0) + F.when(F.col("illumination") > Q["illumination"], 10).otherwise(0)
    )
    score = F.greatest(F.lit(0.0), F.lit(100.0) - lost)
    level = F.when(glyph < 5, "IRRECOVERABLE_RISK").when(score >= 85, "GOOD").when(score >= 65, "FAIR").when(score >= 40, "POOR").otherwise("CRITICAL")
    return metrics.withColumn("quality_score", score).withColumn("quality_level", level)


def problems() -> Column:
    found = [
        ("LOW_TEXT_SCALE", F.col("glyph") < Q["glyph"]), ("LOW_CONTRAST", F.col("contrast") < Q["contrast"]), ("HIGH_NOISE", F.col("noise") > Q["noise"]),
        ("UNEVEN_ILLUMINATION", F.col("illumination") > Q["illumination"]), ("SKEW", F.abs("skew") > Q["skew"]), ("LOW_TEXT_BACKGROUND_SEPARATION", F.col("bimodality") < Q["bimodality"]),
    ]
    return F.filter(F.array(*[F.when(when, name) for name, when in found]), lambda x: x.isNotNull())


def plan(metrics: DataFrame) -> DataFrame:
    """The operations that an image needs, from its metrics."""
    return metrics.select(
        "*", suggested_scale(F.col("glyph")).alias("scale"), (F.col("noise") > Q["noise"]).alias("denoise"), (F.col("illumination") > Q["illumination"]).alias("correct_illumination"),
        (F.col("contrast") < Q["contrast"]).alias("clahe"), F.lit(False).alias("sharpen"), (F.abs("skew") > Q["skew"]).alias("deskew"), (F.col("bimodality") < Q["bimodality"]).alias("binarize_candidate"),
    )


def bimodality(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Largest between-class share of the variance over all thresholds (Otsu's), from counts (keys, level, n)."""
    from pyspark.sql import Window

    up = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    total, s1, s2 = F.sum("n").over(whole), F.sum(F.col("n") * F.col("level")).over(whole), F.sum(F.col("n") * F.col("level") * F.col("level")).over(whole)
    rows = histogram.withColumn("w", F.sum("n").over(up) / total).withColumn("m", F.sum(F.col("n") * F.col("level")).over(up) / total).withColumn("mean", s1 / total).withColumn("var", s2 / total - (s1 / total) * (s1 / total))
    between = F.pow(F.col("mean") * F.col("w") - F.col("m"), F.lit(2)) / F.nullif(F.col("w") * (1 - F.col("w")), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("w") < 1, between)) / F.nullif(F.max("var"), F.lit(0.0)), F.lit(0.0)).alias("bimodality"))
