"""Coverage report over a symbol -> asset manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, round_to

MANIFEST_ENTRY = "struct<available:boolean,source:string,placeholder:boolean,error:boolean>"


def asset_coverage(manifest: DataFrame) -> DataFrame:
    """Symbols and their share per asset source (E12); ``manifest`` has (key, value) rows."""
    entry = F.col("value")
    kind = (
        F.when(entry["available"], entry["source"])
        .when(entry["placeholder"], "placeholder")
        .otherwise("error")
    )
    total = manifest.agg(F.count("*")).scalar()
    counted = manifest.groupBy(kind.alias("asset_source")).agg(F.count("*").alias("symbols"))
    share = round_to(ratio(F.col("symbols"), total) * 100, 1)
    return counted.withColumn("share_pct", share)


def asset_summary(manifest: DataFrame) -> DataFrame:
    """All symbols, those with a real asset, and their share."""
    counts = manifest.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("value")["available"], F.lit(False))).alias("real_assets"),
    )
    return counts.withColumn("real_pct", round_to(ratio("real_assets", "total") * 100, 1))
