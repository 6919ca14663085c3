"""Timelines sampled between their keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eased(easing: Column, x: Column) -> Column:
    """How far a move has come at a share ``x`` of its time."""
    both = F.when(x < 0.5, 4 * F.pow(x, F.lit(3.0))).otherwise(1 - F.pow(2 - 2 * x, F.lit(3.0)) / 2)
    return F.when(easing == "easeInOut", both).when(easing == "easeOut", 1 - F.pow(1 - x, F.lit(4.0))).otherwise(x)


def sample_timelines(keyframes: DataFrame, samples: DataFrame, start: tuple[float, float, float] = (0.0, 0.0, 1.0), still: bool = False) -> DataFrame:
    """(scene, sample, at_ms, keyframe, camera_active, x, y, zoom, values) of each sample (scene, sample, at_ms).

    Keyframes are (scene, keyframe, at_ms, easing, camera, level): ``camera`` a struct (x, y, zoom) or null, ``level`` an array of
    doubles (opacities and the like). A sample lies between the last keyframe before it and the first one at or after it, whose
    easing counts; after the last keyframe it stays there. Zoom moves by its logarithm. Before the first keyframe a move
    comes from ``start`` and from the keyframe's own levels. ``still`` jumps to the keyframe. A scene without keyframes gives
    the start. Keyframes of one time follow each other by name.

    Both neighbours come from one merge of samples and keyframes, forwards and backwards: nothing is joined by range.
    """
    k = F.struct("keyframe", F.col("at_ms").alias("at"), "easing", "camera", "level")
    none = F.lit(None)
    rows = samples.select("scene", "at_ms", "sample", none.alias("k"), F.lit(0).alias("key"), none.cast("string").alias("name"))
    rows = rows.withColumn("k", none.cast(keyframes.select(k.alias("k")).schema["k"].dataType)).unionByName(
        keyframes.select("scene", "at_ms", none.cast(samples.schema["sample"].dataType).alias("sample"), k.alias("k"), F.lit(1).alias("key"), F.col("keyframe").cast("string").alias("name"))
    )
    ahead = Window.partitionBy("scene").orderBy("at_ms", "key", "name")
    back = Window.partitionBy("scene").orderBy(F.desc("at_ms"), F.desc("key"), F.desc("name"))
    # At one time samples come before keyframes, so a keyframe at that very time is the next one.
    both = rows.withColumn("prev", F.last("k", True).over(ahead)).withColumn("next", F.last("k", True).over(back)).where("key = 0")
    target, source = F.coalesce("next", "prev"), F.col("prev")
    both = both.withColumns({"target": target, "source": source})
    t, s = F.col("target"), F.col("source")
    since = F.coalesce(s["at"], F.lit(0))
    share = F.when(F.col("next").isNull() | (t["at"] <= since), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at_ms") - since) / (t["at"] - since))))
    both = both.withColumn("amount", F.when(F.lit(still), 1.0).otherwise(eased(t["easing"], share)))
    a = F.col("amount")
    move = lambda x, y: x + (y - x) * a
    camera = lambda i, f: F.coalesce(s["camera"][f], F.lit(start[i]))
    on = t["camera"].isNotNull()
    shown = lambda i, f: F.when(on, move(camera(i, f), t["camera"][f])).otherwise(start[i])
    zoom = F.when(on, F.exp(move(F.log(camera(2, "zoom")), F.log(t["camera"]["zoom"])))).otherwise(start[2])
    level = F.zip_with(F.coalesce(s["level"], t["level"]), t["level"], move)
    return both.select("scene", "sample", "at_ms", t["keyframe"].alias("keyframe"), F.coalesce(on, F.lit(False)).alias("camera_active"), shown(0, "x").alias("x"), shown(1, "y").alias("y"), zoom.alias("zoom"), level.alias("values"))
