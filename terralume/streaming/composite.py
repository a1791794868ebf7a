"""Composites of scenes as they arrive, and reviewer answers as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_composite(events: DataFrame, time: str = "ts", keys=("user_id", "event_type"), value: str = "value", late: str = "1 day", min_obs: int = 5) -> DataFrame:
    """Mean, count and extremes of each key and day; days close when the watermark has passed them.

    Works on a stream and on a batch alike. The state of an open day is a few numbers a key.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    got = rows.groupBy(F.window(time, "1 day"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return got.select(F.col("window.start").alias("day"), *keys, "n", F.when(F.col("n") >= min_obs, F.col("mean")).alias("mean"), "low", "high")


def best_scene(scenes: DataFrame, quality: DataFrame, span: str = "7 days", late: str = "1 day", within: str = "1 day") -> DataFrame:
    """(start, tile, scene_id, cloud_pct): the scene of least cloud, then id, of each tile and span, once the span is closed.

    ``scenes`` (scene_id, tile, ts) and ``quality`` (q_scene, cloud_pct, seen) meet by scene, a
    record being of use if it is seen within ``within`` of the scene. On streams both sides carry a watermark
    of ``late``: later rows are passed over, open scenes and spans are the only state, and
    repeated rows change nothing. Works on a batch alike.
    """
    if scenes.isStreaming:
        scenes, quality = scenes.withWatermark("ts", late), quality.withWatermark("seen", late)
    met = scenes.join(quality, F.expr(f"scene_id = q_scene AND seen >= ts AND seen <= ts + INTERVAL {within}"))
    best = met.groupBy(F.window("ts", span), "tile").agg(F.min(F.struct("cloud_pct", "scene_id")).alias("best"))
    return best.select(F.col("window.start").alias("start"), "tile", "best.scene_id", "best.cloud_pct")


def answers(lines: DataFrame, more: str = "") -> DataFrame:
    """(content, done, error) of newline-delimited JSON chunks of a reviewer's answer, and ``more`` of their fields."""
    chunk = F.from_json("value", "message struct<content:string>, done boolean, error string" + (f", {more}" if more else ""))
    rest = [F.col(f"c.{f.split()[0]}") for f in more.split(",") if f]
    return lines.select(chunk.alias("c")).select(F.coalesce("c.message.content", F.lit("")).alias("content"), F.coalesce("c.done", F.lit(False)).alias("done"), F.col("c.error").alias("error"), *rest)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take what there is and stop; a rerun resumes after what was already taken."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
