"""Structured Streaming forms of incremental ingestion, windows and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.detection import assign


def follow(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 16) -> DataFrame:
    """Files of a folder as they come; those seen before are skipped by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, width: str, keys: list[str], lateness: str, slide: str | None = None) -> DataFrame:
    """Counts per window and keys; rows later than *lateness* are left out. Works on streams and tables."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, time: str, gap: str, keys: list[str], lateness: str) -> DataFrame:
    """Counts per session: rows of a key not further than *gap* apart."""
    return events.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), "n")


def latest_status(events: DataFrame, key: str, status: str, time: str) -> DataFrame:
    """The status of each key by event time, whatever the order of arrival."""
    return events.groupBy(key).agg(F.max_by(status, time).alias(status), F.max(time).alias(time))


def upsert_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to *merge*; stops when all that's there is done."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _iou(a: list[float], b: list[float]) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def track_frame(state: dict, frame: int, boxes: list[tuple[int, list[float]]], threshold: float = 0.5, most_lost: int = 2, optimal: bool = False) -> tuple[dict, list[tuple[int, int]]]:
    """One frame of an overlap tracker: the new state and (box id, track id) of each box.

    A box takes the free track whose last box it overlaps most, at least *threshold*, pairs in order of
    overlap; others begin a track. With *optimal* the pairs are those of the assignment of least total cost instead, one
    less the overlap each. Tracks not met for more than *most_lost* frames end.
    """
    tracks = dict(state.get("tracks", {}))
    if optimal and boxes and tracks:
        ids = sorted(tracks)
        overlaps = np.array([[_iou(box, tracks[t]["box"]) for t in ids] for _, box in boxes])
        best = {(boxes[i][0], ids[j]) for i, j in assign(1 - overlaps)}
    pairs = sorted(((_iou(box, t["box"]), -bid, -tid) for bid, box in boxes for tid, t in tracks.items() if not optimal or (bid, tid) in best), reverse=True)
    taken, used, out = {}, set(), []
    for o, bid, tid in pairs:
        if o >= threshold and -bid not in taken and -tid not in used:
            taken[-bid] = -tid
            used.add(-tid)
    following = state.get("next", 0)
    for bid, box in boxes:
        if bid not in taken:
            taken[bid], following = following, following + 1
        tracks[taken[bid]] = {"box": box, "frame": frame}
        out.append((bid, taken[bid]))
    return {"tracks": {k: t for k, t in tracks.items() if frame - t["frame"] <= most_lost}, "next": following}, out


def track(frames: DataFrame, threshold: float = 0.5, most_lost: int = 2, idle_ms: int | None = None, optimal: bool = False) -> DataFrame:
    """Track ids over a stream of boxes: video, frame, box_id, x0, y0, x1, y1 -> video, frame, box_id, track_id.

    Keyed state per video holds the live tracks only. With *idle_ms* videos that stay silent for so long
    are dropped; that needs a query that goes on, as an availableNow query with such a timeout never ends.
    """
    import json

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        held = {"tracks": {int(k): v for k, v in held.get("tracks", {}).items()}, "next": held.get("next", 0)}
        rows = pd.concat(list(parts)).sort_values(["frame", "box_id"])
        out = []
        for frame, group in rows.groupby("frame"):
            boxes = [(int(r.box_id), [float(r.x0), float(r.y0), float(r.x1), float(r.y1)]) for r in group.itertuples()]
            held, found = track_frame(held, int(frame), boxes, threshold, most_lost, optimal)
            out += [(key[0], int(frame), b, t) for b, t in found]
        state.update((json.dumps(held),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["video", "frame", "box_id", "track_id"])

    return frames.groupBy("video").applyInPandasWithState(run, "video bigint, frame bigint, box_id bigint, track_id bigint", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def parquet_upsert(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For upsert_batches: merges each batch into a table of *keys* that is written whole under `version=<batch>`.

    A batch that is run again after a failure writes the same version again from the one before it, so nothing is merged twice.
    The last version is read by latest_version.
    """
    from ..operators.relational import upsert

    def merge(rows: DataFrame, batch: int) -> None:
        before = [v for v in _versions(rows.sparkSession, folder) if v < batch]
        once = rows.dropDuplicates(keys)
        old = rows.sparkSession.read.parquet(f"{folder}/version={max(before)}") if before else None
        (once if old is None else upsert(old, once, keys)).write.mode("overwrite").parquet(f"{folder}/version={batch}")

    return merge


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath() for s in system.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The table that parquet_upsert has written last; none raises ValueError."""
    there = _versions(spark, folder)
    if not there:
        raise ValueError(f"{folder} has no version")
    return spark.read.parquet(f"{folder}/version={there[-1]}")
