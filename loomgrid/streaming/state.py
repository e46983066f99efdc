"""State machines over ordered frames: a greedy tracker and a running depth normaliser.

Each is one pure step function, used by a batch operator (one clip is one group) and by a Structured
Streaming operator with the same state, so both give the same rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class TrackerConfig:
    """Limits of the tracker; ``alpha`` weighs the past."""

    reach: float = 0.25
    alpha: float = 0.6
    hold: int = 0
    max_missing: int = 5
    max_tracks: int = 8


def track_step(state: dict, found: list[tuple[float, float]], cfg: TrackerConfig) -> tuple[dict, list[tuple[int, float, float, int]]]:
    """Next state and the shown tracks (track, x, y, missed) after one frame's detections.

    Tracks choose in the order in which they began, each its nearest free detection within reach; a
    matched track moves by a moving average, though it is looked for where it was last seen. New
    tracks begin while there is room; tracks missed too often end.
    """
    tracks = [dict(t) for t in state.get("tracks", [])]
    free = dict(enumerate(found))
    for t in tracks:
        near = min(free, key=lambda i: ((free[i][0] - t["cx"]) ** 2 + (free[i][1] - t["cy"]) ** 2, i), default=None)
        if near is not None and (free[near][0] - t["cx"]) ** 2 + (free[near][1] - t["cy"]) ** 2 <= cfg.reach**2:
            x, y = free.pop(near)
            t |= {"x": cfg.alpha * t["x"] + (1 - cfg.alpha) * x, "y": cfg.alpha * t["y"] + (1 - cfg.alpha) * y, "cx": x, "cy": y, "miss": 0}
        else:
            t["miss"] += 1
    tracks = [t for t in tracks if t["miss"] <= cfg.max_missing]
    new = state.get("next", 0)
    for x, y in free.values():
        if len(tracks) >= cfg.max_tracks:
            break
        tracks.append({"id": new, "x": x, "y": y, "cx": x, "cy": y, "miss": 0})
        new += 1
    shown = [(t["id"], t["x"], t["y"], t["miss"]) for t in tracks if t["miss"] <= cfg.hold]
    return {"tracks": tracks, "next": new}, shown


_OUT = "frame long, track int, x double, y double, missed int"
_COLUMNS = ["frame", "track", "x", "y", "missed"]


def _frames(pdf: pd.DataFrame):
    """(frame, detections in order) of a clip; rows without x stand for frames without detections."""
    for frame, rows in pdf.sort_values(["frame", "ord"], kind="stable").groupby("frame", sort=True):
        rows = rows.dropna(subset=["x", "y"])
        yield int(frame), list(zip(rows["x"].astype(float).tolist(), rows["y"].astype(float).tolist()))


def track(detections: DataFrame, cfg: TrackerConfig = TrackerConfig(), max_frames: int | None = None) -> DataFrame:
    """(clip, frame, track, x, y, missed) from detections (clip, frame, ord, x, y) of complete clips."""
    if max_frames is not None:
        detections = detections.where(F.col("frame") < max_frames)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = {}, []
        for frame, found in _frames(pdf):
            state, shown = track_step(state, found, cfg)
            out += [(key[0], frame, *s) for s in shown]
        return pd.DataFrame(out, columns=["clip", *_COLUMNS])

    kind = detections.schema["clip"].dataType.simpleString()
    return detections.groupBy("clip").applyInPandas(run, f"clip {kind}, {_OUT}")


def track_stream(detections: DataFrame, cfg: TrackerConfig = TrackerConfig(), idle: str | None = None) -> DataFrame:
    """``track`` on a stream whose micro-batches hold whole frames in rising order; a clip's state ends when it was idle so long, or never."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key, parts, group: GroupState):
        if group.hasTimedOut:
            group.remove()
            return
        state = json.loads(group.get[0]) if group.exists else {}
        pdf = pd.concat(list(parts))
        out = []
        for frame, found in _frames(pdf):
            state, shown = track_step(state, found, cfg)
            out += [(key[0], frame, *s) for s in shown]
        group.update((json.dumps(state),))
        if wait:
            group.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["clip", *_COLUMNS])

    kind = detections.schema["clip"].dataType.simpleString()
    return detections.groupBy("clip").applyInPandasWithState(
        run, f"clip {kind}, {_OUT}", "state string", "append", timeout
    )


def depth_ranges(samples: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(clip, frame, lo, hi): interpolated percentiles of the depths of each frame."""
    p = F.percentile("depth", F.array(F.lit(low), F.lit(high)))
    return samples.groupBy("clip", "frame").agg(p.alias("p")).select("clip", "frame", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))


def running_ranges(ranges: DataFrame, alpha: float = 0.9) -> DataFrame:
    """``ranges`` with running ``lo`` and ``hi``: alpha times the past plus (1 - alpha) times the frame's."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        state, out = None, []
        for lo, hi in zip(pdf["lo"], pdf["hi"]):
            state = (lo, hi) if state is None else tuple(alpha * s + (1 - alpha) * v for s, v in zip(state, (lo, hi)))
            out.append(state)
        return pdf.assign(lo=[o[0] for o in out], hi=[o[1] for o in out])

    return ranges.groupBy("clip").applyInPandas(run, ranges.schema)


def normalise_depth(samples: DataFrame, mode: str = "per_frame", alpha: float = 0.9) -> DataFrame:
    """Samples (clip, frame, ..., depth) with ``norm`` in 0..1 by the range of the frame, the clip or the running one."""
    if mode == "global":
        p = F.percentile("depth", F.array(F.lit(0.02), F.lit(0.98)))
        ranges = samples.groupBy("clip").agg(p.alias("p")).select("clip", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
        keys = ["clip"]
    elif mode in ("per_frame", "running"):
        ranges = depth_ranges(samples)
        ranges = running_ranges(ranges, alpha) if mode == "running" else ranges
        keys = ["clip", "frame"]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    share = (F.col("depth") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return samples.join(ranges, keys).withColumn("norm", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("lo", "hi")
