"""Clip paths ``<game>/play_NNN/<view>.mp4`` and the keys built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = r"([^/]+)/(play_[^/]+)/([^/]+)\.mp4$"


def parse_clip(path: Column) -> dict[str, Column]:
    return {name: F.regexp_extract(path, PATH, i + 1) for i, name in enumerate(("game", "play", "view"))}


def clip_tag(path: Column) -> Column:
    """``game/play_NNN``."""
    p = parse_clip(path)
    return F.concat_ws("/", p["game"], p["play"])


def label_id(path: Column) -> Column:
    """``game_play_NNN_view``, the name label files carry."""
    p = parse_clip(path)
    return F.concat_ws("_", p["game"], p["play"], p["view"])


def path_of_label_id(name: Column) -> Column:
    """Back from ``game_play_NNN_view`` to the path."""
    part = F.split(F.regexp_replace(name, r"\.npz$", ""), "_")
    view = F.array_join(F.slice(part, 4, F.size(part)), "_")
    return F.concat(part[0], F.lit("/"), part[1], F.lit("_"), part[2], F.lit("/"), view, F.lit(".mp4"))


def frame_key(clip: Column, frame: Column) -> Column:
    return F.concat(clip, F.lit("#"), frame.cast("string"))


def thumb_id(path: Column, frame: Column) -> Column:
    p = parse_clip(path)
    return F.concat_ws("_", p["game"], p["play"], F.format_string("%04d", frame))


def display_time(frame: Column, snap: Column, fps: float = 30.0) -> Column:
    return (frame - snap) / fps


def trimmed(start: Column, end: Column, head: float = 1.0, tail: float = 2.0,
            shortest: float = 1.0) -> dict[str, Column]:
    """Cut point and length after trimming; NULL when nothing longer than ``shortest`` is left."""
    length = end - start - head - tail
    keep = length > shortest
    return {"cut_start": F.when(keep, start + head), "cut_length": F.when(keep, length)}
