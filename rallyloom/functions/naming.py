"""Names of frames, images and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_id(clip: Column, name: Column) -> Column:
    return F.concat_ws("/", clip.cast("string"), name)


def clip_of(frame: Column) -> Column:
    return F.split_part(frame, F.lit("/"), F.lit(1))


def name_of(frame: Column) -> Column:
    return F.split_part(frame, F.lit("/"), F.lit(2))


def flat_key(parent: Column, name: Column) -> Column:
    """The basename that a frame has in a training folder."""
    return F.concat_ws("_", parent, name)


def label_stem(frame: Column) -> Column:
    return flat_key(clip_of(frame), F.regexp_replace(name_of(frame), r"\.[^.]*$", ""))


def label_path(root: Column, split: Column, frame: Column) -> Column:
    return F.concat(root, F.lit("/"), split, F.lit("/labels/"), label_stem(frame), F.lit(".txt"))


def mime_type(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg")
