"""Panoptic annotations, rasters, categories, captions and file lists."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEGMENT = "struct<id:bigint,category_id:int,area:bigint,iscrowd:int>"
_CATEGORY = "struct<id:int,name:string,supercategory:string,isthing:int,color:array<int>>"


def read_panoptic(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, segments, categories) of an annotation file; without categories of its own those of the fallback."""
    rows = spark.read.schema(f"annotations array<struct<image_id:bigint,file_name:string,segments_info:array<{_SEGMENT}>>>, categories array<{_CATEGORY}>").json(path, multiLine=True)
    a = rows.select(F.explode("annotations").alias("a")).select("a.*")
    segments = a.select("image_id", F.explode("segments_info").alias("s")).select("image_id", F.col("s.id").alias("segment_id"), "s.category_id", "s.area", "s.iscrowd")
    categories = rows.select(F.explode("categories").alias("c")).select("c.*")
    if fallback is not None and categories.isEmpty():
        categories = fallback
    return a.select("image_id", "file_name"), segments, categories


def read_category_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of lines id:label."""
    x = spark.read.text(path).where(F.contains(F.col("value"), F.lit(":")))
    return x.select(F.trim(F.substring_index("value", ":", 1)).cast("int").alias("id"), F.trim(F.regexp_replace("value", "^[^:]*:", "")).alias("name"))


def read_category_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_fields(_CATEGORY)).json(path, multiLine=True)


def _fields(kind: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(kind)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of lines a:b; a list b,c,... gives a row each."""
    x = spark.read.text(path).where(F.contains(F.col("value"), F.lit(":")))
    return x.select(F.trim(F.substring_index("value", ":", 1)).alias("source"), F.explode(F.split(F.regexp_replace("value", "^[^:]*:", ""), ",")).alias("target")).withColumn("target", F.trim("target"))


def read_captions(spark: SparkSession, paths: list[str], images: DataFrame | None = None) -> DataFrame:
    """(image_id, caption) of caption files, of the given images."""
    rows = spark.read.schema("annotations array<struct<image_id:bigint,caption:string>>").json(paths, multiLine=True).select(F.explode("annotations").alias("a")).select("a.*")
    return rows if images is None else rows.join(images.select("image_id").distinct(), "image_id", "left_semi")


def image_name(image_id: Column, extension: str = "jpg") -> Column:
    """File name of an image: its id padded to 12 digits."""
    return F.format_string(f"%012d.{extension}", image_id.cast("bigint"))


def image_id(name: Column) -> Column:
    """Id in a file name: the last run of digits before the extension."""
    return F.nullif(F.regexp_extract(name, r"([0-9]+)\.[A-Za-z]+$", 1), F.lit("")).cast("bigint")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name) of the files of a folder, contents unread."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return rows.withColumn("name", F.element_at(F.split("path", "/"), -1))


def read_split(spark: SparkSession, folder: str, split: str, known: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(name) of a split's list file, without extension; an unknown split is an error."""
    if split not in known:
        raise ValueError(f"unknown split {split}")
    return spark.read.text(f"{folder}/{split}.txt").select(F.regexp_replace(F.trim("value"), r"\.[A-Za-z]+$", "").alias("name")).where(F.col("name") != "").orderBy("name")


def remaining(inputs: DataFrame, outputs: DataFrame, key: str = "name") -> DataFrame:
    """Inputs without an output: a run resumes where it was broken off."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def annotations_of(annotations: DataFrame, class_ids: list[int]) -> DataFrame:
    """All annotations (image_id, category_id, ...) of the classes in images having any of them."""
    mine = annotations.where(F.col("category_id").isin(class_ids))
    return annotations.join(mine.select("image_id").distinct(), "image_id", "left_semi").where(F.col("category_id").isin(class_ids))


def class_registry(classes: DataFrame) -> DataFrame:
    """(source, id, name, short, class_id): dense ids from 1 by source and id (0 is the background); short is the name up to its first comma."""
    from graphweave.operators.keys import dense_ids

    rows = classes.select("source", "id", "name").distinct()
    return dense_ids(rows, [F.asc("source"), F.asc("id")], "class_id").select("source", "id", "name", F.substring_index("name", ",", 1).alias("short"), (F.col("class_id") + 1).cast("int").alias("class_id"))


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, head = 8, [], None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only 8-bit images without palette or interlacing")
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    before = np.zeros(width * channels, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + before) & 255
        elif kind in (3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b, c = before[x], before[x - channels] if x >= channels else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        out[y], before = line, line
    return out.reshape(height, width, channels)


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG."""
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def raster_runs(files: DataFrame, name: str = "image_id", content: str = "content") -> DataFrame:
    """(image_id, x, run, segment_id, y0, len): column runs of the id maps in PNG files; id = R + 256 G + 65536 B."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, data in zip(pdf[name], pdf[content]):
                px = decode_png(bytes(data)).astype(np.int64)
                ids = px[:, :, 0] + 256 * px[:, :, 1] + 65536 * px[:, :, 2] if px.shape[2] >= 3 else px[:, :, 0]
                height, width = ids.shape
                flat = ids.T.ravel()  # column after column
                first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1])]) | (np.arange(len(flat)) % height == 0))
                x = first // height
                start = np.searchsorted(x, np.arange(width))
                yield pd.DataFrame({"image_id": i, "x": x, "run": np.arange(len(first)) - start[x], "segment_id": flat[first], "y0": first % height, "len": np.diff(np.concatenate([first, [len(flat)]]))})

    return files.select(name, content).mapInPandas(run, "image_id bigint, x bigint, run bigint, segment_id bigint, y0 bigint, len bigint")
