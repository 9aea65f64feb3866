"""Frame sources: PNG folders in natural order, inline data URLs, sprite-frame resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.text import natural_key


def png_sequence(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """folder, name, frame_index (natural order within the folder), path, length, content of a folder's PNG files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), name.alias("name"), "path", "length", "content")
    # places come from names alone, so contents are not shuffled with the window
    place = named.select("folder", "path", "name").withColumn("frame_index", F.row_number().over(W.partitionBy("folder").orderBy(natural_key(F.col("name")), "name")) - 1)
    return named.join(place.select("path", "frame_index"), "path").select("folder", "name", "frame_index", "path", "length", "content")


def inline_items(items: DataFrame, column: str = "data_url") -> DataFrame:
    """items with content: the bytes of a base64 PNG data URL, null for anything else."""
    body = F.regexp_extract(column, r"^data:image/png;base64,([A-Za-z0-9+/=\s]+)$", 1)
    return items.withColumn("content", F.when(body != "", F.unbase64(body)))


def sprite_frames(spark: SparkSession, path: str) -> DataFrame:
    """animation, frame_index, duration, speed and texture path of sprite-frame resource files (.tres text).

    External resources are declared by id and joined to the frames that name them.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.tres").select(F.input_file_name().alias("file"), F.col("value").alias("t"))
    tag = files.select("file", F.explode(F.regexp_extract_all("t", F.lit(r"\[ext_resource [^\]]*\]"), F.lit(0))).alias("x"))
    textures = tag.select("file", F.regexp_extract("x", r'\bid="?([^"\s\]]+)', 1).alias("id"), F.regexp_extract("x", r'\bpath="([^"]+)"', 1).alias("texture"))
    block = files.select("file", F.explode(F.regexp_extract_all("t", F.lit(r'(?s)"frames":\s*\[.*?\],.*?"name":\s*&?"[^"]*".*?"speed":\s*[0-9.]+'), F.lit(0))).alias("b"))
    clips = block.select(
        "file",
        F.regexp_extract("b", r'"name":\s*&?"([^"]*)"', 1).alias("animation"),
        F.regexp_extract("b", r'"speed":\s*([0-9.]+)', 1).try_cast("double").alias("speed"),
        F.posexplode(F.regexp_extract_all("b", F.lit(r"(?s)\{[^{}]*\"texture\"[^{}]*\}"), F.lit(0))).alias("frame_index", "f"),
    )
    frames = clips.select(
        "file",
        "animation",
        "speed",
        "frame_index",
        F.coalesce(F.regexp_extract("f", r'"duration":\s*([0-9.]+)', 1).try_cast("double"), F.lit(1.0)).alias("duration"),
        F.regexp_extract("f", r'ExtResource\(\s*"?([^")\s]+)', 1).alias("id"),
    )
    return frames.join(textures, ["file", "id"], "left").drop("id")
