"""JSON documents and script texts, from files or from a column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a scan of scripts skips, its files' endings, and heights that can be an actor's.
SKIPPED = (".git", ".godot", "addons", "node_modules")
ENDINGS = (".gd", ".tscn")
LEAST_HEIGHT, MOST_HEIGHT = 24, 420
#: What a script must name for its heights and sizes to count as shapes'.
SHAPES = "CapsuleShape2D|RectangleShape2D|CollisionShape2D|Polygon2D"


def parsed_documents(rows: DataFrame, column: str, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """rows with state and the fields of the schema, read from JSON texts.

    state: good; missing, where the text is null, and the fields are the defaults; corrupt, where it is not an object of
    that schema: the fields are null and the text stays as it is for repair. A byte order mark is passed over.
    """
    mark = "__corrupt"
    text = F.regexp_replace(column, "^﻿", "")
    wide = T.StructType([*schema.fields, T.StructField(mark, T.StringType())])
    read = rows.withColumn("_doc", F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark}))
    missing = F.col(column).isNull()
    corrupt = F.col(f"_doc.{mark}").isNotNull() | (F.trim(text) == "") | F.col("_doc").isNull()
    state = F.when(missing, "missing").when(corrupt, "corrupt").otherwise("good")
    fallback = lambda f: F.lit((defaults or {}).get(f.name)).cast(f.dataType)
    fields = [F.when(F.col("state") == "good", F.col(f"_doc.{f.name}")).when(F.col("state") == "missing", fallback(f)).alias(f.name) for f in schema.fields]
    return read.withColumn("state", state).select(*rows.columns, "state", *fields)


def json_files(spark: SparkSession, folder: str, names: Sequence[str], schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """name, text, state and fields of the named JSON files of a folder; files that aren't there are missing.

    The folder must exist. Names are the list of wanted documents and join the files that are found. Spark passes over
    files of no bytes, so these count as missing, too.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").load(folder)
    files = found.select(F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"), F.decode("content", "UTF-8").alias("text"))
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    return parsed_documents(wanted.join(files, "name", "left"), "text", schema, defaults)


def listed_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """place, path, length, content of an explicit list of files, in its order; a file listed twice comes twice."""
    listed = spark.createDataFrame(list(enumerate(paths)), "place long, path string")
    plain = lambda c: F.regexp_replace(c, r"^[a-z]+:/*(?=/)", "")
    files = spark.read.format("binaryFile").load(sorted(set(paths))).select(plain(F.col("path")).alias("_at"), "length", "content")
    return listed.withColumn("_at", plain(F.col("path"))).join(files, "_at").select("place", "path", "length", "content")


def outside(path: Column, folders: Iterable[str] = SKIPPED) -> Column:
    """Whether none of a path's folders has one of these names."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, folders)))


def script_texts(spark: SparkSession, root: str, endings: Sequence[str] = ENDINGS, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """path, text of the script files under a folder; folders that are skipped are pruned before a file is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = listed.where(ending.isin(list(endings)) & outside(F.substring(F.col("path"), F.instr("path", root.rstrip("/").split("/")[-1]), 1_000_000), skipped))
    return kept.select("path", F.decode("content", "UTF-8").alias("text"))


def script_heights(texts: DataFrame, key: Sequence[str], column: str = "text") -> DataFrame:
    """key, kind, height: each height that a script states and that can be an actor's.

    span: the extent in y of a packed list of at least two points; height and size: of shapes, in scripts that name one.
    """
    blocks = F.regexp_extract_all(column, F.lit(r"PackedVector2Array\s*\(\s*\[([\s\S]*?)\]\s*\)"), F.lit(1))
    spans = texts.select(*key, F.explode(blocks).alias("_b"))
    y = F.transform(F.regexp_extract_all("_b", F.lit(r"Vector2\s*\(\s*[-0-9.]+\s*,\s*([-0-9.]+)\s*\)"), F.lit(1)), lambda v: v.try_cast("double"))
    spans = spans.withColumn("_y", y).where(F.size("_y") >= 2).select(*key, F.lit("span").alias("kind"), (F.array_max("_y") - F.array_min("_y")).alias("height"))
    shapes = texts.where(F.col(column).rlike(SHAPES))
    number = lambda kind, pattern: shapes.select(*key, F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("_n")).select(*key, "kind", F.col("_n").try_cast("double").alias("height"))
    found = spans.unionByName(number("height", r"\.height\s*=\s*([0-9.]+)")).unionByName(number("size", r"\.size\s*=\s*Vector2\s*\(\s*[0-9.]+\s*,\s*([0-9.]+)\s*\)"))
    return found.where(F.col("height").between(LEAST_HEIGHT, MOST_HEIGHT))
