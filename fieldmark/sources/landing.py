"""Raw inputs: the same readers serve a batch (`spark.read`) and a stream (`spark.readStream`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.values import GAME_SPORT, IMAGE_SPLIT, IMAGE_SPORT, path_key

LABEL_SCHEMA = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int>>, "
    "annotations array<struct<image_id: bigint, category_id: int, bbox: array<double>, "
    "keypoints: array<double>, num_keypoints: int>>")

_LABEL_FIELDS = LABEL_SCHEMA.replace("images ", "images: ", 1).replace("annotations ", "annotations: ", 1)

FRAME_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

GAME_SCHEMA = (
    "game_id string, team string, opponent string, game_date string, points_for string, "
    "points_against string, off_efficiency string, def_efficiency string")


def _reader(spark: SparkSession, stream: bool, max_files: int | None):
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader


def labels(spark: SparkSession, path: str, stream: bool = False, multi_line: bool = True,
           max_files: int | None = None) -> DataFrame:
    """Annotation JSON, one document per file (or per line), with its source file.

    `raw` is the document as it was written, with the fields LABEL_SCHEMA does not name.
    """
    df = (_reader(spark, stream, max_files)
          .option("recursiveFileLookup", True).text(path, wholetext=multi_line)
          .where(F.col("value").rlike(r"\S")))
    # A document may be an array of documents, as for the JSON reader.
    df = df.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"),
                   F.explode_outer(F.from_json("value", f"array<struct<{_LABEL_FIELDS}>>")).alias("d"))
    return df.select("d.*", "raw", "source_file").withColumn("ingested_at", F.current_timestamp())


def frames(spark: SparkSession, path: str, stream: bool = False, glob: str = "*.jpg",
           max_files: int | None = None) -> DataFrame:
    """Image files by path, size and time. The content column is never read."""
    df = (_reader(spark, stream, max_files).format("binaryFile").schema(FRAME_SCHEMA)
          .option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path))
    return df.select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"),
        path_key(F.col("path"), IMAGE_SPORT).alias("sport"),
        path_key(F.col("path"), IMAGE_SPLIT).alias("split"))


# No line holds this separator, so a line is read as one field, named by the file's header line.
_NO_SEPARATOR = "\u0001\u0002\u0001"


def _csv_fields(line: Column) -> Column:
    """Fields of a CSV line as text: quotes taken off, NULL where nothing is written."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"\\]|\\.|"")*"(?=,|$)|[^,]*)'), 1)

    def plain(x: Column) -> Column:
        inner = F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r'(?:\\(?=["\\])|"(?="))(.)', "$1")
        return F.when(x.rlike(r'(?s)^".*"$') & (F.length(x) > 1), inner).when(x != "", x)

    return F.transform(found, plain)


def games(spark: SparkSession, path: str, stream: bool = False, schema: str = GAME_SCHEMA,
          max_files: int | None = None) -> DataFrame:
    """Game result CSV; values stay text until bronze types them.

    Columns go by the names in each file's own header, in any order; absent ones are NULL.
    `record` is the whole row as JSON of texts, with the columns `schema` does not name;
    a repeated name gets its position behind it, fields without a name are `_c` and theirs.
    """
    # The reader takes single numbers for numbers; in this locale a line with a comma is none.
    df = (_reader(spark, stream, max_files).schema("v variant").option("header", True).option("singleVariantColumn", "v")
          .option("sep", _NO_SEPARATOR).option("quote", "").option("locale", "de-CH")
          .option("recursiveFileLookup", True).csv(path))
    typed = ~F.schema_of_variant("v").rlike("(?i): (STRING|VOID)>$")
    line = F.when(typed, F.raise_error(F.lit("a game file needs two columns at least"))).otherwise(
        F.from_json(F.to_json("v"), "map<string,string>"))
    df = (df.select(line.alias("l"), F.col("_metadata.file_path").alias("__file"))
          .select("__file", _csv_fields(F.map_keys("l")[0]).alias("names"), _csv_fields(F.map_values("l")[0]).alias("texts")))
    place = lambda name: F.array_position("names", name).cast("int") - 1
    named = [F.get("texts", place(F.lit(f.name))).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]
    entries = F.transform("texts", lambda x, i: F.struct(
        F.when(F.get("names", i).isNull(), F.concat(F.lit("_c"), i))
        .when(place(F.get("names", i)) == i, F.get("names", i))
        .otherwise(F.concat(F.get("names", i), F.lit("_"), i)), x))
    df = df.select(*named, F.to_json(F.map_from_entries(entries)).alias("record"), "__file")
    return (df.withColumn("sport", path_key(F.col("__file"), GAME_SPORT)).drop("__file")
            .withColumn("ingested_at", F.current_timestamp()))


def survey_csv(spark: SparkSession, path: str) -> DataFrame:
    """A survey file as landed: header row, every column text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def blank_fill(df: DataFrame) -> DataFrame:
    """NULL text becomes ''."""
    return df.na.fill("")


def land_available(spark: SparkSession, sources: dict, write) -> DataFrame:
    """Land each source that can be read; one that fails is recorded and skipped.

    `sources` maps a name to a function returning its DataFrame, `write(name, df)`
    stores it and returns the stored frame. Result: one status row per source.
    """
    schema = "dataset string, status string, error string, rows bigint, cols int"
    rows = []
    for name, load in sources.items():
        try:
            stored = write(name, blank_fill(load()))
            rows.append((name, "landed", None, stored.count(), len(stored.columns)))
        except Exception as e:   # any unreadable source is skipped, the rest go on
            rows.append((name, "skipped", type(e).__name__, None, None))
    return spark.createDataFrame(rows, schema)
