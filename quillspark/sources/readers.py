"""Readers for the reference's file formats, all with explicit schemas (no inference pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.labels import split_alias

REAL_TEXT_SCHEMA = "id string, ended boolean, text string"
GENERATED_SCHEMA = "id string, text string, own_shard long"
NEWS_SCHEMA = (
    "domain string, orig_split string, title string, url string, random_score double, ind30k long, "
    "split string, authors string, date string, article string, label string"
)
SCORE_STRUCT = "struct<fake:double,real:double,correct:boolean>"
INDEX_COLUMNS = {"Filename": "filename", "Prompt": "prompt", "Language": "language", "Score Level": "score_level"}


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header CSV whose quoted cells may hold commas, doubled quotes and newlines."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').option("mode", "FAILFAST").csv(path)
    )


def read_index_csv(spark: SparkSession, path: str) -> DataFrame:
    """Essay index, four columns renamed to snake case."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in INDEX_COLUMNS.items()])


def read_whole_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S3: each file as one string (newlines kept) with its path and file name."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return df.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        *[c for c in df.columns if c != "value"], F.col("value").alias("text"),
    )


def read_members(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """S3 containers (``sinks.write_members``): (name, text), one row per text. The files are splittable; only texts of several parts are
    grouped. With ``parts`` the bounded parts come as they are: (name, part, parts, text)."""
    df = spark.read.schema("name string, part int, parts int, text string").option("mode", "FAILFAST").json(path)
    if parts:
        return df
    long_ = df.filter(F.col("parts") > 1).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    whole = long_.select("name", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return df.filter(F.col("parts") == 1).select("name", "text").unionAll(whole)


def read_array_parts(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """S7 containers (``sinks.write_array_parts``): (keys..., idx, text), position kept; ``keys`` is their schema."""
    df = spark.read.schema(f"{keys}, first long, value string").option("mode", "FAILFAST").json(path)
    arr = F.from_json(F.col("value"), T.ArrayType(T.StringType()))
    names = [c for c in df.columns if c not in ("first", "value")]
    return df.select(*names, "first", F.posexplode(arr).alias("pos", "text")).select(*names, (F.col("first") + F.col("pos")).alias("idx"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: str = REAL_TEXT_SCHEMA) -> DataFrame:
    """JSON lines with an explicit schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_generated(spark: SparkSession, root: str, split: str | None = None, prefix: bool = False) -> DataFrame:
    """Generated shards laid out as gen_method=/split=/shard=; the split filter prunes partitions.

    With ``prefix`` the split value only has to start with ``split`` (the reference's file-name test). A folder can hold several
    small shards; their records name their shard, others are of the folder's.
    """
    df = spark.read.schema(GENERATED_SCHEMA + ", gen_method string, split string, shard long").json(root)
    if split is not None:
        df = df.filter(F.col("split").startswith(split) if prefix else F.col("split") == split)
    return df.select("id", "text", "gen_method", "split", F.coalesce("own_shard", "shard").alias("shard"))


def read_news(spark: SparkSession, path: str, split: str) -> DataFrame:
    """News JSONL rows of one split; the caller's 'valid' is the stored 'val'."""
    df = spark.read.schema(NEWS_SCHEMA).json(path)
    return df.filter(F.col("split") == split_alias(F.lit(split)))


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of strings -> (file_path, idx, text), position kept."""
    w = read_whole_texts(spark, path)
    arr = F.from_json(F.col("text"), T.ArrayType(T.StringType()))
    return w.select("file_path", *[c for c in w.columns if c not in ("file_path", "file_name", "text")],
                    F.posexplode(arr).alias("idx", "text"))


def read_json_maps(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON object id -> {fake, real, correct} -> rows."""
    w = read_whole_texts(spark, path)
    m = F.from_json(F.col("text"), f"map<string,{SCORE_STRUCT}>")
    e = w.select(F.explode(m).alias("id", "s"))
    return e.select("id", "s.fake", "s.real", "s.correct")


def read_text_corpus(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A ``*.txt`` file or a directory of them, line by line or one row per file."""
    return spark.read.text(path, wholetext=whole, pathGlobFilter="*.txt")


# One reader per format, each with the caller's schema; an unknown format is an error.
READERS = {
    "parquet": lambda read, path: read.parquet(path),
    "json": lambda read, path: read.option("mode", "FAILFAST").json(path),
    "csv": lambda read, path: (read.option("header", True).option("multiLine", True).option("escape", '"')
                               .option("mode", "FAILFAST").csv(path)),
    "text": lambda read, path: read.text(path),
}


def format_of(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    fmt = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "txt": "text"}.get(ext)
    if fmt is None:
        raise ValueError(f"unknown file extension for {path!r}; expected .parquet, .json, .jsonl, .csv or .txt")
    return fmt


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read by extension. JSON needs a schema (finding one would scan all rows); CSV without one
    gives strings, Parquet holds its own, and text has the one column ``value``."""
    fmt = format_of(path)
    if fmt == "json" and schema is None:
        raise ValueError("JSON needs a schema")
    return READERS[fmt](spark.read if schema is None or fmt == "text" else spark.read.schema(schema), path)
