"""JSON lines, JSON arrays, file inventories and sinks, through Spark's own readers and commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, strict: bool = True) -> DataFrame:
    """Objects of a JSON-lines file, gzip or not; blank lines are skipped.  `strict` fails on a broken line, else it is dropped."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def broken_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """file and line text of the lines that are no object of the schema."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = fields.add("_corrupt_record", "string") if "_corrupt_record" not in fields.names else fields
    lines = spark.read.text(path).where("trim(value) != ''")
    parsed = F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(F.col("_metadata.file_name").alias("file"), "value", parsed.alias("p")).where("p._corrupt_record is not null").select("file", "value")


def read_json_array(spark: SparkSession, path: str, schema: str, inside: str | None = None) -> DataFrame:
    """Rows of a file that is one JSON array, or one object with the array under `inside`."""
    if inside is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    whole = spark.read.schema(f"{inside} array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(schema))}>>").option("multiLine", True).json(path)
    return whole.select(F.inline(inside))


def write_new(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Write once: fails if the path is there; Spark's commit replaces a temporary file and a rename."""
    writer = df.write.mode("errorifexists").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_canonical(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept."""
    row = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.mode("errorifexists").text(path)


def inventory(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """path, bytes and sha256 of the files that match the patterns ({a,b} and * as Hadoop has them)."""
    found = spark.read.format("binaryFile").load(patterns)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).distinct()


def safe_paths(files: DataFrame, column: str = "path") -> DataFrame:
    """The rows whose relative path stays inside its folder."""
    c = F.col(column)
    return files.where(c.isNotNull() & (c != "") & ~c.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.exists(F.split(c, r"[/\\]"), lambda x: x == ".."))


def text_files(files: DataFrame, most_chars: int = 1_500_000) -> DataFrame:
    """path and text of (path, content) rows that are text: no 0 byte among the first 8192, valid UTF-8, neither empty nor too long."""
    head = F.substring(F.hex(F.substring("content", 1, 8192)), 1, 16384)
    zero = F.exists(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1)), lambda x: x == "00")
    out = files.where(~zero & F.expr("is_valid_utf8(cast(content AS string))")).select("path", F.col("content").cast("string").alias("text"))
    return out.where((F.col("text") != "") & (F.length("text") <= most_chars))


def chunk_table(chunks: DataFrame, path: str) -> None:
    """Chunks as a table partitioned by repository and revision, so that reading a snapshot prunes the rest."""
    chunks.withColumn("revision", F.lower("revision")).repartition("repo", "revision").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "revision").parquet(path)
