"""Text formats as sources and sinks, with strict schemas and the reference point of a bad line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_is_empty: bool = False) -> DataFrame:
    """JSON lines by a schema; a line that doesn't fit is an error, blank lines are none. A missing file is an error or, if asked for, an empty table."""
    if missing_is_empty and not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(file, line)`` texts that don't fit the schema."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter(F.trim("value") != "")
    parsed = rows.select("file", "value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter(F.col("r._corrupt").isNotNull()).select("file", F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one file per partition; an existing folder is an error unless the mode says otherwise."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON documents over several lines, one object or an array of them a file; a broken one is an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", most: int = 100_000) -> None:
    """The table as one indented JSON document, an array of its rows; a table of more than ``most`` rows is an error, since a document is one task's work."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a document of more than {most} rows")
    rows = df.coalesce(1).agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    rows.write.mode(mode).text(path)


def audit_sample(df: DataFrame, columns: list[str], path: str, rows: int = 20) -> None:
    """The first rows, some columns, as JSON lines for the eye."""
    df.select(*columns).limit(rows).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, quoted cells with doubled quotes and line ends; rows of nothing but blanks are left out, missing cells are empty texts.

    Without a schema the types are inferred, by one more pass over the file.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
    t = reader.csv(path, header=True, quote='"', escape='"', multiLine=True)
    said = [F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "" for c in t.columns]
    return t.filter(F.greatest(*said) if len(said) > 1 else said[0]).na.fill("")


def lossless(df: DataFrame) -> DataFrame:
    """Floating-point columns as texts of 17 significant digits, from which the same number is read again; others as they are."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.16e", F.col(c).cast("double"))) for c in floats})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", exact: bool = False) -> None:
    """CSV with a header, every cell quoted; ``exact`` writes floating-point numbers without loss."""
    (lossless(df) if exact else df).write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True)


def read_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By the ending of the path: .jsonl and .json as JSON lines, .csv as CSV, .parquet as Parquet, .txt as lines."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending in ("jsonl", "json"):
        return read_jsonl(spark, path, schema)
    if ending == "csv":
        return read_csv(spark, path, schema)
    if ending == "parquet":
        return spark.read.parquet(path)
    if ending == "txt":
        return spark.read.text(path)
    raise ValueError(f"no reader for {path}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of a list of one value per line, in order, for files of one partition such as id lists."""
    lines = spark.read.option("wholetext", True).text(path)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "value"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_documents(spark: SparkSession, path: str, least: int = 120) -> DataFrame:
    """``(path, text)`` of .txt and .md files of at least ``least`` characters after normalisation."""
    from folioflow.functions.text import document_text

    raw = spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.(txt|md)$"))
    return raw.select("path", document_text(F.decode("content", "UTF-8")).alias("text")).filter(F.length("text") >= least)


def html_section(c: Column, heading: str) -> Column:
    """The part of a page from a heading (of any rank, by its text) to the next of that rank or the end; empty without one."""
    return F.regexp_extract(c, rf"(?is)<h([1-6])[^>]*>\s*{heading}\s*</h\1>(.*?)(?=<h\1[\s>]|\z)", 2)


def html_rows(pages: DataFrame, key: str, html: str, cells: int = 4) -> DataFrame:
    """``(key, cells)``: the list items of a page that have at least so many cells, tags stripped."""
    from folioflow.functions.text import decode_html

    items = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("item"))
    parts = F.transform(F.regexp_extract_all("item", F.lit(r"(?is)<div[^>]*>(.*?)</div>"), F.lit(1)), decode_html)
    return items.select(key, parts.alias("cells")).filter(F.size("cells") >= cells)
