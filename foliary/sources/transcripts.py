"""Text logs of measurement runs, file names and content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed value: one per-page row of the log, ten columns.
ROW = (
    r"^\s{2}(\S+\s+p[0-9]+)\s+([0-9]+)\s+([0-9]+)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)%"
    r"\s+([0-9]+)\s+([0-9]+)\s+([0-9.]+)\s+([0-9]+)\s*$"
)
COLUMNS = [
    ("lines", "int"),
    ("chars", "int"),
    ("cover", "double"),
    ("ink", "double"),
    ("uncovered", "double"),
    ("med_h", "int"),
    ("collapsed", "int"),
    ("density", "double"),
    ("interpolated", "int"),
]
UNKNOWN = "(unknown)"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (run, value) rows."""
    return spark.read.text(path).select(F.input_file_name().alias("run"), "value")


def transcript_refusals(log: DataFrame) -> DataFrame:
    """Run, lines, reason of the files without any page row."""
    rows = F.count_if(F.regexp_like("value", F.lit(ROW)))
    return log.groupBy("run").agg(F.count(F.lit(1)).alias("lines"), rows.alias("_rows")).where("_rows = 0").select("run", "lines", F.lit("no-page-rows").alias("reason"))


def write_transcripts(log: DataFrame, path: str, order: str) -> None:
    """Log lines (run, value) as a text file for each run, in the order of a column."""
    rows = log.repartition("run").sortWithinPartitions("run", order)
    rows.select("run", "value").write.mode("overwrite").partitionBy("run").text(path)


def read_documents(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Path, length, digest of every file below a folder; a refused file has a reason and no digest.

    The content is hashed where it is read; files over ``most_bytes`` aren't read. Spark's source passes over empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    none, digest = F.lit(None).cast("string"), F.sha2("content", 256)
    if most_bytes is None:
        return files.select("path", "length", none.alias("reason"), digest.alias("digest"))
    # the source skips the content of files that a filter on length leaves out, and where content isn't asked for
    small = files.where(F.col("length") <= most_bytes).select("path", "length", none.alias("reason"), digest.alias("digest"))
    large = files.where(F.col("length") > most_bytes).select("path", "length", F.lit("too-large").alias("reason"), none.alias("digest"))
    return small.unionByName(large)


def parse_page_rows(log: DataFrame) -> DataFrame:
    """Metric rows of (run, value) log lines."""
    got = [F.regexp_extract("value", ROW, k + 2).try_cast(t).alias(n) for k, (n, t) in enumerate(COLUMNS)]
    return log.where(F.regexp_like("value", F.lit(ROW))).select(
        "run", F.regexp_extract("value", ROW, 1).alias("page"), *got
    )


def parse_identity(log: DataFrame) -> DataFrame:
    """Model names, totals and short reads of each run."""

    def one(pattern: str, group: int = 1):
        return F.max(F.nullif(F.regexp_extract("value", pattern, group), F.lit("")))

    g = log.groupBy("run").agg(
        one(r"^Model:\s*(\S+)").alias("m"),
        one(r"^OCR model:\s*(\S+)").alias("o"),
        one(r"OCR engine:\s*([^)\n]+)").alias("e"),
        one(r"^TOTAL:\s*([0-9]+\s*/\s*[0-9]+)").alias("t"),
        one(r"field slots \(model-located\):\s*([0-9]+\s*/\s*[0-9]+)").alias("f"),
        one(r"Completeness assertion:\s*([0-9]+) short read").alias("s"),
    )
    u = F.lit(UNKNOWN)
    tight = lambda c: F.regexp_replace(c, r"\s", "")
    return g.select(
        "run",
        F.coalesce("m", u).alias("model"),
        F.coalesce("o", "m", u).alias("ocr_model"),
        F.coalesce(F.trim("e"), u).alias("engine"),
        F.coalesce(tight("t"), u).alias("total"),
        F.coalesce(tight("f"), u).alias("field_slots"),
        F.coalesce("s", u).alias("short_reads"),
    )


# Order and quote numbers in file names.
ORDER_ID = "LOP[0-9]{4,}"
QUOTE_ID = "[0-9]-[0-9]{9,}"


def ids_from_names(sources: DataFrame) -> DataFrame:
    """First order id and first quote id over a run's names in order.

    Neither pattern can span the space between names, so the first name that matches decides; one
    partial aggregate per run.
    """
    order = F.regexp_extract("name", f"({ORDER_ID})", 1)
    quote = F.regexp_extract("name", f"({QUOTE_ID})", 1)
    first = lambda c: F.coalesce(F.min_by(c, F.when(c != "", F.col("pos"))), F.lit(""))
    return sources.groupBy("run_id").agg(first(order).alias("id_epic"), first(quote).alias("quote"))


def digests(documents: DataFrame, content: str) -> DataFrame:
    """Lower-case hexadecimal SHA-256 of each content value."""
    return documents.withColumn("digest", F.sha2(F.col(content), 256)).drop(content)
