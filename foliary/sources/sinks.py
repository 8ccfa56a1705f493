"""Report tables and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def outstanding_report(
    slots: DataFrame, fields: DataFrame, continuations: DataFrame, headers: DataFrame, unmapped: DataFrame, manual: DataFrame
) -> DataFrame:
    """Every open item of a run as one row: kind, key, label, section, reason."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, key: str, label, section, reason) -> DataFrame:
        return df.select(
            "run_id", F.lit(kind).alias("kind"), F.col(key).alias("key"), label.alias("label"), section.alias("section"), reason.alias("reason")
        )

    c = F.col
    return (
        rows(slots, "slot", "slot_key", c("label"), c("section_title"), c("reason"))
        .unionByName(rows(continuations, "continuation", "key", c("label"), c("section_title"), c("verdict")))
        .unionByName(rows(fields, "field", "field_key", c("label"), none, c("reason")))
        .unionByName(rows(headers, "header", "key", F.lit("JENIS ORDER"), none, c("reason")))
        .unionByName(rows(unmapped, "unmapped", "field_key", c("field_key"), none, F.lit("no-form-row")))
        .unionByName(rows(manual, "manual", "slot_key", c("label"), c("section_title"), F.lit("by-hand")))
    )


def proposals_file(sections: DataFrame) -> DataFrame:
    """Kept sections as review rows: one per section with its page span and citation."""
    return sections.where("reason is null").select(
        "run_id",
        "source_id",
        F.concat(F.lit("u:"), F.sha2(F.concat_ws("|", "run_id", "source_id", F.col("pos").cast("string")), 256)).alias("id"),
        "title",
        "from_page",
        "to_page",
        F.struct("page_index", F.col("title_from").alias("from"), F.col("title_to").alias("to")).alias("cite"),
    )


PROPOSALS = "run_id string, source_id string, id string, title string, from_page int, to_page int, cite struct<page_index: int, `from`: int, `to`: int>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_json`` wrote."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Partitioned by run, so that one run's report is one folder."""
    df.write.mode("overwrite").partitionBy("run_id").json(path)


def write_edits(edits: DataFrame, violations: DataFrame, path: str) -> None:
    """Sound edits only, as Parquet by run."""
    keys = ["run_id", "sheet", "ref", "value"]
    edits.join(violations.select(*keys), keys, "left_anti").write.mode("overwrite").partitionBy("run_id").parquet(path)
