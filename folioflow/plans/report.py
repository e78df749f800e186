"""What a run tells: actions, exit codes, JSON objects, a text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import file_name
from ..functions.normalise import date_prefix
from ..functions.text import or_dash
from ..sources.inventory import metadata_out

#: What became of a document.
FILED, DUPLICATE, PLANNED, EXTRACTED, NOT_FILED = "filed", "duplicate", "planned", "extracted", "not-filed"
OUTPUT_VERSION = 1


def action(disposition: Column, duplicate: Column, *, dry_run: bool = False, no_analysis: bool = False, no_file: bool = False) -> Column:
    if no_analysis:
        return F.lit(EXTRACTED)
    if dry_run:
        return F.lit(PLANNED)
    if no_file:
        return F.lit(NOT_FILED)
    return F.when(disposition == "keep", F.lit(NOT_FILED)).when(F.coalesce(duplicate, F.lit(False)), F.lit(DUPLICATE)).otherwise(F.lit(FILED))


def destination(act: Column, dest: Column) -> Column:
    return F.when(act.isin(FILED, DUPLICATE, PLANNED), F.nullif(dest, F.lit("")))


def has_metadata(act: Column, metadata: Column) -> Column:
    return (act != EXTRACTED) & (F.coalesce(metadata["type"], F.lit("")) != "")


def archive_note(archive: Column) -> Column:
    """A few words on a hand-off that ran; null if it didn't."""
    return F.when(
        F.coalesce(archive["attempted"], F.lit(False)),
        F.when(archive["success"], F.lit("archived"))
        .when(archive["exit_code"].isNotNull(), F.concat(F.lit("archiver failed (exit "), archive["exit_code"].cast("string"), F.lit(")")))
        .otherwise(F.lit("archiver failed")),
    )


def output_json(row: DataFrame, *, include_text: bool = False) -> Column:
    """One JSON object a document; keys are always there. row: plan columns, action, archive."""
    c = F.col
    attempted = F.coalesce(c("archive")["attempted"], F.lit(False))
    out = F.struct(
        F.lit(OUTPUT_VERSION).alias("version"),
        F.struct(c("path"), c("mime").alias("type"), c("size"), c("digest")).alias("source"),
        c("action"),
        destination(c("action"), c("dest")).alias("destination"),
        F.nullif(c("rule"), F.lit("")).alias("rule"),
        F.when(c("action") != EXTRACTED, F.nullif(c("disposition"), F.lit(""))).alias("disposition"),
        F.when(c("text")["origin"].isNotNull(), F.struct(c("text")["origin"].alias("origin"), (c("text")["content"] if include_text else F.lit(None).cast("string")).alias("content"))).alias("text"),
        c("text")["truncation"].alias("truncation"),
        F.when(has_metadata(c("action"), c("metadata")), metadata_out(c("metadata"))).alias("metadata"),
        F.when(
            attempted,
            F.struct(
                c("archive")["attempted"].alias("attempted"),
                c("archive")["success"].alias("success"),
                c("archive")["exit_code"].alias("exit_code"),
                F.nullif(c("archive")["output"], F.lit("")).alias("output"),
                F.nullif(c("archive")["error"], F.lit("")).alias("error"),
            ),
        ).alias("archive"),
    )
    return F.to_json(out, {"ignoreNullFields": "false"})


def text_table(rows: DataFrame) -> DataFrame:
    """(source, dest, type, tags) with dashes for what is absent."""
    c = F.col
    return rows.select(
        file_name(c("path")).alias("source"),
        or_dash(destination(c("action"), c("dest"))).alias("dest"),
        or_dash(c("metadata")["type"]).alias("type"),
        or_dash(F.array_join(c("metadata")["tags"], ", ")).alias("tags"),
    )


def detail_of(rows: DataFrame) -> Column:
    """The labelled values that a dry run shows of a plan, blank ones left out."""
    m, text, name = F.col("metadata"), F.col("text"), F.col("name")
    cut = text["truncation"]
    told = [
        ("rule", F.col("rule")),
        ("rule path", F.col("rule_path")),
        ("disposition", F.col("disposition")),
        ("text origin", text["origin"]),
        ("title", m["title"]),
        ("correspondent", m["correspondent"]),
        ("document date", date_prefix(m["document_date"])),
        ("reference", m["reference"]),
        ("description", m["description"]),
        ("due date", date_prefix(m["due_date"])),
        ("amount", F.when(m["amount"].isNotNull(), F.concat(m["amount"], F.lit(" "), m["currency"]))),
        ("filename", F.when(~name["from_proposal"], F.lit("from the source: the proposal had nothing to keep"))),
        ("truncated", F.when(cut.isNotNull(), F.concat(cut["pages_processed"].cast("string"), F.lit(" of "), cut["pages_total"].cast("string"), F.lit(" pages processed")))),
        ("archive", archive_note(F.col("archive")) if "archive" in rows.columns else F.lit(None).cast("string")),
    ]
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), value.cast("string").alias("value")) for k, (label, value) in enumerate(told)])
    return F.filter(listed, lambda d: F.coalesce(d["value"], F.lit("")) != "")


def plan_detail(rows: DataFrame) -> DataFrame:
    """(path, ord, label, value): the same as rows."""
    return rows.select("path", F.explode(detail_of(rows)).alias("d")).select("path", "d.ord", "d.label", "d.value")


def summary(rows: DataFrame) -> DataFrame:
    """Documents and bytes by folder and outcome of a plan."""
    folder = F.regexp_replace(F.coalesce(F.col("dest"), F.lit("")), r"/?[^/]*\z", "")
    return rows.groupBy(folder.alias("folder"), "rule", "error_kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("bytes"))
