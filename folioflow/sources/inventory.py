"""The trace of filed documents: a JSON object each, and the table of them.

The table is the record at scale; ``sources.sink`` also leaves a file beside each document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filing import Archive
from ..plans.schema import ARCHIVE, TRUNCATION
from .listing import contents, listed

#: Fixed values of the format.
VERSION = 1
SUFFIX = ".folioflow.json"
RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"
FIELDS = ("version", "source", "source_digest", "metadata", "rule", "filed_at", "truncation", "archive")
METADATA_FIELDS = ("title", "type", "correspondent", "tags", "document_date", "due_date", "reference", "description", "amount", "currency")
_WIRE_METADATA = "struct<title:string,type:string,correspondent:string,tags:array<string>,document_date:string,due_date:string,reference:string,description:string,amount:string,currency:string>"
_WIRE_ARCHIVE = "struct<attempted:boolean,success:boolean,exit_code:int,output:string,error:string,attempted_at:string>"
_WIRE = f"struct<version:int,source:string,source_digest:string,metadata:{_WIRE_METADATA},rule:string,filed_at:string,truncation:{TRUNCATION},archive:{_WIRE_ARCHIVE}>"


def metadata_out(m: Column) -> Column:
    """Metadata as it is written: absent texts are null, tags never are, no filename."""
    text = lambda k: F.nullif(m[k], F.lit("")).alias(k)
    day = lambda k: F.date_format(m[k], "yyyy-MM-dd").alias(k)
    tags = F.coalesce(m["tags"], F.array().cast("array<string>")).alias("tags")
    return F.struct(
        m["title"].alias("title"), m["type"].alias("type"), text("correspondent"), tags, day("document_date"), day("due_date"), text("reference"), text("description"), text("amount"), text("currency")
    )


def trace_json(source: Column, digest: Column, metadata: Column, rule: Column, filed_at: Column, truncation: Column, archive: Column) -> Column:
    """The JSON of a trace; every key is there, null where there is nothing."""
    out = F.struct(
        archive["attempted"].alias("attempted"),
        archive["success"].alias("success"),
        archive["exit_code"].alias("exit_code"),
        F.nullif(archive["output"], F.lit("")).alias("output"),
        F.nullif(archive["error"], F.lit("")).alias("error"),
        F.date_format(archive["attempted_at"], RFC3339).alias("attempted_at"),
    )
    whole = F.struct(
        F.lit(VERSION).alias("version"),
        source.alias("source"),
        digest.alias("source_digest"),
        metadata_out(metadata).alias("metadata"),
        rule.alias("rule"),
        F.date_format(filed_at, RFC3339).alias("filed_at"),
        truncation.alias("truncation"),
        out.alias("archive"),
    )
    return F.to_json(whole, {"ignoreNullFields": "false"})


def read_traces(traces: DataFrame, trace: str = "trace", digest: str = "digest") -> DataFrame:
    """Add ``record`` and ``unusable`` to rows with a trace's JSON (null: there is none) and the
    digest of the file beside it. What can't be used has no record and says why; the bytes
    always win over what a trace claims."""
    raw = F.col(trace)
    parsed = F.from_json(raw, _WIRE)
    rows = traces.withColumn("_parsed", parsed).withColumn("_variant", F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))))
    part = lambda k: F.json_object_keys(F.get_json_object(raw, f"$.{k}"))
    strange = (
        F.exists(F.json_object_keys(raw), lambda k: ~k.isin(*FIELDS))
        | F.exists(F.coalesce(part("metadata"), F.array().cast("array<string>")), lambda k: ~k.isin(*METADATA_FIELDS))
        | F.exists(F.coalesce(part("archive"), F.array().cast("array<string>")), lambda k: ~k.isin("attempted", "success", "exit_code", "output", "error", "attempted_at"))
    )
    good_json = F.try_variant_get("_variant", "$[0]", "variant").isNotNull() & F.try_variant_get("_variant", "$[1]", "variant").isNull()
    p = F.col("_parsed")
    filed_at = F.try_to_timestamp(p["filed_at"], F.lit(RFC3339))
    reason = (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(~F.coalesce(good_json, F.lit(False)) | p.isNull() | F.json_object_keys(raw).isNull(), F.lit("does not parse"))
        .when(strange, F.lit("does not parse: unknown key"))
        .when(F.coalesce(p["version"], F.lit(0)) != VERSION, F.lit("another schema version"))
        .when(F.coalesce(p["source_digest"], F.lit("")) != F.col(digest), F.lit("records another digest"))
        .when(filed_at.isNull(), F.lit("unreadable filed_at"))
    )
    m, a = p["metadata"], p["archive"]
    record = F.struct(
        p["source"].alias("source"),
        F.struct(
            *[(F.try_to_date(m[k], "yyyy-MM-dd") if k.endswith("_date") else m[k] if k in ("tags", "amount", "currency") else F.coalesce(m[k], F.lit(""))).alias(k) for k in METADATA_FIELDS],
            F.lit("").alias("filename"),
        ).alias("metadata"),
        p["rule"].alias("rule"),
        filed_at.alias("filed_at"),
        p["truncation"].alias("truncation"),
        F.struct(
            F.coalesce(a["attempted"], F.lit(False)).alias("attempted"),
            F.coalesce(a["success"], F.lit(False)).alias("success"),
            a["exit_code"].alias("exit_code"),
            a["output"].alias("output"),
            a["error"].alias("error"),
            F.try_to_timestamp(a["attempted_at"], F.lit(RFC3339)).alias("attempted_at"),
        )
        .cast(ARCHIVE)
        .alias("archive"),
    )
    rows = rows.withColumn("unusable", reason)
    return rows.withColumn("record", F.when(raw.isNotNull() & F.col("unusable").isNull(), record)).drop("_parsed", "_variant")


def outstanding(archive: Column) -> Column:
    """Whether a hand-off is still to be made: any but a successful one."""
    return ~F.coalesce(archive["success"], F.lit(False))


def trace_beside(dest: Column, root: str) -> Column:
    """The trace beside a document of an archive, null without one. Executors read just these
    files, so what a run costs doesn't grow with the archive."""

    def run(names: pd.Series) -> pd.Series:
        archive = Archive(root)

        def one(name: str | None) -> str | None:
            raw = archive.read(name + SUFFIX) if name else None
            return None if raw is None else raw.decode("utf-8", "replace")

        return names.map(one)

    run.__annotations__ = {"names": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string").asNondeterministic()(dest)


def scan_traces(spark, root: str) -> DataFrame:
    """(dest, trace) of all traces in an archive: the whole inventory as a table, listed and read by
    executors. Empty files are no traces; one that can't be read is an error."""
    base = F.lit(f"file:{root.rstrip('/')}/")
    files = contents(listed(spark, [root], f"*{SUFFIX}", recursive=True)).where("size IS NULL OR size > 0")
    trace = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("a trace can't be read: "), F.col("path")))).otherwise(F.col("content").cast("string"))
    return files.select(F.regexp_replace(F.substr("path", F.length(base) + 1), rf"\Q{SUFFIX}\E\z", "").alias("dest"), trace.alias("trace"))
