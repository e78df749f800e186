"""The triage plan: one row a document, from its bytes to where it goes. Nothing is written.

Stages add columns, and the first failure of a row wins: text, then reply, then vocabulary,
then rule, then path. A failed row keeps what was known and gets no destination.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions.naming import file_name, sanitised, with_name
from ..functions.normalise import date_part, date_prefix, first_foreign_tag, type_allowed
from ..operators.rules import Rule, by_place, first_match, joined_path, path_fault
from .config import Config, Vocabulary
from .schema import EXIT_CODES, METADATA


def path_context(metadata: Column) -> dict[str, Column]:
    """What path templates may name: every value sanitised first, so none can add a level."""
    day = metadata["document_date"]
    return {
        **{k: sanitised(metadata[k.lower()]) for k in ("Type", "Correspondent", "Reference", "Title")},
        **{k: date_part(day, k.lower()) for k in ("Year", "Month", "Day")},
        "Tags": F.transform(metadata["tags"], sanitised),
    }


def with_metadata(docs: DataFrame, types: Vocabulary, tags: Vocabulary) -> DataFrame:
    """Decode ``reply`` of rows without error_kind, strictly, and check it; add metadata."""
    rows = D.with_fields(docs, "reply")
    rows = rows.withColumn("_missing", D.missing_field(F.col("fields")))
    rows = rows.withColumn("metadata", F.when(F.col("malformed").isNull() & F.col("_missing").isNull(), D.metadata(F.col("fields"))).cast(METADATA))
    m = F.col("metadata")
    foreign = first_foreign_tag(m["tags"], tags.values)
    malformed = F.coalesce("malformed", "_missing")
    failed = F.col("error_kind").isNotNull()
    kind = (
        F.when(failed, F.col("error_kind"))
        .when(F.col("reply").isNull(), F.lit("transport"))
        .when(malformed.isNotNull(), F.lit("schema-unsupported"))
        .when(~type_allowed(m["type"], types.values) | foreign.isNotNull(), F.lit("rejected"))
    )
    message = (
        F.when(failed, F.col("error_msg"))
        .when(F.col("reply").isNull(), F.lit("no reply"))
        .when(malformed.isNotNull(), malformed)
        .when(~type_allowed(m["type"], types.values), F.concat(F.lit("type "), m["type"]))
        .when(foreign.isNotNull(), F.concat(F.lit("tag "), foreign))
    )
    rows = rows.withColumns({"error_kind": kind, "error_msg": message})
    return rows.withColumn("metadata", F.when(F.col("error_kind").isNull(), m)).drop("fields", "malformed", "_missing")


def with_destination(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add name, rule, rule_path and dest to rows with path, ext, metadata and errors."""
    m = F.col("metadata")
    original = F.regexp_replace(file_name(F.col("path")), r"\.[^./]*\z", "")
    here = m.isNotNull()
    rows = with_name(docs, m["filename"], original, F.col("ext"), date_prefix(m["document_date"]))
    rows = rows.withColumn("name", F.when(here, F.col("name")))
    rows = rows.withColumn("_place", F.when(here, first_match(rules, m["type"], m["correspondent"], m["tags"])))
    rows = rows.withColumn("rule", by_place(F.col("_place"), [F.lit(r.name) for r in rules]))
    rows = rows.withColumn("rule_path", by_place(F.col("_place"), [F.lit(r.path) for r in rules]))
    used = sorted({name for r in rules for name in r.template.names})
    known = path_context(m)
    # sanitised values are columns of their own, so that a rule list of any length names them
    # without repeating their expressions
    rows = rows.withColumns({f"_at_{k}": known[k] for k in used})
    values = {k: F.col(f"_at_{k}") for k in used}
    rows = rows.withColumn("_folder", by_place(F.col("_place"), [r.template.rendered(values) for r in rules]))
    fault = path_fault(F.col("_folder"))
    no_rule = here & F.col("_place").isNull()
    kind = F.when(F.col("error_kind").isNotNull(), F.col("error_kind")).when(no_rule, F.lit("no-rule")).when(here & fault.isNotNull(), F.lit("path"))
    message = (
        F.when(F.col("error_kind").isNotNull(), F.col("error_msg"))
        .when(no_rule, F.concat(F.lit("no rule for type "), m["type"]))
        .when(here & fault.isNotNull(), F.concat(F.lit("rule "), F.col("rule"), F.lit(": "), fault))
    )
    rows = rows.withColumns({"error_kind": kind, "error_msg": message})
    good = here & F.col("error_kind").isNull()
    rows = rows.withColumn("dest", F.when(good, joined_path(F.col("_folder"), F.col("name")["base"])))
    return rows.drop("_place", "_folder", *[f"_at_{k}" for k in used])


def exit_code(kind: Column) -> Column:
    out = F.when(kind.isNull(), F.lit(0))
    for code in sorted(set(EXIT_CODES.values())):
        out = out.when(kind.isin(*[k for k, c in EXIT_CODES.items() if c == code]), F.lit(code))
    return out.otherwise(F.lit(1))


def observed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with metrics: how many, and how many failed. Filters above stay above: pushed
    down they would repeat each stage's expressions inside the next one's, many times over."""
    failed = F.count(F.when(F.col("error_kind").isNotNull(), F.lit(1)))
    return rows.observe(f"{name}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("documents"), failed.alias("failed"))


def build_plan(docs: DataFrame, config: Config) -> DataFrame:
    """The plan of rows with path, ext, size, digest, mime, the struct text, reply, and, where
    the model was asked, reply_error_kind and reply_error_msg. Other columns pass through."""
    text = F.col("text")
    asked = "reply_error_kind" in docs.columns
    rows = docs.withColumns(
        {
            "error_kind": F.coalesce(text["error_kind"], F.col("reply_error_kind")) if asked else text["error_kind"],
            "error_msg": F.coalesce(text["error_msg"], F.col("reply_error_msg")) if asked else text["error_msg"],
        }
    )
    rows = observed(with_metadata(rows, config.types, config.tags), "metadata")
    rows = with_destination(rows, config.rule_set)
    rows = rows.withColumn("disposition", F.lit(config.disposition)).withColumn("exit_code", exit_code(F.col("error_kind")))
    return observed(rows.drop("reply_error_kind", "reply_error_msg") if asked else rows, "plan")
