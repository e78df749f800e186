"""Strict decoding of a model's JSON reply, without Python.

A reply counts only if it is exactly one object with known keys of the right types. Nothing
is stripped or coerced: prose, fences, several values and other shapes are malformed. The
reply is parsed inside brackets, so that whatever stands around the object shows.

Keys are compared without regard to case, and of a key given several times the last holds.
Known limit of the built-in parser: a stray ``]`` behind the object isn't noticed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import amount_and_currency, normalised_tags, parsed_date
from .text import trim_space

#: The keys of a reply; those that must be there come first, in reporting order.
REQUIRED_TEXTS = ("title", "type", "filename")
OPTIONAL_TEXTS = ("correspondent", "document_date", "due_date", "reference", "description", "amount", "currency")
KEYS = (*REQUIRED_TEXTS, "tags", *OPTIONAL_TEXTS)


#: Of equal keys the last holds. The parser takes it from the session when it is resolved, so it
#: is set for good: switched back, two threads of a session could see each other's value.
_LAST_HOLDS = "spark.sql.variant.allowDuplicateKeys"


def _by_lower_key(values: Column, keys: Column) -> Column:
    """``values`` by key in lower case, of keys that differ in case only the last one written; as
    they are where no key has a capital or comes again, which is nearly always."""
    low = F.transform(keys, F.lower)
    last = F.filter(keys, lambda k, i: ~F.array_contains(F.slice(low, i + 2, F.size(low)), F.lower(k)))
    renamed = F.map_from_arrays(F.transform(last, F.lower), F.transform(last, lambda k: F.element_at(values, k)))
    return F.when(F.array_distinct(low) == keys, values).otherwise(renamed)


def with_fields(df, reply: str = "reply"):
    """Add ``fields``, a struct of the reply's values, and ``malformed``, why there are none."""
    df.sparkSession.conf.set(_LAST_HOLDS, "true")
    df = df.withColumn("_all", F.try_parse_json(F.concat(F.lit("["), F.col(reply), F.lit("]"))))
    df = df.withColumn("_one", F.try_variant_get("_all", "$[0]", "variant")).withColumn("_two", F.try_variant_get("_all", "$[1]", "variant"))
    df = df.withColumn("_shape", F.schema_of_variant("_one")).withColumn("_values", F.try_variant_get("_one", "$", "map<string,variant>"))
    df = df.withColumn("_keys", F.when(F.col("_values").isNotNull(), F.json_object_keys(reply)))
    df = df.withColumn("_low", _by_lower_key(F.col("_values"), F.col("_keys")))
    df = df.withColumns({f"_{k}": F.try_element_at("_low", F.lit(k)) for k in KEYS})
    wrong = F.lit(None).cast("string")
    for key in reversed(KEYS):
        kind = F.coalesce(F.schema_of_variant(f"_{key}"), F.lit("VOID"))
        good = kind.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>") if key == "tags" else kind.isin("VOID", "STRING")
        wrong = F.when(~good, F.lit(f"{key} has another type")).otherwise(wrong)
    reason = (
        F.when(F.col("_one").isNull(), F.lit("not JSON"))
        .when(F.col("_two").isNotNull(), F.lit("more than one JSON value"))
        .when(~F.coalesce(F.col("_shape").startswith("OBJECT"), F.lit(False)) | F.col("_keys").isNull(), F.lit("not an object"))
        .when(F.size(F.array_except(F.map_keys("_low"), F.array(*[F.lit(k) for k in KEYS]))) > 0, F.lit("unknown key"))
        .otherwise(wrong)
    )
    texts = [F.try_variant_get(f"_{k}", "$", "string").alias(k) for k in (*REQUIRED_TEXTS, *OPTIONAL_TEXTS)]
    tags = F.try_variant_get("_tags", "$", "array<string>").alias("tags")
    df = df.withColumn("malformed", reason).withColumn("fields", F.when(F.col("malformed").isNull(), F.struct(*texts, tags)))
    return df.drop("_all", "_one", "_two", "_keys", "_shape", "_values", "_low", *[f"_{k}" for k in KEYS])


def missing_field(fields: Column) -> Column:
    """The first required field that is absent or blank, as a message; null if none."""
    out = F.when(F.lit(False), F.lit(""))
    for name in REQUIRED_TEXTS:
        out = out.when(fields[name].isNull(), F.lit(f"the required field {name} is absent"))
        out = out.when(trim_space(fields[name]) == "", F.lit(f"the required field {name} is empty"))
    return out.when(fields["tags"].isNull(), F.lit("the required field tags is absent"))


def metadata(fields: Column) -> Column:
    """The normalised metadata of decoded fields."""
    text = lambda k: F.coalesce(trim_space(fields[k]), F.lit("")).alias(k)
    amount, currency = amount_and_currency(fields["amount"], fields["currency"])
    return F.struct(
        text("title"),
        text("type"),
        text("correspondent"),
        normalised_tags(fields["tags"]).alias("tags"),
        parsed_date(trim_space(fields["document_date"])).alias("document_date"),
        parsed_date(trim_space(fields["due_date"])).alias("due_date"),
        text("reference"),
        text("description"),
        amount.alias("amount"),
        currency.alias("currency"),
        text("filename"),
    )
