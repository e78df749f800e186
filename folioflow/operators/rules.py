"""Ordered filing rules: first match, path templates, checks of the rendered path.

A rule list is small and static, so it compiles to one CASE expression per output column:
no join, no shuffle, first match by construction. ``joined_rules`` is the same over a table
of rules, for rules that live in data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .templates import Template, TemplateError

#: What a path template may name, and what an argument template may.
PATH_FIELDS = ("Type", "Correspondent", "Reference", "Title", "Year", "Month", "Day", "Tags")
ARGUMENT_FIELDS = ("Path", "Title", "Type", "Correspondent", "Reference", "Description", "Amount", "Currency", "Tags", "DocumentDate", "DueDate")

#: Of these the lists.
PATH_LISTS = ("Tags",)


@dataclass(frozen=True)
class Rule:
    """Conditions that are empty hold for everything; comparisons are exact, with case."""

    name: str
    path: str
    type: str = ""
    correspondent: str = ""
    tags: tuple[str, ...] = ()
    template: Template = field(init=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "template", Template.parse(self.path, PATH_FIELDS, f"the path of rule {self.name!r}", PATH_LISTS))

    @property
    def is_default(self) -> bool:
        return not (self.type or self.correspondent or self.tags)

    def matches(self, type_: Column, correspondent: Column, tags: Column) -> Column:
        out = F.lit(True)
        if self.type:
            out = out & (F.coalesce(type_, F.lit("")) == self.type)
        if self.correspondent:
            out = out & (F.coalesce(correspondent, F.lit("")) == self.correspondent)
        for tag in self.tags:
            out = out & F.coalesce(F.array_contains(tags, tag), F.lit(False))
        return out


def first_match(rules: Sequence[Rule], type_: Column, correspondent: Column, tags: Column) -> Column:
    """The place (0, 1, …) of the first rule that matches, null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules):
        out = out.when(rule.matches(type_, correspondent, tags), F.lit(k))
    return out


def by_place(place: Column, values: Sequence[Column]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, value in enumerate(values):
        out = out.when(place == k, value)
    return out


def joined_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """``docs`` (type, correspondent, tags, and whatever else) with ord, rule_name and path of the
    first rule of a table (ord, name, type, tags, correspondent, path) that fits each row; null
    where none does.

    The table is folded to one value, an array in order, which every row then goes through: no
    row is joined or shuffled, none needs a key, and equal rows stay apart. It must be a rule
    list, not data that grows: the array has to fit a value."""
    own = F.struct("ord", F.col("name").alias("rule_name"), "path", "type", "correspondent", "tags")
    listed = rules.agg(F.sort_array(F.collect_list(own)).alias("_rules"))
    r_type, r_from = (lambda r: r["type"]), (lambda r: r["correspondent"])
    free = lambda x: F.coalesce(x, F.lit("")) == ""
    fits = lambda r: (
        (free(r_type(r)) | (r_type(r) == F.col("type")))
        & (free(r_from(r)) | (r_from(r) == F.col("correspondent")))
        & F.forall(F.coalesce(r["tags"], F.array().cast("array<string>")), lambda t: F.array_contains("tags", t))
    )
    met = docs.select("*", listed.scalar().alias("_rules")).withColumn("_first", F.get(F.filter("_rules", fits), F.lit(0)))
    return met.withColumns({k: F.col("_first")[k] for k in ("ord", "rule_name", "path")}).drop("_rules", "_first")


def path_fault(path: Column) -> Column:
    """Why a rendered path can't be used, in the order the checks are made; null if it can."""
    segments = F.split(path, "/")
    first_bad = F.get(F.filter(segments, lambda s: s.isin("", ".", "..")), F.lit(0))
    return (
        F.when(path == "", F.lit("empty path"))
        .when(F.contains(path, F.lit("\\")), F.lit("backslash"))
        .when(first_bad == "", F.lit("empty path segment"))
        .when(first_bad.isNotNull(), F.concat(F.lit("traversal segment "), first_bad))
    )


def joined_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


__all__ = ["ARGUMENT_FIELDS", "PATH_FIELDS", "PATH_LISTS", "Rule", "Template", "TemplateError", "by_place", "first_match", "joined_path", "joined_rules", "path_fault"]
