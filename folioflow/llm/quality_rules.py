"""Quality rules as a short-circuit cascade, in built-in expressions only.

Each rule is a lazy boolean expression over a text and its words. On a sample of bounded
size, drawn over the whole table, the cascade measures what each rule costs, compiled and
repeated until that is well above a job's jitter, and which rows it rejects. It then takes
again and again the rule with the most rejections, among the rows that are left, per cost.
The ordered rules form one CASE expression: Spark stops at the first branch that holds, so
dear rules see only what cheap ones left. The order changes the work, never which rows are
kept. Sampling reads the texts once more, about a hundredth of what judging them costs.

Defined cases: a null or blank text has no words and is rejected as too short; texts of any
length are taken whole; repeated rows are judged alike; an empty table gives an empty
result; ties between rules go to the cheaper one; other columns pass through, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, store

SYMBOLS = "#*$%&|<>"
#: Rows, about, of the sample that costs and rejections are estimated on.
SAMPLE_ROWS = 300
#: Seconds that a measured job takes at least, for which its rows are repeated; the most times
#: that they are; and runs of which the quickest counts.
LEAST_S, MOST_TIMES, RUNS = 0.1, 64, 2
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``; none of a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _pairs(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with the one ``step`` places on."""
    return let(values, lambda v: F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - step, F.lit(0))), F.slice(v, F.lit(1 + step), F.greatest(F.size(v) - step, F.lit(0))), join))


def n_repeat_words(words_: Column) -> Column:
    """Words in windows of eight words that occur twice or more in the text.

    Hashes of one word are joined to those of two, four and eight. Only where some window
    hash repeats are the windows sorted, equal neighbours kept, and the words they cover
    counted: each next start adds its distance, eight at most.
    """
    both = lambda a, b: F.xxhash64(a, b)
    hashes = F.transform(words_, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = _pairs(hashes, step, both)

    def covered(eights: Column) -> Column:
        placed = F.sort_array(F.transform(eights, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.array().cast("array<int>")
        twins = _pairs(placed, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
        starts = F.sort_array(F.array_distinct(F.flatten(twins)))
        steps = _pairs(starts, 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)

    return let(hashes, lambda e: F.when(F.size(F.array_distinct(e)) == F.size(e), F.lit(0)).otherwise(covered(e))).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for what the rule rejects, never null."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share(words_: Column, pattern: str) -> Column:
    return F.size(F.filter(words_, lambda w: w.rlike(pattern))) / F.greatest(F.size(words_), F.lit(1))


#: The base checks: too few words, too much of the text in repeated windows.
BASE_RULES = (
    Rule("few_words", lambda text, w: F.size(w) < 20),
    Rule("repeated_windows", lambda text, w: 100 * n_repeat_words(w) > 30 * F.size(w)),
)
#: The rest: lengths of words, symbols, repeated lines, words without letters, capitals, and
#: words that run into shouted marks.
MORE_RULES = (
    Rule("word_length", lambda text, w: ~(word_chars(text) / F.greatest(F.size(w), F.lit(1))).between(2.5, 14.0)),
    Rule("symbols", lambda text, w: n_symbols(text) > 0.2 * F.size(w)),
    Rule("repeated_lines", lambda text, w: 2 * n_dup_lines(text) > F.size(lines(text))),
    Rule("no_letters", lambda text, w: _share(w, r"\p{L}") < 0.6),
    Rule("capitals", lambda text, w: _share(w, r"^\P{L}*\p{Lu}{2,}\P{L}*$") > 0.5),
    Rule("shouted", lambda text, w: _share(w, r"[!?]{2,}$") > 0.2),
)
RULES = BASE_RULES + MORE_RULES


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` texts from all over ``docs``, and their words, stored."""
    share = min(1.0, rows / max(docs.count(), 1))
    few = docs.select(F.col("text").cast("string").alias("text")).sample(share, seed=11).limit(4 * rows)
    return store(few.repartition(1).withColumn("words", words(F.col("text"))), "sample")


def seconds_of(sample: DataFrame, expr: Column) -> float:
    """Seconds that ``expr`` takes over the sample, without those of the job around it."""

    def took(value: Column, times: int) -> float:
        rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_time"))
        began = time.perf_counter()
        rows.agg(F.count(F.when(value, 1))).first()
        return time.perf_counter() - began

    idle, times = F.octet_length("text") < 0, 1
    took(expr, 1)  # compiles it
    while True:
        net = min(took(expr, times) for _ in range(RUNS)) - min(took(idle, times) for _ in range(RUNS))
        if net >= LEAST_S or times >= MOST_TIMES:
            return max(net, 1e-6) / times
        times *= 8


def cascade(rules: Sequence[Rule], costs: Sequence[float], rejected: Sequence[Sequence[bool]]) -> list[Rule]:
    """``rules`` in the order of rejection per cost, each on the rows that those before it leave.
    rejected: for each row what each rule says."""
    left, todo, out = list(rejected), list(range(len(rules))), []
    while todo:
        gain = lambda k: sum(row[k] for row in left) / costs[k]
        best = min(todo, key=lambda k: (-gain(k), costs[k], rules[k].name))
        out.append(rules[best])
        left = [row for row in left if not row[best]]
        todo.remove(best)
    return out


def measured_order(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` in the order that a sample of about ``rows`` rows gives them."""
    sample = sampled(docs, rows)
    verdicts = [rule.rejects(F.col("text"), F.col("words")) for rule in rules]
    rejected = [tuple(r) for r in sample.select(*[v.alias(f"r{k}") for k, v in enumerate(verdicts)]).collect()]
    costs = [seconds_of(sample, v) if rejected else 1.0 for v in verdicts]
    discard(sample)
    return cascade(rules, costs, rejected)


def first_rejection(ordered: Sequence[Rule], text: Column, words_: Column) -> Column:
    """The name of the first rule that rejects, null if none does; later ones aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(text, words_), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule of the measured order that rejects a row."""
    ordered = measured_order(docs, rules, sample_rows)
    return docs.withColumn("rejected_by", let(words(F.col("text")), lambda w: first_rejection(ordered, F.col("text"), w)))


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    ordered = measured_order(docs, rules, sample_rows)
    return docs.where(let(words(F.col("text")), lambda w: first_rejection(ordered, F.col("text"), w)).isNull())


# ---------------------------------------------------------------- query


def op2_rules(spark, sf_dir: str) -> DataFrame:
    """The base counts of every document, and the verdict of the cascade on those that pass them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ordered = measured_order(docs, MORE_RULES)
    text, w = F.col("text"), F.col("_words")
    counted = docs.withColumn("_words", words(text)).select(
        "doc_id",
        text,
        w,
        F.size(w).cast("long").alias("n_words"),
        word_chars(text).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(first_rejection(ordered, text, w).isNull()).alias("kept"),
    )


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, s.text, s.w, s.l, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.5 AND 14 AND NOT n_symbols > 0.2 * n_words AND NOT 2 * n_dup_lines > len(l)
       AND NOT len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) / greatest(n_words, 1) < 0.6
       AND NOT len(list_filter(w, lambda x: regexp_full_match(x, '\P{L}*\p{Lu}{2,}\P{L}*'))) / greatest(n_words, 1) > 0.5
       AND NOT len(list_filter(w, lambda x: regexp_matches(x, '[!?]{2,}$'))) / greatest(n_words, 1) > 0.2 AS kept
FROM base
"""
