"""Text expressions: trimming, pages, excerpts. Lengths are code points unless named bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the Unicode White_Space property, as a regex class body
#: that Java and RE2 read alike.
SPACE_CLASS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Bounds of the excerpts.
USABLE_LAYER_CHARS = 64
PROMPT_HEAD, PROMPT_TAIL = 2048, 1024
SNIPPET_BYTES = 120
OUTPUT_BYTES = 8192
OUTPUT_MARK = "\n… (truncated at 8 KiB)"


def _str(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def trim_space(x: Column) -> Column:
    """``x`` without Unicode white space at both ends; by default ``trim`` strips blanks only."""
    return F.btrim(x, F.lit(SPACES))


def is_blank(x: Column) -> Column:
    return ~x.rlike(rf"[^{SPACE_CLASS}]")


#: The same characters as text.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def non_space_chars(x: Column) -> Column:
    return F.length(F.translate(x, SPACES, ""))


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def split_pages(x: Column, page_break: str = "\f") -> Column:
    """Pages between breaks, without one blank last page; never an empty array."""
    pages = F.split(or_empty(x), F.lit(rf"\Q{page_break}\E"))
    cut = F.when(is_blank(F.element_at(pages, -1)), F.slice(pages, F.lit(1), F.size(pages) - 1)).otherwise(pages)
    return F.when(F.size(cut) == 0, F.array(F.lit(""))).otherwise(cut)


def capped_pages(total: Column, most: int) -> Column:
    """Number of pages that are read: all, or ``most`` if that is positive and fewer."""
    return total if most <= 0 else F.least(total, F.lit(most))


def truncation(total: Column, most: int) -> Column:
    """struct(pages_processed, pages_total) if pages are dropped, else null."""
    kind = "struct<pages_processed:int,pages_total:int>"
    if most <= 0:
        return F.lit(None).cast(kind)
    return F.when(total > most, F.struct(F.lit(most).alias("pages_processed"), total.alias("pages_total"))).cast(kind)


def usable_text_layer(pages: Column) -> Column:
    """Whether the pages have 64 characters or more that aren't white space, all together; the
    match ends at the 64th, however long the pages are."""
    return F.array_join(pages, "").rlike(rf"\A(?:[{SPACE_CLASS}]*+[^{SPACE_CLASS}]){{{USABLE_LAYER_CHARS}}}")


def elided(x: Column) -> Column:
    """A long prompt's head and tail, and between them how much was left out."""
    n, shown = F.length(x), PROMPT_HEAD + PROMPT_TAIL
    mark = F.concat(F.lit("\n… (elided "), (n - shown).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" runes) …\n"))
    return F.when(n <= shown, x).otherwise(F.concat(F.substring(x, 1, PROMPT_HEAD), mark, F.right(x, F.lit(PROMPT_TAIL))))


def cut_bytes(x: Column, most: int) -> Column:
    """The first ``most`` bytes of ``x`` as text, without a character that the cut would split:
    the longest head that isn't followed by a byte which goes on with a character."""
    raw = F.encode(x, "UTF-8")
    goes_on = lambda at: F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")
    out = F.substring(raw, 1, most - 3)
    for at in (most - 2, most - 1, most):
        out = F.when(~goes_on(at), F.substring(raw, 1, at)).otherwise(out)
    return out.cast("string")


def snippet(x: Column) -> Column:
    """The trimmed text's first 120 bytes, for a message."""
    short = trim_space(x)
    return F.when(F.octet_length(short) <= SNIPPET_BYTES, short).otherwise(F.concat(cut_bytes(short, SNIPPET_BYTES), F.lit("…")))


def cut_output(x: Column) -> Column:
    """A command's output, at most 8 KiB and a mark."""
    return F.when(F.octet_length(x) <= OUTPUT_BYTES, x).otherwise(F.concat(cut_bytes(x, OUTPUT_BYTES), F.lit(OUTPUT_MARK)))


def or_dash(x: Column) -> Column:
    return F.coalesce(null_if_empty(x), F.lit("-"))


def prompt_lines(role: str, x: Column) -> Column:
    """A traced prompt, each line under its role."""
    label = F.lit(f"  {role:<6}| ")
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(x, "\n"), lambda line: F.concat(label, line)))
