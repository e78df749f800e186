"""Golden cases of the scalar expressions."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import decode, mime, naming, normalise, text

c = F.col


def one(spark, values, expr, kind="string"):
    """``expr`` of column x over values, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").coalesce(1)
    return [r[1] for r in sorted(rows.select("i", expr.alias("y")).collect(), key=lambda r: r[0])]


#: Made from the stated rules: accents folded, lower case, runs of all else to one hyphen, none
#: at the ends, at most 120 bytes.
SANITISED = {
    "Lathe No. 7 (spare)": "lathe-no-7-spare",
    "Žluťoučký kůň": "zlutoucky-kun",
    "Ång-Ström_42": "ang-strom-42",
    "a.b..c...d": "a-b-c-d",
    "tab\tand\nline": "tab-and-line",
    "-lead and trail-": "lead-and-trail",
    "UPPER lower 09": "upper-lower-09",
    "Ελλάδα": "",
    "½ x²": "x",
    "Ω42Ω": "42",
    "~~~": "",
    "ü" * 130: "u" * 120,
    "x" * 119 + "--y": "x" * 119,
    "\\server\\share": "server-share",
    "": "",
}


def test_sanitised(spark):
    assert dict(zip(SANITISED, one(spark, list(SANITISED), naming.sanitised(c("x"))), strict=True)) == SANITISED
    long = one(spark, ["seven-letter-words " * 30, None], naming.sanitised(c("x")))
    assert len(long[0]) <= 120 and not long[0].endswith("-") and long[1] == ""


def test_sanitised_equals_model_over_characters(spark):
    chars = [f"a{chr(k)}b" for k in range(0xD7FF) if k]
    got = one(spark, chars, naming.sanitised(c("x")))
    assert [x for x, y in zip(chars, got, strict=True) if naming.sanitised_model(x) != y] == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=200), min_size=20, max_size=50))
def test_sanitised_equals_model(spark, values):
    values = [v.replace("\x00", "").encode("utf-8", "ignore").decode() for v in values]
    assert one(spark, values, naming.sanitised(c("x"))) == [naming.sanitised_model(v) for v in values]


#: proposal, original, extension, date, and what they make: every combination of what is there.
DERIVED = [
    ("Mill manual", "p0012", ".pdf", "2031-11-05", "2031-11-05-mill-manual.pdf", True),
    ("Mill manual", "p0012", ".pdf", "", "mill-manual.pdf", True),
    ("Mill manual", "p0012", "", "", "mill-manual", True),
    ("Mill manual", "p0012", ".TIFF", "", "mill-manual.TIFF", True),
    ("2031-11-05 mill", "p0012", ".pdf", "2031-11-05", "2031-11-05-mill.pdf", True),
    ("***", "P 0012", ".png", "2031-11-05", "2031-11-05-p-0012.png", False),
    (None, "P 0012", ".png", "", "p-0012.png", False),
    ("***", "Ωμέγα", ".png", "2031-11-05", "2031-11-05.png", False),
    ("", "???", ".png", "", "document.png", False),
    ("up/../and\\away", "p", ".txt", "", "up-and-away.txt", True),
]


def test_derived_names(spark):
    rows = spark.createDataFrame([r[:4] for r in DERIVED], "p string, o string, e string, d string").coalesce(1)
    named = naming.with_name(rows, c("p"), c("o"), c("e"), c("d"))
    assert [(r[0], r[1]) for r in named.select("name.base", "name.from_proposal").collect()] == [r[4:] for r in DERIVED]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.dates(dt.date(1900, 1, 1), dt.date(2199, 12, 31)).map(str), st.from_regex(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", fullmatch=True), st.text("0123456789-/ T:", max_size=12)), min_size=40, max_size=80))
def test_dates_equal_model(spark, values):
    def model(x):
        try:
            return dt.date.fromisoformat(x) if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", x) else None
        except ValueError:
            return None

    values = [v for v in values if not v.startswith("0000")]
    assert one(spark, values, normalise.parsed_date(c("x"))) == [model(v) for v in values]


def test_dates(spark):
    cases = {"2031-11-05": dt.date(2031, 11, 5), "2032-02-29": dt.date(2032, 2, 29)}
    cases |= dict.fromkeys(["2031-02-29", "2031-11-31", "2031-00-10", "31-11-05", "2031/11/05", "2031-11-5", "05.11.2031", "2031-11-05 ", "2031-11-05T00:00", "Nov 5", " ", None])
    assert one(spark, list(cases), normalise.parsed_date(c("x"))) == list(cases.values())


def test_decimals(spark):
    good = ["7", "-7", "007", "7.0", "-0.5", "98765432109876543210.000000000001"]
    bad = ["", "--7", "7-", ".7", "7.", "7..0", "7,0", "7_000", "7 000", "+7", "7e2", "7%", "$7", "٧", "inf", "0b1", "7\n", "\t7", None]
    assert one(spark, good + bad, normalise.is_decimal(c("x"))) == [True] * len(good) + [False] * len(bad)


def test_amount_and_currency(spark):
    amounts, currencies = {"12.30": "12.30", " 7 ": "7", "-1": "-1", "1,5": None, "": None, None: None}, {"CHF": "CHF", "\nJPY": "JPY", "chf": None, "CHFR": None, "Fr": None, "": None, None: None}
    rows = [(x, y) for x in amounts for y in currencies]
    want = [(amounts[x], currencies[y]) if amounts[x] and currencies[y] else (None, None) for x, y in rows]
    a, b = normalise.amount_and_currency(c("a"), c("b"))
    assert [tuple(r) for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(a, b).collect()] == want


def test_tags(spark):
    cases = [(["Lathe", "MILL"], ["lathe", "mill"]), (["mill", " Mill", "MILL\t"], ["mill"]), (["z", "y", "a", "y"], ["z", "y", "a"]), (["\u00a0safety\u2003"], ["safety"]), ([" ", None, "", "x"], ["x"]), (["Éclair"], ["éclair"]), ([], []), (None, [])]
    assert one(spark, [x for x, _ in cases], normalise.normalised_tags(c("x")), "array<string>") == [y for _, y in cases]


def test_text_layer(spark):
    cases = [("a" * 64, True), ("a" * 63, False), ("", False), (" \n\t", False), ("fi\n\n  \n", False), ("a" * 32 + "\f" + "b" * 32, True), ("a \n" * 63, False), ("a  " * 64, True)]
    assert one(spark, [x for x, _ in cases], text.usable_text_layer(text.split_pages(c("x")))) == [y for _, y in cases]


def test_pages(spark):
    cases = [("a\fb\f", ["a", "b"]), ("a\fb", ["a", "b"]), ("", [""]), ("\f", [""]), ("a\f\f", ["a", ""]), (None, [""])]
    assert one(spark, [x for x, _ in cases], text.split_pages(c("x"))) == [y for _, y in cases]


def test_excerpts(spark):
    x = "é" * 5000
    got = one(spark, [x, "short"], text.elided(c("x")))
    assert got == ["é" * 2048 + "\n… (elided 1928 of 5000 runes) …\n" + "é" * 1024, "short"]
    cut = one(spark, ["é" * 5000, "ok"], text.cut_output(c("x")))
    assert cut == ["é" * 4096 + "\n… (truncated at 8 KiB)", "ok"]
    assert one(spark, [" " + "a" * 121, " b "], text.snippet(c("x"))) == ["a" * 120 + "…", "b"]
    assert one(spark, ["a\nb", ""], text.prompt_lines("user", c("x"))) == [["  user  | a", "  user  | b"], []]


KINDS = [
    (b"%PDF-1.7\n", "application/pdf"),
    (b"II\x2a\x00rest", "image/tiff"),
    (b"MM\x00\x2arest", "image/tiff"),
    (bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 20, "application/x-ole-storage"),
    (b"\x89PNG\r\n\x1a\n....", "image/png"),
    (b"\xff\xd8\xff\xe0", "image/jpeg"),
    (b"RIFF\x10\0\0\0WEBPVP8 ", "image/webp"),
    (b"GIF89a...", "image/gif"),
    (b"PK\x03\x04....", "application/zip"),
    (b"  \n<!doctype HTML>", "text/html"),
    (b"<p>x", "text/html"),
    (b"<px>", "text/plain"),
    (b"<!-- x", "text/html"),
    (b"\n<?xml version", "text/xml"),
    (b"plain text \xc3\xa9\n", "text/plain"),
    (b"bin\x00ary", "application/octet-stream"),
    (b"\xef\xbb\xbfhello", "text/plain"),
    (b"\xff\xfeh\0", "text/plain"),
    (b"a" * 600 + b"\0", "text/plain"),
    (b"\x00\x00\x00\x18ftypmp42\x00\x00\x00\x00mp42isom", "video/mp4"),
    (b"\x1f\x8b\x08\0", "application/x-gzip"),
    (b"", "text/plain"),
]


def test_kinds(spark):
    assert one(spark, [bytearray(x) for x, _ in KINDS], mime.sniffed(c("x")), "binary") == [y for _, y in KINDS]


GOOD = '{"title":"t","type":"x","tags":["a"],"filename":"f"}'


@pytest.mark.parametrize(
    "raw,bad",
    [
        (GOOD, False),
        (" " + GOOD + "\n", False),
        ('{"title":"t","type":"x","tags":[],"filename":"f","amount":null}', False),
        ('{"title":"t","type":"x","tags":[null,"a"],"filename":"f"}', False),
        ("Sure! " + GOOD, True),
        ("```json\n" + GOOD + "\n```", True),
        ('{"title":"t","type":"x","tags":["a"],"filename":"f","folder":"z"}', True),
        ('{"a":1}', True),
        ("[" + GOOD + "]", True),
        ('"text"', True),
        (GOOD + GOOD, True),
        (GOOD + "," + GOOD, True),
        ("", True),
        (" ", True),
        ('{"Title":"t","TYPE":"x","Tags":["a"],"fileName":"f"}', False),
        ('{"title":1,"title":"t","type":"x","tags":["a"],"filename":"f"}', False),
        ('{"title":"t","Title":1,"type":"x","tags":["a"],"filename":"f"}', True),
        ('{"title":1,"type":"x","tags":["a"],"filename":"f"}', True),
        ('{"title":"t","type":"x","tags":"a","filename":"f"}', True),
        ('{"title":"t","type":"x","tags":["a",1],"filename":"f"}', True),
    ],
)
def test_strict_decoding(spark, raw, bad):
    rows = decode.with_fields(spark.createDataFrame([(raw,)], "reply string"))
    assert (rows.first()["malformed"] is not None) is bad


def test_the_last_of_equal_keys_holds(spark):
    raw = '{"TITLE":"one","title":"two","Title":"three","type":"x","tags":["a"],"tags":["b"],"filename":"f","reference":"r","Reference":null}'
    got = decode.with_fields(spark.createDataFrame([(raw,)], "reply string")).first()["fields"]
    assert (got["title"], got["tags"], got["reference"]) == ("three", ["b"], None)


def test_cuts_keep_characters_whole(spark):
    for x in ("é", "日", "😀", "aé日😀"):
        for shift in range(4):
            whole = "a" * shift + x * 5000
            cut = whole.encode()[:8192].decode("utf-8", "ignore")
            assert one(spark, [whole], text.cut_output(c("x"))) == [cut + "\n… (truncated at 8 KiB)"]


def test_missing_fields(spark):
    cases = {
        GOOD: None,
        '{"type":"x","tags":[],"filename":"f"}': "the required field title is absent",
        '{"title":null,"type":"x","tags":[],"filename":"f"}': "the required field title is absent",
        '{"title":" ","type":"x","tags":[],"filename":"f"}': "the required field title is empty",
        '{"title":"t","type":"","tags":[],"filename":"f"}': "the required field type is empty",
        '{"title":"t","type":"x","tags":[],"filename":" "}': "the required field filename is empty",
        '{"title":"t","type":"x","filename":"f"}': "the required field tags is absent",
    }
    rows = decode.with_fields(spark.createDataFrame([(x,) for x in cases], "reply string").coalesce(1))
    assert [r[0] for r in rows.select(decode.missing_field(c("fields"))).collect()] == list(cases.values())
