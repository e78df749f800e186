"""Rules, paths, claims, plans, configuration."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import claim, rules
from folioflow.plans import config as C
from folioflow.plans.plan import build_plan, exit_code
from folioflow.queries import sample_config

c = F.col

R1 = [
    rules.Rule("hot work", "safety/{{.Year}}", "", "", ("safety", "welding")),
    rules.Rule("kern reports", "reports/kern/{{.Reference}}", "test-report", "Kern"),
    rules.Rule("reports", "reports/{{.Correspondent}}/{{.Year}}", "test-report"),
    rules.Rule("lathe", "machines/lathe", "", "", ("lathe",)),
    rules.Rule("rest", "rest/{{.Type}}"),
]
MATCHES = [
    ("manual", "", ["welding", "safety"], "hot work"),
    ("test-report", "Kern", ["safety", "x", "welding"], "hot work"),
    ("test-report", "Kern", ["safety"], "kern reports"),
    ("test-report", "kern", [], "reports"),
    ("test-report", "", ["lathe"], "reports"),
    ("manual", "Kern", ["lathe"], "lathe"),
    ("manual", "Kern", ["lathes"], "rest"),
    ("Test-Report", "Kern", [], "rest"),
    ("", "", [], "rest"),
]


def test_first_match(spark):
    rows = spark.createDataFrame([m[:3] for m in MATCHES], "t string, k string, g array<string>").coalesce(1)
    place = rules.first_match(R1, c("t"), c("k"), c("g"))
    assert [r[0] for r in rows.select(rules.by_place(place, [F.lit(r.name) for r in R1])).collect()] == [m[3] for m in MATCHES]


def test_joined_rules_agree(spark):
    table = spark.createDataFrame([(k, r.name, r.type, list(r.tags), r.correspondent, r.path) for k, r in enumerate(R1)], "ord int, name string, type string, tags array<string>, correspondent string, path string")
    rows = spark.createDataFrame([(i, *m[:3], "own") for i, m in enumerate(MATCHES)], "id int, type string, correspondent string, tags array<string>, name string")
    joined = rules.joined_rules(rows, table)
    got = {r["id"]: r["rule_name"] for r in joined.collect()}
    assert [got[i] for i in range(len(MATCHES))] == [m[3] for m in MATCHES] and {r["name"] for r in joined.collect()} == {"own"}
    # rows without a key, equal or not, are each judged alone
    again = rows.unionByName(rows).withColumn("id", F.lit(None).cast("int"))
    names = [r["rule_name"] for r in rules.joined_rules(again, table).collect()]
    assert sorted(map(str, names)) == sorted(2 * [str(m[3]) for m in MATCHES])
    assert rules.joined_rules(rows, table.where("false")).where("ord IS NULL AND rule_name IS NULL").count() == len(MATCHES)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0]


@pytest.mark.parametrize("tags,hit", [(["mill", "lathe"], True), (["lathe", "x", "mill"], True), (["mill"], False), ([], False), (None, False)])
def test_all_tags_needed(spark, tags, hit):
    rule = rules.Rule("r", "x", "", "", ("mill", "lathe"))
    rows = spark.createDataFrame([(tags,)], "g array<string>")
    assert rows.select(rule.matches(F.lit(""), F.lit(""), c("g"))).first()[0] is hit


@pytest.mark.parametrize("path,fault", [("machines/mill", None), ("x", None), ("", "empty path"), ("/x", "empty path segment"), ("x//", "empty path segment"), ("x/..", "traversal segment .."), ("x/./y", "traversal segment ."), (".../x", None), ("x\\..", "backslash"), ("//\\", "backslash")])
def test_path_faults(spark, path, fault):
    assert spark.createDataFrame([(path,)], "p string").select(rules.path_fault(c("p"))).first()[0] == fault


@pytest.mark.parametrize(
    "bad",
    [
        "{{.Folder}}", "{{.Year", "{{printf .Year}}", "{{.}}", "{{if .Year}}x", "{{end}}", "{{else}}", "{{if}}x{{end}}", "{{if .Year}}x{{else}}y{{else}}z{{end}}", "{{range .Year}}x{{end}}",
        "{{eq .Year 7}}", "{{lt .Tags .Tags}}", "{{$x := .Year}}", '{{printf "%d" .Year}}', '{{printf "%s"}}', "{{shout .Year}}", "{{(.Year}}", "{{.Year .Month}}", "{{.Year | .Month}}", "{{with .Year}}{{.Month}}{{end}}", "{{if .Year}}x{{end .}}x", '{{"x}}', "{{or .Year 7}}",
    ],
)
def test_templates_refused(bad):
    with pytest.raises(rules.TemplateError):
        rules.Rule("r", bad)


#: Template, values, text; a list is Tags.
RENDERED = [
    ("a/{{ .Year }}/b", {"Year": "2031"}, "a/2031/b"),
    ("{{if .Year}}y{{end}}", {"Year": None}, ""),
    ("{{if .Year}}y{{else if .Month}}m{{else}}n{{end}}", {"Month": "05"}, "m"),
    ("{{if .Year}}{{if .Month}}both{{else}}year{{end}}{{else}}none{{end}}", {"Year": "1"}, "year"),
    ("{{with .Title}}{{.}}-{{$.Year}}{{else}}no{{end}}", {"Title": "t", "Year": "1"}, "t-1"),
    ("{{with .Title}}{{.}}{{else with .Year}}{{.}}!{{end}}", {"Year": "1"}, "1!"),
    ("{{range .Tags}}<{{.}}>{{end}}", {"Tags": ["a", "b"]}, "<a><b>"),
    ("{{range .Tags}}{{if eq . $.Year}}={{else}}{{.}}{{end}}{{else}}none{{end}}", {"Tags": ["a", "1"], "Year": "1"}, "a="),
    ("{{.Tags}}", {"Tags": ["a", "b"]}, "[a b]"),
    ("x {{- .Year -}} y", {"Year": "1"}, "x1y"),
    ("x{{/* said */}}y{{- /* and */ -}} z", {}, "xyz"),
    ('{{or .Year .Month "z"}}{{and .Title "t"}}', {"Month": "2"}, "2"),
    ('{{and .Month "t"}}|{{not .Year}}|{{len .Tags}}', {"Month": "2", "Tags": ["a"]}, "t|true|1"),
    ('{{eq .Year "1" "2"}}{{ne .Year "1"}}{{le .Year "2"}}{{gt (len .Title) 2}}', {"Year": "2", "Title": "é"}, "truetruetruefalse"),
    ('{{printf "%s/%v-%d%%%q" .Year true 7 "a\\"b"}}', {"Year": "2"}, '2/true-7%"a\\"b"'),
    ("{{print 1 2 .Year 3}}{{`raw }}`}}", {"Year": "x"}, "1 2x3raw }}"),
    ('{{.Year | printf "%s-%s" .Month | printf "<%s>"}}', {"Year": "1", "Month": "2"}, "<2-1>"),
    ("{{if and .Year (or .Month (not .Day))}}in{{end}}", {"Year": "1"}, "in"),
]


def test_templates_rendered(spark):
    columns = []
    for template, values, _ in RENDERED:
        made = rules.Template.parse(template, rules.PATH_FIELDS, "x", rules.PATH_LISTS)
        given = {k: F.array(*map(F.lit, values[k])) if k in values and k == "Tags" else F.lit(values.get(k)).cast("array<string>" if k == "Tags" else "string") for k in rules.PATH_FIELDS}
        columns.append(made.rendered(given).alias(f"c{len(columns)}"))
    got = spark.range(1).select(*columns).first()
    for (template, _, want), text in zip(RENDERED, got, strict=True):
        assert text == want, template


def test_templates_name_their_fields():
    t = rules.Template.parse('{{if eq .Type "x"}}{{range .Tags}}{{$.Year}}{{end}}{{end}}', rules.PATH_FIELDS, "x", rules.PATH_LISTS)
    assert t.names == {"Type", "Tags", "Year"} and rules.Template.parse("{{.}}", ("",), "x").names == {""}


def brute_claims(rows, held=(), most=1000):
    """Names tried one after another, in order of arrival."""
    taken, out = {p: (s, d) for p, s, d in held}, {}
    for arrival, dest, size, digest in sorted(rows):
        stem, dot, ext = dest.rpartition(".") if "." in dest.rpartition("/")[2] else (dest, "", "")
        for n in range(1, most + 1):
            name = dest if n == 1 else f"{stem}-{n}{dot}{ext}"
            if name not in taken:
                taken[name] = (size, digest)
                out[arrival] = (name, False)
                break
            if size > 0 and taken[name] == (size, digest):
                out[arrival] = (name, True)
                break
        else:
            out[arrival] = (None, False)
    return out


def _claims(spark, rows, held=None, most=1000):
    df = spark.createDataFrame(rows, "arrival int, dest string, size long, digest string")
    there = None if held is None else spark.createDataFrame(held, "path string, size long, digest string")
    got = claim.claim(df, there, most=most).collect()
    assert all((r["claim_error"] is None) == (r["final_dest"] is not None) for r in got)
    return {r["arrival"]: (r["final_dest"], r["duplicate"]) for r in got}


def test_claims(spark):
    rows = [(1, "a/x.pdf", 3, "d1"), (2, "a/x.pdf", 3, "d2"), (3, "a/x.pdf", 3, "d1"), (4, "a/x.pdf", 4, "d1"), (5, "b/y", 1, "d1"), (6, "b/y", 1, "d2"), (7, "a/x.pdf", 3, "d2"), (8, "a/x.pdf", 0, "e"), (9, "a/x.pdf", 0, "e")]
    got = _claims(spark, rows)
    assert got == brute_claims(rows)
    assert got[3] == ("a/x.pdf", True) and got[6] == ("b/y-2", False) and got[9] == ("a/x-5.pdf", False)


def test_claims_of_names_that_look_suffixed(spark):
    rows = [(1, "a/x.pdf", 3, "d1"), (2, "a/x-2.pdf", 3, "d9"), (3, "a/x.pdf", 3, "d2"), (4, "c/z.pdf", 3, "d1"), (5, "c/z.pdf", 3, "d2"), (6, "a/x-2.pdf", 3, "d2"), (7, "a/x-2-2.pdf", 3, "d7"), (8, "a/x.pdf", 3, "d9"), (9, "a/x-02.pdf", 3, "d1"), (10, "a/x-1.pdf", 3, "d1"), (11, "b-2/x.pdf", 3, "d1"), (12, "b/x.pdf", 3, "d2")]
    assert _claims(spark, rows) == brute_claims(rows)


@pytest.mark.parametrize("seed", range(4))
def test_claims_equal_probing(spark, seed):
    rng = random.Random(seed)
    names = ["a/x.pdf", "a/x-2.pdf", "a/x-3.pdf", "a/y", "b/x.pdf", "b/x-2-2.pdf", "b/x-2.pdf", "c/.hid", "c/v1.2", "c/v1-2.2"]
    if seed % 2:
        names = ["a/x.pdf", "a/y", "b/x.pdf", "c/.hid", "c/v1.2"]
    content = lambda: (lambda k: (0, "e") if k == 0 else (1 + k % 2, f"d{k}"))(rng.randrange(7))
    rows = [(k, rng.choice(names), *content()) for k in range(150)]
    suffixes = ["x.pdf", *(f"x-{n}.pdf" for n in (2, 3, 4, 6, 9, 1001)), "y-2", "y-4", "-2.hid", "v1-3.2", "x-02.pdf"]
    held = [(f"{folder}/{name}", *content()) for folder in "abc" for name in suffixes if rng.random() < 0.6]
    assert _claims(spark, rows) == brute_claims(rows)
    assert _claims(spark, rows, held) == brute_claims(rows, held)
    assert _claims(spark, rows, []) == brute_claims(rows)


def test_contents_behind_a_gap(spark):
    held = [("a/x", 1, "d1"), ("a/x-4", 1, "d4"), ("a/x-6", 1, "d6")]
    rows = [(1, "a/x", 1, "d4"), (2, "a/x", 1, "d8"), (3, "a/x", 1, "d4"), (4, "a/x", 1, "d6"), (5, "a/x", 1, "d9"), (6, "a/x", 1, "d1"), (7, "a/x", 1, "d10")]
    got = _claims(spark, rows, held)
    assert got == brute_claims(rows, held) and got[1] == ("a/x-2", False) and got[6] == ("a/x", True)


def test_too_many_claims(spark):
    rows = [(i, "a/x.pdf", 3, f"d{i}") for i in range(1003)] + [(2000, "a/x.pdf", 3, "d5"), (2001, "a/y", 0, "e"), (2002, "a/x.pdf", 3, "d1002")]
    got = _claims(spark, rows)
    assert got == brute_claims(rows) and got[1000] == (None, False) and got[2000] == ("a/x-6.pdf", True)
    held = [("a/x.pdf", 3, "d7"), ("a/x-3.pdf", 3, "d1002"), ("a/x-2.pdf", 3, "z")]
    assert _claims(spark, rows, held) == brute_claims(rows, held)


def test_contents_of_linked_names_behind_the_last_suffix(spark):
    rows = [(1, "a/x-2.txt", 2, "zz")] + [(10 + i, "a/x.txt", 3, f"d{i}") for i in range(1005)] + [(3000, "a/x.txt", 2, "zz"), (3001, "a/x.txt", 3, "d1"), (3002, "a/x.txt", 3, "new"), (3003, "a/x-2.txt", 3, "d999"), (3004, "a/x.txt", 0, "")]
    got = _claims(spark, rows)
    assert got == brute_claims(rows)
    assert got[3000] == ("a/x-2.txt", True) and got[3001] == ("a/x-3.txt", True) and got[3002] == (None, False)


@pytest.mark.parametrize("seed", range(6))
def test_nested_linked_names_equal_probing(spark, seed):
    """Suffixes on suffixes, few of them, so that names run out on every level."""
    rng = random.Random(seed)
    names = ["x.t", "x-2.t", "x-3.t", "x-2-2.t", "x-2-3.t", "x-3-2.t", "x-2-2-2.t", "x-2-2-2-5.t", "x-5-2.t", "y-2.t", "y-2-2.t", "z.t"]
    content = lambda: (lambda k: (0, "e") if k == 0 else (1 + k % 2, f"d{k}"))(rng.randrange(6 + 6 * (seed % 3)))
    rows = [(k, "f/" + rng.choice(names), *content()) for k in range(160)]
    held = [(f"f/{name}", *content()) for name in [*names, "x-4.t", "y.t", "y-3.t", "x-2-4.t"] if rng.random() < 0.3]
    most = 3 + seed
    assert _claims(spark, rows, None, most) == brute_claims(rows, (), most)
    assert _claims(spark, rows, held, most) == brute_claims(rows, held, most)


def test_no_claims(spark):
    assert _claims(spark, []) == _claims(spark, [], [("a", 1, "d")]) == {}


GOOD = '{"title":"T","type":"protocol","correspondent":%s,"tags":["urgent"],"document_date":"2031-11-05","filename":"Page one"}'


def _plan(spark, rows, config=None):
    df = spark.createDataFrame(rows, "path string, ext string, size long, digest string, mime string, content string, error_kind string, reply string").coalesce(1)
    text = F.struct(c("content"), F.lit("plain").alias("origin"), F.lit(None).cast("struct<pages_processed:int,pages_total:int>").alias("truncation"), c("error_kind"), c("error_kind").alias("error_msg"))
    return build_plan(df.withColumn("text", text).drop("content", "error_kind"), config or sample_config()).collect()


def test_error_precedence(spark):
    row = lambda kind, reply: ("/in/a.txt", ".txt", 1, "d", "text/plain", "x", kind, reply)
    got = _plan(
        spark,
        [
            row("empty", "prose"),
            row(None, "prose"),
            row(None, None),
            row(None, GOOD.replace("protocol", "zzz", 1) % "null"),
            row(None, GOOD.replace('"protocol"', '"minutes"', 1) % "null"),
            row(None, (GOOD % '"///"').replace("urgent", "x")),
            row(None, (GOOD % '"../../etc"').replace("urgent", "x")),
            row(None, (GOOD % '"a/b/c"').replace("urgent", "x")),
            row(None, GOOD % "null"),
        ],
    )
    assert [r["error_kind"] for r in got] == ["empty", "schema-unsupported", "transport", "rejected", "no-rule", "path", None, None, None]
    assert [r["exit_code"] for r in got] == [1, 2, 1, 1, 1, 1, 0, 0, 0]
    assert [r["dest"] for r in got[-3:]] == ["protocols/etc/2031/2031-11-05-page-one.txt", "protocols/a-b-c/2031/2031-11-05-page-one.txt", "protocols/urgent/2031/2031-11-05-page-one.txt"]


def test_exit_codes(spark):
    kinds = [("unsupported", 2), ("archive", 1), ("bomb", 2), (None, 0), ("no-rule", 1)]
    rows = spark.createDataFrame([(k,) for k, _ in kinds], "k string").coalesce(1)
    assert [r[0] for r in rows.select(exit_code(c("k"))).collect()] == [x for _, x in kinds]


def test_configuration_layers(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("archive_root: /a\nocr: {timeout: 1m30s, api_key_env: MINE}\nanalysis: {retries: 5}\ntypes: {fallback: x, values: [x, y]}\nrules:\n  - {name: d, path: z}\n")
    got = C.load(str(path), {"FOLIOFLOW_OCR_MAX_PAGES": "7", "FOLIOFLOW_DISPOSITION": "", "MINE": "secret", "FOLIOFLOW_ANALYSIS_API_KEY": "other"})
    assert (got.archive_root, got.disposition, got.ocr.timeout, got.ocr.max_pages, got.ocr.dpi, got.analysis.retries) == ("/a", "move", 90.0, 7, 200, 5)
    assert (got.ocr.api_key.secret(), got.analysis.api_key.secret()) == ("secret", "other")
    assert "secret" not in repr(got) and "secret" not in f"{got.ocr.api_key} {got}"
    assert got.apply(disposition="copy").validate().disposition == "copy"


@pytest.mark.parametrize(
    "body,said",
    [
        ("archive_root: /a\nnope: 1", "unknown key nope"),
        ("archive_root: /a\nocr: {nope: 1}", "unknown key ocr.nope"),
        ("disposition: move", "archive_root"),
        ("archive_root: /a\ndisposition: burn\ntypes: {fallback: x, values: [x]}", "disposition"),
        ("archive_root: /a", "types.values"),
        ("archive_root: /a\ntypes: {values: [x]}", "types.fallback"),
        ("archive_root: /a\ntypes: {fallback: z, values: [x]}", "types.fallback"),
        ("archive_root: /a\ntypes: {fallback: x, values: [x]}\nrules: [{name: a, path: p}, {name: b, path: q}]", "second rule"),
        ("archive_root: /a\ntypes: {fallback: x, values: [x]}\nrules: [{name: a, path: p, type: x}, {name: a, path: q}]", "duplicate"),
        ("archive_root: /a\ntypes: {fallback: x, values: [x]}\nrules: [{name: a, path: p, type: w}]", "not one of types.values"),
        ("archive_root: /a\ntypes: {fallback: x, values: [x]}\nrules: [{name: a, path: '{{.Nope}}'}]", "not a field"),
        ("archive_root: /a\ntypes: {fallback: x, values: [x]}\nrules: [{name: a}]", "no path"),
        ("archive_root: /a\ntypes: {fallback: x, values: [x]}\narchive: {command: u, args: ['{{.Secret}}']}", "not a field"),
    ],
)
def test_configuration_refused(tmp_path, body, said):
    path = tmp_path / "c.yaml"
    path.write_text(body)
    with pytest.raises(C.ConfigError, match=said.replace(".", r"\.")):
        C.load(str(path), {}).validate()


def test_configuration_missing(tmp_path):
    with pytest.raises(C.NotFound):
        C.load("", {"XDG_CONFIG_HOME": str(tmp_path)})
    with pytest.raises(C.ConfigError):
        C.load(str(tmp_path / "no.yaml"), {})
    with pytest.raises(C.ConfigError, match="FOLIOFLOW_OCR_DPI"):
        C.with_environment(C.Config(), {"FOLIOFLOW_OCR_DPI": "many"})


def test_starter_is_valid():
    got = C.starter().validate()
    assert got.rule_set[-1].is_default and not got.archive_root.startswith("~") and got.archive.configured


@pytest.mark.parametrize("text,value", [("120s", 120), ("1m30s", 90), ("250ms", 0.25), ("1h", 3600), ("1.5m", 90)])
def test_durations(text, value):
    assert C.seconds(text) == value


@pytest.mark.parametrize("text", ["", "120", "ten", "5 s", "s"])
def test_bad_durations(text):
    with pytest.raises(C.ConfigError):
        C.seconds(text)
