"""Edges: containers, tools, model calls, commands, filing, traces, whole runs, streaming."""

import hashlib
import io
import json
import os
import re
import stat
import subprocess
import sys
import threading
import time
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow import channel
from folioflow.functions import mime as M
from folioflow.operators import analyse, extract, filing, handoff, rules
from folioflow.plans import config as C
from folioflow.plans import engine as E
from folioflow.sources import documents, inventory, sink
from folioflow.sources.inventory_log import InventoryLog
from folioflow.streaming import intake

c = F.col
WORD, SHEET, SLIDES = M.OOXML.values()


def archive(*members, method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in members:
            z.writestr(name, body, zipfile.ZIP_STORED if name == "mimetype" else method)
    return out.getvalue()


DOCX = archive(("[Content_Types].xml", "<T/>"), ("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>One</w:t></w:p><w:p><w:t>two &amp; three</w:t><w:br/><w:t>four</w:t></w:p></w:d>'))
ODT = archive(("mimetype", M.ODF[0]), ("content.xml", '<o:d xmlns:o="u"><o:p>Guten Tag</o:p><o:p>grün</o:p></o:d>'))
XLSX = archive(("[Content_Types].xml", "<T/>"), ("xl/sharedStrings.xml", "<s><si><t>a</t></si></s>"), ("xl/worksheets/sheet1.xml", "<w><row><v>1</v></row><row><v>2</v></row></w>"), ("xl/styles.xml", "<x>no</x>"))


@pytest.mark.parametrize(
    "content,kind",
    [
        (DOCX, WORD),
        (ODT, M.ODF[0]),
        (XLSX, SHEET),
        (archive(("[Content_Types].xml", ""), ("word/x", ""), ("ppt/y", "")), SLIDES),
        (archive(("word/document.xml", "")), M.ZIP),
        (archive(("a.txt", "x")), M.ZIP),
        (archive(("mimetype", "application/epub+zip"), ("[Content_Types].xml", ""), ("xl/a", "")), SHEET),
        (archive(), M.ZIP),
        (b"PK\x03\x04broken", M.ZIP),
    ],
)
def test_zip_kinds(content, kind):
    assert extract.zip_kind(content) == kind


def test_office_texts():
    assert extract.office_text(WORD, DOCX) == "One\ntwo & three\nfour"
    assert extract.office_text(M.ODF[0], ODT) == "Guten Tag\ngrün"
    assert extract.office_text(SHEET, XLSX) == "a\n1\n2"


def test_archive_bombs():
    many = archive(("[Content_Types].xml", ""), *[(f"word/{k}", "") for k in range(1101)])
    big = archive(("[Content_Types].xml", ""), ("word/document.xml", b"<a>" + b"x" * (68 << 20) + b"</a>"))
    sheets = archive(("[Content_Types].xml", ""), *[(f"xl/worksheets/sheet{k}.xml", b"<a>" + b"y" * (10 << 20) + b"</a>") for k in range(7)])
    for kind, content in ((WORD, many), (WORD, big), (SHEET, sheets)):
        with pytest.raises(extract.Failure) as e:
            extract.office_text(kind, content)
        assert e.value.kind == "bomb"


def tool(folder: Path, name: str, body: str) -> Path:
    path = folder / name
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return path


def test_pdf_pages(tmp_path, monkeypatch):
    tool(tmp_path, "pdftotext", "cat \"$2\" | tail -c +9\n")
    tool(tmp_path, "pdftoppm", 'for last; do :; done; printf img > "$last-1.png"\n')
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    body = "\f".join(f"page {k} " + "w" * 40 for k in range(25)) + "\f"
    text, origin, cut = extract.extracted(M.PDF, b"%PDF-1.7" + body.encode(), extract.Tools())
    assert (origin, cut, text.count("page")) == ("text-layer", (20, 25), 20)
    seen = []
    tools = extract.Tools(vision=lambda media, data: seen.append((media, data)) or "  said ")
    text, origin, cut = extract.extracted(M.PDF, b"%PDF-1.7 \f \f", tools)
    assert (text, origin, cut, seen) == ("said\n\nsaid", "vision", None, [("image/png", b"img")] * 2)
    with pytest.raises(extract.Failure) as e:
        extract.extracted(M.PDF, b"%PDF-1.7 ", extract.Tools())
    assert e.value.kind == "not-configured"


def test_missing_tools(monkeypatch):
    monkeypatch.setenv("PATH", "/nowhere")
    for kind in (M.PDF, M.OLE2):
        with pytest.raises(extract.Failure) as e:
            extract.extracted(kind, b"x", extract.Tools())
        assert e.value.kind == "missing-tool"


def test_extraction_over_rows(spark, tmp_path):
    files = {"a.docx": DOCX, "b.odt": ODT, "c.txt": b"plain \xc3\xa9", "d.bin": b"\0\1", "e.txt": b" \n ", "f.png": b"\x89PNG\r\n\x1a\nxx", "g.zip": archive(("a", "b")), "h.txt": b""}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    tools = extract.Tools(vision=lambda media, data: f"seen {media}")
    rows = extract.with_text(documents.scan_files(spark, str(tmp_path)), tools)
    got = {Path(r["path"]).name: (r["content"], r["origin"], r["error_kind"]) for r in rows.select("path", "text.content", "text.origin", "text.error_kind").collect()}
    assert got == {
        "a.docx": ("One\ntwo & three\nfour", "office", None), "b.odt": ("Guten Tag\ngrün", "office", None), "c.txt": ("plain é", "plain", None), "d.bin": (None, None, "unsupported"),
        "e.txt": (" \n ", "plain", "empty"), "f.png": ("seen image/png", "vision", None), "g.zip": (None, None, "unsupported"), "h.txt": (None, None, "source"),
    }
    assert {r["digest"] for r in rows.collect()} == {hashlib.sha256(b).hexdigest() for b in files.values()}


# ---------------------------------------------------------------- model calls

REPLY = json.dumps({"title": "T", "type": "manual", "tags": [], "filename": "f"})


def answers(*given):
    """A transport that gives one answer after another, and what it was asked."""
    left, asked = list(given), []

    def transport(url, headers, body, timeout):
        asked.append((url, headers, json.loads(body)))
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        status, text = got
        return status, (json.dumps({"choices": [{"message": {"content": text}}]}) if status == 200 else text).encode()

    return transport, asked


def client(transport, **kw):
    return analyse.Client("http://x/v1/", "m", backoff=0.0, transport=transport, **kw)


def test_retries_and_headers():
    transport, asked = answers((503, "busy"), OSError("refused"), (200, "ok"))
    assert client(transport, api_key="k").complete("s", "u") == "ok"
    assert len(asked) == 3 and asked[0][0] == "http://x/v1/chat/completions" and asked[0][1]["Authorization"] == "Bearer k"
    assert asked[0][2] == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}
    transport, asked = answers((200, "ok"))
    client(transport).complete("", "u", [("image/png", b"x")], analyse.response_schema(["a"]))
    assert "Authorization" not in asked[0][1] and asked[0][2]["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,eA=="
    assert asked[0][2]["response_format"]["json_schema"]["schema"]["properties"]["type"]["enum"] == ["a"]


@pytest.mark.parametrize("given,kind,calls", [([(401, "no")], "transport", 1), ([(500, "")] * 3, "transport", 3), ([(501, "")], "schema-unsupported", 1), ([(400, "unknown RESPONSE_FORMAT")], "schema-unsupported", 1), ([(400, "bad")], "transport", 1), ([(404, "")], "schema-unsupported", 1)])
def test_failures(given, kind, calls):
    transport, asked = answers(*given)
    with pytest.raises(analyse.ModelError) as e:
        client(transport).complete("s", "u", schema={})
    assert e.value.kind == kind and len(asked) == calls


def test_prompts_are_traced_without_secrets(caplog):
    transport, _ = answers((200, "ok"))
    with caplog.at_level("DEBUG"):
        client(transport, api_key="s3cret").complete("be brief", "a" * 4000 + "\nlast line", [("image/png", b"x")])
    assert "  system| be brief" in caplog.text and "  user  | last line" in caplog.text and "elided 938 of 4010 runes" in caplog.text
    assert "1 images" in caplog.text and "s3cret" not in caplog.text and "s3cret" not in repr(client(transport, api_key="s3cret"))


def test_bad_responses():
    for body in (b"not json", b"{}", b'{"choices":[]}'):
        with pytest.raises(analyse.ModelError):
            client(lambda *a, body=body: (200, body)).complete("s", "u")


def test_analysis_loop():
    types = ["manual"]
    transport, asked = answers((200, "prose"), (200, REPLY))
    assert analyse.analysed(client(transport), "p", types, []) == REPLY and len(asked) == 2
    transport, asked = answers(*[(200, "prose")] * 3)
    with pytest.raises(analyse.ModelError) as e:
        analyse.analysed(client(transport), "p", types, [])
    assert e.value.kind == "schema-unsupported"
    transport, asked = answers((200, "prose"), (200, REPLY.replace("manual", "z")), (200, "prose"))
    with pytest.raises(analyse.ModelError) as e:
        analyse.analysed(client(transport), "p", types, [])
    assert e.value.kind == "rejected" and len(asked) == 3


def counted(folder, fails_at=""):
    """A transport that notes each call in a file, and fails once, when it meets a word."""
    folder = str(folder)

    def transport(url, headers, body, timeout):
        prompt = json.loads(body)["messages"][-1]["content"]
        if fails_at and fails_at in prompt and not os.path.exists(f"{folder}/failed"):
            Path(f"{folder}/failed").touch()
            raise RuntimeError("the executor is lost")
        named = hashlib.sha256(prompt.encode()).hexdigest()
        with open(f"{folder}/calls", "a") as f:
            f.write(named + "\n")
        said = {"title": named, "type": "manual", "tags": [], "filename": "f"}
        return 200, json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]}).encode()

    return transport


def test_no_prompt_is_asked_twice(spark, sf, tmp_path):
    """All documents, a task that fails on the way, another run, and a compacted store."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "same"), (-3, "same"), (-4, "the last straw")], "doc_id long, text string")).repartition(4)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    store = analyse.ReplyStore(f"file://{tmp_path}/store")
    client = analyse.Client("http://m", "m", transport=counted(tmp_path, "the last straw"))
    ask = lambda: analyse.with_replies(docs, c("text"), client, ["manual"], "", [], store=store)
    calls = lambda: (tmp_path / "calls").read_text().split()
    with pytest.raises(Exception, match="the executor is lost"):
        ask().collect()
    before = len(calls())
    got = {r["doc_id"]: r for r in ask().collect()}
    different = {t for t in texts.values() if t is not None}
    assert 0 < before < len(different) == len(calls()) == len(set(calls()))
    assert len(got) == len(texts) and all((r["reply"] is None) == (texts[k] is None) and r["reply_error_kind"] is None for k, r in got.items())
    prompts = {r["doc_id"]: r["p"] for r in docs.select("doc_id", analyse.user_prompt(c("text"), ["manual"], "", []).alias("p")).collect()}
    assert all(json.loads(r["reply"])["title"] == hashlib.sha256(prompts[k].encode()).hexdigest() for k, r in got.items() if r["reply"])
    store.compact(spark)
    assert not (tmp_path / "store/new").exists()
    docs = docs.unionByName(spark.createDataFrame([(-5, "one more"), (-6, "same")], "doc_id long, text string"))
    assert ask().where("reply IS NOT NULL").count() == len(texts) + 1 and len(calls()) == len(different) + 1
    other = analyse.Client("http://m", "another", transport=counted(tmp_path))
    analyse.with_replies(docs.where("doc_id < -4"), c("text"), other, ["manual"], "", [], store=store).collect()
    assert len(calls()) == len(different) + 3  # another model's replies are its own


def test_requests_run_side_by_side_at_a_pace():
    import threading
    import time

    now, most, starts, lock = [0], [0], [], threading.Lock()

    def slow(url, headers, body, timeout):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            starts.append(time.monotonic())
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return 200, b'{"choices": [{"message": {"content": "x"}}]}'

    from concurrent.futures import ThreadPoolExecutor

    client = analyse.Client("http://paced", "m", transport=slow, rate=50)
    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(lambda k: client.complete("", str(k)), range(20))) == ["x"] * 20
    gaps = sorted(starts)
    assert 1 < most[0] <= 8 and gaps[-1] - gaps[0] >= 19 / 50 - 0.02


def test_engine_asks_once_with_a_store(spark, tmp_path):
    config = C.load(_setup(tmp_path), {}).validate()
    config.analysis.base_url, config.analysis.model = "http://m", "m"
    engine = E.Engine(spark, config, scratch=str(tmp_path / "scratch"), replies=analyse.ReplyStore(f"file://{tmp_path}/store"))
    store = engine.replies
    client = analyse.Client("http://m", "m", transport=counted(tmp_path))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(E, "Client", lambda *a: client)
        for _ in range(2):
            plan = engine.plan(documents.scan_files(spark, f"{tmp_path}/in"))
            kinds = [r["error_kind"] for r in plan.collect()]
    assert len((tmp_path / "calls").read_text().split()) == 3 and len(kinds) == 5 and store.gathered(spark) is None


def test_schema_lists_every_key_once():
    schema = analyse.response_schema(["a", "b"])["schema"]
    assert schema["required"] == sorted(schema["properties"]) and len(schema["required"]) == 11 and schema["additionalProperties"] is False
    assert "folder" not in json.dumps(schema)


# ---------------------------------------------------------------- commands


def test_arguments_stay_single(spark):
    own = [rules.Template.parse(t, rules.ARGUMENT_FIELDS, "a") for t in ("put", "--title={{.Title}}", "{{.DocumentDate}}", "{{.Path}}")]
    each = [rules.Template.parse(t, ("",), "a") for t in ("--tag", "{{.}}")]
    from folioflow.plans.schema import METADATA

    m = F.from_json(F.lit(json.dumps({"title": "x; rm -rf $(y) `z`", "tags": ["a b", "c"]})), METADATA)
    argv = handoff.arguments(own, each, F.lit("/p"), m)
    assert spark.range(1).select(argv).first()[0] == ["put", "--title=x; rm -rf $(y) `z`", "", "/p", "--tag", "a b", "--tag", "c"]


def test_command_outcomes(tmp_path, monkeypatch):
    tool(tmp_path, "good", 'echo "$1" "$SECRET"\n')
    tool(tmp_path, "bad", "echo out; echo err >&2; exit 7\n")
    tool(tmp_path, "slow", "sleep 30 & sleep 30\n")
    tool(tmp_path, "loud", "head -c 20000 /dev/zero | tr '\\0' x\n")
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    monkeypatch.setenv("SECRET", "s")
    got = handoff.Command("good", env=("SECRET",)).run(["a b"])
    assert (got["success"], got["exit_code"], got["output"], got["error"]) == (True, 0, "a b s\n", None)
    got = handoff.Command("bad").run([])
    assert (got["success"], got["exit_code"], got["error"]) == (False, 7, "bad exited 7") and "out" in got["output"] and "err" in got["output"]
    got = handoff.Command("slow", timeout=0.3).run([])
    assert got["exit_code"] is None and "did not finish" in got["error"]
    got = handoff.Command("loud").run([])
    assert got["output"].startswith("x" * 8192) and got["output"].endswith("(truncated at 8 KiB)")
    got = handoff.Command("absent-command").run([])
    assert got["attempted"] and "not installed" in got["error"]


# ---------------------------------------------------------------- filing and traces


def _source(folder, name, body):
    path = folder / name
    path.write_bytes(body)
    return path, len(body), hashlib.sha256(body).hexdigest()


def test_placing(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    a = filing.Archive(root)
    path, size, digest = _source(tmp_path, "in.txt", b"body")
    assert a.place(path, size, digest, "x/y.txt") == "filed" and path.exists()
    assert a.place(path, size, digest, "x/y.txt", remove=True) == "duplicate" and not path.exists()
    other, n, d = _source(tmp_path, "o.txt", b"boda")
    with pytest.raises(filing.FilingError):
        a.place(other, n, d, "x/y.txt")
    with pytest.raises(filing.FilingError):
        a.place(other, n, "0" * 64, "x/z.txt")
    inside = root / "x/y.txt"
    assert a.place(inside, 4, digest, "x/y.txt", remove=True) == "duplicate" and inside.exists()
    assert [p.name for p in root.rglob("*") if p.is_file()] == ["y.txt"]
    (root / "x/empty").touch()
    (root / "x/folder").mkdir()
    (root / "x/link").symlink_to(other)
    for taken in ("x/empty", "x/folder", "x/link", "x/y.txt/z"):
        with pytest.raises((filing.FilingError, OSError)):
            a.place(other, n, d, taken)
    assert a.content("x/y.txt") == (4, digest) and a.content("x/link") is a.content("x/folder") is a.content("q/r") is None
    assert sorted(a.names_in("x")) == ["x/empty", "x/folder", "x/link", "x/y.txt"] and a.names_in("q") == []
    a.write_atomic("x/y.txt", b"new")
    assert a.read("x/y.txt") == b"new" and a.read("x/none") is None


def test_a_folder_that_becomes_a_link_is_not_followed(tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    (root / "x").mkdir(parents=True)
    outside.mkdir()
    path, size, digest = _source(tmp_path, "in.txt", b"body")
    a = filing.Archive(root)
    with a._inside(["x"]) as folder:  # the folder that was opened is the one written to
        (root / "x").rename(tmp_path / "moved")
        (root / "x").symlink_to(outside)
        with a._new_file() as (staging, part, out):
            out.write(b"body")
            os.link(part, "y.txt", src_dir_fd=staging, dst_dir_fd=folder)
    with pytest.raises(filing.FilingError):
        a.place(path, size, digest, "x/y.txt")
    assert list(outside.iterdir()) == [] and (tmp_path / "moved/y.txt").read_bytes() == b"body"


def test_names_held_are_those_that_may_be_tried(spark, tmp_path):
    for name, body in {"a/x.txt": "1", "a/x-2.txt": "22", "a/x-1001.txt": "3", "a/x-02.txt": "4", "a/z.txt": "5", "b/x.txt": "6", "x.txt": "7"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "a/x-3.txt").mkdir()
    dests = spark.createDataFrame([("a/x.txt",), ("a/x.txt",), ("x.txt",), ("c/new.txt",), (None,)], "dest string")
    got = {r["path"]: (r["size"], r["digest"]) for r in filing.names_held(dests, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {"a/x.txt": (1, sha(b"1")), "a/x-2.txt": (2, sha(b"22")), "a/x-3.txt": (-1, ""), "x.txt": (1, sha(b"7"))}


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "a//b", "", "a\\b", ".", "link/x"])
def test_nothing_leaves_the_archive(tmp_path, name):
    root = tmp_path / "root"
    root.mkdir()
    (root / "link").symlink_to(tmp_path)
    path, size, digest = _source(tmp_path, "in.txt", b"body")
    with pytest.raises(filing.FilingError):
        filing.Archive(root).place(path, size, digest, name)
    with pytest.raises((filing.FilingError, OSError)):
        filing.Archive(tmp_path / "absent")


@pytest.mark.parametrize("change,reason", [(None, None), (lambda t: t[:30], "does not parse"), (lambda t: "no json", "does not parse"), (lambda t: t.replace('"version":1', '"version":99'), "another schema version"), (lambda t: t.replace('"rule":', '"x":1,"rule":'), "does not parse: unknown key"), (lambda t: t.replace("aaaa", "bbbb"), "records another digest"), (lambda t: t.replace("2023-", "x"), "unreadable filed_at"), (lambda t: t + "{}", "does not parse")])
def test_traces(spark, change, reason):
    from folioflow.plans.schema import METADATA

    m = F.from_json(F.lit('{"title":"A & <B>","type":"t","tags":["x"],"document_date":"2031-11-05","amount":"7.25","currency":"EUR"}'), METADATA)
    body = spark.range(1).select(inventory.trace_json(F.lit("/in/a"), F.lit("aaaa"), m, F.lit("r"), F.timestamp_seconds(F.lit(1_700_000_000)), F.lit(None).cast("struct<pages_processed:int,pages_total:int>"), handoff.not_attempted())).first()[0]
    wire = json.loads(body)
    assert wire["metadata"] == {"title": "A & <B>", "type": "t", "correspondent": None, "tags": ["x"], "document_date": "2031-11-05", "due_date": None, "reference": None, "description": None, "amount": "7.25", "currency": "EUR"}
    assert wire["truncation"] is None and wire["archive"]["attempted_at"] is None and "&" in body
    got = inventory.read_traces(spark.createDataFrame([("aaaa", change(body) if change else body)], "digest string, trace string")).first()
    assert got["unusable"] == reason and (got["record"] is None) == (reason is not None)
    if reason is None:
        assert got["record"]["metadata"]["amount"] == "7.25" and got["record"]["filed_at"].year == 2023


# ---------------------------------------------------------------- whole runs


def fixed_replies(rows):
    """Documents say their type in their first word."""
    word = F.lower(F.regexp_extract(c("text")["content"], r"\A(\w+)", 1))
    body = F.to_json(F.struct(F.lit("T").alias("title"), word.alias("type"), F.array(F.lit("Lathe"), F.lit("mill")).alias("tags"), F.lit("2031-11-05").alias("document_date"), word.alias("filename")))
    nothing = F.lit(None).cast("string")
    return rows.withColumns({"reply": F.when(c("text")["error_kind"].isNull(), body), "reply_error_kind": nothing, "reply_error_msg": nothing})


def _setup(tmp_path, command=""):
    (tmp_path / "in").mkdir()
    (tmp_path / "root").mkdir()
    for name, body in {"a.txt": "manual one", "b.txt": "manual one", "c.txt": "manual two", "d.txt": "zzz", "e.bin": "\0"}.items():
        (tmp_path / "in" / name).write_text(body)
    text = f"archive_root: {tmp_path}/root\ntypes: {{values: [manual, note], fallback: note}}\nrules: [{{name: manuals, type: manual, path: 'shelf/{{{{.Month}}}}'}}]\ndisposition: copy\n"
    if command:
        text += f"archive: {{command: {command}, args: ['{{{{.Path}}}}']}}\n"
    (tmp_path / "c.yaml").write_text(text)
    return str(tmp_path / "c.yaml")


def _main(tmp_path, *args):
    out, err = io.StringIO(), io.StringIO()

    def engine(spark, config):
        return E.Engine(spark, config, fixed_replies, scratch=str(tmp_path / "scratch"))

    code = E.main([f"{tmp_path}/in", "--config", f"{tmp_path}/c.yaml", *args], engine, out, err)
    return code, out.getvalue(), err.getvalue()


def test_dry_run_writes_nothing(spark, tmp_path):
    _setup(tmp_path)
    code, out, err = _main(tmp_path, "--dry-run", "--output", "json")
    told = {Path(json.loads(x)["source"]["path"]).name: json.loads(x) for x in out.splitlines()}
    assert code == 2 and set(told) == {"a.txt", "b.txt", "c.txt"} and "rejected" in err and "unsupported" in err
    assert told["a.txt"]["action"] == "planned" and told["a.txt"]["destination"] == "shelf/11/2031-11-05-manual.txt" and told["a.txt"]["archive"] is None
    assert list((tmp_path / "root").rglob("*")) == []


def test_dry_run_in_text(spark, tmp_path):
    _setup(tmp_path)
    code, out, err = _main(tmp_path, "--dry-run")
    lines = out.split("\n")
    row = next(x for x in lines if x.startswith("c.txt"))
    assert code == 2 and row.index("shelf/11") == lines[0].index("DEST") and row.index("manual  ") == lines[0].index("TYPE") and row.endswith("lathe, mill")
    detail = dict(x.split("  ", 1) for x in out[out.index("c.txt") :].split("\n\n")[1].split("\n") if x)
    assert {k.strip(): v.strip() for k, v in detail.items()} == {"rule": "manuals", "rule path": "shelf/{{.Month}}", "disposition": "copy", "text origin": "plain", "title": "T", "document date": "2031-11-05"}
    assert list((tmp_path / "root").rglob("*")) == [] and "archive" not in out


def test_what_commands_say(spark, tmp_path):
    tool(tmp_path, "speak", 'case "$1" in *-2.txt) echo "no room"; echo "at all" >&2; exit 7;; *) echo "taken as 4711";; esac\n')
    _setup(tmp_path, f"{tmp_path}/speak")
    code, out, err = _main(tmp_path, "--quiet")
    assert code == 2 and err.count("speak| no room\nspeak| at all\n") == 1 and "4711" not in err + out
    assert out.count("\narchived\n") == 2 and out.count("\narchiver failed (exit 7)\n") == 1
    for path in (tmp_path / "root").rglob("*.*"):
        path.unlink()
    code, out, err = _main(tmp_path)
    assert err.count("speak| taken as 4711\n") == 2 and err.count("speak| no room\n") == 1 and "4711" not in out


def test_a_line_is_heard_before_its_command_ends(spark, tmp_path):
    tool(tmp_path, "speak", f'echo "begun $1"; printf "and\\rno end of line"; for k in 1 2 3 4 5 6 7 8 9; do test -f {tmp_path}/heard && exit 0; sleep 1; done; exit 9\n')
    _setup(tmp_path, f"{tmp_path}/speak")

    class Ear(io.StringIO):
        def write(self, said):
            if "begun" in said:
                (tmp_path / "heard").touch()
            return super().write(said)

    def engine(session, config):
        return E.Engine(session, config, fixed_replies, scratch=str(tmp_path / "scratch"))

    ear = Ear()
    assert E.main([f"{tmp_path}/in/a.txt", "--config", f"{tmp_path}/c.yaml"], engine, io.StringIO(), ear) == 0
    assert ear.getvalue().count("speak| begun ") == 1 and "speak| and\rno end of line\n" in ear.getvalue()


def test_lines_of_strangers_are_not_heard():
    heard = []
    here = channel.Channel("localhost", heard.append)
    channel.tell(here.address._replace(token="wrong"), b"spoof")
    channel.tell(here.address, b"one")
    channel.tell(here.address, b"x" * (channel.MOST + 10))
    _until(lambda: sum(map(len, heard)) == channel.MOST + 13, 10)
    assert heard[0] == "one" and len(heard) == 3
    here.close()
    channel.tell(here.address._replace(port=1), b"nobody listens")


def test_missing_and_empty_documents_have_their_outcome(spark, tmp_path):
    _setup(tmp_path)
    (tmp_path / "in" / "z é.txt").touch()
    out, err = io.StringIO(), io.StringIO()
    engine = lambda s, config: E.Engine(s, config, fixed_replies, scratch=str(tmp_path / "scratch"))
    code = E.main([f"{tmp_path}/in/a.txt", f"{tmp_path}/nowhere.txt", f"{tmp_path}/in/z*.txt", f"{tmp_path}/no/*", "--config", f"{tmp_path}/c.yaml", "--dry-run"], engine, out, err)
    assert code == 2 and re.search(r"\na\.txt +shelf/11", out.getvalue())
    said = err.getvalue()
    assert "nowhere.txt: source: no such document" in said and "no/*: source: no such document" in said and "z é.txt: source: empty" in said
    assert documents.scan_files(spark, f"{tmp_path}/nowhere").select("size", "mime").collect() == [(None, None)]


def counting(folder: Path):
    """A vision call that leaves a file each time."""

    def see(media, data):
        (folder / os.urandom(8).hex()).touch()
        return f"manual of {len(data)} bytes"

    return see


@pytest.mark.parametrize("body", [b"\x89PNG\r\n\x1a\nxx", b"%PDF-1.7 \f"], ids=["image", "scan"])
@pytest.mark.parametrize("args", [["--dry-run"], ["--dry-run", "--output", "json"], [], ["--no-analysis"]], ids=["text", "json", "filed", "text only"])
def test_one_call_for_a_document(spark, tmp_path, monkeypatch, body, args):
    tool(tmp_path, "pdftotext", 'cat "$2" | tail -c +9\n')
    tool(tmp_path, "pdftoppm", 'for last; do :; done; printf img > "$last-1.png"\n')
    monkeypatch.setitem(spark.sparkContext.environment, "PATH", f"{tmp_path}:{os.environ['PATH']}")
    _setup(tmp_path)
    calls, asked = tmp_path / "calls", tmp_path / "asked"
    calls.mkdir()
    asked.mkdir()
    (tmp_path / "in" / "p").write_bytes(body)

    def transport(url, headers, body, timeout):
        (asked / os.urandom(8).hex()).touch()
        return 200, json.dumps({"choices": [{"message": {"content": json.dumps({"title": "T", "type": "manual", "tags": [], "document_date": "2031-11-05", "filename": "f"})}}]}).encode()

    monkeypatch.setattr(E, "Client", lambda *a: analyse.Client("http://x", "m", transport=transport))
    engine = lambda s, config: E.Engine(s, config, tools=extract.Tools(vision=counting(calls)), scratch=str(tmp_path / "scratch"))
    code = E.main([f"{tmp_path}/in/p", "--config", f"{tmp_path}/c.yaml", *args], engine, io.StringIO(), err := io.StringIO())
    assert code == 0, err.getvalue()
    assert len(list(calls.iterdir())) == 1 and len(list(asked.iterdir())) == (0 if args == ["--no-analysis"] else 1)
    assert not list((tmp_path / "scratch").rglob("*.parquet"))


def test_pages_of_scans_fan_out(spark, tmp_path, monkeypatch):
    """Pages are dealt over tasks, gathered in order, and after a failing page only that is asked for again."""
    tool(tmp_path, "pdftotext", 'cat "$2" | tail -c +9\n')
    tool(tmp_path, "pdftoppm", 'for x; do :; done; printf "%s %s" "$(tail -c +9 "$8" | head -c 2)" "$5" > "$x-1.png"\n')
    monkeypatch.setitem(spark.sparkContext.environment, "PATH", f"{tmp_path}:{os.environ['PATH']}")
    (tmp_path / "in").mkdir()
    calls = tmp_path / "calls"
    calls.mkdir()
    for k in range(6):
        (tmp_path / "in" / f"d{k}.pdf").write_bytes(b"%PDF-1.7" + b"\f".join(f"d{k}".encode() if p == 0 else b"" for p in range(12 if k == 0 else 2)) + b"\fend")
    (tmp_path / "in" / "p.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "in" / "t.txt").write_text("plain")
    folder = str(calls)

    def see(media, data):
        from pyspark import TaskContext

        with open(f"{folder}/{hashlib.sha256(data).hexdigest()[:8]}-{os.urandom(4).hex()}-{TaskContext.get().partitionId()}", "w") as f:
            f.write(data.decode("latin-1"))
        if data == b"d3 2" and not os.path.exists(f"{folder}/../healed"):
            raise OSError("no answer")
        return " " + data.decode("latin-1") + " "

    store = analyse.ReplyStore(f"file://{tmp_path}/store")
    names = iter(range(100))

    def keep(df, name):
        path = f"{tmp_path}/kept/{name}-{next(names)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    from folioflow.operators.pages import with_paged_text

    ask = lambda: {Path(r["path"]).name: r["text"] for r in with_paged_text(documents.scan_files(spark, f"{tmp_path}/in"), extract.Tools(max_pages=10, vision=see), keep, store).collect()}
    got = ask()
    assert got["d0.pdf"]["content"] == "\n\n".join(f"d0 {p}" for p in range(1, 11)) and tuple(got["d0.pdf"]["truncation"]) == (10, 13)
    assert got["d1.pdf"]["content"] == "d1 1\n\nd1 2\n\nd1 3" and got["d1.pdf"]["truncation"] is None and got["d1.pdf"]["origin"] == "vision"
    assert (got["d3.pdf"]["error_kind"], got["d3.pdf"]["error_msg"], got["d3.pdf"]["content"]) == ("transport", "no answer", None)
    assert got["t.txt"]["content"] == "plain" and got["p.png"]["content"].endswith("xx")
    made = list(calls.iterdir())
    of_first = {p.name.rsplit("-", 1)[1] for p in made if p.read_text().startswith("d0 ")}
    assert len(made) == 10 + 5 * 3 + 1 and len(of_first) >= min(3, spark.sparkContext.defaultParallelism)
    (tmp_path / "healed").touch()
    assert ask()["d3.pdf"]["content"] == "d3 1\n\nd3 2\n\nd3 3"
    assert len(list(calls.iterdir())) == len(made) + 1


def test_one_conversion_for_an_old_document(spark, tmp_path, monkeypatch):
    tool(tmp_path, "libreoffice", f'echo x >> {tmp_path}/runs; for last; do :; done; echo "manual text" > "$(dirname "$last")/in.txt"\n')
    monkeypatch.setitem(spark.sparkContext.environment, "PATH", f"{tmp_path}:{os.environ['PATH']}")
    config = C.load(_setup(tmp_path), {}).validate()
    (tmp_path / "in" / "old").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 20)
    engine = E.Engine(spark, config, fixed_replies)
    plan = engine.plan(documents.scan_files(spark, f"{tmp_path}/in/old"))
    assert plan.where("error_kind IS NULL AND text.origin = 'office'").select("dest").collect() == [("shelf/11/2031-11-05-manual",)]
    assert (tmp_path / "runs").read_text() == "x\n"


def test_texts_only(spark, tmp_path):
    _setup(tmp_path)
    code, out, _ = _main(tmp_path, "--no-analysis")
    assert code == 2 and sorted(out.split("\n")) == ["", "manual one", "manual one", "manual two", "zzz"]


def test_file_then_replay(spark, tmp_path):
    tool(tmp_path, "upload", f'test -f {tmp_path}/up && echo "$1" >> {tmp_path}/sent\n')
    _setup(tmp_path, f"{tmp_path}/upload")
    code, out, err = _main(tmp_path)
    root = tmp_path / "root"
    names = sorted(p.relative_to(root).as_posix() for p in root.rglob("*.txt"))
    assert code == 2 and names == ["shelf/11/2031-11-05-manual-2.txt", "shelf/11/2031-11-05-manual.txt"]
    assert err.count("upload exited 1") == 3 and out.split("\n")[0].split() == ["SOURCE", "DEST", "TYPE", "TAGS"]
    assert out.count("archiver failed (exit 1)") == 3
    traces = list(root.rglob("*" + inventory.SUFFIX))
    assert len(traces) == 2 and not json.loads(traces[0].read_text())["archive"]["success"]
    (tmp_path / "up").touch()
    out, err = io.StringIO(), io.StringIO()

    def never(rows):
        raise AssertionError("asked again")

    many = [f"old/{k}.txt{inventory.SUFFIX}" for k in range(3)]
    for name in many:  # traces that the run has no business with
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text("not read")
        os.chmod(root / name, 0)
    for _ in range(2):  # the second time there is nothing left
        engine = lambda s, config: E.Engine(s, config, lambda rows: fixed_replies(rows) if rows.limit(1).count() == 0 else never(rows), scratch=str(tmp_path / "scratch2"))
        assert E.main([f"{root}/shelf/11/*.txt", "--config", f"{tmp_path}/c.yaml"], engine, out, err) == 0
    assert sorted((tmp_path / "sent").read_text().split()) == [f"{root}/{n}" for n in names]
    assert json.loads(traces[0].read_text())["archive"]["success"]


def test_a_trace_that_cannot_be_written_is_an_error(spark, tmp_path):
    tool(tmp_path, "upload", "exit 1\n")
    _setup(tmp_path, f"{tmp_path}/upload")
    taken = tmp_path / "root/shelf/11" / f"2031-11-05-manual.txt{inventory.SUFFIX}"
    taken.mkdir(parents=True)
    (taken / "x").touch()
    code, out, err = _main(tmp_path)
    lines = [line for line in err.split("\n") if ": trace: " in line]
    assert code == 2 and len(lines) == 2 and all(("a.txt" in line) or ("b.txt" in line) for line in lines)
    assert err.count(": archive: ") == 1 and (tmp_path / "root/shelf/11/2031-11-05-manual.txt").exists()
    taken.rename(tmp_path / "away")
    code, out, err = _main(tmp_path)  # nothing was known of it, so all is done again
    assert ": trace: " not in err and taken.is_file()


def test_sink_tells_what_became_of_each_row(spark, tmp_path):
    root, outcome = tmp_path / "root", f"file://{tmp_path}/outcome"
    root.mkdir()
    (root / "t" / f"a.txt{inventory.SUFFIX}").mkdir(parents=True)
    body = lambda k: f"body {k}".encode()
    rows = [(f"p{k}", len(body(k)), hashlib.sha256(body(k)).hexdigest(), body(k), f"d/{k}.txt", f"{{{k}}}") for k in range(20)]
    rows += [("bad", 3, "0" * 64, b"abc", "d/bad.txt", "{}"), ("out", 3, hashlib.sha256(b"abc").hexdigest(), b"abc", "../x", "{}"), ("t", 3, hashlib.sha256(b"abc").hexdigest(), b"abc", "t/a.txt", "{}"), ("none", 1, "x", b"x", None, "{}")]
    df = spark.createDataFrame(rows, "path string, size long, digest string, content binary, final_dest string, trace string").repartition(3)
    got = {r["path"]: r for r in sink.write_archive(df, str(root), outcome).collect()}
    assert len(got) == 23 and all(got[f"p{k}"]["filed"] and got[f"p{k}"]["trace_error"] is None for k in range(20))
    assert "changed" in got["bad"]["filing_error"] and "does not stay" in got["out"]["filing_error"] and got["t"]["filed"] and got["t"]["trace_error"]
    assert {p.read_text() for p in root.glob(f"d/*{inventory.SUFFIX}")} == {f"{{{k}}}" for k in range(20)}
    listed = json.loads((tmp_path / "outcome/_committed.json").read_text())
    assert listed["rows"] == 23 and listed["failed"] == 3
    # what an attempt leaves that wasn't committed counts for nothing
    part = tmp_path / "outcome" / listed["parts"][0]
    (tmp_path / "outcome/part-stray.parquet").write_bytes(part.read_bytes())
    assert sink.committed(spark, outcome).count() == 23
    again = sink.write_archive(df, str(root), f"{outcome}2").where("filing_error IS NULL").select("filed").distinct().collect()
    assert [r["filed"] for r in again] == [False]


def test_sink_aborts_without_a_result(spark, tmp_path):
    (tmp_path / "root").mkdir()
    batch = pa.RecordBatch.from_pylist([{"path": "p", "size": 1, "digest": hashlib.sha256(b"x").hexdigest(), "content": b"x", "final_dest": "a"}])
    writer = sink.ArchiveWriter(str(tmp_path / "root"), f"file://{tmp_path}/outcome", False)
    done = writer.write(iter([batch]))
    assert (done.rows, done.failed) == (1, 0) and (tmp_path / "outcome" / done.part).exists()
    writer.abort([done, None])
    assert list((tmp_path / "outcome").iterdir()) == []
    with pytest.raises(FileNotFoundError):
        sink.committed(spark, f"file://{tmp_path}/outcome")
    gone = spark.createDataFrame([("p", "a")], "path string, final_dest string")
    with pytest.raises(Exception, match="not found|No such file|does not exist"):
        sink.write_archive(gone, str(tmp_path / "nowhere"), f"file://{tmp_path}/outcome")
    assert not (tmp_path / "outcome/_committed.json").exists()


def _alive(mark: str) -> list[int]:
    """Processes whose command line has ``mark``."""
    found = []
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            line = Path(f"/proc/{pid}/cmdline").read_bytes()
        except OSError:
            continue
        if mark.encode() in line and int(pid) != os.getpid():
            found.append(int(pid))
    return found


def _until(condition, seconds=60):
    end = time.monotonic() + seconds
    while not condition():
        assert time.monotonic() < end
        time.sleep(0.1)


def test_a_cancelled_run_leaves_no_child_and_no_half_file(spark, tmp_path):
    mark = f"31{os.getpid()}"  # seconds that nothing else sleeps
    tool(tmp_path, "upload", f"touch {tmp_path}/begun\nsleep {mark} &\nsleep {mark}\n")
    _setup(tmp_path, f"{tmp_path}/upload")
    engines, ended = [], []

    def engine(session, config):
        engines.append(E.Engine(session, config, fixed_replies, scratch=str(tmp_path / "scratch")))
        return engines[0]

    out, err = io.StringIO(), io.StringIO()
    thread = threading.Thread(target=lambda: ended.append(E.main([f"{tmp_path}/in", "--config", f"{tmp_path}/c.yaml"], engine, out, err)))
    thread.start()
    _until((tmp_path / "begun").exists, 120)
    assert _alive(mark)
    engines[0].cancel()
    thread.join(60)
    assert ended == [1] and "interrupted" in err.getvalue()
    _until(lambda: not _alive(mark))
    left = [p.relative_to(tmp_path / "root").as_posix() for p in (tmp_path / "root").rglob("*")]
    assert not [x for x in left if "/." in f"/{x}"] and sum(x.endswith(".txt") for x in left) == 2
    assert not any((tmp_path / "scratch").rglob("folioflow-run-*"))


def test_a_command_ends_with_its_worker(tmp_path):
    """Also where the worker is killed and can do nothing about it."""
    mark = f"32{os.getpid()}"
    code = f"from folioflow.operators.handoff import Command\nCommand({str(tool(tmp_path, 'slow', f'sleep {mark} & sleep {mark}'))!r}).run([])"
    worker = subprocess.Popen([sys.executable, "-c", code], cwd=Path(__file__).parent.parent)
    _until(lambda: len(_alive(mark)) >= 2)
    worker.kill()
    worker.wait()
    _until(lambda: not _alive(mark), 10)
    late = handoff.Command(str(tool(tmp_path, "late", f"sleep {mark} & sleep {mark}")), timeout=0.5).run([])
    assert "killed" in late["error"] and not _alive(mark)


def test_nothing_half_written_is_left_behind(tmp_path):
    path, size, digest = _source(tmp_path, "in.txt", b"body")
    root = tmp_path / "root"
    root.mkdir()
    a = filing.Archive(root, ".mine")
    a.place(path, size, digest, "x/y.txt")
    (root / ".mine" / "half").write_text("bo")  # as a killed task leaves it
    a.cleared()
    a.cleared()
    assert [p.relative_to(root).as_posix() for p in sorted(root.rglob("*"))] == ["x", "x/y.txt"]


def test_inventory_log(spark, tmp_path):
    log = InventoryLog(spark, f"file://{tmp_path}/log")
    rows = lambda *r: spark.createDataFrame(r, "dest string, trace string, at int")
    assert log.current().count() == 0 and log.traced(rows(("a", "x", 1)).drop("trace"), "dest").first()["trace"] is None
    log.append(rows(("a", "1", 1), ("a", "2", 2), ("b", "3", 1), (None, "9", 1), ("c", "4", 1)), "at", "one")
    log.append(rows(("b", "5", 0), ("c", None, 0), ("d", "6", 0)), "at", "two")
    log.append(rows(("b", "7", 0)), "at", "two")
    want = {"a": "2", "b": "5", "d": "6"}
    for _ in range(2):
        assert dict(map(tuple, log.current().collect())) == want
        asked = spark.createDataFrame([("a",), ("c",), ("e",), (None,), ("b",), ("b",)], "inside string")
        assert sorted((r["inside"] or "", r["trace"]) for r in log.traced(asked, "inside").collect()) == [("", None), ("a", "2"), ("b", "5"), ("b", "5"), ("c", None), ("e", None)]
        log.compact()
        assert len(log.deltas()) == 1 and len(list((tmp_path / "log").glob("*/_SUCCESS"))) == 1
    log.append(rows(("a", "8", 0)), "at", "one")  # known, also after compaction
    assert dict(map(tuple, log.current().collect())) == want


def test_replay_from_the_log(spark, tmp_path):
    """Filed, then known by the log alone: nothing is asked or moved again."""
    tool(tmp_path, "upload", f'test -f {tmp_path}/up && echo "$1" >> {tmp_path}/sent\n')
    _setup(tmp_path, f"{tmp_path}/upload")
    log, root = InventoryLog(spark, f"file://{tmp_path}/log"), tmp_path / "root"

    def engine(session, config):
        return E.Engine(session, config, fixed_replies, scratch=str(tmp_path / "scratch"), inventory=log)

    assert E.main([f"{tmp_path}/in", "--config", f"{tmp_path}/c.yaml"], engine, io.StringIO(), io.StringIO()) == 2
    assert log.current().count() == 2
    for p in root.rglob(f"*{inventory.SUFFIX}"):
        p.unlink()
    (tmp_path / "up").touch()
    for _ in range(2):
        assert E.main([f"{root}/shelf/11/*.txt", "--config", f"{tmp_path}/c.yaml"], engine, io.StringIO(), io.StringIO()) == 0
    assert len((tmp_path / "sent").read_text().split()) == 2 and len(log.deltas()) >= 2


@pytest.mark.parametrize("args", [["--nope"], [], ["x", "--quiet", "--verbose"], ["x", "--output", "xml"], ["x", "--config", "/absent.yaml"], ["x", "--disposition", "burn"]])
def test_usage_errors(args):
    err = io.StringIO()
    assert E.main(args, None, io.StringIO(), err) == 2 and err.getvalue().startswith("folioflow: ")


def test_version():
    out = io.StringIO()
    assert E.main(["--version"], None, out) == 0 and out.getvalue() == E.VERSION_TEXT


def test_streaming_intake(spark, tmp_path):
    """Three batches equal one, and a batch reads what is new and no more."""
    config = C.load(_setup(tmp_path), {}).validate()
    engine = E.Engine(spark, config, fixed_replies)
    folder, base = tmp_path / "in", "shelf/11/2031-11-05-manual"
    waves = [{}, {"f.txt": "manual three", "g.txt": "manual two"}, {"h.txt": "manual one", "i.txt": "manual four", "j.txt": "zzz", "k.txt": "manual three"}]
    read = []
    for wave in waves:
        for name, body in wave.items():
            (folder / name).write_text(body)
        queries = intake.intake(intake.watched_files(spark, str(folder), "*.txt"), engine.plan, str(tmp_path / "out"), str(tmp_path / "marks"))
        assert all(q.exception() is None for q in queries)
        read.append(sum(p["numInputRows"] for p in queries[1].recentProgress))
    got = {Path(r["path"]).name: (r["final_dest"], r["duplicate"], r["error_kind"], r["batch"]) for r in intake.outcome(spark, str(tmp_path / "out")).collect()}
    assert read == [3, 2, 3] and len(got) == 10  # rows with a name to claim
    assert [got[f"{x}.txt"][:2] for x in "abcfghik"] == [(f"{base}{n}.txt", same) for n, same in [("", False), ("", True), ("-2", False), ("-3", False), ("-2", True), ("", True), ("-4", False), ("-3", True)]]
    assert got["d.txt"] == (None, False, "rejected", 0) and got["j.txt"] == (None, False, "rejected", 2)
    whole = intake.intake(intake.watched_files(spark, str(folder), "*.txt"), engine.plan, str(tmp_path / "out1"), str(tmp_path / "marks1"))
    assert all(q.exception() is None for q in whole)
    once = {Path(r["path"]).name: (r["final_dest"], r["duplicate"], r["error_kind"]) for r in intake.outcome(spark, str(tmp_path / "out1")).collect()}
    assert once == {k: v[:3] for k, v in got.items()}


@pytest.mark.parametrize("seed", range(3))
def test_claims_of_a_stream_equal_probing(seed):
    """Any cut of the rows into batches gives what probing one after another gives."""
    import random

    from test_rules_and_plan import brute_claims

    rng = random.Random(seed)
    names = ["f/x.t", "f/x-2.t", "f/x-3.t", "f/x-2-2.t", "f/x-2-3.t", "f/x-02.t", "f/x-1.t"]
    rows = [(k, rng.choice(names), *(lambda d: (0, "e") if d == 0 else (1 + d % 2, f"d{d}"))(rng.randrange(12))) for k in range(200)]
    taken, got = {}, {}
    for at in range(0, 200, 37):
        state = intake.Names(taken, 4)
        got |= {arrival: state.claim(dest, size, digest) for arrival, dest, size, digest in rows[at : at + 37]}
        assert set(state.new) <= set(taken)
    assert got == brute_claims(rows, (), 4)


# ---------------------------------------------------------------- listings


def test_files_are_listed_and_read_by_executors(spark, tmp_path):
    """No listing stays with the driver, and the rows are those that Spark's reader would give."""
    from folioflow.sources import listing

    root = tmp_path / "in"
    for name in ("a.txt", "b.md", "c.csv", "_no.txt", ".no.txt", "_k=v.txt", "x/d.txt", "x/y/e.txt", "x/_no/f.txt", "x/empty.txt", f"a.txt{inventory.SUFFIX}", f"x/d.txt{inventory.SUFFIX}", f"x/none{inventory.SUFFIX}"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if "empty" in name or "none" in name else name)
    (tmp_path / "more").mkdir()
    (tmp_path / "more/g.txt").write_text("linked")
    (root / "linked").symlink_to(tmp_path / "more")
    (root / "x/round").symlink_to(root)
    (root / "x/lost.txt").symlink_to(root / "nowhere")
    Path(os.fsdecode(os.fsencode(root) + b"/\xff.txt")).write_text("odd name")
    told = lambda rows: {r["path"].removeprefix(f"file:{root}/"): (r["size"], None if r["content"] is None else r["content"].decode()) for r in rows.collect()}
    rows = documents.scan_files(spark, str(root), str(root / "x"), str(root / "x/d.txt"), pattern="*.{txt,md}", recursive=True)
    own = {k: (len(k), k) for k in ("a.txt", "b.md", "_k=v.txt", "x/d.txt", "x/y/e.txt")}
    assert rows.inputFiles() == [] and rows.count() == 9
    assert told(rows) == own | {"x/empty.txt": (0, ""), "x/lost.txt": (None, None), "linked/g.txt": (6, "linked"), "�.txt": (8, "odd name")}
    assert {*told(documents.scan_files(spark, str(root), pattern="*.txt"))} == {"a.txt", "_k=v.txt", "�.txt"}
    traces = inventory.scan_traces(spark, str(root))
    assert traces.inputFiles() == [] and {tuple(r) for r in traces.collect()} == {("a.txt", f"a.txt{inventory.SUFFIX}"), ("x/d.txt", f"x/d.txt{inventory.SUFFIX}")}
    with pytest.MonkeyPatch.context() as m:  # in pieces
        m.setattr(listing, "PIECE", 7)
        assert told(listing.contents(listing.listed(spark, [str(root / "x")], None, True)))["x/y/e.txt"] == (9, "x/y/e.txt")
    listing.emptied(spark, f"file://{root}")
    left = [p for p in root.rglob("*") if not p.is_dir() or p.is_symlink()]
    assert left == [] and (root / "x/_no").is_dir() and (tmp_path / "more/g.txt").read_text() == "linked"


def test_prompts_are_asked_in_pieces_and_forgotten(spark):
    """A task takes few prompts of a batch at a time, and the endpoint keeps none that it has answered."""
    from folioflow import queries
    from folioflow.workers import pieces

    batch = pa.RecordBatch.from_pydict({"k": list(range(9)), "t": ["x" * n for n in (1, 2, 3, 50, 0, 4, 4, 4, 4)]})
    cut = list(pieces([batch, batch.slice(0, 0)], "t", rows=4, most=10))
    assert [x.num_rows for x in cut] == [3, 1, 3, 2, 0] and pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    client, kept = analyse.Client("http://stub/v1/", "m", "k", backoff=0.0), {}
    for n in range(40):
        body = json.dumps(analyse.request_body("m", "", "x" * n, schema=analyse.response_schema(["manual", "note"]))).encode()
        told = [queries._endpoint(f"{client.base_url}chat/completions", {"Authorization": "Bearer k"}, body, 1.0, kept)[0] for _ in range(2)]
        assert told == {0: [503, 503], 1: [400, 400], 2: [401, 401], 5: [429, 200]}.get(n % 8, [200, 200])
    assert kept == {}


def test_extraction_hands_on_texts_in_pieces(spark):
    """Texts of a batch don't wait for each other, and line feeds in XML aren't a part each."""
    lines = archive(("[Content_Types].xml", "<T/>"), ("word/document.xml", f"<w>{'x' + chr(10) * (3 << 20)}</w>"))
    udf = extract.extract_udf(extract.Tools())
    batch = (pa.array([WORD] * 4 + [None], pa.string()), pa.array([lines] * 4 + [None], pa.binary()))
    got = list(udf.func(iter([batch])))
    assert [len(x) for x in got] == [2, 2, 1] and len(got[0][0].as_py()["content"]) == (3 << 20) + 1 and got[2][0].as_py()["content"] is None
    data = extract._CharData()
    data.feed(b"<w>" + b"\n" * (1 << 20) + b"</w>", last=True)
    assert len(data.parts) < 100 and len(data.text()) == 1 << 20
