"""Packages of WARC records and files of token ids."""

import hashlib
import io
import random
import zipfile
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import huffman, token_store, warc
from folioflow.llm.files import opened, read_manifest
from folioflow.llm.zip_reader import BadZip, ZipRanges

PAGES = "page_id long, url string, html string"


def _pages():
    big, small = "<html>" + "x" * 200, "<p>"
    rows = [(k, f"http://a/{k}", f"<html>{cases.prose(k, 40)}") for k in range(20)]
    rows += [(30 + k, None if k % 2 else "http://b/ c\r\nX: y", big) for k in range(6)] + [(25, "u", big), (25, "u", big)]
    rows += [(40, "u", small), (41, "u", small), (42, "u", None), (43, "u", ""), (None, "u", big), (None, "v", "é" * 80), (50, "w", "日" * 70_000), (51, "w", "日" * 70_000)]
    return rows + [(60, "z", "a" * 99), (61, "z", "a" * 99), (62, "z", "b" * 100), (63, "z", "b" * 100), (64, "z", "\r\n\r\n" * 30)]


def brute_records(rows):
    groups = {}
    for p, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 100:
            groups.setdefault(body, []).append(p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        ids = [x for x in groups.get(body, []) if x is not None]
        first = min(ids) if ids and len(groups[body]) > 1 else p
        again = len(body) >= 100 and first != p
        out.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_records_read_back(spark, tmp_path):
    rows = _pages()
    manifest = warc.write_packages(cases.frame(spark, rows, PAGES), str(tmp_path / "w"))
    got = warc.read_packages(spark, manifest)
    assert cases.ordered(map(tuple, got.drop("url").collect())) == cases.ordered(brute_records(rows))
    assert all("\r" not in r["url"] and " " not in r["url"] for r in got.where("url IS NOT NULL").collect())
    fs, folder = opened(manifest.rpartition("/")[0])
    for p in read_manifest(manifest)["packages"]:
        with zipfile.ZipFile(f"{folder}/{p['name']}") as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert z.read(warc.INDEX).count(b"\n") == p["n"]


def test_damage_is_noticed(spark, tmp_path):
    rows = _pages()
    docs = cases.frame(spark, rows, PAGES).withColumns({c: F.lit(1) for c in ("digest", "first", "n", "refers_to")})
    manifest = warc.write_packages(docs, str(tmp_path / "w"))
    records = warc.read_packages(spark, manifest)
    assert warc.held_together(records).count() == len(rows)
    wrong = records.withColumn("payload_bytes", F.col("payload_bytes") + F.when(F.col("record_type") == "revisit", 1).otherwise(0))
    with pytest.raises(ValueError, match="no such response"):
        warc.held_together(wrong)
    folder = manifest.rpartition("/")[0].removeprefix("file:")
    name = read_manifest(manifest)["packages"][0]["name"]
    raw = bytearray(open(f"{folder}/{name}", "rb").read())
    for at in (raw.index(b"archive/data.warc.gz") + 40, raw.index(b'"page_id"')):
        bad = bytearray(raw)
        bad[at + 12] ^= 1
        with pytest.raises(Exception):  # noqa: B017 gzip, JSON or the directory's checksum
            list(warc.read_package(_Bytes(bytes(bad)), len(bad)))
    with pytest.raises(BadZip, match="damaged"):
        ZipRanges(_Bytes(bytes(raw)).read_at, len(raw)).check(warc.DATA, 1, 2)


def test_no_pages(spark, tmp_path):
    manifest = warc.write_packages(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_packages(spark, manifest).count() == 0


class _Bytes:
    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def read_at(self, n, at):
        self.read += n
        return self.raw[at : at + n]


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 not the end"
        z.writestr("a/é.txt", b"hello")
        z.writestr(zipfile.ZipInfo("b"), b"x" * 100_000, zipfile.ZIP_DEFLATED)
    f = _Bytes(out.getvalue())
    z = ZipRanges(f.read_at, len(f.raw))
    assert z.read("a/é.txt") == b"hello" and z.members["b"].size == 100_000 and f.read < 70_000
    with pytest.raises(BadZip):
        z.data_at("b")
    with pytest.raises(BadZip):
        ZipRanges(_Bytes(b"no zip here").read_at, 11)


def test_zip64_directories(monkeypatch):
    for name, value in (("ZIP64_LIMIT", 10), ("ZIP_FILECOUNT_LIMIT", 2)):
        monkeypatch.setattr(zipfile, name, value)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", allowZip64=True) as z:
        for k in range(5):
            z.writestr(f"m{k}", bytes([k]) * 50)
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw
    z = ZipRanges(_Bytes(raw).read_at, len(raw))
    assert [z.read(f"m{k}") for k in range(5)] == [bytes([k]) * 50 for k in range(5)]


# ---------------------------------------------------------------- token ids


def test_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 1000):
        counts = rng.zipf(1.2, n).clip(max=10**9)
        lengths = huffman.code_lengths(counts, 20)
        assert n == 1 or sum(2.0 ** -int(x) for x in lengths) == 1
        heap = counts.tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        free = int((counts * huffman.code_lengths(counts, 60 if n < 1000 else 40)).sum())
        assert n == 1 or free == cost
        assert int((counts * lengths).sum()) >= free
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = huffman.code_lengths(np.array([0, *fibonacci]), 8)
    assert lengths.max() == 8 and lengths[0] == 0 and sum(2.0 ** -int(x) for x in lengths[1:]) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(10), 3)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 20_001])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.15, n) % 5000).astype(np.uint16)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=2)))
    data, marks = code.encode(ids)
    assert len(marks) == -(-n // huffman.LANE)
    assert (code.decode(data, marks, n) == ids).all()
    bits = "".join(format(code.codes[i], f"0{code.lengths[i]}b") for i in ids[:2000])
    assert "".join(format(b, "08b") for b in data).startswith(bits)


def brute_tokens(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = [(r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    out, start = [], 0
    for d, x in ids:
        out.append((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    return out


HARD_TEXTS = ["Hello big", " a\n\n b\t", "", None, "the quick brown fox", "It'S 'S a''s don'T", "wow!!!? ok;: x!a", "abc<|endoftext|> <|ENDOFTEXT|>", "e\u0301 J\u030c j\u030c \u0301x A\u030angström", "ÀÉ× a÷b ﬁ K \x1cq \x85y\xa0z", "cd_ e-f g/h 12,5 a1.", "mask masked MASK, [mask]"]


@pytest.mark.parametrize("name,cuts", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_of_whole_texts_with_any_tokenizer(spark, tmp_path, name, cuts):
    pieces = token_store.piece_ids(name)
    assert pieces.cuts == pieces.has_stems == cuts
    rows = [*cases.hard_documents()[:30], *[(0, t, "", "", 1) for t in HARD_TEXTS]]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = {r["doc_id"]: np.frombuffer(r["ids"], f"<u{r['width']}").tolist() for r in token_store.tokenized(cases.frame(spark, rows), name).collect()}
    want = {r[0]: [*pieces.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    assert got == want
    manifest = token_store.write_tokens(cases.frame(spark, rows), str(tmp_path / "t"), tokenizer=name)
    back = token_store.read_tokens(spark, manifest).orderBy("start").collect()
    assert [(r["n_tokens"], r["doc_id"]) for r in back] == [(len(want[r[0]]), r[0]) for r in rows]


def _changed(change):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    change(spec)
    return json.dumps(spec)


def _added(content):
    return lambda spec: spec["added_tokens"].append({"id": 60_000, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})


@pytest.mark.parametrize(
    "change,cuts,stems",
    [
        (lambda spec: None, True, True),
        (lambda spec: spec["normalizer"]["normalizers"].pop(), True, False),
        (_added("mask"), True, False),
        (_added("x!"), True, False),
        (_added("<a b>"), False, False),
        (lambda spec: spec["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"), False, False),
        (lambda spec: spec["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True), False, False),
        (lambda spec: spec.update(normalizer={"type": "NFKC"}), False, False),
        (lambda spec: spec.update(truncation={"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}), False, False),
    ],
    ids=["as it is", "cased", "letters added", "letter and mark added", "space added", "isolated", "prefixed", "nfkc", "truncated"],
)
def test_shortcuts_follow_the_declaration(tmp_path, change, cuts, stems):
    path = tmp_path / "t.json"
    path.write_text(_changed(change))
    pieces = token_store.PieceIds(str(path))
    assert (pieces.cuts, pieces.has_stems) == (cuts, stems)
    rng, parts = random.Random(7), [*(x for t in HARD_TEXTS if t for x in t.split(" ")), "x!", "<a b>", "Masks.", "naïve,", "1st"]
    texts = [*HARD_TEXTS, *(rng.choice(["", " ", "\n"]).join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(150))]
    want = [[*pieces.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert [np.frombuffer(x, pieces.kind).tolist() for x in pieces.of([t and t.encode() for t in texts], 1)] == want


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "_GENERATION", 50)
    pieces = token_store.PieceIds(token_store.tokenizer_path("word_bpe_49k.json"))
    texts = [cases.prose(k, 30).encode() for k in range(40)]
    want = [[*pieces.tokenizer.encode(t.decode(), add_special_tokens=False).ids, 1] for t in texts]
    assert [np.frombuffer(x, pieces.kind).tolist() for x in pieces.of(texts, 1)] == want
    assert len(pieces.pieces) <= 80 and len(pieces.pieces.old) <= 80 and not getattr(pieces.pieces.old, "old", None)


@pytest.mark.parametrize("files", [1, 5])
def test_token_files_read_back(spark, tmp_path, files, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 1000)
    rows = cases.hard_documents() + [(700 + k, t, "", "", 1) for k, t in enumerate(["It'S 'S a''s", "wow!!!? ok;: x!a", " lead", "trail \n", "abc<|endoftext|> <|ENDOFTEXT|>", "ÀÉ× a÷b Ångström ﬁ K \x1cq", "cd_ e-f g/h 12,5 a1."])]
    docs = cases.frame(spark, rows).withColumns({c: F.lit("own") for c in ("ids", "width", "id", "n", "n_tokens", "start")})
    manifest = token_store.write_tokens(docs, str(tmp_path / "t"), files=files)
    got = token_store.read_tokens(spark, manifest).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute_tokens(rows)
    assert read_manifest(manifest)["n_tokens"] == sum(r["n_tokens"] for r in got)


def test_one_block_is_read_by_its_range(spark, tmp_path):
    rows = [(k, cases.prose(k, 3000), "en", "s", 1) for k in range(40)]
    manifest = token_store.write_tokens(cases.frame(spark, rows), str(tmp_path / "t"), files=1)
    fs, folder = opened(manifest.rpartition("/")[0])
    entry = read_manifest(manifest)["files"][0]
    raw = open(f"{folder}/{entry['name']}", "rb").read()
    f = _Bytes(raw)
    reader = token_store.Reader(f, len(raw))
    before = f.read
    ids = np.concatenate([reader.block(k) for k in range(len(reader.blocks))])
    whole = f.read - before
    before = f.read
    assert (reader.block(2) == ids[2 * token_store.BLOCK : 3 * token_store.BLOCK]).all() and f.read - before < whole / 2


def test_rewritten_files_are_equal(spark, tmp_path):
    rows = cases.hard_documents()
    made = []
    for k in range(2):
        manifest = token_store.write_tokens(cases.frame(spark, random.Random(k).sample(rows, len(rows)), parts=2 + k), str(tmp_path / f"t{k}"), files=2)
        fs, folder = opened(manifest.rpartition("/")[0])
        made.append([(x["n_tokens"], hashlib.sha256(open(f"{folder}/{x['name']}", "rb").read()).hexdigest()) for x in read_manifest(manifest)["files"]])
    assert made[0] == made[1]


def test_temporary_tables_go(spark):
    from pathlib import Path

    from folioflow.llm.common import bucketed, scratch_root, store, temporary

    root = Path(scratch_root(spark).removeprefix("file://"))
    before, outer = set(root.iterdir()) if root.exists() else set(), store(spark.range(3), "outer")
    with pytest.raises(KeyError), temporary(spark):
        assert store(spark.range(5), "inner").count() == bucketed(spark.range(5), "inner", "id").count() == 5
        with temporary(spark):
            store(spark.range(2), "inner")
        raise KeyError
    assert outer.count() == 3 and len(set(root.iterdir()) - before) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("inner")]


def test_scratch_of_a_cluster_must_be_named(spark, monkeypatch):
    from folioflow.llm import common

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())


def test_no_documents(spark, tmp_path):
    manifest = token_store.write_tokens(spark.createDataFrame([], cases.DOCS), str(tmp_path / "t"))
    assert token_store.read_tokens(spark, manifest).count() == 0
