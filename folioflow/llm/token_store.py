"""Token ids in Huffman-coded files.

1. Each text is cut at ASCII white space, and each different piece is encoded once by the
   tokenizers library and remembered for a while; an end id follows. That is done only with a
   tokenizer whose declared normaliser, pre-tokenizer and added tokens are known to give
   the same ids so; with any other, whole texts are encoded.
2. Global counts of ids, at most one row an id of the vocabulary, give a canonical Huffman
   code of limited length.
3. Rows are range-partitioned by doc_id and each range becomes one file: independent blocks
   of ids with a bit-offset checkpoint every 64 ids, then a footer with the blocks, the
   documents and the code's lengths. A manifest lists the files in order with the number of
   ids before each.
4. Reading starts at any file and block; a block is decoded by table in all its lanes at once.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows of
the same doc_id follow one another, ordered by their ids, so that reruns write the same
bytes; an empty table gives a manifest without files and an empty result; very long texts
are taken whole and span blocks; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, discard, map_rows, scratch_path, shuffle_parts, store, write_json
from .files import opened, qualified, read_manifest, replaced
from .huffman import LANE, Code, code_lengths

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1 << 16
MAGIC = b"FFTOKEN1"
#: Pieces, and stems of pieces, in one generation of a worker's memory; two are held.
_GENERATION, _STEMS, _TAILS = 3 << 18, 1 << 19, 1 << 12
#: ASCII marks but the apostrophe, with which some endings begin; and the letters of ASCII and
#: Latin-1 in UTF-8, which no normalisation changes and whose lower case is one letter.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LATIN_AND_TAIL = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*[" + re.escape(_TAIL) + rb"]*")
#: Fixed value: the pattern of words of a public tokenizer. No match has white space inside, and
#: none looks at what stands beside it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_tokenizers: dict[str, PieceIds] = {}


def _byte_letters() -> dict[int, int]:
    """The characters that byte-level models write bytes as: printable bytes of Latin-1 as
    themselves, the others as those from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


def _steps(spec: dict | None, key: str) -> list[dict]:
    return [] if spec is None else spec[key] if spec["type"] == "Sequence" else [spec]


def cuts_at_space(spec: dict) -> bool:
    """Whether a text has the ids of its pieces between ASCII white space, as the declaration of
    its tokenizer says: every step is one of those known to treat each piece alone. White
    space is a boundary of canonical composition, lower case goes by character, the word
    pattern drops white space, no added token has any, and the model sees one word at a time."""
    known = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    bytewise = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    words = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in _steps(spec["pre_tokenizer"], "pretokenizers")]
    return (
        all(x in known for x in _steps(spec["normalizer"], "normalizers"))
        and words == [split, bytewise]
        and spec["model"].get("type") == "BPE"
        and not spec["model"].get("dropout")
        and not spec.get("truncation")
        and not spec.get("padding")
        and not any(c in SPACE for token in spec["added_tokens"] for c in token["content"])
    )


def has_stems(spec: dict) -> bool:
    """Whether also a piece of Latin letters with ASCII marks behind has the ids of the letters
    in lower case, as its model gives them, and then those of the marks: texts are lower-cased,
    and no added token can begin in such a piece."""
    lowers = {"type": "Lowercase"} in _steps(spec["normalizer"], "normalizers")
    return cuts_at_space(spec) and lowers and not any(_LATIN_AND_TAIL.fullmatch(t["content"].encode()) for t in spec["added_tokens"])


class _Remembered(dict):
    """What ``learn`` gives, remembered. What an older generation knows moves to this one."""

    def __init__(self, learn, old: dict | None = None):
        super().__init__()
        self.learn, self.old = learn, old or {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        self[key] = value
        return value

    def aged(self, most: int) -> _Remembered:
        """This memory, or an empty one after it if it has more than ``most`` entries."""
        if len(self) <= most:
            return self
        self.old = {}
        return _Remembered(self.learn, self)


class PieceIds:
    """Texts, and white-space-free pieces of them, to their ids as little-endian bytes.

    A piece of Latin letters with ASCII marks behind is cut before them, as the tokenizer itself
    does, so its stem in lower case is shared by all its spellings; nothing of a stem is left
    to normalise or to split, so the library's model is asked for it directly. Everything else
    goes through the whole tokenizer. What is remembered is bounded, but for one text's pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        self.cuts, self.has_stems = cuts_at_space(spec), has_stems(spec)
        self.stems, self.tails = _Remembered(self._stem), _Remembered(self._whole)
        self.pieces = _Remembered(self._piece if self.has_stems else self._whole)

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _whole(self, text: bytes) -> bytes:
        return self._packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def _stem(self, stem: bytes) -> bytes:
        text = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(self.letters)
        return self._packed([token.id for token in self.model.tokenize(text)])

    def _piece(self, piece: bytes) -> bytes:
        bare = piece.rstrip(_TAIL)
        if bare.isalpha():
            value = self.stems[bare.lower()]
        elif _LATIN.fullmatch(bare):
            value = self.stems[bare.decode().lower().encode()]
        else:
            return self._whole(piece)
        return value + self.tails[piece[len(bare) :]] if len(bare) < len(piece) else value

    def of(self, texts: list[bytes | None], end_id: int) -> list[bytes]:
        """The ids of each text and the end id."""
        end, out = self._packed([end_id]), []
        for text in texts:
            if not text:
                out.append(end)
            elif self.cuts:
                out.append(b"".join(map(self.pieces.__getitem__, text.split())) + end)
                self.pieces = self.pieces.aged(_GENERATION)
            else:
                out.append(self._whole(text) + end)
        self.stems, self.tails = self.stems.aged(_STEMS), self.tails.aged(_TAILS)
        return out


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is, or the place of a public tokenizer on this machine."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def piece_ids(name_or_path: str) -> PieceIds:
    """This worker's tokenizer; loaded once."""
    if name_or_path not in _tokenizers:
        _tokenizers[name_or_path] = PieceIds(tokenizer_path(name_or_path))
    return _tokenizers[name_or_path]


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, width, ids): the ids of each text and the end id, ``width`` bytes each."""
    kind = dict(docs.dtypes)["doc_id"]

    def encoded(batches):
        pieces = piece_ids(tokenizer)
        for b in batches:
            ids = pieces.of(b["text"], end_id)
            yield {"doc_id": b["doc_id"], "width": [pieces.kind.itemsize] * len(ids), "ids": ids}

    return map_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), encoded, f"doc_id {kind}, width int, ids binary")


def id_counts(ids: DataFrame) -> np.ndarray:
    """Occurrences of each id; one row an id of the vocabulary comes to the driver."""

    def counted(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for width in set(b["width"]):
                raw = b"".join(x for x, w in zip(b["ids"], b["width"], strict=True) if w == width)
                got = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield {"id": used, "n": total[used]}

    rows = map_rows(ids.select("width", "ids"), counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


# ---------------------------------------------------------------- one file


class Writer:
    def __init__(self, out, code: Code, block: int = BLOCK):
        self.out, self.code, self.block = out, code, block
        self.waiting, self.n_waiting, self.at = [], 0, 0
        self.blocks, self.doc_ids, self.n_tokens = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_tokens.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint16)
        upto = len(ids) if whole else len(ids) // self.block * self.block
        for at in range(0, upto, self.block):
            part = ids[at : min(at + self.block, upto)]
            bits, marks = self.code.encode(part)
            marks = marks.astype("<u4").tobytes()
            self.blocks.append((self.at, len(part), len(marks), len(bits)))
            self._put(marks)
            self._put(bits)
        self.waiting, self.n_waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> dict:
        self._flush(whole=True)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        parts = [
            np.array(self.blocks, "<u8").tobytes(),
            np.packbits(np.array([d is None for d in self.doc_ids], bool)).tobytes(),
            ids.tobytes(),
            np.array(self.n_tokens, "<u8").tobytes(),
            self.code.lengths.tobytes(),
        ]
        head = json.dumps({"blocks": len(self.blocks), "docs": len(self.doc_ids), "ids": len(self.code.lengths), "lane": LANE}).encode()
        footer = zlib.compress(struct.pack("<I", len(head)) + head + b"".join(parts), 1)
        self._put(footer)
        self._put(struct.pack("<Q", len(footer)) + MAGIC)
        return {"n_docs": len(self.doc_ids), "n_tokens": int(sum(self.n_tokens)), "n_bytes": self.at}


class Reader:
    """Range-reads one file: the footer first, then only the blocks asked for."""

    def __init__(self, f, size: int):
        self.f = f
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = struct.unpack("<Q", tail[:8])[0]
        raw = zlib.decompress(f.read_at(length, size - 16 - length))
        n = struct.unpack_from("<I", raw)[0]
        head = json.loads(raw[4 : 4 + n])
        at = 4 + n
        docs = head["docs"]
        self.blocks = np.frombuffer(raw, "<u8", head["blocks"] * 4, at).reshape(-1, 4)
        at += head["blocks"] * 32
        self.nulls = np.unpackbits(np.frombuffer(raw, np.uint8, (docs + 7) // 8, at))[:docs].astype(bool)
        at += (docs + 7) // 8
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        at += docs * 8
        self.n_tokens = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
        at += docs * 8
        self.code = Code(np.frombuffer(raw, np.uint8, head["ids"], at))

    def block(self, k: int) -> np.ndarray:
        at, n, marks, bits = (int(x) for x in self.blocks[k])
        raw = self.f.read_at(marks + bits, at)
        return self.code.decode(raw[marks:], np.frombuffer(raw, "<u4", marks // 4), n)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document's id and the pieces of its ids, block after block."""
        k, now, at = 0, np.zeros(0, np.uint32), 0
        for i, n in enumerate(self.n_tokens):
            pieces = []
            while n > 0:
                if at == len(now):
                    now, at, k = self.block(k), 0, k + 1
                take = min(int(n), len(now) - at)
                pieces.append(now[at : at + take])
                at, n = at + take, n - take
            yield None if self.nulls[i] else int(self.doc_ids[i]), pieces


# ---------------------------------------------------------------- folders of files


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID, files: int | None = None) -> str:
    """Write the ids of ``docs`` (doc_id, text) under ``path``; returns the manifest's URI."""
    spark = docs.sparkSession
    where = qualified(spark, path or scratch_path(spark, "tokens"))
    ids = store(tokenized(docs, tokenizer, end_id), "ids")
    lengths = code_lengths(id_counts(ids)).tobytes()

    def written(batches):
        fs, folder = opened(where)
        name = f"part-{TaskContext.get().partitionId():06d}.tokens"
        first = next(batches, None)
        if first is None:
            return
        with replaced(fs, f"{folder}/{name}") as out:
            writer = Writer(out, Code(np.frombuffer(lengths, np.uint8)))
            while first is not None:
                for doc_id, width, raw in zip(first["doc_id"], first["width"], first["ids"], strict=True):
                    writer.add(doc_id, np.frombuffer(raw, f"<u{width}"))
                first = next(batches, None)
            told = writer.close()
        yield {"name": [name]} | {k: [v] for k, v in told.items()}

    ranged = ids.repartitionByRange(files or shuffle_parts(spark), F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    told = map_rows(ranged, written, "name string, n_docs long, n_tokens long, n_bytes long").collect()
    before, listed = 0, []
    for row in sorted(told, key=lambda r: r["name"]):
        listed.append(row.asDict() | {"start": before})
        before += row["n_tokens"]
    manifest = f"{where}/manifest.json"
    write_json(spark, manifest, {"format": MAGIC.decode(), "tokenizer": os.path.basename(tokenizer), "end_id": end_id, "n_tokens": before, "files": listed})
    discard(ids)
    return manifest


def read_tokens(spark: SparkSession, manifest: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files; one task a file."""
    listed = len(read_manifest(manifest)["files"])

    def told(batches):
        told_of = read_manifest(manifest)["files"]
        fs, at = opened(manifest.rpartition("/")[0])
        for b in batches:
            for k in b["id"]:
                entry, rows = told_of[k], {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with fs.open_input_file(f"{at}/{entry['name']}") as f:
                    start = entry["start"]
                    for doc_id, pieces in Reader(f, entry["n_bytes"]).documents():
                        crc, n = 0, 0
                        for x in pieces:
                            crc, n = zlib.crc32(x.astype("<u4").tobytes(), crc), n + len(x)
                        rows["doc_id"].append(doc_id)
                        rows["start"].append(start)
                        rows["n_tokens"].append(n)
                        rows["ids_crc32"].append(crc)
                        start += n
                yield rows

    which = spark.range(0, listed, 1, max(listed, 1))
    return map_rows(which, told, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


# ---------------------------------------------------------------- query


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the files written of the whole table."""
    return read_tokens(spark, write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
