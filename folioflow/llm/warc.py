"""WARC records in ZIP packages, written by tasks and range-read without extraction.

A package holds two stored members: archive/data.warc.gz, one gzip member a record, and
indexes/index.cdxj, a line for each record with its place. Of pages with equal payloads of
at least ``min_bytes``, that of the least page_id is written in full, the others as revisits
that refer to it. Digests are grouped first, so only digests and ids meet by payload; the
groups join the pages as an ordinary equi-join, whose hot partitions Spark splits.

The reader finds the members through the central (or ZIP64) directory, reads the index, and
fetches records by ranges, neighbours together up to some MB. Checksums of members and digests
of responses are held against what was read, and what a revisit says of its payload against
the response that it names.

Defined cases: a null html is an empty payload; rows of the least page_id of a payload are
all responses, also where it is repeated; a null page_id only revisits, unless all of its
payload's are null, which are responses; a null url has no target; an empty table gives no
package and an empty result; a payload of any length is one record; other columns don't
take part.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, maybe_among, scratch_path, store, write_json
from .files import opened, qualified, read_manifest, replaced
from .zip_reader import ZipRanges

MIN_BYTES = 100
#: The pages have no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RANGE = 4 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: bytes | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A WARC record, and its payload's digest; a revisit has the HTTP head alone."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url).decode())
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


class _Counting:
    def __init__(self, out):
        self.out, self.n = out, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.n += len(data)


def write_package(out, rows: Iterator[tuple]) -> int:
    """Write (page_id, url, payload, refers_to) rows as a package; returns their number."""
    index = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            counting = _Counting(member)
            for page_id, url, payload, refers_to in rows:
                raw, digest = record(page_id, url, payload, refers_to)
                at = counting.n
                counting.write(gzip.compress(raw, 2, mtime=0))
                kind = "response" if refers_to is None else "revisit"
                index.append(json.dumps({"page_id": page_id, "offset": at, "length": counting.n - at, "type": kind, "digest": digest}))
        with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            member.write("".join(f"{x}\n" for x in index).encode())
    return len(index)


def read_package(f, size: int) -> Iterator[tuple[dict, dict, dict, bytes]]:
    """(index entry, WARC headers, HTTP headers, payload) of each record, fetched by ranges."""
    ranges = ZipRanges(f.read_at, size)
    base, crc, seen = ranges.data_at(DATA), 0, 0
    batch: list[dict] = []
    for line in [*ranges.read(INDEX).splitlines(), None]:
        entry = json.loads(line) if line else None
        if batch and (entry is None or entry["offset"] + entry["length"] - batch[0]["offset"] > _RANGE):
            first = batch[0]["offset"]
            raw = f.read_at(batch[-1]["offset"] + batch[-1]["length"] - first, base + first)
            crc, seen = zlib.crc32(raw, crc), seen + len(raw)
            for e in batch:
                yield e, *parsed(zlib.decompress(raw[e["offset"] - first : e["offset"] - first + e["length"]], wbits=31))
            batch = []
        if entry:
            batch.append(entry)
    ranges.check(DATA, seen, crc)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): the page each row's payload repeats, null where none. Only
    payloads that a bit filter of the repeated ones lets through are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= min_bytes, F.unhex(F.sha2(payload, 256))).alias("digest"))
    groups = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    groups = store(groups, "payloads")
    again = F.col("digest").isNotNull() & maybe_among([F.col("digest")], groups.select("digest"))
    refers = F.when(F.col("first").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("first"))
    several = keyed.where(again).join(groups, "digest", "left").select("page_id", "url", "html", refers.cast("long").alias("refers_to"))
    return several.unionByName(keyed.where(~again).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))


def write_packages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> str:
    """Write ``pages`` (page_id, url, html) as packages under ``path``; returns the manifest's URI."""
    spark = pages.sparkSession
    where = qualified(spark, path or scratch_path(spark, "warc"))

    def written(batches):
        first = next(batches, None)
        if first is None:
            return
        fs, folder = opened(where)
        name = f"part-{TaskContext.get().partitionId():06d}.wacz"

        def rows():
            b = first
            while b is not None:
                for page_id, url, html, refers_to in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                    yield page_id, url, html or b"", refers_to
                b = next(batches, None)

        with replaced(fs, f"{folder}/{name}") as out:
            n = write_package(out, rows())
        yield {"name": [name], "n": [n], "n_bytes": [fs.get_file_info(f"{folder}/{name}").size]}

    told = map_rows(with_revisits(pages, min_bytes), written, "name string, n long, n_bytes long", rows=64).collect()
    manifest = f"{where}/manifest.json"
    write_json(spark, manifest, {"packages": [r.asDict() for r in sorted(told, key=lambda r: r["name"])]})
    return manifest


def read_packages(spark: SparkSession, manifest: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record."""
    listed = len(read_manifest(manifest)["packages"])

    def told(batches):
        packages = read_manifest(manifest)["packages"]
        fs, folder = opened(manifest.rpartition("/")[0])
        for b in batches:
            for k in b["id"]:
                rows = {c: [] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                with fs.open_input_file(f"{folder}/{packages[k]['name']}") as f:
                    for _, warc, http, payload in read_package(f, packages[k]["n_bytes"]):
                        digest, n = warc["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                        if warc["WARC-Type"] == "response":
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != n:
                                raise ValueError(f"damaged record {warc['WARC-Record-ID']} in {packages[k]['name']}")
                        rows["page_id"].append(int(warc["X-Page-Id"]) if "X-Page-Id" in warc else None)
                        rows["url"].append(warc.get("WARC-Target-URI"))
                        rows["payload_bytes"].append(n)
                        rows["payload_digest"].append(digest)
                        rows["record_type"].append(warc["WARC-Type"])
                        rows["refers_to"].append(int(warc["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in warc else None)
                yield rows

    which = spark.range(0, listed, 1, max(listed, 1))
    return map_rows(which, told, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def held_together(records: DataFrame) -> DataFrame:
    """``records``, stored, if every revisit names a response of its length and digest; else an error."""
    kept = store(records, "records")
    same = ["payload_bytes", "payload_digest", "refers_to"]
    answers = kept.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    alone = kept.where("record_type = 'revisit'").join(answers, same, "left_anti").select("page_id", "refers_to").first()
    if alone:
        raise ValueError(f"page {alone['page_id']} revisits page {alone['refers_to']}, which has no such response")
    return kept


# ---------------------------------------------------------------- query


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as its record says, read back from the packages."""
    manifest = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return held_together(read_packages(spark, manifest)).drop("url")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
