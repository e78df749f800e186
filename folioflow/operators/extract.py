"""Text extraction: which branch a document takes, and the branches that need Python.

Plain text stays in the JVM. ZIP containers, PDF tools, legacy converters and vision calls run
in Arrow batches over the rows of their branch only, so no other document pays for them.
Failures are columns: error_kind and error_msg.
"""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime as M
from ..functions.text import SPACES, USABLE_LAYER_CHARS, is_blank
from ..processes import guarded
from ..workers import BYTES, ROWS

#: Limits on archives, and on plain texts and images.
MOST_ENTRIES = 1024
MOST_BYTES = 64 << 20
MOST_PLAIN = MOST_IMAGE = 32 << 20
#: Local names of elements that begin a new line.
BLOCK_TAGS = frozenset({"p", "br", "tab", "tr", "row", "table-row", "line-break"})
MAX_PAGES, DPI = 20, 200
TEXT_SCHEMA = "struct<content:string,origin:string,truncation:struct<pages_processed:int,pages_total:int>,error_kind:string,error_msg:string>"
_CUT = pa.struct([("pages_processed", pa.int32()), ("pages_total", pa.int32())])
_TEXT = pa.struct([("content", pa.string()), ("origin", pa.string()), ("truncation", _CUT), ("error_kind", pa.string()), ("error_msg", pa.string())])
#: The error kind of documents whose pages are to be looked at by ``operators.pages``.
LATER = "later"
_SPACES = SPACES


class Failure(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Tools:
    """What extraction may call. ``vision`` takes (media type, bytes) and returns text; it is
    pickled to the workers and may be left out. ``deferred``: pages aren't looked at, only
    counted, in errors of kind ``LATER``."""

    max_pages: int = MAX_PAGES
    dpi: int = DPI
    timeout: float = 120.0
    vision: Callable[[str, bytes], str] | None = None
    deferred: bool = False


# ---------------------------------------------------------------- containers


def zip_kind(content: bytes) -> str:
    """What a ZIP holds: OpenDocument if its first member is a stored ``mimetype`` that names a
    supported kind, Office Open XML if it has a content list and a part of a known folder."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = z.infolist()
            if members and members[0].filename == "mimetype" and members[0].compress_type == zipfile.ZIP_STORED:
                with z.open(members[0]) as f:
                    kind = f.read(128).decode("utf-8", "replace").strip(_SPACES)
                if kind in M.SUPPORTED:
                    return kind
    except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, ValueError):
        return M.ZIP
    names = [m.filename for m in members]
    found = [kind for n in names if n != "[Content_Types].xml" for prefix, kind in M.OOXML.items() if n.startswith(prefix)]
    return found[-1] if found and "[Content_Types].xml" in names else M.ZIP


def zip_kinds(content: Column) -> Column:
    """``zip_kind`` as an Arrow UDF, which has the bytes of one row at a time."""
    run = lambda batch: pa.array([zip_kind(x.as_py()) if x.is_valid else None for x in batch], pa.string())
    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(content)


def with_kind(docs: DataFrame, content: str = "content", containers: bool = True) -> DataFrame:
    """Add ``mime`` in one pass. Only content that looks like a ZIP is handed to Python, other
    rows hand over a null; without ``containers`` nothing is, and a ZIP stays a ZIP."""
    sniffed = docs.withColumn("mime", F.when(F.col(content).isNotNull(), M.sniffed(F.col(content))))
    if not containers:
        return sniffed
    inside = zip_kinds(F.when(F.col("mime") == M.ZIP, F.col(content)))
    return sniffed.withColumn("mime", F.coalesce(inside, F.col("mime")))


def _wanted(kind: str, name: str) -> bool:
    if kind == M.OOXML["word/"]:
        return name == "word/document.xml"
    if kind == M.OOXML["xl/"]:
        return name == "xl/sharedStrings.xml" or (name.startswith("xl/worksheets/") and name.endswith(".xml"))
    if kind == M.OOXML["ppt/"]:
        return name.startswith("ppt/slides/slide") and name.endswith(".xml")
    return kind in M.ODF and name == "content.xml"


class _CharData:
    """Character data of XML, with a line feed before each block element once there is text."""

    def __init__(self):
        self.parts: list[str] = []
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True  # else each line feed is a part of its own
        self.parser.buffer_size = 1 << 16
        self.parser.StartElementHandler = self._start
        self.parser.CharacterDataHandler = self.parts.append

    def _start(self, name: str, _attributes) -> None:
        if name.rpartition(":")[2] in BLOCK_TAGS and self.parts:
            self.parts.append("\n")

    def feed(self, data: bytes, last: bool = False) -> None:
        self.parser.Parse(data, last)

    def text(self) -> str:
        return "".join(self.parts)


def office_text(kind: str, content: bytes) -> str:
    """Text of the useful members, in archive order. Sizes are counted while reading, over all
    members together, so what a member claims about itself doesn't matter."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise Failure("extract", f"opening the archive: {e}") from e
    with z:
        members = z.infolist()
        if len(members) > MOST_ENTRIES:
            raise Failure("bomb", f"it declares {len(members)} entries, and the limit is {MOST_ENTRIES}")
        left, texts = MOST_BYTES, []
        for member in members:
            if not _wanted(kind, member.filename):
                continue
            if left <= 0:
                raise Failure("bomb", f"its members decompress to more than {MOST_BYTES >> 20} MiB")
            data, used = _CharData(), 0
            try:
                with z.open(member) as f:
                    while piece := f.read(min(1 << 16, left + 1 - used)):
                        used += len(piece)
                        if used > left:
                            raise Failure("bomb", f"{member.filename} decompresses past the {MOST_BYTES >> 20} MiB limit")
                        data.feed(piece)
                data.feed(b"", last=True)
            except (expat.ExpatError, zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
                raise Failure("extract", f"parsing {member.filename}: {e}") from e
            left -= used
            if text := data.text():
                texts.append(text)
    return "\n".join(texts)


# ---------------------------------------------------------------- host tools


def host_tool(*names: str, package: str = "") -> str:
    """The first of ``names`` on the path; looked up only when a document needs it."""
    for name in names:
        if found := shutil.which(name):
            return found
    raise Failure("missing-tool", f"{names[0]} is not installed (package {package or names[0]})")


def run_tool(argv: list[str], timeout: float) -> bytes:
    try:
        with guarded(argv, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as process:
            told, said = process.communicate(timeout=timeout)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise Failure("extract", f"{Path(argv[0]).name}: {e}") from e
    if process.returncode:
        said = said.decode("utf-8", "replace").strip()
        raise Failure("extract", f"{Path(argv[0]).name}: exit {process.returncode}" + (f": {said}" if said else ""))
    return told


def pages_of(layer: str) -> list[str]:
    pages = layer.split("\f")
    if not pages[-1].strip(_SPACES):
        pages.pop()
    return pages or [""]


def capped(total: int, most: int) -> tuple[int, tuple[int, int] | None]:
    return (total, None) if most <= 0 or total <= most else (most, (most, total))


def usable(pages: list[str]) -> bool:
    n = 0
    for page in pages:
        n += sum(c not in _SPACES for c in page)
        if n >= USABLE_LAYER_CHARS:
            return True
    return False


def _see(tools: Tools, media: str, data: bytes) -> str:
    if tools.vision is None:
        raise Failure("not-configured", "no vision endpoint is configured")
    try:
        return tools.vision(media, data)
    except Failure:
        raise
    except Exception as e:
        raise Failure(getattr(e, "kind", "transport"), str(e)) from e


def transcribed(tools: Tools, media: str, data: bytes) -> str:
    """An image's text."""
    return _see(tools, media, data).strip(_SPACES)


def rendered_page(path: Path, page: int, tools: Tools) -> bytes:
    """One page of a PDF as an image."""
    render = host_tool("pdftoppm", package="poppler-utils")
    with tempfile.TemporaryDirectory() as folder:
        run_tool([render, "-png", "-r", str(tools.dpi if tools.dpi > 0 else DPI), "-f", str(page), "-l", str(page), str(path), str(Path(folder, "page"))], tools.timeout)
        images = sorted(Path(folder).glob("*.png"))
        if not images:
            raise Failure("extract", f"rasterising page {page} produced no image")
        return images[0].read_bytes()


class Later(Failure):
    """Pages that ``operators.pages`` is to look at: how many, of how many."""

    def __init__(self, pages: tuple[int, int]):
        super().__init__(LATER, "")
        self.pages = pages


def pdf_text(content: bytes, tools: Tools) -> tuple[str, str, tuple[int, int] | None]:
    """The text layer if it is usable; else each page as an image, transcribed."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "in.pdf")
        path.write_bytes(content)
        layer = run_tool([host_tool("pdftotext", package="poppler-utils"), "-q", str(path), "-"], tools.timeout)
        pages = pages_of(layer.decode("utf-8", "replace"))
        n, cut = capped(len(pages), tools.max_pages)
        if usable(pages[:n]):
            return "\n".join(pages[:n]), "text-layer", cut
        if tools.deferred:
            raise Later((n, len(pages)))
        said = [transcribed(tools, "image/png", rendered_page(path, page, tools)) for page in range(1, n + 1)]
        return "\n\n".join(said), "vision", cut


def legacy_text(content: bytes, tools: Tools) -> str:
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "in.doc")
        path.write_bytes(content)
        run_tool([host_tool("libreoffice", "soffice"), "--headless", "--convert-to", "txt:Text", "--outdir", folder, str(path)], tools.timeout)
        made = sorted(Path(folder).glob("*.txt"))
        if not made:
            raise Failure("extract", "the conversion produced no text")
        return made[0].read_bytes().decode("utf-8", "replace")


def extracted(mime: str, content: bytes, tools: Tools) -> tuple[str, str, tuple[int, int] | None]:
    """(text, origin, truncation) of one document."""
    if mime == M.TEXT:
        if len(content) > MOST_PLAIN:
            raise Failure("extract", f"a text of more than {MOST_PLAIN >> 20} MiB")
        return content.decode("utf-8", "replace"), "plain", None
    if mime == M.PDF:
        return pdf_text(content, tools)
    if mime in M.IMAGES:
        if len(content) > MOST_IMAGE:
            raise Failure("extract", f"an image of more than {MOST_IMAGE >> 20} MiB")
        if tools.deferred:
            raise Later((1, 1))
        return transcribed(tools, mime, content), "vision", None
    if mime == M.OLE2:
        return legacy_text(content, tools), "office", None
    if mime in M.OFFICE:
        return office_text(mime, content), "office", None
    raise Failure("unsupported", f"unsupported type {mime}")


def extract_udf(tools: Tools):
    """An Arrow UDF (mime, content) to the text struct, for the branches that need Python. It has the
    bytes of one row at a time and hands texts on in pieces, since they may be a thousand times
    larger than what they come from. It is marked as not deterministic: a plan evaluates it once
    for each row, however often the text is used or filtered by."""

    def one(mime: str, content: bytes) -> dict:
        out = dict.fromkeys(("content", "origin", "truncation", "error_kind", "error_msg"))
        if mime is None:
            return out
        try:
            text, out["origin"], cut = extracted(mime, content, tools)
            out["content"] = text
            if cut:
                out["truncation"] = dict(zip(("pages_processed", "pages_total"), cut, strict=True))
        except Failure as e:
            out["error_kind"], out["error_msg"] = e.kind, str(e)
            if isinstance(e, Later):
                out["truncation"] = dict(zip(("pages_processed", "pages_total"), e.pages, strict=True))
        return out

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for mimes, contents in batches:
            told, bulk = [], 0
            for m, x in zip(mimes, contents, strict=True):
                told.append(one(m.as_py(), x.as_py()))
                bulk += len(told[-1]["content"] or "")
                if len(told) == ROWS or bulk > BYTES:
                    yield pa.array(told, _TEXT)
                    told, bulk = [], 0
            if told or not len(mimes):
                yield pa.array(told, _TEXT)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    run = F.arrow_udf(run, TEXT_SCHEMA)
    return run.asNondeterministic()


def plain_text(content: Column) -> Column:
    """The struct of a plain text, without Python: the bytes as they are."""
    big = F.octet_length(content) > MOST_PLAIN
    return F.struct(
        F.when(~big, content.cast("string")).alias("content"),
        F.lit("plain").alias("origin"),
        F.lit(None).cast("struct<pages_processed:int,pages_total:int>").alias("truncation"),
        F.when(big, F.lit("extract")).alias("error_kind"),
        F.when(big, F.lit(f"a text of more than {MOST_PLAIN >> 20} MiB")).alias("error_msg"),
    )


def _refused(kind: str, message: Column) -> Column:
    nothing = F.lit(None).cast("string")
    cut = F.lit(None).cast("struct<pages_processed:int,pages_total:int>")
    return F.struct(nothing.alias("content"), nothing.alias("origin"), cut.alias("truncation"), F.lit(kind).alias("error_kind"), message.alias("error_msg"))


def with_text(docs: DataFrame, tools: Tools | None = None) -> DataFrame:
    """Add the struct ``text`` to rows with mime, size and content (binary), in one pass.

    Plain texts and refusals are expressions. Other kinds go to Python, and only their content
    does: every other row hands over a null. Without ``tools`` there is no Python at all and
    those kinds are errors of kind ``not-configured``. A text of nothing but white space is an
    error of kind ``empty``.
    """
    size, mime = F.col("size"), F.col("mime")
    costly = (size > 0) & M.is_supported(mime) & (mime != M.TEXT)
    if tools is None:
        made = _refused("not-configured", F.concat(F.lit("no tools for "), mime))
    else:
        made = F.col("_made")
        docs = docs.withColumn("_made", extract_udf(tools)(F.when(costly, mime), F.when(costly, F.col("content"))))
    t = (
        F.when(size.isNull(), _refused("source", F.lit("no such document, or it can't be read")))
        .when(size <= 0, _refused("source", F.lit("empty")))
        .when(~M.is_supported(mime), _refused("unsupported", F.concat(F.lit("unsupported type "), mime)))
        .when(costly, made)
        .otherwise(plain_text(F.col("content")))
    )
    rows = docs.withColumn("_text", t).drop("_made")
    t = F.col("_text")
    blank = t["error_kind"].isNull() & (t["content"].isNull() | is_blank(t["content"]))
    whole = F.struct(
        t["content"].alias("content"),
        t["origin"].alias("origin"),
        t["truncation"].alias("truncation"),
        F.when(blank, F.lit("empty")).otherwise(t["error_kind"]).alias("error_kind"),
        F.when(blank, F.lit("no text in the document")).otherwise(t["error_msg"]).alias("error_msg"),
    )
    return rows.withColumn("text", whole).drop("_text")


__all__ = ["Failure", "Tools", "extracted", "office_text", "with_kind", "with_text", "zip_kind"]
