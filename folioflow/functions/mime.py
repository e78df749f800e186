"""Type detection from a document's first bytes, as one CASE expression.

The table is the public WHATWG MIME-sniffing standard's, after the magic numbers of TIFF and
of OLE2 compound files. Extensions are never looked at. ZIP containers are told apart in
``operators.extract`` because that needs their directory.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much of a document is looked at, and the kinds text can be taken from.
HEAD_BYTES = 512
PDF, TEXT, OLE2, ZIP = "application/pdf", "text/plain", "application/x-ole-storage", "application/zip"
IMAGES = ("image/jpeg", "image/png", "image/tiff", "image/webp")
OOXML = {
    "word/": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xl/": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt/": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
ODF = (
    "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.oasis.opendocument.presentation",
)
OFFICE = (*OOXML.values(), *ODF, OLE2)
SUPPORTED = (PDF, *IMAGES, *OFFICE, TEXT)

#: HTML tags that a document may begin with, white space before them allowed.
HTML_TAGS = ("!DOCTYPE HTML", "HTML", "HEAD", "SCRIPT", "IFRAME", "H1", "DIV", "FONT", "TABLE", "A", "STYLE", "TITLE", "B", "BODY", "BR", "P", "!--")

#: Magic numbers as regexes over one character a byte, in the order they are tried.
MAGIC = (
    (r"II\x2A\x00|MM\x00\x2A", "image/tiff"),
    (r"\xD0\xCF\x11\xE0\xA1\xB1\x1A\xE1", OLE2),
    (rf"[\t\n\f\r ]*<(?i:{'|'.join(HTML_TAGS)})[ >]", "text/html"),
    (r"[\t\n\f\r ]*<\?xml", "text/xml"),
    (r"%PDF-", PDF),
    (r"%!PS-Adobe-", "application/postscript"),
    (r"\xFE\xFF..|\xFF\xFE..|\xEF\xBB\xBF.", TEXT),
    (r"\x00\x00[\x01\x02]\x00", "image/x-icon"),
    (r"BM", "image/bmp"),
    (r"GIF8[79]a", "image/gif"),
    (r"RIFF.{4}WEBPVP", "image/webp"),
    (r"\x89PNG\r\n\x1A\n", "image/png"),
    (r"\xFF\xD8\xFF", "image/jpeg"),
    (r"FORM.{4}AIFF", "audio/aiff"),
    (r"ID3", "audio/mpeg"),
    (r"OggS\x00", "application/ogg"),
    (r"MThd\x00\x00\x00\x06", "audio/midi"),
    (r"RIFF.{4}AVI ", "video/avi"),
    (r"RIFF.{4}WAVE", "audio/wave"),
)
MAGIC_AFTER_MP4 = (
    (r"\x1A\x45\xDF\xA3", "video/webm"),
    (r".{34}LP", "application/vnd.ms-fontobject"),
    (r"\x00\x01\x00\x00", "font/ttf"),
    (r"OTTO", "font/otf"),
    (r"ttcf", "font/collection"),
    (r"wOFF", "font/woff"),
    (r"wOF2", "font/woff2"),
    (r"\x1F\x8B\x08", "application/x-gzip"),
    (r"PK\x03\x04", ZIP),
    (r"Rar!\x1A\x07(\x00|\x01\x00)", "application/x-rar-compressed"),
    (r"\x00asm", "application/wasm"),
)
#: Bytes that no text has.
BINARY_BYTES = r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]"


def sniffed(content: Column) -> Column:
    """The media type that the first 512 bytes of a binary column tell."""
    head = F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")
    box = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    movie = (
        (F.length(head) >= 12)
        & (box % 4 == 0)
        & (F.length(head) >= box)
        & (F.substring(head, 5, 4) == "ftyp")
        & F.substr(head, F.lit(1), F.greatest(box, F.lit(0)).cast("int")).rlike(r"(?s)\A.{8}(mp4|.{4}.{4}(.{4})*mp4)")
    )
    out = F.when(F.lit(False), F.lit(""))
    for pattern, kind in MAGIC:
        out = out.when(head.rlike(rf"(?s)\A(?:{pattern})"), F.lit(kind))
    out = out.when(movie, F.lit("video/mp4"))
    for pattern, kind in MAGIC_AFTER_MP4:
        out = out.when(head.rlike(rf"(?s)\A(?:{pattern})"), F.lit(kind))
    return out.when(head.rlike(BINARY_BYTES), F.lit("application/octet-stream")).otherwise(F.lit(TEXT))


def is_supported(mime: Column) -> Column:
    return mime.isin(*SUPPORTED)


def is_image(mime: Column) -> Column:
    return mime.isin(*IMAGES)


def is_office(mime: Column) -> Column:
    return mime.isin(*OFFICE)
