"""Directories of ZIP files, central and ZIP64, read by ranges; members are not extracted."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
#: The end record and the longest comment behind it.
_TAIL = 22 + 0xFFFF


class BadZip(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    stored_size: int
    size: int
    crc: int
    header_at: int

    @property
    def stored(self) -> bool:
        return self.method == 0


class ZipRanges:
    """The members of a ZIP that ``read_at(n_bytes, offset)`` reads, ``size`` bytes long."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        self.members = {m.name: m for m in self._members(size)}

    def _members(self, size: int):
        start = max(0, size - _TAIL)
        tail = self.read_at(size - start, start)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise BadZip("no end of central directory")
        count, length, begin = struct.unpack_from("<HII", tail, at + 10)
        if count == _FULL16 or _FULL32 in (length, begin):
            count, length, begin = self._wide(start + at)
        raw = self.read_at(length, begin)
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != _ENTRY:
                raise BadZip("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
            header_at = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            plain, packed, header_at = _widened(extra, plain, packed, header_at)
            yield Member(name, method, packed, plain, crc, header_at)
            at += 46 + n_name + n_extra + n_comment

    def _wide(self, end_at: int) -> tuple[int, int, int]:
        locator = self.read_at(20, end_at - 20) if end_at >= 20 else b""
        if locator[:4] != _LOCATOR:
            raise BadZip("no ZIP64 locator")
        record = self.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != _END64:
            raise BadZip("no ZIP64 end of central directory")
        return struct.unpack_from("<QQQ", record, 32)

    def data_at(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if not member.stored:
            raise BadZip(f"{name} is not stored")
        head = self.read_at(30, member.header_at)
        if head[:4] != _LOCAL:
            raise BadZip(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header_at + 30 + n_name + n_extra

    def read(self, name: str) -> bytes:
        raw = self.read_at(self.members[name].size, self.data_at(name))
        self.check(name, len(raw), zlib.crc32(raw))
        return raw

    def check(self, name: str, size: int, crc: int) -> None:
        """Hold what was read of a whole member against the directory."""
        member = self.members[name]
        if (size, crc) != (member.size, member.crc):
            raise BadZip(f"{name} is damaged: {size} bytes of {member.size}, checksum {crc:08x} for {member.crc:08x}")


def _widened(extra: bytes, *values: int) -> list[int]:
    """``values`` with those that are full taken from the ZIP64 field, in its order."""
    at, out = 0, list(values)
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(out):
                if v == _FULL32:
                    out[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + n
    return out
