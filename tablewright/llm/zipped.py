"""Directories of ZIP files, read by ranges: which members there are and where their bytes lie. Nothing is extracted.

`read_at(count, offset)` is all that is asked of a file, so a member of an archive of any size costs the end of the file, its
directory, and one local header.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

ReadAt = Callable[[int, int], bytes]

#: Signatures and fixed parts of the records, fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_FIELDS, LOCATOR_FIELDS, END64_FIELDS = "<4s4H2LH", "<4sLQL", "<4sQ2H2L4Q"
CENTRAL_FIELDS, LOCAL_FIELDS = "<4s6H3L5H2L", "<4s5H3L2H"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
STORED, DEFLATED = 0, 8
PIECE = 1 << 20


class Member(NamedTuple):
    name: str
    method: int
    encrypted: bool
    crc: int
    packed: int
    size: int
    header: int


class Directory(NamedTuple):
    members: int
    start: int
    size: int
    #: Bytes that stand before the archive, added to every offset in it.
    before: int


def find_directory(read_at: ReadAt, length: int) -> Directory:
    """Place of the central directory, by the end record or, where a locator stands before it, by the ZIP64 end record."""
    fixed = struct.calcsize(END_FIELDS)
    tail_at = max(0, length - fixed - FULL16)
    tail = read_at(length - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0:
        if at + fixed <= len(tail):
            _, disk, first_disk, _, members, size, start, comment = struct.unpack_from(END_FIELDS, tail, at)
            if at + fixed + comment == len(tail):
                break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP file: it has no end record")
    end = tail_at + at
    locator = end - struct.calcsize(LOCATOR_FIELDS)
    head, _, where, _ = struct.unpack(LOCATOR_FIELDS, read_at(end - locator, locator)) if locator >= 0 else (b"", 0, 0, 0)
    if head == LOCATOR64:
        width = struct.calcsize(END64_FIELDS)
        # with bytes before the archive the record lies further on than it says: right before the locator
        for place in (where, locator - width):
            record = read_at(width, place) if place >= 0 else b""
            if record[:4] == END64:
                break
        else:
            raise ValueError("the ZIP64 end record is not where its locator says")
        _, _, _, _, disk, first_disk, _, members, size, start = struct.unpack(END64_FIELDS, record)
        end = place
    if disk or first_disk:
        raise ValueError("archives of several disks are not read")
    before = end - size - start
    if before < 0:
        raise ValueError("the central directory does not end where it should")
    return Directory(members, start + before, size, before)


def members(read_at: ReadAt, length: int) -> Iterator[Member]:
    """All members in the directory's order. The directory is read in pieces."""
    place = find_directory(read_at, length)
    fixed = struct.calcsize(CENTRAL_FIELDS)
    buffer, at, taken = b"", 0, 0
    for _ in range(place.members):
        for need in (lambda: fixed, lambda: fixed + sum(struct.unpack_from("<3H", buffer, at + 28))):
            while len(buffer) - at < need():
                more = read_at(min(PIECE, place.size - taken), place.start + taken) if taken < place.size else b""
                if not more:
                    raise ValueError("the central directory is cut off")
                buffer, at, taken = buffer[at:] + more, 0, taken + len(more)
        head, _, _, flags, method, _, _, crc, packed, size, named, extra, comment, disk, _, _, header = struct.unpack_from(CENTRAL_FIELDS, buffer, at)
        if head != CENTRAL:
            raise ValueError("the central directory is damaged")
        name = buffer[at + fixed : at + fixed + named]
        more = buffer[at + fixed + named : at + fixed + named + extra]
        wide = _wide_fields(more)
        # the ZIP64 field holds those values only that do not fit their own places, in this order
        if size == FULL32:
            size = next(wide)
        if packed == FULL32:
            packed = next(wide)
        if header == FULL32:
            header = next(wide)
        if disk not in (0, FULL16):
            raise ValueError("archives of several disks are not read")
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), crc, packed, size, header + place.before)
        at += fixed + named + extra + comment


def _wide_fields(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == EXTRA64:
            body = extra[at + 4 : at + 4 + size]
            yield from struct.unpack(f"<{len(body) // 8}Q", body[: len(body) // 8 * 8])
        at += 4 + size
    raise ValueError("a ZIP64 field is missing")


def data_start(read_at: ReadAt, member: Member) -> int:
    """First byte of a member's data. Sizes in its local header are not used: a writer that could not go back left them out."""
    fixed = struct.calcsize(LOCAL_FIELDS)
    head, *_, named, extra = struct.unpack(LOCAL_FIELDS, read_at(fixed, member.header))
    if head != LOCAL:
        raise ValueError(f"{member.name}: no local header at its place")
    return member.header + fixed + named + extra
