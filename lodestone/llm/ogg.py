"""An Ogg container: pages with checksums, lacing, logical streams, granules.

Layout as in RFC 3533. `Writer` puts packets of several logical streams into
pages; `read` verifies every page's checksum and sequence number, takes the
streams apart by serial number, joins packets over lacing values and page
borders, and derives where each packet ends on its stream's time line: a page's
granule position is where the last packet that ends on it does, and from there
the spans of the packets count back. A page that fails its checks is reported
and not used.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

_HEAD = struct.Struct("<4sBBqIIIB")  # fixed by the format: 27 bytes
_CONTINUED, _FIRST, _LAST = 1, 2, 4  # fixed by the format: header type flags
NO_GRANULE = -1  # fixed by the format: no packet ends on this page
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, start and
    final value 0. It is zlib's on mirrored bits, without that one's inversions."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "big").translate(_REVERSED), "little")


def lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


@dataclass
class _Open:
    """A logical stream while it is written."""

    serial: int
    sequence: int = 0
    values: bytearray = field(default_factory=bytearray)
    body: bytearray = field(default_factory=bytearray)
    granule: int = NO_GRANULE
    continued: bool = False


class Writer:
    """Writes pages in the order in which they fill up, so streams interleave."""

    def __init__(self) -> None:
        self.pages: list[bytes] = []
        self.streams: dict[int, _Open] = {}

    def _page(self, s: _Open, last: bool) -> None:
        flags = _CONTINUED * s.continued | _FIRST * (s.sequence == 0) | _LAST * last
        head = _HEAD.pack(b"OggS", 0, flags, s.granule, s.serial, s.sequence, 0, len(s.values))
        page = bytearray(head + s.values + s.body)
        page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
        self.pages.append(bytes(page))
        s.sequence, s.granule, s.continued = s.sequence + 1, NO_GRANULE, bool(s.values) and s.values[-1] == 255
        s.values, s.body = bytearray(), bytearray()

    def packet(self, serial: int, data: bytes, granule: int, flush: bool = False) -> None:
        """granule: the stream's position after this packet."""
        s = self.streams.setdefault(serial, _Open(serial))
        values, at = lacing(len(data)), 0
        while at < len(values):
            room = 255 - len(s.values)
            part = values[at : at + room]
            s.values += part
            s.body += data[at * 255 : (at + len(part)) * 255]
            at += len(part)
            if at == len(values):
                s.granule = granule
            if len(s.values) == 255:
                self._page(s, False)
        if flush and s.values:
            self._page(s, False)

    def close(self) -> bytes:
        for s in self.streams.values():
            self._page(s, True)
        return b"".join(self.pages)


@dataclass
class Stream:
    """A logical stream as read."""

    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule where each packet ends
    pages: int = 0
    next_page: int = 0
    open: bytearray | None = None
    started: bool = False
    ended: bool = False


@dataclass
class Container:
    streams: dict[int, Stream] = field(default_factory=dict)
    pages: int = 0
    bad: int = 0  # pages with a wrong checksum, bytes between pages, gaps in a stream


def read(data: bytes, span: Callable[[bytes], int] = len) -> Container:
    """span: how many granules a packet of the codec lasts."""
    out, at = Container(), 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + _HEAD.size > len(data):
            out.bad += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, sequence, crc, count = _HEAD.unpack_from(data, at)
        body = at + _HEAD.size + count
        values = data[at + _HEAD.size : body]
        end = body + sum(values)
        if version or end > len(data) or checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            out.bad += 1
            at += 4
            continue
        s = out.streams.setdefault(serial, Stream())
        if sequence != s.next_page or bool(flags & _FIRST) == s.started:
            out.bad += 1
            s.open = None
        s.next_page, s.started, s.ended, s.pages = sequence + 1, True, bool(flags & _LAST), s.pages + 1
        out.pages += 1
        part = s.open if flags & _CONTINUED else bytearray()
        whole, done = body, []
        for value in values:
            if part is not None:
                part += data[whole : whole + value]
            whole += value
            if value < 255:
                if part is not None:
                    done.append(bytes(part))
                part = bytearray()
        s.open = part if count and values[-1] == 255 else None
        out.bad += bool(done) != (granule != NO_GRANULE) and bool(values)
        ends, after = [], granule
        for packet in reversed(done):
            ends.append(after)
            after -= span(packet)
        s.packets += done
        s.ends += reversed(ends)
        at = end
    return out
