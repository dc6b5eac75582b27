"""Media columns: texts stored as samples in Ogg containers, and read back."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import ogg
from lodestone.llm.common import map_arrow, whole_text

#: Samples in a packet; a multiple of the 64 samples to which payloads are padded.
PACKET = 4096
#: Samples in a second of the stored signal.
RATE = 8000
_SERIALS = (0x5A17, 0x5A18)  # the two logical streams: packets take turns
_HEAD = struct.Struct("<8sIIQ")  # name, rate, channel, samples of the whole payload
_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def payload(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def store(samples: bytes) -> bytes:
    """8-bit samples in two logical streams: packets of PACKET samples take turns, and a
    packet's granule position is how many samples its stream has by its end."""
    out = ogg.Writer()
    for channel, serial in enumerate(_SERIALS):
        out.packet(serial, _HEAD.pack(b"samples8", RATE, channel, len(samples)), 0, flush=True)
    had = [0, 0]
    for k, at in enumerate(range(0, len(samples), PACKET)):
        part = samples[at : at + PACKET]
        had[k % 2] += len(part)
        out.packet(_SERIALS[k % 2], part, had[k % 2], flush=k % 32 > 29)
    return out.close()


def _span(packet: bytes) -> int:
    """Samples in a packet; a header has none."""
    return 0 if packet[:8] == b"samples8" and len(packet) == _HEAD.size else len(packet)


def load(stored: bytes) -> tuple[bytes, dict]:
    """The samples and what the container says about them. Raises ValueError if a
    page fails its checks or the time line has a gap."""
    found = ogg.read(stored, _span)
    if found.bad or set(found.streams) != set(_SERIALS) or not all(s.ended for s in found.streams.values()):
        raise ValueError(f"damaged container: {found.bad} pages failed")
    streams = [found.streams[s] for s in _SERIALS]
    _, rate, _, total = _HEAD.unpack(streams[0].packets[0])
    bodies = [s.packets[1:] for s in streams]
    parts = [bodies[k % 2][k // 2] for k in range(sum(map(len, bodies)))]
    samples = b"".join(parts)
    # Packets follow each other on their stream's time line: each begins where the
    # one before it ends.
    for s in streams:
        if any(end - _span(p) != before for p, end, before in zip(s.packets, s.ends, [0, *s.ends], strict=False)):
            raise ValueError("a granule position is off the time line")
    if len(samples) != total:
        raise ValueError("samples are missing")
    last = [s.ends[-1] for s in streams]
    return samples, {
        "pages": found.pages,
        "packets": [len(s.packets) for s in streams],
        "ends": [round(e / rate, 6) for e in last],
        "seconds": round(sum(last) / rate, 6),
    }


def feature(samples: bytes, facts: dict) -> str:
    """Facts of the container and of the signal, as JSON."""
    x = np.frombuffer(samples, np.uint8)
    level = np.bincount(x >> 5, minlength=8)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return json.dumps(facts | {"mean": round(float(x.mean()), 4), "peak": int(x.max()), "crossings": crossings, "levels": level.tolist()})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            raw = text.as_py().encode()
            stored = store(payload(raw))
            back, facts = load(stored)
            out.append((doc_id, len(raw), len(back), sha(back), zlib.crc32(back[-64:]), len(stored), sha(stored), feature(back, facts)))
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in _SCHEMA.split(", ")]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def media_column(docs: DataFrame) -> DataFrame:
    """Each text as 8-bit samples in an Ogg container, read back and described.

    docs needs doc_id and text; other columns are ignored. A null or empty text
    is a payload of 64 zero samples. Equal texts give equal containers. Repeated
    rows come as often as they are there; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return map_arrow(texts, _rows, _SCHEMA)
