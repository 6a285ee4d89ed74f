"""Ogg media columns: pages, checksums, packets, logical streams and times.

`packets` takes a column of Ogg files and gives one row for each packet of each
logical stream; `pages` gives one row for each page with the outcome of its
checksum. A page is found by its capture pattern; after damage the search goes on
at the next pattern. Packets are put together from the lacing values, over page
borders where a page says that it continues one. Streams (several at once, or one
after the other) are told apart by serial number and by where a new one begins.

Times come from granule positions by the codec's rule. A page says where its last
packet ends; those before are counted back by the durations of the packets: Opus (48
kHz less pre-skip, from the TOC byte), Speex (from the header), FLAC (from the frame
header), Vorbis (a quarter of the block sizes of a packet and the one before, by the
modes in the setup header), Theora (one frame a packet, the granule being key frame and
offset). Packets of a stream's last page are counted forward, as its end may be trimmed.
A packet whose neighbour has no duration (unknown codec, or something lost before it)
has no time but as the last of its page.
The checksum (CRC-32 of polynomial 0x04C11DB7, not reflected) is taken with zlib's
reflected one over bit-reversed bytes, so no byte is handled in Python.

Results for odd input: a null or empty value, or one without a page, has no rows; a
page that fails its checksum or is cut gives a row in `pages` (crc_ok false) and one in
`packets` (kind `page`, status `bad`, its number as packet, no stream), and its packets
are lost; a file of any length is read whole; there are no ties, as pages and packets
have their place; a packet that lost a part, or begins before the first page that was
read, has status `damaged`, one whose end is missing `cut`, any other `ok`. A null
key is a key like any other, repeated rows give repeated rows, an empty table none;
extra columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import binary, need
from quire.llm.tokens import pieces

_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_NO_CRC = b"\0\0\0\0"
CONTINUED, FIRST, LAST = 1, 2, 4
PACKETS = "key bigint, stream int, serial bigint, codec string, packet int, kind string, status string, n_bytes int, end_us bigint, data binary"
PAGES = "key bigint, page int, offset bigint, serial bigint, sequence bigint, flags int, granule bigint, segments int, body int, crc_ok boolean"


def crc(data: bytes) -> int:
    x = zlib.crc32(data.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "big").translate(_REV), "little")


@dataclass
class Page:
    offset: int
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    ok: bool


def read_pages(data: bytes) -> Iterator[Page]:
    at, n = data.find(b"OggS"), len(data)
    while 0 <= at <= n - 27:
        _, version, flags, granule, serial, sequence, said, k = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + k]
        body_at = at + 27 + k
        end = body_at + sum(lacing)
        ok = version == 0 and len(lacing) == k and end <= n and crc(data[at : at + 22] + _NO_CRC + data[at + 26 : end]) == said
        yield Page(at, flags, granule, serial, sequence, lacing, data[body_at:end], ok)
        # after a bad page its length can't be trusted either
        at = end if ok and data[end : end + 4] == b"OggS" else data.find(b"OggS", end if ok else at + 4)


def _codec(first: bytes) -> str:
    for magic, name in ((b"OpusHead", "opus"), (b"\x01vorbis", "vorbis"), (b"Speex   ", "speex"), (b"\x7fFLAC", "flac"), (b"\x80theora", "theora"), (b"fishead\0", "skeleton")):
        if first.startswith(magic):
            return name
    return "unknown"


def opus_samples(packet: bytes) -> int:
    """Samples at 48 kHz of an Opus packet, from its TOC byte (RFC 6716, 3.1)."""
    if not packet:
        return 0
    config, code = packet[0] >> 3, packet[0] & 3
    if config < 12:
        frame = (480, 960, 1920, 2880)[config & 3]
    elif config < 16:
        frame = (480, 960)[config & 1]
    else:
        frame = (120, 240, 480, 960)[config & 3]
    count = (1, 2, 2)[code] if code < 3 else (packet[1] & 63 if len(packet) > 1 else 0)
    return frame * count


def vorbis_modes(setup: bytes) -> list[int]:
    """Which modes of a setup header have long blocks; they stand at its end, so it is read backwards."""
    bits = int.from_bytes(setup, "little")
    at, flags, found = bits.bit_length() - 1, [], []
    while at >= 47 and len(flags) < 64:
        mode = bits >> (at - 41) & ((1 << 41) - 1)  # long block, window type, transform type, mapping
        if mode >> 1 & 0xFFFFFFFF or mode >> 33 > 63:
            break
        flags.insert(0, mode & 1)
        at -= 41
        if (bits >> (at - 6) & 63) + 1 == len(flags):
            found = list(flags)
    return found


def flac_samples(frame: bytes) -> int | None:
    """Samples of a FLAC frame, from its header."""
    if len(frame) < 6 or frame[0] != 0xFF or frame[1] & 0xFE != 0xF8:
        return None
    code = frame[2] >> 4
    if code == 1:
        return 192
    if 2 <= code <= 5:
        return 576 << (code - 2)
    if code >= 8:
        return 256 << (code - 8)
    ones = 8 - (~frame[4] & 0xFF).bit_length()
    at = 4 + max(1, ones)
    if code == 6 and len(frame) > at:
        return frame[at] + 1
    if code == 7 and len(frame) > at + 1:
        return int.from_bytes(frame[at : at + 2], "big") + 1
    return None


@dataclass
class Stream:
    number: int
    serial: int
    codec: str | None = None
    rate: tuple[int, int] = (0, 1)  # units a second, as a fraction
    skip: int = 0
    fixed: int = 0
    shift: int = 0
    blocks: tuple[int, int] = (0, 0)
    modes: list[int] = field(default_factory=list)
    block: int | None = None  # of the Vorbis packet before; None: unknown
    headers: int = 1
    next_page: int | None = None
    part: list[bytes] | None = None
    broken: bool = False
    count: int = 0
    before: int | None = 0  # where the page before ends, in units
    done: list[tuple] = field(default_factory=list)
    steps: list[int | None] = field(default_factory=list)  # durations

    def begin(self, first: bytes) -> None:
        """What the first packet says about rate, durations and number of headers."""
        self.codec, n = _codec(first), len(first)
        if self.codec == "opus" and n >= 12:
            self.rate, self.skip, self.headers = (48_000, 1), struct.unpack_from("<H", first, 10)[0], 2
        elif self.codec == "vorbis" and n >= 29:
            self.rate, self.headers = (struct.unpack_from("<I", first, 12)[0], 1), 3
            self.blocks, self.block = (1 << (first[28] & 15), 1 << (first[28] >> 4)), 0
        elif self.codec == "speex" and n >= 68:
            rate, (size,), (per,), (extra,) = struct.unpack_from("<I", first, 36)[0], struct.unpack_from("<I", first, 56), struct.unpack_from("<I", first, 64), struct.unpack_from("<I", first, 68) if n >= 72 else (0,)
            self.rate, self.fixed, self.headers = (rate, 1), size * max(per, 1), 2 + extra
        elif self.codec == "flac" and n >= 51:
            self.rate = (int.from_bytes(first[27:30], "big") >> 4, 1)
            self.headers = 1 + struct.unpack_from(">H", first, 7)[0]
        elif self.codec == "theora" and n >= 42:
            self.rate, self.shift, self.headers = struct.unpack_from(">II", first, 22), (int.from_bytes(first[40:42], "big") >> 5) & 31, 3

    def units(self, granule: int) -> int:
        return (granule >> self.shift) + (granule & ((1 << self.shift) - 1)) if self.codec == "theora" else granule

    def micros(self, units: int) -> int | None:
        per, by = self.rate
        return (units - self.skip) * 1_000_000 * by // per if per and by else None

    def duration(self, data: bytes) -> int | None:
        """Units of a data packet; None where nothing tells."""
        if self.codec == "opus":
            return opus_samples(data) or None
        if self.codec == "speex":
            return self.fixed or None
        if self.codec == "flac":
            return flac_samples(data)
        if self.codec == "theora":
            return 1
        if self.codec != "vorbis" or not self.modes or not data or data[0] & 1:
            return None
        mode = data[0] >> 1 & ((1 << (len(self.modes) - 1).bit_length()) - 1)
        if mode >= len(self.modes):
            self.block = None
            return None
        last, self.block = self.block, self.blocks[self.modes[mode]]
        return None if last is None else (last + self.block) // 4 if last else 0

    def take(self, page: Page) -> None:
        gap = self.next_page is not None and page.sequence != self.next_page or self.next_page is None and not page.flags & FIRST
        self.next_page = (page.sequence + 1) & 0xFFFFFFFF
        if gap:
            self.before = self.block = None
        if page.flags & CONTINUED:
            if self.part is None:
                self.part, self.broken = [], True
            self.broken |= gap
        elif self.part is not None:  # its rest never came
            self.put(b"".join(self.part), "damaged" if gap or self.broken else "cut")
            self.part, self.broken = None, False
        at, size, ended = 0, 0, []
        for x in page.lacing:
            size += x
            if x < 255:
                data = page.body[at : at + size]
                at, size = at + size, 0
                status = "ok"
                if self.part is not None:
                    data, status = b"".join([*self.part, data]), "damaged" if self.broken else "ok"
                    self.part, self.broken = None, False
                ended.append(self.put(data, status))
        if size or page.lacing and page.lacing[-1] == 255:
            self.part = [*(self.part or []), page.body[at : at + size]]
        self.time(page, ended)

    def put(self, data: bytes, status: str) -> int:
        if self.codec is None:
            self.begin(data)
        kind = "header" if self.count < self.headers else "data"
        if self.codec == "vorbis" and kind == "header" and status == "ok" and data[:7] == b"\x05vorbis":
            self.modes = vorbis_modes(data)
        if status != "ok":
            self.block = None
        self.done.append([self.count, kind, status, len(data), None, data])
        self.steps.append(self.duration(data) if kind == "data" and status == "ok" else None)
        self.count += 1
        return len(self.done) - 1

    def time(self, page: Page, ended: list[int]) -> None:
        own = [i for i in ended if self.done[i][1] == "data"]
        if page.granule < 0:  # no packet ends here
            return
        end = self.units(page.granule)
        if own:
            if page.flags & LAST and self.before is not None:  # the end may be trimmed: count from the page before
                at = self.before
                for i in own[:-1]:
                    if self.steps[i] is None:
                        break
                    at = min(at + self.steps[i], end)
                    self.done[i][4] = self.micros(at)
            elif not page.flags & LAST:
                at = end
                for i, later in zip(own[-2::-1], own[:0:-1]):
                    if self.steps[later] is None:
                        break
                    at -= self.steps[later]
                    self.done[i][4] = self.micros(at)
            self.done[own[-1]][4] = self.micros(end)
        self.before = end

    def end(self) -> None:
        if self.part is not None:
            self.put(b"".join(self.part), "damaged" if self.broken else "cut")
            self.part = None


def read_streams(data: bytes, bad: list | None = None) -> list[Stream]:
    """The logical streams in the order in which they begin; a serial that begins again is a new one. `bad` gets (number, page) of bad pages."""
    streams: list[Stream] = []
    now: dict[int, Stream] = {}
    for i, page in enumerate(read_pages(data)):
        if not page.ok:
            if bad is not None:
                bad.append((i, page))
            continue
        s = now.get(page.serial)
        if s is None or page.flags & FIRST and s.next_page is not None:
            if s is not None:
                s.end()
            s = now[page.serial] = Stream(len(streams), page.serial)
            streams.append(s)
        s.take(page)
    for s in now.values():
        s.end()
    return streams


def page_bytes(lacing: bytes, body: bytes, flags: int, granule: int, serial: int, sequence: int) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + crc(whole).to_bytes(4, "little") + whole[26:]


def paginate(packets: list[bytes], ends: list[int], serial: int, alone: int = 1, most: int = 4096) -> list[bytes]:
    """The pages of one stream; each of the first `alone` packets has pages of its own, later ones share until `most` bytes."""
    out: list[bytes] = []
    lacing, body, size, granule = bytearray(), [], 0, -1
    flags = FIRST

    def flush(more: int = 0) -> None:
        nonlocal lacing, body, size, granule, flags
        if lacing:
            out.append(page_bytes(bytes(lacing), b"".join(body), flags | more, granule, serial, len(out)))
            lacing, body, size, granule, flags = bytearray(), [], 0, -1, 0

    for i, (p, end) in enumerate(zip(packets, ends)):
        values = b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        at = 0
        while True:
            room = 255 - len(lacing)
            take = values[:room]
            values = values[room:]
            n = sum(take)
            lacing += take
            body.append(p[at : at + n])
            at, size = at + n, size + n
            if not values:
                granule = end
                break
            flush()
            flags = CONTINUED
        if i < len(packets) - 1 and (i < alone or size >= most or len(lacing) == 255):
            flush()
    flush(LAST)
    return out


OPUS = [b"OpusHead\x01\x01" + struct.pack("<HIhB", 312, 48_000, 0, 0), b"OpusTags" + struct.pack("<I", 5) + b"quire" + struct.pack("<I", 0)]
#: Two modes, short and long blocks, at the end of the setup header; what stands before is of no use here.
_MODES = (1 | 1 << 47 | 1 << 88).to_bytes(12, "little")
VORBIS = [b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 44_100, 0, 64_000, 0, 0xB8, 1), b"\x03vorbis" + struct.pack("<I", 5) + b"quire" + struct.pack("<IB", 0, 1), b"\x05vorbis" + b"\xff" * 8 + _MODES]
OPUS_TOC = b"\xf8"  # one CELT frame of 20 ms
VORBIS_LONG, VORBIS_SHORT = b"\x02", b"\0"
VORBIS_STEP = (2048 + 256) // 4  # from a block to the next, long and short in turn
DAMAGED = [b"a stream with a damaged page", b"its end is here"[:10], b"whole"]


def damaged_pages() -> list[bytes]:
    """A stream whose second page, which begins a packet, fails its checksum."""
    lost = page_bytes(b"\xff", b"x" * 255, 0, -1, 3, 1)
    return [page_bytes(bytes([len(DAMAGED[0])]), DAMAGED[0], FIRST, 0, 3, 0), lost[:-1] + b"y", page_bytes(bytes([10, 5]), DAMAGED[1] + DAMAGED[2], CONTINUED | LAST, 0, 3, 2)]


_DAMAGED_PAGES = b"".join(damaged_pages())
_CHAINED = b"".join(paginate([*OPUS, OPUS_TOC + b"chained"], [0, 0, 960], 1, 2))


def mux(text: str) -> bytes:
    """A file of two interleaved streams that share their pages among packets: lines 1, 3, ... as Opus packets, lines 2, 4, ... as Vorbis packets of long and short blocks in turn; then a stream with a damaged page, and a chained one under the first one's serial."""
    lines = text.encode().split(b"\n")
    odd, even = [OPUS_TOC + x for x in lines[::2]], [(VORBIS_SHORT if k % 2 else VORBIS_LONG) + x for k, x in enumerate(lines[1::2])]
    a = paginate([*OPUS, *odd], [0, 0, *range(960, 960 * (len(odd) + 1), 960)], 1, 2)
    b = paginate([*VORBIS, *even], [0, 0, 0, *range(0, VORBIS_STEP * len(even), VORBIS_STEP)], 2, 3)
    both = [x for pair in zip(a, b) for x in pair]
    n = min(len(a), len(b))
    return b"".join([*both, *a[n:], *b[n:], _DAMAGED_PAGES, _CHAINED])


def from_text(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every document as an Ogg file; a null text stays null."""
    need(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            media = [None if t is None else mux(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, media binary")


def _keyed(df: DataFrame, key: str, media: str) -> DataFrame:
    need(df, key, media)
    return df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{media}`").alias("media"))


def packets(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each packet and each bad page; `stream` numbers the logical streams of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        names = [x.strip().split(" ")[0] for x in PACKETS.split(",")]
        for b in pieces(batches, "media", 2 << 20):
            rows = []
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m:
                    bad: list = []
                    rows += [(k, s.number, s.serial, s.codec, *r) for s in read_streams(m, bad) for r in s.done]
                    rows += [(k, None, p.serial, None, i, "page", "bad", len(p.body), None, None) for i, p in bad]
            cols = list(zip(*rows)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), binary(cols[9])], names=names)

    return _keyed(df, key, media).mapInArrow(run, PACKETS)


def pages(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each page, damaged ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        names = [x.strip().split(" ")[0] for x in PAGES.split(",")]
        for b in pieces(batches, "media"):
            rows = [
                (k, i, p.offset, p.serial, p.sequence, p.flags, p.granule, len(p.lacing), len(p.body), p.ok)
                for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m
                for i, p in enumerate(read_pages(m))
            ]
            cols = list(zip(*rows)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return _keyed(df, key, media).mapInArrow(run, PAGES)


def _hex(x: bytes) -> str:
    import hashlib

    return hashlib.md5(x).hexdigest()


def query(docs: DataFrame) -> DataFrame:
    """Every packet and every bad page of every document's file; the data as its digest. The number of a bad page is left out: it follows from how packets share pages."""
    number = F.when(F.col("kind") != "page", F.col("packet"))
    return packets(from_text(docs)).select(F.col("key").alias("doc_id"), "stream", "serial", "codec", number.alias("packet"), "kind", "status", "n_bytes", "end_us", F.md5("data").alias("digest"))


_CONST = [
    *((0, i, "header", "ok", b, None) for i, b in enumerate(OPUS)), *((1, i, "header", "ok", b, None) for i, b in enumerate(VORBIS)),
    (2, 0, "header", "ok", DAMAGED[0], None), (2, 1, "data", "damaged", DAMAGED[1], None), (2, 2, "data", "ok", DAMAGED[2], None),
    *((3, i, "header", "ok", b, None) for i, b in enumerate(OPUS)), (3, 2, "data", "ok", OPUS_TOC + b"chained", (960 - 312) * 1_000_000 // 48_000),
]
_ROWS = ", ".join(f"({s}, {i}, '{k}', '{t}', {len(b)}, '{_hex(b)}', {'NULL' if e is None else e}::BIGINT)" for s, i, k, t, b, e in _CONST)
ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS x FROM documents WHERE text IS NOT NULL
), p AS (SELECT doc_id, x[1] AS line, x[2] // 2 AS k, x[2] % 2 AS s FROM l),
h(s, packet, kind, status, n_bytes, digest, end_us) AS (VALUES {_ROWS}),
a AS (
  SELECT doc_id, s, k + 2 + s AS packet, 'data' AS kind, 'ok' AS status, strlen(line) + 1 AS n_bytes,
    CASE WHEN s = 0 THEN ((k + 1) * 960 - 312) * 1000000 // 48000 ELSE k * {VORBIS_STEP} * 1000000 // 44100 END AS end_us,
    md5(CASE WHEN s = 0 THEN '\\xF8'::BLOB WHEN k % 2 = 0 THEN '\\x02'::BLOB ELSE '\\x00'::BLOB END || encode(line)) AS digest FROM p
  UNION ALL SELECT doc_id, s, packet, kind, status, n_bytes, end_us, digest FROM documents CROSS JOIN h WHERE text IS NOT NULL
)
SELECT doc_id, s::INT AS stream, CASE s WHEN 3 THEN 1 ELSE s + 1 END::BIGINT AS serial, CASE s WHEN 1 THEN 'vorbis' WHEN 2 THEN 'unknown' ELSE 'opus' END AS codec, packet::INT AS packet, kind,
  status, n_bytes::INT AS n_bytes, end_us::BIGINT AS end_us, digest FROM a
UNION ALL SELECT doc_id, NULL, 3, NULL, NULL, 'page', 'bad', 255, NULL, NULL FROM documents WHERE text IS NOT NULL
"""
