"""Binary containers: packs of chunks and manifests of files.

A pack is its chunks, each an 8-byte header (version, compressed length of 3 bytes, scheme, raw length of 3 bytes) and
its payload, then an index: hashes, ends of the chunks as stored, starts of the chunks unpacked, and the pack's hash.
A manifest has a header, fixed-size records of files and their segments, of packs and their chunks, and of raw chunk
hashes, and a footer. All numbers are little-endian. The tags that open sections are parameters.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from itertools import accumulate

from cairn.functions import compression, merkle
from cairn.functions.blake3 import data_hash

HEADER = 8
MOST_CHUNKS = 100_000
ZERO = bytes(32)
#: What marks the end of a list of records.
END_MARK = b"\xff" * 32
RECORD, LOOKUP, FOOTER = 48, 68, 208


@dataclass(frozen=True)
class Tags:
    """Seven bytes for each section of a pack, 32 for a manifest."""

    main: bytes = b"CRNPACK"
    hashes: bytes = b"CRNHASH"
    bounds: bytes = b"CRNBNDS"
    manifest: bytes = b"cairn manifest".ljust(32, b"\0")


TAGS = Tags()


def chunk_header(packed: int, scheme: int, raw: int) -> bytes:
    if max(packed, raw) >= 1 << 24:
        raise ValueError("a chunk is too long for its header")
    return struct.pack("<B", 0) + packed.to_bytes(3, "little") + struct.pack("<B", scheme) + raw.to_bytes(3, "little")


def parse_chunk_header(b: bytes) -> tuple[int, int, int]:
    """(packed length, scheme, raw length)."""
    if len(b) < HEADER or b[0] != 0 or b[4] > compression.BG4_LZ4:
        raise ValueError("not a chunk header")
    return int.from_bytes(b[1:4], "little"), b[4], int.from_bytes(b[5:8], "little")


@dataclass
class PackIndex:
    pack_hash: bytes
    hashes: list[bytes]
    ends: list[int]
    unpacked_starts: list[int]

    def encode(self, tags: Tags = TAGS) -> bytes:
        n = len(self.hashes)
        numbers = struct.pack(f"<{2 * n}I", *self.ends, *self.unpacked_starts)
        return tags.hashes + b"\0" + struct.pack("<I", n) + b"".join(self.hashes) + tags.bounds + b"\1" + numbers + tags.main + b"\1" + self.pack_hash

    @staticmethod
    def length(n: int) -> int:
        return 60 + 40 * n

    @classmethod
    def decode(cls, data: bytes, tags: Tags = TAGS) -> PackIndex:
        if data[:7] != tags.hashes or data[7:8] != b"\0":
            raise ValueError("no section of hashes, or of another version")
        n = struct.unpack_from("<I", data, 8)[0] if len(data) >= 12 else MOST_CHUNKS + 1
        if n > MOST_CHUNKS or len(data) < cls.length(n):
            raise ValueError("too many chunks, or the index is cut off")
        at = 12 + 32 * n
        if data[at : at + 7] != tags.bounds or data[at + 7] != 1:
            raise ValueError("no section of boundaries, or of another version")
        numbers = struct.unpack_from(f"<{2 * n}I", data, at + 8)
        end = at + 8 + 8 * n
        if data[end : end + 7] != tags.main or data[end + 7] != 1:
            raise ValueError("no main section, or of another version")
        return cls(data[end + 8 : end + 40], [data[12 + 32 * i : 44 + 32 * i] for i in range(n)], list(numbers[:n]), list(numbers[n:]))


@dataclass(frozen=True)
class Packed:
    data: bytes
    pack_hash: bytes
    stored_hashes: list[bytes]
    starts: list[int]
    raw_sizes: list[int]
    payload_bytes: int


def build_packs(lists: list[list[bytes]], scheme: int = compression.NONE, tags: Tags = TAGS) -> list[Packed]:
    """A pack of each list of chunks; all are hashed together."""
    bodies = [[compression.compress(scheme, c) for c in chunks] for chunks in lists]
    stored = [[chunk_header(len(x), scheme, len(c)) + x for x, c in zip(xs, chunks, strict=True)] for xs, chunks in zip(bodies, lists, strict=True)]
    flat = iter(data_hash([s for ss in stored for s in ss]))
    hashes = [[next(flat) for _ in ss] for ss in stored]
    roots = merkle.roots([[(h, len(s)) for h, s in zip(hs, ss, strict=True)] for hs, ss in zip(hashes, stored, strict=True)])
    out = []
    for chunks, xs, ss, hs, root in zip(lists, bodies, stored, hashes, roots, strict=True):
        ends, unpacked = list(accumulate(map(len, ss))), list(accumulate(map(len, chunks)))
        index = PackIndex(root, hs, ends, [0, *unpacked][: len(chunks)]).encode(tags)
        out.append(Packed(b"".join(ss) + index, root, hs, [0, *ends][: len(chunks)], [len(c) for c in chunks], sum(map(len, xs))))
    return out


def build_pack(chunks: list[bytes], scheme: int = compression.NONE, tags: Tags = TAGS) -> Packed:
    return build_packs([chunks], scheme, tags)[0]


@dataclass(frozen=True)
class StoredChunk:
    index: int
    start: int
    packed: int
    scheme: int
    raw: int
    stored_hash: bytes


def _parse_pack(data: bytes, tags: Tags) -> tuple[PackIndex, list[tuple[int, int, int, int, int]]]:
    """The index, and (index, start, packed, scheme, raw) of each chunk; all but hashes is checked."""
    at = data.rfind(tags.hashes)
    if at < 0:
        raise ValueError("no index")
    index = PackIndex.decode(data[at:], tags)
    if at + PackIndex.length(len(index.hashes)) != len(data):
        raise ValueError("bytes after the index")
    found, start, raw_at = [], 0, 0
    for i, end in enumerate(index.ends):
        packed, scheme, raw = parse_chunk_header(data[start : start + HEADER])
        if start + HEADER + packed != end or end > at:
            raise ValueError(f"chunk {i} has another length than its boundary says")
        if index.unpacked_starts[i] != raw_at:
            raise ValueError(f"chunk {i} doesn't follow the one before")
        found.append((i, start, packed, scheme, raw))
        start, raw_at = end, raw_at + raw
    if start != at:
        raise ValueError("a gap before the index")
    return index, found


def verify_packs(packs: list[bytes], tags: Tags = TAGS) -> list[tuple[bytes, list[StoredChunk]] | ValueError]:
    """For each pack its hash and chunks, once every hash, length and offset has been checked, or what is wrong; all are hashed together."""
    parsed: list = []
    for data in packs:
        try:
            parsed.append(_parse_pack(data, tags))
        except ValueError as e:
            parsed.append(e)
    good = [k for k, x in enumerate(parsed) if isinstance(x, tuple)]
    flat = iter(data_hash([packs[k][s : s + HEADER + p] for k in good for _, s, p, _, _ in parsed[k][1]]))
    hashes = {k: [next(flat) for _ in parsed[k][1]] for k in good}
    roots = dict(zip(good, merkle.roots([[(h, HEADER + f[2]) for h, f in zip(hashes[k], parsed[k][1], strict=True)] for k in good]), strict=True))
    for k in good:
        index, found = parsed[k]
        if hashes[k] != index.hashes:
            parsed[k] = ValueError("a chunk's hash is wrong")
        elif roots[k] != index.pack_hash:
            parsed[k] = ValueError("the pack's hash is wrong")
        else:
            parsed[k] = index.pack_hash, [StoredChunk(*f, h) for f, h in zip(found, hashes[k], strict=True)]
    return parsed


def verify_pack(data: bytes, tags: Tags = TAGS) -> tuple[bytes, list[StoredChunk]]:
    found = verify_packs([data], tags)[0]
    if isinstance(found, ValueError):
        raise found
    return found


def extract(data: bytes, start: int, raw: int, stored_hash: bytes | None, most_raw: int = 128 << 10) -> bytes:
    """One chunk's bytes; its header and hash are checked before anything is decompressed. stored_hash: None where the pack has been verified."""
    packed, scheme, own = parse_chunk_header(data[start : start + HEADER])
    if own != raw or raw > most_raw or packed > compression.most_compressed(raw, scheme):
        raise ValueError("a chunk's header doesn't fit what was planned")
    stored = data[start : start + HEADER + packed]
    if len(stored) != HEADER + packed or stored_hash is not None and data_hash([stored])[0] != stored_hash:
        raise ValueError("a chunk's hash is wrong")
    return compression.decompress(scheme, stored[HEADER:], raw)


@dataclass
class Manifest:
    """files: hash and segments (pack hash, raw bytes, first chunk, chunk after the last); packs: hash, chunks (stored hash, start, raw bytes), payload bytes; lookup: (raw hash, pack hash, index)."""

    files: list[tuple[bytes, list[tuple[bytes, int, int, int]]]] = field(default_factory=list)
    packs: list[tuple[bytes, list[tuple[bytes, int, int]], int]] = field(default_factory=list)
    lookup: list[tuple[bytes, bytes, int]] = field(default_factory=list)

    def totals(self) -> tuple[int, int, int]:
        """Bytes on disk, in files, and in packs unpacked."""
        return sum(p[2] for p in self.packs), sum(s[1] for f in self.files for s in f[1]), sum(c[2] for p in self.packs for c in p[1])

    def encode(self, tags: Tags = TAGS) -> bytes:
        if len(self.lookup) != sum(len(p[1]) for p in self.packs):
            raise ValueError("as many raw hashes as chunks are needed")
        out = bytearray(tags.manifest + struct.pack("<QQ", 2, FOOTER))
        files_at = len(out)
        for h, segments in self.files:
            out += h + struct.pack("<IIQ", 0, len(segments), 0)
            for pack, size, first, end in segments:
                out += pack + struct.pack("<IIII", 0, size, first, end)
        out += END_MARK + bytes(16)
        packs_at = len(out)
        for h, chunks, stored in self.packs:
            out += h + struct.pack("<IIII", 0, len(chunks), sum(c[2] for c in chunks), stored)
            for own, start, raw in chunks:
                out += own + struct.pack("<IIII", start, raw, 0, 0)
        out += END_MARK + bytes(16)
        lookup_at = len(out)
        for raw_hash, pack, i in self.lookup:
            out += raw_hash + pack + struct.pack("<I", i)
        footer_at = len(out)
        out += struct.pack("<Q6Q", 1, files_at, len(self.files), packs_at, len(self.packs), lookup_at, len(self.lookup))
        out += bytes(32) + struct.pack("<QQ", 0, 0) + bytes(FOOTER - 8 * 7 - 32 - 16 - 32) + struct.pack("<QQQQ", *self.totals(), footer_at)
        return bytes(out)

    @staticmethod
    def outline(data: bytes, tags: Tags = TAGS) -> dict[str, int]:
        """Numbers of files, packs and chunks, and the totals, from header and footer alone."""
        if len(data) < RECORD + FOOTER or data[:32] != tags.manifest or struct.unpack_from("<QQ", data, 32) != (2, FOOTER):
            raise ValueError("not a manifest of this version")
        foot = data[-FOOTER:]
        version, _, files, _, packs, _, chunks = struct.unpack_from("<7Q", foot)
        stored, total, unpacked, at = struct.unpack_from("<QQQQ", foot, FOOTER - 32)
        if version != 1 or at != len(data) - FOOTER:
            raise ValueError("the footer is wrong")
        return {"files": files, "packs": packs, "chunks": chunks, "stored_bytes": stored, "file_bytes": total, "unpacked_bytes": unpacked}

    @classmethod
    def decode(cls, data: bytes, tags: Tags = TAGS) -> Manifest:
        if len(data) < RECORD + FOOTER or data[:32] != tags.manifest or struct.unpack_from("<QQ", data, 32) != (2, FOOTER):
            raise ValueError("not a manifest of this version")
        foot = data[-FOOTER:]
        version, files_at, n_files, packs_at, n_packs, lookup_at, n_lookup = struct.unpack_from("<7Q", foot)
        if version != 1 or struct.unpack_from("<Q", foot, FOOTER - 8)[0] != len(data) - FOOTER or not RECORD <= files_at <= packs_at <= lookup_at <= len(data) - FOOTER:
            raise ValueError("the footer is wrong")

        def records(at: int, end: int, n: int):
            for _ in range(n):
                if at + RECORD > end:
                    raise ValueError("a section is cut off")
                head = data[at : at + RECORD]
                count = struct.unpack_from("<I", head, 36)[0]
                stop = at + RECORD * (1 + count)
                if head[:32] == END_MARK or stop > end:
                    raise ValueError("a section is cut off")
                yield head, [data[i : i + RECORD] for i in range(at + RECORD, stop, RECORD)]
                at = stop

        out = cls()
        for head, rows in records(files_at, packs_at, n_files):
            out.files.append((head[:32], [(r[:32], *struct.unpack_from("<III", r, 36)) for r in rows]))
        for head, rows in records(packs_at, lookup_at, n_packs):
            out.packs.append((head[:32], [(r[:32], *struct.unpack_from("<II", r, 32)) for r in rows], struct.unpack_from("<I", head, 44)[0]))
        if n_lookup != sum(len(p[1]) for p in out.packs) or lookup_at + LOOKUP * n_lookup != len(data) - FOOTER:
            raise ValueError("as many raw hashes as chunks are needed")
        out.lookup = [(data[i : i + 32], data[i + 32 : i + 64], struct.unpack_from("<I", data, i + 64)[0]) for i in range(lookup_at, lookup_at + LOOKUP * n_lookup, LOOKUP)]
        if struct.unpack_from("<QQQ", foot, FOOTER - 32) != out.totals():
            raise ValueError("the totals are wrong")
        return out
