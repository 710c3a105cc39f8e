"""Chunk compression: none, LZ4 blocks with a size before them, and LZ4 of bytes grouped by their place in four."""

from __future__ import annotations

import struct

import pyarrow as pa

NONE, LZ4, BG4_LZ4 = 0, 1, 2
SCHEMES = {"none": NONE, "lz4": LZ4, "bg4-lz4": BG4_LZ4}
MOST_BYTES = 16 << 20


def scheme(name: str) -> int:
    """The scheme of a configured name; unknown names are LZ4."""
    return SCHEMES.get(name.strip().lower(), LZ4)


def bg4_split(data: bytes) -> bytes:
    return data[0::4] + data[1::4] + data[2::4] + data[3::4]


def bg4_regroup(data: bytes) -> bytes:
    out, at = bytearray(len(data)), 0
    for k in range(4):
        n = len(range(k, len(data), 4))
        out[k::4] = data[at : at + n]
        at += n
    return bytes(out)


_RAW = pa.Codec("lz4_raw") if pa.Codec.is_available("lz4_raw") else None


def lz4_block(data: bytes) -> bytes:
    """An LZ4 block, by Arrow's codec where it has one. Other encoders give other bytes."""
    return _RAW.compress(data, asbytes=True) if _RAW and data else plain_lz4_block(data)


def lz4_unblock(block: bytes, size: int) -> bytes:
    """Decodes a block to exactly `size` bytes, else an error."""
    if not _RAW or not block or not 64 < size <= MOST_BYTES:
        return plain_lz4_unblock(block, size)
    try:
        out = _RAW.decompress(block, decompressed_size=size, asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise ValueError(f"a bad block: {e}") from None
    try:
        _RAW.decompress(block, decompressed_size=size - 1)  # the codec doesn't tell how much it wrote
    except (OSError, pa.ArrowException):
        return out
    raise ValueError(f"under {size} bytes")


def plain_lz4_block(data: bytes) -> bytes:
    """The same without a codec: greedy matches from a table of the last place of each four bytes."""
    out, last, anchor, i, n = bytearray(), {}, 0, 0, len(data)

    def rest(n: int) -> None:
        if n >= 15:
            out.extend(b"\xff" * ((n - 15) // 255))
            out.append((n - 15) % 255)

    def emit(literals: bytes, offset: int, length: int) -> None:
        out.append(min(len(literals), 15) << 4 | (min(length - 4, 15) if offset else 0))
        rest(len(literals))
        out.extend(literals)
        if offset:
            out.extend(struct.pack("<H", offset))
            rest(length - 4)

    while i < n - 12:
        four = data[i : i + 4]
        found = last.get(four)
        last[four] = i
        if found is None or i - found > 65535:
            i += 1
            continue
        end, most = i + 4, n - 5
        while end < most and data[end] == data[found + end - i]:
            end += 1
        emit(data[anchor:i], i - found, end - i)
        i = anchor = end
    emit(data[anchor:], 0, 4)
    return bytes(out)


def _length(n: int, block: bytes, i: int) -> tuple[int, int]:
    more = 255 if n == 15 else 0
    while more == 255:
        more = block[i]
        n += more
        i += 1
    return n, i


def plain_lz4_unblock(block: bytes, size: int) -> bytes:
    """The same without a codec, and the tests' second opinion."""
    out, i = bytearray(), 0
    try:
        while i < len(block):
            token = block[i]
            i += 1
            a, i = _length(token >> 4, block, i)
            if i + a > len(block):
                raise ValueError("literals beyond the block")
            out += block[i : i + a]
            i += a
            if i == len(block):
                break
            offset = block[i] | block[i + 1] << 8
            i += 2
            b, i = _length(token & 15, block, i)
            b += 4
            if not 0 < offset <= len(out) or len(out) + b > size:
                raise ValueError("a match out of bounds")
            start = len(out) - offset
            while b > 0:  # matches may overlap what they write
                part = out[start : start + min(b, len(out) - start)]
                out += part
                b -= len(part)
    except IndexError:
        raise ValueError("the block ends early") from None
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def compress(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind not in (LZ4, BG4_LZ4):
        raise ValueError(f"unknown compression scheme {kind}")
    return struct.pack("<I", len(data)) + lz4_block(bg4_split(data) if kind == BG4_LZ4 else data)


def decompress(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        if len(data) != size:
            raise ValueError(f"{len(data)} bytes instead of {size}")
        return data
    if kind not in (LZ4, BG4_LZ4):
        raise ValueError(f"unknown compression scheme {kind}")
    if len(data) < 4:
        raise ValueError("no size before the block")
    if size > MOST_BYTES or struct.unpack_from("<I", data)[0] != size:
        raise ValueError("the size before the block is wrong")
    raw = lz4_unblock(data[4:], size)
    return bg4_regroup(raw) if kind == BG4_LZ4 else raw


def most_compressed(size: int, kind: int) -> int:
    """The most bytes that a chunk of this size may take."""
    return size if kind == NONE else size + size // 255 + 20
