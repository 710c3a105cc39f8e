"""Merkle roots over ordered (hash, size) lists.

A level is cut into groups: after the third or a later node whose hash is divisible by four, or after nine; two or
fewer left are one group. A group's node hashes the lines "hex : size" of its members. Levels shrink until one is left.
"""

from __future__ import annotations

from .blake3 import digests, node_hash

BRANCHING = 4
FEWEST, MOST = 2, 2 * BRANCHING + 1
ZERO = bytes(32)


def groups(hashes: list[bytes]) -> list[int]:
    """Ends of the groups of a level."""
    ends, start, n = [], 0, len(hashes)
    while start < n:
        cut = min(n, start + MOST)
        if n - start > FEWEST:
            cut = next((i + 1 for i in range(start + FEWEST, cut) if hashes[i][0] % BRANCHING == 0), cut)
        ends.append(cut)
        start = cut
    return ends


def line(h: bytes, size: int) -> bytes:
    return f"{h.hex()} : {size}\n".encode()


def roots(lists: list[list[tuple[bytes, int]]]) -> list[bytes]:
    """The root of each list, all lists a level at a time: zeros for no node, a single node's own hash."""
    lists = [list(x) for x in lists]
    while any(len(x) > 1 for x in lists):
        parts = []
        for k, nodes in enumerate(lists):
            if len(nodes) > 1:
                ends = groups([h for h, _ in nodes])
                parts += [(k, nodes[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        hashes = node_hash([b"".join(line(h, n) for h, n in part) for _, part in parts])
        for k in {k for k, _ in parts}:
            lists[k] = []
        for (k, part), h in zip(parts, hashes, strict=True):
            lists[k].append((h, sum(n for _, n in part)))
    return [x[0][0] if x else ZERO for x in lists]


def root(nodes: list[tuple[bytes, int]]) -> bytes:
    return roots([nodes])[0]


def pack_hash(chunks: list[tuple[bytes, int]]) -> bytes:
    """Of (serialized hash, serialized length)."""
    return root(chunks)


def file_hashes(lists: list[list[tuple[bytes, int]]], salt: bytes = ZERO) -> list[bytes]:
    """Of (raw hash, raw length): each root, hashed again with the salt as key. Zeros for no chunk."""
    found = digests(roots(lists), salt)
    return [h if x else ZERO for h, x in zip(found, lists, strict=True)]


def file_hash(chunks: list[tuple[bytes, int]], salt: bytes = ZERO) -> bytes:
    return file_hashes([chunks], salt)[0]
