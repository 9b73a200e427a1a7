"""What the vertices of a Merkle tree do with what they hear. Workers of RDDs import this module alone, which needs little room."""

from __future__ import annotations

import zlib
from hashlib import sha256

NO, LEFT, RIGHT = b"-LR"


def joined(run: list[bytes]) -> bytes:
    """The digest of a run of nodes: of their digests as hex text."""
    return sha256("".join(x.hex() for x in run).encode()).digest()


def levels_of(digests: list[bytes], n: int, climb: int) -> list[list[bytes]]:
    """The levels over a run of nodes, itself first; ``n`` nodes stand on its level in the whole group, and where one is left it is the top."""
    out = [digests]
    while n > 1 and len(out) <= climb:
        last = out[-1]
        out.append([joined(last[k : k + 2]) for k in range(0, len(last), 2)])
        n = (n + 1) // 2
    return out


def siblings_of(levels: list[list[bytes]], k: int) -> tuple[bytes, bytes]:
    """(sides, digests) of the siblings of node k of the lowest level, up to the highest: on the left, on the right or none."""
    sides, digests = bytearray(), []
    for level in levels[:-1]:
        other = k ^ 1
        if other < len(level):
            sides.append(LEFT if other < k else RIGHT)
            digests.append(level[other])
        else:
            sides.append(NO)
        k //= 2
    return bytes(sides), b"".join(digests)


def folded(leaf: bytes, sides: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and the siblings on its way give."""
    at = 0
    for side in sides:
        other = siblings[at : at + 32]
        leaf = joined([leaf] if side == NO else [other, leaf] if side == LEFT else [leaf, other])
        at += 32 * (side != NO)
    return leaf


def place(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def complete(climb: int):
    """A vertex whose children have all come: (nodes on their level, levels of the run, what the children carry)."""

    def run(kv):
        (group, i), messages = kv
        rows = sorted(messages, key=lambda m: m[0])
        n = rows[0][1]
        if [m[0] for m in rows] != list(range(min(1 << climb, n - (i << climb)))):
            raise ValueError(f"vertex {i} of group {group!r} has not heard from each of its children once")
        return (group, i), (n, levels_of([m[2] for m in rows], n, climb), [m[3] for m in rows])

    return run


def upward(climb: int):
    def run(kv):
        (group, i), (n, levels, _) = kv
        return (group, i >> climb), (i & (1 << climb) - 1, (n + (1 << climb) - 1) >> climb, levels[-1][0], None)

    return run


def downward(climb: int):
    def run(kv):
        (group, i), met = kv
        (_, levels, carried), (sides, siblings, top) = (x for _, x in sorted(met, key=lambda m: m[0]))
        for k, more in enumerate(carried):
            a, b = siblings_of(levels, k)
            yield (group, i << climb | k), (a + sides, b + siblings, top, levels[0][k], more)

    return run


def top_first(kv):
    """The key that orders groups: null first, then bytewise."""
    group = kv[0][0]
    return group is not None, (group or "").encode()


def verified_row(kv):
    """A leaf's row, with the root that its digest (or the one that was seen instead) gives with the siblings that came down to it."""
    _, (sides, siblings, (subroot, root), leaf, (seen, *carried)) = kv
    fold = folded(leaf if seen is None else seen, sides, siblings)
    return bytearray(leaf), bytearray(subroot), bytearray(root), sides.decode(), bytearray(siblings), bytearray(fold), *carried
