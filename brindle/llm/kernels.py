"""Vectorised text kernels shared by the corpus operators.

Everything here works on raw UTF-8 bytes with numpy, so a Python worker spends
its time in compiled loops rather than in per-word interpreter steps.  A *word*
is always a maximal run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed per numpy pass; bounds the scratch memory of a worker.
BLOCK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and all bytes of non-ASCII characters: the inside of a bare word.
_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = True
_INNER[128:] = True


def _hash_block(b: np.ndarray, inside: np.ndarray, prefix: int) -> tuple[np.ndarray, ...]:
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(b)]))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(b) + 1)
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    full = mix64((total[ends] - total[starts]) * down[starts])
    if not prefix:
        return full, starts, ends
    cut = np.minimum(starts + prefix, ends)
    return full, starts, ends, mix64((total[cut] - total[starts]) * down[starts] + np.uint64(77))


def hash_words(data: bytes, bare: bool = False, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the lower-cased (A-Z) words of ``data``, with start and end offsets.

    ``bare`` takes runs of letters, digits and non-ASCII bytes as the words instead.
    ``prefix`` > 0 adds the hashes of each word's first ``prefix`` bytes.
    Equal words hash alike wherever they stand; blocks are cut between words, so the
    scratch memory is bounded by BLOCK and by the longest single word.
    """
    whole = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(whole):
        stop = min(len(whole), at + BLOCK)
        if stop < len(whole):
            inside = _INNER[whole[at:stop]] if bare else ~_SPACE[whole[at:stop]]
            gaps = np.flatnonzero(~inside)
            while not len(gaps) and stop < len(whole):
                stop = min(len(whole), stop + BLOCK)
                inside = _INNER[whole[at:stop]] if bare else ~_SPACE[whole[at:stop]]
                gaps = np.flatnonzero(~inside)
            if stop < len(whole) and len(gaps):
                stop = at + int(gaps[-1]) + 1
        b = whole[at:stop]
        inside = _INNER[b] if bare else ~_SPACE[b]
        got = _hash_block(_LOWER[b], inside, prefix)
        parts.append((got[0], got[1] + at, got[2] + at, *got[3:]))
        at = stop
    if not parts:
        empty = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), empty, empty, *([np.zeros(0, np.uint64)] if prefix else []))
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (none if there are fewer words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + words[k : k + n]
    return mix64(out)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def joined_blocks(texts: list[bytes], limit: int = BLOCK, most: int = 1 << 16) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Groups texts into newline-joined buffers of about ``limit`` bytes and at most ``most`` texts.

    Yields (first index, end index, buffer, offset of each text in it and one past the last).
    """
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at]) + 1
        while stop < len(texts) and stop - at < most and size + len(texts[stop]) < limit:
            size += len(texts[stop]) + 1
            stop += 1
        part = texts[at:stop]
        offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in part])))
        yield at, stop, b"\n".join(part), offsets
        at = stop


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(a), int(b - a))
