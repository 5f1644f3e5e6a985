"""Vectorised work on the UTF-8 bytes of Arrow string columns, used inside Spark tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once (one longer text is worked on alone).
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers = (np.ones(1, dtype=U64), np.ones(1, dtype=U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(p))
        if size > CHUNK + 1:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data else np.empty(0, dtype=np.uint8)
    return raw, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows in pieces of about ``size`` bytes of text, with their bytes and offsets."""
    for batch in batches:
        raw, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
            row = end


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space, and the index of each row's first word (one more entry than rows)."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = _IS_WORD[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offs] = True
    before = np.empty(len(raw), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(raw), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Spans of more bytes get a hash of another kind: sums of powers modulo 2^64 have pairs of long spans (of 1,024 bytes and more) that meet for any base.
LONG = 256


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.empty(0, dtype=U64)
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=sums[1:])
        out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    for i in np.flatnonzero(ends - starts > LONG):
        span = raw[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((_LOWER[span] if lower else span).tobytes(), digest_size=8).digest(), "little")
    return out


def order_within(group: np.ndarray, values: np.ndarray, groups: int, score: np.ndarray | None = None, score_bits: int = 0) -> np.ndarray:
    """The order by group, then score (under ``2 ** score_bits``), then value; equal triples in any order."""
    bits = max(groups - 1, 1).bit_length() + score_bits
    key = (group.astype(U64) << U64(64 - bits + score_bits)) | (values >> U64(bits))
    if score is not None:
        key |= score.astype(U64) << U64(64 - bits)
    order = np.argsort(key)
    key, sorted_values = key[order], values[order]
    # the last bits of a value aren't in the key: where they would decide, sort in full
    if len(key) > 1 and ((key[1:] == key[:-1]) & (sorted_values[1:] != sorted_values[:-1])).any():
        return np.lexsort((values, group) if score is None else (values, score, group))
    return order


def word_shingles(hashes: np.ndarray, bounds: np.ndarray, width: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's distinct runs of ``width`` words, sorted by row and hash, the rows' bounds, and the runs' lengths as sums of ``lengths``.

    A row of fewer words has one run of all of them.
    """
    n, rows = len(hashes), len(bounds) - 1
    counts = np.diff(bounds)
    upto = np.r_[0, np.cumsum(lengths)]
    with np.errstate(over="ignore"):
        acc = np.zeros(max(n - width + 1, 0), dtype=U64)
        for i in range(width):
            acc = mix(acc * U64(0x2545F4914F6CDD1D) + hashes[i : i + len(acc)] + U64(width))
        owner = np.repeat(np.arange(rows), counts)
        at = np.arange(len(acc))
        whole = np.flatnonzero(at + width <= bounds[owner[: len(acc)] + 1]) if len(acc) else np.empty(0, np.int64)
        values, rows_of, long = acc[whole], owner[whole], upto[whole + width] - upto[whole]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.zeros(len(short), dtype=U64)
            for i in range(width - 1):
                here = counts[short] > i
                extra[here] = mix(extra[here] * U64(0x2545F4914F6CDD1D) + hashes[bounds[short[here]] + i] + U64(1000 + width))
            values, rows_of = np.concatenate([values, mix(extra + counts[short].astype(U64))]), np.concatenate([rows_of, short])
            long = np.concatenate([long, upto[bounds[short + 1]] - upto[bounds[short]]])
    order = order_within(rows_of, values, rows)
    values, rows_of, long = values[order], rows_of[order], long[order]
    if len(values):
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (rows_of[1:] != rows_of[:-1])
        values, rows_of, long = values[new], rows_of[new], long[new]
    return values, np.searchsorted(rows_of, np.arange(rows + 1)), long


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
