"""Texts of an Arrow batch as one numpy array of code points."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000  # UTF-8 bytes handled at once; a single longer text makes a slice of its own


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``most`` bytes of the column each, but never less than a row."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, and the n + 1 offsets of its rows; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    starts = offsets - offsets[0]
    if len(raw) and raw.max() >= 0x80:
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
        starts = lead[starts]
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32), starts


def text_of(codes: np.ndarray) -> str:
    return np.asarray(codes, dtype="<u4").tobytes().decode("utf-32-le")


SPECIAL = 0xFFFFFFFF


@functools.cache
def _fold_table() -> np.ndarray:
    """Code point to its only letter or digit, folded; 0 if it has none, SPECIAL where a whole text must be folded."""
    out = np.zeros(0x10001, dtype=np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        s = "".join(x for x in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", chr(c)).casefold()) if x.isalnum())
        out[c] = ord(s) if len(s) == 1 else SPECIAL if s else 0
    out[0x300:0x370] = SPECIAL  # may compose with the letter before
    out[0x3099:0x309B] = SPECIAL
    out[0x10000] = SPECIAL  # every code point beyond the first plane
    return out


def fold_text(text: str) -> str:
    """Letters and digits of a text, without case, width and compatibility forms."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(x for x in folded if x.isalnum())


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``fold_text`` of each row as code points with n + 1 offsets, by one table lookup where that suffices."""
    codes, starts = code_points(pc.replace_substring(column, "ß", "ss"))
    table = _fold_table()
    got = table[np.minimum(codes, 0x10000)]
    odd = np.flatnonzero(got == SPECIAL)
    if not len(odd):
        keep = got != 0
        ends = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[starts]
        return got[keep], ends
    rows = np.unique(np.searchsorted(starts, odd, side="right") - 1)
    slow = {int(r): np.frombuffer(fold_text(text_of(codes[starts[r] : starts[r + 1]])).encode("utf-32-le"), dtype=np.uint32) for r in rows}
    keep = got != 0
    parts, at = [], 0
    plain = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    sizes = np.diff(plain[starts])
    for r in sorted(slow):
        parts += [got[starts[at] : starts[r]][keep[starts[at] : starts[r]]], slow[r]]
        sizes[r] = len(slow[r])
        at = r + 1
    parts.append(got[starts[at] :][keep[starts[at] :]])
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))
