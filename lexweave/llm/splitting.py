"""Cutting oversized items at natural boundaries: offset prefix sums and binary search over boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.tokens import TOKENIZER, encoding

CHARACTERS, TOKENS = "characters", "tokens"
#: Kinds of boundary from the most to the least natural; offsets are those just after the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n\s*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[。！？｡।॥؟][”」』’）)]*\s*|[.!?…][”\"’»)]*\s+")),
    ("clause", re.compile(r"[；;，,、:：،؛]\s*")),
    ("word", re.compile(r"\s+")),
)
FILL = 0.5  # least share of the limit that a piece cut at a natural boundary fills


def unit_ends(text: str, unit: str, tokenizer: str = TOKENIZER) -> np.ndarray:
    """Prefix sums of the units' lengths: the offset just after each unit of the text, in code points.

    Units are code points or tokens; a code point that several tokens share ends with the last of them.
    """
    if unit == CHARACTERS:
        return np.arange(1, len(text) + 1, dtype=np.int64)
    code = encoding(tokenizer)
    sizes = np.array([len(code.decode_single_token_bytes(t)) for t in code.encode_ordinary(text)], dtype=np.int64)
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80)))
    last = lead[np.cumsum(sizes)].astype(np.int64) if len(sizes) else np.empty(0, dtype=np.int64)
    whole = np.append(last[1:] > last[:-1], True) if len(last) else np.empty(0, dtype=bool)
    return np.where(whole, last, last - 1)


def boundaries(text: str) -> list[tuple[str, np.ndarray]]:
    """Sorted offsets of each kind at which a piece may end."""
    return [(kind, np.array([m.end() for m in pattern.finditer(text)], dtype=np.int64)) for kind, pattern in BOUNDARIES]


def cut(text: str, limit: int, overlap: int, unit: str = CHARACTERS, tokenizer: str = TOKENIZER) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the end) of at most ``limit`` units.

    A piece ends at the last boundary of the most natural kind that leaves it at least ``FILL`` full, or is cut hard at
    the limit; the next one starts ``overlap`` units before that end.
    """
    ends = unit_ends(text, unit, tokenizer)
    n = len(ends)
    if n <= limit:
        return [(0, len(text), "end")]
    overlap = max(0, min(overlap, limit - 1))
    kinds = boundaries(text)
    out, start = [], 0
    while True:
        first = int(np.searchsorted(ends, start, side="right"))
        stop = first + limit
        if stop >= n:
            out.append((start, len(text), "end"))
            return out
        most = int(ends[stop - 1])
        least = max(int(ends[first + max(overlap, int(limit * FILL)) - 1]), start + 1)
        if most <= start:  # one code point of more tokens than the limit
            most = least = start + 1
        at, kind = most, "hard"
        for name, offsets in kinds:
            k = int(np.searchsorted(offsets, most, side="right")) - 1
            if k >= 0 and offsets[k] > least:
                at, kind = int(offsets[k]), name
                break
        out.append((start, at, kind))
        done = int(np.searchsorted(ends, at, side="right"))
        back = done - overlap
        start = max(int(ends[back - 1]) if back > 0 else 0, start + 1) if overlap else at


def split_items(items: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of ``items`` (item_kind, item_id, content) under the limits of their kinds.

    One row a piece: piece_no, start_offset, end_offset (code points of the content as stored), text, cut and
    n_pieces. ``distinct_pieces`` removes the pieces of repeated rows. An item within its limit is one piece and never leaves the JVM if the unit is a character. A null
    content gives no piece, an empty one a single empty piece; items of a kind without a limit are left whole; null
    kinds and ids are kept.
    """
    # one limit a kind; the join is left to adaptive execution, so any number of kinds will do
    known = limits.groupBy("item_kind").agg(F.min(F.struct("size_unit", "max_size", "overlap_size")).alias("limit")).select("item_kind", "limit.*")
    rows = items.select(F.col("item_kind").cast("string"), F.col("item_id").cast("string"), "content").filter(F.col("content").isNotNull()).join(known, "item_kind", "left")
    size = F.when(F.col("size_unit") == CHARACTERS, F.length("content")).otherwise(F.octet_length("content"))
    over = F.coalesce(size > F.col("max_size"), F.lit(False))
    schema = "item_kind string, item_id string, piece_no int, start_offset long, end_offset long, text string, cut string, n_pieces int"
    whole = rows.filter(~over).select("item_kind", "item_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_offset"), F.length("content").cast("long").alias("end_offset"), F.col("content").alias("text"), F.lit("end").alias("cut"), F.lit(1).alias("n_pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for kind, item, text, unit, most, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = cut(text, most, overlap, unit, tokenizer)
                out += [(kind, item, k, a, b, text[a:b], how, len(pieces)) for k, (a, b, how) in enumerate(pieces)]
            cols = list(zip(*out)) if out else [()] * 8
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item_kind", "item_id", "piece_no", "start_offset", "end_offset", "text", "cut", "n_pieces"])

    return whole.unionByName(rows.filter(over).select("item_kind", "item_id", "content", "size_unit", "max_size", "overlap_size").mapInArrow(run, schema)).withColumn("digest", F.xxhash64("text"))


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    """One row for the pieces of repeated rows of an item."""
    return pieces.dropDuplicates(["item_kind", "item_id", "piece_no", "start_offset", "end_offset", "digest"]).drop("digest")


def oversized(pieces: DataFrame) -> DataFrame:
    """The items that had to be cut."""
    return pieces.filter(F.col("n_pieces") > 1).select("item_kind", "item_id").distinct()
