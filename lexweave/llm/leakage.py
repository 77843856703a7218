"""Evaluation passages in a training corpus: Wu-Manber search for aligned pieces, then exact coverage."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.codes import fold_text, folded, slices, text_of

STRETCH = {"zh": 20, "ja": 30}  # fewest letters and digits of a counted stretch
OTHER_STRETCH = 60
COVERAGE = 0.5
PIECES = {20: 16, 30: 22}  # letters of an aligned piece by least stretch
OTHER_PIECE = 44
PIECE = 14  # first letters of a piece, the window of the search
BLOCK = 4  # letters hashed for the shift table
TABLE_BITS = 18
HEAD = 400  # letters that one search head walks through
ITEMS_AT_ONCE = 20_000  # items of one pass over the corpus; more are searched in further passes


def stretch_of(lang: str | None) -> int:
    return STRETCH.get((lang or "").strip().lower().split("-")[0], OTHER_STRETCH)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(columns[0].shape, dtype=np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _slot(columns: list[np.ndarray]) -> np.ndarray:
    return (_hash(columns) >> np.uint64(20)).astype(np.int64) & ((1 << TABLE_BITS) - 1)


ROOT = 0xD6E8FEB86659FD93
ROOT_INVERSE = pow(ROOT, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(max(0, n - 1), base, dtype=np.uint64))))[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any window follows by one subtraction."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed * _powers(ROOT, len(codes)), dtype=np.uint64)))


def window_hashes(sums: np.ndarray, start: int, end: int, size: int) -> np.ndarray:
    """Hashes of all windows of a size between two offsets."""
    if end - start < size:
        return np.empty(0, dtype=np.uint64)
    rest = pow(ROOT_INVERSE, int(start), 1 << 64)
    return (sums[start + size : end + 1] - sums[start : end - size + 1]) * _powers(ROOT_INVERSE, int(end - start - size + 1)) * np.uint64(rest)


@dataclass
class Searcher:
    """Wu-Manber tables of the pieces of all items.

    Each passage is cut into aligned pieces such that every stretch of the least counted length holds one whole piece.
    SHIFT tells from the block before the end of the window how far the window may move; where it is 0 the bucket of
    the block's slot names the pieces to compare, of which those with the same first letters are compared in full.
    """

    ids: list[int]
    passages: list[str]
    stretches: list[int]
    needed: list[int]
    window_hashes: list[np.ndarray]
    shift: np.ndarray
    bucket_at: np.ndarray
    bucket: np.ndarray
    heads: np.ndarray
    head_hash: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str | None, str | None]], coverage: float = COVERAGE) -> "Searcher":
        """``items``: id, passage, lang. A passage shorter than its least stretch can't leak and is left out."""
        ids, passages, stretches, needed, hashes, pieces_of, owner = [], [], [], [], [], [], []
        for item_id, passage, lang in items:
            p, least = fold_text(passage or ""), stretch_of(lang)
            if item_id is None or len(p) < least:
                continue
            size = PIECES.get(least, OTHER_PIECE)
            step = least - size + 1
            codes = np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)
            starts = list(range(0, len(p) - size + 1, step))
            # a stretch of n letters holds at least (n - size + 1) // step pieces, so a piece stands for at most this many
            reach = 2 * step + size - 2
            needed.append(max(1, math.ceil(len(p) * coverage / reach)))
            hashes.append(window_hashes(prefix_sums(codes), 0, len(codes), least))
            pieces_of += [codes[s : s + size] for s in starts]
            owner += [len(ids)] * len(starts)
            ids.append(item_id)
            passages.append(p)
            stretches.append(least)
        sizes = np.array([len(x) for x in pieces_of], dtype=np.int64)
        pieces = np.zeros((len(pieces_of), int(sizes.max(initial=PIECE))), dtype=np.uint32)
        for k, x in enumerate(pieces_of):
            pieces[k, : len(x)] = x
        shift = np.full(1 << TABLE_BITS, PIECE - BLOCK + 1, dtype=np.int8)
        for end in range(BLOCK, PIECE + 1):
            np.minimum.at(shift, _slot([pieces[:, end - BLOCK + k] for k in range(BLOCK)]), PIECE - end)
        last = _slot([pieces[:, PIECE - BLOCK + k] for k in range(BLOCK)])
        order = np.argsort(last, kind="stable")
        bucket_at = np.searchsorted(last[order], np.arange((1 << TABLE_BITS) + 1))
        return cls(ids, passages, stretches, needed, hashes, shift, bucket_at, order, pieces, _hash([pieces[:, k] for k in range(3)]), sizes, np.array(owner, dtype=np.int64))

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and pieces of all occurrences in one text array. Many heads walk at once, each over its own part."""
        n = len(codes)
        if n < PIECE or not len(self.heads):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        end = np.arange(0, n - PIECE + 1, HEAD) + PIECE  # one past the window
        stop = np.minimum(end + HEAD, n + 1)
        where, which = [], []
        while len(end):
            slot = _slot([codes[end - BLOCK + k] for k in range(BLOCK)])
            move = self.shift[slot]
            hit = np.flatnonzero(move == 0)
            if len(hit):
                at, s = end[hit] - PIECE, slot[hit]
                count = self.bucket_at[s + 1] - self.bucket_at[s]
                row = np.repeat(np.arange(len(hit)), count)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                piece = self.bucket[self.bucket_at[s][row] + inner]
                head = _hash([codes[at + k] for k in range(3)])
                same = head[row] == self.head_hash[piece]
                row, piece = row[same], piece[same]
                same = at[row] + self.sizes[piece] <= n
                row, piece = row[same], piece[same]
                for k in range(self.heads.shape[1]):
                    if not len(row):
                        break
                    same = (codes[np.minimum(at[row] + k, n - 1)] == self.heads[piece, k]) | (k >= self.sizes[piece])
                    row, piece = row[same], piece[same]
                where.append(at[row])
                which.append(piece)
            end = end + np.maximum(move, 1)
            on = end < stop
            end, stop = end[on], stop[on]
        return (np.concatenate(where), np.concatenate(which)) if where else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))

    def covered_share(self, item: int, found: np.ndarray) -> float:
        """The covered share if the item's windows of ``found`` stand in a text."""
        n, least = len(self.passages[item]), self.stretches[item]
        ends = np.zeros(n + 1, dtype=np.int64)
        ends[: n - least + 1] += found
        ends[least:] -= found
        return float((np.cumsum(ends[:-1]) > 0).sum()) / n

    def coverage(self, item: int, text: str) -> float:
        """The share of the passage standing in the text in stretches of the least length, by direct comparison."""
        p, least = self.passages[item], self.stretches[item]
        windows: dict[str, list[int]] = {}
        for i in range(len(p) - least + 1):
            windows.setdefault(p[i : i + least], []).append(i)
        covered = np.zeros(len(p) + 1, dtype=np.int64)
        for j in range(len(text) - least + 1):
            for i in windows.pop(text[j : j + least], ()):
                covered[i] += 1
                covered[i + least if i + least < len(covered) else -1] -= 1
            if not windows:
                break
        return float((np.cumsum(covered[:-1]) > 0).sum()) / len(p)


def _search(searcher: Searcher, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                codes, starts = folded(batch.column("text"))
                at, piece = searcher.occurrences(codes)
                row = np.searchsorted(starts, at, side="right") - 1
                inside = at + searcher.sizes[piece] <= starts[row + 1]
                row, piece = row[inside], piece[inside]
                pairs = np.unique(np.stack([row, piece], axis=1), axis=0)
                ids, found = batch.column("doc_id").to_pylist(), []
                counts = Counter(zip(pairs[:, 0].tolist(), searcher.owner[pairs[:, 1]].tolist()))
                sums, known, known_row = prefix_sums(codes) if counts else None, {}, -1
                for (r, item), n in sorted(counts.items()):
                    if n < searcher.needed[item] or ids[r] is None:
                        continue
                    if r != known_row:
                        known, known_row = {}, r
                    least = searcher.stretches[item]
                    if least not in known:
                        known[least] = window_hashes(sums, starts[r], starts[r + 1], least)
                    if searcher.covered_share(item, np.isin(searcher.window_hashes[item], known[least])) < coverage:
                        continue
                    share = searcher.coverage(item, text_of(codes[starts[r] : starts[r + 1]]))
                    if share >= coverage:
                        found.append((searcher.ids[item], ids[r], share))
                item_ids, doc_ids, shares = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(item_ids, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(shares, pa.float64())], ["item_id", "doc_id", "coverage"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, coverage: float = COVERAGE, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """Item, document and covered share wherever enough of an item's passage stands in a document's text.

    Counted are letters and digits alone, whatever their case, width or spacing, in stretches of at least ``STRETCH``.
    The items are held in tables of every worker, ``items_at_once`` to a pass; larger sets take several passes over the
    corpus. Null texts, passages and ids give no row; a passage shorter than its stretch cannot leak; texts of any
    length are searched whole; repeated documents or items with the same ids give one row.
    """
    wanted = items.select("item_id", "passage", "lang").dropDuplicates()
    n = wanted.count()
    corpus = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    passes = max(1, math.ceil(n / items_at_once))
    out = None
    for k in range(passes):
        part = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else wanted
        searcher = Searcher.of([(r["item_id"], r["passage"], r["lang"]) for r in part.toLocalIterator()], coverage)
        found = corpus.mapInArrow(_search(searcher, coverage), "item_id long, doc_id long, coverage double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("item_id", "doc_id").agg(F.max("coverage").alias("coverage"))
