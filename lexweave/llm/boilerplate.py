"""Main body of web pages: flat text blocks classified by a decision tree over words and link density of neighbours."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.codes import SPECIAL, _fold_table, code_points, slices
from lexweave.llm.hyperminhash import mix, shingle_hashes
from lexweave.session import materialize

LABELLED = Path(__file__).with_name("resources") / "labelled_blocks.jsonl"  # 1,041 blocks of 120 pages, labelled by hand
FOLDS = 6
DEPTH, LEAF = 7, 3
WIDE_RUN, NARROW_RUN = 2, 5  # characters of a run that starts with an ideograph or kana, and of any other
WIDE = 0x3000
STEP = 0.75  # wording is rounded to this, so that the tree cannot follow single runs
PRIOR = 3.0  # runs of no meaning added to each block
SALTS = 16  # parts in which the blocks with one line of a site are joined
MIN_PAGES = 2  # pages of a site from which a line counts as shared
FEATURES = ("words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "wording", "site_share")
OWN = ("words", "link_density")

_CLIPPED = re.compile(r"(…|\.\.\.)\s*\Z", re.M)

GUARD = "\x01"  # stands before and after each text
_END = "。！？!?.；;।؟:："  # signs that end a sentence or open a list
_CLOSERS = "”\"’»」』)）]"
_PATH, _BAR = ">»›/", "|｜"
OTHER, SPACE, IDEOGRAPH, LETTER, DIGIT = range(5)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point of the first plane, and once for all beyond it."""
    out = np.zeros(0x10001, dtype=np.uint8)
    for o in range(0x10000):
        c = chr(o)
        kind = unicodedata.category(c)
        if c.isspace() or c == GUARD:
            out[o] = SPACE
        elif 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF:
            out[o] = IDEOGRAPH
        elif kind[0] in "LM":
            out[o] = LETTER
        elif kind[0] == "N":
            out[o] = DIGIT
    out[0x10000] = LETTER
    return out


@functools.cache
def _among(signs: str) -> np.ndarray:
    out = np.zeros(0x10001, dtype=bool)
    out[[ord(c) for c in signs]] = True
    return out


@dataclass
class Texts:
    """Texts as one array of code points, with case, width and the values of digits folded."""

    codes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        codes, starts = code_points(pc.binary_join_element_wise(GUARD, pc.fill_null(column, ""), GUARD, ""))
        c = codes.astype(np.int64)
        c[(c >= 0xFF01) & (c <= 0xFF5E)] -= 0xFEE0
        c[(c >= 0x41) & (c <= 0x5A)] += 0x20
        c[(c >= 0x30) & (c <= 0x39)] = 0x30
        return cls(c, starts)

    def form(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, link density and number of links of each text.

        Two ideographs or kana make a word. The given densities and counts mislead, so links are told by their form: a
        line that ends with no mark and no number, or is clipped, is an anchor, and signs of a path or a bar part it
        into several; clipped text has a second one, to the page it is taken from. The density is the share of words
        that stand in such lines.
        """
        c, n = np.minimum(self.codes, 0x10000), len(self.starts) - 1
        kind = _classes()[c]
        before = np.concatenate(([SPACE], kind[:-1]))
        words = (kind == IDEOGRAPH) / 2 + ((kind == LETTER) & (before != LETTER)) + ((kind == DIGIT) & (before != DIGIT))
        first = np.zeros(len(c), dtype=bool)
        first[1:] = c[:-1] == 0x0A
        first[self.starts[:-1]] = True
        line = np.flatnonzero(first)
        if not len(line):
            return np.zeros(n), np.zeros(n), np.zeros(n)
        place = np.arange(len(c))
        last = np.maximum.reduceat(np.where(kind != SPACE, place, -1), line)
        core = np.maximum.reduceat(np.where((kind != SPACE) & ~_among(_CLOSERS)[c], place, -1), line)
        dots = (c[last] == ord(".")) & (c[last - 1] == ord(".")) & (c[last - 2] == ord("."))
        cut = (last >= 0) & ((c[last] == ord("…")) | dots)
        ended = (core >= 0) & _among(_END)[c[core]] | (kind[last] == DIGIT)
        anchor = (last >= 0) & (cut | ~ended)
        spaced = np.zeros(len(c), dtype=bool)
        spaced[1:-1] = (kind[:-2] == SPACE) & (kind[2:] == SPACE)
        signs = (_among(_PATH)[c] & spaced) | _among(_BAR)[c]
        row = np.searchsorted(self.starts, line, side="right") - 1
        in_line = np.add.reduceat(words, line)
        whole, linked = np.bincount(row, in_line, n), np.bincount(row, in_line * anchor, n)
        links = np.bincount(row, anchor * (1 + np.add.reduceat(signs.astype(np.int64), line) + cut), n)
        return whole, np.divide(linked, whole, out=np.zeros(n), where=whole > 0), links

    def line_keys(self) -> np.ndarray:
        """A hash of each text's letters and numbers, folded, each number as one digit."""
        folded = _fold_table()[np.minimum(self.codes, 0x10000)].astype(np.int64)
        folded = np.where(folded == SPECIAL, self.codes, folded)
        at = np.flatnonzero(folded)
        row, code = np.searchsorted(self.starts, at, side="right") - 1, folded[at]
        digit = _classes()[np.minimum(code, 0x10000)] == DIGIT
        again = np.zeros(len(at), dtype=bool)
        again[1:] = digit[1:] & digit[:-1] & (row[1:] == row[:-1])
        row, code = row[~again], np.where(digit, 0x30, code)[~again]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        h = mix((place.astype(np.uint64) << np.uint64(21)) | code.astype(np.uint64))
        ends = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h, dtype=np.uint64)))
        bounds = np.searchsorted(row, np.arange(len(self.starts)))
        return (ends[bounds[1:]] - ends[bounds[:-1]]).view(np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character runs of each text with the text's number."""
        plain, wide = self.codes.astype(np.uint32), self.codes >= WIDE
        hashes = np.zeros(len(plain), dtype=np.uint64)
        for size, which in ((WIDE_RUN, wide), (NARROW_RUN, ~wide)):
            got = shingle_hashes(plain, size)
            at = np.flatnonzero(which[: len(got)])
            hashes[at] = got[at]
        owner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        inside = np.arange(len(plain)) + np.where(wide, WIDE_RUN, NARROW_RUN) <= self.starts[owner + 1]
        return hashes[inside], owner[inside]


@dataclass
class Wording:
    """Log odds of character runs for main text, sorted by hash."""

    keys: np.ndarray
    odds: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], main: np.ndarray, links: np.ndarray) -> "Wording":
        """Runs are counted once a block; those of one block alone are left out.

        Furniture of several links or clipped text counts for neither side: its words are titles and main text, and
        its form tells it apart.
        """
        hashes, owner = Texts.of(pa.array(texts, pa.string())).runs()
        told = main | ((links < 2) & np.array([not _CLIPPED.search(t) for t in texts], dtype=bool))
        seen = np.unique(np.stack([hashes, owner.astype(np.uint64)], axis=1)[told[owner]], axis=0)
        keys, place = np.unique(seen[:, 0], return_inverse=True)
        of_main = main[seen[:, 1].astype(np.int64)]
        good, bad = np.bincount(place, of_main, len(keys)), np.bincount(place, ~of_main, len(keys))
        odds = np.log((good + 0.5) / (main.sum() + 1)) - np.log((bad + 0.5) / ((told & ~main).sum() + 1))
        often = good + bad > 1
        return cls(keys[often], odds[often])

    def score(self, texts: Texts) -> np.ndarray:
        """Mean log odds of a text's known runs, in steps; 0 for a text without any."""
        n = len(texts.starts) - 1
        if not len(self.keys):
            return np.zeros(n)
        hashes, owner = texts.runs()
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        sums, m = np.bincount(owner[known], self.odds[at[known]], n), np.bincount(owner[known], minlength=n)
        return np.round(sums / (m + PRIOR) / STEP) * STEP


@dataclass
class Node:
    share: float  # of main blocks
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    def splits(self) -> list[str]:
        """Features of the splits, from the root down."""
        return [] if self.feature < 0 else [FEATURES[self.feature], *self.low.splits(), *self.high.splits()]


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> Node:
    """A binary tree by Gini impurity; missing values are -1."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * leaf or node.share in (0.0, 1.0):
        return node
    best = (2 * node.share * (1 - node.share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.cumsum(t)[:-1]
        n = np.arange(1, len(t))
        right, m = t.sum() - left, len(t) - n
        gini = 2 * (left * (n - left) / n + right * (m - right) / m)
        gini[(v[1:] == v[:-1]) | (n < leaf) | (m < leaf)] = np.inf
        k = int(np.argmin(gini))
        if gini[k] < best[0]:
            best = (gini[k], f, (v[k] + v[k + 1]) / 2)
    if best[1] < 0:
        return node
    low = x[:, best[1]] <= best[2]
    node.feature, node.cut = best[1], float(best[2])
    node.low, node.high = grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf)
    return node


def as_column(node: Node) -> Column:
    """The tree as one nested conditional over the feature columns."""
    if node.feature < 0:
        return F.lit(node.share)
    return F.when(F.col(FEATURES[node.feature]) <= node.cut, as_column(node.low)).otherwise(as_column(node.high))


def with_neighbours(blocks: DataFrame) -> DataFrame:
    """Words and link density of the block before and after on the page; -1 where there is none."""
    w = Window.partitionBy("page_id").orderBy("candidate_no")
    near = {f"{name}_{short}": F.coalesce(f(own).over(w), F.lit(-1.0)) for name, f in (("prev", F.lag), ("next", F.lead)) for short, own in (("words", "words"), ("density", "link_density"))}
    return blocks.withColumns(near)


@functools.cache
def model(labelled: str = str(LABELLED)) -> tuple[Wording, Node]:
    """Wording and tree of the labelled blocks, which are a small table by design.

    The tree learns from wording scores that each page gets from odds fitted on the other pages.
    """
    rows = [json.loads(line) for line in Path(labelled).read_text(encoding="utf-8").splitlines()]
    rows.sort(key=lambda r: (r["table"], r["page"], r["no"]))
    pages = {key: k for k, key in enumerate(dict.fromkeys((r["table"], r["page"]) for r in rows))}
    page = np.array([pages[r["table"], r["page"]] for r in rows])
    column, main = [r["text"] or "" for r in rows], np.array([r["main"] for r in rows], dtype=bool)
    words, density, links = Texts.of(pa.array(column, pa.string())).form()
    wording = np.zeros(len(rows))
    for fold in range(FOLDS):
        out = page % FOLDS == fold
        fitted = Wording.fit([t for t, o in zip(column, out) if not o], main[~out], links[~out])
        wording[out] = fitted.score(Texts.of(pa.array([t for t, o in zip(column, out) if o], pa.string())))
    same = page[1:] == page[:-1]
    before = lambda v: np.concatenate(([-1.0], np.where(same, v[:-1], -1.0)))
    after = lambda v: np.concatenate((np.where(same, v[1:], -1.0), [-1.0]))
    known = {"words": words, "link_density": density, "prev_words": before(words), "prev_density": before(density), "next_words": after(words), "next_density": after(density), "wording": wording, "site_share": np.array([r["site_share"] for r in rows])}
    return Wording.fit(column, main, links), grow(np.stack([known[f] for f in FEATURES], axis=1), main.astype(float))


def _read(wording: Wording):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole, "text")):
            texts = Texts.of(batch.column("text"))
            words, density, _ = texts.form()
            found = [pa.array(texts.line_keys(), pa.int64()), *(pa.array(x, pa.float64()) for x in (words, density, wording.score(texts)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "candidate_no", "site")), *found], ["page_id", "candidate_no", "site", "line_key", *OWN, "wording"])

    return run


def shared_lines(blocks: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Site and line key of texts on several pages of a site, with the share of its other pages that hold them."""
    pages = blocks.select("site", "page_id").distinct().groupBy("site").agg(F.count("*").alias("n_site"))
    lines = blocks.select("site", "line_key", "page_id").distinct().groupBy("site", "line_key").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    return lines.join(pages, "site").select("site", "line_key", ((F.col("n_pages") - 1) / F.col("n_site")).alias("site_share"))


def block_features(candidates: DataFrame, wording: Wording, salts: int = SALTS) -> DataFrame:
    """All ``FEATURES`` of each block. A page's blocks meet in one task, for a page is a bounded thing."""
    rows = candidates.select(F.col("page_id").cast("long"), F.col("candidate_no").cast("int"), F.coalesce(F.col("site").cast("string"), F.lit("")).alias("site"), F.col("text").cast("string"), F.col("fetched_at"))
    rows = rows.filter(F.col("page_id").isNotNull() & F.col("candidate_no").isNotNull()).repartition("page_id")
    newest = Window.partitionBy("page_id", "candidate_no").orderBy(F.col("fetched_at").desc_nulls_last(), F.col("text").desc_nulls_last())
    latest = rows.withColumn("n", F.row_number().over(newest)).filter("n = 1")
    read = latest.select("page_id", "candidate_no", "site", "text").mapInArrow(_read(wording), "page_id long, candidate_no int, site string, line_key long, words double, link_density double, wording double")
    own = materialize(read)  # read three times
    often = shared_lines(own).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    joined = salted.join(often, ["site", "line_key", "salt"], "left").select("page_id", "candidate_no", *OWN, "wording", F.coalesce("site_share", F.lit(0.0)).alias("site_share"))
    return with_neighbours(joined)


def main_blocks(candidates: DataFrame, labelled: str = str(LABELLED)) -> DataFrame:
    """``page_id``, ``candidate_no`` and the tree's ``share`` of main text for every block, kept where it is over a half.

    The tree runs inside the JVM over features of the block and its neighbours. Tags, classes and the given counts and
    densities are not used, for they mislead. Null and empty texts are no main block; blocks without a page or number
    are left out; of repeated rows the latest counts, ties by the greater text; a page of nothing but furniture has no
    row.
    """
    wording, tree = model(labelled)
    return block_features(candidates, wording).filter(F.col("words") > 0).select("page_id", "candidate_no", as_column(tree).alias("share")).filter(F.col("share") > 0.5)
