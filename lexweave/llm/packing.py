"""Filling fixed-capacity containers: context-size tiers, each packed by best fit over the histogram of sizes."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.tokens import TOKENIZER, count_tokens
from lexweave.session import materialize

TIERS = 4  # context-size tiers: windows of the capacity and its halves
STEP_CONTAINERS = 32  # containers of one step group
ROWS_PER_RANK_SLICE = 500_000


@dataclass
class Tier:
    """The windows of one context size; those with equal room are kept as ranges (start, number) by their gap."""

    window: int
    windows: int = 0
    gaps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    open_gaps: list[int] = field(default_factory=list)

    def free(self, gap: int, start: int, n: int) -> None:
        if n:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.open_gaps, gap)
            self.gaps[gap].append((start, n))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """A range of windows with the least gap that holds ``size``."""
        k = bisect.bisect_left(self.open_gaps, size)
        if k == len(self.open_gaps):
            return None
        gap = self.open_gaps[k]
        start, n = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap]
            del self.open_gaps[k]
        return gap, start, n

    def open(self, size: int, count: int) -> tuple[int, int, int]:
        """New windows for ``count`` items."""
        n = math.ceil(count / (self.window // size))
        self.windows += n
        return self.window, self.windows - n, n


@dataclass
class Packing:
    """Where the k-th item of each size goes.

    Sizes are whole numbers up to the capacity, so all a packing needs of the items is how many there are of each
    size: at most ``capacity`` numbers, whatever the corpus. Windows of equal contents are handled as one range.
    ``places[size]`` lists (first ordinal, tier, first window, items a window): the items from that ordinal on go to
    that window and those after it. A container holds one window of the longest tier, two of the next, four of the
    one after it and so on, all of one tier, so every container is of the capacity.
    """

    capacity: int
    tiers: list[Tier] = field(default_factory=list)
    places: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    placed: dict[int, int] = field(default_factory=dict)

    def _put(self, t: int, size: int, count: int, room: tuple[int, int, int]) -> int:
        """Put up to ``count`` items into a range of windows of one gap, as many into each as fit; items put."""
        gap, start, n = room
        tier, at, per = self.tiers[t], self.placed.get(size, 0), gap // size
        full = min(n, count // per)
        rest = count - full * per if full < n else 0
        if full:
            self.places.setdefault(size, []).append((at, t, start, per))
            tier.free(gap - per * size, start, full)
        if rest:
            self.places.setdefault(size, []).append((at + full * per, t, start + full, rest))
            tier.free(gap - rest * size, start + full, 1)
        tier.free(gap, start + full + bool(rest), n - full - bool(rest))
        self.placed[size] = at + full * per + rest
        return full * per + rest

    @classmethod
    def of(cls, counts: dict[int, int], capacity: int, tiers: int = TIERS) -> "Packing":
        """Routes each size to the shortest window that holds it, packs tier by tier and fills gaps from below.

        From the longest windows to the shortest: the tier's items are packed into windows of its own by best fit, from
        large to small; then the gaps of its windows are filled with items of the shorter tiers, again from large to
        small, each into the least gap that holds it. What no gap took is packed when its own tier's turn comes.
        """
        out = cls(capacity, [Tier(capacity >> t) for t in range(tiers) if capacity >> t])
        left = {s: n for s, n in counts.items() if s > 0 and n > 0}
        for t, tier in enumerate(out.tiers):
            below = out.tiers[t + 1].window if t + 1 < len(out.tiers) else 0
            for size in sorted(left, reverse=True):
                while left[size]:
                    room = tier.take(size)
                    if room is None and size <= below:
                        break  # an item of a shorter tier never opens a window of this one
                    left[size] -= out._put(t, size, left[size], room or tier.open(size, left[size]))
            left = {s: n for s, n in left.items() if n}
        return out

    def containers(self, t: int) -> int:
        return math.ceil(self.tiers[t].windows / (1 << t))

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of windows: their starts, numbered through all tiers, their rank by gap within the tier, their tier.

        The rank deals the windows of a tier to its containers, so the loads of containers differ little.
        """
        start, rank, owner, before = [], [], [], 0
        for t, tier in enumerate(self.tiers):
            at = 0
            for gap in tier.open_gaps:
                for first, n in sorted(tier.gaps[gap]):
                    start.append(before + first)
                    rank.append(at)
                    owner.append(t)
                    at += n
            before += tier.windows
        order = np.argsort(np.array(start, dtype=np.int64))
        return tuple(np.array(x, dtype=np.int64)[order] for x in (start, rank, owner))


def _snake(rank: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Deals ranks to ``n`` places there and back, so that each place gets high and low ranks alike."""
    turn, at = rank // n, rank % n
    return np.where(turn % 2 == 0, at, n - 1 - at)


def _place(packing: Packing, per_step: int):
    sizes = np.array(sorted(packing.places), dtype=np.int64)
    rows = [(k, *p) for k, s in enumerate(sizes.tolist()) for p in packing.places[s]]
    key, first, owner, base, each = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    span = int(first.max(initial=0)) + 1
    windows = np.array([t.windows for t in packing.tiers], dtype=np.int64)
    before = np.cumsum(windows) - windows
    dealt = np.array([packing.containers(t) for t in range(len(packing.tiers))], dtype=np.int64)
    first_container, n_windows = np.cumsum(dealt) - dealt, int(windows.sum())
    n_steps = max(1, math.ceil(int(dealt.sum()) / per_step))
    range_start, range_rank, range_tier = packing.layout()
    lengths = np.array([t.window for t in packing.tiers], dtype=np.int64)

    def place(size: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        s, o = size.to_numpy(dtype=np.int64), ordinal.to_numpy(dtype=np.int64)
        window = o % max(1, n_windows)  # of items without tokens
        full = np.flatnonzero(s)
        if len(full):
            k = np.searchsorted(sizes, s[full])
            j = np.searchsorted(key * span + first, k * span + np.minimum(o[full], span - 1), side="right") - 1
            window[full] = before[owner[j]] + base[j] + (o[full] - first[j]) // each[j]
        tier, container = np.zeros(len(s), dtype=np.int64), np.zeros(len(s), dtype=np.int64)
        if n_windows:
            r = np.searchsorted(range_start, window, side="right") - 1
            tier = range_tier[r]
            container = first_container[tier] + _snake(range_rank[r] + window - range_start[r], np.maximum(dealt[tier], 1))
        return pd.DataFrame({"tier": lengths[tier], "window_id": window, "container_id": container, "step_group": _snake(container, np.full(len(s), n_steps))})

    return place


def ordinals(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` numbered from 0 within each size; a size of any number of rows is ranked in bounded slices."""
    slices = max(1, math.ceil(n / ROWS_PER_RANK_SLICE))
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("n_tokens", "slice").agg(F.count("*").alias("m")).select("n_tokens", "slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "slice").orderBy("doc_id", "piece_no")))
    return ranked.join(offsets, ["n_tokens", "slice"]).withColumn("ordinal", F.col("offset") + F.col("rank") - 1).drop("slice", "rank", "offset")


def pack_sizes(sizes: DataFrame, capacity: int, per_step: int = STEP_CONTAINERS, tiers: int = TIERS) -> DataFrame:
    """Containers of items given as ``doc_id``, ``n_tokens``; one row a piece.

    An item above the capacity is cut into full pieces and a rest; no other item is split. ``tier`` is the length of
    the window a piece lies in, ``window_id`` that window, ``container_id`` the container of the whole capacity that
    holds windows of one tier. Items of no tokens are spread over the windows. Repeated rows are items of their own;
    null ids are packed like any other.
    """
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0))
    pieces = (
        sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .select("doc_id", F.col("piece_no").cast("int"), (F.col("piece_no") * capacity).alias("token_start"), F.least(F.col("n_tokens") - F.col("piece_no") * capacity, F.lit(capacity)).alias("n_tokens"))
    )
    counts = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    place = F.pandas_udf(_place(Packing.of(counts, capacity, tiers), per_step), "tier long, window_id long, container_id long, step_group long")
    numbered = ordinals(pieces, sum(counts.values()))
    return numbered.withColumn("at", place("n_tokens", "ordinal")).select("doc_id", "piece_no", "token_start", "n_tokens", "at.tier", "at.window_id", "at.container_id", "at.step_group")


def pack_documents(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, per_step: int = STEP_CONTAINERS, tiers: int = TIERS) -> DataFrame:
    """The window, container, step group and context tier of every document by its size in tokens.

    The token counts are written once to the shared folder, for the histogram and the placement read them both.
    """
    return pack_sizes(materialize(count_tokens(documents, tokenizer)), capacity, per_step, tiers)


def packing_summary(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, windows, pieces, tokens, greatest load of a container and of a window, and unused share by tier."""
    windows = packed.groupBy("tier", "container_id", "window_id").agg(F.sum("n_tokens").alias("load"), F.count("*").alias("pieces"))
    loads = windows.groupBy("tier", "container_id").agg(F.sum("load").alias("load"), F.max("load").alias("window_load"), F.sum("pieces").alias("pieces"), F.count("*").alias("windows"))
    return loads.groupBy("tier").agg(
        F.count("*").alias("n_containers"), F.sum("windows").alias("n_windows"), F.sum("pieces").alias("n_pieces"), F.sum("load").alias("n_tokens"),
        F.max("load").alias("max_load"), F.max("window_load").alias("max_window_load"), F.round(1 - F.sum("load") / (F.count("*") * capacity), 6).alias("unused"),
    )


def packing_checks(packed: DataFrame, documents: DataFrame, capacity: int, unused: float = 0.02, spread: float = 0.1) -> DataFrame:
    """Named counts that a valid packing of ``documents`` (doc_id) must show, one row each.

    Documents placed (their ids are unique); documents cut although they fit, or whose pieces are not full, overlap or
    leave a hole; pieces, containers and windows over their size; containers whose windows are of several tiers or
    too many; whether the unused share and the spread of step groups' mean loads exceed their bounds; documents lost.
    """
    windows = packed.groupBy("container_id", "window_id").agg(F.sum("n_tokens").alias("load"), F.min("tier").alias("low"), F.max("tier").alias("high"))
    containers = windows.groupBy("container_id").agg(F.sum("load").alias("load"), F.sum((F.col("load") > F.col("low")).cast("long")).alias("over"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("windows"))
    steps = packed.groupBy("step_group").agg(F.sum("n_tokens").alias("load"), F.countDistinct("container_id").alias("n"))
    items = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("size"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.max("n_tokens").alias("most"))
    broken = (F.col("n") != F.col("last") + 1) | (F.col("size") != F.col("end")) | (F.col("last") > 0) & (F.col("size") <= F.col("last") * capacity)
    whole = items.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum(broken.cast("long")), F.lit(0)).alias("broken_documents"), F.coalesce(F.sum((F.col("most") > capacity).cast("long")), F.lit(0)).alias("oversized_pieces")
    )
    held = containers.agg(
        F.coalesce(F.sum((F.col("load") > capacity).cast("long")), F.lit(0)).alias("containers_over"), F.coalesce(F.sum("over"), F.lit(0)).alias("windows_over"),
        F.coalesce(F.sum(((F.col("low") != F.col("high")) | (F.col("windows") * F.col("low") > capacity)).cast("long")), F.lit(0)).alias("mixed_containers"),
        (F.coalesce(1 - F.sum("load") / (F.count("*") * capacity), F.lit(0.0)) > unused).cast("long").alias("much_unused"),
    )
    balance = steps.agg((F.coalesce(F.max(F.col("load") / F.col("n")) / F.avg(F.col("load") / F.col("n")) - 1, F.lit(0.0)) > spread).cast("long").alias("unbalanced_steps"))
    lost = documents.select("doc_id").distinct().join(packed.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("lost_documents"))
    names = [*whole.columns, *held.columns, *balance.columns, *lost.columns]
    row = whole.crossJoin(held).crossJoin(balance).crossJoin(lost)  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).cast("long").alias("n")) for n in names])).alias("c")).select("c.check_name", "c.n")
