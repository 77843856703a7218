"""Sentence boundaries of texts in many scripts by a hidden-event n-gram language model.

Between two tokens the model may insert the event <S>: after a closing mark, or, in Thai, which has none, at a space
not next to a number. A line end (in ``wrapped`` layout: a blank line) is an event for certain. The joint probability
of a gap is P(event | left word, mark) * P(right word | event, left word); gaps one word apart depend on each other,
for the history of the second holds the event of the first, and are decided by forward-backward over the run of gaps.
The counts come from all texts, whose certain ends and starts are the labels, refined by expectation maximisation. Marks
that do little else than end sentences start with a prior rate worth some hundred gaps, which counts can overrule.

A text is parsed once. Its gaps are written to the shared folder beside the counts, and the posteriors are then taken
once for each distinct context of a batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize

ROUNDS = 7
FINAL_WEIGHT = 0.3  # of a block end among the gaps inside blocks
ANCHOR = 0.8  # weight of the rates that block ends give to shapes of left words, against those of a round
OTHER_RATE = 0.6  # of the gaps at the other marks, before any count
RARE = 4  # words seen less often are known by their shape
FLUSH = 200_000  # keys that a task counts before it passes them on
UNIT = 1_000_000  # expected counts are summed in millionths, so their sums do not depend on the order
COUNTS = "kind string, script string, key string, n long"
_PART, _GAP_END = "\x1f", "\x1e"  # white space to ``re``, so in no word or mark

_CLOSE = "”\"“»」』’')）\\]】〉》"
_OPENED = {"”": "“„", "“": "„", "»": "«", "」": "「", "』": "『"}
_GAP = re.compile(rf"(?:[。！？｡।॥؟۔!?.．…]+)(?:[ \u00a0\u202f]?»)?[{_CLOSE}]*|(?<=[\u0e00-๏]) +(?=[^\s\d])|(?<=[^\s\d.]) +(?=[\u0e00-๏])")
_QUOTE = re.compile("[“”„«»「」『』\"]")
_LIST_MARK = re.compile(r"(?:[（(【\[]?(?:\d{1,4}|[०-९]{1,4}|[٠-٩]{1,4}|[一二三四五六七八九十百零〇]{1,5}|[a-zA-Z]|[ivxIVX]{1,5})(?:[.．、。]|[)）】\]][.．、]?))+|[-—–•·*]+")
_FINAL = re.compile(rf"([。！？｡।॥؟۔!?.．…]+)([ \u00a0\u202f]?»)?([{_CLOSE}]*)\Z")
_INNER = re.compile(r"(?<=[^\s.!?。！？।؟:»”\"«“„…]) ([^\W\d_]+(?:[’'][^\W\d_]+)?|\d+)")
_WORD = re.compile(r"[^\s(（«“\"„「『¿¡\[【《]+\Z")
_NEXT = re.compile(r"\s*([«“\"„「『¿¡(（\[【《‘]*)\s*(\d+|[a-zA-ZÀ-ɏ]+(?:[’'][a-zA-ZÀ-ɏ]+)?\.?|[Ѐ-ӿ]+|[\u0600-ۿ]+|[\u0900-ॿ]+|[\u0e00-\u0e7f]{1,3}|[㐀-鿿\u3040-ヿ]|\S)")
_CJK = re.compile(r"[\u3040-ヿ㐀-鿿豈-\ufaff]")
_LETTER = re.compile(r"[^\W\d_]")
_FULL = "。！？｡"
MARKS = "。！？｡।॥؟۔!? "  # fixed values: marks, and the space of Thai, that do little else than end sentences outside quotations
MARK_RATE, MARK_GAPS = 0.98, 600  # their rate before any count, and the number of gaps after one word that it is worth
_THAI = chr(0x0E00 >> 7)


def blocks_of(text: str, layout: str | None) -> Iterator[tuple[int, int]]:
    """Spans of text that no sentence crosses: lines, or paragraphs of a text broken at a fixed width."""
    pattern = r"(?:[^\n]|\n(?!\s*\n))+" if layout == "wrapped" else r"[^\n\u2028\u2029]+"
    for m in re.finditer(pattern, text):
        part = m.group()
        left = len(part) - len(part.lstrip())
        end = m.start() + len(part.rstrip())
        if m.start() + left < end:
            yield m.start() + left, end


def quoted(block: str) -> list[tuple[int, int]]:
    """Spans of outermost quotations, each from its opening to its closing mark; an unpaired mark opens none."""
    spans, stack, straight = [], [], None
    for m in _QUOTE.finditer(block):
        c, at = m.group(), m.start()
        if c == '"':
            if straight is None:
                straight = at
            else:
                spans.append((straight, at))
                straight = None
        elif c in _OPENED and any(o in _OPENED[c] for o, _ in stack):
            while stack:
                o, start = stack.pop()
                if o in _OPENED[c]:
                    spans.append((start, at))
                    break
        elif c in "“„«「『":
            stack.append((c, at))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s in spans:
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    return outer


def _shape(word: str) -> str:
    c = word[0]
    if c.isdigit():
        return "<num>"
    if len(word.rstrip(".")) == 1 and c.isupper():
        return "<initial>"
    if c.isupper():
        return "<upper>" if len(word) > 1 and word.isupper() else "<title>"
    if c.islower():
        return "<lower>"
    return "<cjk>" if _CJK.match(c) else "<letter>" if c.isalpha() else "<sign>"


def script_of(block: str) -> str:
    """The script of the first letter, by its place in the code chart."""
    m = _LETTER.search(block)
    c = m.group() if m else "a"
    return "cjk" if _CJK.match(c) else "latin" if c < "Ͱ" else chr(ord(c) >> 7)


Gap = tuple[int, str, str, str, bool]  # end in the block, left word, mark, right word, whether one word after the last gap


def gaps_of(block: str) -> list[Gap]:
    """Gaps of a block, without its end. Gaps within a quotation, within a list mark or next to a number are none."""
    out: list[Gap] = []
    spans = quoted(block) if _QUOTE.search(block) else []
    opening = _LIST_MARK.match(block)
    first = opening.end() if opening else 0
    n, last_end = len(block), -1
    for m in _GAP.finditer(block, first if opening and block[first - 1 : first] in ".．" else 0):
        start, end = m.span()
        c = block[start]
        if c == " ":
            if end >= n or last_end == start:
                continue
            out.append((start, "<letter>" if "\u0e00" <= block[start - 1] <= "\u0e7f" else _shape(block[start - 1]), " ", _NEXT.match(block, end).group(2)[:24], False))
            continue
        mark_end = start
        while mark_end < n and block[mark_end] in "。！？｡।॥؟۔!?.．…":
            mark_end += 1
        inside = None
        for a, b in spans:
            if a < start < b:
                inside = (a, b)
                break
        closers_end = mark_end
        tail = ""
        if inside:
            b = inside[1]
            if block[mark_end:b].strip(" \u00a0\u202f’'") == "":
                closers_end = b + 1
                tail = "q" if inside[0] == 0 or block[: inside[0]].rstrip()[-1:] in "。！？.!?” »»।؟」" else "Q"
            else:
                continue
        while closers_end < n and block[closers_end] in ")）]】’'" and (block[closers_end] not in "’'"):
            closers_end += 1
            tail += ")"
        if closers_end >= n:
            continue
        nxt = block[closers_end]
        last = block[mark_end - 1]
        if last not in _FULL and not nxt.isspace() and not (_CJK.match(nxt) and (c != "." or tail)):
            continue
        word = _WORD.search(block, max(0, start - 12), start)
        left = word.group() if word else "<none>"
        if _CJK.match(left[-1]):
            left = "<cjk>"
        mark = (c * min(3, mark_end - start) if c == "." else c) + tail
        r = _NEXT.match(block, closers_end)
        if not r:
            continue
        right = (("“" if r.group(1) else "") + r.group(2))[:24]
        near = bool(out) and out[-1][2] != " " and start - out[-1][0] < 16 and not block[out[-1][0] : start].strip().count(" ")
        out.append((closers_end, left, mark, right, near))
        last_end = closers_end
    return out


def _bare(word: str) -> str:
    return word.lstrip("“") or "“"


def _right_shape(word: str) -> str:
    """As ``_shape``, but a single capital is an initial only before a full stop."""
    bare = _bare(word)
    shape = _shape(bare)
    return "<title>" if shape == "<initial>" and bare[-1] != "." else shape


@dataclass
class Model:
    """Counts of the hidden-event model with words below ``RARE`` replaced by their shapes."""

    words: set[str] = field(default_factory=set)
    event: dict = field(default_factory=Counter)
    seen: dict = field(default_factory=Counter)
    start: dict = field(default_factory=Counter)
    follow: dict = field(default_factory=Counter)
    inner: dict = field(default_factory=Counter)
    after: dict = field(default_factory=Counter)
    base: dict = field(default_factory=Counter)
    memo: dict = field(default_factory=dict)

    def left(self, word: str) -> str:
        w = word.lower()
        return w if w in self.words and not (len(word) == 1 and word.isupper()) else _shape(word)

    def right(self, word: str) -> str:
        bare, shape = _bare(word), _right_shape(word)
        if shape == "<initial>":
            return word[: len(word) - len(bare)] + shape
        if shape == "<upper>" and word.capitalize() in self.words:
            return word.capitalize()
        return word if word in self.words else word[: len(word) - len(bare)] + shape

    def weights(self, script: str, key: str) -> tuple[float, float]:
        """Joint weights of no event and of an event at a gap, given its left word, mark and right word in one key.

        The right word of an event is drawn from the words that start blocks of the script, for these are a sample of
        all starts. Without an event its shape is drawn given the left word, and the word among those of that shape
        inside sentences and after marks without an event. Both back off to the right words of all gaps and starts.
        """
        got = self.memo.get((script, key))
        if got is None:
            if len(self.memo) >= FLUSH:
                self.memo.clear()
            left, mark, right = key.split(_PART)
            got = self.memo[script, key] = self.weigh(script, self.left(left), mark, self.right(right), _right_shape(right))
        return got

    def weigh(self, k: str, l: str, m: str, r: str, shape: str) -> tuple[float, float]:
        """``weights`` of a script, left word, mark, right word and its shape as the model knows them."""
        whole = (self.event[m] + 1) / (self.seen[m] + 2)
        prior = MARK_GAPS if m in MARKS else 0.0
        p = (self.event[l, m] + 2 * whole + prior * MARK_RATE) / (self.seen[l, m] + 2 + prior)
        p = min(max(p, 1e-4), 1 - 1e-4)
        among = (self.base[k, r] + 0.1) / (self.base[k, "shape", shape] + 2)

        def word(counts: dict) -> float:
            return counts[k, r] / max(1.0, counts[k, "shape", shape])

        after_event = (self.start[k, "shape", shape] + 0.1) / (self.start[k] + 1.2) * (0.9 * word(self.start) + 0.1 * among)
        loose = (self.inner[k, "shape", shape] + 1) / (self.inner[k] + 12)
        # a script without a certain word inside sentences has nothing but guesses to tell how one goes on
        going_on = 0.45 * word(self.inner) + 0.45 * word(self.after) + 0.1 * among if self.inner[k] else among
        after_none = (self.follow[l, m, shape] + 2 * loose) / (self.follow[l, m] + 2) * going_on
        ratio = min(max(after_event / after_none, 1e-4), 1e4)
        return 1 - p, p * ratio

    def run_posteriors(self, w: list[tuple[float, float]]) -> list[float]:
        """P(event) in a run of near gaps by forward-backward; an event right after an event is ``apart`` as likely."""
        return self.run_pairs(w)[0]

    def run_pairs(self, w: list[tuple[float, float]]) -> tuple[list[float], float, float]:
        """Posteriors of a run, its expected pairs of events, and those that the rates alone would give."""
        if len(w) == 1:
            a, b = w[0]
            return [b / (a + b)], 0.0, 0.0
        apart = (self.event["near"] + 1) / (self.seen["near"] + 2)
        forward = [w[0]]
        for a, b in w[1:]:
            f0, f1 = forward[-1]
            x, y = (f0 + f1) * a, (f0 + f1 * apart) * b
            forward.append((x / (x + y), y / (x + y)))
        backward = [(1.0, 1.0)]
        for a, b in reversed(w[1:]):
            b0, b1 = backward[-1]
            x, y = a * b0 + b * b1, a * b0 + apart * b * b1
            backward.append((x / (x + y), y / (x + y)))
        backward.reverse()
        out = [f1 * b1 / (f0 * b0 + f1 * b1) for (f0, f1), (b0, b1) in zip(forward, backward)]
        pairs = free = 0.0
        for k, (a, b) in enumerate(w[1:]):
            f0, f1 = forward[k]
            b0, b1 = backward[k + 1]
            both = f1 * apart * b * b1
            pairs += both / (both + f1 * a * b0 + f0 * (b * b1 + a * b0))
            free += out[k] * b / (a + b)
        return out, pairs, free

    def decide(self, scripts: list[str], keys: list[str]) -> np.ndarray:
        """Which of the gaps of a batch hold an event; a key that starts with the run's sign continues a run."""
        coded = pa.array(map(_GAP_END.join, zip(scripts, keys)), pa.string()).dictionary_encode()
        parts = [x.split(_GAP_END) for x in coded.dictionary.to_pylist()]  # script, nothing before a gap within a run, key
        known = np.array([self.weights(x[0], x[-1]) for x in parts]).reshape(-1, 2)
        near = np.array([len(x) > 2 for x in parts], dtype=bool)
        at = coded.indices.to_numpy()
        w, within = known[at], near[at]
        chosen = w[:, 1] > w[:, 0]
        if within.any():
            first = np.flatnonzero(within & ~np.concatenate(([False], within[:-1]))) - 1
            last = np.flatnonzero(within & ~np.concatenate((within[1:], [False])))
            for a, b in zip(first.tolist(), last.tolist()):
                chosen[a : b + 1] = np.array(self.run_posteriors([tuple(x) for x in w[a : b + 1]])) > 0.5
        return chosen

    def ends(self, text: str, layout: str | None) -> list[int]:
        """Offsets just after each sentence's last character."""
        parsed = parse(Counter(), text, layout)
        sure = np.array([k is None for k in parsed.keys], dtype=bool)
        sure[~sure] = self.decide([x for x, k in zip(parsed.scripts, parsed.keys) if k is not None], [k for k in parsed.keys if k is not None])
        return [e for e, keep in zip(parsed.ends, sure) if keep]


@dataclass
class Parsed:
    """Places where a sentence of a text may end, with the offset of what follows; block ends have no key."""

    ends: list[int] = field(default_factory=list)
    nexts: list[int] = field(default_factory=list)
    scripts: list[str] = field(default_factory=list)
    keys: list[str | None] = field(default_factory=list)
    start: int = 0


def _after(text: str, at: int) -> int:
    """The first character from ``at`` on that is no white space."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def parse(out: Counter, text: str, layout: str | None) -> Parsed:
    """The gaps of a text; adds its observations: words of gaps, ends and starts; ends, starts, inner words, runs."""
    words: list[str] = []
    got = Parsed()
    for a, b in blocks_of(text, layout):
        block = text[a:b]
        k, listed = script_of(block), _LIST_MARK.match(block)
        r = _NEXT.match(block, listed.end() if listed else 0)
        if r:
            w = (("“" if r.group(1) else "") + r.group(2))[:24]
            out["start", k, w] += 1
            words.append(w)
        m = _FINAL.search(block)
        if m:
            word = _WORD.search(block, max(0, m.start() - 12), m.start())
            left = word.group() if word else "<none>"
            if _CJK.match(left[-1]):
                left = "<cjk>"
            c, closers = m.group(1)[0], (m.group(2) or "").strip() + m.group(3)
            quoting = "Q" if _QUOTE.search(closers) else ""
            if quoting and (spans := quoted(block)) and spans[-1][0] == 0:
                quoting = "q"
            mark = (c * min(3, len(m.group(1))) if c == "." else c) + quoting + ")" * sum(x in ")）]】" for x in closers)
            out["final", k, left + _PART + mark] += 1
            words.append(left.lower())
        elif "\u0e00" <= block[-1] <= "\u0e7f":
            out["final", k, "<letter>" + _PART + " "] += 1
        if k != _THAI:  # its spaces are gaps
            out.update(zip(repeat("inner"), repeat(k), _INNER.findall(block)))
        runs: list[str] = []
        if not got.ends:
            got.start = a
        for end, left, mark, right, near in gaps_of(block):
            words += (left.lower(), right)
            gap = f"{left}{_PART}{mark}{_PART}{right}"
            if near:
                runs[-1] += _GAP_END + gap
            else:
                runs.append(gap)
            got.ends.append(a + end)
            got.nexts.append(_after(text, a + end))
            got.scripts.append(k)
            got.keys.append(_GAP_END + gap if near else gap)
        got.ends.append(b)
        got.nexts.append(_after(text, b))
        got.scripts.append(k)
        got.keys.append(None)
        if runs:
            out.update(zip(repeat("run"), repeat(k), runs))
    out.update(zip(repeat("word"), repeat(""), words))
    return got


def reduce_words(model: Model, out: Counter, kind: str, script: str, key: str, n: int) -> None:
    """Adds an observation with the words that the model does not know replaced by their shapes."""
    if kind == "run":
        gaps = (g.split(_PART) for g in key.split(_GAP_END))
        key = _GAP_END.join(_PART.join((model.left(l), m, model.right(r), _right_shape(r))) for l, m, r in gaps)
    elif kind == "final":
        l, m = key.split(_PART)
        key = model.left(l) + _PART + m
    else:
        key = key[:24]
        key = model.right(key) + _PART + (_right_shape(key) if kind == "start" else _shape(key))
    out[kind, script, key] += n


def total(out: Counter, kind: str, script: str, key: str, n: int) -> None:
    """Adds a reduced observation to the totals that no round changes."""
    if kind == "run":
        for l, m, r, shape in (g.split(_PART) for g in key.split(_GAP_END)):
            out["gap", script, l + _PART + m] += n
            out["base", script, r + _PART + shape] += n
        return
    out[kind, script, key] += n
    if kind == "start":
        out["base", script, key] += n


def expect(model: Model, out: Counter, kind: str, script: str, key: str, n: int) -> None:
    """Adds the expected counts, in millionths, of the gaps of a reduced run that hold no event."""
    gaps = []
    for g in key.split(_GAP_END):
        got = model.memo.get((script, g))
        if got is None:
            l, m, r, shape = g.split(_PART)
            if len(model.memo) >= FLUSH:
                model.memo.clear()
            keys = ("after", script, r + _PART + shape), ("follow", "", _PART.join((l, m, shape)))
            got = model.memo[script, g] = (model.weigh(script, l, m, r, shape), *keys)
        gaps.append(got)
    posteriors, pairs, free = model.run_pairs([g[0] for g in gaps])
    for (_, after, follow), p in zip(gaps, posteriors):
        none = round((1 - p) * n * UNIT)
        out[after] += none
        out[follow] += none
    if len(gaps) > 1:
        out["near", "", "pairs"] += round(pairs * n * UNIT)
        out["near", "", "free"] += round(free * n * UNIT)


def known_words(words: Iterable[str]) -> set[str]:
    return {w for w in words if not w[0].isdigit()} | {"<cjk>", "<none>"}


def refine(model: Model, totals: Iterable[tuple], expected: Callable[[Model], Iterable[tuple]], rounds: int = ROUNDS) -> Model:
    """The model with the counts of ``totals``, then of ``rounds`` rounds of expectation maximisation.

    Block ends with a mark are events for certain and block starts show what follows one; words after a plain space
    show what follows none. The events inside blocks are latent: each round takes their posteriors for counts.
    """
    group = lambda mark: mark if mark in MARKS else ""
    final, gap, n_final, n_gap = Counter(), Counter(), Counter(), Counter()
    for kind, k, key, n in totals:
        a, b = key.split(_PART)
        if kind == "final":
            final[a, b] += n
            n_final[group(b)] += n
        elif kind == "gap":
            gap[a, b] += n
            n_gap[group(b)] += n
        else:
            table = {"start": model.start, "inner": model.inner, "base": model.base}[kind]
            table[k] += n
            table[k, a] += n
            table[k, "shape", b] += n
    # the sentence ends of a mark that are block ends; marks of mixed use share one figure
    share = {m: (n_final[m] + 1) / (n_final[m] + 1 + (MARK_RATE if m else OTHER_RATE) * n) for m, n in n_gap.items()}
    first = {}
    for (a, b), n in gap.items():  # words that end no block end few sentences
        first[a, b] = min(0.97 * n, (1 if a[0] == "<" else 3) * (final[a, b] + 0.02) * (1 / share[group(b)] - 1))
    for key, n in sorted(gap.items()):
        for k in (key, key[1]):
            model.event[k] += first[key]
            model.seen[k] += n
    for _ in range(rounds):
        after, follow, near = Counter(), Counter(), Counter()
        for kind, k, key, n in sorted(expected(model)):
            if kind == "near":
                near[key] += n / UNIT
            elif kind == "after":
                r, shape = key.split(_PART)
                after[k, r] += n / UNIT
                after[k, "shape", shape] += n / UNIT
            else:
                l, m, shape = key.split(_PART)
                follow[l, m, shape] += n / UNIT
                follow[l, m] += n / UNIT
        event, seen = Counter(), Counter()
        for key in sorted(gap.keys() | final.keys()):  # certain events keep the rounds from drifting
            sure, told = FINAL_WEIGHT * final[key], ANCHOR if key[0][0] == "<" else 0.0
            for k in (key, key[1]):
                event[k] += sure + told * first.get(key, 0.0) + (1 - told) * max(0.0, gap[key] - follow[key])
                seen[k] += sure + gap[key]
        event["near"], seen["near"] = near["pairs"], near["free"]
        model.event, model.seen, model.after, model.follow = event, seen, after, follow
        model.memo = {}
    return model


def fit(sample: list[tuple[str, str | None]], rounds: int = ROUNDS) -> Model:
    """A model of (text, layout) in memory; ``fit_all`` is the same over a DataFrame."""
    raw, reduced, totals = Counter(), Counter(), Counter()
    for text, layout in sample:
        parse(raw, text, layout)
    model = Model(words=known_words(key for (kind, _, key), n in raw.items() if kind == "word" and n >= RARE))
    for key, n in raw.items():
        if key[0] != "word":
            reduce_words(model, reduced, *key, n)
    for key, n in reduced.items():
        total(totals, *key, n)

    def expected(now: Model) -> list[tuple]:
        out: Counter = Counter()
        for key, n in reduced.items():
            if key[0] == "run":
                expect(now, out, *key, n)
        return [(*key, n) for key, n in out.items()]

    return refine(model, [(*key, n) for key, n in totals.items()], expected, rounds)


_NAMES = [x.split()[0] for x in COUNTS.split(", ")]
_PARSED = "doc_id long, start long, ends array<long>, nexts array<long>, scripts array<string>, keys array<string>, " + COUNTS
_PARSED_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64()]


def _columns(out: Counter) -> list[pa.Array]:
    kinds, scripts, keys = zip(*out) if out else ((), (), ())
    return [pa.array(kinds, pa.string()), pa.array(scripts, pa.string()), pa.array(keys, pa.string()), pa.array(list(out.values()), pa.int64())]


def _counted(rows: DataFrame, add: Callable[..., None]) -> DataFrame:
    """Sums of what ``add`` counts for each row, by kind, script and key; a task holds about ``FLUSH`` keys at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                add(out, *row)
                if len(out) >= FLUSH:
                    yield pa.RecordBatch.from_arrays(_columns(out), _NAMES)
                    out = Counter()
        yield pa.RecordBatch.from_arrays(_columns(out), _NAMES)

    return _summed(rows.mapInArrow(run, COUNTS))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind", "script", "key").agg(F.sum("n").alias("n"))


def parsed_texts(documents: DataFrame) -> DataFrame:
    """One row a text with its gaps (``kind`` is null), and rows of counts of observations, all from one reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        texts, counts = _PARSED_TYPES[:6], _PARSED_TYPES[6:]
        out: Counter = Counter()

        def counted(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(c), t) for t in texts), *_columns(c)], names)

        for batch in batches:
            rows, n_gaps = [], 0
            for doc_id, text, layout in zip(*(c.to_pylist() for c in batch.columns)):
                got = parse(out, text, layout)
                rows.append((doc_id, got.start, got.ends, got.nexts, got.scripts, got.keys))
                n_gaps += len(got.ends)
                if n_gaps > FLUSH:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), texts)), *(pa.nulls(len(rows), t) for t in counts)], names)
                    rows, n_gaps = [], 0
                if len(out) >= FLUSH:
                    yield counted(out)
                    out = Counter()
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), texts)), *(pa.nulls(len(rows), t) for t in counts)], names)
        yield counted(out)

    return documents.mapInArrow(run, _PARSED)


def fit_all(parsed: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all texts of ``parsed_texts``.

    Their observations are counted by Spark, as are the expected counts of each round over the distinct runs of gaps;
    the driver gets the words seen ``RARE`` times or more and counts by such words and shapes, never texts or gaps.
    """
    raw = materialize(_summed(parsed.filter(F.col("kind").isNotNull()).select("kind", "script", "key", "n")))
    frequent = raw.filter((F.col("kind") == "word") & (F.col("n") >= RARE)).select("key")
    model = Model(words=known_words(r["key"] for r in frequent.toLocalIterator()))
    reduced = materialize(_counted(raw.filter(F.col("kind") != "word"), partial(reduce_words, model)))
    runs = reduced.filter(F.col("kind") == "run")
    return refine(model, map(tuple, _counted(reduced, total).collect()), lambda now: map(tuple, _counted(runs, partial(expect, now)).collect()), rounds)


def split_sentences(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``sent_no``, ``sent_start`` and ``sent_end`` of every sentence, by offsets in code points.

    The model is fitted on all texts and then applied to every whole text. Null, empty and blank texts have no
    sentence; a missing layout counts as ``flow``; a repeated row gives its sentences again; a text without any mark
    is one sentence a block.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text", "layout").filter(F.col("text").isNotNull())
    parsed = materialize(parsed_texts(rows))
    model = fit_all(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, nexts, scripts, keys = (batch.column(c) for c in ("ends", "nexts", "scripts", "keys"))
            sizes = np.asarray(pc.list_value_length(ends)).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            flat = pc.list_flatten(keys)
            chosen = np.asarray(flat.is_null())
            open_ = pa.array(np.flatnonzero(~chosen))
            chosen = chosen.copy()
            if len(open_):
                chosen[~chosen] = model.decide(pc.list_flatten(scripts).take(open_).to_pylist(), flat.take(open_).to_pylist())
            row, end, after = row[chosen], np.asarray(pc.list_flatten(ends))[chosen], np.asarray(pc.list_flatten(nexts))[chosen]
            first = np.searchsorted(row, row)
            start = np.concatenate(([0], after[:-1])) if len(after) else after
            fresh = first == np.arange(len(row))
            start = np.where(fresh, np.asarray(batch.column("start"))[row], start)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array((np.arange(len(row)) - first).astype(np.int32)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "sent_no", "sent_start", "sent_end"]
            )

    texts = parsed.filter(F.col("kind").isNull()).select("doc_id", "start", "ends", "nexts", "scripts", "keys")
    return texts.mapInArrow(run, "doc_id long, sent_no int, sent_start long, sent_end long")
