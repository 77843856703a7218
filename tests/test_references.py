import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.functions.bitmaps import Bitmap
from lexweave.operators.references import orphan_references, orphan_report

T = dt.datetime
MAP = "child_id string, external_parent_id string, created_at timestamp_ntz, extra int"
PARENT = "external_parent_id string, created_at timestamp_ntz, child_id string"
GONE = "external_parent_id string, deleted_at timestamp_ntz, created_at int"
CHILD = "child_id string, external_parent_id string"


def run(spark, mapping, parents=(), gone=(), children=(), **kw):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((mapping, MAP), (parents, PARENT), (gone, GONE), (children, CHILD))]
    return orphan_references(*frames, **kw)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_kinds_periods_and_normalised_ids(spark):
    mapping = [
        ("C1 ", " P-OK", T(2024, 1, 5), 1), ("c1", "p-ok", None, 1), ("c2", "p-gone", T(2024, 2, 1), 1), ("c3", "p-miss", None, 1), ("c4", "P-LATE\n", T(2024, 3, 1), 1),
        ("c5", None, T(2024, 3, 1), 1), (None, "p-miss", T(2024, 1, 1), 1), ("c6", "p-back", T(2024, 5, 1), 1), ("c7", "p-delonly", T(2024, 5, 1), 1), ("c8", "p-same", T(2024, 6, 2), 1), ("c9", "p-same", T(2024, 6, 9), 1), ("c10", "p-null", T(2020, 1, 1), 1),
    ]
    parents = [("p-ok", T(2024, 1, 1), "x"), ("p-gone", T(2024, 1, 1), None), ("p-late", T(2024, 3, 2), None), ("p-back", T(2024, 1, 1), None), ("p-back", T(2024, 4, 1), None), ("p-same", T(2024, 6, 5), None), ("p-null", None, None), (None, T(2024, 1, 1), None)]
    gone = [("p-gone", T(2024, 1, 9), 1), ("p-gone", T(2023, 1, 1), 1), ("p-back", T(2024, 2, 1), 1), ("p-delonly", T(2024, 2, 1), 1), (None, T(2024, 2, 1), 1), ("p-nullat", None, 1)]
    children = [(f"c{k}", "p") for k in (1, 2, 3, 4, 6, 7, 8, 10)] + [(None, "p"), ("C1", "q")]
    got = rows(run(spark, mapping, parents, gone, children))
    assert got == sorted(
        [
            ("external_parent_id", "c2", "p-gone", "2024-02", "deleted"), ("external_parent_id", "c3", "p-miss", "unknown", "missing"), ("external_parent_id", "c4", "p-late", "2024-03", "late"), ("external_parent_id", None, "p-miss", "2024-01", "missing"),
            ("external_parent_id", "c7", "p-delonly", "2024-05", "deleted"), ("external_parent_id", "c8", "p-same", "2024-06", "late"), ("child_id", "c9", "p-same", "2024-06", "missing"),
        ],
        key=str,
    )


def test_empty_tables_and_report(spark):
    assert rows(run(spark, [])) == []
    found = run(spark, [("c", "p", None, 1)])
    assert rows(found) == [("child_id", "c", "p", "unknown", "missing"), ("external_parent_id", "c", "p", "unknown", "missing")]
    assert {(r["ref_field"], r["n_references"]) for r in orphan_report(found).collect()} == {("child_id", 1), ("external_parent_id", 1)}


def test_many_ranges_and_a_hot_key_equal_brute_force(spark):
    rng = random.Random(4)
    mapping = [(f"c{rng.randrange(400)}", "hot" if rng.random() < 0.33 else f"p{rng.randrange(60)}", T(2024, rng.randrange(1, 6), rng.randrange(1, 28)), 0) for _ in range(900)]
    parents = [(f"p{k}", T(2024, rng.randrange(1, 6), rng.randrange(1, 28)), None) for k in range(0, 60, 2)]
    gone = [(f"p{k}", T(2024, rng.randrange(1, 6), rng.randrange(1, 28)), 0) for k in range(0, 60, 5)]
    children = [(f"c{k}", "p") for k in range(0, 400, 3)]
    born, removed, first = {p: t for p, t, _ in parents}, {p: t for p, t, _ in gone}, {}
    for c, p, t, _ in mapping:
        first[c, p] = min(t, first.get((c, p), t))
    want = []
    for (c, p), t in first.items():
        kind = "deleted" if p in removed and (p not in born or removed[p] > born[p]) else "missing" if p not in born else "late" if born[p] > t else None
        if kind:
            want.append(("external_parent_id", c, p, f"{t:%Y-%m}", kind))
        if c not in {x for x, _ in children}:
            want.append(("child_id", c, p, f"{t:%Y-%m}", "missing"))
    assert rows(run(spark, mapping, parents, gone, children, keys_per_range=50, salts=3)) == sorted(want, key=str)


codes = st.lists(st.integers(0, 300_000), max_size=60)


@settings(max_examples=60, deadline=None)
@given(codes, codes, st.booleans())
def test_bitmap_is_a_set(a, b, dense):
    if dense:
        a = a + list(range(65_000, 75_000))
    x, y = Bitmap.of(np.array(a, dtype=np.uint32)), Bitmap.of(np.array(b, dtype=np.uint32))
    assert x.codes().tolist() == sorted(set(a)) and len(x) == len(set(a))
    assert x.and_not(y).codes().tolist() == sorted(set(a) - set(b))
    assert x.union(y).codes().tolist() == sorted(set(a) | set(b))
    assert x.has(np.array(b, dtype=np.uint32)).tolist() == [v in set(a) for v in b]
