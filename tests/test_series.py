import random

import pytest

from breathline.functions import rules
from breathline.operators.series import (
    complete_grid,
    pair_series,
    pf_onset,
    sustained_since_failure,
)

SCHEMA = "stay_id bigint, offset_min int, name string, value double"
P, Q = rules.PAO2, rules.FIO2

CASES = {
    1: [(0, P, 60), (0, Q, 50), (300, P, 70), (600, Q, 40), (600, P, 80), (700, P, 200), (700, Q, 40)],
    2: [(0, P, 60), (10, P, 70)],
    3: [(100, P, 50), (100, Q, 50)],
    4: [(0, P, 60), (0, Q, 50), (60, P, 60), (60, Q, 50)],
    5: [(0, P, 60), (0, Q, 50), (60, P, 60), (60, Q, 50), (120, P, 300), (120, Q, 50)],
    6: [(0, Q, 50), (30, P, 60), (30, Q, 40)],
    7: [(0, P, 60), (0, Q, 50), (50, P, 70)],
    8: [(0, P, 60), (0, P, 80), (0, Q, 50)],
    9: [(0, P, None), (0, Q, 50), (10, P, 90), (10, Q, 30), (20, P, 30), (20, Q, 30)],
    10: [(-600, P, 60), (-600, Q, 50), (-100, P, 60), (-100, Q, 50), (50, P, 400), (50, Q, 50)],
}
EXPECTED_PF = {
    1: [120, 140, 200, 500], 3: [100], 4: [120, 120], 5: [120, 120, 600], 6: [150], 7: [120],
    8: [160], 9: [120, 300, 100], 10: [120, 120, 800],
}
EXPECTED_ONSET = {
    1: (600, 2), 3: (100, 1), 4: (60, 2), 5: (None, 2), 6: (30, 2), 7: (0, 2), 8: (0, 2),
    9: (20, 1), 10: (-100, 2),
}


def long_rows(cases):
    return [(k, t, n, None if v is None else float(v)) for k, rows in cases.items() for t, n, v in rows]


@pytest.mark.parametrize("block", [60, 10_080])
def test_pairs_and_onset_of_hand_made_stays(spark, block):
    df = spark.createDataFrame(long_rows(CASES), SCHEMA)
    got = {}
    for r in pair_series(df, block_minutes=block).orderBy("stay_id", "offset_min").collect():
        got.setdefault(r.stay_id, []).append(round(r.pf, 6))
    assert got == {k: [float(x) for x in v] for k, v in EXPECTED_PF.items()}
    onset = {r.stay_id: (r.onset, r.severity) for r in pf_onset(df, block_minutes=block).collect()}
    assert onset == EXPECTED_ONSET


def test_fill_rules_differ_on_vanishing_values(spark):
    rows = [(1, 0, P, 0.0), (1, 0, Q, 50.0), (1, 10, P, 90.0), (1, 10, Q, 50.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    null = [r.pf for r in pair_series(df).orderBy("offset_min").collect()]
    nonpositive = [r.pf for r in pair_series(df, fill="nonpositive").orderBy("offset_min").collect()]
    assert null == [0.0, 180.0] and nonpositive == [180.0, 180.0]


def brute_force(rows, threshold=300.0, sustain=480):
    """Plain restatement of pairing, onset and the alternative rule for one stay."""
    minutes = {}
    for t, n, v in rows:
        slot = minutes.setdefault(t, {})
        slot[n] = max(slot.get(n, float("-inf")), v)
    mean = {n: [m[n] for m in minutes.values() if n in m and m[n] > 1e-6] for n in (P, Q)}
    if not mean[P] or not mean[Q]:
        return None
    last, pairs = {}, []
    for t in sorted(minutes):
        last.update(minutes[t])
        if len(last) < 2 or (t == max(minutes) and len(minutes[t]) < 2):
            continue
        f = last[Q] / 100 if last[Q] > 1 else last[Q]
        pairs.append((t, last[P] / f))
    onset, start = None, None
    for i, (t, pf) in enumerate(pairs):
        if pf > threshold:
            start = None
            continue
        start = t if start is None else start
        final = i == len(pairs) - 1
        if t - start >= sustain or (final and (start < t or len(pairs) == 1)):
            onset = t
            break
    anchor, alternative = pairs[0][0] if pairs else None, False
    for t, pf in pairs:
        if round(pf, 1) < threshold:
            alternative = alternative or t - anchor >= sustain
        else:
            anchor = t
    return pairs, onset, alternative


@pytest.mark.parametrize("block", [180, 1440])
def test_random_stays_match_brute_force(spark, block):
    rng = random.Random(7)
    cases = {}
    for stay in range(60):
        size = 400 if stay == 0 else rng.randint(1, 25)
        cases[stay] = [
            (rng.randint(-900, 6000), rng.choice([P, Q, Q]), float(rng.choice([30, 45, 60, 80, 100, 140])))
            for _ in range(size)
        ]
    df = spark.createDataFrame(long_rows(cases), SCHEMA)
    pairs = pair_series(df, block_minutes=block).cache()
    got_pairs, expected = {}, {k: brute_force(v) for k, v in cases.items()}
    for r in pairs.orderBy("stay_id", "offset_min").collect():
        got_pairs.setdefault(r.stay_id, []).append((r.offset_min, round(r.pf, 6)))
    for k, e in expected.items():
        want = [(t, round(pf, 6)) for t, pf in e[0]] if e else []
        assert got_pairs.get(k, []) == want
    onset = {r.stay_id: r.onset for r in pf_onset(df, block_minutes=block).collect()}
    assert onset == {k: e[1] for k, e in expected.items() if e and e[0]}
    alternative = {r.stay_id: r.sustained for r in sustained_since_failure(pairs).collect()}
    assert alternative == {k: e[2] for k, e in expected.items() if e and e[0]}


def test_grid_completion(spark):
    rows = [(1, 0, P, 60.0), (1, 5, Q, 40.0), (1, 9, Q, 0.0), (2, 0, P, 60.0), (3, 0, P, 50.0), (3, 1, P, 60.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.stay_id, r.offset_min, r.pao2, r.fio2) for r in complete_grid(df).orderBy("offset_min").collect()]
    assert got == [(1, 0, 60.0, 20.0), (1, 5, 60.0, 40.0), (1, 9, 60.0, 20.0)]
