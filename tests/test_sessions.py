import datetime as dt
import random
from collections import Counter

from millrace.operators import sessions

SCHEMA = "m string, ts timestamp_ntz, kind string, _k0 string, session_no string"
T0 = dt.datetime(2020, 1, 1)


def brute(rows, gap_s=1800):
    out = []
    for m in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == m and r[1] is not None), key=lambda r: r[1])
        parts = []
        for r in own:
            if not parts or (r[1] - parts[-1][-1][1]).total_seconds() > gap_s:
                parts.append([])
            parts[-1].append(r)
        out += [(m, no, p[0][1], p[-1][1], Counter(r[2] for r in p)) for no, p in enumerate(parts, 1)]
    return out


def rows_of(seed):
    rnd = random.Random(seed)
    rows = []
    for m, n in (("hot", 700), ("b", 60), ("c", 1)):
        at = T0
        for _ in range(n):
            at += dt.timedelta(seconds=rnd.choice([0, 0, 5, 600, 1799, 1800, 1801, 9000, 40_000]))
            rows.append((m, at, rnd.choice(["x", "y", None]), "c", "c"))
    rnd.shuffle(rows)
    return rows + [(None, T0, "x", "", ""), ("b", None, "x", "", "")]


def test_sessions_and_kinds(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = sessions.sessions(df, ["m"], "ts").collect()
    assert sorted(tuple(r) for r in got) == sorted(
        (m, no, a, b, (b - a).total_seconds(), sum(k.values())) for m, no, a, b, k in want
    )
    kinds = sessions.session_kinds(df, ["m"], "ts", "kind").collect()
    assert sorted((tuple(r) for r in kinds), key=str) == sorted(
        ((m, no, a, b, kind, n) for m, no, a, b, k in want for kind, n in k.items()), key=str
    )


def test_slice_width_does_not_matter(spark):
    df = spark.createDataFrame(rows_of(2), SCHEMA)
    runs = [sorted(map(tuple, sessions.sessions(df, ["m"], "ts", 1800, s).collect())) for s in (1800, 14_400, 864_000)]
    assert runs[0] == runs[1] == runs[2]


def test_empty(spark):
    assert sessions.sessions(spark.createDataFrame([], SCHEMA), ["m"], "ts").count() == 0
    assert sessions.session_kinds(spark.createDataFrame([], SCHEMA), ["m"], "ts", "kind").count() == 0
