import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.operators import late

SCHEMA = "id string, m string, ts timestamp_ntz, seen timestamp_ntz, load date, n bigint, t double, key string"


def corrected(spark, rows, cutoff=3):
    df = spark.createDataFrame(rows, SCHEMA)
    c = F.col
    out = late.corrected_periods(df, c("id"), c("m"), c("ts"), c("seen"), c("load"), c("n"), c("t"), cutoff)
    return sorted((tuple(r) for r in out.collect()), key=str)


def brute(rows, cutoff=3):
    once = {}
    for i, (ident, m, ts, seen, load, n, t, _) in enumerate(rows):
        if m is None or ts is None or seen is None or load is None or ts > seen:
            continue
        k = ident if ident is not None else ("own", i)
        rank = (load, seen, m, ts)
        if k not in once or rank < once[k][0]:
            once[k] = (rank, m, ts, load, n, t)
    days = {}
    for _, m, ts, load, n, t in once.values():
        if (load - ts.date()).days <= cutoff:
            days.setdefault((m, ts.date()), []).append((load, n, t))
    out = []
    for (m, day), got in days.items():
        for rev, load in enumerate(sorted({g[0] for g in got})):
            upto = [g for g in got if g[0] <= load]
            read = [g[2] for g in upto if g[2] is not None]
            out.append((m, day, load, rev, len(upto), sum(g[1] or 0 for g in upto), min(read, default=None), max(read, default=None)))
    return sorted(out, key=str)


def test_every_load_corrects_what_it_touches(spark):
    rnd, start = random.Random(4), dt.datetime(2020, 1, 1)
    rows = []
    for i in range(900):
        ts = start + dt.timedelta(minutes=rnd.randrange(6 * 1440))
        seen = ts + dt.timedelta(hours=rnd.choice([0, 1, 20, 50, 90, -3]))
        load = max(ts, seen).date() + dt.timedelta(days=rnd.choice([0, 0, 1, 4]))
        m = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None])
        rows.append((f"e{i}", m, ts, seen, load, rnd.choice([None, 3]), rnd.choice([None, 1.5, 2.5, -1.0]), "clash"))
    rows += [(r[0], r[1], r[2], r[3], r[4] + dt.timedelta(days=1), r[5], r[6], r[7]) for r in rows[:200]]
    rows += rows[5:25]
    assert corrected(spark, rows) == brute(rows)


def test_cut_off_is_inclusive(spark):
    ts, seen = dt.datetime(2020, 1, 1, 5), dt.datetime(2020, 1, 1, 6)
    rows = [(str(k), "m", ts, seen, dt.date(2020, 1, 1 + k), 1, None, "") for k in (0, 3, 4)]
    assert [(r[2].day, r[3], r[4]) for r in corrected(spark, rows)] == [(1, 0, 1), (4, 1, 2)]


def test_nulls_and_empty(spark):
    ts = dt.datetime(2020, 1, 1, 5)
    rows = [
        ("a", None, ts, ts, ts.date(), 1, 1.0, None), ("b", "m", None, ts, ts.date(), 1, 1.0, None),
        ("c", "m", ts, None, ts.date(), 1, 1.0, None), ("d", "m", ts, ts, None, 1, 1.0, None),
        (None, "m", ts, ts, ts.date(), None, None, None), (None, "m", ts, ts, ts.date(), None, None, None),
    ]
    assert corrected(spark, rows) == [("m", ts.date(), ts.date(), 0, 2, 0, None, None)]
    assert corrected(spark, []) == []
