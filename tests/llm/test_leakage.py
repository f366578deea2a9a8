"""Leak search against a scan of all runs of words."""

import random
from collections import defaultdict

import pytest

from millrace.llm import leakage
from millrace.llm.leakage import RUN, words

DOCS = "doc_id bigint, text string, item_id bigint, places string, shard string"
ITEMS = "item_id bigint, prompt string, doc_id bigint"


def brute(docs, items):
    runs, out = defaultdict(list), {}
    length = {}
    for i, p in items:
        w = words(p)
        length[i] = len(w)
        for j in range(len(w) - RUN + 1):
            runs[tuple(w[j : j + RUN])].append((i, j))
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - RUN + 1):
            for i, j in runs.get(tuple(w[k : k + RUN]), ()):
                out.setdefault((d, i), set()).update(range(j, j + RUN))
    return {(d, i, len(c), length[i]) for (d, i), c in out.items()}


def found(spark, docs, items, slop=None):
    d = spark.createDataFrame([(i, t, i, "clash", None) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, p, None) for i, p in items], ITEMS)
    return leakage.matches(d, "doc_id", "text", q, "item_id", "prompt", slop)


def made(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 40)))) for i in range(30)]
    docs = []
    for d in range(200):
        parts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60)))]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items)[1].split()
            a = rnd.randrange(len(w))
            parts.append(", ".join(w[a : a + rnd.randrange(1, 40)]))
        docs.append((d, ". ".join(parts)))
    return docs, items


@pytest.mark.parametrize("several_blocks", [False, True])
def test_like_a_scan(spark, monkeypatch, several_blocks):
    docs, items = made(several_blocks)
    docs += [(900, None), (901, ""), (902, docs[0][1] * 300)]
    items += [(77, None), (78, ""), (79, "w1 w2"), (80, items[0][1])]
    if several_blocks:
        monkeypatch.setattr(leakage, "BLOCK_CHARS", 700)
    got = found(spark, docs, items).collect()
    assert {(r.doc_id, r.item_id, r.covered, r.length) for r in got} == brute(docs, items)
    assert all(r.near is None for r in got)
    leaked = {(r.doc_id, r.item_id) for r in leakage.leaks(found(spark, docs, items)).collect()}
    assert leaked == {(d, i) for d, i, c, n in brute(docs, items) if 2 * c >= n}


def test_the_corpus_is_read_once_for_all_blocks(spark, monkeypatch):
    docs, items = made(5)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 700)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    d = spark.createDataFrame(docs, "doc_id bigint, text string").mapInArrow(counted, "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, prompt string")
    assert len(list(leakage.item_blocks(q, "item_id", "prompt"))) > 1
    got = leakage.matches(d, "doc_id", "text", q, "item_id", "prompt").collect()
    assert {(r.doc_id, r.item_id, r.covered, r.length) for r in got} == brute(docs, items)
    assert read.value == len(docs)


def test_a_stored_index_is_searched_with_new_items(spark, tmp_path):
    docs, items = made(6)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    leakage.stored(leakage.build_index(d, "doc_id", "text"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    new = [(1000 + i, t) for i, t in docs[:40]]
    for part in (items, new):
        q = spark.createDataFrame(part, "item_id bigint, prompt string")
        got = leakage.search_all(index, q, "item_id", "prompt").collect()
        assert {(r.doc_id, r.item_id, r.covered, r.length) for r in got} == brute(docs, part)


def test_index_holds_every_posting(spark):
    docs = [(1, "a b a"), (2, "b c"), (3, "z z"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    (row,) = leakage.build_index(df, "doc_id", "text").collect()
    assert list(row.docs) == [1, 2, 3]
    one, two, three = row.begins
    bounds = [0, *row.ends]
    assert {w: list(row.places[x:y]) for w, x, y in zip(row.words, bounds, bounds[1:])} == {
        "a": [one, one + 2], "b": [one + 1, two], "c": [two + 1], "z": [three, three + 1]
    }
    assert two >= one + 3 + leakage.GAP


def test_shards_are_cut_and_portions_put_together(monkeypatch):
    docs, items = made(7)
    monkeypatch.setattr(leakage, "AT_ONCE", 3)
    asked = leakage.Queries(items)
    said = [words(t) for _, t in docs]
    begins = [sum(len(w) + leakage.GAP for w in said[:i]) for i in range(len(said))]
    docs_, begins_, vocabulary, ends, places = (c[0].values for c in leakage._shard([i for i, _ in docs], begins, said).columns)
    shard = leakage.Shard(asked, vocabulary, ends.to_numpy().astype("int64"), places.to_numpy())
    got = leakage._covered(asked, begins_.to_numpy(), shard.exact(asked.runs))
    assert {(docs[d][0], asked.items[i][0], len(c), asked.items[i][1]) for (d, i), c in got.items()} == brute(docs, items)


def test_items_that_share_an_id_are_matched_each(spark):
    one, two = "one two three four five six seven eight", "one two three four five six seven eight nine ten"
    got = found(spark, [(1, two)], [(5, one), (5, two)]).collect()
    assert sorted((r.covered, r.length) for r in got) == [(8, 8), (10, 10)]


def brute_near(docs, items, window):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, p in items:
            q = words(p)
            for j in range(len(q) - RUN + 1):
                run = set(q[j : j + RUN])
                if any(run <= set(w[k : k + window]) for k in range(max(1, len(w) - window + 1))):
                    out.setdefault((d, i), set()).update(range(j, j + RUN))
    return {k: len(c) for k, c in out.items()}


def test_near_matches_lie_in_one_window(spark):
    prompt = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [
        (1, "theta eta zeta epsilon delta gamma beta alpha"), (2, prompt), (3, prompt.replace(" gamma", " gamma x y z u")), (4, "alpha " * 8),
        (5, prompt.replace(" gamma", " gamma x y z u v")), (6, "beta gamma delta epsilon x y z u alpha v w s zeta eta theta"), (7, "zeta " + prompt[:-5]),
    ]
    got = {r.doc_id: (r.covered, r.near) for r in found(spark, docs, [(5, prompt)], slop=4).collect()}
    assert got == {1: (0, 8), 2: (8, 8), 3: (0, 8)}
    with pytest.raises(ValueError):
        found(spark, docs, [(5, prompt)], slop=60).collect()


def test_near_like_a_scan(spark):
    rnd = random.Random(8)
    docs, items = made(8)
    items = items[:12]
    for d in range(300, 340):
        w = rnd.choice(items)[1].split()
        rnd.shuffle(w)
        docs.append((d, " ".join(x + (" q" if rnd.random() < 0.3 else "") for x in w)))
    got = {(r.doc_id, r.item_id): r.near for r in found(spark, docs, items, slop=6).collect() if r.near}
    want = brute_near(docs, items, RUN + 6)
    assert got == want and len(want) > 20


def test_empty_tables(spark):
    docs, items = made(3)
    assert found(spark, [], items).count() == 0
    assert found(spark, docs, []).count() == 0


SAID = "The famous lamp above Velmir burned for 578 hours"


@pytest.mark.parametrize("written", [
    "The fa\u200bmous lamp ab\u00adove Vel\u2060mir burned for 578 ho\ufeffurs", r"The famous\nlamp above\tVelmir \"burned\" for 578 hours",
    r"The famous\\nlamp above\\u0020Velmir burned for 578 hours", "<p>The <b>famous</b> lamp&nbsp;above<br/>Velmir burned for &#53;78 hours</p>",
    "ＴＨＥ ｆａｍｏｕｓ ｌａｍｐ ａｂｏｖｅ Ｖｅｌｍｉｒ burned for ５７８ hours", "THE FAMOUS LAMP\r\nABOVE\u3000VELMIR -- BURNED, FOR (578) HOURS!",
])
def test_writing_does_not_count(written):
    assert words(written) == words(SAID)


def test_strings_in_strings_at_any_depth():
    import json

    said = 'The famous\n"lamp" above Velmir\tburned \\ for 578 hours'
    for _ in range(9):
        assert words(said) == words(SAID)
        said = json.dumps(said)
    assert words("\\" * 5000 + "n end") == ["end"]


def test_words_of_scripts():
    assert words("天亮前864箱，ヶ浜カー") == ["天", "亮", "前", "864", "箱", "ヶ", "浜", "カ", "ー"]
    assert words("naïve Straße") == words("naïve STRASSE")
    assert words("a < b and c > d") == ["a", "b", "and", "c", "d"]
    assert words("\\ud83d\\ude00 ok") == ["ok"]
    assert words(None) == words("") == words(" \u200b ") == []
