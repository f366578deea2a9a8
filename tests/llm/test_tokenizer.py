"""Encoding against two other implementations of the same vocabulary."""

import base64
import os
import random
import sys

import pytest

from millrace.llm import tokenizer

FOLDER = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
RANKS = os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
TEXTS = [
    "Hello world", " leading and  double   blanks \n\n\n end ", "it's we'll I'd 'tis they've", "a\r\n\tb\r\n", "<|endoftext|> is text",
    "naïve café Ωμέγα привет мир", "数字会骗人。图更会骗人。", "ทดสอบ ภาษาไทย", "औसत ४५", "👩‍🔬🏭", "x² ½ ⅷ Ⅻ ①②", "a\x1cb \x1d\x1e c\x1f", "\x85 \xa0  ", "__init__ _x_ $%^",
    "1234567890" * 30, "=" * 5000, "ab" * 4000, " " * 3000, "é" * 2000, "́̂", "𝒜𝒷𝒸 𐍈", "\ufeffbom", "don't 'S 'RE",
]


@pytest.fixture(scope="module")
def ranks():
    return tokenizer.read_ranks(RANKS)


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenizer.SPLIT, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=400):
    rnd = random.Random(7)
    pools = ["abcdeé ßŒ'", "0123456789²Ⅷ ", "日本語のテキスト。", " \n\t\r\xa0\x1c", "!?._-'\"$€", "กขค अआइ उदा", "👍🏽👩‍🔬"]
    return ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(80))) for _ in range(n)]


def test_same_ids_as_another_implementation_and_round_trip(spark, reference, ranks):
    texts = TEXTS + random_texts()
    rows = [(i, t, None, [1]) for i, t in enumerate(texts)] + [(-1, None, "x", None), (-2, "", "x", None), (3, TEXTS[3], "again", [2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, ids array<int>")
    got = [(r.doc_id, list(r.ids)) for r in tokenizer.encode(df, "doc_id", "text", RANKS).collect()]
    assert len(got) == len(rows)
    back = {v: k for k, v in ranks.items()}
    for doc, ids in got:
        if doc < 0:
            assert ids == []
        else:
            assert ids == reference.encode_ordinary(texts[doc]), texts[doc][:40]
            assert b"".join(back[i] for i in ids).decode() == texts[doc]


def test_same_ids_as_the_json_file(ranks):
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.join(FOLDER, "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no such file")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    words = tokenizer.Words(ranks)
    for t in TEXTS[:14] + random_texts(60):
        assert memoryview(words.encode(t)).cast("i").tolist() == other.encode(t, add_special_tokens=False).ids, t


def test_long_and_short_merges_agree(ranks):
    rnd = random.Random(3)
    for _ in range(300):
        word = bytes(rnd.choice(b"etaoin shrdlu\xc3\xa9\xe4\xb8\xad0123=") for _ in range(rnd.randrange(1, 150)))
        assert tokenizer.merge_short(word, ranks) == tokenizer.merge_long(word, ranks)


def test_full_table_starts_anew(ranks, reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "KEPT_WORDS", 3)
    words = tokenizer.Words(ranks)
    for t in TEXTS + TEXTS:
        assert memoryview(words.encode(t)).cast("i").tolist() == reference.encode_ordinary(t)
    assert len(words) <= 3 and sys.getsizeof(words) < 10_000


def test_batches_are_bounded_and_empty_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * i) for i in range(200)], "doc_id int, text string")
    out = tokenizer.encode(df, "doc_id", "text", RANKS)
    assert {r.doc_id: len(r.ids) for r in out.collect()}[3] == 4
    assert tokenizer.encode(df.filter("false"), "doc_id", "text", RANKS).count() == 0
    assert out.dtypes == [("doc_id", "int"), ("ids", "array<int>")]


def test_rank_lines_are_base64(ranks):
    line = next(iter(open(RANKS, "rb"))).split()
    assert ranks[base64.b64decode(line[0])] == int(line[1])
