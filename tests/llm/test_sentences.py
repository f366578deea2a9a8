"""Sentence units of single blocks in many languages, and the places of all units."""

import time

import pytest

from millrace.llm import sentences

SCHEMA = "doc_id bigint, text string, cells array<struct<kind string, exec_no int, char_start int, char_end int>>, sentence string, at string"


def units(spark, texts):
    rows = [(i, t, [("markdown", None, 0, len(t))], "clash", "clash") for i, t in enumerate(texts)]
    out = sentences.sentences(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "cells").collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(out, key=lambda r: (r.doc_id, r.char_start)):
        got[r.doc_id].append(texts[r.doc_id][r.char_start : r.char_end])
    return list(got.values())


#: A list stands for a block and its units.
WHOLE = [
    ["Dr. Gor met Mr. and Mrs. Ken.", "They left at 5 p.m.", "It rained, i.e. a lot, until 7 a.m. Sunday.", "See Fig. 3 and Sec. 4.16 for more."],
    ["V. A. Ritosk of Luel Inc. sent it.", "Compare site B vs. site C.", "The value is .05, not .3.", "Ver. 16 (a.k.a. v1.2.3) is gone."],
    ["**Wait ... 9 rows?**", "Wait ... 21 rows?", "Well ... the plot is fine.", "Nothing changed ...", "Then it did…", "The flow stays below 2 °C… mostly."],
    ['The log said: "Run failed. Restart the kernel!" and nothing else.', '"Is it stable?" asked Dana.', 'She wrote: "Fine. Ship it."', "Next."],
    ["The curve (it starts at 2.78. No, at 14.77!) looks flat.", "(The plan was rebuilt in 2009.)", "pandas reads it.", "next i drop it.", "so this works now."],
    ["**It is `a.b()` here.**", "`df.head()` shows that.[3]", "The answer was 'no.'", "The package Bang! prints 3 rows.", "See https://x.example/v1.2/run?id=10 for now.", "Is it?!", "No"],
    ["No.", "He likes modern art.", "It is no. 5 in vol. 2 of Eq. (3).", "By Dec. 4 it rose.", "She came in Dec.", "Then she left."],
    ["There are two steps: 1. load it, 2. clean it.", "README.md and ../cfg/model.tar.gz are old.", "We tried means, etc.", "It is set to 0."],
    ["Am 3. Mai fiel Hr. Ken aus.", "Die Werte der 3. und 4. Schicht, z. B. `C`, u. a. Text, sind i. d. R. gut.", "Teil 3.", "Im 19. Jh. war es bei 5 °C.", "Der Rest usw.", "Die N GmbH & Co. KG."],
    ["„Stimmt das?“ fragte Ken.", "So weit, so gut …", "Wir gehen."],
    ["M. Elmir a relu la fig. 19, p. ex. ici.", "Tout va bien…", "Le seuil vaut 38,52 ; au-delà, on coupe.", "« Est-ce bon ? » demanda Mme Ken.", "Ne lancez pas deux fois !", "J.-P. Ken habite av. du Moulin, bât. 9."],
    ["EE. UU. y Uds. usan otra, según la Dra. Ken.", "¿Y ahora?", "—¿Es estable? —preguntó la Sra. Ken.", "Véase, p. ej., la pág. 4."],
    ["Мы пробовали моду и т. д.", "Проф. Кен и д-р Лен, т. е. оба, см. рис. 3.", "«Сбой. Снова!» и больше ничего."],
    ["Βλ. σχ. 3 για το π.χ. πρώτο.", "Γιατί πηδά στις 7:15;", "Ξανά!"],
    ["यह सच है॥", "प्रो. केन ने कहा।", 'लिखा था: "काम रुका। फिर चलाइए।" और कुछ नहीं।', "क्यों?"],
    ["قال السجل: «فشل. أعد.» ولا شيء.", "لماذا؟", "راجع د. سامبول الشكل 9.", "نعم!"],
    ["በ2017 ዓ.ም. ተቀየረ።", "ለምን ሆነ፧", "አታስኪዱ!"],
    ['로그에는 "실패했다. 다시."라고 적혀 있었다.', "왜 튀는가?", "평균은 3.5에서 줄었다."],
]
NO_BLANKS = [
    ["可以重跑了!", "温度低于18度……基本如此。", "等等……16行？", "真的吗？！", "（见图7。）", "“数字会骗人。图更会骗人。”评审后有人写道。", "《数据。图表》有说明。", "用v3.1（不是v1.0）时最小。"],
    ["なぜ70.61になるのか?", "「安定か？」と聞かれた。", "（図14を参照。）", "v4.11（旧版）はa.v2.csvを読めない。", "28度より低い……はずです。"],
]


def test_blocks(spark):
    texts = [" ".join(x) for x in WHOLE] + ["".join(x) for x in NO_BLANKS] + ["  ".join(x) for x in WHOLE]
    assert units(spark, texts) == WHOLE + NO_BLANKS + WHOLE


def test_stops_inside_decimals_versions_and_names(spark):
    wide = ["円周率は３．１４です。", "値は９５．３％だった．", "ｖ１．２．３とｍａｉｎ．ｐｙとａ.ｂ．csvを使う。", "使ったのはＲ．", "次はPython．", "Rは使わない。", "第３．", "終わり"]
    greek = ["Τρέχει σε Python 3.11;", "Ναι.", "Είναι στο main.py;", "Ναι.", "Είναι στο v1.2.3;", "Όχι.", "Λείπει το .env;", "Ναι."]
    assert units(spark, ["".join(wide), " ".join(greek)]) == [wide, greek]


def test_greek_questions(spark):
    far = "x" * 70
    greek = [
        f"Γιατί αποτυγχάνει το `{far}`;", "Ναι.", f"Πού είναι το /srv/{far}/a;", "Εκεί.", f"Άνοιξε το https://x.example/{far};", "Όχι.",
        "Γιατί αργεί το TensorFlow Extended Data Validation Pipeline Orchestrator With Many More Names;", "Έτσι.", "Ή;", "Τέλος.",
    ]
    other = ["We set the β coefficient of `a`; The rest stays.", "It is the word λόγος in all of them; He said so."]
    assert units(spark, [" ".join(greek), " ".join(other)]) == [greek, other]


def test_a_line_break_is_a_blank(spark):
    for end in ("\n", "\r\n"):
        text = "One line" + end + "goes on. Dr." + end + "Ken came. Ends" + end + end + "New block"
        assert units(spark, [text]) == [["One line" + end + "goes on.", "Dr." + end + "Ken came.", "Ends", "New block"]]


def test_thai(spark):
    text = "ทำไมเส้นกราฟกระโดดตอน 3:15 ทุกวัน เราอ่านไฟล์ a.csv แล้วเรียง ผลลัพธ์\nยังไม่แน่นอน"
    assert units(spark, [text]) == [["ทำไมเส้นกราฟกระโดดตอน 3:15 ทุกวัน", "เราอ่านไฟล์ a.csv แล้วเรียง", "ผลลัพธ์", "ยังไม่แน่นอน"]]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_structure(spark, end):
    lines = [
        "# Head. Line", "Text one. Text two", "| a. | b. |", "|---|---|", "After table.", "- [ ] item. Second", "* other", "1. first. One more", "> quoted. Too", "> next",
        "", "```python", "# It is. Code", "- x", "", "```", "$$ y = x. $$", "![fig. 1](attachment:a.png)", "---", "End", "", "~~~", "never closed. x",
    ]
    want = ["Text one.", "Text two", "After table.", "item.", "Second", "other", "first.", "One more", "quoted.", "Too", "next", "End"]
    assert units(spark, [end.join(lines)]) == [want]


def test_cells_places_and_defined_results(spark):
    text = "😀 head\nEins. Zwei.\ncode. not"
    at = text.index("Eins")
    cells = [("code", 1, 0, 6), ("markdown", None, at, at + 11), ("output", 1, 19, 28), ("markdown", None, None, 4), ("markdown", None, 5, 5), (None, None, 0, 4), None]
    rows = [
        (1, text, cells, "", ""), (1, text, cells, "", ""), (2, None, cells, "", ""), (3, text, None, "", ""), (4, "", [("markdown", None, 0, 0)], "", ""),
        (5, " \n\t\n", [("markdown", None, 0, 4)], "", ""), (6, "... — !!", [("markdown", None, 0, 8)], "", ""), (None, "Ja.", [("markdown", None, 0, 3)], "", ""),
        (7, "a\ue000b. C\ue010d. E", [("markdown", None, 0, 11)], "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id or 0, r.char_start, r.char_end) for r in sentences.sentences(df, "doc_id", "text", "cells").collect()))
    assert got == [(0, 0, 3), (1, at, at + 5), (1, at, at + 5), (1, at + 6, at + 11), (1, at + 6, at + 11), (7, 0, 4), (7, 5, 9), (7, 10, 11)]
    assert sentences.sentences(df.filter("false"), "doc_id", "text", "cells").count() == 0


def test_very_long_cell(spark):
    text = "It is so. (Yes. No.) \"Open quote. " * 6000
    got = units(spark, [text])[0]
    assert len(got) > 6000 and "".join(got).replace(" ", "") == text.replace(" ", "")


N = 100_000


#: Every group that a pattern repeats, and openers that nothing closes, with the number of units.
@pytest.mark.parametrize("texts", [
    {"See (" + "(a) " * N + ") end. Next.": 2, "（" + "（あ）" * N + "）。終": 2, "(" * N + "a. B": 2, "([{" * N: 0},
    {"A. " * N + "Smith went. Then.": 2, "x " + "A. " * N + "y": N, "J.-" * N + "Smith went.": 1},
    {'He said "No."' + "*" * N + " Next": 2, 'He said "No."' + "[1]" * N + " Next": 2, "No." + ")" * N + " Next": 2, "好。" + "」" * N + "次": 2},
    {"> " * N + "a. B": 2, ">" * N + "# x": 0, "- " * N: 0, "-" + "|-" * N: 0, "1. " * N + "x. B": 2, "> " + "- " * N + "x. B": 2},
    {"a" + "." * N + "x B": 1, "あ" + "。" * N: 1, "あ" + "！" * N + "い": 2, "あ" + "!" * N + "い": 2, "a" + "…" * N + " B": 2},
    {"λόγος " + "x" * N + "; ναι; Ναι": 2, '"' * N + "a": 1, "x " + "`" * N + "a": 1, "\n" * N + "a. B": 2, "http://" * N: 1, "ก " * 1000: 1000},
    {"$$ a\n" * 20_000: 1, "\\begin{a}\n" * 20_000: 1, "\\[ a\n" * 20_000: 1, "$$ a\n\nb. C\n$$": 0, "\\begin{a}\n\\x\n\\end{a}\nb. C": 2},
])
def test_repeats_neither_overflow_nor_stall(spark, texts):
    began = time.perf_counter()
    assert [len(u) for u in units(spark, list(texts))] == list(texts.values())
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("text", ["It is so. ", "- It is so\n"])
def test_time_grows_with_the_units_of_a_cell(spark, text):
    def took(n):
        began = time.perf_counter()
        assert len(units(spark, [text * n])[0]) == n
        return time.perf_counter() - began

    took(2000)
    assert took(64_000) < 5 * took(16_000)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 4097])
def test_places_of_many_parts(spark, n):
    parts = ["x" * (i % 7) + sentences.NO_PROSE * (i % 2) for i in range(n)]
    df = spark.createDataFrame([(parts,)], "p array<string>").repartition(2)
    got = df.select(sentences._starts(df.p, less=sentences.NO_PROSE).alias("s")).first().s
    assert got[:n] == [sum(k % 7 for k in range(i)) for i in range(n)]


def test_marks_at_the_end_of_a_block_belong_to_the_unit(spark):
    whole = [["本当ですか？！"], ["真的吗？！"], ["好。。"], ["真的?! ", "次"], ["そう！？", "次。"]]
    assert [[u.strip() for u in x] for x in units(spark, ["".join(x) for x in whole])] == [[u.strip() for u in x] for x in whole]


def test_restored_text(spark):
    text = 'Dr. Ken said: "No. Never!" at 3.5 p.m. Monday.'
    row = sentences.sentences(spark.createDataFrame([(1, text, [("markdown", None, 0, len(text))], "", "")], SCHEMA), "doc_id", "text", "cells").first()
    assert row.sentence == text
