"""Sentence units of the prose in Markdown cells, across languages and scripts, in SQL expressions.

Nothing is cut out of a text while it is worked on: characters that must not end a sentence are swapped
for private-use placeholders of the same length, and borders are marked by inserted private-use
characters that are not counted. So the places of the units can be added up, and the text is restored
by swapping the placeholders back.

1. One pattern marks the lines of a cell that hold no prose, and the markers of lists and quotations;
   what lies between is a block.
2. One pattern finds protected spans: code, addresses, quotations, brackets, abbreviations, initials,
   ordinals, and the stops in decimals, versions and names of files. Their terminators are masked.
3. Script-specific patterns mark the borders after the terminators that are left.

Repeated groups are possessive: the regex engine of the JVM follows other ones by recursion, and a long
text would overflow its stack. No pattern is tried again inside a run of marks that it has failed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BORDER, NO_PROSE, SPAN, BRACKET_END, QUOTE_END = "\ue000", "\ue001", "\ue002", "\ue004", "\ue005"
TERMINATORS = ".!?…。！？．｡؟۔।॥።፧;։။ "
MASKS = "".join(chr(0xE010 + i) for i in range(len(TERMINATORS)))
USED = BORDER + NO_PROSE + SPAN + BRACKET_END + QUOTE_END + MASKS
BLANKS = " \t\u00a0\u3000\u202f\u2009\u2002\u2003\u000b\u000c"

# Abbreviations that do not end a sentence whatever follows.
ALWAYS = {
    "en": "Mr Mrs Ms Messrs Dr Drs Prof St Mt Ft Gen Col Capt Lt Sgt Rev Hon Gov Sen Rep Pres viz cf vs approx ca resp dept "
    "Dept bldg Bldg incl excl Univ univ",
    "de": "Hr Hrn Fr Str Tel vgl Vgl bzw ggf evtl inkl exkl zzgl sog Sog ca Ca Lt lt Hrsg gem bspw Mio Mrd Dipl Ing",
    "fr": "MM env Env av bd éd Cf cf resp boul",
    "es": "Sr Sra Srta Sres Dra Dres aprox Aprox Ud Uds Vd Vds avda",
    "ru": "Проф проф им ул пл пр акад доц См см ср Ср тыс кв обл гор д-р св напр Напр",
    "el": "Βλ βλ κ Κ καθ Καθ δρ Δρ αρ Αρ δηλ Δηλ λ",
    "hi": "डॉ प्रो श्री श्रीमती पं पृ सं कु",
}
# Abbreviations that do not end a sentence before a number; many are words besides.
NUMBERED = {
    "en": "Fig Figs fig figs Eq Eqs eq eqs Sec Secs sec secs Ch Chap ch chap Ref Refs Tab tab No Nos no nos Vol Vols vol vols "
    "Ver ver p pp Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "Nr Nrn Abb Abs Kap Bd Bde Ziff Art Aufl S Std Stk",
    "fr": "bât tabl réf art",
    "es": "pág págs núm núms Núm cap tel",
    "ru": "рис Рис табл Табл стр Стр гл Гл с",
    "el": "σχ Σχ πίν Πίν σελ Σελ κεφ",
}
# Abbreviations of several parts; every stop in them is masked.
PARTS = (
    r"e\. ?g\.|i\. ?e\.|a\.k\.a\.|z\. ?B\.|Z\. ?B\.|d\. ?h\.|u\. ?a\.|u\. ?U\.|s\. ?o\.|s\. ?u\.|i\. ?d\. ?R\.|i\. ?A\.|"
    r"o\. ?[äÄ]\.|v\. ?a\.|u\. ?dgl\.|[vn]\. ?Chr\.|p\. ?ex\.|P\. ?ex\.|p\. ?ej\.|P\. ?ej\.|c\.-à-d\.|c\. ?à ?d\.|"
    r"т\. ?е\.|т\. ?к\.|т\. ?н\.|т\. ?о\.|и\. ?о\.|π\. ?χ\.|Π\. ?χ\.|EE\.(?= ?UU\.)|Co\.(?= KG)|"
    r"[ap]\.m\.(?= (?:(?:on )?(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|(?:EST|EDT|CET|CEST|UTC|GMT)\b))|"
    r"al\.(?=[\s,;:]*[(\[\d])"
)
# What precedes a single capital that is a label, not an initial.
LABELS = (
    "site plan type class option group part phase variant case model line zone area unit plant hall team step version "
    "vitamin column row table figure section appendix series grade level room cell point set batch lot shift"
)
# Words written small that begin a sentence nevertheless.
SMALL = (
    "pandas numpy scipy sklearn matplotlib seaborn pytorch torch tensorflow keras polars dask jax jupyter pip conda git "
    "npm ffmpeg curl"
)
# Nouns that German ordinals precede.
ORDINAL_NOUNS = (
    "Jan Feb März Apr Mai Jun Juli Aug Sep Okt Nov Dez Jänner Tag Woche Monat Quartal Jahr Jh Jahrhundert Schicht Stock "
    "Auflage Kapitel Platz Rang Stelle Schritt Versuch Lauf Mal"
)
# Endings of file names, where a full-width stop precedes them.
ENDINGS = (
    "py ipynb csv tsv txt md json jsonl yaml yml toml xml html pdf png jpg jpeg gif svg parquet gz zip tar sql sh log cfg ini "
    "xls xlsx doc docx ppt pptx js ts css java c h cpp rs go r jl npy npz pkl pt h5 db"
)


def _any(words: str) -> str:
    return "|".join(sorted(set(words.split()), key=lambda w: (-len(w), w)))


def _wide(words: str) -> str:
    return words.translate({i: i + 0xFEE0 for i in range(0x21, 0x7F)})


_HEADING = r"^[ \t]*(?:>[ \t]?)*+#{1,6}(?:[ \t].*)?$"
_TABLE = r"^[ \t]*(?:>[ \t]?)*+\|.*$|^[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)++$"
_IMAGE = r"^[ \t]*(?:>[ \t]?)*+(?:!\[[^\]\r\n]*\](?:\([^)\r\n]*\)|\[[^\]\r\n]*\])|<img\b[^>\r\n]*>)[ \t]*$"
_RULE = r"^[ \t]*(?:(?:-[ \t]*){3,}+|(?:\*[ \t]*){3,}+|(?:_[ \t]*){3,}+|={3,}[ \t]*)$"
# Bodies stop at the next mark of their own kind, so that openers that nothing closes cost no more than their text.
_FORMULA = (
    r"^[ \t]*\$\$(?:[^$]|\$(?!\$))*+\$\$[ \t]*$|^[ \t]*\$[^$\r\n]+\$[ \t]*$|^[ \t]*\\\[(?:[^\\]|\\(?![\[\]]))*+\\\][ \t]*$|"
    r"^[ \t]*\\begin\{(\w+\*?)\}(?:[^\\]|\\(?!(?:begin|end)\{\2\}))*+\\end\{\2\}[ \t]*$"
)
_FENCE = (
    r"^[ \t]*(?:>[ \t]*)*+(```+|~~~+)[^\r\n]*(?:\R(?s:.*?)(?:^[ \t]*(?:>[ \t]*)*+\1[`~]*[ \t]*$|\z)|\z)"
)
_BULLET = r"(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?"
_MARKER = rf"^[ \t]*(?:>[ \t]?)++(?:[ \t]*{_BULLET})*+|^[ \t]*(?:{_BULLET})++"
_BLANK_LINE = r"(?>\r\n|\n|\r)[ \t]*(?=[\r\n])"
#: Everything that is no prose, in one pattern, so that nothing is sought inside what is found.
STRUCTURE = "(?m)" + "|".join((_FENCE, _FORMULA, _HEADING, _TABLE, _IMAGE, _RULE, _MARKER, _BLANK_LINE))

_LATIN = r"\w０-９Ａ-Ｚａ-ｚ＿"
_W = r"(?<![\p{L}\p{M}\p{N}_])"
_QUOTES = (
    "\"[^\"]*\"|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|»[^«»]*«|‹[^‹›]*›|「[^「」]*」|『[^『』]*』|《[^《》]*》|〈[^〈〉]*〉|‘[^‘’]*’(?![\\p{L}])"
)
_BRACKETS = (
    r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)|（[^（）]*+(?:（[^（）]*+）[^（）]*+)*+）|\[[^\[\]]*\]|【[^【】]*】|\{[^{}]*\}"
)
PROTECTED = "|".join(
    (
        "``[^`]+``|`[^`]+`",
        r"(?:https?|ftp)://\S*[^\s.,;:!?…。！？\"'”’»)\]}>*_]",
        _QUOTES,
        _BRACKETS,
        # What follows a look ahead is tried at few places only: long lists cost nothing elsewhere.
        rf"(?=\p{{L}}{{1,2}}\.){_W}(?:{PARTS})",
        rf"(?=[\p{{L}}\p{{M}}-]{{1,9}}\.\s){_W}(?:{_any(' '.join(ALWAYS.values()))})\.",
        rf"(?=\p{{L}}{{1,5}}\.\s){_W}(?:{_any(' '.join(NUMBERED.values()))})\.(?=\s+[(\[#]?\d)",
        # The title M. and initials, also joined ones; a label such as "site C." is none.
        # Whether initials are a name shows at their end, so no more than two starts are tried in a row of them.
        rf"(?=\p{{Lu}}\.){_W}(?<![.°])(?<!\p{{Lu}}\.[ -]?\p{{Lu}}\.[ -]?)(?<!\b(?:{_any(LABELS)}) )(?:\p{{Lu}}\.[ -]?)++(?=\s*\p{{Lu}}\p{{L}})",
        # Single Arabic letters and anything Ethiopic before a full stop are abbreviations.
        r"[ء-ي]\.(?=\s)(?<![\p{L}\p{M}][ء-ي]\.)",
        r"\.(?<=[ሀ-፿]\.)",
        # German ordinals.
        rf"(?=\d{{1,2}}\.\s){_W}\d{{1,2}}\.(?=\s+(?:{_any(ORDINAL_NOUNS)}))",
        r"(?=\d{1,2}\.\s)(?<=\b(?:[Aa]m|[Ii]m|[Vv]om|[Zz]um|[Zz]ur|[Dd]er|[Dd]en|[Dd]em|[Dd]es|[Dd]ie|[Dd]as|\d\. und) )\d{1,2}\.(?=\s+\p{Lu})",
        # Inside decimals, versions and names of files, and before .05 and .env.
        r"[.．](?=\p{Nd})(?<=\p{Nd}[.．])",
        r"\.(?=\w)(?<=[\p{L}\p{N}_\s/-]\.|^\.)",
        rf"．(?<=[{_LATIN}]．)(?=(?:{_any(ENDINGS + ' ' + _wide(ENDINGS))})(?![{_LATIN}]))",
        # A sole word before an ellipsis and a number goes on.
        r"(?=\p{Lu})(?<=^[\s*_]{0,6}|[.!?…。！？][^\p{L}]{0,6})\p{Lu}\p{L}* ?(?:\.{3}|…)(?=\s+\d)",
    )
)

_OPEN = r"[\"'“„«‹‘(\[{*_—–¿¡-]*+"
_CLOSE = r"(?:[\"'”’»›)\]}*_]|\[\d{1,3}\])*+"
_SMALL = rf"(?:{_any(SMALL)})\b|(?:next|so|then|now|also) (?:i|we|this|that|it)\b|i (?:\p{{Ll}}|'m)"
_NEW = rf"(?=\s)(?:(?!\s+{_OPEN}\p{{Ll}})|(?=\s+{_OPEN}(?:{_SMALL})))"
#: Cased scripts and those that use the same stops: a blank and no small letter follow.
STOPS = rf"(?<![.!?…])[.!?…]++{_CLOSE}{_NEW}"
_CJK = r"぀-ヿ㐀-鿿豈-﫿"
#: Stops that need no blank after them.
FULL = r"(?<![。！？．｡؟۔।॥።፧։။])[。！？．｡؟۔।॥።፧։။]++[!?]*+(?:[」』”’）】》〉)\]*_]|\[\d{1,3}\])*+(?=.)"
MIXED = rf"(?<=[{_CJK}])[!?]++(?:[」』”’）】》〉)\]*_]|\[\d{{1,3}}\])*+(?=\S)"
_GREEK = "Ͱ-Ͽἀ-῿"
GREEK = rf";{_CLOSE}{_NEW}"
#: What tells nothing of the language of a sentence: code, addresses, and names with a stop or the like in them.
UNSPOKEN = rf"``[^`]+``|`[^`]+`|(?<![^\s`])[^\s/\\_@:.{MASKS}]*+[/\\_@:.{MASKS}]\S*"
GREEK_WORD = rf"[{_GREEK}][\p{{L}}\p{{M}}]*+"
#: Words of other languages; names, with a capital, are in Greek sentences too.
OTHER_WORD = rf"(?<![\p{{L}}\p{{M}}])[\p{{Ll}}\p{{Lo}}&&[^{_GREEK}]][\p{{L}}\p{{M}}]*+"
THAI = r"(?<=[฀-๿])[ \u00a0]+(?=[฀-๿])"
#: A bracket that is a unit of its own: it opens after a border and closes after a stop.
OWN_BRACKET = (
    rf"((?:^|{BORDER}|(?<={BRACKET_END}))\s*[*_]*[(（\[][^{BORDER}{BRACKET_END}]*){BRACKET_END}"
    rf"([*_]*)(?=\s+(?!{_OPEN}\p{{Ll}})|\s+{_OPEN}(?:{_SMALL})|(?<=[）】][*_]{{0,3}})\S|(?<=[）】]{BRACKET_END})\S)"
)
#: A quotation that ends a sentence: what follows begins another.
END_QUOTE = (
    rf"{QUOTE_END}((?:[*_]|\[\d{{1,3}}\])*+)(?=\s+(?:{_OPEN}[\p{{Lu}}\p{{Lt}}\p{{N}}`]|{_SMALL}))"
)
LATIN_QUOTE = rf"(?<=[A-Za-z][{MASKS[0]}-{MASKS[-1]}]{{1,3}}[\"”»’]{QUOTE_END})([*_]*)(?=\s+\p{{Lo}})"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of a group whose sum is taken at once by ``_starts``.
GROUP = 64


def _sums(sizes: Column) -> Column:
    """What goes before each element of ``sizes``; the list grows by copies, so it must be short."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _sum(sizes: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(sizes, first + 1, n), F.lit(0), lambda acc, x: acc + x)


def _starts(parts: Column, *, less: str = "") -> Column:
    """The place of each part, counted in characters that belong to the text.

    Long lists are summed by groups first, and inside its group for each part: the work per part is
    bounded by GROUP, and only the short list of the groups' sums is made by copies.
    """
    size = lambda p: F.length(F.translate(p, less, "")) if less else F.length(p)

    def grouped(sizes: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(GROUP))
        return _let(
            _sums(F.transform(firsts, lambda at: _sum(sizes, at, F.lit(GROUP)))),
            lambda before: F.transform(
                sizes, lambda _, i: F.get(before, (i / GROUP).cast("int")) + _sum(sizes, i - i % GROUP, i % GROUP)
            ),
        )

    return _let(F.transform(parts, size), lambda sizes: F.when(F.size(sizes) <= GROUP, _sums(sizes)).otherwise(grouped(sizes)))


def _blocks(body: Column) -> Column:
    """Array of (at, block) of a cell body."""
    marked = F.regexp_replace(F.translate(body, USED, "\ufffd" * len(USED)), STRUCTURE, f"{BORDER}{NO_PROSE}$0{BORDER}")
    return F.split(marked, BORDER, -1)


def _masked(block: Column) -> Column:
    """``block`` with line breaks as blanks and the terminators of protected spans masked."""
    line = F.translate(block, "\r\n", "  ")
    spans = F.split(F.regexp_replace(line, PROTECTED, f"{SPAN}$0{SPAN}"), SPAN, -1)
    ended = r"[.!?…。！？．｡؟۔।॥።፧][ \u00a0\u202f]*"

    def mask(part: Column, i: Column) -> Column:
        closing = F.when(part.rlike(ended + r"[)）\]】]$"), BRACKET_END).when(
            part.rlike(ended + "[\"”“»«’」』]$"), QUOTE_END
        )
        return F.when(
            i % 2 == 1, F.concat(F.translate(part, TERMINATORS, MASKS), F.coalesce(closing, F.lit("")))
        ).otherwise(part)

    return F.array_join(F.transform(spans, mask), "")


def _asked(masked: Column) -> Column:
    """``masked`` with a border after every Greek question; most words since the last border are Greek in one."""

    def ask(piece: Column) -> Column:
        spoken = F.regexp_replace(piece, UNSPOKEN, " ")
        greek = F.regexp_count(spoken, F.lit(GREEK_WORD)) > F.regexp_count(spoken, F.lit(OTHER_WORD))
        return F.when(piece.contains(";") & greek, F.regexp_replace(piece, GREEK, f"$0{BORDER}")).otherwise(piece)

    return F.array_join(F.transform(F.split(masked, BORDER, -1), ask), BORDER)


def _bordered(masked: Column) -> Column:
    """``masked`` with a border after every sentence inside it."""
    s = F.regexp_replace(masked, STOPS, f"$0{BORDER}")
    s = F.when(s.rlike(r"[^\x00-ɏ]"), F.regexp_replace(F.regexp_replace(s, FULL, f"$0{BORDER}"), MIXED, f"$0{BORDER}")).otherwise(s)
    s = F.when(s.contains(";") & s.rlike(f"[{_GREEK}]"), _asked(s)).otherwise(s)
    s = F.when(s.rlike(r"[฀-๿]"), F.regexp_replace(s, THAI, f"{BORDER}$0")).otherwise(s)
    s = F.when(s.contains(BRACKET_END), F.regexp_replace(s, OWN_BRACKET, f"$1$2{BORDER}")).otherwise(s)
    return F.when(
        s.contains(QUOTE_END),
        F.regexp_replace(F.regexp_replace(s, LATIN_QUOTE, f"$1{BORDER}"), END_QUOTE, f"$1{BORDER}"),
    ).otherwise(s)


def restored(masked: Column) -> Column:
    """A text with its placeholders swapped back and its marks taken out."""
    plain = F.translate(masked, MASKS, TERMINATORS)
    return F.translate(plain, BORDER + NO_PROSE + SPAN + BRACKET_END + QUOTE_END, "")


def sentences(df: DataFrame, id_column: str, text_column: str, cells_column: str) -> DataFrame:
    """One row per sentence unit: ``id_column``, char_start, char_end (code points of the text), sentence.

    Only bodies of cells of the kind ``markdown`` count; null texts, cells and extents and empty bodies
    give no row, and neither do pieces without letter or digit. A cell is worked on as a whole, however
    long. Private-use characters that serve as marks are read as U+FFFD; ``sentence`` shows them so and
    has blanks for line breaks. Repeated rows give repeated units.
    """
    cell = F.filter(F.col(cells_column), lambda c: (c["kind"] == "markdown") & (c["char_end"] > c["char_start"]))
    bodies = F.transform(
        cell,
        lambda c: F.struct(
            c["char_start"].cast("bigint").alias("at"),
            F.substring(F.col(text_column), c["char_start"] + 1, c["char_end"] - c["char_start"]).alias("body"),
        ),
    )
    cells = df.select(F.col(id_column).alias("_id"), F.explode(bodies).alias("_c")).select("_id", "_c.at", "_c.body")
    parts = cells.select("_id", "at", _blocks(F.col("body")).alias("_parts"))
    parts = parts.withColumn("_starts", _starts(F.col("_parts"), less=NO_PROSE))
    block = F.transform(F.col("_parts"), lambda p, i: F.struct((F.col("at") + F.get(F.col("_starts"), i)).alias("at"), p.alias("block")))
    prose = F.filter(block, lambda b: ~b["block"].startswith(NO_PROSE) & b["block"].rlike(r"[\p{L}\p{N}]"))
    blocks = parts.select("_id", F.explode(prose).alias("_b")).select("_id", "_b.at", _masked(F.col("_b.block")).alias("_m"))
    units = blocks.select("_id", "at", F.split(F.translate(_bordered(F.col("_m")), BRACKET_END + QUOTE_END, ""), BORDER, -1).alias("_u"))
    units = units.withColumn("_starts", _starts(F.col("_u")))
    unit = F.transform(F.col("_u"), lambda p, i: F.struct((F.col("at") + F.get(F.col("_starts"), i)).alias("at"), p.alias("text")))
    rows = units.select("_id", F.explode(F.filter(unit, lambda u: u["text"].rlike(r"[\p{L}\p{N}]"))).alias("_r")).select("_id", "_r.at", "_r.text")
    blanks = F.lit(BLANKS)
    start = F.col("at") + F.length("text") - F.length(F.ltrim(F.col("text"), blanks))
    trimmed = F.trim(F.col("text"), blanks)
    return rows.select(
        F.col("_id").alias(id_column),
        start.alias("char_start"),
        (start + F.length(trimmed)).cast("bigint").alias("char_end"),
        restored(trimmed).alias("sentence"),
    )
