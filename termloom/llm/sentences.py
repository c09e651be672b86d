"""Sentence boundaries across languages and scripts, in SQL expressions.

Characters that look like an end of sentence and are none (in numbers, host and file
names, initials, abbreviations, quotations inside a running sentence) are masked by
private-use placeholders of the same length, boundaries are marked behind terminators
by regular expressions for each kind of script, and the text is cut at the marks.
Since masking keeps every offset, the sentences are restored from the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = ""  # boundary
DOT, ASK, CALL, STOP = "", "", "", ""  # masked . ? ! and any other terminator
OPEN, CLOSE = "", ""  # straight quotes, once it is known which they are

# Names of the languages whose abbreviations are known.
LANGUAGES = {
    "ca": ("ca", "cat", "catalan"), "de": ("de", "deu", "ger", "german"), "en": ("en", "eng", "english"), "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"), "pl": ("pl", "pol", "polish"),
}
# Words by which a text without a stated language is taken for one.
FREQUENT = {
    "ca": "els les amb dels és una pel per això", "de": "der die das und ist nicht ein eine mit", "en": "the of and is to this with that",
    "es": "el los las una con del por para que", "fr": "le les des une est dans avec par pour", "pl": "i w z na jest się nie że oraz",
}
# Titles that no language has as a word; others, by language.
TITLES = "Dr Dra Drs Prof Profa Mr Mrs Ms Mx Sra Srta Sr Mme Mlle Dipl Ing"
TITLES_OF = {
    "ca": "Sta St", "de": "Hr Fr Mag St Gen", "en": "St Ste Gen Col Lt Sgt Capt Rev Hon Sen Rep", "es": "Sta Gral Lic Cap", "fr": "St Ste MM",
    "pl": "dr prof mgr inż doc ks abp bp lic hab św gen Ks Doc",
}
# Abbreviations that are no words and go on whatever follows; others, by language.
ALWAYS = "vs cf viz approx aprox env resp bzw sog evtl ggf inkl exkl vgl zzgl tzn tzw m.in zob"
ALWAYS_OF = {
    "ca": "", "de": "ca siehe Abb Tab Nr Nrn Abs Kap Bd Bde Aufl Anm Art", "en": "ca Fig Figs Eq Eqs Ref Refs", "es": "núm nº pág págs av avda apdo párr art",
    "fr": "ca chap art", "pl": "np tj por ok pow wg rys ust pkt rozdz poz str art ca",
}
# Words that abbreviate something only before its number or letter, in any language.
NUMBERED = (
    "fig figs abb tab sec sect vol vols app ex eq eqs ref refs nr nrn abs art kap bd bde aufl anm chap chapt núm nº pág págs pàg pàgs pp rys str poz ust "
    "pkt rozdz cap caps apdo párr av avda ca ok pow circa siehe np tj por wg col"
)
# The same in letters, written with blanks or without.
ALWAYS_SPACED = ("e.g", "i.e", "z.B", "d.h", "u.a", "u.U", "z.T", "o.Ä", "o.g", "s.o", "s.u", "p.ej", "p.ex", "c.-à-d", "m.in", "m.a.W", "i.d.R", "v.a")
# Abbreviations that go on before a number only.
BEFORE_NUMBER = "No Nos Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Jän Okt Dez p S s n".split()
# Nouns whose single-letter name may end a sentence.
LETTERED = (
    "type types tipo tipos tipus typ typu typen class classe clase klasse klasa group grup grupo gruppe groupe grupa grade vitamin vitamina "
    "vitamine witamina witaminy plan option opción version annex anexo annexe section part hepatitis punkt point punto figure serie series"
).split()
# Short words of the supported languages that introduce a name.
INTRODUCING = (
    "by to of and with from for von vom und mit nach laut bei de del y e i con por según segons selon par et avec d' "
    "według wg przez z od"
).split()
# German words before an ordinal number.
BEFORE_ORDINAL = "im am dem den der das des die vom zum zur beim ab bis seit ein eine einem einen eines jede jeder jedes jeden jedem".split()
# Devanagari and Arabic abbreviations.
OTHER_SCRIPTS = "डॉ श्री प्रो पं मि.ग्रा कि.ग्रा कि.मी से.मी मि.मी मि.ली ई.पू द أ م ص ج ت ه".split() + ["د"]

WHITE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CLOSERS = r"\"'”’»)\]}›」』】）》〉〕" + CLOSE
DASHES = r"\-‐‑‒–—"


def _mask(text: Column, pattern: str, into: str) -> Column:
    return F.regexp_replace(text, pattern, into)


def _either(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True))


def _no_end(lang: str | None) -> str:
    """Pattern of a full stop that ends no sentence, whatever the text around it was split into.

    ``lang`` adds the abbreviations that are words in other languages. Every alternative
    looks back from the dot, so that nothing is tried at other characters.
    """
    sp = r"[ \x{A0}]"
    # before a word may stand letters of scripts without case, but none of its own
    start = r"(?<![\p{Lu}\p{Ll}\p{M}\p{Nd}])"
    spaced = [w.split(".") for w in ALWAYS_SPACED]
    lettered = rf"(?<!(?<![\p{{L}}])(?i:{'|'.join(LETTERED)}){sp}\p{{Lu}}\.)"
    initial = r"(?<=(?<![\p{L}\p{Nd}.])\p{Lu}\.)"
    introduced = rf"(?<=(?:^|[.!?…]\s|\n|[(«“„‘]|(?<![\p{{L}}])(?i:{'|'.join(INTRODUCING)}){sp})\p{{Lu}}\.)"
    titles = TITLES_OF.get(lang, "St").split()
    always = f"{ALWAYS} {ALWAYS_OF.get(lang, '')}".split()
    inside = r"(?!\s*(?:\n\s*\n|\z))"
    rules = [
        rf"(?={sp}?\.)",  # an ellipsis ends with its last dot
        r"(?<=\p{Nd}\.)(?=\p{Nd})",  # numbers, versions
        # host and file names, abbreviations without blanks: a plain lower-case letter follows
        r"(?<=[\p{L}\p{M}\p{Nd}]\.)(?=\p{Ll})(?!\p{Ll}{1,3}\p{Lu})",
        r"(?<=(?<![\p{L}])\p{L}{1,2}\.)(?=\p{Lu}\.)",  # acronyms
        r"(?<=(?<![\p{L}])Ph\.)(?=D)",
        r"(?<=[\u0E00-\u0E7F]\.)",  # Thai has no full stop
        r"(?<=[\u0900-\u097F]\.)(?=[\u0900-\u097F])",
        rf"(?<=(?<![\u0900-\u097F\u0600-\u06FF])(?:{_either(OTHER_SCRIPTS)})\.)",
        # spaced abbreviations: any dot but the last, then the last
        rf"(?<={start}(?i:{_either(sorted({p[0] for p in spaced}))})\.)(?={sp}?(?i:" + _either(sorted({".".join(p[1:]) for p in spaced})).replace(r"\.", rf"\.{sp}?") + r")\.)",
        rf"(?<={start}(?i:" + "|".join(rf"\.{sp}?".join(p) for p in spaced) + r")\.)",
        rf"(?<={start}(?:(?i:{_either(TITLES.split())})|{_either(titles)})\.){inside}",
        rf"(?<={start}(?:[dlDL]['’])?(?i:{_either(always)})\.){inside}",
        rf"(?<={start}(?:[dlDL]['’])?(?i:{_either(NUMBERED.split())})\.)(?=\s*(?:\p{{Nd}}|\p{{Lu}}(?![\p{{L}}])|[IVXLC]+(?![\p{{L}}])))",
        rf"(?<={start}(?:et|i){sp}al\.){inside}",
        rf"(?<={start}(?:{_either(BEFORE_NUMBER)})\.)(?=\s*\p{{Nd}})",
        rf"(?<={start}[pP]\.)(?={sp}?(?:ex|ej)\b)",
        rf"(?<={start}EE\.)(?={sp}?UU)",
        rf"(?<={start}[ap]\.)(?={sp}?m\.)",
        rf"(?<={start}MM?\.)(?={sp}\p{{Lu}})",  # French "M." before a name
        # German ordinals
        rf"(?<=(?<![\p{{L}}])(?i:{'|'.join(BEFORE_ORDINAL)}){sp}\p{{Nd}}{{1,2}}\.)(?={sp}\p{{L}})",
        # initials: before another, after another, after a capitalised or introducing word or first in the
        # sentence; not after a noun that is named by letters
        rf"{initial}{lettered}(?={sp}?[{DASHES}]?\p{{Lu}}\.)",
        rf"(?<=(?<![\p{{L}}])\p{{Lu}}\.[ \x{{A0}}{DASHES}]\p{{Lu}}\.)(?={sp}\p{{Lu}})",
        rf"{initial}(?={sp}\p{{Lu}}\p{{Ll}}){introduced}{lettered}",
    ]
    return r"\.(?:" + "|".join(rules) + ")"


NO_END = {lang: _no_end(lang) for lang in (None, *LANGUAGES)}
_SP = r"[ \x{A0}]"
# a number that begins a line; an initial between a capitalised word and another, but for nouns that are named by letters
_LINE_NUMBER = rf"((?:^|\n){_SP}*+\p{{Nd}}{{1,2}})\.(?={_SP}\p{{L}})"
_MIDDLE_INITIAL = rf"(?<![\p{{L}}\p{{M}}])(?!(?i:{'|'.join(LETTERED)}){_SP})(\p{{Lu}}\p{{Ll}}++{_SP}\p{{Lu}})\.(?={_SP}\p{{Lu}}\p{{Ll}})"


def language_of(text: Column, lang: Column) -> Column:
    """Two-letter code of a stated language, or if none is stated that of whose frequent words the text has most; else null."""
    stated = F.lower(F.trim(F.coalesce(lang.cast("string"), F.lit(""))))
    votes = F.array_max(
        F.array(*[F.struct(F.regexp_count(text, F.lit(rf"(?i)(?<![\p{{L}}])(?:{words.replace(' ', '|')})(?![\p{{L}}])")).alias("n"), F.lit(code).alias("code")) for code, words in FREQUENT.items()])
    )
    known = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        known = F.when(stated.isin(*names), code).otherwise(known)
    return F.when(stated != "", known).otherwise(F.when(votes["n"] > 0, votes["code"]))


def _prepared(text: Column) -> Column:
    t = F.translate(text, MARK, "\uE0FE")
    # straight double quotes open and close in turn within a paragraph
    t = F.regexp_replace(t, r'"([^"\n]*)"', f"{OPEN}$1{CLOSE}")
    t = F.regexp_replace(t, _LINE_NUMBER, f"$1{DOT}")
    return F.regexp_replace(t, _MIDDLE_INITIAL, f"$1{DOT}")


def _masked(t: Column, lang: Column) -> Column:
    masked = F.regexp_replace(t, NO_END[None], DOT)
    for code in LANGUAGES:
        masked = F.when(lang == code, F.regexp_replace(t, NO_END[code], DOT)).otherwise(masked)
    t = masked
    # a quotation before more of its sentence: in scripts without case it ends one only if a colon leads to it
    return F.regexp_replace(
        t,
        r"(?<![:：][ \x{A0}]?)([“「『«" + OPEN + r"][^“”「」『』«»\n]*?)[。！？।॥؟!?.…]"
        r"(?=[ \x{A0}]?[”」』»" + CLOSE + r"][ \x{A0}]?[\p{Lo}\p{M}]|」と)",
        f"$1{STOP}",
    )


def _marked(t: Column) -> Column:
    # “ closes where „ opens
    closers = CLOSERS
    late = F.when(F.contains(t, F.lit("„")), _ends(t, closers + "“", "«„‘")).otherwise(_ends(t, closers, "«“„‘"))
    # scripts with terminators of their own need no blank
    late = F.regexp_replace(late, rf"([。！？｡।॥؟۔]+[{closers}]*)(?!{MARK})", f"$1{MARK}")
    late = F.regexp_replace(late, rf"(…+[{closers}]*)(?=\p{{Lo}})", f"$1{MARK}")
    # Thai: a blank between letters
    thai = r"[ก-ฺเ-๎]"
    late = F.regexp_replace(late, rf"(?<={thai})([ \t  - 　]+)(?={thai})", f"{MARK}$1")
    # blank lines
    return F.regexp_replace(late, r"(?:\r\n|\n|\r)[^\S\n\r ]* *[^\S\n\r]*(?:\r\n|\n|\r)", f"{MARK}$0")


def _ends(t: Column, closers: str, openers: str) -> Column:
    """Marks behind terminators of scripts with case, and of others that use them."""
    cluster = rf"[.!?…]+(?:[   ]?[»›])?[{closers}]*"
    # after white space: a lower-case word or a sign that carries on doesn't begin a sentence
    later = rf"(?=[{WHITE}]+(?:[\p{{Ll}}]{{1,3}}\p{{Lu}}|[^\p{{Ll}}{WHITE},;:)\]}}»”’…{DASHES}]))"
    t = F.regexp_replace(t, f"({cluster}){later}", f"$1{MARK}")
    # without white space: a capital, an opening sign; for a full stop a number only after a word
    close = rf"(?<![{MARK}])"
    t = F.regexp_replace(t, rf"({cluster}){close}(?=[\p{{Lu}}¿¡(\[{openers}{OPEN}]|\p{{Ll}}{{1,2}}\p{{Lu}})", f"$1{MARK}")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{M}]{3})(\.)(?=\p{Nd})|([!?…])(?=\p{Nd})", f"$1$2{MARK}")
    return F.regexp_replace(t, rf"([.!?][{closers}]*)(?=[؀-ۿ])|([!?][{closers}]*)(?=[\p{{Lo}}])", f"$1$2{MARK}")


def sentences(df: DataFrame, *, id_col: str, text: str, lang: str | None = None) -> DataFrame:
    """Every sentence of every text: id_col, sent_start, sent_end, sentence.

    ``lang`` is the column of the language (code or English name), which decides about
    abbreviations that are words elsewhere; where it is null, frequent words do.
    Offsets are in code points; white space around a sentence belongs to none. Null,
    empty and blank texts have no sentence; a text without any terminator is one. The
    only thing a row's length costs is its own expression; nothing is shuffled.
    """
    parts = F.split(F.col("__m"), MARK, -1)
    # start of each part: lengths summed up within its row
    starts = F.aggregate(
        F.col("__p"),
        F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("sum")),
        lambda acc, p: F.struct(F.array_append(acc["at"], acc["sum"]).alias("at"), (acc["sum"] + F.length(p)).alias("sum")),
    )["at"]
    cut = (
        df.select(F.col(id_col), F.col(text).alias("__t"), (F.col(lang) if lang else F.lit(None)).alias("__stated"))
        .where(F.col("__t").isNotNull())
        .withColumn("__lang", language_of(F.col("__t"), F.col("__stated")))
        .withColumn("__m", _prepared(F.col("__t")))
        .withColumn("__m", _masked(F.col("__m"), F.col("__lang")))
        .withColumn("__m", _marked(F.col("__m")))
        .withColumn("__p", parts)
        .select(id_col, "__t", F.explode(F.arrays_zip(F.col("__p").alias("part"), starts.alias("at"))).alias("__s"))
        .select(
            id_col,
            "__t",
            F.col("__s.at").alias("__at"),
            F.col("__s.part").alias("__part"),
            F.regexp_replace("__s.part", r"(?U)^\s+", "").alias("__left"),
        )
        .select(
            id_col,
            "__t",
            (F.col("__at") + F.length("__part") - F.length("__left")).alias("sent_start"),
            F.regexp_replace("__left", r"(?U)\s+\z", "").alias("__body"),
        )
        .where(F.col("__body") != "")
        .withColumn("sent_end", F.col("sent_start") + F.length("__body"))
    )
    return cut.select(id_col, "sent_start", "sent_end", F.expr("substring(__t, sent_start + 1, sent_end - sent_start)").alias("sentence"))
