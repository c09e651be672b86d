"""Template residue and error pages.

Unfilled placeholders. A placeholder is residue unless its sentence is about it (the
nouns that lead to it tell). Texts are aligned at the words beside such a placeholder:
where other records fill the position, it is a slot, and the placeholder is residue too.
A variable's name, a default or nothing is residue in a slot that other records fill.

Whole pages. Pages are cut into blocks, menus, footers, headings
and markup are taken away, and blocks are aligned by their skeletons (numbers, quoted
names and paths made slots). A page is residue if each block left is a message, filler,
or a skeleton that recurs on message pages and hardly anywhere else.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.skew import grid_join
from termloom.runtime import checkpointed

# Shapes of placeholders of common template languages, defaults and blanks.
# letters of scripts without blanks are in none but double delimiters: "5%和10%", "<红楼梦>"
_NAME = r"[\p{L}_&&[^\p{Lo}]][\p{L}\p{M}\p{N}_.&&[^\p{Lo}]]*+"
_WORDS_IN = r"[\p{L}_][\p{L}\p{M}\p{N}_.\- ]*+"
PLACEHOLDERS = [
    rf"\{{\{{\{{?\s*{_WORDS_IN}\s*\}}?\}}\}}",
    rf"\{{%-?\s*{_NAME}\s*-?%\}}",
    rf"<%=?\s*{_NAME}\s*%>",
    rf"[$#]\{{\s*{_WORDS_IN}\s*\}}",
    rf"\{{(?:{_NAME}|[0-9]{{1,2}})\}}",
    rf"%\({_NAME}\)[sdf]",
    rf"%{_NAME}%",
    r"%(?:[0-9]{1,2}\$)?[sd](?![\p{L}\p{N}&&[^\p{Lo}]])",
    r"\$[\p{L}_&&[^\p{Lo}]][\p{L}\p{M}\p{N}_&&[^\p{Lo}]]{2,}+\$",
    r"@@[\p{L}\p{M}\p{N}_]++@@",
    r"(?<![A-Za-z0-9_])__[\p{L}](?:[\p{L}\p{M}\p{N}_]*?)__(?![A-Za-z0-9_])",
    rf"<<\s*{_WORDS_IN}\s*>>",
    rf"&lt;{_NAME}&gt;",
    r"<(?!/?(?i:a|abbr|article|aside|b|blockquote|body|br|button|caption|center|cite|code|col|dd|div|dl|dt|em|figure|font|footer|form|h[1-6]"
    r"|head|header|hr|html|i|img|input|label|li|link|main|meta|nav|noscript|ol|option|p|pre|q|s|script|section|select|small|span|strong"
    r"|style|sub|sup|table|tbody|td|textarea|tfoot|th|thead|tr|u|ul|var|wbr)\b)" + _NAME + ">",
    rf"\[\[\s*{_WORDS_IN}\s*\]\]",
    r"\[(?!sic\]|\.\.\.\]|…\])\p{L}[^\s\[\]]*+(?:[ ][^\s\[\]]++){0,4}\]",
    r"\[(?i:insert|enter|add|type|fill|put|replace|your|please|hier|bitte|ihre?|insérer|saisir|votre|à|insertar|introduzca|su|por|inseriu|uzupełnić|wpisz)\b[^\[\]\n]*+\]",
    r"\([\p{L}_][^()\n]* goes here\)",
    r"(?<![A-Za-z0-9_])_{3,}(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9])X{3,}(?![A-Za-z0-9])",
    r"#(?:REF|NAME|VALUE|DIV/0)[!?]",
    r"(?<![A-Za-z0-9])(?:undefined|NaN)(?![A-Za-z0-9])",
]
PLACEHOLDER = "(?:" + "|".join(PLACEHOLDERS) + ")"
_ONE = r"\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}|\p{IsThai}"
_REST = rf"|{_ONE}|[\p{{L}}\p{{M}}&&[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}]]+|\p{{N}}+|[^\s\p{{L}}\p{{M}}\p{{N}}]"


# what any placeholder needs, cheap to look for
_QUICK = r"[{\[<$@#_]|%[\p{L}_(0-9]|&lt;|goes here|XXX|undefined|NaN"
_PLAIN = _REST[1:]
TOKEN = PLACEHOLDER + _REST

# What a slot can hold that was never filled, though it has no shape of its own. Nouns of fields, as defaults and variables
# are called by them; variable names; and the blank that an empty value leaves before a comma or stop, between words or after a colon.
_FIELD = (
    r"name|names|company|client|customer|contact|recipient|employee|user|username|title|subject|date|address|street|city|country|email|phone|number"
    r"|amount|price|product|company|position|department|organi[sz]ation|author|website|firma|kunde|kunden|datum|titel|anschrift|adresse|ort|nom|prénom"
    r"|société|titre|ville|nombre|empresa|cliente|fecha|título|dirección|ciudad|empresa|client|data|títol|adreça|nazwa|imię|nazwisko|klient|tytuł|adres"
)
_DEFAULT = rf"(?:(?:\p{{Lu}}\p{{L}}*[ ]){{0,3}}(?=\p{{Lu}})(?i:{_FIELD})(?![\p{{L}}\p{{N}}_])|(?:John|Jane) Doe\b|(?:Max|Erika) Mustermann\b)"
_VARIABLE = r"\p{L}+(?:_[\p{L}\p{N}]+)+|\p{Ll}{2,}(?:\p{Lu}\p{Ll}+)+"
SUSPECT = rf"(?<![\p{{L}}\p{{N}}_.@/:\-])(?:(?:{_VARIABLE})(?![\p{{L}}\p{{N}}_@/:(\-])|{_DEFAULT})"
_BLANK = r"(?<=[\p{L}\p{N}])[ \t]+(?=[,.](?:\s|$))|(?<=\p{L})[ \t]{2,}(?=\p{L})|(?<=:)[ \t]*(?=\r?\n|$)"
EMPTY = "\uE0FC"


def _has_placeholder(text: Column) -> Column:
    return text.rlike(_QUICK) & text.rlike(PLACEHOLDER)


# Nouns of what a placeholder, a code or a set is called, where the text talks about it; what may stand between.
_MENTION = (
    r"placeholders?|platzhaltern?s?|marcador(?:es)?|espaces? réservés?|symbole?s? zastępcz\p{L}+|variablen?s?|zmienn\p{L}+|tokens?|jetons?|fichas?"
    r"|parameters?|parametern?s?|paramètres?|parámetros?|paràmetres?|parametr\p{L}*|markers?|strings?|tags?|keywords?|escapes?|codes?|expressions?"
    r"|cells?|zellen?|cellules?|celdas?|cel·les?|komórk\p{L}+|intervals?|intervalls?|intervalles?|intervalos?|sets?|mengen?|ensembles?|conjuntos?"
    r"|(?:columns?|spalten?|colonnes?|columnas?|columnes?|kolumn\p{L}+) (?:headed|named|called|labelled|namens|intitulée?s?|llamadas?|tituladas?)"
    r"|変数|プレースホルダー?|变量|占位符"
)
_BETWEEN = r"such as|like|namely|called|named|and|or|wie|und|oder|namens|comme|tels? que|et|ou|nommée?s?|como|tales como|y|o|llamad[oa]s?|com|i|lub|jak|[,;\"'`“”„«»‘’]"
_MENTIONED = rf"(?iu)(?<!\p{{L}})(?:{_MENTION})(?: (?:{_BETWEEN}|{PLACEHOLDER}))*$"
_MENTIONED_AFTER = r"(?iu)^(?:[\"'`”»’] )?(?:in|within|between|entre|dans|en|między|w) (?:(?:square|curly|angle|eckigen|geschweiften|spitzen) )?(?:brackets|braces|klammern|crochets|accolades|corchetes|llaves|claudàtors|nawias\p{L}*)"
_FILL, _SIDE = 4, 3  # most tokens of a fill; tokens to either side by which texts are aligned


def _tokens(texts: DataFrame) -> DataFrame:
    """``texts`` with their tokens, padded on both sides."""
    pad = lambda n: F.array_repeat(F.lit(""), n)
    # only texts that hold a placeholder need the pattern that knows them
    found = F.when(_has_placeholder(F.col("text")), F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1))).otherwise(
        F.regexp_extract_all("text", F.lit(f"({_PLAIN})"), F.lit(1))
    )
    return texts.withColumn("__tok", F.concat(pad(_SIDE), found, pad(_FILL + _SIDE - 1)))


def _is_hole(token: Column) -> Column:
    return token.rlike(_QUICK) & token.rlike(rf"^{PLACEHOLDER}$")


def _frame(k: int) -> Column:
    """The tokens to either side of a fill of ``k`` tokens, of the window t."""
    return F.concat_ws(" ", F.slice("t", 1, _SIDE), F.lit("\uE0FD"), F.slice("t", _SIDE + k + 1, _SIDE))


def _holes(texts: DataFrame) -> DataFrame:
    """key, pos, frame, value, shaped and mentioned of the placeholders and suspects in ``texts`` (key, text).

    mentioned: whether the sentence is about the placeholder. Suspects have no shape of
    placeholders; the value of an empty one is EMPTY.
    """
    marked = F.regexp_replace("text", _BLANK, EMPTY)
    token = f"({PLACEHOLDER}|{SUSPECT}{_REST})"
    tokens = texts.select("key", F.regexp_extract_all(marked, F.lit(token), F.lit(1)).alias("__tok"))
    at = lambda i: F.coalesce(F.get("__tok", i), F.lit(""))
    hole, pos = _is_hole(F.col("t")), F.col("pos")
    rows = tokens.select("key", "__tok", F.posexplode("__tok").alias("pos", "t")).withColumn("shaped", hole)
    rows = rows.where(F.col("shaped") | F.col("t").rlike(rf"^(?:{SUSPECT}|{EMPTY})$"))
    before = F.array_join(F.expr("slice(__tok, greatest(pos - 11, 1), least(pos, 12))"), " ")
    after = F.array_join(F.expr("slice(__tok, pos + 2, 4)"), " ")
    return rows.select(
        "key",
        "pos",
        F.concat_ws(" ", *[at(pos - j) for j in range(_SIDE, 0, -1)], F.lit("\uE0FD"), *[at(pos + j) for j in range(1, _SIDE + 1)]).alias("frame"),
        F.col("t").alias("value"),
        "shaped",
        (before.rlike(_MENTIONED) | after.rlike(_MENTIONED_AFTER) | ((at(pos - 1) == "`") & (at(pos + 1) == "`"))).alias("mentioned"),
    )


def _fills(texts: DataFrame, frames: DataFrame, broadcast_limit: int) -> DataFrame:
    """frame, key, fill: what stands in ``frames`` (frame) in the texts, placeholders and suspects aside; up to four tokens.

    A first pass over all texts keeps only hashes of three successive tokens and their
    places; texts are looked at closely at the places where such a hash begins a frame.
    """
    frames = checkpointed(frames.distinct())
    few = frames.limit(broadcast_limit + 1).count() <= broadcast_limit
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df.hint("merge"))
    left = frames.select(F.xxhash64(F.split("frame", " \uE0FD ")[0]).alias("left")).distinct()
    width = _FILL + 2 * _SIDE
    starts = F.expr(f"transform(sequence(1, size(__tok) - {width - 1}), i -> xxhash64(array_join(slice(__tok, i, {_SIDE}), ' ')))")
    places = (
        _tokens(texts)
        .where(F.size("__tok") >= width)
        .select("key", F.posexplode(starts).alias("pos", "left"))
        .join(near(left), "left", "left_semi")
        .groupBy("key")
        .agg(F.collect_list("pos").alias("places"))
    )
    framed = F.array(
        *[
            F.when(
                ~F.array_contains(F.transform(F.slice("t", _SIDE + 1, k), _is_hole), True),
                F.struct(_frame(k).alias("frame"), F.concat_ws(" ", F.slice("t", _SIDE + 1, k)).alias("fill")),
            )
            for k in range(1, _FILL + 1)
        ]
    )
    return (
        _tokens(texts.join(places.hint("merge"), "key"))
        .select("key", F.explode(F.expr(f"transform(places, i -> slice(__tok, i + 1, {width}))")).alias("t"))
        .select("key", F.explode(F.array_compact(framed)).alias("x"))
        .select("key", "x.frame", "x.fill")
        .join(near(frames), "frame", "left_semi")
        .where(~F.regexp_replace("fill", " _ ", "_").rlike(rf"^(?:{SUSPECT})$"))
    )


def unfilled(texts: DataFrame, *, records: int = 3, filled: float = 0.1, broadcast_limit: int = 200_000) -> DataFrame:
    """Keys of texts with a slot that was never filled. ``texts``: key (equal for equal texts), text.

    Texts are aligned by the three tokens to either side of a position. A placeholder is
    literal if its sentence is about it: a noun for placeholders, codes or sets leads to
    it, or it is said to be in brackets, or it stands in backticks; unless more than
    ``filled`` of the different texts aligned there hold something else. Any other
    placeholder is residue. That verdict asks for no number of texts.

    A position is a slot if at least ``records`` different texts fill it in two or more
    ways. A variable's name or nothing in a slot is residue if not more texts have that
    than fill it; a default, called by the noun of a field, if no fill is more common.
    """
    texts = texts.dropDuplicates(["key"])
    mark = F.col("text").rlike(SUSPECT) | F.col("text").rlike(_BLANK)
    holes = checkpointed(_holes(texts.where(_has_placeholder(F.col("text")) | mark)))
    mentioned, suspects = holes.where("shaped and mentioned"), holes.where("not shaped")
    fills = checkpointed(_fills(texts, mentioned.unionByName(suspects).select("frame"), broadcast_limit).distinct())
    per_fill = fills.groupBy("frame", "fill").agg(F.count("*").alias("n"))
    slots = per_fill.groupBy("frame").agg(F.max("n").alias("most"), F.count("*").alias("ways")).join(
        fills.groupBy("frame").agg(F.count_distinct("key").alias("fills")).hint("merge"), "frame"
    )
    stand = mentioned.groupBy("frame").agg(F.count_distinct("key").alias("holes"))
    filled_slots = stand.join(slots.hint("merge"), "frame").where(F.col("fills") > filled * (F.col("holes") + F.col("fills"))).select("frame")
    default = F.col("value").rlike(rf"^{_DEFAULT}$")
    left = (
        suspects.groupBy("frame", "value").agg(F.count_distinct("key").alias("times"))
        .join(suspects.groupBy("frame").agg(F.count_distinct("key").alias("unfilled")).hint("merge"), "frame")
        .join(slots.hint("merge"), "frame")
        .where((F.col("fills") >= records) & (F.col("ways") >= 2))
        .where(F.when(default, F.col("times") >= F.col("most")).otherwise(F.col("unfilled") <= F.col("fills")))
        .select("frame", "value")
    )
    return (
        holes.where("shaped and not mentioned")
        .select("key")
        .unionByName(mentioned.join(filled_slots.hint("merge"), "frame", "left_semi").select("key"))
        .unionByName(suspects.join(left.hint("merge"), ["frame", "value"], "left_semi").select("key"))
        .distinct()
    )


# Words by which a page can be a message, in the languages of the corpus.
CUE = (
    r"(?i)error|fehler|erreur|erro\b|błąd|błęd|not found|forbidden|gateway|denied|unavailable|no longer available|expired|too many requests"
    r"|went wrong|try again|looks broken|can.?t find|could not|traceback|exception|javascript|scripts?\b|skripte|cookies|checking your browser"
    r"|no existe|no se ha|no s.ha trobat|introuvable|nicht gefunden|nicht erreichbar|verweigert|refusé|denegado|znaleziono|wystąpił"
    r"|エラー|見つかりません|错误|未找到|无法|त्रुटि|خطأ"
)
_CUE = re.compile(CUE)
# Whole messages, matched within a sentence from which quotations are taken.
MESSAGE = re.compile(
    r"\b(?:error|fehler|erreur|błąd)\s*\d{3}\s*(?:[.:)]|$)|^\W*\d{3}\s+(?:not found|forbidden|bad gateway|unauthorized|internal server error|service unavailable|gateway time)"
    r"|\bhttp (?:status|error) \d{3}|\((?:error|erreur|fehler|błąd) \d{3}\)"
    r"|\btraceback \(most recent call last\)|\bfatal error: |\buncaught (?:type|reference)?error|could not connect to (?:the )?database|\berrno \d"
    r"|\baccess denied\b|do not have permission to|session has expired|domain has expired|service (?:is )?(?:temporarily )?unavailable"
    r"|something went wrong|an (?:unexpected )?error (?:has )?occurred|please try again later|too many requests|link looks broken"
    r"|can.?t find that page|page you (?:asked|are looking) for|has been removed or is no longer available|page (?:does not exist|not found)"
    r"|(?:página|página solicitada) no (?:existe|encontrada)|no se ha encontrado el recurso|ha producido un error|página no encontrada"
    r"|no s.ha trobat la pàgina|error intern del servidor|page introuvable|erreur est survenue|accès refusé\s*:|seite wurde nicht gefunden"
    r"|dienst ist (?:vorübergehend )?nicht erreichbar|zugriff verweigert|nie znaleziono strony|wystąpił błąd|ページが見つかりません|页面(?:不存在|未找到)"
    r"|(?:enable|activate|turn on|allow|activer|activez|aktivieren sie|activar|active|włącz(?: obsługę)?)\b[\w\s]{0,20}(?:javascript|scripts)"
    r"|javascript (?:is|must be|ist|est|está) (?:disabled|off|required|enabled|deaktiviert|erforderlich|désactivé|requis|desactivado)"
    r"|scripts? (?:is |are )?required|needs scripts|scripts (?:soient|sont) |führt keine skripte|no admite scripts|checking your browser|noscript version",
    re.I,
)
# Sentences that carry on a message.
FOLLOW = re.compile(
    r"^(?:it may have been moved|activate it and reload|(?:please )?(?:re)?try (?:again|later)|retry in|ref(?:erence)?\b|request id|log in again|please allow cookies"
    r"|your browser has them switched off|diese anwendung setzt sie voraus|vuelva a intentarlo|veuillez réessayer|bitte versuchen|you do not have permission"
    r"|file \"|\w*error: )",
    re.I,
)
# Filler words and phrases.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris laborum nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate "
    "velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est".split()
)
FILLER = re.compile(
    r"sample text(?: for this block)?|text goes here|your (?:content|text|title|name) here|(?:todo|tbd|fixme)\b\s*:[^.!?\n]*|your (?:content|text) (?:will appear|goes)(?: in this area| here)?|insert text here|placeholder text"
    r"|texto de (?:ejemplo|relleno|muestra)|aquí va el texto|texte d.exemple|votre texte ici|texte de remplissage|text de mostra|text d.exemple"
    r"|aquí va el text|platzhaltertext|hier steht ein blindtext|blindtext|beispieltext|mustertext|tekst przykładowy|tu wpisz tekst|示例文本|サンプルテキスト",
    re.I,
)
FILLER_WORDS = frozenset("asdf jkl qwert qwerty blah bla foo bar baz test abc xyz xxx".split())
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MENU = re.compile(r"[^\W\d_][\w\-]*(?:[ \t]*[|·>/•›»][ \t]*[^\W\d_][\w\-]*){2,}")
_FOOTER = re.compile(r"(?:©|\(c\)|copyright)\s*\d{4}(?:\s+\w+)?", re.I)
_SKIP = re.compile(r"\bskip to (?:main )?content\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)]*\s+(?=[^\W\d_a-zà-ÿ]|[a-z]+ (?:[a-z]+ )?|\d)")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|‘[^’\n]*’|「[^」\n]*」|『[^』\n]*』")
_SLOT = re.compile(r"\"[^\"]*\"|'[^']*'|/\S+|(?<![A-Za-z0-9_])[A-Za-z_]*\d[A-Za-z0-9_]*|\w+_\w+")
_WORDS = re.compile(r"[^\W\d_]+")

# What any match of MESSAGE or FILLER holds, of which a page is told cheaply that neither can match.
MESSAGE_PARTS = (
    "error", "fehler", "erreur", "błąd", "not found", "forbidden", "bad gateway", "unauthorized", "unavailable", "gateway time", "http ", "traceback",
    "could not connect to", "errno ", "access denied", "do not have permission to", "has expired", "something went wrong", "please try again later",
    "too many requests", "link looks broken", "t find that page", "page you ", "no longer available", "page does not exist", "no existe", "encontrad",
    "ha trobat la p", "introuvable", "refusé", "nicht gefunden", "nicht erreichbar", "verweigert", "nie znaleziono", "見つかりません", "页面", "script", "skripte",
    "checking your browser",
)
FILLER_PARTS = ("text", "tekst", "content", "title here", "name here", "todo", "tbd", "fixme", "文本", "テキスト")

STRONG, FILLING, PLAIN, WHOLE = "strong", "filling", "plain", "whole"
PAGE_WORDS = 3  # words outside slots without which a page's longest block says nothing


def _is_filler(block: str, phrases: bool = True) -> bool:
    """Whether nine tenths of a block's words are filler phrases, repeated filler words or filler Latin."""
    words = _WORDS.findall(block.lower())
    rest = _WORDS.findall(FILLER.sub(" ", block).lower()) if phrases else words
    covered = len(words) - len(rest)
    if (n := sum(w in FILLER_WORDS for w in rest)) >= 2:
        covered += n
    if (n := sum(w in LOREM for w in rest)) >= 3:
        covered += n
    return covered > 0 and covered >= 0.9 * len(words)


def _bare(text: str) -> tuple[str, bool]:
    """A page without markup, menus and footers, and whether it had any."""
    text = html.unescape(text) if "&" in text else text
    bare = _TAG.sub("\n", text) if "<" in text else text
    if sum(bare.count(c) for c in "|·>/•›»") >= 2:  # a menu has two signs between its items
        bare = _MENU.sub("\n", bare)
    folded = _folded(bare)
    if "©" in bare or "(c)" in folded or "copyright" in folded:
        bare = _FOOTER.sub("\n", bare)
    if "skip to" in folded:
        bare = _SKIP.sub("\n", bare)
    return bare, bare != text


def _folded(text: str) -> str:
    """Lower case, with the letters that matching without case takes for i."""
    return (text if text.isascii() else text.replace("İ", "i").replace("ı", "i")).casefold()


def page_blocks(text: str) -> list[tuple[str, str]]:
    """(kind, skeleton) of the blocks of a page that are no menu, footer, heading or markup."""
    return _page(text)[0]


def _page(text: str) -> tuple[list[tuple[str, str]], bool]:
    text, framed = _bare(text)
    folded = _folded(text)
    messages, phrases = any(x in folded for x in MESSAGE_PARTS), any(x in folded for x in FILLER_PARTS)
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or not any(c.isalnum() for c in line):
            continue
        # without a stop and short: a heading or menu item, unless it is a message itself
        closed = line.rstrip("\"'”’»)")[-1:] in ".!?…。！？;:,"
        for block in _SENTENCE.split(line):
            block = block.strip()
            if not any(c.isalnum() for c in block):
                continue
            if _is_filler(block, phrases):
                kind = FILLING
            elif messages and MESSAGE.search(_QUOTED.sub(" ", block)):
                kind = STRONG
            elif out and out[-1][0] == STRONG and FOLLOW.search(block):
                kind = STRONG
            elif not closed and len(line.split()) <= 8 and not _CUE.search(block):
                continue
            else:
                kind = PLAIN
            out.append((kind, _SLOT.sub("*", block.lower()).strip(" .")))
    return out, framed


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages, skeletons as digests; a row of the kind WHOLE has the page's, and its longest block's."""
    digest = lambda x: hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()
    for b in batches:
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            blocks, framed = _page(text)
            message = any(k in (STRONG, FILLING) for k, _ in blocks)
            rows += [(key, kind, digest(skeleton), None, message) for kind, skeleton in blocks]
            if blocks and framed:
                longest = max((x for _, x in blocks), key=lambda x: (len(_WORDS.findall(x)), x))
                if len(_WORDS.findall(longest)) >= PAGE_WORDS:
                    rows.append((key, WHOLE, digest("\n".join(x for _, x in blocks)), digest(longest), message))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "kind", "skeleton", "longest", "message"])


def message_pages(texts: DataFrame, *, records: int = 3, mostly: float = 0.8) -> DataFrame:
    """Keys of pages that consist of messages or filler. ``texts``: key (equal for equal texts), text.

    A block that is no message by itself counts as part of one if its skeleton stands in
    at least ``records`` different texts, ``mostly`` of which hold a message. A page that no
    pattern knows is a template, in whatever language, if at least ``records`` different
    texts with menus, footers or markup have its skeleton as a whole and are ``mostly`` of
    all texts with its longest block: sentences of contents stand beside others elsewhere.
    Without such a frame a text that recurs may as well be contents. Every distinct text is cut
    into blocks: no cheaper look at the raw text sees what the patterns see once entities,
    markup and quotations are resolved.
    """
    pages = texts.dropDuplicates(["key"])
    schema = "key string, kind string, skeleton binary, longest binary, message boolean"
    rows = checkpointed(pages.select("key", "text").mapInArrow(_blocks, schema))
    blocks, wholes = rows.where(F.col("kind") != WHOLE), rows.where(F.col("kind") == WHOLE)
    beside_messages = blocks.where("message").where(~F.col("kind").isin(STRONG, FILLING)).select("skeleton").distinct()
    aligned = (
        blocks.join(beside_messages.hint("merge"), "skeleton", "left_semi")
        .groupBy("skeleton")
        .agg(
            F.count_distinct("key").alias("texts"),
            F.count_distinct(F.when(F.col("message"), F.col("key"))).alias("with_message"),
        )
        .where((F.col("texts") >= records) & (F.col("with_message") >= mostly * F.col("texts")))
        .select("skeleton", F.lit(True).alias("recurs"))
    )
    own = F.col("kind").isin(STRONG, FILLING)
    patterned = (
        blocks.where("message")
        .join(aligned.hint("merge"), "skeleton", "left")
        .groupBy("key")
        .agg(F.min(own | F.coalesce("recurs", F.lit(False))).alias("nothing_else"))
        .where("nothing_else")
        .select("key")
    )
    recurring = wholes.groupBy("skeleton", "longest").agg(F.count("*").alias("alone")).where(F.col("alone") >= records)
    anywhere = blocks.join(recurring.select(F.col("longest").alias("skeleton")).distinct().hint("merge"), "skeleton", "left_semi")
    anywhere = anywhere.groupBy(F.col("skeleton").alias("longest")).agg(F.count_distinct("key").alias("texts"))
    templates = recurring.join(anywhere.hint("merge"), "longest").where(F.col("alone") >= mostly * F.col("texts")).select("skeleton", F.col("alone"))
    # one template may hold a third of all pages
    unknown = grid_join(wholes.select("skeleton", "key"), templates, ["skeleton"], left_id="key", right_id="alone", limit=100_000).select("key")
    return patterned.unionByName(unknown)


def residue(df: DataFrame, *, id_col: str, text: str, records: int = 3) -> DataFrame:
    """Ids of records that hold an unfilled placeholder or are a message or filler as a whole: id_col, reason.

    reason is ``placeholder`` or ``page`` (a record that is both has ``page``). Null,
    empty and blank texts are none. Equal texts are judged once; the way back to their
    records splits texts that a large part of all records share.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    keyed = rows.withColumn("key", F.md5("text"))
    texts = keyed.select("key", "text")
    reasons = checkpointed(
        unfilled(texts, records=records)
        .withColumn("reason", F.lit("placeholder"))
        .unionByName(message_pages(texts, records=records).withColumn("reason", F.lit("page")))
        .groupBy("key")
        .agg(F.min("reason").alias("reason"))
    )
    found = grid_join(keyed.select("id", "key"), reasons, ["key"], left_id="id", right_id="reason", limit=100_000)
    return found.select(F.col("id").alias(id_col), "reason")


def without_residue(df: DataFrame, *, id_col: str, text: str, **options) -> DataFrame:
    """The records of ``df`` that :func:`residue` doesn't report, all columns kept."""
    bad = residue(df, id_col=id_col, text=text, **options).select(F.col(id_col).alias("__bad"))
    return df.join(bad.hint("merge"), df[id_col] == F.col("__bad"), "left_anti")
