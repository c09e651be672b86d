"""Stopwords by language.

The lists here are short lists of function words. Longer ones are a parameter: every
operator takes any set of words, and ``termloom.sources.readers.word_set`` reads one
from a file.
"""

from __future__ import annotations

# Names of the languages, by code.
NAMES = {
    "ca": ("cat", "catalan"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fr": ("fra", "french"),
    "pl": ("pol", "polish"),
}

# Function words.
OUTER = {
    "en": "a an the and or but nor so yet if of in on at by for from to into onto with without within about above across after against along "
    "among around before behind below beneath beside between beyond during near over through under until upon i you he she it we they me him "
    "her us them my your his its our their this that these those which who whom whose what where when why how is are was were be been being "
    "am do does did have has had will would shall should can could may might must not no there here than then as",
    "es": "el la los las un una unos unas y e o u pero sino ni que de del al a en con sin por para sobre entre hasta desde hacia según tras ante "
    "bajo contra durante yo tú él ella ello nosotros ellos ellas me te se le les lo nos mi tu su sus este esta esto estos estas ese esa eso "
    "esos esas aquel aquella cuyo quien cual donde cuando como es son era eran fue fueron ser ha han había no más muy ya también",
    "fr": "le la les l un une des du de d au aux et ou où mais ni car donc que qui quoi dont à en dans par pour sur sous avec sans entre vers "
    "chez depuis pendant avant après contre je tu il elle on nous vous ils elles me te se lui leur leurs mon ton son sa ses notre votre ce "
    "cet cette ces est sont était étaient être a ont avait ne pas plus très y si comme quand",
    "ca": "el la els les l un una uns unes i o però sinó ni que de del dels d al als a en amb sense per pel pels sobre entre fins des cap segons "
    "sota contra durant jo tu ell ella nosaltres ells elles em et es li lo ho ens us hi meu teu seu seva seus aquest aquesta aquests aquestes "
    "aquell aquella qui què on quan com és són era eren ser ha han havia no més molt ja també",
    "pl": "i a o u w we z ze na do od po za przez dla bez pod nad przed przy między oraz lub albo ale lecz więc że aby by gdy jeśli czy jak jako "
    "to ta ten te ci tego tej tych tym tymi ja ty on ona ono my wy oni one mnie ciebie go jej ich im mu się swój nie tak jest są był była "
    "było były być ma mają który która które co kto gdzie kiedy",
}
INNER = {
    "en": "and or the is are will shall do does to don't but",
    "es": "y o pero que es son",
    "fr": "mais ou et donc",
    "ca": "i o però que és són",
    "pl": "",
}


def language_code(language: str) -> str:
    """Two-letter code of a language given as code or English name."""
    spelt = language.strip().lower()
    for code, names in NAMES.items():
        if spelt == code or spelt in names:
            return code
    raise ValueError(f"no resources for language {language!r}; there are {', '.join(sorted(NAMES))}")


def outer(language: str) -> frozenset[str]:
    """Words that may not begin or end a term."""
    return frozenset(OUTER[language_code(language)].split())


def inner(language: str) -> frozenset[str]:
    """Words that may not stand within a term."""
    return frozenset(INNER[language_code(language)].split())


def all_outer() -> frozenset[str]:
    return frozenset().union(*(outer(c) for c in NAMES))


def all_inner() -> frozenset[str]:
    return frozenset().union(*(inner(c) for c in NAMES))
