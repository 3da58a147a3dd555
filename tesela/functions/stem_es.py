"""Spanish stemming by the published Snowball algorithm, for words whose accents are stripped already."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = set("aeiouáéíóúü")

#: The algorithm's endings, step by step.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
GERUNDS = ["iéndo", "ándo", "ár", "ér", "ír"]
PLAIN_GERUNDS = ["ando", "iendo", "ar", "er", "ir"]
STEP1 = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(),
    "log": "logía logías".split(),
    "u": "ución uciones ucion".split(),
    "ente": "encia encias".split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "idad": ["idad", "idades"],
    "iva": "iva ivo ivas ivos".split(),
}
STEP2A = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
STEP2B_GU = "en es éis emos".split()
STEP2B = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran "
    "ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
STEP3 = "os a o á í ó".split()
STEP3_GU = "e é".split()


def _plain(s: str) -> str:
    return s.translate(str.maketrans("áéíóú", "aeiou"))


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    n = len(word)

    def after_pair(start: int) -> int:
        return next((i + 1 for i in range(start + 1, n) if word[i] not in VOWELS and word[i - 1] in VOWELS), n)

    r1 = after_pair(0)
    r2 = after_pair(r1)
    rv = n
    if n > 2:
        if word[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] in VOWELS), n)
        elif word[0] in VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] not in VOWELS), n)
        else:
            rv = 3
    return rv, r1, r2


def _longest(word: str, endings, start: int) -> str:
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


def stem(word: str) -> str:
    if len(word) < 2:
        return word
    rv, r1, r2 = regions(word)
    # step 0: a pronoun behind a gerund or infinitive
    pronoun = _longest(word, PRONOUNS, rv)
    if pronoun:
        base = word[: -len(pronoun)]
        if verb := _longest(base, GERUNDS, rv):
            word = base[: -len(verb)] + _plain(verb)
        elif _longest(base, PLAIN_GERUNDS, rv) or (base.endswith("uyendo") and len(base) - 5 >= rv):
            word = base
    start = word
    # step 1: standard endings
    kind, ending = max(((k, e) for k, es in STEP1.items() for e in es if word.endswith(e)), key=lambda x: len(x[1]), default=("", ""))
    begin = len(word) - len(ending)
    cut = lambda *more: _cut(word[:begin], r2, more)
    if kind == "amente" and begin >= r1:
        word = word[:begin]
        if word.endswith("iv") and len(word) - 2 >= r2:
            word = _cut(word[:-2], r2, ("at",))
        else:
            word = _cut(word, r2, ("os", "ic", "ad"))
    elif kind and kind != "amente" and begin >= r2:
        if kind == "delete":
            word = word[:begin]
        elif kind == "ic":
            word = cut("ic")
        elif kind == "log":
            word = word[:begin] + "log"
        elif kind == "u":
            word = word[:begin] + "u"
        elif kind == "ente":
            word = word[:begin] + "ente"
        elif kind == "mente":
            word = cut("ante", "able", "ible")
        elif kind == "idad":
            word = cut("abil", "ic", "iv")
        elif kind == "iva":
            word = cut("at")
    if word == start:
        # step 2a: verb endings with y, behind u
        ending = _longest(word, STEP2A, rv)
        if ending and word[: -len(ending)].endswith("u"):
            word = word[: -len(ending)]
        else:
            # step 2b: other verb endings
            ending = _longest(word, [*STEP2B, *STEP2B_GU], rv)
            if ending:
                word = word[: -len(ending)]
                if ending in STEP2B_GU and word.endswith("gu"):
                    word = word[:-1]
    # step 3: what is left of a residual ending
    ending = _longest(word, [*STEP3, *STEP3_GU], rv)
    if ending:
        word = word[: -len(ending)]
        if ending in STEP3_GU and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return _plain(word)


def _cut(word: str, start: int, endings) -> str:
    ending = _longest(word, endings, start)
    return word[: len(word) - len(ending)]


@F.pandas_udf(T.StringType())
def stem_es(term: pd.Series) -> pd.Series:
    """Stems of terms; meant for distinct terms, which are then joined back."""
    return term.map(lambda w: None if w is None else stem(unicodedata.normalize("NFC", w)))
