"""English words for search: stop list and the Porter2 ("English Snowball") stemmer.

The stemmer follows the published rules step by step; a word is at most changed at its end.
The first region starts after the first non-vowel that follows a vowel, the second after the
next such place; most endings go only inside a region.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published stemmer and of the stop list in common use with it.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
FIRST_REGION_AFTER = ["gener", "commun", "arsen"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
BEFORE_LI = "cdeghkmnrt"
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
DERIVED_AGAIN = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
REMOVED = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_DERIVED, _DERIVED_AGAIN, _REMOVED = tuple(DERIVED), tuple(DERIVED_AGAIN), tuple(REMOVED)
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _longest(word: str, endings: tuple) -> str | None:
    if not word.endswith(endings):  # most words: one call
        return None
    return max((e for e in endings if word.endswith(e)), key=len)


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _plurals(w: str) -> str:
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and re.search("[aeiouy]", w[:-2]) else w


def _verbs(w: str, first: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= first else w
    if end is None or not re.search("[aeiouy]", w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(tuple(DOUBLES)):
        return w[:-1]
    return w + "e" if len(w) <= first and _SHORT.search(w) else w


def _derived(w: str, first: int, second: int) -> str:
    end = _longest(w, _DERIVED)
    if end and len(w) - len(end) >= first:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and not before.endswith(tuple(BEFORE_LI))):
            w = before + DERIVED[end]
    end = _longest(w, _DERIVED_AGAIN)
    if end and len(w) - len(end) >= (second if end == "ative" else first):
        w = w[: -len(end)] + DERIVED_AGAIN[end]
    end = _longest(w, _REMOVED)
    if end and len(w) - len(end) >= second and not (end == "ion" and not w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= second or len(w) - 1 >= first and not _SHORT.search(w[:-1])):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and len(w) - 1 >= second else w


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words with digits stay."""
    if len(word) < 3 or re.search("[0-9]", word):
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    first = next((len(p) for p in FIRST_REGION_AFTER if w.startswith(p)), None) or _after(w, 0)
    second = _after(w, first)
    w = _plurals(w)
    if w in KEPT_AFTER_PLURALS:
        return w
    w = _verbs(w, first)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    return _derived(w, first, second).replace("Y", "y")
