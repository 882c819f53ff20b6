"""The Porter2 stemmer for English words in ASCII, as published."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words with a stem of their own, words that stay after the first step.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAYING = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings of steps 2 to 4.
STEP2 = {"ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]

_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")


def _region(word: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), "")


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _region(word)
    r2 = _region(word, r1)
    word = re.sub(r"'(s'?)?$", "", word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in STAYING:
        return word

    if e := _ending(word, ("eed", "eedly")):
        if len(word) - len(e) >= r1:
            word = word[: -len(e)] + "ee"
    elif (e := _ending(word, ("ed", "edly", "ing", "ingly"))) and _VOWEL.search(word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if re.search(r".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"

    if e := _ending(word, [*STEP2, "ogi", "li"]):
        if len(word) - len(e) >= r1:
            if e in STEP2:
                word = word[: -len(e)] + STEP2[e]
            elif e == "ogi" and word.endswith("logi"):
                word = word[:-1]
            elif e == "li" and re.search(r"[cdeghkmnrt]li$", word):
                word = word[:-2]
    if e := _ending(word, [*STEP3, "ative"]):
        if len(word) - len(e) >= r1 and e != "ative":
            word = word[: -len(e)] + STEP3[e]
        elif e == "ative" and len(word) - 5 >= r2:
            word = word[:-5]
    if e := _ending(word, STEP4):
        if len(word) - len(e) >= r2 and (e != "ion" or word[:-3].endswith(("s", "t"))):
            word = word[: -len(e)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
