"""The Porter stemmer, as published in 1980: five steps of suffix rules on the measure of what is left."""

from __future__ import annotations

import re
from functools import lru_cache

#: The published suffix rules, tried from the longest suffix of a step on.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """A letter for each of the word's: v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall("vc", _shape(word)))


def _ends_short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plurals(word: str) -> str:
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + to
    return word


def _endings(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word.removesuffix(suffix)
        if base != word and "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _doubled(base) and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if _measure(base) == 1 and _ends_short(base) else base
    return word


def _replaced(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + rules[suffix] if _measure(base) > 0 else word
    return word


def _residue(word: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            fits = _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t")))
            return base if fits else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    word = _endings(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _residue(_replaced(_replaced(word, STEP_2), STEP_3))
    if word.endswith("e"):
        base = word[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _ends_short(base)):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
