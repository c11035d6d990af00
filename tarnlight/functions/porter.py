"""The Porter (1980) stemmer, from the published rules."""

from __future__ import annotations

import functools
import re

_STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
_STEP3 = "icate ic ative . alize al iciti ic ical ic ful . ness .".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """consonant, vowel, consonant other than w, x, y at the end"""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: list[str], least: int) -> str:
    for end, new in sorted(zip(rules[::2], rules[1::2]), key=lambda r: -len(r[0])):
        if word.endswith(end):
            base = word[: -len(end)]
            return base + new.strip(".") if _measure(base) >= least else word
    return word


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _shape(base := word[: -len(end)]):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif _double(base) and base[-1] not in "lsz":
                        base = base[:-1]
                    elif _measure(base) == 1 and _short(base):
                        base += "e"
                    word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2, 1), _STEP3, 1)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
