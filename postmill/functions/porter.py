"""Porter's stemmer (1980), from the published description of its steps."""

from __future__ import annotations

from functools import lru_cache

STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_vowel(word, i) for i in range(len(word))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(word: str) -> bool:
    return any(_vowel(word, i) for i in range(len(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


def _longest(word: str, table) -> tuple[str, str] | None:
    hits = [(s, r) for s, r in table if word.endswith(s)]
    return max(hits, key=lambda x: len(x[0])) if hits else None


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + to
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and _has_vowel(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        hit = _longest(word, table)
        if hit and _measure(word[: -len(hit[0])]) > 0:
            word = word[: -len(hit[0])] + hit[1]
    hit = _longest(word, [(s, "") for s in STEP4])
    if hit:
        base = word[: -len(hit[0])]
        if _measure(base) > 1 and (hit[0] != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
