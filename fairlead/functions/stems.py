"""Word stems by suffix rules (Porter 1980, with the usual later rules for short words and ``-ly``)."""

from __future__ import annotations

from functools import lru_cache

# The published suffix rules, (suffix, what takes its place). The first suffix that fits decides.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
          "ive", "ize")
# Words whose stems the rules would get wrong.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def shape(word: str) -> str:
    """v for a vowel and c for any other character; y is a vowel after a consonant."""
    out = ""
    for char in word:
        vowel = char in "aeiou" or (char == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends like ``hop`` or is like ``at``: an e belongs after it."""
    kind = shape(word)
    return kind == "vc" or (kind.endswith("cvc") and word[-1] not in "wxy")


def _swap(word: str, rules) -> str:
    for suffix, instead in rules:
        if word.endswith(suffix):
            rest = word.removesuffix(suffix)
            return rest + instead if measure(rest) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        rest = word.removesuffix(suffix)
        if rest != word and "v" in shape(rest):
            break
    else:
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if len(rest) > 1 and rest[-1] == rest[-2] and shape(rest)[-1] == "c":
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short(rest) else rest


def _derived(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    return _swap(word, STEP_2)


def _ending(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            rest = word.removesuffix(suffix)
            return rest if measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st") else word
    return word


@lru_cache(maxsize=20_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _ending(_swap(_derived(word), STEP_3))
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
