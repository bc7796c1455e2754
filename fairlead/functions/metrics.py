"""Answer metrics as columns of (response, reference)."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fairlead.functions.stems import stem
from fairlead.functions.text import relative_score

SMOOTHING = 0.1  # fixed value: numerator of an n-gram order without a match
ORDERS = (1, 2, 3, 4)
REFERENCES = 1_000  # references a task remembers the n-grams of


@lru_cache(maxsize=REFERENCES)
def _wanted(reference: str) -> tuple[int, list[Counter]]:
    """Number of words of a reference and its n-grams by order."""
    truth = reference.split()
    return len(truth), [Counter(zip(*(truth[i:] for i in range(n)))) for n in ORDERS]


def bleu(response: str, reference: str, smooth: bool = True) -> float:
    """Sentence BLEU-4 on white-space tokens with equal weights.

    Only places where the shorter n-gram is one of the reference can begin a longer one.
    """
    said, (n_truth, wanted) = (response or "").split(), _wanted(reference or "")
    if not said or not n_truth:
        return 0.0
    total, places = 0.0, range(len(said))
    for n, grams in zip(ORDERS, wanted):
        here = [(i, gram) for i in places if (gram := tuple(said[i:i + n])) in grams]
        found = Counter(gram for _, gram in here)
        hits = sum(min(count, grams[gram]) for gram, count in found.items())
        if hits == 0 and n == 1:
            return 0.0
        places = [i for i, _ in here]
        size = max(1, len(said) - n + 1)
        if hits == 0:
            total += math.log(SMOOTHING / size if smooth else sys.float_info.min)
        else:
            total += math.log(hits / size)
    brevity = min(0.0, 1 - n_truth / len(said))
    return math.exp(brevity + total / len(ORDERS))


WORD = re.compile(r"[a-z0-9]+")
STEM_FROM = 4  # fixed value: shorter words are compared as they are


def rouge_l(response: str, reference: str, stems: bool = False) -> float:
    """F1 of the longest common subsequence of lower-case alphanumeric words, or of their stems.

    The row of the subsequence table is one integer, a bit per reference word.
    """
    said, truth = WORD.findall((response or "").lower()), WORD.findall((reference or "").lower())
    if stems:
        said, truth = ([stem(w) if len(w) >= STEM_FROM else w for w in words] for words in (said, truth))
    if not said or not truth:
        return 0.0
    places: dict[str, int] = {}
    for i, word in enumerate(truth):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(truth)) - 1
    row = full
    for word in said:
        if word in places:
            match = row & places[word]
            row = ((row + match) | (row - match)) & full
    common = len(truth) - row.bit_count()
    if common == 0:
        return 0.0
    precision, recall = common / len(said), common / len(truth)
    return 2 * precision * recall / (precision + recall)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance over characters.

    A column of the table is two integers with a bit per character of the longer text
    (Myers 1999), so there are as many steps as the shorter text has characters.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return len(long)
    chars = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {c: int.from_bytes(np.packbits(chars == ord(c), bitorder="little").tobytes(), "little") for c in set(short)}
    full, last = (1 << len(long)) - 1, 1 << (len(long) - 1)
    up, down, distance = full, 0, len(long)
    for char in short:
        match = places[char] | down
        same = (((match & up) + up) ^ up) | match
        right_up = down | (full & ~(same | up))
        right_down = same & up
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up = (right_up << 1) | 1
        right_down <<= 1
        up = (right_down | ~(same | right_up)) & full
        down = same & right_up & full
    return distance


def similarity(a: str, b: str) -> float | None:
    if a is None or b is None:
        return None
    return 1 - edit_distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def pairwise(score):
    """A pandas UDF of a (response, reference) score."""
    @F.pandas_udf(DoubleType())
    def udf(response: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([score(a, b) for a, b in zip(response, reference)], dtype="float64")
    return udf


_BLEU = pairwise(bleu)
_BLEU_PLAIN = pairwise(lambda a, b: bleu(a, b, smooth=False))
_ROUGE_L = pairwise(rouge_l)
_ROUGE_L_STEMS = pairwise(lambda a, b: rouge_l(a, b, stems=True))
_SIMILARITY = pairwise(similarity)


def bleu_score(response: Column, reference: Column, smooth: bool = True) -> Column:
    return (_BLEU if smooth else _BLEU_PLAIN)(response, reference)


def rouge_score(response: Column, reference: Column, stems: bool = False) -> Column:
    return (_ROUGE_L_STEMS if stems else _ROUGE_L)(response, reference)


def string_similarity(response: Column, reference: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    return _SIMILARITY(response, reference)


def string_presence(response: Column, reference: Column) -> Column:
    return F.contains(response, reference).cast("double")


def factual_correctness(found: Column, truth: Column) -> Column:
    """Lenient numeric agreement; 0 when either number is missing."""
    return F.coalesce(relative_score(found, truth), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null when one has no length."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
