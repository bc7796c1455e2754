"""Language identification by mixtures: which languages a text is written in, and in what proportions.

A language is the distribution of its letter trigrams. A text is a mixture of languages, each of its
words written in one of them; expectation-maximisation finds the proportions, and a language is only taken into
the set when the likelihood gained exceeds a penalty. The counts cover all training documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers in a model: hash buckets of trigrams times languages stay below, so a model has 64 MB at most.
MODEL_SIZE, MOST_BUCKETS, LEAST_BUCKETS = 1 << 24, 1 << 16, 1 << 10
# Letters of a unit: words are units, and longer runs (scripts without blanks) are cut.
UNIT_LETTERS = 16
# Characters whose likelihoods are held at once, per language.
HELD_CHARS = 1 << 22
# Share of the mean of all languages in each distribution; neighbouring trigrams share letters, so their logs count half.
SMOOTH, TEMPER = 0.02, 0.5
# A unit tells for no language against another by more than this.
FLOOR = -50.0
EM_STEPS, PENALTY = 20, 3.0
UNDETERMINED = "und"


class Model(NamedTuple):
    langs: list[str]
    logs: np.ndarray  # [buckets, languages]


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str, size: int) -> Iterator[str]:
    """A long text in pieces, cut where a word ends if there is such a place."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end > start + size // 2 and text[end - 1].isalpha():
            end -= 1
        if end == start + size // 2:
            end = start + size
        yield text[start:end]
        start = end
    yield text[start:]


def trigrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket per letter, first letter of each unit, text number of each unit) of all texts.

    Every letter stands for the trigram around it; whatever is no letter is one and the same edge.
    """
    joined = "\0" + "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    code = np.where(letter_table()[code], code, 0).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])  # the edge before a text goes with it
    at = np.flatnonzero(code)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mix = (code[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (
        code[at + 1] * np.uint64(0x165667B19E3779F9))
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((mix ^ (mix >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
    opens = np.diff(at, prepend=-1) > 1
    opens[0] = True
    start = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
    first = np.flatnonzero((np.arange(len(at)) - start) % UNIT_LETTERS == 0)
    return bucket, first, text[at[first]]


def lots(texts: list[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters; a longer text is a range by itself."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > size:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def likelihoods(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods [units, languages], text number of each unit); long texts are worked on in pieces."""
    size = max(10_000, HELD_CHARS // max(1, len(model.langs)))
    cut, of = [], []
    for i, t in enumerate(texts):
        for piece in pieces(t, size):
            cut.append(piece.lower())
            of.append(i)
    found, numbers = [], []
    for a, b in lots(cut, size):
        bucket, first, number = trigrams(cut[a:b], len(model.logs))
        if len(first):
            found.append(np.add.reduceat(model.logs[bucket], first, axis=0))
            numbers.append(np.array(of)[a:b][number])
    if not found:
        return np.zeros((0, len(model.langs))), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(numbers)


def proportions(logs: np.ndarray, text: np.ndarray, n_texts: int, penalty: float = PENALTY) -> np.ndarray:
    """[texts, languages] proportions by expectation-maximisation; zero outside the set of languages chosen.

    Starts from the one most likely language. Each round offers every text the language of steepest
    gain, fits the proportions with it and keeps it if the log-likelihood grows by more than
    penalty * log(units + 1); texts that refuse are done. Ties go to the earlier language. Texts without units get zeros.
    """
    share = np.zeros((n_texts, logs.shape[1]))
    if not logs.size:
        return share
    best = np.maximum(logs - logs.max(1, keepdims=True), FLOOR)
    units = np.bincount(text, minlength=n_texts)
    here = np.flatnonzero(units)
    total = np.zeros_like(share)
    total[here] = np.add.reduceat(best, np.flatnonzero(np.diff(text, prepend=-1)), axis=0)
    share[here, total[here].argmax(1)] = 1.0
    gained = np.where(units > 0, total.max(1), 0.0)
    like = np.exp(best)
    going = (units > 1) & (logs.shape[1] > 1)
    while going.any():
        keep = going[text]
        own, of = like[keep], text[keep]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        names = of[starts]
        number = np.repeat(np.arange(len(names)), np.diff([*starts, len(of)]))
        per_text = lambda x: np.add.reduceat(x, starts, axis=0)
        now = share[names]
        mix = (own * now[number]).sum(1)
        steepest = np.where(now > 0, -1.0, per_text(own / mix[:, None]))
        offered = steepest.argmax(1)
        rows = np.arange(len(names))
        fitted = now * 0.75
        fitted[rows, offered] += 0.25
        for _ in range(EM_STEPS):
            blame = own * fitted[number]
            blame /= blame.sum(1, keepdims=True)
            fitted = per_text(blame) / units[names][:, None]
        reached = per_text(np.log((own * fitted[number]).sum(1)))
        takes = (steepest[rows, offered] > units[names]) & (reached - gained[names] > penalty * np.log(units[names] + 1.0))
        share[names[takes]] = fitted[takes]
        gained[names[takes]] = reached[takes]
        going[names[~takes]] = False
        going[names] &= (share[names] == 0).any(1)
    return share


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """Trigram distributions of all languages, from every document that is not held out and has a text and a language.

    Only counts per language and bucket leave the tasks. The number of buckets is halved
    where there are so many languages that the model would exceed its bound.
    """
    known = docs.filter("text is not null and lang is not null").filter(~held_out()).select(
        F.col("lang").cast("string").alias("lang"), "text")
    languages = known.select("lang").distinct().count()
    buckets = MOST_BUCKETS
    while buckets > LEAST_BUCKETS and buckets * languages > MODEL_SIZE:
        buckets //= 2
    if buckets * languages > MODEL_SIZE:
        raise ValueError(f"{languages} languages: at most {MODEL_SIZE // LEAST_BUCKETS} can be told apart")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in pieces(text.as_py(), HELD_CHARS):
                    by_lang.setdefault(lang, []).append(piece.lower())
            for lang, texts in by_lang.items():
                for a, b in lots(texts, HELD_CHARS):
                    found = np.bincount(trigrams(texts[a:b], buckets)[0], minlength=buckets)
                    held[lang] = held[lang] + found if lang in held else found
        for lang, counts in held.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])],
                names=["lang", "bucket", "count"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        share = np.zeros(buckets)
        share[pdf["bucket"].to_numpy()] = pdf["count"] / pdf["count"].sum()
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "share": [share.astype(np.float32).tobytes()]})

    counts = known.mapInArrow(count, "lang string, bucket int, count long").groupBy("lang", "bucket").agg(
        F.sum("count").alias("count"))
    # One row per language and at most 4 bytes per bucket: the model, whose size is bounded above.
    rows = sorted(counts.groupBy("lang").applyInPandas(together, "lang string, share binary").collect())
    if not rows:
        return Model([], np.zeros((buckets, 0), np.float32))
    share = np.stack([np.frombuffer(r["share"], np.float32) for r in rows], axis=1).astype(np.float64)
    mean = 0.999 * share.mean(1, keepdims=True) + 0.001 / buckets
    logs = TEMPER * np.log((1 - SMOOTH) * share + SMOOTH * mean)
    return Model([r["lang"] for r in rows], logs.astype(np.float32))


def mixtures(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(row, lang_pred, score, mixture): every row as it came, in a struct, with the languages of its text."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            parts = [np.zeros((0, len(model.langs)))]
            for a, b in lots(texts, max(10_000, HELD_CHARS // max(1, len(model.langs)))):
                parts.append(proportions(*likelihoods(texts[a:b], model), b - a, penalty))
            share = np.concatenate(parts)
            lang, score, mixture = [], [], []
            for row in share:
                chosen = np.flatnonzero(row)
                chosen = chosen[np.argsort(-row[chosen], kind="stable")]
                lang.append(model.langs[chosen[0]] if len(chosen) else UNDETERMINED)
                score.append(min(1.0, float(row[chosen[0]])) if len(chosen) else 0.0)
                mixture.append([{"lang": model.langs[i], "share": float(row[i])} for i in chosen])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(mixture, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["row", "lang_pred", "score", "mixture"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                         F.array(F.struct(F.lit("").alias("lang"), F.lit(0.0).alias("share"))).alias("mixture")).schema
    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Learn the languages from ``docs`` (doc_id, text, lang) and tell those of every whole text.

    One row per input row: row (all its columns), held_out, lang_pred (the language of greatest
    proportion), score (that proportion), mixture (all languages chosen, by proportion). A text that is
    null or has no letter, and any text when nothing could be learned, is ``und`` with score 0. Documents
    without a language teach nothing but are told too; a language whose texts have no letter is not learned. Ties go to
    the language first in order; repeated rows stay; an empty table gives no row.
    """
    return mixtures(docs, learn(docs), penalty).select("row", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "mixture")
