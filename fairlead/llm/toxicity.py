"""Toxicity by a support vector machine on gapped character subsequences, with landmark strings."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the training sample: labelled rows of either kind, and characters of a row.
TRAIN_ROWS, TRAIN_CHARS = 2_000, 20_000
LANDMARKS, PLAIN_LANDMARKS, PLAIN_WORDS, ROUNDS = 160, 96, 15_000, 4
DECAY = 0.5
PIECE_CHARS = 500_000
TOP = 3  # words of a text that its score looks at
# Steps from one character of a subsequence to the next: four characters, up to two skipped in all.
STEPS = [(a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3) if a + b + c <= 5]
SPACES = {*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _classes() -> np.ndarray:
    """32 classes: 0 blank, 1-26 letters and their look-alikes, 27 other signs, 28-31 other letters."""
    table = np.full(0x110000 >> 4, 27, np.uint8)
    for point in range(len(table)):
        c = chr(point)
        c = LOOKALIKE.get(c, c)
        table[point] = 0 if point in SPACES else ord(c) - 96 if "a" <= c <= "z" else 28 + point % 4 if c.isalpha() else 27
    return table


_table: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """The class of each character of the lower-cased text."""
    if not _table:
        _table.append(_classes())
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    x = _table[0][np.minimum(points, len(_table[0]) - 1)]
    if not len(x):
        return x
    # Signs at a word's edge are no part of it: their run touches a blank or an end of the text.
    other = (x == 0) | (x == 27)
    begin = np.flatnonzero(np.concatenate([[True], other[1:] != other[:-1]]))
    edge = np.logical_or.reduceat(x == 0, begin)
    edge[[0, -1]] |= other[begin[[0, -1]]]
    return np.where(np.repeat(edge, np.diff(np.append(begin, len(x)))), 0, x).astype(np.uint8)


def subsequences(x: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """Per pattern of steps its weight and, for each place it fits, the number of the four classes."""
    wide = x.astype(np.int32)
    for a, b, c in STEPS:
        n = len(x) - a - b - c
        if n > 0:
            yield DECAY ** (a + b + c - 3), (
                (wide[:n] << 15) | (wide[a:a + n] << 10) | (wide[a + b:a + b + n] << 5) | wide[a + b + c:a + b + c + n])


def norm(length: np.ndarray) -> np.ndarray:
    """Length of a word's vector if no subsequence occurred twice: a word of n characters has n+2 with its ends."""
    total = sum(DECAY ** (2 * (a + b + c - 3)) * np.maximum(0, length + 1 - a - b - c) for a, b, c in STEPS)
    return np.sqrt(np.maximum(total, 1.0))


def vector(word: str) -> dict[int, float]:
    """Weights of a word's gapped subsequences, its ends included, divided by the word's norm."""
    x = np.concatenate([[0], codes(word), [0]])
    out: Counter = Counter()
    for weight, numbers in subsequences(x):
        for number in numbers.tolist():
            out[number] += weight
    size = float(norm(np.array([len(x) - 2]))[0])
    return {k: v / size for k, v in out.items()}


@dataclass
class Model:
    """Weights of subsequences (the machine's landmarks folded into one table), bias and calibration."""

    weights: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float

    def words(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, scores) of the words of a sequence of classes that begins and ends with 0."""
        solid = x != 0
        starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        if not len(starts):
            return starts, ends, np.zeros(0)
        total = np.zeros(len(x) + 1, np.float64)
        blank = np.where(solid, len(x), np.arange(len(x)))
        ahead = np.minimum.accumulate(blank[::-1])[::-1]  # the next blank from each place on
        reach = np.append(ahead[1:], len(x)) - np.arange(len(x))
        for (a, b, c), (weight, numbers) in zip(STEPS, subsequences(x)):
            n = len(numbers)  # no subsequence runs on into the next word
            total[1:n + 1] += np.where(reach[:n] >= a + b + c, weight * self.weights[numbers], 0.0)
        total = np.cumsum(total)
        return starts, ends, (total[ends] - total[starts - 1]) / norm(ends - starts) + self.bias

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(best @ self.slope + self.shift, -35, 35)))


SINGLE = re.compile(r"(?<!\S)(\S)\s(?=\S(?:\s|$))")


def join_singles(text: str) -> str:
    """Join runs of characters that stand alone, as in a word spelt with blanks."""
    return SINGLE.sub(r"\1", text)


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbered parts of texts, about PIECE_CHARS together; long texts are cut at blanks, all of them is used."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = at + PIECE_CHARS
            if stop < len(text):
                cut = max(text.rfind(" ", at + 1, stop), text.rfind("\n", at + 1, stop))
                stop = cut if cut > at else stop
            numbers.append(i)
            parts.append(text[at:stop])
            size += min(stop, len(text)) - at
            at = stop
            if size >= PIECE_CHARS:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def best_words(model: Model, texts: list[str]) -> tuple[np.ndarray, list[list[str]]]:
    """Per text the scores of its ``TOP`` worst different words, falling, and the words.

    Where a text has fewer words, the score of an empty word (the bias) fills up.
    """
    who, what, names = [np.zeros(0, np.int64)], [np.zeros(0)], []
    for numbers, parts in pieces(texts):
        parts = [join_singles(p) for p in parts]
        coded = [codes(p) for p in parts]
        zero = np.zeros(1, np.uint8)
        x = np.concatenate([zero, *(y for c in coded for y in (c, zero))])
        edges = np.cumsum([1, *(len(c) + 1 for c in coded)])
        starts, ends, scores = model.words(x)
        if not len(starts):
            continue
        owner = np.searchsorted(edges, starts, "right") - 1
        order = np.lexsort((-scores, owner))
        owner, scores = owner[order], scores[order]
        # Equal words have equal scores up to rounding; one of them stands for all.
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (scores[:-1] - scores[1:] > 1e-6)])
        order, owner, scores = order[fresh], owner[fresh], scores[fresh]
        first = np.searchsorted(owner, owner)
        top = np.flatnonzero(np.arange(len(owner)) - first < TOP)
        who.append(np.array(numbers)[owner[top]])
        what.append(scores[top])
        for k in top.tolist():
            p, at = owner[k], order[k]
            names.append(parts[p].lower()[starts[at] - edges[p]:ends[at] - edges[p]])
    doc, score = np.concatenate(who), np.concatenate(what)
    best, words = np.full((len(texts), TOP), model.bias), [[] for _ in texts]
    for k in np.lexsort((-score, doc)).tolist():
        have = words[doc[k]]
        if len(have) < TOP and names[k] not in have:
            best[doc[k], len(have)] = score[k]
            have.append(names[k])
    return best, words


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the violating rows."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        bad = y * (x1 @ w) < 1
        a = x1[bad] * weight[bad, None]
        new = np.linalg.solve(ridge + cost * a.T @ x1[bad], cost * a.T @ y[bad])
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def train(texts: list[str], toxic: list[int], share: float) -> Model:
    """Fit on labelled texts; ``share`` is the share of toxic rows among all labelled ones.

    A text is toxic if its sentences are, and a sentence by its worst words, so words are what the machine
    separates: of each toxic text the two that tell most (at first by how much more often toxic texts
    have them, then by the machine itself, in rounds), against words of clean texts and the worst word
    of each. The score weighs a text's three worst words, as one may stand anywhere by chance. Landmarks are telling words unlike each other and plain words; the machine works on kernel
    values with them (Nystroem features). A quarter of the texts only calibrates the score.
    """
    empty = Model(np.zeros(1 << 20, np.float32), 0.0, np.zeros(TOP), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < sum(toxic) < len(toxic):
        return empty
    fit = [i for i in range(len(texts)) if i % 4]
    bare = re.compile(r"^\W+|\W+$")
    words = [list(dict.fromkeys(bare.sub("", w) for w in join_singles(texts[i]).lower().split())) for i in fit]
    y = np.array([toxic[i] for i in fit])
    have = [Counter(), Counter()]
    for ws, label in zip(words, y):
        have[label].update(ws)
    n = np.bincount(y, minlength=2)
    telling = {w: np.log((k + 0.1) / n[1]) - np.log((have[0][w] + 0.5) / n[0]) for w, k in have[1].items() if 2 < len(w) < 40}
    ranked = sorted(telling, key=lambda w: (-telling[w], w))
    vectors: list[dict[int, float]] = []
    landmarks: list[str] = []
    for w in ranked[:4000]:
        v = vector(w)
        if len(landmarks) < LANDMARKS and all(sum(x * o.get(k, 0.0) for k, x in v.items()) < 0.6 for o in vectors):
            landmarks.append(w)
            vectors.append(v)
    clean = sorted(w for w in have[0] if w not in have[1] or telling.get(w, -1) < 0)
    rng = np.random.default_rng(7)
    plain = [clean[i] for i in rng.permutation(len(clean))[:PLAIN_WORDS]] if clean else []
    for w in plain[:PLAIN_LANDMARKS]:
        vectors.append(vector(w))
    known = {k: i for i, k in enumerate(sorted({k for v in vectors for k in v}))}
    base = np.zeros((len(known), len(vectors)))
    for j, v in enumerate(vectors):
        for k, x in v.items():
            base[known[k], j] = x
    values, axes = np.linalg.eigh(base.T @ base)
    good = values > 1e-4
    root = axes[:, good] / np.sqrt(values[good])  # landmark kernel to the power -1/2

    def features(ws: list[str]) -> np.ndarray:
        rows = np.zeros((len(ws), len(vectors)))
        for r, w in enumerate(ws):
            v = vector(w)
            hit = [(known[k], x) for k, x in v.items() if k in known]
            if hit:
                at, x = zip(*hit)
                rows[r] = np.array(x) @ base[list(at)]
        return rows @ root

    witness = [sorted(ws, key=lambda w: (-telling.get(w, -9.0), w))[:TOP] for ws, label in zip(words, y) if label]
    negative = dict.fromkeys(plain)
    stored: dict[str, np.ndarray] = {}
    model = empty
    for _ in range(ROUNDS):
        # A word that clean texts have about as often tells nothing, wherever it stands.
        found = Counter(w for ws in witness for w in ws[:2] if telling.get(w, 0.0) > 1.0)
        positive = list(found)
        against = [w for w in negative if w not in found]
        need = [w for w in positive + against if w not in stored]
        stored.update(zip(need, features(need)))
        x = np.array([stored[w] for w in positive + against])
        label = np.array([1.0] * len(positive) + [-1.0] * len(against))
        weight = np.concatenate([np.array([found[w] for w in positive], float) / sum(found.values()),
                                 np.full(len(against), 1.0 / max(len(against), 1))]) * 1000
        w, bias = support_vectors(x, label, weight)
        table = np.zeros(1 << 20, np.float32)
        table[list(known)] = base @ (root @ w)
        model = Model(table, bias, np.zeros(TOP), 0.0)
        _, worst = best_words(model, [texts[i] for i in fit])
        witness = [b for b, label in zip(worst, y) if label]
        negative.update(dict.fromkeys(b for bs, label in zip(worst, y) if not label for b in bs[:1]))
    rest = [i for i in range(len(texts)) if i % 4 == 0]
    best, _ = best_words(model, [texts[i] for i in rest])
    label = np.array([toxic[i] for i in rest], float)
    share_here = label.mean()
    weight = np.where(label > 0, share / max(share_here, 1e-9), (1 - share) / max(1 - share_here, 1e-9))
    a = np.column_stack([best, np.ones(len(best))])
    line, damp = np.zeros(TOP + 1), 1e-1 * np.eye(TOP + 1)
    for _ in range(50):  # logistic regression on the worst words' scores, a little damped so that it ends
        p = 1 / (1 + np.exp(-np.clip(a @ line, -35, 35)))
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + damp
        line = line + np.linalg.solve(hessian, a.T @ (weight * (label - p)) - damp @ line)
    return Model(model.weights, model.bias, line[:-1], float(line[-1]))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Bounds: ``rows`` toxic and as many other labelled rows, in hashed order, with texts of up to
    ``chars`` characters. Labels are per doc_id; null ids and null labels teach nothing, of
    several labels for an id the greatest counts. The share of toxic rows comes from all labels.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy(
        F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic_label"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic_label").count().collect()}
    if len(counts) < 2:
        return train([], [], counts.get(1, 0) / max(1, sum(counts.values())))
    pick = lambda label: known.filter(F.col("toxic_label") == label).orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = pick(0).unionByName(pick(1))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).filter(F.char_length("text") <= chars)
    sample = texts.join(F.broadcast(chosen), "id").select("text", "toxic_label").distinct()
    share = counts[1] / sum(counts.values())

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "toxic_label"]).iloc[np.random.default_rng(11).permutation(len(rows))]
        model = train(rows["text"].tolist(), rows["toxic_label"].tolist(), share)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    # The bounded sample meets in one task, so that the driver holds no texts.
    made = sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "model binary").head()
    return pickle.loads(made[0]) if made else train([], [], share)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score, worst_words): every row as it came, in a struct, with the probability of toxicity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, word = best_words(model, [t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.probability(best)), pa.array(word, pa.list_(pa.string()))],
                names=["row", "score", "worst_words"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    schema = rows.select("row", F.lit(0.0).alias("score"), F.array(F.lit("")).alias("worst_words")).schema
    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on the labelled rows that are not held out and score every whole text.

    One row per input row: row (all its columns), held_out, score, predicted, worst_words. A null or
    empty text gets the score of a text without words. A null id is not held out. Repeated rows stay; an
    empty table gives no row; without labels of both kinds every text gets the share of toxic rows.
    """
    scored = score_texts(docs, fit_model(docs, labels))
    out = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("row", F.coalesce(out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_words")
