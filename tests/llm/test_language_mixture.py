"""Language mixtures: trigrams and expectation-maximisation against plain loops, planted mixtures, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from fairlead.llm import language_mixture as lm
from fairlead.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, row string, score double, mixture string, held_out int"
WORDS = {"en": "the of and thing tion was that with hand other shore ing water", "de": "der die und nicht schön zu eine verlich heit auch über",
         "fr": "le la des être que dans une pation élle où vous les", "ru": "и в не на что это быть как так слово вода"}


def text_of(rng, lang, n):
    words = WORDS[lang].split()
    return " ".join(rng.choice(words) + (rng.choice(words) if rng.random() < 0.3 else "") for _ in range(n)).capitalize() + "."


def odd_rows():
    rng = random.Random(9)
    rows = [(i, text_of(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 60)), lang) for i in range(160)]
    rows += [(500, None, "en"), (501, "", "en"), (502, " 12 !? \n", "nn"), (503, "42", "nn"), (504, text_of(rng, "en", 9), None),
             (None, text_of(rng, "de", 30), "de"), (505, text_of(rng, "fr", 20_000), "fr"), (506, "x", "en"),
             (507, "ÄÖ" * 5000, "de"), (508, "İ\x00ŉ 𝒳 日本語のテキスト", "en")]
    return rows + [rows[0]] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "clash", 0.5, "m", 1) for i, t, lang in rows], SCHEMA).repartition(3)


def test_trigrams():
    texts = ["", "Ab, c", "12", "é" * 40 + " x", "日本 a", "ab"]
    bucket, first, number = lm.trigrams(texts, 1 << 20)
    units, owner = [], []
    for i, t in enumerate(texts):
        run = []
        for j, c in enumerate(t):
            if not c.isalpha():
                continue
            if j and t[j - 1].isalpha() and len(run) < lm.UNIT_LETTERS:
                units[-1].append(tuple(t[k] if 0 <= k < len(t) and t[k].isalpha() else "" for k in (j - 1, j, j + 1)))
                run.append(c)
            else:
                units.append([tuple(t[k] if 0 <= k < len(t) and t[k].isalpha() else "" for k in (j - 1, j, j + 1))])
                owner.append(i)
                run = [c]
    assert np.diff([*first, len(bucket)]).tolist() == [len(u) for u in units]
    assert number.tolist() == owner
    known = {}
    for gram, b in zip([g for u in units for g in u], bucket):
        assert known.setdefault(gram, b) == b
    assert len(set(known.values())) == len(known)


def plain_proportions(units, penalty):
    """The same rule for one text, one number at a time; units are lists of log-likelihoods."""
    n, k = len(units), len(units[0])
    best = [[max(x - max(u), lm.FLOOR) for x in u] for u in units]
    total = [sum(b[j] for b in best) for j in range(k)]
    share = [0.0] * k
    share[total.index(max(total))] = 1.0
    gained = max(total)
    while n > 1 and 0.0 in share:
        like = [[math.exp(x) for x in b] for b in best]
        mix = [sum(p * x for p, x in zip(share, u)) for u in like]
        steep = [-1.0 if share[j] > 0 else sum(u[j] / m for u, m in zip(like, mix)) for j in range(k)]
        j = steep.index(max(steep))
        fitted = [p * 0.75 + (0.25 if i == j else 0) for i, p in enumerate(share)]
        for _ in range(lm.EM_STEPS):
            blame = [[p * x for p, x in zip(fitted, u)] for u in like]
            fitted = [sum(b[i] / sum(b) for b in blame) / n for i in range(k)]
        reached = sum(math.log(sum(p * x for p, x in zip(fitted, u))) for u in like)
        if not (steep[j] > n and reached - gained > penalty * math.log(n + 1)):
            break
        share, gained = fitted, reached
    return share


def test_proportions():
    rng = np.random.default_rng(4)
    texts = []
    for i in range(40):
        n = int(rng.integers(0, 30))
        logs = rng.normal(-20, 2, (n, 5))
        for r in range(n):
            logs[r, rng.integers(0, 1 + i % 4)] += 9
        texts.append(logs)
    number = np.repeat(np.arange(40), [len(t) for t in texts])
    got = lm.proportions(np.concatenate(texts), number, 40, 0.5)
    for t, g in zip(texts, got):
        want = plain_proportions(t.tolist(), 0.5) if len(t) else [0.0] * 5
        assert np.allclose(g, want, atol=1e-9)
    assert {int((g > 0).sum()) for g in got} >= {0, 1, 2, 3}


def test_mixtures(spark):
    """Planted proportions of two or three languages come back."""
    rng = random.Random(2)
    docs = frame(spark, odd_rows())
    model = lm.learn(docs)
    assert model.langs == ["de", "en", "fr", "ru"]
    rows, want = [], []
    for i in range(60):
        langs = rng.sample(list(WORDS), rng.choice([1, 2, 3]))
        parts = [text_of(rng, lang, rng.randint(30, 80)) for lang in langs]
        words = [len(p.split()) for p in parts]
        rows.append((i, " ".join(parts), None))
        want.append({lang: n / sum(words) for lang, n in zip(langs, words)})
    for r in lm.mixtures(frame(spark, rows), model).collect():
        told = {m.lang: m.share for m in r.mixture}
        assert set(told) == set(want[r.row.doc_id])
        assert all(abs(told[lang] - share) < 0.06 for lang, share in want[r.row.doc_id].items())
        assert r.lang_pred == max(told, key=told.get) and r.score == max(told.values())


@pytest.mark.parametrize("held", [1 << 22, 300])
def test_rows(spark, held, monkeypatch):
    monkeypatch.setattr(lm, "HELD_CHARS", held)
    rows = odd_rows()
    got = lm.identify_languages(frame(spark, rows)).collect()
    assert sorted(str(tuple(r.row)[:3]) for r in got) == sorted(map(str, rows))
    for r in got:
        assert r.held_out == (r.row.doc_id is not None and zlib.crc32(str(r.row.doc_id).encode()) % 3 == 1)
        assert 0.0 <= r.score <= 1.0
        if not any(c.isalpha() for c in r.row.text or ""):
            assert (r.lang_pred, r.score, r.mixture) == ("und", 0.0, [])
        elif r.row.lang and len(r.row.text) > 20 and r.row.doc_id != 508:
            assert r.lang_pred == r.row.lang
    rest = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 != 1]
    taught = [(i, t, lang if (i, t, lang) in rest else "wrong") for i, t, lang in rows]
    same = {(r.row.doc_id, r.row.text): r.lang_pred for r in got}
    for r in lm.identify_languages(frame(spark, taught)).collect():  # held-out labels teach nothing
        assert same[r.row.doc_id, r.row.text] == r.lang_pred


def test_nothing_to_learn(spark):
    assert lm.identify_languages(frame(spark, [])).count() == 0
    for r in lm.identify_languages(frame(spark, [(1, "some text", None), (2, None, "en"), (3, "12", "en")])).collect():
        assert (r.lang_pred, r.score) == ("und", 0.0)


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(lm, "MODEL_SIZE", 4 * lm.LEAST_BUCKETS + lm.LEAST_BUCKETS)
    model = lm.learn(frame(spark, odd_rows()))
    assert model.logs.size <= lm.MODEL_SIZE and model.langs == ["de", "en", "fr", "ru"]
    monkeypatch.setattr(lm, "MODEL_SIZE", lm.LEAST_BUCKETS)
    with pytest.raises(ValueError):
        lm.learn(frame(spark, odd_rows()))


def test_query_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op13_language_id(spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 0
