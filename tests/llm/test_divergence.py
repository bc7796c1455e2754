"""The divergence audit and its perfect hashes against plain loops."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.llm import divergence, perfect_hash, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, count long, shard long, value long, item string"


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(
        r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: collections.Counter() for s in {d[1] for d in own}}
        for _, source, found in own:
            count[source].update(t for t in found if held[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), collections.Counter()))
        value = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(o, sum(value(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, value(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:last])]
    return out


def odd_rows():
    rng = random.Random(3)
    words = ["the", "The", "THE", "été", "Éa", "x", "naïve", "日本", "a-b", "c3d", "𝒳", "z" * 300, "y" * 300] + [
        "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: rng.choice([" ", "\n", ", ", "\x00", "`"]).join(rng.choice(words) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "S é", None, ""])) for _ in range(120)]
    rows += [(None, "en", "only nulls"), ("", "xx", "a"), ("", "xx", "b"), (None, None, None), ("solo word", "yy", "one")]
    rows += [(text(3000), "en", "s1")] * 2 + [("hot hot cold", "en", f"many{i}") for i in range(40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 1, 2, 3, "i") for i, r in enumerate(rows)], SCHEMA).repartition(4)


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, small, monkeypatch):
    if small:  # many shards, a pass per few of them, tasks that flush early, many runs and tiles
        for name, value in dict(SHARD_TERMS=7, BLOCK_BYTES=600, HELD_TERMS=20, HELD_SLOTS=30, PAIR_SLOTS=3, PAIR_SOURCES=2).items():
            monkeypatch.setattr(divergence, name, value)
    rows = [r for r in odd_rows() if not small or not (r[2] or "").startswith("many") or r[2] in ("many1", "many2", "many3")]
    got = divergence.source_divergence(frame(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))


def test_top_and_least(spark):
    rows = odd_rows()[:100]
    got = divergence.source_divergence(frame(spark, rows), 1, 5).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows, 1, 5))


def test_none(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0
    assert divergence.source_divergence(frame(spark, [("a b", "en", "s"), ("a", "en", "t")])).count() == 2


def test_query(spark, tmp_path):
    rows = odd_rows()[:60]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_source_divergence(spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_perfect_hash(n):
    keys = [f"key {i}".encode() * (1 if i % 9 else 60) for i in range(n)]
    seed, steps, slots = perfect_hash.build(keys, 42)
    assert sorted(slots) == list(range(n))
    kept = [perfect_hash.stored(k) for _, k in sorted(zip(slots, keys))]
    shards = perfect_hash.Shards(1, 42, [(0, seed, steps.tobytes(), np.array([len(k) for k in kept], np.int32).tobytes(), b"".join(kept))])
    assert shards.find(keys).tolist() == slots
    assert (shards.find([k + b"!" for k in keys]) == -1).all()


def test_equal_hashes(monkeypatch):
    """Keys of one hash get another seed, and are found by it."""
    true = perfect_hash.hash_key
    monkeypatch.setattr(perfect_hash, "hash_key", lambda key, seed: true(b"one" if seed == 42 and key in (b"a", b"b") else key, seed))
    seed, steps, slots = perfect_hash.build([b"a", b"b", b"c"], 42)
    kept = [k for _, k in sorted(zip(slots, [b"a", b"b", b"c"]))]
    shards = perfect_hash.Shards(1, 42, [(0, seed, steps.tobytes(), np.ones(3, np.int32).tobytes(), b"".join(kept))])
    assert seed != 42 and shards.find([b"a", b"b", b"c", b"d"]).tolist() == [*slots, -1]


def test_exact_shares(spark):
    rng = random.Random(1)
    pairs = [(c, c + rng.randrange(1, 10**13)) for c in (1, 5, 10**9, 10**13, 3 * 10**14)] + [(1, 1), (7, 7)]
    want = [1 + 10**9 * c // n for c, n in pairs]
    assert divergence.shares(np.array([c for c, _ in pairs]), np.array([n for _, n in pairs])).tolist() == want
    rows = spark.createDataFrame(pairs, "c long, n long")
    got = rows.select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("s")).collect()
    assert collections.Counter((r.c, r.n, r.s) for r in got) == collections.Counter((*p, w) for p, w in zip(pairs, want))


def test_terms_are_runs_of_letters():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"aZ\x00 \n\x1c[`{\x7f\x80\xc3\xff09_") for _ in range(60)) for _ in range(200)]
    for text in [*texts, bytes(range(256)), "Ärger İ ß".encode()]:
        assert divergence.terms(text) == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_counts_of_tasks_are_summed_after_the_shuffle_only(spark):
    rows = spark.createDataFrame([("en", bytearray(b"one two"))], "lang string, text binary")
    plan = divergence.document_frequencies(rows)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.index("MapInArrow")
    assert "HashAggregate" not in plan[plan.index("Exchange"):]
