"""The training-data operators against plain loops, on small tables with every kind of odd row."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairlead.llm import decontaminate, licenses, minhash, packing, sharding, simhash, suffix_columns, superkmer, tokens, toxicity
from fairlead.llm.minimisers import blocks, byte_grams, runs, window_minima
from fairlead.llm.token_matrix import token_matrix

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, o long, tk long, key string, "
          "length long, fp long, sig string, score double, bucket long, kept string, leaks string")


def odd_texts() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(1, 7))).strip() or "x"
    long = " ".join(word() for _ in range(3000))
    passage = " ".join(word() for _ in range(120))
    near = [passage.replace(passage[60 + i:62 + i], "zz") for i in range(6)]
    texts = ["", None, "   \n\t ", "one", "Two Words", "İ ŉ 𝒳   x", long, long, passage, passage + " tail " + word(),
             word() + " " + passage, *near, "the line repeats again. " * 60, "A\x00b\x0bc", "<|endoftext|> a  b"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, passage), (None, "null id"), (3, "one"), (3, "another text of the same id"), (2**60, "far id"), (-5, passage)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_texts()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 1, *["clash", 1, 2, "k", 3, 4, "s", 0.5, 6, "kk", "l"]) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


# Packing and token matrices

def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_those_of_the_vocabulary_file(rows):
    for _, text in rows:
        assert [*tokens.encode(text or "", PATH).tolist(), 2] == plain_ids(text)
    for text in ("a" * 150_000, " " * 120_000 + "x"):
        assert tokens.encode(text, PATH).tolist() == plain_ids(text)[:-1]


def plain_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        open_bins = [(room, i) for i, room in enumerate(bins) if room >= length]
        if open_bins:
            bins[min(open_bins)[1]] -= length
        else:
            bins.append(capacity - length)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        plan, bins = packing.best_fit_plan(collections.Counter(lengths), capacity)
        assert bins == plain_best_fit(lengths, capacity)
        there = collections.defaultdict(list)
        for r in plan.itertuples():
            for k in range(r.n):
                there[r.bin + k].append((r.offset, r.length))
        for held in there.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(x for h in there.values() for _, x in h) == sorted(lengths)


def test_plan_does_not_grow_with_the_pieces():
    plan, _ = packing.best_fit_plan({i: 10**9 + i for i in range(1, 1025)}, 1024)
    assert len(plan) < 20_000
    with pytest.raises(ValueError):
        packing.best_fit_plan({11: 1}, 10)


def test_pack_documents(docs, rows, none):
    capacity = 64
    got = packing.pack_documents(docs, PATH, capacity).collect()
    want = []
    for doc, text in rows:
        ids = np.array(plain_ids(text), "<u4")
        want += [(doc, k, a, n, zlib.crc32(ids[a:a + n].tobytes())) for k, (a, n) in enumerate(tokens.cuts(len(ids), capacity))]
    same([r[:5] for r in got], want)
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == plain_best_fit([r.length for r in got], capacity)
    assert packing.pack_documents(none, PATH, capacity).count() == 0


def test_token_matrix_round_trip(docs, rows, none):
    capacity, parts = 64, collections.defaultdict(list)
    for r in token_matrix(docs, PATH, capacity).collect():
        ids, position = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(position) == capacity and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens:] == 2).all()
        for (a, b), s in zip(zip(r.cu_seqlens, r.cu_seqlens[1:]), r.segments, strict=True):
            assert position[a:b].tolist() == list(range(b - a)) and s.length == b - a
            parts[s.doc_id].append((s.piece, s.start, ids[a:b].tolist()))
    want = collections.defaultdict(list)
    for doc, text in rows:
        ids = plain_ids(text)
        want[doc] += [(k, a, ids[a:a + n]) for k, (a, n) in enumerate(tokens.cuts(len(ids), capacity))]
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_matrix(none, PATH, capacity).count() == 0


# Sharding

def test_differencing_balances():
    rng = np.random.default_rng(0)
    parts = np.zeros((2000, 40), np.int64)
    parts[:, 0] = rng.integers(16, 20_000, 2000)
    to = sharding.differencing(parts)
    sums = np.bincount(to[:, 0], weights=parts[:, 0], minlength=40)
    assert sums.max() - sums.min() <= 16
    assert all(sorted(row) == list(range(40)) for row in to.tolist())
    assert sharding.differencing(parts[:0]).shape == (0, 40)


def test_shards(spark, docs, rows, none):
    got = sharding.shard_documents(docs, 4).collect()
    same([(r.doc_id, r["size"], r.text_crc32) for r in got],
         [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows])
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    homes = collections.defaultdict(set)
    for r in got:
        homes[r["size"], r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_documents(none, 4).count() == 0
    # Many small buckets and several levels give about the balance of one.
    groups = spark.range(3000).select(F.col("id").cast("string").cast("binary").alias("group"), (F.col("id") % 997 + 16).alias("bytes"))
    placed = sharding.shard_groups(groups, 8, 3000, bucket_groups=50, fan_in=6)
    sums = [r[0] for r in placed.join(groups, "group").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert placed.count() == 3000 and len(sums) == 8 and max(sums) - min(sums) <= 30


# Similarity fingerprints

def plain_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not lower:
        return 0
    width = min(3, len(lower))
    hashes = [xxhash.xxh64_intdigest(b" ".join(lower[i:i + width]), 42) for i in range(len(lower) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(fps)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_components(docs, rows, none):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    root = plain_components({f for _, f in fps})
    least = collections.defaultdict(lambda: None)
    for d, f in fps:
        if d is not None and (least[root[f]] is None or d < least[root[f]]):
            least[root[f]] = d
    got = simhash.simhash_components(docs).collect()
    same([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], [(d, f, least[root[f]]) for d, f in fps])
    assert simhash.simhash_components(none).count() == 0


def test_links_connect_all_within_two_bits(spark):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        center = rng.getrandbits(64)
        fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(15)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(a % 2**64, b % 2**64) for a, b in simhash.links(df).collect()]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    want = plain_components(fps)
    groups = lambda f: sorted(sorted(x for x in fps if f(x) == r) for r in {f(x) for x in fps})
    assert groups(find) == groups(want.get)
    assert len(edges) < 65 * len(fps)


def test_one_per_component(docs, none):
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    found = {r.component_id for r in simhash.simhash_components(docs).collect()}
    got = kept.collect()
    assert {r.doc_id for r in got} >= {f for f in found if f is not None} and len(got) == len(found)
    assert simhash.one_per_component(none).count() == 0


# One-permutation fingerprints

def test_fingerprints(docs, rows, none):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    want = []
    for (d, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    got = minhash.fingerprint_documents(docs).collect()
    same([r[:3] for r in got], want)
    for r in got:
        assert len(r.fingerprint) in (0, 256) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    of = collections.defaultdict(set)
    texts = dict(rows)
    for r in got:
        if r.doc_id in (6, 7):
            of[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(f) == 1 for f in of.values())
    assert minhash.fingerprint_documents(none).count() == 0


def test_likeness_estimates_common_shingles(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    cases = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for n in (40, 400):
            a = [word() for _ in range(n)]
            b = a[:int(share * n)] + [word() for _ in range(n - int(share * n))]
            grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
            cases.append((" ".join(a), " ".join(b), len(grams(a) & grams(b)) / len(grams(a) | grams(b))))
    df = spark.createDataFrame(cases, "a string, b string, truth double")
    sig = df.select(minhash.signature(F.col("a")).alias("a"), minhash.signature(F.col("b")).alias("b"), "truth")
    for r in sig.select(minhash.likeness(F.col("a"), F.col("b")).alias("got"), "truth").collect():
        assert abs(r.got - r.truth) < 0.17
    plan = minhash.fingerprint_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_id_ranges_keep_the_order(spark):
    ids = [0, 1, 5, 10**12, 10**12 + 3, -7, 2**62] + list(range(20_000, 29_000))
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    coarse, fine = minhash.id_ranges(df)
    got = df.select("doc_id", coarse.alias("c"), fine.alias("f")).orderBy("doc_id").collect()
    assert [(r.c, r.f) for r in got] == sorted((r.c, r.f) for r in got)


# Repeated bytes

def plain_repeated(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0,
                    hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [5_000, 1])
def test_repeated_bytes(docs, rows, none, hot):
    got = suffix_columns.remove_repeated_bytes(docs, 40, 16, hot).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got], plain_repeated(rows, 40))
    assert suffix_columns.remove_repeated_bytes(none, 40, 16, hot).count() == 0


def test_column_order_finds_all_repeats():
    rng = random.Random(3)
    for span in (1 << 30, 2, 1):
        for _ in range(60):
            length, gram = 6, 2
            base = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) for _ in range(4)]
            texts = [b"".join(rng.sample(base, 2)) for _ in range(5)]
            count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
            strings, places, where = collections.Counter(), {}, []
            for d, t in enumerate(texts):
                if len(t) < length:
                    continue
                h = byte_grams(np.frombuffer(t, np.uint8), gram)
                least = window_minima(h, length - gram + 1)
                for a, b in runs(least):
                    for x, y, place in blocks(h, least[a], a, b, length - gram + 1, span):
                        s = t[x:y - 1 + length]
                        assert places.setdefault(s, place) == place
                        strings[s] += 1
                        where.append((d, x, s))
            if strings:
                keys = list(strings)
                found = dict(zip(keys, suffix_columns.repeated_windows(
                    keys, [strings[k] for k in keys], [places[k] for k in keys], length)))
                for d, x, s in where:
                    assert found[s].tolist() == [count[texts[d][x + i:x + i + length]] > 1 for i in range(len(s) - length + 1)]


def test_a_string_a_text_holds_many_times_is_one_row():
    length, gram = 64, 16
    text = b"Is onhe. " * 60
    least = window_minima(byte_grams(np.frombuffer(text, np.uint8), gram), length - gram + 1)
    times = [{"m": m, "n": 2} for m in set(least.view(np.int64).tolist())]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"k"]), pa.array([text]), pa.array([times], pa.list_(pa.struct([("m", pa.int64()), ("n", pa.int64())]))), pa.array([1])],
        names=["tk", "text", "shared", "copies"])
    rows = [r for made in suffix_columns._strings(length, gram, 5_000)(iter([batch])) for r in made.to_pylist()]
    assert len({(r["bucket"], r["h"]) for r in rows}) == len(rows) < 10 and max(len(r["starts"]) for r in rows) > 30


# Repeated word windows

def plain_windows(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    order = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, 2**63), order(d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < order(d):
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [5_000, 1])
def test_repeated_windows(docs, rows, none, hot):
    got = superkmer.substring_dedup(docs, hot=hot)
    same(got.select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect(), plain_windows(rows, 13))
    assert got.select("row.*").columns == docs.columns
    assert superkmer.substring_dedup(none, hot=hot).count() == 0


def test_a_null_id_loses_an_embedded_passage(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = some(60)
    more = [(1, some(30) + " " + passage + " " + some(30)), (None, some(25) + " " + passage + " " + some(25)),
            (None, some(9) + " " + passage[:200] + " " + some(9))]
    got = superkmer.substring_dedup(frame(spark, more)).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, plain_windows(more, 13))
    assert sorted(r.n_removed for r in got)[-1] >= 60


def test_each_text_is_cut_once_for_minimisers_and_once_for_strings(docs):
    plan = superkmer.substring_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4  # minimisers, strings, their judging, the words kept


def test_windows_of_earlier_owners():
    words = lambda *w: b" ".join(b"w%d" % i for i in w)
    rows = [(words(1, 2, 3, 4), 5, 50, [0]), (words(1, 2, 3, 4), 5, 50, [9]), (None, 6, 60, [2, 4]), (words(0, 1, 2, 3), 6, 61, [7, 20]),
            (words(1, 2, 3, 4), 8, 80, [3]), (words(0, 1, 2, 9), 9, 90, [1]), (words(7, 8, 9), 9, 91, [0])]
    assert list(superkmer.later_runs(rows, 3)) == [
        (6, 60, [2, 4]), (6, 61, [8, 9, 21, 22]), (8, 80, [3, 5]), (9, 90, [1, 2])]


# Benchmark decontamination

def plain_edits(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_matches_are_those_within_the_budget():
    rng = random.Random(2)
    for _ in range(120):
        item = decontaminate.normal("".join(rng.choice("abcde ") for _ in range(rng.randint(10, 110))))
        index = decontaminate.Index([(1, item)], 8, 0.08)
        if not index.edits:
            continue
        edited = list(item)
        for _ in range(rng.randint(0, index.edits[0] + 3)):
            at, kind = rng.randrange(len(edited) + 1), rng.random()
            if kind < 0.33 and at < len(edited):
                edited[at] = rng.choice("xyz")
            elif kind < 0.66 and at < len(edited):
                del edited[at]
            else:
                edited.insert(at, rng.choice("xyz"))
        noise = lambda: "".join(rng.choice("fghij ") for _ in range(50))
        text = decontaminate.normal(noise() + "".join(edited) + noise())
        edits, found = plain_edits(item, text), decontaminate.matches(index, text)
        assert (edits <= index.edits[0]) == bool(found)
        assert not found or (found[0][1] == edits and plain_edits(item, text[found[0][2]:found[0][3]]) == edits)


def test_contaminated(spark, docs, rows, none):
    item = " ".join(f"benchmark question number {i}" for i in range(6))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " "), (4, "nowhere to be found in any text at all"), (None, "null id")],
                                  "item_id long, text string")
    more = docs.unionByName(frame(spark, [(900, "x " * 300_000 + item.upper().replace(" ", "\n  ") + " y" * 900),
                                          (901, item.replace("question", "queztion"))]))
    for size in (4_000_000, 60):
        got = {r.row.doc_id: [(x.item_id, x.edits) for x in r.leaks] for r in decontaminate.contaminated(more, bench, block_chars=size).collect()
               if r.leaks}
        assert got == {900: [(1, 0)], 901: [(1, 6)], None: [(None, 0)]}
    assert decontaminate.contaminated(more, bench).count() == len(rows) + 2
    assert decontaminate.contaminated(docs, bench.limit(0)).filter("size(leaks) = 0").count() == len(rows)
    assert decontaminate.contaminated(none, bench).count() == 0


# Licenses

@pytest.mark.parametrize("text, name", [
    ("Prose here. Licensed under the Apache License, Version 2.0. More prose.", "Apache-2.0"),
    ("x\nReleased under the MIT License.", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    ("He has a driving licence and likes the copyright office.", None),
])
def test_classify(text, name):
    (a, b), = licenses.blocks(text)
    assert {r["license"] for r in licenses.classify(text[a:b])} == {name}


@pytest.mark.parametrize("text, names", [
    ("MIT License or Apache License, Version 2.0", ["MIT", "Apache-2.0"]),
    ("Parts are under the MIT License.\nBSD 3-Clause License\nMozilla Public License, v. 2.0\n", ["MIT", "BSD-3-Clause", "MPL-2.0"]),
    ("SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0"]),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1+", ["MIT", "Apache-2.0", "LGPL-2.1"]),
    ("GNU General Public License v3.0", ["GPL-3.0"]),
    ("Licensed under GPLv3 or AGPL version 3", ["GPL-3.0", "AGPL-3.0"]),
    ("CC BY 4.0 text, CC BY-SA 4.0 pictures, CC BY 4.0 data", ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-4.0"]),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
    ("MIT License\n\nCopyright (c) someone\n\n" + licenses.TEMPLATES["MIT-text"][1][1], ["MIT", "MIT"]),
    ("GNU Lesser General Public License of no version", [None]),
])
def test_every_license_of_a_block(text, names):
    found = [r for a, b in licenses.blocks(text) for r in licenses.classify(text[a:b])]
    assert [r["license"] for r in found] == names


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from(["a", "b", "c", "d", None]), max_size=12))
def test_common_places(wording, stretch):
    def longest(i, j):
        if i == len(wording) or j == len(stretch):
            return 0
        return max(longest(i + 1, j), longest(i, j + 1), *([1 + longest(i + 1, j + 1)] if wording[i] == stretch[j] else []))

    got = licenses.common_places(wording, stretch)
    assert all(wording[i] == stretch[j] for i, j in got) and len(got) == len({j for _, j in got}) == len({i for i, _ in got})
    assert got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)
    if len(wording) <= 5 and len(stretch) <= 7:
        assert len(got) == longest(0, 0)


def test_wordings_hold_where_a_plain_search_finds_them():
    """Every stretch of the block, widest allowed, against every wording: a license is found exactly where one has enough words."""
    rng = random.Random(11)
    for _ in range(60):
        name = rng.choice([n for n in licenses.TEMPLATES if n.endswith("-text") or n == "GPL-3.0"])
        wording = licenses.words(max(licenses.TEMPLATES[name][1], key=len))
        must = set(licenses.words(licenses.TEMPLATES[name][0])) & set(wording)
        text = [w for w in wording if rng.random() > 0.15]
        have = ["x"] * rng.randrange(9) + text + ["y"] * rng.randrange(9)
        enough = len(text) >= licenses.COVER * len(wording) and must <= set(text)
        assert len(list(licenses._held(wording, must, have))) == enough


def test_license_scan(spark, docs, none):
    more = docs.unionByName(frame(spark, [(800, "y " * 90_000 + "\nReleased under the MIT License.\n" + "z " * 90_000), (801, "Released under the MIT License.")]))
    got = {(r.doc_id, r.start, r.license) for r in licenses.license_scan(more).collect()}
    assert got == {(800, 180_001, "MIT"), (801, 0, "MIT")}
    dual = frame(spark, [(802, "MIT License or Apache-2.0"), (None, "MIT License or Apache-2.0"), (803, "A copyright of no license.")])
    same([(r.doc_id, r.block, r.license, r.place) for r in licenses.license_scan(dual).collect()],
         [(i, 0, n, p) for i in (802, None) for n, p in (("MIT", 0), ("Apache-2.0", 3))] + [(803, 0, None, None)])
    assert licenses.license_scan(none).count() == 0


# Toxicity

def test_toxicity(spark, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "so"]) for _ in range(rng.randint(1, 4)))
    bad, texts, labels = ["grobnax", "fuzwhit", "plovik"], [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 120))]
        if i % 5 == 0:
            for k in range(3):
                b = rng.choice(bad)
                at = rng.randrange(1, len(b))
                w.insert(rng.randrange(len(w) + 1), b[:at] + rng.choice(["", "", "*", "-"]) + b[at:] + rng.choice(["", "!"]))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = frame(spark, [*texts, (None, None), (5000, ""), (5001, "x" * 1_200_000), (5001, "x" * 1_200_000)])
    label = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, label).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.row.doc_id < 900]
    assert {r.row.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r.predicted == (r.row.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.93
    assert toxicity.score_documents(none, label).count() == 0
    assert toxicity.score_documents(docs.limit(3), label.limit(0)).count() == 3
