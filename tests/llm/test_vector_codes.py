"""Vector codes against plain loops, with odd vectors, repeated rows and one vector that a third of the rows share."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from fairlead.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector long, codes int, position int, error string"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    ids = sorted({r[0] for r in kept}, key=lambda i: (i is None, i or 0))[:entries]
    first = [min((list(r[1]), q) for r, q in zip(kept, whole) if r[0] == i)[1] for i in ids]
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(parts):
        cut = [q[p * width:(p + 1) * width] for q in whole]
        book = [q[p * width:(p + 1) * width] for q in first]
        near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))
        for _ in range(rounds):
            at = [near(v)[1] for v in cut]
            for j in range(len(book)):
                own = [v for v, a in zip(cut, at) if a == j]
                if own:
                    book[j] = [sum(c) // len(own) for c in zip(*own)]
        for i, v in enumerate(cut):
            far, j = near(v)
            codes[i].append(j)
            errors[i] += far
        books.append(book)
    return [(r[0], r[2], tuple(c), e) for r, c, e in zip(kept, codes, errors)], books


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, "e") for r in rows], SCHEMA).repartition(3)


def odd_vectors(width):
    rng = random.Random(width)
    vector = lambda: [rng.gauss(0, 0.3) for _ in range(width)]
    rows = [(rng.randrange(-500, 500), vector(), rng.choice([None, 1, 2])) for _ in range(300)]
    same = vector()
    rows += [(1000 + i, same, 7) for i in range(150)]
    rows += [rows[0]] * 3 + [(None, vector(), None), (None, same, 1)]
    rows += [(2000, None, 1), (2001, [None] * width, 1), (2002, [float("nan")] * width, 1), (2003, [float("inf"), 0.0], 1)]
    rows += [(-900, [], 1), (2004, [0.5], 2), (2005, [9.0] * width, None), (2**60, [-0.0] * width, None)]
    return rows


@pytest.mark.parametrize("width", [16, 19])
def test_codes(spark, width, monkeypatch):
    monkeypatch.setattr(vector_codes, "TASK_PARTS", 300)
    monkeypatch.setattr(vector_codes, "SALT_VECTORS", 40)
    monkeypatch.setattr(vector_codes, "DEAL_VECTORS", 30)
    monkeypatch.setattr(vector_codes, "COMPARE_PARTS", 7)
    rows = odd_vectors(width)
    out, books = vector_codes.encode_vectors(frame(spark, rows))
    want, want_books = plain(rows)
    got = [(r.id, r.label, tuple(r.codes), r.error) for r in out.collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert books.tolist() == want_books


def test_members_stay(spark):
    """Rounds keep the number of partitions, and only members that change their entry are shuffled."""
    rows = odd_vectors(16)
    kept = frame(spark, rows).selectExpr("vec_id id", "cast(label as bigint) label", "embedding vector").filter(
        vector_codes.finite("vector"))
    kept = kept.selectExpr("id", "label", "xxhash64(id, label, vector) key", "vector")
    record = np.dtype([("id", "<i8"), ("label", "<i8"), ("key", "<i8"), ("nulls", "u1"), ("position", "u1"), ("entry", "u1"),
                       ("part", "<i4", (2,))])
    plan = vector_codes.Plan(8, 2, 4096, 4, 6, record)
    books = vector_codes.first_books(kept, 16, plan)
    members, books = vector_codes.lloyd(vector_codes.deal(kept, books, plan), books, plan, 4)
    assert members.getNumPartitions() == 6 and members.partitioner is not None
    for number, own in members.mapPartitionsWithIndex(
            lambda i, blocks: [(i, vector_codes.resident(blocks, plan))]).collect():
        assert (plan.owner(own["position"], own["entry"], own["key"]) == number).all()


def test_few_and_none(spark):
    for rows in ([], [(1, None, 1)], [(5, [], 3)], [(5, [0.1, 0.2], 3), (6, [0.1, 0.3], None)]):
        out, books = vector_codes.encode_vectors(frame(spark, rows))
        want, want_books = plain(rows)
        got = [(r.id, r.label, tuple(r.codes), r.error) for r in out.collect()]
        assert collections.Counter(got) == collections.Counter(want)
        assert not want or books.tolist() == want_books


def test_query(spark, tmp_path):
    rows = odd_vectors(16)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    want, books = plain(rows)
    label_error = collections.Counter()
    for _, label, _, error in want:
        label_error[label] += error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    assert collections.Counter(map(tuple, got)) == collections.Counter(
        (i, "".join(f"{c:02x}" for c in codes), error, label_error[label], sha) for i, label, codes, error in want)
