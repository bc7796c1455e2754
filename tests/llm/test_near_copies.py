"""The near-copy stage of the pipeline against plain loops."""

import collections
import random

import pytest

from fairlead.llm import near_copies


def plain_sets(text):
    words = (text or "").encode().translate(near_copies.LOWER).split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_components(texts):
    sets = {t: plain_sets(t) for t in texts}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(texts)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return {t: find(t) for t in texts}


def edited_copies():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = text(30)
    out = []
    for n in (12, 60, 61, 200, 600):
        for _ in range(4):
            base = text(n)
            out.append(base)
            for edits in (1, 1, 2, 4, 8, 20):  # chains: copies of copies
                near = list(out[-1] if rng.random() < 0.5 else base)
                for _ in range(min(edits, n // 10)):
                    near[rng.randrange(len(near))] = rng.choice(vocabulary)
                out.append(near)
    out += [text(20) + common + text(20) for _ in range(30)]
    out += [(b := list(common))[:k] + ["x"] + b[k:] for k in range(30)]
    return [" ".join(w) for w in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, root long").repartition(3)


@pytest.mark.parametrize("listed", [near_copies.LISTED, 0])
def test_one_per_near_copy(spark, listed):
    rows = [(i, t, 1) for i, t in enumerate(edited_copies())]
    base = rows[50][1]
    rows += [(None, base, 1), (None, "no id", 1), (None, "none either", 1), (None, "No  ID ", 1), (3, "other text of an id", 1),
             (3, "a third text of that id", 1), (3, "a third text of that id", 1), (-7, base.upper(), 1), (900, None, 1), (901, " \n", 1), (902, "", 1)]
    root = plain_components({t or "" for _, t, _ in rows})
    groups = collections.defaultdict(set)
    for d, t, _ in rows:
        groups[root[t or ""]].add((d is None, d or 0, t or ""))
    got = near_copies.one_per_near_copy(frame(spark, rows), listed)
    assert got.columns == ["doc_id", "text", "root"]
    kept = collections.Counter(root[r.text or ""] for r in got.collect())
    assert set(kept) == set(groups) and set(kept.values()) == {1} and len(groups) < len(rows) - 60
    least = {k: min((n, d) for n, d, _ in v) for k, v in groups.items()}
    assert all((r.doc_id is None, r.doc_id or 0) == least[root[r.text or ""]] for r in got.collect())
    assert near_copies.one_per_near_copy(frame(spark, rows).limit(0)).count() == 0


def test_pipeline_drops_edited_copies(spark):
    from corpus_pipeline import drop_near_copies

    words = [f"word{i}" for i in range(100)]
    edited = [*words[:50], "edited", *words[51:]]
    got = drop_near_copies(spark, frame(spark, [(1, " ".join(words), 1), (2, " ".join(edited), 1)]), "").collect()
    assert [r.doc_id for r in got] == [1]


def test_pipeline_finds_near_copies_by_fingerprints(spark, monkeypatch):
    """The stage gets its pairs through the fingerprints: without a link between them only equal texts are one."""
    from corpus_pipeline import drop_near_copies
    from fairlead.llm import simhash

    words = [f"word{i}" for i in range(100)]
    edited = [*words[:50], "edited", *words[51:]]
    rows = [(1, " ".join(words), 1), (2, " ".join(edited), 1), (3, " ".join(words), 1), (None, "other", 1), (4, "other", 1), (5, "apart", 1)]
    kept = lambda: sorted(r.doc_id for r in drop_near_copies(spark, frame(spark, rows), "").collect())
    assert kept() == [1, 4, 5]
    monkeypatch.setattr(simhash, "links", lambda distinct: distinct.select(distinct.fp.alias("a"), distinct.fp.alias("b")).limit(0))
    assert kept() == [1, 2, 4, 5]


def test_large_components_are_dealt_to_several_tasks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = [(1, " ".join(words), 1), (0, "apart", 1)]
    for i in range(2, 30):
        edited = list(words)
        edited[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(edited), 1))
    kept = lambda: sorted(r.doc_id for r in near_copies.one_per_fingerprint_group(frame(spark, rows)).collect())
    whole = kept()
    assert whole[:2] == [0, 1] and len(whole) < 20
    monkeypatch.setattr(near_copies, "TOGETHER", 2)
    assert kept() == whole


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_components_end_alike_in_rounds_and_in_one_task(spark, few):
    from fairlead.operators.graph import connected_components

    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 230)]
    least = {n: n for n in range(240)}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = connected_components(spark.range(240).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"), few)
    assert {r.node: r.component for r in got.collect()} == least


@pytest.mark.parametrize("small", [False, True])
def test_the_stage_leaves_out_no_near_copy(spark, monkeypatch, small):
    """Texts near others than their component's first text, and copies with more edits than two bits, are found as plain loops find them."""
    if small:
        for name, size in (("TOGETHER", 2), ("BUCKET", 40), ("HELD", 100), ("ENOUGH", 1)):
            monkeypatch.setattr(near_copies, name, size)
    rows = [(i, t, 1) for i, t in enumerate(edited_copies())]
    rows += [(None, rows[50][1], 1), (None, "no id", 1), (None, "none either", 1), (3, "other text of an id", 1),
             (3, "other text of an id", 1), (-7, rows[50][1].upper(), 1), (900, None, 1), (901, " \n", 1), (902, "", 1)]
    root = plain_components({t or "" for _, t, _ in rows})
    groups = collections.defaultdict(set)
    for d, t, _ in rows:
        groups[root[t or ""]].add((d is None, d or 0))
    got = near_copies.one_per_fingerprint_group(frame(spark, rows)).collect()
    assert sorted(root[r.text or ""] for r in got) == sorted(groups) and len(groups) < len(rows) - 60
    assert all((r.doc_id is None, r.doc_id or 0) == min(groups[root[r.text or ""]]) for r in got)
