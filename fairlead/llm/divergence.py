"""Source divergence audit: how the term use of each source departs from the other sources and from its language.

A first pass over the documents counts in how many of them each term stands, exactly, and keeps the terms of
enough documents. These are dealt to shards with a minimal perfect hash each. Shards are broadcast in blocks of bounded
bytes, and a second pass over the documents adds to dense slots, one array per group of language and source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.llm.common import written
from fairlead.llm.perfect_hash import Shards, build, hash_key, stored

# Runs of letters and of anything beyond ASCII, as UTF-8 bytes, are terms; only A-Z are lowered and all else parts them.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEED = 42
# Terms of a shard, bytes of the shards broadcast at once, terms or slots a task holds before it sends them on.
SHARD_TERMS, BLOCK_BYTES = 8192, 32 << 20
HELD_TERMS, HELD_SLOTS = 500_000, 8_000_000
# Slots and sources whose pairs are compared in one group.
PAIR_SLOTS, PAIR_SOURCES = 512, 32
ONE = 1_000_000_000


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


def named(docs: DataFrame) -> DataFrame:
    """(lang, source, text as bytes) with nulls as empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), F.col("text").cast("binary").alias("text"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents of the language a term stands."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent():
            for lang, counted in held.items():
                found = list(counted)
                for i in range(0, len(found), 50_000):
                    part = found[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()),
                         pa.array([counted[t] for t in part], pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(set(terms(text.as_py())))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from sent()
        yield from sent()

    # Tasks have counted already, so nothing is summed before the shuffle.
    found = rows.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long").repartition("lang", "term")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def hashed_terms(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per kept term (lang, shard, slot, term), and one per shard with its hash (steps, lengths, keys)."""
    h = F.xxhash64("lang", "term")  # the term's hash, seeded with the language's
    dealt = kept.join(sizes, "lang").withColumn(
        "shard", (F.shiftrightunsigned(h, 34) % F.col("shards")).cast("long")).select("lang", "shard", "shards", "term")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, shard, shards = pdf["lang"].iloc[0], int(pdf["shard"].iloc[0]), int(pdf["shards"].iloc[0])
        keys = sorted(bytes(t) for t in pdf["term"])
        seed, steps, slots = build(keys, hash_key(lang.encode(), SEED))
        by_slot = sorted(zip(slots, keys))
        kept_keys = [stored(k) for _, k in by_slot]
        out = pd.DataFrame({"lang": lang, "shard": shard, "slot": [s for s, _ in by_slot], "term": [k for _, k in by_slot]})
        head = pd.DataFrame([{"lang": lang, "shard": shard, "shards": shards, "terms": len(keys), "seed": str(seed), "steps": steps.tobytes(),
                              "lengths": np.array([len(k) for k in kept_keys], np.int32).tobytes(), "keys": b"".join(kept_keys)}])
        both = pd.concat([head, out], ignore_index=True).astype(object)
        return both.where(both.notna(), None)[NAMES]

    schema = ("lang string, shard long, slot long, term binary, shards long, terms long, seed string, steps binary, "
              "lengths binary, keys binary")
    NAMES = [c.split()[0] for c in schema.split(", ")]
    return dealt.repartition("lang", "shard").groupBy("lang", "shard").applyInPandas(make, schema)


def blocks_of(heads: DataFrame) -> list[list[tuple[str, int]]]:
    """Shards in blocks whose hashes and keys stay within the broadcast bound; a shard alone has at most 2 MB."""
    sizes = heads.select("lang", "shard", (F.length("keys") + F.length("steps") * 3).alias("bytes")).orderBy("lang", "shard")
    blocks, room = [], 0
    for lang, shard, size in sizes.toLocalIterator():
        if not blocks or size > room:
            blocks.append([])
            room = BLOCK_BYTES
        blocks[-1].append((lang, shard))
        room -= size
    return blocks


def recount(rows: DataFrame, heads: DataFrame) -> DataFrame | None:
    """(lang, source, shard, slot, count): occurrences of every kept term in every group, zeros left out."""
    spark = rows.sparkSession
    passes = []
    for block in blocks_of(heads):
        low, high = block[0], block[-1]
        key = F.struct("lang", "shard")
        bound = lambda k: F.struct(F.lit(k[0]).alias("lang"), F.lit(k[1]).alias("shard"))
        held = heads.filter(key.between(bound(low), bound(high))).orderBy("lang", "shard").collect()
        by_lang: dict[str, list] = {}
        for r in held:
            by_lang.setdefault(r["lang"], []).append(r)
        hashes = spark.sparkContext.broadcast({
            lang: (own[0]["shards"], hash_key(lang.encode(), SEED), [
                (r["shard"], int(r["seed"]), bytes(r["steps"]), bytes(r["lengths"]), bytes(r["keys"])) for r in own])
            for lang, own in by_lang.items()})
        slots = ["lang", "source", "shard", "slot"]
        passes.append(written(counted(rows, hashes).repartition(*slots).groupBy(*slots).agg(F.sum("count").alias("count")), "recount"))
        hashes.unpersist()
    out = None
    for one in passes:
        out = one if out is None else out.unionByName(one)
    return out


def counted(rows: DataFrame, hashes) -> DataFrame:
    """Per task and group, the occurrences of the terms that the broadcast hashes store."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {lang: Shards(*told) for lang, told in hashes.value.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}
        groups: dict[tuple[str, str], Counter] = {}
        known: dict[str, dict[bytes, int]] = {lang: {} for lang in lookups}

        def places(lang: str, keys: list[bytes]) -> np.ndarray:
            """Places of keys; those found or missed lately are remembered, up to a bound."""
            lately = known[lang]
            out = np.fromiter((lately.get(k, -2) for k in keys), np.int64, len(keys))
            new = np.flatnonzero(out == -2)
            if len(new):
                asked = [keys[i] for i in new]
                out[new] = lookups[lang].find(asked)
                if len(lately) > HELD_TERMS:
                    lately.clear()
                lately.update(zip(asked, out[new].tolist()))
            return out

        def counted_in():
            for group, found in groups.items():
                at = places(group[0], list(found))
                hit = at >= 0
                if hit.any():
                    if group not in dense:
                        dense[group] = np.zeros(len(lookups[group[0]]), np.int64)
                    dense[group][at[hit]] += np.fromiter(found.values(), np.int64, len(found))[hit]
                if sum(map(len, dense.values())) > HELD_SLOTS:
                    yield from sent()
            groups.clear()

        def sent():
            for (lang, source), slots in dense.items():
                used = np.flatnonzero(slots)
                for i in range(0, len(used), 50_000):
                    part = used[i:i + 50_000]
                    shard, slot = lookups[lang].shard_and_slot(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(lang, pa.string()), len(part)), pa.repeat(pa.scalar(source, pa.string()), len(part)),
                         pa.array(shard), pa.array(slot), pa.array(slots[part])],
                        names=["lang", "source", "shard", "slot", "count"])
            dense.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang in lookups:
                    groups.setdefault((lang, source), Counter()).update(terms(text.as_py()))
            if sum(map(len, groups.values())) > HELD_TERMS:
                yield from counted_in()
        yield from counted_in()
        yield from sent()

    return rows.mapInArrow(run, "lang string, source string, shard long, slot long, count long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) by long division in three steps of 1000, within 64 bits for totals below 9 * 10^15."""
    div = lambda a, b: F.call_function("div", a, b)
    whole, rest = div(count, total), count % total
    for _ in range(3):
        whole, rest = whole * 1000 + div(rest * 1000, total), (rest * 1000) % total
    return whole + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def pair_values(groups: DataFrame, shard_sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    Slots are cut into runs and sources into tiles; a group compares two tiles over one run as dense
    arrays, so neither a language with all terms nor one with many sources is one task's work.
    """
    tiled = groups.withColumn("tiles", F.expr(f"cast((sources + {PAIR_SOURCES - 1}) div {PAIR_SOURCES} as int)")).withColumn(
        "tile", F.expr("cast(pmod(xxhash64(source), tiles) as int)"))
    # One copy of a source for every tile it meets; both orders of a pair come from one meeting.
    meeting = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "source", "tile", "n", "terms", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    runs = shard_sizes.withColumn("run", F.explode(F.expr(f"sequence(0L, (terms - 1) div {PAIR_SLOTS})"))).select(
        "lang", "shard", "run", F.least(F.lit(PAIR_SLOTS), F.col("terms") - F.col("run") * PAIR_SLOTS).cast("long").alias("slots"))
    # A language without kept terms has one run of no slots.
    marks = meeting.join(runs, "lang", "left").select(
        "lang", F.coalesce("shard", F.lit(-1)).alias("shard"), F.coalesce("run", F.lit(-1)).alias("run"), "low", "high",
        "source", "tile", F.lit(-1).cast("long").alias("slot"), F.col("n").alias("count"), "terms",
        F.coalesce("slots", F.lit(0)).alias("slots"))
    none = lambda name: F.lit(None).cast("long").alias(name)
    cells = counts.join(meeting, ["lang", "source"]).select(
        "lang", "shard", F.expr(f"slot div {PAIR_SLOTS}").alias("run"), "low", "high", "source", "tile",
        (F.col("slot") % PAIR_SLOTS).alias("slot"), "count", none("terms"), none("slots"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        is_mark = pdf["slot"].to_numpy() < 0
        mark = pdf[is_mark].sort_values("source")
        low, high = int(mark["low"].iloc[0]), int(mark["high"].iloc[0])
        names, tile = mark["source"].to_numpy(), mark["tile"].to_numpy()
        row = {s: i for i, s in enumerate(names)}
        cell = pdf[~is_mark]
        count = np.zeros((len(names), int(mark["slots"].iloc[0])), np.int64)
        count[cell["source"].map(row).to_numpy(np.int64), cell["slot"].to_numpy(np.int64)] = cell["count"]
        total = (mark["count"] + mark["terms"]).to_numpy(np.int64)
        p = shares(count + 1, np.maximum(total, 1)[:, None])
        source, item, value = [], [], []
        for i, name in enumerate(names):
            other = np.flatnonzero(tile == (low + high - tile[i])) if low != high else np.arange(len(names))
            other = other[other != i]
            apart = p[i][None, :] - p[other]
            source += [name] * len(other)
            item += list(names[other])
            value += ((apart * apart) // p[other]).sum(1).tolist()
        text = lambda found: np.array(found, object)
        return pd.DataFrame({"lang": text([mark["lang"].iloc[0]] * len(item)), "source": text(source), "item": text(item),
                             "value": np.array(value, np.int64)})

    parts = marks.unionByName(cells).groupBy("lang", "shard", "run", "low", "high").applyInPandas(
        compare, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(groups: DataFrame, hashed: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for the terms a group uses more than its language does."""
    term = hashed.filter("slot is not null").select("lang", "shard", "slot", "term")
    everywhere = W.partitionBy("lang", "shard", "slot")
    rows = counts.withColumn("all", F.sum("count").over(everywhere)).join(term, ["lang", "shard", "slot"]).join(
        groups.select("lang", "source", "n", "lang_n", "terms"), ["lang", "source"])
    p = share(F.col("count") + 1, F.col("n") + F.col("terms"))
    q = share(F.col("all") + 1, F.col("lang_n") + F.col("terms"))
    return rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").select(
        "lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """How each (lang, source) group departs from the other sources of its language and from the language itself.

    (lang, source, part, item, value, rank). Part ``pair``: every other source of the language, all
    ranks. Part ``term``: the terms of greatest value, up to rank ``top``. A term is kept in a language with
    ``least_docs`` documents that hold it. All arithmetic is on integers. Null text, lang and source count
    as empty; groups without terms take part; a language with one source has no pairs, one without kept
    terms only pairs of value 0; ties go by UTF-8; repeated rows are documents of their own; an empty table
    gives no row; other columns are not read. Terms above 256 bytes are verified by a 128-bit digest.
    """
    rows = named(docs)
    kept = written(document_frequencies(rows).filter(F.col("docs") >= least_docs).select("lang", "term"), "kept_terms")
    sizes = kept.groupBy("lang").agg(F.expr(f"(count(1) + {SHARD_TERMS - 1}) div {SHARD_TERMS}").alias("shards"))
    hashed = written(hashed_terms(kept, sizes), "hashed_terms")
    heads = hashed.filter("slot is null")
    counts = recount(rows, heads)
    if counts is None:
        counts = docs.sparkSession.createDataFrame([], "lang string, source string, shard long, slot long, count long")
    here = rows.select("lang", "source").distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    vocabulary = heads.groupBy("lang").agg(F.sum("terms").alias("terms"))
    groups = here.join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["n", "terms"])
    language = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("sources"))
    groups = written(groups.join(language, "lang"), "groups")
    ranked = lambda values: values.withColumn("rank", F.row_number().over(
        W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    out = lambda values, part: values.select(
        "lang", "source", F.lit(part).alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")
    pairs = ranked(pair_values(groups, heads.select("lang", "shard", "terms"), counts))
    leading = ranked(term_values(groups, hashed, counts)).filter(F.col("rank") <= top)
    return out(pairs, "pair").unionByName(out(leading, "term"))
