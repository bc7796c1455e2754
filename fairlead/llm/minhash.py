"""One-permutation minimum hashing with optimal densification, in built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.llm.common import text_key

BINS, BIN_BITS, LOW_BITS, WORDS, PROBES = 256, 8, 4, 5, 8
REST = 63 - BIN_BITS
BLANK = r"[\x20\x09-\x0D]+"
# Rows of neighbouring ids that one window partition holds, about.
RANGE_ROWS = 4_000
COARSE = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """63-bit hashes of all runs of ``words`` words; fewer words count as one run, none as no run."""
    each = F.transform(F.filter(F.split(text, BLANK), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        several = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(0))),
                              lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
        return F.when(F.size(h) >= words, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(
            F.array().cast("array<long>"))

    return F.transform(let(each, runs), lambda x: x.bitwiseAND(F.lit((1 << 63) - 1)))


def signature(text: Column, words: int = WORDS) -> Column:
    """``BINS`` numbers of ``LOW_BITS`` bits, or an empty array for a text without words.

    Each shingle is hashed once: the high bits choose its bin, the rest compete for the bin's
    minimum. Sorting the hashes together with an upper bound per bin leaves each bin's minimum
    first among its own. An empty bin takes the value of a full one found by its own sequence of
    probes; where the first probes all meet empty bins, it takes the full bin that comes first in
    an order hashed from both bin numbers. So every full bin is equally likely, independently for
    each empty bin, and two texts that fill the same bins choose alike.
    """
    bound = F.lit([(b << REST) + (1 << REST) - 1 for b in range(BINS)])
    top = F.lit((1 << REST) - 1)
    bin_of = lambda x: F.shiftright(x, REST)
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    low = lambda m: F.transform(m, lambda x: F.when(
        x.bitwiseAND(top) != top, x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("byte")))

    def densify(v: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(v, j).isNotNull())
        probe = lambda i, a: F.get(v, F.pmod(F.xxhash64(F.lit(a), i), F.lit(BINS)).cast("int"))
        return let(full, lambda f: F.transform(v, lambda x, i: F.coalesce(
            x, *[probe(i, a) for a in range(PROBES)],
            F.get(v, F.array_min(F.transform(f, lambda j: F.struct(F.xxhash64(i, j), j.alias("j")))).getField("j")))))

    dense = lambda h: let(let(let(F.sort_array(F.concat(h, bound)), first), low), densify)
    return let(shingle_hashes(text, words), lambda h: F.when(F.size(h) > 0, dense(h)).otherwise(
        F.array().cast("array<byte>")))


def packed(sig: Column) -> Column:
    """A signature as a string of hexadecimal digits, one per bin."""
    digits = F.lit([f"{d:x}" for d in range(16)])
    return F.array_join(F.transform(sig, lambda v: F.get(digits, v.cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1.

    Unequal values still agree in their low bits by chance, once in 2^LOW_BITS; that share is
    taken out. Two texts without words are alike (1), one of them and any other text are not (0).
    """
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    chance = 1.0 / (1 << LOW_BITS)
    share = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), share))


def id_ranges(docs: DataFrame) -> tuple[Column, Column]:
    """Columns (coarse, fine) whose order is that of doc_id and whose pairs hold about RANGE_ROWS rows.

    Up to 1024 quantiles of the ids are the coarse bounds, the only thing collected; ranges
    between them are cut evenly, so the number of pairs grows with the rows.
    """
    cuts = COARSE * COARSE
    shares = ", ".join(f"{(i + 1) / cuts!r}D" for i in range(cuts - 1))
    known = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"),
                     F.expr(f"percentile_approx(doc_id, array({shares}), 20000)")).head()
    rows, low, high, bounds = known[0], known[1], known[2], list(known[3] or [])
    if low is None:
        return F.lit(0), F.lit(0).cast("long")
    bounds = [low, *bounds]
    ends = [*bounds[1:], high + 1]
    fine = max(1, -(-rows // (RANGE_ROWS * cuts)))
    if rows < RANGE_ROWS * cuts:  # few rows: neighbouring coarse ranges are joined
        step = max(1, cuts * RANGE_ROWS // max(rows, 1))
        bounds, ends = bounds[::step], [*bounds[step::step], high + 1]
    wide = -(-len(bounds) // COARSE)
    groups = [bounds[i:i + wide] for i in range(0, len(bounds), wide)]
    doc = F.col("doc_id")
    upto = lambda array: F.size(F.filter(array, lambda b: b <= doc)) - 1
    padded = [[*g, *[(1 << 63) - 1] * (wide - len(g))] for g in groups]

    def place(group: Column) -> Column:
        return group * wide + upto(F.get(F.lit(padded), group))

    coarse = F.when(doc.isNull(), F.lit(-1)).otherwise(let(upto(F.lit([g[0] for g in groups])), place))
    width = [max(1, -(-(b - a) // fine)) for a, b in zip(bounds, ends)]
    inner = F.when(doc.isNull(), F.lit(0).cast("long")).otherwise(let(
        coarse, lambda c: F.floor((doc - F.get(F.lit(bounds), c)) / F.get(F.lit(width), c)).cast("long")))
    return coarse, inner


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Add next_<column> of the row that follows in (doc_id, key) order; the first follows the last.

    Rows move once, to windows over ranges of ids; each range's last row gets the first row of the
    next range through a join on the ranges. ``rows`` has coarse and fine range columns.
    """
    by = W.partitionBy("coarse", "fine").orderBy("doc_id", "key")
    placed = rows.withColumn("nth", F.row_number().over(by)).withColumn(
        "following", F.lead(F.struct(*carried)).over(by))
    firsts = placed.filter("nth = 1").select("coarse", "fine", F.struct(*carried).alias("first"))
    heads = firsts.select("coarse", "fine")
    within = heads.withColumn("to_fine", F.lead("fine").over(W.partitionBy("coarse").orderBy("fine")))
    starts = heads.groupBy("coarse").agg(F.min("fine").alias("to_fine"))  # 1025 rows at most
    ring = W.orderBy("coarse")
    starts = starts.select(
        "coarse", F.coalesce(F.lead("coarse").over(ring), F.first("coarse").over(ring)).alias("next_coarse"),
        F.coalesce(F.lead("to_fine").over(ring), F.first("to_fine").over(ring)).alias("next_fine"))
    hop = within.join(starts, "coarse").select(
        "coarse", "fine", F.when(F.col("to_fine").isNull(), F.col("next_coarse")).otherwise(F.col("coarse")).alias("tc"),
        F.coalesce("to_fine", "next_fine").alias("tf"))
    target = firsts.select(F.col("coarse").alias("tc"), F.col("fine").alias("tf"), "first")
    edges = hop.join(target, ["tc", "tf"]).select("coarse", "fine", "first")
    joined = placed.join(edges, ["coarse", "fine"]).withColumn("after", F.coalesce("following", "first"))
    return joined.select(*rows.columns, *[F.col(f"after.{c}").alias(f"next_{c}") for c in carried])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the
    next document's in ascending (doc_id, text key) order; after the last comes the first. One row per
    input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty; a text without words has an empty fingerprint. Null ids come first in the
    order; equal ids are ordered by text; repeated rows stay; an empty table gives no row.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coarse, fine = id_ranges(base)
    rows = base.select("doc_id", "text", text_key().alias("key"), signature(F.col("text")).alias("sig"),
                       coarse.alias("coarse"), fine.alias("fine"))
    n, text, after = F.char_length("text"), F.col("text"), F.col("next_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), n - half), F.substr(after, F.lit(1), half))
    wide = with_next(rows, ["text", "sig"]).withColumn("edited", edited)
    out = wide.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      "sig", "next_sig", F.when(F.col("edited") == text, F.col("sig")).otherwise(
                          signature(F.col("edited"))).alias("edited_sig"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
