"""Packed id matrices: fixed-width rows of token ids with segment lengths and position resets."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import written
from fairlead.llm.packing import place
from fairlead.llm.tokens import load, token_pieces


def token_matrix(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per packed sequence, ready to be written as binary columns.

    sequence_id; n_tokens; input_ids: exactly ``capacity`` ids, little-endian in two bytes each if
    the vocabulary allows (else four), filled up with the end id; cu_seqlens: 0 and the running
    ends of the segments; position_ids: as many numbers in the same form, restarting from 0 at
    each segment and in the filling; segments: (doc_id, piece, start, length) in order. Joining a
    document's pieces by ``piece`` gives back all its ids. Null texts count as empty (one end id);
    null ids, ties and repeated rows keep their own segments; an empty table gives no row.

    Pieces that fill a sequence by themselves are rows already; only the others are moved.
    """
    width = 2 if load(tokenizer)[2].get_vocab_size() <= 65536 and end_id < 65536 and capacity <= 65536 else 4
    form = "<H" if width == 2 else "<I"
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, keep_ids=True), "id-pieces")
    if width == 4 and load(tokenizer)[2].get_vocab_size() <= 65536:
        raise ValueError("a capacity over 65536 needs ids of four bytes")
    whole = pieces.filter(F.col("length") == capacity)
    counting = F.lit(bytearray(b"".join(struct.pack(form, i) for i in range(capacity))))
    filling = F.lit(bytearray(struct.pack(form, end_id) * capacity))
    segment = F.struct("doc_id", "piece", "start", "length")
    alone = whole.select(
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(capacity).cast("long").alias("n_tokens"),
        F.col("ids").alias("input_ids"), F.array(F.lit(0).cast("long"), F.col("length")).alias("cu_seqlens"),
        counting.alias("position_ids"), F.array(segment).alias("segments"))
    parts = place(pieces.filter(F.col("length") < capacity), capacity)
    rows = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(
        F.struct("offset", "length", "doc_id", "piece", "start", "ids"))).alias("s"), F.sum("length").alias("n_tokens"))
    room = F.lit(capacity) - F.col("n_tokens")
    joined = lambda start, value: F.aggregate("s", start, lambda whole, x: F.concat(whole, value(x)))
    cut = lambda binary, n: F.substring(binary, F.lit(1), (n * width).cast("int"))
    nothing = F.lit(bytearray())
    shared = rows.select(
        "sequence_id", "n_tokens",
        F.concat(joined(nothing, lambda x: x["ids"]), cut(filling, room)).alias("input_ids"),
        F.concat(F.array(F.lit(0).cast("long")),
                 F.transform("s", lambda x: x["offset"] + x["length"])).alias("cu_seqlens"),
        F.concat(joined(nothing, lambda x: cut(counting, x["length"])), cut(counting, room)).alias("position_ids"),
        F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"),
                                            x["start"].alias("start"), x["length"].alias("length"))).alias("segments"))
    return alone.unionByName(shared)


def write_token_matrix(docs: DataFrame, path: str, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> None:
    """Write the packed matrices as Parquet with binary columns; every task writes its own sequences."""
    token_matrix(docs, tokenizer, capacity, end_id).write.parquet(path)
