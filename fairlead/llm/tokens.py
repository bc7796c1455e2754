"""Token ids of texts, cut into pieces of bounded length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A run without a break of this many characters goes to the slower library: the fast one's
# pattern engine may give up on it.
LONG_RUN = 100_000

_loaded: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """The byte each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple:
    """(fast encoder, its special tokens, plain encoder) of a byte-level vocabulary file, once per process.

    The fast encoder merges by the file's own ids and is used only if the file's merges come in
    the order of their ids; otherwise it is None and the plain encoder does the work.
    """
    if path not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        fast, byte_of, pre = None, _byte_of(), spec.get("pre_tokenizer") or {}
        vocabulary = {k: v for k, v in spec["model"].get("vocab", {}).items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", ())]
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        if (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
                and all(c in byte_of for k in vocabulary for c in k) and made == sorted(set(made))):
            ranks = {bytes(byte_of[c] for c in k): v for k, v in vocabulary.items()}
            fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        _loaded[path] = fast, set(special), plain
    return _loaded[path]


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of a whole text, without tokens of the library's own."""
    fast, special, plain = load(path)
    if fast is not None and (len(text) < LONG_RUN or max(map(len, text.split(" "))) < LONG_RUN):
        try:
            return fast.encode_to_numpy(text, allowed_special=special, disallowed_special=())
        except BaseException as error:  # a panic of the pattern engine is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
    return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all are ``width`` long but the first, which may be shorter."""
    first = n if n <= width else n % width or width
    return [(0, first)] + [(at, width) for at in range(first, n, width)]


def token_pieces(docs: DataFrame, path: str, width: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Every document's ids and its end id, cut into pieces of at most ``width``.

    Columns: doc_id, piece (from 0), start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers) and, on request, ids: the numbers themselves, little-endian, in two
    bytes each if the vocabulary allows, else four. A null text counts as empty and gives the
    end id alone; a null doc_id stays null; repeated rows stay repeated. Other columns are left out.
    """
    wide = "<u2" if load(path)[2].get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or "", path), np.uint32(end_id)).astype("<u4", copy=False)
                for piece, (start, length) in enumerate(cuts(len(ids), width)):
                    part = ids[start:start + length]
                    row = (doc, piece, start, length, zlib.crc32(part.tobytes()),
                           part.astype(wide).tobytes() if keep_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[:5 + keep_ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)
