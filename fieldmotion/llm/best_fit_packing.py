"""Packing documents into training sequences: bounded-space online best-fit.

A fixed number of sequences is open at a time. A bitset has bit f set while an open
sequence has f free places, so the tightest fit is the lowest set bit at or above the
piece's length. Where nothing fits and all places are taken, the fullest sequence closes.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.llm.common import stored

#: Up to this code point both libraries' character classes are the same.
SAFE = 0x24F
#: Longer texts are looked through for runs of blanks, which the reader of ranks recurses on.
LONG, BLANKS = 4000, re.compile(r"\s{2000}")
_ENCODERS: dict[tuple, object] = {}


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary as the tokenizers library reads it, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(files: tuple[str, str | None]):
    """text -> ids that the tokenizers library gives for ``files[0]`` without adding special tokens.

    A special string inside a text has its own id, as that library reads it. Where
    ``files[1]`` holds the same vocabulary as ranks, texts of Latin letters go through the
    faster reader of ranks, which gives the same ids (tested). Texts with other letters, a
    special string or a long run of blanks go through the first.
    """
    if files in _ENCODERS:
        return _ENCODERS[files]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(files[0])
    encode = lambda t: whole.encode(t, add_special_tokens=False).ids
    if files[1]:
        import public_tokenizers
        import tiktoken

        with open(files[0], encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = encode

        def plain(t: str) -> bool:
            return (t.isascii() or max(map(ord, set(t))) <= SAFE) and not any(x in t for x in special) and (len(t) < LONG or not BLANKS.search(t))

        encode = lambda t: quick.encode_ordinary(t) if plain(t) else slow(t)
    _ENCODERS[files] = encode
    return encode


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than ``most``."""
    first = n % most or min(n, most)
    return [(0, first), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, files: tuple[str, str | None] | None = None, end: int = 2, most: int = 1024,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of documents (doc_id, text).

    A null or empty text is the end token alone. Every row of the input is cut on its
    own, repeated ones too; other columns are left behind.
    """
    files = files or tokenizer_files()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        for b in batches:
            if not b.num_rows:
                continue
            out: list[list] = [[] for _ in names]
            row_of: list[int] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*(encode(text) if text else ()), end], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), most)):
                    part = ids[start : start + n]
                    row_of.append(i)
                    for c, v in zip(out[1:], (k, start, n, zlib.crc32(part.tobytes()), *[part.tolist()] * keep_ids), strict=True):
                        c.append(v)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row_of, pa.int32())), *(pa.array(c, t) for c, t in zip(out[1:], types, strict=True))], names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class OpenSequences:
    """At most ``space`` open sequences of ``most`` places."""

    def __init__(self, most: int, space: int):
        self.most, self.space, self.free, self.bits, self.n_open, self.made = most, space, [[] for _ in range(most + 1)], 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        if length == self.most:  # it fills a sequence of its own
            self.made += 1
            return self.made - 1, 0
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.n_open == self.space:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.n_open -= 1
            free, sequence = self.most, self.made
            self.made += 1
            self.n_open += 1
        if free > length:
            self.free[free - length].append(sequence)
            self.bits |= 1 << (free - length)
        else:
            self.n_open -= 1  # it is full
        return sequence, self.most - free

    def _take(self, free: int) -> int:
        sequence = self.free[free].pop()
        if not self.free[free]:
            self.bits &= ~(1 << free)
        return sequence


def pack(parts: DataFrame, most: int = 1024, space: int = 128, group_pieces: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    Pieces are dealt by a hash to groups of about ``group_pieces``, whose number grows
    with the data, and each group is packed by itself in hash order: a rerun or a lost
    executor gives the same sequences. Full pieces are sequences of their own. The last
    ``space`` sequences of a group may stay open, at most 0.64 % of its pieces.
    """
    n = parts.count()
    groups = max(1, -(-n // group_pieces))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = parts.withColumns({"_h": key, "_g": F.pmod(F.hash(key, F.lit("group")), F.lit(groups))})
    names = [f.name for f in parts.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def run(key: tuple[pa.Scalar, ...], d: pa.Table) -> pa.Table:
        d = d.take(pc.sort_indices(d, [(c, "ascending") for c in ("_h", "doc_id", "piece", "length")]))
        bins = OpenSequences(most, space)
        spots = [bins.place(x) for x in d.column("length").to_pylist()]
        base = key[0].as_py() << 32
        return d.select(names).append_column("sequence_id", pa.array([base + s for s, _ in spots], pa.int64())).append_column("offset", pa.array([o for _, o in spots], pa.int64()))

    return dealt.groupBy("_g").applyInArrow(run, schema)


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs)


def packed(docs: DataFrame) -> DataFrame:
    return pack(stored(pieces(docs), "pieces"))
