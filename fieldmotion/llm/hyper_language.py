"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its place. A text's vector bundles (adds) the
vectors of all its n-grams; a language's prototype bundles those of its training texts.
A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.llm.common import id_crc

DIM, GRAM = 1024, 3
#: Letters are turned into vectors in batches of about so many characters, n-grams in blocks.
BATCH_CHARS, GRAM_BLOCK = 500_000, 8192


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(20_000)
def letter_vector(code: int, dim: int) -> np.ndarray:
    """The fixed random vector of a code point; 0 stands for any break between words."""
    return np.random.Generator(np.random.Philox(key=7_919 + code)).integers(0, 2, dim).astype(np.int8) * 2 - 1


def _codes(text: str | None) -> np.ndarray:
    """Lower-case letters with one 0 at each end and between runs; empty without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[c], c, 0).astype(np.int64)
    if not c.any():
        return c[:0]
    c = np.concatenate([[0], c, [0]])
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def gram_counts(texts: list[str | None], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams as rows of code points, text of each occurrence, gram of each occurrence)."""
    each = [_codes(t) for t in texts]
    owner = np.repeat(np.arange(len(each)), [len(c) for c in each])
    codes = np.concatenate(each) if len(owner) else np.zeros(0, np.int64)
    whole = np.flatnonzero(owner[gram - 1 :] == owner[: max(0, len(owner) - gram + 1)])  # starts that do not run into the next text
    if not len(whole):
        return np.zeros((0, gram), np.int64), whole, whole
    alphabet = np.flatnonzero(np.bincount(codes))
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    dense, n = place[codes], len(alphabet)
    if float(n) ** gram < 4e6:
        code = np.zeros(len(whole), np.int64)
        for k in range(gram):
            code = code * n + dense[whole + k]
        seen = np.flatnonzero(np.bincount(code, minlength=n**gram))
        at = np.zeros(n**gram, np.int64)
        at[seen] = np.arange(len(seen))
        parts, rest = [], seen
        for _ in range(gram):
            parts.append(rest % n)
            rest = rest // n
        return alphabet[np.stack(parts[::-1], axis=1)], owner[whole], at[code]
    grams, gram_of = np.unique(np.stack([dense[whole + k] for k in range(gram)], axis=1), axis=0, return_inverse=True)
    return alphabet[grams], owner[whole], gram_of.reshape(-1)


def gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    codes, dense = np.unique(grams, return_inverse=True)
    dense = dense.reshape(grams.shape)
    base = np.stack([letter_vector(int(c), dim) for c in codes]) if len(codes) else np.zeros((0, dim), np.int8)
    out = np.ones((len(grams), dim), np.int8)
    for k in range(grams.shape[1]):
        out *= np.roll(base, grams.shape[1] - 1 - k, axis=1)[dense[:, k]]
    return out.astype(np.float32)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS or i - start >= 255:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sums(grams: np.ndarray, owner: np.ndarray, gram_of: np.ndarray, n: int, dim: int) -> np.ndarray:
    """(n, dim) sums of the n-grams' vectors by owner, GRAM_BLOCK n-grams at a time."""
    out = np.zeros((n, dim), np.float64)
    for s in range(0, len(grams), GRAM_BLOCK):
        part = grams[s : s + GRAM_BLOCK]
        here = slice(None) if len(part) == len(grams) else (gram_of >= s) & (gram_of < s + len(part))
        counts = np.bincount(owner[here] * len(part) + (gram_of[here] - s), minlength=n * len(part)).reshape(n, len(part))
        out += counts.astype(np.float32) @ gram_vectors(part, dim)
    return out


def bundle(texts: list[str | None], dim: int) -> np.ndarray:
    """One vector per text; all zero where a text has no letter."""
    grams, owner, gram_of = gram_counts(texts)
    return _sums(grams, owner, gram_of, len(texts), dim)


def bundle_by(texts: list[str], labels: list[str], dim: int) -> dict[str, np.ndarray]:
    """One vector per label: n-grams are counted over all its texts before one product."""
    names, label_of = np.unique(labels, return_inverse=True)
    grams, owner, gram_of = gram_counts(texts)
    return dict(zip(names.tolist(), _sums(grams, label_of[owner], gram_of, len(names), dim), strict=True))


def learn(docs: DataFrame, dim: int = DIM, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of all languages from every row with a text and a language.

    Each task adds up its own rows; a shuffle adds the tasks' sums by (language, place),
    so one language with most of the rows costs no more than another. The driver gets
    ``dim`` numbers per language. Sums are whole numbers: any order gives the same bits.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b["text"].tolist(), b["lang"].tolist()
            for i, j in _chunks(texts):
                for k, v in bundle_by(texts[i:j], langs[i:j], dim).items():
                    total[k] = total[k] + v if k in total else v
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": [v.tolist() for v in total.values()]})

    got = (rows.mapInPandas(sums, "lang string, vector array<double>").select("lang", F.posexplode("vector"))
           .groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect())
    out: dict[str, np.ndarray] = {}
    for r in got:
        out.setdefault(r["lang"], np.zeros(dim))[r["pos"]] = r["v"]
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row with the ``keep`` columns, lang_pred, score) for every input row.

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing was
    learnt. Equal cosines go to the first language in order. Whole texts of any length
    count. Repeated rows each get their row. Only ``text`` is read for the decision.
    """
    dim = len(next(iter(prototypes.values()))) if prototypes else DIM
    names = list(prototypes)
    table = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, dim))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for i, j in _chunks(texts):
                v = bundle(texts[i:j], dim)
                norm = np.linalg.norm(v, axis=1)
                if names and norm.any():
                    cos = (v @ table.T) / np.where(norm > 0, norm, 1)[:, None]
                    best = cos.argmax(axis=1)
                    for k in np.flatnonzero(norm > 0):
                        lang[i + k], score[i + k] = names[best[k]], min(1.0, max(0.0, float(cos[k, best[k]])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*b.schema.names[:-1], "lang_pred", "score"])

    kept = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))
    types = [f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    return kept.mapInArrow(predict, ", ".join([*types, "lang_pred string, score double"])).toDF(*keep, "lang_pred", "score")


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    prototypes = learn(docs.where((id_crc() % 4 != 2)))
    return identify(docs, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")
