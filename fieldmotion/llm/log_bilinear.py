"""Log-probabilities of texts under a log-bilinear neural language model.

Every token has a class: each of the most frequent words is one, all other words share
classes by their last letters, and the end of a text is one. The model predicts a class
from the classes before it: context vectors, each weighted by its place, are summed and
multiplied with all class vectors at once; a softmax makes that a distribution. A word
within its class has its smoothed relative frequency, so whole texts have normalised
probabilities over all known words and, per class, one unknown word.

Training is noise-contrastive estimation in numpy on every task's own texts; the tasks'
parameters, of fixed size, are averaged by a shuffle and trained on in a second round.
Every training token is a target once, in one of the rounds.
Word counts are exact and cover all training texts; only the most frequent words, a
fixed number, are sent to every task, all other words meet their counts in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.llm.common import id_crc, stored
from fieldmotion.llm.shingles import mixed, word_tails

#: Words with a class of their own, classes of all others, numbers a vector, tokens of context.
OWN, KINDS, DIM, CONTEXT = 150, 104, 24, 4
END, CLASSES = OWN + KINDS, OWN + KINDS + 1
#: Most frequent words whose counts every task gets (16 bytes each).
COMMON = 1 << 16
#: Noise classes of a batch, rounds of averaging, targets of a batch.
NOISE, ROUNDS, BATCH = 64, 2, 1024
#: Contexts scored at once; where products of powers of e sum to less than FAINT, logits are added instead.
SCORED, FAINT = 512, 1e-25
SLICE_BYTES = 1_000_000
END_HASH = 1  # stands for the end token among word hashes


@dataclass(frozen=True)
class Vocabulary:
    """``common``: hashes of frequent words, ascending, with counts and classes; per class
    the training tokens and distinct words; N and V of all training tokens."""

    common: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n: int
    v: int

    def look_up(self, words: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count, whether the count is known here) of every word."""
        if not len(self.common):
            return OWN + kinds, np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        hit = self.common[at] == words
        return np.where(hit, self.classes[at], OWN + kinds), np.where(hit, self.counts[at], 0), hit


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    part, size, start = [], 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def word_counts(train: DataFrame) -> DataFrame:
    """(word, kind, c) over all training texts; words are 64-bit hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _slices(b.column(0).to_pylist()):
                words, kinds, _ = word_tails(part, KINDS)
                w, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(kinds[first].astype(np.int32)), pa.array(n)], names=["word", "kind", "c"])

    return train.select("text").mapInArrow(run, "word long, kind int, c long").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int = COMMON) -> DataFrame:
    """At most ``most`` words (word, kind, c): all those counted at least so often that no
    more can be had. The bound is read off a histogram of counts in steps of an eighth of
    an octave, so what reaches the driver does not grow with the tasks."""
    step = F.floor(8 * F.log2("c")).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # one row an eighth octave
    least, taken = None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if taken + r["n"] > most:
            break
        least, taken = r["step"], taken + r["n"]
    return counts.where(step >= least if least is not None else F.lit(False))


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """The driver gets at most COMMON words and one row a kind, however large the corpus is."""
    top = common_words(counts).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, kinds, c = top["word"].to_numpy(np.int64).view(np.uint64), top["kind"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    classes = np.where(np.arange(len(top)) < OWN, np.arange(len(top)), OWN + kinds)
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[OWN + r["kind"]], distinct[OWN + r["kind"]] = r["c"], r["v"]
    for k, x in zip(kinds[:OWN], c[:OWN], strict=True):
        tokens[OWN + k] -= x
        distinct[OWN + k] -= 1
    own = min(OWN, len(top))
    tokens[:own], distinct[:own] = c[:own], 1
    tokens[END], distinct[END] = n_docs, int(n_docs > 0)
    order = np.argsort(words)
    return Vocabulary(words[order], c[order], classes[order], tokens, distinct, int(tokens.sum()), int(distinct.sum()))


def start_parameters(vocab: Vocabulary) -> np.ndarray:
    """Context vectors, class vectors, place weights and biases in one row of numbers."""
    r = np.random.Generator(np.random.Philox(key=3))
    share = (vocab.class_tokens + 0.5) / (vocab.n + 0.5 * CLASSES)
    return np.concatenate([r.normal(0, 0.1, CLASSES * DIM), r.normal(0, 0.1, CLASSES * DIM), np.full(CONTEXT * DIM, 1 / CONTEXT), np.log(share)]).astype(np.float32)


def _parts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b = CLASSES * DIM, 2 * CLASSES * DIM
    return p[:a].reshape(CLASSES, DIM), p[a:b].reshape(CLASSES, DIM), p[b : b + CONTEXT * DIM].reshape(CONTEXT, DIM), p[b + CONTEXT * DIM :]


def contexts(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each token of each text, nearest first; END before its start."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(classes))
    return np.stack([np.where(at - k >= starts, classes[np.maximum(at - k, 0)], END) for k in range(1, CONTEXT + 1)], axis=1)


def encode(part: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """(words, classes, counts, known here, lengths) with an end token after each text."""
    words, kinds, n = word_tails(part, KINDS)
    classes, counts, hit = vocab.look_up(words, kinds)
    ends = np.cumsum(n)
    put = lambda x, v: np.insert(x, ends, v)
    return put(words, np.uint64(END_HASH)), put(classes, END), put(counts, vocab.class_tokens[END]), put(hit, True), n + 1


def targets(words: np.ndarray, lengths: np.ndarray, turn: int) -> np.ndarray:
    """Places of the tokens that are targets in a round. The rounds share all tokens out
    by a hash of word, place in the text and length of the text, however texts are sliced."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    salt = (place + (np.repeat(lengths, lengths) << 32)).astype(np.uint64)
    return np.flatnonzero(mixed(words + mixed(salt)) % np.uint64(ROUNDS) == turn)


#: Places of the vectors in a flat array, two numbers at a time, by number of the vector.
_PAIRS = np.arange(CONTEXT * CLASSES * (DIM // 2)).reshape(-1, DIM // 2)


def _row_sums(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Per number below ``size``, the sum of the vectors with that number. Two numbers of a
    vector are added at once, as the parts of a complex one."""
    out = np.zeros(size * DIM // 2, np.complex64)
    np.add.at(out, _PAIRS.take(rows, axis=0).ravel(), values.view(np.complex64).ravel())
    return out.view(np.float32).reshape(size, DIM)


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place, x held within 30 of 0."""
    np.clip(np.negative(x, out=x), -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _weighted(q: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The context vectors as every place weights them, by place and class."""
    return (q * place[:, None]).reshape(CONTEXT * CLASSES, DIM)


def _numbers(ctx: np.ndarray) -> np.ndarray:
    """Each place and class of the contexts as one number, a row a place."""
    return np.ascontiguousarray(ctx.T) + CLASSES * np.arange(CONTEXT)[:, None]


def train_on(p: np.ndarray, past: np.ndarray, ctx: np.ndarray, target: np.ndarray, noise: np.ndarray, seed: int, rate: float = 0.05) -> None:
    """One pass of noise-contrastive estimation with AdaGrad; ``p`` and the squared
    gradients ``past`` change in place."""
    q, r, place, bias = _parts(p)
    rng = np.random.Generator(np.random.Philox(key=seed))
    edges, log_noise = np.cumsum(noise), np.log(noise * NOISE).astype(np.float32)
    order = rng.permutation(len(target))
    numbers, target = _numbers(ctx).take(order, axis=1), target.take(order)
    for s in range(0, len(order), BATCH):
        c, t = numbers[:, s : s + BATCH], target[s : s + BATCH]
        # the noise classes are drawn once a batch and shared by its tokens
        drawn = np.minimum(np.searchsorted(edges, rng.random(NOISE) * edges[-1]), CLASSES - 1)
        weighted, rt, rd = _weighted(q, place), r.take(t, axis=0), r.take(drawn, axis=0)
        hidden = weighted.take(c[0], axis=0)
        for k in range(1, CONTEXT):
            hidden += weighted.take(c[k], axis=0)
        g_true = _logistic(np.einsum("bd,bd->b", hidden, rt) + (bias - log_noise).take(t)) - 1
        g_noise = hidden @ rd.T
        g_noise += (bias - log_noise).take(drawn)
        _logistic(g_noise)
        d_hidden = g_noise @ rd
        rt *= g_true[:, None]
        d_hidden += rt
        met = np.concatenate([t, drawn])
        d_bias = np.bincount(met, np.concatenate([g_true, g_noise.sum(axis=0)]), minlength=CLASSES)
        d_r = _row_sums(met, np.concatenate([g_true[:, None] * hidden, g_noise.T @ hidden]), CLASSES)
        # sums by place and class serve the vectors as well as the weights
        by_place = _row_sums(c.ravel(), np.tile(d_hidden, (CONTEXT, 1)), CONTEXT * CLASSES).reshape(CONTEXT, CLASSES, DIM)
        d_q, d_place = np.einsum("kcd,kd->cd", by_place, place), np.einsum("kcd,cd->kd", by_place, q)
        grad = np.concatenate([d_q.ravel(), d_r.ravel(), d_place.ravel(), d_bias]).astype(np.float32) / len(t)
        past += grad * grad
        p -= rate * grad / np.sqrt(past)


def trained(train: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Parameters after ROUNDS of local training on every task's texts and averaging,
    weighted by tokens. Targets are shared out by a hash, so a task that is run again
    learns the same."""
    p = start_parameters(vocab)
    noise = (vocab.class_tokens + 0.5) / (vocab.n + 0.5 * CLASSES)
    for turn in range(ROUNDS):
        begin = p

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, past, seen = begin.copy(), np.full_like(begin, 1e-6), 0
            for b in batches:
                for _, part in _slices(b.column(0).to_pylist()):
                    words, classes, _, _, n = encode(part, vocab)
                    picked = targets(words, n, turn)
                    if len(picked):
                        train_on(own, past, contexts(classes, n)[picked], classes[picked], noise, seen * ROUNDS + turn)
                        seen += len(words)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.astype(np.float64).tolist()], pa.list_(pa.float64()))], names=["n", "p"])

        each = stored(train.select("text").mapInArrow(run, "n long, p array<double>"), "lbl-round")
        mean = each.select("n", F.posexplode("p")).groupBy("pos").agg((F.sum(F.col("col") * F.col("n")) / F.sum("n")).alias("v")).toPandas()
        if len(mean):
            p = mean.sort_values("pos")["v"].to_numpy(np.float32)
    return p


def class_log10(p: np.ndarray, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 P(class | context). A logit is a sum over the places of the context,
    so its power of e is a product: powers are taken once for every place and class, each
    row of them against its greatest, and contexts only multiply them."""
    q, r, place, bias = _parts(p)
    logits = _weighted(q, place) @ r.T
    logits[:CLASSES] += bias
    top = logits.max(axis=1)
    powers, one = np.exp(logits - top[:, None]), np.ones(CLASSES, np.float32)
    numbers, total = _numbers(ctx), np.zeros(len(target), np.float32)
    for s in range(0, len(target), SCORED):
        product = powers.take(numbers[0, s : s + SCORED], axis=0)
        for k in range(1, CONTEXT):
            product *= powers.take(numbers[k, s : s + SCORED], axis=0)
        total[s : s + SCORED] = product @ one
    faint = np.flatnonzero(~(total > FAINT))
    total[faint] = 1
    out = -np.log(total.astype(np.float64))
    for n in numbers:
        out += logits.ravel().take(n * CLASSES + target).astype(np.float64) - top.take(n)
    # places that favour far different classes: nearly all products vanish
    for s in range(0, len(faint), SCORED):
        at = faint[s : s + SCORED]
        whole = logits.take(numbers[:, at], axis=0).sum(axis=0, dtype=np.float64)
        whole -= whole.max(axis=1, keepdims=True)
        out[at] = whole[np.arange(len(at)), target[at]] - np.log(np.exp(whole).sum(axis=1))
    return out / np.log(10)


def scores(docs: DataFrame, vocab: Vocabulary, counts: DataFrame, p: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per
    row of docs (doc_id, held_out, text).

    A null or empty text is its end token. Rows that repeat are scored on their own; rows
    meet the counts of their rare words by a row number, not by doc_id, which may repeat
    or be null. An empty table gives no rows; without training tokens c is 0 for all.
    """
    base_of = np.log10(vocab.n + 0.5 * (vocab.v + 1))
    in_class = np.log10(vocab.class_tokens + 0.5 * (vocab.class_words + 1))
    single = np.arange(CLASSES) < OWN
    single[END] = True
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["task", "nth", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "word", "kind", "tf"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            for start, part in _slices(b.column(2).to_pylist()):
                words, classes, c, hit, n = encode(part, vocab)
                owner = np.repeat(np.arange(len(part)), n)
                base = np.where(hit, np.log10(c + 0.5) - base_of, 0.0)
                model = class_log10(p, contexts(classes, n), classes) + np.where(hit & ~single[classes], np.log10(c + 0.5) - in_class[classes], 0.0)
                add = lambda x: np.bincount(owner, x, minlength=len(part))  # noqa: B023, E731
                rare = np.flatnonzero(~hit)
                pair, first, tf = _pairs(owner[rare], words[rare])
                m, k = len(part), len(first)
                kinds = (classes[rare][first] - OWN).astype(np.int32)
                ids, held = b.column(0).slice(start, m), b.column(1).slice(start, m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m + k, task, np.int32)), pa.array(np.concatenate([np.arange(m), pair]) + nth),
                    pa.concat_arrays([ids, pa.nulls(k, ids.type)]), pa.concat_arrays([held, pa.nulls(k, pa.bool_())]),
                    pa.concat_arrays([pa.array(n.astype(np.int64)), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([add(hit & (c > 0)), np.zeros(k)]).astype(np.int64)),
                    pa.array(np.concatenate([add(base), np.zeros(k)])), pa.array(np.concatenate([add(model), np.zeros(k)])),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(words[rare][first].view(np.int64))]),
                    pa.array(np.concatenate([np.zeros(m, np.int32), kinds])), pa.array(np.concatenate([np.zeros(m, np.int64), tf]))], names=names)
                nth += m

    schema = f"task int, nth long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, model double, word long, kind int, tf long"
    rows = stored(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema), "lbl-scores")
    inside = F.create_map(*[x for k in range(KINDS) for x in (F.lit(k), F.lit(float(in_class[OWN + k])))])
    c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    rare = rows.where("word is not null").select("task", "nth", "word", "kind", "tf").join(counts.select("word", "c"), "word", "left").groupBy("task", "nth").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("tf") * (c - F.lit(float(base_of)))).alias("rare_base"),
        F.sum(F.col("tf") * (c - inside[F.col("kind")])).alias("rare_model"))
    whole = rows.where("word is null")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.join(rare, ["task", "nth"], "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "rare_known").alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"), plus("model", "rare_model").alias("score"))


def _pairs(owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first place, times) of each distinct (owner, word); owners ascend."""
    order = np.lexsort((words, owner))
    o, w = owner[order], words[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return o[at], order[at], np.diff(np.append(at, len(o)))


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(id_crc() % 5 == 1, F.lit(False)))
    train = docs.where("not held_out")
    counts = stored(word_counts(train), "word-counts")
    vocab = vocabulary(counts, train.count())
    return scores(docs, vocab, counts, trained(train, vocab))
