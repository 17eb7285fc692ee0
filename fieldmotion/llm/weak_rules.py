"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good or bad or abstains. Expectation-maximisation over the vote patterns
(at most 3 ** rules of them, whatever the corpus) estimates how often each rule is right
and how common good documents are; a document is kept by its posterior, not by having to
pass every rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmotion.llm.common import let, rowed, stored, words

SYMBOLS = "#*$%&|<>"
ENDS = list(".!?…。！？")


def repeated_words(w: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in one text.

    Windows are hashed; only a text whose hashes are not all different goes on to sort
    (hash, place) pairs, pick places with an equal neighbour and add up what they cover.
    Sorting keeps it at n log n for texts of any length.
    """
    windows = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, 5)]))
    hashes = F.when(F.size(w) >= 5, F.slice(windows, 1, F.size(w) - 4))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(pairs, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True)))
        places = F.sort_array(F.transform(places, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def measures(docs: DataFrame, text: Column) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the
    rules read beside them). A null text measures like an empty one."""
    d = rowed(docs, _t=F.coalesce(text, F.lit("")))
    with_word = lambda x: F.rtrim(x).rlike("[^\x20\x09-\x0D]")
    of_words = let(words(F.col("_t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    of_lines = let(F.filter(F.split("_t", "\n"), with_word), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.substring(F.rtrim(y), -1, 1).isin(*ENDS))).cast("long").alias("n_closed_lines")))
    left = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")).cast("long")
    return d.select("row", of_words.alias("_of_words"), of_lines.alias("_of_lines"), left(f"[^{SYMBOLS}]+").alias("n_symbols"),
                    (F.length("_t") - left(r"\p{L}+")).cast("long").alias("n_letters"),
                    (F.size(F.split("_t", "!!")) - 1).cast("long").alias("n_shouts")).select(
        "row", "_of_words.*", "_of_lines.*", "n_symbols", "n_letters", "n_shouts")


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)).cast("int")


#: name: (votes good, votes bad); neither: it abstains. Integers only, so every engine
#: agrees. Rules that look for one kind of damage never vote good.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 30", "n_words < 10"),
    "letters": ("false", "n_words >= 30 and 100 * n_letters < 88 * word_chars"),
    "closed_lines": ("2 * n_closed_lines >= n_lines", "10 * n_closed_lines < 3 * n_lines"),
    "word_length": ("false", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "symbols": ("false", "100 * n_symbols > 15 * n_words"),
    "duplicate_lines": ("false", "10 * n_dup_lines > 3 * n_lines"),
    "repetition": ("false", "100 * n_repeat_words > 20 * n_words"),
    "shouting": ("false", "100 * n_shouts > 10 * n_words"),
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


VOTES = (-1, 0, 1)
#: How a rule is expected to vote on good and on bad documents before any are seen.
PRIOR_VOTES = ({-1: 0.02, 0: 0.49, 1: 0.49}, {-1: 0.3, 0: 0.35, 1: 0.35})


@dataclass(frozen=True)
class Supervision:
    """``weights[j][vote]``: log odds for good that this vote of rule j adds, abstaining
    included; ``accuracy[j]``: how often rule j is right when it votes; ``prior``: share
    of good documents."""

    weights: tuple[dict[int, float], ...]
    accuracy: tuple[float | None, ...]
    prior: float

    def posterior(self, votes: Sequence[int]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(w[v] for v, w in zip(votes, self.weights, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, start: float = 0.9, pseudo: float = 20.0,
              tol: float = 1e-9, most: int = 500) -> Supervision:
    """Expectation-maximisation over (votes, count) until no posterior moves.

    It starts from the belief that a document with any bad vote is bad with probability
    ``start`` and any other good with that probability. ``pseudo`` imagined documents of
    each class, PRIOR_VOTES, are added to the counts: they decide on a small or empty
    table and weigh nothing on a large one.
    """
    belief = [1 - start if -1 in votes else start for votes, _ in patterns]
    total = sum(n for _, n in patterns)
    for _ in range(most):
        good = [n * p for (_, n), p in zip(patterns, belief, strict=True)]
        n_good = sum(good)
        weights, accuracy = [], []
        for j in range(n_rules):
            on_good, on_bad = dict.fromkeys(VOTES, 0.0), dict.fromkeys(VOTES, 0.0)
            for (votes, n), g in zip(patterns, good, strict=True):
                on_good[votes[j]] += g
                on_bad[votes[j]] += n - g
            share = lambda c, of, prior: {v: (c[v] + pseudo * prior[v]) / (of + pseudo) for v in VOTES}
            a, b = share(on_good, n_good, PRIOR_VOTES[0]), share(on_bad, total - n_good, PRIOR_VOTES[1])
            weights.append({v: math.log(a[v] / b[v]) for v in VOTES})
            cast = on_good[1] + on_good[-1] + on_bad[1] + on_bad[-1]
            accuracy.append((on_good[1] + on_bad[-1]) / cast if cast else None)
        s = Supervision(tuple(weights), tuple(accuracy), (n_good + pseudo * start) / (total + pseudo))
        new = [s.posterior(votes) for votes, _ in patterns]
        moved = max((abs(x - y) for x, y in zip(new, belief, strict=True)), default=0.0)
        belief = new
        if moved < tol:
            break
    return s


def with_votes(measured: DataFrame) -> DataFrame:
    return measured.withColumns({f"vote_{k}": _vote(*v) for k, v in RULES.items()})


def supervise(voted: DataFrame) -> Supervision:
    """The pattern counts, at most 3 ** len(RULES) rows, are all that reaches the driver."""
    cols = [f"vote_{k}" for k in RULES]
    rows = voted.groupBy(*cols).agg(F.count("*").alias("n")).collect()
    return fit_votes(sorted((tuple(r[c] for c in cols), r["n"]) for r in rows), len(cols))


def judged(voted: DataFrame, s: Supervision) -> DataFrame:
    odds = F.lit(math.log(s.prior / (1 - s.prior)))
    for k, w in zip(RULES, s.weights, strict=True):
        v = F.col(f"vote_{k}")
        odds = odds + F.when(v > 0, F.lit(w[1])).when(v < 0, F.lit(w[-1])).otherwise(F.lit(w[0]))
    quality = 1 / (1 + F.exp(-odds))
    return voted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_rules(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Columns (row, measures, votes, base_failed, quality, kept) for every input row.

    Null and empty texts have no words, so they fail; repeated rows each get a row; an
    empty table gives none; other columns of the input travel inside ``row``.
    """
    voted = with_votes(measures(docs, F.col("text") if text is None else text))
    return judged(voted, supervise(voted))


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = measures(docs.select("doc_id", "text"), F.col("text")).select(F.struct("row.doc_id").alias("row"), *MEASURES)
    voted = with_votes(stored(measured, "quality-measures"))
    out = judged(voted, supervise(voted))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines",
            "n_letters", "n_shouts")
