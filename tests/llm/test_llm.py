import collections
import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldmotion.llm import (
    best_fit_packing, block_neighbours, co_training, flow_reshard, hyper_language, line_blocks, log_bilinear, ngram_jaccard,
    shingles, systematic_mix, weak_rules,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, copies string"
LINE = "one two three four five six seven eight nine ten eleven twelve."


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeats and clashing column names."""
    long = " ".join(f"w{i % 900}" for i in range(30_000))
    rows = [(1, LINE, "en", "a", 5, 0, "r", "c"), (2, LINE, "en", "a", 5, 0, "r", "c"), (2, LINE, "en", "a", 5, 0, "r", "c"),
            (3, None, None, None, None, None, None, None), (None, LINE, "en", None, 1, 1, "x", "y"), (4, "", "de", "b", 0, 0, "", ""),
            (5, " \t\n ", None, "", None, 0, "", ""), (6, long, "fr", "b", 9, 1, "", ""), (7, "12 34 !!", "fr", "b", 9, 1, "", ""),
            (8, LINE + " thirteen", "en", "c", 1, 1, "", ""), (9, "Ünïcode straße 東京 ﬁn", "de", "c", 1, 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_shingles_agree_with_sets():
    texts = ["A b\tc d e f a B c d e", "a b", "", "x " * 40, "é ü\x0bo p q r"]
    _, sets = shingles.shingle_sets([t.encode() for t in texts], 5)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    for t, s in zip(texts, sets, strict=True):
        w = words(lower(t))
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    assert set(sets[0].tolist()).isdisjoint(sets[4].tolist())


def brute_components(rows):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = words((t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rows, base = [], [[f"w{r.integers(400)}" for _ in range(r.integers(4, 60))] for _ in range(8)]
    for d in range(150):
        w = list(base[r.integers(8)])
        for _ in range(r.integers(0, 4)):
            w[r.integers(len(w))] = f"x{r.integers(30)}"
        rows.append((d, " ".join(w)))
    got = ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x)[:3] for x in got.collect()) == brute_components(rows)


def test_ngram_join_of_one_repeated_word(spark):
    """Five times a word has the same one shingle as six times; four times has another."""
    texts = {1: "ho " * 5, 2: "ho " * 6, 3: "ho " * 9, 4: "ho " * 4, 5: "a b c d e", 6: "a b c d e f", 7: "ho hum"}
    rows = list(texts.items())
    got = ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(tuple(x)[:3] for x in got.collect())
    assert found == brute_components(rows)
    assert {d: c for d, _, c in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_ngram_join_odd_rows(spark):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(odd_docs(spark)).collect())
    assert ("3", 0, 3) in got and ("5", 0, 5) in got and got.count(("2", 8, 1)) == 2 and ("None", 8, 1) in got and ("8", 9, 1) in got
    assert ngram_jaccard.near_duplicates(empty(spark)).count() == 0


def test_matches_choice_and_lossless_prefix():
    assert ngram_jaccard.choose_matches(20, 4, np.array([2, 2, 2, 9, 9, 9, 9, 9]), 75) >= 1
    r = np.random.default_rng(5)
    for _ in range(300):  # any two similar sets share m tokens of their prefixes for m
        n = int(r.integers(5, 40))
        x = sorted(r.choice(60, n, replace=False).tolist())
        y = sorted(set(x[int(r.integers(0, 4)):]) | set(r.choice(60, 2).tolist()))
        both = len(set(x) & set(y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            for m in range(1, 4):
                cut = lambda s: set(s[: len(s) - -(-75 * len(s) // 100) + m])  # noqa: B023, E731
                assert len(cut(x) & cut(y)) >= min(m, both)


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><article><h1>Big &amp; small</h1><p>First
 line.<br>Same block.<p>Second <b>bold</b>.</p><aside>More</aside><script>var a="<p>no</p>";</script><form>Name</form><p>Third.</p>
<section id="comments"><p>First!</p></section></article><footer>&copy; me</footer>"""
    assert line_blocks.main_text(page) == "Big & small\nFirst line. Same block.\nSecond bold.\nThird."
    assert line_blocks.main_text(None) == "" == line_blocks.main_text("")
    bare = "<div>" + "".join(f"<p>{LINE} {i}</p>" for i in range(5)) + "</div><div class=footer>x</div>"
    assert line_blocks.main_text(bare).count("\n") == 4
    assert line_blocks.stretches([0, 0, 100, 50, 0, 0, 0, 0, 90, 0], 80) == [(2, 6), (8, 10)]


def test_windows_choose_the_text_on_every_page():
    text = "".join(f"<p>{LINE} {i}</p>" for i in range(6))
    whole = [f"{LINE} {i}" for i in range(6)]
    # an article that is a teaser beside a long main text does not win by its tag
    teaser = f"<div><article><p>Soon.</p></article></div><div>{text}</div>"
    assert line_blocks.main_text(teaser).split("\n") == whole
    # no element marks the article: short lines between removed parts and linked ones stay
    bare = (f"<nav>Menu</nav><div>{text}<div class=ad>Buy</div><h2>More</h2><form>Name</form><p>The end.</p><aside>x</aside>"
            f"<p>See <a href=x>the long study of it all</a>.</p></div><footer>me</footer>")
    assert line_blocks.main_text(bare).split("\n") == [*whole, "More", "The end.", "See the long study of it all."]
    # outside of the text's section, short lines are left out
    assert line_blocks.main_text(f"<div>Hi</div><form>x</form><div>{text}</div>").split("\n") == whole
    # whole names mark a part, not parts of names
    assert line_blocks.main_text(f'<div class="no-sidebar has-comments">{text}</div>').split("\n") == whole
    # the same text with the article's tags taken away
    page = f"<body><nav>Menu</nav><div class=ad>Buy</div><article><h1>Big</h1>{text}<aside>x</aside><p>So.</p></article><footer>me</footer></body>"
    stripped = re.sub("</?article>", "", page)
    assert line_blocks.main_text(stripped) == line_blocks.main_text(page) == "\n".join(["Big", *whole, "So."])


def test_windows_choose_inside_an_article(monkeypatch):
    """Containers nobody has a name for go or stay by their windows; another surge or window changes that."""
    para = lambda k, n: f"<p>{' '.join([k] * n)}.</p>"
    page = (f"<body><article><h1>Head</h1><div class=body>{para('long', 60)}{para('so', 2)}{para('more', 70)}</div><div class='ad-slot x9'><p>Buy now!</p></div>"
            f"<section class=related-posts-list><p>Read this</p><p>And that</p></section><section class=second>{para('deep', 40)}</section><p>End.</p></article></body>")
    long, so, more, deep = (" ".join([k] * n) + "." for k, n in (("long", 60), ("so", 2), ("more", 70), ("deep", 40)))
    assert line_blocks.main_text(page) == "\n".join(["Head", long, so, more, deep, "End."])
    monkeypatch.setattr(line_blocks, "SURGE", 0.5)
    assert line_blocks.main_text(page) == "\n".join(["Head", long, so, more, "End."])
    monkeypatch.setattr(line_blocks, "SURGE", 0.01)
    assert "Buy now!" in line_blocks.main_text(page) and "And that" in line_blocks.main_text(page)
    monkeypatch.setattr(line_blocks, "SURGE", 0.25)
    three = page.replace("<p>End.", f"<section>{para('trio', 12) * 3}</section><p>End.")
    assert line_blocks.main_text(three).count("trio") == 36
    monkeypatch.setattr(line_blocks, "WINDOW", 1)
    assert line_blocks.main_text(three) == line_blocks.main_text(page)


def test_markup_leaves_no_blank():
    assert line_blocks.main_text("<p>Hello<!-- c -->world<script>x</script>, a<b>b</b>c</p>") == "Helloworld, abc"


def test_stretches_against_brute_force():
    """A stretch is a run of windows with text that holds a window of the surge, up to its neighbours with text."""
    r = np.random.default_rng(8)
    for _ in range(300):
        n = [int(x) for x in r.choice([0, 0, 0, 5, 20, 90], r.integers(1, 30))]
        window, surge = int(r.integers(1, 5)), int(r.integers(1, 150))
        got = {i for s, e in line_blocks.stretches(n, surge, window) for i in range(s, e) if n[i]}
        runs, run = [], []
        for i, x in enumerate(n):
            if x and run and i - run[-1] > window:
                runs.append(run)
                run = []
            if x:
                run.append(i)
        for run in [*runs, run]:
            sums = [sum(n[max(0, j - window + 1) : j + 1]) for j in range(run[0], min(len(n), run[-1] + window))] if run else []
            first = next((i for i in run if max((sums[j - run[0]] for j in range(i, min(i + window, run[0] + len(sums)))), default=0) >= surge), None)
            if first is not None:
                while first - 1 in run:
                    first -= 1
            assert got & set(run) == ({i for i in run if i >= first} if first is not None else set())


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>hello</p>", None)], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in line_blocks.extract(pages).collect()) == [("", 0), ("hello", 5)]


def test_packing_round_trip(spark):
    docs = odd_docs(spark)
    got = best_fit_packing.pack(best_fit_packing.pieces(docs, most=64, keep_ids=True), most=64).collect()
    encode = best_fit_packing.encoder((best_fit_packing.tokenizer_files()[0], None))
    whole = sorted([*encode(r["text"] or ""), 2] for r in docs.collect())
    ones = [r for r in got if r["piece"] == 0]
    assert len(ones) == len(whole)
    assert sorted(sum((list(r["ids"]) for r in sorted((x for x in got if x["doc_id"] == 6), key=lambda r: r["piece"])), [])) == sorted(max(whole, key=len))
    seqs = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in seqs.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= 64
    assert best_fit_packing.packed(empty(spark)).count() == 0


def test_both_tokenizers_agree():
    files = best_fit_packing.tokenizer_files()
    a, b = best_fit_packing.encoder(files), best_fit_packing.encoder((files[0], None))
    for t in ["Hello  world\n\n x", "naïve ŠČ ß 12,5 % <|endoftext|>", "東京   x", "\x00\x85 a\xa0b", "'s 'LL don't"]:
        assert list(a(t)) == list(b(t))


def test_special_strings_and_long_blanks():
    """Ids are the library's own, and a million blanks or line feeds do no harm."""
    files = best_fit_packing.tokenizer_files()
    a, b = best_fit_packing.encoder(files), best_fit_packing.encoder((files[0], None))
    assert list(a("x <|endoftext|> y")) == [87, 220, 50256, 331]
    for t in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "x " * 500 + "\t \n" * 5000, "\xa0" * 3000 + "z" * 2000):
        assert list(a(t)) == list(b(t))


def test_long_ids_beside_nulls(spark):
    """doc_ids that a double cannot hold come back whole from packing, language ID and the pipeline's stages."""
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, LINE, "en", "a", 2**60 + 3, None, "r", "c"), (None, LINE + " and more words than that", "en", None, None, 1, "r", "c")], SCHEMA)
    assert {r["doc_id"] for r in best_fit_packing.packed(docs).collect()} == {big, None}
    assert {r["doc_id"] for r in hyper_language.identify(docs, hyper_language.learn(docs)).collect()} == {big, None}
    docs = docs.union(spark.createDataFrame([(i, LINE, "en", "a", i, 0, "r", "c") for i in range(8)], SCHEMA))
    got = {(r["doc_id"], r["n_chars"]) for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert len(got) == 10 and {(big, 2**60 + 3), (None, None)} < got


def test_many_different_letters():
    """N-grams are multiplied block by block; blocks change nothing."""
    r = np.random.default_rng(2)
    text = "".join(chr(0x4E00 + int(x)) for x in r.integers(0, 3000, 12_000))
    texts = [text, text[:3000], "abc def"]
    grams, owner, gram_of = hyper_language.gram_counts(texts)
    assert len(grams) > hyper_language.GRAM_BLOCK
    vectors = hyper_language.gram_vectors(grams, 64)
    want = np.stack([vectors[gram_of[owner == i]].sum(axis=0) for i in range(3)])
    assert (hyper_language.bundle(texts, 64) == want).all()


def test_bundle_by_brute_force():
    text, dim = "Ab ü", 32
    codes, total = [0, ord("a"), ord("b"), 0, ord("ü"), 0], np.zeros(dim)
    for i in range(len(codes) - 2):
        v = np.ones(dim, int)
        for k in range(3):
            v *= np.roll(hyper_language.letter_vector(codes[i + k], dim), 2 - k)
        total += v
    assert (hyper_language.bundle([text], dim)[0] == total).all()


def test_one_row_of_each_group(spark):
    """Clashing names, null and repeated ids: one row a group stays, the same one in every run."""
    near, other = LINE + " thirteen", "quite another text that has no partner in this small table at all"
    rows = [(1, LINE, "z"), (None, near, "y"), (None, other, "x"), (5, near, "w"), (7, other, "v"), (7, near, "u"), (7, near, "a"), (7, near, "a"), (8, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _first string")
    docs = docs.selectExpr("*", "'en' AS lang", "_first AS source", "1 AS key", "2 AS first", "3 AS row", "4 AS component_id")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["_first"]) for r in got.collect()) == [(1, "z"), (7, "v"), (8, "n")]


def test_open_sequences_is_best_fit():
    s = best_fit_packing.OpenSequences(10, 2)
    assert [s.place(n) for n in (6, 7, 3, 4, 10, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 16))
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (450, [None] * 16), (500, [1.0, 2.0])]
    got = block_neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, query_block=4, block=64).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 300, 50):
        best = sorted(((-(unit[q] @ unit[c]), c) for c in range(300) if c != q))[:5]
        assert [r["vec_id"] for r in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == [c for _, c in best]
    assert {r["query_id"] for r in got} == set(range(0, 300, 50))


def test_neighbours_of_huge_and_tiny_numbers(spark):
    """Scaling by powers of two leaves the cosine as it is; lengths do not mix; repeated ids are rows."""
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8))
    rows = [(i, (x * 10.0 ** (150 * (i % 3 - 1))).tolist()) for i, x in enumerate(v)] + [(100, [1e300, -1e300]), (101, [1e-300, 1e-301]), (102, [1.0, -1.0])]
    rows += [(7, rows[8][1]), (0, rows[1][1])]
    got = block_neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, query_block=2, block=16).collect()
    unit = lambda x: np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max())
    want = []
    for q, x in rows:
        if q % 50 == 0:
            best = sorted((-round(float(unit(x) @ unit(y)), 12), c) for c, y in rows if c != q and len(x) == len(y))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in got) == sorted(want)


def test_common_words_by_a_threshold(spark):
    r = np.random.default_rng(4)
    c = [int(x) for x in r.zipf(1.4, 800) % 10_000 + 1]
    counts = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(c)], "word long, kind int, c long")
    for most in (1, 40, 300, 5000):
        got = [x["c"] for x in log_bilinear.common_words(counts, most).collect()]
        assert len(got) <= most and (not got or sorted(got) == sorted(x for x in c if x >= min(got)))
    assert len(log_bilinear.common_words(counts, 5000).collect()) == 800 and log_bilinear.common_words(counts.limit(0)).count() == 0


def test_base_score_by_counting(spark):
    """base_score, n_tokens and n_known against counts in plain Python; a second run gives the same rows."""
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {x["doc_id"]: [*words(lower(x["text"])), None] for x in rows}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    count = collections.Counter(t for k, v in tokens.items() if not held[k] for t in v)
    n, v = sum(count.values()), len(count)
    first = sorted(map(tuple, log_bilinear.op7_query(spark, d).collect()))
    assert len(first) == len(rows)
    for doc, out, n_tokens, n_known, train, base, score in first:
        want = sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[doc])
        assert (out, n_tokens, n_known, train) == (held[doc], len(tokens[doc]), sum(count[t] > 0 for t in tokens[doc]), n)
        assert abs(base - want) < 1e-6 * max(1, abs(want)) and score < 0
    assert sum(r[6] for r in first if r[1]) > sum(r[5] for r in first if r[1])
    again = sorted(map(tuple, log_bilinear.op7_query(spark, d).collect()))
    assert all(a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-3 * abs(a[6]) for a, b in zip(first, again, strict=True))


def test_grid_of_tasks_does_not_grow_with_the_blocks():
    assert all(block_neighbours._grid(a, b, 32)[0] * block_neighbours._grid(a, b, 32)[1] <= 64 for a in (1, 3, 50, 4000) for b in (1, 7, 90, 10**6))


def test_flow_is_cheapest_and_shards_are_equal(spark):
    for seed in range(20):
        r = np.random.default_rng(seed)
        supply = r.integers(0, 50, 4).tolist()
        total = sum(supply)
        cap = [total // 5 + (j < total % 5) for j in range(5)]
        flow = flow_reshard.cheapest_flow(supply, cap, [[int(i != j) for j in range(5)] for i in range(4)])
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= cap[j] for j in range(5))
        assert sum(flow[i][i] for i in range(4)) == sum(min(supply[i], cap[i]) for i in range(4))
    docs = odd_docs(spark)
    plan = flow_reshard.reshard(docs, flow_reshard.text_bytes(F.col("text")), F.col("text"), F.col("doc_id"), F.lit(0), 1, 2)
    got = flow_reshard.with_slots(plan.rows).collect()
    assert len(got) == docs.count()
    for j in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == j)
        assert own == list(range(len(own)))
    none = flow_reshard.reshard(empty(spark), flow_reshard.text_bytes(F.col("text")), F.col("text"), F.col("doc_id"), F.lit(0), 1, 2)
    assert flow_reshard.with_slots(none.rows).count() == 0


def test_class_probabilities_are_normalised():
    vocab = log_bilinear.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                                    np.ones(log_bilinear.CLASSES, np.int64), np.ones(log_bilinear.CLASSES, np.int64), 255, 255)
    p = log_bilinear.start_parameters(vocab)
    ctx = np.tile(np.array([[3, 4, 5, 6]]), (log_bilinear.CLASSES, 1))
    assert abs((10 ** log_bilinear.class_log10(p, ctx, np.arange(log_bilinear.CLASSES))).sum() - 1) < 1e-5


def some_parameters(r, size):
    return r.normal(0, size, log_bilinear.CLASSES * (2 * log_bilinear.DIM + 1) + log_bilinear.CONTEXT * log_bilinear.DIM).astype(np.float32)


def test_class_probabilities_are_those_of_a_softmax_in_doubles():
    """Also where logits are so large that products of powers of e vanish."""
    r = np.random.default_rng(5)
    ctx, target = r.integers(0, log_bilinear.CLASSES, (3000, log_bilinear.CONTEXT)), r.integers(0, log_bilinear.CLASSES, 3000)
    for size in (0.3, 2.0, 8.0):
        p = some_parameters(r, size)
        q, to, place, bias = (x.astype(float) for x in log_bilinear._parts(p))
        logits = (q[ctx] * place).sum(axis=1) @ to.T + bias
        top = logits.max(axis=1, keepdims=True)
        want = (logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True)))[np.arange(3000), target] / np.log(10)
        assert np.allclose(log_bilinear.class_log10(p, ctx, target), want, rtol=1e-4, atol=1e-4) and (size < 8 or top.max() > 1000)
    assert len(log_bilinear.class_log10(p, ctx[:0], target[:0])) == 0


def test_powers_of_e_do_not_grow_with_the_contexts(monkeypatch):
    r = np.random.default_rng(6)
    ctx, target = r.integers(0, log_bilinear.CLASSES, (20_000, log_bilinear.CONTEXT)), r.integers(0, log_bilinear.CLASSES, 20_000)
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **k: taken.append(np.size(x)) or exp(x, **k))
    log_bilinear.class_log10(some_parameters(r, 0.3), ctx, target)
    assert sum(taken) <= log_bilinear.CONTEXT * log_bilinear.CLASSES**2


def test_a_training_step_follows_the_plain_gradients():
    r = np.random.default_rng(7)
    ctx, target = r.integers(0, 40, (200, log_bilinear.CONTEXT)), r.integers(0, 40, 200)
    p, noise = some_parameters(r, 0.3), np.full(log_bilinear.CLASSES, 1 / log_bilinear.CLASSES)
    draw = np.random.Generator(np.random.Philox(key=9))
    draw.permutation(200)
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), draw.random(log_bilinear.NOISE) * np.cumsum(noise)[-1]), log_bilinear.CLASSES - 1)
    q, to, place, bias = (x.astype(float) for x in log_bilinear._parts(p))
    grad = [np.zeros_like(x) for x in (q, to, place, bias)]
    log_noise = np.log(noise * log_bilinear.NOISE)
    for c, t in zip(ctx, target, strict=True):
        h = (q[c] * place).sum(axis=0)
        for k, true in [(t, 1), *((k, 0) for k in drawn)]:
            g = 1 / (1 + np.exp(-(h @ to[k] + bias[k] - log_noise[k]))) - true
            grad[1][k] += g * h
            grad[3][k] += g
            for i, x in enumerate(c):
                grad[0][x] += g * to[k] * place[i]
                grad[2][i] += g * to[k] * q[x]
    grad = np.concatenate([g.ravel() for g in grad]) / 200
    got = p.copy()
    log_bilinear.train_on(got, np.full_like(p, 1e-6), ctx, target, noise, 9)
    assert np.allclose(got, p - 0.05 * grad / np.sqrt(1e-6 + grad * grad), atol=2e-4)


def test_every_training_token_is_a_target_once():
    texts = [f"{LINE} {i}".encode() for i in range(40)] + [b"", b"one one one"]
    vocab = log_bilinear.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                                    np.ones(log_bilinear.CLASSES, np.int64), np.ones(log_bilinear.CLASSES, np.int64), 255, 255)
    for part in (texts, texts[7:20], texts[-2:]):
        hashes, _, _, _, n = log_bilinear.encode(part, vocab)
        rounds = [log_bilinear.targets(hashes, n, turn) for turn in range(log_bilinear.ROUNDS)]
        assert sorted(np.concatenate(rounds)) == list(range(len(hashes)))
    # a text's share of a round does not depend on the texts around it
    alone, _, _, _, n = log_bilinear.encode(texts[3:4], vocab)
    among, _, _, _, m = log_bilinear.encode(texts[2:5], vocab)
    start = int(m[0])
    inside = [x - start for x in log_bilinear.targets(among, m, 0) if start <= x < start + m[1]]
    assert inside == log_bilinear.targets(alone, n, 0).tolist()


def test_scores_odd_rows(spark):
    docs = odd_docs(spark).select("doc_id", "text", "size").withColumn("held_out", F.lit(False))
    counts = log_bilinear.word_counts(docs).cache()
    vocab = log_bilinear.vocabulary(counts, docs.count())
    tokens = [w.lower() for r in docs.collect() for w in words(r["text"])]
    assert vocab.n == len(tokens) + docs.count() and vocab.v == len(set(tokens)) + 1
    got = log_bilinear.scores(docs, vocab, counts, log_bilinear.trained(docs, vocab)).collect()
    assert len(got) == docs.count()
    end = np.log10((docs.count() + 0.5) / (vocab.n + 0.5 * (vocab.v + 1)))
    for r in got:
        assert r["n_known"] == r["n_tokens"] and r["score"] < 0
        if r["doc_id"] in (3, 4, 5):
            assert r["n_tokens"] == 1 and abs(r["base_score"] - end) < 1e-9
    assert log_bilinear.scores(docs.limit(0), vocab, counts, log_bilinear.start_parameters(vocab)).count() == 0


def test_mix_agrees_with_sql_and_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got = sorted(map(tuple, systematic_mix.op8_query(spark, d).collect()))
    assert got == sorted(con.sql(systematic_mix.OP8_SQL).fetchall())
    mix = systematic_mix.systematic_mix(odd_docs(spark), systematic_mix.word_count(F.col("text")), F.col("source"), F.col("doc_id"))
    rows = mix.collect()
    assert len(rows) == 11 and all(0 <= r["copies"] <= 2 for r in rows)
    assert systematic_mix.emitted(mix).columns == odd_docs(spark).columns
    assert systematic_mix.systematic_mix(empty(spark), F.col("size"), F.col("source"), F.col("doc_id")).count() == 0


def filled(sizes, weights, share, cap):
    """Water-filling step by step: split what is left by weight, freeze whoever is above its cap."""
    target, left = {}, share * sum(sizes.values())
    open_ = {k: weights[i % len(weights)] for i, k in enumerate(sorted(sizes))}
    while open_:
        over = [k for k in open_ if left * open_[k] / sum(open_.values()) > cap * sizes[k]]
        if not over:
            return target | {k: left * w / sum(open_.values()) for k, w in open_.items()}
        for k in over:
            target[k] = cap * sizes[k]
        left -= sum(target[k] for k in over)
        for k in over:
            del open_[k]
    return target


def test_mix_targets_and_words_taken(spark):
    for seed in range(4):
        r = np.random.default_rng(seed)
        sizes = {f"s{i:02d}": int(r.integers(1, 10 ** r.integers(2, 6))) for i in range(9)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in systematic_mix.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = filled(sizes, (5, 2, 1), 1.5, 2.0)
        assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in sizes)
        assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    per = {}
    for x in systematic_mix.op8_query(spark, "/root/testdata/sf0.01").collect():
        assert 0 <= x["taken"] <= 2 * x["size"]
        per.setdefault((x["source_size"], x["target"]), []).append(x["taken"])
    assert all(abs(sum(v) - t) < 0.1 * t + 500 for (_, t), v in per.items())


def test_quality_measures_against_brute_force(spark):
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(
        [(20, "a b c d e f a b c d e f\nx\nx\n \n\n y# |"), (21, "z " * 50), (22, f"{LINE}\n{LINE}\nother line")], "doc_id long, text string"))
    for r in weak_rules.measures(docs, F.col("text")).collect():
        t = r["row"]["text"] or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 1000 else None
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == (len(w) if hit is None else len(hit))
    assert weak_rules.quality_rules(empty(spark)).count() == 0
    out = {r["row"]["doc_id"]: r["kept"] for r in weak_rules.quality_rules(odd_docs(spark)).collect()}
    assert out[1] and not out[3] and not out[4] and not out[6]


def test_votes_find_the_bad_class():
    good, bad = (1, 0, 0), (0, -1, -1)
    s = weak_rules.fit_votes([(good, 900), (bad, 80), ((1, -1, 0), 20)], 3)
    assert s.posterior(good) > 0.9 and s.posterior(bad) < 0.1
    assert weak_rules.fit_votes([], 3).posterior(good) > 0.9


def test_language_id(spark):
    docs = odd_docs(spark)
    p = hyper_language.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in hyper_language.identify(docs, p).collect()}
    assert got[1][0] == "en" and got[6][0] == "fr" and got[9][0] == "de"
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 7)) and all(0 <= s <= 1 for _, s in got.values())
    assert hyper_language.learn(empty(spark)) == {} and hyper_language.identify(docs, {}).where("lang_pred <> 'und'").isEmpty()


def test_co_training(spark):
    docs = spark.createDataFrame([(i, (LINE if i % 3 else "### $$$ ***") + f" {i}", "en", f"s{i % 3}", i, 0, "", "") for i in range(120)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (61, None), (62, 0), (62, 1)], "doc_id long, quality int")
    got = co_training.quality_scores(docs, labels).collect()
    assert len(got) == 120 and all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
    odd = co_training.quality_scores(odd_docs(spark), labels.limit(0)).collect()
    assert len(odd) == 11 and all(r["kept"] and r["score"] == 0.5 for r in odd)
    assert co_training.quality_scores(empty(spark), labels).count() == 0


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    good, bad = order[y == 1], order[y == 0]
    return (good.sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))


def quality_corpus(spark, telling):
    """Texts of overlapping word lists; the source tells the quality, or nothing."""
    r, rows, labels = np.random.default_rng(5), [], []
    for i in range(1200):
        good = int(r.random() < 0.6)
        text = " ".join(f"{'ab'[good] if r.random() < 0.08 else 'c'}{r.integers(60)}" for _ in range(30))
        rows.append((i, text, "en", f"s{good if telling and r.random() < 0.97 else r.integers(2)}", len(text), 0, "", ""))
        labels.append((i, good))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:160], "doc_id long, quality int")
    return docs, known, np.array([g for _, g in labels])


@pytest.mark.parametrize("telling", [True, False])
def test_rounds_help_or_do_nothing(spark, telling):
    """On documents whose labels nobody saw: metadata that tells something teaches the text
    view; metadata that tells nothing changes little and is not listened to."""
    docs, known, y = quality_corpus(spark, telling)
    found = {}
    for rounds in (0, 4):
        got = sorted(tuple(r) for r in co_training.quality_scores(docs, known, rounds).collect())
        found[rounds] = np.array([g[1:4] for g in got])[160:].astype(float)
    none, some = (auc(found[k][:, 0], y[160:]) for k in (0, 4))
    if telling:
        assert some > none + 0.05 and auc(found[4][:, 2], y[160:]) > 0.97
    else:
        assert some > none - 0.02 and found[4][:, 1].std() < 0.1


def test_all_unlabelled_documents_take_part(spark):
    """Newton sums over the pool are those over all its rows, with what the other view hands over."""
    r = np.random.default_rng(3)
    t, m = r.normal(size=(500, 3)).astype(np.float32), r.normal(size=(500, 2)).astype(np.float32)
    view = lambda k: co_training.View(np.zeros(k), np.ones(k), r.normal(size=k + 1), sure=(-0.5, 0.7))
    views = [view(3), view(2)]
    pool = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes())) for a, b in zip(t, m)], "t binary, m binary")
    got = co_training.pool_sums(pool, views)
    for me, other, x, o in ((0, 1, t, m), (1, 0, m, t)):
        y = views[other].pseudo_labels(o.astype(float))
        g, h = co_training.newton_sums(views[me].inputs(x[y >= 0].astype(float)), y[y >= 0], views[me].weights)
        assert got[me][0] == (y >= 0).sum() > 0 and np.allclose(got[me][1], g) and np.allclose(got[me][2], h)


def test_pipeline_stages(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert stage(spark, empty(spark), "").count() == 0
    kept = [r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert sorted(kept) == [1, 3, 4, 5, 6, 7, 9]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where("length > 1024 or offset + length > 1024").isEmpty()


def test_queries_agree_with_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{os.path.join(d, t)}.parquet'")
    for q, sql in ((ngram_jaccard.op1_query, ngram_jaccard.OP1_SQL), (block_neighbours.op5_query, block_neighbours.OP5_SQL)):
        assert sorted(map(tuple, q(spark, d).collect())) == sorted(con.sql(sql).fetchall())
