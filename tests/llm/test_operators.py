"""The training-corpus operators against brute force and on odd inputs."""

import binascii
import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tipscope.llm import (backoff_lm, components, cotrain, decontaminate, html_text, line_dedup, line_rules, mixing,
                          ngram_join, secrets, toxicity)

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, and
    columns whose names the operators use themselves."""
    rows = [(1, LONG, "en", "a", 1), (2, None, None, None, None), (None, "a b c d e f g", "en", "a", 2),
            (3, "", "en", "a", 0), (4, "a b c d e f g", "de", "b", 3), (4, "a b c d e f g", "de", "b", 3),
            (5, " \t\n\x0b ", "en", "a", 1), (6, "one", "en", "b", 1), (7, LONG, "fr", "c", 9)]
    d = spark.createDataFrame(rows, DOC)
    return d.withColumns({c: F.lit("clash") for c in ("id", "rid", "n", "key", "rep", "kept", "component", "h", "item", "k")})


def test_every_dealt_query_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("order,span", [(1, 256), (2, 256), (3, 7), (4, 3)])
def test_backoff_lm_is_the_smoothed_model(docs, texts, monkeypatch, order, span):
    """Brute force over dictionaries of n-grams; pieces far shorter than texts."""
    monkeypatch.setattr(backoff_lm, "SPAN", span)
    held = {d: binascii.crc32(str(d).encode()) % 7 == 2 for d in texts}
    seq = {d: [*words(t), "</s>"] for d, t in texts.items()}
    grams, begun = collections.Counter(), 0
    for d, w in seq.items():
        if not held[d]:
            begun += 1
            for i in range(len(w)):
                for k in range(1, order + 1):
                    if i - k + 1 >= -1:  # one start token stands for all before
                        grams[tuple(w[i - k + 1:i + 1]) if i - k + 1 >= 0 else ("<s>", *w[:i + 1])] += 1
    one = {g[0]: c for g, c in grams.items() if len(g) == 1}
    total, kinds, s = sum(one.values()), len(one), backoff_lm.STRENGTH
    grams["<s>",] = begun

    def p(h, x):
        if not h:
            return (one.get(x, 0) + 1) / (total + kinds + 1)
        return (grams[(*h, x)] + s * p(h[1:], x)) / (grams[h] + s)
    for r in backoff_lm.score(docs, order=order).collect():
        w = seq[r.doc_id]
        base = sum(math.log10(p((), x)) for x in w)
        past = ["<s>", *w]
        score = sum(math.log10(p(tuple(past[max(0, i + 2 - order):i + 1]) if order > 1 else (), x)) for i, x in enumerate(w))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in one for x in w), total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_failure_arcs_lead_to_the_shorter_history(docs):
    row = next(iter(backoff_lm._blocks(iter([pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(["a b a b c", "b a b"])], names=["i", "t"])])))).to_pylist()[0]
    levels = backoff_lm.ngrams(row, 3)
    n = np.frombuffer(row["counts"], np.int64)
    counts = [np.bincount(at, minlength=len(keys)) for keys, at, _ in levels]
    m = backoff_lm.Automaton(levels, counts, 2, int(n.sum()), len(levels[0][0]), 5.0)
    one, two = levels[0][1], levels[1][1]
    assert all(m.fail[2][two[i] + 1] == one[i] + 1 for i in range(len(one))) and not m.fail[1].any()
    assert len(m.arcs[1][0]) == len(levels[1][0]) and len(m.arcs[2][0]) == len(levels[2][0])


def test_secret_spans(docs, texts):
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
             ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    for r in secrets.digest(secrets.scan(docs)).collect():
        spans = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(kinds)
                       for m in re.finditer(p, texts[r.doc_id]) if len(m[g]) >= n)
        assert r.base_sha256 == hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(spans)


def test_ownership_tells_copied_examples_from_live_keys(spark):
    key = "Ab1" * 10
    rows = [(i, f"😀 x {key} token=abcdefghijkl{i}", "en", f"s{i % 4}", 0) for i in range(8)]
    rows.append((99, "x Zz9" + "Qq8" * 8, "en", "s9", 0))
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, DOC))).collect()}
    assert all(got[i].n_owned == 0 and got[i].n_live == 1 for i in range(8)) and got[99].spans == "owned:2:29"
    assert got[0].spans == "assign:35:54"  # code points: the emoji counts once


def test_jaccard_components(docs, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    up = {d: d for d in sets}

    def top(x):
        return x if up[x] == x else top(up[x])
    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(i := sets[a] & sets[b]) >= 75 * (len(sets[a]) + len(sets[b]) - len(i)):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    for r in ngram_join.jaccard_classes(docs).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.id]), top(r.id))


def test_jaccard_at_the_threshold_and_across_a_hot_group(spark):
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *[f"t{i}_{j}" for j in range(6)]]), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, " ".join([*base[:10], *[f"u{i}_{j}" for j in range(60)]]), "en", "a", 0) for i in range(40)]
    got = {r.id: r.component_id for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(40))


def test_jaccard_of_documents_built_of_stock_passages(spark, monkeypatch):
    """Brute force where words are shared widely, over many blocks and buckets."""
    monkeypatch.setattr(ngram_join, "BLOCK", 700)
    monkeypatch.setattr(ngram_join, "GROUP", 900)
    r = random.Random(8)
    stock = [" ".join(f"p{j}w{i}" for i in range(30)) for j in range(12)]
    common = " ".join(f"c{i}" for i in range(40))
    rows = []
    for i in range(160):
        w = " ".join([common, *r.sample(stock, 3)]).split()
        if rows and i % 3 == 0:
            w = r.choice(rows)[1].split()
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a", 0))
    rows += [(500, " ".join(f"long{i}" for i in range(3000)), "en", "a", 0), (501, " ".join(f"long{i}" for i in range(2900)), "en", "a", 0)]
    sets = {x[0]: shingles(x[1]) for x in rows}
    up = {d: d for d in sets}

    def top(x):
        return x if up[x] == x else top(up[x])
    for a in sets:
        for b in sets:
            if b < a and 100 * len(i := sets[a] & sets[b]) >= 75 * (len(sets[a]) + len(sets[b]) - len(i)):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {x.id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {d: (len(sets[d]), top(d)) for d in sets} and len({top(d) for d in sets}) > 20


def test_jaccard_cells_hold_every_pair_of_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 8)
    big, other = range(400), range(1000, 1090)
    rows = [(1, i, 0) for i in big] + [(k, i, i) for k in (1, 2) for i in other] + [(3, i, 7) for i in big]
    cells, pairs = ngram_join._cells(spark.createDataFrame(rows, "key long, rep long, component long"))
    held = {tuple(c.id): c.x for c in cells.collect()}
    seen = {frozenset((x, y)) for p in pairs.collect() for x in held[tuple(p.a)] for y in held[tuple(p.b)]}
    assert all(frozenset((x, y)) in seen for x in other for y in [*big, *other] if x != y)
    assert not any(frozenset((x, x + 1)) in seen for x in range(399))  # one component
    # a member once a cell that holds it: the two groups of key 1 and 2 share theirs
    assert sum(map(len, held.values())) <= len(big) + 2 * len(other)


def test_jaccard_with_all_pairs_across_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 0)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *[f"t{i % 30}_{j}" for j in range(6)]]) + f" e{i}", "en", "a", 0) for i in range(60)]
    rows += [(200 + i, " ".join([*base[:30], *[f"u{i % 6}_{j}" for j in range(30)], f"e{i}"]), "en", "a", 0) for i in range(24)]
    got = {r.id: r.component_id for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{200 + i: 200 + i % 6 for i in range(24)}}


def test_jaccard_candidates_that_do_not_link_stay_in_proportion(spark, monkeypatch):
    """All documents share words and every pair passes the sketch, but few link:
    candidates are no more than the cells' members, and no link is lost."""
    monkeypatch.setattr(ngram_join, "CELL", 16)
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 64)
    monkeypatch.setattr(ngram_join, "PART", 700, raising=False)
    base = [f"b{i}" for i in range(85)]
    rows = [(i, " ".join([*base, *[f"t{i}_{j}" for j in range(15)]]), "en", "a", 0) for i in range(90)]
    rows += [(200 + i, " ".join([*base, *[f"t{i}_{j}" for j in range(14)], f"y{i}"]), "en", "a", 0) for i in range(0, 90, 9)]
    seen, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *x: seen.append(pairs.count()) or verified(pairs, *x))
    got = {r.id: r.component_id for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {**{i: i for i in range(90)}, **{200 + i: i for i in range(0, 90, 9)}}
    assert sum(seen) < 1000  # over 4,005 pairs pass the sketch


@pytest.mark.parametrize("rounds", [0, 1])
def test_jaccard_links_are_found_within_dense_cells(spark, monkeypatch, rounds):
    """Brute force where borderline pairs and links mix in many groups of the same
    members, and the nearest pairs join little."""
    monkeypatch.setattr(ngram_join, "CELL", 16)
    monkeypatch.setattr(ngram_join, "LARGEST", 3)
    monkeypatch.setattr(ngram_join, "PART", 700)
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 64)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "_forest", lambda x, y, holds=None, old=ngram_join._forest: old(x, y, holds) if holds else old(x[:1], y[:1]))
    dense, within = [], ngram_join._within
    monkeypatch.setattr(ngram_join, "_within", lambda *x: dense.append(within(*x).count()) or within(*x))
    r = random.Random(5)
    base, tails, rows = [f"b{i}" for i in range(85)], [], []
    for i in range(90):  # up to 13 other words at the end are a link
        own = r.randrange(11, 16) if tails else 15
        tails.append([*(r.choice(tails)[:15 - own] if own < 15 else []), *[f"t{i}_{j}" for j in range(own)]])
        rows.append((i, " ".join([*base, *tails[-1]]), "en", "a", 0))
    sets = {x[0]: shingles(x[1]) for x in rows}
    up = {d: d for d in sets}

    def top(x):
        return x if up[x] == x else top(up[x])
    for a in sets:
        for b in sets:
            if b < a and 100 * len(i := sets[a] & sets[b]) >= 75 * (len(sets[a]) + len(sets[b]) - len(i)):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {x.id: x.component_id for x in ngram_join.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {d: top(d) for d in sets} and 10 < len({top(d) for d in sets}) < 80
    assert dense and (rounds or sum(dense))  # links that only whole sets in one task gave


def test_components_ignore_loops_nulls_and_repeats(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, 9), (None, 4), (7, 8), (20, 8)], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 20: 7}
    assert components.components(e.where("a < 0")).count() == 0


def test_toxicity_and_quality_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for mod, col, least in ((toxicity, "toxic", 0.93), (cotrain, "quality", 0.93)):
        r = mod.score(d, lab).where("held_out").join(lab, "doc_id")
        assert r.agg(F.avg((F.col("predicted") == F.col(col)).cast("int"))).first()[0] > least


def test_co_training_scores_every_unlabelled_document(spark):
    sizes = ((0, "abc ab", "a"), (1, "xyz zy", "b"))
    rows = [(i, f"{sizes[i % 2][1]} {i}", "en", sizes[i % 2][2], 9) for i in range(60)]
    sure = [(i, " ".join([sizes[i % 2][1]] * 30) + f" {i}", "en", sizes[i % 2][2], 9) for i in range(100, 110)]
    d = spark.createDataFrame(rows + sure, DOC)
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, None) for i in range(100, 110)], "doc_id long, quality int")
    meta = cotrain._meta_columns(d, ("source",))
    _, handed = cotrain.co_train(d, lab, "doc_id", "text", "quality", meta, max_labelled=30)
    keys = {r.key: r.doc_id for r in d.select("doc_id", F.xxhash64("text").alias("key")).collect()}
    got = {keys[k]: label for k, label, _ in handed}
    held = {i for i in range(60) if binascii.crc32(str(i).encode()) % 5 == 0}
    assert got and all(label == i % 2 for i, label in got.items()) and not held & set(got)
    assert any(i >= 100 for i in got) and any(i < 60 for i in got)  # a NULL label, and a label beyond the bound


def test_main_text_is_the_article(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html_text.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        a = r.html[r.html.index("<article>") + 9:].split("</article>")[0]
        parts = [html_text.html.unescape(x).split() for x in re.split("<[^>]*>", re.sub("</?b>", "", a))]
        assert r.text == " ".join(" ".join(p) for p in parts if p) and r.n_chars == len(r.text)


def test_blocks_of_broken_html():
    page = "<p>a&amp;b <b>c\n d<script>'</p>'</script><p>e<br>f</div><!-- x <p>no"
    assert [t for _, t in html_text.blocks(page)] == ["a&b c d", "e", "f"]
    assert html_text.blocks("") == []


def test_base_rules(docs, texts):
    for r in line_rules.quality_report(docs).collect():
        t = texts[r.id]
        w = WORD.findall(t)
        times = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if times[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_frequent_lines_are_removed_per_host(spark):
    body = " ".join(f"x{i}" for i in range(60))
    long = " ".join(f"y{i}" for i in range(200))
    rows = [(i, f"{body} {chr(97 + i)}\nSame LINE 12", "en", "h", 0) for i in range(20)] + [(50, long, "en", "h", 0)]
    rows += [(60 + i, f"{body}\nz{i}", "en", "g", 0) for i in range(9)]
    d = spark.createDataFrame(rows, DOC)
    got = {r.id: r for r in line_rules.quality_report(d, min_docs=5, max_share=0.1).collect()}
    assert got[0].n_removed_words == 0 and got[1].n_removed_words == 3 and got[1].kept and got[50].kept
    assert got[60].kept and not got[61].kept  # the first holder keeps its line, the others are depleted
    kept = {r.doc_id: r.text for r in line_rules.clean(d, min_docs=5, max_share=0.1).collect()}
    assert kept[1] == f"{body} b" and 61 not in kept


def test_patience_alignment(spark):
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    block = "\n".join(" ".join(f"l{j}w{i}" for i in range(20)) for j in range(3))
    rows = [(1, f"start one\n{block}\nend", "en", "a", 0), (2, f"other\n{block}\nmore", "en", "a", 0), (3, block, "en", "a", 0),
            (4, "start one\nx", "en", "a", 0)]
    got = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(rows, DOC)).collect()}
    assert got[1].removed == [] and got[2].text == "other\nmore" and not got[3].kept and got[4].removed == []


def common_runs(a, b, words, least):
    """Brute force: places in ``b`` of runs that stand anywhere in ``a``."""
    gone = set()
    for j in range(len(b)):
        for i in range(len(a)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[j:j + n]) >= least:
                gone |= set(range(j, j + n))
    return gone


def test_repeated_and_swapped_passages_are_common_blocks():
    P, Q = [1, 2], [3, 4]
    cases = [([5, *P, 6, *P, 7], [8, *P, 9], [1, 2]), ([5, *P, 6], [7, *P, 8, *P, 9], [1, 2, 4, 5]),
             ([5, *P, 6, *Q, 7], [8, *Q, 9, *P, 10], [1, 2, 4, 5])]
    for a, b, gone in cases:
        assert line_dedup.common_blocks(a, b, [20] * len(b), 30) == gone
    r = random.Random(2)
    for kinds in (3, 8, 40) * 400:  # line 0 is blank
        a = [r.randrange(kinds) for _ in range(r.randrange(20))]
        b = [r.randrange(kinds) for _ in range(r.randrange(12))]
        for _ in range(r.randrange(4)):
            i, j = r.randrange(len(a) + 1), r.randrange(len(b) + 1)
            b[j:j] = a[i:i + r.randrange(1, 7)]
        words = [x * 7 % 20 for x in b]
        got = line_dedup.common_blocks(a, b, words, 30)
        want = common_runs(a, b, words, 30)
        assert set(got) <= want and {j for j in want if words[j]} <= set(got) and len(got) == len(set(got))


def test_blocks_whose_lines_have_different_first_holders(spark):
    line = [" ".join(f"p{j}w{i}" for i in range(20)) for j in range(3)]
    rows = [(j + 1, f"a{j}\n{line[j]}\nb{j}", "en", "a", 0) for j in range(3)]
    rows += [(i, "\n".join([f"c{i}", *line, f"d{i}"]), "en", "a", 0) for i in range(4, 9)]
    got = {r.doc_id: r.removed for r in line_dedup.report(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i] == [] for i in range(1, 5)) and all(got[i] == [1, 2, 3] for i in range(5, 9))


def test_every_common_block_goes_from_the_later_document(spark):
    r = random.Random(5)
    size = {x: r.randrange(1, 20) for x in range(1, 60)}
    seqs = []
    for _ in range(60):
        s = [r.randrange(1, 60) for _ in range(r.randrange(6))]
        for _ in range(r.randrange(4)):
            if seqs and (old := r.choice(seqs)):
                i, j = r.randrange(len(old)), r.randrange(len(s) + 1)
                s[j:j] = old[i:i + r.randrange(1, 6)]
        seqs.append(s)
    rows = [(i, "\n".join(" ".join(f"l{x}w{k}" for k in range(size[x])) for x in s), "en", "a", 0) for i, s in enumerate(seqs)]
    got = {x.doc_id: x.removed for x in line_dedup.report(spark.createDataFrame(rows, DOC)).collect()}
    for i, s in enumerate(seqs):
        words = [size[x] for x in s]
        assert set(got[i]) == set().union(*(common_runs(a, s, words, 30) for a in seqs[:i]))


def test_contained_items(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = set()
    for i, t in items.items():
        k = min(5, len(words(t)))
        s = shingles(t, k)
        for d, x in texts.items():
            w = words(x)
            both = len(s & {tuple(w[j:j + k]) for j in range(len(w) - k + 1)})
            if 100 * both >= 75 * len(s):
                want.add((d, i, both))
    got = decontaminate.contained(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()
    assert {(r["__llm_id"], r.item_id, r.n_shared) for r in got} == want and len(got) == len(want)


def test_short_items_are_found_whole(spark):
    d = spark.createDataFrame([(1, "x y the answer z", "en", "a", 0), (2, "answer the", "en", "a", 0)], DOC)
    items = spark.createDataFrame([(7, "The Answer"), (8, None), (9, "")], "item_id long, text string")
    assert [(r["__llm_id"], r.item_id) for r in decontaminate.contained(d, items).collect()] == [(1, 7)]
    assert [r.doc_id for r in decontaminate.clean(d, items).collect()] == [2]


def margins_of(p, tokens):
    return [(p * tokens).sum(axis=tuple(i for i in range(tokens.ndim) if i != axis)) for axis in range(tokens.ndim)]


def test_no_items_give_an_empty_result_of_the_same_schema(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    some, none = decontaminate.contained(docs, items), decontaminate.contained(docs, items.where("item_id < 0"))
    assert none.dtypes == some.dtypes and none.count() == 0
    assert decontaminate.clean(docs, items.where("item_id < 0")).count() == docs.count()


def test_learning_without_labels_or_of_one_class(spark, docs):
    schema = "doc_id long, quality int, toxic int"
    n = docs.count()
    for rows in ([], [(i, 1, 1) for i in range(40)], [(i, None, None) for i in range(40)]):
        lab = spark.createDataFrame(rows, schema)
        t, q = toxicity.score(docs, lab).collect(), cotrain.score(docs, lab).collect()
        assert len(t) == len(q) == n and all(0 <= r.score <= 1 for r in [*t, *q])


def test_the_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Every stage, with NULLs, empty and long texts and repeated rows; an empty
    table; each stage's rows are some of its input's, by columns of documents."""
    items = spark.createDataFrame([(0, "a b c d e"), (None, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    import corpus_pipeline
    body = " ".join(f"w{i}" for i in range(80))
    good = spark.createDataFrame([(100 + i, f"{body} {i}", "en", "a", 9) for i in range(4)], DOC)
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(good)
    for first in (plain, plain.where("doc_id < 0")):
        at = first
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            assert out.columns == plain.columns
            ids = [r.doc_id for r in out.collect()]
            assert len(ids) <= at.count() and set(ids) <= {r.doc_id for r in at.collect()}
            at = out
    kept = corpus_pipeline.near_duplicates(spark, good, "").collect()
    assert [r.doc_id for r in kept] == [100]


def test_raking_meets_the_targets():
    t = np.array([[80.0, 10], [5, 5]])
    p, eased = mixing.rake(t, [[0.5, 0.5], [0.5, 0.5]], fraction=0.2)
    assert eased == 0 and all(m == pytest.approx([10, 10], rel=1e-6) for m in margins_of(p, t))
    t = np.array([[90.0, 1], [8, 1]])  # the second row and column have too few
    p, eased = mixing.rake(t, [[0.5, 0.5], [0.5, 0.5]], fraction=0.5)
    rows, cols = margins_of(p, t)
    assert p.max() <= 1 and rows.sum() == pytest.approx(49.5 + 0.5) and rows == pytest.approx([41, 9], abs=0.01)
    assert cols == pytest.approx([48, 2], abs=0.01) and eased < 0.01


def test_targets_that_clash_are_eased():
    t = np.array([[100.0, 0], [0, 100]])  # rows and columns are the same tokens
    p, eased = mixing.rake(t, [[0.8, 0.2], [0.2, 0.8]], fraction=0.5)
    rows, cols = margins_of(p, t)
    assert 0.9 < eased <= 1 and rows == pytest.approx([50, 50], abs=1) and cols == pytest.approx(rows)
    assert mixing.rake(t * 0, [[1, 0], [1, 0]])[0].shape == (2, 2)
    assert (mixing.rake(t, [[0.8, 0.2], [0.2, 0.8]], fraction=1.0)[0] == 1).all()


def test_the_mixture_against_plain_loops(spark):
    """Brute force: cells counted and raked with loops, one probability a cell."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.report(d).collect()
    text = {r.doc_id: r for r in d.collect()}

    def topic(t):
        n = max(len(t), 1)
        if t.count("|") / n > 0.03:
            return "table"
        if sum(t.count(c) for c in "#*$%&") / n > 0.1:
            return "marked"
        return "shouted" if t.upper() == t != t.lower() else "note" if len(t) < 400 else "prose"

    cells = {}
    for r in got:
        x = text[r.doc_id]
        want = (x.source if x.source in mixing.TARGETS["source"] else "other", x.lang, topic(x.text or ""))
        assert (r.source_level, r.lang_level, r.topic_level) == want and r.n_tokens == len(WORD.findall(x.text or ""))
        c = cells.setdefault(want, [0, r.probability])
        c[0] += r.n_tokens
        assert c[1] == r.probability
    total = sum(n for n, _ in cells.values())
    assert sum(n * p for n, p in cells.values()) == pytest.approx(total / 2, rel=1e-6)
    weight = {c: 0.5 for c in cells}
    aims = []
    for axis, name in enumerate(mixing.TARGETS):
        own = {}
        for c, (n, _) in cells.items():
            own[c[axis]] = own.get(c[axis], 0) + n
        share = {k: mixing.TARGETS[name].get(k, max(0.0, 1 - sum(mixing.TARGETS[name].values()))) for k in own}
        aim = {k: 0 for k in own}
        free = set(own)
        while free:
            left = total / 2 - sum(aim[k] for k in own if k not in free)
            rate = left / sum(share[k] for k in free)
            full = {k for k in free if share[k] * rate > own[k]}
            aim |= {k: own[k] if k in full else share[k] * rate for k in free}
            free = free - full if full else set()
        aims.append(aim)
    for _ in range(400):
        for axis, aim in enumerate(aims):
            for k, w in aim.items():
                has = sum(min(weight[c], 1) * n for c, (n, _) in cells.items() if c[axis] == k)
                for c in cells:
                    if c[axis] == k and has > 0:
                        weight[c] *= w / has
    if got[0].eased == 0:
        assert all(p == pytest.approx(min(weight[c], 1), abs=1e-4) for c, (_, p) in cells.items())
    s = {(r.margin, r.level): r for r in mixing.shares(d).collect()}
    assert all(abs(r.expected - r.sampled) < 0.1 for r in s.values())
    kept = sum(r.n_tokens for r in got if r.sampled)
    assert abs(kept - total / 2) < 0.1 * total
    assert {r.doc_id for r in mixing.sample(d).collect()} == {r.doc_id for r in got if r.sampled}


def test_copies_within_one_owner_are_an_example(spark):
    key, two = "Ab1" * 10, "Cd2" * 10
    rows = [(i, f"x {key} {i}", "en", "same", 0) for i in range(12)] + [(50, f"y {two}", "en", "a", 0), (51, f"z {two}", "en", "b", 0)]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, DOC))).collect()}
    assert all(got[i].spans == "" for i in range(12)) and got[50].spans == "owned:2:32" and got[50].n_shared == 1


def test_training_pages_are_chosen_by_id(spark):
    rows = spark.createDataFrame([(i % 50 if i % 9 else None, f"<p>{i}") for i in range(400)], "page_id long, html string")
    got = html_text.training_pages(rows, 20).collect()
    assert len(got) == 20 and len({r.order for r in got}) == 20
    plan = html_text.training_pages(rows, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan[plan.index("GlobalLimit"):].split("LogicalRDD")[0]


def test_lines_of_small_hosts_are_removed():
    d = entry.queries()["op9_line_frequency"]
    from pyspark.sql import SparkSession
    r = d(SparkSession.getActiveSession(), "/root/testdata/sf0.01").agg(F.sum("n_removed_words").alias("n")).first()
    assert r.n > 0


def test_odd_inputs_have_a_result(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = odd.where("doc_id < 0")
    items = spark.createDataFrame([(0, "a b c d e"), (None, None)], "item_id long, text string")
    for df, rows in ((odd, n), (none, 0)):
        assert backoff_lm.score(df).count() == rows
        assert secrets.digest(secrets.scan(df)).count() == rows
        assert ngram_join.jaccard_classes(df).count() == rows
        assert line_rules.quality_report(df).count() == rows
        assert line_dedup.report(df).count() == rows
        assert toxicity.score(df, labels).count() == rows and cotrain.score(df, labels).count() == rows
        assert mixing.report(df).count() == rows
        assert html_text.main_text(df.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})).count() == rows
        for f in (line_rules.clean, line_dedup.clean, ngram_join.clean, mixing.sample):
            assert f(df).columns == odd.columns
        assert decontaminate.clean(df, items).columns == odd.columns
    near = {(r.doc_id, r.text) for r in ngram_join.clean(odd).collect()}
    assert (7, LONG) not in near and (1, LONG) in near and (2, None) in near
    assert ngram_join.clean(odd).where("doc_id = 4").count() == 1
    left = [r.doc_id for r in decontaminate.clean(odd, items).collect()]
    assert 4 not in left and {1, 2, 3, 5, 6, 7} <= set(left)


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline as p
    d = p.table(spark, SMALL, "documents")
    columns = d.columns
    for name, stage in p.STAGES:
        before, d = d, p.stored(stage(spark, d, SMALL), name)
        assert d.columns == columns and d.join(before, "doc_id", "left_anti").count() == 0
        assert d.where("n_chars <> length(text)").count() == 0
    assert sorted(r.doc_id for r in p.run(spark, SMALL).collect()) == sorted(r.doc_id for r in d.collect())
