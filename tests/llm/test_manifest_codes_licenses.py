"""Operators 11 to 13 against brute force and on odd inputs."""

import binascii
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scripts.check_oracle import digest
from tipscope.llm import license_rules, license_scan, merkle, oracles, registry, vector_codes

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, LONG, "en", "a", 1), (2, None, None, None, None), (None, "a b c", "en", "a", 2), (3, "", "en", "a", 0),
            (4, "é b", "de", "b", 3), (4, "é b", "de", "b", 3), (4, "c", "de", None, None), (5, " \t", "", "a", 2**63 - 1),
            (20, "all rights reserved", "é", "b", 1), (7, LONG, "en", "c", 9)]
    return spark.createDataFrame(rows, DOC).withColumns(
        {c: F.lit("clash") for c in ("g", "h", "p", "n", "b", "id", "path", "root", "label", "found", "v", "code")})


# ------------------------------------------------------------------ operator 11
def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(hashes, fanout):
    paths, own, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, o in enumerate(own):
            run, k = level[o - o % fanout:o - o % fanout + fanout], o % fanout
            paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            own[i] = o // fanout
        level = [sha("".join(level[j:j + fanout])) for j in range(0, len(level), fanout)]
    return level[0], paths


def brute_manifest(rows, fanout=2):
    def leaf(r, more=0):
        n = None if r.n_chars is None else r.n_chars + more
        values = [None if v is None else str(v) for v in (r.doc_id, r.source, r.lang, n, r.text)]
        return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        groups.setdefault((r.lang is not None, (r.lang or "").encode()), []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    subs = {g: tree([leaf(r) for r in groups[g]], fanout) for g in sorted(groups)}
    root, above = tree([s for s, _ in subs.values()], fanout)
    out = []
    for (g, (sub, paths)), up in zip(subs.items(), above):
        for r, path in zip(groups[g], paths):
            at = leaf(r, r.doc_id is not None and binascii.crc32(str(r.doc_id).encode()) % 7 == 0)
            for before, after in path + up:
                at = sha(before + at + after)
            out.append((r.doc_id, leaf(r), sub, root, sha("".join(a + b for a, b in path + up)), at, at == root))
    return sorted(out, key=str)


def test_manifest_is_the_tree(spark, odd):
    for d in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd, odd.where("doc_id = 1"), odd.where("lang is null")):
        assert sorted(map(tuple, merkle.report(d).collect()), key=str) == brute_manifest(d.collect())
    assert merkle.report(odd.where("doc_id < 0")).count() == 0
    got = {r.doc_id: r.verified for r in merkle.report(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    changed = [i for i in got if binascii.crc32(str(i).encode()) % 7 == 0]
    assert changed and all(got[i] != (i in changed) for i in got)


@pytest.mark.parametrize("fanout,height,rows", [(3, 2, 1), (3, 2, 9), (3, 2, 10), (3, 1, 28), (4, 2, 70), (2, 3, 65)])
def test_other_fanouts(spark, fanout, height, rows):
    d = spark.createDataFrame([(i, f"t{i}", "x" if i else None, "s", i) for i in range(rows)], DOC)
    m = merkle.manifest(d, fanout=fanout, height=height)
    got = sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded) for r in m.withColumns(
        {"proof": merkle.proof_digest(F.col("path")), "folded": merkle.fold(F.col("path"), F.col("leaf"))}).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in brute_manifest(d.collect(), fanout)]
    assert all(g[5] == g[3] for g in got)


def test_a_repeated_row_in_most_rows_is_spread(spark):
    d = spark.createDataFrame([(7, "same", "en", "s", 4)] * 90 + [(i, "x", "en", "s", 1) for i in range(30)], DOC)
    r = merkle.numbered(d.repartition(4).select(F.lit("").alias("g"), F.col("doc_id").alias("id")), ["id"])
    got = sorted((x.p, x.id, x.n) for x in r.collect())
    assert [x[0] for x in got] == list(range(120)) and [x[1] for x in got] == sorted(x[1] for x in got) and got[0][2] == 120


# ------------------------------------------------------------------ operator 12
def brute_codes(rows):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])),
                  key=lambda r: r[0])
    ints = [[math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in r[1]] for r in kept]
    m = len(ints[0]) // 16
    cut = [[tuple(v[p * m:(p + 1) * m]) for p in range(16)] for v in ints]
    books = [[c[p] for c in cut[:64]] for p in range(16)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            of = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                if own := [c[p] for c, o in zip(cut, of) if o == e]:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    final = [[near(c[p], books[p]) for p in range(16)] for c in cut]
    said = sha(",".join(str(v) for b in books for e in b for v in e))
    errors = [sum(d for d, _ in f) for f in final]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{i:02x}" for _, i in f), e, labels[r[2]], said) for r, f, e in zip(kept, final, errors))


def test_codes_are_the_nearest_entries(spark):
    d = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert sorted(map(tuple, vector_codes.report(d).collect())) == brute_codes([tuple(r) for r in d.collect()])


def test_codes_of_odd_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, -0.01, 0.5, 1.0]) for _ in range(48)], i % 3 or None) for i in range(150)]  # many ties
    bad = [(900, None, 1), (901, [None] * 48, 1), (902, [float("nan")] * 48, 1), (903, [float("-inf")] * 48, None)]
    schema = "vec_id long, embedding array<double>, label int"
    d = spark.createDataFrame(rows + bad, schema).withColumns({c: F.lit("clash") for c in ("id", "v", "code", "part")})
    assert sorted(map(tuple, vector_codes.report(d).collect())) == brute_codes(rows)
    huge = [(i, [r.uniform(-1, 1) * 10.0 ** r.randrange(7) for _ in range(32)], 1) for i in range(90)]
    assert sorted(map(tuple, vector_codes.report(spark.createDataFrame(huge, schema)).collect())) == brute_codes(huge)
    over = spark.createDataFrame([(i, [(-1) ** i * 1e300 / (i + 1)] * 16, 1) for i in range(70)], schema)
    assert vector_codes.report(over).where("error is null").count() > 0  # beyond a long
    few = spark.createDataFrame([(2, [1.0, 2.0], 1), (None, [0.5], None), (2, [1.0, 2.0], 1), (3, [], 1)], schema)
    got = {(x.vec_id, x.code[:2], x.error) for x in vector_codes.report(few).collect()}
    assert len(got) == 3 and {(2, "00"), (3, "01")} <= {g[:2] for g in got}  # rows that are equal get equal codes
    assert vector_codes.report(few.where("vec_id < 0")).count() == 0


def test_transform_keeps_scaled_distances_and_elimination_is_exact():
    r = np.random.default_rng(4)
    for m in (1, 3, 4, 8, 48):
        x, c = r.integers(-40, 40, (200, m)), r.integers(-40, 40, (30, m))
        x[:30] = c[r.permutation(30)]
        c[7] = c[3]
        t, u = vector_codes.spectrum(x), vector_codes.spectrum(c)
        want = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (((t[:, None] - u[None]) ** 2).sum(2) == t.shape[1] * want).all()
        for kind in (np.int64, object):
            at, scaled = vector_codes.nearest(t.astype(kind), u.astype(kind))
            assert (at == want.argmin(1)).all() and (scaled == t.shape[1] * want.min(1)).all()
    h = vector_codes.transform(np.eye(16, dtype=np.int64))[:, vector_codes.sequency(16)]
    assert ((h[1:] != h[:-1]).sum(0) == np.arange(16)).all()


# ------------------------------------------------------------------ operator 13
def test_base_phrases_and_words(spark, odd):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    extra = spark.createDataFrame([(50, "CC-BY cc by, All Rights\nReserved! the GENERAL PUBLIC (License)é cc by", "en", "a", 1)], DOC)
    for d in (spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"),
              odd.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))):
        got = license_scan.report(d).collect()
        texts = [r.text for r in d.collect()]
        assert len(got) == len(texts)
        want = []
        for r in d.collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(fold))
            at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split()]
            want.append((r.doc_id, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
                         ",".join(sorted({x for _, x in at}))))
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
        assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got if r.base_labels)
        assert all(r.labels == "" and r.score == 0 for r in got if not r.n_words)
    assert license_scan.report(odd.where("doc_id < 0")).count() == 0


def test_every_rule_compiles_and_is_gated_by_words_it_needs():
    rules = license_rules.rules()
    assert len(rules) > 300 and len({r[3] for r in rules if r[0] == "text"}) > 60
    order = list(license_rules.CLASSES)
    assert [order.index(r[0]) for r in rules] == sorted(order.index(r[0]) for r in rules)
    for _, _, keywords, pattern in rules:
        assert re.compile(pattern.encode()) and keywords


def test_gate_and_thinning_against_all_rules_and_all_pairs(spark):
    """Brute force: every rule on every text, spans compared in pairs."""
    rules, order = license_rules.rules(), list(license_rules.CLASSES)
    tests = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    tests += ["Licensed under CC BY-NC-SA 4.0 and CC-BY, see https://creativecommons.org/licenses/by-nc-sa/4.0/. All rights reserved.",
              "SPDX-License-Identifier: LGPL-2.1-or-later. Licensed under the GNU Lesser General Public License v2.1, released under the MIT license",
              "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,"
              " or (at your option) any later version; redistribute it. GPL version 3 or later, gplv3"]
    scanner = license_scan.Scanner()
    hits = 0
    for t in tests:
        form = b" " + b" ".join(t.encode().translate(license_scan.NORMAL).split()) + b" "
        words = set(form.split())
        spans = [(m.start(), m.end(), order.index(kind), i) for i, (kind, _, keys, pattern) in enumerate(rules)
                 if all(k.encode() in words for k in keys) for m in re.finditer(rf" (?:{pattern})(?= )".encode(), form)]
        left = [s for s in spans if not any(
            o != s and o[0] <= s[0] and s[1] <= o[1] and o[2] <= s[2]
            and ((o[2], o[0] - o[1], o[3]) < (s[2], s[0] - s[1], s[3])) for o in spans)]
        found = scanner.scan(t)[5]
        assert [(f["label"], f["class"]) for f in found] == [(rules[s[3]][1], order[s[2]]) for s in sorted(left, key=lambda s: (s[0], -s[1], s[2], s[3]))]
        hits += len(found)
    assert hits > 50
    labels = {f["label"] for f in scanner.scan(tests[-3])[5]}
    assert labels == {"cc-by-nc-sa-4.0", "cc-by", "reserved"}
    assert {f["label"] for f in scanner.scan(tests[-2])[5]} == {"lgpl-2.1-or-later", "lgpl-2.1", "lgpl", "mit"} - {"lgpl-2.1"}
    assert "gpl-2.0-or-later" in {f["label"] for f in scanner.scan(tests[-1])[5]}


# ------------------------------------------------------------------ SQL
@pytest.mark.parametrize("name", ["op11_slot_pivot", "op12_hadamard_codes"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = registry.queries()[name](spark, SMALL)
    res = con.execute(oracles.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]
