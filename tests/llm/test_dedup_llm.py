"""Operators 1, 3, 4 and 10 against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bloom, near_dedup, queries
from tessera.llm.bloom import build_filter, may_hold
from tessera.llm.components import connected_components
from tessera.llm.embedding_dedup import Codebooks, near_embeddings, unit_vectors
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.line_dedup import _LINES, _sequence, dedup_lines, later_copies, shortest_runs, suffix_array
from tessera.llm.near_dedup import bag_minhash, multiset, near_duplicates, shingles, similarity


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=15).filter(lambda w: sum(a for a, _ in w) and sum(b for _, b in w)))
def test_signatures_estimate_weighted_jaccard(weights):
    keys = near_dedup.mix(np.arange(1, len(weights) + 1, dtype=np.uint64))
    a, b = (np.repeat(keys, [w[k] for w in weights]) for k in (0, 1))
    true = sum(min(w) for w in weights) / sum(max(w) for w in weights)
    assert similarity(multiset(a), multiset(b)) == pytest.approx(true)
    assert np.mean(bag_minhash(a, 1500) == bag_minhash(b, 1500)) == pytest.approx(true, abs=0.08)


def test_signature_of_large_weights_and_nothing():
    key = np.array([7], np.uint64)
    a, b = bag_minhash(np.repeat(key, 100), 2000), bag_minhash(np.repeat(key, 130), 2000)
    assert np.mean(a == b) == pytest.approx(100 / 130, abs=0.05)
    assert not np.isfinite(bag_minhash(key[:0], 4)).any()
    assert len(shingles("")[1]) == len(shingles(None)[1]) == 0 and len(shingles("One two")[1]) == 1


def corpus():
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    rows, base = [], words(300)
    for k in range(60):  # a family of edited copies, some too far from each other
        text = list(base)
        for _ in range(rnd.randrange(14)):
            text[rnd.randrange(300)] = f"n{rnd.randrange(10**6)}"
        rows.append((1000 + k, " ".join(text)))
    rows += [(2000 + k, " ".join(words(80))) for k in range(40)]
    rows += [(3000 + k, rows[70][1].upper() + "!") for k in range(5)] + [(4000, ""), (4001, ""), (4002, None), (4003, "two words"), (4004, "Two, words"), (None, rows[0][1]), (2001, rows[61][1]), (5000, "again " * 200), (5001, "again " * 190), (5002, "again " * 100)]
    return rows


@pytest.mark.parametrize("block", [7, 1024])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    bags = [(d, multiset(h)) for d, t in rows if d is not None and len(h := shingles(t)[1])]
    sets = Sets()
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            if similarity(x, y) >= 0.8:
                sets.join(a, b)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, component string, rep string").repartition(5)
    out = near_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (sets.find(r.doc_id), sets.find(r.doc_id) == r.doc_id))
    assert {r.component_id for r in out if r.doc_id in (4000, 4001, 4002)} == {4000, 4001, 4002}
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_each_text_of_an_id(spark):
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(12):
        a, b = words(120), words(120)
        # 100 k + 5 has two texts, each with a near copy of another id; 50 k + 20,000 has one that a smaller id has too
        rows += [(100 * k + 5, " ".join(a)), (100 * k + 5, " ".join(b)), (100 * k + 8, " ".join([*a, "more"])), (100 * k + 9, " ".join([*b, "more"]))]
        c, d = words(120), words(120)
        rows += [(50 * k + 20_000, " ".join(c)), (50 * k + 20_001, " ".join(c)), (50 * k + 20_001, " ".join(d)), (50 * k + 20_002, " ".join([*d, "more"]))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        first = r.doc_id // 100 * 100 + 5 if r.doc_id < 20_000 else r.doc_id // 50 * 50
        assert (r.component_id, r.kept) == (first, first == r.doc_id)


def test_near_duplicates_of_very_long_texts(spark):
    rnd = random.Random(7)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:190_000], "end"])), (3, " ".join(long[:100_000])), (4, "x " * 300_000), (5, "x " * 299_000)]
    out = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


@pytest.mark.parametrize("block", [5, 1024])
def test_near_misses_meet_by_bucket(spark, monkeypatch, block):
    """One family of texts that are half alike, with a few pairs that are similar, against SQL."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(11)
    common = [f"c{k}" for k in range(100)]
    rows = [(k, " ".join(common + [f"x{rnd.randrange(10**6)}" for _ in range(60)])) for k in range(80)]
    rows += [(100 + k, rows[3 * k][1] + " more words") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    got = {tuple(r) for r in near_duplicates(df).collect()}
    assert got == set(con.sql(queries.oracle_sql()["op1_near_dedup"]).fetchall()) and sum(not r[2] for r in got) == 12


def test_components(spark):
    rnd, sets = random.Random(1), Sets()
    edges = [(k, k + 1) for k in range(0, 60)] + [(rnd.randrange(100, 300), rnd.randrange(100, 300)) for _ in range(110)] + [(900, 900), (500, 501), (501, 500)] + [(400, 401 + k) for k in range(50)]
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 12))
    rows = [(k, (base[k % 40] + rng.normal(size=12) * rng.choice([0, 0.03, 0.1, 0.3])).tolist(), k % 3) for k in range(400)]
    rows += [(1000 + k, base[0].tolist(), 0) for k in range(30)] + [(2000, (base[0] * 1e200).tolist(), 0), (2001, (base[0] * 1e-200).tolist(), 0)]
    odd = [(3000, None, 0), (3001, [0.0] * 12, 0), (3002, [float("nan")] * 12, 0), (3003, [float("inf"), *[0.0] * 11], 0), (3004, [None, *[1.0] * 11], 0), (3005, base[0].tolist(), None), (3006, [], 0), (3007, [1.0, 2.0], 0), (3008, [2.0, 4.0], 0), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame([(*r, "z") for r in rows + odd], "vec_id long, embedding array<double>, label int, size string")
    valid, sets, links = [*rows, *odd[7:9]], Sets(), {}
    unit = {r[0]: unit_vectors(np.array([r[1]]))[0] for r in valid}
    for i, (a, _, la) in enumerate(valid):
        for b, _, lb in valid[:i]:
            if la == lb and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                sets.join(a, b)
    out = near_embeddings(df).collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        expected = (None, 0, None, True) if r.vec_id is None else (r.vec_id, links.get(r.vec_id, 0), sets.find(r.vec_id), sets.find(r.vec_id) == r.vec_id)
        assert tuple(r) == expected
    assert near_embeddings(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows + odd if r[0] != 2000], "embedding": pa.array([r[1] for r in rows + odd if r[0] != 2000], pa.list_(pa.float64())), "label": [r[2] for r in rows + odd if r[0] != 2000]}))
    sql = {tuple(r) for r in con.sql(queries.oracle_sql()["op3_embedding_dedup"]).fetchall()}
    near = near_embeddings(df.where("vec_id IS NULL OR vec_id <> 2000")).collect()
    assert {tuple(r) for r in near if r.vec_id != 2001 and r.component_id != 0} == {r for r in sql if r[0] != 2001 and r[2] != 0}


def test_near_embeddings_of_repeated_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(8, 6))
    rows = [(int(rng.integers(0, 40)), (base[rng.integers(8)] + rng.normal(size=6) * rng.choice([0, 0.05, 0.4])).tolist(), int(rng.integers(0, 2))) for _ in range(150)]
    e = np.eye(6)
    # The id 500 has two vectors, each with its own neighbours.
    rows += [(500, e[0].tolist(), 5), (500, e[1].tolist(), 5), (501, e[0].tolist(), 5), (502, (e[1] + 0.01 * e[2]).tolist(), 5), (503, (e[1] - 0.01 * e[2]).tolist(), 5), (500, e[0].tolist(), 5), (502, None, 5), (503, e[1].tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": [r[2] for r in rows]}))
    got = sorted(tuple(r) for r in near_embeddings(df).collect())
    assert got == sorted(con.sql(queries.oracle_sql()["op3_embedding_dedup"]).fetchall())
    assert sorted(r[1] for r in got if r[0] == 500) == [2, 2, 2] and sorted(r[1] for r in got if r[0] > 501) == [0, 0, 2, 2] and {r[2] for r in got if r[0] >= 500} == {500}


def test_probes_lose_no_neighbour():
    rng = np.random.default_rng(6)
    x = unit_vectors(rng.normal(size=(2000, 16)))
    y = unit_vectors(x + rng.normal(size=x.shape) * 0.03)
    book = Codebooks.fit(x, 40)
    (a, codes, error), (b, _, _) = book.encode(x), book.encode(y)
    close = np.einsum("ij,ij->i", x, y) >= 0.98
    for k, probes in enumerate(book.probes(x, a, np.sqrt(0.04))):
        assert not close[k] or b[k] in probes or b[k] < a[k]
    approx = book.lookup(y[:50], int(a[0]), codes[a == a[0]])
    exact = y[:50] @ x[a == a[0]].T
    assert (np.abs(approx - exact) <= error[a == a[0]][None, :] + 1e-9).all()


def brute_lines(rows, least):
    """What stays of each text if runs are compared one by one."""
    order = sorted(rows, key=lambda r: r[0])
    seqs = [[(k, " ".join(w)) for k, line in enumerate(t.split("\n")) if (w := line.split())] for _, t in order]
    wins, first = [], {}
    for d, seq in enumerate(seqs):
        ahead, behind = shortest_runs([len(x.split()) for _, x in seq], least)
        runs = {(p, n) for p, n in enumerate(ahead) if n} | {(p - n + 1, n) for p, n in enumerate(behind) if n}
        for p, n in runs:
            key = tuple(x for _, x in seq[p : p + n])
            first[key] = min(first.get(key, (d, p)), (d, p))
            wins.append((d, p, n, key))
    gone = [set() for _ in seqs]
    for d, p, n, key in wins:
        o = first[key]
        begin = max(p, o[1] + n) if o[0] == d else p
        if o != (d, p) and begin < p + n:
            gone[d] |= set(range(seqs[d][begin][0], seqs[d][p + n - 1][0] + 1))
    return {order[d][0]: "\n".join(x for k, x in enumerate(order[d][1].split("\n")) if k not in gone[d]) for d in range(len(order))}


@pytest.mark.parametrize("least", [1, 6, 15])
def test_line_dedup(spark, least):
    rnd = random.Random(least)
    lines = ["a", "b c", "", " ", "d e f", "g h i j", "k", "l  m", "n o p q r s"]
    rows = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(16)))) for k in range(70)] + [(90, "same line\n" * 30), (91, "")]
    df = spark.createDataFrame([(d, t, "u", 3) for d, t in rows], "doc_id long, text string, row string, h int").repartition(3)
    out = dedup_lines(df, least).select("row.*", "n_deleted").collect()
    assert {r.doc_id: r.text for r in out} == brute_lines(rows, least)
    assert {(r.row, r.h) for r in out} == {("u", 3)}


def repeated_lines(spark, texts):
    df = spark.createDataFrame([(d, 0, t) for d, t in enumerate(texts)], "d long, h long, text string").repartition(4)
    lines = df.mapInArrow(_sequence(1), _LINES)
    return lines.join(lines.groupBy("id").count().where("count > 1").drop("count"), "id").repartition(5).cache()


@pytest.mark.parametrize("depth", [None, 5, 8])
def test_suffix_array(spark, depth):
    rnd = random.Random(3)
    stretch = [f"s {k}" for k in range(40)]
    texts = ["\n".join(rnd.choice(["a", "b", "c", f"only {d} {k}"]) for k in range(rnd.randrange(12))) for d in range(40)] + ["\n".join(stretch[a:]) for a in (0, 0, 7, 20)] + ["x\n" * 25, "x\n" * 9]
    lines = repeated_lines(spark, texts)
    rows = {(r.d, r.pos): bytes(r.id) for r in lines.collect()}
    suffixes = {}
    for d, pos in rows:
        ids, p = [], pos
        while (d, p) in rows and (depth is None or len(ids) < 8):  # rounds of 1, 2, 4 and 8 lines
            ids.append(rows[d, p])
            p += 1
        suffixes[d, pos] = [(1, i) for i in ids] + ([] if (d, p) in rows or (depth and len(ids) == 8) else [(0, d, p)])  # the stretch ends with its own mark

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    ordered = sorted(suffixes, key=lambda s: suffixes[s])
    place = {}
    for k, s in enumerate(ordered):
        place[s] = place[ordered[k - 1]] if k and suffixes[s] == suffixes[ordered[k - 1]] else k
    ranks, bounds = suffix_array(lines, len(rows), depth)
    got = {(r.d, r.pos): r.r for r in ranks.collect()}
    assert got == place and (depth or sorted(got.values()) == list(range(len(got))))
    assert {r.r: r.lcp for r in bounds.collect()} == {k: common(suffixes[ordered[k - 1]], suffixes[s]) if k else 0 for k, s in enumerate(ordered) if place[s] == k}
    assert bounds.count() == len(set(place.values()))


def test_line_dedup_against_sql(spark):
    rnd = random.Random(12)
    pool = [f"p{k} " * rnd.randrange(1, 60) for k in range(60)]
    rows = [(k, "\n".join(pool[(a + j) % 60] if rnd.random() < 0.9 else f" own {k} {j}" for a in [rnd.randrange(60)] for j in range(rnd.randrange(30)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n".join(["word " * 3] * 400)), (203, "q " * 200_000), (204, "q " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    got = sorted((r.row.doc_id, r.n_deleted, r.row.text) for r in dedup_lines(df).collect() if r.row.text is not None)
    assert got == sorted(r for r in con.sql(queries.oracle_sql()["op4_line_dedup"]).fetchall() if r[2] is not None)
    assert sum(n for _, n, _ in got) > 500


def test_line_dedup_edges(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (1, f"x\n{long}\ny"), (2, None), (2, None), (3, long), (3, long), (4, f"{long}\n" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.row.doc_id, r.row.text, r.n_deleted) for r in dedup_lines(df).collect()), key=str)
    assert out == sorted([(None, long, 0), (1, "x\ny", 1), (2, None, 0), (2, None, 0), (3, "", 1), (3, "", 1), (4, "", 3)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0 and later_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1 << 28, 1 << 13])
def test_exact_duplicates(spark, monkeypatch, bits):
    monkeypatch.setattr(bloom, "MOST_BITS", bits)
    rows = [(k, t) for k, t in enumerate(["A b", "a B", "ä", "Ä", "", None, "x", "a b "])] + [(100 + k, "Hot") for k in range(1500)] + [(None, "ä"), (None, "only"), (7, "a b "), (7, "a b ")]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, h string").repartition(4)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out = exact_duplicates(df).collect()
    assert len(out) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in out:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (max(known, default=None), len(ids))
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert sum(r.shuffled for r in out) < sum(len(i) for i in groups.values() if len(i) > 1) + 50
    assert exact_duplicates(df.limit(0)).count() == 0


def test_filter_holds_all(spark):
    df = spark.range(5000).selectExpr("xxhash64(id % 4000) AS h")
    h = np.array([r.h for r in df.collect()])
    assert may_hold(h, build_filter(df, 5000, 1)).all()
    twice = may_hold(h, build_filter(df, 5000, 2))
    assert twice[:1000].all() and twice[4000:].all() and twice[1000:4000].mean() < 0.1
