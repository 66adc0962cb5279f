"""Exact, n-gram and embedding near-dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_words import words
from pyspark.sql import functions as F

from chunkloom.llm import embedding_dedup, exact_dedup, ngram_join

FOLD = {i: i + 32 for i in range(65, 91)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()].append(i)
    out = []
    for sha, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def near(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent, seen = {i: i for i, _ in sets}, collections.defaultdict(list)
    for at, (i, s) in enumerate(sets):
        for k, both in collections.Counter(k for x in s for k in seen[x]).items():
            if 100 * both >= 75 * (len(s) + len(sets[k][1]) - both):
                a, b = find(parent, i), find(parent, sets[k][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            seen[x].append(at)
    return sorted((i, len(s), find(parent, i)) for i, s in sets)


def test_exact_digests(spark, store, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, exact_dedup.digests(odd, store).collect()), key=str)
    assert got == exact(rows)
    # a filter far too small only lets more rows shuffle
    assert sorted(map(tuple, exact_dedup.digests(odd, store, bits=64).collect()), key=str) == exact(rows)
    assert exact_dedup.digests(odd.limit(0), store).count() == 0


@pytest.mark.parametrize("most", [exact_dedup.MOST_BROADCAST, 0])
def test_exact_rows_that_stay(spark, store, odd, monkeypatch, most):
    """With the filter broadcast, and met by a shuffle."""
    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", most)
    assert sorted(map(tuple, exact_dedup.digests(odd, store).collect()), key=str) == exact([(r.doc_id, r.text) for r in odd.collect()])
    out = exact_dedup.unique(odd, store)
    assert out.columns == odd.columns
    texts = [(r.text or "").translate(FOLD) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(FOLD) for r in odd.collect()})
    kept = {(r.text or "").translate(FOLD): r.doc_id for r in out.collect()}
    assert kept["a b"] == 6 and kept[" "] == 2


def test_exact_filter_passes_most_unrepeated_rows(spark, store):
    """Rows of repeated texts are all marked; of the others about one in 1 / BITS is."""
    table = spark.range(200_000).selectExpr("id", "xxhash64(if(id < 1000, 'same', cast(id as string))) as hash")
    words, bits = exact_dedup.filtered(table, store)
    found = exact_dedup.probed(table, words, bits).groupBy(F.expr("id < 1000").alias("repeated")).agg(F.avg(F.col("__again").cast("int")).alias("share")).collect()
    share = {r.repeated: r.share for r in found}
    assert share[True] == 1 and share[False] < 2 / exact_dedup.BITS


def test_exact_very_long_texts(spark, store):
    rows = [(1, "Ab " * 700_000), (2, "aB " * 700_000), (3, "ab " * 700_000 + "."), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.digests(df, store).collect())) == exact(rows)
    assert sorted(r.doc_id for r in exact_dedup.unique(df, store).select("doc_id").collect()) == [2, 3, 4]


def test_exact_hot_group(spark, store):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) as text")
    out = {r.doc_id: r for r in exact_dedup.digests(df, store).collect()}
    assert out[0].group_size == 1000 and out[0].keep_id == 2997 and sum(r.kept for r in out.values()) == 2001


def corpus(seed):
    rng, rows = random.Random(seed), []
    for n in [3, 5, 6, 9, 14, 40, 60, 66, 90, 127, 129, 300, 700]:
        for _ in range(3):
            base = words(rng, n)
            for _ in range(rng.choice([1, 2, 5, 9])):
                x = list(base)
                for _ in range(int(n * rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.1]))):
                    at, how = rng.randrange(len(x)), rng.random()
                    if how < 0.5:
                        x[at] = "new" + str(rng.random())
                    elif how < 0.8:
                        x.insert(at, "more")
                    elif len(x) > 1:
                        del x[at]
                rows.append(" ".join(x))
    passage = words(rng, 60)  # many documents share it, few link
    rows += [" ".join(words(rng, rng.randint(0, 40)) + passage + words(rng, rng.randint(0, 10))) for _ in range(120)]
    rng.shuffle(rows)
    return list(enumerate([*rows, None, "", " \n", "A b", "a B ", "a b c"]))


def test_ngram_join_equals_brute_force(spark, store):
    for seed, parts in ((1, 1), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(map(tuple, ngram_join.joined(df, store).collect())) == near(rows)


def test_ngram_join_with_rare_paths(spark, store, monkeypatch):
    """Slices, buckets and cells are small, nothing is broadcast, no pair is met by a star; then classes are crowded."""
    for name, value in (("CELL", 3), ("SLICE_CHARS", 3000), ("SLICE_ROWS", 7), ("BUCKET_BYTES", 5000), ("MOST_BROADCAST", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.joined(df, store).collect())) == near(rows)
    monkeypatch.setattr(ngram_join, "_within", lambda pairs, units: pairs.select("x", "y").where("false"))
    assert sorted(map(tuple, ngram_join.joined(df, store).collect())) == near(rows)
    monkeypatch.undo()
    monkeypatch.setattr(ngram_join, "PER_WORD", 8)
    assert sorted(map(tuple, ngram_join.joined(df, store).collect())) == near(rows)


@pytest.mark.parametrize("split", [False, True])
def test_ngram_join_cells_give_fewer_pairs_than_documents(split):
    """Of a group whose documents nearly all link; and with whole sets, of one where about half of the pairs do."""
    rng = np.random.default_rng(4)
    for swaps, whole in ((4, False), (10, True)):
        base = np.unique(rng.integers(0, 2**64 - 1, 150, dtype=np.uint64))
        sets = [np.unique(np.append(rng.permutation(base)[rng.integers(0, 2 * swaps) :], rng.integers(0, 2**64 - 1, swaps, dtype=np.uint64))) for _ in range(90)]
        second = [split and i >= 40 for i in range(90)]
        data = pa.array([s.tobytes() for s in sets], pa.binary()) if whole else pa.array([ngram_join.parities(s, 256).view(np.int64).tolist() for s in sets])
        cols = {"key": [5] * 90, "i": [0] * 90, "j": [int(split)] * 90, "second": second, "code": range(90), "n": map(len, sets), "c": range(90), "guest": [False] * 90}
        batch = pa.RecordBatch.from_arrays([*(pa.array(list(v)) for v in cols.values()), data], [*cols, "data"])
        got = [tuple(p) for b in ngram_join._cells(iter([batch]), *[True] * whole) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        pairs = [(x, y) for y in range(90) for x in range(y) if not split or second[x] != second[y]]
        links = [(x, y) for x, y in pairs if ngram_join._alike(sets[x], sets[y])]
        assert len(links) > 20 * 90 if not whole else 90 < len(links) < 0.8 * len(pairs)
        assert len(got) < 90 and (not whole or set(got) <= set(links))
        joined, wanted = ({i: i for i in range(90)} for _ in range(2))
        for parent, edges in ((joined, got), (wanted, links)):
            for x, y in edges:
                a, b = find(parent, x), find(parent, y)
                parent[max(a, b)] = min(a, b)
        # candidates join what links join, at least
        assert all(find(joined, x) == find(joined, y) for x, y in links)
        assert not whole or [find(joined, i) for i in range(90)] == [find(wanted, i) for i in range(90)]


def test_ngram_join_hot_group_without_stars(spark, store, monkeypatch):
    """Many near copies of one text about the threshold, and pairs, in clusters of several blocks."""
    rng, rows = random.Random(8), []
    base = words(rng, 150)
    for _ in range(120):
        x = list(base)
        for at in rng.sample(range(150), rng.randint(1, 5)):
            x[at] = "new" + str(rng.random())
        rows.append(" ".join(x))
    for _ in range(20):
        x = words(rng, 60)
        rows += [" ".join(x), " ".join([*x[:-1], "new"])]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "_within", lambda pairs, units: pairs.select("x", "y").where("false"))
    for cell, size in ((16, 16 << 20), (1024, 20_000)):
        monkeypatch.setattr(ngram_join, "CELL", cell)
        monkeypatch.setattr(ngram_join, "CELL_BYTES", size)
        assert sorted(map(tuple, ngram_join.joined(df, store).collect())) == near(rows)


def test_ngram_join_odd_rows(spark, store, odd):
    got = ngram_join.joined(odd, store).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == 0 and by[5].component_id == 5 and by[6].component_id == 5
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    out = ngram_join.unique(odd, store)
    assert out.columns == odd.columns and out.where("doc_id = 6").count() == 0 and out.where("doc_id is null").count() == 2
    assert ngram_join.joined(odd.limit(0), store).count() == 0


def test_ngram_join_repeated_ids_with_other_texts(spark, store):
    """An id whose one text equals another document's and whose other text links elsewhere has both links."""
    rng = random.Random(6)
    a, b, c = (words(rng, 20) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, [*b[:-1], "new"]), (2, b[::-1]), (8, a[::-1]), (8, b[::-1]), (8, c), (9, [*c[:-1], "new"]), (3, c[::-1])]
    rows = [(i, " ".join(t)) for i, t in rows]
    many = [(i if rng.random() > 0.03 else rng.randrange(200), t) for i, t in corpus(7)]
    for some in (rows, rows[::-1], many):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, ngram_join.joined(df, store).collect())) == near(some)
    got = {r.doc_id: r.component_id for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), store).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 2: 2, 8: 2, 9: 2, 3: 3}


def test_bound_of_sketches():
    """Sets that link share all of their words but the bound, and their bits differ within it."""
    rng = np.random.default_rng(0)
    for n in (5, 20, 64, 65, 100, 128, 129, 400):
        a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        for _ in range(20):
            drop = int(rng.integers(0, n // 8 + 1))
            b = np.unique(np.append(rng.permutation(a)[drop:], rng.integers(0, 2**64 - 1, drop, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                keys, unit, doc, many, _, top = ngram_join.keys(np.concatenate([a, b]), np.array([len(a), len(b)]))
                common = np.intersect1d(keys[doc[unit] == 0], keys[doc[unit] == 1])
                assert len(common) >= many.min() - (len(a) + len(b)) // 7 > 0
                p, q = (ngram_join.parities(x, int(top.max())) for x in (a, b))
                assert np.bitwise_count(p ^ q).sum() <= len(a) + len(b) - 2 * both <= (len(a) + len(b)) // 7


def cosine_links(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v]
    ok = [(i, v) for i, v in ok if len(v) and np.isfinite(v).all() and v.any()]
    n, parent = collections.Counter(), {i: i for i, _ in rows}
    for k, (i, v) in enumerate(ok):
        for j, w in ok[:k]:
            if len(v) == len(w) and i != j and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                n[i] += 1
                n[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: (n[i], find(parent, i)) for i, _ in rows}


def vectors(seed, spreads):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(25):
        base = rng.standard_normal(24)
        for _ in range(12):
            rows.append((len(rows), [float(x) for x in base + rng.standard_normal(24) * rng.choice(spreads)]))
    return rows


def test_embeddings_recall_and_no_false_link(spark, store, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # buckets are split
    rows = vectors(1, [0.05, 0.2, 0.3])
    got = {r.vec_id: r for r in embedding_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), store).collect()}
    want = cosine_links(rows)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values()) > 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_hot_group_is_exact(spark, store, monkeypatch):
    """Close vectors meet in some table almost surely: all links of a group larger than a block."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rows = vectors(2, [0.02])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), store).collect()}
    assert got == cosine_links(rows)


def test_embeddings_equal_vectors_are_one_node(spark, store):
    """However many rows hold one vector, cells have it once; links count its rows."""
    rows = vectors(3, [0.02])
    many = [*rows, *((1000 + i, rows[5][1]) for i in range(2000))]
    df = spark.createDataFrame(many, "vec_id long, embedding array<float>").repartition(4)
    units = embedding_dedup.nodes(df, store, 0.9, 0.98, 7, "vec_id", "embedding")[1]
    assert units.count() == len(rows) and units.agg({"weight": "max"}).first()[0] == 2001
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_copies(df, store).collect()}
    assert got == cosine_links(many)


def test_embeddings_tables_stay_few():
    """Tables grow slowly with the vectors, and each is likely to miss only what the recall allows."""
    for n, most in ((2_000, 8), (50_000, 16), (10**6, 32), (10**8, 110), (10**9, 200)):
        k, tables = embedding_dedup.shape(n)
        near = embedding_dedup.met(0.2**0.5) ** k
        assert tables <= most and (1 - near) ** tables <= 1 - embedding_dedup.RECALL


@pytest.mark.parametrize("n", [300, 3000])
def test_embeddings_recall_at_the_threshold(spark, store, n):
    """Planted pairs with cosines from 0.9 to 0.92 among unrelated vectors."""
    rng, rows = np.random.default_rng(n), []
    for i in range(n):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        c = rng.uniform(0.9001, 0.92)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b)).tolist())]
    got = embedding_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), store).toPandas()
    assert (got["n_links"] <= 1).all() and got["n_links"].sum() >= 0.95 * 2 * n


def test_embeddings_odd_rows(spark, store):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [1e300, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as n", "'a' as label")
    got = sorted(map(tuple, embedding_dedup.near_copies(df, store).collect()), key=str)
    assert [r for r in got if r[0] in (3, 4, 5, 6, 7, 8)] == [(i, 0, i, True) for i in range(3, 9)]
    assert (1, 3, 1, True) in got and got.count((2, 4, 1, False)) == 2 and (None, 0, None, True) in got
    assert embedding_dedup.near_copies(df.limit(0), store).count() == 0
