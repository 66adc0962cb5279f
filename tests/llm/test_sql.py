"""Every query that has SQL against it: on given tables, and on planted ones where the given have little to find."""

import random

import compare
import numpy as np
import pytest
from llm_words import words

from chunkloom.llm import entries


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare.differences(entries.QUERIES[name](spark, sf), compare.connect(sf), entries.SQL[name]) == []


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with near copies, short and empty ones and license wordings that overlap; vectors in groups."""
    draw, top = random.Random(5), tmp_path_factory.mktemp("planted")
    told = ["Licensed under the Apache License, Version 2.0", "GNU General Public License version 3 or any later version", "cc by cc by-sa 4.0", "All RIGHTS reserved.", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-2.0-only OR MIT and ISC", "ISC or MIT", "provided “as is” without warranty", "released under the terms of the MIT license"]
    texts = [None, "", " \t\n", "one", "One two three four", "one two three FOUR", "one two three four five", "ccé by", "café cc by"]
    for _ in range(40):
        base = words(draw, 60)
        texts.append(" ".join(base))
        for k in (1, 3, 9):
            other = list(base)
            other[draw.randrange(60)] = f"changed{k}"
            texts.append(" ".join(other[: 60 - k]))
        texts.append(" ".join(base[:10] + draw.sample(told, 2) + base[10:20]))
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 4 if i % 3 else 0}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(top / "documents.parquet")
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(30):
        centre = rng.normal(size=64)
        vectors += [centre + rng.normal(size=64) * s for s in (0, 0.1, 0.2, 0.25, 0)]
    rows = [(i, [float(x) for x in v.astype(np.float32)], 0) for i, v in enumerate(vectors)] + [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(top / "made"))
    next((top / "made").glob("*.parquet")).rename(top / "embeddings.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_source_mix", "op5_exact_dedup", "op6_ngram_join"])
def test_planted_tables_equal_sql(spark, planted, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{planted}/{t}.parquet'")
    df = entries.QUERIES[name](spark, planted)
    assert compare.differences(df, con, entries.SQL[name]) == []
    rows = df.collect()
    found = {
        "op2_license_scan": lambda: len({r.labels for r in rows}) > 8 and sum(r.n_base > 0 for r in rows) > 20,
        "op3_source_mix": lambda: sum(r.taken for r in rows) > 0,
        "op5_exact_dedup": lambda: not all(r.kept for r in rows),
        "op6_ngram_join": lambda: sum(r.component_id != r.doc_id for r in rows) > 40,
    }
    assert found[name]()


def test_planted_vectors_against_sql(spark, planted):
    """Links found by hashing are among those of every pair, and nearly all of them."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{planted}/embeddings.parquet'")
    want = {r[0]: r for r in con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({entries.SQL['op1_embedding_dedup']})").fetchall()}
    got = {r.vec_id: r for r in entries.QUERIES["op1_embedding_dedup"](spark, planted).collect()}
    assert set(got) == set(want) and all(got[i].n_links <= want[i][1] for i in want)
    assert sum(r[1] for r in want.values()) > 500
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(r[1] for r in want.values())
    assert sum(got[i].component_id == want[i][2] for i in want) >= 0.95 * len(want)
