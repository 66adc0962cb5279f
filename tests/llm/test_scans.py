"""License scan, source mix, toxicity, URL filter and the pipeline."""

import collections
import random
import re

import duckdb
import pandas as pd
import pytest

from chunkloom.llm import entries, license_scan, license_texts, source_mix, toxicity, url_filter
from chunkloom.llm.shared import Store

FOLD = {i: i + 32 for i in range(65, 91)}


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


LICENSES = [
    "CC BY", "cc-by cc by, CC\nBY", "All rights reserved. ALL RIGHTS  RESERVED all rights", "Kcc by", "occ by", "cc bye", "§cc by§ cc by é",
    "licensed under the GNU General Public License v3 or any later version", "Licensed under the Apache License, Version 2.0", "Released under the MIT License.",
    "public domain", "cc by all rights reserved general public license " * 200, "CC BY-NC-SA 3.0 and BSD 3-Clause", "permission",
]


def test_license_scan(spark, odd):
    assert len(license_scan.rules()) > 300
    rows = list(enumerate(LICENSES))
    got = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: tuple(got[i])[1:6] for i, _ in rows} == {i: base(t) for i, t in rows}
    labels = {i: got[i].labels for i in got}
    assert labels[7] == "gpl,gpl-3,gpl-3-or-later" and labels[8] == "apache-2.0" and labels[9] == "mit" and labels[12] == "bsd-3-clause,cc-by,cc-by-nc-sa-3.0"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[13].score == 0 and got[8].score == 1
    odd_rows = {i: t for i, t in ((r.doc_id, r.text) for r in odd.collect()) if i is not None}
    for r in license_scan.scanned(odd).where("doc_id is not null").collect():
        assert tuple(r)[1:6] == base(odd_rows[r.doc_id])
    assert license_scan.scanned(odd.limit(0)).count() == 0


BODIES = {
    "Permission is hereby granted, free of charge, to any person": "mit",
    "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\")": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software": "ofl",
    "Redistribution and use in source and binary forms": "bsd",
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted": "bsd",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "isc",
    "with or without fee is hereby granted": "",
    "The origin of this software must not be misrepresented; you": "zlib",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an “AS IS” BASIS": "apache-2.0",
    "you can redistribute it. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2-or-later",
    "SPDX-License-Identifier: MIT": "mit",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC": "apache-2.0,isc,mit",
    "SPDX-License-Identifier: BSD-3-Clause-Clear": "bsd-3-clause-clear",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    "Apache-2.0": "apache-2.0",
    "see MPL 2.0.": "mpl-2.0",
    "mit isc ruby": "",
}


def test_license_bodies_and_spdx(spark):
    rows = list(enumerate(BODIES))
    got = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i].labels for i, t in rows} == BODIES
    assert len(license_texts.handwritten()) > 300
    for label, _, regex, _, _ in license_texts.handwritten():
        assert any(g in regex for g in license_scan.GATES) or regex.split()[0] in license_texts.ALONE, label
    for label, keyword, regex, _, _ in license_texts.BODIES:  # a keyword stands in whatever the rule matches
        assert keyword in regex, label


def test_license_scan_is_native(spark, odd):
    plan = license_scan.scanned(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def water(sizes):
    """Targets by the rounds as they are told: cap, share again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = {s: 3 * sizes[s] for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: capped.get(s, weight[s] * level) for s in order}
        capped |= over


def test_mix_is_near_in_sources_of_few_documents(spark, store):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * int(rng.lognormvariate(5, 1))), f"s{i % 12}") for i in range(120)]
    got = source_mix.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), store).toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per["taken"] - per["target"]).abs() <= 0.05 * per["target"]).all()


def test_mix_offset_is_one_draw(spark, store, monkeypatch):
    """Without changes of single documents, copies are what one offset of the source gives."""
    monkeypatch.setattr(source_mix, "ROUNDS", 0)
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 3 % 2]) for i in range(300)], "doc_id long, text string, source string")
    got = source_mix.plan(df, store).toPandas()
    for _, x in got.groupby("source"):
        rate = x["target"].iloc[0] / x["source_size"].iloc[0]
        assert abs(x["copies"].sum() - len(x) * rate) < 1 and x["copies"].isin([int(rate), int(rate) + 1]).all()


def test_mix(spark, store, odd):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 60)) or None, rng.choice(["a", "b", "ß", None, "c" if i % 50 == 0 else "big"])) for i in range(900)]
    rows += [(9001, "", "none"), (9002, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = source_mix.plan(df, store).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = water(sizes), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]) for s in want)
    assert all(abs(taken[s] - want[s]) <= 3 for s in want if sizes[s])  # changes of single documents come nearer than sampling
    again = source_mix.plan(df.repartition(2), store)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    out = source_mix.mixed(df, store)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({r.doc_id: r.copies for r in got if r.copies})
    copies = source_mix.plan(odd, store).agg({"copies": "sum"}).first()[0]
    assert source_mix.mixed(odd, store).count() == copies and source_mix.plan(odd.limit(0), store).count() == 0


def documents(seed, n):
    rng = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(400)], ["vile", "rotten", "lowly"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(2, 12))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(bad)}{rng.choice(['', 'er', 'ing'])} {rng.choice(bad)}"
        rows.append((i, ". ".join(sentences) + ".", "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, odd):
    rows, labels = documents(1, 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    toxic = {i: t for i, _, t in labels}
    got = toxicity.judged(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert 200 < len(held) < 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted != toxic[r.doc_id] for r in held) <= 0.05 * len(held)
    model = toxicity.train(docs, marks)
    found = toxicity.located(docs, model).collect()
    assert all(re.search("vile|rotten|lowly", r.text) for r in found if r.score > 0.9)
    texts = {i: re.split(r"(?<=\.) ", t) for i, t, *_ in rows}
    assert sum(texts[r.doc_id][r.sentence].split() == r.text.split() for r in found) > 0.9 * len(found) > 0
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    every = toxicity.judged(odd, marks).collect()
    assert len(every) == odd.count() and all(r.score == 0 and r.worst_sentence == -1 for r in every if r.doc_id in (0, 1, 2, 3))
    assert toxicity.clean(odd, marks).columns == odd.columns
    assert toxicity.judged(odd, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.judged(docs.limit(0), marks).count() == 0


def test_url_filter(spark, store):
    rng = random.Random(3)
    hosts = [f"h{i}.example.{rng.choice(['com', 'net', 'org'])}" for i in range(40)] + ["NET", "x.org"]
    rows = []
    for i in range(300):
        tail = rng.choice(["/en/", "/de/", "/fr/", "", "/x?y", "#z", "?q=/fr/"])
        links = "".join(f"<a HREF={rng.choice(['', chr(34), chr(39)])}//{rng.choice(hosts)}/a>" for _ in range(rng.randint(0, 3)))
        rows.append((i, f"http://{rng.choice(hosts)}{tail}{i}", f"<p>{links}<a href='/local'>"))
    rows += [(500, None, None), (501, "nothing", "x"), (502, "://", "<a href='http://a.net'>"), (503, "HTTP://ExAmple.NET/en/é?x", ""), (503, "HTTP://ExAmple.NET/en/é?x", "")]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(repr(tuple(r)) for r in url_filter.judged(df, store).collect())
    con = duckdb.connect()
    con.register("pages", pages)
    assert got == sorted(map(repr, con.execute(url_filter.sql()).fetchall()))
    assert sum("'block')" in x and "None" in x for x in got) > 0  # some by links alone
    assert url_filter.judged(df.limit(0), store).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, store, before = spark.read.parquet(f"{sf}/documents.parquet"), Store(spark, "p"), None
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = store.keep(stage(spark, docs, sf), "stage")
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        if i < 3:
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() <= docs.count()
        before, docs = docs, out
    assert docs.count() == before.count() and docs.where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, sf)
    assert sorted(run.select("doc_id", "ids_crc32").collect()) == sorted(docs.select("doc_id", "ids_crc32").collect())


def test_pipeline_takes_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd = odd.select("doc_id", "text", "lang", "source", "n_chars")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("not round_trip").count() == 0
    for table in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in entries.QUERIES] == list(range(1, 11))
    assert set(entries.SQL) <= set(entries.QUERIES)
