"""Mixing, sharding and licence scan: against SQL on the tables, by hand on small ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from parlance.llm import licenses, mixing, sharding
from parlance.llm.queries import op5_mix_sources, op7_shard


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def duck(path):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    return con


def test_mix_equals_sql(spark, sf):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = rows(op5_mix_sources(spark, sf), columns)
    want = sorted((tuple(r) for r in duck(f"{sf}/documents.parquet").sql(f"select {', '.join(columns)} from ({mixing.SQL})").fetchall()), key=str)
    assert got == want


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Clamping one by one until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: float(weights[i % 3]) for i, n in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[n] for n in full)
        free = sum(weight[n] for n in names if n not in full)
        target = {n: most * sizes[n] if n in full else left * weight[n] / free for n in names}
        over = {n for n in names if n not in full and target[n] > most * sizes[n]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 100}, {"z": 5, "é": 5, "Z": 500, "y": 1, "x": 0}, {"a": 0, "b": 0}])
def test_targets_and_words_taken(spark, sizes):
    docs, i = [], 0
    for source, n in sizes.items():
        while n > 0:
            k = min(n, 1 + i % 13)
            docs.append((i, " ".join(["w"] * k), source, "extra"))
            n, i = n - k, i + 1
        if sizes[source] == 0:
            docs.append((i, None if i % 2 else "  ", source, None))
            i += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, target string")
    mixed = mixing.mix(df, range_docs=3)
    want = brute_targets(sizes)
    per = {r["source"]: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    for source, n in sizes.items():
        assert per[source]["target"] == pytest.approx(want[source])
        assert abs(per[source]["taken"] - want[source]) <= 0.5
        assert per[source]["over"] <= 0
    applied = mixing.apply_mix(df, mixed)
    assert applied.columns == df.columns
    assert applied.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)))).first()[0] == (mixed.agg(F.sum("taken")).first()[0] or None)
    assert rows(mixing.mix(df, range_docs=3), mixed.columns) == rows(mixed, mixed.columns)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(empty, mixing.mix(empty)).count() == 0


@pytest.mark.parametrize("limit", [3_000, 40_000, 1 << 24])
def test_shards_equal_sql(spark, sf, limit):
    columns = ["doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "overfull"]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(sharding.shard(df, limit), columns)
    want = sorted((tuple(r) for r in duck(f"{sf}/documents.parquet").sql(f"select {', '.join(columns)} from ({sharding.sql(limit)})").fetchall()), key=str)
    assert got == want
    assert op7_shard(spark, sf).count() == len(got)


def test_shards_of_odd_rows(spark):
    docs = [(1, "x" * 50, "s"), (1, "x" * 50, "s"), (2, None, None), (None, "y" * 500, "t"), (3, "", "u")]
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string, shard string"), 60).collect()
    assert len(got) == 5
    for r in got:
        assert r["shard_bytes"] <= 60 or r["overfull"]
    assert {r["doc_id"] for r in got if r["overfull"]} == {1, None}
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 60).count() == 0


def brute_licenses(text, threshold=0.8):
    low = licenses.lower(text or "")
    found = {}
    import re

    for passage in {*low.split("\n"), *re.split(r"\n\s*\n", low), low}:
        own = licenses.bigrams(passage)
        best = {}
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                b = licenses.bigrams(t)
                if own and b:
                    best[name] = max(best.get(name, 0.0), 2 * len(own & b) / (len(own) + len(b)))
        if best:
            name = min(best, key=lambda n: (-best[n], n))
            if best[name] >= threshold:
                found[name] = max(found.get(name, 0.0), best[name])
    return found


def test_license_scan_equals_brute_force(spark):
    texts = ["Released under the MIT License.", "some\nreleased UNDER  the mit-license!\nmore", "Licensed under CC BY 4.0.\n\nLicensed under CC BY-NC 4.0.", None, "", "license", "the License the MIT", "é Permission is hereby granted, free of charge\nto any person obtaining a copy of this software"]
    texts += ["This work is licensed under the GNU General Public License, version %d." % v for v in (2, 3, 4)]
    texts += ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in\ncompliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string").repartition(3)
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = round(r["dice"], 9)
    want = {i: {n: round(d, 9) for n, d in brute_licenses(t).items()} for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}
    assert licenses.scan(docs.limit(0)).count() == 0


def best_windows(text):
    """The best coefficient of any run of words for each licence, by trying them all."""
    found = licenses.WORDS.findall(licenses.lower(text))
    pairs, best = list(zip(found, found[1:], strict=False)), {}
    for name, texts in licenses.TEMPLATES.items():
        for b in map(licenses.bigrams, texts):
            for i in range(len(pairs)):
                for j in range(i, len(pairs)):
                    own = set(pairs[i : j + 1])
                    best[name] = max(best.get(name, 0.0), 2 * len(own & b) / (len(own) + len(b)))
    return best


def test_notices_inside_passages():
    held = licenses.Templates(licenses.TEMPLATES, 0.8)
    mit = licenses.TEMPLATES["MIT"][2]
    third = len(mit) // 3
    comment = "# copyright 2020 some one and all the others of them\n#\n# " + mit[:third] + "\n# " + mit[third : 2 * third] + "\n# " + mit[2 * third :] + "\n#\n# the above copyright notice and this permission notice shall be included in all copies or substantial portions and more words follow here until the end of it\nimport os"
    line = "The tools in this chapter are released under the MIT License. They may be copied by anyone who has read it, and the GNU Affero General Public License, version 3 is not one of them."
    for text in (comment, line):
        got = {name: dice for name, dice, _ in held.scan(text)}
        assert set(got) == {"MIT"}
        assert got["MIT"] == pytest.approx(best_windows(text)["MIT"])
    assert [p for _, _, p in held.scan(line)] == ["released under the mit license"]
    two = "Part one is licensed under CC BY 4.0 and part two is licensed under CC BY-NC 4.0 as the table of all parts below says in detail"
    assert {name for name, _, _ in held.scan(two)} == {"CC-BY-4.0", "CC-BY-NC-4.0"}
    exact = "we say: this work is licensed under the GNU General Public License, version 3. And so on, for as long as a line of some more words goes"
    assert {name: dice for name, dice, _ in held.scan(exact)} == {"GPL-3.0": 1.0}


def test_directory_of_shards_stays_off_the_driver(spark, sf):
    """Its files are far smaller than its rows, so Spark would broadcast it by their size."""
    plan = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet"), 3_000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan
