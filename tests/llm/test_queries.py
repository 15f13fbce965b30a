"""Registered queries against their SQL, and the pipeline against its operators stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from gritsieve.llm import decontaminate, near_dup, quality, queries, secrets

from .helpers import awkward, ids, prose, table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def folder(spark, tmp_path, rows):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 150)) for i in range(100, 200)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(30, 77))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def corpus():
    good = [(100 + i, prose(60, i)) for i in range(50)]
    bad = [(150 + i, prose(60, i + 50).upper().replace(" ", "!! ")) for i in range(50)]
    copies = [(300 + i, good[0][1]) for i in range(5)] + [(310, good[1][1].replace(" a", " b", 1) + " end")]
    leaks = [(400, f"{prose(40, 90)} {prose(30, 77)} {prose(10, 91)}")]
    hidden = [(500, f"{prose(60, 95)} key 7f3a9c1be04d5286a1f0c37be92d4856 {prose(10, 96)}")]
    return good + bad + copies + leaks + hidden + awkward()


def test_pipeline_stage_by_stage(spark, tmp_path):
    d = folder(spark, tmp_path, corpus())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/stage{at}")
        now = spark.read.parquet(f"{d}/stage{at}")
        if at < 4:
            assert now.columns == columns
        if name == "quality_rules":
            kept = quality.scores(docs, quality.fit_model(docs, spark.read.parquet(f"{d}/labels.parquet"))).where("decision not in ('reject', 'empty')")
            assert ids(now) == ids(kept) and not set(ids(now)) & set(range(150, 200)) and set(range(100, 150)) <= set(ids(now))
        elif name == "simhash_near_dedup":
            gone = [r["doc_id"] for r in near_dup.groups(docs).where("not keep").collect()]
            assert set(ids(docs)) - set(ids(now)) == set(gone) >= {300, 301, 302, 303, 304, 310} and ids(now).count(5) == 1
        elif name == "benchmark_decontamination":
            hit = {r["doc_id"] for r in decontaminate.matches(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
            assert hit == {400} and ids(now) == [i for i in ids(docs) if i != 400]
        elif name == "secret_scans":
            assert ids(now) == ids(docs)
            changed = now.where("text like '%[SECRET]%'").collect()
            assert [r["doc_id"] for r in changed] == [500] and changed[0]["n_chars"] == len(changed[0]["text"])
            assert secrets.scan(now).count() == 0
        docs = now
    assert docs.where("not exact").count() == 0 and docs.columns == ["doc_id", "n_bytes", "n_tokens", "tokens", "exact"]
    assert sorted(map(repr, corpus_pipeline.run(spark, d).collect())) == sorted(map(repr, docs.collect()))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage by its definition in plain Python: scores gram by gram, all pairs, all windows, all tokens, the library's encoding."""
    import re

    import tiktoken

    from gritsieve.llm import bpe

    from .test_operators import brute_groups, brute_matches, plain_quality

    d = folder(spark, tmp_path, corpus())
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_model(docs, labels)
    rows = [(i, t) for i, t in corpus() if t is not None and re.search(r"\w", t) and model.probability(plain_quality(t, model.weights)) >= quality.REJECT_BELOW]
    root, _, _ = brute_groups([t for _, t in rows], near_dup.RADIUS)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first = {}
    for k in order:
        first.setdefault(root[k], k)
    rows = [rows[k] for k in sorted(first.values())]
    hit = {i for i, _ in brute_matches([(k, t) for k, (_, t) in enumerate(rows)], [(1, prose(30, 77))])}
    rows = [(i, t.replace("7f3a9c1be04d5286a1f0c37be92d4856", "[SECRET]")) for k, (i, t) in enumerate(rows) if k not in hit]
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.Vocabulary.read().rank, special_tokens={})
    want = sorted(repr((i, len(t.encode()), library.encode_ordinary(t))) for i, t in rows)
    got = sorted(repr((r["doc_id"], r["n_bytes"], r["tokens"])) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want and 50 < len(got) < len(corpus()) - 50


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0
