"""The pipeline's stages on the smallest tables, each against what its operator says of its own input."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fenwright.llm import decontamination, packing, queries, tokens
from fenwright.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    from test_operators_llm import deduped, fingerprint, jaccard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    step = {}
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, SF), name)
        step[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    before, after = step["toxicity"]
    assert 0 < after.count() <= before.count()
    before, after = step["line_dedup"]
    rows = [(r["doc_id"], r["text"], None) for r in before.collect()]
    want = {k[0]: v[0] for k, v in deduped(rows, 2, 20).items()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = step["simhash_near_dedup"]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    ids = sorted(rows)
    near = lambda a, b: (fingerprint(rows[a], 5) ^ fingerprint(rows[b], 5)).bit_count() <= 2 or jaccard(rows[a], rows[b]) >= 0.8
    linked = [(a, b) for a in ids for b in ids if a < b and near(a, b)]
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    assert all(any(group[k] == group[i] and k < i for k in kept) for i in ids if i not in kept)  # only near duplicates go
    assert not any(rows[a] == rows[b] and a in kept and b in kept for a, b in linked)
    assert sum(a in kept and b in kept for a, b in linked) <= 0.1 * len(linked)
    before, after = step["benchmark_decontamination"]
    hit = {r["doc_id"] for r in decontamination.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
    before, after = step["packing"]
    encode = tokens.encoder(packing.default_tokenizer())
    total = {}
    for r in after.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {r["doc_id"]: len(encode(r["text"] or "")) + 1 for r in before.collect()}


def test_columns_with_the_operators_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    names = ["n_lines", "gone", "score", "predicted", "s_id", "f_text", "Label", "best"]
    extra = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns, name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names), name


def test_decontamination_takes_only_the_text_found(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item}"), (None, "clean"), (None, None), (5, f"{item} y"), (5, "clean too"), (6, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in cp.decontaminate(spark, d, str(tmp_path)).collect()} == {rows[1], rows[2], rows[4], rows[5]}


def test_stages_on_awkward_tables(spark, tmp_path):
    from test_operators_llm import awkward, deduped, make

    rows = awkward(3, 30)
    docs = make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0), (11, 0, 1), (12, None, 1), (None, 1, 1), (13, 0, None)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (1, "same text twice"), (2, rows[9][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        given = [(i, t) for i, t, _ in rows]
        if name == "line_dedup":
            want = {k: v[0] for k, v in deduped(rows, 2, 20).items()}
            assert got == sorted(((i, None if t is None else want[-1 if i is None else i, t]) for i, t in given), key=str)
        else:
            assert set(got) <= set(given) and len(got) <= len(given), name
        if name == "simhash_near_dedup":
            assert len(got) == len({t for _, t in got}) and (None, "no id here at all") in got
        if name == "benchmark_decontamination":
            assert {i for i, t in given if (i, t) not in got} >= {5} and (1, None) in got and (2, "") in got
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).groupBy("doc_id").count().count() == len({i for i, _, _ in rows})


def test_run(spark):
    assert cp.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF).toPandas()
    want = c.execute(queries.oracle_sql()[name]).df()
    norm = lambda df: sorted(tuple(None if v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert sorted(got.columns) == sorted(want.columns) and str(norm(got)) == str(norm(want))
