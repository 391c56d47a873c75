"""The pipeline's stages on the test tables: each decision takes effect, and clean documents stay."""

from __future__ import annotations


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from docloom.llm import secrets
    from docloom.llm._shared import written
    from docloom.llm.decontaminate import find

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, single, clean, safe = kept
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    wanted = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in good for i in wanted) >= 0.97 * len(wanted)
    # one of each group of near copies stays
    from test_operators import components_by_force

    ids = sorted(good)
    of = [c for _, c in components_by_force([good[i] for i in ids], 5, (80, 100))]
    assert set(single) == {i for k, i in enumerate(ids) if of[k] == k}
    # no window of the benchmark is left
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert find(spark.createDataFrame(list(clean.items()), "doc_id long, text string"), benchmark).where("n_hit > 0").count() == 0
    assert set(clean) == set(single) and set(safe) == set(clean)
    assert not any(secrets.base_spans(t) for t in safe.values())


def test_run(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) == len({r["doc_id"] for r in out}) > 50
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_odd_tables(spark, sf_dir, tmp_path):
    """Empty tables, null and empty texts, and repeated rows go through all stages."""
    import corpus_pipeline

    benchmark, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x" * 50_000), (4, "tab\t\x00   end")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS LONG) AS n_chars")
    for name, table, rows in (("empty", odd.limit(0), 0), ("odd", odd, 5)):
        folder = tmp_path / name
        for n, t in (("documents", table.select(docs.columns)), ("benchmark", benchmark.limit(0) if not rows else benchmark), ("labels", labels.limit(0))):
            t.write.parquet(f"file://{folder}/{n}.parquet")
        out = corpus_pipeline.run(spark, f"file://{folder}").collect()
        assert len(out) == rows and all(r["n_tokens"] == len(r["ids"]) for r in out)
