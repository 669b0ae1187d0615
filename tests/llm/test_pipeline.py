"""The corpus pipeline against a brute-force version of its stages."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as C

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        done = stage(spark, docs, SF)
        rows = done.collect()
        out.append((name, docs.columns, done.columns, rows))
        docs = spark.createDataFrame(rows, done.schema)
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "quality rules", "near-dedup", "pii", "packing"]
    assert all(s[1] == s[2] for s in stages[:-1])


def test_each_stage_does_what_its_operator_says(spark, stages):
    from pathloom.llm import neardup, packing, pii, quality, toxicity
    from pathloom.llm.common import table

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    tox, good = toxicity.train(docs, labels), quality.train(docs, labels)
    rows = docs.collect()
    want = [r for r in rows if tox.score(r.text or "") < toxicity.THRESHOLD]
    assert sorted(stages[0][3]) == sorted(want) and len(want) > 0.7 * len(rows)
    kept = []
    for r in want:
        c = quality.base_counts(r.text or "")
        if not quality.base_failed(c[0], c[4]) and good.score(r.text or "") >= quality.KEEP:
            kept.append(r)
    assert sorted(stages[1][3]) == sorted(kept)
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(kept, docs.schema)).collect()}
    assert {r.doc_id for r in stages[2][3]} == set(classes.values()) and len(stages[2][3]) == len(set(classes.values()))
    before = {r.doc_id: r.text for r in stages[2][3]}
    for r in stages[3][3]:
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(before[r.doc_id]))
        if not spans:
            assert r.text == before[r.doc_id]
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    texts = {r.doc_id: r.text for r in stages[3][3]}
    enc = packing.encoder(packing.tokenizer_path(packing.VOCABULARY))
    got = {}
    for r in stages[4][3]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(enc(t)) + 1 for i, t in texts.items()}


def test_run(spark, stages):
    import corpus_pipeline as C

    assert {(r.doc_id, r.start, r.ids_crc32) for r in C.run(spark, SF).collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in stages[4][3]}


def test_llm_queries_are_registered():
    import __spark_entry__ as E

    names = list(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("k, operator", list(enumerate(["toxicity.drop_toxic", "quality.keep_good", "neardup.one_of_each", "pii.sanitised"])))
def test_stages_are_written_in_small_row_groups(spark, monkeypatch, tmp_path, k, operator):
    """A task that reads a stage's rows holds a row group: with Parquet's own 128 MB eight tasks ran out of a heap of 1 GB at 0.6 GB of documents."""
    import corpus_pipeline as C
    import pyarrow.parquet as pq

    module, name = operator.split(".")
    monkeypatch.setattr(getattr(C, module), name, lambda docs, *a, **b: docs)
    for m in (C.toxicity, C.quality):
        monkeypatch.setattr(m, "train", lambda *a: None)
    docs = spark.range(1200).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 500), x -> sha2(concat(id, ' ', x), 256)), ' ') AS text").coalesce(1)
    spark.conf.unset("parquet.block.size")
    C.STAGES[k][1](spark, docs, SF).write.parquet(f"{tmp_path}/out")
    meta = [pq.ParquetFile(p).metadata for p in (tmp_path / "out").glob("*.parquet")]
    sizes = [m.row_group(g).total_byte_size for m in meta for g in range(m.num_row_groups)]
    assert sum(m.num_rows for m in meta) == 1200 and sum(sizes) > 4 * C.GROUP and max(sizes) < 2 * C.GROUP
    spark.conf.set("parquet.block.size", "12345678")
    C.STAGES[k][1](spark, docs, SF)
    assert spark.conf.get("parquet.block.size") == "12345678"
    spark.conf.unset("parquet.block.size")
