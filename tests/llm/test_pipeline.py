"""The pipeline: each stage against its operator, and the whole on planted cases."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def staged(spark, folder, tmp_path_factory):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(staged):
    assert [n for n, *_ in staged] == ["toxicity", "near-duplicates", "decontamination", "personal data", "packing"]
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns
    assert set(staged[-1][2].columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_decisions_take_effect(spark, folder, staged):
    from tallyline.llm import decontaminate, simhash

    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in [staged[0][1], *[s[2] for s in staged[:4]]]]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = ids[0] - ids[1]
    assert gone and all(labels.get(d, 1) == 1 for d in gone)
    components = simhash.similar_documents(staged[1][1]).collect()
    assert ids[2] == {r["component_id"] for r in components}
    sets = {r["doc_id"]: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((r["text"] or "").lower().split()) for r in staged[1][1].collect()}
    for gone in ids[1] - ids[2]:  # by brute force: what went has a near copy, and what stays has none
        assert any(o != gone and 5 * len(sets[o] & sets[gone]) >= 4 * len(sets[o] | sets[gone]) for o in sets)
    for one in ids[2]:
        assert not any(o < one and 5 * len(sets[o] & sets[one]) >= 4 * len(sets[o] | sets[one]) for o in ids[2])
    hits = decontaminate.decontaminate(staged[2][1], spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
    assert ids[3] == {r["doc_id"] for r in hits if not r["n_hit"]}
    assert ids[4] == ids[3]
    packed = {r["doc_id"] for r in staged[4][2].select("doc_id").collect()}
    assert packed == ids[4]
    texts = {r["doc_id"]: r for r in staged[3][2].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())


def test_run_gives_the_last_stage(spark, folder, staged):
    assert corpus_pipeline.run(spark, folder).count() == staged[-1][2].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rejected string"


@pytest.mark.parametrize("k", range(5))
def test_odd_documents(spark, folder, k):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names in every stage."""
    long = " ".join("word%d" % i for i in range(120_000))
    rows = [
        (1, None, "en", "s", 0, "x"), (2, "", None, None, None, "x"), (None, "text of nobody with mail a.b@c.example.com", "en", "s", 3, "x"),
        (None, "another text of nobody at all", "en", "s", 3, "x"), (7, "plain words that nobody else has", "en", "s", 5, "x"),
        (7, "plain words that nobody else has", "en", "s", 5, "x"), (8, long, "en", "s", 5, "x"),
        (9, "one id of two texts and this is the first", "en", "s", 5, "x"), (9, "one id of two texts but that is another", "en", "s", 5, "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    name, stage = corpus_pipeline.STAGES[k]
    after = stage(spark, docs, folder)
    got = after.collect()
    if name == "packing":
        assert sorted({r["doc_id"] or 0 for r in got}) == [0, 1, 2, 7, 8, 9] and sum(r["doc_id"] == 7 for r in got) == 2
        return
    assert after.columns == docs.columns
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
    if name == "personal data":
        assert len(got) == len(rows) and not any("a.b@c.example.com" in t for _, t in texts)
    elif name == "near-duplicates":
        assert texts == sorted({(d or 0, t or "") for d, t, *_ in rows if d != 2})  # the empty texts are one group
    elif name == "decontamination":
        assert texts == sorted((d or 0, t or "") for d, t, *_ in rows)
    else:
        assert {t for _, t in texts} <= {t or "" for _, t, *_ in rows} and sum(d == 7 for d, _ in texts) in (0, 2)


def test_texts_that_share_an_id(spark, folder):
    """A text that is rejected takes no other text of its id with it."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    fresh = "a text of quite another kind that is in no benchmark and has no copy"
    docs = spark.createDataFrame([(5, item, "en", "s", 1, "x"), (5, fresh, "en", "s", 1, "x"), (5, fresh, "en", "s", 1, "w"), (4, fresh + " but this end", "en", "s", 1, "x"), (None, item, "en", "s", 1, "x")], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((r["doc_id"], r["text"]) for r in stages["decontamination"](spark, docs, folder).collect()) == sorted([(4, fresh + " but this end"), (5, fresh), (5, fresh)])
    kept = stages["near-duplicates"](spark, docs, folder).collect()
    assert sorted((r["doc_id"], r["text"], r["_rejected"]) for r in kept) == sorted([(4, fresh + " but this end", "x"), (5, item, "x")] + ([(5, fresh, "w")] if len(kept) == 3 else []))


def test_toxic_ties(spark, folder, monkeypatch):
    """A score of exactly one half is rejected, whatever row has it."""
    from tallyline.llm import toxicity

    monkeypatch.setattr(toxicity, "trained", lambda *a: 0.5)
    docs = spark.createDataFrame([(1, "x", None, None, None, None), (None, None, None, None, None, None)], SCHEMA)
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == 0


def test_empty_documents(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_workers_get_small_batches(spark, folder, monkeypatch):
    """However many rows a partition has, few whole texts are in a worker at a time; the session's setting stays."""
    import pyarrow as pa

    from tallyline.llm import simhash

    sizes, before = [], spark.conf.get(corpus_pipeline.BATCH)

    def spy(docs):
        seen = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        sizes.extend(r["n"] for r in seen.collect())
        return docs.selectExpr("doc_id", "doc_id AS component_id")

    monkeypatch.setattr(simhash, "similar_documents", spy)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, folder).count() == 3000
    assert sum(sizes) == 3000 and max(sizes) <= int(corpus_pipeline.ROWS) and spark.conf.get(corpus_pipeline.BATCH) == before
    monkeypatch.setattr(simhash, "similar_documents", lambda docs: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, folder)
    assert spark.conf.get(corpus_pipeline.BATCH) == before
