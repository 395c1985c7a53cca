import corpus_pipeline
from tastegraph.llm import decontaminate, line_dedup, simhash_dedup, token_counts, toxicity
from tastegraph.llm.queries import QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing",
    ]


def test_stages_do_what_their_operators_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.learn_weights(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected

    lines = stages["line_dedup"](spark, clean, sf_dir).cache()
    found = line_dedup.remove_lines(clean).collect()
    expected = {r.row.doc_id: r.kept for r in found if not r.n_removed or r.kept.strip()}
    assert {r.doc_id: r.text for r in lines.collect()} == expected

    first = stages["simhash_dedup"](spark, lines, sf_dir).cache()
    groups = simhash_dedup.simhash_components(lines).collect()
    assert sorted(r.doc_id for r in first.collect()) == sorted({r.component_id for r in groups})

    passed = stages["decontamination"](spark, first, sf_dir).cache()
    bad = {r.doc_id for r in decontaminate.benchmark_matches(first, benchmark).collect()}
    assert {r.doc_id for r in passed.collect()} == {r.doc_id for r in first.collect()} - bad
    for stage in (clean, lines, first, passed):
        assert stage.columns == docs.columns

    packed = stages["packing"](spark, passed, sf_dir).collect()
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(passed).collect()}
    assert {r.doc_id: r.n_tokens for r in packed} == counts

    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.bucket_tokens) for r in whole.collect()) == sorted((r.doc_id, r.bucket_tokens) for r in packed)


def test_pipeline_of_odd_and_empty_documents(docs_of, odd_pairs, spark, sf_dir):
    for pairs in (odd_pairs, []):
        docs = docs_of(pairs, extra=False)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() <= len(pairs)


def test_pipeline_without_labels_keeps_documents(docs_of, spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs_of([(1, "some clean words"), (2, "other text")], extra=False)
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 2
