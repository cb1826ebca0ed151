import corpus_pipeline
from tests.llm.samples import edge_documents
from tests.llm.test_dedup import by_brute_force, fingerprint
from tidemark.llm import mixing, toxicity


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def after(df, name):
        rows = stage[name](spark, df, folder)
        assert rows.columns == df.columns
        return spark.createDataFrame(rows.collect(), df.schema)

    clean = after(docs, "toxicity")
    scored = toxicity.toxicity(docs, labels.select("doc_id", "toxic")).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored if r.score < 0.5}
    unique = after(clean, "exact dedup")
    last = {}
    for r in clean.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert {r.doc_id for r in unique.collect()} == set(last.values())
    apart = after(unique, "SimHash near-dedup")
    groups = by_brute_force({r.doc_id: fingerprint(r.text) for r in unique.collect()})
    assert {r.doc_id for r in apart.collect()} == {k for k, v in groups.items() if k == v}
    mix = after(apart, "mixing sources to target weights")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(apart).collect()}
    held = [r.doc_id for r in mix.collect()]
    assert {d: held.count(d) for d in copies} == copies
    coded = stage["SentencePiece encoding and decoding"](spark, mix, folder).collect()
    assert sorted(r.doc_id for r in coded) == sorted(held) and all(r.round_trips for r in coded)


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trips"]
    assert rows.count() > 0


def test_edges(spark, folder):
    for docs in (edge_documents(spark), edge_documents(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= bool(docs.count())
