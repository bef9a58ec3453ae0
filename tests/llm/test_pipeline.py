import public_tokenizers

import corpus_pipeline
from gleaner.llm import exact_dedup, language_id, near_dup, packing, source_mix
from gleaner.session import staged


def test_stages_chain_and_their_decisions_take_effect(spark, docs):
    read = docs.where("doc_id is not null")
    kept = [read]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, kept[-1], ""), name)
        assert out.columns == read.columns
        kept.append(out)
    language, exact, near, mixed = kept[1:]
    model = language_id.fit(read)
    known = language_id.predict(read, model).where("lang_pred <> 'und' and score >= 0.3")
    ids = lambda rows: sorted(r.doc_id for r in rows.select("doc_id").collect())
    assert ids(language) == ids(known)
    assert {r.score for r in language.collect()} == {0.5}
    assert exact.count() == exact_dedup.dedup(language).where("kept").count() < language.count()
    dropped = near_dup.group(exact).where("not kept").select("doc_id").distinct()
    assert near.count() == exact.join(dropped, "doc_id", "left_anti").count()
    taken = source_mix.mix(near)[0].agg({"taken": "sum"}).first()[0]
    assert sum(len(r.text.encode().split()) for r in mixed.collect()) == taken
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, "")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    expected = packing.pack(mixed, packing.PackingParams(tokenizer))
    assert last.columns == expected.columns and last.count() == expected.count()


def test_run_reads_the_documents_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert {n for n, _ in corpus_pipeline.STAGES} == {
        "language_id", "exact_dedup", "near_dup", "source_mix", "best_fit_packing"
    }
