import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.llm.common import stored
from tests.llm.test_near_dedup import brute
from tests.llm.test_texts import brute_lines, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out[name] = docs
        assert name == "packing" or docs.columns == columns
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
    kept = {r.doc_id for r in toxicity.score(source, model).where("score < 0.3").collect()}
    texts = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in out.items() if name != "packing"}
    assert {i for i, _ in texts["toxicity"]} == kept
    assert sorted(texts["line_dedup"]) == [(i, t) for i, _, _, t in sorted(brute_lines(texts["toxicity"]))]
    assert {i for i, _ in texts["near_dedup"]} == {i for i, _, _, keep in brute(texts["line_dedup"], 5) if keep}
    before = dict(texts["near_dedup"])
    for i, text in texts["pii"]:
        assert not brute_spans(text) or not before[i]
        if not brute_spans(before[i]) and "[TERM]" not in text:
            assert text == before[i]
    packed = out["packing"].collect()
    assert {r.doc_id for r in packed} == {i for i, _ in texts["pii"]}
    assert sum(len(r.ids) // 4 for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    again = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in again) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in packed)
