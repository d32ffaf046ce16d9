"""The pipeline's rows against plain Python over the same stages' decisions."""

import corpus_pipeline
import public_tokenizers
from cladeloom.llm import pii, toxicity
from cladeloom.session import materialize
from test_operators import SF, brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    kept = {0: docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        kept[k] = materialize(stage(spark, kept[k - 1], SF), name)
        if k < len(corpus_pipeline.STAGES):
            assert kept[k].columns == columns
    texts = {k: {r["doc_id"]: r["text"] for r in kept[k].collect()} for k in range(5)}
    model = toxicity.fit(docs, labels)
    assert texts[1] == {d: t for d, t in texts[0].items() if model.severity(t)[1] < toxicity.REJECT_AT}
    assert set(texts[2]) == {d for d, (_, c) in brute_components(texts[1]).items() if d == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, t in texts[2].items() if any(i in t for i in items)}
    assert leaked and not leaked & texts[3].keys() and len(texts[2]) - len(texts[3]) <= len(leaked) + 2
    assert texts[4].keys() == texts[3].keys()
    left = pii.find(kept[4], pii.SpanModel()).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0]
    assert left == 0
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: r["length"] for r in kept[5].groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "length").collect()}
    assert sizes == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts[4].items()}
