from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import tiktoken

from seshat.llm import byte_bpe, quality_rules

from . import plain

DATA = "/root/testdata/sf0.001"


def test_stages_do_as_plain_versions(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python; clean documents stay."""
    docs, columns = spark.read.parquet(f"{DATA}/documents.parquet"), None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        rows = list(texts.items())
        if k == 0:
            kept = {r["doc_id"] for r in quality_rules.judge(before, quality_rules.train(before, labels)).where("kept").collect()}
            texts = {d: t for d, t in rows if d in kept}
            good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
            fail = {d for d, t in rows if (c := plain.quality_counts(t))[0] < 20 or 100 * c[4] > 30 * c[0]}
            assert not kept & fail and len(good & kept) >= 0.98 * len(good - fail)
        elif k == 1:
            texts = {d: t for d, _, _, t in plain.line_dedup(rows)}
        elif k == 2:
            texts = {d: texts[d] for d, _, component in plain.components(rows) if d == component}
        elif k == 3:
            bad = {r[0] for r in plain.decontamination(rows, items) if r[-1]}
            assert bad
            texts = {d: t for d, t in rows if d not in bad}
        else:
            own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            assert {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in docs.collect()} == {(d, len(own.encode_ordinary(t)), plain.sha(t)) for d, t in rows}
            break
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
        assert docs.where("n_chars <> length(text)").isEmpty()
