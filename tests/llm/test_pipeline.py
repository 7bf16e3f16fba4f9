"""The pipeline against its stages done plainly on the smallest tables."""

import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from graphweft.llm.tokenizing import tokenizer_path

from .test_operators import DATA, brute_components, brute_hits


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, DATA)
        seen[name] = after.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        at = after
    start = docs.toPandas()
    tongue, single, clean, packed = (seen[n] for n, _ in corpus_pipeline.STAGES)
    assert set(tongue.doc_id) == set(start.doc_id[start.text.str.contains(r"[^\W\d_]", regex=True)])
    rows = [tuple(r) for r in tongue[["doc_id", "text"]].itertuples(index=False)]
    assert sorted(single.doc_id) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    items = [tuple(r) for r in pd.read_parquet(f"{DATA}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    hits = {r[0] for r in brute_hits([tuple(r) for r in single[["doc_id", "text"]].itertuples(index=False)], items) if r[2]}
    assert hits and not any(r[2] for r in brute_hits([tuple(r) for r in clean[["doc_id", "text"]].itertuples(index=False)], items))
    untouched = single[~single.doc_id.isin(hits)].set_index("doc_id").text
    assert untouched.equals(clean[~clean.doc_id.isin(hits)].set_index("doc_id").text.reindex(untouched.index))
    assert (clean.n_chars == clean.text.str.len()).all()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(clean.doc_id, clean.text)}
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_run(spark):
    """The run is its stages one after the other; only where pieces of equal length go may differ."""
    at = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, DATA)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out, expected = corpus_pipeline.run(spark, DATA).toPandas(), at.toPandas()
    rows = lambda df: sorted(map(tuple, df[columns].itertuples(index=False)))
    assert len(out) and rows(out) == rows(expected)
    assert out.sequence_id.nunique() == expected.sequence_id.nunique()
