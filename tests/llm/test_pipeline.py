"""The corpus pipeline, each stage against what its operator says about its own input."""

from __future__ import annotations

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import language, quality

from .test_exact_dedup import brute as equal_texts
from .test_ngram_join import brute as near_texts
from .test_tokens import check_sequences


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = spark.read.parquet(str(tmp_path / f"{k - 1}")) if k else docs
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / f"{k}"))
        after = spark.read.parquet(str(tmp_path / f"{k}"))
        assert k == 4 or after.columns == docs.columns
        kept.append(after.collect())
    ids = [{r.doc_id for r in rows} for rows in kept]
    assert all(len(rows) == len(i) for rows, i in zip(kept[:-1], ids, strict=False))
    texts = {r.doc_id: r.text for r in kept[0]}
    known = {r.doc_id for r in language.predict(docs, language.train(docs)).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert ids[1] == known
    model = quality.train(spark.read.parquet(str(tmp_path / "0")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids[2] == {r.doc_id for r in quality.score(spark.read.parquet(str(tmp_path / "0")), model).where("kept").collect()}
    assert ids[3] == {max(g) for g in equal_texts([(i, texts[i]) for i in ids[2]]).values()}
    assert ids[4] == {c for _, _, c in near_texts([(i, texts[i]) for i in ids[3]])}
    assert ids[5] == ids[4] and check_sequences(kept[5]) == 0


def test_run_has_the_rows_of_the_last_stage(spark, sf_dir):
    """The whole table, against the stages worked out row by row."""
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and check_sequences(out.collect()) == 0
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = [r.doc_id for r in language.predict(docs, language.train(docs)).where("lang_pred <> 'und' and score >= 0.5").collect()]
    left = docs.where(docs.doc_id.isin(known))
    good = [r.doc_id for r in quality.score(left, quality.train(left, labels)).where("kept").collect()]
    single = [max(g) for g in equal_texts([(i, texts[i]) for i in good]).values()]
    want = {c for _, _, c in near_texts([(i, texts[i]) for i in single])}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in out.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == want
    for i in want:
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        for start, length, crc in sorted(pieces[i]):
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))
        assert sum(n for _, n, _ in pieces[i]) == len(ids)


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, ""), (2, "12 34")], None])
def test_stages_take_any_table(spark, sf_dir, docs, tmp_path, rows):
    """Empty tables, nulls, repeated ids and rows."""
    good = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) between 500 and 3000").limit(6).collect()]
    if rows is None:
        rows = [(None, good[0]), (None, good[0]), (5, good[1]), (5, good[1]), (5, good[2]), (6, good[1].upper()), (7, good[3]), (8, None), (9, "x" * 200_000), (10, " ".join(good[3].split()[:-1]))]
    table, before = docs(rows), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, before if k else table, sf_dir)
        made.write.parquet(str(tmp_path / f"{k}"))
        before = spark.read.parquet(str(tmp_path / f"{k}"))
        assert k == 4 or before.columns == table.columns
    assert check_sequences(before.collect()) == 0
