from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import quality, queries

BLANK = "\x20\t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    repeated = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            repeated |= set(range(k, k + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.strip(BLANK):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_base_counts():
    r = random.Random(1)
    parts = ["a", "B", "é", "日本", "#", "<b>", " ", "  ", "\n", "\t", "\xa0", "\x0b", "same line\n", "a b c d e f "]
    for text in [None, "", " \n ", "a " * 12, "x y z w v " * 3 + "q", *("".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(300))]:
        assert quality.statistics(text)[0] == brute(text)


def test_base_rules():
    assert quality.base_failed(9, 0) and not quality.base_failed(10, 2) and quality.base_failed(10, 3)


def test_model_on_labelled_rows(spark, sf_dir):
    """On rows that were not in training: junk goes, good texts stay."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~held))
    out = quality.score(docs, model).join(labels.where(held), "doc_id").where("not base_failed and quality is not null").collect()
    right = [r.kept == (r.quality == 1) for r in out]
    assert len(right) > 5 and np.mean(right) >= 0.9
    assert all(0 <= r.probability <= 1 for r in out)


def test_probabilities_are_calibrated():
    r = np.random.default_rng(1)
    score = r.normal(size=4000) * 3
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 * score - 1)))).astype(float)
    a, b = quality.platt(score, y)
    assert abs(a - 0.5) < 0.1 and abs(b + 1) < 0.15


def test_nulls_missing_labels_and_columns(spark, docs):
    df = docs([(1, None), (None, ""), (3, "w " * 20), (4, " ".join(map(str, range(30)))), (5, "long " * 50_000)]).withColumnRenamed("source", "kept")
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(df, none) is None
    out = {r.doc_id: r for r in quality.score(df, None).collect()}
    assert [out[k].kept for k in (1, None, 3, 4, 5)] == [False, False, False, True, False]
    kept = quality.keep_good(df, None)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [4]
    assert quality.score(df.limit(0), None).isEmpty() and quality.keep_good(df.limit(0), None).isEmpty()


def slow_probability(text, model):
    """Features counted one by one, and the logistic regression with Platt's two numbers by hand."""
    data = text.encode()
    h = [xxhash.xxh64_intdigest(w) for w in data.split()]
    words, chars = np.zeros(1 << quality.WORD_BITS), np.zeros(1 << quality.CHAR_BITS)
    for k, x in enumerate(h):
        words[x >> 64 - quality.WORD_BITS] += 1
        if k:
            words[((h[k - 1] * 0xC2B2AE3D27D4EB4F + x) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - quality.WORD_BITS] += 1
    for k in range(len(data) - 2):
        chars[(int.from_bytes(data[k : k + 3]) * 2654435761 & 0xFFFFFFFF) >> 32 - quality.CHAR_BITS] += 1
    x = np.concatenate([np.sqrt(words / max(1, words.sum())), np.sqrt(chars / max(1, chars.sum()))])
    *w, b, a, c = model
    return 1 / (1 + np.exp(-(a * (x @ np.array(w) + b) + c)))


def test_query(spark, sf_dir):
    """Every row of the table: counts and rules by hand, and the verdict from a slow probability."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: r for r in queries.queries()["op1_quality"](spark, sf_dir).collect()}
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        r = rows[i]
        if len(t or "") < 20_000:  # the brute count is quadratic
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == quality.base_failed(r.n_words, r.n_repeat_words)
        p = slow_probability(t or "", model)
        assert r.probability == pytest.approx(p, abs=1e-3) and (r.kept == (not r.base_failed and p >= 0.5) or abs(p - 0.5) < 1e-3)


def test_training_takes_one_text_of_an_id_and_any_order(spark, docs):
    good, bad = "plain words of a text " * 4, "### $$$ ||| <<< %%% *** " * 4
    df = docs([(k % 20, f"{good if k % 20 % 2 else bad} {k}") for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "key long, quality int")
    a = quality.train(df, labels, label_id="key", sample=16)
    b = quality.train(df.repartition(7), labels.repartition(3), label_id="key", sample=16)
    assert np.array_equal(a, b)


def test_ids_of_text(spark, sf_dir):
    """The id may be of any type: the same verdicts as with numbers on rows that both samples can hold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    out = {r.doc_id: r.kept for r in quality.score(named[0], quality.train(*named)).collect()}
    known = {r.doc_id: r.kept for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(out) == len(known) and np.mean([out[f"doc-{i}"] == k for i, k in known.items()]) >= 0.95
