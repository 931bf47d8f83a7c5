from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, duck_rows, spark_rows
from tidemark.llm import ngram_join, queries
from tidemark.llm.components import components


def shingle_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, per_cent=75):
    """component by id, all pairs looked at."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    least = {f: min((i for i in ids if i is not None), default=None) for f, ids in members.items()}
    return sorted(((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def words(r, n, pool=400):
    return [f"w{r.randrange(pool)}" for _ in range(n)]


def edited(r, base, edits):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def test_against_brute_force(docs):
    r = random.Random(1)
    rows = [(None, "null id text of six words"), (3, "null id TEXT of six words"), (5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE  two"), (10, "one two three"), (11, "É a b c d e"), (12, "é a b c d e"), (13, "same row again " * 4), (13, "same row again " * 4)]
    passage = words(r, 60)
    i = 20
    for n in (8, 30, 100, 300):
        for _ in range(4):
            base = words(r, n)
            for _ in range(6):
                rows.append((i, " ".join(edited(r, base, r.randrange(0, max(2, n // 12))))))
                i += 1
    for _ in range(30):  # a passage that many documents share links none of them
        rows.append((i, " ".join(words(r, 200) + passage + words(r, 100))))
        i += 1
    rows.append((i, " ".join(words(r, 20_000))))
    r.shuffle(rows)
    assert found(ngram_join.groups(docs(rows))) == brute(rows)


def test_against_sql(spark, sf_dir):
    names, expected = duck_rows(connect(sf_dir), queries.oracle_sql()["op6_ngram_join"])
    df = queries.queries()["op6_ngram_join"](spark, sf_dir)
    assert sorted(df.columns) == names and spark_rows(df) == expected


def test_large_group_of_near_copies(docs):
    r = random.Random(2)
    base = words(r, 90, 10**6)
    rows = [(k, " ".join(edited(r, base, r.randrange(0, 5)))) for k in range(400)] + [(1000 + k, " ".join(words(r, 50, 10**6))) for k in range(50)] + [(2000 + k, " ".join(base)) for k in range(100)]
    assert found(ngram_join.groups(docs(rows))) == brute(rows)


def test_similarity_exactly_at_the_threshold(docs):
    w = [f"x{k}" for k in range(40)]
    a = " ".join(w[:11])  # 7 shingles
    rows = [(1, a), (2, " ".join([*w[:10]])), (3, " ".join(w[:9])), (4, " ".join(w[:7])), (5, " ".join(w[20:28])), (6, " ".join(w[20:27]))]
    assert found(ngram_join.groups(docs(rows))) == brute(rows)


def test_rows_that_stay_and_other_columns(docs):
    df = docs([(5, "a b c d e f g h i"), (2, "a b c d e f g h i"), (9, None), (None, "a b c d e f g h i"), (4, "p q r s t u")]).withColumnRenamed("source", "component_id")
    out = ngram_join.near_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect() if r.doc_id is not None)) == [2, 4, 9] and out.count() == 4
    assert ngram_join.groups(df.limit(0)).isEmpty()


@pytest.mark.parametrize("per_cent", [50, 75, 90])
def test_tree_finds_what_all_pairs_find(per_cent):
    r = np.random.default_rng(3)
    sets = [np.sort(r.choice(60, r.integers(1, 30), replace=False)).astype(np.uint64) for _ in range(80)]
    sets += [np.arange(100 * k, 100 * k + 90, dtype=np.uint64) for k in (1, 1, 2)] + [np.append(np.arange(100, 185, dtype=np.uint64), np.uint64(9999))]
    sizes = np.array([len(s) + (k % 3 == 0) for k, s in enumerate(sets)])
    tree = ngram_join.Tree(sets, sizes)
    expected = set()
    for a, s in enumerate(sets):
        for b, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            if 100 * both >= per_cent * (sizes[a] + sizes[b] - both):
                expected.add((a, b))
    walked = [(int(a), int(b)) for x, y in tree.walk(sets, sizes, per_cent) for a, b in zip(x, y, strict=True)]
    assert len(walked) == len(set(walked)) and set(walked) == expected


@pytest.mark.parametrize("limits", [ngram_join.Limits(), ngram_join.Limits(8, 1 << 20, 1), ngram_join.Limits(1024, 300, 64), ngram_join.Limits(3, 200, 4)])
def test_limits_of_blocks_change_no_result(docs, limits):
    """Hot places cut into blocks, and large places walked block by block, against all pairs."""
    r = random.Random(4)
    rows, i = [], 0
    for n, copies, edits in ((60, 120, 9), (40, 30, 2), (25, 12, 1)):
        base = words(r, n, 10**6)
        for _ in range(copies):
            rows.append((i, " ".join(edited(r, base, r.randrange(0, edits)))))
            i += 1
    parts = [words(r, 14, 10**6) for _ in range(6)]
    for _ in range(80):  # made of common passages, linked here and there
        rows.append((i, " ".join(w for p in r.sample(parts, 3) for w in p)))
        i += 1
    assert found(ngram_join.groups(docs(rows), limits=limits)) == brute(rows)


def test_components_of_chains_and_stars(spark, tmp_path):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(300, 200), (200, 250), (7, 7)]
    out = dict(components(spark.createDataFrame(edges, "u long, v long"), str(tmp_path), "c").collect())
    assert all(out[k] == 0 for k in range(61)) and all(out[k] == 100 for k in range(100, 140)) and {out[k] for k in (200, 250, 300)} == {200}
    assert components(spark.createDataFrame([], "u long, v long"), str(tmp_path), "d").isEmpty()


def test_an_id_with_texts_of_several_components(spark, docs):
    """Only the text that is linked with a smaller id goes; the other text of that id stays."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (3, b + " more"), (7, a + " x"), (None, b), (9, None), (5, "")]
    out = ngram_join.near_dedup(docs(rows).withColumn("h1", F.lit(1)).withColumn("gone", F.lit("x")))
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(5, a), (3, b + " more"), (0, b), (9, ""), (5, "")])
    assert out.columns[-2:] == ["h1", "gone"]


def test_a_large_place_is_walked_by_size(spark, tmp_path):
    """10,000 sets of one place that link with nothing: each goes to blocks of its own size only, and meets all sets that it could link with."""
    r = random.Random(5)
    rows = [(7, k, k, 9, int(10 ** r.uniform(1, 6))) for k in range(10_000)] + [(8, k, 0, 9, 50) for k in range(40)]
    seats = spark.createDataFrame(rows, "place long, node long, root long, size int, n long")
    out = ngram_join.placed(seats, str(tmp_path), 75, ngram_join.Limits(sets=64)).collect()
    assert len(out) == len(rows)
    sits = {(x.place, x.node): x["at"][0].block for x in out}
    walks = {x.node: {b.block for b in x["at"] if b.walks} for x in out if x.place == 7}
    assert sum(len(x["at"]) for x in out) < 20 * len(rows)  # by all blocks of the place it would be 157 a row
    sizes = {k: n for p, k, _, _, n in rows if p == 7}
    for a, b in ((r.randrange(10_000), r.randrange(10_000)) for _ in range(200_000)):
        if 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b]):
            assert a == b or sits[7, b] in walks[a] or sits[7, a] in walks[b]
    assert {sits[8, k] for k in range(40)} == {0} and all(len(x["at"]) == 1 for x in out if x.place == 8)


@pytest.mark.parametrize("per_cent", [50, 75, 90, 100])
def test_bands_part_no_sizes_that_can_link(spark, per_cent):
    """A set and the smallest set that could link with it, for all sizes up to 20,000 and some large ones."""
    n = spark.range(1, 20_001).union(spark.sql("select 4 * pow(4, id) * 3 as id from range(12)").select(F.col("id").cast("long")))
    least = F.ceil(F.col("id") * per_cent / 100)
    apart = ngram_join.band(F.col("id"), per_cent) - ngram_join.band(least, per_cent)
    assert n.select(F.max(apart)).first()[0] <= 1


@pytest.mark.parametrize("per_cent", [60, 75, 90])
def test_places_of_many_sizes_against_all_pairs(docs, per_cent):
    r = random.Random(6)
    parts = [words(r, 12, 10**6) for _ in range(12)]
    rows = [(k, " ".join(w for p in r.sample(parts, r.randrange(1, 9)) for w in p)) for k in range(160)]
    rows += [(1000 + k, " ".join(edited(r, rows[k][1].split(), 1))) for k in range(40)]
    df = ngram_join.groups(docs(rows), per_cent=per_cent, limits=ngram_join.Limits(3, 400, 4))
    assert found(df) == brute(rows, per_cent)
