"""Packing, token files and the transducer, against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, queries, token_files, tokens

ODD = ["", " ", "  a  b\n\n c", "x   y", "don't  DON'T 's", "<|endoftext|> a <|endoftext|>", "a <|ENDOFTEXT|>b <|startoftext|>", "á ́b", "ΑΣ Σ", "\x1c a\x1d b", "\r\n x\t y ", "日本 語  text", "a\x85 b\xa0 c", "e ́", "\n a", "a \n", "a\x01 \x01 b", "'", "a\n\nb\nC", "x" * 5000, " " * 900 + "y", "'" * 700 + "s", "ab " * 3000]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def both(request):
    with open(public_tokenizers.path(request.param), "rb") as f:
        data = f.read()
    return tokens.encoder(data, 5000), Tokenizer.from_buffer(data)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return bpe.Model(f.read())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def mixed(n, seed=1):
    r = random.Random(seed)
    parts = ["a", "th", "'", "re", " ", "  ", "\n", "é", "1", "!", "<|endoftext|>", "日", "the", " of", "\t", "'s", "<", "|"]
    return ["".join(r.choice(parts) * r.choice([1, 1, 1, 2, 5, 40]) for _ in range(r.randint(1, 12))) for _ in range(n)]


def test_pieces_have_the_ids_of_the_whole(both, corpus):
    encode, tokenizer = both
    texts = ODD + mixed(1000) + [r.text for r in corpus.collect()]
    for t, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids(tokenizer, t), t[:60]
    assert encode([None]) == [b""]


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.chars = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_the_library_gets_each_piece_of_a_word_once():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encode = tokens.encoder(f.read())
    encode.tokenizer = counted = Counted(encode.tokenizer)
    new = ["garbelon wistrade", "garbelon, wistrade. wistrade,", "\u00e9garb. ,", "\u00e9garb,"]
    given = []
    for t in new:
        before = counted.chars
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == ids(counted.inner, t)
        given.append(counted.chars - before)
    assert given == [len(new[0]), len(", ."), len("\u00e9garb"), 0]  # no word between words of letters, and nothing twice


def test_every_pair_of_latin_letters_and_signs():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encode = tokens.encoder(f.read())
    chars = [chr(c) for c in range(0x20, 0x260)]
    texts = [*chars, *[a + b for a in "a'.\u00e9" for b in chars], *[b + a for a in "a'.\u0301" for b in chars]]
    for t, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids(encode.tokenizer, t), t


@pytest.mark.parametrize("run", [" ", "\n", " \n\t", "\u2003"])
def test_runs_of_two_million_blanks(docs, library, run):
    text = "a" + run * (2_000_000 // len(run)) + "b <|endoftext|>" + run * 99_999 + "c"
    expected = [*ids(library, text), 1]
    pieces = sorted((r.start, r.ids) for r in packing.pack(docs([(1, text)]), with_ids=True).collect())
    assert [x for _, p in pieces for x in p] == expected
    (r,) = bpe.digests(docs([(1, text)])).collect()
    assert r.n_tokens == len(expected) - 1 and r.ids_sha256 == hashlib.sha256(",".join(map(str, expected[:-1])).encode()).hexdigest()


def test_kinds_of_files():
    def read(name):
        with open(public_tokenizers.path(name), "rb") as f:
            return f.read()

    assert isinstance(tokens.encoder(read("word_bpe_49k.json")), tokens.WordEncoder) and tokens.byte_encoder(read("word_bpe_49k.json")) is None
    data = read("byte_bpe_50k.json")
    texts = ODD + mixed(50)
    assert tokens.byte_encoder(data)(texts) == tokens.library_encoder(data)(texts)
    assert tokens.byte_encoder(data.replace(b'"add_prefix_space":false', b'"add_prefix_space":true').replace(b'"add_prefix_space": false', b'"add_prefix_space": true')) is None


def test_transducer_and_decoder(model, library, corpus):
    encoder, decoder = bpe.Encoder(model), bpe.Decoder(model)
    for t in ODD + mixed(400) + [r.text for r in corpus.limit(60).collect()]:
        expected = ids(library, t)
        for chunk in (1 << 16, 100, 7):
            got = [i for some in bpe.encode_text(encoder, t, chunk) for i in some]
            assert got == expected, (chunk, t[:60])
        back = "".join(decoder.feed(expected[k : k + 3]) for k in range(0, len(expected), 3)) + decoder.finish()
        assert back == library.decode(expected, skip_special_tokens=False)


def test_memory_of_a_long_word_is_bounded(model):
    encoder, most = bpe.Encoder(model), 0
    word = "".join(random.Random(2).choice("aehnrst") for _ in range(60_000))
    for k in range(0, len(word), 500):
        encoder.feed(word[k : k + 500])
        most = max(most, len(encoder.text) + (len(encoder.window.held) if encoder.window else 0))
    assert most <= encoder.hold + 500 + 3 * model.lookahead + 500


def test_lookahead_of_a_known_list():
    ab, abc = (b"a", b"b"), (b"ab", b"c")
    assert bpe.lookahead([ab]) == 1
    assert bpe.lookahead([ab, abc]) == 2
    assert bpe.lookahead([(b"b", b"c"), (b"a", b"b")]) == 2  # c takes b, so a stays alone: two merges in a chain
    with pytest.raises(ValueError):
        bpe.lookahead([abc, ab])


def test_digests(docs, library):
    rows = [(1, "Hello  world"), (2, None), (None, ""), (3, "<|endoftext|>x" * 50), (3, "é" * 70_000)]
    out = {(r.doc_id, r.n_tokens): r for r in bpe.digests(docs(rows)).collect()}
    for i, t in rows:
        expected = ids(library, t)
        r = out[(i, len(expected))]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs([]).limit(0)).isEmpty()
    assert bpe.encode(docs([(1, "Hello  world")])).first().ids == ids(library, "Hello  world")


def test_query_over_the_whole_table(spark, sf_dir, corpus, library):
    rows = {r.doc_id: r for r in queries.queries()["op8_bpe"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        expected = ids(library, t)
        text = library.decode(expected, skip_special_tokens=False)
        assert rows[i].n_tokens == len(expected) and rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# Packing ----------------------------------------------------------------------------------------------------------------


def best(lengths, capacity):
    """The largest sum up to capacity of a multiset with the longest length, by trying all."""
    seed = max(lengths)
    rest = sorted(lengths)
    rest.remove(seed)
    sums = {seed}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= capacity}
    return max(sums)


def test_fill_is_the_minimum_slack():
    r = random.Random(3)
    for _ in range(300):
        lengths = [r.randint(1, 60) for _ in range(r.randint(1, 12))]
        counts = {x: lengths.count(x) for x in lengths}
        used = packing.fill(counts, sorted(counts, reverse=True), 64)
        assert all(0 < n <= counts[x] for x, n in used.items()) and max(lengths) in used
        assert sum(x * n for x, n in used.items()) == best(lengths, 64)


def check_sequences(rows, capacity=2048):
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for parts in documents.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    return padding


def test_pieces_cover_each_document(corpus, library):
    out = packing.pack(corpus, with_ids=True).collect()
    assert check_sequences(out) == 0
    texts = {r.doc_id: r.text for r in corpus.collect()}
    pieces = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, t in texts.items():
        whole = [x for _, p, _ in sorted(pieces[i]) for x in p]
        assert whole == [*ids(library, t), 1] and {n for _, _, n in pieces[i]} == {len(whole)}


def test_blocks_and_small_inputs(docs):
    r = random.Random(4)
    for block, n in ((1, 50), (7, 200), (64, 500), (4096, 3)):
        packer, made = packing.Packer(64, block), []
        for k in range(n):
            made += packer.add(k, np.full(r.choice([1, 3, 64, 200, r.randint(1, 63)]), k, "<u4"))
        made += packer.finish()
        assert len(packer.rest) == 0
        from types import SimpleNamespace

        assert check_sequences([SimpleNamespace(doc_id=p[0], start=p[1], length=len(p[2]), sequence_id=p[4], offset=p[5]) for p in made], 64) == 0
    out = packing.pack(docs([(1, None), (2, ""), (3, "a")])).collect()
    assert sorted(r.length for r in out) == [1, 1, 2] or sum(r.length for r in out) == 4
    assert packing.pack(docs([]).limit(0)).isEmpty()


# Token files ------------------------------------------------------------------------------------------------------------


def test_blocks_round_trip():
    r = np.random.default_rng(5)
    cases = [np.zeros(1, "<u4"), np.full(1024, 7, "<u4"), r.integers(0, 49408, 5000), r.integers(0, 50, 1023), np.concatenate([r.integers(0, 20, 1500), [49407, 0, 49407]]), np.array([0, 2**32 - 1]), r.integers(0, 2**32, 3000)]
    for x in cases:
        x = np.asarray(x).astype("<u4")
        docs = [(5, x), (None, x[:1]), (-3, x[::-1])]
        data = token_files.encode_segment(docs)
        back = token_files.decode_segment(data)
        assert [d for d, _ in back] == [5, None, -3]
        assert all(np.array_equal(a, b) for (_, a), (_, b) in zip(docs, back, strict=True))
        whole = np.concatenate([v for _, v in docs])
        for lo, hi in ((0, 1), (len(whole) // 3, len(whole)), (len(whole) // 2, len(whole) // 2)):
            assert np.array_equal(token_files.decode_range(data, lo, hi), whole[lo:hi])
    with pytest.raises(ValueError):
        token_files.decode_segment(b"nope")


def test_outliers_are_patched_and_width_is_narrow():
    x = np.concatenate([np.arange(1000) % 8, np.full(24, 49407)]).astype("<u4")
    low, width, n, patches = token_files.HEAD.unpack_from(token_files.encode_blocks(x)[0])
    assert (low, width, n, patches) == (0, 3, 1024, 24)


def test_files_of_a_table(spark, docs, corpus, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(7, None), (-1, "b a"), (None, "first"), (7, "zz"), (100, "Long " * 30_000)]
    rows += [(1000 + r.doc_id, r.text) for r in corpus.limit(40).collect()]
    token_files.write_files(docs(rows), str(tmp_path / "f"))
    out = sorted(token_files.read_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    at, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = np.array([*ids(tokenizer, t), 1], "<u4")
        expected.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert [tuple(r) for r in out] == expected
    token_files.write_files(docs([]).limit(0), str(tmp_path / "e"))
    assert token_files.read_files(spark, str(tmp_path / "e")).isEmpty()


def test_query_of_files_over_the_whole_table(spark, sf_dir, corpus):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, at = {r.doc_id: r for r in queries.queries()["op3_token_files"](spark, sf_dir).collect()}, 0
    for r in sorted(corpus.collect(), key=lambda r: r.doc_id):
        x = np.array([*ids(tokenizer, r.text), 1], "<u4")
        assert tuple(rows[r.doc_id]) == (r.doc_id, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert len(rows) == corpus.count()


def test_many_rows_without_an_id_are_split(spark, docs, tmp_path):
    df = docs([(None, f"text {k}") for k in range(4000)]).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_files(df, str(tmp_path / "n"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "n")).select("shard").distinct().count() > 1
    assert token_files.read_files(spark, str(tmp_path / "n")).count() == 4000
