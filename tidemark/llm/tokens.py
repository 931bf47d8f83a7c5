"""Token ids of whole texts with a tokenizer file, in Arrow batches.

All encoders give the ids of the tokenizers library. Byte-level files whose ids follow their list of merges (checked on loading) are run
by tiktoken, which takes a third of the time; files that drop white space and lower-case are encoded word by word with a bounded
cache; any other file goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: The pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN, BLANK_RUN = 100_000, re.compile(r"\s++")
CACHE = 1_000_000  #: words in each of the two generations of a worker's cache
Encoder = Callable[[list[str | None]], list[bytes]]


def shipped(spark: SparkSession, name: str) -> Broadcast:
    """The tokenizer file's bytes (a few MB, whatever the input), for the executors."""
    with open(public_tokenizers.path(name), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        names[chr(256 + k)] = b
    return names


def as_bytes(ids: list[int] | np.ndarray) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def library(data: bytes):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def library_encoder(data: bytes) -> Encoder:
    tokenizer = library(data)
    return lambda texts: [as_bytes(e.ids) for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def byte_encoder(data: bytes) -> Encoder | None:
    """For a plain byte-level file; None if it is any other."""
    spec = json.loads(data)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or spec["normalizer"] or any(pre.get(k) != v for k, v in plain.items()) or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    names = byte_names()
    ranks = {bytes(names[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(set(made)) or len(made) + 256 != len(ranks):
        return None
    import tiktoken

    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = lru_cache(1)(lambda: library_encoder(data))

    def ids(t: str | None) -> bytes:
        if not t:
            return b""
        return slow()([t])[0] if has_long_run(t) else as_bytes(encoding.encode_to_numpy(t, allowed_special="all"))

    return lambda texts: [*map(ids, texts)]


def has_long_run(text: str) -> bool:
    """Whether white space goes on for RUN characters; tiktoken fails at about a million, and the library takes any number."""
    return len(text) >= RUN and any(m.end() - m.start() >= RUN for m in BLANK_RUN.finditer(text))


class WordEncoder:
    """For files that drop white space and lower-case: ids of words between ASCII white space, one after another.

    Words that aren't in the cache are encoded by the library, many in one call. A word of Latin letters, or of ASCII signs without an apostrophe,
    is one piece to the tokenizer, and a piece has one id of a word's end, its last; a word of such letters and then such signs is these two pieces.
    Between all other words goes a word of one token.
    """

    MARK = "\x01"
    #: U+0130 isn't among the letters, since its lower case is a letter and a mark
    PIECES = re.compile("([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, data: bytes, cache: int = CACHE) -> None:
        self.tokenizer, self.size = library(data), cache
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = json.loads(data)["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # the generation before; what isn't used goes with it

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_pieces(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 512):
            some = pieces[at : at + 512]
            ids = self._library(" ".join(some))
            stops = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(stops) != len(some):
                self._learn_marked(some)
                continue
            data, start = ids.tobytes(), 0
            for w, stop in zip(some, stops, strict=True):
                self.words[w.encode()] = data[start:stop]
                start = stop

    def _learn_marked(self, words: list[str]) -> None:
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = self._library(f" {self.MARK} ".join(some))
            data, start = ids.tobytes(), 0
            for w, end in zip(some, [*(np.flatnonzero(ids == self.mark[0]) * 4).tolist(), len(data)], strict=True):
                self.words[w.encode()] = data[start:end]
                start = end + 4

    def _learn(self, words: Iterable[bytes]) -> None:
        pieces, pairs, others, parts = [], [], [], self.PIECES.fullmatch
        for w in words:
            if (known := self.old.get(w)) is not None:
                self.words[w] = known
            elif self.MARK.encode() in w or b"<|" in w:
                self.words[w] = as_bytes(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids)
            elif (found := parts(t := w.decode())) is None:
                others.append(t)
            elif found[1] and found[2]:
                pairs.append((w, *found.groups()))
            else:
                pieces.append(t)
        known = {p for _, *two in pairs for p in two}.difference(pieces)
        pieces += [p for p in known if p.encode() not in self.words]
        self._learn_pieces(pieces)
        self._learn_marked(others)
        for w, letters, signs in pairs:
            self.words[w] = self.words[letters.encode()] + self.words[signs.encode()]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(texts), 64):
            if len(self.words) > self.size:
                self.old, self.words = self.words, {}
            # upper case may be part of a special token's name, which lower case isn't
            cut = [(t.encode() if "<|" in t else t.encode().lower()).split() if t else [] for t in texts[start : start + 64]]
            if new := set().union(*cut).difference(self.words):
                self._learn(new)
            out += [b"".join([*map(self.words.__getitem__, words)]) for words in cut]
        return out


def encoder(data: bytes, cache: int = CACHE) -> Encoder:
    if found := byte_encoder(data):
        return found
    spec = json.loads(data)
    words = spec["model"].get("end_of_word_suffix") and '"Lowercase"' in json.dumps(spec["normalizer"]) and '"Removed"' in json.dumps(spec["pre_tokenizer"])
    return WordEncoder(data, cache) if words else library_encoder(data)


@lru_cache(2)
def worker_encoder(data: bytes) -> Encoder:
    """One encoder, with its cache, for all tasks of a Python worker."""
    return encoder(data)
