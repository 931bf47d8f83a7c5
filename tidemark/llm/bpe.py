"""Operator 8: byte-level BPE as a streaming transducer with bounded lookahead, and a streaming decoder.

Lookahead. Merges run in the order of the list. Compare the runs on a window w and on a longer text wz: their tokens agree up to a
frontier, at first the end of w. Only a merge (a, b) across the frontier moves it, by |a| to the left, and the next one (a', b')
must come later in the list and have a at the left edge of b'. So the frontier moves by no more than the heaviest such chain of
merges, which `lookahead` computes in one pass over the list. A token of w that ends at least that far before the end of w is
final, and a merged text may be cut after any final token. A worker thus holds a window, never a whole word, however long.

Words (the pattern of the tokenizer file) are found chunk by chunk: the last few characters of a chunk stay back, since what a word
is depends on at most two characters after it; a word longer than `hold` is fed on to the window piece by piece.

Defined results: null counts as empty; the special token's own text becomes its id, as the tokenizers library does;
repeated rows and null ids are encoded each on its own; an empty table gives an empty result; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tokens import PATTERN, byte_names, shipped

#: What goes on in a word of each kind, by the kind of its last character.
RUNS = ((regex.compile(r"\p{L}"), regex.compile(r"\p{L}*")), (regex.compile(r"\p{N}"), regex.compile(r"\p{N}*")), (regex.compile(r"\s"), regex.compile(r"\s*")), (regex.compile(r"."), regex.compile(r"[^\s\p{L}\p{N}]*")))
CHUNK, HOLD, CACHE, SHORT = 1 << 16, 512, 1_000_000, 64
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that settle it: the heaviest chain of merges, each with the one before at its right part's left edge."""
    left: dict[bytes, bytes] = {}  # a token's left part
    reach: dict[bytes, int] = {}  # the heaviest chain that ends in a merge with this left part
    made = set()
    most = 0
    for a, b in merges:
        for part in (a, b):
            if len(part) > 1 and part not in made:
                raise ValueError("a merge comes before its parts; the bound needs them in order")
        longest, edge = 0, b
        while edge:
            longest = max(longest, reach.get(edge, 0))
            edge = left.get(edge)
        reach[a] = max(reach.get(a, 0), len(a) + longest)
        most = max(most, reach[a])
        left.setdefault(a + b, a)
        made.add(a + b)
    return most


class Model:
    """What a tokenizer file says: ids of tokens, ranks of merges, special tokens."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        names = byte_names()
        raw = lambda t: bytes(names[c] for c in t)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.first = [ids[bytes([b])] for b in range(256)]
        self.ranks = {ids[a] << 20 | ids[b]: k for k, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.bytes = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.lookahead = lookahead(merges)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one word: the merge of lowest rank first, of equal ones the leftmost."""
        parts = list(map(self.first.__getitem__, data))
        get, none = self.ranks.get, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            new = parts[k] = self.made[best]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] << 20 | new, none)
            if k < len(ranks):
                ranks[k] = get(new << 20 | parts[k + 1], none)
        return parts


class Window:
    """The transducer on one word: bytes in, final ids out, never more than a window held."""

    def __init__(self, model: Model) -> None:
        self.model, self.held = model, b""
        self.size = 3 * model.lookahead

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out = []
        while len(self.held) >= self.size:
            safe, end = self.size - self.model.lookahead, 0
            for token in self.model.merge(self.held[: self.size]):
                n = len(self.model.bytes[token])
                if end + n > safe:
                    break
                end += n
                out.append(token)
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        data, self.held = self.held, b""
        return self.model.merge(data)


class Words(dict):
    """A bounded cache of words' ids, filled as it is asked; long words aren't kept."""

    def __init__(self, model: Model, size: int) -> None:
        self.model, self.size = model, size

    def __missing__(self, word: str) -> list[int]:
        data = word.encode()
        if len(data) > SHORT:
            window = Window(self.model)
            return window.feed(data) + window.finish()
        if len(self) >= self.size:
            self.clear()
        ids = self[word] = tuple(self.model.merge(data))
        return ids


class Encoder:
    """Text in by chunks of any size, ids out."""

    def __init__(self, model: Model, hold: int = HOLD, cache: int = CACHE) -> None:
        self.model, self.hold = model, hold
        self.find = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None
        self.longest = max(map(len, model.special), default=1)
        self.words = Words(model, cache)
        self.reset()

    def reset(self) -> None:
        self.text, self.open, self.window, self.back = "", None, None, ""

    def feed(self, chunk: str) -> list[int]:
        """Ids that no later text can change."""
        text, out = self.text + chunk, []
        while self.marks and (m := self.marks.search(text)):
            out += self._plain(text[: m.start()], True)
            out.append(self.model.special[m[0]])
            text = text[m.end() :]
        cut = len(text) - self._begun(text)
        self.text = ""
        out += self._plain(text[:cut], False)
        self.text += text[cut:]
        return out

    def finish(self) -> list[int]:
        out = self._plain(self.text, True)
        self.reset()
        return out

    def _begun(self, text: str) -> int:
        """Characters at the end that may begin a special token."""
        for n in range(min(len(text), self.longest - 1), 0, -1):
            if any(mark.startswith(text[-n:]) for mark in self.model.special):
                return n
        return 0

    def _plain(self, text: str, last: bool) -> list[int]:
        """Text without special tokens; what may still change is put back into self.text, unless it is the last."""
        out = []
        if self.window is not None:
            out, text = self._run_on(text, last)
            if self.window is not None:
                return out
        found = self.find.findall(text)
        if last:
            return out + list(chain.from_iterable(map(self.words.__getitem__, found)))
        back = 0  # a word is settled if two characters follow it
        while found and back < 2:
            back += len(found.pop())
        out += chain.from_iterable(map(self.words.__getitem__, found))
        text = text[len(text) - back :]
        if len(text) > self.hold and (m := self.find.match(text)) and m.end() > self.hold // 2:
            self._open(text[: m.end()])
            text = text[m.end() :]
            out += self.window.feed(self._ready())
        self.text = text
        return out

    def _open(self, word: str) -> None:
        self.window, self.back = Window(self.model), word
        self.open, self.run = next((kind, run) for kind, run in RUNS if kind.match(word[-1]))

    def _ready(self) -> bytes:
        """The open word but for its last character, which may turn out to be the next word's (a space before it)."""
        data, self.back = self.back[:-1].encode(), self.back[-1:]
        return data

    def _run_on(self, text: str, last: bool) -> tuple[list[int], str]:
        """Goes on with the open word; returns its ids and what comes after it."""
        n = self.run.match(text).end()
        self.back += text[:n]
        out = self.window.feed(self._ready())
        text = text[n:]
        if not text and not last:
            return out, ""
        if text and self.open is RUNS[2][0]:  # a run of white space before other text leaves its last character to what comes next
            text = self.back + text
        else:
            out += self.window.feed(self.back.encode())
        out += self.window.finish()
        self.window, self.open, self.back = None, None, ""
        return out, text


class Decoder:
    """Ids in, text out: bytes of tokens through a UTF-8 state machine, which holds at most three bytes of an open character."""

    def __init__(self, model: Model) -> None:
        self.bytes = model.bytes
        self.reset()

    def reset(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.reset()
        return text


@lru_cache(2)
def worker_encoder(data: bytes) -> Encoder:
    """One encoder, with its cache of words, for all tasks of a Python worker."""
    return Encoder(Model(data))


def encode_text(encoder: Encoder, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
    for at in range(0, len(text), chunk):
        yield encoder.feed(text[at : at + chunk])
    yield encoder.finish()


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Encodes and decodes every text; number of ids, hash of the ids and hash of the decoded text."""
    data = shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(data.value)
        model = encoder.model
        decoder = Decoder(model)
        names = [str(i) for i in range(max(model.bytes) + 1)]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            counts, sums, decoded = [], [], []
            for t in texts:
                n, ids_hash, text_hash, comma = 0, hashlib.sha256(), hashlib.sha256(), ""
                for ids in encode_text(encoder, t.as_py() or ""):
                    if ids:
                        n += len(ids)
                        ids_hash.update((comma + ",".join(map(names.__getitem__, ids))).encode())
                        comma = ","
                        text_hash.update(decoder.feed(ids).encode())
                text_hash.update(decoder.finish().encode())
                counts.append(n)
                sums.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and the ids of every text."""
    data = shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [[i for some in encode_text(encoder, t or "") for i in some] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")
