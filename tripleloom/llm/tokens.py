"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

Prefix-sharing trie traversal. The distinct words of a batch, in byte order, are the trie's leaves in depth-first order. On the path from the
root each node holds the last token of the encoding of its prefix and where that token starts. A child's last token is the one vocabulary
token that ends its prefix and may follow the last token of the prefix before it: byte pair encodings are exactly the token sequences whose
neighbouring pairs encode as themselves. Moving on to the next word drops the states below the common prefix and keeps all above it, so the
encoding of a shared prefix is computed once; a word's tokens are read off by going back from its leaf.

Words and whether two tokens may be neighbours are kept for the life of a worker, up to a fixed number of entries.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the tokenizers' files lie, and which one is used, unless told otherwise.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Most words that a worker keeps the encodings of; beyond that it starts anew.
KEPT_WORDS = 300_000
#: Texts of about so many characters are turned into one output batch.
SLICE_CHARS = 4_000_000

#: The white space of the tokenizer's pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Splitter:
    """Cuts texts into the tokenizer's words: contractions, runs of letters, of digits and of other signs, each with a space before it, and white space.

    The classes of letters and digits hold just those characters that have been met, which lets the standard engine match them by table.
    """

    def __init__(self):
        self.known: set[str] = set()
        self._compile()

    def _compile(self) -> None:
        pick = lambda kind: "".join(re.escape(c) for c in sorted(self.known) if unicodedata.category(c)[0] == kind and c not in SPACES)
        letters, digits, spaces = pick("L") or "a", pick("N") or "0", re.escape(SPACES)
        self.find = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall

    def learn(self, texts: list[str]) -> None:
        new = set().union(*texts) - self.known
        if new:
            self.known |= new
            self._compile()


class Encoder:
    """Encodes words by one vocabulary of ranked byte strings."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.ends = {t[k:] for t in self.rank for k in range(len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a short byte string by merging, lowest rank first: the definition, used for pairs of tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            low = min(ranked)
            if low == 1 << 30:
                break
            i = ranked.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * KEPT_WORDS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """The encodings of words that come in byte order."""
        rank, ends, pairs = self.rank, self.ends, self.pairs
        before, last, start = b"", [-1], [0]
        for word in words:
            n, top = 0, min(len(before), len(word))
            while n < top and before[n] == word[n]:
                n += 1
            del last[n + 1 :], start[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                found, k = [], i - 1
                while k >= 0 and (end := word[k:i]) in ends:
                    if (t := rank.get(end)) is not None:
                        found.append((t, k))
                    k -= 1
                for t, k in reversed(found):
                    if not k:
                        break
                    ok = pairs.get((last[k], t))
                    if ok or (ok is None and self._may_follow(last[k], t)):
                        break
                last.append(t)
                start.append(k)
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i = start[i]
            out.reverse()
            yield out
            before = word


class Words:
    """The words met by a worker, numbered, with their encodings and what further callers want to know of each."""

    def __init__(self, path: str):
        self.encoder, self.splitter = Encoder(path), Splitter()
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.ids: list[list[int]] = []
        self.counts = np.zeros(0, np.int32)

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; all of them are numbered and encoded afterwards."""
        self.splitter.learn(texts)
        cut = [self.splitter.find(t) for t in texts]
        if len(self.number) > KEPT_WORDS:
            self.reset()
        new = sorted((w.encode(), w) for w in set(chain.from_iterable(cut)).difference(self.number))
        if new:
            for k, (_, w) in enumerate(new, len(self.number)):
                self.number[w] = k
                self.names.append(w)
            fresh = list(self.encoder.encode_sorted([b for b, _ in new]))
            self.ids += fresh
            self.counts = np.concatenate([self.counts, np.fromiter(map(len, fresh), np.int32, len(fresh))])
        return cut

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


_WORDS: dict[str, Words] = {}


def worker_words(folder: str, name: str) -> Words:
    """This worker's words for a tokenizer; loaded once."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts, each of about so many characters or one text."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    The ids of a null and of an empty text are the empty list. Text that looks like a special token is ordinary text. Texts of any length are
    encoded whole; equal rows each give a row; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(folder, name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                cut = words.split([t or "" for t in texts[a:b]])
                ids, number = words.ids, words.number
                flat = [np.fromiter(chain.from_iterable([ids[number[w]] for w in ws]), np.int32) for ws in cut]
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum([len(x) for x in flat], out=offsets[1:])
                values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def counted(documents: DataFrame, columns: list[str], text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """The named columns and ``n_tokens``, the number of tokens of each text; 0 for a null or empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(folder, name)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            out = np.zeros(len(texts), np.int64)
            for a, b in slices(texts):
                for k, ws in enumerate(words.split([t or "" for t in texts[a:b]]), a):
                    out[k] = words.counts[words.numbers(ws)].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*columns, "n_tokens"])

    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    return documents.select(*columns, text).mapInArrow(run, f"{fields}, n_tokens bigint")
