"""Problem 8: oversized texts cut into pieces within a token limit, at natural boundaries, with overlap.

Lexical-cohesion segmentation. At every pause of a text (end of a line, paragraph or sentence) the words of a block before and a block after
are compared, by the cosine of their frequencies; where similarity falls into a valley, the topic changes. A piece ends at the pause of the
deepest valley in its window; the next piece starts the given number of tokens before. The window is what a piece may hold from a least share
of the limit on (``fill``, a second aim beside cohesion: without it pieces would be half as long on average); only where no pause lies there
is it the part below, again at the deepest valley. A text without a pause in either is cut at a lesser mark, between words, or, without places
to cut, between tokens that end with a whole character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripleloom.llm import tokens
from tripleloom.storage import small

#: Marks that end a sentence, marks that may follow them, and marks of a lesser pause.
ENDS = frozenset(".!?。！？…")
AFTER = "\"'”’»)]}」』）"
LESSER = frozenset(",;:、，；：—–·•|")

SPACE, BREAK, END, SOFT, LEAD, WIDE, TIGHT = 1, 2, 4, 8, 16, 32, 64


@dataclass(frozen=True)
class Cohesion:
    """block: words compared on either side of a pause; least: letters of a word that counts; fill: the share of the limit from which on a piece may end."""

    block: int = 40
    least: int = 4
    fill: float = 0.5


def _flags(word: str) -> int:
    """What a word of the tokenizer means for a cut after or before it."""
    bare = word.strip(tokens.SPACES)
    out = LEAD if word[0] in tokens.SPACES else 0
    if not bare:
        return out | SPACE | (BREAK if any(c in word for c in "\n\r\x85\u2028\u2029") else 0)
    mark = bare.rstrip(AFTER)
    if mark and mark[-1] in ENDS:
        out |= END | (WIDE if mark[-1] in "。！？" else 0)
    elif bare[-1] in LESSER:
        out |= SOFT
    if bare[0] == "'":
        out |= TIGHT
    return out


class _Kinds:
    """For each numbered word its flags and the number of its term; grows with the worker's words."""

    def __init__(self, words: tokens.Words, least: int):
        self.words, self.least = words, least
        self.reset()

    def reset(self) -> None:
        self.owner = self.words.number
        self.flags = np.zeros(0, np.int16)
        self.terms = np.zeros(0, np.int64)
        self.term_no: dict[str, int] = {}

    def update(self) -> None:
        if self.owner is not self.words.number:
            self.reset()
        names = self.words.names[len(self.flags) :]
        if names:
            self.flags = np.concatenate([self.flags, np.fromiter(map(_flags, names), np.int16, len(names))])
            bare = [n.strip(tokens.SPACES).lower() for n in names]
            new = [self.term_no.setdefault(b, len(self.term_no)) if b.isalpha() and (len(b) >= self.least or not b.isascii()) else -1 for b in bare]
            self.terms = np.concatenate([self.terms, np.array(new, np.int64)])


def _levels(flags: np.ndarray) -> np.ndarray:
    """For the boundary before each word but the first: 4 paragraph, 3 line, 2 sentence, 1 lesser mark, 0 between words, -1 inside of a unit."""
    a, b = flags[:-1], flags[1:]
    brk = (a & BREAK) > 0
    two = np.zeros(len(a), bool)
    two[1:] = brk[1:] & ((flags[:-2] & BREAK) > 0)
    open_ = (b & LEAD) > 0
    out = np.where((a & SPACE) > 0, 0, np.where(open_, 0, -1))
    out = np.where((a & SOFT) > 0, np.where(open_ | ((b & TIGHT) == 0), 1, out), out)
    out = np.where(((a & END) > 0) & (open_ | ((a & WIDE) > 0)), 2, out)
    out = np.where(brk & ((b & BREAK) == 0), np.where(two, 4, 3), out)
    return out


def _cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each row the cosine of the term frequencies of two blocks; -1 is no term, a block without terms is like none.

    The inner product of two frequency vectors is the number of pairs of equal terms.
    """
    a, b = left.astype(np.int32), right.astype(np.int32)
    blank_a, blank_b = (a < 0).sum(1), (b < 0).sum(1)
    pairs = lambda x, y: np.count_nonzero(x[:, :, None] == y[:, None, :], axis=(1, 2))
    norms = (pairs(a, a) - blank_a**2) * (pairs(b, b) - blank_b**2)
    return np.where(norms > 0, (pairs(a, b) - blank_a * blank_b) / np.sqrt(np.maximum(norms, 1)), 0.0)


def _depths(pauses: np.ndarray, terms: np.ndarray, block: int) -> np.ndarray:
    """How deep the valley of word similarity is at each pause; pauses are word positions."""
    real = terms >= 0
    place = np.concatenate([[0], np.cumsum(real)])[pauses]
    kept = np.concatenate([np.full(block, -1), terms[real], np.full(block, -1)])
    sim: list[float] = []
    for at in range(0, len(place), 128):
        left = kept[place[at : at + 128, None] + np.arange(block)]
        right = kept[place[at : at + 128, None] + np.arange(block, 2 * block)]
        sim += _cosine(left, right).tolist()
    n = len(sim)
    up, down = [0.0] * n, [0.0] * n
    for i in range(n):
        up[i] = max(sim[i], up[i - 1]) if i and sim[i - 1] >= sim[i] else sim[i]
    for i in range(n - 1, -1, -1):
        down[i] = max(sim[i], down[i + 1]) if i < n - 1 and sim[i + 1] >= sim[i] else sim[i]
    return np.array(up) + np.array(down) - 2 * np.array(sim)


class _Text:
    """One oversized text: its words, where each starts in tokens and characters, and where it may be cut."""

    def __init__(self, ws: list[str], numbers: np.ndarray, words: tokens.Words, kinds: _Kinds, o: Cohesion):
        self.ws, self.words = ws, words
        self.ids = [words.ids[k] for k in numbers.tolist()]
        self.at = np.concatenate([[0], np.cumsum(words.counts[numbers])])
        self.chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)))])
        self.text = "".join(ws)
        flags = kinds.flags[numbers]
        self.tight = (flags & TIGHT) > 0
        self.level = _levels(flags)
        self.fill = o.fill
        self.pauses = np.flatnonzero(self.level >= 2) + 1
        self.depth = _depths(self.pauses, kinds.terms[numbers], o.block)

    def char(self, token: int, up: bool = False) -> tuple[int, int]:
        """The last place at or before a token (or the first at or after it) where a whole character ends: (token, character)."""
        w = int(np.searchsorted(self.at, token, side="right")) - 1
        if self.at[w] == token or w >= len(self.ws):
            return token, int(self.chars[w])
        ids, raw = self.ids[w], self.ws[w].encode()
        k = token - int(self.at[w])
        size = len(b"".join(self.words.encoder.bytes_of[t] for t in ids[:k]))
        while 0 < k < len(ids) and size < len(raw) and raw[size] & 0xC0 == 0x80:
            size += len(self.words.encoder.bytes_of[ids[k]]) if up else -len(self.words.encoder.bytes_of[ids[k - 1]])
            k += 1 if up else -1
        return int(self.at[w]) + k, int(self.chars[w]) + len(raw[:size].decode())

    def cut(self, low: int, half: int, high: int) -> int:
        """The token at which a piece ends: in (low, high], after half if a pause lies there; of several pauses the deepest valley, then the longest pause, then the last."""
        where = self.at[self.pauses]
        a, b, c = (int(np.searchsorted(where, x, side="right")) for x in (low, half, high))
        if a < c:
            best = max(range(b, c) if b < c else range(a, b), key=lambda i: (self.depth[i], self.level[self.pauses[i] - 1], i))
            return int(where[best])
        f, m, t = (int(np.searchsorted(self.at, x, side="right")) for x in (low, half, high))
        for least, first in ((1, m), (1, f), (0, f), (-1, f)):
            near = np.flatnonzero(self.level[max(first, 1) - 1 : t - 1] >= least)
            if len(near):
                return int(self.at[max(first, 1) + near[-1]])
        got, _ = self.char(high)
        return got if got > low else self.char(low + 1, up=True)[0]

    def fits(self, start: int, a: int, end: int, b: int, most: int) -> bool:
        """Whether the piece, taken as a text of its own, is within the limit; only a start inside of a word can make it differ."""
        w = int(np.searchsorted(self.at, start, side="right")) - 1
        if self.at[w] == start and not self.tight[w] and end - start <= most:
            return True
        words = self.words.splitter.find(self.text[a:b])
        n = sum(len(self.words.ids[k]) if (k := self.words.number.get(x)) is not None else len(next(self.words.encoder.encode_sorted([x.encode()]))) for x in words)
        return n <= most

    def pieces(self, most: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
        """(first token, first character, end token, end character) of each piece."""
        total, start, a, done, done_char = int(self.at[-1]), 0, 0, 0, 0
        while True:
            room = most
            while True:
                if total - start <= room:
                    end, b = total, len(self.text)
                else:
                    low = max(done, start + overlap + 3 if overlap and overlap + 3 < room else 0)  # what follows the shared part; a character has at most four tokens
                    end, b = self.char(self.cut(low, max(low, start + int(room * self.fill)), max(low + 1, start + room)))
                if end - start > room and start < done:  # what is shared leaves no room for a whole character
                    start, a = done, done_char
                elif room <= 1 or self.fits(start, a, end, b, most):
                    break
                else:
                    room -= max(1, room // 32)
            yield start, a, end, b
            if end >= total:
                return
            done, done_char = end, b
            back, back_char = self.char(max(end - overlap, 0))
            start, a = (back, back_char) if back > start else (end, b)


def pieces(documents: DataFrame, limits: DataFrame, o: Cohesion = Cohesion(), folder: str = tokens.FOLDER, name: str = tokens.NAME) -> DataFrame:
    """(doc_id, source, piece_no, n_pieces, start_token, end_token, start_char, end_char, text): the documents in pieces, piece_no from 0.

    limits has one row for each source: source, max_tokens (at least 1; a single character always fits where its tokens do), overlap_tokens
    (0 or more; at or above max_tokens it is taken as 0). Positions count the tokens and characters of the whole text. A piece of a text has at most max_tokens
    tokens, also when it is encoded by itself. Consecutive pieces share overlap_tokens tokens, or up to three more where the shared part would
    start inside of a character. Texts within the limit, null and empty texts, and texts of sources without a limit or of a null source come
    out whole as one piece.
    """
    rows = documents.select("doc_id", "source", "text").join(small(limits.select("source", "max_tokens", "overlap_tokens")), "source", "left")
    rows = rows.select("doc_id", "source", "max_tokens", "overlap_tokens", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.worker_words(folder, name)
        kinds = _Kinds(words, o.least)
        for batch in batches:
            texts, most, shared = batch.column(4).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for x, y in tokens.slices(texts):
                cut = words.split([t or "" for t in texts[x:y]])
                kinds.update()
                row, col = [], [[] for _ in range(7)]
                for k, ws in enumerate(cut, x):
                    numbers = words.numbers(ws)
                    total = int(words.counts[numbers].sum())
                    if most[k] is None or total <= most[k]:
                        found = [(0, 0, total, len(texts[k] or ""))]
                        parts = [texts[k]]
                    else:
                        limit = max(1, most[k])
                        overlap = shared[k] if shared[k] and 0 < shared[k] < limit else 0
                        found = list(_Text(ws, numbers, words, kinds, o).pieces(limit, overlap))
                        parts = [texts[k][a:b] for _, a, _, b in found]
                    row += [k] * len(found)
                    for no, ((s, a, e, b), part) in enumerate(zip(found, parts)):
                        for c, v in zip(col, (no, len(found), s, e, a, b, part)):
                            c.append(v)
                own = batch.select([0, 1]).take(pa.array(row, pa.int64()))
                kinds_ = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(col, kinds_))], names=["doc_id", "source", "piece_no", "n_pieces", "start_token", "end_token", "start_char", "end_char", "text"])

    key = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {key}, source string, piece_no int, n_pieces int, start_token bigint, end_token bigint, start_char bigint, end_char bigint, text string")
