"""SentencePiece encoding and decoding with batched numpy: words of equal length advance together."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .hashing import mix

U = np.uint64
_M = U(0x9E3779B97F4A7C15)
SPACE = "▁"
#: Longer words are rare (no spaces for so long) and merged one by one with a heap.
LONG = 48
#: Words that a worker remembers; beyond them the ones not seen of late are forgotten, which changes no result.
MEMORY = 400_000
#: Characters of text whose words are looked up together.
STEP_CHARS = 1_000_000
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _fields(raw: bytes):
    """(number, value) of a protocol buffer's fields."""
    i = 0

    def number() -> int:
        nonlocal i
        v = s = 0
        while True:
            c = raw[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, raw[i : i + n]
            i += n


class Encoder:
    """Pieces of a model file: sorted hashes, ids and scores.

    A model of type unigram is encoded by Viterbi's best path. One of type BPE
    is encoded by merging, best pair first, since its scores are ranks whose
    sums mean nothing: the best path there isn't what the library gives.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(x for v in (v for k, v in model if k == 2) for x in _fields(v))
        norm = dict(x for v in (v for k, v in model if k == 3) for x in _fields(v))
        if norm.get(1, b"identity") != b"identity" or norm.get(4, 1):
            raise ValueError("only models without normalisation are read")
        self.bpe, self.prefix = trainer.get(3, 1) == 2, bool(norm.get(3, 1))
        self.text, self.byte, keys = [], {}, []
        self.unknown = 0
        for i, v in enumerate(v for k, v in model if k == 1):
            p = dict(_fields(v))
            piece, kind = p[1].decode(), p.get(3, 1)
            score = float(np.frombuffer(p.get(2, b"\0" * 4), "<f4")[0])
            if kind == 2:
                self.unknown = i
            if kind == 6:
                self.byte[int(piece[3:5], 16)] = i
            self.text.append(bytes([int(piece[3:5], 16)]) if kind == 6 else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else piece.replace(SPACE, " ").encode())
            if kind in (1, 4):
                keys.append((piece, i, score))
        words = [k[0] for k in keys]
        hashes = np.array([self._hash(np.array([[ord(c) for c in w]], U))[1](0, len(w))[0] for w in words], U)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array([k[1] for k in keys])[order]
        self.scores = np.array([k[2] for k in keys])[order]
        self.longest = max(map(len, words), default=1)
        self.rank = {k[0]: (k[2], k[1]) for k in keys}
        self.lowest = float(self.scores.min()) - 10 if len(keys) else -10.0
        if any(SPACE in w.lstrip(SPACE) for w in words):
            raise ValueError("a piece holds a space between other characters")

    @staticmethod
    def _hash(codes: np.ndarray):
        """Prefix hashes of rows of code points, and hash(i, j) of their substrings (i, j: numbers or arrays of a row's shape)."""
        rows, n = codes.shape
        h = np.zeros((rows, n + 1), U)
        for j in range(n):
            h[:, j + 1] = h[:, j] * _M + codes[:, j] + U(1)
        power = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, _M)]))

        def sub(i, j):
            if np.ndim(i) == 0:
                return mix(h[:, j] - h[:, i] * power[j - i] + U(j - i))
            r = np.arange(rows).reshape((-1,) + (1,) * (np.ndim(i) - 1))
            return mix(h[r, j] - h[r, i] * power[j - i] + (j - i).astype(U))

        return h, sub

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Places among the sorted keys, -1 for what is no piece."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG and self.bpe:
                out[i] = self.merge_long(w)
            elif w:
                by.setdefault(len(w), []).append(i)
        for n, which in by.items():
            for k in range(0, len(which), 4096):
                part = which[k : k + 4096]
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(U)
                bounds = self.merge(codes) if self.bpe else self.viterbi(codes)
                rows, flat = np.nonzero(bounds)  # by rows; the last character of each ends a piece
                starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(part)))])
                lo = np.concatenate([[0], flat[:-1] + 1])
                lo[starts[:-1]] = 0
                h = self._hash(codes)[0]
                power = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, _M)]))
                hashes = mix(h[rows, flat + 1] - h[rows, lo] * power[flat + 1 - lo] + (flat + 1 - lo).astype(U))
                at = self.probe(hashes)
                raw = self.ids[at].astype("<u4").tobytes()
                edges = (4 * starts).tolist()
                for i, x, y in zip(part, edges, edges[1:]):
                    out[i] = raw[x:y]
                for row in np.unique(rows[at < 0]).tolist():
                    got: list[int] = []
                    for k in range(starts[row], starts[row + 1]):
                        got += [int(self.ids[at[k]])] if at[k] >= 0 else self.fallback(words[part[row]][lo[k] : flat[k] + 1])
                    out[part[row]] = np.array(got, "<u4").tobytes()
        return out

    def fallback(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Best paths of all rows at once; marks[r, j]: a piece of row r ends with character j."""
        rows, n = codes.shape
        sub = self._hash(codes)[1]
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, n + 1), int)
        for j in range(1, n + 1):
            lo = max(0, j - self.longest)
            choice = np.full((rows, j - lo), -np.inf)
            for i in range(lo, j):
                at = self.probe(sub(i, j))
                score = np.where(at >= 0, self.scores[at], self.lowest if j - i == 1 else -np.inf)
                choice[:, i - lo] = best[:, i] + score
            pick = choice.argmax(1)
            best[:, j], back[:, j] = choice[np.arange(rows), pick], pick + lo
        marks, at = np.zeros((rows, n), bool), np.full(rows, n)
        while (live := at > 0).any():
            r = np.flatnonzero(live)
            marks[r, at[r] - 1] = True
            at[r] = back[r, at[r]]
        return marks

    def merge(self, codes: np.ndarray) -> np.ndarray:
        """Merges of all rows at once: in each round every row joins its best pair (the leftmost of equals)."""
        rows, n = codes.shape
        marks = np.ones((rows, n), bool)
        if n == 1:
            return marks
        h = self._hash(codes)[0]
        power = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, _M)]))
        who = np.arange(rows)
        bound = np.tile(np.arange(n + 1), (rows, 1))  # bounds of symbols, n where there are none

        def pairs(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            at = self.probe(mix(h[r, hi] - h[r, lo] * power[hi - lo] + (hi - lo).astype(U)))
            return np.where(at >= 0, self.scores[at], -np.inf)

        r = np.repeat(who, n - 1)
        score = pairs(r, bound[:, :-2].ravel(), bound[:, 2:].ravel()).reshape(rows, n - 1)
        while len(who):
            pick = score.argmax(1)
            top = score[np.arange(len(who)), pick]
            live = top > -np.inf
            if not live.all():
                for row in np.flatnonzero(~live):
                    marks[who[row]] = False
                    marks[who[row], bound[row][1:][bound[row][1:] > bound[row][:-1]] - 1] = True
                who, bound, score, pick = who[live], bound[live], score[live], pick[live]
                if not len(who):
                    break
            m = bound.shape[1]
            cols = np.arange(m - 1)
            bound = np.take_along_axis(bound, cols + (cols > pick[:, None]), 1)
            if m - 1 < 3:
                score = np.full((len(who), 1), -np.inf)
                continue
            cols = np.arange(m - 3)
            score = np.take_along_axis(score, cols + (cols > pick[:, None]), 1)
            for shift in (-1, 0):  # the pairs that hold the new symbol
                k = pick + shift
                ok = (k >= 0) & (k < m - 3)
                x = np.flatnonzero(ok)
                score[x, k[x]] = pairs(who[x], bound[x, k[x]], bound[x, k[x] + 2])
        return marks

    def merge_long(self, word: str) -> bytes:
        """The same for one word of any length, in n log n."""
        n = len(word)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[float, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and end[j] - i <= self.longest and (got := self.rank.get(word[i : end[j]])):
                heapq.heappush(heap, (-got[0], i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], nxt[i] = e, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        ids: list[int] = []
        for i in range(n):
            if alive[i]:
                got = self.rank.get(word[i : end[i]])
                ids += [got[1]] if got else self.fallback(word[i : end[i]])
        return np.array(ids, "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """Words with the spaces before them; no piece reaches over their bounds."""
        if not text:
            return []
        whole = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.prefix and SPACE * 2 not in whole:
            return [SPACE + w for w in whole[1:].split(SPACE)]
        return _RUNS.findall(whole)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


class Memo:
    """word -> bytes of its ids, filled by batches of new words."""

    def __init__(self, encoder: Encoder):
        self.encode, self.split, self.known, self.old = encoder.encode_words, encoder.split, {}, {}

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, by its words."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.split(text) if text else [])
            size += len(text or "")
            if size > STEP_CHARS:
                yield from self.join(held)
                held, size = [], 0
        yield from self.join(held)

    def join(self, held: list[list[str]]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = set().union(*held).difference(known)
        known.update((w, old[w]) for w in new.intersection(old))
        new = list(new.difference(old))
        known.update(zip(new, self.encode(new)))
        return [b"".join(map(known.__getitem__, words)) for words in held]


_memos: dict[str, tuple[Encoder, Memo]] = {}


def memo(path: str) -> tuple[Encoder, Memo]:
    if path not in _memos:
        encoder = Encoder(path)
        _memos[path] = encoder, Memo(encoder)
    return _memos[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids) of every whole text; ``ids``: little-endian uint32 bytes.

    Each worker encodes a distinct word once. Null and empty texts have no ids.
    Repeated ids give a row each; other columns are not read.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        _, words = memo(model)
        for batch in batches:
            raws = list(words.texts(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // 4 for r in raws], pa.int64()), pa.array(raws, pa.binary())], [id_col, "n_pieces", "ids"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, n_pieces long, ids binary")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_pieces, ids_crc32, text): back to text; U+2581 comes back as a space, bytes that are no UTF-8 as U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder, _ = memo(model)
        for batch in batches:
            raws = [r or b"" for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // 4 for r in raws], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64()), pa.array([encoder.decode(np.frombuffer(r, "<u4")) for r in raws], pa.string())], [id_col, "n_pieces", "ids_crc32", "text"])

    return encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, text string")
