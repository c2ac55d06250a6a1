"""Token ids of whole texts by way of their words: each distinct word is encoded once per worker."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and bytes of words and their ids, that a worker remembers; beyond either the words not seen of late are forgotten, which changes no result.
MEMORY, ROOM, EACH = 400_000, 64_000_000, 100
#: A word of more letters is encoded each time that it turns up.
LONGEST = 1_000
#: Letters of a long text that are split into words at once, and of texts that are together.
PIECE, STEP = 1_000_000, 4_000_000
#: Unknown words that the model gets in one call.
TOGETHER = 2_000


class Known:
    """Words and the bytes of their ids (little-endian uint32), as Arrow arrays; ``size``: what they take, with ``EACH`` bytes a word."""

    def __init__(self) -> None:
        self.words, self.raws, self.size = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), 0

    def __len__(self) -> int:
        return len(self.words)

    def items(self) -> Iterator[tuple[str, bytes]]:
        return zip(self.words.to_pylist(), self.raws.to_pylist())


class Memo(Known):
    """Words as they turn up; holds twice ``MEMORY`` words and ``ROOM`` bytes at most.

    ``apart`` parts words into two arrays whose ids follow each other, ``many`` encodes
    distinct words together; where it is left out ``encode`` does them one by one.
    """

    def __init__(self, encode: Callable[[str], bytes], split: Callable[[list[str]], pa.ListArray], apart: Callable[[pa.Array], tuple[pa.Array, pa.Array]] | None = None, many: Callable[[pa.Array], pa.Array] | None = None):
        super().__init__()
        self.many, self.split, self.apart, self.old = many or (lambda words: pa.array([encode(w) for w in words.to_pylist()], pa.large_binary())), split, apart, Known()

    def keep(self, words: pa.Array, raws: pa.Array) -> None:
        fit = pc.and_(pc.less_equal(pc.utf8_length(words), LONGEST), pc.greater(pc.binary_length(words), 0))
        words, raws = words.filter(fit), raws.filter(fit)
        sizes = np.cumsum(pc.add(pc.binary_length(words), pc.binary_length(raws)).to_numpy() + EACH)
        n = min(MEMORY, int(np.searchsorted(sizes, ROOM, "right")))
        if not n:
            return
        if len(self) + n > MEMORY or self.size + sizes[n - 1] > ROOM:
            self.old.words, self.old.raws = self.words, self.raws
            super().__init__()
        self.words, self.raws = pa.concat_arrays([self.words, words[:n]]), pa.concat_arrays([self.raws, raws[:n]])
        self.size += int(sizes[n - 1])

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words; those that aren't remembered are encoded together."""
        # the known ones look for theirs among these few, which takes less than a table of all that is known
        at = pc.index_in(pa.concat_arrays([self.words, self.old.words]), value_set=words)
        known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))[::-1]
        found = np.full(len(words), -1)
        found[at.fill_null(0).to_numpy()[known]] = known
        new = words.filter(pa.array(found < 0))
        raws = pa.concat_arrays([self.raws, self.old.raws, self.many(new)])
        found[found < 0] = np.arange(len(raws) - len(new), len(raws))
        got, late = raws.take(pa.array(found)), pa.array(found >= len(self))
        self.keep(words.filter(late), got.filter(late))
        return got

    def run(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are split at once; each of their distinct words is looked up once."""
        rows = self.split(texts)
        words = rows.flatten().dictionary_encode()
        if self.apart:
            n, parts = len(words.dictionary), pa.concat_arrays(self.apart(words.dictionary)).dictionary_encode()
            both = self.ids(parts.dictionary).take(parts.indices)
            raws = pc.binary_join_element_wise(both[:n], both[n:], pa.scalar(b"", pa.large_binary()))
        else:
            raws = self.ids(words.dictionary)
        _, ends, data = raws.take(words.indices).buffers()
        at = np.frombuffer(ends, np.int64)[rows.offsets.to_numpy()].tolist()
        raw = memoryview(data or b"")
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, by its words."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > STEP:
                yield from self.run(held)
                held, size = [], 0
            if len(text) <= PIECE:
                held.append(text)
                size += len(text)
            else:
                if held:
                    yield from self.run(held)
                    held, size = [], 0
                yield b"".join([self.run([p])[0] for p in pieces(text)])
        if held:
            yield from self.run(held)

    def forget(self) -> None:
        super().__init__()
        self.old = Known()


_memos: dict[str, Memo] = {}


def forget_words() -> None:
    """Leave the memory of all words to the tasks that follow in this worker; the tokenizers stay."""
    for memo in _memos.values():
        memo.forget()


#: Signs that are one pre-token with their like; what contractions and special tokens are made of is left out.
_SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Letters beyond this one, which a tokenizer's tables may not know, go through the library whole.
_LAST = "\u04ff"
#: Words of these letters alone, each lower-case and composed, need no closer look.
_COMMON = "^[a-zß-öø-ÿ]+$"

_PROBES = ("the", "thorreou", "größe", "été", "ñandú", "naïve", ".", "...", "%%%", "!?", "zzxxqq", "привет")


def tokenizers_memo(path: str) -> Memo:
    """Words for a tokenizer whose pre-tokenizer drops white space, so that no token depends on two words.

    Where it also marks word ends in its tokens, the letters of a simple word
    and the signs after them are looked up apart and go straight to the model,
    many in one call; all other words go through the library.
    """
    if path not in _memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        plain = Tokenizer(tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ending = getattr(tokenizer.model, "end_of_word_suffix", None)
        vocab = tokenizer.get_vocab() if ending else {}
        last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        last[[i for token, i in vocab.items() if token.endswith(ending)]] = True
        # white space parts the words that go together
        alphabet = {b: c for b, c in byte_alphabet().items() if b != 32}

        def single(word: str) -> bytes:
            return np.asarray(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

        def together(some: list[str]) -> tuple[bytes, np.ndarray]:
            """The ids of words, and where a word's ends among their bytes."""
            shown = " ".join(some)
            got = plain.encode_batch_fast([shown if shown.isascii() else shown.encode().decode("latin-1").translate(alphabet)], add_special_tokens=False)[0]
            ids = np.asarray(got.ids, "<u4")
            return ids.tobytes(), 4 * np.flatnonzero(last[ids]) + 4

        def straight(words: pa.Array) -> pa.Array:
            raws, ends, size = [], [np.zeros(1, np.int64)], 0
            for i in range(0, len(words), TOGETHER):
                some = words[i : i + TOGETHER].to_numpy(zero_copy_only=False).tolist()
                raw, at = together(some)
                if len(at) != len(some):  # a word that doesn't end in a token of word ends: the library says what it is
                    each = [*map(single, some)]
                    raw, at = b"".join(each), np.cumsum([len(x) for x in each])
                raws.append(raw)
                ends.append(at + size)
                size += len(raw)
            return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.concatenate(ends)), pa.py_buffer(b"".join(raws))])

        def simple(letters: pa.Array) -> np.ndarray:
            ok = pc.match_substring_regex(letters, _COMMON).to_numpy(zero_copy_only=False).copy()
            others = np.flatnonzero(~(ok | pc.string_is_ascii(letters).to_numpy(zero_copy_only=False)))
            ok[others] = [w.isalpha() and w.islower() and max(w) <= _LAST and w == w.lower() and unicodedata.is_normalized("NFC", w) for w in letters.take(pa.array(others)).to_numpy(zero_copy_only=False)]
            return ok

        def apart(words: pa.Array) -> tuple[pa.Array, pa.Array]:
            letters = pc.utf8_rtrim(words, characters=_SIGNS)
            letters = pc.if_else(pa.array(simple(letters)), letters, words)
            return letters, tails(words, letters)

        def encode(words: pa.Array) -> pa.Array:
            found = pc.equal(pc.utf8_rtrim(words, characters=_SIGNS), "").to_numpy(zero_copy_only=False) & (pc.binary_length(words).to_numpy() > 0) | simple(words)
            others = pa.array([single(w) for w in words.filter(pa.array(~found)).to_pylist()], pa.large_binary())
            at = np.empty(len(words), np.int64)
            at[np.concatenate([np.flatnonzero(found), np.flatnonzero(~found)])] = np.arange(len(words))
            return pa.concat_arrays([straight(words.filter(pa.array(found))), others]).take(pa.array(at))

        # lower-case letters and signs in bytes' own alphabet may go straight to the model, if it then says the same
        direct = ending and all(single(w) == together([w])[0] for w in _PROBES)
        lower = single("ABÇ") == single("abç")
        memo = _memos[path] = Memo(single, (lambda texts: split_words([lowered(t) for t in texts])) if lower else split_words, apart if direct else None, encode if direct else None)
    return _memos[path]


def byte_alphabet() -> dict[int, str]:
    """The letters that stand for bytes in byte-level models: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def lowered(text: str) -> str:
    """In lower case, where that is what lowering the normalised text letter by letter gives."""
    if text.isascii() or unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text:
        return text.lower()
    return text


def tails(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows in each word after its head."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset + 1 : words.offset + 1 + len(words)]
    size = pc.subtract(pc.binary_length(words), pc.binary_length(heads)).to_numpy()
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[np.repeat(ends - size - at[:-1], size) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(at), pa.py_buffer(data))


def split_words(texts: list[str]) -> pa.ListArray:
    """The words of each text. At spaces and line ends alone; other white space stays for the tokenizer to see to."""
    return pc.split_pattern(pa.array([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts], pa.large_string()), " ")


_WHITE = re.compile("[ \n\t\r]")


def pieces(text: str) -> Iterator[str]:
    """The text cut at white space after each ``PIECE`` letters, so that its words don't all stand in memory beside it."""
    at = 0
    while len(text) - at > PIECE and (cut := _WHITE.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text
