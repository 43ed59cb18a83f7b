"""Whole texts to token ids with a public tokenizer, a batch's distinct pieces at a time."""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

VOCABULARY = "word_bpe_49k.json"


#: A word of Latin-1 letters, and perhaps a punctuation mark.
PLAIN = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+[,.!?;:]?$"
MARKS = ",.!?;:"


def load(path: str):
    """A tokenizer that uses one thread: tasks are Spark's, and the library's threads would wait on each other's cores."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts, equal to the tokenizer's own, with each distinct piece encoded once.

    The tokenizer drops white space and never joins across it, its normaliser composes
    nothing with a space and lower-cases character by character, so a text's ids are its
    pieces' ids in order. Arrow cuts a batch of texts at ASCII white space (any other
    white space stays within a piece) and numbers its distinct pieces. Letters of Latin-1
    alone, in lower case, are one composed pre-token, so the model takes them without the
    normaliser and the splitter; one punctuation mark after them is a pre-token of its
    own. Any other piece goes through the whole tokenizer.

    What is known is bounded: at ``most`` pieces, those that were met in a single batch
    are forgotten, and all are if that leaves too many.
    """

    def __init__(self, path: str, most: int = 300_000, plain: bool = False):
        self.tokenizer, self.most = load(path), most
        self.tokenizer.encode_special_tokens = plain  # true: special tokens' strings are ordinary text
        # How the byte-level step writes each byte, asked of the library itself.
        self.letters = {chr(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(170, 256) if chr(c).isalpha()}
        self.tails = np.array([self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in MARKS] + [0], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.others: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.lengths, self.met = (np.zeros(0, np.int32) for _ in range(3))

    def forget(self) -> None:
        """Keeps the pieces that more than one batch had."""
        kept = self.met > 1
        if kept.sum() > self.most // 2:
            return self.clear()
        number = np.cumsum(kept) - 1
        self.words, self.others = ({p: int(number[i]) for p, i in d.items() if kept[i]} for d in (self.words, self.others))
        n = self.lengths[kept]
        self.flat = self.flat[spread(self.starts[kept], n)]
        self.starts, self.lengths, self.met = (np.cumsum(n) - n).astype(np.int32), n, self.met[kept] // 2

    def word_ids(self, words: list[str]) -> list[list[int]]:
        text, tokenize = "\n".join(words), self.tokenizer.model.tokenize
        # In ascending order: what a letter is written as has no letter that comes later.
        for c in sorted(set(text) & self.letters.keys()):
            text = text.replace(c, self.letters[c])
        return [[t.id for t in tokenize(w)] for w in text.split("\n")]

    def other_ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def numbers(self, pieces: list[str], known: dict[str, int], encode) -> np.ndarray:
        """The number of each of distinct pieces; new ones are learned."""
        out = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        if len(new):
            names, n = [pieces[i] for i in new], len(self.met)
            got = encode(names)
            sizes = np.fromiter(map(len, got), np.int32, len(got))
            out[new] = np.arange(n, n + len(new))
            known.update(zip(names, range(n, n + len(new))))
            self.starts = np.append(self.starts, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32))
            self.lengths, self.met = np.append(self.lengths, sizes), np.append(self.met, np.zeros(len(new), np.int32))
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())))
        self.met[out] += 1
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all texts in order, number of ids of each); a null text has none."""
        if len(self.met) > self.most:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        pieces, code = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(pieces, PLAIN)
        words, is_word = pieces.filter(plain), plain.to_numpy(zero_copy_only=False)
        bare = pc.utf8_lower(pc.utf8_rtrim(words, characters=MARKS)).dictionary_encode()
        number, tail = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(MARKS))
        number[is_word] = self.numbers(listed(bare.dictionary), self.words, self.word_ids)[bare.indices.to_numpy()]
        last = pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array(list(MARKS)))
        tail[is_word] = pc.fill_null(last, len(MARKS)).to_numpy(zero_copy_only=False)
        number[~is_word] = self.numbers(listed(pieces.filter(pc.invert(plain))), self.others, self.other_ids)
        marked = (tail < len(MARKS))[code]
        number = number[code]
        n = self.lengths[number] + marked
        ends = np.cumsum(n, dtype=np.int64)
        # A mark's place is read as what follows the word, and then set.
        ids = np.append(self.flat, np.uint32(0))[spread(self.starts[number], n)]
        ids[ends[marked] - 1] = self.tails[tail[code[marked]]]
        return ids, np.diff(np.append(0, ends)[offsets - offsets[0]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text (null: none)."""
        ids, sizes = self.encode_batch(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []


def listed(strings: pa.Array) -> list[str]:
    """The values as a list; by way of numpy, which makes them faster than one by one."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts`` and have ``sizes`` members, one run after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def slices(texts: pa.Array, most: int = 1 << 22):
    """(first row, rows) of slices of a string column with about ``most`` bytes each, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, end - at
        at = end


def closed(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes with the id ``end`` after each text."""
    return np.insert(ids, np.cumsum(sizes), np.uint32(end)), sizes + 1


def packed(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value a text: its ids as little-endian unsigned integers, of 16 bits if all fit, else of 32."""
    kind = "<u2" if not len(ids) or int(ids.max()) < 1 << 16 else "<u4"
    offsets = np.append(0, np.cumsum(sizes)) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids.astype(kind))])


def encoder(path: str | None = None, plain: bool = False, most: int = 300_000) -> WordIds:
    """This worker's encoder of at most ``most`` known pieces; ``path`` defaults to the public vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    cache = worker_cache()
    if ("encoder", path, plain, most) not in cache:
        cache["encoder", path, plain, most] = WordIds(path, most, plain)
    return cache["encoder", path, plain, most]
