"""Token ids of whole texts, each distinct word encoded once.

Only for tokenizers whose pieces never cross ASCII white space, and that treat a word
alike wherever it stands; then a text's ids are its words' ids in a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from flowmill.llm.words import Slice

MAX_WORDS = 400_000  # kept between slices, in arrays of some 50 bytes a word
MAX_IDS = 3_000_000
TOGETHER = 200  # words encoded in one call


class WordIds:
    """Ids by word hash. ``encode`` gives, for a list of words, their ids in a row and how many each has.

    Known words are arrays: sorted hashes, each with its word's place in ``starts`` and ``counts``.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], lower: bool = False):
        self.encode, self.lower = encode, lower
        self._clear()

    def _clear(self):
        self.keys, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int32)  # slices with the word
        self.ids = np.zeros(0, dtype=np.uint32)

    def _shrink(self):
        """Forget the half of the words that fewest slices had; all, if what is left is long."""
        half = len(self.starts) // 2
        kept = np.sort(np.argpartition(-self.uses, half)[:half])
        starts, counts = self.starts[kept], self.counts[kept]
        if counts.sum() > MAX_IDS // 2:
            return self._clear()
        now = np.full(len(self.starts), -1, dtype=np.int64)
        now[kept] = np.arange(half)
        self.place = now[self.place]
        self.keys, self.place = self.keys[self.place >= 0], self.place[self.place >= 0]
        self.starts, self.counts, self.uses = np.cumsum(counts) - counts, counts, self.uses[kept]
        self.ids = self.ids[_spans(starts, counts)]

    def lookup(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word of each word, that word's place in ``starts`` and ``counts``)."""
        if len(self.keys) > MAX_WORDS or len(self.ids) > MAX_IDS:
            self._shrink()
        # Spelled-out special tokens are told apart by case, so only texts without them are folded.
        fold = self.lower and b"<|" not in part.data.tobytes()
        codes, distinct = pd.factorize(part.hashes(lower=fold))
        order = np.argsort(distinct)
        keys = distinct[order]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        where = np.empty(len(keys), dtype=np.int64)
        where[order[known]] = self.place[at[known]]
        new = order[~known]
        if len(new):
            first = np.empty(len(keys), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = part.data.tobytes()
            words = [raw[a:b].decode("utf-8", "replace")
                     for a, b in zip(part.starts[first[new]].tolist(), part.ends[first[new]].tolist())]
            flat, counts = self.encode(words)
            where[new] = len(self.starts) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int32)])
            self.ids = np.concatenate([self.ids, flat])
            self.place = np.insert(self.place, at[~known], where[new])
            self.keys = np.insert(self.keys, at[~known], keys[~known])
        self.uses[where] += 1
        return codes, where

    def texts(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, each text's bounds in them)."""
        inverse, where = self.lookup(part)
        counts = self.counts[where][inverse]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[_spans(self.starts[where][inverse], counts)], bounds[part.word_bounds]


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs of ``counts`` from ``starts`` on, in a row."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def joined_ids(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and the length of each."""
    counts = np.fromiter((len(x) for x in found), dtype=np.int64, count=len(found))
    return np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(counts.sum())), counts


def bpe_words(path: str, separator: str = "<|startoftext|>") -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encoder of word lists for a ``tokenizers`` file.

    Many words go in one call with a special token between them, which the library splits
    off before anything else; lists with words that may spell it out are encoded word by word.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    mark = tokenizer.token_to_id(separator)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [], []
        for at in range(0, len(words), TOGETHER):
            text = separator.join(words[at : at + TOGETHER])
            size = len(words[at : at + TOGETHER])
            if text.count("<|") == size - 1:
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                marks = np.flatnonzero(ids == mark)
                flat.append(ids[ids != mark])
                counts.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            else:
                found = tokenizer.encode_batch_fast(words[at : at + TOGETHER], add_special_tokens=False)
                ids, n = joined_ids([x.ids for x in found])
                flat.append(ids)
                counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    return encode
