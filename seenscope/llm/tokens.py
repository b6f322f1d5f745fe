"""Token ids of whole batches with a public word-level tokenizer.

White space never becomes a part of a token of this tokenizer, so a text's ids are those of
its words in order, and each distinct word is encoded once. Words of plain Latin letters,
digits and signs go through a byte-pair encoder with the same merges, many at a time; all
others, and words that may hold a special token, go through the tokenizer itself.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from seenscope.llm.words import Words

NAME = "word_bpe_49k.json"
END = 1  # token after each document
KNOWN_WORDS = 1 << 20  # words remembered by a worker; beyond, it starts anew

# Fixed value: how the tokenizer splits a lower-case text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = regex.compile(PIECE)
# Stands for the end of a word in the encoder; no word with this character goes there.
_MARK = "\x01"
_WORD_END = "</w>"


def tokenizer_path(name: str = NAME) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _alphabet() -> dict[str, int]:
    """Byte of each printable stand-in of the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _odd_bytes() -> np.ndarray:
    """Bytes that do not occur in words for the fast encoder."""
    odd = np.zeros(256, bool)
    odd[:0x21] = True
    odd[0x7F] = True
    odd[0xC9:] = True  # code points from 0x240
    odd[ord("|")] = True  # may be part of a special token
    return odd


class WordTokenizer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.full = Tokenizer.from_file(path)
        alphabet = _alphabet()
        ranks = {}
        self.closes = np.zeros(1 + max(model["vocab"].values()), bool)
        special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        for token, rank in model["vocab"].items():
            if token in special:
                continue
            core = token.removesuffix(_WORD_END)
            self.closes[rank] = core != token
            ranks[bytes(alphabet[c] for c in core) + (_MARK.encode() if core != token else b"")] = rank
        self.fast = tiktoken.Encoding(
            "words", pat_str=f"[^{_MARK}]*{_MARK}", mergeable_ranks=ranks, special_tokens={}
        )
        self.odd = _odd_bytes()
        self._forget()

    @staticmethod
    @cache
    def load(path: str) -> WordTokenizer:
        return WordTokenizer(path)

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes, sorted
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode_plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, count per word)`` of words that each end with a line feed."""
        marked = _PIECES.sub(r"\g<0>" + _MARK, text.lower())
        raw = np.frombuffer(marked.encode(), np.uint8)
        pieces = np.cumsum(raw == ord(_MARK))[raw == ord("\n")]
        ids = self.fast.encode_to_numpy(marked.replace("\n", ""), disallowed_special=())
        closed = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
        return ids, np.diff(closed[pieces], prepend=0)

    def _encode_new(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, count per word)`` of the words ``which``."""
        data, starts, ends = words.data, words.starts[which], words.ends[which]
        bad = self.odd[data]
        bad[:-1] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
        upto = np.concatenate([[0], np.cumsum(bad)])
        plain = upto[ends] == upto[starts]
        # The bytes of the plain words, each with the byte after it overwritten.
        length = (ends - starts)[plain] + 1
        close = np.cumsum(length) - 1
        at = np.arange(length.sum()) + np.repeat(ends[plain] - close, length)
        raw = np.append(data, np.uint8(0))[at]
        raw[close] = ord("\n")
        fast_ids, fast_counts = self._encode_plain(raw.tobytes().decode())
        others = [words.word(i) for i in which[~plain]]
        slow = [e.ids for e in self.full.encode_batch(others, add_special_tokens=False)]
        counts = np.zeros(len(which), np.int64)
        counts[plain] = fast_counts
        counts[~plain] = [len(x) for x in slow]
        ids = np.zeros(counts.sum(), np.uint32)
        of_plain = np.repeat(plain, counts)
        ids[of_plain] = fast_ids
        ids[~of_plain] = [i for x in slow for i in x]
        return ids, counts

    def _learn(self, words: Words, hashes: np.ndarray, first: np.ndarray) -> None:
        ids, counts = self._encode_new(words, first)
        at = np.cumsum(counts) - counts + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, counts])[order]

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts in order, number of ids per text)``"""
        hashes, first, which = np.unique(
            words.hashes(lower=False), return_index=True, return_inverse=True
        )
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            self._learn(words, hashes[new], first[new])
            place = np.searchsorted(self.known, hashes)
        size, at = self.size[place][which], self.at[place][which]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)
        counts = np.bincount(words.doc, size, words.n_docs).astype(np.int64)
        return self.ids[take], counts
