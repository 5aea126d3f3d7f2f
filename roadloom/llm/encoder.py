"""Tokenizers inside tasks, with each distinct piece of text encoded once per worker."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: Distinct pieces a worker remembers; when they are more, it forgets all and goes on.
MEMORY = 500_000
#: So many new pieces are encoded as one text.
CHAIN = 250
_RUNS = re.compile(r"\s\s")
_GAP = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str) -> list[str]:
    """Cut a text at every single space between two characters that are no white space.

    A byte-level pattern always starts a new word there, so the ids of the text are those of its pieces, one after another.  A piece
    goes by its text without the space before it; the first one has none and is marked by a line break, with which no other starts.
    """
    words = text.split()
    if " ".join(words) != text or not words:
        ragged = _RUNS.search(text) or text[:1].isspace() or text[-1:].isspace()
        words = _GAP.split(text) if ragged else text.split(" ")
    words[0] = "\n" + words[0]
    return words


def _written(piece: str) -> str:
    return piece[1:] if piece[0] == "\n" else " " + piece


def _widths(tokenizer) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for: its pieces are written with one character a byte."""
    width = {i: len(token) for token, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    width |= {i: len(token.content.encode()) for i, token in tokenizer.get_added_tokens_decoder().items()}
    out = np.zeros(max(width) + 1, np.int64)
    out[list(width)] = list(width.values())
    return out


class _Places(dict):
    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        return at


class Encoder:
    """Encodes texts piece by piece; equal to encoding each whole text with add_special_tokens=False."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.widths = _widths(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.places, self.ids, self.sizes = _Places(), [], np.zeros(0, np.int64)
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encode the pieces that came since the last time.  Those after a space are put one after another into texts;
        the bytes of their ids tell where each piece ends.  A text in which they don't is encoded again piece by piece."""
        new = list(islice(self.places, len(self.sizes), None))
        if not new:
            return
        alone = [i for i, p in enumerate(new) if p[0] == "\n" or p[-1].isspace()]
        other = set(alone)
        plain = [i for i in range(len(new)) if i not in other]
        sizes, starts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        flat, at = [self.flat], len(self.flat)
        chains = [plain[i : i + CHAIN] for i in range(0, len(plain), CHAIN)]
        for chain, got in zip(chains, self._ids([" " + " ".join([new[i] for i in c]) for c in chains]), strict=True):
            ends, wanted = np.cumsum(self.widths[got]), np.cumsum([len(new[i].encode()) + 1 for i in chain])
            last = np.searchsorted(ends, wanted)
            if not len(ends) or ends[-1] != wanted[-1] or (ends[last] != wanted).any():
                alone += chain
                continue
            sizes[chain] = np.diff(last, prepend=-1)
            starts[chain] = at + last + 1 - sizes[chain]
            flat.append(got)
            at += len(got)
        for i, got in zip(alone, self._ids([_written(new[i]) for i in alone]), strict=True):
            sizes[i], starts[i] = len(got), at
            flat.append(got)
            at += len(got)
        self.flat = np.concatenate(flat)
        self.sizes, self.starts = np.concatenate([self.sizes, sizes]), np.concatenate([self.starts, starts])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def places_of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > MEMORY:
            self._forget()
        out = []
        for text in texts:
            cut = pieces(text)
            out.append(np.fromiter(map(self.places.__getitem__, cut), np.int64, len(cut)))
        self._learn()
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        return [int(self.sizes[p].sum()) for p in self.places_of(texts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [gather(self.flat, self.starts, self.sizes, p) for p in self.places_of(texts)]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that ``places`` name, one after another."""
    n = sizes[places]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts[places] - (ends - n), n)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
