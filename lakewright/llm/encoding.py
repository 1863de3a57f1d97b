"""Exact tokenizer ids of texts, by pieces that are encoded once in a Python worker.

A piece ends where a character that is no white space is followed by a
space, tab or line end. The tokenizers here always begin a new
pre-token there, so the ids of a text are those of its pieces in order.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: White space that may not end a piece: libraries differ on it, so it stays inside.
_UNSURE = "\x0b\x0c\x1c-\x1f\x85\xa0  -     　"
_SPACE = " \t\n\r" + _UNSURE
PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:[{_UNSURE}][{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")


def pieces(text: str) -> list[str]:
    return PIECE.findall(text)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one thread, as Spark uses the other cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=8)
def encoder(path: str, drops_space: bool, limit: int = 500_000) -> "PieceIds":
    """One for all tasks of a Python worker."""
    return PieceIds(path, drops_space, limit)


class PieceIds(dict):
    """Piece -> number; ids of all numbers lie one after the other. At `limit` pieces the half that was used least goes.

    drops_space: the tokenizer drops white space and maps A-Z to lower case,
    so pieces are plain words, in lower case unless special tokens may be in the text.
    """

    def __init__(self, path: str, drops_space: bool = False, limit: int = 500_000) -> None:
        super().__init__()
        self.path, self.drops_space, self.limit, self.fresh = path, drops_space, limit, []
        self.sizes, self.starts, self.uses = (np.zeros(1024, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def __missing__(self, piece) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number

    def cut(self, data):
        if not self.drops_space:
            return pieces(data.decode("utf-8", "replace"))
        return (data if b"<|" in data else data.lower()).split()

    def encode(self, bodies: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end`, and how many each has."""
        numbers, lasts = self._numbers(bodies)
        sizes = self.sizes[numbers]
        ends = np.cumsum(np.concatenate([[0], sizes]))
        ids = self.ids[np.repeat(self.starts[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]
        stops = ends[lasts]
        lengths = np.diff(stops, prepend=0)
        if end is not None:
            ids, lengths = np.insert(ids, stops, end), lengths + 1
        return ids, lengths

    def counts(self, bodies: list[bytes]) -> np.ndarray:
        """How many ids each text has."""
        numbers, lasts = self._numbers(bodies)
        return np.diff(np.concatenate([[0], np.cumsum(self.sizes[numbers])])[lasts], prepend=0)

    def _numbers(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces, and where each text ends among them."""
        if len(self) > self.limit:
            self._forget()
        words, counts = [], []
        for data in bodies:
            found = self.cut(data)
            words += found
            counts.append(len(found))
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self._learn()
        self.uses[:len(self)] += np.bincount(numbers, minlength=len(self))
        return numbers, np.cumsum(np.array(counts, np.int64))

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.uses[:len(self)], kind="stable")[:self.limit // 2])
        names, sizes, starts = list(self), self.sizes[kept], self.starts[kept]
        self.clear()
        self.update((names[i], n) for n, i in enumerate(kept.tolist()))
        ends = np.cumsum(sizes)
        self.ids, self.used = self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())], int(sizes.sum())
        # Uses count half, so that what was frequent long ago goes as well.
        self.sizes, self.starts, self.uses = sizes, ends - sizes, self.uses[kept] // 2

    def _learn(self) -> None:
        """Ids of fresh pieces. One that ends in punctuation is a word, which may be known, and the punctuation."""
        if not self.fresh:
            return
        marks, pattern = (_MARK_BYTES, _ENDED_BYTES) if self.drops_space else (_MARK_SET, _ENDED)
        whole, joined = [], []
        for piece in self.fresh:  # grows as words and punctuation are met
            if piece and piece[-1] in marks and (found := pattern.fullmatch(piece)):
                joined += (self[piece], self[found[1]], self[found[2]])
            else:
                whole.append(piece)
        self.sizes, self.starts, self.uses = (_room(a, len(self)) for a in (self.sizes, self.starts, self.uses))
        first = len(self) - len(self.fresh)
        numbers = np.arange(first, len(self))
        if joined:
            number, *parts = np.array(joined, np.int64).reshape(-1, 3).T
            numbers = np.delete(numbers, number - first)
        ids, sizes, order = _ids_of(self.path, whole, self.drops_space)
        self._add(numbers[order], ids, sizes)
        if joined:
            parts = np.stack(parts, axis=1).ravel()
            sizes = self.sizes[parts]
            ends = np.cumsum(sizes)
            ids = self.ids[np.repeat(self.starts[parts] - ends + sizes, sizes) + np.arange(sizes.sum())]
            self._add(number, ids, sizes.reshape(-1, 2).sum(axis=1))
        self.fresh = []

    def _add(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = _room(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.sizes[numbers], self.starts[numbers] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)


#: A piece of which nothing but ASCII punctuation follows a letter: pre-tokens end between the two. Special tokens stay whole.
#: U+0130 is left out: its lower case ends in a mark that is no letter.
_LETTER, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f", r"[!-/:-@\[-`{-~]+"
_ENDED = re.compile(rf"((?:(?!<\|).)*[{_LETTER}])({_MARKS})", re.DOTALL)
_ENDED_BYTES = re.compile(rb"((?:(?!<\|).)*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf]))(" + _MARKS.encode() + rb")", re.DOTALL)
_MARK_SET = frozenset(re.findall(_MARKS[:-1], "".join(map(chr, range(128)))))
_MARK_BYTES = frozenset(map(ord, _MARK_SET))
#: Pieces that are encoded as one text.
_GROUP = 512


@lru_cache(maxsize=4)
def _widths(path: str) -> np.ndarray:
    """How many bytes of the normalised text each id of a byte-level vocabulary stands for."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    found = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, number in vocabulary.items():
        found[number] = len(token.removesuffix("</w>"))
    return found


def _ids_of(path: str, pieces_: list, drops_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces, how many each has, and which pieces these are.

    Many are encoded as one text, and cut where their bytes end; where an
    end lies inside a token, or the bytes differ, each is encoded by itself.
    """
    encode, widths = tokenizer(path).encode_batch_fast, _widths(path)
    if drops_space:
        alone = [n for n, p in enumerate(pieces_) if b"<|" in p or not p]
    else:
        alone = [n for n, p in enumerate(pieces_) if "<|" in p or p[0] not in " \t\n\r" or p[-1] in _SPACE]
    out, sizes, order = [], [], []
    plain = np.delete(np.arange(len(pieces_)), alone).tolist()
    groups = [plain[i:i + _GROUP] for i in range(0, len(plain), _GROUP)]
    joined, lengths = [], []
    for group in groups:
        own = [pieces_[n] for n in group]
        if drops_space:
            joined.append(b" ".join(own).decode("utf-8", "replace"))
            lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
        else:
            joined.append("".join(own))
            lengths.append(np.fromiter((len(p.encode()) for p in own), np.int64, len(own)))
    for group, length, own in zip(groups, lengths, encode(joined, add_special_tokens=False)):
        ids = np.array(own.ids, np.uint32)
        ends, wanted = np.cumsum(widths[ids]), np.cumsum(length)
        cuts = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[cuts], wanted):
            out.append(ids)
            sizes.append(np.diff(cuts, prepend=-1))
            order += group
        else:
            alone += group
    texts = [pieces_[n].decode("utf-8", "replace") if drops_space else pieces_[n] for n in alone]
    for own in encode(texts, add_special_tokens=False):
        out.append(np.array(own.ids, np.uint32))
        sizes.append(np.array([len(own.ids)], np.int64))
    if not order and not alone:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(sizes), np.array(order + alone, np.int64)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])
