"""Token ids of whole texts from a byte-level BPE vocabulary file, with a bounded per-worker cache of words.

In this kind of vocabulary no token crosses from a non-blank to a following blank, so a text may be cut there
and each cut piece tokenised alone; invented or rare words cost one call, frequent ones a dictionary lookup.
Texts with blanks that the two regular-expression engines may class differently are tokenised whole.

The ids are those of the ``tokenizers`` library for the same file.  Pieces of Latin script go through
``tiktoken`` when the folder has the same vocabulary as ranks (three times as fast, same ids); all others, and
pieces with a special token's string, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

_PIECES = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_LATIN = re.compile(r"[\x00-ɏ]*")
#: Pieces that a worker remembers, and their characters in all.
CACHED, CACHED_CHARS = 600_000, 1 << 24


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.exact.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = self._fast(re.sub(r"\.json$", ".tiktoken", path))
        self.reset()

    def _fast(self, ranks_path: str):
        if not os.path.exists(ranks_path):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.width = np.zeros(1 + max(ranks.values()), np.int64)
        self.width[list(ranks.values())] = [len(b) for b in ranks]
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def reset(self) -> None:
        self.at: dict[str | None, int] = {None: 0}  # None stands for the end of a document
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.store, self.used, self.chars = np.zeros(1 << 18, self.dtype), 1, 0
        self.size[0] = 1

    def encode(self, piece: str) -> list[int]:
        if self.fast is not None and self.plain(piece):
            return self.fast.encode_ordinary(piece)
        return self.exact.encode(piece, add_special_tokens=False).ids

    def plain(self, text: str) -> bool:
        """Latin script without the string of a special token."""
        return (text.isascii() or _LATIN.fullmatch(text) is not None) and not any(s in text for s in self.special)

    def _add(self, pieces: list[str], ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Remember pieces whose ids are ``size`` of ``ids`` from ``start``."""
        n, end = len(self.at), self.used + len(ids)
        while n + len(pieces) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while end > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : end] = ids
        self.start[n : n + len(pieces)] = self.used + start
        self.size[n : n + len(pieces)] = size
        self.at.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used, self.chars = end, self.chars + sum(map(len, pieces))

    def _each(self, pieces: list[str], encode: Callable[[str], list[int]]) -> None:
        """Encode pieces one by one."""
        found = [encode(p) for p in pieces]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._add(pieces, np.fromiter(chain.from_iterable(found), self.dtype, int(size.sum())), np.cumsum(size) - size, size)

    def _together(self, pieces: list[str]) -> None:
        """Encode plain pieces in one call: no token crosses from a non-blank to a blank, and widths tell whose each token is.

        Pieces without a blank before them stand after a newline, which is a token of its own there.  Pieces
        that end with a blank go one by one, and so do all if any end is not the end of a token.
        """
        blank = " \t\n\x0b\x0c\r"
        after, bare, rest = [], [], []
        for p in pieces:
            (rest if p[-1] in blank else after if p[0] in blank else bare).append(p)
        parts = [*after, *chain.from_iterable(("\n", p) for p in bare)]
        if parts:
            ids = np.array(self.fast.encode_ordinary("".join(parts)), np.int64)
            until = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in parts])
            ends = np.cumsum(self.width[ids])
            last = np.searchsorted(ends, until)
            if last[-1] >= len(ends) or (ends[last] != until).any():
                rest = pieces
            else:
                bound = np.concatenate([[0], last + 1])
                start, size = bound[:-1], np.diff(bound)
                own = np.concatenate([np.arange(len(after)), np.arange(len(after) + 1, len(parts), 2)])
                self._add([*after, *bare], ids.astype(self.dtype), start[own], size[own])
        if rest:
            self._each(rest, self.fast.encode_ordinary)

    def cut(self, text: str) -> list[str]:
        """Pieces of the text that are tokenised alone."""
        if not text:
            return []
        words = text.split()
        blanks = len(text) - sum(map(len, words))
        plain = text.count(" ") + text.count("\n")
        if blanks == plain == len(words) - 1 and "\x00" not in text:  # one space or newline between words, no other blank
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        data = text.encode()
        if blanks == len(data) - sum(map(len, data.split())):  # ASCII blanks only
            return _PIECES.findall(text)
        return [text]

    def ids(self, texts: Sequence[str | None], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end`` behind them if one is given."""
        if len(self.at) > CACHED or self.chars > CACHED_CHARS:
            self.reset()
        tail = [] if end is None else [None]
        cut = [[*self.cut(t or ""), *tail] for t in texts]
        plain = [self.fast is not None and self.plain(t or "") for t in texts]
        if new := set(chain.from_iterable(c for c, p in zip(cut, plain, strict=True) if p)).difference(self.at):
            self._together(list(new))
        if new := set(chain.from_iterable(c for c, p in zip(cut, plain, strict=True) if not p)).difference(self.at):
            self._each(list(new), self.encode)
        flat = list(chain.from_iterable(cut))
        where = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        if end is not None:
            self.store[0] = end
        size = self.size[where]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        every = self.store[np.repeat(self.start[where] - (ends - size), size) + np.arange(total)]
        until = np.concatenate([[0], ends])[np.cumsum([len(c) for c in cut])]
        return np.split(every, until[:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
