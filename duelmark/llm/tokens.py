"""Ids of whole texts by a public tokenizer file, one lookup per word."""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np

# endings that are a token run of their own after a letter or digit; no apostrophe, which may begin a contraction
ENDINGS = b".,;:!?*&%$#"


def resolve(path: str) -> str:
    """The file at ``path``, or the installed public tokenizer of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


class WordTokens:
    """Ids of texts for tokenizers that treat words between white space independently.

    The ids of each distinct word are kept in one pool, so a text costs a lookup per word; only unseen words
    reach the tokenizer. The pool starts afresh when it holds ``most`` words, so a worker's memory is bounded.
    """

    _own: dict[str, WordTokens] = {}

    @classmethod
    def shared(cls, path: str) -> WordTokens:
        """One per worker process and file, kept from task to task."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(resolve(path))
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.words = self.used = 0
        self.end = None         # the id that closes a text, entered as the empty word

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Enter words with their ids, one word's after the other's."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.words + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        own = slice(self.words, self.words + len(words))
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[own], self.lengths[own] = self.used + np.cumsum(lengths) - lengths, lengths
        self.index.update(zip(words, range(own.start, own.stop)))
        self.used += len(ids)
        self.words = own.stop

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the entries ``at``, one after the other."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, words: set[bytes]) -> None:
        ended, whole = [], set()
        for w in words:
            core = w.rstrip(ENDINGS)
            # a letter or digit ends its run of letters before the ending; other words stay whole
            if len(core) < len(w) and (core[-1:].isalnum() if core[-1:] < b"\x80" else core.decode()[-1].isalnum()):
                ended.append((w, core, w[len(core):]))
            else:
                whole.add(w)
        whole.update(core for _, core, _ in ended)
        whole.update({ending for _, _, ending in ended})
        fresh = [p for p in whole if p not in self.index]
        for begin in range(0, len(fresh), 4096):
            some = fresh[begin:begin + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(some, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)
        ended = [e for e in ended if e[0] not in self.index]
        if ended:
            parts = np.fromiter((self.index[p] for _, core, ending in ended for p in (core, ending)), np.int64, 2 * len(ended))
            self._add([w for w, _, _ in ended], self._gather(parts), self.lengths[parts].reshape(-1, 2).sum(axis=1))

    def __call__(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text closed by ``end_id``, and where each text ends."""
        if self.words > self.most:
            self._clear()
        # the tokenizer lower-cases too, but the strings of its special tokens are told by case
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if self.end != end_id:
            self._add([b""], np.array([end_id], np.uint32), np.array([1]))
            self.end = end_id
        for words in split:
            words.append(b"")
        line = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, line, repeat(-1)), np.int64, len(line))
        unseen = np.flatnonzero(at < 0).tolist()
        if unseen:
            self._learn({line[i] for i in unseen})
            at[unseen] = [self.index[line[i]] for i in unseen]
        flat, ends = self._gather(at), np.cumsum(self.lengths[at])
        last = np.cumsum([len(words) for words in split]) - 1
        return flat, ends[last] if len(last) else ends
