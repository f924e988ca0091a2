"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

#: Texts are cut at white space, and before the full stops and commas that follow a letter, which are pieces of their
#: own. The tokenizer cuts there as well and never looks across, so the ids of a text are the ids of its pieces in turn.
#: Python also counts four separators as white space that the tokenizer does not.
_GAPS = re.compile("[ \n\t\r]+")
_NOT_GAPS = "\x1c\x1d\x1e\x1f"
_ENDS = re.compile("(?<=[a-zß-öø-ÿ])[.,]")
CACHED_PIECES, CACHED_CHARS = 1 << 19, 40


def default_tokenizer() -> str:
    """Path of the word-level BPE file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split(text: str | None) -> list[str]:
    """The pieces of a text that are encoded on their own, A-Z lower-cased as the tokenizer does itself.

    Texts with ``<|`` are cut at white space only: they may hold special tokens, which are matched before that.
    """
    if not text:
        return []
    if "<|" not in text:
        text = _ENDS.sub(r" \g<0>", text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    return _GAPS.split(text) if any(c in text for c in _NOT_GAPS) else text.split()


class WordIds(dict):
    """Pieces to their ids as little-endian unsigned 32-bit bytes; a bounded number of them stays in memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()

    def __missing__(self, piece: str) -> bytes:
        """Long and unusual pieces, one at a time and not kept."""
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces in one call and share the ids out by where each one's text lies."""
        if len(self) >= CACHED_PIECES:
            self.clear()
        new = [w for w in pieces if w not in self and 0 < len(w) <= CACHED_CHARS and "<|" not in w and is_normalized("NFC", w)]
        for lo in range(0, len(new), 20_000):
            some = new[lo:lo + 20_000]
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = np.searchsorted([a for a, _ in found.offsets], starts)
            self.update((w, ids[cuts[i]:cuts[i + 1]].tobytes()) for i, w in enumerate(some))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts in turn; a null text is empty."""
        for some in _by_size(texts):
            pieces = [split(t) for t in some]
            self.learn(set().union(*pieces))
            for found in pieces:
                yield b"".join(map(self.__getitem__, found))


def _by_size(texts: Iterable[str | None], chars: int = 1 << 21) -> Iterator[list[str | None]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache for each Python worker, kept between its tasks."""
    return WordIds(path)
