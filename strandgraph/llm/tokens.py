"""Token ids of whole texts, remembered by word within a worker.

The tokenizer drops white space before it merges, and none of its rules looks across white space: the ids of a
text are the ids of its words, one after the other. Words recur, so a bounded memory of words saves most calls.

Ids are those of the tokenizer as its file has it: the content of an added token, wherever it stands in a text, is that
token's id. Such contents hold no white space, so a word that contains one goes to the tokenizer as it is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

from strandgraph.llm.shared import kept

#: White space to str.split() that the tokenizer takes for ordinary signs.
ODD = "\x1c\x1d\x1e\x1f"
#: What stands between white space as the tokenizer sees it.
WORD = re.compile(f"[\\S{ODD}]+")
#: The tokenizer's split of an ASCII word in lower case (a fixed value of its file, over ASCII).
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def words(text: str) -> list[str]:
    """The pre-tokens of a text, in order."""
    return WORD.findall(text) if any(c in text for c in ODD) else text.split()


def packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordMemo(dict):
    """word -> its ids as little-endian uint16 bytes. Holds at most two generations of ``most`` words."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or len(t.content.split()) != 1 or t.content.strip() != t.content for t in added):
            raise ValueError("an added token may reach beyond its word")
        self.marks = [t.content for t in added]
        self.most, self.older, self.letters = most, {}, _byte_letters()
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.encode(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got

    def encode(self, word: str) -> bytes:
        if any(m in word for m in self.marks) or any(c in word for c in ODD):
            return self.whole(word)
        if word.isascii():
            if word.isprintable():
                word = word.lower()
                if word.isalpha():
                    return packed([t.id for t in self.merge(word)])
                return b"".join([self.get(p) or packed([t.id for t in self.merge(p)]) for p in _ASCII.findall(word)])
        elif word.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word):
            seen = "".join(map(self.letters.__getitem__, word.lower().encode()))
            if unicodedata.is_normalized("NFC", word.lower()) and word.lower().isalpha():
                return packed([t.id for t in self.merge(seen)])
        return self.whole(word)

    def whole(self, text: str) -> bytes:
        """By the tokenizer's own front door."""
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null reads as empty."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, words(text)))


def memo(path: str) -> WordMemo:
    """One for each vocabulary and worker process."""
    own = kept("tokens")
    if path not in own:
        own[path] = WordMemo(path)
    return own[path]
