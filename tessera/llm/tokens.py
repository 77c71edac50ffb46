"""Token ids of whole texts by the tokenizers library, encoded once per distinct word or piece.

A text of nothing but Latin letters, digits, ASCII punctuation and white space is split as the library does, and its
ids are those of its words, which are kept in a bounded cache.

In other texts, a byte-level BPE vocabulary splits before a space that follows a character other than white space, whatever
stands around it, so the ids of a text are those of its pieces between single spaces, each with its space before
it. Ids of pieces are kept in a bounded cache. Where runs of white space would make a piece depend on its
neighbours, or the text has a special token's string, the whole text goes to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

from tessera.llm.common import give_back

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: The library's own splitting, for the characters named here; in a text that has others, these words don't cover it.
WORDS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[!-/:-@\[-`{-~]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: White space that takes in a space on either side of which the split depends on the neighbours.
LINKED = re.compile(r"\s (?:\s|\Z)")
#: Letters, then punctuation, on one line or two: words of the library's own splitting, taken straight to its BPE model.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*#$%&|]*)(?:\n([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*#$%&|]*))?")
CAPACITY = 250_000


class Cache(dict):
    """Values of a function by its argument; emptied when it is full."""

    def __init__(self, make: Callable[[str], bytes], capacity: int):
        super().__init__()
        self.make, self.capacity = make, capacity

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.capacity:
            self.clear()
        value = self[key] = self.make(key)
        return value


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def splits_by_piece(kind: dict) -> bool:
    """Whether a vocabulary file has the splitting that pieces and prefix counts rely on."""
    before = kind["pre_tokenizer"] or {}
    by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return kind["model"]["type"] == "BPE" and not kind["normalizer"] and by_words


class PieceEncoder:
    """Encodes texts into little-endian ids, as bytes of `code` ('H' or 'I') an id."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        with open(vocabulary_path(vocabulary)) as f:
            kind = json.load(f)
        self.by_piece = splits_by_piece(kind)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in kind["added_tokens"]) or r"(?!)")
        self.has_special = bool(kind["added_tokens"])
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.words = Cache(self._word, capacity)
        self.pieces = Cache(lambda piece: self._piece(piece, " "), capacity)

    def forget(self) -> None:
        """Give the caches' memory back, at the end of a task: the next one sees other texts, and the worker may wait for long."""
        self.words.clear()
        self.pieces.clear()
        give_back()

    def _library(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word of the library's splitting."""
        written = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.library.model.tokenize(written)]).tobytes()

    def _piece(self, piece: str, lead: str) -> bytes:
        if not (m := SIMPLE.fullmatch(piece)):
            return self._library(lead + piece)
        ids = self.words[lead + m[1]]
        if m[2]:
            ids += self.words[m[2]]
        if m[3]:
            ids += self.words["\n"] + self.words[m[3]]
            if m[4]:
                ids += self.words[m[4]]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, without any added at its ends."""
        if not self.by_piece or self.has_special and self.special.search(text):
            return self._library(text)
        words = WORDS.findall(text)
        if sum(map(len, words)) == len(text):
            return b"".join(map(self.words.__getitem__, words))
        if LINKED.search(text):
            return self._library(text)
        first, *rest = text.split(" ")
        return (self._piece(first, "") if first else b"") + b"".join(map(self.pieces.__getitem__, rest))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> PieceEncoder:
    """The worker process's encoder; loading it takes longer than a small task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = PieceEncoder(vocabulary)
    return _ENCODERS[vocabulary]
