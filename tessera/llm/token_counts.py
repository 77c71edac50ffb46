"""Exact token counts of every prefix by dynamic programming, without re-encoding.

For a word of the vocabulary's splitting, let count[i] be the tokens of its first i bytes and last[i] the last of
them. The last token of a prefix is the one token t ending there that byte-pair encoding keeps apart from
last[i - len(t)]: then count[i] = count[i - len(t)] + 1. One pass over the bytes so gives the exact count of all
prefixes of a word, however long. Whether two tokens stay apart is found once per pair and kept.

A text is cut into pieces at each space or other white space that follows a character that is not white space:
no token crosses such a place, in the text or in any prefix of it. A document's store is, for every code point,
how much the count changes by it, as signed bytes (32-bit integers where a change does not fit). Sums of it
answer budget and truncation questions. Counts may fall from one prefix to the next, as tokens merge.

Nulls: a null text is the empty text with no tokens; a null doc_id is carried. Repeated rows are counted each.
Whole texts of any length are counted. An empty table gives no rows. Only doc_id and text are read, whatever other
columns are called. A vocabulary file of another kind of splitting is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, store, text_or_empty
from tessera.llm.tokens import DEFAULT_VOCABULARY, Cache, byte_letters, splits_by_piece, vocabulary_path

LIMIT = 512
CAPACITY, PAIRS = 500_000, 600_000
#: The vocabulary's white space leaves out the separators 1C to 1F, which Python's has.
_WHITE, _SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# The splitting of byte-level vocabularies.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{_WHITE})[^\p{{L}}\p{{N}}])+|{_WHITE}+(?!{_SOLID})|{_WHITE}+")
PIECES = regex.compile(rf"{_WHITE}*{_SOLID}+|{_WHITE}+")
HEAD = regex.compile(rf"{_WHITE}*")
#: Letters, then punctuation: two words of the splitting.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*#$%&|]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*#$%&|]*))?")
#: White space before a space; the separators 1C to 1F make no difference here.
SPACED = re.compile(r"\s ")
STORE = "doc_id long, n_bytes long, n_tokens long, width int, changes binary"


class Vocabulary:
    """Tokens by their bytes, and the merges of byte-pair encoding by rank."""

    def __init__(self, name: str = DEFAULT_VOCABULARY):
        with open(vocabulary_path(name)) as f:
            kind = json.load(f)
        if not splits_by_piece(kind):
            raise ValueError(f"{name}: the vocabulary's splitting is not the one that prefixes are counted by")
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in kind["added_tokens"]}
        self.strings = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.strings)))
        self.ids = {bytes(byte[c] for c in t): i for t, i in kind["model"]["vocab"].items() if t not in special}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        letter = byte_letters()
        self.single = [kind["model"]["vocab"][letter[b]] for b in range(256)]
        self.merges, self.rank, self.parts = {}, dict.fromkeys(self.single, -1), {}
        of = kind["model"]["vocab"]
        for rank, pair in enumerate(kind["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = of[left + right]
            self.merges[of[left], of[right]] = rank, new
            self.rank[new], self.parts[new] = rank, (of[left], of[right])
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Byte-pair encoding of a few bytes."""
        ids, none = [self.single[b] for b in data], (1 << 60, -1)
        while len(ids) > 1:
            found = [self.merges.get(pair, none) for pair in zip(ids, ids[1:])]
            best = min(found)
            if best is none:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
        return ids

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether byte-pair encoding of both tokens' bytes gives these tokens.

        Goes back in time: the later of the merges that made the two tokens at the border is undone. If the two
        then at the border merge earlier than what was undone, the border would not have stayed. Of equal merges
        the one further left comes first.
        """
        key = left, right
        if (found := self.apart.get(key)) is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            before, rank = 1 << 60, self.rank
            while True:
                merge = self.merges.get((left, right))
                if merge and merge[0] < before:
                    found = False
                    break
                if rank[left] > rank[right]:
                    before, left = rank[left], self.parts[left][1]
                elif rank[right] >= 0:
                    before, right = rank[right] + 1, self.parts[right][0]
                else:
                    found = True
                    break
            self.apart[key] = found
        return found

    def is_whole(self, token: int) -> bool:
        if (found := self.whole.get(token)) is None:
            found = self.whole[token] = self.merged(self.bytes[token]) == [token]
        return found

    def counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a word, from the empty one to the whole."""
        count, last, ids = [0], [-1], self.ids
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ids.get(word[start:end])
                if token is not None and (self.stays_apart(last[start], token) if start else self.is_whole(token)):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return count


def _packed(counts: list[int]) -> bytes:
    """Changes between counts as signed bytes."""
    changes = [b - a for a, b in zip(counts, counts[1:])]
    if changes and (max(changes) > 127 or min(changes) < -128):
        raise OverflowError("a change of the count does not fit a byte")
    return bytes([c & 255 for c in changes])


def _sum(changes: bytes) -> int:
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))


class PrefixCounter:
    """Changes of the count by code point, for whole texts."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY):
        self.vocabulary = Vocabulary(vocabulary)
        self.words = Cache(self._word, capacity)
        self.pieces = Cache(lambda piece: self._piece(f" {piece}"), capacity)  # by what follows a space

    def _word(self, word: str) -> bytes:
        """Changes by each code point of one word of the splitting."""
        counts = self.vocabulary.counts(word.encode())
        if not word.isascii():
            counts = [0] + [counts[e] for e in np.cumsum([len(c.encode()) for c in word]).tolist()]
        if word in ("'re", "'ve", "'ll"):  # "'r" is two words
            counts[2] = 1 + _sum(self.words[word[1]])
        return _packed(counts)

    def _segment(self, text: str) -> bytes:
        """Changes within white space and what follows it up to the next, as they are after a solid character."""
        blank = HEAD.match(text).end()
        if blank == len(text):
            return self.words[text]
        if blank < 2:
            head = b"" if text[:1] == " " or not blank else self.words[text[0]]
            return head + b"".join(map(self.words.__getitem__, WORDS.findall(text[1:] if head else text)))
        # The white space is one word while nothing follows it; then its last character leaves it.
        space, rest = self.words[text[:blank]], text[blank:]
        if text[blank - 1] == " ":
            base = _sum(self.words[text[: blank - 1]])
            solid = b"".join(map(self.words.__getitem__, WORDS.findall(" " + rest)))
            first = base + _sum(solid[:2]) - _sum(space)
            return space + _packed([0, first]) + solid[2:]
        base = _sum(self.words[text[: blank - 1]]) + _sum(self.words[text[blank - 1]])
        solid = b"".join(map(self.words.__getitem__, WORDS.findall(rest)))
        return space + _packed([0, base + _sum(solid[:1]) - _sum(space)]) + solid[1:]

    def _piece(self, piece: str) -> bytes:
        """Changes by each code point of an ordinary text that starts where no token crosses."""
        if m := SIMPLE.fullmatch(piece):
            return b"".join([self.words[g] for g in m.groups() if g])
        return b"".join(map(self._segment, PIECES.findall(piece)))

    def _wide(self, text: str) -> np.ndarray:
        """As integers, for texts where a change does not fit a byte: the counts of each word, one by one."""
        changes = []
        for segment in PIECES.findall(text):
            blank = HEAD.match(segment).end()
            ends = [blank] if blank == len(segment) else []
            counts, at = [0], 0
            for k in range(1, blank + 1):
                counts.append(self.vocabulary.counts(segment[:k].encode())[-1])
            if not ends:
                at = blank - 1 if blank and segment[blank - 1] == " " else blank
                base = sum(self.vocabulary.counts(x.encode())[-1] for x in (segment[: max(0, blank - 1)], segment[blank - 1 : at] if blank else ""))
                for word in WORDS.findall(segment[at:]):
                    own = self.vocabulary.counts(word.encode())
                    inner = [own[e] for e in np.cumsum([len(c.encode()) for c in word]).tolist()]
                    if word in ("'re", "'ve", "'ll"):
                        inner[1] = 1 + self.vocabulary.counts(word[1].encode())[-1]
                    start = at
                    for k, c in enumerate(inner):
                        if start + k >= blank:
                            counts.append(base + c)
                    at, base = at + len(word), base + inner[-1]
            changes.append(np.diff(np.array(counts)))
        return np.concatenate(changes).astype(np.int32)

    def _ordinary(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int8)
        try:
            if SPACED.search(text):
                return np.frombuffer(b"".join(map(self._segment, PIECES.findall(text))), np.int8)
            first, *rest = text.split(" ")
            return np.frombuffer((self._piece(first) if first else b"") + b"".join(map(self.pieces.__getitem__, rest)), np.int8)
        except OverflowError:
            return self._wide(text)

    def changes(self, text: str) -> np.ndarray:
        """How the count changes by each code point; special tokens' strings count one when whole."""
        if not any(s in text for s in self.vocabulary.strings):
            return self._ordinary(text)
        special = self.vocabulary.special
        counts, base, at = [], 0, 0
        for m in special.finditer(text):
            part = np.cumsum(self._ordinary(text[at : m.start()]), dtype=np.int64) + base
            inside = np.cumsum(self._ordinary(text[at : m.end() - 1]), dtype=np.int64)[m.start() - at :] + base
            base = (int(part[-1]) if len(part) else base) + 1
            counts += [part, inside, [base]]
            at = m.end()
        counts.append(np.cumsum(self._ordinary(text[at:]), dtype=np.int64) + base)
        return np.diff(np.concatenate([[0], *counts])).astype(np.int32)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(vocabulary: str = DEFAULT_VOCABULARY) -> PrefixCounter:
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = PrefixCounter(vocabulary)
    return _COUNTERS[vocabulary]


def prefix_index(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and the changes by code point with their width in bytes, for every row of docs."""

    def make():
        count = counter(vocabulary)

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            texts = batch.column(1).to_pylist()
            changes = [count.changes(t) for t in texts]
            return {
                "doc_id": batch.column(0),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": [int(c.sum(dtype=np.int64)) for c in changes],
                "width": [c.itemsize for c in changes],
                "changes": [c.tobytes() for c in changes],
            }

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty()), STORE, make)


def prefix_counts(width: int, changes: bytes) -> np.ndarray:
    """Token counts of all prefixes, from the empty one on, out of a stored row."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, f"<i{width}"), dtype=np.int64)])


def _longest(counts: np.ndarray, budget: int) -> int:
    """The longest prefix of at most so many tokens; a longer one can have fewer than a shorter."""
    return len(counts) - 1 - int(np.argmax(counts[::-1] <= budget))


def truncation_points(index: DataFrame, budgets: list[int]) -> DataFrame:
    """doc_id, budget, n_chars (the longest prefix within the budget) and its n_tokens, for every stored row and budget."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            rows = list(_truncations(batch, budgets))
            return {name: [r[k] for r in rows] for k, name in enumerate(("doc_id", "budget", "n_chars", "n_tokens"))}

        return step

    return map_arrow(index.select("doc_id", "width", "changes"), "doc_id long, budget long, n_chars long, n_tokens long", make)


def _truncations(batch: pa.RecordBatch, budgets: list[int]) -> Iterator[tuple]:
    for doc, width, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        counts = prefix_counts(width, changes)
        for budget in budgets:
            at = _longest(counts, budget)
            yield doc, budget, at, int(counts[at])


def answers(index: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the budget), and the longest prefix within it, for every stored row."""
    names = ("doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars", "cut_tokens")

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            found = []
            for doc, size, width, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(changes, f"<i{width}")
                total = at_tokens = int(own.sum(dtype=np.int64))
                at = len(own)
                if total > budget:
                    counts = prefix_counts(width, changes)
                    at = _longest(counts, budget)
                    at_tokens = int(counts[at])
                found.append((doc, size, total, total > budget, at, at_tokens))
            return dict(zip(names, zip(*found, strict=True), strict=True))

        return step

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long, cut_tokens long"
    return map_arrow(index.select("doc_id", "n_bytes", "width", "changes"), schema, make)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    index = store(prefix_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prefix-counts")
    return answers(index, LIMIT)
