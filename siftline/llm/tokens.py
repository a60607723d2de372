"""Token ids of whole texts, with a public vocabulary file given by its path.

Both kinds of vocabulary split a text into pieces before they merge characters, and neither joins
characters across a single space between two other characters. So the ids of a text are the ids of
its space-separated words put together, and a task asks the tokenizer only for words that it hasn't
met lately. Texts in which spaces stand otherwise (doubled, leading, trailing) go to the tokenizer
whole. tests/llm compares both ways.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np

#: Words that a Python worker keeps at most, in two generations.
CACHE_WORDS = 300_000

_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level vocabularies write each byte: printable ones as themselves, the others in order from U+0100.
AS_TEXT = {b: chr(b) for b in _shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _shown)}
AS_CODE = np.array([ord(AS_TEXT[b]) for b in range(256)], "<u2")
AS_BYTE = {c: b for b, c in AS_TEXT.items()}
#: Letters before this one are taken for letters by all the splitting rules.
BEYOND = "\u0130"
#: Marks that may end a word, and how many of them: a run of them is a piece for both kinds, with nothing of an elision ('s).
MARKS, MOST_MARKS = "!#$%&*,.:;?", 4
#: New words that the model is given in one call at most.
AT_ONCE = 256


def packed(ids: list[int]) -> bytes:
    """Few ids as little-endian unsigned 32-bit integers."""
    return pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers. spaced: a word's ids differ after a space."""

    def __init__(self, path: str, spaced: bool, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)  # splits nothing
        self.begins = self.beginnings() if spaced else None
        self.spaced, self.half = spaced, cache_words // 2
        self.young: dict[str, bytes] = {}  # of words after a space
        self.old: dict[str, bytes] = {}
        self.firsts: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # of words that begin a text
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " \n" if self.spaced else " ").split(" ")  # without `spaced`, white space only parts words
        first = self.first(words[0])
        if first is None:
            return self.whole(text)
        del words[0]
        ids = list(map(self.young.get, words))
        if gaps := [k for k, got in enumerate(ids) if got is None]:
            if not self.learn({words[k] for k in gaps}):
                return self.whole(text)
            for k in gaps:
                ids[k] = self.young[words[k]]
        return first + b"".join(ids)

    def first(self, word: str) -> bytes | None:
        """The ids of a text's first word, which no space precedes; None if it can't stand alone."""
        young, old = self.firsts
        got = young.get(word)
        if got is None:
            if word[:1] == "\n" or self.string(word) is None:
                return None
            if len(young) > self.half // 8:
                self.firsts = young, old = {}, young
            got = young[word] = old.get(word) or self.whole(word)
        return got

    def string(self, word: str) -> str | None:
        """What the tokenizer is given for a word after a space, None if it can't stand alone."""
        bare = word[1:] if word[:1] == "\n" else word
        if not bare or bare != bare.strip() or "\0" in bare:
            return None
        return word if word[0] == "\n" or not self.spaced else " " + word

    def learn(self, words: set[str]) -> bool:
        """Puts words that aren't there into the young generation; False if one of them can't stand alone."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new, ends, alone = [], [], set()
        for w in words:
            if (got := old.get(w)) is not None:
                young[w] = got
            elif self.one_piece(w):
                alone.add(w)
            elif (s := self.string(w)) is None:
                return False
            elif w[-1] in MARKS and (body := w.rstrip(MARKS)) and len(w) - len(body) <= MOST_MARKS and self.one_piece(body[-1]):  # marks after a letter are a piece of their own
                ends.append((w, body))
            else:
                new.append((w, s))
        for w, body in ends:
            if body not in young:
                if (got := old.get(body)) is not None:
                    young[body] = got
                elif self.one_piece(body):
                    alone.add(body)
                else:
                    new.append((body, self.string(body)))
        young.update(self.pieces(list(alone)))
        if new:
            for (w, _), e in zip(new, self.tokenizer.encode_batch_fast([s for _, s in new], add_special_tokens=False), strict=True):
                young[w] = packed(e.ids)
        for w, body in ends:
            young[w] = young[body] + self.mark(w[len(body) :])
        return True

    @staticmethod
    def one_piece(word: str) -> bool:
        """Letters alone, none beyond Latin-1 and its neighbours: the splitting rules leave it whole, and the model alone will do."""
        return word.isalpha() and (word.isascii() or max(word) < BEYOND)

    def beginnings(self) -> np.ndarray | None:
        """By id, whether a token begins with a space; None if the vocabulary may join a letter with a space after it."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            begins[i] = token[0] == "\u0120"
            if "\u0120" in token[1:]:
                shown = bytes(AS_BYTE[c] for c in token).decode(errors="replace")
                if any(b == " " and (a.isalpha() or a == "\ufffd") for a, b in pairwise(shown)):
                    return None
        return begins

    def pieces(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Such words with their ids after a space: many in one call of the model where it joins no two of them, cut where a space begins."""
        if self.begins is None:
            yield from ((w, self.piece(w)) for w in words)
            return
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            written = AS_CODE[np.frombuffer((" " + " ".join(some)).encode(), "u1")].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
            data, starts = ids.tobytes(), (4 * np.flatnonzero(self.begins[ids])).tolist()
            yield from zip(some, [data[a:b] for a, b in pairwise([*starts, len(data)])], strict=True)

    def piece(self, word: str) -> bytes:
        """The ids of such a word after a space."""
        if not self.spaced:
            word = word.lower()
            if (known := self.young.get(word) or self.old.get(word)) is not None:
                return known
        written = word if word.isascii() else "".join([AS_TEXT[b] for b in word.encode()])
        ids = packed([t.id for t in self.model.tokenize("\u0120" + written if self.spaced else written)])
        if not self.spaced:
            self.young[word] = ids
        return ids

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self.whole(marks)
        return self.marks[marks]


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool, cache_words: int = CACHE_WORDS) -> TextEncoder:
    """One for each Python worker; the words that it learned serve the worker's later tasks."""
    return TextEncoder(path, spaced, cache_words)
