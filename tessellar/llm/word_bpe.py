"""The word-level BPE vocabulary: identifiers by the tokenizers library, counts by heap merging.

Both sides rest on two facts about this tokenizer: white space separates tokens and is dropped, and
runs of letters and of punctuation are encoded by themselves. So each distinct run is encoded once
and kept in a bounded cache; what holds any other character goes to the library's own rules as a whole
piece between spaces.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array

import numpy as np

from tessellar.llm.common import claim

#: Entries of each of a worker's two generations of runs, and the longest run kept: bounds the bytes.
CACHE, KEPT = 120_000, 48
#: ASCII or Latin-1 letters, and punctuation without apostrophes or angle brackets: lower-casing and
#: splitting these needs no Unicode tables.
RUN = re.compile(r"[a-zß-öø-ÿ]+|[.,!?;:*$%&#|()\"/-]+")
OTHER = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ.,!?;:*$%&#|()\"/\- \n]")
SPACE = re.compile(r"[ \n]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level tokenizers give each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


#: The same as a table for str.translate over Latin-1.
_TABLE = {b: letter for b, letter in LETTERS.items() if chr(b) != letter}


class Runs(dict):
    """run -> value, in two generations: what is used again moves to the young one, the rest goes."""

    def __init__(self):
        self.old: dict = {}

    def value(self, run: str):
        """Of letters or of punctuation."""
        raise NotImplementedError

    def other(self, piece: str):
        """Of anything else without spaces."""
        raise NotImplementedError

    def __missing__(self, run: str):
        found = self.old.get(run)
        if found is None:
            found = self.other(run) if OTHER.search(run) else self.value(run)
        if len(run) <= KEPT:
            self[run] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()

    def values_of(self, text: str) -> list:
        """The values of a text's runs and other pieces, in order."""
        look, at, out = self.__getitem__, 0, []
        other = OTHER.search(text)
        while other:
            start = max(at, text.rfind(" ", at, other.start()) + 1, text.rfind("\n", at, other.start()) + 1)
            space = SPACE.search(text, other.end())
            end = space.start() if space else len(text)
            out += map(look, RUN.findall(text[at:start].lower()))
            out.append(look(text[start:end]))
            at = end
            other = OTHER.search(text, at)
        out += map(look, RUN.findall(text[at:].lower() if at else text.lower()))
        return out


class PieceIds(Runs):
    """run -> its identifiers as bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize

    def value(self, run: str) -> bytes:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(_TABLE)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def other(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 identifiers of each text."""
        self.trim()
        return [np.frombuffer(b"".join(self.values_of(t)), np.uint32) for t in texts]


class PieceCounts(Runs):
    """run -> its number of tokens, by merging pairs and counting the merges."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalized, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.byte_of = {letter: b for b, letter in LETTERS.items()}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        #: Identifiers of an adjacent pair -> (rank, identifier of the merged symbol).
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[left], self.vocab[right]] = rank, self.vocab[left + right]
        self.inner = [self.vocab[LETTERS[b]] for b in range(256)]
        self.last = [self.vocab[LETTERS[b] + self.end] for b in range(256)]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))

    def merged(self, raw: bytes) -> int:
        """Symbols left of one word: initial symbols less merges."""
        n = len(raw)
        if n < 2:
            return n
        inner, merges = self.inner, self.merges
        symbol = [inner[b] for b in raw[:-1]]
        symbol.append(self.last[raw[-1]])
        heap = []
        for i in range(n - 1):
            pair = symbol[i], symbol[i + 1]
            if pair in merges:
                rank, new = merges[pair]
                heap.append((rank, i, new, *pair, i + 1))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            _, i, new, a, b, j = heapq.heappop(heap)
            if symbol[i] != a or after[i] != j or symbol[j] != b:
                continue  # one side has been merged meanwhile
            left -= 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], new, symbol[k], k))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbol[h], new, i))
        return left

    def value(self, run: str) -> int:
        return self.merged(run.encode())

    def other(self, piece: str) -> int:
        n = sum(1 for _ in self.special.finditer(piece))
        for part in self.special.split(piece):
            n += sum(self.merged(bytes(map(self.byte_of.__getitem__, word))) for word, _ in self.split(self.normalized(part)))
        return n

    def count(self, text: str) -> int:
        return sum(self.values_of(text))


_loaded: dict = {}


def loaded(kind: type, path: str):
    """One cache of a kind for a worker process."""
    claim(f"word_bpe.{kind.__name__}", _loaded.clear)
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
