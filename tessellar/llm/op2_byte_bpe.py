"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are read as Latin-1 letters, so one Aho-Corasick automaton finds every vocabulary entry in a
match of the split pattern. From each place the longest entry is tried first; an entry may follow
another only if merging their bytes would leave the border between them alone, which is decided
once per pair and remembered. A place from which no way leads on is marked and never entered again,
so the work is linear, and the identifiers are those of rank-ordered merging.

A border between two pieces lies before every space that follows a non-space: no match of the
pattern crosses it. Distinct pieces are encoded once and kept in a bounded cache.

Defined cases: null text is empty (no tokens, digests of nothing); a very long text is encoded whole, its
bytes and identifiers held at once; of entries that could follow, the longest that rank-ordered merging
allows is taken, so there are no ties; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored, whatever their names. Map-only: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import claim, gather, slices, table, texts_of

#: Entries of each of a worker's caches; a full one is emptied between slices.
CACHE = 400_000
INFINITE = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: Bytes of a match whose dictionary hits are held at once; a longer match is taken window by window.
WINDOW = 1 << 14


class Windows:
    """The hits of a long match: those of the window that is asked for and of the one before."""

    def __init__(self, bpe: ByteBpe, raw: str):
        self.bpe, self.raw, self.held = bpe, raw, {}

    def __getitem__(self, at: int) -> list[tuple[int, int]]:
        w, k = divmod(at, WINDOW)
        if w not in self.held:
            for other in [x for x in self.held if abs(x - w) > 1]:
                del self.held[other]
            self.held[w] = self.bpe.hits(self.raw, w * WINDOW, min((w + 1) * WINDOW, len(self.raw)))
        return self.held[w][k]


class ByteBpe(dict):
    """' ' and a piece after a space, or another piece -> number of its run of identifiers."""

    #: White space before a space: only such texts hold pieces that aren't simply between spaces.
    AWKWARD = re.compile(r"\s |^ ")
    PIECE = re.compile(r"\s*\S+|\s+")

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.size_of = {rank: len(token) for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.longest = max(self.size_of.values())
        self.chains: dict[tuple[int, bool], list[int]] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.classes = None
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.known.clear()
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two entries whose merge makes this one; None for a byte."""
        token = self.bytes_of[rank]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], INFINITE), i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def chain(self, rank: int, last: bool) -> list[int]:
        """What stands at one end of an entry as it is merged: from a byte to the entry itself."""
        found = self.chains.get((rank, last))
        if found is None:
            halves = self.halves(rank)
            found = self.chains[rank, last] = [*(self.chain(halves[last], last) if halves else []), rank]
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two."""
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            found = self.fits[key] = self.border_holds(self.chain(left, True), self.chain(right, False))
        return found

    def border_holds(self, left: list[int], right: list[int]) -> bool:
        """Follows both ends in order of ranks; the border falls if its own merge comes first."""
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else INFINITE
            next_right = right[j + 1] if j + 1 < len(right) else INFINITE
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], INFINITE)
            if across < next_left and across <= next_right and across < INFINITE:
                return False
            if next_left == next_right == INFINITE:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def encode_match(self, match: str) -> list[int]:
        found = self.known.get(match)
        if found is not None:
            return found
        raw = match.encode()
        rank = self.ranks.get(raw)
        found = self.known[match] = [rank] if rank is not None else self.backtrack(raw.decode("latin-1"))
        return found

    def backtrack(self, raw: str) -> list[int]:
        n = len(raw)
        out: list[int] | array = []
        ways: list[int] | array = []
        if n <= WINDOW:
            starting = [[] for _ in range(n + 1)]  # shortest first
            for end, (rank, size) in self.automaton.iter(raw):
                starting[end - size + 1].append((rank, end + 1))
        else:
            starting, out, ways = Windows(self, raw), array("I"), array("H")
        dead = bytearray(n + 1)
        at, way = 0, len(starting[0]) - 1
        while at < n:
            here = starting[at]
            while way >= 0:
                rank, end = here[way]
                if not dead[end] and (not out or self.compatible(out[-1], rank)):
                    break
                way -= 1
            if way >= 0:
                out.append(rank)
                ways.append(way)
                at, way = end, len(starting[end]) - 1
            else:
                dead[at] = 1
                at -= self.size_of[out.pop()]
                way = ways.pop() - 1
        return list(out)

    def hits(self, raw: str, begin: int, end: int) -> list[list[tuple[int, int]]]:
        """(entry, its end) of all entries that start at each place from begin up to end, shortest first; and none at end."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(end - begin + 1)]
        for last, (rank, size) in self.automaton.iter(raw, begin, min(len(raw), end + self.longest)):
            if last - size + 1 < end:
                out[last - size + 1 - begin].append((rank, last + 1))
        return out

    def matches(self, piece: str) -> list[str]:
        """The pattern's matches. Letters that this Python doesn't know yet are classed as tiktoken classes them."""
        if piece.isascii() or not any(map(self.unknown, piece)):
            return self.pattern.findall(piece)
        stand_in = "".join(self.like(c) if self.unknown(c) else c for c in piece)
        return [piece[slice(*m.span())] for m in self.pattern.finditer(stand_in)]

    def unknown(self, c: str) -> bool:
        return c > "\u04ff" and unicodedata.category(c) == "Cn"

    def like(self, c: str) -> str:
        """A known letter, digit or mark of the same class."""
        if self.classes is None:
            import tiktoken

            self.classes = [(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=self.ranks, special_tokens={}), s) for p, s in ((r"\p{L}", "a"), (r"\p{N}", "1"))]
        return next((s for e, s in self.classes if e.encode_ordinary(c)), "!")

    def __missing__(self, piece: str) -> int:
        ids = [x for match in self.matches(piece) for x in self.encode_match(match)]
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        self[piece] = n = len(self.starts) - 1
        return n

    def pieces(self, text: str) -> list[str]:
        if self.AWKWARD.search(text):
            return self.PIECE.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 identifiers of each text."""
        if len(self) > CACHE or len(self.known) > CACHE:
            self.empty()
        if len(self.fits) > 2 * CACHE:
            self.fits.clear()
        numbers, counts = [], []
        look = self.__getitem__
        for text in texts:
            own = list(map(look, self.pieces(text)))
            counts.append(len(own))
            numbers += own
        at = np.array(numbers, np.int64)
        sizes = np.array(self.sizes, np.int64)[at]
        ids = gather(np.array(self.flat, "<u4"), np.array(self.starts, np.int64)[at], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_loaded: dict = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    claim("byte_bpe", _loaded.clear)
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def _ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source, source.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id_col and ids array<int> of every row."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                own = bpe.encode(texts_of(part, 1))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    source, kind = _ids(docs, id_col, text_col)
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id_col and the bytes that the ids stand for; null ids decode to nothing."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(bpe.bytes_of[x] for x in ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes, decodes and digests every row in one pass, without moving identifiers to the JVM."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                own = bpe.encode(texts_of(part, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in own], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    source, kind = _ids(docs, id_col, text_col)
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
