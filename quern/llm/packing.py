"""Packing: sum-of-squares online packing of token sequences into windows.

Each task packs the documents of its input split as they come: whole windows of a long document are cut off
first, and the rest goes to the fill level for which the sum of the squared counts of partially filled windows
grows least. The counts are kept in an array by level; beside it lie the open windows themselves, at most
OPEN_WINDOWS of them (then, and at the split's end, the emptier ones are poured into the fuller ones, cutting
documents where they don't fit), so that a task pads one window at most. There is no shuffle.

Defined cases: null text counts as empty and has the closing id alone; repeated rows are packed each.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ship, table, word_pieces

WINDOW = 2048
OPEN_WINDOWS = 4096
#: Words whose ids are remembered by a worker before it starts anew.
REMEMBERED_WORDS = 300_000


class WordTokenizer:
    """Ids of texts, word by word, as tokenizers gives them for a file of byte-level BPE with word ends.

    No pre-token of such a file holds white space, so a text's ids are its words' ids in order; words repeat, and
    each one's ids (little-endian 32-bit bytes) are remembered. New words go through tiktoken, whose merges are
    the file's own: a mark after each pre-token stands for the end of a word and joins the byte before it
    first. Words with characters for which the libraries might disagree (odd spaces, private use, capital sigma,
    special tokens) go to tokenizers itself.
    """

    _PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    _PLAIN = regex.compile("[\\n\x21-\x7E\u00A1-\u03A2\u03A4-\u167F\u2010-\u2027\u3041-\u9FFF\uAC00-\uD7A3]*")
    _MARK = "\uE000"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, mark = model["vocab"], self._MARK.encode()
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}
        byte = {c: b for b, c in letters.items()}

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(byte[c] for c in (token[:-4] if ends else token)) + mark * ends

        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def rank(token: bytes, id_: int) -> None:
            if token not in ranks:
                ranks[token] = len(ids)
                ids.append(id_)

        for b in range(256):
            rank(bytes([b]), vocabulary[letters[b]])
        rank(mark[:2], 0)
        rank(mark, 0)
        for b in range(256):
            rank(bytes([b]) + mark, vocabulary[letters[b] + "</w>"])
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            rank(raw(left) + raw(right), vocabulary[left + right])
        self.ids_of = np.array(ids, "<u4")
        self.ends = np.array([r.endswith(mark) for r in ranks], bool)
        self.fast = tiktoken.Encoding("words", pat_str=f"[^\\s{self._MARK}]+{self._MARK}", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def _alone(self, word: str) -> bytes:
        return np.array(self.t.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            line = b"\n".join(some).decode()
            if b"<|" in line.encode() or not self._PLAIN.fullmatch(line):
                plain = []
                for w in some:
                    text = w.decode()
                    if "<|" in text or not self._PLAIN.fullmatch(text):
                        self.known[w] = self._alone(text)
                    else:
                        plain.append(w)
                some, line = plain, b"\n".join(plain).decode()
            if not some:
                continue
            marked = self._PRE.sub("\\g<0>" + self._MARK, unicodedata.normalize("NFC", line).lower())
            counts = [w.count(self._MARK) for w in marked.split("\n")]
            ranks = np.array(self.fast.encode_ordinary(marked), np.int64)
            last = np.concatenate([[0], np.flatnonzero(self.ends[ranks]) + 1])
            cut = (last[np.concatenate([[0], np.cumsum(counts)])] * 4).tolist()
            raw = self.ids_of[ranks].tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip(cut, cut[1:])]))

    def _ids(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > REMEMBERED_WORDS:
                self.known.clear()
            self.learn(list(set(words).difference(self.known)))
            return b"".join(map(self.known.__getitem__, words))

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; new words of many texts are learnt together."""
        for at in range(0, len(texts), 256):
            some = [t.encode() for t in texts[at : at + 256]]
            if sum(map(len, some)) > 1 << 23:
                yield from (b"".join(map(self._ids, word_pieces(t))) for t in some)
                continue
            if len(self.known) > REMEMBERED_WORDS:
                self.known.clear()
            words: list[bytes] = []
            ends = [0]
            for t in some:
                words += t.split()
                ends.append(len(words))
            parts = list(map(self.known.get, words))
            if gaps := [i for i, p in enumerate(parts) if p is None]:
                self.learn(list({words[i] for i in gaps}))
                for i in gaps:
                    parts[i] = self.known[words[i]]
            yield from (b"".join(parts[a:b]) for a, b in zip(ends, ends[1:]))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker and file; workers are used again, and what they remember with them."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class SumOfSquares:
    """Level array of an online packing; open windows are lists of pieces, by level."""

    def __init__(self, window: int = WINDOW, most: int = OPEN_WINDOWS):
        self.window, self.most = window, most
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level (0: a new window) where a piece of this size, below a window, adds least to the sum of squares."""
        n, room = self.count, self.window - size
        levels = np.flatnonzero(n[1 : room + 1]) + 1
        if not levels.size:
            return 0
        after = n[levels + size] * 2 + 1
        after[levels + size == self.window] = 0
        change = after - (2 * n[levels] - 1)
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
        return int(levels[best]) if change[best] <= 2 * n[size] + 1 else 0

    def _take(self, level: int) -> list:
        if not level:
            return []
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, pieces: list, level: int) -> list | None:
        if level == self.window:
            return pieces
        self.count[level] += 1
        self.n_open += 1
        self.open[level].append(pieces)
        return None

    def add(self, piece: tuple, size: int) -> Iterator[list]:
        """Places a piece; yields windows that are done."""
        level = self.level_for(size) if size < self.window else 0
        pieces = self._take(level)
        pieces.append(piece)
        if done := self._put(pieces, level + size):
            yield done
        elif self.n_open > self.most:
            yield from self.pour()

    def pour(self) -> Iterator[list]:
        """Pours emptier windows into fuller ones until one is left open; yields the full ones."""
        rest = [(level, pieces) for level in range(1, self.window) for pieces in self.open[level]]
        self.count[:] = 0
        self.n_open = 0
        self.open = [[] for _ in range(self.window)]
        low, high = 0, len(rest) - 1
        while low <= high:
            level, pieces = rest[high]
            while level < self.window and low < high:
                source_level, source = rest[low]
                doc, start, raw, total = source.pop()
                fits = min(len(raw) // 4, self.window - level)
                pieces.append((doc, start, raw[: fits * 4], total))
                if fits * 4 < len(raw):
                    source.append((doc, start + fits, raw[fits * 4 :], total))
                level += fits
                rest[low] = (source_level - fits, source)
                low += not source
            if level == self.window:
                yield pieces
            else:
                self._put(pieces, level)
            high -= 1


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_OUT_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packer(path: str, closing_id: int, window: int):
    closing = np.array([closing_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, t = SumOfSquares(window), tokenizer(path)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rows: list[tuple] = []

        def written(pieces: list) -> None:
            nonlocal number
            at = 0
            for doc, start, raw, total in pieces:
                rows.append((doc, start, len(raw) // 4, zlib.crc32(raw), total, number, at))
                at += len(raw) // 4
            number += 1

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)
            rows.clear()
            return out

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), t.batch(batch.column("text").to_pylist())):
                raw += closing
                total = len(raw) // 4
                for start in range(0, total, window):
                    part = raw[start * 4 : (start + window) * 4]
                    for done in levels.add((doc, start, part, total), len(part) // 4):
                        written(done)
                if len(rows) > 50_000:
                    yield taken()
        for done in levels.pour():
            written(done)
        for left in (p for level in levels.open for p in level):
            written(left)
        yield taken()

    return pack


def packed(docs: DataFrame, path: str, closing_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each piece of docs (doc_id, text): where its ids lie in the document and in which sequence.

    sequence_id tells the input split (upper bits) and the window in it; a rerun over the same files agrees.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(packer(path, closing_id, window), _OUT_SQL)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
