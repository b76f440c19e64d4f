"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped (space to U+2581, one put in front) and cut in front of every run of U+2581: no piece of such a model
holds U+2581 after another character, so no merge crosses a cut and each part ("word") can be merged alone. The words of
a batch that are new are laid out as one flat symbol array. A round finds the best-ranked mergeable pair of each word (a
segmented minimum) and merges its leftmost occurrence in every word at once; all its occurrences, where no piece that
the merged one could go on to form ranks as well or better, since then nothing can come between them. The arrays are
compacted and the rounds go on until no pair is left. Characters outside the vocabulary become byte pieces. A word of more
than LONG characters (a text without spaces) would need as many rounds as it has merges: there the same merges, in the
same order, are taken from a priority queue.

Decoding takes a text's ids, never the text: their pieces in a row, byte pieces as UTF-8, each byte that is none as U+FFFD,
without the space in front that escaping put there.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text. Whole texts are encoded,
whatever their length; what a worker remembers of words is bounded (MEMORY_BYTES): the words of late in one half, those of
before in the other, which is forgotten when the first is full.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.llm.common import short_batches

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Bytes of remembered words in a worker, and of one of them besides its characters and ids.
MEMORY_BYTES, ENTRY = 90_000_000, 190
#: Words of more characters go through a priority queue, and aren't remembered.
LONG = 1000
NONE = np.int64(1) << 40
#: Ids as they are remembered.
IDS = np.dtype("<i4")

codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: number, and an int or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """A BPE model file: pieces, ranks and the table of mergeable pairs, as sorted arrays."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        scores, kinds = [], []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(piece.get(3, 1))
        self.unknown = kinds.index(2)
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds white space after another character: words can't be merged alone")
        self.byte_ids = np.full(256, self.unknown, np.int64)
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == 6:
                self.byte_ids[int(p[1:-1], 16)] = i
        # equal scores share a rank: among them the leftmost pair goes first
        distinct = np.unique(-np.array(scores, np.float64))
        rank = np.searchsorted(distinct, -np.array(scores, np.float64))
        self.char_id = {p: i for p, i in normal.items() if len(p) == 1}
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.char_id.items():
            self.of_char[ord(p)] = i
        # symbols: piece ids; characters without a piece get ids above them, for they never merge
        left, right, whole = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
        left, right, whole = (np.array(x, np.int64) for x in (left, right, whole))
        keys = left * len(self.pieces) + right
        order = np.argsort(keys)
        self.keys, self.whole = keys[order], whole[order]
        self.rank = rank.astype(np.int64)
        best = np.full(len(self.pieces), np.iinfo(np.int64).max)
        np.minimum.at(best, left, self.rank[whole])
        np.minimum.at(best, right, self.rank[whole])
        self.at_once = best > self.rank
        self.surface = [self._surface(p, k) for p, k in zip(self.pieces, kinds, strict=True)]
        self.controls = {i for i, k in enumerate(kinds) if k == 3}
        self.digits = [str(i).encode() for i in range(len(self.pieces))]
        self.words: dict[str, bytes] = {}  # ids of words, as IDS
        self.before: dict[str, bytes] = {}
        self.remembered = 0
        self.pair_of: dict[int, int] = {}

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == 6:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else piece.replace(MARK, " ").encode()

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or -1."""
        n = len(self.pieces)
        key = np.where((a < n) & (b < n), a * n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.whole[at], -1)

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The characters of all words as symbols; those without a piece are numbered above the pieces, and returned."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.of_char[code].astype(np.int64)
        if len(symbol) and symbol.min() >= 0:
            return symbol, []
        unlisted, number = np.unique(code[symbol < 0], return_inverse=True)
        symbol[symbol < 0] = len(self.pieces) + number
        return symbol, [chr(c) for c in unlisted.tolist()]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each word, by merge rounds over all of them together."""
        flat, end = self._merged(words)
        ids, end = flat.tolist(), end.tolist()
        return [ids[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's end."""
        n = len(self.pieces)
        symbol, beyond = self._symbols(words)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbol, done_word = [], []
        pair = np.full(len(symbol), -1, np.int64)  # what symbol k and the next one merge to
        if len(symbol) > 1:
            pair[:-1] = np.where(word[:-1] == word[1:], self._pairs(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            rank = np.where(pair >= 0, self.rank[np.maximum(pair, 0)], NONE)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            least = np.minimum.reduceat(rank, start)
            if (least == NONE).any():  # whole words leave once they hold no pair
                ended = np.repeat(least == NONE, size)
                done_symbol.append(symbol[ended])
                done_word.append(word[ended])
                symbol, word, pair, rank = symbol[~ended], word[~ended], pair[~ended], rank[~ended]
                size, least = size[least != NONE], least[least != NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            # runs of touching hits (a a a): every second one, counted from the run's left end
            run = np.r_[True, hit[1:] != hit[:-1] + 1]
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[first | (self.at_once[pair[hit]] & (since % 2 == 0))]
            symbol[hit] = pair[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, pair, hit = symbol[keep], word[keep], pair[keep], moved[hit]
            near = np.zeros(len(symbol) + 1, bool)  # symbols whose pair with the next one may be another now
            near[hit] = True
            near[hit - 1] = True
            pair[-1] = -1
            inner = np.flatnonzero(near[: len(symbol) - 1])
            pair[inner] = np.where(word[inner] == word[inner + 1], self._pairs(symbol[inner], symbol[inner + 1]), -1)
        if not done_symbol:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        if beyond:  # byte pieces in their place
            raw = [self.byte_ids[list(c.encode("utf-8"))] for c in beyond]
            size = np.ones(len(symbol), np.int64)
            at = np.flatnonzero(symbol >= n)
            size[at] = np.array([len(x) for x in raw])[symbol[at] - n]
            start = np.cumsum(size) - size
            whole, word = np.repeat(symbol, size), np.repeat(word, size)
            whole[np.repeat(start[at], size[at]) + np.concatenate([np.arange(k) for k in size[at].tolist()])] = np.concatenate([raw[k] for k in (symbol[at] - n).tolist()])
            symbol = whole
        return symbol, np.cumsum(np.bincount(word, minlength=len(words)))

    def merge_long(self, word: str) -> list[int]:
        """Piece ids of one word, best-ranked pair first and the leftmost of equals, by a priority queue."""
        n = len(self.pieces)
        if not self.pair_of:
            self.pair_of = dict(zip(self.keys.tolist(), self.whole.tolist(), strict=True))
        rank, pair_of = self.rank.tolist(), self.pair_of
        symbol = [self.char_id.get(c, n) for c in word]
        after, ahead = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        whole_of = lambda a, b: pair_of.get(a * n + b, -1) if a < n and b < n else -1
        queue = [(rank[w], k, w) for k in range(len(word) - 1) if (w := whole_of(symbol[k], symbol[k + 1])) >= 0]
        heapq.heapify(queue)
        while queue:
            _, k, whole = heapq.heappop(queue)
            right = after[k]
            if symbol[k] < 0 or right >= len(word) or whole_of(symbol[k], symbol[right]) != whole:
                continue  # one of the two has been merged meanwhile
            symbol[k], symbol[right] = whole, -1
            after[k] = after[right]
            if after[k] < len(word):
                ahead[after[k]] = k
                if (w := whole_of(whole, symbol[after[k]])) >= 0:
                    heapq.heappush(queue, (rank[w], k, w))
            if ahead[k] >= 0 and (w := whole_of(symbol[ahead[k]], whole)) >= 0:
                heapq.heappush(queue, (rank[w], ahead[k], w))
        out: list[int] = []
        for c, s in zip(word, symbol, strict=True):
            if s >= 0:
                out.extend([s] if s < n else self.byte_ids[list(c.encode("utf-8"))].tolist())
        return out

    def _remember(self, words: list[str], flat: np.ndarray, end: np.ndarray) -> None:
        data, place = flat.astype(IDS).tobytes(), (np.r_[0, end] * IDS.itemsize).tolist()
        self.words.update(zip(words, [data[a:b] for a, b in zip(place[:-1], place[1:], strict=True)], strict=True))
        self.remembered += ENTRY * len(words) + 2 * sum(map(len, words)) + len(data)

    def learn(self, words: set[str]) -> list[str]:
        """Remember the ids of words not met of late; those too long to be kept are returned."""
        fresh = words.difference(self.words)
        new = fresh.difference(self.before)
        for w in fresh.difference(new):
            self.words[w] = self.before[w]
            self.remembered += ENTRY + 2 * len(w) + len(self.words[w])
        long = [w for w in new if len(w) > LONG]
        new = list(new.difference(long))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self._remember(part, *self._merged(part))
        for w in long:
            ids = self.merge_long(w)
            self._remember([w], np.array(ids, np.int64), np.array([len(ids)]))
        return long

    def digests(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """For each text the number of ids, the ids as text, and what they decode to."""
        if self.remembered > MEMORY_BYTES // 2:
            self.words, self.before, self.remembered = {}, self.words, 0
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        long = self.learn(set().union(*split))
        known, out = self.words, []
        for parts in split:
            ids = np.frombuffer(b"".join([known[w] for w in parts]), IDS).tolist()
            out.append((len(ids), b",".join(map(self.digits.__getitem__, ids)), self.decode(ids)))
        for w in long:
            self.remembered -= ENTRY + 2 * len(w) + len(self.words.pop(w))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.digests([text or ""])[0][1].split(b",") if x]

    def decode(self, ids: list[int]) -> str:
        parts = [ids]
        if not self.controls.isdisjoint(ids):  # they have no text, but end a run of bytes
            parts = [[]]
            for i in ids:
                parts[-1].append(i) if i not in self.controls else parts.append([])
        text = "".join([b"".join(map(self.surface.__getitem__, x)).decode("utf-8", "each_byte") for x in parts])
        first = next((x[0] for x in parts if x), None)  # the space in front is a piece's mark: no byte, no unknown
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


#: One model for each worker process and file.
_LOADED: dict[str, Model] = {}


def model_of(data: bytes) -> Model:
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Model(data)
    return _LOADED[key]


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; with_ids adds ids array<int> and decoded.

    The model file (under 1 MB) travels to the executors as a broadcast. Narrow: no shuffle.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = own.digests([x or "" for x in batch.column(1).to_pylist()])
                columns = [
                    batch.column(0),
                    pa.array([x[0] for x in rows], pa.int64()),
                    pa.array([hashlib.sha256(x[1]).hexdigest() for x in rows], pa.string()),
                    pa.array([hashlib.sha256(x[2].encode("utf-8", "replace")).hexdigest() for x in rows], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([[int(y) for y in x[1].split(b",") if y] for x in rows], pa.list_(pa.int32())), pa.array([x[2] for x in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return short_batches(docs).select("doc_id", text_col).mapInArrow(run, schema)
