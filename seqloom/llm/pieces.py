"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch of texts are laid end to end and their suffixes sorted.  Every piece of
the vocabulary is looked up by binary search and gives the range of its occurrences: edges from their
first byte to the byte after their last.  Edges sorted by position are relaxed from left to right, all
words abreast.  An edge holds if the piece before it and its own can stand side by side, that is if
merging the two alone would leave them as they are; exactly one edge into each position does, so the
path back from a word's end is its encoding.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, tune
from .suffixes import Block, sorted_strings

SPACE = "▁"
#: Words whose ids a worker keeps; beyond it the cache starts anew, which bounds memory only.
CACHE_WORDS = 800_000
#: Slots of the cache of pairs of pieces.
PAIR_SLOTS = 1 << 21
START, NONE = -2, -1


class PieceModel:
    """Pieces of a byte-pair SentencePiece model, with the order in which they are merged."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        ordinary = []
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ordinary.append(i)
        ids = {names[i]: i for i in ordinary}
        self.lengths = np.array([len(x.encode()) for x in names] + [0])
        self.single = np.zeros(n + 1, bool)
        self.single[[i for i in ordinary if len(names[i]) == 1]] = True
        #: rank of a merge: earlier merges have smaller ranks; characters come before all
        self.rank = np.full(n + 1, -1, np.int64)
        made = sorted((i for i in ordinary if len(names[i]) > 1), key=lambda i: (-model.get_score(i), i))
        self.rank[made] = np.arange(len(made))
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs = []
        for i in made:
            name = names[i]
            cuts = [(ids[name[:k]], ids[name[k:]]) for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids]
            pairs += [(a << 32 | b, i) for a, b in cuts]
            if split := self._last_merge(name, ids):
                self.left[i], self.right[i] = split
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = self.rank[np.array([i for _, i in pairs], np.int64)]
        self.ordinary = np.array(sorted(ordinary, key=lambda i: names[i].encode()))
        self.keys = [names[i].encode() for i in self.ordinary]
        #: bytes that a piece stands for in a text
        self.bytes = [x.replace(SPACE, " ").encode() for x in names]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                self.bytes[i] = b""
        # words end where no piece goes on: before a space that follows something else, and around
        # line ends if no piece holds one
        whole = any(SPACE in x.lstrip(SPACE) for x in names)
        lines = any("\n" in x for x in ids)
        self.words = re.compile("(?s:.+)" if whole else " +[^ ]*|[^ ]+" if lines else " +[^ \n]*|\n|[^ \n]+")
        self._slots, self._valid = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.cache: dict[str, bytes] = {}
        self.kind = "<u2" if n <= 1 << 16 else "<u4"

    def _last_merge(self, name: str, ids: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge, the last of all, makes this one; None if merging ends elsewhere."""
        parts = list(name)
        while len(parts) > 2:
            ranks = [(self.rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
            if not ranks:
                return None
            _, k = min(ranks)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (ids[parts[0]], ids[parts[1]]) if len(parts) == 2 and all(p in ids for p in parts) else None

    def _merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; beyond all ranks if there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], self.size) if len(self.pair_keys) else np.full(len(a), self.size)

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart: walk back in time and look for a merge across that came first.

        The later of the two pieces is taken apart until both are characters.  Of equal merges the
        left one comes first.
        """
        out = np.ones(len(a), bool)
        todo, limit = np.arange(len(a)), np.full(len(a), self.size)
        while len(todo):
            crossed = self._merged_rank(a, b) < limit
            out[todo[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & (np.maximum(ra, rb) >= 0)
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            of_a = ra > rb
            limit = np.where(of_a, ra, rb + 1)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = (key * 0x9E3779B1 ^ key >> 21) & (PAIR_SLOTS - 1)
        out, miss = self._valid[slot], self._slots[slot] != key
        if miss.any():
            fresh, back = np.unique(key[miss], return_inverse=True)
            ok = self._stand(fresh >> 32, fresh & 0xFFFFFFFF)
            out[miss] = ok[back]
            at = (fresh * 0x9E3779B1 ^ fresh >> 21) & (PAIR_SLOTS - 1)
            self._slots[at], self._valid[at] = fresh, ok
            # of two keys for one slot the last stays, with its own answer
            self._valid[at] = ok[np.searchsorted(fresh, self._slots[at])]
        return out

    def edges(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of every piece, by binary search in the sorted suffixes."""
        n, deep = len(data), max(map(len, self.keys))
        block = Block(np.zeros(1, np.int64), np.array([n]), data)
        suffixes = np.arange(n)
        order, _ = sorted_strings(block, suffixes, deep)
        words = [np.ndarray((n,), ">u8", block.data, strides=(1,), offset=k)[order].astype(np.uint64) for k in range(0, deep, 8)]
        low, high = np.zeros(len(self.keys), np.int64), np.full(len(self.keys), n)
        for k, word in enumerate(words):
            own = np.array([i for i, key in enumerate(self.keys) if len(key) > 8 * k])
            if not len(own):
                break
            part = [self.keys[i][8 * k : 8 * k + 8] for i in own]
            least = np.frombuffer(b"".join(p.ljust(8, b"\0") for p in part), ">u8").astype(np.uint64)
            most = np.frombuffer(b"".join(p.ljust(8, b"\xff") for p in part), ">u8").astype(np.uint64)
            a, b = low[own], high[own]
            low[own], high[own] = _between(word, a, b, least, False), _between(word, a, b, most, True)
        count = np.maximum(high - low, 0)
        total = int(count.sum())
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
        return order[at], np.repeat(self.ordinary, count)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes."""
        raw = [w.replace(" ", SPACE).encode("utf-8", "surrogatepass") for w in words]
        data = b"\xff".join(raw) + b"\xff"
        codes = np.frombuffer(data, np.uint8)
        sizes = np.array([len(r) for r in raw])
        begin = np.cumsum(sizes + 1) - sizes - 1
        start, piece = self.edges(data)
        # characters without a piece go byte by byte
        first = np.nonzero((codes & 0xC0) != 0x80)[0]
        first = first[codes[first] != 0xFF]
        known = np.zeros(len(data) + 1, bool)
        known[start[self.single[piece]]] = True
        lone = first[~known[first]]
        edge = np.append(np.nonzero((codes & 0xC0) != 0x80)[0], len(data))
        width = edge[np.searchsorted(edge, lone, side="right")] - lone
        start, end = np.concatenate([start, lone]), np.concatenate([start + self.lengths[piece], lone + width])
        piece = np.concatenate([piece, np.full(len(lone), self.size)])
        word = np.searchsorted(begin, start, side="right") - 1
        step = end - begin[word]
        order = np.argsort(step.astype(np.uint16), kind="stable") if step.max() < 1 << 16 else np.argsort(step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        last, before = np.full(len(data) + 1, NONE), np.zeros(len(data) + 1, np.int64)
        last[begin] = START
        cuts = np.nonzero(np.diff(step))[0] + 1
        for s, e, p in zip(np.split(start, cuts), np.split(end, cuts), np.split(piece, cuts)):
            prior = last[s]
            live = prior != NONE
            s, e, p, prior = s[live], e[live], p[live], prior[live]
            ok = prior == START
            rest = np.nonzero(~ok)[0]
            if len(rest):
                ok[rest] = self.side_by_side(prior[rest], p[rest])
            last[e[ok]], before[e[ok]] = p[ok], s[ok]
        # back from the ends, all words abreast
        place, owner = begin + sizes, np.arange(len(words))
        found_at, found = [], []
        while len(place):
            p, b = last[place], before[place]
            if (p < 0).any():
                raise ValueError("the vocabulary's merges don't reach the end of a word")
            found_at.append(b)
            found.append(np.stack([p, place - b], 1))
            go = b > begin[owner]
            place, owner = b[go], owner[go]
        at = np.concatenate(found_at)
        by = np.argsort(at)
        at, found = at[by], np.concatenate(found)[by]
        bytewise = found[:, 0] == self.size
        many = np.where(bytewise, found[:, 1], 1)
        ids, origin = np.repeat(found[:, 0], many), np.repeat(at, many)
        loose = ids == self.size
        step = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        ids[loose] = self.byte_ids[codes[(origin + step)[loose]]]
        cut = np.searchsorted(origin, begin[1:])
        return [x.tobytes() for x in np.split(ids.astype(self.kind), cut)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache, new = {}, set().union(*split)
        new = list(new)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.cache.update(zip(part, self.encode_words(part)))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), self.kind) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts first goes."""
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _between(word: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, after: bool) -> np.ndarray:
    """First place in [low, high) whose word is not less than the key (after: is greater); all at once."""
    low, high = low.copy(), high.copy()
    high = np.maximum(high, low)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        w = word[np.minimum(mid, len(word) - 1)]
        right = open_ & ((w <= key) if after else (w < key))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


_models: dict[str, PieceModel] = {}


def piece_model(path: str | None = None) -> PieceModel:
    """The worker's own model; its caches serve the worker's later tasks too."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


OUT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    decoded_sha256, round_trip (decoding gives the text back) and, if asked for, ids.  A null or empty
    text has no ids; rows that repeat a doc_id are encoded each; an empty table gives no rows; extra
    columns are ignored.  A text that holds the vocabulary's space sign itself decodes to spaces.
    """
    tune(docs.sparkSession)
    schema = OUT.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in schema]
            for doc, text, ids in zip(batch.column(0).to_pylist(), texts, model.encode(texts)):
                back = model.decode(ids)
                row = (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text, ids.astype(np.int32))
                for col, x in zip(cols, row):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else "")
    )
