"""Best-fit packing of tokenised documents into sequences: hierarchical residual packing."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, as_text, tune

CAPACITY = 4096
#: Words whose ids a worker keeps (about 200 bytes each); beyond it the cache starts anew.
CACHE_WORDS = 600_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of these characters only: lower-casing and composition leave them alone or act letter by letter.
PLAIN = re.compile("[ -&(-;=-~\n\t\rÀ-ÖØ-öø-ÿ]*")
#: Their runs of letters, and of anything else but blanks.
RUNS = re.compile("[a-zß-öø-ÿ]+|[!-`{-~]+")


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary's own pre-tokenizer never joins characters across a blank, nor letters with other
    characters unless an apostrophe is among them.  So a text's ids are those of its blank-separated
    words in order, or in plain texts of its runs of letters and of other characters; every distinct
    one is encoded once by the library.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.model, self.cache, self.most = Tokenizer.from_file(path), {}, cache_words

    def encode(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            words = RUNS.findall(text.lower())
        else:
            words = [w for w in re.split("[ \n\t\r]+", text) if w]
        if new := set(words).difference(self.cache):
            if len(self.cache) + len(new) > self.most:
                self.cache = {}
                new = set(words)
            new = list(new)
            for word, got in zip(new, self.model.encode_batch(new, add_special_tokens=False)):
                self.cache[word] = array("I", got.ids).tobytes()
        return np.frombuffer(b"".join(map(self.cache.__getitem__, words)), np.uint32)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's own tokenizer; its cache serves the worker's later tasks too."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids plus `end_id` into pieces of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.  A null or
    empty text is the one id `end_id`.  Other columns are ignored; repeated rows give repeated pieces.
    """
    tune(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = word_tokenizer(vocabulary)
        for batch in batches:
            out = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(words.encode(text.as_py()), np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].astype("<u4")
                    row = (doc, k, at, len(part), zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if with_ids else ())
                    for col, x in zip(out, row):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(out, fields)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(
        cut, PIECES + (", ids array<int>" if with_ids else "")
    )


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Best fit, longest first: item numbers of each bin.  Bins are found by their exact room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r > n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins


ROUND = pa.schema([("grp", pa.int64()), ("used", pa.int64()), ("members", pa.binary()), ("done", pa.bool_())])
ROUND_DDL = "grp long, used long, members binary, done boolean"


def _pack_group(capacity: int, fan_in: int, slack: int, rounds_left: int):
    """One group of one round: its items (used, members) in bins, each done or passed on as an item."""

    def run(table: pa.Table) -> pa.Table:
        used, members, grp = table["used"].to_numpy(), table["members"].to_pylist(), table["grp"][0].as_py()
        bins = best_fit(used, capacity)
        full = np.array([int(used[items].sum()) for items in bins])
        done = np.ones(len(bins), bool)
        if rounds_left:
            open_ = np.nonzero(capacity - full > slack)[0]
            open_ = open_[np.argsort(full[open_], kind="stable")]
            done[open_[: 1 + fan_in * rounds_left]] = False
        blobs = [b"".join(members[i] for i in items) for items in bins]
        return pa.table([pa.array(np.full(len(bins), grp // fan_in)), pa.array(full), pa.array(blobs, pa.binary()), pa.array(done)], schema=ROUND)

    return run


def _places(items: DataFrame, n: int, capacity: int, group_items: int, fan_in: int, slack: int) -> DataFrame:
    """(row, sequence_id, offset) of n stored items (row, length); rows differ.

    Each group packs its items by best fit.  Best fit leaves one bin at most that is half empty, and
    two fuller ones never join; so all that can be gained by joining groups is to put the half-empty
    bin of each elsewhere.  A group therefore passes on its emptiest bin and as many of the next as
    half-empty bins can still come by on the way up, `fan_in` a round; the other bins are done.  A bin
    that is done could only have taken what an emptier one that went on can take as well, so nothing
    is lost, and a later group holds fan_in * (1 + fan_in * rounds) items at most.
    """
    groups = max(1, -(-n * 11 // (10 * group_items)))  # dealt by hash: a tenth to spare
    rounds = 0
    while fan_in**rounds < groups:
        rounds += 1
    todo = items.select(
        F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"), F.col("length").cast("long").alias("used"),
        # members: the (row, length) of a bin's items, big-endian, in the order they stand in it
        F.unhex(F.concat(F.lpad(F.hex("row"), 16, "0"), F.lpad(F.hex(F.col("length").cast("long")), 16, "0"))).alias("members"),
    )
    steps = []
    for left in range(rounds, -1, -1):
        steps.append(Stored(todo.groupBy("grp").applyInArrow(_pack_group(capacity, fan_in, slack, left), ROUND_DDL), "pack-round"))
        todo = steps[-1].read().filter("not done").select("grp", "used", "members")
    bins = steps[0].read()
    for x in steps[1:]:
        bins = bins.unionByName(x.read())
    bins = Stored(bins.filter("done").select(F.monotonically_increasing_id().alias("sequence_id"), "members"), "pack-bins").read()
    for x in steps:
        x.drop()
    placed = pa.schema([("row", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            if not blobs:
                continue
            m = np.frombuffer(b"".join(blobs), ">i8").astype(np.int64).reshape(-1, 2)
            counts = np.array([len(b) // 16 for b in blobs])
            first = np.repeat(np.cumsum(counts) - counts, counts)
            before = np.cumsum(m[:, 1]) - m[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(m[:, 0]), pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(before - before[first])], schema=placed)

    return bins.mapInArrow(spread, "row long, sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = 40_000, fan_in: int = 8, slack: int = 8) -> DataFrame:
    """Place pieces (doc_id, piece, length, ...) into sequences of at most `capacity` tokens.

    Returns the pieces' columns, sequence_id and offset.  Groups of about `group_items` pack their items
    by best fit and emit full bins, those with at most `slack` tokens of room among them; a few underfull
    ones of each go up a tree, `fan_in` groups joining into one, as items of the next round (`_places`).
    A length must not exceed the capacity.  Pieces that repeat, or lack a doc_id, are told apart by a row
    number; an empty table gives no rows.
    """
    rows = Stored(pieces.select("*", F.monotonically_increasing_id().alias("row")), "pack-pieces").read()
    places = _places(rows.select("row", "length"), rows.count(), capacity, group_items, fan_in, slack)
    return rows.join(places, "row").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece with its place in its sequence.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is one
    piece of the one id `end_id`; only a document of more than `capacity` ids is cut, however long it
    is; rows that repeat a doc_id, or lack one, have pieces and places of their own; an empty table
    gives no rows; extra columns are ignored.
    """
    return pack(tokenize(docs, vocabulary, end_id, capacity), capacity)
