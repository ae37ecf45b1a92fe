"""Text classes by compression: zstandard dictionaries of two classes and their compressed sizes.

A text is cut into windows; each is compressed with the dictionary of either class.  The sizes'
normalised difference, over all windows and in the most telling ones, becomes a score by logistic
calibration on labelled rows that the dictionaries weren't made from.

Dictionaries are made by contrast: short byte strings that are frequent in one class and rare in the
other are found by document frequency, and the stretches of text that they cover, most frequent last,
are the class's dictionary.  (zstandard's own trainer picks what is frequent in a class, and that is
mostly the language itself, so both dictionaries are alike.)  How long the strings and windows are may
be left to the labels: of several settings the one whose calibration fits best is taken.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, as_text, release, tune

#: Labelled rows of either class that are learnt from at most; of each, the whole text.
SAMPLE_ROWS = 6000
FOLDS = 3
#: Texts that a stretch must stand in.
LEAST_TEXTS = 3


@dataclass(frozen=True)
class Settings:
    """How texts are cut and dictionaries are chosen."""

    lower: bool  # ignore the case of A-Z
    window: int  # bytes
    grams: tuple[int, ...]  # bytes of the strings that are contrasted, 8 at most
    times: float  # ratio of a telling string's shares of the two classes
    evidence: float = 30.0  # its log-likelihood ratio, twice; millions of strings are tried
    shifts: tuple[int, ...] = (0,)  # where the first whole window starts; each shift cuts the text anew
    saving: bool = False  # whether the difference to the plain size counts too
    dictionary: int = 16_384  # bytes


#: Insults with many endings call for short strings, few and short labelled texts for longer ones.
TOXICITY = (
    Settings(lower=True, window=256, grams=(4,), times=3.0, shifts=(0, 128)),
    Settings(lower=True, window=128, grams=(5, 7), times=3.0, shifts=(0, 64)),
)
QUALITY = (Settings(lower=False, window=512, grams=(5,), times=8.0, saving=True),)

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fold(text: str, lower: bool) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data.translate(_LOWER) if lower else data


def _grams(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data + bytes(8), np.uint8)
    return np.ndarray((max(0, len(data) - n + 1),), "<u8", raw, strides=(1,)) & np.uint64((1 << (8 * n)) - 1)


def _distinct(data: bytes, n: int, step: int = 1 << 20) -> np.ndarray:
    """Each string of n bytes in a text once; read in steps, which bounds memory."""
    out = np.zeros(0, np.uint64)
    for k in range(0, len(data) - n + 1, step):
        out = np.union1d(out, _grams(data[k : k + step + n - 1], n))
    return out


def contrast(own: tuple, texts: int, other: tuple, others: int, how: Settings) -> np.ndarray:
    """Strings that stand in more of `own` than of `other`: several times as many, and not by chance.

    Both are strings with the number of texts that hold them, of so many texts.  Chance is judged by the
    likelihood ratio of the texts with and without a string, which holds for small counts too.
    """
    (u, c), (v, d) = own, other
    if not texts or not others:
        return u[:0]
    at = np.searchsorted(v, u)
    at[at == len(v)] = 0
    there = np.where(v[at] == u, d[at], 0) if len(v) else np.zeros(len(u))
    share = (c + there) / (texts + others)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)

    ratio = part(c, share * texts) + part(there, share * others) + part(texts - c, (1 - share) * texts) + part(others - there, (1 - share) * others)
    return u[(c * others > how.times * there * texts) & (2 * ratio > how.evidence)]


def stretches(t: bytes, telling: dict[int, np.ndarray], longest: int = 24, step: int = 1 << 18) -> set[bytes]:
    """The stretches of a text that telling strings cover, each once."""
    covered = np.zeros(len(t), bool)
    for n, grams in telling.items():
        for k in range(0, len(t) - n + 1 if len(grams) else 0, step):
            g = _grams(t[k : k + step + n - 1], n)
            at = np.searchsorted(grams, g)
            at[at == len(grams)] = 0
            hit = grams[at] == g
            for j in range(n):
                covered[k + j : k + j + len(hit)] |= hit
    turn = np.diff(covered.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    found = set()
    for begin, end in zip(np.nonzero(turn == 1)[0].tolist(), np.nonzero(turn == -1)[0].tolist()):
        s = t[begin:end]
        # a word cut off by the run's ends is no part of the stretch
        if (k := s.rfind(b" ", 0, 4)) > 0:
            s = s[k:]
        if (k := s.find(b" ", max(1, len(s) - 3))) > 0:
            s = s[: k + 1]
        if len(s) >= 4:
            found.add(s[:longest])
    return found


def class_dictionary(counts: dict[bytes, int], size: int) -> bytes:
    """Stretches by the number of texts that hold them; the most frequent stands last."""
    out = b""
    for s, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if c < LEAST_TEXTS or len(out) + len(s) > size:
            break
        if s not in out:
            out = s + out
    return out


class Sizes:
    """Compressed sizes of a text's windows under both dictionaries, and what they say of the text."""

    def __init__(self, first: bytes, second: bytes, how: Settings):
        # equal lengths: a match costs the same in either
        pad = max(len(first), len(second), 8)
        self.window, self.shifts, self.saving = how.window, how.shifts, how.saving
        self.first, self.second = (self._compressor(d.rjust(pad, b"\0")) for d in (first, second))

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        # optimal parsing: the size then follows the text's content, not a parser's luck
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTOPT, min_match=5, search_log=4, hash_log=16, chain_log=16, window_log=17, target_length=32,
            write_content_size=0, write_dict_id=0, write_checksum=0,
        )
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)

    def features(self, data: bytes) -> list[float]:
        """Overlapping windows see a string whole that another cut divides, so every shift counts."""
        return [x for shift in self.shifts for x in self._features(data, shift)]

    def _features(self, data: bytes, shift: int) -> list[float]:
        first, second, w = self.first.compress, self.second.compress, self.window
        a, b, k = [], [], 0
        while k < len(data) or not a:
            end = k + w if k or not shift else shift
            part = data[k:end]
            a.append(len(first(part)))
            b.append(len(second(part)))
            k = end
        gain = [y - x for x, y in zip(a, b)]
        total, n, net = sum(a) + sum(b), len(a), sum(b) - sum(a)
        plus, minus = sum(g for g in gain if g > 2), sum(-g for g in gain if g < -2)
        some, many = sum(g > 4 for g in gain), sum(g > 8 for g in gain)
        plain = len(data) + 16
        return [
            net / total, net / (n + 2), plus / (n + 1), minus / (n + 1), some / (n + 1), many / (n + 1),
            log1p(max(0, max(gain))), log1p(max(0, -min(gain))), log1p(plus), log1p(minus), log1p(many),
            *([(plain - sum(map(min, a, b))) / plain] if self.saving else []),
        ]


class Calibration:
    """Logistic regression on standardised features, by Newton's steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            penalty = np.full(z.shape[1], ridge)
            penalty[0] = 1e-6
            grad = z.T @ (p - y) + penalty * self.weights
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            self.weights -= step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean logarithmic loss."""
        p = self.score(x)
        return float(-np.log(np.where(y == 1, p, 1 - p)).mean())

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


@dataclass
class CompressionClassifier:
    """Scores any text from 0 to 1 (label 1 likelier); every text 0.5 where there is no calibration."""

    how: Settings
    dictionaries: tuple[bytes, bytes] = (b"", b"")
    calibration: Calibration | None = None

    def scorer(self):
        """Scores of a list of texts."""
        if self.calibration is None:
            return lambda texts: np.full(len(texts), 0.5)
        sizes = Sizes(*self.dictionaries, self.how)
        return lambda texts: self.calibration.score(np.array([sizes.features(t) for t in texts])) if texts else np.zeros(0)


def held_out(doc_id="doc_id"):
    """Rows that no label is learnt from: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


SAMPLE_DDL = "doc_id long, y int, fold int, data binary"


def _prepare(lower: bool):
    """A labelled text's bytes and its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.translate(_LOWER) if lower else t for t in batch.column(2).to_pylist()]
            fold = [zlib.crc32(t) % FOLDS for t in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fold, pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "y", "fold", "data"])

    return run


#: Classes by folds; the texts of a class and fold that hold a string are counted in one column.
SLOTS = 2 * FOLDS
COUNTS_DDL = ", ".join(["n int", "gram long", *(f"c{k} long" for k in range(SLOTS))])


def _count(sizes: tuple[int, ...], most: int = 1_000_000):
    """Strings of so many bytes and the texts of every class and fold that hold each."""

    def flush(n: int, parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        slot = np.concatenate([np.full(len(g), k) for k, g in parts])
        grams, back = np.unique(np.concatenate([g for _, g in parts]), return_inverse=True)
        counts = np.bincount(back * SLOTS + slot, minlength=len(grams) * SLOTS).reshape(-1, SLOTS)
        cols = [np.full(len(grams), n, np.int32), grams.view(np.int64), *(np.ascontiguousarray(c) for c in counts.T)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["n", "gram", *(f"c{k}" for k in range(SLOTS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = {n: [] for n in sizes}, dict.fromkeys(sizes, 0)
        for batch in batches:
            for y, fold, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for n in sizes:
                    grams = _distinct(t.as_py(), n)
                    parts[n].append((y * FOLDS + fold, grams))
                    held[n] += len(grams)
                    if held[n] > most:
                        yield flush(n, parts[n])
                        parts[n], held[n] = [], 0
        for n in sizes:
            if held[n]:
                yield flush(n, parts[n])

    return run


def _cover(telling: list[list[dict[int, np.ndarray]]], most: int = 200_000):
    """Stretches of the texts that a dictionary is made from, for each choice of folds and class."""
    names = ["made", "y", "stretch", "texts"]

    def flush(counts: Counter) -> pa.RecordBatch:
        made, y, stretch = zip(*counts)
        types = pa.int32(), pa.int32(), pa.binary(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((made, y, stretch, list(counts.values())), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for y, fold, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = t.as_py()
                for made in range(FOLDS + 1):
                    if made != fold:
                        counts.update((made, y, s) for s in stretches(t, telling[made][y]))
                if len(counts) > most:
                    yield flush(counts)
                    counts.clear()
        if counts:
            yield flush(counts)

    return run


def _measure(dictionaries: list[tuple[bytes, bytes]], how: Settings):
    """Features of a text by the dictionaries made without its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [Sizes(*d, how) for d in dictionaries[:FOLDS]]
        for batch in batches:
            x = [sizes[fold].features(t.as_py()) for fold, t in zip(batch.column(2).to_pylist(), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return run


#: Texts that a string must stand in to be looked at; the evidence asks for more.
FEW = 4


def _fit(sample: DataFrame, how: Settings) -> tuple[float, CompressionClassifier]:
    """Learn from a stored sample (doc_id, y, fold, data); the model and its loss on the sample.

    Whole texts are read on the executors; the driver gets counts of strings and stretches, and each
    text's features.  Calibration sees a text through dictionaries made without it: texts fall into
    FOLDS folds by their own checksum, so copies stay together, and each fold is measured with the
    dictionaries of the others.  Those that score are made from all.
    """
    texts = {(r.y, r.fold): r.n for r in sample.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}  # SLOTS rows
    if min(sum(y == k for y, _ in texts) for k in (0, 1)) < 2:
        return 0.0, CompressionClassifier(how)
    counted = sample.select("y", "fold", "data").mapInArrow(_count(how.grams), COUNTS_DDL).groupBy("n", "gram").agg(*(F.sum(f"c{k}").cast("int").alias(f"c{k}") for k in range(SLOTS)))
    # strings in fewer texts tell of neither class, however folds are chosen
    total = [sum((F.col(f"c{y * FOLDS + i}") for i in range(FOLDS)), F.lit(0)) for y in (0, 1)]
    got = counted.filter((total[0] >= FEW) | (total[1] >= FEW)).toArrow()
    sizes, grams = got["n"].to_numpy(), got["gram"].to_numpy().view(np.uint64)
    counts = np.stack([got[f"c{k}"].to_numpy() for k in range(SLOTS)])
    telling = []
    for made in range(FOLDS + 1):
        folds = [i for i in range(FOLDS) if i != made]
        n = [sum(texts.get((y, i), 0) for i in folds) for y in (0, 1)]
        seen = [counts[[y * FOLDS + i for i in folds]].sum(0) for y in (0, 1)]
        telling.append([{}, {}])
        for size in how.grams:
            at = np.nonzero(sizes == size)[0]
            at = at[np.argsort(grams[at])]
            for y in (0, 1):
                telling[made][y][size] = contrast((grams[at], seen[y][at]), n[y], (grams[at], seen[1 - y][at]), n[1 - y], how)
    covered = sample.select("y", "fold", "data").mapInArrow(_cover(telling), "made int, y int, stretch binary, texts long").groupBy("made", "y", "stretch").agg(F.sum("texts").alias("texts"))
    found: list[list[dict[bytes, int]]] = [[{}, {}] for _ in range(FOLDS + 1)]
    for r in covered.filter(F.col("texts") >= LEAST_TEXTS).collect():  # stretches of 2 * SAMPLE_ROWS texts
        found[r.made][r.y][bytes(r.stretch)] = r.texts
    dictionaries = [(class_dictionary(f[1], how.dictionary), class_dictionary(f[0], how.dictionary)) for f in found]
    rows = sorted((r.doc_id, r.y, r.x) for r in sample.mapInArrow(_measure(dictionaries, how), "doc_id long, y int, x array<double>").collect())
    x, y = np.array([x for _, _, x in rows]), np.array([y for _, y, _ in rows], float)
    calibration = Calibration(x, y)
    return calibration.loss(x, y), CompressionClassifier(how, dictionaries[FOLDS], calibration)


def learn(docs: DataFrame, labels: DataFrame, label: str, choices: tuple[Settings, ...], rows: int = SAMPLE_ROWS) -> CompressionClassifier:
    """Fit on the whole texts of at most `rows` rows of either label, chosen by a hash of doc_id, none of them held out.

    Of several settings (all fold case, or none) the one with the least loss is taken, each text being measured
    through dictionaries made without it; of equal ones the first.
    """
    tune(docs.sparkSession)
    picked = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).filter("y = z").drop("z")
    )
    order = F.xxhash64("doc_id"), F.col("doc_id")
    ids = [r for y in (0, 1) for r in picked.filter(F.col("y") == y).orderBy(*order).limit(rows).collect()]  # 2 * rows numbers at most
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in ids], "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().cast("binary").alias("data"))
    sample = Stored(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "data").mapInArrow(_prepare(choices[0].lower), SAMPLE_DDL), "labelled")
    with ThreadPoolExecutor(len(choices)) as side_by_side:
        models = list(side_by_side.map(lambda how: _fit(sample.read(), how), choices))
    sample.drop()
    release(docs.sparkSession)
    return min(models, key=lambda m: m[0])[1]


def _scores(model: CompressionClassifier, batch: pa.RecordBatch, score) -> np.ndarray:
    """Scores of the texts in a batch's last column."""
    return score([fold(t.as_py(), model.how.lower) for t in batch.column(batch.num_columns - 1)])


def classify(docs: DataFrame, model: CompressionClassifier, threshold: float) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted (score >= threshold).

    A null or empty text is scored as one empty window; a model without labels of both classes scores
    0.5; rows that repeat a doc_id are scored each; an empty table gives no rows; extra columns are
    ignored.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            got = _scores(model, batch, score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), as_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, model: CompressionClassifier, keep) -> DataFrame:
    """The rows, all columns unchanged, whose scores `keep` (an array in, a mask out) lets pass.

    A null or empty text is scored as one empty window; a table without rows gives none.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            kept = batch.filter(pa.array(keep(_scores(model, batch, score)), pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(kept.schema)[:-1]))

    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any name there is
    return docs.select("*", as_text().alias(free)).mapInArrow(run, docs.schema)


#: A document is toxic, or good, from this score on.
TOXIC, GOOD = 0.7, 0.5


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Likelihood that a text is toxic; case is ignored."""
    return classify(docs, learn(docs, labels, "toxic", TOXICITY), TOXIC)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Likelihood that a text is of good quality."""
    return classify(docs, learn(docs, labels, "quality", QUALITY), GOOD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns unchanged, whose texts aren't toxic.

    A null or empty text is scored as one empty window; without labels of both classes all rows stay;
    rows that repeat a doc_id, or lack one, are judged each; an empty table gives no rows.
    """
    return passing(docs, learn(docs, labels, "toxic", TOXICITY), lambda scores: scores < TOXIC)


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns unchanged, whose texts are good; odd rows as in `without_toxic`."""
    return passing(docs, learn(docs, labels, "quality", QUALITY), lambda scores: scores >= GOOD)
