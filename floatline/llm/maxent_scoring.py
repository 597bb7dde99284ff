"""Scoring texts by a hashed maximum-entropy model (operator 12).

A text is its words, A-Z in lower case, and one end token.  The model factors
P(word | words before) into a softmax over classes and one over the words of
the class, both linear in hashed features: the word before, the two words
before, and the word before last (a skip).

1. Words of all training texts are counted (map-side combined, shuffled by word).
2. The most frequent words, at most ``KNOWN``, are *known*: every task holds
   their counts.  Of these the first ``MODELLED`` make up the classes, words
   with like neighbours together: the profiles of the words before them, from
   all training texts, are halved along their principal direction until a class
   holds ``SLOTS`` words.  All other words share the last class, in which a word
   has its smoothed corpus count as probability; so the model is a
   distribution over all words, with as much left for unseen words as in the base.
3. Training: in each round, every shard of training tokens makes gradient
   updates from the broadcast weights; the shards' updates are averaged row by
   row, weighted with how often each updated the row, in a tree of sums.  Every
   training token is used once.
4. Texts are scored in sparse numpy batches; for words that are not known, the
   counts are joined.

The broadcast parts have fixed sizes: known words (longer ones stand as a
digest) and weights of ``ROWS`` x ``CLASSES`` and ``ROWS`` x ``SLOTS`` floats.

Defined results: null texts are empty (the end token alone); repeated rows count
and are scored each; extra columns are ignored; a null doc_id is never held
out; an empty table gives an empty result.  With nothing to learn from, every
score is 0.  Texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.llm.common import VECTOR_LAYOUT, gathered, ship_package, slices, staged, table, tree_sum

KNOWN = 0xE000           # most known words; hashed ids of other words follow
START = 0xFFFF           # id of what stands before a text
CLASSES, SLOTS = 32, 128
MODELLED = (CLASSES - 1) * SLOTS
ROWS = 1 << 15           # hashed features of each softmax
PROFILE = 64             # words before, told apart in a word's profile
ROUNDS = 2
SHARD_TOKENS = 8_000_000
BATCH = 8192
STEP = 0.6
LIMIT = 60.0             # of a logit
SLICE = 1 << 18
LONG_WORD = 64           # bytes
PIECE = 1 << 20          # bytes split at once
SOFT = 2048              # tokens of a softmax at once: their exponentials stay in the processor's cache
SHORT = 8                # gradients of a row that are added up in layers
HELD_WORDS = 200_000     # distinct words a task counts before it hands them on
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
TOKEN_LAYOUT = ("uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, ids binary, "
                "rest array<struct<word:binary,n:long>>")


# ---------------------------------------------------------------- words, ids

def words_of(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The words of a text (bytes are its UTF-8), a piece at a time; a long one as a digest of fixed size."""
    text, carry = text.encode() if isinstance(text, str) else text or b"", b""
    for at in range(0, max(1, len(text)), PIECE):
        raw = carry + text[at:at + PIECE].lower()  # bytes: A-Z only
        words, carry = raw.split(), b""            # and the six white-space characters only
        if at + PIECE < len(text) and raw and not raw[-1:].isspace():
            carry = words.pop()
        if words and max(map(len, words)) > LONG_WORD:
            words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.md5(w).digest() for w in words]
        yield words


END = b""


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                         names=["word", "n"])
        counts.clear()
        return out

    for part in batches:
        for text in part.column("text").cast(pa.binary()):
            counts[END] += 1
            for words in words_of(text.as_py()):
                counts.update(words)
                if len(counts) >= HELD_WORDS:
                    yield handed()
    if counts:
        yield handed()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n long) of all texts, written once; the end token is the empty word."""
    counts = docs.select("text").mapInArrow(_count_words, "word binary, n long")
    return staged(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def known_words(counts: DataFrame, most: int = KNOWN) -> list[tuple[bytes, int]]:
    """The most frequent words, the end token first: all at or above the lowest
    count level (eighths of a power of two) that no more than ``most`` reach."""
    level = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 1  # the end token comes along whatever its count
    for at, words in sorted(((r["level"], r["words"]) for r in counts.where(F.col("word") != F.lit(END)).groupBy(level.alias("level"))
                             .agg(F.count("*").alias("words")).collect()), reverse=True):
        held += words
        if held > most:
            break
        least = at
    wanted = F.col("word") == F.lit(END) if least is None else (F.col("word") == F.lit(END)) | (level >= least)
    rows = [(bytes(r["word"]), r["n"]) for r in counts.where(wanted).collect()]
    return sorted(rows, key=lambda r: (r[0] != END, -r[1], r[0]))


class Corpus(NamedTuple):
    """What was counted: the known words' counts by id, all tokens, all distinct words."""
    counts: np.ndarray
    tokens: int
    distinct: int

    def modelled(self) -> int:
        return min(len(self.counts), MODELLED)

    def rest_total(self) -> float:
        """Smoothed total of the last class."""
        return self.tokens - int(self.counts[:MODELLED].sum()) + 0.5 * (self.distinct - self.modelled() + 1)


def _tokenize(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        uid = TaskContext.get().partitionId() << 40
        words, counts = shared.value
        number = {w: i for i, w in enumerate(words)}.get
        logs = np.log10(counts + 0.5)
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "ids", "rest"]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            *columns, rests = zip(*rows)
            ends = np.cumsum([0] + [len(r) for r in rests])
            pairs = pa.StructArray.from_arrays([pa.array([w for r in rests for w in r], pa.binary()),
                                                pa.array([n for r in rests for n in r.values()], pa.int64())], ["word", "n"])
            out = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=names)
            rows.clear()
            return out

        for part in batches:
            for doc_id, held_out, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(),
                                              part.column("text").cast(pa.binary())):
                rest: Counter = Counter()
                ids = []
                for found in (*words_of(text.as_py()), [END]):
                    some = np.fromiter(map(number, found, repeat(-1)), np.int64, len(found))
                    other = np.flatnonzero(some < 0)
                    if len(other):
                        unknown = [found[i] for i in other.tolist()]
                        rest.update(unknown)
                        some[other] = [KNOWN + zlib.crc32(w) % (START - KNOWN) for w in unknown]
                    ids.append(some)
                ids = np.concatenate(ids)
                known = ids[ids < KNOWN]
                rows.append((uid, doc_id, held_out, len(ids), len(known), float(logs[known].sum()),
                             ids.astype("<u2").tobytes(), rest))
                uid += 1
                size += len(ids)
                if size >= PIECE or len(rows) >= 500:
                    yield batch()
                    size = 0
        if rows:
            yield batch()
    return run


# ------------------------------------------------------------------- classes

def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (modelled word, word before) over a task's texts."""
    from pyspark import TaskContext
    total = np.zeros(MODELLED * PROFILE, np.int64)
    for ids, starts in _token_batches(batches, 1 << 20):
        before = np.minimum(np.append(START, ids[:-1]), PROFILE - 1)
        before[starts] = PROFILE - 1
        inside = ids < MODELLED
        total += np.bincount(ids[inside] * PROFILE + before[inside], minlength=len(total))
    yield from _vectors(TaskContext.get().partitionId(), total.astype("<i8"))


def _vectors(shard: int, vec: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in slices(shard, vec, SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(part["slice"], pa.int32()), pa.array(part["shard"], pa.int64()),
                                          pa.array(part["vec"], pa.binary())], names=["slice", "shard", "vec"])


def _token_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, where texts start) of whole texts, some ``most`` tokens at a time."""
    for part in batches:
        held, starts, size = [], [], 0
        for raw in part.column("ids").to_pylist():
            held.append(raw)
            starts.append(size)
            size += len(raw) // 2
            if size >= most:
                yield np.frombuffer(b"".join(held), "<u2").astype(np.int64), np.array(starts)
                held, starts, size = [], [], 0
        if held:
            yield np.frombuffer(b"".join(held), "<u2").astype(np.int64), np.array(starts)


def classes(profiles: np.ndarray, words: int) -> np.ndarray:
    """The class of each of ``words`` modelled words: profiles halved along their
    principal direction, in equal numbers, until one class is left."""
    p = profiles[:words].astype(np.float64)
    p = np.sqrt(p / np.maximum(1, p.sum(axis=1, keepdims=True)))
    out = np.zeros(words, np.int64)

    def split(members: np.ndarray, parts: int, first: int) -> None:
        if parts == 1 or len(members) == 0:
            out[members] = first
            return
        centred = p[members] - p[members].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = members[np.argsort(centred @ direction, kind="stable")]
        half = parts // 2
        cut = len(order) * half // parts
        split(order[:cut], half, first)
        split(order[cut:], parts - half, first + half)

    split(np.arange(words), CLASSES - 1, 0)
    return out


# --------------------------------------------------------------------- model

class Model(NamedTuple):
    cls: np.ndarray         # class of every id
    slot: np.ndarray        # its place within the class
    class_bias: np.ndarray  # (CLASSES,)
    slot_bias: np.ndarray   # (CLASSES, SLOTS)
    class_rows: np.ndarray  # (ROWS, CLASSES)
    slot_rows: np.ndarray   # (ROWS, SLOTS)


def first_model(corpus: Corpus, cls_of: np.ndarray) -> Model:
    """Without features: classes and words by their counts."""
    cls, slot = np.full(START + 1, CLASSES - 1, np.int64), np.zeros(START + 1, np.int64)
    cls[:len(cls_of)] = cls_of
    for k in range(CLASSES - 1):
        members = np.flatnonzero(cls_of == k)
        slot[members] = np.arange(len(members))
    counts = corpus.counts[:len(cls_of)].astype(np.float64)
    mass = np.bincount(cls_of, weights=counts, minlength=CLASSES)
    mass[CLASSES - 1] = corpus.rest_total()
    slot_bias = np.full((CLASSES, SLOTS), -LIMIT, np.float32)
    slot_bias[cls_of, slot[:len(cls_of)]] = np.log(counts / np.maximum(mass[cls_of], 1))
    with np.errstate(divide="ignore"):
        class_bias = np.maximum(np.log(mass / mass.sum()), -LIMIT).astype(np.float32)
    return Model(cls, slot, class_bias, slot_bias, np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SLOTS), np.float32))


def features(ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """A hash for each feature of each token: word before, two words before, word before last."""
    before = []
    for k in (1, 2):
        p = np.full(len(ids), START, np.uint32)
        p[k:] = ids[:-k]
        for j in range(k):
            p[np.minimum(starts + j, len(ids) - 1)] = START
        before.append(p)
    one, two = before  # after a text of one token comes the start of the next

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * _MULT[1]
        return h ^ (h >> np.uint32(13))

    return [mixed(one * _MULT[0] + np.uint32(1)), mixed((one * _MULT[0] + np.uint32(2)) ^ (two * _MULT[2])),
            mixed(two * _MULT[0] + np.uint32(3))]


def _class_row(h: np.ndarray) -> np.ndarray:
    return (h % np.uint32(ROWS)).astype(np.uint16)


def _slot_row(h: np.ndarray, cls: np.ndarray) -> np.ndarray:
    g = (h * _MULT[2]) ^ (cls.astype(np.uint32) * _MULT[0] + np.uint32(77))
    g = (g ^ (g >> np.uint32(16))) * _MULT[1]
    return ((g ^ (g >> np.uint32(14))) % np.uint32(ROWS)).astype(np.uint16)


def _exponentials(bias: np.ndarray, of: np.ndarray | None, weights: np.ndarray, rows: list[np.ndarray],
                  out: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(tokens, exponentials, their sums) of a softmax over ``bias``, or its rows
    ``of``, plus the weights in ``rows``, some tokens at a time."""
    n, width = len(rows[0]), weights.shape[1]
    held = np.empty((2, min(n, SOFT), width), np.float32)
    for s in range(0, n, SOFT):
        some = slice(s, min(n, s + SOFT))
        z, more = (held[0, :some.stop - s] if out is None else out[some]), held[1, :some.stop - s]
        np.take(weights, rows[0][some], axis=0, out=z, mode="clip")
        z += bias if of is None else np.take(bias, of[some], axis=0, out=more, mode="clip")
        for r in rows[1:]:
            z += np.take(weights, r[some], axis=0, out=more, mode="clip")
        np.clip(z, -LIMIT, LIMIT, out=z)
        np.exp(z, out=z)
        yield some, z, z.sum(axis=1, keepdims=True)


def _softmax(bias: np.ndarray, of: np.ndarray | None, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    p = np.empty((len(rows[0]), weights.shape[1]), np.float32)
    for _, z, total in _exponentials(bias, of, weights, rows, p):
        z /= total
    return p


def _chosen(bias: np.ndarray, of: np.ndarray | None, weights: np.ndarray, rows: list[np.ndarray], choice: np.ndarray) -> np.ndarray:
    """Of each token the softmax's value at ``choice``."""
    return np.concatenate([z[np.arange(len(z)), choice[some]] / total[:, 0]
                           for some, z, total in _exponentials(bias, of, weights, rows)])


class Updates:
    """Gradient updates of one weight matrix, each row with its own shrinking step."""

    def __init__(self, weights: np.ndarray):
        self.start, self.weights = weights, weights.copy()
        self.squares = np.zeros(len(weights), np.float32)
        self.times = np.zeros(len(weights), np.float32)

    def apply(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        size = np.diff(at, append=len(ranked))
        g = np.take(gradient, order[at], axis=0)  # rows met once need no sum
        few = np.flatnonzero((size > 1) & (size <= SHORT))
        if len(few):  # the second of each, then the third of those that have one, ...
            few = few[np.argsort(-size[few], kind="stable")]
            rest = np.take(gradient, order[at[few] + 1], axis=0)
            for k in range(2, int(size[few[0]])):
                n = np.count_nonzero(size[few] > k)
                rest[:n] += np.take(gradient, order[at[few[:n]] + k], axis=0)
            g[few] += rest
        many = size > SHORT
        if many.any():
            several = np.take(gradient, order[np.repeat(many, size)], axis=0)
            g[many] = np.add.reduceat(several, np.append(0, np.cumsum(size[many])[:-1]), axis=0)
        row = ranked[at].astype(np.intp)
        squares = self.squares[row] + np.einsum("ij,ij->i", g, g)
        self.squares[row] = squares
        self.times[row] += size
        g *= (-STEP / np.sqrt(squares + 1e-6))[:, None]
        g += np.take(self.weights, row, axis=0)
        self.weights[row] = g

    def summed(self) -> list[np.ndarray]:
        return [((self.weights - self.start) * self.times[:, None]).ravel(), self.times]


def log_probabilities(model: Model, ids: np.ndarray, starts: np.ndarray,
                      learn: tuple[Updates, Updates] | None = None) -> np.ndarray:
    """Of each token, log10 of its class's probability, and of its own within a
    class of modelled words.  With ``learn``, weights are updated batch by batch."""
    hashes = features(ids, starts)
    out = np.zeros(len(ids))
    for s in range(0, len(ids), BATCH):
        token = ids[s:s + BATCH]
        cls = model.cls[token]
        rows = [_class_row(h[s:s + BATCH]) for h in hashes]
        if learn:
            p = _softmax(model.class_bias, None, learn[0].weights, rows)
            n = np.arange(len(token))
            own_p = p[n, cls]
            p[n, cls] -= 1
            for r in rows:
                learn[0].apply(r, p)
        else:
            own_p = _chosen(model.class_bias, None, model.class_rows, rows, cls)
        out[s:s + BATCH] = np.log10(np.maximum(own_p, 1e-30))
        own = np.flatnonzero(cls < CLASSES - 1)
        if not len(own):
            continue
        cls, slot = cls[own], model.slot[token[own]]
        rows = [_slot_row(h[s:s + BATCH][own], cls) for h in hashes]
        if learn:
            p = _softmax(model.slot_bias, cls, learn[1].weights, rows)
            n = np.arange(len(own))
            own_p = p[n, slot]
            p[n, slot] -= 1
            for r in rows:
                learn[1].apply(r, p)
        else:
            own_p = _chosen(model.slot_bias, cls, model.slot_rows, rows, slot)
        out[s + own] += np.log10(np.maximum(own_p, 1e-30))
    return out


def _learn(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        model = shared.value
        learn = Updates(model.class_rows), Updates(model.slot_rows)
        for ids, starts in _token_batches(batches, 1 << 18):
            log_probabilities(model, ids, starts, learn)
        yield from _vectors(TaskContext.get().partitionId(), np.concatenate([x for u in learn for x in u.summed()]).astype("<f4"))
    return run


def train(tokens: DataFrame, corpus: Corpus) -> Model:
    """The model from all rows of ``tokens`` (uid, ids)."""
    context = tokens.sparkSession.sparkContext
    seen = gathered(staged(tree_sum(tokens.select("ids").mapInArrow(_profiles, VECTOR_LAYOUT), "<i8"), "word-profiles"),
                    MODELLED * PROFILE, SLICE, "<i8").reshape(MODELLED, PROFILE)
    model = first_model(corpus, classes(seen, corpus.modelled()))
    sizes = [ROWS * CLASSES, ROWS, ROWS * SLOTS, ROWS]
    shards = max(1, -(-corpus.tokens // (ROUNDS * SHARD_TOKENS)))
    for k in range(ROUNDS):
        part = tokens.where(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == k).select("ids").coalesce(shards)
        shared = context.broadcast(model)
        updates = part.mapInArrow(_learn(shared), VECTOR_LAYOUT)
        whole = gathered(staged(tree_sum(updates, "<f4"), "gradient-updates"), sum(sizes), SLICE, "<f4")
        shared.destroy()  # the updates are written
        a, times_a, b, times_b = np.split(whole, np.cumsum(sizes)[:-1])
        model = model._replace(
            class_rows=model.class_rows + a.reshape(ROWS, CLASSES) / np.maximum(1, times_a)[:, None],
            slot_rows=model.slot_rows + b.reshape(ROWS, SLOTS) / np.maximum(1, times_b)[:, None])
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value
        logs = np.log10(counts + 0.5)
        for part in batches:
            found, modelled = [], []
            for ids, starts in _token_batches([part], 1 << 18):
                value = log_probabilities(model, ids, starts)
                shared_class = np.flatnonzero(model.cls[ids] == CLASSES - 1)
                known = shared_class[ids[shared_class] < KNOWN]
                value[known] += logs[ids[known]]
                found.append(np.add.reduceat(value, starts))
                alone = np.zeros(len(ids), np.int64)
                alone[shared_class] = 1
                modelled.append(np.add.reduceat(alone, starts))
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), pa.array(np.concatenate([np.zeros(0), *found])),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *modelled]))], names=["uid", "model_log", "n_rest"])
    return run


# ----------------------------------------------------------------------- job

def score_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out boolean) with n_tokens, n_known,
    train_tokens, base_score and score; learns from the rows that are not held out."""
    spark = docs.sparkSession
    ship_package(spark)
    held_out = F.coalesce("held_out", F.lit(False)) if "held_out" in docs.columns else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held_out.alias("held_out"))
    counts = word_counts(rows.where("NOT held_out"))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = known_words(counts)
    corpus = Corpus(np.array([n for _, n in known], np.int64), tokens, distinct)
    shared = spark.sparkContext.broadcast(([w for w, _ in known], corpus.counts))
    held = staged(rows.mapInArrow(_tokenize(shared), TOKEN_LAYOUT), "word-ids")
    shared.destroy()

    unseen = F.coalesce("c", F.lit(0))
    others = (held.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.n")
              .join(counts.select("word", F.col("n").alias("c")), "word", "left")
              .groupBy("uid").agg(F.sum(F.col("n") * F.log10(unseen + 0.5)).alias("rest_log"),
                                  F.sum(F.when(unseen > 0, F.col("n")).otherwise(0)).alias("rest_known")))
    if tokens:
        model = spark.sparkContext.broadcast((train(held.where("NOT held_out"), corpus), corpus.counts))
        modelled = held.select("uid", "ids").mapInArrow(_score(model), "uid long, model_log double, n_rest long")
    else:
        modelled = held.select("uid", F.lit(0.0).alias("model_log"), F.col("n_tokens").alias("n_rest"))
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    base_total = float(np.log10(tokens + 0.5 * (distinct + 1)))
    rest_total = float(np.log10(corpus.rest_total()))
    return held.drop("ids", "rest").join(others, "uid", "left").join(modelled, "uid").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("known_log") + rest_log - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("model_log") + rest_log - F.col("n_rest") * rest_total).alias("score"))


def op12_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return score_texts(docs.select("doc_id", "text", F.coalesce(fold == 1, F.lit(False)).alias("held_out")))
