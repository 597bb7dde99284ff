"""Alignment of two tokenizers over a corpus (operator 13).

Every text is cut by a byte-level BPE (A) and a piece BPE (B).  Offsets where a
token of each ends cut the text into groups; the two tokens ending there are a
*link*.  Corpus-wide, each pair of ids gets the number of its links.

Two tokens that end together end with the same bytes, so the shorter is a
suffix of the longer.  The pairs that can ever be linked therefore follow from
the vocabularies alone (324,297 of them for the two used here, however large
the corpus), and a minimal perfect hash numbers them: a cascade of bit tables,
a key taking the first level where no other key shares its bit, its number
being the rank of that bit.  The keys are stored by number, and every look-up
is verified against them.

1. Texts are tokenized once; ids are written to the shared folder, two bytes each.
2. First pass: every task aligns its documents and counts links in one dense
   vector indexed by the hash; vectors are added up in a tree, slice by slice.
3. Second pass: documents are aligned again from their ids and look up the
   counts, which are broadcast (8 bytes a possible pair).

Defined results: null and empty texts, and texts one tokenizer does not give
back byte by byte, have no tokens: zeros and ''.  Repeated rows count each,
extra columns are ignored, an empty table gives an empty result.  Special
tokens' strings are plain text.  Texts of any length are read whole; documents
are aligned some million tokens at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.llm.common import VECTOR_LAYOUT, gathered, slices, staged, table, text_input, tree_sum

A_NAME, B_NAME = "byte_bpe_50k", "piece_bpe_32k"
SLICE = 1 << 14
CHUNK = 1 << 20   # tokens aligned at once
LONG_SPACE = 100_000  # characters of one white-space run, too deep for tiktoken's pattern
IDS = "<u2"
GROUPS_LAYOUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                 "count_sum long, groups string")


# ---------------------------------------------------------------- tokenizers

@lru_cache(maxsize=2)
def _byte_bpe(name: str):
    import base64

    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(name + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@lru_cache(maxsize=2)
def _byte_bpe_json(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name + ".json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def _piece_bpe(name: str):
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name + ".model"))


@lru_cache(maxsize=2)
def entry_bytes(a_name: str = A_NAME, b_name: str = B_NAME) -> tuple[list[bytes], list[bytes]]:
    """Bytes of every id of A and of B; ids that stand for no text have none."""
    _, ranks = _byte_bpe(a_name)
    a = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        a[i] = token
    pieces = _piece_bpe(b_name)
    b = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        if pieces.is_control(i) or pieces.is_unknown(i):
            b.append(b"")
        elif pieces.is_byte(i):
            b.append(bytes([int(piece[3:5], 16)]))
        else:
            b.append(piece.replace("▁", " ").encode())
    return a, b


def _long_space(text: str) -> bool:
    import re
    return len(text) >= LONG_SPACE and re.search(r"\s{%d}" % LONG_SPACE, text) is not None


def encode(texts: list[str | None], a_name: str = A_NAME, b_name: str = B_NAME) -> list[tuple[bytes, bytes]]:
    """Ids of A and of B, two bytes each, for every text; both empty where a
    tokenizer does not give the text back."""
    fast, _ = _byte_bpe(a_name)
    a_bytes, b_bytes = entry_bytes(a_name, b_name)
    out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(texts)
    held = [i for i, text in enumerate(texts) if text]
    for i, b in zip(held, _piece_bpe(b_name).encode([texts[i] for i in held], num_threads=1)):
        whole = " " + texts[i]
        raw = whole.encode()
        if b"".join(map(b_bytes.__getitem__, b)) != raw:
            continue
        a = _byte_bpe_json(a_name).encode(whole, add_special_tokens=False).ids if _long_space(whole) \
            else fast.encode_ordinary(whole)
        if b"".join(map(a_bytes.__getitem__, a)) == raw:
            out[i] = np.array(a, IDS).tobytes(), np.array(b, IDS).tobytes()
    return out


def _tokenize(a_name: str, b_name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            at = 0
            while at < len(texts):  # some MB of text at a time
                end, size = at, 0
                while end < len(texts) and size < 4 << 20:
                    size += len(texts[end] or "")
                    end += 1
                a, b = zip(*encode(texts[at:end], a_name, b_name))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:end].astype("Int64").array, "a": a, "b": b})
                at = end
    return run


# -------------------------------------------------------- minimal perfect hash

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Numbers 0..n-1 for n distinct non-negative keys, none twice."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        keys = np.unique(np.asarray(keys, np.int64))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, base = keys, 0
        while len(rest):
            bits = 64 * max(1, int(np.ceil(room * len(rest) / 64)))
            at = (_mix(rest, len(self.levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
            rest = rest[~alone[at]]
        self.keys = np.zeros(len(keys), np.int64)
        self.keys[self._number(keys)] = keys

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = _mix(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[word[hit]] + below[hit]
            left = left[~hit]
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for those that are none of the hash's own."""
        keys = np.asarray(keys, np.int64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._number(keys)
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1)


def possible_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """Keys ``a * len(b_bytes) + b`` of all id pairs whose bytes can end together."""
    ids_of: dict[bytes, list[int]] = {}
    for i, x in enumerate(b_bytes):
        ids_of.setdefault(x, []).append(i)
    a_of = {x: i for i, x in enumerate(a_bytes)}
    n, keys = len(b_bytes), []
    for i, x in enumerate(a_bytes):
        for cut in range(len(x)):
            keys += [i * n + j for j in ids_of.get(x[cut:], ())]
    for j, x in enumerate(b_bytes):
        for cut in range(1, len(x)):
            if (i := a_of.get(x[cut:])) is not None:
                keys.append(i * n + j)
    return np.unique(np.array(keys, np.int64))


# ------------------------------------------------------------------ alignment

def align(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of the tokens that end together, in order.
    Both are the ids of the same bytes, of one document or of several in a row."""
    end_a, end_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.full(int(end_a[-1]) + 1, -1, np.int32)
    at[end_b] = np.arange(len(b), dtype=np.int32)
    met = at[end_a]
    first = np.flatnonzero(met >= 0)
    return first, met[first].astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of A, of B, ends of the documents in A, in B) of some documents at a time."""
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        parts = [batch.column(c).to_pylist() for c in ("a", "b")]
        at = 0
        while at < len(doc_ids):
            end, size = at, 0
            while end < len(doc_ids) and size < CHUNK:
                size += len(parts[0][end]) // 2
                end += 1
            a, b = (np.frombuffer(b"".join(p[at:end]), IDS).astype(np.int64) for p in parts)
            ends = [np.cumsum([len(x) // 2 for x in p[at:end]]) for p in parts]
            yield doc_ids[at:end], a, b, ends[0], ends[1]
            at = end


def _sizes(entries: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in entries], np.int64)


def _numbers(index: PerfectHash, a: np.ndarray, b: np.ndarray, n_b: int) -> np.ndarray:
    found = index.look_up(a * n_b + b)
    if len(found) and found.min() < 0:
        raise ValueError("two tokens ended together whose bytes do not end alike")
    return found


def _count(model, a_name: str, b_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        index = model.value
        a_bytes, b_bytes = entry_bytes(a_name, b_name)
        a_size, b_size = _sizes(a_bytes), _sizes(b_bytes)
        total = np.zeros(len(index), np.int64)
        for _, a, b, _, _ in _chunks(batches):
            i, j = align(a, b, a_size, b_size)
            total += np.bincount(_numbers(index, a[i], b[j], len(b_bytes)), minlength=len(total))
        for part in slices(TaskContext.get().partitionId(), total, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(part["slice"], pa.int32()), pa.array(part["shard"], pa.int64()),
                                              pa.array(part["vec"], pa.binary())], names=["slice", "shard", "vec"])
    return run


def _names(count: int, marks: tuple[str, str]) -> np.ndarray:
    """'12,' for an id within its group, '12|' (or '12;') for the last; the latter ``count`` further on."""
    return np.array([f"{i}{mark}" for mark in marks for i in range(count)], object)


def _written(a, b, i, j, names_a, names_b, n_a: int, n_b: int) -> np.ndarray:
    """Tokens in the order of the groups' notation, each with its mark."""
    out = np.empty(len(a) + len(b), object)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[i], last_b[j] = n_a, n_b
    # an A token comes after the B tokens of earlier groups, a B token after the A tokens of its own too
    out[np.arange(len(a)) + np.repeat(np.append(0, j + 1)[:-1], np.diff(i, prepend=-1))] = names_a[a + last_a]
    out[np.arange(len(b)) + np.repeat(i + 1, np.diff(j, prepend=-1))] = names_b[b + last_b]
    return out


def _look_up(model, a_name: str, b_name: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, best = model.value
        a_bytes, b_bytes = entry_bytes(a_name, b_name)
        a_size, b_size = _sizes(a_bytes), _sizes(b_bytes)
        names_a, names_b = _names(len(a_bytes), (",", "|")), _names(len(b_bytes), (",", ";"))
        for doc_ids, a, b, end_a, end_b in _chunks(batches):
            i, j = align(a, b, a_size, b_size)
            pair = _numbers(index, a[i], b[j], len(b_bytes))
            written = _written(a, b, i, j, names_a, names_b, len(a_bytes), len(b_bytes))
            groups = []
            for at, end in zip(np.append(0, (end_a + end_b)[:-1]), end_a + end_b):
                text = "".join(written[at:end].tolist())[:-1]
                groups.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
            links = np.searchsorted(i, end_a)  # links up to each document's end

            def per_document(x: np.ndarray) -> np.ndarray:
                return np.diff(np.append(0, np.cumsum(x))[links], prepend=0)

            n_links = np.diff(links, prepend=0)
            columns = [np.diff(end_a, prepend=0), np.diff(end_b, prepend=0), n_links, n_links,
                       per_document(best[pair]), per_document(counts[pair])]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns),
                                              pa.array(groups, pa.string())],
                                             names=[c.split()[0] for c in GROUPS_LAYOUT.split(", ")])
    return run


def token_ids(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME) -> DataFrame:
    """(doc_id, a, b): both tokenizers' ids of every document, two bytes each, written once."""
    rows = text_input(docs).mapInPandas(_tokenize(a_name, b_name), "doc_id long, a binary, b binary")
    return staged(rows, "token-ids")


def link_counts(ids: DataFrame, index: PerfectHash, a_name: str = A_NAME, b_name: str = B_NAME) -> np.ndarray:
    """How many links of the corpus hold each pair, by its number in ``index``."""
    model = ids.sparkSession.sparkContext.broadcast(index)
    parts = ids.mapInArrow(_count(model, a_name, b_name), VECTOR_LAYOUT)
    return gathered(staged(tree_sum(parts, "<i8"), "link-counts"), len(index), SLICE, "<i8")


def aligned(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME, digest: bool = False) -> DataFrame:
    """One row a document: token, group and link numbers, how many links are
    their B id's most frequent, the sum of the links' counts, and ``groups`` as
    `a1,a2|b1;a3|b2,b3` (its SHA-256 in hex with ``digest``)."""
    ids = token_ids(docs, a_name, b_name)
    a_bytes, b_bytes = entry_bytes(a_name, b_name)
    index = PerfectHash(possible_pairs(a_bytes, b_bytes))
    counts = link_counts(ids, index, a_name, b_name)
    highest = np.zeros(len(b_bytes), np.int64)
    np.maximum.at(highest, index.keys % len(b_bytes), counts)
    best = ((counts == highest[index.keys % len(b_bytes)]) & (counts > 0)).astype(np.int64)
    model = ids.sparkSession.sparkContext.broadcast((index, counts, best))
    return ids.mapInArrow(_look_up(model, a_name, b_name, digest), GROUPS_LAYOUT)


def pair_table(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME) -> DataFrame:
    """(a long, b long, count long) of every pair linked somewhere in ``docs``."""
    ids = token_ids(docs, a_name, b_name)
    a_bytes, b_bytes = entry_bytes(a_name, b_name)
    index = PerfectHash(possible_pairs(a_bytes, b_bytes))
    counts = link_counts(ids, index, a_name, b_name)
    seen = np.flatnonzero(counts)
    rows = pd.DataFrame({"a": index.keys[seen] // len(b_bytes), "b": index.keys[seen] % len(b_bytes), "count": counts[seen]})
    return docs.sparkSession.createDataFrame(rows, "a long, b long, count long")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
