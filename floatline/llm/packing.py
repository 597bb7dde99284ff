"""Best-fit packing of documents into fixed-length sequences (operator 6).

A document is its tokens followed by id 0.  One longer than a sequence is cut
into full pieces; its first piece holds the remainder.  Full pieces are
sequences of their own; the others are packed by bulk-synchronous best fit:

* documents longer than half a sequence open a sequence each (no two fit
  together), the room left is a *gap*;
* a round range-sorts gaps and pieces together by length, longest first, gaps
  before pieces of the same length.  A sweep over each range matches every
  piece with its successor: the smallest gap not shorter than it that no
  longer piece took (a stack; conflicts between pieces are resolved by rank).
  What a range leaves over, pieces without a gap and gaps without a piece, is
  matched across ranges from per-range counts alone: one row a range goes to
  the driver, the leftovers are numbered and joined by number;
* once all pieces and gaps left fit one range, its remaining rounds are run in place;
* matched gaps shrink by the piece they took, the rest goes to the next
  round.  When a round leaves pieces that no gap can hold, the longest of
  them open as many new sequences as their tokens need.

Where the mean piece would need many to fill a sequence, very short pieces
are first tied in bundles, so rounds stay few.  Ranges have a
bounded number of rows, however many pieces share one length.

Defined results: null and empty texts are the single id 0.  Repeated rows are
documents of their own.  Extra columns are ignored, an empty table gives an
empty result.  Token ids are those of the ``tokenizers`` file byte_bpe_50k;
the added token <|endoftext|> is cut out of a text first, as there.  The text
between is encoded with tiktoken over the same vocabulary, six times faster
(tests compare the two); texts with a very long run of white space, on which
tiktoken runs out of stack, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.llm.common import staged, table, text_input

LENGTH = 2048
RANGE_ROWS = 20_000
BUNDLE = 128
FILLERS = 16  # one in so many short pieces stays single, to fill what bundles leave
END_OF_TEXT = "<|endoftext|>"  # the added token of the tokenizers file
LONG_SPACE = 100_000  # characters
PIECE_LAYOUT = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(name: str):
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(name + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name + ".json"))


def token_ids(text: str | None, name: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of a document, with the closing 0."""
    text = text or ""
    if len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in re.finditer(r"\s+", text)):
        return np.asarray(_tokenizer(name).encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
    encode = _encoder(name).encode_ordinary
    if END_OF_TEXT not in text:
        return np.asarray(encode(text) + [0], dtype="<u4")
    end = _tokenizer(name).token_to_id(END_OF_TEXT)
    ids: list[int] = []
    for part in text.split(END_OF_TEXT):
        ids += encode(part) + [end]
    return np.asarray(ids[:-1] + [0], dtype="<u4")


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = n % length if n > length else n
    bounds = ([0] if head else []) + list(range(head, n + 1, length))
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _pieces(length: int, name: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        uid = TaskContext.get().partitionId() << 40
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                ids = token_ids(text.as_py(), name)
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    rows.append((uid, doc_id, k, start, n, zlib.crc32(ids[start:start + n])))
                    uid += 1
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=[c.split()[0] for c in PIECE_LAYOUT.split(", ")])
    return run


def pieces(docs: DataFrame, length: int = LENGTH, name: str = "byte_bpe_50k") -> DataFrame:
    return text_input(docs).mapInArrow(_pieces(length, name), PIECE_LAYOUT)


def _sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range, longest first: match pieces with the latest gap still open.

    Emits every row: pieces and gaps with the other's id if matched, else with
    their number among the range's leftovers."""
    from pyspark import TaskContext
    here = TaskContext.get().partitionId()
    pdf = pd.concat(list(parts), ignore_index=True) if (parts := list(parts)) else None
    if pdf is None:
        return
    kind = pdf["kind"].to_numpy()  # 0 gap, 1 piece
    mate = np.full(len(pdf), -1, np.int64)
    stack: list[int] = []
    for i, k in enumerate(kind.tolist()):
        if k == 0:
            stack.append(i)
        elif stack:
            j = stack.pop()
            mate[i], mate[j] = j, i
    left = mate < 0
    number = np.full(len(pdf), -1, np.int64)
    for k in (0, 1):
        mine = left & (kind == k)
        number[mine] = np.arange(mine.sum())
    ids, sizes = pdf["id"].to_numpy(), pdf["size"].to_numpy()
    yield pdf.assign(mate=np.where(left, -1, ids[mate]), mate_size=np.where(left, 0, sizes[mate]), part=here, number=number)


def _meet(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Match leftovers across ranges from (range, gaps, pieces) in range order:
    (gap range, gap number, piece range, piece number, how many); gap numbers
    go down while piece numbers go up."""
    stack: list[list[int]] = []
    out = []
    for part, gaps, items in counts:
        at = 0
        while at < items and stack:
            top = stack[-1]
            n = min(items - at, top[1])
            out.append((top[0], top[1] - 1, part, at, n))
            at += n
            top[1] -= n
            if not top[1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


SWEPT = "id long, size long, kind int, mate long, mate_size long, part int, number long"
GAP, PIECE, PLACED = 0, 1, 2


def _round(rows: DataFrame, n_rows: int, length: int, level: int) -> DataFrame:
    """One sweep over gaps and pieces (id, size, kind): the gaps and pieces
    after it, and a row for every piece placed (its sequence and offset)."""
    spark = rows.sparkSession
    n = max(1, -(-n_rows // RANGE_ROWS))
    order = [F.col("size").desc(), F.col("kind").asc(), F.col("id").asc()]
    swept = staged(rows.select("id", "size", "kind").repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .mapInPandas(_sweep, SWEPT), f"sweep{level}")
    left = swept.where("mate < 0")
    counts = left.groupBy("part").agg(F.sum((F.col("kind") == GAP).cast("int")).alias("gaps"),
                                      F.sum((F.col("kind") == PIECE).cast("int")).alias("items")).orderBy("part")
    plan = _meet([(r["part"], r["gaps"], r["items"]) for r in counts.collect()])  # a row a range
    matched = swept.where((F.col("mate") >= 0) & (F.col("kind") == GAP)).select("id", "size", F.col("mate").alias("item"), F.col("mate_size").alias("used"))
    rest = left.select("id", "size", "kind")
    if plan:
        # Segments: at most two a range; they are broadcast, the rows meet by pair number.
        segments, pair = [], 0
        for gpart, gtop, ipart, ifirst, many in plan:
            segments += [(gpart, GAP, gtop - many + 1, gtop, pair + gtop, -1), (ipart, PIECE, ifirst, ifirst + many - 1, pair - ifirst, 1)]
            pair += many
        seg = F.broadcast(spark.createDataFrame(segments, "part int, kind int, low long, high long, base long, step int"))
        numbered = left.join(seg, ["part", "kind"], "left").where("low IS NULL OR number BETWEEN low AND high") \
            .select("id", "size", "kind", (F.col("base") + F.col("step") * F.col("number")).alias("pair"))
        # a leftover beyond its range's segments has none of them
        last = seg.groupBy("part", "kind").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        beyond = left.join(F.broadcast(last), ["part", "kind"]).where("number < low OR number > high").select("id", "size", "kind")
        rest = numbered.where("pair IS NULL").select("id", "size", "kind").union(beyond)
        g = numbered.where((F.col("pair").isNotNull()) & (F.col("kind") == GAP)).select("id", "size", "pair")
        i = numbered.where((F.col("pair").isNotNull()) & (F.col("kind") == PIECE)).select(F.col("id").alias("item"), F.col("size").alias("used"), "pair")
        matched = matched.union(g.join(i, "pair").select("id", "size", "item", "used"))
    # a match gives two rows: the gap that is left, and the placed piece
    both = matched.select(F.explode(F.array(
        F.struct("id", (F.col("size") - F.col("used")).alias("size"), F.lit(GAP).alias("kind"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")),
        F.struct(F.col("item").alias("id"), F.col("used").alias("size"), F.lit(PLACED).alias("kind"), F.col("id").alias("sequence_id"), (F.lit(length) - F.col("size")).alias("offset")))).alias("r")).select("r.*")
    return both.union(rest.select("id", "size", "kind", F.lit(None).cast("long"), F.lit(None).cast("long")))


def _finish(length: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last pieces, longest first, each into its successor among the
        gaps as they then are; one without a successor opens a sequence."""
        pdf = pd.concat(parts, ignore_index=True)
        open_ = sorted((s, i) for s, i, k in zip(pdf["size"], pdf["id"], pdf["kind"]) if k == GAP)
        rows = []
        for size, uid in sorted(((s, i) for s, i, k in zip(pdf["size"], pdf["id"], pdf["kind"]) if k == PIECE), reverse=True):
            at = bisect.bisect_left(open_, (size, -1))
            room, sequence = open_.pop(at) if at < len(open_) else (length, uid)
            rows.append((uid, sequence, length - room))
            bisect.insort(open_, (room - size, sequence))
        yield pd.DataFrame(rows, columns=["id", "sequence_id", "offset"])
    return run


def _bundle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tie neighbouring short pieces: every piece with its bundle and place in it."""
    bundle, used = -1, BUNDLE
    for pdf in parts:
        tied, place = [], []
        for uid, size in zip(pdf["id"].tolist(), pdf["size"].tolist()):
            if used + size > BUNDLE:
                bundle, used = uid, 0
            tied.append(bundle)
            place.append(used)
            used += size
        yield pdf.assign(bundle=tied, place=place)


def _opened(rows: DataFrame, opens, length: int) -> DataFrame:
    """(id, size, kind, sequence_id, offset): pieces for which ``opens`` holds
    start a sequence, whose room left becomes a gap."""
    none = F.lit(None).cast("long")
    new = (F.col("kind") == PIECE) & opens
    first = F.struct("id", "size", F.lit(PLACED).alias("kind"), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    room = F.struct("id", (F.lit(length) - F.col("size")).alias("size"), F.lit(GAP).alias("kind"), none.alias("sequence_id"), none.alias("offset"))
    same = F.struct("id", "size", "kind", none.alias("sequence_id"), none.alias("offset"))
    return rows.select(F.explode(F.when(new, F.array(first, room)).otherwise(F.array(same))).alias("r")).select("r.*")


def best_fit(sizes: DataFrame, length: int = LENGTH) -> DataFrame:
    """``sizes`` (id long, size long; ids distinct, 0 < size <= length) placed:
    id, sequence_id, offset.  A sequence is named after its first piece."""
    whole = sizes.where(F.col("size") == length).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = sizes.where(F.col("size") < length).select("id", "size")
    stat = items.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")).first()
    tied = None
    if stat["n"] and stat["tokens"] / stat["n"] < BUNDLE:
        tie = (F.col("size") < BUNDLE // 2) & (F.pmod(F.xxhash64("id"), F.lit(FILLERS)) > 0)
        short = items.where(tie)
        parts = max(1, -(-stat["n"] // (10 * RANGE_ROWS)))
        tied = staged(short.repartition(parts, F.xxhash64("id")).sortWithinPartitions(F.xxhash64("id"), "id")
                      .mapInPandas(_bundle, "id long, size long, bundle long, place long"), "bundles")
        bundles = tied.groupBy(F.col("bundle").alias("id")).agg(F.sum("size").alias("size"))
        items = staged(items.where(~tie).union(bundles), "tied")
    opens = F.col("size") > length // 2
    placed, level = [], 0
    state = _opened(items.select("id", "size", F.lit(PIECE).alias("kind")), opens, length)
    state = staged(state, "state0")
    while True:
        placed.append(state.where(F.col("kind") == PLACED).select("id", "sequence_id", "offset"))
        is_gap, is_piece = F.col("kind") == GAP, F.col("kind") == PIECE
        stat = state.agg(F.count_if(is_gap).alias("gaps"), F.count_if(is_piece).alias("pieces"), F.max(F.when(is_gap, F.col("size"))).alias("largest"),
                         F.max(F.when(is_piece, F.col("size"))).alias("longest"), F.min(F.when(is_piece, F.col("size"))).alias("shortest")).first()
        if not stat["pieces"]:
            break
        usable = is_gap & (F.col("size") >= stat["shortest"])  # other gaps are closed for good
        rows = state.where(is_piece | usable).select("id", "size", "kind")
        if stat["pieces"] + stat["gaps"] <= RANGE_ROWS or stat["pieces"] + rows.where(usable).count() <= RANGE_ROWS:
            # what is left is one range: its rounds are run in place
            placed.append(rows.repartition(1).mapInPandas(_finish(length), "id long, sequence_id long, offset long"))
            break
        bound = stat["largest"] or 0
        if bound < stat["longest"]:
            # pieces above every gap: the longest of them open what their tokens need
            over = rows.where(is_piece & (F.col("size") > bound)).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
            by_size = {r["size"]: r["n"] for r in over.collect()}  # a row a length
            need = -(-sum(s * n for s, n in by_size.items()) // length)
            limit = before = count = 0
            for limit in sorted(by_size, reverse=True):
                before, count = count, count + by_size[limit]
                if count >= need:
                    break
            # of the last length, about as many as are missing, by a hash of the id
            share = F.lit(int((need - before) / by_size[limit] * (1 << 20)))
            some = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 20)) <= share
            rows = _opened(rows, (F.col("size") > limit) | ((F.col("size") == limit) & some), length)
        else:
            rows = _opened(rows, F.lit(False), length)
        rows = staged(rows, f"rows{level}")
        placed.append(rows.where(F.col("kind") == PLACED).select("id", "sequence_id", "offset"))
        state = staged(_round(rows.where(F.col("kind") != PLACED), stat["gaps"] + stat["pieces"], length, level), f"state{level + 1}")
        level += 1
    out = placed[0]
    for part in placed[1:]:
        out = out.union(part)
    if tied is not None:
        at = out.withColumnRenamed("id", "bundle").withColumnRenamed("offset", "base")
        inside = tied.join(at, "bundle").select("id", "sequence_id", (F.col("base") + F.col("place")).alias("offset"))
        out = out.join(tied.select(F.col("bundle").alias("id")).distinct(), "id", "left_anti").union(inside)
    return whole.union(out)


def pack_documents(docs: DataFrame, length: int = LENGTH, name: str = "byte_bpe_50k") -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = staged(pieces(docs, length, name), "pieces")
    place = best_fit(cut_up.select(F.col("uid").alias("id"), F.col("length").alias("size")), length)
    place = place.select(F.col("id").alias("uid"), "sequence_id", "offset")
    return cut_up.join(place, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, packed: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>.

    ``docs`` must have distinct doc_ids; their ids are computed again next to
    the text, cut by the placement, and gathered by sequence (at most one
    sequence's length a row)."""
    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text, where in zip(pdf["text"], pdf["places"]):
                ids = token_ids(text, name)
                rows += [(p["sequence_id"], p["offset"], ids[p["start"]:p["start"] + p["length"]].astype(np.int32)) for p in where]
            yield pd.DataFrame(rows, columns=["sequence_id", "offset", "ids"])

    parts = text_input(docs).join(places, "doc_id").select("text", "places").mapInPandas(run, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
