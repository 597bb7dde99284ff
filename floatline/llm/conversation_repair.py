"""Conversation structure repair (operator 11).

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  Its rows,
in order, are edited one after another: Keep costs 0, Rerole to user or
assistant 2, Delete 3 (the only way with blank rows and duplicates), Insert an
empty user or assistant row 2; a truncated row that stays adds 1.  Wanted are
the cheapest edits, among these the ones whose letters read least.

The edit lattice has a node (rows consumed, state) for the states nothing
written / system / user / assistant last.  Bidirectional Dijkstra runs a heap
from the start and one from the ends; it goes on until no unexplored path can
be as cheap as the best meeting, so every equal-cost crossing is known.  The
tight edges on both sides of the crossings are exactly those of the cheapest
paths.  The least letter at each node then spells the least audit: letters lead
from a node to different nodes, and no audit from a node to another is the
beginning of an equally cheap one (it would end in paid insertions).

Rows are range-partitioned by (conversation, turn, role, text) and cut into
*blocks* of bounded size.  A conversation that lies within one block is solved
there.  The blocks of a longer one, however long, are solved in parallel, from
each state to each state; the same search over a lattice of blocks then picks
one path a block.  Digests of long conversations are read in order from the
sorted blocks, a block at a time.

Defined results: a null role or text is one space; null turns come first; rows
of one turn follow by role, then text (code points); equal rows of a turn stand
side by side.  A null conv_id is a conversation of its own.  Roles are judged
by their first character; an empty role has none and is legal nowhere.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatline.llm.common import WHITE_SPACE, ship_package, staged, table

BLOCK_ROWS = 1024
BLOCK_CHARS = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
BLOCK_LAYOUT = ("conv_id long, pid long, seq long, open boolean, roles array<string>, texts array<string>, "
                "faults string")
REPAIR_LAYOUT = "conv_id long, illegal long, cost long, audit string, repaired_sha256 string"


# ------------------------------------------------------------------ the search

Edges = Callable[[tuple], list]


def least_path(out: Edges, into: Edges, start: tuple, goals: set[tuple]) -> tuple[int, list[tuple]] | None:
    """(cost, edges (label, cost, node)) of the cheapest path from ``start`` to one
    of ``goals``, of equally cheap ones that whose labels read least; None if there
    is none.  ``out`` gives a node's edges (label, cost, next), ``into`` (label,
    cost, previous); a goal that costs nothing more is where the path ends."""
    ahead, back = {start: 0}, dict.fromkeys(goals, 0)
    heaps = [[(0, start)], [(0, g) for g in sorted(goals)]]
    done: tuple[set, set] = (set(), set(goals))
    best = 0 if start in goals else None
    closed: set = set()
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        mine, other, step = (ahead, back, out) if side == 0 else (back, ahead, into)
        cost, node = heapq.heappop(heaps[side])
        if (side, node) in closed or cost > mine[node]:
            continue
        closed.add((side, node))
        done[side].add(node)
        for _, w, to in step(node):
            if cost + w < mine.get(to, cost + w + 1):
                mine[to] = cost + w
                heapq.heappush(heaps[side], (cost + w, to))
            if to in other and (best is None or cost + w + other[to] < best):
                best = cost + w + other[to]
    if best is None:
        return None
    good: dict[tuple, set] = {}
    left, right = [], []
    for u in done[0]:
        if u in goals and ahead[u] == best:
            left.append(u)
        for label, w, v in out(u):
            if v in done[1] and ahead[u] + w + back[v] == best:
                good.setdefault(u, set()).add((label, w, v))
                left.append(u)
                right.append(v)
    seen = set(left)
    while left:  # tight edges that lead to a crossing
        v = left.pop()
        for label, w, u in into(v):
            if u in done[0] and ahead[u] + w == ahead[v]:
                good.setdefault(u, set()).add((label, w, v))
                if u not in seen:
                    seen.add(u)
                    left.append(u)
    seen = set(right)
    while right:  # and those that lead on from one
        u = right.pop()
        for label, w, v in out(u):
            if v in done[1] and back[v] + w == back[u]:
                good.setdefault(u, set()).add((label, w, v))
                if v not in seen:
                    seen.add(v)
                    right.append(v)
    path, node, cost = [], start, 0
    while not (node in goals and cost == best):
        edge = min(good[node])
        path.append(edge)
        node, cost = edge[2], cost + edge[1]
    return best, path


def _written(state: int) -> int:
    """The state after a user or assistant row is written: which of the two follows from the state."""
    return ASSISTANT if state == USER else USER


def _kept(initial: str, state: int) -> int | None:
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "ua"[state == USER]:
        return _written(state)
    return None


def lattice(initials: list[str], faults: str, last: bool) -> tuple[Edges, Edges]:
    """Edges out of and into the nodes (rows consumed, state) of some rows in
    order.  ``faults`` has a letter a row: x must go, t truncated, - none.  After
    the last row rows can be inserted only if it is the conversation's ``last``."""
    n = len(initials)

    def row_edges(i: int, state: int) -> list:
        edges = [("D", DELETE, (i + 1, state))]
        if faults[i] != "x":
            more = TRUNCATED if faults[i] == "t" else 0
            if (to := _kept(initials[i], state)) is not None:
                edges.append(("K", KEEP + more, (i + 1, to)))
            edges.append(("R", REROLE + more, (i + 1, _written(state))))
        return edges

    def out(node: tuple) -> list:
        i, state = node
        edges = row_edges(i, state) if i < n else []
        return edges + [("I", INSERT, (i, _written(state)))] if i < n or last else edges

    def into(node: tuple) -> list:
        i, state = node
        edges = []
        if i:
            for before in range(4):
                edges += [(label, w, (i - 1, before)) for label, w, to in row_edges(i - 1, before) if to == node]
        if i < n or last:
            edges += [("I", INSERT, (i, before)) for before in range(4) if _written(before) == state]
        return edges

    return out, into


def best_edits(initials: list[str], faults: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    out, into = lattice(initials, faults, True)
    cost, path = least_path(out, into, (0, NOTHING), {(len(initials), s) for s in ENDS})
    return cost, "".join(e[0] for e in path)


def transfers(initials: list[str], faults: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block within a conversation;
    rows inserted after its last row are the next block's."""
    out, into = lattice(initials, faults, False)
    found = []
    for before in range(4):
        for after in range(4):
            got = least_path(out, into, (0, before), {(len(initials), after)})
            if got is not None:
                found.append((before, after, got[0], "".join(e[0] for e in got[1])))
    return found


def chain(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, (state before, audit) of every block) of a conversation of several
    blocks, given their transfers."""
    n = len(blocks)
    closing = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    outs: dict[tuple, list] = {(n, s): [(audit, INSERT * len(audit), (n + 1, 0))] for s, audit in closing.items()}
    for k, pairs in enumerate(blocks):
        for before, after, cost, audit in pairs:
            outs.setdefault((k, before), []).append((audit, cost, (k + 1, after)))
    intos: dict[tuple, list] = {}
    for node, edges in outs.items():
        for audit, cost, to in edges:
            intos.setdefault(to, []).append((audit, cost, node))
    cost, path = least_path(lambda x: outs.get(x, []), lambda x: intos.get(x, []), (0, NOTHING), {(n + 1, 0)})
    states = [NOTHING] + [e[2][1] for e in path[:-2]]
    audits = [e[0] for e in path[:-1]]
    audits[-1] += path[-1][0]
    return cost, list(zip(states, audits))


def apply_edits(roles: list[str], texts: list[str | None], state: int, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave."""
    i = 0
    for letter in audit:
        if letter == "K":
            state = _kept(roles[i][:1], state)
            yield roles[i], texts[i]
        elif letter != "D":
            state = _written(state)
            yield ("assistant" if state == ASSISTANT else "user"), (texts[i] if letter == "R" else "")
        i += letter != "I"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


# ------------------------------------------------------------------- the jobs

def faulty_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, blank, truncated, first): equal rows of one
    turn as one with their number; ``first`` if role and text were not seen earlier
    in the conversation.  Only digests are grouped for that, with a map-side
    combine, so a text repeated any number of times is no hot key."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                       (F.col("copies") if "copies" in rows.columns else F.lit(1)).cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"),
                     F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)))
    early = rows.groupBy("key").agg(F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("least"))
    end = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    return rows.join(early, "key").select(
        "conv_id", "turn", "role", "text", "n", (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least")).alias("first"))


def fault_counts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) from ``faulty_rows``."""
    n, blank, first, cut = (F.col(c) for c in ("n", "blank", "first", "truncated"))
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(blank, n).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(first, n - 1).otherwise(n)).alias("duplicate"),
        F.sum(F.when(~blank & first & cut, 1).otherwise(0)).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long"))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range as blocks.  ``open`` are those whose conversation
    may reach beyond the block."""
    from pyspark import TaskContext
    pid, seq = TaskContext.get().partitionId(), 0
    conv, started, whole = None, False, False   # whole: the block begins where its conversation begins
    roles, texts, faults, size = [], [], [], 0
    names = [c.split()[0] for c in BLOCK_LAYOUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
        held.clear()
        return out

    for part in batches:
        columns = {name: part.column(name).to_pylist() for name in part.schema.names}
        for key, role, text, n, blank, cut, first in zip(*(columns[c] for c in ("conv_id", "role", "text", "n", "blank",
                                                                                   "truncated", "first"))):
            for copy in range(n):
                new = not started or key != conv
                if roles and (new or len(roles) >= BLOCK_ROWS or size >= BLOCK_CHARS):
                    held.append((conv, pid, seq, not (whole and new), roles, texts, "".join(faults)))
                    seq += 1
                    roles, texts, faults, size = [], [], [], 0
                    if len(held) >= 64:
                        yield batch()
                    whole = False
                if new:
                    whole = started  # the first conversation of a range may have begun in the one before
                    conv, started = key, True
                gone = blank or copy > 0 or not first
                roles.append(role)
                texts.append(None if gone else text)
                faults.append("x" if gone else "t" if cut else "-")
                size += 0 if gone else len(text)
    if roles:
        held.append((conv, pid, seq, True, roles, texts, "".join(faults)))
    if held:
        yield batch()


def conversation_blocks(rows: DataFrame) -> DataFrame:
    """``faulty_rows`` in order, as blocks in the shared folder; (pid, seq) is their order."""
    order = ["conv_id", "turn", "role", "text"]
    ranges = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    ordered = rows.repartitionByRange(*ranges).sortWithinPartitions(*order)
    return staged(ordered.mapInArrow(_blocks, BLOCK_LAYOUT), "conversation-blocks")


def _digest(rows: Iterator[tuple[str, str]], digest, begun: bool) -> bool:
    for role, text in rows:
        digest.update((("\n" if begun else "") + role + ":" + text).encode())
        begun = True
    return begun


def _initials(roles: list[str]) -> list[str]:
    return [r[:1] for r in roles]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        rows = []
        for conv, roles, texts, faults in zip(*(part.column(c).to_pylist() for c in ("conv_id", "roles", "texts", "faults"))):
            initials = _initials(roles)
            cost, audit = best_edits(initials, faults)
            digest = hashlib.sha256()
            _digest(apply_edits(roles, texts, NOTHING, audit), digest, False)
            rows.append((conv, illegal_pairs(initials), cost, audit, digest.hexdigest()))
        yield _repairs(rows)


def _repairs(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)],
                                      names=[c.split()[0] for c in REPAIR_LAYOUT.split(", ")])


TRANSFER_LAYOUT = ("conv_id long, pid long, seq long, head string, tail string, illegal long, "
                   "befores array<int>, afters array<int>, costs array<long>, audits array<string>")


def _transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                                                    pa.list_(pa.int64()), pa.list_(pa.string())]
    for part in batches:
        for conv, pid, seq, roles, faults in zip(*(part.column(c).to_pylist() for c in ("conv_id", "pid", "seq", "roles", "faults"))):
            initials = _initials(roles)
            row = [conv, pid, seq, initials[0], initials[-1], illegal_pairs(initials), *map(list, zip(*transfers(initials, faults)))]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)],
                                             names=[c.split()[0] for c in TRANSFER_LAYOUT.split(", ")])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pid", "seq"])
    blocks = [list(zip(*row)) for row in zip(pdf["befores"], pdf["afters"], pdf["costs"], pdf["audits"])]
    cost, chosen = chain([[(int(b), int(a), int(c), audit) for b, a, c, audit in pairs] for pairs in blocks])
    borders = illegal = 0
    for tail, head in zip(pdf["tail"].iloc[:-1], pdf["head"].iloc[1:]):
        borders += tail + head not in ("su", "ua", "au")
    illegal = int(pdf["illegal"].sum()) + borders
    n = len(pdf)
    return pd.DataFrame({"pid": pdf["pid"].to_numpy(), "seq": pdf["seq"].to_numpy(), "state": [s for s, _ in chosen],
                         "audit": [a for _, a in chosen], "cost": [cost] * n, "illegal": [illegal] * n})


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole conversations in order: their audits joined, their rows digested."""
    key, digest, begun, audits, last = None, None, False, [], (0, 0)
    for part in batches:
        names = ("conv_id", "roles", "texts", "state", "audit", "cost", "illegal")
        for conv, roles, texts, state, audit, cost, illegal in zip(*(part.column(c).to_pylist() for c in names)):
            if digest is None or conv != key:
                if digest is not None:
                    yield _repairs([(key, last[0], last[1], "".join(audits), digest.hexdigest())])
                key, digest, begun, audits = conv, hashlib.sha256(), False, []
            begun = _digest(apply_edits(roles, texts, state, audit), digest, begun)
            audits.append(audit)
            last = (illegal, cost)
    if digest is not None:
        yield _repairs([(key, last[0], last[1], "".join(audits), digest.hexdigest())])


def chosen_edits(blocks: DataFrame) -> DataFrame:
    """The open blocks with the state each begins in, its audit, and its conversation's cost and illegal pairs."""
    reach = blocks.where("open").select("conv_id", "pid", "seq", "roles", "faults").mapInArrow(_transfer, TRANSFER_LAYOUT)
    plan = reach.groupBy("conv_id").applyInPandas(_chain, "pid long, seq long, state int, audit string, cost long, illegal long")
    return blocks.where("open").join(staged(plan, "conversation-plan"), ["pid", "seq"])


def repair(blocks: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, repaired_sha256) of every conversation in ``blocks``."""
    within = blocks.where("not open").select("conv_id", "roles", "texts", "faults").mapInArrow(_solve, REPAIR_LAYOUT)
    across = chosen_edits(blocks).repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq") \
        .mapInArrow(_digest_blocks, REPAIR_LAYOUT)
    return within.unionByName(across)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        names = ("conv_id", "pid", "seq", "roles", "texts", "state", "audit")
        for conv, pid, seq, roles, texts, state, audit in zip(*(part.column(c).to_pylist() for c in names)):
            rows = list(apply_edits(roles, texts, state, audit))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(rows), pa.int64()) for x in (conv, pid, seq)] +
                [pa.array(range(len(rows)), pa.int64()), pa.array([r for r, _ in rows], pa.string()),
                 pa.array([t for _, t in rows], pa.string())], names=["conv_id", "pid", "seq", "place", "role", "text"])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        audits = [best_edits(_initials(roles), faults)[1]
                  for roles, faults in zip(part.column("roles").to_pylist(), part.column("faults").to_pylist())]
        columns = [part.column(c) for c in ("conv_id", "pid", "seq", "roles", "texts")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([NOTHING] * len(audits), pa.int32()), pa.array(audits, pa.string())],
                                         names=["conv_id", "pid", "seq", "roles", "texts", "state", "audit"])


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, pid, seq, place, role, text), in the order of the middle three."""
    ship_package(conversations.sparkSession)
    blocks = conversation_blocks(faulty_rows(conversations))
    within = blocks.where("not open").select("conv_id", "pid", "seq", "roles", "texts", "faults").mapInArrow(
        _audited, "conv_id long, pid long, seq long, roles array<string>, texts array<string>, state int, audit string")
    across = chosen_edits(blocks).select(*within.columns)
    return within.unionByName(across).mapInArrow(_edited, "conv_id long, pid long, seq long, place long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after the damage that their key decides, with the copies of each."""
    key = F.concat(*(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def conversation_repair(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: faults of ``rows`` and their cheapest repair."""
    ship_package(conversations.sparkSession)
    marked = staged(faulty_rows(rows), "conversation-rows")
    solved = repair(conversation_blocks(marked)).withColumnRenamed("conv_id", "solved_id")
    counts = fault_counts(marked).withColumnRenamed("conv_id", "counts_id")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = (every.join(counts, F.col("conv_id").eqNullSafe(F.col("counts_id")), "left")
             .join(solved, F.col("conv_id").eqNullSafe(F.col("solved_id")), "left"))
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in longs),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair(conversations, damaged(conversations))


# ------------------------------------------------------------------------ SQL

def _crc_step(c: str) -> str:
    return f"(CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END)"


def _crc_rounds() -> str:
    steps = ["r0 AS (SELECT range AS i, range AS c FROM range(0::BIGINT, 256::BIGINT))"]
    steps += [f"r{k + 1} AS (SELECT i, {_crc_step('c')} AS c FROM r{k})" for k in range(8)]
    return ",\n".join(steps)


def _then(state: str, letter: str, cost: str, line: str | None) -> str:
    """SQL of a state's (cost, audit, text) after one more edit; null if the state is."""
    text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


def _row(state: str, letter: str, cost: str, line: str, when: str) -> str:
    return f"CASE WHEN NOT gone AND {when} THEN {_then(state, letter, cost, line)} END"


_BEFORE_USER = ("s0", "s1", "s3")
_LEAST_USER = "list_min([s2, " + ", ".join(_then(s, "I", "2", "'user:'") for s in _BEFORE_USER) + "])"
_KEPT_LINE = "role || ':' || text"

# The same dynamic programme in SQL: per conversation and row the least
# (cost, audit) of every state, as structs, which compare by cost, then audit.
OP11_SQL = f"""
WITH RECURSIVE {_crc_rounds()},
crc AS (SELECT list(c ORDER BY i) AS t FROM r8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM keyed, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS c(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM hurt),
seen AS (
  SELECT *, ending = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
rows_ AS (
  SELECT *, blank OR again AS gone, CASE WHEN ending IN ('.', '!', '?') THEN 0 ELSE 1 END AS tr, left(role, 1) AS r FROM seen),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (NOT gone AND tr = 1) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows_ GROUP BY conv_id),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR),
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR), NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) FROM faults
  UNION ALL
  SELECT w.conv_id, w.i,
    {_then('s0', 'D', '3', None)},
    list_min([{_then('s1', 'D', '3', None)}, {_row('s0', 'K', 'tr', _KEPT_LINE, "r = 's'")}]),
    list_min([{_then('s2', 'D', '3', None)},
      {", ".join(_row(s, 'K', 'tr', _KEPT_LINE, "r = 'u'") for s in _BEFORE_USER)},
      {", ".join(_row(s, 'R', '2 + tr', "'user:' || text", "true") for s in _BEFORE_USER)}]),
    list_min([{_then('s3', 'D', '3', None)},
      {_row('s2', 'K', 'tr', _KEPT_LINE, "r = 'a'")}, {_row('s2', 'R', '2 + tr', "'assistant:' || text", "true")}])
  FROM (
    SELECT x.conv_id, x.i + 1 AS i, s0, s1, s2, list_min([s3, {_then('s2', 'I', '2', "'assistant:'")}]) AS s3
    FROM (SELECT conv_id, i, s0, s1, {_LEAST_USER} AS s2, s3 FROM walk) x) w
  JOIN rows_ v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = w.i),
ended AS (
  SELECT w.conv_id, list_min([s0, s3, {_then('s2', 'I', '2', "'assistant:'")}]) AS b
  FROM (SELECT conv_id, i, s0, {_LEAST_USER} AS s2, s3 FROM walk) w
  JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
