"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, by Hirschberg's method.

The roles' first letters are read by an automaton of four states: nothing yet, after s, after u, after a. A row is kept
(K, 0), gets the other role (R, 1) or is deleted (D, 2; the only way for blank rows and repeated ones); rows can be
inserted anywhere (I, 5). A truncated row that stays costs 5 more. Of the cheapest ways that with the ASCII-least string
of edits is taken. Inserts belong to the row that follows, so two different ways to the rows read so far never are one
the beginning of the other: which is least is known from its state before a row and what is added there, and a vector
of four costs with four ranks stands for all ways so far. A backward vector of four costs stands for the rest. In the
middle the cheapest crossing of least rank is taken, and both halves are solved alike: memory is linear in the rows.

Rows are sorted across the cluster by conversation and turn, so that a long conversation lies in many partitions, and
cut into blocks of at most 2**BLOCK_BITS rows. Blocks of one conversation are summed up as 4 x 4 costs and ranks; the
same method finds the states between them, then each block is solved by itself. Only the last pass, which hashes a
conversation's repaired text, reads its rows as one stream, since a SHA-256 has to; it holds one row at a time and the
string of edits.

Faults, the first counts: `blank` (only white space), `duplicate` (role and text were seen earlier in the conversation),
`truncated` (the last letter is none of .!?). Null roles and texts are one blank; a null conversation is one of its own;
null turns come first. Rows of one turn are ordered by role and by the SHA-256 of the text. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import materialize

BLOCK_BITS, SPACE = 12, r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
#: (state, letter or role's letter read there): the state after it. States: 0 nothing, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What is inserted in a state so that the conversation may end there.
ENDING = {0: "", 1: "II", 2: "I", 3: ""}
END_COSTS = tuple(INSERT * len(ENDING[q]) for q in range(4))


def _ways(letter: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of the ways to read a row; of each two states the best."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    more = TRUNCATED if fault == "truncated" else 0
    for p in range(4):
        q, inserted = p, 0
        for inserted in range(3):
            steps = [("D", q, DELETE)]
            if fault not in ("blank", "duplicate"):
                steps += [("K", NEXT[q, letter], KEEP + more)] if (q, letter) in NEXT else []
                steps += [("R", NEXT[q, x], REROLE + more) for x in "ua" if (q, x) in NEXT]
            for edit, after, cost in steps:
                way = INSERT * inserted + cost, "I" * inserted + edit
                best[p, after] = min(way, best.get((p, after), way))
            q = NEXT[q, "a" if q == 2 else "u"]
    return [(p, q, cost, edits) for (p, q), (cost, edits) in sorted(best.items())]


Item = list[tuple[int, int, int, object]]


class Repair:
    """The vectors over a list of kinds; items[kind] has the ways (before, after, cost, order) of a row or of a block.

    Vectors are kept relative to their least cost, of which there are few, so that each step is looked up.
    """

    def __init__(self, items: dict[object, Item]):
        self.items, self._forward, self._backward = items, {}, {}

    def forward(self, kinds: list, start: int) -> tuple[list[int], list[int]]:
        """Costs and ranks of the best ways from start to each state."""
        base, v = 0, tuple((0, 0) if q == start else (FAR, 0) for q in range(4))
        for kind in kinds:
            known = self._forward.get((v, kind))
            if known is None:
                best: dict[int, tuple] = {}
                for p, q, cost, order in self.items[kind]:
                    if v[p][0] < FAR:
                        way = v[p][0] + cost, v[p][1], order
                        best[q] = min(way, best.get(q, way))
                least = min(way[0] for way in best.values())
                rank = {q: i for i, q in enumerate(sorted(best, key=lambda q: best[q][1:]))}
                known = least, tuple((best[q][0] - least, rank[q]) if q in best else (FAR, 0) for q in range(4))
                self._forward[v, kind] = known
            base, v = base + known[0], known[1]
        return [base + c if c < FAR else FAR for c, _ in v], [r for _, r in v]

    def backward(self, kinds: list, ends: tuple[int, ...]) -> list[int]:
        """The least cost from each state to the end, where a state costs what `ends` has."""
        base, v = 0, tuple(ends)
        for kind in reversed(kinds):
            known = self._backward.get((v, kind))
            if known is None:
                new = [FAR] * 4
                for p, q, cost, _ in self.items[kind]:
                    if v[q] < FAR:
                        new[p] = min(new[p], cost + v[q])
                least = min(new)
                known = self._backward[v, kind] = least, tuple(c - least if c < FAR else FAR for c in new)
            base, v = base + known[0], known[1]
        return [base + c if c < FAR else FAR for c in v]

    def solve(self, kinds: list, start: int, ends: tuple[int, ...]) -> list[int]:
        """The state after each item on the best way."""
        out: list[int] = []
        todo = [(0, len(kinds), start, tuple(ends))]
        while todo:
            low, high, s, e = todo.pop()
            if high - low == 1:
                out.append(min((cost + e[q], order, q) for p, q, cost, order in self.items[kinds[low]] if p == s and e[q] < FAR)[2])
                continue
            middle = (low + high) // 2
            costs, ranks = self.forward(kinds[low:middle], s)
            rest = self.backward(kinds[middle:high], e)
            cross = min((costs[q] + rest[q], ranks[q], q) for q in range(4) if costs[q] < FAR and rest[q] < FAR)[2]
            todo.append((middle, high, cross, e))
            todo.append((low, middle, s, only(cross)))
        return out


def only(state: int) -> tuple[int, ...]:
    """Costs of an end in this state alone; in any, with what has to be inserted, for -1."""
    return END_COSTS if state < 0 else tuple(0 if q == state else FAR for q in range(4))


ROWS = Repair({letter + fault[:1]: _ways(letter, fault) for letter in "sua-" for fault in ("", "blank", "duplicate", "truncated")})


def edits(kinds: list[str], start: int, end: int) -> list[str]:
    """The edits of each row: inserts before it, then its own; after the conversation's last also those at its end."""
    out, s = [], start
    for kind, q in zip(kinds, ROWS.solve(kinds, start, only(end)), strict=True):
        out.append(min((cost, order) for p, to, cost, order in ROWS.items[kind] if (p, to) == (s, q))[1])
        s = q
    if end < 0 and out:
        out[-1] += ENDING[s]
    return out


def sorted_rows(rows: DataFrame) -> DataFrame:
    """conv_id, pos, turn, role, text, letter, fault, kind: rows in order of pos, which is unique, written to the shared
    folder. A range of conversations and turns is a partition; rows of one turn can lie in several."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    keys = ["conv_id", "turn", "role", "digest"]
    own = own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    own = materialize(own, "repair-sorted")
    again = own.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    joined = own.join(again, own["conv_id"].eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    fault = F.when(blank, "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated").otherwise("")
    letter = F.substring("role", 1, 1)
    known = F.when(letter.isin("s", "u", "a"), letter).otherwise("-")
    out = joined.select("conv_id", "pos", "turn", "role", "text", letter.alias("letter"), fault.alias("fault"), F.concat(known, F.substring(fault, 1, 1)).alias("kind"))
    return materialize(out, "repair-rows")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the 4 x 4 costs and ranks."""
    for batch in batches:
        costs, ranks = [], []
        for kinds in batch.column("kinds").to_pylist():
            got = [ROWS.forward(kinds, s) for s in range(4)]
            costs.append([c for cs, _ in got for c in cs])
            ranks.append([r for _, rs in got for r in rs])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "block")), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], ["conv_id", "block", "costs", "ranks"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield from batch.slice(start, 1024).to_pylist()


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each block of a conversation, whose blocks come in order; -1: the end."""
    for _, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        blocks = list(own)
        items = {}
        for i, b in enumerate(blocks):
            items[i] = [(k // 4, k % 4, c, r) for k, (c, r) in enumerate(zip(b["costs"], b["ranks"], strict=True)) if c < FAR]
        after = Repair(items).solve(list(range(len(blocks))), 0, END_COSTS)
        rows = [{"_c": b["conv_id"], "_b": b["block"], "before": p, "after": q} for b, p, q in zip(blocks, [0, *after[:-1]], [*after[:-1], -1], strict=True)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("_c", pa.int64()), ("_b", pa.int64()), ("before", pa.int32()), ("after", pa.int32())]))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in _rows([batch]):
            yield pa.RecordBatch.from_arrays([pa.array(r["at"], pa.int64()), pa.array(edits(r["kinds"], r["before"], r["after"]), pa.string())], ["pos", "edits"])


def planned(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """pos, edits of each of the sorted rows. bits: a block has at most so many rows, as a power of two."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "kind")))
    blocks = rows.groupBy("conv_id", F.shiftright("pos", bits).alias("block")).agg(listed.alias("_l"))
    blocks = materialize(blocks.select("conv_id", "block", F.col("_l.pos").alias("at"), F.col("_l.kind").alias("kinds")), "repair-blocks")
    several = blocks.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("n")).where("n > 1")
    # Conversations of one block need no states; their key joins are null-safe, since null is a conversation too.
    parts = blocks.join(several, blocks["conv_id"].eqNullSafe(F.col("_c"))).select("conv_id", "block", "kinds")
    sums = parts.mapInArrow(_summed, "conv_id long, block long, costs array<long>, ranks array<int>")
    states = sums.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_between, "_c long, _b long, before int, after int")
    both = blocks.join(states, blocks["conv_id"].eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    return both.select("at", "kinds", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after")).mapInArrow(_solved, "pos long, edits string")


def _repaired(rows: Iterator[dict]) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """Each row of a conversation, and the rows (role, text) that its edits leave."""
    state = 0
    for r in rows:
        left = []
        for edit in r["edits"]:
            if edit == "D":
                continue
            role = r["role"] if edit == "K" else "assistant" if state == 2 else "user"
            state = NEXT[state, role[:1]]
            left.append((role, "" if edit == "I" else r["text"]))
        yield r, left


REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for conv_id, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        digest, first, audit, before, turns = hashlib.sha256(), True, [], None, []
        out = dict.fromkeys(REPORT.names, 0) | {"conv_id": conv_id}
        distinct = 0
        for r, left in _repaired(own):
            audit.append(r["edits"])
            if r["fault"]:
                out[r["fault"]] += 1
            stays = r["edits"].strip("I") != "D"
            out["cost"] += sum(_COSTS[e] for e in r["edits"]) + (TRUNCATED if stays and r["fault"] == "truncated" else 0)
            out["illegal"] += before is not None and before + r["letter"] not in ("su", "ua", "au")
            before = r["letter"]
            if r["turn"] is not None and r["turn"] not in turns[1:]:
                distinct += 1
                turns = [turns[0] if turns else r["turn"], r["turn"]]
            for role, text in left:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        out["gaps"] = turns[1] - turns[0] + 1 - distinct if turns else 0
        held.append(out | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
        if len(held) >= 512 or len(audit) > 1 << 16:
            yield pa.RecordBatch.from_pylist(held, REPORT)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, REPORT)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for conv_id, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        held, place = [], 0
        for _, left in _repaired(own):
            for role, text in left:
                held.append({"conv_id": conv_id, "place": place, "role": role, "text": text})
                place += 1
            if len(held) >= 512:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)


def _streamed(rows: DataFrame, bits: int) -> DataFrame:
    """The sorted rows with their edits, each conversation in order in one partition."""
    own = sorted_rows(rows)
    return own.join(planned(own, bits), "pos").repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def report(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in rows
    (conv_id, turn, role, text). gaps: turns missing between the first and the last; illegal: neighbours whose letters
    aren't su, ua or au; audit: the edits in order; the hash is of the repaired `role:text`, joined by line ends."""
    return _streamed(rows, bits).select("conv_id", "turn", "role", "text", "letter", "fault", "edits").mapInArrow(_reported, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, place, role, text: the repaired conversations."""
    return _streamed(rows, bits).select("conv_id", "role", "text", "edits").mapInArrow(_written, "conv_id long, place long, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) damaged by crc32 of `conv_id:turn` modulo 20 (nulls: one blank): 0 is left out, 1
    loses its text, 2 its marks .!?, 3 comes twice, 4 gets the role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("way")
    own = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), way).where("way <> 0")
    text: Column = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def report_damaged(rows: DataFrame) -> DataFrame:
    """The report of the damaged rows, with zeros for conversations of which no row is left."""
    found = report(damaged(rows))
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    both = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in REPORT.names[1:7]]
    return both.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
