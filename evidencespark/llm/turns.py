"""Conversation structure repair by Wagner-Fischer target alignment.

A repaired conversation has the role initials (s?(ua)+)?. Its turns are aligned to each feasible length of the alternating string, with
edit costs KEEP, REROLE, DELETE and INSERT; a length is feasible, and a cell of its table lies in the Ukkonen band, if the deletions and
insertions that it cannot do without cost no more than the incumbent. Alignments of the least cost are traced back with the ASCII-least
edits first, and the least audit over all lengths wins.

Conversations of at most WHOLE turns are aligned whole, in the task that holds them. Longer ones are dealt over tasks by range and aligned
in blocks of BLOCK turns: a block is aligned from each state of the grammar (START, S: after s, U: after a pair, A: after u), a scan from the
last block to the first adds the costs of what follows, the blocks are aligned again with these, and a scan from the first block on
picks each block's audit. A block before the last doesn't end in an insertion, which the next one makes; so no audit of a block is a prefix
of another, and the least of each block are the least of the whole. The scans read a row a block, the last one the texts, in one stream and a
bounded memory: one SHA-256 of a conversation has to read it in order.

Defined results: a null conv_id is a conversation of its own; a null turn comes first and counts neither in gaps nor in the turn numbers;
a null role or text is one space; rows of one turn are taken by role and text (after damage); repeated rows are duplicates; an empty role
has no initial; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_text, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHOLE, BLOCK = 256, 64
INF = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
START, S, U, A = 0, 1, 2, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: What may follow in each state: the first characters, then the alternating string goes on.
FAMILIES = {START: ("", "s"), S: ("",), U: ("",), A: ("a",)}
#: initial of the role, must be deleted, truncated
Turn = tuple[str, bool, bool]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def align(turns: list[Turn], target: str, limit: int, trailing: bool = True) -> tuple[int, str] | None:
    """Least cost and ASCII-least audit of turns onto target, or None if it costs over limit. Without trailing, the last edit is one of a turn."""
    n, m = len(turns), len(target)
    surplus = n - m
    least = DELETE * surplus if surplus > 0 else -INSERT * surplus
    if least > limit:
        return None
    reach = (limit - least) // (DELETE + INSERT)
    most_over, most_under = max(0, surplus) + reach, min(0, surplus) - reach  # the band of i - j
    table = [[INF] * (m + 2) for _ in range(n + 2)]
    table[n][m] = 0
    for i in range(n, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(min(m, i - most_under), max(0, i - most_over) - 1, -1):
            best = row[j]
            if j < m and target[j] != "s" and (trailing or i < n):
                best = min(best, INSERT + row[j + 1])
            if i < n:
                best = min(best, DELETE + below[j])
                if j < m and not turns[i][1] and below[j + 1] < INF:
                    if turns[i][0] == target[j]:
                        best = min(best, KEEP + TRUNCATED * turns[i][2] + below[j + 1])
                    elif target[j] != "s":
                        best = min(best, REROLE + TRUNCATED * turns[i][2] + below[j + 1])
            row[j] = best
    if table[0][0] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        now = table[i][j]
        if i < n and DELETE + table[i + 1][j] == now:
            edit, i = "D", i + 1
        elif j < m and target[j] != "s" and (trailing or i < n) and INSERT + table[i][j + 1] == now:
            edit, j = "I", j + 1
        else:
            edit, i, j = "K" if turns[i][0] == target[j] else "R", i + 1, j + 1
        audit.append(edit)
    return table[0][0], "".join(audit)


def _bound(turns: list[Turn], state: int, ends: tuple[int, ...], trailing: bool) -> int:
    """The cost of some repair: the first incumbent. INF if no end can be reached."""
    found = DELETE * len(turns) + ends[state]
    if state == START:
        kept = [TRUNCATED * cut for initial, must, cut in turns if initial == "s" and not must]
        found = min(found, DELETE * (len(turns) - 1) + min(kept, default=INF) + ends[S])
    cost = 0
    for initial, must, cut in turns:
        if must or cut:
            cost += DELETE
        elif state == START and initial == "s":
            state = S
        else:
            wanted = "a" if state == A else "u"
            cost += REROLE * (initial != wanted)
            state = U if state == A else A
    found = min(found, cost + ends[state])
    for _ in range(2):  # one more turn changes the state; before the last one, it may change that one's edit
        state, cost = (U if state == A else A), cost + INSERT + (not trailing) * REROLE
        found = min(found, cost + ends[state])
    return min(found, INF)


def repair(turns: list[Turn], state: int = START, ends: tuple[int, ...] = (0, INF, 0, INF), trailing: bool = True) -> tuple[int, str, int] | None:
    """Least cost, ASCII-least audit and the state reached; ends: the cost of what follows in each state."""
    limit, best = _bound(turns, state, ends, trailing), None
    if limit >= INF:
        return None
    live = sum(not must for _, must, _ in turns)
    longest = len(turns) + (limit - min(ends)) // INSERT + 1
    options = []
    for first in FAMILIES[state]:
        whole = first + "ua" * (longest // 2 + 2)
        for m in range(1 if first == "s" else 0, longest + 1):
            end = state if m == 0 else {"s": S, "u": A, "a": U}[whole[m - 1]]
            if ends[end] < INF:
                options.append((abs(m - live), whole[:m], end))
    for _, target, end in sorted(options, key=lambda x: x[0]):
        found = align(turns, target, limit - ends[end], trailing)
        if found is not None:
            cost, audit = found[0] + ends[end], found[1]
            if best is None or (cost, audit) < best[:2]:
                best, limit = (cost, audit, end), cost
    return best


class Digest:
    """What is told of a conversation, from its turns in order and their edits."""

    def __init__(self) -> None:
        self.low = self.high = self.last_turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_initial: str | None = None
        self.sha, self.first, self.needed = hashlib.sha256(), True, "u"

    def see(self, turn: int | None, initial: str, blank: bool, duplicate: bool, cut: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        self.illegal += self.last_initial is not None and self.last_initial + initial not in LEGAL
        self.last_initial = initial

    def _add(self, role: str, text: str) -> None:
        self.sha.update((f"{role}:{text}" if self.first else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self) -> None:
        self._add(ROLES[self.needed], "")
        self.needed = "a" if self.needed == "u" else "u"

    def turn(self, edit: str, role: str, text: str) -> None:
        if edit == "D":
            return
        self._add(role if edit == "K" else ROLES[self.needed], text)
        if not (edit == "K" and role[:1] == "s"):
            self.needed = "a" if self.needed == "u" else "u"

    def row(self, cost: int, audit: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.sha.hexdigest()


def repaired(rows: Iterable[tuple[int | None, str, str]]) -> tuple:
    """RESULT of a whole conversation of (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    digest, turns, texts = Digest(), [], []
    for turn, role, text in rows:
        kept = text.rstrip(SPACES)
        blank = not kept
        duplicate = not blank and (role, text) in seen
        cut = not blank and not duplicate and kept[-1] not in ".!?"
        seen.add((role, text))
        digest.see(turn, role[:1], blank, duplicate, cut)
        turns.append((role[:1], blank or duplicate, cut))
        texts.append((role, text))
    cost, audit, _ = repair(turns)
    at = 0
    for edit in audit:
        if edit == "I":
            digest.insert()
        else:
            digest.turn(edit, *texts[at])
            at += 1
    return digest.row(cost, audit)


def damaged(conversations: DataFrame, faults: bool = True) -> DataFrame:
    """conv, turn, role, text without nulls in role and text, copies: 0 for a dropped row, 2 for one repeated. Without faults, rows as they are."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))), F.lit(20)) if faults else F.lit(99)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(named("role")).alias("role"),
        text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _out(conv_type: pa.DataType, convs: list, rows: list[tuple]) -> pa.RecordBatch:
    longs, strings = list(zip(*[r[:6] for r in rows])), list(zip(*[r[6:] for r in rows]))
    columns = [pa.array(convs, conv_type), *[pa.array(x, pa.int64()) for x in longs], *[pa.array(x, pa.string()) for x in strings]]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place: one result for each conversation."""
    now, held, kind = (), [], None
    convs, results = [], []
    for batch in batches:
        kind = batch["conv"].type
        for conv, turn, role, text, copies in zip(batch["conv"].to_pylist(), batch["turn"].to_pylist(), batch["role"].to_pylist(), each_text(batch["text"]), batch["copies"].to_pylist()):
            if (conv,) != now:
                if now:
                    convs.append(now[0])
                    results.append(repaired(held))
                now, held = (conv,), []
            held += [(turn, role, text)] * copies
        if len(convs) >= 1024:
            yield _out(kind, convs, results)
            convs, results = [], []
    if now:
        convs.append(now[0])
        results.append(repaired(held))
    if convs:
        yield _out(kind, convs, results)


def _block_turns(turns: list[dict]) -> list[Turn]:
    return [(x["initial"], x["must"], x["cut"]) for x in turns]


def _block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's least cost from each state to each state; -1 where there is no way."""
    for batch in batches:
        costs = []
        for turns, last in zip(batch["turns"].to_pylist(), batch["last"].to_pylist()):
            rows, own = _block_turns(turns), []
            for state in range(4):
                for end in range(4):
                    found = repair(rows, state, tuple(0 if e == end else INF for e in range(4)), last)
                    own.append(-1 if found is None else found[0])
            costs.append(own)
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["block"], pa.array(costs, pa.list_(pa.int64()))], ["conv", "block", "costs"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first: the cost of what follows each, by state."""
    now, ends = (), ()
    for batch in batches:
        out = []
        for conv, costs in zip(batch["conv"].to_pylist(), batch["costs"].to_pylist()):
            if (conv,) != now:
                now, ends = (conv,), (0, INF, 0, INF)
            out.append([min(e, INF) for e in ends])
            ends = tuple(min(min((c + ends[e] for e, c in enumerate(costs[4 * s : 4 * s + 4]) if c >= 0), default=INF), INF) for s in range(4))
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["block"], pa.array(out, pa.list_(pa.int64()))], ["conv", "block", "ends"])


def _block_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's audit and the state reached from each state, given what follows."""
    for batch in batches:
        audits, states, costs = [], [], []
        for turns, last, ends in zip(batch["turns"].to_pylist(), batch["last"].to_pylist(), batch["ends"].to_pylist()):
            rows = _block_turns(turns)
            found = [repair(rows, state, tuple(ends), last) or (INF, "", state) for state in range(4)]
            costs.append([x[0] for x in found])
            audits.append([x[1] for x in found])
            states.append([x[2] for x in found])
        columns = [batch["conv"], batch["block"], pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64())), pa.array(costs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "block", "audits", "states", "costs"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each before its turns, in order: one result for each conversation. Holds the conversation's audit and no more of its texts than a batch."""
    now, state, cost, parts, digest, left, kind = (), START, None, [], Digest(), iter(()), None

    def rest() -> None:
        for edit in left:  # insertions after a block's last turn
            digest.insert() if edit == "I" else None

    for batch in batches:
        kind = batch["conv"].type
        columns = [batch[c].to_pylist() for c in ("conv", "audits", "states", "costs", "turn", "role", "fault")]
        for conv, audits, states, costs, turn, role, fault, text in zip(*columns, each_text(batch["text"])):
            if (conv,) != now:
                if now:
                    rest()
                    yield _out(kind, [now[0]], [digest.row(cost, "".join(parts))])
                now, state, cost, parts, digest, left = (conv,), START, None, [], Digest(), iter(())
            if audits is not None:
                rest()
                cost = costs[state] if cost is None else cost
                parts.append(audits[state])
                left, state = iter(audits[state]), states[state]
                continue
            digest.see(turn, role[:1], fault == 1, fault == 2, fault == 3)
            for edit in left:
                if edit != "I":
                    digest.turn(edit, role, text)
                    break
                digest.insert()
    if now:
        rest()
        yield _out(kind, [now[0]], [digest.row(cost, "".join(parts))])


def _long(rows: DataFrame, conv_type: str) -> DataFrame:
    """Results of conversations of more turns than one task should hold."""
    spark = rows.sparkSession
    each = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The row's number in its input lets rows that are all equal be dealt to several tasks.
    dealt = each.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, "conv", "turn", "role", F.substring("text", 1, 64), "n")
    kept = F.rtrim(F.translate("text", SPACES, " " * 6))
    placed = dealt.sortWithinPartitions("conv", "turn", "role", "text").select(
        "conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("same"),
        (kept == "").alias("blank"), (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    placed = stored(placed.withColumn("block", F.shiftright("place", 6)), "turns-placed")  # BLOCK is 2 ** 6
    light = placed.select("conv", "block", "place", F.substring("role", 1, 1).alias("initial"), "same", "blank", "open")
    firsts = light.where("not blank").groupBy("conv", "same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = light.alias("l").join(firsts.alias("f"), F.col("l.conv").eqNullSafe(F.col("f.conv")) & (F.col("l.same") == F.col("f.same")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(duplicate, 2).when(F.col("open"), 3).otherwise(0)
    marked = stored(marked.select("l.conv", "block", "place", "initial", fault.alias("fault")), "turns-marked")
    one = F.struct("place", "initial", F.col("fault").isin(1, 2).alias("must"), (F.col("fault") == 3).alias("cut"))
    blocks = marked.groupBy("conv", "block").agg(F.sort_array(F.collect_list(one)).alias("turns"))  # at most BLOCK turns
    ends = marked.groupBy("conv").agg(F.max("block").alias("final"))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    blocks = blocks.alias("b").join(ends.alias("e"), same("b", "e")).select("b.conv", "block", "turns", (F.col("block") == F.col("final")).alias("last"))
    blocks = stored(blocks, "turns-blocks")
    costs = blocks.repartition(parts, "conv", "block").mapInArrow(_block_costs, f"conv {conv_type}, block long, costs array<long>")
    suffixes = costs.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(_suffixes, f"conv {conv_type}, block long, ends array<long>")
    ended = blocks.alias("b").join(suffixes.alias("s"), same("b", "s") & (F.col("b.block") == F.col("s.block"))).select("b.conv", "b.block", "turns", "last", "ends")
    audits = ended.mapInArrow(_block_audits, f"conv {conv_type}, block long, audits array<string>, states array<long>, costs array<long>")
    none = F.lit(None)
    told = audits.select("conv", "block", F.lit(-1).cast("long").alias("place"), "audits", "states", "costs", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("int").alias("fault"))
    turns = placed.join(marked.select("place", "fault"), "place").select(
        "conv", "block", "place", none.cast("array<string>").alias("audits"), none.cast("array<long>").alias("states"), none.cast("array<long>").alias("costs"), "turn", "role", "text", "fault"
    )
    ordered = told.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "block", "place")
    return ordered.mapInArrow(_told, f"conv_id {conv_type}, {RESULT}")


def repair_conversations(conversations: DataFrame, faults: bool = False, whole: int = WHOLE) -> DataFrame:
    """conv_id, counts of faults, cost, audit, repaired_sha256: one row for each conv_id. With faults, rows are damaged first by a fixed rule."""
    conv_type = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations, faults)
    counts = rows.groupBy("conv").agg(F.sum("copies").alias("turns"))
    long = stored(counts.where(F.col("turns") > whole).select("conv"), "turns-long")
    schema = f"conv_id {conv_type}, {RESULT}"

    def found(how: str) -> DataFrame:
        return rows.alias("r").join(long.alias("l"), F.col("r.conv").eqNullSafe(F.col("l.conv")), how)

    if long.isEmpty():
        short = rows
    else:
        short = found("left_anti")
    done = short.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(_whole, schema)
    return done if short is rows else done.unionByName(_long(found("left_semi"), conv_type))
