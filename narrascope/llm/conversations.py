"""Repair of conversation structure at least cost, by a suffix-shared automaton.

A legal conversation has the role initials `(s?(ua)+)?`. Every row of a conversation gets a symbol from its
role's initial and its first fault: blank (no visible character), duplicate (role and text seen earlier), truncated (its
last visible character is none of `.!?`). Keeping a row costs nothing, giving it the role user or assistant 2, deleting
it 3 (blank and duplicate rows must go), inserting an empty row 2; a truncated row that stays adds 1. Of the
cheapest repairs the one whose letters (D, I, K, R) are least is taken.

Symbols are strung to signatures of at most `block` rows. Different signatures, sorted from their
ends, share their suffixes: each suffix is one node of an automaton, and for each node and each of the four
grammar states the cheapest repair of the suffix is computed once for all conversations. The next
role is fixed by the state, so the letters alone say what the repaired rows are.

A long conversation is cut into blocks. One pass from its end gives the costs behind every block, which
belong to the node (they start the automaton's suffixes), one pass from its start gives the state in which
every block is entered. Symbols are made from narrow rows (128-bit hashes of role and text); texts are moved
once, into the order of their conversation, where a task goes through them row by row. Rows are
cut into blocks along a range partitioning, so a long conversation's symbols spread over tasks; only its
repaired rows, which its digest needs in order, pass through one task, which holds one batch of them at a time.

Defined cases: null roles and texts are one space; rows of one turn follow by role, then by the hash
of role and text; a null conversation id is a conversation of its own; roles of other initials (or none) must be
changed or deleted; a conversation without rows has no edits; gaps beyond 64 bits count as the largest number;
columns of other names are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from narrascope.llm.common import written
from narrascope.operators.skew import lookup_join

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
BLOCK = 256  # rows of a signature
SENT = 4096  # rows that a task sends on at once
MOST = (1 << 63) - 1

# grammar states: before the first row, after a system, user and assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
# by state: the role that may follow besides an opening system row, and the state then
FOLLOWS = ("user", "user", "assistant", "user")
STATE_OF = {"user": USER, "assistant": ASSISTANT}
INITIALS = "sua"  # any other initial is the fourth class
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
LAST = "end"  # what follows the last block of a conversation
# cost, letters, state behind, own cost
Repair = tuple[int, str, int, int]
PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
PLAN_NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def symbol(initial: int, fault: int) -> str:
    return chr(65 + 4 * fault + initial)


def parts(letter: str) -> tuple[int, int]:
    """Fault and class of the role's initial of a symbol."""
    return divmod(ord(letter) - 65, 4)


def root(behind: str) -> tuple[Repair, ...]:
    """The empty suffix: nothing to do before another block; behind the last row, open turns are closed."""
    if behind != LAST:
        return tuple((int(cost), "", state, 0) for state, cost in enumerate(behind.split(",")))
    return (0, "", START, 0), (4, "II", ASSISTANT, 4), (2, "I", ASSISTANT, 2), (0, "", ASSISTANT, 0)


def extend(node: tuple[Repair, ...], letter: str) -> tuple[Repair, ...]:
    """The node of the suffix with one more row in front: the cheapest repair from every state."""
    fault, initial = parts(letter)

    def put(edit: str, cost: int, after: Repair) -> Repair:
        return cost + after[0], edit + after[1], after[2], cost + after[3]

    best = []
    for state in range(4):
        ways = [put("D", 3, node[state])]
        if fault in (SOUND, TRUNCATED):
            stays = int(fault == TRUNCATED)
            target = STATE_OF[FOLLOWS[state]]
            ways.append(put("R", 2 + stays, node[target]))
            if initial == 0 and state == START:
                ways.append(put("K", stays, node[SYSTEM]))
            elif initial and initial == target - 1:
                ways.append(put("K", stays, node[target]))
        best.append(min(ways))
    for _ in range(3):  # inserted rows in front; more than two in a row never help
        best = [min(own, put("I", 2, best[STATE_OF[FOLLOWS[state]]])) for state, own in enumerate(best)]
    return tuple(best)


def costs_before(signature: str, behind: str) -> str:
    """Costs from every state in front of a block, less the smallest, as a node's root takes them."""
    node = root(behind)
    for letter in reversed(signature):
        node = extend(node, letter)
    least = min(repair[0] for repair in node)
    return ",".join(str(repair[0] - least) for repair in node)


def nodes(signatures: DataFrame) -> DataFrame:
    """(behind, signature, repairs from the four states) of different signatures.

    Sorted by their ends, signatures that share a suffix follow each other; the nodes of the suffix at hand are
    kept, so each is computed once in a task.
    """
    parts_wanted = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (signatures.withColumn("turned", F.reverse("signature")).repartitionByRange(parts_wanted, "behind", "turned")
               .sortWithinPartitions("behind", "turned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind, turned, path = None, "", []
        for batch in batches:
            found = []
            for root_costs, own in zip(batch.column("behind").to_pylist(), batch.column("turned").to_pylist()):
                if root_costs != behind:
                    behind, turned, path = root_costs, "", [root(root_costs)]
                shared = 0
                for a, b in zip(turned, own):
                    if a != b:
                        break
                    shared += 1
                del path[shared + 1:]
                for letter in own[shared:]:
                    path.append(extend(path[-1], letter))
                turned = own
                found.append([list(column) for column in zip(*path[-1])])
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("behind"), batch.column("signature"),
                     *[pa.array([f[i] for f in found], kind) for i, kind in
                       ((1, pa.list_(pa.string())), (2, pa.list_(pa.int32())), (3, pa.list_(pa.int64())))]],
                    ["behind", "signature", "letters", "states", "costs"])

    return ordered.mapInArrow(run, "behind string, signature string, letters array<string>, states array<int>, costs array<bigint>")


def plain_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, copies) of the rows as they are."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                       known(role_col).alias("role"), known(text_col).alias("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """Plain rows after a damage that follows from crc32(`conv:turn`): dropped, emptied, without its ends, repeated, made the user's."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    return rows.filter(kind != 0).select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"))


def _order() -> list[Column]:
    return [F.col("conv"), F.col("turn"), F.col("role"), F.col("a"), F.col("b")]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "role", "text")})


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, a, b, first symbol, symbol of the repeats, times) of different rows of a conversation."""
    seen = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = _hashed(rows).select("conv", "turn", "role", "a", "b", kind.alias("kind"), (seen == "").alias("blank"),
                                  (~F.right(seen, F.lit(1)).isin(*ENDS)).alias("cut"), "copies")
    # equal rows of a turn follow each other, so they are one row with a number
    once = written(narrow.groupBy("conv", "turn", "role", "a", "b", "kind", "blank", "cut").agg(
        F.sum("copies").alias("times")), "turns")
    key = F.struct("conv", "role", "a", "b").alias("key")  # null ids are equal inside
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = once.groupBy("conv", "role", "a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter(
        "first <> last").select(key, F.col("first.turn").alias("first_turn"), F.lit(True).alias("again"))
    joined = lookup_join(once.withColumn("key", key), written(again, "repeated"), ["key"], F.col("turn"))
    later = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    letter = lambda fault: F.chr(F.lit(65) + 4 * fault + F.col("kind"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    return joined.select("conv", "turn", "role", "a", "b", letter(fault).alias("symbol"),
                         letter(F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)).alias("repeat"), "times")


def _blocks(symbols: DataFrame, block: int) -> DataFrame:
    """(conv, part, no, signature, first and last known turn, different known turns) of runs of at most `block` rows."""
    kind = symbols.schema["conv"].dataType.simpleString()
    parts_wanted = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = symbols.repartitionByRange(parts_wanted, *_order()).sortWithinPartitions(*_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        conv, started, letters, turns = None, False, [], []
        kind_of_id, done = None, []

        def close() -> None:
            nonlocal letters, turns, no
            if letters:
                known = [t for t in turns if t is not None]
                different = sum(a != b for a, b in pairwise(known)) + bool(known)
                done.append((conv, part, no, "".join(letters), known[0] if known else None, known[-1] if known else None, different))
                letters, turns, no = [], [], no + 1

        def sent() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            types = [kind_of_id, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              ["conv", "part", "no", "signature", "first_turn", "last_turn", "turns"])

        for batch in batches:
            kind_of_id = batch.schema.field("conv").type
            for own, turn, letter, repeat, times in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "symbol", "repeat", "times"))):
                if own != conv or not started:
                    close()
                    conv, started = own, True
                turns.append(turn)
                while times:
                    room = min(times, block - len(letters))
                    letters.extend(letter if room == 1 else letter + repeat * (room - 1))
                    letter, times = repeat, times - room
                    if len(letters) >= block:
                        close()
                        turns = [turn] if times else []
                    if len(done) >= SENT:
                        yield sent()
        close()
        if done:
            yield sent()

    return ordered.mapInArrow(run, f"conv {kind}, part int, no bigint, signature string, first_turn bigint, last_turn bigint, turns bigint")


def _behind(blocks: DataFrame) -> DataFrame:
    """The blocks with the costs behind them; conversations of several blocks are gone through from their ends."""
    key = F.struct("conv").alias("key")
    several = written(blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit(True).alias("long")), "long")
    if several.isEmpty():
        return blocks.withColumn("behind", F.lit(LAST))
    marked = lookup_join(blocks.withColumn("key", key), several, ["key"], F.col("no")).drop("key")
    ordered = (marked.filter("long").drop("long").repartition("conv")
               .sortWithinPartitions("conv", F.desc("part"), F.desc("no")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, behind = None, False, LAST
        for batch in batches:
            found = []
            for own, signature in zip(batch.column("conv").to_pylist(), batch.column("signature").to_pylist()):
                if own != conv or not started:
                    conv, started, behind = own, True, LAST
                found.append(behind)
                behind = costs_before(signature, behind)
            yield batch.append_column("behind", pa.array(found, pa.string()))

    whole = marked.filter(F.col("long").isNull()).drop("long").withColumn("behind", F.lit(LAST))
    return whole.unionByName(ordered.mapInArrow(run, StructType([*ordered.schema.fields, StructField("behind", StringType())])))


def plans(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    blocks = written(_blocks(_symbols(rows), block), "blocks")
    placed = written(_behind(blocks), "behind")
    repairs = nodes(placed.select("behind", "signature").distinct())
    joined = placed.join(repairs, ["behind", "signature"])
    ordered = joined.repartition("conv").sortWithinPartitions("conv", "part", "no")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, state = None, False, START
        faults, illegal, cost, letters = [0] * 4, 0, 0, []
        first = last = before = None
        turns = 0
        id_kind, done = None, []

        def close() -> None:
            if started:
                gaps = 0 if first is None else min(MOST, last - first + 1 - turns)
                done.append((conv, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, "".join(letters)))

        def sent() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [id_kind, *[pa.int64()] * 6, pa.string()])], ["conv", *PLAN_NAMES])

        names = ("conv", "signature", "letters", "states", "costs", "first_turn", "last_turn", "turns")
        for batch in batches:
            id_kind = batch.schema.field("conv").type
            for own, signature, edits, states, own_costs, low, high, different in zip(*(batch.column(c).to_pylist() for c in names)):
                if own != conv or not started:
                    close()
                    conv, started, state = own, True, START
                    faults, illegal, cost, letters = [0] * 4, 0, 0, []
                    first = last = before = None
                    turns = 0
                    if len(done) >= SENT:
                        yield sent()
                if low is not None:
                    turns += different - (low == last)
                    first, last = low if first is None else first, high
                initials = [] if before is None else [before]
                for letter in signature:
                    fault, initial = parts(letter)
                    faults[fault] += 1
                    initials.append(initial)
                before = initials[-1]
                illegal += sum(pair not in LEGAL_PAIRS for pair in pairwise(initials))
                letters.append(edits[state])
                cost += own_costs[state]
                state = states[state]
        close()
        if done:
            yield sent()

    return ordered.select(*("conv", "signature", "letters", "states", "costs", "first_turn", "last_turn", "turns")).mapInArrow(
        run, f"conv {kind}, {PLAN}")


def repaired_rows(original: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations in order: (conv, place, edit, role, text), and in front of each its plan at place -1.

    Deleted rows are left out; inserted ones have an empty text. A conversation of `original` without rows has a plan only.
    Rows of one conversation follow each other in one task.
    """
    plan = plans(rows, block)
    nothing = {"turn": "bigint", "role": "string", "text": "string", "copies": "int", "a": "bigint", "b": "bigint"}
    empty = [F.lit(0).cast("bigint").alias(n) for n in PLAN_NAMES[:-1]] + [F.lit("").alias("audit")]
    blank = [F.lit(None).cast(t).alias(n) for n, t in nothing.items()]
    every = original.select("conv").distinct().select("conv", F.lit(0).alias("kind"), *blank, *empty)
    planned = plan.select("conv", F.lit(1).alias("kind"), *blank, *PLAN_NAMES)
    texts = _hashed(rows).select("conv", F.lit(2).alias("kind"), *nothing, *[c.cast("string" if i == 6 else "bigint").alias(n) for i, (n, c) in
                                                                            enumerate((n, F.lit(None)) for n in PLAN_NAMES)])
    order = ["conv", "kind", "turn", "role", "a", "b"]
    ordered = every.union(planned).union(texts).repartition("conv").sortWithinPartitions(*order)
    conv_field = rows.schema["conv"]
    schema = StructType([StructField("conv", conv_field.dataType), StructField("place", LongType()), StructField("edit", StringType()),
                         StructField("role", StringType()), StructField("text", StringType()),
                         *[StructField(n, LongType()) for n in PLAN_NAMES[:-1]], StructField("audit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, waiting = None, False, None
        audit, at, place, state = "", 0, 0, START
        id_kind, done = None, []
        none = (None,) * len(PLAN_NAMES)

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            done.append((conv, place, edit, role, text, *none))
            place += 1
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], state)

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", FOLLOWS[state], "")
                at += 1

        def begin() -> None:
            """Send the plan on once it is known, and the rows inserted first."""
            nonlocal waiting, audit
            if waiting is not None:
                done.append((conv, -1, None, None, None, *waiting))
                audit, waiting = waiting[-1], None

        def sent() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            kinds = [id_kind, pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)

        for batch in batches:
            id_kind = batch.schema.field("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "copies", *PLAN_NAMES)]
            for own, kind, role, text, copies, *plan_of in zip(*columns):
                if own != conv or not started:
                    begin()
                    inserted()
                    conv, started, audit, at, place, state = own, True, "", 0, 0, START
                if kind < 2:
                    waiting = tuple(plan_of)
                    continue
                begin()
                for _ in range(copies):
                    inserted()
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        put(edit, role, text)
                    elif edit == "R":
                        put(edit, FOLLOWS[state], text)
                    if len(done) >= SENT:
                        yield sent()
        begin()
        inserted()
        if done:
            yield sent()

    return ordered.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, plan, repaired_sha256) of every conversation, from repaired rows as they follow each other in a task."""
    kind = repaired.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, digest, done, id_kind = None, None, [], None

        def sent() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [id_kind, *[pa.int64()] * 6, pa.string(), pa.string()])],
                ["conv", *PLAN_NAMES, "repaired_sha256"])

        for batch in batches:
            id_kind = batch.schema.field("conv").type
            for conv, place, role, text, *plan_of in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text", *PLAN_NAMES))):
                if place < 0:
                    if plan is not None:
                        done.append((*plan, digest.hexdigest()))
                        if len(done) >= SENT:
                            yield sent()
                    plan, digest = (conv, *plan_of), hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if plan is not None:
            done.append((*plan, digest.hexdigest()))
        if done:
            yield sent()

    return repaired.mapInArrow(run, f"conv {kind}, {PLAN}, repaired_sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           damage: bool = False, block: int = BLOCK) -> DataFrame:
    """The repaired rows of a table of conversations (see `repaired_rows`), after the test damage if asked for."""
    plain = plain_rows(rows, conv_col, turn_col, role_col, text_col)
    return repaired_rows(plain, damaged(plain) if damage else plain, block)
