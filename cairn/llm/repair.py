"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation is well formed if the initials of its roles spell ``(s?(ua)+)?``. Edits make it so: Keep (0), Rerole
to user or assistant (2), Delete (3; the only edit of blank and repeated rows) and Insert an empty user or
assistant turn (2); a truncated row that stays adds 1. The pattern is an automaton of four states (start, after
system, after user, after assistant), so the cheapest edits are a Viterbi search with four costs a row.

How a conversation of any length is searched without one task holding it:

1. Rows are sorted by range over (conversation, turn, role, text) and cut into chunks of at most ``piece`` rows;
   equal rows are one row with a count, so a row repeated a billion times is one row here.
2. Every chunk starts from a speculative cost vector at its end, that of the conversation's end, and runs back to
   its first row. Vectors are kept less their least cost, as only differences matter.
3. A pass over the chunk results, from the last chunk back, compares what each chunk was started from with what the
   chunk behind it found. A chunk whose vectors differ by more than a constant is run again (fix-up), only until a
   row at which the new vector and the earlier one differ by a constant: from there on the earlier result holds
   but for that constant. Passes go on until no chunk is left. Each chunk keeps what it found from every vector
   it was started from; differences are at most 5, so these are few and passes end even where vectors never
   converge in a chunk (a run of one role).
4. With the backward costs right everywhere, each chunk says in which state it is left for every state it is entered in;
   a pass from the first chunk on picks the true ones. Then every chunk traces its edits: at each row the
   least letter in ASCII order that lies on a cheapest way. A letter fixes the next state, so the letters that
   come out are the least of all cheapest audits.

What cannot be cut is the digest of a repaired text: SHA-256 runs through its input in order, so the rows of a
conversation are streamed through one task at the very end, batch by batch, never held together. The passes
over chunk results (one small row a chunk) stream likewise.

Rows are ordered by turn (null first), then role, the first 64 characters of the text, and a digest of it; rows alike in all
of these are equal. Null conversations are one conversation of their own; null role and text count as one space. A
conversation without rows costs nothing and is empty. Turns are whole numbers; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.jobs import cut

WHITE = " \t\n\x0b\x0c\r"
#: States: start, after system, after user, after assistant. An inserted or re-roled turn can only lead on to one state.
NEXT = (2, 2, 3, 2)
KEEP = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
SAID = {2: "user", 3: "assistant"}
#: The inserts that end a conversation from each state.
ENDS = (0, 4, 2, 0)
FORCED, LATE = 4, 8

Vector = tuple[int, int, int, int]


@dataclass(frozen=True)
class Repair:
    piece: int = 16_384


def normal(costs: list[int] | Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


def _costs(code: int, after: Vector) -> list[int]:
    """Cheapest cost from each state ahead of a row; ``code`` is its initial (s, u, a, other) and FORCED or LATE."""
    late = 1 if code & LATE else 0
    found = []
    for state in range(4):
        best = 3 + after[state]
        if not code & FORCED:
            best = min(best, 2 + late + after[NEXT[state]])
            kept = KEEP[state].get(code & 3)
            if kept is not None:
                best = min(best, late + after[kept])
        found.append(best)
    return [min(found[q], 2 + found[NEXT[q]], 4 + found[NEXT[NEXT[q]]]) for q in range(4)]


@lru_cache(maxsize=None)
def step(code: int, after: Vector) -> tuple[Vector, int]:
    """The vector ahead of a row and its least cost above ``after``; few arguments occur, so it is looked up."""
    return normal(_costs(code, after))


@lru_cache(maxsize=None)
def choose(code: int, after: Vector, state: int) -> tuple[str, int, str, str]:
    """(letters, next state, roles said before the row, role of the row): the least letters on a cheapest way."""
    costs, letters, said = _costs(code, after), "", []
    late = 1 if code & LATE else 0
    while True:
        if 3 + after[state] == costs[state]:
            return letters + "D", state, ",".join(said), ""
        if 2 + costs[NEXT[state]] == costs[state]:
            letters, state = letters + "I", NEXT[state]
            said.append(SAID[state])
            continue
        kept = KEEP[state].get(code & 3)
        if kept is not None and late + after[kept] == costs[state]:
            return letters + "K", kept, ",".join(said), "="
        return letters + "R", NEXT[state], ",".join(said), SAID[NEXT[state]]


def finish(state: int) -> tuple[str, str]:
    """Letters and roles of the inserts at the end."""
    said = []
    while ENDS[state]:
        state = NEXT[state]
        said.append(SAID[state])
    return "I" * len(said), ",".join(said)


def pack(vector: Vector) -> int:
    return sum(v << 8 * k for k, v in enumerate(vector))


def unpack(packed: int) -> Vector:
    return tuple(packed >> 8 * k & 255 for k in range(4))


START = pack(normal(ENDS)[0])


def backward(codes: list[int], end: Vector) -> list[Vector]:
    """The vectors ahead of every row and at the end."""
    found = [end]
    for code in reversed(codes):
        found.append(step(code, found[-1])[0])
    found.reverse()
    return found


def _runs(table: pa.Table) -> Iterator[tuple[str, dict]]:
    """The rows of each conversation in a chunk, in order."""
    columns = table.sort_by("place").to_pydict()
    keys, at = columns["key"], 0
    while at < len(keys):
        end = at
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        yield keys[at], {name: values[at:end] for name, values in columns.items()}
        at = end


SUMMARY = "key string, chunk long, illegal long, first int, last int, started long, found long"


def _speculate(chunk: pa.Table) -> pa.Table:
    rows = []
    for key, run in _runs(chunk):
        codes = run["code"]
        initials = [c & 3 for c in codes]
        # The pairs su, ua and au are legal; equal rows that stand side by side are no such pair.
        illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:])) + sum(run["n"]) - len(codes)
        vector = unpack(START)
        for code in reversed(codes):
            vector = step(code, vector)[0]
        rows.append((key, run["chunk"][0], illegal, initials[0], initials[-1], START, pack(vector)))
    names = ["key", "chunk", "illegal", "first", "last", "started", "found"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


def _fix(chunk: pa.Table, asked: pa.Table) -> pa.Table:
    """The asked conversations of a chunk run from other vectors, each until it meets a vector already known."""
    wanted = {r["key"]: r for r in asked.to_pylist()}
    rows = []
    for key, run in _runs(chunk):
        if key not in wanted:
            continue
        ask = wanted[key]
        old, new = unpack(ask["started"]), unpack(ask["needed"])
        found = None
        for code in reversed(run["code"]):
            old, new = step(code, old)[0], step(code, new)[0]
            if old == new:  # they differ by a constant, and so do all rows ahead
                found = ask["found"]
                break
        rows.append((key, ask["chunk"], ask["needed"], pack(new) if found is None else found))
    return pa.table({
        "key": pa.array([r[0] for r in rows], pa.string()),
        **{n: pa.array([r[k] for r in rows], pa.int64()) for k, n in ((1, "chunk"), (2, "started"), (3, "found"))},
    })


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation from its last one back: the vector each needs, and whether it must be run for it."""
    key, vector = None, START
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["key"] != key:
                key, vector = row["key"], START
            known = {k["started"]: k["found"] for k in row["known"]}
            missing = vector not in known
            first = row["known"][0]
            out.append((key, row["chunk"], vector, missing, first["started"], first["found"]))
            vector = known.get(vector, first["found"])  # a guess where it is missing
        yield pa.record_batch([
            pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()),
            pa.array([r[3] for r in out], pa.bool_()), pa.array([r[4] for r in out], pa.int64()), pa.array([r[5] for r in out], pa.int64()),
        ], names=["key", "chunk", "needed", "missing", "started", "found"])


def _exits(chunk: pa.Table, plan: pa.Table) -> pa.Table:
    """The state in which each planned conversation leaves the chunk, for each state it may be entered in."""
    needed = {r["key"]: unpack(r["needed"]) for r in plan.to_pylist()}
    rows = []
    for key, run in _runs(chunk):
        if key in needed:
            vectors, states = backward(run["code"], needed[key]), [0, 1, 2, 3]
            for k, code in enumerate(run["code"]):
                states = [choose(code, vectors[k + 1], q)[1] for q in states]
            rows.append((key, run["chunk"][0], needed[key], states))
    return pa.table({
        "key": pa.array([r[0] for r in rows], pa.string()), "chunk": pa.array([r[1] for r in rows], pa.int64()),
        "needed": pa.array([pack(r[2]) for r in rows], pa.int64()), "exits": pa.array([r[3] for r in rows], pa.list_(pa.int32())),
    })


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation from its first one on: the state each is entered in, and which one is the last."""
    key, state = None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["key"] != key:
                key, state = row["key"], 0
            out.append((key, row["chunk"], row["needed"], state, row["last_chunk"] == row["chunk"]))
            state = row["exits"][state]
        yield pa.record_batch([
            pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()),
            pa.array([r[3] for r in out], pa.int32()), pa.array([r[4] for r in out], pa.bool_()),
        ], names=["key", "chunk", "needed", "state", "ends"])


EDITS = "place long, edit string, said string, role string, end string, ending string"


def _trace(chunk: pa.Table, plan: pa.Table) -> pa.Table:
    """The edit of every row; a conversation without a plan lies in this chunk alone."""
    planned = {r["key"]: r for r in plan.to_pylist()}
    rows = []
    for key, run in _runs(chunk):
        own = planned.get(key, {"needed": START, "state": 0, "ends": True})
        vectors, state = backward(run["code"], unpack(own["needed"])), own["state"]
        for k, code in enumerate(run["code"]):
            letters, state, said, role = choose(code, vectors[k + 1], state)
            rows.append([run["place"][k], letters, said, role, "", ""])
        if own["ends"]:
            rows[-1][4:] = finish(state)
    names = ["place", "edit", "said", "role", "end", "ending"]
    return pa.table({n: pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k, n in enumerate(names)})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by newlines; rows come by conversation and in order."""
    key, state = None, None
    for batch in batches:
        out = []
        for this, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if this != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = this, hashlib.sha256()
                state.update(lines.encode())
            else:
                state.update(b"\n" + lines.encode())
        if out:
            yield pa.record_batch([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["key", "digest"])
    if state is not None:
        yield pa.record_batch([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "digest"])


def keyed(conversation: Column) -> Column:
    """A text that names a conversation, never null."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, n): the rows after damage by crc32 of ``conversation:turn``; n copies side by side."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conversation), F.lit(":"), space(turn)).cast("binary")) % 20
    frame = turns.select(keyed(F.col(conversation)).alias("key"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"))
    return frame.where("kind != 0").select(
        "key",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"),
    )


def _ordered(rows: DataFrame, piece: int) -> DataFrame:
    """(key, turn, role, text, n, place, chunk, …): equal rows together, places in order over the whole table."""
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("role"), F.left("text", F.lit(64)), F.xxhash64("text"), F.xxhash64(F.lit(7), "text")]
    frame = rows.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n"))
    frame = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return cut(frame).withColumn("chunk", F.floor(F.col("place") / piece))


def _coded(ordered: DataFrame) -> DataFrame:
    """(key, place, chunk, n, code, blank, late): the faults of every row's first copy."""
    shown = F.rtrim("text", F.lit(WHITE))
    frame = ordered.select(
        "key", "place", "chunk", "n", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(7), "text", "role").alias("y"),
        (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("late"),
        F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)).alias("letter"),
        (F.col("role") == "").alias("nameless"),
    )
    firsts = frame.where("not blank").groupBy("key", "x", "y").agg(F.min("place").alias("first")).select("first")
    frame = frame.join(firsts, F.col("place") == F.col("first"), "left")
    initial = F.when(F.col("nameless"), 3).otherwise(F.col("letter") - 1)
    forced = F.col("first").isNull()
    fault = F.when(forced, FORCED).when(F.col("late"), LATE).otherwise(0)
    return frame.select("key", "place", "chunk", "n", (initial + fault).cast("int").alias("code"), "blank")


def edits(ordered: DataFrame, codes: DataFrame, how: Repair = Repair()) -> tuple[DataFrame, DataFrame]:
    """The edit of every row of the codes, by its place, and the summaries of the chunks."""
    chunks = codes.select("key", "place", "chunk", "n", "code").groupBy("chunk")
    summary = cut(chunks.applyInArrow(_speculate, SUMMARY))
    many = summary.groupBy("key").agg(F.count("*").alias("chunks"), F.max("chunk").alias("last_chunk")).where("chunks > 1")
    many = cut(summary.join(many.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select("key", "chunk", "last_chunk", "started", "found"))
    runs = many.select("key", "chunk", "started", "found")
    while True:
        # The speculative run comes first.
        each = F.struct((F.col("started") != START).alias("later"), "started", "found")
        known = runs.groupBy("key", "chunk").agg(F.array_sort(F.collect_set(each)).alias("known"))
        inorder = known.repartition("key").sortWithinPartitions("key", F.desc("chunk"))
        plan = cut(inorder.mapInArrow(_stitch, "key string, chunk long, needed long, missing boolean, started long, found long"))
        asked = plan.where("missing")
        if asked.isEmpty():
            break
        fixed = chunks.cogroup(asked.groupBy("chunk")).applyInArrow(_fix, "key string, chunk long, started long, found long")
        runs = cut(runs.unionByName(fixed))
    exits = chunks.cogroup(plan.groupBy("chunk")).applyInArrow(_exits, "key string, chunk long, needed long, exits array<int>")
    exits = exits.join(many.select("key", "chunk", "last_chunk"), ["key", "chunk"]).repartition("key").sortWithinPartitions("key", "chunk")
    entered = cut(exits.mapInArrow(_enter, "key string, chunk long, needed long, state int, ends boolean"))
    return cut(chunks.cogroup(entered.groupBy("chunk")).applyInArrow(_trace, EDITS)), summary


def _said(roles: Column) -> Column:
    """The lines of inserted turns."""
    return F.transform(F.filter(F.split(roles, ","), lambda r: r != ""), lambda r: F.concat(r, F.lit(":")))


def repair(rows: DataFrame, how: Repair = Repair()) -> tuple[DataFrame, DataFrame]:
    """Repairs (key, turn, role, text, n).

    First (key, place, lines): what stays of each conversation, as ``role:text`` lines in order of place. Second one
    row a conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    ordered = _ordered(rows, how.piece)
    codes = cut(_coded(ordered))
    found, summary = edits(ordered, codes, how)

    own = F.col("role_of_edit") == "="
    texts = ordered.join(found.withColumnRenamed("place", "at").withColumnRenamed("role", "role_of_edit"), F.col("place") == F.col("at"))
    kept = F.when(F.col("role_of_edit") != "", F.array(F.concat(F.when(own, F.col("role")).otherwise(F.col("role_of_edit")), F.lit(":"), F.col("text"))))
    lines = F.concat(_said(F.col("said")), F.coalesce(kept, F.array().cast("array<string>")), _said(F.col("ending")))
    lines = texts.where("said != '' or role_of_edit != '' or ending != ''").select("key", "place", F.array_join(lines, "\n").alias("lines"))

    letters = F.concat("edit", F.repeat(F.lit("D"), (F.col("n") - 1).cast("int")), "end")
    traced = codes.join(found, "place").withColumn("letters", letters)
    count = lambda letter: F.length("letters") - F.length(F.replace("letters", F.lit(letter), F.lit("")))
    forced, late = F.col("code").bitwiseAND(F.lit(FORCED)) != 0, F.col("code").bitwiseAND(F.lit(LATE)) != 0
    stays = (late & ~F.col("edit").endswith("D")).cast("long")
    pieces = traced.groupBy("key", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letters"))), lambda r: r["letters"]), "").alias("letters"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(forced, F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(late.cast("long")).alias("truncated"),
        F.sum(3 * count("D") + 2 * count("I") + 2 * count("R") + stays).alias("cost"),
    )
    sums = pieces.groupBy("key").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "letters"))), lambda r: r["letters"]), "").alias("audit"),
    )
    turns = ordered.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(
        F.coalesce(F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    before = F.lag("last").over(Window.partitionBy("key").orderBy("chunk"))
    joint = F.concat_ws("", before, F.col("first"))
    pairs = summary.withColumn("joint", F.when(before.isNotNull() & ~joint.isin("01", "12", "21"), 1).otherwise(0))
    illegal = pairs.groupBy("key").agg(F.sum(F.col("illegal") + F.col("joint")).alias("illegal"))
    return lines, turns.join(sums, "key").join(illegal, "key").select("key", F.expr("try_cast(gaps as bigint)").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(turns: DataFrame, how: Repair = Repair(), conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every conversation: its faults, the cheapest audit, and the digest of the repaired text."""
    lines, sums = repair(damage(turns, conversation, turn, role, text), how)
    digests = lines.repartition("key").sortWithinPartitions("key", "place").select("key", "lines").mapInArrow(_digest, "key string, digest string")
    every = turns.groupBy(F.col(conversation).alias("conv")).agg(F.lit(1).alias("one")).select("conv", keyed(F.col("conv")).alias("of"))
    found = every.join(sums, F.col("of") == F.col("key"), "left").drop("key").join(digests, F.col("of") == F.col("key"), "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        F.col("conv").alias(conversation),
        *(whole(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
