"""Repair of conversation structure by dynamic programming over a grammar that all conversations share.

A conversation is a string over nine marks: its roles' initials, in capitals where the text is truncated, and X or D where
the row must go because it is blank or a duplicate. Re-Pair replaces the most frequent neighbours in the marks of the whole
corpus by new symbols, again and again. Between four states of role order, each symbol has one min-plus transfer matrix of
the cheapest edits, with the edits themselves as ropes; a rule's matrix is the product of its two parts, so what many
conversations share is computed once, and a conversation is the product of its few remaining symbols.

Rows are sorted by range, so a conversation of any size is cut into segments over many tasks. Of a segment only 32
small numbers go to the place where a path through the segments is chosen; its texts don't.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.blocks import saved

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
SEGMENT_ROWS, SEGMENT_BYTES = 2048, 4 << 20
RULES, ROUNDS, AT_ONCE = 96, 16, 8
TERMINALS = "XsuaoSUAO"
BLANKS = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: Where a row of a role leads from each state; the user comes first, after s and after a, the assistant after u.
USER = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}
MOVES = {"s": {START: AFTER_S}, "u": USER, "a": {AFTER_U: AFTER_A}, "o": {}}
Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]


def text_of(rope: Rope) -> str:
    out, left = [], [rope]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left += [x[1], x[0]]
    return "".join(out)


def better(x: tuple[int, Rope] | None, y: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    """The cheaper of two entries; of equal ones that with the lesser edits.

    Edits of equal cost for the same rows between the same states are never one a prefix of the other, as more edits are inserts
    and cost more. So the least edits of two parts side by side are the least of both parts.
    """
    if x is None or y is None:
        return y if x is None else x
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return x if text_of(x[1]) <= text_of(y[1]) else y


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * len(b[0]) for _ in a]
    for i, row in enumerate(a):
        for j in range(len(b[0])):
            best = None
            for k, x in enumerate(row):
                if x is not None and (y := b[k][j]) is not None:
                    best = better(best, (x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]))
            out[i][j] = best
    return out


def inserts() -> Matrix:
    """No, one or two inserted rows; more only lead where fewer do."""
    out: Matrix = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    for i in STATES:
        j = AFTER_A if i == AFTER_U else AFTER_U
        k = AFTER_U if j == AFTER_A else AFTER_A
        out[i][j] = better(out[i][j], (INSERT, "I"))
        out[i][k] = better(out[i][k], (2 * INSERT, "II"))
    return out


def terminal(mark: str) -> Matrix:
    """Inserts, then what may be done with one row."""
    one: Matrix = [[(DELETE, "D") if i == j else None for j in STATES] for i in STATES]
    if mark != "X":
        extra = TRUNCATED if mark.isupper() else 0
        for i in STATES:
            if (j := MOVES[mark.lower()].get(i)) is not None:
                one[i][j] = better(one[i][j], (KEEP + extra, "K"))
            j = AFTER_A if i == AFTER_U else AFTER_U
            one[i][j] = better(one[i][j], (REROLE + extra, "R"))
    return times(inserts(), one)


def compressed(marks: str, rules: list[tuple[str, str]]) -> str:
    for symbol, pair in rules:
        marks = marks.replace(pair, symbol)
    return marks


def matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """The matrix of every symbol, bottom-up: a rule only uses symbols before it."""
    out = {m: terminal(m) for m in TERMINALS}
    for symbol, (left, right) in rules:
        out[symbol] = times(out[left], out[right])
    return out


def grammar(patterns: DataFrame) -> list[tuple[str, str]]:
    """Re-Pair over (marks, n): rules in order, found by counting neighbours over all conversations.

    A round takes up to AT_ONCE of the most frequent pairs that share no symbol, so none changes another's count. It ends when no
    pair occurs twice, or after RULES rules or ROUNDS rounds, which bounds what the driver counts at (9 + RULES) squared numbers.
    """
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):

        def count(batches: Iterator[pa.RecordBatch], rules=tuple(rules)) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for marks, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = compressed(marks, list(rules))
                    here = Counter(map("".join, zip(s, s[1:])))
                    for pair, seen in here.items():
                        total[pair] += n * (s.count(pair) if pair[0] == pair[1] else seen)
            yield pa.RecordBatch.from_pydict({"pair": list(total), "n": list(total.values())}, schema=pa.schema([("pair", pa.string()), ("n", pa.int64())]))

        found = patterns.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").collect()
        used: set[str] = set()
        for pair, n in sorted(found, key=lambda r: (-r.n, r.pair)):
            if not used & set(pair) and len(used) < 2 * AT_ONCE and len(rules) < RULES:
                used |= set(pair)
                rules.append((chr(0x100 + len(rules)), pair))
        if not used or len(rules) >= RULES:
            break
    return rules


def cheapest(marks: str, table: dict[str, Matrix], rules: list[tuple[str, str]], starts: tuple[int, ...] = tuple(STATES)) -> Matrix:
    """The matrix of marks, of the rows ``starts`` only."""
    out: Matrix = [[(0, "") if i == j else None for j in STATES] for i in starts]
    for symbol in compressed(marks, rules):
        out = times(out, table[symbol])
    return out


#: From each state to a right end: what inserts it takes.
ENDS = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}


def next_state(state: int, edit: str, initial: str) -> tuple[int, str | None]:
    """The state after an edit, and the role that it writes, None for the row's own."""
    if edit == "D":
        return state, None
    if edit == "K":
        return MOVES[initial][state], None
    return (AFTER_A, "assistant") if state == AFTER_U else (AFTER_U, "user")


def replay(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[int, list[tuple[str, str]]]:
    """The rows that edits leave or make."""
    out, i = [], 0
    for e in edits:
        own = roles[i] if e != "I" else ""
        state, role = next_state(state, e, own[:1])
        if e == "I":
            out.append((role, ""))
        else:
            if e != "D":
                out.append((role or own, texts[i]))
            i += 1
    return state, out


def mark(role: str, text: str) -> str:
    """X for a blank row, else the class of the role's initial, in capitals if the text is truncated."""
    bare = text.strip(BLANKS)
    if not bare:
        return "X"
    m = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return m if bare[-1] in ".!?" else m.upper()


def again(marks: str, roles: list[str], texts: list[str]) -> str:
    """Marks with D for rows whose role and text stand before."""
    seen: set[tuple[str, str]] = set()
    out = []
    for m, row in zip(marks, zip(roles, texts)):
        out.append("D" if m != "X" and row in seen else m)
        seen.add(row)
    return "".join(out)


def segments(df: DataFrame, kind: str, rows: int, size: int) -> DataFrame:
    """Sorted rows cut into segments of one conversation each; ``open`` where more of it may lie elsewhere.

    In closed segments duplicates are marked; open ones have a key for each row that isn't blank, of conversation, role and text.
    """
    shape = f"conv {kind}, part int, seg long, open boolean, marks string, initials array<string>, turns array<long>, roles array<string>, texts array<string>, keys array<binary>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, weight = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        done: list[dict] = []
        spread = True  # the first conversation of a task may have begun in another
        schema = None

        def close(is_open: bool) -> None:
            nonlocal seg, held, weight
            conv, turns, roles, texts = held[0][0], [h[1] for h in held], [h[2] for h in held], [h[3] for h in held]
            marks, keys = "".join(map(mark, roles, texts)), []
            if is_open:
                lead = repr(conv)
                keys = [b"" if m == "X" else hashlib.md5(f"{lead}\0{len(r)}\0{r}{t}".encode()).digest() for m, r, t in zip(marks, roles, texts)]
            else:
                marks = again(marks, roles, texts)
            done.append({"conv": conv, "part": part, "seg": seg, "open": is_open, "marks": marks, "initials": [r[:1] for r in roles], "turns": turns, "roles": roles, "texts": texts, "keys": keys})
            seg, held, weight = seg + 1, [], 0

        def out() -> pa.RecordBatch:
            nonlocal done
            batch, done = pa.RecordBatch.from_pylist(done, schema=schema), []
            return batch

        total = 0
        for batch in batches:
            if schema is None:
                text = pa.string()
                schema = pa.schema([("conv", batch.schema.field(0).type), ("part", pa.int32()), ("seg", pa.int64()), ("open", pa.bool_()), ("marks", text), ("initials", pa.list_(text)), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(text)), ("texts", pa.list_(text)), ("keys", pa.list_(pa.binary()))])
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    close(spread)
                    spread = False
                elif held and (len(held) >= rows or weight >= size):
                    close(True)
                    spread = True
                held.append(row)
                weight += len(row[3])
                total += len(row[3])
                if total >= size and done:
                    yield out()
                    total = 0
        if held:
            close(True)
        if done:
            yield out()

    return df.mapInArrow(cut, shape)


class Summary:
    """What a conversation comes to, segment after segment in order; holds no rows but, if asked for, the repaired ones."""

    def __init__(self, keep: bool):
        self.keep, self.hash, self.first = keep, hashlib.sha256(), True
        self.counts, self.illegal, self.cost, self.audit, self.rows = Counter(), 0, 0, [], []
        self.initial: str | None = None
        self.turn: int | None = None
        self.low: int | None = None
        self.distinct = 0

    def write(self, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode())
            self.first = False
        if self.keep:
            self.rows += rows

    def add(self, marks: str, initials: list[str], turns: list[int | None], edits: str, rows: list[tuple[str, str]]) -> None:
        self.counts.update(marks)
        for x in initials:
            self.illegal += self.initial is not None and self.initial + x not in ("su", "ua", "au")
            self.initial = x
        for t in turns:
            if t is not None and t != self.turn:
                self.low = t if self.low is None else self.low
                self.distinct, self.turn = self.distinct + 1, t
        self.audit.append(edits)
        self.cost += INSERT * edits.count("I") + REROLE * edits.count("R") + DELETE * edits.count("D")
        self.cost += TRUNCATED * sum(m in "SUAO" and e != "D" for m, e in zip(marks, edits.replace("I", "")))
        self.write(rows)

    def fields(self) -> dict:
        return {
            "gaps": 0 if self.low is None else self.turn - self.low + 1 - self.distinct, "blank": self.counts["X"], "duplicate": self.counts["D"], "truncated": sum(self.counts[m] for m in "SUAO"),
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(), "repaired": [{"role": r, "text": t} for r, t in self.rows],
        }


def conversation_schema(conv: pa.DataType) -> pa.Schema:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    kinds = {"audit": pa.string(), "repaired_sha256": pa.string(), "repaired": pa.list_(turn)}
    return pa.schema([("conv", conv), *[(f, kinds.get(f, pa.int64())) for f in FIELDS]])


def ranks(m: Matrix) -> list[int]:
    """For each entry its cost (-1: none) and then, by row, its place among the row's edits in order."""
    out = [-1 if x is None else x[0] for row in m for x in row]
    for row in m:
        texts = [None if x is None else text_of(x[1]) for x in row]
        known = sorted({t for t in texts if t is not None})
        out += [-1 if t is None else known.index(t) for t in texts]
    return out


def path(steps: list[list[int]]) -> list[int]:
    """The states between segments, START first, on the cheapest way with the least edits."""
    left = [[INSERT * len(ENDS[i]) for i in STATES]]
    for step in reversed(steps):
        left.append([min((step[4 * i + k] + left[-1][k] for k in STATES if step[4 * i + k] >= 0 and left[-1][k] is not None), default=None) for i in STATES])
    left.reverse()
    out = [START]
    for n, step in enumerate(steps):
        i = out[-1]
        ways = [k for k in STATES if step[4 * i + k] >= 0 and left[n + 1][k] is not None and step[4 * i + k] + left[n + 1][k] == left[n][i]]
        out.append(min(ways, key=lambda k: step[16 + 4 * i + k]))
    return out


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, keep: bool = True,
    segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """One row for each conversation: its key, its faults, the cheapest edits and what they make of it.

    Rows count by turn, null first, then by role and text; a null role or text is one space, and rows with a null key are one
    conversation. gaps, blank, duplicate, truncated and illegal are counts; audit has an initial for each edit (Keep, Rerole, Delete,
    Insert) and cost their sum. repaired has the rows left (array of role and text; empty without ``keep``) and repaired_sha256 the digest of
    ``role:text`` lines. A fault counts once a row: blank, else a copy of an earlier row, else not ended by one of ``.!?``. Deleting
    everything is a repair too, so there always is one. Other columns are left out; an empty table gives no rows.

    A conversation of more rows than fit one segment goes through several tasks; only its audit (a byte a row) and, with ``keep``, its
    repaired rows come together, and the digest, which is made in order by its nature, is made by one task from a stream.
    """
    kind = df.schema[conv].dataType.simpleString()
    slim = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    ordered = slim.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions("conv", "turn", "role", "text")
    cut = saved(segments(ordered, kind, segment_rows, segment_bytes), "segments")
    closed, opened = cut.where("NOT open"), cut.where("open")

    spots = opened.select("part", "seg", F.posexplode("keys").alias("pos", "key")).where(F.length("key") > 0)
    first = spots.groupBy("key").agg(F.min(F.struct("part", "seg", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = spots.join(first, "key").where(F.struct("part", "seg", "pos") > F.col("first")).groupBy("part", "seg").agg(F.collect_list("pos").alias("later"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for old, places in zip(batch.column("marks").to_pylist(), batch.column("later").to_pylist()):
                new = list(old)
                for p in places or []:
                    new[p] = "D"
                marks.append("".join(new))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seg"), pa.array(marks, pa.string())], ["part", "seg", "marks"])

    joined = opened.select("part", "seg", "marks").join(later, ["part", "seg"], "left")
    marks = saved(joined.mapInArrow(marked, "part int, seg long, marks string"), "marks")
    patterns = saved(closed.select("marks").unionByName(marks.select("marks")).select(F.translate("marks", "D", "X").alias("marks")).groupBy("marks").agg(F.count("*").alias("n")), "patterns")
    rules = grammar(patterns)
    shared = df.sparkSession.sparkContext.broadcast((rules, matrices(rules)))

    def solve(marks: str, start: int, end: int | None) -> str:
        """The edits from one state to another or, for None, to a right end with its inserts."""
        [row] = cheapest(marks.replace("D", "X"), shared.value[1], shared.value[0], (start,))
        if end is not None:
            return text_of(row[end][1])
        best = None
        for x, tail in zip(row, ENDS.values()):
            if x is not None:
                best = better(best, (x[0] + INSERT * len(tail), (x[1], tail)))
        return text_of(best[1])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 14)(lambda m: solve(m, START, None))
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                one = Summary(keep)
                edits = known(r["marks"])
                one.add(r["marks"], r["initials"], r["turns"], edits, replay(edits, START, r["roles"], r["texts"])[1])
                out.append({"conv": r["conv"], **one.fields()})
            yield pa.RecordBatch.from_pylist(out, schema=conversation_schema(batch.schema.field("conv").type))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [ranks(cheapest(m.replace("D", "X"), shared.value[1], shared.value[0])) for m in batch.column("marks").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["conv", "part", "seg"]).columns, pa.array(steps, pa.list_(pa.int64()))], ["conv", "part", "seg", "step"])

    def choose(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([path([s["step"] for s in row]) for row in column.to_pylist()], pa.list_(pa.int32()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, conv, schema = None, None, None
        for batch in batches:
            schema = schema or conversation_schema(batch.schema.field("conv").type)
            for r in batch.to_pylist():
                if one is not None and r["conv"] != conv:
                    yield pa.RecordBatch.from_pylist([{"conv": conv, **one.fields()}], schema=schema)
                    one = None
                one, conv = one or Summary(keep), r["conv"]
                edits = solve(r["marks"], r["from"], r["to"])
                one.add(r["marks"], r["initials"], r["turns"], edits, replay(edits, r["from"], r["roles"], r["texts"])[1])
                if r["last"]:
                    one.audit.append(tail := ENDS[r["to"]])
                    one.cost += INSERT * len(tail)
                    one.write(replay(tail, r["to"], [], [])[1])
        if one is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, **one.fields()}], schema=schema)

    shape = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>"
    own = opened.select("conv", "part", "seg").join(marks, ["part", "seg"])
    steps = own.mapInArrow(weigh, f"conv {kind}, part int, seg long, step array<long>")
    lists = steps.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "seg", "step"))).alias("steps"))
    ways = lists.select("steps.part", "steps.seg", F.arrow_udf(choose, "array<int>")(F.col("steps")).alias("way"))
    place = F.posexplode(F.arrays_zip(F.col("part"), F.col("seg"))).alias("n", "at")
    ways = ways.select("way", place).select(
        F.col("at.part").alias("part"), F.col("at.seg").alias("seg"), F.expr("way[n]").alias("from"), F.expr("way[n + 1]").alias("to"), (F.col("n") == F.size("way") - 2).alias("last")
    )
    whole = opened.drop("marks", "keys", "open").join(marks, ["part", "seg"]).join(ways, ["part", "seg"])
    parted = whole.repartition("conv").sortWithinPartitions("conv", "part", "seg").mapInArrow(stream, shape)
    out = closed.drop("keys", "open").mapInArrow(finish, shape).unionByName(parted)
    return out.withColumnRenamed("conv", conv)
