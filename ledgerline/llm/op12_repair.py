"""Repair of conversation structure at the least cost, by depth-first branch-and-bound.

A conversation's rows, in the order of their turns, are kept (0), given the other role (2) or
deleted (3), and empty messages of the user or the assistant are inserted (2), until the roles'
initials read `(s?(ua)+)?`. Blank and duplicate rows must go; a truncated row that stays costs 1.
Of the cheapest edits the ASCII-least audit wins: one initial an edit, in order.

The search walks nodes (row, state), the state being what the next kept row must follow: nothing,
`s`, `u` or `a`. An explicit stack holds open prefixes, best last. A prefix is dropped if its cost
and the suffix's lower bound exceed the incumbent (or equal it with a greater audit), or if its node's
dominance table has a prefix of no greater (cost, audit). The bound sums what each row costs at
least, and 2 for each disjoint pair of neighbours that cannot follow each other. When the stack is
empty the incumbent is optimal.

Long conversations are searched in segments of SEGMENT rows: the best prefix to each of the four
states at a segment's end starts the next one. An insertion belongs to the row that follows, so no
such audit is a prefix of another, and they can be compared by rank. Messages go out as soon as all
four prefixes agree on them. So a task streams a conversation of any length by, in one sort of its
partition; what it holds is a segment and where the prefixes still differ. One conversation is one
sorted run, however many rows it has: its hash over all of its text is sequential by nature. What
is a duplicate is found before that by a grouped minimum, which does not gather a conversation.

Nulls in role and text are one space; null turns come first; a null conv_id is a conversation of
its own. Rows of one turn go by role, then text, in code point order. Repeated rows are duplicates.
An empty table gives no rows; columns but conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, table

SEGMENT = 16
#: States: nothing yet, after s, after u, after a; and which initial leads where.
NONE, S, U, A = range(4)
FOLLOWS = {NONE: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
TURNS = {NONE: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
LAWFUL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"


def damaged(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows of `messages` after damage by a checksum of conversation and turn;
    copies is how often a row stands there. Dropped rows stay with 0 and without text, so that no conversation is lost."""
    named = F.concat(*[F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    n, role, text = F.crc32(named) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = F.when(n <= 1, F.lit("")).when(n == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(n == 0, F.lit("")).when(n == 4, F.lit("user")).otherwise(role)
    return messages.select("conv_id", "turn", role.alias("role"), hurt.alias("text"), F.when(n == 0, 0).when(n == 3, 2).otherwise(1).alias("copies"))


def whole(messages: DataFrame) -> DataFrame:
    """`messages` as they are, in the form of `damaged`."""
    return messages.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with `late` (their role and text stand at an earlier turn), one sorted run for each conversation."""
    rows = rows.withColumn("same", F.when(F.col("copies") > 0, F.sha2(F.concat_ws("\0", "role", "text"), 256)))
    # Only what is repeated comes back: a row for each text that stands at several turns.
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    again = rows.where("copies > 0").groupBy("conv_id", "same").agg(F.min(turn).alias("lo"), F.max(turn).alias("hi")).where("lo < hi")
    again = again.select(F.col("conv_id").alias("c"), F.col("same").alias("k"), "lo")
    both = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("k")), "left")
    late = F.coalesce(turn > F.col("lo"), F.lit(False))
    kept = both.select("conv_id", "turn", "role", "text", "copies", late.alias("late"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def fault(text: str, repeated: bool) -> int:
    """A row's first fault, 0 if none."""
    end = text.rstrip(SPACE)
    return BLANK if not end else DUPLICATE if repeated else TRUNCATED if end[-1] not in ".!?" else 0


def bounds(roles: list[str], faults: list[int], lawful: str) -> list[int]:
    """What the rows from each one on cost at least, if only initials of `lawful` can be kept for nothing."""
    n = len(roles)
    out, own, ahead = [0] * (n + 1), [0] * n, -1
    gone = [0] * (n + 1)  # deletions that are required from each row on
    for i in range(n - 1, -1, -1):
        must = faults[i] in (BLANK, DUPLICATE)
        gone[i] = gone[i + 1] + 3 * must
        if must:
            out[i] = out[i + 1] + 3
            continue
        free = roles[i] in lawful and roles[i] != ""
        own[i] = 2 * (not free) + (faults[i] == TRUNCATED)
        out[i] = out[i + 1] + own[i]
        if free:
            if ahead >= 0 and roles[i] + roles[ahead] not in LAWFUL:
                # Between the two stand only deleted rows: one of them is edited, or something inserted.
                out[i] = max(out[i], own[i] + 2 + gone[i + 1] - gone[ahead] + own[ahead] + out[ahead + 1])
            ahead = i
        else:
            ahead = -1
    return out


def search(roles: list[str], faults: list[int], entries: list[tuple[int, int]], goals: tuple[int, ...], last: bool) -> tuple[int, int, str] | None:
    """The least (cost, rank of entry, audit) from one of `entries`, (state, cost) in the order of their audits, over
    all rows to one of `goals`. Insertions after the rows are made only if these are the last."""
    n, begun = len(roles), bounds(roles, faults, "ua")
    # Only at the start can an s be kept.
    bound = {NONE: bounds(roles, faults, "sua"), S: begun, U: begun, A: begun}
    seen: dict[tuple[int, int], tuple[int, int, str]] = {}
    best: tuple[int, int, str] | None = None
    stack = sorted(((cost + bound[state][0], cost, rank, "", 0, state) for rank, (state, cost) in enumerate(entries)), reverse=True)
    while stack:
        least, cost, rank, audit, i, state = stack.pop()
        if best is not None and (least > best[0] or least == best[0] and (rank, audit) >= (best[1], best[2][: len(audit)]) and (rank, audit) != (best[1], best[2][: len(audit)])):
            continue
        known = seen.get((i, state))
        if known is not None and known <= (cost, rank, audit):
            continue
        seen[i, state] = (cost, rank, audit)
        if i == n and state in goals:
            if best is None or (cost, rank, audit) < best:
                best = (cost, rank, audit)
            if not last:
                continue
        role, to = TURNS[state]
        nexts = []
        if i < n:
            nexts.append((cost + 3, "D", i + 1, state))
            if faults[i] not in (BLANK, DUPLICATE):
                short = faults[i] == TRUNCATED
                own = FOLLOWS[state].get(roles[i])
                if own is not None:
                    nexts.append((cost + short, "K", i + 1, own))
                if roles[i] != role[0]:
                    nexts.append((cost + 2 + short, "R", i + 1, to))
        if i < n or last:
            nexts.append((cost + 2, "I", i, to))
        stack += sorted(((c + bound[s][j], c, rank, audit + edit, j, s) for c, edit, j, s in nexts), reverse=True)
    return best


def repaired(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple[str, str, str]], int | None]]:
    """Of one conversation's rows (role, text, fault): its edits as (edit, role, text), in lists as they
    become certain, and with the last of them the cost."""
    paths = {NONE: (0, 0, [])}  # state -> (cost, rank, segments that are not out yet)
    part: list[tuple] = []
    done = False
    while not done:
        part = []
        for row in rows:
            part.append(row)
            if len(part) > SEGMENT:
                break
        else:
            done = True
        # One row is looked ahead, so that the last segment is known as such.
        rest = [] if done else [part.pop()]
        rows = iter_with(rest, rows)
        roles, faults = [r[:1] for r, _, _ in part], [f for _, _, f in part]
        entries = sorted(paths.items(), key=lambda p: p[1][1])
        starts = [(state, cost) for state, (cost, _, _) in entries]
        found = {}
        for goals in [(NONE, A)] if done else [(g,) for g in (NONE, S, U, A)]:
            if (hit := search(roles, faults, starts, goals, done)) is not None:
                cost, at, audit = hit
                state, (_, _, before) = entries[at]
                found[goals[0]] = (cost, (at, audit), [*before, (audit, edits(audit, state, part))])
        ranks = {key: i for i, key in enumerate(sorted(key for _, key, _ in found.values()))}
        paths = {state: (cost, ranks[key], parts) for state, (cost, key, parts) in found.items()}
        while all(parts for _, _, parts in paths.values()) and (done or all(parts[0] is next(iter(paths.values()))[2][0] for _, _, parts in paths.values())):
            out = [parts.pop(0) for _, _, parts in paths.values()][0]
            yield out[1], None
    yield [], min(cost for cost, _, _ in paths.values())


def iter_with(head: list, tail: Iterator) -> Iterator:
    yield from head
    yield from tail


def edits(audit: str, state: int, rows: list[tuple]) -> list[tuple[str, str, str]]:
    """The edits that an audit names, from a state on: (edit, role, text) each."""
    out, at = [], 0
    for edit in audit:
        role, to = TURNS[state]
        if edit == "I":
            out.append(("I", role, ""))
            state = to
            continue
        own, text, _ = rows[at]
        at += 1
        if edit == "K":
            role, state = own, FOLLOWS[state][own[:1]]
        elif edit == "R":
            state = to
        else:
            role = own
        out.append((edit, role, text))
    return out


class Conversation:
    """Reads one conversation's rows once and keeps their figures."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows, self.turns, self.low, self.high, self.faults, self.illegal = rows, 0, None, None, [0] * 4, 0

    def __iter__(self) -> Iterator[tuple[str, str, int]]:
        before, initial = None, None
        for turn, role, text, copies, late in self.rows:
            for _ in range(copies):
                if turn is not None and turn != self.high:
                    self.turns, self.high = self.turns + 1, turn
                    self.low = turn if self.low is None else self.low
                kind = fault(text, late or before == (turn, role, text))
                before = (turn, role, text)
                self.faults[kind] += 1
                self.illegal += initial is not None and initial + role[:1] not in LAWFUL
                initial = role[:1]
                yield role, text, kind

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def flowing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in range(batch.num_columns)])


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, rows in groupby(flowing(batches), key=lambda r: r[0]):
        yield conv, Conversation(r[1:] for r in rows)


MESSAGES = "conv_id long, position long, edit string, role string, text string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def emitted(rows: Iterator[tuple], schema: str, most: int = 512) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in schema.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) >= most or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.types)], schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.types)], schema=kinds)


def repair(rows: DataFrame) -> DataFrame:
    """MESSAGES of `damaged` or `whole` rows: each edit in order with what it leaves; deleted rows are told by their edit."""
    session(rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for conv, rows in conversations(batches):
                position = 0
                for part, _ in repaired(iter(rows)):
                    for edit, role, text in part:
                        yield conv, position, edit, role, text
                        position += 1

        yield from emitted(out(), MESSAGES)

    return keyed(ordered(rows)).mapInArrow(each, MESSAGES)


def keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "copies", "late")


def summary(rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of `damaged` or `whole` rows: its faults, and the cost, audit and hash of its repair."""
    session(rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for conv, rows in conversations(batches):
                total, audit, digest, first = 0, [], hashlib.sha256(), True
                for part, cost in repaired(iter(rows)):
                    audit.append("".join(e for e, _, _ in part))
                    for edit, role, text in part:
                        if edit != "D":
                            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                            first = False
                    total = total if cost is None else cost
                yield conv, rows.gaps, rows.faults[BLANK], rows.faults[DUPLICATE], rows.faults[TRUNCATED], rows.illegal, total, "".join(audit), digest.hexdigest()

        yield from emitted(out(), SUMMARY)

    return keyed(ordered(rows)).mapInArrow(each, SUMMARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(damaged(table(spark, sf_dir, "conversations")))
