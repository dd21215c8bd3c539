"""Repair of conversation structure by iterative-deepening A* over edit scripts.

*Model.* A conversation's rows are read in order. Delete (cost 4), Insert an empty turn (3), Keep
(0) and Rerole (3) are its edits; blank and duplicate rows must be deleted, a truncated row that
stays costs 3 more. The role initials that remain must match ``(s?(ua)+)?``. In every state of that
pattern only one of user and assistant can follow, so an edit's initial fixes the edit.

*Search.* Depth first, edits in ASCII order (D, I, K, R), under a cost bound that rises to the least
cost that exceeded it. ``lower`` is the transposition table of failed states: what a state is
proven to cost at least, kept from bound to bound. The first accepting path under the least
bound is the cheapest script, and among those the ASCII-least.

*Scale.* Rows are dealt by ranges of (conversation, turn, role, text), so a conversation that holds a
third of all rows is cut over many tasks. A conversation that lies within one task is settled
there, in one pass over a sorted stream. One that is cut, or longer than ``PIECE_ROWS``, is searched
piece by piece for every pair of entry and exit state; costs and ranks of the pieces (a few numbers for
each piece) are then composed, and its rows stream once more through the chosen scripts. The
digest of a repaired conversation is one sequential hash, so this last stream, and only it, runs in one
task per conversation, with a hash state and the script in memory, not the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.llm.common import saved, written

PIECE_ROWS = 512
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
INFINITE = 1 << 60

#: The pattern ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 accept.
STATES = range(4)
ACCEPTS = (0, 3)
FORCED = (2, 2, 3, 2)  # the state after the one role, user or assistant, that can follow
ROLE_OF = {2: "user", 3: "assistant"}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL_PAIRS = frozenset(("su", "ua", "au"))

FINE, MUST_GO, TRUNCATED = 0, 1, 2


def floor_costs(rows: list[tuple[str, int]]) -> list[int]:
    """What the rows from each place on cost at least, whatever the state.

    Forced deletions and truncations count in full. Two neighbours among the rows that may stay
    whose initials cannot follow each other need an edit of their own; pairs that share no
    row count together (the heaviest such choice)."""
    n = len(rows)
    base, pairs = [0] * (n + 1), [0] * (n + 1)
    after = n  # the next row that may stay
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        base[i] = base[i + 1] + (DELETE if fault == MUST_GO else CUT_SHORT if fault == TRUNCATED else 0)
        pairs[i] = pairs[i + 1]
        if fault != MUST_GO:
            if after < n and initial + rows[after][0] not in LEGAL_PAIRS:
                least = min(REROLE, INSERT, DELETE)
                if TRUNCATED in (fault, rows[after][1]):
                    least = min(least, DELETE - CUT_SHORT)
                pairs[i] = max(pairs[i], least + pairs[after + 1])
            after = i
    return [b + p for b, p in zip(base, pairs)]


def cheapest(rows: list[tuple[str, int]], entry: int, exits: tuple[int, ...], last: bool,
             floors: list[int] | None = None, lower: dict | None = None) -> tuple[int, str] | None:
    """``(cost, script)`` from state ``entry`` to one of ``exits`` after all rows, or None.

    ``last`` allows inserts after the final row. ``lower`` may be shared by calls with equal exits."""
    n = len(rows)
    floors = floor_costs(rows) if floors is None else floors
    lower = {} if lower is None else lower

    def bound_of(i: int, q: int) -> int:
        known = lower.get((i, q))
        if known is None:
            known = floors[i]
            if not last and exits[0] < 2:  # nothing but a system row may stay, in what is left
                kept = 0 if q == exits[0] else 1
                known = DELETE * max(n - i - kept, 0) if q <= exits[0] and n - i >= kept else INFINITE
            elif i == n and q not in exits:
                known = INSERT if last else INFINITE
            lower[i, q] = known
        return known

    def edits(i: int, q: int) -> list[tuple[str, int, int, int]]:
        out = []
        if i < n:
            initial, fault = rows[i]
            out.append(("D", DELETE, i + 1, q))
        if i < n or last:
            out.append(("I", INSERT, i, FORCED[q]))
        if i < n and fault != MUST_GO:
            extra = CUT_SHORT if fault == TRUNCATED else 0
            if (q, initial) in STEP:
                out.append(("K", extra, i + 1, STEP[q, initial]))
            out.append(("R", REROLE + extra, i + 1, FORCED[q]))
        return out

    if not last and not reachable(rows, entry, exits[0]):
        return None
    while (bound := bound_of(0, entry)) < INFINITE:
        # A frame: place, state, cost so far, edits left, least cost to go seen over all edits.
        frames = [[0, entry, 0, iter(edits(0, entry)), INFINITE]]
        script: list[str] = []
        paid: list[int] = []
        if n == 0 and entry in exits:
            return 0, ""
        while frames:
            i, q, spent, left, least = frame = frames[-1]
            step = next(left, None)
            if step is None:  # all edits failed under this bound
                lower[i, q] = max(lower[i, q], least)
                frames.pop()
                if frames:
                    script.pop()
                    frames[-1][4] = min(frames[-1][4], paid.pop() + lower[i, q])
                continue
            name, cost, j, r = step
            if spent + cost + bound_of(j, r) > bound:
                frame[4] = min(least, cost + lower[j, r])
                continue
            script.append(name)
            if j == n and r in exits:
                return spent + cost, "".join(script)
            paid.append(cost)
            frames.append([j, r, spent + cost, iter(edits(j, r)), INFINITE])
    return None


def reachable(rows: list[tuple[str, int]], entry: int, goal: int) -> bool:
    """Whether any script of a piece that is not the last leads from ``entry`` to ``goal``."""
    if entry == goal:
        return True
    if goal == 0:
        return False
    if goal == 1:
        return entry == 0 and any(initial == "s" and fault != MUST_GO for initial, fault in rows)
    return bool(rows)


def table_of(rows: list[tuple[str, int]]) -> tuple[list, list, list]:
    """Costs, scripts and ASCII ranks of the scripts of a piece for every entry state: to each exit state, then the end."""
    floors = floor_costs(rows)
    costs, scripts = [INFINITE] * 20, [""] * 20
    for k in range(5):
        exits, last, lower = ((k,), False, {}) if k < 4 else (ACCEPTS, True, {})
        for entry in STATES:
            found = cheapest(rows, entry, exits, last, floors, lower)
            if found:
                costs[entry * 5 + k], scripts[entry * 5 + k] = found
    ranks = [sorted(set(scripts[5 * (i // 5): 5 * (i // 5) + 5])).index(s) for i, s in enumerate(scripts)]
    return costs, scripts, ranks


class Rewriter:
    """Applies a script to rows that arrive one by one; each call returns the ``role:text`` lines it leaves."""

    def __init__(self, script: str, entry: int):
        self.script, self.at, self.q = script, 0, entry

    def inserts(self) -> list[str]:
        out = []
        while self.at < len(self.script) and self.script[self.at] == "I":
            self.q = FORCED[self.q]
            out.append(f"{ROLE_OF[self.q]}:")
            self.at += 1
        return out

    def row(self, role: str, text: str) -> list[str]:
        out = self.inserts()
        edit = self.script[self.at]
        self.at += 1
        if edit == "K":
            self.q = STEP[self.q, role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            self.q = FORCED[self.q]
            out.append(f"{ROLE_OF[self.q]}:{text}")
        return out


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def damaged(talks: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The rows after the contract's damage, with ``gone`` for dropped ones and ``copy`` for repeats.

    Null roles and texts, and nulls in the key ``conv_id:turn``, count as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled("turn"))) % 20
    rows = talks.select(F.col(conv).alias("conv"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
                        filled("role").alias("role"), filled("text").alias("text"))
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with ``again`` (role and text seen earlier in the conversation).

    Only groups of equal rows are counted and joined: their earliest row by (turn, salt) is the first."""
    keyed = rows.select("conv", "turn", "role", "text", "gone", F.md5("text").alias("digest"),
                        F.monotonically_increasing_id().alias("salt"))
    keyed = written(keyed, "turns")  # the salt tells equal rows apart, so it is given once
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "salt")
    same = (keyed.where(~F.col("gone")).groupBy(F.col("conv").alias("c"), F.col("role").alias("r"),
                                                F.col("digest").alias("d"))
            .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    joined = keyed.join(same, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                        & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    return joined.select("conv", "turn", "role", "text", "gone", "digest", "salt", again.alias("again"))


def fault_kind() -> Column:
    """b, d, t or empty: the first fault of a row."""
    trimmed = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    return (F.when(trimmed == "", F.lit("b")).when(F.col("again"), F.lit("d"))
            .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), F.lit("t")).otherwise(F.lit("")))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECE_FIELDS = ("conv {kind}, part int, piece int, whole boolean, n_rows long, blank long, duplicate long, "
                "truncated long, illegal long, first string, last string, turns long, turn_lo long, turn_hi long, "
                "costs array<long>, scripts array<string>, ranks array<int>, digest string, "
                "lines array<struct<role:string,text:string>>")


class Piece:
    """Rows of one conversation that a task has met so far, in order."""

    def __init__(self, conv, number: int, opens: bool):
        self.conv, self.number, self.opens = conv, number, opens
        self.rows: list[tuple[str, str]] = []
        self.marks: list[tuple[str, int]] = []
        self.faults = dict.fromkeys(("b", "d", "t"), 0)
        self.illegal = self.turns = 0
        self.lo = self.hi = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.marks and self.marks[-1][0] + initial not in LEGAL_PAIRS:
            self.illegal += 1
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.hi:
            self.turns += 1
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        self.rows.append((role, text))
        self.marks.append((initial, {"": FINE, "t": TRUNCATED}.get(fault, MUST_GO)))

    def record(self, part: int, whole: bool) -> dict:
        out = {"conv": self.conv, "part": part, "piece": self.number, "whole": whole, "n_rows": len(self.rows),
               "blank": self.faults["b"], "duplicate": self.faults["d"], "truncated": self.faults["t"],
               "illegal": self.illegal, "first": self.marks[0][0] if self.marks else None,
               "last": self.marks[-1][0] if self.marks else None, "turns": self.turns, "turn_lo": self.lo,
               "turn_hi": self.hi, "ranks": None, "digest": None, "lines": None}
        if whole:
            cost, script = cheapest(self.marks, 0, ACCEPTS, True)
            writer = Rewriter(script, 0)
            lines = [line for row in self.rows for line in writer.row(*row)] + writer.inserts()
            return out | {"costs": [cost], "scripts": [script],
                          "digest": hashlib.sha256(utf8("\n".join(lines))).hexdigest()}
        costs, scripts, ranks = table_of(self.marks)
        return out | {"costs": costs, "scripts": scripts, "ranks": ranks,
                      "lines": [{"role": r, "text": t} for r, t in self.rows]}


def pieces_of(rows: DataFrame, piece_rows: int) -> DataFrame:
    """The pieces of every conversation, settled where a conversation lies within one task."""
    order = ["conv", "turn", "role", "digest", "salt"]
    dealt = rows.select(*order, "gone", "text", fault_kind().alias("fault"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = PIECE_FIELDS.format(kind=rows.schema["conv"].dataType.simpleString())
    schema = rows.sparkSession.createDataFrame([], fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        shape, out, part = to_arrow_schema(schema), [], None
        now: Piece | None = None  # conversations open a task and close it: those may go on elsewhere
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "fault", "part")]
            for conv, turn, role, text, gone, fault, part in zip(*cols):
                if now is None:
                    now = Piece(conv, 0, True)
                elif now.conv != conv:
                    out.append(now.record(part, whole=not now.opens))
                    now = Piece(conv, 0, False)
                elif len(now.rows) >= piece_rows:
                    out.append(now.record(part, whole=False))
                    now = Piece(conv, now.number + 1, True)
                if not gone:
                    now.add(turn, role, text, fault)
                if len(out) >= 256 or out and not out[-1]["whole"]:  # what is cut carries its texts
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    out = []
        if now is not None:
            out.append(now.record(part, whole=False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return dealt.mapInArrow(run, schema)


def composed(pieces: DataFrame) -> DataFrame:
    """Per cut conversation: its counts, and for each piece the entry state and which script it takes.

    Only costs, and the ASCII ranks of the scripts, come together here: some 40 numbers for each piece."""
    slim = pieces.select("conv", "part", "piece", "n_rows", *COUNTS, "first", "last", "turns", "turn_lo", "turn_hi",
                         "costs", "ranks")
    kind = pieces.schema["conv"].dataType.simpleString()

    def run(key, pdf):
        pdf = pdf.sort_values(["part", "piece"], kind="stable")
        rows = pdf.to_dict("records")
        togo = [[INFINITE] * 4 for _ in rows]  # from the state before a piece to the end
        for k in range(len(rows) - 1, -1, -1):
            costs, final = rows[k]["costs"], k == len(rows) - 1
            for e in STATES:
                togo[k][e] = min(costs[e * 5 + 4] if final else INFINITE,
                                 INFINITE if final else min(costs[e * 5 + x] + togo[k + 1][x] for x in STATES))
        total = {c: int(sum(r[c] for r in rows)) for c in (*COUNTS, "turns")}
        state, before, turn, out = 0, None, None, []
        for k, r in enumerate(rows):
            if r["n_rows"]:
                total["illegal"] += before is not None and before + r["first"] not in LEGAL_PAIRS
                before = r["last"]
                if r["turns"]:
                    total["turns"] -= turn is not None and turn == r["turn_lo"]
                    turn = r["turn_hi"]
            if k == len(rows) - 1:
                take = 4
            else:
                goals = [(r["costs"][state * 5 + x] + togo[k + 1][x], r["ranks"][state * 5 + x], x) for x in STATES]
                take = min(goals)[2]
            out.append((r["conv"], r["part"], r["piece"], state, state * 5 + take))
            state = take
        lo, hi = pdf.turn_lo.min(), pdf.turn_hi.max()
        gaps = 0 if total["turns"] == 0 else int(hi) - int(lo) + 1 - total["turns"]
        found = pd.DataFrame(out, columns=["conv", "part", "piece", "entry", "take"])
        found["conv"] = found["conv"].astype(pdf["conv"].dtype)
        for name in COUNTS:
            found[name] = total[name]
        return found.assign(gaps=gaps, cost=int(togo[0][0]))

    return slim.groupBy("conv").applyInPandas(
        run, f"conv {kind}, part int, piece int, entry int, take int, blank long, duplicate long, truncated long, "
             "illegal long, gaps long, cost long")


def streamed(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """The script and digest of each cut conversation: its pieces pass in order, one at a time."""
    chosen = plan.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("piece").alias("q"), "entry", "take",
                         *[F.col(x).alias(f"all_{x}") for x in (*COUNTS, "gaps", "cost")])
    joined = pieces.join(chosen, pieces.conv.eqNullSafe(F.col("c")) & (pieces.part == F.col("p"))
                         & (pieces.piece == F.col("q")))
    totals = [f"all_{x}" for x in (*COUNTS, "gaps", "cost")]
    taken = joined.select("conv", "part", "piece", "entry", F.element_at("scripts", F.col("take") + 1).alias("script"),
                          *totals, F.posexplode_outer("lines").alias("pos", "line"))
    rows = taken.select("conv", "part", "piece", "pos", "entry", *totals, "line.role", "line.text",
                        F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("script")).alias("script"))
    kind = pieces.schema["conv"].dataType.simpleString()
    fields = f"conv {kind}, gaps long, {', '.join(c + ' long' for c in COUNTS)}, cost long, audit string, digest string"
    schema = pieces.sparkSession.createDataFrame([], fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        shape, now = to_arrow_schema(schema), None

        def put(lines: list[str]) -> None:
            for line in lines:
                now["hash"].update(utf8("\n" * now["some"] + line))
                now["some"] = True

        def closed() -> pa.RecordBatch:
            put(now["writer"].inserts())
            row = now["base"] | {"audit": "".join(now["scripts"]), "digest": now["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=shape)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["conv"] != row["conv"]:
                    if now is not None:
                        yield closed()
                    base = {"conv": row["conv"]} | {x.removeprefix("all_"): row[x] for x in totals}
                    now = {"conv": row["conv"], "base": base, "scripts": [], "hash": hashlib.sha256(), "some": False,
                           "writer": Rewriter("", 0)}
                if row["script"] is not None:
                    put(now["writer"].inserts())
                    now["scripts"].append(row["script"])
                    now["writer"] = Rewriter(row["script"], row["entry"])
                if row["role"] is not None:
                    put(now["writer"].row(row["role"], row["text"]))
        if now is not None:
            yield closed()

    return rows.repartition("conv").sortWithinPartitions("conv", "part", "piece", "pos").mapInArrow(run, schema)


def repair(rows: DataFrame, key: str = "conv_id", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Per conversation: fault counts, the cheapest repair's cost and script, digest of the repaired text.

    ``rows`` has ``conv, turn, role, text`` and ``gone`` (rows that are not read but whose conversation
    is still listed). Rows stand by turn, nulls first; rows of one turn by role, then by the md5 of the
    text, so equal rows stand next to each other. A conversation without rows has zeros, an empty script
    and the digest of nothing; a null conversation id is a conversation; an empty table gives an empty
    one; other columns are not read."""
    faults = with_faults(rows)
    pieces = saved(pieces_of(faults, piece_rows))
    whole = pieces.where("whole").select(
        "conv", F.when(F.col("turns") > 0, F.col("turn_hi") - F.col("turn_lo") + 1 - F.col("turns"))
        .otherwise(F.lit(0).cast("long")).alias("gaps"), *COUNTS, F.element_at("costs", 1).alias("cost"),
        F.element_at("scripts", 1).alias("audit"), "digest")
    cut = pieces.where("not whole")
    both = whole.unionByName(streamed(cut, saved(composed(cut))))
    return both.select(F.col("conv").alias(key), "gaps", *COUNTS, "cost", "audit", F.col("digest").alias("repaired_sha256"))
