"""Conversation structure repair by weighted interval parsing.

A conversation is sound when its role initials read ``(s?(ua)+)?``. The repair grammar is in Chomsky normal form: a nonterminal X[p, q]
stands for edits that lead the role order from state p to state q; X[p, q] -> X[p, r] X[r, q] joins two neighbouring spans, and
X[p, q] -> row is one edited row. A cell holds the cheapest (cost, audit) of every nonterminal over one span of rows, closed under
insertions before and after each row. Spans are combined bottom-up by their length. Because the nonterminals are pairs of states, every
split of a span gives the same cell, so one split per span is enough, and cells of stretches that lie in different tasks combine in the same way.

Two audits of one span with equal cost never have one another as a proper prefix (what follows could only be insertions, which cost), so
the ASCII-least audit of a whole is made of the ASCII-least audits of its parts.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat.llm.folders import written

NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # the role that came last
AFTER = {NOTHING: (NOTHING, SYSTEM, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}
SOUND = (NOTHING, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last is added for a truncated row that stays
LEGAL = ("su", "ua", "au")
ROWS_PER_SLICE = 500_000

Cell = dict[tuple[int, int], tuple[int, str]]


def turn_of(state: int) -> int:
    """The role that may be written next."""
    return ASSISTANT if state == USER else USER


def _better(cell: Cell, key: tuple[int, int], found: tuple[int, str]) -> None:
    if key not in cell or found < cell[key]:
        cell[key] = found


def joined(left: Cell, right: Cell) -> Cell:
    """Cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in AFTER[r]:
            more = right.get((r, q))
            if more:
                _better(out, (p, q), (cost + more[0], audit + more[1]))
    return out


def _insertions() -> Cell:
    """Cell of the empty span: the fewest insertions between two states."""
    cell: Cell = {(p, p): (0, "") for p in AFTER}
    for p in AFTER:
        state, count = p, 0
        while (p, turn_of(state)) not in cell or count == 0:
            state, count = turn_of(state), count + 1
            _better(cell, (p, state), (INSERT * count, "I" * count))
    return cell


EMPTY = _insertions()


def row_cell(initial: str, truncated: bool) -> Cell:
    """Cell of a row that may stay."""
    more = TRUNCATED if truncated else 0
    cell: Cell = {(p, p): (DELETE, "D") for p in AFTER}
    for p in AFTER:
        _better(cell, (p, turn_of(p)), (REROLE + more, "R"))
        if initial == "s" and p == NOTHING:
            _better(cell, (p, SYSTEM), (KEEP + more, "K"))
        elif initial == "ua"[turn_of(p) - USER]:
            _better(cell, (p, turn_of(p)), (KEEP + more, "K"))
    return joined(joined(EMPTY, cell), EMPTY)


_ROWS = {(i, t): row_cell(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


def deleted_cell(rows: int) -> Cell:
    """Cell of rows that must go."""
    return joined(EMPTY, joined({(p, p): (DELETE * rows, "D" * rows) for p in AFTER}, EMPTY))


def span_cell(cells: list[Cell]) -> Cell:
    """Cell of a stretch from the cells of its rows, spans of length 1, 2, 4, ... bottom-up."""
    while len(cells) > 1:
        whole = [joined(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = whole + cells[len(cells) - len(cells) % 2 :]
    return cells[0] if cells else EMPTY


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[NOTHING, q] for q in SOUND if (NOTHING, q) in cell)


class Piece:
    """A stretch of one conversation: counts, first and last row, and the cells of its rows."""

    def __init__(self) -> None:
        self.first_turn = self.last_turn = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.cells: list[Cell] = []

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, later: bool, times: int) -> None:
        """``times`` equal rows; all but the first repeat it, and the first repeats an earlier one if ``later``."""
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += times - 1
        self.last = initial
        if blank:
            self.blank += times
            self.cells.append(deleted_cell(times))
            return
        repeats = times if later else times - 1
        if not later:
            self.truncated += truncated
            self.cells.append(_ROWS[initial if initial in ("s", "u", "a") else "", truncated])
        if repeats:
            self.duplicate += repeats
            self.cells.append(deleted_cell(repeats))

    def append(self, other: Piece) -> None:
        """The stretch right after this one."""
        if other.first_turn is not None:
            self.turns += other.turns - (other.first_turn == self.last_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        self.illegal += other.illegal + (self.last + other.first not in LEGAL if self.first is not None else 0)
        self.first = other.first if self.first is None else self.first
        self.last = other.last
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        self.cells += other.cells

    def report(self) -> dict:
        cost, audit = cheapest(span_cell(self.cells))
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_PART = "first_turn bigint, last_turn bigint, turns bigint, first string, last string, cell array<struct<p: int, q: int, cost: bigint, audit: string>>"
_REPORT_FIELDS = [f.split()[0] for f in _REPORT.split(", ")]
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _flat(piece: Piece, whole: bool) -> dict:
    if whole:
        return piece.report()
    cell = [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in span_cell(piece.cells).items()]
    part = {name: getattr(piece, name) for name in ("first_turn", "last_turn", "turns", "first", "last", *_COUNTS)}
    return part | {"cell": cell}


def _piece(row: dict) -> Piece:
    piece = Piece()
    for name in ("first_turn", "last_turn", "turns", "first", "last", *_COUNTS):
        setattr(piece, name, row[name])
    piece.cells = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in row["cell"]}]
    return piece


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The four columns under fixed names; a null role or text is one space; ``digest`` tells texts apart."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), space).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), space).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


_ORDER = ("turn", "role", "digest")  # rows of one turn by role and digest; nulls first


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows counted, with their faults: blank, truncated, and later (role and text stand in an earlier turn)."""
    blank: Column = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    ended: Column = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    narrow = rows.select("conv", *_ORDER, blank.alias("blank"), (~ended).alias("truncated"))
    counted = written(narrow.groupBy("conv", *_ORDER, "blank", "truncated").agg(F.count(F.lit(1)).alias("times")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = counted.groupBy("conv", "role", "digest").agg(F.min(at).alias("first")).toDF("_conv", "_role", "_digest", "first")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return counted.join(firsts, same).select("conv", *_ORDER, F.left("role", F.lit(1)).alias("initial"), "blank", "truncated", (at > F.col("first")).alias("later"), "times")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations of a sorted slice; its first and last one may go on in the slices beside it and come out as cells."""
    place = TaskContext.get().partitionId()
    current: object = _pieces  # no conversation yet
    piece, number, out = Piece(), -1, []

    def row(whole: bool) -> dict:
        return {"conv": current, "slice": place, "whole": whole, **_flat(piece, whole)}

    for batch in batches:
        for conv, turn, initial, blank, truncated, later, times in zip(*[c.to_pylist() for c in batch.columns]):
            if conv != current or number < 0:
                if number >= 0:
                    out.append(row(whole=number > 0))
                current, piece, number = conv, Piece(), number + 1
            piece.add(turn, initial, blank, truncated, later, times)
        yield _batch(out, batch.schema.field(0).type)
        out = []
    if number >= 0:
        yield _batch([row(whole=False)], batch.schema.field(0).type)


_KINDS = {"bigint": pa.int64(), "string": pa.string()}
_CELL = pa.list_(pa.struct({"p": pa.int32(), "q": pa.int32(), "cost": pa.int64(), "audit": pa.string()}))


def _batch(rows: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv": conv_type, "slice": pa.int64(), "whole": pa.bool_()}
    for field in (_REPORT + ", " + _PART.split(", cell")[0]).split(", "):
        kinds[field.split()[0]] = _KINDS[field.split()[1]]
    kinds["cell"] = _CELL
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()], names=list(kinds))


def _combined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Report of a conversation from its pieces."""
    whole = Piece()
    for row in sorted(table.to_pylist(), key=lambda r: r["slice"]):
        whole.append(_piece(row))
    report = whole.report()
    values = {"conv": pa.array([key[0].as_py()], table.schema.field("conv").type)}
    return pa.table(values | {n: pa.array([report[n]], _KINDS["string" if n == "audit" else "bigint"]) for n in _REPORT_FIELDS})


def repair_reports(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first, and within a turn by role and a digest of the text. A null role or text is one space; a null
    conversation id is a conversation like any other; repeated rows are duplicates; other columns are ignored; the empty table gives an empty result.
    gaps: turn numbers missing between the smallest and the largest. blank, duplicate, truncated: rows by their first fault. illegal:
    neighbours whose role initials are not su, ua or au. cost and audit: the cheapest repair, K(eep) 0, R(erole) 1, D(elete) 2, I(nsert) 5,
    and 5 for a truncated row that stays; of equally cheap ones the ASCII-least audit.

    Only flags are shuffled, equal rows as one. Slices are ranges of (conversation, turn), so a long conversation spreads over many
    tasks; a task holds the cells of one stretch, and a conversation over several slices is joined from one cell per slice.
    """
    rows = written(_faults(_named(turns, conv_col, turn_col, role_col, text_col)), "faults")
    slices = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_SLICE))
    ranged = rows.repartitionByRange(slices, "conv", *_ORDER).sortWithinPartitions("conv", *_ORDER)
    kind = rows.schema["conv"].dataType.simpleString()
    columns = ranged.select("conv", "turn", "initial", "blank", "truncated", "later", "times")
    pieces = written(columns.mapInArrow(_pieces, f"conv {kind}, slice bigint, whole boolean, {_REPORT}, {_PART}"), "pieces")
    parts = pieces.filter("NOT whole").groupBy("conv").applyInArrow(_combined, f"conv {kind}, {_REPORT}")
    return pieces.filter("whole").select("conv", *_REPORT_FIELDS).unionByName(parts)


_NAMES = {USER: "user", ASSISTANT: "assistant"}


class Writer:
    """Follows the audit of one conversation and gives the rows of the repaired one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = turn_of(self.state), self.at + 1
            yield _NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else turn_of(self.state)
        yield (role if edit == "K" else _NAMES[self.state]), text


def _followed(turns: DataFrame, reports: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All rows of a conversation in order, its audit before them, in one sorted partition."""
    rows = _named(turns, **columns)
    heads = reports.select("conv", "audit")
    both = rows.withColumn("audit", F.lit(None).cast("string")).unionByName(heads, allowMissingColumns=True)
    ordered = both.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *_ORDER)
    return ordered.select("conv", "audit", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Writer | None, Iterator[tuple[str, str]]]]:
    """For every input row its conversation, the writer of a conversation that begins, and the repaired rows it gives."""
    writer, current = None, None
    for batch in batches:
        for conv, audit, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if audit is not None:
                if writer is not None:
                    yield current, None, writer.inserted()
                writer, current = Writer(audit), conv
                yield conv, writer, iter(())
            else:
                yield conv, None, writer.row(role, text)
    if writer is not None:
        yield current, None, writer.inserted()


def _columns(given: dict[str, str]) -> dict[str, str]:
    return {"conv_col": "conv_id", "turn_col": "turn", "role_col": "role", "text_col": "text"} | given


def repaired_turns(turns: DataFrame, reports: DataFrame, **columns: str) -> DataFrame:
    """Rows (conv, place, role, text) of the repaired conversations, place counted from 0; streams, holds no conversation."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, place = None, [], 0

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def flush() -> pa.RecordBatch:
            convs, places, roles, texts = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["conv", "place", "role", "text"])

        for conv, begun, rows in _conversations(seen()):
            place = 0 if begun else place
            for role, text in rows:
                out.append((conv, place, role, text))
                place += 1
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    followed_rows = _followed(turns, reports, _columns(columns))
    return followed_rows.mapInArrow(followed, f"conv {followed_rows.schema['conv'].dataType.simpleString()}, place bigint, role string, text string")


def repaired_digests(turns: DataFrame, reports: DataFrame, **columns: str) -> DataFrame:
    """(conv, repaired_sha256): hash of the repaired rows ``role:text``, joined by newlines; a conversation streams through one hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, current, state, empty = None, [], None, None, True

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out], pa.string())], names=["conv", "repaired_sha256"])

        for conv, begun, rows in _conversations(seen()):
            if begun:
                if state is not None:
                    out.append((current, state.hexdigest()))
                current, state, empty = conv, hashlib.sha256(), True
            for role, text in rows:
                state.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
            if len(out) >= 10_000:
                yield flush()
                out = []
        if state is not None:
            out.append((current, state.hexdigest()))
        if out:
            yield flush()

    rows = _followed(turns, reports, _columns(columns))
    return rows.mapInArrow(hashed, f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string")
