"""Repair of the turn structure of conversations by iterative-deepening A*.

A conversation's rows are edited until their roles read (system)? (user assistant)+, or
nothing is left: a row is kept, deleted or given another role, and empty rows are inserted.
Depth-first search tries the edits in ASCII order of their initials, D, I, K, R, below a
bound on the cost that rises to the least cost by which the search went over it. What a
place in the rows and a state of the roles have been found to cost at least stays in a
transposition table: a visit with less left has failed before. The first accepting path
below the final bound is the answer, so of the cheapest ones it is the ASCII-least.

Long conversations are searched by blocks from the end, from every state at the start of a
block, so that the bound rises by what one block adds and not by what all rows add up to.

The search reads a character per row. These are put together by ranges of rows, so that no
task holds a large conversation but as such a string, which is as long as the audit it
gets. Texts are read once, in order, when the repaired rows are written or hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import spread_left_join, stored

#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows of a block.
BLOCK = 32
#: Rows of a stream that are worked on together.
ROWS = 512

# States of the roles so far: nothing, system, user, assistant. Each wants one role next,
# but for a system row at the start.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_WANTED = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = ("", "system", "user", "assistant")
_FINAL = (_START, _ASSISTANT)
#: A row's character: its role's initial (others as x) by its first fault.
_INITIALS, _FAULTS = "xsua", ("", "blank", "duplicate", "truncated")
_FIRST = ord("A")


def _edit_table() -> list[list[list[tuple[int, int, str]]]]:
    """By a row's code and a state: (step, cost, initial) of the edits in ASCII order.

    A node is 4 * place + state. The last entry is for the place after all rows.
    """
    out = []
    for code in range(16):
        role, fault = code >> 2, code & 3
        more = TRUNCATED if fault == 3 else 0
        by_state = []
        for state, wanted in enumerate(_WANTED):
            edits = [(4, DELETE, "D"), (wanted - state, INSERT, "I")]
            if fault in (0, 3):
                if role == wanted or (role == _SYSTEM and state == _START):
                    edits.append((4 + role - state, more, "K"))
                if role != wanted:
                    edits.append((4 + wanted - state, REROLE + more, "R"))
            by_state.append(edits)
        out.append(by_state)
    out.append([[(wanted - state, INSERT, "I")] for state, wanted in enumerate(_WANTED)])
    return out


_EDITS = _edit_table()
_AFTER = len(_EDITS) - 1


class Search:
    """Cheapest edits of a conversation, given as a string with a character per row."""

    def __init__(self, rows: str, block: int = BLOCK):
        self.codes = [ord(c) - _FIRST for c in rows] + [_AFTER]
        self.block = block
        n = len(rows)
        self.end = 4 * n
        # Faulty rows cost something whatever is done: a bound to start from.
        forced = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            forced[i] = forced[i + 1] + (0, DELETE, DELETE, TRUNCATED)[self.codes[i] & 3]
        self.forced = forced
        self.least = [cost for cost in forced for _ in range(4)]
        #: Nodes whose least cost is reached: the bound on it is the cost itself.
        self.exact = bytearray(4 * n + 4)
        for state in _FINAL:
            self.exact[self.end + state] = 1
        self.visited = 0

    def _edits(self, node: int) -> list[tuple[int, int, str]]:
        return _EDITS[self.codes[node >> 2]][node & 3]

    def below(self, node: int, bound: int, whole: bool) -> str | None:
        """The first path from a node that costs at most `bound`, or None.

        Unless it is to be whole a path may end where the cost of the rest is known. A node
        that fails costs at least its cheapest edit and what has been learnt of its target.
        """
        least, exact, end = self.least, self.exact, self.end
        if least[node] > bound:
            return None
        path: list[str] = []
        stack = [(node, bound, iter(self._edits(node)))]
        while stack:
            at, left, edits = stack[-1]
            if exact[at] and (not whole or (at >= end and at - end in _FINAL)):
                return "".join(path)
            for step, cost, initial in edits:
                to, rest = at + step, left - cost
                if least[to] <= rest:
                    path.append(initial)
                    stack.append((to, rest, iter(self._edits(to))))
                    self.visited += 1
                    break
            else:
                least[at] = max(least[at], min(cost + least[at + step] for step, cost, _ in self._edits(at)))
                stack.pop()
                if path:
                    path.pop()
        return None

    def settle(self, node: int) -> int:
        """The cost of the cheapest path from a node, by raising the bound until one fits."""
        while not self.exact[node]:
            if self.below(node, self.least[node], False) is not None:
                self.exact[node] = 1
        return self.least[node]

    def run(self) -> tuple[int, str]:
        """Cost and edits of the first accepting path in ASCII order."""
        n = len(self.codes) - 1
        after = n
        for place in range((n - 1) // self.block * self.block, 0, -self.block):
            self._lift(place, after)
            for state in range(4):
                self.settle(4 * place + state)
            after = place
        self._lift(0, after)
        cost = self.settle(_START)
        return cost, self.below(_START, cost, True)

    def _lift(self, place: int, after: int) -> None:
        """Raises the bounds of a block's nodes by what is known of the blocks after it."""
        low = 4 * after
        more = min(self.least[low : low + 4]) - self.forced[after]
        self.least[4 * place : low] = [self.forced[i] + more for i in range(place, after) for _ in range(4)]


@lru_cache(maxsize=1 << 14)
def _short(rows: str) -> tuple[int, str]:
    return Search(rows).run()


def cheapest_edits(rows: str) -> tuple[int, str]:
    """Cost and audit of a conversation: initials of D(elete), I(nsert), K(eep), R(erole)."""
    return _short(rows) if len(rows) <= 4 * BLOCK else Search(rows).run()


def row_codes(initials: str, faults: list[str]) -> str:
    """The characters of rows, from their roles' initials and their faults ('' for none)."""
    return "".join(
        chr(_FIRST + 4 * max(_INITIALS.find(r), 0) + _FAULTS.index(f)) for r, f in zip(initials, faults, strict=True)
    )


def _illegal(codes: np.ndarray) -> int:
    """Adjacent rows whose roles do not follow one another."""
    role = codes >> 2
    one, two = role[:-1], role[1:]
    legal = ((two == _USER) & ((one == _SYSTEM) | (one == _ASSISTANT))) | ((one == _USER) & (two == _ASSISTANT))
    return int((~legal).sum())


# --- rows ---------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with the faults that a hash of `conv_id:turn` plants.

    Of twenty equal shares one loses the row, one its text, one its sentence ends; one
    repeats the row, one makes its role user. Nulls count as one space in the hash, as a
    role and as a text; conv_id and turn stay null.
    """

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("_kind")
    ).where("_kind <> 0")
    text = (
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_"),
    ).drop("_")


def _filled(rows: DataFrame) -> DataFrame:
    """The four columns of a conversation, null roles and texts as one space, with what
    orders rows of one turn: the role's initial and a digest of conversation, role and text."""
    names = ["conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]]
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    sizes = F.concat_ws(":", F.octet_length(conv), F.octet_length("role"), F.lit(""))
    return rows.select(names).withColumns(
        {
            "initial": F.substring("role", 1, 1),
            "content": F.unhex(F.sha2(F.concat(sizes, conv, F.col("role"), F.col("text")), 256)),
        }
    )


_ORDER = ["conv_id", "turn", "initial", "content"]


def _row_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, content, row, code) of filled rows, `code` telling role and fault.

    A row's first fault counts: blank, a repeat of an earlier row's role and text, truncated.
    """
    # White space at the end goes in one pass, however long it is.
    text = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5))
    narrow = rows.select(
        *_ORDER,
        (text == "").alias("blank"),
        (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow, _ = stored(narrow, "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("z"), "turn", "row")
    repeats = narrow.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min(place)["row"].alias("first"))
    repeats, _ = stored(repeats.where("n > 1"), "repair-repeats")
    joined = spread_left_join(narrow, repeats, ["content"], ["row"])
    fault = F.when(F.col("blank"), 1).when(F.col("first") != F.col("row"), 2).when(F.col("truncated"), 3).otherwise(0)
    role = F.lit(0)
    for number, initial in enumerate(_INITIALS):
        role = F.when(F.col("initial") == initial, number).otherwise(role)
    return joined.select(*_ORDER, "row", (F.when(F.col("initial") == "x", 0).otherwise(role) * 4 + fault).alias("code"))


def _runs(column: pa.Array) -> list[int]:
    """Where runs of equal values start, and the end."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, part, codes): the characters of each conversation's rows, a string for each
    range of rows that holds some of them. `part` orders them."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, open_ = TaskContext.get().partitionId(), None, []

        def out(ids, texts):
            parts = pa.array([part] * len(texts), pa.int32())
            return pa.RecordBatch.from_arrays([ids, parts, pa.array(texts, pa.string())], ["conv_id", "part", "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("conv_id")
            data = (batch.column("code").to_numpy() + _FIRST).astype(np.uint8).tobytes().decode("ascii")
            bounds = _runs(column)
            texts = [data[a:b] for a, b in zip(bounds, bounds[1:])]
            if conv is not None:
                if conv == column.slice(0, 1):
                    texts[0] = "".join([*open_, texts[0]]) if len(texts) > 1 else texts[0]
                else:
                    yield out(conv, ["".join(open_)])
                    open_ = []
            if len(texts) > 1:
                yield out(column.take(pa.array(bounds[:-2])), texts[:-1])
                open_ = []
            conv = column.slice(len(column) - 1)
            open_.append(texts[-1])
        if conv is not None:
            yield out(conv, ["".join(open_)])

    dealt = rows.select(*_ORDER, "row", "code").repartitionByRange(*_ORDER, "row").sortWithinPartitions(*_ORDER, "row")
    return dealt.mapInArrow(strings, f"conv_id {kind}, part int, codes string")


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    `ids` names conversations (conv_id) that are reported even if they have no row.
    """
    return _audits(_filled(rows), ids)


def _audits(filled: DataFrame, ids: DataFrame | None) -> DataFrame:
    kind = filled.schema["conv_id"].dataType.simpleString()
    faults = _row_faults(filled)
    segments, _ = stored(_segments(faults), "repair-codes")
    turns = filled.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id")
    turns = turns.agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("turns"))
    every = segments.unionByName(turns, allowMissingColumns=True)
    if ids is not None:
        every = every.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    # A conversation has a string for each range of rows it lies in.
    strings = F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "codes"))))
    gaps = F.max("high") - F.min("low") + 1 - F.max("turns")
    whole = every.groupBy("conv_id").agg(
        F.array_join(F.transform(strings, lambda s: s["codes"]), "").alias("codes"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(5)]
            found = []
            for text in batch.column("codes").to_pylist():
                codes = np.frombuffer(text.encode("ascii"), np.uint8) - _FIRST
                by_fault = np.bincount(codes & 3, minlength=4)
                cost, audit = cheapest_edits(text)
                found.append(audit)
                for out, value in zip(counts, [*by_fault[1:].tolist(), _illegal(codes), cost]):
                    out.append(value)
            columns = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("gaps"), *columns, pa.array(found, pa.string())],
                ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
            )

    numbers = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    found, _ = stored(whole.mapInArrow(search, f"conv_id {kind}, {numbers}, audit string"), "repair-audits")
    return found


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _in_order(filled: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order and in one task.

    They are streamed there, not gathered: what is done with them goes row by row.
    """
    rows = filled.withColumn("is_row", F.lit(True))
    first = found.withColumn("is_row", F.lit(False))
    every = first.unionByName(rows, allowMissingColumns=True)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "initial", "content")


class _Writer:
    """Follows a conversation's audit along its rows and passes on what the edits leave."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _WANTED[self.state]
            yield "I", _ROLES[self.state], ""

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _INITIALS.find(role[:1])
            yield "K", role, text
        elif edit == "R":
            self.state = _WANTED[self.state]
            yield "R", _ROLES[self.state], text

    def end(self):
        yield from self._inserted()


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: how it is repaired, and a digest of the result.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of `role:text` of the repaired rows, joined by newlines). Faults and
    edits are those of `repair`; `ids` is as in `audits`. A conversation that has no rows
    has zeros, no edits and the digest of nothing. An empty table gives an empty result.
    """
    filled = _filled(rows)
    found = _audits(filled, ids)
    kind = found.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, sha, head, first = None, None, None, True

        def add(parts):
            nonlocal first
            for _, role, text in parts:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False

        def done(ended):
            texts = pa.array([s for _, s in ended], pa.string())
            heads = pa.concat_tables([pa.Table.from_batches([h]) for h, _ in ended]).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*heads.columns, texts], ["conv_id", *_REPORT, "repaired_sha256"])

        ended = []
        for batch in _pieces(batches):
            heads = batch.select(["conv_id", *_REPORT])
            columns = (batch.column(c).to_pylist() for c in ("is_row", "audit", "role", "text"))
            for k, (is_row, audit, role, text) in enumerate(zip(*columns)):
                if is_row:
                    add(writer.row(role, text))
                    continue
                if writer is not None:
                    add(writer.end())
                    ended.append((head, sha.hexdigest()))
                writer, sha, head, first = _Writer(audit), hashlib.sha256(), heads.slice(k, 1), True
            if ended:
                yield done(ended)
                ended = []
        if writer is not None:
            add(writer.end())
            yield done([(head, sha.hexdigest())])

    numbers = ", ".join(f"{c} long" for c in _REPORT[:-1])
    schema = f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string"
    ordered = _in_order(filled, found).select("conv_id", *_REPORT, "is_row", "role", "text")
    return ordered.mapInArrow(digest, schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows of conversations: conv_id, place (from 0), edit, turn, role, text.

    Rows (conv_id, turn, role, text) count in the order of their turns, null first; those of
    one turn by their role's initial and a digest, so that repeats stand together. A row is
    blank without any character but white space, a duplicate when an earlier row of its
    conversation has its role and text, truncated when its last character that is not white
    space is none of `.!?`; blank rows and duplicates go. A role counts by its initial.
    Edits are the cheapest ones, of those the ASCII-least in order. `edit` tells what became
    of the row: K(ept), R(eroled) or I(nserted), whose turn is null. A null role or text
    counts as one space; an empty role can't be kept. A null conv_id is a conversation of
    its own; other columns are not read. An empty table gives an empty result.
    """
    filled = _filled(rows)
    found = _audits(filled, None)
    kinds = {c: filled.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, conv, place = None, None, 0
        for batch in _pieces(batches):
            out: list[tuple] = []
            ids, turns = [], []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "is_row", "audit", "turn", "role", "text"))

            def add(parts, turn):
                nonlocal place
                for edit, role, text in parts:
                    ids.append(conv), turns.append(None if edit == "I" else turn)
                    out.append((place, edit, role, text))
                    place += 1

            for conv_id, is_row, audit, turn, role, text in zip(*columns):
                if is_row:
                    add(writer.row(role, text), turn)
                    continue
                if writer is not None:
                    add(writer.end(), None)
                writer, conv, place = _Writer(audit), conv_id, 0
            yield _batch(batch, ids, turns, out)
        if writer is not None:
            ids, turns, out = [], [], []
            add(writer.end(), None)
            yield _batch(batch, ids, turns, out)

    schema = f"conv_id {kinds['conv_id']}, place long, edit string, turn {kinds['turn']}, role string, text string"
    return _in_order(filled, found).select("conv_id", "is_row", "audit", "turn", "role", "text").mapInArrow(write, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, as they become Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _batch(like: pa.RecordBatch, ids: list, turns: list, out: list[tuple]) -> pa.RecordBatch:
    place, edit, role, text = zip(*out) if out else ((), (), (), ())
    columns = [
        pa.array(ids, like.schema.field("conv_id").type),
        pa.array(place, pa.int64()),
        pa.array(edit, pa.string()),
        pa.array(turns, like.schema.field("turn").type),
        pa.array(role, pa.string()),
        pa.array(text, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "edit", "turn", "role", "text"])
