"""Repair of conversation structure by a dynamic program over grammar-compressed sequences.

Every turn is one symbol: its role and fault.  The cheapest edit of a sequence
of symbols into the allowed order of roles is a path through four states (at
the start, after system, after user, after assistant), so a run of symbols is
a 4 x 4 matrix of (cost, edits) under addition of costs and the minimum, ties
to the least edits.  Of two equally cheap edits of the same run between the
same states, neither is the beginning of the other (it would lack insertions
only, and so cost less), hence least edits of two runs make the least edits of
both together, and matrices can be multiplied in any grouping.

Re-Pair finds pairs of symbols that occur often, in all distinct sequences, and
gives each a symbol of its own, again and again.  A symbol's matrix is the
product of the two it stands for, and is computed once for the whole table;
its edits are a rope that shares the ropes of its parts.

A conversation is cut into blocks of bounded rows and bytes after a range sort
by (conversation, turn), so a long one spreads over tasks.  Blocks of a
conversation that is whole inside one task end there; the others are
multiplied along the conversation by their matrices alone, and their texts
follow with the states already known.  Grammar and matrices are bounded by the
number of rules, whatever the number of conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import partitions, prepare, stored, table

DAMAGE_MODULUS = 20
RULE_ROUNDS = 6
RULES_PER_ROUND = 32
BLOCK_ROWS = 4096
BLOCK_BYTES = 2 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
ROLES = ("user", "assistant")

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_OTHER = 3
# Symbols: 1 must go; then two for each of system, user, assistant, other: whole and truncated.  0 parts sequences.
_GONE, _FIRST, _TERMINALS = 1, 2, 10
_INITIALS = "sua"


class Rope:
    """Edits as a tree of shared parts; ``size`` letters."""

    __slots__ = ("left", "right", "leaf", "size")

    def __init__(self, leaf: str = "", left: Rope | None = None, right: Rope | None = None):
        self.leaf, self.left, self.right = leaf, left, right
        self.size = len(leaf) if left is None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not self.size:
            return other
        return self if not other.size else Rope(left=self, right=other)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            rope = todo.pop()
            if rope.left is None:
                out.append(rope.leaf)
            else:
                todo += [rope.right, rope.left]
        return "".join(out)

    def less(self, other: Rope) -> bool:
        """Whether these edits come first; equal parts that both share are passed over unread."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y:
                continue
            if x.left is not None and (y.left is None or x.size >= y.size):
                a += [x.right, x.left]
                b.append(y)
            elif y.left is not None:
                b += [y.right, y.left]
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.leaf[:n] != y.leaf[:n]:
                    return x.leaf[:n] < y.leaf[:n]
                if x.size > n:
                    a.append(Rope(x.leaf[n:]))
                if y.size > n:
                    b.append(Rope(y.leaf[n:]))
        return bool(b)


def _better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> bool:
    return a is None or b[0] < a[0] or (b[0] == a[0] and b[1].less(a[1]))


def times(x: list, y: list) -> list:
    """Product of two matrices, or of a row of states and a matrix, under (min, +); ``None`` is no way."""
    out = []
    for row in x:
        made: list = [None] * 4
        for k, a in enumerate(row):
            if a is None:
                continue
            for j, b in enumerate(y[k]):
                if b is not None:
                    c = (a[0] + b[0], a[1] + b[1])
                    if _better(made[j], c):
                        made[j] = c
        out.append(made)
    return out


def _inserted() -> list:
    """Fewest insertions between states: user and assistant in turn, nothing before system."""
    follows = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
    out: list = [[None] * 4 for _ in _STATES]
    for i in _STATES:
        at, n = i, 0
        while out[i][at] is None:
            out[i][at] = (INSERT * n, Rope("I" * n))
            at, n = follows[at], n + 1
    return out


def _edited(symbol: int) -> list:
    """Keep, change the role of, or delete one turn."""
    out: list = [[None] * 4 for _ in _STATES]

    def add(i, j, cost, edit):
        if _better(out[i][j], (cost, edit)):
            out[i][j] = (cost, edit)

    for i in _STATES:
        add(i, i, DELETE, Rope("D"))
    if symbol != _GONE:
        role, cut = divmod(symbol - _FIRST, 2)
        more = TRUNCATED * cut
        if role == 0:
            add(_START, _SYSTEM, KEEP + more, Rope("K"))
        for i, j, own in ((_START, _USER, 1), (_SYSTEM, _USER, 1), (_ASSISTANT, _USER, 1), (_USER, _ASSISTANT, 2)):
            add(i, j, REROLE + more, Rope("R"))
            if role == own:
                add(i, j, KEEP + more, Rope("K"))
    return out


CLOSE = _inserted()
TERMINALS = [None, *(times(CLOSE, _edited(s)) for s in range(1, _TERMINALS))]


class Grammar:
    """Rounds of rules: in each, disjoint pairs (a, b) become new symbols."""

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.size = _TERMINALS

    def add(self, pairs: list[tuple[int, int]]) -> None:
        self.rounds.append({p: self.size + i for i, p in enumerate(pairs)})
        self.size += len(pairs)

    def matrices(self) -> list:
        """One matrix per symbol, from the bottom up."""
        out = list(TERMINALS)
        for rules in self.rounds:
            out += [times(out[a], out[b]) for a, b in rules]
        return out

    def rewrite(self, s: np.ndarray) -> np.ndarray:
        """Apply all rules to sequences parted by zeros, each round in one pass, left to right."""
        for rules in self.rounds:
            if len(s) < 2:
                break
            made = np.zeros((self.size, self.size), np.int32)
            for (a, b), x in rules.items():
                made[a, b] = x
            to = made[s[:-1], s[1:]]
            hit = np.flatnonzero(to)
            hit = hit[_alternate(hit, s[hit] == s[hit + 1])]
            s = s.copy()
            s[hit] = to[hit]
            left = np.ones(len(s), bool)
            left[hit + 1] = False
            s = s[left]
        return s


def _alternate(at: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of the places where a pair stands, those that do not overlap: in a run of one symbol every second."""
    if not len(at):
        return np.zeros(0, bool)
    head = np.ones(len(at), bool)
    head[1:] = (np.diff(at) > 1) | ~same[1:] | ~same[:-1]
    run = np.flatnonzero(head)
    return (np.arange(len(at)) - run[np.cumsum(head) - 1]) % 2 == 0


def _joined(col: pa.Array) -> np.ndarray:
    """The sequences of a binary column, one after the other, parted by zeros."""
    buf, off = tk.text_buffer(col)
    out = np.zeros(len(buf) + len(col), np.int64)
    out[np.arange(len(buf)) + np.repeat(np.arange(len(col)), np.diff(off))] = buf
    return out


def _count(grammar: Grammar):
    """How often each pair of symbols occurs in a task's sequences, without overlaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grammar.size * grammar.size, np.int64)
        for batch in batches:
            s = grammar.rewrite(_joined(batch.column(0)))
            at = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0))
            at = at[_alternate(at, s[at] == s[at + 1])] if len(at) else at
            total += np.bincount(s[at] * grammar.size + s[at + 1], minlength=len(total)) if len(at) else 0
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])
    return run


def re_pair(sequences: DataFrame, col: str, rounds: int = RULE_ROUNDS, per_round: int = RULES_PER_ROUND) -> Grammar:
    """Rules from the most frequent pairs of all distinct sequences, several disjoint ones a round.

    Rules only shorten the work on sequences; results do not depend on them.
    What comes to the driver is bounded by the number of symbols squared.
    """
    own = stored(sequences.select(F.col(col).alias("s")).distinct())
    grammar = Grammar()
    for _ in range(rounds):
        found = own.mapInArrow(_count(grammar), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        taken: set[int] = set()
        rules = []
        for pair, _n in found.where("n > 1").orderBy(F.desc("n"), "pair").limit(16 * per_round).collect():
            ab = divmod(pair, grammar.size)
            if len(rules) < per_round and not taken & set(ab):
                rules.append(ab)
                taken |= set(ab)
        if not rules:
            break
        grammar.add(rules)
    return grammar


_BLANKS = " \t\n\x0b\x0c\r"
_NUMBERS = ("blank", "duplicate", "truncated", "illegal")
_COUNTS = [("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), *((k, pa.int64()) for k in _NUMBERS),
           ("head", pa.string()), ("tail", pa.string())]
_PLACE = [("task", pa.int64()), ("block", pa.int64())]
_LINES = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_BLOCK = [*_PLACE, ("edge", pa.bool_()), ("symbols", pa.binary()), *_LINES, *_COUNTS]
_PIECE = [*_PLACE, ("whole", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), *_LINES, *_COUNTS]
_PATH = [*_PLACE, ("start", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]
_RESULT = [("gaps", pa.int64()), *((k, pa.int64()) for k in (*_NUMBERS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string",
          pa.list_(pa.string()): "array<string>"}


def _ddl(conv: str, fields: list) -> str:
    return ", ".join([f"conv {conv}", *(f"{n} {_SPARK[t]}" for n, t in fields)])


def _batch(rows: list[tuple], conv: pa.DataType, fields: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [("conv", conv), *fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])


def _written(rows: Iterator[tuple[tuple, int]], conv: pa.DataType, fields: list, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of (row, size) items, each of bounded size."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 100
        if size > limit:
            yield _batch(held, conv, fields)
            held, size = [], 0
    if held:
        yield _batch(held, conv, fields)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _typed(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """``make(batches, type of the first column)``; nothing where there is no batch."""
    first = next(batches, None)
    if first is None:
        return
    yield from make(chain([first], batches), first.schema.field(0).type)


def _faults(rows: DataFrame) -> DataFrame:
    """Rows of equal (conv, turn, role, text) with their number ``n``, and whether each text came before, is blank or cut off.

    A marker (null role) stands for a conversation of which nothing may be left.
    """
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    again = rows.where("role is not null").groupBy("conv", "role", "text").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"), F.count("*").alias("k")).where("k > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "least", "unplaced")
    joined = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    later = F.when(F.col("unplaced"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    return joined.select("conv", "turn", "role", "text", "n", F.coalesce(later, F.lit(False)).alias("later"),
                         (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


class _Block:
    """Consecutive rows of one conversation: their symbols, what is left to write of them, and counts."""

    def __init__(self, conv, number: int):
        self.conv, self.number, self.bytes = conv, number, 0
        self.symbols, self.roles, self.texts = bytearray(), [], []
        self.low = self.high = self.head = self.tail = None
        self.turns, self.counts = 0, dict.fromkeys(_NUMBERS, 0)

    def add(self, turn, role: str, text: str, later: bool, blank: bool, cut: bool, copies: int) -> None:
        """One row, or further ``copies`` of a row that came before."""
        if later or blank:
            self.symbols += bytes([_GONE]) * copies
            self.counts["blank" if blank else "duplicate"] += copies
        else:
            at = _INITIALS.find(role[0]) if role else -1
            self.symbols.append(_FIRST + 2 * (at if at >= 0 else _OTHER) + cut)
            self.counts["truncated"] += cut
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
        initial = role[:1]
        self.counts["illegal"] += copies - 1 + (self.head is not None and (self.tail, initial) not in _LEGAL)
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, task: int, edge: bool) -> tuple[tuple, int]:
        return (self.conv, task, self.number, edge, bytes(self.symbols), self.roles, self.texts, self.low, self.high, self.turns,
                *self.counts.values(), self.head, self.tail), self.bytes + len(self.symbols)


def _cut(rows: Iterator[tuple], task: int, rows_limit: int, bytes_limit: int) -> Iterator[tuple[tuple, int]]:
    """Blocks of a sorted task; ``edge`` marks conversations that are cut or may go on in another task."""
    block, first, begun = None, True, 0
    for conv, turn, role, text, n, later, blank, cut in rows:
        if block is None or conv != block.conv:
            if block is not None:
                yield block.row(task, first or block.number > begun)
                first, begun = False, block.number + 1
            block = _Block(conv, begun)
        left = n if role is not None else 0
        while left:
            if len(block.symbols) >= rows_limit or (block.bytes and block.bytes + len(text) > bytes_limit):
                yield block.row(task, True)
                block = _Block(conv, block.number + 1)
            gone = later or blank or left < n  # every further copy of a row came before
            take = min(left, rows_limit - len(block.symbols)) if gone else 1
            block.add(turn, role, text, gone, blank, cut, take)
            left -= take
    if block is not None:
        yield block.row(task, True)


def _blocks(rows_limit: int, bytes_limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        yield from _typed(batches, lambda b, t: _written(_cut(_read(b), task, rows_limit, bytes_limit), t, _BLOCK))
    return run


def _lines(symbols: bytes, start: int, audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits; the state says which role a changed or new turn has."""
    state, at, next_, out = start, 0, 0, ([], [])
    for edit in audit:
        if edit == "D":
            next_ += symbols[at] != _GONE
            at += 1
            continue
        role = ROLES[state == _USER]
        text = ""
        if edit != "I":
            role = roles[next_] if edit == "K" else role
            text = texts[next_]
            next_ += 1
            at += 1
        state = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[role[0]]
        out[0].append(role)
        out[1].append(text)
    return out


class Solver:
    """Matrices of sequences under a grammar; equal sequences are solved once in a task."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.matrices, self.known = grammar, grammar.matrices(), {}

    def _along(self, symbols: bytes, begin: list) -> list:
        for s in self.grammar.rewrite(np.frombuffer(symbols, np.uint8).astype(np.int64)).tolist():
            begin = times(begin, self.matrices[s])
        return begin

    def whole(self, symbols: bytes) -> tuple[int, str]:
        """Cost and edits of a whole conversation."""
        if symbols not in self.known:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            (ends,) = times(self._along(symbols, [[(0, Rope()), None, None, None]]), CLOSE)
            best = ends[_START]
            if ends[_ASSISTANT] is not None and _better(best, ends[_ASSISTANT]):
                best = ends[_ASSISTANT]
            self.known[symbols] = best[0], best[1].text()
        return self.known[symbols]

    def matrix(self, symbols: bytes) -> list[list]:
        """Costs and edits between all states."""
        unit = [[(0, Rope()) if i == j else None for j in _STATES] for i in _STATES]
        return [[None if c is None else (c[0], c[1].text()) for c in row] for row in self._along(symbols, unit)]


def _whole(grammar: Grammar):
    """Repaired pieces of blocks that are whole conversations."""
    def rows(batches, solver):
        for conv, task, block, _, symbols, roles, texts, *counts in _read(batches):
            cost, audit = solver.whole(symbols)
            new = _lines(symbols, _START, audit, roles, texts)
            yield (conv, task, block, True, cost, audit, *new, *counts), sum(map(len, texts)) + 2 * len(audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _typed(batches, lambda b, t: _written(rows(b, Solver(grammar)), t, _PIECE))
    return run


class _Way:
    """The edits of the blocks so far, as a chain that ways share."""

    __slots__ = ("before", "place", "start", "audit")

    def __init__(self, before, place, start, audit):
        self.before, self.place, self.start, self.audit = before, place, start, audit

    def less(self, other: _Way) -> bool:
        a, b, x, y = self, other, [], []
        while a is not b:  # both have as many blocks
            x.append(a.audit)
            y.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(x)) < "".join(reversed(y))


def _better_way(a, b) -> bool:
    return a is None or b[0] < a[0] or (b[0] == a[0] and b[1].less(a[1]))


def _path(conv, ways: list) -> Iterator[tuple[tuple, int]]:
    """The cheapest way of a conversation, a row for each block."""
    best = None
    for i in _STATES:
        for j in (_START, _ASSISTANT):
            if ways[i] is not None and CLOSE[i][j] is not None:
                cost, more = CLOSE[i][j]
                w = ways[i][1]
                c = (ways[i][0] + cost, _Way(w.before, w.place, w.start, w.audit + more.text()))
                if _better_way(best, c):
                    best = c
    cost, w = best
    while w is not None:
        yield (conv, *w.place, w.start, cost, w.audit), len(w.audit)
        w = w.before


def _paths(grammar: Grammar):
    """For conversations of several blocks, sorted: where each block starts and its edits."""
    def rows(batches, solver):
        begun, ways, last = False, None, None
        for conv, task, block, symbols in _read(batches):
            if not begun or conv != last:
                if begun:
                    yield from _path(last, ways)
                begun, last, ways = True, conv, [(0, None), None, None, None]
            matrix = solver.matrix(symbols)
            new: list = [None] * 4
            for i in _STATES:
                for j in _STATES:
                    if ways[i] is not None and matrix[i][j] is not None:
                        cost, audit = matrix[i][j]
                        c = (ways[i][0] + cost, _Way(ways[i][1], (task, block), i, audit))
                        if _better_way(new[j], c):
                            new[j] = c
            ways = new
        if begun:
            yield from _path(last, ways)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _typed(batches, lambda b, t: _written(rows(b, Solver(grammar)), t, _PATH))
    return run


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of long conversations after the edits found for them."""
    def rows(batches):
        for conv, task, block, symbols, start, cost, audit, roles, texts, *counts in _read(batches):
            new = _lines(symbols, start, audit, roles, texts)
            yield (conv, task, block, False, cost, audit, *new, *counts), sum(map(len, texts)) + 2 * len(audit)

    yield from _typed(batches, lambda b, t: _written(rows(b), t, _PIECE))


def damage(conversations: DataFrame, modulus: int = DAMAGE_MODULUS) -> DataFrame:
    """The rows with a column ``copies``, damaged by ``crc32("conv_id:turn") % modulus``.

    0 drops a row (no copies), 1 empties its text, 2 takes ``.!?`` out of it,
    3 makes two copies, 4 sets the role to user.  Nulls count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % modulus
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies_col: str | None = None, rounds: int = RULE_ROUNDS, per_round: int = RULES_PER_ROUND,
           block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Repaired pieces of conversations: ``conv``, place (``task``, ``block``), ``whole``, ``cost`` of the conversation,
    ``audit`` (edits), repaired ``roles`` and ``texts``, and counts of faults before the repair.

    Rows are taken by turn, nulls first; rows of one turn by role and text.
    Null roles and texts are one space.  ``copies_col`` says how often a row
    occurs (0: not at all, but its conversation has a result).  A row is blank
    (only blanks), else a duplicate (role and text came before), else truncated
    (last character that is not blank is not ``.!?``), else whole.  Blank and
    duplicate rows are deleted.  Roles are compared by their first character;
    any but ``s``, ``u`` and ``a`` can only be changed or deleted.  Most
    conversations are one piece; the pieces of a longer one are in order of
    place.  A single very long text is a block by itself.  The edits of one
    conversation, a letter a turn, have to fit into one task's memory, as they
    make one value.  Null conversation ids are one conversation.  Turns are
    read as long.  Other columns are ignored.  An empty table gives no pieces.
    """
    spark = prepare(turns.sparkSession)
    copies = F.col(copies_col) if copies_col else F.lit(1)
    there = copies > 0
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.when(there, F.col(turn_col).cast("long")).alias("turn"),
                        F.when(there, space(role_col)).alias("role"), F.when(there, space(text_col)).alias("text"), copies.alias("copies"))
    conv = rows.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", F.xxhash64("text")]
    ranged = _faults(rows).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    blocks = stored(ranged.mapInArrow(_blocks(block_rows, block_bytes), _ddl(conv, _BLOCK)))
    grammar = re_pair(blocks, "symbols", rounds, per_round)
    inner = blocks.where("not edge").mapInArrow(_whole(grammar), _ddl(conv, _PIECE))
    edges = blocks.where("edge")
    ways = edges.select("conv", "task", "block", "symbols").repartition("conv").sortWithinPartitions("conv", "task", "block")
    paths = stored(ways.mapInArrow(_paths(grammar), _ddl(conv, _PATH))).drop("conv")
    joined = edges.join(paths, ["task", "block"]).select(
        "conv", "task", "block", "symbols", "start", "cost", "audit", *[n for n, _ in [*_LINES, *_COUNTS]])
    return inner.unionByName(joined.mapInArrow(_rewritten, _ddl(conv, _PIECE)))


def _gaps(low, high, turns):
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of several pieces, hashed along the pieces."""
    def rows(batches):
        begun, last = False, None
        for conv, cost, audit, roles, texts, low, high, turns, *rest in _read(batches):
            *numbers, head, tail = rest
            if not begun or conv != last:
                if begun:
                    yield done()
                begun, last = True, conv
                sha, empty, edits, span, sums, end = hashlib.sha256(), True, [], [None, None, 0], [0] * len(numbers), None
            if low is not None:
                span = [low if span[0] is None else span[0], high, span[2] + turns - (low == span[1])]
            sums = [a + b for a, b in zip(sums, numbers, strict=True)]
            if head is not None:
                sums[-1] += end is not None and (end, head) not in _LEGAL
                end = tail
            edits.append(audit)
            for role, text in zip(roles, texts, strict=True):
                sha.update((("" if empty else "\n") + role + ":").encode())
                sha.update(text.encode())
                empty = False

            def done(conv=conv, cost=cost):
                return (conv, _gaps(*span), *sums, cost, "".join(edits), sha.hexdigest()), sum(map(len, edits))
        if begun:
            yield done()

    yield from _typed(batches, lambda b, t: _written(rows(b), t, _RESULT))


def summarise(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, gaps, counts of faults, cost, audit and the SHA-256 of the repaired turns.

    A conversation in one piece is finished where it is; the others are brought
    together by conversation and hashed piece after piece, since a checksum has
    to pass over the text in order.
    """
    gaps = F.coalesce(F.expr("cast(least(cast(high as decimal(38,0)) - low + 1 - turns, 9223372036854775807) as long)"), F.lit(0).cast("long"))
    text = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    single = pieces.where("whole").select("conv", gaps.alias("gaps"), *_NUMBERS, "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
    parted = pieces.where("not whole").repartition("conv").sortWithinPartitions("conv", "task", "block")
    conv = pieces.schema["conv"].dataType.simpleString()
    return single.unionByName(parted.select("conv", "cost", "audit", *[n for n, _ in [*_LINES, *_COUNTS]]).mapInArrow(_summed, _ddl(conv, _RESULT)))


@query("op13_structure_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, edits and checksum of every conversation, after damage by a checksum of its keys."""
    pieces = repair(damage(table(spark, sf_dir, "conversations")), copies_col="copies")
    return summarise(stored(pieces)).withColumnRenamed("conv", "conv_id")
