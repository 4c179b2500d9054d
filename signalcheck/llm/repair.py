"""Repair of conversation structure by Four-Russians block tables.

A conversation is a row of symbols: the initial of each role with its first fault. The cheapest edits that make the roles
alternate are found from the end: per row a vector of four costs, one per state (start, after a system turn, after a user
turn, after an assistant turn). Taken relative to its least entry, only a few different vectors exist, so the step over a
block of ``BLOCK`` symbols is a table entry for every vector and every block. A conversation is read block by block
through that table; the vectors at block ends are kept, and the trace goes forward through each block, expanded backward
from its end, taking the least letter among the cheapest edits. A state and a letter fix the next state, so this gives
the least of all cheapest edit strings.

Rows are put in order by range partitions, so a conversation of any length lies in several tasks. Segments of at most
``SEGMENT`` rows give a 4 x 4 table of costs from their first to their last state; the tables of a conversation are put
together from the end, the states from the start. Only the hash of the repaired text, one sequence by definition, reads a
conversation in one task, row by row with constant memory beside the audit.

Null roles and texts are one space, a null conv_id is a conversation, null turns come first. Rows of one turn are ordered
by role and text. Repeated rows are duplicates. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import append_columns, table
from signalcheck.session import Scratch, materialize

BLOCK = 3
SEGMENT = 3_072
BLANKS = " \t\n\x0b\x0c\r"
#: Symbols: 0-3 the initials s, u, a and others, 4-7 the same truncated, 8 blank, 9 duplicate, 10 padding.
INITIALS = "sua"
BLANK, DUPLICATE, PAD, SYMBOLS = 8, 9, 10, 11
START, SYSTEM, USER, ASSISTANT = range(4)
NONE = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The state after a turn that is put in or given the role that fits.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept turn, by initial.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
#: One step of inserted turns leads from any state to the end.
ENDED = (0, 2 * INSERT, INSERT, 0)


def before(costs: tuple, symbol: int) -> tuple:
    """Costs from before the row, given those from after it; inserts before the row count as well."""
    if symbol == PAD:
        return costs
    out = []
    for state in range(4):
        best = costs[state] + DELETE
        if symbol < BLANK:
            late = TRUNCATED * (symbol >= 4)
            best = min(best, costs[NEXT[state]] + REROLE + late)
            if state in KEPT[symbol % 4]:
                best = min(best, costs[KEPT[symbol % 4][state]] + KEEP + late)
        out.append(min(best, NONE))
    for _ in range(3):
        out = [min(c, out[NEXT[s]] + INSERT) for s, c in enumerate(out)]
    return tuple(min(c, NONE) for c in out)


def relative(costs: tuple) -> tuple[tuple, int]:
    least = min(costs)
    return tuple(c if c >= NONE else c - least for c in costs), least


def unit(state: int) -> tuple:
    return tuple(0 if s == state else NONE for s in range(4))


@functools.cache
def block_table() -> tuple[dict, list, np.ndarray, np.ndarray]:
    """Numbers of the relative vectors, the vectors, and for vector and block the vector before it and the cost added."""
    vectors = [ENDED, *map(unit, range(4))]
    number = {v: i for i, v in enumerate(vectors)}
    one, added = [], []
    for vector in vectors:  # grows while read
        steps = [relative(before(vector, symbol)) for symbol in range(SYMBOLS)]
        for found, _ in steps:
            if found not in number:
                number[found] = len(vectors)
                vectors.append(found)
        one.append([number[found] for found, _ in steps])
        added.append([cost for _, cost in steps])
    one, added = np.array(one), np.array(added, np.int64)
    codes = np.arange(SYMBOLS**BLOCK)
    to = np.repeat(np.arange(len(vectors))[:, None], len(codes), 1)
    cost = np.zeros_like(to)
    for place in range(BLOCK):  # the last symbol of a block is the lowest digit and is read first
        symbol = codes // SYMBOLS**place % SYMBOLS
        cost, to = cost + added[to, symbol[None]], one[to, symbol[None]]
    return number, vectors, to, cost


def blocks_of(symbols: list[int]) -> list[int]:
    padded = [PAD] * (-len(symbols) % BLOCK) + list(symbols)
    return [functools.reduce(lambda code, s: code * SYMBOLS + s, padded[i : i + BLOCK], 0) for i in range(0, len(padded), BLOCK)]


def scan(blocks: list[int], vector: int) -> tuple[list[int], int]:
    """The vector after each block, then the one before the first; and the cost added in all."""
    _, _, to, cost = block_table()
    at, total = [vector], 0
    for block in reversed(blocks):
        total += int(cost[vector, block])
        vector = int(to[vector, block])
        at.append(vector)
    return at[::-1], total


def summary(symbols: list[int]) -> list[int]:
    """Costs from each state before to each state after the rows, as 16 numbers, -1 for none."""
    number, vectors, _, _ = block_table()
    blocks = blocks_of(symbols)
    columns = []
    for last in range(4):
        at, total = scan(blocks, number[unit(last)])
        columns.append([-1 if c >= NONE else c + total for c in vectors[at[0]]])
    return [columns[last][first] for first in range(4) for last in range(4)]


@functools.lru_cache(200_000)
def trace_block(block: int, vector: int, state: int) -> tuple[tuple[str, ...], int]:
    """Letters of the rows of a block and the state after it, given the vector after it."""
    _, vectors, _, _ = block_table()
    symbols = [block // SYMBOLS**place % SYMBOLS for place in reversed(range(BLOCK))]
    costs = [vectors[vector]]
    for symbol in reversed(symbols):
        costs.append(before(costs[-1], symbol))
    costs.reverse()
    out = []
    for i, symbol in enumerate(symbols):
        if symbol == PAD:
            continue
        letters, here, after = "", costs[i], costs[i + 1]
        late = TRUNCATED * (4 <= symbol < BLANK)
        while True:
            kept = KEPT[symbol % 4].get(state) if symbol < BLANK else None
            if here[state] == after[state] + DELETE:
                letters += "D"
            elif here[state] == here[NEXT[state]] + INSERT:
                letters += "I"
                state = NEXT[state]
                continue
            elif kept is not None and here[state] == after[kept] + KEEP + late:
                letters, state = letters + "K", kept
            else:
                letters, state = letters + "R", NEXT[state]
            break
        out.append(letters)
    return tuple(out), state


def trace(symbols: list[int], after: list[int], state: int, last: bool) -> tuple[list[str], int]:
    """Letters per row and the state after the last, given the costs after it."""
    number, _, _, _ = block_table()
    blocks = blocks_of(symbols)
    at, _ = scan(blocks, number[relative(tuple(NONE if c < 0 else c for c in after))[0]])
    letters: list[str] = []
    for block, vector in zip(blocks, at[1:], strict=True):
        found, state = trace_block(block, vector, state)
        letters += found
    while last and state in (SYSTEM, USER):
        letters[-1] += "I"
        state = NEXT[state]
    return letters, state


def ends_of(matrices: list[list[int]]) -> list[list[int]]:
    """Costs after each segment of a conversation, from the 16 numbers of its segments; -1 for none."""
    after, out = list(ENDED), []
    for flat in reversed(matrices):
        out.append([-1 if c >= NONE else c for c in after])
        step = [[flat[4 * s + e] for e in range(4)] for s in range(4)]
        after = [min([row[e] + after[e] for e in range(4) if row[e] >= 0 and after[e] < NONE], default=NONE) for row in step]
        after = list(relative(tuple(after))[0])
    return out[::-1]


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with the faults that the hash of conversation and turn decides; conv is never null."""
    space = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(as_text("role"))
    copies = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    damaged = rows.select(conv_key().alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return damaged.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "copy")


def conv_key() -> Column:
    return F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("#"), F.col("conv_id").cast("string")))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, rising within a conversation by turn, role and text, and ``segment`` of at most SEGMENT rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    # The number of a row holds its partition and its place in it, and the partitions are ranges of the order.
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    return placed.withColumn("segment", F.floor(F.col("pos") / F.lit(SEGMENT)).cast("long"))


def symbols_of(rows: DataFrame) -> DataFrame:
    """(conv, segment, pos, symbol) of rows in order."""
    narrow = rows.select("conv", "segment", "pos", "role", F.sha2("text", 256).alias("digest"), F.rtrim("text", F.lit(BLANKS)).alias("text"))
    narrow = narrow.select("conv", "segment", "pos", "role", "digest", F.length("text").alias("n"), F.substring("text", -1, 1).alias("end"))
    said = narrow.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    seen = narrow.join(said, ["conv", "role", "digest"], "left")
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when(F.length("role") == 0, F.lit(3)).when(initial == 0, F.lit(3)).otherwise(initial - 1)
    symbol = (
        F.when(F.col("n") == 0, F.lit(BLANK)).when(F.col("pos") > F.col("first"), F.lit(DUPLICATE))
        .when(F.col("end").isin(".", "!", "?"), initial).otherwise(initial + 4)
    )
    return seen.select("conv", "segment", "pos", symbol.cast("int").alias("symbol"))


def edits_of(symbols: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, symbol, letters): the edits before and at each row, after the last one too."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    grouped = symbols.groupBy("conv", "segment").agg(ordered.alias("rows")).select("conv", "segment", F.col("rows.pos").alias("places"), F.col("rows.symbol").alias("symbols"))
    segments = scratch.materialize(
        append_columns(grouped, ["symbols"], "matrix array<long>", lambda rows: [[summary(s) for s in rows]]), "repair-segments"
    )
    # 16 numbers per segment: a conversation is thousands of times larger than its list of segments.
    whole = segments.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "matrix"))).alias("parts"))
    whole = whole.select("conv", F.col("parts.segment").alias("names"), F.col("parts.matrix").alias("matrices"))
    known = append_columns(whole, ["matrices"], "afters array<array<long>>", lambda rows: [[ends_of(m) for m in rows]], ["conv", "names"])
    known = known.select("conv", F.size("names").alias("of"), F.posexplode(F.arrays_zip("names", "afters")).alias("place", "z"))
    known = known.select("conv", F.col("z.names").alias("segment"), F.col("z.afters").alias("after"), (F.col("place") == 0).alias("head"), (F.col("place") == F.col("of") - 1).alias("tail"))

    def traced(symbols, afters, heads, tails):
        letters, ends = [], []
        for symbol, after, head, tail in zip(symbols, afters, heads, tails, strict=True):
            found = [trace(symbol, after, state, tail) for state in range(1 if head else 4)]
            letters.append([f[0] for f in found])
            ends.append([f[1] for f in found])
        return [letters, ends]

    told = append_columns(
        segments.drop("matrix").join(known, ["conv", "segment"]), ["symbols", "after", "head", "tail"], "letters array<array<string>>, ends array<int>", traced,
        ["conv", "segment", "places", "symbols"],
    )
    told = scratch.materialize(told, "repair-traces")
    chains = told.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "ends"))).alias("parts"))
    chains = chains.select("conv", F.col("parts.segment").alias("names"), F.col("parts.ends").alias("ends"))
    chains = append_columns(chains, ["ends"], "states array<int>", lambda rows: [[starts_of(e) for e in rows]], ["conv", "names"])
    chains = chains.select("conv", F.explode(F.arrays_zip("names", "states")).alias("z")).select("conv", F.col("z.names").alias("segment"), F.col("z.states").alias("state"))
    picked = told.join(chains, ["conv", "segment"]).select("conv", F.explode(F.arrays_zip("places", "symbols", F.col("letters")[F.col("state")].alias("letters"))).alias("z"))
    return picked.select("conv", F.col("z.places").alias("pos"), F.col("z.symbols").alias("symbol"), F.col("z.letters").alias("letters"))


def starts_of(ends: list[list[int]]) -> list[int]:
    """The state before each segment, from the states after it by state before it."""
    out, state = [], START
    for end in ends:
        out.append(state)
        state = end[state]
    return out


class Report:
    """Figures, audit and hash of one conversation, fed row by row in order."""

    def __init__(self, conv_id):
        self.conv_id, self.first, self.last, self.distinct = conv_id, None, None, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = 0
        self.initial, self.state, self.audit, self.hash, self.said = None, START, [], hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.said else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.said = True

    def add(self, turn, role: str, text: str, symbol: int, letters: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        late = 4 <= symbol < BLANK
        for name, is_so in (("blank", symbol == BLANK), ("duplicate", symbol == DUPLICATE), ("truncated", late)):
            self.faults[name] += is_so
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.audit.append(letters)
        for letter in letters:
            if letter == "D":
                self.cost += DELETE
                continue
            if letter == "K":
                self.state = KEPT[symbol % 4][self.state]
                self.say(role, text)
                self.cost += KEEP + late
                continue
            self.state = NEXT[self.state]
            self.say("user" if self.state == USER else "assistant", "" if letter == "I" else text)
            self.cost += INSERT if letter == "I" else REROLE + late

    def row(self) -> list:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return [self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reported(fed: DataFrame, conv_type: str) -> DataFrame:
    """One row per conversation from (conv, pos, kind, conv_id, turn, role, text, symbol, letters) in order.

    Kind 0 opens a conversation, 1 brings the edits of the row that follows as kind 2.
    """
    names = ["conv_id", *(part.split()[0] for part in RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, edit, done = None, None, []

        def out():
            columns = list(zip(*done, strict=True))
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for what, conv_id, turn, role, text, symbol, letters in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "symbol", "letters")), strict=True):
                if what == 0:
                    if report is not None:
                        done.append(report.row())
                    report = Report(conv_id)
                elif what == 1:
                    edit = (symbol, letters)
                else:
                    report.add(turn, role, text, *edit)
            if done:
                yield out()
        if report is not None:
            done.append(report.row())
            yield out()

    dealt = fed.repartition("conv").sortWithinPartitions("conv", "pos", "kind")
    return dealt.mapInArrow(run, f"conv_id {conv_type}, {RESULT}")


def repair(conversations: DataFrame) -> DataFrame:
    """The report of every conversation after damage and repair."""
    with Scratch(conversations.sparkSession) as scratch:
        rows = scratch.materialize(in_order(damage(conversations)), "repair-rows")
        edits = edits_of(symbols_of(rows), scratch)
        conv_type = dict(conversations.dtypes)["conv_id"]
        blank = lambda kind, *columns: F.lit(None).cast(kind)
        text, number, name = blank("string"), blank("int"), blank(conv_type)
        heads = conversations.groupBy("conv_id").count().select(
            conv_key().alias("conv"), F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), "conv_id",
            blank("long").alias("turn"), text.alias("role"), text.alias("text"), number.alias("symbol"), text.alias("letters"),
        )
        edited = edits.select("conv", "pos", F.lit(1), name, blank("long"), text, text, "symbol", "letters")
        said = rows.select("conv", "pos", F.lit(2), name, "turn", "role", "text", number, text)
        return materialize(reported(heads.union(edited).union(said), conv_type), "repair")


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(table(spark, folder, "conversations"))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c
    FROM (SELECT unnest(range(256)) AS b))
), keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM marked)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told
  FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS i, CASE WHEN told = '' THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'd'
    WHEN right(told, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY j) AS was
  FROM placed
), inserts(a, b, n, put) AS (
  VALUES (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']),
    (3, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])
), moves(a, letter, i, b) AS (
  VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2),
    (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2)
), dp AS (
  SELECT conv_id, 0::BIGINT AS j, b AS state, {'cost': 2 * n::BIGINT, 'audit': repeat('I', n), 'told': put::VARCHAR[]} AS best
  FROM (SELECT DISTINCT conv_id FROM faulty), inserts WHERE a = 0
  UNION ALL
  SELECT conv_id, j, state, min(best) AS best FROM (
    SELECT f.conv_id, f.j, n.b AS state, {
      'cost': d.best.cost + 2 * n.n + CASE m.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (m.letter <> 'D' AND f.fault = 't')::BIGINT,
      'audit': d.best.audit || m.letter || repeat('I', n.n),
      'told': list_concat(d.best.told, CASE m.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
        ELSE [(CASE m.b WHEN 2 THEN 'user:' ELSE 'assistant:' END) || f.text] END, n.put::VARCHAR[])} AS best
    FROM dp d JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.j = d.j + 1
    JOIN moves m ON m.a = d.state AND (m.letter = 'D' OR f.fault NOT IN ('b', 'd')) AND (m.i IS NULL OR m.i = f.i)
    JOIN inserts n ON n.a = m.b)
  GROUP BY conv_id, j, state
), counts AS (
  SELECT conv_id, max(j) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ended AS (
  SELECT c.conv_id, min(d.best) AS best FROM counts c JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.j = c.rows
  WHERE d.state IN (0, 3) GROUP BY c.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.told, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
