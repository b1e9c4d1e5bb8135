"""Conversation structure repair by secondary-sorted streaming.

Conversations are dealt by id and each is streamed twice out of one sorted
partition: first its rows from the last turn to the first as one code each,
then in turn order with their texts.  On the way back a dynamic programme over
the four states of ``(s?(ua)+)?`` finds the cheapest edits and writes one byte
of backpointers a row (two bits a state); on the way forth the bytes are read
from their end and the edits are applied.  State is carried across Arrow
batches, so a conversation may be longer than any batch.  Backpointers beyond
``SPILL_BYTES`` leave memory for an unnamed file of the task, which is gone
with the task; a lost executor's task starts over from the shuffle.

Ties: going back, every state keeps the choice that is least in ASCII among the
cheapest (Delete, Insert, Keep, Rerole).  An edit's letter and the state fix
the next state, so these choices spell the least audit string.

Scale: one exchange by conversation; texts are shuffled once.  A task holds one
Arrow batch, a few integers and the spooled bytes, whatever the length of a
conversation.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm.common import crc32_sql, prepare, table

#: Bytes of backpointers of one conversation that stay in memory.
SPILL_BYTES = 8 << 20
#: Bytes read at once on the way forth.
READ_BYTES = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
OPS = b"DIKR"
SYMBOLS = "sua"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Code of a row that the damage dropped: its conversation is known, nothing else is left of it.
GONE = -1
#: State after reading s, u or a in each state (0 start, 1 after s, 2 after u, 3 after a), or None.
NEXT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: The symbol among user and assistant that a state takes: it decides what Insert and Rerole write.
TAKES = (1, 1, 2, 1)
WORDS = {1: "user", 2: "assistant"}
#: Cost from each state when no row is left.
END = (0, 4, 2, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}

_BLANKS = r"\x20\x09-\x0D"


class Backpointers:
    """Bytes written in one order and read in the opposite one; beyond ``limit`` they lie in a file."""

    def __init__(self, limit: int):
        self.file = tempfile.SpooledTemporaryFile(max_size=limit)
        self.waiting = bytearray()

    def add(self, byte: int) -> None:
        self.waiting.append(byte)
        if len(self.waiting) >= READ_BYTES:
            self.file.write(self.waiting)
            self.waiting.clear()

    def backwards(self) -> Iterator[int]:
        self.file.write(self.waiting)
        at = self.file.tell()
        while at:
            size = min(READ_BYTES, at)
            at -= size
            self.file.seek(at)
            yield from reversed(self.file.read(size))
        self.file.close()


def step(after: tuple, code: int) -> tuple[tuple, int]:
    """Costs from each state before a row, given those after it, and the row's backpointers."""
    symbol, fault = divmod(code, 4)
    extra = TRUNCATED if fault == CUT else 0
    ways = []
    for q in range(4):
        options = {"D": DELETE + after[q]}
        if fault not in (BLANK, DUPLICATE):
            if symbol < 3 and NEXT[q][symbol] is not None:
                options["K"] = KEEP + extra + after[NEXT[q][symbol]]
            options["R"] = REROLE + extra + after[NEXT[q][TAKES[q]]]
        ways.append(options)
    least = [min(w.values()) for w in ways]
    costs = [0] * 4
    costs[2], costs[3] = min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])
    costs[0], costs[1] = min(least[0], INSERT + costs[2]), min(least[1], INSERT + costs[2])
    byte = 0
    for q in range(4):
        ways[q]["I"] = INSERT + costs[NEXT[q][TAKES[q]]]
        best = min(op for op, cost in ways[q].items() if cost == costs[q])
        byte |= "DIKR".index(best) << 2 * q
    return tuple(costs), byte


class Conversation:
    """What is carried of one conversation."""

    def __init__(self, spill_bytes: int, steps: dict):
        self.steps, self.spill_bytes = steps, spill_bytes
        self.faults = [0] * 4
        self.illegal = self.base = self.turns = 0
        self.costs, self.later = END, None
        self.low = self.high = None
        self.back = self.path = None
        self.state, self.audit, self.sha, self.first = 0, bytearray(), hashlib.sha256(), True

    def backward(self, code: int, turn: int | None) -> None:
        if code == GONE:
            return
        if self.back is None:
            self.back = Backpointers(self.spill_bytes)
        symbol, fault = divmod(code, 4)
        self.faults[fault] += 1
        if self.later is not None and (symbol, self.later) not in LEGAL:
            self.illegal += 1
        self.later = symbol
        if turn is not None and turn != self.low:
            self.low, self.turns = turn, self.turns + 1
            self.high = turn if self.high is None else self.high
        key = (self.costs, code)
        if key not in self.steps:  # costs are kept relative to their least, so there are few keys
            costs, byte = step(self.costs, code)
            least = min(costs)
            self.steps[key] = tuple(c - least for c in costs), least, byte
        self.costs, more, byte = self.steps[key]
        self.base += more
        self.back.add(byte)

    def _write(self, role: str, text: str) -> None:
        if not self.first:
            self.sha.update(b"\n")
        self.first = False
        self.sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def _insert(self) -> None:
        symbol = TAKES[self.state]
        self._write(WORDS[symbol], "")
        self.audit.append(OPS[1])
        self.state = NEXT[self.state][symbol]

    def forward(self, code: int, role: str, text: str) -> None:
        if self.path is None:
            self.path = self.back.backwards()
        byte = next(self.path)
        while (op := byte >> 2 * self.state & 3) == 1:
            self._insert()
        self.audit.append(OPS[op])
        if op == 0:
            return
        symbol = code // 4 if op == 2 else TAKES[self.state]
        self._write(role if op == 2 else WORDS[symbol], text)
        self.state = NEXT[self.state][symbol]

    def result(self) -> tuple:
        if self.path is not None:
            next(self.path, None)  # the first row's byte was the last one: this closes the file
        while END[self.state]:
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal,
                self.base + self.costs[0], self.audit.decode(), self.sha.hexdigest())


_FIELDS = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
    T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")]


def _coded(rows: DataFrame) -> DataFrame:
    """``_tm_pos`` and ``_tm_code`` of each row of its conversation; one exchange by ``conv_id``."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    seen = F.row_number().over(Window.partitionBy("conv_id", "_tm_live", "_tm_said").orderBy(F.col("turn").asc_nulls_first()))
    fault = (F.when(~F.col("text").rlike(f"[^{_BLANKS}]"), BLANK).when(F.col("_tm_seen") > 1, DUPLICATE)
             .when(~F.col("text").rlike(rf"[.!?][{_BLANKS}]*\z"), CUT).otherwise(NONE))
    # rows that are equal in all else stand in the order in which they were seen
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "_tm_seen")
    return (rows.withColumn("_tm_said", said).repartition("conv_id").withColumn("_tm_seen", seen)
            .withColumn("_tm_code", F.when(F.col("_tm_live"), symbol * 4 + fault).otherwise(GONE))
            .withColumn("_tm_pos", F.row_number().over(order)).drop("_tm_said", "_tm_seen"))


def repair_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", live: Column | None = None, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, nulls first; rows of one turn by role, then text.
    A null role or text is one space.  A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (no ``.!?`` at its end).
    The cheapest edits that give role initials ``(s?(ua)+)?`` are found as in
    the module's head.  Only s, u and a are roles that can be kept.

    Rows where ``live`` is false leave nothing but their conversation's id, so
    a conversation without live rows has zeros, an empty audit and the hash of
    the empty string.  A null id is a conversation of its own; repeated rows
    are duplicates; an empty table gives no rows; other columns are ignored.
    """
    prepare(turns.sparkSession)
    live = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    rows = turns.select(F.col(conv_id).alias("conv_id"), live.alias("_tm_live"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    rows = rows.select("conv_id", "_tm_live", *(F.when(F.col("_tm_live"), F.col(c)).alias(c) for c in ("turn", "role", "text")))
    phases = F.when(F.col("_tm_code") == GONE, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    forth = F.col("phase") == 1
    stream = (_coded(rows).withColumn("phase", F.explode(phases))
              .select("conv_id", "phase", F.when(forth, F.col("_tm_pos")).otherwise(-F.col("_tm_pos")).alias("place"),
                      F.col("_tm_code").alias("code"), "turn", F.when(forth, F.col("role")).alias("role"),
                      F.when(forth, F.col("text")).alias("text"))
              .sortWithinPartitions("conv_id", "phase", "place").drop("place"))
    out = T.StructType([rows.schema["conv_id"], *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict = {}
        open_id, talk, done = None, None, []

        def made():
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(
                    columns, [id_type, *[pa.int64()] * 6, *[pa.string()] * 2], strict=True)], names=[f.name for f in out])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for key, phase, code, at, who, words in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "phase", "code", "turn", "role", "text")), strict=True):
                if talk is None or key != open_id:
                    if talk is not None:
                        done.append((open_id, *talk.result()))
                    open_id, talk = key, Conversation(spill_bytes, steps)
                if phase:
                    talk.forward(code, who, words)
                else:
                    talk.backward(code, at)
            if done:
                yield made()
                done.clear()
        if talk is not None:
            done.append((open_id, *talk.result()))
            yield made()

    return stream.mapInArrow(run, out)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by ``crc32(conv_id:turn) % 20``: 0 marks the row as not ``live``, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    hit = F.col("_tm_hit")
    return (turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"),
                         (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).alias("_tm_hit"))
            .select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    (hit != 0).alias("live"),
                    F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_tm_copy"))
            .drop("_tm_copy"))


def op13_conversation_repair(spark, sf_dir):
    """All of ``conversations``, damaged as the contract says."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(rows), live=F.col("live"))


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _op(letter: str, cost: str, then: str) -> str:
    """Cost and audit of an edit before ``then``, both in one string that sorts by cost, then audit."""
    return f"lpad(CAST(CAST({then}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || {then}[10:]"


def _sql_step() -> str:
    """Backward step of the four states: edits of the row, then at most two inserts before them."""
    big = "'999999999'"
    free = "f NOT IN (1, 2)"
    extra = "CASE f WHEN 3 THEN 1 ELSE 0 END"
    rows = {}
    for q in range(4):
        keep = [f"CASE WHEN {free} AND s = '{SYMBOLS[x]}' THEN {_op('K', extra, f'p.v{n}')} ELSE {big} END"
                for x, n in enumerate(NEXT[q]) if n is not None]
        rerole = f"CASE WHEN {free} THEN {_op('R', f'2 + {extra}', f'p.v{NEXT[q][TAKES[q]]}')} ELSE {big} END"
        rows[q] = _least(_op("D", "3", f"p.v{q}"), *keep, rerole)
    return ", ".join(f"{e} AS w{q}" for q, e in rows.items())


OP13_SQL = rf"""
WITH RECURSIVE {crc32_sql("SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations")},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS h FROM conversations
      JOIN crcs ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM c, unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) WHERE h <> 0),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
e AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS s, lead(left(role, 1)) OVER w AS later,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS f
      FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)),
t AS (SELECT conv_id, max(i) AS n, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate,
             count(*) FILTER (f = 3) AS truncated, count(*) FILTER (s || later NOT IN ('su', 'ua', 'au')) AS illegal,
             CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps FROM e GROUP BY conv_id),
p AS (SELECT conv_id, n AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3 FROM t
      UNION ALL
      SELECT conv_id, i, {_least("w0", _op("I", "2", "u2"))} AS v0, {_least("w1", _op("I", "2", "u2"))} AS v1, u2, u3
      FROM (SELECT *, {_least("w2", _op("I", "2", "w3"))} AS u2, {_least("w3", _op("I", "2", "w2"))} AS u3
            FROM (SELECT p.conv_id, p.i - 1 AS i, {_sql_step()}
                  FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i))),
a AS (SELECT conv_id, CAST(v0[1:9] AS BIGINT) AS cost, v0[10:] AS audit FROM p WHERE i = 0),
walk AS (SELECT conv_id, 1 AS k, 1 AS i, 0 AS q, audit, CAST(NULL AS VARCHAR) AS line FROM a
         UNION ALL
         SELECT w.conv_id, k + 1, CASE audit[k] WHEN 'I' THEN w.i ELSE w.i + 1 END,
                CASE WHEN audit[k] = 'D' THEN q WHEN audit[k] = 'K' AND e.s = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END, audit,
                CASE WHEN audit[k] = 'D' THEN NULL WHEN audit[k] = 'K' THEN e.role || ':' || e.text
                     ELSE CASE q WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE audit[k] WHEN 'I' THEN '' ELSE e.text END END
         FROM walk w LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i WHERE k <= length(audit)),
r AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (line IS NOT NULL), '')) AS repaired_sha256
      FROM walk GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
