"""Repair of conversations whose turns break the order of roles, with the fewest edits, by generalised LR parsing.

The roles of a sound conversation spell the grammar D -> s T | T | nothing, T -> T u a | u a (system, user,
assistant).  A parser runs over all edits of a conversation at once: its stacks share what lies below in a
graph, every turn is deleted, kept or given another role, turns may be inserted anywhere, and stacks with
equal tops are merged into the cheapest by (cost, audit).  An audit has a letter for each edit: K, R, D, I.

First pass: rows without their texts, sorted by conversation and turn, stream through the parser, which yields
counts, cost and audit.  Second pass: texts, sorted alike, stream by their conversation's audit.  Of a
conversation a task holds a byte a turn, the hashes that show duplicates and the audit, but never its texts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches, table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: The parser of the grammar.  States: 0 start, 1 s, 2 u, 3 T, 4 sT, 5 ua, 6 Tu, 7 Tua.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
#: Symbols that a state's reduction to T takes from the stack, and the state that T leads to from the one below.
REDUCE, GOTO, ACCEPT = {5: 2, 7: 3}, {0: 3, 1: 4}, (0, 3, 4)

#: White space of the fault rules.
BLANKS = " \t\n\x0b\f\r"
INITIALS = " sua"
ROLES = {"u": "user", "a": "assistant"}
#: Turns of a conversation up to which its parse is remembered, and after how many a common beginning is set aside.
SHORT, STEP = 64, 256

REPORT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack (state, rest) after a symbol and the reductions it allows; None where the grammar has no place for it."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while state in REDUCE:
        for _ in range(REDUCE[state]):
            stack = stack[1]
        state = GOTO[stack[0]]
        stack = (state, stack)
    return stack


def _offer(tops: dict, stack: tuple | None, cost: int, audit: str) -> bool:
    """Merge a stack into those with an equal top: the least (cost, audit) stays."""
    if stack is None:
        return False
    old = tops.get(stack[0])
    if old is not None and (old[0], old[1]) <= (cost, audit):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def _insert(tops: dict) -> None:
    waiting = list(tops.values())
    while waiting:
        cost, audit, stack = waiting.pop()
        for symbol in "ua":
            after = _shift(stack, symbol)
            if _offer(tops, after, cost + INSERT, audit + "I"):
                waiting.append(tops[after[0]])


def parse(turns: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; of equally cheap ones the audit that is least in ASCII.

    A byte a turn: place of the initial in INITIALS, plus 4 if the turn must go, plus 8 if it is cut off.  Two
    stacks merge at the same turn, where equal costs exclude that one audit begins the other: what follows
    cannot turn their order round.
    """
    tops = {0: (0, "", (0, None))}
    _insert(tops)
    settled = []
    for k, turn in enumerate(turns):
        initial, extra, after = INITIALS[turn & 3], TRUNCATED if turn & 8 else 0, {}
        for cost, audit, stack in tops.values():
            _offer(after, stack, cost + DELETE, audit + "D")
            if not turn & 4:
                _offer(after, _shift(stack, initial), cost + extra, audit + "K")
                for symbol in "ua":
                    _offer(after, _shift(stack, symbol), cost + extra + REROLE, audit + "R")
        tops = after
        _insert(tops)
        if k % STEP == STEP - 1:
            common = os.path.commonprefix([audit for _, audit, _ in tops.values()])
            settled.append(common)
            tops = {state: (cost, audit[len(common):], stack) for state, (cost, audit, stack) in tops.items()}
    cost, audit = min(tops[state][:2] for state in ACCEPT if state in tops)
    return cost, "".join(settled) + audit


_remembered = lru_cache(100_000)(parse)


def _reports(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row a conversation, from rows (conv_id, turn, code, a, b) in order; code -1: there is no turn."""
    schema = pa.schema([("conv_id", kind), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    legal = {(INITIALS.index(x), INITIALS.index(y)) for x, y in ("su", "ua", "au")}
    current, open_ = None, False
    turns, seen, counts, places = bytearray(), set(), [0, 0, 0, 0], []  # blank, duplicate, truncated, illegal; least, last and number of turns

    def report() -> tuple:
        cost, audit = (_remembered if len(turns) <= SHORT else parse)(bytes(turns))
        return (current, places[1] - places[0] + 1 - places[2] if places else 0, *counts, cost, audit)

    for batch in batches:
        out = []
        for conv, turn, code, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_ or conv != current:
                if open_:
                    out.append(report())
                current, open_ = conv, True
                turns, seen, counts, places = bytearray(), set(), [0, 0, 0, 0], []
            if code < 0:
                continue
            if turn is not None:
                if not places:
                    places = [turn, turn, 1]
                elif turn != places[1]:
                    places[1], places[2] = turn, places[2] + 1
            if turns and (turns[-1] & 3, code & 3) not in legal:
                counts[3] += 1
            blank = bool(code & 4)
            copy = not blank and (a, b) in seen
            if blank or copy:
                code = code & 3 | 4
            else:
                seen.add((a, b))
            counts[0] += blank
            counts[1] += copy
            counts[2] += bool(code & 8)
            turns.append(code)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in out], schema)
    if open_:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, report()))], schema)


def _keyed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls, and 128 bits of the last two, by which equal turns are ordered."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "role", "text")})


def repair_reports(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Faults and the cheapest repair of each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    `turns` has conv_id, turn, role and text; other columns are left alone.  Order is by turn, nulls first, rows
    of one turn by a hash of role and text.  Null roles and texts count as one space, rows with a null conv_id as
    one conversation.  A role that begins with none of s, u, a fits nowhere and is deleted or given another.
    Rows where `present` is false only tell that there is such a conversation: one without turns has zeros and
    an empty audit.  An empty table gives no rows.  Duplicates are told by 128 bits of role and text.
    """
    kind = turns.schema["conv_id"].dataType
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    code += F.when(end == "", 4).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(8)
    if present is not None:
        turns = turns.withColumn("__present", F.coalesce(present, F.lit(False)))
        rows = _keyed(turns.filter("__present")).select("conv_id", "turn", code.cast("int").alias("code"), "a", "b")
        away = [F.lit(None).cast("long").alias("turn"), F.lit(-1).alias("code"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")]
        rows = rows.union(turns.filter("not __present").select("conv_id", *away))
    else:
        rows = _keyed(turns).select("conv_id", "turn", code.cast("int").alias("code"), "a", "b")
    arrow = pa.int64() if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "a", "b")
    return rows.mapInArrow(lambda batches: _reports(batches, arrow), REPORT.format(kind.simpleString()))


def _replay(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Turns that an audit leaves, from rows (conv_id, role, text, audit): a conversation's audit, then its turns."""
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    audit, at, place, before, current = "", 0, 0, "", None
    out: list[tuple] = []

    def put(role: str, text: str) -> None:
        nonlocal place, before
        out.append((current, place, role, text))
        place, before = place + 1, role[:1]

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(ROLES["a" if before == "u" else "u"], "")
            at += 1

    for batch in batches:
        for conv, role, text, edits in zip(*(c.to_pylist() for c in batch.columns)):
            if edits is not None:
                audit, at, place, before, current = edits, 0, 0, "", conv
                inserted()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                put(ROLES["a" if before == "u" else "u"] if edit == "R" else role, text)
            inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()


def repaired_turns(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The conversations as `repair_reports` mends them: conv_id, place (from 0), role, text, in order within partitions."""
    kind = turns.schema["conv_id"].dataType
    arrow = pa.int64() if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string()
    rows = _keyed(turns).withColumn("audit", F.lit(None).cast("string"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("a", "long"), ("b", "long"))]
    rows = rows.union(reports.select("conv_id", *none, "audit"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "a", "b")
    return rows.select("conv_id", "role", "text", "audit").mapInArrow(lambda batches: _replay(batches, arrow), f"conv_id {kind.simpleString()}, place long, role string, text string")


def turn_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256): of the lines `role:text` of each conversation of `repaired_turns`, joined by a line break."""
    kind = repaired.schema["conv_id"].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None
        for batch in batches:
            done, out = [], []
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if place == 0:
                    if running is not None:
                        done.append(current)
                        out.append(running.hexdigest())
                    current, running = conv, hashlib.sha256(line)
                else:
                    running.update(b"\n" + line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, batch.schema.field(0).type), pa.array(out, pa.string())], ["conv_id", "sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.schema.field(0).type), pa.array([running.hexdigest()])], ["conv_id", "sha256"])

    return repaired.mapInArrow(digest, f"conv_id {kind.simpleString()}, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that the query prescribes; those that it drops stay with `dropped` true and no text."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage `conversations`, find each conversation's faults and cheapest repair, and digest the repaired turns."""
    small_batches(spark)
    rows = damaged(table(spark, sf_dir, "conversations"))
    reports = repair_reports(rows, ~F.col("dropped"))
    digests = turn_digests(repaired_turns(rows.filter("not dropped"), reports)).withColumnRenamed("conv_id", "__conv")
    joined = reports.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return joined.select(*reports.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of an ASCII text."""
    fed = f"xor(sofar, CASE WHEN bit % 8 = 0 THEN ord(({text})[bit // 8 + 1]) ELSE 0 END)"
    return f"xor(list_reduce(range(8 * length({text})), lambda sofar, bit: xor({fed} >> 1, 3988292384 * ({fed} & 1)), 4294967295), 4294967295)"


def _add(top: str, cost: str, letter: str) -> str:
    return f"{{'c': {top}.c + {cost}, 'a': {top}.a || '{letter}'}}"


_NONE = "{'c': 1000000000000::BIGINT, 'a': ''}"
_ROW = "'i': {0}, 'gone': {1}, 'cut': {2}::BIGINT, 'p0': {3}, 'p1': {4}, 'p2': {5}, 'p3': {6}"
SQL = {
    "op13_conversation_repair": f"""
WITH base AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
        {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
hurt AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE r END AS r,
        CASE f WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS n
    FROM base WHERE f <> 0),
placed AS (SELECT *, rtrim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t, n) AS p FROM hurt),
known AS (SELECT *, row_number() OVER (PARTITION BY conv_id, r, t ORDER BY p) > 1 AS again, lag(r[1]) OVER (PARTITION BY conv_id ORDER BY p) AS old FROM placed),
faulty AS MATERIALIZED (SELECT *, CASE WHEN x = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN x[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM known),
packed AS (SELECT conv_id, list({{{_ROW.format("r[1]", "fault IN ('blank', 'duplicate')", "5 * (fault = 'truncated')::INT", *[_NONE] * 4)}}} ORDER BY p) AS turns,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (p > 1 AND old || r[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id),
folded AS (SELECT * EXCLUDE (turns), list_reduce(turns, lambda y, x: list_transform([list_transform([{{
            'n0': {_add("y.p0", "2", "D")},
            'n1': least({_add("y.p1", "2", "D")}, CASE WHEN x.i = 's' AND NOT x.gone THEN {_add("y.p0", "x.cut", "K")} ELSE {_NONE} END),
            'n2': least({_add("y.p2", "2", "D")}, CASE WHEN x.i = 'u' AND NOT x.gone THEN {_add("least(y.p0, y.p1, y.p3)", "x.cut", "K")} ELSE {_NONE} END,
                CASE WHEN NOT x.gone THEN {_add("least(y.p0, y.p1, y.p3)", "x.cut + 1", "R")} ELSE {_NONE} END),
            'n3': least({_add("y.p3", "2", "D")}, CASE WHEN x.i = 'a' AND NOT x.gone THEN {_add("y.p2", "x.cut", "K")} ELSE {_NONE} END,
                CASE WHEN NOT x.gone THEN {_add("y.p2", "x.cut + 1", "R")} ELSE {_NONE} END)}}],
        lambda z: {{'n0': z.n0, 'n1': z.n1, 'n3': z.n3, 'n2': least(z.n2, {_add("least(z.n0, z.n1, z.n3)", "5", "I")})}})[1]],
        lambda z: {{{_ROW.format("x.i", "x.gone", "x.cut", "z.n0", "z.n1", "z.n2", f"least(z.n3, {_add('z.n2', '5', 'I')})")}}})[1],
        {{{_ROW.format("''", "false", "0", "{'c': 0::BIGINT, 'a': ''}", _NONE, "{'c': 5::BIGINT, 'a': 'I'}", "{'c': 10::BIGINT, 'a': 'II'}")}}}) AS z FROM packed),
chosen AS (SELECT * EXCLUDE (z), least(z.p0, z.p3) AS best FROM folded),
edits AS (SELECT conv_id, best.a AS a, unnest(range(1, length(best.a) + 1)) AS k FROM chosen),
numbered AS (SELECT conv_id, k, a[k] AS e, sum((a[k] <> 'I')::INT) OVER w AS p, sum((a[k] <> 'D')::INT) OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
joined AS (SELECT n.conv_id, o, e, CASE WHEN e = 'I' THEN '' ELSE t END AS t, r,
        max((o = 1 AND e = 'K' AND r[1] = 's')::INT) OVER (PARTITION BY n.conv_id) AS s
    FROM numbered n LEFT JOIN faulty f ON n.conv_id IS NOT DISTINCT FROM f.conv_id AND n.p = f.p WHERE e <> 'D'),
mended AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN r WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || t, chr(10) ORDER BY o) AS body FROM joined GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN chosen c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended m ON i.conv_id IS NOT DISTINCT FROM m.conv_id"""
}
