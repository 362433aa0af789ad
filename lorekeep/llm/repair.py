"""Conversation structure repair by a time-major dynamic program over many conversations at once.

A conversation is well formed if its role initials read `(s?(ua)+)?`. Edits: Keep costs 0, Rerole to user
or assistant 3, Delete 4 (blank and repeated turns must go), Insert an empty user or assistant turn 3;
a truncated turn that stays adds 3. Of the cheapest edits the ASCII-least string of initials is taken.

The pattern is a machine of four states (start, after s, after u, after a) in which each edit has one
successor, so a string of edits determines the repaired turns. Conversations of like length lie side by
side in tensors, time first: one NumPy step per turn takes the costs of all states of all conversations
back by a turn and stores them; the trace then walks forward and takes, for all conversations at once,
the least letter that stays on a cheapest path.

Two passes, each one shuffle by conversation: (1) codes of the turns (some 50 bytes a turn, no texts)
give edits and facts; (2) the texts, in the same order behind the edits of their conversation, are read
as a stream. A digest of a whole conversation is sequential by nature, so one task reads a conversation;
it holds its codes, never its texts.

Edge cases: a null role or text is one space, and so is a null id or turn in the key of a damage; turns
lie in order of turn (nulls first), then role, then text; rows with a null conv_id are one conversation;
repeated rows are repeated turns; a conversation without rows has zeros and an empty audit; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts

RELABEL, REMOVE, ADD, CUT_OFF = 3, 4, 3, 3
#: States: 0 start, 1 after s, 2 after u, 3 after a. By state and initial (s, u, a, other), the state after it, or -1.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: By state: the state after the only user or assistant turn that may follow, and its role.
TURN = np.array([2, 2, 3, 2])
ROLES = ("user", "user", "assistant", "user")
#: Cost of the inserts that end a conversation well.
END = np.array([0, 2 * ADD, ADD, 0], np.int32)
#: Bits of a turn's code above the two of its initial.
BLANK, CUT, GONE, MUST, PAD = 4, 8, 16, 32, 64
FAR = np.int32(1 << 29)
#: Turns times conversations in one tensor, and turns that a task gathers before it computes.
CELLS, HELD = 1 << 20, 200_000

FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def costs_back(codes: np.ndarray) -> np.ndarray:
    """codes: turns x conversations. Returns (turns + 1) x 4 x conversations: the least cost from before each turn, by state."""
    turns, n = codes.shape
    out = np.empty((turns + 1, 4, n), np.int32)
    out[turns] = END[:, None]
    initial, adds = codes & 3, np.where(codes & CUT, CUT_OFF, 0).astype(np.int32)
    may = (codes & MUST) == 0
    everyone = np.arange(n)
    for t in range(turns - 1, -1, -1):
        ahead, best = out[t + 1], np.empty((4, n), np.int32)
        for q in range(4):
            to = AFTER[q][initial[t]]
            keep = np.where(to >= 0, ahead[to, everyone] + adds[t], FAR)
            stays = np.minimum(keep, ahead[TURN[q]] + adds[t] + RELABEL)
            best[q] = np.minimum(ahead[q] + REMOVE, np.where(may[t], stays, FAR))
        once = np.minimum(best, best[TURN] + ADD)
        twice = np.minimum(once, best[TURN[TURN]] + 2 * ADD)
        out[t] = np.where(codes[t] & PAD, ahead, twice)
    return out


def edits_of(codes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Least costs and least edits of the conversations in a tensor of codes."""
    turns, n = codes.shape
    back = costs_back(codes)
    state, everyone = np.zeros(n, np.int64), np.arange(n)
    letters = np.zeros((3 * turns + 2, n), np.uint8)
    at = 0
    for t in range(turns):
        here, ahead = back[t], back[t + 1]
        adds = np.where(codes[t] & CUT, CUT_OFF, 0)
        may, todo = (codes[t] & MUST) == 0, (codes[t] & PAD) == 0
        for _ in range(3):
            if not todo.any():
                break
            need = here[state, everyone]
            drop = todo & (ahead[state, everyone] + REMOVE == need)
            add = todo & ~drop & (here[TURN[state], everyone] + ADD == need)
            to = AFTER[state, codes[t] & 3]
            keep = todo & ~drop & ~add & may & (to >= 0) & (ahead[to, everyone] + adds == need)
            relabel = todo & ~drop & ~add & ~keep
            for chosen, letter in ((drop, b"D"), (add, b"I"), (keep, b"K"), (relabel, b"R")):
                letters[at][chosen] = letter[0]
            state = np.where(add | relabel, TURN[state], np.where(keep, to, state))
            todo = add
            at += 1
    for _ in range(2):
        add = END[state] > 0
        letters[at][add] = ord("I")
        state = np.where(add, TURN[state], state)
        at += 1
    made = letters[:at].T
    return back[0, 0], [row[row > 0].tobytes() for row in made]


def _facts(conv: np.ndarray, n: int, turn: np.ndarray, no_turn: np.ndarray, code: np.ndarray, ha: np.ndarray, hb: np.ndarray):
    """Facts and edits of n whole conversations; conv is each turn's conversation number, ascending. Gone turns are left out."""
    live = (code & GONE) == 0
    conv, turn, no_turn, code, ha, hb = (x[live] for x in (conv, turn, no_turn, code, ha, hb))
    tally = lambda which: np.bincount(conv[which], minlength=n).astype(np.int64)
    order = np.lexsort((hb, ha, conv))
    again = np.zeros(len(conv), bool)
    again[order[1:]] = (np.diff(conv[order]) == 0) & (ha[order][1:] == ha[order][:-1]) & (hb[order][1:] == hb[order][:-1])
    blank = (code & BLANK) > 0
    repeat = again & ~blank
    cut = ((code & CUT) > 0) & ~blank & ~repeat
    code = (code & 3) | np.where(cut, CUT, 0) | np.where(blank | repeat, MUST, 0)

    same = np.diff(conv) == 0
    pair = (code[:-1] & 3) * 4 + (code[1:] & 3)
    illegal = np.zeros(len(conv), bool)
    illegal[1:] = same & ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))

    gaps = np.zeros(n, np.int64)
    told = np.flatnonzero(~no_turn)
    if len(told):
        c, t = conv[told], turn[told]
        new = np.r_[True, np.diff(c) != 0]
        first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:] - 1, len(c) - 1]
        distinct = np.add.reduceat((new | np.r_[True, np.diff(t) != 0]).astype(np.int64), first)
        gaps[c[first]] = t[last] - t[first] + 1 - distinct

    lengths = tally(slice(None))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    cost, audit = np.zeros(n, np.int64), [b""] * n
    size = np.where(lengths > 0, np.ceil(np.log2(np.maximum(lengths, 1))).astype(int), -1)
    for s in np.unique(size[size >= 0]):
        alike = np.flatnonzero(size == s)
        longest = int(lengths[alike].max())
        step = max(1, CELLS // longest)
        for k in range(0, len(alike), step):
            some = alike[k : k + step]
            codes = np.full((longest, len(some)), PAD, np.uint8)
            column = np.repeat(np.arange(len(some)), lengths[some])
            place = np.arange(len(column)) - np.repeat(np.r_[0, np.cumsum(lengths[some])[:-1]], lengths[some])
            codes[place, column] = code[np.repeat(starts[some], lengths[some]) + place]
            least, found = edits_of(codes)
            cost[some] = least
            for c, a in zip(some, found):
                audit[c] = a
    return [gaps, tally(blank), tally(repeat), tally(cut), tally(illegal), cost], audit


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    keys = ["conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions(*keys)


def edits(turns: DataFrame) -> DataFrame:
    """conv_id, facts (array of the values named in FACTS), audit. turns: conv_id, turn, role, text, and gone for
    rows that only name their conversation."""
    schema = "conv_id long, facts array<bigint>, audit string"

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def result(upto: int | None):
            whole = [np.concatenate(x) for x in zip(*held)]
            new = np.r_[True, (np.diff(whole[0]) != 0) | (np.diff(whole[1]) != 0)]
            end = len(new) if upto is None else int(np.flatnonzero(new)[-1])  # the last conversation may go on
            held[:] = [] if upto is None else [tuple(x[end:] for x in whole)]
            if not end:
                return None
            ids, no_id, turn, no_turn, code, ha, hb = (x[:end] for x in whole)
            starts = np.flatnonzero(new[:end])
            facts, audit = _facts(np.cumsum(new[:end]) - 1, len(starts), turn, no_turn, code, ha, hb)
            flat = np.stack(facts, axis=1)
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * len(FACTS))
            return pa.RecordBatch.from_arrays([pa.array(ids[starts], mask=no_id[starts] > 0), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())), pa.array(audit, pa.binary()).cast(pa.string())], ["conv_id", "facts", "audit"])

        rows, most = 0, HELD
        for batch in batches:
            if not batch.num_rows:
                continue
            told = [batch.column(i) for i in range(5)]
            ids, turn = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in told[:2])
            none = [c.is_null().to_numpy(zero_copy_only=False) for c in told[:2]]
            held.append((ids, none[0].astype(np.int8), turn, none[1], *(c.to_numpy(zero_copy_only=False) for c in told[2:])))
            rows += batch.num_rows
            if rows >= most:
                if (made := result(rows)) is not None:
                    yield made
                rows = sum(len(x[0]) for x in held)
                most = max(HELD, 2 * rows)  # one long conversation is not gathered anew at each batch
        if held and (made := result(None)) is not None:
            yield made

    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code += F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(BLANK)
    code += F.when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(CUT)
    code += F.when(F.col("gone"), GONE).otherwise(0)
    hashes = [F.xxhash64("role", "text").alias("ha"), F.xxhash64(F.lit("lorekeep"), "text", "role").alias("hb")]
    narrow = _in_order(turns).select("conv_id", "turn", code.cast("int").alias("code"), *hashes)
    return narrow.mapInArrow(run, schema)


def applied(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns in order within partitions: conv_id, edit, role, text, facts. A row with edit '' opens each
    conversation and holds its facts and, as text, its audit; deleted turns are left out."""
    schema = "conv_id long, edit string, role string, text string, facts array<bigint>"
    heads = found.select("conv_id", F.lit(0).alias("k"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), "facts")
    rows = turns.where(~F.col("gone")).select("conv_id", F.lit(1).alias("k"), "turn", "role", "text", F.lit(None).cast("array<bigint>").alias("facts"))

    def run(batches):
        import pyarrow as pa

        conv, audit, at, state = None, "", 0, 0
        out: list[tuple] = []

        def inserts():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                out.append((conv, "I", ROLES[state], "", None))
                at, state = at + 1, int(TURN[state])

        def table():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())))], ["conv_id", "edit", "role", "text", "facts"])
            out.clear()
            return made

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for c, k, role, text, facts in zip(*(x.to_pylist() for x in batch.slice(start, 1024).columns)):
                    inserts()
                    if k == 0:
                        conv, audit, at, state = c, text, 0, 0
                        out.append((c, "", None, text, facts))
                        continue
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = int(AFTER[state, "sua".index(role[0])])
                        out.append((c, "K", role, text, None))
                    elif edit == "R":
                        out.append((c, "R", ROLES[state], text, None))
                        state = int(TURN[state])
                if out:
                    yield table()
        inserts()
        if out:
            yield table()

    return _in_order(heads.unionByName(rows), "k").select("conv_id", "k", "role", "text", "facts").mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of applied(): its facts, audit and the digest of its repaired turns."""
    schema = ", ".join(["conv_id long", *(f"{n} long" for n in FACTS), "audit string", "repaired_sha256 string"])

    def run(batches):
        import pyarrow as pa

        head, state, turns, rows = None, None, 0, []

        def table():
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 6 else pa.int64()) for i, c in enumerate(zip(*rows))], ["conv_id", *FACTS, "audit", "repaired_sha256"])
            rows.clear()
            return made

        for batch in batches:
            for conv, edit, role, text, facts in zip(*(x.to_pylist() for x in batch.columns)):
                if edit == "":
                    if head:
                        rows.append((*head, state.hexdigest()))
                    head, state, turns = (conv, *facts, text), hashlib.sha256(), 0
                else:
                    state.update((("\n" if turns else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    turns += 1
            if len(rows) >= 4096:
                yield table()
        if head:
            rows.append((*head, state.hexdigest()))
            yield table()

    return repaired.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: each turn damaged by the checksum of its `conv_id:turn`."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("_by")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), told("role").alias("role"), told("text").alias("text"), by)
    by = F.col("_by")
    text = F.when(by == 1, "").when(by == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(by == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(by == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (by == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def repair(turns: DataFrame) -> DataFrame:
    """Repaired turns (conv_id, edit, role, text) of a table of conv_id, turn, role, text, in order within partitions."""
    told = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    live = turns.select("conv_id", "turn", told("role"), told("text"), F.lit(False).alias("gone"))
    return applied(live, edits(live)).where("edit <> ''").drop("facts")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by rule, and their cheapest repairs."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(applied(rows, edits(rows)))


def _least(*candidates: str) -> str:
    return f"list_sort([{', '.join(candidates)}])[1]"


_AHEAD = "{{'c': {v}[tn[q]].c + 3, 'a': 'I' || {v}[tn[q]].a, 'x': ro[q] || ':' || chr(10) || {v}[tn[q]].x}}"
#: crc32 bit by bit, then the same program as a recursion over the turns, last first; a value is (cost, edits, repaired turns).
OP11_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::UBIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::UBIGINT)),
             lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) % 20 AS h
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE h <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM o),
r AS (
  SELECT *, blank OR again AS must, CASE WHEN cut THEN 3 ELSE 0 END AS more,
         CASE i WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS nx,
         [3, 3, 4, 3] AS tn, ['user', 'user', 'assistant', 'user'] AS ro
  FROM f),
c AS (
  SELECT id AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (WHERE pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id AS id FROM k) LEFT JOIN r ON conv_id IS NOT DISTINCT FROM id AND pos IS NOT NULL
  GROUP BY id),
p(conv_id, t, v) AS (
  SELECT id, coalesce(n, 0), [{{'c': 0, 'a': '', 'x': ''}}, {{'c': 6, 'a': 'II', 'x': 'user:' || chr(10) || 'assistant:' || chr(10)}},
                 {{'c': 3, 'a': 'I', 'x': 'assistant:' || chr(10)}}, {{'c': 0, 'a': '', 'x': ''}}]
  FROM (SELECT DISTINCT conv_id AS id FROM k) LEFT JOIN (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id) ON conv_id IS NOT DISTINCT FROM id
  UNION ALL
  SELECT conv_id, t - 1, list_transform([1, 2, 3, 4], lambda q: {_least("b[q]", _AHEAD.format(v="once"))})
  FROM (
    SELECT *, list_transform([1, 2, 3, 4], lambda q: {_least("b[q]", _AHEAD.format(v="b"))}) AS once
    FROM (
      SELECT p.conv_id, p.t, r.tn, r.ro, list_transform([1, 2, 3, 4], lambda q: {_least(
        "{'c': v[q].c + 4, 'a': 'D' || v[q].a, 'x': v[q].x}",
        "{'c': v[greatest(nx[q], 1)].c + more + CASE WHEN must OR nx[q] = 0 THEN 1000000000 ELSE 0 END, 'a': 'K' || v[greatest(nx[q], 1)].a, 'x': role || ':' || text || chr(10) || v[greatest(nx[q], 1)].x}",
        "{'c': v[tn[q]].c + 3 + more + CASE WHEN must THEN 1000000000 ELSE 0 END, 'a': 'R' || v[tn[q]].a, 'x': ro[q] || ':' || text || chr(10) || v[tn[q]].x}")}) AS b
      FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.t)))
SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, v[1].c::BIGINT AS cost, v[1].a AS audit, sha256(left(v[1].x, length(v[1].x) - 1)) AS repaired_sha256
FROM p LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id WHERE t = 0
"""
