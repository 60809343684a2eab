"""Conversation repair with a suffix-shared automaton.

A row of a conversation is one symbol: the initial of its role (u, a, s or another) and its first fault (blank, seen
before, cut off). A conversation is a string of symbols, its signature. The cheapest edits that bring the roles into the
form (s?(ua)+)? are

    Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit of blank and repeated rows), Insert an empty text 2;
    a cut-off row that stays costs 1 more.

* Damaged rows never travel with their texts until the last step: order and faults need digests alone. They are dealt
  by ranges of (conversation, order), so a long conversation lies in several tasks, each of which writes its pieces.
* Every distinct signature is planned once. Read from the end, signatures form an automaton whose nodes are the distinct
  suffixes: with the reversed signatures sorted, what two neighbours share is the path that is still on the stack, so a
  task keeps one path and makes a node once, whichever conversations run through it. A node holds, for each of the four
  grammar states, the cost to go and the first letter of the best audit from there.
* Letters compare as characters, and from a node and a state each letter leads to one place alone; two audits of equal
  cost are never a prefix of one another. So the ASCII-least audit takes the least letter among those of least cost at
  each step, and no suffix is copied.
* Plans and rows meet in one sorted stream per conversation, which is hashed as it comes, so a conversation of any size
  needs no memory beyond a batch and its audit, which is a value of the result.

Cases: null conversation ids are a conversation of their own; null roles and texts are one blank; a null turn comes
first and counts in no gap. Rows of one turn are ordered by role and SHA-256 of the text before damage, a repeated row
beside its copy; equal rows are all kept. A role that is empty has no initial and cannot be kept, like any other than u,
a or s. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join

BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "uas"  # any other is the fourth class
FAULTS = ("", "blank", "duplicate", "truncated")
ROLES = {"u": "user", "a": "assistant"}
PIECE = 4096

# grammar states: nothing yet, after s, after u, after a; an audit may end in the first and the last
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_TURN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # what a new role must be
NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1


def _symbol(initial: Column, fault: Column) -> Column:
    role = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    return F.char(role * 4 + fault + ord("A"))


def _role_fault(symbol: str) -> tuple[str, str]:
    k = ord(symbol) - ord("A")
    return (INITIALS + "-")[k // 4], FAULTS[k % 4]


def _insertions(costs: list[int], letters: list[str]) -> None:
    """Two inserts in a row are the most that can pay."""
    for _ in range(2):
        for state in range(4):
            c = INSERT + costs[_NEXT[state][_TURN[state]]]
            if c < costs[state] or (c == costs[state] and "I" < letters[state]):
                costs[state], letters[state] = c, "I"


def end_node() -> tuple[tuple[int, ...], str]:
    costs, letters = [0, NEVER, NEVER, 0], ["", "", "", ""]
    _insertions(costs, letters)
    return tuple(costs), "".join(x or "." for x in letters)


def before(symbol: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """The node in front of one with these costs."""
    role, fault = _role_fault(symbol)
    new, letters = [], []
    for state in range(4):
        options = [(DELETE + costs[state], "D")]
        if fault not in ("blank", "duplicate"):
            cut = CUT if fault == "truncated" else 0
            if role in _NEXT[state]:
                options.append((KEEP + cut + costs[_NEXT[state][role]], "K"))
            options.append((REROLE + cut + costs[_NEXT[state][_TURN[state]]], "R"))
        c, letter = min(options)
        new.append(c)
        letters.append(letter)
    _insertions(new, letters)
    return tuple(new), "".join(letters)


@dataclass
class Automaton:
    """The path of the last signature, from the end: costs and letters of four states a node."""

    symbols: str = ""  # reversed
    costs: array = field(default_factory=lambda: array("q"))
    letters: bytearray = field(default_factory=bytearray)
    made: int = 0
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        costs, letters = end_node()
        self.costs.extend(costs)
        self.letters += letters.encode()

    def path(self, backwards: str) -> None:
        """Keep the nodes of the common suffix and make those of the rest."""
        shared, most = 0, min(len(self.symbols), len(backwards))
        while shared < most and self.symbols[shared:shared + 64] == backwards[shared:shared + 64]:
            shared = min(most, shared + 64)
        while shared < most and self.symbols[shared] == backwards[shared]:
            shared += 1
        del self.costs[4 * (shared + 1):], self.letters[4 * (shared + 1):]
        costs = tuple(self.costs[4 * shared:])
        for symbol in backwards[shared:]:
            least = min(costs)
            key = symbol, tuple(c - least for c in costs)  # few differences occur, so few nodes are computed
            if key not in self.known:
                self.known[key] = before(*key)
            more, letters = self.known[key]
            costs = tuple(least + c for c in more)
            self.costs.extend(costs)
            self.letters += letters.encode()
        self.made += len(backwards) - shared
        self.symbols = backwards

    def plan(self) -> tuple[int, str]:
        """(cost, audit) of the whole signature."""
        node, state, out = len(self.symbols), START, []
        while True:
            letter = chr(self.letters[4 * node + state])
            if letter == ".":
                return self.costs[4 * len(self.symbols) + START], "".join(out)
            out.append(letter)
            if letter == "K":
                state = _NEXT[state][_role_fault(self.symbols[node - 1])[0]]
            elif letter != "D":
                state = _NEXT[state][_TURN[state]]
            node -= letter != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """(k, conv_id, turn, role, text, place, dropped): rows by crc32(conv_id:turn) % 20; `place` orders the rows of a turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    c = conversations.select(conv, turn, F.coalesce("role", F.lit(" ")).alias("was"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    c = c.withColumn("h", F.crc32(key.cast("binary")) % 20).withColumn("digest", F.sha2("text", 256))
    c = c.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return c.select(
        F.concat(F.when(conv.isNull(), "n").otherwise("v"), F.coalesce(conv.cast("string"), F.lit(""))).alias("k"), conv, turn,
        F.when(F.col("h") == 4, "user").otherwise(F.col("was")).alias("role"), text.alias("text"),
        F.struct(turn, F.col("was"), F.col("digest"), F.col("copy")).alias("place"), (F.col("h") == 0).alias("dropped"))


def _tuples(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)


def signatures(rows: DataFrame) -> DataFrame:
    """(k, signature) of every conversation of `rows` (k, role, text, place)."""
    kept = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(kept == "", 1).when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    s = rows.select("k", "place", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), F.sha2(F.concat("role", F.lit(":"), "text"), 256).alias("digest"))
    # rows of one place are equal: one of them with their number
    s = s.groupBy("k", "place").agg(F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("initial", "fault", "digest")])
    again = s.where("fault <> 1").groupBy("k", "digest").agg(F.count(F.lit(1)).alias("places"), F.min("place").alias("first")).where("places > 1").drop("places")
    s = spread_join(s, again, ["k", "digest"], "left", salt_by=["place"])
    fault = F.when((F.col("fault") != 1) & (F.col("place") > F.col("first")), 2).otherwise(F.col("fault"))
    s = s.select("k", "place", "n", _symbol(F.col("initial"), fault).alias("symbol"), _symbol(F.col("initial"), F.when(F.col("fault") == 1, 1).otherwise(2)).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        key, piece, size = None, [], 0

        def out():
            return pa.RecordBatch.from_pydict({"k": pa.array([key], pa.string()), "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "piece": ["".join(piece)]})

        for b in batches:
            for k, n, symbol, more in _tuples(b):
                if piece and (k != key or size >= PIECE):
                    yield out()
                    seq, piece, size = seq + 1, [], 0
                key, size = k, size + n
                piece.append(symbol + more * (n - 1))
        if piece:
            yield out()

    order = s.repartitionByRange("k", "place").sortWithinPartitions("k", "place").select("k", "n", "symbol", "more")
    pieces = order.mapInArrow(run, "k string, part int, seq long, piece string")
    listed = F.array_sort(F.collect_list(F.struct("part", "seq", "piece")))
    return pieces.groupBy("k").agg(F.array_join(F.transform(listed, lambda x: x["piece"]), "").alias("signature"))


_COUNTS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(of: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit, new_nodes) of every distinct `signature`; the sum of
    `new_nodes` is the size of the automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, legal = Automaton(), {"su", "ua", "au"}
        classes = {chr(ord("A") + k): (INITIALS + "-")[k // 4] for k in range(16)}
        for b in batches:
            out = []
            for signature in b.column(0).to_pylist():
                had = automaton.made
                automaton.path(signature[::-1])
                roles = "".join(map(classes.__getitem__, signature))
                faults = [sum(signature.count(chr(ord("A") + 4 * r + f)) for r in range(4)) for f in (1, 2, 3)]
                out.append((signature, *faults, sum(x + y not in legal for x, y in zip(roles, roles[1:], strict=False)), *automaton.plan(), automaton.made - had))
            names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "new_nodes"]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], pa.string() if n in ("signature", "audit") else pa.int64()) for i, n in enumerate(names)})

    distinct = of.select("signature").distinct().withColumn("backwards", F.reverse("signature"))
    return (distinct.repartitionByRange("backwards").sortWithinPartitions("backwards").select("signature")
            .mapInArrow(run, f"signature string, {_COUNTS}, new_nodes long"))


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    rows = damaged(conversations)
    alive = rows.where("not dropped")
    signature = signatures(alive)
    turns = rows.groupBy("k", "turn").agg(F.first("conv_id").alias("conv_id"), F.bool_or(~F.col("dropped")).alias("stays"))
    turn = F.when(F.col("stays"), F.col("turn"))
    spans = turns.groupBy("k").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).alias("gaps"))
    known = spread_join(signature, plans(signature).drop("new_nodes"), ["signature"], "left", salt_by=["k"]).drop("signature")
    head = spans.join(known, "k", "left").fillna(0, ["blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"])
    body = F.struct("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    stream = head.select("k", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["place"].dataType).alias("place"), body.alias("head"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = stream.unionByName(alive.select("k", F.lit(1).alias("kind"), "place", F.lit(None).cast(stream.schema["head"].dataType).alias("head"), "role", "text"))
    result = conversations.select("conv_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        head, at, state, digest, first = None, 0, START, None, True
        schema = pa.schema([("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def add(role: str, text: str) -> None:
            nonlocal first
            digest.update(("" if first else "\n").encode() + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
            first = False

        def inserted() -> None:
            nonlocal at, state
            while at < len(head["audit"]) and head["audit"][at] == "I":
                add(ROLES[_TURN[state]], "")
                state, at = _NEXT[state][_TURN[state]], at + 1

        def closed() -> dict:
            inserted()
            return head | {"repaired_sha256": digest.hexdigest()}

        for b in batches:
            out = []
            for h, role, text in _tuples(b):
                if h is not None:
                    if head is not None:
                        out.append(closed())
                    head, at, state, digest, first = h, 0, START, sha256(), True
                    continue
                inserted()
                letter = head["audit"][at]
                at += 1
                if letter == "K":
                    add(role, text)
                    state = _NEXT[state][role[:1]]
                elif letter == "R":
                    add(ROLES[_TURN[state]], text)
                    state = _NEXT[state][_TURN[state]]
            yield batch_of(out, b.schema.field("head").type.field("conv_id").type, schema)
            conv_type = b.schema.field("head").type.field("conv_id").type
        if head is not None:
            yield batch_of([closed()], conv_type, schema)

    def batch_of(out: list[dict], conv_type: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r[n] for n in ("conv_id", *schema.names)} for r in out], schema=pa.schema([("conv_id", conv_type), *schema]))

    sorted_rows = stream.repartition("k").sortWithinPartitions("k", "kind", "place").select("head", "role", "text")
    types = result.simpleString()[len("struct<"):-1].replace(":", " ")
    return sorted_rows.mapInArrow(run, f"{types}, gaps long, {_COUNTS}, repaired_sha256 string")


def _best(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _then(cost: str, letter: str, state: str, text: str | None = None, when: str | None = None) -> str:
    """An edit in front of what follows from a state; one that is not allowed has an endless cost."""
    fragments = f"list_prepend({text}, {state}.r)" if text else f"{state}.r"
    cost = f"CASE WHEN {when} THEN {cost} + {state}.c ELSE {NEVER} END" if when else f"{cost} + {state}.c"
    return f"{{'c': {cost}, 'a': '{letter}' || {state}.a, 'r': {fragments}}}"


_MAY_STAY = "fault NOT IN (1, 2)"
_STAYS_AS = "role || ':' || text"


def _row_options(state: str, keeps: dict[str, str], new: str, after: str) -> str:
    """Best edit of the row in one grammar state."""
    kept = [_then("(fault = 3)::BIGINT", "K", to, _STAYS_AS, f"{_MAY_STAY} AND role[1:1] = '{initial}'") for initial, to in keeps.items()]
    rerole = _then("2 + (fault = 3)::BIGINT", "R", after, f"'{new}:' || text", _MAY_STAY)
    return _best(_then("3", "D", state), *kept, rerole)


SQL = f"""
WITH RECURSIVE
source AS (SELECT conv_id, turn, coalesce(role, ' ') AS was, coalesce(text, ' ') AS text,
                  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(key[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) % 20 AS h FROM source),
alive AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE was END AS role, was, sha256(text) AS digest, copy,
                 CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM hashed, LATERAL (SELECT unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy) WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was, digest, copy) AS rn,
                  count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept FROM alive),
faulty AS (SELECT *, CASE WHEN kept = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 2
                          WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                  lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY rn) || role[1:1] AS pair FROM placed),
go AS (
  SELECT DISTINCT conv_id, n, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS q0, {{'c': 4::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}} AS q1,
         {{'c': 2::BIGINT, 'a': 'I', 'r': ['assistant:']}} AS q2, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS q3 FROM faulty
  UNION ALL
  SELECT conv_id, n, i, {_best("q0", _then("2", "I", "q2", "'user:'"))}, {_best("q1", _then("2", "I", "q2", "'user:'"))},
         {_best("q2", _then("2", "I", "q3", "'assistant:'"))}, {_best("q3", _then("2", "I", "q2", "'user:'"))}
  FROM (SELECT conv_id, n, i, {_best("q0", _then("2", "I", "q2", "'user:'"))} AS q0, {_best("q1", _then("2", "I", "q2", "'user:'"))} AS q1,
               {_best("q2", _then("2", "I", "q3", "'assistant:'"))} AS q2, {_best("q3", _then("2", "I", "q2", "'user:'"))} AS q3
        FROM (SELECT g.conv_id, g.n, g.i + 1 AS i, {_row_options("q0", {"s": "q1", "u": "q2"}, "user", "q2")} AS q0, {_row_options("q1", {"u": "q2"}, "user", "q2")} AS q1,
                     {_row_options("q2", {"a": "q3"}, "assistant", "q3")} AS q2, {_row_options("q3", {"u": "q2"}, "user", "q2")} AS q3
              FROM go g JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.rn = g.n - g.i))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.a, '') AS audit, sha256(coalesce(array_to_string(q0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN go g ON g.conv_id IS NOT DISTINCT FROM o.conv_id AND g.i = g.n
"""
