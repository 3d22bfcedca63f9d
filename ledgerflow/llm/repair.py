"""Repair of conversations: faults of rows, and the cheapest edits that give a dialogue in which
user and assistant take turns, found as shortest paths by auction."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.sources.readers import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
BLANKS = " \t\n\x0b\x0c\r"
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 18
BATCH_BLOCKS, BATCH_CHARS = 1000, 4 << 20
FAR = 1 << 40  # distance to what can't be reached
SPREAD, LOST = 100, 1000  # two insertions lead to any turn, so prices that count differ by 10 at most; beyond stands LOST

START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired dialogue ends with so far
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
FORCED, WHOLE, CUT = range(3)  # what a row is worth: to be deleted, without fault, truncated

COUNTS = ("blank", "duplicate", "truncated", "illegal")
STATS = ", ".join(f"{c} long" for c in COUNTS) + ", head string, tail string, lo long, hi long, turns long"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---- the lattice -----------------------------------------------------------------------------


def follow(state: int) -> int:
    """The state behind the next role of a dialogue: assistant behind user, else user."""
    return ASSISTANT if state == USER else USER


def auction(arcs: list[list[tuple[int, int]]], prices: list[int], settled: set[int], origin: int) -> None:
    """Exact prices (distances to the goal) along a shortest path from ``origin``.

    ``arcs[i]`` are the (cost, node) out of node i. No price may exceed cost plus price behind any
    arc. A path starts at the origin; its last node raises its price to the cheapest way on and
    leaves the path (contraction), or, if its price is that already, the path goes on there
    (extension). It ends at a settled node, and then all its nodes are settled. Cycles have
    positive costs, so prices rise until that happens."""
    path = [origin]
    while path[-1] not in settled:
        node = path[-1]
        price, to = min((cost + prices[t], t) for cost, t in arcs[node])
        if prices[node] < price:
            prices[node] = price
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    settled.update(path)


@lru_cache(maxsize=1 << 16)
def layer(initial: str, worth: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Prices of the four states before a row, given those behind it, and for each state the edits
    up to and with that row and the state they lead to: of the tight arcs (cost plus price
    behind equals price) always the least in ASCII. Every state is an origin, so all prices are
    exact and every tight arc lies on a shortest path."""
    ways: list[dict[str, tuple[int, int]]] = []  # by state: edit -> (cost, node); nodes 4.. lie behind the row
    for state in range(4):
        out = {"I": (INSERT, follow(state))}
        if worth is None:
            if state in (START, ASSISTANT):
                out["."] = (0, 4)
        else:
            out["D"] = (DELETE, 4 + state)
            if worth != FORCED:
                extra = TRUNCATED if worth == CUT else 0
                out["R"] = (REROLE + extra, 4 + follow(state))
                if initial == "s" and state == START:
                    out["K"] = (KEEP + extra, 4 + SYSTEM)
                elif initial == ("a" if state == USER else "u"):
                    out["K"] = (KEEP + extra, 4 + follow(state))
        ways.append(out)
    arcs = [list(out.values()) for out in ways]
    prices, settled = [0] * 4 + list(behind), set(range(4, 4 + len(behind)))
    for state in range(4):
        auction(arcs, prices, settled, state)
    exits = []
    for state in range(4):
        edits, node = "", state
        while node < 4:
            edit = min(e for e, (cost, to) in ways[node].items() if cost + prices[to] == prices[node])
            edits, node = edits + edit, ways[node][edit][1]
        exits.append((edits, node - 4))
    return tuple(prices[:4]), tuple(exits)


GOAL = layer("", None, (0,))[0]


def near(prices: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The least price, and all prices relative to it."""
    least = min(prices)
    return least, tuple(p - least if p - least < SPREAD else LOST for p in prices)


def prices_before(kinds: list[tuple[str, int, int]], behind: tuple[int, ...], layers: list | None = None) -> tuple[int, ...]:
    """Prices before rows (initial, worth, copies) given those behind; ``layers`` collects the exits of
    each row, last row first. Copies after the first are to be deleted, which shifts all
    prices; an insertion among them is never less than one behind them."""
    base, rest = near(behind)
    for initial, worth, copies in reversed(kinds):
        base += DELETE * (copies - (worth != FORCED))
        if worth == FORCED:
            exits = None
        else:
            rest, exits = layer(initial, worth, rest)
            more, rest = near(rest)
            base += more
        if layers is not None:
            layers.append(exits)
    return tuple(p + base if p < SPREAD else FAR for p in rest)


def crossing(kinds: list[tuple[str, int, int]]) -> list[int]:
    """Distances from the states before rows to those behind them, 16 of them by rows."""
    columns = [prices_before(kinds, tuple(0 if s == t else FAR for s in range(4))) for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def over_blocks(matrices: list[list[int]], goal: tuple[int, ...] = GOAL) -> list[tuple[int, ...]]:
    """Prices behind each block of a conversation, and before the first: an auction in which a
    block's distances are the arcs of one layer."""
    out = [goal]
    for m in reversed(matrices):
        least, rest = near(out[-1])
        prices, settled = [0] * 4 + list(rest), set(range(4, 8))
        for s in range(4):
            auction([[(m[4 * i + t], 4 + t) for t in range(4) if m[4 * i + t] < FAR] for i in range(4)], prices, settled, s)
        out.append(tuple(p + least for p in prices[:4]))
    return out[::-1]


def trace(kinds: list[tuple[str, int, int]], exits: list, state: int, last: bool) -> tuple[list[str], int]:
    """Edits row by row (those after the last row of a conversation as one more) and the state behind."""
    out = []
    for (_, worth, copies), ways in zip(kinds, reversed(exits)):
        edits = ""
        if worth != FORCED:
            edits, state = ways[state]
        out.append(edits + "D" * (copies - (worth != FORCED)))
    if last:
        edits = layer("", None, (0,))[1][state][0].rstrip(".")
        out.append(edits)
        for _ in edits:
            state = follow(state)
    return out, state


def dialogue(rows: list[tuple[str, str]], edits: list[str], state: int) -> str:
    """The repaired ``role:text`` lines of rows (role, text) under ``trace``'s edits."""
    lines = []
    for (role, text), own in zip([*rows, ("", "")], edits):
        for edit in own:
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = SYSTEM if role[0] == "s" else follow(state)
            elif edit in "RI":
                state = follow(state)
                lines.append(f"{ROLES[state]}:{text if edit == 'R' else ''}")
    return "\n".join(lines)


# ---- the tables ------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of (conv_id, turn, role, text) after damage by
    crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes out its [.!?], 3 gives
    it twice, 4 makes it the user's. Nulls are one space there and in role and text."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("way"))
    return rows.filter("way <> 0").select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("way") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faults(turns: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with their number of ``copies``, and whether they are
    ``blank``, ``again`` (role and text stand in an earlier turn) or ``cut`` (no [.!?] at the end).

    Equal rows are counted per task first. Equal texts of a conversation meet as digests, and
    only those of several turns are joined back."""
    keys = ["conv_id", "turn", "role", "text"]
    own = turns.groupBy(*keys).agg(F.sum("copies").alias("copies")).withColumn("sha", F.sha2("text", 256))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    several = own.groupBy("conv_id", "role", "sha").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    several = materialise(several.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), "first"))
    match = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    end = F.rtrim("text", F.lit(BLANKS))
    return own.join(several, match, "left").select(
        *keys, "copies", (end == "").alias("blank"), F.coalesce(order > F.col("first"), F.lit(False)).alias("again"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int, block_chars: int) -> Iterator[dict]:
    """Blocks of a task's rows in their order, each of one conversation."""
    number = TaskContext.get().partitionId() << 32
    block, size = None, 0
    for batch in batches:
        for conv, turn, role, text, copies, blank, again, cut in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None or block["conv_id"] != conv or len(block["kinds"]) >= block_rows or size >= block_chars:
                if block is not None:
                    yield block
                number, size = number + 1, 0
                block = {"conv_id": conv, "block": number, "roles": [], "texts": [], "copies": [], "kinds": bytearray(), "head": role[:1], "lo": turn, "turns": 0, "hi": None, "tail": None}
                block |= dict.fromkeys(COUNTS, 0)
            alive = not (blank or again)
            worth = (CUT if cut else WHOLE) if alive else FORCED
            block["kinds"].append(worth)
            block["roles"].append(role if alive else role[:1])
            block["texts"].append(text if alive else "")
            block["copies"].append(copies)
            block["blank"] += copies if blank else 0
            block["duplicate"] += 0 if blank else copies - alive
            block["truncated"] += worth == CUT
            initial = role[:1]
            block["illegal"] += copies - 1 + (block["tail"] is not None and block["tail"] + initial not in LEGAL)
            block["tail"] = initial
            if turn is not None:
                block["turns"] += turn != block["hi"]
                block["lo"] = turn if block["lo"] is None else block["lo"]
                block["hi"] = turn
            size += len(text) if alive else 0
    if block is not None:
        yield block


def _map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], columns: str) -> DataFrame:
    """mapInArrow with a function that gives rows; ``columns`` follow conv_id, whose type stays."""
    ddl = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {columns}"
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    rest = [(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))]

    def mapped(batches):
        kind = []

        def seen():
            for batch in batches:
                kind[:] = [batch.schema.field("conv_id").type]
                yield batch

        held, size = [], 0
        for row in fn(seen()):
            held.append({k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.items()})
            size += sum(map(len, row.get("texts", ()))) + len(row.get("lines") or "") + len(row.get("audit") or "")
            if len(held) >= BATCH_BLOCKS or size >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(held, pa.schema([("conv_id", kind[0]), *rest]))
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema([("conv_id", kind[0]), *rest]))

    return df.mapInArrow(mapped, ddl)


def _kinds(row: dict) -> list[tuple[str, int, int]]:
    return [(r[:1], w, n) for r, w, n in zip(row["roles"], row["kinds"], row["copies"])]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _whole(row: dict, kinds: list, exits: list, entry: int, last: bool) -> dict:
    edits, state = trace(kinds, exits, entry, last)
    return {"audit": "".join(edits), "lines": dialogue(list(zip(row["roles"], row["texts"])), edits, entry), "exit": state}


def _result(parts: Iterator[dict]) -> dict:
    """One conversation's row from its blocks in order; of the lines only the digest is held."""
    digest, some, audit, before, out = hashlib.sha256(), False, [], None, dict.fromkeys((*COUNTS, "cost"), 0)
    lo = hi = None
    turns = 0
    for p in parts:
        if p["lines"]:
            digest.update((("\n" if some else "") + p["lines"]).encode())
            some = True
        audit.append(p["audit"])
        for c in (*COUNTS, "cost"):
            out[c] += p[c]
        out["illegal"] += before is not None and before + p["head"] not in LEGAL
        before = p["tail"]
        turns += p["turns"] - (hi is not None and p["lo"] == hi)
        lo, hi = p["lo"] if lo is None else lo, hi if p["hi"] is None else p["hi"]
        out["conv_id"] = p["conv_id"]
    return out | {"gaps": 0 if lo is None else hi - lo + 1 - turns, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def _short(batches):
    for row in _rows(batches):
        kinds, exits = _kinds(row), []
        prices = prices_before(kinds, GOAL, exits)
        yield _result([row | _whole(row, kinds, exits, START, True) | {"cost": prices[START]}])


def _crossings(batches):
    for row in _rows(batches):
        yield {"conv_id": row["conv_id"], "block": row["block"], "matrix": crossing(_kinds(row))}


def _ways(batches):
    """For each block and each state before it the state behind it."""
    for row in _rows(batches):
        kinds, exits = _kinds(row), []
        prices_before(kinds, tuple(row["behind"]), exits)
        yield {"conv_id": row["conv_id"], "block": row["block"], "exits": [trace(kinds, exits, s, False)[1] for s in range(4)]}


def _pieces(batches):
    for row in _rows(batches):
        kinds, exits = _kinds(row), []
        behind = tuple(row["behind"])
        prices = prices_before(kinds, behind, exits)
        last = bool(row["last"])
        piece = _whole(row, kinds, exits, row["entry"], last)
        yield {k: row[k] for k in ("conv_id", "block", *COUNTS, "head", "tail", "lo", "hi", "turns")} | {
            "audit": piece["audit"], "lines": piece["lines"], "cost": prices[row["entry"]] - (0 if last else behind[piece["exit"]])
        }


def _folded(batches):
    """Conversations of rows sorted by (conv_id, block), read one block at a time."""
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        conv, ahead = row["conv_id"], []

        def own(first):
            yield first
            for r in rows:
                if r["conv_id"] != conv:
                    ahead.append(r)
                    return
                yield r

        yield _result(own(row))
        row = ahead[0] if ahead else None


def _behind(table: pa.Table) -> pa.Table:
    """Prices behind each block of a conversation, from the distances across its blocks."""
    table = table.sort_by("block")
    prices = over_blocks(table.column("matrix").to_pylist())[1:]
    last = [0] * (len(prices) - 1) + [1]
    return table.select(["conv_id", "block"]).append_column("behind", pa.array(prices, pa.list_(pa.int64()))).append_column("last", pa.array(last, pa.int32()))


def _entries(table: pa.Table) -> pa.Table:
    table, state, out = table.sort_by("block"), START, []
    for exits in table.column("exits").to_pylist():
        out.append(state)
        state = exits[state]
    return table.select(["conv_id", "block"]).append_column("entry", pa.array(out, pa.int32()))


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies), a row standing for ``copies``
    equal ones: gaps (missing turn numbers), blank, duplicate, truncated (rows by their first fault),
    illegal (adjacent roles), cost and audit of the cheapest edits, repaired_sha256.

    Rows go by (turn, role, text), null turns first. Edits: K keep (0), R make it user or assistant
    (1), D delete (2; required where blank or duplicate), I insert an empty turn of user or
    assistant (5); a truncated row that stays costs 5 more. The result has role initials
    (s?(ua)+)?; of equally cheap edits the least initials in ASCII are taken. Null conversation
    ids are one conversation; an empty table has no rows; other columns are not read.

    The rows are sorted over the cluster, also within a conversation, and cut to blocks of at most
    ``block_rows`` rows. A conversation in one block is solved there. Of others, the 16 distances
    across each block are found first; an auction over blocks gives the prices behind each; the
    ways through every block for each state before it give the state in which the best way
    enters it; then each block is traced on its own, and the pieces are read in order, one at
    a time, for the digest. What is held of a conversation in one task is 16 numbers a block.
    """
    seen = faults(turns)
    order = ["conv_id", "turn", "role", "text"]
    arrays = "block long, roles array<string>, texts array<string>, copies array<long>, kinds binary"
    blocks = materialise(_map(seen.repartitionByRange(*order).sortWithinPartitions(*order), lambda b: _blocks(b, block_rows, block_chars), f"{arrays}, {STATS}"))
    kind = blocks.schema["conv_id"].dataType.simpleString()

    many = materialise(blocks.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("c")))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = _map(blocks.join(many, same, "left_anti"), _short, RESULT)

    long = materialise(blocks.join(many, same, "left_semi"))

    def with_blocks(facts: DataFrame) -> DataFrame:
        names = [c for c in facts.columns if c not in ("conv_id", "block")]
        facts = facts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *names)
        return long.join(facts, same & (F.col("block") == F.col("b"))).drop("c", "b")

    matrices = _map(long, _crossings, "block long, matrix array<long>")
    behind = materialise(matrices.groupBy("conv_id").applyInArrow(_behind, f"conv_id {kind}, block long, behind array<long>, last int"))
    exits = _map(with_blocks(behind), _ways, "block long, exits array<int>")
    entries = exits.groupBy("conv_id").applyInArrow(_entries, f"conv_id {kind}, block long, entry int")
    known = behind.join(
        entries.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry"), same & (F.col("block") == F.col("b"))
    ).drop("c", "b")
    pieces = _map(with_blocks(materialise(known)), _pieces, f"block long, {STATS}, audit string, lines string, cost long")
    folded = _map(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block"), _folded, RESULT)
    return short.unionByName(folded)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conversation that there was before: one of
    which no row is left has zeros, an empty audit and the digest of nothing."""
    done = repair(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    columns = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *columns, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


# ---- the same in SQL -------------------------------------------------------------------------


def _edit(state: str, label: str, cost: str, text: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{label}', 't': {state}.t || {text}}}"


def _sql() -> str:
    far = "{'c': 1000000000, 'a': '', 't': ''}"

    def taken(initial: str, role: str, *states: str) -> str:
        """Keeping the row if it has that initial, else giving it that role."""
        own = [f"CASE WHEN NOT r.forced AND r.h = '{initial}' THEN {_edit(z, 'K', 'r.extra', 'chr(10) || r.role || chr(58) || r.text')} ELSE {far} END" for z in states]
        if role:
            own += [f"CASE WHEN NOT r.forced THEN {_edit(z, 'R', '1 + r.extra', f'chr(10) || {role!r} || chr(58) || r.text')} ELSE {far} END" for z in states]
        return ", ".join(own)

    behind = f"""SELECT s.conv_id, s.i + 1 AS i, {_edit('s.z0', 'D', '2')} AS s0,
        least({_edit('s.z1', 'D', '2')}, {taken('s', '', 's.z0')}) AS s1,
        least({_edit('s.z2', 'D', '2')}, {taken('u', 'user', 's.z0', 's.z1', 's.z3')}) AS s2,
        least({_edit('s.z3', 'D', '2')}, {taken('a', 'assistant', 's.z2')}) AS s3
        FROM best s JOIN faults r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1"""

    def inserted(rows: str) -> str:
        user = ", ".join(_edit(z, "I", "5", "chr(10) || 'user:'") for z in ("s0", "s1", "s3"))
        assistant = _edit("y", "I", "5", "chr(10) || 'assistant:'")
        first = f"SELECT conv_id, i, s0, s1, s3, least(s2, {user}) AS y FROM ({rows}) AS before_users"
        return f"SELECT conv_id, i, s0 AS z0, s1 AS z1, y AS z2, least(s3, {assistant}) AS z3 FROM ({first}) AS before_assistants"

    start = f"SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM faults"
    return f"""
WITH RECURSIVE own AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(k, '')]), lambda c, b:
        list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y:
            CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS way
    FROM own
), damaged AS (
    SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
           CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE way <> 0
), placed AS (
    SELECT *, left(role, 1) AS h, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), marked AS (
    SELECT *, shown = '' AS blank, shown <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           lag(h) OVER (PARTITION BY conv_id ORDER BY i) || h AS two
    FROM placed
), faults AS (
    SELECT *, blank OR again AS forced, NOT blank AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS cut,
           CASE WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra
    FROM marked
), best AS (
    {inserted(start)} UNION ALL {inserted(behind)}
), counted AS (
    SELECT conv_id, max(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
), done AS (
    SELECT c.*, least(b.z0, b.z3) AS z FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.rows
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.c, 0)::BIGINT AS cost,
       coalesce(z.a, '') AS audit, sha256(coalesce(substr(z.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM own) o LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
