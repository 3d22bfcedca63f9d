"""Repair of conversations: the auction against all edits of short ones, blocks against one block."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from helpers import SMALL

import __spark_entry__ as entry
from ledgerflow.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if way == 1 else "".join(x for x in text if x not in ".!?") if way == 2 else text
        out += [(c, t, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def solve(rows):
    """Cheapest (cost, audit, lines) by rows and states, straight from the rules; rows (role, text, forced, cut)."""
    follow = {"": "u", "s": "u", "a": "u", "u": "a"}
    best = {"": (0, "", [])}

    def insert(best):
        for _ in range(3):
            for last, (cost, audit, lines) in list(best.items()):
                to = follow[last]
                new = (cost + 5, audit + "I", lines + [{"u": "user:", "a": "assistant:"}[to]])
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    best = insert(best)
    for role, text, forced, cut in rows:
        after = {}

        def offer(last, new):
            if last not in after or new < after[last]:
                after[last] = new

        for last, (cost, audit, lines) in best.items():
            offer(last, (cost + 2, audit + "D", lines))
            if not forced:
                extra, to = 5 * cut, follow[last]
                offer(to, (cost + 1 + extra, audit + "R", lines + [{"u": "user:", "a": "assistant:"}[to] + text]))
                if role[:1] == to or (role[:1] == "s" and last == ""):
                    offer(role[0], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
        best = insert(after)
    return min(best[k] for k in ("", "a") if k in best)


def plain(original, damaged_rows=None):
    rows = damage(original) if damaged_rows is None else damaged_rows
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for c in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == c), key=order)
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            shown = text.rstrip(BLANK)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = solve(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def dialogues(seed, n, most):
    rng = random.Random(seed)
    texts = ["Fine.", "So?", "cut off", "", " \n", "Again!", "é漢 😀.", "a\nb.", "text. \t"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice([*texts, f"own {t}.", f"own {t}", None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, b"k", 1) for r in rows], SCHEMA + ", copies int, kinds binary, block int").repartition(6)


@pytest.mark.parametrize("block_rows", [repair.BLOCK_ROWS, 2])
def test_equals_plain_version(spark, block_rows):
    rows = dialogues(3, 60, 14)
    damaged = repair.damaged(frame(spark, rows))
    want = {c: v for c, v in plain(rows).items() if c in {r[0] for r in damage(rows)}}
    assert got(repair.repair(damaged, block_rows)) == want
    if block_rows != 2:
        assert got(repair.damage_and_repair(frame(spark, rows))) == plain(rows)


def test_one_conversation_holds_the_table(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Same text.", f"own {t}.", "cut"])) for t in range(1500)]
    rows += [(7, 40, "user", "One row many times.")] * 300 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    assert got(repair.repair(repair.damaged(frame(spark, rows)), 64, 500)) == plain(rows)


def test_conversation_without_rows_left_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = got(repair.damage_and_repair(frame(spark, [(gone, 0, "user", "Hi.")])))
    assert out == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(entry.queries()["op12_conversation_repair"](spark, SMALL)) == plain(rows)


def test_every_short_dialogue():
    """All sequences of five kinds of rows up to length four, without tables."""
    kinds = [("user", "u.", False, False), ("assistant", "a.", False, False), ("system", "s.", False, False), ("tool", "t", False, True), ("user", "", True, False)]
    for n in range(5):
        for rows in product(kinds, repeat=n):
            own = [(r[:1], repair.FORCED if f else repair.CUT if c else repair.WHOLE, 1) for r, _, f, c in rows]
            exits = []
            prices = repair.prices_before(own, repair.GOAL, exits)
            edits, _ = repair.trace(own, exits, repair.START, True)
            lines = repair.dialogue([(r, t) for r, t, _, _ in rows], edits, repair.START)
            cost, audit, want = solve(rows)
            assert (prices[repair.START], "".join(edits), lines) == (cost, audit, "\n".join(want))


def test_auction_equals_relaxation():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(2, 9)
        arcs = [[(rng.randint(0 if j > i else 1, 9), j) for j in range(n) if j != i and rng.random() < 0.5] + [(rng.randint(5, 30), n - 1)] for i in range(n - 1)]
        want = [10**9] * (n - 1) + [0]
        for _ in range(n):
            want = [min([want[i], *(c + want[j] for c, j in arcs[i])]) if i < n - 1 else 0 for i in range(n)]
        prices, settled = [0] * n, {n - 1}
        for i in range(n - 1):
            repair.auction(arcs, prices, settled, i)
        assert prices == want


def test_blocks_equal_one_block():
    """Distances across blocks, composed, are those of the whole, without tables."""
    rng = random.Random(4)
    for _ in range(200):
        own = [(rng.choice("suat"), rng.choice([0, 1, 1, 1, 2]), rng.choice([1, 1, 3])) for _ in range(rng.randint(1, 30))]
        cuts = sorted({0, len(own), *(rng.randint(0, len(own)) for _ in range(4))})
        blocks = [own[a:b] for a, b in zip(cuts, cuts[1:])]
        prices = repair.over_blocks([repair.crossing(b) for b in blocks])
        exits = []
        assert prices[0] == repair.prices_before(own, repair.GOAL, exits)
        state, pieces = repair.START, []
        for b, behind in zip(blocks, prices[1:]):
            ways = []
            repair.prices_before(b, behind, ways)
            edits, state = repair.trace(b, ways, state, behind is prices[-1])
            pieces += edits
        assert "".join(pieces) == "".join(repair.trace(own, exits, repair.START, True)[0])
