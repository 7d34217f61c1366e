import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from quillspark.llm import dialogue

COLUMNS = "conv_id long, turn long, role string, text string, audit string, part int, digest string, again string, times string, dropped string"


def by_dijkstra(codes):
    """Least (cost, edits) by a plain search over (row, state), edits compared as strings."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, row, state = heapq.heappop(heap)
        if row == len(codes) and state in (0, 3):
            return cost, audit
        if (row, state) in done:
            continue
        done.add((row, state))
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(heap, (cost + 5, audit + "I", row, after))
        if row < len(codes):
            code = codes[row]
            heapq.heappush(heap, (cost + 2, audit + "D", row + 1, state))
            if not code & 4:
                worse = 5 if code & 8 else 0
                heapq.heappush(heap, (cost + 1 + worse, audit + "R", row + 1, after))
                to = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((state, code & 3))
                if to is not None:
                    heapq.heappush(heap, (cost + worse, audit + "K", row + 1, to))
    raise AssertionError


def test_auction_against_dijkstra_whole_and_in_windows():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 90]:
        for _ in range(40):
            codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 9, 10, 8]) for _ in range(n))
            want = by_dijkstra(codes)
            for window in (1, 3, 7, 32, 1000):
                assert dialogue.cheapest(codes, window) == want, (codes, window)


def test_prices_hold_on_every_arc():
    arcs = dialogue.lattice(bytes([1, 1, 2, 9, 4, 0]), None)
    price = [0] * len(arcs)
    cost = dialogue.auction(arcs, price, 0)
    assert price[0] - price[-1] == cost == by_dijkstra(bytes([1, 1, 2, 9, 4, 0]))[0]
    assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for c, _, j in out)


def expected(rows):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, n = set(), [], [0, 0, 0, 0]
        for i, (_, role, text) in enumerate(rs):
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            n[3] += i > 0 and rs[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            codes.append(({"s": 0, "u": 1, "a": 2}.get(role[:1], 3)) | (4 if fault in (0, 1) else 8 if fault == 2 else 0))
        cost, audit = by_dijkstra(codes)
        lines, it, shape = [], iter(rs), ""
        for e in audit:
            _, role, text = next(it) if e != "I" else (None, "", "")
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if shape[-1:] == "u" else "user"
            shape += role[0]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", shape)
        turns = {t for t, _, _ in rs if t is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def hard():
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        n = rng.choice([1, 2, 3, 6, 9, 120 if conv == 7 else 4])
        for t in range(n):
            text = rng.choice(["Hi there.", "Yes!", "", " \t\n", "cut off", "é ", None, "A question?", f"long {t}. " * rng.choice([1, 400]), "dots... \r\n"])
            rows.append((conv, rng.choice([t, t, t, t * 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "System"]), text))
    return rows + rows[:40]


def test_hard_rows(spark):
    rows = hard()
    df = spark.createDataFrame([r + ("x", 1) + ("x",) * 4 for r in rows], COLUMNS).repartition(5)
    want = expected(rows)
    for held in (1 << 20, 300):  # a task holds all texts of a conversation, or hardly any
        got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
               for r in dialogue.repair(df, held_bytes=held).collect()}
        assert got == want
    assert {e for w in want.values() for e in w[6]} == set("DKR")  # to insert is never cheaper than to delete


def test_all_rows_dropped_and_empty(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = dialogue.repair(spark.createDataFrame([(5, turn, "user", "Hi.") + ("x", 1) + ("x",) * 4], COLUMNS)).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert dialogue.repair(spark.createDataFrame([], COLUMNS)).collect() == []


def test_one_conversation_of_very_many_rows(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t}{'.' if t % 5 else ''}") for t in range(20_000)]
    df = spark.createDataFrame([r + ("x", 1) + ("x",) * 4 for r in rows], COLUMNS)
    (got,) = dialogue.repair(df, held_bytes=10_000).collect()
    want = expected(rows)[1]
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == want[5:]
