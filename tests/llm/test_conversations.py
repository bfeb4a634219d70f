import hashlib
import heapq
import random
import re
import zlib

import pytest

from placeweave.llm import conversations as C
from placeweave.llm import queries

SF = "/root/testdata/sf0.001"
GOAL = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """A conversation's result by searching over edit strings; rows (turn, role, text) in order."""
    seen, faults, letters = set(), [], []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        letters.append(role[:1])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and GOAL.fullmatch(roles):
            break
        if (i, roles[-1:], len(roles) > 0) in done:
            continue
        done.add((i, roles[-1:], len(roles) > 0))
        moves = [("I", 2, i, r, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            moves.append(("D", 3, i + 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                moves.append(("K", extra, i + 1, role, (role, text)))
                moves += [("R", 2 + extra, i + 1, r, (r, text)) for r in ("user", "assistant")]
        for letter, c, j, role, row in moves:
            now = roles if role is None else roles + role[:1]
            if role is None or (role[:1] and re.fullmatch(r"s?(ua)*u?", now)):
                heapq.heappush(heap, (cost + c, audit + letter, j, now, out if row is None else (*out, row)))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def plain_damage(rows):
    """{conv_id: ordered damaged rows} of (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in found.items()}


def as_rows(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = as_rows(queries.QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{sf}"))
    assert got == {c: plain(x) for c, x in plain_damage(rows).items()}


def test_random_rows(spark):
    rnd = random.Random(5)
    texts = ["Good.", "Why?", "cut", "", " \n", "cut off ", None, "So!\t"]
    rows = [(rnd.randrange(60), rnd.choice([None, *range(6)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "User", "ua"]), rnd.choice(texts)) for _ in range(500)]
    rows += [(None, 1, "user", "No id."), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnsRenamed({"text": "text"}).selectExpr("*", "1 as copies", "'x' as key", "2 as n").repartition(5)
    want = {c: plain(x) for c, x in plain_damage(rows).items()}
    assert as_rows(C.repair(C.damaged(frame.drop("copies")))) == want
    assert C.repair(C.damaged(frame.where("false"))).collect() == []
    plain_rows = {}
    for conv, turn, role, text in rows:
        plain_rows.setdefault(conv, []).append((turn, *(" " if x is None else x for x in (role, text))))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    whole = C.repair(frame, with_text=True).collect()
    assert {r.conv_id: tuple(r)[1:9] for r in whole} == {c: plain(sorted(x, key=order)) for c, x in plain_rows.items()}
    assert all(hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256 for r in whole)


def test_walk_is_least_of_the_cheapest():
    rnd = random.Random(1)
    for _ in range(300):
        codes = bytes(rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 10]) for _ in range(rnd.randrange(7)))
        rows, n = [], 0
        for c in codes:
            n += 1
            role = {0: "s", 1: "u", 2: "a", 3: "x"}[c % 4]
            rows.append((n, role, "" if c >= 8 else f"t{n}" if c >= 4 else f"t{n}."))
        assert C.cheapest(codes) == plain(rows)[5:7]


def test_one_long_conversation(spark):
    """Longer than a batch and than the scratch file's part in memory."""
    n = 6000
    rows = [(7, i, ("user", "assistant")[i % 2], f"{i} " + "x" * 1500 + ".") for i in range(n)] + [(8, 0, "system", "Only.")]
    got = as_rows(C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)))
    text = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:n])
    assert got[7] == (0, 0, 0, 0, 0, 0, "K" * n, hashlib.sha256(text.encode()).hexdigest())
    assert got[8] == (0, 0, 0, 0, 0, 3, "D", hashlib.sha256(b"").hexdigest())
