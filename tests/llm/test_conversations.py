import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.llm import conversations as C
from brickledger.llm.queries import ORACLES, QUERIES
from checks.compare import difference

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string, pos long, seg int, conv string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], SCHEMA)


def plain_damage(rows):
    made = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        made += [(conv, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    return made


def plain_repair(rows):
    """Faults and the cheapest repair of one conversation: every prefix keeps its best script for each state."""
    rows = sorted(((turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, script, lines) in list(best.items()):
                for role, name in (("u", "user"), ("a", "assistant")):
                    if (state, role) in go:
                        new = (cost + 3, script + "I", lines + [f"{name}:"])
                        best[go[state, role]] = min(best.get(go[state, role], new), new)
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def offer(state, new):
            after[state] = min(after.get(state, new), new)
        more = 3 if fault == "truncated" else 0
        for state, (cost, script, lines) in best.items():
            offer(state, (cost + 4, script + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            if (state, role[:1]) in go:
                offer(go[state, role[:1]], (cost + more, script + "K", lines + [f"{role}:{text}"]))
            for new, name in (("u", "user"), ("a", "assistant")):
                if (state, new) in go:
                    offer(go[state, new], (cost + 3 + more, script + "R", lines + [f"{name}:{text}"]))
        best = inserted(after)
    cost, script, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
            "truncated": faults.count("truncated"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": script, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def plain(rows):
    by_conv = defaultdict(list)
    for conv, *rest in rows:
        by_conv[conv].append(rest)
    return {conv: plain_repair(each) for conv, each in by_conv.items()}


def connect_to(sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet{'' if sf == SF else '/*.parquet'}')")
    return db


def repaired(df):
    fixed = C.repair(df)
    found = {r["conv"]: r.asDict() for r in fixed.summary.collect()}
    for r in C.digests(fixed.rows).collect():
        found[r["conv"]] |= {"audit": r["audit"], "repaired_sha256": r["repaired_sha256"]}
    assert all(f.pop("conv") == c and f.pop("n_rows") > 0 for c, f in found.items())
    return found, fixed


def messy():
    rng = np.random.default_rng(1)
    roles, texts = ["system", "user", "assistant", "tool", None, "", "User", "sudo"], ["Yes.", "No!", "cut off", "", " \t", None, "ä ü?  \n", "one. two"]
    rows = [(c, None if rng.random() < .05 else int(t), roles[int(rng.choice(8, p=[.1, .35, .35, .04, .04, .04, .04, .04]))], texts[int(rng.integers(8))])
            for c in range(150) for t in range(int(rng.integers(1, 14)))]
    return rows + [(None, 1, "user", "a."), (None, 2, "user", "b."), (None, None, None, None), (900, 5, "assistant", "x" * 300_000 + "."), (900, 5, "assistant", "x" * 300_000 + "."),
                   (901, 1, "system", "only."), (902, 3, "user", "twice."), (902, 3, "user", "same turn.")]


def test_repair_of_messy_rows_against_brute_force(spark):
    found, fixed = repaired(table(spark, messy()))
    wanted = plain(messy())
    assert found == wanted
    texts = defaultdict(list)
    for r in sorted(C.repaired_rows(fixed.rows).collect(), key=lambda r: (r["pos"], r["nth"])):
        texts[r["conv"]].append((r["role"], r["text"]))
    for conv, w in wanted.items():
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in texts[conv]).encode()).hexdigest() == w["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in texts[conv]))


def test_segments_and_levels_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(c, t, "sua"[int(rng.choice(3, p=[.1, .45, .45]))] + "x", ["Yes.", "cut", "", f"{t}.", f"{t}"][int(rng.integers(5))])
            for c, n in ((1, 700), (2, 64), (3, 65), (4, 1)) for t in range(n)]
    monkeypatch.setattr(C, "SEGMENT", 16)
    monkeypatch.setattr(C, "FAN", 4)
    assert repaired(table(spark, rows))[0] == plain(rows)


def test_traces_of_random_symbols_against_every_script():
    t = C.tables()
    assert len(t.vectors) < 500 and t.block_next.shape[1] == C.SYMBOLS ** C.BLOCK
    rng = np.random.default_rng(3)
    symbols = ["".join(map(str, rng.integers(0, 9, int(rng.integers(1, 11))))) for _ in range(400)]
    edits, state = C.trace(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))
    _, codes = C.blocks(symbols)
    at, gained = C.backward(codes, np.zeros(len(symbols), np.int64))
    for k, s in enumerate(symbols):
        rows = [(i, C.ROLES[int(x) // 2] if x != "8" else "u", "" if x == "8" else f"{i}" + ("" if int(x) % 2 else ".")) for i, x in enumerate(s)]
        wanted = plain_repair(rows)
        assert ("".join(edits[k]) + t.last_edits[state[k]]).translate(C.INITIALS) == wanted["audit"]
        assert t.vectors[at[k, 0], 0] + gained[k] + t.end_cost == wanted["cost"]


def test_empty_and_dropped(spark):
    none = C.repair(table(spark, []))
    assert none.summary.count() == 0 and none.rows.count() == 0 and C.digests(none.rows).count() == 0
    gone = repaired(table(spark, [(1, 0, "user", " "), (1, 1, "system", "")]))[0][1]
    assert (gone["audit"], gone["cost"], gone["repaired_sha256"]) == ("DD", 8, EMPTY)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(10)] + [(None, None, None, None), (3, None, None, "a?"), (None, 4, "user", None)]
    found = C.damaged(table(spark, rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(plain_damage(rows), key=key)


@pytest.mark.parametrize("sf", [SF, "messy"])
def test_registered_query_against_brute_force(spark, sf, tmp_path):
    if sf == "messy":
        sf = str(tmp_path)
        table(spark, messy() + [(c, 7, "user", "maybe lost.") for c in range(2000, 2060)]).write.parquet(f"{sf}/conversations.parquet")
    source = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    wanted = plain(plain_damage(source))
    nothing = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": EMPTY}
    got = QUERIES["op12_conversation_repair"](spark, sf)
    assert got.dtypes == [("conv_id", "bigint")] + [(n, "bigint") for n in list(nothing)[:6]] + [("audit", "string"), ("repaired_sha256", "string")]
    found = {r["conv_id"]: {k: r[k] for k in nothing} for r in got.collect()}
    assert found == {conv: wanted.get(conv, nothing) for conv, *_ in source}
    assert difference(got, connect_to(sf), ORACLES["op12_conversation_repair"]) is None
    assert got.filter(F.col("audit") == "").count() == sum(not w for w in (wanted.get(c) for c in {c for c, *_ in source}))
