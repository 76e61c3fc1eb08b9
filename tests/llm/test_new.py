"""Operators 11 to 13 against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerline.llm import op11_centroids, op12_repair

WS = " \t\n\x0b\x0c\r"


def plain_kmeans(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    if not kept:
        return {}
    xs = np.array([x for _, x in kept], np.int64)
    named = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"3:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    c = xs[named[:k]]
    for at in range(rounds + 1):
        d = ((xs[:, None, :] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if at < rounds:
            c = np.array([xs[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return sorted((i if i is not None else -1, int(j), int(m)) for (i, _), j, m in zip(kept, a, d.min(1)))


@pytest.mark.parametrize("kind", ["apart", "one", "ties", "few", "none"])
def test_centroids_equal_plain_rounds(spark, kind):
    rng = np.random.default_rng(5)
    n = {"few": 3, "none": 0}.get(kind, 400)
    x = rng.normal(size=(n, 4)) + 6 * rng.integers(0, 3, size=(n, 1)) * (kind == "apart")
    if kind == "one":
        x[:300] = x[0]
    if kind == "ties":
        x = rng.integers(0, 3, size=(n, 4)).astype(float)
    rows = [(i if i != 7 else None, [float(v) for v in r]) for i, r in enumerate(x)]
    if n:
        rows += [(1000, None), (1001, [1.0]), (1002, [1.0, None, 0.0, 0.0]), (1003, [float("nan"), 0.0, 0.0, 0.0]), (1004, [float("inf"), 0.0, 0.0, 0.0]), (1, rows[1][1]), (1005, [1e300, 0.0, 0.0, 0.0])]
    # Clashing names of other columns are ignored.
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, x string")
    state, c, scans = op11_centroids.cluster(df, size=4, k=5, rounds=6)
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in (state.select("vec_id", "cluster", op11_centroids.distance(c).alias("d")).collect() if len(c) else []))
    assert got == list(plain_kmeans([r for r in rows if r[0] != 1005], 5, 6, 4))
    if kind == "apart":
        assert sum(scans[1:]) < 0.5 * len(got) * (len(scans) - 1)


def test_losses_hold_for_random_points():
    rng = np.random.default_rng(1)
    less = []
    for _ in range(50):
        old, move = rng.normal(size=(4, 3)) * 5, rng.normal(size=(4, 3)) * rng.choice([0.1, 1, 5])
        radius = rng.uniform(0, 4, 4)
        loss = op11_centroids.losses(old, old + move, radius)
        way = rng.normal(size=(500, 3))
        for i in range(4):
            x = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * rng.uniform(0, 1, (500, 1))
            for j in range(4):
                lost = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - old[j] - move[j], axis=1)
                assert lost.max() <= loss[i, j] + 1e-9
        less.append((loss / np.linalg.norm(move, axis=1)).mean())
    assert np.mean(less) < 0.8  # the full drift would be 1


def plain_best(roles, faults):
    """Least (cost, audit) by trying every edit at every row, over all states."""
    now = {0: (0, "")}
    for i in range(len(roles) + 1):
        for _ in range(3):
            for s, (c, a) in list(now.items()):
                t, v = op12_repair.TURNS[s][1], (c + 2, a + "I")
                now[t] = min(now.get(t, v), v)
        if i == len(roles):
            return min(v for s, v in now.items() if s in (0, 3))
        then = {}
        for s, (c, a) in now.items():
            short, ways = faults[i] == 3, [(s, (c + 3, a + "D"))]
            if faults[i] not in (1, 2):
                ways += [(op12_repair.FOLLOWS[s][roles[i]], (c + short, a + "K"))] if roles[i] in op12_repair.FOLLOWS[s] else []
                ways += [(op12_repair.TURNS[s][1], (c + 2 + short, a + "R"))]
            for t, v in ways:
                then[t] = min(then.get(t, v), v)
        now = then


def test_search_finds_the_least_audit_of_the_least_cost():
    rng = random.Random(3)
    names = {"u": "user", "a": "assistant", "s": "system", "x": "xy", "": ""}
    for _ in range(600):
        n, alphabet, p = rng.choice([0, 1, 2, 4, 7, 15, 16, 17, 40]), rng.choice(["ua", "uas", "uasx", "u", "a", "s"]), rng.choice([0, 0.2, 0.6])
        roles = [rng.choice(alphabet) for _ in range(n)]
        faults = [rng.choice([1, 2, 3]) if rng.random() < p else 0 for _ in range(n)]
        parts = list(op12_repair.repaired(iter([(names[r], "t", f) for r, f in zip(roles, faults)])))
        edits = [e for part, _ in parts for e in part]
        assert (parts[-1][1], "".join(e for e, _, _ in edits)) == plain_best(roles, faults)
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for e, r, _ in edits if e != "D"))


def plain_summary(messages):
    """What the contract asks of whole conversations, by plain Python."""
    out, groups = [], {}
    for conv, turn, role, text in messages:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
        groups[conv] += [row] * (0 if n == 0 else 2 if n == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(WS)
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = plain_best([r[:1] for _, r, _ in rows], faults)
        state, left, at = 0, [], 0
        for e in audit:
            role, to = op12_repair.TURNS[state]
            if e == "I":
                left.append(f"{role}:")
                state = to
                continue
            _, own, text = rows[at]
            at += 1
            if e == "K":
                left.append(f"{own}:{text}")
                state = op12_repair.FOLLOWS[state][own[:1]]
            elif e == "R":
                left.append(f"{role}:{text}")
                state = to
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_summaries_equal_plain_python(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "so", " ", "", None, "Why?\n", "x" * 50_000 + ".", "é.", " "]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(600)]
    rows += [(99, i, "user" if i % 2 == 0 else "assistant", "Fine." if i % 3 else f"{i}?") for i in range(300)]  # a long one
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", copies string").repartition(5)
    got = sorted(map(tuple, op12_repair.summary(op12_repair.damaged(df)).collect()), key=repr)
    assert got == plain_summary(rows)
    assert op12_repair.summary(op12_repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_repair_gives_the_messages(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "Hi."), (1, 4, "user", "cut off")], SCHEMA)
    got = [tuple(r) for r in op12_repair.repair(op12_repair.whole(rows)).orderBy("position").select("edit", "role", "text").collect()]
    assert got == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi."), ("D", "user", "Hi."), ("R", "assistant", "cut off")]


def test_messages_with_calls_keep_all_they_hold(spark):
    """Random call graphs against plain Python; content and other keys of messages with calls stay."""
    import json

    from ledgerline.llm import op9_chat

    rng, rows = random.Random(6), []
    for conv in range(30):
        ids = [f"c{k}" for k in range(rng.randrange(4))]
        for turn in range(rng.randrange(1, 9)):
            kind = rng.randrange(3)
            if kind == 0:
                message = {"tool_calls": [{"id": i, "name": "search", "arguments": json.dumps({"limit": 1, "query": "q"})} for i in rng.sample(ids, rng.randrange(len(ids) + 1))], **({"content": rng.choice(["let me look", "", None])} if rng.random() < 0.7 else {}), **({"note": {"b": 1, "a": [2]}} if rng.random() < 0.5 else {})}
                rows.append((conv, turn, "assistant", json.dumps(message)))
            elif kind == 1:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "none"]), "content": "r"})))
            else:
                rows.append((conv, turn, "user", rng.choice(["Hi.", "{not json", "", None])))
    got = {(r.conv_id, r.turn): r for r in op9_chat.linked(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, calls int")).collect()}
    assert len(got) == len(rows)
    made = {}
    for conv, turn, _, text in rows:
        for c in (json.loads(text).get("tool_calls", []) if text and text.startswith('{"') else []):
            made[conv, c["id"]] = min(turn, made.get((conv, c["id"]), turn))
    for conv, turn, role, text in rows:
        r, out = got[conv, turn], json.loads(got[conv, turn].json)
        m = json.loads(text) if text and text.startswith('{"') else {}
        assert out.get("role") == role and r.json == json.dumps(out, separators=(",", ":"), sort_keys=True)
        if "tool_call_id" in m:
            call = made.get((conv, m["tool_call_id"]))
            assert (r.call_turn, r.orphan, r.rank_turn, r.rank_step) == (call, call is None, max(turn, call if call is not None else turn), 1)
        if m.get("tool_calls"):
            assert out.get("content") == m.get("content") and [c["id"] for c in out["tool_calls"]] == [c["id"] for c in m["tool_calls"]]
            assert {k: json.loads(v) for k, v in out.get("extra", {}).items()} == ({"note": m["note"]} if "note" in m else {})
        elif not m.get("tool_calls"):
            assert out.get("content") == text


def test_quality_rows_are_bounded_by_their_ids(spark):
    from ledgerline.llm import op6_quality

    docs = spark.createDataFrame([(i // 500, f"text {i}", 7) for i in range(3000)] + [(None, "x", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    out = op6_quality.labelled(docs, labels, 50)
    assert out.columns == ["text", "quality", "weight"] and 1 <= out.count() <= 6
    assert out.count() == out.select("text").distinct().count()
