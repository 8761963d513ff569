"""Conversation repair, substring dedup and vector codes next to brute force, on odd rows and with forced splits."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import sys
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from wardlight.llm import codes, repair, substrings  # noqa: E402

# conversation repair


def brute_repair(rows):
    """Faults and the cheapest, audit-least edits, by trying every way and keeping whole audits per state."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.rstrip("\t\n\x0b\x0c\r ")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    role_of = {"s": 1, "u": 2, "a": 3}
    allowed = {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}
    name = {2: "user", 3: "assistant"}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (c, audit, made) in list(out.items()):
                for b in (2, 3):
                    if (s, b) in allowed:
                        new = (c + 3, audit + "I", made + (f"{name[b]}:",))
                        out[b] = min(out.get(b, new), new)
        return out

    ways = {0: (0, "", ())}
    for (role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, way):
            new[state] = min(new.get(state, way), way)

        for before in (ways, inserted(ways)):
            for s, (c, audit, made) in before.items():
                offer(s, (c + 4, audit + "D", made))
                if fault in (1, 2):
                    continue
                extra = 3 if fault == 3 else 0
                own = role_of.get(role[:1])
                if own and (s, own) in allowed:
                    offer(own, (c + extra, audit + "K", (*made, f"{role}:{text}")))
                for b in (2, 3):
                    if (s, b) in allowed:
                        offer(b, (c + 3 + extra, audit + "R", (*made, f"{name[b]}:{text}")))
        ways = new
    ends = [w for s, w in inserted(ways).items() if s in (0, 3)]
    cost, audit, made = min(ends)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for i in [None, *range(30)]:
        n = rng.choice([1, 2, 3, 5, 8, 40]) if i else 150
        for k in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sys", "umpire"])
            text = rng.choice(["ok.", f"well {k}.", f"cut {k}", "", " \t\n", None, f"é {k}!", "x" * 40 + str(k) + "?", "no\x0b"])
            rows.append((i, rng.choice([k, k, k + 2, None, k // 2]), role, text))
    return rows


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of one conversation
    rows = conversations(bits)
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "conv long, turn long, role string, text string, pos long, id string, block int").repartition(5)
    plan = repair.plan(df, "conv", "turn", "role", "text")
    assert plan.rows.selectExpr("count(distinct shiftright(pos, 33))").first()[0] > 3
    got = {r.id: tuple(r)[1:] for r in plan.report.collect()}
    digests = {r.id: (r.audit, r.repaired_sha256) for r in repair.digests(plan).collect()}
    long = defaultdict(list)
    for r in repair.repaired(plan).collect():
        long[r.id].append(r)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    grouped = defaultdict(list)
    for r in rows:
        grouped[r[0]].append(r)
    assert set(got) == set(grouped) == set(digests)
    for i, own in grouped.items():
        own = [(t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in own]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:32].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        *counts, audit, sha = brute_repair([(r, x) for _, r, x in own])
        assert got[i] == (gaps, *counts), i
        assert digests[i] == (audit, sha), i
        kept = sorted(long[i], key=lambda r: r.place)
        assert "".join(r.edit for r in kept) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept if r.edit != "D").encode()).hexdigest() == sha
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept if r.edit != "D"))


def test_repair_of_one_long_conversation(spark):
    """One conversation of many equal rows: spread over parts, all but one of them deleted."""
    df = spark.range(0, 20_000, 1, 8).selectExpr("7L as id", "cast(null as long) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'same.' as text")
    plan = repair.plan(df, "id", "turn", "role", "text")
    report, digest = plan.report.first(), repair.digests(plan).first()
    assert (report.duplicate, report.cost) == (19_998, 4 * 19_998 + 6)
    assert digest.audit.replace("D", "") in ("IKKI", "RR") and len(digest.audit.replace("I", "")) == 20_000


def test_an_audit_is_found_in_linear_space():
    """Crossings of halved stretches are those of the whole table of states."""
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 9, 300)
    cost, order = repair.COST[kinds], repair.PIECE[kinds]
    start, stop = np.array([0, 120, 121]), np.array([120, 121, 300])
    entry = np.zeros(3, np.int64)
    ends = repair.forward(cost, order, start, stop - start, entry) + 4 * repair.TAIL_COST
    states = repair.crossings(cost, order, start, stop, entry, ends.argmin(1))
    for lane in range(3):
        ways = {0: (0, "")}
        for i in range(start[lane], stop[lane]):
            new = {}
            for s, (c, audit) in ways.items():
                for b in range(4):
                    if cost[i, s, b] < repair.FAR:
                        way = (c + cost[i, s, b], audit + repair.PIECES[order[i, s, b]])
                        new[b] = min(new.get(b, way), way)
            ways = new
        best = min((c + int(repair.TAIL_COST[s]), audit, s) for s, (c, audit) in ways.items())
        assert best[0] == ends[lane].min() >> 2 and best[2] == ends[lane].argmin()
        behind = [*states[start[lane] + 1 : stop[lane]], best[2]]
        assert "".join(repair.PIECES[order[i, states[i], b]] for i, b in zip(range(start[lane], stop[lane]), behind)) == best[1]


# substring dedup


def brute_repeated(rows, window):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def passages(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "Ünï", "x.", "X."]
    shared = [[rng.choice(vocabulary) for _ in range(size)] for size in (12, 13, 14, 20, 40, 90, 8, 3)]
    rows = [(-5, None), (-4, ""), (-3, " \t "), (None, " ".join(shared[5])), (900, " ".join(shared[5])), (900, " ".join(shared[5])), (901, "a " * 40), (902, "a " * 13), (903, "a " * 12)]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 30, 200]))]
        for _ in range(rng.choice([0, 1, 2, 4])):
            at = rng.randrange(len(words) + 1)
            own = rng.choice(shared)
            cut = own[rng.randrange(3) :] if rng.random() < 0.5 else own[: len(own) - rng.randrange(3)]
            words[at:at] = cut
        rows.append((rng.choice([i, i, i // 2]), rng.choice([" ", "\n", "  "]).join(words) + rng.choice(["", " "])))
    rows += [(1000 + i, rows[20][1]) for i in range(30)]  # exact copies
    return rows


@pytest.mark.parametrize("window, anchors, shards", [(13, 2_000, 20_000), (13, 1, 20_000), (13, 3, 7), (3, 2_000, 50), (1, 2_000, 50)])
def test_repeated_passages(spark, monkeypatch, window, anchors, shards):
    monkeypatch.setattr(substrings, "ANCHOR_PIECES", anchors)
    monkeypatch.setattr(substrings, "SHARD_PIECES", shards)
    rows = passages(window * 7 + anchors)
    df = spark.createDataFrame([(t, i, 1, "k", None, 3) for i, t in rows], "text string, doc_id long, doc long, key string, anchors string, id long").repartition(4)
    got = []
    for r in substrings.repeated(df, "doc_id", "text", window).collect():
        assert all(a < z for a, z in zip(r.starts, r.stops))
        got.append((r.id, r.n_words, sum(z - a for a, z in zip(r.starts, r.stops)), r.kept_sha256))
    assert sorted(got, key=str) == sorted(brute_repeated(rows, window), key=str)


def test_matching_statistics():
    rng = np.random.default_rng(2)
    length = rng.integers(1, 19, 60)
    words = rng.integers(0, 4, length.sum()).astype(np.uint64)
    owner = rng.integers(0, 9, 60)
    index = substrings.MatchIndex(words, length, owner)
    pieces = [w.tolist() for w in np.split(words, np.cumsum(length)[:-1])]
    which = np.repeat(np.arange(60), length)
    end = np.concatenate([np.arange(n) for n in length])
    got = index.statistics(which, end, 13)
    for j, e, n in zip(which, end, got):
        own = pieces[j][: e + 1]
        held = [size for size in range(min(len(own), 13) + 1) if not size or any(o < owner[j] and any(p[k : k + size] == own[-size:] for k in range(len(p))) for p, o in zip(pieces, owner))]
        assert n == max(held)


# vector codes


def brute_codes(rows, entries=256):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    quarter = len(whole[0]) // 4
    parts = [np.array([w[j * quarter : (j + 1) * quarter] for w in whole]) for j in range(4)]
    books = [parts[j][order].copy() for j in range(4)]

    def assign(j):
        d = ((parts[j][:, None, :] - books[j][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(4):
        for j in range(4):
            code, _ = assign(j)
            for e in range(len(order)):
                own = parts[j][code == e]
                if len(own):
                    books[j][e] = own.sum(0) // len(own)
    found = [assign(j) for j in range(4)]
    error = sum(d for _, d in found)
    groups = defaultdict(int)
    for (_, _, g), e in zip(kept, error):
        groups[g] += int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{found[j][0][k]:02x}" for j in range(4)), int(error[k]), groups[g]) for k, (i, _, g) in enumerate(kept)], key=str), sha


@pytest.mark.parametrize("n, width, spread", [(700, 16, 0.2), (40, 8, 3.0), (900, 4, 0.01), (300, 64, 0.15)])
def test_codes(spark, n, width, spread):
    rng = np.random.default_rng(n)
    middle = rng.normal(0, spread, (max(2, n // 60), width))
    rows = [(int(i), [float(np.float32(x)) for x in middle[rng.integers(len(middle))] + rng.normal(0, spread / 6, width)], [1, 2, None][rng.integers(3)]) for i in rng.permutation(n)]
    rows += [(rows[3][0], rows[3][1], 1), (rows[4][0], rows[5][1], None), (None, rows[6][1], 2), (n + 1, None, 1), (n + 2, [None, *rows[0][1][1:]], 1), (-1, [float("nan"), *rows[0][1][1:]], 1)]
    rows += [(-2, [float("inf"), *rows[0][1][1:]], 1), (n + 3, [0.0] * width, None), (n + 4, [-x for x in rows[1][1]], 2)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "vec_id long, v array<float>, label int, code string, part string, n int").repartition(5)
    books = codes.fit(df, "vec_id", "v")
    got = codes.error_by(codes.encode(df, "v", books), "label").collect()
    want, sha = brute_codes(rows)
    assert books.digest() == sha
    assert sorted([(r.vec_id, r.code, r.error, r.group_error) for r in got], key=str) == want
    assert {r.part for r in got} == {"b"}


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 4, None)], "vec_id long, v array<double>, label int")
    assert codes.fit(df, "vec_id", "v") is None
    assert codes.encode(df, "v", None).columns == ["vec_id", "v", "label", "code", "error"] and codes.encode(df, "v", None).count() == 0


def test_cells_leave_out_dominated_entries_only():
    rng = np.random.default_rng(8)
    entries = rng.integers(-300, 300, (64, 4))
    cells = codes.Cells(entries, bits=5, most=50)
    parts = rng.integers(-400, 400, (3000, 4))
    parts[:50] = entries[:50]
    parts[50] = (entries[0] + entries[1]) // 2
    code, error = cells.nearest(parts)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    assert cells.exact < 0.5 * d.size
    assert len(cells.slots) == len(cells.kept)
