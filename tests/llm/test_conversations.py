"""Prefix trie and structure repair against brute force and SQL, and on odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from custodia.llm import prefixes, queries, repair

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, depth string, n1 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def white(text):
    return not re.search(r"[^\x20\x09-\x0d]", text)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeated rows, empty and very long texts, and columns whose names clash with internal ones."""
    long = "word. " * 200_000
    rows = [
        (0, 0, "user", "a b"), (0, None, None, None), (0, 1, "assistant", long), (0, 1, "assistant", long), (0, 1, "a", "tie"),
        (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, None, "system", ""), (3, None, None, None), (21, 5, "user", "x"), (None, None, None, None),
        (None, 4, "user", "lost"), (40, 0, "user", "shared"), (41, 0, "user", "own"), (59, 0, "", " "), (-7, -3, "user", "é\xa0z!"), (2**40, 9, "system", "s."),
    ]
    return spark.createDataFrame([(*r, "b", "d", "n") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def turns_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, v in convs.items()}


def brute_trie(rows):
    own = turns_of(rows)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:])
    members, kids = defaultdict(set), defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(held) - 1) * words
            leaves[node[:d]] += node not in kids
    return {
        (min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(kids.get(node, ())), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(held) if len(built[c]) == len(node)).encode()).hexdigest())
        for node, held in members.items()
    }


def got_trie(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_trie_is_exact(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(queries.op12_prefix_trie(spark, DATA)) == brute_trie(rows)


def test_trie_of_odd_rows(odd, none):
    rows = [tuple(r)[:4] for r in odd.collect()]
    got = got_trie(prefixes.prefix_trie(odd, share_every=20))
    assert got == brute_trie(rows) and len([r for r in got if r[1] == 0]) == 1
    assert prefixes.prefix_trie(none, share_every=20).count() == 0


def test_trie_of_branches_inside_blocks_and_long_conversations(spark):
    draw = np.random.default_rng(3)
    rows, number = [], 0
    for c in range(60):
        length = 9_000 if c in (5, 25) else int(draw.integers(1, 14))
        for t in range(length):
            number += 1
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if draw.random() < 0.93 and length < 20 or t < 8_000 < length else f"own {number}"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = got_trie(prefixes.prefix_trie(df, share_every=20))
    short = [r for r in rows if r[0] not in (5, 25)]
    assert got_trie(prefixes.prefix_trie(df.where("conv_id not in (5, 25)"), share_every=20)) == brute_trie(short)
    root = [r for r in got if r[1] == 0][0]
    assert root[:4] == (0, 0, None, 60) and max(r[1] for r in got) >= 8_997
    assert root[5] == len([r for r in got if r[4] == 0]) and len(got) == 1 + sum(r[4] for r in got)


def test_id_lists_of_many_pieces(spark):
    df = spark.range(10_000).selectExpr("id * 3 as conv_id", "0L as turn", "'user' as role", "'same' as text")
    got = {r.depth: r for r in prefixes.prefix_trie(df).collect()}
    ids = ",".join(str(3 * k) for k in range(10_000))
    assert got[1].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[0].ends_sha256 == EMPTY
    assert (got[0].n_convs, got[0].n_children, got[0].n_leaves, got[0].saved_tokens) == (10_000, 1, 1, 9_999)


def brute_edits(rows):
    """Least (cost, initials) of all edits of (role, fault) rows, by going through them one by one."""
    best = None

    def go(k, state, cost, letters, inserts):
        nonlocal best
        if best is not None and (cost > best[0]):
            return
        if k == len(rows) and state in "EA":
            best = (cost, letters) if best is None else min(best, (cost, letters))
        if inserts < len(rows) + 2:
            for to, frm in (("U", "ESA"), ("A", "U")):
                if state in frm:
                    go(k, to, cost + 3, letters + "I", inserts + 1)
        if k < len(rows):
            role, fault = rows[k]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                extra = 3 * (fault == repair.TRUNCATED)
                if role[:1] == "s" and state == "E":
                    go(k + 1, "S", cost + extra, letters + "K", inserts)
                for to, frm in (("U", "ESA"), ("A", "U")):
                    if state in frm:
                        same = role[:1] == to.lower()
                        if same:
                            go(k + 1, to, cost + extra, letters + "K", inserts)
                        go(k + 1, to, cost + extra + 3, letters + "R", inserts)
            go(k + 1, state, cost + 4, letters + "D", inserts)

    go(0, "E", 0, "", 0)
    return best


def searched(rows):
    search, letters = repair.Repair(), []
    for role, fault in rows:
        letters += [e.letter for e in search.row(role, "t", fault)]
    cost, rest = search.close()
    return cost, "".join(letters + [e.letter for e in rest])


def test_repair_of_every_short_conversation():
    kinds = [(r, f) for r in ("system", "user", "assistant", "") for f in (repair.SOUND, repair.BLANK, repair.TRUNCATED)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert searched(rows) == brute_edits(rows), rows


def test_repair_of_longer_conversations_holds_little():
    draw = np.random.default_rng(11)
    for _ in range(150):
        rows = [(("system", "user", "assistant")[draw.integers(3)], int(draw.choice(4, p=[0.6, 0.1, 0.1, 0.2]))) for _ in range(draw.integers(4, 8))]
        assert searched(rows) == brute_edits(rows), rows
    search, most = repair.Repair(), 0
    for k in range(20_000):
        search.row(("user", "assistant", "user", "system")[int(draw.integers(4))], "t", int(draw.choice(4, p=[0.7, 0.1, 0.1, 0.1])))
        most = max(most, *[end.depth - search.root.depth for _, end in search.paths.values()])
    assert most < 200


def brute_report(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
        convs[c] += [] if d == 0 else [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = set()
    for c, held in convs.items():
        held.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, kinds = set(), []
        for _, role, text in held:
            last = text.rstrip(" \t\n\x0b\f\r")[-1:]
            kinds.append(repair.BLANK if white(text) else repair.DUPLICATE if (role, text) in seen else repair.SOUND if last in ".!?" else repair.TRUNCATED)
            seen.add((role, text))
        numbers = [t for t, _, _ in held if t is not None]
        cost, audit = brute_edits([(r, k) for (_, r, _), k in zip(held, kinds, strict=True)])
        lines, at, state = [], 0, "E"
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role, text = ("", "") if letter == "I" else held[at][1:]
            first = role[:1] == "s" and state == "E" and letter == "K"
            state = "S" if first else "U" if state in "ESA" else "A"
            lines.append(f"{role if letter == 'K' else {'U': 'user', 'A': 'assistant'}[state]}:{text}")
            at += letter != "I"
        initials = [r[:1] for _, r, _ in held]
        out.add((
            c, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[kinds.count(k) for k in (1, 2, 3)],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return out


def test_repair_is_exact(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op13_structure_repair(spark, "/root/testdata/sf0.01").collect()} == brute_report(rows)


def test_repair_of_odd_rows(odd, none):
    rows = [tuple(r)[:4] for r in odd.collect()]
    got = [tuple(r) for r in repair.repair_report(repair.damaged(odd)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_report(rows)
    assert repair.repair_report(repair.damaged(none)).count() == 0


def test_repair_of_dropped_conversations(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in repair.repair_report(repair.damaged(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    edits = repair.repair_turns(repair.prepared(df)).collect()
    assert [tuple(r) for r in edits] == [(gone, 1, "K", "user", "Hi."), (gone, 2, "I", "assistant", "")]
