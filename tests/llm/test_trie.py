"""List ranking, Euler tours and the prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from seenscope.llm import euler, trie

TURNS = "conv_id LONG, turn LONG, role STRING, text STRING, node STRING, pos INT"


def shuffled_list(rng, sizes):
    ids = rng.sample(range(10_000), sum(sizes))
    links, places = [], {}
    for size in sizes:
        own = [ids.pop() for _ in range(size)]
        links += list(zip(own, [*own[1:], None], strict=True))
        places.update({a: i for i, a in enumerate(own)})
    return links, places


@pytest.mark.parametrize("sizes", [[], [1, 40, 2, 160]])
def test_list_rank(spark, sizes):
    links, places = shuffled_list(random.Random(3), sizes)
    found = euler.list_rank(spark.createDataFrame(links, "at LONG, next LONG"), base=8).collect()
    assert {r["at"]: r["rank"] for r in found} == places
    assert len(found) == len(places)


def test_contraction_keeps_every_place(spark):
    links, places = shuffled_list(random.Random(4), [500])
    weighted = [(a, b, 1) for a, b in links]
    once = euler._contract(spark.createDataFrame(weighted, "at LONG, next LONG, weight LONG"), 0).collect()
    assert len(once) < 400
    for r in once:
        if r["lost"] is not None:
            assert places[r["lost"]] == places[r["at"]] + r["far"]
        if r["next"] is not None:
            assert places[r["next"]] == places[r["at"]] + r["weight"]


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_subtree_sums(spark, shape):
    rng = random.Random(5)
    up = {i: {"path": i - 1, "star": 0, "random": rng.randrange(i)}[shape] for i in range(1, 150)}
    up[0] = None
    value = {i: rng.randrange(5) for i in up}
    wanted = dict.fromkeys(up, 0)
    for i in up:
        at = i
        while at is not None:
            wanted[at] += value[i]
            at = up[at]
    tree = spark.createDataFrame([(i, p, value[i]) for i, p in up.items()], "node LONG, parent LONG, v LONG")
    found = euler.subtree_sums(tree, ["v"], base=16).collect()
    assert {r["node"]: r["v"] for r in found} == wanted


def brute(rows):
    """The contract, one conversation after the other."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(text.encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(x, key=lambda p: p[0])] for c, x in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + mine[h:]
    members, children = defaultdict(set), defaultdict(set)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
            if d:
                children[tuple(t[: d - 1])].add(tuple(t[:d]))

    def saved(n):
        own = (len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        return own + sum(saved(k) for k in children[n])

    def leaves(n):
        return sum(leaves(k) for k in children[n]) or 1

    out = []
    for n in list(members):
        ends = sorted(c for c in members[n] if len(rebuilt[c]) == len(n))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        up = min(members[n[:-1]]) if n else None
        out.append((min(members[n]), len(n), up, len(members[n]), len(children[n]), leaves(n), saved(n), digest))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame(rows, TURNS)
    result = trie.prefix_trie(*trie.share_openings(trie.place_turns(table)), base=16)
    return sorted((tuple(r) for r in result.drop("node", "parent").collect()), key=str)


def test_trie_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for c in rng.sample(range(-30, 70), 60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a b", "a  c\td", "", "é x"])))
    rows += [(1000, t, "user", f"long {t}") for t in range(120)]  # a path
    rows += [(2000 + i, 0, "user", "same words here") for i in range(60)]  # copies
    rows = [(*r, "clash", 5) for r in rows]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 0, "user", "left out"),
        (0, None, None, None),
        (0, 3, "user", "x y " * 5000),
        (0, 3, "user", "x y " * 5000),
        (0, 1, "", ""),
        (7, 0, "user", "tie b"),
        (7, 0, "user", "tie a"),
        (7, 0, "assistant", "tie a"),
        (21, 5, "user", "one"),
        (39, 0, "user", "lender without a row for 20"),
        (20, 0, "user", "one"),
        (2**40 + 3, 0, "user", None),
        (-21, 0, "user", "one"),
    ]
    rows = [(*r, None, None) for r in rows]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == []


def test_ends_of_one_node_stream_through_pieces(spark, monkeypatch):
    ends = spark.range(1000).selectExpr("CASE WHEN id < 990 THEN 'n' ELSE 'm' END AS node", "id * 7 AS conv_id")
    wanted = {
        n: hashlib.sha256(",".join(str(i * 7) for i in ids).encode()).hexdigest()
        for n, ids in (("n", range(990)), ("m", range(990, 1000)))
    }
    for chunk in (3, 1 << 16):
        monkeypatch.setattr(trie, "CHUNK", chunk)
        assert {r["node"]: r["ends_sha256"] for r in trie.id_digests(ends).collect()} == wanted
