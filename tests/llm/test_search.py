"""Fingerprints, near duplicates and decontamination against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from seenscope.llm import cgk, dartminhash, simhash
from seenscope.llm.components import components
from seenscope.llm.words import find_words, split_words, text_bytes

WORDS = ["the", "of", "and", "to", "in", "stone", "river", "light", "cloud", "été", "Straße", "x1", "日本"]
EDGE = [None, "", "   \n", "one", "two words", "The of", "THE OF", "a" * 50_000, "the " * 20_000]
DOCS = "doc_id LONG, text STRING, class_id STRING, bucket INT"


def text(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randrange(200)) for _ in range(n))


def rows(texts):
    """Documents with columns whose names clash with those used inside."""
    return [(i, t, "other", 7) for i, t in enumerate(texts)]


def test_words_and_hashes():
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choice("aAbB é\t\n\x0b .") for _ in range(40)) for _ in range(300)]
    found, hashes = [], {}
    for max_bytes in (64, 1 << 20):
        for words in split_words(pa.array(texts, pa.string()), max_bytes):
            h = words.hashes()
            for i, d in enumerate(words.doc):
                found.append((words.first + d, words.word(i)))
                lower = "".join(c.lower() if c.isascii() else c for c in words.word(i))
                assert hashes.setdefault(lower, h[i]) == h[i]
    wanted = [
        (d, w)
        for d, t in enumerate(texts)
        for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ")
        if w
    ]
    assert found == wanted * 2
    assert len(set(hashes.values())) == len(hashes)
    assert len(find_words(*text_bytes(pa.array([], pa.string()))).starts) == 0


def brute_fingerprint(t):
    words = find_words(*text_bytes(pa.array([t], pa.string())))
    votes = np.zeros(128)
    from seenscope.llm.words import mix

    for h, n in Counter((words.hashes() >> np.uint64(20)).tolist()).items():
        halves = [int(mix(np.array([2 * h + i], np.uint64))[0]) for i in (0, 1)]
        bits = [(halves[b // 64] >> (8 * (b // 8 % 8) + 7 - b % 8)) & 1 for b in range(128)]
        votes += (1 + np.log(n)) * (2 * np.array(bits) - 1)
    return sum(int(v > 1e-9) << (127 - i) for i, v in enumerate(votes))


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = EDGE + [text(rng, rng.randrange(1, 60)) for _ in range(120)]
    texts += [texts[20]] * 40 + [texts[20] + " more"]
    df = spark.createDataFrame(rows(texts), DOCS).repartition(7)
    found = {r["doc_id"]: r for r in simhash.with_near_counts(simhash.fingerprint_documents(df)).collect()}
    assert len(found) == len(texts)
    own = [brute_fingerprint(t or "") for t in texts]
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        row = found[i]
        assert row["n_chars"] == len(t)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == f"{own[i]:032x}"
        assert row["edited_fingerprint"] == f"{brute_fingerprint(edited):032x}"
        like = lambda a, b: 1 - (a ^ b).bit_count() / 128
        assert row["near_edited"] == pytest.approx(like(own[i], int(row["edited_fingerprint"], 16)))
        assert row["near_next"] == pytest.approx(like(own[i], own[(i + 1) % len(texts)]))
        near = sum((own[i] ^ x).bit_count() <= simhash.RADIUS for x in own) - 1
        assert row["n_near"] == (near if i % 20 == 0 else None)


def test_fingerprints_of_odd_tables(spark):
    assert simhash.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
    (alone,) = simhash.fingerprint_documents(spark.createDataFrame(rows(["abcd"]), DOCS)).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    odd = spark.createDataFrame([(None, "x y", "", 1), (3, "b c", "", 1), (3, "b c", "", 1)], DOCS)
    found = simhash.with_near_counts(simhash.fingerprint_documents(odd)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["3", "3", "None"]


def test_near_counts_finds_all_within_the_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 8)  # buckets of several lists
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(5)]
    prints = []
    for _ in range(300):
        x = rng.choice(base)
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(128)
        prints.append(f"{x:032x}")
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint STRING")
    found = {r["fingerprint"]: r["n_near"] for r in simhash.near_counts(df, df).collect()}
    for p in prints:
        assert found[p] == sum((int(p, 16) ^ int(q, 16)).bit_count() <= simhash.RADIUS for q in prints)


def test_probes_are_not_broadcast(spark):
    """A query has 135 probes, which estimates leave out: however few the queries, they are dealt by bucket."""
    rows = [(f"{random.Random(i).getrandbits(128):032x}",) for i in range(40)]
    df = spark.createDataFrame(rows, "fingerprint STRING")
    found = simhash.near_lists(df, df)
    assert found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [bucket" in plan and "BuildLeft" not in plan


def test_near_prints_names_the_edited_copies(spark):
    rng = random.Random(12)
    originals = [text(rng, 300) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(originals)] + [(200, originals[0]), (300, None)]
    for i, t in enumerate(originals):
        words = t.split()
        for j in rng.sample(range(300), 6):  # similarity of about 0.82
            words[j] = f"changed{rng.randrange(1000)}"
        docs.append((100 + i, " ".join(words)))
    prints = simhash.fingerprint_documents(spark.createDataFrame(docs, "doc_id LONG, text STRING")).select("doc_id", "fingerprint")
    known = {r["doc_id"]: int(r["fingerprint"], 16) for r in prints.collect()}
    found = simhash.near_prints(prints, prints.where("doc_id < 60"))
    pairs = [(r["query_id"], int(r["fingerprint"], 16), r["distance"]) for r in found.collect()]
    wanted = {(q, x, (known[q] ^ x).bit_count()) for q in range(60) for x in known.values() if (known[q] ^ x).bit_count() <= simhash.RADIUS}
    assert set(pairs) == wanted and len(pairs) == len(wanted)
    near = {(r["query_id"], r["doc_id"]) for r in found.join(simhash.members(prints), "fingerprint").collect()}
    assert (0, 200) in near and sum((i, 100 + i) in near for i in range(60)) >= 57


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 20])
def test_near_counts_of_any_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(3)]
    values = [rng.choice(base) ^ sum(1 << i for i in rng.sample(range(128), rng.randrange(radius + 3))) for _ in range(60)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in values], "fingerprint STRING")
    found = {int(r["fingerprint"], 16): r["n_near"] for r in simhash.near_counts(df, df, radius).collect()}
    assert found == {x: sum((x ^ y).bit_count() <= radius for y in values) for x in values}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    links += [(300 + i, 301 + i) for i in range(60)] + [(5, 5), (None, 1), (500, 400), (500, 400)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = components(spark.createDataFrame(links, "a LONG, b LONG")).collect()
    nodes = {x for a, b in links if a is not None for x in (a, b)}
    assert {r["node"]: r["label"] for r in found} == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def shingle_bag(t):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").split()]
    return Counter(zip(*[words[i:] for i in range(5)], strict=False)) if len(words) >= 5 else Counter([tuple(words)] * bool(words))


def weighted_jaccard(a, b):
    keys = a.keys() | b.keys()
    both, union = sum(min(a[k], b[k]) for k in keys), sum(max(a[k], b[k]) for k in keys)
    return both / union if union else 1.0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    weight = rng.uniform(0.1, 4, (2, 60)) * (rng.random((2, 60)) < 0.7)
    doc, element = np.nonzero(weight)
    names = rng.integers(0, 1 << 48, 60).astype(np.uint64)
    k = 4000
    found = dartminhash.signatures(2, doc, names[element], weight[doc, element], k)
    wanted = np.minimum(*weight).sum() / np.maximum(*weight).sum()
    assert (found[0] == found[1]).mean() == pytest.approx(wanted, abs=0.04)
    assert (found != 0).all()
    assert (dartminhash.signatures(1, doc[:0], names[:0], weight[0, :0], 8) == 0).all()


def test_similarity_is_exact():
    rng = random.Random(6)
    a = [text(rng, 40) for _ in range(20)] + ["", "x", "the " * 500]
    b = [" ".join(w if rng.random() > 0.05 else "z" for w in t.split(" ")) for t in a]
    found = dartminhash.similarity(pa.array(a), pa.array(b))
    for x, y, got in zip(a, b, found, strict=True):
        assert got == pytest.approx(weighted_jaccard(shingle_bag(x), shingle_bag(y)))


def test_near_duplicates(spark):
    rng = random.Random(7)
    texts = list(EDGE)
    for _ in range(25):
        base = text(rng, rng.randrange(60, 200)).split(" ")
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    # One large group: exact copies, and a chain in which neighbours only are near.
    texts += [texts[-1]] * 30
    chain = text(rng, 150).split(" ")
    for i in range(20):
        chain = chain[3:] + [f"new{i}a", f"new{i}b", f"new{i}c"]
        texts.append(" ".join(chain))
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[i], "c", 1) for i in order], DOCS).repartition(5)
    found = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(df).collect()}
    bags = [shingle_bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (bags[i] and bags[j] and weighted_jaccard(bags[i], bags[j]) >= 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert found == {i: root(i) for i in range(len(texts))}


def test_near_duplicates_of_odd_tables(spark):
    assert dartminhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    odd = [(None, "x", "", 1), (4, "a b", "", 1), (4, "a b", "", 1), (2, "a b", "", 1)]
    found = dartminhash.near_duplicates(spark.createDataFrame(odd, DOCS)).collect()
    assert {(r["doc_id"], r["class_id"]) for r in found} == {(4, 2), (2, 2)}


def test_texts_that_share_an_id(spark):
    rng = random.Random(11)
    a, b = text(rng, 90), text(rng, 90)
    near = a.split(" ")
    near[40] = "edited"
    near = " ".join(near)
    rows = [(1, a, "", 1), (1, b, "", 1), (2, a, "", 1), (3, b, "", 1), (3, near, "", 1), (1, b, "", 1)]
    found = dartminhash.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 6 and {r["class_id"] for r in found} == {1}
    kept = {(r["doc_id"], bytes(r["digest"]).hex()) for r in found if r["kept"]}
    assert kept == {(1, hashlib.md5(x.encode()).hexdigest()) for x in (a, b)}


def test_pairs_of_copies_below_the_limit_grow_in_proportion(spark, monkeypatch):
    """Each copy has three words of its own: 0.77 to the original, 0.59 to each other."""
    rng = random.Random(12)
    base = text(rng, 120).split(" ")
    texts = [" ".join(base)]
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(6, 108, 6), 3):
            copy[at + rng.randrange(2)] = f"edit{i}x{at}"
        texts.append(" ".join(copy))
    # Copies of copies, which are linked.
    for i in (7, 230):
        texts.append(texts[i].replace(texts[i].split(" ")[60], "again"))
    opened = []
    verified = dartminhash._verified
    monkeypatch.setattr(dartminhash, "_verified", lambda pairs, *rest: opened.append(pairs.count()) or verified(pairs, *rest))
    totals = []
    for n in (200, 400):
        df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts) if i <= n or i > 400], DOCS)
        opened.clear()
        found = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(df).collect()}
        totals.append(sum(opened))
        bags = {i: shingle_bag(texts[i]) for i in found}
        near = {i: 7 for i in found if weighted_jaccard(bags[i], bags[7]) >= 0.8}
        assert found[401] == 7 and set(near) == {7, 401} and found[402] == (230 if n == 400 else 402)
        alone = [i for i in found if i not in (7, 230, 401, 402)]
        assert all(found[i] == i for i in alone)
    assert totals[1] <= 2.5 * totals[0]


def edit_distance(item, t):
    """To the best matching substring of ``t``."""
    last = [0] * (len(t) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
        last = row
    return min(last)


def test_within_is_exact():
    rng = random.Random(8)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))
        wanted = edit_distance(item, t)
        for most in (0, 1, 3, 12):
            assert cgk.within(item, t, most) == (wanted if wanted <= most else None)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_contaminated(spark, block_bytes):
    rng = random.Random(9)
    items = [(i, text(rng, rng.randrange(12, 50))) for i in range(30)]
    items += [(100, "Short Item here"), (101, ""), (102, None), (None, "no id"), (3, items[3][1])]
    docs, wanted = [None, "", "a" * 30_000, "short item  here now"], [set(), set(), set(), {100}]
    for i in range(60):
        body = text(rng, rng.randrange(0, 80), ["only", "other", "words"])
        inside = set(rng.sample(range(30), rng.choice([0, 1, 2])))
        for k in inside:
            body += " " + items[k][1].upper() + " " + text(rng, 20, ["more"])
        docs.append(body)
        wanted.append(inside)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(docs)], DOCS)
    found = cgk.contaminated(df, spark.createDataFrame(items, "item_id LONG, text STRING"), block_bytes=block_bytes)
    got = {r["doc_id"]: r for r in found.collect()}
    assert [set(got[i]["item_ids"]) for i in range(len(docs))] == wanted
    assert all(r["contaminated"] == bool(r["item_ids"]) and r["n_items"] == len(r["distances"]) for r in got.values())
    empty = spark.createDataFrame([], "item_id LONG, text STRING")
    assert not any(r["contaminated"] for r in cgk.contaminated(df, empty).collect())
    assert cgk.contaminated(spark.createDataFrame([], DOCS), empty).count() == 0


def test_edited_items_are_found():
    rng = random.Random(10)
    items = [text(rng, rng.randrange(15, 60)) for _ in range(100)]
    index = cgk.Items(list(range(100)), items)
    recall = defaultdict(list)
    for rate in (0.0, 0.02, 0.05):
        docs = []
        for item in items:
            letters = list(item)
            for _ in range(int(rate * len(item))):
                letters[rng.randrange(len(letters))] = "z"
            docs.append(text(rng, 30) + " " + "".join(letters) + " " + text(rng, 30))
        found = [m for words in split_words(pa.array(docs)) for m in index.matches(words)]
        recall[rate] = sum(i in m for i, m in enumerate(found)) / len(items)
        assert all(set(m) <= {i} for i, m in enumerate(found))
    assert recall[0.0] == 1.0 and recall[0.02] >= 0.97 and recall[0.05] >= 0.85


@pytest.mark.parametrize("kind", ["spread", "random", "shifted"])
def test_items_at_the_edit_limit_are_found(kind):
    rng = random.Random(11)
    items = [text(rng, n) for n in (8, 9, 10, 12, 15, 18, 20, 40) for _ in range(10)]
    items += [text(rng, 10, ["internationalisation", "straßenbahnhaltestelle", "日本語日本語日本語日本"]) for _ in range(20)]
    index = cgk.Items(list(range(len(items))), items)
    docs = []
    for item in items:
        letters, most = list(item), int(cgk.EDITS * len(item))
        places = [(2 * j + 1) * len(item) // (2 * most) for j in range(most)] if kind == "spread" else rng.sample(range(len(item)), most)
        for j in sorted(places, reverse=True):
            letters[j : j + (kind != "shifted" or rng.random() < 0.5)] = [] if kind == "shifted" and rng.random() < 0.5 else ["ž"]
        docs.append(text(rng, 30) + " " + "".join(letters) + " " + text(rng, 30))
    found = [m for words in split_words(pa.array(docs)) for m in index.matches(words)]
    for i, m in enumerate(found):
        distance = cgk.within(cgk.fold(items[i]), cgk.fold(docs[i]), int(cgk.EDITS * len(items[i])))
        assert (distance is not None) == (i in m) and m.get(i, distance) >= (distance or 0)
    assert all(i in m for i, m in enumerate(found))
