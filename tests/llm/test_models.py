"""Language identification, language-model scores and personal data."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seenscope.llm import hpyp, language, pii

SF_DIR = "/root/testdata/sf0.001"
EDGE = [None, "", " \n", "123 456 --", "日本語", "a" * 30_000, "été ÉTÉ"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def held_out(i, modulus=0):
    return zlib.crc32(str(i).encode()) % 5 == modulus


# --- language ---------------------------------------------------------------------------


def test_language_of_held_out_documents(documents):
    found = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == documents.count()
    tested = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in tested} == {r["doc_id"] for r in found if held_out(r["doc_id"])}
    assert sum(r["lang_pred"] == r["lang"] for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_uses_neither_label_nor_held_out_texts(documents):
    changed = documents.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify(x).collect())) for x in (documents, changed))
    assert a == b


def test_language_edge_cases(spark, documents):
    model = language.train(documents.withColumn("score", F.lit("clash")))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGE)], "doc_id LONG, text STRING, score STRING")
    found = language.predict(df, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in found] == [t is None or not any(c.isalpha() for c in t) for t in EDGE]
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in found)
    nothing = language.train(documents.where("false"))
    assert {r["lang_pred"] for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.identify(documents.where("false")).count() == 0


def test_ngrams_are_those_of_the_text():
    texts = ["Ab c", "", "é1a"]
    (found,) = language.features(pa.array(texts))
    # Each letter gives a single, a pair with the sign before, and a triple around it.
    assert np.bincount(found.doc, found.tf, 3).tolist() == [9, 0, 6]
    alone = [list(language.features(pa.array([t])))[0] for t in texts]
    together = [sorted(zip(found.bucket[found.doc == d], found.tf[found.doc == d], strict=True)) for d in range(3)]
    assert together == [sorted(zip(f.bucket, f.tf, strict=True)) for f in alone]


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(500, 3)) * 5
    p = language.softmax(scores / 4)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert language.temperature(scores, labels) == pytest.approx(4, rel=0.25)


# --- scores -----------------------------------------------------------------------------


def brute_tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\0end"]


@pytest.mark.parametrize("partitions", [1, 6])
def test_base_scores(spark, documents, partitions):
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*EDGE, *EDGE])], "doc_id LONG, text STRING")
    df = documents.select("doc_id", "text").union(odd).repartition(partitions)
    rows = df.collect()
    found = {r["doc_id"]: r for r in hpyp.score_documents(df.withColumn("part", F.lit("clash"))).collect()}
    counts = Counter(t for r in rows if not held_out(r["doc_id"], 1) for t in brute_tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in rows:
        got, tokens = found[r["doc_id"]], brute_tokens(r["text"])
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(tokens), sum(t in counts for t in tokens), n)
        assert got["held_out"] == held_out(r["doc_id"], 1)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert got["base_score"] == pytest.approx(base, rel=1e-9)
        assert got["score"] < 0
    held = [r for r in found.values() if r["held_out"] and r["doc_id"] < 10_000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_depend_on_the_rows_only(spark, documents, monkeypatch):
    monkeypatch.setattr(hpyp, "BUCKET_TOKENS", 1 << 14)
    known = None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, shuffles, part in ((1, 2, 4 << 20), (7, 16, 4 << 20), (16, 5, 1 << 16)):
            monkeypatch.setattr(hpyp, "PART_BYTES", part)
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            df = documents.select("doc_id", "text").repartition(partitions)
            found = {r["doc_id"]: r["score"] for r in hpyp.score_documents(df).collect()}
            known = known or found
            assert found == pytest.approx(known, rel=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_frequent_words_are_counted_exactly(spark, documents):
    df = documents.select("text").repartition(5)
    counts = Counter(t for r in df.collect() for t in brute_tokens(r["text"]))
    found = hpyp.count_words(df, "text")
    assert sorted(r["n"] for r in found.collect()) == sorted(counts.values())
    least = sorted(counts.values())[-hpyp.FREQUENT :][0]
    frequent = set(hpyp.frequent_words(found).view(np.int64).tolist())
    assert len(frequent) == min(hpyp.FREQUENT, len(counts))
    assert all(r["word"] in frequent for r in found.where(F.col("n") > least).collect())
    assert [hpyp.bucket_number(n * hpyp.BUCKET_TOKENS) for n in (0, 1, 2, 3, 4, 5)] == [1, 1, 2, 4, 4, 8]


def plain_log_p(sentences, rng, sweeps):
    """Customers seated one by one in dictionaries, with the discounts and strengths of the
    model; log10 of the mean probabilities over ``sweeps`` after as many, by text."""
    pairs = Counter((u, w) for s in sentences for u, w in zip(["", *s], s, strict=False))
    words = sorted({w for _, w in pairs})
    uniform, d = 1 / (len(words) + 1), None
    t = {c: 1 for c in pairs}
    t0 = {w: 1 for w in words}
    customers = Counter()
    for (u, _), n in pairs.items():
        customers[u] += n
    share = hpyp.discount(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
    out = []
    for turn in range(2 * sweeps):
        c0, tables = Counter(), Counter()
        for (u, w), n in t.items():
            c0[w] += n
            tables[u] += n
        d = hpyp.discount(sum(n == 1 for n in c0.values()), sum(n == 2 for n in c0.values()))
        fresh = (hpyp.SHARED_STRENGTH + d * sum(t0.values())) * uniform
        p0 = {w: (c0[w] - d * t0[w] + fresh) / (hpyp.SHARED_STRENGTH + sum(c0.values())) for w in words}
        if turn >= sweeps:
            novelty = {u: hpyp.STRENGTH + share * tables[u] for u in customers}
            p = {c: (n - share * t[c] + novelty[c[0]] * p0[c[1]]) / (hpyp.STRENGTH + customers[c[0]]) for c, n in pairs.items()}
            out.append(p)
        for (u, w), n in pairs.items():
            a, new = (hpyp.STRENGTH + share * tables[u]) * p0[w], 1
            for i in range(1, n):
                new += rng.random() * (a + i - share * new) < a
            t[u, w] = new
        c0 = Counter()
        for (_, w), n in t.items():
            c0[w] += n
        for w in words:
            new = 1
            for i in range(1, c0[w]):
                new += rng.random() * (fresh + i - d * new) < fresh
            t0[w] = new
    mean = {c: sum(p[c] for p in out) / len(out) for c in pairs}
    return np.array([sum(math.log10(mean[c]) for c in zip(["", *s], s, strict=False)) for s in sentences])


def test_scores_agree_with_a_plain_sampler(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    ids = [i for i in range(400) if not held_out(i, 1)]
    texts = [" ".join(words[int(60 * rng.random() ** 2)] for _ in range(rng.randrange(1, 30))) for _ in ids]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id LONG, text STRING")
    found = {r["doc_id"]: r["score"] for r in hpyp.score_documents(df).collect()}
    # All words are frequent, so their scores come from the first pass. The sampling error is
    # that of runs of the plain sampler among themselves.
    runs = np.array([plain_log_p([brute_tokens(t) for t in texts], rng, hpyp.FIRST_SWEEPS // 2) for _ in range(40)])
    wanted, spread = runs.mean(axis=0), runs.std(axis=0)
    got = np.array([found[i] for i in ids])
    off = (got - wanted) / spread
    assert math.sqrt((off**2).mean()) <= 1.5 and abs(off).max() <= 6
    assert got.sum() == pytest.approx(wanted.sum(), rel=0.002)


def test_scores_edge_cases(spark, documents):
    assert hpyp.score_documents(documents.where("false")).count() == 0
    one = next(i for i in range(100) if held_out(i, 1))
    alone = spark.createDataFrame([(one, "never seen"), (None, "x")], "doc_id LONG, text STRING")
    found = hpyp.score_documents(alone).collect()
    assert all(r["train_tokens"] == 0 and r["held_out"] and r["score"] == 0 for r in found)
    row = hpyp.perplexity(hpyp.score_documents(documents)).where("held_out").first()
    assert 1 < row["perplexity"] < 50_000


def test_seating_agrees_with_one_by_one():
    rng = np.random.default_rng(2)
    for customers, a, d in ((1, 0.5, 0.5), (20, 0.7, 0.6), (400, 3.0, 0.2)):
        tables = hpyp.seat(rng, np.full(4000, customers), np.full(4000, a), d)
        plain = []
        for _ in range(1500):
            t = 1
            for i in range(1, customers):
                t += rng.random() * (a + i - d * t) < a
            plain.append(t)
        assert tables.mean() == pytest.approx(np.mean(plain), rel=0.06)
        assert tables.min() >= 1 and tables.max() <= customers


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    n_words = 200
    words = (np.arange(1, n_words + 1, dtype=np.uint64) * np.uint64(1 << 40)).repeat(3)
    key = words | np.tile(np.array([1, 5, 9], np.uint64), n_words)
    cells = hpyp.Cells.make(key, rng.integers(1, 30, len(key)))
    t, c0, t0 = list(cells.sweeps(5, rng, None, 1.0))[-1]
    totals = cells.estimate(cells.context, t, c0, t0, 1.0)
    shared = totals.shared(c0, t0)
    assert shared.sum() + totals.shared(0.0, 0.0) == pytest.approx(1)
    for u in (1, 5, 9):
        mine = cells.context == u
        own = (cells.count - totals.discount * t)[mine].sum() / (hpyp.STRENGTH + totals.customers[u])
        assert own + totals.novelty[u] == pytest.approx(1)


def test_key_planes():
    keys = np.sort(np.random.default_rng(4).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (hpyp.keys_of(hpyp.unbundle(hpyp.bundle(hpyp.planes(keys)))[0]) == keys).all()


# --- personal data ----------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: [c for c in m[0] if c in "0123456789"]

    def card(m):
        d = [int(c) for c in digits(m)][::-1]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
        return 16 <= len(d) <= 19 and total % 10 == 0

    checks = [
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", CARD, card),
        ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, good in checks for m in pattern.finditer(text) if good(m)]


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    parts = ["4111111111111111", "5500 0000 0000 0004", "10.0.0.255", "256.1.1.1", "1.2.3.4.5", "a@b.c@d.e", "x@y", "@a.b", "a.b-c@x-y.z.", "+1 (456) 555-2186", "+49", "007", " ", "-", ".", "@", "+", "(", "é", "0000010.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "1", "1." * 100_000, "@" * 100_000, "+1(" * 50_000):
        assert pii.base_spans(text) is not None
        pii.graph([text], [[]])


def test_personal_data_digest(spark, documents):
    texts = [*EDGE, "+1 (269) 555-3296 4524132264652876 x", "id 4524132264652876, again 4524132264652876"]
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    df = documents.select("doc_id", "text").union(odd).withColumn("base_spans", F.lit("clash"))
    found = {r["doc_id"]: r for r in pii.digest(df).collect()}
    for r in df.collect():
        spans = brute_spans(r["text"] or "")
        base = [f"{k}:{a}:{b}" for k, a, b in spans]
        got = found[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        every = got["spans"].split(",") if got["spans"] else []
        assert set(base) <= set(every)
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in every)]
        assert order == sorted(order)
    assert pii.digest(documents.where("false")).count() == 0


def test_random_field_adds_what_patterns_merge(spark):
    clean = [f"call +1 (4{i % 10}6) 555-21{i % 90 + 10} or pay 4111111111111111 from 10.0.0.{i % 200} ." for i in range(400)]
    merged = "so +1 (269) 555-3296 4111111111111111 it"
    df = spark.createDataFrame(list(enumerate([*clean, merged, "version 2.0. of 3"])), "doc_id LONG, text STRING")
    found = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    assert not brute_spans(merged)
    assert "card:21:37" in found[400].split(",") and "phone:3:20" in found[400].split(",")
    assert found[401] == ""


def test_what_the_field_learns_from_is_bounded(spark, monkeypatch):
    seen = []
    learn = pii.learn
    monkeypatch.setattr(pii, "learn", lambda shapes, label, edges: seen.append(len(label)) or learn(shapes, label, edges, 2))
    line = "mail a{}@b.cd now"
    distinct = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("mail a%s@b.cd now", "id").alias("text"))
    no_id = distinct.withColumn("doc_id", F.lit(None).cast("long"))
    one_id = distinct.withColumn("doc_id", F.lit(5).cast("long"))
    copies = distinct.withColumn("text", F.lit(line.format(1))).withColumn("doc_id", F.lit(1).cast("long"))
    for df in (distinct, no_id, one_id):
        pii.train(df, sample=100)
    assert all(50 <= n <= 100 for n in seen)
    del seen[:]
    pii.train(copies)
    assert seen == [1]  # a token with a digit or an @, once
    pii.train(no_id, most=640)
    assert seen[1:] == [640]
    long_text = spark.createDataFrame([(1, line.format(1) * 50), (2, line.format(2))], "doc_id LONG, text STRING")
    pii.train(long_text, most=640)
    assert seen[2:] == [1]
    assert (pii.train(distinct.where("false")).unary == 0).all()


def test_personal_data_of_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "a@b.cd"), (None, "x"), (3, "1.2.3.4"), (3, "e@f.gh"), (3, "e@f.gh"), (4, None)]
    found = pii.digest(spark.createDataFrame([(*r, "c") for r in rows], "doc_id LONG, text STRING, spans STRING"))
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"]) for r in found.collect()) == [
        ("3", 0, 1), ("3", 1, 0), ("3", 1, 0), ("4", 0, 0), ("None", 0, 0), ("None", 1, 0),
    ]
    assert pii.digest(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


def test_skip_edges_make_labels_consistent():
    field = pii._new_field()
    token = pii._shapes("12345")
    field.unary[list(token), 3] = [0.4, 0.4]
    text = "12345 is what 12345 was and 12345"
    found = pii.graph([text], [[]])
    assert found.edges.tolist() == [[0, 1, pii.EQUAL], [1, 2, pii.EQUAL]]
    weak = pii.marginals(found, field)
    field.agree[pii.EQUAL] = 1.5
    assert (pii.marginals(found, field)[:, 3] > weak[:, 3]).all()


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(6)
    field = pii._new_field()
    found = pii.graph(["a1 b2 c3"], [[]])
    field.unary[:] = rng.normal(size=field.unary.shape)
    field.follow[:] = rng.normal(size=field.follow.shape)
    own = field.unary[found.shapes].sum(1)
    joint = own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :]
    joint = np.exp(joint + field.follow[:, :, None] + field.follow[None])
    wanted = [joint.sum(axis=x) / joint.sum() for x in ((1, 2), (0, 2), (0, 1))]
    assert np.allclose(pii.marginals(found, field, 40), wanted, atol=1e-4)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or 4111111111111111!"), (2, None), (3, "none")], "doc_id LONG, text STRING")
    found = {r["doc_id"]: r["text"] for r in pii.redact(df, pii._new_field()).collect()}
    assert found == {1: "mail [EMAIL] or [CARD]!", 2: None, 3: "none"}
