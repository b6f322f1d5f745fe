"""Trust, revisits, chat formatting, packing, and the pipeline, against brute force."""

import json
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from seenscope.llm import cgk, chat, dartminhash, language, packing, pii, queries, trust, warc
from seenscope.llm.tokens import WordTokenizer, tokenizer_path
from seenscope.llm.words import split_words

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_every_operator_is_registered():
    names = list(entry_point.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    wanted = connection.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    found = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(columns)
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(found.select(columns).collect()) == as_text(wanted.fetchall())


# --- trust ------------------------------------------------------------------------------

PAGES = "page_id LONG, url STRING, html STRING, host STRING, rule STRING"


def test_verdicts_of_odd_urls(spark):
    urls = {
        1: (None, "", "", None), 2: ("no scheme", "", "", None), 3: ("", "", "", None),
        4: ("http://A.COM", "a.com", "", None), 5: ("http://a.com/x?y://z", "a.com", "/x", "com/"),
        6: ("HTTP://www.Example.com/en/a#b", "www.example.com", "/en/a", "www.example.com/en/"),
        7: ("x://m.example.com/en/?q", "m.example.com", "/en/", "example.com/en/"),
        8: ("http://x.net/fr/", "x.net", "/fr/", "net/fr/"), 9: ("http://xcom/", "xcom", "/", None),
        10: ("http://É.com/", "É.com", "/", "com/"), 11: ("//b.com/", "", "", None),
        12: ("u://a?b://c.com/d", "a", "", None), 13: ("http://com/" + "x" * 50_000, "com", "/" + "x" * 50_000, "com/"),
    }
    df = spark.createDataFrame([(i, u, None, "clash", "clash") for i, (u, *_) in urls.items()] * 2, PAGES)
    found = trust.judge(df).collect()
    assert len(found) == 2 * len(urls)
    for r in found:
        assert (r["host"], r["path"], r["rule"]) == urls[r["page_id"]][1:]
        if r["rule"]:
            assert r["verdict"] == ("block" if r["rule"] in ("example.com/en/", "net/es/", "net/fr/") else "allow")
    assert trust.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_trust_spreads_as_page_rank(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.org" for i in range(12)] + ["good.com", "bad.net"]
    pages, edges, votes = [], defaultdict(float), defaultdict(lambda: [0, 0])
    for i in range(150):
        host = rng.choice(hosts[:3] if i < 50 else hosts)  # a hot host among them
        path = rng.choice(["/fr/", "/x/"])
        targets = [rng.choice(hosts) for _ in range(rng.randrange(4))]
        pages.append((i, f"http://{host}{path}", "".join(f'<a HREF="https://{t.upper()}/p">' for t in targets), "", ""))
        for t in targets:
            if t != host:
                edges[host, t] += 1
        if host == "good.com":
            votes[host][0] += 1
        if host == "bad.net" and path == "/fr/":
            votes[host][1] += 1

    def rank(edges, which):
        total = sum(v[which] for v in votes.values())
        seed = {h: v[which] / total for h, v in votes.items() if v[which]}
        out = defaultdict(float)
        for (a, _), n in edges.items():
            out[a] += n
        now = dict(seed)
        for _ in range(trust.ROUNDS):
            new = defaultdict(float, {h: s * (1 - trust.DAMPING) for h, s in seed.items()})
            for (a, b), n in edges.items():
                new[b] += now.get(a, 0) * n / out[a] * trust.DAMPING
            now = new
        return now

    good, bad = rank(edges, 0), rank({(b, a): n for (a, b), n in edges.items()}, 1)
    for r in trust.judge(spark.createDataFrame(pages, PAGES).repartition(5)).collect():
        assert r["trust"] == pytest.approx(good.get(r["host"], 0))
        assert r["distrust"] == pytest.approx(bad.get(r["host"], 0))
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["distrust"] > r["trust"] else "allow")


def test_small_seeds_spread_in_large_tables(spark):
    edges = spark.createDataFrame([("linker.com", "bad.net", 1), ("other.org", "large.net", 1)], "a STRING, b STRING, n LONG")
    for large in (10, 10**14):  # blocked URLs of the rest of the table
        seeds = spark.createDataFrame([("bad.net", 0, 1), ("large.net", 0, large), ("good.com", 5, 0)], "host STRING, allowed LONG, blocked LONG")
        found = {r["host"]: r for r in trust.spread(edges, seeds).collect()}
        wanted = trust.DAMPING * (1 - trust.DAMPING) / (large + 1)
        assert found["linker.com"]["distrust"] == pytest.approx(wanted, rel=1e-6, abs=0)
        assert found["linker.com"]["trust"] == 0


# --- revisits ---------------------------------------------------------------------------

RECORDS = "record_id LONG, kind STRING, uri STRING, date LONG, headers MAP<STRING, STRING>, payload STRING, part INT"


def test_canonical_urls(spark):
    cases = {
        "HTTP://A.com:80": "http://a.com/", "https://A.com:443/B?utm_source=x&c=1&ref=y#z": "https://a.com/B?c=1",
        "http://a.com/?ref": "http://a.com/", "http://a.com:8080/x?&&k=": "http://a.com:8080/x?k=",
        "no scheme#x": "no scheme", "": "", "http://a.com/?reference=1": "http://a.com/?reference=1",
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "u STRING")
    found = dict(df.select("u", warc.canonical_url(F.col("u"))).collect())
    assert found == {**cases, None: None}


def test_revisits_with_a_hot_url(spark):
    rng = random.Random(2)
    records = []
    for i in range(900):
        url = "http://hot.com/" if rng.random() < 0.5 else f"http://u{rng.randrange(40)}.com/"
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        headers = {"ETag": f'"{rng.randrange(3)}"', "X-Own": kind, "AGE": str(i)}
        if rng.random() < 0.2:
            headers = {"Last-Modified": str(rng.randrange(2))} if rng.random() < 0.5 else {}
        records.append((i, kind, url + rng.choice(["", "#f"]), rng.randrange(200), headers, f"body {i}" if kind == "response" else None, 1))
    records += [(2000, "revisit", None, 5, None, None, 1), (2001, "revisit", "http://hot.com/", None, {}, None, 1), (2002, None, None, None, None, None, 1)]
    found = {r["revisit_id"]: r for r in warc.resolve(spark.createDataFrame(records, RECORDS).repartition(3)).collect()}
    assert set(found) == {r[0] for r in records if r[1] == "revisit"}
    lower = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    by_id = {r[0]: r for r in records}
    for i, row in found.items():
        _, _, url, date, headers, _, _ = by_id[i]
        before = [
            r for r in records
            if r[1] == "response" and url and date is not None and r[2].split("#")[0] == url.split("#")[0] and (r[3], r[0]) < (date, i)
        ]
        mine, wanted = lower(headers), max(before, key=lambda r: (r[3], r[0]), default=None)
        theirs = lower(wanted[4]) if wanted else {}
        first = next((k for k in ("etag", "last-modified") if k in mine), None)
        if wanted and first and mine[first] == theirs.get(first):
            assert (row["outcome"], row["refers_to"], row["payload_chars"]) == ("resolved", wanted[0], len(wanted[5]))
            update = {k: v for k, v in mine.items() if k in warc.PERMITTED}
            assert row["headers"] == {**theirs, **update}
        else:
            assert (row["outcome"], row["refers_to"]) == ("mismatch" if wanted else "missing", None)
            assert row["headers"] == mine
    assert warc.resolve(spark.createDataFrame([], RECORDS)).count() == 0
    some = warc.resolve(spark.createDataFrame(records, RECORDS))
    payloads = warc.with_payload(some, spark.createDataFrame(records, RECORDS)).where("outcome = 'resolved'")
    assert all(r["payload"] == f"body {r['refers_to']}" for r in payloads.collect())


# --- chat -------------------------------------------------------------------------------


def test_escaping_is_reversible(spark):
    rng = random.Random(3)
    parts = ["%", "25", "3C", "5B", "<", "|", ">", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|end|>\n", "<|user|>\n", "x", "\n", "[", "7C", "\\", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(3000)] + ["é" * 50_000]
    df = spark.createDataFrame([(i, i % 2, rng.choice(["user", "assistant", "a|b<|end|>\n"]), t) for i, t in enumerate(texts)], "conv_id LONG, turn LONG, role STRING, text STRING")
    done = chat.format_chats(chat.canonical_table(df)).select("*", chat.read_back(F.col("formatted")).alias("back"))
    for r in done.collect():
        assert r["back"] == r["turns"]
        body = r["formatted"]
        for s in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert s not in body
        assert body.count("<|") == 2 * len(r["turns"])
        spans = [body[s["start"] - 1 : s["start"] - 1 + s["length"]] for s in r["loss_mask"]]
        assert len(spans) == sum(t["role"] == "assistant" for t in r["turns"])


def test_turn_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (1, None, None, "first"), (None, 0, "user", "x"), (9, 0, "user", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, turns STRING")
    found = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.canonical_table(df))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in found.items()} == {1: (4, 2), None: (1, 0), 9: (1, 0)}
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical_table(df).collect()}
    assert turns[1] == [("", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.canonical_table(df.where("false")).count() == 0


def test_mixed_json_layouts(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "gpt", "content": "a"}], "id": 4, "extra": {"role": 1}},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt-completion": {"completion": "a", "prompt": "q"},
        "question-answer": {"question": "q", "answer": "a", "layout": "x"},
        "instruction-output": {"instruction": "q", "output": "a", "input": None},
        "instruction-input-output": {"instruction": "q", "input": "more", "output": "a"},
        "system-prompt-response": {"system": "s", "prompt": "q", "response": "a"},
    }
    texts = [json.dumps(r) for r in records.values()] + ["not json", None, "{}", '{"prompt": "q"}', "[]"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id LONG, record STRING, layout STRING")
    found = [r for r in chat.canonical_json(df).orderBy("id").collect()]
    assert [r["layout"] for r in found] == [*records, *[None] * 5]
    for name, r in zip(records, found, strict=False):
        turns = [tuple(t) for t in r["turns"]]
        question = "q\n\nmore" if "input" in name else "q"
        assert turns[-2:] == [("user", question), ("assistant", "a")]
        assert turns[:-2] == ([("system", "s")] if name.startswith("system") else [])
    assert all(r["turns"] is None for r in found[len(records) :])


def test_json_records_with_fields_of_several_layouts(spark):
    said = [{"role": "system", "content": None}, {"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]
    pair = [("user", "q"), ("assistant", "a")]
    cases = [
        ({"prompt": "q", "completion": "a", "system": "s"}, "system-prompt-completion", [("system", "s"), *pair]),
        ({"question": "q", "answer": "a", "system": ""}, "system-question-answer", [("system", ""), *pair]),
        ({"question": "q", "answer": "a", "system": None}, "question-answer", pair),
        ({"prompt": "x", "messages": said}, "messages", [("system", ""), *pair]),
        ({"prompt": "x", "completion": "y", "system": "s", "messages": said[1:]}, "system-messages", [("system", "s"), *pair]),
        ({"prompt": "q", "completion": "a", "messages": []}, "prompt-completion", pair),
        ({"prompt": "x", "instruction": "q", "output": "a", "response": "b"}, "instruction-output", pair),
        ({"system": "s", "prompt": "q"}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(cases)], "id LONG, record STRING")
    found = chat.canonical_json(df).orderBy("id").collect()
    assert [r["layout"] for r in found] == [layout for _, layout, _ in cases]
    assert [r["turns"] and [tuple(t) for t in r["turns"]] for r in found] == [turns for _, _, turns in cases]
    assert all(chat.BY_FINGERPRINT[r["fingerprint"]].name == r["layout"] for r in found[:-1])
    assert found[-1]["fingerprint"] == chat.fingerprint(["system", "prompt"])


def test_turn_tables_are_chosen_by_fingerprint(spark):
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    wanted = chat.TURN_ROWS.fingerprint
    assert chat.schema_fingerprint(chat.paths_of(turns.schema)) == wanted
    clashing = turns.withColumns({"prompt": F.lit("x"), "response": F.lit("y"), "turns": F.lit(1)})
    assert chat.schema_fingerprint(chat.paths_of(clashing.schema)) == wanted
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)
    assert sorted(chat.canonical_table(clashing).collect()) == sorted(chat.canonical_table(turns).collect())


def test_lists_are_read_by_name(spark):
    kind = "conv_id LONG, messages ARRAY<STRUCT<id: INT, content: STRING, role: STRING>>, system STRING"
    df = spark.createDataFrame([(1, [(7, "q", "user")], "s"), (2, None, None)], kind)
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical_table(df).collect()}
    assert found == {1: [("system", "s"), ("user", "q")], 2: []}


def test_table_layouts(spark):
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)])], "conv_id LONG, conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>")
    flat = spark.createDataFrame([(1, "q", "")], "conv_id LONG, prompt STRING, response STRING")
    for df in (nested, flat):
        (row,) = chat.canonical_table(df).collect()
        assert [tuple(t) for t in row["turns"]] == [("user", "q"), ("assistant", "")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_table(spark.createDataFrame([(1, "q")], "conv_id LONG, prompt STRING"))


# --- packing ----------------------------------------------------------------------------


def test_tokenizer_agrees_with_the_library():
    rng = random.Random(4)
    signs = [chr(c) for c in range(1, 0x250)] + [" "] * 60
    texts = ["", "don't WE'LL 's", "<|endoftext|>x <|startoftext|>", "É́ ª ½³ 日本 テ", "a\u3000b\u00a0c\u0085d", "İ ΣΑΣ", "a" * 5000]
    texts += ["".join(rng.choice(signs) for _ in range(50)) for _ in range(1500)]
    full = Tokenizer.from_file(tokenizer_path())
    wanted = [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]
    own, found = WordTokenizer.load(tokenizer_path()), []
    for words in split_words(pa.array(texts), 4000):
        ids, counts = own.encode(words)
        found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == wanted


def test_differencing_balances_and_fits():
    rng = np.random.default_rng(5)
    assert packing.difference(np.array([8, 7, 6, 5, 4]), 2).tolist() in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [1, 0, 1, 0, 0], [0, 1, 0, 1, 1])
    for n in (0, 1, 2, 50, 300):
        sizes = rng.integers(1, 700, n)
        window = packing.pack(sizes)
        sums = np.bincount(window, sizes) if n else np.zeros(1)
        assert sums.max() <= packing.WINDOW and len(window) == n
        if n >= 50:
            assert sums.sum() / (len(sums) * packing.WINDOW) > 0.85
            assert sums.max() - sums.min() < 120


def brute_pieces(rows, texts):
    full = Tokenizer.from_file(tokenizer_path())
    ids = {i: full.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[i][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[i]))
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["length"] > 0
            at += r["length"]
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    return sum(len(x) for x in ids.values()) / (packing.WINDOW * len(by_sequence))


def test_packing(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    texts |= {10_000: None, 10_001: "", 10_002: "word " * 30_000, 10_003: "x" * 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING").withColumn("offset", F.lit("clash"))
    assert brute_pieces(packing.pack_documents(df.repartition(3)).collect(), texts) > 0.9
    ids = packing.pack_documents(df.limit(3), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in ids)
    assert packing.pack_documents(df.where("false")).count() == 0


# --- pipeline ---------------------------------------------------------------------------


def test_pipeline(spark, documents):
    docs = {r["doc_id"]: r for r in documents.collect()}
    clean = max(docs.values(), key=lambda r: (r["n_chars"] < 3000, r["n_chars"]))
    words = clean["text"].split(" ")
    words[5] = "edited"
    extra = [
        (10_000, "12345 --", "en", "src0", 8), (10_001, None, "en", "src0", None), (None, "the end of it", "en", "src0", 13),
        (10_002, clean["text"], "en", "src0", 5), (10_003, " ".join(words), "en", "src0", 5),
        (10_004, "this and that", "en", None, 13), (10_004, "this and that", "en", None, 13),
    ]
    start = documents.unionByName(spark.createDataFrame(extra, documents.schema)).withColumn("label", F.lit("clash"))
    kept, seen = start, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR).persist()
        assert kept.columns == corpus_pipeline.COLUMNS
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert kept.count() == len(seen[name]) + (name == "language")
    known = set(seen["language"])
    assert not known & {10_000, 10_001, None} and known >= {i for i, r in docs.items() if len(r["text"]) > 200}
    classes = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(start.where(F.col("doc_id").isin([*known]))).collect()}
    assert set(seen["near_duplicates"]) == set(classes.values())
    assert classes[10_002] == classes[10_003] == classes[clean["doc_id"]] and 10_004 in seen["near_duplicates"]
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaked = {i for i, t in seen["near_duplicates"].items() if any(x in t for x in items)}
    assert leaked and not leaked & set(seen["decontamination"])
    assert len(seen["near_duplicates"]) - len(seen["decontamination"]) <= len(leaked) + 1
    assert set(seen["personal_data"]) == set(seen["decontamination"])
    assert all(not pii.base_spans(t) or t != docs[i]["text"] for i, t in seen["personal_data"].items() if i in docs)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    assert brute_pieces(corpus_pipeline.pack(spark, kept, SF_DIR).collect(), seen["personal_data"]) > 0.9


def test_kept_texts_are_not_shuffled(spark, documents):
    """Rows whose ids are not dropped are kept by a branch without a join by shuffle."""
    few = documents.orderBy("doc_id").limit(12)
    few = few.unionByName(few.withColumn("doc_id", F.col("doc_id") + 50_000))
    kept = corpus_pipeline.drop_near_duplicates(spark, few.coalesce(1), SF_DIR)
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    branches = [i for i, line in enumerate(plan) if line.startswith((":- ", "+- "))]
    assert plan[0].startswith("Union") and len(branches) == 2
    assert not any("LeftAnti" in line for line in plan[: branches[1]]) and any("LeftAnti" in line for line in plan[branches[1] :])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["doc_id"] for r in few.collect() if r["doc_id"] < 50_000})


def test_pipeline_of_nothing(spark, documents):
    kept = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF_DIR)
        assert kept.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns[:3] == ["doc_id", "start", "length"]
    assert language.UNKNOWN == "und" and cgk.repetitions(0.98) >= 8
