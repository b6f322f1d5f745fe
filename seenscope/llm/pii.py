"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans: emails, IP addresses, card and phone numbers. The random field
then labels every token that holds a digit or an ``@`` (all other tokens are fixed to "none")
and adds spans that the patterns cannot separate or complete. Potentials: the token's shape;
the labels of neighbouring tokens; and skip edges between distant tokens of a document that
are equal, or of equal shape, which pull their labels together. Labels are inferred by loopy
message passing. Skip edges link each token with the next equal one only, so a token that
repeats without end costs one edge per occurrence.

The weights are learned by pseudo-likelihood from the base spans of a bounded sample: at most
``SAMPLE`` documents of at most ``TOKENS`` labelled tokens together. The same weights are then
used for every row. The search itself is a map over the rows: nothing is shuffled and no group
is formed.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.llm.words import pieces, reachable, text_bytes
from seenscope.plans.materialize import materialize

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 16384
TOKENS = 1 << 20  # of the sample
LONGEST = TOKENS // 64  # tokens of one document of the sample
SHAPES = 1 << 12
STEPS = 150
RATE = 0.5
PENALTY = 1e-3
ROUNDS = 10  # of message passing
DAMPING = 0.5
LEAST = 0.5  # an added token needs at least this marginal probability

Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only, so that long runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_PART = re.compile(r"[0-9]+|[^\W\d_]+")
_ACTIVE = np.zeros(256, bool)
_ACTIVE[[*range(ord("0"), ord("9") + 1), ord("@")]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check, by kind and start."""
    found = [(0, *x) for x in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if 16 <= len(m[0]) <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return found


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


@dataclass
class Graph:
    """Active tokens of some texts as nodes, and the edges between them."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shapes: np.ndarray  # node x 2: exact and coarse shape
    edges: np.ndarray  # edge x 3: from, to, type
    label: np.ndarray  # from the base spans, 0: none


NEXT, EQUAL, SIMILAR = 0, 1, 2


def _shapes(token: str) -> tuple[int, int]:
    def exact(m):
        return f"9{len(m[0])}" if m[0][0].isdigit() else "a"

    fine = _PART.sub(exact, token)
    coarse = _PART.sub(lambda m: "9" if m[0][0].isdigit() else "a", token)
    half = SHAPES // 2
    return zlib.crc32(fine.encode()) % half, half + zlib.crc32(coarse.encode()) % half


def graph(texts: list[str], bases: list[list[Span]]) -> Graph:
    doc, start, end, shapes, label, edges = [], [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        kind = {}
        for k, a, b in base:
            for i in range(a, b):
                kind.setdefault(i, k + 1)
        last: dict = {}
        before = None
        for m in _TOKEN.finditer(text):
            node = len(doc)
            token = m[0].strip(".,;:!?\"'")
            shape = _shapes(token)
            beside = before is not None and text[end[before] : m.start()] == " "
            if beside:
                edges.append((before, node, NEXT))
            # The last equal token or else the last of equal shape, if it is a distant one.
            equal, similar = last.get(token), last.get(shape)
            other, kind_of_edge = (similar, SIMILAR) if equal is None else (equal, EQUAL)
            if other is not None and not (beside and other == before):
                edges.append((other, node, kind_of_edge))
            last[shape] = last[token] = node
            inside = [kind.get(i, 0) for i in range(m.start(), m.end()) if text[i].isdigit() or text[i] == "@"]
            doc.append(d)
            start.append(m.start())
            end.append(m.end())
            shapes.append(shape)
            label.append(inside[0] if inside and len(set(inside)) == 1 else 0)
            before = node
    return Graph(
        np.array(doc, int), np.array(start, int), np.array(end, int),
        np.array(shapes, int).reshape(-1, 2), np.array(edges, int).reshape(-1, 3), np.array(label, int),
    )


@dataclass
class Field:
    unary: np.ndarray  # shape x label
    follow: np.ndarray  # label x label, of neighbours
    agree: np.ndarray  # weight of equal labels by edge type (entry 0 is not used)


def _new_field() -> Field:
    n = len(KINDS) + 1
    return Field(np.zeros((SHAPES, n)), np.zeros((n, n)), np.zeros(3))


def learn(shapes: np.ndarray, label: np.ndarray, edges: np.ndarray, steps: int = STEPS) -> Field:
    """Maximise the pseudo-likelihood by Adagrad; all zero if there is no token."""
    field, n = _new_field(), len(KINDS) + 1
    sums = [np.full(x.shape, 1e-8) for x in (field.unary, field.follow, field.agree)]
    one = np.eye(n)[label]
    a, b, kind = edges.T
    near, skip = kind == NEXT, kind != NEXT
    for _ in range(steps if len(label) else 0):
        score = field.unary[shapes[:, 0]] + field.unary[shapes[:, 1]]
        np.add.at(score, b[near], field.follow[label[a[near]]])
        np.add.at(score, a[near], field.follow[:, label[b[near]]].T)
        for x, y in ((a, b), (b, a)):
            np.add.at(score, x[skip], field.agree[kind[skip], None] * one[y[skip]])
        p = np.exp(score - score.max(1, keepdims=True))
        rest = one - p / p.sum(1, keepdims=True)  # gradient by score
        unary, follow, agree = np.zeros_like(field.unary), np.zeros((n, n)), np.zeros(3)
        for column in shapes.T:
            np.add.at(unary, column, rest)
        np.add.at(follow, label[a[near]], rest[b[near]])
        np.add.at(follow.T, label[b[near]], rest[a[near]])
        for x, y in ((a, b), (b, a)):
            np.add.at(agree, kind[skip], rest[x[skip], label[y[skip]]])
        for value, total, gradient in zip((field.unary, field.follow, field.agree), sums, (unary, follow, agree), strict=True):
            step = gradient / len(label) - PENALTY / len(label) * value
            total += step * step
            value += RATE * step / np.sqrt(total)
    field.agree = np.maximum(field.agree, 0)  # consistency may help, never repel
    return field


def marginals(found: Graph, field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every node by damped loopy belief propagation."""
    n = len(KINDS) + 1
    own = field.unary[found.shapes[:, 0]] + field.unary[found.shapes[:, 1]]
    a, b, kind = found.edges.T
    # Every edge in both directions: potentials by (label at source, label at target).
    pair = np.where((kind == NEXT)[:, None, None], field.follow, field.agree[kind][:, None, None] * np.eye(n))
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), n))
    for _ in range(rounds if len(source) else 0):
        belief = own.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    belief = own
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _trim(text: str, kind: int, start: int, end: int) -> list[Span]:
    """The part of a run of tokens that is the entity itself."""
    part = text[start:end]
    inner = [(k, a + start, b + start) for k, a, b in base_spans(part) if k == kind]
    if inner:
        return inner
    bare = part.strip(".,;:!?\"'[]{}<>")
    if not any(c.isdigit() or c == "@" for c in bare):
        return []
    at = start + part.index(bare)
    return [(kind, at, at + len(bare))]


def added_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans that the random field adds; none overlaps a base span."""
    added: list[list[Span]] = [[] for _ in texts]
    found = graph(texts, bases)
    if not len(found.doc):
        return added
    p = marginals(found, field)
    label = np.where(p.max(1) >= LEAST, p.argmax(1), 0)
    label[found.label > 0] = 0  # covered already
    follows = {int(b) for a, b, kind in found.edges if kind == NEXT and label[a] == label[b]}
    nodes = np.flatnonzero(label)
    i = 0
    while i < len(nodes):
        first = last = nodes[i]
        # Phone numbers are made of several tokens, the other kinds of one.
        while i + 1 < len(nodes) and label[first] == 4 and nodes[i + 1] == last + 1 and int(last + 1) in follows:
            i += 1
            last = nodes[i]
        d = found.doc[first]
        for span in _trim(texts[d], int(label[first]) - 1, int(found.start[first]), int(found.end[last])):
            if all(span[2] <= a or b <= span[1] for _, a, b in bases[d] + added[d]):
                added[d].append(span)
        i += 1
    return added


def _active(texts: pa.Array) -> np.ndarray:
    """Rows whose text has a digit or an ``@``; the others have no spans."""
    data, offsets = text_bytes(texts)
    found = [np.zeros(0, np.int64)]
    for first, last in pieces(offsets):
        at = offsets[first : last + 1]
        upto = np.concatenate([[0], np.cumsum(_ACTIVE[data[at[0] : at[-1]]])])
        found.append(first + np.flatnonzero(np.diff(upto[at - at[0]])))
    return np.concatenate(found)


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = TOKENS
) -> Field:
    """Learn the weights from the base spans of at most ``sample`` rows and ``most`` tokens.

    Rows are chosen by a hash of id and text, so null and repeated ids are as good as others,
    while rows equal in both count once. Texts of more than a 64th of ``most`` tokens are used
    for the search only. An empty table gives zero weights, with which nothing is added.
    """
    reachable(docs.sparkSession)
    total = docs.count()
    share = int(min(1.0, sample / max(total, 1)) * (1 << 32))
    longest = max(1, most // 64)

    def tokens(batches):
        for batch in batches:
            rows = _active(batch.column(1))
            texts = batch.column(1).take(pa.array(rows)).to_pylist()
            found = graph(texts, [base_spans(t) for t in texts])
            at = np.searchsorted(found.doc, np.arange(len(texts) + 1))
            of_edge = found.doc[found.edges[:, 0]]
            edge_at = np.searchsorted(of_edge, np.arange(len(texts) + 1))
            out = []
            for d, row in enumerate(rows.tolist()):
                if at[d + 1] - at[d] > longest:
                    continue
                part = slice(at[d], at[d + 1])
                edges = found.edges[edge_at[d] : edge_at[d + 1]] - np.array([at[d], at[d], 0])
                out.append((batch.column(0)[row].as_py(), found.shapes[part].ravel().tolist(), found.label[part].tolist(), edges.ravel().tolist()))
            if out:
                columns = [list(x) for x in zip(*out, strict=True)]
                types = [pa.int64()] + [pa.list_(pa.int32())] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["hash", "shapes", "label", "edges"]
                )

    identity = F.xxhash64(F.col(key).cast("string"), F.col(text))
    chosen = docs.select(identity.alias("hash"), F.col(text).alias("text"))
    chosen = chosen.where((F.pmod("hash", F.lit(1 << 32)) < share) & F.col("text").rlike("[0-9@]"))
    rows = chosen.mapInArrow(tokens, "hash LONG, shapes ARRAY<INT>, label ARRAY<INT>, edges ARRAY<INT>")
    rows = materialize(rows.dropDuplicates(["hash"]), "labelled-tokens")
    # In the order of the hash, as many as the bounds leave room for.
    sizes = rows.select("hash", F.size("label").alias("n")).orderBy("hash").limit(sample).toPandas()
    sizes = sizes[sizes["n"].cumsum() <= most]
    if not len(sizes):
        return _new_field()
    got = rows.where(F.col("hash") <= int(sizes["hash"].iloc[-1])).toPandas().sort_values("hash")
    shapes = np.concatenate([np.array(x, int).reshape(-1, 2) for x in got["shapes"]])
    label = np.concatenate([np.array(x, int) for x in got["label"]])
    first = np.cumsum([len(x) for x in got["label"]]) - [len(x) for x in got["label"]]
    edges = np.concatenate(
        [np.array(x, int).reshape(-1, 3) + np.array([f, f, 0]) for x, f in zip(got["edges"], first, strict=True)]
    )
    return learn(shapes, label, edges)


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``added_spans``: arrays of ``(kind, start, end)``, in
    code points, by kind and start. A null text has none. Columns of these names are replaced."""
    reachable(docs.sparkSession)
    docs = docs.drop("base_spans", "added_spans")
    held = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text)
    empty = F.from_json(F.lit("[]"), "ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>")
    schema = docs.withColumns({"base_spans": empty, "added_spans": empty}).schema
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = _active(batch.column(at))
            texts = batch.column(at).take(pa.array(rows)).to_pylist()
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, held.value)
            columns = []
            for found in (bases, more):
                out = [[] for _ in range(batch.num_rows)]
                for row, spans in zip(rows.tolist(), found, strict=True):
                    out[row] = [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
                columns.append(pa.array(out, span))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts and a digest of its base spans, and all spans as text.

    Every row is judged by its own text, whether its id is null or repeated; a null text has
    no spans. Further columns are ignored; an empty table gives an empty result.
    """
    found = find(docs.select("doc_id", "text"), train(docs))

    def of_kind(spans: str | Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    def text(spans: str | Column) -> Column:
        # Kinds in the order of ``KINDS``, which is not the alphabetical one.
        ordered = F.flatten(F.array(*[of_kind(spans, k) for k in KINDS]))
        return F.array_join(
            F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    every = F.array_sort(F.concat("base_spans", "added_spans"), lambda a, b: a["start"] - b["start"])
    return found.select(
        "doc_id",
        *[F.size(of_kind("base_spans", k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text("base_spans"), 256).alias("base_sha256"),
        text(every).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become
    one. A null text stays null, all rows and their other columns stay as they are, and an empty
    table gives an empty result."""
    spans = F.array_sort(F.concat("base_spans", "added_spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    body, start = F.col(text), F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc, s):
        kept = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    cleaned = F.aggregate(spans, start, put, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    found = find(docs, field, text)
    return found.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(body)).drop("base_spans", "added_spans")
