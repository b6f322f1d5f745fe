"""Main text of web pages, by deducing the template that pages of a host share.

Tokens are start tags and runs of text, each in its place. Tokens that occur equally often on
every page of a host share an occurrence vector and form an equivalence class; vectors are
compared by a fingerprint, so a host with most of the pages is spread over many tasks. A class
is valid if its tokens come in one order on all pages, and if it lies in one and the same slot
of the class around it; valid classes nest into the template. What a page holds beside its
template are the slots.

Of these, the main text is what lies in articles, else in the main element, else in the
container that holds most of the host's text, without menus and the like, which names, classes
and roles of the elements tell, and without runs of text that belong to the template.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.llm import markup
from seenscope.llm.words import reachable
from seenscope.plans.materialize import materialize

# Different pages that a class must occur on, and tokens that it must have.
LEAST_PAGES = 3
LEAST_TOKENS = 3
# Share of a host's pages that a token of the template occurs on.
COMMON = 0.1
# A run of text is part of the template only if it is on so many pages, and such a share.
FIXED_PAGES = 10
FIXED_SHARE = 0.95
# The container of the main text holds at least this share of a host's text outside links.
MAIN_SHARE = 0.6
# Rows held per task before they are handed on.
HELD = 100_000

TOKENS = "host STRING, token LONG, tag BOOLEAN, depth INT, high LONG, low LONG, pages LONG, total LONG, words LONG"
CLASSES = "host STRING, class LONG, form LONG, parent LONG, slot INT, nested BOOLEAN"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z in lower case; empty if
    there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _spread(x: int) -> int:
    """Spreads every bit of a number of 64 bits."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def _tokens(page: markup.Page):
    """``(token, frame, is it a tag)`` in page order; runs of text that never are main text do
    not count."""
    for frame, run, _, _ in page.events:
        if run is None:
            yield frame.path, frame, True
        elif not frame.drop and not run.isspace():
            yield markup.text_hash(frame, run), frame, False


def _learn(batches):
    """Occurrences of tokens, added up within a task as far as memory allows."""
    held: dict[tuple[str, int], list] = {}

    def rows():
        columns = list(zip(*[(h, t, *v) for (h, t), v in held.items()], strict=True)) or [[]] * 9
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["host", "token", "tag", "depth", "high", "low", "pages", "total", "words"],
        )

    for batch in batches:
        hosts, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (host, number) in enumerate(zip(hosts, numbers, strict=True)):
            page = markup.read(batch.column(2)[i].as_py())
            counts: Counter[int] = Counter()
            frames: dict[int, tuple] = {}
            for token, frame, tag in _tokens(page):
                counts[token] += 1
                frames.setdefault(token, (tag, frame.depth))
            words: Counter[int] = Counter()
            for frame in page.containers:
                if not frame.drop:
                    words[frame.path] += frame.words
            own = _spread(number & 0xFFFFFFFFFFFFFFFF)
            frames[0], counts[0] = (True, 0), 1  # the page as a whole
            for token, n in counts.items():
                vector = _spread(own ^ n)
                row = held.get((host, token))
                if row is None:
                    row = held[host, token] = [*frames[token], 0, 0, 0, 0, 0]
                row[2] += vector >> 32
                row[3] += vector & 0xFFFFFFFF
                row[4] += 1
                row[5] += n
                row[6] += words.get(token, 0)
            if len(held) >= HELD:
                yield rows()
                held.clear()
    yield rows()


def occurrences(pages: DataFrame) -> DataFrame:
    """``(host, token, tag, depth, high, low, pages, total, words, host_pages, host_words)`` of
    tokens that occur on enough pages of a host; ``high`` and ``low``, sums of 32-bit hashes of
    page and count, stand for how often a token occurs on each page, ``words`` is the text
    outside links in a container."""
    counted = (
        pages.select("host", "number", "html")
        .mapInArrow(_learn, TOKENS)
        .groupBy("host", "token")
        .agg(
            F.bool_or("tag").alias("tag"),
            F.min("depth").alias("depth"),
            F.sum("high").alias("high"),
            F.sum("low").alias("low"),
            F.sum("pages").alias("pages"),
            F.sum("total").alias("total"),
            F.sum("words").alias("words"),
        )
        .where(F.col("pages") >= LEAST_PAGES)
    )
    counted = materialize(counted, "tokens")
    hosts = counted.where("token = 0").select(
        "host", F.col("pages").alias("host_pages"), F.col("words").alias("host_words")
    )
    return counted.where("token != 0").join(hosts, "host").where(F.col("pages") >= F.col("host_pages") * COMMON)


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """Tokens with their ``class`` (its smallest token) and its ``size``, for classes of enough
    tokens."""
    same = Window.partitionBy("host", "high", "low", "pages", "total")
    return tokens.withColumn("class", F.min("token").over(same)).withColumn(
        "size", F.count("*").over(same)
    ).where(F.col("size") >= LEAST_TOKENS)


def _forms(order: list[tuple[int, int]], sizes: dict[int, int]):
    """``(class, form, parent, slot, nested)`` per instance of a class on a page, from the
    classes and tokens in page order. The form is a hash of the tokens' order."""
    seen: dict[int, list] = {}
    around: list[int] = []
    for name, token in order:
        if name not in seen:
            parent = around[-1] if around else 0
            seen[name] = [0, 0, parent, seen[parent][0] if parent else 0]
            around.append(name)
        state = seen[name]
        state[0] += 1
        state[1] = _spread(state[1] * 31 + (token & 0xFFFFFFFFFFFFFFFF) & 0xFFFFFFFFFFFFFFFF)
        if state[0] == sizes[name]:
            nested = around[-1] == name
            yield name, _signed(state[1]), state[2], state[3], nested
            around.remove(name)
            del seen[name]


def _arrange(batches):
    """What pages say about the form and the place of each class; conflicts within a task are
    settled at once."""
    held: dict[tuple[str, int], tuple] = {}
    last = None
    for batch in batches:
        hosts = batch.column(0).to_pylist()
        for i, host in enumerate(hosts):
            if host != last:
                tokens, classes, sizes = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                of, size, last = dict(zip(tokens, classes, strict=True)), dict(zip(classes, sizes, strict=True)), host
            order = [(of[t], t) for t, _, _ in _tokens(markup.read(batch.column(1)[i].as_py())) if t in of]
            for name, form, parent, slot, nested in _forms(order, size):
                old = held.get((host, name))
                new = (form, parent, slot, nested)
                if old is None:
                    held[host, name] = new
                elif old != new:
                    held[host, name] = (
                        form if form == old[0] else None,
                        *((parent, slot) if (parent, slot) == old[1:3] else (None, None)),
                        nested and old[3],
                    )
    columns = list(zip(*[(h, c, *v) for (h, c), v in held.items()], strict=True)) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["host", "class", "form", "parent", "slot", "nested"],
    )


def valid_classes(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """``(host, class, parent, slot)`` of the classes that are ordered and nested on all pages;
    the parent of an outermost class is 0."""
    listed = classes.groupBy("host").agg(
        F.collect_list("token").alias("tokens"),
        F.collect_list("class").alias("classes"),
        F.collect_list("size").alias("sizes"),
    )
    listed = materialize(listed, "classes")
    found = pages.join(listed, "host").select("host", "html", "tokens", "classes", "sizes").mapInArrow(_arrange, CLASSES)

    def agreed(name: str) -> Column:
        return (F.count(name) == F.count("*")) & (F.min(name) == F.max(name))

    return (
        found.groupBy("host", "class")
        .agg(
            (agreed("form") & agreed("parent") & agreed("slot") & F.bool_and("nested")).alias("valid"),
            F.min("parent").alias("parent"),
            F.min("slot").alias("slot"),
        )
        .where("valid")
        .drop("valid")
    )


def learn_templates(pages: DataFrame) -> DataFrame:
    """``(host, token, tag, depth, class, parent, slot, pages, host_pages, words, host_words)``:
    the template of every host, from ``pages(host, number, html)``.

    ``number`` tells the pages apart. Equal pages should be given once, else their text looks
    like a template.
    """
    classes = materialize(equivalence_classes(occurrences(pages)), "classes")
    valid = valid_classes(pages, classes)
    return classes.join(valid, ["host", "class"]).select(
        "host", "token", "tag", "depth", "class", "parent", "slot", "pages", "host_pages", "words", "host_words"
    )


def _main_container(page: markup.Page, template: int | None) -> int:
    """The path of the container with the main text: that of the host, if the page has it, else
    the innermost one with enough of the page's text."""
    if template is not None and any(f.path == template and not f.drop for f in page.containers):
        return template
    words: Counter[int] = Counter()
    depth: dict[int, int] = {}
    for f in page.containers:
        if not f.drop:
            words[f.path] += f.words
            depth[f.path] = f.depth
    enough = [p for p, n in words.items() if n >= MAIN_SHARE * words[0]]
    return max(enough, key=lambda p: (depth[p], words[p]))


def main_text(html: str | None, fixed: frozenset[int] = frozenset(), container: int | None = None) -> str:
    """The main text of a page; ``fixed`` are runs of text of the template, ``container`` is the
    host's container of main texts."""
    page = markup.read(html)
    if page.has_article:
        wanted = lambda f: f.article
    elif page.has_main:
        wanted = lambda f: f.main
    else:
        path = _main_container(page, container)
        inside: dict[int, bool] = {}
        for f in page.containers:
            inside[id(f)] = f.path == path or (f.outer is not None and inside[id(f.outer)])
        wanted = lambda f: inside[id(f.container)]
    runs = [
        (run, block)
        for frame, run, block, _ in page.events
        if run is not None and not frame.drop and wanted(frame) and not (fixed and markup.text_hash(frame, run) in fixed)
    ]
    return markup.blocks(runs)


def _extract(batches, columns: list[str]):
    known: dict[str, frozenset[int]] = {}
    for batch in batches:
        texts = []
        containers = batch.column("_container").to_pylist()
        for i, (host, container) in enumerate(zip(batch.column("host").to_pylist(), containers, strict=True)):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = frozenset(batch.column("_fixed")[i].as_py() or ())
            texts.append(main_text(batch.column("_html")[i].as_py(), known[host], container))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in columns], pa.array(texts, pa.string())], [*columns, "text"]
        )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row: the main text of each page.

    A null or empty page has an empty text, a null or strange url is a host of its own, and
    rows that repeat an id are pages of their own. An empty table gives an empty result;
    further columns are ignored. Pages of a host with few pages go by their own structure.
    """
    reachable(pages.sparkSession)
    read = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    named = read.withColumn("host", host_of(F.col("url")))
    different = named.select(
        "host", F.xxhash64("page_id", "url", "_html").alias("number"), F.md5(F.coalesce("_html", F.lit(""))).alias("same")
    )
    # Of equal pages of a host one counts.
    copies = different.groupBy("host", "same").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(copies.drop("n"), "equal-pages")
    numbered = named.select(
        "host",
        F.xxhash64("page_id", "url", "_html").alias("number"),
        F.md5(F.coalesce("_html", F.lit(""))).alias("same"),
        F.col("_html").alias("html"),
    )
    once = numbered.join(copies, ["host", "same"], "left").where("first IS NULL OR number = first")
    template = materialize(learn_templates(once.select("host", "number", "html")), "template")
    fixed = ~F.col("tag") & (F.col("pages") >= FIXED_PAGES) & (F.col("pages") >= F.col("host_pages") * FIXED_SHARE)
    enough = F.col("tag") & (F.col("words") >= F.col("host_words") * MAIN_SHARE) & (F.col("host_words") > 0)
    hosts = template.groupBy("host").agg(
        F.collect_list(F.when(fixed, F.col("token"))).alias("_fixed"),
        F.max_by("token", F.when(enough, F.struct("depth", "words", "token"))).alias("_container"),
    )
    hosts = materialize(hosts, "host-templates")
    joined = named.join(hosts, "host", "left").select("page_id", "url", "host", "_html", "_fixed", "_container")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in ("page_id", "url"))
    found = joined.mapInArrow(lambda b: _extract(b, ["page_id", "url"]), f"{kinds}, text STRING")
    return found.withColumn("n_chars", F.length("text").cast("long"))
