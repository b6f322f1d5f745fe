"""Main text of pages: the reader, template deduction against brute force, and whole pages."""

import random
from collections import Counter, defaultdict

import pytest

from seenscope.llm import markup, template

PAGES = "page_id LONG, url STRING, html STRING, host STRING, text STRING, token LONG"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<article>a<b>b</b>c <i>d</i><br>e<p>f<p>g&amp;h&nbsp;i</article>x", "abc d e f g&h i"),
        ("<nav>m</nav><main><p>one</p><aside>s</aside><p>two</main><footer>f</footer>", "one two"),
        ("<article><h1>T</h1><script>var t='</p>';</script><p>x<!-- <p>no --></article>", "T x"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p></article>", "T x"),
        ("<header><h1>Site</h1></header><article>x</article>", "x"),
        ("<article>a<div class='share-box'>s</div><form>q<p>r</form>b</article>", "a b"),
        ("<article>a</article><section id=comments><article>no</article></section>", "a"),
        ("<article class='post comments-open'>a</article><article class='comment'>no</article>", "a"),
        ("<article>a<span class=ad>no<p>b</article>", "a b"),
        ("<div class='has-sidebar'><article>a</article></div><div class=cookieNotice>no</div>", "a"),
        ("<article>a<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "a 1 2 3 4"),
        ("<article></article><div>words that are elsewhere</div>", ""),
        ("<article>1 &lt; 2 <x y='>'>z</x> 3 < 4 <a href=\"", '1 < 2 z 3 < 4 <a href="'),
        ("<html><head><title>t</title><p>a</p>", "a"),
        ("<article>a</p></div></b></article></article>", "a"),
        ("<script>never closed <p>a", ""),
        ("<script src=x /><article>a</article>", "a"),
        ("a<!-- b <p> c", "a"),
        ("<article>a\n\t b\u00a0c\x0bd\r\n</article>", "a b c d"),
        ("<body><div class=menu>m m m m</div><div><p>long text here</p></div></body>", "long text here"),
    ],
)
def test_reader(html, text):
    assert template.main_text(html) == text


def test_reader_on_long_and_deep_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert template.main_text(deep) == "x"
    assert template.main_text("<article>" + "</i></p>" * 50_000 + "a") == "a"
    assert template.main_text("<article>" + "<a " * 50_000) == "<a" + " <a" * 49_999
    assert len(template.main_text("<article>" + "<p>w " * 100_000).split()) == 100_000


def page(rng, kind, n):
    """A page of a host's layout and its main text."""
    words = lambda k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(k))
    paragraphs = [words(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 5))]
    title, menu = words(3), "".join(f"<li><a href=/{i}>{words(1)}</a></li>" for i in range(4))
    body = f"<h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    text = " ".join([title, *paragraphs])
    html = {
        "named": f"<nav><ul>{menu}</ul></nav><article>{body}</article><footer>c {words(5)}</footer>",
        "plain": f"<div class=c1><ul>{menu}</ul></div><div class=c2>{body}</div><div class=c3>All our texts are free</div>",
        "fixed": f"<ul>{menu}</ul><div class=c2>{body}<p>Like what you read? Tell a friend</p></div><div>{words(2)}</div>",
    }[kind]
    return f"<html><head><title>{title}</title></head><body>{html}</body></html>", text


def test_main_text_of_hosts(spark):
    rng = random.Random(2)
    rows, wanted = [], {}
    for h, kind in enumerate(["named", "plain", "fixed"]):
        for n in range(30 if kind != "named" else 90):
            html, text = page(rng, kind, n)
            rows.append((len(rows), f"https://H{h}.example.com/{n}", html, "clash", "clash", 1))
            wanted[len(rows) - 1] = text
    for _ in range(40):  # copies of one page are one page
        rows.append((len(rows), "http://h0.example.com/copy", rows[0][2], None, None, None))
        wanted[len(rows) - 1] = wanted[0]
    rng.shuffle(rows)
    found = template.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()
    assert len(found) == len(rows)
    assert {r["page_id"]: r["text"] for r in found} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_extract_of_odd_tables(spark):
    rows = [
        (None, None, None, None, None, None),
        (1, "http://a/", "<article>x</article>", None, None, None),
        (1, "http://a/", "<article>x</article>", None, None, None),
        (1, "http://a/", "<article>y</article>", None, None, None),
        (2, "no host", "", None, None, None),
        (3, "", "<p>" + "word " * 50_000, None, None, None),
    ]
    found = template.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["page_id"] or 0, r["text"][:9]) for r in found) == [
        (0, ""), (1, "x"), (1, "x"), (1, "y"), (2, ""), (3, "word word")
    ]
    assert template.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_host_of(spark):
    urls = ["HTTP://Www.A.com/x", "a://b?c://d", "x\ny://h#f", "none", None, "é://Ä.de", "://", "a:b://c/d"]
    rows = spark.createDataFrame([(u,) for u in urls], "url STRING")
    found = [r[0] for r in rows.select(template.host_of(rows["url"])).collect()]
    assert found == ["www.a.com", "b", "h", "", "", "Ä.de", "", "c"]


def brute_template(pages):
    """Occurrence vectors written out; classes checked instance by instance."""
    out = {}
    by_host = defaultdict(list)
    for host, number, html in pages:
        by_host[host].append([t for t, _, _ in template._tokens(markup.read(html))])
    for host, read in by_host.items():
        counts = [Counter(p) for p in read]
        vectors = defaultdict(list)
        for t in set().union(*counts):
            n = sum(t in c for c in counts)
            if n >= template.LEAST_PAGES and n >= template.COMMON * len(read):
                vectors[tuple(c[t] for c in counts)].append(t)
        classes = {min(ts): ts for ts in vectors.values() if len(ts) >= template.LEAST_TOKENS}
        of = {t: c for c, ts in classes.items() for t in ts}
        spans = defaultdict(list)  # class -> per instance (page, first, last, order)
        for i, tokens in enumerate(read):
            part = defaultdict(list)
            for at, t in enumerate(tokens):
                if t in of:
                    part[of[t]].append((at, t))
            for c, found in part.items():
                k = len(classes[c])
                for j in range(0, len(found), k):
                    spans[c].append((i, [at for at, _ in found[j : j + k]], tuple(t for _, t in found[j : j + k])))
        for c, found in spans.items():
            places, nested = set(), True
            for i, at, _ in found:
                around = []
                for d, others in spans.items():
                    for i2, at2, _ in others:
                        if i2 == i and d != c:
                            if at2[0] < at[0] < at2[-1]:
                                around.append((at2[0], d, sum(x < at[0] for x in at2)))
                                nested &= at[-1] < at2[-1]
                places.add(max(around)[1:] if around else (0, 0))
            if len({o for *_, o in found}) == 1 and len(places) == 1 and nested:
                out[host, c] = (*places.pop(), frozenset(classes[c]))
    return out


def test_template_against_brute_force(spark):
    rng = random.Random(9)
    pages = []
    for h in ("a", "b", ""):
        for n in range(12):
            rows = "".join(
                f"<tr><td class=k>{rng.choice('xyz')}</td><td class=v>{rng.randrange(50)}<i>u</i></td></tr>"
                for _ in range(rng.randrange(1, 4))
            )
            note = "<ul><li>Fixed note</li><li><div class=q>Second note</div></li></ul>" if n % 2 else ""
            swap = ["<h3>One</h3>", "<h4>Two</h4>", "<h5>Three</h5>"]
            if n % 3 and h != "a":
                swap.reverse()
            pages.append((h, n, f"<body>{note}<div><table>{rows}</table></div>{''.join(swap)}<p>All {n}</p></body>"))
    table = spark.createDataFrame(pages, "host STRING, number LONG, html STRING").repartition(3)
    found = defaultdict(set)
    place = {}
    for r in template.learn_templates(table).collect():
        found[r["host"], r["class"]].add(r["token"])
        place[r["host"], r["class"]] = (r["parent"], r["slot"])
    wanted = brute_template(pages)
    assert {k: (*place[k], frozenset(v)) for k, v in found.items()} == wanted
    assert any(parent for parent, *_ in wanted.values())
