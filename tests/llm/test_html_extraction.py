"""Extraction by deduced templates: known articles, odd markup, and the deduction's own rules."""

import html as entities
import random
import re

import pytest
from llm_helpers import SF, needs_data

import panelyard.llm.html_extraction as extraction
from panelyard.llm.html_extraction import Paths, deduce_templates, extract_text, op11_html_extraction, orders_and_crossings, parse

KIND = "page_id long, url string, html string"


def got(df):
    return {r.page_id: r.text for r in df.collect()}


@needs_data
def test_query_gives_the_articles(spark):
    """In the given pages the article is one element without anything foreign inside."""
    made = got(op11_html_extraction(spark, SF))
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(made) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        assert made[r.page_id] == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", article)).split())
    checked = op11_html_extraction(spark, SF).filter("n_chars <> char_length(text)")
    assert checked.count() == 0


def one(spark, page):
    return extract_text(spark.createDataFrame([(1, "http://a.b/c", page)], KIND)).first().text


CASES = [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b> c<p>d", "ab c d"), ("<p>one<br>two<hr>three", "one two three"),
    ("<article>kept<!-- not > kept --> too<script>if (a</b) '<p>no</p>'</script> end", "kept too end"),
    ("<article>x &lt;y&gt; &eacute;&#233;&#xE9; &nbsp; z 1 < 2</article>", "x <y> ééé z 1 < 2"),
    ("<head><title>T</title><body><p>b</p>", "b"), ("<article><p>a</p><!-- open <p>b</p>", "a"),
    ("<article>a<script>b", "a"), ("<div class='ad'>buy</div><div>text</div>", "text"),
    ("<article>t<aside>no</aside><div class=\"comments\"><p>no</p></div>u</article>", "t u"),
    ("<main><h1>H</h1><form><p>no</p><input value='>'></form><p>yes</p></main><p>no</p>", "H yes"),
    ("<nav>n</nav><header>h</header><p>text <span class=\"advert\">no</span> more</p><footer>f</footer>", "text more"),
    ("<article><header><h1>Head</h1></header><p>x</p><footer>no</footer></article>", "Head x"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a b 1 2 3"),
    ("<div id='cookie-notice'>no</div><div class='post-content'><p>yes</p></div><div>else</div>", "yes"),
    ("<div class=\"with-sidebar\"><p>yes</p></div><div class=\"sidebar\">no</div>", "yes"),
    ("<article><p>x</p></div></p></span>y<a href='/?class=ad'>z</a></article>", "x yz"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p class='notice'>no</p>ok</article>", "ok"),
    ("<article>a<noscript>no</noscript><button>no</button><svg><text>no</text></svg>b</article>", "a b"),
    ("<ul><li><a href=x>menu one</a><li><a href=y>two</a></ul><p>text of the page</p>", "text of the page"),
    ("<ARTICLE>Up<P CLASS=AD>no</P></ARTICLE >", "Up"), ("<article>a\x00b <p", "a\x00b"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_single_pages(page, text):
    run = extraction.text_kernel(False)()
    assert run([page], [None], [None], [None], [None]) == [[text], [len(text)]]


def layout(draw, i, kind):
    """A page whose markup names nothing; only other pages of the host tell what is template."""
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    body = [words(draw.randrange(30, 80)) for _ in range(draw.randrange(2, 5))]
    title = words(5)
    if kind == "plain":   # constant short texts around the article and inside it
        page = (
            f"<html><body><div class=\"x1\"><span>Home Contact Imprint</span></div><div class=\"x2\"><h1>{title}</h1>"
            + "".join(f"<p>{b}</p>" for b in body) + f"<p>Read this again tomorrow</p></div><div class=\"x3\">Made by us {words(2)}</div></body></html>"
        )
    else:
        page = f"<html><body><article><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body) + "<p>Tell your friends</p></article><div>Seen today</div></body></html>"
    return page, " ".join([title, *body])


def test_templates_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(extraction, "TASK_TOKENS", 500)
    draw, rows, want = random.Random(5), [], {}
    for i in range(120):
        host, kind = (("http://one.x/", "plain"), ("https://two.y/p", "article"))[i % 2]
        page, want[i] = layout(draw, i, kind)
        rows.append((i, f"{host}{i}", page))
    # Copies of one page at a host of their own: nothing tells template and article apart.
    rows += [(200 + i, "http://copies.z/", rows[0][2]) for i in range(40)]
    rows += [(300, None, rows[0][2]), (301, "http://one.x/", None), (302, "http://one.x/", ""), (303, "", "<p>x</p>")]
    df = spark.createDataFrame(rows, KIND).repartition(5).selectExpr("*", "1 as text", "2 as host", "3 as of", "'x' as slots")
    made = got(extract_text(df))
    assert {i: made[i] for i in want} == want
    assert made[301] == "" and made[302] == "" and made[303] == "x"
    assert "Read this again tomorrow" in made[200] and made[200] == made[239]
    slots = extract_text(df, with_slots=True).filter("page_id = 0").first().slots
    assert " ".join(s.text for s in slots if s.article) == want[0] and any(not s.article for s in slots)
    assert extract_text(df.limit(0)).count() == 0


def test_occurrence_vectors_make_the_classes(spark, monkeypatch):
    """Classes by sums of hashes are those of the vectors themselves."""
    monkeypatch.setattr(extraction, "WORD_PAGES", 3)
    draw = random.Random(8)
    pages = [layout(draw, i, "plain")[0] + ("<div class=\"q\">More or less</div>" if i % 3 == 0 else "") for i in range(20)]
    df = spark.createDataFrame([(1, p) for p in pages], "host long, html string").repartition(4)
    row = deduce_templates(df).first()
    import numpy as np

    tokens = set(np.frombuffer(row.tokens, dtype=np.int64).tolist())
    paths, vectors = Paths(), {}
    for i, page in enumerate(pages):
        for item in parse(page, paths):
            own = [item[1]] if item[0] == 0 else extraction.word_tokens(*item[1:2], *item[3:]) if len(item[1]) <= extraction.RUN_WORDS else []
            for token in own:
                vectors.setdefault(extraction.signed(token), [0] * 20)[i] += 1
    constant = {t for t, v in vectors.items() if v == [1] * 20}
    third = {t for t, v in vectors.items() if v == [int(i % 3 == 0) for i in range(20)]}
    assert constant <= tokens and third <= tokens and len(third) == 5
    assert not tokens & {t for t, v in vectors.items() if sum(v) == 1}


def test_orders_and_crossings():
    orders, crossings = orders_and_crossings([(1, 10), (2, 20), (3, 20), (2, 20), (3, 20), (4, 10)])
    assert all(orders.values()) and not crossings
    orders, crossings = orders_and_crossings([(1, 10), (2, 20), (4, 10), (3, 20)])
    assert crossings == {(10, 20), (20, 10)}
    assert orders_and_crossings([(1, 10), (2, 10), (2, 10), (1, 10)])[0][10] == 0


def test_long_and_hostile_pages():
    run = extraction.text_kernel(False)()
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    many = "<article>" + "<p>w</p>" * 50_000
    quotes = "<a '" * 20_000 + "<b \"" * 20_000
    texts = run([deep, many, quotes, "<" * 100_000, "<!--" * 50_000], *[[None] * 5] * 4)[0]
    assert texts[0] == "x" and texts[1] == " ".join("w" * 50_000)


NOTICE = " ".join(f"the of n{i % 9} and m{i}" for i in range(12))                     # 48 words, most of them the articles' too
PROMO = "if you like what you read here then tell all of your friends about the site and come back to it"
POSTED = "posted on the site of our paper at {} by {} and filed under the heading of the day"


def long_layout(draw, i, kind):
    """Constant texts longer than a short run, of words that the articles hold too."""
    common = "the of and if you like site paper on to it all n1 n2 m3 m4".split()
    words = lambda n: " ".join(draw.choice(common) if draw.random() < 0.5 else f"w{draw.randrange(10**6)}" for _ in range(n))
    body = [words(draw.randrange(30, 80)) for _ in range(draw.randrange(4, 7))]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    if kind == "article":
        return f"<html><body><article><p>{PROMO}</p>{paragraphs}<p>{NOTICE}</p></article></body></html>", " ".join(body)
    line = POSTED.format(f"t{i}", f"a{i}")
    page = f"<html><body><div class=\"x1\"><p>{NOTICE}</p></div><div class=\"x2\">{paragraphs}<p>{PROMO}</p><p>{line}</p></div></body></html>"
    return page, " ".join([*body, f"t{i} by a{i}"])


def test_template_text_in_long_runs(spark):
    draw, rows, want = random.Random(3), [], {}
    for i in range(80):
        host, kind = (("http://one.x/", "plain"), ("https://two.y/p", "article"))[i % 2]
        page, want[i] = long_layout(draw, i, kind)
        rows.append((i, f"{host}{i}", page))
    # Too few pages to tell: nothing is dropped.
    few = [long_layout(draw, i, "article")[0] for i in range(10)]
    rows += [(100 + i, f"http://few.z/{i}", page) for i, page in enumerate(few)]
    made = got(extract_text(spark.createDataFrame(rows, KIND).repartition(7)))
    assert {i: made[i] for i in want} == want
    assert all(made[100 + i].startswith(PROMO) and made[100 + i].endswith(NOTICE) for i in range(10))


def test_near_copies_of_an_article_are_no_template(spark):
    """Not where a host has nothing else, nor where a container of their own tells them apart."""
    draw = random.Random(4)
    body = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    copies = [f"<html><body><article id=\"same\"><p>{'</p><p>'.join([*body, f'copy {i} ' + 'x ' * 15])}</p></article></body></html>" for i in range(20)]
    rows = [(i, f"http://copies.z/{i}", page) for i, page in enumerate(copies)]
    rows += [(100 + i, f"http://one.x/c{i}", page) for i, page in enumerate(copies)]
    rows += [(200 + i, f"http://one.x/{i}", long_layout(draw, i, "article")[0]) for i in range(30)]
    made = got(extract_text(spark.createDataFrame(rows, KIND).repartition(4)))
    for i in range(20):
        assert made[i] == made[100 + i] == " ".join([*body, f"copy {i}", *["x"] * 15])
    assert not any(PROMO in made[200 + i] or NOTICE in made[200 + i] for i in range(30))


def test_stretch_elsewhere_too_is_no_template(spark):
    """Its class's pages hold it, but not once a round, or not at one place, or other pages have it too."""
    line = "this line of some length stands now here and now there but always once on a page"
    body = lambda i: " ".join(f"b{i}.{j}" for j in range(30))
    spot = lambda i, own: f"<div>a{i}</div>{own if i % 2 else ''}<ul class=\"u\"></ul>{'' if i % 2 else own}"
    rows = [(i, f"http://one.x/{i}", f"<html><body><p>{body(i)}</p>{spot(i, f'<p>{line}</p>')}</body></html>") for i in range(40)]
    rows += [(100 + i, f"http://two.x/{i}", f"<html><body><p>{body(i)}</p>{'<ul></ul>' if i < 20 else ''}<p>{line}</p></body></html>") for i in range(40)]
    rows += [(200 + i, f"http://three.x/{i}", f"<html><body><p>{body(i)}</p><p>{line}</p>{f'<p>{line}</p>' * (i % 2)}</body></html>") for i in range(40)]
    made = got(extract_text(spark.createDataFrame(rows, KIND).repartition(3)))
    assert all(line in made[i] and line in made[200 + i] for i in range(40))
    assert all(made[100 + i] == body(i) for i in range(40))   # once on every page, after the body's tag


def test_stretches_are_the_windows_of_all_runs():
    page = parse("<div><p>a b c d</p>x<p>a b c d</p></div><p>a b c d</p><p>b a c d</p><br>a b c", Paths())
    runs = [(p, item) for p in (0, 1) for item in page if item[0] == 1]
    token, at, place = extraction.stretches([(item[1], extraction.container_seed(item)) for _, item in runs])
    want = {}
    for r, (_, (_, words, _, node, leaf)) in enumerate(runs):
        padded = ["", *words, ""]
        want.update({(r, j): (node.key, leaf, *padded[j:j + 3]) for j in range(len(words))})
        want[r, -1] = (node.key, leaf, "all", *words)
    made = dict(zip(zip(at.tolist(), place.tolist()), token.tolist()))
    assert made.keys() == want.keys() and len(token) == len(made)
    pairs = {(made[k], want[k]) for k in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert [len(x) for x in extraction.stretches([])] == [0] * 3
    wanted = token[place >= 0][::3]
    found = extraction.known_stretches([page, page, page], [wanted, None, wanted[:0]])
    assert {t for *_, t in found[0]} == set(wanted.tolist()) and found[1:] == [[], []]
    odd = ["a", "ab", "ba", "\U0001f600", "\uf600", "\ud83d", "b" * 300, "b" * 301, "a\x00"]
    assert len(set(extraction.word_hashes(odd).tolist())) == len(odd)
    assert extraction.word_hashes(odd * 2).tolist() == [h for w in odd * 2 for h in extraction.word_hashes([w]).tolist()]


def test_tasks_hand_on_every_stretch_with_a_tags_vector(monkeypatch):
    """However a task's pages are cut: sums of kept stretches are those of all of them."""
    import pyarrow as pa

    draw = random.Random(6)
    pages = [long_layout(draw, i, "plain")[0] for i in range(30)]
    batches = lambda n: [pa.RecordBatch.from_pydict({"host": [7] * len(c), "html": c, "words": [True] * len(c)}) for c in (pages[i:i + n] for i in range(0, 30, n))]

    def sums(batches):
        total = {}
        for batch in extraction.vector_task(iter(batches)):
            for host, kind, token, *values in zip(*(c.to_pylist() for c in batch.columns)):
                total[host, kind, token] = [a + b for a, b in zip(total.get((host, kind, token), [0] * 3), values)]
        tags = {tuple(v) for (_, kind, _), v in total.items() if kind == 1}
        return {k: v for k, v in total.items() if k[1] < 2 or tuple(v) in tags and v[0] >= extraction.WORD_PAGES}

    whole = sums(batches(30))
    assert sum(k[1] == 2 for k in whole) > 60
    monkeypatch.setattr(extraction, "TASK_STRETCHES", 100)
    assert sums(batches(5)) == sums(batches(1)) == whole
