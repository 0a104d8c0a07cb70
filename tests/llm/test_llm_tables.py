"""URL filter, HTML extraction, sharding, chat formatting, n-gram join and archives."""

import base64
import gzip
import hashlib
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, html_extract, ngram_join, sharding, url_filter, warc

PAGES = "page_id long, url string, html string"


# --- urls --------------------------------------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    urls = ["https://A.Example.ORG/es/1?q", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/2#a", "https://x.com/de/", "http://com/de/x", "ftp://h?x://y/z", "no scheme", None, "http://", "http://example.orgx/en/1"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r["host"] for r in got] == ["a.example.org", "example.org", "notexample.org", "x.com", "x.com", "com", "h", "", "", "", "example.orgx"]
    assert [r["path"] for r in got] == ["/es/1", "/en/12", "/es/", "/fr/2", "/de/", "/de/x", "", "", "", "", "/en/1"]
    assert [r["rule"] for r in got] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "com/de/", None, None, None, None, None]
    assert [r["verdict"] for r in got][:6] == ["block", "block", "allow", "allow", "block", "block"]


def test_templates_reject_by_labels(spark):
    bad = [(f"http://a.net/buy/{k}", 0) for k in range(30)]
    good = [(f"http://a.net/news/{k}", 1) for k in range(30)]
    labels = spark.createDataFrame(bad + good, "url string, good int")
    pages = spark.createDataFrame([(1, "http://a.net/buy/999"), (2, "http://a.net/news/999"), (3, "http://b.net/buy/1"), (4, "http://c.net/other")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules=(), labels=labels).collect()}
    assert [got[k]["verdict"] for k in (1, 2, 3, 4)] == ["block", "allow", "block", "allow"]
    assert got[1]["template"] == "/buy/*"


def test_variable_segments_and_alike_siblings(spark):
    labels = spark.createDataFrame([(f"http://a.net/{name}/x", good) for names, good in ((["p", "q"], 0), (["r"], 1)) for name in names for _ in range(20)] + [(f"http://b.net/user{chr(97 + k % 26)}{chr(97 + k // 26)}/x", 1) for k in range(60)], "url string, good int")
    pages = labels.select(F.monotonically_increasing_id().alias("page_id"), "url")
    got = {r["url"]: r["template"] for r in url_filter.judge(pages, rules=(), labels=labels).join(pages, "page_id").collect()}
    assert got["http://a.net/p/x"] == got["http://a.net/q/x"] != got["http://a.net/r/x"]
    assert got["http://b.net/useraa/x"] == "/*/x"


def test_labels_of_merged_branches_judge_other_hosts(spark):
    labels = spark.createDataFrame([(f"http://a.net/{name}/x", 1) for name in "pq" for _ in range(20)] + [("http://b.net/p/x", 0)] * 12, "url string, good int")
    pages = spark.createDataFrame([(1, "http://a.net/p/x"), (2, "http://b.net/p/x"), (3, "http://c.net/p/x")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules=(), labels=labels).collect()}
    assert [got[k]["verdict"] for k in (1, 2, 3)] == ["allow", "block", "allow"] and got[1]["template"] != got[3]["template"] == "/p/x"
    whole = 41 / 54
    assert got[3]["purity"] == pytest.approx((20 + 5 * whole) / (32 + 5))  # all 32 labels of /p/x, smoothed by the whole
    assert got[1]["purity"] == pytest.approx((40 + 5 * (40 + 5 * whole) / (52 + 5)) / (40 + 5))


def test_siblings_merge_by_gap_and_counts(spark):
    labels = {"e": (1000, 899), "f": (1000, 901), "g": (5, 5), "h": (500, 500), "i": (1000, 700), "j": (8, 3), "k": (1000, 40)}
    rows = [(f"http://a.net/{host}/{name}/x", int(k < good)) for host, names in (("m", "ef"), ("n", "gh"), ("o", "ijk")) for name in names for n, good in [labels[name]] for k in range(n)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(sorted({u for u, _ in rows}))], "page_id long, url string")
    got = {r["path"].split("/")[2]: r["template"] for r in url_filter.judge(pages, rules=(), labels=spark.createDataFrame(rows, "url string, good int")).collect()}
    assert got["e"] == got["f"] and got["g"] == got["h"] and got["i"] == got["j"] != got["k"]


def plain_judge(urls, labels, s):
    """{url: (template, purity)} by dicts and lists: one trie of all labels and urls, grown, merged and smoothed by the book."""
    import math
    import re

    def shape(url):
        host, _, path = url.partition("://")[2].partition("/")
        parts = [x for x in re.sub(r"\.[A-Za-z0-9]{1,5}$", "", "/" + path).split("/") if x]
        return host, tuple("*" if re.search("[0-9]", x) else x for x in parts)

    told = defaultdict(list)
    for url, good in labels:
        told[shape(url)].append(good)
    shapes = {shape(u) for u in urls} | set(told)
    template = dict.fromkeys(shapes, "")
    for depth in range(max(len(x) for _, x in shapes)):
        kinds = defaultdict(set)
        for (host, x), t in template.items():
            if len(x) > depth and x[depth] != "*":
                kinds[host, t].add(x[depth])
        template = {(host, x): t if len(x) <= depth else f"{t}/" + ("*" if len(kinds[host, t]) >= s.variable_kinds else x[depth]) for (host, x), t in template.items()}
    nodes = defaultdict(lambda: [0, 0])
    for key, t in template.items():
        nodes[key[0], t][0] += len(told[key])
        nodes[key[0], t][1] += sum(told[key])
    merged = {key: key[1].split("/") for key in nodes}
    for place in reversed(range(1, 1 + max(len(x) for _, x in shapes))):
        siblings = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for key, parts in merged.items():
            if len(parts) > place and parts[place] != "*":
                own = siblings[key[0], tuple(parts[:place]), tuple(parts[place + 1 :])][parts[place]]
                own[0] += nodes[key][0]
                own[1] += nodes[key][1]
        for (host, before, after), found in siblings.items():
            classes = []
            for _, n, g, x in sorted((g / n, n, g, x) for x, (n, g) in found.items() if n >= s.prior):
                if classes:
                    last = classes[-1]
                    both, apart = (last[1] + g) / (last[0] + n), g / n - last[1] / last[0]
                    if apart < s.merge_gap or apart < s.merge_z * math.sqrt(both * (1 - both) * (1 / last[0] + 1 / n)):
                        classes[-1] = [last[0] + n, last[1] + g, [*last[2], x]]
                        continue
                classes.append([n, g, [x]])
            for n, g, names in classes:
                for key, parts in merged.items() if len(names) > 1 else ():
                    if key[0] == host and tuple(parts[:place]) == before and tuple(parts[place + 1 :]) == after and len(parts) > place and parts[place] in names:
                        merged[key] = [*before, f"{{{math.floor(g / n / s.merge_gap)}}}", *after]
    everything = [g for own in told.values() for g in own]
    pool = defaultdict(lambda: [0, 0])
    for (_, t), (n, g) in nodes.items():
        pool[t][0] += n
        pool[t][1] += g
    total = defaultdict(lambda: [0, 0, 0, 0])
    for key, (n, g) in nodes.items():
        own = total[key[0], "/".join(merged[key])]
        for k, v in enumerate((n, g, *pool[key[1]])):
            own[k] += v
    out = {}
    for u in urls:
        key = shape(u)
        name = "/".join(merged[key[0], template[key]])
        n, g, all_n, all_g = total[key[0], name]
        wide = (all_g + s.prior * (sum(everything) + 1) / (len(everything) + 2)) / (all_n + s.prior)
        out[u] = (name, (g + s.prior * wide) / (n + s.prior))
    return out


def test_template_tree_equals_brute_force(spark):
    rng = random.Random(12)
    s = url_filter.Settings(variable_kinds=6)
    chance = {"news": 0.9, "blog": 0.85, "shop": 0.1, "tag": 0.15, "wiki": 0.5}

    def url():
        first = rng.choice(list(chance))
        rest = [rng.choice(list("abcdefgh") if first == "tag" else ["a", "b", "c1", "d", str(rng.randint(0, 99))]) for _ in range(rng.randint(0, 5))]
        return f"http://{rng.choice(['h.net', 'h.net', 'i.org', 'j.com'])}/" + "/".join([first, *rest]) + rng.choice(["", "", "/", ".html"]), int(rng.random() < chance[first])

    labels, urls = [url() for _ in range(600)], sorted({url()[0] for _ in range(200)} | {"http://new.net/", "http://h.net"})
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, rules=(), labels=spark.createDataFrame(labels, "url string, good int"), settings=s).collect()
    expected = plain_judge(urls, labels, s)
    assert len(got) == len(urls) and len({t for t, _ in expected.values()}) > 15 and any("{" in t for t, _ in expected.values()) and any("/*" in t for t, _ in expected.values())
    for r in got:
        template, purity = expected[urls[r["page_id"]]]
        assert (r["template"], r["purity"]) == (template, pytest.approx(purity)), urls[r["page_id"]]
        assert r["verdict"] == ("block" if purity < s.reject else "allow")


def test_long_paths_keep_their_segments(spark):
    head = "http://h.net/" + "/".join("abcdefg")
    urls = [f"{head}/h/i/j", f"{head}/x/y/z", f"{head}/h/i/" + "q/" * 300 + "r", f"{head}/h/i/" + "q/" * 300 + "s"]
    told = [(u, k % 2) for k, u in enumerate(urls) for _ in range(60)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=(), labels=spark.createDataFrame(told, "url string, good int")).collect()
    assert len({r["template"] for r in got}) == 4 and [r["verdict"] for r in sorted(got)] == ["block", "allow"] * 2


def test_tree_grows_on_one_scan(spark):
    pages = spark.createDataFrame([(k, f"http://h.net/{'abc'[k % 3]}/x/y/z/{k}") for k in range(30)], "page_id long, url string")
    plan = url_filter.judge(pages, rules=())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("ExternalRDD") <= 1  # the urls; the tree is read from its table


def test_url_odd_rows(spark):
    rows = [(None, "http://a/b", "x"), (1, None, None), (1, None, None), (2, "http://h/" + "a/" * 5000, "x"), (3, "http://h/%", None)]
    df = spark.createDataFrame(rows, PAGES)
    for c in ("host", "path", "good", "n", "template", "hit"):
        df = df.withColumn(c, F.lit("x"))
    assert len(url_filter.judge(df).collect()) == 5
    assert url_filter.judge(spark.createDataFrame([], PAGES)).collect() == []


# --- html --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad 1 -->
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy.</div>%s<aside>Side</aside><form><p>Mail?</p><button>Go</button></form><div id="comments"><p>Nice article, thanks!</p></div><footer>&copy; x &middot; y</footer>%s"""


@pytest.mark.parametrize("body, expected", [
    ("<article><h1>Head</h1><p><b>One  two\n three.<br><p>Four &amp; five&amp;&amp;.</p><p>Six</p></article>", "Head\nOne two three.\nFour & five&&.\nSix"),
    ("<main><h1>Head</h1><ul><li>a<li>b</ul><blockquote>Q</blockquote></main>", "Head\na\nb\nQ"),
    ("<div class='content'><h2>Head</h2><p>A long sentence, with commas, and with words.</p><p>Another long sentence; it has more, and more.</p><p>Short</p></div>", "Head\nA long sentence, with commas, and with words.\nAnother long sentence; it has more, and more.\nShort"),
    ("<article><header><h1>Head</h1></header><p>Text &#233;&eacute; &lt;b&gt;.</p><div class='share'>Tweet</div></article>", "Head\nText éé <b>."),
])
@pytest.mark.parametrize("end", ["</body></html>", ""])
def test_article(body, expected, end):
    assert html_extract.main_text(PAGE % (body, end)) == expected


def test_whole_article_of_many_short_paragraphs():
    parts = [f"Line {k}" for k in range(3000)]
    assert html_extract.main_text(PAGE % ("<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>", "")) == "\n".join(parts)


SENTENCES = ["The first paragraph, which is long, says a lot; it has commas, and a stop.", "The second paragraph, as long as that, goes on; it has commas too, and a stop.", "The third paragraph, no shorter, comes to an end; it has commas, and a stop."]
TEXT = "".join(f"<p>{x}</p>" for x in SENTENCES)


@pytest.mark.parametrize("body, expected", [
    (f"<div class='content'><h2>Head</h2>{TEXT}</div><div class='list'><article><p>A teaser.</p></article></div>", ["Head", *SENTENCES]),
    ("<div class='list'>" + "".join(f"<article><h2>Part</h2><p>{x}</p></article>" for x in SENTENCES) + "</div>", [y for x in SENTENCES for y in ("Part", x)]),
    (f"<main><h1>Head</h1><div><p>Short</p>{TEXT}</div></main>", ["Head", "Short", *SENTENCES]),
])
def test_paths_choose_the_content_element(body, expected):
    assert html_extract.main_text(PAGE % (body, "")) == "\n".join(expected)


@pytest.mark.parametrize("body, expected", [
    (f"<article><h1>Head</h1>{TEXT}<section id='related-work'><h2 id='comment-on-x'>Work</h2><p>{SENTENCES[0]}</p></section></article>", ["Head", *SENTENCES, "Work", SENTENCES[0]]),
    (f"<article class='post category-social has-comments'><h1>Head</h1>{TEXT}</article>", ["Head", *SENTENCES]),
    (f"<div class='has-sidebar'><article><h1>Head</h1>{TEXT}</article></div>", ["Head", *SENTENCES]),
    (f"<form id='aspnet'><div class='page'><h1>Head</h1>{TEXT}</div></form>", ["Head", *SENTENCES]),
    (f"<article><div class='social'>{TEXT}<p>So <math><mi>x</mi></math> and <label>this</label>.</p></div><div class='share'>Tweet</div></article>", [*SENTENCES, "So x and this."]),
])
def test_marked_subtrees_with_the_text_stay(body, expected):
    assert html_extract.main_text(PAGE % (body, "")) == "\n".join(expected)


@pytest.mark.parametrize("body, expected", [
    (f"<article><h1>One</h1>{TEXT}</article><article><h1>Two</h1>{TEXT}</article>", ["One", *SENTENCES, "Two", *SENTENCES]),
    (f"<article><h1>Head</h1>{TEXT}<div class='notice-period'><p>Two months.</p></div><section id='social-history'><p>Short.</p></section></article>", ["Head", *SENTENCES, "Two months.", "Short."]),
    (f"<article><h1>Head</h1>{TEXT}<div class='notice'><p>Closed today.</p></div><section class='post-comments'><p>{SENTENCES[0]}</p></section></article>", ["Head", *SENTENCES]),
    (f"<h1>Head</h1>{TEXT}<ul><li>a</li></ul><div>Home</div>", ["Head", *SENTENCES, "a"]),
    ("<p>" + "</p><p>".join(SENTENCES) + "</p><article><h2>Card</h2></article>", SENTENCES),
])
def test_paths_select_whole_articles(body, expected):
    assert html_extract.main_text(PAGE % (body, "")) == "\n".join(expected)


def plain_text_of(page, s):
    """main_text() restated on closed markup: strings for paths, a list of ancestors for every block, every sum anew."""
    import html.parser
    import math

    class Reader(html.parser.HTMLParser):
        open, blocks, count = [("", "", 0)], [], 0

        def handle_starttag(self, tag, attrs):
            self.count += 1
            words = dict(attrs).get("class") or ""
            mark = 2 if tag in ("nav", "footer", "aside") else int(tag == "header" and not any(t == "article" for t, _, _ in self.open) or words in ("ad", "side-bar sidebar", "comments"))
            self.open = [*self.open, (tag, f"{tag} {words} {mark}", self.count)]

        def handle_endtag(self, tag):
            self.open = self.open[:-1]

        def handle_data(self, data):
            if data.strip():
                self.blocks = [*self.blocks, (self.open, " ".join(data.split()))]

    reader = Reader()
    reader.feed(page)
    rows = [{"up": up, "path": "/".join(x for _, x, _ in up), "text": text, "ids": [i for _, _, i in up]} for up, text in reader.blocks]
    if all(any(x.endswith(" 2") for _, x, _ in r["up"]) for r in rows):
        return ""
    for r in rows:
        same = [q["text"] for q in rows if q["path"] == r["path"]]
        r["t"], r["p"] = sum(map(len, same)) / len(same), sum(sum(c in ".,;:!?" for c in x) for x in same) / len(same)

    def near(k, name):
        around = [(q[name], math.exp(-((k - j) ** 2) / (2 * s.width**2))) for j, q in enumerate(rows) if abs(k - j) <= math.ceil(3 * s.width)]
        return sum(x * w for x, w in around) / sum(w for _, w in around)

    for k, r in enumerate(rows):
        r["plain"] = near(k, "t") * (near(k, "p") + 1)
        r["marks"] = {i for _, x, i in r["up"] if x and x[-1] in "12"}
        r["inside"] = any(t == "article" for t, _, _ in r["up"])

    def factor(r):
        return (s.bonus if r["inside"] else 1) * (s.doubt if r["marks"] - lifted else 1)

    lifted = set()
    whole = sum(r["plain"] * factor(r) * len(r["text"]) for r in rows)
    lifted = {i for r in rows for _, x, i in r["up"] if x.endswith(" 1") and sum(q["plain"] * factor(q) * len(q["text"]) for q in rows if i in q["ids"]) >= s.most * whole}
    for r in rows:
        own = [q["plain"] * factor(q) for q in rows if q["path"] == r["path"]]
        r["score"] = sum(own) / len(own)
    mean = sum(r["plain"] for r in rows) / len(rows)
    deviation = math.sqrt(sum((r["plain"] - mean) ** 2 for r in rows) / len(rows))
    best_score = max(r["score"] for r in rows)
    cut = min(best_score, max(s.cut * deviation, s.faint * best_score))
    for r in rows:
        r["on"] = r["score"] >= cut
    groups = ("article", "body", "div", "html", "section", "", "nav", "footer", "aside", "header")
    selected = {i: sum(len(q["text"]) for q in rows if q["on"] and i in q["ids"]) for r in rows for i in r["ids"]}
    length = {i: sum(len(q["text"]) for q in rows if factor(q) >= 1 and i in q["ids"]) for i in selected}
    places = {i: (depth, t, r["up"]) for r in rows for depth, (t, _, i) in enumerate(r["up"])}
    best = max((i for i, (_, t, _) in places.items() if t in groups and selected[i] >= s.share * selected[0]), key=lambda i: (places[i][0], -i))
    around = [i for t, _, i in places[best][2][: places[best][0] + 1] if t == "article"]
    best = around[0] if around else best
    tag, own_group = places[best][1], {k: [i for t, _, i in r["up"] if t in groups][-1] for k, r in enumerate(rows)}
    tops = {best}
    if tag == "article":
        above = {i for _, _, i in places[best][2][max(0, places[best][0] - 2) : places[best][0]]}
        tops |= {i for i, (d, t, up) in places.items() if t == "article" and selected[i] and not any(x == "article" for x, _, _ in up[:d]) and above & {x for _, _, x in up[max(0, d - 2) : d]}}
    elif tag in ("body", "html", ""):
        tops = {own_group[k] for k, r in enumerate(rows) if r["on"] and r["t"] * (r["p"] + 1) * factor(r) >= cut}
    headers = {i for i, (_, t, _) in places.items() if t == "header"} if tag not in ("body", "html", "", "article") else set()
    bare = {i for i in tops if places[i][1] in ("body", "html", "")}
    tops = {i for i in tops - bare if selected[i] >= s.hold * length[i]}
    out, usual = [], [len(r["text"]) for r in rows if r["on"]]
    for k, r in enumerate(rows):
        if own_group[k] in bare or tops & set(r["ids"]):
            keep = r["on"] or not r["marks"] - lifted - headers and len(r["text"]) <= s.beside * sum(usual) / len(usual)
        else:
            keep = r["on"] and r["t"] * (r["p"] + 1) * factor(r) >= cut
        out += [r["text"]] if keep else []
    return "\n".join(out)


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["lorem", "ipsum", "dolor,", "sit.", "amet", "elit;"]) for _ in range(n))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "h2", "li", "group", "group"] if depth else ["group"])
        if kind == "group" and depth < 5:
            tag = rng.choice(["div", "div", "section", "article", "nav", "footer", "aside", "header"])
            own = rng.choice(["", "", "", " class='ad'", " class='content'", " class='comments'", " class='notice-period'", " class='side-bar sidebar'"])
            return f"<{tag}{own}>" + "".join(part(depth + 1) for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind == "li":
            return "<ul>" + "".join(f"<li>{words(rng.randint(1, 4))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        return f"<h2>{words(rng.randint(1, 5))}</h2>" if kind == "h2" else f"<p>{words(rng.choice([2, 10, 40]))}</p>"

    return "<html><body>" + "".join(part(rng.randint(0, 1)) for _ in range(rng.randint(1, 6))) + "</body></html>"


def test_extraction_equals_brute_force():
    rng, kinds = random.Random(8), set()
    for _ in range(400):
        page = random_page(rng)
        got, expected = html_extract.main_text(page), plain_text_of(page, html_extract.Settings())
        assert got == expected, page
        every = "\n".join(b.text for b in html_extract.blocks_of(page))
        kinds.add((got == "", got == every))
    assert kinds == {(True, False), (False, True), (False, False)}


@pytest.mark.parametrize("kind", ["constant", "nearly constant", "random", "few"])
def test_ratios_decide(monkeypatch, kind):
    """Other ratios give other texts: there is no branch that markup alone decides."""
    pages = [p for _, p in zip(range(200), iter(lambda rng=random.Random(9): random_page(rng), None))]
    before = [html_extract.main_text(p) for p in pages]
    rng = random.Random(1)
    one = {"constant": lambda: (50.0, 1.0), "nearly constant": lambda: (50 + rng.random() / 1000, 1.0), "random": lambda: (rng.uniform(1, 300), rng.uniform(0, 8)), "few": lambda: (rng.choice([2.0, 200.0]), 1.0)}[kind]

    def other(blocks):
        own = {}
        return [own.setdefault(b.element.path, one()) for b in blocks]

    monkeypatch.setattr(html_extract, "path_ratios", other)
    assert sum(html_extract.main_text(p) != x for p, x in zip(pages, before)) > 80


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a x='" * 170_000, "<!" * 500_000, "<div>" * 200_000 + "deep", '<a ">"' * 170_000, "<b>" + "<div>" * 100_000 + "</b>" * 100_000, "<div>" * 100_000 + "</span>" * 100_000, "&" * 1_000_000, "<" * 1_000_000])
def test_long_markup_takes_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 10  # about 2 s at most; quadratic work would take minutes


def test_html_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "u", "plain text & more"), (3, "u", "<" * 20_000), (4, "u", "<p a='" * 3000), (5, "u", "<script>never closed"), (6, "u", "<article>" + "<div>" * 3000 + "deep"), (7, "u", "</p></div>x</b><![CDATA[ <y> ]]>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[None] == got[1] == got[5] == "" and got[2] == "plain text & more" and got[6] == "deep" and got[7] == "x <y>".replace("x ", "x ")
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


# --- shards ------------------------------------------------------------------------------------------------------------


def plain_table(shards, slots):
    """Each shard's whole preference list of slots, written out; in turns each takes the first of its list that nobody has."""
    preferences = []
    for name in shards:
        digest = int(hashlib.md5(name.encode()).hexdigest(), 16)
        start, step = digest % slots, digest // 2**64 % (slots - 1) + 1
        preferences.append(sorted(range(slots), key=lambda x, start=start, step=step: (x - start) * pow(step, -1, slots) % slots))
    taken = {}
    while len(taken) < slots:
        for k, order in enumerate(preferences):
            free = [x for x in order if x not in taken]
            if free:
                taken[free[0]] = k
    return [taken[x] for x in range(slots)]


@pytest.mark.parametrize("shards, slots", [(["a"], 2), (["a", "b", "c"], 3), ([f"s{k}" for k in range(7)], 53), ([f"s{k}" for k in range(20)], 211)])
def test_table_equals_written_out_preferences(shards, slots):
    assert sharding.fill_table(shards, slots) == plain_table(shards, slots)


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(10)]
    table = sharding.fill_table(names, 1009)
    count = Counter(table)
    assert set(count) == set(range(10)) and max(count.values()) - min(count.values()) <= 1
    less = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 9)
    assert moved < 0.2 * 1009
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c", "d"], 3)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_placement(spark):
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([(k, "x") for k in [None, None, *range(500), 7]], "doc_id long, shard string")
    got = sharding.assign(rows, F.col("doc_id"), names, 101).collect()
    table = sharding.fill_table(names, 101)
    for r in got:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert len(got) == 503 and sharding.assign(rows.limit(0), F.col("doc_id"), names, 101).collect() == []


# --- chat --------------------------------------------------------------------------------------------------------------


def test_escapes_undo(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["<", "|", "\\", "<|im_end|>", "\n", "x", "<\\|", "$1"]) for _ in range(12)) for _ in range(300)] + ["", "<|im_end|><|im_start|>assistant ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape_role(F.col("t")).alias("er")).collect():
        assert r["u"] == r["t"] == r["r"] and "<|" not in r["e"] and "\n" not in r["er"] and "<|" not in r["er"]


def test_best_branch_of_a_tree(spark):
    replies = [(1, 1, None, "user", "q", 0.5), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.5), (1, 6, 3, "user", "worse", 0.1), (2, 1, 9, "user", "orphan", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    df = spark.createDataFrame(replies, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r["conv_id"], r["branch"]): r for r in chat.format_conversations(df).collect()}
    assert set(got) == {(1, 1), (2, 1)}
    text = got[1, 1]["formatted"]
    assert [line for line in text.split("<|im_start|>") if line] == ["user\nq<|im_end|>\n", "assistant\ngood<|im_end|>\n", "user\nmore<|im_end|>\n", "assistant\nend<|im_end|>\n"]
    assert [text[s["start"] : s["end"]] for s in got[1, 1]["loss_spans"]] == ["good", "end"]
    two = chat.best_paths(df, branches=2).filter("conv_id = 1").collect()
    assert {r["branch"] for r in two} == {1, 2} and sorted(r["node"] for r in two if r["branch"] == 2) == [1, 3, 6]


def test_long_and_odd_conversations(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", f"t{k} <|im_end|>") for k in range(300)] + [(None, None, None, None), (2, 0, "a\nb\\n", None), (2, 0, "a\nb\\n", None), (3, 1, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).withColumn("score", F.lit("x"))
    made = chat.format_conversations(chat.linear_replies(df))
    got = {r["conv_id"]: r for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [x["text"] for x in got[1]["t"]] == [f"t{k} <|im_end|>" for k in range(300)]
    assert got[1]["l"] == [f"t{k} <|im_end|>" for k in range(0, 300, 2)]
    assert [tuple(x) for x in got[2]["t"]] == [("a\nb\\n", "")] * 2 and [tuple(x) for x in got[None]["t"]] == [("", "")] and got[3]["l"] == ["x" * 200_000]
    assert chat.format_conversations(chat.linear_replies(df.limit(0))).collect() == []


# --- n-gram join -------------------------------------------------------------------------------------------------------


def plain_components(docs, words, percent):
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def group_of_copies(rng, n):
    """Unrelated texts, copies, near copies of one text, texts around one shared passage, odd ones."""
    said = lambda k: [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(k)]
    base, passage = said(60), said(70)
    docs = [" ".join(said(rng.randint(1, 60))) for _ in range(n)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = said(1)[0]
        docs.append(" ".join(w))
    docs += [" ".join(said(rng.randint(0, 20)) + passage + said(rng.randint(0, 20))) for _ in range(n)]
    docs += [" ".join(base)] * 20 + ["", None, "x", "X", "x y", " \n", "one  Two", "ONE\ttwo"]
    return list(enumerate(docs))


@pytest.mark.parametrize("words, percent, settings", [(4, 85, {}), (5, 80, {"bucket": 2, "levels": (1,), "broadcast": 4}), (4, 85, {"bucket": 1, "levels": (2, 4), "broadcast": 8}), (3, 60, {"bucket": 3, "levels": (1, 8)})])
def test_components_equal_brute_force(spark, words, percent, settings):
    docs = group_of_copies(random.Random(words * percent), 40)
    got = ngram_join.cluster(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), ngram_join.Settings(words=words, percent=percent, **settings)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(docs, words, percent)


def test_shingles_of_long_and_short_texts_agree():
    s = ngram_join.Shingler(4)
    text = " ".join(f"Word{k % 5000}" for k in range(200_000)).encode()
    long, short = list(s.sets([text, b"a b c d e"]))
    assert len(text) > 1 << 20 and len(long) == 5000 and len(short) == 2
    other = ngram_join.Shingler(4)
    assert set(next(other.sets([b"word0 WORD1 word2\tword3"])).tolist()) <= set(long.tolist())


def test_join_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None), (7, "q w e r t y"), (7, "z x c v b n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "node", "n", "tokens", "prefix", "component_id", "heavy"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.cluster(df).collect()), key=str)
    assert got == sorted([(None, None), (3, 3), (3, 3), (5, 5), (7, 7), (7, 7), (None, None)], key=str)
    assert ngram_join.cluster(df.limit(0)).collect() == []


# --- archives ----------------------------------------------------------------------------------------------------------


def test_both_arc_versions_and_lengths():
    for version in (1, 2):
        blocks = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n<p>\n\nfiledesc://x 0 0 0 5\n</p>", b"no http\n\n", b""]
        data = warc.arc_head(version, "x.arc", "20240102030405") + b"".join(warc.arc_record(version, f"http://h/{k} k", "20240102030405", b, 0, "x.arc") for k, b in enumerate(blocks))
        for content in (data, gzip.compress(data)):
            got = list(warc.parse_arc("x.arc", content))
            assert [(r[1], r[2], r[3], r[4], r[6]) for r in got] == [(7, "response", "http://h/0%20k", "2024-01-02T03:04:05Z", blocks[0].partition(b"\r\n\r\n")[2]), (None, "resource", "http://h/1%20k", "2024-01-02T03:04:05Z", blocks[1]), (None, "resource", "http://h/2%20k", "2024-01-02T03:04:05Z", b"")]
    cut = warc.arc_head(1, "x", "2024") + warc.arc_record(1, "u", "2024", b"abcdef", 0, "x")[:-3]
    assert list(warc.parse_arc("x", cut))[0][6:8] == (b"abcd", 4) and list(warc.parse_arc("x", cut))[0][-1]
    for broken in (b"junk", warc.arc_head(1, "x", "2024") + b"u 1 2\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc("x", broken))


def test_archive_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1", "é\x00\n" * 1000, "<p>a</p>", "x" * 5_000_000]
    rows = [(k + 1, f"http://h/{k}" if k else None, h) for k, h in enumerate(html)] + [(1, None, "<p>a</p>"), (None, "u v\n", "<p>a</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("type", F.lit("x")).withColumn("payload", F.lit("x"))
    got = warc.archive(df, str(tmp_path / "w")).collect()
    first = defaultdict(lambda: 10**9)
    for k, _, h in rows:
        first[h or ""] = min(first[h or ""], k if k is not None else 10**9)
    seen = Counter((r["key"], r["type"], r["payload_bytes"], r["payload_digest"], r["refers_key"]) for r in got)
    expected = Counter()
    for n, (k, _, h) in enumerate(rows):
        b = (h or "").encode()
        again = k != first[h or ""] or n == len(html)  # the repeated row revisits its equal
        expected[k, "revisit" if again else "response", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), first[h or ""] if again else None] += 1
    assert seen == expected
    files = list((tmp_path / "w").glob("*.gz"))
    kinds = Counter(h["WARC-Type"] for f in files for h, _ in warc.parse_warc(f.read_bytes()))
    assert kinds["warcinfo"] >= 1 and kinds["response"] + kinds["revisit"] == len(rows)
    assert warc.archive(df.limit(0)).collect() == []


def test_small_payloads_are_never_revisits(spark):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    assert {r["key"]: r["type"] for r in warc.archive(rows, least_bytes=3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_digests_by_broadcast_and_by_shuffle(spark):
    """One id on two payloads, payloads of very different lengths, and both ways of the join."""
    html = ["a" * 300_000, "b", "b", "a" * 300_000, "c" * 50, None, ""]
    rows = spark.createDataFrame([(k // 2, f"http://h/{k}", h) for k, h in enumerate(html)], PAGES)
    records = warc.convert(warc.to_arc(rows))
    told = []
    for size in (0, 1 << 20):
        marked = warc.mark_revisits(records, broadcast_bytes=size)
        told.append(sorted((r["uri"], r["type"], r["refers_uri"], None if r["payload"] is None else len(r["payload"])) for r in marked.collect()))
        assert ("BroadcastHashJoin" in marked._jdf.queryExecution().sparkPlan().toString()) == bool(size) or not size
    assert told[0] == told[1]
    assert [(t, u and u[-1]) for _, t, u, _ in told[0]] == [("response", None), ("response", None), ("revisit", "1"), ("revisit", "0"), ("response", None), ("response", None), ("revisit", "5")]
    assert len(warc.archive(rows).collect()) == len(html)
