import html
import math
import random
import re
import statistics
import time
from collections import Counter, defaultdict

import pytest

from docloom.llm import html_extract
from docloom.llm.queries import op10_html_extraction


def test_query_returns_each_article(spark, base):
    """The tables' articles are flat, so a plain pattern gives their text."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{base}/pages.parquet").collect()}
    rows = op10_html_extraction(spark, base).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        article = re.sub(r"</?(?:p|h1|br)>", " ", article)
        want = " ".join(html.unescape(re.sub(r"</?[a-z]+[^>]*>", "", article)).split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


REPAIRED = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two <b>bo</b>ld<br>three", "one two bold three"),
    ("<body><nav>menu</nav><p>a</p><div class='side ads'>buy</div><p>b &lt;i&gt;</p><footer>f</footer>", "a b <i>"),
    ("<article><header><h1>T</h1></header><p>x</p><div id='comments'><p>no</p></div><p>y</article><p>out</p>", "T x y"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><script>open", "yes"),
    ("<ul><li>a<li>b</ul>1 < 2 &notanentity; &#233;", "a b 1 < 2 ¬anentity; é"),
    ("<head><title>t</title><body>kept", "kept"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("</div></p>stray<div>open", "stray open"), ("<p>" + "x y " * 50_000 + "</p>", ("x y " * 50_000).strip()),
    ("<form><p>mail</p></form><p>z</p><div role=banner>b</div>", "z"),
    ("<form id=page><div>" + "the whole page is one form and its text is long enough " * 30 + "</div></form>", ("the whole page is one form and its text is long enough " * 30).strip()),
    ("<p title='it is>open</p>here <b>now", "open here now"), ("a<p>b<c", "a b"),
]


def test_repair_and_noise(spark):
    df = spark.createDataFrame([(k, f"http://h{k}.example/", page) for k, (page, _) in enumerate(REPAIRED)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    for k, (page, want) in enumerate(REPAIRED):
        assert got[k] == want, page and page[:80]


@pytest.mark.parametrize("bad", ["<a '", "<a href='", "<div>", "</x>", "<p><b>x<hr>", "<li><ul>", "<b>x<br>", "<!--", "<table><tr><td>", "<script>", "= \"'<", '<article class="ab">', "&amp;<"])
def test_malformed_pages_take_linear_time(bad):
    began = time.process_time()
    html_extract.Page(bad * (1_000_000 // len(bad))).priors()
    assert time.process_time() - began < 5


def brute(pages):
    """The style tree of each host by plain loops: {(host, path): score}, and the texts that are repeated."""
    by_host = defaultdict(dict)
    for _, url, page in pages:
        p = html_extract.Page(page or "")
        same = tuple((x.path, x.text) for x in p.blocks if not x.noise)
        by_host[html_extract.host(url)].setdefault(same, []).append(p)
    scores, often = {}, set()
    for h, groups in by_host.items():
        m = len(groups)
        smooth = math.log(m + html_extract.PAGES)
        styles, prior, texts, within = defaultdict(Counter), defaultdict(list), defaultdict(set), defaultdict(list)
        for g, copies in groups.items():
            for path in {x for p in copies for x in p.kinds}:
                own = [p for p in copies if path in p.kinds]
                styles[path][min(html_extract._key(",".join(p.styles.get(path, ()))) for p in own)] += 1
                within[path] += [p.inside(path) for p in own]
                prior[path].append((min(html_extract._key(",".join(p.styles.get(path, ()))) for p in own), statistics.mean(p.priors()[path] for p in own)))
            for p in copies:
                for x in p.blocks:
                    texts[x.path, x.text, x.kept].add(g)
        words, total, flows = Counter(), Counter(), Counter()
        for (path, text, _), pages_ in texts.items():
            n = len(pages_)
            informative = n / m * len(text.split()) * (1 - math.log(n) / smooth)
            if path.endswith("/#") and "!" not in path:
                flows[path] += informative
            for k in range(1, path.count("/") + 1):
                words["/".join(path.split("/")[: k + 1])] += informative
                total["/".join(path.split("/")[: k + 1])] += n / m * len(text.split())
        article = max(((round(w, 9), p) for p, w in flows.items()), default=(0, None))[1]
        whole = {p: words[p] * (1 + min(1, sum(-c / m * math.log(c / m) for c in styles[p].values()) / smooth)) + html_extract.WORDS for p in styles}
        for p in whole:
            rivals = [w for q, w in whole.items() if q != p and q.rpartition("/")[0] == p.rpartition("/")[0]]
            reach = html_extract.REACH
            if all(within[p]) or article and p.startswith(article[:-1]) and not re.search(html_extract._DECLARED, p):
                evidence = -math.log(html_extract.REPEATED)
            else:
                evidence = math.log(whole[p] / max(rivals, default=html_extract.WORDS))
            evidence += math.log((words[p] + 1) / (total[p] + 1))
            scores[h, p] = statistics.mean(v for _, v in prior[p]) + max(-reach, min(reach, evidence))
        for (path, text, kept), pages_ in texts.items():
            if len(pages_) > 1 and not kept and 1 - math.log(len(pages_)) / smooth < html_extract.REPEATED:
                often.add((h, path, html_extract._key(text)))
    return scores, often


def test_tree_equals_brute_force(spark, monkeypatch):
    rng, pages = random.Random(5), []
    sentence = lambda n: " ".join(rng.choice("river stone light paper window garden".split()) for _ in range(n))
    for k in range(120):
        parts = [f"<div class=top>{rng.choice(['Home page', 'Start here'])}</div>", f"<div class=story-{k}>" + "".join(f"<p>{sentence(20)}</p>" for _ in range(rng.randint(1, 6))) + "</div>"]
        parts += [f"<aside><ul>{'<li>' + sentence(2)}</ul></aside>"] * rng.randint(0, 2) + ["<div>Contact us</div>"] * (k % 3 > 0)
        rng.shuffle(parts)
        pages.append((k, f"http://h{k % 4}.example/{k}", f"<body>{''.join(parts)}</body>"))
    pages += [(1, "http://h1.example/copy", pages[1][2])] * 5
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    tree = html_extract.shared(html_extract.style_tree(html_extract.features(df)))
    scores, often = brute(pages)
    got = {(r.host, r.path): r.score for r in html_extract.importance(tree).collect()}
    assert got.keys() == scores.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in scores.items())
    assert {tuple(r) for r in html_extract.repeated(tree).collect()} == often
    texts = sorted((r.page_id, r.url, r.text) for r in html_extract.main_text(df).collect())
    want = []
    for page_id, url, page in pages:
        h = html_extract.host(url)
        low = {p for (x, p), v in scores.items() if x == h and v < 0}
        want.append((page_id, url, html_extract.extract(page, low, {(p, k) for x, p, k in often if x == h})))
    assert texts == sorted(want)
    monkeypatch.setattr(html_extract, "KNOWN", 0)  # too many judgements to broadcast
    assert sorted((r.page_id, r.url, r.text) for r in html_extract.main_text(df).collect()) == sorted(want)
    assert any("Contact" in p and "Contact" not in t for (_, _, p), (_, _, t) in zip(sorted(pages), sorted(want), strict=True))


def test_the_tree_decides(spark, base):
    """On the given pages: priors alone give another text on every page, the tree without any prior the right one on nearly all."""
    pages = spark.read.parquet(f"{base}/pages.parquet")
    texts = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    rows = html_extract.importance(html_extract.shared(html_extract.style_tree(html_extract.features(pages)))).collect()
    assert all(abs(p) < html_extract.REACH for p in html_extract.PRIORS.values())
    low = defaultdict(set)
    for r in rows:
        if r.evidence < 0:
            low[r.host].add(r.path)
    source = pages.collect()
    by_priors = {r.page_id: html_extract.extract(r.html, {p for p, v in html_extract.Page(r.html).priors().items() if v < 0}) for r in source}
    by_tree = {r.page_id: html_extract.extract(r.html, low[html_extract.host(r.url)]) for r in source}
    assert sum(by_priors[k] != t for k, t in texts.items()) == len(texts)
    assert sum(by_tree[k] == t for k, t in texts.items()) > 0.95 * len(texts)
    assert sum((r.prior < 0) != (r.score < 0) for r in rows) > len(rows) / 10


def test_short_parts_of_a_long_article_stay(spark):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i: f"<div class=menu><a>Start</a></div><div><h1>T{i}</h1><p>{words(i, 600)}</p><figure>{words(i, 2)}y</figure><ul><li>{words(i, 1)}z</ul></div><div><p>{words(i, 6)}v</p></div>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[3].startswith("T3 w3x0") and "w3x1y" in got[3] and "w3x0z" in got[3] and "Start" not in got[3]


def test_style_tree_removes_repeated_branches(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"http://site.example/{i}", f"<body><div><span>Site motto here</span></div><div><p>Story {i} tells of {i * 7}.</p><p>More {i}</p></div><div>Call us today</div></body>", 1))
    rows += [(100, "http://other.example/", "<body><div>Site motto here</div><p>q</p></body>", 1), (101, None, None, 1), (101, "", "<p>r</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(6)
    got = html_extract.main_text(df).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
    assert texts[3] == ["Story 3 tells of 21. More 3"]
    assert texts[100] == ["Site motto here q"] and sorted(texts[101]) == ["", "r"]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_copies_of_an_article_stay_whole(spark):
    page = "<body><nav>n</nav><article><h1>Same</h1><p>text for all</p></article></body>"
    df = spark.createDataFrame([(i, "http://h.example/x", page) for i in range(50)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.main_text(df).collect()} == {"Same text for all"}


def test_copies_without_article_stay_whole(spark):
    words = lambda i: f"<div>opening {i} of a story</div><div><p>Body {i} goes on</p><div>and ends {i}</div></div>"
    page = lambda i: f"<body>{words(i)}</body>"
    rows = [(i, f"https://copies.example/{i}", page(0 if i < 200 else i)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[5] == "opening 0 of a story Body 0 goes on and ends 0" and got[299] == "opening 299 of a story Body 299 goes on and ends 299"
