"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree. Spark holds the tree as rows, not as
an object: (host, branch, style) for the child sequences of each element, and (host,
branch, text) for the texts, each with its number of pages; pages of a host with the
same content count once, so copies do not make a text common.

Text elements of one parent (paragraphs, headings, list items, cells) are one branch of
the tree, its flow: their amounts are no evidence against each other. Every branch of every
page is scored by the tree of its host:

* content: the informative words it holds, an average over the host's pages. A text's
  words count by 1 - log(n) / log(m) where n of m pages repeat it, which is 1 less the
  normalised entropy of its spread over the pages; branches add up to their ancestors.
* presentation: the normalised entropy of its styles over the host's pages.
* importance: content * (1 + presentation). A branch is set against the strongest of
  its siblings by the logarithm of their ratio.
* template: the logarithm of its informative share of words, 0 where no page repeats another.
  Within an article - a declared one, or the parent of the host's richest flow - this alone
  counts, against the share ``REPEATED``, as parts of an article may be short.
* The sum of both, within ``REACH``, is the evidence. What HTML declares is a prior in the same
  scale (``PRIORS``) that the evidence can always overrule. Menus, headers, footers, sidebars and
  forms that only their tags declare have no prior: the tree decides, and their tag breaks ties.

A branch below zero goes with all below it. Apart from that a text goes that too many
pages of the host repeat, unless it is a text element of a declared article. Small hosts are smoothed as
if ``PAGES`` more pages were known and each branch had ``WORDS`` words more.

Html is parsed in one linear pass, twice: once for the tree, once to apply it. Up to
``KNOWN`` judgements (counted first) are broadcast and html is not shuffled; beyond, a page
meets its judgements in a join by the hash of its url and html, so repeated ids do not
matter there either. Counts are combined before each shuffle, so a host with a third of
all pages costs no task more.

Defined results: null or empty html gives the empty text; pages without a host form
the host ''; repeated rows and ids are extracted each; unclosed and stray tags and
quotes are repaired much as browsers do; elements nested below ``DEPTH`` count as part
of the branch at that depth; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import shared

#: Text inside these is never content.
DROPPED = frozenset("head script style noscript template svg math iframe object canvas select button textarea".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu".split())
MAIN_TAGS = frozenset(("article", "main"))
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style noscript template svg iframe textarea".split())
#: Elements that a following start tag of the listed kinds ends.
ENDS_P = BLOCKS - frozenset(("html", "body", "br", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"))
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
SCOPES = tuple("ul ol dl table tr tbody thead tfoot article main div section body".split())
#: Words of class and id names that mark noise.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup share sharing social comment comments respond disqus replies related recommended login search pagination pager toolbar footer masthead skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo search complementary dialog".split())
KEPT_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())

#: How far the tree moves a branch, and the priors it starts from (natural logarithms of odds).
REACH = 5.5
PRIORS = {"main": 2.0, "open": 3.0, "outside": 0.0, "tag": 0.0, "name": -4.0}
#: Smoothing of small hosts, and the importance below which a repeated text goes, and a part of an article without priors.
PAGES, WORDS, REPEATED = 8, 5.0, 0.3
DEPTH = 32
#: The branch of an element's text elements.
FLOW = "#"
#: Judgements that may be broadcast, some ten megabytes.
KNOWN = 100_000

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)|<[!?]")
_STOP = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: A branch under one that its tag or name declares.
_DECLARED = rf"!|/({'|'.join(sorted(NOISE_TAGS | {'header'}))})(\.[^/]*)?(/|$)"
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")
_PLAIN = re.compile(r"[^a-z]+")


def tokens(page: str):
    """Yields (text before, closing, tag, attributes) of each tag; tag None for text before a comment or the end.

    Linear: each search starts where the last one ended, and a search that fails is
    not made again. A quote that nothing closes is an ordinary character.
    """
    at, n = 0, len(page)
    unclosed: set[str] = set()
    while m := _OPEN.search(page, at):
        text, end = page[at : m.start()], m.end()
        if not m[2]:
            yield text, None, None, ""
            mark = "-->" if page.startswith("<!--", m.start()) else ">"
            close = page.find(mark, end)
            at = n if close < 0 else close + len(mark)
            continue
        while (stop := _STOP.search(page, end)) and (quote := stop[1]):
            end = stop.end()
            if quote not in unclosed:
                close = page.find(quote, end)
                if close < 0:
                    unclosed.add(quote)
                else:
                    end = close + 1
        if not stop:  # the page ends inside a tag
            yield text, None, None, ""
            return
        tag, at = m[2].lower(), stop.end()
        yield text, bool(m[1]), tag, page[m.end() : stop.start()]
        if tag in RAW and not m[1]:
            close = _ends(tag).search(page, at)
            at = close.end() if close else n
            yield "", True, tag, ""
    yield page[at:], None, None, ""


@cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


class Block:
    """A run of text with the branch of elements around it."""

    __slots__ = ("path", "kept", "noise", "text")

    def __init__(self, path, kept, noise, text):
        self.path, self.kept, self.noise, self.text = path, kept, noise, text


class _Element:
    __slots__ = ("tag", "path", "depth", "noise", "main", "leaf")

    def __init__(self, tag, path, depth, noise, main, leaf):
        self.tag, self.path, self.depth, self.noise, self.main, self.leaf = tag, path, depth, noise, main, leaf


def _named(attrs: str) -> tuple[str, bool]:
    """The letters of an element's class, id and role, and whether they declare noise."""
    label, noise = [], False
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        words = _PLAIN.split(value)
        noise = noise or (value in NOISE_ROLES if m[1].lower() == "role" else not NOISE_WORDS.isdisjoint(words))
        label += words
    return "-".join(filter(None, label)), noise


class Page:
    """Blocks in page order, the styles of the branches, and their priors."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.styles: dict[str, list[str]] = {}
        self.kinds: dict[str, tuple[str, str, bool]] = {}
        self._main: set[str] = set()
        self._parse(page)

    def _parse(self, page: str) -> None:
        stack = [_Element("", "", 0, "", False, "")]
        open_at: dict[str, list[int]] = defaultdict(list)
        parts: list[str] = []
        hidden = 0

        def flush():
            if parts:
                text = " ".join(markup.unescape("".join(parts)).split())
                parts.clear()
                if text and not hidden:
                    top = stack[-1]
                    self.blocks.append(Block(top.path, top.main and top.leaf in KEPT_LEAVES, bool(top.noise), text))

        def cut(k: int) -> None:
            nonlocal hidden
            for e in stack[k:]:
                open_at[e.tag].pop()
                hidden -= e.tag in DROPPED
            del stack[k:]

        def nearest(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        for text, closing, tag, attrs in tokens(page):
            if text:
                parts.append(text)
            if tag is None:
                continue
            if closing:
                if k := nearest((tag,)):
                    if any(e.tag in BLOCKS or e.tag in DROPPED for e in stack[k:]):
                        flush()
                    cut(k)
                continue
            if tag in BLOCKS or tag in DROPPED:
                flush()
            if tag in ENDS_P and (k := nearest(("p",))) and k > nearest(SCOPES):
                cut(k)
            if tag == "body" and hidden:
                cut(next(k for k, e in enumerate(stack) if e.tag in DROPPED))
            if tag in SIBLINGS and (k := nearest(SIBLINGS[tag])):
                if k > nearest(s for s in SCOPES if s not in SIBLINGS[tag]):
                    cut(k)
            if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
                continue
            top = stack[-1]
            path, depth, leaf, noise = top.path, top.depth, top.leaf, top.noise
            label, named = _named(attrs) if attrs and tag not in ("html", "body") else ("", False)
            if named and tag not in MAIN_TAGS:
                noise = "name"
            elif not noise and (tag in NOISE_TAGS or tag == "header" and not top.main):
                noise = "tag"
            if tag in BLOCKS:
                leaf = tag
                self.styles.setdefault(path, []).append(tag)
            if depth < DEPTH and (tag in BLOCKS or noise != top.noise):
                step = FLOW if tag in KEPT_LEAVES and not named else tag + f".{label}" * bool(label) + "!" * named
                if step != FLOW or not path.endswith("/" + FLOW):
                    path, depth = f"{path}/{step}", depth + 1
                    self.kinds.setdefault(path, (tag, "" if noise == top.noise else noise, top.main and not noise))
            main = top.main or tag in MAIN_TAGS and not noise
            if main and not top.main:
                self._main.add(path)
            open_at[tag].append(len(stack))
            stack.append(_Element(tag, path, depth, noise, main, leaf))
            hidden += tag in DROPPED
        flush()

    def priors(self) -> dict[str, float]:
        """The prior of each branch: what tags and names declare, before the host's tree is asked."""
        around = {p[:k] for p in self._main for k in range(1, len(p)) if p[k] == "/"} | self._main
        out = {}
        for path, (_, noise, inside) in self.kinds.items():
            if noise:
                kind = noise
            elif path in around:
                kind = "main"
            else:
                kind = "open" if inside or not self._main else "outside"
            out[path] = PRIORS[kind]
        return out

    def inside(self, path: str) -> bool:
        """Whether a branch lies in a declared article and under nothing declared as noise."""
        return self.kinds[path][2]


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _key(*parts: str) -> int:
    """A stable 64-bit key of some strings."""
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


#: One row for each feature of a page. kind 0: the page, 1: a branch with its style, prior and whether it lies in an
#: article (kept), 2: a text with its words and whether an article keeps it.
_FEATURES = "page long, host string, same long, path string, kind byte, key long, value double, kept boolean"


def _features(batches):
    for b in batches:
        rows = []
        for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            page, h = Page(html or ""), host(url)
            priors = page.priors()
            same = _key(*(part for x in page.blocks if not x.noise for part in (x.path, x.text)))
            rows.append((page_id, h, same, "", 0, 0, 0.0, True))
            rows += [(page_id, h, same, p, 1, _key(",".join(page.styles.get(p, ()))), v, page.inside(p)) for p, v in priors.items()]
            texts = {(x.path, _key(x.text)): (float(len(x.text.split())), x.kept) for x in page.blocks}
            rows += [(page_id, h, same, p, 2, k, *v) for (p, k), v in texts.items()]
        columns = zip(*rows, strict=True) if rows else ((),) * 8
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int8(), pa.int64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page", "host", "same", "path", "kind", "key", "value", "kept"])


def features(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    rows = pages.select(_page(url, html).alias("page"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(_features, _FEATURES)


def _page(url: str, html: str):
    return F.xxhash64(F.col(url).cast("string"), F.col(html), F.length(html))


def style_tree(found: DataFrame) -> DataFrame:
    """(host, path, kind, key, n, value, kept): distinct pages of a host with a style (1) or text (2) at a branch; kind 0 counts the pages."""
    text = F.when(F.col("kind") == 2, F.col("key")).alias("text")
    once = found.groupBy("host", "same", "path", "kind", text).agg(F.min("key").alias("key"), F.avg("value").alias("value"), F.bool_and("kept").alias("kept"))
    return once.groupBy("host", "path", "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"), F.bool_and("kept").alias("kept"))


def importance(tree: DataFrame) -> DataFrame:
    """(host, path, prior, evidence, score) of every branch of every host; a branch below zero goes."""
    size = tree.where("kind = 0").groupBy("host").agg(F.sum("n").alias("m"))
    # everything is summed by branch before it meets the host's number of pages m, so a large host is no large group
    n = F.col("n").cast("double")
    sums = tree.where("kind > 0 and path <> ''").groupBy("host", "path", "kind").agg(
        F.sum(n).alias("n"), F.sum(n * F.log(n)).alias("nl"), F.sum(n * F.col("value")).alias("nv"), F.sum(n * F.col("value") * F.log(n)).alias("nvl"), F.bool_and("kept").alias("kept")
    )
    m, smooth = F.col("m").cast("double"), F.log(F.col("m").cast("double") + PAGES)
    sums = sums.join(size, "host")
    # words of the texts in the mean page, and these each less by how evenly its text is spread over the pages
    texts = sums.where("kind = 2").select("host", "path", ((F.col("nv") - F.col("nvl") / smooth) / m).alias("words"), (F.col("nv") / m).alias("total"))
    # the richest flow's parent stands for an article where none is declared
    flows = texts.where(F.col("path").endswith("/" + FLOW) & ~F.col("path").contains("!"))
    richest = flows.groupBy("host").agg(F.max(F.struct("words", "path")).alias("f")).select("host", F.regexp_replace("f.path", FLOW + "$", "").alias("article"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    content = texts.select("host", F.explode(above).alias("path"), "words", "total").groupBy("host", "path").agg(F.sum("words").alias("words"), F.sum("total").alias("total"))
    entropy = (F.col("n") * F.log(m) - F.col("nl")) / m
    style = sums.where("kind = 1").select("host", "path", F.least(F.lit(1.0), entropy / smooth).alias("presentation"), (F.col("nv") / F.col("n")).alias("prior"), "kept")
    words, total = F.coalesce("words", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
    whole = words * (1 + F.col("presentation")) + WORDS
    parent = F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/")
    under = F.col("path").startswith(F.col("article")) & ~F.col("path").rlike(_DECLARED)
    inside = F.col("kept") | F.coalesce(under, F.lit(False))
    branch = style.join(content, ["host", "path"], "left").join(richest, "host", "left")
    branch = branch.select("host", "path", parent.alias("parent"), "prior", whole.alias("whole"), F.log((words + 1) / (total + 1)).alias("template"), inside.alias("inside"))
    # the strongest sibling: the best of the parent's branches, or the second where the branch is the best itself
    top = branch.groupBy("host", "parent").agg(F.max(F.struct("whole", "path")).alias("best"))
    among = branch.join(top, ["host", "parent"])
    second = among.where("path <> best.path").groupBy("host", "parent").agg(F.max("whole").alias("second"))
    rival = F.when(F.col("path") == F.col("best.path"), F.coalesce("second", F.lit(WORDS))).otherwise(F.col("best.whole"))
    beside = F.when(F.col("inside"), -math.log(REPEATED)).otherwise(F.log(F.col("whole") / rival))
    evidence = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), beside + F.col("template")))
    out = among.join(second, ["host", "parent"], "left").withColumn("evidence", evidence)
    return out.select("host", "path", "prior", "evidence", (F.col("prior") + F.col("evidence")).alias("score"))


def low_branches(scored: DataFrame) -> DataFrame:
    """The branches that go: those below zero, and at zero those that their tag declares."""
    tag = F.regexp_extract("path", r"([a-z0-9-]+)[^/]*$", 1)
    return scored.where((F.col("score") < 0) | (F.col("score") == 0) & tag.isin(*NOISE_TAGS, "header")).select("host", "path")


def repeated(tree: DataFrame) -> DataFrame:
    """(host, path, key) of the texts that too many pages of their host repeat."""
    size = tree.where("kind = 0").groupBy("host").agg(F.sum("n").alias("m"))
    often = tree.where("kind = 2 and n > 1 and not kept").join(size, "host")
    content = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("m").cast("double") + PAGES)
    return often.where(content < REPEATED).select("host", "path", "key")


_TEXTS = "page_id long, url string, text string, n_chars long"


def _texts(ids, urls, texts) -> pa.RecordBatch:
    sizes = pa.array([len(t) for t in texts], pa.int64())
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def _apply_known(held):
    """Rows (page_id, url, html): the text without the host's low branches and texts."""

    def run(batches):
        none = (frozenset(), frozenset())
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield _texts(b.column(0), b.column(1), [extract(html, *held.value.get(host(url), none)) for url, html in rows])

    return run


def _apply_joined(batches):
    """Rows (page_id, url, html, low): the text without the branches and texts that are low."""
    for b in batches:
        texts = []
        for html, low in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            paths = {x["path"] for x in low or () if x["key"] is None}
            keys = {(x["path"], x["key"]) for x in low or () if x["key"] is not None}
            texts.append(extract(html, paths, keys))
        yield _texts(b.column(0), b.column(1), texts)


def extract(html: str | None, paths: set[str] = frozenset(), keys: set[tuple[str, int]] = frozenset()) -> str:
    """The text of one page without the given branches and (branch, text) pairs."""
    gone: dict[str, bool] = {"": False}

    def low(path: str) -> bool:
        if path not in gone:
            gone[path] = path in paths or low(path.rpartition("/")[0])
        return gone[path]

    return " ".join(x.text for x in Page(html or "").blocks if not low(x.path) and not (keys and (x.path, _key(x.text)) in keys))


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    tree = shared(style_tree(features(rows)))
    branches = low_branches(importance(tree)).withColumn("key", F.lit(None).cast("long"))
    low = shared(branches.unionByName(repeated(tree)))
    if low.count() <= KNOWN:
        known: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for r in low.collect():
            paths, keys = known[r["host"]]
            if r["key"] is None:
                paths.add(r["path"])
            else:
                keys.add((r["path"], r["key"]))
        return rows.mapInArrow(_apply_known(rows.sparkSession.sparkContext.broadcast(dict(known))), _TEXTS)
    # a page has a row for each of its branches (key null) and one for each of its texts
    own = features(rows).where("kind > 0").select("page", "host", "path", F.when(F.col("kind") == 2, F.col("key")).alias("key"))
    same = [own["host"] == low["host"], own["path"] == low["path"], own["key"].eqNullSafe(low["key"])]
    by_page = own.join(low, same).groupBy(own["page"]).agg(F.collect_set(F.struct(own["path"], own["key"])).alias("low"))
    keyed = rows.withColumn("page", _page("url", "html"))
    return keyed.join(by_page, "page", "left").select("page_id", "url", "html", "low").mapInArrow(_apply_joined, _TEXTS)
