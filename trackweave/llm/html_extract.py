"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags and classes from the root are one
node of the host's tree. A node whose children look the same on all pages, and whose text repeats from page
to page, has a low entropy of presentation and content; such branches are site furniture and are cut from each page.
What the markup itself names as furniture (navigation, adverts, forms, ...) is cut as well, and where a page marks its
article, only that is kept.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .urls import host_of

_TOKEN = re.compile(
    # a quote opens a value only after "="; what the end of the page leaves open goes
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|style|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUES = re.compile(r"""=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'>]+)""")
_HIDDEN, _NOT_SHOWN = re.compile(r"(?:^|\s)hidden(?=\s|/|$)", re.I), re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
#: The words of a name: its parts between signs, digits and changes of case.
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg annotation annotation-xml textarea select option canvas audio video title".split())
CLOSES_P = set("address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())
#: Elements that begin and end a block; all others, unknown ones too, are part of a line.
BLOCKS = CLOSES_P | set("br html body head li dt dd tr td th caption thead tbody tfoot colgroup optgroup option legend summary hgroup search dialog frameset noframes title".split())
#: What may stand in a head; anything else, text too, closes a head that is still open.
METADATA = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An opened element closes one of these that is still open, down to the nearest of the second set.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FURNITURE_TAGS = set("head nav aside footer form button dialog menu".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
FURNITURE_NAMES = set("""ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion
cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall
sidebar rail widget widgets related recommended recommendations share sharing social follow
menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc
comment comments commentlist replies reply
footer copyright skip""".split())
#: Words that name furniture beside an article, but may name its subject or parts within it.
OUTER_WORDS = set("alert legal login signup register discussion disqus respond".split())
#: Names of reader comments, which may be articles themselves.
COMMENT_NAMES = set("comment comments commentlist replies reply".split())
#: What a compound name may hold beside one of these and still name furniture, as it may hold parts of two letters or one; "social-science" does not.
COMPANIONS = set("""area bar block body bottom box button buttons container content cta entry facebook form group header holder icons inner item items left link links list
main news page panel post posts pane reader right row section site slot story strip text title top twitter unit user users wrap wrapper""".split())
#: Cut outside the article only: within it, these hold its title.
OUTER_NAMES = set("header masthead topbar top hero search side".split())
ARTICLE_NAMES = {"articlebody", "article-body", "post-content", "entry-content", "article-content"}
#: Pages that a node must be on before its entropy counts; weight of a node's children; least importance that stays.
MIN_PAGES, GAMMA, LEAST_IMPORTANCE = 4, 0.9, 0.3


def _named(words: list[set[str]], among: set[str], alone: bool = False) -> bool:
    """Whether a name has one of these words and, beside it, none that says something else."""
    return any(w & among and (w <= among if alone else all(len(x) < 3 or x in among or x in COMPANIONS for x in w)) for w in words)


@lru_cache(100_000)
def _look(tag: str, attributes: str) -> tuple[str, str]:
    """What an element is for and its look (tag, classes). Purposes: "furniture"; "frame", furniture unless a page's only
    article is in it; "outer", furniture outside of the article; "article"; "" for all else."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if attributes else {}
    named = {k: v.lower() for k, v in given.items()}
    look = f"{tag}.{'.'.join(sorted(named.get('class', '').split()))}"
    if tag in ("html", "body"):
        return "", look
    if attributes and (_NOT_SHOWN.search(named.get("style", "")) or _HIDDEN.search(_VALUES.sub(" ", attributes))):
        return "furniture", look
    names = f"{given.get('class', '')} {given.get('id', '')}".split()
    words = [{x.lower() for x in _WORDS.findall(n)} for n in names]
    if tag in ("article", "main"):
        return ("furniture" if _named(words, COMMENT_NAMES) else "article"), look
    if tag in FURNITURE_TAGS or named.get("role") in FURNITURE_ROLES:
        return ("frame" if tag == "form" or named.get("role") == "form" else "furniture"), look
    if named.get("role") in ("main", "article") or named.get("itemprop") == "articlebody" or ARTICLE_NAMES & {n.lower() for n in names}:
        return "article", look
    if _named(words, FURNITURE_NAMES):
        return "frame", look
    if tag == "header" or _named(words, OUTER_NAMES) or _named(words, OUTER_WORDS):
        return "outer", look
    return "", look


@lru_cache(200_000)
def _path(parent: int, look: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent:x}/{look}") - (1 << 63)


class Page:
    """A page's elements in order: parent, path and purpose; and its text runs, each with its element."""

    def __init__(self, source: str):
        self.parent, self.path, self.look, self.purpose, self.tags = [-1], [0], [""], [""], ["#root"]
        self.children: list[list[int]] = [[]]
        self.runs: list[tuple[int, str]] = []
        self._stack, self._open = [0], {}
        at, end, in_head, endless = 0, len(source), False, set()
        while at < end:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                if in_head and not source[at:stop].isspace():
                    self._close({"head"})
                    in_head = False
                self.runs.append((self._stack[-1], source[at:stop]))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in RAW or tag in VOID:
                    if tag == "br":
                        self._break()
                    continue
                self._close({tag})
                if tag in BLOCKS:
                    self._break()
                continue
            if in_head and tag not in METADATA:
                self._close({"head"})
                in_head = False
            if tag in RAW:
                if not (m[3] or "").rstrip().endswith("/"):
                    # an end that was not found once is not looked for again
                    closing = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    if closing:
                        at = closing.end()
                    else:
                        endless.add(tag)
                        at = end if tag in ("script", "style") else at
                if tag in BLOCKS:
                    self._break()
                continue
            if tag in CLOSES_P:
                self._close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in SIBLINGS:
                self._close(*SIBLINGS[tag])
            if tag in BLOCKS:
                self._break()
            if tag in VOID:
                continue
            purpose, look = _look(tag, m[3] or "")
            parent = self._stack[-1]
            self.children[parent].append(len(self.tags))
            self.parent.append(parent)
            self.path.append(_path(self.path[parent], look))
            self.look.append(look)
            self.purpose.append(purpose)
            self._open.setdefault(tag, []).append(len(self._stack))
            self._stack.append(len(self.tags))
            self.tags.append(tag)
            self.children.append([])
            in_head |= tag == "head"

    def _break(self) -> None:
        self.runs.append((self._stack[-1], " "))

    def _close(self, tags: set[str], within: set[str] = frozenset()) -> None:
        """Close the innermost open element of ``tags`` and all in it, unless one of ``within`` was opened after it.

        The places of open elements are kept by tag, so this costs no walk over what is open; each element is closed once.
        """
        k, barrier = (max((self._open[t][-1] for t in own if self._open.get(t)), default=0) for own in (tags, within))
        if k > barrier:
            for element in reversed(self._stack[k:]):
                self._open[self.tags[element]].pop()
            del self._stack[k:]

    def features(self) -> set[tuple[int, int, int]]:
        """(path, kind, feature): kind 0 the looks of the children, 1 the element's own text, 2 that the page has the path."""
        own: dict[int, list[str]] = {}
        for element, text in self.runs:
            if text != " ":
                own.setdefault(element, []).append(text)
        found = set()
        for k, path in enumerate(self.path):
            looks: list[str] = []
            for c in self.children[k]:
                if not looks or looks[-1] != self.look[c]:
                    looks.append(self.look[c])
            found.add((path, 0, xxhash.xxh64_intdigest("|".join(looks)) - (1 << 63)))
            found.add((path, 2, 0))
            if k in own and (text := " ".join("".join(own[k]).split())):
                found.add((path, 1, xxhash.xxh64_intdigest(text) - (1 << 63)))
        return found

    def text(self, model: dict[int, tuple[int, float, float | None]]) -> str:
        """The main text. ``model``: path -> (presentations, importance of presentation, importance of text or None)."""
        n = len(self.tags)

        def marked_by(purpose: list[str]) -> tuple[list[bool], list[bool]]:
            article, cut = [False] * n, [False] * n
            for k in range(1, n):
                up = self.parent[k]
                cut[k] = cut[up] or purpose[k] in ("furniture", "frame") or (purpose[k] == "outer" and not article[up])
                article[k] = not cut[k] and (article[up] or purpose[k] == "article")
            return article, cut

        article, cut = marked_by(self.purpose)
        if "article" in self.purpose and not any(article):
            # the page's articles are all in forms or in what a name calls furniture: what is around one of them isn't
            around = [p == "article" for p in self.purpose]
            for k in range(n - 1, 0, -1):
                around[self.parent[k]] |= around[k]
            article, cut = marked_by(["" if p in ("frame", "outer") and around[k] else p for k, p in enumerate(self.purpose)])
        holds = article[:]
        importance = [1.0] * n
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            holds[up] = holds[up] or holds[k] and not article[up]
            if self.path[k] in model:
                styles, look, text = model[self.path[k]]
                below = [importance[c] for c in self.children[k]] + ([] if text is None else [text])
                weight = GAMMA**styles if self.children[k] else 1.0
                importance[k] = (1 - weight) * look + weight * max(below, default=1.0)  # as its most important part
        marked = any(article)
        for k in range(1, n):
            root = article[k] and not article[self.parent[k]]
            outside = holds[k] and not article[k]
            cut[k] = cut[k] or cut[self.parent[k]] or not (root or outside) and importance[k] < LEAST_IMPORTANCE
        kept = [html.unescape(t) if "&" in t else t for k, t in self.runs if not cut[k] and (article[k] or not marked)]
        return " ".join("".join(kept).split())


def site_styles(pages: DataFrame) -> DataFrame:
    """(host, styles): for each host the paths of its style tree that could be unimportant, as an array of structs
    (path, presentations, look, text). Counted over all pages; a path on fewer than MIN_PAGES pages has no say."""

    def run(batches):
        for batch in batches:
            hosts, paths, kinds, features = [], [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, kind, feature in Page(source.as_py() or "").features():
                    hosts.append(host)
                    paths.append(path)
                    kinds.append(kind)
                    features.append(feature)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.int64()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int8()), pa.array(features, pa.int64())],
                names=["host", "path", "kind", "feature"])

    seen = pages.select(F.xxhash64("host").alias("host"), "html").mapInArrow(run, "host long, path long, kind byte, feature long")
    counts = seen.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"))
    own = {kind: F.col("kind") == kind for kind in (0, 1, 2)}
    total = F.sum(F.when(own[0], F.col("k")))
    nodes = counts.groupBy("host", "path").agg(
        F.max(F.when(own[2], F.col("k"))).alias("pages"), F.count_if(own[0]).cast("int").alias("presentations"),
        (F.log(total) - F.sum(F.when(own[0], F.col("k") * F.log("k"))) / total).alias("entropy"),
        F.avg(F.when(own[1], F.log("k"))).alias("shared")).where(F.col("pages") >= MIN_PAGES)
    look = F.col("entropy") / F.log("pages")
    text = 1 - F.col("shared") / F.log("pages")
    low = nodes.where("shared is null").select("host", "path", "presentations", look.alias("look"), F.lit(None).cast("double").alias("text")).union(
        nodes.where("shared is not null").select("host", "path", "presentations", look, text).where(text < 0.7))
    return low.groupBy("host").agg(F.collect_list(F.struct("path", "presentations", "look", "text")).alias("styles"))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row (page_id, url, text, n_chars) for each page.

    Two passes over the pages: the first counts each host's style tree, by path and feature, so that a host
    with any share of the pages is spread over all tasks; the second joins each page with its host's tree, which Spark
    broadcasts only if the written table is small enough, and cuts the page.

    A null or empty html gives an empty text; so does a page without text. A page is parsed and returned whole, however
    long. A null url or one without a host shares the tree of the empty host. Null and repeated ids and repeated rows each
    get their row, and repeated pages count in their tree each time; which of them comes first changes nothing. An
    empty table has none; other columns are not read, whatever they are named.
    """
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    trees = materialise(site_styles(known))
    joined = known.withColumn("host", F.xxhash64("host")).join(trees, "host", "left").select("page_id", "url", "html", "host", "styles")

    def run(batches):
        host, model = None, {}
        for batch in batches:
            texts = []
            for source, of, styles in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if of != host:
                    host = of
                    model = {s["path"]: (s["presentations"], s["look"], s["text"]) for s in styles.as_py() or []}
                texts.append(Page(source.as_py()).text(model))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
