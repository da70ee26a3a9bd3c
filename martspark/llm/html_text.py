"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each page is parsed to a tree. Every element gets features of its tag, its class
and id tokens and those above it, its depth, its place among its siblings, and
the density of text, links and punctuation below it. A gradient-boosted tree model
gives each element a score for being main text.

Decoding keeps ancestors and descendants consistent: a block is kept whole,
dropped whole, or left to its children, and elements inside a line go with their block. Kept and dropped elements decide for all
that is below them; an element left to its children gives up its own score. The
choice with the largest sum of scores is found in one pass from the leaves up.

The model is fitted (``pyspark.ml``) on at most ``SAMPLE_PAGES`` distinct marked pages,
those of the smallest hashes, a bound for the fit alone. Labels come from pages that
mark one ``article`` or ``main`` element:
what is inside is main text. The sample is varied: marks are taken away, and
menus, sidebars, notices, forms and reader comments made of the page's own
words are set around the text, so that the model does not rest on one tag. If no
page carries such a mark, a fixed rule on cues and densities scores instead.

Defined results: a missing or empty page has an empty text; anything that is not
markup is text; unclosed and misplaced tags are closed as browsers do for blocks;
pages without id or with repeated ids are handled one by one; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import batches
from martspark.session import working_path, written

SAMPLE_PAGES = 300
TREES = 16
DEPTH = 4
STEP = 0.2

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without content, elements that make blocks, and blocks that end an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("html body p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
             "tfoot tr td th caption form fieldset blockquote pre figure figcaption address details summary hgroup".split())
SAME_KIND = {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
NEVER = set("head form button select label script style".split())

# Words in tags, classes and ids that tell boilerplate or main text apart.
AWAY = set("nav menu navbar header footer sidebar aside comment comments reply respond ad ads advert advertisement banner promo "
           "sponsor sponsored cookie cookies consent notice popup modal overlay share sharing social related recommended form "
           "login signup subscribe newsletter breadcrumb breadcrumbs widget toolbar pagination pager tags copyright legal "
           "search skip disqus".split())
TOWARDS = set("article main content post entry story text body page".split())

TAG_GROUPS = ["nav", "header", "footer", "aside", "article", "main", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "a",
              "div section", "table tr td th", "span b i em strong"]
TAG_PLACE = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags.split()}
N_FEATURES = len(TAG_GROUPS) + 16


class Page:
    """A page as a tree in document order: parents come before children."""

    def __init__(self, html: str | None):
        self.tags, self.parents, self.tokens = ["html"], [-1], [frozenset()]
        self.flow: list[tuple[int, str]] = []  # (element, text) in page order; a block's start and end break the text
        stack, html, at = [0], html or "", 0
        for m in _MARKUP.finditer(html):
            if m.start() > at:
                self.flow.append((stack[-1], html[at:m.start()]))
            at = m.end()
            tag = m.group(3)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(2):
                self._close(stack, tag)
            elif tag == "br":
                self.flow.append((stack[-1], " "))
            elif tag in ("html", "body") and tag in (self.tags[k] for k in stack):
                continue
            else:
                self._open(stack, tag, m.group(4) or "")
        if at < len(html):
            self.flow.append((stack[-1], html[at:]))

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag == "body":
            del stack[1:]
        elif tag in BLOCKS:
            self._end_paragraph(stack)
        if tag in SAME_KIND:
            stops = SAME_KIND[tag].split()
            for place in range(len(stack) - 1, 0, -1):
                if self.tags[stack[place]] in stops:
                    break
                if self.tags[stack[place]] == tag or {tag, self.tags[stack[place]]} in ({"dt", "dd"}, {"td", "th"}):
                    del stack[place:]
                    break
        self.tags.append(tag)
        self.parents.append(stack[-1])
        found = [x for m in _NAMES.finditer(attributes) for x in _TOKEN.findall((m[1] or m[2] or m[3] or "").lower())]
        self.tokens.append(frozenset(found))
        if tag in BLOCKS:
            self.flow.append((len(self.tags) - 1, ""))
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(len(self.tags) - 1)

    def _end_paragraph(self, stack: list[int]) -> None:
        for place in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[place]]
            if tag == "p":
                del stack[place:]
                self.flow.append((stack[-1], ""))
                return
            if tag in BLOCKS:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for place in range(len(stack) - 1, 0, -1):
            here = self.tags[stack[place]]
            if here == tag:
                del stack[place:]
                if tag in BLOCKS:
                    self.flow.append((stack[-1], ""))
                return
            if here in BLOCKS and tag not in BLOCKS:
                return

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parent = np.array(self.parents)
        own, linked, points = np.zeros(n), np.zeros(n), np.zeros(n)
        begins = np.full(n, -1.0)
        away, towards = np.zeros(n), np.zeros(n)
        above_away, above_towards, depth, in_link = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        place, count = np.zeros(n), np.zeros(n)
        same: dict[tuple[int, str], int] = {}
        for k in range(n):
            cues = self.tokens[k] | {self.tags[k]}
            away[k], towards[k] = bool(cues & AWAY), bool(cues & TOWARDS and self.tags[k] != "body")
            if k:
                p = self.parents[k]
                above_away[k], above_towards[k] = max(above_away[p], away[p]), max(above_towards[p], towards[p])
                depth[k], in_link[k] = depth[p] + 1, in_link[p]
                place[k] = count[p]
                count[p] += 1
                same[p, self.tags[k]] = same.get((p, self.tags[k]), 0) + 1
            in_link[k] |= self.tags[k] == "a"
        so_far = 0
        for k, text in self.flow:
            size = len(text.strip())
            if begins[k] < 0:
                begins[k] = so_far
            if self.tags[k] not in NEVER:
                own[k] += size
                points[k] += text.count(".") + text.count(",")
                if in_link[k]:
                    linked[k] += size
                so_far += size
        total, links, dots, tags = own.copy(), linked.copy(), points.copy(), np.ones(n)
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            total[p] += total[k]
            links[p] += links[k]
            dots[p] += dots[k]
            tags[p] += tags[k]
            if begins[p] < 0 or 0 <= begins[k] < begins[p]:
                begins[p] = begins[k]
        out = np.zeros((n, N_FEATURES))
        for k, tag in enumerate(self.tags):
            if tag in TAG_PLACE:
                out[k, TAG_PLACE[tag]] = 1
        at, up = len(TAG_GROUPS), np.maximum(parent, 0)
        density = total / tags
        columns = [away, towards, above_away, above_towards, depth, place, count[up],
                   np.array([same.get((p, t), 1) for p, t in zip(self.parents, self.tags)]) / np.maximum(count[up], 1),
                   np.log1p(total), np.log1p(tags), np.log1p(density), np.log1p(density[up]), links / np.maximum(total, 1),
                   dots / np.maximum(total, 1), total / max(1.0, total[0]), np.maximum(begins, 0) / max(1.0, total[0])]
        for k, column in enumerate(columns):
            out[:, at + k] = column
        self.own = own
        return out

    def kept(self, scores: np.ndarray) -> np.ndarray:
        """Which elements' own text stays, for the best consistent choice.

        Blocks decide: an element inside a line shares the fate of the block around it,
        whose text its words are part of.
        """
        n = len(self.tags)
        block, never = np.zeros(n, int), np.zeros(n, bool)
        own_text = self.own > 0
        for k in range(1, n):
            up = self.parents[k]
            never[k] = never[up] or self.tags[k] in NEVER
            block[k] = k if self.tags[k] in BLOCKS or self.tags[k] in NEVER else block[up]
            if block[k] != k and own_text[k]:
                own_text[block[k]] = True
        above = [block[self.parents[k]] if k else -1 for k in range(n)]
        keep, children, best = scores.astype(float).copy(), np.zeros(n), np.zeros(n)
        own = np.where(own_text, np.maximum(scores, 0), 0.0)
        for k in range(n - 1, -1, -1):
            if block[k] != k:
                continue
            split = own[k] + children[k]
            if never[k]:
                keep[k] = split = 0.0
            best[k] = max(keep[k], 0.0, split)
            if k:
                keep[above[k]] += keep[k]
                children[above[k]] += best[k]
        state = np.zeros(n, np.int8)  # 1 keep, -1 drop, 0 left to the children
        for k in range(n):
            if block[k] != k:
                continue
            over = state[above[k]] if k else 0
            if never[k]:
                state[k] = -1
            elif over:
                state[k] = over
            elif keep[k] >= best[k] and keep[k] > 0:
                state[k] = 1
            elif best[k] <= 0:
                state[k] = -1
        stays = (state == 1) | ((state == 0) & (scores > 0))
        return stays[block]

    def text(self, kept: np.ndarray) -> str:
        blocks, parts = [], []
        for k, text in [*self.flow, (0, "")]:
            if text:
                if kept[k]:
                    parts.append(text)
                continue
            block = " ".join(html_entities.unescape("".join(parts)).split())
            if block:
                blocks.append(block)
            parts = []
        return "\n\n".join(blocks)


class Trees:
    """A fitted model as arrays, evaluated for all nodes at once."""

    def __init__(self, trees: list[tuple[float, dict]]):
        self.trees = trees

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return cue_scores(x)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(tree["depth"]):
                feature = tree["feature"][at]
                right = x[rows, np.maximum(feature, 0)] > tree["threshold"][at]
                at = np.where(feature < 0, at, np.where(right, tree["right"][at], tree["left"][at]))
            total += weight * tree["value"][at]
        return 2 * total


def cue_scores(x: np.ndarray) -> np.ndarray:
    """The fixed rule for corpora without marked pages."""
    at = len(TAG_GROUPS)
    cues = x[:, at] + x[:, at + 2] > 0
    dense = x[:, at + 10] > np.log1p(20)
    return np.where(cues, -2.0, np.where(x[:, at + 12] > 0.5, -1.0, np.where(dense, 1.0, -0.2)))


def main_text(html: str | None, model: Trees) -> str:
    page = Page(html)
    return page.text(page.kept(model.scores(page.features())))


# ------------------------------------------------------------------ training

_MARKED = re.compile(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_MARKED_SQL = r"(?isU)<(article|main)\b[^>]*>(.*?)</\1\s*>"  # the same pattern for Spark
_BODY = re.compile(r"<body\b[^>]*>", re.I)


def variants(html: str, seed: int) -> list[tuple[str, str]]:
    """The page as it is, and varied forms of it; each with the tag name that now marks the main text."""
    marked = _MARKED.findall(html)
    if len(marked) != 1:
        return []
    tag, inside = marked[0][0].lower(), marked[0][1]
    rng = random.Random(seed)
    words = re.sub(r"<[^>]*>|&\w*;?", " ", inside).split() or ["text"]
    pick = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b)))
    named = lambda *names: rng.choice([f'<div class="{rng.choice(names)}">', f'<div id="{rng.choice(names)}">',
                                       f'<section class="{rng.choice(names)}">'])
    links = lambda n: "<ul>" + "".join(f'<li><a href="#">{pick(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def closed(start: str, content: str) -> str:
        return f"{start}{content}</{re.match(r'<(\w+)', start)[1]}>"

    extras = [
        lambda: closed(rng.choice(["<aside>", named("sidebar", "widget")]), f"<h3>{pick(1, 3)}</h3>" + links(rng.randint(2, 6))),
        lambda: closed(named("comments", "comment-list"), f"<h3>{pick(1, 2)}</h3>" + "".join(
            f'<div class="comment"><p>{pick(4, 40)}</p></div>' for _ in range(rng.randint(1, 5)))),
        lambda: closed(named("cookie-notice", "consent", "notice"), f"<p>{pick(5, 25)}</p>"),
        lambda: closed(named("ad", "ads", "banner", "promo"), f"<p>{pick(3, 20)}</p>"),
        lambda: f'<form action="#"><p>{pick(2, 8)}</p><input name="q"></form>',
        lambda: closed(rng.choice(["<header>", named("header", "menu")]), f"<p>{pick(1, 6)}</p>" + links(rng.randint(2, 5))),
        lambda: closed(rng.choice(["<footer>", named("footer", "copyright")]), f"<p>{pick(3, 20)}</p>"),
        lambda: closed(named("related", "share"), links(rng.randint(2, 5))),
    ]
    out = [(html, tag)]
    for masked in (False, True):
        bare, before, after = _MARKED.split(html)[0], [], []
        for extra in extras:
            if rng.random() < 0.5:
                (before if rng.random() < 0.4 else after).append(extra())
        content = inside
        if rng.random() < 0.5:  # boilerplate inside the text's own element
            cut = content.find("<p>", len(content) // 2)
            if cut > 0:
                content = content[:cut] + rng.choice(extras[2:4])() + content[cut:]
        head = _BODY.split(bare)
        body = head[1] if len(head) > 1 else ""
        tail = html[html.lower().rfind(f"</{tag}") :]
        tail = tail[tail.find(">") + 1:]
        mark = "x-main" if masked else tag
        page = f"{head[0]}<body>{body}{''.join(before)}<{mark}>{content}</{mark}>{''.join(after)}{tail}"
        if masked:
            for name in ("nav", "footer", "header", "aside"):
                page = re.sub(rf"<(/?){name}\b", r"<\1div", page)
        out.append((page, mark))
    return out


def labelled_nodes(html: str, seed: int) -> Iterator[tuple[np.ndarray, float]]:
    """Features and labels of all elements of a marked page and its variants."""
    for varied, mark in variants(html, seed):
        page = Page(varied)
        tags = page.tags
        page.tags = ["div" if tag == "x-main" else tag for tag in tags]
        x = page.features()
        inside = np.zeros(len(tags), bool)
        dropped = np.zeros(len(tags), bool)
        for k in range(1, len(tags)):
            p = page.parents[k]
            inside[k] = inside[p] or tags[k] == mark
            away = page.tokens[k] & AWAY or tags[k] in NEVER
            dropped[k] = dropped[p] or bool(inside[k] and away)
        for k in range(len(tags)):
            if tags[k] not in ("html", "head", "body", "meta", "link"):
                yield x[k], float(inside[k] and not dropped[k])


def marked_pages(pages: DataFrame, bound: int = SAMPLE_PAGES) -> DataFrame:
    """``html``: at most ``bound`` distinct pages that mark exactly one element, those of the smallest hashes, in that order.

    Hashes are settled first, so that only the picked pages are shuffled.
    """
    html = pages.select(F.col("html").cast("string").alias("html")).withColumn("mark", F.xxhash64("html"))
    marked = F.regexp_count("html", F.lit(_MARKED_SQL)) == 1
    marks = [r.mark for r in html.filter(marked).select("mark").distinct().orderBy("mark").limit(bound).collect()]
    last = marks[-1] if marks else None
    picked = html.filter(F.col("mark") <= F.lit(last).cast("long")).filter(marked).groupBy("mark").agg(F.min("html").alias("html"))
    return picked.repartition(1).sortWithinPartitions("mark").select("html")


def fit(pages: DataFrame) -> Trees:
    """Fit the model on a bounded sample of the marked pages."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    picked = marked_pages(pages)

    def nodes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            for text in frame.column(0):
                rows = list(labelled_nodes(text.as_py(), len(text.as_py())))
                if rows:
                    yield pa.record_batch([pa.array([x.tolist() for x, _ in rows], pa.list_(pa.float64())),
                                           pa.array([y for _, y in rows], pa.float64())], names=["x", "label"])

    table = written(picked.mapInArrow(nodes, "x array<double>, label double"), "dom-nodes")
    if table.select("label").distinct().count() < 2:
        return Trees([])
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(
        table.select(array_to_vector("x").alias("features"), "label"))
    return exported(model)


def exported(model) -> Trees:
    """The trees of a fitted model as arrays: at most ``TREES`` trees of ``2 ** (DEPTH + 1)`` nodes."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = working_path(spark, "dom-model")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees = []
    for k, weight in enumerate(model.treeWeights):
        own = {r["id"]: r for r in rows if r["treeID"] == k}
        order = sorted(own)
        at = {key: j for j, key in enumerate(order)}
        leaf = [own[key]["leftChild"] < 0 for key in order]
        split = [own[key]["split"] for key in order]
        trees.append((weight, {
            "feature": np.array([-1 if last else s["featureIndex"] for last, s in zip(leaf, split)]),
            "threshold": np.array([0.0 if last else s["leftCategoriesOrThreshold"][0] for last, s in zip(leaf, split)]),
            "left": np.array([0 if last else at[own[key]["leftChild"]] for last, key in zip(leaf, order)]),
            "right": np.array([0 if last else at[own[key]["rightChild"]] for last, key in zip(leaf, order)]),
            "value": np.array([own[key]["prediction"] for key in order]), "depth": DEPTH}))
    return Trees(trees)


def extracted(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``."""
    model = model or fit(pages)

    def extract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            texts = [main_text(x.as_py(), model) for x in frame.column(2)]
            yield pa.record_batch([frame.column(0), frame.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
