"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the log-odds that it is article text, by what its block is: the
elements around it, the words of their class, id and role, the share of linked words, the length, how sentences end, and
words that are common in notices. A tag scores below zero, by its name. All weights are fitted to labelled pages. One
linear scan finds the contiguous region with the greatest sum; if one element below the page's body holds the region,
the region is that element's content. Of the region's blocks those that score below zero (an advert between two
paragraphs) are left out, all others are the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import read, with_columns

#: The elements that the HTML standard shows as blocks, in alphabetical order (fixed values); all others run in a line.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content (fixed values).
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no markup; xmp's is shown as it is.
RAW = {name: re.compile(rf"</{name}(?![a-z0-9:-])[^>]*>?", re.I) for name in ("script", "style", "template", "textarea", "iframe", "xmp")}
#: Blocks end an open paragraph; an item ends an open item of its own list, and so on: what is ended, and what ends the search for it.
ENDS = {name: (("p",), ("button", "caption", "object", "table", "td", "th")) for name in BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}}
AFTER = {
    "li": (("li",), ("ol", "ul", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("optgroup",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot"), ("table",))),
}
OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
NAME = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
#: A tag in which values may be quoted and hold any sign, and one that ends at the next ``<`` or ``>``.
QUOTED_TAG = re.compile(rf"""{NAME}((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
TAG = re.compile(rf"{OTHER}{NAME}([^<>]*)(?:>|(?=<)|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z]+")
#: Elements that are features by their name.
TELLING = BLOCKS - {"html", "body", "div", "hr", "tbody", "thead", "tfoot", "tr", "frameset", "center"} | {"a", "button", "label", "time", "math", "svg", "code"}


def features_of(name: str, attributes: str) -> tuple[str, ...]:
    """What an element is by its name and its attributes."""
    out = [name] if name in TELLING else []
    if "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role") and name not in ("html", "body"):
                out += ["." + w for w in WORD.findall(value)]
            elif (key == "style" and "display:none" in value.replace(" ", "")) or (key == "aria-hidden" and value == "true"):
                out.append("hidden")
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
            out.append("hidden")
    return tuple(out)


class Page:
    """Tokens in order: ``kind`` is a tag's name, "" for text, "\\n" for the end of a block; ``text`` is the decoded text,
    ``context`` the features around it, ``element`` the number of the innermost element."""

    def __init__(self, html: str):
        self.kind: list[str] = []
        self.text: list[str] = []
        self.context: list[frozenset[str]] = []
        self.element: list[int] = []
        self.parent, self.name, self.begin, self.end = [-1], [""], [0], [0]  # of each element; 0 holds all
        self.has_main = False
        self._read(html)

    def _add(self, kind: str, text: str, context: frozenset[str], element: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.context.append(context)
        self.element.append(element)

    def _read(self, html: str) -> None:
        none: frozenset[str] = frozenset()
        stack: list[tuple[str, int, frozenset[str]]] = []
        places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are open
        known: dict[tuple[frozenset[str], str, str], frozenset[str]] = {}
        at, n, quotes = 0, len(html), True
        context, element = none, 0

        def shut(to: int) -> None:
            while len(stack) > to:
                name, number, _ = stack.pop()
                places[name].pop()
                self.end[number] = len(self.kind)

        while at < n:
            m = TAG.search(html, at)
            stop = m.start() if m else n
            if stop > at:
                self._add("", unescape(html[at:stop]), context, element)
            if not m:
                break
            if m[2] and quotes and "=" in m[3] and ('"' in m[3] or "'" in m[3]):
                whole = QUOTED_TAG.match(html, stop)
                quotes = whole is not None  # a value that is never closed: from here on quotes are plain signs
                m = whole or m
            at = m.end()
            if not m[2]:
                continue
            name, attributes = m[2].lower(), m[3]
            block = name in BLOCKS
            self._add(name, "", none, element)
            if block:
                self._add("\n", "", none, element)
            if m[1]:
                if places[name]:
                    shut(places[name][-1])
                    context, element = (stack[-1][2], stack[-1][1]) if stack else (none, 0)
                continue
            if name in RAW:
                end = RAW[name].search(html, at)
                if name == "xmp":
                    self._add("", html[at : end.start() if end else n], context, element)
                at = end.end() if end else n
                continue
            for ended, within in filter(None, (ENDS.get(name), AFTER.get(name))):
                last = max((places[x][-1] for x in ended if places[x]), default=-1)
                if last > max((places[x][-1] for x in within if places[x]), default=-1):
                    shut(last)
            if name == "body":
                shut(0)
            context, element = (stack[-1][2], stack[-1][1]) if stack else (none, 0)
            if name in VOID or attributes.endswith("/"):
                continue
            key = (context, name, attributes)
            if key not in known:
                own = features_of(name, attributes)
                inside = "in" in context
                more = {*own, *(f"in {f}" for f in own)} if inside else set(own)
                if inside and any(f[0] == "." for f in own):
                    more.add("in box")
                if name in ("article", "main") or ".main" in own and "role" in attributes:
                    more.add("in")
                known[key] = context | more
            context = known[key]
            self.has_main |= name in ("article", "main")
            self.parent.append(element)
            self.name.append(name)
            self.begin.append(len(self.kind))
            self.end.append(-1)
            element = len(self.parent) - 1
            places[name].append(len(stack))
            stack.append((name, element, context))
        shut(0)
        self._add("\n", "", none, 0)
        self.end[0] = len(self.kind)

    def blocks(self):
        """The text tokens of each block that has words, and all of its words."""
        own: list[int] = []
        for i, kind in enumerate(self.kind):
            if kind == "":
                own.append(i)
            elif kind == "\n" and own:
                words = "".join([self.text[j] for j in own]).split()
                if words:
                    yield own, words
                own = []

    def features(self, own: list[int], words: list[str]) -> tuple[frozenset[str], list[tuple[str, float]]]:
        """Of a block: what stands around its first word, and what it is by itself."""
        first = next(i for i in own if self.text[i] and not self.text[i].isspace())
        linked = sum(len(self.text[i].split()) for i in own if "a" in self.context[i] or "in a" in self.context[i])
        n = len(words)
        share = linked / n
        more = [("bias", 1.0), ("linked", share), ("all linked", float(share > 0.9)), ("long", min(1.0, n / 40)), ("sentence", float(words[-1][-1] in ".!?…。:;\"”»"))]
        if "in box" in self.context[first]:  # a named part of an article: that it reads like one tells less
            more += [(f"{f} in box", x) for f, x in more[3:5]]
        if self.has_main and "in" not in self.context[first]:
            more.append(("outside", 1.0))
        return self.context[first] - {"a", "in a"}, more


def labelled_pages(pages: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    """(html, article text) of pages in many layouts: an article of paragraphs, lists, headings, quotes and tables, in
    article, main or plain containers, with menus, notices, adverts, forms and comments around it and some inside. Class
    words that boilerplate has are also given to parts of articles, where sites do so."""
    rng = np.random.default_rng(seed)
    stock = ["".join(rng.choice(list("aeioulmnrst"), size=rng.integers(2, 9))) for _ in range(400)]
    stock += 6 * "a about also and by for in is it like more most now of on or our shop that the this to top up us use we with x you your".split()
    pick = lambda *xs: xs[rng.integers(len(xs))]
    maybe = lambda p, x: x if rng.random() < p else ""

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(stock, size=rng.integers(a, b)))

    def sentence(a: int, b: int) -> str:
        return words(a, b) + pick(".", ".", ".", "!", "?", "")

    def links(k: int) -> str:
        item = lambda i: f'<a href="/{i}">{words(1, 4)}</a>'
        return pick(f"<ul>{''.join(f'<li>{item(i)}</li>' for i in range(k))}</ul>", " | ".join(item(i) for i in range(k)), "".join(f"<div>{item(i)}</div>" for i in range(k)))

    said = {
        "comment": ("Leave a reply", "Leave a comment", "Post a comment", "Your email address will not be published", "3 comments", "Reply", "Log in to reply"),
        "footer": ("All rights reserved", "© 2020 Foo Inc. All rights reserved", "Copyright 2019", "Privacy policy", "Terms of use", "Contact us", "About us", "Powered by X"),
        "notice": ("We use cookies to improve your experience", "This site uses cookies", "Accept all cookies", "Please enable JavaScript", "You need to log in", "Skip to content"),
        "advert": ("Advertisement", "Sponsored", "Buy now", "Special offer", "Shop now and save"),
        "form": ("Search", "Subscribe to our newsletter", "Sign up", "Log in", "Your email", "Send"),
        "share": ("Share this", "Share on X", "Tweet", "Follow us", "Like"),
        "related": ("Related posts", "You may also like", "Read more", "Most popular", "Trending", "Recommended for you"),
    }
    names = {
        "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination topbar toolbar tabs", "header": "header masthead banner site-header top", "footer": "footer site-footer copyright legal bottom",
        "sidebar": "sidebar side rail widget secondary complementary", "notice": "cookie-notice cookie cookies consent notice popup modal overlay alert gdpr-banner", "advert": "ad ads advert advertisement ad-slot sponsored sponsor promo banner-ad",
        "form": "search search-form newsletter subscribe signup login", "comment": "comments comment comment-list reply respond replies disqus-thread discussion", "share": "share sharing social social-share follow-us",
        "related": "related related-posts more recommended trending popular tags tag-list",
    }
    neutral = "wrapper container row col inner box block section text entry-text body-copy wide clearfix x y grid card".split()

    def plain_box(inside: str) -> str:
        return pick(inside, inside, f'<div class="{pick(*neutral)}">{inside}</div>')

    def attribute(kind: str) -> str:
        return f'{pick("class", "class", "class", "id")}="{maybe(0.3, pick(*neutral) + " ")}{pick(*names[kind].split())}{maybe(0.25, "-" + pick("content", "box", "wrapper", "block", "text"))}"'

    def clutter(inside: bool = False) -> str:
        kind = pick("advert", "advert", "share", "related", "comment", "form", "notice") if inside else pick("menu", "menu", "header", "footer", "footer", "sidebar", "notice", "advert", "form", "comment", "share", "related")
        phrase = pick(*said[kind]) if kind in said else words(1, 4)
        body = pick(sentence(3, 30), links(rng.integers(2, 7)), f"<p>{sentence(4, 50)}</p>", f"<p>{sentence(8, 30)} {sentence(8, 50)}</p>", f"<p>{phrase}</p>", phrase, f"<h3>{phrase}</h3>{links(4)}", f"{phrase} {words(1, 8)}", f"<h4>{phrase}</h4><p>{sentence(3, 20)}</p>")
        element = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "advert": "aside", "related": "aside", "notice": "dialog"}.get(kind)
        if kind == "comment":
            body = "".join(f"<div class=comment><b>{words(1, 3)}</b><p>{sentence(3, 60)}</p></div>" for _ in range(rng.integers(1, 5)))
            body = pick(f"<h3>{pick(*said['comment'])}</h3>{body}", body, f"<ol><li><p>{sentence(4, 50)}</p></li></ol>", f"<p>{pick(*said['comment'])}: {words(1, 6)}</p>")
        if kind == "form":
            choice = f"<select name=s>{''.join(f'<option>{words(1, 3)}' for _ in range(rng.integers(1, 4)))}</select>"
            body = pick(f"<label>{phrase}</label><input name=q><button>{words(1, 2)}</button>", f"{phrase} {choice}", choice, f"<fieldset><legend>{phrase}</legend>{choice}<button>{words(1, 2)}</button></fieldset>")
            if rng.random() < 0.3:
                return choice
        if kind == "notice" and rng.random() < 0.2:
            return f"<noscript>{phrase}</noscript>"
        if rng.random() < 0.12:
            return f"<div>{phrase}: {words(1, 6)}</div>" if kind in said else f"<div>{links(4)}</div>"
        if element and rng.random() < (0.25 if kind == "advert" else 0.5):
            return f"<{element}{maybe(0.3, ' ' + attribute(kind))}>{body}</{element}>"
        return plain_box(f"<{pick('div', 'div', 'section')} {attribute(kind)}>{body}</div>") if rng.random() < 0.9 else f'<div role="{pick("navigation", "complementary", "banner", "contentinfo", "search")}">{body}</div>'

    def inline(text: str) -> str:
        out = text.split(" ")
        if len(out) > 5 and rng.random() < 0.35:
            i = rng.integers(len(out) - 1)
            out[i] = pick(f'<a href="/x">{out[i]}</a>', f"<b>{out[i]}</b>", f"<em>{out[i]}</em>", f"<code>{out[i]}</code>", f"<math><mi>{out[i]}</mi></math>", f"<span class=x>{out[i]}</span>")
        return " ".join(out)

    def part() -> tuple[str, list[str]]:
        kind = pick("p", "p", "p", "p", "p", "list", "heading", "quote", "table", "pre", "section", "bare", "one link")
        text = sentence(1, 60)
        if kind == "list":
            items = [sentence(1, 20) for _ in range(rng.integers(1, 6))]
            return f"<{(e := pick('ul', 'ul', 'ol'))}>" + "".join(f"<li>{maybe(0.2, '<p>')}{inline(x)}" + maybe(0.5, "</li>") for x in items) + f"</{e}>", items
        if kind == "heading":
            head = words(1, 8)
            return f"<h{(k := rng.integers(2, 5))}>{head}</h{k}>", [head]
        if kind == "table":
            cells = [[words(1, 4) for _ in range(2)] for _ in range(rng.integers(1, 4))]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in cells) + "</table>", [x for row in cells for x in row]
        if kind == "section":  # words that boilerplate has as well
            other = sentence(1, 40)
            name = pick("discussion", "legal", "more", "social-policy", "tags-content", "popular-methods", "side-effects", "follow-up", "top", "header-text", "related-work", "search-results", "text-body", "section", "alert-systems", "reply-letter", "bottom-line", *neutral)
            return f'<{(e := pick("div", "section"))} {pick("class", "id")}="{name}"><p>{inline(text)}</p><p>{inline(other)}</p></{e}>', [text, other]
        if kind == "bare":
            return f"<div>{inline(text)}</div>", [text]
        if kind == "one link":
            return f'<p><a href="/y">{text}</a></p>', [text]
        if kind == "quote":
            return f"<blockquote><p>{inline(text)}</p></blockquote>", [text]
        return (f"<pre>{text}</pre>" if kind == "pre" else f"<p>{inline(text)}</p>"), [text]

    out = []
    for _ in range(pages):
        tag = pick("article", "article", "article", "main", "div", "div")
        title = words(2, 9)
        parts, texts = [f"<h1>{title}</h1>"], [title]
        if tag != "div" and rng.random() < 0.3:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.integers(1, 12)):
            html, lines = part()
            parts.append(html)
            texts += lines
            if rng.random() < 0.12:
                parts.append(clutter(inside=True))
        holder = maybe(0.5, ' class="' + pick("article", "content", "post", "entry-content", "story-body", "main", "prose") + '"') if tag != "div" else ' class="' + pick("article", "content", "post", "entry-content", "story-body", "main-content", "x", "prose") + '"'
        before, after = ("".join(clutter() for _ in range(rng.integers(0, 4))) for _ in range(2))
        inner = f"<{tag}{holder}>{''.join(parts)}</{tag}>"
        out.append((f"<html><head><title>{title}</title></head><body>{plain_box(before)}{plain_box(inner)}{plain_box(after)}</body></html>", "\n".join(texts)))
    return out


class Weights:
    """Log-odds of a word by the features of its block, and the score of each tag name."""

    def __init__(self, of: dict[str, float], cues: dict[str, float], tags: dict[str, float], other_tag: float):
        self.of, self.cues, self.tags, self.other_tag = of, cues, tags, other_tag
        self.seen = frozenset(cues)
        self.known: dict[frozenset[str], float] = {}

    def block(self, context: frozenset[str], more: list[tuple[str, float]], words: list[str]) -> float:
        if context not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[context] = sum(self.of.get(f, 0.0) for f in context)
        out = self.known[context] + sum(self.of[f] * x for f, x in more)
        found = self.seen.intersection(map(str.lower, words))
        return out + sum(self.cues[w] for w in found) / len(words) ** 0.5 if found else out


def fit(rows: list[dict[str, float]], good: np.ndarray, weight: np.ndarray, rounds: int = 25, penalty: float = 0.25) -> dict[str, float]:
    """Logistic regression with a quadratic penalty, by Newton steps."""
    names = sorted({f for r in rows for f in r})
    number = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for f, value in r.items():
            x[i, number[f]] = value
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(names))
        step = np.linalg.solve(curve, x.T @ (weight * (good - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


@cache
def fitted() -> Weights:
    """Weights of block features and of cue words ("is this word of the article?"), and for each tag name how often it
    stands outside of the article, all from the labelled pages."""
    pages = [(Page(html), text.split("\n")) for html, text in labelled_pages()]
    rows, good, weight, boiler, inside, seen = [], [], [], defaultdict(int), defaultdict(int), defaultdict(int)
    for page, lines in pages:
        left, first, last = iter(lines), None, None
        line = next(left)
        for own, words in page.blocks():
            context, more = page.features(own, words)
            match = " ".join(words) == line and "head" not in context and "title" not in context
            if match:
                first, last, line = own[0] if first is None else first, own[-1], next(left, None)
            rows.append((dict.fromkeys(context, 1.0) | dict(more), [w.lower() for w in words]))
            good.append(match)
            weight.append(1 + np.log(len(words)))
            if not match:
                for w in set(rows[-1][1]):
                    boiler[w] += 1
        assert line is None, "a labelled page has its article's blocks in order"
        for i, kind in enumerate(page.kind):
            if kind not in ("", "\n"):
                seen[kind] += 1
                inside[kind] += first <= i <= last
    content = defaultdict(int)
    for (_, words), match in zip(rows, good, strict=True):
        for w in set(words) if match else ():
            content[w] += 1
    cues = {w for w, n in boiler.items() if n >= 5 and not content[w]}  # words of notices, not of the common stock
    full = [x | {f"word {w}": len(words) ** -0.5 for w in cues.intersection(words)} for x, words in rows]
    of = fit(full, np.array(good, dtype=float), np.array(weight))
    tags = {name: -0.02 - 0.2 * (1 - inside[name] / n) for name, n in seen.items()}
    return Weights({f: w for f, w in of.items() if not f.startswith("word ")}, {w: of[f"word {w}"] for w in cues}, tags, -0.1)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """Start and end of the contiguous part with the greatest sum, in one scan."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    least = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - least))
    return int(np.argmax(sums[: end + 1] == least[end])), end + 1


def extract_text(html: str, weights: Weights) -> str:
    """The article's blocks, joined by one line feed; empty if no word scores above zero."""
    page = Page(html)
    scores = np.array([weights.tags.get(k, weights.other_tag) if k not in ("", "\n") else 0.0 for k in page.kind])
    blocks = []
    for own, words in page.blocks():
        score = weights.block(*page.features(own, words), words)
        blocks.append((own, score))
        for i in own:
            scores[i] = score * len(page.text[i].split())
    if not len(scores) or scores.max() <= 0:
        return ""
    start, end = best_region(scores)
    own = [i for i in range(start, end) if page.kind[i] == ""]
    holds, last = page.element[own[0]], own[-1]
    while holds and page.end[holds] <= last:
        holds = page.parent[holds]
    while holds and page.name[holds] not in BLOCKS:
        holds = page.parent[holds]
    if holds and page.name[holds] not in ("body", "html"):
        start, end = min(start, page.begin[holds]), max(end, page.end[holds])
    out = []
    for own, score in blocks:
        if score > 0 and start <= own[0] and own[-1] < end:
            text, before = [], own[0]
            for i in own:
                text += [" "] * ("br" in page.kind[before:i]) + [page.text[i]]
                before = i
            out.append(" ".join("".join(text).split()))
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page, from the whole html; no shuffle.

    A null or empty html, or one without article words, gives an empty text. Character references are decoded, white
    space inside a block becomes one space, blocks are joined by one line feed; markup that is cut off or not closed is read as
    far as it goes. An empty table gives no rows; repeated rows and null ids give a row each. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fitted())

    def run(batches):
        weights = shared.value
        for batch in batches:
            text = [extract_text(raw.decode("utf-8", "replace"), weights) if raw else "" for raw in batch.column("html").to_pylist()]
            yield with_columns(batch, ["page_id", "url"], text=pa.array(text, pa.string()), n_chars=pa.array([len(t) for t in text], pa.int64()))

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
