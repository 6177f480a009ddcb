"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks, the text between two block-level tags, in page
order.  Each block has features of its ancestors (tags, words of their class,
id and role), of its text (length, share of link text, punctuation) and of its
neighbours.  A linear-chain conditional random field with the labels article and
rest, trained on labelled pages, is decoded by Viterbi, and the article blocks
are joined.

The labelled pages are made by ``labelled_pages``: pages of many layouts, with
and without semantic tags, whose article blocks are known.  Training maximises
the conditional likelihood by stochastic gradients from forward-backward; its
seed is fixed, so that every run gets the same weights.  The weights, some
hundred numbers, travel with the tasks; pages are read once, without a shuffle.

Defined results: a null or empty page, or one without article blocks, has an
empty text; markup may be cut off or unbalanced anywhere; white space of a block
becomes one space, blocks are joined by two line feeds; repeated rows get equal
results; a null id or url is passed through; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements whose content is no text of the page: to the first end tag, or to the end tag that balances the start.
RAW_FIRST = frozenset("script style iframe textarea title".split())
RAW_NESTED = frozenset("noscript template svg object select canvas audio video".split())
#: Start tags that end an open element of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PLAIN = frozenset(["html", "body", "div", "span", "tbody"])

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^"'>])*|[^>]*)>|<(?=[a-z/!?])[^>]*\Z""",
    re.S | re.I,
)
_SKIPPED = r"<!--.*?(?:-->|\Z)|<(?P<skip>script|style)(?=[\s/>]).*?(?:</(?P=skip)(?=[\s/>])|\Z)"
_RAW_TAG = {
    tag: re.compile(rf"""{_SKIPPED}|<(?P<end>/?){tag}(?=[\s/>])(?:(?:"[^"]*"|'[^']*'|[^"'>])*|[^>]*)>""", re.S | re.I) for tag in RAW_NESTED
}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW_FIRST}
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")


def _names(rest: str) -> list[str]:
    """Features of a tag's class, id and role."""
    out = []
    for kind, a, b, c in _NAMES.findall(rest):
        value, kind = (a or b or c).lower(), kind.lower()
        if kind in ("hidden", "aria-hidden") and value != "false" or kind == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
        elif kind != "style":
            out += [f"c:{w}" for w in _WORD.findall(value)]
    return out


def _raw_ends(page: str):
    """A function (tag, start, end of the start tag) -> where the raw element ends; each tag's ends are looked for once.

    Where the end tag is missing, script and style take the rest of the page;
    the others are empty.
    """
    nested: dict[str, dict[int, int]] = {}
    missing: set[str] = set()

    def ends(tag: str, start: int, end: int) -> int:
        if tag in RAW_FIRST:
            m = None if tag in missing else _RAW_END[tag].search(page, end)
            if m:
                return m.end()
            missing.add(tag)
            return len(page) if tag in ("script", "style") else end
        if tag not in nested:
            pairs, open_ = {}, []
            for m in _RAW_TAG[tag].finditer(page):
                if m["end"] is None:  # a comment or script
                    continue
                if not m["end"]:
                    if tag != "svg" or page[m.end() - 2] != "/":
                        open_.append(m.start())
                elif open_:
                    pairs[open_.pop()] = m.end()
            nested[tag] = pairs
        return nested[tag].get(start, end)

    return ends


class _Level:
    """An open block-level element: what its chain of ancestors weighs, and the inline elements open within it."""

    __slots__ = ("tag", "base", "inline", "total", "article")

    def __init__(self, tag: str, base, article: bool, zero) -> None:
        self.tag, self.base, self.article = tag, base, article
        self.inline: dict[str, list] = {}
        self.total = zero


def blocks(page: str, weights: dict[str, float] | None = None) -> list[tuple[str, list[str] | float]]:
    """(text, features) of the leaf blocks in page order; with ``weights`` (text, sum of the features' weights).

    An open element keeps the features, or their summed weights, of all its
    ancestors, so that a block costs the same at any depth.
    """
    if weights is None:
        zero, fold = [], list

        def less(total: list[str], value: list[str]) -> list[str]:
            rest = list(total)
            for f in value:
                rest.remove(f)
            return rest

    else:
        zero, get = 0.0, weights.get

        def fold(features: list[str]) -> float:
            return sum([get(f, 0.0) for f in features])

        def less(total: float, value: float) -> float:
            return total - value

    out: list[tuple] = []  # text, what the ancestors weigh, own features, feature of the size, within an article
    levels = [_Level("body", zero, False, zero)]
    known: dict[str, int] = {}  # how many elements of a tag are open
    text: list[str] = []
    linked = link_depth = at = 0
    semantic = False
    raw_ends = _raw_ends(page)

    def flush() -> None:
        nonlocal linked
        if text:
            own = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if own:
                level = levels[-1]
                size = f"n:{min(9, (own.count(' ') + 1).bit_length())}"
                features = [f"p:{level.tag}", size, f"l:{min(4, int(5 * linked / max(1, len(own))))}", "end:stop" if own[-1] in ".!?…\"”»" else "end:bare"]
                if "©" in own:
                    features.append("has:copyright")
                if " | " in own or "»" in own or "·" in own:
                    features.append("has:bar")
                out.append((own, level.base + level.total, features, size, level.article))
        linked = 0

    def close(k: int) -> None:
        for level in levels[k:]:
            known[level.tag] -= 1
        del levels[k:]

    while m := _MARKUP.search(page, at):
        a = m.start()
        if a > at:
            piece = page[at:a]
            text.append(piece)
            if link_depth:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if not m["end"] and (tag in RAW_FIRST or tag in RAW_NESTED):
            at = raw_ends(tag, a, at)
            continue
        if tag in INLINE:
            level = levels[-1]
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link_depth = 0 if m["end"] else 1
            elif tag not in VOID:
                if not m["end"]:
                    value = fold(_names(m["rest"])) if m["rest"] else zero
                    level.inline.setdefault(tag, []).append(value)
                    level.total = level.total + value
                elif level.inline.get(tag):
                    level.total = less(level.total, level.inline[tag].pop())
            continue
        flush()
        link_depth = 0
        if tag in VOID:
            continue
        if m["end"]:
            if known.get(tag):
                close(next(k for k in range(len(levels) - 1, 0, -1) if levels[k].tag == tag))
            continue
        over = ENDS.get(tag, ("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag != "p" else ("p",))
        for k in range(len(levels) - 1, 0, -1):
            if levels[k].tag in over:
                close(k)
                break
            if levels[k].tag != "p":
                break
        features = [] if tag in PLAIN else [f"t:{tag}"]
        semantic = semantic or tag in ("article", "main")
        if m["rest"]:
            features += _names(m["rest"])
        above = levels[-1]
        levels.append(_Level(tag, above.base + above.total + fold(features), above.article or tag in ("article", "main"), zero))
        known[tag] = known.get(tag, 0) + 1
    if at < len(page):
        text.append(page[at:])
    flush()
    found = []
    for k, (own, base, features, _, article) in enumerate(out):
        if semantic:
            features.append("in:article" if article else "out:article")
        features.append(f"prev:{out[k - 1][3]}" if k else "prev:none")
        features.append(f"next:{out[k + 1][3]}" if k + 1 < len(out) else "next:none")
        found.append((own, base + fold(features)))
    return found


def viterbi(scores: list[float], change: tuple[float, float, float, float]) -> list[int]:
    """Best labels (1: article) of a chain; ``scores`` favour 1 over 0, ``change`` has the weights of 0-0, 0-1, 1-0 and 1-1."""
    s00, s01, s10, s11 = change
    zero, one = 0.0, scores[0] if scores else 0.0
    back = []
    for s in scores[1:]:
        back.append((zero + s00 < one + s10, zero + s01 < one + s11))
        zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + s
    label = int(one > zero)
    out = [label] if scores else []
    for b in reversed(back):
        label = int(b[label])
        out.append(label)
    return out[::-1]


def _marginals(scores: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(label 1) of each block and the expected number of each kind of step."""
    n = len(scores)
    emit = np.stack([np.zeros(n), scores], 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[0] = emit[0]
    for i in range(1, n):
        alpha[i] = emit[i] + np.logaddexp(alpha[i - 1, 0] + change[0], alpha[i - 1, 1] + change[1])
    for i in range(n - 2, -1, -1):
        step = change + emit[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(step[:, 0], step[:, 1])
    total = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
    steps = np.zeros((2, 2))
    for i in range(n - 1):
        steps += np.exp(alpha[i][:, None] + change + emit[i + 1] + beta[i + 1] - total)
    return np.exp(alpha[:, 1] + beta[:, 1] - total), steps


# Words of the layouts of training pages.
_GOOD = "article content main post entry story body text page news blog".split()
_BAD = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toolbar topbar tabs".split(),
    "header": "header masthead banner logo top branding site-header page-header".split(),
    "footer": "footer foot bottom copyright colophon legal site-footer".split(),
    "side": "sidebar aside side widget related recommended popular trending tags more".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad".split(),
    "notice": "notice cookie cookies consent gdpr alert newsletter subscribe signup popup modal overlay paywall message".split(),
    "comments": "comments comment replies reply respond discussion disqus commentlist responses".split(),
    "form": "form search login contact signup-form searchbox".split(),
    "share": "share social sharing follow buttons".split(),
}
_TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "aside", "ins"], "notice": ["div", "section"], "comments": ["section", "div"], "form": ["form"], "share": ["div", "ul"]}


def labelled_pages(n: int, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """Pages and the texts of their article blocks."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return words(a, b).capitalize() + r.choice("...!?")

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))

    def named(tag: str, names: list[str], body: str, always: bool = False) -> str:
        if tag in ("div", "ul", "ins", "section") or always or r.random() < 0.5:
            value = r.choice(names)
            if r.random() < 0.3:
                value += r.choice([" ", "-", "_"]) + r.choice(["box", "wrap", "item", "area", "1", "inner"])
            return f'<{tag} {r.choice(["class", "class", "id"])}="{value}">{body}</{tag}>'
        return f"<{tag}>{body}</{tag}>"

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"

    def boilerplate(kind: str) -> str:
        if kind == "menu":
            body = links()
        elif kind == "header":
            body = r.choice([f"<a href='/'>{words(1, 3)}</a>", f"<h1>{words(1, 3)}</h1><p>{words(2, 6)}</p>", f"<div>{words(1, 4)}</div>{links()}"])
        elif kind == "footer":
            body = r.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; 2020 {words(1, 3)}. {sentence(2, 6)}</p>{links()}", f"{words(1, 3)}.example - {paragraph()}"])
        elif kind == "side":
            body = f"<h3>{words(1, 3)}</h3>" + r.choice([links(), f"<p>{sentence()}</p>", f"<p><a href='/x'>{sentence()}</a></p>"])
        elif kind == "ad":
            body = r.choice([sentence(), f"<p>{sentence()}</p>", f"<a href='/buy'>{sentence()}</a>", paragraph()])
        elif kind == "notice":
            body = r.choice([sentence(), f"<p>{paragraph()}</p><button>{word()}</button>", f"<p>{sentence()} <a href='/p'>{words(1, 2)}</a></p>"])
        elif kind == "comments":
            body = f"<h3>{words(1, 3)}</h3>" + "".join(f"<{t} class='{c}'><b>{word()}</b><p>{paragraph()}</p></{t}>" for t, c in [(r.choice(["div", "li", "article"]), r.choice(["comment", "reply", "comment-body"]))] for _ in range(r.randint(1, 5)))
        elif kind == "form":
            body = f"<label>{words(1, 3)}</label><input><p>{sentence(2, 9)}</p><button>{word()}</button>"
        else:
            body = "".join(f"<a href='#'>{word()}</a> " for _ in range(r.randint(2, 5)))
        tag = r.choice(_TAGS[kind])
        return named(tag, _BAD[kind], body, always=kind not in ("menu", "header", "footer", "form"))

    for _ in range(n):
        article, body = set(), []

        def own(tag: str, text: str) -> None:
            article.add(" ".join(text.split()))  # noqa: B023
            style = r.random()
            if style < 0.1 and tag == "p":
                body.append(f"<p><b>{text}<br>")  # noqa: B023
            elif style < 0.2:
                body.append(f"<{tag}>{text}")  # noqa: B023
                if tag != "p":
                    body.append(f"</{tag}>")  # noqa: B023
            elif style < 0.3:
                k = text.find(" ")
                body.append(f"<{tag}>{text[:k]}<em>{text[k:]}</em></{tag}>" if k > 0 else f"<{tag}>{text}</{tag}>")  # noqa: B023
            else:
                body.append(f"<{tag}>{text}</{tag}>")  # noqa: B023

        own("h1", words(2, 12) if r.random() < 0.7 else sentence())
        for _ in range(r.choice([1, 2, 4, 7, 12])):
            x = r.random()
            if x < 0.75:
                own("p", paragraph())
            elif x < 0.83:
                own(r.choice(["h2", "h3"]), words(1, 6))
            elif x < 0.89:
                own("p", " | ".join(words(1, 2) for _ in range(r.randint(2, 12))))
            elif x < 0.93:
                own("blockquote", paragraph())
            elif x < 0.97:
                own("p", word().capitalize() + ".")
            else:
                body.append("<ul>")
                for _ in range(3):
                    own("li", sentence())
                body.append("</ul>")
            if r.random() < 0.08:
                body.append(boilerplate(r.choice(["ad", "share", "notice", "side"])))
        if r.random() < 0.2:
            body.append(boilerplate("comments"))
        shell = r.random()
        inner = "".join(body)
        if shell < 0.45:
            inner = f"<article>{inner}</article>" if r.random() < 0.6 else named("article", _GOOD, inner, True)
        elif shell < 0.6:
            inner = f"<main>{inner}</main>"
        elif shell < 0.92:
            inner = named("div", _GOOD, inner, True)
        else:
            inner = f"<div>{inner}</div>"
        before = [boilerplate(k) for k in ("header", "menu", "ad", "notice", "form", "side") if r.random() < 0.45]
        after = [boilerplate(k) for k in ("side", "share", "comments", "ad", "notice", "form", "footer") if r.random() < 0.45]
        yield "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(before) + inner + "".join(after) + "</body></html>", article


@cache
def train(pages: int = 700, rounds: int = 6, seed: int = 5) -> tuple[dict[str, float], tuple[float, float, float, float]]:
    """Weights of the features, in favour of the article, and of the four kinds of step."""
    data = []
    for page, article in labelled_pages(pages, seed):
        found = blocks(page)
        if found:
            data.append(([f for _, f in found], np.array([t in article for t, _ in found], int)))
    columns = {f: k for k, f in enumerate(sorted({f for x, _ in data for b in x for f in b}))}
    coded = [([np.array([columns[f] for f in b]) for b in x], y) for x, y in data]
    w, gw = np.zeros(len(columns)), np.full(len(columns), 1e-8)
    change, gc = np.zeros((2, 2)), np.full((2, 2), 1e-8)
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(coded)
        for x, y in coded:
            p, steps = _marginals(np.array([w[b].sum() for b in x]), change)
            grad = np.zeros(len(w))
            for b, e in zip(x, y - p, strict=True):
                np.add.at(grad, b, e)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            grad -= 2e-4 * w
            gw += grad * grad
            w += 0.3 * grad / np.sqrt(gw)
            step = seen - steps
            gc += step * step
            change += 0.3 * step / np.sqrt(gc)
    return {f: float(w[k]) for f, k in columns.items()}, tuple(float(x) for x in change.ravel())


def main_text(page: str | None, weights: dict[str, float], change: tuple[float, float, float, float]) -> str:
    found = blocks(page or "", weights)
    labels = viterbi([score for _, score in found], change)
    return "\n\n".join(t for (t, _), y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, model: tuple[dict[str, float], tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    weights, change = model or train()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                texts = [main_text(h, weights, change) for h in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(apply, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the main text of all pages."""
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
