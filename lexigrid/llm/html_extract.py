"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with the chain of its open ancestors.
Features are the ancestors' tags, the words of their class, id and role, and the shape of the text; the chain adds a
weight for each pair of neighbouring labels.  Weights are fitted by the exact gradient of the likelihood (forward and
backward passes) on labelled pages, and pages are decoded by Viterbi.  The labelled pages come from a seeded generator
of page layouts, so training needs no file; own labelled pages can be given instead.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import bounded_batches, slices, table

# Element names of HTML, by what they do to text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "select")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img input button".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "li": frozenset({"li"}), "p": frozenset({"p"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
#: Open elements that an end tag or an implied end does not reach across.
FENCES = frozenset("table ul ol dl article section aside nav header footer main body html div form blockquote".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split()
)
#: Elements that begin and end a block; all others, unknown and foreign ones too, stand inside one.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link listing "
    "main menu meta nav noframes ol optgroup option p plaintext pre search section summary table tbody td tfoot th "
    "thead tr ul xmp".split()
) | frozenset(RAW)
#: Elements nested deeper are read as if they were not there; their text is kept.
DEPTH = 512
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"(/?)([a-zA-Z][^\s/>\"']{0,40})((?:\s[^>\"']{0,200})?)>")
_MARK = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?![\w-])", re.I) for t in RAW}
_HUGE = re.compile(r"&#([0-9]{8,})").sub
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+").findall
_SPACE = re.compile(r"\s+").sub


@dataclass
class Block:
    """Text of a leaf block, its open ancestors' features, and how many of its characters are in links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _element(name: str, attributes: str) -> tuple[str, frozenset[str]]:
    own = {f"<{name}"}
    if attributes and "=" in attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            own.update(f".{x}" for x in _PART((a or b or c).lower()))
    return name, frozenset(own)


class _Tags:
    """Finds where tags end.  Quotes hide what is between them; a quote that is not closed is a plain character.

    Where the rest of a tag leads from a quote on is remembered, so all tags of a page are found in one pass over it.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[int, int] = {}
        self.marked = (0, -1)  # from here to there is no mark

    def _mark(self, at: int) -> int:
        low, high = self.marked
        if not low <= at <= high:
            m = _MARK.search(self.page, at)
            self.marked = (at, m.start() if m else len(self.page))
        return self.marked[1]

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at ``at``; -1 if there is none."""
        seen, page, end = [], self.page, -1
        while at <= self.last:
            i = self._mark(at)
            if i in self.ends or i == len(page):
                end = self.ends.get(i, -1)
                break
            if page[i] == ">":
                end = i
                break
            seen.append(i)
            close = page.find(page[i], i + 1)
            at = (close if close >= 0 else i) + 1
        self.ends.update(dict.fromkeys(seen, end))
        return end


def _decoded(text: str) -> str:
    """Character references as characters, one space for white space; numbers of any length stay numbers."""
    if "&#" in text:
        text = _HUGE(lambda m: "&#" + (m[1].lstrip("0") or "0")[:8], text)
    return _SPACE(" ", html.unescape(text)).strip()


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page with text, in order.  Broken markup never raises: what can't be a tag is text."""
    page = page or ""
    stack: list[tuple[str, frozenset[str]]] = []
    opened: Counter = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked = links = at = 0
    held: tuple[str, ...] | None = None
    tags = _Tags(page)

    def flush():
        nonlocal linked, held
        if parts:
            text = _decoded("".join(parts))
            if text:
                out.append(Block(text, held or (), linked))
            parts.clear()
        linked, held = 0, None

    def add(text: str):
        nonlocal linked, held
        if text:
            if held is None and not text.isspace():
                held = tuple(sorted(frozenset().union(*(x for n, x in stack if n not in INLINE)))) if stack else ()
            parts.append(text)
            if links:
                linked += len(text)

    def close(i: int):
        nonlocal links
        for n, _ in stack[i:]:
            opened[n] -= 1
            links -= n == "a"
        del stack[i:]

    begin = 0  # of text that is not added yet
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > tags.last:
            add(page[begin:])
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            add(page[begin:lt])
            begin = at = end + 3 if end >= 0 else len(page)
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            add(page[begin:lt])
            begin = at = page.find(">", lt) + 1
            continue
        m = _PLAIN.match(page, lt + 1)  # most tags
        if m:
            gt, rest = m.end() - 1, m[3]
        else:
            m = _NAME.match(page, lt + 1)
            gt = tags.end(m.end()) if m else -1
            if gt < 0:
                at = lt + 1
                continue
            rest = page[m.end() : gt]
        add(page[begin:lt])
        begin = at = gt + 1
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in FENCES and (name not in BLOCK or name in ("p", "li")):
                    break
            continue
        foreign = opened["svg"] or opened["math"]
        if name in BLOCK and not foreign:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in RAW:
            if not rest.endswith("/"):
                end = _RAW_END[name].search(page, at)
                begin = at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            continue
        if name in VOID or rest.endswith("/"):
            continue
        closes = CLOSED_BY.get(name, frozenset()) | (frozenset({"p"}) if name in ENDS_P else frozenset())
        if any(opened[x] for x in closes):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    close(i)
                    break
                if stack[i][0] in FENCES:
                    break
        if len(stack) < DEPTH:
            stack.append(_element(name, rest))
            opened[name] += 1
            links += name == "a"
    flush()
    return out


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block of a page."""
    out = []
    for i, b in enumerate(found):
        words = b.text.split()
        own = [
            "any",
            *b.path,
            f"words{_bucket(len(words), (2, 4, 8, 16, 32, 64))}",
            f"links{_bucket(b.linked / len(b.text), (0.01, 0.3, 0.7, 0.95))}",
            f"stop{b.text[-1] in '.!?…。'}",
            f"commas{_bucket(b.text.count(','), (1, 3))}",
        ]
        if i == 0 or i == len(found) - 1:
            own.append("edge")
        low = b.text.lower()
        if "©" in low or "copyright" in low or "all rights" in low:
            own.append("rights")
        if "cookie" in low or "subscribe" in low or "sign up" in low or "newsletter" in low:
            own.append("notice")
        out.append(own)
    return out


@dataclass
class Field:
    """Feature numbers, a weight for each feature and label, and one for each pair of labels.  Label 1 is main text."""

    number: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def scores(self, names: list[list[str]]) -> np.ndarray:
        get, w = self.number.get, self.weights
        return np.array([w[[x for x in map(get, own) if x is not None]].sum(axis=0) for own in names])

    def decode(self, names: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        s = self.scores(names).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            from0, from1 = a + p00 >= b + p10, a + p01 >= b + p11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = x + max(a + p00, b + p10), y + max(a + p01, b + p11)
        labels = [0 if a >= b else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def _gradient(s: np.ndarray, pairs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of labels y, towards the block scores and the pair weights."""
    n = len(s)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = s[0]
    for i in range(1, n):
        ahead[i] = s[i] + np.logaddexp(ahead[i - 1, 0] + pairs[0], ahead[i - 1, 1] + pairs[1])
    for i in range(n - 2, -1, -1):
        t = pairs + s[i + 1] + back[i + 1]
        back[i] = np.logaddexp(t[:, 0], t[:, 1])
    whole = np.logaddexp(*ahead[-1])
    to_scores = -np.exp(ahead + back - whole)
    to_scores[np.arange(n), y] += 1
    to_pairs = np.zeros((2, 2))
    if n > 1:
        t = ahead[:-1, :, None] + pairs + (s[1:] + back[1:])[:, None, :] - whole
        to_pairs = -np.exp(t).sum(axis=0)
        np.add.at(to_pairs, (y[:-1], y[1:]), 1)
    return to_scores, to_pairs


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 8, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """A field from pages given as block features and labels, by adaptive gradient steps a page at a time."""
    number: dict[str, int] = {}
    for names, _ in pages:
        for own in names:
            for x in own:
                number.setdefault(x, len(number))
    w, p = np.zeros((len(number), 2)), np.zeros((2, 2))
    gw, gp = np.full_like(w, 1e-6), np.full_like(p, 1e-6)
    coded = [([np.array([number[x] for x in own]) for own in names], np.array(y)) for names, y in pages if names]
    order = random.Random(5)
    for _ in range(rounds):
        order.shuffle(coded)
        for rows, y in coded:
            s = np.array([w[r].sum(axis=0) for r in rows])
            to_s, to_p = _gradient(s, p, y)
            d = np.zeros_like(w)
            for r, g in zip(rows, to_s, strict=True):
                d[r] += g
            d -= ridge * w
            gw += d * d
            gp += to_p * to_p
            w += rate * d / np.sqrt(gw)
            p += rate * to_p / np.sqrt(gp)
    return Field(number, w, p)


def _sentence(r: random.Random) -> str:
    words = ["".join(r.choice("aeiourstlnmdcé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 22))]
    words = [w + "," if r.random() < 0.07 else w for w in words]
    return " ".join(words).capitalize() + r.choice("....!?")


def labelled_page(r: random.Random) -> tuple[str, str]:
    """A page of a random layout, and its main text."""
    main: list[str] = []

    def keep(tag: str, text: str, inside: str | None = None) -> str:
        main.append(text)
        close = "" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>"
        return f"<{tag}>{inside or html.escape(text, quote=False)}{close}"

    def prose(n: int) -> str:
        return " ".join(_sentence(r) for _ in range(n))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{_sentence(r)[: r.randint(3, 14)]}</a></li>' for i in range(n))

    def article() -> str:
        title, out = _sentence(r), []
        if r.random() < 0.85:
            out.append(keep(r.choice(["h1", "h1", "h2"]), title))
        for _ in range(r.randint(1, 9)):
            kind, text = r.random(), prose(1 if r.random() < 0.35 else r.randint(2, 9))
            if kind < 0.7:
                cut = text.rsplit(" ", 1)
                inside = f"<b>{html.escape(text, quote=False)}<br>" if r.random() < 0.25 else None
                if inside is None and len(cut) > 1 and r.random() < 0.2:
                    inside = f'{cut[0]} <a href="#">{cut[1]}</a>'
                out.append(keep("p", text, inside))
            elif kind < 0.8:
                out.append(keep(r.choice(["h2", "h3"]), _sentence(r)[:40].strip()))
            elif kind < 0.9:
                out.append("<ul>" + "".join(keep("li", _sentence(r)) for _ in range(r.randint(2, 4))) + "</ul>")
            else:
                out.append(f"<blockquote>{keep('p', text)}</blockquote>")
            if r.random() < 0.08:
                out.append(f'<div class="{r.choice(["ad", "ads", "advert", "promo", "sponsored"])}">{prose(1)}</div>')
        return "".join(out)

    def aside(tag: str, names: list[str], inner: str) -> str:
        name = r.choice(names)
        return r.choice([f"<{tag}>{inner}</{tag}>", f'<div class="{name}">{inner}</div>', f'<{tag} id="{name}">{inner}</{tag}>'])

    top, end = [], []
    for chance, made in (
        (0.5, lambda: aside("header", ["header", "masthead", "top"], f"<a href='/'>{_sentence(r)[:15]}</a>" + (f"<p>{prose(1)}</p>" if r.random() < 0.4 else ""))),
        (0.8, lambda: aside("nav", ["nav", "menu", "navbar", "breadcrumb"], f"<ul>{links(r.randint(2, 8))}</ul>")),
        (0.35, lambda: f'<div class="{r.choice(["cookie-notice", "cookie", "notice", "banner", "consent"])}"><p>{prose(1)} cookies.</p><button>OK</button></div>'),
        (0.5, lambda: f'<div class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsor", "promo"])}">{prose(r.randint(1, 2))}</div>'),
        (0.2, lambda: f"<form action='/s'><label>{_sentence(r)[:12]}</label><input name=q><button>Go</button></form>"),
        (0.25, lambda: aside("aside", ["sidebar", "side", "widget"], f"<h3>{_sentence(r)[:20]}</h3><ul>{links(3)}</ul>")),
    ):
        if r.random() < chance:
            top.append(made())
    r.shuffle(top)
    for chance, made in (
        (0.35, lambda: aside("aside", ["sidebar", "related", "widget"], f"<h3>{_sentence(r)[:20]}</h3><p>{prose(r.randint(1, 3))}</p><ul>{links(3)}</ul>")),
        (0.4, lambda: f'<{(t := r.choice(["section", "div"]))} class="{r.choice(["comments", "comment-list", "responses"])}"><h3>{_sentence(r)[:14]}</h3>' + "".join(f'<div class="comment"><p>{prose(r.randint(1, 4))}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>"),
        (0.2, lambda: f'<form class="subscribe"><p>{prose(1)}</p><input type=email><button>Send</button></form>'),
        (0.3, lambda: f'<div class="{r.choice(["ad", "promo", "share", "social", "newsletter"])}">{prose(1)}</div>'),
    ):
        if r.random() < chance:
            end.append(made())
    r.shuffle(end)
    body = article()
    wrap = r.choice(["article", "article", "article", "main", "div class=content", "div id=article", "div class=post", "section class=entry"])
    bare = r.random()
    if bare < 0.1:  # layouts that name nothing
        body = f"<div>{body}</div>" if bare < 0.06 else body
    elif bare < 0.25:
        rows = r.choice(["", f"<tr><td colspan=2><a href='/'>{_sentence(r)[:12]}</a></td></tr>"])
        side = r.choice(["", f"<td width=150><ul>{links(r.randint(2, 6))}</ul></td>", f"<td><a href='/a'>{_sentence(r)[:9]}</a><br><a href='/b'>{_sentence(r)[:9]}</a></td>"])
        body = f"<table>{rows}<tr>{side}<td>{body}</td></tr></table>"
    else:
        body = f"<{wrap}>{body}</{wrap.split()[0]}>"
    foot = f"<{(t := r.choice(['footer', 'footer', 'div class=footer']))}>" + r.choice(["&copy; ", "", "&copy; 2020 &middot; "]) + f"{prose(r.randint(1, 2))}</{t.split()[0]}>"
    head = f"<head><title>{_sentence(r)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
    page = f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{body}{''.join(end)}{foot if r.random() < 0.9 else ''}"
    return page + ("</body></html>" if r.random() < 0.8 else ""), "\n".join(main)


def label(page: str, main: str) -> tuple[list[list[str]], list[int]]:
    """Block features of a labelled page, and which blocks are the lines of its main text, in order."""
    found, lines, labels = blocks(page), main.split("\n"), []
    for b in found:
        hit = bool(lines) and b.text == " ".join(lines[0].split())
        labels.append(int(hit))
        if hit:
            lines.pop(0)
    return features(found), labels


@lru_cache(maxsize=4)
def trained(pages: int = 500, seed: int = 11) -> Field:
    r = random.Random(seed)
    return fit([label(*labelled_page(r)) for _ in range(pages)])


def main_text(page: str | None, field: Field) -> str:
    """The main blocks of a page, one a line."""
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Null and empty html, and pages without a main block, give an empty text; broken markup is read as far as it goes;
    pages of any length are read whole, in one pass; of labellings that are equally likely that with fewer main blocks is
    taken; repeated rows stay repeated; an empty table gives an empty result; columns but page_id, url and html are
    ignored.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(field or trained())
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "html"):
            texts = [main_text(x, own) for x in b.column("html").to_pylist()]
            arrays = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every row of pages with its main text.  Odd rows as in extract."""
    bounded_batches(spark)
    return extract(table(spark, sf_dir, "pages"))
