"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into its block elements; inline markup belongs to the block
around it.  Each block has features: what kind of element it is, words of its
class and id that speak for content or for page furniture, here and above it,
depth, text density and link share of its subtree, how it stands among its
siblings, and how to the block with most prose.  Gradient-boosted trees give the log-odds that its own text is main
text.  Decoding then picks the best consistent choice for the whole tree: a
dropped element takes all it holds with it, a kept one may still lose parts.

The trees are trained here, on ``TRAINING_PAGES`` generated pages whose true
parts are known; that bound does not depend on the data.  Extraction treats
every page by itself, without a shuffle.

Text: character references are decoded, white space within a block becomes one
space, blocks are joined in page order by one space.

Cases: null or empty html gives an empty text; text outside any element counts
as a block of the page; unclosed and misnested elements, the head included, are
closed where HTML closes them, or at the end; hidden elements go with all they
hold; a very long page takes time and memory in proportion to its length; where
keeping and dropping a block are worth the same, it is dropped; repeated rows,
and rows that repeat an id or have none, are extracted alike; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytekit
from .boost import Boosted

TRAINING_PAGES = 1400
#: The most that the block around it adds to the log-odds of a block.
PULL = 1.0

# Outside of quotes a tag ends at the next angle bracket, and nothing is tried twice: a page is scanned in linear time.
_ATTR = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|select|iframe|svg|title)(?![^\s/<>]){_ATTR}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTR})>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLASS = re.compile(r"""(?:class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
#: What may stand in the head; anything else ends it.
_HEAD = frozenset("base link meta title style script noscript template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
_ALIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = frozenset("ul ol dl table body article main div section td".split())

_KINDS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset button input", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dd dt", "table tr td th tbody", "div section center", "figure figcaption"]
_KIND = {t: i for i, x in enumerate(_KINDS) for t in x.split()}
_GOOD = frozenset("article articlebody body content entry main post story text prose read page paragraph".split())
_BAD = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom copyright legal sidebar side aside rail widget related recommended trending popular cookie cookies consent notice gdpr privacy alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social follow comment comments commentlist disqus reply replies respond pagination pager tags toc skip toolbar complementary contentinfo dialog".split()
)
_PARAGRAPH = frozenset("p blockquote pre".split())
_WIDTH = len(_KINDS) * 2 + 21


def _attr_words(attrs: str) -> tuple[int, int]:
    good = bad = 0
    for m in _NAMED.finditer(attrs):
        for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()):
            good += w in _GOOD
            bad += w in _BAD
    return good, bad


def _hidden(attrs: str) -> bool:
    """Whether an element is hidden by the attribute of that name, to readers aloud, or by its style."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NONE.search(value):
            return True
    return False


class Page:
    """Blocks of a page as parallel lists; a parent stands before its children."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.good, self.bad, self.off, self.runs = [-1], [""], [0], [0], [0], []
        self.named = [""]
        self.linked = [0]
        open_, tags, at, links = [0], [""], 0, 0
        held: Counter[str] = Counter()
        run: list[str] = []

        def close(to: int) -> None:
            held.subtract(tags[to:])
            del tags[to:], open_[to:]

        def end_run() -> None:
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                run.clear()
                if text:
                    self.runs.append((open_[-1], text))

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                part = source[at : m.start()]
                run.append(part)
                if links:
                    self.linked[open_[-1]] += len(part)
            at = m.end()
            closing, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            if not tag:
                continue
            tag = tag.lower()
            if held["head"] and not closing and tag not in _HEAD:
                end_run()
                close(tags.index("head"))
            if tag in _INLINE:
                if tag == "a":
                    links = 0 if closing else 1
                continue
            end_run()
            if tag in _VOID:
                continue
            if closing:
                if held[tag]:
                    to = len(tags) - 1
                    while tags[to] != tag:
                        to -= 1
                    close(to)
                continue
            if tag in _CLOSES_P and tags[-1] == "p":
                close(len(tags) - 1)
            if tag in _ALIKE and any(held[x] for x in _ALIKE[tag]):
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] in _ALIKE[tag]:
                        close(i)
                        break
                    if tags[i] in _FENCE:
                        break
            good, bad = _attr_words(attrs) if "=" in attrs else (0, 0)
            self.parent.append(open_[-1])
            self.tag.append(tag)
            self.named.append(" ".join(sorted((m[1] or m[2] or m[3] or "") for m in _CLASS.finditer(attrs))) if "=" in attrs else "")
            self.good.append(good)
            self.bad.append(bad)
            self.off.append(tag == "head" or tag == "title" or bool(attrs) and _hidden(attrs))
            self.linked.append(0)
            open_.append(len(self.tag) - 1)
            tags.append(tag)
            held[tag] += 1
        run.append(source[at:])
        end_run()

    def features(self) -> np.ndarray:
        n, parent = len(self.tag), self.parent
        own, words, count = [0] * n, [0] * n, [0] * n
        for node, text in self.runs:
            own[node] += len(text)
            words[node] += text.count(" ") + 1
            count[node] += 1
        under, link, nodes, runs = own[:], self.linked[:], [1] * n, count[:]
        kids = [0] * n
        for v in range(n - 1, 0, -1):
            p = parent[v]
            under[p] += under[v]
            link[p] += link[v]
            nodes[p] += nodes[v]
            runs[p] += runs[v]
            kids[p] += 1
        # The block with most text in paragraphs of its own, or as its own; and how the others lie to it.
        prose = own[:]
        for v in range(1, n):
            if self.tag[v] in _PARAGRAPH:
                prose[parent[v]] += own[v]
                prose[v] = 0
        best = max(range(n), key=prose.__getitem__)
        inside, around, after = [v == best for v in range(n)], [False] * n, best
        for v in range(best + 1, n):
            inside[v] = inside[parent[v]]
            if inside[v]:
                after = v
        v = parent[best]
        while v >= 0:
            around[v], v = True, parent[v]
        told = any(t in ("article", "main") for t in self.tag)
        x = np.zeros((n, _WIDTH))
        kinds = len(_KINDS)
        total, depth, place = max(1, under[0]), [0] * n, [0] * n
        seen: dict = {}
        same: dict = {}
        for v in range(1, n):
            key = (parent[v], self.tag[v])
            same[key] = same.get(key, 0) + 1
        rows = []
        for v in range(n):
            p = parent[v]
            if v:
                depth[v] = depth[p] + 1
                place[v] = seen.get(p, 0)
                seen[p] = place[v] + 1
                x[v, kinds : 2 * kinds] = x[p, kinds : 2 * kinds]
            k = _KIND.get(self.tag[v])
            if k is not None:
                x[v, k] = x[v, kinds + k] = 1
            u = under[v]
            brothers = kids[p] if v else 1
            up_good, up_bad = (rows[p][14], rows[p][15]) if v else (0, 0)
            rows.append((
                math.log1p(u), math.log1p(own[v]), min(1.0, link[v] / u) if u else 0.0, min(1.0, self.linked[v] / own[v]) if own[v] else 0.0, u / total, math.log1p(u / nodes[v]), words[v] / max(1, count[v]),
                depth[v], math.log1p(kids[v]), math.log1p(brothers), same.get((p, self.tag[v]), 1) / max(1, brothers), place[v] / max(1, brothers),
                self.good[v], self.bad[v], up_good + (self.good[v] > 0), up_bad + (self.bad[v] > 0), words[v],
                told, inside[v], around[v], v > after,
            ))
        x[:, 2 * kinds :] = rows
        self.own = own
        return x

    def decode(self, odds: np.ndarray) -> list[bool]:
        """The best set of kept blocks in which no kept block lies within a dropped one."""
        # Siblings of one element and class stand or fall together: their odds are pooled by text.
        like: dict = {}
        keys = list(zip(self.parent, self.tag, self.named, strict=True))
        for key, o, w in zip(keys, odds.tolist(), self.own, strict=True):
            a, b = like.get(key, (0.0, 0))
            like[key] = a + o * (w + 1), b + w + 1
        pooled = [like[key][0] / like[key][1] for key in keys]
        # What the block around it is speaks for a block as well, if it is in doubt.
        pull = [0.0, *(max(-PULL, min(PULL, pooled[p] / 4)) for p in self.parent[1:])]
        gain = [(o + more) * (w + 1) for o, more, w in zip(pooled, pull, self.own, strict=True)]
        for v in range(len(gain) - 1, 0, -1):
            if self.off[v]:
                gain[v] = 0.0
            elif gain[v] > 0:
                gain[self.parent[v]] += gain[v]
        keep = [gain[0] > 0] * len(gain)
        for v in range(1, len(gain)):
            keep[v] = keep[self.parent[v]] and gain[v] > 0
        return keep


# ---- training pages -------------------------------------------------------


def _prose(r: random.Random, n: int) -> str:
    syllables = "an ber con de el fo ga hi in ju ka lo mer no or pa qui re st ti un ver wa xi ye zo é ü ñ".split()
    out = []
    for i in range(n):
        w = "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
        out.append(w.capitalize() if i == 0 or out[-1][-1] == "." else w)
        if r.random() < 0.12:
            out[-1] += r.choice(".,")
    return " ".join(out)


def _noise(r: random.Random, text: str) -> str:
    for tag in ("b", "em", "a", "span"):
        if r.random() < 0.12:
            words = text.split(" ")
            i = r.randrange(len(words))
            words[i] = f"<{tag}>{words[i]}</{tag}>"
            text = " ".join(words)
    return text


def training_html(r: random.Random) -> str:
    """A random page with its main text between marks."""
    links = lambda n: "".join(f'<li><a href="/{i}">{_prose(r, r.randint(1, 3))}</a>' + r.choice(("</li>", "</li>", "")) for i in range(n))
    plain = lambda n: f"<p>{_noise(r, _prose(r, n))}</p>"

    def any_name() -> str:
        """Names that say nothing, as sites make up their own."""
        return f' {r.choice(("class", "class", "id"))}="{"".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 4)))}-{r.choice(("box", "block", "inner", "wrap", "x", "1"))}"'

    def furniture(kind: str) -> str:
        short, long = r.randint(2, 9), r.randint(8, 45)
        body = {
            "nav": lambda: r.choice((f"<ul>{links(r.randint(2, 9))}</ul>", f"<ul>{links(r.randint(2, 9))}</ul>", " | ".join(f'<a href="/{i}">{_prose(r, r.randint(1, 3))}</a>' for i in range(r.randint(1, 9))))),
            "header": lambda: r.choice((f"<h1>{_prose(r, short)}</h1>", f"<h2>{_prose(r, short)}</h2>", _prose(r, short), plain(short))),
            "footer": lambda: r.choice((plain(long), _prose(r, long), f"<ul>{links(3)}</ul>", f"&copy; 2020 {_prose(r, short)}")),
            "side": lambda: r.choice((f"<h3>{_prose(r, 2)}</h3><ul>{links(4)}</ul>", plain(long), plain(long) * 2)),
            "notice": lambda: r.choice((_prose(r, long), plain(long) + "<button>OK</button>")),
            "ad": lambda: r.choice((_prose(r, short), _prose(r, long), plain(long), f'<a href="x">{_prose(r, short)}</a>')),
            "form": lambda: f"<label>{_prose(r, short)}</label><input name=q><button>{_prose(r, 1)}</button>" + r.choice(("", plain(short))),
            "comments": lambda: r.choice((f"<h3>{_prose(r, 2)}</h3>", f"<h2>{r.randint(1, 90)} {_prose(r, 1)}</h2>", "")) + "".join(r.choice((plain(long), f'<div{r.choice((' class="comment"', ' class="reply"', any_name(), ""))}>{r.choice(("", f"<b>{_prose(r, 1)}</b>", f"<h4>{_prose(r, 2)}</h4>"))}{plain(long)}</div>', f"<li>{plain(long)}</li>")) for _ in range(r.randint(1, 6))) + r.choice(("", "<form><textarea></textarea></form>")),
        }[kind]()
        tag = {"nav": ("nav", "nav", "div", "ul", "td", "p"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "side": ("aside", "aside", "div", "section"), "notice": ("div", "section", "p"), "ad": ("div", "div", "section", "aside", "p"), "form": ("form", "form", "div"), "comments": ("section", "div", "ol")}[kind]
        names = {"nav": "nav menu navbar main-menu breadcrumbs", "header": "header site-header masthead topbar", "footer": "footer site-footer bottom copyright", "side": "sidebar side right-rail related widget popular", "notice": "cookie-notice notice consent banner alert popup", "ad": "ad ads advert sponsored promo ad-banner", "form": "search newsletter login-form signup subscribe", "comments": "comments comment-list replies responses disqus"}[kind].split()
        t = r.choice(tag)
        named = f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"' if t in ("div", "section", "p", "ul", "ol") or r.random() < 0.4 else ""
        if r.random() < 0.3:
            named = any_name()
        out = f"<{t}{named}>{body}</{t}>"
        return f"<table><tr>{out}</tr></table>" if t == "td" else out

    parts: list[tuple[str, bool]] = []
    size = r.choice((1, 1, 2, 3, 4, 6, 9, 14, 30, 60, 140))
    if r.random() < 0.85:
        parts.append((f"<h1>{_noise(r, _prose(r, r.randint(1, 9)))}</h1>", True))
    for _ in range(size):
        x = r.random()
        n = r.choice((1, 3, 8, 20, 40, 80, 150) if size < 30 else (1, 5, 12, 25))
        if x < 0.75:
            parts.append((f"<p>{_noise(r, _prose(r, n))}" + r.choice(("</p>", "</p>", "</p>", "<br>" + _prose(r, 5) + "</p>", "")), True))
        elif x < 0.82:
            parts.append((f"<h2>{_prose(r, r.randint(1, 5))}</h2>", True))
        elif x < 0.88:
            parts.append(("<ul>" + "".join(f"<li>{_prose(r, r.randint(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>", True))
        elif x < 0.92:
            parts.append((f"<blockquote><p>{_prose(r, n)}</p></blockquote>", True))
        elif x < 0.95:
            parts.append((f"<table><tr><td>{_prose(r, 2)}</td><td>{_prose(r, 3)}</td></tr></table>", True))
        elif r.random() < 4 / size:
            parts.append((furniture(r.choice(("ad", "side", "form", "notice"))), False))
    if r.random() < 0.05:
        parts.append((furniture("comments"), False))
    whole = "".join(f"\x01{h}\x02" if good else h for h, good in parts)
    wrap = r.choice(("<article>{}</article>",) * 3 + ('<article class="post">{}</article>', "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body">{}</div>', '<div class="entry">{}</div>', '<main><div class="article">{}</div></main>', '<div class="wrap"><div class="story">{}</div></div>', "<div>{}</div>", f"<div{any_name()}>{{}}</div>", f"<div{any_name()}><section>{{}}</section></div>", "{}"))
    above = [furniture(k) for k in ("nav", "header", "ad", "notice", "form", "side") if r.random() < 0.45]
    below = [furniture(k) for k in ("comments", "side", "ad", "form", "footer", "notice", "nav") if r.random() < 0.45]
    r.shuffle(above)
    body = "".join(above) + wrap.format(whole) + "".join(below)
    if r.random() < 0.3:
        body = f'<div class="{r.choice(("page", "container", "site"))}">{body}</div>'
    head = r.choice((f"<head><title>{_prose(r, 4)}</title><style>p{{}}</style></head>", f"<head><title>{_prose(r, 4)}</title><style>p{{}}</style></head>", f"<head><meta charset=utf-8><title>{_prose(r, 4)}</title>", ""))
    start, end = r.choice((("<body>", "</body>"), ("<body>", "</body>"), ("<body>", "</body>"), ("", "")))
    marked = f'<!DOCTYPE html><html>{head}{start}<script>var t="</p>";</script>{body}{end}</html>'
    return marked


def training_page(r: random.Random) -> tuple[str, str]:
    """A random page, with marks, and its main text."""
    marked = training_html(r)
    page = Page(marked)
    main, on = [], False
    for _, text in page.runs:
        if "\x01" in text:
            on = True
        if on and (t := " ".join(text.replace("\x01", " ").replace("\x02", " ").split())):
            main.append(t)
        if "\x02" in text and text.rindex("\x02") > text.rfind("\x01"):
            on = False
    return marked, " ".join(main)


def train(pages: int = TRAINING_PAGES, seed: int = 11) -> Boosted:
    """Trees from generated pages; a block is positive if it holds main text, or a block that does."""
    r, xs, ys, ws = random.Random(seed), [], [], []
    for _ in range(pages):
        marked = training_html(r)
        marks = Page(marked)
        clean = Page(re.sub("[\x01\x02]", "", marked))
        label = np.zeros(len(marks.tag))
        on = False
        for node, text in marks.runs:
            on = on or "\x01" in text
            if on and text.replace("\x01", "").replace("\x02", "").strip():
                label[node] = 1
            if "\x02" in text and text.rindex("\x02") > text.rfind("\x01"):
                on = False
        for v in range(len(label) - 1, 0, -1):
            if label[v]:
                label[marks.parent[v]] = 1
        x = clean.features()
        if len(x) == len(label):
            xs.append(x)
            ys.append(label)
            ws.append(np.log1p(np.array(clean.own)) + 0.5)
    return Boosted(rounds=80, depth=4, rate=0.25, share=0.5).fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extract(sources: list[str], model: Boosted) -> list[str]:
    """Main texts of some pages."""
    pages = [Page(x) for x in sources]
    xs = [p.features() for p in pages]
    odds = model.score(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for p, x in zip(pages, xs, strict=True):
        keep = p.decode(odds[at : at + len(x)])
        at += len(x)
        out.append(" ".join(text for node, text in p.runs if keep[node]))
    return out


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    # A few hundred small arrays: the size of the model does not depend on the data.
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch, "html"):
                texts = extract([x or "" for x in part.column("html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


#: The given pages hold their main text in one article; SQL says no more of the method than that.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(b|em|a|span|i)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
