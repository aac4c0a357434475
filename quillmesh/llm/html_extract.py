"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Each block element of a page is described by its subtree (text, links, tags, their density), its attribute tokens,
its depth and its siblings. Trees learn whether a node holds main text. The labels come from markup that says so:
a page that has an article or main element is labelled by it, less the parts inside it that are navigation, asides,
forms, adverts, notices or comments. Training rows are bounded: pages written by ``templates`` (a fixed number of
layouts, with and without such elements) and at most SAMPLE_PAGES pages of the input by least hash, those of at most
SAMPLE_CHARS characters; everything else of the operator works on all pages whole.

Decoding takes the choice of on and off for all nodes that has the greatest sum of log-odds among those in which
nothing below an off node is on, so that an ancestor and a descendant never contradict each other.

Text is that of the blocks that are on, in page order: character references decoded, white space runs one space,
trimmed, joined by an empty line. Scripts, styles, templates, form controls, drawings, players, comments and tags have no text.

Defined cases: an empty table gives no rows; a null or empty page has the empty text; pages may be as long as Spark
holds in a row, and take time in proportion; where a node's choices tie it is off; repeated rows are extracted alike; unclosed and crossed tags
are closed as their parents end, and so are elements without text, but for script, style and title, which go on to
the page's end; elements without text may close themselves; extra columns pass through, those with the names of the results are replaced.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted
from .storage import least_hashes

SAMPLE_PAGES = 200
SAMPLE_CHARS = 100_000
TEMPLATE_PAGES = 240
BATCH_PAGES = 128

BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hgroup center".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg iframe object select textarea button canvas video audio annotation annotation-xml title".split())
#: An open element of the key ends where one of the values begins.
CLOSES_P = BLOCK - {"html", "body"}
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
GOOD = re.compile(r"^(article|content|main|post|story|entry|body|text|prose|maincontent)")
POOR = re.compile(r"^(nav|menu|header|masthead|footer|sidebar|side|ad|ads|advert|advertisement|sponsor|sponsored|promo|banner|cookie|consent|notice|alert|popup|modal|comment|comments|reply|replies|respond|disqus|share|sharing|social|related|recommended|widget|form|login|signup|subscribe|newsletter|breadcrumb|breadcrumbs|pagination|pager|tags|toolbar|copyright|legal|search)$")
ROLES = {"navigation": 1, "banner": 1, "contentinfo": 1, "complementary": 1, "search": 1, "form": 1, "dialog": 1, "alert": 1}
OFF_TAGS = {"nav", "footer", "aside", "form", "header"}
#: Elements whose content is no markup: up to their end tag, or the page's end.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "title")}
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTE_OR_END = re.compile("[>\"']")
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
TAGS = ["p", "h", "li", "list", "div", "section", "article", "nav", "aside", "header", "footer", "form", "table", "quote", "other"]
_TAG = {"p": 0, **{f"h{i}": 1 for i in range(1, 7)}, "hgroup": 1, "li": 2, "dt": 2, "dd": 2, "ul": 3, "ol": 3, "dl": 3, "div": 4, "center": 4, "section": 5, "article": 6, "main": 6, "nav": 7, "aside": 8, "header": 9, "footer": 10, "form": 11, "fieldset": 11, **dict.fromkeys("table thead tbody tfoot tr td th caption".split(), 12), "blockquote": 13, "pre": 13, "figure": 13, "figcaption": 13}


def markup(source: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, end tag?, name, attributes) of each tag in turn, and at last the rest with an empty name; comments,
    declarations and what stands in RAW elements are left out.

    A tag ends at the first > outside quotes, a quote that nothing closes being a plain character. Where no such > is
    left on the page, it ends at the first > at all, and so do all tags after it; where there is none, < is text. So
    every character is looked at a bounded number of times.
    """
    at = begin = 0
    quoted, closes, size = True, {'"': True, "'": True}, len(source)
    held: list[str] = []

    def end_of(place: int) -> int:
        nonlocal quoted
        i = place
        while quoted:
            m = QUOTE_OR_END.search(source, i)
            if m is None:
                quoted = False
            elif m[0] == ">":
                return m.start()
            else:
                close = source.find(m[0], m.end()) if closes[m[0]] else -1
                closes[m[0]] = close >= 0
                i = close + 1 if close >= 0 else m.end()
        return source.find(">", place)

    while (at := source.find("<", at)) >= 0:
        tag, name, attributes = None, "", ""
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            after = end + 3 if end >= 0 else size
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at)
            if end < 0:
                break
            after = end + 1
        elif (tag := NAME.match(source, at + 1)) is not None:
            end = end_of(tag.end())
            if end < 0:
                break
            name, attributes, after = tag[2].lower(), source[tag.end() : end], end + 1
        else:
            at += 1
            continue
        held.append(source[begin:at])
        at = begin = after
        if tag is None:
            continue
        if not tag[1] and name in RAW and not (name == "title" and attributes.endswith("/")):
            close = RAW[name].search(source, after)
            at = begin = close.end() if close else size
            continue
        yield "".join(held), bool(tag[1]), name, attributes
        held.clear()
    yield "".join([*held, source[begin:]]), False, "", ""


class Page:
    """Block nodes of one page in order of their starts, and its text chunks with the node that holds each."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#"]
        self.parent: list[int] = [-1]
        self.good: list[int] = [0]
        self.poor: list[int] = [0]
        self.chunks: list[tuple[int, int, str, bool]] = []  # node, block run, text, inside a link
        stack: list[tuple[str, int]] = [("#", 0)]
        open_: dict[str, list[int]] = {}  # where in the stack the elements of a name are
        node = run = silent = 0

        def text(piece: str) -> None:
            if silent:
                return
            if piece and not piece.isspace():
                self.chunks.append((node, run, references.unescape(piece), bool(open_.get("a"))))
            elif piece:
                self.chunks.append((node, run, " ", False))

        def push(name: str) -> None:
            open_.setdefault(name, []).append(len(stack))
            stack.append((name, node))

        def pop_to(depth: int) -> None:
            nonlocal node, run, silent
            while len(stack) > depth:
                name, _ = stack.pop()
                open_[name].pop()
                silent -= name in SILENT
                run += name in BLOCK and not silent
            node = stack[-1][1]

        def innermost(names: Iterable[str]) -> int:
            return max((open_[x][-1] for x in names if open_.get(x)), default=0)

        for before, end, name, attributes in markup(source):
            if before:
                text(before)
            if not name:
                break
            if end:
                if open_.get(name):
                    pop_to(open_[name][-1])
                elif name == "p" and not silent:
                    run += 1
                continue
            if name in SILENT and attributes.endswith("/"):
                continue
            if name in SILENT or silent:  # tags in silent elements make no nodes and end nothing around them
                if name not in VOID:
                    push(name)
                    silent += name in SILENT
                continue
            if name == "br":
                self.chunks.append((node, run, " ", False))
            if name in VOID:
                run += name == "hr"
                continue
            if name in CLOSES_P and open_.get("p"):
                pop_to(open_["p"][-1])
            if name in ITEMS and innermost(ITEMS[name]) > innermost(LIMITS[name]):
                pop_to(innermost(ITEMS[name]))
            if name in BLOCK:
                good = poor = 0
                if attributes and not attributes.isspace():
                    for key, value in ATTR.findall(attributes):
                        key, value = key.lower(), value.strip("\"'")
                        if key == "role":
                            poor += ROLES.get(value.lower(), 0)
                            good += value.lower() in ("main", "article")
                        elif key == "hidden" or key == "aria-hidden":
                            poor += value.lower() != "false"
                        else:
                            for word in SPLIT.split(value):
                                word = word.lower()
                                good += bool(GOOD.match(word))
                                poor += bool(POOR.match(word))
                self.tag.append(name)
                self.parent.append(node)
                self.good.append(good)
                self.poor.append(poor)
                node = len(self.tag) - 1
                run += 1
            push(name)

    def labels(self) -> np.ndarray | None:
        """1 for nodes that hold main text by the page's own markup; None where it has no such markup."""
        roots = [t in ("article", "main") for t in self.tag]
        if not any(roots):
            return None
        inside = np.zeros(len(self.tag), bool)
        off = np.zeros(len(self.tag), bool)
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            inside[i] = inside[p] or roots[i]
            off[i] = off[p] or (self.tag[i] in OFF_TAGS and not (self.tag[i] == "header" and inside[p])) or (self.poor[i] > 0 and self.good[i] == 0)
        return self.carry(inside & ~off)

    def carry(self, own: np.ndarray) -> np.ndarray:
        """Nodes with ``own`` and text, and all above them."""
        out = np.zeros(len(self.tag), bool)
        for node, _, piece, _ in self.chunks:
            if own[node] and not piece.isspace():
                out[node] = True
        for i in range(len(self.tag) - 1, 0, -1):
            out[self.parent[i]] |= out[i]
        return out.astype(float)


def features(page: Page) -> np.ndarray:
    """One row for each node of the page."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, _, piece, link in page.chunks:
        size = len(piece)
        own[node] += size
        if link:
            linked[node] += size
        stops[node] += piece.count(".") + piece.count(",")
    chars, links, marks, nodes = own.copy(), linked.copy(), stops.copy(), np.ones(n)
    good, poor = np.array(page.good, float), np.array(page.poor, float)
    up = page.parent
    for i in range(n - 1, 0, -1):
        p = up[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        nodes[p] += nodes[i]
    kind = np.array([_TAG.get(t, 14) for t in page.tag])
    depth, above_good, above_poor, above_off, above_main = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    off_kind, main_kind = np.isin(kind, [7, 8, 9, 10, 11]), kind == 6
    order = np.zeros(n)
    for i in range(1, n):
        p = up[i]
        depth[i] = depth[p] + 1
        above_good[i] = above_good[p] + good[p]
        above_poor[i] = above_poor[p] + poor[p]
        above_off[i] = above_off[p] + off_kind[p]
        above_main[i] = above_main[p] + main_kind[p]
        order[i] = order[i - 1] + own[i - 1]
    safe = np.maximum(parent, 0)
    siblings = np.bincount(safe[1:], minlength=n)[safe] if n > 1 else np.zeros(n)
    sibling_chars = (np.bincount(safe[1:], chars[1:], n)[safe] - chars) / np.maximum(siblings - 1, 1) if n > 1 else np.zeros(n)
    same = np.zeros(n)
    if n > 1:
        key = safe[1:] * 16 + kind[1:]
        same[1:] = np.bincount(key, minlength=int(key.max()) + 1)[key]
    total = max(1.0, float(chars[0]))
    columns = [np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), chars / nodes, marks / np.maximum(chars, 1), np.log1p(nodes), chars / total, order / total, depth, siblings, np.log1p(np.maximum(sibling_chars, 0)), same, good, poor, above_good, above_poor, above_off, above_main]
    return np.concatenate([np.stack(columns, 1), np.eye(len(TAGS))[kind]], 1)


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """On and off for every node: the greatest sum of log-odds with nothing on below an off node."""
    n = len(page.tag)
    on, off = (margin / 2).tolist(), (-margin / 2).tolist()
    up = page.parent
    for i in range(n - 1, 0, -1):  # below an off node all are off
        p = up[i]
        on[p] += max(on[i], off[i])
        off[p] += off[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[up[i]] and on[i] > off[i]
    return out


def blocks(page: Page, on: np.ndarray) -> str:
    parts, last, held = [], None, []
    for node, run, piece, _ in [*page.chunks, (0, -1, "", False)]:
        if run != last:
            line = " ".join("".join(held).split())
            if line:
                parts.append(line)
            held, last = [], run
        if on[node]:
            held.append(piece)
    return "\n\n".join(parts)


def templates(count: int = TEMPLATE_PAGES, seed: int = 11) -> Iterator[tuple[Page, np.ndarray]]:
    """Written pages of varied layouts with their labels: the parts marked \x01 hold the main text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def line(a: int, b: int, stop: str = ".") -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(a, b))).capitalize() + stop

    def links(tag: str) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{line(1, 3, "")}</a></li>' for i in range(rng.randint(3, 9))) + "</ul>" if tag == "ul" else "".join(f'<a href="/{i}">{line(1, 3, "")}</a> ' for i in range(rng.randint(2, 7)))

    for _ in range(count):
        body = f"<h1>\x01{line(3, 12, '')}</h1>"
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            text = "\x01" + line(1, 90) + (f' <a href="x">{line(1, 3, "")}</a> ' + line(2, 20) if rng.random() < 0.2 else "")
            if kind < 0.72:
                body += f"<p>{text}</p>"
            elif kind < 0.8:
                body += f"<p><b>{text}<br>"
            elif kind < 0.86:
                body += f"<h2>\x01{line(2, 7, '')}</h2><p>{text}</p>"
            elif kind < 0.91:
                body += "<ul>" + "".join(f"<li>\x01{line(3, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            elif kind < 0.95:
                body += f"<blockquote>{text}</blockquote>"
            else:
                body += f'<div class="{rng.choice(["ad", "promo", "share", "related", "ad-slot"])}">{line(2, 14)}</div><p>{text}</p>'
        if rng.random() < 0.15:
            body += f'<div class="comments"><h3>{line(1, 2, "")}</h3>' + "".join(f'<div class="comment"><p>{line(4, 40)}</p></div>' for _ in range(rng.randint(1, 4))) + "</div>"
        opening, closing = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"), ('<section class="story">', "</section>"), ("<div>", "</div>")])
        before = [f"<nav>{links('ul')}</nav>", f'<div class="menu">{links("a")}</div>', f'<header><div>{line(1, 4, "")}</div>{links("ul")}</header>', f'<div class="{rng.choice(["ad", "banner", "advert"])}">{line(3, 25)}</div>', f'<div class="cookie-notice"><p>{line(8, 25)}</p></div>', f'<form><p>{line(1, 5)}</p><input></form>']
        after = [f"<footer>&copy; {line(2, 14)}</footer>", f'<div class="footer"><p>{line(2, 12)}</p>{links("a")}</div>', f'<aside><h3>{line(1, 3, "")}</h3>{links("ul")}<p>{line(5, 30)}</p></aside>', f'<div id="sidebar"><p>{line(5, 40)}</p></div>', f'<section id="comments"><p>{line(5, 50)}</p><p>{line(5, 50)}</p></section>', f'<div class="newsletter"><p>{line(5, 15)}</p></div>']
        rng.shuffle(before)
        rng.shuffle(after)
        source = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(before[: rng.randint(1, 4)]) + opening + body + closing + "".join(after[: rng.randint(1, 4)]) + ("</body></html>" if rng.random() < 0.9 else "")
        page = Page(source)
        own = np.zeros(len(page.tag), bool)
        for node, _, piece, _ in page.chunks:
            own[node] |= "\x01" in piece
        page.chunks = [(a, b, c.replace("\x01", ""), d) for a, b, c, d in page.chunks]
        yield page, page.carry(own)


def fit(sample: list[str] | None = None) -> Boosted:
    """Trees from the templates and the labelled pages of a sample."""
    rows = [(features(p), y) for p, y in templates()]
    for source in sample or []:
        page = Page(source)
        y = page.labels()
        if y is not None:
            rows.append((features(page), y))
    return Boosted().fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def extract_one(source: str, model: Boosted) -> str:
    page = Page(source)
    return blocks(page, decode(page, model.margin(features(page))))


def extract(pages: DataFrame, html: str = "html", model: Boosted | None = None) -> DataFrame:
    """``pages`` without its html column, with text and n_chars (code points)."""
    spark = pages.sparkSession
    if model is None:
        keys = [c for c in ("page_id", "url") if c in pages.columns] or [html]
        few = least_hashes(pages.where(F.length(html) <= SAMPLE_CHARS).select(html, *[k for k in keys if k != html]), keys, SAMPLE_PAGES)
        model = fit([r[0] for r in few.select(html).collect()])
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH_PAGES):
                batch = whole.slice(a, BATCH_PAGES)
                parsed = [Page(x or "") for x in batch.column(batch.schema.get_field_index(html)).to_pylist()]
                rows = [features(p) for p in parsed]
                margin = np.split(trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [blocks(p, decode(p, m)) for p, m in zip(parsed, margin)]
                cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages.select("page_id", "url", "html"))
