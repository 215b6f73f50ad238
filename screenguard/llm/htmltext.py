"""Main text of web pages by tree scoring.

Blocks of text give points, for length and commas, to the elements above them, discounted
by the share of their text that is in links. The best container and the siblings that
score near it are kept. Elements whose tag is furniture don't count; those that only name
themselves so don't either, unless most of the page's running text is in them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, sliced

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select datalist title noembed noframes xmp".split())
DROP = frozenset("nav header footer aside form button dialog menu fieldset input head legend optgroup option".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body button caption head html legend option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the same family ends, up to the element that holds the family.
FAMILY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
#: Words of a class, id or role that mark furniture (fixed values): of any element, and of those that hold other blocks.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus consent cookie cookies cookiebar gdpr notice notices notification alert newsletter outbrain pagination popup promo promoted promotion reply replies respond share sharing shares skiplink sponsor sponsored subscribe subscription taboola".split())
HOLDERS = ALWAYS | frozenset("bottombar dialog disclaimer footer foot masthead header menu menubar modal nav navbar navigation overlay pager recommend recommended related search searchbox sidebar sidenav skip social toolbar topbar widget widgets complementary contentinfo".split())
#: Of those, what readers write: never the article, however long.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that name content when they come last, and words that say what an element has or lacks (fixed values).
CONTENT = frozenset("article body content entry main page post story text wrapper container layout".split())
HAVING = frozenset("has have with without no not is js hide show".split())
TEXTUAL = frozenset("p pre blockquote li dd dt td th span em strong b i u a q cite code small mark h1 h2 h3 h4 h5 h6 figcaption".split())
LISTS = frozenset("ul ol dl table section div".split())

_TAG = re.compile(r"<(?:!--(?:>|->|(?P<comment>))|(?P<odd>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _furniture(tag: str, rest: str) -> int:
    """What the attributes say: 0 nothing, 1 named as furniture, 2 hidden, 3 named as readers' words."""
    if "=" not in rest and "hidden" not in rest:
        return 0
    names = ALWAYS if tag in TEXTUAL else HOLDERS
    found = 0
    for m in _ATTR.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for name in value.split():
                words = [w for w in re.split(r"[^a-z0-9]+", _CAMEL.sub("-", name).lower()) if w]
                if not words or words[0] in HAVING or words[-1] in CONTENT:
                    continue
                if any(w in names for w in (words[0], words[-1])):
                    found = 3 if 3 == found or any(w in READERS for w in words) else 1
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return found


class Page:
    """Elements in page order as parallel lists, and runs of text with their element and block."""

    def __init__(self, page: str):
        self.tag, self.up, self.drop = ["html"], [-1], [0]  # drop: 0 no, 1 by name, 2 for good
        self.runs: list[tuple[int, int, str, bool]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, open_tags, at, block, links = [0], {"html": 1}, 0, 0, 0

        def pop() -> None:
            nonlocal block, links
            t = self.tag[stack.pop()]
            open_tags[t] -= 1
            block += t in BLOCK
            links -= t == "a"

        def text(piece: str) -> None:
            if piece:
                self.runs.append((stack[-1], block, entities.unescape(piece), links > 0))

        low = None
        while True:
            start = page.find("<", at)
            if start < 0:
                text(page[at:])
                return
            m = _TAG.match(page, start)
            if not m:
                if page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/":  # quotes that don't close
                    text(page[at:start])
                    end = page.find(">", start)
                    if end < 0:
                        return
                    m = re.match(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)?(?P<rest>[^>]*)>", page[start : end + 1])
                    at = end + 1
                    if not m or not m["name"]:
                        continue
                else:
                    text(page[at : start + 1])
                    at = start + 1
                    continue
            else:
                text(page[at:start])
                at = m.end()
                if m["comment"] is not None:
                    end = page.find("-->", at)
                    at = len(page) if end < 0 else end + 3
                    continue
                if m["odd"]:
                    end = page.find(">", at)
                    at = len(page) if end < 0 else end + 1
                    continue
                if not m["name"]:
                    continue
            name, rest = m["name"].lower(), m["rest"]
            if m["end"]:
                if name == "br":
                    self.runs.append((stack[-1], block, " ", False))
                elif open_tags.get(name):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name and not (name not in BLOCK and self.tag[stack[k]] in BLOCK):
                        k -= 1
                    if self.tag[stack[k]] == name and k:
                        while len(stack) > k:
                            pop()
                continue
            if name in RAW:
                if low is None:
                    low = page.lower() if len(page.lower()) == len(page) else re.sub(r"[A-Z]+", lambda x: x[0].lower(), page)
                if rest.rstrip().endswith("/") and name in ("svg", "math"):
                    continue
                end = low.find(f"</{name}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = len(page) if close < 0 else close + 1
                continue
            if name in ENDS_P and open_tags.get("p"):
                k = len(stack) - 1
                while k and self.tag[stack[k]] != "p" and (self.tag[stack[k]] not in BLOCK):
                    k -= 1
                if self.tag[stack[k]] == "p":
                    while len(stack) > k:
                        pop()
            if name in FAMILY:
                mates, holders = FAMILY[name]
                k = len(stack) - 1
                found = 0
                while k and self.tag[stack[k]] not in holders:
                    if self.tag[stack[k]] in mates:
                        found = k
                    k -= 1
                while found and len(stack) > found:
                    pop()
            if name in VOID:
                if name == "br":
                    self.runs.append((stack[-1], block, " ", False))
                block += name == "hr"
                continue
            if name in ("html", "body") and open_tags.get(name):
                continue
            if name == "body" and open_tags.get("head"):
                while len(stack) > 1 and self.tag[stack[-1]] != "head":
                    pop()
                if len(stack) > 1:
                    pop()
            block += name in BLOCK
            self.tag.append(name)
            self.up.append(stack[-1])
            said = _furniture(name, rest) if name not in ("html", "body", "article", "main") else 0
            self.drop.append(2 if name in DROP or said > 1 else said)
            stack.append(len(self.tag) - 1)
            open_tags[name] = open_tags.get(name, 0) + 1
            links += name == "a"

    def _dropped(self) -> list[bool]:
        """Elements that don't count: those for good, those by name that hold less than half of the running text, and all inside them."""
        tag, up, drop = self.tag, self.up, self.drop
        gone = [False] * len(tag)
        for i in range(1, len(tag)):
            gone[i] = gone[up[i]] or drop[i] == 2
        named = [i for i in range(1, len(tag)) if drop[i] == 1 and not gone[i]]
        if not named:
            return gone
        running, blocks = [0] * len(tag), [set() for _ in tag] if named else []
        for node, block, piece, link in self.runs:
            if not gone[node] and not link and not piece.isspace():
                running[node] += len(piece)
                blocks[node].add(block)
        total = sum(running)
        for i in range(len(tag) - 1, 0, -1):
            running[up[i]] += running[i]
            if len(blocks[up[i]]) < 3:
                blocks[up[i]] |= blocks[i]
        for i in named:
            if not (running[i] >= 200 and 2 * running[i] > total and len(blocks[i]) > 1):
                gone[i] = True
        for i in range(1, len(tag)):
            gone[i] = gone[i] or gone[up[i]]
        return gone

    def main_text(self) -> str:
        tag, up, drop = self.tag, self.up, self._dropped()
        size, linked = [0] * len(tag), [0] * len(tag)
        blocks: dict[int, list] = {}
        for node, block, piece, link in self.runs:
            if drop[node]:
                continue
            n = len(piece)
            size[node] += n
            linked[node] += n * link
            blocks.setdefault(block, [node, 0, 0, 0])
            b = blocks[block]
            b[1] += n
            b[2] += n * link
            b[3] += piece.count(",") + piece.count("，") + piece.count("、")
        for i in range(len(tag) - 1, 0, -1):
            size[up[i]] += size[i]
            linked[up[i]] += linked[i]
        score = [0.0] * len(tag)
        for node, n, link, commas in blocks.values():
            while node and tag[node] not in BLOCK:
                node = up[node]
            if n < 2 or tag[node] in HEADINGS:
                continue
            points = (1 + commas + min(n / 100, 3)) * (1 - link / n)
            at = up[node] if tag[node] in ("p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption") and node else node
            share = 1.0
            for _ in range(4):
                score[at] += points * share
                if not at:
                    break
                at, share = up[at], share / 2
        for i in range(len(tag)):
            score[i] *= 1 - linked[i] / size[i] if size[i] else 0
            if tag[i] in ("html", "ul", "ol", "dl", "tr", "tbody", "thead", "li", "blockquote"):
                score[i] *= 0.5
            elif tag[i] in ("article", "main"):
                score[i] = score[i] * 1.5 + 1e-9
        best = max(range(len(tag)), key=lambda i: (score[i], -i)) if tag else 0
        at = best
        while at:  # an article is kept as a whole
            if tag[at] in ("article", "main"):
                best = at
                break
            at = up[at]
        whole = tag[best] in ("article", "main")
        inside, says = [False] * len(tag), [tag[i] in ("p", "pre", "blockquote") and size[i] > 0 for i in range(len(tag))]
        inside[best] = True
        for i in range(len(tag) - 1, 0, -1):
            says[up[i]] = says[up[i]] or says[i] and not drop[i]
        for i in range(1, len(tag)):  # siblings that score near it, and running text beside it
            if up[i] == up[best] and i != best and not drop[i]:
                running = says[i] and linked[i] < 0.25 * size[i] and (tag[i] == tag[best] or tag[i] in ("section", "p", "pre", "blockquote")) and not (whole and tag[i] == "div")
                inside[i] = running or score[i] >= max(3.0, 0.2 * score[best]) or tag[i] in HEADINGS and size[i] > 0 and not whole
        for i in range(1, len(tag)):
            inside[i] = inside[i] or inside[up[i]]
            drop[i] = drop[up[i]] or drop[i] or not whole and tag[i] in LISTS and size[i] > 0 and linked[i] > 0.66 * size[i] and i != best
        out: dict[int, list[str]] = {}
        for node, block, piece, _ in self.runs:
            if inside[node] and not drop[node]:
                out.setdefault(block, []).append(piece)
        return "\n".join(t for t in (" ".join("".join(x).split()) for x in out.values()) if t)


def main_text(page: str | None) -> str:
    """The article's blocks of a whole page, one a line; empty if it has none, or if null."""
    return Page(page).main_text() if page else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` with text and n_chars (code points) in place of the html column.

    Null, empty and textless pages give an empty text. Unclosed and misnested tags, comments
    and quotes are read on to a defined end. Repeated rows stay; a column of ``pages`` that
    is already called text or n_chars gives way to the new one.
    """
    prepare(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + (", " if keep else "") + "text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, html_col):
            texts = [main_text(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], [*keep, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
