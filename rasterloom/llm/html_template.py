"""Main text of web pages by template deduction over the pages of a host.

A token is an element in its role, or a text block at its path. A role is the path of tags with the number among like elements
beside it, so the order of roles is that of the page. Its occurrence vector says how often each page of the host holds it; tokens of equal
vectors form an equivalence class. Vectors are compared by their sums of hashes over
the pages, so no host is ever collected: rows are folded before they move. Classes of enough tokens and pages whose paths nest
in one another form the host's template.

The elements of the template are its slots. How much text outside of links the host's pages hold in each tells menus, adverts and
footers from the article: from the root, the slot that holds most of what is around it is entered, until no slot does or the next
one is a text block itself. What lies in the last one is the text, but for blocks that the template holds word by word. A page that
does not follow its host's template, or that has no such host, is read alike on its own. Tags, roles and classes break ties: a slot
marked as article weighs twice, what a page itself marks as navigation, form, advert or comment is left out. Equal
pages count once, and blocks inside an article never are template text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import written

from .text import documents, pieces

MIN_TOKENS, MIN_PAGES, MIN_SHARE = 3, 3, 0.5
#: Elements around everything: they belong to no class and give no scope.
_ROOTS = ("/html", "/body", "/html/body", "/html/head")
#: Template blocks that may be sent to every executor; beyond, pages and templates are joined by host.
BROADCAST_BLOCKS = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"),
}
_SCOPES = frozenset("ul ol dl table td th div article section body main".split())
#: Elements, roles, and whole classes and ids that are not the article; the last also joined with one another or with words of place.
ASIDE_TAGS = frozenset(
    "nav footer aside form button select input label menu dialog svg canvas audio video object search".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus reply replies respond discussion related recommended "
    "share sharing social toolbar pagination pager masthead topbar".split()
)


PLACE_WORDS = frozenset("site page main global primary secondary top bottom left right".split())
#: What readers write can outweigh the article without being it.
REPLY_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())


def _marks(names: str) -> set[str]:
    """The aside words of those classes and ids that consist of nothing else but words of place."""
    out: set[str] = set()
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words <= ASIDE_WORDS | PLACE_WORDS:
            out |= words & ASIDE_WORDS
    return out


#: A slot is entered if it holds this share of the text around it, and left to the page itself if the page has less of its own there.
ENTERED, FOLLOWED = 0.6, 0.1
#: What an article's mark multiplies the text of a slot by.
MARKED = 2
#: Elements that are numbered among their like; of others all are one role.
_NUMBERED = frozenset(
    "article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header main nav ol pre section "
    "table tbody ul".split()
)


#: Elements that can be the slot of a text; others are text blocks or parts of one.
_CONTAINERS = frozenset("article aside blockquote center details div fieldset footer form header main nav section table tbody td tr".split())


def _tag(path: str) -> str:
    return re.split(r"[.\[]", path[path.rfind("/") + 1 :], maxsplit=1)[0]


class Block(NamedTuple):
    path: str
    text: str
    article: bool
    linked: int = 0  # characters inside links


class Mass(NamedTuple):
    """Characters outside of links below an element, those that no other block inside it holds, and whether an article marks it."""

    text: int
    own: int
    marked: int


def masses(blocks: list[Block]) -> dict[str, Mass]:
    """Of all elements around the blocks."""
    sums: dict[str, list[int]] = {}
    for b in blocks:
        size = max(0, len(b.text) - b.linked)
        path, own = b.path, True
        while path:
            found = sums.setdefault(path, [0, 0, 0])
            found[0] += size
            found[1] += size * own
            found[2] += size * b.article
            own = own and _tag(path) not in _BLOCKS
            path = path.rpartition("/")[0]
    # A block's article lies around it: elements above hold other text, too.
    return {p: Mass(text, own, int(2 * marked > text)) for p, (text, own, marked) in sums.items()}


def entered(slots: dict[str, Mass]) -> str:
    """The slot that holds the text: from the root, where most of the text around it lies, down to the last such element."""
    inside: dict[str, list[str]] = {}
    slots = {p: m for p, m in slots.items() if p not in _ROOTS and _tag(p) in _CONTAINERS}
    for path in slots:
        above = path.rpartition("/")[0]
        while above and above not in slots:
            above = above.rpartition("/")[0]
        inside.setdefault(above, []).append(path)
    at = ""
    while True:
        below = inside.get(at, [])
        total = sum(slots[p].text for p in below) if not at else slots[at].text

        def weight(path: str) -> tuple[int, str]:
            return slots[path].text * (MARKED if slots[path].marked else 1), path

        best = max(below, key=weight, default=None)
        if best is None or weight(best)[0] < ENTERED * total or 2 * slots[best].own > slots[best].text or not total:
            return at
        at = best


def within(path: str, slot: str) -> bool:
    return path == slot or path.startswith(f"{slot}/")


def main_blocks(html: str | None, slot: str | None) -> list[Block]:
    """Blocks of the page's text, given the slot of its host's template."""
    blocks, marked, replies, _ = _read(html)
    pairs = list(zip(blocks, marked, strict=True))

    def size(found: list) -> int:
        return sum(max(0, len(b.text) - b.linked) for b, _ in found)

    chosen = [(b, m) for b, m in pairs if slot and within(b.path, slot)]
    if not chosen or size(chosen) < FOLLOWED * size(pairs):
        own = entered(masses(blocks))
        chosen = [(b, m) for b, m in pairs if not own or within(b.path, own)]
    if any(b.article for b in blocks) and not any(b.article for b, _ in chosen):
        chosen = pairs
    return _unmarked([b for b, _ in chosen], [m for _, m in chosen], replies)


def parse(html: str | None) -> tuple[list[Block], Counter]:
    """Text blocks outside of what a page itself marks as not the article, all blocks and elements counted by (path, hash).

    Elements marked by class or id alone are left out only if they do not hold the page's only article or, on pages
    without one, more than half of its text.
    """
    blocks, marked, replies, tokens = _read(html)
    return _unmarked(blocks, marked, replies), tokens


def _read(html: str | None) -> tuple[list[Block], list[tuple[int, ...]], set[int], Counter]:
    """All blocks but those that tags and roles set aside, the elements that mark each, which of these hold replies; and the tokens."""
    tokens: Counter = Counter()
    blocks: list[Block] = []
    marked: list[tuple[int, ...]] = []  # of each block the elements around it that a class or id marks
    replies: set[int] = set()
    if not html:
        return blocks, marked, replies, tokens
    # Tag, path, aside, article, marked elements; whether a link is around, and how many of each kind are inside.
    stack: list[tuple[str, str, bool, bool, tuple[int, ...], bool, Counter]] = []
    parts: list[tuple[str, tuple]] = []  # text and the element around it
    at, n, opened = 0, len(html), 0
    page = ("", "", False, False, (), False, Counter())

    def inner() -> tuple:
        return stack[-1] if stack else page

    def flush() -> None:
        # Inline elements that are set aside are blocks of their own; the text around them stays one block.
        groups: dict[tuple, list[tuple[str, tuple]]] = {}
        for part in parts:
            groups.setdefault(part[1][2:5], []).append(part)
        parts.clear()
        top = inner()
        for state, found in groups.items():
            text = " ".join(unescape("".join(p[0] for p in found)).split())
            if text:
                path = (top if state == top[2:5] else found[0][1])[1]
                linked = sum(len(p[0].strip()) for p in found if p[1][5])
                aside, article, marks = state
                tokens[path, xxhash.xxh64_intdigest(text.encode()) >> 1] += 1
                if not aside:
                    blocks.append(Block(path, text, article, linked))
                    marked.append(marks)

    while at < n:
        found = _TOKEN.search(html, at)
        if found is None:
            parts.append((html[at:], inner()))
            break
        parts.append((html[at : found.start()], inner()))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[0] in _BLOCKS for s in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if tag == "br":
            parts.append((" ", inner()))
            continue
        if tag in _BLOCKS:
            flush()
            closing = _CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or name in closing:
                    del stack[k:]
                    break
                if name in _SCOPES:
                    break
        if tag in _RAW:
            closed = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = closed.end() if closed else n
            continue
        if tag in _VOID:
            continue
        _, above, aside, article, marks, link, like = inner()
        name, label = tag, ""
        if found[3].strip():
            known = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(found[3])}
            label = known.get("class", "")
            words = _marks(f"{label} {known.get('id', '')}")
            role = known.get("role", "").lower()
            if words and tag not in ("html", "body", "main"):
                opened += 1
                marks = (*marks, opened)
                if words & REPLY_WORDS:
                    replies.add(opened)
            aside |= role in ASIDE_ROLES or "hidden" in found[3].lower().split() or known.get("aria-hidden") == "true"
            article |= role == "main" or known.get("itemprop") == "articleBody"
            name = f"{tag}.{label.split()[0]}" if label.split() else tag
        aside |= tag in ASIDE_TAGS or (tag == "header" and not article) or tag == "head"
        article |= tag in ("article", "main")
        if tag in _NUMBERED:
            like[name] += 1
            name = f"{name}[{like[name]}]"
        path = f"{above}/{name}"
        tokens[path, 0] += 1
        stack.append((tag, path, aside, article, marks, link or tag == "a", Counter()))
        if found[3].endswith("/") and tag == "svg":
            stack.pop()
    flush()
    return blocks, marked, replies, tokens


def _unmarked(blocks: list[Block], marked: list[tuple[int, ...]], replies: set[int]) -> list[Block]:
    """The blocks of the article, else of the page, outside of marked elements that may be set aside."""
    pairs = list(zip(blocks, marked, strict=True))
    inside = [(b, m) for b, m in pairs if b.article]
    pairs = inside or pairs
    if not any(m for _, m in pairs):
        return [b for b, _ in pairs]
    sizes: Counter = Counter()
    for b, m in pairs:
        sizes.update(dict.fromkeys(m, len(b.text)))
    half = sum(len(b.text) for b, _ in pairs) / 2
    kept = {k for k, size in sizes.items() if size > half and k not in replies}
    found = [b for b, m in pairs if kept.issuperset(m)]
    # Where all is marked, the outermost mark is a wrapper's.
    return found or _unmarked([b for b, _ in pairs], [m[1:] for _, m in pairs], replies)


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return documents(pages, id_col, html_col, url_col).select(
        "doc_id", F.col(url_col).cast("string").alias("url"), "text"
    ).withColumn("host", F.xxhash64(host))


_SEEN = "host long, path string, token long, page long, times int, text long, own long, marked int"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
        for host, html in zip(part.column("host").to_pylist(), part.column("text").to_pylist(), strict=True):
            blocks, _, _, tokens = _read(html)
            mass = masses(blocks)
            page = xxhash.xxh64_intdigest(repr(sorted(tokens.items())).encode()) >> 1
            for (path, token), times in tokens.items():
                held = (mass.get(path) if not token else None) or (0, 0, 0)
                for column, value in zip(out, (host, path, token, page, times, *held), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        names = ["host", "path", "token", "page", "times", "text", "own", "marked"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def _nest(classes: pd.DataFrame) -> pd.DataFrame:
    """Classes of a host that nest: the widest is the root, each other lies inside the paths of a kept wider one."""
    kept: list[str] = []
    chosen = []
    ordered = classes.sort_values(["pages", "size", "v1"], ascending=[False, False, True])
    for row in ordered.itertuples(index=False):
        # Of whole names: /a/b lies inside /a, not inside /a/bc.
        names = commonprefix([row.low.split("/"), row.high.split("/")])
        scope = "/".join([*names[: min(len(names), row.low.count("/"))], ""])
        if not kept or any(scope.startswith(k) for k in kept):
            kept.append(scope)
            chosen.append((row.host, row.v1, row.v2))
    return pd.DataFrame(chosen, columns=["host", "v1", "v2"])


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, token, pages, share, text, own, marked``: the elements (token 0) and text blocks of each host's template (host and
    token as hashes), with the characters outside of links that the pages hold in an element, those of its own blocks, and on
    how many pages an article marks it."""
    rows = _rows(pages, id_col, url_col, html_col).select("host", "text")
    # Copies of a page do not vote; their hashes are compared, not their texts.
    seen = rows.mapInArrow(_tokens, _SEEN)
    mark = F.xxhash64("page", "times")
    # Two 32-bit sums tell occurrence vectors apart and cannot overflow.
    vectors = written(
        seen.distinct()
        .groupBy("host", "path", "token")
        .agg(
            F.count("*").alias("pages"),
            F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v1"),
            F.sum(F.shiftrightunsigned(mark, 32)).alias("v2"),
            *[F.sum(c).alias(c) for c in ("text", "own", "marked")],
        )
        .where(F.col("pages") >= MIN_PAGES),
        "page-vectors",
    )
    # The element at the root stands in every page, so the widest token counts the host's pages.
    hosts = vectors.groupBy("host").agg(F.max("pages").alias("host_pages"))
    wide = vectors.join(hosts, "host").where(F.col("pages") >= MIN_SHARE * F.col("host_pages"))
    wide = wide.where(~F.col("path").isin(*_ROOTS))
    classes = (
        wide.groupBy("host", "v1", "v2", "pages")
        .agg(F.count("*").alias("size"), F.min("path").alias("low"), F.max("path").alias("high"))
        .where(F.col("size") >= MIN_TOKENS)
    )
    # A host has at most twice as many such tokens as its mean page, so its classes are few.
    valid = classes.groupBy("host").applyInPandas(_nest, "host long, v1 long, v2 long")
    return wide.join(valid, ["host", "v1", "v2"]).select(
        "host", "path", "token", "pages", (F.col("pages") / F.col("host_pages")).alias("share"), "text", "own", "marked"
    )


def _slot(host: pd.DataFrame) -> pd.DataFrame:
    """The slot of a host's text. A host's template has about as many elements as its pages have."""
    found = zip(*[host[c] for c in ("path", "text", "own", "marked", "pages")], strict=True)
    slots = {p: Mass(int(text), int(own), int(2 * marked > pages)) for p, text, own, marked, pages in found}
    return pd.DataFrame({"host": host["host"].iloc[:1], "slot": [entered(slots)]})


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: blocks of the main text in page order, joined by a blank line.

    Null and empty pages have the empty text, and so have pages of template blocks alone. Null urls count as one host.
    Repeated rows come back once each. Empty tables give none.
    """
    found = written(templates(pages, id_col, url_col, html_col), "page-templates")
    texts = found.where("token <> 0").groupBy("host").agg(F.collect_list(F.struct("path", "token")).alias("template"))
    slots = found.where("token = 0").groupBy("host").applyInPandas(_slot, "host long, slot string")
    blocks = written(slots.join(texts, "host", "full_outer"), "page-slots")
    if found.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    rows = _rows(pages, id_col, url_col, html_col).join(blocks, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            texts = []
            known: dict[int, set] = {}
            hosts, places = part.column("host").to_pylist(), part.column("slot").to_pylist()
            for k, html in enumerate(part.column("text").to_pylist()):
                if hosts[k] not in known:
                    rows = part.column("template")[k].as_py() or []
                    known[hosts[k]] = {(r["path"], r["token"]) for r in rows}
                outside = known[hosts[k]]
                slots = [
                    b.text
                    for b in main_blocks(html, places[k])
                    if b.article or (b.path, xxhash.xxh64_intdigest(b.text.encode()) >> 1) not in outside
                ]
                texts.append("\n\n".join(slots))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("url"), pa.array(texts, pa.string())], names=[id_col, "url", "text"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select("doc_id", "url", "text", "host", "template", "slot").mapInArrow(run, f"`{id_col}` {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
