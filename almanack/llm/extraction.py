"""Main text of web pages by template deduction from equivalence classes.

Every tag, told apart by the elements it is nested in, is a token. For each host the pages on
which a token occurs, and how often, are its occurrence vector; tokens with equal vectors are
one equivalence class. Classes that cover half of a host's pages or more and hold several
tokens are valid: together, nested as their paths are, they are the template. Text lies in the
slots between them. A slot whose text is the same on half of the pages or more, and on all that
have it, is template too, inside articles as well; only a first heading stays. Of the others the
slot with the most changing text is kept, with all of the article or main element that it stands
in, or else all below it. Article and main elements alone decide where a host has too few pages
for that, and on pages that lack the host's slot. Blocks inside menus, headers, footers, sidebars,
adverts, forms and comments belong to no slot: by element, or by a class, id or role that as a
whole says so (``comment-list``, not ``comment-policy``). Names of notices, banners, related and
social parts are doubtful: such a block is left out where the host's pages confirm it, by text
that is always the same or that stands mostly in links, and kept otherwise.

Elements nested deeper than ``DEPTH`` are told apart by a digest of what they stand in, so that a
path's length is bounded; they are slots like any other, but count as next to, not below, each other.

A host's vectors are kept as sums, so a host with very many pages needs no more room than one
with few, and its pages are never brought together.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle, slices

#: Pages a host must have for a template to be deduced.
LEAST_PAGES = 3
#: Hosts above which decisions are joined by a shuffle, not broadcast.
MOST_BROADCAST = 20_000
DEPTH = 64

_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|select|svg|object|title)\b"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?>[^>"']+|"[^"]*"|'[^']*')*+)>""",
    re.S | re.I,
)
_OPENING = re.compile(r"""<[a-zA-Z]++(?>[^>"']+|"[^"]*"|'[^']*')*+>""")
_CLOSING = {k: re.compile(rf"</{k}\s*>", re.I) for k in "script style noscript template iframe textarea select svg object title".split()}
#: What hides the rest of a page if it is never closed, and what may close itself.
TO_END = set("script style textarea title".split())
SELF_CLOSED = {"svg", "object"}
_CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav header footer aside form button head menu dialog input".split())
MARKED = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs header footer masthead comment comments disqus replies respond share sharing newsletter subscribe signup login "
    "popup modal toolbar pager pagination".split()
)
#: What the template of the host has to confirm.
DOUBTFUL = set("notice notices alert banner social related recommended promo promotion overlay widget".split())
#: What says where or how something stands, not what it is.
PLACING = set(
    "site page main top bottom left right primary secondary mobile list section area box container wrapper wrap block bar thread links "
    "items item inner slot unit form holder panel column col row group".split()
)
ARTICLE = {"article", "main"}
OWN_HEADER = {"header", "masthead"}
#: What tells the element that holds the page from one that holds a sidebar or comments.
PAGE_PARTS = set("h1 nav header footer main".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())


def _says(name: list[str], what: set[str], also: set[str] = frozenset()) -> bool:
    """Whether all words of a name tell what something is or where it stands, and one of them is of ``what``."""
    return any(w in what for w in name) and all(w in what or w in also or w in PLACING or w.isdigit() for w in name)


def _marks(attributes: str, inside: bool = False) -> tuple[str, bool, bool]:
    """The element's class, id and role words as one name, whether it is boilerplate by them, and whether it may be.

    Inside an article a header is the article's own.
    """
    names = [[w for w in re.split(r"[^a-z0-9]+", n) if w] for m in _CLASS.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split()]
    marked = any(_says(n, MARKED, DOUBTFUL) and not (inside and set(n) & OWN_HEADER) for n in names)
    return ".".join(w for n in names for w in n if not w.isdigit()), marked, any(_says(n, DOUBTFUL) for n in names)


class Block(NamedTuple):
    path: str
    inside: bool  # an article
    linked: int  # characters that stand in links
    doubtful: bool
    text: str


def _scan(page: str) -> Iterator[tuple[re.Match, int]]:
    """Tags, comments and raw elements, each with its end."""
    at, unclosed = 0, set()
    while m := _SCAN.search(page, at):
        at = m.end()
        if m["raw"]:
            raw = m["raw"].lower()
            opening = _OPENING.match(page, m.start())
            if raw in SELF_CLOSED and opening and opening[0].endswith("/>"):
                at = opening.end()
            elif raw not in unclosed and (closing := _CLOSING[raw].search(page, at)):
                at = closing.end()
            elif raw in TO_END:
                at = len(page)
            else:
                unclosed.add(raw)
                at = opening.end() if opening else at
        yield m, at


def parse(page: str) -> tuple[list[str], list[Block]]:
    """(tokens, blocks) of a page.

    Never fails: unknown or unclosed tags are taken as they come, and a closing tag closes what
    is open above its element. Boilerplate left open ends where an article begins. A class word
    marks no element that holds parts of a page and more text than is outside of it.
    """
    tokens: list[str] = []
    blocks: list[tuple[Block, int]] = []  # the last: the marked element around it, 0 for none
    stack: list[tuple[str, str, bool, int, bool]] = []  # name, path, inside an article, inside boilerplate: the marked element or -1, doubtful
    holds = [False]  # for each marked element, whether it holds parts of a page
    held: list[str] = []
    at, linked, in_link = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            _, path, inside, skipped, doubtful = stack[-1] if stack else ("", "", False, 0, False)
            if skipped >= 0 and (text := " ".join(entities.unescape("".join(held)).split())):
                blocks.append((Block(path, inside, min(linked, len(text)), doubtful, text), skipped))
            held.clear()
        linked = 0

    for m, end in _scan(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            linked += in_link * (m.start() - at)
        at = end
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name == "a":
            in_link = not m["close"]
        if name in INLINE and name not in VOID:
            continue
        if name == "img" or name == "wbr":
            continue
        flush()
        if m["close"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                tokens.append(stack[depth][1] + "/")
                del stack[depth:]
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if name == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        if name in ARTICLE:
            while stack and stack[-1][3] and not stack[-1][2]:
                stack.pop()
        _, above, inside, skipped, doubtful = stack[-1] if stack else ("", "", False, 0, False)
        inside = inside or name in ARTICLE
        words, marked, may_be = _marks(m["attributes"], inside)
        if skipped > 0 and name in PAGE_PARTS:
            holds[skipped] = True
        if name not in ARTICLE and name not in ("html", "body"):
            if name in BOILERPLATE and not (name == "header" and inside) or marked and skipped:
                skipped = -1
            elif marked:
                holds.append(False)
                skipped = len(holds) - 1
                doubtful = False
            elif may_be:
                doubtful = True
        path = f"{above}/{name}{'.' + words if words else ''}"
        if len(stack) >= DEPTH:
            path = f"{stack[DEPTH - 1][1]}/#{_hash(above):016x}/{name}{'.' + words if words else ''}"
        stack.append((name, path, inside, skipped, doubtful))
        tokens.append(path)
    held.append(page[at:])
    linked += in_link * (len(page) - at)
    flush()
    chars = [0] * len(holds)
    for block, mark in blocks:
        chars[mark] += len(block.text)
    kept = {0} | {k for k in range(1, len(holds)) if holds[k] and chars[k] > chars[0]}
    return tokens, [block for block, mark in blocks if mark in kept]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))


# ---- template -------------------------------------------------------------------------------

SEEN = "host string, kind string, token string, pages long, vector_x long, vector_s long, chars long, least long, most long"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a batch by host and token, by host and slot, and by host and repeated text."""
    for batch in slices(batches, "html"):
        seen: dict[tuple[str, str, str], list[int]] = {}

        def add(host: str, kind: str, token: str, vector: int, chars: int, text: int) -> None:
            row = seen.setdefault((host, kind, token), [0, 0, 0, 0, text, text])  # noqa: B023
            row[0] += 1
            row[1] ^= vector
            row[2] += vector & 0xFFFFFFFF
            row[3] += chars
            row[4], row[5] = min(row[4], text), max(row[5], text)

        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host, page = host_of(url), page or ""
            tokens, blocks = parse(page)
            own = _hash(url, len(page), page[:64], page[-64:])
            add(host, "host", "", own, 0, 0)
            counts: dict[str, int] = {}
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
            for t, n in counts.items():
                add(host, "token", t, _hash(own, n), 0, 0)
            slots: dict[str, list] = {}
            doubts: dict[str, list[int]] = {}
            for path, inside, linked, doubtful, text in blocks:
                slot = slots.setdefault(("+" if inside else "-") + path, [0, []])
                slot[0] += len(text)
                slot[1].append(text)
                if doubtful:
                    doubt = doubts.setdefault(path, [0, 0])
                    doubt[0] += len(text)
                    doubt[1] += linked
            for path, (chars, texts) in slots.items():
                add(host, "slot", path, 0, chars, _hash(*texts) >> 1)
            for path, (chars, linked) in doubts.items():
                add(host, "doubt", path, linked, chars, 0)  # the vector's sum counts linked characters
        keys = list(seen)
        sums = list(zip(*seen.values()))
        signed = [x - (1 << 64) if x >> 63 else x for x in sums[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(c, pa.int64()) for c in (sums[0], signed, *sums[2:])],
            ["host", "kind", "token", "pages", "vector_x", "vector_s", "chars", "least", "most"],
        )


FIRST_HEADING = r"/h1[^/]*$"


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template, decisions): tokens in valid classes, and per host what is kept.

    ``template``: host, token, class (the occurrence vector), pages. ``decisions``: host,
    ``container`` (the path that is kept), ``fixed`` (the slots that are template).
    """
    seen = settle(
        pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
        .mapInArrow(_observe, SEEN)
        .groupBy("host", "kind", "token")
        .agg(
            F.sum("pages").alias("pages"), F.expr("bit_xor(vector_x)").alias("vector_x"), F.sum("vector_s").alias("vector_s"),
            F.sum("chars").alias("chars"), F.min("least").alias("least"), F.max("most").alias("most"),
        )
    )
    hosts = seen.where("kind = 'host'").select("host", F.col("pages").alias("all_pages"))
    tokens = seen.where("kind = 'token'")
    classes = tokens.groupBy("host", "pages", "vector_x", "vector_s").agg(F.count(F.lit(1)).alias("tokens"))
    valid = classes.join(hosts, "host").where((F.col("all_pages") >= LEAST_PAGES) & (2 * F.col("pages") >= F.col("all_pages")) & (F.col("tokens") > 1))
    template = tokens.join(valid.select("host", "pages", "vector_x", "vector_s"), ["host", "pages", "vector_x", "vector_s"]).select(
        "host", "token", F.struct("pages", "vector_x", "vector_s").alias("class"), "pages"
    )
    slots = seen.where("kind = 'slot'").select("host", F.substring("token", 1, 1).alias("side"), F.expr("substring(token, 2)").alias("token"), "pages", "chars", "least", "most")
    changing = slots.where((F.col("pages") < LEAST_PAGES) | (F.col("least") != F.col("most")))
    framed = changing.join(template.select("host", "token", F.lit(True).alias("framed")), ["host", "token"], "left")
    # an article's own frame is no weaker than that of a slot outside, so articles break ties only
    best = framed.groupBy("host").agg(
        F.max(F.col("side") == "+").alias("_article"),
        F.max_by("token", F.struct(F.coalesce("framed", F.lit(False)), F.col("chars"), F.col("side") == "+", F.col("token"))).alias("container"),
    )
    constant = slots.join(hosts, "host").where((F.col("pages") >= LEAST_PAGES) & (2 * F.col("pages") >= F.col("all_pages")) & (F.col("least") == F.col("most")))
    linked = seen.where(F.col("kind") == "doubt").where((F.col("pages") >= LEAST_PAGES) & (2 * F.col("vector_s") >= F.col("chars")))
    known = constant.where(~F.col("token").rlike(FIRST_HEADING)).select("host", "token").unionByName(linked.select("host", "token"))
    fixed = known.groupBy("host").agg(F.collect_set("token").alias("fixed"))
    decided = best.join(hosts, "host").where((F.col("all_pages") >= LEAST_PAGES) | ~F.col("_article")).select("host", "container")
    decisions = decided.join(fixed, "host", "left")
    return template, decisions


# ---- extraction -----------------------------------------------------------------------------


_ARTICLE_PATH = re.compile(r".*?/(?:article|main)(?=[./]|\Z)[^/]*")


def main_blocks(page: str, container: str | None, fixed: list[str] | None = None) -> list[str]:
    """Kept blocks of one page, in page order.

    Without a container, or where the page has nothing of it, the page's articles decide, and
    without those every block that isn't boilerplate stays.
    """
    _, blocks = parse(page)
    if container is not None:
        same = set(fixed or ())
        blocks = [b for b in blocks if b.path not in same]
        # a paragraph's siblings of another kind belong to the same slot, and so does the whole article
        if article := _ARTICLE_PATH.match(container):
            above = article[0]
        else:
            above = container.rsplit("/", 1)[0] if re.search(r"/(p|h[1-6]|li|pre|blockquote)[^/]*$", container) else container
        if kept := [b.text for b in blocks if b.path == container or b.path.startswith(above + "/") or b.path == above]:
            return kept
    if any(b.inside for b in blocks):
        return [b.text for b in blocks if b.inside]
    return [b.text for b in blocks]


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row: blocks joined by a line feed, empty if there are none.

    Character references are decoded and white space inside a block becomes one space. A null
    page counts as empty, a null or broken url as a host of its own kind.
    """
    _, decisions = templates(pages)
    decided = settle(decisions)
    few = decided.count() <= MOST_BROADCAST
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    @F.pandas_udf("string")
    def host(urls):
        return urls.map(host_of, na_action=None)

    with_host = rows.withColumn("host", host("url")) if not few else None

    if few:
        # one small row per host, by a checked count
        known = {r["host"]: (r["container"], r["fixed"]) for r in decided.collect()}

        def run(batches):
            for batch in slices(batches, "html"):
                urls = batch.column("url").to_pylist()
                texts = [
                    "\n".join(main_blocks(page or "", *known.get(host_of(url), (None, None))))
                    for url, page in zip(urls, batch.column("html").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return rows.mapInArrow(run, "page_id long, url string, text string")

    def run_joined(batches):
        for batch in slices(batches, "html"):
            texts = [
                "\n".join(main_blocks(page or "", container, fixed))
                for page, container, fixed in zip(*(batch.column(k).to_pylist() for k in ("html", "container", "fixed")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return with_host.join(decided, "host", "left").select("page_id", "url", "html", "container", "fixed").mapInArrow(run_joined, "page_id long, url string, text string")
