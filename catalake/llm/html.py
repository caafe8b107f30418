"""Main text by template deduction with equivalence classes.

Tokens of a page are its tags, told apart by their path, and its text blocks, told
apart by path and wording. Tokens of a host whose occurrences are equal on every
page form an equivalence class; occurrence vectors are compared by fingerprint sums,
which partial aggregation adds up, so no host's pages meet in one task. A class is
valid if at least half of the host's pages that have tokens, and enough of them, have
it. The valid classes of a host, in page order, are its template: text in it is
boilerplate, and the slots between its tokens hold the page's own text. A page keeps
the text of tokens that stand out of their class's order there. Of the slots, those in
an article (or main) element are the main text; without one, those outside menus,
headers, footers, sidebars, notices, adverts, forms and comments are. Words of a class or id skip no element that holds a main
element, and nothing where they would skip all the text.

Classes nest: an element is on every page that has what it holds, at least as often, so
the class of the element around a class's outermost one is valid too and is its parent.
A class that repeats on a page in a parent that doesn't, holds wording of its own and no
heading, is a list of records (reader comments with their "Reply", teasers). On a page
without a main element the slots in such records are not the main text, unless more than
half of the text of all slots is in them.

Defined results: null and empty pages give empty text. Unclosed elements end with
their parent; stray end tags are ignored. A self-closed svg or math is empty; of elements without an end tag only
those of ``TO_END`` run to the page's end. Repeated pages are extracted alike. A
host with fewer than ``least_pages`` pages with tokens (the support that a class needs,
``LEAST_PAGES`` if not given) has no template, so all its slots stay: two pages don't tell a template from a copy.
Pages without a host share the empty host. An empty table gives no row. Only page_id, url
and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpointed

LEAST_PAGES = 3
#: Up to so many hosts with a template, their templates are broadcast; beyond, pages and templates meet by host in a shuffle.
FRAME_HOSTS = 5000

# Fixed element and attribute word lists.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
#: RAW elements that run to the page's end without an end tag, and those that may be self-closed.
TO_END = frozenset("script style textarea title".split())
FOREIGN = frozenset("svg math".split())
SKIP = frozenset("nav footer aside form script style noscript template button select option input textarea head title svg math iframe object dialog menu".split())
MAIN = frozenset("article main".split())
HEADERS = frozenset("header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
HINTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|menus?|nav\w*|breadcrumbs?|sidebars?|side|footers?|comments?|respond|replies|disqus|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|widgets?|pagination|pager|skip|toolbar|login|search)(?=$|[\s_-]|\d)", re.I)
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSERS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LIST_SCOPE = frozenset("ul ol dl table tbody thead tfoot select".split())

_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<(?:script|style|noscript|template|textarea|title|svg|math|iframe|object)\b[^>]*>|</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>", re.S | re.I)
_NESTED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1(?:[\s/][^>]*)?>|\Z)|<(/?)(noscript|template|svg|math|iframe|object)\b[^>]*>", re.S | re.I)
_ATTRS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_tags: dict[str, tuple] = {}
_paths: dict[tuple[int, str], int] = {}
#: What a token is.
ELEMENT, WORDING, HEADING = 0, 1, 2


def _tag(raw: str) -> tuple[str, bool, str, int]:
    """Name, whether it ends, token, and kind (0 plain, 1 skipped, 2 main, 3 header, 4 skipped by its words only) of a tag as written."""
    t = _tags.get(raw)
    if t is None:
        if len(_tags) > 20_000:
            _tags.clear()
        m = re.match(r"</?([a-zA-Z][^\s/>]*)", raw)
        name = m[1].lower() if m else ""
        end = raw.startswith("</")
        kind, sign = 0, name
        if not end and name:
            attrs = {a.lower(): (v or "").strip("\"'") for a, v in _ATTRS.findall(raw[len(name) + 1 :])} if " " in raw or "\n" in raw else {}
            words = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            sign = f"{name}.{words}" if words else name
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))
            if name in SKIP or hidden or attrs.get("role", "").lower() in ROLES:
                kind = 1
            elif name in MAIN or attrs.get("role", "").lower() == "main" or attrs.get("itemprop") == "articleBody":
                kind = 2
            elif name not in ("html", "body") and words and HINTS.search(words):
                kind = 4
            elif name in HEADERS:
                kind = 3
        t = _tags[raw] = (name, end, sign, kind)
    return t


def _key(token: str) -> int:
    return int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _path(around: int, sign: str) -> int:
    """Token of an element by that of the element around it (0 at the top)."""
    at = _paths.get((around, sign))
    if at is None:
        if len(_paths) > 50_000:
            _paths.clear()
        at = _paths[around, sign] = _key(f"{around}/{sign}")
    return at


def _raw_ends(page: str, end: int) -> dict[int, int]:
    """By the place after the start tag of a RAW element that isn't in TO_END: the place after its own end tag, where it has one."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in _NESTED.finditer(page, 0, end):
        if not m[3]:
            continue
        name = m[3].lower()
        if not m[2]:
            if not (name in FOREIGN and m[0].endswith("/>")):
                open_.setdefault(name, []).append(m.end())
        elif open_.get(name):
            ends[open_[name].pop()] = m.end()
    return ends


def parse(page: str) -> tuple[list[tuple[int, bool, int, str]], list[int], dict[int, tuple[int, int]]]:
    """Blocks (token, in main, skipped: 0 no, 1 by words of class or id only, 2 by an element or role; text), the tokens of blocks and tags in page order, and of each token the element around it (0 at the top) and what it is."""
    blocks: list[tuple[int, bool, int, tuple[int, ...], str]] = []
    tokens: list[int] = []
    about: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int, int, int, bool, tuple[int, ...]]] = []  # name, path, skipped depth, main depth, hinted elements
    path, skipped, main = 0, 0, 0
    hinted: tuple[int, ...] = ()
    wraps: set[int] = set()  # hinted elements that hold a main element, which their hint can't mean
    text: list[str] = []
    raw_ends: dict[int, int] | None = None
    at = 0

    def flush() -> None:
        if text:
            clean = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if clean:
                token = _key(f"{path}\0{clean}")
                blocks.append((token, main > 0, skipped, hinted, clean))
                tokens.append(token)
                about[token] = (path, WORDING)

    def close(k: int) -> None:
        nonlocal path, skipped, main, hinted
        flush()
        del stack[k:]
        path, skipped, main, hinted = (*stack[-1][1:4], stack[-1][5]) if stack else (0, 0, 0, ())

    # Behind the last > nothing but an open comment can be a part; a search that ends there meets an end for each tag that it tries.
    find, n, last = _PARTS.search, len(page), page.rfind(">") + 1
    while at < n:
        m = find(page, at, last) if at < last else None
        if m is None:
            comment = page.find("<!--", at)
            text.append(page[at:] if comment < 0 else page[at:comment])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at, raw = m.end(), m[0]
        if raw[1] in "!?":
            if raw.startswith("<!--") and at == last and (len(raw) < 7 or not raw.endswith("-->")):
                break
            continue
        name, end, sign, kind = _tag(raw)
        if name in RAW and not end:
            if name in TO_END:
                stop = re.compile(rf"</{re.escape(name)}(?:[\s/][^>]*)?>", re.I).search(page, at, last)
                at = stop.end() if stop else n
            elif not (name in FOREIGN and raw.endswith("/>")):
                raw_ends = _raw_ends(page, last) if raw_ends is None else raw_ends
                at = raw_ends.get(at, at)
            if name != "textarea":
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        inline = name in INLINE
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k) if not inline or stack[k][4] else stack.pop(k)
                    break
                if inline and not stack[k][4] and stack[k][0] not in INLINE:
                    break
            continue
        if name in VOID:
            if not inline:
                flush()
            continue
        if inline and kind not in (1, 4):
            continue
        if not inline:
            flush()
            if name in P_CLOSERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in P_CLOSERS or stack[k][0] in ("td", "th", "li", "button"):
                        break
            shut = SELF_CLOSERS.get(name)
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        close(k)
                        break
                    if stack[k][0] in LIST_SCOPE:
                        break
        else:
            flush()
        if raw.endswith("/>"):
            continue
        around, path = path, _path(path, sign)
        # A header inside the main element is its heading; elsewhere it is the site's.
        skipped += kind == 1 or (kind == 3 and not main)
        main += kind == 2
        if kind == 4:
            hinted = (*hinted, len(tokens))
        # An article in an article is a comment or a teaser, and says nothing of what is around it.
        elif kind == 2 and hinted and not (name == "article" and any(e[0] == "article" for e in stack)):
            wraps.update(hinted)
        stack.append((name, path, skipped, main, True, hinted))
        tokens.append(path)
        about[path] = (around, HEADING if name in HEADINGS else ELEMENT)
    flush()
    return [(token, is_main, 2 if deep else int(any(h not in wraps for h in hints)), clean) for token, is_main, deep, hints, clean in blocks], tokens, about


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rsplit("@", 1)[-1].lower() if m else ""


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, token, around, kind, pages, hits, mark1, mark2, rank: partial sums over the pages of a batch. The token 0 stands once on each page that has tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            known: dict[int, tuple[int, int]] = {0: (0, ELEMENT)}
            for page, url, html in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")], strict=True):
                host = _host(url)
                _, tokens, about = parse(html or "")
                known |= about
                seen: dict[int, list[int]] = {0: [1, 0]} if tokens else {}
                for k, key in enumerate(tokens):
                    if key in seen:
                        seen[key][0] += 1
                    else:
                        seen[key] = [1, k]
                h = _key(f"{page}\0{url}")
                m1, m2 = h & 0x7FFFFFFF, (h >> 32) & 0x7FFFFFFF
                for key, (n, rank) in seen.items():
                    s = sums.setdefault((host, key), [0, 0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] += n * m1
                    s[3] += n * m2
                    s[4] += rank
            keys = list(sums)
            cols = list(zip(*sums.values(), strict=True)) if sums else [[]] * 5
            whole = [[k[1] for k in keys], [known[k[1]][0] for k in keys], [known[k[1]][1] for k in keys], *cols]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *[pa.array(c, pa.int64()) for c in whole]], names=["host", "token", "around", "kind", "pages", "hits", "mark1", "mark2", "rank"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "host string, token long, around long, kind long, pages long, hits long, mark1 long, mark2 long, rank long")


def deduce_classes(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Valid equivalence classes: host, class (its fingerprint sums), tokens in page order, pages, frame (every page of the host has its tokens once), repeats (some page has them more than once), labelled (has wording), headed (has a heading), tops (its outermost elements) and arounds (the elements around those).

    Tokens that fewer than half of a host's pages have are slots' own and no template,
    so a class is bounded by twice the longest page.
    """
    sums = [F.sum(c).alias(c) for c in ("pages", "hits", "mark1", "mark2", "rank")]
    # Stored without what too few pages have, which is nearly all of it, as hosts and tokens are both read from it.
    totals = checkpointed(page_tokens(pages).groupBy("host", "token").agg(*sums, F.max("around").alias("around"), F.max("kind").alias("kind")).where(F.col("pages") >= least_pages))
    # The page count of a host travels with its tokens by a window-free join on one row a host.
    hosts = totals.where("token = 0").select("host", F.col("pages").alias("of"), F.col("mark1").alias("frame1"), F.col("mark2").alias("frame2"))
    common = totals.where("token != 0").join(hosts, "host").where("2 * pages >= of")
    classes = common.groupBy("host", "mark1", "mark2").agg(
        F.array_sort(F.collect_list(F.struct((F.col("rank") / F.col("pages")).alias("at"), "token", "around", "kind"))).alias("members"),
        F.max("pages").alias("pages"), F.max((F.col("mark1") == F.col("frame1")) & (F.col("mark2") == F.col("frame2"))).alias("frame"),
        F.max(F.col("hits") > F.col("pages")).alias("repeats"), F.max(F.col("kind") == WORDING).alias("labelled"), F.max(F.col("kind") == HEADING).alias("headed"),
    ).withColumn("own", F.col("members.token"))
    outer = F.filter("members", lambda m: (m["kind"] != WORDING) & ~F.array_contains(F.col("own"), m["around"]))
    return classes.withColumn("outer", outer).select(
        "host", F.struct("mark1", "mark2").alias("class"), F.col("own").alias("tokens"), "pages", "frame", "repeats", "labelled", "headed",
        F.col("outer.token").alias("tops"), F.array_distinct("outer.around").alias("arounds"), F.col("members.at")[0].alias("first"),
    )


def nest_classes(classes: DataFrame) -> DataFrame:
    """Classes with parents (the classes of the elements around their outermost ones, without those at the top) and records: whether each instance is a record of a list that a page has once."""
    owners = classes.select("host", F.col("class").alias("parent"), F.col("repeats").alias("again"), F.explode("tokens").alias("around"))
    places = classes.select("host", "class", F.explode("arounds").alias("around"))
    parents = places.join(owners, ["host", "around"]).groupBy("host", "class").agg(F.collect_set("parent").alias("parents"), F.max("again").alias("in_repeats"))
    records = F.col("repeats") & F.col("labelled") & ~F.col("headed") & ~F.coalesce("in_repeats", F.lit(False)) & (F.size("tops") > 0)
    return classes.join(parents, ["host", "class"], "left").withColumn("records", records).drop("in_repeats")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row a host with valid classes: host, their tokens class by class, how many each class has, and the elements that are records."""
    nested = nest_classes(checkpointed(deduce_classes(pages, least_pages)))
    each = F.array_sort(F.collect_list(F.struct("first", F.col("tokens")[0].alias("tie"), "tokens", F.when(F.col("records"), F.col("tops")).otherwise(F.array().cast("array<bigint>")).alias("tops"))))
    hosts = nested.groupBy("host").agg(each.alias("c"))
    return hosts.select("host", F.flatten("c.tokens").alias("template"), F.transform("c", lambda c: F.size(c["tokens"])).alias("sizes"), F.flatten("c.tops").alias("records"))


def _in_order(places: list[int]) -> set[int]:
    """Indices of a longest run of rising places."""
    if all(a < b for a, b in zip(places, places[1:], strict=False)):
        return set(range(len(places)))
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        if k:
            before[i] = at[k - 1]
        ends[k:] = [p, *ends[k + 1 :]]
        at[k:] = [i, *at[k + 1 :]]
    keep, i = set(), at[-1]
    while i >= 0:
        keep.add(i)
        i = before[i]
    return keep


def boilerplate(tokens: list[int], template: dict[int, tuple[int, int]]) -> set[int]:
    """Tokens of a page that belong to a class of its host and stand in the class's order: once each, or in whole repetitions."""
    on_page: dict[int, tuple[list[int], list[int]]] = {}
    for token in tokens:
        spot = template.get(token)
        if spot:
            places, keys = on_page.setdefault(spot[0], ([], []))
            places.append(spot[1])
            keys.append(token)
    out: set[int] = set()
    for places, keys in on_page.values():
        n = len(set(places))
        if n == len(places):
            out.update(keys[i] for i in _in_order(places))
        elif places == sorted(set(places)) * (len(places) // n):
            out.update(keys)
    return out


def in_records(block: int, about: dict[int, tuple[int, int]], records: frozenset[int], known: dict[int, bool]) -> bool:
    """Whether an element around a block is a record; ``known`` keeps what was found for elements of the page."""
    seen = []
    at = about[block][0]
    while at and at not in known and at not in records:
        seen.append(at)
        at = about[at][0]
    found = at in records or known.get(at, False)
    known.update(dict.fromkeys(seen, found))
    return found


def main_text(page: str | None, template: dict[int, tuple[int, int]], records: frozenset[int] = frozenset()) -> str:
    blocks, tokens, about = parse(page or "")
    has_main = any(b[1] for b in blocks)
    if has_main:
        blocks = [b for b in blocks if b[1]]
    # Where words of class or id skip all there is, they don't count.
    slots = [b for b in blocks if not b[2]] or [b for b in blocks if b[2] == 1]
    own = slots
    if template:
        common = boilerplate(tokens, template)
        own = [b for b in slots if b[0] not in common]
    if records and not has_main:
        known: dict[int, bool] = {}
        rest = [b for b in own if not in_records(b[0], about, records, known)]
        if 2 * sum(len(b[3]) for b in rest) >= sum(len(b[3]) for b in own):
            own = rest
    # Pages that are all one copy have a template that is the article itself.
    return " ".join(b[3] for b in (own or slots))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url and text of every row; other columns are not read."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    pages = pages.select("page_id", "url", "html")
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), "^.*@", ""))
    joined = pages.withColumn("host", host).join(broadcast_if_small(templates(pages, least_pages), FRAME_HOSTS), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[dict[int, tuple[int, int]], frozenset[int]]] = {}
        for batch in batches:
            texts = []
            for page, *parts in zip(batch.column("html").to_pylist(), *[batch.column(c) for c in ("template", "sizes", "records")], strict=True):
                flat, counts, lists = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in parts)
                key = b"|".join([flat.tobytes(), counts.tobytes(), lists.tobytes()])
                if key not in known:
                    if len(known) > 200:
                        known.clear()
                    spots = [(c, k) for c, n in enumerate(counts.tolist()) for k in range(n)]
                    known[key] = (dict(zip(flat.tolist(), spots, strict=True)), frozenset(lists.tolist()))
                texts.append(main_text(page, *known[key]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "template", "sizes", "records").mapInArrow(run, f"page_id {id_type}, url string, text string")
