"""HTML extraction by wrappers: union-free expressions inferred from pages of one host.

A page is a tree of elements over its token stream. The wrapper of a host is what its pages have
in common: a tree whose children are aligned page by page. A child that some pages lack becomes
optional, neighbours that repeat become a repeated group, and text that differs becomes a slot;
text that is the same on all pages stays part of the template. Wrappers of parts of a host are
merged the same way, so they are inferred where the pages lie and merged in a tree. The roles of a
wrapper's places (template, menu, content) then say which text of each page is the article.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Names of elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output "
    "progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form script style noscript template textarea title head button select "
                      "menu dialog iframe svg canvas object audio video fieldset legend datalist".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body html nav main aside footer header form".split())
# words of a class, id or role that mark what isn't the article
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond "
    "disqus share sharing social related recommended recommendations pagination pager widget widgets skip contentinfo "
    "complementary search form hidden copyright legal disclaimer".split())
HEADERS = frozenset("header banner masthead".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[A-Za-z]+")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
# pages of a host from which on text that never differs counts as part of the template
LEAST_PAGES = 5
LINKED = 0.5  # share of text in links from which on a place is a list of links
# roles up to this many bytes are broadcast; more are joined by host and salt
BROADCAST_BYTES = 32 << 20
SALTS = 32


def _signature(name: str, attrs: str) -> tuple[str, bool]:
    """(name with its class words, whether it marks furniture)."""
    if not attrs or attrs.isspace():
        return name, name in FURNITURE
    words, mark = [], name in FURNITURE
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            # words with digits are numbers of a page, not of the template
            words += [w for w in value.split() if not any(c.isdigit() for c in w)] if key == "class" else []
            found = {w.lower() for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))}
            mark = mark or bool(found & MARKS) and name not in MAIN and name not in ("body", "html")
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            mark = True
    return ".".join([name, *sorted(set(words))]), mark


def parse(html: str) -> Iterator[tuple[str, str, str | bool]]:
    """Events of a page: (open, signature, furniture), (close, signature, ""), (text, raw, "").

    Void and unknown elements need no end; ends that are missing are implied, as browsers do for
    paragraphs, list items and cells; ends without a start are ignored.
    """
    stack: list[str] = []
    names: list[str] = []
    for m in TOKEN.finditer(html):
        text = m[5]
        if text is not None:
            yield "text", text, ""
            continue
        if m[3] is None:
            continue  # comments, declarations and raw elements
        name = m[3].lower()
        if m[2]:
            if name in names:
                # an inline end doesn't close blocks around it
                at = len(names) - 1 - names[::-1].index(name)
                if name in INLINE and any(n not in INLINE for n in names[at + 1:]):
                    continue
                while len(names) > at:
                    names.pop()
                    yield "close", stack.pop(), ""
            continue
        closing = ("p",) if name in CLOSES_P else SAME_CLOSES.get(name, ())
        for at in range(len(names) - 1, -1, -1):
            if names[at] in closing:
                while len(names) > at:
                    names.pop()
                    yield "close", stack.pop(), ""
                break
            if names[at] in SCOPES:
                break
        sig, mark = _signature(name, m[4])
        yield "open", sig, mark
        if name in VOID or m[4].endswith("/") and name not in INLINE and name not in CLOSES_P:
            yield "close", sig, ""
        else:
            names.append(name)
            stack.append(sig)
    while stack:
        yield "close", stack.pop(), ""


# A wrapper node: [signature, flags, kids, text, pages, chars, linked]. flags: "" needed, "?" optional,
# "+" repeated, "*" both. text of a "#text" node: the text if it never differed, else null (a slot).
SIG, FLAGS, KIDS, TEXT, PAGES, CHARS, LINKS = range(7)


def _node(sig: str) -> list:
    return [sig, "", [], "", 1, 0, 0]


def _flag(a: str, more: str) -> str:
    """Flags with one more: optional and repeated together are "*"."""
    have = {"": set(), "?": {"?"}, "+": {"+"}, "*": {"?", "+"}}
    both = have[a] | have[more]
    return {0: "", 2: "*"}.get(len(both)) if len(both) != 1 else both.pop()


def fold(kids: list[list]) -> list[list]:
    """Neighbours that repeat as repeated groups: runs of one signature, then runs of two or three."""
    out: list[list] = []
    for k in kids:
        if out and out[-1][SIG] == k[SIG]:
            out[-1] = merge(out[-1], k)
            out[-1][FLAGS] = _flag(out[-1][FLAGS], "+")
        else:
            out.append(k)
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            if all(out[i + j][SIG] == out[i + size + j][SIG] for j in range(size)):
                for j in range(size):
                    out[i + j] = merge(out[i + j], out[i + size + j])
                    out[i + j][FLAGS] = _flag(out[i + j][FLAGS], "+")
                del out[i + size:i + 2 * size]
            else:
                i += 1
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """Two lists of children as one: equal signatures in order meet (longest common
    subsequence), all others become optional where they stand."""
    n, m = len(a), len(b)
    if [x[SIG] for x in a] == [x[SIG] for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][SIG] == b[j][SIG] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][SIG] == b[j][SIG]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i])
            a[i][FLAGS], i = _flag(a[i][FLAGS], "?"), i + 1
        else:
            out.append(b[j])
            b[j][FLAGS], j = _flag(b[j][FLAGS], "?"), j + 1
    return fold(out)


def merge(a: list, b: list) -> list:
    """Two nodes of one signature as one."""
    flags = _flag(a[FLAGS], b[FLAGS])
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    return [a[SIG], flags, align(a[KIDS], b[KIDS]), text, a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS]]


def tree(html: str) -> list:
    """A page as a wrapper of its own."""
    root = _node("")
    path, links = [root], 0
    for kind, what, _ in parse(html):
        if kind == "open":
            path.append(_node(what))
            links += what.split(".")[0] == "a"
        elif kind == "close":
            done = path.pop()
            links -= what.split(".")[0] == "a"
            done[KIDS] = fold(done[KIDS])
            path[-1][KIDS].append(done)
        elif not what.isspace():
            leaf = _node("#text")
            text = " ".join(what.split())
            leaf[TEXT], leaf[CHARS], leaf[LINKS] = text, len(text), len(text) if links else 0
            # a slot that differs needs no more than a sign that it does
            path[-1][KIDS].append(leaf)
    root[KIDS] = fold(root[KIDS])
    return root


def _slim(text: str) -> str:
    """A long text by its hash."""
    return text if len(text) <= 64 else "#" + hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()


def slim(node: list) -> list:
    """Long constant texts by their hash, so that a wrapper stays small."""
    if node[TEXT]:
        node[TEXT] = _slim(node[TEXT])
    for k in node[KIDS]:
        slim(k)
    return node


# A place of a wrapper as its pages need it: [signature, dropped, text, kids, texts]. kids only where a place
# below is dropped; texts: the dropped texts below.
DROP, PLACE_TEXT, PLACES, TEXTS = range(1, 5)


def roles(wrapper: list) -> dict:
    """{"drop": places, "main": paths} of a wrapper; a path is the signatures from the root on.

    Dropped are places that hold the same text on all of LEAST_PAGES pages or more, and places
    outside the main element whose text is mostly links. They are nodes of the wrapper, not paths: of
    places with one path some may be dropped (null: none is). Main is, where a host has no article
    and main elements, the smallest element that holds most of the text that differs.
    """
    dropped: set[int] = set()
    mass: list[tuple[int, str, int, str]] = []
    any_main = False

    def walk(node, path, inside):
        nonlocal any_main
        name = node[SIG].split(".")[0]
        here = f"{path}/{node[SIG]}" if path or node[SIG] else ""
        any_main = any_main or name in MAIN
        inside = inside or name in MAIN
        if name in FURNITURE or {w.lower() for w in WORD.findall(node[SIG])[1:]} & MARKS and name not in MAIN:
            return 0, 0, 0
        if node[SIG] == "#text":
            if not inside and node[PAGES] >= LEAST_PAGES and node[TEXT]:
                dropped.add(id(node))
                return 0, 0, 0
            return node[CHARS], node[LINKS], 0 if node[TEXT] else node[CHARS]
        chars = links = varying = 0
        for k in node[KIDS]:
            c, li, v = walk(k, here, inside)
            chars, links, varying = chars + c, links + li, varying + v
        if not inside and name in ("ul", "ol", "div", "section", "table", "p") and chars and links > LINKED * chars:
            dropped.add(id(node))
            return 0, 0, 0
        mass.append((here.count("/"), here, varying, name))
        return chars, links, varying

    _, _, total = walk(wrapper, "", False)
    main = []
    if not any_main and total and wrapper[PAGES] >= LEAST_PAGES:
        good = [(depth, path) for depth, path, v, name in mass
                if path and 2 * v > total and name not in INLINE | {"p", "li", "td"}]
        main = [max(good)[1]] if good else []

    def places(node):
        gone = id(node) in dropped
        kids = [] if gone else [places(k) for k in node[KIDS]]
        text = node[TEXT] if gone and node[SIG] == "#text" else None
        texts = sorted({text} if text else {t for k in kids for t in k[TEXTS]})
        return [node[SIG], gone, text, kids if any(k[DROP] or k[PLACES] for k in kids) else [], texts]

    return {"drop": places(wrapper) if dropped else None, "main": main}


def _folded(kids: list[list]) -> list[list[list]]:
    """Children of a page's element as groups, as ``fold`` makes them of a wrapper's."""
    out: list[list[list]] = []
    for k in kids:
        if out and out[-1][0][0] == k[0]:
            out[-1].append(k)
        else:
            out.append([k])
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            if all(out[i + j][0][0] == out[i + size + j][0][0] for j in range(size)):
                for j in range(size):
                    out[i + j] += out[i + size + j]
                del out[i + size:i + 2 * size]
            else:
                i += 1
    return out


def _texts(node: list) -> set[str]:
    sig, kids, text = node[:3]
    return {_slim(text)} if sig == "#text" else set().union(*map(_texts, kids))


def _fits(group: list[list], place: list) -> int:
    """How well a group of a page's children fits a place (0: not at all). That signatures agree
    counts most, then dropped texts, then the share of links."""
    if group[0][0] != place[SIG]:
        return 0
    if place[PLACE_TEXT] is not None:
        return 64 if all(_slim(k[2]) == place[PLACE_TEXT] for k in group) else 0
    linked = sum(k[5] for k in group) > LINKED * sum(k[4] for k in group)
    seen = 2 if not place[TEXTS] else 4 * any(_texts(k) & set(place[TEXTS]) for k in group)
    return 64 + seen + (linked == place[DROP])


def located(events: list[tuple], found: list) -> set[int]:
    """The dropped elements and texts of a page, by the index of their event: its children are
    aligned with the places of the wrapper as pages are with each other."""
    # [signature, kids, text, event, chars, characters in links]
    root = ["", [], None, -1, 0, 0]
    stack, links = [root], 0
    for i, (kind, what, _) in enumerate(events):
        if kind == "open":
            stack.append([what, [], None, i, 0, 0])
            links += what.split(".")[0] == "a"
        elif kind == "close":
            done = stack.pop()
            links -= what.split(".")[0] == "a"
            up = stack[-1]
            up[1].append(done)
            up[4], up[5] = up[4] + done[4], up[5] + done[5]
        elif not what.isspace():
            text = " ".join(what.split())
            n, up = len(text), stack[-1]
            up[1].append(["#text", [], text, i, n, n if links else 0])
            up[4], up[5] = up[4] + n, up[5] + (n if links else 0)
    gone: set[int] = set()
    todo = [(root, found)]
    while todo:
        node, place = todo.pop()
        if place[DROP]:
            gone.add(node[3])
        groups, places = _folded(node[1]) if place[PLACES] else [], place[PLACES]
        n, m = len(groups), len(places)
        fit = [[_fits(g, p) for p in places] for g in groups]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + fit[i][j])
        i = j = 0
        while i < n and j < m:
            if fit[i][j] and best[i][j] == best[i + 1][j + 1] + fit[i][j]:
                todo += [(k, places[j]) for k in groups[i]]
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return gone


def article(html: str | None, found: dict | None) -> str:
    """The main text of a page by the roles of its host's wrapper (none: of the page alone).

    Blocks in order, joined by one \\n; white space in a block is one space. Where a page lacks the
    main element of its host, all text outside furniture and template counts.
    """
    if not html:
        return ""
    events = list(parse(html))
    found = found or {"drop": None, "main": []}
    drop, main = located(events, found["drop"]) if found["drop"] else (), set(found["main"])
    blocks: list[tuple[bool, str]] = []
    part: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # path, dropped, in the main element
    any_main = False

    def end():
        text = " ".join(entities.unescape("".join(part)).split())
        part.clear()
        if text:
            blocks.append((stack[-1][2], text))

    for i, (kind, what, mark) in enumerate(events):
        path, gone, inside = stack[-1]
        if kind == "text":
            if not gone and i not in drop:
                part.append(what)
            continue
        name = what.split(".", 1)[0]
        if name not in INLINE:
            end()
        elif name == "br":
            part.append(" ")
        if kind == "open":
            here = f"{path}/{what}"
            is_main = name in MAIN or here in main
            # a header that belongs to the article is part of it
            gone = gone or bool(mark) or i in drop or name == "header" and not inside
            any_main = any_main or is_main and not gone
            stack.append((here, gone, inside or is_main))
        elif len(stack) > 1:
            stack.pop()
    end()
    return "\n".join(t for inside, t in blocks if inside or not any_main)


def host(url: str | None) -> str:
    """Host of a URL in lower case; without one: empty."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, salt, wrapper) of the pages of a task, one row per host."""
    kept: dict[str, list] = {}
    for b in batches:
        for url, page in zip(b.column(0), b.column(1)):
            h, t = host(url.as_py()), slim(tree(page.as_py() or ""))
            kept[h] = merge(kept[h], t) if h in kept else t
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(kept), pa.string()), pa.array([json.dumps(w, ensure_ascii=True) for w in kept.values()], pa.string())],
        names=["host", "wrapper"])


def _merge_sorted(last: bool):
    """Merges the wrappers of each host, one after the other; rows come sorted by host."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None

        def row():
            value = roles(held) if last else held
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([json.dumps(value)], pa.string())],
                                              names=["host", "wrapper"])
        for b in batches:
            for h, w in zip(b.column(0), b.column(1)):
                h, w = h.as_py(), json.loads(w.as_py())
                if h == name:
                    held = merge(held, w)
                else:
                    if name is not None:
                        yield row()
                    name, held = h, w
        if name is not None:
            yield row()
    return run


def infer_roles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): the roles of each host's wrapper as JSON, from all its pages.

    Tasks infer wrappers of the pages they hold; those are merged by host and salt and then by
    host, so that a host with a third of all pages is merged by many tasks first.
    """
    n = pages.sparkSession.sparkContext.defaultParallelism
    first = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(_infer, "host string, wrapper string")
    salted = first.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    second = (salted.repartition(n, "host", "salt").sortWithinPartitions("host", "salt").select("host", "wrapper")
              .mapInArrow(_merge_sorted(False), "host string, wrapper string"))
    return (second.repartition(n, "host").sortWithinPartitions("host", "wrapper")
            .mapInArrow(_merge_sorted(True), "host string, wrapper string"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null or empty html has an empty text; pages without a URL share a wrapper. Null ids and
    repeated rows pass through. An empty table gives none. Other columns are ignored.
    """
    spark = pages.sparkSession
    known = written(infer_roles(pages, url, html), "wrappers")
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    kind = dict(pages.dtypes)[page_id]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = f"page_id {kind}, url string, text string, n_chars bigint"

    def texts(b, each):
        out = [article(page.as_py(), found) for page, found in zip(b.column(2), each)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:  # sizes checked: a few hundred bytes a host
        by_host = spark.sparkContext.broadcast({r.host: json.loads(r.wrapper) for r in known.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, [by_host.value.get(host(u.as_py())) for u in b.column(1)])
        return rows.mapInArrow(run, schema)

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    of_host = F.udf(host, "string")
    salted = rows.withColumn("host", of_host("url")).withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    joined = salted.join(known.select("host", "wrapper", salt), ["host", "salt"], "left").select("page_id", "url", "html", "wrapper")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield texts(b, [json.loads(w.as_py() or "null") for w in b.column(3)])
    return joined.mapInArrow(run_joined, schema)
