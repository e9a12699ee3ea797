"""Main text of web pages: structural parsing and differencing against pages with the nearest URLs."""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, save, small_enough, table
from .urlfilter import split_url

#: A page's neighbours are looked for among so many different pages before and after it in the order of paths; so many
#: that are no copies, with the nearest paths, are aligned.
WINDOW, NEIGHBOURS = 32, 4
#: Hosts with more pages are split into stretches of paths, of at least so many pages, at most MAX_PARTS of them.
HOST_PAGES, MAX_PARTS = 1_024, 4_096
#: Pages for each boundary sought, on average, whose paths are looked at to place the boundaries.
SAMPLED = 16
BROADCAST_HOSTS = 20_000
#: Pages of a task, on average, at most.
TASK_PAGES = 20_000
#: Pages whose lines outside of the alignment have so many of their words in common are copies of each other.
COPY_WORDS = 0.5
#: Share of the text that no neighbour has that the main part must hold: to be found, and to be confirmed if marked.
MAIN_SHARE, MARKED_SHARE = 0.8, 0.5

_TOKEN = re.compile(
    r"<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[\"'])*+)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HEADING = re.compile(r">h[1-6](?![^> ])[^>]*\Z")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "option", "select", "button", "label", "legend",
}
#: Elements that never hold main text.
DROP_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "search", "button", "select", "object", "canvas", "audio", "video", "map", "label", "fieldset", "datalist"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "toolbar", "dialog", "alertdialog", "alert", "status", "tablist"}
#: Words in class and id names of elements that are not main text. A name counts if all its words are of these or say
#: nothing, one at least of these.
READERS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "related", "recommended", "recommendations", "teaser", "teasers"}
DROP_NAMES = READERS | {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright",
    "dialog", "footer", "gdpr", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "popup", "privacy", "promo", "promos", "promotion", "promoted", "search", "share", "sharing", "shares", "sidebar", "sidebars", "signup", "social", "sponsor", "sponsored",
    "sponsors", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
PLAIN_NAMES = {
    "area", "bar", "block", "body", "bottom", "box", "col", "column", "container", "content", "footer", "global", "group", "header", "holder", "inner", "item", "items", "left", "link", "links", "list",
    "main", "outer", "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "title", "top", "unit", "wrap", "wrapper", "zone",
}
#: An end tag of an element may also end these, if they lie open inside it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "menu", "table", "tbody", "thead", "tfoot", "select", "div", "article", "main", "section", "body"}


def _names(value: str, words: set[str]) -> bool:
    for name in value.split():
        parts = {x.lower() for x in _NAME_PARTS.findall(name)}
        if parts & words and parts <= words | PLAIN_NAMES:
            return True
    return False


def _verdict(tag: str, attributes: str, inside: str) -> tuple[str, str]:
    """What an element is: ``main``, ``drop`` (also readers' comments, even if marked as articles), ``hint`` (its name
    says that it is no main text) or ````; and its class names."""
    names, role = "", ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += f" {value}"
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "drop", names
    if tag in ("html", "body"):
        return "", names
    if names and _names(names, READERS):
        return "drop", names
    if tag in ("article", "main") or role in ("main", "article"):
        return "main", names
    if tag in DROP_TAGS or role in DROP_ROLES or tag == "header" and inside != "main":
        return "drop", names
    if names and (_names(names, DROP_NAMES) or inside != "main" and _names(names, {"header"})):
        return "hint", names
    return "", names


class Block(NamedTuple):
    """text; whether it lies in a marked main part; the outermost element whose name is against it, or 0; all elements
    around it; slot: their tags and names."""

    text: str
    main: bool
    hint: int
    inside: tuple[int, ...]
    slot: str


def blocks(html: str) -> list[Block]:
    """Blocks of text outside of menus, forms and the like, in page order."""
    out: list[Block] = []
    pieces: list[str] = []
    # Open elements: tag, kind ("main", "drop" or ""), hint, elements around it and itself, slot.
    stack: list[tuple[str, str, int, tuple[int, ...], str]] = [("", "", 0, (), "")]
    lower, opened = None, 0

    def flush():
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, kind, hint, inside, slot = stack[-1]
                out.append(Block(text, kind == "main", hint, inside, slot))
            pieces.clear()

    def close_to(depth: int):
        flush()
        del stack[depth:]

    pos, n = 0, len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        end = m.start() if m else n
        if end > pos and stack[-1][1] != "drop":
            text = html[pos:end]
            pieces.append(unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == tag:
                    if tag in BLOCK:
                        close_to(d)
                    else:
                        del stack[d:]
                    break
                if tag not in BLOCK and stack[d][0] in BLOCK:
                    break
            if tag == "p" and "p" not in [s[0] for s in stack]:
                flush()
            continue
        if tag in RAW:
            if tag == "svg" and m[4].endswith("/"):
                continue
            if lower is None:
                lower = html.lower() if len(html.lower()) == n else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            at = lower.find(f"</{tag}", pos)
            close = lower.find(">", at) if at >= 0 else -1
            pos = close + 1 if close >= 0 else n
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            for d in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[d][0] == "p":
                    close_to(d)
                    break
                if stack[d][0] in BLOCK:
                    break
            for d in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
                if stack[d][0] in CLOSES[tag]:
                    close_to(d)
                    break
                if stack[d][0] in LISTS:
                    break
            flush()
        if tag in VOID:
            continue
        _, kind, hint, inside, slot = stack[-1]
        if kind != "drop":
            own, names = _verdict(tag, m[4], kind)
            if tag in BLOCK or own:
                opened += 1
                inside, slot = (*inside, opened), f"{slot}>{tag}{names}"
                if own == "hint":
                    hint = hint or opened
                elif own:
                    kind = own
        elif tag in ("html", "body"):
            kind = ""
        stack.append((tag, kind, hint, inside, slot))
    flush()
    return out


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    return lo


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of the lines of a and b (bit-parallel, a row of bits for each line of a)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    out = set(range(start)) | set(range(len(a) - stop, len(a)))
    x, y = a[start : len(a) - stop], b[start : len(b) - stop]
    places: dict[str, int] = {}
    for j, line in enumerate(y):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [], full
    for line in x:  # bit j of v is 0 where the length of the common subsequence grows at y[j]
        hit = v & places.get(line, 0)
        v = ((v + hit) | (v - hit)) & full
        rows.append(v)
    i, j = len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        length = lambda r, c: (~r & ((1 << (c + 1)) - 1)).bit_count() if c >= 0 else 0
        here = length(rows[i], j)
        if not here:
            break
        if i and length(rows[i - 1], j) == here:
            i -= 1
        elif length(rows[i], j - 1) == here:
            j -= 1
        else:
            out.add(start + i)
            i, j = i - 1, j - 1
    return out


def _is_copy(own: list[str], other: list[str], shared: set[int]) -> bool:
    """Whether what the alignment leaves of both pages is nothing, or mostly the same words."""
    rest = Counter(other) - Counter(own[i] for i in shared)
    a = {w for i, line in enumerate(own) if i not in shared for w in line.split()}
    b = {w for line in rest for w in line.split()}
    return len(a & b) >= COPY_WORDS * len(a | b)


def aligned(own: list[str], others) -> list[set[int]]:
    """Places of own that are shared with each of the first NEIGHBOURS others that are no copies of it or of each other."""
    out, seen = [], {tuple(own)}
    for other in others:
        key = tuple(other)
        if key in seen:
            continue
        seen.add(key)
        shared = shared_lines(own, other)
        if own and not _is_copy(own, other, shared):
            out.append(shared)
            if len(out) == NEIGHBOURS:
                break
    return out


def main_text(own: list[Block], near: list[set[int]]) -> str:
    """Text of a page, given its blocks and the places that it shares with each of its neighbours.

    A line that half of the neighbours share is boilerplate. What is left, the page's own text, shows where the main
    part is. An element marked as article or main is it if it holds MARKED_SHARE of the own text (one without any, as
    it quotes others, if it is longer than all own text): all its lines stay, but for slots, headings and its largest
    one excepted, whose every line all of three or more neighbours share. Else the innermost element with MAIN_SHARE of the own
    text is the main part, and shared lines are deleted. An element whose name says that it is no main text is left
    out, unless no marked part is confirmed and it holds most of the own text. Without a neighbour, marks and names
    decide.
    """
    votes = Counter(i for shared in near for i in shared)
    new = [len(b.text) if not near or 2 * votes[i] < len(near) else 0 for i, b in enumerate(own)]
    total = sum(new)
    kept = [i for i, b in enumerate(own) if not b.hint]
    outside = sum(new[i] for i in kept)
    marked = [i for i in kept if own[i].main]
    held = sum(new[i] for i in marked)
    if marked and (not near or held >= MARKED_SHARE * outside and (held or sum(len(own[i].text) for i in marked) >= total)):
        slots: dict[str, list[int]] = {}
        for i in marked:
            slots.setdefault(own[i].slot, []).append(i)
        largest = max(slots, key=lambda s: sum(len(own[i].text) for i in slots[s]))
        same = {s for s, at in slots.items() if s != largest and not _HEADING.search(s) and len(near) > 2 and all(votes[i] == len(near) for i in at)}
        kept = [i for i in marked if own[i].slot not in same]
    elif near and total:
        hinted = Counter()
        for b, n in zip(own, new):
            hinted[b.hint] += n
        kept = [i for i, b in enumerate(own) if not b.hint or 2 * hinted[b.hint] > total]
        total = sum(new[i] for i in kept)
        held = Counter()
        for i in kept:
            for e in own[i].inside:
                held[e] += new[i]
        within = max((e for e, n in held.items() if n >= MAIN_SHARE * total), default=None)  # elements are numbered as they open
        kept = [i for i in kept if new[i] and (within is None or within in own[i].inside)]
    return "\n".join(own[i].text for i in kept)


_TEXT = "page_id {}, url string, text string, n_chars long"


def _parts(rows: DataFrame) -> DataFrame:
    """host, bounds of hosts with more than HOST_PAGES pages: where each stretch of keys (path, hash of the page) after
    the first starts, its WINDOW-th key, and the WINDOW-th last key of the stretch before.

    Boundaries are placed by the paths of about SAMPLED pages for each, picked by a hash. They decide which task does
    what, never the result: each stretch also gets the WINDOW pages on either side of it.
    """
    large = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > HOST_PAGES)
    large = save(large.select("host", "n", F.least(F.ceil(F.col("n") / HOST_PAGES), F.lit(MAX_PARTS)).alias("parts")), "hosts")
    few = F.broadcast(large) if small_enough(large, BROADCAST_HOSTS) else large
    keys = rows.join(few, "host").select("host", "n", "parts", F.struct("path", "h").alias("key")).distinct()
    step = F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("parts") * SAMPLED)))
    some = keys.where(F.pmod(F.xxhash64("key"), step) == 0).groupBy("host").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list("key")).alias("all"))
    cut = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.get("all", F.floor(k * F.size("all") / F.col("parts")).cast("int")))
    starts = save(some.where("parts > 1").select("host", F.array_sort(F.array_distinct(F.filter(cut, lambda c: c.isNotNull()))).alias("starts")), "starts")
    starts = F.broadcast(starts) if small_enough(starts, BROADCAST_HOSTS) else starts
    placed = keys.select("host", "key").join(starts, "host").select("host", "key", F.size(F.filter("starts", lambda c: c <= F.col("key"))).alias("part"))
    ranked = lambda order: placed.withColumn("k", F.row_number().over(Window.partitionBy("host", "part").orderBy(order))).where(F.col("k") <= WINDOW)
    heads = ranked(F.col("key")).groupBy("host", "part").agg(F.max("key").alias("head"), F.min("key").alias("start"))
    tails = ranked(F.col("key").desc()).groupBy("host", F.col("part").alias("before")).agg(F.min("key").alias("tail"), F.count("*").alias("rows"))
    # A stretch with fewer than WINDOW pages would leave its neighbours without some of theirs; it joins the one before.
    bounds = heads.where("part > 0").join(tails.select("host", (F.col("before") + 1).alias("part"), "tail", F.col("rows").alias("rows_before")), ["host", "part"])
    bounds = bounds.join(tails.select("host", F.col("before").alias("part"), "rows"), ["host", "part"]).where((F.col("rows") == WINDOW) & (F.col("rows_before") == WINDOW))
    return save(bounds.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("start", "head", "tail"))).alias("bounds")), "bounds")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Pages are sorted by path within their host, equal pages with one path count as one. Of the WINDOW pages before
    and after a page, those whose paths have the longest start in common with its path are its neighbours (ties: the
    closer one, then the one before), up to NEIGHBOURS of them that are no copies of the page or of each other. Lines
    are aligned by longest common subsequence with each, and main_text decides. Large hosts are split into stretches
    of paths, which get the pages around them, too, so that the result is the same however a host is split.

    Null and empty html give an empty text. A page without a neighbour, as all others of its host or of its window
    are copies of it, is left to the structure of its html. Null URLs share the empty host. Repeated rows give a row each, null ids stay, other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"), F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))).alias("h"))
    bounds = _parts(rows.drop("html"))
    bounds = F.broadcast(bounds) if small_enough(bounds, BROADCAST_HOSTS) else bounds
    key = F.struct("path", "h")
    part = F.coalesce(F.size(F.filter("bounds", lambda b: b["start"] <= F.col("key"))), F.lit(0))
    dealt = rows.join(bounds, "host", "left").withColumn("key", key).withColumn("part", F.when(F.col("bounds").isNull(), 0).otherwise(part))
    at = lambda k: F.get("bounds", k)
    # Beyond its own stretch, a page among the first or last WINDOW of it goes to the one before or after.
    to = F.array(
        F.struct(F.col("part").alias("part"), F.lit(True).alias("own")),
        F.when((F.col("part") > 0) & (F.col("key") <= at(F.col("part") - 1)["head"]), F.struct((F.col("part") - 1).alias("part"), F.lit(False).alias("own"))),
        F.when(F.col("key") >= at(F.col("part"))["tail"], F.struct((F.col("part") + 1).alias("part"), F.lit(False).alias("own"))),
    )
    dealt = dealt.withColumn("to", F.explode(F.filter(to, lambda x: x.isNotNull())))
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // TASK_PAGES))
    dealt = dealt.select("host", "to.part", "path", "page_id", "url", "html", "to.own", "h").repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "path", "h")
    schema = _TEXT.format(rows.schema["page_id"].dataType.simpleString())

    def finish(pages, i):
        """Results of the i-th of the pages (group, path, h, rows, own, blocks, lines) around it."""
        group, path, _, members, _, own, lines = pages[i]
        near = [(-_common(pages[j][1], path), abs(j - i), j > i, j) for j in range(len(pages)) if j != i and pages[j][0] == group and abs(j - i) <= WINDOW]
        text = main_text(own, aligned(lines, (pages[j][6] for *_, j in sorted(near))))
        return [(page_id, url, text, len(text)) for page_id, url in members]

    def run(batches):
        held, out, todo = deque(), [], 0  # todo: place in held of the first page without a result

        def step(more):
            nonlocal todo
            while todo < len(held) and (not more or len(held) - todo > WINDOW + 1):  # the last may have more rows to come
                if held[todo][4]:
                    out.extend(finish(held, todo))
                todo += 1
                if todo > WINDOW:
                    held.popleft()
                    todo -= 1

        for batch in batches:
            types = [batch.schema.field("page_id").type, pa.string(), pa.string(), pa.int64()]
            for at in range(0, batch.num_rows, 256):
                for host_, part_, p, page_id, url, html, own, h in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if held and held[-1][:3] == ((host_, part_), p, h):
                        held[-1][3].append((page_id, url))
                        continue
                    found = blocks(html or "")
                    held.append(((host_, part_), p, h, [(page_id, url)], own, found, [b.text for b in found]))
                    step(True)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "url", "text", "n_chars"])
                    out.clear()
        step(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return dealt.mapInArrow(run, schema)


def op4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
