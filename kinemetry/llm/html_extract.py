"""Main text of web pages: structure, and differencing against the page of the nearest URL.

A page becomes lines, one per block element. Lines in containers that are never main text (menus,
footers, forms, adverts, comments, ...) go; words in names decide for small parts only, not for an
article that holds most of the text nor for paragraphs within one. If the page marks its article, the article's lines
stay. Else the page is compared with the neighbour of its host whose URL path is nearest: the two
line lists are aligned by longest common subsequence, and shared lines, the site's frame, go."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed lists of element names and of words in class, id and role.
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button dialog menu head".split())
HEAD_PARTS = frozenset("base basefont bgsound head link meta noscript script style template title".split())
#: Start tags that end open elements which need no end tag: these, what they end, and where the search stops.
_SCOPE = frozenset("html body table caption td th button object template".split())
_ENDS_P = BLOCK - frozenset("body html head legend option tbody td tfoot th thead tr caption".split())
IMPLIED = {
    "li": ({"li"}, _SCOPE | {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, _SCOPE | {"dl"}), "dd": ({"dt", "dd"}, _SCOPE | {"dl"}),
    "option": ({"option"}, _SCOPE), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"td", "th", "tr", "caption"}, {"table"}),
} | {x: ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}) for x in ("tbody", "thead", "tfoot")}
NESTED = frozenset("svg math object select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu topbar toolbar masthead "
    "header footer sidebar aside widget widgets comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager skip search searchbox copyright".split())
#: Elements of running text, which only these words as whole names drop within an article.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
RUNNING = frozenset("p blockquote pre dl dt dd table caption tbody tr td th".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Pages that share so many hundredths of the text of both are copies, which differencing leaves alone.
COPY = 98
#: Blocks of consecutive pages, for each shuffle partition.
BLOCKS = 3
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Line(NamedTuple):
    text: str
    dropped: bool
    article: bool


class _Open(NamedTuple):
    name: str
    dropped: int
    article: int
    doubtful: bool


def _hints(name: str, attrs: str, within_article: bool) -> tuple[int, int]:
    """Whether an element never holds main text (2), or none by the words of its names alone (1), and how well it marks the article (0 to 2)."""
    mark = {"article": 2, "main": 1}.get(name, 0)
    drop, named = name in DROPPED or name == "header" and not within_article, False
    if attrs:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
            drop = True
        role = values.get("role", "").lower()
        drop |= role in DROPPED_ROLES
        mark = max(mark, 2 * (role == "article"), int(role == "main"))
        words = set()
        for key in ("class", "id", "itemprop"):
            for w in re.split(r"[^A-Za-z]+", values.get(key, "")):
                words.add(w.lower())
                words.update(x.lower() for x in _WORD.findall(w))
        if within_article and name in RUNNING:
            named = any(w.lower() in ADVERTS for key in ("class", "id") for w in values.get(key, "").split())
        elif name not in ("html", "body", "main", *HEADINGS):
            named = bool(words & (DROPPED_WORDS - {"header"} if within_article else DROPPED_WORDS))
        if "articlebody" in values.get("itemprop", "").lower():
            mark = 2
    return 2 if drop else int(named), 0 if drop else mark


def _ended(stack: list[_Open], name: str) -> int | None:
    """The place of the stack from where a start tag ends what is open; none if it ends nothing."""
    found = None
    for names, stop in ((IMPLIED.get(name), None), (({"p"}, _SCOPE) if name in _ENDS_P else None, None)):
        if not names:
            continue
        ends, stop = names
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in ends:
                found = i if found is None else min(found, i)
                if name not in ("tr", "tbody", "thead", "tfoot"):
                    break
            elif stack[i].name in stop:
                break
    return found


def _after(page: str, at: int, name: str) -> int:
    """Where the text behind a raw element begins, its content and, if it may nest, those within it left out."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif name in NESTED and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, white space made single spaces, without empty ones.

    An article that its own names or those around it would drop is doubtful: it counts where it holds most of what the
    page has beside what is never main text, and no other article stands there."""
    out: list[Line] = []
    marks: list[tuple[int, bool]] = []
    stack: list[_Open] = []
    buffer: list[str] = []
    dropped, article, doubtful = 0, 0, False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append(Line(text, dropped > 0, False))
                marks.append((article, doubtful))

    def cut(deep: int) -> None:
        nonlocal dropped, article, doubtful
        del stack[deep:]
        now = stack[-1] if stack else _Open("", 0, 0, False)
        if now[1:] != (dropped, article, doubtful):
            flush()
        dropped, article, doubtful = now[1:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        plain = page[at : m.start() if m else end]
        if plain:
            if stack and stack[-1].name == "head" and not plain.isspace():  # text ends the head
                cut(len(stack) - 1)
            buffer.append(html.unescape(plain))
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            buffer.append(m["cdata"])
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in BLOCK:
                flush()
            deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), -1)
            if deep >= 0:
                cut(deep)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if stack and stack[-1].name == "head" and name not in HEAD_PARTS:
            cut(len(stack) - 1)
        if name in RAW:
            if not attrs.endswith("/"):
                at = _after(page, at, name)
            buffer.append(" ")
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            buffer.append(" ")
        if (deep := _ended(stack, name)) is not None:
            cut(deep)
        if name in VOID:
            continue
        drop, mark = _hints(name, attrs, article > 0)
        if name in BLOCK or drop or mark:
            drop = max(drop, dropped)
            marked = drop == 1 and mark > 0 and not (article and not doubtful)
            new = (0, mark, True) if marked else (drop, article if drop else max(article, mark), doubtful)
            if new != (dropped, article, doubtful):
                flush()
            dropped, article, doubtful = new
            stack.append(_Open(name, *new))
    flush()
    sure = any(a and not d and not x.dropped for (a, d), x in zip(marks, out, strict=True))
    left = [(d, len(x.text)) for (_, d), x in zip(marks, out, strict=True) if not x.dropped]
    if sure or 2 * sum(n for d, n in left if d) < sum(n for _, n in left):
        out = [Line(x.text, x.dropped or d, False) for (_, d), x in zip(marks, out, strict=True)]
    sizes = [(a, len(x.text)) for (a, _), x in zip(marks, out, strict=True) if a and not x.dropped]
    # a teaser marked as an article inside a longer main part is no article of its own
    least = 2 if 2 * sum(n for a, n in sizes if a == 2) >= sum(n for _, n in sizes) else 1
    return [Line(x.text, x.dropped, bool(sizes) and a >= least) for x, (a, _) in zip(out, marks, strict=True)]


def common(a: list[str], b: list[str]) -> set[int]:
    """The places of `a` that a longest common subsequence of both lists uses (of several, the
    earliest in `a`). Rows of the table are the bits of integers."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    own = [i for i, x in enumerate(a) if x in where]
    full, v, table = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for i in own:
        table.append(v)
        hit = v & where[a[i]]
        v = ((v + hit) | (v - hit)) & full
    # bit j of v is 0 where the subsequence grows at place j; walk back from the end
    out, j = set(), len(b)
    for k in range(len(own) - 1, -1, -1):
        before = table[k]
        mask = (1 << j) - 1
        grew = (~v & mask).bit_count() > (~before & mask).bit_count()
        if grew:
            out.add(own[k])
            # the match is at the last place of this row, below j, where the length grows
            zeros = ~v & mask
            j = zeros.bit_length() - 1
        v = before
    return out


def _path(url: str) -> tuple[str, list[str]]:
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url or "", flags=re.I)
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), [p for p in path.split("/") if p]


def _near(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(own: list[Line], near: list[Line] | None) -> str:
    """The text of a page, given its neighbour's lines (none: the only page of its host)."""
    if any(x.article for x in own):
        return "\n".join(x.text for x in own if x.article and not x.dropped)
    kept = [x.text for x in own if not x.dropped]
    if near:
        other = [x.text for x in near if not x.dropped]
        shared = common(kept, other)
        size = sum(len(kept[i]) for i in shared)
        # a copy of the page, equal or all but so on both sides, says nothing about the frame
        if 100 * size < COPY * max(sum(map(len, kept)), sum(map(len, other))):
            kept = [x for i, x in enumerate(kept) if i not in shared]
    return "\n".join(kept)


def _blocks(keys: DataFrame, blocks: int) -> tuple[list[str], list[str]]:
    """The first and last key of each of at most `blocks` ranges of keys, in order."""
    ends = keys.repartitionByRange(blocks, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("a"), F.max("k").alias("z"))
    rows = sorted((r.a, r.z) for r in ends.collect())  # two keys of each block
    return [a for a, _ in rows], [z for _, z in rows]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: its id and url, `text` and `n_chars` (code points of it).

    Pages stand in the order of host, path segments and id, cut into blocks, so a host of any size is
    spread over tasks. The neighbour of a page is the one before or behind it in its host that shares
    more segments (as many: the one before); a block also gets the last page of the block before and
    the first of the next, so the result is the same for any number of blocks. Null html is an empty
    page, a null url a page without host; repeated rows are pages each; an empty table gives an empty
    one; other columns are left out. A clash of names can't arise."""
    kind = pages.schema[page_id].dataType.simpleString()
    bare = F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    # segments part at a character below all others, so that text order is the order of segments
    key = F.concat(F.lower(F.substring_index(bare, "/", 1)), F.lit("\x01"), F.regexp_replace(F.substring(bare, F.length(F.substring_index(bare, "/", 1)) + 1, 1 << 30), "/+", "\x01"),
                   F.lit("\x01"), F.coalesce(F.lpad(F.col(f"`{page_id}`").cast("string"), 20, "0"), F.lit("")))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, last = _blocks(pages.select(key.alias("k")), BLOCKS * parts)

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array) -> pa.Array:
        out = []
        for k in keys.to_pylist():
            b = max(bisect.bisect_right(first, k) - 1, 0)
            out.append([b] + [b - 1] * (b > 0 and k == first[b]) + [b + 1] * (b + 1 < len(first) and k == last[b]))
        return pa.array(out, pa.list_(pa.int32()))

    rows = pages.select(F.col(f"`{page_id}`").alias("i"), F.col(f"`{url}`").alias("u"), F.col(f"`{source}`").alias("h"), key.alias("k"))
    rows = rows.select("i", "u", "h", "k", F.posexplode(places("k")).alias("guest", "block"))
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "k").select("i", "u", "h", "guest", "block")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None  # (id, url, host, path, lines, guest, block)

        def result(done: list) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind_of), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([len(x) for x in cols[2]], pa.int64())], names=[page_id, url, "text", "n_chars"])

        def finish(left, page, right) -> list[tuple]:
            if page[5]:
                return []
            beside = [(_near(page[3], x[3]), k, x) for k, x in ((1, left), (0, right)) if x and page[2] and x[2] == page[2] and x[6] == page[6]]
            near = max(beside, key=lambda x: x[:2])[2][4] if beside else None
            return [(page[0], page[1], main_text(page[4], near))]

        kind_of = None
        for batch in batches:
            kind_of, done = batch.column(0).type, []
            for i, u, h, guest, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                new = (i, u, *_path(u), lines(h or ""), guest, block)
                if now:
                    done += finish(before, now, new)
                before, now = now, new
            if done:
                yield result(done)
        if now and (done := finish(before, now, None)):
            yield result(done)

    return rows.mapInArrow(texts, f"`{page_id}` {kind}, `{url}` string, text string, n_chars long")
