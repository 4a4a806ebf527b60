"""Main text of web pages by wrapper induction.

The pages of a host fall into layouts by the structural tags and the classes they use. Every layout on
``MIN_PAGES`` different pages has a reference, a page of its most frequent sequence of tags; other pages
go with the host's most frequent layout. Pages are aligned with their reference by simple tree
matching, and a node of the reference whose text is the same on the aligned pages is template. The
rest are varying slots: of these the article's are content, and slots in menus, sidebars, notices and
the like are not, which their tags, roles and class names tell.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import lower_ascii, pick
from assaykit.session import broadcast_if_small, materialize

# What the markup language and common usage say about elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript template iframe noembed noframes xmp title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head script style noscript template iframe noembed noframes object svg canvas audio video nav footer aside form button input select option textarea label menu dialog title fieldset".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status note".split())
CLASSES = set(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "teaser teasers newsletter subscribe subscription sidebar sidenav menu submenu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus "
    "replies reply respond discussion share sharing social related recommended recommendations widget pagination pager login signup search skip".split()
)
# Of these also an article itself is marked.
ARTICLE_CLASSES = set("comment comments reply teaser teasers ad ads advert adverts advertisement sponsor sponsored promo promotion related recommended recommendations".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("table ul ol dl div section article main body html blockquote form td th nav aside header footer".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Markup of running text, which does not tell one layout from another.
PROSE = sorted(INLINE | VOID | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split()))
MIN_PAGES = 5  # different pages that must agree before a text is template


class Page:
    """The elements of a page: parent, label, whether it is no content, and its own text in order."""

    def __init__(self, html: str):
        self.label, self.parent, self.kids, self.out = ["#"], [-1], [[]], [False]
        self.flow: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self.inside = [False]  # in an article or main part
        self._build(html)

    def _build(self, html: str) -> None:
        stack, names, at, n = [0], ["#"], 0, len(html)
        opened: dict[str, int] = {}  # how often a name stands in names
        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                self.flow.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                self.flow.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if opened.get(name):
                    while True:
                        top, gone = names.pop(), stack.pop()
                        opened[top] -= 1
                        if top not in INLINE:
                            self.flow.append((gone, None))
                        if top == name:
                            break
                elif name == "p":
                    self.flow.append((stack[-1], None))
                continue
            closes = SAME.get(name)
            if closes or name in CLOSES_P and opened.get("p"):
                for i in range(len(names) - 1, 0, -1):
                    if closes and names[i] in closes or not closes and names[i] == "p":
                        for gone in names[i:]:
                            opened[gone] -= 1
                        del names[i:], stack[i:]
                        break
                    if names[i] in SCOPE:
                        break
            if name == "br":
                self.flow.append((stack[-1], "\n"))
                continue
            node = self._add(name, m[3] or m[6] or "", stack[-1])
            if name not in INLINE:
                self.flow.append((node, None))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}", re.I).search(html, at)
                at = n if end is None else end.start()
                if end is not None:
                    close = html.find(">", end.end())
                    at = n if close < 0 else close + 1
            elif name not in VOID:
                stack.append(node)
                names.append(name)
                opened[name] = opened.get(name, 0) + 1

    def _add(self, name: str, attributes: str, parent: int) -> int:
        node, label, out = len(self.label), name, self.out[parent] or name in DROPPED
        inside = self.inside[parent]
        if name == "header" and not inside:
            out = True
        main = name == "main"
        if attributes:
            found = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
            words = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
            role = found.get("role", "").lower()
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
            by_class = words & (CLASSES if name not in ("html", "body", "main", "article") else ARTICLE_CLASSES if name == "article" else set())
            out = out or role in ROLES or hidden or bool(by_class)
            main = main or role == "main" or found.get("itemprop") == "articleBody"
            if found.get("class"):
                label = f"{name}.{found['class'].split()[0] if found['class'].split() else ''}"
        self.label.append(label)
        self.parent.append(parent)
        self.kids.append([])
        self.out.append(out)
        self.kids[parent].append(node)
        self.inside.append(inside or not out and (name == "article" or main))
        return node

    def blocks(self, skip: set[int] = frozenset()) -> list[str]:
        """Texts of the content blocks in page order, without the elements in ``skip``.

        They are those of all articles and main parts, or of the whole page if it has neither.
        """
        everywhere = not any(self.inside)
        out, held = [], []
        for node, text in self.flow:
            if text is None:
                if held:
                    out.append("".join(held))
                    held = []
            elif (everywhere or self.inside[node]) and not self.out[node] and node not in skip:
                held.append(text)
        out.append("".join(held))
        return [t for t in (" ".join(unescape(x).split()) for x in out) if t]

    def own_texts(self) -> dict[int, str]:
        """White-space normalised own text of the elements that could be content."""
        found: dict[int, list[str]] = {}
        for node, text in self.flow:
            if text is not None and not self.out[node]:
                found.setdefault(node, []).append(text)
        return {n: t for n, parts in found.items() if (t := " ".join("".join(parts).split()))}

    def skeleton(self) -> str:
        """Labels and parents, enough to align with."""
        return "\n".join(f"{p} {label}" for p, label in zip(self.parent[1:], self.label[1:]))


def _row(above: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The next row of the programme: best sums with the first j of the second list."""
    row = above.copy()
    np.maximum(row[1:], above[:-1] + scores, out=row[1:])
    return np.maximum.accumulate(row)


def _best(rows: list[int], scores: Callable[[int], np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Last row of the programme that matches two lists in order; ``scores`` has them by shape."""
    row = np.zeros(len(columns) + 1, np.int32)
    for i in rows:
        row = _row(row, scores(i)[columns])
    return row


def _matching(rows: list[int], scores: Callable[[int], np.ndarray], columns: np.ndarray) -> list[tuple[int, int]]:
    """A best matching in order. Of n rows of the programme about 2 sqrt(n) are held at a time."""
    step = math.isqrt(len(rows)) + 1
    held, row = [], np.zeros(len(columns) + 1, np.int32)
    for n, i in enumerate(rows):
        if n % step == 0:
            held.append(row)
        row = _row(row, scores(i)[columns])
    out, j = [], len(columns)
    for block in range(len(held) - 1, -1, -1):
        part, grid = rows[block * step : (block + 1) * step], [held.pop()]
        for i in part:
            grid.append(_row(grid[-1][: j + 1], scores(i)[columns[:j]]))
        i = len(part)
        while i and j:
            if grid[i][j] == grid[i - 1][j]:
                i -= 1
            elif grid[i][j] == grid[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((block * step + i, j))
    return out


class Reference:
    """The tree of a host's reference page and what aligning with it has found so far."""

    def __init__(self, skeleton: str):
        self.label, self.kids = ["#"], [[]]
        for i, line in enumerate(skeleton.split("\n") if skeleton else [], 1):
            p, label = line.split(" ", 1)
            self.label.append(label)
            self.kids.append([])
            self.kids[int(p)].append(i)
        self.ids: dict[tuple, int] = {}
        self.shapes, self.sizes = self._shapes(self.label, self.kids)
        self.scores: dict[tuple[int, int], int] = {}

    def _shapes(self, label: list[str], kids: list[list[int]]) -> tuple[list[int], list[int]]:
        shape, size = [0] * len(label), [1] * len(label)
        for i in range(len(label) - 1, -1, -1):
            key = (label[i], *[shape[k] for k in kids[i]])
            shape[i] = self.ids.setdefault(key, len(self.ids))
            size[i] += sum(size[k] for k in kids[i])
        return shape, size

    def align(self, page: Page) -> dict[int, int]:
        """Element of the page to element of the reference, for the largest simple tree matching."""
        if len(self.ids) > 100_000 or len(self.scores) > 1_000_000:
            self.ids, self.scores = {}, {}
            self.shapes, self.sizes = self._shapes(self.label, self.kids)
        shape, size = self._shapes(page.label, page.kids)
        found: dict[int, int] = {}

        def score(a: int, b: int) -> int | None:
            """Size of the largest matching with ``a`` and ``b`` matched; None if not known yet."""
            if page.label[a] != self.label[b]:
                return 0
            if shape[a] == self.shapes[b]:
                return size[a]
            return self.scores.get((shape[a], self.shapes[b]))

        def ends(a: int, b: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
            """Children that match as the lists begin and end alike, and the lists between."""
            x, y = page.kids[a], self.kids[b]
            out, lo, hx, hy = [], 0, len(x), len(y)
            while lo < min(hx, hy) and shape[x[lo]] == self.shapes[y[lo]]:
                out.append((x[lo], y[lo]))
                lo += 1
            while hx > lo and hy > lo and shape[x[hx - 1]] == self.shapes[y[hy - 1]]:
                hx, hy = hx - 1, hy - 1
                out.append((x[hx], y[hy]))
            return out, x[lo:hx], y[lo:hy]

        def by_label(y: list[int]) -> dict[str, list[tuple[int, int]]]:
            """(number, element) of the different shapes in ``y`` for each label."""
            found: dict[str, list[tuple[int, int]]] = {}
            for i, k in enumerate({self.shapes[k]: k for k in y}.values()):
                found.setdefault(self.label[k], []).append((i, k))
            return found

        def table(x: list[int], y: list[int]) -> tuple[list[int], Callable[[int], np.ndarray], np.ndarray]:
            """The shapes of ``x``, the scores of such a shape with the different shapes of ``y``, and those of ``y`` by number."""
            of_x, likes = {shape[k]: k for k in x}, by_label(y)
            number = {s: i for i, s in enumerate({self.shapes[k]: k for k in y})}

            @lru_cache(maxsize=16 + 4_000_000 // len(number))
            def scores(s: int) -> np.ndarray:
                row = np.zeros(len(number), np.int32)
                for i, k in likes.get(page.label[of_x[s]], ()):
                    row[i] = score(of_x[s], k)
                return row

            return [shape[k] for k in x], scores, np.array([number[self.shapes[k]] for k in y])

        def fill(a: int, b: int) -> None:
            """Find the score of ``a`` and ``b`` and all that it needs, the inner ones first."""
            todo = [(a, b)]
            while todo:
                a, b = todo[-1]
                if score(a, b) is not None:
                    todo.pop()
                    continue
                same, x, y = ends(a, b)
                likes = by_label(y)
                need = [(k, m) for k in {shape[k]: k for k in x}.values() for _, m in likes.get(page.label[k], ()) if score(k, m) is None]
                if need:
                    todo += need
                    continue
                todo.pop()
                inner = int(_best(*table(x, y))[-1]) if x and y else 0
                self.scores[shape[a], self.shapes[b]] = 1 + sum(size[k] for k, _ in same) + inner

        def pairs(a: int, b: int) -> list[tuple[int, int]]:
            same, x, y = ends(a, b)
            if not x or not y:
                return same
            fill(a, b)
            return same + [(x[i], y[j]) for i, j in _matching(*table(x, y))]

        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            found[a] = b
            if shape[a] == self.shapes[b]:
                todo += zip(page.kids[a], self.kids[b])
            else:
                todo += pairs(a, b)
        return found


@lru_cache(maxsize=64)
def reference(skeleton: str) -> Reference:
    return Reference(skeleton)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Page(x or "").skeleton() for x in batch.column("html").to_pylist()]
        names = ["host", "layout", "is_main"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, pa.string())], [*names, "skeleton"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the text at each element of the reference, for every page; element -1 stands for the page."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            hosts, refs, spots, texts, pages = [], [], [], [], []
            for row in batch.slice(i, 256).to_pylist():
                html = row["html"] or ""
                page, mark = Page(html), _digest(html)
                at = reference(row["skeleton"]).align(page)
                own = [(at[n], _digest(t)) for n, t in page.own_texts().items() if n in at]
                for spot, text in [(-1, 0), *own]:
                    hosts.append(row["host"])
                    refs.append(row["ref"])
                    spots.append(spot)
                    texts.append(text)
                    pages.append(mark)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(refs, pa.int64()), pa.array(spots, pa.int32()), pa.array(texts, pa.int64()), pa.array(pages, pa.int64())],
                ["host", "ref", "spot", "text", "page"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part, texts = batch.slice(i, 256), []
            for row in part.select(["html", "skeleton", "template"]).to_pylist():
                page, skip = Page(row["html"] or ""), set()
                if row["template"]:
                    fixed = set(row["template"])
                    skip = {n for n, r in reference(row["skeleton"]).align(page).items() if r in fixed}
                texts.append(" ".join(page.blocks(skip)))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


def _laid_out(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, layout, and shape (the sequence of tags; null if there are none)."""
    html, tag = F.coalesce("html", F.lit("")), "[a-zA-Z][a-zA-Z0-9:-]*"
    rows = pick(pages, "page_id", "url", "html").withColumns({
        "host": host_of(F.col("url")),
        "tags": F.regexp_extract_all(html, F.lit(f"<(/?{tag})")),
        "classes": F.regexp_extract_all(html, F.lit(r"""\sclass\s*=\s*["']?\s*([^\s"'>]+)""")),
    })
    structure = F.filter(F.transform("tags", lambda t: F.lower(F.ltrim(t, F.lit("/")))), lambda t: ~t.isin(PROSE))
    layout = F.xxhash64(F.array_sort(F.array_distinct(F.concat(structure, F.transform("classes", lambda c: F.concat(F.lit("."), c))))))
    return rows.withColumns({"layout": layout, "shape": F.when(F.size("tags") > 0, F.xxhash64("tags"))}).drop("tags", "classes")


def _with_wrapper(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ref, skeleton and template of their layout, or else of the host's most frequent layout."""
    own = found.withColumns({"ref": F.col("layout"), "wrapper": F.struct(F.col("layout").alias("ref"), "skeleton", "template")})
    main = own.where("is_main").select("host", F.col("wrapper").alias("main"))
    joined = rows.join(broadcast_if_small(own.select("host", "layout", "wrapper"), 5_000), ["host", "layout"], "left")
    joined = joined.join(broadcast_if_small(main, 5_000), "host", "left").withColumn("wrapper", F.coalesce("wrapper", "main"))
    return joined.select(*rows.columns, "wrapper.ref", "wrapper.skeleton", "wrapper.template")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, is_main, skeleton, template): the reference trees of each host and their template elements.

    Template are elements with one text on at least ``MIN_PAGES`` different pages and on half of the
    different pages that go with the reference. With fewer pages there is no template.
    """
    rows = _laid_out(pages).where("shape is not null").select("host", "layout", "shape", "html", F.xxhash64("html").alias("mark"))
    shapes = rows.select("host", "layout", "shape", "mark").distinct().groupBy("host", "layout", "shape").agg(F.count("*").alias("n"), F.min("mark").alias("mark"))
    layouts = materialize(shapes.groupBy("host", "layout").agg(F.sum("n").alias("n"), F.max_by("mark", F.struct("n", "shape")).alias("mark")), "layouts")
    most = layouts.groupBy("host").agg(F.max_by("layout", F.struct("n", "layout")).alias("main"))
    kept = layouts.join(most, "host").withColumn("is_main", F.col("layout") == F.col("main")).where(F.col("is_main") | (F.col("n") >= MIN_PAGES))
    kept = materialize(kept.select("host", "layout", "mark", "is_main"), "kept")
    first = rows.join(broadcast_if_small(kept), ["host", "layout", "mark"]).groupBy("host", "layout", "is_main").agg(F.min("html").alias("html"))
    skeletons = materialize(first.mapInArrow(_skeletons, "host string, layout bigint, is_main boolean, skeleton string"), "skeletons")
    slots = _with_wrapper(rows.select("host", "layout", "html"), skeletons.withColumn("template", F.lit(None).cast("array<int>"))).select("host", "ref", "html", "skeleton")
    slots = slots.mapInArrow(_slots, "host string, ref bigint, spot int, text bigint, page bigint")
    spots = materialize(
        slots.groupBy("host", "ref", "spot").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count_distinct("page").alias("n")), "spots"
    )
    whole = spots.where("spot = -1").select("host", "ref", F.col("n").alias("n_pages"))
    fixed = spots.where("spot >= 0 and lo = hi").join(whole, ["host", "ref"]).where(F.col("n") >= F.greatest(F.lit(MIN_PAGES), F.col("n_pages") / 2))
    template = fixed.groupBy("host", F.col("ref").alias("layout")).agg(F.sort_array(F.collect_list("spot")).alias("template"))
    return skeletons.join(template, ["host", "layout"], "left")


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points) of the main text.

    Null and empty html, and pages without content, give an empty text. Pages whose url is null or
    has no host share one group. Broken markup is read as far as it goes: what is open at the end
    is closed. Repeated pages count once when templates are sought. All articles and main parts
    that are not marked as teasers, comments or adverts are joined in page order. An empty table gives an empty table.
    """
    found = materialize(wrappers(pages), "wrappers")
    rows = _with_wrapper(_laid_out(pages).select("page_id", "url", "html", "host", "layout"), found)
    return rows.select("page_id", "url", "html", "skeleton", "template").mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")
