"""Main text of pages by a site style tree.

The DOMs of one host are merged by the path of their block elements (tag with class or id). Per path the tree keeps the
presentation styles (sequences of child blocks) and the content features (texts of leaf blocks) with the number of
pages that show each. With m the pages that hold a path,

* presentation importance is the entropy of its styles to base m, 1 when m is 1;
* content importance of a leaf text seen on k pages is 1 - log_m k: one on every page is worth nothing, a unique one 1;
* a branch with l styles is worth (1 - g^l) * presentation importance + g^l * mean content importance below it.

Branches below ``THRESHOLD`` are removed from each page. Elements that say what they are go first: navigation, headers,
footers, asides, forms, scripts, adverts, notices and comments are worth nothing. Where a page marks its article, only
marked blocks are its main text, and the mark is a prior: a block of the article goes if its own branch is below the
threshold after ``PRIOR`` showings worth 1 have been added to those the tree has seen.

Inline elements belong to the block around them; character references are decoded, white space inside a block becomes
one space, blocks are joined by a line feed. Null and empty pages give an empty text. Unclosed and misnested tags are
closed as their parents end. Pages whose URL has no host share one host, the empty one.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.batches import extended, slices
from millrace.llm.urls import host
from millrace.session import cut

DAMPING = 0.9
THRESHOLD = 0.3
PRIOR = 2
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template svg math iframe object audio video canvas select textarea button".split())
REMOVED = frozenset("nav footer aside form dialog menu".split())
MAIN = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article main content post entry story".split())
REMOVED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget related share social notice notices cookie cookies consent alert popup modal newsletter subscribe comment comments respond "
    "disqus complementary contentinfo search form toolbar pagination".split()
)
CLOSED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
SPACE = re.compile(r"\s+")


class Page(HTMLParser):
    """Collects blocks (path, role, text) in page order and the child blocks of every path.

    role: 1 inside the marked article, -1 inside something that is none, 0 where the page does not say.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.children: dict[str, list[str]] = {}
        self._stack: list[tuple[str, str, int]] = [("", "", 0)]
        self._text: list[str] = []
        self._skip: str | None = None
        self._depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._skip:
            self._depth += tag == self._skip
            return
        if tag == "br":
            self._text.append(" ")
        if tag in INLINE or tag == "br":
            return
        self._flush()
        if tag in VOID:
            return
        if tag in SKIPPED:
            self._skip, self._depth = tag, 1
            return
        self._imply_ends(tag)
        names = [n for key, value in attrs if key in ("class", "id", "role") and value for n in value.lower().split()]
        step = ".".join([tag, *names[:2]])
        _, parent, role = self._stack[-1]
        self.children.setdefault(parent, []).append(step)
        path = f"{parent}/{step}"
        if role >= 0:
            told = frozenset(names)
            if tag in REMOVED or told & REMOVED_NAMES or (tag == "header" and role == 0):
                role = -1
            elif tag in MAIN or told & MAIN_NAMES:
                role = 1
        self._stack.append((tag, path, role))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def _imply_ends(self, tag: str) -> None:
        closes = CLOSED_BY.get(tag, frozenset())
        while len(self._stack) > 1 and (self._stack[-1][0] == "p" or self._stack[-1][0] in closes):
            self._stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if self._skip:
            if tag == self._skip:
                self._depth -= 1
                self._skip = self._skip if self._depth else None
            elif tag in ("body", "html"):
                self._skip = None
            return
        if tag in INLINE or tag in VOID:
            return
        self._flush()
        if any(open_tag == tag for open_tag, _, _ in self._stack):
            while self._stack[-1][0] != tag:
                self._stack.pop()
            self._stack.pop()

    def handle_data(self, data: str) -> None:
        if not self._skip:
            self._text.append(data)

    def close(self) -> None:
        super().close()
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = SPACE.sub(" ", "".join(self._text)).strip()
            self._text = []
            if text:
                _, path, role = self._stack[-1]
                self.blocks.append((path, role, text))


def parsed(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    return page


BLOCK = T.StructType([T.StructField("path", T.StringType()), T.StructField("role", T.IntegerType()), T.StructField("text", T.StringType())])
STYLE = T.StructType([T.StructField("path", T.StringType()), T.StructField("style", T.StringType())])


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces ``html`` by ``blocks`` and ``styles``; other columns stay."""
    blocks = pa.list_(pa.struct([("path", pa.string()), ("role", pa.int32()), ("text", pa.string())]))
    styles = pa.list_(pa.struct([("path", pa.string()), ("style", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, html):
            found = [parsed(t) for t in texts]
            kept = piece.select([n for n in piece.schema.names if n not in (html, "blocks", "styles")])
            yield extended(
                kept,
                blocks=pa.array([[{"path": p, "role": r, "text": t} for p, r, t in page.blocks] for page in found], blocks),
                styles=pa.array([[{"path": p, "style": _style(c)} for p, c in page.children.items()] for page in found], styles),
            )

    kept = [f for f in pages.schema if f.name not in (html, "blocks", "styles")]
    return pages.mapInArrow(run, T.StructType([*kept, T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("styles", T.ArrayType(STYLE))]))


def _style(children: list[str]) -> str:
    """Child blocks in order, runs of one kind as one: a longer list has no other style than a short one."""
    return " ".join(c for k, c in enumerate(children) if not k or children[k - 1] != c)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, shown, importance) of every branch (``shown``: leaf texts below it), from parsed pages with a ``host``.

    Counts are partial sums before every shuffle; a leaf adds to each branch above it through its path's prefixes.
    """
    leaves = pages.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("text"))))).alias("b"))
    texts = leaves.select("host", "b.path", "b.text").groupBy("host", "path", "text").agg(F.count("*").alias("k"))
    shown = pages.select("host", F.explode("styles").alias("s")).select("host", "s.path", "s.style")
    styles = shown.groupBy("host", "path", "style").agg(F.count("*").alias("k"))
    per_style = styles.groupBy("host", "path").agg(F.sum("k").alias("pages"), F.count("*").alias("l"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    # entropy to base m of the shares k / m is 1 - sum(k log k) / (m log m)
    entropy = F.when(F.col("pages") > 1, 1 - F.col("klogk") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    per_style = per_style.select("host", "path", "l", "pages", entropy.alias("presentation"))
    # a text on k of m pages; sums over the k occurrences, so that repeated texts weigh as often as they are shown
    of = pages.groupBy("host").agg(F.count("*").alias("m"))
    content = texts.join(of, "host").select(
        "host", "path", "k", (F.col("k") * F.when(F.col("m") > 1, 1 - F.log("k") / F.log("m")).otherwise(1.0)).alias("worth")
    )
    content = content.groupBy("host", "path").agg(F.sum("k").alias("n"), F.sum("worth").alias("worth"))
    steps = F.filter(F.split("path", "/"), lambda s: s != "")
    above = content.withColumn("_steps", steps).select(
        "host", "n", "worth", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_steps"), F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("_steps", F.lit(1), k), "/")))).alias("path")
    )
    below = above.groupBy("host", "path").agg((F.sum("worth") / F.sum("n")).alias("content"), F.sum("n").alias("shown"))
    tree = below.join(per_style, ["host", "path"], "left")
    damp = F.pow(F.lit(DAMPING), F.coalesce("l", F.lit(0)))
    worth = (1 - damp) * F.coalesce("presentation", F.lit(0.0)) + damp * F.col("content")
    return tree.select("host", "path", "pages", "shown", worth.alias("importance"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Replaces ``html`` by the main ``text`` of every page; other columns stay (``host`` and ``text`` are replaced)."""
    kept = [c for c in pages.columns if c not in (html, "text", "host", "blocks", "styles")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    source = pages.select(row, F.col(html).alias("html"), host(F.col(url)).alias("host"))
    rows = cut(parse(source, "html"), "dom")
    held = (F.col("importance") * F.col("shown") + PRIOR) / (F.col("shown") + PRIOR)
    low = style_tree(rows).where(F.col("importance") < threshold).groupBy("host").agg(
        F.collect_list("path").alias("low"), F.collect_list(F.when(held < threshold, F.col("path"))).alias("low_marked")
    )
    joined = rows.drop("styles").join(cut(low, "branches"), "host", "left")
    marked = F.exists("blocks", lambda b: b["role"] == 1)
    paths, own = (F.coalesce(c, F.array().cast("array<string>")) for c in ("low", "low_marked"))
    removed = lambda b: F.exists(paths, lambda p: F.startswith(F.concat(b["path"], F.lit("/")), F.concat(p, F.lit("/"))))
    article = F.filter("blocks", lambda b: (b["role"] == 1) & ~F.array_contains(own, b["path"]))
    chosen = F.when(marked, article).otherwise(F.filter("blocks", lambda b: (b["role"] == 0) & ~removed(b)))
    return joined.select("row.*", F.array_join(F.transform(chosen, lambda b: b["text"]), "\n").alias("text"))
