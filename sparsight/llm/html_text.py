"""Main text of web pages by removal of site templates.

Every element's subtree is hashed (tags and text, not attributes).  Spark counts, for each host and
subtree, the different contents it stands beside; subtrees that recur beside ``MIN_CONTENTS`` or more,
and beside ``MIN_SHARE`` of the host's contents, are template and are deleted, unless they hold more than
half of their page's text.  A page's content stands for its longest block that is not on most of the host's
pages, so that copies and edited versions of a page count once and don't make its blocks a template.
Inside an article only what stands beside most of the host's contents is template, and lists, tables
and figures never are.  Menus, notices, adverts and the like of hosts
with few pages are recognised by their elements, roles and class names.  Paragraphs of an article are
never taken for template.

Counts are summed up before they move, so that a host with a third of all pages is no hot group.  The
recurring subtrees are sent to the tasks up to a checked number, and beyond it joined to their pages.

Defined results: a null or empty html gives an empty text; broken or cut markup is read as far as it
goes; a null url is a host of its own; repeated rows give equal results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.storage import materialize

#: Different contents beside which a subtree must recur on its host.
MIN_CONTENTS = 5
#: Share of the host's different contents beside which it must recur, too; inside an article, more than ``ARTICLE_SHARE``.
MIN_SHARE, ARTICLE_SHARE = 0.02, 0.5
#: Pages of which blocks on most pages of the host hold more than this share of the text count as copies.
COPY_SHARE = 0.9
#: Recurring subtrees (a host and a number each) that are sent to the tasks, at most.
MOST_SENT = 500_000

# Fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr br".split()
)
#: Opening one of these closes an open one of the listed kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: What an open ``li``, cell and so on of an outer list or table is safe behind.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
TABLE_SCOPE = frozenset({"table"})
CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p"
    " pre section table ul".split()
)
PARAGRAPH = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption ul ol dl table thead tbody tfoot caption figure".split()
)

#: Elements, roles and words of class names that are no main text.
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas audio video".split())
NOISE = frozenset("nav aside footer form button select textarea dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|ads?|advert\w*|banner|promo\w*|sponsor\w*"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|search|share|sharing|social"
    r"|comments?|commentlist|respond|replies|discussion|related|recommend\w*|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
FIELDS = frozenset("form input button select textarea".split())
#: Inside an article: an element with a name of noise and a field is noise up to so many characters.
FIELD_TEXT = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ARTICLE = re.compile(r"(?:^|\s)(?:comments?|reply|response|teaser|related|promo|advert|ad)(?:$|[\s_-])", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|site-title)(?:$|[\s_-])", re.I)


CUT_OFF = re.compile("<[A-Za-z/!?]")


class Element:
    """A node: children are elements and strings."""

    __slots__ = ("tag", "names", "classes", "role", "hidden", "children", "subtree", "size", "links", "linked", "holds")

    def __init__(self, tag: str, attrs: dict):
        self.tag = tag
        self.classes = attrs.get("class") or ""
        self.names = f"{self.classes} {attrs.get('id') or ''}"
        self.role = (attrs.get("role") or "").lower()
        self.hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")
        self.children: list = []
        self.subtree = self.size = self.links = self.linked = 0
        self.holds = False


class Tree(HTMLParser):
    """Builds elements from markup of any quality."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.open = [self.root]
        self.counts: Counter = Counter()

    def _close(self, kinds, scope=frozenset()) -> None:
        """Closes the nearest open element of ``kinds``, if no element of ``scope`` lies between."""
        if not any(self.counts[k] for k in kinds):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in kinds:
                self.counts.subtract(e.tag for e in self.open[at:])
                del self.open[at:]
                return
            if tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSE_P:
            self._close({"p"}, TABLE_SCOPE | {"td", "th", "li", "button"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES.get(tag, TABLE_SCOPE))
        element = Element(tag, dict(attrs))
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "script", "iframe"):
            self._close({tag})

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, frozenset() if tag in ("body", "html", "article", "main", "div", "section") else {"article", "main", "table"} - {tag})

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    tree = Tree()
    try:
        tree.feed(html)
        if CUT_OFF.match(tree.rawdata):  # markup that never ends is no text
            tree.rawdata = ""
        tree.close()
    except AssertionError:  # the parser's word for a declaration that it can't read
        tree.handle_data(tree.rawdata)
    return tree.root


def elements(root: Element) -> list[Element]:
    """All elements, parents first."""
    found = [root]
    for element in found:
        found.extend(c for c in element.children if not isinstance(c, str))
    return found


def hash_subtrees(root: Element) -> None:
    """Sets each element's subtree hash, the size of its text and of its links, and whether it holds an article."""
    from xxhash import xxh64_intdigest

    for element in reversed(elements(root)):
        if element.tag in NO_TEXT:
            continue
        parts, size = [element.tag], 0
        for child in element.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                if text:
                    parts.append("=" + text)
                    size += len(text)
            elif child.size:
                parts.append(f"<{child.subtree}")
                size += child.size
                element.links += child.links
                element.linked += child.linked
                element.holds = element.holds or child.holds or child.tag in ("article", "main")
        element.size = size
        if element.tag == "a":
            element.links, element.linked = 1, size
        element.subtree = xxh64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def is_noise(element: Element, in_article: bool, page: Element) -> bool:
    """Whether an element is no main text by its tag, its role or its names.

    Names don't count for what holds the article, nor, on a page without one, for most of the text.
    Inside an article they count only for what looks like chrome, too; never for headings, and of
    sections only the classes.
    """
    if element.tag in NOISE or element.hidden or element.role in NOISE_ROLES:
        return True
    if element.tag in ("html", "body", "#root", "main"):
        return False
    if element.tag == "article" and not in_article:
        return bool(NOISE_ARTICLE.search(element.names))
    if not in_article and element.tag == "header" and not element.holds:
        return True
    if not element.names.strip() or element.holds or (not page.holds and 2 * element.size > page.size):
        return False
    if in_article:
        names = element.classes if element.tag == "section" else element.names
        return element.tag not in HEADINGS and bool(NOISE_NAMES.search(names)) and is_chrome(element)
    return bool(NOISE_NAMES.search(element.names) or HEADER_NAMES.search(element.names))


def is_chrome(element: Element) -> bool:
    """Mostly links, a short text with a form's fields, or a label of one word."""
    if element.links and element.linked > 0.6 * element.size:
        return True
    inner = elements(element)
    if element.size <= FIELD_TEXT and any(e.tag in FIELDS for e in inner):
        return True
    texts = [c for e in inner for c in e.children if isinstance(c, str) and c.strip()]
    return len(texts) < 2 and len("".join(texts).split()) < 2


def is_menu(element: Element) -> bool:
    """A list or box that is little but links."""
    return element.tag in ("ul", "ol", "div", "table", "section", "p") and element.links >= 3 and element.linked > 0.6 * element.size


def content_roots(root: Element, template: frozenset | set, everywhere: frozenset | set) -> list[Element]:
    """In page order, the articles outside of noise, or the mains around them; else the longest main, else everything."""

    def walk():
        """Elements outside of noise in page order, whether in an article, and the outermost main around each."""
        waiting = [(root, False, None)]
        while waiting:
            element, in_article, main = waiting.pop()
            kind = kind_of(element)
            listed = everywhere if in_article or kind in ("article", "main") else template
            if element.tag in NO_TEXT or is_noise(element, in_article, root) or gone(element, listed, root.size):
                continue
            yield element, in_article, main
            inside = in_article or kind == "article"
            around = element if main is None and kind == "main" and not in_article else main
            waiting.extend((c, inside, around) for c in reversed(element.children) if not isinstance(c, str))

    best: dict[str, Element] = {}
    for element, _, _ in walk():
        kind = kind_of(element)
        if kind in ("article", "main") and (kind not in best or element.size > best[kind].size):
            best[kind] = element
    longest = best.get("article")
    if longest is None or not longest.size:
        main = best.get("main")
        return [main if main is not None and main.size else root]
    for element in reversed(elements(root)):  # from here on names count for boxes of other articles
        inner = [c for c in element.children if not isinstance(c, str)]
        element.holds = any(c is longest or c.holds for c in inner)
    found: list[Element] = []
    for element, in_article, main in walk():
        if kind_of(element) == "article" and not in_article and element.size:
            unit = element if main is None else main
            if not found or found[-1] is not unit:
                found.append(unit)
    return found


def kind_of(element: Element) -> str:
    return "main" if element.role == "main" else element.tag


def gone(element: Element, template, page_size: int) -> bool:
    return element.subtree in template and 2 * element.size <= page_size


def candidates(root: Element) -> set[int]:
    """Subtrees that may be template: elements with text, but neither inline nor an article's paragraphs."""
    found: set[int] = set()
    waiting = [(root, False)]
    while waiting:
        element, in_article = waiting.pop()
        if element.tag in NO_TEXT or not element.size:
            continue
        if element.tag not in INLINE and element.tag not in ("#root", "html", "body") and not (in_article and element.tag in PARAGRAPH):
            found.add(element.subtree)
        inside = in_article or element.tag in ("article", "main") or element.role == "main"
        waiting.extend((c, inside) for c in element.children if not isinstance(c, str))
    return found


def article_state(contents: list[Element]) -> bool:
    """Whether all of the contents counts as an article: it is a main without one."""
    return len(contents) == 1 and kind_of(contents[0]) == "main" and not contents[0].holds


def content_blocks(root: Element, contents: list[Element]) -> dict[int, int]:
    """The subtrees and sizes of the contents' innermost blocks outside of noise."""
    found: dict[int, int] = {}
    waiting = [(c, article_state(contents)) for c in contents]
    while waiting:
        element, article = waiting.pop()
        article = article or element.tag == "article"
        within = [c for c in element.children if not isinstance(c, str) and c.size]
        if any(c.tag not in INLINE for c in within):
            waiting.extend((c, article) for c in within if not is_noise(c, article, root))
        elif element.size:
            found[element.subtree] = element.size
    return found


def main_text(html: str, template=frozenset(), everywhere=None) -> str:
    """Blocks of the main content, in page order, joined by line ends.

    ``template`` holds the subtrees that go; inside an article only those of ``everywhere`` (None: all) do.
    """
    root = parse(html)
    hash_subtrees(root)
    everywhere = template if everywhere is None else everywhere
    contents = content_roots(root, template, everywhere)
    blocks: list[str] = []
    held: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    def leaves(element: Element, article: bool, protected: bool) -> bool:
        return (
            element.tag in NO_TEXT
            or is_noise(element, article, root)
            or (element.tag not in INLINE and not (protected and element.tag in PARAGRAPH) and gone(element, everywhere if protected else template, root.size))
            or (not article and is_menu(element))
        )

    for content in contents:
        article = article_state(contents) or content.tag == "article"
        # Paragraphs beside the articles of a main are protected like theirs.
        waiting = [(content, iter(content.children), article, article or kind_of(content) == "main")]
        while waiting:
            element, rest, article, protected = waiting[-1]
            child = next(rest, None)
            if child is None:
                waiting.pop()
                if element.tag not in INLINE:
                    end_block()
            elif isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append(" ")
            else:
                if child.tag not in INLINE:
                    end_block()
                if not leaves(child, article, protected):
                    inside = article or child.tag == "article"
                    waiting.append((child, iter(child.children), inside, protected or inside))
    return "\n".join(blocks)


# --- tables -----------------------------------------------------------------


def page_subtrees(html: str) -> tuple[int, list[tuple[int, int, bool]]]:
    """The hash of a page's content; its candidates and its content's blocks: subtree, size (0: no block), whether a candidate."""
    from xxhash import xxh64_intdigest

    root = parse(html)
    hash_subtrees(root)
    contents = content_roots(root, frozenset(), frozenset())
    may_go, blocks = candidates(root), content_blocks(root, contents)
    found = [(subtree, blocks.get(subtree, 0), subtree in may_go) for subtree in sorted(may_go | blocks.keys())]
    return xxh64_intdigest(" ".join(str(c.subtree) for c in contents)) - (1 << 63), found


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_key(html: Column) -> Column:
    return F.xxhash64(F.coalesce(html, F.lit("")))


def page_candidates(pages: DataFrame) -> DataFrame:
    """host, page_key, content, subtree, size, may_go: a row for each candidate and block of each page, as a written table."""

    def subtrees(batches: Iterator) -> Iterator:
        import pyarrow as pa

        item = pa.struct([("subtree", pa.int64()), ("size", pa.int64()), ("may_go", pa.bool_())])
        for batch in batches:
            contents, lists = [], []
            for html in batch.column(2):
                content, found = page_subtrees(html.as_py())
                contents.append(content)
                lists.append([{"subtree": s, "size": n, "may_go": g} for s, n, g in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(contents, pa.int64()), pa.array(lists, pa.list_(item))],
                names=["host", "page_key", "content", "subtrees"],
            )

    rows = pages.select(host_of(F.col("url")).alias("host"), page_key(F.col("html")).alias("page_key"), F.coalesce("html", F.lit("")).alias("html"))
    schema = "host string, page_key bigint, content bigint, subtrees array<struct<subtree:bigint,size:bigint,may_go:boolean>>"
    found = rows.mapInArrow(subtrees, schema)
    return materialize(found.select("host", "page_key", "content", F.inline("subtrees")), "subtrees")


def recurring_subtrees(found: DataFrame, min_contents: int = MIN_CONTENTS) -> DataFrame:
    """host, subtree, everywhere of those beside enough different contents; everywhere: beside most of the host's."""

    def beside(rows: DataFrame, pages: DataFrame, content: str) -> DataFrame:
        """host, subtree, n (different contents), of_host (all the host's)."""
        every = pages.select("host", content).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
        counts = rows.select("host", "subtree", content).distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.filter(F.col("n") >= min_contents)
        return counts.join(common.sent_if_small(materialize(every, "host-contents"), F.length("host") + 16), "host")

    first = materialize(beside(found, found, "content").filter(F.col("n") >= MIN_SHARE * F.col("of_host")), "often")
    often = first.select("host", "subtree", (F.col("n") > ARTICLE_SHARE * F.col("of_host")).alias("most"))
    rows = found.join(common.sent_if_small(often, F.length("host") + 24), ["host", "subtree"], "left")
    most, size = F.coalesce("most", F.lit(False)), F.col("size")
    block = F.when(size > 0, F.struct("size", "subtree"))
    cores = rows.groupBy("host", "page_key").agg(
        F.max(block).alias("longest"), F.max(F.when(~most, block)).alias("own"),
        F.sum(F.when(most, size).otherwise(0)).alias("shared"), F.sum("size").alias("all"), F.first("content").alias("content"),
    )
    copy = F.col("shared") > COPY_SHARE * F.col("all")
    core = F.coalesce(F.when(copy, F.col("longest.subtree")).otherwise(F.col("own.subtree")), F.col("content"))
    cores = materialize(cores.select("host", "page_key", core.alias("core")), "page-cores")
    again = rows.filter("may_go AND most IS NOT NULL").select("host", "page_key", "subtree")
    again = beside(again.join(cores, ["host", "page_key"]), cores, "core")
    enough = (F.col("n") >= min_contents) & (F.col("n") >= MIN_SHARE * F.col("of_host"))
    everywhere = F.col("n") > ARTICLE_SHARE * F.col("of_host")
    return materialize(again.filter(enough).select("host", "subtree", everywhere.alias("everywhere")), "recurring")


def extract_text(pages: DataFrame, min_contents: int = MIN_CONTENTS, most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Up to ``most_sent`` recurring subtrees are sent to the tasks and no page is moved.  Beyond that,
    each page meets the list of its own ones in a join; the texts are the same.
    """
    found = page_candidates(pages)
    recurring = recurring_subtrees(found, min_contents)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    if recurring.count() <= most_sent:
        most = F.collect_list(F.when(F.col("everywhere"), F.col("subtree"))).alias("most")
        by_host = recurring.groupBy("host").agg(F.collect_list("subtree").alias("list"), most).collect()
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (frozenset(r["list"]), frozenset(r["most"])) for r in by_host})
        rows = rows.withColumns({n: F.lit(None).cast("array<bigint>") for n in ("template", "everywhere")})
    else:
        sent = None
        most = F.collect_set(F.when(F.col("everywhere"), F.col("subtree"))).alias("everywhere")
        lists = found.join(recurring, ["host", "subtree"]).groupBy("host", "page_key").agg(F.collect_set("subtree").alias("template"), most)
        lists = materialize(lists, "templates").withColumnsRenamed({"host": "at_host", "page_key": "at_page"})
        same = (F.col("host") == F.col("at_host")) & (page_key(F.col("html")) == F.col("at_page"))
        rows = rows.join(lists, same, "left").select("page_id", "url", "html", "host", "template", "everywhere")
    key = pages.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        none: tuple = (frozenset(), frozenset())
        for batch in batches:
            done = []
            for html, host, *own in zip(batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
                listed = [frozenset(x or ()) for x in own] if sent is None else sent.value.get(host, none)
                done.append(main_text(html.as_py(), *listed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(done, pa.string())], names=["page_id", "url", "text"]
            )

    extracted = rows.mapInArrow(texts, f"page_id {key}, url string, text string")
    return extracted.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_site_templates(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(common.table(spark, sf, "pages"))
