"""Main text of pages: flat text blocks judged by a decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its number of words, its
link density, those of the block before and after it, and where it stands (page furniture such as
menus and forms, inside or outside the article). A decision tree trained on the small labelled
table below says which blocks are main text."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import table

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "place")
#: Labelled blocks: the features above, then 1 for main text. ``furniture`` is 1 inside menus, headers, footers,
#: sidebars, notices, adverts, forms and comments; ``place`` is 2 inside an article, 1 on a page without one, 0
#: outside the article of a page that has one.
LABELLED = (
    (6, 0.0, 4, 1.0, 60, 0.0, 0, 2, 1),
    (1, 0.0, 45, 0.0, 38, 0.0, 0, 2, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 2, 1),
    (60, 0.0, 6, 0.0, 80, 0.0, 0, 2, 1),
    (140, 0.02, 60, 0.0, 35, 0.0, 0, 2, 1),
    (35, 0.1, 140, 0.0, 3, 0.0, 0, 2, 1),
    (400, 0.0, 35, 0.1, 90, 0.05, 0, 2, 1),
    (12, 0.4, 80, 0.0, 50, 0.0, 0, 2, 1),
    (4, 1.0, 70, 0.0, 55, 0.0, 0, 2, 1),
    (3, 0.0, 12, 0.0, 9, 0.0, 0, 2, 1),
    (25, 0.0, 5, 1.0, 7, 0.0, 1, 2, 0),
    (8, 0.0, 30, 0.0, 0, 0.0, 1, 2, 0),
    (70, 0.0, 90, 0.0, 60, 0.0, 1, 2, 0),
    (3, 1.0, 40, 0.0, 3, 1.0, 1, 2, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0),
    (14, 0.0, 2, 1.0, 30, 0.0, 1, 0, 0),
    (120, 0.0, 14, 0.0, 45, 0.0, 1, 0, 0),
    (5, 0.2, 60, 0.0, 0, 0.0, 1, 0, 0),
    (9, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0),
    (22, 0.0, 40, 0.0, 4, 0.5, 0, 0, 0),
    (75, 0.0, 20, 0.0, 18, 0.0, 0, 0, 0),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 1, 1, 0),
    (30, 0.1, 3, 1.0, 8, 0.0, 1, 1, 0),
    (150, 0.0, 60, 0.0, 90, 0.0, 1, 1, 0),
    (6, 0.0, 40, 0.0, 2, 1.0, 1, 1, 0),
    (60, 0.0, 6, 0.0, 80, 0.0, 0, 1, 1),
    (180, 0.05, 60, 0.0, 30, 0.0, 0, 1, 1),
    (30, 0.0, 180, 0.0, 22, 0.0, 0, 1, 1),
    (22, 0.1, 30, 0.0, 45, 0.2, 0, 1, 1),
    (18, 0.0, 45, 0.0, 4, 0.0, 0, 1, 1),
    (5, 0.0, 3, 1.0, 70, 0.0, 0, 1, 1),
    (7, 0.0, 55, 0.0, 64, 0.0, 0, 1, 1),
    (3, 0.0, 90, 0.0, 48, 0.1, 0, 1, 1),
    (9, 0.1, 48, 0.0, 25, 0.0, 0, 1, 1),
    (2, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0),
    (4, 0.0, 5, 0.0, 3, 0.0, 0, 1, 0),
    (6, 0.0, 2, 0.9, 6, 0.0, 0, 1, 0),
    (8, 0.9, 6, 1.0, 7, 0.8, 0, 1, 0),
    (25, 0.8, 30, 0.9, 4, 1.0, 0, 1, 0),
    (40, 0.7, 90, 0.0, 12, 1.0, 0, 1, 0),
    (5, 1.0, 80, 0.0, 5, 1.0, 0, 1, 0),
    (3, 0.0, 4, 0.5, 2, 0.0, 0, 1, 0),
    (30, 0.0, 2, 0.5, 3, 0.0, 0, 1, 1),
    (45, 0.0, 0, 0.0, 20, 0.0, 0, 1, 1),
    (60, 0.0, 2, 0.0, 2, 0.0, 0, 1, 1),
    (25, 0.0, 3, 0.9, 40, 0.0, 0, 1, 1),
    (20, 0.0, 1, 0.0, 2, 0.0, 0, 1, 1),
    (15, 0.1, 0, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (2, 0.5, 0, 0.0, 40, 0.0, 0, 1, 0),
    (2, 0.0, 0, 0.0, 1, 0.0, 0, 1, 0),
    (1, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0),
    (3, 0.5, 3, 0.5, 50, 0.0, 0, 1, 0),
)
#: The same blocks elsewhere: inside an article all but runs of links are main text, beside it and inside page
#: furniture none is.
TRAINING = (
    *LABELLED,
    *((*row[:6], 1, row[7], 0) for row in LABELLED),
    *((*row[:6], 0, 0, 0) for row in LABELLED),
    *((*row[:6], 0, 2, int(row[1] < 0.8 or max(row[3], row[5]) < 0.8)) for row in LABELLED),
)
DEPTH = 6

#: Elements that end a block, and those whose text is never shown as text: that of ``RAW`` has no tags and ends at their own
#: closing tag only.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup"
    " option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title iframe noframes".split())
HIDDEN = frozenset("noscript template svg object canvas audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav aside footer form button select fieldset menu dialog".split())
#: Words in class and id names, and roles, that mark page furniture. A name counts only if all its words are among
#: these or say where something is or what kind of box it is, so ``sidebar-left`` does and ``has-sidebar`` does not.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice"
    " notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead"
    " comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe signup"
    " login search form pagination pager widget toolbar".split()
)
#: Marks of what readers wrote.
READERS = frozenset("comment comments respond reply replies disqus".split())
PLACES = frozenset(
    "site page global main primary secondary top bottom left right inner outer upper lower fixed sticky list box wrap wrapper"
    " container section area block slot unit item items link links bar panel content title heading body text button buttons"
    " icons post posts article entry blog story news user reader google message info law thread count header row col column group inline small large".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar".split())
#: Elements whose class says something about the whole page.
WHOLE = frozenset(("html", "body", "article", "main"))
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(!--)|[!?/][^>]*+>)")
_ATTRIBUTE = re.compile(
    r"""([^\x20\t\n\f\r/>=]++)(?:[\x20\t\n\f\r]*+=[\x20\t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^\x20\t\n\f\r>"'][^\x20\t\n\f\r>]*+)))?"""
)
_NAMED = frozenset(("class", "id", "role", "style", "hidden"))
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\x20\t\n\f\r/>]|\Z)[^>]*+(?:>|\Z)", re.I | re.A) for tag in RAW}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SAID = MARKS | PLACES
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


@dataclass
class Block:
    text: str
    links: int
    furniture: bool
    article: bool


def _names(attributes: str) -> tuple[bool, bool, bool, bool]:
    """(furniture by class, id or role; a header by them; hidden; written by readers)."""
    marked = header = hidden = readers = False
    seen: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        # Of attributes of one name the first counts.
        if name not in _NAMED or name in seen:
            continue
        seen.add(name)
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "role":
            marked |= value.strip().lower() in ROLES
        else:
            for token in value.split():
                parts = {x.lower() for x in _PART.findall(token) if len(x) > 1}
                if parts <= _SAID:
                    marked |= not MARKS.isdisjoint(parts)
                    readers |= not READERS.isdisjoint(parts)
                    header |= "header" in parts
    return marked, header, hidden, readers


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page in order, one pass over its tags."""
    found: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    # Open elements as (tag, furniture, article, hidden, link), each with what holds above it. Furniture is 1 by a name
    # alone, which the page's first article inside it overrules, 2 by the element itself or if readers wrote it.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    articles = 0
    opened: dict[str, int] = {}
    unclosed: set[str] = set()

    def close_block() -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join([p for p, _ in pieces])).strip(" ")
            if text:
                _, furniture, article, _, _ = stack[-1]
                linked = sum(len(_SPACE.sub(" ", p).split(" ")) - p[:1].isspace() - p[-1:].isspace() for p, link in pieces if link)
                found.append(Block(text, max(linked, 0), furniture > 0, article))
            pieces.clear()

    def add(raw: str) -> None:
        if raw and not stack[-1][3]:
            pieces.append((references.unescape(raw) if "&" in raw else raw, stack[-1][4]))

    def pop(tag: str) -> None:
        while opened.get(tag):
            top = stack.pop()[0]
            opened[top] -= 1
            if top == tag:
                return

    def end_link() -> None:
        """Ends the open link; block-level elements inside it stay open."""
        place = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "a")
        if not any(e[0] in BLOCKS for e in stack[place + 1 :]):
            pop("a")
            return
        stack[place] = ("", *stack[place][1:])
        stack[place:] = [(*e[:4], False) for e in stack[place:]]
        opened["a"] -= 1
        opened[""] = opened.get("", 0) + 1

    at = 0
    while True:
        start = html.find("<", at)
        match = _TAG.match(html, start) if start >= 0 else None
        if start < 0:
            add(html[at:])
            break
        if match is None:
            add(html[at : start + 1])
            at = start + 1
            continue
        add(html[at:start])
        at = match.end()
        slash, tag, attributes, comment = match.groups()
        if comment:
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            continue
        if not tag:
            continue
        tag = tag.lower()
        # Tags inside a hidden element end no block, unless they end an element around it.
        inside = stack[-1][3]
        if tag in BLOCKS and (not inside or slash and opened.get(tag) and not next(e[3] for e in reversed(stack) if e[0] == tag)):
            close_block()
        elif tag == "br":
            add(" ")
        if slash:
            pop(tag)
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = None if tag in unclosed else _CLOSING[tag].search(html, at)
            if end is None:
                unclosed.add(tag)
            # In drawings and formulas these are elements like others, which end with their parent.
            if end or not (opened.get("svg") or opened.get("math")):
                at = end.end() if end else len(html)
                continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
            pop(tag)
        elif tag == "a" and opened.get("a"):
            end_link()
        _, furniture, article, hidden, link = stack[-1]
        marked, header, gone, readers = _names(attributes) if attributes else (False, False, False, False)
        if tag in WHOLE:
            # Their names speak of the whole page; an article may still be one reader's comment.
            marked, header, gone, readers = readers and tag == "article", False, False, readers and tag == "article"
        hidden = hidden or gone or tag in HIDDEN
        main = article
        if not hidden:
            main = article or tag in ("article", "main")
            if tag == "article" and not marked:
                articles += 1
                if articles == 1 and furniture == 1:
                    furniture = 0
            if tag in FURNITURE or readers or tag == "header" and not article:
                furniture = 2
            elif marked or header and not article:
                furniture = max(furniture, 1)
        stack.append((tag, furniture, main, hidden, link or tag == "a"))
        opened[tag] = opened.get(tag, 0) + 1
    close_block()
    return found


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """``FEATURES`` of every block."""
    has_article = any(b.article and not b.furniture for b in found)
    words = [float(b.text.count(" ") + 1) for b in found]
    links = [min(1.0, b.links / w) for b, w in zip(found, words)]
    words, links = [0.0, *words, 0.0], [0.0, *links, 0.0]
    return [
        (words[i + 1], links[i + 1], words[i], links[i], words[i + 2], links[i + 2], float(b.furniture), 2.0 if b.article else 0.0 if has_article else 1.0)
        for i, b in enumerate(found)
    ]


def train(spark: SparkSession, rows: tuple[tuple[float, ...], ...] = TRAINING) -> DecisionTreeClassificationModel:
    """The decision tree over a labelled table."""
    frame = spark.createDataFrame([tuple(map(float, r)) for r in rows], [*FEATURES, "label"])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame)
    return DecisionTreeClassifier(maxDepth=DEPTH, minInstancesPerNode=1, seed=0).fit(vectors)


def as_nodes(model: DecisionTreeClassificationModel) -> tuple:
    """The tree as nested (feature, threshold, left, right), and verdicts at the leaves."""

    def walk(node) -> tuple | bool:
        if node.subtreeDepth() == 0:
            return node.prediction() > 0.5
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return walk(model._java_obj.rootNode())


def judge(tree: tuple | bool, row: tuple[float, ...]) -> bool:
    """The tree's verdict on a block."""
    while not isinstance(tree, bool):
        feature, threshold, left, right = tree
        tree = left if row[feature] <= threshold else right
    return tree


def main_text(tree: tuple | bool, html: str | None) -> str:
    """The main blocks of a page, one a line."""
    found = blocks(html or "")
    return "\n".join([b.text for b, row in zip(found, features(found)) if judge(tree, row)])


def extract_main_text(pages: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with the main text of ``html``: its blocks' words, character references decoded and white
    space made one space, one block a line. A null or empty page, or one without main blocks, has an
    empty text. Equal pages get equal texts; a column called ``name`` is replaced, others pass through."""
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(as_nodes(train(spark)))
    rest = pages.drop(name)
    schema = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    return pages.drop(name).mapInArrow(_extracted(held, html, name), f"{schema}, `{name}` string")


def _extracted(held: Broadcast, html: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(held.value, x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return run


def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract_main_text(pages, name="text").selectExpr("page_id", "url", "text", "CAST(length(text) AS BIGINT) AS n_chars")


QUERIES = {"op2_html_extract": (op2_html_extract, None)}
