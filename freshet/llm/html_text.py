"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Menus, page headers, footers, side bars, forms, hidden elements and elements named like
adverts, notices or comments are cut out with their blocks first.

Pass one decides a block by its link density, length and share of stop words. Runs of blocks that are mostly links are menus; a lone one is
left open. Blocks of SHORT characters or more with LOW_STOPS or more stop words are content. Where stop words tell nothing, because less than LOW_STOPS / 2 of all
the page's words are any (another language, or writing without spaces), length alone is asked for. What is short, or long but poor in stop words, stays open: headings, tables,
code, lists of names.

Pass two gives each open block the label of the nearest decided block; if both sides are as near, a heading follows the block after it and
other blocks the one before. Where nothing on the page is content by pass one, its open blocks are: nothing else is.

An article or main element is believed if it holds half of the page's text or more. Blocks outside it are then no content, and within it only a menu's
heading follows the menu; other open blocks look for the nearest text.

Defined cases: null html is empty and gives empty text; unclosed and stray tags, unclosed comments and scripts are tolerated; a page
without any content block gives empty text; repeated rows give equal results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import lean, table

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or our she so that the their them there they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und von war was werden wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con de del el ella ellos en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se sin sobre son su sus también un una y ya yo""".split()
)

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TAGS = frozenset("nav aside footer form menu select button dialog head title fieldset label textarea".split())
CONTENT_TAGS = frozenset("article main".split())
RAW_TAGS = "script|style|noscript|template|svg|math|iframe|object|textarea|canvas|video|audio"
#: Words of class, id and role that mark an element as no content.
NEVER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay sidebar side aside widget comment comments disqus reply replies respond menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead copyright legal share sharing social related recommended newsletter subscribe subscription signup login search form toolbar skip teaser complementary contentinfo dialog alert".split())
#: These mark with any ending (comment-list, cookiebar, ...).
NEVER_STEMS = ("comment", "advert", "sponsor", "cookie", "sidebar", "newsletter", "navbar", "breadcrumb", "subscribe", "promo", "disqus", "footer", "popup")
#: Beside these a word tells of a layout that has such a part, not of the part.
LAYOUT_WORDS = frozenset("with has no layout without".split())
#: What heads an article belongs to it.
HEAD_WORDS = frozenset("header masthead".split())
HIDDEN = re.compile(r"""display\s*:\s*none|\bhidden\b(?!\s*=\s*[\"']?false)""", re.I)

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{RAW_TAGS})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*+)>
    |<[!?/][^>]*(?:>|\Z)
    |<[a-zA-Z][^<>]*\Z""",
    re.S | re.I | re.X,
)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[^\W\d_]+")

MAX_LINKS, SHORT, LOW_STOPS = 0.33, 70, 0.20
#: So many neighbouring blocks of links make a menu.
MENU = 2
RIGHTS = re.compile(r"\s*(?:\xa9|\(c\)\s|copyright\b)", re.I)


@dataclass
class Block:
    heading: bool
    never: bool
    vouched: bool
    in_menu: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None
    rule: str = ""


def _names_never(rest: str, vouched: bool) -> bool:
    """Whether an element's class, id or role names it as no content; ``vouched``: it stands in an article."""
    for m in NAMES.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            if LAYOUT_WORDS & set(words):
                continue
            for word in words:
                if word in HEAD_WORDS and vouched or word == "commentary":
                    continue
                if word in NEVER_WORDS or word.startswith(NEVER_STEMS):
                    return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, with white space put in order and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, never, vouched
    block = Block(False, False, False)
    in_link = 0
    heading = False

    def begin() -> Block:
        if block.parts:
            out.append(block)
        return Block(heading, bool(stack) and stack[-1][1], bool(stack) and stack[-1][2])

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            block.parts.append(plain)
            if in_link:
                block.linked += len("".join(plain.split()))

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, rest = name.lower(), m["rest"]
        if name == "br":
            block.parts.append(" ")
        if name == "a":
            in_link = 0 if m["close"] else 1
        if not m["close"]:
            if name in BLOCK_TAGS:
                if stack and stack[-1][0] == name and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                    stack.pop()  # these close themselves
                never, vouched = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                if name in CONTENT_TAGS and not never:
                    vouched = True
                if name in NEVER_TAGS or (name == "header" and not vouched) or (name not in ("html", "body", "article", "main") and rest.strip() and (HIDDEN.search(rest) or _names_never(rest, vouched))):
                    never = True
                if name not in VOID_TAGS and not rest.rstrip().endswith("/"):
                    stack.append((name, never, vouched))
                heading = name in HEADINGS
                block = begin()
        elif name in BLOCK_TAGS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            heading = False
            in_link = 0
            block = begin()
    text(page[at:])
    if block.parts:
        out.append(block)
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def _stop_share(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(blocks: list[Block]) -> None:
    """Decide what link density, length and stop words decide. ``blocks``: without clutter."""
    words = [WORDS.findall(b.text.lower()) for b in blocks]
    told = _stop_share([w for ws in words for w in ws]) >= LOW_STOPS / 2
    linked = [b.linked > MAX_LINKS * len(b.text.replace(" ", "")) for b in blocks]
    i = 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and linked[j]:
            j += 1
        for b in blocks[i:j] if j - i >= MENU else ():
            b.label, b.in_menu, b.rule = False, True, "links"
        i = max(j, i + 1)
    for b, ws, is_link in zip(blocks, words, linked):
        if b.in_menu or is_link:
            continue
        if not b.vouched and len(b.text) < 2 * SHORT and RIGHTS.match(b.text):
            b.label, b.rule = False, "rights"
        elif len(b.text) >= SHORT and (not told or _stop_share(ws) >= LOW_STOPS):
            b.label, b.rule = True, "stop words" if told else "length"


def second_pass(blocks: list[Block]) -> None:
    """Give open blocks the label of the nearest decided one."""
    before: list[int | None] = []
    last = None
    for i, b in enumerate(blocks):
        before.append(last)
        last = i if b.label is not None else last
    labels = [b.label for b in blocks]
    after = None
    for i in range(len(blocks) - 1, -1, -1):
        b, left, right = blocks[i], before[i], after
        if labels[i] is not None:
            after = i
            continue
        b.rule = "neighbour"
        if left is None and right is None:
            b.label, b.rule = True, "nothing decided"
        elif left is None or right is None:
            b.label = labels[right if left is None else left]
        elif i - left != right - i:
            b.label = labels[left if i - left < right - i else right]
        else:
            b.label = labels[right if b.heading else left]


def classify(blocks: list[Block]) -> None:
    """Label every block: content or not."""
    rest = []
    for b in blocks:
        if b.never:
            b.label, b.rule = False, "clutter"
        else:
            rest.append(b)
    size = sum(len(b.text) for b in rest)
    if 2 * sum(len(b.text) for b in rest if b.vouched) >= size > 0:
        for b in rest:
            if not b.vouched:
                b.label, b.rule = False, "outside the article"
        rest = [b for b in rest if b.vouched]
        first_pass(rest)
        for b, following in zip(rest, rest[1:]):
            if b.label is None and b.heading and following.in_menu:
                b.label, b.in_menu, b.rule = False, True, "neighbour"
        rest = [b for b in rest if not b.in_menu]
    else:
        for b in rest:
            b.vouched = False
        first_pass(rest)
        if not any(b.label for b in rest):
            rest = [b for b in rest if b.label is None]
    second_pass(rest)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label)


def rules(pages: DataFrame, source: str = "html") -> DataFrame:
    """(rule, label, blocks): how many blocks of all pages each rule has decided, and how."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[tuple[str, bool]] = Counter()
            for p in batch.column(0).to_pylist():
                blocks = blocks_of(p or "")
                classify(blocks)
                n.update((b.rule, bool(b.label)) for b in blocks)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], names=["rule", "label", "blocks"])

    return pages.select(source).mapInArrow(lean(run), "rule string, label boolean, blocks long").groupBy("rule", "label").agg(F.sum("blocks").alias("blocks"))


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html column."""
    at = pages.columns.index(source)
    names = [f"c{i}" for i in range(len(pages.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(len(names))], names=names)

    plain = pages.toDF(*names)
    schema = ", ".join(f"`{f.name}` {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(plain.schema))
    return plain.mapInArrow(lean(run), schema).toDF(*[text if i == at else c for i, c in enumerate(pages.columns)])


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
