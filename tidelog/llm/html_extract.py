"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, for every block by itself: a long block with few links and enough function
words is good; a block made of links is bad, and so is a long one with hardly any function words on a page that has many; short ones, and
those in between, are open. Function words are known for some languages; what is enough is measured against the page's own share of
them, and on a page that has none of those (another language, or one without spaces) length and links decide alone. Second
pass: an open block takes the label of its nearest decided neighbour in reading order (one in the same part of the page before
others, ties: good). A page whose blocks are all open is kept as it is.

Where a block stands is evidence, too. Menus, footers, asides, forms, page headers and elements whose class, id or role names such a part
are bad; a name counts only as a whole ("cookie-notice", "ad-slot", but not "has-sidebar"). Where the rules leave something of the
page's <article> or <main>, what is outside of it is bad; a link-made block inside is bad only in a run of such blocks or a list.
Forms and named elements lose their meaning where they hold <main> (a form also where it holds an <article>), and where the page
would be left without any text although they hold good blocks.

Defined cases: null and empty html give an empty text; repeated rows give repeated result rows; an empty table gives an
empty result; unclosed tags and cut-off pages are read as far as they go; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, mapped

# Common function words of English, German, French, Spanish, Italian, Portuguese, Dutch and Russian.
STOP_WORDS = frozenset(
    """a about an and are as at be by for from has have in is it not of on or that the this to was were which with
    aber als am an auf aus bei das dem den der des die ein eine einer es für im in ist mit nicht sich sie und von zu
    au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui sur un une
    al como con de del el en es la las lo los más no o para pero por que se su un una y
    alla che come con da dei del della di e gli i il in la le lo ma non per più si sono sul un una
    ao as com da das do dos e em mais na não no nos os ou para pela por que se sem um uma
    aan dat de die een en er het in is met niet of om op te van voor zijn
    а без был в для до его ее и из или как к не но о от по при с так то у что это""".split()
)
# Elements without running text, and elements that hold a page's boilerplate.
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas select textarea button option".split())
PLACES = frozenset("nav footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROOTS = frozenset("article main".split())
LISTS = frozenset("li dd dt td th option".split())
PARTS = frozenset("div section article main body td ul ol table aside header footer nav form".split())
# Names of boilerplate, and words that such names are combined with.
NAMED = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr
    nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social
    footer masthead comment comments disqus respond reply replies newsletter subscribe signup login popup modal overlay toolbar
    pagination pager contentinfo complementary search skip""".split()
)
NEUTRAL = frozenset("area bar block box bottom button buttons container content form group header inner item items left link links list message main nav outer page panel post posts primary right secondary section site slot sticky text title top unit wrap wrapper".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
RAW = {t: re.compile(rf"</{t}\s*>|</{t}\Z", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
SPACE = re.compile(r"\s+")
DENSE = re.compile("[぀-ヿ㐀-鿿가-힯฀-๿]")
LONG, SHORT, LINKS, KNOWN = 140, 60, 0.5, 0.08


class Block:
    """A block's text, how much of it is linked, and where it stands: in a boilerplate place, in which weighed elements, root and part."""

    __slots__ = ("text", "linked", "place", "weighed", "root", "listed", "part", "size", "stops")

    def __init__(self, text: str, linked: int, place: bool, weighed: tuple[int, ...], root: int, listed: bool, part: int):
        self.text, self.linked, self.place, self.weighed, self.root, self.listed, self.part = text, linked, place, weighed, root, listed, part
        # a character of a script without spaces says as much as some letters
        self.size = len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))
        words = text.lower().split()
        self.stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def named(attributes: str) -> bool:
    """Whether a class, id or role is, as a whole, the name of boilerplate."""
    for a, b, c in NAMES.findall(attributes):
        for name in (a or b or c).split():
            parts = [p.lower() for p in WORD_PARTS.findall(name) if not p.isdigit()]
            if parts and any(p in NAMED for p in parts) and all(p in NAMED or p in NEUTRAL for p in parts):
                return True
    return False


def _end_of(page: str, tag: str, at: int) -> int | None:
    """Where the element of a tag opened before `at` ends, elements of the same tag within it counted."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def blocks_of(page: str) -> tuple[list[Block], set[int], set[int]]:
    """The blocks of a page that aren't empty, in page order; the weighed elements that lose their meaning by what they hold; all forms."""
    import html

    out: list[Block] = []
    void: set[int] = set()
    stack: list[tuple] = []  # tag, place, weighed, root, listed, part
    outside = ("", False, (), 0, False, 0)
    forms: set[int] = set()
    parts: list[tuple[str, bool]] = []
    links = at = serial = 0

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in parts))).strip()
            if text:
                linked = sum(len(SPACE.sub(" ", html.unescape(t)).strip()) for t, inside in parts if inside)
                out.append(Block(text, linked, *(stack[-1] if stack else outside)[1:]))
            parts.clear()

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    links = 0
                    break
            continue
        if tag in RAW and tag != "noscript":
            end = RAW[tag].search(page, at)
            at = end.end() if end else size
            if at < size and page[at - 1] != ">":
                at = size
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            elif attributes and tag not in VOID and not attributes.endswith("/") and named(attributes):
                at = _end_of(page, tag, at) or at
            continue
        flush()
        if closes := CLOSES.get(tag):
            while stack and stack[-1][0] in closes:
                stack.pop()
        links = 0
        if tag in VOID or attributes.endswith("/"):
            continue
        _, place, weighed, root, listed, part = stack[-1] if stack else outside
        serial += 1
        if tag in ROOTS:
            void.update(weighed if tag == "main" else (w for w in weighed if w in forms))
            root = root or serial
        if tag in PLACES or tag in SKIPPED or (tag == "header" and not root):
            place = True
        elif tag == "form" or (attributes and tag not in ("html", "body", "main") and named(attributes)):
            weighed = (*weighed, serial)
            if tag == "form":
                forms.add(serial)
        stack.append((tag, place, weighed, root, listed or tag in LISTS, serial if tag in PARTS else part))
    flush()
    return out, void, forms


def _judge(block: Block, level: float) -> bool | None:
    """First pass: good, bad, or None where the block alone doesn't tell. level: the page's own share of function words, 0 if they aren't known."""
    if block.linked > LINKS * len(block.text):
        return False
    if block.size < SHORT:
        return None
    if block.size >= LONG:
        if block.stops >= level / 2:
            return True
        if block.stops < level / 8 and not block.root:
            return False
    return None


def _labels(blocks: list[Block]) -> list[bool]:
    """Both passes over the blocks of a page."""
    prose = [b for b in blocks if b.size >= SHORT and b.linked <= LINKS * len(b.text)]
    total = sum(len(b.text) for b in prose)
    level = sum(b.stops * len(b.text) for b in prose) / total if total else 0.0
    level = level if level >= KNOWN else 0.0
    labels = [_judge(b, level) for b in blocks]
    links = [x is False and b.linked > LINKS * len(b.text) for b, x in zip(blocks, labels)]
    for i, b in enumerate(blocks):  # a single link in an article may be one of its paragraphs
        if links[i] and b.root and not b.listed and not any(links[j] and blocks[j].root == b.root for j in (i - 1, i + 1) if 0 <= j < len(blocks)):
            labels[i] = None
    if any(b.root and x is not False for b, x in zip(blocks, labels)):
        labels = [x if b.root else False for b, x in zip(blocks, labels)]
    good_roots = {b.root for b, x in zip(blocks, labels) if x}
    nearest: list[list[int]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int, int] = {}  # neighbours outside of a block's article say nothing about what is in it
        for i in order:
            if labels[i] is not None:
                last[blocks[i].root] = i
            elif blocks[i].root in last:
                nearest[i].append(last[blocks[i].root])
    final = [bool(x) for x in labels]
    for i, b in enumerate(blocks):
        if labels[i] is None:
            near = min(((blocks[j].part != b.part, abs(j - i), not labels[j], j) for j in nearest[i]), default=None)
            final[i] = b.root not in good_roots or near is None or bool(labels[near[3]])
    return final


def extract(page: str) -> str:
    """The main text of a page: its good blocks, joined by an empty line."""
    blocks, void, forms = blocks_of(page)
    free = [b for b in blocks if not b.place]
    for meaningless in (void, void | forms, None):
        kept = free if meaningless is None else [b for b in free if not set(b.weighed) - meaningless]
        if chosen := [b for b, good in zip(kept, _labels(kept)) if good]:
            break
        if not any(b.size >= LONG and b.linked <= LINKS * len(b.text) for b in free):
            break
    return "\n\n".join(b.text for b in chosen)


def _extract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for part in chunks(batches, "html", 4 << 20):
        texts = [extract(h) if h else "" for h in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.transform(mapped, _extract, "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
