"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Menus, headers, footers, sidebars, notices, adverts, forms, comments and the like
are told by their element, role, or a word of their class or id; scripts, styles and other contents that aren't text are dropped. The
first pass decides on the remaining blocks by stop-word density, length and link density; short ones stay ambiguous. Names that
may be a topic, as compounds with a word of their own, yield to the density of a long block.
The second pass lets those inherit the label of the nearest decided neighbours. A marked article (article, main, role=main,
itemprop=articleBody) is evidence: inside it a block needs less to be good and none but links can make it bad, and blocks outside are bad as
long as some block inside is good. Names that a main part may bear, too, never empty a page: where no block is left, those that only such names told are judged like others.

Stop words are those of four languages; a page whose long blocks hold hardly any is taken to be in another one, and length and links decide.
Within a block character references are decoded and white space turns into one space.

Results in special cases: a null or empty html, or a page without main text, gives the empty text; repeated rows each
give a row; an empty table gives an empty one; other columns are ignored, whatever their names. A tag that the
page's end cuts off is dropped; unclosed elements end where their container does.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

# Function words of four languages.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can for from had has have he her his how i if in into is it its
    just like more my no not of on one only or other our out over she so some than that the their them then there these they
    this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die dies durch ein eine einem einen einer es für
    hat ich ihr im in ist kein mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war
    was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais me ne nous on ou
    où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous y à
    al como con de del desde donde el ella ellos en entre era es esta este esto fue ha han hasta la las lo los más me mi
    muy no nos o para pero por porque que se ser si sin sobre su sus también te un una uno y ya""".split()
)
# Elements that begin and end blocks, whose contents aren't text, or that hold what isn't the article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER_TAGS = frozenset("article aside blockquote body details dialog dir div dl fieldset figure footer form head header html li main menu nav ol search section table tbody td tfoot thead tr ul".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
# Elements whose contents are a control or stand for what isn't shown: dropped where they are closed; a tag that nothing closes is markup alone.
INSET_TAGS = frozenset("template applet svg canvas audio video select button datalist".split())
REGIONS = frozenset("article main footer nav aside".split())
WITHIN = frozenset("div section li ul ol td tr".split())
BOILER_TAGS = frozenset("head nav footer aside form menu dialog search".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words of class names and ids that tell what isn't the article, and those that say that something lacks or only has such a part.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notification notifications alert popup modal overlay newsletter subscribe "
    "subscription social share sharing related recommended recommendations comment comments respond replies disqus widget widgets toolbar "
    "pagination pager legal copyright disclaimer login signin signup search skip hidden".split()
)
MODIFIERS = frozenset("has no not non with without is overflow hide show".split())
#: Names that a page's main part may bear, too.
SOFT_NAMES = frozenset("search legal share social related recommended recommendations hidden sidebar widget widgets header skip copyright promo promotion banner overlay modal popup alert notice masthead".split())
#: Soft names that say the least.
PLAIN_NAMES = frozenset({"alert", "widget", "widgets"})
#: Names that tell boilerplate outside an article alone: inside, they are often its own parts.
OUTSIDE_NAMES = frozenset({"header"})

#: Words that such a compound ends in, or begins with, where it names a part of the page and not what the part is about.
PARTS = frozenset(
    "area areas bar bars block blocks body bottom box boxes btn button buttons col column container content center close desktop form frame group head holder icon icons id inner item items label left "
    "line link links list lists logo main message mobile module msg nav outer page pane panel post posts primary right row secondary section sections site slot small social stories strip sub tab text thread "
    "title toggle top unit view wrap wrapper wide widget zone".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
MOST_LINKS, ARTICLE_LINKS = 0.33, 0.8
NAMED_LINKS = 0.05
#: Stop-word density of a page's long blocks under which its language isn't one of STOP_WORDS.
FOREIGN = 0.12

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
COPYRIGHT = re.compile(r"\s*(?:\xa9|\(c\)|copyright\b)", re.IGNORECASE)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A block of text; boiler: what told it ("name", "about", another reason, or ""); label is good, bad, or near or short until the second pass has decided."""

    text: str
    link_chars: int
    tag: str
    boiler: str
    article: bool
    label: str = ""


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html_entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _boiler(tag: str, attrs: dict[str, str], in_article: bool) -> str:
    """Why an element isn't part of the article: "sure", "name" where only a soft name says so, "about" where a name may be a topic, "" if nothing does; the first of these is the greatest."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return "sure"
    if attrs.get("role", "").lower() in BOILER_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return "sure"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return "sure"
    told = {_named(x, in_article) for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()}
    return max(told, default="")


def _named(token: str, in_article: bool) -> str:
    """Whether a class or id is one of the names, or a compound that begins or ends with one (cookie-notice, sidebarLeft, post-comments): "name" if soft ones alone say so."""
    names = BOILER_NAMES if in_article else BOILER_NAMES | OUTSIDE_NAMES
    parts = [x.lower() for x in NAME_PARTS.findall(token)]
    if whole := {token.lower()} & names:
        return "about" if whole <= PLAIN_NAMES else "name" if whole <= SOFT_NAMES else "sure"
    told = set() if not parts or MODIFIERS & {*parts} else {parts[0], parts[-1]} & names
    # a compound with a word of its own says what its text is about as well as that it is boilerplate (ad-lib, menu-item-desc)
    own = [x for x in parts if x not in names and x not in PARTS and len(x) > 2]
    return "" if not told else "about" if parts[0] in told and parts[-1] in own else "name" if told <= SOFT_NAMES else "sure"


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order, not labelled yet."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # container, why it is boilerplate or "", within an article
    open_: dict[str, list[int]] = {}  # places in the stack of each open container, and of REGIONS' ones
    regions: list[int] = []
    parts: list[tuple[str, bool]] = []
    links, tag_now, inline_boiler, own_boiler = 0, "", "", ""
    lower: str | None = None
    ends: dict[str, int] = {}  # where no end tag of these follows any more

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html_entities.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = " ".join(html_entities.unescape("".join(p for p, a in parts if a)).split())
                why, article = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                out.append(Block(text, len(linked), tag_now, why or own_boiler, article))
            parts = []

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            if not inline_boiler:
                parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if tag in RAW_TAGS or tag in INSET_TAGS:
            if not closing and not (m[3].endswith("/") and tag not in RAW_TAGS):
                lower = lower if lower is not None else _ascii_lower(page)
                end = lower.find(f"</{tag}", at) if at < ends.get(tag, n) else -1
                close = page.find(">", end) if end >= 0 else -1
                if end < 0:
                    ends[tag] = at
                if tag in RAW_TAGS:
                    at = close + 1 if close >= 0 else n
                # another one that begins before the end has it, so this one was never closed
                elif close >= 0 and lower.find(f"<{tag}", at, end) < 0:
                    at = close + 1
            if tag in ("select", "button", "textarea", "title"):
                parts.append((" ", False))
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag not in BLOCK_TAGS:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            if inline_boiler == tag and closing:
                inline_boiler = ""
            elif not closing and not inline_boiler and tag not in VOID_TAGS and tag in ("span", "small", "label") and m[3] and _boiler(tag, attributes(m[3]), bool(stack and stack[-1][2])):
                inline_boiler = tag
            continue
        flush()
        links, inline_boiler, own_boiler, tag_now = 0, "", "", "" if closing else tag
        if tag not in CONTAINER_TAGS or tag in VOID_TAGS:
            own_boiler = "" if closing or not m[3] else _boiler(tag, attributes(m[3]), bool(stack and stack[-1][2]))
            continue
        if closing:
            k = open_[tag][-1] if open_.get(tag) else -1
            # a stray end tag doesn't leave a region
            if k >= 0 and not (tag in WITHIN and regions and regions[-1] > k):
                for name, _, _ in stack[k:]:
                    open_[name].pop()
                del stack[k:]
                while regions and regions[-1] >= k:
                    regions.pop()
            continue
        why, article = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        if tag == "body" and why == "head":
            stack.clear()
            open_.clear()
            regions.clear()
            why, article = "", False
        attrs = attributes(m[3]) if m[3] else {}
        marked = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
        if marked and why == "form":
            why = ""  # some pages are one form
        if why in ("", "name", "about") and tag not in ("html", "body") and not (marked and tag in ("article", "main")) and (told := _boiler(tag, attrs, article)):
            why = tag if tag in ("head", "form") else told if not why else max(why, told)
        open_.setdefault(tag, []).append(len(stack))
        if tag in REGIONS:
            regions.append(len(stack))
        stack.append((tag, why, article or (marked and not why)))
    flush()
    return out


def _ascii_lower(page: str) -> str:
    return page.translate({c: c + 32 for c in range(65, 91)})


def classify(found: list[Block]) -> list[Block]:
    """Labels every block good or bad. Density overrules a name that may be a topic on long blocks rich in stop words and with hardly a link."""
    for b in found:
        if b.boiler == "about" and len(b.text) > 2 * LENGTH_LOW and b.link_chars <= NAMED_LINKS * len(b.text) and stop_density(b.text) >= STOP_HIGH:
            b.boiler = ""
    for trusted in (("sure", "head", "form", "name", "about"), ("sure", "head", "form")):
        for only_article in (True, False):
            left = [b for b in found if b.boiler not in trusted and (b.article or not only_article)]
            for b in found:
                b.label = "bad"
            _decide(left)
            _inherit(left)
            if any(b.label == "good" for b in left):
                return found
        if not any(b.boiler in ("name", "about") for b in found):
            break
    return found


def _decide(left: list[Block]) -> None:
    """The first pass over what is no boilerplate."""
    long = [b for b in left if len(b.text) >= LENGTH_LOW]
    foreign = stop_density(" ".join(b.text for b in long)) < FOREIGN
    for b in left:
        links, stop = b.link_chars / len(b.text), STOP_HIGH if foreign else stop_density(b.text)
        if b.article:
            if links > ARTICLE_LINKS:
                b.label = "short"
            else:
                b.label = "good" if len(b.text) >= LENGTH_HIGH or stop >= STOP_LOW else "near" if len(b.text) >= LENGTH_LOW else "short"
        elif links > MOST_LINKS:
            b.label = "bad"
        elif len(b.text) < LENGTH_LOW:
            b.label = "bad" if b.link_chars or COPYRIGHT.match(b.text) else "short"
        elif stop >= STOP_HIGH:
            b.label = "good" if len(b.text) > LENGTH_HIGH else "near"
        else:
            b.label = "near" if stop >= STOP_LOW else "bad"


def stop_density(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _inherit(left: list[Block]) -> None:
    """The second pass: short and near blocks get the label of the nearest decided neighbours: both alike, or else the closer one; near ones and headings beat a bad neighbour at the same distance. Without any, those of an article and near ones are good."""
    decided = [b.label if b.label in ("good", "bad") else "" for b in left]
    n = len(left)
    before: list[tuple[str, int]] = []
    last = ("", n + 1)
    for x in decided:
        last = (x, 0) if x else (last[0], last[1] + 1)
        before.append(last)
    after: list[tuple[str, int]] = [("", n + 1)] * n
    last = ("", n + 1)
    for k in range(n - 1, -1, -1):
        last = (decided[k], 0) if decided[k] else (last[0], last[1] + 1)
        after[k] = last
    for k, b in enumerate(left):
        if decided[k]:
            continue
        (p, dp), (q, dq) = before[k], after[k]
        if not p and not q:
            b.label = "good" if b.article or b.label == "near" else "bad"
        elif p == q or not p or not q:
            b.label = p or q
        elif b.label == "near" or (b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and q == "good"):
            b.label = "good"
        elif dp == dq:
            b.label = "good" if b.article else "bad"
        else:
            b.label = p if dp < dq else q


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text string) of every row."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([main_text(x) for x in batch.columns[-1].to_pylist()], pa.string())], names=[*batch.schema.names[:-1], "text"])

    rows = pages.select(id_col, *keep, F.col(html_col).cast("string").alias("_html"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_html")
    return rows.mapInArrow(run, f"{head}, text string")
