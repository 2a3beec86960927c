"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line's weight is the
length of its text outside links; lines in menus, headers, footers, sidebars,
notices, adverts, forms and comment areas weigh nothing. Weights are summed over
sliding windows of lines: the text surges where a window first passes the
threshold and dives where a window is empty again; lines between a surge and its
dive are kept, on every page and over all lines. Lines in marked elements (article,
main, or a class such as entry-content) have a part of the threshold added to their
sums, the share of the page's unskipped text that such elements hold: short
paragraphs of an article that is the whole text stay, a teaser gains little. Lines
outside are judged by their own sums. An article in a skipped area, or with a noise
class of its own, is skipped like anything else there. A page on which no window
reaches the threshold keeps all its unskipped lines that are not mostly links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import ship

WINDOW = 3
#: Characters of a window at which text surges; a marked line has up to as many on top.
SURGE = 86

# Element names and class words.
_RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_TAG = re.compile(r"(?s)<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?/][^>]*>")
_SKIP = frozenset("head nav header footer aside form menu dialog button fieldset template svg select object".split())
_MARKED = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start of the named one ends, and the ones that keep it from reaching further out.
_ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "tr": ("tr", "table thead tbody tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
}
_ENDS = {k: tuple(frozenset(x.split()) for x in v) for k, v in _ENDS.items()}
_PARAGRAPH = (frozenset(["p"]), frozenset("td th caption table button".split()))
_CLASS = re.compile(r"(?i)\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")
_NOISE = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|warning|"
    r"sidebar\w*|side|menu\w*|nav\w*|breadcrumb\w*|topbar|masthead|header\w*|footer\w*|comment\w*|respond|disqus\w*|replies|"
    r"share\w*|sharing|social\w*|related\w*|recommend\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|search\w*|pagination|pager|widget\w*|"
    r"navigation|complementary|contentinfo|search|form)(?:$|[\s_-])"
)
#: On headings and elements that hold words only a whole class: "ad", not "alert-level".
_NOISE_WHOLE = re.compile(_NOISE.pattern.replace(r"(?:^|[\s_-])", r"(?:^|\s)", 1).replace(r"(?:$|[\s_-])", r"(?:$|\s)").replace(r"\w*", ""))
_WORDS = frozenset("h1 h2 h3 h4 h5 h6 p li dd dt td th tr figcaption blockquote pre span em strong b i".split())
#: On article and main only what a class starts with: "comment-body", not "has-sidebar" or "category-social".
_NOISE_FIRST = re.compile(_NOISE.pattern.replace(r"(?:^|[\s_-])", r"(?:^|\s)", 1))
#: Classes such as "legal-notice-article" name an article, unless they start with a noise word ("ad-article").
_NAMES_ARTICLE = re.compile(r"(?i)(?<!\S)\S+[_-]article(?!\S)")
_ARTICLE_ROLE = re.compile(r"(?i)(?:^|[\s_-])(?:main|article|articlebody|post-content|entry-content|article-body|story-body)(?:$|[\s])")


def _without_articles(words: str) -> str:
    """Classes without those that name an article and do not start with a noise word."""
    return _NAMES_ARTICLE.sub(lambda m: m[0] if _NOISE_FIRST.search(m[0]) else "", words)


def _kind(name: str, attrs: str) -> str:
    """skip, marked or plain."""
    if name in _SKIP:
        return "skip"
    if attrs and name not in ("html", "body"):
        if _HIDDEN.search(attrs):
            return "skip"
        words = " ".join(a or b or c for _, a, b, c in _CLASS.findall(attrs))
        if words:
            if (_NOISE_FIRST if name in _MARKED else _NOISE_WHOLE if name in _WORDS else _NOISE).search(_without_articles(words)):
                return "skip"
            if _ARTICLE_ROLE.search(words):
                return "marked"
    return "marked" if name in _MARKED else "plain"


def _closed(tags: list[re.Match]) -> set[int]:
    """Numbers of the opening tags that have a closing tag of their own."""
    opened: dict[str, list[int]] = {}
    out: set[int] = set()
    for i, m in enumerate(tags):
        name = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if opened.get(name):
                out.add(opened[name].pop())
        else:
            opened.setdefault(name, []).append(i)
    return out


def to_lines(page: str) -> list[tuple[str, int, bool, str]]:
    """``(text, weight, marked, element)`` of each block that holds text; weight -1 in skipped areas."""
    page = _RAW.sub(" ", page)
    lines: list[tuple[str, int, bool, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str, int]] = []
    closed: set[int] | None = None
    skips = mutes = marks = links = linked = at = 0
    last = ""

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not mutes:
            parts.append(raw)
            if links:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            weight = 0 if 2 * linked >= len(text) else len(text) - linked  # mostly links: a menu
            lines.append((text, -1 if skips else weight, marks > 0, last))
        parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal skips, mutes, marks, links
        name, kind, _ = stack.pop()
        skips -= kind == "skip"
        mutes -= kind == "mute"
        marks -= kind == "marked"
        links -= name == "a"
        return name

    tags = list(_TAG.finditer(page))
    for number, m in enumerate(tags):
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _BLOCK:
            if not closing and any(n == "svg" for n, _, _ in stack) and all(n != "foreignobject" for n, _, _ in stack):
                while pop() != "svg":  # a block ends a drawing that was left open
                    pass
            flush()
            last = name
        elif name == "br":
            parts.append(" ")
        if closing:
            if any(n == name for n, _, _ in stack):
                while stack:
                    top = stack[-1][0]
                    pop()
                    if top == name:
                        break
            continue
        if name in _VOID:
            continue
        kind = _kind(name, attrs)
        if kind == "skip" and name not in _BLOCK:
            kind = "mute"  # inside a line, which goes on behind it
        for ended, scope in ((_PARAGRAPH,) if name in _BLOCK and name != "body" else ()) + ((_ENDS[name],) if name in _ENDS else ()):
            for depth in range(len(stack) - 1, -1, -1):
                n, k, _ = stack[depth]
                if n in ended:
                    while len(stack) > depth:
                        pop()
                    break
                if n in scope or k in ("skip", "mute"):  # what is skipped stays so to its end
                    break
        ends = name == "body"
        if kind == "marked" and skips + mutes:
            closed = _closed(tags) if closed is None else closed
            ends = all(i not in closed for _, k, i in stack if k in ("skip", "mute"))
        while ends and skips + mutes:  # what was left open before, and is never closed, ends here
            pop()
        if attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        stack.append((name, kind, number))
        skips += kind == "skip"
        mutes += kind == "mute"
        marks += kind == "marked"
        links += name == "a"
    put(page[at:])
    flush()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of one page; empty for a null or textless page."""
    if not page:
        return ""
    lines = to_lines(page)
    weights = [max(0, w) for _, w, _, _ in lines]
    unskipped = sum(len(t) for t, w, _, _ in lines if w >= 0)
    share = sum(len(t) for t, w, m, _ in lines if m and w >= 0) / max(1, unskipped)  # small for a teaser
    added = [surge * share if m and w >= 0 else 0 for _, w, m, _ in lines]
    n, keep = len(lines), [False] * len(lines)
    sums = [sum(weights[i : i + window]) + added[i] for i in range(n)]
    i = 0
    while i < n:
        if sums[i] < surge or not weights[i] + added[i]:
            i += 1
            continue
        end = i
        while end < n and sums[end] > 0:  # a window without text: the dive
            end += 1
        for j in range(i, end):
            keep[j] = lines[j][1] >= 0
        if i and lines[i - 1][3] in ("h1", "h2") and lines[i - 1][1] > 0:
            keep[i - 1] = True
        i = end
    if not any(keep):  # nowhere enough text for a surge, as on a page of one short line
        keep = [w > 0 for w in weights]
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def _extract(window: int, surge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window, surge) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_pages(pages: DataFrame, *, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A null, empty or textless page gives an empty text. Pages are handled one by
    one, so repeated rows come back each and nothing is shuffled; extra columns
    are ignored; an empty table gives an empty result. A page of any length is
    read whole. An unclosed comment, script, style, title, textarea, noscript or
    iframe runs to the page's end, as in browsers; any other unclosed element ends
    with the element around it, an unclosed drawing with the next block too.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(window, surge), "page_id long, url string, text string, n_chars long")
