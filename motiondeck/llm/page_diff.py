"""HTML extraction by differencing each page with the pages of nearest URL.

A page becomes text lines, one for each block of its markup, each with its region: ``main`` (inside
article or main), ``chrome`` (inside navigation, footer, aside, form, script, advert, notice, comments and the like),
``side`` (inside what a class or id calls layout: header, sidebar, search and so on) or ``open``. Pages are sorted by (host, path);
each is aligned by longest common subsequence of its lines with the page before and the page after it on the same host, and
lines shared with either are what the site repeats. Shared open lines and all chrome lines are deleted; main lines stay,
since two pages may carry the same article. Side lines go too, unless the page has no main and no open line left:
then those stay that no neighbour shares. A neighbour that shares over half of both pages' text is a copy, not a
template, and deletes nothing.

A class or id marks chrome only if one of its names is made of such words alone (``comments``, ``ad-box``, ``related-posts``); a name with
any other word (``related-work``, ``share-price``, ``cookie-recipe``) marks nothing. An article that is itself a comment or an
advert, or whose role is complementary, is chrome.

Null html is empty and gives an empty text. Null urls are one host. Repeated rows are copies of one
another. The content of scripts, styles and the like is skipped up to their end tag. Elements whose end tag may be left out (p, li, td and so on) end
where the next one begins or their parent ends; other unclosed elements end with the page. Very long html is one page's memory in its task. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by \\n. Reading a page takes time in proportion to its length: a tag without an end is text,
a quote without a second one is no quote, an end tag without an open element is passed over.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.align import common
from motiondeck.llm.common import shuffle_parts, table

MAIN, OPEN, CHROME, SIDE = 0, 1, 2, 3

_IN_TAG = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "select", "title", "canvas", "audio", "video", "math"}
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "dialog"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_SPACING = {"br", "td", "th"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "source", "col", "area", "base", "embed", "param", "track", "wbr"}
_SIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar"}
#: Elements whose end tag may be left out: what begins after them ends them, within the nearest of some parents.
_LIST, _ROW = {"ul", "ol", "menu"}, {"table", "thead", "tbody", "tfoot"}
_IMPLIED = {"li": ({"li"}, _LIST), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, _ROW), "td": ({"td", "th"}, {"tr", *_ROW}), "th": ({"td", "th"}, {"tr", *_ROW}), "option": ({"option"}, {"select"})}
#: What a paragraph cannot hold.
_ENDS_P = {"p", "div", "ul", "ol", "dl", "li", "table", "section", "article", "main", "aside", "nav", "header", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote", "figure", "address", "fieldset", "details", "menu", "dd", "dt", "td", "tr", "th"}
_HEADING = {"header", "hgroup", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of a class or id that mark no main text, words that may stand beside them, and words of layout.
_SIDE_WORD = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notice\w*|popup|modal|overlay|"
    r"comments?|commentlist|replies|disqus\w*|share|sharing|social\w*|related|recommend\w*|newsletter|subscribe\w*|signup|login|pagination|pager|breadcrumbs?|copyright"
)
_BESIDE = re.compile(
    r"\d*|area|articles?|bar|block|bottom|box|button|buttons|center|column|container|content|entry|foot|footer|form|frame|header|heading|icons?|inner|item|items|js|label|large|layer|left|link|links|list|main|media|"
    r"module|outer|page|panel|popular|post|posts|region|respond|right|row|section|site|slot|small|space|stories|story|text|title|thread|toolbar|top|unit|us|user|widget|widgets|wrap|wrapper|zone"
)
_OWN_WORD = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|comments?|replies")
_LAYOUT_WORD = re.compile(r"(?:^|[\s_-])(?:banner|nav\w*|menu\w*|header|masthead|footer|sidebar|side|aside|search\w*|widget\w*|toolbar)(?=$|[\s_-])", re.I)
_NAME_PART = re.compile(r"[_-]+")
#: A class such as has-sidebar tells of something else on the page.
_ABOUT = re.compile(r"(?<!\S)(?:has|with|without|no|is)[_-]\S*", re.I)
_SPACE = re.compile(r"\s+")
_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)")


def url_key(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2].rstrip("/")) if m else ("", url or "")


_PLAIN, _MAIN, _SOFT, _HARD = range(4)


def _made_of(value: str, words: re.Pattern) -> bool:
    """Whether a name in a class or id has one of the words, and no other word but those that may stand beside them."""
    for name in value.lower().split():
        parts = _NAME_PART.split(name)
        if any(words.fullmatch(x) for x in parts) and all(words.fullmatch(x) or _SIDE_WORD.fullmatch(x) or _BESIDE.fullmatch(x) for x in parts):
            return True
    return False


def _kind(name: str, tag: str, in_main: bool) -> int:
    """What an element says of its content: main text, layout (unless main text is within), no main text at all, or nothing."""
    own = name in ("article", "main")
    if name in _ASIDE or name == "header" and not in_main:
        return _HARD
    kind = _MAIN if own else _PLAIN
    if "=" not in tag or name in ("html", "body"):
        return kind
    for m in _ATTRIBUTE.finditer(tag):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in _SIDE_ROLE:
                return _HARD
            continue
        value = _ABOUT.sub("", value)
        if _made_of(value, _OWN_WORD if own else _SIDE_WORD):
            return _HARD
        if not own and not (in_main and name in _HEADING) and _LAYOUT_WORD.search(value):
            kind = _SOFT
    return kind


class _Scanner:
    """The tokens of a page, each character read a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, 0
        self.gone: set[str] = set()  # what the rest of the page does not have

    def _find(self, what: str, start: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, start)
        if found < 0:
            self.gone.add(what)
        return found

    def _tag_end(self) -> int:
        """Behind the tag that begins here; -1 if nothing ends it."""
        at = self.at + 1
        while self._find(">", at) >= 0:
            m = _IN_TAG.search(self.page, at)
            if m[0] == ">":
                return m.end()
            second = self._find(m[1], m.end())
            at = m.end() if second < 0 else second + 1
        return -1

    def __iter__(self) -> Iterator[str]:
        page, n = self.page, len(self.page)
        while self.at < n:
            begin = self.at
            if page[begin] != "<":
                end = self._find("<", begin)
                self.at = n if end < 0 else end
            elif page.startswith("<!--", begin) or page.startswith("<![CDATA[", begin):
                close = "-->" if page[begin + 2] == "-" else "]]>"
                end = self._find(close, begin + 4)
                self.at = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), begin):
                end = self._find(">", begin)
                self.at = begin + 1 if end < 0 else end + 1
            else:
                letter = page[begin + 1 : begin + 3].lstrip("/")[:1]
                end = self._tag_end() if letter.isascii() and letter.isalpha() else -1
                self.at = begin + 1 if end < 0 else end
            yield page[begin : self.at]


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, region) of every block with text, in page order."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    page = page or ""
    open_: list[tuple[str, int]] = []  # the elements we are in, with their kinds
    names: Counter[str] = Counter()
    counts, region = [0] * 4, OPEN

    def close():
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, region))

    def decide():
        """Main text within layout is main text; within what is none it is not; layout within main text is none."""
        nonlocal region
        if counts[_HARD]:
            region = CHROME
        else:
            region = next((MAIN if k == _MAIN else CHROME if counts[_MAIN] else SIDE for _, k in reversed(open_) if k), OPEN) if counts[_MAIN] or counts[_SOFT] else OPEN

    def leave(size: int):
        kinds = [k for _, k in open_[size:]]
        names.subtract(n for n, _ in open_[size:])
        del open_[size:]
        if any(kinds):
            close()
            for k in kinds:
                counts[k] -= 1
            decide()

    def imply(ended: set[str], parents: set[str]):
        """Ends the elements of some names that the nearest of their parents holds."""
        if not any(names[x] for x in ended):
            return
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in parents:
                break
            if open_[i][0] in ended:
                leave(i)

    scanner, unended = _Scanner(page), set()
    for token in scanner:
        if token[0] != "<" or token == "<":
            held.append(token)
            continue
        named = _NAME.match(token)
        if not named:
            continue
        name, ends = named[1].lower(), token[1] == "/"
        if name in _RAW:
            if not ends and not token.endswith("/>") and name not in unended:
                # from behind the name on: a script may hold what looks like a tag's end, or the tag may have none
                begin = scanner.at - len(token)
                last = _ENDS[name].search(page, named.end() + begin)
                if last:
                    scanner.at = last.end()
                else:
                    unended.add(name)
                    if name in ("script", "style"):
                        scanner.at = len(page)
            continue
        if name in _SPACING:
            held.append(" ")
        elif name not in _INLINE:
            close()
        if ends:
            if names[name]:
                leave(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name))
            continue
        if name in _ENDS_P:
            imply({"p"}, {"div", "section", "article", "main", "aside", "td", "th", "li", "blockquote", "body", "button", "figure"})
        if name in _IMPLIED:
            imply(*_IMPLIED[name])
        if name in _VOID or token.endswith("/>"):
            continue
        kind = _kind(name, token, counts[_MAIN] > 0)
        open_.append((name, kind))
        names[name] += 1
        if kind:
            close()
            counts[kind] += 1
            decide()
    close()
    return out


def shared_lines(hashes: list[int], sizes: list[int], other: list[int], other_sizes: list[int]) -> list[int]:
    """Positions of the lines shared with another page, none if it is a copy."""
    one, two = common(hashes, other)
    if 2 * sum(sizes[i] for i in one) > sum(sizes) and 2 * sum(other_sizes[j] for j in two) > sum(other_sizes):
        return []
    return one


def _line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


_KEY = ["host", "path", "page_id", "tie"]
_SORTED = "bucket int, guest boolean, host string, path string, page_id bigint, tie bigint, url string, lines array<string>, regions array<int>, hashes array<bigint>, sizes array<int>"
_ARROW = pa.schema([("bucket", pa.int32()), ("guest", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("tie", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string())), ("regions", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int32()), ("n_shared", pa.int32())])


def _key(page_id, url, tie) -> tuple:
    return (*url_key(url), -(1 << 63) if page_id is None else page_id, tie)


def _ranges(marks: list[tuple]):
    """The smallest and the largest key of each range that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "tie")), strict=True):
                k = _key(*row)
                b = bisect_right(marks, k)
                old = found.setdefault(b, [k, k])
                if k < old[0]:
                    old[0] = k
                if k > old[1]:
                    old[1] = k
        rows = [(b, *k) for b, ks in found.items() for k in ks]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["bucket", *_KEY])

    return run


def _parsed(marks: list[tuple], guests: dict[tuple, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = []
                for page_id, url, tie, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "tie", "html")), strict=True):
                    k = _key(page_id, url, tie)
                    found = lines_of(page)
                    hashes, sizes = [_line_hash(x) for x, _ in found], [len(x) for x, _ in found]
                    rows.append((bisect_right(marks, k), False, *k[:2], page_id, tie, url, [x for x, _ in found], [r for _, r in found], hashes, sizes))
                    rows += [(b, True, *k[:2], page_id, tie, url, None, None, hashes, sizes) for b in guests.get(k, ())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and key: each page with the lines left after both neighbours have been held against it."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                yield from batch.slice(at, 500).to_pylist()

    def finish(before: dict | None, page: dict, after: dict | None) -> tuple:
        shared: set[int] = set()
        for other in (before, after):
            if other is not None and other["host"] == page["host"] and other["bucket"] == page["bucket"]:
                shared.update(shared_lines(page["hashes"], page["sizes"], other["hashes"], other["sizes"]))
        found = list(enumerate(zip(page["lines"], page["regions"], strict=True)))
        kept = [x for i, (x, r) in found if r == MAIN or r == OPEN and i not in shared] or [x for i, (x, r) in found if r == SIDE and i not in shared]
        return page["page_id"], page["url"], "\n".join(kept), len(page["lines"]), len(shared)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * len(_OUT)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    before = page = None
    done: list[tuple] = []
    for after in rows():
        if page is not None and not page["guest"]:
            done.append(finish(before, page, after))
            if len(done) >= 500:
                yield batch_of(done)
                done = []
        before, page = page, after
    if page is not None and not page["guest"]:
        done.append(finish(before, page, None))
    yield batch_of(done)


def extract(pages: DataFrame, sample: int = 100_000, range_bytes: int = 1 << 24) -> DataFrame:
    """page_id, url, text, n_lines, n_shared of every page.

    Ranges of (host, path) come from a hash sample of at most about ``sample`` keys, so a host with most of
    the pages has most of the ranges; the first and last page of each range are also lent, as line hashes,
    to the ranges beside it. A range holds about ``range_bytes`` of html, more where the sample's keys give fewer ranges than that (beyond 1.6 TB);
    tasks sort their range on disk and stream it, so that bounds no memory. How pages fall into ranges does not change the result.
    """
    keyed = pages.select(F.col("page_id").cast("bigint"), "url", F.xxhash64("html").alias("tie"), "html")
    keys = keyed.select("page_id", "url", "tie")
    rows, size = keyed.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    every = max(1, rows // sample)
    parts = max(4 * shuffle_parts(pages.sparkSession), (size or 0) // range_bytes)
    some = sorted(_key(*r) for r in keys.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0).collect())
    marks = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []
    ends: dict[int, list[tuple]] = {}
    for r in keys.mapInArrow(_ranges(marks), "bucket int, host string, path string, page_id bigint, tie bigint").groupBy("bucket").agg(F.min(F.struct(*_KEY)).alias("lo"), F.max(F.struct(*_KEY)).alias("hi")).collect():
        ends[r.bucket] = [tuple(r.lo), tuple(r.hi)]
    guests: dict[tuple, list[int]] = {}
    order = sorted(ends)
    for left, right in zip(order, order[1:], strict=False):
        guests.setdefault(ends[left][1], []).append(right)
        guests.setdefault(ends[right][0], []).append(left)
    rows = keyed.mapInArrow(_parsed(marks, guests), _SORTED)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "host", "path", F.coalesce("page_id", F.lit(-(1 << 63))), "tie", "guest")
    return rows.mapInArrow(_cleaned, "page_id bigint, url string, text string, n_lines int, n_shared int")


def op5_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_shared")


