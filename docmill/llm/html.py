"""Main text of pages by deduced templates: equivalence classes of tokens (Arasu and Garcia-Molina 2003).

1. Tokens. The start and the end of an element at its path of elements, and a block's whole text at its path. The token
   sequences of the different pages of every host are written once; copies of a page count once.
2. Classes. A token's occurrence vector has a number for each page of the host; tokens with one vector are a class. Vectors are not
   built: a vector is known by the sums, over its pages, of hashes of (page, number), which combine before the shuffle and so
   never bring a host's pages together. A token that all pages have as often is told apart by its number in the page. Classes
   that most pages have are candidates.
3. Nesting. In each page a candidate must be ordered (its tokens come in one order, any number of times) and nested: each
   occurrence lies between two neighbouring tokens of another class's occurrence, its gap, or holds others in its own gaps. Tokens that
   are out of their class's order in too many pages leave it. Of classes that cross, the more frequent stays. A class that is valid, and has one parent and gap, in most of its pages is in the
   host's template, a tree. Where a gap always has the same number of occurrences of a class, these are told apart.
4. Slots. A gap of the tree, with the gaps around it, is a slot. What the pages hold there is summed up: how much text, how much of
   it in links, and what names of elements say. The slots of the article are those that names tell, or without such names
   the element with most text and what surrounds it. Texts that are template tokens are the site's.

A page's text is what its article's slots hold. Hosts of few pages have no template; their pages go by names alone.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.worker import released
from docmill.llm.urls import host_of
from docmill.llm.words import mix
from docmill.plans.shared import bounded_batches, release, sized, written

# Elements and names.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What is no text whatever names say.
NO_TEXT = frozenset("head script style template noscript textarea title iframe object embed svg math canvas audio video select".split())
#: Elements that hold parts of a page.
CONTAINERS = frozenset("html body div section article main aside nav header footer form td center dialog".split())
ASIDE = frozenset("head nav aside footer form menu dialog script style template noscript textarea title iframe object embed svg math canvas audio video select button search".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disclaimer disqus footer "
    "gdpr menu modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promoted promotion related replies reply responses share sharing sidebar "
    "sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Parts of longer names that say the same.
ASIDE_PARTS = ("advert", "adsby", "breadcrumb", "comment", "cookie", "navbar", "newsletter", "sidebar", "sponsor")
#: Names of what has articles of its own, such as readers' comments.
OWN_ARTICLES = frozenset("comment comments commentlist discussion disqus promoted related replies reply responses sponsored".split())
#: Elements that are never beside the text by their names, which tell the page's layout.
UNNAMED = frozenset("html body main article".split())
#: Names that say whether something else is there.
_STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:open|closed|enabled|disabled)", re.I)
#: Beside the main text unless it is in an article, whose own header holds its title.
HEADER_NAMES = frozenset("header masthead".split())
MAIN_NAMES = frozenset("article content entry main post story".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note status toolbar".split())
#: An opening tag of the first kind closes an open element of these kinds, if no element of the third kind lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_P_CLOSERS = BLOCKS - {"body", "html", "head", "button", "caption", "dd", "dt", "legend", "li", "optgroup", "option", "select", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}


@lru_cache(4096)
def _element(tag: str, attributes: str, names: bool = True) -> tuple[str, bool, int, bool, int]:
    """(name in paths, is it beside the main text, is it so by its names, is it a header, how surely it holds the article) of an opening tag.

    By its names: 0 no, 1 yes, 2 what is named may have articles of its own. Without ``names`` only what is no text at all is beside it.
    """
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    called = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _NAME.findall(" ".join(c for c in called.split() if not _STATE.fullmatch(c)))}
    role, hidden = found.get("role", "").lower(), "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").lower().replace(" ", "")
    beside = tag in ASIDE or role in ASIDE_ROLES or hidden
    named = 2 if words & OWN_ARTICLES or any("comment" in w for w in words) else 1 if words & ASIDE_NAMES or any(p in w for w in words for p in ASIDE_PARTS) else 0
    sure = 3 if tag == "article" or role == "article" else 2 if tag == "main" or role == "main" else 1 if words & MAIN_NAMES else 0
    header = tag == "header" or bool(words & HEADER_NAMES)
    if not names:
        beside, named, sure, header = tag in NO_TEXT, 0, 0, False
    if tag in UNNAMED or role in UNNAMED:
        named, header = 0, False
    return tag + "".join(f".{c}" for c in sorted(found.get("class", "").split())), beside, named, header, sure


class Block:
    """A block's text, where it is, whether it is beside the main text, how surely it is in an article, and whether that is in an element beside it by name."""

    __slots__ = ("path", "text", "beside", "inside", "linked", "outer")

    def __init__(self, path: str, text: str, beside: bool, inside: int, linked: int, outer: int = 0):
        self.path, self.text, self.beside, self.inside, self.linked, self.outer = path, text, beside, inside, linked, outer


def parse(page: str, names: bool = True) -> Iterator[str | Block]:
    """The path of every element, / and the path where it ends, and every block with text, in page order."""
    # tag, path, beside, how surely inside an article, beside by a name inside that article, or by one around it
    stack: list[tuple[str, str, bool, int, int, int]] = []
    parts: list[str] = []
    linked = at = 0

    def here() -> tuple[str, str, bool, int, int, int]:
        return stack[-1] if stack else ("", "", False, 0, 0, 0)

    def block() -> Iterator[Block]:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                # Inline elements aren't part of a block's place.
                for tag, path, beside, inside, named, outer in reversed(stack):
                    if tag in BLOCKS or beside or named:
                        yield Block(path, text, beside or named > 0, inside, linked, outer)
                        break
                else:
                    yield Block("", text, False, 0, linked)
        linked = 0

    def said(text: str) -> Iterator[Block]:
        nonlocal linked
        if text:
            text = entities.unescape(text)
            parts.append(text)
            if any(s[0] == "a" for s in stack[-4:]):
                linked += len(text)
        return iter(())

    def close(k: int) -> Iterator[Block]:
        if any(s[0] in BLOCKS or s[2] or s[4] for s in stack[k:]):
            yield from block()
        for s in reversed(stack[k:]):
            yield "/" + s[1]
        del stack[k:]

    while m := _TOKEN.search(page, at):
        yield from said(page[at : m.start()])
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                yield from said(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[0][1] == "/":
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                yield from close(k)
            elif tag in ("p", "br"):
                yield from block()
            continue
        if tag in _P_CLOSERS:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in ("button", "td", "th", "table", "object")), None)
            if k is not None and stack[k][0] == "p":
                yield from close(k)
        if tag in CLOSES:
            kinds, stops = CLOSES[tag]
            low = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in kinds:
                    low = i
            if low is not None:
                yield from close(low)
        name, beside, named, header, sure = _element(tag, m[2] if m[1] else m[4], names)
        _, path, above, inside, named_above, outer = here()
        if header and inside < 3:
            beside, named = beside or tag == "header", named or 1
        if (beside or named) and not (above or named_above) or tag in BLOCKS:
            yield from block()
        if tag == "br":
            parts.append(" ")
        beside = above or beside
        path = f"{path}>{name}"
        yield path
        if tag in VOID:
            continue
        named = max(named, named_above)
        if sure > inside:  # names around a container, or its own, don't decide about it
            inside, outer, named = sure, max(outer, named), 0
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag in ("textarea", "title"):
                stack.append((tag, path, True, inside, named, outer))
                yield from said(page[at : end.start() if end else len(page)])
                yield from block()
                stack.pop()
            at = end.end() if end else len(page)
            continue
        stack.append((tag, path, beside, inside, named, outer))
    yield from said(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", page[at:]))  # a tag cut off at the end isn't text
    yield from block()
    yield from close(0)


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: The last bits of a token: what starts and ends an element that holds parts of a page, whose tokens are equal but for these.
OPENS, CLOSES_IT = 1, 2


@lru_cache(1 << 16)
def _path_hash(path: str) -> int:
    plain = path.removeprefix("/")
    if plain[plain.rfind(">") + 1 :].split(".", 1)[0] in CONTAINERS:
        return _hash("path", plain) & ~3 | (OPENS if plain == path else CLOSES_IT)
    return _hash("path", path) & ~3


def _tokens(page: str, names: bool = True) -> tuple[list[int], list[str | Block]]:
    events = list(parse(page, names))
    return [_path_hash(e) if isinstance(e, str) else _hash("text", e.path, e.text) & ~3 for e in events], events


_HEADING = re.compile(r"h[1-6](?:\.|$)")
#: Marks of a block beside its length: does it lie in a heading, is it mostly links, is it beside the main text, is it in what is named an article.
HEAD, LINKS, BESIDE, SURE = 1, 2, 4, 8


def _marks(b: Block) -> int:
    heading = any(_HEADING.match(p) for p in b.path.rsplit(">", 3)[1:])
    return len(b.text) << 4 | HEAD * heading | LINKS * (2 * b.linked > len(b.text)) | BESIDE * (b.beside or b.outer > 0) | SURE * (b.inside > 0)


def _sequences(names: bool):
    """(host, page, tokens, marks): marks are 0 for what isn't text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: tuple[list, list] = ([], [])
            for page in batch.column(2).to_pylist():
                tokens, events = _tokens(page or "", names)
                lists[0].append(tokens)
                lists[1].append([0 if isinstance(e, str) else _marks(e) for e in events])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["host", "page", "tokens", "marks"])

    return run


PAGE = 3  # the token that every page has once
#: A token that every page has as often, up to this many times, is told apart by its number in the page.
TOLD_APART = 16


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, starts of runs of equal keys in that order); equal keys keep their order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, j, pages, sums of hashes of (page, number), sum of places, least and greatest number), added up over a batch.

    A row for each of the first occurrences j of a token in a page; hashes and numbers are in the row of the first.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        names, host = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        lists = batch.column(2)
        size = np.diff(np.asarray(lists.offsets))
        token, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(size)), size)
        place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        every = np.arange(len(size))
        token, row, place = np.concatenate((np.full(len(size), PAGE), token)), np.concatenate((every, row)), np.concatenate((np.full(len(size), -1), place))
        order, start = _runs(row, token)
        token, row, place = token[order], row[order], place[order]
        number = np.diff(np.append(start, len(order)))
        j = np.arange(len(order)) - np.repeat(start, number)
        number = np.repeat(number, number)
        kept = j < TOLD_APART
        token, row, place, j, number = token[kept], row[kept], place[kept], j[kept], number[kept]
        h = mix(np.asarray(batch.column(1))[row].astype(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = j == 0
        sums = np.stack([np.ones(len(j), np.int64), (h & np.uint64(0x7FFFFFFF)).astype(np.int64) * first, (h >> np.uint64(33)).astype(np.int64) * first, place], axis=1)
        owner = host[row]
        order, start = _runs(owner, token, j)
        sums = np.add.reduceat(sums[order], start, axis=0)
        low, high = np.minimum.reduceat(number[order], start), np.maximum.reduceat(number[order], start)
        at = order[start]
        yield pa.RecordBatch.from_arrays([pa.array(names[owner[at]], pa.string()), pa.array(token[at]), pa.array(j[at]), *(pa.array(sums[:, i].copy()) for i in range(4)), pa.array(low), pa.array(high)], ["host", "token", "j", "n", "p", "q", "place", "low", "high"])


def _bodies(pages: DataFrame) -> DataFrame:
    """(host, body, html): the different pages of every host. Only pages that come again are shuffled, one of each task."""
    keyed = pages.select("host", F.xxhash64("html").alias("body"), "html")
    again = written(keyed.groupBy("host", "body").count().where("count > 1").select(F.col("host").alias("h"), F.col("body").alias("b")), "repeated")
    again = sized(again)
    same = keyed.host.eqNullSafe(again.h) & (keyed.body == again.b)
    return keyed.join(again, same, "left_anti").union(keyed.join(again, same, "left_semi").distinct())


class Template:
    """Classes of tokens with what is known of their nesting, and slots with what they hold.

    told is JSON: classes as tokens (token, j) and pages, j being -1 or the token's number in the page; evidence as (class, parent,
    gap, pages, born, least, most); slots as (key, characters, of these in headings, in links, beside, in what is named an article).
    """

    def __init__(self, told: str | None, share: float = 0.9):
        found = json.loads(told) if told else {}
        self.classes = [[(t["token"], t["j"]) for t in c["tokens"]] for c in found.get("classes") or []]
        pages = [c["n"] for c in found.get("classes") or []]
        self.sizes = [len(c) for c in self.classes]
        self.rank = sorted(range(len(self.classes)), key=lambda c: (-pages[c], -self.sizes[c], c))
        self.fixed: set[int] = set()
        self.parents: dict[int, tuple[int, int]] = {}
        valid = set(range(len(self.classes)))
        if "evidence" in found:
            fits, born, total = {}, {}, {}
            for e in found["evidence"] or []:
                if e["parent"] == ABOUT:
                    fits[e["cls"]] = e["pages"]
                    if e["least"] == e["most"] and 1 < e["most"] <= TOLD_APART:
                        self.fixed.add(e["cls"])
                else:
                    total[e["cls"]] = total.get(e["cls"], 0) + e["born"]
                    born[e["cls"]] = max(born.get(e["cls"], (0, 0, 0)), (e["born"], -e["parent"], -e["gap"]))
            valid = {c for c in valid if fits.get(c, 0) >= share * pages[c] and born[c][0] >= share * total[c]}
            self.parents = {c: (-born[c][1], -born[c][2]) for c in valid}
        self.of: dict[int, dict[int, tuple[int, int]]] = {}
        for c in valid:
            for k, (t, j) in enumerate(self.classes[c]):
                self.of.setdefault(t, {})[j] = (c, k)
        self.rejected = rejected({s["slot"]: s | {"region": self.region(s["slot"])} for s in found.get("slots") or []})

    def places(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(class, place in it) of each token of a page; ROOT for those of no class."""
        out, numbers = [], {}
        for t in tokens:
            here = self.of.get(t)
            if here is None:
                out.append((ROOT, 0))
            elif -1 in here:
                out.append(here[-1])
            else:
                j = numbers[t] = numbers.get(t, -1) + 1
                out.append(here.get(j, (ROOT, 0)))
        return out

    def key(self, frames: tuple[tuple[int, int, int], ...]) -> str:
        return "/".join(f"{c}:{o}.{g}" if c in self.fixed else f"{c}.{g}" for c, g, o in frames)

    def region(self, key: str) -> tuple:
        """The elements that hold parts of a page and are open at a slot, outermost first."""
        out: list[tuple[str, int]] = []
        for part in key.split("/")[1:]:
            of, gap = part.rsplit(".", 1)
            for k, (t, _) in enumerate(self.classes[int(of.split(":")[0])][: int(gap) + 1]):
                if t & 3 == OPENS:
                    out.append((of, k))
                elif t & 3 == CLOSES_IT and out:
                    out.pop()
        return tuple(out)

    def fit(self, tokens: list[int], texts: set[int]) -> tuple[set[int], list, dict, dict]:
        """(classes that are valid in a page, births, repetitions, frames of its texts), see _aligned()."""
        at = self.places(tokens)
        kept = _ordered(at, self.sizes)
        found = _aligned(at, texts, self.sizes, kept)
        if found is None:  # of classes that cross, those that come first by rank stay
            wanted, kept = kept, set()
            for c in self.rank:
                if c in wanted and _aligned(at, set(), self.sizes, kept | {c}) is not None:
                    kept.add(c)
            found = _aligned(at, texts, self.sizes, kept)
        return kept, *found

    def misplaced(self, tokens: list[int]) -> dict[int, list[int]]:
        """Of classes that have each token once in a page, but not in order: places of those that are least in number and put the others in order."""
        seen: dict[int, list[int]] = {}
        for c, k in self.places(tokens):
            if c != ROOT:
                seen.setdefault(c, []).append(k)
        return {c: out_of_order(ks) for c, ks in seen.items() if len(ks) == self.sizes[c] == len(set(ks)) and ks != sorted(ks)}


def out_of_order(ks: list[int]) -> list[int]:
    """What is left of distinct numbers without a longest rising subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, k in enumerate(ks):
        n = bisect_left(ends, k)
        before.append(at[n - 1] if n else -1)
        ends[n : n + 1], at[n : n + 1] = [k], [i]
    i, rising = at[-1] if at else -1, set()
    while i >= 0:
        rising.add(ks[i])
        i = before[i]
    return sorted(set(ks) - rising)


ROOT, ABOUT = -1, -2  # the document as a class, and the parent in rows about a class itself


def _ordered(at: list[tuple[int, int]], sizes: list[int]) -> set[int]:
    """Classes whose tokens come in their order in a page, once or again and again."""
    due: dict[int, int] = {}
    wrong = set()
    for c, k in at:
        if c != ROOT:
            if due.get(c, 0) != k:
                wrong.add(c)
            due[c] = (k + 1) % sizes[c]
    return {c for c, k in due.items() if not k and c not in wrong}


def _aligned(at: list[tuple[int, int]], texts: set[int], sizes: list[int], kept: set[int]) -> tuple[list, dict, dict] | None:
    """How ordered classes nest in a page; None if they cross.

    births: (class, parent, gap) of every occurrence. repetitions: least and most occurrences of a class in one gap. frames: for each
    wanted text that is no token of a class, (class, gap, number among its like in the gap around) from the document to the innermost.
    """
    frames: list[list] = [[ROOT, 0, 0, {}]]
    births: list[tuple[int, int, int]] = []
    repeats: dict[int, tuple[int, int]] = {}
    slots: dict[int, tuple[tuple[int, int, int], ...]] = {}

    def count(counts: dict[int, int]) -> None:
        for c, m in counts.items():
            low, high = repeats.get(c, (m, m))
            repeats[c] = min(low, m), max(high, m)
        counts.clear()

    for i, (c, k) in enumerate(at):
        if c not in kept:
            if i in texts:
                slots[i] = tuple((f[0], f[1], f[2]) for f in frames)
            continue
        top = frames[-1]
        if k == 0:
            top[3][c] = top[3].get(c, 0) + 1
            births.append((c, top[0], top[1]))
            if sizes[c] > 1:
                frames.append([c, 0, top[3][c], {}])
        elif top[0] != c:
            return None
        else:
            count(top[3])
            top[1] = k
            if k == sizes[c] - 1:
                frames.pop()
    count(frames[0][3])
    return births, repeats, slots


@lru_cache(64)
def _template(told: str | None) -> Template:
    return Template(told)


def _disorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class, place, pages in which the token there is out of order), added up over a batch."""
    for batch in batches:
        found: dict[tuple[str, int, int], int] = {}
        for host, tokens, told in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for c, ks in _template(told).misplaced(tokens).items():
                for k in ks:
                    found[host, c, k] = found.get((host, c, k), 0) + 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2)), pa.array(list(found.values()), pa.int64())], ["host", "cls", "k", "n"])


def _nesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class, parent, gap, pages, born, least, most), added up over a batch."""
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for host, tokens, told in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kept, births, repeats, _ = _template(told).fit(tokens, set())
            for c in kept:
                low, high = repeats[c]
                row = found.setdefault((host, c, ABOUT, 0), [0, 0, low, high])
                row[0] += 1
                row[2], row[3] = min(row[2], low), max(row[3], high)
            for b in births:
                found.setdefault((host, *b), [0, 0, 0, 0])[1] += 1
        keys, values = list(found), list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))] + [pa.array([v[i] for v in values], pa.int64()) for i in range(4)], ["host", "cls", "parent", "gap", "pages", "born", "least", "most"])


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, characters, of these in headings, in links, beside, in what is named an article), added up over a batch."""
    for batch in batches:
        found: dict[tuple[str, str], list[int]] = {}
        for host, tokens, marks, told in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            template = _template(told)
            _, _, _, frames = template.fit(tokens, {i for i, m in enumerate(marks) if m})
            for i, f in frames.items():
                n = marks[i] >> 4
                row = found.setdefault((host, template.key(f)), [0] * 5)
                row[0] += n
                for k, bit in enumerate((HEAD, LINKS, BESIDE, SURE)):
                    row[1 + k] += n * bool(marks[i] & bit)
        keys, values = list(found), list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(2)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(5)], ["host", "slot", "chars", "head", "links", "beside", "sure"])


def rejected(slots: dict[str, dict]) -> set[str]:
    """Slots that don't hold article text, by what they hold on all pages of the host.

    Beside the article are slots that mostly names put there. If no slot is named as an article's, the region with most text that
    isn't mostly links is it, with what is inside it and around it; other regions stay if they have a quarter of its text, and so do
    headings.
    """
    out = {k for k, s in slots.items() if 2 * s["beside"] > s["chars"]}
    rest = {k: s for k, s in slots.items() if k not in out}
    if any(2 * s["sure"] > s["chars"] for s in rest.values()):
        return out
    links = {k for k, s in rest.items() if 2 * s["links"] > s["chars"]}
    by: dict[tuple, int] = {}
    for k, s in rest.items():
        if k not in links:
            by[s["region"]] = by.get(s["region"], 0) + s["chars"]
    if not by:
        return out
    main = min(by, key=lambda r: (-by[r], r))
    for k, s in rest.items():
        of = s["region"]
        inside = of == main[: len(of)] or main == of[: len(main)]
        if k in links or not inside and 4 * by[of] < by[main] and 2 * s["head"] <= s["chars"]:
            out.add(k)
    return out


def templates(pages: DataFrame, share: float = 0.9, least: int = 10, names: bool = True) -> DataFrame:
    """(host, pages, template): for hosts of at least ``least`` different pages, JSON as Template reads it.

    pages: (host, html). A class is a candidate if at least that share of the host's different pages has it, and is in the
    template if it is valid with one parent and gap in that share of its pages. A host's template has at most 1 / share as many tokens
    as its pages have on average.
    """
    known = pages.where("host <> ''")
    sequences = written(_bodies(known).mapInArrow(released(_sequences(names)), "host string, page long, tokens array<long>, marks array<long>"), "sequences")
    vectors = sequences.select("host", "page", "tokens").mapInArrow(released(_vectors), "host string, token long, j long, n long, p long, q long, place long, low long, high long")
    sums = [F.sum(c).alias(c) for c in ("n", "p", "q", "place")]
    vectors = written(vectors.groupBy("host", "token", "j").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("n") >= least), "vectors")
    hosts = sized(vectors.where(F.col("token") == PAGE).select("host", F.col("n").alias("pages"), F.col("p").alias("every_p"), F.col("q").alias("every_q")))
    first = lambda c: F.max(F.when(F.col("j") == 0, F.col(c))).alias(c)
    tokens = vectors.where(F.col("token") != PAGE).groupBy("host", "token").agg(*[first(c) for c in ("n", "p", "q", "low", "high")], F.sort_array(F.collect_list(F.struct("j", (F.col("place") / F.col("n")).alias("at")))).alias("places"))
    often = tokens.join(hosts, "host").where(F.col("n") >= share * F.col("pages"))
    apart = (F.col("low") == F.col("high")) & F.col("high").between(2, TOLD_APART) & (F.col("n") == F.col("pages"))
    often = often.withColumn("place", F.explode(F.when(apart, F.col("places")).otherwise(F.slice("places", 1, 1))))
    often = often.select("host", "pages", "n", F.when(apart, F.col("every_p")).otherwise(F.col("p")).alias("p"), F.when(apart, F.col("every_q")).otherwise(F.col("q")).alias("q"), F.struct(F.col("place.at").alias("at"), "token", F.when(apart, F.col("place.j")).otherwise(-1).alias("j")).alias("t"))
    classes = often.groupBy("host", "pages", "n", "p", "q").agg(F.sort_array(F.collect_list("t")).alias("t"))
    one = F.struct(F.col("t")[0].alias("first"), F.struct(F.transform("t", lambda t: F.struct(t["token"].alias("token"), t["j"].alias("j"))).alias("tokens"), "n").alias("c"))
    classes = written(classes.groupBy("host", "pages").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"]).alias("classes")), "classes")
    told = lambda *columns: F.to_json(F.struct(*columns)).alias("template")
    by_page = sequences.select("host", "page", "tokens")

    # Tokens that are out of their class's order in more pages than may differ leave it.
    wrong = with_templates(by_page, classes.select("host", told("classes"))).select("host", "tokens", "template").mapInArrow(released(_disorder), "host string, cls long, k long, n long")
    wrong = wrong.groupBy("host", "cls", "k").agg(F.sum("n").alias("n")).groupBy("host").agg(F.collect_list(F.struct("cls", "k", "n")).alias("wrong"))
    away = lambda c, i, k: F.exists(F.coalesce("wrong", F.array().cast("array<struct<cls:long,k:long,n:long>>")), lambda w: (w["cls"] == i) & (w["k"] == k) & (w["n"] > (1 - share) * c["n"]))
    kept = F.transform("classes", lambda c, i: F.struct(F.filter(c["tokens"], lambda t, k: ~away(c, i, k)).alias("tokens"), c["n"].alias("n")))
    classes = written(classes.join(wrong, "host", "left").select("host", "pages", F.filter(kept, lambda c: F.size(c["tokens"]) > 0).alias("classes")), "classes-in-order")

    evidence = with_templates(by_page, classes.select("host", told("classes"))).select("host", "tokens", "template").mapInArrow(released(_nesting), "host string, cls long, parent long, gap long, pages long, born long, least long, most long")
    evidence = evidence.groupBy("host", "cls", "parent", "gap").agg(*[F.sum(c).alias(c) for c in ("pages", "born")], F.min("least").alias("least"), F.max("most").alias("most"))
    evidence = evidence.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("cls", "parent", "gap", "pages", "born", "least", "most"))).alias("evidence"))
    nested = written(classes.join(evidence, "host"), "nested")
    held = with_templates(sequences, nested.select("host", told("classes", "evidence"))).select("host", "tokens", "marks", "template")
    held = held.mapInArrow(released(_slot_sums), "host string, slot string, chars long, head long, links long, beside long, sure long")
    held = held.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("chars", "head", "links", "beside", "sure")])
    held = held.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "chars", "head", "links", "beside", "sure"))).alias("slots"))
    out = written(nested.join(held, "host", "left").select("host", "pages", told("classes", "evidence", "slots")), "templates")
    release(sequences, vectors, classes, nested)
    return out


#: Pages of a host that one task reads with its template, if templates are too many to go to every task.
PAGES_AT_ONCE = 20_000


def with_templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages(host, ...) with the template of their host, or null.

    The templates go to every task if they are seen to be small. If not, the pages are dealt by host; those of a host with
    many pages by host and a number, as many as the host's size asks for.
    """
    few = sized(found)
    if few is not found:
        return pages.join(few, "host", "left")
    large = pages.groupBy("host").count().where(F.col("count") > PAGES_AT_ONCE).select("host", F.ceil(F.col("count") / PAGES_AT_ONCE).cast("int").alias("parts"))
    large = sized(written(large, "large-hosts"))
    own = [c for c in ("page", "page_id") if c in pages.columns]
    dealt = pages.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64(*own), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    salted = found.join(large, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(salted, ["host", "part"], "left").drop("part")


def _judged(page: str, told: str | None, names: bool = True) -> list[tuple[Block, bool]]:
    """The blocks of a page in order, each with whether it is a text of its host's template. Those in rejected slots are beside the text."""
    tokens, events = _tokens(page, names)
    template = _template(told)
    texts = {i for i, e in enumerate(events) if not isinstance(e, str)}
    _, _, _, frames = template.fit(tokens, texts)
    out = []
    for i in sorted(texts):
        b, shared = events[i], i not in frames
        if not shared and template.key(frames[i]) in template.rejected:
            b.beside = True
        out.append((b, shared))
    return out


def slots(page: str, told: str | None) -> list[Block]:
    """The blocks of a page that aren't texts of its host's template, in page order."""
    return [b for b, shared in _judged(page, told) if not shared]


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _article(blocks: list[Block]) -> list[Block]:
    """Those of the blocks that are in the surest container; without one, those that aren't mostly links.

    A container in an element beside the text by its name counts if there is no other text, or if it is an article or main,
    surer than what holds the other text and longer; but readers' comments and the like count only if there is no other text.
    """

    def surest(blocks: list[Block]) -> list[Block]:
        sure = max((b.inside for b in blocks), default=0)
        return [b for b in blocks if b.inside == sure and (sure or 2 * b.linked <= len(b.text))]

    blocks = [b for b in blocks if not b.beside]
    found = surest([b for b in blocks if not b.outer])
    for level in (1, 2):
        named = surest([b for b in blocks if b.outer == level])
        if named and (not found or level == 1 and named[0].inside > max(1, found[0].inside) and _size(named) > _size(found)):
            found = named
    return found


def main_text(page: str | None, told: str | None = None, names: bool = True) -> str:
    """The article of a page: blocks joined by blank lines.

    Texts of the template are left out of an article of which they are the smaller part. Where they are the larger,
    the host's pages are near copies of each other and what they share is their text: the article stays whole, unless
    nothing in it is the page's own and more of the page's own text is elsewhere.
    """
    judged = _judged(page or "", told, names)
    shared = {id(b) for b, s in judged if s}
    whole = _article([b for b, _ in judged])
    own = [b for b in whole if id(b) not in shared]
    if not own and _size(elsewhere := _article([b for b, s in judged if not s])) > _size(whole):
        own = whole = elsewhere
    if not own or whole[0].inside and 2 * _size(own) < _size(whole):
        own = whole
    return "\n\n".join(b.text for b in own)


def _extract(names: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, told, names) for page, told in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, share: float = 0.9, least: int = 10, names: bool = True) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages.

    Null and blank pages have an empty text, and so have pages without an article's blocks. Character references are
    decoded, white space inside a block is one space, blocks are joined by two line ends. Hosts of fewer than ``least``
    different pages have no template, nor have pages without a host. Without ``names``, what elements are called tells nothing and
    the template alone says what the article is. Equal rows are each returned; other columns are ignored. Texts of any length are
    parsed whole, in time proportional to it.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    with bounded_batches(pages.sparkSession):
        found = templates(rows.select("host", "html"), share, least, names)
        joined = with_templates(rows, found.select("host", "template"))
        out = joined.select("page_id", "url", "html", "template").mapInArrow(released(_extract(names)), f"page_id {kind}, url string, text string")
        out = written(out, "texts")
    release(found)
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
