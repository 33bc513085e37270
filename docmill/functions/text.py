"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.vocabulary import NAME_SUFFIXES, STOPWORDS, TFIDF_STOPWORDS

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}\p{Co}]+"  # without the underscore: what the lexical index takes as a token


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: inside other lambdas, a column's expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def all_matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, group))


def words(c: Column | str, pattern: str = WORD) -> Column:
    return all_matches(F.lower(F.coalesce(col(c), F.lit(""))), pattern)


def without(tokens: Column, stop: Iterable[str], shortest: int = 2) -> Column:
    """Tokens that are long enough and no stopwords, repeats kept."""
    return F.filter(tokens, lambda t: (F.length(t) >= shortest) & ~t.isin(sorted(stop)))


def query_terms(c: Column | str) -> Column:
    """Terms of a query for BM25. Marks inside a word stay: what they join is looked for as a phrase."""
    return without(words(c), STOPWORDS)


def term_parts(c: Column | str) -> Column:
    """What the lexical index has of a term: one token, or, of a term like foo_bar, several."""
    return words(c, TERM)


def tfidf_tokens(c: Column | str) -> Column:
    return without(words(c), TFIDF_STOPWORDS)


def squeeze(c: Column | str) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalized(c: Column | str) -> Column:
    return squeeze(F.lower(F.coalesce(col(c), F.lit(""))))


def slug(c: Column | str) -> Column:
    """Anchor of a heading."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"(?U)[^\w\s-]", ""), r"(?U)\s+", "-")


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def kebab_to_pascal(c: Column | str) -> Column:
    return F.array_join(F.transform(F.split(col(c), "-"), lambda w: capitalized(w)), "")


def pascal_to_kebab(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), "(.)([A-Z][a-z]+)", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2"))


def strip_html(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", ""))


# Elements beside a page's text, and what becomes of the others: (pattern, replacement), one after the other. Only what Java's and
# RE2's patterns have in common is used.
BESIDE = ("script", "style", "nav", "header", "footer", "aside", "form")
MARKDOWN_RULES = [
    (r"(?s)<!--.*?-->", " "),
    (r"[ \t\r\n\f]+", " "),
    *[(f"(?i)<{tag}( [^>]*)?>.*?</{tag} ?>", "\n") for tag in BESIDE],
    *[(f"(?i)<h{n}( [^>]*)?>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)<li( [^>]*)?>", "\n- "),
    (r"(?i)</?(h[1-6]|p|div|br|hr|section|article|main|ul|ol|li|table|tr|blockquote|pre)( [^>]*)?/?>", "\n"),
    (r"<[^>]*>", ""),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
    (" *\n *", "\n"), ("\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+\z", ""),
]


def html_to_markdown(c: Column | str) -> Column:
    """A page's text as markdown: headings, list items and paragraphs on lines of their own, without what stands beside the text.

    White space is one space, in code too; the commonest character references are decoded. Null: empty.
    """
    out = F.coalesce(col(c), F.lit(""))
    for pattern, replacement in MARKDOWN_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def url_host(c: Column | str) -> Column:
    """What stands between the first :// and the next /, ?, # or end, in lower case; empty without ://."""
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(c: Column | str) -> Column:
    """What follows the host up to ?, # or end; empty without ://."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def without_suffix(c: Column, suffixes: Iterable[str] = NAME_SUFFIXES) -> Column:
    """c less the first of the suffixes that it ends with."""
    out = c
    for s in reversed(list(suffixes)):
        out = F.when(c.endswith(s), F.substr(c, F.lit(1), F.length(c) - len(s))).otherwise(out)
    return out


def stem_of(path: Column | str) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def chunk_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


#: Fixed value: the public name space of domain names (RFC 4122).
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(c: Column) -> Column:
    """The name-based UUID (version 5) of an id."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS)), c.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_uri(source: Column, path: Column, anchor: Column) -> Column:
    return F.concat(F.lit("docs://"), source, F.lit("/section/"), path, F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(F.lit("#"), anchor)).otherwise(""))


def snippet(content: Column, terms: Column, length: int = 200, before: int = 50, tail: bool = False) -> Column:
    """The text around the earliest of the terms, with ellipses where it is cut.

    Without a match: the beginning, or with ``tail`` the last ``before`` characters.
    """
    found = F.filter(F.transform(terms, lambda t: F.instr(F.lower(content), t)), lambda p: p > 0)
    n = F.length(content)
    at = F.coalesce(F.array_min(found) - 1, n if tail else F.lit(0))
    start = F.greatest(F.lit(0), at - before)
    end = F.least(n, start + length)
    cut = F.trim(F.substr(content, start + 1, end - start))
    cut = F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")
    text = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < n, "...").otherwise(""))
    return F.regexp_replace(text, r"(?U)\s+", " ")


def marked_snippet(content: Column, terms: Column, window: int = 32, mark: str = "**") -> Column:
    """The window of that many words with the earliest term near its start, terms marked, ellipses where it is cut."""
    pieces = F.split(F.trim(content), r"(?U)\s+")
    bare = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]+", "")
    hit = F.transform(pieces, lambda w: F.array_contains(terms, bare(w)))
    start = F.greatest(F.array_position(hit, True) - 1 - window // 4, F.lit(0)).cast("int")
    shown = F.transform(F.slice(pieces, start + 1, F.lit(window)), lambda w: F.when(F.array_contains(terms, bare(w)), F.concat(F.lit(mark), w, F.lit(mark))).otherwise(w))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(start + window < F.size(pieces), "...").otherwise(""))


def usage_snippet(content: Column, component: Column) -> Column:
    """The text around the first of a component's tags that occurs, else the beginning."""
    kebab, low, n = pascal_to_kebab(component), F.lower(content), F.length(content)
    at = F.coalesce(*[F.nullif(F.instr(low, F.concat(F.lit(p), kebab)), F.lit(0)) for p in ("<", "<app-", "<tds-")])
    start = F.greatest(F.lit(1), at - 50)
    end = F.least(n, at + 199)
    around = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(content, start, end - start + 1), F.when(end < n, "...").otherwise(""))
    return F.when(at.isNotNull(), around).otherwise(F.when(n > 300, F.concat(F.substring(content, 1, 300), F.lit("..."))).otherwise(content))
