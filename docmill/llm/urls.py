"""URL filters: explicit rules, and a logistic regression on hashed character n-grams for all other URLs.

The classifier is fitted on the driver from a small labelled table by Newton-like steps on the regularised loss,
always to the same weights. Scoring is one pass of numpy over the bytes of host and path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.plans.shared import bounded_batches, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path prefix); a rule holds for its host and all its subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Words of hosts that a filter of training data blocks, and of hosts that it allows; the labelled table is made from them.
BLOCK_WORDS = (
    "casino poker slots jackpot roulette blackjack baccarat betting bets wager bookmaker lottery lotto bingo gambling pills viagra cialis pharmacy meds steroids xanax tramadol diet slimming "
    "adult porn sex xxx nude naked cams webcam escort hookup erotic milf dating singles loans payday forex crypto bitcoin trading profit bonus spam clickbait popunder popup adserver ads adclick "
    "tracker tracking banners pixel redirect doorway linkfarm backlinks seo warez crack cracked keygen torrent serials nulled replica fake knockoff counterfeit cheap free win winner prize giveaway "
    "discount deals hacked unlock followers"
).split()
ALLOW_WORDS = (
    "news weather museum library university school college academy journal science physics chemistry biology astronomy history geography geology music theatre opera poetry novel books bookshop recipes "
    "cooking bakery garden flowers city council parliament court railway station harbour river mountain forest valley island farm village town castle church doctor hospital clinic health nursing sport "
    "football tennis chess cycling hiking running travel hotel photo camera film cinema radio guide manual docs developer compiler database kernel python network source project blog diary forum archive "
    "gallery painting sculpture teacher student research institute society club union family kitchen school energy solar wind water ocean climate animals birds insects horses language grammar dictionary "
    "encyclopedia translation letters essays daily morning evening post times herald tribune gazette observer review magazine"
).split()
# What comes before hosts and after them; neutral paths, and those of one kind.
SUBDOMAINS = ["", "www.", "m.", "blog."]
NEUTRAL_PATHS = ["/", "/en/4711", "/de/12.html", "/fr/915/", "/es/33071", "/index.html"]
BLOCK_PATHS = ["/bonus/claim", "/click/out/77", "/offer/win-now", "/buy/cheap", "/go/redirect/9", "/join-free"]
ALLOW_PATHS = ["/about", "/articles/2021/05/a-title", "/docs/guide.html", "/contact", "/archive/1998/", "/wiki/page"]


def hosts_of(words: Sequence[str]) -> list[str]:
    """Hosts of one word, and of two with and without a hyphen, each word with others of the same kind."""
    n = len(words)
    return [h for i, w in enumerate(words) for h in (w, f"{w}-{words[(i + 7) % n]}", f"{words[(i + 19) % n]}{w}")]


def labelled_urls(block: Sequence[str] = tuple(BLOCK_WORDS), allow: Sequence[str] = tuple(ALLOW_WORDS)) -> list[tuple[str, bool]]:
    """(url, block?): every host with neutral paths and with some of its kind; and the empty URL, which is allowed."""
    out = [("", False)]
    for label, words, own in ((True, block, BLOCK_PATHS), (False, allow, ALLOW_PATHS)):
        for i, h in enumerate(hosts_of(words)):
            paths = (NEUTRAL_PATHS[i % 6], own[i % 6], own[(i + 2) % 6])
            out += [(f"https://{SUBDOMAINS[(i + k) % 4]}{h}.example{p}", label) for k, p in enumerate(paths)]
    return out


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty if there is none."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path, action) of the longest rule that fits, of equal ones the first by code point; else nulls."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


class Classifier:
    """Logistic regression on the presence of hashed byte n-grams of host, with marks at its ends, and path."""

    def __init__(self, bits: int = 14, grams: Sequence[int] = (3, 4, 5), l2: float = 0.2, steps: int = 300):
        self.bits, self.grams, self.l2, self.steps = bits, tuple(grams), l2, steps
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def features(self, hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs, each once, sorted by row."""
        raw = [f"\x01{h}\x02{p}\x03".encode("utf-8", "replace") for h, p in zip(hosts, paths, strict=True)]
        n = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw) + bytes(max(self.grams)), np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(len(raw)), n)
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        rows, features = [], []
        for g in self.grams:
            i = np.flatnonzero(place <= n[row] - g)
            h = np.full(len(i), g, np.uint32)
            for k in range(g):
                h = (h ^ data[i + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            rows.append(row[i])
            features.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - self.bits))
        both = np.unique(np.concatenate(rows) << self.bits | np.concatenate(features))
        return both >> self.bits, both & ((1 << self.bits) - 1)

    def fit(self, hosts: Sequence[str], paths: Sequence[str], labels: Sequence[bool]) -> Classifier:
        row, feature = self.features(hosts, paths)
        y, m = np.asarray(labels, float), len(labels)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=m)))
        v, vb = np.zeros_like(self.weights), 0.0
        for _ in range(self.steps):  # gradient descent with momentum
            less = 1 / (1 + np.exp(-self.margin(row, feature, m))) - y
            g = np.bincount(feature, (less * scale)[row], len(self.weights)) / m + self.l2 / m * self.weights
            v, vb = 0.9 * v - 4 * g, 0.9 * vb - 0.4 * less.mean()
            self.weights, self.bias = self.weights + v, self.bias + vb
        return self

    def margin(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(1, np.bincount(row, minlength=n))
        return np.bincount(row, self.weights[feature], n) / np.sqrt(count) + self.bias

    def probability(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        if not len(hosts):
            return np.zeros(0)
        row, feature = self.features(hosts, paths)
        return 1 / (1 + np.exp(-self.margin(row, feature, len(hosts))))


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[end:]
    return rest[:end].lower(), path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def trained(labelled: Sequence[tuple[str, bool]] | None = None, **options: float) -> Classifier:
    rows = labelled_urls() if labelled is None else list(labelled)
    parts = [_split(u) for u, _ in rows]
    return Classifier(**options).fit([h for h, _ in parts], [p for _, p in parts], [y for _, y in rows])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, bool]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, p_block) for every row of pages.

    verdict is the action of the longest rule that fits, else block if the classifier gives at least threshold.
    p_block is the classifier's probability, null where a rule decides. Null URLs and those without :// have an empty host and
    path, fit no rule and are judged by the classifier's view of an empty string. Rows are judged one by one; other columns are
    ignored.
    """
    model = trained(labelled)

    @F.pandas_udf("double")
    def p_block(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            yield pd.Series(model.probability(host.tolist(), path.tolist()), dtype=float)

    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule).withColumn("verdict", action)
    asked = rows.where("rule is null").withColumn("p_block", p_block("host", "path")).withColumn("verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    with bounded_batches(pages.sparkSession):
        asked = written(asked, "scored-urls")
    out = rows.where("rule is not null").withColumn("p_block", F.lit(None).cast("double")).unionByName(asked)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "p_block")
