"""URL filters: exact rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is host/path-prefix; it fits the host and all its subdomains if the URL's path starts with the prefix."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def prefix(self) -> str:
        return self.rule[len(self.host) :]


#: The rules of the query's contract.
RULES = (
    UrlRule("com/", "allow"),
    UrlRule("example.com/en/", "block"),
    UrlRule("www.example.com/en/", "allow"),
    UrlRule("net/es/", "block"),
    UrlRule("net/fr/", "block"),
)

#: Words of the hosts that block lists name, by category, and of ordinary sites. Hosts of the table are made of them.
BLOCK_WORDS = (
    "casino poker slots jackpot roulette blackjack bets betting wager lottery gambling win-prize "  # gambling
    "porn xxx adult escort cams nude sex hentai webcam-girls erotic "  # adult
    "viagra cialis pills pharmacy meds steroids weightloss diet-pills painkillers "  # drugs
    "warez crack keygen serials torrent cracked-games nulled pirated "  # piracy
    "phishing malware spyware trojan verify-account login-update exploit botnet "  # attacks
    "ads adserver ad-track tracking tracker popunder clicks banner-ads affiliate doubleclick pixel-track "  # advertising
    "spam backlinks linkfarm seo-links content-farm clickbait spam-blog link-exchange traffic-bot "  # spam
    "payday loans quick-cash get-rich forex-bonus replica-watches fake-id miracle-cure crypto-double"  # fraud
).split()
CLEAN_WORDS = (
    "library museum university school college academy news herald tribune weather garden recipes kitchen bakery "
    "hiking travel maps history archive music theatre cinema orchestra forum wiki encyclopedia research institute "
    "journal docs guide software data-portal physics mathematics chemistry biology hospital clinic dental police council government "
    "parliament railway airport harbour timetable football cricket cycling sailing photography painting ceramics furniture "
    "stationery bookshop florist veterinary wildlife forest river mountain valley westfield brookdale harrington lindqvist moreau "
    "takahashi oliveira novak petersen attention station tradition theory another mention nation reading ending winning"
).split()


def labelled_table(block: list[str] = BLOCK_WORDS, clean: list[str] = CLEAN_WORDS) -> tuple[tuple[str, int], ...]:
    """(host and path, 1 for block): every word in some hosts, with the same affixes and paths for both labels."""
    affixes = ("{a}", "{a}-online", "best-{a}", "www.{a}{b}", "m.my{a}", "{b}-and-{a}", "free-{a}", "blog.{a}-club", "the{a}", "{a}24", "{a}{b}")
    paths = ("", "/", "/en/12", "/index.html", "/de/a/3", "/page/7?x", "/fr/88/", "/es/new")
    rows = []
    for words, label in ((block, 1), (clean, 0)):
        for i, a in enumerate(words):
            for k in range(7):
                n = i + 3 * k
                rows.append((affixes[n % len(affixes)].format(a=a, b=words[(i * 7 + k + 1) % len(words)]) + (".example", ".example.org", ".example.net")[n % 3] + paths[n // 2 % len(paths)], label))
    return tuple(rows)


#: The labelled URL table.
LABELLED = labelled_table()

BUCKETS = 1 << 17


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), both null without one; of equal rules the first."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.prefix)
        rule = F.when(fits, F.lit(r.rule)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, orders: tuple[int, ...] = (3, 4, 5)) -> np.ndarray:
    """Buckets of the character n-grams of host and path, each hashed with its part's name; digits count as one digit."""
    out = []
    for part, text in (("h", host), ("p", path)):
        text = f"^{''.join('0' if c.isdigit() else c for c in text)}$"
        out += [crc32(f"{part}{text[i : i + n]}".encode()) % BUCKETS for n in orders for i in range(len(text) - n + 1)]
    return np.unique(np.array(out, np.int64))


def fit(labelled: tuple[tuple[str, int], ...] = LABELLED, epochs: int = 300, rate: float = 0.1, l2: float = 1e-3, clean_weight: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by full-batch gradient descent over the small labelled table. A clean row counts
    ``clean_weight`` times, so that hosts that resemble neither kind pass."""
    rows = []
    for url, _ in labelled:
        host, slash, path = url.partition("/")
        rows.append(features(host, slash + path))
    y = np.array([label for _, label in labelled], float)
    at, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.bincount(of, minlength=len(rows)))
    counts = np.where(y == 1, 1.0, clean_weight)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(np.bincount(of, w[at], len(rows)) * scale + b)))
        error = (p - y) * counts
        w -= rate * (np.bincount(at, (error * scale)[of], BUCKETS) * 100 / len(y) + l2 * w)
        b -= rate * error.mean()
    return w, b


def judge_urls(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, the longest fitting rule (null without one), verdict (the rule's, else
    ``block`` where the model's score is 0.5 or more, else ``allow``) and the model's score, 0 to 1.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and gets the model's verdict on
    empty strings. Very long URLs are read whole. Repeated rows give repeated rows; an empty table gives no rows. Only the
    two named columns are read.
    """
    weights, bias = fit(labelled)
    weights = weights.astype(np.float32)
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = (
        pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
        .select("_id", "host", "path", rule.alias("rule"), ruled.alias("_ruled"))
    )
    kind = parts.schema["_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, verdicts = [], []
            for host, path, given in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                at = features(host, path)
                z = float(weights[at].sum()) / max(len(at), 1) ** 0.5 + bias
                scores.append(float(1 / (1 + np.exp(-z))))
                verdicts.append(given or ("block" if scores[-1] >= 0.5 else "allow"))
            columns = [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "host", "path", "rule", "verdict", "score"])

        return step

    return arrow_map(parts, make, f"_id {kind}, host string, path string, rule string, verdict string, score double", 4096).withColumnRenamed("_id", id_col)
