"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features.

Operator 9.  The trees are trained on the driver from a bounded set of labelled URLs; judging a
URL needs the URL alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Verdicts of hosts with a path prefix.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

#: Labelled URLs of each class that the trees are fitted on, at most.
SAMPLE = 3000
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 20

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy",
    "parameters", "host_labels", "host_hyphens", "longest_label", "suffix_score", "path_hyphens",
    "switches",
)

#: Words of hosts and paths of the generated sample, the same for both classes.
WORDS = (
    "amber anchor apple arrow atlas bakery basket bridge bright candle canvas castle cedar circle clover coffee copper corner cotton "
    "crystal dragon eagle ember engine falcon feather field forest fountain galaxy gentle ginger glacier golden granite harbor hazel "
    "helmet honey horizon island ivory jasmine jungle kettle kitchen lantern laurel lemon lunar maple marble meadow mirror monarch "
    "mountain needle night oak ocean olive orange orchid otter paper pearl pebble pepper pilot planet pocket prairie purple quartz "
    "rabbit rocket saddle saffron sailor shadow silver smart spring summit sunset tiger timber travel tulip valley velvet violet "
    "walnut water willow window winter yellow zebra account article center city club company digital family gallery group guide "
    "history home international institute journal learning local magazine market media museum national network office online people "
    "project public research review school service society software sport store studio system theatre today university video world"
).split()
SUFFIXES = "com com com net org info io co.uk de fr es it eu biz online site edu us".split()
ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"


def labelled_urls(size: int = SAMPLE, seed: int = 9) -> tuple[list[str], np.ndarray]:
    """``size`` unwanted (1) and as many ordinary (0) URLs, made by a seeded generator.

    Words, suffixes, hyphens of hosts and kinds of paths are drawn alike for both classes; an unwanted
    URL has two or three of these signs besides: a random or numeric host, many labels, a long host,
    a random path, many parameters.
    """
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    among = lambda low, high: int(rng.integers(low, high + 1))
    noise = lambda low, high: "".join(pick(ALNUM) for _ in range(among(low, high)))
    urls, labels = [], []
    for k in range(2 * size):
        bad = k % 2
        signs = set(rng.permutation(["host", "labels", "long", "path", "query"])[: among(2, 3)]) if bad else set()
        hyphens = pick([0, 0, 0, 0, 0, 1, 1, 2])
        pieces = [pick(WORDS) for _ in range(max(hyphens + 1, among(4, 6) if "long" in signs else among(1, 2)))]
        if "host" in signs:
            pieces = [noise(8, 18) if rng.random() < 0.7 else f"{pick(WORDS)}{among(100, 10**6)}", *pieces[:hyphens]]
        joints = set(rng.permutation(len(pieces) - 1)[:hyphens].tolist())
        name = "".join(p + "-" * (j in joints) for j, p in enumerate(pieces)) + (str(among(1, 99)) if rng.random() < 0.1 else "")
        labels_ = [pick(WORDS + ["login", "secure", "cdn", "srv1"]) for _ in range(among(2, 5))] if "labels" in signs else []
        front = pick([[], [], ["www"], ["www"], ["m"], ["en"], [pick(WORDS)]])
        host = ".".join([*front, *labels_, name, pick(SUFFIXES)])
        if "host" in signs and not hyphens and rng.random() < 0.2:
            host = ".".join(str(among(1, 254)) for _ in range(4))
        slug = lambda low, high: pick("-_-").join(pick(WORDS) for _ in range(among(low, high)))
        path = pick([
            "", "/", f"/{pick(WORDS)}", f"/{pick(WORDS)}/{slug(1, 3)}", f"/{pick(WORDS)}/{slug(3, 8)}", f"/{pick(WORDS)}/{among(1, 10**7)}",
            f"/{among(1998, 2026)}/{among(1, 12):02}/{among(1, 28):02}/{slug(3, 8)}", f"/{pick(WORDS)}/{pick(WORDS)}/{slug(1, 4)}-{among(1, 10**6)}",
        ])
        if "path" in signs:
            path = path.rstrip("/") + "".join(f"/{noise(10, 32)}" for _ in range(among(1, 3)))
        path += pick(["", "", "", ".htm", ".php", ".aspx"]) if path.strip("/") else ""
        tail = pick(["", "", "", "", f"?id={among(1, 10**6)}", f"?q={pick(WORDS)}", f"?lang=en&p={among(1, 40)}", f"?v={noise(8, 11)}", f"#{pick(WORDS)}"])
        if "query" in signs:
            values = lambda: pick([str(among(0, 10**8)), noise(6, 30), pick(WORDS)])
            tail = "?" + "&".join(f"{pick([noise(1, 4), pick(WORDS)])}={values()}" for _ in range(among(3, 9)))
        urls.append(f"{pick(['http', 'https'])}://{host}{path or '/' * bool(tail)}{tail}")
        labels.append(bad)
    return urls, np.array(labels)


_SWITCH = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_PARTS = re.compile(r"\A.*?://([^/?#]*)([^?#]*)([^#]*)", re.S)


def parts(url: str | None) -> tuple[str, str, str]:
    """(host, path, query) of a URL; all empty for null or without ``://``."""
    m = _PARTS.match(url or "")
    if not m:
        return "", "", ""
    lower = m[1].translate({c: c + 32 for c in range(65, 91)})
    return lower, m[2], m[3]


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffix(host: str) -> str:
    return host.rsplit(".", 1)[-1]


def suffix_scores(urls: list[str], labels: np.ndarray) -> dict[str, float]:
    """Smoothed log odds of being unwanted, for each last label of a host in the sample."""
    bad, good = Counter(), Counter()
    for u, y in zip(urls, labels):
        (bad if y else good)[suffix(parts(u)[0])] += 1
    return {s: math.log((bad[s] + 1) / (good[s] + 1)) for s in bad | good}


def features(url: str | None, scores: dict[str, float]) -> list[float]:
    host, path, query = parts(url)
    url = url or ""
    digits = lambda s: sum(map(str.isdigit, s)) / len(s) if s else 0.0
    labels = host.split(".") if host else []
    return [
        len(url), len(host), len(path), sum(map(bool, path.split("/"))), digits(url), digits(host), entropy(url), entropy(host),
        query.count("=") + query.count("&"), len(labels), host.count("-"), max(map(len, labels), default=0), scores.get(suffix(host), 0.0),
        path.count("-"), len(_SWITCH.findall(url)),
    ]


class Trees:
    """Boosted regression trees for the logistic loss; splits are at quantiles of the sample."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, leaf: int = LEAF) -> None:
        self.n, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.trees: list[dict] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            tree, values = self._grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            margin[values[0]] += values[1]
            self.trees.append(tree)
        return self

    def _grow(self, binned, edges, g, h, rows, depth):
        value = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        if depth:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                n, sg, sh = (np.bincount(b, weights=w, minlength=len(e) + 1)[:-1].cumsum() for w in (np.ones(len(rows)), g[rows], h[rows]))
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(n < self.leaf) | (len(rows) - n < self.leaf)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            return {"value": float(value)}, (rows, np.full(len(rows), value))
        left = binned[rows, f] <= k
        low, vl = self._grow(binned, edges, g, h, rows[left], depth - 1)
        high, vh = self._grow(binned, edges, g, h, rows[~left], depth - 1)
        return {"f": f, "cut": float(edges[f][k]), "low": low, "high": high}, tuple(np.concatenate(v) for v in zip(vl, vh))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being unwanted."""

        def walk(tree: dict, rows: np.ndarray, out: np.ndarray) -> None:
            if "value" in tree:
                out[rows] += tree["value"]
            elif len(rows):
                left = x[rows, tree["f"]] <= tree["cut"]
                walk(tree["low"], rows[left], out)
                walk(tree["high"], rows[~left], out)

        out = np.full(len(x), self.start)
        for tree in self.trees:
            walk(tree, np.arange(len(x)), out)
        return out


class Filter:
    """Trained trees and the suffix table they need."""

    def __init__(self, urls: list[str], labels: np.ndarray) -> None:
        self.scores = suffix_scores(urls, labels)
        self.trees = Trees().fit(self.matrix(urls), np.asarray(labels, float))

    def matrix(self, urls) -> np.ndarray:
        return np.array([features(u, self.scores) for u in urls], float).reshape(-1, len(FEATURES))

    def unwanted(self, urls) -> np.ndarray:
        """Probability of each URL."""
        return 1 / (1 + np.exp(-self.trees.margin(self.matrix(urls))))


def url_filter(pages: DataFrame, model: Filter | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, unwanted) for each row of ``pages`` (page_id, url).

    A null url, or one without ``://``, has an empty host and path, meets no rule and is judged by
    the trees as it stands; of rules that fit, the longest wins; repeated rows repeat; other
    columns are ignored; an empty table gives an empty table.
    """
    model = model or Filter(*labelled_urls())

    @F.pandas_udf("host string, path string, unwanted double")
    def judge(urls: pd.Series) -> pd.DataFrame:
        urls = [u if isinstance(u, str) else None for u in urls]
        split = [parts(u)[:2] for u in urls]
        return pd.DataFrame({"host": [h for h, _ in split], "path": [p for _, p in split], "unwanted": model.unwanted(urls)})

    judged = pages.select("page_id", judge("url").alias("_j")).select("page_id", "_j.*")
    fitting = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fitting.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    own = F.when(F.col("unwanted") > threshold, "block").otherwise("allow")
    ruled = judged.select("*", F.coalesce(*fitting).alias("_r"))
    return ruled.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "unwanted")
