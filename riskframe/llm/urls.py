"""URL filter: host and path rules, and for the rest a logistic regression
on hashed character n-grams of host and path.

The model is fitted from a labelled URL table (at most ``MAX_LABELLED`` rows
are taken, a documented bound); pages are scored in Arrow tasks, each with the
weight vector of fixed size ``2**BITS``.  :func:`labelled_table` is the table
used where no other is given.  It is made by a rule, not collected: hosts of
several kinds (topic names, brands of invented syllables, compounds, subdomains,
institutions) with paths of several kinds, blocked ones around words of
gambling, pills, loans, adult, downloads and tracking.  Verdicts of the model
are as good as that table; the tests hold it against urls written by hand that
the rule cannot make.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and gets the model's verdict on the empty string;
repeated rows are judged alike; urls are judged whole; an empty table gives
an empty result; other columns are ignored.
"""
from __future__ import annotations

import random
import re
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import U, mix

BITS = 16
SIZES = (3, 4, 5)
MAX_LABELLED = 20_000
ROWS_AT_ONCE = 2_000

# fixed values: (verdict, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# the words of the labelled table
CLEAN_TOPICS = ("library museum university garden recipe weather history science music theatre ocean mountain chess train school church hospital "
                "farmer bakery bicycle camera journal gazette herald tribune research physics biology chemistry algebra poetry novel painting "
                "council parliament ministry archive forum review travel hiking football tennis software compiler database kernel protocol "
                "energy climate harbour village coffee kitchen furniture architecture orchestra wiki news docs help blog shop store").split()
BLOCK_TOPICS = ("casino poker slots jackpot roulette bets betting gambling lottery viagra cialis pills meds steroids weightloss diet payday loans "
                "credit-repair forex-profit getrich porn xxx adult escort webcam nude hookup torrent warez crack keygen serial cheats spam link-farm "
                "clickbait adserver popads tracker doorway replica cheap-watches free-spins free-money win-prize").split()
SUFFIXES = "com org net edu gov info io de fr es it nl co.uk com.br ac.jp".split()
BLOCK_SUFFIXES = "com net info biz xyz top click ru org".split()
SUBDOMAINS = ["", "", "", "www.", "www.", "m.", "blog.", "en.", "shop."]
TABLE_ROWS = 6_000
BLOCK_SHARE = 0.3


def labelled_table(spark: SparkSession, rows: int = TABLE_ROWS, seed: int = 11) -> DataFrame:
    """``url, label`` (1: block) made by the rule that the module describes;
    the same rows for the same seed."""
    r = random.Random(seed)
    syllables = [c + v for c in "bdfgklmnprsvz" for v in "aeiou"]
    brand = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4))) + r.choice(["", "", "n", "x", "s"])
    page = lambda words: r.choice([
        "/", "", f"/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randrange(100)}", f"/{r.choice(words)}/{r.randrange(10_000)}", f"/{r.choice(words)}-{r.choice(words)}.html",
        f"/20{r.randrange(10, 25)}/{r.randrange(1, 13):02d}/{r.choice(words)}", f"/index.php?id={r.randrange(500)}", f"/{r.choice(words)}/{brand()}", f"/{brand()}/"])
    made = []
    for i in range(rows):
        if r.random() < BLOCK_SHARE:
            w = BLOCK_TOPICS
            host = r.choice([r.choice(w), f"{r.choice(w)}-{r.choice(w)}", f"{r.choice(w)}{r.randrange(1000)}", f"{r.choice(['best', 'free', 'online', 'cheap', 'buy', 'hot'])}-{r.choice(w)}",
                             f"{r.choice(w)}{r.choice(w)}", f"{r.choice(w)}.{brand()}", f"{brand()}-{r.choice(w)}"])
            made.append((f"http{r.choice(['', 's'])}://{r.choice(SUBDOMAINS)}{host}.{r.choice(BLOCK_SUFFIXES)}{page(w + CLEAN_TOPICS[:10])}", 1))
        else:
            w = CLEAN_TOPICS
            host = r.choice([brand(), brand(), brand(), r.choice(w), f"{brand()}-{r.choice(w)}", f"{r.choice(w)}-{r.choice(w)}", f"{r.choice(w)}{brand()}", f"{r.choice(w)}.{brand()}", f"{brand()}{r.randrange(100)}"])
            made.append((f"http{r.choice(['', 's'])}://{r.choice(SUBDOMAINS)}{host}.{r.choice(SUFFIXES)}{page(w)}", 0))
        if i % 500 == 0:
            made.append(("", 0))
    return spark.createDataFrame(made, "url string, label int")


def host_path(url: str = "url") -> tuple:
    """(host, path) expressions; both empty where there is no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def rule_columns(rules=RULES, host: str = "host", path: str = "path") -> tuple:
    """(rule, verdict) expressions: of the rules that fit, the longest; null
    where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(hosts: list[str], paths: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram id) of the different hashed n-grams of each row; host and
    path grams are told apart, and their ends are marked."""
    mask, found = U((1 << bits) - 1), [np.zeros(0, U)]
    for tag, texts in ((U(1), hosts), (U(2), paths)):
        raw = [f"^{t}$".encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(U)
        off = np.cumsum([0, *map(len, raw)])
        row = np.repeat(np.arange(len(raw)), np.diff(off))
        for n in SIZES:
            m = len(data) - n + 1
            if m <= 0:
                continue
            g = np.full(m, tag * U(16) + U(n), U)
            for j in range(n):
                g = (g << U(8)) | data[j:j + m]
            inside = row[:m] == row[n - 1:]
            found.append((row[:m][inside].astype(U) << U(bits)) | (mix(g[inside]) & mask))
    both = np.unique(np.concatenate(found))
    return (both >> U(bits)).astype(np.int64), (both & mask).astype(np.int64)


def linear_scores(weights: np.ndarray, hosts: list[str], paths: list[str], bits: int = BITS) -> np.ndarray:
    row, col = features(hosts, paths, bits)
    n = np.bincount(row, minlength=len(hosts))
    return np.bincount(row, weights=weights[col], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1)) + weights[-1]


def split_url(url: str | None) -> tuple[str, str]:
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(ascii_uppercase, ascii_lowercase)), m[2]) if m else ("", "")


def train(labelled: list[tuple[int, str]], bits: int = BITS, l2: float = 3e-5, steps: int = 300, rate: float = 8.0) -> np.ndarray:
    """Weights (the last one is the intercept) by full-batch gradient descent
    from zero: the same table always gives the same weights."""
    labelled = labelled[:MAX_LABELLED]
    parts = [split_url(u) for _, u in labelled]
    row, col = features([h for h, _ in parts], [p for _, p in parts], bits)
    y = np.array([v for v, _ in labelled], float)
    val = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1)))[row]
    w = np.zeros((1 << bits) + 1)
    for _ in range(steps):
        z = np.bincount(row, weights=val * w[col], minlength=len(y)) + w[-1]
        e = (1 / (1 + np.exp(-z)) - y) / max(len(y), 1)
        w[:-1] -= rate * (np.bincount(col, weights=val * e[row], minlength=1 << bits) + l2 * w[:-1])
        w[-1] -= rate * e.sum()
    return w


def labelled_rows(df: DataFrame, url: str = "url", label: str = "label", most: int = MAX_LABELLED) -> list[tuple[int, str]]:
    """Reads a labelled URL table for :func:`train`; ``most`` rows at most
    (the documented bound), chosen by a hash of the url."""
    return [(int(r[0]), r[1]) for r in df.where(F.col(label).isNotNull()).select(label, url)
            .orderBy(F.xxhash64(url), url).limit(most).collect()]


def block_probability(weights: np.ndarray, host: str = "host", path: str = "path", bits: int = BITS):
    w = weights.astype(np.float64)

    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, p in batches:
            texts = [[t or "" for t in c.to_pylist()] for c in (h, p)]
            z = [linear_scores(w, texts[0][i:i + ROWS_AT_ONCE], texts[1][i:i + ROWS_AT_ONCE], bits) for i in range(0, len(texts[0]), ROWS_AT_ONCE)]
            yield pa.array(1 / (1 + np.exp(-np.concatenate([np.zeros(0), *z]))), pa.float64())
    return scored(F.col(host), F.col(path))


def judge(pages: DataFrame, weights: np.ndarray, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and the model's block probability."""
    host, path = host_path(url_col)
    d = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = rule_columns(rules)
    d = d.select("*", rule.alias("rule"), ruled.alias("ruled"), block_probability(weights).alias("p_block"))
    model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return d.select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "p_block")
