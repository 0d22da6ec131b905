"""Main text of web pages: markup decides what it names, and a host's suffix
array decides the rest.

A page is read as a stream of blocks.  Elements that are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments by
name, role or class are chrome.  What an ``article`` (else ``main``) element
holds besides them is the candidate for the main text.  The words of all other
blocks, page by page of one host, are concatenated; the suffix array of that
stream shows the strings of at least ``RUN`` words that occur on several pages,
and words they cover are template text.  A page without an article keeps the
unique runs of its open blocks (all of them, if it has none: it is a copy of a
page then, not a template).

Articles are held against the same strings, those that more than half of the
host's pages have outside them: whole blocks in a row that such strings cover
are an unmarked notice, and go, if they stand between different neighbours in
articles of the host.  A passage that articles share is part of them, also if
an advert or a menu here and there has it too, and one that always has the same
neighbours (a headline that menus repeat, in an article and its copies) stays.

Pages of one host go to groups of at most about ``GROUP`` pages.  A host of
several groups passes one row for each different string of a group on, and
strings are counted over the host's groups, so the answer does not depend on
the grouping.

Defined results: null or empty html gives an empty text; repeated rows are
one page to the repeat search and each get the text; a null url has the
empty host; html of any length is read whole; an empty table gives an empty
result; page ids are cast to long; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import BLOOM_BITS, U, Rolling, bloom, grams, saved, word_spans
from riskframe.llm.jaccard import whole_groups
from riskframe.llm.suffix_array import common_prefixes, suffix_array
from riskframe.llm.urls import host_path

RUN = 8
GROUP = 256

# fixed values: elements that never hold main text
SKIPPED = frozenset("nav header footer aside form script style noscript template head title button select option "
                    "textarea iframe svg canvas object dialog menu".split())
RAW = frozenset("script style noscript template title textarea iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
# fixed values: words of classes, ids and roles that mark chrome
CHROME = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr "
                   "notice notices notification alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar "
                   "navigation breadcrumb breadcrumbs header footer masthead comment comments reply replies disqus share sharing "
                   "social related recommended widget toolbar pagination pager login signup search copyright legal contentinfo "
                   "complementary dialog".split())
BEFORE = frozenset("has with no is without".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

MAIN, OPEN, OUT = 0, 1, 2


def marks_chrome(attrs: str) -> bool:
    """Class, id or role names that start or end with a chrome word."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for m in NAMED.finditer(attrs):
        for name in html.unescape(m[2] or m[3] or m[4] or "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
            if words and words[0] not in BEFORE and (words[0] in CHROME or words[-1] in CHROME):
                return True
    return HIDDEN.search(attrs) is not None


def blocks(page: str) -> list[tuple[int, str, bool]]:
    """(kind, text, inside main) of the blocks in page order.  Kind: MAIN
    inside an article, OPEN outside, OUT chrome; the flag tells ``main``."""
    out: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, bool]] = []
    skip = article = main = 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((OUT if skip else MAIN if article else OPEN, text, main > 0))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if any(t == name for t, _ in stack):
                if name not in INLINE:
                    flush()
                while stack:
                    t, s = stack[-1]
                    if s or t in ("article", "main"):
                        flush()
                    stack.pop()
                    skip -= s
                    article -= t == "article"
                    main -= t == "main"
                    if t == name:
                        break
            elif name not in INLINE:
                flush()
            continue
        attrs = m[3] if m[2] else m[6]
        if name in RAW and not (attrs or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.start())
            at = n if close < 0 else close + 1
            continue
        if name not in INLINE:
            flush()
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
        if name in VOID:
            continue
        s = name in SKIPPED or (name not in ("html", "body", "main") and marks_chrome(attrs or ""))
        if s:
            flush()
        stack.append((name, s))
        skip += s
        article += name == "article"
        main += name == "main"
    flush()
    return out


def read_page(page: str | None) -> tuple[str | None, list[str], list[int], list[str], list[int]]:
    """(main text or None, open words, their places in the stream, the stream
    of words outside the main text, words of the main text up to each block's
    end)."""
    bs = blocks(page or "")
    kind = MAIN if any(k == MAIN for k, _, _ in bs) else None
    if kind is None and any(k == OPEN and m for k, _, m in bs):
        bs = [(MAIN if k == OPEN and m else k, t, m) for k, t, m in bs]
        kind = MAIN
    stream: list[str] = []
    words: list[str] = []
    places: list[int] = []
    for k, t, _ in bs:
        if k == MAIN:
            continue
        w = t.split()
        if k == OPEN and kind is None:
            words.extend(w)
            places.extend(range(len(stream), len(stream) + len(w)))
        stream.extend(w)
    text = " ".join(t for k, t, _ in bs if k == MAIN) if kind == MAIN else None
    ends = np.cumsum([len(t.split()) for k, t, _ in bs if k == MAIN]).tolist() if kind == MAIN else []
    return text, words, places, stream, ends


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return Rolling(data).spans(starts, ends)


def page_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            got = [read_page(x.as_py()) for x in part.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array([None if g[0] is None else zstandard.compress(g[0].encode(), 3) for g in got], pa.binary()),
                 pa.array([g[1] if g[0] is None else [] for g in got], pa.list_(pa.string())),
                 pa.array([g[2] if g[0] is None else [] for g in got], pa.list_(pa.int32()))],
                ["page_id", "url", "k_row", "main", "words", "places"])


def page_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array([read_page(x.as_py())[3] for x in part.column(2)], pa.list_(pa.string()))],
                ["k_row", "host", "stream"])


HITS = "k_row long, host string, s1 long, place int, before long, after long, opens boolean, closes boolean"


def article_hits(run: int, bits):
    """The strings of a page's main text that may be template strings, with
    the words before and after (0: none), and whether they open and close
    blocks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, cols = [], []
                for r, x in enumerate(part.column(2)):
                    text, _, _, _, ends = read_page(x.as_py())
                    if text is None or ends[-1] < run:
                        continue
                    w = word_hashes(text)
                    h = grams(w, run)
                    at = np.arange(len(h))
                    for b in (h >> U(64 - BLOOM_BITS), (h >> U(8)) & U((1 << BLOOM_BITS) - 1)):
                        at = at[(held[b[at] >> U(3)] >> (b[at] & U(7)).astype(np.uint8)) & 1 == 1]
                    if not len(at):
                        continue
                    w = np.concatenate([[U(0)], w, [U(0)]])
                    edge = np.zeros(ends[-1] + 1, bool)
                    edge[[0, *ends]] = True
                    rows.append(np.full(len(at), r))
                    cols.append((h[at].view(np.int64), at.astype(np.int32), w[at].view(np.int64), w[at + run + 1].view(np.int64), edge[at], edge[at + run]))
                if not rows:
                    continue
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(of) for c in part.columns[:2]), *(pa.array(np.concatenate(c)) for c in zip(*cols, strict=True))],
                    ["k_row", "host", "s1", "place", "before", "after", "opens", "closes"])
    return work


def shared_strings(pages: list[list[str]], run: int) -> list[list[list[int]]]:
    """Classes of equal ``run``-word strings: for each class the (page,
    place) of its occurrences, in suffix order.  Classes of one page only
    are included."""
    code: dict[str, int] = {}
    s: list[int] = []
    where: list[tuple[int, int]] = []
    for p, words in enumerate(pages):
        s.extend(code.setdefault(w, len(code) + 2) for w in words)
        s.append(1)
        where.extend((p, i) for i in range(len(words) + 1))
    s.append(0)
    where.append((-1, 0))
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa, 1)
    out: list[list[list[int]]] = []
    for k, i in enumerate(sa):
        p, place = where[i]
        if p < 0 or place + run > len(pages[p]):
            continue
        if k and lcp[k] >= run and out:
            out[-1].append([p, place])
        else:
            out.append([[p, place]])
    return out


STRINGS = "k_row long, host string, place int, known boolean, s1 long, s2 long, pages int"


def group_strings(run: int):
    """Per group of a host: every string on several of its pages (known),
    and, for hosts of several groups, one row for each other string."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 2):
            host, many = t.column("host").to_pylist(), t.column("groups").to_pylist()
            key, stream = t.column("k_row").to_pylist(), t.column("stream").to_pylist()
            rows = []
            for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True):
                own = [grams(word_hashes(" ".join(x)), run).view(np.int64) for x in stream[lo:hi]]
                for cls in shared_strings(stream[lo:hi], run):
                    n_pages = len({p for p, _ in cls})
                    known = n_pages > 1
                    p, i = cls[0]
                    d = hashlib.blake2b(" ".join(stream[lo + p][i:i + run]).encode("utf-8", "surrogatepass"), digest_size=8).digest() if many[lo] > 1 else b"\0" * 8
                    s1, s2 = int(own[p][i]), int.from_bytes(d, "little", signed=True)
                    if known:
                        rows.extend((key[lo + q], host[lo], j, True, s1, s2, 0 if n else n_pages) for n, (q, j) in enumerate(cls))
                    elif many[lo] > 1:
                        rows.extend((key[lo + q], host[lo], j, False, s1, s2, 0 if n else 1) for n, (q, j) in enumerate(cls))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["k_row", "host", "place", "known", "s1", "s2", "pages"])
    return work


def notices(pages: DataFrame, strings: DataFrame, run: int) -> DataFrame:
    """(k_row, notes): the words [start, end) of a main text that are whole
    blocks covered by template ``strings`` (host, s1) of its host, between
    different neighbours in different places."""
    bits = pages.sparkSession.sparkContext.broadcast(bloom(strings, "s1"))
    hits = (pages.select("k_row", "host", "html").mapInArrow(article_hits(run, bits), HITS)
            .join(strings, ["host", "s1"]).dropDuplicates(["k_row", "place"]))
    # windows one word apart are one run
    hits = hits.withColumn("line", F.col("place") - F.row_number().over(Window.partitionBy("k_row").orderBy("place")))
    first = lambda c: F.min_by(c, "place").alias(c)
    last = lambda c: F.max_by(c, "place").alias(c)
    runs = saved(hits.groupBy("k_row", "host", "line").agg(
        F.min("place").alias("start"), (F.max("place") + run).alias("end"), first("s1"), F.max_by("s1", "place").alias("s_last"),
        first("before"), last("after"), first("opens"), last("closes")).where("opens and closes"))
    name = ["host", "s1", "s_last", (F.col("end") - F.col("start")).alias("n")]
    often = runs.select(*name, "before", "after").distinct().groupBy("host", "s1", "s_last", "n").agg(F.count(F.lit(1)).alias("places")).where("places > 1")
    return (runs.select("k_row", "start", "end", *name).join(often, ["host", "s1", "s_last", "n"])
            .groupBy("k_row").agg(F.collect_list(F.struct("start", "end")).alias("notes")))


def template_places(pages: DataFrame, run: int, group: int) -> DataFrame:
    """(k_row, starts, notes): where strings shared with other pages of the
    host begin in a page's stream, and the :func:`notices` in its main text.
    ``pages``: k_row, host, html."""
    st = saved(pages.select("k_row", "host", "html").mapInArrow(page_streams, "k_row long, host string, stream array<string>")
               .dropDuplicates(["k_row"]))
    sizes = saved(st.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups"), F.count(F.lit(1)).alias("all")))
    g = st.join(sizes.drop("all"), "host").withColumn("part", F.pmod(F.xxhash64("k_row"), F.col("groups")).cast("int"))
    found = (g.select("host", "part", "groups", "k_row", "stream").repartition("host", "part").sortWithinPartitions("host", "part", "k_row")
             .mapInArrow(group_strings(run), STRINGS))
    found = saved(found)
    counted = saved(found.where("pages > 0").groupBy("host", "s1", "s2").agg(F.sum("pages").alias("n")).where("n > 1"))
    several = counted.where("s2 != 0").select("host", "s1", "s2")
    across = found.where("not known").join(several, ["host", "s1", "s2"]).select("k_row", "place")
    starts = found.where("known").select("k_row", "place").union(across).groupBy("k_row").agg(F.collect_set("place").alias("starts"))
    strings = saved(counted.join(sizes, "host").where(2 * F.col("n") > F.col("all")).select("host", "s1").distinct())
    return starts.join(notices(pages, strings, run), "k_row", "full")


def final_text(main: str, words: str, places: str, covered: str, notes: str):
    """Column: the main text, which travels compressed, without its notices;
    else the words whose places are not covered.  All words if none is left."""
    @F.arrow_udf("string")
    def runs(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = []
            for m, w, p, c, gone in zip(*columns, strict=True):
                if m.is_valid:
                    text = zstandard.decompress(m.as_py()).decode()
                    if gone.is_valid:
                        own = text.split(" ")
                        for x in gone.as_py():
                            own[x["start"]:x["end"]] = [None] * (x["end"] - x["start"])
                        text = " ".join(x for x in own if x is not None) or text
                    out.append(text)
                    continue
                w, c = w.as_py(), set(c.as_py())
                kept = [x for x, i in zip(w, p.as_py(), strict=True) if i not in c]
                out.append(" ".join(kept or w))
            yield pa.array(out, pa.string())
    return runs(F.col(main), F.col(words), F.col(places), F.col(covered), F.col(notes))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            run: int = RUN, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars and ``n_template``, the words of the page
    outside its main text that template strings cover."""
    host, _ = host_path(url_col)
    key = F.xxhash64(F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col), F.lit("")))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), key.alias("k_row"),
                       host.alias("host"), F.col(html_col).cast("string").alias("html"))
    starts = template_places(src, run, group)
    parts = src.select("page_id", "url", "k_row", "html").mapInArrow(
        page_parts, "page_id long, url string, k_row long, main binary, words array<string>, places array<int>")
    d = parts.join(starts, "k_row", "left")
    covered = F.array_distinct(F.flatten(F.transform(F.coalesce("starts", F.array().cast("array<int>")), lambda x: F.sequence(x, x + (run - 1)))))
    d = d.withColumn("covered", covered)
    d = d.withColumn("text", final_text("main", "words", "places", "covered", "notes"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("covered").cast("long").alias("n_template"))
