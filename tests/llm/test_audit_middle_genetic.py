"""Filter audit, fill-in-middle and genetic packing against brute force, on
tables with nulls, empty and very long texts, ties, repeated rows and clashing
column names."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import filter_audit, fim, genetic_packing, tokens
from riskframe.llm.queries import op11_filter_audit, op12_fill_in_middle, op13_genetic_packing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, mask int, part string, output string, form string, n long, g long, length string, salt string"


def prose(seed, n, kinds=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(kinds)}é" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = "\n".join(prose(i, 40) for i in range(1500))
    texts = [None, "", "  \n\t ", "one two", "one two", long, prose(1, 300, 9), prose(2, 300, 10 ** 6), prose(2, 300, 10 ** 6) + " A# B$ C% " + "ABC" * 60,
             "x" * 70_000 + " " + "x" * 70_000 + " " + "x" * 69_999 + "y", "\n" * 5000, "a\nb\n\nc", "a\nb\n\nc\n", "text with <S> mark\nx", "<<P", "a <\nb<\nc<S\n<M",
             "\U0001F600\n日本語 words here\r\n" * 300, "|", "ABCDEFG", "|", prose(3, 199, 10 ** 6), prose(4, 200, 10 ** 6)]
    langs = ["en", None, "", "de"]
    out = [(i, t, langs[i % 4], 1, "p", "o", "f", 3, 4, "l", "s") for i, t in enumerate(texts)]
    out += [out[7], out[7], (None, prose(2, 300, 10 ** 6), "en", *[None] * 8), (None, None, None, *[None] * 8)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# -- filter audit ---------------------------------------------------------

def fails_of(t):
    t = t or ""
    w = WORD.findall(t)
    out = set()
    if len(w) < 200:
        out.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
        out.add("C")
    if re.search(r"[#$%&*|]", t):
        out.add("D")
    return out


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, lang in rows:
        f = fails_of(t)
        if i is not None and least[t or ""] < i:
            f.add("E")
        failed.append((lang or "", f, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)))
    out = {}
    for part in {f[0] for f in failed}:
        mine = [f[1:] for f in failed if f[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                alive = [x for x in mine if not x[0] & before]
                removed = [x for x in alive if letter in x[0]]
                shapley[letter] += len(removed)
                out[part, "".join(order), k + 1] = [
                    len(alive) - len(removed), len(removed), sum(letter in x[0] and bool(x[0] & before) for x in mine), sum(x[0] == {letter} for x in mine),
                    sum(x[1] for x in removed), sum(x[2] for x in removed)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_against_brute_force(spark, docs, rows):
    labels = [(3, 1, 1), (4, 1, 0), (5, 1, None), (7, 0, 1), (7, 1, 0), (9, None, None), (17, 0, 1), (None, 1, 1), (999, 1, 1)]
    lab = spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in filter_audit.interactions(docs, lab).collect()}
    want = brute_audit([r[:3] for r in rows], labels)
    assert got == want and len(got) == 3 * 600
    assert any(v[6] for v in got.values()) and any(v[4] for v in got.values()) and any(v[5] for v in got.values())


def test_audit_query_on_given_rows(spark):
    src = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in op11_filter_audit(spark, SF).collect()}
    assert got == brute_audit(src, labels)


def test_scan_counts(docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.n_distinct, r.n_capitals, r.n_points, r.n_symbols) for r in filter_audit.scan(docs).collect())
    assert got == collections.Counter((r[0], len(WORD.findall(r[1] or "")), len(set(WORD.findall(r[1] or ""))), len(re.findall("[A-Z]", r[1] or "")),
                                       len(r[1] or ""), len(re.findall(r"[#$%&*|]", r[1] or ""))) for r in rows)


def test_span_table_tells_colliding_words_apart(monkeypatch):
    # every hash equal: only the comparison of bytes separates the words
    monkeypatch.setattr(filter_audit, "mix", lambda x: np.zeros(len(x), np.uint64))
    r = random.Random(5)
    for _ in range(60):
        texts = [" ".join("".join(r.choice("ab") for _ in range(r.choice([1, 7, 8, 9, 17, 33]))) for _ in range(r.randrange(30))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        got = filter_audit.measure(np.frombuffer(b"".join(raw), np.uint8), off)
        assert got["n_distinct"].tolist() == [len(set(t.split())) for t in texts]


def test_transducer_needs_the_last_byte_only():
    assert (filter_audit.STEP[:256] == filter_audit.STEP[256:]).all()


# -- fill in middle -------------------------------------------------------

def brute_middle(i, t, rate=100):
    t = t or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, t
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h4 % 100 < 50
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [100, 40])
def test_middle_against_brute_force(docs, rows, rate):
    got = fim.transform(docs, rate=rate).withColumn("back", fim.restored()).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == order((r[0], *brute_middle(r[0], r[1], rate)) for r in rows)
    assert order((r.doc_id, r.back) for r in got) == order((r[0], r[1] or "") for r in rows)
    assert {"spm", "psm", "plain"} == {r.form for r in got}


def test_middle_query_and_text_ids(spark, docs):
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_fill_in_middle(spark, SF).collect()
    assert len(got) == len(src)
    for r in got:
        n, form, p, m, out = brute_middle(r.doc_id, src[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((src[r.doc_id] or "").encode()).hexdigest()
    named = spark.createDataFrame([("a-1", "x\ny\nz\n")], "name string, body string")
    r = fim.transform(named, "name", "body").first()
    assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == ("a-1", *brute_middle("a-1", "x\ny\nz\n"))


def test_boundary_set_selects_every_member():
    r = np.random.default_rng(3)
    kinds = set()
    for size, top in ((0, 10), (1, 1), (50, 300_000), (9_000, 65_536), (40_000, 65_536 * 3), (65_536, 65_536)):
        v = np.sort(r.choice(top, size, replace=False)).astype(np.int64)
        v = np.union1d(v, np.arange(200_000, 260_000)) if size == 50 else v
        s = fim.BoundarySet(v)
        kinds |= {type(p).__name__ for p in s.parts}
        assert len(s) == len(v) and (s.select(np.arange(len(v))) == v).all()
        back = np.arange(len(v))[::-7]
        assert (s.select(back) == v[back]).all()
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}


# -- genetic packing ------------------------------------------------------

@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(src, got, ids_of, size=1024):
    """Every id once, pieces cut as agreed, sequences gapless; the number of
    sequences."""
    want = collections.Counter()
    for i, t in src:
        ids = ids_of(t)
        head = len(ids) % size or size
        bounds = [0] if len(ids) <= size else [0, *range(head, len(ids), size)]
        for k, s in enumerate(bounds):
            part = ids[s:(bounds + [len(ids)])[k + 1]]
            want[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(seqs)


@pytest.mark.parametrize("shard", [4096, 6])
def test_genetic_packing_keeps_every_id_once(docs, rows, reference_ids, shard):
    got = genetic_packing.pack(docs, shard_pieces=shard, epochs=2, births=6).collect()
    check_packing([r[:2] for r in rows], got, reference_ids)
    assert docs.limit(0).count() == 0


def test_genetic_query_on_given_rows(spark, reference_ids):
    src = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_genetic_packing(spark, SF).collect()
    bins = check_packing(src, got, reference_ids)
    lengths = np.array([r.length for r in got])
    assert bins <= genetic_packing.least_bins(lengths, 1024) + 1


def test_ids_equal_the_library(reference_ids):
    import public_tokenizers
    enc = genetic_packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.fast is not None
    odd = ["", "<|endoftext|> a<|endoftext|>", " " * 5000, "\n \t\r\n", "don't WE'LL 's", "日本語é\x00\x7f\U0001F600", "x" * 30_000]
    for t, x in zip(odd, enc.ids(odd), strict=True):
        assert [*x.tolist(), 2] == reference_ids(t)
    other = genetic_packing.ByteEncoder(tokens.tokenizer_path())
    assert other.fast is None and other.ids(["some words"])[0].tolist() == other.tok.encode("some words", add_special_tokens=False).ids


def valid(genes, lengths, capacity):
    f = genetic_packing.fills(genes, lengths)
    return f.max() <= capacity and f.min() > 0 and len(genes) == len(lengths)


def test_crossover_brings_whole_bins_and_mutation_refits():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.sort(rng.integers(1, 100, rng.integers(1, 80)))[::-1]
        a, b = genetic_packing.founders(lengths, 100, 2, rng, True)
        child = genetic_packing.crossover(a, b, lengths, 100, rng)
        assert valid(child, lengths, 100) and valid(genetic_packing.mutation(a, lengths, 100, rng), lengths, 100)
        groups = lambda g: {tuple(np.flatnonzero(g == k)) for k in np.unique(g)}
        assert groups(child) & groups(b)
        assert genetic_packing.least_bins(lengths, 100) <= len(np.unique(child))


def test_lower_bound_against_all_packings():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 7))
        best = min(n for part in itertools.product(range(len(lengths)), repeat=len(lengths))
                   if max(f := np.bincount(part, weights=lengths)) <= 20 for n in [len(f[f > 0])])
        assert genetic_packing.least_bins(lengths, 20) <= best


def test_evolution_improves_on_best_fit():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(200, 600, 900))[::-1]
    people = genetic_packing.founders(lengths, 1024, 4, rng, True)
    start = max(genetic_packing.worth(p, lengths) for p in people)
    best = genetic_packing.evolve(lengths, people, 1024, 300, genetic_packing.least_bins(lengths, 1024), rng)[0]
    assert valid(best, lengths, 1024) and genetic_packing.worth(best, lengths) > start


def test_one_shard_holds_equal_rows_apart(spark):
    # a third of all rows are one text: its pieces are dealt to all shards
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same words")).otherwise(F.concat(F.lit("w "), "id")).alias("text")).repartition(4)
    p = genetic_packing.pieces(df).where("length < 1024").withColumn("g", F.expr("pmod(xxhash64(salt, 0), 10)"))
    sizes = [r["count"] for r in p.groupBy("g").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 450


def test_empty_tables_of_the_new_operators(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(none, labels).collect() == []
    assert fim.transform(none).collect() == []
    assert genetic_packing.pack(none).collect() == []
    assert filter_audit.interactions(docs, labels).count() == 3 * 600
