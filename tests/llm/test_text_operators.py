"""Fill-in-middle, spelling variants and secret scans against plain versions, with nulls, empty and very long texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlens.llm import middle_fill, queries, secret_scan, spelling_variants

SCHEMA = "doc_id long, text string, hash string, Word string"


def as_docs(spark, texts):
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "a\nb\n", "", "")], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_middle_fill", "op12_spelling_variants", "op13_secret_scan"])
def test_query_equals_its_sql(spark, name):
    assert not compare.differences(spark, queries.QUERIES[name], queries.ORACLE[name], "/root/testdata/sf0.01")


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for size, share in ((1, 1), (63, 0.5), (64, 0.5), (512, 1), (513, 0), (5000, 0.01), (4096, 0.9)):
        bits = rng.random(size) < share
        v = middle_fill.BitVector(bits)
        assert v.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        assert v.select(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()


UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", UNITS)
def test_fill_middle(spark, unit):
    rng = random.Random(4)
    texts = [None, "", "\n", "one line", "é\n\n€ x\n", "has <P> in it\n", "<S", "\r\n a \n" * 3, "line of words\n" * 40_000, "ends <\n<S\n<M\n"]
    texts += ["".join(rng.choice("aé€😀 \n\t<SPM") for _ in range(rng.randint(1, 90))) for _ in range(150)]
    docs = as_docs(spark, texts)
    filled = middle_fill.fill_middle(docs, rate=80, unit=unit)
    got = collections.Counter(map(tuple, filled.select("doc_id", *[f"fim_{c}" for c in ("units", "form", "prefix_chars", "middle_chars", "output")]).collect()))
    want = collections.Counter()
    for row in docs.collect():
        text, digest = row.text or "", hashlib.sha256(f"7:{'' if row.doc_id is None else row.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        u = re.findall(UNITS[unit], text)
        a, b = sorted(x % (len(u) + 1) for x in h[:2])
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 80:
            want[row.doc_id, len(u), "plain", None, None, text] += 1
        else:
            spm = h[3] % 100 < 50
            want[row.doc_id, len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"] += 1
    assert got == want
    assert filled.where(F.coalesce("text", F.lit("")) != middle_fill.restored()).isEmpty()
    assert set(docs.columns) < set(filled.columns) and middle_fill.digest(filled.limit(0)).isEmpty()


def plain_variants(counts):
    near = {w: set() for w in counts}
    by_hole = collections.defaultdict(list)
    for w in counts:
        for i in range(len(w)):
            by_hole[w[:i], w[i + 1 :]].append(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for found in by_hole.values():
        for a in found:
            near[a] |= {b for b in found if b != a}
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best and counts[best] >= 10 * n else None, n, len(near[w])]
    for w in counts:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {(w, f, root, n, k, counts[f] if f else None) for w, (f, n, k, root) in out.items()}


def variant_words(rng):
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))): rng.choice([2, 3, 20, 30, 500, 7000]) for _ in range(2500)}
    return words | {"aaaaaaa": 5, "aaaaaaaa": 60, "aaaaaaaaa": 700, "z" * 60: 2, "z" * 61: 30}


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_variants_for_cells_of_all_sizes(spark, most):
    counts = variant_words(random.Random(5))
    words = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n long").repartition(4)
    got = spelling_variants.variants(words, most=most)
    assert {tuple(r) for r in got.collect()} == plain_variants(counts) and got.count() == len(counts)
    assert spelling_variants.variants(words.limit(0)).isEmpty()


def test_merge_skips_nothing():
    rng = random.Random(6)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 25))) for _ in range(rng.randint(0, 6))]
        for least in range(1, 5):
            seen = collections.Counter(x for p in lists for x in p)
            assert list(spelling_variants.merge(lists, least)) == sorted(x for x, k in seen.items() if k >= least)


def test_word_counts(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abÀÿZq") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    texts = [None, "", "Straßenbahn—Straßenbahn", "x" * 50_000, *[" ,1\n".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(60)]]
    docs = as_docs(spark, texts)
    want = collections.Counter()
    for r in docs.collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += len(w) >= 7
    got = {r.word: r.n for r in spelling_variants.word_counts(docs, drop_every=31).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}


def plain_entropy_spans(run, kind, window=secret_scan.WINDOW):
    out = []
    for i in range(len(run) - window + 1):
        w = run[i : i + window]
        bits = -sum(c / window * math.log2(c / window) for c in collections.Counter(w).values())
        if bits >= kind.bits - 1e-7 and all(re.search(n, w) for n in kind.needs):
            if out and out[-1][1] >= i:
                out[-1][1] = i + window
            else:
                out.append([i, i + window])
    return out


def plain_scan(text):
    base, more = [], []
    for rank, p in enumerate(secret_scan.PATTERNS):
        base += [(m.start(), rank, p.kind, m.end()) for m in re.finditer(p.regex, text) if len(m.group(p.group)) >= p.least]
    for rank, c in enumerate(secret_scan.CLASSES, len(secret_scan.PATTERNS)):
        for m in re.finditer(f"[{c.chars}]{{{secret_scan.WINDOW},}}", text):
            before = text[max(0, m.start() - 40) : m.start()]
            if not any(re.search(a, m.group()) for a in secret_scan.ALLOW_RUN) and not any(re.search(a, before) for a in secret_scan.ALLOW_BEFORE):
                more += [(m.start() + s, rank, c.kind, m.start() + e) for s, e in plain_entropy_spans(m.group(), c)]
    more = [x for x in more if not any(b[0] <= x[0] and x[3] <= b[3] for b in base)]
    return sorted(base), sorted(base + more)


def test_secret_scan(spark):
    rng = random.Random(8)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    base64, upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF", "0123456789abcdef"
    pieces = [lambda: key(base64, rng.randint(10, 60)), lambda: key(upper, rng.randint(20, 50)), lambda: key(low, rng.randint(20, 50)), lambda: "token='" + key(base64, rng.randint(3, 20)) + "'", lambda: "AKIA" + key("ABC123", rng.randint(5, 30)), lambda: "Passwd : ", lambda: "api_key=", lambda: "sha256: ", lambda: "https://x.org/", lambda: "wörter ", lambda: "€ ", lambda: "a" * 30 + key(base64, 40) + "a" * 60 + key(base64, 30), lambda: "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdef", lambda: "example"]
    texts = [None, "", "secret=token: abcdefgh", "secret=short secret=longer1", "x" * 300_000, key(base64, 3000), "token = " * 3000, *["".join(rng.choice(pieces)() + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(250)]]
    docs = as_docs(spark, texts)
    scanned = secret_scan.scan(docs)
    got = collections.Counter((r.doc_id, tuple(map(tuple, r.secret_base)), tuple(map(tuple, r.secret_spans))) for r in scanned.collect())
    assert got == collections.Counter((r.doc_id, *map(tuple, plain_scan(r.text or ""))) for r in docs.collect())
    assert sum(len(s) > len(b) for _, b, s in got) > 50 and set(docs.columns) < set(scanned.columns)
    assert secret_scan.digest(scanned.limit(0)).isEmpty()


def test_window_weights_are_the_entropy():
    # eight of three characters each: log2(8) bits exactly, which is enough for a bound of 3
    kind = secret_scan.CharClass("k", "a-h", 3.0, ())
    assert plain_entropy_spans("abcdefgh" * 3, kind) == [[0, 24]]
    assert 8 * secret_scan.weights()[3] <= secret_scan.most(3.0) < 7 * secret_scan.weights()[3] + secret_scan.weights()[2] + secret_scan.weights()[4]
