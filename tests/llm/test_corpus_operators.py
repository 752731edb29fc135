"""The operators against brute force, exact round trips and held-out accuracy, with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import io
import math
import random
import re
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlens.llm import chat_format, compression_lid, edit_match, lsh_forest, nn_descent, recompression, site_template, source_schedule, suffix_tree, zip_archive
from crowdlens.llm.shared import components, hashed_fold

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def made(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    shared = [rng.choice(vocabulary) for _ in range(70)]
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = shared
        if i % 7 == 3:
            w = rows[i - 1][1].split()
            w[rng.randrange(len(w))] = "changed"
        if i % 11 == 5:
            w = rows[i - 2][1].split()
        rows.append((i, " ".join(w), "en", f"s{i % 5}", 0, "x"))
    rows += [(900, None, None, None, None, None), (901, "", "en", "s1", 0, ""), (902, "a " * 300, "en", "s1", 0, ""), (903, "b " + "a " * 200, "en", None, 0, ""), (904, "One  two", "en", "", 0, ""), (905, "one two", "en", "s1", 0, ""), rows[0]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 8), (7, 9), (3, 5)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 7)]


def test_repeats_equal_brute_force(docs, empty):
    got = {r.doc_id: tuple(r)[1:] for r in recompression.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    texts = {r[0]: WORDS.findall(r[1] or "") for r in made()}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][p : p + 50]), i)
    for i, w in texts.items():
        keep = [True] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                keep[p : p + 50] = [False] * 50
        assert got[i] == (len(w), keep.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest()), i
    assert recompression.remove_repeats(empty).count() == 0


def test_similar_equals_brute_force(docs, empty):
    got = {r.doc_id: (r.n_links, r.component_id) for r in lsh_forest.similar(docs).collect()}
    sets = {}
    for i, t, *_ in made():
        w = WORDS.findall((t or "").lower())
        if w:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    links = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    for i in sets:
        seen, queue = {i}, [i]
        while queue:
            new = [j for j in links[queue.pop()] if j not in seen]
            seen.update(new)
            queue += new
        assert got[i] == (len(links[i]), min(seen)), i
    assert got[900] == (0, 900) and got[901] == (0, 901) and lsh_forest.similar(empty).count() == 0


def test_prefix_shortens_until_the_recall_is_met():
    k = lsh_forest.prefix()
    assert 1 - (1 - 0.8**k) ** 40 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 40


def plain_suffix_tree(texts, held, depth=3):
    """The model counted word by word: base score and score of each text."""
    tokens = {i: [*WORDS.findall((t or "").lower()), 0] for i, t in texts.items()}
    train = [i for i in tokens if not held(i)]
    c = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    follow = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    after = lambda x, j, k: tuple(x[j - m] if j >= m else -1 for m in range(1, k + 1))
    for i in train:
        for j, w in enumerate(tokens[i]):
            for k in range(1, depth + 1):
                follow[k][after(tokens[i], j, k)][w] += 1
    kept = {}

    def p(context, w):
        if not context:
            return (c[w] + 1) / (n + v + 1)
        low, seen = p(context[:-1], w), follow[len(context)].get(context)
        if not seen or not keep(context):
            return low
        return (max(seen[w] - 0.75, 0) + 0.75 * len(seen) * low) / sum(seen.values())

    def keep(context):
        if context not in kept:
            seen, gain = follow[len(context)][context], 0.0
            size = sum(seen.values())
            for w, m in seen.items() if size > 1 else ():
                low = p(context[:-1], w)
                gain += m * math.log(max((max(m - 1.75, 0) + 0.75 * (len(seen) - (m == 1)) * low) / (size - 1), 1e-300) / low)
            kept[context] = size > 1 and gain >= 0.005 * size
        return kept[context]

    score = {i: sum(math.log10(p(after(x, j, depth), w)) for j, w in enumerate(x)) for i, x in tokens.items()}
    base = {i: sum(math.log10(p((), w)) for w in x) for i, x in tokens.items()}
    return tokens, c, base, score, sum(kept.values())


@pytest.mark.parametrize("hot, codes, share", [(10**9, 500_000, 10**6), (200, 20, 1500), (30, 0, 700)])
def test_suffix_tree_equals_brute_force(docs, empty, monkeypatch, hot, codes, share):
    """Whether contexts are hot, words have numbers and tokens are dealt to many tasks changes no score."""
    for name, value in (("HOT", hot), ("CODES", codes), ("SHARE", share), ("SAMPLE", 1)):
        monkeypatch.setattr(suffix_tree, name, value)
    texts = {i: t for i, t, *_ in made()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens, c, base, score, states = plain_suffix_tree(texts, held)
    twice = [i for i, *_ in made()]
    # a repeated row counts as a text of its own
    rows = suffix_tree.score_texts(docs.dropDuplicates(["doc_id"]), hashed_fold("doc_id", 7, 2)).collect()
    assert len(rows) == len(texts) == len(set(twice)) and states > 20
    for r in rows:
        x = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(x), sum(w in c for w in x), sum(c.values()))
        assert math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9) and math.isclose(r.score, score[r.doc_id], rel_tol=1e-5), r
    assert suffix_tree.score_texts(docs, hashed_fold("doc_id", 7, 2)).count() == len(made())
    assert suffix_tree.score_texts(empty, hashed_fold("doc_id", 7, 2)).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(3)
    lang = {"aa": "the and of to in that which".split(), "bb": "le la de que et dans une".split()}
    rows = [(i, " ".join(rng.choice(lang[k]) + rng.choice(["", "s"]) for _ in range(40)), k, k, 0, "") for i in range(200) for k in ["aa" if i % 2 else "bb"]]
    d = spark.createDataFrame([*rows, (998, None, "aa", "", 0, ""), (999, "123 !!", None, "", 0, "")], SCHEMA)
    held = hashed_fold("doc_id", 4, 2)
    got = compression_lid.identify(d, compression_lid.learn(d, ~held)).where(held | (F.col("doc_id") > 900)).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.lang_score <= 1 for r in got if r.doc_id < 900)
    assert {r.lang_pred for r in got if r.doc_id > 900} <= {"und"}
    assert compression_lid.identify(empty, compression_lid.learn(empty)).count() == 0


def test_mix_reaches_its_targets(docs, empty):
    rows = source_schedule.mix(docs).collect()
    assert len(rows) == len(made()) and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, source_schedule.mix(docs).collect()), key=repr)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.size == len(WORDS.findall(next(t or "" for i, t, *_ in made() if i == r.doc_id))) and 0 <= r.taken <= 2 * r.size
    total = 1.5 * sum(r.size for r in rows)
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9))
    caps = {s: 2.0 * sum(r.size for r in x) for s, x in by.items()}
    full: set = set()
    while True:
        level = (total - sum(caps[s] for s in full)) / max(1e-9, sum(w for s, w in weights.items() if s not in full))
        more = {s for s in weights if s not in full and level * weights[s] > caps[s]}
        if not more:
            break
        full |= more
    for s, x in by.items():
        aim = caps[s] if s in full else level * weights[s]
        assert math.isclose(x[0].target, aim, abs_tol=1e-6) and abs(sum(r.taken for r in x) - aim) <= 1
    assert source_schedule.mix(empty).count() == 0


def test_each_slot_has_one_source(docs):
    taken = source_schedule.schedule(docs).where("slot is not null").groupBy("slot").agg(F.count_distinct(F.struct("source")).alias("n"))
    assert taken.where("n > 1").count() == 0


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "a<|end|>\nb\\<|x|><"), (1, 2, "assistant", "|><|"), (2, None, None, None), (3, 0, "end", "\nx<"), (3, 1, "a|>\\", "<|turn:b|>"), (3, 1, "a|>\\", "<|turn:b|>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.digest(chat_format.format_chats(d)).collect():
        own = [(b or "", t or "") for c, _, b, t in rows if c == r.conv_id]
        loss = "".join(t for b, t in own if b == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{b}\n{t}\n" for b, t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(d.limit(0)).count() == 0


def test_chat_parts(spark):
    from pyspark.sql import types as T

    part = lambda kind, text=None, ref=None, **m: (kind, text, ref, m.get("width"), m.get("height"), m.get("seconds"), m.get("pages"))
    rows = [(1, 0, "user", [part("text", "see <|image:1|>"), part("image", ref="a", width=56, height=29), part("audio", ref="b", seconds=2.5)]), (1, 1, "assistant", [part("document", ref="d", pages=3), None]), (1, 2, "user", None)]
    d = spark.createDataFrame(rows, T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(chat_format.PART))]))
    r = chat_format.format_chats(d).first()
    assert "see <\\|image:1|><|image:1|><|audio:2|>" in r.formatted and "<|document:3|>" in r.formatted
    assert [(a.number, a.ref, a.tokens) for a in r.attachments] == [(1, "a", 4), (2, "b", 63), (3, "d", 3072)] and r.expanded_tokens == 3139


def test_myers_and_pieces():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t, k = "".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) + p[rng.randint(0, 9) :], rng.randint(0, 9)
        row, best = list(range(len(p) + 1)), (k + 1, -1)
        for j, c in enumerate(t):
            old, row = row, [0]
            for i in range(1, len(p) + 1):
                row.append(min(old[i - 1] + (p[i - 1] != c), old[i] + 1, row[i - 1] + 1))
            if row[-1] < best[0]:
                best = (row[-1], j + 1)
        assert edit_match.myers(edit_match.peq(p), len(p), t, k) == best
    assert "".join(x for _, x in edit_match.split("abcdefghij", 3)) == "abcdefghij"


def test_decontamination(spark, empty):
    item = "The quick brown fox jumps over the lazy dog while seventeen clever otters applaud politely"
    bench = spark.createDataFrame([(1, item), (2, "short"), (3, None)], "item_id long, text string")
    near = item.replace("clever", "clevr").upper()
    d = spark.createDataFrame([(i, t, "en", "s", 0, "") for i, t in enumerate(["x " + item, near + "!", "the quick brown fox is elsewhere", None, "", item[:40]])], SCHEMA)
    assert {(r.doc_id, r.item_id, r.distance) for r in edit_match.matches(d, bench).collect()} == {(0, 1, 0), (1, 1, 1)}
    assert sorted(r.doc_id for r in edit_match.decontaminate(d, bench).collect()) == [2, 3, 4, 5]
    assert edit_match.matches(empty, bench).count() == 0 and edit_match.matches(d, bench.limit(0)).count() == 0


def test_archive_round_trip(spark):
    rows = [(5, "u", "x" * 200), (3, "v", "x" * 200), (9, "w\r\n", "x" * 200), (1, None, None), (2, "", "short"), (4, "", "short")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in zip_archive.archive_round_trip(d).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i in (5, 9)
        assert got[i] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None)
    assert zip_archive.archive_round_trip(d.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    out = io.BytesIO()
    z = zip_archive.ZipWriter(out, zip64)
    z.add("a", [b"hello"])
    z.add("é", [b""])
    z.close()
    assert zipfile.ZipFile(out).testzip() is None
    found = zip_archive.members(out, len(out.getvalue()))
    out.seek(zip_archive.data_start(out, found["a"]))
    assert out.read(5) == b"hello" and list(found) == ["a", "é"]
    with pytest.raises(ValueError):
        zip_archive.members(io.BytesIO(b"no archive"), 10)


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[200:240] = x[0] + 0.05 * rng.standard_normal((40, 16))
    x[250] = 3 * x[1]
    x[251] = x[2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [])]
    got = {r.vec_id: r for r in nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    adj = u @ u.T >= 0.95
    np.fill_diagonal(adj, False)
    assert [got[i].n_links for i in range(300)] == adj.sum(1).tolist()
    assert got[251].component_id == 2 and not got[251].kept and all(got[i].n_links == 0 and got[i].kept for i in range(400, 405))


def test_full_lists_hide_no_other_cluster(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = x[1] - (x[0] @ x[1]) * x[0]
    near = 0.97 * x[0] + math.sqrt(1 - 0.97**2) * side / np.linalg.norm(side)
    for lo, center in ((100, x[0]), (300, near)):
        x[lo : lo + 100] = center + 0.006 * rng.standard_normal((100, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    adj = u @ u.T >= 0.95
    assert adj[100:200, 300:400].all()
    np.fill_diagonal(adj, False)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nn_descent.near_vectors(d).collect()}
    assert [got[i].n_links for i in range(2000)] == adj.sum(1).tolist()
    assert sum(got[i].kept for i in [*range(100, 200), *range(300, 400)]) == 0  # vector 0 is kept for both
    # without any edge the audit leads to the comparison of all
    monkeypatch.setattr(nn_descent, "neighbour_graph", lambda vecs, *a, **k: vecs.select(*[vecs.id.alias(c) for c in "ab"]).limit(0))
    got = {r.vec_id: r for r in nn_descent.near_vectors(d).collect()}
    assert [got[i].n_links for i in range(2000)] == adj.sum(1).tolist()


def test_extraction(spark):
    page = "<body><header><h1>Site</h1></header><nav>m</nav><main><article><header><h1>T &amp; t</h1><p>by X</p></header><p>A<b>b</b>\n c<br>d<p>E&nbsp;f<ul><li>x<li>y</ul><aside>no</aside><div class='cookie-notice'>z</div></article></main><section id=comments><p>reader</p></section><footer>f</footer>"
    assert site_template.extract(page) == "T & t\nAb c d\nE f\nx\ny"
    rows = [(i, f"http://h.example/{i}", f"<article><div><span>Buy now</span></div><p>text {i}</p></article>") for i in range(6)] + [(9, None, None), (10, "http://h.example/x", "")]
    got = {r.page_id: r.text for r in site_template.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" for i in range(6)} | {9: "", 10: ""}


def test_repeated_pages_keep_their_article(spark):
    page = lambda k: f"<body><div class='wrap'><article><h1>T{k}</h1><p>text {k}</p><ul><li>one {k}</ul><table><tr><td>cell {k}</table></article></div><div><p>Buy now</p></div></body>"
    text = lambda k: f"T{k}\ntext {k}\none {k}\ncell {k}"
    which = [0, 0, 0, 0, 0, 0, 1, 2, 3, 4]
    rows = [(i, f"http://h.example/{i}", page(k)) for i, k in enumerate(which)]
    # the article is the same under another page: template, but what wraps it stays
    rows += [(20 + i, f"http://w.example/{i}", f"<body><div><main><p>{'same text ' * 3}</p></main></div><p>{i}</p></body>") for i in range(4)]
    got = {r.page_id: r.text for r in site_template.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text(k) for i, k in enumerate(which)} | {20 + i: "same text same text same text" for i in range(4)}


def test_trees_share_no_values_and_meet_the_recall():
    # 30,000 pairs of sets with a similarity of exactly 0.8: 36 shingles in common, 9 apart
    n, rng = 30_000, np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, (n, 45), dtype=np.uint64)
    begins = np.arange(n)
    below = lsh_forest.BITS * (lsh_forest.DEPTH - lsh_forest.prefix())
    one, other = (lsh_forest.forest_keys(x[:, at].ravel(), begins * len(at))[0] >> below for at in (np.arange(40), np.r_[:36, 40:45]))
    assert (one == other).any(axis=1).mean() >= 0.9988


def test_audit_shortens_the_prefix(docs, monkeypatch):
    chains, levels = lsh_forest._chains, []
    monkeypatch.setattr(lsh_forest, "_chains", lambda f, level, least: levels.append(level) or chains(f, level, least))
    whole = {r.doc_id: tuple(r) for r in lsh_forest.similar(docs).collect()}
    assert levels == [8]
    levels.clear()
    monkeypatch.setattr(lsh_forest, "_chains", lambda f, level, least: levels.append(level) or chains(f, level, least).where(F.lit(level < 8)))
    assert {r.doc_id: tuple(r) for r in lsh_forest.similar(docs).collect()} == whole and levels == [8, 7]
    monkeypatch.setattr(lsh_forest, "_chains", lambda f, level, least: chains(f, level, least).where(F.lit(False)))
    monkeypatch.setattr(lsh_forest, "prefix", lambda *a, **k: 2)
    # where no prefix is enough, all links are found through shared shingles
    assert {r.doc_id: tuple(r) for r in lsh_forest.similar(docs).collect()} == whole


def test_blocks_of_any_size_find_the_same_links(docs, monkeypatch):
    whole = {r.doc_id: tuple(r) for r in lsh_forest.similar(docs).collect()}
    monkeypatch.setattr(lsh_forest, "BLOCK", 2)
    monkeypatch.setattr(lsh_forest, "COLUMNS", 7)
    assert {r.doc_id: tuple(r) for r in lsh_forest.similar(docs).collect()} == whole


def test_hubs_and_blocks_change_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24))
    x[100:220] = x[0] + 0.12 * rng.standard_normal((120, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    adj = u @ u.T >= 0.95
    np.fill_diagonal(adj, False)
    monkeypatch.setattr(nn_descent, "HUB", 8)
    monkeypatch.setattr(nn_descent, "BLOCK", 30)
    got = {r.vec_id: r.n_links for r in nn_descent.near_vectors(d).collect()}
    assert [got[i] for i in range(400)] == adj.sum(1).tolist()


def test_matches_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (8, 14, 25, 40, 3)] + ["abcde abcde abcde edc"]  # 21 characters: one edit

    def spoilt(item, edits):
        x = list(item)
        for _ in range(edits):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], ["z"], [x[k], "y"]])
        return "".join(x)

    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) + " " + spoilt(rng.choice(items), rng.randint(0, 8)) + " " + " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["so abcde abcde abcde edc it", "so abcde abcde abde edc it", "so abcde abcde abde ed it"]
    want = set()
    for i, t in enumerate(texts):
        t = edit_match.normal(t)
        for j, item in enumerate(items):
            item = edit_match.normal(item)
            row, best = list(range(len(item) + 3)), len(item)
            for c in f" {t} ":
                old, row = row, [0]
                for k, x in enumerate(f" {item} ", 1):
                    row.append(min(old[k - 1] + (x != c), old[k] + 1, row[k - 1] + 1))
                best = min(best, row[-1])
            if best <= int(len(item) * edit_match.RATE):
                want.add((i, j, best))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in edit_match.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == want and 15 < len(want) < 60 and any(d for *_, d in want) and {d for _, j, d in want if j == 5} == {0, 1}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = hashed_fold("doc_id", 4, 2)
    found = compression_lid.identify(docs, compression_lid.learn(docs, ~held)).where(held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n, right = found.count(), found.where("lang_pred = lang").count()
    assert n > 200 and right / n >= 0.97


def thue_morse(n=1024):
    """Two words that hashes which are linear in the bytes can't tell apart."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_tell_patterned_words_apart():
    from crowdlens.llm.shared import text_buffer, word_hashes, words
    import pyarrow as pa

    rng = random.Random(3)
    made_ = {*thue_morse(), *thue_morse(64), *("a" * n for n in range(1, 40)), *("ab" * n for n in range(1, 40)), *("abcdefgh" * n + "x" for n in range(20)), "\x00", "\x00\x00", "\u20ac"}
    made_ |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(3000)}
    many = sorted(made_)
    buf, offsets = text_buffer(pa.array([" ".join(many), "x " + " \n".join(reversed(many)).upper()]))
    s, e, rows = words(buf, offsets)
    h = word_hashes(buf, s, e, lower=True)
    assert len(set(h[rows == 0].tolist())) == len(many)
    # the same word has the same hash in another place, and in capitals
    assert h[rows == 1][1:][::-1].tolist() == h[rows == 0].tolist()
    assert len(np.intersect1d(word_hashes(buf, s, e)[rows == 0], word_hashes(buf, s, e)[rows == 1])) < 10


def test_patterned_words_are_not_equal(spark):
    a, b = thue_morse()
    rest = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{rest} {a} {rest}"), (2, f"{rest} {b} {rest}")]
    df = spark.createDataFrame([(*r, "en", "s", 0, "") for r in rows], SCHEMA)
    assert [(r.doc_id, r.n_removed) for r in recompression.remove_repeats(df).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
    short = spark.createDataFrame([(1, f"p q {a} r s", "en", "s", 0, ""), (2, f"p q {b} r s", "en", "s", 0, "")], SCHEMA)
    assert [r.n_links for r in lsh_forest.similar(short).collect()] == [0, 0]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    scored = suffix_tree.score_texts(spark.createDataFrame([(train, a), (held, b)], "doc_id long, text string"), hashed_fold("doc_id", 7, 2))
    assert {r.doc_id: r.n_known for r in scored.collect()} == {train: 2, held: 1}


def test_pages_with_adverts_and_comments():
    x = site_template.extract
    assert x("<article><p>Text one.</p><p class='advert'>Buy now</p><p style='display:none'>Hidden</p><p>Two.</p></article>") == "Text one.\nTwo."
    assert x("<article class='post'><p>Short post.</p></article><div id='discussion'><article class='comment'><p>A far longer comment than the post is.</p></article></div>") == "Short post."
    assert x("<article><p>Post.</p><article class='comment'><p>Reader says hi</p></article></article>") == "Post."
    said = lambda name: f"<li class='{name}'><span class='author'>Ann</span> <time>1 May</time><p>Nice text, thank you.</p></li>"
    assert x(f"<article><p>Post and more of it.</p><div class='leserkommentare'><h3>Leser</h3><ul>{said('x') * 3}</ul></div><p>End.</p></article>") == "Post and more of it.\nEnd."
    assert x("<article><p>Post and more of it.</p><div id='reader_comments'><p>me too</p></div></article>") == "Post and more of it."
    assert x("<main><article><p>The first of two stories here.</p></article><article><p>Second of two stories.</p></article></main>") == "The first of two stories here.\nSecond of two stories."


@pytest.mark.parametrize("page", ["<div>" * 8000 + "deep", "<a " * 100_000, "<div class='content'>" * 6000 + "<p>deep", "<b>" * 5000 + "</i>" * 5000 + "<p>x" * 5000, "<!" * 100_000, "<span>" * 5000 + "<li>x" * 5000, "<a '" * 99_999], ids=range(7))
def test_odd_pages_take_linear_time(page):
    begin = time.perf_counter()
    site_template.extract(page)
    site_template.subtree_hashes(page)
    assert time.perf_counter() - begin < 2 * max(1, len(page) / 500_000)
