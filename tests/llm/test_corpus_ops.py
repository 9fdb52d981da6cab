"""Line dedup, vectors, toxicity, Jaccard, mixing and the pipeline against brute force, SQL and odd inputs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import spark_rows, sql_rows

import corpus_pipeline
from lodegraph.llm import common, components, crf, entries, jaccard, linededup, mixing, rotated, toxicity
from lodegraph.llm.common import words_of
from lodegraph.llm.components import connected_components

SPACE = "\x20\x09-\x0d"


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert spark_rows(entries.QUERIES[name](spark, sf_dir)) == sql_rows(entries.ORACLE_SQL[name], sf_dir)


def root_of(links, nodes):
    low = {n: n for n in nodes}
    change = True
    while change:
        change = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                change = True
    return low


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(components, "HOT_SHARE", 8)
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 130)] + [(5, 5)] + [(200, k) for k in range(201, 240)]
    df = spark.createDataFrame([*pairs, (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    used = {n for a, b in pairs if a != b for n in (a, b)}
    low = root_of(pairs, {n for p in pairs for n in p})
    assert got == {n: low[n] for n in used}
    assert connected_components(df.limit(0)).count() == 0


def lines_by_hand(rows, min_sites, min_words):
    """A long line's sites are the distinct texts that hold it, and it stays in copies of the first one."""
    n_words = lambda x: len(re.findall(f"[^{SPACE}]+", x))
    long = lambda x: n_words(x) >= linededup.LONG_WORDS
    need = lambda x: linededup.LONG_SITES if long(x) else min_sites if n_words(x) >= min_words else linededup.SHORT_SITES
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if trim(line):
                sites[trim(line)].add(text if long(line) else site)
                if i is not None:
                    first[trim(line)] = min((i, text), first.get(trim(line), (i, text)), key=lambda x: x[0])
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        stays = lambda x: i == first.get(trim(x), (i,))[0] or (long(x) and text == first[trim(x)][1])  # noqa: E731, B023
        left = [x for x in lines if not trim(x) or len(sites[trim(x)]) < need(x) or stays(x)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [2, 3, 8])
def test_lines_near_and_far_from_the_threshold(docs, min_sites):
    rows = [(k, f"this line is shared by many\n only {k} has this one line\n\tthis line has {k % 4} of four forms\nshort", f"s{k % 9}" if k % 9 else None) for k in range(40)]
    rows += [(50, "  this line is shared by many\t", "s1"), (51, None, "s2"), (52, "", "s3"), (None, "this line is shared by many\nand more words without an id", "s4"), (7, "this line is shared by many", "s5")]
    got = sorted((tuple(r) for r in linededup.remove_shared_lines(docs(rows), min_sites).collect()), key=str)
    assert got == lines_by_hand(rows, min_sites, linededup.MIN_WORDS)


def test_lines_by_their_length(docs):
    passage = "a passage of many words that goes on " * 8
    rows = [(k, f"All rights reserved.\nmine {k}\n{passage}" if k < 14 else f"All rights reserved.\nfrom one source only\n{passage.upper()}{k // 16}", f"s{k}" if k < 12 else "hot") for k in range(40)]
    got = sorted((tuple(r) for r in linededup.remove_shared_lines(docs(rows)).collect()), key=str)
    assert got == lines_by_hand(rows, linededup.MIN_SITES, linededup.MIN_WORDS)
    assert "reserved" not in dict((r[0], r[1]) for r in got)[5] and sum(passage in r[1] for r in got) == 1


@pytest.mark.parametrize("share", [linededup.HOT_SHARE, 4])
def test_lines_hot_or_not(docs, monkeypatch, share):
    monkeypatch.setattr(linededup, "HOT_SHARE", share)
    rows = [(k, f"one line that every document has\nanother line of group {k % 9} here\nand this only {k}\n\n", f"s{k % 7}") for k in range(60)] + [(None, "one line that every document has", "x")] * 3
    got = sorted((tuple(r) for r in linededup.remove_shared_lines(docs(rows)).collect()), key=str)
    assert got == lines_by_hand(rows, linededup.MIN_SITES, linededup.MIN_WORDS)


def test_lines_empty(none):
    assert linededup.remove_shared_lines(none).count() == 0


def test_short_lines_and_two_sites_if_asked_for(docs):
    rows = [(k, f"All rights reserved.\nonly {k}\n \n{'long ' * 60}{k // 2}", f"s{k}") for k in range(4)]
    got = sorted((tuple(r) for r in linededup.remove_shared_lines(docs(rows), min_sites=2, min_words=1).collect()), key=str)
    assert got == lines_by_hand(rows, 2, 1) and [r[3] for r in got] == [0, 2, 1, 2]


def vectors_by_hand(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold]
    low, n = root_of(links, [i for i, _ in rows]), Counter(x for p in links for x in p)
    return sorted((i, n[i], low[i], low[i] == i) for i, _ in rows)


@pytest.mark.parametrize("side", [8192, 16])
def test_vectors(spark, monkeypatch, side):
    monkeypatch.setattr(rotated, "SIDE", side)
    monkeypatch.setattr(rotated, "PER_PIVOT", side)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = base[:20] + 0.15 * rng.standard_normal((20, 16))
    crowd = base[0] + 0.12 * rng.standard_normal((60, 16))
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate([*base, *near, *crowd, *base[:5], 3 * base[6]])]
    rows += [(800 + k, (base[k] * (0.1 + k)).tolist()) for k in range(5)]  # not exact in 32 bits
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (907, [float("inf")] * 16), (908, [-0.0] * 15 + [1.0]), (909, [0.0] * 15 + [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, node int")
    got = sorted(tuple(r) for r in rotated.near_duplicates(df).collect())
    assert got == vectors_by_hand(rows, rotated.THRESHOLD)
    assert rotated.near_duplicates(df.limit(0)).count() == 0


def test_vectors_keep_their_precision():
    v = np.array([[0.1, 0.2], [0.5, 0.25], [1e300, 1.0], [3.0, -4.0]])
    raw = rotated.raw_vectors(v)
    assert [len(x) for x in raw] == [16, 8, 16, 8] and (rotated.read_vectors(raw, 2) == v).all() and (rotated.read_vectors(raw[1:2], 2) == v[1:2]).all()


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    y = x[:50] + 0.3 * rng.standard_normal((50, 64)) / 8
    y /= np.sqrt((y * y).sum(1))[:, None]
    turn = rotated.rotation(64)
    guess, error = rotated.estimates(*rotated.codes(x, turn), y @ turn.T)
    true = x @ y.T
    assert (np.abs(guess - true) <= error + 1e-5).all() and abs(float((guess - true).mean())) < 0.01
    low, high = rotated.interval(rotated.codes(x, turn)[1], 0.9)
    inner = rotated.unpacked(rotated.codes(x, turn)[0], 64) @ (y @ turn.T).T
    assert ((inner >= low[:, None] - 1e-5) & (inner <= high[:, None] + 1e-5))[true >= 0.9].all()


def crf_by_hand(model, scores):
    from itertools import product

    n, k = scores.shape
    best, total, p = None, 0.0, np.zeros((n, k))
    for path in product(range(k), repeat=n):
        s = model.first[path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False))
        total += np.exp(s)
        for t, y in enumerate(path):
            p[t, y] += np.exp(s)
        best = max(best or (s, path), (s, path))
    return list(best[1]), p / total, np.log(total)


def test_field_against_all_paths():
    rng = np.random.default_rng(5)
    model = crf.Crf(np.zeros((1, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3))
    sizes = np.array([3, 0, 5, 1])
    scores = rng.standard_normal((9, 3))
    labels, (p, *_, logz) = model.viterbi(scores, sizes), model.marginals(scores, sizes)
    at, total = 0, 0.0
    for n in sizes:
        if n:
            path, q, z = crf_by_hand(model, scores[at : at + n])
            assert labels[at : at + n].tolist() == path and np.allclose(p[at : at + n], q)
            total += z
        at += n
    assert abs(total - logz) < 1e-9


def test_toxicity_query(spark, sf_dir):
    rows = entries.op7_toxicity(spark, sf_dir).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == docs
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def score_by_hand(model, text):
    """Words, lines and marginals one after another, without arrays of texts."""
    every, words = [], 0
    for line in (text or "").split("\n"):
        tokens = [w.strip(toxicity._EDGE).lower() for w in line.split()]
        words += len(line.split())
        gaps = [sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in tokens]
        first, moves = np.exp(model.crf.first), np.exp(model.crf.moves)
        ahead = []
        for k, g in enumerate(gaps):
            f = (first if not k else ahead[-1] @ moves) * np.exp([0.0, g])
            ahead.append(f / f.sum())
        back = np.ones(2)
        for k in range(len(gaps) - 1, -1, -1):
            both = ahead[k] * back
            every.append(both[1] / both.sum() if tokens[k] else 0.0)
            back = moves @ (np.exp([0.0, gaps[k]]) * back)
            back /= back.sum()
    found = np.array([np.log1p(sum(every)), max(every, default=0.0), np.log1p(words)])
    return 1 / (1 + np.exp(-(model.logistic[0] + (found - model.shift) @ np.array(model.logistic[1:]))))


def test_toxicity_query_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_table(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in entries.op7_toxicity(spark, sf_dir).collect()}
    for i, text in texts.items():
        if len(text) < 20_000:
            assert abs(rows[i]["score"] - score_by_hand(model, text)) < 1e-6
        for a, b, p in rows[i]["spans"]:
            assert p >= 0.5 and text[a:b].strip() == text[a:b] and (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace())
    assert any(r["spans"] for r in rows.values())


def test_toxicity_finds_most_of_the_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["predicted"] for r in entries.op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in got]
    caught, alarms = [p for t, p in held if t], [p for t, p in held if not t]
    assert sum(caught) >= 0.7 * len(caught) and sum(alarms) <= 0.1 * len(alarms)
    assert docs.count() == len(got)


def test_toxicity_sample(spark):
    docs = spark.createDataFrame([(k, "w " * (k + 1) if k < 8 else "line one\n" * 4000 + "end") for k in range(10)] + [(None, "x"), (3, "w w w w ")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(3, 0), (2, 1), (4, None), (None, 1), (99, 1), (5, 7)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, hold_out=False)
    assert {r["_doc"]: r["_label"] for r in rows.collect()} == {k: int(k % 2 == 1 or k == 2) for k in range(10)} and rows.count() == 10
    toxic, clean = toxicity.drawn(rows, most_chars=2000)
    assert len(toxic) == 6 and len(clean) == 4 and max(map(len, toxic + clean)) <= 2002
    assert toxicity.fit_table(docs, labels.where("toxic = 0")).logistic == []


def test_toxicity_on_held_out_rows():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("aeioustrn"), 6)) for _ in range(400)]
    rude = ["grub" + "".join(rng.choice(list("aeiou"), 2)) for _ in range(12)]

    def text(toxic):
        words = rng.choice(plain, 60).tolist()
        for _ in range(4 * toxic):
            words[int(rng.integers(60))] = str(rng.choice(rude)) + "!"
        return " ".join(words[:30]) + "\n" + " ".join(words[30:])

    toxic, clean = [text(1) for _ in range(80)], [text(0) for _ in range(160)]
    model = toxicity.fit(toxic[:60], clean[:120])
    score = lambda t: model.score(model.documents(pa.array(t))[0])
    assert (score(toxic[60:]) >= 0.5).all() and (score(clean[120:]) < 0.5).all()
    assert 0 <= score(["", None, "\n\n", "x " * 5000]).max() < 0.5
    said = "one two\n\n  grubai! grubae, five"
    assert [said[a:b] for a, b, _ in toxicity.spans(said, model)] in (["grubai! grubae,"], ["grubai!", "grubae,"])


def test_toxicity_odd(odd, none):
    model = toxicity.fit([], ["x"])
    assert {r["score"] for r in toxicity.score_documents(odd, model).collect()} == {0.0}
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.keep_clean(odd, model, ["doc_id", "text"]).count() == odd.count()


def shingles(text, k):
    w = re.findall(f"[^{SPACE}]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def similar_by_hand(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, _ in rows]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    low = root_of(links, [i for i, _ in sets if i is not None])
    return sorted((str(i), len(x), str(low.get(i))) for i, x in sets)


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 256), (5, 80, 256), (1, 80, 4), (2, 50, 8), (1, 30, 4), (3, 72, 2)])
def test_jaccard(docs, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    if block < 256:
        monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
        monkeypatch.setattr(jaccard, "SMALL", 12)
    rng = np.random.default_rng(7)
    words = [f"w{n}" for n in range(300)]
    shared = rng.choice(words, 50).tolist()
    rows = []
    for n in range(120):
        base = rng.choice(words, int(rng.integers(1, 120))).tolist()
        if n % 5 == 0:
            base[: len(shared)] = shared
        for c in range(int(rng.integers(1, 5))):
            t = list(base)
            for _ in range(c):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(t).title() if c == 2 else " ".join(t), "a"))
    rows += [(900, None, "a"), (901, "", "a"), (902, " \n ", "a"), (903, "one two", "a"), (904, "ONE\ttwo ", "a"), (None, "one two", "a"), (905, "\xa0a b\x1cc", "a"), (3, rows[50][1], "a"), (5, rows[5][1], "b"), (906, "long text " * 20_000, "a")]
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.similarity_components(docs(rows), k, percent).collect())
    assert got == similar_by_hand(rows, k, percent)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 120), st.integers(0, 30), st.integers(0, 30), st.sampled_from([20, 30, 50, 66, 70, 80, 85, 95]), st.integers(0, 10**6))
def test_similar_sets_share_a_key(common, left, right, percent, seed):
    h = jaccard.mixed(np.random.default_rng(seed).integers(0, 2**63, common + left + right).astype(np.uint64))
    x, y = np.unique(h[: common + left]), np.unique(np.concatenate([h[:common], h[common + left :]]))
    if jaccard.similar(x, y, percent) and not np.array_equal(x, y):
        assert len(np.intersect1d(jaccard.filed_keys(x, percent), jaccard.filed_keys(y, percent)))


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
@pytest.mark.parametrize("n", [33, 64, 300, 1000])
def test_a_set_is_filed_under_few_keys(n, percent):
    """One key more than a partner can differ in, for each band that partners are in."""
    x = np.unique(jaccard.mixed(np.arange(n, dtype=np.uint64)))
    bands = n.bit_length() - (-(-n * percent // 100)).bit_length() + 1
    small = n - -(-percent * n // 100) + 1 if n * percent <= 100 * jaccard.SMALL else 0
    keys = jaccard.filed_keys(x, percent)
    assert len(keys) == small + bands * (jaccard.allowed(n, percent) + 1)
    assert len(set(keys.tolist())) == len(keys)


def test_tables_without_readers_are_deleted(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    text = " ".join(f"w{k}" for k in range(60))
    df = docs([(1, text, "a"), (2, text + " x", "a"), (3, text, "b"), (4, "y " + text, "c"), (5, "none of these", "a")])
    rows = jaccard.similarity_components(df, 5, 80).collect()
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert sorted((r[0], r[2]) for r in rows) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    assert not left & {"signatures", "heads", "candidates", "texts", "tiles", "near", "nearest", "labelled", "open"}
    assert len(linededup.remove_shared_lines(df).collect()) == len(rows)
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert "lines" not in left and "gone-lines" in left


def test_jaccard_empty(none):
    assert jaccard.similarity_components(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_keep_one_takes_repeated_rows_and_null_ids(docs):
    a, b = "one two three four five six seven", "other words that no one else has here"
    rows = [(3, a, "x"), (3, a, "y"), (3, "a second text under the id", "x"), (9, a, "x"), (None, a, "x"), (None, b, "x"), (None, b, "y"), (None, "", "x"), (None, None, "x"), (7, "", "x"), (7, "", "x")]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs(rows)).collect()), key=str)
    assert got == sorted([(3, a), (3, "a second text under the id"), (None, b), (None, ""), (None, None), (7, "")], key=str)


def test_targets():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)]) == {"a": 300 * 5 / 8, "b": 300 * 2 / 8, None: 300 / 8}
    got = mixing.targets([("a", 10), ("b", 500), ("c", 90)])
    assert got["a"] == 30 and abs(sum(got.values()) - 600) < 1e-9 and abs(got["b"] / got["c"] - 2) < 1e-9
    assert mixing.targets([("a", 0)]) == {"a": 0.0} and mixing.targets([]) == {}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.floats(0.01, 0.99), st.integers(0, 99))
def test_flight_keeps_both_totals(sizes, p, seed):
    size = np.array(sizes, float)
    start = np.full(len(size), p)
    end = mixing.flight(start, size, np.random.default_rng(seed))
    assert ((end > 1e-9) & (end < 1 - 1e-9)).sum() <= 2
    assert abs(end.sum() - start.sum()) < 1e-5 and abs((size * end).sum() - (size * start).sum()) < 1e-5 * max(1.0, size.sum())


def test_mixing_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in entries.op9_mixing(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    total, taken, biggest = Counter(), Counter(), Counter()
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["size"] == len(words_of(d["text"])) and r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        total[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        biggest[d["source"]] = max(biggest[d["source"]], r["size"])
    target = mixing.targets(list(total.items()))
    for s in total:
        assert abs(taken[s] - target[s]) <= biggest[s]
    assert {r["doc_id"]: r["taken"] for r in entries.op9_mixing(spark, sf_dir).collect()} == {k: r["taken"] for k, r in rows.items()}


def test_mixing_in_many_blocks(docs):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(rng.integers(1, 40)), f"s{k % 3}") for k in range(3000)]
    got = mixing.mix(docs(rows), block=140).collect()
    assert len(got) == 3000
    by, target = Counter(), {}
    for r in got:
        by[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(by[s] - target[s]) <= 2 for s in target)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "é", "Z", "\U0001f600", "", None, "src10", "src9"]), st.integers(0, 400)), max_size=12, unique_by=lambda x: x[0]))
def test_plan_of_sources_is_that_of_the_list(sizes):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(s, n) for s, n in sizes], "source string, size long")
    plan, _ = mixing.source_table(rows, mixing.WEIGHTS, mixing.MOST_TIMES, 4096)
    assert {r["_source"]: r["target"] for r in plan.collect()} == pytest.approx(mixing.targets(sizes))


def test_mixing_with_a_shuffled_plan(docs, monkeypatch):
    rows = [(k, "w " * (k % 30), f"s{k % 40}") for k in range(400)] + [(500, "w w", None)]
    want = sorted(map(str, mixing.mix(docs(rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.mix(docs(rows)).collect())) == want


def test_mixing_odd(odd, none):
    rows = mixing.mix(odd, extra=("text",)).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if not r["text"]} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mix(none, extra=("text",)).count() == 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept[name] = (docs, out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "mixing", "packing"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in x.collect()} for x in kept["toxicity"])
    gone = before - after
    clean = [i for i, t in labels.items() if t == 0 and i in before]
    assert after < before and sum(i in gone for i in clean) <= 0.05 * len(clean)
    before, after = (sorted((r["doc_id"], r["text"], r["source"]) for r in x.collect()) for x in kept["line_dedup"])
    hand = [(i, t) for i, t, _, n in lines_by_hand(before, linededup.MIN_SITES, linededup.MIN_WORDS) if not n or t.strip()]
    assert sorted((i, t) for i, t, _ in after) == sorted(hand)
    before, after = ([(r["doc_id"], r["text"], "") for r in x.collect()] for x in kept["near_dup"])
    roots = {int(i) for i, _, c in similar_by_hand(before, 5, 80) if i == c}
    assert {i for i, *_ in after} == roots
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in kept["mixing"])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    assert sum(r["length"] for r in kept["packing"][1].collect()) >= len(after)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, odd, none, stage):
    assert stage(spark, none, sf_dir).count() == 0
    left = stage(spark, odd, sf_dir).collect()
    assert left and {r["doc_id"] for r in left} <= {1, 2, 3, 4, 5, 6, 7, None}


def test_guard_and_names():
    import __spark_entry__ as e

    assert set(entries.QUERIES) <= set(e.queries()) and "pipeline" in e.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in entries.QUERIES) == list(range(1, 11))
