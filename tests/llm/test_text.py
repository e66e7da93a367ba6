"""Scanning, packing, mixing, exact duplicates, language identification, toxicity."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import exact_dedup, language_id, mixing, packing, textscan, toxicity
from weft.llm.common import components

ODD = [None, "", " ", "\t\n", "x", "a b\tc", "  The quick\x0bbrown ", "é à\xa0b c", "a b c", "A" * 5000, "w " * 3000]
SCHEMA = "doc_id long, text string, source string, n_chars long, key string, again string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", 1, "k", "g") for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_scan_agrees_with_the_pattern(limit):
    seen = {}
    for w in textscan.scan(pa.array(ODD), limit=limit):
        for d in range(w.n_docs):
            at = np.flatnonzero(w.doc == d)
            assert [w.text(i, i + 1) for i in at] == words(ODD[w.first + d])
            for i in at:
                assert seen.setdefault(w.text(i, i + 1), w.hash[i]) == w.hash[i]
            if len(at) >= 3:
                h, ok = w.sequence(3)
                assert ok[at[0]] and seen.setdefault(w.text(at[0], at[0] + 3), h[at[0]]) == h[at[0]]
    assert len(set(seen.values())) == len(seen)
    assert textscan.count_words(pa.array(ODD)).tolist() == [len(words(t)) for t in ODD]
    sliced = pa.array(ODD).slice(4, 5)
    assert textscan.count_words(sliced).tolist() == [len(words(t)) for t in ODD[4:9]]


@pytest.mark.parametrize("width", [1, 2, 3, 9, 13])
def test_sliding_min(width):
    x = np.random.default_rng(1).integers(0, 99, 40)
    assert textscan.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(40 - width + 1)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 201 + i) for i in range(20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]}


# -- exact duplicates


def brute_duplicates(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        g = groups[norm]
        out.append((i, min(g)[3], len(g), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def test_exact_duplicates(spark):
    rows = list(enumerate(ODD)) + [(50 + i, "same text") for i in range(20)] + [(90, "same  text "), (91, "sametext"), (None, "lost"), (None, "lost x"), (7, "twice"), (8, "twice")]
    df = frame(spark, rows).repartition(5)
    got = exact_dedup.duplicates(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(brute_duplicates(rows), key=repr)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in got if r.kept), key=repr)


def test_exact_duplicates_of_repeated_rows_and_none(spark):
    rows = [(1, "a"), (1, "a"), (2, "b")]
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup.duplicates(frame(spark, rows)).collect()) == [(1, 2, False), (1, 2, True), (2, 1, True)]
    empty = frame(spark, [])
    assert exact_dedup.duplicates(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0


def test_filter_never_misses(spark):
    keys = [int(x) for x in np.random.default_rng(5).integers(-(2**62), 2**62, 2000)]
    rows = spark.createDataFrame([(k,) for k in keys + keys[:100]], "key long").repartition(7)
    got = exact_dedup.maybe_repeated(rows, "key", "again").where("again").collect()
    assert {k for k in keys[:100]} <= {r.key for r in got}
    assert len(got) < 300


# -- packing


@pytest.mark.parametrize("seed", range(4))
def test_packing_keeps_every_unit(seed):
    rnd = random.Random(seed)
    lengths = np.array([rnd.choice([0, 1, rnd.randint(1, 40), rnd.randint(1, 400)]) for _ in range(300)])
    bins = list(packing.pack_window(list(range(300)), lengths, (32, 64, 128), 4))
    seen = {}
    for capacity, used, ids, starts, sizes in bins:
        assert used == sum(sizes) <= capacity
        assert capacity == min(c for c in (32, 64, 128) if c >= used)
        for i, s, n in zip(ids, starts, sizes):
            seen.setdefault(i, []).append((s, n))
    assert set(seen) == set(range(300))
    for i, parts in seen.items():
        assert sum(n for _, n in parts) == lengths[i]
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
    waste = 1 - lengths.sum() / sum(b[0] for b in bins)
    assert waste < 0.03


def cheapest(lengths, capacities, overhead):
    """Exhaustive: every way to deal the pieces into sequences."""
    best = [float("inf")]

    def go(at, sums):
        if at == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= x) + overhead for x in sums))
            return
        for i, x in enumerate(sums):
            if x + lengths[at] <= max(capacities) and x not in sums[:i]:
                go(at + 1, [*sums[:i], x + lengths[at], *sums[i + 1 :]])
        go(at + 1, [*sums, lengths[at]])

    go(0, [])
    return best[0]


def test_packing_against_exhaustive_search():
    rnd = random.Random(2)
    ours = least = exact = 0
    for _ in range(150):
        lengths = [rnd.choice([rnd.randint(1, 10), rnd.randint(1, 40)]) for _ in range(rnd.randint(1, 8))]
        bins = packing.pack_lengths(lengths, (10, 20, 40), 2)
        assert sorted(x for _, held in bins for x in held) == sorted(lengths)
        assert all(c == min(s for s in (10, 20, 40) if s >= sum(held)) for c, held in bins)
        a, b = packing.cost(bins, 2), cheapest(lengths, (10, 20, 40), 2)
        ours, least, exact = ours + a, least + b, exact + (a == b)
    assert ours <= 1.05 * least and exact >= 90


def test_packing_query_against_brute_force(spark):
    """One partition: windows of rows in order, every word counted, the same sequences as from plain lists."""
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 3, 50, 400, 2500])))) for i in range(150)]
    got = [(r.capacity, r.n_used, list(r.doc_ids), list(r.starts), list(r.lengths)) for r in packing.pack(frame(spark, rows).coalesce(1), window=64).orderBy("bin_id").collect()]
    expected = []
    for at in range(0, 150, 64):
        part = rows[at : at + 64]
        expected += packing.pack_window([i for i, _ in part], np.array([len(words(t)) for _, t in part]), packing.CAPACITIES, packing.OVERHEAD)
    assert got == [(c, n, list(i), list(s), list(z)) for c, n, i, s, z in expected]


def test_packing_table(spark):
    df = frame(spark, [*enumerate(ODD), (None, "some words here"), (3, "again 3")])
    got = packing.pack(df, capacities=(1024, 2048)).collect()
    total = sum(len(words(t)) for t in ODD) + 5
    assert sum(r.n_used for r in got) == total == sum(sum(r.lengths) for r in got)
    assert sorted({str(i) for r in got for i in r.doc_ids}) == sorted({*map(str, range(len(ODD))), "None"})
    assert len({r.bin_id for r in got}) == len(got)
    assert packing.pack(frame(spark, [])).count() == 0
    assert [r.capacity for r in packing.pack(frame(spark, [(1, None)])).collect()] == [1024]


# -- mixing


def mixing_docs(spark, n=200):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["red", "rose", "ruby"] if i % 4 else ["blue", "sky", "sea"]) for _ in range(rnd.randint(5, 60)))) for i in range(n)]
    return frame(spark, rows + [(n, None), (n + 1, ""), (None, "red sky")]), spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(0, n, 2)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")


def test_mixing_reaches_the_targets(spark):
    docs, labels = mixing_docs(spark)
    out, report = mixing.mix(docs, labels, weights={"0": 0.5, "1": 0.5})
    rows = out.collect()
    assert len(rows) == 203
    assert report["domains"] == ["0", "1"]
    for k, goal in enumerate(report["goal"]):
        reached = sum(r.rate * r.n_tokens * r[f"p_{k}"] for r in rows)
        assert reached == pytest.approx(goal, rel=1e-3)
    assert all(r.rate >= 0 and abs(r.p_0 + r.p_1 - 1) < 1e-9 and 0 <= r.copies - r.rate + 1 <= 2 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[4].p_0 > 0.9 > 0.1 > by[5].p_0
    assert by[200].n_tokens == 0


def test_mixing_against_brute_force(spark):
    """Posteriors by the formula of naive Bayes, rates by projected gradients of their own; hashes from the public xxhash."""
    import xxhash

    docs, labels = mixing_docs(spark, 80)
    out, report = mixing.mix(docs, labels, weights={"0": 0.4, "1": 0.6})
    rows = [(r.doc_id, [xxhash.xxh64_intdigest(w, 42) & (mixing.BUCKETS - 1) for w in words(r.text)]) for r in docs.collect()]
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    table, size = np.full((2, mixing.BUCKETS), 0.5), np.zeros(2)
    for i, w in rows:
        if i in known:
            size[known[i]] += 1
            np.add.at(table[known[i]], w, 1)
    table = np.log(table / table.sum(axis=1, keepdims=True))
    raw = np.array([np.log(size / size.sum()) + mixing.WEIGHT_WORDS / max(len(w), mixing.WEIGHT_WORDS) * table[:, w].sum(axis=1) for _, w in rows])
    p = np.exp(raw - raw.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    n = np.array([len(w) for _, w in rows], float)
    goal = np.array([0.4, 0.6]) * n.sum()
    rate = np.ones(len(n))
    g = (p * n[:, None]).T @ p
    for _ in range(500):
        rate = np.maximum(0, rate - p @ np.linalg.solve(g, (rate * n) @ p - goal))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.p_0, r.rate) for r in out.collect()))
    want = sorted(((i if i is not None else -1, int(a), b, r) for (i, _), a, b, r in zip(rows, n, p[:, 0], rate)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.array([x[2] for x in got]) == pytest.approx(np.array([x[2] for x in want]), abs=1e-3)
    assert np.array([x[3] for x in got]) == pytest.approx(np.array([x[3] for x in want]), abs=2e-3)
    assert report["goal"] == pytest.approx(goal.tolist())


def test_mixing_with_a_lower_bound(spark):
    docs, labels = mixing_docs(spark)
    out, report = mixing.mix(docs, labels, weights={"0": 0.5, "1": 0.5}, least=1.0, carry=True)
    assert set(docs.columns) <= set(out.columns)
    assert out.where("rate < 1").count() == 0
    assert report["reached"] == pytest.approx(report["goal"], rel=1e-2)


def test_mixing_without_labels_or_documents(spark):
    docs, labels = mixing_docs(spark, 20)
    out, report = mixing.mix(docs, labels.limit(0))
    assert report["domains"] == ["all"] and {r.rate for r in out.collect()} == {1.0}
    out, _ = mixing.mix(frame(spark, []), labels)
    assert out.count() == 0


# -- language


def language_docs(spark):
    rnd = random.Random(2)
    stems = {"en": ["the", "thing", "shell", "with"], "fr": ["être", "où", "leçon", "élève"], "de": ["über", "straße", "schön", "ich"]}
    rows = [(i, " ".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(3, 30))), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    return rows, spark.createDataFrame(rows + [(900, "Über Straße", None), (901, None, "en"), (902, "123 ---", "fr"), (None, "le mot", "fr"), (903, "", None)], "doc_id long, text string, lang string")


def test_language_identification(spark):
    rows, df = language_docs(spark)
    model = language_id.train(df.where("doc_id % 4 <> 2"), rows=30)
    got = {r.doc_id: r.language for r in language_id.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 2]
    assert all(got[i].lang == lang for i, lang in held)
    assert got[900].lang == "de"
    assert {got[i].lang for i in (901, 902, 903)} == {"und"} and got[901].score == 0
    assert all(0 <= x.score <= 1 for x in got.values())
    none = language_id.train(df.limit(0))
    assert {r.language.lang for r in language_id.identify(df, none).collect()} == {"und"}


def test_language_of_repeated_rows_and_clashing_columns(spark):
    rows, df = language_docs(spark)
    twice = df.union(df).withColumn("language", F.lit("mine"))
    model = language_id.train(twice, rows=20)
    assert model.languages == language_id.train(df, rows=20).languages
    out = language_id.identify(twice, model)
    assert out.columns[-1] == "_language" and {r.language for r in out.collect()} == {"mine"}
    known = [(i, lang) for i, t, lang in rows if lang and t and re.search(r"[^\W\d_]", t)]
    got = {(r.doc_id, r["_language"].lang) for r in out.collect()}
    assert sum(x in got for x in known) >= 0.9 * len(known)


def test_presence_is_whole_and_per_text():
    texts = ["abc", "", "ABC", "é" * 70000, "bcd"]
    rows = np.concatenate([x for _, x in language_id.presence(pa.array(texts))])
    assert rows.sum(axis=1).tolist()[:3] == [6, 0, 6] and (rows[0] == rows[2]).all()
    assert rows[3].sum() == 3 and rows[4].sum() == 6


# -- toxicity


def toxic_docs(spark, n=240):
    rnd = random.Random(4)
    plain = ["water", "house", "garden", "letter", "winter", "morning", "stone", "paper"]
    bad = ["dreadfool", "nastibum", "grumblewit"]
    rows = []
    for i in range(n):
        text = [rnd.choice(plain) for _ in range(rnd.randint(5, 40))]
        if i % 3 == 0:
            text[rnd.randrange(len(text))] = rnd.choice(bad)
        rows.append((i, " ".join(text)))
    return rows, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity(spark):
    rows, labels = toxic_docs(spark)
    extra = [(900, "a house d-r-e-a-d-f-o-o-l here"), (901, "the nastixbum garden"), (902, None), (903, ""), (904, "g r u m b l e w i t stone"), (905, "x" * 3000 + " water"), (None, "nastibum")]
    docs = frame(spark, rows + extra)
    machine = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == (i % 3 == 0) for i, _ in rows if i % 5 == 0]
    assert sum(right) >= 0.95 * len(right)
    assert got[900] > 0.5 and got[901] > 0.5 and got[904] > 0.5
    assert got[902] < 0.5 and got[903] < 0.5 and got[905] < 0.5


def test_sentences():
    assert toxicity.sentences('The stone, a STONE. "Is it paper?" yes\nwinter i d i o t m') == [["stone", "the"], ["paper"], ["yes"], ["winter"], ["idiotm"]]
    assert toxicity.sentences(None) == toxicity.sentences(" .\n!") == []


def test_sentences_of_texts_and_of_columns_agree():
    """Margins of the two highest sentences, text by text and in runs of a column."""
    rnd = random.Random(6)
    parts = ["stone", "grumblewit", "nastibum.", 'winter!"', "a", "\n", "paper?", "...", "nas-ti-bum", "\t"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(200)]
    rows = [f"{rnd.choice(['stone paper', 'winter house'])} {'grumblewit nastibum' if i % 2 else 'garden'}" for i in range(60)]
    m = toxicity.fit([toxicity.sentences(t) for t in rows], [i % 2 for i in range(60)])
    own = []
    for t in texts:
        of = sorted((m.margins(x).max() for x in toxicity.sentences(t)), reverse=True)
        own.append(m.probability(*(np.array([v]) for v in [*of, toxicity.NO_WORD, toxicity.NO_WORD][:2]))[0])
    assert toxicity.Scorer(m)(pa.array(texts)).tolist() == pytest.approx(own)


def test_toxicity_finds_unseen_forms_of_insults(spark):
    """Forms with inserted letters and marks of which training holds none, at every place of every insult."""
    rows, labels = toxic_docs(spark)
    machine = toxicity.train(frame(spark, rows), labels)
    unseen = [f"{w[:i]}{x}{w[i:]}" for w in ("dreadfool", "nastibum", "grumblewit") for i in range(2, len(w) - 1) for x in ("z", "*", "qk", "0")]
    seen = {w for _, t in rows for w in t.split()}
    assert not seen & set(unseen)
    got = toxicity.Scorer(machine)(pa.array([f"water {w} paper. The winter garden" for w in unseen]))
    assert (got >= 0.5).mean() >= 0.95
    clean = toxicity.Scorer(machine)(pa.array([f"water {w} paper. The winter garden" for w in ("stones", "dreams", "grumble", "waters", "bumper", "fools", "letters")]))
    assert (clean < 0.5).mean() >= 0.7


def test_toxicity_defined_cases(spark):
    rows, labels = toxic_docs(spark, 60)
    twice = frame(spark, rows + rows).withColumn("score", F.lit("mine")).withColumn("SCORE_", F.lit(1))
    out = toxicity.score(twice, toxicity.train(twice, labels.union(labels)))
    assert out.columns[-1] == "_score" and {r.score for r in out.collect()} == {"mine"}
    assert out.where("doc_id % 3 = 0 AND _score < 0.5 OR doc_id % 3 > 0 AND _score >= 0.5").count() <= 4
    none = toxicity.train(frame(spark, [(1, None), (2, "")]), labels)
    assert [r.score for r in toxicity.score(frame(spark, [(1, None), (2, "stone")]), none).select("score").collect()] == [0.0, 0.0] or none.constant is None
    assert toxicity.score(frame(spark, []), none).count() == 0


def test_toxicity_with_one_class(spark):
    rows, labels = toxic_docs(spark, 30)
    docs = frame(spark, rows)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def brute_kernel(a, b):
    from itertools import combinations

    def vec(w):
        out = {}
        for t in combinations(range(len(w)), 3):
            if t[2] - t[0] < toxicity.SPAN:
                k = w[t[0]] + w[t[1]] + w[t[2]]
                out[k] = out.get(k, 0) + toxicity.DECAY ** (t[2] - t[0] + 1)
        return out

    x, y = vec(a), vec(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_is_the_gapped_subsequence_kernel():
    left, right = ["idiot", "idxiot", "banana", "stone"], ["idiot", "nanana", "onest"]
    got = toxicity.kernel(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            assert got[i, j] == pytest.approx(brute_kernel(a, b), abs=1e-9)


def test_folded_scores_equal_kernel_scores(spark):
    rows, labels = toxic_docs(spark, 60)
    m = toxicity.fit([toxicity.sentences(t) for _, t in rows], [int(i % 3 == 0) for i, _ in rows])
    scorer = toxicity.Scorer(m)
    one = [scorer(pa.array([t]))[0] for _, t in rows]
    assert scorer(pa.array([t for _, t in rows])).tolist() == pytest.approx(one)
