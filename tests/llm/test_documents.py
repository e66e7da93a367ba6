"""Near duplicates, repeated phrases, fingerprints, WARC archives, HTML extraction, and the pipeline."""

import base64
import hashlib
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import fingerprints, html_extract, near_dedup, substrings, warc

SCHEMA = "doc_id long, text string, source string, key string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "k", "c") for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- near duplicates


def brute_near(rows, k, threshold=80):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = list(rnd.choice(texts))
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 30, 80]))]
        texts.append(w)
        text = " ".join(w)
        out.append((i * 3 + 1, text.upper() if rnd.random() < 0.2 else text))
    return out + [(2, None), (5, ""), (8, " \t"), (11, "one"), (14, "ONE"), (17, "one two")]


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 2), (3, 5)])
def test_near_duplicates_against_brute_force(spark, seed, k):
    rows = near_rows(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_classes(frame(spark, rows).repartition(3), k=k).collect()}
    assert got == brute_near(rows, k)


def test_chains_and_crossing_components(spark):
    """Neighbours in a chain are similar, its ends are not: links that no star centre has must be found in the blocks."""
    rnd = random.Random(9)
    w = [f"x{i}" for i in range(60)]
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(w)))
        w = list(w)
        for _ in range(2):
            w[rnd.randrange(60)] = f"y{i}_{rnd.randrange(999)}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_classes(frame(spark, rows), k=2).collect()}
    assert got == brute_near(rows, 2)


def test_one_large_group_around_the_threshold(spark):
    """Mutual similarities scatter around 0.8; the block's rows, not its pairs, leave the task."""
    rnd = random.Random(4)
    base = [f"x{i}" for i in range(70)]
    rows = []
    for i in range(1200):
        w = list(base)
        for j in rnd.sample(range(70), rnd.choice([2, 3, 4])):
            w[j] = f"y{rnd.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_classes(frame(spark, rows).repartition(5), k=2).collect()}
    assert got == brute_near(rows, 2)


@pytest.mark.parametrize("halves", [False, True])
def test_links_of_a_block_are_a_spanning_forest(halves):
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 2**62, 90).astype(np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy() if rnd.random() < 0.8 else rnd.integers(0, 2**62, 90).astype(np.uint64)
        s[rnd.choice(90, rnd.integers(2, 14), replace=False)] = rnd.integers(0, 2**62)
        sets.append(np.unique(s))
    doc = np.repeat(np.arange(150), [len(s) for s in sets])
    regs = near_dedup.sketches(150, doc, np.concatenate(sets))
    comp, own = rnd.integers(0, 120, 150), rnd.integers(0, 2, 150)
    links = near_dedup.spanning_links(np.arange(150), comp, own if halves else None, regs, sets, 0.8)
    root = dict(enumerate(comp.tolist()))

    def merged(pairs):
        of = {c: c for c in root.values()}
        for a, b in pairs:
            x, y = of[root[a]], of[root[b]]
            of = {c: x if r == y else r for c, r in of.items()}
        groups = {}
        for c, r in of.items():
            groups.setdefault(r, set()).add(c)
        return {frozenset(g) for g in groups.values()}

    every = []
    for a in range(150):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if (not halves or own[a] != own[b]) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                every.append((a, b))
    assert set(map(frozenset, links)) <= set(map(frozenset, every))
    assert merged(links) == merged(every)
    assert len(links) == len(set(comp.tolist())) - len(merged(every))


def test_near_duplicates_defined_cases(spark):
    assert near_dedup.link_classes(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup.link_classes(frame(spark, rows)).collect()), key=repr)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]


def test_registers_merge_and_estimate():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[250:1250]
    ra, rb, ru = (near_dedup.sketches(1, np.zeros(len(x), np.int64), x)[0] for x in (a, b, np.union1d(a, b)))
    assert (np.maximum(ra, rb) == ru).all()
    got = near_dedup.estimate(ra[None], rb[None], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(got - 750 / 1250) < 0.15
    tiny = near_dedup.sketches(2, np.array([1]), np.array([5], np.uint64))
    assert not tiny[0].any() and tiny[1].all()


def test_estimates_are_unbiased():
    rnd = np.random.default_rng(8)
    out = []
    for _ in range(60):
        pool = rnd.integers(0, 2**63, 360).astype(np.uint64)
        r = near_dedup.sketches(2, np.repeat([0, 1], [324, 324]), np.concatenate([pool[:324], pool[36:]]))
        out.append(near_dedup.estimate(r[:1], r[1:], np.array([324.0]), np.array([324.0]))[0])
    assert abs(np.mean(out) - 0.8) < 0.02 and np.std(out) < 0.06


# -- repeated phrases


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        for j in range(len(w) - 12):
            p = tuple(w[j : j + 13])
            first[p] = min(first.get(p, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.choice([12, 13, 14, 40, 90]))] for _ in range(8)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))]
        rows.append((rnd.choice([i, i + 1000]), rnd.choice([" ", "\n", " \t"]).join(w)))
    rows += [(5000, None), (5001, ""), (5002, "the " * 200), (5003, "the " * 40), (None, " ".join(passages[3])), (5004, "é\xa0b " * 20), (5005, "é\xa0b " * 20), (7, rows[3][1]), (7, rows[4][1])]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, rows).repartition(4)).collect()), key=repr)
    assert got == brute_repeats(rows)


def test_one_anchor_in_very_many_segments(spark, monkeypatch):
    """The same five words amid ever different ones, and repeats among them: the anchor is split, nothing is lost."""
    rnd = random.Random(3)
    word = lambda: f"u{rnd.randrange(9000)}"
    core = ["the", "five", "words", "that", "recur"]
    around = [([word() for _ in range(8)], [word() for _ in range(8)]) for _ in range(60)]
    rows = []
    for i in range(300):
        left, right = rnd.choice(around)
        rows.append((i, " ".join([*(word() for _ in range(rnd.randrange(4))), *left, *core, *(right if rnd.random() < 0.5 else rnd.choice(around)[1]), word()])))
    expected = brute_repeats(rows)
    assert sum(n for _, _, n, _ in expected) > 2000
    cuts = []
    single = substrings.single_windows
    monkeypatch.setattr(substrings, "SHARD", 1)
    monkeypatch.setattr(substrings, "single_windows", lambda *args: cuts.append(1) or single(*args))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, rows).repartition(4)).collect()), key=repr)
    assert got == expected and cuts


def test_least_ids_against_a_dictionary():
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.choice([3, 13, 20, 60]))) for _ in range(150)]
    ids = [rnd.randrange(1000) for _ in texts]
    least = {}
    for t, i in zip(texts, ids):
        w = t.split(" ")
        for j in range(len(w) - 12):
            p = tuple(w[j : j + 13])
            least[p] = min(least.get(p, i), i)
    assert substrings.least_ids(texts, ids) == [[least[tuple(w[j : j + 13])] for j in range(len(w) - 12)] for w in (t.split(" ") for t in texts)]
    assert substrings.least_ids([], []) == []


def test_repeats_spans_and_empty(spark):
    p = " ".join(f"p{i}" for i in range(15))
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, [(1, p), (2, f"a {p} b {p}")])).collect()}
    assert got[1].spans == [] and got[2].spans == [1, 16, 17, 32] and got[2].kept == "a b"
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


# -- fingerprints


def brute_fingerprints(spark, rows):
    order = sorted(set(rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), 0))
    following = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    out = []
    for r in rows:
        text, after = r[1] or "", following[r][1] or ""
        m = len(text) // 3
        out.append((r[0], len(text), hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(spark):
    rnd = random.Random(5)
    rows = [(i * 7, "é" * rnd.randint(0, 9) + " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(1, None), (2, ""), (3, "xyz"), (None, "no id at all")]
    got = fingerprints.compare_with_successors(frame(spark, rows).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute_fingerprints(spark, rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    again = fingerprints.compare_with_successors(frame(spark, rows + rows[:3])).collect()
    assert len(again) == len(rows) + 3
    one = fingerprints.compare_with_successors(frame(spark, [(1, "abc def ghi")])).first()
    assert one.next_id == 1 and one.near_next == 1.0
    assert fingerprints.compare_with_successors(frame(spark, [])).count() == 0


def own_sketch(text):
    """Sketch and hash of the word sequence with the public xxhash, chained as Spark chains columns and arrays."""
    import struct

    import xxhash

    def chained(numbers):
        h = 42
        for x in numbers:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return h - (1 << 64) if h >> 63 else h

    w = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(x, 42)))[0] for x in words(text)]
    k = fingerprints.WORDS
    every = [chained(w[i : i + k]) for i in range(len(w) - k + 1)] or ([chained(w)] if w else [])
    top = -(1 << 63) + int(fingerprints.FRACTION * (1 << 64))
    return sorted({h for h in every if h < top}), chained(w)


def test_fingerprints_against_an_independent_sketch(spark):
    rnd = random.Random(15)
    rows = [(i * 3, " ".join(rnd.choice(["ah", "b", "cé", "d", "e"]) for _ in range(rnd.choice([0, 2, 6, 30, 90])))) for i in range(50)] + [(1, None), (4, "")]
    rows += [(1000, rows[5][1]), (1003, rows[5][1])]
    after = sorted(rows, reverse=True)
    texts = {i: t or "" for i, t in rows}
    follows = {i: texts[after[(at + 1) % len(after)][0]] for at, (i, _) in enumerate(after)}

    def name(sketch):
        found, sequence = sketch
        return ",".join(f"{h & (1 << 64) - 1:X}" for h in found) if found else f"={sequence & (1 << 64) - 1:X}"

    def near(a, b):
        x, y = set(a[0]), set(b[0])
        return len(x & y) / len(x | y) if x and y else float(not x and not y and a[1] == b[1])

    got = {r.doc_id: r for r in fingerprints.compare_with_successors(frame(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, t in texts.items():
        m = len(t) // 3
        own, edited, other = own_sketch(t), own_sketch(t[: len(t) - m] + follows[i][:m]), own_sketch(follows[i])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (name(own), name(edited))
        assert got[i].near_edited == pytest.approx(near(own, edited)) and got[i].near_next == pytest.approx(near(own, other))


def test_sketches_estimate_likeness_and_containment(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(4000)]
    texts = [(0, " ".join(base)), (1, " ".join(base[:3000] + [f"z{i}" for i in range(1000)])), (2, " ".join(base[:400])), (3, " ".join(base))]
    df = fingerprints.sketched(frame(spark, texts), "text", "sk", "sq")
    a, b, c, d = df.orderBy("doc_id").collect()
    assert a.sk == d.sk and a.sk == sorted(set(a.sk))
    j = len(set(a.sk) & set(b.sk)) / len(set(a.sk) | set(b.sk))
    assert abs(j - 3000 / 5000) < 0.08
    assert len(set(c.sk) - set(a.sk)) == 0
    assert abs(len(a.sk) / 3996 - fingerprints.FRACTION) < 0.03
    whole = fingerprints.merge(df.where("doc_id IN (1, 2)").withColumn("g", F.lit(1)), "sk", "g").first()
    assert whole.sk == sorted(set(b.sk) | set(c.sk))


def test_sketches_of_short_texts(spark):
    """Texts of 12 words have 8 shingles: 0.75 ** 8, a tenth, have no sketch (a third at a fraction of 1/8)."""
    rnd = random.Random(5)
    df = fingerprints.sketched(frame(spark, [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(12))) for i in range(1000)]), "text", "sk", "sq")
    assert 0.06 < df.where("size(sk) = 0").count() / 1000 < 0.15


# -- archives


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"https://h/{i}", f"<p>{'page ' * 20}{i % 7}</p>" + "é" * i) for i in range(60)]
    rows += [(100 + i, None, "<p>same</p>") for i in range(9)] + [(200, "http://x\r\ny", None), (201, "u", ""), (None, "n", "<p>same</p>"), (300, "big", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "extra", "digest") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(4)
    archives = warc.write(df, f"file://{tmp_path}/a")
    got = {r.page_id: r for r in warc.read(archives).collect()}
    assert len(got) == len(rows) and all(r.intact for r in got.values())
    groups = {}
    for i, _, h in rows:
        if i is not None:
            groups.setdefault(h or "", []).append(i)
    for i, u, h in rows:
        data = (h or "").encode()
        r = got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = i if i is None else max(groups[h or ""])
        assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
        assert r.payload == ((h or "") if i == top else None)
        assert r.url == (u if u and "\r" not in u else None)
    none = warc.write(df.limit(0), f"file://{tmp_path}/b")
    assert none.count() == 0 and warc.read(none).count() == 0
    assert {r.record_type for r in warc.read(warc.write(df, f"file://{tmp_path}/c", least=10**6)).collect()} == {"response"}


@pytest.mark.parametrize(
    "rows, records",
    [
        ([(1, "A"), (1, "B"), (2, "A")], [(1, "B", None), (1, None, 2), (2, "A", None)]),
        ([(1, "A"), (1, "B"), (2, "A"), (3, "B")], [(1, None, 2), (1, None, 3), (2, "A", None), (3, "B", None)]),
        ([(1, "A"), (1, "A"), (1, "A")], [(1, "A", None)] * 3),
        ([(1, "A"), (1, "A"), (2, "A"), (2, "A")], [(1, None, 2), (1, None, 2), (2, "A", None), (2, "A", None)]),
    ],
)
def test_archives_of_repeated_ids(spark, tmp_path, rows, records):
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.payload, r.refers_to) for r in warc.read(warc.write(df, f"file://{tmp_path}/a")).collect()]
    assert sorted(got, key=repr) == sorted(records, key=repr)


def test_archives_of_one_hot_payload(spark, tmp_path):
    """A third of all pages are equal: their group is broadcast, the records are whole."""
    rows = [(i, "u", "hot" if i % 3 == 0 else f"page {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.read(warc.write(df, f"file://{tmp_path}/a")).collect()
    assert len(got) == 4000
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(i, 3999) for i in range(0, 3999, 3)}


def test_archive_layout():
    dictionary = warc.train_dictionary([f"<html>{'abc def ' * 50}{i}</html>".encode() * 20 for i in range(60)])
    out = io.BytesIO()
    w = warc.Writer(out, dictionary)
    at = []
    for i in range(5):
        at.append(w.size)
        w.add(warc.record(i, None, f"<html>{i}</html>".encode(), None))
    data = out.getvalue()
    assert data[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(data[4:8], "little") == len(dictionary)
    import zstandard

    # each record is a frame of its own
    frame_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(data[at[3] : at[4]])
    assert b"X-Page-ID: 3" in frame_
    assert [b for _, b in warc.read_records(io.BytesIO(data))] == [f"<html>{i}</html>".encode() for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"\0" * 20)))


# -- pages


def page(body, title="T"):
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        f"<!-- c --><div class='ad'>Buy</div><article><h1>{title}</h1>{body}<div class='share'>Share</div></article><aside>Side</aside><div id=comments><p>First!</p></div><form>Mail <input></form><footer>&copy; us</footer></body></html>"
    )


def test_extraction():
    html = page("<p>One  two\n three &amp; <b>four</b>.<br>five</p>six<p>se&#118;en <i>eight</i><p>nine")
    assert html_extract.extract(html) == "T\nOne two three & four. five\nsix\nseven eight\nnine"
    assert html_extract.extract("") == ""
    assert html_extract.extract("<p>open <b>tag") == "open tag"
    assert html_extract.extract("<script>never closed <p>x</p>") == ""
    assert html_extract.extract("a < b and c") == "a < b and c"
    assert html_extract.extract("<!-- open <p>x</p>") == ""
    assert html_extract.extract("plain &lt;p&gt; text") == "plain <p> text"
    assert html_extract.extract("<main><p>x</p></main><p>outside</p>") == "x"
    assert html_extract.extract("<article><header><h1>Title</h1></header><p>b</p></article>") == "Title\nb"


def test_templates_of_div_pages(spark):
    """No semantic elements: the slots' texts decide."""

    def div_page(i):
        links = "".join(f"<a href='/{k}'>Link number {k} of the long list</a> " for k in range(6))
        return f"<html><body><div>{links}</div><div>Welcome to our site, dear reader of pages</div><div>{f'Sentence {i} of a long story about things. ' * 6}</div><div>Tiny {i}</div></body></html>"

    rows = [(i, "http://h.example/x", div_page(i)) for i in range(12)] + [(50, "http://other.example/", page("<p>alone</p>")), (51, None, None), (52, "odd url", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    for i in range(12):
        assert got[i].text == (f"Sentence {i} of a long story about things. " * 6).strip()
    assert got[50].text == "T\nalone" and got[51].text == "" and got[52].text == "x"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.main_text(df.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.main_text(df).orderBy("page_id").collect()]


def story(i, k):
    return f"Part {k} of story {i} tells of a long walk through number {i * 31 + k}."


def test_slots_hold_all_paragraphs(spark):
    """A div of a heading and several paragraphs is one slot, judged by all of its text."""
    links = "".join(f"<a href='/{k}'>Link number {k} of the long list</a> " for k in range(6))
    pages = [f"<html><body><div>{links}</div><div><h1>Tale {i}</h1>{''.join(f'<p>{story(i, k)}</p>' for k in range(2 + i % 3))}</div><div>Tiny {i}</div></body></html>" for i in range(6)]
    assert extracted(spark, pages) == ["\n".join([f"Tale {i}", *(story(i, k) for k in range(2 + i % 3))]) for i in range(6)]


def test_layouts_of_one_host(spark):
    """Two div layouts, a page with an article, fragments and a page without its content container share a host."""
    menu = "".join(f"<a href='/{k}'>Link number {k} of the long list</a> " for k in range(6))
    body = lambda i: f"<h2>Tale {i}</h2>" + "".join(f"<p>{story(i, k)}</p>" for k in range(2 + i % 3))
    text = lambda i: "\n".join([f"Tale {i}", *(story(i, k) for k in range(2 + i % 3))])
    head = "<html><head><title>Site</title></head><body>"
    pages = [f"{head}<div>{menu}</div><div>{body(i)}</div></body></html>" for i in range(5)]
    pages += [f"{head}<section><ul><li>{menu}</li></ul></section><section>{body(i)}</section></body></html>" for i in range(5, 9)]
    pages += [f"{head}<div>{menu}</div><article>{body(9)}</article></body></html>", f"<p>{story(10, 0)}</p>", f"{head}{body(11)}</body></html>"]
    pages += [f"{head}<div>{menu}</div><div>{body(12)}</div><div>{body(13)}</div></body></html>"]
    assert extracted(spark, pages) == [*(text(i) for i in range(10)), story(10, 0), text(11), f"{text(12)}\n{text(13)}"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div class='page has-sidebar'><article><p>x</p></article></div>", "x"),
        ("<div class='page has-sidebar'><p>x</p></div>", "x"),
        ("<div class='page sidebar'><article><p>x</p></article></div>", "x"),
        ("<div class='search-results-page'><article><p>x</p></article></div>", "x"),
        ("<form id='aspnetForm'><article><p>x</p></article></form>", "x"),
        ("<body><form id='aspnetForm'><div><p>x</p></div></form></body>", "x"),
        ("<article><header class='entry-header'><h1>T</h1></header><p>x</p></article>", "T\nx"),
        ("<article><div class='header'><h1>T</h1></div><p>x</p></article>", "T\nx"),
        ("<article><div class='notice-of-intent'><p>x</p></div></article>", "x"),
        ("<nav class='main-nav'><a href='/'>Home</a></nav><div><p>x</p></div>", "x"),
        ("<div class='main-column'><p>x</p></div><p>y</p>", "x\ny"),
        ("<div id='main'><p>x</p></div><p>y</p>", "x"),
        ("<div role='main'><p>x</p></div><p>y</p>", "x"),
        ("<article><p class='advert'>Buy</p><p>x</p></article>", "x"),
        ("<article><p class='advert'>Buy<p>x</article>", "x"),
        ("<article><p>x <span class='notice'>Mind <span>the</span> gap</span> y</p></article>", "x y"),
        ("<article><h3 class='promo'>Buy</h3><p>x</p></article>", "x"),
        ("<article><div class='share-buttons'>Share</div><p>x</p></article>", "x"),
        ("<article><p>x</p></article><section class='comments'><article><p>First!</p></article></section>", "x"),
        ("<aside><article><p>card</p></article></aside><article><p>x</p></article>", "x"),
        ("<div><p>x</p></div><section class='comments'><article><p>First!</p></article></section>", "x"),
        ("<div class='site-footer'>us</div><p>x</p>", "x"),
    ],
)
def test_names(html, text):
    assert html_extract.extract(html) == text


def test_host_of_articles_with_a_page_without(spark):
    pages = [f"<html><head><title>t</title></head><body><article><p>{story(i, 0)}</p></article></body></html>" for i in range(4)] + [f"<div><p>{story(4, 0)}</p></div>"]
    assert extracted(spark, pages) == [story(i, 0) for i in range(5)]


def test_template_inside_articles(spark):
    """Lines that all articles of a host repeat and lists of links inside them go; copies, short texts and articles of links stay."""
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{k}'>Another tale {n * 7 + k}</a></li>" for k in range(2 + n % 3)) + "</ul>"
    body = lambda i: f"<h1>Tale {i}</h1>" + "".join(f"<p>{story(i, k)}</p>" for k in range(4 + i % 3))
    text = lambda i: "\n".join([f"Tale {i}", *(story(i, k) for k in range(4 + i % 3))])
    around = lambda inside: f"<html><head><title>Site</title></head><body><article>{inside}</article></body></html>"
    pages = [around(f"{body(i)}{links(i)}<p>Write to us for more tales.</p>") for i in range(6)]
    assert extracted(spark, pages) == [text(i) for i in range(6)]
    assert extracted(spark, [around(body(1))] * 4) == [text(1)] * 4
    assert all(extracted(spark, [around(links(i)) for i in range(5)]))


def test_records_nest_in_slots(spark):
    """Links and paragraphs in one div: each class of records decides for itself; inline tags make no records."""
    items = lambda i: "".join(f"<dt><a href='/{k}'>Link number {k} of page {i} in a long list of links to other tales</a></dt>" for k in range(3 + i % 2))
    paragraphs = lambda i: [f"{i}.{k}: {story(i, k)}" for k in range(2 + i % 3)]
    pages = [f"<html><body><div>{items(i)}{''.join(f'<p><b>{p[:3]}</b>{p[3:]}</p>' for p in paragraphs(i))}</div></body></html>" for i in range(6)]
    assert extracted(spark, pages) == ["\n".join(paragraphs(i)) for i in range(6)]


@pytest.mark.parametrize("seed", range(4))
def test_planted_texts_of_class_free_templates(spark, seed):
    """Generated layouts of bare divs: banner, menu, teasers and footer around the planted text, in any order and nesting."""
    rnd = random.Random(seed)
    links = lambda n: "".join(f"<a href='/{rnd.randrange(999)}'>Tale {rnd.randrange(999)} of a long list</a> " for _ in range(n))
    order = rnd.sample(["banner", "menu", "text", "teasers", "footer"], 5)
    deep = {part: rnd.randint(1, 3) for part in order}
    pages, planted = [], []
    for i in range(12):
        blocks = [f"Tale {i} of host {seed}", *(f"{story(i, k)} {story(i + 50, k)}" for k in range(rnd.randint(2, 6)))]
        parts = {
            "banner": "Stories for long evenings by the fire", "menu": links(6), "teasers": links(rnd.randint(3, 5)), "footer": "All rights are with those who tell the tales",
            "text": f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]),
        }
        pages.append("<html><body>" + "".join("<div>" * deep[x] + parts[x] + "</div>" * deep[x] for x in order) + "</body></html>")
        planted.append("\n".join(blocks))
    assert extracted(spark, pages) == planted
    assert all(html_extract.extract(p) != t for p, t in zip(pages, planted))  # not without the template


def test_equal_pages_count_one_by_one(spark):
    """Rows that repeat whole pages an even number of times leave the vectors of their tokens apart."""
    html = [f"<html><body><div>{''.join(f'<a href=/{k}>Link number {k} of the list</a> ' for k in range(6))}</div><div><h1>Tale {i}</h1><p>{story(i, 0)} {story(i, 1)}</p></div></body></html>" for i in range(4)]
    rows = [(i, "http://h.example/x", h) for i, h in enumerate(html)] * 2
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, f"Tale {i}\n{story(i, 0)} {story(i, 1)}") for i in [*range(4)] * 2)


def test_vectors_merge(spark):
    html = [page(f"<p>{'text ' * i}</p>", f"t{i}") for i in range(1, 9)]
    df = spark.createDataFrame([("h", i, h) for i, h in enumerate(html)], "host string, page long, html string")
    one = sorted(map(str, html_extract.token_counts(df.repartition(1)).collect()))
    assert one == sorted(map(str, html_extract.token_counts(df.repartition(4)).collect()))


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(11)
    plain = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(plain) for _ in range(n))
    rows = [(i, text(rnd.randint(20, 200))) for i in range(120)]
    rows += [(200 + i, text(40) + " nastibum grumblewit") for i in range(40)]
    rows += [(300 + i, rows[0][1]) for i in range(10)] + [(400, " ".join(["changed", *rows[1][1].split()[1:]]) + " end"), (401, None), (402, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 2), int(200 <= i < 240)) for i, _ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    df, seen = docs, {}
    for name, stage in cp.STAGES:
        df = stage(spark, df, str(tmp_path)).persist()
        seen[name] = df
        if name != "packing":
            assert df.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items() if n != "packing"}
    assert not ids["toxicity"] & set(range(200, 240)) and set(range(120)) <= ids["toxicity"]
    assert not ids["exact_dedup"] & {*range(300, 310), 402} and set(range(120)) <= ids["exact_dedup"]
    assert ids["toxicity"] - ids["exact_dedup"] == {*range(300, 310), 402}
    assert ids["mixing"] == ids["near_dedup"]
    n_words = sum(len((r.text or "").split()) for r in seen["mixing"].select("text").collect())
    assert seen["packing"].agg(F.sum("n_used")).first()[0] == n_words
    assert cp.run(spark, str(tmp_path)).agg(F.sum("n_used")).first()[0] == n_words
