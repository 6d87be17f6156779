"""Near-duplicate operators, components and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from panelgrid.llm import embedding_dedup, linking, minhash, quality, shingles, substring_dedup, toxicity
from panelgrid.llm.common import read_table, stored
from panelgrid.llm.components import components
from tests.conftest import SF_SMALL


def groups(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def near_texts():
    rng = random.Random(11)
    words = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 30, 120, 400]))] for _ in range(25)]
    out = []
    for k in range(260):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8]) if len(t) > 5 else 0):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((k * 3, rng.choice([" ", "  ", "\n"]).join(t)))
    return out + [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (5005, "one two three four"), (5006, "w " * 30000)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, monkeypatch, percent):
    monkeypatch.setattr(linking, "BLOCK_NODES", 6)  # so that clusters take several blocks
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS kept", "2 AS cluster")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, percent).collect()}
    sets = {i: sets_of(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(ids, links)
    assert len(set(want.values())) < len(ids) - 50
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(7, text), (7, text), (9, text.upper()), (None, text), (None, None), (7, "another text of one id")]
    got = sorted(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(7, 7, True)] * 3 + [(9, 7, False)]
    assert all(r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, 4000, np.uint64)
    limit = shingles.most_odd_bits(0.85, minhash.SAMPLES, minhash.BITS)
    for similarity, within in ((0.95, True), (0.85, True), (0.3, False)):
        common = int(4000 * 2 * similarity / (1 + similarity))
        b = np.concatenate([a[:common], rng.integers(0, 1 << 32, 4000 - common, np.uint64)])
        h = shingles.mix64(np.concatenate([a, b]))
        sketch = shingles.odd_sketch(shingles.minhash(h, np.repeat([0, 1], 4000), 2, minhash.SAMPLES), minhash.BITS)
        assert (np.unpackbits(sketch[0] ^ sketch[1]).sum() <= limit) == within


def passage_docs():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "tu", "ser"]) for _ in range(rng.randint(1, 4)))

    def sentence(n):
        return " ".join([word().capitalize(), *(word() for _ in range(n - 1))]) + "."

    passage = " ".join(sentence(15) for _ in range(4))
    changed = passage.split()
    long_line = sentence(90)
    near_line = long_line.split()
    near_line[45] = "other"
    changed[7] = "changed"
    docs = {k: "\n".join(" ".join(sentence(rng.randint(8, 20)) for _ in range(5)) for _ in range(3)) for k in range(40)}

    def paste(k, text):
        w = docs[k].split(" ")
        at = rng.randrange(5, len(w) - 5)
        docs[k] = " ".join([*w[:at], text, *w[at:]])

    for k in (3, 11, 29):
        paste(k, passage)
    for k in (5, 17):
        docs[k] += "\n" + (long_line if k == 5 else " ".join(near_line))
    for k in (8, 9):
        docs[k] += "\nReleased under the MIT License."
    return docs, passage, long_line, near_line


def test_repeated_passages(spark):
    docs, passage, long_line, near_line = passage_docs()
    rows = [*docs.items(), (100, None), (101, ""), (None, docs[3]), (102, "x" * 50000)]
    frame = spark.createDataFrame([(i, t, "l", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, words string, n_chars long")
    found = {r.doc_id: r for r in substring_dedup.repeats_by_document(frame).collect() if r.doc_id is not None}
    assert {k for k, r in found.items() if not r.kept} == {11, 29, 17}
    assert found[11].first_docs == [3] and found[17].first_docs == [5]
    assert all(found[k].n_words_removed >= 60 for k in (11, 29)) and found[17].n_words_removed == 90
    left = {r.doc_id: r for r in substring_dedup.remove_repeats(frame).collect()}
    assert set(left) == {i for i, _ in rows} and left[3].text == docs[3] and left[None].text == docs[3]
    assert all(left[k].text == t for k, t in rows if k not in (11, 29, 17))
    for k in (11, 29):
        assert passage[:60] not in left[k].text and left[k].n_chars == len(left[k].text)
        assert left[k].text.split() == docs[k].replace(passage, " ").split()
    assert " ".join(near_line) not in left[17].text and left[5].text == docs[5]
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_copies_lose_all(spark):
    docs, *_ = passage_docs()
    frame = spark.createDataFrame([(1, docs[0]), (1, docs[0]), (2, docs[0]), (4, docs[1])], "doc_id long, text string")
    assert sorted(r.doc_id for r in substring_dedup.remove_repeats(frame).collect()) == [1, 1, 4]


def test_paragraphs_do_not_depend_on_what_is_around():
    docs, passage, *_ = passage_docs()
    alone = substring_dedup._fingerprints(*substring_dedup._spans(substring_dedup.paragraphs([passage.encode()])))[0]
    for around in (f"some words {passage} and others", f"Hello.\n{passage}", f"{passage}"):
        there = substring_dedup._fingerprints(*substring_dedup._spans(substring_dedup.paragraphs([b"before", around.encode()])))[0]
        assert set(alone[:-1].tolist()) <= set(there.tolist())


@pytest.mark.parametrize("block", [2048, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, 32))
    rows = []
    for k in range(300):
        x = centre[k % 12] + rng.standard_normal(32) * rng.choice([0.0, 0.08, 0.12, 0.16, 1.0])
        rows.append((k, [float(v) for v in x], k % 3))
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, [], 1), (905, rows[0][1], None),
           (906, [float("inf")] * 32, 0), (None, rows[0][1], 0), (907, rows[0][1][:5], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS n_links")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    want = groups(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert near.sum() > 900
    for k in range(300):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum() - 1, want[k], want[k] == k)
    for i, _, _ in odd:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_any_length(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((6, 16))
    plain = [(k, centre[k % 6] + rng.standard_normal(16) * 0.1, k % 2) for k in range(60)]
    schema = "vec_id long, embedding array<double>, label int"

    def found(scale):
        frame = spark.createDataFrame([(k, [float(v) for v in x * scale(k)], label) for k, x, label in plain], schema)
        return sorted(map(tuple, embedding_dedup.near_duplicates(frame).collect()))

    want = found(lambda k: 1.0)
    assert found(lambda k: 2.0 ** (900 * (k % 3 - 1))) == want and sum(r[1] for r in want) > 0
    ends = [(1, [1e200, 1e200, 0.0], 0), (2, [2e200, 2e200, 0.0], 0), (3, [1e-200, 1e-200, 0.0], 0), (4, [1e308, -1e308, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(ends, schema)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_calibration():
    import math

    count, p = embedding_dedup.calibrated_count(), embedding_dedup.collision_chance()
    below = sum(math.comb(embedding_dedup.TABLES, k) * p ** k * (1 - p) ** (embedding_dedup.TABLES - k) for k in range(count))
    assert below <= embedding_dedup.MISS and count >= 2


def test_pipeline_stages(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF_SMALL), "stage")
        seen.append((name, before, docs))
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
    ids = [({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for _, a, b in seen]
    verdict = {r.doc_id for r in quality.score_quality(seen[0][1]).where("kept").collect()}
    assert ids[0][1] == verdict
    model = toxicity.learn(seen[1][1], read_table(spark, SF_SMALL, "labels"))
    assert ids[1][1] == {r.doc_id for r in toxicity.score(seen[1][1], model).where(f"score < {toxicity.THRESHOLD}").collect()}
    texts = {r.doc_id: sets_of(r.text) for r in seen[2][1].collect()}
    order = sorted(texts)
    links = [(a, b) for k, a in enumerate(order) for b in order[k + 1:] if texts[a] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])]
    assert ids[2][1] == set(groups(order, links).values())
    assert ids[3][1] <= ids[3][0] and ids[4][1] == ids[4][0]


def test_pipeline_on_odd_tables(spark):
    text = " ".join(f"the word{k} of thing{k}" for k in range(40))
    rows = [(1, text, "en", "s", 5, "x"), (1, text, "en", "s", 5, "x"), (2, text, None, None, None, None), (None, text, "en", "s", 5, "x"),
            (3, None, None, None, None, None), (4, "", "en", "s", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF_SMALL), "stage")
        got = [r.doc_id for r in docs.collect()]
        assert sorted(got, key=str) == ([1, None] if some else [])


def test_passages_without_stops_inside_a_line(spark):
    kinds = [lambda d, k: f"{d}wort{k * 7 % 61}", lambda d, k: f"{d.upper()}WORT{k}",
             lambda d, k: f"Haus{d}{k}" if k % 3 == 0 else f"und{d}{k}", lambda d, k: f"शब्द{d}{k}"]
    rows, want = [], {}
    for at, (make, n) in enumerate((m, n) for m in kinds for n in (51, 75, 200)):
        part = lambda d, n, make=make, at=at: " ".join(make(f"{d}{at}x", k) for k in range(n))
        passage = part("p", n)
        rows += [(2 * at, f"{part('a', 33)} {passage} {part('b', 47)}"), (2 * at + 1, f"{part('c', 58)} {passage} {part('d', 21)}")]
        want |= {2 * at: rows[-2][1], 2 * at + 1: f"{part('c', 58)} {part('d', 21)}"}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame).collect()} == want


def test_anchors_depend_on_content_alone():
    rng = random.Random(3)
    run = [f"w{rng.randrange(500)}" for _ in range(50)]
    for _ in range(40):
        texts = [" ".join([f"{d}{rng.random()}" for _ in range(rng.randrange(60))] + run + [f"{d}{rng.random()}" for _ in range(9)]) for d in "ab"]
        words = substring_dedup._words([t.encode() for t in texts])
        at, h = substring_dedup.anchors(words)
        assert set(h[words.owner[at] == 0]) & set(h[words.owner[at] == 1])


def test_every_word_lies_in_a_paragraph():
    text = "Title\nA line. Then a long enough line of some more words here\n" + "\n".join(f"one two three {k}" for k in range(30)) + "\nend"
    found = substring_dedup.paragraphs([text.encode(), b"", b"two words"])
    covered = [(o, a + k) for o, a, n in zip(found["owner"], found["at"], found["words"], strict=True) for k in range(n)]
    assert covered == [(0, k) for k in range(len(text.split()))] + [(2, 0), (2, 1)]
    assert sum(found["words"] >= substring_dedup.LEAST_WORDS) > 5


def test_passage_of_short_lines(spark):
    lines = [" ".join(f"v{k}x{j}" for j in range(6)) for k in range(100)]
    other = [line if k % 8 else line + " changed" for k, line in enumerate(lines)]  # no 50 words alike
    rows = [(1, "\n".join(lines)), (2, "Another text begins here.\n" + "\n".join(other))]
    found = {r.doc_id: r for r in substring_dedup.repeats_by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].kept and found[2].n_words_removed > 250


def test_short_near_paragraphs(spark):
    rows = []
    for n in (15, 9):
        lines = [" ".join(f"s{n}x{k}y{j}" for j in range(n)) for k in range(6)]
        changed = [line.rsplit(" ", 1)[0] + (" changed" if n > 12 else "") for line in lines]  # Jaccard 10/12, 4/5
        rows += [(n, "\n".join(lines)), (n + 100, "\n".join([f"before{n}", *changed, f"behind{n}"]))]
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {15: rows[0][1], 115: "before15\nbehind15", 9: rows[2][1], 109: "before9\nbehind9"}


def test_tables_of_repeats_go_with_their_last_reader(spark, monkeypatch):
    docs, *_ = passage_docs()
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    alive, seen = {}, {}
    put, drop = substring_dedup.stored_at, substring_dedup.discard

    def stored_at(df, name):
        table, path = put(df, name)
        seen[name] = set(alive.values())
        alive[path] = name
        return table, path

    monkeypatch.setattr(substring_dedup, "stored_at", stored_at)
    monkeypatch.setattr(substring_dedup, "discard", lambda s, path: (alive.pop(path, None), drop(s, path)))
    assert substring_dedup.find_repeats(frame).count() > 0
    assert "paragraphs" not in seen["windows"] and not alive


def test_signatures_go(spark, monkeypatch):
    names, gone = {}, []
    put, drop = minhash.stored_at, minhash.discard

    def stored_at(df, name):
        table, path = put(df, name)
        names[path] = name
        return table, path

    monkeypatch.setattr(minhash, "stored_at", stored_at)
    monkeypatch.setattr(minhash, "discard", lambda s, path: (gone.append(names[path]), drop(s, path)))
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in minhash.near_duplicates(frame).collect()) == [(1, True), (2, False), (3, True)]
    assert sorted(gone) == ["sets", "signatures"]


def test_chains_are_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK_NODES", 4)
    sets = [np.arange(k // 2 * 100, k // 2 * 100 + 20, dtype=np.uint64) for k in range(64)]  # two by two alike
    rows = [(0, k, [k * 10, k * 10 + 10], None, s.tobytes()) for k, s in enumerate(sets)]
    rows = [(c, n, [n // 2 * 10, 1000 + (n + 1) // 2 * 10], b, m) for c, n, _, b, m in rows]  # and each a chain's link
    rows += [(100, 100 + k, [5, 5], None, sets[0].tobytes()) for k in range(9)]  # one key, one cluster
    frame = spark.createDataFrame(rows, "cluster long, node long, keys array<long>, bitmap binary, members binary")
    dealt, _ = linking._dealt(frame)
    assert dealt.where("node < 100").count() <= 2 * 64 and dealt.where("node >= 100").count() == 9 * 3
    links, _ = linking.verified_links(frame, lambda common, a, b: 100 * common >= 80 * (a + b - common), None)
    found = [(r.a, r.b) for r in links.collect()]
    assert groups(range(109), found) == {k: k // 2 * 2 if k < 64 else min(k, 100) for k in range(109)}


def test_sketches_keep_chance_meetings_apart(spark):
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 1 << 32, (400, 12)).astype(np.uint32)
    samples[1::2] = samples[::2]
    samples[1::2, :2] += np.uint32(1)
    sketch = shingles.digit_sketch(samples).tolist()
    least = shingles.least_digits(0.8, 2, 6, 0.003)
    assert least == 5
    # Keys 0 to 99 are of two alike, 100 to 198 of two unlike nodes.
    rows = [(k, k // 2, sketch[k]) for k in range(200)] + [(k, 100 + (k - 200) // 2, sketch[k + 2 * (k % 2) - 1 if 200 < k < 399 else k]) for k in range(201, 399)]
    pairs = {}
    for node, key, sk in rows:
        pairs.setdefault(key, []).append((node, sk))
    alike = lambda a, b: int(shingles.digits_alike(np.array([a]), np.array([b]))[0]) >= least
    want = {n for key, p in pairs.items() if len(p) == 2 and alike(p[0][1], p[1][1]) for n, _ in p}
    ends = [(9000 + k, key, 0) for k, key in enumerate([-1, 10 ** 6])]
    frame = spark.createDataFrame(rows + ends, "node long, key long, sketch long").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.node for r in linking.candidate_clusters(frame, least).collect()}
        all_of = {r.node for r in linking.candidate_clusters(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and len(want) < len(all_of)
