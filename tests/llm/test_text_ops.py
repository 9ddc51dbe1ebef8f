"""Quality, toxicity, near-duplicates, language, shards, fingerprints: brute force on small tables and odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import common as C
from reviewlens.llm import graph, queries
from reviewlens.llm import op1_toxicity as P1
from reviewlens.llm import op2_minhash as P2
from reviewlens.llm import op3_language as P3
from reviewlens.llm import op4_sharding as P4
from reviewlens.llm import op6_fingerprints as P6
from reviewlens.llm import op8_quality as P8

from .conftest import SF


def words_of(text):
    return re.findall("[^ \t\n\x0b\x0c\r]+", text or "")


# ---------------------------------------------------------------- quality


def brute_quality(text):
    ws = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    covered = {p for i in range(len(ws) - 7) if windows[tuple(ws[i:i + 8])] > 1 for p in range(i, i + 8)}
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark, odd, odd_rows, empty):
    extra = [(90, "a b c d e f g h " * 3 + "tail " * 12), (91, "one\ntwo\none\n \n\none\ntwo three"), (92, "😀 x" * 30), (93, "a\x1fb\x85c d")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for table, rows in ((odd, [(r[0], r[1]) for r in odd_rows]), (more, extra)):
        found = P8.quality(table).collect()
        assert sorted((r.doc_id, *(r[c] for c in names)) for r in found) == sorted((d, *brute_quality(t)) for d, t in rows)
        assert not any(r.kept for r in found if r.base_failed)
    assert P8.quality(empty).count() == 0
    assert P8.quality(odd.withColumn("n_words", odd.n)).filter("n_words is null or n_words < 0").count() == 0


def test_quality_runs_no_python(spark, small):
    plan = P8.quality(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_can_be_filtered(spark, small):
    """A condition on the verdict stays above the projections that compute the measures once."""
    kept = P8.quality(small).filter("kept").select("doc_id")
    assert len(kept._jdf.queryExecution().executedPlan().toString()) < 60_000
    began = time.monotonic()
    found = {r.doc_id for r in kept.collect()}
    assert time.monotonic() - began < 90
    assert found == {r.doc_id for r in P8.quality(small).collect() if r.kept}


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert not any(r.kept for r in rows if r.quality == 0)


# ---------------------------------------------------------------- near-duplicates


def brute_groups(rows, width, percent):
    sets = []
    for _, text in rows:
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
        sets.append({tuple(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same_id = False
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) or same_id:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows():
    """A large group of near copies, chains of links, shared passages, short texts and copies."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # near copies of one text
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append(" ".join(own))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for i in range(12):  # each links with the next ones only
        chain = chain[9:] + [rng.choice(vocabulary) for _ in range(9)]
        rows.append(" ".join(chain))
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(30)]) for _ in range(60)]
    rows += ["short text", "Short TEXT", "short", "", " ", None, "a b c", "a b c d", "É b c d", "é b c d"] + rows[:5]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(d, rows[k]) for d, k in enumerate(order)]


@pytest.mark.parametrize("width,percent", [(4, 80), (5, 80), (3, 90)])
def test_groups_equal_brute_force(spark, width, percent):
    rows = near_rows()
    found = P2.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, percent).collect()
    assert sorted(map(tuple, found)) == brute_groups(rows, width, percent)


def test_links_among_many_variants_of_one_text(spark):
    """Pairs that share only the common text lie in tables with half of all rows and are each linked with one row only."""
    base = [f"w{i}" for i in range(200)]
    places = [(s, t) for s in range(4, 192, 4) for t in range(s + 12, 192, 4)][:900]
    rows = []
    for i, (s, t) in enumerate(places):
        for side in range(2):
            words = list(base)
            for at in (s, t):
                words[at:at + 7] = [f"p{i}x{side}y{at + k}" for k in range(7)]
            rows.append((side * 10_000 + (i * 7919) % 9973, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = P2.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 10_000 for i, _ in rows}


def test_groups_of_odd_rows(spark, odd, odd_rows, empty):
    found = P2.near_duplicates(odd).collect()
    assert sorted(map(tuple, found)) == brute_groups([(r[0], r[1]) for r in odd_rows], 4, 80)
    assert P2.near_duplicates(empty).count() == 0


def test_one_id_with_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, "something else altogether here now"), (2, text + " x"), (3, "something else altogether here now")]
    found = P2.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == 1 for r in found) and len(found) == 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}
    for a, b in edges:
        x, y = a, b
        while parent.setdefault(x, x) != x:
            x = parent[x]
        while parent.setdefault(y, y) != y:
            y = parent[y]
        parent[max(x, y)] = min(x, y)

    def top(x):
        return x if parent[x] == x else top(parent[x])

    want = {x: top(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == want and len(found) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_of_neighbours(spark, odd, odd_rows, empty):
    rows = sorted(((r[0], r[1] or "") for r in odd_rows))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = P6.edited(text, after)
        n = len(text) // 4
        assert changed == text[:len(text) - n] + after[:n]
        own, new, other = (P6.fingerprints([t]) for t in (text, changed, after))
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), P6.as_text(*own)[0], P6.as_text(*new)[0],
                     round(float(P6.likeness(own, new)[0]), 9), round(float(P6.likeness(own, other)[0]), 9)))
    found = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in P6.fingerprint_documents(odd).collect()]
    assert sorted(found) == sorted(want)
    assert P6.fingerprint_documents(empty).count() == 0
    alone = P6.fingerprint_documents(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_likeness_estimates_jaccard():
    rng = random.Random(0)
    errors = []
    for _ in range(120):
        n = rng.choice([12, 40, 200, 800])
        a = [f"w{rng.randrange(5000)}" for _ in range(n)]
        k = rng.randint(0, n // 3)
        b = a[:n - k] + [f"w{rng.randrange(5000)}" for _ in range(k)]
        x, y = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        estimate = P6.likeness(P6.fingerprints([" ".join(a)]), P6.fingerprints([" ".join(b)]))[0]
        errors.append(estimate - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_densification_fills_every_bin():
    hashes = C.mix(np.arange(3, dtype=np.uint64))
    assert (P6.densified(hashes, np.array([0, 1, 3])) != P6._EMPTY).all()


# ---------------------------------------------------------------- shards


def test_curve_visits_all_cells_by_single_steps():
    for n, bits in ((2, 1), (2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * n, indexing="ij")).reshape(n, -1)
        index = P4.hilbert_index(cells, bits)
        assert sorted(index) == list(range(1 << (bits * n)))
        assert (np.abs(np.diff(cells[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, odd, odd_rows, empty, small):
    for table, rows in ((odd, [(r[0], r[1]) for r in odd_rows]), (small, [(r.doc_id, r.text) for r in small.collect()])):
        found = P4.write_shards(table, C.new_path(spark, "shards"), 16).collect()
        sizes = Counter(r["shard"] for r in found)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
        for s, n in sizes.items():
            assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))
        assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(rows, key=str)
    assert P4.write_shards(empty, C.new_path(spark, "shards")).count() == 0
    rows = queries.QUERIES["op4_hilbert_shards"](spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in small.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}


def test_shards_prune_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P4.write_shards(docs, C.new_path(spark, "shards"))
    per_shard = rows.selectExpr("shard", "source").distinct().groupBy("shard").count().collect()
    assert np.mean([r["count"] for r in per_shard]) < 13  # of 20 sources


# ---------------------------------------------------------------- language and toxicity


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == 1000
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, empty):
    learnable = odd.selectExpr("cast(doc_id as string) as key", "text", "lang")
    found = P3.predict(odd, P3.fit(learnable)).collect()
    assert len(found) == odd.count()
    for r in found:
        assert (r.lang_pred == "und" and r.score == 0) if r.doc_id in (40, 41, 42) else (r.lang_pred in ("de", "en") and 0 < r.score <= 1)
    nothing = P3.predict(odd, P3.fit(learnable.filter("false"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert P3.predict(empty, P3.fit(learnable)).count() == 0


def test_ngrams_of_long_texts_do_not_depend_on_pieces():
    text = "Ab cd, é. " * 300_000
    short, _ = P3.ngram_counts(["Ab cd, é. " * 3])
    counts, lettered = P3.ngram_counts([text, "12 %", ""])
    assert lettered.tolist() == [True, False, False] and set(np.flatnonzero(counts[0])) == set(np.flatnonzero(short[0]))


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op1_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    assert hit > 0.85 and wrong < 0.04 and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_gradients():
    network = P1.Network()
    network.p = {k: v.astype(float) for k, v in network.p.items()}
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 4) for _ in range(n)) for n in (3, 40, 70)]
    features, group, row_at = P1.split(*C.text_bytes(pa.array(texts)))
    rows, starts, counts = P1.windows_of(row_at)
    index = group[np.minimum(starts[:, None] + np.arange(P1.WINDOW), len(group) - 1)]
    target, weight = (rows % 2).astype(float), np.full(len(rows), 1 / len(rows))

    def loss():
        p = 1 / (1 + np.exp(-network.score(features, index, counts).astype(float)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    for name, g in network.gradients(features, index, counts, target, weight).items():
        at = int(np.abs(g).argmax())
        kept = network.p[name].flat[at]
        network.p[name].flat[at] = kept + 1e-3
        above = loss()
        network.p[name].flat[at] = kept - 1e-3
        below = loss()
        network.p[name].flat[at] = kept
        assert abs((above - below) / 2e-3 - g.flat[at]) < 1e-4 + 0.02 * abs(g.flat[at]), name


def test_windows_cover_all_words():
    for n in (1, 31, 32, 33, 48, 49, 500):
        starts = P1.window_starts(n)
        assert {p for s in starts for p in range(s, min(s + P1.WINDOW, n))} == set(range(n)) and len(set(starts)) == len(starts)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for model in (P1.fit(odd, labels), P1.fit(odd, labels.filter("toxic = 0")), P1.fit(empty, labels)):
        found = P1.score(odd, model).collect()
        assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
        assert {r["score"] for r in found if r.doc_id in (40, 41, 42)} == {0.0}
        assert len({r["score"] for r in found if r.doc_id in (3, 45)}) == 1
        assert P1.score(empty, model).count() == 0


# ---------------------------------------------------------------- whole pipeline


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in P8.quality(docs).filter("kept").select("doc_id").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    sample = sorted(((zlib.crc32(str(d).encode()), d, t) for d, t in rows
                     if d in marked and zlib.crc32(str(d).encode()) % 4 != 2 and 0 < len(t) <= P1.SAMPLE_CHARS))
    model = P1.train([t for _, _, t in sample], np.array([marked[d] for _, d, _ in sample]))
    scores = np.concatenate([v for _, v in model.scores(pa.array([t for _, t in rows]))])
    rows = [r for r, s in zip(rows, scores) if s < P1.THRESHOLD]
    groups = brute_groups(rows, 5, 80)
    rows = [r for r in rows if (r[0]) in {d for d, _, c in groups if d == c}]
    found = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} == {d for d, _ in rows} and len(rows) > 300
    assert sum(r.length for r in found) > 0 and {r.piece for r in found} >= {0}


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars", "n", "base", "_part", "_rank", "_at", "_curve", "_doc", "_shard", "a.b"]
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i, *[i * 10 + k for k in range(9)]) for i in range(40)]
    found = P4.write_shards(spark.createDataFrame(rows, names), f"{tmp_path}/shards")
    assert set(found.columns) == {*names, "shard", "slot"}
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == rows
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and found.groupBy("shard").agg({"slot": "max"}).filter("`max(slot)` > 2").count() == 0


def test_dedup_goes_by_texts_not_ids(spark):
    """An id with two unrelated texts, and copies without an id: one row of each group of texts stays."""
    import corpus_pipeline as pipeline

    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " x"), (None, three), (None, three), (None, three + " x"), (5, one)]
    found = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in found) == [(0, "c"), (1, "a"), (1, "b")]


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        for table in (odd, empty):
            found = stage(spark, table, str(tmp_path))
            n = found.count()
            assert (n == 0) == (table is empty)
            if name != "packing":
                assert found.dtypes == table.dtypes
                assert found.exceptAll(table).count() == 0
