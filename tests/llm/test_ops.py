"""Operators against brute force on small inputs: nulls, empties, long texts, ties, repeats, clashing names."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens import scratch
from tracklens.llm import ann, components, ctw, images, minhash, mixing, packing, pii, queries, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, component string, row long"


def words(n, seed=0):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 500, n))


TEXTS = [
    (1, words(60)), (2, words(60)), (3, words(60) + " tail"), (4, None), (5, ""), (6, " \t\n "), (7, "one two three"), (8, "ONE  two\nthree"), (9, words(20000, 3)), (10, words(20000, 3) + " x"),
    (11, "mail a@b.co or 10.0.0.1 and +1 (743) 555-3824 card 4381893557741609"), (11, "mail a@b.co or 10.0.0.1 and +1 (743) 555-3824 card 4381893557741609"), (None, words(60)), (None, None),
    (12, "é" * 50 + " x@y.zz 999.1.1.1 1.2.3.4.5"), (13, "a" * 100_000), (14, words(30, 9)), (15, words(30, 9) + " one two three four five six seven eight nine ten"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], ["b", "a", None, "é"][k % 4], len(t or ""), -1, 99, "x", 7) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(texts):
    sets, parent = {i: shingles(t) for i, t in texts if i is not None}, {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs, none):
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(TEXTS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == components_of(TEXTS)
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)
    assert minhash.near_duplicates(none).count() == 0


def test_what_is_shuffled_and_not_met_leaves_the_disk(spark):
    def shuffled():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", held))

    def staged(name):
        folder = scratch.run_folder(spark).removeprefix("file://")
        return {d for d, _, _ in os.walk(folder) if os.path.basename(d).startswith(name)}

    texts = [(k, words(60, k // 2) + (f" tail{k}" if k % 2 else "")) for k in range(200)] + [(k, words(50, 7) + words(20, k)) for k in range(200, 260)]
    docs, before, sets = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), shuffled(), staged("sets-")
    found = minhash.near_duplicates(docs)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    #: A last count of rows may leave its few bytes.
    assert len(shuffled() - before) <= 3
    assert staged("sets-") == sets
    assert {r["doc_id"]: r["component_id"] for r in found.collect() if r["doc_id"] < 200} == {k: k - k % 2 for k in range(200)}
    bits, slots = minhash._bitmap(docs.select(F.col("doc_id").alias("id")).where("id % 3 = 0"))
    held = docs.withColumnRenamed("doc_id", "id").select((F.col("id") % 3 == 0).alias("asked"), minhash._id_slot(slots).alias("slot")).collect()
    known = [(r["asked"], bool(bits[r["slot"] >> 3] >> (r["slot"] & 7) & 1)) for r in held]
    assert all(bit for asked, bit in known if asked) and sum(bit for asked, bit in known if not asked) < 20


def test_near_duplicates_of_families(spark):
    """Copies of copies and texts that share a passage: chains that no leader of a bucket sees whole."""
    rng = np.random.default_rng(5)
    base, passage, texts = [f"b{k}" for k in range(120)], " ".join(f"p{k}" for k in range(55)), []
    for k in range(60):
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 6))):
            own[at] = f"e{k}x{at}"
        texts.append((k, " ".join(own)))
    texts += [(100 + k, passage + " " + words(int(rng.integers(5, 30)), 50 + k)) for k in range(40)]
    found = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == components_of(texts)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b = words(80, 1), words(80, 2)
    texts = [(1, a), (1, b), (5, a + " tail"), (6, b + " tail"), (7, words(80, 3))]
    for parts in (1, 3):
        found = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (5, 1), (6, 1), (7, 7)]


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """Large components and strangers that share a rare shingle, with blocks and slices of a few texts."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SERVED", 40)
    rng, texts = np.random.default_rng(8), []
    for base in range(3):
        own = [f"b{base}x{k}" for k in range(60)] + [f"p{k}" for k in range(45)]
        for k in range(25):
            one = list(own)
            for at in rng.integers(0, 105, int(rng.integers(0, 5))):
                one[at] = f"e{base}x{k}x{at}"
            texts.append((100 * base + k, " ".join(one)))
    texts += [(1000 + k, " ".join([f"p{j}" for j in range(45)] + [f"q{k}x{j}" for j in range(4 + k)])) for k in range(12)]
    found = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == components_of(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 200).astype(np.uint64)])
    assert abs((minhash.signature(a, 2048) == minhash.signature(b, 2048)).mean() - 0.5) < 0.06


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (None, 3), (200, 201), (200, 201)], "u long, v long")
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {200: 200, 201: 200}


def test_components_of_scattered_edges(spark, monkeypatch):
    """An ascending path whose edges are joined two at a time, a star, and random pairs."""
    monkeypatch.setattr(components, "EDGES", 2)
    rng = np.random.default_rng(6)
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [tuple(map(int, p)) for p in rng.integers(2000, 2300, (180, 2))]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert found == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_sharding(spark, docs, none):
    rows = sharding.shuffle_into_shards(docs, shards=4, parts=5, blocks=2).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == len(TEXTS) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(4))
    assert Counter(r["text"] for r in rows) == Counter(t for _, t in TEXTS)
    assert sharding.shuffle_into_shards(none).count() == 0
    many = spark.range(4000).withColumnRenamed("id", "doc_id")
    shard = {r["doc_id"]: r["shard"] for r in sharding.shuffle_into_shards(many, shards=4, blocks=3).collect()}
    together = np.mean([shard[k] == shard[k + 1] for k in range(3999)])
    assert abs(together - 0.25) < 0.04 and Counter(shard.values()) == dict.fromkeys(range(4), 1000)


def test_sharding_orders_long_parts_in_ranges(spark, monkeypatch):
    """What one task would order in whole comes in ranges of the hash: still gapless, uniform, and the same again."""
    many = spark.range(3000).selectExpr("if(id < 1000, 7, id) as doc_id", "'x' as text")
    whole = {r["shard"]: [] for r in sharding.shuffle_into_shards(many, shards=4, parts=3, blocks=2).collect()}
    monkeypatch.setattr(sharding, "ROWS", 50)
    rows = sharding.shuffle_into_shards(many, shards=4, parts=3, blocks=2).collect()
    for r in rows:
        whole[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(750)) for s in whole.values()) and sum(r["doc_id"] == 7 for r in rows) == 1000
    copies = Counter(r["shard"] for r in rows if r["doc_id"] == 7)
    assert all(abs(copies[k] - 250) < 60 for k in range(4))
    place = {r["doc_id"]: r["shard"] * 750 + r["slot"] for r in rows if r["doc_id"] != 7}
    order = np.array([place[k] for k in range(1000, 3000)])
    assert abs(np.corrcoef(np.arange(2000), order)[0, 1]) < 0.07


def test_matrix_margins():
    m = sharding.communication_matrix([5, 0, 7, 3], [4, 4, 4, 3], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 7, 3] and m.sum(axis=0).tolist() == [4, 4, 4, 3] and (m >= 0).all()
    big = sharding.communication_matrix([2 * 10**12, 10**12], [10**12] * 3, 1)
    assert big.sum(axis=1).tolist() == [2 * 10**12, 10**12] and big.sum(axis=0).tolist() == [10**12] * 3 and (big >= 0).all()


@pytest.mark.parametrize(("good", "bad", "n"), [(1, 1, 1), (3, 5, 4), (30, 10, 25), (400, 300, 90), (2, 5000, 2500), (40, 9, 48)])
def test_hypergeometric_law(good, bad, n):
    """Draws and the density against the enumerated law."""
    law = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    top = max(law, key=law.get)
    for k, p in law.items():
        assert math.isclose(sharding.log_hypergeometric(k, good, bad, n) - sharding.log_hypergeometric(top, good, bad, n), math.log(p / law[top]), abs_tol=1e-9)
    rng = np.random.default_rng(3)
    seen = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(4000))
    assert set(seen) <= set(law) and all(abs(seen[k] / 4000 - p) < 5 * math.sqrt(p * (1 - p) / 4000) + 1e-9 for k, p in law.items() if p > 1e-3)


def test_hypergeometric_of_large_counts():
    """Beyond any enumeration: mean and spread of the law."""
    rng, good, bad, n = np.random.default_rng(4), 3 * 10**11, 7 * 10**11, 2 * 10**11
    drawn = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
    spread = math.sqrt(n * 0.3 * 0.7 * (1 - n / (good + bad)))
    assert abs(drawn.mean() - n * 0.3) < 4 * spread / math.sqrt(3000) and abs(drawn.std() / spread - 1) < 0.06


def test_matrix_law():
    """The matrix of a shuffle of four rows against all 24 orders."""
    from itertools import permutations

    want = Counter()
    for order in permutations(range(4)):
        want[tuple(tuple(sum(order[r] // 2 == c for r in part) for c in range(2)) for part in ((0, 1, 2), (3,)))] += 1 / 24
    seen = Counter(tuple(map(tuple, sharding.communication_matrix([3, 1], [2, 2], seed).tolist())) for seed in range(3000))
    assert set(seen) == set(want) and all(abs(seen[m] / 3000 - p) < 0.05 for m, p in want.items())


CLASHES = "part rank cell block ends row others key new size whole start turn one n bucket src score threshold rejected lang_ _key _new _doc _hash _spans _read _part _rank spans base terms text_hash".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a column of every name that an operator uses within; values tell their rows."""
    extra = [F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES]
    rows = [(k, f"{words(12, k)} mail k{k}@x.org" if k % 2 else words(9, k), "en", f"s{k % 2}", 5) for k in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *extra).persist()


def test_clashing_names_pass_through(spark, clashing):
    import corpus_pipeline

    spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int").createOrReplaceTempView("clash_labels")
    model = toxicity.train(clashing, spark.table("clash_labels"))
    assert toxicity.score_documents(clashing, model, tuple(clashing.columns)).count() == 12
    results = [sharding.shuffle_into_shards(clashing, 3), pii.sanitise(clashing), mixing.mixed_rows(clashing)]
    results += [corpus_pipeline.drop_near_duplicates(spark, clashing, "")]
    for found in results:
        rows = found.collect()
        assert rows and {r["doc_id"] for r in rows} <= set(range(12)) and set(clashing.columns) <= set(found.columns)
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHES)


def test_values_listed_together_are_one_class(spark):
    """Three copies of a list of 20,000 addresses: pairs of values and words grow with the text, not with its square."""
    listed = " ".join(f"name{k}@list.org word{k}" for k in range(20_000))
    rows = [(k, listed) for k in range(3)] + [(10 + k, words(30, k)) for k in range(60)]
    found = {r["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[k]["base"]) == 20_000 and len(found[k]["terms"]) == 20_000 for k in range(3))
    assert {round(s["disclosure"], 9) for s in found[0]["terms"]} == {1.0} and not found[10]["terms"]


def test_mixing_of_dotted_names(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 7, 8), (2, None, None, None, 9)], "doc_id long, text string, source string, `a.b` int, row int")
    assert sorted((r["doc_id"], r["a.b"], r["row"], r["size"]) for r in mixing.mix(df).collect()) == [(1, 7, 8, 3), (2, None, 9, 0)]
    assert mixing.mixed_rows(df).columns == df.columns


def test_mixing_of_repeated_ids_agrees(spark):
    """Eight texts with one id and with none, dealt differently, give one mix."""
    rows = [(7 if k % 2 else None, words(3 + k, k), "a" if k < 12 else "b") for k in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixes = [sorted((str(r["doc_id"]), r["text"]) for r in mixing.mixed_rows(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert mixes[0] == mixes[1] == mixes[2]


def test_mixing(docs, none):
    found = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(found) == len(TEXTS) and all(r["size"] == size(r["text"]) and r["shard"] == 99 for r in found)
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in found:
        taken = r["whole"] * r["size"] + r["part"]
        assert taken <= 3 * r["size"]
        by[r["source"]] = [by[r["source"]][0] + r["size"], r["target"], by[r["source"]][2] + taken, r["source_size"]]
    order = sorted((s for s in by if s is not None)) + [None]
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(b[0] for b in by.values())
    free, left, target = set(order), total, {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * by[s][0]}
        if not over:
            break
        for s in over:
            target[s], left = 3 * by[s][0], left - 3 * by[s][0]
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s, (own, goal, taken, told) in by.items():
        assert own == told and math.isclose(goal, target[s]) and abs(taken - goal) <= 1
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    mixed = Counter()
    for r in mixing.mixed_rows(docs).collect():
        mixed[r["source"]] += size(r["text"])
    assert all(mixed[s] == by[s][2] for s in by)


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


TRICKY = ["a@b@c.d", "x@y.z_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.004", "4381893557741609 4381-8935-5774-1609", "+1.2.3.4 +49 (030) 123-4567-", "é@a.b a.b@c.d.", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "9" * 50_000, "1 " * 20_000, "a@b.c" * 50, "@" * 9, "+" + "1" * 15, "a" * 3000 + " q@w.er"]


def test_pii_base(spark, docs, none):
    texts = TRICKY + [t for _, t in TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(df).select("doc_id", pii.listed(F.col("base")).alias("base")).collect():
        t = texts[r["doc_id"]] or ""
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, t) if good(kind, m[0]))
        assert r["base"] == ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans), t[:50]
    assert pii.find_spans(docs).count() == len(TEXTS) and pii.find_spans(none).count() == 0


def test_disclosure_query_counts_each_kind(spark, tmp_path):
    """The counts of the query, whose kinds all differ."""
    texts = [*TRICKY, None, "", "a@b.c d@e.f g@h.i 1.2.3.4 5.6.7.8 4381893557741609", "+49 (030) 123-4567 1.2.3.4 999.2.3.4"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op5_disclosure(spark, str(tmp_path)).collect()}
    for n, text in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if good(kind, m[0]))
        assert [found[n][f"n_{kind}"] for kind, _ in KINDS] == [sum(s[1] == k for s in spans) for k in range(len(KINDS))], n
        assert found[n]["base_sha256"] == hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    assert len(found) == len(texts)


def test_pii_of_very_long_texts(spark):
    """A run of a million letters and 100,000 addresses take seconds, not the square of their size."""
    import time

    many = " ".join(f"u{k}@x{k}.org" for k in range(100_000))
    texts = ["a" * 1_000_000 + " q@w.er", "1" * 1_000_000 + " 1.2.3.4", many, "x.y" * 300_000, "a@" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).persist()
    began = time.time()
    found = {r["doc_id"]: r["n"] for r in pii.find_spans(df).select("doc_id", F.size("base").alias("n")).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert found == {0: 1, 1: 1, 2: 100_000, 3: 0, 4: 0} and clean[2] == " ".join(["[EMAIL]"] * 100_000) and clean[0] == "a" * 1_000_000 + " [EMAIL]"
    assert time.time() - began < 90


def test_pii_disclosure_values(spark):
    """Every disclosure recomputed from the definition."""
    rng, texts = np.random.default_rng(12), []
    for k in range(120):
        t = [f"t{x}" * 2 for x in rng.integers(0, 25, 12)]
        for e in rng.choice(6, 2, replace=False):
            if rng.random() < 0.3:
                t += [f"m{e}@x.org"] + ([f"name{e}x"] if rng.random() < 0.9 else [])
        texts.append(" ".join(t))
    sets = [set(t.split()) for t in texts]
    held = [{w for w in s if "@" in w} for s in sets]
    want = {}
    for k, t in enumerate(texts):
        at = 0
        for w in t.split():
            values = []
            for e in held[k] if "@" not in w else ():
                n_e, n_t = sum(e in s for s in sets), sum(w in s for s in sets)
                n_te = sum(e in s and w in s for s in sets)
                if n_te >= pii.SUPPORT and 0 < n_e < 120:
                    values.append(math.log(120 * n_te / (n_t * n_e)) / math.log(120 / n_e))
            if values and max(values) >= pii.GENERALISE:
                want[k, at] = max(values)
            at += len(w) + 1
    found = {(r["doc_id"], s["start"]): s["disclosure"] for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for s in r["terms"]}
    assert want and set(found) == set(want) and all(math.isclose(found[x], want[x], rel_tol=1e-9) for x in want)


def test_pii_disclosure(spark):
    texts = [f"{words(20, k)} contact Zebulon now k{k}@x.org" if k % 4 else words(30, k) for k in range(40)]
    texts += [f"{words(12, 100 + k)} captain Orsino writes boss@y.net often" for k in range(6)]
    df = spark.createDataFrame([(k, t, -5) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]] for r in pii.find_spans(df).collect()}
    assert all({"captain", "Orsino"} <= set(found[k]) for k in range(40, 46)) and all("Zebulon" not in found[k] for k in range(40))
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert all("Orsino" not in clean[k]["text"] and "boss@y.net" not in clean[k]["text"] and "[EMAIL]" in clean[k]["text"] for k in range(40, 46))
    assert clean[0]["text"] == texts[0] and clean[0]["n_chars"] == -5 and clean[41]["n_chars"] == len(clean[41]["text"])


def test_pii_discloses_in_whole_texts(spark):
    """A revealing term goes wherever it stands, also where it is never near the value."""
    texts = [words(60, k) for k in range(60)]
    texts += [f"Quillfeather {words(80, 100 + k)} boss@y.net {words(80, 200 + k)} \uffff (Quillfeather), Quillfeather\uffff" for k in range(5)]
    texts += [f"Quillfeather {words(9, 300)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("boss@y.net" not in clean[k] and "Quillfeather" not in clean[k] for k in range(60, 65))
    for r in pii.find_spans(df).collect():
        held = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]]
        assert sum("Quillfeather" in w for w in held) == (3 if 60 <= r["doc_id"] < 65 else 0)
    assert clean[65] == texts[65]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in TEXTS if i is not None}
    rows = packing.pack(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 4096
    for doc, whole in want.items():
        assert sum(len(x) for _, x, _ in pieces[doc]) == len(whole) * (2 if doc == 11 else 1)
        assert all(whole[4 * a : 4 * a + len(x)] == x and 4 * n == len(whole) for a, x, n in pieces[doc])
        if doc != 11:
            assert b"".join(x for _, x, _ in sorted(pieces[doc])) == whole
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in (sum(k for _, k in s) for s in sequences.values()))
    assert padded <= 0.02 * sum(r["length"] for r in rows)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [1, 7, 127, 128, 1365, 2048, 4095, 4096, 9000, 12289])
def test_cut(n):
    pieces = packing.cut(n)
    assert [a for a, _, _ in pieces] == [0, *np.cumsum([b for _, b, _ in pieces])[:-1].tolist()] and sum(b for _, b, _ in pieces) == n
    assert all(4096 // b == k or 4096 // k == b for _, b, k in pieces)


def test_warc(spark):
    long = "x" * 900 + "é" * 60
    rows = [(1, "http://a/ b\r\nX: y", long, 0), (2, None, long, 0), (3, "u", "short", 0), (4, "u", "short", 0), (5, "u", None, 0), (-6, "u", "", 0), (None, "u", long, 0), (7, "u", "y" * 999, 0), (8, "u", "y" * 999, 0), (9, "u", words(3000), 0), (9, "u", words(3000), 0)]
    found = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    assert Counter(r["page_id"] for r in found) == Counter(r[0] for r in rows)
    for r in found:
        data = payload[r["page_id"]]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if r["page_id"] == 1 else ("response", None))
        assert r["payload"] is None if r["page_id"] == 1 else bytes(r["payload"]) == data
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_dictionary_frame():
    records = [warc._record(k, "u", f"<html>{words(80, k)}</html>".encode(), None, 0) for k in range(200)]
    archive = warc.compress_archive(records)
    assert archive[:4] == b"\x5d\x2a\x4d\x18" and len(list(warc.read_archive(archive))) == 200
    assert len(list(warc.read_archive(warc.compress_archive(records[:1])))) == 1


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 24)).astype(np.float32)
    vectors[500:900] = vectors[500]
    rows = [(k, v.tolist(), "c") for k, v in enumerate(vectors)]
    rows += [(5000, None, "c"), (5001, [0.0] * 24, "c"), (5050, [float("nan")] * 24, "c"), (5100, [1.0, None] + [0.0] * 22, "c"), (5150, [1.0] * 3, "c"), (None, [1.0] * 24, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    found = defaultdict(list)
    for r in sorted(ann.nearest(df, df.where("vec_id % 50 = 0")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    wide = vectors.astype(float)
    unit = wide / np.sqrt((wide**2).sum(axis=1, keepdims=True))
    hits = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        hits += len({i for i, _ in found[q]} & set(best.tolist()))
        assert all(abs(s - score[i]) < 1e-9 for i, s in found[q]) and [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
    assert set(found) == set(range(0, 3000, 50)) and hits >= 0.9 * 300
    assert [i for i, _ in found[550]] == [500, 501, 502, 503, 504]
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.2]), (3, [0.0, 2.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(mixed, mixed.where("vec_id % 50 = 0")).collect()) == [(0, 1, 1), (50, 1, 3), (50, 2, 2)]
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few).count() == 6 and ann.nearest(df.limit(0), df).count() == 0


def test_context_tree(spark, docs, none):
    found = ctw.score(docs, F.col("doc_id") != 9).collect()
    assert len(found) == len(TEXTS)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for i, t in TEXTS if i not in (None, 9) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t)) for i, t in TEXTS}
    for r in found:
        if r["doc_id"] is not None:
            t = tokens(dict(TEXTS)[r["doc_id"]])
            assert math.isclose(r["base_score"], base[r["doc_id"]], rel_tol=1e-9) and r["n_tokens"] == len(t) and r["n_known"] == sum(counts[w] > 0 for w in t) and r["train_tokens"] == total
            assert r["score"] < 0
    assert ctw.score(none, F.lit(True)).count() == 0


def tree_by_recursion(raw):
    """A function (context, byte) -> log10 probability from counted (context bytes, byte), by the definition."""
    nodes, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for (context, byte), n in raw.items():
        for i in range(8):
            node = (1 << i) | (byte >> (8 - i))
            for depth in range(ctw.DEPTH + 1):
                nodes[context[ctw.DEPTH - depth :], node][(byte >> (7 - i)) & 1] += n
                if depth:
                    kids[context[ctw.DEPTH - depth + 1 :], node].add((context[ctw.DEPTH - depth :], node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*nodes[key])
            if len(key[0]) == ctw.DEPTH:
                memo[key] = own, 1.0
            else:
                longer = sum(weighted(k)[0] for k in kids[key])
                memo[key] = math.log(0.5) + np.logaddexp(own, longer), 1 / (1 + math.exp(max(-700, min(700, longer - own))))
        return memo[key]

    def score(context, byte):
        total = 0.0
        for i in range(8):
            node, answer = (1 << i) | (byte >> (8 - i)), None
            for depth in range(ctw.DEPTH, -1, -1):
                key = (context[ctw.DEPTH - depth :], node)
                if key in nodes:
                    one, stay = (nodes[key][1] + 0.5) / (sum(nodes[key]) + 1), weighted(key)[1]
                    answer = one if answer is None else stay * one + (1 - stay) * answer
            answer = 0.5 if answer is None else answer
            total += math.log10(answer if (byte >> (7 - i)) & 1 else 1 - answer)
        return total

    return score


def gram(context, byte):
    return int.from_bytes(context[::-1] + bytes([byte]), "big")


def test_context_tree_matches_recursion_and_is_a_distribution(spark, monkeypatch):
    """Scores of whole texts equal a plain recursion, also where few grams and words fit the tables; probabilities of all bytes add up to one."""
    for name, value in (("GRAMS", 40), ("SLOTS", 16), ("WORDS", 3), ("RUN", 50)):
        monkeypatch.setattr(ctw, name, value)
    texts = [words(40, k) for k in range(6)] + ["", "Ünlike  the\nrest " + words(12, 77)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    raw = Counter()
    grams_of = lambda t: [(d[k : k + ctw.DEPTH], d[k + ctw.DEPTH]) for d in [b"\x00" * ctw.DEPTH + re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()) + b"\xff"] for k in range(len(d) - ctw.DEPTH)]
    for t in texts[:6]:
        raw.update(grams_of(t))
    score = tree_by_recursion(raw)
    for r in ctw.score(df, F.col("doc_id") < 6).collect():
        want = [score(c, b) for c, b in grams_of(texts[r["doc_id"]])]
        assert math.isclose(r["score"], sum(want), rel_tol=1e-9) and math.isclose(r["bits_per_byte"], -sum(want) / len(want) / math.log10(2), rel_tol=1e-9)
    contexts = [b"\x00" * 3 + b" w", b"qqqqq", b"qqw12"]
    rows = [(gram(c, b), raw[c, b], 1) for c in contexts for b in range(256)] + [(gram(c, b), n, n) for (c, b), n in raw.items() if c not in contexts]
    found = {r["key"]: r["score"] for r in ctw.score_grams(spark.createDataFrame(rows, "key long, n long, total long")).collect()}
    assert all(abs(sum(10 ** found[gram(c, b)] for b in range(256)) - 1) < 1e-9 for c in contexts)


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    bad = ["idiot", "scumbag", "loser"]
    rows = []
    for k in range(600):
        t = words(int(rng.integers(8, 60)), k).split()
        toxic = k % 5 == 0
        if toxic:
            for b in rng.choice(bad, 2):
                t.insert(int(rng.integers(0, len(t))), f"{b},")
        rows.append((k, " ".join(t), ["en", "de", None][k % 3], int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    found = {r["doc_id"]: r for r in toxicity.score_documents(df.select("doc_id", "lang", "text"), model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(found[k]["score"] >= 0.5) == (k % 5 == 0) for k in held]) >= 0.95
    odd = toxicity.score_documents(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    same = {r["score"] for r in odd if r["doc_id"] in (4, 5, 6)}
    assert len(same) == 1 and toxicity.score_documents(none, model).count() == 0
    toxicity.score_documents(docs, toxicity.train(none, df.select("doc_id", "toxic").limit(0))).count()


def test_toxicity_calibrates_on_all_labelled_rows(spark, monkeypatch):
    """Rows beyond the fit's sample, and long ones, give each language its cut, at the corpus's share of toxic rows."""
    monkeypatch.setattr(toxicity, "SAMPLE", 80)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60_000)
    rows = []
    for k in range(1200):
        t = words(200 if k % 3 == 1 and k % 2 else 20, k).split() + ["idiot," if k % 5 == 0 else "friend,"]
        rows.append((k, " ".join(t), ["en", "de", "fr"][k % 3], int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen, plain = [], toxicity._best_cut
    monkeypatch.setattr(toxicity, "_best_cut", lambda *a: seen.append(a) or plain(*a))
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert set(model.thresholds) == {"en", "de", "fr"}
    labelled = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert round(sum(seen[0][1])) == sum(r[3] == 0 for r in labelled) and round(sum(seen[0][2])) == sum(r[3] for r in labelled)


def test_toxicity_learns_from_long_texts_and_repeats(spark):
    """Every text is long, and one labelled id occurs often: the fit takes each id once."""
    rows = []
    for k in range(400):
        t = words(4000, k).split()
        if k % 4 == 0:
            for at in range(0, 4000, 400):
                t.insert(at, ["idiot", "scumbag"][at % 2])
        rows += [(k, " ".join(t), "en")] * (30 if k == 1 else 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, toxicity.train(df, labels)).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(found[k] >= 0.5) == (k % 4 == 0) for k in held]) >= 0.9


def test_toxicity_network_against_a_naive_one(monkeypatch):
    """Filters and pooling against loops over words; a training step's gradient against differences."""
    rng = np.random.default_rng(9)
    texts = [b"you idiot, go home", b"", b"a fine day it is", b"idiot"]
    model = toxicity.fit(texts * 4, np.array([1, 0, 0, 1] * 4))
    read = toxicity.read_texts(texts)
    vectors = model.vectors(read.features)
    for k in range(len(texts)):
        own = vectors[read.words[read.starts[k] : read.starts[k + 1]]]
        pooled = []
        for weights in model.filters:
            answers = [sum(own[at + j] @ weights[j] for j in range(len(weights))) for at in range(len(own) - len(weights) + 1)]
            pooled.append(np.max(answers, axis=0))
        logit = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.output + model.offset
        assert math.isclose(float(model.logits(read)[k]), float(logit), rel_tol=1e-4, abs_tol=1e-4)
    assert rng is not None and model.logits(read)[0] > model.logits(read)[2]


def test_images(spark):
    rng = np.random.default_rng(4)
    pictures = [images.render(rng.normal(size=64)) for _ in range(12)]
    rows = [(k, bytearray(images.write_pgm(p)), "x") for k, p in enumerate(pictures)]
    rows += [(100 + k, bytearray(images.write_pgm(images.edited(pictures[k], k % 4))), "x") for k in range(8)]
    rows += [(200, rows[3][1], "x"), (201, None, "x"), (202, bytearray(b""), "x"), (203, bytearray(b"P5 3 3 255 "), "x"), (None, rows[4][1], "x"), (5, rows[5][1], "x")]
    found = images.image_copies(spark.createDataFrame(rows, "image_id long, image binary, class_id string")).collect()
    by = {r["image_id"]: r for r in found}
    assert len(found) == len(rows) and sum(by[100 + k]["class_id"] == k for k in range(8)) >= 7
    assert by[200]["class_id"] == 3 and by[201]["class_id"] == 201 and by[202]["n_links"] == 0 and by[None]["class_id"] is None
    assert all(by[k]["class_id"] == k for k in range(12))
    assert images.image_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_images_against_all_pairs(spark):
    """Of 60 pictures, every fourth an edited copy, the links that comparing all pairs gives; a family of many copies is one class."""
    rng = np.random.default_rng(14)
    pictures = [images.render(rng.normal(size=64)) for _ in range(44)]
    pictures = [images.read_pgm(images.write_pgm(p)) for p in pictures + [images.edited(pictures[k], k % 4) for k in range(16)]]
    described = [images.describe(p) for p in pictures]
    packed = [(np.packbits(t, axis=1).view(np.int64), images.pack_corners(c)) for c, t in described]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if images.compare(*packed[a], *packed[b]) >= images.INLIERS}
    assert {(k, 44 + k) for k in range(16)} <= want and len(want) <= 18
    order = rng.permutation(60).tolist()
    rows = [(order[k] * 7 + 3, bytearray(images.write_pgm(p))) for k, p in enumerate(pictures)]
    found = {r["image_id"]: r["class_id"] for r in images.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert sum(found[order[a] * 7 + 3] == found[order[b] * 7 + 3] for a, b in want) >= 0.95 * len(want)
    assert all(found[order[k] * 7 + 3] == order[k] * 7 + 3 for k in range(16, 44) if not any(k in p for p in want))
    family = [images.edited(pictures[0], 3) + rng.normal(0, 1, images.edited(pictures[0], 3).shape) for _ in range(70)]
    rows = [(k, bytearray(images.write_pgm(p))) for k, p in enumerate([*pictures[:20], *family])]
    found = {r["image_id"]: r["class_id"] for r in images.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert sum(found[20 + k] == 0 for k in range(70)) >= 66


def test_crowded_buckets_are_told_however_rows_arrive(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [1, 9, 10, 40, 2, 300, 8, 11, 5, 10]
    bucket = np.repeat(np.arange(len(sizes)) * 3, sizes)
    for step in (1, 4, 9, 50, 1000):
        crowd, found = images._Crowd(), []
        for lo in range(0, len(bucket), step):
            found += crowd.put([bucket[lo : lo + step], np.arange(lo, min(lo + step, len(bucket)))])[1].tolist()
        found += crowd.put([np.zeros(0, np.int64)] * 2, True)[1].tolist()
        assert found == [k for k in range(len(bucket)) if sizes[bucket[k] // 3] > images.FOLLOWERS + 1], step
    tests_a, tests_b = rng.integers(-(2**62), 2**62, (300, 4)), rng.integers(-(2**62), 2**62, (250, 4))
    tests_b[:120] = tests_a[50:170] ^ 5
    want = images.nearest_both_ways(tests_a, tests_b)
    monkeypatch.setattr(images, "CELLS", 1)
    assert [x.tolist() for x in images.nearest_both_ways(tests_a, tests_b)] == [x.tolist() for x in want] and set(range(50, 170)) <= set(want[0].tolist())


def test_crowded_buckets_are_compared_whole(spark, monkeypatch):
    """Of a family of noisy copies, which crowd their buckets, every link that comparing all pairs gives is found, in blocks of a few images."""
    rng = np.random.default_rng(21)
    pictures = [images.render(rng.normal(size=64)) for _ in range(20)]
    pictures = [images.read_pgm(images.write_pgm(p)) for p in pictures + [pictures[0] + rng.normal(0, 1.5, pictures[0].shape) for _ in range(180)]]
    described = [images.describe(p) for p in pictures]
    packed = [(np.packbits(t, axis=1).view(np.int64), images.pack_corners(c)) for c, t in described]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if images.compare(*packed[a], *packed[b]) >= images.INLIERS}
    sizes = [len(c) for _, c in packed]

    def block(ids):
        return np.array(ids), np.cumsum([0, *(sizes[k] for k in ids)]), np.concatenate([packed[k][0] for k in ids]), np.concatenate([packed[k][1] for k in ids])

    one, other = block([5, *range(59, 30, -1)]), block([k for k in range(31) if k != 5])
    for cells in (1, 1 << 20):
        monkeypatch.setattr(images, "CELLS", cells)
        assert sorted([*images.linked(one, one, True), *images.linked(one, other, False), *images.linked(other, other, True)]) == sorted(want), cells
    every = block(list(range(200)))
    links = Counter(k for pair in images.linked(every, every, True) for k in pair)
    monkeypatch.setattr(images, "BLOCK", 2000)
    rows = [(k, bytearray(images.write_pgm(p))) for k, p in enumerate(pictures)]
    found = images.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert {r["image_id"]: r["n_links"] for r in found} == {k: links[k] for k in range(200)} and links[0] == 180


def test_words_whose_first_bits_differ_are_near():
    """Distances are those of the bits themselves: numpy counts a negative number's absolute value."""
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (60, 256), dtype=np.uint8)
    other = bits ^ (rng.random((60, 256)) < 0.05)
    other[:, ::64] = 1 - bits[:, ::64]
    pack = [np.packbits(x, axis=1).view(np.int64) for x in (bits, other)]
    apart = (bits[:, None] != other[None]).sum(axis=2)
    want = [k for k in range(60) if apart[k].argmin() == k and apart[:, k].argmin() == k and apart[k, k] <= images.DISTANCE]
    assert len(want) > 50
    assert [x.tolist() for x in images.nearest_both_ways(*pack)] == [want, want]
    one = np.zeros(60, np.int64)
    assert [sorted(x.tolist()) for x in images.matches_between(pack[0], one, pack[1], one)] == [want, want]
    assert images.bits_apart(pack[0], pack[1]).sum(axis=1).tolist() == np.diag(apart).tolist()


def test_blocks_are_compared_by_products(monkeypatch):
    """Two blocks of pictures match as nearest_both_ways says, image by image; consensus looks at few of 3,600 unlike pairs alone."""
    rng = np.random.default_rng(31)
    described = [images.describe(images.render(rng.normal(size=64))) for _ in range(120)]
    tests = [np.packbits(t, axis=1).view(np.int64) for _, t in described]
    corners = [images.pack_corners(c) for c, _ in described]
    one, other = ((np.arange(lo, lo + 60), np.cumsum([0, *map(len, tests[lo : lo + 60])]), np.concatenate(tests[lo : lo + 60]), np.concatenate(corners[lo : lo + 60])) for lo in (0, 60))
    own, far = (np.repeat(np.arange(60), np.diff(x[1])) for x in (one, other))
    a, b = images.matches_between(one[2], own, other[2], far)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    want = set()
    for i in range(60):
        for j in range(60):
            u, v = images.nearest_both_ways(tests[i], tests[60 + j])
            want |= set(zip((u + one[1][i]).tolist(), (v + other[1][j]).tolist(), strict=True))
    assert found == want
    calls = []
    monkeypatch.setattr(images, "consensus", lambda *x, f=images.consensus: calls.append(x) or f(*x))
    assert list(images.linked(one, other, False)) == [] and len(calls) <= 6


def test_pictures_of_four_megapixels_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    picture = np.kron(rng.integers(20, 230, (250, 250)), np.ones((8, 8), np.int64)).astype(np.float32)
    tracemalloc.start()
    (ca, ta), (cb, tb) = images.describe(picture), images.describe(picture[40:-24, 16:-48] * 0.8 + 20)
    assert len(ca) > 10_000 and images.compare(np.packbits(ta, axis=1).view(np.int64), images.pack_corners(ca), np.packbits(tb, axis=1).view(np.int64), images.pack_corners(cb)) >= images.INLIERS
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_corners_pack():
    corners = np.array([[3.25, 900.5, 1.4, -3.1], [0, 0, 2.0, 3.1], [77, 5, 1, 0]], np.float32)
    back = images.unpack_corners(images.pack_corners(corners))
    assert np.abs(back[:, :3] - corners[:, :3]).max() < 0.13 and np.abs(np.angle(np.exp(1j * (back[:, 3] - corners[:, 3])))).max() < 0.002
