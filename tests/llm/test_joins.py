"""Near duplicates, substrings and vector searches against brute force, and the pipeline."""

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import ann, common, graph, neardup, substrings, topk, vectors
from tests.llm.test_text_operators import DOCS, ODD, rows


def frame(spark, texts, more=()):
    return spark.createDataFrame([(i, t, "en", "s", 1, "z") for i, t in texts] + list(more), DOCS)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            t = rng.choice(texts)[1]
        elif texts and kind < 0.5:
            w = rng.choice(texts)[1].split()
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 25, 60])))
            if kind > 0.8:
                t += " " + passage
        texts.append((i * 7 % 1009, t))
    return texts


def brute_components(texts, words, similarity):
    sets = {i: set(neardup.shingle_set(t, words).tolist()) for i, t in texts}
    name = {i: i for i in sets}
    find = lambda x: x if name[x] == x else find(name[x])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    texts = corpus(words)
    out = rows(neardup.near_duplicates(frame(spark, texts), words, 80))
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(texts, words, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_odd_rows(spark):
    out = rows(neardup.near_duplicates(frame(spark, [], ODD), 2, 80))
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[None]["kept"]
    assert rows(neardup.near_duplicates(frame(spark, []), 2, 80)) == []
    kept = neardup.keep_one(frame(spark, [(9, "a b c d e f g"), (8, "a b c d e f g")], ODD))
    assert sorted(r["doc_id"] for r in rows(kept) if r["doc_id"]) == [1, 2, 3, 4, 5, 8] and len(kept.columns) == 6


def test_shingles_take_ascii_case_and_space():
    assert len(neardup.shingle_set("A b\x0bC", 2)) == 2
    assert neardup.shingle_set("A B", 2).tolist() == neardup.shingle_set("a\tb", 2).tolist()
    assert neardup.shingle_set("É x", 2).tolist() != neardup.shingle_set("é x", 2).tolist()
    assert len(neardup.shingle_set("one", 2)) == 1 and len(neardup.shingle_set(" \n", 2)) == 0


def test_signature_keys_guarantee():
    """Any signatures within the threshold share a chunk with at most one error."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        wrong = rng.permutation(neardup.SYMBOLS)[: neardup.ERRORS]
        assert min(np.bincount(wrong // neardup.WIDE, minlength=neardup.CHUNKS)) <= 1


def test_parity_sketch_bounds_difference():
    rng = np.random.default_rng(2)
    for n in (3, 50, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.unique(np.concatenate((x[: n // 2], rng.integers(0, 2**63, n // 3).astype(np.uint64))))
        apart = np.unpackbits(neardup.odd_sketch(x) ^ neardup.odd_sketch(y)).sum()
        assert apart <= len(np.setxor1d(x, y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["node"]: r["component"] for r in rows(graph.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 150: 100, 200: 100}
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"))) == []


def brute_substrings(texts, length):
    seen, out = {}, {}
    for i, t in sorted(texts):
        data = t.encode()
        cover = np.zeros(len(data) + 1, int)
        own = {data[k : k + length] for k in range(len(data) - length + 1)}
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                cover[k] += 1
                cover[k + length] -= 1
        seen |= dict.fromkeys(own)
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide", [2000, 0])
def test_substrings_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(substrings, "WIDE_BUCKET", wide)
    texts = corpus(11, 120) + [(2000 + i, "é" * k + "ab" * 40) for i, k in enumerate((0, 3, 30, 60))] + [(3000, "x" * 49), (3001, "x" * 500), (3002, "x" * 70)]
    rng = random.Random(12)
    long_ = "".join(rng.choice("abcd ") for _ in range(90_000))
    texts += [(4000, long_), (4001, "pre" + long_[60_000:70_000] + "post")]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(substrings.remove_repeats(frame(spark, texts)))}
    assert out == brute_substrings(texts, 50)


def test_substrings_odd_rows(spark):
    out = rows(substrings.remove_repeats(frame(spark, [(6, "word " * 100)], ODD)))
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ODD) + 1 and by[1]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[6]["n_removed"] == 500 and by[5]["n_removed"] == 0
    assert rows(substrings.remove_repeats(frame(spark, []))) == []
    cut = {r["doc_id"]: r for r in rows(substrings.shorten(frame(spark, [(6, "word " * 100)], ODD)))}
    assert cut[6]["text"] == "" and cut[6]["n_chars"] == 0 and cut[1]["text"] is None and set(cut[6]) == set(DOCS.replace(" long", "").replace(" string", "").split(", "))


def test_refinement_equals_plain_comparison():
    rng = random.Random(13)
    runs = ["".join(rng.choice("ab") for _ in range(rng.randint(10, 16))).encode() for _ in range(60)]
    owners = np.array([rng.randint(0, 30) for _ in runs])
    got = substrings.refine(runs, owners, 10)
    for i, r in enumerate(runs):
        for k in range(len(r) - 9):
            assert got[i][k] == any(r[k : k + 10] in s and owners[j] < owners[i] for j, s in enumerate(runs))


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n, seed, d=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, d)).astype(np.float32)
    x[n // 2 :: 7] = x[0]  # many copies of one vector
    return [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(100_000, None, 0), (100_050, [0.1, None] + [0.0] * (d - 2), 0), (100_100, [float("nan")] * d, 0), (None, [0.1] * d, 0), (100_150, [0.5], 0)]


def brute_top(data, k, score):
    known = [(i, np.array(v, float)) for i, v, _ in data if i is not None and v and len(v) > 1 and None not in v and np.isfinite(v).all()]
    return {i: [j for _, j in sorted((-score(q, v), j) for j, v in known if j != i)[:k]] for i, q in known if i % 50 == 0}


def test_exact_products(spark, monkeypatch):
    monkeypatch.setattr("quarrylight.llm.vectors.CELL_ROWS", 90)
    monkeypatch.setattr("quarrylight.llm.vectors.CELL_QUERIES", 4)
    data = vector_rows(600, 1)
    scaled = lambda v: np.floor(256 * v)
    out = {}
    for r in sorted(rows(topk.product_search(spark.createDataFrame(data, VECTORS), 5)), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    assert out == brute_top(data, 5, lambda a, b: float(scaled(a) @ scaled(b)))
    assert rows(topk.product_search(spark.createDataFrame(data[:3], VECTORS), 5))[0]["rank"] == 1
    assert rows(topk.product_search(spark.createDataFrame([], VECTORS), 5)) == []


def clustered(n, seed, d=8, centres=25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1.0, (centres, d))
    x = (middle[rng.integers(0, centres, n)] + rng.normal(0, 0.03, (n, d))).astype(np.float32)
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


def test_products_are_replicated_only_where_bounds_ask(spark, monkeypatch):
    """On clustered vectors a candidate goes to few of the bundles of queries; the result stays exact."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 200)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 10)
    sent, plain = [], vectors.best_in_cells
    monkeypatch.setattr(vectors, "best_in_cells", lambda q, c, *more: (sent.append((q.select("cell").distinct().count(), c.count())), plain(q, c, *more))[1])
    data = clustered(2500, 5)
    out = {}
    for r in sorted(rows(topk.product_search(spark.createDataFrame(data, VECTORS), 5, every=10)), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    x = np.floor(256 * np.array([v for _, v, _ in data]))
    products = x[::10] @ x.T
    for i, q in enumerate(range(0, 2500, 10)):
        products[i, q] = -np.inf
        assert out[q] == np.lexsort((np.arange(2500), -products[i]))[:5].tolist()
    number = len(topk.bundles(np.zeros((1, 2)), {0: 250}, 10)[0][0])  # what as many queries in one cell would take
    assert sent[1][1] < 0.5 * number * 2500, sent


def test_bundles_hold_neighbours_and_split_crowds():
    pivots = np.array([[0.0], [10.0], [0.5], [10.5]])
    dealt, number = topk.bundles(pivots, {0: 3, 1: 3, 2: 3, 3: 25}, 10)
    assert dealt[0].tolist() == dealt[2].tolist() and len(dealt[3]) == 3 and number == 4
    assert sorted(set(np.concatenate(list(dealt.values())).tolist())) == list(range(number))


def test_vector_searches_take_every_row_of_repeated_ids(spark, monkeypatch):
    """Rows that repeat an id are queries and candidates of their own, also if all of the row repeats; other columns do not matter."""
    monkeypatch.setattr(vectors, "CELL_QUERIES", 3)
    data = [(i, v, 0, "x", i) for i, v, _ in clustered(200, 6)]
    data += [(0, [1.0] * 8, 1, "again", 7), (3, data[3][1], 0, "same", 3), (50, data[50][1], 0, "same", 3)] + [(100, data[7][1], 0, "hot", 1)] * 70
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, score string, rank int")
    ids = [r[0] for r in data]
    x = np.array([np.float32(r[1]) for r in data], float)
    scaled, unit = np.floor(256 * x), ann.units(x)
    # All parts are visited, so the second search is exact too.
    for search, scores in ((lambda f: topk.product_search(f, 5), scaled @ scaled.T), (lambda f: ann.cosine_search(f, 5, probes=8), unit @ unit.T)):
        want = []
        for q in (i for i, own in enumerate(ids) if own % 50 == 0):
            best = sorted((round(-scores[q, c], 9), ids[c]) for c in range(len(ids)) if c != q)[:5]
            want += [(ids[q], rank, v, -s) for rank, (s, v) in enumerate(best, 1)]
        got = [tuple(r) for r in search(frame).collect()]
        assert sorted((q, n, v) for q, n, v, _ in got) == sorted((q, n, v) for q, n, v, _ in want)
        assert np.allclose(sorted(r[3] for r in got), sorted(r[3] for r in want))


def test_twin_of_products_sees_repeated_ids(spark):
    import duckdb

    data = vector_rows(120, 8)[:120] + [(50, [0.5] * len(vector_rows(1, 8)[0][1]), 0)] * 2
    emb = pa.table({"vec_id": [r[0] for r in data], "embedding": pa.array([r[1] for r in data], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", emb)
    want = con.execute(topk.SQL["op2_voronoi_topk"]).fetchall()
    got = topk.product_search(spark.createDataFrame(data, VECTORS), 5).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 25


def test_few_parts_are_visited_on_clustered_vectors(spark):
    x = np.array([v for _, v, _ in clustered(2000, 7)])
    router = ann.learn(x[400:], 16)
    part = router(ann.units(x)).argmax(1)
    index = spark.createDataFrame([(int(p), i, v.tobytes()) for i, (p, v) in enumerate(zip(part, x, strict=True))], "part int, row long, x binary")
    found = ann.parts_of_nearest(index, np.arange(40), x[:40], 5)
    sims = ann.units(x[:40]) @ ann.units(x).T
    sims[np.arange(40), np.arange(40)] = -np.inf
    near = np.argsort(-sims, 1)[:, :5]
    assert sorted(found) == sorted((j, int(p)) for j in range(40) for p in part[near[j]])
    assert ann.probes_for(router, x[:40], found, 0.94) <= 4


def test_learned_partitions_recall(spark):
    data = vector_rows(1500, 2)
    want = brute_top(data, 5, lambda a, b: float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b)))
    got = {}
    for r in rows(ann.cosine_search(spark.createDataFrame(data, VECTORS), 5)):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    # Copies of one vector tie; what counts is how near the found ones are.
    assert np.mean([len(got[q]) for q in want]) == 5
    vec = {i: np.array(v, float) for i, v, _ in data[:1500]}
    cos = lambda a, b: float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b))
    hit = [sum(cos(vec[q], vec[v]) >= cos(vec[q], vec[w[-1]]) - 1e-12 for v in got[q]) / 5 for q, w in want.items()]
    assert np.mean(hit) >= 0.9
    assert rows(ann.cosine_search(spark.createDataFrame([], VECTORS), 5)) == []
    assert {r["vec_id"] for r in rows(ann.cosine_search(spark.createDataFrame(data[:3], VECTORS), 5))} == {1, 2}


def test_balanced_parts():
    x = np.random.default_rng(3).normal(size=(300, 6))
    near = ann.neighbour_graph(ann.units(x), 5)
    part = ann.balanced_parts(near, 6)
    assert np.bincount(part, minlength=6).max() <= 50 * 1.05 + 2
    assert (part[near] == part[:, None]).mean() > 1 / 6


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data)
        if name != "packing":
            assert after.columns == docs.columns
        docs = after.sparkSession.createDataFrame(after.toPandas(), after.schema)
        counts.append(docs.count())
        if name == "near_duplicates":
            texts = [(r["doc_id"], r["text"]) for r in rows(docs)]
            assert all(k == v for k, v in brute_components(texts, 5, 80).items())
        if name == "repeated_passages":
            again = rows(docs)
            want = brute_substrings(texts, 50)
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            assert np.mean([sha(r["text"]) == want[r["doc_id"]][3] for r in again]) > 0.9  # cuts inside a character lose its rest
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4]
    assert counts[5] >= counts[4]


@pytest.mark.parametrize("docs", [[], ODD, [*ODD, (50, "plain words in a row that say little", "en", "s", 3, "z"), (51, "é" * 300, None, "s", 3, "z")]])
def test_pipeline_takes_odd_tables(spark, tmp_path, docs):
    import corpus_pipeline

    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (50, None, None)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert all(r["length"] > 0 for r in out) and (docs or out == [])


def test_what_was_shuffled_for_a_stash_goes_at_once(spark):
    """Files of shuffles that nothing reads any more would stand beside those of the next step."""
    jvm = spark.sparkContext._jvm
    files = lambda: {f.name for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    numbers = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    stashed = common.stash(numbers.groupBy("k").agg(F.sum("id").alias("n")), "sums")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert stashed.count() == 7 and spark.conf.get(common._CLEANUP) == "false"
