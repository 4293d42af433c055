"""Streaming state, the posting index, the lexical labeller and jobs that keep no key in one task."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import dedupe, labelling, postings, ranges, ranking, retrieval, segment, tables
from quarrylight.streaming import candidates, changes, matches, seen

SCHEMA = "pos long, " + dedupe.SCHEMA


def records(spark, rng, n, first):
    """Candidates that meet by address, file or title now and then."""
    rows = []
    for i in range(n):
        k = rng.randrange(12)
        row = {
            "pos": first + i, "source_id": rng.choice("ab"), "source_ids": rng.choice([[], ["c", "a"]]), "tier": rng.choice(["web", "preprint", "peer_reviewed"]),
            "title": rng.choice(["", f"A title of record {k}"]), "url": rng.choice(["", f"https://h{k}.com/{rng.randrange(3)}"]), "pdf_url": rng.choice([None, None, f"https://h{k}.com/f.pdf"]),
            "doi": None, "authors": rng.choice([[], ["X"], ["X", "Y"]]), "publisher": rng.choice([None, "P"]), "published": rng.choice([None, "2020", "2020-05", "2021-01-02"]),
            "snippet": rng.choice([None, "s" * rng.randrange(1, 5)]), "text": rng.choice([None, "t" * rng.randrange(1, 5)]), "cited_by_count": rng.choice([None, 3, 9]),
            "search_score": rng.choice([None, 0.5, 0.7]), "search_rank": rng.choice([None, 1, 2]), "for_counter": rng.random() < 0.5, "low_quality": False, "is_wikipedia": rng.random() < 0.3, "round": rng.choice([1, 2]),
        }
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, SCHEMA)


def plain_merge(members, keep):
    """One group's record, field by field; members are rows in order of pos."""
    filled = lambda v: v is not None and v != ""
    base = members[0] if keep else min(members, key=lambda m: (not filled(m["pdf_url"]), not filled(m["text"]), -len(m["snippet"] or ""), m["pos"]))
    order = [base, *(m for m in members if m is not base)]
    first = lambda c: next((m[c] for m in order if filled(m[c])), None)
    weight = {"web": 0.4, "preprint": 0.7, "peer_reviewed": 1.0}
    published = first("published")
    if published and len(published) == 4:
        published = next((m["published"] for m in order if m["published"] and len(m["published"]) > 4 and m["published"][:4] == published), published)
    ids = []
    for m in order:
        ids += [x for x in (m["source_ids"] or [m["source_id"]]) if x not in ids]
    longest = lambda c: next(iter(sorted((m for m in order if m[c]), key=lambda m: -len(m[c]))), {c: None})[c]
    return {
        "source_id": base["source_id"], "source_ids": ids, "tier": max((m["tier"] for m in order), key=weight.get), "title": first("title") or "", "url": base["url"], "pdf_url": first("pdf_url"), "publisher": first("publisher"),
        "authors": base["authors"] or longest("authors") or [], "published": published, "snippet": first("snippet"), "text": base["text"] or longest("text"), "cited_by_count": max((m["cited_by_count"] for m in order if m["cited_by_count"] is not None), default=None),
        "search_score": next((m["search_score"] for m in order if m["search_score"] is not None), None), "search_rank": min((m["search_rank"] for m in order if m["search_rank"] is not None), default=None),
        "for_counter": all(m["for_counter"] for m in order), "is_wikipedia": all(m["is_wikipedia"] for m in order), "round": base["round"] if keep else min(m["round"] for m in order), "pos": min(m["pos"] for m in order),
    }


@pytest.mark.parametrize("keep", [False, True])
def test_merged_groups_equal_a_plain_fold(spark, keep):
    rng = random.Random(5)
    rows = records(spark, rng, 240, 0).withColumn("component", F.when(F.col("pos") < 90, 0).otherwise(F.col("pos") % 30)).withColumn("candidate_id", F.col("pos").cast("string"))
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: r["pos"]):
        groups.setdefault(r["component"], []).append(r.asDict())
    out = {r["component"]: r.asDict() for r in dedupe.merge_groups(rows, keep).collect()}
    assert out.keys() == groups.keys()
    for c, members in groups.items():
        want = plain_merge(members, keep)
        assert {k: out[c][k] for k in want} == want


def uncommit(tmp_path, number):
    """As if the query had been killed after a batch's work and before its commit."""
    for name in (str(number), f".{number}.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()


def by_pos(df):
    return {r["pos"]: r.asDict() for r in df.select("pos", "candidate_id", *dedupe.FIELDS).collect()}


def test_changes_equal_merging_the_whole_table(spark, tmp_path):
    rng, root = random.Random(2), str(tmp_path / "store")
    batches = [records(spark, rng, 15, 0) for _ in range(2)]
    table = dedupe.empty_candidates(spark)
    for n, batch in enumerate(batches):
        table = tables.cut(dedupe.merge_incremental(table, batch))
        candidates.merge(batch, root, n, buckets=2)
        assert by_pos(candidates.snapshot(spark, root, n + 1)) == by_pos(table)
    # A batch that is run again reads the ones before it, here a base, and gives the same table.
    candidates.compact(spark, root, 0)
    candidates.merge(batches[1], root, 1, buckets=2)
    assert by_pos(candidates.snapshot(spark, root, 2)) == by_pos(table)
    # A tombstone takes a record and its keys; its position stays empty.
    candidates.retract(spark, root, 2, table.where("pos = 0").select("candidate_id"), buckets=2)
    left = by_pos(candidates.snapshot(spark, root, 3))
    assert 0 not in left and left == {k: v for k, v in by_pos(table).items() if k}


def test_bytes_follow_the_batch(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "store")
    big = records(spark, rng, 600, 0).withColumn("url", F.concat(F.lit("https://x.com/"), "pos")).withColumn("title", F.lit("")).withColumn("pdf_url", F.lit(None).cast("string"))
    candidates.merge(big, root, 0, buckets=2)
    candidates.merge(records(spark, rng, 5, 0), root, 1, buckets=2)
    sizes = [changes.size(spark, f"{root}/records", n) for n in (0, 1)]
    assert 0 < sizes[1] < sizes[0] / 2 and candidates.snapshot(spark, root, 2).count() > 600


def test_upserts_of_a_stream_and_a_killed_batch(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    run = lambda: candidates.upsert(spark.readStream.schema(SCHEMA).parquet(str(src / "*")), root, str(tmp_path / "cp"), 2).awaitTermination()
    records(spark, random.Random(7), 10, 0).coalesce(1).write.parquet(str(src / "0"))
    run()
    before = by_pos(candidates.snapshot(spark, root, 9))
    # Killed after it wrote and before it was committed: the batch is run again.
    uncommit(tmp_path, 0)
    run()
    assert before and by_pos(candidates.snapshot(spark, root, 9)) == before


def test_keys_are_remembered_for_ever(spark, tmp_path):
    root = str(tmp_path / "seen")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, key string")
    take = lambda n, rows: sorted(tuple(r) for r in seen.unseen(frame(rows), ["doc_id"], root, n, ["text"], 2).collect())
    assert take(0, [(1, "b", "k"), (1, "a", "k"), (2, "x", None)]) == [(1, "a", "k"), (2, "x", None)]
    again = [(2, "y", "k"), (3, "z", "k")]
    assert take(1, again) == take(1, again) == [(3, "z", "k")]  # run again: the same rows
    assert take(2, []) == []
    for n in range(3, 5):
        assert len(take(n, [(10 * n + i, "t", "k") for i in range(9)])) == 9
    seen.compact(spark, root, 3)
    assert take(6, [(1, "late", "k"), (2, "late", "k"), (30, "late", "k"), (99, "new", "k")]) == [(99, "new", "k")]
    state = seen.state_size(spark, root, 7).collect()
    assert sum(r["keys"] for r in state) == 3 + 18 + 1 and all(0 < r["filled"] < 0.01 for r in state)


def test_a_stream_processes_each_key_once(spark, tmp_path):
    schema = "doc_id long, text string"
    feed = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    run = lambda: seen.process_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), ["doc_id"], str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=2).awaitTermination()
    for n, rows in enumerate([[(1, "a"), (1, "a"), (2, "b")], [(2, "c"), (3, "d")], [(1, "e")]]):
        feed(n, rows)
        run()
    uncommit(tmp_path, 2)
    run()
    got = sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a"), (2, "b"), (3, "d")]


def corpus(spark, rng, n, first=0):
    vocab = ["wages", "minimum", "jobs", "cut", "rise", "policy", "Größe", "effect", "rate", "costs"]
    text = lambda: " ".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 9))).capitalize() + rng.choice([". ", "! ", ".\n"]) for _ in range(rng.randint(1, 9)))
    return spark.createDataFrame([(first + i, text()) for i in range(n)], "doc_id long, text string")


def scores(df):
    return {(r["claim_id"], r["doc_id"], r["chunk_idx"]): r["score"] for r in df.collect()}


def test_moving_statistics_converge(spark, tmp_path):
    rng, root = random.Random(1), str(tmp_path / "index")
    docs = [corpus(spark, rng, 12, 100 * n) for n in range(3)]
    asked = retrieval.query_terms(spark.createDataFrame([(1, ["minimum wages cut jobs"]), (2, ["policy costs", "rate"])], "claim_id long, texts array<string>"))
    for n, batch in enumerate(docs):
        matches.add(batch, root, n, 2)
    matches.add(docs[1], root, 1, 2)  # run again
    whole = postings.build(docs[0].union(docs[1]).union(docs[2]), str(tmp_path / "whole"), 2)
    want = scores(whole.bm25(asked))
    assert scores(matches.standing_scores(spark, root, 2, asked)) == want
    assert scores(matches.new_scores(spark, root, 2, asked)) == {k: v for k, v in want.items() if k[1] >= 200}
    again = postings.load(spark, str(tmp_path / "whole"), 2)
    assert scores(again.bm25(asked)) == want == scores(retrieval.bm25(retrieval.chunk_terms(whole.sentences), asked))
    assert scores(matches.standing_scores(spark, str(tmp_path / "none"), 5, asked)) == {}


def test_matching_a_stream(spark, tmp_path):
    rng = random.Random(4)
    asked = retrieval.query_terms(spark.createDataFrame([(1, ["minimum wages cut jobs"])], "claim_id long, texts array<string>"))
    schema = "doc_id long, text string"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    run = lambda: matches.match(stream(), asked, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    docs = [corpus(spark, rng, 8, 100 * n) for n in range(2)]
    for n, batch in enumerate(docs):
        batch.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        run()
    rounds = {r["round"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(rounds) == {0, 1} and rounds[1]["doc_id"] >= 100
    whole = postings.build(docs[0].union(docs[1]), str(tmp_path / "whole"), 2)
    assert scores(matches.standing_scores(spark, str(tmp_path / "index"), 1, asked)) == scores(whole.bm25(asked))


def test_index_reads_no_shuffle_of_its_postings(spark, tmp_path):
    index = postings.build(corpus(spark, random.Random(6), 10), str(tmp_path / "index"), 4)
    plan = postings.document_frequencies(index.postings)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lexical_labels(spark, tmp_path):
    docs = spark.createDataFrame([
        (1, "Minimum wages cut many jobs in small towns. Bread is old. Nobody knows why. Rivers flow north."),
        (2, "Minimum wages do not cut many jobs in small towns. Fish swim. Birds fly. Trees grow."),
        (3, "Minimum wages cut jobs in towns. Other things happen. Bread is old. Rivers flow."),
        (4, "Bread is old. Rivers flow north. Fish swim. Trees grow."),
        (5, "Minimum wages rose by 12 percent over two years. Fish swim. Birds fly. Trees grow."),
    ], "doc_id long, text string")
    index = postings.build(docs, str(tmp_path / "index"), 2)
    claims = spark.createDataFrame([(1, "Minimum wages cut many jobs in small towns."), (2, "Minimum wages rose by 7 percent over two years."), (3, "... of the")], "claim_id long, text string")
    chunks = index.spans().crossJoin(claims.select("claim_id"))
    got = {(r["claim_id"], r["doc_id"]): r for r in labelling.label(claims, chunks, index).collect()}
    relation = {k: r["relation"] for k, r in got.items()}
    assert relation[1, 1] == "direct" and got[1, 1]["sentence_ids"] == ["d1.s0"] and got[1, 1]["confidence"] == 1.0
    assert relation[1, 2] == "contradicts" and "negated" in got[1, 2]["reason"]
    assert relation[1, 3] in ("partial", "paraphrase") and relation[1, 4] == "irrelevant" and got[1, 4]["sentence_ids"] == []
    assert relation[2, 5] == "contradicts" and "numbers differ" in got[2, 5]["reason"]
    assert not any(c == 3 for c, _ in relation)


def plain_greedy(rows):
    out, taken = set(), {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["pos"], r["doc_id"], r["chunk_idx"])):
        used = taken.setdefault((r["claim_id"], r["candidate_id"], r["doc_id"]), set())
        if used.isdisjoint(r["sentence_idx"]):
            used |= set(r["sentence_idx"])
            out.add((r["claim_id"], r["candidate_id"], r["doc_id"], r["chunk_idx"]))
    return out


def test_greedy_passages_of_a_skewed_source(spark):
    rng = random.Random(9)
    rows = [(1, 0 if i % 3 else i, 0 if i % 3 else i, i % 2, i, rng.choice(["direct", "contradicts"]), rng.randint(0, 40) / 10, sorted(rng.sample(range(i % 60, i % 60 + 5), 3)), f"p{i}") for i in range(300)]
    scored = spark.createDataFrame(rows, "claim_id long, candidate_id long, pos long, doc_id long, chunk_idx long, relation string, score double, sentence_idx array<int>, passage string")
    key = ("claim_id", "candidate_id", "doc_id", "chunk_idx")
    kept = plain_greedy(scored.collect())
    assert {tuple(r[k] for k in key) for r in ranking.distinct_passages(scored).collect()} == kept
    out = ranking.rank_results(scored, support=100, pushback=100).collect()
    assert {r["candidate_id"] for r in out} == {r[1] for r in rows}
    for r in out:
        mine = [x for x in rows if x[1] == r["candidate_id"] and (1, x[1], x[3], x[4]) in kept]
        on, off = (max((x[6] for x in mine if (x[5] == "contradicts") == side), default=None) for side in (False, True))
        support = on is not None and (off is None or on >= 0.8 * off)
        assert r["side"] == ("support" if support else "pushback") and r["score"] == (on if support else off)
        assert 1 + len(r["more"]) == sum((x[5] == "contradicts") != support for x in mine)
        assert r["best"]["passage"] not in {m["passage"] for m in r["more"]}


def test_running_sums_of_one_key(spark, monkeypatch):
    rng = random.Random(10)
    rows = [("big" if i % 4 else rng.choice(["a", "b", None]), i, float(rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "job string, batch long, estimate double").repartition(7)
    got = {(r["job"], r["batch"]): r["running"] for r in ranges.running(df, "job", [F.col("batch")], F.col("estimate"), "running").collect()}
    for job in {r[0] for r in rows}:
        total = 0
        for _, batch, value in sorted(r for r in rows if r[0] == job):
            total += value
            assert got[job, batch] == total
    placed = ranges.placed(df, "job", [-F.col("batch")], "n").where("job = 'big'").orderBy("n").collect()
    assert [r["n"] for r in placed] == list(range(1, 301)) and placed[0]["batch"] == 399
    held = []
    monkeypatch.setattr(ranges, "cut", lambda df, label: held.append(tables.cut(df, label)) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one task
    ranges.running(df, "job", [F.col("batch")], F.col("estimate"), "running")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held[0].where("job = 'big'").select("__range").distinct().count() > 1


def test_reserved_places_are_chosen_among_few(spark):
    rows = [(1, i, i % 10 == 9, i + 1) for i in range(60)] + [(2, i, False, i + 1) for i in range(3)]
    df = spark.createDataFrame(rows, "claim_id long, doc_id long, for_counter boolean, rank int")
    out = ranking.select_to_read(df, 8, 3)
    got = sorted((r["claim_id"], r["rank"]) for r in out.collect())
    assert got == [*((1, k) for k in (1, 2, 3, 4, 5, 10, 20, 30)), (2, 1), (2, 2), (2, 3)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_repaired(spark):
    text = "1. First point here. See e.g. this one. A. Then more. " + "word " * 60 + "part one; " + "more " * 70 + "end. Pi is 3.14 now! (a) Last\nOne."
    sents = segment.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("sent_idx").collect()
    assert [r["text"] for r in sents][:3] == ["1. First point here.", "See e.g. this one.", "A. Then more."]
    assert all(text[r["start"] : r["end"]] == r["text"] and len(r["text"]) <= 600 for r in sents)
    assert any(r["text"].endswith("part one;") for r in sents) and [r["text"] for r in sents][-3:] == ["Pi is 3.14 now!", "(a) Last", "One."]


def test_pages_join_to_running_text(spark):
    from quarrylight.operators import paging

    page = lambda n, body: f"Report of 2024\n{body}\nPage {n} of 4"
    pages = [(1, 1, page(1, "First para-\ngraph goes on")), (1, 2, page(2, "over the edge. It is inter-")), (1, 3, page(3, "rupted here.\n\nNew one?")), (1, 4, page(4, "Last."))]
    pages += [(2, 1, "Only page"), (3, 1, " \n"), (3, 2, "7\nBody")]
    out = {r["doc_id"]: r for r in paging.running_text(spark.createDataFrame(pages, "doc_id long, page_no int, text string")).collect()}
    text = out[1]["text"]
    assert text == "First paragraph goes on over the edge. It is interrupted here.\n\nNew one?\n\nLast."
    assert [(p["page"], text[p["start"] :].split(" ")[0]) for p in out[1]["page_starts"]] == [(1, "First"), (2, "over"), (3, "rupted"), (4, "Last.")]
    assert out[2]["text"] == "Only page" and out[3]["text"] == "Body" and [p["page"] for p in out[3]["page_starts"]] == [2]
    got = paging.sentence_pages(spark.createDataFrame([tuple(out[1])], "doc_id long, text string, page_starts array<struct<page: int, start: long>>"))
    assert [(r["text"], r["page"]) for r in got.orderBy("sent_idx").collect()] == [("First paragraph goes on over the edge.", 1), ("It is interrupted here.", 2), ("New one?", 3), ("Last.", 4)]
