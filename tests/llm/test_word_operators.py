"""Spelling variants, the filter audit and decontamination against brute force and odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quarrylight.llm import audit, decontaminate, spelling
from tests.llm.test_text_operators import DOCS, ODD, rows

EMPTY_LABELS = "doc_id long, quality int, toxic int, source string"


def frame(spark, texts, more=()):
    return spark.createDataFrame([(i, t, "en", "s", 1, "z") for i, t in texts] + list(more), DOCS)


# Spelling variants


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def plain_variants(texts, length=7, count=2, ratio=10, spoil=31):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if spoil and doc_id is not None and h % spoil == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= count}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        others = (edits(w, letters) & n.keys()) - {w}
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], near[w], n.get(form[w])) for w in n}


def by_word(df):
    out = rows(df)
    assert len({r["word"] for r in out}) == len(out)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}


def test_spelling_equals_brute_force(spark):
    rng = random.Random(11)
    stems = ["evidence", "Passage", "sentence", "corporaé", "straßenname", "document", "aaaaaaaa", "Évidence"]
    weight = [0.9**k for k in range(len(stems))]
    texts = []
    for i in range(150):
        words = rng.choices(stems, weight, k=60)
        for k in range(len(words)):
            for _ in range(3):
                if rng.random() < 0.25:
                    at = rng.randrange(len(words[k]))
                    words[k] = words[k][:at] + rng.choice(["", "e", "a", "ü"]) + words[k][at + rng.randint(0, 1) :]
        texts.append((i, rng.choice([" ", "-", "9", "中"]).join(words)))
    want = plain_variants(texts)
    assert by_word(spelling.variants(frame(spark, texts), spoil=31)) == want
    assert any(form and root != form for form, root, *_ in want.values())  # chains of two and more
    assert by_word(spelling.variants(frame(spark, texts), 5, 3, 4)) == plain_variants(texts, 5, 3, 4, None)


def test_spelling_of_odd_tables(spark):
    long = "wonderful " * 200_000 + "wonderfull " * 3 + "x" * 5000
    odd = [*ODD, (7, long, None, None, None, "w"), (8, "x" * 5000 + " 😀 " + "x" * 4999 + "÷", None, None, None, "w")]
    odd = [(a, b and b.encode("utf-16", "surrogatepass").decode("utf-16"), *c) for a, b, *c in odd]
    docs = spark.createDataFrame(odd, DOCS).withColumnRenamed("batch", "word").withColumnRenamed("lang", "key")
    assert by_word(spelling.variants(docs, spoil=31)) == plain_variants([(r[0], r[1]) for r in odd])
    assert rows(spelling.variants(docs.limit(0))) == []


def test_neighbourhoods_are_full():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7):
        words = rng.integers(1, spelling.SYMBOLS + 1, (20, n))
        key = lambda w: int(spelling.keys_of(np.array([[int(c) for c in w]], np.uint64).reshape(1, -1))[0])
        found = np.concatenate(list(spelling.neighbourhoods(words.astype(np.uint64))), axis=1)
        for word, keys in zip(words, found, strict=True):
            assert set(keys.tolist()) == {key(w) for w in edits("".join(map(str, word)), "123456")}


def test_forms_of_ties_and_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w3")], "word string, form string")
    assert {r["word"]: r["root"] for r in rows(spelling.roots(forms))} == {**{f"w{i}": "w13" for i in range(13)}, "x": "w13"}


# Filter audit


def plain_audit(docs, labels):
    """Every order walked document by document."""
    smallest, failed = {}, []
    for doc_id, text, source in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        marks = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and smallest[t] < doc_id,
        }
        failed.append((source or "", doc_id, {k for k, v in marks.items() if v}))
    out = {}
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[2]]
                left = [f for f in left if letter not in f[2]]
                share[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f[2] for f in own) - len(gone), sum(f[2] == {letter} for f in own),
                    sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def audited(docs, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = rows(audit.audit(audit.counted(audit.failures(docs), labels)))
    assert len(out) == 600 * len({r["part"] for r in out})
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in out}


def test_audit_equals_walking_every_order(spark):
    rng = random.Random(4)
    docs = []
    for i in range(120):
        if docs and rng.random() < 0.3:
            text = rng.choice(docs)[1]
        else:
            vocab = [rng.choice(["aB", "b", "C", "d#", "ée"]) + str(k) for k in range(rng.choice([3, 400]))]
            text = rng.choice([" ", "\n", "  ", "\x0b"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 5, 199, 200, 450])))
        docs.append((rng.choice([i, i, i // 2]), text, rng.choice(["s", "s", "t", "", None])))
    docs += [(None, docs[3][1], "t"), (None, None, None), docs[5], docs[5], (500, "w " * 700_000, "u"), (501, None, "u"), (502, "", "v")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(i, t, "en", s, 1, "z") for i, t, s in docs], DOCS).withColumnRenamed("batch", "mask").withColumnRenamed("lang", "n")
    marks = spark.createDataFrame([(*x, "s") for x in labels], EMPTY_LABELS)
    assert audited(table, marks) == plain_audit(docs, labels)
    assert audited(table, marks.limit(0)) == plain_audit(docs, [])
    assert audited(table.limit(0), marks) == {}


def test_shapley_is_the_mean_over_orders():
    rng = random.Random(8)
    for players in (1, 2, 3, 5):
        value = [0, *(rng.randint(0, 1000) for _ in range((1 << players) - 1))]
        orders = list(permutations(range(players)))
        total = [0] * players
        for order in orders:
            before = 0
            for i in order:
                total[i] += value[before | 1 << i] - value[before]
                before |= 1 << i
        assert [len(orders) * x for x in audit.shapley(value, players)] == total


# Decontamination


def plain_words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_hits(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        size = min(window, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(name)
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, met = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[p : p + size]))) is not None:
                    hit |= set(range(p, p + size))
                    met |= found
        out.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(str(x) for x in met if x is not None))))
    return sorted(out, key=repr)


def found_hits(df):
    out = []
    for r in rows(df):
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        out.append((r["doc_id"], r["n_words"], tuple(k for a, b in spans for k in range(a, b)), tuple(r["items"])))
    return sorted(out, key=repr)


def leaky(seed):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma", "été", "x1", "de"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 40]) if i > 3 else 30)) for i in range(40)] + [(50, None), (51, " -- "), (5, text(14)), (None, text(12))]
    items = [(i, t) for i, t in items if t is None or len(t.split()) > 6]
    docs = []
    for i in range(80):
        parts = [text(rng.choice([0, 3, 30]))]
        for _ in range(rng.choice([0, 1, 3])):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [rng.choice([" ", "... "]).join(w[a : a + rng.choice([5, 9, 10, 30])]).upper() if rng.random() < 0.3 else " ".join(w[a:]), text(rng.choice([0, 2]))]
        docs.append((i, "\n".join(parts)))
    return docs, items


@pytest.mark.parametrize("block_words", [200_000, 120])
def test_decontamination_equals_brute_force(spark, block_words):
    docs, items = leaky(block_words)
    docs = [*docs, docs[7], docs[7], (None, docs[9][1]), (None, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found_hits(decontaminate.hits(frame(spark, docs), table, 10, block_words)) == plain_hits(docs, items)


def test_decontamination_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    docs = [(r[0], r[1]) for r in ODD] + [(9, "lead " + " ".join(f"w{k}" for k in range(60)) + " word word"), (10, "q " * 900_000 + "some words here")]
    items = [(1, " ".join(f"W{k}" for k in range(5, 50))), (1, "Some, words"), (2, "word word word word word word word word word word word"), (3, None), (None, "me")]
    table = spark.createDataFrame([(i, t, "a", "b") for i, t in items], "item_id long, text string, doc_id string, words string")
    odd = frame(spark, docs).withColumnRenamed("batch", "spans").withColumnRenamed("lang", "digest")
    assert found_hits(decontaminate.hits(odd, table)) == plain_hits(docs, items)
    assert found_hits(decontaminate.hits(odd, table.limit(0))) == plain_hits(docs, [])
    assert found_hits(decontaminate.hits(odd.limit(0), table)) == []
    kept = {r["doc_id"]: r for r in rows(decontaminate.clean(odd, table))}
    assert kept[1]["text"] is None and kept[2]["text"] == "" and 5 not in kept  # all of 5 is hit
    assert kept[4]["text"] == "repeat " and list(kept[4]) == odd.columns
    assert 9 not in kept
    kept = {r["doc_id"]: r for r in rows(decontaminate.clean(odd, table, coverage=0.9))}
    assert kept[9]["text"] == "lead w0 w1 w2 w3 w4  w50 w51 w52 w53 w54 w55 w56 w57 w58 w59 word word"


def test_query_digests(spark, data):
    out = rows(decontaminate.op13_benchmark_decontamination(spark, data))
    assert len(out) == 200 and any(r["contaminated"] for r in out)
    assert all(r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in out if not r["contaminated"])


def test_marks_alone_are_no_letters():
    from quarrylight.llm import langid

    profiles = langid.Profiles({"de": [1, 2], "en": [3]}, 2)
    assert profiles.predict("́̈ ́") == ("und", 0.0)
    assert profiles.predict("é")[0] in ("de", "en")


def test_different_texts_of_one_id_stay(spark):
    from quarrylight.llm import neardup

    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words[:30]), " ".join(words[30:])
    kept = rows(neardup.keep_one(frame(spark, [(1, a), (1, b), (1, b), (2, a), (3, None)])))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, a), (1, b), (3, "")]
