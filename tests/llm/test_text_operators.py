"""Packing, pieces, licenses, language, toxicity and HTML against plain versions and odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrylight.llm import html_text, langid, licenses, packing, pieces, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch string"
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "some words here", "en", "s", 3, "y"), (3, " \n\t ", "en", "s", 4, "z"), (4, "repeat me", "de", "s", 9, "z"), (4, "repeat me", "de", "s", 9, "z"), (5, "word " * 30000, "fr", "s", 150000, "z")]


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_packing_covers_every_id_once(spark):
    path = tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta's", "ça", "x1,", "…!"]) for _ in range(rng.choice([0, 1, 40, 900, 9000]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)] + ODD, DOCS)
    out = rows(packing.pack(docs, path, shard_sequences=4))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    pieces_of, used = {}, Counter()
    for r in out:
        pieces_of.setdefault(r["doc_id"], []).append(r)
        used[r["sequence_id"]] += r["length"]
    for i, t in enumerate(texts):
        if i in (1, 2, 3, 4, 5):
            continue  # ids that ODD repeats
        ids = np.asarray([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces_of[i], key=lambda r: r["start"])
        assert [r["start"] for r in mine] == list(np.cumsum([0, *(r["length"] for r in mine)])[:-1])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    assert max(used.values()) <= 4096
    assert all(n == 4096 or n & (n - 1) == 0 for n in used.values())
    for s in used:
        at = 0
        for r in sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    assert Counter(r["doc_id"] for r in out)[4] == (2 if len(texts) <= 4 else Counter(r["doc_id"] for r in out)[4])


def test_packing_balances_cost():
    lengths = [random.Random(5).randint(1, 3000) for _ in range(400)]
    placed = packing.pack_lengths(lengths, 4096, 1.0, 1 / 4096)
    assert all(sum(p[1] for p in ps) == n for ps, n in zip(placed, lengths, strict=True))
    cost = Counter()
    for ps in placed:
        for _, n, at, _ in ps:
            cost[at] += n + n * n / 4096
    full = sorted(cost.values())[-len(cost) + 12 :]
    assert max(full) < 2 * min(full)


def test_packing_empty(spark):
    assert rows(packing.pack(spark.createDataFrame([], DOCS), tokenizers.path("word_bpe_49k.json"))) == []


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    plain, mine, rng = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(1)
    odd = ["a\x1cb c", "é́ ̈x", "<|endoftext|> a<|startoftext|>b", "it's  DON'T we'll", "ΣΑΣ İstanbul ﬁ J̌", "a b​c\x85d", "한국어 你好 123 4५ x² ½"]
    odd += ["".join(rng.choice(" \n\t\xa0'stAÉé漢1²_<|>…J̌") for _ in range(40)) for _ in range(500)]
    for text in odd:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def brute_viterbi(model, scores, word):
    best, back = [0.0] + [-1e18] * len(word), [None] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        best[end], back[end] = best[end - 1] + model.floor, (1, None)
        for n in range(1, min(end, model.longest) + 1):
            hit = scores.get(word[end - n : end])
            if hit and best[end - n] + hit[0] > best[end]:
                best[end], back[end] = best[end - n] + hit[0], (n, hit[1])
    out, end = [], len(word)
    while end:
        n, i = back[end]
        out += [i] if i is not None else [model.bytes[b] for b in reversed(word[end - 1].encode())]
        end -= n
    return out[::-1]


def test_pieces_best_sum():
    """A vocabulary with log probabilities: the best sum, as a plain Viterbi finds it."""
    model = pieces.Pieces(tokenizers.path("piece_bpe_32k.model"))
    model.merges, model.blanks = None, {}
    model.score = -np.log(300.0 + np.arange(len(model.text)) * 7919 % 31991)
    ids = model.piece[model.piece >= 0].tolist()
    model.floor = float(model.score[ids].min()) - pieces.UNKNOWN
    scores = {model.text[i].decode(): (model.score[i], i) for i in ids}
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("abcdeéßñ漢😀1.,'") for _ in range(rng.randint(1, 18))) for _ in range(300)] + ["▁the", "▁straße"]
    for n in {len(w) for w in words}:
        group = [w for w in words if len(w) == n]
        for w, got in zip(group, model.viterbi(group), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == brute_viterbi(model, scores, w)


def test_pieces_are_the_librarys(data):
    """A merge-trained vocabulary: the library's own ids, on whole documents and on odd text of every kind."""
    import pyarrow.parquet as pq
    from sentencepiece import SentencePieceProcessor

    path = tokenizers.path("piece_bpe_32k.model")
    model, library = pieces.Pieces(path), SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()]
    rng = random.Random(1)
    letters = "aabbcde  ▁éßÀ你好の😀\n\t'.,0123的是一不了在人有the in"
    texts += ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 30, 200]))) for _ in range(3000)]
    texts += [unit * k for unit in (" ", "a", "ab", "你", "▁") for k in (0, 1, 2, 15, 16, 17, 33, 700)] + [" " * k + "x你"[k % 2] + " " * k for k in range(40)]
    got = model.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library.encode(texts)


def test_pieces_round_trip(spark):
    path = tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello  world.\nNew\tline", "漢字 😀", " leading and trailing ", "a" * 5000]
    docs = spark.createDataFrame([(100 + i, t, None, None, None, None) for i, t in enumerate(texts)] + ODD, DOCS)
    back = {r["doc_id"]: r["text"] for r in rows(pieces.decode(pieces.encode(docs, path), path))}
    assert [back[100 + i] for i in range(len(texts))] == texts
    assert all(r["same_text"] for r in rows(pieces.digest(docs, path)))
    assert {r["n_ids"] for r in rows(pieces.digest(docs, path)) if r["doc_id"] in (1, 2)} == {0}
    assert rows(pieces.digest(docs.limit(0), path)) == [] and rows(pieces.encode(docs.limit(0), path)) == []


def test_patience_alignment():
    t = licenses.words(licenses.TEMPLATES["mit-text"])
    assert len(licenses.align(t, t)) == len(t)
    changed = t[:20] + ["inserted", "words"] + t[20:50] + t[53:]
    pairs = licenses.align(changed, t)
    assert all(changed[i] == t[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    assert len(pairs) == len(t) - 3
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_license_scan_finds_all_and_only(spark):
    text = licenses.TEMPLATES
    docs = [
        (10, "Intro. " + text["mit-line"] + " Some prose. " + text["mit-line"], None, None, None, None),
        (11, "x " * 2000 + text["apache-2.0-notice"].replace("agreed to in writing", "agreed in writing") + " y" * 100, None, None, None, None),
        (12, "Licensed under CC BY-NC 4.0. more", None, None, None, None),
        (13, "the of and license version under", None, None, None, None),
    ]
    found = {}
    for r in rows(licenses.scan(spark.createDataFrame(docs + ODD, DOCS))):
        found.setdefault(r["doc_id"], []).append(r["license"])
    assert found == {10: ["mit-line", "mit-line"], 11: ["apache-2.0-notice"], 12: ["cc-by-nc-4.0-line"]}


def test_license_scan_tells_siblings_apart(spark):
    """Every template is found as itself, alone; siblings that no template has are not reported as their relatives."""
    every = sorted(licenses.TEMPLATES)
    docs = [(i, "Some prose stands before it. " + licenses.TEMPLATES[n] + " And prose after it.", None, None, None, None) for i, n in enumerate(every)]
    unlisted = ["Released under the Frobnitz License.", "Licensed under CC BY-XX 9.0.", "Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU Lesser General Public License, version 7."]
    docs += [(1000 + i, t, None, None, None, None) for i, t in enumerate([*unlisted, "Released under the BSD License.", "Licensed under CC BY-ND 4.0."])]
    found = {}
    for r in rows(licenses.scan(spark.createDataFrame(docs, DOCS))):
        found.setdefault(r["doc_id"], []).append(r["license"])
    assert {every[i]: found.get(i) for i in range(len(every))} == {n: [n] for n in every}
    assert {k: v for k, v in found.items() if k >= 1000} == {1004: ["bsd-released-line"], 1005: ["cc-by-nd-4.0-line"]}


def test_license_filter_loses_nothing():
    """Windows against alignment from every position."""
    rng = random.Random(4)
    t = licenses.Template("gpl", licenses.TEMPLATES["gpl-3-line"], 0.8, 1.5)
    for _ in range(200):
        body = [w for w in t.words if rng.random() > 0.15]
        text = [rng.choice(["foo", "the", "is"]) for _ in range(rng.randint(0, 9))] + body + ["bar"] * rng.randint(0, 9)
        every = max(len(licenses.align(text[a : a + t.span], t.words)) for a in range(len(text)))
        found = max((m[0] for m in t.find(text)), default=0)
        assert (every >= t.need) == (found >= t.need)


def test_language_profiles(spark):
    base = {"en": "the cat and the dog with that of this", "de": "der hund und die katze mit dem nicht ein", "fr": "le chien et la chatte avec des pour une"}
    rng = random.Random(6)
    data = [(i, " ".join(rng.choice(base[lang].split()) for _ in range(60)), lang, "s", 1, "z") for i, lang in enumerate(["en", "de", "fr"] * 30)]
    docs = spark.createDataFrame(data + ODD[:4], DOCS)
    profiles = langid.fit(docs)
    assert profiles.langs == ["de", "en", "fr"]
    out = {r["doc_id"]: r for r in rows(langid.identify(spark.createDataFrame([(1000 + d[0], *d[1:]) for d in data] + [(1, None, None, None, None, None), (2, "12 !?", None, None, None, None)], DOCS), profiles))}
    assert np.mean([out[1000 + d[0]]["lang_pred"] == d[2] for d in data]) == 1
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.Profiles({}).predict("abc") == ("und", 0.0)
    kept = langid.keep_known(docs, profiles)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0


def test_ngrams_against_plain_count():
    text = "Ab, ba-ab!"
    keys, counts = langid.ngrams(text)
    stream = "_ab_ba_ab_"
    plain = Counter(c for c in stream if c != "_")
    plain.update(stream[i : i + 2] for i in range(len(stream) - 1))
    plain.update(stream[i : i + 3] for i in range(len(stream) - 2) if stream[i + 1] != "_")
    assert sorted(counts.tolist()) == sorted(plain.values())


def test_string_kernel_is_the_plain_one():
    from itertools import combinations

    def plain(a, b):
        def subs(t):
            t, out = [27, *t, 27], Counter()
            for at in combinations(range(len(t)), 4):
                if at[3] - at[0] < toxicity.SPAN:
                    out[tuple(t[i] for i in at)] += toxicity.DECAY ** (at[3] - at[0] + 1)
            return out

        x, y = subs(a), subs(b)
        dot = lambda p, q: sum(v * q[k] for k, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = [toxicity.letters(w) for w in ("idiot", "id-iot", "idxiot", "banana", "bananas")]
    keys, weights = toxicity.features(words)
    weights = toxicity.unit(keys, weights)
    for i, a in enumerate(words):
        column = toxicity.kernel_column(keys, weights, i)
        assert column == pytest.approx([plain(a, b) for b in words])


def test_words_of_the_same_letters_are_weighed_once(monkeypatch):
    rng = np.random.default_rng(5)
    table = rng.normal(size=toxicity._SIZE)
    model = toxicity.Model(table, -1.0)
    words = ["", "a", "ab", "anna", "aaaaaaa", "École", "日本語", "{|}~", "x" * 40, "ab" * 60, *("".join(rng.choice(list("abcé-"), n)) for n in range(2, 60))]
    plain = []
    for word in words:
        t, best = toxicity.letters(word), -1.0
        for at in range(0, max(1, len(t) - toxicity.SPAN), toxicity.LONGEST - toxicity.SPAN) if len(t) > toxicity.LONGEST else (0,):
            if len(t[at : at + toxicity.LONGEST]) >= 2:
                keys, weights = toxicity.features([t[at : at + toxicity.LONGEST]])
                best = max(best, float((table[keys] * toxicity.unit(keys, weights)).sum()) - 1.0)
        plain.append(best)
    assert np.allclose(model.decisions(words), plain, atol=1e-9, rtol=0)
    seen, weighed = [], toxicity.weighed
    monkeypatch.setattr(toxicity, "weighed", lambda tokens, table: seen.extend(tokens) or weighed(tokens, table))
    assert len(set(model.decisions(["idiot", "Idiot,", "(IDIOT!)"]))) == 1 and len(seen) == 1
    assert model.decisions([]).shape == (0,)


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["zorkon", "blimfar", "quaddle"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        docs.append((i, " ".join(words), "en", "s", 1, "z"))
        labels.append((i, toxic * 1))
    frame = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(frame, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in rows(toxicity.score(frame, model))}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    spoilt = {r["doc_id"]: r["predicted"] for r in rows(toxicity.score(spark.createDataFrame([(1, "some z-o-r-k-o-n text", "", "", 1, ""), (2, "zorxkon", "", "", 1, ""), (3, "plain words", "", "", 1, "")], DOCS), model))}
    assert spoilt == {1: 1, 2: 1, 3: 0}
    odd = rows(toxicity.score(spark.createDataFrame(ODD, DOCS), model))
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.fit(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r["score"] for r in rows(toxicity.score(frame, none))) < 1e-12
    assert toxicity.keep_clean(frame, model).columns == frame.columns


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu<li>Other</ul></nav>
<div class="ad banner">Buy</div><article><h1>Head&amp;line</h1><p>First&nbsp;<b>bold</b>
 text<br>more<p>Second &lt;x&gt;<script>var t="</p>";</script><form>Name <input></form><aside>Side</aside><div class="comments"><p>Nice!</p></div></article><footer>&copy;</footer></body></html>"""


def test_html_article_and_neutral_pages(spark):
    neutral = lambda own: f"<body><div><p>Our shop sells many fine things to all of you</p></div><div><p>{own}</p></div></body>"
    pages = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "x", "")] + [(10 + i, f"https://b.example/{i}", neutral(f"Unique story number {i} with words of its own")) for i in range(5)]
    pages += [pages[-1]]
    out = {r["page_id"]: r for r in rows(html_text.extract(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")))}
    assert out[1]["text"] == "Head&line\nFirst bold text more\nSecond <x>" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[3]["text"] == ""
    assert [out[10 + i]["text"] for i in range(5)] == [f"Unique story number {i} with words of its own" for i in range(5)]
    assert rows(html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"))) == []


@pytest.mark.parametrize("held", [html_text.HELD, 0])
def test_html_array_decides_on_all_blocks(spark, held):
    own = lambda i: f"Page {i} tells of harbour {i} and of ship {i} at length"
    same = "Read all our other stories on this site every single day."
    teaser = lambda i: f"<body><article><p>Teaser number {i}</p></article><div>{own(i)}</div><div>{same}</div></body>"
    inside = lambda i: f"<body><article><p>{own(i)}</p><p>{same}</p><p>{same} {own(i + 50)}</p></article></body>"
    pages = [(i, f"https://a.example/{i}", teaser(i)) for i in range(5)]
    pages += [(100 + i, f"https://b.example/{i}", inside(i)) for i in range(12)]
    pages += [(200 + i, f"https://c.example/?copy={i}", f"<body><!-- {i} --><div>{own(7)}</div></body>") for i in range(4)]
    pages += [(300 + i, f"https://d.example/{i}", inside(i)) for i in range(4)]  # too few pages to overrule an article
    out = {r["page_id"]: r["text"] for r in rows(html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), held=held))}
    assert all(out[i] == f"Teaser number {i}\n{own(i)}" for i in range(5))
    assert all(out[100 + i] == f"{own(i)}\n{own(i + 50)}" for i in range(12))
    assert all(out[200 + i] == own(7) for i in range(4))
    assert all(out[300 + i] == f"{own(i)}\n{same}\n{same} {own(i + 50)}" for i in range(4))


@pytest.mark.parametrize("slot_words", [html_text.SLOT_WORDS, 40])
def test_html_equals_brute_force(spark, monkeypatch, slot_words):
    """Prefixes counted plainly on each host's distinct contents, with copies, repeated rows, and articles."""
    monkeypatch.setattr(html_text, "SLOT_WORDS", slot_words)
    rng = random.Random(9)
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(rng.randint(3, 14))) for _ in range(25)]
    pages = []
    for i in range(90):
        tag = rng.choice(["div", "article"])
        body = "".join(f"<{tag}><p>{rng.choice(lines)}</p></{tag}>" for _ in range(rng.randint(1, 6)))
        pages.append((i, f"https://{rng.choice('abc')}.example/{i}", f"<body>{body}</body>"))
    pages += [(100 + i, f"https://a.example/copy{i}", pages[0][2] + f"<!-- {i} -->") for i in range(5)] + [pages[1], pages[1]]
    streams = {(url, page): html_text.blocks(page) for _, url, page in pages}
    contents: dict[str, set] = {}
    for (url, _), found in streams.items():
        contents.setdefault(url.split("/")[2], set()).add(tuple(found))
    n = html_text.RUN_WORDS
    grams = lambda found: [tuple(w[i : i + n]) for w in [[x for _, t in found for x in t.split()]] for i in range(max(len(w) - n + 1, 0))]
    counts = {host: Counter(g for found in every for g in set(grams(found))) for host, every in contents.items()}
    want = {}
    for i, url, page in pages:
        host, found = url.split("/")[2], streams[url, page]
        c, whole = np.array([counts[host][g] for g in grams(found)]), len(contents[host])
        masks = [(c >= least) & (c >= share * whole) for least, share in ((html_text.LEAST_PAGES, html_text.SHARE), (html_text.ARTICLE_PAGES, html_text.ARTICLE_SHARE))]
        want[i] = html_text.main_text(found, [w for _, t in found for w in t.split()], *masks)
    out = rows(html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert len(out) == len(pages) and any(n for _, n in want.values())
    assert {r["page_id"]: (r["text"], r["n_repeated_blocks"]) for r in out} == want


def test_html_keys_survive_packing():
    rng = np.random.default_rng(4)
    for bits in (0, 1, 6, 24, 30):
        keys = rng.integers(0, 2**64, 50, np.uint64) & np.uint64((2**64 - 1) >> bits)
        slot = 0 if bits == 0 else 2**bits - 1
        keys |= np.uint64(slot << (64 - bits) if bits else 0)
        assert (html_text.unpacked(html_text.packed(keys, bits), slot, bits) == keys & html_text.mask(bits)).all()


def test_language_distance_against_plain_version():
    """The out-of-place distance, n-gram by n-gram, and ties going to the smaller name."""
    rng = random.Random(10)
    of, size = {}, 12
    for lang, letters in (("aa", "abcd"), ("bb", "bcde"), ("cc", "xyz")):
        keys, counts = langid.ngrams(" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(60)))
        of[lang] = langid.ranked(keys, counts, size).tolist()
    of["ab"] = of["aa"]
    profiles = langid.Profiles(of, size)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcdexyz") for _ in range(5)) for _ in range(8))
        keys, counts = langid.ngrams(text)
        mine = [k for _, k in sorted(zip((-counts).tolist(), keys.tolist(), strict=True))][:size]
        away = {lang: sum(abs(i - ranks.index(k)) if k in ranks else size for i, k in enumerate(mine)) for lang, ranks in of.items()}
        assert profiles.predict(text)[0] == min(sorted(away), key=away.get)
        assert profiles.predict(text)[0] != "ab"


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(none, labels)
    assert rows(toxicity.score(none, model)) == [] and rows(toxicity.keep_clean(none, model)) == []
    profiles = langid.fit(none)
    assert rows(langid.identify(none, profiles)) == [] and rows(langid.keep_known(none, profiles)) == []
    assert {r["lang_pred"] for r in rows(langid.identify(spark.createDataFrame(ODD, DOCS), profiles))} == {"und"}
    assert rows(licenses.scan(none)) == [] and rows(packing.pack(none, tokenizers.path("word_bpe_49k.json"))) == []
