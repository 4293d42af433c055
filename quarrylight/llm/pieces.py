"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Method.  A text is cut into words, each with the word-start mark before it; no piece of the vocabulary crosses such a cut (checked when it
is read).  Words not met before are grouped by length, and all words of a length advance together: the hashes of their
substrings probe the sorted hashes of the vocabulary's prefixes, a hit being compared letter by letter with the prefix it stands for, and
the pieces found extend the best way to their first letter; a vectorised maximum keeps the last piece as backpointer.

What is best depends on the vocabulary.  Where pieces have log probabilities, it is the largest sum, ties going to the shorter last
piece.  Where the vocabulary was trained by merging, scores are merge ranks, which do not add up: there a way is possible only if each two
neighbouring pieces are what merging makes of their joined text, and of the pieces that end at a letter exactly one passes (any prefix of a
text has one outcome).  Whether two pieces may be neighbours is found by undoing their merges, latest first: no pair that meets at the
border on the way may have a merge that is due before the next of their own.  The ids are those that the library gives.

Letters that no piece covers become byte pieces (or the unknown piece where the vocabulary has no bytes); in sums they cost ``UNKNOWN``
below the worst piece.  Runs of blanks, whose pieces all have one rank, are merged from the left when all else is done.

Defined cases: null and empty texts have no ids; words of any length are cut where no piece spans two neighbouring letters, so a
script without blanks does not make one long word; repeated rows are encoded each for itself; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.common import slices, sole_cache, table, text_rows

MARK = "▁"
UNKNOWN = 10.0
CACHE_WORDS = 500_000
#: Letters of the words that advance together.
BATCH = 1 << 17
#: Words of more letters are cut where no piece spans two neighbours.
LONG = 24
#: Score below which pieces have no rank: runs of marks.
NO_RANK = -1e8

_M1 = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0xBF58476D1CE4E5B9)
_ROOT, _BARRIER = -1, -1
_NEVER = np.iinfo(np.int64).max


def _extend(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes.astype(np.uint64)) * _M1
    return h ^ (h >> np.uint64(29))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class SortedHashes:
    """Sorted hashes that are probed from where their leading bits begin."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.append(np.sort(hashes), np.uint64(2**64 - 1))
        bits = max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1], np.arange(2**bits, dtype=np.uint64) << self.shift)
        self.deepest = int(np.diff(np.append(self.first, len(hashes))).max())

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        for _ in range(self.deepest):
            at = at + (self.keys[at] < h)
        at = np.minimum(at, len(self.keys) - 1)
        return at, (self.keys[at] == h) & (at < len(self.keys) - 1)


class Merges:
    """What merging makes of two neighbouring pieces.  A piece's own last merge joins ``left`` and ``right``."""

    def __init__(self, names: list[str], rank: dict[int, int]):
        ids = {names[i]: i for i in rank}
        size = len(names)
        self.size = size
        self.rank = np.full(size, -1, np.int64)  # letters are there from the start
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        by_length: dict[int, list[int]] = {}
        pairs, joint = [], []
        for name, i in ids.items():
            if len(name) > 1:
                self.rank[i] = rank[i]
                by_length.setdefault(len(name), []).append(i)
                for at in range(1, len(name)):
                    a, b = ids.get(name[:at]), ids.get(name[at:])
                    if a is not None and b is not None:
                        pairs.append(a * size + b)
                        joint.append(i)
        split_at: dict[int, list[tuple[int, int]]] = {}
        for key, i in zip(pairs, joint, strict=True):
            split_at.setdefault(i, []).append(divmod(key, size))
        self._index(np.array(pairs, np.int64), np.array(joint, np.int64))
        reached = set(i for i in rank if len(names[i]) == 1)
        for n in sorted(by_length):
            rows = [(a, b, i) for i in by_length[n] for a, b in split_at.get(i, ()) if a in reached and b in reached and self.rank[a] < rank[i] and self.rank[b] < rank[i]]
            if rows:
                a, b, i = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                fine = self.apart(a, b, 2 * self.rank[i])
                self.left[i[fine]], self.right[i[fine]] = a[fine], b[fine]
                reached.update(i[fine].tolist())
        #: Pieces that merging can make at all.
        self.reached = np.zeros(size, bool)
        self.reached[list(reached)] = True
        made = self.reached[np.array(joint, np.int64)]
        self._index(np.array(pairs, np.int64)[made], np.array(joint, np.int64)[made])
        self._asked, self._said = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, bool)

    def _index(self, pairs: np.ndarray, joint: np.ndarray) -> None:
        """Pieces by the two that they join.  Multiplying by an odd number hashes without collisions."""
        hashes = pairs.astype(np.uint64) * _M1
        self.pairs = SortedHashes(hashes)
        # Twice the rank of the joint piece; never for what is no pair.
        self.joint = np.append(2 * self.rank[joint[np.argsort(hashes)]], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether a and b stay apart when their joined text is merged (by merges before the limit, twice a rank, if one is given)."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero(a >= 0)
        x, y = a[live], b[live]
        limit = np.full(len(live), _NEVER) if limit is None else limit[live]
        while len(live):
            at, known = self.pairs.probe((x * self.size + y).astype(np.uint64) * _M1)
            merged = known & (self.joint[at] < limit)
            out[live[merged]] = False
            rx, ry = self.rank[x], self.rank[y]
            going = ~merged & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            # Of equal ranks the left merge came first, so the right one is undone first, and a tie at the border wins over it.
            second = ry >= rx
            limit = np.where(second, 2 * ry + 1, 2 * rx)
            x, y = np.where(second, x, self.right[x]), np.where(second, self.left[y], y)
        return out

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart``, remembering what was asked last."""
        key = a * self.size + b
        slot = (key.astype(np.uint64) * _M1 >> np.uint64(48)).astype(np.int64)
        unknown = np.flatnonzero((self._asked[slot] != key) & (a >= 0))
        if len(unknown):
            said = self.apart(a[unknown], b[unknown])
            # Keys that share a slot: the last one written wins in both arrays, so they are written in one order.
            self._asked[slot[unknown]], self._said[slot[unknown]] = key[unknown], said
        out = self._said[slot]
        lost = np.flatnonzero((self._asked[slot] != key) & (a >= 0))
        if len(lost):
            out[lost] = self.apart(a[lost], b[lost])
        return out | (a < 0)


class Pieces:
    """A vocabulary: pieces, scores or merges, byte pieces, and sorted hashes of the pieces' prefixes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.text = [n.encode() for n in names]
        for i in range(size):
            if model.is_control(i):
                self.text[i] = b""
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece of the vocabulary crosses words")
        score = {i: model.get_score(i) for i in plain}
        ranks = [s for i, s in score.items() if s > NO_RANK]
        self.merges: Merges | None = None
        self.blanks: dict[int, int] = {}
        if ranks and all(s == int(s) <= 0 for s in ranks) and len(set(ranks)) == len(ranks):
            self.blanks = {len(names[i]): i for i in plain if set(names[i]) == {MARK}}
            plain = [i for i in plain if names[i] == MARK or set(names[i]) != {MARK}]
            self.merges = Merges(names, {i: -int(score[i]) for i in plain})
            plain = [i for i in plain if self.merges.reached[i]]
        self.score = np.array([score.get(i, 0.0) for i in range(size)])
        self.floor = min((score[i] for i in plain), default=0.0) - UNKNOWN
        self.longest = max((len(names[i]) for i in plain), default=1)
        self._index(names, plain)
        self.spans = np.unique(np.array([ord(a) << 21 | ord(b) for i in plain for a, b in zip(names[i], names[i][1:])], np.int64))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _index(self, names: list[str], plain: list[int]) -> None:
        """Sorted hashes of all prefixes, and of each its shorter prefix, last letter and, if it is one, piece."""
        where: dict[str, int] = {}
        parent, code, hashes = [], [], []
        for i in plain:
            h, before = int(_SEED), _ROOT
            for n in range(1, len(names[i]) + 1):
                c = ord(names[i][n - 1])
                h = ((h ^ c) * int(_M1)) & 0xFFFFFFFFFFFFFFFF
                h ^= h >> 29
                at = where.get(names[i][:n])
                if at is None:
                    at = where[names[i][:n]] = len(parent)
                    parent.append(before)
                    code.append(c)
                    hashes.append(h)
                before = at
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        place = np.empty(len(order) + 1, np.int64)
        place[order], place[-1] = np.arange(len(order)), _ROOT
        self.keys = SortedHashes(np.array(hashes, np.uint64))
        if len(np.unique(self.keys.keys)) <= len(hashes):
            raise ValueError("two prefixes of the vocabulary have one hash")
        self.parent, self.code = (np.append(x[order], -2) for x in (place[np.array(parent, np.int64)], np.array(code, np.int64)))
        self.piece = np.full(len(order) + 1, -1, np.int64)
        for i in plain:
            self.piece[place[where[names[i]]]] = i

    def found(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all pieces in the words (codes; left: letters up to the word's end): start, length, id.  Ordered by length."""
        at = np.arange(len(codes))
        h, before = np.full(len(codes), _SEED), np.full(len(codes), _ROOT)
        out = []
        for n in range(1, self.longest + 1):
            c = codes[at + n - 1]
            h = _extend(h, c)
            place, hit = self.keys.probe(h)
            hit &= (self.parent[place] == before) & (self.code[place] == c)
            at, h, before = at[hit], h[hit], place[hit]
            ids = self.piece[before]
            whole = ids >= 0
            out.append((at[whole], np.full(int(whole.sum()), n), ids[whole]))
            more = left[at] > n
            at, h, before = at[more], h[more], before[more]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian uint32 bytes, of the best segmentations of words that all have the same length."""
        size, many = len(words[0]), len(words)
        codes = _codes(words)
        start, length, ids = self.found(codes, np.tile(np.arange(size, 0, -1), many))
        word, at = np.divmod(start, size)
        order = np.argsort(at, kind="stable")  # longer last pieces come first, so that the shorter of equals stays
        word, at, length, ids = word[order], at[order], length[order], ids[order]
        bounds = np.searchsorted(at, np.arange(size + 1))
        best = np.full((size + 1, many), -np.inf)
        best[0] = 0
        last, step = np.full((size + 1, many), _BARRIER), np.ones((size + 1, many), np.int32)
        for s in range(size):
            some = slice(bounds[s], bounds[s + 1])
            w, n, p = word[some], length[some], ids[some]
            if self.merges:
                gain = np.where(self.merges.neighbours(last[s, w], p), 0.0, -np.inf)
            else:
                gain = self.score[p]
            total = best[s, w] + gain
            # An uncovered letter: any merge that is possible is better.
            alone = best[s] + self.floor
            better = alone > best[s + 1]
            best[s + 1, better], last[s + 1, better], step[s + 1, better] = alone[better], _BARRIER, 1
            for k in np.unique(n) if len(n) else ():
                of = np.flatnonzero((n == k) & (total >= best[s + n, w]))
                best[s + k, w[of]], last[s + k, w[of]], step[s + k, w[of]] = total[of], p[of], k
        return self._traced(words, last, step)

    def _traced(self, words: list[str], last: np.ndarray, step: np.ndarray) -> list[bytes]:
        """The ids along the backpointers, all words going back together."""
        size, many = len(words[0]), len(words)
        ids, owner = [], []
        word, end = np.arange(many), np.full(many, size)
        while len(word):
            ids.append(last[end, word])
            owner.append(word)
            end = end - step[end, word]
            word, end = word[end > 0], end[end > 0]
        owner = np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        flat, owner = np.concatenate(ids[::-1])[order], owner[order]
        bounds = (4 * np.searchsorted(owner, np.arange(many + 1))).tolist()
        data = flat.astype("<i4").tobytes()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.unique(owner[flat < 0]).tolist():
            out[i] = self._with_bytes(words[i], last[:, i].tolist(), step[:, i].tolist())
        return out

    def _with_bytes(self, word: str, last: list[int], step: list[int]) -> bytes:
        end, got = len(word), []
        while end:
            if last[end] >= 0:
                got.append(last[end])
            elif self.bytes:
                got += [self.bytes[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass"))]
            else:
                got.append(self.unknown)
            end -= step[end]
        return np.array(got[::-1], "<u4").tobytes()

    def fragments(self, word: str) -> list[str]:
        """A long word, cut where no piece spans two neighbouring letters."""
        if not len(self.spans):
            return list(word)
        codes = _codes([word])
        pair = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.spans, pair), len(self.spans) - 1)
        cuts = (np.flatnonzero(self.spans[at] != pair) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Put the words (with their marks) into the cache; if it is full, those not met since the time before go."""
        if len(self.cache) + len(words) > CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {}
        met = words & self.older.keys()
        self.cache.update((w, self.older[w]) for w in met)
        by: dict[int, list[str]] = {}
        cut: dict[str, list[str]] = {}
        for w in words - met:
            if len(w) <= LONG:
                by.setdefault(len(w), []).append(w)
            else:
                cut[w] = self.fragments(w)
        for f in {f for parts in cut.values() for f in parts}:
            by.setdefault(len(f), []).append(f)
        known: dict[str, bytes] = {}
        for n, group in by.items():
            most = max(1, BATCH // n)
            for at in range(0, len(group), most):
                part = group[at : at + most]
                known.update(zip(part, self.viterbi(part), strict=True))
        self.cache.update((w, known[w]) for w in words - met if w not in cut)
        self.cache.update((w, b"".join(map(known.__getitem__, parts))) for w, parts in cut.items())

    def blank_run(self, marks: int) -> bytes:
        """Pieces of marks merged from the left, all merges being equally good."""
        done: list[int] = []
        now, rest = 1, marks - 1
        while True:
            if done and done[-1] + now in self.blanks:
                now += done.pop()
            elif rest and now + 1 in self.blanks:
                now, rest = now + 1, rest - 1
            else:
                done.append(now)
                if not rest:
                    break
                now, rest = 1, rest - 1
        return np.array([self.blanks[n] for n in done], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian uint32 bytes."""
        if self.merges is None:
            cut = [_UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        else:
            cut = [[MARK + w for w in t.replace(MARK, " ").split(" ")] if t else [] for t in texts]
        words = set().union(*cut)
        if not words <= self.cache.keys():
            self.learn(words if len(self.cache) + len(words) > CACHE_WORDS // 2 else words - self.cache.keys())
        if self.merges is None or not self.blanks:
            return [b"".join(map(self.cache.__getitem__, u)) for u in cut]
        return [self._joined(u) if MARK in u else b"".join(map(self.cache.__getitem__, u)) for u in cut]

    def _joined(self, units: list[str]) -> bytes:
        """Ids of words, the bare marks between them merged into runs (with a word's own mark, if it stays alone)."""
        alone = np.array([self.blanks[1]], "<u4").tobytes()
        out, marks = [], 0
        for u in units:
            if u == MARK:
                marks += 1
                continue
            ids = self.cache[u]
            if marks:
                if ids[:4] == alone:
                    marks, ids = marks + 1, ids[4:]
                out.append(self.blank_run(marks))
                marks = 0
            out.append(ids)
        if marks:
            out.append(self.blank_run(marks))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


#: Marks and what follows them up to the next.
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_KNOWN: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    sole_cache("pieces", _KNOWN.clear)
    if path not in _KNOWN:
        _KNOWN[path] = Pieces(path)
    return _KNOWN[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids = model.encode([t or "" for t in part.column(1).to_pylist()])
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_byte_ids, same_text: ids encoded and decoded again, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        low, high = (min(model.bytes.values()), max(model.bytes.values())) if model.bytes else (0, -1)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for text, data in zip(texts, model.encode(texts), strict=True):
                    ids = np.frombuffer(data, "<u4")
                    rows.append((len(ids), zlib.crc32(data), int(((ids >= low) & (ids <= high)).sum()), model.decode(data) == text.replace(MARK, " ")))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "same_text"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, same_text boolean")


def op8_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op8_viterbi_pieces": op8_viterbi_pieces}
SQL: dict[str, str] = {}
