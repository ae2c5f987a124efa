"""Substring dedup: recurring phrases are confirmed, compiled to Aho-Corasick automata, and located in all documents."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import blocks as B

WINDOW = 20
PHRASE = 8
#: Characters that stand for a word in the automata.
LETTERS = 3
#: An automaton holds at most so many phrases (of LETTERS * PHRASE nodes each, about 80 MB in all); a block with more
#: phrases gets several automata, one after another.
SHARD = 100_000
NO_ID = -(1 << 63)
#: The part of a phrase's hash that is sent: enough to find candidates.
SENT = np.uint64(0xFFFFFFFFFFFF0000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for j in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return _mix(out)


class _Powers:
    """Powers of the odd factor of word hashes and of its inverse, modulo 2^64, and a number for each byte."""

    def __init__(self, factor: int, seed: int) -> None:
        self.factor = factor
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = []
            for f in (self.factor, pow(self.factor, -1, 1 << 64)):
                steps = np.full(n, f, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


#: Two hashes that have nothing in common: the first finds windows, both together say which are equal.
_FIRST, _SECOND = _Powers(0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes whose word hashes are computed at once.
SPAN = 1 << 19


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _FIRST) -> np.ndarray:
    """Hash of each word raw[start:end]: a polynomial of its bytes, read off running sums, and mixed with its length."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN, "right")))
        first = int(starts[at])
        up, down = powers.to(max(SPAN, int(ends[to - 1]) - first))
        piece = raw[first : ends[to - 1]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers.bytes[piece] * up[: len(piece)], dtype=np.uint64)])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


class _Words:
    """The words of a block in one row: their hashes, and the place where each word's document ends."""

    def __init__(self, sizes: list[int], blob: bytes) -> None:
        raw = np.frombuffer(B.expand(blob), np.uint8)
        inside = _IN_WORD[raw]
        limits = np.cumsum(np.array(sizes, np.int64))
        edge = np.zeros(len(raw) + 1, bool)
        edge[0] = True
        edge[limits] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (edge[:-1] | ~before[: len(raw)]))
        ends = np.flatnonzero(inside & (edge[1:] | ~after[: len(raw)])) + 1
        self.raw, self.word_starts, self.word_ends = raw, starts.astype(np.int32), ends.astype(np.int32)
        self.hashes = _word_hashes(raw, starts, ends)
        self.counts = np.bincount(np.searchsorted(limits, starts, "right"), minlength=len(sizes)).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        ends = np.repeat(self.starts + self.counts, self.counts)
        #: Places where a window begins that ends inside its document.
        self.window_at = (np.arange(len(ends)) + WINDOW <= ends)[: max(0, len(ends) - WINDOW + 1)]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rolling phrase hashes, the distinct least ones of all windows (sorted), and which of these occur twice.

        Equal windows hold equal phrases, so they have the same least one: a window recurs only if that phrase does.
        """
        g = _rolled(self.hashes, PHRASE)
        if not self.window_at.any():
            return g, np.zeros(0, np.uint64), np.zeros(0, bool)
        span = WINDOW - PHRASE + 1
        least, have = g & SENT, 1
        while 2 * have <= span:
            least, have = np.minimum(least[: len(least) - have], least[have:]), 2 * have
        more = span - have
        least = np.minimum(least[: len(least) - more], least[more:]) if more else least
        chosen = np.unique(least[self.window_at])
        every = np.sort(g & SENT)
        twice = np.searchsorted(every, chosen, "right") - np.searchsorted(every, chosen, "left") >= 2
        return g, chosen, twice

    def checks(self, at: np.ndarray) -> np.ndarray:
        """The second hash of the windows that begin ``at``; only words of these windows are read again."""
        edge = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]))
        hashes = np.zeros(len(self.hashes), np.uint64)
        hashes[inside] = _word_hashes(self.raw, self.word_starts[inside].astype(np.int64), self.word_ends[inside].astype(np.int64), _SECOND)
        return _rolled(hashes, WINDOW)[at]

    def _letters(self) -> str:
        """The block's words as a string, LETTERS characters each: the digits of the word's number.

        Each digit has an alphabet of its own, so a match begins where a word does; and nodes of the automata, which
        look for a child by going through all, have few.
        """
        distinct, numbers = np.unique(self.hashes, return_inverse=True)
        base = int(np.ceil((len(distinct) + 1) ** (1 / LETTERS))) + 1
        digits, rest = np.empty((len(numbers), LETTERS), np.uint32), numbers
        for d in reversed(range(LETTERS)):
            digits[:, d] = rest % base + 1 + d * base
            rest = rest // base
        return digits.tobytes().decode("utf-32-le")

    def located(self, g: np.ndarray, recurring: np.ndarray) -> np.ndarray:
        """Which places begin a window that holds one of the recurring phrases: where the automata find them.

        One place of each recurring phrase says what it reads; all its places come from the automata alone.  Documents
        are joined for them, as windows across their ends are ruled out below.
        """
        found = np.zeros(len(self.hashes) + 1, np.int64)
        first = np.argsort(g, kind="stable")
        first = first[np.concatenate([[True], g[first[1:]] != g[first[:-1]]])] if len(g) else first
        first = first[np.isin(g[first] & SENT, recurring)]
        text = self._letters()
        for at in range(0, len(first), SHARD):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in first[at : at + SHARD].tolist():
                automaton.add_word(text[LETTERS * p : LETTERS * (p + PHRASE)])
            automaton.make_automaton()
            ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
            found[(ends + 1) // LETTERS - PHRASE] = 1
        before = np.concatenate([[0], np.cumsum(found)])
        n = len(self.window_at)
        return self.window_at & (before[WINDOW - PHRASE + 1 :][:n] > before[:n])


def _window_table(w: _Words, candidate: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the candidate windows: distinct pairs of hashes in order, the first place of each, whether it occurs twice, and
    for each place its number among the pairs.  Places are in order of document id and start."""
    at = np.flatnonzero(candidate)
    h = _rolled(w.hashes, WINDOW)[at]
    check = w.checks(at)
    owner = np.searchsorted(w.starts, at, "right") - 1
    start = at - w.starts[owner]
    order = np.lexsort((start, doc_ids[owner], check, h))
    at, h, check, owner, start = at[order], h[order], check[order], owner[order], start[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]) if len(h) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    twice = np.diff(np.concatenate([firsts, [len(h)]])) >= 2
    return h[firsts], check[firsts], doc_ids[owner[firsts]], start[firsts], twice, at, number, new, doc_ids[owner], start


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in table.column("doc_id")[0].as_py()], np.int64)


def _block(table: pa.Table) -> _Words:
    return _Words(table.column("sizes")[0].as_py(), table.column("blob")[0].as_py())


def _rows(kind: str, rows: list[tuple]) -> pa.Table:
    names = {"key": ["bucket", "block", "blob"], "answer": ["block", "bucket", "blob"]}[kind]
    types = {"bucket": pa.int64(), "block": pa.int64(), "blob": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)})


KEY, ANSWER = "bucket long, block long, blob binary", "block long, bucket long, blob binary"


def _frame(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unframe(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _by_bucket(table: pa.Table, key: str) -> list[bytes]:
    """Blobs of one block's answers in the order of the buckets."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist()))
    return [blob for bucket, blob in rows if (bucket >= 0) == (key == "bucket")]


def _phrase_blob(keys: np.ndarray, twice: np.ndarray) -> bytes:
    return _frame([B.put(keys, True), np.packbits(twice).tobytes()])


def _window_blob(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, twice: np.ndarray, checks: np.ndarray) -> bytes:
    return _frame([B.put(hashes, True), B.put(docs), B.put(starts.astype(np.int32)), np.packbits(twice).tobytes(), B.put(checks)])


class _Phrases:
    """What blocks sent of their phrases to a bucket, and which of these occur at two places or more."""

    def __init__(self, blobs: list[bytes]) -> None:
        sent = [_unframe(x) for x in blobs]
        self.keys = [B.get(k, np.uint64, True) for k, _ in sent]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool) for (_, t), k in zip(sent, self.keys)]
        self.every = np.sort(np.concatenate(self.keys))
        shared = np.unique(self.every[1:][self.every[1:] == self.every[:-1]])
        self.recurring = np.union1d(shared, np.concatenate([k[t] for k, t in zip(self.keys, twice)]))

    def answers(self, recurring: np.ndarray) -> list[bytes]:
        return [np.packbits(np.isin(k, recurring)).tobytes() for k in self.keys]


class _Windows:
    """What blocks sent of their windows to a bucket, in the order of hashes and then places; equal windows are a group."""

    def __init__(self, blobs: list[bytes]) -> None:
        sent = [_unframe(x) for x in blobs]
        keys = [B.get(s[0], np.uint64, True) for s in sent]
        self.sizes = [len(k) for k in keys]
        twice = np.concatenate([np.unpackbits(np.frombuffer(s[3], np.uint8), count=n) for s, n in zip(sent, self.sizes)])
        h, c = np.concatenate(keys), np.concatenate([B.get(s[4], np.uint64) for s in sent])
        d, p = (np.concatenate([B.get(s[i], t) for s in sent]) for i, t in ((1, np.int64), (2, np.int32)))
        self.order = np.lexsort((p, d, c, h))
        self.h, self.c, self.d, self.p = h[self.order], c[self.order], d[self.order], p[self.order]
        new = np.concatenate([[True], (self.h[1:] != self.h[:-1]) | (self.c[1:] != self.c[:-1])]) if len(h) else np.zeros(0, bool)
        self.group, self.firsts = np.cumsum(new) - 1, np.flatnonzero(new)
        self.recurs = (np.bincount(self.group) >= 2) | (np.bincount(self.group, twice[self.order]) > 0)
        first = self.firsts[self.group]
        self.is_first = (self.d == self.d[first]) & (self.p == self.p[first])

    def answers(self, status: np.ndarray) -> list[bytes]:
        """For each block the status of its windows, from that of each group (0, or 1 if the first place of all is here,
        or 2): 0 for windows that don't recur, 1 if the block has the first place, 2 if not."""
        s = status[self.group]
        out = np.zeros(len(self.order), np.uint8)
        out[self.order] = np.where(s == 0, 0, np.where((s == 1) & self.is_first, 1, 2))
        return [B.put(x) for x in np.split(out, np.cumsum(self.sizes)[:-1])]


def _reply(table: pa.Table, blobs: list[bytes]) -> pa.Table:
    return _rows("answer", list(zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), blobs)))


def _confirm_phrases(table: pa.Table) -> pa.Table:
    """Of the phrases that the blocks sent to a bucket: which occur at two places or more."""
    p = _Phrases(table.column("blob").to_pylist())
    return _reply(table, p.answers(p.recurring))


def _confirm_windows(table: pa.Table) -> pa.Table:
    """Of the windows that the blocks sent to a bucket, the first places of those that recur.  Rows of buckets under 0 are
    what a block left for itself."""
    blobs = table.column("blob").to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        return _reply(table, blobs)
    w = _Windows(blobs)
    return _reply(table, w.answers(w.recurs.astype(np.uint8)))


def _relay_phrases(n_buckets: int):
    """A relay's two halves for phrases."""

    def merge(table: pa.Table) -> pa.Table:
        p, relay = _Phrases(table.column("blob").to_pylist()), table.column("relay")[0].as_py()
        keys = np.unique(p.every)
        twice = np.isin(keys, p.recurring)
        return _rows("key", [(b, relay, _phrase_blob(keys[s:e], twice[s:e])) for b, (s, e) in enumerate(itertools.pairwise(B.cuts(keys, n_buckets))) if e > s])

    def hand_back(table: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Phrases(table.column("blob").to_pylist())
        keys = np.unique(p.every)
        sizes = [e - s for s, e in itertools.pairwise(B.cuts(keys, n_buckets)) if e > s]
        masks = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(_by_bucket(answers, "bucket"), sizes, strict=True)]
        return _reply(table, p.answers(keys[np.concatenate(masks).astype(bool)]))

    return merge, hand_back


def _relay_windows(n_buckets: int):
    """A relay's two halves for windows: each goes on once, with the first place that the relay knows."""

    def merge(table: pa.Table) -> pa.Table:
        w, relay = _Windows(table.column("blob").to_pylist()), table.column("relay")[0].as_py()
        h, c, d, p = (x[w.firsts] for x in (w.h, w.c, w.d, w.p))
        cuts = itertools.pairwise(B.cuts(h, n_buckets))
        return _rows("key", [(b, relay, _window_blob(h[s:e], d[s:e], p[s:e], w.recurs[s:e], c[s:e])) for b, (s, e) in enumerate(cuts) if e > s])

    def hand_back(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Windows(table.column("blob").to_pylist())
        return _reply(table, w.answers(np.concatenate([B.get(x, np.uint8) for x in _by_bucket(answers, "bucket")])))

    return merge, hand_back


def remove_repeats(docs: DataFrame, *, block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN, digest: bool = False) -> DataFrame:
    """Remove the words of 20-word windows that start earlier elsewhere: (doc_id, n_words, n_removed, kept_text).

    A window is 20 consecutive words of a document; it is removed if the same words also start earlier: in a document
    with a smaller doc_id, or before in the same one.  Windows are judged on the input.  kept_text is what is left,
    joined by one space; with ``digest`` it is replaced by kept_sha256, its lowercase hex SHA-256.

    Way: (1) each block of documents sends the distinct least phrases (8 words) of its windows to buckets, which confirm
    those that occur at two places or more.  (2) Each block compiles its confirmed phrases to Aho-Corasick automata, in
    shards of bounded size, and streams all its documents through them; windows that hold an occurrence are candidates,
    and their hashes go to buckets, once a block, with the first place in the block.  Buckets find the first place of
    all.  (3) Each block marks the words of windows that aren't the first and returns what is left.  Beyond ``fan`` buckets
    relays stand between blocks and buckets (``blocks.exchange``).  Windows are equal if
    two independent 64-bit hashes of them are.  doc_id must be of an integer type.

    Null and empty texts have no words and stay as empty.  A null id counts as smaller than all others.  Places compare
    by (doc_id, start) alone, so of rows with equal ids neither is earlier at the same start, and both stay.  Other
    columns are ignored; empty input gives empty output.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = B.pack(d, block_bytes=block_bytes)
    n_blocks = B.count(packed)
    all_buckets = B.bucket_count(n_blocks, block_bytes // 40)
    n_buckets = B.first_level(all_buckets, fan)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                _, chosen, twice = _block(row).phrases()
                at = B.cuts(chosen, n_buckets)
                block = row.column("block")[0].as_py()
                rows = [(b, block, _phrase_blob(chosen[s:e], twice[s:e])) for b, (s, e) in enumerate(itertools.pairwise(at)) if e > s]
                yield from _rows("key", rows).to_batches()

    phrases = B.exchange(packed.mapInArrow(keyed, KEY), n_blocks, all_buckets, fan, _confirm_phrases, *_relay_phrases(all_buckets), KEY, ANSWER)

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = _block(table)
        g, chosen, _ = w.phrases()
        at = B.cuts(chosen, n_buckets)
        sizes = [e - s for s, e in itertools.pairwise(at) if e > s]
        masks = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(_by_bucket(answers, "bucket"), sizes, strict=True)]
        recurring = chosen[np.concatenate([*masks, np.zeros(0, np.uint8)]).astype(bool)]
        candidate = w.located(g, recurring)
        hashes, checks, firsts, starts, twice, *_ = _window_table(w, candidate, _ids(table))
        block = table.column("block")[0].as_py()
        rows = [(-1 - block, block, B.squeeze(np.packbits(candidate).tobytes()))]
        for b, (s, e) in enumerate(itertools.pairwise(B.cuts(hashes, n_buckets))):
            if e > s:
                rows.append((b, block, _window_blob(hashes[s:e], firsts[s:e], starts[s:e], twice[s:e], checks[s:e])))
        return _rows("key", rows)

    located = B.by_block(packed, phrases, candidates, KEY)
    windows = B.exchange(located, n_blocks, all_buckets, fan, _confirm_windows, *_relay_windows(all_buckets), KEY, ANSWER)
    last = "kept_sha256" if digest else "kept_text"

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = _block(table)
        n = len(w.window_at)
        candidate = np.unpackbits(np.frombuffer(B.expand(_by_bucket(answers, "self")[0]), np.uint8), count=n).astype(bool)
        *_, at, number, new, owner_ids, start = _window_table(w, candidate, _ids(table))
        status = np.concatenate([*[B.get(x, np.uint8) for x in _by_bucket(answers, "bucket")], np.zeros(0, np.uint8)])
        mine = status[number]
        first = np.flatnonzero(new)[number] if len(number) else number
        is_first = (owner_ids == owner_ids[first]) & (start == start[first])
        gone = at[(mine == 2) | ((mine == 1) & ~is_first)]
        edge = np.zeros(len(w.hashes) + WINDOW + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        kept = np.cumsum(edge)[: len(w.hashes)] == 0
        out = []
        for raw, s in zip(B.texts(table.column("sizes")[0].as_py(), table.column("blob")[0].as_py()), w.starts.tolist()):
            words = raw.split()
            mask = kept[s : s + len(words)]
            left = words if mask.all() else list(itertools.compress(words, mask.tolist()))
            text = b" ".join(left)
            out.append((len(words), len(words) - len(left), hashlib.sha256(text).hexdigest() if digest else text.decode()))
        ids = pa.array(table.column("doc_id")[0].as_py(), pa.int64())
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.table([ids, *columns], names=["doc_id", "n_words", "n_removed", last])

    return B.by_block(packed, windows, removed, f"doc_id long, n_words long, n_removed long, {last} string")


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 20) AS q(j) WHERE k > 1),
a AS (SELECT doc_id, list(p) AS ats, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(a.n, 0)::bigint AS n_removed,
       sha256(array_to_string(CASE WHEN a.n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(a.ats, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
