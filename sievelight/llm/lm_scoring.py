"""LM scoring by prediction by partial matching: a byte-context trie, escapes, and symbol exclusion."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import blocks as B
from sievelight.llm.common import checkpoint

#: Bytes of the longest context: with the symbol after it, 48 bits.
ORDER = 5
#: Contexts of up to so many bytes are kept in one table of at most 2^24 entries; longer ones are dealt to buckets.
LOW = 2
CHUNK = 2 << 20
LEAD = b"\n" * ORDER

KEY, ANSWER = "kind int, bucket long, block long, n long, blob binary", "kind int, block long, bucket long, blob binary"
WORDS, GRAMS, LOWS = 0, 1, 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _bucket_keys(codes: np.ndarray, n_buckets: int) -> np.ndarray:
    """What deals a gram to a bucket: leading bits of a hash of its last three context bytes, so contexts stay together."""
    spare = np.uint64(64 - (n_buckets.bit_length() - 1))
    return (_mix((codes >> np.uint64(8)) & np.uint64(0xFFFFFF)) >> spare) << spare


def _stream(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams of the texts (the context's bytes and the symbol) and the number of each one's text.

    A text is its words joined by one space, and a line feed that ends it; what stands before it are line feeds.
    """
    parts = [b"".join([LEAD, b" ".join(w), b"\n"]) for w in words]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    code = np.zeros(max(0, len(raw) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        code = (code << np.uint64(8)) | raw[j : len(raw) - ORDER + j]
    owner = np.repeat(np.arange(len(parts)), sizes - ORDER)
    starts = np.repeat(np.cumsum(sizes) - sizes - np.concatenate([[0], np.cumsum(sizes - ORDER)[:-1]]), sizes - ORDER)
    return code[np.arange(len(owner)) + starts], owner


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts, A-Z in lower case, in runs of texts of about CHUNK bytes, with the number of the first text."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t.lower().split())
        size += len(t)
        if size >= CHUNK:
            yield first, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, held


def _sum_sorted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def _grams(texts: list[bytes], training: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block by bucket and code, and how often each occurs in training texts."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, words in _chunks(texts):
        code, owner = _stream(words)
        code = np.sort((code << np.uint64(1)) | training[first + owner].astype(np.uint64))
        k, n = _sum_sorted(code >> np.uint64(1), (code & np.uint64(1)).astype(np.int64))
        keys.append(k)
        counts.append(n)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = _sum_sorted(k[order], n[order])
    order = np.argsort(_bucket_keys(k, n_buckets), kind="stable")
    return k[order], n[order]


class _Counted:
    """Words of a block: distinct words' hashes in order, and how often each occurs in training texts."""

    def __init__(self, texts: list[bytes], training: np.ndarray) -> None:
        known = B.Vocabulary()
        self.numbers = [known.numbers(t.lower().split()) for t in texts]
        counts = np.zeros(len(known), np.int64)
        for n, learn in zip(self.numbers, training):
            if learn:
                np.add.at(counts, n, 1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 2) for w in known), np.uint64, len(known))
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[self.order], counts[self.order]


def _answer(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "block", "bucket", "blob"])


def _key_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["kind", "bucket", "block", "n", "blob"])


def _counts(sent: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys by block, all distinct keys, their sums, and each sent key's place among them."""
    keys, counts = [], []
    for x in sent:
        n = int.from_bytes(x[:8], "little")
        keys.append(B.get(x[8 : 8 + n], np.uint64, True))
        counts.append(B.get(x[8 + n :], np.int64))
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, every, np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64), place


def _sent(keys: np.ndarray, counts: np.ndarray) -> bytes:
    k = B.put(keys, True)
    return len(k).to_bytes(8, "little") + k + B.put(counts)


def _lead(kind: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """What deals sorted keys to buckets."""
    return keys if kind == WORDS else _bucket_keys(keys, n_buckets)


def _relay(n_buckets: int):
    """The two halves of a relay: sums of what blocks sent for the buckets, and the buckets' answers for the blocks."""

    def merge(table: pa.Table) -> pa.Table:
        kind, relay = table.column("kind")[0].as_py(), table.column("relay")[0].as_py()
        _, keys, n, _ = _counts(table.column("blob").to_pylist())
        lead = _lead(kind, keys, n_buckets)
        order = np.argsort(lead, kind="stable")
        keys, n = keys[order], n[order]
        rows = [(kind, b, relay, 0, _sent(keys[s:e], n[s:e])) for b, (s, e) in enumerate(itertools.pairwise(B.cuts(lead[order], n_buckets))) if e > s]
        return pa.Table.from_batches([_key_rows(rows)])

    def hand_back(table: pa.Table, answers: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        sent, keys, _, place = _counts(table.column("blob").to_pylist())
        got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
        values = np.concatenate([B.get(x, np.int64 if kind == WORDS else np.float32) for _, x in got])
        by_key = np.empty_like(values)
        by_key[np.argsort(_lead(kind, keys, n_buckets), kind="stable")] = values
        at = np.cumsum([len(k) for k in sent])[:-1]
        return _answer([(kind, block, bucket, B.put(x)) for block, x in zip(table.column("block").to_pylist(), np.split(by_key[place], at))])

    return merge, hand_back


class Trie:
    """Log10 probabilities of symbols after contexts of at most ORDER bytes, by counts (PPM, escape method D).

    At each order the symbols seen in the context that was escaped from are excluded.  As every place counts for all
    orders, those symbols are seen at the lower order too, so what they take off there is a sum that their context has.
    A symbol counted n times among t of what is left, of d kinds, gets (2n - 1) / 2t, and the escape d / 2t.  Below the
    order of no context the bytes that were never seen share what is left evenly.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """grams, counts: all grams of LOW bytes of context, with counts over all training texts."""
        seen = counts > 0
        self.low = {LOW: (grams[seen], counts[seen])}
        for k in range(LOW - 1, -1, -1):
            g, n = self.low[k + 1]
            g = g & np.uint64((1 << (8 * (k + 1))) - 1)
            order = np.argsort(g, kind="stable")
            self.low[k] = _sum_sorted(g[order], n[order])

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys), values.dtype)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], values.dtype.type(0))

    def log10(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For distinct grams of ORDER bytes of context that hold all grams with the same last three context bytes."""
        levels = {}
        seen = counts > 0
        g, n = grams[seen], counts[seen]
        for k in range(ORDER, LOW, -1):
            key = g & np.uint64((1 << (8 * (k + 1))) - 1)
            order = np.argsort(key, kind="stable")
            levels[k] = _sum_sorted(key[order], n[order])
        levels |= self.low
        out = np.zeros(len(grams))
        coded = np.zeros(len(grams), bool)
        off_t, off_d = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for k in range(ORDER, -1, -1):
            key, n = levels[k]
            context = key >> np.uint64(8)
            new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.zeros(0, np.int64)
            contexts = context[new]
            total = np.add.reduceat(n, new) if len(new) else n
            kinds = np.diff(np.concatenate([new, [len(key)]]))
            lower = self._find(levels[k - 1][0], key & np.uint64((1 << (8 * k)) - 1), levels[k - 1][1]) if k else n
            below = np.add.reduceat(lower, new) if len(new) else lower
            mine = grams & np.uint64((1 << (8 * (k + 1))) - 1)
            own = self._find(key, mine, n)
            c = mine >> np.uint64(8)
            t, d, e = (self._find(contexts, c, x) for x in (total, kinds, below))
            left, fresh = t - off_t, d - off_d
            hit = ~coded & (own > 0)
            out[hit] += np.log10((2 * own[hit] - 1) / (2.0 * left[hit]))
            coded |= hit
            escape = ~coded & (t > 0)
            go = escape & (left > 0)
            out[go] += np.log10(fresh[go] / (2.0 * left[go]))
            off_t, off_d = np.where(escape, e, off_t), np.where(escape, d, off_d)
        out[~coded] -= np.log10(256.0 - off_d[~coded])
        return out


def score_texts(docs: DataFrame, held_out, *, block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN) -> DataFrame:
    """Score every text by models of the texts for which the boolean column ``held_out`` is not true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.  Tokens are the words of the text,
    A-Z in lower case, and one end.  base_score is the add-one unigram log10 probability of the tokens; score is that of
    the same tokens, written with one space between them and a line feed at the end, by the byte trie of ``Trie``.

    Way: (1) blocks of texts sum up their distinct words and grams (context and symbol) with their training counts and
    send each once to a bucket.  Grams with the same last three context bytes share a bucket, which so holds whole
    contexts of the higher orders; the counts of the orders up to LOW are one table of at most 2^24 entries.  (2) Buckets
    answer each block's words with their counts in the corpus and its grams with their log10 probabilities; beyond ``fan``
    buckets relays stand between (``blocks.exchange``).  (3) Blocks add them up.  All counts are of all training texts; what is sent grows with them.

    Null and empty texts have one token, their end.  A null id or null flag counts as not held out.  Without training
    texts no token is known and every byte costs log10 of 256.  Words are told apart by 64-bit hashes.  Rows count one
    by one; other columns are ignored; empty input gives empty output.
    """
    d = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    id_type = d.schema["doc_id"].dataType.simpleString()
    packed = B.pack(d, ("doc_id", "held_out"), block_bytes)
    n_blocks = B.count(packed)
    all_buckets = B.bucket_count(n_blocks, block_bytes // 16)
    n_buckets = B.first_level(all_buckets, fan)
    spark = docs.sparkSession

    def parts(row: pa.Table | pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
        texts = B.texts(row.column("sizes")[0].as_py(), row.column("blob")[0].as_py())
        return texts, ~np.array(row.column("held_out")[0].as_py(), bool)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, (texts, training) = row.column("block")[0].as_py(), parts(row)
                words = _Counted(texts, training)
                rows = [
                    (WORDS, b, block, 0, _sent(words.hashes[s:e], words.counts[s:e]))
                    for b, (s, e) in enumerate(itertools.pairwise(B.cuts(words.hashes, n_buckets)))
                    if e > s
                ]
                grams, n = _grams(texts, training, n_buckets)
                for b, (s, e) in enumerate(itertools.pairwise(B.cuts(_bucket_keys(grams, n_buckets), n_buckets))):
                    if e > s:
                        rows.append((GRAMS, b, block, 0, _sent(grams[s:e], n[s:e])))
                low = grams[n > 0] & np.uint64((1 << (8 * (LOW + 1))) - 1)
                order = np.argsort(low, kind="stable")
                rows.append((LOWS, -1, block, int(training.sum()), _sent(*_sum_sorted(low[order], n[n > 0][order]))))
                yield _key_rows(rows)

    sent = checkpoint(packed.mapInArrow(keyed, KEY))

    def low_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                _, k, n, _ = _counts([blob])
                k, n = np.concatenate([total[0], k]), np.concatenate([total[1], n])
                order = np.argsort(k, kind="stable")
                total = _sum_sorted(k[order], n[order])
        yield pa.RecordBatch.from_arrays([pa.array(total[0].astype(np.int64)), pa.array(total[1])], ["gram", "n"])

    lows = sent.where(F.col("kind") == LOWS)
    low = lows.select("blob").mapInArrow(low_rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    low = low.toArrow().sort_by("gram")  # at most 2^24 rows, a few ten thousand in natural text
    trie = spark.sparkContext.broadcast(Trie(low.column("gram").to_numpy().astype(np.uint64), low.column("n").to_numpy().astype(np.int64)))
    ends = lows.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long"))).first()[0]

    def distinct(table: pa.Table) -> pa.Table:
        _, _, n, _ = _counts(table.column("blob").to_pylist())
        return pa.table([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["v", "n"])

    vocabulary = sent.where(F.col("kind") == WORDS).select("bucket", "blob").groupBy("bucket").applyInArrow(distinct, "v long, n long")
    v, n_tokens = vocabulary.agg(F.coalesce(F.sum("v"), F.lit(0).cast("long")), F.coalesce(F.sum("n"), F.lit(0).cast("long"))).first()
    v, n_tokens = v + (ends > 0), n_tokens + ends

    def answered(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, every, n, place = _counts(table.column("blob").to_pylist())
        values = n if kind == WORDS else trie.value.log10(every, n).astype(np.float32)
        at = np.cumsum([len(k) for k in keys])[:-1]
        return _answer([(kind, block, bucket, B.put(x)) for block, x in zip(table.column("block").to_pylist(), np.split(values[place], at))])

    answers = B.exchange(sent.where(F.col("kind") != LOWS), n_blocks, all_buckets, fan, answered, *_relay(all_buckets), KEY, ANSWER, ["kind"])

    def scored(row: pa.Table, answers: pa.Table) -> pa.Table:
        texts, training = parts(row)
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "blob"))))
        counts = np.concatenate([*[B.get(x, np.int64) for k, _, x in got if k == WORDS], np.zeros(0, np.int64)])
        costs = np.concatenate([*[B.get(x, np.float32) for k, _, x in got if k == GRAMS], np.zeros(0, np.float32)])
        words = _Counted(texts, training)
        by_number = np.empty(len(counts), np.int64)
        by_number[words.order] = counts
        logs = np.log10(by_number + 1.0)
        tokens = np.array([len(x) + 1 for x in words.numbers], np.int64)
        known = np.array([int((by_number[x] > 0).sum()) + (ends > 0) for x in words.numbers], np.int64)
        base = np.array([float(logs[x].sum()) for x in words.numbers]) + np.log10(ends + 1.0) - tokens * np.log10(n_tokens + v + 1.0)
        del words
        grams, _ = _grams(texts, training, n_buckets)
        order = np.argsort(grams, kind="stable")
        grams, costs = grams[order], costs[order].astype(np.float64)
        score = np.zeros(len(texts))
        for first, chunk in _chunks(texts):
            code, owner = _stream(chunk)
            if len(chunk) <= 1 << 16:  # the text's number fits beside the gram, so one plain sort brings equal grams together
                packed_keys = np.sort((code << np.uint64(16)) | owner.astype(np.uint64))
                code, owner = packed_keys >> np.uint64(16), (packed_keys & np.uint64(0xFFFF)).astype(np.int64)
            new = np.concatenate([[True], code[1:] != code[:-1]])
            cost = costs[np.searchsorted(grams, code[new])][np.cumsum(new) - 1]
            score[first : first + len(chunk)] += np.bincount(owner, cost, len(chunk))
        ids = row.column("doc_id")[0].values
        columns = [ids, pa.array(~training), pa.array(tokens), pa.array(known), pa.array([n_tokens] * len(texts), pa.int64()), pa.array(base), pa.array(score)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return B.by_block(packed, answers, scored, schema)


def op2_lm_scoring(docs: DataFrame) -> DataFrame:
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
