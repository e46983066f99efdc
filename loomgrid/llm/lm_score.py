"""Language-model scores by stupid backoff, from n-gram count tables of the whole corpus.

1. Distinct words of chunks meet by hash (compared by their bytes); that is the table of unigram counts,
   in which every word that occurs twice gets a number. Chunks become streams of these numbers.
2. A chunk lists its distinct bigrams of numbered words with their counts; the bigram count table,
   partitioned by hash, adds them up and numbers those that occur twice.
3. Likewise trigrams, as pairs of a numbered bigram and a numbered word. An n-gram with a part that occurs
   once occurs once itself and is never sent. A frequent n-gram is one entry of each chunk.
4. The counts are joined back to the chunk's n-grams, exploded by position, and summed per document.

N-grams are exchanged as numbers, not as hashes, so no two are ever taken for one, and counts have 64 bits.

The score of a word is c(uvw) / c(uv) where c(uvw) is at least ``MIN_COUNT``; else ``ALPHA`` times
c(vw) / c(v) where c(vw) is at least that; else ``ALPHA`` squared times c(w) / N. At the start of a
document the context is shorter and is not a backoff. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
lower-cased; all counts are over all documents, the scored one included.

Defined cases: null, empty and wordless texts have no words and a score of 0 (and no mean); repeated
rows count as often as they occur, and rows that share an id stay rows of their own; null ids stay null;
an empty table gives an empty result; other columns are ignored. What is held of a chunk (or of the longest
text) is about 60 bytes for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as pk
from . import textbatch as tb
from . import vocabulary as vc
from .store import cut, drop

ALPHA = 0.4
MIN_COUNT = 2
ORDERS = (1, 2, 3)
CHUNK_BYTES = 4 << 20


def _split(data, offsets):
    data = tb.LOWER[data]

    def pieces():
        for lo, hi in tb.pieces(data, tb.NON_SPACE):
            first, last = np.searchsorted(offsets, [lo, hi])
            own = np.concatenate(([0], offsets[first:last] - lo, [hi - lo]))
            starts, ends, _ = tb.words(data[lo:hi], own, tb.NON_SPACE)
            yield lo, hi, starts + lo, ends + lo

    return data, pieces()


class Pairs:
    """Pairs of numbers as keys: spread over one word of 64 bits where both fit in it, else over two."""

    def __init__(self, first: int, second: int):
        """The largest number on each side."""
        self.low = max(1, int(second).bit_length())
        self.bits = max(8, int(first).bit_length() + self.low)
        self.narrow = self.bits <= 64

    def keys(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Keys that are equal only for equal pairs."""
        p, q = p.astype(np.uint64), q.astype(np.uint64)
        if not self.narrow:
            out = np.empty(len(p), [("v", "<u8"), ("p", "<u8")])
            out["v"], out["p"] = tb.mix(tb.mix(p) ^ q), p  # with p given, a bijection of q
            return out
        # Odd factors and shifts are bijections of numbers of so many bits.
        x, mask, half = p << np.uint64(self.low) | q, np.uint64((1 << self.bits) - 1), np.uint64(self.bits // 2)
        for odd in (0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407):
            x = (x * np.uint64(odd)) & mask
            x ^= x >> half
        return x

    def packets(self, known: np.ndarray, counts: np.ndarray, buckets: int):
        """(bucket, keys, further keys, counts) of distinct keys in rising order."""
        lead = known << np.uint64(64 - self.bits) if self.narrow else known["v"]
        bounds = pk.bounds_of(lead, buckets)
        for j in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[j], bounds[j + 1])
            keys = known[part] if self.narrow else known["v"][part]
            yield j, pk.pack_rising(keys), None if self.narrow else pk.pack(known["p"][part]), pk.pack(counts[part])

    def opened(self, keys: bytes, more: bytes | None) -> np.ndarray:
        first = pk.unpack_rising(keys)
        if self.narrow:
            return first
        out = np.empty(len(first), [("v", "<u8"), ("p", "<u8")])
        out["v"], out["p"] = first, pk.unpack(more)
        return out


_PACKET = "chunk long, bucket int, keys binary, more binary, counts binary"
_BACK = "chunk long, bucket int, totals binary, numbers binary, top long"


def _packet_batch(chunk: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    arrays = [pa.array([chunk] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))]
    return pa.RecordBatch.from_arrays(arrays, names=["chunk", "bucket", "keys", "more", "counts"])


def _add(pairs: Pairs, buckets: int):
    """The count table of one hash range, handed back to each chunk in the chunk's own order, with numbers from 1."""

    def run(table: pa.Table) -> pa.Table:
        tb.tidy()
        keys = [pairs.opened(k.as_py(), m.as_py()) for k, m in zip(table.column("keys"), table.column("more"))]
        counts = np.concatenate([pk.unpack(x.as_py()) for x in table.column("counts")])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(int(back.max()) + 1, np.uint64)
        np.add.at(totals, back, counts)
        again = totals > 1
        numbers = np.where(again, (np.cumsum(again) - 1) * buckets + table.column("bucket")[0].as_py() + 1, 0)
        ends = np.cumsum([len(k) for k in keys])
        parts = [back[e - len(k) : e] for k, e in zip(keys, ends)]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "totals": pa.array([pk.pack(totals[p]) for p in parts], pa.binary()),
                "numbers": pa.array([pk.pack(numbers[p]) for p in parts], pa.binary()),
                "top": pa.array([int(numbers.max())] * len(parts), pa.int64()),
            }
        )

    return run


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(pk.unpack(x.as_py()) for x in table.sort_by("bucket").column(name))])


class Stream:
    """The words of a chunk as numbers (0 for those that occur once in all), with their counts."""

    def __init__(self, row):
        tb.tidy()
        get = lambda c: pk.unpack(row.column(c)[0].as_py())
        self.sizes = get("sizes").astype(np.int64)
        stream = pk.unpack_skewed(row.column("stream")[0].as_py())
        self.words, self.counts = get("numbers")[stream], get("totals")[stream]
        self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def within(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each place on are of one text."""
        m = max(0, len(self.owner) - n + 1)
        return self.owner[:m] == self.owner[len(self.owner) - m :]

    def bigrams(self) -> np.ndarray:
        """Places of bigrams that may occur twice."""
        return np.flatnonzero(self.within(2) & (self.words[:-1] > 0) & (self.words[1:] > 0)) if len(self.words) > 1 else np.empty(0, np.int64)

    def trigrams(self, bigrams: np.ndarray) -> np.ndarray:
        """Places of trigrams that may occur twice, from the numbers of the bigrams at all places."""
        if len(self.words) < 3:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.within(3) & (bigrams[:-2] > 0) & (bigrams[1:-1] > 0))

    def spread(self, at: np.ndarray, keys: np.ndarray, back: pa.Table, name: str, rest: int) -> np.ndarray:
        """A column of the count table at all places; ``rest`` where no n-gram was sent."""
        out = np.full(len(self.words), rest, np.uint64)
        if len(at):
            out[at] = _column(back, name)[np.unique(keys, return_inverse=True)[1]]
        return out


def _scores(stream: Stream, c2: np.ndarray, c3: np.ndarray, min_count: int, alpha: float):
    """Per text: sum of logarithms without the corpus size, and how often each order was used.

    ``c2`` and ``c3`` are the counts of the n-grams that begin at each place.
    """
    total, sizes = len(stream.words), stream.sizes
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    c1 = stream.counts.astype(float)
    value = np.log(c1)
    used = np.ones(total, np.int8)
    backed = np.zeros(total, np.int8)  # steps of backoff
    if total > 1:
        two = np.flatnonzero(stream.within(2) & (c2[:-1] >= min_count)) + 1
        value[two] = np.log(c2[two - 1].astype(float)) - np.log(c1[two - 1])
        used[two] = 2
        backed[(place >= 1) & (used == 1)] += 1
    if total > 2:
        three = np.flatnonzero(stream.within(3) & (c3[:-2] >= min_count)) + 2
        value[three] = np.log(c3[three - 2].astype(float)) - np.log(c2[three - 2].astype(float))
        used[three] = 3
        backed[(place >= 2) & (used < 3)] += 1
        backed[three] = 0
    value += backed * np.log(alpha)
    n, owner = len(sizes), stream.owner
    return np.bincount(owner, value, n), [np.bincount(owner[used == k], minlength=n) for k in ORDERS]


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_count: int = MIN_COUNT, wide: bool = False
) -> DataFrame:
    """Per document: doc_id, n_words, n_tri, n_bi, n_uni (words by the order used), log_score, mean_log_score.

    ``wide`` has n-grams exchanged as two numbers even where one would do.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def add_words(table: pa.Table) -> pa.Table:
        tb.tidy()
        heads, lists = vc.parted(table)
        number: dict[bytes, int] = {}
        places = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in vc.list_words(lists)]
        totals = np.zeros(len(number), np.uint64)
        for p, times in zip(places, lists.column("times")):
            totals[p] += pk.unpack(times.as_py())
        # Numbers follow the words, whatever order the lists came in.
        rank = np.empty(len(number), np.int64)
        rank[[number[w] for w in sorted(number)]] = np.arange(len(number))
        bucket = table.column("bucket")[0].as_py()
        numbers = np.where(totals > 1, rank * buckets + bucket + 1, 0)
        lists = lists.select(["chunk", "bucket", "sum"])
        lists = lists.append_column("totals", pa.array([pk.pack(totals[p]) for p in places], pa.binary()))
        lists = lists.append_column("numbers", pa.array([pk.pack(numbers[p]) for p in places], pa.binary()))
        return vc.with_heads(heads, lists)

    def streams(table: pa.Table) -> pa.Table:
        tb.tidy()
        head, lists, slot = vc.unite(table)
        made = {name: _column(lists, name)[slot] for name in ("totals", "numbers")}
        columns = {name: head.column(name) for name in ("chunk", "docs", "sizes", "stream")}
        columns |= {name: pa.array([pk.pack(x, 3)], pa.binary()) for name, x in made.items()}
        return pa.table(columns | {"top": pa.array([int(made["numbers"].max(initial=0))], pa.int64())})

    words = (
        vc.word_lists(base, _split, buckets, CHUNK_BYTES)
        .groupBy("bucket").applyInArrow(add_words, vc.head_schema(base) + ", sum long, totals binary, numbers binary")
        .groupBy("chunk").applyInArrow(streams, f"chunk long, docs array<{kind}>, sizes binary, stream binary, totals binary, numbers binary, top long")
    )
    words = cut(words, "lm-words")
    top = words.agg(F.max("top")).first()[0] or 0
    two = Pairs(top, top if not wide else 1 << 63)

    def list_bigrams(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stream = Stream(batch.slice(i, 1))
                at = stream.bigrams()
                known, counts = np.unique(two.keys(stream.words[at], stream.words[at + 1]), return_counts=True)
                yield _packet_batch(batch.column("chunk")[i].as_py(), list(two.packets(known, counts, buckets)))

    bigrams = words.select("chunk", "sizes", "stream", "totals", "numbers").mapInArrow(list_bigrams, _PACKET)
    bigrams = cut(bigrams.groupBy("bucket").applyInArrow(_add(two, buckets), _BACK), "lm-bigrams")
    three = Pairs(bigrams.agg(F.max("top")).first()[0] or 0, top if not wide else 1 << 63)

    def bigrams_of(stream: Stream, back: pa.Table):
        at = stream.bigrams()
        keys = two.keys(stream.words[at], stream.words[at + 1])
        numbers = stream.spread(at, keys, back, "numbers", 0)
        return at, keys, numbers

    def list_trigrams(row: pa.Table, back: pa.Table) -> pa.Table:
        stream = Stream(row)
        numbers = bigrams_of(stream, back)[2]
        at = stream.trigrams(numbers)
        known, counts = np.unique(three.keys(numbers[at], stream.words[at + 2]), return_counts=True)
        return pa.Table.from_batches([_packet_batch(row.column("chunk")[0].as_py(), list(three.packets(known, counts, buckets)))])

    def finish(row: pa.Table, back: pa.Table) -> pa.Table:
        stream = Stream(row)
        is_bigram = pc.equal(back.column("n"), 2)
        own = back.filter(is_bigram)
        at, keys, numbers = bigrams_of(stream, own)
        c2 = stream.spread(at, keys, own, "totals", 1)
        del keys
        at = stream.trigrams(numbers)
        c3 = stream.spread(at, three.keys(numbers[at], stream.words[at + 2]), back.filter(pc.invert(is_bigram)), "totals", 1)
        value, used = _scores(stream, c2, c3, min_count, alpha)
        ids = row.column("docs").combine_chunks()[0].values
        return pa.table({"doc_id": ids, "n_words": stream.sizes, "n_tri": used[2], "n_bi": used[1], "n_uni": used[0], "value": value})

    rows = words.select("chunk", "docs", "sizes", "stream", "totals", "numbers")
    trigrams = rows.groupBy("chunk").cogroup(bigrams.groupBy("chunk")).applyInArrow(list_trigrams, _PACKET)
    trigrams = cut(trigrams.groupBy("bucket").applyInArrow(_add(three, buckets), _BACK), "lm-trigrams")
    back = bigrams.withColumn("n", F.lit(2)).unionByName(trigrams.withColumn("n", F.lit(3)))
    counted = (
        rows.groupBy("chunk").cogroup(back.groupBy("chunk"))
        .applyInArrow(finish, f"doc_id {kind}, n_words long, n_tri long, n_bi long, n_uni long, value double")
    )
    counted = cut(counted, "lm-scores")
    drop(words, bigrams, trigrams)
    size = counted.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.round(F.col("value") - F.col("n_uni") * F.log(F.lit(float(size))), 4)
    return counted.select(
        "doc_id", "n_words", "n_tri", "n_bi", "n_uni", log_score.alias("log_score"),
        F.when(F.col("n_words") > 0, F.round(log_score / F.col("n_words"), 4)).alias("mean_log_score"),
    )


#: The same scores in SQL, for the production parameters.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
t AS (SELECT doc_id, i, w, lag(w) OVER x AS v, lag(w, 2) OVER x AS u FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
n AS (SELECT sum(c)::DOUBLE AS n FROM c1),
s AS (SELECT doc_id, i,
  CASE WHEN c3.c >= 2 THEN 3 WHEN c2.c >= 2 THEN 2 ELSE 1 END AS used,
  CASE WHEN c3.c >= 2 THEN ln(c3.c) - ln(x2.c)
       WHEN c2.c >= 2 THEN ln(c2.c) - ln(x1.c) + CASE WHEN i >= 2 THEN ln(0.4::DOUBLE) ELSE 0 END
       ELSE ln(c1.c) - ln(n.n) + least(i, 2) * ln(0.4::DOUBLE) END AS value
  FROM t JOIN c1 USING (w) CROSS JOIN n
  LEFT JOIN c2 ON t.v = c2.v AND t.w = c2.w
  LEFT JOIN c1 x1 ON t.v = x1.w
  LEFT JOIN c3 ON t.u = c3.u AND t.v = c3.v AND t.w = c3.w
  LEFT JOIN c2 x2 ON t.u = x2.v AND t.v = x2.w),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (used = 3) AS n_tri, count(*) FILTER (used = 2) AS n_bi,
  count(*) FILTER (used = 1) AS n_uni, sum(value) AS value FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_tri, 0) AS n_tri, coalesce(n_bi, 0) AS n_bi,
  coalesce(n_uni, 0) AS n_uni, coalesce(round(value, 4), 0) AS log_score,
  CASE WHEN n_words > 0 THEN round(round(value, 4) / n_words, 4) END AS mean_log_score
FROM d LEFT JOIN a USING (doc_id)
"""
