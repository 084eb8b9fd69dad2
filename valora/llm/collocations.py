"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends,
and pieces into words at spaces and tabs.

1. Parse.  A window of ``OVERLAP`` (4) words whose hash is 0 modulo ``MOD`` is a
   trigger.  A chunk runs from one trigger (or the start of the piece) to the
   end of the next trigger (or of the piece), so neighbours share just the four
   words of the trigger and no chunk is part of another at its start.  As
   triggers depend on the words alone, equal passages give equal chunks.  The
   dictionary holds each different chunk of a language once, with the number
   of its places (the frequencies of the parse); copies end here.
2. Count.  Phrases of up to five words are counted inside the chunks of the
   dictionary, weighted.  A phrase belongs to the chunk in whose own words (all
   but the shared last four) it begins, so none is counted twice, and the four
   shared words are enough to see it whole.
   A phrase can only be frequent if its parts are: one pass over the dictionary
   for words, one for pairs and one for the longer phrases add up 64-bit hashes.
   The hashes that reach ``min_count`` set bits of a filter of fixed size,
   ``FILTER_BITS`` (8 MB), which is broadcast to the next pass.  Hashes that
   meet can only let more through; the last two passes count what passes by the
   words themselves, first phrases of two words and more, then the single words
   at the ends of those.  So the counts are exact at any size, and what is
   shuffled is what may be frequent and is asked for.
3. Score.  Frequent phrases are cut after each word and joined with the counts
   of their parts, with salted keys, as parts like "the" belong to very many
   phrases.  Numbers are decimals of 38 digits.

Defined cases: a null text is empty, a null language is ``und`` (and counts
together with a language of that name); repeated rows count each; a very long
piece without a trigger is cut every ``MAX_CORE`` words, a very long text is parsed
in slices of ``SLICE_BYTES``; an empty table gives no rows; phrases at equal
score and count are in order of their bytes; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.llm.common import read, register
from valora.llm.textops import MULT, mix64
from valora.session import stage

LONGEST = 5
OVERLAP = LONGEST - 1
MOD = 16
MAX_CORE = 256
SLICE_BYTES = 1 << 20
FILTER_BITS = 1 << 26
MIN_COUNT, TOP, DROP_PERCENT = 100, 2000, 100
SALTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = 1
_CLASS[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_GAP = re.compile(rb"[\x20\x09]")
_MORE = re.compile(rb"(?:[\x20\x09]+[^\x20\x09.,;:!?\x0A-\x0D]+){%d}" % OVERLAP)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - at, size)


def _word_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words by their 8-byte blocks; of words over 128 bytes the
    first 128 and the last 8 bytes count (meeting hashes do no harm here)."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    gram = np.ndarray((len(buf) + 8,), "<u8", padded.data, strides=(1,))
    h = size.astype(np.uint64) * MULT
    todo, at = np.arange(len(start)), 0
    while len(todo) and at < 128:
        left = size[todo] - at
        keep = np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        h[todo] = mix64(h[todo] ^ (gram[start[todo] + at] & keep))
        todo, at = todo[left > 8], at + 8
    if len(todo):
        h[todo] = mix64(h[todo] ^ gram[start[todo] + size[todo] - 8])
    return h


# ------------------------------------------------------------------ parse

def slices(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(slice, bytes of it whose words are its own): slices end with a piece,
    or within a long one before a word, followed by OVERLAP more words."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        cut = _PIECE_END.search(data, at + SLICE_BYTES // 2, at + SLICE_BYTES)
        if cut:
            yield data[at: cut.end()], cut.end() - at
            at = cut.end()
            continue
        gap = _GAP.search(data, at + SLICE_BYTES // 2)
        more = _MORE.match(data, gap.start()) if gap else None
        if more:
            yield data[at: more.end()], gap.start() - at
            at = gap.start()
        else:  # the piece ends within the next few words (or the text is one word)
            cut = _PIECE_END.search(data, gap.start() if gap else at)
            end = cut.end() if cut else len(data)
            yield data[at: end], end - at
            at = end
    yield data[at:], len(data) - at


def parse(buf: np.ndarray, off: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Chunks of the slices in ``buf`` (offsets ``off``; words that begin at or
    after ``own`` belong to the next slice): (slice, chunk, whether a next one
    shares its last words, own words)."""
    buf = _LOWER[buf]
    kind = _CLASS[buf]
    word = kind == 0
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    edge = off[1:-1]
    before[edge[edge < len(buf)]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(start):
        return np.empty(0, np.int64), pa.array([], pa.binary()), np.empty(0, bool), np.empty(0, np.int64)
    row = np.searchsorted(off, start, side="right") - 1
    piece = np.cumsum(kind == 2)[start] + row
    size = end - start
    # one space after each word, nothing else between them
    text = buf[_ranges(start, size + 1).clip(max=len(buf) - 1)]
    stop = np.cumsum(size + 1)
    text[stop - 1] = 32
    first = stop - size - 1
    h = _word_hashes(text, first, size)
    n = len(h)
    new = np.concatenate([[True], piece[1:] != piece[:-1]])
    if n > OVERLAP:
        window = h[:-OVERLAP + 1].copy()
        with np.errstate(over="ignore"):
            for j in range(1, OVERLAP):
                window = mix64(window * MULT ^ h[j: n - OVERLAP + 1 + j])
        inside = piece[: len(window)] == piece[OVERLAP - 1:]
        new[: len(window)] |= inside & (window % np.uint64(MOD) == 0)
    foreign = start >= own[row]
    new |= np.concatenate([[False], foreign[1:] & ~foreign[:-1]])
    cut = np.flatnonzero(new)
    long = np.diff(np.append(cut, n))
    if long.max() > MAX_CORE:
        more = _ranges(cut, np.where(long > MAX_CORE, -(-long // MAX_CORE), 1))
        step = more - np.repeat(cut, np.where(long > MAX_CORE, -(-long // MAX_CORE), 1))
        more = more - step + step * MAX_CORE
        fits = more + OVERLAP - 1 < n
        fits[fits] = piece[more[fits]] == piece[more[fits] + OVERLAP - 1]
        cut = more[fits | (step == 0)]
    last = np.append(cut[1:], n)  # the word after the chunk's own
    shared = np.append(piece[cut[1:]] == piece[cut[:-1]], False)
    mine = ~foreign[cut]
    cut, last, shared = cut[mine], last[mine], shared[mine]
    until = last + np.where(shared, OVERLAP, 0) - 1
    length = stop[until] - 1 - first[cut]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    body = text[_ranges(first[cut], length)]
    chunks = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return row[cut], chunks, shared, last - cut


DICTIONARY = "lang string, chunk binary, shared boolean, own int"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        sizes = np.array([len(p) for p, _, _ in some])
        off = np.concatenate([[0], np.cumsum(sizes)])
        buf = np.frombuffer(b"".join(p for p, _, _ in some), np.uint8)
        row, chunks, shared, own = parse(buf, off, off[:-1] + np.array([o for _, o, _ in some]))
        langs = pa.array([x for _, _, x in some], pa.string()).take(pa.array(row))
        return pa.RecordBatch.from_arrays([langs, chunks, pa.array(shared), pa.array(own.astype(np.int32))],
                                          names=["lang", "chunk", "shared", "own"])

    some, held = [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
            for part, own in slices(text.as_buffer().to_pybytes()):
                some.append((part, own, lang))
                held += len(part)
                if held >= SLICE_BYTES:
                    yield flush()
                    some, held = [], 0
    if some:
        yield flush()


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, chunk, shared, own, n)``: different chunks (words with one
    space between them), whether the last four words belong to the next chunk,
    the number of own words, and how often the chunk occurs."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_parse_batches, DICTIONARY).groupBy("lang", "chunk", "shared", "own").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ count

class Words:
    """The words of a batch of chunks (lang, chunk, own, n) and the hashes of
    the phrases that begin at each."""

    def __init__(self, b: pa.RecordBatch):
        self.lang = b.column(0)
        own, self.n = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        col = b.column(1).cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
        self.buf = np.frombuffer(col.buffers()[2], np.uint8)[off[0]: off[-1]]
        off = off - off[0]
        gap = self.buf == 32
        new = np.concatenate([[True], gap[:-1]])
        new[off[1:-1]] = True
        self.start = np.flatnonzero(new)
        self.row = np.searchsorted(off, self.start, side="right") - 1
        following = np.append(self.start[1:], len(self.buf) + 1)
        self.end = following - 1
        final = np.append(self.row[1:] != self.row[:-1], True)
        self.end[final] = off[1:][self.row[final]]
        place = np.arange(len(self.start)) - np.searchsorted(self.start, off[:-1])[self.row]
        self.own = place < own[self.row]
        codes = self.lang.dictionary_encode()
        seed = np.array([xxhash.xxh64_intdigest(x) for x in codes.dictionary.to_pylist()], np.uint64)
        h = _word_hashes(self.buf, self.start, self.end - self.start)
        self.word = mix64(h ^ seed[codes.indices.to_numpy()][self.row])

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hashes of the k words from each place, whether they are of one chunk)."""
        n, h, same = len(self.word), self.word, np.ones(len(self.word), bool)
        for k in range(1, LONGEST + 1):
            if k > 1:
                h, same = h.copy(), same & (np.arange(n) + k <= n)
                same[: n - k + 1] &= self.row[: n - k + 1] == self.row[k - 1:]
                with np.errstate(over="ignore"):
                    h[: n - k + 1] = mix64(h[: n - k + 1] * MULT ^ self.word[k - 1:])
            yield k, h, same

    def frequent(self, filters: dict[int, np.ndarray], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hashes, places) of the phrases that may be frequent: what
        ``filters`` let through, and of the lengths without a filter those whose
        parts it lets through."""
        ok = None
        for k, h, same in self.hashes():
            if k > upto:
                return
            if ok is not None:
                ok = ok & same & np.append(ok[1:], False)
            else:
                ok = same
            if k in filters:
                some = np.flatnonzero(ok)
                bit = h[some] & np.uint64(8 * len(filters[k]) - 1)
                hit = filters[k][(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1)
                ok = np.zeros(len(h), bool)
                ok[some[hit.astype(bool)]] = True
            yield k, h, ok


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``limit`` bytes of chunks."""
    for b in batches:
        rows = max(1, int(len(b) * limit // max(b.column(1).nbytes, 1)))
        for i in range(0, len(b), rows):
            part = b.slice(i, rows)
            if len(part):
                yield part


HELD = 1 << 21


def _count_hashes(filters, lengths: range):
    """Task function: (k, hash, n) of the phrases of these lengths."""
    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        h, at = np.unique(h, return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, at, n)
        return h, total

    def rows(k: int, parts: list) -> pa.RecordBatch:
        h, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n)],
                                          names=["k", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.frombuffer(f.value, np.uint8) for k, f in filters.items()}
        held: dict[int, list] = {k: [] for k in lengths}
        for b in _blocks(batches):
            words = Words(b)
            for k, h, ok in words.frequent(bits, lengths[-1]):
                if k in held:
                    at = np.flatnonzero(ok & words.own)
                    held[k].append((h[at], words.n[words.row[at]]))
                    if sum(len(p[0]) for p in held[k]) > HELD:
                        one = merged(held[k])
                        held[k] = [one]
                        if len(one[0]) > HELD // 2:
                            yield rows(k, held[k])
                            held[k] = []
        for k, parts in held.items():
            if parts:
                yield rows(k, parts)
    return run


def _bits(hashes: DataFrame, lengths: range) -> dict:
    """A filter for each k of ``hashes(k, h)``: FILTER_BITS bits, one set for
    each hash, however many there are."""
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (hashes.select("k", F.shiftright(bit, 6).cast("int").alias("w"),
                           F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("b"))
             .groupBy("k", "w").agg(F.bit_or("b").alias("b")).toArrow())
    out = {}
    for k in lengths:
        part = words.filter(pc.equal(words["k"], k))
        table = np.zeros(FILTER_BITS // 64, np.int64)
        table[part["w"].to_numpy()] = part["b"].to_numpy()
        out[k] = hashes.sparkSession.sparkContext.broadcast(table.tobytes())
    return out


def _may_be_frequent(chunks: DataFrame, filters: dict, lengths: range, min_count: int) -> dict:
    """Filters of ``lengths``: hashes that reach ``min_count``."""
    return _bits(chunks.mapInArrow(_count_hashes(filters, lengths), "k int, h long, n long")
                 .groupBy("k", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), lengths)


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(1, hash) of single words in the form of a dictionary."""
    for b in _blocks(batches):
        h = Words(b).word
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), 1, np.int32)), pa.array(h.view(np.int64))], names=["k", "h"])


def _count_phrases(filters, lengths: range):
    """Task function: (lang, phrase, k, n) of the phrases of these lengths that
    pass, one row a place; Spark's partial sums add them up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.frombuffer(f.value, np.uint8) for k, f in filters.items()}
        for b in _blocks(batches, SLICE_BYTES):
            words = Words(b)
            for k, _, ok in words.frequent(bits, lengths[-1]):
                at = np.flatnonzero(ok & words.own)
                if k not in lengths or not len(at):
                    continue
                size = words.end[at + k - 1] - words.start[at]
                off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                body = words.buf[_ranges(words.start[at], size)]
                phrase = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(body)])
                row = words.row[at]
                yield pa.RecordBatch.from_arrays(
                    [words.lang.take(pa.array(row)), phrase, pa.array(np.full(len(at), k, np.int32)), pa.array(words.n[row])],
                    names=["lang", "phrase", "k", "n"])
    return run


def _exact(chunks: DataFrame, filters: dict, lengths: range, min_count: int) -> DataFrame:
    return (chunks.mapInArrow(_count_phrases(filters, lengths), "lang string, phrase binary, k int, n long")
            .groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
            .withColumn("phrase", F.col("phrase").cast("string")))


def phrase_counts(chunks: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, k, n)`` of all phrases of 2 to LONGEST words that occur
    ``min_count`` times, and of the single words at their ends; ``chunks`` is a
    staged dictionary.  Both are staged."""
    parts = chunks.select("lang", "chunk", "own", "n")
    filters: dict = {}
    for lengths in (range(1, 2), range(2, 3), range(3, LONGEST + 1)):
        filters |= _may_be_frequent(parts, filters, lengths, min_count)
    found = stage(_exact(parts, filters, range(2, LONGEST + 1), min_count), "phrase_counts")
    ends = (found.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1))).alias("w"))
            .distinct().select("lang", F.col("w").cast("binary").alias("chunk"), F.lit(1).alias("own"), F.lit(1).cast("long").alias("n")))
    asked = _bits(ends.mapInArrow(_word_keys, "k int, h long"), range(1, 2))
    return found, stage(_exact(parts, asked, range(1, 2), min_count), "word_counts")


# ------------------------------------------------------------------ score

#: floor(1000 * a * n / (l * r)); the products are exact below 10^38
SCORE = ("cast(1000 * cast(a as decimal(38, 0)) * cast(n as decimal(38, 0)) as decimal(38, 0)) "
         "div cast(cast(l as decimal(38, 0)) * cast(r as decimal(38, 0)) as decimal(38, 0))")


def _salted(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join in which many ``rows`` may have one key; ``table`` has each key once."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"]).drop("salt")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                 drop_percent: int = DROP_PERCENT) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to LONGEST words that occur
    ``min_count`` times: lang, rank, phrase, a, l, r, n, score.  A phrase is
    dropped if a longer one that holds it has ``drop_percent`` of its count."""
    chunks = stage(dictionary(docs, text, lang), "phrase_chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("n"))
    several, single = phrase_counts(chunks, min_count)
    counts = several.unionByName(single)
    found = several.select("lang", "phrase", "k", F.col("n").alias("a"))

    # a longer phrase with as many places implies one that is a single word longer
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.col("k") - 1), " "), F.array_join(F.slice(words, 2, F.col("k") - 1), " "))
    longer = (found.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = (found.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < drop_percent * F.col("a"))).drop("longer"))

    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, 1, F.col("cut")), " "),
                             "rest": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = _salted(_salted(cuts, part("first", "l"), ["lang", "first"]), part("rest", "r"), ["lang", "rest"])
    cuts = _salted(cuts, totals, ["lang"])
    best = (cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 6) r(k)
  WHERE i + k - 1 <= len(w)),
totals AS (SELECT lang, count(*)::HUGEINT AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
left_over AS (
  SELECT * FROM f c
  WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
                        AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM left_over) c
  JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (
  SELECT lang, phrase, a, l, r, n, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000"""


@register("op11_collocations", ORACLE_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))
