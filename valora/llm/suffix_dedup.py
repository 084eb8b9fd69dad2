"""Exact-substring dedup on a sparse suffix array.

A byte goes if a string of ``LENGTH`` (400) bytes covers it that also starts
anywhere else, in the same text or another.  Strings never cross texts and are
judged on the input.

Every start s of such a string has an anchor: the place of the smallest 8-gram
hash (the first of equals) among the ``SPAN`` places from s on.  It depends on
the string alone, so equal strings have equal anchors at equal distances d
from their start, and it is enough to compare strings with the same bytes after
their anchors.  An anchor serves a run of starts, about SPAN / 2 on average.

1. Suffixes start at anchors.  Their leading bytes (those that all strings of
   an anchor hold) are counted by hash; only what occurs twice goes on.
2. If all occurrences of a leading part have the same surroundings, all their
   strings are repeated.  Copies and the inside of shared passages end here.
3. The others are cut out once for each different surrounding and
   range-partitioned by their leading bytes; Spark samples the splitters.  Each
   partition is sorted by multikey quicksort on 8-byte tokens; neighbours with
   the same leading part form runs, in which strings of equal d are compared.
   Ranges are cut by the first 8 bytes and a hash of the leading part, so only
   the runs with the smallest or largest of these in a partition can go on in
   another, wherever their bytes stand in the sorted partition: to compare
   across the boundary their suffixes, one of each kind, go through the pass again,
   for the two halves of the distances, which have more leading bytes in
   common; the last few distances are compared string by string, by 128-bit
   hashes.  A passage with very many surroundings thus spreads over many
   partitions, and a suffix makes a few rows, not one for each string.
4. The covered spans of a text are joined back to the texts by a 128-bit hash.

All sizes are linear in the text; no task gets all occurrences of a passage.

Defined cases: null counts as empty; texts below LENGTH bytes are never cut; a
text that occurs twice and has LENGTH bytes goes whole, in all its rows; cuts
can fall inside a character, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, BinaryType, LongType, StructType

from valora.llm.common import fresh, read, register
from valora.llm.textops import MULT, SLICE_BYTES, mix64, row_groups, text_buffer
from valora.session import stage

LENGTH, SPAN = 400, 256
LEAD = LENGTH - SPAN + 1
SORT_ROWS = 8_000
#: tasks that share the copies of one text
SALTS = 16
#: width of distances below which strings are compared one by one
LAST_WIDTH = 8
_LOW = np.uint64(0xFFFFFFFF)


def _grams(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as a number (zeros after the end)."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    return np.ndarray((len(buf) + 8,), "<u8", padded.data, strides=(1,)).astype(np.uint64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - at, size)


def _fold(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * MULT
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of the texts in a buffer: row, place in the text, smallest and
    largest distance of the starts, hashes of the leading bytes and of all
    bytes of its strings."""
    n, size = len(buf), np.maximum(np.diff(off) - LENGTH + 1, 0)
    names = ("row", "at", "dmin", "dmax", "key", "cid")
    if not size.sum():
        return {x: np.empty(0, np.uint64 if x in ("key", "cid") else np.int64) for x in names}
    with np.errstate(over="ignore"):
        gram = _grams(buf)
        h = ((gram[:n] * MULT) & ~_LOW) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // SPAN) * SPAN + SPAN, np.uint64(2**64 - 1), np.uint64)
    full[:n] = h
    block = full.reshape(-1, SPAN)
    front = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    start = _ranges(off[:-1], size)
    place = (np.minimum(back[start], front[start + SPAN - 1]) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    cut = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    last = np.append(cut[1:], len(start)) - 1
    a, lo, hi = place[cut], start[cut], start[last]
    with np.errstate(over="ignore"):
        key = np.full(len(a), np.uint64(LEAD), np.uint64)
        for j in [*range(0, LEAD - 7, 8), LEAD - 8]:
            key = _fold(key, gram[a + j])
        span = hi - lo + LENGTH
        cid = mix64((a - lo).astype(np.uint64) * np.uint64(1009) + (a - hi).astype(np.uint64))
        for j in range(0, int(span.max()) - 7, 8):
            on = j + 8 <= span
            cid[on] = _fold(cid[on], gram[lo[on] + j])
        cid = _fold(cid, gram[lo + span - 8])
    return {"row": row[cut], "at": a - off[row[cut]], "dmin": a - hi, "dmax": a - lo, "key": mix64(key), "cid": mix64(cid)}


def sliced_anchors(buf: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first row, anchors) of a buffer of texts, some ``limit`` bytes at a time.
    A text beyond that is walked in slices which share LENGTH - 1 bytes, so that
    each start is in one of them; a run of starts that a slice cuts has two
    surroundings, which is a matter of the later steps, not of the result."""
    for i, j in row_groups(off, limit):
        if off[j] - off[i] <= 2 * limit:
            yield i, anchors(buf[off[i]: off[j]], off[i: j + 1] - off[i])
            continue
        for at in range(off[i], off[j] - LENGTH + 1, limit):
            part = buf[at: min(at + limit + LENGTH - 1, off[j])]
            x = anchors(part, np.array([0, len(part)]))
            x["at"] += at - off[i]
            yield i, x


def multikey_order(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of tokens by three-way multikey quicksort."""
    n, width = tokens.shape
    out, todo = [], [(np.arange(n), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2 or depth == width:
            out.append(rows)
            continue
        if len(rows) <= 24:
            out.append(rows[np.lexsort(tokens[rows, depth:].T[::-1])])
            continue
        col = tokens[rows, depth]
        pivot = np.partition(col[[0, len(col) // 2, -1]], 1)[1]
        less, more = col < pivot, col > pivot
        # the last one pushed comes out first
        todo.append((rows[more], depth))
        todo.append((rows[~less & ~more], depth + 1))
        todo.append((rows[less], depth))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _window_hashes(body: list[bytes], dmin: np.ndarray, dmax: np.ndarray) -> tuple:
    """For all strings of the rows: row, distance d, two hashes."""
    flat = np.frombuffer(b"".join(body), np.uint8)
    size = np.fromiter(map(len, body), np.int64, len(body))
    base = np.cumsum(size) - size
    count = dmax - dmin + 1
    row = np.repeat(np.arange(len(body)), count)
    step = _ranges(np.zeros(len(body), np.int64), count)
    first = base[row] + step
    out = []
    with np.errstate(over="ignore"):
        for r in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)):
            inverse = np.uint64(pow(int(r), -1, 1 << 64))
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(flat), r)]))
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(flat), inverse)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:-1])])
            out.append(mix64((sums[first + LENGTH] - sums[first]) * back[first]))
    return row, dmax[row] - step, out[0], out[1]


SORTED = ("kind int, key long, cid long, lo int, hi int, w1 long, w2 long, mult long, body binary, "
          "lead long, ord long")
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(),
          pa.int64(), pa.int64()]
DONE, STRING, AGAIN = range(3)


def _rows(kind: int, key, cid, lo, hi, w1=None, w2=None, mult=None, body=None, lead=None, ord_=None) -> pa.RecordBatch:
    n = len(key)
    cols = [np.full(n, kind), key, cid, lo, hi, *([None] * n if c is None else c for c in (w1, w2, mult, body, lead, ord_))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)],
                                      names=[f.split()[0] for f in SORTED.split(", ")])


def _common(body: bytes, dmax: int, node: int, width: int) -> bytes:
    """The bytes that all strings of a node of distances hold."""
    return body[dmax - node: dmax - node + LENGTH - width + 1]


def _lead(common: bytes) -> int:
    return int.from_bytes(common[:8].ljust(8, b"\0"), "big") - (1 << 63)


def _edge(rows: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """A run that can go on in another range, rows (key, cid, dmin, dmax, mult,
    body): equal rows with two occurrences are done; one of each goes on, in
    the two halves of its distances, or string by string at the end."""
    alike: dict[tuple, list[tuple]] = {}
    for r in rows:
        alike.setdefault((r[2], r[3], r[5]), []).append(r)
    done, on = [], []
    for (lo, hi, body), same in alike.items():
        mult = sum(r[4] for r in same)
        if mult > 1:
            done += [(r[0], r[1], lo, hi) for r in same]
        on.append((same[0][0], same[0][1], lo, hi, mult, body))
    if done:
        yield _rows(DONE, *zip(*done))
    if width <= LAST_WIDTH:
        row, d, w1, w2 = _window_hashes([r[5] for r in on], np.array([r[2] for r in on]), np.array([r[3] for r in on]))
        key, cid, mult = (np.array([r[i] for r in on])[row] for i in (0, 1, 4))
        yield _rows(STRING, key, cid, d, d, w1.view(np.int64), w2.view(np.int64), mult)
        return
    half, out = width // 2, []
    for key, cid, dmin, dmax, mult, body in on:
        for node in range(dmin // half * half, dmax + 1, half):
            lo, hi = max(dmin, node), min(dmax, node + half - 1)
            part = body[dmax - hi: len(body) - (lo - dmin)]
            common = _common(part, hi, node, half)
            name = int.from_bytes(blake2b(common, digest_size=8).digest(), "big", signed=True)
            out.append((key, cid, lo, hi, None, None, mult, part, _lead(common), name))
    yield _rows(AGAIN, *zip(*out))


def sort_bucket(width: int, alone: bool):
    """Task function for one range of suffixes (key, cid, lo, hi, mult, body,
    lead, ord) whose distances lie in nodes of ``width``; ``alone``: there is no
    other range.  Runs with the smallest or largest (lead, ord) of the range may
    go on in another, see ``_edge``; all others are resolved here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        cols = pa.Table.from_batches(tables)
        key, cid, dmin, dmax, mult = (cols.column(i).to_numpy().astype(np.int64) for i in range(5))
        body = cols.column(5).to_pylist()
        node = dmin // width * width
        size = -(-(LENGTH - width + 1) // 8) * 8
        common = [_common(b, d, n, width).ljust(size, b"\0") for b, d, n in zip(body, dmax.tolist(), node.tolist())]
        tokens = np.frombuffer(b"".join(common), ">u8").reshape(len(body), -1).astype(np.uint64)
        tokens = np.column_stack([tokens, node.astype(np.uint64)])
        order = multikey_order(tokens)
        starts = np.flatnonzero(np.concatenate([[True], np.any(tokens[order[1:]] != tokens[order[:-1]], axis=1)]))
        stops = np.append(starts[1:], len(order))
        edge = np.zeros(len(starts), bool)  # all rows of a run have one (lead, ord)
        if not alone:
            lead, name = (cols.column(i).to_numpy() for i in (6, 7))
            by = np.lexsort((name, lead))
            for i in by[[0, -1]]:
                edge |= (lead[order[starts]] == lead[i]) & (name[order[starts]] == name[i])
        for k in np.flatnonzero(edge):
            yield from _edge([(int(key[i]), int(cid[i]), int(dmin[i]), int(dmax[i]), int(mult[i]), body[i])
                              for i in order[starts[k]: stops[k]]], width)
        inner, p = np.flatnonzero(~edge), 0
        while p < len(inner):  # whole runs together, about a thousand suffixes at a time
            q, some = p, 0
            while q == p or q < len(inner) and some + stops[inner[q]] - starts[inner[q]] <= 1000:
                some += stops[inner[q]] - starts[inner[q]]
                q += 1
            block = np.concatenate([order[starts[k]: stops[k]] for k in inner[p:q]])
            p = q
            row, d, w1, w2 = _window_hashes([body[i] for i in block], dmin[block], dmax[block])
            by = np.lexsort((w2, w1))
            change = np.concatenate([[True], (np.diff(w1[by]) != 0) | (np.diff(w2[by]) != 0)])
            group = np.cumsum(change) - 1
            again = np.zeros(len(by), bool)
            again[by] = np.bincount(group, mult[block[row[by]]])[group] > 1
            row, d = row[again], d[again]
            if len(row):  # distances fall by one within a row
                cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(d, prepend=d[0]) != -1))
                who = block[row[cut]]
                yield _rows(DONE, key[who], cid[who], d[np.append(cut[1:], len(row)) - 1], d[cut])
    return run


def repeated(texts: DataFrame) -> DataFrame:
    """Covered spans ``(h1, h2, spans)`` of ``texts(h1, h2, text)``, spans as
    an array of (lo, hi) byte offsets; texts without any are left out."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, x in sliced_anchors(*text_buffer(b.column(2))):
                if len(x["row"]):
                    where = x["at"] << 16 | x["dmin"] << 8 | x["dmax"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (h1[i + x["row"]], h2[i + x["row"]], where,
                                               x["key"].view(np.int64), x["cid"].view(np.int64))],
                        names=["h1", "h2", "place", "key", "cid"])

    # copies of a text end here: one row for each place of a different text
    found = stage(texts.mapInArrow(cut, "h1 long, h2 long, place long, key long, cid long")
                  .groupBy("h1", "h2", "place", "key", "cid").agg(F.count(F.lit(1)).alias("n")), "anchors")
    keys = (found.groupBy("key").agg(F.sum("n").alias("all"), F.min("cid").alias("c0"), F.max("cid").alias("c1"))
            .where("all > 1").select("key", (F.col("c0") == F.col("c1")).alias("alike")))
    # the keys as a table of their own, so that a key with very many places can be split in the join
    hits = stage(found.join(stage(keys, "suffix_keys"), "key"), "suffix_hits")
    at, dmin, dmax = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    hits = hits.withColumns({"at": at, "dmin": dmin.cast("int"), "dmax": dmax.cast("int")})
    whole = hits.where("alike").select("h1", "h2", (F.col("at") - F.col("dmax")).alias("lo"),
                                       (F.col("at") - F.col("dmin") + LENGTH).alias("hi"))
    other = hits.where(~F.col("alike"))

    # one text for each different surrounding; the array is bounded by the text
    chosen = (other.groupBy("key", "cid").agg(F.min(F.struct("h1", "h2", "at", "dmin", "dmax")).alias("r"),
                                              F.sum("n").alias("mult"))
              .groupBy("r.h1", "r.h2").agg(F.collect_list(F.struct("key", "cid", "mult", "r.at", "r.dmin", "r.dmax")).alias("c")))
    # copies of a text end before the join, within the tasks that read them
    once = texts.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    pieces = (once.join(chosen, ["h1", "h2"])
              .select("h1", "h2", "text", "c").mapInArrow(_cut_out, CUT))
    todo = stage(pieces.dropDuplicates(["key", "cid"]), "suffixes")
    width, passes = SPAN, []
    while n := todo.count():
        one = n <= SORT_ROWS
        ranged = todo.repartition(1) if one else todo.repartitionByRange(-(-n // SORT_ROWS), "lead", "ord", "cid")
        passes.append(stage(ranged.select("key", "cid", "lo", "hi", "mult", "body", "lead", "ord")
                            .mapInArrow(sort_bucket(width, one), SORTED), "suffix_runs"))
        todo = passes[-1].where(F.col("kind") == AGAIN).select("key", "cid", "lo", "hi", "mult", "body", "lead", "ord")
        width //= 2
    empty = texts.sparkSession.createDataFrame([], SORTED)
    resolved = reduce(DataFrame.unionByName, passes, empty)
    string = resolved.where(F.col("kind") == STRING)
    twice = string.groupBy("w1", "w2").agg(F.sum("mult").alias("m")).where("m > 1").drop("m")
    runs = (resolved.where(F.col("kind") == DONE).select("key", "cid", "lo", "hi")
            .union(string.join(twice, ["w1", "w2"]).select("key", "cid", "lo", "hi"))).distinct()
    part = (other.join(runs, ["key", "cid"])
            .select("h1", "h2", (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo") + LENGTH).alias("hi")))
    return (whole.union(part).distinct().groupBy("h1", "h2")
            .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")))


CUT = "key long, cid long, lo int, hi int, mult long, body binary, lead long, ord long"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in CUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    for b in batches:
        rows: list[tuple] = []
        for text, chosen in zip(b.column(2), b.column(3)):
            data = text.as_py().encode("utf-8", "replace")
            for c in chosen.as_py():
                a, lo = c["at"], c["at"] - c["dmax"]
                rows.append((c["key"], c["cid"], c["dmin"], c["dmax"], c["mult"], data[lo: a - c["dmin"] + LENGTH],
                             _lead(data[a: a + LEAD]), c["key"]))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the bytes left) and ``removed`` (maximal removed
    runs as an array of (lo, hi))."""
    kept, removed, h1, h2, spans, salt = fresh(docs, "kept", "removed", "h1", "h2", "spans", "salt")
    full = F.coalesce(F.col(text), F.lit(""))
    one, two = F.xxhash64(full), F.xxhash64(F.lit(1), full)
    texts = docs.select(one.alias("h1"), two.alias("h2"), full.alias("text")).where(F.octet_length("text") >= LENGTH)
    found = repeated(texts).select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("spans").alias(spans))
    # copies of a text are dealt over SALTS tasks by their other columns
    others = [f.name for f in docs.schema.fields if f.name != text and isinstance(f.dataType, AtomicType)]
    dealt = F.pmod(F.xxhash64(*others) if others else F.spark_partition_id(), F.lit(SALTS)).cast("int")
    found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = docs.withColumns({h1: one, h2: two, salt: dealt}).join(found, [h1, h2, salt], "left").select(*docs.columns, spans)
    at, n = docs.columns.index(text), len(docs.columns)
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, gone = [], []
            for t, s in zip(b.column(at), b.column(n)):
                data = (t.as_py() or "").encode("utf-8", "replace")
                cut = merged([(x["lo"], x["hi"]) for x in s.as_py() or ()])
                edges = [0, *(e for c in cut for e in c), len(data)]
                left.append(b"".join(data[edges[i]: edges[i + 1]] for i in range(0, len(edges), 2)))
                gone.append([{"lo": lo, "hi": hi} for lo, hi in cut])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(left, pa.binary()), pa.array(gone, kind)],
                                             names=[*b.schema.names[:n], kept, removed])

    span = StructType().add("lo", LongType()).add("hi", LongType())
    schema = StructType([*docs.schema.fields]).add(kept, BinaryType()).add(removed, ArrayType(span))
    return joined.mapInArrow(remove, schema)


@register("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda t, x: t + x["hi"] - x["lo"])
    return done.select("doc_id", (F.octet_length("kept") + size).alias("n_bytes"), size.alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
