"""Language identification by compression.

Every language gets a raw-content zstandard dictionary of its own sample
texts.  A text is encoded with each dictionary and goes to the language that
needs the fewest bytes; a narrow margin over the runner-up is a rejection.

Texts are compared as lower-case letters (other ASCII signs become one space) and encoded in pieces of ``CHUNK`` bytes, all of them, so that the
dictionary counts over the whole text and not only at its start.

Every label but ``und`` is learned.  The dictionaries come from a bounded sample:
per language the ``SAMPLE_DOCS`` documents with the smallest hash, of each
``PIECES`` pieces from all over the text, an equal share of the dictionary and
at most ``SAMPLE_CHARS`` characters.  A dictionary has ``DICT_BYTES``.  Labels
whose dictionaries wouldn't fit in ``DICT_TOTAL`` together share it by their
documents, with at least ``LEAST_BYTES`` (or an equal part, if that is less), so
that all dictionaries are at most twice ``DICT_TOTAL`` for any number of labels
up to that number of bytes.  Prediction reads whole texts.  Beyond
``BLOCK_LANGS`` languages a task takes ``GROUP_BYTES`` of texts through one
block of languages after another, so that only one block's encoders are held.

Defined cases: a null text or one without a letter gets ``und``, score 0,
rejected.  Ties go to the first language in order of name.  Without any
labelled text everything is ``und``.  Repeated rows are judged alike.  Added
columns give way to existing names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.llm.common import fresh, read, register

UNKNOWN = "und"
SAMPLE_DOCS, SAMPLE_CHARS, PIECES, DICT_BYTES = 400, 2000, 4, 262_144
DICT_TOTAL, LEAST_BYTES = 200 * DICT_BYTES, 4096
LEVEL, CHUNK = 5, 2048
#: share of the runner-up's bytes below which the choice is rejected
MIN_MARGIN = 0.002
#: languages scored at a time, and bytes of texts that go through all blocks
BLOCK_LANGS, GROUP_BYTES = 200, 16 << 20

_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def room(counts: dict[str, int]) -> dict[str, int]:
    """Bytes of every label's dictionary, from its number of documents."""
    if len(counts) * DICT_BYTES <= DICT_TOTAL:
        return dict.fromkeys(counts, DICT_BYTES)
    least, rows = max(1, min(LEAST_BYTES, DICT_TOTAL // len(counts))), sum(counts.values())
    return {k: max(least, min(DICT_BYTES, DICT_TOTAL * n // rows)) for k, n in counts.items()}


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Raw-content dictionaries by language, from rows with a label."""
    rows = (labelled.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"),
                            F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)).alias("h"))
            .where(F.col("l").isNotNull() & (F.col("l") != UNKNOWN)))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # one row a language
    if not counts:
        return {}
    size_of = room(counts)
    # a cut at four times the wanted share of each language: what the window
    # ranks doesn't grow with the input
    cuts = labelled.sparkSession.createDataFrame(
        [(l, int(min(1.0, 4 * SAMPLE_DOCS / n) * (1 << 30)) + 1, max(1, size_of[l] // min(n, SAMPLE_DOCS)))
         for l, n in sorted(counts.items())], "l string, cut long, share long")
    rows = rows.join(F.broadcast(cuts), "l").where((F.col("h") < F.col("cut")) & F.col("t").rlike(r"\p{L}"))
    size = F.length("t")
    # the share of the dictionary in characters, in pieces that don't overlap
    piece = F.floor(F.least(F.lit(SAMPLE_CHARS), F.col("share") * size / F.octet_length("t")) / PIECES).cast("int")
    spread = F.concat_ws(" ", *[F.substr("t", (F.lit(1) + F.floor((size - piece) * j / (PIECES - 1))).cast("int"), piece)
                                for j in range(PIECES)])
    w = Window.partitionBy("l").orderBy("h", "t")
    sample = (rows.withColumn("t", F.when(size <= piece * PIECES, F.col("t")).otherwise(spread))
              .withColumn("r", F.row_number().over(w))
              .where(F.col("r") <= SAMPLE_DOCS).orderBy("l", "r"))  # at most SAMPLE_DOCS rows a language
    model: dict[str, bytes] = {}
    for r in sample.select("l", "t").toLocalIterator():
        if len(model.get(r["l"], b"")) < size_of[r["l"]]:
            model[r["l"]] = (model.get(r["l"], b"") + b" " + letters(r["t"]))[:size_of[r["l"]]]
    # zstandard takes content of 8 bytes and more
    return {k: v.ljust(8) for k, v in sorted(model.items()) if v.strip()}


def _encoders(part: list[tuple[str, bytes]]) -> list:
    import zstandard as zs
    enc = []
    for lang, content in part:
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        enc.append((lang, zs.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress))
    return enc


class _Scorer:
    """Language, margin and rejection of texts, languages block by block."""

    def __init__(self, model: dict[str, bytes]):
        langs = list(model.items())
        self.blocks = [langs[i: i + BLOCK_LANGS] for i in range(0, len(langs), BLOCK_LANGS)]
        self.kept = _encoders(self.blocks[0]) if len(self.blocks) == 1 else None

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        bodies = [letters(t) if t and any(c.isalpha() for c in t) else b"" for t in texts]
        best: list[tuple] = [(None, None, UNKNOWN)] * len(bodies)  # fewest bytes, runner-up's, language
        for block in self.blocks:
            enc = self.kept or _encoders(block)
            for at, body in enumerate(bodies):
                if not body:
                    continue
                sizes = [0] * len(enc)
                for p in range(0, len(body), CHUNK):
                    piece = body[p: p + CHUNK]
                    for k, (_, compress) in enumerate(enc):
                        sizes[k] += len(compress(piece))
                one, two, name = best[at]
                for (lang, _), n in zip(enc, sizes):
                    if one is None or n < one:
                        one, two, name = n, one, lang
                    elif two is None or n < two:
                        two = n
                best[at] = one, two, name
        out = []
        for one, two, name in best:
            margin = 0.0 if one is None else 1.0 if two is None else (two - one) / two
            out.append((name, margin, margin < MIN_MARGIN))
        return out


def _groups(batches: Iterator[pa.RecordBatch], at: int, limit: int) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.column(at).nbytes
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def predict(docs: DataFrame, model: dict[str, bytes], text: str = "text",
            out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with language, score (margin over the runner-up, 0 to 1) and
    rejection; a column of one of these names gives way to an underscore."""
    names = fresh(docs, *out)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # at most twice DICT_TOTAL
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(shared.value)
        for group in _groups(batches, at, GROUP_BYTES if len(score.blocks) > 1 else 0):
            all_ = iter(score([t.as_py() for b in group for t in b.column(at)]))
            for b in group:
                got = [next(all_) for _ in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([x[0] for x in got], pa.string()),
                     pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())],
                    names=[*b.schema.names, *names])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType
    schema = StructType(list(docs.schema.fields))
    for n, kind in zip(names, (StringType(), DoubleType(), BooleanType())):
        schema = schema.add(n, kind)
    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """True for every third document by checksum; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the documents that aren't held out."""
    return fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_documents(docs)
    return (predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rejected documents go, all columns stay as they are."""
    lang, score, rejected = fresh(docs, "lang_pred", "score", "rejected")
    return predict(docs, fit_documents(docs)).where(~F.col(rejected)).drop(lang, score, rejected)
