"""Phrase collocations from count streams in prefix and in suffix order.

Counts of phrases up to some length are kept as one stream in prefix order (words from left
to right) and one in suffix order (from right to left). In prefix order the first parts of
a phrase stand right before it and its right extensions right after it, so one pass over
the stream, in lockstep over all lengths, gives both; the suffix order gives the last parts
and the left extensions. A third pass merges the two. Each pass reads a range of a sorted
stream and keeps one path of phrases, no table of counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.stage import staged
from .common import documents
from .words import WordBatch, byte_batches, byte_kinds, lower_bytes, spans

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Stands between the words of a phrase; no word holds it.
JOINT = b"\n"
#: Bits of the table of frequent phrases that counting consults; it never grows.
FILTER_BITS = 27
#: Parts of a language whose best phrases are found apart before they meet.
PARTS = 64
#: Odd number that spreads hashes.
_MIX = 0x9E3779B97F4A7C15

COUNTS = "lang string, gram binary, hash bigint, f bigint"


# ---- counting ------------------------------------------------------------------------

def kinds_of_bytes() -> np.ndarray:
    return byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")


def parts_of(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text cut at stops, where no phrase is lost."""
    at = 0
    while len(text) - at > limit:
        end = at + limit
        while end < len(text) and text[end] not in b".,;:!?\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


class Grams:
    """Phrases of growing length in a batch of words; ``known`` says which can be frequent."""

    def __init__(self, batch: WordBatch, langs: np.ndarray, names: list[str]):
        self.batch, self.names, self.piece = batch, names, batch.piece
        word_hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in batch.words), np.uint64, len(batch.words))
        self.word_hash = word_hash
        width = max(1, len(batch.words))
        lang_hash = np.fromiter((xxhash.xxh64_intdigest(n.encode()) for n in names), np.uint64, len(names))
        #: Per length so far: distinct phrases by (shorter phrase or language, last word).
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        key = langs[batch.text] * width + batch.code
        self.first = np.arange(len(key))
        self._distinct(key, width)
        lead, last = self.tables[0]
        self.hash = _mixed(lang_hash[lead] + word_hash[last])
        self.lang = lead

    def _distinct(self, key: np.ndarray, width: int) -> None:
        found, self.gram, self.n = np.unique(key, return_inverse=True, return_counts=True)
        self.tables.append((found // width, found % width))

    def keep(self, known: np.ndarray) -> None:
        """Go on with the phrases of which ``known`` is true."""
        held = known[self.gram]
        self.first, self.gram = self.first[held], self.gram[held]
        self.known = known

    def longer(self) -> None:
        """Phrases of one word more, both shorter parts of which were kept."""
        batch, n = self.batch, len(self.tables)
        held = np.zeros(len(batch.code) + 1, bool)
        held[self.first] = True
        ends = np.minimum(self.first + n, len(batch.code) - 1)
        fits = (self.first + n < len(batch.code)) & held[self.first + 1]
        if len(batch.code):
            fits &= self.piece[ends] == self.piece[self.first]
        self.first = self.first[fits]
        width = max(1, len(batch.words))
        lead_hash, lead_lang = self.hash, self.lang
        self._distinct(self.gram[fits] * width + batch.code[self.first + n], width)
        lead, last = self.tables[-1]
        self.hash = _mixed(lead_hash[lead] + np.uint64(_MIX) + self.word_hash[last])
        self.lang = lead_lang[lead]

    def texts(self, wanted: np.ndarray) -> list[bytes]:
        """The phrases of these numbers, words joined."""
        parts = []
        for lead, last in reversed(self.tables):
            parts.append([self.batch.words[i] for i in last[wanted].tolist()])
            wanted = lead[wanted]
        return [JOINT.join(p) for p in zip(*reversed(parts))]


def _bits_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def count_batches(hashed: range, named: range, bits):
    """For mapInArrow: (lang, text as binary) to partial counts of phrases. Those of the
    ``hashed`` lengths are known by hash alone; of the ``named`` ones those that ``bits`` lets
    through are spelt out. Lengths up to the last named one go on only through ``bits``.
    Without named lengths, each language's words are counted as well, under no hash."""
    kinds, lower = kinds_of_bytes(), lower_bytes()

    def rows_of(texts: list[bytes], langs: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        grams = Grams(WordBatch(texts, kinds, lower), langs, names)
        table = np.frombuffer(bits.value, np.uint64) if named else None

        def out(lang, gram, hashes, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [lang, gram, pa.array(hashes, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "gram", "hash", "f"])

        if not named:
            words = np.bincount(langs[grams.batch.text], minlength=len(names))
            yield out(pa.array(names, pa.string()), pa.nulls(len(names), pa.binary()), [None] * len(names), words)
        for n in range(1, (hashed or named)[-1] + 1):
            if n > 1:
                grams.longer()
            count = len(grams.hash)
            if n in hashed:
                yield out(pa.nulls(count, pa.string()), pa.nulls(count, pa.binary()), grams.hash.view(np.int64), grams.n)
            held = np.ones(count, bool)
            if named and n <= named[-1]:
                held = _bits_hold(table, grams.hash)
            if n in named:
                found = np.flatnonzero(held)
                for at in range(0, len(found), 100_000):
                    some = found[at:at + 100_000]
                    yield out(pa.array(names, pa.string()).take(pa.array(grams.lang[some])),
                              pa.array(grams.texts(some), pa.binary()), [None] * len(some), grams.n[some])
            grams.keep(held)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            texts, of = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for part in parts_of(text or b"", 1 << 20):
                    texts.append(part)
                    of.append(lang[i])
            of = np.array(of, np.int64)
            for a, b in spans(texts):
                yield from rows_of(texts[a:b], of[a:b], names)

    return count


def with_bits(bits: bytes | None, hashes: DataFrame) -> bytes:
    """A table of 2**FILTER_BITS bits, given or empty, with one for each hash; its size is fixed."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    words = hashes.select(F.shiftright(slot, 6).alias("at"), one.alias("bit")).groupBy("at").agg(
        F.bit_or("bit").alias("word")).toArrow()  # at most 2**(FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64) if bits is None else np.frombuffer(bits, np.int64).copy()
    table[words["at"].to_numpy()] |= words["word"].to_numpy()
    return table.tobytes()


def frequent_grams(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS
                   ) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, f) of all phrases counted ``min_count`` times, and (lang, n) of all words.

    A phrase can be that frequent only if its parts are, so each step reads the texts and
    counts phrases whose parts the steps before have let through, one word longer; the last
    step takes two lengths. What is rare, the bulk, is counted and shuffled as a hash of
    eight bytes; the next step spells out phrases with a frequent hash and counts them
    exactly, so a hash that two phrases share, or a bit of the filter, costs a row at most.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    context = docs.sparkSession.sparkContext
    steps = [range(n, n + 1) for n in range(1, min(max_words, 3) + 1)] + [range(4, max_words + 1)]
    found = totals = bits = None
    named = range(0)
    for hashed in [s for s in steps if s] + [range(0)]:
        shipped = context.broadcast(bits) if named else None
        counts = texts.mapInArrow(count_batches(hashed, named, shipped), COUNTS).groupBy("lang", "gram", "hash").agg(
            F.sum("f").alias("f"))
        counts = staged(counts.where((F.col("f") >= min_count) | F.col("hash").isNull()))
        hashes = counts.where(F.col("hash").isNotNull())
        spelt = counts.where(F.col("gram").isNotNull() & (F.col("f") >= min_count)).select("lang", "gram", "f")
        if named:
            found = spelt if found is None else found.union(spelt)
        else:
            totals = counts.where(F.col("hash").isNull()).select("lang", F.col("f").alias("n"))
        if hashed:
            bits = with_bits(bits, hashes)
        named = hashed
    return found, totals


# ---- streams -------------------------------------------------------------------------

STREAM = "lang string, gram binary, f bigint, parts array<bigint>, longer bigint"


def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of a stream (lang, words in its order, f), sorted: per phrase the counts of
    its leading parts and the largest count of a phrase one word longer.

    A part that lies in an earlier range is unknown: its count is missing here, and it is
    given out itself without a count, with what this range knows of its extensions.
    """
    out: list[tuple] = []
    path: list[list] = []  # words so far, count, largest extension
    lang = None

    def pop() -> None:
        words, f, longer = path.pop()
        out.append((lang, JOINT.join(words), f, [p[1] for p in path], longer))

    def taken() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["lang", "gram", "f", "parts", "longer"])
        out.clear()
        return done

    for batch in batches:
        for of, words, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
            while path and (of != lang or words[:len(path)] != path[-1][0]):
                pop()
            lang = of
            for n in range(len(path) + 1, len(words)):
                path.append([words[:n], None, 0])
            if path:
                path[-1][2] = max(path[-1][2], f)
            path.append([words, f, 0])
        yield taken()
    while path:
        pop()
    yield taken()


def stream(grams: DataFrame, backwards: bool) -> DataFrame:
    """The walk over all phrases in prefix order, or in suffix order if ``backwards``: adds
    ``parts`` (counts of the leading parts by length) and ``longer``. Ranges are cut by
    Spark, anywhere; what a range can't know is at most one path of phrases, looked up.
    """
    words = F.split(F.col("gram").cast("string"), JOINT.decode())
    words = (F.reverse(words) if backwards else words).cast("array<binary>")
    ordered = grams.select("lang", words.alias("words"), "f").repartitionByRange("lang", "words")
    walked = staged(ordered.sortWithinPartitions("lang", "words").mapInArrow(walk, STREAM))
    known = walked.where(F.col("f").isNotNull())
    # At most MAX_WORDS - 1 a range.
    asked = walked.where(F.col("f").isNull()).groupBy("lang", "gram").agg(F.max("longer").alias("more"))
    heads = staged(asked.join(known.select("lang", "gram", F.col("f").alias("head")), ["lang", "gram"]))
    known = known.join(F.broadcast(heads.select("lang", "gram", "more")), ["lang", "gram"], "left").withColumn(
        "longer", F.greatest("longer", F.coalesce("more", F.lit(0)))).drop("more")
    lead = F.split(F.col("gram").cast("string"), JOINT.decode())
    for k in range(1, MAX_WORDS):
        head = heads.select("lang", F.col("gram").alias("_lead"), F.col("head").alias(f"_h{k}"))
        short = F.when(F.get("parts", F.lit(k - 1)).isNull() & (F.size("parts") >= k),
                       F.array_join(F.slice(lead, 1, k), JOINT.decode()).cast("binary"))
        known = known.withColumn("_lead", short).join(F.broadcast(head), ["lang", "_lead"], "left").drop("_lead")
    heads_by_length = F.array(*[F.col(f"_h{k}") for k in range(1, MAX_WORDS)])
    full = F.transform("parts", lambda p, i: F.coalesce(p, F.get(heads_by_length, i)))
    known = known.withColumn("parts", full).select("lang", "gram", "f", "parts", "longer")
    if backwards:
        known = known.withColumn("gram", F.array_join(F.reverse(lead), JOINT.decode()).cast("binary"))
    return known


def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both streams' rows of a phrase, next to each other, to its lowest-scoring cut; phrases
    that an extension covers fall away. Whole numbers of any size, so scores are exact."""
    before = None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if before is None:
                before = row
                continue
            (lang, gram, a, left, more, n, _), (_, _, _, right, more_left, _, _) = before, row
            before = None
            if max(more, more_left) >= a:
                continue
            cuts = [(1000 * a * n // (l * r), k) for k, (l, r) in enumerate(zip(left, reversed(right)))]
            score, k = min(cuts)
            out.append((lang, gram.replace(JOINT, b" "), a, left[k], right[len(right) - 1 - k], n, score))
        cols = list(zip(*out)) or [()] * 7
        kinds = (pa.string(), pa.binary(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["lang", "phrase", "a", "l", "r", "n", "score"])


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of several words that no longer one covers."""
    several = F.size("parts") > 0
    prefix = stream(grams, False).where(several).join(staged(totals), "lang").withColumn("side", F.lit(0))
    suffix = stream(grams, True).where(several).withColumn("n", F.lit(None).cast("bigint")).withColumn("side", F.lit(1))
    cols = ["lang", "gram", "f", "parts", "longer", "n", "side"]
    both = prefix.select(cols).union(suffix.select(cols)).repartitionByRange("lang", "gram")
    return both.sortWithinPartitions("lang", "gram", "side").mapInArrow(
        merge, "lang string, phrase binary, a bigint, l bigint, r bigint, n bigint, score bigint"
    ).withColumn("phrase", F.col("phrase").cast("string"))


def best(rows: DataFrame, top: int | None) -> DataFrame:
    """Adds ``rank`` by language; parts of a language choose their best before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        inside = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        rows = rows.withColumn("_part", part).withColumn("_n", inside).where(F.col("_n") <= top).drop("_part", "_n")
    rank: Column = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = rows.withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 top: int | None = TOP) -> DataFrame:
    """Phrases of 2 to ``max_words`` words (5 at most) by how much more often they occur than
    their parts would by chance: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at ``. , ; : ! ?`` and line ends into pieces and those
    at blanks and tabs into words. A phrase counted a >= ``min_count`` times is cut where
    floor(1000 * a * n / (l * r)) is lowest, l and r being the counts of both parts and n
    the words of the language; ties go to the earliest cut. A phrase with an extension that
    is counted as often falls away. Each language's ``top`` phrases are returned by score,
    count and phrase; None returns all.

    A missing language is ``und``. Missing and empty texts have no words; rows that repeat
    count each; other columns take no part. An empty table gives an empty table.
    """
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"max_words must be 2 to {MAX_WORDS}")
    byte_batches(docs.sparkSession)
    grams, totals = frequent_grams(docs, min_count, max_words)
    return best(scored(grams, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spread AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, w[i:i + k - 1] AS w, count(*) AS f
  FROM spread, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE i + k - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, w[1:len(w) - 1] AS part, f FROM grams WHERE len(w) > 1
    UNION ALL SELECT lang, w[2:], f FROM grams WHERE len(w) > 1) GROUP BY ALL),
cuts AS (
  SELECT g.lang, g.w, g.f AS a, k, p.f AS l, s.f AS r, t.n,
         (1000::HUGEINT * g.f * t.n) // (p.f::HUGEINT * s.f) AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM grams) g
  JOIN grams p ON p.lang = g.lang AND p.w = g.w[1:k]
  JOIN grams s ON s.lang = g.lang AND s.w = g.w[k + 1:]
  JOIN totals t ON t.lang = g.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer x ON x.lang = c.lang AND x.part = c.w
  WHERE x.f IS NULL OR x.f < c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank,
       array_to_string(w, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) <= {TOP}
"""
