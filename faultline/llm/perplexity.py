"""Quality rules: text counts and language-specific perplexity bands.

The language model has two parts, each modified Kneser-Ney and one per language. Character
n-grams inside words give a word its probability by itself. Over them stands a class
trigram over the running text, across blanks and line breaks: a frequent word is a class of
its own, any other word belongs to the class of its shape, and a word that repeats the last
word or the one before it is of the class of such repeats. So

    P(word | text before) = P(class | two classes before) * P(word) / P(shape or frequent word)

and, for a repeat, the first factor alone. Perplexity is per word. Spark counts both parts
over all documents: the words of every text, the n-grams of every distinct word, the class
trigrams of every text, the lower orders from the orders above them.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.stage import staged
from .common import documents, no_worker_state, row_key, without, worker_state
from .words import WordBatch, byte_batches, byte_kinds, spans

ORDER = 5
#: Stands for what is before and after a word.
EDGE = " "
#: Distinct words counted in a task before they are handed on.
HELD_WORDS = 200_000
#: Word scores a Python worker remembers, by language.
KNOWN_WORDS = 600_000
#: N-grams of a model that is sent to the executors (16 bytes each). A larger model stays a
#: table, and words are scored by a join.
SHIPPED_NGRAMS = 6_000_000
#: Words of a language that are a class of their own. There are fewer than CLASSES classes,
#: so that a language has at most CLASSES ** CONTEXT class trigrams, however long the texts.
FREQUENT = 100
CLASSES = 128
CONTEXT = 3
#: Classes: before the text, the word before again, the word before that again; then 18
#: shapes, then frequent words.
START, AGAIN, LATER, SHAPES, NAMED = 0, 1, 2, 3, 21

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


# ---- counts of a text ---------------------------------------------------------------

SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
KINDS = byte_kinds(SPACES)
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Bytes that go on with a code point; they are always part of a word.
LATER_BYTES = (np.arange(256) & 0xC0) == 0x80


def repeated_words(batch: WordBatch, n: int) -> np.ndarray:
    """Per text: words in five-word windows that it has twice or more, the first included."""
    out = np.zeros(n, np.int64)
    last = len(batch.code) - WINDOW + 1
    if last < 2:
        return out
    at = np.flatnonzero(batch.text[:last] == batch.text[WINDOW - 1:])
    # Only windows whose first two words the text has again can be repeated.
    width = len(batch.words) + 1
    key = (batch.text[at] * width + batch.code[at]) * width + batch.code[at + 1]
    if len(key) and (batch.text[-1] + 1) * width * width > 1 << 62:
        key = np.unique(batch.text[at] * width + batch.code[at], return_inverse=True)[1] * width + batch.code[at + 1]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at, key = at[again], key[again]
    # Windows get dense numbers by pairing: no two different windows of a text share one.
    for k in range(2, WINDOW):
        key = np.unique(key, return_inverse=True)[1] * width + batch.code[at + k]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(batch.code) + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(batch.text[covered], minlength=n)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)] if b"\n" in text else []
    return len(lines) - len(set(lines))


def text_counts(texts: list[bytes], batch: WordBatch) -> list[np.ndarray]:
    """The base columns of each text."""
    n = len(texts)
    return [
        np.bincount(batch.text, minlength=n), batch.word_bytes() - batch.count(LATER_BYTES[batch.data]),
        batch.count(SYMBOLS[batch.data]), np.fromiter(map(duplicate_lines, texts), np.int64, n),
        repeated_words(batch, n),
    ]


def by_lang(langs: list[str], texts: list[bytes]) -> Iterator[tuple[str, list[int], list[bytes], WordBatch]]:
    """Texts by language, a bounded part at a time, with their places and words."""
    places: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        places.setdefault(lang, []).append(i)
    for lang, mine in places.items():
        for a, b in spans([texts[i] for i in mine]):
            some = [texts[i] for i in mine[a:b]]
            yield lang, mine[a:b], some, WordBatch(some, KINDS)


# ---- the model ----------------------------------------------------------------------

def words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (lang, text as binary) to partial counts (lang, word, n)."""

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()).cast(pa.string()),
             pa.array(cols[2], pa.int64())], names=["lang", "word", "n"])

    held: dict[str, dict[bytes, int]] = {}
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for lang, _, _, words in by_lang(batch.column(0).to_pylist(), texts):
            seen = held.setdefault(lang, {})
            for word, n in zip(words.words, np.bincount(words.code, minlength=len(words.words)).tolist()):
                seen[word] = seen.get(word, 0) + n
        if sum(map(len, held.values())) > HELD_WORDS:
            yield flush()
            held = {}
    yield flush()


def padded_codes(words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Words between edges as one text, its code points, and where each word's n-grams start."""
    text = "".join([EDGE * (ORDER - 1) + w + EDGE for w in words])
    size = np.array([len(w) + ORDER for w in words], np.int64)
    return text, np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), np.cumsum(size) - size


def counted_grams(langs: dict[str, tuple[list[str], list[int]]]) -> pa.RecordBatch:
    """Counts of n-grams (lang, gram, n) of words by language."""
    names, grams, counts = [], [], [np.zeros(0, np.int64)]
    for lang, (words, numbers) in langs.items():
        text, codes, start = padded_codes(words)
        n = np.diff(np.append(start, len(codes))) - ORDER + 1
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        _, first, which = np.unique(HashArrays.hashes(codes)[at], return_index=True, return_inverse=True)
        # whole numbers stay exact in doubles up to 2**53
        counts.append(np.bincount(which, weights=np.repeat(numbers, n)).astype(np.int64))
        grams += [text[i:i + ORDER] for i in at[first].tolist()]
        names += [lang] * len(first)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(grams, pa.string()), pa.array(np.concatenate(counts), pa.int64())],
        names=["lang", "gram", "n"])


def grams_of(batches):
    """For mapInArrow: (lang, word, n) to partial counts of n-grams (lang, gram, n)."""
    held: dict[str, tuple[list[str], list[int]]] = {}
    size = 0
    for batch in batches:
        for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words, numbers = held.setdefault(lang, ([], []))
            words.append(word)
            numbers.append(n)
        size += batch.num_rows
        if size > HELD_WORDS:
            yield counted_grams(held)
            held, size = {}, 0
    yield counted_grams(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """Every word of every text with its number by language; a missing language is ''."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    words = docs.select(lang, F.col("text").cast("binary").alias("text"))
    return staged(words.mapInArrow(words_of, "lang string, word string, n bigint")
                  .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _smoothed(counts: DataFrame, order: int) -> DataFrame:
    """Discounted probability and the context's back-off weight per n-gram of one order."""
    # Counts of counts give the three discounts of modified Kneser-Ney.
    of = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"t{k}")
    t = counts.groupBy("lang").agg(of(1), of(2), of(3), of(4))
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def discount(k: int) -> Column:
        d = k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}"))
        return F.when((d > 0) & (d < k), d).otherwise(0.5 * k).alias(f"d{k}")  # also for too few counts

    t = staged(t.select("lang", discount(1), discount(2), discount(3)))
    cut = F.col("gram").substr(F.lit(1), F.lit(order - 1))
    rows = counts.withColumn("ctx", cut).join(t, "lang")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("d", d)
    ctx = rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    return rows.join(ctx, ["lang", "ctx"]).select(
        "lang", "gram", "ctx", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("p"),
        (F.col("left") / F.col("total")).alias("back"))


def model(vocab: DataFrame) -> DataFrame:
    """All n-grams of the corpus with their interpolated probability: (lang, gram, p)."""
    return interpolated(staged(
        vocab.mapInArrow(grams_of, "lang string, gram string, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))), ORDER)


def interpolated(top: DataFrame, order: int) -> DataFrame:
    """Probabilities of n-grams (lang, gram, p) from their counts (lang, gram, n)."""
    counts = {order: top}
    for k in range(order - 1, 0, -1):  # how many n-grams of the order above end in it
        tail = F.col("gram").substr(F.lit(2), F.lit(k))
        counts[k] = staged(counts[k + 1].groupBy("lang", tail.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    kinds = counts[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("kinds"))
    lower = _smoothed(counts[1], 1).join(staged(kinds), "lang").select(
        "lang", "gram", (F.col("p") + F.col("back") / F.col("kinds")).alias("p"))
    for k in range(2, order + 1):
        base = lower.select("lang", F.col("gram").alias("_tail"), F.col("p").alias("_p"))
        rows = _smoothed(counts[k], k).withColumn("_tail", F.col("gram").substr(F.lit(2), F.lit(k - 1)))
        lower = staged(rows.join(base, ["lang", "_tail"]).select(
            "lang", "gram", (F.col("p") + F.col("back") * F.col("_p")).alias("p")))
    return lower


class HashArrays:
    """A model as sorted arrays of n-gram hashes beside their log probabilities."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, langs: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs

    @classmethod
    def hashes(cls, codes: np.ndarray) -> np.ndarray:
        """Of the n-grams that start at each place of an array of code points."""
        n = len(codes) - ORDER + 1
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(ORDER):
                h = (h ^ codes[k:k + n]) * cls.MULTIPLIER
                h ^= h >> np.uint64(29)
        return h

    @classmethod
    def of(cls, rows: DataFrame) -> "HashArrays":
        """From the n-grams, hashed and sorted by the executors."""

        def hashed(frames):
            for f in frames:
                codes = np.frombuffer("".join(f["gram"]).encode("utf-32-le"), "<u4").astype(np.uint64)
                h = cls.hashes(codes)[::ORDER] if len(codes) else np.zeros(0, np.uint64)
                yield f.assign(h=h.view(np.int64), logp=np.log(f["p"].to_numpy()))[["lang", "h", "logp"]]

        table = rows.mapInPandas(hashed, "lang string, h bigint, logp double").toArrow()  # size checked
        h, logp = table["h"].to_numpy().view(np.uint64), table["logp"].to_numpy()
        lang = table["lang"].combine_chunks().dictionary_encode()
        which, out = lang.indices.to_numpy(), {}
        for i, name in enumerate(lang.dictionary.to_pylist()):
            mine = np.flatnonzero(which == i)
            mine = mine[np.argsort(h[mine])]
            out[name] = (h[mine], logp[mine])
        return cls(out)

    def score(self, lang: str, words: list[str]) -> np.ndarray:
        """Log probability of each word; an unseen n-gram counts as the rarest seen one."""
        if lang not in self.langs:
            return np.zeros(len(words))
        known, logp = self.langs[lang]
        _, codes, start = padded_codes(words)
        h = self.hashes(codes)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        values = np.where(known[at] == h, logp[at], logp.min())
        size = np.diff(np.append(start, len(codes)))
        sums = np.concatenate([[0.0], np.cumsum(values)])
        return sums[np.minimum(start + size - ORDER + 1, len(values))] - sums[start]


# ---- the context ----------------------------------------------------------------------

def shape(word: str) -> int:
    """The class of a word that is not frequent: its kind of letters and how it ends."""
    end = 2 if word[-1] in ".!?" else 1 if word[-1] in ",;:" else 0
    core = word.strip(".,;:!?()\"'")
    if not any(map(str.isalnum, word)):
        kind = 0
    elif core.isalpha():
        kind = 1 if core.islower() else 2 if core.isupper() and len(core) > 1 else 3
    else:
        kind = 4 if any(map(str.isdigit, word)) else 5
    return SHAPES + 3 * kind + end


def repeats(words: list[bytes]) -> np.ndarray:
    """For each word AGAIN if it is the word before, LATER if the one before that, or else 0."""
    out = np.zeros(len(words), np.int64)
    for back, name in ((2, LATER), (1, AGAIN)):
        if len(words) > back:
            out[back:][np.fromiter(map(eq, words[back:], words), bool, len(words) - back)] = name
    return out


class WordFacts:
    """Log probability and form of words by language, remembered by a Python worker. A word is
    looked up once a batch; its facts are gathered for all its places."""

    def __init__(self, arrays: HashArrays | None, frequent: dict[str, dict[bytes, int]]):
        self.arrays, self.frequent = arrays, frequent
        self.places: dict[str, dict[bytes, int]] = {}
        self.facts: dict[str, tuple[array, array]] = {}

    def _new(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        frequent, texts = self.frequent.get(lang, {}), [w.decode() for w in words]
        logp = self.arrays.score(lang, texts) if self.arrays else np.zeros(len(words))
        return logp, [frequent[w] if w in frequent else shape(t) for w, t in zip(words, texts)]

    def of(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities and forms of distinct words."""
        places = self.places.setdefault(lang, {})
        logps, forms = self.facts.setdefault(lang, (array("d"), array("B")))
        found = list(map(places.get, words))
        new = [i for i, f in enumerate(found) if f is None]
        at = np.fromiter((0 if f is None else f for f in found), np.int64, len(found))
        if len(logps):
            p, form = np.frombuffer(logps, np.float64)[at], np.frombuffer(forms, np.uint8)[at].astype(np.int64)
        else:
            p, form = np.zeros(len(words)), np.zeros(len(words), np.int64)
        if new:
            fresh = [words[i] for i in new]
            p[new], form[new] = self._new(lang, fresh)
            if sum(map(len, self.places.values())) + len(new) <= KNOWN_WORDS:
                places.update(zip(fresh, range(len(logps), len(logps) + len(new))))
                logps.frombytes(p[new].tobytes())
                forms.frombytes(form[new].astype(np.uint8).tobytes())
        return p, form


def repeats_of(batch: WordBatch) -> np.ndarray:
    """The same for the words of a whole batch of texts."""
    code, text = batch.code, batch.text
    out = np.zeros(len(code), np.int64)
    for back, name in ((2, LATER), (1, AGAIN)):
        if len(code) > back:
            out[back:][(code[back:] == code[:-back]) & (text[back:] == text[:-back])] = name
    return out


class Running:
    """Texts in turn as classes of words, unpacked from two bytes a word: form and repeat."""

    def __init__(self, packed: list[bytes]):
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        codes = np.frombuffer(b"".join(packed), "<u2").astype(np.int64)
        self.text = np.repeat(np.arange(len(packed)), sizes)
        self.again, self.forms = np.divmod(codes, CLASSES)
        classes = np.where(self.again > 0, self.again, self.forms)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before = lambda k: np.where(place >= k, np.roll(classes, k), START)
        #: One number per place: its class and the two before.
        self.trigrams = (before(2) * CLASSES + before(1)) * CLASSES + classes

    @staticmethod
    def packed(forms: np.ndarray, again: np.ndarray, text: np.ndarray, n: int) -> list[bytes]:
        data = (again * CLASSES + forms).astype("<u2").tobytes()
        ends = (2 * np.cumsum(np.bincount(text, minlength=n))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def running_by_lang(langs: list[str], packed: list[bytes]) -> Iterator[tuple[str, list[int], Running]]:
    places: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        places.setdefault(lang, []).append(i)
    for lang, mine in places.items():
        yield lang, mine, Running([packed[i] for i in mine])


def frequent_words(vocab: DataFrame) -> dict[str, dict[bytes, int]]:
    """The classes of the FREQUENT most frequent words by language."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    rows = vocab.withColumn("place", place).where(F.col("place") <= FREQUENT).collect()
    out: dict[str, dict[bytes, int]] = {}
    for r in rows:
        out.setdefault(r.lang, {})[r.word.encode()] = NAMED + r.place - 1
    return out


class Contexts:
    """Log probabilities of class trigrams and of forms by language.

    At most CLASSES ** CONTEXT trigrams a language, of 12 bytes each.
    """

    def __init__(self, trigrams: dict[str, tuple[np.ndarray, np.ndarray]], forms: dict[str, np.ndarray]):
        self.trigrams, self.forms = trigrams, forms

    def gains(self, lang: str, run: Running, n: int) -> np.ndarray:
        """What the context adds to each text's log probability, repeated words aside: these also lose their own."""
        if not len(run.forms):
            return np.zeros(n)
        codes, logp = self.trigrams[lang]
        gained = logp[np.searchsorted(codes, run.trigrams)]  # all were counted
        alone = np.where(run.again == 0, self.forms[lang][run.forms], 0.0)
        return np.bincount(run.text, gained - alone, n)


def contexts_of(rows: DataFrame) -> Contexts:
    """Counted by the executors over all texts as classes (lang, packed)."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_worker_state()  # words have been scored
        for batch in batches:
            for lang, _, run in running_by_lang(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, n = np.unique(run.trigrams, return_counts=True)
                forms = np.bincount(run.forms, minlength=CLASSES)
                there = np.flatnonzero(forms)
                names = [lang] * (len(code) + len(there))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(np.concatenate([code, -1 - there]), pa.int64()),
                     pa.array(np.concatenate([n, forms[there]]), pa.int64())], names=["lang", "code", "n"])

    # Trigrams by their code; forms below zero.
    counts = staged(rows.mapInArrow(counted, "lang string, code bigint, n bigint")
                    .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    places = [CLASSES ** k for k in range(CONTEXT - 1, -1, -1)]
    gram = F.concat(*[F.char(F.floor(F.col("code") / k) % CLASSES) for k in places])
    trigrams = interpolated(counts.where("code >= 0").select("lang", gram.alias("gram"), "n"), CONTEXT)
    code = sum((F.ascii(F.substring("gram", i + 1, 1)) * k for i, k in enumerate(places)), F.lit(0))
    table = trigrams.select("lang", code.cast("int").alias("code"), F.log("p").alias("logp")).toArrow()  # bounded
    found, forms = {}, {}
    lang = table["lang"].combine_chunks().dictionary_encode()
    which, codes, logp = lang.indices.to_numpy(), table["code"].to_numpy(), table["logp"].to_numpy()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        at = np.flatnonzero(which == i)
        at = at[np.argsort(codes[at])]
        found[name] = (codes[at], logp[at])
    for r in counts.where("code < 0").collect():  # fewer than CLASSES a language
        forms.setdefault(r.lang, np.zeros(CLASSES))[-1 - r.code] = r.n
    with np.errstate(divide="ignore"):
        forms = {name: np.log(n / n.sum()) for name, n in forms.items()}
    return Contexts(found, forms)


MEASURED = f"doc_id bigint, lang string, {BASE}, logp double, lost double, packed binary, _key bigint"


def measured(docs: DataFrame, shipped_ngrams: int = SHIPPED_NGRAMS) -> DataFrame:
    """Each document's counts, language, log probability of its words by themselves, what
    their context adds to it, and row key.

    Texts are read twice: for the words of the corpus, then to score them. The second time
    each word leaves two bytes, its form and whether it repeats, from which the context is
    counted and scored.
    """
    vocab = vocabulary(docs)
    grams, frequent = model(vocab), frequent_words(vocab)
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.col("text").cast("binary").alias("text"), row_key().alias("_key"))
    shipping = grams.count() <= shipped_ngrams
    shipped = context.broadcast(HashArrays.of(grams).langs if shipping else None)
    job = str(id(shipped))

    def scored(batches):
        state = worker_state("word_facts")
        if job not in state:
            state.clear()  # of an earlier model
            state[job] = WordFacts(HashArrays(shipped.value) if shipped.value is not None else None, frequent)
        yield from _measure(batches, state[job])

    base = staged(rows.mapInArrow(scored, MEASURED))
    found = context.broadcast(contexts_of(base.select("lang", "packed")).__dict__)

    def gained(batches):
        no_worker_state()
        contexts = Contexts(**found.value)
        for batch in batches:
            langs, packed = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "packed"))
            gains = np.zeros(batch.num_rows)
            for lang, places, run in running_by_lang(langs.to_pylist(), packed.to_pylist()):
                gains[places] = contexts.gains(lang, run, len(places))
            at = batch.schema.get_field_index("packed")
            yield batch.set_column(at, "context", pa.array(gains))

    base = base.mapInArrow(gained, MEASURED.replace("packed binary", "context double"))
    columns = [c.split()[0] for c in MEASURED.replace("packed", "context").split(", ") if not c.startswith("lost")]
    if shipping:
        done = staged(base.withColumn("context", F.col("context") - F.col("lost")).select(columns))
        for model_ in (shipped, found):  # what reads them is written down
            model_.destroy()
        pa.default_memory_pool().release_unused()
        return done
    # A larger model scores words by a join, and documents by a join with their words.
    words = rows.dropDuplicates(["_key"]).select("_key", "lang", "text").mapInArrow(
        _words_by_row, "_key bigint, lang string, word string, n bigint, again bigint")
    parts = vocab.mapInPandas(_positions, "lang string, word string, gram string").join(grams, ["lang", "gram"])
    scores = staged(parts.groupBy("lang", "word").agg(F.sum(F.log("p")).alias("logp")))
    sums = words.join(scores, ["lang", "word"]).groupBy("_key").agg(
        F.sum(F.col("logp") * F.col("n")).alias("_logp"), F.sum(F.col("logp") * F.col("again")).alias("_again"))
    return staged(base.join(sums, "_key", "left").withColumns(
        {"logp": F.coalesce("_logp", F.lit(0.0)), "context": F.col("context") - F.coalesce("_again", F.lit(0.0))})
        .select(columns))


def _measure(batches, facts: WordFacts):
    """Without a model, words have a log probability of 0."""
    for batch in batches:
        doc_ids, langs, raws, keys = (batch.column(k) for k in range(4))
        raws = [r or b"" for r in raws.to_pylist()]
        n_rows = len(raws)
        counts = [np.zeros(n_rows, np.int64) for _ in range(5)]
        logp, lost, packed = np.zeros(n_rows), np.zeros(n_rows), [b""] * n_rows
        for lang, places, texts, words in by_lang(langs.to_pylist(), raws):
            p, forms = facts.of(lang, words.words)
            p, forms, again, n = p[words.code], forms[words.code], repeats_of(words), len(texts)
            for column, values in zip(counts, text_counts(texts, words)):
                column[places] = values
            logp[places] = np.bincount(words.text, p, n)
            lost[places] = np.bincount(words.text, np.where(again > 0, p, 0.0), n)
            for i, codes in zip(places, Running.packed(forms, again, words.text, n)):
                packed[i] = codes
        names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "logp", "lost", "packed", "_key"]
        yield pa.RecordBatch.from_arrays(
            [doc_ids, langs, *map(pa.array, counts), pa.array(logp), pa.array(lost), pa.array(packed, pa.binary()),
             keys], names=names)


def _words_by_row(batches):
    for batch in batches:
        rows = []
        for key, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = (text or b"").split()
            again = Counter(compress(words, repeats(words)))
            rows += [(key, lang, w.decode(), n, again[w]) for w, n in Counter(words).items()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
            names=["_key", "lang", "word", "n", "again"])


def _positions(frames):
    import pandas as pd

    for f in frames:
        rows = [(lang, w, padded[i:i + ORDER]) for lang, w in zip(f["lang"], f["word"])
                for padded in (EDGE * (ORDER - 1) + w + EDGE,) for i in range(len(w) + 1)]
        yield pd.DataFrame(rows, columns=["lang", "word", "gram"])


# ---- the rules ----------------------------------------------------------------------

def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def bands(rows: DataFrame) -> DataFrame:
    """Per language, the median and a robust standard deviation of word_ppl and of context.

    Both are taken over the documents that pass the base rules.
    """
    sound = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    columns = ("word_ppl", "context")
    middle = staged(sound.groupBy("lang").agg(
        *[F.percentile_approx(c, 0.5, 10000).alias(f"{c}_middle") for c in columns]))
    off = lambda c: F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_middle")), 0.5, 10000)
    return staged(sound.join(middle, "lang").groupBy("lang", *[f"{c}_middle" for c in columns]).agg(
        *[(off(c) * 1.4826).alias(f"{c}_spread") for c in columns]))


def quality_rules(docs: DataFrame, width: float = 8.0, floor: float = 0.5, short: float = 30.0,
                  shipped_ngrams: int = SHIPPED_NGRAMS, context_width: float = 12.0) -> DataFrame:
    """Counts of every document, the base rules and the perplexity bands of its language.

    Returns doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_ppl (natural logarithm of the perplexity per word; null without
    words), its two parts word_ppl (of the words by themselves) and context (what the words
    before save per word, so that log_ppl is word_ppl - context), low and high of word_ppl,
    context_low and context_high, kept (whether the base rules hold and both parts lie in
    their bands) and _key (the document's ``row_key``).
    A band's bounds lie ``width`` (``context_width``) robust standard deviations of the
    language from its median on either side, at least ``floor``, and
    sqrt(1 + short / n_words) times that, as the mean over few words varies more. The parts
    are held apart because they can cancel out: strange words in a monotonous order have an
    ordinary perplexity. Menus and repeated words stand above the band of context, a word
    order that the language does not have below it.

    Words are runs of anything but ASCII white space. A missing or empty text has no words
    and fails. A missing language is a language of its own. A language without any
    document that passes the base rules has no band and keeps none. Rows that repeat a
    doc_id are judged each. An empty table gives an empty table; other columns take no part.
    """
    byte_batches(docs.sparkSession)
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words"))
    rows = measured(docs, shipped_ngrams).withColumns(
        {"word_ppl": per_word(-F.col("logp")), "context": per_word(F.col("context"))})
    half = lambda w, c: F.greatest(F.lit(w) * F.col(f"{c}_spread"), F.lit(floor)) * F.sqrt(
        1 + F.lit(short) / F.greatest(F.col("n_words"), F.lit(1)))
    words, order = half(width, "word_ppl"), half(context_width, "context")
    rows = rows.join(bands(rows), "lang", "left").withColumns({
        "log_ppl": F.col("word_ppl") - F.col("context"),
        "low": F.col("word_ppl_middle") - words, "high": F.col("word_ppl_middle") + words,
        "context_low": F.col("context_middle") - order, "context_high": F.col("context_middle") + order})
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    inside = F.coalesce(F.col("word_ppl").between(F.col("low"), F.col("high"))
                        & F.col("context").between(F.col("context_low"), F.col("context_high")), F.lit(False))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "log_ppl", "word_ppl", "context", "low", "high", "context_low",
        "context_high", (~failed & inside).alias("kept"), "_key")


def filter_documents(docs: DataFrame, **bands_) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns."""
    return without(docs, quality_rules(docs, **bands_).where("not kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "log_ppl")
