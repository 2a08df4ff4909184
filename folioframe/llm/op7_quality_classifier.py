"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, and quantiles of its perplexity.

Words. Trusted rows are those labelled quality 1 and toxic 0. The model is fitted on all of them but a fifth (by a hash
of doc_id), which is held out for the thresholds. The vocabulary is the MOST_WORDS most frequent words of those seen
MIN_COUNT times or more (fewer where several are as frequent), a bound on what is broadcast; another word becomes the class of its letters, one of CLASSES by
hash. A word like the one before it is an event of its own, which the model never learns. Words are numbers of 21 bits,
so an n-gram is one long, exactly.

Counts. All n-grams of the fitted rows are counted, none is left out or sampled. A task counts its own in blocks and
packs them by shard; shards add the blocks up. A trigram's shard is chosen by its middle word and, where that word is
frequent, by one of several salts of its first word: so the shard holds the trigram, the bigram it backs off to (held
once a salt) and all trigrams with its context. The highest order counts occurrences, the lower ones distinct left
neighbours, each with three discounts; what has one value a word (unigrams, the contexts of bigrams) is broadcast, at
most 2^21 rows.

Scoring is a join of counts in the same shards. Texts are turned into word numbers once, a packed table of blocks; each
block sends its different trigrams with the documents that have them, sorted and packed; the shard's task reads the model's counts first, then block after block, and gives each
document's sum of log probabilities there. Sums are added up by document. This is done in PASSES passes, each for its
share of the shards, so that no more than that share lies in shuffle files at once. No key is gathered: a trigram that
all documents hold costs a block one entry and a list of documents.

Thresholds. A document's score is its log perplexity, in nats a word. A language's threshold is the QUANTILE of all its
held-out rows' scores plus MARGIN nats; a language with fewer than MIN_HELD of them, or none given, takes the quantile
of all. If no row is held out, those of the model serve. A document of n words is kept if it scores no higher than this
plus FEW_WORDS / n nats, as the score of few words says little. Without trusted rows there is no model: score and
threshold are null, and everything is kept.

Null and empty texts have the end of the text as their only word. Repeated rows each give a row. Labels that are
repeated count with their worst values; null labels trust nothing. An empty table gives an empty result. Other columns
have no effect. Tasks hold a block of BLOCK words, or one text where it is longer, and one shard of the model.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.ordering import numbered
from folioframe.llm.packing_bytes import pack, unpack
from folioframe.llm.storage import batches_of, drop_table, fresh_path, shuffles_end_here, write_table
from folioframe.llm.trusted import trusted_ids

MIN_COUNT = 3
HELD_OUT = 5
MIN_HELD = 20
QUANTILE = 0.99
MARGIN = 0.7
FEW_WORDS = 12.0
START, END, AGAIN = 1, 2, 3
WORD_BITS = 21
FIRST_CLASS = 16
FIRST_WORD = 1 << 14
CLASSES = FIRST_WORD - FIRST_CLASS
MOST_WORDS = (1 << 20) - FIRST_WORD
BLOCK = 1 << 19
SHARD_WORDS = 1 << 19
LEAST_SHARDS = 64
PASSES = 8
BLOCKS_AT_ONCE = 16
TEXTS_AT_ONCE = 2_500
MOST_SENT = 1 << 22
_WORD = (1 << WORD_BITS) - 1
_PAIR = (1 << 2 * WORD_BITS) - 1
_MODEL, _ASKED = 0, 1


def letter_class(word: str) -> str:
    """The class of a word that is not in the vocabulary: runs of upper case, lower case, other letters, digits and signs."""
    core, end = (word[:-1], word[-1]) if word[-1] in ".,;:" and len(word) > 1 else (word, "")
    if core.isalpha():
        return "<" + ("a" if core.islower() else "A" if core.isupper() else "Aa" if core.istitle() else "aA") + end
    kinds = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
            if len(kinds) == 8:
                break
    return "<" + "".join(kinds)


@lru_cache(1 << 16)
def _class_number(kind: str) -> int:
    return FIRST_CLASS + xxhash.xxh64_intdigest(kind.encode("utf-8", "surrogatepass"), 7) % CLASSES


def _coded(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the numbers of all words, as `[^\\x20\\x09-\\x0D]+` cuts them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    numbers = vocabulary.numbers(coded.dictionary)
    code = coded.indices.to_numpy()
    word = numbers[code] if len(code) else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    code, at, word = code[word > 0], at[word > 0], word[word > 0]
    word[np.flatnonzero((code[1:] == code[:-1]) & (at[1:] == at[:-1])) + 1] = AGAIN
    return np.bincount(at, minlength=len(texts)), word


def _trigrams(count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that ends at each word and at each text's end, and the place of its text."""
    at = np.repeat(np.arange(len(count)), count)
    end = np.cumsum(count + 3)
    joined = np.full(int(end[-1]) if len(end) else 0, START, np.int64)
    joined[end - 1] = END
    joined[np.arange(len(word)) + 3 * at + 2] = word
    inside = np.ones(len(joined), bool)
    inside[end - count - 3] = inside[end - count - 2] = False
    three = (joined[:-2] << 2 * WORD_BITS | joined[1:-1] << WORD_BITS | joined[2:])[inside[2:]]
    return three, np.repeat(np.arange(len(count)), count + 1)


def _blocks(batches, text_column: int):
    """The batches in slices of about BLOCK words (eight bytes a word, with its blank)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy() + 8).astype(np.int64)
        parts = max(1, round(int(size[-1]) / (8 * BLOCK))) if len(size) else 0
        block = (size - 1) * parts // size[-1] if parts else size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)


def _rows(batches):
    """The rows of batches, each copied when it is its turn."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(24)


@dataclass(frozen=True)
class Vocabulary:
    """Words, whose numbers count from FIRST_WORD on, as the bytes of an Arrow stream."""

    data: bytes

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of words in the vocabulary, -1 where there is none."""
        known = pa.ipc.open_stream(self.data).read_all().column(0).combine_chunks()
        return pc.fill_null(pc.index_in(words.cast(known.type), value_set=known), -1).to_numpy().astype(np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words, or of their classes; 0 for an empty one."""
        out = self.places(words) + FIRST_WORD
        other = np.flatnonzero(out < FIRST_WORD)
        out[other] = [_class_number(letter_class(w)) if w else 0 for w in words.take(pa.array(other)).to_pylist()]
        return out

    def __contains__(self, word: str) -> bool:
        return bool(self.places(pa.array([word]))[0] >= 0)


@dataclass
class Sharding:
    """How n-grams are dealt to shards. salts[word] is over how many shards a middle word's n-grams lie."""

    shards: int
    salts: np.ndarray

    def of_trigrams(self, three: np.ndarray) -> np.ndarray:
        middle = three >> WORD_BITS & _WORD
        return self.at(middle, _mixed(three >> 2 * WORD_BITS) % self.salts[middle].astype(np.uint64))

    def at(self, middle: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return ((_mixed(middle + (1 << 30)) + salt.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, places) of each shard that occurs, places in their order."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(shard[places[0]]), places


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _packed_counts(key: np.ndarray, count: np.ndarray) -> bytes:
    return pack([np.diff(key, prepend=0), count])


def _unpacked_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, count = unpack(data)
    return np.cumsum(step), count


def _merged(batches):
    """(shard, key, count) of the shards in rows (shard, data), which come sorted by shard."""
    now, keys, counts = None, [], []
    for shard, data in _rows(batches):
        if shard != now and keys:
            yield now, *_added(keys, counts)
            keys, counts = [], []
        now = shard
        key, count = _unpacked_counts(data)
        keys.append(key)
        counts.append(count)
        if len(keys) == 64:  # so that a shard's blocks are never all held apart
            keys, counts = ([x] for x in _added(keys, counts))
    if keys:
        yield now, *_added(keys, counts)


_COUNTS = "shard int, n1 long, n2 long, n3 long, n4 long, data binary"


def _counts_row(shard: int, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    n = [int((count == k).sum()) for k in (1, 2, 3, 4)]
    return pa.RecordBatch.from_pylist([{"shard": shard, "n1": n[0], "n2": n[1], "n3": n[2], "n4": n[3], "data": _packed_counts(key, count)}], _schema(_COUNTS))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _dealt(df: DataFrame, shards: int, *order: str, share: int = 1) -> DataFrame:
    """df dealt out by its column shard, a task a shard (every share-th occurs), each task's rows sorted."""
    return df.repartitionById(-(-shards // share), (F.col("shard") / share).cast("int")).sortWithinPartitions("shard", *order)


def discounts(n: tuple[int, int, int, int]) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and more; n: how many n-grams have the counts 1 to 4."""
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0] + [min(max(k - (k + 1) * y * a / b if b else 0.5, 0.05), float(k)) for k, a, b in ((1, n[1], n[0]), (2, n[2], n[1]), (3, n[3], n[2]))])


@dataclass
class Words:
    """What the model has a value a word for (arrays by word number), beside the discounts."""

    p1: np.ndarray
    total2: np.ndarray
    rest2: np.ndarray
    base: float
    d2: np.ndarray
    d3: np.ndarray


class Part:
    """The trigrams and bigrams of one shard."""

    def __init__(self, words: Words, three: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]):
        self.words, (self.three, self.c3), (self.two, self.c2) = words, three, two
        context = self.three >> WORD_BITS
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
        self.context = context[first]
        self.total3 = np.add.reduceat(self.c3, first).astype(float) if len(first) else np.empty(0)
        self.rest3 = np.add.reduceat(words.d3[np.minimum(self.c3, 3)], first) / self.total3 if len(first) else np.empty(0)

    def log_odds(self, asked: np.ndarray) -> np.ndarray:
        """Log probabilities of trigrams whose last word is not AGAIN."""
        w = self.words
        second, last = asked >> WORD_BITS & _WORD, asked & _WORD
        c2, c3 = _found(self.two, self.c2, asked & _PAIR), _found(self.three, self.c3, asked)
        total2, p1 = w.total2[second], w.p1[last]
        p2 = np.where(total2 > 0, (c2 - w.d2[np.minimum(c2, 3)]) / np.maximum(total2, 1) + w.rest2[second] * p1, p1)
        if len(self.context):
            at = np.minimum(np.searchsorted(self.context, asked >> WORD_BITS), len(self.context) - 1)
            known = self.context[at] == asked >> WORD_BITS
            p3 = (c3 - w.d3[np.minimum(c3, 3)]) / self.total3[at] + self.rest3[at] * p2
            p2 = np.where(known, p3, p2)
        return np.log(p2)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of asked keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


@dataclass
class Model:
    """Words are sent to all tasks; counts of trigrams and bigrams stay in written tables, packed by shard."""

    vocabulary: Vocabulary
    words: Words
    sharding: Sharding
    trigrams: DataFrame
    bigrams: DataFrame
    thresholds: dict[str, float] = field(default_factory=dict)
    overall: float | None = None

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words with the end, log perplexity) of each text, in this process: for few texts under a small model."""
        if not len(texts):
            return np.empty(0, np.int64), np.empty(0)
        pairs = [[_unpacked_counts(r.data) for r in df.select("data").collect()] for df in (self.trigrams, self.bigrams)]
        part = Part(self.words, *(_added([np.empty(0, np.int64), *(x[0] for x in p)], [np.empty(0, np.int64), *(x[1] for x in p)]) for p in pairs))
        count, word = _coded(pa.array(texts, pa.string()), self.vocabulary)
        three, at = _trigrams(count, word)
        odds = np.where(three & _WORD == AGAIN, np.log(self.words.base), part.log_odds(three))
        return count + 1, -np.bincount(at, odds, len(count)) / (count + 1)


def train(docs: DataFrame, labels: DataFrame, max_docs: int | None = None, max_words: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN) -> Model | None:
    """The model of docs (doc_id, text, lang) that labels trust, or None without any; bounds only where they are given."""
    spark = docs.sparkSession
    ids, ids_at = write_table(trusted_ids(labels, max_docs), "trusted-ids")
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT else ids  # else texts are shuffled once
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text is not null").join(ids, "doc_id")
    sample, sample_at = write_table(chosen, "trusted")
    drop_table(spark, ids_at)
    if sample.isEmpty():
        drop_table(spark, sample_at)
        return None
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD_OUT)) == 0
    if max_words is not None:
        within = _within(sample, max_words)
        sample = sample.join(spark.createDataFrame([(d, True) for d in within], "doc_id long, within boolean"), "doc_id", "left")
        held = F.col("within").isNull() | held
    own = sample.where(~held)
    if own.isEmpty():
        own, held = sample if max_words is None else sample.where("within"), F.lit(True)
    model = _counted(own)
    rest = sample.where(held)
    perplexity, sums_at = log_perplexity((own if rest.isEmpty() else rest).select("doc_id", F.col("lang").cast("string").alias("lang"), "text"), model)
    scored, scored_at = write_table(perplexity, "held-out")
    at = F.percentile("log_perplexity", F.lit(quantile)).alias("at")
    model.overall = scored.agg(at).first().at + margin
    limits = scored.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), at).where(F.col("n") >= MIN_HELD)
    model.thresholds = {r.lang: r["at"] + margin for r in limits.toLocalIterator()}  # a row a language
    drop_table(spark, scored_at, sample_at, *sums_at)
    return model


def _vocabulary(own: DataFrame) -> tuple[Vocabulary, Sharding]:
    """The most frequent words, MOST_WORDS at most, and shards for as many n-grams as there are words.

    Words are taken by level of frequency, 64 to a doubling: all of a level or none, as far down as the bound allows.
    """
    spark = own.sparkSession
    counted, counted_at = write_table(own.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").groupBy("w").count(), "words")
    total = (counted.agg(F.sum("count").alias("n")).first().n or 0) + 2 * own.count()
    usable = counted.where(F.col("count") >= MIN_COUNT).withColumn("level", F.floor(F.log2("count") * 64))
    least, held = None, 0
    for r in sorted(usable.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # a few thousand levels
        held += r.n
        if held > MOST_WORDS:
            break
        least = r.level
    chosen = usable.where(F.lit(False) if least is None else F.col("level") >= least).select("w", "count").toArrow()
    chosen = chosen.sort_by([("count", "descending"), ("w", "ascending")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", chosen.schema.field("w").type)])) as out:
        out.write_table(chosen.select(["w"]))
    vocabulary = Vocabulary(sink.getvalue().to_pybytes())
    sent = spark.sparkContext.broadcast(vocabulary)

    def classes(batches):
        for batch in batches:
            number = sent.value.numbers(batch.column(0))
            rare = number < FIRST_WORD
            yield pa.RecordBatch.from_arrays([pa.array(number[rare]), pa.array(batch.column(1).to_numpy()[rare])], ["word", "n"])

    of_class = counted.mapInArrow(classes, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most CLASSES
    drop_table(spark, counted_at)
    share = np.zeros(FIRST_WORD + len(chosen))
    share[START] = own.count() / total
    share[[r.word for r in of_class]] = [r.n / total for r in of_class]
    share[FIRST_WORD:] = chosen.column("count").to_numpy() / total
    shards = max(LEAST_SHARDS, -(-total // SHARD_WORDS))
    return vocabulary, Sharding(shards, np.minimum(1 + np.floor(share * shards), shards).astype(np.int64))


def _counted(own: DataFrame) -> Model:
    """The model of all rows of own, without thresholds."""
    spark = own.sparkSession
    vocabulary, sharding = _vocabulary(own)
    sent = spark.sparkContext.broadcast((vocabulary, sharding))
    size = len(sharding.salts)

    def trigrams(batches):
        vocabulary, sharding = sent.value
        for rows in _blocks(batches, 0):
            three, _ = _trigrams(*_coded(rows.column(0), vocabulary))
            key, count = _added([three[three & _WORD != AGAIN]], [np.ones(int((three & _WORD != AGAIN).sum()), np.int64)])
            found = [(s, _packed_counts(key[at], count[at])) for s, at in _by_shard(sharding.of_trigrams(key), sharding.shards)]
            if found:
                shard, data = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])

    def added(batches):
        for row in _merged(batches):
            yield _counts_row(*row)

    def bigrams(batches):
        """Of each shard's trigrams, the bigrams they end in, with the number of trigrams, for the first word's home."""
        sharding = sent.value[1]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                two = _unpacked_counts(data)[0] & _PAIR
                key, count = _added([two], [np.ones(len(two), np.int64)])
                first = key >> WORD_BITS
                found = [(s, _packed_counts(key[at], count[at])) for s, at in _by_shard(sharding.at(first, np.zeros_like(first)), sharding.shards)]
                shard, data = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])

    def by_word(batches):
        """A row for each context, with its sum and how many bigrams of it have the counts 1, 2 and more; and one for each last word."""
        for batch in batches:
            for data in batch.column(0).to_pylist():
                key, count = _unpacked_counts(data)
                words, at = np.unique(key >> WORD_BITS, return_inverse=True)
                sums = [np.bincount(at, w, len(words)).astype(np.int64) for w in (count, count == 1, count == 2, count > 2)]
                last, n = np.unique(key & _WORD, return_counts=True)
                none = np.zeros(len(last), np.int64)
                columns = [np.concatenate([words, last]), *(np.concatenate([x, none]) for x in sums), np.concatenate([np.zeros(len(words), np.int64), n])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["word", "total", "o", "t", "m", "c1"])

    part = "shard int, data binary"
    three, _ = write_table(_dealt(own.select("text").mapInArrow(trigrams, part), sharding.shards).mapInArrow(added, _COUNTS), "trigrams")
    two, _ = write_table(_dealt(three.select("data").mapInArrow(bigrams, part), sharding.shards).mapInArrow(added, _COUNTS), "bigrams")
    n3, n2 = (tuple(df.agg(*(F.sum(f"n{k}") for k in (1, 2, 3, 4))).first()) for df in (three, two))
    each = two.select("data").mapInArrow(by_word, "word long, total long, o long, t long, m long, c1 long")
    got = each.groupBy("word").agg(*(F.sum(x).alias(x) for x in ("total", "o", "t", "m", "c1"))).toArrow()  # a row a word, at most 2^21
    word, total, ones, twos, more, c1 = (c.to_numpy() for c in got.columns)
    d3, d2 = discounts(n3), discounts(n2)
    d1 = discounts(tuple(int((c1 == k).sum()) for k in (1, 2, 3, 4)))
    base = d1[np.minimum(c1, 3)].sum() / c1.sum() / ((c1 > 0).sum() + 1)
    p1, total2, rest2 = np.full(size, base), np.zeros(size), np.ones(size)
    p1[word] = (c1 - d1[np.minimum(c1, 3)]) / c1.sum() + base
    total2[word] = total
    rest2[word] = (ones * d2[1] + twos * d2[2] + more * d2[3]) / np.maximum(total, 1)
    sent.unpersist()
    return Model(vocabulary, Words(p1, total2, rest2, float(base), d2, d3), sharding, three, two)


def _within(sample: DataFrame, max_words: int) -> list[int]:
    """Ids of the least hash that have max_words words in all; one that does not fit is passed over, and the shortest stays if none fits."""
    words = F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")) + 1
    sizes = sorted((r.h, r.doc_id, r.n) for r in sample.groupBy("h", "doc_id").agg(F.sum(words).alias("n")).collect())
    out, total = [], 0
    for _, doc_id, n in sizes:
        if total + n <= max_words:
            total += n
            out.append(doc_id)
    return out or [min(sizes, key=lambda x: x[2])[1]]


_ROWS = "shard int, kind int, data binary, more binary, ids binary"
_SUMS = "id long, n long, s double"


def _sums(rows: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """(id, n, s) and its tables: words and summed log odds of rows (id: unique, text), a row an id and pass or more."""
    spark = rows.sparkSession
    sharding = model.sharding
    known_words = spark.sparkContext.broadcast(model.vocabulary)
    sent = spark.sparkContext.broadcast((sharding, model.words))

    def coded(batches):
        for block in _blocks(batches, 1):
            count, word = _coded(block.column(1), known_words.value)
            yield pa.RecordBatch.from_arrays([pa.array([pack([block.column(0).to_numpy()])]), pa.array([pack([count, word])])], ["ids", "words"])

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), _schema(_ROWS).types, strict=True)], _schema(_ROWS).names)

    def asked(now):
        def run(batches):
            sharding = sent.value[0]
            for ids, words in _rows(batches):
                (ids,), (count, word) = unpack(ids), unpack(words)
                three, at = _trigrams(count, word)
                again = three & _WORD == AGAIN
                found = []
                if now == 0:  # what needs no shard: the words of each text, and its repeated words
                    repeats = np.bincount(at[again], minlength=len(ids))
                    found.append((int(ids[0] % sharding.shards) // PASSES * PASSES, _ASKED, pack([count + 1, repeats]), None, pack([ids])))
                shard = sharding.of_trigrams(three)
                mine = ~again & (shard % PASSES == now)
                three, at, shard = three[mine], at[mine], shard[mine]
                order = np.argsort(three, kind="stable")  # documents stay in order
                three, at, shard = three[order], at[order], shard[order]
                for s, places in _by_shard(shard, sharding.shards):
                    key, doc = three[places], at[places]
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    docs, local = np.unique(doc, return_inverse=True)
                    found.append((s, _ASKED, pack([np.diff(key[first], prepend=0), np.diff(first, append=len(key))]), pack([local]), pack([ids[docs]])))
                if found:
                    yield batch_of(found)

        return run

    def model_rows(now):
        def run(batches):
            """Trigrams as they are; bigrams for each shard that their first word is dealt to."""
            sharding = sent.value[0]
            for shard, order, data in _rows(batches):
                if order == 3:
                    yield batch_of([(shard, _MODEL, None, data, None)])
                    continue
                key, count = _unpacked_counts(data)
                first = key >> WORD_BITS
                salts = sharding.salts[first]
                place = np.repeat(np.arange(len(key)), salts)
                salt = np.arange(len(place)) - np.repeat(np.cumsum(salts) - salts, salts)
                to = sharding.at(first[place], salt)
                mine = to % PASSES == now
                place, to = place[mine], to[mine]
                found = [(s, _MODEL, _packed_counts(key[place[x]], count[place[x]]), None, None) for s, x in _by_shard(to, sharding.shards)]
                if found:
                    yield batch_of(found)

        return run

    def answered(batches):
        words = sent.value[1]
        now, part, three, two = None, None, [], []
        for batch in batches:
            ids, ns, sums = [], [], []
            for shard, kind, data, more, who in _rows([batch]):
                if shard != now:
                    now, part, three, two = shard, None, [], []
                if kind == _MODEL:
                    (three if data is None else two).append(_unpacked_counts(data or more))
                    continue
                docs = unpack(who)[0]
                if more is None:
                    n, repeats = unpack(data)
                    ids.append(docs)
                    ns.append(n)
                    sums.append(repeats * np.log(words.base))
                    continue
                if part is None:
                    nothing = (np.empty(0, np.int64),) * 2
                    part = Part(words, *(_added(*zip(nothing, *x, strict=True)) for x in (three, two)))
                    three = two = []
                step, runs = unpack(data)
                odds = np.repeat(part.log_odds(np.cumsum(step)), runs)
                ids.append(docs)
                ns.append(np.zeros(len(docs), np.int64))
                sums.append(np.bincount(unpack(more)[0], odds, len(docs)))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, ns, sums)], ["id", "n", "s"])

    paths = []
    with batches_of(spark, TEXTS_AT_ONCE):
        blocks, blocks_at = write_table(rows.select("id", "text").mapInArrow(coded, "ids binary, words binary"), "coded")
    known = model.trigrams.select("shard", F.lit(3).alias("order"), "data")
    pairs = model.bigrams.select("shard", F.lit(2).alias("order"), "data")
    for now in range(PASSES):
        counts = known.where(F.col("shard") % PASSES == now).union(pairs).mapInArrow(model_rows(now), _ROWS)
        every = counts.union(blocks.mapInArrow(asked(now), _ROWS))
        sums = _dealt(every, sharding.shards, "kind", share=PASSES).mapInArrow(answered, _SUMS)
        paths.append(fresh_path(spark, "sums"))
        with shuffles_end_here(spark), batches_of(spark, BLOCKS_AT_ONCE):
            sums.groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).write.parquet(paths[-1])
    drop_table(spark, blocks_at)
    return spark.read.schema(_SUMS).parquet(*paths), paths


def log_perplexity(docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """(doc_id, lang, n_words, log_perplexity) of each row of docs (doc_id, lang, text), and the tables it is read from."""
    own, number = numbered(docs)
    parts, paths = _sums(own.select(F.col(number).alias("id"), F.col("text").cast("string").alias("text")), model)
    sums = parts.groupBy("id").agg(F.sum("n").alias("n_words"), F.sum("s").alias("s"))
    found = own.join(sums, own[number] == sums["id"])
    return found.select("doc_id", "lang", "n_words", (-F.col("s") / F.col("n_words")).alias("log_perplexity")), paths


def _judged(docs: DataFrame, model: Model) -> DataFrame:
    own = docs.sparkSession.createDataFrame(list(model.thresholds.items()), "lang string, own double")
    threshold = F.coalesce("own", F.lit(model.overall).cast("double")) + FEW_WORDS / F.col("n_words")
    found = log_perplexity(docs, model)[0].join(F.broadcast(own), "lang", "left").withColumn("threshold", threshold)
    return found.withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity, threshold, kept) of every row; n_words counts the end of the text."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    if model is None:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        none = F.lit(None).cast("double")
        return named.select("doc_id", "lang", n.cast("long").alias("n_words"), none.alias("log_perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    return _judged(named, model).select("doc_id", "lang", "n_words", "log_perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns as they are."""
    if model is None:
        return docs
    own, number = numbered(docs)
    named = own.select(F.col(number).alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    bad = _judged(named, model).where(~F.col("kept")).select(F.col("doc_id").alias(number))
    return own.join(bad, number, "left_anti").select(*[own[c] for c in docs.columns])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: perplexity under the model of trusted text, its language's threshold, and the verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
