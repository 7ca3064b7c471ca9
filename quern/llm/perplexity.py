"""Quality rules by n-gram perplexity (operator 5).

A modified Kneser-Ney model over UTF-8 bytes is counted by Spark on every
document, per language.  Each order is stored as an array of 64-bit hashes in
ascending order beside its log probabilities; a small directory over the top
hash bits finds an entry in about one probe.  A document's perplexity is taken
per word, so that decoration between words (symbols, separators, capitals) is
not diluted by its own predictable characters.  Language-specific lower and
upper bands, by length class, come from documents labelled good.

Scale.  Counting is one narrow scan: a task holds only the distinct n-grams of
its split and ships those (map-side combine).  Continuation counts, discounts,
sums by context and probabilities are Spark aggregations and joins over the
distinct n-grams, so no language's model is built in one place.  Models of at
most ``MAX_MODEL_BYTES`` together are broadcast; beyond it each text moves once,
to a place of its language (one for every ``TEXT_BYTES_A_PLACE`` of text) that
the language's arrays are sent to, where the same scorer reads them.
Bands come from all labelled rows, by counts of slices and the order inside a few.  A model
of byte 5-grams saturates, so a language's fits a worker.

Defined cases: NULL or blank text has no word, hence no perplexity, and is
rejected; a NULL language is its own language ''; NULL ids pass through;
repeated rows each get their own (equal) decision; without two documents
labelled good nothing is judged and all with a word stay; in scripts written
without blanks every character counts as a word; perplexities are given up to
2 ** 1023; an empty table gives an empty result.  Other columns are kept as
they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quern.llm import kernels as K
from quern.llm.common import col, free_name, small_batches
from quern.session import cut

ORDER = 5
MAX_MODEL_BYTES = 96 << 20
ENTRIES_A_PART = 500_000
TEXT_BYTES_A_PLACE = 256 << 20
MAX_BROADCAST_IDS = 500_000
MIN_LABELS_IN_CLASS = 40
TAIL = 0.002
SLACK_BITS = 0.15
DEVIATIONS = 4.0
MAX_BROADCAST_BANDS = 100_000

#: Code points of scripts written without blanks between words: Thai to Lao, Myanmar, Khmer, kana, Han.
_UNSEGMENTED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0] = 32
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for Basic Latin and Latin-1, digits as one class, NUL as a blank."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[upper] += 32
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    enc = column.fill_null("").dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary.to_pylist()


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            lang, names = _codes(batch.column(0))
            data, off = K.utf8_view(batch.column(1))
            for lo, hi in K.chunks(off):
                part, o = fold(data[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo]
                keys = K.ngram_keys(part, o, order)
                here = lang[lo:hi]
                present = np.unique(here)
                who = np.repeat(here, np.diff(o)) if len(present) > 1 else None
                for code in present:
                    own = keys if who is None else keys[who == code]
                    parts = held.setdefault(names[code], [])
                    parts.append(np.unique(own, return_counts=True))
                    if len(parts) >= 16:
                        parts[:] = [_merge(parts)]
        for name, parts in held.items():
            keys, counts = _merge(parts)
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k), pa.array(counts[a : a + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    return count


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over every document; ``gram`` packs the last ``order`` bytes, zeros before the text."""
    own = small_batches(docs).select(col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text"))
    return own.mapInArrow(_counter(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(c: np.ndarray) -> np.ndarray:
    """Chen and Goodman's three discounts from counts of counts, per entry."""
    n1, n2, n3, n4 = (max(int((c == i).sum()), 1) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    d = np.clip(d, 0.05, [1.0, 0.95, 1.9, 2.85])
    return d[np.minimum(c, 3).astype(np.int64)]


def kneser_ney(keys: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Interpolated modified Kneser-Ney: per order 1..n (grams, -log2 p, contexts, -log2 back-off weight).

    The highest order uses counts, the lower ones the number of distinct bytes
    seen before the n-gram; order 0 is uniform over 256 bytes.
    """
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {order: (keys, counts)}
    for n in range(order - 1, 0, -1):
        grams[n] = np.unique(grams[n + 1][0] & np.uint64((1 << (8 * n)) - 1), return_counts=True)
    out, below = [], np.zeros(0)
    for n in range(1, order + 1):
        g, c = grams[n]
        d = _discounts(c)
        ctx, inv = np.unique(g >> np.uint64(8), return_inverse=True)
        total = np.bincount(inv, c)
        gamma = np.bincount(inv, d) / total
        if n == 1:
            low = np.full(len(g), 1 / 256)
        else:
            low = below[np.searchsorted(grams[n - 1][0], g & np.uint64((1 << (8 * (n - 1))) - 1))]
        below = (c - d) / total[inv] + gamma[inv] * low
        out.append((g, -np.log2(below), ctx, -np.log2(gamma)))
    return out


class HashArray:
    """float32 values under 64-bit keys: hashes in ascending order and a directory over their top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = K.mix64(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, int(len(h)).bit_length()))
        edges = np.searchsorted(self.hashes >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64))
        self.first = edges.astype(np.int64)
        self.depth = int(np.max(np.diff(edges))) if len(h) else 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); an absent key has value 0."""
        out, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        if not len(self.hashes) or not len(keys):
            return out, found
        h = K.mix64(keys)
        at = self.first[(h >> self.shift).astype(np.int64)]
        last = len(self.hashes) - 1
        hit = self.hashes[np.minimum(at, last)] == h
        pos = np.minimum(at, last)
        todo = np.flatnonzero(~hit)
        for step in range(1, self.depth):
            if not len(todo):
                break
            p = np.minimum(at[todo] + step, last)
            ok = self.hashes[p] == h[todo]
            pos[todo[ok]] = p[ok]
            hit[todo[ok]] = True
            todo = todo[~ok]
        out[hit] = self.values[pos[hit]]
        return out, hit


class Scorer:
    """A language's model; scores bytes with back-off for what was never counted."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.order = len(levels)
        self.grams = [HashArray(g, v) for g, v, _, _ in levels]
        self.back = [HashArray(c, b) for _, _, c, b in levels]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        out, found = self.grams[-1].find(keys)
        todo = np.flatnonzero(~found)
        for n in range(self.order, 0, -1):  # back-off weight of the context, then the shorter gram
            if not len(todo):
                break
            out[todo] += self.back[n - 1].find((keys[todo] & np.uint64((1 << (8 * n)) - 1)) >> np.uint64(8))[0]
            if n == 1:
                out[todo] += 8.0
                break
            value, found = self.grams[n - 2].find(keys[todo] & np.uint64((1 << (8 * (n - 1))) - 1))
            out[todo] += value
            todo = todo[~found]
        return out


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each row: runs without white space; in scripts that write none between words every character counts as one."""
    start, end, row = K.words(data, offsets, ~K.IS_SPACE)
    rows = len(offsets) - 1
    at = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] < 0xF8)) if len(data) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return np.bincount(row, minlength=rows)
    b = data.astype(np.int64)
    four = data[at] >= 0xF0
    point = np.where(four, ((b[at] & 7) << 18) | ((b[at + 1] & 63) << 12) | ((b[at + 2] & 63) << 6), ((b[at] & 15) << 12) | ((b[at + 1] & 63) << 6) | (b[at + 2] & 63))
    alone = np.zeros(len(at), bool)
    for low, high in _UNSEGMENTED:
        alone |= (point >= low) & (point <= high)
    at, four = at[alone], four[alone]
    other = np.ones(len(data) + 1, np.int64)
    for step in range(4):
        other[np.minimum(at[four] if step == 3 else at, len(data) - step - 1) + step] = 0
    sums = np.concatenate(([0], np.cumsum(other[:-1])))
    mixed = sums[end] > sums[start]
    return np.bincount(row[mixed], minlength=rows) + np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=rows)


def build(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, level, context, key, value): -log2 of the probabilities of all n-grams and of the back-off weights of their contexts.

    The formulas are those of ``kneser_ney``, as aggregations and joins: counts of
    the shorter n-grams, counts of counts, sums by context, and probabilities from
    the shortest order up.  No language is ever in one place.
    """
    level = counts.select("lang", F.lit(order).alias("level"), "gram", F.col("n").alias("c"))
    levels = [level]
    for n in range(order - 1, 0, -1):
        level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1)).alias("gram")).agg(F.count("*").alias("c")).select("lang", F.lit(n).alias("level"), "gram", "c")
        levels.append(level)
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    grams = cut(grams)
    many = lambda i: F.greatest(F.count_if(F.col("c") == i), F.lit(1)).cast("double")
    sizes = cut(grams.groupBy("lang", "level").agg(*(many(i).alias(f"n{i}") for i in (1, 2, 3, 4))))
    few = sizes.count() <= MAX_BROADCAST_BANDS
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    held = lambda x, top: F.greatest(F.lit(0.05), F.least(x, F.lit(top)))
    sizes = sizes.select("lang", "level", held(1 - 2 * y * F.col("n2") / F.col("n1"), 0.95).alias("d1"), held(2 - 3 * y * F.col("n3") / F.col("n2"), 1.9).alias("d2"), held(3 - 4 * y * F.col("n4") / F.col("n3"), 2.85).alias("d3"))
    grams = grams.join(F.broadcast(sizes) if few else sizes, ["lang", "level"])
    grams = grams.select("lang", "level", "gram", F.shiftright("gram", 8).alias("ctx"), "c", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
    contexts = cut(grams.groupBy("lang", "level", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")))
    grams = cut(grams.join(contexts, ["lang", "level", "ctx"]).select("lang", "level", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "gamma"))
    below, out = None, []
    for n in range(1, order + 1):
        here = grams.where(F.col("level") == n)
        if below is None:
            here = here.select("lang", "gram", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            low = below.select("lang", F.col("gram").alias("short"), F.col("p").alias("low"))
            here = here.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))).join(low, ["lang", "short"]).select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("low")).alias("p"))
        below = here
        out.append(here.select("lang", F.lit(n).alias("level"), F.lit(False).alias("context"), F.col("gram").alias("key"), (-F.log2("p")).cast("float").alias("value")))
    model = contexts.select("lang", "level", F.lit(True).alias("context"), F.col("ctx").alias("key"), (-F.log2("gamma")).cast("float").alias("value"))
    for part in out:
        model = model.unionByName(part)
    return cut(model)


_PART = "lang string, level int, context boolean, part int, keys binary, bits binary"


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(*key, rows["key"].to_numpy(np.int64).tobytes(), rows["value"].to_numpy(np.float32).tobytes())], columns=["lang", "level", "context", "part", "keys", "bits"])


def _scorers(parts: list[tuple[str, int, bool, bytes, bytes]]) -> dict[str, Scorer]:
    """Scorers by language from packed parts (language, level, context?, keys, values)."""
    held: dict[str, dict[tuple[int, bool], list]] = {}
    for lang, level, context, keys, bits in parts:
        held.setdefault(lang, {}).setdefault((level, context), []).append((np.frombuffer(keys, np.uint64), np.frombuffer(bits, np.float32)))
    out = {}
    for lang, tables in held.items():
        top = max(level for level, _ in tables)
        both = {k: [np.concatenate(x) for x in zip(*v, strict=True)] for k, v in tables.items()}
        out[lang] = Scorer([(*both[n, False], *both[n, True]) for n in range(1, top + 1)])
    return out


class _Texts:
    """Bits and words of a batch of texts with their languages."""

    def __init__(self, order: int):
        self.order = order
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        self.unknown = Scorer([(*nothing, *nothing)])

    def score(self, langs: pa.Array, texts: pa.Array, scorers) -> tuple[np.ndarray, np.ndarray]:
        """``scorers`` gives a language's model, or None; without one every byte costs 8 bits."""
        code, names = _codes(langs)
        data, off = K.utf8_view(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi in K.chunks(off):
            raw, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            part = fold(raw)
            keys = K.ngram_keys(part, o, self.order)
            here = code[lo:hi]
            present = np.unique(here)
            who = np.repeat(here, np.diff(o)) if len(present) > 1 else None
            cost = np.zeros(len(keys), np.float32)
            for c in present:
                scorer = scorers(names[c]) or self.unknown
                if who is None:
                    cost = scorer.bits(keys)
                else:
                    own = np.flatnonzero(who == c)
                    cost[own] = scorer.bits(keys[own])
            sums = np.concatenate(([0.0], np.cumsum(cost, dtype=np.float64)))
            total[lo:hi] = sums[o[1:]] - sums[o[:-1]]
            count[lo:hi] = word_counts(raw, o)
        return total, count


class Model:
    """Per-language models, built by Spark; broadcast when they fit ``max_model_bytes``, sent to their texts otherwise."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, max_model_bytes: int = MAX_MODEL_BYTES):
        self.order, self.text, self.lang = order, text, lang
        self.table = build(cut(count_ngrams(docs, text, lang, order)), order)
        sizes = cut(self.table.groupBy("lang", "level", "context").agg(F.count("*").alias("n")))
        few = sizes.count() <= MAX_BROADCAST_BANDS
        self.small = (sizes.agg(F.sum("n")).first()[0] or 0) * 12 <= max_model_bytes
        parts = sizes.select("lang", "level", "context", F.ceil(F.col("n") / ENTRIES_A_PART).alias("parts"))
        split = self.table.join(F.broadcast(parts) if few else parts, ["lang", "level", "context"])
        split = split.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select("lang", "level", "context", "part", "key", "value")
        self.packed = split.groupBy("lang", "level", "context", "part").applyInPandas(_pack, _PART)
        if self.small:
            rows = self.packed.select("lang", "level", "context", "keys", "bits").collect()
            self.shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
        else:
            self.packed = cut(self.packed)

    def score(self, docs: DataFrame, bits: str, words: str, text: str | None = None, lang: str | None = None) -> DataFrame:
        """``docs`` with two more columns: total bits and number of words."""
        own = (text or self.text, lang or self.lang)
        return self._by_broadcast(docs, bits, words, *own) if self.small else self._by_place(docs, bits, words, *own)

    def _by_broadcast(self, docs: DataFrame, bits: str, words: str, text: str, lang: str) -> DataFrame:
        shared, order = self.shared, self.order
        schema = T.StructType([*docs.schema.fields, T.StructField(bits, T.DoubleType()), T.StructField(words, T.LongType())])
        at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, scorers = _Texts(order), None
            for batch in batches:
                scorers = scorers or _scorers(shared.value)
                total, count = texts.score(batch.column(at_lang).cast(pa.string()), batch.column(at_text), scorers.get)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total), pa.array(count)], [*batch.schema.names, bits, words])

        return docs.mapInArrow(run, schema)

    def _by_place(self, docs: DataFrame, bits: str, words: str, text: str, lang: str) -> DataFrame:
        """The same for a model too large to broadcast: texts move once, to a place of their language that its model is sent to.

        A language has a place for every ``TEXT_BYTES_A_PLACE`` of its text, so a task
        holds one language's model and nothing of the others.
        """
        order = self.order
        schema = T.StructType([*docs.schema.fields, T.StructField(bits, T.DoubleType()), T.StructField(words, T.LongType())])
        at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)
        name = F.coalesce(col(lang).cast("string"), F.lit(""))
        places = cut(docs.groupBy(name.alias("_l")).agg(F.ceil((F.coalesce(F.sum(F.octet_length(col(text).cast("string"))), F.lit(0)) + 1) / F.lit(TEXT_BYTES_A_PLACE)).alias("_many")))
        few = places.count() <= MAX_BROADCAST_BANDS
        flat = [col(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]
        own = docs.select(name.alias("_l"), F.xxhash64(*flat).alias("_h"), F.struct(*(col(c) for c in docs.columns)).alias("_doc"))
        own = own.join(F.broadcast(places) if few else places, "_l").select("_l", F.pmod("_h", "_many").alias("_place"), F.lit(True).alias("_is"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("context"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("bits"), "_doc")
        model = self.packed.join(places, self.packed["lang"] == places["_l"]).withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
        model = model.select("_l", "_place", F.lit(False).alias("_is"), "level", "context", "keys", "bits", F.lit(None).cast(own.schema["_doc"].dataType).alias("_doc"))
        ready = own.unionByName(model).repartition("_l", "_place").sortWithinPartitions("_l", "_place", "_is")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, area, held, scorer = _Texts(order), None, [], None
            for batch in batches:
                langs, at, is_doc = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                edges = [i for i in range(1, len(at)) if (langs[i], at[i], is_doc[i]) != (langs[i - 1], at[i - 1], is_doc[i - 1])]
                for lo, hi in zip([0, *edges], [*edges, len(at)], strict=True):
                    if lo == hi:
                        continue
                    if area is None or langs[lo] != area[0] or at[lo] != area[1]:
                        same = area is not None and langs[lo] == area[0] and scorer is not None
                        area, held = (langs[lo], at[lo], same), []
                        scorer = scorer if same else None  # the next place of a language has the same model
                    part = batch.slice(lo, hi - lo)
                    if not is_doc[lo]:
                        if not area[2]:
                            held += zip(langs[lo:hi], part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)
                        continue
                    if scorer is None:
                        scorer = _scorers(held).get(area[0]) if held else None
                        held = []
                    docs_of = part.column(7).flatten()
                    total, count = texts.score(docs_of[at_lang].cast(pa.string()), docs_of[at_text], lambda _, s=scorer: s)
                    yield pa.RecordBatch.from_arrays([*docs_of, pa.array(total), pa.array(count)], schema.names)

        return ready.mapInArrow(run, schema)


def length_class(words: str):
    """floor(log2(words)), from 0 to 20."""
    return F.least(F.floor(F.log2(F.greatest(F.col(words), F.lit(1)))), F.lit(20)).cast("int")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(keys, n, q): the quantiles of ``value`` at ``shares`` with linear interpolation, NULL keys being a group.

    Values are counted by slices of 1 / 64 first, then only those of the slices
    that hold a wanted rank are put in order, so no task holds or sorts a group.
    """
    rank = [f"_r{i}" for i in range(2 * len(shares))]
    slices = rows.groupBy(*keys, F.floor(F.col(value) * 64).alias("_slice")).agg(F.count("*").alias("_n"))
    up = W.partitionBy(*keys).orderBy("_slice")
    slices = slices.withColumn("_before", F.sum("_n").over(up) - F.col("_n")).withColumn("n", F.sum("_n").over(W.partitionBy(*keys)))
    for i, share in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(share)
        slices = slices.withColumn(rank[2 * i], F.floor(at)).withColumn(rank[2 * i + 1], F.ceil(at))
    inside = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_n"))
    wanted = slices.where(F.array_max(F.array(*(inside(r) for r in rank))))
    some = rows.select(*(F.col(k).alias("_k" + k) for k in keys), F.floor(F.col(value) * 64).alias("_s"), F.col(value).alias("_v")).groupBy(*("_k" + k for k in keys), "_s", "_v").agg(F.count("*").alias("_many"))
    same = F.col("_slice") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k" + k))
    some = wanted.join(some, same)
    last = F.sum("_many").over(W.partitionBy(*keys, "_slice").orderBy("_v")) + F.col("_before")
    some = some.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_many"))
    found = some.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when((F.col(r) >= F.col("_first")) & (F.col(r) < F.col("_last")), F.col("_v"))).alias(r) for r in rank))
    parts = []
    for i, share in enumerate(shares):
        at, low, high = (F.col("n") - 1) * F.lit(share), F.col(rank[2 * i]), F.col(rank[2 * i + 1])
        parts.append(low + (high - low) * (at - F.floor(at)))
    return found.select(*keys, "n", F.array(*parts).alias("q"))


def fit_bands(model: Model, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", max_broadcast_ids: int = MAX_BROADCAST_IDS, tail: float = TAIL, slack: float = SLACK_BITS) -> DataFrame:
    """(lang, class, low, high) in bits a word from every labelled row.

    Documents labelled good give the ``tail`` and ``1 - tail`` quantiles, widened
    by ``slack``.  A class with under MIN_LABELS_IN_CLASS of them takes the class
    of all languages, and where that is as small the language's mean with
    ``DEVIATIONS`` deviations.  Language NULL stands for all languages together.
    Up to ``max_broadcast_ids`` labelled ids go to the texts; beyond it all texts are
    scored, and only their figures are joined to the labels by shuffle.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    own = docs.select(col(doc_id).alias("_id"), col(model.lang).cast("string").alias("lang"), col(model.text).cast("string").alias("text"))
    few = good.limit(max_broadcast_ids + 1).count() <= max_broadcast_ids
    if few:
        own = own.join(F.broadcast(good), "_id", "left_semi")
    scored = model.score(own, "bits", "words", "text", "lang").where("words > 0").select("_id", F.coalesce("lang", F.lit("")).alias("lang"), length_class("words").alias("class"), (F.col("bits") / F.col("words")).alias("rate"))
    if not few:
        scored = scored.join(good.hint("merge"), "_id", "left_semi")
    scored = cut(scored.select("lang", "class", "rate"))
    both = scored.unionByName(scored.withColumn("lang", F.lit(None).cast("string")))
    bands = exact_quantiles(both, ["lang", "class"], "rate", (tail, 1 - tail))
    bands = bands.where(F.col("n") >= MIN_LABELS_IN_CLASS).select("lang", "class", (F.col("q")[0] - slack).alias("low"), (F.col("q")[1] + slack).alias("high"))
    # classes with fewer labels: mean and spread, whose variance falls as 1/words, from all labels together
    every = scored.agg(F.count("*").alias("n"), F.avg("rate").alias("m")).first()
    if every["n"] < 2:
        return bands
    centre = both.groupBy("lang").agg(F.avg("rate").alias("centre"))
    gap = F.pow(F.col("rate") - every["m"], F.lit(2))
    line = scored.agg(F.regr_slope(gap, F.pow(F.lit(2.0), -F.col("class"))).alias("b"), F.regr_intercept(gap, F.pow(F.lit(2.0), -F.col("class"))).alias("a"), F.avg(gap).alias("v")).first()
    slope, base = max(line["b"] or 0.0, 0.0), max(line["a"] or 0.0, 0.1 * line["v"], 0.01)
    wide = F.lit(DEVIATIONS) * F.sqrt(F.lit(base) + slope * F.pow(F.lit(2.0), -F.col("class"))) + slack
    classes = docs.sparkSession.range(21).select(F.col("id").cast("int").alias("class"))
    smooth = centre.crossJoin(classes).select("lang", "class", (F.col("centre") - wide).alias("low"), (F.col("centre") + wide).alias("high"))
    missing = smooth.alias("s").join(bands.alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")) & (F.col("s.class") == F.col("b.class")), "left_anti")
    pooled = bands.where("lang IS NULL").select("class", F.col("low").alias("_low"), F.col("high").alias("_high"))
    return bands.unionByName(missing.join(pooled, "class", "left").select("lang", "class", F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high")))


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER, detail: bool = False, **limits) -> DataFrame:
    """The documents inside their band, with the columns of ``docs``; ``detail`` adds words, perplexity and band.

    The bands are a table of languages times length classes, broadcast up to
    ``MAX_BROADCAST_BANDS`` rows and joined by shuffle beyond.
    """
    model = Model(docs, text, lang, order, limits.pop("max_model_bytes", MAX_MODEL_BYTES))
    bands = cut(fit_bands(model, docs, labels, doc_id, **limits))
    few = bands.count() <= MAX_BROADCAST_BANDS
    bits, words = free_name(docs, "_bits"), free_name(docs, "_words")
    low, high, rate, cls = (free_name(docs, x, (bits, words)) for x in ("_low", "_high", "_rate", "_class"))
    scored = model.score(docs, bits, words).withColumn(cls, length_class(words))
    for suffix, part in (("1", bands.where("lang IS NOT NULL")), ("2", bands.where("lang IS NULL"))):
        part = part.select(F.col("lang").alias(cls + "_l"), F.col("class").alias(cls + "_c"), F.col("low").alias(low + suffix), F.col("high").alias(high + suffix))
        on = F.col(cls) == F.col(cls + "_c")
        if suffix == "1":
            on = on & (F.coalesce(col(lang).cast("string"), F.lit("")) == F.col(cls + "_l"))
        scored = scored.join(F.broadcast(part) if few else part, on, "left").drop(cls + "_l", cls + "_c")
    scored = scored.withColumn(low, F.coalesce(low + "1", low + "2")).withColumn(high, F.coalesce(high + "1", high + "2"))
    scored = scored.where(F.col(words) > 0).withColumn(rate, F.col(bits) / F.col(words))
    kept = scored.where(F.col(low).isNull() | F.col(rate).between(F.col(low), F.col(high)))
    if not detail:
        return kept.select(*(col(c) for c in docs.columns))
    power = lambda c: F.round(F.pow(F.lit(2.0), F.least(F.col(c), F.lit(1023.0))), 3)
    return kept.select(*(col(c) for c in docs.columns if c != text), F.col(words).alias("words"), power(rate).alias("perplexity"), power(low).alias("band_low"), power(high).alias("band_high"))
