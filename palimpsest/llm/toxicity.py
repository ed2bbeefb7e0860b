"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two interpolated Kneser-Ney models of order ORDER, one of toxic and one of ordinary texts,
give each word a log-likelihood ratio. Orders above SHARED have their own counts for each class; below, both classes
back off to the same pooled continuation counts, so an expression that neither class has seen says little.
A document's evidence is the ratio per character, over the whole text and in the passages of each of
PASSAGES words where it is largest, and how many words have a ratio above STRONG; logistic regression on
texts kept out of the counts turns it into a score.

Counts cover all labelled texts that may be learned from but those of the calibration, which takes CALIBRATION
texts at most. They are summed as packed keys (an n-gram is a number of up to 7 bytes); no n-gram is dropped. A model
of up to MOST_GRAMS n-grams goes to all executors. A larger one stays in a table of key ranges: shards of texts ask it
for the n-grams of their words and score with the answers. Both ways give the same scores.

Defined cases: null, empty or wordless texts get the share of toxic texts among those learned from; with labels of
one class only, all texts do; repeated rows each give a row; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _exchange as X, _text as T
from ._encode import KeyTable
from ._labels import Logistic, labelled, remainder

ORDER, SHARED, DISCOUNT = 6, 2, 0.75
PASSAGES, STRONG = (1, 4, 16), (4.0, 7.0)
N_FEATURES = len(PASSAGES) + len(STRONG) + 2
#: N-grams that are sent to all executors (32 bytes each); a larger model is asked instead.
MOST_GRAMS = 4_000_000
#: Texts that the logistic regression is fitted on.
CALIBRATION = 20_000
#: Words whose ratio a process keeps.
MOST_WORDS = 500_000
_LENGTH = T.U64(56)


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes between marks 1 and 2, each byte's place in its word, and the words' offsets."""
    sizes = ends - starts + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(offsets[-1]), T.U64)
    place = T.ragged(np.zeros(len(sizes), np.int64), sizes)
    out[offsets[:-1]] = 1
    out[offsets[1:] - 1] = 2
    inner = np.ones(len(out), bool)
    inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
    out[inner] = data[T.ragged(starts, ends - starts)]
    return out, place, offsets


def grams(chars: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each place, and where these lie in the word."""
    key = chars.copy()
    for i in range(1, order):
        key[i:] |= chars[:-i] << T.U64(8 * i)
    at = np.flatnonzero(place >= order - 1)
    return key[at] | (T.U64(order) << _LENGTH), at


def gram_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their rows of counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first, axis=0)


def text_grams(column: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts and their counts in ordinary and toxic ones."""
    data, offsets = T.buffers(column)
    found = []
    for a, b in T.slices(offsets):
        raw = T.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, bounds = T.word_bounds(raw, offsets[a : b + 1] - offsets[a], T.ALNUM)
        if not len(starts):
            continue
        of = np.repeat(toxic[a:b], np.diff(bounds))
        keys = T.hash_words(raw, starts, ends)
        order = np.argsort(keys)
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        first = np.flatnonzero(new)
        held = np.add.reduceat(np.stack([of == 0, of == 1], 1)[order].astype(np.int64), first, axis=0)
        chars, place, cuts = letters(raw, starts[order[first]], ends[order[first]])
        word = np.repeat(np.arange(len(first)), np.diff(cuts))
        for n in range(1, ORDER + 1):
            key, at = grams(chars, place, n)
            if n == 1:
                key, at = key[place[at] > 0], at[place[at] > 0]
            found.append(gram_counts(key, held[word[at]]))
    if not found:
        return np.zeros(0, T.U64), np.zeros((0, 2), np.int64)
    return gram_counts(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))


class Model:
    """Interpolated Kneser-Ney for both classes; rows by sorted keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = (keys >> _LENGTH).astype(np.int64)
        bodies = keys & ((T.U64(1) << _LENGTH) - T.U64(1))
        first = (bodies >> (T.U64(8) * (np.maximum(order, 1) - 1).astype(T.U64))) & T.U64(255)
        adjusted = counts.astype(np.float64)
        for n in range(1, ORDER):  # below the highest order: in how many distinct n-grams one longer it ends
            longer = np.flatnonzero(order == n + 1)
            suffix = (bodies[longer] & ((T.U64(1) << T.U64(8 * n)) - T.U64(1))) | (T.U64(n) << _LENGTH)
            here = np.flatnonzero((order == n) & (first != 1))
            types = np.zeros((len(keys), 2))
            place = np.minimum(np.searchsorted(keys, suffix), len(keys) - 1)
            ok = keys[place] == suffix
            np.add.at(types, place[ok], (counts[longer[ok]] > 0).astype(np.float64))
            adjusted[here] = types[here]
        shared = order <= SHARED
        adjusted[shared] = adjusted[shared].sum(1, keepdims=True)
        self.keys, self.counts = keys, adjusted.astype(np.float32)  # Grams has the same steps by key ranges
        # what follows each n-gram as a context
        prefix = ((bodies >> T.U64(8)) | ((order - 1).astype(T.U64) << _LENGTH))[order > 1]
        place = np.minimum(np.searchsorted(keys, prefix), max(len(keys) - 1, 0))
        # the mark that begins a word is a context but no n-gram of its own
        self.begin = np.zeros((2, 2))
        ok = keys[place] == prefix
        after = adjusted[order > 1]
        total, kinds = np.zeros((len(keys), 2)), np.zeros((len(keys), 2))
        np.add.at(total, place[ok], after[ok])
        np.add.at(kinds, place[ok], after[ok] > 0)
        opening = prefix == (T.U64(1) | (T.U64(1) << _LENGTH))
        self.begin[0], self.begin[1] = after[opening].sum(0), (after[opening] > 0).sum(0)
        self.total, self.kinds = total.astype(np.float32), kinds.astype(np.float32)
        one = order == 1
        self.base = np.full(256, 1.0)
        self.base[bodies[one].astype(np.int64)] += adjusted[one, 0]
        self.base /= self.base.sum()

    @classmethod
    def of(cls, keys: np.ndarray, stats: np.ndarray, begin: np.ndarray, base: np.ndarray) -> Model:
        """A model out of some n-grams (sorted keys) and their counts, totals and kinds, two columns each."""
        out = cls.__new__(cls)
        out.keys = np.append(keys, ~T.U64(0))  # no n-gram has this key
        out.counts, out.total, out.kinds = (np.concatenate([stats[:, i : i + 2], np.zeros((1, 2), np.float32)]) for i in (0, 2, 4))
        out.begin, out.base = begin, base
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary)."""
        out = np.zeros(len(starts))
        for a in range(0, len(starts), 20_000):
            b = min(a + 20_000, len(starts))
            chars, place, cuts = letters(data, starts[a:b], ends[a:b])
            p = np.repeat(self.base[chars.astype(np.int64)][:, None], 2, 1)
            total = np.zeros((len(chars), 2))
            kinds = np.zeros((len(chars), 2))
            for n in range(1, ORDER + 1):
                key, at = grams(chars, place, n)
                row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[row] == key
                if n > 1:
                    count = np.where(ok[:, None], self.counts[row], 0)
                    t, k = total[at - 1], kinds[at - 1]
                    seen = t > 0
                    mixed = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * k * p[at]) / np.where(seen, t, 1)
                    p[at] = np.where(seen, mixed, p[at])
                total[:], kinds[:] = 0, 0
                total[at[ok]], kinds[at[ok]] = self.total[row[ok]], self.kinds[row[ok]]
                if n == 1:
                    total[cuts[:-1]], kinds[cuts[:-1]] = self.begin[0], self.begin[1]
            ratio = np.where(place > 0, np.log(p[:, 1]) - np.log(p[:, 0]), 0)
            out[a:b] = np.add.reduceat(ratio, cuts[:-1])
        return out


class Scorer:
    """Features of texts, with the ratios of words met so far."""

    def __init__(self, model: Model):
        self.model, self.known, self.values = model, KeyTable(), np.zeros(0)

    def ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = T.hash_words(data, starts, ends)
        order = np.argsort(keys)
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        first = order[new]
        distinct = keys[first]
        if len(self.known) + len(distinct) > MOST_WORDS:
            self.known, self.values = KeyTable(), np.zeros(0)
        found = self.known.find(distinct)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self.known.add(distinct[missing])
            self.values = np.concatenate([self.values, self.model.words(data, starts[first[missing]], ends[first[missing]])])
            found = self.known.find(distinct)
        out = np.empty(len(keys))
        out[order] = self.values[found][np.cumsum(new) - 1]
        return out

    def features(self, column: pa.Array) -> np.ndarray:
        """Largest ratio per character by size of passage, that of the whole text, log of the number of strong words and of words; nan without words."""
        data, offsets = T.buffers(column)
        parts = []
        for a, b in T.slices(offsets):
            raw = T.LOWER[data[offsets[a] : offsets[b]]]
            starts, ends, bounds = T.word_bounds(raw, offsets[a : b + 1] - offsets[a], T.ALNUM)
            out = np.full((b - a, N_FEATURES), np.nan)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            if len(full):
                each = self.ratios(raw, starts, ends)
                ratio = np.concatenate([[0], np.cumsum(each)])
                size = np.concatenate([[0], np.cumsum(ends - starts + 1)])
                for i, passage in enumerate(PASSAGES):
                    counts = np.maximum(n[full] - passage + 1, 1)
                    at = T.ragged(bounds[:-1][full], counts)
                    to = np.minimum(at + passage, np.repeat(bounds[1:][full], counts))
                    out[full, i] = np.maximum.reduceat((ratio[to] - ratio[at]) / (size[to] - size[at]), np.cumsum(counts) - counts)
                lo, hi = bounds[:-1][full], bounds[1:][full]
                out[full, -2] = (ratio[hi] - ratio[lo]) / (size[hi] - size[lo])
                out[full, -1] = np.log(n[full])
                for i, least in enumerate(STRONG):
                    out[full, len(PASSAGES) + i] = np.log1p(np.add.reduceat((each > least).astype(np.int64), lo))
            parts.append(out)
        return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    for factor in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD):
        x = x ^ (x >> T.U64(33))
        x = x * T.U64(pow(factor, -1, 1 << 64))
    return x ^ (x >> T.U64(33))


def count_grams(learn: DataFrame) -> tuple[DataFrame, int]:
    """All n-grams of the texts with their counts by class: bucket, keys (mixed and sorted), counts, size; and the number of buckets."""
    n = int(learn.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches):
        from pyspark import TaskContext

        T.let_go()
        keys, counts = np.zeros(0, T.U64), np.zeros((0, 2), np.int64)
        for batch in batches:
            k, c = text_grams(batch.column("text"), batch.column("label").to_numpy())
            keys, counts = gram_counts(np.concatenate([keys, k]), np.concatenate([counts, c]))
        mixed = T.mix(keys)
        order = np.argsort(mixed)
        mixed, counts = mixed[order], np.ascontiguousarray(counts[order])
        yield from X.send(TaskContext.get().partitionId(), mixed, counts, n, whole=True).to_batches()
        T.rest()

    def total(table: pa.Table) -> pa.Table:
        keys, counts = sums_sent(table, 2)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([X.pack(counts)], pa.binary()), "size": pa.array([len(keys)], pa.int64()), "seen": pa.array([counts.any(0).tolist()], pa.list_(pa.bool_()))})

    return X.checkpoint(learn.mapInArrow(gather, X.SENT).groupBy("bucket").applyInArrow(total, "bucket int, keys binary, counts binary, size long, seen array<boolean>")), n


def sums_sent(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of rows of SENT, sorted, and the sums of their notes, width longs each."""
    if not table.num_rows:
        return np.zeros(0, T.U64), np.zeros((0, width), np.int64)
    keys = np.concatenate([np.frombuffer(x, T.U64) for x in table["keys"].to_pylist()])
    return gram_counts(keys, np.concatenate([X.unpack(x, np.int64).reshape(-1, width) for x in table["notes"].to_pylist()]))


def collected(summed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a table that count_grams() made, at the driver."""
    rows = summed.select("keys", "counts").collect()  # bounded by MOST_GRAMS
    if not rows:
        return np.zeros(0, T.U64), np.zeros((0, 2), np.int64)
    keys = unmix(np.concatenate([np.frombuffer(r[0], T.U64) for r in rows]))
    counts = np.concatenate([X.unpack(r[1], np.int64).reshape(-1, 2) for r in rows])
    order = np.argsort(keys)
    return keys[order], counts[order]


def parts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders and bodies of n-grams."""
    return (keys >> _LENGTH).astype(np.int64), keys & ((T.U64(1) << _LENGTH) - T.U64(1))


OPENING = T.U64(1) | (T.U64(1) << _LENGTH)


class Grams:
    """Model's numbers of any number of n-grams, in a table by key ranges: bucket, keys (mixed and sorted), stats (counts, totals and kinds)."""

    def __init__(self, summed: DataFrame, n: int):
        self.n = n
        no_counts = X.to_arrow("bucket int, keys binary, counts binary")  # made here, as workers know no schema texts

        def passed(row, keys: np.ndarray, notes: np.ndarray):
            """Rows of SENT of one bucket's notes to other keys."""
            keys, notes = gram_counts(T.mix(keys), notes)
            return X.send(row, keys, notes, n, whole=True).to_batches()

        def suffixes(batches):
            for batch in batches:
                for bucket, k, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "counts"))):
                    order, bodies = parts_of(unmix(np.frombuffer(k, T.U64)))
                    longer = order > 1
                    shorter = order[longer].astype(T.U64) - T.U64(1)
                    suffix = (bodies[longer] & ((T.U64(1) << (T.U64(8) * shorter)) - T.U64(1))) | (shorter << _LENGTH)
                    yield from passed(bucket, suffix, (X.unpack(c, np.int64).reshape(-1, 2)[longer] > 0).astype(np.int64))

        def adjust(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return no_counts
            mixed = np.frombuffer(left["keys"][0].as_py(), T.U64)
            counts = X.unpack(left["counts"][0].as_py(), np.int64).reshape(-1, 2).copy()
            order, bodies = parts_of(unmix(mixed))
            first = (bodies >> (T.U64(8) * (order - 1).astype(T.U64))) & T.U64(255)
            here = (order < ORDER) & (first != 1)
            counts[here] = placed(mixed, *sums_sent(right, 2))[here]
            shared = order <= SHARED
            counts[shared] = counts[shared].sum(1, keepdims=True)
            return pa.table({"bucket": left["bucket"].cast(pa.int32()), "keys": left["keys"].cast(pa.binary()), "counts": pa.array([X.pack(counts)], pa.binary())})

        adjusted = X.checkpoint(summed.select("bucket", "keys", "counts").groupBy("bucket").cogroup(summed.mapInArrow(suffixes, X.SENT).groupBy("bucket")).applyInArrow(adjust, "bucket int, keys binary, counts binary"))

        def prefixes(batches):
            for batch in batches:
                for bucket, k, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "counts"))):
                    order, bodies = parts_of(unmix(np.frombuffer(k, T.U64)))
                    longer = order > 1
                    after = X.unpack(c, np.int64).reshape(-1, 2)[longer]
                    prefix = (bodies[longer] >> T.U64(8)) | ((order[longer] - 1).astype(T.U64) << _LENGTH)
                    yield from passed(bucket, prefix, np.concatenate([after, (after > 0).astype(np.int64)], 1))

        def follow(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, sums = sums_sent(right, 4)
            opening = sums[keys == T.mix(np.array([OPENING]))].ravel().tolist()
            mixed, counts = np.zeros(0, T.U64), np.zeros((0, 2), np.int64)
            if left.num_rows:
                mixed, counts = np.frombuffer(left["keys"][0].as_py(), T.U64), X.unpack(left["counts"][0].as_py(), np.int64).reshape(-1, 2)
            order, bodies = parts_of(unmix(mixed))
            one = order == 1
            stats = np.concatenate([counts, placed(mixed, keys, sums)], 1).astype(np.float32)
            bucket = (left if left.num_rows else right)["bucket"][0].as_py()
            base = np.stack([bodies[one].astype(np.int64), counts[one, 0]], 1).tolist()
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([mixed.tobytes()], pa.binary()), "stats": pa.array([X.pack(stats)], pa.binary()), "opening": pa.array([opening], pa.list_(pa.int64())), "base": pa.array([base], pa.list_(pa.list_(pa.int64())))})

        whole = X.checkpoint(adjusted.groupBy("bucket").cogroup(adjusted.mapInArrow(prefixes, X.SENT).groupBy("bucket")).applyInArrow(follow, "bucket int, keys binary, stats binary, opening array<long>, base array<array<long>>"))
        self.table = whole.select("bucket", "keys", "stats")
        self.begin, self.base = np.zeros((2, 2)), np.full(256, 1.0)
        for opening, base in whole.where("size(opening) > 0 or size(base) > 0").select("opening", "base").collect():  # 255 n-grams of one byte
            if opening:
                self.begin = np.array(opening, np.float64).reshape(2, 2)
            for byte, count in base:
                self.base[byte] += count
        self.base /= self.base.sum()

    def apply(self, docs: DataFrame, work, schema, text: str = "text") -> DataFrame:
        """work(rows, scorer) for every shard of docs, the scorer out of the n-grams of the shard's words."""
        table, _ = X.shards(docs, "doc_id", text, whole=True)
        n, begin, base = self.n, self.begin, self.base
        no_codes = X.to_arrow("shard long, bucket int, codes binary")

        def asked(rows: pa.Table) -> np.ndarray:
            column = rows[text].cast(pa.string()).combine_chunks()
            return np.sort(T.mix(text_grams(column, np.zeros(len(column), np.int32))[0]))

        def ask(shard: int, rows: pa.Table) -> pa.Table:
            keys = asked(rows)
            return X.send(shard, keys, np.zeros(len(keys), np.uint8), n, whole=True)

        def tell(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, stats = np.zeros(0, T.U64), np.zeros((0, 6), np.float32)
            if right.num_rows:
                keys, stats = np.frombuffer(right["keys"][0].as_py(), T.U64), X.unpack(right["stats"][0].as_py(), np.float32).reshape(-1, 6)
            if not left.num_rows:
                return no_codes
            codes = [X.pack(placed(np.frombuffer(x, T.U64), keys, stats)) for x in left["keys"].to_pylist()]
            return pa.table({"shard": left["shard"].cast(pa.int64()), "bucket": left["bucket"].cast(pa.int32()), "codes": pa.array(codes, pa.binary())})

        def score(_, rows: pa.Table, answered: pa.Table) -> pa.Table:
            keys = asked(rows)
            stats = X.read_answers(answered, 6 * len(keys), np.float32).reshape(-1, 6)
            known = stats.any(1)
            keys, stats = unmix(keys[known]), stats[known]
            order = np.argsort(keys)
            return work(rows, Scorer(Model.of(keys[order], stats[order], begin, base)))

        answers = X.per_shard(table, ask, X.SENT).groupBy("bucket").cogroup(self.table.groupBy("bucket")).applyInArrow(tell, "shard long, bucket int, codes binary")
        return X.with_answers(table, answers, score, schema)


def placed(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys, 0 for those that are not known; known is sorted."""
    out = np.zeros((len(keys), values.shape[1]), values.dtype)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        ok = known[at] == keys
        out[ok] = values[at[ok]]
    return out


class Judge:
    """The whole classifier: texts to scores."""

    def __init__(self, share: float, scorer: Scorer | Grams | None = None, regression: Logistic | None = None):
        self.share, self.scorer, self.regression = share, scorer, regression

    def run(self, docs: DataFrame, work, schema, text: str = "text") -> DataFrame:
        """work(batch, judge) for docs: with the judge sent to all executors, or by shards if its model is too large for that."""
        if isinstance(self.scorer, Grams):
            share, regression = self.share, self.regression

            def whole(rows: pa.Table, scorer: Scorer) -> pa.Table:
                return pa.Table.from_batches([work(batch, Judge(share, scorer, regression)) for batch in rows.to_batches()])

            return self.scorer.apply(docs, whole, schema, text)
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def batched(batches):
            T.let_go()
            for batch in batches:
                yield work(batch, sent.value)
            T.rest()

        return docs.mapInArrow(batched, schema)

    def __call__(self, column: pa.Array) -> np.ndarray:
        return self.judged(column)[0]

    def judged(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and whether there is anything to judge: a model, and words."""
        out, ok = np.full(len(column), self.share), np.zeros(len(column), bool)
        if self.regression is not None and len(column):
            x = self.scorer.features(column)
            ok = ~np.isnan(x[:, 0])
            out[ok] = self.regression(x[ok])
        return out, ok


def fit(docs: DataFrame, labels: DataFrame, learn, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> Judge:
    """A classifier from the labels that learn (a condition on the labels' rows) allows."""
    source = labelled(docs, labels, label, learn, ident, text)
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(8)) == 0
    place = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("d"))
    beyond = source.where(aside).select(place.alias("p")).orderBy("p").limit(CALIBRATION + 1).agg(F.count("*"), F.max("p")).first()
    if beyond[0] > CALIBRATION:  # what the calibration has no place for is counted
        aside &= place < F.struct(F.lit(beyond[1].h).alias("h"), F.lit(beyond[1].d).alias("d"))
    summed, n = count_grams(source.where(~aside))
    spark = docs.sparkSession
    rows = source.where(aside)
    sizes = summed.agg(F.sum("size"), F.max(F.col("seen")[0]), F.max(F.col("seen")[1])).first()
    if not sizes[0] or not all(sizes[1:]):
        seen = source.agg(F.avg("label")).first()[0]
        return Judge(float(seen or 0))
    model = Grams(summed, n) if sizes[0] > MOST_GRAMS else Scorer(Model(*collected(summed)))

    def measure(batch: pa.RecordBatch, judge: Judge) -> pa.RecordBatch:
        x = judge.scorer.features(batch.column("text"))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), **{f"x{i}": pa.array(x[:, i]) for i in range(N_FEATURES)}})

    found = Judge(0.0, model).run(rows, measure, "doc_id long, label int, " + ", ".join(f"x{i} double" for i in range(N_FEATURES))).where("not isnan(x0)")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION).collect()
    x, y = np.array([r[2:] for r in found]).reshape(-1, N_FEATURES), np.array([r[1] for r in found], float)
    if len(set(y.tolist())) < 2:  # too few texts were set aside
        share = float(source.agg(F.avg("label")).first()[0])
        far = np.repeat([[0.0], [1.0]], N_FEATURES, 1) * np.array([*(0.5,) * len(PASSAGES), *(1,) * len(STRONG), 0.1, 0])
        regression = Logistic(np.concatenate([far, far * 1.1]), np.array([0, 1, 0, 1.0]))
        return Judge(share, model, regression)
    return Judge(float(y.mean()), model, Logistic(x, y))


def scores(docs: DataFrame, judge: Judge, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def work(batch: pa.RecordBatch, judge: Judge) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(judge(batch.column("text")), pa.float64())})

    return judge.run(docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), work, "doc_id long, score double")


def ordinary(docs: DataFrame, judge: Judge, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs below the threshold, all columns; null, empty and wordless texts stay, and all texts where no model was learned, as nothing speaks against them."""

    def work(batch: pa.RecordBatch, judge: Judge) -> pa.RecordBatch:
        score, spoken = judge.judged(batch.column(batch.schema.get_field_index(text)))
        return batch.filter(pa.array((score < threshold) | ~spoken))

    return judge.run(docs, work, docs.schema, text)


def held_out():
    return remainder("doc_id", 4) == 2


def op3_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scores(docs, fit(docs, labels, ~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
