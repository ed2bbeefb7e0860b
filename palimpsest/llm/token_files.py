"""Token-id files compressed by Re-Pair, a grammar for each shard.

A file (one blob) holds the ids of consecutive documents. Its text is a sequence of symbols:
ids, and nonterminals for pairs of symbols, found by replacing the most frequent pairs over and over
until no pair occurs LEAST_COUNT times, so often that its rule (three numbers) pays; pairs never reach over a document's end. A round replaces all pairs
of at least an eighth of the highest count whose occurrences don't overlap with those of a more frequent one; pairs are
counted once, and after that only the pairs next to a replaced one are counted anew; a round costs as much as what it replaces. Rules come with their
expansion lengths, and each document's place in the sequence is stored, so any document, or any token
range of it, is decoded without the rest.

Layout, little-endian: magic "PRP2"; uint32 version 2, documents, rules, first nonterminal;
uint64 symbols; then int64 ids of the documents, uint8 whether the id is known, uint32 tokens of each,
uint32 symbols of each, uint32 left and right symbol of each rule, uint32 expansion length of each rule, the
symbols of the sequence in as many bits each as the last nonterminal takes, the highest bit first. Of the last six parts each comes after its uint64 byte size, and all
but the sequence are deflated.

Files are binary columns of Parquet tables, so they are written and read through Spark in any
store it knows. Documents are dealt out by ranges of their ids, sorted within each, null ids first.

Defined cases: a null text is empty; an empty text has the end id alone; repeated rows and equal ids each keep their
place; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _exchange as X, _text as T
from ._encode import PieceStore, Ragged, fine_pieces, flat

MAGIC = b"PRP2"
#: Tokens of a file, about.
FILE_TOKENS = 1 << 20
#: A pair that is so frequent becomes a rule: it saves a symbol each time and costs three numbers.
LEAST_COUNT = 4
#: In the place of the pair that begins at a document's last symbol.
CLOSES = -2
#: For T.keep_freed(): a file's arrays are made over and over, and new memory for each took a fifth of the time.
KEPT = 32 << 20, 64 << 20
#: ahead: tokens of the part's files before this one.
FILES = "part int, file int, n_docs long, n_tokens long, ahead long, blob binary"
#: Up to so many parts, their offsets (24 bytes each) go to all executors; beyond, they are joined.
MOST_PARTS = 1 << 16


# ---------------------------------------------------------------- grammar


def apart(pairs: np.ndarray) -> list[int]:
    """Which of the pairs, the most frequent first, have no occurrence that overlaps with one of an earlier one of these."""
    firsts, seconds, kept = pairs >> T.U64(32), pairs & T.U64(0xFFFFFFFF), []
    n = int(max(firsts.max(initial=0), seconds.max(initial=0))) + 1
    left, right = bytearray(n), bytearray(n)  # whether a symbol is one of a kept pair
    for i, (a, b) in enumerate(zip(firsts.tolist(), seconds.tolist())):
        if right[a] or left[b] or a == b and (left[a] or right[b]):
            continue
        left[a] = right[b] = 1
        kept.append(i)
    return kept


def ordered(keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, equal ones by place, and the keys in it."""
    bits = max(len(keys) - 1, 1).bit_length()
    if wide + bits > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    held = np.sort(keys << T.U64(bits) | np.arange(len(keys), dtype=T.U64))  # plain numbers sort faster than places by numbers
    return (held & T.U64((1 << bits) - 1)).astype(np.int64), held >> T.U64(bits)


class Sequence:
    """Symbols in a chain of places, which of the pairs that occur LEAST times or more begins at each, the counts of these pairs, and where they began when they came up.

    Only pairs with a symbol of the last round come up in a round, so a pair gets only rarer afterwards. The symbol of a pair is put at its left
    place, and the right one leaves the chain, so a round costs as much as what it replaces, however long the sequence is.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, first: int, least: int):
        n = len(ids)
        self.least, self.symbols = least, int(first)
        self.seq, self.there = np.append(ids, 0).astype(np.uint32), np.ones(n, bool)
        self.of = np.full(n + 1, -1, np.int32)
        self.of[ends - 1] = self.of[n] = CLOSES  # place n stands before the first and after the last one
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        self.before[0] = n
        self.pairs, self.counts, self.places = np.zeros(0, T.U64), np.zeros(0, np.int64), Ragged(np.int32)
        self.add(np.flatnonzero(self.of != CLOSES))

    def add(self, at: np.ndarray) -> None:
        """New pairs, which begin at these places."""
        self.of[at] = -1
        if not len(at):
            return
        wide = T.U64(self.symbols.bit_length())
        order, held = ordered(self.seq[at].astype(T.U64) << wide | self.seq[self.after[at]], 2 * int(wide))
        begin = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        sizes = np.diff(np.append(begin, len(held)))
        often = sizes >= self.least
        at, sizes, held = at[order[np.repeat(often, sizes)]], sizes[often], held[begin[often]]
        self.of[at] = np.repeat(np.arange(len(self.pairs), len(self.pairs) + len(sizes), dtype=np.int32), sizes)
        self.places.add(sizes, at)
        self.pairs = np.concatenate([self.pairs, held >> wide << T.U64(32) | held & T.U64((1 << int(wide)) - 1)])
        self.counts = np.concatenate([self.counts, sizes])

    def best(self) -> np.ndarray:
        """Pairs of an eighth of the highest count or more whose occurrences don't overlap, in the order of their symbols."""
        much = np.flatnonzero(self.counts >= max(self.least, int(self.counts.max(initial=0)) // 8))
        much = much[np.lexsort((self.pairs[much], -self.counts[much]))]
        much = much[apart(self.pairs[much])]
        return much[np.argsort(self.pairs[much])]

    def occurrences(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs, ascending, and which pair is there; of a run of one symbol every other place."""
        at, sizes = self.places.rows(best)
        which = np.repeat(np.arange(len(best)), sizes)
        now = self.of[at] == best[which]
        both = np.sort(at[now].astype(T.U64) << T.U64(32) | which[now].astype(T.U64))  # memory is read in its order from here on
        at, which = (both >> T.U64(32)).astype(np.int64), (both & T.U64(0xFFFFFFFF)).astype(np.int64)
        if ((self.pairs[best] >> T.U64(32)) == (self.pairs[best] & T.U64(0xFFFFFFFF))).any():
            begin = np.flatnonzero(np.concatenate([[True], self.after[at[:-1]] != at[1:]]))[: len(at)]
            keep = (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0
            at, which = at[keep], which[keep]
        return at, which

    def replace(self, best: np.ndarray) -> np.ndarray:
        """A symbol for each of the pairs; the pairs that got one, as a run of one symbol holds its pair half as often as counted."""
        at, which = self.occurrences(best)
        often = np.bincount(which, minlength=len(best)) >= self.least
        if not often.all():
            at, which = at[often[which]], which[often[which]]
        right = self.after[at].astype(np.int64)
        of_right = self.of[right]
        self.of[right] = -1  # the pair with an occurrence before it is that one's
        lost = np.concatenate([of_right, self.of[self.before[at]]])
        lost = lost[lost >= 0]
        if 4 * len(lost) < len(self.counts):
            np.subtract.at(self.counts, lost, 1)
        else:
            self.counts -= np.bincount(lost, minlength=len(self.counts))
        self.counts[best] = 0
        self.seq[at] = (self.symbols - 1 + np.cumsum(often))[which]
        self.symbols += int(often.sum())
        self.there[right] = False
        follows = self.after[right]
        self.after[at], self.before[follows] = follows, at
        self.of[at] = np.where(of_right == CLOSES, CLOSES, -1)
        ahead = self.before[at].astype(np.int64)
        ahead = ahead[np.append(-1, at[:-1]) != ahead]  # no occurrence itself
        begins = np.concatenate([ahead, at])
        self.add(begins[self.of[begins] != CLOSES])
        return self.pairs[best[often]]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their count by document, and rules (left, right); ends are the documents' ends in ids, first the first free symbol."""
    ends = np.asarray(ends, np.int64)
    full = np.diff(ends, prepend=0) > 0
    held, rules = Sequence(ids, ends[full], first, least), [np.zeros(0, T.U64)]
    while len(best := held.best()):
        rules.append(held.replace(best))
    symbols = np.zeros(len(ends), np.uint32)
    number = np.cumsum(held.there)
    symbols[full] = np.diff(number[(held.of[:-1] == CLOSES) & held.there], prepend=0)
    found = np.concatenate(rules)
    return held.seq[:-1][held.there], symbols, np.stack([(found >> T.U64(32)).astype(np.uint32), (found & T.U64(0xFFFFFFFF)).astype(np.uint32)], 1)


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Tokens that each nonterminal stands for; a rule uses earlier rules only."""
    out = np.ones(first + len(rules), np.int64)
    a = 0
    while a < len(rules):  # rules of one round don't use each other
        used = rules[a:].max(1)
        b = a + max(1, int(np.argmax(used >= first + a)) if (used >= first + a).any() else len(used))
        out[first + a : first + b] = out[rules[a:b, 0]] + out[rules[a:b, 1]]
        a = b
    return out[first:]


def expand(seq: np.ndarray, rules: np.ndarray, spans: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for; spans are the rules' expansion lengths, which say where each part goes."""
    sizes_of = lambda x: np.where(x >= first, spans[np.maximum(x - first, 0)], 1) if len(spans) else np.ones(len(x), np.int64)
    seq, spans = seq.astype(np.int64), spans.astype(np.int64)
    sizes = sizes_of(seq)
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    while len(seq):
        high = seq >= first
        out[at[~high]] = seq[~high]
        left, right = (rules[seq[high] - first, side].astype(np.int64) for side in (0, 1))
        seq, at = np.concatenate([left, right]), np.concatenate([at[high], at[high] + sizes_of(left)])
    return out


def expand_all(seq: np.ndarray, rules: np.ndarray, spans: np.ndarray, first: int) -> np.ndarray:
    """As expand(), for a whole file: each rule is expanded once."""
    if not len(rules):
        return seq.astype(np.uint32)
    spans = spans.astype(np.int64)
    begin = np.cumsum(spans) - spans
    pool = np.empty(int(spans.sum()), np.uint32)
    low, rules = rules < first, rules.astype(np.int64)
    halves = np.where(low, 1, spans[np.where(low, 0, rules - first)])
    a = 0
    while a < len(rules):  # as lengths(): rules of one round don't use each other
        used = rules[a:].max(1) >= first + a
        b = a + max(1, int(np.argmax(used)) if used.any() else len(used))
        for side, to in ((0, begin[a:b]), (1, begin[a:b] + halves[a:b, 0])):
            one = low[a:b, side]
            pool[to[one]] = rules[a:b, side][one]
            of, n = rules[a:b, side][~one] - first, halves[a:b, side][~one]
            pool[T.ragged(to[~one], n)] = pool[T.ragged(begin[of], n)]
        a = b
    high = np.flatnonzero(seq >= first)
    rule = seq[high].astype(np.int64) - first
    sizes = np.ones(len(seq), np.int64)
    sizes[high] = spans[rule]
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    out[at] = seq  # the places of rules are written over
    out[T.ragged(at[high], spans[rule])] = pool[T.ragged(begin[rule], spans[rule])]
    return out


def to_bits(x: np.ndarray, wide: int) -> bytes:
    """The lowest so many bits of each number, the highest bit first."""
    rows = np.zeros((-(-len(x) // 8), 8), T.U64)
    rows.ravel()[: len(x)] = x
    out = np.zeros((len(rows), wide + 8), np.uint8)  # eight numbers take as many bytes as one takes bits
    for i in range(8):
        at, left = divmod(i * wide, 8)
        shifted = rows[:, i] << T.U64(40 - wide - left)  # 40 bits hold any number from any bit of a byte on
        for j in range((left + wide + 7) // 8):
            out[:, at + j] |= (shifted >> T.U64(32 - 8 * j)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :wide]).tobytes()[: -(-len(x) * wide // 8)]


def of_bits(body: bytes, wide: int, n: int) -> np.ndarray:
    rows = np.zeros((-(-n // 8), wide), np.uint8)
    rows.ravel()[: len(body)] = np.frombuffer(body, np.uint8)
    out = np.empty((len(rows), 8), np.uint32)
    for i in range(8):
        at, left = divmod(i * wide, 8)
        held, size = np.zeros(len(rows), T.U64), (left + wide + 7) // 8
        for j in range(size):
            held = held << T.U64(8) | rows[:, at + j]
        out[:, i] = (held >> T.U64(8 * size - left - wide)) & T.U64((1 << wide) - 1)
    return out.ravel()[:n]


def to_blob(doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, sizes: np.ndarray, first: int) -> bytes:
    seq, symbols, rules = compress(ids, np.cumsum(sizes), first)
    packed = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in (sizes, symbols, rules[:, 0], rules[:, 1], lengths(rules, first))]
    packed.append(to_bits(seq, (first + len(rules) - 1).bit_length()))
    out = [MAGIC, struct.pack("<IIIIQ", 2, len(doc_ids), len(rules), first, len(seq)), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes()]
    return b"".join(out + [x for body in packed for x in (struct.pack("<Q", len(body)), body)])


class TokenFile:
    """Random access to a blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        version, n, n_rules, self.first, n_seq = struct.unpack_from("<IIIIQ", blob, 4)
        if version != 2:
            raise ValueError(f"version {version}")
        at = 28
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.known = np.frombuffer(blob, np.uint8, n, at + 8 * n).astype(bool)
        at += 9 * n
        parts = []
        for i in range(6):
            (size,) = struct.unpack_from("<Q", blob, at)
            body = blob[at + 8 : at + 8 + size]
            parts.append(np.frombuffer(zlib.decompress(body), "<u4") if i < 5 else of_bits(body, (self.first + n_rules - 1).bit_length(), n_seq))
            at += 8 + size
        self.sizes, self.symbols, left, right, self.spans, self.seq = parts
        self.rules = np.stack([left, right], 1)
        self.begin = np.concatenate([[0], np.cumsum(self.symbols.astype(np.int64))])

    def document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.begin[i] : self.begin[i + 1]], self.rules, self.spans, self.first)

    def tokens(self, i: int, start: int, end: int) -> np.ndarray:
        """Tokens start..end of document i; only the symbols that reach into the range are expanded."""
        seq = self.seq[self.begin[i] : self.begin[i + 1]].astype(np.int64)
        size = np.where(seq >= self.first, self.spans[np.maximum(seq - self.first, 0)] if len(self.spans) else 1, 1).astype(np.int64)
        after = np.cumsum(size)
        a, b = int(np.searchsorted(after, start, "right")), int(np.searchsorted(after - size, end, "left"))
        if a >= b:
            return np.zeros(0, np.uint32)
        skip = start - int(after[a] - size[a])
        return expand(seq[a:b], self.rules, self.spans, self.first)[skip : skip + end - start]

    def all(self) -> np.ndarray:
        return expand_all(self.seq, self.rules, self.spans, self.first)


# ---------------------------------------------------------------- encoding


#: Steps of a tokenizer file for which texts may be cut at white space, and parts of ASCII where letters, digits and other characters meet.
KNOWN_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
KNOWN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: Bytes of the letters A-Z, a-z and À-ÿ (without × and ÷), of which no normaliser decomposes, joins or lengthens any.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
WORD_BYTES[[0x97, 0xB7]] = False


def one_word(pieces: list[str]) -> np.ndarray:
    """Whether each piece (none empty, none with a line feed) is one word whatever the case: such letters only."""
    raw = np.frombuffer("\n".join(pieces).encode(), np.uint8)
    cuts = np.flatnonzero(raw == 10)
    other = ~WORD_BYTES[raw]
    other[cuts] = False
    return ~np.logical_or.reduceat(other, np.concatenate([[0], cuts + 1]))


class TextEncoder:
    """Ids of texts by a tokenizer, with an end id after each text.

    Texts are put together from the ids of their pieces only where the tokenizer's file says that this gives the same ids; any other
    tokenizer gets whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        self.first = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.store = PieceStore(self.ids_of)
        parts = json.loads(self.tokenizer.to_str())
        normalizers, splits = ((parts[k] or {}).get(key, [parts[k]] if parts[k] else []) for k, key in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        split = [x for x in splits if x["type"] == "Split"]
        self.added = [x["content"].encode() for x in parts["added_tokens"]]
        plain = all(x in KNOWN_NORMALIZERS for x in normalizers) and len(split) == 1 and split[0]["pattern"] == {"Regex": KNOWN_PATTERN} and split[0]["behavior"] == "Removed" and split[0]["invert"]
        plain = plain and all(x["type"] == "Split" or x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in splits)
        self.by_pieces = plain and not any(any(c.isspace() for c in x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in parts["added_tokens"])
        self.fold = T.LOWER if {"type": "Lowercase"} in normalizers else None
        # by the suffix that ends a word one can tell which ids end one
        suffix = parts["model"].get("end_of_word_suffix") if self.by_pieces and parts["model"]["type"] == "BPE" else None
        self.closes = np.zeros(self.first, bool)
        for piece, i in parts["model"]["vocab"].items() if suffix else ():
            self.closes[i] = piece.endswith(suffix)

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # read at every call; pieces are short, and each core has a task of its own
        one = one_word(pieces) & self.closes.any()
        words = [p for p, x in zip(pieces, one) if x]
        ids, sizes = self.words(words)
        if len(sizes) != len(words):  # some word has no id that closes it
            return self.each(pieces)
        if one.all():
            return ids, sizes
        other, n = self.each([p for p, x in zip(pieces, one) if not x])
        counts = np.empty(len(pieces), np.int64)
        counts[one], counts[~one] = sizes, n
        out = np.empty(len(ids) + len(other), np.int32)
        of_word = np.repeat(one, counts)
        out[of_word], out[~of_word] = ids, other
        return out, counts

    def each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As each(), of pieces of one word each, many in a text: an id that closes a word ends its piece."""
        held = self.tokenizer.encode_batch_fast([" ".join(words[a : a + 500]) for a in range(0, len(words), 500)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *[np.array(e.ids, np.int32) for e in held]])
        return ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)

    def slice_ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, and how many each has."""
        body = raw.tobytes()
        if not self.by_pieces:
            return self.each([body[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
        starts, ends, _ = T.word_bounds(raw, off, T.SPACED)
        fold = None
        if not any(x in body for x in self.added):  # only a whole part shows an added token
            starts, ends = fine_pieces(raw, starts, ends)
            fold = self.fold
        ids, counts = self.store.of(raw, starts, ends, fold)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, off)])

    def encode(self, column: pa.Array):
        """(first row, last row, ids, tokens of each text) by slices."""
        data, offsets = T.buffers(column)
        for a, b in T.slices(offsets):
            ids, sizes = self.slice_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = np.full(len(ids) + (b - a), self.end, np.uint32)
            ends_at = np.cumsum(sizes + 1) - 1
            inner = np.ones(len(out), bool)
            inner[ends_at] = False
            out[inner] = ids
            yield a, b, out, sizes + 1


_ENCODERS: dict[tuple, TextEncoder] = T.kept()


def encoder(path: str, end_id: int) -> TextEncoder:
    """One for each process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = TextEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def files(docs: DataFrame, tokenizer: str, end_id: int = 1, ident: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """FILES: token files in ascending order of (part, file), and in each in ascending order of ids."""
    n = -(-X.text_bytes(docs, text) // (16 << 20))
    n = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        T.keep_freed(*KEPT)
        part, file, ahead, held = TaskContext.get().partitionId(), 0, 0, []

        def flush():
            nonlocal file, ahead, held
            doc_ids, known, ids, sizes = (np.concatenate(x) for x in zip(*held))
            blob = to_blob(doc_ids, known, ids, sizes, encode.first)
            row = {"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "ahead": pa.array([ahead], pa.int64()), "blob": pa.array([blob], pa.binary())}
            file, ahead, held = file + 1, ahead + len(ids), []
            return pa.RecordBatch.from_pydict(row)

        encode, n_held = encoder(tokenizer, end_id), 0
        for batch in batches:
            column = batch.column("doc_id")
            known, keys = np.array(column.is_valid()), column.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b, ids, sizes in encode.encode(batch.column("text")):
                held.append((keys[a:b], known[a:b], ids, sizes))
                n_held += len(ids)
                if n_held >= file_tokens:
                    yield flush()
                    n_held = 0
        if held:
            yield flush()

    return rows.mapInArrow(write, FILES)


def write_files(docs: DataFrame, folder: str, tokenizer: str, **options) -> None:
    """Writes the files below folder, in any store that Spark knows."""
    files(docs, tokenizer, **options).write.option("compression", "zstd").parquet(folder)


def read_documents(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, tokens (binary, little-endian unsigned 32-bit) of every document in the files."""

    def decode(batches):
        T.keep_freed(*KEPT)
        for batch in batches:
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("blob").to_pylist()):
                found = TokenFile(blob)
                ids = found.all().astype("<u4")
                ends = np.cumsum(found.sizes.astype(np.int64))
                begins = ends - found.sizes
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(found.doc_ids, pa.int64(), mask=~found.known),
                        "start": pa.array(base + begins, pa.int64()),
                        "n_tokens": pa.array(found.sizes, pa.int64()),
                        "tokens": pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                    }
                )

    of_part = stored.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = of_part.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    if stored.select("part").distinct().count() <= MOST_PARTS:
        before = F.broadcast(before)
    placed = stored.join(before, "part").select((F.col("before") + F.col("ahead")).alias("base"), "blob")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, tokens binary")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = X.scratch_folder(spark, "op5")
    write_files(docs, folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    read = read_documents(spark.read.parquet(folder))
    return read.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
