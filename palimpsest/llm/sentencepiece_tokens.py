"""SentencePiece models on the tokenizers library.

The model file is parsed here, without a protobuf library: pieces, scores and kinds, the trainer's and
the normaliser's settings. A tokenizer of the tokenizers library is rebuilt from them: the metaspace mark for
blanks, a Unigram model with its scores or BPE merges in the order of the scores, and byte fallback. Batches are encoded by its
threads where the process allows them.

A text is encoded as the pieces between which no piece of the vocabulary can lie: a place between two
characters that stand next to each other in no vocabulary piece is never merged over. Each distinct
one is encoded once and kept (BPE models that keep texts as they are only; all others encode texts whole). Parity with the sentencepiece library is
verified on the first text of every slice of about 1 MB, ids and decoded text; a difference raises an error. Only where a Unigram model has several segmentations
of one score, of the same pieces in another order, may the two libraries choose differently.

The normaliser is rebuilt from the model's settings: the compiled character map, removal of outer and repeated blanks, the blank ahead of a text, and marks for
blanks. Models of words or characters, and those with the mark behind a word, raise ValueError.

Defined cases: a null or empty text has no tokens and decodes to an empty text; repeated rows each give a row; a null id
is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._encode import PieceStore, flat
from .token_files import tokenizer_path

#: Texts or pieces that the library encodes at once; what it returns for each is many times the ids.
AT_ONCE = 2_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


def fields(data: bytes):
    """(number, value) of every field of a protobuf message; value: int or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.type, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.prefix, self.remove_blanks, self.escape, self.charsmap, suffix = True, True, True, b"", False
        for number, value in fields(data):
            if number == 1:
                held = dict(fields(value))
                self.pieces.append(held.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", held[2])[0] if 2 in held else 0.0)
                self.kinds.append(held.get(3, NORMAL))
            elif number == 2:
                held = dict(fields(value))
                self.type, self.byte_fallback = held.get(3, UNIGRAM), bool(held.get(35, 0))
                self.unknown, suffix = held.get(40, 0), bool(held.get(24, 0))
            elif number == 3:
                held = dict(fields(value))
                self.charsmap, self.prefix = held.get(2, b""), bool(held.get(3, 1))
                self.remove_blanks, self.escape = bool(held.get(4, 1)), bool(held.get(5, 1))
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if suffix:
            raise ValueError("models that put the mark of white space after a word are not supported")

    @property
    def keeps_text(self) -> bool:
        """Whether texts are taken as they are, but for the marks of blanks."""
        return not self.charsmap and not self.remove_blanks and self.escape


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, those of better scores first."""
    place = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] in (NORMAL, USER)}
    found = []
    for piece, i in place.items():
        splits = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in place and piece[k:] in place]
        splits.sort(key=lambda s: (place[s[0]], place[s[1]]))
        found += [(-model.scores[i], j, i, s) for j, s in enumerate(splits)]
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    return [x[3] for x in found]


def build(model: Model, prefix: bool):
    """The tokenizers library's tokenizer; without prefix it takes parts of texts."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.type == BPE:
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(list(zip(model.pieces, model.scores)), model.unknown, model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_blanks:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model.prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.prefix else [])])
    out.add_tokens([AddedToken(p, normalized=False, special=False) for p, k in zip(model.pieces, model.kinds) if k == USER])
    return out


class Codec:
    """Encodes and decodes columns of texts."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.check = sentencepiece.SentencePieceProcessor(model_file=path)
        self.part = build(self.model, False)
        self.store = PieceStore(lambda pieces: self.batch(self.part, pieces))
        m = self.model
        body = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds)]
        self.size = np.array([len(b) for b in body], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(body), np.uint8)
        self.cuts = self.safe_cuts() if m.type == BPE and m.prefix and m.keeps_text else None

    @cached_property
    def whole(self):
        """The tokenizer of whole texts, which few models and texts need."""
        return build(self.model, True)

    @staticmethod
    def batch(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has, by the library's threads."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # read at every call
        parts = [flat([e.ids for e in tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]) for i in range(0, max(len(texts), 1), AT_ONCE)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([sizes for _, sizes in parts])

    def safe_cuts(self) -> np.ndarray:
        """Whether two bytes may be parted: ASCII characters (a blank stands for the mark) that meet in no piece; any byte and a blank, if no piece has the mark after another character."""
        out = np.zeros((256, 256), bool)
        out[:128, :128] = True
        late = False
        for piece, kind in zip(self.model.pieces, self.model.kinds):
            if kind in (NORMAL, USER):
                text = piece.replace(MARK, " ")
                late |= " " in text.lstrip(" ")
                for a, b in zip(text, text[1:]):
                    if a < "\x80" and b < "\x80":
                        out[ord(a), ord(b)] = False
        if not late:
            out[128:, 32] = True
        return out

    def encode(self, column: pa.Array):
        """(first row, last row, ids, tokens of each text) by slices."""
        data, offsets = T.buffers(column)
        for a, b in T.slices(offsets):
            raw, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            sizes = np.diff(off)
            if self.cuts is None or b"\xe2\x96\x81" in raw.tobytes():
                texts = [x or "" for x in column[a:b].to_pylist()]
                ids, n = self.batch(self.whole, texts)
            else:
                # a blank before each text that isn't empty stands for the mark that begins it
                full = sizes > 0
                begin = np.concatenate([[0], np.cumsum(sizes + full)])
                text = np.full(int(begin[-1]), 32, np.uint8)
                text[T.ragged(begin[:-1] + full, sizes)] = raw
                edge = np.zeros(len(text) + 1, bool)
                edge[1:-1] = self.cuts[text[:-1], text[1:]] if len(text) else False
                edge[begin] = True
                places = np.flatnonzero(edge)
                starts, ends = (places[:-1], places[1:]) if len(text) else (places[:0], places[:0])
                ids, counts = self.store.of(text, starts, ends)
                n = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, begin)])
            self.verify(column[a].as_py() or "", ids[: n[0]])
            yield a, b, ids, n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and their sizes; ids must come from encode()."""
        sizes = self.size[ids]
        data = self.bytes[T.ragged(self.start[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
        if self.model.prefix:
            keep = np.ones(len(data), bool)
            keep[ends[:-1][n > 0]] = False
            return data[keep], np.diff(ends) - (n > 0)
        return data, np.diff(ends)

    def verify(self, text: str, ids: np.ndarray) -> None:
        expected = self.check.encode(text)
        alike = self.model.type == UNIGRAM and sorted(expected) == sorted(ids.tolist())  # the same pieces in another order have the same score
        if expected != ids.tolist() and not alike:
            raise ValueError("ids differ from those of the sentencepiece library")
        data, _ = self.decode(ids, np.array([len(ids)]))
        if data.tobytes().decode() != self.check.decode(expected):
            raise ValueError("decoded text differs from that of the sentencepiece library")


_CODECS: dict[str, Codec] = T.kept()


def codec(path: str) -> Codec:
    """One for each process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, tokens (binary, little-endian unsigned 32-bit ids) and decoded (the text out of them) of every row."""

    def run(batches):
        of = codec(path)
        for batch in batches:
            column = batch.column("text")
            if pa.types.is_string(column.type) and column.null_count:
                column = column.fill_null("")
            for a, b, ids, n in of.encode(column):
                ids = ids.astype("<u4")
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                data, sizes = of.decode(ids, n)
                text_ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_tokens": pa.array(n.astype(np.int64)),
                        "tokens": pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.tobytes())]),
                        "decoded": pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(text_ends), pa.py_buffer(data.tobytes())]),
                    }
                )
        T.rest()

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, tokens binary, decoded string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_tokens", F.crc32("tokens").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model")))
