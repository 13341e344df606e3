"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format), and its parts are rebuilt: the normaliser (precompiled character map,
white space rules), the metaspace marker with its dummy prefix, unigram scores or the merges that bigram pieces imply, and
byte fallback. Whole texts are encoded and decoded in batches by the library's threads.

Words are split off before merging only if no piece of the model reaches over a marker from a word before it: then the split
changes nothing, and the library can reuse the pieces of words it has seen.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, byte_chunks, prepare, text_buffer, with_text_columns

MARK = "▁"
# FIXED VALUES of the model format: piece types and model types
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_codecs: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protobuf message: ints, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} is not part of a model file")
            size = varint()
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    """What a model file says, with the format's defaults."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix_space: bool = False

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.suffix_space = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    if m.kind not in (UNIGRAM, BPE) or m.suffix_space or not m.escape:
        raise ValueError("only unigram and BPE models with a leading marker are rebuilt")
    return m


def implied_merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces whose join is a piece, by the joined piece's score, best first."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = [(-m.pieces[i][1], i, ids[p[:k]], ids[p[k:]]) for p, i in ids.items() for k in range(1, len(p))
             if p[:k] in ids and p[k:] in ids]
    return [(m.pieces[a][0], m.pieces[b][0]) for *_, a, b in sorted(found)]


def build_tokenizer(m: Model):
    """A tokenizer of the library that does what the model says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    unk = m.pieces[m.unk_id][0]
    if m.kind == BPE:
        model = models.BPE(vocab, implied_merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        # the lattice holds normal and user-defined pieces only: others get a name with a space, which no normalised text
        # has. Byte pieces are then no fallback for the library either: ``encode_batch`` puts them in for unknown pieces
        model = models.Unigram([(p if kind in (NORMAL, USER_DEFINED) else f" {p}", s) for p, s, kind in m.pieces], unk_id=m.unk_id)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    # markers are replaced in the joined text, not piece by piece
    t.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "),
                                   *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    own = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens(own)
    return t


class Codec:
    """A model's tokenizer with what the library does not do itself."""

    def __init__(self, m: Model):
        self.model, self.tokenizer = m, build_tokenizer(m)
        self.kinds = np.array([kind for _, _, kind in m.pieces])
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        #: The unknown id where this class falls back to bytes, else none.
        self.unknown = m.unk_id if m.kind == UNIGRAM and m.byte_fallback else -1

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._with_bytes(text) if self.unknown in ids else ids for text, ids in zip(texts, found)]

    def _with_bytes(self, text: str) -> list[int]:
        """Ids with the bytes of what an unknown piece stands for in its place (only the slow call names pieces)."""
        out = []
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        for i, piece in zip(encoding.ids, encoding.tokens):
            out += [self.bytes[b] for b in piece.encode()] if i == self.unknown else [i]
        return out

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """Control pieces have no text."""
        if self.model.kind == BPE:
            return self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [self._joined(own) for own in ids]

    def _joined(self, ids: list[int]) -> str:
        parts: list[bytes] = []
        strip = self.model.dummy_prefix or self.model.remove_extra     # a marker at the very beginning
        for i in ids:
            piece, _, kind = self.model.pieces[i]
            if kind in (NORMAL, USER_DEFINED, UNUSED):
                parts.append((piece.removeprefix(MARK) if strip and not parts else piece).replace(MARK, " ").encode())
            elif kind != CONTROL:
                parts.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else " \u2047 ".encode())
        return b"".join(parts).decode("utf-8", "replace")


def load(path: str, threads: int = 2) -> Codec:
    """The codec of a model file, built once per process; its batches use ``threads`` threads."""
    if path not in _codecs:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as f:
            _codecs[path] = Codec(parse_model(f.read()))
    return _codecs[path]


def _encode(path: str, threads: int):
    types = {"ids": pa.list_(pa.int32())}

    def kernel(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        tok = load(path, threads)
        _, ends = text_buffer(texts)
        for lo, hi in byte_chunks(ends, 1 << 20):
            done = tok.encode_batch(texts.slice(lo, hi - lo).to_pylist())
            yield as_batch({"ids": [np.array(x, np.int32) for x in done]}, types)
    return kernel


def encode(docs: DataFrame, model_file: str, threads: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of each whole text (null and empty: none). All rows stay, repeated ones too;
    an empty table gives an empty one, and a column ``ids`` is replaced."""
    prepare(docs.sparkSession)
    return with_text_columns(docs, _encode(model_file, threads), "ids array<int>", keep)


def decode(rows: DataFrame, model_file: str, threads: int = 2) -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids`` (null ids: empty); all other columns stay."""
    prepare(rows.sparkSession)
    kept = [c for c in rows.columns if c not in ("ids", "text")]
    packed = rows.select(F.struct(F.lit(True).alias("_"), *kept).alias("row"), F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(model_file, threads)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = tok.decode_batch([x or [] for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(texts, pa.string())],
                                                 names=["row", "ids", "text"])

    made = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, text string")
    return made.select(*[F.col("row")[c].alias(c) for c in kept], "ids", "text")


def round_trip(docs: DataFrame, model_file: str, threads: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_unknown, n_byte_tokens (byte fallbacks), ids_crc32 (unsigned, of the ids as little-endian
    unsigned 32-bit integers) and decoded_equal: whether decoding gives the whole text back (null: empty). The ids do not
    leave the task."""
    prepare(docs.sparkSession)
    types = {"n_tokens": pa.int64(), "n_unknown": pa.int64(), "n_byte_tokens": pa.int64(), "ids_crc32": pa.int64(),
             "decoded_equal": pa.bool_()}

    def kernel(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        tok = load(model_file, threads)
        _, ends = text_buffer(texts)
        for lo, hi in byte_chunks(ends, 1 << 20):
            own = texts.slice(lo, hi - lo).to_pylist()
            ids = tok.encode_batch(own)
            back = tok.decode_batch(ids)
            flat = [np.array(x, "<u4") for x in ids]
            kinds = [tok.kinds[x] if len(x) else tok.kinds[:0] for x in flat]
            yield as_batch({"n_tokens": [len(x) for x in ids], "n_unknown": [int((k == UNKNOWN).sum()) for k in kinds],
                            "n_byte_tokens": [int((k == BYTE).sum()) for k in kinds],
                            "ids_crc32": [zlib.crc32(x) for x in flat],
                            "decoded_equal": [a == b for a, b in zip(own, back)]}, types)

    return with_text_columns(docs, kernel, "n_tokens long; n_unknown long; n_byte_tokens long; ids_crc32 long; "
                                           "decoded_equal boolean", keep)


def parity(docs: DataFrame, model_file: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with same_ids and same_text: whether the reference library encodes each whole text to the same ids and decodes
    them to the same text. For verification; it needs that library in the tasks."""
    prepare(docs.sparkSession)

    def kernel(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        tok, other = load(model_file), sentencepiece.SentencePieceProcessor(model_file=model_file)
        _, ends = text_buffer(texts)
        for lo, hi in byte_chunks(ends, 1 << 20):
            own = texts.slice(lo, hi - lo).to_pylist()
            ids, theirs = tok.encode_batch(own), other.encode(own, num_threads=1)
            back = tok.decode_batch(ids)
            yield as_batch({"same_ids": [a == b for a, b in zip(ids, theirs)],
                            "same_text": [a == b for a, b in zip(back, other.decode(theirs))]},
                           {"same_ids": pa.bool_(), "same_text": pa.bool_()})

    return with_text_columns(docs, kernel, "same_ids boolean; same_text boolean", keep)
