"""Token-id files compressed by Re-Pair grammars.

Documents are encoded in ascending doc_id order (range-partitioned), end id included, and cut into shards of about
``SHARD_TOKENS`` ids. In each shard, the most frequent pairs of neighbouring ids are replaced by nonterminals, round by
round, pairs that hold the end id excepted, so no nonterminal crosses a document. A shard is one binary value:

    magic ``RPG1``, then counts as unsigned 32-bit: base (first nonterminal), rules, sequence, documents;
    rules: two unsigned 16-bit symbols each; expansion length of each rule: unsigned 32-bit;
    sequence: unsigned 16-bit symbols; per document: doc_id (signed 64-bit), whether it is set (byte),
    ids (unsigned 32-bit), sequence symbols (unsigned 32-bit). All little-endian.

Shards are rows of a Parquet table (part, shard, n_tokens, blob): any store that Spark writes to can hold them. The rules'
expansion lengths give random access: a range of ids is decoded from the symbols that cover it alone.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, byte_chunks, prepare, shuffle_partitions, text_buffer

END_ID = 0
SHARD_TOKENS = 1_000_000
#: Symbols are 16-bit; nonterminals take what the vocabulary leaves.
SYMBOLS = 1 << 16
#: A rule takes the room of four symbols (two, and its expansion length); a pair seen more often pays for it.
MIN_COUNT = 5
#: Text bytes encoded at once, and those of one call of the library.
ENCODE_BYTES, CALL_BYTES = 8 << 20, 1 << 16
#: Most pieces of text whose ids a process keeps, the bytes of one, and the ids kept.
MAX_PIECES, MAX_PIECE_BYTES, MAX_PIECE_IDS = 1 << 20, 48, 1 << 23
_MAGIC = b"RPG1"
_tokenizers: dict = {}
_encoders: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
        from tokenizers import Tokenizer
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


# Bytes that are ASCII's visible characters, letters and other ones but digits; and those that begin a character that is surely
# not white (white ones beyond ASCII are among U+0080 to U+00BF and U+1000 to U+3FFF).
_VISIBLE, _LETTER, _SIGN = (np.zeros(256, bool) for _ in range(3))
_VISIBLE[0x21:0x7F] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[0x21:0x7F] = True
_SIGN[[*range(0x30, 0x3A)]] = False
_SIGN &= ~_LETTER
_BEGINS = _VISIBLE.copy()
_BEGINS[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def _piece_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the pieces of UTF-8 texts that follow one another. Cuts are where the byte-level pattern ends a token whatever
    comes before and after: before one blank, before and after one line feed (both between characters that are not white),
    and between a letter (ASCII or Latin-1) and an ASCII sign."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        cut[1:-1] = _LETTER[data[:-1]] & _SIGN[data[1:]]
        accent = _accents(data, data[1:-1])
        cut[accent[_SIGN[data[accent + 2]]] + 2] = True
        white = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1
        before = data[white - 1]
        solid = _VISIBLE[before]
        wide = np.flatnonzero(before >= 0x80)           # the last byte of a character of two or three bytes
        two, three = data[white[wide] - 2], data[np.maximum(white[wide] - 3, 0)]
        solid[wide] = (two >= 0xC3) & (two < 0xE0) | (two < 0xC0) & (two >= 0x80) & (three >= 0xE4) & (three < 0xF0)
        white = white[solid & _BEGINS[data[white + 1]]]
        cut[white] = True
        cut[white[data[white] == 0x0A] + 1] = True
    cut[ends] = True
    cut[0] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts by the tokenizers library. With the byte-level pattern a text is cut into pieces, whose ids in turn are
    the text's; the library encodes each distinct piece once, many in one call, and the ids of a bounded number of short
    pieces are kept for the next texts. Texts beside an added token, and those for other tokenizers, go to the library whole."""

    def __init__(self, tok):
        spec = json.loads(tok.to_str())
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.tok, self.added = tok, [x["content"].encode() for x in spec["added_tokens"]]
        self.cuts = (split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
                     and not any(spec[x] for x in ("normalizer", "post_processor", "truncation", "padding"))
                     and model["type"] == "BPE" and not model["dropout"] and not any(b"\n" in x for x in self.added))
        if self.cuts:
            from tokenizers import Tokenizer, pre_tokenizers
            byte = sorted(pre_tokenizers.ByteLevel.alphabet())          # one character for each byte: bytes of each id
            shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            self.byte = dict(zip(shown + [x for x in range(256) if x not in shown], byte)) | {0x0A: "\n"}
            self.words = Tokenizer(tok.model)
            self.words.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
            self.width = np.zeros(tok.get_vocab_size(), np.int64)
            for token, i in tok.get_vocab().items():
                self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, ids of all texts)"""
        found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, np.uint32), *found])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that are one token of the pattern each: a call's words go to the library's model as one text of
        lines, in the byte-level alphabet. An id stands for a known number of bytes, which tells the words' ids apart."""
        data, upto = text_buffer(words)
        calls = [(lo, hi, data[upto[lo - 1] if lo else 0:upto[hi - 1]], upto[lo:hi] - (upto[lo - 1] if lo else 0))
                 for lo, hi in byte_chunks(upto, CALL_BYTES)]
        lines = [np.insert(own, ends[:-1], 0x0A).tobytes().decode("latin-1").translate(self.byte) for _, _, own, ends in calls]
        count, ids = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        for (lo, hi, _, ends), found in zip(calls, self.words.encode_batch_fast(lines, add_special_tokens=False)):
            own = np.array(found.ids, np.uint32)
            at = np.cumsum(self.width[own])
            if len(at) and at[-1] == ends[-1]:
                count[lo:hi] = np.diff(np.searchsorted(at, ends) + 1, prepend=0)
            else:                                       # bytes that have no id
                count[lo:hi], own = self._whole(words.slice(lo, hi - lo).to_pylist())
            ids.append(own)
        return count, np.concatenate(ids)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, count) of each distinct piece's ids, and the ids."""
        slot = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy()
        first, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        old, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        first[old], size[old] = self.first[slot[old]], self.count[slot[old]]
        fresh = pieces.take(pa.array(new))
        word = _are_words(fresh)
        (a, own), (b, more) = self._words(fresh.filter(pa.array(word))), self._whole(fresh.filter(pa.array(~word)).to_pylist())
        order = np.concatenate((new[word], new[~word]))
        size[order] = np.concatenate((a, b))
        first[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        ids = np.concatenate((self.ids, own, more))
        if len(self.known) + len(fresh) > MAX_PIECES or len(ids) > MAX_PIECE_IDS:
            self._forget()
        else:
            short = pc.less_equal(pc.binary_length(fresh), MAX_PIECE_BYTES)
            kept = new[short.to_numpy(zero_copy_only=False)]
            self.known = pa.concat_arrays([self.known, fresh.filter(short)])
            self.first, self.count, self.ids = np.append(self.first, first[kept]), np.append(self.count, size[kept]), ids
        return first, size, ids

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, its end id included, and the ids of all texts) of an Arrow array without nulls."""
        data, ends = text_buffer(text)
        raw = data.tobytes()
        if not self.cuts or any(x in raw for x in self.added):
            count, ids = self._whole(text.to_pylist())
            return count + 1, np.insert(ids, np.cumsum(count), END_ID)
        cuts = _piece_ends(data, ends)
        pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(0, cuts)), pa.py_buffer(raw)).dictionary_encode()
        first, size, ids = self._pieces(pieces.dictionary)
        # the end id is a piece of its own, after each text's last one
        first, size, ids = np.append(first, len(ids)), np.append(size, 1), np.append(ids, np.uint32(END_ID))
        upto = np.searchsorted(cuts, ends, side="right")
        own = np.insert(pieces.indices.to_numpy().astype(np.int64), upto, len(first) - 1)
        width = size[own]
        total = np.cumsum(width)
        at = np.arange(total[-1], dtype=np.int32 if total[-1] + len(ids) < 1 << 31 else np.int64)
        at += np.repeat((first[own] - total + width).astype(at.dtype), width)
        out = ids[at]
        return np.diff(total[upto + np.arange(len(upto))], prepend=0), out


def _are_words(pieces: pa.Array) -> np.ndarray:
    """Which pieces are a blank or none, and letters (ASCII or Latin-1): one token of the byte-level pattern."""
    data, ends = text_buffer(pieces)
    starts = np.append(0, ends[:-1])[:len(ends)]
    other = ~_LETTER[data]
    other[_accents(data, data[1:])] = False
    other[1:][_accents(data, data[1:])] = False
    blank = data[starts] == 0x20
    other[starts[blank]] = False
    return (np.diff(np.append(0, np.cumsum(other))[np.append(0, ends)]) == 0) & (ends - starts > blank)


def _accents(data: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where a letter of U+00C0 to U+00FF begins."""
    at = np.flatnonzero(data[:len(after)] == 0xC3)
    return at[(after[at] != 0x97) & (after[at] != 0xB7)]


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file, with the pieces that the process has met, made once per process."""
    if path not in _encoders:
        _encoders[path] = Encoder(tokenizer(path))
    return _encoders[path]


def re_pair(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): symbol base + i stands for the pair rules[i]. Each round takes the pairs that are at least
    an eighth as frequent as the most frequent one, and replaces them from left to right, until no pair pays for a rule
    or no symbol is left."""
    if base > SYMBOLS or ids.max(initial=0) >= base:
        raise ValueError(f"ids must be under the first nonterminal ({base}), and that at most {SYMBOLS}")
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint16)
    while len(seq) > 1:
        key = (seq[:-1] << np.uint32(16)) | seq[1:]
        inner = (seq[:-1] != END_ID) & (seq[1:] != END_ID)
        ordered = np.sort(key[inner])
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(ordered)))
        room = SYMBOLS - base - len(rules)
        some = np.flatnonzero(count >= max(MIN_COUNT, int(count.max(initial=0)) // 8))
        if not len(some) or room <= 0:
            break
        some = np.sort(some[np.argsort(-count[some], kind="stable")][:room])
        chosen = ordered[first[some]]
        # most places fail by one of their symbols already; only the others are looked up
        begins, ends = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
        begins[chosen >> np.uint32(16)], ends[chosen & np.uint32(0xFFFF)] = True, True
        at = np.flatnonzero(inner & begins[seq[:-1]] & ends[seq[1:]])
        slot = np.searchsorted(chosen, key[at])
        hit = chosen[np.minimum(slot, len(chosen) - 1)] == key[at]
        at, slot = at[hit], slot[hit]
        # neighbouring hits overlap: every other one of a run is replaced
        fresh = np.r_[True, at[1:] != at[:-1] + 1]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        odd = (np.arange(len(at)) - run) % 2 == 1
        at, slot = at[~odd], slot[~odd]
        seq[at] = base + len(rules) + slot
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        seq = seq[kept]
        rules = np.concatenate((rules, np.stack((chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)), axis=1).astype(np.uint16)))
    return rules, seq.astype(np.uint16)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    out = np.zeros(len(rules), np.uint32)
    lo = 0
    while lo < len(rules):                          # rules refer to earlier ones only
        hi = lo + max(1, int((rules[lo:].max(1) < base + lo).argmin() or len(rules) - lo))
        part = rules[lo:hi].astype(np.int64) - base
        out[lo:hi] = np.where(part < 0, 1, out[np.maximum(part, 0)]).sum(1)
        lo = hi
    return out


def _symbols(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    out = symbols.astype(np.uint32)
    while len(out) and out.max() >= base:
        pair = out >= base
        width = np.where(pair, 2, 1)
        at = np.cumsum(width) - width
        new = np.empty(int(width.sum()), np.uint32)
        new[at[~pair]] = out[~pair]
        both = rules[out[pair] - base]
        new[at[pair]], new[at[pair] + 1] = both[:, 0], both[:, 1]
        out = new
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for. Each distinct symbol is expanded once, if those are fewer."""
    if len(symbols) < 4 * len(rules):
        return _symbols(symbols, rules, base)
    used = np.zeros(base + len(rules), bool)
    used[symbols] = True
    own = np.flatnonzero(used)
    width = np.ones(base + len(rules), np.int64)
    width[base:] = expansion_lengths(rules, base)
    ids, first = _symbols(own, rules, base), np.zeros(len(width), np.int64)
    first[own] = np.cumsum(width[own]) - width[own]
    size = width[symbols]
    total = np.cumsum(size)
    return ids[np.arange(total[-1] if len(total) else 0) + np.repeat(first[symbols] - total + size, size)]


def write_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    rules, seq = re_pair(ids, base)
    lengths = expansion_lengths(rules, base)
    width = np.ones(len(seq), np.int64)
    nonterminal = seq >= base
    width[nonterminal] = lengths[seq[nonterminal].astype(np.int64) - base]
    symbols = np.diff(np.searchsorted(np.cumsum(width), np.cumsum(counts)) + 1, prepend=0)
    head = np.array([base, len(rules), len(seq), len(doc_ids)], "<u4")
    return b"".join([_MAGIC, head.tobytes(), rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(),
                     seq.astype("<u2").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
                     np.array([x is not None for x in doc_ids], "u1").tobytes(), counts.astype("<u4").tobytes(),
                     symbols.astype("<u4").tobytes()])


class Shard:
    """A shard's parts, read in place."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a shard of this format")
        self.base, rules, seq, docs = np.frombuffer(blob, "<u4", 4, 4).tolist()
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.rules, self.lengths = take("<u2", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.sequence = take("<u2", seq)
        self.doc_ids, self.known = take("<i8", docs), take("u1", docs)
        self.counts, self.symbols = take("<u4", docs), take("<u4", docs)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        end = int(self.symbols[:i + 1].sum(dtype=np.int64))
        return expand(self.sequence[end - int(self.symbols[i]):end], self.rules, self.base)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Ids [start, start + count) of the shard, from the symbols that cover them."""
        width = np.ones(len(self.sequence), np.int64)
        pair = self.sequence >= self.base
        width[pair] = self.lengths[self.sequence[pair].astype(np.int64) - self.base]
        ends = np.cumsum(width)
        lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + count, side="left") + 1
        skip = start - (int(ends[lo - 1]) if lo else 0)
        return expand(self.sequence[lo:hi], self.rules, self.base)[skip:skip + count]

    def all_tokens(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.base)


_FILE = {"part": pa.int32(), "shard": pa.int32(), "n_tokens": pa.int64(), "blob": pa.binary()}


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).encode
        base, part, shard = tokenizer(path).get_vocab_size(), TaskContext.get().partitionId(), 0
        docs, counts, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            blob = write_shard(docs, np.array(counts, np.int64), np.concatenate(held), base)
            return as_batch({"part": [part], "shard": [shard], "n_tokens": [size], "blob": [blob]}, _FILE)

        for batch in batches:
            keys, text = batch.column("doc_id").to_pylist(), batch.column("text")
            _, ends = text_buffer(text)
            for lo, hi in byte_chunks(ends, ENCODE_BYTES):
                count, found = ids_of(text.slice(lo, hi - lo))
                for key, ids in zip(keys[lo:hi], np.split(found, np.cumsum(count)[:-1])):
                    if held and size + len(ids) > SHARD_TOKENS:
                        yield flush()
                        docs, counts, held, size, shard = [], [], [], 0, shard + 1
                    docs.append(key)
                    counts.append(len(ids))
                    held.append(ids)
                    size += len(ids)
        if held:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str) -> None:
    """Writes the ids of every whole text (null: empty), each followed by id 0, in ascending doc_id order (nulls first, equal
    ids by text) as the shards of a Parquet table at ``path``. A vocabulary of over 65,536 ids is an error. An empty table
    gives an empty one; repeated rows are documents of their own, and range bounds only split rows that differ in id or text."""
    if tokenizer(tokenizer_file).get_vocab_size() > SYMBOLS:
        raise ValueError(f"the vocabulary of {tokenizer_file} does not fit symbols of 16 bits")
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    (rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
     .select("doc_id", "text").mapInArrow(_encode(tokenizer_file), "part int, shard int, n_tokens long, blob binary")
     .write.option("compression", "zstd").parquet(path))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"part": pa.int32(), "shard": pa.int32(), "doc_id": pa.int64(), "at": pa.int64(), "n_tokens": pa.int64(),
             "ids_crc32": pa.int64()}
    for batch in batches:
        for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "blob"))):
            s = Shard(blob)
            ids = s.all_tokens().astype("<u4")
            ends = np.cumsum(s.counts.astype(np.int64))
            starts = ends - s.counts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield as_batch({"part": np.full(len(crc), part, np.int32), "shard": np.full(len(crc), number, np.int32),
                            "doc_id": pa.array(s.doc_ids, mask=s.known == 0), "at": starts,
                            "n_tokens": s.counts.astype(np.int64), "ids_crc32": crc}, types)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, decoded from the files."""
    prepare(spark)
    files = spark.read.parquet(path)
    shards = files.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    # running totals: over the parts (one row each), then over each part's shards
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = (shards.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part")
              .select("part", "shard", (F.col("part_start") + F.col("within")).alias("shard_start")))
    docs = files.mapInArrow(_documents, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
