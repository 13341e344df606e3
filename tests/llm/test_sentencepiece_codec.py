import struct

import public_tokenizers
import pytest
import sentencepiece

from moodlake.llm import sentencepiece_codec as codec

FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "  two  spaces ", " lead", "\ttab\n\nnl", "日本語テキスト😀 emoji", "a" * 300, "▁mark ▁▁ x", "<s> </s> <unk> <0x41>",
       "é combining é", " nbsp　wide", "x\x00y", "The The  The   The    The", "don't stop  "]


def test_parity_on_odd_texts():
    tok, other = codec.load(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    for text in ODD:
        ids, = tok.encode_batch([text])
        assert ids == other.encode(text), text
        assert tok.decode_batch([ids]) == [other.decode(ids)], text


def test_every_piece_of_the_model_in_parity():
    tok, other = codec.load(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = [p.replace(codec.MARK, " ") for p, _, kind in codec.parse_model(open(FILE, "rb").read()).pieces if kind == codec.NORMAL]
    assert tok.encode_batch(texts) == other.encode(texts)


def test_parity_on_documents(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = codec.parity(docs, FILE, ["doc_id"]).collect()
        assert len(rows) == docs.count() and all(r["same_ids"] and r["same_text"] for r in rows)


def _message(*fields):
    """Protobuf bytes of (number, value): ints as varints, floats as 32 bits, bytes with their length."""
    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])
    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += varint(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(k << 3) + varint(v)
        else:
            out += varint(k << 3 | 2) + varint(len(v)) + v
    return out


def unigram_model(dummy_prefix=True, remove_extra=True, fallback=True):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256) if fallback]
    pieces += [("unused", -1.0, 5)]
    pieces += [("▁", -3.0, 1), ("▁ab", -2.0, 1), ("ab", -2.5, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("c", -4.5, 1), ("bc", -3.5, 1),
               ("▁a", -3.0, 1), ("abc", -6.5, 1)]
    body = [(1, _message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces]
    body += [(2, _message((3, 1), (35, int(fallback)))), (3, _message((3, int(dummy_prefix)), (4, int(remove_extra)), (5, 1)))]
    return _message(*body)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("dummy_prefix", [True, False])
@pytest.mark.parametrize("remove_extra", [True, False])
def test_unigram_in_parity(dummy_prefix, remove_extra, fallback):
    """Control, byte, unknown and unused pieces are never read from a text."""
    data = unigram_model(dummy_prefix, remove_extra, fallback)
    tok, other = codec.Codec(codec.parse_model(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["", "ab", "abc abc", " ab  c ", "zé ab", "aabbcc", "cab", "  ", "a <s> a", "<s></s>", "<0x41>", "a<unk>b", "unused a", "日本 <s>ab é",
             "x\u2047 a", "abz zz"]
    assert tok.encode_batch(texts) == other.encode(texts)
    ids = tok.encode_batch(texts)
    assert tok.decode_batch(ids) == other.decode(ids)
    assert tok.decode_batch([[1, 5, 2]]) == [other.decode([1, 5, 2])]


def test_encode_then_decode(spark, odd_docs, no_docs):
    rows = codec.decode(codec.encode(odd_docs, FILE).withColumnRenamed("text", "given"), FILE).collect()
    assert len(rows) == odd_docs.count()
    marked = [r for r in rows if "▁" not in (r["given"] or "")]
    assert all(r["text"] == (r["given"] or "") for r in marked)
    assert all(r["ids"] == [] for r in rows if not r["given"])
    for r in codec.round_trip(odd_docs, FILE).collect():
        assert r["decoded_equal"] and r["n_unknown"] == 0
    assert codec.round_trip(no_docs, FILE).count() == 0
