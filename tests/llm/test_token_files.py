import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from moodlake.llm import token_files
from moodlake.session import scratch_dir

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 4000):
        docs = [np.append(rng.integers(0, 7, rng.integers(0, n)), 0).astype(np.uint32) for _ in range(5)]
        counts, ids = np.array([len(x) for x in docs]), np.concatenate(docs)
        s = token_files.Shard(token_files.write_shard([3, None, 5, 6, 7], counts, ids, 300))
        assert np.array_equal(s.all_tokens(), ids)
        assert all(np.array_equal(s.document(i), x) for i, x in enumerate(docs))
        assert s.known.tolist() == [1, 0, 1, 1, 1] and s.doc_ids.tolist() == [3, 0, 5, 6, 7]
        assert [len(token_files.expand(np.array([300 + i]), s.rules, 300)) for i in range(len(s.rules))] == s.lengths.tolist()
        for a in rng.integers(0, len(ids), 20).tolist():
            assert np.array_equal(s.tokens(a, 9), ids[a:a + 9])
    assert len(s.rules) and len(s.sequence) < len(ids)
    with pytest.raises(ValueError):
        token_files.Shard(b"none")


def test_few_symbols_left_for_rules():
    ids = np.array([1, 2, 1, 2, 3, 4] * 200 + [0], np.uint32)
    rules, seq = token_files.re_pair(ids, token_files.SYMBOLS - 1)
    assert len(rules) == 1 and np.array_equal(token_files.expand(seq, rules, token_files.SYMBOLS - 1), ids)


@pytest.mark.parametrize("copies", [10, 200])
def test_repeated_passages_become_rules(copies):
    """Pairs are replaced until none pays for a rule: copies of 1,000 ids end as few symbols each."""
    ids = np.append(np.tile(np.random.default_rng(4).integers(1, 50_000, 1000), copies), 0)
    rules, seq = token_files.re_pair(ids, 50_257)
    assert len(seq) <= 4 * copies + 8 and token_files.expansion_lengths(rules, 50_257).max() >= 250
    assert np.array_equal(token_files.expand(seq, rules, 50_257), ids)


def test_ids_that_do_not_fit():
    for ids, base in (([1, 2], 70_000), ([1, 300], 300)):
        with pytest.raises(ValueError):
            token_files.re_pair(np.array(ids), base)


@pytest.mark.parametrize("shard", [500, 1_000_000])
def test_files_equal_the_library(spark, odd_docs, monkeypatch, shard):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", shard)
    path = scratch_dir(spark, "tokens")
    token_files.write_tokens(odd_docs, path, FILE)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    tok, start = Tokenizer.from_file(FILE), 0
    rows = odd_docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").orderBy("doc_id", "h").collect()
    assert len(got) == len(rows)
    for r, g in zip(rows, got):
        ids = np.array(tok.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_empty_table(spark, no_docs):
    path = scratch_dir(spark, "tokens")
    token_files.write_tokens(no_docs, path, FILE)
    assert token_files.read_tokens(spark, path).count() == 0


def _by_library(texts):
    tok = token_files.tokenizer(FILE)
    ids = [np.array([*tok.encode(x, add_special_tokens=False).ids, 0], np.uint32) for x in texts]
    return [len(x) for x in ids], np.concatenate(ids)


def test_pieces_equal_whole_texts(monkeypatch):
    """Blanks of all kinds, signs, contractions, digits, accents, other scripts and the added token, in every order."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    some = [" ", " ", " ", "\n", "\n", "\t", "\r", " ", "\u0085", " ", "　", "\x1c", "'s", "'", "'ll", ",", ".", "$$", "3", "42",
            "word", "The", "é", "ñu", "Ã", "×", "÷", "ª", "Ж", "字", "́", "\U0001f600", "a", "x", "\x00", "\x7f", "ü.", "é\n"]
    texts = ["".join(rng.choice(some, rng.integers(0, 40))) for _ in range(600)] + ["", " ", "\n", "a", "é"]
    known = token_files.Encoder(token_files.tokenizer(FILE))
    for most in (1 << 20, 40):      # pieces kept, and forgotten again and again
        monkeypatch.setattr(token_files, "MAX_PIECES", most)
        for lo in range(0, len(texts), 100):
            count, ids = known.encode(pa.array(texts)[lo:lo + 100])
            want = _by_library(texts[lo:lo + 100])
            assert count.tolist() == want[0] and np.array_equal(ids, want[1])
    assert known.cuts
    for x in (["a <|endoftext|> b.", "it's"], ["a<|endoftext|>"], [""], ["", ""]):
        count, ids = known.encode(pa.array(x))
        assert (count.tolist(), ids.tolist()) == (_by_library(x)[0], _by_library(x)[1].tolist())


def test_the_library_gets_a_repeated_piece_once():
    import pyarrow as pa
    known, seen = token_files.Encoder(token_files.tokenizer(FILE)), []
    plain = known.words

    class Watched:
        def encode_batch_fast(self, lines, **kw):
            seen.extend(lines)
            return plain.encode_batch_fast(lines, **kw)
    known.words = Watched()
    text = " some words of a text" * 500
    for _ in range(3):
        count, _ = known.encode(pa.array([text, text]))
        assert count.tolist() == _by_library([text, text])[0]
    assert sum(map(len, seen)) < 100


def test_another_tokenizer_takes_whole_texts():
    import pyarrow as pa
    from tokenizers import models, pre_tokenizers
    tok = Tokenizer(models.WordLevel({"a": 1, "b": 2, "?": 3}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    other = token_files.Encoder(tok)
    assert not other.cuts
    count, ids = other.encode(pa.array(["a b a", "", "c"]))
    assert count.tolist() == [4, 1, 2] and ids.tolist() == [1, 2, 1, 0, 0, 3, 0]


def test_expansion_of_many_symbols():
    ids = np.append(np.tile(np.array([5, 6, 7, 8, 9, 5, 6], np.uint32), 300), np.arange(1, 200, dtype=np.uint32))
    rules, seq = token_files.re_pair(ids, 300)
    assert len(seq) >= 4 * len(rules) and np.array_equal(token_files.expand(seq, rules, 300), ids)
    assert len(token_files.expand(seq[:0], rules, 300)) == 0 == len(token_files.expand(seq[:0], rules[:0], 300))
