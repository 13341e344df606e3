import collections
import re

import numpy as np
import pyarrow as pa

from moodlake.llm import decision_list
from moodlake.llm.common import text_buffer
from tests.llm.test_ngram_join import WORD


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if count[tuple(w[i:i + 3])] > 1:
            again[i] = again[i + 1] = again[i + 2] = True
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup,
            "n_repeat_words": sum(again), "n_marks": sum(c in "!?" for c in text), "n_upper": len(re.findall("[A-Z]", text)),
            "n_bare_words": sum(not re.search("[A-Za-z\x80-\U0010ffff]", x) for x in w),
            "n_echo_words": sum(a == b for a, b in zip(w, w[1:])), "n_lines": lines}


def test_statistics(odd_docs):
    for r in decision_list.with_statistics(odd_docs).collect():
        assert {k: r[k] for k in decision_list.STATS} == brute(r["text"])


def test_statistics_do_not_cross_texts():
    texts = ["a b", "a b", "", "a b c", "a b c a b c", "x\ny\nx", " ", "é ü é"]
    got = decision_list.text_statistics(*text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert {k: got[k][i] for k in decision_list.STATS} == brute(t)


def test_rules_cover_what_they_are_grown_for():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    rules = decision_list.learn_rules(x, bad)
    said = np.zeros(3000, bool)
    for rule in rules:
        said |= decision_list._covers(rule, x, 3000)
    assert (said & bad).sum() >= 0.9 * bad.sum() and (said & ~bad).sum() <= 0.01 * (~bad).sum()
    assert decision_list.learn_rules(x, np.zeros(3000, bool)) == []


def test_expression_is_the_ordered_list(spark, odd_docs):
    rules = [(decision_list.Condition("symbols_per_char", True, 0.1),),
             (decision_list.Condition("words", False, 60.0), decision_list.Condition("repeat_per_word", True, 0.2))]
    for r in decision_list.judge(odd_docs, rules).collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        hit = (r["n_symbols"] / max(r["word_chars"], 1) >= 0.1
               or (r["n_words"] <= 60 and r["n_repeat_words"] / max(r["n_words"], 1) >= 0.2))
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not hit)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = decision_list.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = decision_list.judge(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), rules).filter("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    poor = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_no_labels_and_empty_table(spark, odd_docs, no_docs, no_labels):
    assert decision_list.train(odd_docs, no_labels) == []
    assert decision_list.judge(no_docs, []).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in decision_list.judge(odd_docs, []).collect())
