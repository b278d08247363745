"""The string kernel against plain sets, held-out accuracy on the documents, and odd rows."""

import re

import numpy as np
import pytest

from mullion.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, score int, lang_pred string, grams int"


def plain_grams(text, longest=4):
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    t = re.sub(" +", " ", t)
    return {t[i:i + n] for n in range(1, longest + 1) for i in range(len(t) - n + 1)} if t.strip() else set()


TEXTS = ["Hello, World!", "a", "été à l'ÉTÉ", "123 !? ", "", "Straße 中文 текст", "x" * 50000, "aßİ i̇", "퟿\U0001F600 z"]


def test_grams_and_kernel_against_sets():
    sets, want = [langid.grams(t) for t in TEXTS], [plain_grams(t) for t in TEXTS]
    assert [len(s) for s in sets] == [len(w) for w in want]
    marks = [0, 2, 5, 7]
    kernel = langid.spanned_by([sets[i] for i in marks], ["a"]).kernel(sets)
    for i, row in enumerate(kernel):
        for j, m in zip(marks, row):
            assert m == pytest.approx(len(want[i] & want[j]) / max(1, np.sqrt(len(want[i]) * len(want[j]))), abs=1e-5)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 200
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoilt = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 'zz' ELSE lang END AS lang")
    got = [sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(d).collect()) for d in (docs, spoilt)]
    assert got[0] == got[1]


def test_odd_rows(spark):
    rows = [(2 * i, "the house of the man and the dog", "en", 1, "x", 2) for i in range(30)] + [(2 * i + 1, "das Haus und der Mann mit dem Hund", "de", 1, "x", 2) for i in range(30)]
    odd = [(None, "das Haus", "de", 1, "x", 2), (100, None, "en", 1, "x", 2), (101, "", "en", 1, "x", 2), (102, "12 -- !", "en", 1, "x", 2), (103, "der Mann " * 60000, None, 1, "x", 2), (0, "the house", "en", 1, "x", 2), (0, "the house", "en", 1, "x", 2)]
    got = langid.identify(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert len(got) == len(rows + odd)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [pred[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert pred[None][0] == "de" and pred[103][0] == "de" and pred[0][0] == "en"
    assert sum(r.doc_id == 0 for r in got) == 3


def test_nothing_to_learn_from(spark):
    got = langid.identify(spark.createDataFrame([(1, "a text", None, 1, "x", 2), (2, "!", "en", 1, "x", 2)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in got) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
