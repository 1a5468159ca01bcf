"""Fill-in-the-middle against a plain tokenizer."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import clashing, documents, odd_texts, words
from quotalens.llm import infill


def plain_cut(key, text, epoch=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{epoch}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


MARKED = [
    (20, "a <P> b"), (21, "<<S"), (22, "x<M>"), (23, "<P><S><M>"), (24, "<P< S>"), (25, "\0\n\r\n\x85  "), (26, "😀é𝔘a𝔘bc😀" * 50), (27, "<" * 40), (28, ">" * 3),
    *[(k, words(k, k % 7) + "1. Ünï" * (k % 3)) for k in range(100, 160)]]


def test_rows_equal_the_plain_tokenizer_and_are_restored(spark):
    rows = odd_texts() + MARKED
    made = infill.fill_in_middle(clashing(documents(spark, rows)).drop("n_chars")).withColumn("restored", infill.restored())
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored", "node").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, rows))
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, r.text)
        assert r.restored == (r.text or "") and r.node == "x"
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_epochs_cut_anew_and_shares_are_kept(spark):
    docs = documents(spark, [(k, words(k, 30)) for k in range(400)])
    forms = {}
    for epoch in (1, 2):
        got = {r.doc_id: (r.form, r.prefix_chars, r.output) for r in infill.fill_in_middle(docs, epoch=epoch).collect()}
        assert all(got[k][2] == plain_cut(k, words(k, 30), epoch)[4] for k in got)
        forms[epoch] = got
    assert sum(forms[1][k] != forms[2][k] for k in forms[1]) > 300
    assert 15 < sum(f[0] == "plain" for f in forms[1].values()) < 70
    assert {r.form for r in infill.fill_in_middle(docs, plain_percent=0, suffix_first_percent=100).collect()} == {"spm"}


def test_empty_table(spark):
    out = infill.fill_in_middle(documents(spark, []))
    assert out.count() == 0 and out.columns[-5:] == ["n", "form", "prefix_chars", "middle_chars", "output"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300))
def test_ranks_equal_counts(symbols):
    x = np.array(symbols, np.uint8)
    at = np.arange(len(x) + 1)
    matrix = infill.WaveletMatrix(x)
    for c in range(4):
        assert matrix.rank(c, at).tolist() == [symbols[:k].count(c) for k in at]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128])
def test_runs_end_at_document_borders(size):
    texts = ["ab" * size, "cd", "", "1" * size, "e"]
    none = np.zeros(len(texts), np.int64)
    units, first, _ = infill.cut_places(texts, none, none)
    assert units.tolist() == [min(1, size), 1, 0, size, 1] and not first.any()
