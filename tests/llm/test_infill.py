"""Fill-in-the-middle against a plain restatement of the rule, text by text."""

import hashlib
import re

import pytest

from chainspark.llm import infill

TEXTS = [None, "", "\n", "one", "one\n", "a\nb", "a\n\n\nb\n", "é\nü ñ\n日本\nx", "has <S> in it\nx", "<P>", "<P\nS>\n<M", "\r\n\x0b\n", "\n" * 70, "".join(f"line {i} ü\n" for i in range(40_000)) + "end"]


def by_hand(doc_id, text, share=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= share:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 31 - 40, t, "mine", 1.5) for i in range(12) for t in TEXTS]
    rows += [(None, "a\nb\nc", "mine", None), (rows[5][0], rows[5][1], "mine", 1.5), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, form string, `odd name` double")


@pytest.mark.parametrize("share, spm", [(100, 50), (40, 100), (0, 50)])
def test_equal_to_the_rule(docs, share, spm):
    got = infill.restored(infill.rearranged(docs, share=share, spm=spm)).collect()
    assert len(got) == docs.count()
    marks = infill.MARKS
    for r in got:
        n, form, pre, mid, output = by_hand(r.doc_id, r.text, share, spm)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, pre, mid, output)
        assert r.restored == (r.text or "") and r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
        raw = (r.text or "").encode()
        assert b"".join((raw, marks)[p.buffer][p.begin : p.end] for p in r.pieces) == output.encode()
    assert {r.form for r in got} == ({"plain"} if not share else {"plain", "spm"} if spm == 100 else {"plain", "spm", "psm"})


def test_empty_table_and_other_columns(spark, docs):
    assert infill.restored(infill.rearranged(docs.limit(0))).count() == 0
    made = infill.rearranged(docs)
    assert made.columns == ["doc_id", "text", "odd name", *dict(infill.ARRANGED)]
    lost = spark.createDataFrame([(None, "psm")], "output string, form string")
    assert [(r.restored, r.restored_sha256) for r in infill.restored(lost).collect()] == [(None, None)]
