"""Operator 12 against plain Python, and on odd rows."""

import hashlib
import random

import pytest

from basewise.llm import fill_in_middle

rnd = random.Random(12)


def plain(doc_id, text):
    t, sha = text or "", lambda x: hashlib.sha256(x.encode()).hexdigest()
    digits = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:x], t[x:y], t[y:]
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t, sha(t), sha(t))
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", x, y - x, out, sha(out), sha(t))


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("run, slice_bytes", [(64, 8_000_000), (3, 200), (1, 1)])
def test_against_plain_python(spark, monkeypatch, run, slice_bytes):
    monkeypatch.setattr(fill_in_middle, "SLICE_BYTES", slice_bytes)
    texts = ["", None, "a", "<", "<P", "x<P>y", "<S>", "a<M>", "P>", "S>M>P>" * 5, "<<<" * 30, "a\x00b\r\n c" * 20, "é日🤗́" * 40, "x" * 64, "y" * 128, "z" * 129, "'%s' {run} $1 \\1" * 9]
    texts += ["".join(rnd.choice("ab <>PSM\n é日🤗") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(-5, "minus"), (10**15, "large id"), (None, "no id"), (None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(fill_in_middle.fill_in_middle(docs, run=run))
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_long_text_and_odd_columns(spark):
    long = "".join(rnd.choice("abcdefg é日🤗\n") for _ in range(100_000)) * 30
    rows = [("k", long), ("", "short"), (None, "short")]
    docs = spark.createDataFrame([(a, b, 1, "f", "o") for a, b in rows], "doc_id string, text string, n int, form string, batch string")
    found = fill_in_middle.fill_in_middle(docs)
    assert rows_of(found) == sorted((plain(*r) for r in rows), key=str)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_marks_are_checked(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id int, text string")
    assert fill_in_middle.fill_in_middle(docs, changed=100, suffix_first=0, marks=("|pre|"[:-1], "|suf", "|mid")).first().output.startswith("|pre")
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs, marks=marks)
