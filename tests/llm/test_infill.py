import hashlib
import random
import re

import pytest

from cohortloom.llm import infill as I
from tests.llm.tables import documents, odd_documents


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def compare(df, rows):
    want = sorted([(i, *by_hand(i, t)) for i, t in rows], key=str)
    out = I.transform(df)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()], key=str) == want
    got = sorted([tuple(r) for r in I.digest(out).collect()], key=str)
    assert got == sorted([(i, *by_hand(i, t)[:4], sha(by_hand(i, t)[4]), sha(t or "")) for i, t in rows], key=str)


ALPHABET = ["a", "Z", "word", " ", "\n", "é", "日", "𝒳", "<", ">", "P", "<P", "S>", "<<", "1", "\x00", "@", "[", "`", "{"]


@pytest.mark.parametrize("chunk", [1 << 20, 7, 64])
def test_any_text(spark, monkeypatch, chunk):
    monkeypatch.setattr(I, "CHUNK", chunk)
    r = random.Random(3)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", "<P>", "a<M>b", "<S"]
    got = I.arrange([t.encode() for t in texts], list(range(len(texts))))
    back = I.restore(got["output"], got["form"])
    for i, t in enumerate(texts):
        assert (got["n"][i], got["form"][i], got["prefix_chars"][i], got["middle_chars"][i], bytes(got["output"][i]).decode()) == by_hand(i, t)
        assert bytes(back[i]).decode() == t
    assert {"plain", "psm", "spm"} == set(got["form"])


def test_odd_rows(spark):
    df = odd_documents(spark)
    compare(df, [(r.doc_id, r.text) for r in df.collect()])


def test_long_texts(spark):
    rows = [(i, ("é word, " * 400_000 if i % 2 else "x" * 3_000_000) + str(i)) for i in range(4)]
    compare(documents(spark, [(i, t, "a") for i, t in rows]), rows)


def test_nothing(spark):
    assert I.digest(I.transform(documents(spark, []))).count() == 0
