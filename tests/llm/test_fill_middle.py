import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import fill_middle as fm

TEXTS = {
    "ascii": "plain words " * 9000,
    "two bytes": "éàü" * 30000,
    "mixed": "aé中\U0001f600 " * 12000,
    "rare": ("x" * 500 + "é") * 400,
    "empty": "",
}


@pytest.mark.parametrize("name", TEXTS)
def test_offsets_equal_prefix_lengths(name):
    text = TEXTS[name]
    found = fm.BoundarySet(np.frombuffer(text.encode(), np.uint8))
    assert len(found) == len(text)
    places = sorted({0, len(text), len(text) // 2, len(text) // 3, max(0, len(text) - 1), min(len(text), 65537)})
    assert [found.offset(p) for p in places] == [len(text[:p].encode()) for p in places]
    with pytest.raises(IndexError):
        found.offset(len(text) + 1)


def test_every_kind_of_container_selects_its_members():
    rng = np.random.default_rng(1)
    flags = {
        fm.RunContainer: np.repeat(rng.random(60) < 0.5, 1000),
        fm.ArrayContainer: rng.random(60000) < 0.02,
        fm.BitmapContainer: rng.random(60000) < 0.5,
    }
    for kind, marks in flags.items():
        chosen = fm.container(marks)
        assert type(chosen) is kind
        members = np.flatnonzero(marks)
        assert [chosen.select(i) for i in range(len(members))][:: 1 if kind is not fm.BitmapContainer else 97] == members[
            :: 1 if kind is not fm.BitmapContainer else 97
        ].tolist()
    sizes = {type(fm.container(m)): fm.container(m).nbytes() for m in flags.values()}
    assert sizes[fm.RunContainer] < 400 and sizes[fm.BitmapContainer] < 9000


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 10**6))
def test_one_text_round_trips(text, doc_id):
    text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, form, first, middle, output = fm.rearrange(text.encode(), fm.draws(doc_id, "1:"), fm.FillMiddleParams())
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
    assert n == len(text) and form == ("plain" if plain else "spm" if h4 % 100 < 20 else "psm")
    expected = {
        "plain": text,
        "psm": "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b],
        "spm": "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b],
    }[form]
    assert output.decode() == expected
    assert (first, middle) == ((None, None) if plain else (a, b - a))


def test_awkward_rows(docs, rows, spark):
    traps = ["<P>", "a<S>b", "x<M>", "<", "<<S", "P>S>M>", "<P", None, "", "\x00é", "é" * 70000]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(traps)], "doc_id long, text string")
    for table in (docs, extra):
        out = fm.transform(table)
        assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        assert out.count() == table.count()
        back = out.select("doc_id", fm.restored().alias("text"))
        given_texts = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        assert back.exceptAll(given_texts).count() == 0
        assert given_texts.exceptAll(back).count() == 0
    forms = {r.form for r in fm.transform(extra.where("doc_id < 1003")).collect()}
    assert forms == {"plain"}


def test_no_rows_and_both_forms(docs, no_docs):
    assert fm.described(fm.transform(no_docs)).collect() == []
    forms = {r["form"]: r["count"] for r in fm.transform(docs).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm", "spm"} and forms["psm"] > forms["spm"]
