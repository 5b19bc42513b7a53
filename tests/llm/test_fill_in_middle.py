from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lapidary.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", "a b", " a  b ", "Ünï 日本 𝕏 x\n", "\x0b\x0c\r\n", "a b c d e f g h i j k l m n o p " * 40, "has <P> in it and more words", "<M>", "x\xa0y z", "word " * 3000]


def _want(doc, text):
    text = text or ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    h = sha(f"42:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc, n, form, len(p), len(m), sha(out), sha(text))


def test_every_document_against_the_definition(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(TEXTS)) for i in range(400)] + [(i, TEXTS[5]) for i in range(1000, 4000)] + [(None, "a b"), (7, "a b c"), (7, "a b c"), (2**53 + 1, "x y")]
    docs = spark.createDataFrame([(*r, "p", "q") for r in rows], "doc_id long, text string, key string, form string")
    found = sorted(map(tuple, fim.digests(docs).collect()), key=str)
    assert found == sorted((_want(*r) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}


def test_texts_of_the_forms(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y z") for i in range(200)], "doc_id long, text string")
    found = fim.fill_in_middle(docs).collect()
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    for r in found:
        assert fim.restored(r.form, r.output) == f"w{r.doc_id} x y z"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(docs).collect() == []


def test_each_text_has_one_group_and_frequent_ones_several(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(50)] + [(50, None), (51, ""), (52, "other")], "doc_id long, text string")
    found = {r.text: sorted(x.id for x in r.ids) for r in fim.text_groups(docs).collect()}
    assert found == {"same words here": list(range(50)), "": [50, 51], "other": [52]}
    many = spark.createDataFrame([(7, "hot")] * 5000 + [(i, f"t{i}") for i in range(5000)], "doc_id long, text string")
    groups = [len(r.ids) for r in fim.text_groups(many).where("text = 'hot'").collect()]
    assert sum(groups) == 5000 and len(groups) > 3 and max(groups) < 1000


@pytest.mark.parametrize("seed", range(20))
def test_elias_fano_selects_every_number(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.integers(1, 5000))
    ends = np.sort(rng.integers(0, most + 1, int(rng.integers(1, 400)))).astype(np.int64)
    ef = fim.EliasFano.of(ends, most)
    ranks = ef.ranks()
    assert [ef.select(i, ranks) for i in range(len(ends))] == ends.tolist()
    assert len(ef.low) + len(ef.high) <= len(ends) * (2 + max(0, np.log2(most / len(ends)))) / 8 + most // 8 // max(1, most // len(ends)) + 3


def test_token_ends_are_in_code_points():
    texts = [t or "" for t in TEXTS]
    for (ends, n), t in zip(fim.token_ends(pa.array(texts)), texts, strict=True):
        assert n == len(t)
        assert ends.tolist() == [m.end() for m in TOKEN.finditer(t)]
