import random

import numpy as np
import pytest

from schemaloom.llm import licenses

FILLER = "alpha beta gamma delta epsilon zeta eta theta".split()


def brute(text, coverage):
    """Templates whose words a stretch of the text holds in order, by a full alignment."""
    words = [m.group().lower() for m in licenses.WORD.finditer(text)]
    index = licenses.Index(licenses.TEMPLATES)
    ids = [index.number.get(w, 0) for w in words]
    out = set()
    for t, template in enumerate(index.words):
        matched = licenses.align(template, ids, 0, len(template) + len(ids))[0] if ids else 0
        if matched >= coverage * len(template):
            out.add(index.names[t])
    return out


@pytest.fixture(scope="module")
def texts():
    pick, out = random.Random(2), ["", None, "no license here", "licensed"]
    for text in licenses.TEMPLATES.values():
        words = text.split()
        for drop in (0, 1):
            own = list(words)
            for _ in range(drop * (len(own) // 12)):
                own[pick.randrange(len(own))] = pick.choice(FILLER)
            before, after = ([pick.choice(FILLER) for _ in range(pick.randrange(60))] for _ in "ab")
            out.append(" ".join(before) + ". \n" + " ".join(own).upper() + ". é " + " ".join(after))
    return out


def test_scan_equals_full_alignment(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.id, set()).add(r.license)
        words = licenses.words_of(texts[r.id][r.start : r.end])
        assert r.coverage >= licenses.COVERAGE and r.matched <= len(words)
    for i, text in enumerate(texts):
        assert got.get(i, set()) == brute(text or "", licenses.COVERAGE), text


def test_every_place_is_reported(spark):
    notice = "Released under the MIT License."
    text = f"{notice} {notice} x y z {notice.replace('the', 'THE')}"
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [text[r.start : r.end] for r in rows] == [notice[:-1], notice[:-1], notice.replace("the", "THE")[:-1]]
    assert all((r.license, r.coverage) == ("MIT-notice", 1.0) for r in rows)


def test_odd_rows(docs, no_docs):
    rows = licenses.scan(docs).collect()
    assert [(r.id, r.license) for r in rows] == [(None, "MIT-notice")]
    assert licenses.scan(no_docs).count() == 0


def test_shared_words_share_a_fingerprint():
    pick = random.Random(4)
    for _ in range(200):
        shared = [pick.randrange(1, 9) for _ in range(licenses.K + licenses.W - 1)]
        one, other = ([pick.randrange(1, 9) for _ in range(6)] + shared + [pick.randrange(1, 9) for _ in range(5)] for _ in "ab")
        a, b = (licenses._runs(np.array(x)) for x in (one, other))
        assert set(a[licenses.winnowed(a)]) & set(b[licenses.winnowed(b)])
