import hashlib

import pytest

from lakewright.llm import fingerprints

from .samples import documents, odd_documents


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_edits_and_neighbours(spark, parts):
    rows = [r for r in odd_documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    texts = [r[1] or "" for r in sorted(rows, key=lambda r: -r[0])]
    ids = sorted((r[0] for r in rows), reverse=True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r.doc_id: r for r in fingerprints.neighbour_prints(documents(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(found) == sorted(ids)
    prints = {}
    for i, (doc, text) in enumerate(zip(ids, texts)):
        following, r = texts[(i + 1) % len(texts)], found[doc]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, theirs = (fingerprints.prints([t.encode()])[0] for t in (text, changed))
        assert (fingerprints.parsed(r.fingerprint), fingerprints.parsed(r.edited_fingerprint)) == (own, theirs)
        assert r.near_edited == fingerprints.containment(own, theirs)
        assert r.near_next == fingerprints.containment(own, fingerprints.prints([following.encode()])[0])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint


def test_odd_ids_repeats_and_empty_tables(spark):
    assert fingerprints.neighbour_prints(documents(spark)).count() == len(odd_documents())
    assert fingerprints.neighbour_prints(documents(spark, [])).collect() == []
    only = fingerprints.neighbour_prints(documents(spark, [(1, "just one text " * 20, None, None, None, None)])).collect()
    assert len(only) == 1 and only[0].near_next == 1.0


def test_containment():
    assert fingerprints.containment({}, {}) == 1 and fingerprints.containment({}, {1: 2}) == 0
    assert fingerprints.containment({1: 30, 2: 10}, {1: 30, 3: 5}) == 0.75
    assert fingerprints.containment({1: 60}, {1: 30}) == 0.5
