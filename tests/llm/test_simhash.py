import random

import numpy as np
import pytest
import xxhash

from lakewright.llm import simhash
from lakewright.llm.components import connected_components

from .samples import documents, lines, odd_documents, words


def fingerprint(text, size=3):
    w = words(text, lower=True)
    shingles = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, radius):
    """Component number of each print, by comparing all with all."""
    number = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and number[i] != number[j]:
                old, new = number[i], number[j]
                number = [new if n == old else n for n in number]
    return number


def test_equals_brute_force(spark):
    rows = odd_documents()
    prints = [fingerprint(r[1]) for r in rows]
    number = groups(prints, 3)
    least = {n: min((r[0] for r, m in zip(rows, number) if m == n and r[0] is not None), default=None) for n in set(number)}
    expected = sorted(((r[0], f"{p:016x}", least[n]) for r, p, n in zip(rows, prints, number)), key=repr)
    assert lines(simhash.simhash_groups(documents(spark)).collect(), "doc_id", "fingerprint", "component_id") == expected


def nodes(spark, prints):
    return spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) * 2 for p in prints], "fp long, node long")


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
@pytest.mark.parametrize("piece", [16_384, 50])
def test_links_span_the_components(spark, monkeypatch, radius, piece):
    """Clusters of near prints, random ones and chains; buckets larger than a piece too."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    prints = set(rng.integers(0, 2**64, 80, dtype=np.uint64).tolist()) | {0, 2**64 - 1}
    for c in centres.tolist():
        for _ in range(60):
            c ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 6)))
            prints.add(c)
    prints = sorted(prints)
    number = groups(prints, radius)
    frame = nodes(spark, prints)
    found = simhash.links(frame, radius).collect()
    place = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    joined = np.arange(len(prints))
    for a, b in found:
        assert number[place[a]] == number[place[b]]
    simhash.join(joined, np.array([place[r.a] for r in found], int), np.array([place[r.b] for r in found], int))
    assert len(set(joined.tolist())) == len(set(number))


def test_bucket_gives_a_forest_not_all_pairs(spark):
    base = 0xABCDEF0123456789
    prints = [base ^ (1 << i) for i in range(64)] + [base]
    frame = nodes(spark, prints)
    assert simhash.links(frame, 3).count() <= len(simhash.block_masks(6, 3)) * len(prints)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(41) if i} | {i: 100 for i in range(101, 160)}


def test_stage_keeps_one_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    found = simhash.similar_groups(docs).collect()
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == {r.component_id for r in found if r.doc_id is not None}
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(spark):
    assert simhash.simhash_groups(documents(spark, [])).collect() == []
    assert simhash.drop_near_copies(documents(spark, [])).collect() == []


def test_similar_texts_are_found_and_others_stay(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, near, far = [], [], []
    for i in range(80):
        own = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((10 * i, " ".join(own), None, None, None, None))
        changed = list(own)
        for at in rng.sample(range(300), 4 if i % 2 else 40):
            changed[at] = "changed"
        rows.append((10 * i + 1, " ".join(changed), None, None, None, None))
        a, b = ({tuple(w[j:j + 5]) for j in range(296)} for w in (own, changed))
        (near if len(a & b) / len(a | b) >= 0.85 else far).append(10 * i)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows)).collect()}
    assert sum(found[i + 1] == i for i in near) >= 0.9 * len(near)
    assert all(found[i + 1] == i + 1 for i in far) and all(found[i] == i for i in near + far)


def edited_pairs(pairs: int, seed: int = 5):
    """Texts of 40, 300 and 1,000 words, each with an edited one whose shingles are similar by 0.7 to 0.95; and the similarities."""
    rng = random.Random(seed)
    rows, similarity = [], {}
    for i in range(pairs):
        n = (40, 300, 1000)[i % 3]
        own = [f"w{rng.randrange(30_000)}" for _ in range(n)]
        wanted = 0.7 + 0.25 * i / pairs
        changed, likeness, places = list(own), 1.0, iter(rng.sample(range(n), n))
        a = {tuple(own[j:j + 5]) for j in range(n - 4)}
        while likeness > wanted:
            # A word at the end is in fewer shingles.
            at = next(places) if n > 40 else len([w for w in changed if w.startswith("e")])
            changed[at] = f"e{rng.randrange(10**9)}"
            b = {tuple(changed[j:j + 5]) for j in range(n - 4)}
            before, likeness = likeness, len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(own), None, None, None, None), (2 * i + 1, " ".join(changed), None, None, None, None)]
        similarity[2 * i] = len(a & b), len(a | b)
    return rows, similarity


def test_every_pair_is_decided_by_its_shingles(spark):
    rows, similarity = edited_pairs(240)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows)).collect()}
    wrong = [i for i, (shared, all_) in similarity.items() if (found[i + 1] == i) != (10 * shared >= 8 * all_)]
    assert not wrong and sum(0.75 <= s / a <= 0.9 for s, a in similarity.values()) > 100


def test_groups_equal_brute_force(spark):
    """Copies of copies, short, empty and equal texts, texts of shared passages, and a group without a middle."""
    rng = random.Random(8)
    texts = [None, "", " ", "one two", "One  two", "one two three", "a b c d e", "A b c d e", *(r[1] for r in odd_documents())]
    passages = [[f"p{rng.randrange(900)}" for _ in range(rng.randint(5, 30))] for _ in range(12)]
    texts += [" ".join(w for p in rng.sample(passages, rng.randint(1, 5)) for w in p) for _ in range(120)]
    for _ in range(4):
        own = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(25):
            own = list(own)
            for at in rng.sample(range(150), rng.randint(1, 4)):
                own[at] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = words(t, lower=True)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    number = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if number[i] != number[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = max(number[i], number[j]), min(number[i], number[j])
                number = [new if n == old else n for n in number]
    rows = [(i, t, None, None, None, None) for i, t in enumerate(texts)]
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows)).collect()}
    assert found == dict(enumerate(number))


def test_stage_gets_its_links_from_the_fingerprints(spark, monkeypatch):
    """Texts within three bits meet by their fingerprints, and are decided by their shingles."""
    rng = random.Random(12)
    rows = []
    for i in range(0, 60, 2):
        own = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(i, " ".join(own), None, None, None, None), (i + 1, " ".join([*own[:-1], "changed"]), None, None, None, None)]
    asked, compared = [], simhash.links

    def seen(prints, *args):
        asked.append({r.node: r.fp for r in prints.collect()})
        found = compared(prints, *args)
        asked.append([(r.a, r.b) for r in found.collect()])
        return found

    monkeypatch.setattr(simhash, "links", seen)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows)).collect()}
    prints, pairs = asked
    wanted = {simhash._fingerprint(r[1].encode(), 5)[0] for r in rows}
    assert {fp % 2**64 for fp in prints.values()} == wanted
    assert pairs and all((prints[a] ^ prints[b]).bit_count() <= 3 or a == b for a, b in pairs)
    assert found == {r[0]: r[0] - r[0] % 2 for r in rows}
