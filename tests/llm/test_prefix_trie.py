import hashlib
import random

import pytest

from lakewright.llm import prefix_trie

from .samples import crc, words

SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth string, `u` int"


def odd_conversations() -> list[tuple]:
    rng = random.Random(5)
    texts = ["", None, "one", "two words", " é  x\n", "a b c d"]
    rows = []
    for conv in [*range(60), 400, 401, 10**15]:
        turns = [(t, rng.choice(["user", None, ""]), rng.choice(texts)) for t in range(rng.randint(1, 5))]
        if conv % 3:  # a first turn that most share
            turns[0] = (0, "user", "hello there all")
        rows += [(conv, *t) for t in turns]
    # Copies, a long one and one that goes on like it, null and repeated turns, no id.
    for conv in range(100, 130):
        rows += [(conv, t, "user", f"copy {t}") for t in range(4)]
    rows += [(c, t, "user", f"long {t}") for c, n in ((140, 70), (141, 45)) for t in range(n)]
    rows += [(c, 0, "user", "base is absent") for c in range(201, 220)]
    rows += [(150, None, "user", "null turn"), (150, 3, "user", "x"), (150, 3, "user", "x"), (None, 0, "user", "nobody")]
    rows += [(r[0], *r[1:]) for r in rows[:2]]
    return [(*r, 7, "depth", 1) for r in rows]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    return {c: own.get(c - c % 20, [])[:crc(c) % 4] + ts[crc(c) % 4:] for c, ts in own.items()}


def trie(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) or 1
        saved[k] = sum(saved[b] for b in below) + (len(members[k]) - 1) * (len(words(k[-1][1])) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


@pytest.mark.parametrize("fragment", [1, 20, 1 << 16])
def test_trie_equals_brute_force(spark, fragment):
    rows = odd_conversations()
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), fragment=fragment)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    expected = trie(rebuilt(rows))
    assert any(len(t) == 0 for t in rebuilt(rows).values())
    assert sorted(map(tuple, found.collect())) == expected


def test_plain_conversations(spark):
    rows = [r for r in odd_conversations() if r[0] is not None and r[0] < 60]
    own = {}
    for conv, turn, role, text, *_ in rows:
        own.setdefault(conv, []).append((turn, role or "", text or ""))
    expected = trie({c: [t[1:] for t in sorted(ts)] for c, ts in own.items()})
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, prefix_trie.trie_nodes(*prefix_trie.plain(turns), fragment=20).collect())) == expected


def test_no_conversations_and_turnless_ones(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "", 1)], SCHEMA)).collect() == []
    # Its base is absent, and it has no more turns than it would borrow.
    alone = next(c for c in range(1, 20) if crc(c) % 4 == 3)
    found = prefix_trie.conversation_trie(spark.createDataFrame([(alone, 0, "u", "x", 1, "", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_equal_turns_have_one_order(spark):
    rows = [(20, 1, "user", f"text {i}", 1, "", 1) for i in range(8)] + [(20, None, "b", "x", 1, "", 1), (20, None, "a", "y", 1, "", 1)]
    a, b = (prefix_trie.conversation_trie(spark.createDataFrame(r, SCHEMA).repartition(3)) for r in (rows, rows[::-1]))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 11


def test_ids_of_many_copies_pass_in_blocks(spark):
    n = 2 * prefix_trie.IDS + 5
    ends = spark.range(n, 0, -1).selectExpr("id as conv", "1L as u", "2L as v", "3L as len").repartition(7)
    row, = prefix_trie.end_digests(ends).collect()
    assert (row.n, row.conv) == (n, 1)
    assert row.sha == hashlib.sha256(",".join(map(str, range(1, n + 1))).encode()).hexdigest()
