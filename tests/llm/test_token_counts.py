import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakewright.llm import token_counts
from lakewright.llm.token_counts import Cuts

from .samples import documents, odd_documents

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_spans_cover_the_text_and_overlap():
    cuts = Cuts(100, 10)
    for n in (1, 10, 100, 110, 111, 210, 211, 1000):
        spans = cuts.spans(n)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b < n for b, _ in spans) and all(e == b + 10 for (_, e), (b, _) in zip(spans, spans[1:]))
    wide = cuts
    for _ in range(8):
        assert wide.wider().chunk > wide.chunk and wide.wider().overlap > wide.overlap
        wide = wide.wider()


def test_splice_only_at_common_boundaries_of_equal_tokens():
    text = "alpha beta gamma delta epsilon zeta"
    whole, = token_counts.encode_chunks([(0, text)], WORD)
    library = Tokenizer.from_file(WORD)
    for p, n in zip(whole.places.tolist(), whole.before.tolist()):
        assert text[p] == " " and n == len(library.encode(text[:p], add_special_tokens=False).ids)
    left, right = token_counts.encode_chunks([(0, text[:28]), (13, text[13:])], WORD)
    found = token_counts.splice(left, right)
    assert found and found[0] + right.n_tokens - found[1] == whole.n_tokens
    # "mma" at the right's begin is no word of the left's.
    assert right.places[0] == 16 and right.hashes[0] not in left.hashes
    left, right = token_counts.encode_chunks([(0, "alpha beta"), (6, "beta")], WORD)
    assert token_counts.splice(left, right) is None


@pytest.mark.parametrize("cuts", [Cuts(), Cuts(64, 16), Cuts(40, 40), Cuts(300, 2)])
def test_counts_equal_the_library(spark, cuts):
    rows = odd_documents()
    texts = ["abc def. " * 3000, "日本語の文" * 400 + " end " + "日本" * 300, "y" * 5000 + " z", "<|endoftext|> a<|endoftext|>b" * 90, "don't! we'll " * 200,
             "é É ﬁ İ, é. " * 150, " " * 4000 + "x", "12 345,6 7" * 200, "́ ́a" * 200]
    rows += [(3000 + i, t, None, None, None, None) for i, t in enumerate(texts)]
    library = Tokenizer.from_file(WORD)
    expected = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    found = token_counts.token_counts(documents(spark, rows), WORD, limit=50, cuts=cuts)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((*e, e[2] > 50) for e in expected), key=repr)


def test_invalid_text_and_nothing(spark):
    bad = spark.createDataFrame([(1, b"a \xff\xfe b " * 100), (2, None)], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    found = {r.doc_id: r for r in token_counts.token_counts(bad, WORD, cuts=Cuts(64, 16)).collect()}
    text = (b"a \xff\xfe b " * 100).decode("utf-8", "replace")
    assert found[1].n_tokens == len(Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids)
    assert (found[1].n_bytes, found[2].n_bytes, found[2].n_tokens) == (700, 0, 0)
    assert token_counts.token_counts(documents(spark, []), WORD).collect() == []


def test_offsets_of_a_chunk_count_from_the_whole_text():
    made, = token_counts.encode_chunks([(500, "one two")], WORD)
    assert np.array_equal(made.places, [503]) and unpacked(made) == (2, [503], [1])


def unpacked(made):
    again = token_counts.unpack(made.n_tokens, made.pack())
    return again.n_tokens, again.places.tolist(), again.before.tolist()
