import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakewright.llm import bitplanes, chunk_bpe
from lakewright.llm.chunking import Sizes, chunk_ends
from lakewright.llm.encoding import PieceIds, pieces

from .samples import documents, lines, odd_documents

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("ids", [[], [0, 0], [1, 5, 49407], [2**32 - 1, 0, 7], list(range(300))])
def test_planes_round_trip(bits, ids):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(bitplanes.from_planes(bitplanes.to_planes(ids, bits), len(ids), bits), ids)


@pytest.mark.parametrize("bits", [True, False])
def test_files_hold_the_library_ids_in_order(spark, tmp_path, bits):
    path, rows = str(tmp_path / "ids"), odd_documents()
    bitplanes.write_ids(documents(spark), path, WORD, 1, bits, chunk=64, segment=500)
    found = bitplanes.read_ids(spark, path, bits).collect()
    library = Tokenizer.from_file(WORD)
    expected = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    ours = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    assert sorted(ours, key=repr) == sorted(expected, key=repr)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))
    sums = bitplanes.read_ids(spark, path, bits, checksums=True).collect()
    assert lines(sums, "doc_id", "ids_crc32") == sorted(((r.doc_id, zlib.crc32(r.ids)) for r in found), key=repr)


def test_no_documents_no_ids(spark, tmp_path):
    path = str(tmp_path / "ids")
    bitplanes.write_ids(documents(spark, []), path, WORD)
    assert bitplanes.read_ids(spark, path).collect() == []


def test_pieces_cover_the_text():
    for _, text, *_ in odd_documents():
        assert "".join(pieces(text or "")) == (text or "")


@pytest.mark.parametrize("sizes", [Sizes(32, 64, 128), Sizes(128, 512, 4096)])
def test_chunked_ids_equal_the_library(spark, sizes):
    rows = odd_documents()
    # Long texts that share passages without any space, and a special token across chunks.
    glued = "".join(f"{i:04x}é" for i in range(900))
    rows += [(2000 + i, "x" * i + glued + "<|endoftext|>" * i + glued, None, None, None, None) for i in range(6)]
    library = Tokenizer.from_file(BYTE)
    expected = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    found = chunk_bpe.encode_documents(documents(spark, rows), BYTE, sizes=sizes).collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=repr) == sorted(expected, key=repr)
    digests = chunk_bpe.encode_documents(documents(spark, rows), BYTE, keep_ids=False, sizes=sizes).collect()
    wanted = [(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(),
               hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, i in expected]
    assert lines(digests, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(wanted, key=repr)


def test_texts_of_shared_chunks_only(spark):
    text = " ".join(f"word{i}" for i in range(2000))
    found = chunk_bpe.encode_documents(documents(spark, [(i, text, None, None, None, None) for i in range(3)]), BYTE).collect()
    ids = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [ids] * 3


def test_encoding_nothing(spark):
    assert chunk_bpe.encode_documents(documents(spark, []), BYTE).collect() == []


def test_chunks_move_with_the_text():
    """Chunks behind an insertion stay the same."""
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    sizes = Sizes(32, 64, 256)
    plain, shifted = chunk_ends([text, b"inserted" + text], sizes)
    chunks = [{t[s:e] for s, e in zip([0, *ends], ends)} for t, ends in ((text, plain), (b"inserted" + text, shifted))]
    assert len(chunks[0] & chunks[1]) > 0.95 * len(chunks[0])
    assert plain[-1] == len(text) and max(np.diff([0, *plain])) <= 256 and min(np.diff([0, *plain])[:-1]) >= 32
    assert chunk_ends([text[:5000], text], sizes)[0] == chunk_ends([text[:5000]], sizes)[0]


def test_ids_digests_and_text_come_together(spark):
    rows = odd_documents()
    found = chunk_bpe.encode_documents(documents(spark, rows), BYTE, digests=True, decoded=True)
    assert found.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"]
    found = found.collect()
    for r in found:
        assert r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert sorted((repr(r.doc_id), r.decoded) for r in found) == sorted((repr(r[0]), r[1] or "") for r in rows)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_without_their_marks_give_the_same_ids(path):
    """Also where pieces are forgotten again, and where case or composition change their length."""
    odd = ["don't,", "x',", "é,.", "é,.", "İ,", "ﬁ!", "<|endoftext|>", "a<|endoftext|>.", "<|endoftext|", "a\xa0b,", "　x,",
           "A'S.", "we'll,", "1,000.", "日本,", "x\x85", "ÿ!", "ß?", "ǅ,", "Å,", "Å,", "(hi)", "--", "a…,", "O'Brien's,", " ", "\n", ""]
    rng = np.random.default_rng(3)
    texts = [sep.join(rng.choice(odd, rng.integers(0, 9))) for sep in (" ", "", "  ", "\n") for _ in range(300)]
    known, library = PieceIds(path, path == WORD, limit=60), Tokenizer.from_file(path)
    for i in range(0, len(texts), 50):
        bodies = [t.encode() for t in texts[i:i + 50]]
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts[i:i + 50]]
        ids, lengths = known.encode(bodies)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == expected
        assert known.counts(bodies).tolist() == lengths.tolist()


def test_few_texts_or_chunks_that_come_once_count_as_repeated():
    import numpy as np

    from lakewright.llm import chunk_bpe, sketch
    n = 1 << 19
    hashes = np.random.default_rng(3).integers(0, 2**64, n, dtype=np.uint64)
    width = sketch.cells_for(n, chunk_bpe.CELLS)
    rows = [np.packbits(np.bincount(sketch.cells(hashes, row, width), minlength=width) > 1, bitorder="little") for row in range(2)]
    assert sketch.Repeated(width, rows).estimate(hashes).mean() < 0.005
