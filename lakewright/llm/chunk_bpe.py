"""BPE encoding by content-defined chunks: what documents share is encoded once, and the joins are repaired exactly.

A sketch of all texts' hashes tells which texts may occur more than once. Those
are brought together first, so each goes on once, and its ids are joined to its uses.
A sketch of all chunk digests tells which chunks may occur in more than one text.
Texts without such a chunk are encoded where they are read. Of the
others only the chunks' digests, each shared chunk's text once, and the ids
of what lies between them are moved.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lakewright.session import cut_lineage

from .chunking import Sizes, chunk_ends
from .common import gives_back, pack_ids, rows_by_size, texts, unpack_ids, unzstd, zstd
from .encoding import PieceIds, encoder, tokenizer
from .sketch import PARTIAL, cells_for, merged, partial_sketch

SIZES = Sizes(128, 512, 4096)
#: Chunk digests a task holds before it passes its sketch on.
HELD = 1 << 21
#: Digests that a task remembers as sent; beyond that it may send a chunk again.
SENT = 1 << 18
#: Pieces that a Python worker keeps the ids of, beside what the stages before left in it.
PIECES = 200_000
#: Cells of a sketch for every text or chunk: of those that come once fewer than one in two hundred counts as repeated, and is moved.
CELLS = 16
#: A visible ASCII character before a space, tab or line end: pre-tokens, and so tokens, end between them in any text.
_SURE = re.compile(rb"[\x21-\x7e](?=[ \t\n\r])")


@lru_cache(maxsize=4)
def spellings(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level tokenizer stands for."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    found = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        found[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return found


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(spellings(path).__getitem__, ids.tolist())).decode("utf-8", "replace")


def repaired(parts: list[np.ndarray], known: PieceIds) -> np.ndarray:
    """The ids of the joined texts of `parts`, each of which is the ids of its own text.

    At each join what lies between the last sure boundary on the left and
    the first one on the right is encoded anew. Both must fall between two
    of the ids at hand, so that what is kept agrees with an encoding of the
    whole; where a side has none, all of it is encoded anew, together with
    what follows.
    """
    spell = spellings(known.path)
    done: list[np.ndarray] = []
    left = parts[0]
    for right in parts[1:]:
        keep, tail = _from_last_boundary(left, spell)
        drop, head = _to_first_boundary(right, spell)
        middle, _ = known.encode([tail + head])
        done.append(left[:keep])
        # Without a boundary on the right the middle stays open for the next join.
        left = np.concatenate([middle, right[drop:]])
    return np.concatenate([*done, left])


def _from_last_boundary(ids: np.ndarray, spell: list[bytes]) -> tuple[int, bytes]:
    """How many ids stand before the last sure boundary, and the bytes behind it."""
    n = 32
    while True:
        own = [spell[i] for i in ids[-n:].tolist()]
        starts = np.cumsum([0, *map(len, own)])
        data = b"".join(own)
        at_token = {int(s): k for k, s in enumerate(starts)}
        for match in reversed(list(_SURE.finditer(data))):
            if match.end() in at_token:
                return max(0, len(ids) - n) + at_token[match.end()], data[match.end():]
        if n >= len(ids):
            return 0, data
        n *= 4


def _to_first_boundary(ids: np.ndarray, spell: list[bytes]) -> tuple[int, bytes]:
    """How many ids stand before the first sure boundary, and their bytes."""
    n = 32
    while True:
        own = [spell[i] for i in ids[:n].tolist()]
        starts = np.cumsum([0, *map(len, own)])
        data = b"".join(own)
        at_token = {int(s): k for k, s in enumerate(starts)}
        for match in _SURE.finditer(data):
            if match.end() in at_token:
                return at_token[match.end()], data[:match.end()]
        if n >= len(ids):
            return len(ids), data
        n *= 4


#: A text: the document's id, or two hashes of a text that may come more than once.
_KEY = "doc long, ca long, cb long"
_KINDS = f"kind int, row long, {_KEY}, seq int, digest binary, ids binary, body binary"
WHOLE, OWN, SHARED, CHUNK = range(4)


#: Digests of a text's ids and of the text decoded from them.
_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: list[np.ndarray], path: str) -> list[pa.Array]:
    raw = [i.astype("<u4").tobytes() for i in ids]
    return [pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
            pa.array([hashlib.sha256(decode(i, path).encode()).hexdigest() for i in ids], pa.string())]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True, key: str = "doc_id", text: str = "text",
                     sizes: Sizes = SIZES, digests: bool | None = None, decoded: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id and ids (binary, little-endian unsigned 32-bit), as the byte-level tokenizer at `path` gives.

    digests: n_tokens, ids_sha256 and decoded_sha256 (of the text decoded from the ids) as well; None for
    only where there are no ids, keep_ids=False. decoded: that text itself as well, in `decoded`.
    A null text counts as empty, and gives no ids; a null id stays null; repeated rows
    give repeated rows. Other columns are not read. Special tokens in a text
    count as such. A text that is no valid UTF-8 is encoded with replacement characters.
    """
    spark = docs.sparkSession
    rows, prepared, refs, n_bytes = _texts_once(texts(docs, key, text))
    width = cells_for(n_bytes // sizes.normal + 1, CELLS)

    def chunks_of(batch):
        bodies = [b.decode("utf-8", "replace").encode() for b in batch.column("body").to_pylist()]
        return bodies, chunk_ends(bodies, sizes, whole_characters=True)

    @gives_back
    def sketch_task(batches):
        held = []
        for batch in rows_by_size(prepared(batches), 1 << 20):
            held += [xxhash.xxh3_64_intdigest(body[s:e]) for body, ends in zip(*chunks_of(batch)) for s, e in zip([0, *ends], ends)]
            if len(held) >= HELD:
                yield partial_sketch(np.array(held, np.uint64), width)
                held = []
        if held:
            yield partial_sketch(np.array(held, np.uint64), width)

    repeated = spark.sparkContext.broadcast(merged(rows.mapInArrow(sketch_task, PARTIAL), width))
    digests_wanted = not keep_ids if digests is None else digests
    # Digests are made once for each text; ids travel packed, and are opened and decoded at the end.
    late = keep_ids or decoded
    made = ", own_ids binary" * late + f", {_DIGESTS}" * digests_wanted
    names = [x.split()[0] for x in made.split(", ")[1:]]
    known_digests = [n for n in names if n != "own_ids"]

    @gives_back
    def split_task(batches):
        from pyspark import TaskContext
        known, row, sent = encoder(path, False, PIECES), TaskContext.get().partitionId() << 32, set()
        for batch in rows_by_size(prepared(batches), 1 << 20):
            bodies, ends = chunks_of(batch)
            spans = [list(zip([0, *e], e)) for e in ends]
            digests = [xxhash.xxh3_64_intdigest(b[s:e]) for b, own in zip(bodies, spans) for s, e in own]
            shared, at = repeated.value.estimate(np.array(digests, np.uint64)).tolist(), 0
            whole, parts, chunks = [], [], {}  # (key, text); [row, key, seq, digest, text of its own]
            for doc, body, own in zip(_keys(batch), bodies, spans):
                marks, at = shared[at:at + len(own)], at + len(own)
                if not any(marks):
                    whole.append((doc, body))
                    continue
                row, open_from, seq = row + 1, 0, 0
                for (s, e), mark in zip(own, marks):
                    if mark:
                        if open_from < s:
                            parts.append((row, doc, seq, None, body[open_from:s]))
                        digest = xxhash.xxh3_128_digest(body[s:e])
                        if digest not in sent:
                            sent.add(digest)
                            chunks[digest] = body[s:e]
                        parts.append((row, doc, seq + 1, digest, None))
                        open_from, seq = e, seq + 2
                if open_from < len(body):
                    parts.append((row, doc, seq, None, body[open_from:]))
            if len(sent) > SENT:
                sent.clear()
            own_parts = [p for p in parts if p[3] is None]
            ids, lengths = known.encode([b for _, b in whole] + [p[4] for p in own_parts])
            ids = np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []
            n = len(whole)
            finished = _digests(ids[:n], path) if digests_wanted else []
            found = ([(WHOLE, None, *d, None, None, pack_ids(i) if late else None, None) for (d, _), i in zip(whole, ids)]
                     + [(OWN, r, *d, q, None, pack_ids(i), None) for (r, d, q, _, _), i in zip(own_parts, ids[n:])]
                     + [(SHARED, r, *d, q, g, None, None) for r, d, q, g, _ in parts if g is not None]
                     + [(CHUNK, None, None, None, None, None, g, None, b) for g, b in chunks.items()])
            kinds = (pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
            done = [pa.concat_arrays([f, pa.nulls(len(found) - n, f.type)]) for f in finished]
            yield pa.record_batch(columns + done, names=["kind", "row", "doc", "ca", "cb", "seq", "digest", "own_ids", "body", *known_digests])

    @gives_back
    def encode_task(batches):
        known = encoder(path, False, PIECES)
        for batch in rows_by_size(batches, 1 << 20):
            ids, lengths = known.encode(batch.column("body").to_pylist())
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            yield pa.record_batch({"digest": batch.column("digest"), "own_ids": pa.array(map(pack_ids, parts), pa.binary())})

    def joined_rows(keys, ids):
        columns = [pa.array(c, pa.int64()) for c in zip(*keys)]
        return pa.record_batch(columns + [pa.array(map(pack_ids, ids), pa.binary())] * late + (_digests(ids, path) if digests_wanted else []),
                               names=["doc", "ca", "cb", *names])

    @gives_back
    def join_task(batches):
        known, last, held, done = encoder(path, False, PIECES), None, [], []
        for batch in batches:
            for row, doc, ids in zip(batch.column("row").to_pylist(), _keys(batch), batch.column("own_ids").to_pylist()):
                if row != last:
                    if held:
                        done.append((last_doc, repaired(held, known)))
                    last, last_doc, held = row, doc, []
                held.append(unpack_ids(ids))
            if len(done) > 500:
                yield joined_rows(*zip(*done))
                done = []
        if held:
            done.append((last_doc, repaired(held, known)))
        if done:
            yield joined_rows(*zip(*done))

    @gives_back
    def open_task(batches):
        for batch in rows_by_size(batches, 1 << 20, "own_ids"):
            ids = [unpack_ids(i) for i in batch.column("own_ids").to_pylist()]
            columns = {"doc_id": batch.column("doc")}
            if keep_ids:
                columns["ids"] = pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
            columns |= {c: batch.column(c) for c in known_digests}
            if decoded:
                columns["decoded"] = pa.array([decode(i, path) for i in ids], pa.string())
            yield pa.record_batch(columns)

    kinds = _KINDS.replace("ids", "own_ids") + f", {_DIGESTS}" * digests_wanted
    split = cut_lineage(rows.mapInArrow(split_task, kinds), "chunks")
    shared = (split.where(F.col("kind") == CHUNK).groupBy("digest").agg(F.first("body").alias("body"))
              .mapInArrow(encode_task, "digest binary, own_ids binary"))
    part = ["row", "doc", "ca", "cb", "seq"]
    parts = split.where(F.col("kind") == SHARED).select(*part, "digest").join(shared, "digest").select(*part, "own_ids").unionByName(
        split.where(F.col("kind") == OWN).select(*part, "own_ids"))
    joined = parts.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(join_task, _KEY + made)
    whole = split.where(F.col("kind") == WHOLE)
    done = cut_lineage(joined.unionByName(whole.select("doc", "ca", "cb", *names)), "encoded")
    # A text of very many uses is one row here; adaptive execution splits its uses.
    uses = refs.join(done.where("ca is not null").drop("doc"), ["ca", "cb"])
    result = done.where("ca is null").unionByName(uses).select("doc", *names)
    if not late:
        return result.withColumnRenamed("doc", "doc_id")
    return result.mapInArrow(open_task, "doc_id long" + ", ids binary" * keep_ids + f", {_DIGESTS}" * digests_wanted + ", decoded string" * decoded)


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("doc", "ca", "cb"))))


def _texts_once(rows: DataFrame):
    """Rows `doc`, `ca`, `cb`, `body`, `packed`, for tasks that first pass them through the function beside them; uses of texts that may come again; bytes of all.

    The function leaves `doc` and `body` of texts that come once, and `ca`, `cb` and `body` of each of the others, once.
    """
    hashed = rows.select("doc", F.xxhash64("body").alias("ca"), F.xxhash64(F.lit(1), "body").alias("cb"), "body")
    n, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("body"))).first()
    width = cells_for(n, CELLS)

    @gives_back
    def sketch_task(batches):
        for batch in batches:
            yield partial_sketch(batch.column("ca").to_numpy().view(np.uint64), width)

    found = rows.sparkSession.sparkContext.broadcast(merged(hashed.select("ca").mapInArrow(sketch_task, PARTIAL), width))

    def repeated(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(found.value.estimate(batch.column("ca").to_numpy().view(np.uint64)))

    def prepared(batches):
        for batch in batches:
            own = batch.filter(pc.and_(pc.is_null(batch.column("packed")), pc.invert(repeated(batch))))
            none = pa.nulls(own.num_rows, pa.int64())
            yield pa.record_batch([own.column("doc"), none, none, own.column("body")], names=["doc", "ca", "cb", "body"])
            for part in rows_by_size([batch.filter(pc.is_valid(batch.column("packed")))], 1 << 18, "packed"):
                bodies = [unzstd(b, np.uint8).tobytes() for b in part.column("packed").to_pylist()]
                yield pa.record_batch([pa.nulls(part.num_rows, pa.int64()), part.column("ca"), part.column("cb"), pa.array(bodies, pa.binary())],
                                      names=["doc", "ca", "cb", "body"])

    @gives_back
    def again(batches):
        for batch in batches:
            own = batch.filter(repeated(batch))
            yield pa.record_batch([own.column("ca"), own.column("cb"), pa.array([zstd(b) for b in map(_bytes, own.column("body"))], pa.binary())],
                                  names=["ca", "cb", "packed"])

    def uses(batches):
        for batch in batches:
            yield batch.filter(repeated(batch))

    packed = hashed.select("ca", "cb", "body").mapInArrow(again, "ca long, cb long, packed binary")
    distinct = cut_lineage(packed.groupBy("ca", "cb").agg(F.first("packed").alias("packed")), "texts")
    return (hashed.unionByName(distinct, allowMissingColumns=True), prepared,
            hashed.select("doc", "ca", "cb").mapInArrow(uses, _KEY), n_bytes or 0)


def _bytes(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)
