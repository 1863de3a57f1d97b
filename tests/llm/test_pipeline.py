import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lakewright.llm import mixing
from lakewright.session import cut_lineage, release_scratch, scratch_mark

from .samples import words


def corpus():
    """Clean texts of four sources, junk, exact and near copies, and a passage that clean texts share."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, labels, copies = [], [], set()
    for i in range(240):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        junk = i % 4 == 3
        if junk:
            text = [w.upper() + "!!" for w in text]
        elif i % 10 == 0:
            text = text[:20] + passage + text[20:]
        rows.append((i, " ".join(text), "en", "big" if i % 6 else f"small{i % 12}", 0))
        labels.append((i, int(not junk), 0))
    for n, i in enumerate(range(0, 40, 4)):
        words_ = rows[i][1].split(" ")
        if n % 2:
            words_[-1] = "changed"
        rows.append((1000 + i, " ".join(words_), "en", "big", 0))
        copies.add(1000 + i)
    return rows, labels, copies


def expected_texts(rows, labels, copies, size=13):
    """What the first three stages leave, by brute force."""
    good = {i for i, quality, _ in labels if quality}
    kept = sorted((i, words(t)) for i, t, *_ in rows if i in good)
    firsts = {}
    for i, w in kept:
        for j in range(len(w) - size + 1):
            firsts.setdefault(tuple(w[j:j + size]), i)
    out = {}
    for i, w in kept:
        gone = {k for j in range(len(w) - size + 1) if firsts[tuple(w[j:j + size])] < i for k in range(j, j + size)}
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels, copies = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = expected_texts(rows, labels, copies)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    uses = [sum(r.doc_id == i for r in found) for i in texts]
    assert min(uses) == 1 and max(uses) == 2


def test_stages_take_documents_and_return_documents(spark, tmp_path):
    rows, labels, _ = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(1, None, None, None, None), (None, "", "en", "a", 0), *rows[:30]]
    for docs in (spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, str(tmp_path))
            assert left.columns == docs.columns, name
            assert left.count() >= (docs.count() > 0)
    assert len(corpus_pipeline.STAGES) == 5


def test_last_stage_hands_out_the_ids(spark, tmp_path):
    rows, _, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.encoded(spark, docs, str(tmp_path)).collect()}
    assert found == {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in rows}


def test_mixture_is_written_in_its_order(spark, tmp_path):
    rows, _, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    written = cut_lineage(corpus_pipeline.mixture(spark, docs, str(tmp_path)), "mixture")
    found = [r.doc_id for path in sorted(written.inputFiles()) for r in spark.read.parquet(path).collect()]
    places = {}
    for r in mixing.mixed(docs).select("doc_id", "position").collect():
        places.setdefault(r.position, []).append(r.doc_id)
    at = 0
    for position in sorted(places):
        own = places[position]
        assert sorted(found[at:at + len(own)]) == sorted(own)
        at += len(own)
    assert at == len(found) > len(rows)


#: Names that the operators use for columns of their own.
INNER = ("block epoch position uses use row s of b n tie passes rank blocks before all n_words n_removed kept _kind _share _doc _docs _hashes "
         "doc body node fp first root component_id hashes k at share ca cb c0 c1 own_ids ids score label").split()


def test_extra_columns_of_any_name_come_through(spark, tmp_path):
    rows, labels, _ = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INNER)
    docs = spark.createDataFrame([(*r, *(f"{c} of {r[0]}" for c in INNER)) for r in rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = cut_lineage(stage(spark, docs, str(tmp_path)), name)
        assert found.columns == docs.columns, name
        kept = found.collect()
        assert kept and all(r[c] == f"{c} of {r.doc_id}" for r in kept for c in INNER), name
    assert len(corpus_pipeline.encoded(spark, docs, str(tmp_path)).collect()) == len(rows)


def test_inner_tables_go_when_the_next_stage_begins(spark, tmp_path):
    rows, labels, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    start = scratch_mark(spark)
    first = cut_lineage(corpus_pipeline.near_copies(spark, docs, str(tmp_path)), "first")
    lazy = corpus_pipeline.repeats(spark, first, str(tmp_path))
    mark = scratch_mark(spark)
    assert corpus_pipeline.mixture(spark, cut_lineage(lazy, "second"), str(tmp_path)).count() > 0
    assert scratch_mark(spark) >= mark and first.count() > 0
    release_scratch(spark, start, keep=first)
    assert first.count() > 0 and scratch_mark(spark) <= start + 1
