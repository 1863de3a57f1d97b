"""The registered query of each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakewright.session import scratch_path

from . import (backoff, bitplanes, chunk_bpe, fingerprints, mixing, orchard, pivots, prefix_trie, rules, simhash, substrings, token_counts,
               toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(table(spark, folder, "documents"))


@query
def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without windows of 13 words that an earlier one has."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs, 13).select(
        "doc_id", "n_words", "n_removed", substrings.digest("kept").alias("kept_sha256"))


ORACLE_SQL["op7_substrings"] = r"""
with words as (
    select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
windows as (
    select doc_id, i, array_to_string(w[i:i + 12], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from words)),
firsts as (select s, min(doc_id) as first from windows group by s),
gone as (
    select distinct doc_id, p
    from (select doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (s) where doc_id > first)),
positions as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from words),
kept as (
    select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t
    from positions anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (doc_id)
"""


@query
def op9_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under single words and under the automaton of word pairs."""
    return backoff.lm_scores(table(spark, folder, "documents"))


@query
def op1_bitplanes(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written as bit planes and read back."""
    path = scratch_path(spark, "ids")
    bitplanes.write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return bitplanes.read_ids(spark, path, checksums=True)


@query
def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprints.neighbour_prints(table(spark, folder, "documents"))


@query
def op4_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by shared chunks, and the text decoded from them, as digests."""
    return chunk_bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@query
def op3_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    return rules.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 largest inner products of every fiftieth vector."""
    return pivots.top_inner_products(table(spark, folder, "embeddings"))


ORACLE_SQL["op6_pivots"] = """
with usable as (
    select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
queries as (select distinct on (vec_id) vec_id as query_id, v as q from usable where vec_id % 50 = 0),
scored as (
    select query_id, vec_id, cast(list_inner_product([cast(x as double) for x in q], [cast(x as double) for x in v]) as bigint) as score
    from queries join usable on query_id <> vec_id and len(q) = len(v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored)
select query_id, cast(n as integer) as rank, vec_id, score from ranked where n <= 5
"""


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often, in which epochs and where every document is used."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    counted = docs.select("doc_id", "source", mixing.n_tokens("text").alias("n_tokens"), "text")
    return mixing.mixed(counted).drop("text")


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


# crc32 by its bits: each byte of the number, then eight shifts.
ORACLE_SQL["op11_prefix_trie"] = r"""
with turns as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p,
           struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as x
    from conversations where conv_id is not null),
own as (select conv_id, list(x order by p) as a from turns group by conv_id),
headed as (
    select conv_id, a, xor(list_reduce(
        list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(conv_id::varchar, '')]),
        lambda s, b: list_reduce(list_prepend(xor(s, b), [0::bigint for i in range(8)]),
                                 lambda z, i: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295) % 4 as h
    from own),
rebuilt as (
    select c.conv_id, coalesce(b.a[1:c.h], []) || c.a[c.h + 1:] as a
    from headed c left join own b on b.conv_id = c.conv_id - ((c.conv_id % 20) + 20) % 20),
members as (select conv_id, d, a[1:d] as k, len(a) = d as ends from rebuilt, lateral (select unnest(range(0, len(a) + 1)) as d)),
nodes as (
    select d, k, min(conv_id) as c, count(*) as n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as sha,
           case when d = 0 then 0 else len([w for w in string_split_regex(k[d].t, '[\x20\x09-\x0D]+') if w <> '']) end as words
    from members group by d, k),
numbered as (select *, row_number() over () as id from nodes),
linked as (select n.*, p.id as parent, p.c as parent_c from numbered n left join numbered p on p.d = n.d - 1 and p.k = n.k[1:n.d - 1]),
kids as (select parent, count(*) as n from linked where parent is not null group by parent),
closed as (
    select t.id as top, x.id, x.n, x.words, coalesce(kids.n, 0) = 0 as leaf
    from linked t join linked x on x.d >= t.d and x.k[1:t.d] = t.k left join kids on kids.parent = x.id)
select c as conv_id, d as depth, parent_c as parent_conv_id, l.n as n_convs, coalesce(kids.n, 0) as n_children,
       cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha as ends_sha256
from linked l left join kids on kids.parent = l.id
join (select top, count(*) filter (leaf) as n_leaves, sum((n - 1) * words) as saved from closed group by top) s on s.top = l.id
"""


@query
def op12_orchard(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after three rounds."""
    return orchard.clustered(table(spark, folder, "embeddings"))


def _assign(n: int) -> str:
    """Round `n` of the clustering: every vector's nearest centroid, and the centroids after it."""
    return f"""
a{n} as (
    select r, any_value(v) as v, min(struct_pack(d := d, c := c)) as best
    from (select r, kept.v, c, cast(list_sum([(kept.v[i] - c{n}.v[i]) * (kept.v[i] - c{n}.v[i]) for i in range(1, 65)]) as bigint) as d from kept, c{n})
    group by r),
s{n} as (
    select c, j, cast(sum(x) as bigint) as s, count(*) as m
    from (select best.c as c, unnest(range(1, 65)) as j, unnest(v) as x from a{n}) group by c, j),
c{n + 1} as (
    select c, list((s - ((s % m) + m) % m) // m order by j) as v from s{n} group by c
    union all select c, v from c{n} where c not in (select c from s{n})),"""


ORACLE_SQL["op12_orchard"] = f"""
with kept as (
    select vec_id, row_number() over () as r, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v
    from embeddings
    where embedding is not null and len(embedding) = 64 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
c0 as (
    select cast(row_number() over (order by h, v) - 1 as integer) as c, v
    from (select sha256('1:' || vec_id) as h, v from kept where vec_id is not null order by h, v limit 16)),{_assign(0)}{_assign(1)}{_assign(2)}{_assign(3)}
sums as (select best.c as c, cast(sum(best.d) as bigint) as own from a3 group by 1)
select vec_id, best.c as cluster, best.d as distance, own as cluster_inertia, (select cast(sum(own) as bigint) from sums) as inertia,
       sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join kept using (r) join sums on sums.c = best.c join c3 on c3.c = best.c
"""


@query
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether they are too many."""
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
