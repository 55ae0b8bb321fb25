"""The query of each operator over its whole table, with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.clustering import cluster_vectors
from tablewise.llm.common import documents, table
from tablewise.llm.decontamination import find_overlaps
from tablewise.llm.filter_audit import audit_filters
from tablewise.llm.fingerprints import compare_with_edited, digest
from tablewise.llm.language import identify_languages, learn_languages
from tablewise.llm.ngram_join import ngram_join
from tablewise.llm.packing import pack
from tablewise.llm.pii import replace_pii
from tablewise.llm.pieces import encode_pieces
from tablewise.llm.quality import quality_rules
from tablewise.llm.suffix_dedup import remove_repeats
from tablewise.llm.token_files import token_digest
from tablewise.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _remainder(divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder), length=400).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


#: A key of the queries; a user passes a secret one
PII_KEY = b"key of the registered query"


@query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return replace_pii(documents(spark, folder), PII_KEY)


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(documents(spark, folder), model, ends=True, decode=True).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint) as n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(documents(spark, folder))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(documents(spark, folder), table(spark, folder, "labels"), train=_remainder(5) != 0)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder)).drop("row", "digest")


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0,
                special=True)


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = identify_languages(docs, learn_languages(docs.where(_remainder(4) != 2)))
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score",
                        "accepted")


@query
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_edited(documents(spark, folder)).select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        digest("fingerprint").alias("fingerprint"), digest("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited", "near_next")


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_digest(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), end_id=2, special=True)


@query
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = F.array_join("items", ",")
    return find_overlaps(documents(spark, folder), table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(items, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(documents(spark, folder), table(spark, folder, "labels"))


@query
def op13_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "embeddings"), k=16, rounds=3, dimensions=64).table()


#: Windows of 400 bytes as hexadecimal text; a window repeats if its hash does (64 bits)
ORACLES["op1_suffix_dedup"] = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, hash(substr(h, 2 * i + 1, 800)) as k
  from (select doc_id, h, unnest(range(0, length(h) // 2 - 399)) as i from d where length(h) >= 800)),
s as (select doc_id, i from w where k in (select k from w group by k having count(*) > 1)),
b as (select *, i > lag(i) over (partition by doc_id order by i) + 400 as fresh from s),
n as (select *, count(*) filter (where fresh) over (partition by doc_id order by i) as run from b),
r as (select doc_id, run, min(i) as a, max(i) + 400 as z from n group by doc_id, run),
p as (select r.*, h, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from r join d using (doc_id)),
k as (select doc_id, sum(z - a) as removed, count(*) as spans,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) as kept
  from p group by doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
  coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join k using (doc_id)"""

ORACLES["op4_ngram_join"] = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
g as (select doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, least(len(words), 1) + 1)),
    lambda i: array_to_string(words[i:i + 4], ' '))) as grams from w),
sizes as (select doc_id, len(grams) as n from g),
classes as (select doc_id, min(doc_id) over (partition by list_sort(grams)) as class from g where len(grams) > 0),
e as (select class, unnest(grams) as gram from classes join g on g.doc_id = class where classes.doc_id = class),
shared as (select x.class as a, y.class as b, count(*) as k from e x join e y on x.gram = y.gram and x.class < y.class
  group by 1, 2),
links as (select a, b from shared join sizes s on s.doc_id = a join sizes t on t.doc_id = b
  where 100 * k >= 75 * (s.n + t.n - k)),
either as (select a, b from links union all select b, a from links),
reach(a, b) as (select class, class from (select distinct class from classes)
  union select reach.a, either.b from reach join either on either.a = reach.b)
select sizes.doc_id, n as n_shingles, coalesce(root, sizes.doc_id) as component_id
from sizes left join classes using (doc_id) left join (select a, min(b) as root from reach group by a) on a = class"""

#: A line counts by the components of ``op4`` among the texts with a line that ten texts of the host share
ORACLES["op6_quality"] = """with t as (select doc_id, coalesce(text, '') as text, coalesce('=' || source, '') as host from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from t),
g as (select doc_id, i, gram, count(*) over (partition by doc_id, gram) as times from (select doc_id, i,
    array_to_string(words[i:i + 4], ' ') as gram from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w))),
repeated as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from g where times > 1) group by doc_id),
l as (select doc_id, host, text, line, regexp_extract_all(lower(line), '[^\\s]+') as words
  from (select *, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
twice as (select doc_id, count(*) - count(distinct line) as n from l group by doc_id),
n as (select doc_id, host, text, array_to_string(words, ' ') as line, len(words) as n from l),
shared as (select host, line from n group by host, line having count(distinct text) >= 10),
carriers as (select distinct host, line, text from n join shared using (host, line)),
carrying as (select min(doc_id) as doc_id, text from t where text in (select text from carriers) group by text),
components as (""" + ORACLES["op4_ngram_join"].replace("from documents", "from carrying") + """),
boilerplate as (select host, line from carriers join carrying using (text) join components using (doc_id)
  group by host, line having count(distinct component_id) >= 10),
gone as (select doc_id, sum(n)::bigint as n from n join boilerplate using (host, line) group by doc_id),
c as (select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(twice.n, 0) as n_dup_lines,
  coalesce(repeated.n, 0) as n_repeat_words, coalesce(gone.n, 0) as n_boilerplate_words
  from w left join twice using (doc_id) left join repeated using (doc_id) left join gone using (doc_id)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  n_words - n_boilerplate_words < 0.3::double * n_words as depleted from c)
select *, not base_failed and not depleted as kept from v"""

#: Windows of ten words, or of all words of a shorter item
ORACLES["op11_decontamination"] = """with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark),
bw as (select distinct item, k, array_to_string(words[i:i + k - 1], ' ') as w
  from (select item, words, least(len(words), 10) as k, unnest(range(1, len(words) - least(len(words), 10) + 2)) as i
    from b where len(words) > 0)),
dw as (select doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') as w
  from (select doc_id, words, k, unnest(range(1, len(words) - k + 2)) as i
    from d, (select distinct k from bw) where len(words) >= k)),
hits as (select doc_id, i, dw.k, item from dw join bw on dw.w = bw.w and dw.k = bw.k),
places as (select distinct doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, i, k from hits)),
n as (select doc_id, count(*) as n_hit from places group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)"""

ORACLES["op12_filter_audit"] = """with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
    min(doc_id) over (partition by text) as least from t),
m as (select part, list_filter([case when len(words) < 200 then 'A' end,
    case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' end,
    case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) then 'C' end,
    case when regexp_matches(text, '[#$%&*|]') then 'D' end, case when doc_id > least then 'E' end],
    lambda x: x is not null) as failed, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic from w left join labels using (doc_id)),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, cast(step as int) as step, filter_order[step] as x, string_split(left(filter_order, step - 1), '') as before from o, range(1, 6) r(step)),
c as (select part, failed, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
  from m group by part, failed),
j as (select *, list_contains(failed, x) as mine, list_has_any(failed, before) as gone from c, s),
r as (select part, filter_order, step, x, coalesce(sum(n) filter (not mine and not gone), 0) as kept,
    coalesce(sum(n) filter (mine and not gone), 0) as removed, coalesce(sum(n) filter (mine and gone), 0) as redundant,
    coalesce(sum(n) filter (mine and len(failed) = 1), 0) as unique_fails,
    coalesce(sum(n_good) filter (mine and not gone), 0) as good_lost,
    coalesce(sum(n_toxic) filter (mine and not gone), 0) as toxic_lost
  from j group by part, filter_order, step, x)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley from r"""


def _rounds_sql(rounds: int) -> str:
    """Assignments a0, a1, ... and the centroids after each."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""d{k} as materialized (select v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as distance
  from v join c{k} c on v.i = c.i group by v.vec_id, c.cluster),
a{k} as materialized (select vec_id, min(distance)::bigint as distance, arg_min(cluster, (distance, cluster)) as cluster
  from d{k} group by vec_id)""")
        if k < rounds:
            out.append(f"""m{k} as (select cluster, i, sum(x)::bigint as s, count(*) as n from a{k} join v using (vec_id) group by cluster, i),
c{k + 1} as materialized (select cluster, i, coalesce((s - ((s % n) + n) % n) // n, x) as x from c{k} left join m{k} using (cluster, i))""")
    return ",\n".join(out)


#: Components as rows (vec_id, i, x)
ORACLES["op13_clustering"] = f"""with kept as (select vec_id, embedding from embeddings where len(embedding) = 64
  and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as materialized (select vec_id, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: floor(64 * x::double)::bigint)) as x
  from kept),
f as (select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster from kept qualify cluster < 16),
c0 as materialized (select cluster, i, x from f join v using (vec_id)),
{_rounds_sql(3)},
h as (select cluster, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c3 group by cluster)
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, centroid_sha256 from a3 join h using (cluster)"""
