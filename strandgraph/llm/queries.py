"""The queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import chat, decontam, jaccard, language, packing, pii, prefixtrie, quality, tokencount, topk, toxicity, warc, whitening
from strandgraph.llm.shared import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.apply_edits(tokencount.build_trees(_table(spark, sf_dir, "documents")), tokencount.cleaning)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_pairs(chat.swapped_answers(_table(spark, sf_dir, "conversations")))
    flat = {m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(m) for m in ("chosen_mask", "rejected_mask")}
    return found.select("pair_id", "n_common", "prompt", "chosen", "rejected", *flat.values())


OP4_SQL = '''
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as pos from conversations
), l as (select conv_id, max(pos) filter (role = 'assistant') as last, max(pos) as n from t group by conv_id),
c as (select t.conv_id as id, pos, role, text from t),
r as (
  select t.conv_id as id, pos, role, text from t join l using (conv_id) where last is null or pos < last
  union all
  select l.conv_id, l.last, o.role, o.text from l join l m on m.conv_id = l.conv_id + 1 join t o on o.conv_id = m.conv_id and o.pos = m.last where l.last is not null
), b as (
  select coalesce(c.id, r.id) as id, min(coalesce(c.pos, r.pos)) filter (c.id is null or r.id is null or c.role is distinct from r.role or c.text is distinct from r.text) as off, max(coalesce(c.pos, r.pos)) as n
  from c full join r on c.id = r.id and c.pos = r.pos group by 1
), p as (select id, cast(coalesce(off - 1, n) as integer) as n_common from b),
s as (
  select side, id, pos, n_common, role, '<|im_start|>' || role || chr(10) as head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as seg
  from (select 'c' as side, * from c union all select 'r', * from r) join p using (id)
), o as (
  select *, cast(coalesce(sum(length(seg)) over (partition by side, id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as skip from s where pos > n_common
), g as (
  select id, coalesce(string_agg(seg, '' order by pos) filter (side = 'c'), '') as chosen, coalesce(string_agg(seg, '' order by pos) filter (side = 'r'), '') as rejected,
    coalesce(string_agg((skip + length(head)) || ':' || (skip + length(seg)), ',' order by pos) filter (side = 'c' and role = 'assistant'), '') as chosen_mask,
    coalesce(string_agg((skip + length(head)) || ':' || (skip + length(seg)), ',' order by pos) filter (side = 'r' and role = 'assistant'), '') as rejected_mask
  from o group by id
), q as (select id, string_agg(seg, '' order by pos) as prompt from s where side = 'c' and pos <= n_common group by id)
select p.id as pair_id, n_common, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected,
  coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask
from p left join g on g.id = p.id left join q on q.id = p.id
'''


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r'''
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') as a from documents
), s as (
  select distinct doc_id, case when len(a) < 5 then array_to_string(a, ' ') else array_to_string(a[i:i+4], ' ') end as g
  from w, unnest(range(1, greatest(len(a) - 4, 1) + 1)) as u(i) where len(a) > 0
), n as (select doc_id, count(*) as n from s group by doc_id),
e as (
  select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
  group by x.doc_id, y.doc_id
  having 100 * count(*) >= 75 * ((select n from n where n.doc_id = x.doc_id) + (select n from n where n.doc_id = y.doc_id) - count(*))
), r as (
  select doc_id as node, doc_id as reached from documents
  union select r.node, e.b from r join e on r.reached = e.a
)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.reached) as component_id
from documents d left join n on n.doc_id = d.doc_id join r on r.node = d.doc_id group by d.doc_id
'''


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP8_SQL = '''
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
'''


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def _uuid_sql(text: str) -> str:
    h = f"md5({text})"
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _entities_sql(x: str) -> str:
    name = f"regexp_extract(p, {_quoted(warc.ENTITY)}, 1)"
    known = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in warc.ENTITIES.items()) + "}"
    number = f"case when {name}[2:2] in ('x', 'X') then cast('0x' || {name}[3:] as bigint) else cast({name}[2:] as bigint) end"
    valid = f"{number} > 0 and {number} <= 1114111 and {number} not between 55296 and 57343"
    sign = f"case when {name} = '' then null when map_contains({known}, {name}) then {known}[{name}] when {name}[1:1] <> '#' then null when {valid} then chr(cast({number} as integer)) else chr(65533) end"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: case when i = 1 then p else coalesce({sign} || substr(p, length({name}) + 2), '&' || p) end), '')"


def _squeezed_sql(x: str) -> str:
    x = _entities_sql(x)
    for pattern, put in ((warc.BLANKS, "' '"), (warc.LINES, "chr(10)"), (warc.EDGES, "''")):
        x = f"regexp_replace({x}, '{pattern}', {put}, 'g')"
    return x


_LINK_SQL = f"regexp_replace({_entities_sql('regexp_replace(x, ' + _quoted(warc.QUOTES) + ', ' + _quoted('') + ', ' + _quoted('g') + ')')}, '{warc.ENDS}', '', 'g')"

OP9_SQL = rf'''
with p as (select coalesce(cast(page_id as varchar), '') as k, coalesce(url, '') as target_uri, coalesce(html, '') as h, regexp_replace(coalesce(html, ''), '{warc.DROPPED}', '', 'g') as shown from pages),
r as (
  select {_uuid_sql("'response|' || k || '|' || target_uri")} as refers_to, target_uri, h, shown, 'sha256:' || sha256(h) as payload_digest,
    regexp_replace(regexp_replace(shown, '{warc.BREAKS}', chr(10), 'g'), '{warc.TAGS}', '', 'g') as bare,
    regexp_replace(regexp_extract(shown, '{warc.TITLE}', 1), '{warc.TAGS}', '', 'g') as title from p
), b as (
  select 'metadata' as record_type, 'application/warc-fields' as content_type, refers_to, target_uri, payload_digest,
    'title: ' || replace({_squeezed_sql("title")}, chr(10), ' ') || chr(13) || chr(10)
    || 'source-Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-Content-Length: ' || strlen(h) || chr(13) || chr(10)
    || coalesce(array_to_string(list_transform(regexp_extract_all(shown, {_quoted(warc.LINK)}, 1), lambda x: 'outlink: ' || {_LINK_SQL} || ' L a/@href' || chr(13) || chr(10)), ''), '') as block from r
  union all select 'conversion', 'text/plain', refers_to, target_uri, payload_digest, {_squeezed_sql("bare")} from r
), i as (select *, {_uuid_sql("record_type || '|' || refers_to")} as record_id, strlen(block) as content_length, 'sha256:' || sha256(block) as block_digest from b)
select record_type, record_id, refers_to, target_uri, '{warc.UNDATED}' as date, content_type, content_length, block_digest, payload_digest, block,
  replace('WARC/1.1~WARC-Type: ' || record_type || '~WARC-Record-ID: ' || record_id || '~WARC-Refers-To: ' || refers_to, '~', chr(13) || chr(10))
  || chr(13) || chr(10) || 'WARC-Target-URI: ' || regexp_replace(target_uri, '{warc.CONTROL}', '', 'g')
  || replace('~WARC-Date: {warc.UNDATED}~Content-Type: ' || content_type || '~WARC-Block-Digest: ' || block_digest || '~WARC-Payload-Digest: ' || payload_digest || '~Content-Length: ' || content_length || '~', '~', chr(13) || chr(10)) as header
from i
'''


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP10_SQL = r'''
with t as (
  select 'd' as kind, cast(doc_id as varchar) as id, text from documents union all select 'b', cast(item_id as varchar), text from benchmark
), w as (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as a from t
), p as (
  select distinct id as item, least(10, len(a)) as m, array_to_string(a[i:i + least(10, len(a)) - 1], ' ') as g
  from w, unnest(range(1, len(a) - least(10, len(a)) + 2)) as u(i) where kind = 'b' and len(a) > 0
), lens as (select distinct m from p),
x as (
  select id, i, m, array_to_string(a[i:i + m - 1], ' ') as g from w join lens on len(a) >= m, unnest(range(1, len(a) - m + 2)) as u(i) where kind = 'd'
), o as (select x.id, x.i, x.m, p.item from x join p on x.m = p.m and x.g = p.g),
h as (select id, count(distinct k) as n_hit from o, unnest(range(i, i + m)) as u(k) group by id),
n as (select id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct id, item from o) group by id)
select d.doc_id, len(w.a) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from documents d join w on w.kind = 'd' and w.id = cast(d.doc_id as varchar) left join h on h.id = w.id left join n on n.id = w.id
'''


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie_of(_table(spark, sf_dir, "conversations"))


_CRC_STEP = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))), lambda a, c: {_CRC_STEP}), 4294967295)"

OP13_SQL = f'''
with t as (
  select cast(conv_id as bigint) as conv_id, turn, strlen(coalesce(text, '')) as size,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] as id
  from conversations where conv_id is not null
), o as (select conv_id, list(id order by turn nulls first, id, size) as ids, list(size order by turn nulls first, id, size) as sizes from t group by conv_id),
h as (select *, conv_id - conv_id % 5 as base, {_CRC} % 9 as h from o),
r as (
  select a.conv_id, list_concat(coalesce(b.ids, [])[:a.h], a.ids[a.h + 1:]) as ids, list_concat(coalesce(b.sizes, [])[:a.h], a.sizes[a.h + 1:]) as sizes
  from h a left join o b on b.conv_id = a.base
), m as (
  select conv_id, d, array_to_string(ids[:d], '') as node, case when d > 0 then array_to_string(ids[:d - 1], '') end as above, case when d > 0 then sizes[d] else 0 end as size, d = len(ids) as ends
  from r, unnest(range(0, len(ids) + 1)) as u(d)
), n as (
  select node, any_value(d) as depth, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(size) as own,
    sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (ends), '')) as ends_sha256 from m group by node
), k as (select above as node, count(*) as n_children from n where above is not null group by above),
s as (
  select substr(n.node, 1, 32 * a) as node, sum(case when k.node is null then 1 else 0 end) as n_leaves, sum(own) as saved_tokens
  from n left join k using (node), unnest(range(0, depth + 1)) as u(a) group by 1
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from n join s using (node) left join k using (node) left join n p on p.node = n.above
'''


def queries() -> dict[str, Query]:
    found = (op1_tokencount, op2_pii, op3_packing, op4_chat, op5_toxicity, op6_quality, op7_jaccard, op8_topk, op9_warc, op10_decontamination)
    return {f.__name__: f for f in (*found, op11_whitening, op12_language, op13_prefixtrie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op9_warc": OP9_SQL, "op7_jaccard": OP7_SQL, "op8_topk": OP8_SQL, "op10_decontamination": OP10_SQL, "op13_prefixtrie": OP13_SQL}
