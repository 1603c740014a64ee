"""DuckDB SQL for the catalogue. Written from window functions and plain joins, not from the jobs' array expressions."""

from __future__ import annotations

from strandgraph.functions import params


def _copies(base: str, source: str) -> str:
    return f"""r as (
  select k, case cast(k % 4 as int) when 0 then base
    when 1 then substr(base, 1, 9) || translate(substr(base, 10, 1), 'ACGT', 'CGTA') || substr(base, 11)
    when 2 then substr(base, 1, 15) || substr(base, 17) else substr(base, 1, 5) || 'A' || substr(base, 6) end as seq
  from (select k, {base} as base from (select *, cast(floor(k / 4) as bigint) as f from (select {source}) t) t) t
)"""


def _letters(*parts: str) -> str:
    return f"translate({' || '.join(f'md5({p})' for p in parts)}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _reads(length: int) -> str:
    return _copies(f"substr({_letters('cast(f as varchar)')}, 1, {length})", "o_orderkey as k from orders")


def _mixed(shortest: int) -> str:
    return _copies(f"substr({_letters(*(f'f || {chr(39)}|{i}{chr(39)}' for i in range(10)))}, 1, {shortest} + f * 37 % {301 - shortest})", "p_partkey as k from part")


PRIMED = _copies(f"'ACGTTGCA' || substr({_letters(chr(39) + 'c' + chr(39) + ' || f')}, 1, 16)", "c_custkey as k from customer")
AMPLICON = "TGGCATTACGGATCCAAGTCTTGACCGTAATGCACGGTTCAGATTACCGTGAACTCGTCA"


def _amplicon(source: str, errors: str) -> str:
    """Reads r (k, seq): copies of one sequence, one letter after the other put in where a digest of k says."""
    rows = f"(select k, '{AMPLICON}' as s from (select {source}) t) t"
    for i in range(5):
        told = f"md5('a' || k || '|{i}')"
        place = f"cast('0x' || substr({told}, 1, 4) as integer) % {len(AMPLICON)}"
        put = f"substr(s, 1, {place}) || translate(substr({told}, 5, 1), '0123456789abcdef', 'ACGTACGTACGTACGT') || substr(s, {place} + 2)"
        rows = f"(select k, case when {errors} > {i} then {put} else s end as s from {rows}) t"
    return f"r as (select k, s as seq from {rows})"


AMPLIFIED = _amplicon("p_partkey as k from part", "(case when k % 2 = 0 then 3 else 5 end)")
V = ", v as (select row_number() over (order by seq) - 1 as vid, seq, cnt from (select seq, count(*) as cnt from r group by seq) t)"
ALL_PAIRS = """select src, dst, cast(weight as integer) as weight from (
  select a.vid as src, b.vid as dst, levenshtein(a.seq, b.seq) as weight
  from (select vid, seq, unnest(range(length(seq) - 2, length(seq) + 3)) as n from v) a join (select vid, seq, length(seq) as n from v) b on a.n = b.n and a.vid < b.vid
) t where weight between 1 and 2"""


def _vertices(length: int) -> str:
    return _reads(length) + V


def _exact(most: int = 2) -> str:
    """Pairs of v: a read's segments against the substrings of another at shifts up to the distance."""
    n = most + 1
    width = f"case i when {most} then l - {most} * (l // {n}) else l // {n} end"
    return f"""own as (select vid, length(seq) as l, i, substr(seq, i * (l // {n}) + 1, {width}) as g from (select *, length(seq) as l from v) t, unnest(range(0, {n})) as u(i)),
asked as (
  select distinct vid, size, l, i, g from (
    select vid, length(seq) as size, l, i, substr(seq, i * (l // {n}) + 1 + s, {width}) as g
    from v, unnest(range(0, {n})) as u(i), unnest(range(-{most}, {most + 1})) as w(s), unnest(range(length(seq) - {most}, length(seq) + 1)) as x(l)
    where i * (l // {n}) + 1 + s >= 1 and l > 0) t
),
cand as (select distinct least(o.vid, a.vid) as src, greatest(o.vid, a.vid) as dst from own o join asked a on o.l = a.l and o.i = a.i and o.g = a.g and (o.l < a.size or o.vid < a.vid)),
exact as (
  select src, dst, cast(weight as integer) as weight from (select c.src, c.dst, levenshtein(x.seq, y.seq) as weight from cand c join v x on x.vid = c.src join v y on y.vid = c.dst) t
  where weight between 1 and {most}
)"""


def _kmers(k: int, name: str = "km", source: str = "v", seq: str = "seq", keep: str = "vid") -> str:
    return f"{name} as (select {keep}, i, substr({seq}, i, {k}) as kmer from {source}, unnest(range(1, length({seq}) - {k} + 2)) as u(i))"


def _segments(n: int) -> str:
    return f"sg as (select vid, j, substr(seq, j * (length(seq) // {n}) + 1, case j when {n - 1} then length(seq) else length(seq) // {n} end) as s from v, unnest(range(0, {n})) as u(j))"


def _minima(value: str, window: int, source: str, by: str, shrink: bool) -> str:
    """Distinct minima of full windows of consecutive rows; with ``shrink`` shorter lists are one window."""
    full = f"least({window}, n)" if shrink else str(window)
    return f"""select distinct key, vid from (
    select vid, min({value}) over w as key, count(*) over w as m, count(*) over (partition by {by}) as n from {source}
    window w as (partition by {by} order by i rows between current row and {window - 1} following)
  ) t where m >= {full}"""


LEX = _kmers(4) + ", b as (" + _minima("kmer", 3, "km", "vid", True) + ")"


def _hashed(k: int, window: int, name: str = "b") -> str:
    return _kmers(k, "hk") + ", hm as (select vid, i, md5('2024|' || kmer) as h from hk), " + f"{name} as (" + _minima("h", window, "hm", "vid", False) + ")"


def _gapped(k: int = 4) -> str:
    word = " || ".join(f"substr(seq, i + {2 * j}, 1)" for j in range(k))
    return f"""gk as (select vid, i, {word} as kmer from v, unnest(range(1, length(seq) - {2 * k} + 3)) as u(i) where length(seq) >= {2 * k - 1}),
go as (select vid, kmer, row_number() over (partition by vid, kmer order by i) as occ from gk)"""


_SEEDS = "(select unnest([11, 22, 33]) as seed)"


def _min_hashed(seeds: str) -> str:
    return _gapped() + f""", gb as (
  select distinct key, vid from (
    select v.vid, s.seed, coalesce(min(md5(s.seed || '|' || go.kmer || '|' || go.occ)), '0') as key from v cross join {seeds} s left join go on go.vid = v.vid group by v.vid, s.seed
  ) t
)"""


GOMH = _min_hashed(_SEEDS)
DRAWN = _min_hashed(f"(select unnest([{', '.join(str(s) for s, _ in params.seeds(50, 2, times=3))}]) as seed)")
ALL_GAPPED = _gapped() + ", ab as (select distinct kmer || '|' || occ as key, vid from go)"
OMH_PREFIX = f"ob as (select distinct md5(s.seed || '|' || substr(seq, 1, 6) || '|' || substr(seq, 2, 6)) as key, vid from v cross join (select unnest([1, 2, 3]) as seed) s where length(seq) >= 7)"  # noqa: F541
OMH_MIN = (
    _kmers(6)
    + """, oc as (select *, row_number() over (partition by vid, kmer order by i) - 1 as occ from km),
oh as (select *, row_number() over (partition by vid, seed order by md5(seed || '|' || kmer || '|' || occ), i) as rank from oc cross join (select unnest([1, 2, 3]) as seed) s),
mb as (select distinct md5(seed || '|' || string_agg(kmer, '|' order by i)) as key, vid from oh where rank <= 2 group by vid, seed)"""
)


def _inside(buckets: str, edges: str = "exact", by: str = "key") -> str:
    return f"select distinct e.src, e.dst, e.weight from {edges} e join {buckets} x on x.vid = e.src join {buckets} y on y.vid = e.dst and " + " and ".join(f"x.{c} = y.{c}" for c in by.split(","))


def _split(most: int, source: str = "b") -> str:
    return f"""bs as (select key, count(*) as size from {source} group by key),
nb as (select * from {source} where key in (select key from bs where size >= 2 and size < {most})),
lb as (select * from {source} where key not in (select key from bs where size >= 2 and size < {most})),
sb as (select distinct l.key as parent, g.key, l.vid from lb l join gb g on g.vid = l.vid),
rt as (select parent, count(distinct key) as n from sb group by parent)"""


def _hops(edges: str, depth: int, sources: str = "") -> str:
    """Recursive and breadth first; each round walks one edge further."""
    return f"""nr as (select src, dst from {edges} union select dst, src from {edges}),
hp as (select src, dst, 1 as d from nr {sources} union select h.src, n.dst, h.d + 1 from hp h join nr n on n.src = h.dst where h.d < {depth} and n.dst <> h.src),
hops as (select distinct src, dst from hp)"""


def oracle_sql() -> dict[str, str]:
    v24, v12, e24, e12 = _vertices(24), _vertices(12), _vertices(24) + ", " + _exact(), _vertices(12) + ", " + _exact()
    long = params.lexicographic(51)
    modes = {"minimizer": "b", "miniception": "hb", "omh": "ob", "gapped": "ab"}
    recall = " union all ".join(f"select '{m}' as mode, weight, count(*) as n_found from ({_inside(b)}) t group by weight" for m, b in modes.items())
    return {
        "read_multiplicity": f"with {_reads(12)} select seq, count(*) as cnt from r group by seq",
        "read_length_stats": f"""with {_reads(24)} select count(*) as n_unique, cast(min(length(seq)) as integer) as min_length, cast(max(length(seq)) as integer) as max_length,
  count(*) filter (length(seq) not between 6 and 300) as n_out_of_range from (select distinct seq from r) t""",
        "read_length_flags": f"with {_reads(24)} select length(seq) between 6 and 300 as length_ok, length(seq) as length, count(*) as n from r group by all",
        "alphabet_cast": """with t as (select p_partkey, translate(regexp_replace(upper(p_name), '[^A-Z]', 'N', 'g'), 'URYSWKMBDHV', 'TNNNNNNNNNN') as s from part)
select p_partkey, case when regexp_full_match(s, '[ACGNT]+') then s end as seq from t""",
        "vertex_numbering": f"with {v12} select vid, seq, cnt from v",
        "segments": f"with {_reads(24)} select k, i, substr(seq, i * (length(seq) // 3) + 1, case i when 2 then length(seq) else length(seq) // 3 end) as segment from r, unnest(range(0, 3)) as u(i)",
        "kmer_spectrum": f"with {_reads(24)}, {_kmers(4, source='r', keep='k')} select kmer, count(*) as n from km group by kmer",
        "kmer_occurrence": f"with {v24}, {_kmers(2)}, o as (select kmer, row_number() over (partition by vid, kmer order by i) as occ from km) select kmer, occ, count(*) as n from o group by all",
        "gapped_kmers": f"with {v12}, {_gapped()} select vid, kmer, occ from go",
        "lex_minimizers": f"with {v24}, {LEX} select key, vid from b",
        "lex_minimizers_segmented": f"with {v24}, {_segments(2)}, {_kmers(4, source='sg', seq='s', keep='vid, j')} {_minima('kmer', 3, 'km', 'vid, j', True)}",
        "hash_minimizers": f"with {v24}, {_hashed(4, 8)} select key, vid from b",
        "hash_minimizers_segmented": f"""with {v24}, {_segments(2)}, {_kmers(4, source='sg', seq='s', keep='vid, j')}, hm as (select vid, j, i, md5('2024|' || kmer) as h from km)
{_minima('h', 5, 'hm', 'vid, j', False)}""",
        "gomh_keys": f"with {v24}, {GOMH} select key, vid from gb",
        "gomh_all_keys": f"with {v12}, {ALL_GAPPED} select key, vid from ab",
        "omh_prefix_keys": f"with {v24}, {OMH_PREFIX} select key, vid from ob",
        "omh_minhash_keys": f"with {v24}, {OMH_MIN} select key, vid from mb",
        "bucket_sizes": f"with {v24}, {LEX} select key, count(*) as size from b group by key",
        "bucket_count": f"with {v24}, {LEX} select count(distinct key) as n_buckets from b",
        "bucket_split": f"with {v24}, {LEX} select key, count(*) as size, case when count(*) >= 2 and count(*) < 600 then 'normal' else 'large' end as kind from b group by key",
        "bucket_stats": f"""with {e24}, {LEX}, s as (select key, count(*) as n from b group by key),
h as (select x.key, count(*) as n from exact e join b x on x.vid = e.src join b y on y.vid = e.dst and y.key = x.key group by x.key)
select s.key, s.n as bucket_size, s.n * (s.n - 1) // 2 as total_pairs, coalesce(h.n, 0) as positive_cases, s.n * (s.n - 1) // 2 - coalesce(h.n, 0) as negative_cases from s left join h using (key)""",
        "edges_brute_force": f"with {e24} select * from exact",
        "edges_brute_force_short": f"with {e12} select * from exact",
        "edges_brute_force_min2": f"with {e24} select * from exact where weight >= 2",
        "edges_minimizer": f"with {e12}, {LEX} {_inside('b')}",
        "edges_miniception": f"with {e12}, {_hashed(4, 8)} {_inside('b')}",
        "edges_omh": f"with {e24}, {OMH_MIN} {_inside('mb')}",
        "edges_omh_minhash": f"with {e24}, {OMH_MIN} {_inside('mb')}",
        "edges_gapped": f"with {e12}, {ALL_GAPPED} {_inside('ab')}",
        "edges_bucket_join": f"""with {v24} select a.vid as src, b.vid as dst, cast(levenshtein(a.seq, b.seq) as integer) as weight from v a join v b on substr(a.seq, 1, 7) = substr(b.seq, 1, 7) and a.vid < b.vid
where levenshtein(a.seq, b.seq) between 1 and 2""",
        "large_bucket_rebucket": f"with {e24}, {LEX}, {GOMH}, {_split(600)}, pw as (select s.* from sb s join rt using (parent) where n >= 2 and n < 600) {_inside('pw', by='parent,key')}",
        "sub_bucket_routes": f"with {v24}, {LEX}, {GOMH}, {_split(600)} select parent, n, case when n >= 300 then 'traversal' when n >= 2 then 'pairwise' else 'dropped' end as route from rt",
        "khop_pairs": f"with recursive {e24}, {_hops('exact', 3)} select src, dst from hops",
        "edges_after_khop": f"""with recursive {e12}, ones as (select * from exact where weight = 1), {_hops('ones', 3)}
select src, dst, weight from exact where weight = 1 or (src, dst) in (select src, dst from hops)""",
        "merge_unique_reads": f"with {_reads(24)}, a as (select seq from r), b as (with {_reads(12)} select seq from r) select seq from a union select seq from b",
        "edge_weight_filter": f"with {e24} select * from exact where weight not between 1 and 1",
        "edge_summary": f"with {e24} select weight, count(*) as n from exact group by rollup(weight)",
        "graph_minimizer_gomh": f"with {e12}, {LEX}, {ALL_GAPPED} {_inside('b')} union {_inside('ab')}",
        "graph_miniception_gomh": f"""with recursive {e24}, {_hashed(4, 8)}, {DRAWN}, {_split(600)},
pw as (select s.* from sb s join rt using (parent) where n >= 2 and n < 600), far as (select distinct vid from sb join rt using (parent) where n >= 600),
now as ({_inside('nb')} union {_inside('pw', by='parent,key')}), {_hops('now', 4, 'where src in (select vid from far)')},
met as (select distinct least(src, dst) as src, greatest(src, dst) as dst from hops)
select * from now union select e.* from exact e join met using (src, dst)""",
        "edges_mixed_lengths": f"with {_mixed(6)}{V} {ALL_PAIRS}",
        "edges_shared_primer": f"with {PRIMED}{V} {ALL_PAIRS}",
        "edges_incremental": f"""with {_reads(24)}, a as (select seq, unnest(case when k % 10 = 0 then [0, 1, 2] else [k % 3] end) as batch from r),
v as (select row_number() over (order by min(batch), seq) - 1 as vid, seq, count(*) as cnt from a group by seq), {_exact()}
select src, dst, weight, x.cnt as src_cnt, y.cnt as dst_cnt from exact e join v x on x.vid = e.src join v y on y.vid = e.dst""",
        "component_sizes": f"""with recursive {e24}, near as (select src, dst from exact union select dst, src from exact),
reach as (select vid, vid as other from v union select r.vid, n.dst from reach r join near n on n.src = r.other)
select comp, count(*) as n from (select vid, min(other) as comp from reach group by vid) t group by comp""",
        "edges_amplicon": f"with {AMPLIFIED}{V} {ALL_PAIRS}",
        "graph_miniception": f"with {e12}, {_hashed(4, 8)} {_inside('b')}",
        "graph_omh": f"with {e24}, {OMH_PREFIX} {_inside('ob')}",
        "graph_long_reads": f"""with {_mixed(52)}{V}, exact as ({ALL_PAIRS}), {_segments(long.segments)}, {_kmers(long.k, source='sg', seq='s', keep='vid, j')},
b as ({_minima('kmer', long.window, 'km', 'vid, j', True)}), nb as (select * from b where key in (select key from b group by key having count(*) between 2 and 9999)) {_inside('nb')}""",
        "stage_metrics": f"""with {e12}, {LEX}, {ALL_GAPPED}, bs as (select key, count(*) as size from b group by key),
lb as (select * from b where key in (select key from bs where size < 2 or size >= 10000)), nb as (select * from b where key not in (select key from lb)),
o as (select distinct l.key as parent, g.key, l.vid from lb l join ab g on g.vid = l.vid), w as (select g.key, g.vid from ab g where g.vid in (select vid from nb)),
one as ({_inside('nb')}), two as (select * from one union {_inside('w')}),
c as (select 'first pass' as stage, key, size from bs union all select 'odd-sized buckets', parent || key, count(*) from o group by parent, key union all select 'second pass', key, count(*) from w group by key),
names as (select unnest(['first pass', 'odd-sized buckets', 'second pass']) as stage),
e as (select 'first pass' as stage, weight from one union all select 'odd-sized buckets', weight from one union all select 'second pass', weight from two union all select 'graph', weight from two)
select 'reads' as stage, 'n_unique' as measure, count(*) as n from v union all select 'reads', 'min_length', min(length(seq)) from v
union all select 'reads', 'n_out_of_range', count(*) filter (length(seq) not between 6 and 300) from v
union all select n.stage, 'buckets', count(size) from names n left join c using (stage) group by all
union all select n.stage, 'buckets of one read', count(*) filter (size = 1) from names n left join c using (stage) group by all
union all select n.stage, 'normal buckets', count(*) filter (size between 2 and 9999) from names n left join c using (stage) group by all
union all select n.stage, 'large buckets', count(*) filter (size >= 10000) from names n left join c using (stage) group by all
union all select stage, 'edges of weight ' || coalesce(cast(weight as varchar), 'any'), count(*) from e group by grouping sets ((stage, weight), (stage))""",
        "fastq_reads": f"with {_reads(24)} select cast(k as varchar) as id, seq from r",
        "fastq_ranges": f"with {_reads(24)} select cast(k as varchar) as id, seq from r",
        "mode_recall": f"""with {e12}, {LEX}, {_hashed(4, 8, 'hb')}, {OMH_PREFIX}, {ALL_GAPPED}, f as ({recall}), t as (select weight, count(*) as n_exact from exact group by weight)
select mode, weight, n_found, n_exact, round(n_found / n_exact, 6) as recall from f join t using (weight)""",
        "dot_lines": f"""with {e24} select 1 as part, vid || ' [count="' || cnt || '", read="' || seq || '"];' as line from v
union all select 2, src || '--' || dst || ' [weight="' || weight || '"];' from exact union all select 0, 'graph G {{' union all select 3, '}}'""",
    }
