"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import dialogue, divergence, idfiles, itq, langid, lm, mixing, packing, quality, simhash, token_counts, vptree, warc
from quillspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(file: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


def query(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn
    return deco


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_cross_parsing_langid")
def op2(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


@query("op3_itq_embedding_dedup")
def op3(spark, sf_dir):
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_mix_sources")
def op4(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op5_vantage_point_search")
def op5(spark, sf_dir):
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


@query("op6_simhash_ball_dedup")
def op6(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_quality_neighbours")
def op7(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_warc_chunks")
def op9(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query("op10_bloom_lm")
def op10(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    return dialogue.repair(table(spark, sf_dir, "conversations"))


@query("op12_token_files")
def op12(spark, sf_dir):
    return idfiles.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op13_source_divergence")
def op13(spark, sf_dir):
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


# --- DuckDB SQL where it can say the same -----------------------------------------------------------
# vectors that take part: not null, no null or non-finite component, not zero
_VECTORS = """v as (
 select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

ORACLES["op3_itq_embedding_dedup"] = f"""with recursive {_VECTORS},
links as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
 where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach(n, m) as (select vec_id, vec_id from embeddings union select reach.n, links.b from reach join links on reach.m = links.a),
least as (select n, min(m) c from reach group by n),
counts as (select a, count(*) k from links group by a)
select vec_id, cast(coalesce(k, 0) as bigint) n_links, c component_id, vec_id = c kept
from embeddings join least on vec_id = n left join counts on vec_id = a"""

ORACLES["op5_vantage_point_search"] = f"""with {_VECTORS},
pairs as (select q.vec_id query_id, v.vec_id, list_distance(q.e, v.e) score
 from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 100 = 0)
select query_id, cast(rank as int) rank, vec_id, score from (
 select *, row_number() over (partition by query_id order by score, vec_id) rank from pairs) where rank <= 10"""

# 20 bits of the digest, five hexadecimal digits, are four characters of base32
ORACLES["op9_warc_chunks"] = """with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h from pages),
d as (select *, max(page_id) over (partition by h, n) first, array_to_string(list_transform(range(0, 32), lambda i: substr(
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, cast(1 + (i // 4) * 5 as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31 as int), 1)), '') b from p)
select page_id, cast(n as bigint) payload_bytes, b payload_digest, case when page_id = first then 'response' else 'revisit' end record_type,
 case when page_id <> first then first end refers_to, case when page_id = first then true end intact from d"""

# Damage, faults, then the cheapest repair state by state: before each row and at the end none, one or two turns are inserted
# (a third only repeats a state at a cost). Of equal costs the least edits win; of equal edits the repaired text is the same.
ORACLES["op11_conversation_repair"] = r"""with recursive
c as (select conv_id, turn, coalesce(role, ' ') r0, coalesce(text, ' ') t0, row_number() over () nr,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
crc_table(i, v) as (select i, list_reduce(list_prepend(cast(i as bigint), range(0, 8)), lambda a, b: case when a & 1 = 1 then xor(3988292384::bigint, a >> 1) else a >> 1 end)
  from range(0, 256) t(i)),
crc(nr, k, j, v) as (select nr, k, 1, 4294967295::bigint from c
 union all select nr, k, j + 1, xor((select t.v from crc_table t where t.i = xor(crc.v, ascii(substr(k, j, 1))::bigint) & 255), crc.v >> 8) from crc where j <= length(k)),
kinds as (select nr, xor(v, 4294967295::bigint) % 20 kind from crc where j > length(k)),
d as (select conv_id, turn, nr, case when kind = 4 then 'user' else r0 end as role,
  case when kind = 1 then '' when kind = 2 then translate(t0, '.!?', '') else t0 end as text, unnest(range(0, case when kind = 3 then 2 else 1 end)) copy
 from c join kinds using (nr) where kind <> 0),
o as (select *, rtrim(text, E' \t\n\x0B\f\r') body, row_number() over (partition by conv_id order by turn nulls first, role, text, nr, copy) i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, nr, copy) > 1 again from d),
f as (select *, substr(role, 1, 1) x, case when body = '' then 'b' when again then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end fault from o),
n as (select conv_id, count(*) n, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end gaps,
  count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated from f group by conv_id),
l as (select conv_id, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from
 (select conv_id, x, lag(x) over (partition by conv_id order by i) || x pair from f) where pair is not null group by conv_id),
g(s, e, c, w, s2) as (select * from (values ('0','',0,'','0'),('0','I',5,E'\nuser:','u'),('0','II',10,E'\nuser:\nassistant:','a'),
 ('s','',0,'','s'),('s','I',5,E'\nuser:','u'),('s','II',10,E'\nuser:\nassistant:','a'),
 ('u','',0,'','u'),('u','I',5,E'\nassistant:','a'),('u','II',10,E'\nassistant:\nuser:','u'),
 ('a','',0,'','a'),('a','I',5,E'\nuser:','u'),('a','II',10,E'\nuser:\nassistant:','a')) t),
m(s, x, s2) as (select * from (values ('0','s','s'),('0','u','u'),('s','u','u'),('u','a','a'),('a','u','u')) t),
st(conv_id, i, s, b) as (
 select conv_id, 1::bigint, '0', {'cost': 0::bigint, 'audit': '', 'w': ''} from n
 union all
 select conv_id, i + 1, s2, min(b) from (
  select st.conv_id, st.i, z.s2, {'cost': st.b.cost + g.c + z.c, 'audit': st.b.audit || g.e || z.e, 'w': st.b.w || g.w || z.w} b
  from st join f on f.conv_id is not distinct from st.conv_id and f.i = st.i join g on g.s = st.s,
  lateral (select g.s2 s2, 2 c, 'D' e, '' w
   union all select m.s2, case when fault = 't' then 5 else 0 end, 'K', E'\n' || f.role || ':' || f.text from m where m.s = g.s2 and m.x = f.x and fault not in ('b', 'd')
   union all select case when g.s2 = 'u' then 'a' else 'u' end, case when fault = 't' then 6 else 1 end, 'R',
    E'\n' || case when g.s2 = 'u' then 'assistant' else 'user' end || ':' || f.text where fault not in ('b', 'd')) z)
 group by conv_id, i, s2),
e as (select st.conv_id, min({'cost': st.b.cost + g.c, 'audit': st.b.audit || g.e, 'w': st.b.w || g.w}) b
 from st join n on n.conv_id is not distinct from st.conv_id and st.i = n.n + 1 join g on g.s = st.s and g.s2 in ('0', 'a') group by st.conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
 coalesce(illegal, 0)::bigint illegal, coalesce(e.b.cost, 0)::bigint as cost, coalesce(e.b.audit, '') as audit, sha256(substr(coalesce(e.b.w, ''), 2)) repaired_sha256
from (select distinct conv_id from conversations) a left join n on n.conv_id is not distinct from a.conv_id
 left join l on l.conv_id is not distinct from a.conv_id left join e on e.conv_id is not distinct from a.conv_id"""

ORACLES["op13_source_divergence"] = r"""with
d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term, count(*) n from w group by lang, term having count(distinct id) >= 3),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) n from w join kept using (lang, term) group by all),
l as (select lang, count(*) v, sum(n) n from kept group by lang),
gn as (select g.lang, g.source, coalesce(sum(n), 0) n from g left join c using (lang, source) group by all),
p as (select gn.lang, gn.source, kept.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (gn.n + l.v)::hugeint p,
  1 + (1000000000::hugeint * (kept.n + 1)) // (l.n + l.v)::hugeint q
 from gn join l using (lang) join kept using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
pairs as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
 union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank from (
 select *, row_number() over (partition by lang, source, part order by value desc, item) rank from parts) where part = 'pair' or rank <= 200"""
