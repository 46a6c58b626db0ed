"""The registered queries opN_<name> and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineflow.llm import collocations, decontaminate, embeddings, language, licenses, manifest, minhash, mixing, pii, quality, secrets, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2).drop("source")


OP3 = r"""
with d as (select doc_id, case when source is null then '1' else '0' || source end sk, md5('mix:' || doc_id) h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select sk, sum(size)::bigint source_size from d group by sk),
w as (select *, [3, 1, 2][((row_number() over (order by sk)) - 1) % 3 + 1]::bigint w, 2 * source_size cap, sum(source_size) over ()::double * 1.5 budget from s),
k as (select *, row_number() over o k, (budget - (sum(cap) over o - cap)) / (sum(w) over () - (sum(w) over o - w)) lv from w
    window o as (order by cap::double / w::double, sk)),
lvl as (select arg_min(lv, k) filter (lv <= cap::double / w::double) lv from k),
t as (select sk, source_size, budget, least(cap::double, coalesce(lvl.lv * w, cap::double)) target from k, lvl),
c as (select d.*, source_size, target, budget, sum(size) over (partition by d.sk order by h, doc_id, size rows unbounded preceding)::bigint cum from d join t using (sk)),
e as (select c.*, e, (source_size * e + cum)::double / target f from c, (values (0), (1)) v(e) where target > 0 and size > 0),
r as (select *, sum(size) over (order by f, sk, h, doc_id, size, e rows unbounded preceding) run from e),
n as (select doc_id, sum(size) taken from r where run <= budget group by doc_id)
select c.doc_id, c.size, c.source_size, c.target, coalesce(n.taken, 0)::bigint taken from c left join n using (doc_id)
"""

def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages"), least=0)


OP4 = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b)::bigint n, upper(sha1(b)) x from p),
d as (select page_id, n, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (i // 4) * 5 + 1, 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') dg from h),
m as (select *, min(page_id) over (partition by dg) f from d)
select page_id, n payload_bytes, dg payload_digest, case when f = page_id then 'response' else 'revisit' end record_type,
    case when f <> page_id then f end refers_to from m
"""

def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_all(_table(spark, sf_dir, "documents"), mod=4, held=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), mod=5, held=0, threshold=0.3)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


OP2 = """
with recursive n as (select vec_id, embedding::double[] v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id u, b.vec_id v from n a join n b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select u as node, u as seen from link union select node, v from reach join link on seen = u),
comp as (select node, min(seen) c from reach group by node),
cnt as (select u, count(*) k from link group by u)
select vec_id, coalesce(k, 0)::bigint n_links, coalesce(c, vec_id) component_id, vec_id = coalesce(c, vec_id) kept
from embeddings left join cnt on u = vec_id left join comp on node = vec_id
"""

def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.1)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pseudonymise(_table(spark, sf_dir, "documents"), pii.session_key(spark)))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.deduplicate(_table(spark, sf_dir, "documents")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end s from w),
n as (select doc_id, len(s)::bigint n_shingles, md5(array_to_string(list_sort(s), chr(10))) k from g),
class as (select k, min(doc_id) rep, any_value(n_shingles) n from n where n_shingles > 0 group by k),
e as (select rep, n, unnest(s) x from class join g on rep = doc_id),
pair as (select a.rep a, b.rep b, count(*) k, any_value(a.n) na, any_value(b.n) nb from e a join e b using (x) where a.rep < b.rep group by all),
link as (select a u, b v from pair where 100 * k >= 85 * (na + nb - k)),
sym as (select u, v from link union all select v, u from link),
reach as (select rep as node, rep as seen from class union select reach.node, sym.v from reach join sym on reach.seen = sym.u),
comp as (select node, min(seen) c from reach group by node)
select n.doc_id, n.n_shingles, coalesce(c, n.doc_id) component_id, n.doc_id = coalesce(c, n.doc_id) kept
from n left join class on n.k = class.k and n.n_shingles > 0 left join comp on comp.node = class.rep
"""

def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, top=2000, inside=100)


OP11 = r"""
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
q as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase, count(*) f
    from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from q, range(1, 6) s(k)) group by all having count(*) >= 100),
n as (select lang, sum(len(ws))::bigint n from q group by lang),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from g where k > 1),
x as (select c.lang, phrase, a, j, array_to_string(w[1:j], ' ') lp, array_to_string(w[j + 1:], ' ') rp from c, range(1, 5) s(j) where j < k),
y as (select x.lang, x.phrase, a, j, l.f l, r.f r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint score
    from x join g l on l.lang = x.lang and l.phrase = lp join g r on r.lang = x.lang and r.phrase = rp join n on n.lang = x.lang),
z as (select lang, phrase, a, n, arg_min({'l': l, 'r': r, 's': score}, score * 8 + j) b from y group by all),
d as (select lang, array_to_string(w[i:i + m - 1], ' ') phrase, max(a) lf from (select lang, w, a, m, unnest(range(1, k - m + 2)) i from c, range(2, 5) s(m) where m < k) group by all)
select lang, row_number() over (partition by lang order by b.s desc, a desc, phrase) "rank", phrase, a, b.l l, b.r r, n, b.s score
from z left join d using (lang, phrase) where coalesce(100 * lf < 100 * a, true) qualify "rank" <= 2000
"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(_table(spark, sf_dir, "documents"))


OP13 = """
with recursive x as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))) t),
d as (select doc_id, doc_id::varchar k, coalesce('1' || lang, '0') g, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') head, text,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from documents),
l as (select doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) leaf, sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) low,
        xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 hit from d, x),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i, row_number() over () id from l),
n as (select g, 0 lv, i, leaf h, count(*) over (partition by g) c from p
    union all select g, lv, i, h, count(*) over (partition by g) from (select g, lv + 1 lv, i // 8 i, sha256(string_agg(h, '' order by i)) h from n where c > 1 group by g, lv, i // 8)),
s as (select g, h, row_number() over (order by g) - 1 i from n where c = 1),
t as (select 0 lv, i, h, count(*) over () c from s
    union all select lv, i, h, count(*) over () from (select lv + 1 lv, i // 8 i, sha256(string_agg(h, '' order by i)) h from t where c > 1 group by lv, i // 8)),
b as (select g, lv, i, coalesce(string_agg(h, '' order by i) over (partition by g, lv, i // 8 order by i rows between unbounded preceding and 1 preceding), '') lf,
        coalesce(string_agg(h, '' order by i) over (partition by g, lv, i // 8 order by i rows between 1 following and unbounded following), '') rt from n where c > 1),
u as (select lv, i, coalesce(string_agg(h, '' order by i) over (partition by lv, i // 8 order by i rows between unbounded preceding and 1 preceding), '') lf,
        coalesce(string_agg(h, '' order by i) over (partition by lv, i // 8 order by i rows between 1 following and unbounded following), '') rt from t where c > 1),
w as (select id, b.lv, lf, rt from p join b on b.g = p.g and b.i = p.i // (8 ** b.lv)::bigint
    union all select id, 100 + u.lv, lf, rt from p join s using (g) join u on u.i = s.i // (8 ** u.lv)::bigint),
a as (select id, list({'l': lf, 'r': rt} order by lv) way from w group by id),
f as (select id, 0 k, case when hit then low else leaf end h from p union all select f.id, k + 1, sha256(way[k + 1].l || h || way[k + 1].r) from f join a using (id) where k < len(way)),
e as (select id, arg_max(h, k) folded_root from f group by id)
select doc_id, leaf, s.h subroot, t.h root, sha256(coalesce(list_reduce(list_transform(way, lambda y: y.l || y.r), lambda m, y: m || y), '')) proof_sha256, folded_root, folded_root = t.h verified
from p join s using (g) cross join (select h from t where c = 1) t join e using (id) left join a using (id)
"""

QUERIES = {"op5_substrings": op5_substrings, "op1_pii": op1_pii, "op2_embeddings": op2_embeddings, "op6_quality": op6_quality, "op8_secrets": op8_secrets, "op9_language": op9_language, "op10_decontaminate": op10_decontaminate, "op4_warc": op4_warc, "op3_mixing": op3_mixing, "op7_minhash": op7_minhash, "op11_collocations": op11_collocations, "op12_licenses": op12_licenses, "op13_manifest": op13_manifest}
ORACLES = {"op2_embeddings": OP2, "op4_warc": OP4, "op3_mixing": OP3, "op7_minhash": OP7, "op11_collocations": OP11, "op13_manifest": OP13}
