"""The registered queries of the corpus operators and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import audit, bpe, centroids, chat, dedup, langid, licences, mixing, partenum, pii, secrets, substrings, topk

#: Key of the pseudonyms in the registered query; a real run passes its own secret.
PII_KEY = "query-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_private")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), labelled, mixing.TARGETS).drop("mark")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_groups(table(spark, sf_dir, "documents")).drop("class_id")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), texts_too=False).drop("kept_text")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_pii_pseudonyms, op3_mixing, op4_ngram_jaccard, op5_top_k, op6_exact_dedup, op7_substring_dedup, op8_byte_bpe, op9_chat_format, op10_licence_scan)
}
QUERIES |= {f.__name__: f for f in (op11_filter_audit, op12_secret_scan, op13_centroids)}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""
        with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as materialized (select distinct doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) as s
              from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
        n as materialized (select doc_id, count(*) as n from s group by doc_id),
        c as materialized (select s, min(doc_id) as rep from s group by s having count(*) > 1),
        pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id where a.s in (select s from c) group by 1, 2),
        links as materialized (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
        sym as materialized (select x, y from links union select y, x from links),
        reach(doc_id, label) as (select x, x from sym union select sym.y, label from reach join sym on sym.x = reach.doc_id where label < sym.y),
        comp as (select doc_id, min(label) as label from reach group by doc_id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.label, d.doc_id) as component_id from documents d left join n using (doc_id) left join comp using (doc_id)""",
    "op7_substring_dedup": r"""
        with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as materialized (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as h
                             from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from w where len(w) >= 50)),
        f as (select h, min(doc_id) as first from win group by h having count(*) > 1),
        hit as (select distinct win.doc_id, win.i + k as pos from win join f using (h), range(50) r(k) where f.first < win.doc_id),
        gone as materialized (select doc_id, list(pos) as pos from hit group by doc_id),
        k as (select w.doc_id, w.w, pos, case when pos is null then w.w else list_filter(list_transform(w.w, lambda x, i: case when not list_contains(pos, i) then x end), lambda x: x is not null) end as kept
              from w left join gone using (doc_id))
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(pos), 0) as bigint) as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k""",
    "op5_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
              from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_exact_dedup": r"""
        with norm as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
        g as (select doc_id, sha256(t) as text_sha256, count(*) over (partition by t) as group_size,
                     first_value(doc_id) over (partition by t order by n desc, doc_id) as keep_id from norm)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""",
    "op9_chat_format": r"""
        with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
                   union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t as (select *, lag(role) over w as prev, lead(role) over w as next from c window w as (partition by conv_id order by turn, role, text)),
        v as (select *, length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) + 4 + length(role) + 2 + 9 as chars,
                     coalesce(case when prev is null then role in ('system', 'user') when prev = 'system' then role = 'user'
                                   when prev = 'user' then role = 'assistant' when prev = 'assistant' then role = 'user' else false end, false)
                     and (next is not null or role = 'assistant') as ok from t),
        a as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as whole,
                     coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
                     cast(sum(chars) as bigint) as formatted_chars, bool_and(ok) as valid from v group by conv_id)
        select conv_id, n_turns, sha256(whole) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, valid from a""",
}

ORACLE_SQL["op11_filter_audit"] = r"""
    with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
    f as (select w.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
                 case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
                 || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
                 || case when coalesce(doc_id > min(doc_id) over (partition by t), false) then 'E' else '' end as bad
          from w left join l using (doc_id)),
    cells as materialized (select part, bad, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, bad),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as materialized (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
                            where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    gone as (select part, bad, n, good, toxic, filter_order, coalesce(list_min(list_transform(string_split(bad, ''), lambda f: instr(filter_order, f))), 6) as first
             from (select part, bad, n, good, toxic, filter_order from cells, orders where bad <> '')
             union all select part, bad, n, good, toxic, filter_order, 6 from cells, orders where bad = ''),
    steps as (select part, filter_order, step, substr(filter_order, step, 1) as f,
                     sum(case when first > step then n else 0 end) as kept, sum(case when first = step then n else 0 end) as removed,
                     sum(case when first < step and contains(bad, substr(filter_order, step, 1)) then n else 0 end) as redundant,
                     sum(case when bad = substr(filter_order, step, 1) then n else 0 end) as unique_fails,
                     sum(case when first = step then good else 0 end) as good_lost, sum(case when first = step then toxic else 0 end) as toxic_lost
              from gone, (select unnest([1, 2, 3, 4, 5]) as step) group by part, filter_order, step)
    select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
           cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
           cast(sum(removed) over (partition by part, f) as bigint) as shapley from steps"""


def centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round is a pair of relations: the assignment and the moved centroids. Distances are exact in doubles at these sizes."""
    ctes = [
        """v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select cast(row_number() over (order by sha256('2:' || cast(vec_id as varchar)), q) - 1 as integer) as cluster, q from v order by sha256('2:' || cast(vec_id as varchar)), q limit {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} as materialized (select r, first(cluster order by d, cluster) as cluster, min(d) as d from
            (select v.r, c.cluster, list_dot_product(v.q, v.q) - 2 * list_dot_product(v.q, c.q) + list_dot_product(c.q, c.q) as d from v, c{i} c) group by r)""")
        if i < rounds:
            ctes.append(f"""m{i} as (select a.cluster, p, floor(sum(v.q[p]) / count(*)) as x from v join a{i} a using (r), (select unnest(generate_series(1, 64)) as p) group by a.cluster, p)""")
            ctes.append(f"""c{i + 1} as materialized (select c.cluster, coalesce(n.q, c.q) as q from c{i} c left join (select cluster, list(x order by p) as q from m{i} group by cluster) n using (cluster))""")
    return f"""with {", ".join(ctes)}
        select v.vec_id, a.cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
               sha256(array_to_string(list_transform(c.q, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
        from v join a{rounds} a using (r) join c{rounds} c using (cluster)"""


ORACLE_SQL["op13_centroids"] = centroid_sql()


def secret_sql(max_docs: int = secrets.MAX_DOCS, threshold: int = secrets.THRESHOLD) -> str:
    """Patterns, training and scores once more. Letters of the keywords are spelt in both cases: (?i) folds more than ASCII here."""
    both = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(both(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = "(?:" + words + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    access, hex_, run, short = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", "[A-Za-z0-9+/_-]{16,}={0,2}", "[A-Za-z0-9+/_-]{8,}={0,2}"
    letters = secrets.ALPHABET

    def spans(name: str, pattern: str) -> str:
        return f"""{name} as materialized (select r, h, cast(e - length(h) as bigint) as s, cast(e as bigint) as e from (
            select r, h, sum(length(g) + length(h)) over (partition by r order by i) as e from (
                select r, unnest(hits) as h, unnest(gaps[1:len(hits)]) as g, unnest(range(len(hits))) as i
                from (select r, regexp_extract_all(t, '{pattern}') as hits, string_split_regex(t, '{pattern}') as gaps from d))))"""

    pairs = f"case when i = 1 then 0 else instr('{letters}', v[i - 1]) end as last, instr('{letters}', v[i]) as next"
    return rf"""
        with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
        {spans('assigns', assign)}, {spans('accesses', access)}, {spans('hexes', hex_)}, {spans('runs', run)},
        base as materialized (select r, 0 as rank, s, e from assigns where length(regexp_extract(h, '{assign}', 1)) >= 8
                 union all select r, 1, s, e from accesses union all select r, 2, s, e from hexes),
        sample as materialized (select doc_id, t from d where md5(cast(doc_id as varchar)) <= (select max(h) from (select md5(cast(doc_id as varchar)) as h from d where doc_id is not null order by h limit {max_docs}))),
        made as (select unnest([substr(x, 1, 40), to_base64(unhex(x)), upper(regexp_replace(to_base64(unhex(x)), '[+/=]', '', 'g'))]) as v from (select sha256(cast(doc_id as varchar)) as x from sample)),
        labelled as (select v, true as secret from made
                     union all select v, true from (select unnest(regexp_extract_all(t, '{assign}', 1)) as v from sample) where length(v) >= 8
                     union all select unnest(regexp_extract_all(t, '{access}')), true from sample union all select unnest(regexp_extract_all(t, '{hex_}')), true from sample
                     union all select unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '{assign}', ' ', 'g'), '{access}', ' ', 'g'), '{hex_}', ' ', 'g'), '{short}')), false from sample),
        counts as (select secret, last, next, count(*) as n from (select secret, {pairs} from (select secret, v, unnest(range(1, length(v) + 1)) as i from labelled)) group by all),
        grid as (select secret, a.x as last, b.x as next from (select unnest([true, false]) as secret) cross join range({len(letters) + 1}) a(x) cross join range({len(letters) + 1}) b(x)),
        cells as (select secret, last, next, coalesce(n, 0) as n from grid left join counts using (secret, last, next)),
        likely as (select secret, last, next, ln((n + {secrets.BACKOFF}::double * anywhere / sum(anywhere) over (partition by secret, last)) / (sum(n) over (partition by secret, last) + {secrets.BACKOFF}::double)) as p
                   from (select *, 1 + sum(n) over (partition by secret, next) as anywhere from cells)),
        scores as materialized (select x.last, x.next, cast(round(1000 * (x.p - y.p)) as bigint) as score from likely x join likely y using (last, next) where x.secret and not y.secret),
        random as (select r, 3 as rank, s, e from (select r, s, e, sum(score) as score from (select r, s, e, {pairs} from (select r, s, e, h as v, unnest(range(1, length(h) + 1)) as i from runs)) join scores using (last, next) group by r, s, e) q
                   where score >= {threshold} and not exists (select 1 from base b where b.r = q.r and b.s < q.e and q.s < b.e)),
        every as (select *, ['assign', 'access', 'hex', 'random'][rank + 1] || ':' || s || ':' || e as named from (select * from base union all select * from random)),
        per as (select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, count(*) filter (rank = 3) as n_random,
                       coalesce(string_agg(named, ',' order by s, rank, e) filter (rank < 3), '') as joined, string_agg(named, ',' order by s, rank, e) as spans from every group by r)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(joined, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_random, 0) as n_random
        from d left join per using (r)"""


ORACLE_SQL["op12_secret_scan"] = secret_sql()
