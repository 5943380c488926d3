"""Query catalogue: each plan is declared once in SQL that both Spark and the test oracle accept."""
import re
from functools import partial

from chronorank.sources import store
from chronorank.sources.tables import DUCK_TIME, EDGES, SPARK_TIME, run

# Queries: every edge, with 9 arithmetic candidates besides the positive; pos is part of a candidate's identity.
ORD = "ord as (select *, row_number() over (partition by src order by t, dst, k1, k2, k3) as o from edges)"
CAND = """top as (select max(dst) as m from edges),
 qq as (select distinct concat_ws('-', k1, k2, dst, k3) as qid, k1 * 31 + k2 * 7 + dst + k3 as h, src, dst as pos_dst, t from edges),
 slots as (select 0 as pos union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9),
 cand as (select qid, src, t, pos, case when pos = 0 then pos_dst else (h * 7919 + pos * 104729 + 31) % (m + 1) end as c, case when pos = 0 then 1 else 0 end as y from qq cross join slots cross join top),
 cnt as (select dst, count(*) as n from edges group by dst),
 sc as (select qid, pos, c, y, coalesce(n, 0) as s from cand left join cnt on c = cnt.dst)"""

PLANS = {
    "dst_popularity_scaled": ("d as (select dst, count(*) as n from edges group by dst), m as (select greatest(ln(1 + max(n)), 1) as m from d)", "select dst, round(ln(1 + n) / m, 6) as pop from d cross join m"),
    "src_counts_last_time": ("", "select src, count(*) as n, max(t) as last_t, count(distinct dst) as n_dst from edges group by src"),
    "pair_counts": ("", "select src, dst, count(*) as n, max(t) as last_t from edges group by src, dst"),
    "dst_degree_distinct": ("", "select dst, count(distinct src) as degree from edges group by dst"),
    "bucketed_trend": ("cut as (select {pct60} as c60, {pct82} as c82 from edges)", "select dst, round(greatest(-5, least(5, ln(1 + r) - ln(1 + m + 0.25 * o))) / 5, 6) as trend, r, m, o from (select dst, cast(sum(case when t >= c82 then 1 else 0 end) as bigint) as r, cast(sum(case when t >= c60 and t < c82 then 1 else 0 end) as bigint) as m, cast(sum(case when t < c60 then 1 else 0 end) as bigint) as o from edges cross join cut group by dst) x"),
    "trailing_window_pop": ("mx as (select max(t) as tm from edges)", "select dst, cast(sum(case when t >= tm - 7776000 then 1 else 0 end) as bigint) as n90, cast(sum(case when t >= tm - 31536000 then 1 else 0 end) as bigint) as n365 from edges cross join mx group by dst"),
    "decayed_popularity": ("mx as (select max(t) as tm from edges)", "select dst, round(sum(exp(-(tm - t) / (30 * 86400.0))), 6) as w from edges cross join mx where t >= tm - 7776000 group by dst"),
    "dedupe_keep_last": (ORD, "select src, dst, max(o) as last_o from ord group by src, dst"),
    "window_counts_7d_30d": ("", "select dst, k1, k2, k3, src, t, count(*) over (partition by dst order by t range between 604800 preceding and 1 preceding) as n7, count(*) over (partition by dst order by t range between 2592000 preceding and 1 preceding) as n30 from edges"),
    "recency_pair_asof": ("", "select src, dst, k1, k2, k3, t, max(t) over (partition by src, dst order by t range between unbounded preceding and 1 preceding) as prev_t from edges"),
    "recency_dst_asof": ("", "select src, dst, k1, k2, k3, t, round(ln(1 + coalesce(t - max(t) over (partition by dst order by t range between unbounded preceding and 1 preceding) + 1, 10000000000)), 6) as gap from edges"),
    "recency_src_asof": ("", "select src, dst, k1, k2, k3, t, round(ln(1 + coalesce(t - max(t) over (partition by src order by t range between unbounded preceding and 1 preceding) + 1, 10000000000)), 6) as gap from edges"),
    "history_last_n": (ORD, "select src, dst, t, cast(rk as bigint) as rk from (select src, dst, t, row_number() over (partition by src order by o desc) as rk from ord) x where rk <= 16"),
    "gap_per_src": (ORD, "select src, cast(o as bigint) as o, t - lag(t) over (partition by src order by o) as gap from ord"),
    "src_recent_exact": (ORD, "select src, dst, round(1 / sqrt(min(rk)), 6) as w from (select src, dst, row_number() over (partition by src order by o desc) as rk from ord) x where rk <= 160 group by src, dst"),
    "transition_topk": (ORD, "select a, b, round(w, 6) as w, cast(rk as bigint) as rk from (select a, b, w, row_number() over (partition by a order by round(w, 6) desc, b) as rk from (select x.dst as a, y.dst as b, sum(1 / sqrt(y.o - x.o)) as w from ord x join ord y on x.src = y.src and y.o - x.o between 1 and 16 and x.dst <> y.dst group by x.dst, y.dst) z) v where rk <= 256"),
    "cooc_exact": ("d as (select distinct src, dst from edges)", "select x.dst as a, y.dst as b, count(*) as n from d x join d y on x.src = y.src and x.dst < y.dst group by x.dst, y.dst having count(*) >= 2"),
    "mrr_three_rules": (CAND, "select round(avg(1 / (1 + g + 0.5 * e)), 6) as mrr_half, round(avg(1e0 / (1 + g + e)), 6) as mrr_pessimistic, round(avg(1e0 / (1 + g)), 6) as mrr_strict, count(*) as n from (select qid, cast(sum(case when s > p then 1 else 0 end) as double) as g, cast(sum(case when s = p and pos > 0 then 1 else 0 end) as double) as e from (select *, max(case when pos = 0 then s end) over (partition by qid) as p from sc) x group by qid) z"),
    "rank_competition": (CAND, "select qid, pos, round(1.0 / rank() over (partition by qid order by s desc), 6) as r from sc"),
    "rank_percentile_col": (CAND, "select qid, pos, round(row_number() over (partition by qid order by s, pos) / 10.0, 6) as r from sc"),
    "rank_percentile_id": (CAND, "select qid, pos, round(row_number() over (partition by qid order by s, c, pos) / 10.0, 6) as r from sc"),
    "row_zscore": (CAND, "select qid, pos, round((s - avg(s) over w) / case when stddev_pop(s) over w >= 1e-6 then stddev_pop(s) over w else 1 end, 6) as z from sc window w as (partition by qid)"),
    "row_softmax": (CAND, "select qid, pos, round(e / sum(e) over (partition by qid), 6) as p from (select qid, pos, exp(cast(s - max(s) over (partition by qid) as double)) as e from sc) x"),
    "row_minmax": (CAND, "select qid, pos, case when hi = lo then 0.5 else round(0.01 + 0.99 * (s - lo) / cast(hi - lo as double), 6) end as v from (select *, min(s) over (partition by qid) as lo, max(s) over (partition by qid) as hi from sc) x"),
    "candidate_frequency": (CAND, "select c, count(*) as n from cand group by c"),
}


from chronorank.plans import blocks, dealt, lean, probed, slots  # noqa: E402  (its plans build on the names above)

PLANS |= blocks.plans(CAND, ORD)
LEAN = lean.QUERIES | slots.QUERIES | dealt.QUERIES | probed.QUERIES


CAND_ROWS = re.search(r"cand as \(.*? cross join top\)", CAND)[0]

# Oracles that are written apart from their query.
APART = {
    "recency_block": f"""{CAND}, ev as (select cand.qid, cand.pos, cand.t, count(e.t) filter (e.t >= greatest(cand.t - 604800, 0)) as n7, count(e.t) filter (e.t >= greatest(cand.t - 2592000, 0)) as n30, max(e.t) as ld from cand left join edges e on e.dst = cand.c and e.t > 0 and e.t < cand.t group by cand.qid, cand.pos, cand.t),
 lp as (select cand.qid, cand.pos, max(e.t) as lp from cand join edges e on e.src = cand.src and e.dst = cand.c and e.t > 0 and e.t < cand.t group by cand.qid, cand.pos), ls as (select qq.qid, max(e.t) as ls from qq join edges e on e.src = qq.src and e.t > 0 and e.t < qq.t group by qq.qid)
 select ev.qid, ev.pos, ln(1 + n30) as cnt30, ln(1 + n7) as cnt7, ln(1.5e0 + n7) - ln(1.5e0 + n30) as burst, ln(1 + coalesce(t - ld + 1, 1e10)) as gap_dst, ln(1 + coalesce(t - lp + 1, 1e10)) as gap_pair, ln(1 + coalesce(t - ls + 1, 1e10)) as gap_src from ev left join lp on ev.qid = lp.qid and ev.pos = lp.pos left join ls on ev.qid = ls.qid""",
    "window_counts_7d_30d": "select a.dst, a.k1, a.k2, a.k3, a.src, a.t, count(b.t) filter (b.t >= a.t - 604800) as n7, count(b.t) as n30 from (select *, row_number() over () as rid from edges) a left join edges b on b.dst = a.dst and b.t < a.t and b.t >= a.t - 2592000 group by a.rid, a.dst, a.k1, a.k2, a.k3, a.src, a.t",
    "recency_pair_asof": "select a.src, a.dst, a.k1, a.k2, a.k3, a.t, max(b.t) as prev_t from (select *, row_number() over () as rid from edges) a left join edges b on b.src = a.src and b.dst = a.dst and b.t < a.t group by a.rid, a.src, a.dst, a.k1, a.k2, a.k3, a.t",
    "recency_dst_asof": "select a.src, a.dst, a.k1, a.k2, a.k3, a.t, round(ln(1 + coalesce(a.t - max(b.t) + 1, 10000000000)), 6) as gap from (select *, row_number() over () as rid from edges) a left join edges b on b.dst = a.dst and b.t < a.t group by a.rid, a.src, a.dst, a.k1, a.k2, a.k3, a.t",
    "recency_src_asof": "select a.src, a.dst, a.k1, a.k2, a.k3, a.t, round(ln(1 + coalesce(a.t - max(b.t) + 1, 10000000000)), 6) as gap from (select *, row_number() over () as rid from edges) a left join edges b on b.src = a.src and b.t < a.t group by a.rid, a.src, a.dst, a.k1, a.k2, a.k3, a.t",
    "rank_competition": f"{CAND} select a.qid, a.pos, round(1e0 / (1 + count(b.s)), 6) as r from sc a left join sc b on a.qid = b.qid and b.s > a.s group by a.qid, a.pos",
    "rank_percentile_col": f"{CAND} select a.qid, a.pos, round(count(*) / 10e0, 6) as r from sc a join sc b on a.qid = b.qid and (b.s < a.s or b.s = a.s and b.pos <= a.pos) group by a.qid, a.pos",
    "src_recent_exact": f"{ORD}, l as (select src, max(o) as n from ord group by src), m as (select src, dst, max(o) as o from ord group by src, dst) select m.src, dst, round(1 / sqrt(n - o + 1), 6) as w from m join l on m.src = l.src where n - o < 160",
    "dedupe_keep_last": f"{ORD} select a.src, a.dst, a.o as last_o from ord a where not exists (select 1 from ord b where b.src = a.src and b.dst = a.dst and b.o > a.o)",
    "transition_topk": f"{ORD}, st as (select src, dst as b, o, unnest([{', '.join(f'lag(dst, {i}) over (partition by src order by o)' for i in range(1, 17))}]) as a, unnest(range(1, 17)) as d from ord), sm as (select a, b, sum(1 / sqrt(d)) as w from st where a is not null and a <> b group by a, b) select a, b, round(w, 6) as w, cast(rk as bigint) as rk from (select *, row_number() over (partition by a order by round(w, 6) desc, b) as rk from sm) v where rk <= 256",
}


def parts(name: str, spark: bool) -> tuple[str, str]:
    """The edge view and the text behind it."""
    head, body = PLANS[name]
    both = f"{', ' + head if head else ''} {body}"
    if not spark and name in APART:
        both = f", {APART[name]}" if re.match(r"\w+ as \(", APART[name]) else f" {APART[name]}"
    p = "percentile({}, {})" if spark else "quantile_cont({}, {})"
    both = both.replace("{pct60}", p.format("t", 0.60)).replace("{pct82}", p.format("t", 0.82))
    return EDGES.format(time=SPARK_TIME if spark else DUCK_TIME), re.sub(r"\{pct (\w+) ([\d.]+)\}", lambda m: p.format(m[1], m[2]), both)


def text(name: str, spark: bool) -> str:
    return "with " + "".join(parts(name, spark))


def ask(spark, sf_dir: str, name: str):
    """One query. Where the text names the edge view or the candidates more than once, they are written once and read."""
    edges, rest = parts(name, True)
    if len(re.findall(r"\bedges\b", rest)) < 2:
        return run(spark, sf_dir, f"with {edges}{rest}")
    known = {"edges": store.settled(run(spark, sf_dir, f"with {edges} select * from edges"))}
    if name in LEAN and (rows := LEAN[name](known["edges"])) is not None:
        return rows
    if CAND_ROWS in rest:
        known["cand"] = store.settled(spark.sql(f"with edges as (select * from {{edges}}), {CAND[: CAND.index(CAND_ROWS)]}{CAND_ROWS} select * from cand", edges=known["edges"]))
        rest = rest.replace(CAND_ROWS, "cand as (select * from {cand})")
    return spark.sql(f"with edges as (select * from {{edges}}){rest}", **known)


def queries() -> dict:
    return {n: partial(ask, name=n) for n in PLANS}


def oracle_sql() -> dict:
    return {n: text(n, False) for n in PLANS}
