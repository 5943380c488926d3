"""Feature blocks, sampling, fusion, evaluation and output plans over the candidates of the catalogue.

Every window is keyed (by query, source or destination) and every frame is a running one, so a hot key costs one external sort and a
linear pass; scalars (cuts, maxima) are one-row aggregates."""

# Linear rule weights of the two data set families, in the order pair, exact, pop, recent, trend, recency, transition, unknown.
RULE_A = (1.45, 1.15, 0.85, 1.00, 0.45, 0.45, 0.25, -0.20)
# The same for the other family, whose pop is capped.
RULE_B = (-0.28, -0.08, 1.00, 1.15, 0.50, 0.65, 0.10, -0.80)
# Published fusion weights of two members, and the cap of the popularity.
BLEND, POP_CAP = (0.70, 0.30), 0.72

FIT = """mx as (select min(t) as tmin, max(t) as tmax, {pct60} as c60, {pct82} as c82 from edges),
 ds as (select dst, count(*) as n, cast(sum(case when t >= c82 then 1 else 0 end) as bigint) as r, cast(sum(case when t >= c60 and t < c82 then 1 else 0 end) as bigint) as m, cast(sum(case when t < c60 then 1 else 0 end) as bigint) as o,
  cast(sum(case when t >= tmax - 10800 then 1 else 0 end) as bigint) as n3, cast(sum(case when t >= tmax - 43200 then 1 else 0 end) as bigint) as n12, max(t) as last_t from edges cross join mx group by dst),
 pr as (select src, dst, count(*) as n from edges group by src, dst),
 tc as (select c, count(*) as n from cand group by c),
 sm as (select greatest(ln(1 + max(n)), 1) as ld, greatest(ln(1 + max(r)), 1) as lr, greatest(ln(1 + max(n3)), 1) as l3, greatest(ln(1 + max(n12)), 1) as l12 from ds),
 sp as (select greatest(ln(1 + max(n)), 1) as lp from pr), st as (select greatest(ln(1 + max(n)), 1) as lt from tc),
 seen as (select src, dst, min(rk) as rk from (select src, dst, row_number() over (partition by src order by o desc) as rk from ord) x where rk <= 160 group by src, dst),
 fx as (select cand.qid, cand.pos, cand.src, cand.c, cand.t, cand.y, coalesce(ds.n, 0) as s, coalesce(ds.r, 0) as r, coalesce(ds.m, 0) as m, coalesce(ds.o, 0) as o, coalesce(n3, 0) as n3, coalesce(n12, 0) as n12, last_t, coalesce(pr.n, 0) as pn, coalesce(tc.n, 0) as tn, seen.rk as rk
  from cand left join ds on cand.c = ds.dst left join tc on cand.c = tc.c left join pr on cand.src = pr.src and cand.c = pr.dst left join seen on cand.src = seen.src and cand.c = seen.dst),
 f as (select qid, pos, src, c, t, y, round(ln(1 + s) / ld, 9) as pop, round(ln(1 + r) / lr, 9) as recent_pop, round(greatest(-5, least(5, ln(1 + r) - ln(1 + m + 0.25 * o))) / 5, 9) as trend,
  round(case when last_t is null then 0 else 1 / (1 + greatest(t - last_t, 0) / cast(greatest(tmax - tmin, 1) as double)) end, 9) as recency, round(coalesce(1 / sqrt(rk), 0), 9) as exact_rank, round(ln(1 + pn) / lp, 9) as pair_log,
  case when s > 0 then 1 else 0 end as known, round(ln(1 + tn) / lt, 9) as test_seen, round(ln(1 + n3) / l3, 9) as pop_3h, round(ln(1 + n12) / l12, 9) as pop_12h, round(greatest(-5, least(5, ln(1 + n3) - ln(1 + n12 / 4e0))) / 5, 9) as trend_3h_12h, case when pn > 0 then 1 else 0 end as pair_seen
  from fx cross join mx cross join sm cross join sp cross join st)"""

# Steps up to 16 apart in one source's history, weighted by distance; at most 256 successors each.
STEP = """step as (select a, b, w from (select a, b, w, row_number() over (partition by a order by round(w, 6) desc, b) as rk from (select x.dst as a, y.dst as b, sum(1 / sqrt(y.o - x.o)) as w from ord x join ord y on x.src = y.src and y.o - x.o between 1 and 16 and x.dst <> y.dst group by x.dst, y.dst) z) v where rk <= 256),
 late as (select src, dst, rk from (select src, dst, row_number() over (partition by src order by o desc) as rk from ord) x where rk <= 16),
 want as (select distinct src, c from cand),
 fwd as (select l.src, s.b as c, sum(s.w / sqrt(l.rk)) as w from late l join step s on l.dst = s.a group by l.src, s.b),
 bwd as (select l.src, s.a as c, sum(s.w / sqrt(l.rk)) as w from late l join step s on l.dst = s.b group by l.src, s.a),
 tr as (select want.src, want.c, coalesce(fwd.w, 0) as fw, coalesce(bwd.w, 0) as bw from want left join fwd on want.src = fwd.src and want.c = fwd.c left join bwd on want.src = bwd.src and want.c = bwd.c)"""

# A probe counts, and dates the last of, the edges of its key strictly before its time: running frames only.
PROBE = """ask as (select qid, pos, src, c, t from cand),
 pd as (select c as k, t as ts0, qid, pos, 0 as kind, 0 as e from ask union all select c, greatest(t - 604800, 0), qid, pos, 7, 0 from ask union all select c, greatest(t - 2592000, 0), qid, pos, 30, 0 from ask union all select dst, t, null, null, -1, 1 from edges where t > 0),
 wd as (select qid, pos, kind, coalesce(sum(e) over w, 0) as n, max(case when e = 1 then ts0 end) over w as last_t from pd window w as (partition by k order by ts0, e rows between unbounded preceding and 1 preceding)),
 gd as (select qid, pos, cast(max(case when kind = 0 then n end) - max(case when kind = 7 then n end) as bigint) as n7, cast(max(case when kind = 0 then n end) - max(case when kind = 30 then n end) as bigint) as n30, max(case when kind = 0 then last_t end) as last_d from wd where kind >= 0 group by qid, pos),
 pp as (select src, c as k, t as ts0, qid, pos, 0 as e from ask union all select src, dst, t, null, null, 1 from edges where t > 0),
 gp as (select * from (select qid, pos, e, max(case when e = 1 then ts0 end) over (partition by src, k order by ts0, e rows between unbounded preceding and 1 preceding) as last_p from pp) x where e = 0),
 ps as (select src as k, t as ts0, qid, 0 as e from qq union all select src, t, null, 1 from edges where t > 0),
 gs as (select * from (select qid, e, max(case when e = 1 then ts0 end) over (partition by k order by ts0, e rows between unbounded preceding and 1 preceding) as last_s from ps) x where e = 0)"""

# Every (source, candidate), seen or not: how the candidate co-occurs with each item of the source's distinct history.
CF = """d as (select distinct src, dst from edges), g as (select dst, count(*) as g from d group by dst), hl as (select src, count(*) as len from d group by src),
 co as (select x.dst as a, y.dst as b, count(*) as n from d x join d y on x.src = y.src and x.dst <> y.dst group by x.dst, y.dst),
 pairs as (select distinct src, c from cand),
 cf as (select p.src, p.c, cast(sum(n) as bigint) as raw, sum(n / sqrt(ga.g * gb.g)) as cos, count(*) as hit, max(n) as top from pairs p join d h on p.src = h.src join co on co.a = h.dst and co.b = p.c join g ga on ga.dst = h.dst join g gb on gb.dst = p.c group by p.src, p.c)"""

TWO = "two as (select qid, pos, c, y, src, pair_seen, pop as x1, recent_pop as x2, row_number() over (partition by qid order by pop, pos) / 10e0 as p1, row_number() over (partition by qid order by recent_pop, pos) / 10e0 as p2, row_number() over (partition by qid order by pop desc, pos) as d1, row_number() over (partition by qid order by recent_pop desc, pos) as d2 from f)"
PROB = """raw as (select qid, pos, exp(cast(s - max(s) over (partition by qid) as double)) as e from sc), near as (select qid, pos, round(e / sum(e) over (partition by qid), 8) as p from raw),
 first_best as (select *, row_number() over (partition by qid order by p desc, pos) as k, sum(p) over (partition by qid) as total from near), prob as (select qid, pos, round(greatest(0, least(1, case when k = 1 then p + 1 - total else p end)), 8) as p from first_best)"""


def rule(w, pop):
    return f"round({w[0]} * pair_log + {w[1]} * exact_rank + {w[2]} * {pop} + {w[3]} * recent_pop + {w[4]} * trend + {w[5]} * recency + {w[6]} * fw + {w[7]} * (1 - known), 6)"


def hits(score, extra=""):
    """One row per query: how many candidates score above, and as high as, the positive."""
    return f"(select qid{extra}, cast(sum(case when {score} > p then 1 else 0 end) as double) as g, cast(sum(case when {score} = p and pos > 0 then 1 else 0 end) as double) as e from (select *, max(case when pos = 0 then {score} end) over (partition by qid) as p from f) x group by qid{extra}) h"


def plans(cand, ord_):
    base, rec = f"{cand}, {ord_}, {FIT}", f"{cand}, {PROBE}"
    z = lambda x: f"({x} - avg({x}) over w) / case when stddev_pop({x}) over w >= 1e-6 then stddev_pop({x}) over w else 1 end"
    gap = lambda x: f"ln(1 + coalesce(t - {x} + 1e0, 1e10))"
    never = "case when t <= 0 then ln(1 + 1e10) else {} end"
    col = lambda x, name: f"{never.format(x)} as {name}"
    return {
        "edge_scan": ("", "select src, dst, t, k1, k2, k3 from edges"),
        "edge_row_count": ("", "select count(*) as n, count(distinct src) as n_src, count(distinct dst) as n_dst, min(t) as t_min, max(t) as t_max from edges"),
        "candidates_long": (cand, "select qid, pos, src, t, c, y from cand"),
        "sharded_frequency": (cand, "select c, cast(sum(n) as bigint) as n from (select c, count(*) as n from cand where pos < 5 group by c union all select c, count(*) as n from cand where pos >= 5 group by c) x group by c"),
        "base_features": (base, f"select qid, pos, pop, recent_pop, trend, recency, exact_rank, pair_log, known, least(pop, {POP_CAP}) as degree_cap, test_seen, pop_3h, pop_12h, trend_3h_12h from f"),
        "base_feature_ranks": (base, "select qid, pos, round(1e0 / rank() over (partition by qid order by pop desc), 6) as rank_pop, round(1e0 / rank() over (partition by qid order by recent_pop desc), 6) as rank_recent_pop, round(1e0 / rank() over (partition by qid order by pair_log desc), 6) as rank_pair, round(1e0 / rank() over (partition by qid order by recency desc), 6) as rank_recency, round(1e0 / rank() over (partition by qid order by pop_3h desc), 6) as rank_pop_3h from f"),
        "transition_scores": (f"{cand}, {ord_}, {STEP}", "select src, c, round(fw, 6) as transition, round(fw + bw, 6) as symmetric_cooc from tr"),
        "rule_scores": (f"{base}, {STEP}", f"select qid, pos, {rule(RULE_A, 'pop')} as rule_a, {rule(RULE_B, f'least(pop, {POP_CAP})')} as rule_b from f join tr on f.src = tr.src and f.c = tr.c"),
        "recency_block": (rec, f"select ask.qid, ask.pos, {col('ln(1 + n30)', 'cnt30')}, {col('ln(1 + n7)', 'cnt7')}, {col('ln(n7 + 0.5e0 + 1) - ln(n30 + 0.5e0 + 1)', 'burst')}, {col(gap('last_d'), 'gap_dst')}, {col(gap('last_p'), 'gap_pair')}, {col(gap('last_s'), 'gap_src')} from ask join gd on ask.qid = gd.qid and ask.pos = gd.pos join gp on ask.qid = gp.qid and ask.pos = gp.pos join gs on ask.qid = gs.qid"),
        "cf_pair_block": (f"{cand}, {CF}", "select cand.qid, cand.pos, coalesce(round(ln(1 + raw), 6), 0) as cooc_sum, coalesce(round(ln(1 + cos), 6), 0) as cooc_cos, coalesce(round(hit / cast(len as double), 6), 0) as coverage, coalesce(round(ln(1 + top), 6), 0) as cooc_max, coalesce(round(ln(1 + len), 6), 0) as hist_len from cand left join hl on cand.src = hl.src left join cf on cand.src = cf.src and cand.c = cf.c"),
        "cooc_capped_topk": (f"{ord_}, l as (select src, dst, row_number() over (partition by src order by max(o) desc) as rk from ord group by src, dst), k as (select src, dst from l where rk <= 64)", "select a, b, n, round(ln(1 + n) / max(ln(1 + n)) over (partition by a), 6) as w, cast(rk as bigint) as rk from (select *, row_number() over (partition by a order by n desc, b) as rk from (select x.dst as a, y.dst as b, count(*) as n from k x join k y on x.src = y.src and x.dst <> y.dst group by x.dst, y.dst having count(*) >= 2) z) v where rk <= 128"),
        "degree_heuristics": ("g as (select dst, count(*) as n, count(distinct src) as d from edges group by dst), m as (select max(n) as mn, max(d) as md from g)", "select dst, round(n / cast(mn as double), 6) as popularity, round(d / cast(md as double), 6) as degree from g cross join m"),
        "edge_count_scaled": ("pr as (select src, dst, count(*) as n from edges group by src, dst), top as (select max(n) as m from pr)", "select src, dst, round(n / cast(m as double), 6) as edge_count from pr cross join top"),
        "source_activity": (f"{ord_}, l as (select src, dst, o, row_number() over (partition by src order by o desc) as rk from ord), a as (select src, max(o) as n from ord group by src), m as (select greatest(ln(1 + max(n)), 1) as lm from a)", "select a.src, round(ln(1 + max(a.n)) / max(lm), 6) as activity, round(count(distinct dst) / cast(count(*) as double), 6) as coverage, round(count(*) / 64e0, 6) as fill from a join l on a.src = l.src cross join m where rk <= 64 group by a.src"),
        "audience_hits": (f"{cand}, r as (select dst, src from (select dst, src, row_number() over (partition by dst order by t desc, src desc, k1 desc, k2 desc, k3 desc) as rk from edges) x where rk <= 64), a as (select dst, count(*) as n from r group by dst), m as (select greatest(ln(1 + max(n)), 1) as lm from a), u as (select distinct dst, src from r)", "select qid, pos, case when u.src is null then 0 else 1 end as recent_source_hit, round(ln(1 + coalesce(n, 0)) / lm, 6) as audience_count from cand left join u on cand.c = u.dst and cand.src = u.src left join a on cand.c = a.dst cross join m"),
        "heuristic_scorer": (f"{cand}, mx as (select max(t) as tm from edges), a as (select dst, sum(exp(-(tm - t) / 2592000e0)) as w from edges cross join mx where t >= tm - 7776000 group by dst), b as (select c, cast(count(*) as double) as w, sum(exp(-(tm - t) / 5184000e0)) as v from cand cross join mx group by c), ids as (select dst as u from a union select c from b), j as (select u, ln(1 + coalesce(a.w, 0)) as x1, ln(1 + coalesce(b.w, 0)) as x2, ln(1 + coalesce(b.v, 0)) as x3 from ids left join a on u = a.dst left join b on u = b.c), sd as (select avg(x1) as a1, avg(x2) as a2, avg(x3) as a3, stddev_pop(x1) as s1, stddev_pop(x2) as s2, stddev_pop(x3) as s3 from j)", "select u, round((x1 - a1) / case when s1 > 1e-12 then s1 else 1 end + (x2 - a2) / case when s2 > 1e-12 then s2 else 1 end + (x3 - a3) / case when s3 > 1e-12 then s3 else 1 end, 5) as score from j cross join sd"),
        "global_zscore": ("c as (select dst, ln(1 + count(*)) as x from edges group by dst), s as (select avg(x) as a, stddev_pop(x) as d from c)", "select dst, round((x - a) / case when d > 1e-12 then d else 1 end, 6) as z from c cross join s"),
        "row_zscore_floor": (cand, "select qid, pos, round((s - avg(s) over w) / greatest(stddev_pop(s) over w, 1e-6), 6) as z from sc window w as (partition by qid)"),
        "linear_score": (base, f"select qid, pos, round({z('pop')} + 0.5 * ({z('recent_pop')}) + 0.25 * ({z('pair_log')}), 5) as score from f window w as (partition by qid)"),
        "probability_rows": (f"{cand}, {PROB}", "select qid, pos, p from prob"),
        "probability_text": (f"{cand}, {PROB}", "select qid, pos, cast(round(p * 100000000) as bigint) as units, md5(concat_ws(',', qid, pos, cast(round(p * 100000000) as bigint))) as digest from prob"),
        "output_validator": (f"{cand}, {PROB}, per as (select qid, count(*) as k, sum(p) as total, min(p) as lo, max(p) as hi from prob group by qid)", "select count(*) as n, cast(sum(case when k <> 10 or lo < -1e-12 or hi > 1 + 1e-12 or abs(total - 1) > 1e-5 then 1 else 0 end) as bigint) as bad, min(case when k <> 10 or lo < -1e-12 or hi > 1 + 1e-12 or abs(total - 1) > 1e-5 then qid end) as first_bad, round(min(total), 6) as sum_min, round(max(total), 6) as sum_max, round(min(lo), 6) as p_min, round(max(hi), 6) as p_max from per"),
        "fixed_grid": (cand, "select qid, pos, cast(round((case when hi = lo then 0.5e0 else 0.01e0 + 0.99e0 * (s - lo) / cast(hi - lo as double) end) * 10000) as bigint) as tenthousandths from (select *, min(s) over (partition by qid) as lo, max(s) over (partition by qid) as hi from sc) x"),
        "prediction_entropy": (f"{cand}, {PROB}", "select round(avg(h), 6) as entropy, count(*) as n from (select qid, -sum(case when p > 0 then p * ln(p) else 0 end) as h from prob group by qid) x"),
        "known_histogram": (cand, "select known, count(*) as n from (select qid, cast(sum(case when s > 0 then 1 else 0 end) as bigint) as known from sc group by qid) x group by known"),
        "top1_margin": (f"{cand}, {PROB}, shares as (select qid, pos, e / sum(e) over (partition by qid) as p from raw), places as (select qid, p, row_number() over (partition by qid order by p desc, pos) as k from shares)", "select qid, max(case when k = 1 then p end) - max(case when k = 2 then p end) as margin from places group by qid"),
        "top1_change": (f"{base}, {TWO}", "select count(*) as n, round(avg(case when a = b then 0e0 else 1e0 end), 6) as changed from (select qid, max(case when d1 = 1 then c end) as a, max(case when d2 = 1 then c end) as b from two group by qid) x"),
        "top1_summary": (f"{base}, {TWO}", "select count(*) as n, count(distinct c) as n_top, round(avg(x1), 6) as mean, round({pct x1 0.5}, 6) as median, round({pct x1 0.95}, 6) as p95 from two where d1 = 1"),
        "top3_jaccard": (f"{base}, {TWO}", "select round(avg(shared / (6e0 - shared)), 6) as jaccard, count(*) as n from (select qid, cast(sum(case when d1 <= 3 and d2 <= 3 then 1 else 0 end) as double) as shared from two group by qid) x"),
        "row_pearson": (f"{base}, {TWO}", "select count(*) as n, round(avg(r), 5) as pearson from (select qid, corr(x1, x2) as r from two group by qid having stddev_pop(x1) > 1e-9 and stddev_pop(x2) > 1e-9) x"),
        "rank_blend": (f"{base}, {TWO}", f"select qid, pos, round({BLEND[0]} * p1 + {BLEND[1]} * p2, 6) as score from two"),
        "gated_blend": (f"{base}, {TWO}", f"select qid, pos, round(case when pair_seen = 1 then p1 else {BLEND[0]} * p1 + {BLEND[1]} * p2 end, 6) as score from two"),
        "residual_blend": (f"{base}, {TWO}", "select qid, pos, round(x1 + 0.25 * (x2 - x1), 6) as score from two"),
        "hit_rates": (base, f"select round(avg(1e0 / (1 + g)), 6) as mrr, round(avg(case when g < 1 then 1e0 else 0e0 end), 6) as hit1, round(avg(case when g < 3 then 1e0 else 0e0 end), 6) as hit3, {{pct g 0.5}} + 1 as median_rank from {hits('pop')}"),
        "grouped_mrr": (f"{base}, gr as (select qid, max(case when pos = 0 then known end) as grp from f group by qid)", f"select grp, count(*) as n, round(avg(1e0 / (1 + g + 0.5 * e)), 6) as mrr from {hits('recency')} join gr on h.qid = gr.qid group by grp"),
        "component_mrr": (base, " union all ".join(f"select '{x}' as component, round(avg(1e0 / (1 + g + 0.5 * e)), 6) as mrr from {hits(x)}" for x in ("pop", "recent_pop", "trend", "recency", "exact_rank", "pair_log", "test_seen"))),
        "weight_grid_step": (f"{base}, grid as (select 0e0 as wt union all select 0.25e0 union all select 0.5e0 union all select 1e0 union all select 2e0), sw as (select wt, qid, pos, round(pop + wt * recent_pop, 6) as x from f cross join grid)", "select wt, round(avg(1e0 / (1 + g + 0.5 * e)), 6) as mrr from (select wt, qid, sum(case when x > p then 1e0 else 0e0 end) as g, sum(case when x = p and pos > 0 then 1e0 else 0e0 end) as e from (select *, max(case when pos = 0 then x end) over (partition by wt, qid) as p from sw) v group by wt, qid) u group by wt"),
        "quantile_bins": ("c as (select dst, cast(count(*) as double) as n from edges group by dst), e as (select {pct n 0.2} as q1, {pct n 0.4} as q2, {pct n 0.6} as q3, {pct n 0.8} as q4 from c)", "select bin, count(*) as dsts, cast(sum(n) as bigint) as total from (select n, case when n >= q1 then 1 else 0 end + case when n >= q2 and q2 > q1 then 1 else 0 end + case when n >= q3 and q3 > q2 then 1 else 0 end + case when n >= q4 and q4 > q3 then 1 else 0 end as bin from c cross join e) x group by bin"),
        "hot_list": ("", "select dst, count(*) as n from edges group by dst order by n desc, dst limit 100"),
        "weighted_sample": ("c as (select dst, count(*) as n from edges group by dst), s as (select distinct src from edges), h as (select src, dst, n, (src * 7919 + dst * 104729 + n * 31) % 1000003 as u from edges join c using (dst) group by src, dst, n)", "select src, dst, cast(rk as bigint) as rk from (select src, dst, row_number() over (partition by src order by round(ln((u + 1) / 1000005e0) / n, 9) desc, dst) as rk from h) x where rk <= 8"),
        "history_lags": (ord_, "select src, cast(o as bigint) as o, coalesce(lag(dst, 1) over w, 0) as h1, coalesce(lag(dst, 2) over w, 0) as h2, coalesce(lag(dst, 3) over w, 0) as h3, coalesce(round(ln(1 + greatest(t - lag(t, 1) over w, 0)) / 10, 6), 0) as g1, coalesce(round(ln(1 + greatest(t - lag(t, 2) over w, 0)) / 10, 6), 0) as g2 from ord window w as (partition by src order by o)"),
        "gap_percentiles": (f"{ord_}, g as (select t - lag(t) over (partition by src order by o) as gap from ord)", "select {pct gap 0.5} as p50, {pct gap 0.9} as p90, count(*) as n from g where gap > 0"),
    }
