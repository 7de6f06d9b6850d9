"""DuckDB SQL of the retrieval stages behind diffusion: runs, seeds, corridors, units and what is rendered of them."""

from __future__ import annotations

from .binding import CANDIDATES, RUNS, SEEDS, STEPS, TAU

CAP = max(2, TAU + 1)
Parts = dict[str, tuple[tuple[str, ...], str]]


def settled(x: str, digits: int = 6) -> str:
    return f"round({x} + {10.0 ** -(digits + 3)!r}::double, {digits})"


def spread(v: str, by: str, eps: str = "0") -> str:
    """To 0..1 over a group; without a span 1 if positive."""
    w = f"over (partition by {by})"
    return f"(case when max({v}) {w} - min({v}) {w} > {eps} then ({v} - min({v}) {w}) / (max({v}) {w} - min({v}) {w}) when max({v}) {w} > 0 then 1.0::double else 0.0::double end)"


def jaccard(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end)"


def coverage(nodes: str) -> str:
    return f"""select qid, run, {settled("avg(rate)")} coverage, {settled("stddev_pop(rate)")} anchor_dispersion from (
        select s.qid, s.run, a.source, avg(case when d.dist <= {TAU} then 1.0::double else 0.0 end) rate
        from {nodes} s join (select distinct qid, source from dist) a on a.qid = s.qid
        left join dist d on d.qid = s.qid and d.source = a.source and d.node = s.node group by all) group by all"""


def completeness(nodes: str) -> str:
    return f"""select r.qid, r.run, {settled("case when coalesce(n, 0) > 0 then coalesce(k, 0)::double / n else 0.0 end")} completeness
        from (select distinct qid, run from {nodes}) r
        left join (select qid, run, count(*) k from (select distinct s.qid, s.run, a.source l, b.source r from {nodes} s
            join dist a on a.qid = s.qid and a.node = s.node and a.dist <= {TAU}
            join dist b on b.qid = s.qid and b.node = s.node and b.dist <= {TAU} and a.source < b.source) group by all) m on m.qid = r.qid and m.run = r.run
        left join (select a.qid, count(*) n from (select distinct qid, source from dist) a join (select distinct qid, source from dist) b
            on a.qid = b.qid and a.source < b.source group by all) p on p.qid = r.qid"""


def utility(nodes: str) -> str:
    return f"""select s.qid, s.run, {settled("avg(case when k >= 2 then 1.0::double else 0.0 end)")} utility from {nodes} s
        left join (select qid, node, count(distinct source) k from dist where dist <= {TAU} group by all) b on b.qid = s.qid and b.node = s.node group by all"""


def parts(content) -> Parts:
    """Named parts, each with the parts that it needs. content: SQL of a text's content tokens."""
    p: Parts = {
        "radj": (("redges",), "select run, qid, src, dst from redges union select run, qid, dst, src from redges"),
        "rdeg": (("radj",), "select run, qid, src node, count(*) degree from radj group by all"),
        "m0": (("srcs",), f"select qid, run, source node, 1.0::double / count(*) over (partition by qid, run) mass from (select distinct qid, source, run from srcs, (select unnest(range({RUNS})) run))"),
        "cand": ((f"m{STEPS}",), f"""select * from (select qid, run, node, mass, row_number() over (partition by qid, run order by mass desc, node) rank
            from (select qid, run, node, {settled("mass", 9)} mass from m{STEPS})) where rank <= {CANDIDATES}"""),
        "near": (("dist",), "select qid, node, min(dist) near from dist group by all"),
        "brdg": (("dist",), f"""select k.qid, node, least(1.0::double, k::double / n + case when k >= 2 then 0.2::double else 0.0 end) bridge
            from (select qid, node, count(distinct source) k from dist where dist <= {TAU} group by all) k
            join (select qid, count(distinct source) n from dist group by qid) a on a.qid = k.qid"""),
        "utok": (("sents",), f"select qid, node, list_distinct({content('text')}) toks from sents"),
        "asim": (("utok", "anch"), f"select u.qid, u.node, round(2 * {jaccard('l', 'toks')} - 1, 9) a from utok u join (select qid, list(tok) l from anch group by qid) n on n.qid = u.qid"),
        "grnd": (("fwd", "sim"), """select qid, node, round(avg(g), 9) ground from (
            select f.qid, f.ent node, 0.5::double * (sim + 1) g, row_number() over (partition by f.qid, f.ent order by 0.5::double * (sim + 1) desc, f.unit) t
            from fwd f join sim s on s.qid = f.qid and s.node = f.unit where f.rn <= 12) where t <= 3 group by all"""),
        "comp": (("cand", "sim", "asim", "brdg", "grnd", "near"), """select c.qid, c.run, c.node, c.rank, c.mass graph, coalesce(sim, 0.0) semantic, coalesce(a, 0.0) anchor, coalesce(bridge, 0.0) bridge,
            coalesce(ground, 0.0) ground, case when near <= 1 then 1.0::double else 0.0 end coverage from cand c
            left join sim s on s.qid = c.qid and s.node = c.node left join asim x on x.qid = c.qid and x.node = c.node left join brdg b on b.qid = c.qid and b.node = c.node
            left join grnd g on g.qid = c.qid and g.node = c.node left join near n on n.qid = c.qid and n.node = c.node"""),
        "scored": (("comp",), f"""select *, round(seed_score + 0.20::double * bridge + 0.15::double * ground + 0.10::double * coverage, 9) weight from (select *,
            round(0.45::double * {spread("graph", "qid, run")} + 0.35::double * {spread("(0.5::double * (semantic + 1))", "qid, run")} + 0.2::double * {spread("(0.5::double * (anchor + 1))", "qid, run")}, 9) seed_score from comp)"""),
        "e0": (("cand",), "select distinct qid, node source, node from cand"),
        "sdist": (tuple(f"e{k}" for k in range(TAU + 1)), "select d.* from (" + " union all ".join(f"select qid, source, node, {k} dist from e{k}" for k in range(TAU + 1)) + ") d semi join e0 c on c.qid = d.qid and c.node = d.node"),
        "pd": (("scored", "sdist"), f"""select a.qid, a.run, a.node i, b.node j, b.rank jr, a.weight w, case when a.node = b.node then 0 else least({TAU}, coalesce(d.dist, {TAU})) end dist
            from scored a join scored b on a.qid = b.qid and a.run = b.run left join sdist d on d.qid = a.qid and d.source = a.node and d.node = b.node"""),
        "b0": (("scored",), f"select qid, run, node i, {TAU} best from scored"),
        "seeds": (("scored", *(f"p{k}" for k in range(1, SEEDS + 1))), "select s.*, pick from (" + " union all ".join(f"select qid, run, node, {k} pick from p{k}" for k in range(1, SEEDS + 1)) + ") p join scored s on s.qid = p.qid and s.run = p.run and s.node = p.node"),
        "spair": (("seeds", "sdist"), f"""select a.qid, a.run, a.node x, b.node y, least({TAU}, coalesce(d.dist, {TAU})) dist from seeds a join seeds b on a.qid = b.qid and a.run = b.run and a.node < b.node
            left join sdist d on d.qid = a.qid and d.source = a.node and d.node = b.node"""),
        "disp": (("seeds", "spair"), f"""select s.qid, s.run, {settled(f"coalesce(avg(dist) / {TAU}, 0.0)")} dispersion from (select distinct qid, run from seeds) s
            left join spair p on p.qid = s.qid and p.run = s.run group by all"""),
        "surr": ((f"m{STEPS}",), f"""select * from (select *, row_number() over (partition by qid order by weight desc, node) r from (
            select qid, node, {settled(f"sum(mass) / {RUNS}", 9)} weight from m{STEPS} group by all)) where r <= 128"""),
        "conn": (("seeds", "sdist", "surr", "disp"), f"""select k.qid, k.run, {settled("greatest(0.0, (case when w > 0 then v / w else 0.0 end) - 0.5::double * dispersion)")} connectivity from (
            select n.qid, n.run, sum(weight) w, sum(weight * (1 - least(dist, {TAU})::double / {TAU})) v from (
                select s.qid, s.run, d.node, min(d.dist) dist from seeds s join sdist d on d.qid = s.qid and d.source = s.node group by all) n
            join surr u on u.qid = n.qid and u.node = n.node where weight > 0 group by all) k join disp d on d.qid = k.qid and d.run = k.run"""),
        "redu": (("seeds", "utok"), f"""select s.qid, s.run, {settled("coalesce(x, 0.0)")} redundancy from (select distinct qid, run from seeds) s left join (
            select a.qid, a.run, avg({jaccard("u.toks", "v.toks")}) x from seeds a join seeds b on a.qid = b.qid and a.run = b.run and a.node < b.node
            join utok u on u.qid = a.qid and u.node = a.node join utok v on v.qid = b.qid and v.node = b.node group by all) p on p.qid = s.qid and p.run = s.run"""),
        "runs": (("seeds", "conn", "redu", "disp", "cand", "dist"), f"""select *, {settled("(0.30::double * semantic + 0.20::double * anchor + 0.25::double * structure + 0.15::double * bridge - 0.10::double * redundancy)")} run_score from (
            select s.qid, s.run, s.semantic, c.coverage anchor, n.connectivity structure, u.utility bridge, r.redundancy, d.dispersion
            from (select qid, run, max(0.5::double * (semantic + 1)) semantic from seeds group by all) s join ({coverage("seeds")}) c on c.qid = s.qid and c.run = s.run
            join conn n on n.qid = s.qid and n.run = s.run join ({utility("cand")}) u on u.qid = s.qid and u.run = s.run
            join redu r on r.qid = s.qid and r.run = s.run join disp d on d.qid = s.qid and d.run = s.run)"""),
        "cpairs": (("seeds", "srcs", "dist", "sim"), f"""select qid, row_number() over (partition by qid order by pair_score desc, source, node) rank, source, node seed, run, dist, pair_score, {settled("bridges")} bridges, {settled("align")} align from (
            select *, row_number() over (partition by qid, source, node order by pair_score desc, run) o from (
            select *, {settled("0.30::double * align + 0.25::double * seed_score + 0.20::double * 0.5::double * (sim + 1) + 0.15::double * (1 - dist::double / " + str(CAP) + ") + 0.10::double * bridges")} pair_score from (
            select *, (sum((dist < {CAP})::int) over w - (dist < {CAP})::int)::double / greatest(1, count(*) over w - 1) bridges from (
            select s.qid, s.run, s.node, s.seed_score, a.source, least({CAP}, coalesce(d.dist, {CAP})) dist, coalesce(1.0::double / (1 + d.dist), 0.0) align, coalesce(m.sim, 0.0) sim
            from seeds s join (select distinct qid, source from srcs) a on a.qid = s.qid left join dist d on d.qid = s.qid and d.source = a.source and d.node = s.node
            left join sim m on m.qid = s.qid and m.node = s.node) window w as (partition by qid, run, node)))) where o = 1 qualify rank <= 6"""),
        "t0": (("cpairs", "dist"), "select p.qid, p.rank, p.source, p.seed, d.dist d, p.seed as spot, [p.seed] path from cpairs p join dist d on d.qid = p.qid and d.source = p.source and d.node = p.seed"),
        "paths": (tuple(f"t{k}" for k in range(TAU + 1)), " union all ".join(f"select qid, rank, source, seed, path from t{k} where d = 0" for k in range(TAU + 1))),
        "psteps": (("paths",), "select qid, rank corridor, unnest(path) node, unnest(range(len(path))) pos, len(path) n from paths"),
        "pmain": (("psteps",), "select qid, corridor, pos, node from psteps where node like 's::%' or node like 'c::%'"),
        "psup": (("psteps", "pmain", "adj"), """select * from (select qid, corridor, node, row_number() over (partition by qid, corridor order by spot, node) - 1 pos from (
            select s.qid, s.corridor, a.dst node, min(s.pos) as spot from psteps s join adj a on a.qid = s.qid and a.src = s.node
            where not (s.node like 's::%' or s.node like 'c::%') and (a.dst like 's::%' or a.dst like 'c::%') group by all) b
            anti join pmain m on m.qid = b.qid and m.corridor = b.corridor and m.node = b.node) where pos < 4"""),
        "units": (("pmain", "psup"), """select qid, corridor, 'main' role, pos, node from pmain union all
            select s.qid, s.corridor, case when h.corridor is null then 'main' else 'support' end, pos, node from psup s left join (select distinct qid, corridor from pmain) h on h.qid = s.qid and h.corridor = s.corridor"""),
        "ccomp": (("units", "sim", "cpairs"), f"""select u.*, pair_score, align anchor, bridges bridge,
            0.6::double * (n_main > 0)::int + 0.2::double * least(1.0::double, n_main / 2.0::double) + 0.2::double * least(1.0::double, n_support / 2.0::double) structure from (
            select x.qid, corridor, count(*) filter (role = 'main') n_main, count(*) filter (role = 'support') n_support, count(*) n, {settled("avg(s)", 9)} semantic,
                round(coalesce(avg(s) filter (role = 'support'), avg(s)), 9) answer_side_density, avg((s >= 0.35::double)::int::double) filter (role = 'support') useful,
                count(*) filter (s >= 0.55::double) answers, count(*) filter (role = 'support' and s >= 0.55::double) kept, list_distinct(list(node)) nodes
            from (select u.*, 0.5::double * (coalesce(sim, 0.0) + 1) s from (select distinct qid, corridor, node, role from units) u left join sim m on m.qid = u.qid and m.node = u.node) x group by all) u
            join cpairs p on p.qid = u.qid and p.rank = u.corridor"""),
        "cbase": (("ccomp",), f"select qid, corridor, nodes, {settled('0.45::double * structure + 0.45::double * semantic + 0.10::double * pair_score + 0.0', 9)} base from ccomp"),
        "ranked": (("cbase", "cpairs"), f"""select r.qid, corridor, row_number() over (partition by r.qid order by score desc, corridor) place, {settled("base")} base, {settled("overlap")} overlap, score, source || '|' || seed anchors from (
            select *, {settled("base - 0.10::double * overlap")} score from (select a.qid, a.corridor, a.base, coalesce(max({jaccard("a.nodes", "b.nodes")}), 0.0) overlap from cbase a left join cbase b
            on a.qid = b.qid and (b.base > a.base or (b.base = a.base and b.corridor < a.corridor)) group by a.qid, a.corridor, a.base)) r join cpairs p on p.qid = r.qid and p.rank = r.corridor"""),
        "sel": (("units", "sim", "sents", f"m{STEPS}"), f"""select qid, row_number() over (partition by qid order by score desc, node) - 1 pos, node, text, score from (
            select u.qid, u.node, s.text, {settled("coalesce(b.mass, 0.0) + 0.5::double * (m.sim + 1)", 9)} score from (select distinct qid, node from units) u
            left join (select qid, node, max(mass) mass from m{STEPS} group by all) b on b.qid = u.qid and b.node = u.node
            join sim m on m.qid = u.qid and m.node = u.node join sents s on s.qid = u.qid and s.node = u.node)"""),
        "feat": (("sel", "units", "ranked"), f"""select s.qid, s.pos, s.node, s.text, coalesce(best_rank, 1000000000) best_rank, round(coalesce(best_score, 0.0), 6) best_score, coalesce(is_main, false) is_main, coalesce(is_support, false) is_support,
            coalesce(is_support, false) is_connector, coalesce(corridors, 0) corridors, len(list_intersect(list_distinct({content("q.text")}), {content("s.text")})) overlap,
            {settled("greatest(1.0::double / (s.pos + 1), coalesce(local, 0.0))")} locality, {settled("s.score")} base from sel s join benchmark q on q.item_id = s.qid left join (
            select qid, node, min(place) best_rank, max(score) best_score, bool_or(role = 'main') is_main, bool_or(role = 'support') is_support,
                max((case when role = 'main' then 1.0::double else 0.75 end) / (place * k)) local, count(distinct corridor) corridors from (
                select u.qid, u.corridor, u.node, u.role, r.place, r.score, row_number() over (partition by u.qid, u.corridor, u.role order by u.pos, u.node) k
                from units u join ranked r on r.qid = u.qid and r.corridor = u.corridor semi join sel x on x.qid = u.qid and x.node = u.node) group by all) b on b.qid = s.qid and b.node = s.node"""),
        "lin": (("feat",), "select *, base + 0.35::double * best_score + 0.45::double * is_main::int + 0.20::double * is_support::int + 0.20::double * is_connector::int + 0.12::double * overlap + 0.08::double * locality value, case when overlap >= 1 then 'query' when is_support or is_connector then 'bridge' else 'answer' end role from feat"),
        "backc": (("units", "ranked", "feat"), """select qid, row_number() over (partition by qid order by cp, k) rank, regexp_extract(node, '^[a-z]::(.*):\\d+$', 1) doc_id, regexp_extract(node, ':(\\d+)$', 1)::bigint center from (
            select *, row_number() over (partition by qid, cp order by place nulls last, o, pos, node) k from (
            select u.qid, r.place cp, u.node, min(case when u.role = 'main' then 0 else 1 end) o, arg_min(u.pos, (case when u.role = 'main' then 0 else 1 end, u.pos)) pos, min(f.pos + 1) place
            from units u join ranked r on r.qid = u.qid and r.corridor = u.corridor and r.place <= 3 left join feat f on f.qid = u.qid and f.node = u.node and f.pos < 6 group by all)) where k <= 1"""),
        "back": (("backc", "sents"), "select c.qid, c.rank, s.unit_idx pos, s.node, s.text from backc c join (select distinct doc_id, unit_idx, node, text from sents) s on s.doc_id::varchar = c.doc_id and abs(s.unit_idx - c.center) <= 1"),
        "exsel": (("back", "feat"), """select qid, place, rank, node, text, candidates from (select *, row_number() over (partition by qid order by rank, pos, node) place, count(*) over (partition by qid) candidates from (
            select *, row_number() over (partition by qid, node order by rank, pos) f from back b anti join (select qid, node from feat where pos < 6) x on x.qid = b.qid and x.node = b.node where trim(text) <> '') where f = 1) where place <= 4"""),
        "qchunks": (("chunks", "hits"), "select h.qid, h.doc_id, row_number() over (partition by h.qid order by h.rank, c.unit_idx) rank, c.unit_idx, c.text from hits h join chunks c on c.doc_id = h.doc_id"),
        "smatch": (("qchunks", "gold"), """select c.qid, c.rank, c.doc_id, 'chunk::doc' || c.doc_id || '::' || c.unit_idx unit_id,
            case when g.qid is not null and contains(lower(c.text), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) then 'doc' || c.doc_id || '::0' else '' end matched,
            case when g.qid is null then 'chunk_title_not_in_gold' when c.text = '' then 'chunk_text_missing' when contains(lower(c.text), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) then 'chunk_contains_gold_sentence' else 'chunk_text_no_gold_sentence_match' end reason
            from qchunks c join benchmark b on b.item_id = c.qid left join gold g on g.qid = c.qid and g.doc_id = c.doc_id"""),
        "boost": (("anch", "fwd"), f"select a.qid, unit, {settled('max(round(score, 9) * greatest(0.0, 0.92::double - 0.03::double * (f.rn - 1)) * greatest(0.0, 0.96::double - 0.02::double * (a.rank - 1)))')} score from anch a join fwd f on f.qid = a.qid and f.ent = 'e::' || a.tok group by a.qid, unit"),
        "links": (("fwd", "bck"), "select qid, ent node, unit linked from fwd union all select qid, unit, ent from bck"),
    }
    for k in range(1, STEPS + 1):
        p[f"m{k}"] = ((f"m{k - 1}", "radj", "rdeg", "m0"), f"""select qid, run, node, sum(mass) mass from (
            select r.qid, r.run, a.dst node, 0.85::double * r.mass / d.degree mass from m{k - 1} r join radj a on a.qid = r.qid and a.run = r.run and a.src = r.node join rdeg d on d.qid = r.qid and d.run = r.run and d.node = r.node
            union all select v.qid, v.run, v.node, (0.15::double + 0.85::double * coalesce(lost, 0.0)) * v.mass from m0 v left join (
                select r.qid, r.run, sum(r.mass) lost from m{k - 1} r anti join rdeg d on d.qid = r.qid and d.run = r.run and d.node = r.node group by all) l on l.qid = v.qid and l.run = v.run) group by all""")
    for k in range(1, TAU + 1):
        seen = " union all ".join(f"select qid, source, node from e{j}" for j in range(k))
        p[f"e{k}"] = (("adj", *(f"e{j}" for j in range(k))), f"select s.* from (select distinct f.qid, f.source, a.dst node from e{k - 1} f join adj a on a.qid = f.qid and a.src = f.node) s anti join ({seen}) o on o.qid = s.qid and o.source = s.source and o.node = s.node")
        p[f"t{k}"] = ((f"t{k - 1}", "adj", "dist"), f"select t.qid, t.rank, t.source, t.seed, t.d - 1 d, min(a.dst) as spot, list_prepend(min(a.dst), t.path) path from t{k - 1} t join adj a on a.qid = t.qid and a.src = t.spot join dist x on x.qid = t.qid and x.source = t.source and x.node = a.dst and x.dist = t.d - 1 where t.d > 0 group by t.qid, t.rank, t.source, t.seed, t.d, t.path")
    for k in range(1, SEEDS + 1):
        before = " union all ".join(f"select qid, run, node from p{j}" for j in range(1, k)) or "select qid, run, node from scored where false"
        p[f"p{k}"] = (("pd", "scored", f"b{k - 1}", *(f"p{j}" for j in range(1, k))), f"select qid, run, j node from (select d.qid, d.run, j, jr, round(sum(w * least(best, dist)), 7) v from pd d join b{k - 1} b on b.qid = d.qid and b.run = d.run and b.i = d.i anti join ({before}) o on o.qid = d.qid and o.run = d.run and o.node = d.j group by all) qualify row_number() over (partition by qid, run order by v, jr) = 1")
        p[f"b{k}"] = ((f"b{k - 1}", f"p{k}", "pd"), f"select b.qid, b.run, b.i, least(b.best, d.dist) best from b{k - 1} b join p{k} c on c.qid = b.qid and c.run = b.run join pd d on d.qid = b.qid and d.run = b.run and d.i = b.i and d.j = c.node")
    return p


def oracles(sql, tokens, content) -> dict[str, str]:
    """SQL of each query by name. sql: a query over named parts."""
    chosen = "(select * from runs qualify row_number() over (partition by qid order by run_score desc, run) = 1)"
    lookup = "select '{s}' strategy, qid, rank, node, score from (select *, row_number() over (partition by qid order by score desc, node) rank from (select qid, node, max(score) score from ({body}) group by all)) where rank <= 16"
    scanned, cached = f"select qid, node, {settled('0.5::double * (sim + 1)')} score from sim", "select qid, unit node, score from boost"
    mixed = "select * from ({c}) union all select * from ({s}) x anti join (select qid from boost group by qid having count(*) >= {n}) f on f.qid = x.qid"
    body = {"full": scanned, "cache_only": cached, "two_tier": mixed.format(c=cached, s=scanned, n=16), "adaptive": mixed.format(c=cached, s=scanned, n=0.8 * 16)}
    order = {"score": "value desc, pos", "retrieval": "pos", "corridor_rank": "best_rank, value desc, pos", "score+relation_on": "best_rank, case role when 'query' then 0 when 'bridge' then 1 else 2 end, value desc, pos"}
    picked = f"(select qid, node, pos, best_rank, role, text, {settled('value')} value from lin{{where}})"
    flat = "string_agg('[' || (pos + 1) || '] (' || node || ') ' || text, chr(10) order by pos)"
    corr = lambda v, eps="1e-12": spread(v, "qid", eps)
    return {
        "ppr_mass": sql(f"select qid, run::int run, round(sum(mass), 6) mass, count(*) nodes from m{STEPS} group by all", f"m{STEPS}"),
        "seed_components": sql(f"select qid, run::int run, node, {settled('graph', 5)} graph, {settled('seed_score', 5)} seed_score, {settled('weight', 5)} weight from scored", "scored"),
        "greedy_seeds": sql("select qid, run::int run, pick::bigint pick, node from seeds", "seeds"),
        "seed_dispersion": sql("select qid, run::int run, dispersion from disp", "disp"),
        "seed_pair_coverage": sql(coverage("cand"), "cand", "dist").replace("select qid, run,", "select qid, run::int run,", 0),
        "bridge_completeness": sql(completeness("cand"), "cand", "dist"),
        "bridge_utility": sql(utility("cand"), "cand", "dist"),
        "run_precheck": sql(f"""select t.qid, t.run::int run, {settled("0.40::double * (case when total > 0 then coalesce(mass, 0.0) / total else 0.0 end) + 0.25::double * coalesce(covered, 0)::double / anchors + 0.20::double * coalesce(semantic, 0.0) + 0.15::double * (case when picked > 0 then coalesce(bridges, 0)::double / picked else 0.0 end)")} pre_score
            from (select qid, run, sum(mass) total from cand group by all) t
            left join (select qid, run, sum(graph) mass, max(0.5::double * (semantic + 1)) semantic, count(*) picked from seeds group by all) m on m.qid = t.qid and m.run = t.run
            left join (select s.qid, s.run, count(distinct source) covered from seeds s join dist d on d.qid = s.qid and d.node = s.node group by all) c on c.qid = t.qid and c.run = t.run
            left join (select qid, run, count(*) filter (k >= 2) bridges from (select s.qid, s.run, s.node, count(distinct source) k from seeds s join dist d on d.qid = s.qid and d.node = s.node group by all) group by all) b on b.qid = t.qid and b.run = t.run
            join (select qid, count(distinct source) anchors from dist group by qid) a on a.qid = t.qid""", "cand", "seeds", "dist"),
        "run_scores": sql("select qid, run::int run, semantic, anchor, structure, bridge, redundancy, dispersion, run_score from runs", "runs"),
        "run_choice": sql(f"select qid, run::int run, run_score from {chosen}", "runs"),
        "run_rerank": sql(f"select qid, row_number() over (partition by qid order by score desc, run) place, run::int run, score from (select qid, run, {settled('0.72::double * ' + corr('run_score') + ' + 0.12::double * ' + corr('semantic') + ' + 0.08::double * ' + corr('anchor') + ' + 0.08::double * ' + corr('bridge'))} score from runs)", "runs"),
        "chunk_grounding": sql(f"""select s.qid, s.run::int run, {settled("coalesce(avg(hit), 0.0)")} grounding from (select distinct qid, run from seeds) s left join (
            select s.qid, s.run, s.node, max((c.node is not null)::int) hit from seeds s join links l on l.qid = s.qid and l.node = s.node left join cand c on c.qid = s.qid and c.run = s.run and c.node = l.linked group by all) h
            on h.qid = s.qid and h.run = s.run group by s.qid, s.run""", "seeds", "cand", "links"),
        "fallback_pairs": sql(f"""select qid, rank, source, seed, run::int run from (select s.qid, row_number() over (partition by s.qid order by s.seed_score desc, a.source, s.node) rank, a.source, s.node seed, s.run
            from {chosen} c join seeds s on s.qid = c.qid and s.run = c.run join (select distinct qid, source from srcs) a on a.qid = s.qid
            where c.qid not in (select qid from cpairs where qid % 2 = 0)) where rank <= 6""", "runs", "seeds", "srcs", "cpairs"),
        "pair_shortlist": sql("select qid, rank, source, seed, dist::bigint dist, pair_score from cpairs", "cpairs"),
        "corridor_nodes": sql("select qid, corridor, role, pos, node from units", "units"),
        "corridor_rerank": sql("select qid, corridor, place, base, overlap, score, anchors from ranked", "ranked"),
        "unit_features": sql("select qid, pos, node, best_rank::bigint best_rank, best_score, is_main, is_support, is_connector, corridors, overlap, locality, base from feat", "feat"),
        "pinned_support": sql("""select qid, row_number() over (partition by qid order by pos, node) place, node, is_support from (select *, row_number() over (partition by qid order by (is_support and s <= 2) desc, r) r2 from (
            select qid, pos, node, is_support, row_number() over (partition by qid order by pos, node) r, sum(is_support::int) over (partition by qid order by pos, node rows unbounded preceding) s from feat)) where r2 <= 10""", "feat"),
        "slice_reorder": sql("select qid, case when pos < 3 then row_number() over (partition by qid, pos >= 3 order by is_support desc, is_main desc, overlap desc, base desc, pos) else pos + 1 end place, node from feat", "feat"),
        "bundle_clip": sql("""select qid, row_number() over (partition by qid order by pos, node) place, role, node from (select *, row_number() over (partition by qid order by first desc, pos, node) o from (
            select *, row_number() over (partition by qid, role order by pos, node) = 1 first from lin)) where o <= 5""", "lin"),
        "corridor_top1": sql(f"""select qid, corridor, place from (select qid, corridor, row_number() over (partition by qid order by corrected desc, place) place from (
            select *, round(0.75::double * {corr("score")} + 0.10::double * {corr("align")} + 0.06::double * {corr("base")} + 0.05::double * {corr("bridges")} + 0.04::double * {corr("pair_score")} - 0.05::double * {corr("overlap")}, 9) corrected from (
            select r.*, p.align, p.bridges, p.pair_score from ranked r join cpairs p on p.qid = r.qid and p.rank = r.corridor) where place <= 3)) union all select qid, corridor, place from ranked where place > 3""", "ranked", "cpairs"),
        "corridor_lift": sql(f"""select * from (select qid, row_number() over (partition by qid order by score desc, doc_id) rank, doc_id, l[len(l) // 2 + 1] center, score from (
            select u.qid, doc_id, list_sort(list(idx)) l, round(count(*) + 0.1::double * len(list_intersect(list_distinct({content("any_value(q.text)")}), {content("'doc' || doc_id")})), 6) score from (
            select distinct qid, node, regexp_extract(node, '^s::(.*):\\d+$', 1) doc_id, regexp_extract(node, ':(\\d+)$', 1)::bigint idx from units where node like 's::%') u join benchmark q on q.item_id = u.qid group by u.qid, doc_id)) where rank <= 2""", "units"),
        "corridor_components": sql(SHAPED_SQL, "ccomp"),
        "package_score": sql(f"select qid, rank, doc_id, score from ({packages(tokens)})", "exc", "feat"),
        "ordered_units": sql(" union all ".join(f"select '{s}' strategy, qid, row_number() over (partition by qid order by {o}) place, node, role from {picked.format(where=' where pos < 10')}" for s, o in order.items()), "lin"),
        "context_grid": sql(" union all ".join(f"select '{s}' strategy, budget, count(distinct qid) questions, count(*) units, sum(n)::bigint tokens from (select qid, row_number() over (partition by qid order by {order[s]}) place, len({tokens('text')}) n from {picked.format(where='')}) r join (select unnest([3, 5, 8])::bigint budget) b on place <= budget group by budget" for s in ("score", "corridor_rank")), "lin"),
        "connector_metrics": sql(connector_metrics(chosen), "ccomp", "ranked", "runs", "seeds", "cand", "dist", "sim", "units"),
        "node_signature": sql("select count(*) n, sum(('0x' || substr(sha1(src), 1, 15))::bigint)::varchar fingerprint from (select distinct src from cedge)", "cedge"),
        "top1_correction": sql(head_correction(content), "feat"),
        "package_choice": sql(package_rounds(tokens), "exc", "feat"),
        "corridor_coverage_order": sql(coverage_rounds(), "cbase", "ranked"),
        "render_mmr": sql(mmr_rounds(tokens), "lin"),
        "path_bundles": sql(BUNDLES.format(main=3, support=2, bridge=1, corridors=3, dedup="where role = 'anchor' or first = bundle"), "units", "ranked", "feat"),
        "bundle_metrics": sql("""select qid, count(*) path_bundle_count, round(avg(n), 6) avg_chunks_per_bundle, round(avg(b * c), 6) bridge_answer_adjacency_rate, coalesce(min(bundle) filter (a * b * c = 1), 0) first_complete_path_rank, round(avg(c), 6) answer_path_coverage
            from (select qid, bundle, count(*) n, max((role = 'anchor')::int) a, max((role = 'bridge')::int) b, max((role = 'answer')::int) c from (""" + BUNDLES.format(main=2, support=2, bridge=1, corridors=2, dedup="") + """) group by all) group by qid""", "units", "ranked", "feat"),
        "retrieved_units": sql(f"select qid, rank, unit_id, round(score, 6) score from (select m.qid, row_number() over (partition by m.qid order by {settled('0.5::double * (sim + 1)', 9)} desc, m.node) rank, m.node unit_id, {settled('0.5::double * (sim + 1)', 9)} score from sim m) where rank <= 14", "sim"),
        "run_answers": sql(f"select item_id qid, coalesce(text, '') prediction from (select item_id from benchmark) b left join (select * from (select s.qid, s.text, row_number() over (partition by s.qid order by len(list_intersect(list_distinct({tokens('q.text')}), list_distinct({tokens('s.text')}))) desc, s.pos) k from sel s join benchmark q on q.item_id = s.qid) where k = 1) a on a.qid = b.item_id", "sel"),
        "backfill_packages": sql("select qid, rank, pos, node from back", "back"),
        "excerpt_selection": sql("select qid, place, rank, node, candidates from exsel", "exsel"),
        "grounded_context": sql(f"""select b.qid, md5(context || case when n > 0 then chr(10) || chr(10) || '[Grounded Chunk Excerpts]' || chr(10) || l else '' end) context_md5, units + coalesce(n, 0) units, coalesce(n, 0) excerpts from (
            select qid, {flat} context, count(*) units from feat where pos < 6 group by qid) b left join (select e.qid, count(*) n, string_agg('- ' || e.text, chr(10) order by e.place) l from exsel e
            join (select qid, count(*) units from feat where pos < 6 group by qid) u on u.qid = e.qid where e.place <= greatest(0, least(4, 8 - units)) group by e.qid) x on x.qid = b.qid""", "feat", "exsel"),
        "support_match_reasons": sql("select qid, rank, unit_id, matched, reason from smatch", "smatch"),
        "support_debug": sql("""select g.qid, 'doc' || g.doc_id || '::0' unit_id, 'doc' || g.doc_id title, coalesce(m, false) matched, case when m then 'matched' when m is null then 'no_predicted_unit_with_same_title'
            when bare then 'same_title_chunk_text_missing' else 'same_title_chunk_without_gold_sentence_containment' end reason from gold g left join (
            select qid, doc_id, bool_or(matched <> '') m, bool_or(reason = 'chunk_text_missing') bare from smatch where rank <= 40 group by all) x on x.qid = g.qid and x.doc_id = g.doc_id""", "gold", "smatch"),
        "cache_boost": sql("select qid, unit, score from boost", "boost"),
        "support_expansion": sql(f"select a.qid, unit, {settled('max(round(score, 9) * (0.85::double - 0.03::double * (f.rn - 1)))')} score from anch a join fwd f on f.qid = a.qid and f.ent = 'e::' || a.tok where f.rn <= 4 group by a.qid, unit", "anch", "fwd"),
        "grounding_bonus": sql("select qid, node, round(ground, 6) ground from grnd", "grnd"),
        "semantic_lookup": sql(" union all ".join(lookup.format(s=s, body=b) for s, b in body.items()), "sim", "boost"),
        "entity_chunk_scores": sql("select * from (select qid, row_number() over (partition by qid order by score desc, unit) rank, unit, score from (select qid, unit, round(list_reduce(list_prepend(0.0::double, l), lambda a, x: greatest(a, 0.65::double * a + 0.35::double * x)), 6) score from (select a.qid, unit, list(round(score, 9) * greatest(0.20::double, 1 - 0.06::double * (f.rn - 1)) order by a.rank, tok) l from anch a join fwd f on f.qid = a.qid and f.ent = 'e::' || a.tok group by a.qid, unit))) where rank <= 20", "anch", "fwd"),
        "diffusion_scope": sql("""select coalesce(e.qid, a.qid) qid, edges, anchors from (select qid, count(*) edges from inner_edges group by qid) e full join (select qid, count(*) anchors from (
            select distinct s.qid, s.source from srcs s semi join inner_edges i on i.qid = s.qid and i.src = s.source) group by qid) a on a.qid = e.qid""", "srcs", "inner_edges"),
        "bridged_proposals": sql("""select qid, source, place - 1 rank, node, round(score, 6) score from (select *, row_number() over (partition by qid, source order by g, r, node) place from (
            select qid, source, node, min(g) g, arg_min(r, (g, r)) r, max(score) score from (select qid, source, node, 0 g, rn - 1 r, score from prop union all select b.qid, s.source, b.node, 1, b.rank, b.score from bcand b join (select distinct qid, source from srcs) s on s.qid = b.qid) group by qid, source, node)) where place <= 48""", "prop", "bcand", "srcs"),
    }


BUNDLES = """select qid, bundle, role, row_number() over (partition by qid, bundle order by case role when 'anchor' then 0 when 'bridge' then 1 else 2 end, place, node) place, node from (
    select *, min(bundle) filter (role <> 'anchor') over (partition by qid, node) first from (
    select qid, bundle, case when role = 'main' then 'anchor' when r <= {bridge} then 'bridge' else 'answer' end role, r place, node from (
    select *, row_number() over (partition by qid, bundle, role order by round(value, 6) desc, pos, node) r from (
    select u.qid, r.place bundle, u.node, u.role, max(f.base + 0.35::double * f.overlap) value, min(u.pos) pos from units u join ranked r on r.qid = u.qid and r.corridor = u.corridor and r.place <= {corridors}
    join feat f on f.qid = u.qid and f.node = u.node group by all)) where (role = 'main' and r <= {main}) or (role = 'support' and r <= {support}))) {dedup}"""



def connector_metrics(chosen: str) -> str:
    weighed = {
        "bridge_purity": "purity", "answer_side_density": "answer_side_density", "support_set_compactness": "compactness", "bridge_noise_ratio": "noise",
        "answer_preserve_activation_rate": "(open and gain > 0)::int::double", "preserved_answer_usefulness": "0.0::double", "path_complete_rate": "case when path_complete then 1.0::double else path_score end",
        "bridge_answer_pair_retention": "retention", "incomplete_path_rate": "incomplete", "chain_compactness": "chain",
        "path_preserve_activation_rate": "(path_complete and path_score >= 0.70::double and retention >= 0.55::double and answer_side_density >= 0.62::double)::int::double",
    }
    unit = lambda x: f"least(greatest({x}, 0.0), 1.0)"
    shares = {f"{c}_role_share": f"{c} / greatest(1e-8::double, anchor + bridge + answer)" for c in ("anchor", "bridge", "answer")}
    mean = ", ".join([f"sum({unit(v)} / place) / sum(1.0::double / place) {k}" for k, v in weighed.items()] + [f"sum(({v}) / place) / sum(1.0::double / place) {k}" for k, v in shares.items()])
    top = ", ".join(f"max({unit(c)}) max_{c}" for c in ("anchor", "bridge", "answer"))
    zero = dict.fromkeys(weighed, "0.0") | {"support_set_compactness": "1.0", "chain_compactness": "1.0", "bridge_noise_ratio": "1.0"} | dict.fromkeys(shares, "(1.0::double / 3)") | dict.fromkeys(("max_anchor", "max_bridge", "max_answer"), "0.0")
    filled = ", ".join(f"coalesce(p.{k}, {v}) {k}" for k, v in zero.items())
    both = "run_bridge_coverage >= 0.35::double and (max_answer >= 0.35::double or answer_side_density >= 0.35::double)"
    flag = lambda x: f"({both} and {x})::int::double"
    names = {c: c for c in ("seed_diversity", "seed_redundancy", "seed_anchor_recall", "seed_answer_recall", "seed_bridge_recall", "redundancy_rate", "run_bridge_coverage", *weighed, *shares, "corridor_role_coverage")}
    three = ", ".join(shares)
    names |= {
        "anchor_bridge_balance": unit(f"1 - (greatest({three}) - least({three}))"),
        "useful_bridge_rate": flag("bridge_purity >= 0.40::double"),
        "bridge_to_answer_path_hit": flag("corridor_role_coverage >= 0.45::double and bridge_purity >= 0.35::double"),
        "conversion_after_bridge_proxy": flag("answer_side_density >= 0.35::double and bridge_purity >= 0.35::double"),
        "conversion_after_preserve_proxy": flag("answer_preserve_activation_rate >= 0.5::double and preserved_answer_usefulness >= 0.35::double"),
        "conversion_after_path_preserve_proxy": flag("path_preserve_activation_rate >= 0.25::double and path_complete_rate >= 0.45::double and incomplete_path_rate <= 0.55::double"),
        "connector_quality": "(seed_bridge_recall + run_bridge_coverage + corridor_role_coverage + path_complete_rate + bridge_purity + chain_compactness) / 6",
    }
    out = ", ".join(f"round({v}, 6) {k}" for k, v in names.items())
    return f"""select qid, {out} from (select *, (max_anchor + max_bridge + max_answer) / 3 corridor_role_coverage from (
        select c.qid, c.dispersion seed_diversity, c.redundancy seed_redundancy, coalesce(v.c, 0)::double / a.n seed_anchor_recall, w.r seed_answer_recall, s.completeness seed_bridge_recall,
            coalesce(o.redundancy_rate, 0.0) redundancy_rate, greatest(c.bridge, x.completeness) run_bridge_coverage, {filled} from {chosen} c
        join (select qid, count(distinct source) n from dist group by qid) a on a.qid = c.qid
        left join (select s.qid, s.run, count(distinct source) c from seeds s join dist d on d.qid = s.qid and d.node = s.node group by all) v on v.qid = c.qid and v.run = c.run
        join (select qid, run, avg(hit) r from (select n.qid, n.run, (e.node is not null)::int hit from (
            select *, row_number() over (partition by qid, run order by s desc, node) k, bool_or(s >= 0.5::double) over (partition by qid, run) any_ from (
            select n.qid, n.run, n.node, 0.5::double * (coalesce(sim, 0.0) + 1) s from cand n left join sim m on m.qid = n.qid and m.node = n.node)) n
            left join seeds e on e.qid = n.qid and e.run = n.run and e.node = n.node where s >= 0.5::double or (not any_ and k <= 4)) group by all) w on w.qid = c.qid and w.run = c.run
        join ({completeness("seeds")}) s on s.qid = c.qid and s.run = c.run join ({completeness("cand")}) x on x.qid = c.qid and x.run = c.run
        left join (select a.qid, avg({jaccard("a.l", "b.l")}) redundancy_rate from (select qid, corridor, list_distinct(list(node)) l from units group by all) a
            join (select qid, corridor, list_distinct(list(node)) l from units group by all) b on b.qid = a.qid and a.corridor < b.corridor group by a.qid) o on o.qid = c.qid
        left join (select z.qid, {mean}, {top} from ({SHAPED_ROWS}) z join ranked r on r.qid = z.qid and r.corridor = z.corridor group by z.qid) p on p.qid = c.qid))"""


def packages(tokens) -> str:
    return f"""select *, round(0.50::double / rank + 0.20::double * bridge::int + 0.15::double * least(4, corridors) / 4 + 0.15::double * (case when len(a) > 0 then len(list_intersect(a, b))::double / len(a) else 0.0 end) + 0.05::double / (case when best_rank < 1000000000 then best_rank + 1 else 1000 end), 6) score from (
        select e.qid, e.rank, e.doc_id, coalesce(f.best_rank, 1000000000) best_rank, coalesce(f.is_connector, false) bridge, coalesce(f.corridors, 0) corridors, list_distinct({tokens("q.text")}) a, list_distinct({tokens("excerpt")}) b
        from exc e join benchmark q on q.item_id = e.qid left join feat f on f.qid = e.qid and f.node = 's::' || e.doc_id || ':' || e.center)"""


def rounds(items: str, count: int, value: str, extra: str = "0.0") -> str:
    """Greedy picks one by one, as a chain of named rounds.

    items: qid, o (order), score and toks of each item; value: of an item x,
    given ``red``, its largest overlap with the picks before, and ``extra``, an
    aggregate over the picks before (alias t).
    """
    chain = [f"items as materialized ({items})", "k0 as materialized (select qid, o, 0 pick, 0.0::double value from items where false)"]
    for k in range(1, count + 1):
        chain.append(f"""n{k} as materialized (select qid, o, {k} pick, value from (select *, {value} value from (select x.qid, x.o, any_value(x) x, coalesce(max({jaccard("x.toks", "t.toks")}), 0.0) red, {extra} extra
            from items x left join (select i.*, pick from items i join k{k - 1} p on p.qid = i.qid and p.o = i.o) t on t.qid = x.qid
            where not exists (select 1 from k{k - 1} p where p.qid = x.qid and p.o = x.o) group by x.qid, x.o)) qualify row_number() over (partition by qid order by value desc, o) = 1)""")
        chain.append(f"k{k} as materialized (select * from k{k - 1} union all select * from n{k})")
    return "with " + ", ".join(chain)


def head_correction(content) -> str:
    mm = lambda c: spread(f"{c}::double", "qid", "1e-12")
    score = f"round(0.60::double * {mm('base')} + 0.20::double * {mm('best_score')} + 0.08::double * is_main::int + 0.04::double * is_support::int + 0.04::double * {mm('overlap')} + 0.04::double * {mm('locality')}, 9)"
    items = f"select qid, pos o, node, {score} score, list_distinct({content('text')}) toks from feat where pos < 3"
    return f"select * from ({rounds(items, 3, 'x.score - 0.04::double * red')} select k.qid, pick::bigint place, node from k3 k join items i on i.qid = k.qid and i.o = k.o) union all select qid, pos + 1, node from feat where pos >= 3"


def package_rounds(tokens) -> str:
    items = f"select qid, rank o, score, b toks from ({packages(tokens)})"
    return f"select qid, pick::bigint place, o rank, {settled("value")} value from ({rounds(items, 4, 'x.score - 0.1::double * red')} select * from k4)"


def coverage_rounds() -> str:
    """Corridors one by one: the share of units that no pick before has, and the overlap with the picks."""
    items = "select qid, corridor o, base score, toks from (select r.qid, r.corridor, r.base, b.nodes toks from ranked r join cbase b on b.qid = r.qid and b.corridor = r.corridor)"
    fresh = "len(list_filter(x.toks, lambda u: not list_contains(coalesce(extra, []), u)))::double / greatest(1, len(x.toks))"
    return f"select qid, pick::bigint place, o corridor, {settled("value")} value from ({rounds(items, 6, f'x.score + 0.35::double * ({fresh}) - 0.20::double * red', 'flatten(list(t.toks) filter (t.toks is not null))')} select * from k6)"


def mmr_rounds(tokens) -> str:
    items = f"select qid, pos o, node, role, regexp_extract(node, '^[a-z]::(.*):\\d+$', 1) title, round(value + 0.05::double * is_connector::int, 9) score, list_distinct({tokens('text')}) toks from lin"
    extra = "{'same': count(*) filter (t.title = x.title), 'b': count(*) filter (t.role = 'bridge'), 'a': count(*) filter (t.role = 'answer')}"
    value = "x.score - 0.25::double * red + (-0.20::double * 0.25::double * extra.same - 0.04::double * (case x.role when 'bridge' then greatest(0, extra.b - extra.a) when 'answer' then greatest(0, extra.a - extra.b - 1) else 0 end))"
    return f"select k.qid, pick::bigint place, node, {settled("value")} value from ({rounds(items, 10, value, extra)} select k.*, i.node from k10 k join items i on i.qid = k.qid and i.o = k.o) k"


#: The guarded and light settings of every shaping term, written out.
SHAPED_ROWS = """
    select *, 0.08::double * ((case when open0 then 0.65::double else 1.0::double end) * (case when 0.5::double * (anchor + bridge) >= 0.70::double then 0.35::double else 1.0::double end) * (case when density >= 0.40::double then 0.35::double else 1.0::double end) * answer_side_density - 0.5::double * greatest(0.0, 0.30::double - answer_side_density)) gain,
        open0 and answer_side_density < 0.72::double as open from (
    select *, least(greatest(1 - purity, 0.0), 1.0) noise, least(greatest(least(anchor_chain, bridge_chain, answer_chain), 0.0), 1.0) path_score, (answer_chain >= 0.55::double and not path_complete)::int::double incomplete,
        retention >= 0.55::double and answer_side_density >= 0.62::double as open0,
        least(greatest(compactness * (0.5::double + 0.5::double * retention) * (1 - 0.4::double * least(1.0, abs(answer_chain - bridge_chain))), 0.0), 1.0) chain from (
    select *, anchor_chain >= 0.35::double and bridge_chain >= 0.35::double and answer_chain >= 0.55::double and retention > 0 as path_complete from (
    select *, greatest(anchor, (n_main > 0)::int::double) anchor_chain, greatest(bridge, purity, density) bridge_chain, greatest(answer, answer_side_density) answer_chain from (
    select *, greatest(semantic, anchor) answer, coalesce(useful, least(greatest(bridge, 0.0), 1.0)) purity, 1.0::double / (1 + greatest(0, n_support - 1)) compactness, kept::double / greatest(1, answers) retention, n_support::double / greatest(1, n) density from ccomp))))"""
SHAPED_SQL = f"""select qid, corridor, path_complete, {settled("structure")} structure, {settled("semantic")} semantic, {settled("answer")} answer, {settled("purity")} bridge_purity, {settled("answer_side_density")} answer_side_density,
    {settled("compactness")} support_set_compactness, {settled("retention")} bridge_answer_pair_retention, {settled("case when path_complete then 1.0::double else path_score end")} path_complete_rate, {settled("chain")} chain_compactness, {settled("incomplete")} incomplete_path_rate,
    {settled("round(0.05::double * compactness + (case when path_complete and path_score >= 0.70::double and retention >= 0.55::double and answer_side_density >= 0.62::double then 0.10::double * path_score * (0.6::double + 0.4::double * retention) * 0.70::double when not path_complete then -(0.05::double * incomplete * least(greatest(answer_chain, 0.0), 1.0)) else 0.0 end) + 0.04::double * (chain - 0.5::double) * 0.65::double - least(0.08::double, 0.015::double * greatest(0, n_support - 3)) + (case when open and gain > 0 then gain else 0.0 end) + 0.06::double * (purity - 0.5::double * noise), 9)")} shaping from ({SHAPED_ROWS})"""
