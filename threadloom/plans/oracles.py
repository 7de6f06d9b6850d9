"""DuckDB SQL of the library's queries, composed from common table expressions."""

from __future__ import annotations

from ..functions.text import ARTICLES, STOPWORDS
from ..operators.reports import CASES
from . import retrieval_oracles
from .binding import RUNS, TAU

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
SPACE = r"'^\s+|\s+$'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {SPACE}, '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda t: lower(t))"


def content(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: length(t) > 2 and t not in ({STOP}))"


def entity(x: str) -> str:
    return f"case when len({content(x)}) > 0 then {content(x)} else list_slice(list_filter({tokens(x)}, lambda t: length(t) > 1), 1, 4) end"


def sentences(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace({strip(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"case when len({parts}) > 0 or {strip(x)} = '' then {parts} else [{strip(x)}] end"


def answer(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"list_filter(string_split({squash(bare)}, ' '), lambda t: t not in ('', {', '.join(repr(a) for a in ARTICLES)}))"


def common_tokens() -> str:
    return "list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda y: y = t)))))"


def f1(both_empty: str) -> str:
    return f"case when len(p) = 0 and len(g) = 0 then {both_empty} when len(p) = 0 or len(g) = 0 then 0.0 else 2.0 * coalesce({common_tokens()}, 0) / (len(p) + len(g)) end"


#: name -> (needed names, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "dtok": ((), f"select distinct doc_id, tok from (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) tok from documents) where length(tok) > 2 and tok not in ({STOP})"),
    "qtok": ((), f"select qid, tok, min(pos) pos from (select item_id qid, unnest(l) tok, unnest(range(len(l))) pos from (select item_id, {content('text')} l from benchmark)) group by all"),
    "sup": (("dtok",), "select tok, count(*) freq from dtok group by tok"),
    "anch": (("qtok", "sup"), "select * from (select qid, tok, freq, pos, score, row_number() over (partition by qid order by score desc, freq, pos) rank from (select qid, tok, freq, pos, 0.75::double / (1 + freq) + 0.25::double / (1 + 0.15::double * greatest(0, freq - 1)) score from qtok join sup using (tok))) where rank <= 5"),
    "hits": (("anch", "dtok"), "select * from (select qid, doc_id, score, n_anchors, row_number() over (partition by qid order by score desc, doc_id) rank from (select qid, doc_id, round(sum(score), 9) score, count(*) n_anchors from anch join dtok using (tok) group by all)) where rank <= 5"),
    "dsent": ((), f"select doc_id, unnest(l) text, unnest(range(len(l))) unit_idx from (select doc_id, {sentences('text')} l from documents)"),
    "ctx": (("hits",), f"select qid, doc_id, doc_rank, unnest(l) text, unnest(range(len(l))) unit_idx from (select qid, doc_id, h.rank doc_rank, {sentences('text')} l from hits h join documents using (doc_id))"),
    "sents": (("ctx",), "select *, 's::' || doc_id || ':' || unit_idx node from ctx"),
    "edges": (("sents",), f"select qid, node src, nxt dst, 'adjacent' edge_type from (select qid, node, lead(node) over (partition by qid, doc_id order by unit_idx) nxt from sents) where nxt is not null union all select distinct qid, node, 'e::' || unnest(list_distinct({entity('text')})), 'mentions' from sents"),
    "adj": (("edges",), "select qid, src, dst from edges union select qid, dst, src from edges"),
    "deg": (("adj",), "select qid, src node, count(*) degree from adj group by all"),
    "srcs": (("anch", "adj"), "select qid, 'e::' || tok source from anch where (qid, 'e::' || tok) in (select qid, src from adj)"),
    "f0": (("srcs",), "select qid, source, source node from srcs"),
    "sim": (("sents",), f"select qid, node, round(2 * (case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end) - 1, 9) sim from (select s.qid, node, list_distinct({content('q.text')}) a, list_distinct({content('s.text')}) b from sents s join benchmark q on s.qid = q.item_id)"),
    "fwd": (("edges",), "select qid, dst ent, src unit, row_number() over (partition by qid, dst order by src) rn from edges where edge_type = 'mentions'"),
    "bck": (("edges",), "select qid, src unit, dst ent, row_number() over (partition by qid, src order by dst) rn from edges where edge_type = 'mentions'"),
    "prop": (("dist", "sim"), f"select *, greatest(base, 0.05::double) + 0.02::double / rn score from (select *, row_number() over (partition by qid, source order by base desc, node) rn from (select d.qid, source, d.node, 0.90::double * round(0.5::double * (sim + 1), 9) + 0.10::double * (1 - least(dist, {TAU}) / {TAU}.0::double) base from dist d join sim s on s.qid = d.qid and s.node = d.node)) where rn <= 20"),
    "gold": ((), "select item_id qid, doc_id from benchmark b join documents d on contains(d.text, b.text)"),
    "sums": ((), "select lang dataset, source variant, round(avg(quality), 6) recall, round(avg(quality * (1 - toxic)), 6) f1, round(avg(1 - toxic), 6) em, round(avg(n_chars), 6) ms, round(avg(length(text) / 2.0), 6) rendered from documents join labels using (doc_id) group by all"),
    "delt": (("sums",), "select s.dataset, s.variant, " + ", ".join(f"s.{m}, round(s.{m} - b.{m}, 6) delta_{m}" for m in ("recall", "f1", "em", "ms", "rendered")) + " from sums s left join (select * from sums where variant = 'src0') b on s.dataset = b.dataset"),
    "pairs": ((), "select conv_id, turn, text gold, nt prediction from (select *, lead(role) over w nr, lead(text) over w nt from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'"),
    "centers": (("sents", "sim"), "select * from (select s.qid, doc_id, unit_idx, row_number() over (partition by s.qid order by sim desc, doc_id, unit_idx) rank from sents s join sim on s.qid = sim.qid and s.node = sim.node) where rank <= 5"),
    "exc": (("centers", "sents"), "select c.qid, c.rank, c.doc_id, c.unit_idx center, count(*) n, string_agg(s.text, ' ' order by s.unit_idx) excerpt from centers c join (select distinct doc_id, unit_idx, text from sents) s on s.doc_id = c.doc_id and s.unit_idx between c.unit_idx - 1 and c.unit_idx + 1 group by all"),
    "redges": (("edges",), f"select run, qid, src, dst from (select distinct qid, src, dst from edges), (select unnest(range({RUNS})) run) where ('0x' || substr(sha1(run || '|' || qid || '|' || least(src, dst) || '|' || greatest(src, dst)), 1, 8))::bigint >= {int(0.1 * (1 << 32))}"),
    "etext": (("dsent",), f"select 'e::' || tok node, 'Entity: ' || tok || chr(10) || 'Context: ' || string_agg(text, ' ' order by rn) text from (select *, row_number() over (partition by tok order by node) rn from (select tok, text, min('s::' || doc_id || ':' || unit_idx) node from (select doc_id, unit_idx, text, unnest(list_distinct({entity('text')})) tok from dsent) group by tok, text)) where rn <= 2 group by tok"),
    "chunks": ((), f"""select doc_id, text, row_number() over (partition by doc_id order by i) - 1 unit_idx from (select doc_id, text, min(i) i from (select doc_id, i, {squash(strip("substr(array_to_string(list_slice(l, i + 1, i + 3), ' '), 1, 900)"))} text from (select doc_id, l, unnest(case when len(l) <= 3 then [0] else range(0, len(l), 2) end) i from (select doc_id, {sentences('text')} l from documents)) where i = 0 or len(l) <= 3 or (i + 1 < len(l) and least(len(l), i + 3) - i >= 2)) where text <> '' group by doc_id, text)"""),
    "cedge": (("chunks",), f"select distinct 'c::' || doc_id || ':' || unit_idx src, 'e::' || unnest(list_distinct({entity('text')})) dst from chunks"),
}
for _k in range(1, TAU + 1):
    _seen = " union all ".join(f"select qid, source, node from f{j}" for j in range(_k))
    PARTS[f"f{_k}"] = (("adj", *(f"f{j}" for j in range(_k))), f"select distinct f.qid, f.source, a.dst node from f{_k - 1} f join adj a on f.qid = a.qid and f.node = a.src where (f.qid, f.source, a.dst) not in ({_seen})")
PARTS["dist"] = (tuple(f"f{j}" for j in range(TAU + 1)), " union all ".join(f"select qid, source, node, {j} dist from f{j}" for j in range(TAU + 1)))
PARTS["rv"] = (("srcs",), "select qid, source node, 1.0::double / count(*) over (partition by qid) mass from (select distinct qid, source from srcs)")
PARTS["r0"] = (("rv",), "select * from rv")
for _k in range(1, 5):
    PARTS[f"r{_k}"] = ((f"r{_k - 1}", "adj", "deg", "rv"), f"select qid, node, sum(mass) mass from (select r.qid, a.dst node, 0.85::double * r.mass / d.degree mass from r{_k - 1} r join adj a on r.qid = a.qid and r.node = a.src join deg d on d.qid = r.qid and d.node = r.node union all select qid, node, 0.15::double * mass from rv) group by all")
PARTS |= retrieval_oracles.parts(content)
PARTS["inner_edges"] = (("adj", "srcs"), "select a.qid, src, dst from adj a where (not src like 's::%' or exists (select 1 from srcs s where s.qid = a.qid and s.source = a.src)) and (not dst like 's::%' or exists (select 1 from srcs s where s.qid = a.qid and s.source = a.dst))")
PARTS["bcand"] = (("dist", "sim", "deg"), f"""select * from (select *, row_number() over (partition by qid order by score desc, node) rank from (select qid, node, max(score) score, count(*) pairs from (
    select *, row_number() over (partition by qid, l, r order by score desc, node) k from (
    select a.qid, a.node, a.source l, b.source r, round(0.45::double * 0.5 * (coalesce(sim, 0) + 1) + 0.35::double * (1 - (a.dist + b.dist) / {2 * TAU}.0::double) + 0.20::double * degree / top, 9) score
    from dist a join dist b on a.qid = b.qid and a.node = b.node and a.source < b.source left join sim on sim.qid = a.qid and sim.node = a.node join deg on deg.qid = a.qid and deg.node = a.node
    join (select qid, max(degree) top from deg group by qid) t on t.qid = a.qid where a.node <> a.source and a.node <> b.source and a.dist <= {TAU} and b.dist <= {TAU})) where k <= 8 group by qid, node)) where rank <= 48""")


def sql(body: str, *names: str) -> str:
    """A query over the parts it names and those they need."""
    order: list[str] = []

    def need(n: str) -> None:
        if n not in order:
            for m in PARTS[n][0]:
                need(m)
            order.append(n)

    for n in names:
        need(n)
    return ("with " + ", ".join(f"{n} as materialized ({PARTS[n][1]})" for n in order) + " " if order else "") + body


def minmax(zero: str, eps: str = "0") -> str:
    return f"round(case when hi - lo > {eps} then (value - lo) / (hi - lo) {zero} end, 6)"


def joined_text(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def describe(value: str, by: str, table: str) -> str:
    return f"select {by}, count({value}) n, round(avg({value}), 6) mean, round(quantile_cont({value}, 0.5), 6) median, round(quantile_cont({value}, 0.9), 6) p90, round(max({value}), 6) max from {table} group by {by}"


RECALL = "select g.qid, " + ", ".join(f"round(coalesce(h.{c}, 0)::double / n, 6) {n}" for c, n in (("hit", "recall"),)) + ", round(case when coalesce(u, 0) > 0 then coalesce(h.hit, 0)::double / u else 0.0 end, 6) \"precision\", " + ", ".join(f"round(coalesce(h{k}, 0)::double / n, 6) recall_{k}" for k in (1, 2, 5)) + " from (select qid, count(distinct doc_id) n from gold group by qid) g left join (select h.qid, count(distinct g.doc_id) hit, count(distinct h.doc_id) u, " + ", ".join(f"count(distinct case when rank <= {k} then g.doc_id end) h{k}" for k in (1, 2, 5)) + " from hits h left join gold g on h.qid = g.qid and h.doc_id = g.doc_id group by h.qid) h on g.qid = h.qid"

#: Recall without rounding, for means over questions.
EXACT_RECALL = RECALL.replace("round(", "(").replace(", 6)", ")")
STAGES = [s.removesuffix("_ms") for group in CASES.values() for s in group]


def recommendation() -> str:
    stage = {s: f"round(avg(value) filter (event_id % {len(STAGES)} = {i}), 6)" for i, s in enumerate(STAGES)}
    sums = {case: " + ".join(f"coalesce({x.removesuffix('_ms')}, 0.0)" for x in group) for case, group in CASES.items()}
    first = lambda names, top: " ".join(f"when {n} = {top} then '{label}'" for n, label in names)
    inner = ", ".join(f"{v} {k}" for k, v in stage.items())
    cases = first([(c.lower() + "_sum", c) for c in CASES], "greatest(" + ", ".join(c.lower() + "_sum" for c in CASES) + ")")
    slow = first([(f"coalesce({s}, 0.0)", f"{s}_ms") for s in STAGES], "greatest(" + ", ".join(f"coalesce({s}, 0.0)" for s in STAGES) + ")")
    return f"""select event_type, case when c = 'E' and total > 0 and proposal_subgraph_build / total >= 0.15::double and nodes >= 5000 then 'D' else c end "case", slow primary_stage from (
        select *, case {cases} end c, case {slow} end slow from (select *, {", ".join(f"{v} {k.lower()}_sum" for k, v in sums.items())} from (
        select event_type, {inner}, round(sum(value) / 1000, 6) total, max(event_id) nodes from events group by event_type)))"""


TWO_TIER = """with q as (select vec_id qid, embedding::double[] v from embeddings where vec_id % 50 = 0), c as (select vec_id id, label, embedding::double[] v from embeddings),
    short as (select a.vec_id qid, b.vec_id id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) sim from embeddings a join embeddings b on a.label = b.label where a.vec_id % 100 = 0 and b.vec_id % 10 = 3),
    first as (select * from (select *, row_number() over (partition by qid order by sim desc, id) rank from short) where rank <= 5),
    poor as (select * from q where qid not in (select qid from first group by qid having count(*) >= 5)),
    wide as (select * from (select *, row_number() over (partition by qid order by sim desc, id) rank from (select p.qid, c.id, round(list_cosine_similarity(p.v, c.v), 6) sim from poor p, c)) where rank <= 5)
    select qid, rank, id, 'shortlist' tier, round(sim, 4) sim from first where qid not in (select qid from wide) union all select qid, rank, id, 'global', round(sim, 4) from wide"""

HYBRID = sql(f"""select qid, row_number() over (partition by qid order by lexical desc, sim desc, o) rank, token, lexical = 0 added from (
    select qid, tok token, 1 lexical, 0.0::double sim, rank o from anch union all select qid, token, 0, sim, k from (select *, row_number() over (partition by qid order by score desc, token) k from (
    select * from (select *, row_number() over (partition by qid order by score desc, token) place from (select n.qid, n.token, n.sim, 0.70::double * 0.5::double * (n.sim + 1) + 0.10::double * (case when q.tok is null then 0 else 1 end) + 0.20::double / (1 + s.freq) score
    from (select qid, substr(node, 4) token, {retrieval_oracles.settled("k / 5.0::double - 0.5::double")} sim from (select qid, node, count(distinct source) k from dist where dist = 2 and node like 'e::%' group by all)) n
    join sup s on s.tok = n.token left join qtok q on q.qid = n.qid and q.tok = n.token)) where place <= 24) z anti join anch a on a.qid = z.qid and a.tok = z.token) where k <= 2) qualify rank <= 5""", "anch", "dist", "sup", "qtok")

# the reduced graph: from each anchor's first proposals back over all parents
PARTS["ptop"] = (("prop", "dist"), f"select p.qid, p.source, p.node, d.dist from prop p join dist d on d.qid = p.qid and d.source = p.source and d.node = p.node where p.rn <= 7 and d.dist <= {TAU}")
for _k in range(TAU, -1, -1):
    _more = f" union select c.qid, c.source, x.node from up{_k + 1} c join adj a on a.qid = c.qid and a.src = c.node join dist x on x.qid = c.qid and x.source = c.source and x.node = a.dst and x.dist = {_k}" if _k < TAU else ""
    PARTS[f"up{_k}"] = (("ptop", "adj", "dist", *([f"up{_k + 1}"] if _k < TAU else [])), f"select qid, source, node from ptop where dist = {_k}{_more}" if _more else f"select distinct qid, source, node from ptop where dist = {_k}")
PARTS["keep"] = (("srcs", "prop", "deg", *(f"up{k}" for k in range(TAU + 1))), "select qid, node from (select k.qid, k.node, must, row_number() over (partition by k.qid order by must desc, round(score + 0.02::double * least(1.0::double, coalesce(degree, 0) / 25.0::double), 9) desc, k.node) place from (select qid, node, max(must) must, max(score) score from (select qid, source node, 1 must, 0.0::double score from srcs union all select qid, node, 0, score from prop union all "
    + " union all ".join(f"select qid, node, 0, 0.0::double from up{k}" for k in range(TAU + 1)) + ") group by qid, node) k left join deg g on g.qid = k.qid and g.node = k.node) where place <= 30000 or must = 1")

ORACLES: dict[str, str] = {
    "token_stats": f"select doc_id, len({tokens('text')}) n_tokens, len({content('text')}) n_content, md5({joined_text(content('text'))}) content_md5 from documents",
    "entity_tokens": f"select doc_id, {joined_text(entity('text'))} tokens from documents",
    "sentence_split": sql("select doc_id, unit_idx::int unit_idx, text from dsent", "dsent"),
    "sentence_chunks": sql("select doc_id, unit_idx::int unit_idx, text from chunks", "chunks"),
    "match_keys": f"select doc_id, md5(lower({squash('text')})) match_md5, md5(substr({squash('text')}, 1, 384)) query_md5, length(substr({strip('text')}, 1, 900)) clipped from documents",
    "answer_normalize": f"select conv_id, turn, {joined_text(answer('text'))} answer from conversations",
    "em_f1_legacy": sql(f"select conv_id, turn, (case when p = g then 1.0 else 0.0 end)::double em, round({f1('1.0')}, 6)::double f1 from (select conv_id, turn, {answer('prediction')} p, {answer('gold')} g from pairs)", "pairs"),
    "em_f1_parity": sql(f"select conv_id, turn, max(case when p = g then 1.0 else 0.0 end)::double em, round(max({f1('0.0')}), 6)::double f1 from (select conv_id, turn, {answer('prediction')} p, {answer('one')} g from (select conv_id, turn, prediction, unnest([gold, array_to_string(list_slice(string_split(gold, ' '), 1, 3), ' ')]) one from pairs)) group by all", "pairs"),
    "evaluator_cross_check": sql(f"select conv_id % 2 odd, round(avg(a), 6)::double left_mean, round(avg(b), 6)::double right_mean, round(avg(a - b), 6)::double mean_diff, round(max(abs(a - b)), 6)::double max_diff, count(case when abs(a - b) > 1e-9 then 1 end) n_diff from (select conv_id, ({f1('1.0')})::double a, ({f1('0.0')})::double b from (select conv_id, {answer('prediction')} p, {answer('gold')} g from pairs)) group by 1", "pairs"),
    "minmax_variants": f"select event_id, {minmax('when hi > 0 then 1.0 else 0.0')} as_map, {minmax('else 0.0')} as_list, {minmax('when hi > 0 then 1.0 else 0.0', '1e-12')} as_vector from (select event_id, value, min(value) over w lo, max(value) over w hi from events window w as (partition by user_id))",
    "unit_ids": "select doc_id, 'chunk::doc::' || source || '::' || doc_id unit, 'chunk' kind, 'doc::' || source title, doc_id idx from documents",
    "question_overlap": sql(f"select qid, doc_id, round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 6) jaccard from (select qid, h.doc_id, list_distinct({content('q.text')}) a, list_distinct({content('d.text')}) b from hits h join benchmark q on q.item_id = h.qid join documents d on d.doc_id = h.doc_id)", "hits"),
    "corpus_entities": sql("select tok token, freq from sup", "sup"),
    "graph_edges": sql("select src, dst, 'entity_chunk_support' edge_type from cedge", "cedge"),
    "sentence_layer": f"select distinct 's::' || doc_id || ':' || unit_idx src, 'e::' || unnest(list_distinct({entity('text')})) dst from (select doc_id, unnest(l) text, unnest(range(len(l))) unit_idx from (select doc_id, {sentences('text')} l from documents))",
    "graph_stats": sql("select 'node' what, 'chunk' kind, count(distinct src) n from cedge union all select 'node', 'entity', count(distinct dst) from cedge union all select 'edge', 'entity_chunk_support', count(*) from cedge", "cedge"),
    "degree_table": sql("select node, count(*) degree from (select src node, dst o from cedge union select dst, src from cedge) group by node", "cedge"),
    "entity_texts": sql("select * from etext", "etext"),
    "semantic_records": sql("select 'entity' kind, node, text from etext union all select 'chunk', 'c::' || doc_id || ':' || unit_idx, case when trim(coalesce(d.source, '')) <> '' then 'Title: ' || trim(d.source) || chr(10) || 'Passage: ' || c.text else c.text end from chunks c join documents d using (doc_id)", "etext", "chunks"),
    "chunk_contains_sentence": sql(f"select 'c::' || c.doc_id || ':' || c.unit_idx src, 's::' || s.doc_id || ':' || s.unit_idx dst from chunks c join (select doc_id, unit_idx, {squash('text')} t from dsent) s on c.doc_id = s.doc_id and contains(c.text, s.t) where s.t <> ''", "chunks", "dsent"),
    "support_topk": sql("select * from (select dst entity, src chunk, row_number() over (partition by dst order by src) - 1 rank from cedge) where rank < 32", "cedge"),
    "support_topk_chunks": sql("select * from (select src chunk, dst entity, row_number() over (partition by src order by dst) - 1 rank from cedge) where rank < 8", "cedge"),
    "pending_extractions": sql("select doc_id, unit_idx::int unit_idx, k cache_key from (select *, 'sentence:' || doc_id || ':' || unit_idx || ':' || substr(sha1(text), 1, 16) k from dsent) where doc_id not in (select doc_id from labels)", "dsent"),
    "merged_edges": "select 'c' || o_custkey src, 'p' || l_partkey dst, max(l_quantity) weight from orders join lineitem on l_orderkey = o_orderkey group by all",
    "anchor_select": sql("select qid, rank, tok token, freq, round(score, 6) score from anch", "anch"),
    "context_proposals": sql("select qid, rank, doc_id, round(score, 6) score, n_anchors from hits", "hits"),
    "question_graph": sql("select qid, src, dst, edge_type from edges", "edges"),
    "graph_reserve": sql("select qid, rank, node, dist, round(score, 6) score from (select *, row_number() over (partition by qid order by score desc, node) rank from (select m.qid, m.node, m.dist, round(0.80::double / (1 + m.dist) + 0.20::double * least(1.0, degree / 20.0::double), 9) score from (select qid, node, min(dist) dist from dist where dist > 0 group by all) m join deg on deg.qid = m.qid and deg.node = m.node)) where rank <= 32", "dist", "deg"),
    "normalized_norms": "select vec_id, round(1.0, 6)::double norm2, round(list_dot_product(embedding::double[], embedding::double[]), 5) raw2 from embeddings",
    "cosine_topk": "select qid, rank, id, round(sim, 4) sim from (select *, row_number() over (partition by qid order by sim desc, id) rank from (select q.vec_id qid, v.vec_id id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) sim from embeddings q, embeddings v where q.vec_id % 50 = 0)) where rank <= 5",
    "bfs_distance": sql("select qid, source, node, dist::bigint dist from dist", "dist"),
    "min_set_distance": sql(f"select a.qid, a.node, least({TAU}, coalesce(d, {TAU}))::bigint dist from (select distinct qid, src node from adj) a left join (select qid, node, min(dist) d from dist group by all) m on a.qid = m.qid and a.node = m.node", "adj", "dist"),
    "edge_drop_runs": sql("select run::int run, qid, src, dst from redges", "redges"),
    "ppr_fixed_k": sql("select qid, node, round(mass + 1e-10, 6) mass from r4", "r4"),
    "render_flat": sql("select qid, md5(string_agg(case when r <= 10 then '[' || r || '] (' || node || ') ' || text end, chr(10) order by r)) context_md5, count(case when r <= 10 then 1 end) units, count(*) > 10 truncated from (select *, row_number() over (partition by qid order by doc_rank, unit_idx) r from sents) group by qid", "sents"),
    "excerpt_window": sql("select qid, rank, doc_id, center, n, md5(excerpt) excerpt_md5 from exc", "exc"),
    "heuristic_answer": sql(f"select qid, pos, overlap, text answer from (select *, row_number() over (partition by qid order by overlap desc, pos) k from (select s.qid, s.text, row_number() over (partition by s.qid order by doc_rank, unit_idx) pos, len(list_intersect(list_distinct({tokens('q.text')}), list_distinct({tokens('s.text')}))) overlap from sents s join benchmark q on q.item_id = s.qid)) where k = 1", "sents"),
    "oracle_injection": sql("select qid, row_number() over (partition by qid order by o, pos, node) place, node from (select qid, node, min(o) o, min_by(pos, o) pos from (select qid, doc_id::varchar node, 0 o, 0 pos from gold union all select qid, doc_id::varchar, 1, rank from hits) group by all)", "gold", "hits"),
    "shortlist_decay": sql("select * from (select qid, row_number() over (partition by qid order by score desc, unit) rank, unit, score from (select a.qid, unit, round(max(greatest(0.0, 0.92::double - 0.03::double * s.rank - 0.02::double * (a.rank - 1))), 6) score from anch a join (select qid, src unit, substr(dst, 4) tok, row_number() over (partition by qid, dst order by src) - 1 rank from edges where edge_type = 'mentions') s on a.qid = s.qid and a.tok = s.tok where s.rank < 12 group by a.qid, unit)) where rank <= 256", "anch", "edges"),
    "anchor_proposals": sql("select qid, source, node, rn - 1 rank, round(score, 6) score from prop", "prop"),
    "lazy_union": sql("select qid, rank, node, round(score, 6) score, votes from (select *, row_number() over (partition by qid order by anchor desc, (votes >= 2) desc, score desc, node) rank from (select qid, node, max(score) score, max(votes) votes, max(anchor) anchor from (select qid, node, max(round(score, 9)) score, count(distinct source) votes, 0 anchor from prop group by qid, node union all select qid, source, 0.0, 0, 1 from srcs) group by qid, node)) where rank <= 64", "prop", "srcs"),
    "embedding_fusion": sql("select qid, row_number() over (partition by qid order by fused desc nulls last, case when fused is not null then -sim end, pos) rank, node, round(fused, 6) fused from (select qid, node, pos, sim, case when pos <= 80 then round(0.65::double * (case when bh > bl then (base - bl) / (bh - bl) else 0 end) + 0.35::double * (case when sh > sl then (sim - sl) / (sh - sl) else 0 end), 9) end fused from (select *, min(base) filter (where pos <= 80) over w bl, max(base) filter (where pos <= 80) over w bh, min(sim) filter (where pos <= 80) over w sl, max(sim) filter (where pos <= 80) over w sh from (select s.qid, s.node, sim, row_number() over (partition by s.qid order by doc_rank, unit_idx) pos, round(1.0::double / (doc_rank + 1), 9) base from sents s join sim m on m.qid = s.qid and m.node = s.node) window w as (partition by qid)))", "sents", "sim"),
    "cache_reserve": sql("select qid, source, rank, node, round(score, 6) score from (select *, row_number() over (partition by qid, source order by score desc, node) rank from (select qid, source, node, round(max(score), 9) score from (select s.qid, s.source, f.unit node, 1.0::double - 0.04::double * (f.rn - 1) score from srcs s join fwd f on f.qid = s.qid and f.ent = s.source where f.rn <= 30 union all select s.qid, s.source, b.ent, 0.82::double - 0.06::double * (f.rn - 1) - 0.04::double * (b.rn - 1) from srcs s join fwd f on f.qid = s.qid and f.ent = s.source join bck b on b.qid = s.qid and b.unit = f.unit where f.rn <= 30 and b.rn <= 2 and b.ent <> s.source union all select s.qid, s.source, a.dst, 0.35::double + 0.15::double * least(1.0, d.degree / 20.0::double) from srcs s join adj a on a.qid = s.qid and a.src = s.source join deg d on d.qid = s.qid and d.node = a.dst) group by all)) where rank <= 15", "srcs", "fwd", "bck", "adj", "deg"),
    "generated_answers": sql(f"select qid, text prediction from (select *, row_number() over (partition by qid order by overlap desc, pos) k from (select s.qid, s.text, row_number() over (partition by s.qid order by doc_rank, unit_idx) pos, len(list_intersect(list_distinct({tokens('q.text')}), list_distinct({tokens('s.text')}))) overlap from sents s join benchmark q on q.item_id = s.qid)) where k = 1", "sents"),
    "recall_at_k": sql(RECALL, "gold", "hits"),
    "recall_cuts": sql("select variant, count(*) n, round(avg(recall), 6) recall from (select unnest(['full', 'short', 'first']) variant, unnest([recall_5, recall_2, recall_1]) recall from (" + RECALL + ")) group by variant", "gold", "hits"),
    "loss_funnel": sql("select stage, round(rate, 6) rate, round(coalesce(lag(rate) over (order by pos) - rate, 0), 6) loss from (select pos, stage, avg(case when h.qid is null then 0 else 1 end) rate from (select distinct qid, doc_id from gold) g, (values (0, 'anchored'), (1, 'proposed'), (2, 'rendered')) s(pos, stage) left join (select distinct a.qid, doc_id, 'anchored' st from anch a join dtok using (tok) union all select qid, doc_id, 'proposed' from hits union all select qid, doc_id, 'rendered' from hits where rank <= 2) h on h.qid = g.qid and h.doc_id = g.doc_id and h.st = stage group by pos, stage)", "gold", "anch", "dtok", "hits"),
    "latency_describe": describe("value", "event_type", "events"),
    "latency_pearson": "select event_type, round(corr(value, hour(ts)), 6) pearson from events group by event_type",
    "fast_slow_groups": "select event_type, round(avg(case when r <= k then value end), 6) fast_mean, round(avg(case when r > n - k then value end), 6) slow_mean from (select *, greatest(1, floor(n * 0.3::double)) k from (select event_type, value, row_number() over (partition by event_type order by value, event_id) r, count(*) over (partition by event_type) n from events)) group by event_type",
    "bottleneck_rank": "select row_number() over (order by total desc, event_type) place, event_type, round(total, 4) total, round(mean, 6) mean, round(total / sum(total) over (), 6) share from (select event_type, sum(value) total, avg(value) mean from events group by event_type)",
    "error_rates": "select event_type, n, round(n::double / sum(n) over (), 6) share from (select event_type, count(*) n from events group by all)",
    "stage_summary": "select lang, count(*) n, round(coalesce(avg(quality), 0), 6) quality, round(coalesce(avg(toxic), 0), 6) toxic, round(avg(n_chars), 6) n_chars from documents left join labels using (doc_id) group by lang",
    "run_table": sql("select * from sums", "sums"),
    "grid_profiles": "select row_number() over (order by a, b, c, d, e) - 1 profile, [3, 5, 8][a] max_anchors, [2, 4][b] tau, [2, 4][c] seed_k, [1, 2, 4][d] runs, [true, false][e] trim from range(1, 4) r(a), range(1, 3) s(b), range(1, 3) t(c), range(1, 4) u(d), range(1, 3) v(e)",
    "variant_delta": sql("select * from delt", "delt"),
    "guarded_topk": sql("select dataset, place, variant, delta_recall, delta_f1 from (select *, row_number() over (partition by dataset order by delta_f1 desc, delta_em desc, delta_rendered desc, delta_ms, variant) place from (select *, bool_or(delta_recall >= -0.01) over (partition by dataset) holds from delt where variant <> 'src0') where delta_recall >= -0.01 or not holds) where place <= 3", "delt"),
    "best_delta_f1": sql("select dataset, variant, delta_f1 from (select *, row_number() over (partition by dataset order by delta_f1 desc, variant) o from delt) where o = 1", "delt"),
    "top_variants": sql("select dataset, place, variant profile, f1 from (select *, row_number() over (partition by dataset order by f1 desc, variant) place from sums) where place <= 3", "sums"),
    "reference_gaps": sql("select s.dataset, variant, metric, ours, ref reference, round(ours - ref, 6) gap from (select dataset, variant, unnest(['recall', 'f1', 'em']) metric, unnest([recall, f1, em]) ours from sums) s join (values ('recall', 0.95::double), ('f1', 0.5154::double), ('em', 0.335::double)) c(m, ref) on m = metric", "sums"),
    "pareto_winners": sql("select dataset, winner, variant, f1, ms from (select *, unnest(['accuracy', 'efficiency', 'balanced']) winner, unnest([a, e, b]) place from (select *, row_number() over (partition by dataset order by f1 desc, ms, variant) a, row_number() over (partition by dataset order by ms, f1 desc, variant) e, row_number() over (partition by dataset order by gain desc nulls last, variant) b from (select s.*, case when s.f1 >= t.f1 and s.ms <= t.ms then round((case when t.f1 > 0 then (s.f1 - t.f1) / t.f1 else 0 end) + (case when t.ms > 0 then (t.ms - s.ms) / t.ms else 0 end), 9) end gain from sums s join sums t on s.dataset = t.dataset and t.variant = 'src0'))) where place = 1", "sums"),
    "length_audit": f"select lang, count(*) n, round(avg(c), 4) mean_chars, round(quantile_cont(c, 0.5), 4)::double p50_chars, round(quantile_cont(c, 0.95), 4)::double p95_chars, round(quantile_cont(c, 0.99), 4)::double p99_chars, max(c) max_chars, round(avg(case when c > 900 then 1.0 else 0.0 end), 6)::double char_clip_rate, round(quantile_cont(t, 0.95), 4)::double p95_tokens, round(avg(case when t > 256 then 1.0 else 0.0 end), 6)::double token_clip_rate from (select lang, length(text) c, len({tokens('text')}) t from documents) group by lang",
    "prompt_gate": "select count(*) n, round(quantile_cont(t, 0.95), 4)::double p95, round(quantile_cont(t, 0.99), 4)::double p99, max(t)::bigint most, round(avg(case when t > 4096 then 1.0 else 0.0 end), 6)::double over_rate, avg(case when t > 4096 then 1.0 else 0.0 end) = 0 passed from (select ceil(length(text) / 4.0) t from conversations)",
    "pending_runs": "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)",
    "latest_results": "select conv_id, max(turn) turn, md5(max_by(text, turn)) text_md5 from conversations where role = 'assistant' group by conv_id",
    "backfilled": "select doc_id, case when doc_id % 2 = 0 then n_chars else length(text) end n_chars from documents",
    "bridge_candidates": sql("select qid, rank, node, round(score, 6) score, pairs from bcand", "bcand"),
    "reduced_subgraph": sql("select a.qid, a.src, a.dst from adj a semi join keep k on k.qid = a.qid and k.node = a.src semi join keep l on l.qid = a.qid and l.node = a.dst", "adj", "keep"),
    "dense_rerank": "select qid, rank, id, round(dot, 4) sim from (select *, row_number() over (partition by qid order by dot desc, id) rank from (select *, row_number() over (partition by qid order by sim desc, id) c from (select q.vec_id qid, v.vec_id id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) sim, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 6) dot from embeddings q, embeddings v where q.vec_id % 50 = 0)) where c <= 20) where rank <= 5",
    "seed_bridges": sql("select qid, node, round(bridge, 6) bridge from brdg", "brdg"),
    "paragraph_chunks": f"""select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int unit_idx, text from (select doc_id, text, min(p * 1000000 + i) k from (
        select doc_id, p, i, {squash(strip("substr(array_to_string(list_slice(l, i + 1, i + 3), ' '), 1, 900)"))} text from (select doc_id, p, l, unnest(case when len(l) <= 3 then [0] else range(0, len(l), 2) end) i from (
        select doc_id, p, {sentences('par')} l from (select doc_id, unnest(l) par, unnest(range(len(l))) p from (select doc_id, list_filter(list_transform(regexp_split_to_array({strip('text')}, '\\n\\s*\\n+'), lambda x: {strip('x')}), lambda x: x <> '') l from documents))))
        where i = 0 or len(l) <= 3 or (i + 1 < len(l) and least(len(l), i + 3) - i >= 2)) where text <> '' group by doc_id, text)""",
    "length_audit_total": f"select sum(n)::bigint n, round(sum(c * n) / sum(n), 6) char_clip_rate, round(sum(t * n) / sum(n), 6) token_clip_rate from (select count(*) n, round(avg(case when length(text) > 900 then 1.0 else 0.0 end), 6)::double c, round(avg(case when len({tokens('text')}) > 256 then 1.0 else 0.0 end), 6)::double t from documents group by lang)",
    "error_buckets": "select event_type, bucket, n, round(n::double / sum(n) over (partition by event_type), 6) share from (select event_type, case when not bridge then 'bridge_missing' when not answer then 'answer_side_missing' when failed then 'answer_present_generation_fail' when bridge and answer and (noise >= 0.55::double or (p < 0.25::double and (red >= 0.60::double or f1 < 0.25::double))) then 'bridge_present_noisy' else 'none' end bucket, count(*) n from (select event_type, greatest((e % 3) / 3.0::double, (e % 5) / 5.0::double) >= 0.35::double bridge, greatest((e % 7) / 7.0::double, (e % 4) / 4.0::double, (e % 6) / 6.0::double) >= 0.25::double answer, event_type <> 'error' and (e % 10) / 10.0::double <= 0.01::double failed, (e % 9) / 9.0::double noise, greatest((e % 11) / 11.0::double, (e % 13) / 13.0::double) p, (e % 8) / 8.0::double red, (e % 10) / 10.0::double f1 from (select *, event_id e from events)) group by all)",
    "derived_metrics": sql("select dataset, variant, round(case when recall > 0 then rendered / recall else 0 end, 6)::double retention, round(case when rendered > 0 then f1 / rendered else 0 end, 6)::double conversion, round(gap, 6)::double oracle_gap, round(case when ms > 0 then 100 * f1 / ms else 0 end, 6)::double f1_per_100ms, round(case when ms > 0 then 100 * recall / (ms / 2) else 0 end, 6)::double r5_per_100ms, round(case when ms > 0 then gap / ms else 0 end, 6)::double oracle_gap_per_ms, round(0.5154::double - f1, 6)::double gap_to_reference_f1, round(case when dataset <> 'fr' then 0.95::double - recall else 0 end, 6)::double gap_to_reference_r5 from (select *, case when variant <> 'src1' then 1.0::double - f1 else 0.0::double end gap from sums)", "sums"),
    "profile_record": "select user_id qid, " + ", ".join(f"round(coalesce(sum(value) filter (event_id % {len(STAGES)} = {i}), 0.0), 6) {n}_ms" for i, n in enumerate(STAGES)) + f", round(sum(value), 6) total_ms, count(distinct event_id % {len(STAGES)}) n_stages from events group by user_id",
    "profile_subset": "select qid, total_ms, place from (select *, row_number() over (order by place) k from (select user_id qid, round(sum(value), 6) total_ms, row_number() over (order by user_id) - 1 place from events group by user_id) where place % 3 = 0 and place < 60) where k <= 12",
    "priority_recommendation": recommendation(),
    "run_summary": sql("select count(*) n, round(avg((recall > 0)::int), 6) hit_rate, " + ", ".join(f"round(coalesce(avg({c}), 0.0), 6) {q}" for c, q in (("recall", "recall"), ('"precision"', '"precision"'), ("recall_1", "recall_1"), ("recall_2", "recall_2"), ("recall_5", "recall_5"), ("proposed", "proposed"), ("anchored", "anchored"))) + " from (" + EXACT_RECALL + ") t left join (select qid, count(*) proposed, sum(n_anchors) anchored from hits group by qid) h on h.qid = t.qid", "gold", "hits"),
    "recomputed_metrics": sql(f"select odd, count(*) n, round(avg(em0), 6) em_legacy, round(avg(f0), 6) f1_legacy, round(avg(em1), 6) em_parity, round(avg(f2), 6) f1_parity from (select odd, k, any_value(em) filter (o = 1) em0, any_value(legacy) filter (o = 1) f0, max(em) em1, max(parity) f2 from (select odd, k, o, (case when p = g then 1.0 else 0.0 end)::double em, ({f1('1.0')})::double legacy, ({f1('0.0')})::double parity from (select odd, k, o, {answer('prediction')} p, {answer('one')} g from (select conv_id % 2 odd, conv_id || '-' || turn k, prediction, unnest(golds) one, unnest(range(1, len(golds) + 1)) o from (select *, case when conv_id % 3 = 0 then [array_to_string(list_slice(string_split(gold, ' '), 1, 5), ' '), gold] else [gold] end golds from pairs)))) group by odd, k) group by odd", "pairs"),
    "feasible_profiles": sql("select variant profile, em >= 0.9::double and (f1 >= 0.6::double or f1 > 0.5::double) and ms < 5000.0 feasible, f1, em, ms from sums where dataset = 'en' qualify row_number() over (order by feasible desc, f1 desc, em desc, ms, variant) = 1", "sums"),
    "two_tier_lookup": TWO_TIER,
    "hybrid_anchors": HYBRID,
} | retrieval_oracles.oracles(sql, tokens, content)
