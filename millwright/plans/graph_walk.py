"""Named graph-walk queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions import text as tx
from millwright.functions.common import join_lines
from millwright.operators import graph_walk as gw
from millwright.plans.registry import query
from millwright.plans.text import WIDE, duck_tags
from millwright.plans.views import CHECK_FRAGMENTS
from millwright.session import cut_lineage


def starts(t):
    return t.nodes.where("label = 'Equipment'").select(F.col("id").alias("start"))


CHECK_FRAGMENTS.update(
    x_level1="select n.id as start, e.src, e.dst, e.rel from v_nodes n join v_edges e on e.src = n.id where n.label = 'Equipment'",
    x_seen1="select distinct start, dst as node from x_level1 where dst <> start",
    x_level2="select s.start, e.src, e.dst, e.rel from x_seen1 s join v_edges e on e.src = s.node",
    x_seen2="select distinct start, dst as node from x_level2 where dst <> start except select start, node from x_seen1",
    x_level3="select s.start, e.src, e.dst, e.rel from x_seen2 s join v_edges e on e.src = s.node",
    x_walk="""select *, 1 as depth from x_level1 union all select *, 2 from x_level2 union all select *, 3 from x_level3""",
    x_question_seeds=f"select question_id, unnest({duck_tags('question', WIDE)}) as tag from v_questions",
    x_links="""select src, dst, rel, src || '|' || rel || '|' || dst as edge_id from v_rule_edges
               union all select dst, src, rel, src || '|' || rel || '|' || dst from v_rule_edges""",
)


@query(
    "neighbors_bfs",
    """select start, src, dst as tag, rel as relationship, depth from (
         select *, row_number() over (partition by start order by depth, src, dst) as r from x_walk) where r <= 50""",
)
def _(t):
    return gw.neighbors_bfs(t.nodes, cut_lineage(t.edges), starts(t), depth=3)


@query("neighbors_bfs_all", "select start, src, dst as tag, rel as relationship, depth from x_walk")
def _(t):
    return gw.neighbors_bfs(t.nodes, cut_lineage(t.edges), starts(t), depth=3, cap=None)


@query(
    "neighbors_bfs_capped",
    """select start, src, dst as tag, rel as relationship, depth from (
         select *, row_number() over (partition by start order by depth, src, dst) as r from x_walk) where r <= 6 and rel = 'part_of'""",
)
def _(t):
    return gw.neighbors_bfs(t.nodes, cut_lineage(t.edges), starts(t), depth=3, cap=6, relationship="part_of")


_PATHS = """with x_p1 as (select start, dst as tag, rel, 1 as depth, start || '>' || dst as path, [dst, rel] as s from x_level1),
            x_p2 as (select p.start, e.dst as tag, e.rel, 2 as depth, p.path || '>' || e.dst as path, list_concat(s, [e.dst, e.rel]) as s from x_p1 p join v_edges e on e.src = p.tag),
            x_p3 as (select p.start, e.dst as tag, e.rel, 3 as depth, p.path || '>' || e.dst as path, list_concat(s, [e.dst, e.rel]) as s from x_p2 p join v_edges e on e.src = p.tag)"""


@query(
    "neighbors_paths_all",
    _PATHS + " select start, tag, rel as relationship, depth, path from (select * from x_p1 union all select * from x_p2 union all select * from x_p3)",
)
def _(t):
    return gw.neighbors_paths(cut_lineage(t.edges), starts(t), depth=3, cap=None)


@query(
    "neighbors_paths",
    _PATHS + """
       select start, tag, rel as relationship, depth, path from (
         select *, row_number() over (partition by start order by depth, s) as r from (select * from x_p1 union all select * from x_p2 union all select * from x_p3)) where r <= 100""",
)
def _(t):
    return gw.neighbors_paths(cut_lineage(t.edges), starts(t), depth=3)


def seeds(t):
    return t.questions.select("question_id", F.explode(tx.wide_tags(F.col("question"))).alias("tag"))


WALKS = """with x_w1 as (select question_id, tag as origin, l.dst as node, 1 as depth, tag || ' -[:' || l.rel || ']- ' || l.dst as path, [tag, '', l.dst, l.rel] as s, [l.edge_id] as used
                     from x_question_seeds q join x_links l on l.src = q.tag),
            x_w2 as (select w.question_id, w.origin, l.dst as node, 2 as depth, w.path || ' -[:' || l.rel || ']- ' || l.dst as path, list_concat(s, [l.dst, l.rel]) as s, list_concat(used, [l.edge_id]) as used
                     from x_w1 w join x_links l on l.src = w.node and not list_contains(w.used, l.edge_id))"""


@query("rag_paths_all", WALKS + " select question_id, depth, path from (select * from x_w1 union all select * from x_w2)")
def _(t):
    return gw.rag_paths(t.rule_edges, seeds(t), cap=None).select("question_id", "depth", "path")


@query(
    "rag_paths",
    WALKS + """
       select question_id, depth, path from (
         select *, row_number() over (partition by question_id order by depth, s, used) as r from (select * from x_w1 union all select * from x_w2)) where r <= 30""",
)
def _(t):
    return gw.rag_paths(t.rule_edges, seeds(t)).select("question_id", "depth", "path")


CHECK_FRAGMENTS.update(
    x_rule_ids="select id from v_rule_nodes where label = 'ComplianceRule'",
    x_rule_adj="select distinct src, dst as code from x_links where dst in (select id from x_rule_ids)",
    x_near_all="""
        select q.question_id, a.code from x_question_seeds q join x_rule_adj a on a.src = q.tag
        union select q.question_id, a.code from x_question_seeds q join x_links l on l.src = q.tag join x_rule_adj a on a.src = l.dst
        union select q.question_id, q.tag from x_question_seeds q where q.tag in (select id from x_rule_ids)""",
    x_events_all="""
        select distinct q.question_id, q.tag as asset_id, l.dst as event_id from x_question_seeds q join x_links l on l.src = q.tag
        where l.rel in ('HAD_EVENT', 'HAS_COMPLIANCE_CHECK')""",
    x_near="select question_id, code from (select *, row_number() over (partition by question_id order by code) as r from x_near_all) where r <= 15",
    x_question_terms="select distinct question_id, unnest(list_transform(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: upper(x))) as term from v_questions",
    x_rule_texts="select rule_code, upper(rule_code || ' ' || title || ' ' || category || ' ' || regulation_body || ' ' || full_text) as body from v_rules",
    x_term_rules="select term, rule_code from (select distinct term from x_question_terms) join x_rule_texts on contains(body, term)",
    x_matched_all="select distinct question_id, rule_code as code from x_question_terms join x_term_rules using (term)",
    x_matched="""
        select question_id, code from (
          select *, row_number() over (partition by question_id order by code) as r from x_matched_all) where r <= 15""",
)


@query("rules_near_assets_all", "select question_id, code from x_near_all")
def _(t):
    return gw.rules_near_assets(t.rule_nodes, t.rule_edges, seeds(t), None)


@query("events_of_assets_all", "select question_id, asset_id, event_id from x_events_all")
def _(t):
    return gw.events_of_assets(t.rule_edges, seeds(t), None)


@query("rule_text_match_all", "select question_id, code from x_matched_all")
def _(t):
    return gw.rule_text_match(t.rules, t.questions, None)


@query(
    "rule_context_all",
    "select question_id, code, min(source) as source from (select *, 0 as source from x_near_all union all select *, 1 from x_matched_all) group by 1, 2",
)
def _(t):
    near = gw.rules_near_assets(t.rule_nodes, t.rule_edges, seeds(t), None)
    return gw.rule_context(near, gw.rule_text_match(t.rules, t.questions, None), None)


@query("rules_near_assets", "select * from x_near")
def _(t):
    return gw.rules_near_assets(t.rule_nodes, t.rule_edges, seeds(t))


@query(
    "events_of_assets",
    """select question_id, asset_id, event_id from (
         select *, row_number() over (partition by question_id order by asset_id, event_id) as r from x_events_all) where r <= 20""",
)
def _(t):
    return gw.events_of_assets(t.rule_edges, seeds(t))


@query("rule_text_match", "select * from x_matched")
def _(t):
    return gw.rule_text_match(t.rules, t.questions)


@query(
    "rule_context",
    """select question_id, code, source from (
         select *, row_number() over (partition by question_id order by source, code) as r from (
           select question_id, code, min(source) as source from (select *, 0 as source from x_near union all select *, 1 from x_matched) group by 1, 2)) where r <= 15""",
)
def _(t):
    return gw.rule_context(gw.rules_near_assets(t.rule_nodes, t.rule_edges, seeds(t)), gw.rule_text_match(t.rules, t.questions))


@query(
    "known_tags_in_text",
    f"""select id, string_agg(tag, '|' order by position) as tags from (
          select id, unnest(g) as tag, unnest(range(0, len(g))) as position from (select id, {duck_tags('text', WIDE)} as g from v_documents))
        where tag in (select id from v_rule_nodes) group by 1""",
)
def _(t):
    return gw.known_tags(t.documents.select("id", "text"), t.rule_nodes, "id").withColumn("tags", join_lines(F.col("tags")))


_PIECES = ", ".join(f"regexp_extract_all(coalesce({c}, ''), '{WIDE}', 1)" for c in ("tag", "source", "target", "path", "attribute_text"))
CHECK_FRAGMENTS.update(
    x_context_tags=f"""
        select question_id, list_filter(l, lambda x, i: list_position(l, x) = i) as graph_tags from (
          select question_id, flatten(list(list_transform(flatten([{_PIECES}]), lambda x: upper(x)) order by item)) as l from v_graph_context group by 1)""",
)


@query(
    "context_tags",
    f"""select question_id, array_to_string(asked, '|') as asked, array_to_string(graph, '|') as graph_tags,
               len(list_intersect(asked, graph)) > 0 and len(graph) > len(asked) as has_context
        from (select q.question_id, {duck_tags('q.question', WIDE)} as asked, coalesce(c.graph_tags, []) as graph
              from v_questions q left join x_context_tags c using (question_id))""",
)
def _(t):
    return gw.context_tags(t.graph_context, t.questions).select(
        "question_id", join_lines(F.col("asked")).alias("asked"), join_lines(F.col("graph_tags")).alias("graph_tags"), "has_context"
    )


@query(
    "shortest_path",
    """with x_pairs_asked as (select concat('O-', o_orderkey) as src, concat('R-', o_orderkey % 5) as dst from orders
                              union all select concat('C-', c_custkey), concat('S-', c_custkey % 10) from customer),
            x_e as (select distinct src, dst from v_edges),
            x_routes as (
              select a.src, a.dst, 1 as length, a.src || '>' || e.dst as path from x_pairs_asked a join x_e e on e.src = a.src and e.dst = a.dst
              union all select a.src, a.dst, 2, a.src || '>' || e.dst || '>' || f.dst from x_pairs_asked a join x_e e on e.src = a.src join x_e f on f.src = e.dst and f.dst = a.dst
              union all select a.src, a.dst, 3, a.src || '>' || e.dst || '>' || f.dst || '>' || g.dst from x_pairs_asked a join x_e e on e.src = a.src join x_e f on f.src = e.dst join x_e g on g.src = f.dst and g.dst = a.dst)
       select src, dst, min(length) as length, arg_min(path, (length, string_split(path, '>'))) as path from x_routes group by 1, 2""",
)
def _(t):
    orders = t.raw("orders").select(
        F.concat(F.lit("O-"), "o_orderkey").alias("src"), F.concat(F.lit("R-"), F.col("o_orderkey") % 5).alias("dst")
    )
    customers = t.raw("customer").select(
        F.concat(F.lit("C-"), "c_custkey").alias("src"), F.concat(F.lit("S-"), F.col("c_custkey") % 10).alias("dst")
    )
    # the edges are a stored table in a running plant, not a view derived anew at every hop
    return gw.shortest_paths(cut_lineage(t.edges), orders.unionByName(customers)).withColumn("path", join_lines(F.col("path"), ">"))


@query(
    "graph_stats",
    """select 'count' as part, label, n from (select label, count(*) as n from v_nodes group by 1
         union all select 'nodes', count(*) from v_nodes union all select 'edges', count(*) from v_edges)
       union all
       select 'top', tag, connections from (
         select n.id as tag, (coalesce(d.c, 0))::bigint as connections from v_nodes n
         left join (select id, count(*) as c from (select src as id from v_edges union all select dst from v_edges) group by 1) d on d.id = n.id
         order by connections desc, tag limit 10)""",
)
def _(t):
    totals, top = gw.graph_stats(t.nodes, t.edges)
    return totals.select(F.lit("count").alias("part"), "label", "n").unionByName(
        top.select(F.lit("top").alias("part"), F.col("tag").alias("label"), F.col("connections").alias("n"))
    )


@query(
    "neighbor_count",
    """select n.id, coalesce(d.c, 0) as neighbor_count from v_nodes n left join (
         select id, count(distinct other) as c from (select src as id, dst as other from v_edges union all select dst, src from v_edges) group by 1) d on d.id = n.id""",
)
def _(t):
    return gw.neighbor_counts(t.nodes, t.edges)
