"""Neighbours, paths and context of the equipment graph.

Walks start from a table of seeds and advance one join per hop.  Where a result
is capped, its order is fixed, so each hop keeps only what the cap can still
reach: the first edges of a node and the first rows of a seed.  A hub node then
costs a seed no more than the cap, and the capped result stays exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions import text as tx
from millwright.functions.common import unnest
from millwright.session import cut_lineage, deal, deal_rows

# So many keys over the cap are too many to be sent to every task.
MANY_KEYS = 100_000


def _first_rows(rows: DataFrame, key: list[str], order: list[str], most: int | None) -> DataFrame:
    """The first rows of every key; all of them if ``most`` is None."""
    if most is None:
        return rows
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return numbered.where(F.col("_n") <= most).drop("_n")


class _Cap:
    """Cuts a walk to the first ``cap`` rows of every key, hop by hop.

    A key that cannot be past the cap yet is not sorted: as long as the most rows that any key can have, the product of the
    widest hops, stay within the cap, nothing is counted. Past that, rows are counted per key, and only keys over the cap are cut.
    """

    def __init__(self, key: str, cap: int | None):
        self.key, self.cap = key, cap
        self.levels: list[DataFrame] = []
        self.reach, self.total = 1, 0

    def hop(self, step: DataFrame, order: list[str], widest: int | None, last: bool) -> tuple[DataFrame, DataFrame]:
        """(the rows of a hop that stay, those of them to walk on from); ``widest`` is the most edges ahead of a node, if known."""
        if self.cap is None:
            step = step if last else cut_lineage(step)
            return step, step
        if widest is None:
            step = cut_lineage(step)
            widest = step.groupBy(self.key).count().agg(F.max("count")).first()[0] or 0
        self.reach *= widest
        self.total += self.reach
        if self.total <= self.cap:
            step = step if last or self._stored(step) else cut_lineage(step)
            self.levels.append(step)
            return step, step
        self.reach = self.total = self.cap
        step = step if self._stored(step) else cut_lineage(step)
        rows = [*[r.select(self.key, F.lit(0).alias("new")) for r in self.levels], step.select(self.key, F.lit(1).alias("new"))]
        held = reduce(DataFrame.unionByName, rows).groupBy(self.key).agg(F.sum("new").alias("new"), F.count("*").alias("held"))
        full = cut_lineage(held.where((F.col("held") >= self.cap) & (F.col("new") > 0)))
        over = full.where(F.col("held") > self.cap).select(self.key, (F.col("held") - F.col("new")).alias("used"))
        by_key = W.partitionBy(self.key).orderBy(*order)
        crossed = full.count()
        if not crossed:
            self.levels.append(step)
            return step, step
        if crossed > MANY_KEYS:
            step = deal_rows(step, step.count(), self.key)
        numbered = step.join(over, self.key).withColumn("_n", F.row_number().over(by_key)).where(F.col("_n") <= self.cap)
        cut = numbered.where(F.col("used") + F.col("_n") <= self.cap).select(*step.columns)
        kept = step.join(over, self.key, "left_anti").select(*step.columns).unionByName(cut)
        kept = kept if last else cut_lineage(kept)
        self.levels.append(kept)
        return kept, kept.join(full, self.key, "left_anti")

    @staticmethod
    def _stored(step: DataFrame) -> bool:
        return getattr(step, "written_to", None) is not None


def _edges_ahead(out: DataFrame, nodes: DataFrame, order: list[str], most: int | None, mixed: bool = False) -> tuple[DataFrame, int]:
    """(the first edges of ``nodes(node)``, stored, and the most of them that a node has).

    Stored, a short list is known as such and sent to the walks, which are then not shuffled for it. ``mixed`` deals the edges out evenly
    first, so that the edges of busy nodes do not end up in a few tasks.
    """
    found = _edges_of(out, nodes)
    found = deal(found, "src", "dst") if mixed else found
    ahead = cut_lineage(_first_rows(_named(found) if "turned" in out.columns else found, ["src"], order, most))
    return ahead, 0 if most is None else ahead.groupBy("src").count().agg(F.max("count")).first()[0] or 0


def _edges_of(out: DataFrame, nodes: DataFrame) -> DataFrame:
    return out.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def _few_nodes(walks: DataFrame) -> DataFrame:
    """The distinct nodes that ``walks`` stand on, stored, so that a short list is known as such and sent to the edges."""
    return cut_lineage(walks.select("node").distinct())


# ---- neighbours -------------------------------------------------------------
def neighbors_bfs(
    nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1, cap: int | None = 50, relationship: str | None = None
) -> DataFrame:
    """Out-edges met by a breadth-first walk from every ``starts(start)``.

    An edge is listed at one more than its source's distance; edges back to nodes
    seen before are listed too, but a node is expanded once.  The cap holds per
    start in the order (depth, src, dst); a relationship filter applies after it.
    """
    out = edges.select("src", "dst", "rel")
    order = ["dst", "rel"]
    begun = cut_lineage(starts.select("start").distinct().join(nodes.select(F.col("id").alias("start")), "start", "left_semi"))
    limit = _Cap("start", cap)
    # the first hop's edges are the starts' own
    out_by_start = deal_rows(out, edges.count(), "src")
    own = _first_rows(_edges_of(out_by_start, begun.select(F.col("start").alias("node"))), ["src"], order, cap)
    step = own.select(F.col("src").alias("start"), "src", "dst", "rel")
    visited = begun.select("start", F.col("start").alias("node"))
    levels, widest = [], None
    for hop in range(1, depth + 1):
        if hop > 1:
            reached = going.select("start", F.col("dst").alias("node"))  # noqa: F821
            met = _few_nodes(reached)
            # of the nodes seen before only those met again matter, mostly none
            again = cut_lineage(visited.join(met, "node", "left_semi").select("start", "node"))
            frontier = reached.distinct().join(again, ["start", "node"], "left_anti")
            visited = visited.unionByName(step.select("start", F.col("dst").alias("node")))
            ahead, widest = _edges_ahead(out, met, order, cap)
            step = frontier.join(ahead, frontier["node"] == ahead["src"]).select("start", "src", "dst", "rel")
        step, going = limit.hop(step, ["src", *order], widest, hop == depth)
        levels.append(step.select("start", "src", F.col("dst").alias("tag"), F.col("rel").alias("relationship"), F.lit(hop).alias("depth")))
    found = reduce(DataFrame.unionByName, levels)
    return found if relationship is None else found.where(F.col("relationship") == relationship)


def _paths(out: DataFrame, seeds: DataFrame, key: str, depth: int, cap: int | None, mixed: bool = False) -> DataFrame:
    """Walks of 1..depth edges from ``seeds(key, tag)`` that use no edge twice.

    ``out(src, dst, rel, turned)`` holds every direction that may be taken.
    Ordered by (length, steps), capped per key.
    """
    # up to depth - 1 of a node's first edges may be spent already
    most = None if cap is None else cap + depth
    order = ["dst", "rel", "edge_id"]
    begun = cut_lineage(seeds.select(key, F.col("tag").alias("node")).distinct())
    walks = begun.select(
        key, "node", F.array(F.struct(F.col("node").alias("id"), F.lit("").alias("rel"))).alias("steps"), F.array().cast("array<string>").alias("taken")
    )
    limit = _Cap(key, cap)
    levels = []
    for hop in range(1, depth + 1):
        if hop == 1:
            ahead, widest = _first_rows(_named(_edges_of(out, begun.select("node").distinct())), ["src"], order, most), None
        else:
            met = _few_nodes(walks)
            if met.isEmpty():
                break
            ahead, widest = _edges_ahead(out, met, order, most, mixed)
        step = (
            walks.join(ahead, walks["node"] == ahead["src"])
            .where(~F.array_contains("taken", F.col("edge_id")))
            .select(
                key, F.col("dst").alias("node"), F.array_append("steps", F.struct(F.col("dst").alias("id"), "rel")).alias("steps"),
                F.array_append("taken", F.col("edge_id")).alias("taken"),
            )
        )
        step, walks = limit.hop(step, ["steps", "taken"], widest, hop == depth)
        levels.append(step.select(key, "node", "steps", F.lit(hop).alias("depth")))
    return reduce(DataFrame.unionByName, levels)


def _named(out: DataFrame) -> DataFrame:
    """Directions with the id of their edge, which is the same both ways.

    It is put to them once they are cut to the nodes asked for: Spark does not take that cut below the joins that make up the edges if a
    text has to be put together in between.
    """
    ids = F.when(F.col("turned"), F.concat_ws("|", "dst", "rel", "src")).otherwise(F.concat_ws("|", "src", "rel", "dst"))
    return out.select("src", "dst", "rel", ids.alias("edge_id"))


def neighbors_paths(edges: DataFrame, starts: DataFrame, depth: int = 1, cap: int | None = 100) -> DataFrame:
    """One row per directed path of up to ``depth`` edges, with its last relationship."""
    out = edges.select("src", "dst", "rel", F.lit(False).alias("turned"))
    seeds = starts.select("start", F.col("start").alias("tag"))
    return _paths(out, seeds, "start", depth, cap).select(
        "start", F.col("node").alias("tag"), F.element_at("steps", -1)["rel"].alias("relationship"), "depth",
        F.array_join(F.transform("steps", lambda s: s["id"]), ">").alias("path"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    ahead = edges.select("src", "dst", "rel", F.lit(False).alias("turned"))
    return ahead.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", F.lit(True).alias("turned")))


def rag_paths(edges: DataFrame, seeds: DataFrame, depth: int = 2, cap: int | None = 30) -> DataFrame:
    """Undirected paths around the tags of each question, rendered as ``A -[:R]- B``.

    Worked out and rendered once per distinct tag and then handed to its questions. The first paths of a question are among
    the first of its tags, so only questions of several tags are cut once more.
    """
    asked, tags = _asked(seeds)
    walks = _paths(both_ways(edges), tags, "tag", depth, cap, mixed=cap is None)
    rendered = F.array_join(
        F.transform("steps", lambda s: F.when(s["rel"] == "", s["id"]).otherwise(F.concat(F.lit("-[:"), s["rel"], F.lit("]- "), s["id"]))), " "
    )
    paths = walks.select("tag", "depth", rendered.alias("path"), F.transform("steps", lambda s: s["id"]).alias("nodes"), "steps")
    columns = ["question_id", "depth", "path", "nodes"]
    if cap is None:
        # the paths stay where they are as long as the questions can be sent to them
        to_paths = F.broadcast(asked) if asked.count() <= MANY_KEYS else asked
        return paths.drop("steps").join(to_paths, "tag").select(*columns)
    paths = cut_lineage(paths)
    of_tags = asked.groupBy("question_id").agg(F.count("*").alias("n"), F.min("tag").alias("tag"))
    single = of_tags.where("n = 1").join(paths, "tag").select(*columns)
    several = asked.join(of_tags.where("n > 1").select("question_id"), "question_id", "left_semi")
    first = _first_rows(several.join(paths, "tag"), ["question_id"], ["depth", "steps"], cap).select(*columns)
    return single.unionByName(first)


# ---- context around assets --------------------------------------------------
def _asked(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (question, tag) rows and the distinct tags, stored: their sizes are known when edges are joined to them."""
    asked = cut_lineage(seeds.select("question_id", "tag").distinct())
    return asked, cut_lineage(asked.select("tag").distinct())


def _links_from(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Distinct (src, dst) links in either direction out of ``nodes``; the edges are cut to these before any shuffle."""
    links = both_ways(edges).select("src", "dst")
    return links.join(nodes.select(F.col(column).alias("src")), "src", "left_semi").distinct()


def rules_near_assets(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, cap: int | None = 15) -> DataFrame:
    """Rules within two undirected hops of a question's tags, the first by code (all: None).

    Worked out once per distinct tag and then handed to its questions. Only neighbours
    with rules of their own are walked over, and each hands on no more than the cap.
    """
    rules = cut_lineage(nodes.where("label = 'ComplianceRule'").select(F.col("id").alias("code")))
    adjacent = _links_from(edges, rules, "code").select(F.col("dst").alias("src"), F.col("src").alias("code"))
    first = cut_lineage(_first_rows(adjacent, ["src"], ["code"], cap))
    asked, tags = _asked(seeds)
    bridges = _links_from(edges, tags, "tag").join(first.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    around = tags.join(bridges, tags["tag"] == bridges["src"]).select("tag", F.col("dst").alias("via"))
    reached = tags.select("tag", F.col("tag").alias("via")).unionByName(around)
    of_tag = reached.join(first, reached["via"] == first["src"]).select("tag", "code").unionByName(
        tags.join(rules, tags["tag"] == rules["code"]).select("tag", "code")
    )
    of_tag = _first_rows(of_tag.distinct(), ["tag"], ["code"], cap)
    return _first_rows(asked.join(of_tag, "tag").select("question_id", "code").distinct(), ["question_id"], ["code"], cap)


EVENT_LINKS = ("HAD_EVENT", "HAS_COMPLIANCE_CHECK")


def events_of_assets(edges: DataFrame, seeds: DataFrame, cap: int | None = 20) -> DataFrame:
    """Events and checks tied to a question's tags, the first by tag and id (all: None).

    A busy asset is cut to its own first events before questions are joined to it.
    """
    asked, tags = _asked(seeds)
    links = _links_from(edges.where(F.col("rel").isin(*EVENT_LINKS)), tags, "tag").select("src", F.col("dst").alias("event_id"))
    links = _first_rows(links, ["src"], ["event_id"], cap)
    if cap is None and asked.count() <= MANY_KEYS:
        # questions are sent to the links, which are stored in order: rows of one event follow each other, and files of them are small
        links = cut_lineage(deal(links, "src", "event_id").sortWithinPartitions("src", "event_id"))
        return links.join(F.broadcast(asked), links["src"] == asked["tag"]).select("question_id", F.col("tag").alias("asset_id"), "event_id")
    # both sides are distinct, and so are the rows
    found = asked.join(links, asked["tag"] == links["src"]).select("question_id", F.col("tag").alias("asset_id"), "event_id")
    return _first_rows(found, ["question_id"], ["asset_id", "event_id"], cap)


# Fixed value: a search term of a question.
RULE_TERM = "[A-Za-z][A-Za-z0-9_-]{2,}"


def _grams(word: str) -> Column:
    """The distinct runs of three characters in a word of three or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, F.lit(3))))


def rule_text_match(rules: DataFrame, questions: DataFrame, cap: int | None = 15, runs_at_a_key: int = 4096) -> DataFrame:
    """Rules whose code, title, category, body or text contains a term of the question, the first by code.

    Containment is looked up word by word: a term can only lie inside an unbroken
    run of term characters, and both meet on that gram of three of the term's characters
    which fewest runs hold; a term with a gram that no run holds goes nowhere.  Runs of a gram
    are dealt into blocks of about ``runs_at_a_key``, which a term visits one by one.  Terms and
    runs are made distinct first, so the join is between vocabularies, and a run
    or term passes on no more rules than the cap can use.
    """
    words = F.regexp_extract_all("question", F.lit(RULE_TERM), F.lit(0))
    terms = unnest(questions, ["question_id"], F.array_distinct(F.transform(words, F.upper)), "term")
    fields = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("rule_code", "title", "category", "regulation_body", "full_text")])
    whole = F.array_distinct(F.regexp_extract_all(F.upper(fields), F.lit("[A-Z0-9_-]{3,}"), F.lit(0)))
    runs = unnest(rules, ["rule_code"], whole, "run")
    run_rules = _first_rows(runs, ["run"], ["rule_code"], cap)
    grams = run_rules.select("run").distinct().select("run", F.explode(_grams("run")).alias("gram"))
    known = grams.groupBy("gram").agg(F.ceil(F.count("*") / runs_at_a_key).alias("blocks"), F.count("*").alias("held_by"))
    wanted = terms.select("term").distinct().select("term", _grams("term").alias("grams"))
    wanted = wanted.select("term", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(known, "gram")
    rarest = wanted.groupBy("term", "n").agg(F.count("*").alias("met"), F.min(F.struct("held_by", "gram", "blocks")).alias("g")).where("met = n")
    asked = rarest.select("term", "g.gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g.blocks") - 1)).alias("block"))
    filed = grams.join(known, "gram").select("run", "gram", F.pmod(F.xxhash64("run"), "blocks").alias("block"))
    held = asked.join(filed, ["gram", "block"]).where(F.contains("run", F.col("term"))).select("term", "run")
    term_rules = _first_rows(held.join(run_rules, "run").select("term", "rule_code").distinct(), ["term"], ["rule_code"], cap)
    matched = terms.join(term_rules, "term").select("question_id", F.col("rule_code").alias("code")).distinct()
    return _first_rows(matched, ["question_id"], ["code"], cap)


def rule_context(near: DataFrame, matched: DataFrame, cap: int | None = 15) -> DataFrame:
    """Rules near a question's assets, then rules its words match, each code once."""
    both = near.select("question_id", "code", F.lit(0).alias("source")).unionByName(
        matched.select("question_id", "code", F.lit(1).alias("source"))
    )
    once = both.groupBy("question_id", "code").agg(F.min("source").alias("source"))
    return _first_rows(once, ["question_id"], ["source", "code"], cap)


def known_tags(texts: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Tags of each text that the graph knows, in the order they appear."""
    named = unnest(texts, [key], tx.wide_tags(F.col("text")), "tag", "position")
    kept = named.join(nodes.select(F.col("id").alias("tag")), "tag", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "tag"))), lambda x: x["tag"])
    return kept.groupBy(key).agg(ordered.alias("tags"))


def context_tags(context: DataFrame, questions: DataFrame) -> DataFrame:
    """Tags named by a question's context rows, and whether they add to the question's own.

    ``context(question_id, item, tag, source, target, path, attribute_text)``; a
    question's context is capped where it is fetched, so gathering it is safe.
    """
    pieces = F.flatten(F.transform(F.array("tag", "source", "target", "path", "attribute_text"), tx.wide_tags))
    gathered = context.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("item", pieces.alias("tags")))).alias("rows"))
    found = gathered.select("question_id", F.array_distinct(F.flatten(F.transform("rows", lambda r: r["tags"]))).alias("graph_tags"))
    own = questions.select("question_id", tx.wide_tags(F.col("question")).alias("asked"))
    graph = F.coalesce("graph_tags", F.array().cast("array<string>"))
    both = own.join(found, "question_id", "left").select("question_id", "asked", graph.alias("graph_tags"))
    return both.withColumn(
        "has_context", (F.size(F.array_intersect("asked", "graph_tags")) > 0) & (F.size("graph_tags") > F.size("asked"))
    )


# ---- shortest paths and statistics -----------------------------------------
def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Shortest directed path of every ``pairs(src, dst)`` that has one; the smallest by node ids among equals.

    One walk backwards from every distinct target finds, for each node that reaches it,
    the hops left and the smallest next node; it stops once all sources asked for are
    met.  A node that nothing leads to can only be a path's source, so it is not walked to but for the targets
    asked of it.  The paths are then read off forwards, each hop in the table of its distance, so no state is kept per source and
    none of the walks carries a path.
    """
    wanted = cut_lineage(pairs.select("src", "dst").distinct())
    apart = wanted.where("src <> dst")
    entered = edges.select(F.col("dst").alias("src")).distinct().withColumn("inner", F.lit(True))
    steps = edges.select("src", F.col("dst").alias("node")).join(apart, "src", "left").join(entered, "src", "left")
    steps = cut_lineage(steps.where("dst is not null or inner").select("src", "node", F.col("dst").alias("target"), "inner"))
    asked = steps.where("target is not null").select("target", "src", "node")
    inner = steps.where("inner").select("src", "node")
    ask = cut_lineage(apart.groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("asked")))
    frontier = visited = ask.select("target", F.col("target").alias("node"))
    ways: list[DataFrame] = []
    found: list[DataFrame] = []

    def fewest(moved: DataFrame) -> DataFrame:
        return moved.groupBy("target", F.col("src").alias("node")).agg(F.min("node").alias("next"))

    def without(rows: DataFrame, known: list[DataFrame]) -> DataFrame:
        return rows.join(reduce(DataFrame.unionByName, known), ["target", "node"], "left_anti") if known else rows

    while max_hops is None or len(found) < max_hops:
        if found:
            met = reduce(DataFrame.unionByName, found).groupBy("target").agg(F.count("*").alias("met"))
            still = ask.join(met, "target", "left").where("met is null or met < asked")
            frontier = frontier.join(still, "target", "left_semi")
        if frontier.isEmpty():
            break
        found.append(cut_lineage(without(fewest(asked.join(frontier, ["target", "node"])), [f.select("target", "node") for f in found])))
        way = cut_lineage(fewest(inner.join(frontier, "node")).join(visited, ["target", "node"], "left_anti"))
        ways.append(way)
        frontier = way.select("target", "node")
        visited = visited.unionByName(frontier)
    arrived = [wanted.where("src = dst").select("src", "dst", F.array("src").alias("path"))]
    walking = None
    for left in range(len(found) - 1, -1, -1):
        # sources this many hops and one away, after their first step
        begun = found[left].select(
            F.col("node").alias("src"), F.col("target").alias("dst"), F.col("next").alias("node"), F.array("node", "next").alias("path")
        )
        walking = begun if walking is None else walking.unionByName(begun)
        if left == 0:
            break
        if left == 1:
            walking = walking.select("src", "dst", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
            continue
        onward = ways[left - 1].withColumnRenamed("target", "dst")
        moved = walking.join(onward, ["dst", "node"])
        walking = cut_lineage(moved.select("src", "dst", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path")))
    if walking is not None:
        arrived.append(walking.select("src", "dst", "path"))
    return reduce(DataFrame.unionByName, arrived).select("src", "dst", "path", (F.size("path") - 1).alias("length"))


def graph_stats(nodes: DataFrame, edges: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts per label with totals, the nodes with most relationships)."""
    labels = nodes.groupBy("label").agg(F.count("*").alias("n"))
    totals = labels.unionByName(labels.agg(F.sum("n").alias("n")).select(F.lit("nodes").alias("label"), "n")).unionByName(
        edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("label"), "n")
    )
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("connections"))
    ranked = nodes.join(degrees, "id", "left").select(
        F.col("id").alias("tag"), "label", F.coalesce("connections", F.lit(0)).alias("connections")
    )
    return totals, ranked.orderBy(F.desc("connections"), "tag").limit(top)


def neighbor_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes next to each node, in either direction."""
    pairs = both_ways(edges).select(F.col("src").alias("id"), "dst").distinct()
    counts = pairs.groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("neighbor_count"))
