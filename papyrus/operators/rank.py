"""PageRank family as DataFrame iterations.

Semantics (same as the graph library the reference calls):

* edges with an endpoint outside the vertex set are dropped; the weight of
  an edge is ``1 / outdeg(src)`` with parallel edges counted;
* fixed-iteration form: ``r'(v) = reset(v) + (1 - a) * sum r(u) w(u->v)``,
  ``reset = a`` everywhere (plain) or only on the source (personalised);
  start 1.0 on every vertex (plain) or on the source only;
* at the end ranks are rescaled to sum to ``|V|`` (plain) or to 1 per
  source (personalised), which repairs the mass lost at sinks;
* tolerance form: delta propagation until no vertex changes by more than
  ``tol`` (Pregel style), then the same rescaling.

Plan shape per iteration: the transition table ``(src, dst, w)`` is written
once, in buckets of ``(src, slice)``, with the out-edges of a hub cut into
slices (:class:`papyrus.operators.graph.SlicedEdges`).  A step shuffles the
state, one row per slice of its vertex, to the edges, which stay where they
lie, then sums by ``groupBy(source, dst)`` with partial aggregation.  No vertex
brings more than a slice of its edges to a task (out-degree skew), and a
hub's in-edges are summed before the shuffle (in-degree skew).  Personalised
state is sparse: only
vertices reached from a source carry a row, so one source costs its
reachable set, not ``|V|``.  Lineage is cut with written tables.

The operators run on numbered vertices (:class:`papyrus.operators.graph.Numbered`),
and names come back when the ranks are final.  A state with one row a vertex is
hashed in its tasks (rows / buckets each), so that the edges need no sort; the
states of many sources are sorted, which can spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrus.functions.ranking import top_k_per_group
from papyrus.operators.graph import (Graph, Numbered, SlicedEdges, author_id_of_vertex, author_vertex_id,
                                     drop_isolated, undirected)
from papyrus.operators.graph import undirected as both_ways
from papyrus.operators.lookup import AUTHOR_ID, resolve_author
from papyrus.operators.reach import reach
from papyrus.operators.reach import source_blocks as blocks_by_reach
from papyrus.session import cut_lineage, own_shuffles, release, scratch_path, setting

DEFAULT_RESET = 0.15
RANK_THRESHOLD = 1e-5
# ranks equal to this many places are ties (broken by id), so float noise
# from summation order cannot reorder papers of one rank
RANK_TIE_DIGITS = 12
# Iterations between reliable checkpoints: bounds lineage (recovery cost)
# and the plan the adaptive optimizer re-plans after every stage.
CHECKPOINT_EVERY = 3
# The same for a state of one row a vertex, whose steps are short.
PLAIN_EVERY = 6


def prepared_weights(graph: Graph, make_undirected: bool = False, with_degree: bool = False,
                     internal: bool = False, spread: bool = True) -> SlicedEdges:
    """Transition table in slices, written to the scratch folder."""
    g = Graph(graph.vertices, undirected(graph.edges)) if make_undirected else graph
    return SlicedEdges.transitions(g, with_degree, internal, spread)


# ---------------------------------------------------------------- cores

#: Messages of a step that a block of sources sends, at most: so many, or so many an edge of the graph.
BLOCK_MESSAGES, MESSAGES_PER_EDGE = 16_000_000, 4


def _walk(weights: SlicedEdges, state: DataFrame, step, messages, result, max_iter: int) -> DataFrame:
    """``result(state)`` after ``max_iter`` steps, for states too large to lie
    on disk at once: before a step that would send more messages than a block
    may, the sources are dealt by hash, and their states go on one after
    another.  Each source takes all its steps, in one block.

    ``state`` and what a step makes are written; ``step(state, part)`` takes
    the sources with ``part``, ``messages(state)`` is a number."""
    allowed = max(BLOCK_MESSAGES, MESSAGES_PER_EDGE * weights.total)
    spark = state.sparkSession
    found: list[DataFrame] = []
    path = scratch_path(spark)

    def go_on(state: DataFrame, part: F.Column, i: int, depth: int) -> None:
        while i < max_iter:
            blocks = -(-messages(state) // allowed)
            if blocks > 1 and state.select("source").distinct().limit(2).count() > 1:
                for k in range(blocks):
                    # another hash at each depth, or one part of a block would be all of it
                    own = F.pmod(F.xxhash64("source", F.lit(depth)), F.lit(blocks)) == k
                    block = cut_lineage(state.where(own))
                    if not block.isEmpty():
                        go_on(block, part & own, i, depth + 1)
                release(state)
                return
            moved = cut_lineage(step(state, part))
            release(state)
            state, i = moved, i + 1
        made = result(state)
        with own_shuffles(spark):
            made.write.mode("append").parquet(path)
        found.append(made)
        release(state)

    go_on(state, F.lit(True), 0, 0)
    return spark.read.schema(found[0].schema).parquet(path)


def _all(ranks: DataFrame) -> DataFrame:
    return ranks


def personalized_ranks(weights: SlicedEdges, sources: DataFrame, reset: float = DEFAULT_RESET,
                       max_iter: int = 10, checkpoint_every: int = CHECKPOINT_EVERY, keep=_all) -> DataFrame:
    """``(source, id, r)``: personalised PageRank of every source at once,
    each source normalised to sum 1.  Equal to running the sources one by
    one (the state is keyed by source; sources never mix).

    ``keep`` is applied to the ranks of whole sources, before those of many
    blocks of sources (:func:`_walk`) are put together."""
    stays = 1.0 - reset
    # materialised once: every step unions the anchor rows, and a lazy
    # distinct would be re-shuffled by every job
    src = cut_lineage(sources.select("source").distinct())
    state = src.select("source", F.col("source").alias("id"), F.lit(1.0).alias("r"))

    def step(state: DataFrame, part: F.Column) -> DataFrame:
        # one zero-message row per source keeps the source in the state even
        # when nothing flows back to it
        anchor = src.where(part).select("source", F.col("source").alias("id"), F.lit(0.0).alias("m"))
        msgs = (weights.meet(state, "id", hashed=True)
                .select("source", F.col("dst").alias("id"), (F.col("r") * F.col("w")).alias("m")))
        return (msgs.unionByName(anchor)
                .groupBy("source", "id").agg(F.sum("m").alias("m"))
                .select("source", "id",
                        (F.when(F.col("id") == F.col("source"), F.lit(reset)).otherwise(F.lit(0.0))
                         + F.lit(stays) * F.col("m")).alias("r")))

    def result(state: DataFrame) -> DataFrame:
        totals = state.groupBy("source").agg(F.sum("r").alias("t")).hint("shuffle_hash")
        return keep(state.join(totals, "source").select("source", "id", (F.col("r") / F.col("t")).alias("r")))

    if src.count() * weights.total > BLOCK_MESSAGES:
        return _walk(weights, cut_lineage(state), step, lambda s: int(s.count() * (1 + weights.mean)), result, max_iter)
    written = None
    for i in range(1, max_iter + 1):
        state = step(state, F.lit(True))
        if i % checkpoint_every == 0 or i == max_iter:
            state = cut_lineage(state)
            if written is not None:
                release(written)
            written = state
    if max_iter == 0:
        state = cut_lineage(state)
    release(src)
    return result(state)


def push_ranks(weights: SlicedEdges, sources: DataFrame, push: float, reset: float = DEFAULT_RESET,
               max_iter: int = 10, keep=_all) -> DataFrame:
    """``(source, id, r)``: :func:`personalized_ranks` by forward push.

    A row of the state holds the estimate ``p`` of a vertex and the residual
    ``r`` that it has not passed on.  A step passes on the residuals of at
    least ``push`` per out-edge: ``reset`` of them stays as estimate, the rest
    moves along the edges; smaller ones wait, and join later arrivals.  At the
    end all residuals count for the vertex they have come to.  Each out-edge
    used adds ``reset * push`` to estimates that sum up to 1, so a source
    uses at most ``1 / (reset * push)`` edges in all and its state is bounded
    by that, whatever the graph's size.  With ``push`` 0 it is the exact run.

    ``weights`` must carry ``dst_deg`` (:meth:`SlicedEdges.transitions`);
    ``keep`` as in :func:`personalized_ranks`.
    """
    passes = 1.0 - reset
    src = sources.select("source").distinct()
    degree = weights.table.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).withColumnRenamed("src", "source")
    state = cut_lineage(src.join(degree, "source", "left").select(
        "source", F.col("source").alias("id"), F.coalesce("deg", F.lit(0)).cast("long").alias("deg"),
        F.lit(0.0).alias("p"), F.lit(1.0).alias("r")))
    moves = (F.col("r") > 0) & (F.col("r") >= F.lit(push) * F.col("deg"))

    def step(state: DataFrame, part: F.Column) -> DataFrame:
        passed = (weights.meet(state.where(moves & (F.col("deg") > 0)).select("source", "id", "r"), "id", hashed=True)
                  .select("source", F.col("dst").alias("id"), F.col("dst_deg").cast("long").alias("deg"),
                          F.lit(0.0).alias("p"), (F.lit(passes) * F.col("r") * F.col("w")).alias("r")))
        stays = state.select("source", "id", "deg",
                             (F.col("p") + F.when(moves, F.lit(reset) * F.col("r")).otherwise(F.lit(0.0))).alias("p"),
                             F.when(moves, F.lit(0.0)).otherwise(F.col("r")).alias("r"))
        return (stays.unionByName(passed).groupBy("source", "id")
                .agg(F.max("deg").alias("deg"), F.sum("p").alias("p"), F.sum("r").alias("r")))

    def messages(state: DataFrame) -> int:
        rows, sent = state.agg(F.count(F.lit(1)), F.sum(F.when(moves, F.col("deg")))).first()
        return rows + (sent or 0)

    def result(state: DataFrame) -> DataFrame:
        totals = state.groupBy("source").agg(F.sum(F.col("p") + F.col("r")).alias("t")).hint("shuffle_hash")
        return keep(state.join(totals, "source")
                    .select("source", "id", ((F.col("p") + F.col("r")) / F.col("t")).alias("r")))

    return _walk(weights, state, step, messages, result, max_iter)


def plain_ranks(weights: SlicedEdges, vertex_ids: DataFrame, reset: float = DEFAULT_RESET,
                max_iter: int = 30, checkpoint_every: int = PLAIN_EVERY) -> DataFrame:
    """``(id, r)``: PageRank on every vertex, rescaled to sum ``|V|``."""
    keep = 1.0 - reset
    spark = vertex_ids.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    ids = cut_lineage(vertex_ids.select("id").distinct())
    zeros = ids.select("id", F.lit(0.0).alias("m"))
    state = ids.select("id", F.lit(1.0).alias("r"))
    written = None
    for i in range(1, max_iter + 1):
        msgs = (weights.meet(state.hint("shuffle_hash"), "id")
                .select(F.col("dst").alias("id"), (F.col("r") * F.col("w")).alias("m")))
        state = (msgs.unionByName(zeros).groupBy("id").agg(F.sum("m").alias("m"))
                 .select("id", (F.lit(reset) + F.lit(keep) * F.col("m")).alias("r")))
        if i % checkpoint_every == 0 or i == max_iter:
            # as many partitions as buckets: a step finds its state where the edges are
            with setting(spark, "spark.sql.shuffle.partitions", str(weights.buckets or parts)):
                state = cut_lineage(state)
            if written is not None:
                release(written)
            written = state
    if max_iter == 0:
        state = cut_lineage(state)
    n, total = state.agg(F.count(F.lit(1)), F.sum("r")).first()
    factor = (n / total) if total else 0.0
    return state.select("id", (F.col("r") * F.lit(factor)).alias("r"))


def delta_ranks(weights: SlicedEdges, vertex_ids: DataFrame, reset: float, tol: float,
                source: str | None = None, checkpoint_every: int = CHECKPOINT_EVERY) -> DataFrame:
    """``(id, r)`` by delta propagation until every change is <= ``tol``.

    With ``tol > 0`` and ``0 < reset <= 1`` the sum of all changes shrinks by
    ``1 - reset`` a step, so the run ends.

    Vertices send ``delta * w`` along their out-edges while they were
    updated in the previous step and their last change exceeds ``tol``.
    One small action per step decides whether any message is left.
    """
    if not tol > 0 or not 0 < reset <= 1:
        raise ValueError("tol must be above 0 and reset in (0, 1]")
    keep = 1.0 - reset
    if source is None:
        first = reset
        state = vertex_ids.select("id").distinct().select(
            "id", F.lit(first).alias("pr"), F.lit(first).alias("delta"), F.lit(True).alias("active"))
    else:
        spark = vertex_ids.sparkSession
        state = spark.createDataFrame([(source, 1.0, 1.0, True)],
                                      "id string, pr double, delta double, active boolean")
    state = cut_lineage(state)
    superseded = [state]
    step = 0
    while True:
        sending = state.filter(F.col("active") & (F.col("delta") > F.lit(tol)))
        msgs = (weights.meet(sending.hint("shuffle_hash"), "id")
                .groupBy(F.col("dst").alias("id"))
                .agg(F.sum(F.col("delta") * F.col("w")).alias("m")))
        msgs = cut_lineage(msgs)
        superseded.append(msgs)
        if msgs.isEmpty():
            break
        step += 1
        old = F.coalesce(F.col("pr"), F.lit(0.0))
        new = old + F.lit(keep) * F.col("m")
        state = (state.join(msgs, "id", "full_outer")
                 .select("id",
                         F.when(F.col("m").isNull(), F.col("pr")).otherwise(new).alias("pr"),
                         F.when(F.col("m").isNull(), F.col("delta")).otherwise(new - old).alias("delta"),
                         F.col("m").isNotNull().alias("active")))
        if step % checkpoint_every == 0:
            state = cut_lineage(state)
            for old_cut in superseded:
                release(old_cut)
            superseded = [state]
    state = cut_lineage(state.select("id", F.col("pr").alias("r")))
    for old_cut in superseded:
        release(old_cut)
    n, total = state.agg(F.count(F.lit(1)), F.sum("r")).first()
    if source is None:
        factor = (n / total) if total else 0.0
    else:
        factor = (1.0 / total) if total else 0.0
    return state.select("id", (F.col("r") * F.lit(factor)).alias("r"))


# ---------------------------------------------------------------- sources

def _sources_frame(graph: Graph, start) -> tuple[DataFrame, bool]:
    spark = graph.vertices.sparkSession
    if isinstance(start, str):
        return spark.createDataFrame([(start,)], "source string"), True
    if isinstance(start, (list, tuple)):
        if not all(isinstance(s, str) for s in start):
            raise TypeError("source ids must be strings")
        return spark.createDataFrame([(s,) for s in start], "source string"), False
    if isinstance(start, DataFrame):
        first = start.columns[0]
        return start.select(F.col(first).cast("string").alias("source")), False
    raise TypeError(f"start must be a str, a list/tuple of str or a DataFrame, not {type(start).__name__}")


def _require_known(graph: Graph, sources: DataFrame) -> None:
    unknown = sources.join(graph.vertices.select(F.col("id").alias("source")), "source", "left_anti")
    if not unknown.isEmpty():
        bad = [r[0] for r in unknown.limit(5).collect()]
        raise ValueError(f"unknown source vertex: {bad}")


def _first_by_rank(ranks: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of each source, ties to the smaller id, with ``rank``.

    Rounding goes through decimals and is dear, so it is left to the ranks that
    are not below the ``n``-th by more than rounding can move them."""
    falling = Window.partitionBy("source").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = (ranks.withColumn("last", F.nth_value("r", n).over(falling))
            .where(F.col("last").isNull() | (F.col("r") >= F.col("last") - F.lit(2 * 10.0 ** -RANK_TIE_DIGITS))).drop("last"))
    return top_k_per_group(near, ["source"], [F.round("r", RANK_TIE_DIGITS).desc(), F.asc("id")], n, "rank")


def _others_above(threshold: float):
    """Ranks above ``threshold`` without those of the sources themselves."""
    return lambda ranks: ranks.filter((F.col("id") != F.col("source")) & (F.col("r") > F.lit(threshold)))


# ---------------------------------------------------------------- operators

def pagerank(graph: Graph, reset_probability: float = DEFAULT_RESET, max_iter: int | None = 30,
             tol: float | None = None, checkpoint_every: int | None = None) -> DataFrame:
    """``(paper_doi, pagerank)`` sorted by rank descending.

    Exactly one of ``max_iter`` and ``tol`` must be given.
    """
    if (max_iter is None) == (tol is None):
        raise ValueError("exactly one of max_iter and tol must be set")
    numbered = Numbered.of(graph)
    weights = prepared_weights(numbered.graph, internal=True, spread=tol is not None)
    if tol is None:
        ranks = plain_ranks(weights, numbered.graph.vertices, reset_probability, max_iter, checkpoint_every or PLAIN_EVERY)
    else:
        ranks = delta_ranks(weights, numbered.graph.vertices, reset_probability, tol, None, checkpoint_every or CHECKPOINT_EVERY)
    return (numbered.name(ranks, "id").select(F.col("id").alias("paper_doi"), F.col("r").alias("pagerank"))
            .orderBy(F.desc("pagerank"), "paper_doi"))


def topic_pagerank(graph: Graph, start, reset_probability: float = DEFAULT_RESET,
                   max_iter: int = 10, undirected: bool = False,
                   threshold: float = RANK_THRESHOLD, checkpoint_every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Papers related to one or many start papers.

    * ``start`` a string: ``(related_paper, pagerank)`` sorted descending;
    * ``start`` a list/tuple of strings or a one-column DataFrame of ids:
      ``(start_paper, related_paper, pagerank)``, unsorted.

    The start papers themselves and ranks <= ``threshold`` are left out.
    """
    sources, single = _sources_frame(graph, start)
    _require_known(graph, sources)
    numbered = Numbered.of(graph)
    weights = prepared_weights(numbered.graph, undirected, internal=True)
    kept = personalized_ranks(weights, numbered.number(sources, "source"), reset_probability, max_iter, checkpoint_every,
                              _others_above(threshold))
    kept = numbered.name(numbered.name(kept, "id"), "source")
    if single:
        return (kept.select(F.col("id").alias("related_paper"), F.col("r").alias("pagerank"))
                .orderBy(F.desc("pagerank"), "related_paper"))
    return kept.select(F.col("source").alias("start_paper"), F.col("id").alias("related_paper"),
                       F.col("r").alias("pagerank"))


def topic_pagerank_tol(graph: Graph, start: str, tol: float,
                       reset_probability: float = DEFAULT_RESET, undirected: bool = False,
                       threshold: float = RANK_THRESHOLD) -> DataFrame:
    """Single-source personalised PageRank run to a tolerance."""
    sources, _ = _sources_frame(graph, start)
    _require_known(graph, sources)
    weights = prepared_weights(graph, undirected)
    ranks = delta_ranks(weights, graph.vertices, reset_probability, tol, source=start)
    return (ranks.filter((F.col("id") != F.lit(start)) & (F.col("r") > F.lit(threshold)))
            .select(F.col("id").alias("related_paper"), F.col("r").alias("pagerank"))
            .orderBy(F.desc("pagerank"), "related_paper"))


#: Residual per out-edge from which on :func:`top_related` passes it on.
PUSH = 1e-4


def top_related(graph: Graph, n: int = 10, sources: DataFrame | None = None, push: float = PUSH,
                reset_probability: float = DEFAULT_RESET, max_iter: int = 10, undirected: bool = False,
                threshold: float = RANK_THRESHOLD) -> DataFrame:
    """K8: ``(start_paper, related_paper, pagerank, rank)``: the ``n`` papers
    most related to each paper that has an edge (or to each of ``sources``),
    ties to the smaller id.

    Linear in the number of sources: forward push bounds the state of each
    (:func:`push_ranks`), and the output is ``n`` rows a source.  The exact
    form is :func:`topic_pagerank` with a top-n, or
    :func:`all_topic_pagerank` with ``keep_top``.
    """
    starts = drop_isolated(graph).vertices.select(F.col("id").alias("source")) if sources is None else sources
    numbered = Numbered.of(graph)
    weights = prepared_weights(numbered.graph, undirected, with_degree=True, internal=True)
    others = _others_above(threshold)
    top = push_ranks(weights, numbered.number(starts, "source"), push, reset_probability, max_iter,
                     lambda ranks: _first_by_rank(others(ranks), n))
    return numbered.name(numbered.name(top, "id"), "source").select(
        F.col("source").alias("start_paper"), F.col("id").alias("related_paper"), F.col("r").alias("pagerank"), "rank")


def all_topic_pagerank(graph: Graph, reset_probability: float = DEFAULT_RESET, max_iter: int = 10,
                       undirected: bool = False, threshold: float = RANK_THRESHOLD,
                       keep_top: int | None = None, source_blocks: int = 1,
                       output_path: str | None = None, checkpoint_every: int = CHECKPOINT_EVERY,
                       max_state: int | None = None) -> DataFrame:
    """Personalised PageRank from every non-isolated paper.

    The output is quadratic in the worst case, so the sources can be split
    into ``source_blocks`` hash blocks; each block is computed against the
    shared transition table and appended to ``output_path`` (a shared
    folder), and the written table is returned.  With ``max_state`` the
    blocks follow from the data instead: the state of each is about that
    many rows (:func:`papyrus.operators.reach.source_blocks`).  ``keep_top``
    keeps the N best related papers per start paper (ties to the smaller id).
    """
    if max_state is not None and source_blocks != 1:
        raise ValueError("give at most one of source_blocks and max_state")
    g = drop_isolated(graph)
    weights = prepared_weights(g, undirected)
    all_sources = g.vertices.select(F.col("id").alias("source"))

    def block_result(sources: DataFrame) -> DataFrame:
        ranks = personalized_ranks(weights, sources, reset_probability, max_iter, checkpoint_every)
        out = (ranks.filter((F.col("id") != F.col("source")) & (F.col("r") > F.lit(threshold)))
               .select(F.col("source").alias("start_paper"), F.col("id").alias("related_paper"),
                       F.col("r").alias("pagerank")))
        if keep_top is not None:
            out = top_k_per_group(out, ["start_paper"], [F.desc("pagerank"), F.asc("related_paper")],
                                  keep_top)
        return out

    if max_state is None and source_blocks <= 1 and output_path is None:
        return block_result(all_sources)
    if output_path is None:
        raise ValueError("output_path (a shared folder) is needed when sources are blocked")
    spark = graph.vertices.sparkSession
    if max_state is None:
        dealt = all_sources.select("source", F.pmod(F.xxhash64("source"), F.lit(max(1, source_blocks))).alias("block"))
        blocks = range(max(1, source_blocks))
    else:
        walked = Graph(g.vertices, both_ways(g.edges)) if undirected else g
        dealt = cut_lineage(blocks_by_reach(reach(walked, max_iter), max_state).select("source", "block"))
        # numbers are left out beside a source that fills more than a block
        blocks = sorted(r[0] for r in dealt.select("block").distinct().collect()) or [0]
    for b in blocks:
        block = dealt.filter(F.col("block") == b).select("source")
        block_result(block).write.mode("overwrite" if b == blocks[0] else "append").parquet(output_path)
    return spark.read.parquet(output_path)


def author_similarity(graph_author: Graph, start_author, reset_probability: float = DEFAULT_RESET,
                      max_iter: int = 10, threshold: float = RANK_THRESHOLD,
                      checkpoint_every: int = CHECKPOINT_EVERY, authors: DataFrame | None = None) -> DataFrame:
    """Personalised PageRank from an author over the authorship (or
    combined) graph, authors only.

    * ``start_author`` an author id (int or digit string), an ``A:`` vertex
      id, or, with the ``authors`` table, a name that exactly one author has:
      ``(related_author INT, simrank)`` sorted descending;
    * a one-column DataFrame of author ids:
      ``(start_author INT, related_author INT, simrank)``, unsorted.
    """
    spark = graph_author.vertices.sparkSession
    single = not isinstance(start_author, DataFrame)
    if not single:
        sources = start_author.select(author_vertex_id(F.col(start_author.columns[0])).alias("source"))
    else:
        vid = str(start_author)
        if not vid.startswith("A:"):
            if authors is None and not AUTHOR_ID.fullmatch(vid):
                raise ValueError(f"{vid!r} is no author id; pass the authors table to look up a name")
            vid = f"A:{int(vid) if authors is None else resolve_author(authors, vid)}"
        sources = spark.createDataFrame([(vid,)], "source string")
    _require_known(graph_author, sources)
    numbered = Numbered.of(graph_author)
    weights = prepared_weights(numbered.graph, internal=True)
    kept = personalized_ranks(weights, numbered.number(sources, "source"), reset_probability, max_iter, checkpoint_every,
                              _others_above(threshold))
    writers = numbered.names.join(graph_author.vertices.filter(F.col("node_type") == "author"), "id", "left_semi")
    kept = numbered.name(numbered.name(kept, "id", writers), "source")
    found = [author_id_of_vertex(F.col("id")).alias("related_author"), F.col("r").alias("simrank")]
    if single:
        return kept.select(*found).orderBy(F.desc("simrank"), "related_author")
    return kept.select(author_id_of_vertex(F.col("source")).alias("start_author"), *found)
