"""Mixing documents to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell's size is its tokens (white-space words).  Given the share of
all tokens that each source, language and topic shall have, raking scales the cells by one factor for each value of each
marginal, in turn, until every marginal is met.  Documents are then drawn independently: a document's probability is its
cell's weight (raked tokens / tokens) times a common scale, at most 1, with the scale set so that the expected tokens are
``budget`` of all.  The draw compares a hash of the id and text with the probability, so it is repeatable and needs no order.

Every step is a Spark aggregation over the cell table: texts are read once to be counted and once to be drawn, never
shuffled; a hot source is one row after partial aggregation.  Only convergence figures and the scale come to the driver.

Without given targets a marginal's shares are flattened: share ** ``flatten``, rescaled to 1.  Targets for values that do not
occur are dropped and the rest rescaled; values without a target get none, and their documents have probability 0.  A null
source, language or given topic is a value of its own, named "".  Null and wordless texts count one token, so that they can be drawn.
An empty table gives no rows.  Repeated rows share a hash and are drawn together.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from partmill.llm.tables import columns_of, free_name
from partmill.sources.storage import materialize

MARGINALS = ("source", "lang", "topic")
FLATTEN, BUDGET, ROUNDS, TOLERANCE = 0.7, 0.75, 60, 1e-5
#: How far a marginal that counts as met may be off, as a share.
MET = 1e-3
#: Cells of one task.
CELLS = 1 << 19
#: Candidate scales tried in one pass over the cells, and passes.
_SCALES, _PASSES = 64, 4


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text, first match wins."""
    return (
        F.when(text.isNull() | ~text.rlike(r"\S"), "none")
        .when(text.contains("icensed under") | text.contains("icense, ") | text.contains("opyright"), "legal")
        .when(text.rlike(r"[#*$%&|<>]{3}"), "code")
        .when(text.rlike("[0-9]{3}"), "numeric")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    words = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))
    return F.greatest(words, F.lit(1)).cast("long")


def cell_columns(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> dict[str, Column]:
    """The columns that place and draw a document; ``draw`` is uniform in [0, 1)."""
    return {
        "draw": F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("draw")), F.lit(1 << 48)) / float(1 << 48),
        "source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
        "topic": topic_of(F.col(text_col)) if topic is None else F.coalesce(topic.cast("string"), F.lit("")),
    }


def flattened_targets(cells: DataFrame, flatten: float = FLATTEN) -> dict[str, DataFrame]:
    """Marginal -> (value, share): today's shares to the power ``flatten``, rescaled."""
    raised = F.pow(F.sum("tokens").cast("double"), F.lit(flatten)).alias("share")
    return {m: cells.groupBy(F.col(m).alias("value")).agg(raised) for m in MARGINALS}


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` (source, lang, topic, tokens) with ``raked``: tokens after fitting, with the sum they had before; and how
    far, as a share of what it should be, a marginal was off in the last round.

    Rounds go on until one moves no cell by ``tolerance`` of itself.  Targets that contradict each other then still leave some
    marginal off: a warning says so, and the marginal fitted last is met.  A round is one job over the cells, written after it."""
    parts = max(1, -(-cells.count() // CELLS))
    cells = cells.coalesce(parts)  # a table that fits in one task needs no exchange to be summed and joined
    total = cells.agg(F.sum("tokens").cast("double")).first()[0]
    if not total:
        return cells.withColumn("raked", F.lit(0.0)), 0.0
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    for m in MARGINALS:
        there = targets[m].where("share > 0").join(cells.select(F.col(m).alias("value")).distinct().hint("merge"), "value", "left_semi")
        shares = there.agg(F.sum("share")).first()[0] or 1.0
        want = there.select(F.col("value").alias(m), (F.col("share") / shares * total).alias(f"want_{m}"))
        now = now.join(want.hint("merge"), m, "left").withColumn(f"want_{m}", F.coalesce(f"want_{m}", F.lit(0.0)))
    # Every cell carries what its marginals shall have, so a round joins it with sums only.
    now, off = materialize(now, "mix-cells").coalesce(parts), 0.0
    for _ in range(rounds):
        new = now.withColumns({"before": F.col("raked"), "off": F.lit(0.0)})
        for m in MARGINALS:
            new = new.join(new.groupBy(m).agg(F.sum("raked").alias("have")).hint("merge"), m, "left")
            new = new.withColumn("factor", F.when(F.col("have") > 0, F.col(f"want_{m}") / F.col("have")))
            new = new.withColumns({"raked": F.coalesce(F.col("raked") * F.col("factor"), F.lit(0.0)), "off": F.greatest("off", F.abs(F.col("factor") - 1))}).drop("have", "factor")
        seen = Observation()
        moved = F.max(F.when(F.col("before") > 0, F.abs(F.col("raked") / F.col("before") - 1)))
        now = materialize(new.observe(seen, F.max("off").alias("off"), moved.alias("moved")).select(now.columns), "mix-cells").coalesce(parts)
        off = seen.get["off"] or 0.0
        if (seen.get["moved"] or 0.0) < tolerance:
            break
    if off >= MET:
        warnings.warn(f"raking stopped with a marginal off by {off:.2g} of what it should be: the targets contradict each other, or {rounds} rounds are too few", stacklevel=2)
    return now.select(*cells.columns, "raked"), off


def common_scale(raked: DataFrame, budget: float = BUDGET) -> float:
    """The factor by which weights become probabilities whose expected tokens are ``budget`` of all (capped at 1 each); if
    the cells with a weight are fewer than that, the least that draws them all."""
    weight = F.col("raked") / F.col("tokens")
    ends = raked.agg(F.min(F.when(weight > 0, weight)), F.max(weight), F.sum("tokens").cast("double")).first()
    if not ends[0]:
        return 0.0
    low, high = 0.0, 1.0 / ends[0]
    for _ in range(_PASSES):
        tried = [low + (high - low) * k / _SCALES for k in range(1, _SCALES + 1)]
        each = raked.select("tokens", weight.alias("weight"), F.posexplode(F.array(*map(F.lit, tried))).alias("k", "scale"))
        drawn = each.groupBy("k").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.col("scale"))).alias("n"))
        k = drawn.where(F.col("n") >= budget * ends[2]).agg(F.min("k")).first()[0]
        if k is None:
            return high
        low, high = (tried[k - 1] if k else low), tried[k]
    return high


def fit_mix(cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, flatten: float = FLATTEN) -> DataFrame:
    """(source, lang, topic, weight, probability, converged) of every cell of ``cells`` (source, lang, topic, tokens)."""
    cells = cells.coalesce(max(1, -(-cells.count() // CELLS)))
    raked, off = rake(cells, targets or flattened_targets(cells, flatten))
    weight = F.col("raked") / F.col("tokens")
    converged = F.lit(off < MET).alias("converged")
    fitted = raked.select(*MARGINALS, weight.alias("weight"), F.least(F.lit(1.0), weight * common_scale(raked, budget)).alias("probability"), converged)
    return materialize(fitted, "mix-weights")


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic: Column | None = None, budget: float = BUDGET, flatten: float = FLATTEN,
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, draw, sampled, converged) of every row; ``converged``: whether
    raking met all marginals."""
    placed = cell_columns(id_col, text_col, source_col, lang_col, topic)
    labelled = materialize(docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("n_tokens"), *[c.alias(k) for k, c in placed.items()]), "mix-labels")
    cells = materialize(labelled.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")), "mix-sizes")
    drawn = labelled.join(fit_mix(cells, targets, budget, flatten), list(MARGINALS))
    return drawn.select(F.col("doc_id").alias(id_col), *MARGINALS, "n_tokens", "weight", "probability", "draw", (F.col("draw") < F.col("probability")).alias("sampled"), "converged")


def keep_sampled(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    budget: float = BUDGET, flatten: float = FLATTEN,
) -> DataFrame:
    """The rows of ``docs`` that the mix draws, with all their columns."""
    placed = cell_columns(id_col, text_col, source_col, lang_col)
    sizes = docs.select(token_count(F.col(text_col)).alias("n"), *[placed[m].alias(m) for m in MARGINALS]).groupBy(*MARGINALS).agg(F.sum("n").alias("tokens"))
    fitted = fit_mix(materialize(sizes, "mix-sizes"), targets, budget, flatten).where("probability > 0")
    name = {k: free_name(docs, f"_mix_{k}") for k in (*placed, "p")}
    chosen = fitted.select(*[F.col(m).alias(name[m]) for m in MARGINALS], F.col("probability").alias(name["p"]))
    own = docs.withColumns({name[k]: c for k, c in placed.items()})
    drawn = own.join(chosen, [name[m] for m in MARGINALS]).where(F.col(name["draw"]) < F.col(name["p"]))
    return drawn.select(columns_of(docs))
