"""Mixing sources to target weights by iterative proportional fitting (operator 9).

Documents fall into cells (source, language, topic).  Raking scales the
cells' token weights until each margin has its target share; a document is
then drawn with its cell's calibrated probability.  No cell can give more
than it holds: such a cell is drawn whole, and the raking hands what it lacks
to the other cells of its margins.  Only cell totals are iterated, never
documents.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import materialise, nested, unnested

MARGINS = ("source", "lang", "topic")
#: Target share of a margin's value: its token share to this power, normalised.  1 keeps the corpus, 0 is uniform.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SWEEPS = 25
TOLERANCE = 1e-6
#: The mix aims at this share of the corpus' tokens.
BUDGET = 0.5
NONE = "(none)"
#: Missed targets that are logged, the farthest first; ``margins`` has all.
SHOWN = 50
LOG = logging.getLogger(__name__)


def tokens(text: Column) -> Column:
    """White-space words: runs of other characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse content class from the text's length and its share of bars and marks (a rule, not a model)."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    held = lambda marks: sum((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in marks), F.lit(0)) / n
    return F.when(held("|") > 0.02, "list").when(held("#%&$") > 0.05, "marked") \
        .when(F.length(t) < 400, "short").otherwise("prose")


def with_cell(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row``, with ``cell`` (source, lang, topic; NULL is a value of its own) and ``tokens`` next to it."""
    return nested(docs, doc_id=F.col("doc_id"), tokens=tokens(F.col("text")), cell=F.struct(
        F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), topic(F.col("text")).alias("topic")))


def tempered_targets(cells: DataFrame, temper: dict[str, float]) -> dict[str, DataFrame]:
    """Per margin ``(value, target)``: shares that sum to 1 over the values that hold tokens."""
    out = {}
    for m in MARGINS:
        held = materialise(cells.groupBy(m).agg(F.pow(F.sum("base"), F.lit(temper[m])).alias("p")), f"mix-target-{m}")
        whole = held.agg(F.sum("p")).first()[0] or 1.0
        out[m] = held.select(m, (F.col("p") / F.lit(whole)).alias("target"))
    return out


def attainable(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``targets`` that cells with ``most`` can meet margin by margin: ``(value, target, wanted)``.

    A value whose cells hold less than its target gets what they hold; the
    others share the rest in proportion to their targets.
    """
    out = {}
    for m in MARGINS:
        held = materialise(cells.groupBy(m).agg(F.sum("most").alias("most")).join(targets[m], m), f"mix-held-{m}")
        scale = 1.0
        while True:
            whole = F.col("target") * F.lit(scale) >= F.col("most")
            full, rest = held.agg(F.sum(F.when(whole, F.col("most"))), F.sum(F.when(~whole, F.col("target")))).first()
            if not full or not rest or (1.0 - full) / rest <= scale * (1 + 1e-12):
                break
            scale = (1.0 - full) / rest
        out[m] = held.select(m, F.least(F.col("target") * F.lit(scale), F.col("most")).alias("target"),
                             F.col("target").alias("wanted"))
    return out


#: Where a sum of weights comes within this of its bound it counts as there.
NEAR = 1 - 1e-12


def _full(cell: Column) -> Column:
    return cell["weight"] >= cell["most"] * F.lit(NEAR)


def _clipped(cell: Column) -> Column:
    """A cell above its bound counts at it."""
    return F.when(_full(cell), cell["most"]).otherwise(cell["weight"])


def _factor_sql(target: Column, full: Column, room: Column, held: Column, fill: Column) -> Column:
    """What to scale a margin's value by: see ``_factor``."""
    return F.coalesce(F.when(target >= held * F.lit(NEAR), fill).when((room > 0) & (full < target), F.try_divide(target - full, room))
                      .otherwise(F.try_divide(target, full + room)), F.lit(0.0))


def _factor(target: float, full: float, room: float, held: float, fill: float | None) -> float:
    """A value that needs all it has fills its last cell; else the cells with room take what the full ones leave."""
    if target >= held * NEAR:
        return fill or 0.0
    if room > 0 and full < target:
        return (target - full) / room
    return target / (full + room) if full + room else 0.0


def _sums(cell: Column) -> list[Column]:
    return [F.sum(F.when(_full(cell), cell["most"]).otherwise(0.0)).alias("full"),
            F.sum(F.when(_full(cell), 0.0).otherwise(cell["weight"])).alias("room"), F.sum(cell["most"]).alias("held"),
            F.max(F.try_divide(cell["most"], cell["weight"])).alias("fill")]


def _scaled(cells: Column, factor: Callable[[Column], Column]) -> Column:
    return F.transform(cells, lambda c: c.withField("weight", c["weight"] * factor(c)))


def _of(factors: dict[str, float], value: Column) -> Column:
    """Factor of a margin's value, 0 where it has none."""
    if not factors:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair]), value), F.lit(0.0))


def _source_step(state: DataFrame) -> DataFrame:
    """Every source scaled to its target, within its row; ``off`` is how far it was from it, ``before`` the cells until then."""
    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda a, c: a + of(c))
    full, room, held = (total(f) for f in (
        lambda c: F.when(_full(c), c["most"]).otherwise(0.0), lambda c: F.when(_full(c), 0.0).otherwise(c["weight"]), lambda c: c["most"]))
    fill = F.array_max(F.transform("cells", lambda c: F.try_divide(c["most"], c["weight"])))
    state = state.withColumn("s", F.struct(full.alias("full"), room.alias("room"), held.alias("held"), fill.alias("fill"),
                                           total(_clipped).alias("now")))
    target = F.coalesce("target", F.lit(0.0))
    factor = _factor_sql(target, F.col("s.full"), F.col("s.room"), F.col("s.held"), F.col("s.fill"))
    return state.withColumn("f", factor).select(
        "source", "target", F.col("cells").alias("before"), F.abs(F.col("s.now") - F.col("target")).alias("off"),
        _scaled(F.col("cells"), lambda _: F.col("f")).alias("cells"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """Cells ``(source, lang, topic, base)`` with a ``weight`` whose margins meet ``targets``.

    Cells may have a column ``most``, the largest weight they can take.  Each
    sweep scales every margin in turn, with cells above ``most`` counted at
    ``most``.  A row holds one source with its cells, so the source margin
    needs no exchange; the languages' and topics' sums are two-phase
    aggregates, as many rows as there are languages and topics, whose factors
    go back as literals.  So a sweep is two small aggregates and one table in
    the shared folder, with the same plan every time.  Sweeps end when no
    margin is off by more than ``tolerance`` (of 1), or after ``sweeps``;
    where the targets contradict empty or full cells the last sweep stands.
    A value without a target gets none of the weight.
    """
    bounded = "most" in cells.columns
    total = float(cells.agg(F.sum("base").alias("t")).first()["t"] or 1)
    aims = {m: {r[m]: r["target"] for r in targets[m].collect()} for m in ("lang", "topic")}
    cell = F.struct("lang", "topic", "base", (F.col("base") / F.lit(total)).alias("weight"),
                    (F.col("most") if bounded else F.lit(float("inf"))).alias("most"))
    state = cells.groupBy("source").agg(F.collect_list(cell).alias("cells")).join(targets["source"].select("source", "target"), "source", "left")
    factors: dict[str, dict[str, float]] = {}
    for k in range(sweeps + 1):
        if factors:
            state = state.select("source", "target", _scaled(
                F.col("cells"), lambda c: _of(factors["lang"], c["lang"]) * _of(factors["topic"], c["topic"])).alias("cells"))
        state = materialise(_source_step(state), f"mix-{k}")
        # How far the sweep before left each margin, and the languages' sums after this one's source step.
        both = F.explode(F.arrays_zip("before", "cells")).alias("c")
        parts = state.select("off", both).groupBy(F.col("c.cells.lang").alias("lang"), F.col("c.cells.topic").alias("topic")).agg(
            F.max("off").alias("off"), F.sum(_clipped(F.col("c.before"))).alias("now"), *_sums(F.col("c.cells"))).collect()
        off = max((r["off"] or 0.0 for r in parts), default=0.0)
        for m in ("lang", "topic"):
            for value, aim in aims[m].items():
                off = max(off, abs(sum(r["now"] for r in parts if r[m] == value) - aim))
        if (k and off <= tolerance) or k == sweeps or not parts:
            break
        factors = {"lang": {}}
        for value, aim in aims["lang"].items():
            own = [r for r in parts if r["lang"] == value]
            factors["lang"][value] = _factor(aim, *(sum(r[c] for r in own) for c in ("full", "room", "held")),
                                             max((r["fill"] for r in own if r["fill"] is not None), default=None))
        scaled = _scaled(F.col("cells"), lambda c: _of(factors["lang"], c["lang"]))
        sums = state.select(F.explode(scaled).alias("c")).groupBy(F.col("c.topic").alias("topic")).agg(*_sums(F.col("c"))).collect()
        factors["topic"] = {r["topic"]: _factor(aims["topic"].get(r["topic"], 0.0), r["full"], r["room"], r["held"], r["fill"]) for r in sums}
    return state.select("source", F.explode("before").alias("c")).select(
        "source", "c.lang", "c.topic", "c.base", *(["c.most"] if bounded else []), _clipped(F.col("c")).alias("weight"))


def _fit(marked: DataFrame, temper: dict[str, float] | None, budget: float) -> tuple[DataFrame, DataFrame]:
    """Cells with ``weight`` and ``probability``; per margin's value ``margin, value, wanted, share, met``."""
    cells = materialise(marked.groupBy(*[F.col(f"cell.{m}").alias(m) for m in MARGINS])
                        .agg(F.sum("tokens").cast("double").alias("base")).filter("base > 0"), "mix-cells")
    room = budget * (cells.agg(F.sum("base").alias("t")).first()["t"] or 1.0)
    cells = cells.withColumn("most", F.col("base") / F.lit(room) if room > 0 else F.lit(float("inf")))
    targets = attainable(cells, tempered_targets(cells, TEMPER | (temper or {})))
    fitted = rake(cells, targets).withColumn("probability", F.when(F.col("weight") >= F.col("most"), 1.0).otherwise(
        F.least(F.lit(1.0), F.col("weight") * F.lit(room) / F.col("base"))))
    drawn = fitted.agg(F.sum("weight")).first()[0] or 1.0
    report = reduce(DataFrame.unionAll, [
        fitted.groupBy(m).agg((F.sum("weight") / F.lit(drawn)).alias("share")).join(targets[m], m)
        .select(F.lit(m).alias("margin"), F.col(m).alias("value"), "wanted", "share",
                (F.abs(F.col("share") - F.col("wanted")) <= 10 * TOLERANCE).alias("met")) for m in MARGINS])
    return fitted, report


def margins(docs: DataFrame, temper: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """``margin, value, wanted, share, met`` of a mix: wanted and expected token shares of every margin's values."""
    return _fit(with_cell(docs), temper, budget)[1]


def draw(docs: DataFrame, temper: dict[str, float] | None = None, budget: float = BUDGET,
         seed: int = 9, id_col: str = "doc_id") -> DataFrame:
    """``docs`` as ``row``, with ``doc_id, cell, tokens, probability, sampled`` next to it (see ``mix``)."""
    marked = with_cell(docs)
    fitted, report = _fit(marked, temper, budget)
    missed = report.filter("NOT met").orderBy(F.desc(F.abs(F.col("wanted") - F.col("share")))).take(SHOWN)
    for r in missed:
        LOG.warning("mix: %s %s gets %.6f of the tokens, not %.6f", r["margin"], r["value"], r["share"], r["wanted"])
    rates = fitted.select(F.struct(*MARGINS).alias("cell"), "probability")
    # 53 bits of the hash as a number in [0, 1).
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"row.{id_col}")), 11) / F.lit(float(1 << 53))
    return marked.join(rates, "cell", "left") \
        .withColumn("probability", F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)) \
        .withColumn("sampled", unit < F.col("probability"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, lang, topic, tokens, probability, sampled``.

    ``probability`` is the expected token share the mix wants of the row's
    cell over the tokens it has, for a total of ``budget`` of all tokens, at
    most 1; cells that would need more are drawn whole and the others make up
    for them.  Targets that no such rates meet are logged, and ``margins``
    lists all.  A row is sampled when the hash of its id and ``seed`` falls below
    it, so the draw is the same in every run and repeated rows share their
    fate.  A row without tokens is in no cell total and has probability 0.
    A NULL source or language is the value ``(none)``; a NULL id is drawn
    like any other.
    """
    return draw(docs, **options).select(
        "doc_id", *[F.col(f"cell.{m}").alias(m) for m in MARGINS], "tokens", "probability", "sampled")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``; columns of any name as they are."""
    return unnested(draw(docs, **options).filter("sampled"))
