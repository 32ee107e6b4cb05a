"""Mixing by iterative proportional fitting: weights of (source, language, topic) cells are raked to three sets of marginals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import WHITE, cut, release

MARGINS = ("source", "lang", "topic")
#: Targets are the sizes found, raised to this power: small parts gain, large ones give.
POWER = 0.7
#: Share of all tokens to keep, and sweeps over the three marginals for the weights and for the probabilities.
RATE, SWEEPS, CALIBRATION = 0.7, 8, 16
#: A probability from here on counts as 1, so that rounding does not decide which cells can still grow.
WHOLE = 1 - 1e-9
#: Tables of cells up to this many rows are fitted by one task and sent to all executors; larger ones are fitted sweep by sweep and joined by a shuffle.
BROADCAST_CELLS = 50_000


def token_count(text: Column) -> Column:
    """Words parted by ASCII white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{WHITE}]+"))).cast("long")


def topic_of(text: Column) -> Column:
    """The make of a text: empty, table, symbols, shouting, lines or prose."""
    bare = F.coalesce(text, F.lit(""))
    size = F.length(bare)
    count = lambda marks: sum(size - F.length(F.replace(bare, F.lit(m), F.lit(""))) for m in marks)
    return (
        F.when(size == 0, "empty").when(count("|") * 40 >= size, "table").when(count("#$%&*") * 20 >= size, "symbols")
        .when(count("!") * 20 >= size, "shouting").when(count("\n") * 80 >= size, "lines").otherwise("prose")
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (the margins, tokens) with a weight, so that the weighted tokens of every margin's value are in proportion to its target.

    targets: for each margin a frame (margin, target). A value without a target keeps its weight. Each sweep fits the margins in turn by a
    sum over the cells of each value, and is written out. The frames hold a row for each cell, never documents.
    """
    out = cells.withColumn("weight", F.lit(1.0))
    for margin in MARGINS:
        out = out.join(targets[margin].withColumnRenamed("target", f"target_{margin}"), margin, "left")
    before = None
    for _ in range(sweeps):
        for margin in MARGINS:
            now = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(margin))
            out = out.withColumn("now", now).withColumn("weight", F.when(F.col("now") > 0, F.coalesce(f"target_{margin}", "now") / F.col("now")).otherwise(1.0) * F.col("weight")).drop("now")
        out = cut(out)
        if before is not None:
            release(before)
        before = out
    return out


def power_targets(cells: DataFrame, margin: str, power: float = POWER) -> DataFrame:
    """Targets in proportion to the tokens found, raised to a power, that add up to all tokens."""
    sizes = cells.groupBy(margin).agg(F.sum("tokens").alias("size")).withColumn("raised", F.pow(F.col("size").cast("double"), F.lit(power)))
    total = sizes.agg(F.sum("size").alias("size_sum"), F.sum("raised").alias("raised_sum"))
    return sizes.select(
        margin,
        (F.col("raised") * F.lit(1.0) / total.select("raised_sum").scalar() * total.select("size_sum").scalar()).alias("target"),
    )


def reachable(sizes: DataFrame, tokens: float) -> DataFrame:
    """sizes (value, size, target) with wanted: in proportion to target and `tokens` in all, but at most size, the others sharing what is over.

    The driver sees two sums a round; a round more is taken only where another value turns out too small.
    """
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("target") * F.lit(level) >= F.col("size")
        found = sizes.agg(F.sum(F.when(full, F.col("size")).otherwise(0)).cast("double").alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("target"))).alias("rest")).first()
        higher = (tokens - (found["used"] or 0.0)) / found["rest"] if found["rest"] else 0.0
        if higher <= (level or 0.0) * (1 + 1e-12):
            return sizes.withColumn("wanted", F.least(F.col("size").cast("double"), F.col("target") * F.lit(level or 0.0)))
        level = higher


def calibrate(cells: DataFrame, rate: float = RATE, sweeps: int = CALIBRATION) -> DataFrame:
    """Raked cells with a probability, so that the expected tokens of every margin's value are rate times its raked ones.

    A value that has fewer tokens is kept whole, and the other values of its margin share the rest in proportion, so the rate is met where
    there are tokens for it (see shortfall). Each sweep fits the margins in turn: cells of a value with too much shrink alike; of one with too
    little those below 1 grow, up to 1.
    """
    raked = cells.agg(F.sum(F.col("weight") * F.col("tokens")), F.sum("tokens")).first()
    goal = min(rate * (raked[0] or 0.0), float(raked[1] or 0))
    out = cells.withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("weight")))
    for margin in MARGINS:
        sizes = cells.groupBy(margin).agg(F.sum("tokens").alias("size"), F.sum(F.col("weight") * F.col("tokens")).alias("target"))
        out = out.join(cut(reachable(cut(sizes), goal)).select(margin, F.col("wanted").alias(f"wanted_{margin}")), margin)
    before = None
    for _ in range(sweeps):
        for margin in MARGINS:
            per, kept = Window.partitionBy(margin), F.col("probability") * F.col("tokens")
            whole = F.col("probability") >= WHOLE
            out = out.withColumns({"fixed": F.sum(F.when(whole, kept).otherwise(0.0)).over(per), "free": F.sum(F.when(whole, 0.0).otherwise(kept)).over(per)})
            wanted = F.col(f"wanted_{margin}")
            shrunk = F.col("probability") * wanted / (F.col("fixed") + F.col("free"))
            grown = F.least(F.lit(1.0), F.col("probability") * (wanted - F.col("fixed")) / F.col("free"))
            changed = F.when(F.col("fixed") + F.col("free") <= 0, F.col("probability")).when(F.col("fixed") + F.col("free") > wanted, shrunk).when(whole | (F.col("free") <= 0), F.col("probability")).otherwise(grown)
            out = out.withColumn("probability", changed).drop("fixed", "free")
        out = cut(out)
        if before is not None:
            release(before)
        before = out
    return out


def fitted(cells: DataFrame, targets: dict[str, DataFrame], rate: float, calibrated: bool) -> DataFrame:
    """What rake and, if calibrated, calibrate give for a table of at most BROADCAST_CELLS cells, in one task instead of a job for each sweep."""
    for margin in MARGINS:
        cells = cells.join(targets[margin].withColumnRenamed("target", f"target_{margin}"), margin, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        frame = pd.concat(frames).sort_values(list(MARGINS), ignore_index=True)
        tokens = frame["tokens"].to_numpy(float)
        codes = {m: pd.factorize(frame[m])[0] for m in MARGINS}
        total = lambda m, values: np.bincount(codes[m], values)
        goals = {m: frame.groupby(codes[m])[f"target_{m}"].first().to_numpy(float) for m in MARGINS}
        weight = np.ones(len(frame))
        for _ in range(SWEEPS):
            for m in MARGINS:
                now = total(m, weight * tokens)
                goal = np.where(np.isnan(goals[m]), now, goals[m])
                weight = weight * np.where(now > 0, goal / np.where(now > 0, now, 1.0), 1.0)[codes[m]]
        frame["weight"] = weight
        frame["probability"] = np.minimum(1.0, rate * weight)
        if calibrated:
            frame["probability"] = _probabilities(codes, tokens, weight, rate)
        yield frame[[*MARGINS, "tokens", "weight", "probability"]]

    kind = cells.schema["tokens"].dataType.simpleString()
    return cells.repartition(1).mapInPandas(run, f"source string, lang string, topic string, tokens {kind}, weight double, probability double")


def _probabilities(codes: dict[str, np.ndarray], tokens: np.ndarray, weight: np.ndarray, rate: float) -> np.ndarray:
    """The probabilities of calibrate, over arrays."""
    goal = min(rate * float((weight * tokens).sum()), float(tokens.sum()))
    out, wanted = np.minimum(1.0, rate * weight), {}
    for m in MARGINS:
        size, target = np.bincount(codes[m], tokens), np.bincount(codes[m], weight * tokens)
        level = 0.0
        while True:
            full = (target * level >= size) if level else np.zeros(len(size), bool)
            rest = target[~full].sum()
            higher = (goal - size[full].sum()) / rest if rest else 0.0
            if higher <= level * (1 + 1e-12):
                break
            level = higher
        wanted[m] = np.minimum(size, target * level)
    for _ in range(CALIBRATION):
        for m in MARGINS:
            whole, kept = out >= WHOLE, out * tokens
            fixed, free = np.bincount(codes[m], np.where(whole, kept, 0.0)), np.bincount(codes[m], np.where(whole, 0.0, kept))
            with np.errstate(divide="ignore", invalid="ignore"):
                shrink, grow = (wanted[m] / (fixed + free))[codes[m]], ((wanted[m] - fixed) / free)[codes[m]]
            have, want, loose = (fixed + free)[codes[m]], wanted[m][codes[m]], free[codes[m]] > 0
            over, under = (have > 0) & (have > want), (have > 0) & (have <= want) & ~whole & loose
            out = np.where(over, out * np.where(over, shrink, 1.0), np.where(under, np.minimum(1.0, out * np.where(under, grow, 1.0)), out))
    return out


def shortfall(mixed: DataFrame, rate: float = RATE) -> DataFrame:
    """(margin, value, tokens, target, wanted, expected) of a mixed frame with its raked weights: tokens there are, tokens by the targets, tokens
    that can be had of them, and tokens that the probabilities keep in expectation. target - wanted is the remainder that no sample can hold.
    """
    cells = cut(
        mixed.groupBy(*[F.coalesce(m, F.lit("(none)")).alias(m) for m in MARGINS])
        .agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("raked") * F.col("n_tokens")).alias("raked"), F.sum(F.col("probability") * F.col("n_tokens")).alias("expected"))
    )
    sums = cells.agg(F.sum("raked"), F.sum("tokens")).first()
    goal = min(rate * (sums[0] or 0.0), float(sums[1] or 0))
    out = None
    for margin in MARGINS:
        sizes = cells.groupBy(margin).agg(F.sum("tokens").alias("size"), F.sum("raked").alias("target"), F.sum("expected").alias("expected"))
        rows = reachable(sizes, goal).select(F.lit(margin).alias("margin"), F.col(margin).alias("value"), F.col("size").alias("tokens"), (F.col("target") * F.lit(rate)).alias("target"), "wanted", "expected")
        out = rows if out is None else out.unionByName(rows)
    return out


def uniform(id: Column) -> Column:
    """A number in [0, 1) drawn from an id's md5, the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", targets: dict[str, DataFrame] | None = None, rate: float = RATE, calibrated: bool = True) -> DataFrame:
    """docs with topic, n_tokens, raked, weight, probability and kept added (names already in docs are replaced).

    raked is the weight of the document's cell by the marginals. A document is kept with a probability of at most 1 for which the kept tokens
    meet the raked marginals in expectation, as far as there are tokens (see calibrate and shortfall); weight is probability / rate. Not
    calibrated, weight is raked and the probability is rate * weight cut at 1: cells with a weight over 1 / rate then keep too little, and
    nothing makes up for it. mixing_sql states the calibrated result. An empty table gives an empty result.

    Sampling is the feature here: the decision is drawn from a hash of the id and is the same on every run. Null sources and languages are
    values of their own; a null id is drawn like any other; empty texts have no tokens and take part with their cell's weight.
    """
    added = ("topic", "n_tokens", "raked", "weight", "probability", "kept")
    sized = docs.drop(*added).withColumns({"topic": topic_of(F.col(f"`{text}`")), "n_tokens": token_count(F.col(f"`{text}`"))})
    cells = cut(sized.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).withColumns({m: F.coalesce(m, F.lit("(none)")) for m in MARGINS}).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    if targets is None:
        targets = {m: cut(power_targets(cells, m)) for m in MARGINS}
    small = cells.count() <= BROADCAST_CELLS
    raked = cut(fitted(cells, targets, rate, calibrated)) if small else rake(cells, targets)
    if calibrated and not small:
        raked = calibrate(raked.select(*MARGINS, "tokens", "weight"), rate)
    if calibrated:
        weight, probability = F.col("probability") / F.lit(rate), F.col("probability")
    else:
        weight, probability = F.col("weight"), F.least(F.lit(1.0), F.lit(rate) * F.col("weight"))
    weights = raked.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("weight").alias("raked"), weight.alias("weight"), probability.alias("probability"))
    if small:
        weights = F.broadcast(weights)
    same = [F.coalesce(F.col(m), F.lit("(none)")) == F.col(f"__{m}") for m in MARGINS]
    return (
        sized.join(weights, same, "left").drop(*[f"__{m}" for m in MARGINS])
        .withColumn("kept", uniform(F.col(f"`{id}`")) < F.col("probability"))
    )


def mixing_sql(docs: str, sweeps: int = SWEEPS, power: float = POWER, rate: float = RATE, calibration: int = CALIBRATION) -> str:
    """DuckDB: (doc_id, source, lang, topic, n_tokens, weight, kept) of a relation with the columns of documents; each sweep is written out.

    The level to which the tokens of a margin's values are filled, at most to their size, is the largest of (goal - sizes before) / targets from
    here on, over the values in order of size / target.
    """
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    marks = lambda m: f"(length(t) - length(translate(t, '{m}', '')))"
    parts = [f"""sized as materialized (select doc_id, source, lang,
    case when length(t) = 0 then 'empty' when {marks('|')} * 40 >= length(t) then 'table' when {marks('#$%&*')} * 20 >= length(t) then 'symbols'
         when {marks('!')} * 20 >= length(t) then 'shouting' when (length(t) - length(replace(t, chr(10), ''))) * 80 >= length(t) then 'lines' else 'prose' end as topic,
    case when trim(t, {white}) = '' then 0 else len(string_split_regex(trim(t, {white}), '[ \\t\\n\\v\\f\\r]+')) end as n_tokens
  from (select *, coalesce(text, '') as t from {docs}))""",
        """c0 as materialized (select coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, topic, sum(n_tokens)::double as tokens, 1.0::double as weight from sized group by 1, 2, 3)""",
    ]
    for m in MARGINS:
        parts.append(f"""t_{m} as materialized (select {m}, pow(size, {power}) / sum(pow(size, {power})) over () * sum(size) over () as target
  from (select {m}, sum(tokens) as size from c0 group by {m}))""")
    step = 0
    for _ in range(sweeps):
        for m in MARGINS:
            parts.append(f"""c{step + 1} as materialized (select c.source, c.lang, c.topic, c.tokens,
    c.weight * case when n.now > 0 then t.target / n.now else 1.0 end as weight
  from c{step} c join (select {m}, sum(weight * tokens) as now from c{step} group by {m}) n using ({m}) join t_{m} t using ({m}))""")
            step += 1
    parts.append(f"goal as materialized (select least({rate} * sum(weight * tokens), sum(tokens)) as goal from c{step})")
    for m in MARGINS:
        parts.append(f"""z_{m} as materialized (select *, case when target > 0 then size / target else 0.0 end as ratio
  from (select {m}, sum(tokens) as size, sum(weight * tokens) as target from c{step} group by {m}))""")
        parts.append(f"""w_{m} as materialized (select {m}, least(size, target * level) as wanted from z_{m}, (select max((goal - before) / rest) as level from goal,
    (select coalesce(sum(size) over (order by ratio, {m} rows between unbounded preceding and 1 preceding), 0) as before,
            sum(target) over (order by ratio, {m} rows between current row and unbounded following) as rest from z_{m}) where rest > 0))""")
    parts.append(f"p0 as materialized (select source, lang, topic, tokens, least(1.0::double, {rate} * weight) as p from c{step})")
    turn = 0
    for _ in range(calibration):
        for m in MARGINS:
            parts.append(f"""p{turn + 1} as materialized (select c.source, c.lang, c.topic, c.tokens,
    case when n.fixed + n.free <= 0 then c.p when n.fixed + n.free > w.wanted then c.p * w.wanted / (n.fixed + n.free)
         when c.p >= {WHOLE!r} or n.free <= 0 then c.p else least(1.0, c.p * (w.wanted - n.fixed) / n.free) end as p
  from p{turn} c join w_{m} w using ({m}) join (select {m}, sum(case when p >= {WHOLE!r} then p * tokens else 0.0 end) as fixed,
    sum(case when p >= {WHOLE!r} then 0.0 else p * tokens end) as free from p{turn} group by {m}) n using ({m}))""")
            turn += 1
    return f"""with {", ".join(parts)}
select s.doc_id, s.source, s.lang, s.topic, s.n_tokens::bigint as n_tokens, round(c.p / {rate}, 6) as weight,
       ('0x' || substr(md5(coalesce(s.doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < c.p as kept
from sized s join p{turn} c on coalesce(s.source, '(none)') = c.source and coalesce(s.lang, '(none)') = c.lang and s.topic = c.topic"""
