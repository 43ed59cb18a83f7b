"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Raking multiplies the cells'
token weights until each of the three marginals meets its target within a tolerance; a
document is then sampled with its cell's calibrated probability. Every step is a grouping
or an equi-join over the table of cells, which has at most as many rows as there are
distinct triples; the documents are read once to weigh the cells and once to be sampled.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, free_names, materialise

DIMENSIONS = ("source", "lang", "topic")
#: Marginals are met when none is further from its target than this part of all tokens.
TOLERANCE, STEP, TEMPER, SHARE, SALT = 1e-12, 6, 0.7, 0.8, "mix-1"
#: Cells up to this many are raked in one task, without exchanges; more are dealt by dimension.
CELLS_A_TASK = 100_000


def topic(text: Column) -> Column:
    """A coarse topic from surface cues; null texts are prose."""
    return (
        F.when(text.contains("icense"), "legal").when(text.contains("@"), "contact")
        .when(text.contains(" | "), "tabular").otherwise("prose")
    )


def draw(id: Column, salt: str = SALT) -> Column:
    """A number in [0, 1) that depends on the id only, so reruns and lost tasks agree."""
    digest = F.substring(F.md5(F.concat(F.lit(salt + ":"), F.coalesce(id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**52))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE, most_rounds: int = 20_000) -> tuple[DataFrame, float]:
    """(cells with ``fitted``: token weights whose marginals meet the targets, the largest gap left).

    ``targets`` maps a dimension to a table (value, share); values it lacks keep their own
    share, and shares are scaled to sum to one. Without targets a dimension's shares are
    its token shares to the power ``temper``. Cells without tokens stay at zero, and a
    target for a value without tokens cannot be met.

    Rounds go on until the gap, as a part of all tokens, is within ``tolerance``, or until
    the targets are proved to contradict each other on these cells, which gives a warning
    and the last round's weights. The proof: the logarithms of the factors that a few
    rounds gave to the values add up to at most M in any cell, so weights that met the
    targets could not give the factors a mean of more than M over the targets; if it is
    more, there are none. Slow progress is no contradiction; after ``most_rounds`` it is
    reported as what it is.
    """
    if cells.isEmpty():
        return cells.withColumn("fitted", F.lit(0.0)), 0.0
    size, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    total = float(total or 0)
    out = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        marginal = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("mass"))
        if targets and d in targets:
            given = targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias("given"))
            marginal = marginal.join(given, d, "left").withColumn("wish", F.coalesce("given", F.try_divide("mass", F.lit(total))))
        else:
            marginal = marginal.withColumn("wish", F.pow("mass", F.lit(temper)))
        marginal = materialise(marginal, "mix-marginal")
        wishes = float(marginal.agg(F.sum("wish")).first()[0] or 0)
        goal = F.try_divide(F.col("wish") * F.lit(total), F.lit(wishes))
        out = out.join(marginal.select(d, F.coalesce(goal, F.lit(0.0)).alias(f"goal_{d}")), d)
    if size <= CELLS_A_TASK:
        out = materialise(out.coalesce(1).mapInPandas(raked_rows(total, tolerance, most_rounds), f"{out._jdf.schema().toDDL()}, gap double, contradicted boolean"), "mix-raked")
        gap, contradicted = out.select("gap", "contradicted").first()
    else:
        out, gap, contradicted = raked_rounds(materialise(out, "mix-goals"), total, tolerance, most_rounds)
    if gap > 1e-6:
        why = "the targets contradict each other" if contradicted else "raking has not settled"
        warnings.warn(f"{why}: a marginal misses its target by {gap:.2g} of all tokens", stacklevel=2)
    return out.select(*cells.columns, "fitted"), gap


def raked_rows(total: float, tolerance: float, most_rounds: int):
    """A function for mapInPandas that rakes a table of cells as a whole, in numpy."""

    def run(batches):
        rows = pd.concat(list(batches), ignore_index=True)
        codes = [pd.factorize(rows[d])[0] for d in DIMENSIONS]
        goals = [rows.groupby(c)[f"goal_{d}"].first().to_numpy() for c, d in zip(codes, DIMENSIONS)]
        fitted, possible, scale = rows["fitted"].to_numpy(float), (rows["tokens"] > 0).to_numpy(), max(total, 1.0)
        for c, goal in zip(codes, goals):
            possible = possible & (goal > 0)[c]
        sums = lambda: [np.bincount(c, fitted, len(goal)) for c, goal in zip(codes, goals)]
        contradicted = not possible.any() or any(((goal > 0) & (now <= 0)).any() for goal, now in zip(goals, sums()))
        for n in range(most_rounds):
            mean, logs = 0.0, np.zeros(len(rows))
            for c, goal in zip(codes, goals):
                now = np.bincount(c, fitted, len(goal))
                factor = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
                fitted = fitted * factor[c]
                log = np.log(np.where(factor > 0, factor, 1.0))
                mean, logs = mean + float(goal @ log) / scale, logs + log[c]
            gap = max(float(np.abs(now - goal).max()) for now, goal in zip(sums(), goals)) / scale
            contradicted = contradicted or bool(mean > logs[possible].max() + 1e-9)
            if gap <= tolerance or contradicted and n >= STEP:
                break
        yield rows.assign(fitted=fitted, gap=gap, contradicted=contradicted)

    return run


def raked_rounds(out: DataFrame, total: float, tolerance: float, most_rounds: int) -> tuple[DataFrame, float, bool]:
    """(cells, gap, contradicted) by rounds over the distributed table, STEP to a job."""
    done, scale = 0, max(total, 1.0)
    while True:
        for n in range(STEP):
            for d in DIMENSIONS:
                factor = F.coalesce(F.try_divide(F.col(f"goal_{d}"), F.sum("fitted").over(W.partitionBy(d))), F.lit(0.0))
                out = out.withColumn(f"factor_{d}" if n == STEP - 1 else "factor", factor)
                out = out.withColumn("fitted", F.col("fitted") * F.col(f"factor_{d}" if n == STEP - 1 else "factor"))
        out, done = materialise(out.drop("factor"), "mix-round"), done + STEP
        sums, most, possible = None, F.lit(0.0), F.col("tokens") > 0
        for d in DIMENSIONS:
            log = F.ln(F.when(F.col(f"factor_{d}") > 0, F.col(f"factor_{d}")).otherwise(1.0))
            most, possible = most + log, possible & (F.col(f"goal_{d}") > 0)
            value = out.groupBy(d).agg(F.sum("fitted").alias("now"), F.first(f"goal_{d}").alias("goal"), F.first(log).alias("log"))
            row = value.agg(F.max(F.abs(F.col("now") - F.col("goal"))).alias("gap"), F.sum(F.col("goal") * F.col("log")).alias("mean"), F.max((F.col("goal") > 0) & (F.col("now") <= 0)).alias("empty"))
            sums = row if sums is None else sums.unionByName(row)
        found, highest = sums.collect(), out.where(possible).agg(F.max(most)).first()[0]
        gap = max(r["gap"] or 0.0 for r in found) / scale
        contradicted = highest is None or any(r["empty"] for r in found) or sum(r["mean"] or 0.0 for r in found) / scale > highest + 1e-9
        out = out.drop(*(f"factor_{d}" for d in DIMENSIONS))
        if gap <= tolerance or contradicted or done >= most_rounds:
            return out, gap, contradicted


def calibrate(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """Adds ``p``: the largest p = min(1, scale * fitted / tokens) that keeps ``share`` of the tokens.

    The scale is solved for by filling up: cells that it fills are kept whole, and what is
    left is shared by the others, until no other cell is filled. Each step is one
    aggregation; the scale only rises, so there are few.
    """
    known = cells.select("tokens", "fitted").where("tokens > 0")
    total = known.agg(F.sum("tokens").cast("double").alias("t"), F.sum("fitted").alias("f")).first()
    scale, full = (share * total["t"] / total["f"] if total["t"] and total["f"] else None), -1
    while scale is not None:
        filled = F.lit(scale) * F.col("fitted") >= F.col("tokens")
        got = known.agg(F.count(F.when(filled, 1)).alias("n"), F.coalesce(F.sum(F.when(filled, F.col("tokens"))), F.lit(0)).alias("t"), F.sum(F.when(~filled, F.col("fitted"))).alias("f")).first()
        if got["n"] == full or not got["f"]:
            break
        scale, full = max(scale, (share * total["t"] - got["t"]) / got["f"]), got["n"]
    ratio = F.coalesce(F.try_divide("fitted", "tokens"), F.lit(0.0))
    p = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(1.0 if scale is None else scale) * ratio))
    return cells.withColumn("p", p)


def dimension_columns(docs: DataFrame, text: str, source: str, lang: str, topic_column: str | None) -> dict[str, Column]:
    given = F.col(topic_column) if topic_column else topic(F.col(text))
    named = {"source": F.col(source), "lang": F.col(lang), "topic": given}
    return {k: F.coalesce(v.cast("string"), F.lit("unknown")) for k, v in named.items()}


def mixed(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", lang: str = "lang", topic_column: str | None = None, tokens_column: str | None = None, targets: dict | None = None, share: float = SHARE, temper: float = TEMPER, name: str = "__mix") -> DataFrame:
    """``docs`` with a struct column ``name``: source, lang, topic, n_tokens, p, u, kept.

    A token is a word, unless ``tokens_column`` gives counts (null: 0). A null source,
    language or topic is the value "unknown"; null texts have no tokens, long ones are
    counted whole. Cells without tokens are kept whole. A row's draw depends on its id
    only: rows that share an id (null ids share one draw) fare alike within a cell. Other
    columns stay as they are, whatever their names (but ``name``, which must be free). An
    empty table gives an empty result.
    """
    key, place, p = free_names(docs, "__key", "__cell", "__p")
    columns = dimension_columns(docs, text, source, lang, topic_column)
    counted = F.col(tokens_column) if tokens_column else F.regexp_count(F.col(text).cast("string"), F.lit(WORD))
    words = F.coalesce(counted, F.lit(0)).cast("long")
    rows = docs.withColumn(key, F.struct(*(v.alias(k) for k, v in columns.items()), words.alias("n_tokens")))
    cells = rows.select(f"{key}.*").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = calibrate(rake(materialise(cells, "mix-cells"), targets, temper)[0], share)
    fitted = materialise(fitted.select(F.struct(*DIMENSIONS).alias(place), F.col("p").alias(p)), "mix-p")
    cell = F.struct(*(F.col(f"{key}.{d}").alias(d) for d in DIMENSIONS))
    joined = rows.withColumn(place, cell).join(fitted, place, "left")
    u = draw(F.col(id))
    mix = F.struct(*(F.col(f"{key}.{c}").alias(c) for c in (*DIMENSIONS, "n_tokens")), F.col(p).alias("p"), u.alias("u"), (u < F.col(p)).alias("kept"))
    return joined.withColumn(name, mix).drop(key, place, p)


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``; columns as they were."""
    (name,) = free_names(docs, "__mix")
    return mixed(docs, name=name, **options).where(f"`{name}`.kept").select(*docs.columns)


def oracle_sql(rounds: int = 60, temper: float = TEMPER, share: float = SHARE, salt: str = SALT) -> str:
    """The query over ``documents`` as DuckDB SQL, with ``rounds`` of raking as a recursion."""
    nested = f"SELECT * REPLACE (round + 1 AS round) FROM fit WHERE round < {rounds}"
    for d in DIMENSIONS:
        nested = f"SELECT * REPLACE (coalesce(fitted * goal_{d} / nullif(sum(fitted) OVER (PARTITION BY {d}), 0), 0) AS fitted) FROM ({nested})"
    marginals = ", ".join(
        f"m_{d} AS (SELECT {d}, pow(mass, {temper}) / sum(pow(mass, {temper})) OVER () * sum(mass) OVER () AS goal_{d} "
        f"FROM (SELECT {d}, sum(tokens)::DOUBLE AS mass FROM cells GROUP BY {d}))"
        for d in DIMENSIONS
    )
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE WHEN contains(text, 'icense') THEN 'legal' WHEN contains(text, '@') THEN 'contact'
         WHEN contains(text, ' | ') THEN 'tabular' ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{marginals},
goals AS (SELECT 0 AS round, c.*, c.tokens::DOUBLE AS fitted, goal_source, goal_lang, goal_topic
  FROM cells c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic)),
fit AS (SELECT * FROM goals UNION ALL {nested}),
r AS (SELECT *, coalesce(fitted / nullif(tokens, 0), 0) AS ratio FROM fit WHERE round = {rounds}),
q AS (SELECT *,
  ({share} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(fitted) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale,
  row_number() OVER (ORDER BY ratio DESC, source, lang, topic) AS place FROM r),
s AS (SELECT *, arg_min(scale, CASE WHEN scale * ratio <= 1 THEN place END) OVER () AS best FROM q),
p AS (SELECT source, lang, topic, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, coalesce(best, 1.0) * ratio) END AS p FROM s),
u AS (SELECT *, CAST('0x' || substr(md5('{salt}:' || doc_id), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM d)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, u < p AS kept FROM u JOIN p USING (source, lang, topic)
"""
