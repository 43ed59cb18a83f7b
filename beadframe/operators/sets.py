"""Probe-set enrichment: set by set, by running sums, and statistics of sets.

Sets are (dbname, probe_id[, value]); a query is (probe_id) or (probe_id, value). One
aggregation counts overlaps for all sets at once; tails are expressions on its result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normal
from ..functions.store import stored
from ..functions.windows import benjamini_hochberg, log_factorial, mean_rank

LOG2_MAX, LOG2_MIN = 1024.0, -1022.0  # log2 of the largest and smallest double


def restrict(members: DataFrame, universe: DataFrame) -> DataFrame:
    """Members within the universe; sets left without any go."""
    return members.join(universe.select("probe_id").distinct(), "probe_id", "left_semi")


def overlap_counts(members: DataFrame, query: DataFrame, universe: DataFrame) -> DataFrame:
    """(dbname, nd, ndq, nq, nu); nq counts the whole query, as given."""
    inside = restrict(members.select("dbname", "probe_id").distinct(), universe)
    hits = query.select("probe_id").distinct().withColumn("__q", F.lit(1))
    n = inside.join(hits, "probe_id", "left").groupBy("dbname").agg(F.count("*").alias("nd"), F.count("__q").alias("ndq"))
    totals = hits.agg(F.count("*").alias("nq")).join(universe.agg(F.countDistinct("probe_id").alias("nu")))
    return n.join(F.broadcast(totals))  # one row


def _log_choose(n: str, k: str) -> str:
    return f"({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')})"


def log10_tail(alternative: str = "greater") -> Column:
    """log10 of the hypergeometric tail of (nd, nq, ndq, nu), as a log-sum-exp over its terms."""
    low, high = "greatest(0, nq + nd - nu)", "least(nq, nd)"
    bounds = {"greater": ("ndq", high), "less": (low, "ndq")}
    if alternative == "two.sided":
        one = F.least(log10_tail("greater"), log10_tail("less")) + F.log10(F.lit(2.0))
        return F.least(F.lit(0.0), one)
    if alternative not in bounds:
        raise ValueError("alternative must be greater, less or two.sided")
    a, b = bounds[alternative]
    whole = "ndq <= 0" if alternative == "greater" else f"ndq >= {high}"
    # What depends on x, and apart from it what does not; the largest term is found once.
    term = f"- ({log_factorial('x')} + {log_factorial('(nd - x)')} + {log_factorial('(nq - x)')} + {log_factorial('(nu - nd - nq + x)')})"
    same = f"({log_factorial('nd')} + {log_factorial('(nu - nd)')} - {_log_choose('nu', 'nq')})"
    terms = f"transform(array(transform(sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)), x -> {term})), t -> struct(t, array_max(t) AS top))"
    log = f"({same} + element_at(transform({terms}, z -> z.top + ln(aggregate(z.t, 0.0D, (s, y) -> s + exp(y - z.top)))), 1))"
    return F.expr(f"CASE WHEN {whole} THEN 0.0D ELSE least(0.0D, {log} / ln(10.0D)) END")


def fisher_columns(counts: DataFrame, alternative: str = "greater") -> DataFrame:
    """estimate (log2 odds ratio), p, log10_p and coefficients from (nd, nq, ndq, nu)."""
    d = lambda c: F.col(c).cast("double")
    only_q, only_d, neither = d("nq") - d("ndq"), d("nd") - d("ndq"), d("nu") - d("nq") - d("nd") + d("ndq")
    top, bottom = d("ndq") * neither, only_q * only_d
    estimate = (
        F.when((bottom == 0) & ((d("ndq") == 0) | (neither == 0)), F.lit(None)).when(bottom == 0, F.lit(LOG2_MAX))
        .when(top == 0, F.lit(LOG2_MIN)).otherwise(F.log2(F.try_divide(top, bottom)))
    )
    out = counts.withColumn("log10_p", log10_tail(alternative))
    npmi = F.try_divide(F.log2("nd") + F.log2("nq") - 2 * F.log2("nu"), F.when(F.col("ndq") > 0, F.log2("ndq")) - F.log2("nu")) - 1
    return out.withColumns({
        "estimate": estimate, "p": F.pow(F.lit(10.0), F.col("log10_p")), "jaccard": F.try_divide(d("ndq"), d("nd") + only_q),
        "overlap_coef": F.try_divide(d("ndq"), F.least("nd", "nq")), "npmi": F.when(F.col("ndq") == 0, F.lit(-1.0)).otherwise(npmi),
        "dice": F.try_divide(2 * d("ndq"), d("nd") + d("nq")),
    })


def enrich(query: DataFrame, members: DataFrame, universe: DataFrame, alternative: str = "greater") -> DataFrame:
    """A row a set, with FDR over all sets; order by log10_p, then by the estimate's size."""
    out = stored(fisher_columns(overlap_counts(members, query, universe), alternative), "enriched")  # a set's tail is summed once
    return benjamini_hochberg(out, "p", "fdr", ties=["dbname"])


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("log10_p"), F.abs("estimate").desc_nulls_last(), "dbname")


def aggregate_results(results: DataFrame, names: list[str], column: str = "estimate") -> DataFrame:
    """(query, one column a set) from results of several queries."""
    return results.groupBy("query").pivot("dbname", names).agg(F.first(column))


def set_overlap(members: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard) of pairs of sets that share a probe, a < b.

    Pairs come from an equi-join on the probe, so sets without a common probe cost nothing.
    """
    m = members.select("dbname", "probe_id").distinct()
    size = m.groupBy("dbname").agg(F.count("*").alias("n"))
    a, b = m.withColumnRenamed("dbname", "a"), m.withColumnRenamed("dbname", "b")
    shared = a.join(b, "probe_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def network(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (dbname) and edges (source, target, weight)."""
    edges = set_overlap(members).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("jaccard").alias("weight"))
    return members.select("dbname").distinct(), edges


def annotate(probes: DataFrame, members: DataFrame, sep: str = ",") -> DataFrame:
    """(probe_id, sets): names of the sets that hold a probe, joined; null if none does."""
    m = members.select("dbname", "probe_id").distinct()
    rows = probes.select("probe_id").distinct().join(m, "probe_id", "left").groupBy("probe_id").agg(F.sort_array(F.collect_set("dbname")).alias("x"))
    return rows.select("probe_id", F.when(F.size("x") > 0, F.array_join("x", sep)).alias("sets"))


def indicator(probes: DataFrame, members: DataFrame, names: list[str]) -> DataFrame:
    """(probe_id, one 0/1 column a set)."""
    m = members.select("dbname", "probe_id").distinct()
    return probes.select("probe_id").distinct().join(m, "probe_id", "left").groupBy("probe_id").pivot("dbname", names).count().fillna(0)


def set_statistics(betas: DataFrame, members: DataFrame, fun=F.avg, n_min: int = 0, f_min: float = 0.1) -> DataFrame:
    """(sample_id, dbname, n, value): ``fun`` of a set's betas; null when too few are not null.

    Too few: under ``n_min``, or under ``f_min`` of the set's probes that the betas have.
    """
    rows = betas.join(members.select("dbname", "probe_id").distinct(), "probe_id")
    n, have = F.count("beta"), F.count("*")
    ok = n >= F.greatest(F.lit(float(n_min)), f_min * have)
    return rows.groupBy("sample_id", "dbname").agg(n.alias("n"), F.when(ok & (n > 0), fun("beta")).alias("value"))


def running_scores(values: DataFrame, members: DataFrame) -> DataFrame:
    """(dbname, n, overlap, es_max, es_min) of each set over the ranked values.

    Instead of walking all values for each set, only members are ranked against them: the
    running sum peaks at a member and bottoms just before one, so both extremes follow from
    the members' ranks. Work is values + memberships, not values times sets.
    """
    v = values.where("value IS NOT NULL")
    ranked = _positions(v)
    total = v.agg(F.count("*").alias("n"))
    held = members.select("dbname", "probe_id").distinct().join(ranked, "probe_id")
    sizes = held.groupBy("dbname").agg(F.count("*").alias("overlap"))
    rows = held.join(sizes, "dbname").join(F.broadcast(total))  # one row
    k = F.row_number().over(W.partitionBy("dbname").orderBy("at"))
    others = F.col("n") - F.col("overlap")
    high = k / F.col("overlap") - F.try_divide(F.col("at") - k, others)
    low = (k - 1) / F.col("overlap") - F.try_divide(F.col("at") - k, others)
    rows = rows.withColumns({"high": high, "low": low})
    out = rows.groupBy("dbname").agg(F.first("n").alias("n"), F.first("overlap").alias("overlap"), F.max("high").alias("es_max"), F.least(F.min("low"), F.lit(0.0)).alias("es_min"))
    none = (F.col("overlap") == F.col("n")) | (F.col("overlap") == 0)
    return out.withColumns({c: F.when(~none, F.col(c)).otherwise(F.lit(0.0)) for c in ("es_max", "es_min")})


def _positions(values: DataFrame) -> DataFrame:
    """(probe_id, at): 1-based position by (value, probe_id), from one distributed sort."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.repartitionByRange(n, "value", "probe_id").sortWithinPartitions("value", "probe_id")
    rows = dealt.select("probe_id", F.monotonically_increasing_id().alias("mono"))
    rows = rows.select("probe_id", F.shiftright("mono", 33).alias("part"), (F.col("mono").bitwiseAND((1 << 33) - 1) + 1).alias("row"))
    counts = rows.groupBy("part").agg(F.count("*").alias("c"))  # one row a partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    return rows.join(F.broadcast(offsets), "part").select("probe_id", (F.col("row") + F.col("off")).alias("at"))


def null_scores(sizes: DataFrame, permutations: int, seed: int = 1) -> DataFrame:
    """(overlap, draw, high, low): running-sum extremes of random sets of each size.

    ``sizes`` (n, overlap) has one n. Draw i orders the positions by a hash of seed, draw
    and position, and a set of k takes the first k of them: uniform, without replacement,
    and the same wherever it is computed. Only hashes below what the largest set is all but
    sure to need are sorted; should a draw have too few of these, its other positions come
    to them. A draw's group has the largest set's positions, and each size takes its part.
    """
    found = sizes.agg(F.first("n").alias("n"), F.max("overlap").alias("most"), F.array_sort(F.collect_set("overlap")).alias("sizes")).first()  # distinct sizes
    names = "overlap long, draw int, high double, low double"
    if not found["sizes"]:
        return sizes.sparkSession.createDataFrame([], names)
    n, most, each = found["n"], found["most"], 1 << 16

    def placed(draws: DataFrame) -> DataFrame:
        blocks = draws.select("draw", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // each).cast("long"))).alias("block")).repartition("draw", "block")
        at = F.explode(F.sequence(F.col("block") * each + 1, F.least(F.lit(n).cast("long"), (F.col("block") + 1) * each)))
        return blocks.select("draw", at.alias("at")).withColumn("key", F.md5(F.concat_ws("-", F.lit(str(seed)), "draw", "at")))

    draws = sizes.sparkSession.range(permutations).select(F.col("id").cast("int").alias("draw"))
    share = most / n
    share += 7 * math.sqrt(share * (1 - share) / n) + 1 / n
    low = F.col("key") <= f"{min(int(share * 2**52), 2**52 - 1):013x}z"
    first = stored(placed(draws).where(low), "draws")
    few = stored(draws.join(first.groupBy("draw").agg(F.count("*").alias("c")), "draw", "left").where(F.coalesce("c", F.lit(0)) < most).select("draw"), "few")
    if not few.isEmpty():
        first = first.unionByName(placed(few).where(~low))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("draw").orderBy("key"))).where(F.col("rank") <= most).select("draw", "at", "rank")
    asked = [int(k) for k in found["sizes"]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at, rank = pdf["at"].to_numpy(), pdf["rank"].to_numpy()
        rows = []
        for k in asked:
            j = np.arange(1, k + 1)
            missed = (at[rank <= k] - j) / (n - k) if k < n else np.full(k, np.nan)
            rows.append((k, pdf["draw"].iloc[0], float(np.max(j / k - missed)), min(float(np.min((j - 1) / k - missed)), 0.0)))
        return pd.DataFrame(rows, columns=["overlap", "draw", "high", "low"])

    return ranked.groupBy("draw").applyInPandas(run, names)


def enrich_values(values: DataFrame, members: DataFrame, permutations: int = 100, precise: bool = False, seed: int = 1, most: int = 1000) -> DataFrame:
    """(dbname, n, overlap, estimate, p): running-sum enrichment with a permutation null.

    A null score depends on the two counts only, so sets of one size share their draws.
    With ``precise`` a set with p below 0.01 on either side is tested with ``most`` draws.
    A side that no draw reaches takes a normal tail. A negative estimate is enrichment at
    large values; a set of none or of all values has estimate 0 and p 1.
    """
    scored = stored(running_scores(values, members), "scores")
    tested = scored.where("overlap > 0 AND overlap < n")

    def shares(rows: DataFrame, draws: int) -> DataFrame:
        null = null_scores(rows.select("n", "overlap").distinct(), draws, seed).withColumnRenamed("overlap", "size")
        met = rows.join(null, F.col("overlap") == F.col("size"))
        one = lambda c: F.avg(c.cast("double"))
        return met.groupBy("dbname", "n", "overlap", "es_max", "es_min").agg(
            one(F.col("high") > F.col("es_max")).alias("p_high"), one(F.col("low") <= F.col("es_min")).alias("p_low"),
            F.avg("high").alias("m_high"), F.stddev_samp("high").alias("s_high"), F.avg("low").alias("m_low"), F.stddev_samp("low").alias("s_low"),
        )

    found = shares(tested, permutations)
    if precise and permutations < most:
        found = stored(found, "null-shares")
        strong = found.where("p_high < 0.01 OR p_low < 0.01").select("dbname", "n", "overlap", "es_max", "es_min")
        if not strong.isEmpty():
            found = found.where("NOT (p_high < 0.01 OR p_low < 0.01)").unionByName(shares(strong, most))
    deviations = lambda s, m, c: (F.col(s) - F.col(m)) / (F.greatest(c, F.lit(1e-12)) * F.sqrt(F.lit(2.0)))
    found = found.withColumns({"y_high": deviations("es_max", "m_high", F.col("s_high")), "y_low": deviations("m_low", "es_min", F.col("s_low"))})
    high = F.when(F.col("p_high") == 0, F.expr(normal.upper_tail("y_high"))).otherwise(F.col("p_high"))
    low = F.when(F.col("p_low") == 0, F.expr(normal.upper_tail("y_low"))).otherwise(F.col("p_low"))
    large = -F.col("es_min") > F.col("es_max")
    out = found.select("dbname", F.when(large, F.col("es_min")).otherwise(F.col("es_max")).alias("estimate"), F.when(large, low).otherwise(high).alias("p"))
    rows = scored.select("dbname", "n", "overlap").join(out, "dbname", "left")
    return rows.select("dbname", "n", "overlap", F.coalesce("estimate", F.lit(0.0)).alias("estimate"), F.coalesce("p", F.lit(1.0)).alias("p"))


def spearman(values: DataFrame, members: DataFrame) -> DataFrame:
    """(dbname, n, rho): rank correlation of the query's values with a numeric set's."""
    rows = members.where("value IS NOT NULL").select("dbname", "probe_id", F.col("value").alias("y")).join(values.where("value IS NOT NULL").select("probe_id", F.col("value").alias("x")), "probe_id")
    ranked = rows.withColumns({"rx": mean_rank("x", ["dbname"]), "ry": mean_rank("y", ["dbname"])})
    return ranked.groupBy("dbname").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def find_groups(members: DataFrame, name: str | None = None, how: str = "substring", platform: str | None = None) -> DataFrame:
    """(group, dbname, n): sets whose group matches exactly, by substring or by all dot-separated tokens.

    ``platform`` keeps groups that have it among their tokens.
    """
    rows = members.groupBy("group", "dbname").agg(F.countDistinct("probe_id").alias("n"))
    if platform is not None:
        rows = rows.where(F.array_contains(F.split("group", r"\."), platform))
    if name is None:
        return rows
    if how == "exact":
        return rows.where(F.col("group") == name)
    if how == "substring":
        return rows.where(F.lower("group").contains(name.lower()))
    tokens = F.split(F.lower("group"), r"\.")
    return rows.where(F.forall(F.array(*(F.lit(t) for t in name.lower().split("."))), lambda t: F.array_contains(tokens, t)))


def take_groups(members: DataFrame, names: list[str]) -> DataFrame:
    """The members of the named groups; an unknown name is an error."""
    chosen = members.where(F.col("group").isin(*names))
    missing = set(names) - {r[0] for r in chosen.select("group").distinct().collect()}  # names asked for at most
    if missing:
        raise ValueError(f"no set group {sorted(missing)}")
    return chosen


def set_metadata(members: DataFrame, meta: DataFrame) -> DataFrame:
    """(group, dbname, n, columns of ``meta``): a row a set; sets without metadata have nulls."""
    sizes = members.groupBy("group", "dbname").agg(F.countDistinct("probe_id").alias("n"))
    return sizes.join(meta, ["group", "dbname"], "left")


def universe(manifests: DataFrame, platform: str) -> DataFrame:
    """(probe_id): all probes of a platform; an error where the manifests (platform, probe_id) have none."""
    rows = manifests.where(F.col("platform") == platform).select("probe_id").distinct()
    if rows.isEmpty():
        raise ValueError(f"no manifest of {platform}; give the universe itself")
    return rows
