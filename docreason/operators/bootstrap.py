"""Bootstrap confidence intervals (A12-A15), in two modes.

hash
    Draw j of replicate r in a sample group picks sorted position
    ``md5(seed-group-r-j) mod n``. Any engine that sorts by value and hashes
    alike draws the same samples, so results are checked against SQL. Draws
    are generated per (group, replicate, chunk) so that no task creates a
    whole group's draws; a chunk's draws of one value are counted together
    where its group has at most ``FEW_VALUES`` of them. Positions are resolved
    against value intervals of the sorted value counts with a bucketed range
    join (equi-join on bucket and range) -- no window over a group's rows.
    Cost: n * B draws; meant for small B.

poisson
    Independent Poisson(1) weights per row (the Poisson bootstrap). Rows are
    first compressed to cells of equal values with multiplicity m; the sum of
    m Poisson(1) weights is Poisson(m), so one draw per cell and replicate is
    exact for this scheme. Draws come from a counter-based generator (Philox)
    keyed by the cell, hence identical at any partitioning and after task
    retries. A task keeps, for the group at hand, one row of weighted sums per
    replicate and adds its cells to it by a matrix product; it sends on groups
    x B rows whatever the number of cells, and the rows are summed by (group,
    replicate). Every replicate is there, also one whose weights are all zero:
    its metrics are NULL, percentiles leave it out, and ``n_usable`` counts the
    others.

    Spearman needs ranks within each replicate. Values are put on a grid of
    ranges per group and score, none of which holds more than 1 / ``RANK_GRID``
    of the rows unless it is one value (exact as long as a score has no more
    than ``RANK_GRID`` distinct values; beyond that, values of one range count
    as ties), the grid's cells are drawn as cells are, and a task computes the
    correlations of a block of replicates of one group, whose size is bounded
    by the grid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.functions.scores import linspace, rnd
from docreason.operators.joins import join_on
from docreason.operators.ranks import exact_quantile, running_below
from docreason.schemas import N_BOOT, N_CAL_BINS, SEED_PER_DOMAIN
from docreason.session import materialize

DRAW_CHUNK = 65536
# Groups with at most so many distinct values have their draws counted by value.
FEW_VALUES = 512
# A range of the rank grid holds at most 1 / RANK_GRID of the rows; replicates
# per task of the rank grid, and replicates ranked at a time.
RANK_GRID = 64
RANK_BLOCK = 250
RANK_STEP = 25


# ---------------------------------------------------------------- hash mode
def _hash_draws(work: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """The draws of every row (group, replicate r, chunk c) of ``work``: keys, r,
    n, _w, k, m. Position k is drawn m times, where the draws of one value of a
    group with known ``_edges`` all count at its first position."""
    from docreason.session import ship_package
    ship_package(work.sparkSession)
    from docreason.functions.draws import md5_draws
    kept = [*keys, "r", "n", "_w"]
    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in kept) + ", k long, m long"

    def drawn(prefix: str, n: int, c: int, edges: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        k = (md5_draws(prefix.encode(), c * chunk, min(n, (c + 1) * chunk)) % np.uint64(n)).astype(np.int64)
        if edges is None:
            return k, np.ones(len(k), np.int64)
        many = np.bincount(np.searchsorted(edges, k, side="right") - 1, minlength=len(edges))
        return edges[many > 0], many[many > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ready = [], 0

            def done() -> pa.RecordBatch:
                of = batch.select(kept).take(np.repeat([i for i, _, _ in rows], [len(k) for _, k, _ in rows]))
                return pa.RecordBatch.from_arrays([*of.columns, pa.array(np.concatenate([k for _, k, _ in rows])),
                                                   pa.array(np.concatenate([m for _, _, m in rows]))], names=[*kept, "k", "m"])

            for i in range(batch.num_rows):
                prefix, n, c, edges = (batch[x][i] for x in ("_prefix", "n", "c", "_edges"))
                rows.append((i, *drawn(prefix.as_py(), n.as_py(), c.as_py(), edges.values.to_numpy() if edges.is_valid else None)))
                ready += len(rows[-1][1])
                if ready >= chunk:
                    yield done()
                    rows, ready = [], 0
            if rows:
                yield done()

    return work.select(*kept, "c", "_prefix", "_edges").mapInArrow(run, schema)


def replicate_means_hash(values: DataFrame, keys: list[str], value: str, n_boot: int,
                         seed: int, chunk: int = DRAW_CHUNK, few: int = FEW_VALUES) -> DataFrame:
    """Per group and replicate r in [0, n_boot): the mean of a resample of n
    out of the group's n values. Returns keys, r, rep_mean."""
    v = values.where(F.col(value).isNotNull())
    # Written once: sizes and running totals read the counts several times.
    counts = materialize(v.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt")), "value-counts")
    # Position buckets as wide as a group's mean value interval (n / distinct
    # values): a draw meets about two candidate intervals and the intervals
    # spread over about twice as many bucket rows as there are values,
    # whether values are heavily tied or all distinct.
    sizes = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("_d")) \
        .withColumn("_w", F.greatest(F.lit(1), F.floor(F.col("n") / F.col("_d"))))
    # Value intervals [below, below + cnt) of sorted positions, spread over
    # the position buckets they touch.
    iv = running_below(counts, keys, value, "cnt").select(
        *keys, value, F.col("below").alias("lo"), (F.col("below") + F.col("cnt")).alias("hi"))
    iv = join_on(iv, sizes.select(*keys, "_w", "_d"), keys).withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_w")),
                                       F.floor((F.col("hi") - 1) / F.col("_w"))))).drop("_w")
    # Written, so that Spark knows its size before it plans the join with the draws.
    iv = materialize(iv, "value-intervals")
    edges = iv.where(F.col("_d") <= few).groupBy(*keys).agg(F.array_sort(F.collect_set("lo")).alias("_edges"))
    # Draws: (group, r, chunk) rows are spread over tasks before the
    # positions inside a chunk are generated.
    n_chunks = F.floor((F.col("n") - 1) / chunk)
    n_parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.concat(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("r").cast("string")), F.lit("-"))
    work = (join_on(sizes, edges, keys, "left").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
            .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), n_chunks))).withColumn("_prefix", prefix)
            .repartition(n_parts, *keys, "r", "c"))
    draws = _hash_draws(work, keys, chunk).withColumn("bucket", F.floor(F.col("k") / F.col("_w")))
    # A left join, as Spark takes the draws for no more than the rows they are
    # generated from: of the two sides only the intervals may be broadcast.
    at = iv.select(*[F.col(k).alias(f"_r_{k}") for k in keys], value, "lo", "hi", F.col("bucket").alias("_r_bucket"))
    same = (F.col("bucket") == F.col("_r_bucket")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    means = draws.join(at, same, "left").groupBy(*keys, "r").agg((F.sum(F.col(value) * F.col("m")) / F.max("n")).alias("rep_mean"))
    # Groups x replicates rows, written once: intervals of differences read them several times.
    return materialize(means, "replicate-means")


def mean_ci_hash(values: DataFrame, keys: list[str], value: str, n_boot: int, seed: int) -> DataFrame:
    """Sample mean, replicate median and 2.5/97.5 percentiles per group."""
    reps = replicate_means_hash(values, keys, value, n_boot, seed)
    q = reps.groupBy(*keys).agg(F.percentile("rep_mean", [0.025, 0.5, 0.975]).alias("_q"))
    obs = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg(value).alias("_mean"))
    return join_on(obs, q, keys).select(
        *keys, "n_valid", rnd("_mean").alias("mean"), rnd(F.col("_q")[1]).alias("boot_median"),
        rnd(F.col("_q")[0]).alias("ci_lo"), rnd(F.col("_q")[2]).alias("ci_hi"))


def diff_ci_hash(values: DataFrame, group: list[str], arm: str, value: str, cond_arms: list[str],
                 base_arm: str, n_boot: int, seed: int) -> DataFrame:
    """A13 with hash-mode replicates."""
    reps = replicate_means_hash(values, group + [arm], value, n_boot, seed)
    return diff_ci(values, group, arm, value, cond_arms, base_arm, reps)


def diff_ci(values: DataFrame, group: list[str], arm: str, value: str, cond_arms: list[str],
            base_arm: str, reps: DataFrame) -> DataFrame:
    """Per group and compared arm, observed difference of means to the
    baseline and percentile interval of replicate differences (each side
    resampled independently, replicate r paired with r)."""
    keys = group + [arm]
    cur = reps.where(F.col(arm).isin(cond_arms))
    base = reps.where(F.col(arm) == base_arm).select(*group, "r", F.col("rep_mean").alias("_b"))
    q = (join_on(cur, base, group + ["r"]).withColumn("_d", F.col("rep_mean") - F.col("_b"))
         .groupBy(*keys).agg(F.percentile("_d", [0.025, 0.975]).alias("_q")))
    obs = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("_m"))
    ob = obs.where(F.col(arm) == base_arm).select(*group, F.col("_m").alias("_mb"))
    oc = obs.where(F.col(arm).isin(cond_arms))
    return join_on(join_on(oc, ob, group), q, keys).select(
        *keys, rnd(F.col("_m") - F.col("_mb")).alias("diff_mean"),
        rnd(F.col("_q")[0]).alias("diff_lo"), rnd(F.col("_q")[1]).alias("diff_hi"))


def did_ci_hash(values: DataFrame, outer: list[str], domain: str, arm: str, value: str,
                cond_arms: list[str], base_arm: str, n_boot: int, seed: int) -> DataFrame:
    """A14 with hash-mode replicates."""
    reps = replicate_means_hash(values, outer + [domain, arm], value, n_boot, seed)
    return did_ci(outer, domain, arm, cond_arms, base_arm, reps)


def did_ci(outer: list[str], domain: str, arm: str, cond_arms: list[str], base_arm: str,
           reps: DataFrame) -> DataFrame:
    """Per outer key (metric) and compared arm, replicate difference of
    effects between the first and second domain; middle = mean of the
    replicates. Without exactly two domains that have both sides the row has
    NULL domains and values."""
    base = reps.where(F.col(arm) == base_arm).select(*outer, domain, "r", F.col("rep_mean").alias("_b"))
    cur = reps.where(F.col(arm).isin(cond_arms))
    eff = join_on(cur, base, outer + [domain, "r"]).withColumn("_e", F.col("rep_mean") - F.col("_b"))
    # One row per replicate: the effects of the domains, first to last.
    by_rep = eff.groupBy(*outer, arm, "r").agg(
        F.count(F.lit(1)).alias("_n"), F.min(domain).alias("_d1"), F.max(domain).alias("_d2"),
        (F.min_by("_e", domain) - F.max_by("_e", domain)).alias("_did"))
    two = F.col("_n") == 2
    did = by_rep.groupBy(*outer, arm).agg(
        F.min(F.when(two, F.col("_d1"))).alias("domain_a"), F.max(F.when(two, F.col("_d2"))).alias("domain_b"),
        rnd(F.avg(F.when(two, F.col("_did")))).alias("did_mean"),
        rnd(F.percentile(F.when(two, F.col("_did")), 0.025)).alias("ci_lo"),
        rnd(F.percentile(F.when(two, F.col("_did")), 0.975)).alias("ci_hi"))
    wanted = cur.select(*outer, arm).distinct()
    return join_on(wanted, did, outer + [arm], "left")


# ------------------------------------------------------------- poisson mode
def _cell_key(seed: int, parts) -> list[int]:
    h = hashlib.blake2b(("|".join(repr(p) for p in (seed, *parts))).encode(), digest_size=16).digest()
    return [int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")]


def _draws(seed: int, cell, m: float, n_boot: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=_cell_key(seed, list(cell)))).poisson(float(m), size=n_boot)


def replicate_sums(cells: DataFrame, keys: list[str], cell_cols: list[str], n_boot: int, seed: int,
                   sums: Callable[[dict[str, np.ndarray]], np.ndarray], names: list[str]) -> DataFrame:
    """Per group and replicate r in [0, n_boot): the weighted sums ``names``.

    ``cells`` has one row per (keys, cell_cols) with its multiplicity ``m``;
    ``sums`` maps the cell columns of a batch to a matrix [cell, name] whose
    rows are added up with the replicate's Poisson(m) weights."""
    from docreason.session import ship_package
    ship_package(cells.sparkSession)
    ident = keys + cell_cols
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", r int, " + ", ".join(f"`{n}` double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            cols = [pa.array([v] * n_boot, t) for v, t in zip(now, types)]
            cols += [pa.array(np.arange(n_boot, dtype=np.int32)), *[pa.array(c) for c in total.T.copy()]]
            return pa.RecordBatch.from_arrays(cols, names=[*keys, "r", *names])

        types = []
        for batch in batches:
            types = [batch[k].type for k in keys]
            groups = list(zip(*(batch[k].to_pylist() for k in keys)))
            idents = list(zip(*(batch[k].to_pylist() for k in ident)))
            many = batch["m"].to_pylist()
            starts = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(groups)]):
                if groups[a] != now:
                    if now is not None:
                        yield done()
                    now, total = groups[a], np.zeros((n_boot, len(names)))
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    w = np.stack([_draws(seed, t, m, n_boot) for t, m in zip(idents[c:d], many[c:d])]).astype(float)
                    values = {k: np.array(batch[k].slice(c, d - c).to_pylist(), object) for k in cell_cols}
                    total += w.T @ sums(values)
        if now is not None:
            yield done()

    # Spread the cells over the tasks, each group's cells together within one.
    n_parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select(*ident, "m").repartition(n_parts, *ident).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema).groupBy(*keys, "r").agg(*[F.sum(n).alias(n) for n in names])


def rank_places(cells: DataFrame, keys: list[str], col: str, size: int) -> DataFrame:
    """keys, ``col``, ``_place``: the number of each distinct value's range in
    its group.

    A value weighs its share of the rows plus its share of the distinct values,
    and the running weight is cut at every 1/size. A value across a cut is a
    range of its own, the values between two cuts are one: such a range holds
    less than 1/size of the rows, and with at most ``size`` distinct values each
    value is across a cut. There are at most 4 * size ranges. Weights are
    integers (times rows and distinct values), so that the ranges are the same
    at any partitioning."""
    distinct = cells.groupBy(*keys, col).agg(F.sum("m").alias("_m"))
    sizes = distinct.groupBy(*keys).agg(F.sum("_m").alias("_n"), F.count(F.lit(1)).alias("_d"))
    whole = "decimal(19,0)"
    weighed = join_on(distinct, sizes, keys).select(
        *keys, col, (F.col("_m").cast(whole) * F.col("_d").cast(whole) + F.col("_n")).cast("decimal(28,0)").alias("_w"),
        (F.col("_n").cast("double") * F.col("_d")).alias("_unit"))

    def cut(at):
        return F.floor(at.cast("double") / F.col("_unit") * size)

    first, last = cut(F.col("below")), cut(F.col("below") + F.col("_w"))
    placed = running_below(weighed, keys, col, "_w").select(
        *keys, col, (2 * first + F.when(last > first, 1).otherwise(0)).alias("_range"))
    ranges = placed.groupBy(*keys).agg(F.array_sort(F.collect_set("_range")).alias("_ranges"))
    return join_on(placed, ranges, keys).select(
        *keys, col, (F.array_position("_ranges", F.col("_range")) - 1).cast("int").alias("_place"))


def rank_grid(cells: DataFrame, keys: list[str], cols: list[str], size: int) -> DataFrame:
    """The cells with each of ``cols`` replaced by the number of its range."""
    # Written once: the places of every score read the cells several times.
    cells = out = materialize(cells, "rank-cells")
    for c in cols:
        places = materialize(rank_places(cells, keys, c, size), "rank-places")
        out = join_on(out, places, keys + [c], "left").drop(c).withColumnRenamed("_place", c)
    return out


def spearman_replicates(cells: DataFrame, keys: list[str], x: str, y: str, n_boot: int, seed: int,
                        grid: int = 0, block: int = 0) -> DataFrame:
    """Per group and replicate: Spearman correlation of the weighted cells on
    the rank grid. Returns keys, r, spearman."""
    from docreason.session import ship_package
    ship_package(cells.sparkSession)
    grid, block = grid or RANK_GRID, block or RANK_BLOCK
    placed = rank_grid(cells, keys, [x, y], grid)
    on_grid = placed.groupBy(*keys, x, y).agg(F.sum("m").alias("m"))
    blocks = on_grid.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // block))))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(x, "ascending"), (y, "ascending")])
        at = int(table["_block"][0].as_py()) * block
        n = min(block, n_boot - at)
        group = [table[k][0].as_py() for k in keys]
        gx, gy = table[x].to_numpy(), table[y].to_numpy()
        w = np.empty((len(gx), n))
        for i, (a, b, m) in enumerate(zip(gx, gy, table["m"].to_pylist())):
            w[i] = _draws(seed, (*group, int(a), int(b)), m, n_boot)[at: at + n]

        def ranks(g: np.ndarray, w: np.ndarray) -> np.ndarray:
            at_value = np.zeros((int(g.max()) + 1, w.shape[1]))
            np.add.at(at_value, g, w)
            below = np.cumsum(at_value, axis=0) - at_value
            return (below + (at_value + 1) / 2)[g]

        def correlation(w: np.ndarray) -> np.ndarray:
            rx, ry, total = ranks(gx, w), ranks(gy, w), w.sum(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                mx, my = (w * rx).sum(axis=0) / total, (w * ry).sum(axis=0) / total
                vx, vy = (w * (rx - mx) ** 2).sum(axis=0), (w * (ry - my) ** 2).sum(axis=0)
                rho = (w * (rx - mx) * (ry - my)).sum(axis=0) / np.sqrt(vx * vy)
            return np.where((total >= 2) & (vx > 0) & (vy > 0), rho, np.nan)

        rho = np.concatenate([correlation(w[:, i:i + RANK_STEP]) for i in range(0, n, RANK_STEP)])
        cols = {k: pa.array([v] * n, table.schema.field(k).type) for k, v in zip(keys, group)}
        return pa.table(cols | {"r": np.arange(at, at + n, dtype=np.int32), "spearman": pa.array(rho, from_pandas=True)})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", r int, spearman double"
    return blocks.groupBy(*keys, "_block").applyInArrow(run, schema)


def _fmt(mid, lo, hi):
    return F.format_string("%.3f [%.3f, %.3f]", mid, lo, hi)


def _metric_sums(edges: list[float]):
    """Matrix of the sums that A15's metrics are made of, over cells of gold
    and pred: totals, errors, moments, then weights and golds by bin."""
    def sums(values: dict[str, np.ndarray]) -> np.ndarray:
        g, p = values["gold"].astype(float), values["pred"].astype(float)
        err = p - g

        def anchor(v: np.ndarray) -> np.ndarray:
            return np.where(v <= 0.25, 0.0, np.where(v <= 0.75, 0.5, 1.0))

        inside = np.searchsorted(np.array(edges), p, side="right")[:, None] == np.arange(1, len(edges))
        return np.column_stack([np.ones(len(g)), np.abs(err), err * err, anchor(g) == anchor(p), g, p, g * g, p * p, g * p,
                                inside, inside * g[:, None]]).astype(float)
    names = ["w", "ae", "se", "tri", "g", "p", "gg", "pp", "gp"]
    n = len(edges) - 1
    return sums, names + [f"wb{i}" for i in range(n)] + [f"gb{i}" for i in range(n)]


def bootstrap_metrics(cl: DataFrame, keys: list[str], n_boot: int = N_BOOT,
                      seed: int = SEED_PER_DOMAIN, n_bins: int = N_CAL_BINS) -> DataFrame:
    """Replicates of MAE, RMSE, Brier, Pearson, Spearman, ECE and
    three-class accuracy, each reported as "median [lo, hi]", and ``n_usable``,
    the replicates with any weight; plus the trace-similarity mean interval
    (A12, its own draw) and median. Spearman has a draw of its own, on its
    rank grid; the other six metrics share one."""
    cells = cl.groupBy(*keys, "gold", "pred").agg(F.count(F.lit(1)).alias("m"))
    rk = keys + ["r"]
    edges = linspace(0.0, 1.0, n_bins + 1)
    sums, names = _metric_sums(edges)
    s = replicate_sums(cells, keys, ["gold", "pred"], n_boot, seed, sums, names)
    w = F.when(F.col("w") > 0, F.col("w"))
    vx, vy = F.col("gg") - F.col("g") * F.col("g") / w, F.col("pp") - F.col("p") * F.col("p") / w
    ok = (w >= 2) & (vx > 1e-12 * F.col("gg")) & (vy > 1e-12 * F.col("pp"))
    gaps, filled = [], []
    for i in range(n_bins):
        wb, gb = F.col(f"wb{i}"), F.col(f"gb{i}")
        filled.append(wb)
        gaps.append(F.when(wb > 0, wb * F.abs(gb / wb - (edges[i] + edges[i + 1]) / 2.0)).otherwise(0.0))
    total = sum(filled[1:], filled[0])
    reps = s.select(
        *rk, w.alias("w"), (F.col("ae") / w).alias("mae"), (F.col("se") / w).alias("brier"),
        F.sqrt(F.col("se") / w).alias("rmse"), (F.col("tri") / w).alias("tri_acc"),
        F.when(ok, (F.col("gp") - F.col("g") * F.col("p") / w) / F.sqrt(vx * vy)).alias("pearson"),
        F.when(total > 0, sum(gaps[1:], gaps[0]) / total).alias("ece"))
    names = ["mae", "rmse", "brier", "pearson", "ece", "tri_acc"]
    q = reps.groupBy(*keys).agg(F.count("w").alias("n_usable"),
                                *[F.percentile(c, [0.025, 0.5, 0.975]).alias(c) for c in names])
    sp = (spearman_replicates(cells, keys, "gold", "pred", n_boot, seed + 2)
          .groupBy(*keys).agg(F.percentile("spearman", [0.025, 0.5, 0.975]).alias("spearman")))
    n = cells.groupBy(*keys).agg(F.sum("m").alias("n"))
    out = join_on(join_on(n, q, keys), sp, keys, "left")
    order = ["mae", "rmse", "brier", "pearson", "spearman", "ece", "tri_acc"]
    out = out.select(*keys, "n", "n_usable", *[_fmt(F.col(c)[1], F.col(c)[0], F.col(c)[2]).alias(c) for c in order])
    # Trace similarity: mean interval from its own cells and draw, exact median.
    means = replicate_means_poisson(cl, keys, "trace_sim", n_boot, seed + 1)
    tq = means.groupBy(*keys).agg(F.percentile("rep_mean", [0.025, 0.5, 0.975]).alias("tq"))
    tmed = exact_quantile(cl, keys, "trace_sim", 0.5, "trace_median")
    return (join_on(join_on(out, tq, keys, "left"), tmed, keys, "left")
            .withColumn("trace_mean_ci", _fmt(F.col("tq")[1], F.col("tq")[0], F.col("tq")[2]))
            .drop("tq").withColumn("trace_median", rnd("trace_median")))


def mean_ci_poisson(values: DataFrame, keys: list[str], value: str, n_boot: int = N_BOOT,
                    seed: int = 42) -> DataFrame:
    """A12 at the full replicate count: Poisson-bootstrap interval of the mean
    per group, from value cells (distinct values with multiplicity). Returns
    keys, n_valid, mean, ci_lo, ci_hi (middle = sample mean)."""
    reps = replicate_means_poisson(values, keys, value, n_boot, seed)
    q = reps.groupBy(*keys).agg(F.percentile("rep_mean", [0.025, 0.975]).alias("_q"))
    obs = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg(value).alias("_mean"))
    return join_on(obs, q, keys, "left").select(
        *keys, "n_valid", rnd("_mean").alias("mean"), rnd(F.col("_q")[0]).alias("ci_lo"), rnd(F.col("_q")[1]).alias("ci_hi"))


def replicate_means_poisson(values: DataFrame, keys: list[str], value: str, n_boot: int = N_BOOT,
                            seed: int = 42) -> DataFrame:
    """Per group and replicate: Poisson-weighted mean over value cells (NULL
    if all weights are zero). Returns keys, r, rep_mean."""
    cells = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("m"))

    def sums(cols: dict[str, np.ndarray]) -> np.ndarray:
        v = cols[value].astype(float)
        return np.column_stack([np.ones(len(v)), v])

    s = replicate_sums(cells, keys, [value], n_boot, seed, sums, ["_w", "_wv"])
    return s.select(*keys, "r", F.when(F.col("_w") > 0, F.col("_wv") / F.col("_w")).alias("rep_mean"))
