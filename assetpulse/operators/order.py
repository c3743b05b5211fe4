"""Order-dependent operators without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves the whole table into one
task. Everything here instead range-partitions on the sort key, numbers rows
inside each partition, and adds per-partition offsets from a table that has
one row per partition (bounded by the partition count, so it is broadcast).

Rolling frames keyed by asset use a *halo*: the ordered rows are cut into
buckets of ``bucket_rows`` positions; the last ``w - 1`` rows of each bucket
are copied into the next one, and the window runs per (bucket[, asset]).
A hot asset holding a third of the table is therefore spread over many tasks,
and no task ever holds more than ``bucket_rows + w - 1`` rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .selection import ACCURACY, MERGED, nth, sort_number

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition id << 33 | row position


def _num_partitions(df: DataFrame, requested: int | None) -> int:
    if requested:
        return requested
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_index(df: DataFrame, order: list, index_col: str = "row_idx",
              num_partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    ``order`` must be a total order (end it with a unique key) for the index to
    be deterministic. The range-partitioned, numbered table is checkpointed to
    the shared checkpoint folder, so a lost executor cannot renumber rows
    between the count pass and the offset join.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    tagged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per non-empty partition: a bounded table, summed in one small task.
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
            .withColumn(index_col, F.col("_off") + local)
            .drop("_mid", "_pid", "_off"))


def every_nth(df: DataFrame, order: list, n: int, index_col: str = "row_idx") -> DataFrame:
    """Every n-th row by position (positions 0, n, 2n, ...)."""
    return row_index(df, order, index_col).where(F.col(index_col) % n == 0)


def first_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows in the order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(n)


def last_n(df: DataFrame, by: str, order: list[str], n: int, salts: int = 32) -> DataFrame:
    """The last ``n`` rows of each ``by`` in ``order`` (ties by the last order column).

    Rows are first cut to ``n`` for each (``by``, salt), so a hot key is spread over
    ``salts`` groups and at most ``n * salts`` of its rows meet. ``order`` must be total.
    """
    newest = [F.col(c).desc_nulls_last() for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for keys in ([by, "_salt"], [by]):
        salted = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_rank") <= n)
    return salted.drop("_salt", "_rank")


def _halo(df: DataFrame, order: list, by: str | None, w: int, bucket_rows: int):
    """Index rows in (by, order) order and attach bucket ids with a (w-1)-row halo."""
    if bucket_rows < w:
        raise ValueError("bucket_rows must be at least the frame length")
    full_order = ([by] if by else []) + list(order)
    idx = row_index(df, full_order, "_idx")
    bucket = F.floor(F.col("_idx") / F.lit(bucket_rows)).cast("long")
    own = idx.withColumn("_bucket", bucket).withColumn("_halo", F.lit(False))
    copies = (idx.where((F.col("_idx") % bucket_rows) >= bucket_rows - (w - 1))
              .withColumn("_bucket", bucket + 1).withColumn("_halo", F.lit(True)))
    return own.unionByName(copies)


def rolling(df: DataFrame, value_col: str, out_col: str, order: list, by: str | None = "asset_id",
            w: int = 30, agg=F.avg, bucket_rows: int = 1 << 16) -> DataFrame:
    """Trailing w-row aggregate (default mean), minimum one row.

    ``by=None`` runs over the whole table in ``order`` (as a single series);
    ``by='asset_id'`` restarts the frame for each asset.
    """
    both = _halo(df, order, by, w, bucket_rows)
    part = ["_bucket"] + ([by] if by else [])
    win = Window.partitionBy(*part).orderBy("_idx").rowsBetween(-(w - 1), 0)
    return (both.withColumn(out_col, agg(F.col(value_col)).over(win))
            .where(~F.col("_halo")).drop("_bucket", "_halo", "_idx"))


def preceding_list(df: DataFrame, cols: list[str], out_col: str, order: list,
                   by: str | None = "asset_id", n: int = 30, bucket_rows: int = 1 << 16) -> DataFrame:
    """For each row, the n rows before it (not itself) as an array of structs.

    Rows with fewer than n predecessors are dropped, as a sequence builder
    that starts at position n does.
    """
    both = _halo(df, order, by, n + 1, bucket_rows)
    part = ["_bucket"] + ([by] if by else [])
    win = Window.partitionBy(*part).orderBy("_idx").rowsBetween(-n, -1)
    # Counted apart from the list, so a reader of the keys alone builds no lists.
    return (both.withColumn("_cnt", F.count(F.lit(1)).over(win))
            .withColumn(out_col, F.collect_list(F.struct(*[F.col(c) for c in cols])).over(win))
            .where(~F.col("_halo") & (F.col("_cnt") == n))
            .drop("_bucket", "_halo", "_idx", "_cnt"))


def time_split(df: DataFrame, order: list, test: float = 0.2, index_col: str = "row_idx",
               total: int | None = None) -> DataFrame:
    """First floor(n * (1 - test)) rows in order are train, the rest test.

    Adds ``is_test``. ``total`` may be passed when the row count is known.
    """
    idx = row_index(df, order, index_col)
    n = total if total is not None else idx.count()
    cut = int(n * (1 - test))
    return idx.withColumn("is_test", F.col(index_col) >= F.lit(cut))


def time_cut(df: DataFrame, order: list[str], test: float = 0.2, keys_of: DataFrame | None = None) -> tuple[DataFrame, int]:
    """W4, exact and without a sort: the rows with ``is_test``, and the number of training rows.

    The first floor(n * (1 - test)) rows in ``order`` train, as in ``time_split``. The
    key of the first test row is selected column by column (``selection.nth``), and the
    flag is a comparison with that key: no row moves and nothing is written. ``order``
    must be total and hold numbers, dates or times; nulls sort first. No rows: none.
    ``keys_of`` gives the order columns of the same rows where those of ``df`` are dear to read again.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    source = df if keys_of is None else keys_of
    rows = source.select(*[sort_number(source, c).alias(k) for c, k in zip(order, keys, strict=True)])
    n = rows.count()
    cut = int(n * (1 - test))
    if cut >= n:
        return df.withColumn("is_test", F.lit(False)), n
    rank, left, bound = cut, n, []
    for k in keys:
        value, below, left = nth(rows, k, rank, left)
        rank -= below
        bound.append(value)
        rows = rows.where(F.col(k).eqNullSafe(F.lit(value)))
    flag = F.lit(True)
    for c, value in reversed(list(zip(order, bound, strict=True))):
        key = sort_number(df, c)
        after = key.isNotNull() if value is None else F.coalesce(key > F.lit(value), F.lit(False))
        flag = after | (key.eqNullSafe(F.lit(value)) & flag)
    return df.withColumn("is_test", flag), cut


def time_split_approx(df: DataFrame, time_col: str = "event_time", test: float = 0.2,
                      accuracy: int = 1_000_000) -> DataFrame:
    """W4 without a sort: rows at or after the (1 - test) quantile of the time
    column are test. One ``percentile_approx`` pass (rank error 1/accuracy);
    use it when the exact row count of the split does not matter."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    cut = df.agg(F.percentile_approx(micros, F.lit(1.0 - test), F.lit(accuracy))).first()[0]
    return df.withColumn("is_test", micros >= F.lit(cut))


def hash_unit(key: Column, salt: str = "split") -> Column:
    """A uniform number in [0, 1) from a key, identical across engines (md5 based)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2,
                     salt: str = "split") -> DataFrame:
    """Per class, a row is test when its hashed key ranks among the first
    round(test * class size) rows of the class (exact share per class). Rows
    without a label are a class of their own.

    Ranks come from the global row index over (label, hash, key) minus the
    class's first index, so a class holding a third of the table is still
    spread over many tasks (no window partitioned by class).
    """
    u = hash_unit(F.col(key), salt)
    idx = row_index(df.withColumn("_u", u), [label, "_u", key], "_gidx")
    first = idx.groupBy(label).agg(F.min("_gidx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per class (a label column is categorical): broadcast, so a hot
    # class is never gathered by a shuffle join on the class key.
    return (idx.join(F.broadcast(first.withColumnRenamed(label, "_class")), F.col(label).eqNullSafe(F.col("_class")))
            .withColumn("is_test", (F.col("_gidx") - F.col("_first")) < F.round(F.col("_n") * F.lit(test)))
            .drop("_u", "_gidx", "_first", "_n", "_class"))


def stratified_cut(df: DataFrame, label: str, key: str, test: float = 0.2, salt: str = "split") -> DataFrame:
    """W5, exact and without a sort: per class the first round(test * class size) rows by (hashed key, key) are test.

    The same rows as ``stratified_split`` picks. Every class's last test hash is bracketed
    by a grouped sketch, counted, and narrowed until few rows are left in all brackets
    together; those alone come to the driver (with one row a class: a label is
    categorical). ``key`` must be unique, a row without one trains; rows without a label
    are a class of their own.
    """
    u = hash_unit(F.col(key), salt)
    rows = df.select(F.col(label).alias("_class"), u.alias("_u"), F.col(key).alias("_key")).persist()
    spark = df.sparkSession
    kind = rows.schema["_class"].dataType.simpleString()
    sizes = {r[0]: r[1] for r in rows.groupBy("_class").count().collect()}
    if not sizes:
        rows.unpersist()
        return df.withColumn("is_test", F.lit(False))
    wanted = dict(spark.createDataFrame(list(sizes.items()), f"c {kind}, n long")
                  .select("c", F.round(F.col("n") * F.lit(test)).cast("long")).collect())
    bracket = {c: (0.0, 1.0, 0, n) for c, n in sizes.items()}  # from, to (included), rows before, rows inside

    def bracketed() -> DataFrame:
        ends = spark.createDataFrame([(c, b[0], b[1]) for c, b in bracket.items()], f"_c {kind}, _lo double, _hi double")
        return rows.join(F.broadcast(ends), F.col("_class").eqNullSafe(F.col("_c")))  # one row a class

    def inside() -> DataFrame:
        return bracketed().where((F.col("_u") >= F.col("_lo")) & (F.col("_u") <= F.col("_hi")))

    while sum(b[3] for b in bracket.values()) > MERGED:
        before, error = dict(bracket), 2 / ACCURACY
        grid = [i * error for i in range(int(1 / error) + 1)]
        for c, points in inside().groupBy("_class").agg(F.percentile_approx("_u", F.array(*map(F.lit, grid)), F.lit(ACCURACY))).collect():
            lo, hi, below, n = bracket[c]
            share = (wanted[c] - below) / max(1, n)
            at = min(int(share / error), len(grid) - 1)
            bracket[c] = (points[max(0, at - 1)] if at > 1 else lo, points[min(len(grid) - 1, at + 2)] if at + 2 < len(grid) else hi, below, n)
        for c, below, n in bracketed().groupBy("_class").agg(
                F.count_if(F.col("_u") < F.col("_lo")), F.count_if((F.col("_u") >= F.col("_lo")) & (F.col("_u") <= F.col("_hi")))).collect():
            bracket[c] = (*bracket[c][:2], below, n)
            if not below <= wanted[c] <= below + n:  # the sketch missed: keep the wider bracket
                bracket[c] = before[c]
        if bracket == before:  # a hash that many rows share: they differ by key alone
            break
    seen, last = {c: b[2] for c, b in bracket.items()}, {}
    for c, h, k in inside().select("_class", "_u", "_key").orderBy("_u", "_key").collect():  # at most MERGED rows
        seen[c] += 1
        if seen[c] <= wanted[c]:
            last[c] = (h, k)
    rows.unpersist()
    key_kind = rows.schema["_key"].dataType.simpleString()
    # A class whose bracket begins right after its last test row: all rows before the bracket are test.
    ends = [(c, *last.get(c, (bracket[c][0], None))) for c in sizes]
    table = spark.createDataFrame(ends, f"_class {kind}, _h double, _k {key_kind}")
    hit = (u < F.col("_h")) | ((u == F.col("_h")) & F.coalesce(F.col(key) <= F.col("_k"), F.lit(False)))
    return (df.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_class")))
            .withColumn("is_test", F.coalesce(hit, F.lit(False))).drop("_class", "_h", "_k"))


def stratified_split_approx(df: DataFrame, key: str, test: float = 0.2, salt: str = "split") -> DataFrame:
    """W5 at scale: test when the hashed key falls under ``test`` (no shuffle)."""
    return df.withColumn("is_test", hash_unit(F.col(key), salt) < F.lit(test))


def preceding_stats(df: DataFrame, cols: list[str], order: list, by: str | None = "asset_id",
                    n: int = 30, bucket_rows: int = 1 << 16) -> DataFrame:
    """W2 summarised: for each row with n predecessors (same asset), the mean,
    sample deviation, min, max, last value and least-squares slope of each
    column over those n rows — native window aggregates over the halo frame
    (codegen, no arrays). The slope uses sums over the frame:
    sum((i - mid) * (x - mean)) = sum(j * x) - (r - n) * sum(x) - mid * sum(x),
    with j the row's position in its bucket (contiguous per asset).
    """
    both = _halo(df, order, by, n + 1, bucket_rows)
    part = ["_bucket"] + ([by] if by else [])
    frame = Window.partitionBy(*part).orderBy("_idx").rowsBetween(-n, -1)
    prev = Window.partitionBy(*part).orderBy("_idx")
    mid = (n - 1) / 2.0
    denom = sum((i - mid) ** 2 for i in range(n))
    out = both.withColumn("_cnt", F.count(F.lit(1)).over(frame))
    # Counted from the bucket's start: small numbers, so that the sums do not cancel.
    idx = (F.col("_idx") - F.col("_bucket") * F.lit(bucket_rows)).cast("double")
    exprs = {}
    for c in cols:
        x = F.col(c).cast("double")
        s1 = F.sum(x).over(frame)
        sjx = F.sum(idx * x).over(frame)
        exprs[f"{c}_mean"] = s1 / F.lit(float(n))
        exprs[f"{c}_sd"] = F.stddev_samp(x).over(frame)
        exprs[f"{c}_min"] = F.min(x).over(frame)
        exprs[f"{c}_max"] = F.max(x).over(frame)
        exprs[f"{c}_last"] = F.lag(x, 1).over(prev)
        exprs[f"{c}_slope"] = (sjx - (idx - F.lit(float(n))) * s1 - F.lit(mid) * s1) / F.lit(denom)
    return (out.withColumns(exprs).where(~F.col("_halo") & (F.col("_cnt") == n))
            .drop("_bucket", "_halo", "_idx", "_cnt"))
