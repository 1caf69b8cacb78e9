"""Keyed fan-in: gather slot-indexed values of an id into one vector.

Input rows are ``(id, slot, value, seq)``, where ``seq`` orders the arrivals of an
id: one number column, or a time and a tie-break column. Two columns are compared as
they are in sorts, and packed into one number for aggregates. Options:

* ``dup``: the ``first`` or the ``last`` write of a slot counts.
* ``complete``: a vector is complete when its ``distinct`` slots reach ``n``, or
  when the ``arrivals`` reach ``n``, repeated slots included. With arrivals, every
  further ``n`` messages complete another cycle and older values stay in place.
  ``batch_arrivals`` counts once per ``group`` of messages, as a stream does per micro-batch, so
  a cycle can take more than ``n``; groups follow each other in ascending order.
* ``cycles``: with distinct slots, only the ``first`` completion of an id or ``all``;
  after a completion the id starts again without values.
* ``fill``: value of a slot that is missing on completion (arrivals only).
* ``ttl``: only messages less than ``ttl`` after the id's first one count. With ``renew``
  every message starts the time anew, as it renews a kept state: after ``ttl`` or more without
  a message the state is dropped, and the next message opens another round of the id.

Output rows are ``(id, cycle, completed_seq, vector)``, with ``renew`` also ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanweave.operators.cycles import distinct_cycles
from fanweave.operators.rounds import grouped_cycles, with_rounds
from fanweave.operators.skew import HOT_ROWS, attach_per_key, hot_keys, split_hot
from fanweave.session import stage

#: up to this width the slots become aggregate columns and one shuffle is enough
WIDE_SLOTS = 16
#: cycles of one hot id that are filled forward in one window
CYCLES_PER_SPAN = 100_000


def arrival_seq(micros: Column, tie: Column) -> Column:
    """Time and tie-break as one number; a negative one is an error, as it would misorder.

    A decimal keeps min_by and max_by in hash aggregates, which a struct would not.
    """
    step = F.lit("10000000000000000000").cast("decimal(20,0)")
    seq = (micros.cast("decimal(19,0)") * step + tie.cast("decimal(19,0)")).cast("decimal(38,0)")
    wrong = F.raise_error(F.lit("arrival order needs times and ties from 0 on"))
    return F.when((micros < 0) | (tie < 0), wrong.cast("decimal(38,0)")).otherwise(seq)


def micros_of(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column without time zone."""
    return F.expr(
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)"
    )


def fan_in(
    df: DataFrame, id: str, slot: str, value: str, seq: str | tuple[str, str], n: int,
    dup: str = "first", complete: str = "distinct", fill: float | None = None,
    cycles: str = "first", ttl: float | None = None, ttl_col: str | None = None,
    hot_rows: int = HOT_ROWS, group: str | None = None, renew: bool = False,
) -> DataFrame:
    """Completed vectors of every id; see the module text for the options."""
    if dup not in ("first", "last") or complete not in ("distinct", "arrivals", "batch_arrivals"):
        raise ValueError(
            "dup is 'first' or 'last', complete is 'distinct', 'arrivals' or 'batch_arrivals'")
    if (complete == "batch_arrivals") != (group is not None):
        raise ValueError("batch_arrivals needs a group, other rules have none")
    if renew and ttl is None:
        raise ValueError("renew needs a ttl")
    if cycles not in ("first", "all"):
        raise ValueError("cycles is 'first' or 'all'")
    by = [seq] if isinstance(seq, str) else list(seq)
    order = [f"_o{i}" for i in range(len(by))]
    columns = [
        F.col(c).alias(a)
        for c, a in zip([id, slot, value, *by], ["_id", "_slot", "_value", *order])
    ]
    if ttl is not None:
        columns.append(F.col(ttl_col or by[0]).alias("_at"))
    if group is not None:
        columns.append(F.col(group).alias("_group"))
    if complete == "distinct":
        df = df.filter(F.col(slot).between(0, n - 1))
    messages = df.select(*columns).filter(F.col("_id").isNotNull())
    if renew:
        rounds = with_rounds(messages, "_id", "_at", order, ttl).drop("_at")
        # one text key: rounds of an id are ids of their own
        key = F.concat_ws(":", "_round", F.col("_id").cast("string"))
        done = fan_in(
            rounds.withColumn("_key", key), "_key", "_slot", "_value",
            tuple(order) if len(order) > 1 else order[0], n, dup, complete, fill, cycles,
            hot_rows=hot_rows, group=group and "_group")
        number = F.substring_index("_key", ":", 1)
        text = F.expr("substring(_key, instr(_key, ':') + 1)")
        return done.select(
            text.cast(df.schema[id].dataType).alias(id), number.cast("bigint").alias("round"),
            "cycle", "completed_seq", "vector")
    repeated = complete == "distinct" and cycles == "all"
    needs_hot = ttl is not None or complete == "arrivals" or (dup == "last" and not repeated)
    hot = hot_keys(messages, "_id", hot_rows) if needs_hot else None
    if ttl is not None:
        messages = _live(messages, "_id", "_at", ttl, hot).drop("_at")

    if complete == "batch_arrivals":
        result = _grouped_arrivals(messages, order, n, dup, fill)
    elif complete == "arrivals":
        result = _arrivals(messages, order, n, dup, fill, hot)
    elif repeated:
        result = distinct_cycles(messages, order, n, dup)
    else:
        packed = messages.withColumn("_seq", _packed(order)).drop(*order)
        pick = _distinct_first(packed, n) if dup == "first" else _distinct_last(packed, n, hot)
        return pick.select(
            F.col("_id").alias(id), "cycle", F.col("_done").alias("completed_seq"), "vector"
        )
    return result.select(
        F.col("_id").alias(id), "cycle", _packed(order).alias("completed_seq"), "vector"
    )


def _packed(order: list[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else arrival_seq(*[F.col(c) for c in order])


def misplaced(df: DataFrame, id: str, slot: str, n: int) -> DataFrame:
    """The dead letters of a fan-in: rows without id, and slots outside ``0 .. n-1``.

    Counting arrivals, such slots count although they have no place in the vector; with
    distinct slots they do not count. A row without id never counts. The same rows in
    batches and on streams.
    """
    reason = (
        F.when(F.col(id).isNull(), "no id")
        .when(F.col(slot).isNull(), "no slot")
        .when(~F.col(slot).between(0, n - 1), "slot out of range")
    )
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def within_ttl(
    df: DataFrame, id: str, at: str, ttl: float, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Messages that arrive less than ``ttl`` after the first one of their id."""
    return _live(df, id, at, ttl, hot_keys(df, id, hot_rows))


def _live(df: DataFrame, id: str, at: str, ttl: float, hot: DataFrame | None) -> DataFrame:
    first = df.groupBy(id).agg(F.min(at).alias("_first"))
    live = attach_per_key(df, first, id, hot)
    return live.filter(F.col(at) < F.col("_first") + F.lit(ttl)).drop("_first")


def completed_ids(result: DataFrame, id: str) -> DataFrame:
    """The completion signal alone: which id is ready for the next layer."""
    return result.select(id, "cycle")


def completeness(df: DataFrame, id: str, slot: str, n: int) -> DataFrame:
    """Arrivals, distinct slots and whether all ``n`` are there, for every id.

    Slots are combined first, so a hot id shuffles one row per slot and task.
    """
    per_slot = df.groupBy(id, slot).agg(F.count(F.lit(1)).alias("c"))
    return per_slot.groupBy(id).agg(
        F.sum("c").cast("bigint").alias("arrivals"),
        F.count(slot).cast("bigint").alias("slots"),
        (F.count(F.when(F.col(slot).between(0, n - 1), 1)) == n).alias("is_complete"),
    )


def strict_check(df: DataFrame, id: str, slot: str, value: str, n: int) -> DataFrame:
    """Strict assembly of one entry set per id: ``(id, vector, reason)``.

    There must be exactly ``n`` entries, every slot must be a number below ``n``
    and used once, every value must be a number. The first rule broken is the
    reason and the vector is null.
    """
    s, v = F.col(slot), F.col(value)
    per_slot = df.groupBy(id, slot).agg(
        F.count(F.lit(1)).alias("c"), F.count(v).alias("good"), F.max(v).alias("v")
    )
    sums = per_slot.groupBy(id).agg(
        F.sum("c").alias("entries"),
        F.sum("good").alias("good"),
        F.count(F.when(s.isNull(), 1)).alias("no_slot"),
        F.count(F.when((s < 0) | (s >= n), 1)).alias("outside"),
        F.count(F.when(F.col("c") > 1, 1)).alias("repeated"),
        F.collect_list(F.when(s.between(0, n - 1), F.struct(s.alias("s"), F.col("v")))).alias(
            "pairs"
        ),
    )
    reason = (
        F.when(
            F.col("entries") != n,
            F.concat(F.lit(f"expected {n} entries, got "), F.col("entries")),
        )
        .when(F.col("no_slot") > 0, "bad slot")
        .when(F.col("outside") > 0, "slot out of range")
        .when(F.col("repeated") > 0, "repeated slot")
        .when(F.col("good") < F.col("entries"), "bad value")
    )
    vector = F.transform(F.sort_array("pairs"), lambda p: p["v"])
    return sums.withColumn("reason", reason).select(
        id, F.when(F.col("reason").isNull(), vector).alias("vector"), "reason"
    )


def stack_columns(
    df: DataFrame, chunk: str, neuron: str, vector: str, n: int, size: int, seq: str
) -> DataFrame:
    """Per-neuron batch vectors to matrix rows: ``(chunk, pos, vector)``.

    Each input row holds one neuron's outputs for all members of a chunk. A chunk
    counts when all ``n`` neurons reported; of several reports of a neuron the first by
    ``seq`` counts. A report with more than ``size`` outputs does not count; see
    :func:`oversized_reports`. Rows are assembled per member, never per chunk.
    """
    fit = df.filter(F.size(vector) <= size)
    cells = fit.select(chunk, neuron, seq, F.posexplode(vector).alias("pos", "x"))
    per_cell = cells.groupBy(chunk, "pos", neuron).agg(F.min_by("x", seq).alias("x"))
    pairs = F.collect_list(F.struct(neuron, "x"))
    return (
        per_cell.groupBy(chunk, "pos")
        .agg(F.sort_array(pairs).alias("pairs"))
        .filter(F.size("pairs") == n)
        .select(chunk, "pos", F.transform("pairs", lambda p: p["x"]).alias("vector"))
    )


def oversized_reports(df: DataFrame, vector: str, size: int) -> DataFrame:
    """The dead letters of :func:`stack_columns`: reports with more than ``size`` outputs."""
    reason = F.concat(
        F.lit("expected at most "), F.lit(size), F.lit(" outputs, got "), F.size(vector))
    return df.filter(F.size(vector) > size).withColumn("reason", reason)


# --- distinct slots --------------------------------------------------------------------------


def _per_id(messages: DataFrame, n: int, pick) -> DataFrame:
    """One row per complete id: ``_done`` and ``vector``; ``pick`` is min or max over seq.

    Every aggregate here combines in the map tasks, so an id with any number of
    messages sends at most one row per slot and task.
    """
    choose_value, choose_seq = pick
    if n <= WIDE_SLOTS:
        aggregates = []
        for k in range(n):
            here = F.col("_slot") == k
            aggregates.append(
                choose_value(F.col("_value"), F.when(here, F.col("_seq"))).alias(f"_v{k}")
            )
            aggregates.append(choose_seq(F.when(here, F.col("_seq"))).alias(f"_s{k}"))
        seqs = [F.col(f"_s{k}") for k in range(n)]
        full = seqs[0].isNotNull()
        for s in seqs[1:]:
            full = full & s.isNotNull()
        done = F.greatest(*seqs) if n > 1 else seqs[0]
        return (
            messages.groupBy("_id")
            .agg(*aggregates)
            .filter(full)
            .select(
                "_id", done.alias("_done"),
                F.array(*[F.col(f"_v{k}") for k in range(n)]).alias("vector"),
            )
        )
    per_slot = messages.groupBy("_id", "_slot").agg(
        choose_value(F.col("_value"), F.col("_seq")).alias("v"), choose_seq("_seq").alias("s")
    )
    pairs = F.sort_array(F.collect_list(F.struct("_slot", "v")))
    return (
        per_slot.groupBy("_id")
        .agg(F.max("s").alias("_done"), pairs.alias("pairs"))
        .filter(F.size("pairs") == n)
        .select("_id", "_done", F.transform("pairs", lambda p: p["v"]).alias("vector"))
    )


def _distinct_first(messages: DataFrame, n: int) -> DataFrame:
    done = _per_id(messages, n, (F.min_by, F.min))
    return done.withColumn("cycle", F.lit(0).cast("bigint"))


def _distinct_last(messages: DataFrame, n: int, hot: DataFrame | None) -> DataFrame:
    """The id completes with its last new slot; later writes do not count."""
    done = _per_id(messages, n, (F.min_by, F.min)).select("_id", F.col("_done").alias("_end"))
    live = attach_per_key(messages, done, "_id", hot).filter(F.col("_seq") <= F.col("_end"))
    return _per_id(live.drop("_end"), n, (F.max_by, F.max)).withColumn(
        "cycle", F.lit(0).cast("bigint")
    )


# --- arrival counts --------------------------------------------------------------------------


def _arrivals(
    messages: DataFrame, order: list[str], n: int, dup: str, fill: float | None,
    hot: DataFrame | None,
) -> DataFrame:
    if dup != "last":
        raise ValueError("counting arrivals overwrites slots: use dup='last'")
    by_arrival = W.partitionBy("_id").orderBy(*order)
    cold, spread = split_hot(messages, "_id", hot)
    ranked = cold.withColumn("_rank", (F.row_number().over(by_arrival) - 1).cast("bigint"))
    result = _cycles(ranked, order, n, fill, spans=False)
    if spread is not None:
        apart = _rank_spread(spread, order)
        result = result.unionByName(_cycles(apart, order, n, fill, spans=True))
    return result


def _grouped_arrivals(
    messages: DataFrame, order: list[str], n: int, dup: str, fill: float | None
) -> DataFrame:
    """Cycles of whole groups. Only sizes of groups are scanned in order; the messages are
    joined with their group's cycle, so a hot id is spread by group and by cycle."""
    if dup != "last":
        raise ValueError("counting arrivals overwrites slots: use dup='last'")
    groups = stage(grouped_cycles(messages, n), "grouped-cycles")
    rows = messages.join(groups.drop("full"), ["_id", "_group"]).withColumn("_rank", _packed(order))
    full = groups.filter("full").select("_id", "cycle")
    return _filled_cycles(rows.drop("_group"), order, n, fill, True).join(
        full, ["_id", "cycle"], "left_semi").drop("_rows")


def _rank_spread(messages: DataFrame, order: list[str]) -> DataFrame:
    """``_rank`` of every message within its id, for ids too large for one task.

    The rows are range-partitioned by id and arrival, which cuts a hot id into
    many parts, and written with their part number. A row's rank is its rank in
    the part plus the id's rows in earlier parts; the totals have one row per id
    and part.
    """
    parts = stage(
        messages.repartitionByRange("_id", *order).withColumn("_part", F.spark_partition_id()),
        "fan-in",
    )
    before = W.partitionBy("_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        parts.groupBy("_id", "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_id", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    in_part = W.partitionBy("_id", "_part").orderBy(*order)
    return (
        parts.join(totals, ["_id", "_part"])
        .withColumn("_rank", F.col("_base") + F.row_number().over(in_part) - 1)
        .drop("_part", "_base")
    )


def _cycles(
    ranked: DataFrame, order: list[str], n: int, fill: float | None, spans: bool
) -> DataFrame:
    """Vectors of all full cycles: last value per slot, older cycles showing through.

    Cycles have ``n`` messages each, so grouping by cycle spreads a hot id; with
    ``spans`` the forward fill is cut into spans too.
    """
    cycle = F.expr(f"`_rank` div {int(n)}").alias("cycle")
    rows = ranked.select("_id", cycle, "_slot", "_value", "_rank", *order)
    return _filled_cycles(rows, order, n, fill, spans).filter(F.col("_rows") == n).drop("_rows")


def _filled_cycles(
    rows: DataFrame, order: list[str], n: int, fill: float | None, spans: bool
) -> DataFrame:
    """Vectors of all cycles, full or not, with their number of messages ``_rows``."""
    per_cycle = _latest_in_cycle(rows, order, n)
    slots = [f"_v{k}" for k in range(n)]
    filled = _fill_spans(per_cycle, slots) if spans else _fill_forward(per_cycle, slots, "_id")
    cells = [F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(float(fill))) for c in slots]
    return filled.select("_id", "cycle", *order, "_rows", F.array(*cells).alias("vector"))


def _latest_in_cycle(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``_rows``, the last message's ``order`` and the last value of each slot in a cycle."""
    done = [F.max_by(c, "_rank").alias(c) for c in order]
    if n <= WIDE_SLOTS:
        latest = [
            F.max_by("_value", F.when(F.col("_slot") == k, F.col("_rank"))).alias(f"_v{k}")
            for k in range(n)
        ]
        return rows.groupBy("_id", "cycle").agg(F.count(F.lit(1)).alias("_rows"), *done, *latest)
    per_slot = rows.groupBy("_id", "cycle", "_slot").agg(
        F.count(F.lit(1)).alias("c"), *done, F.max("_rank").alias("_rank"),
        F.max_by("_value", "_rank").alias("v"),
    )
    # slots outside the vector count as arrivals, but have no place in it
    placed = F.when(F.col("_slot").between(0, n - 1), F.struct("_slot", "v"))
    by_slot = F.map_from_entries(F.collect_list(placed))
    return (
        per_slot.groupBy("_id", "cycle")
        .agg(F.sum("c").alias("_rows"), *done, by_slot.alias("m"))
        .select(
            "_id", "cycle", "_rows", *order,
            *[F.col("m")[F.lit(k)].alias(f"_v{k}") for k in range(n)],
        )
    )


def _fill_forward(per_cycle: DataFrame, slots: list[str], *group: str) -> DataFrame:
    so_far = W.partitionBy(*group).orderBy("cycle").rowsBetween(W.unboundedPreceding, 0)
    others = [c for c in per_cycle.columns if c not in slots]
    return per_cycle.select(
        *others, *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in slots]
    )


def _fill_spans(per_cycle: DataFrame, slots: list[str]) -> DataFrame:
    """Forward fill in spans of cycles, each starting from what earlier spans left."""
    spanned = per_cycle.withColumn("_span", F.expr(f"cycle div {CYCLES_PER_SPAN}"))
    last_of_span = spanned.groupBy("_id", "_span").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("cycle"))).alias(c) for c in slots]
    )
    earlier = W.partitionBy("_id").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = last_of_span.select(
        "_id", "_span",
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_before") for c in slots],
    )
    filled = _fill_forward(spanned, slots, "_id", "_span").join(carried, ["_id", "_span"])
    others = [c for c in spanned.columns if c not in slots]
    return filled.select(
        *others, *[F.coalesce(F.col(c), F.col(f"{c}_before")).alias(c) for c in slots]
    )
