"""Message layouts and batch fan-in over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanweave.functions import encode_vectors
from fanweave.operators.fanin import (
    completed_ids,
    completeness,
    fan_in,
    stack_columns,
    strict_check,
    within_ttl,
)
from fanweave.operators.forward import route
from fanweave.operators.parsing import bad_rows, lookup_values, parse_messages, tag_messages
from fanweave.operators.rows import chunk, global_id, with_row_id
from fanweave.plans import query
from fanweave.plans.tables import (
    ARRIVAL,
    CELLS_SQL,
    MESSAGES_SQL,
    SLOTS,
    TTL_MICROS,
    event_of,
    exploded,
    images,
    messages,
    table,
)
from fanweave.sinks import pending

N = len(SLOTS)
CHUNK = 50


def _text(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def _as_text(df: DataFrame, value: Column, key: Column | None = None) -> DataFrame:
    """The event id with a message as text."""
    return df.select(
        "event_id", (key if key is not None else F.col("id")).cast("string").alias("key"),
        value.alias("value"),
    )


# --- parsing ---------------------------------------------------------------------------------


@query(
    "parse_messages",
    f"""WITH {MESSAGES_SQL}
    SELECT layout, event_id, id AS image_id, number, number_value
    FROM (SELECT event_id, id, layout,
                 CASE layout WHEN 'P8' THEN {CHUNK} ELSE slot END AS number,
                 CASE WHEN layout IN ('P1', 'P2', 'P3') THEN value END AS number_value
          FROM m, (VALUES ('P1'), ('P2'), ('P3'), ('P7'), ('P8'), ('P10')) AS l(layout))""",
)
def q_parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = messages(spark, sf_dir)
    id, slot, value = F.col("id"), F.col("slot"), F.col("value")
    layer = F.concat(F.lit("layer_"), slot)
    texts = {
        "P1": (_text(slot, value), "slot", "value"),
        "P2": (_text(slot, id, value), "slot", "value"),
        "P3": (_text(id, slot, value), "slot", "value"),
        "P7": (_text(layer, id), "layer", None),
        "P8": (_text(layer, id, F.lit(CHUNK), F.lit(N)), "batch_size", None),
        "P10": (_text(id, slot), "prediction", None),
    }
    result = None
    for layout, (text, number, real) in texts.items():
        good, _ = parse_messages(_as_text(df, text), layout, n=N)
        image = "batch_id" if layout == "P8" else "image_id"
        rows = good.select(
            F.lit(layout).alias("layout"), "event_id", F.col(image).alias("image_id"),
            F.col(number).alias("number"),
            (F.col(real) if real else F.lit(None).cast("double")).alias("number_value"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result


@query(
    "parse_json_messages",
    f"""WITH {MESSAGES_SQL}
    SELECT layout, event_id, id AS image_id, slot, value
    FROM m, (VALUES ('P4'), ('P5')) AS l(layout)""",
)
def q_parse_json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 carries the value; a P5 notice finds it in the table of outputs."""
    df = messages(spark, sf_dir)
    names = [F.col("slot").alias("neuron_id"), F.col("event_id").alias("image_id")]
    whole = F.to_json(F.struct(*names, F.col("value").alias("output")))
    p4, _ = parse_messages(_as_text(df, whole), "P4", n=N)
    notices, _ = parse_messages(_as_text(df, F.to_json(F.struct(*names))), "P5", n=N)
    outputs = df.select(F.col("event_id").alias("image_id"), "slot", "value")
    p5 = lookup_values(notices, outputs)
    columns = ["layout", "event_id", "slot", "value"]
    both = p4.withColumn("layout", F.lit("P4")).select(columns).unionByName(
        p5.withColumn("layout", F.lit("P5")).select(columns)
    )
    return both.join(df.select("event_id", F.col("id").alias("image_id")), "event_id")


@query(
    "parse_vector_messages",
    f"""WITH {CELLS_SQL},
    three AS (SELECT image_id, slot, x FROM cells)
    SELECT 'P4' AS layout, image_id, slot, x AS value FROM three WHERE slot = 0
    UNION ALL SELECT 'P6', image_id, slot, x FROM three
    UNION ALL SELECT 'P9', image_id, slot, x FROM three""",
)
def q_parse_vector_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex numbers and base64 vectors inside messages come out unchanged."""
    df = images(spark, sf_dir).withColumn("event_id", F.col("image_id"))
    vectors = encode_vectors(df, "base64").withColumn("id", F.col("image_id"))
    image, blob = F.col("image_id"), F.col("blob")
    one = encode_vectors(
        df.withColumn("features", F.slice("features", 1, 1)), "hex"
    ).withColumn("id", F.col("image_id"))
    number = F.to_json(
        F.struct(F.lit(0).alias("neuron_id"), "image_id", F.col("blob").alias("output"))
    )
    p4, _ = parse_messages(_as_text(one, number), "P4", n=1, encoding="hex")
    p6, _ = parse_messages(
        _as_text(vectors, _text(F.lit(0), image, F.lit(1), F.lit(64), blob)), "P6_VECTOR"
    )
    p9, _ = parse_messages(_as_text(vectors, _text(F.lit("layer_0"), image, blob)), "P9")
    rows = p4.select(F.lit("P4").alias("layout"), "image_id", "slot", "value")
    for layout, good, id in (("P6", p6, "batch_id"), ("P9", p9, "image_id")):
        rows = rows.unionByName(
            exploded(
                good.select(
                    F.lit(layout).alias("layout"), F.col(id).alias("image_id"), "vector"
                ),
                "layout", "image_id", vector="vector",
            )
        )
    return rows


@query(
    "parse_hex_values",
    f"WITH {CELLS_SQL} SELECT image_id, slot, x AS value FROM cells",
)
def q_parse_hex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every vector as a hex number in a message of its own."""
    one = images(spark, sf_dir).select(
        F.col("image_id").alias("event_id"), F.col("image_id").alias("id"),
        F.posexplode("features").alias("slot", "x"),
    ).withColumn("features", F.array("x"))
    number = F.to_json(F.struct(
        F.col("slot").alias("neuron_id"), F.col("id").alias("image_id"), F.col("blob").alias(
            "output")))
    good, _ = parse_messages(_as_text(encode_vectors(one, "hex"), number), "P4", n=64, encoding="hex")
    return good.select("image_id", "slot", "value")


@query(
    "parse_batch_messages",
    f"""WITH {MESSAGES_SQL}
    SELECT layout, event_id, slot AS number, id,
           CASE WHEN layout <> 'P7_JSON' THEN CAST({CHUNK} + id % 7 AS INTEGER) END AS batch_size,
           CASE WHEN layout = 'P8' THEN CAST({N} + slot AS INTEGER) END AS columns
    FROM m, (VALUES ('P6'), ('P7_JSON'), ('P8')) AS l(layout)""",
)
def q_parse_batch_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the messages that announce a batch, with sizes that differ."""
    df = messages(spark, sf_dir)
    id, slot = F.col("id"), F.col("slot")
    size = (F.lit(CHUNK) + id % 7).cast("int")
    none = F.lit(None).cast("int")
    layer = F.concat(F.lit("layer-"), slot)
    p6, _ = parse_messages(_as_text(df, _text(slot, id, size)), "P6", n=N)
    p8, _ = parse_messages(_as_text(df, _text(layer, id, size, F.lit(N) + slot)), "P8")
    note = F.to_json(F.struct(layer.alias("layer"), id.alias("image_id")))
    p7, _ = parse_messages(_as_text(df, note), "P7_JSON")

    def rows(good: DataFrame, layout: str, number: str, id: str, *rest: Column) -> DataFrame:
        return good.select(
            F.lit(layout).alias("layout"), "event_id", F.col(number).alias("number"),
            F.col(id).alias("id"), *(c.alias(n) for c, n in zip(rest, ("batch_size", "columns"))))

    return (
        rows(p6, "P6", "slot", "batch_id", F.col("batch_size"), none)
        .unionByName(rows(p7, "P7_JSON", "layer", "image_id", none, none))
        .unionByName(rows(p8, "P8", "layer", "batch_id", F.col("batch_size"), F.col("columns")))
    )


@query("route_layer",
       f"WITH {MESSAGES_SQL} SELECT event_id, slot AS layer, id AS image_id FROM m WHERE slot = 2")
def q_route_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = messages(spark, sf_dir)
    good, _ = parse_messages(_as_text(df, _text(F.col("slot"), F.col("id"))), "P7")
    return route(good, 2).select("event_id", "layer", "image_id")


def broken_messages(df: DataFrame) -> DataFrame:
    """Partial outputs with the faults real senders make, chosen by content."""
    slot, value, whole = F.col("slot"), F.col("value"), F.floor("value") % 10
    text = (
        F.when(whole == 1, slot.cast("string"))
        .when(whole == 2, _text(slot, F.lit("x")))
        .when(whole == 3, _text(slot + N, value))
        .when(whole == 4, _text(F.lit("n"), value))
        .otherwise(_text(slot, value))
    )
    key = F.when(whole == 5, F.lit("?")).otherwise(F.col("id").cast("string"))
    return _as_text(df, text, key)


DEAD_LETTERS_SQL = f"""WITH {MESSAGES_SQL}
SELECT event_id, CASE CAST(floor(value) AS BIGINT) % 10 WHEN 1 THEN 'missing field'
       WHEN 2 THEN 'bad value' WHEN 3 THEN 'slot out of range' WHEN 4 THEN 'bad slot'
       ELSE 'bad image_id' END AS reason
FROM m WHERE CAST(floor(value) AS BIGINT) % 10 BETWEEN 1 AND 5"""


@query("dead_letters", DEAD_LETTERS_SQL)
def q_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_messages(broken_messages(messages(spark, sf_dir)), "P1", n=N)
    return bad_rows(tagged, ["event_id"]).select("event_id", "reason")


# --- fan-in ----------------------------------------------------------------------------------

FIRST_SQL = """
firsts AS (
  SELECT id, slot, arg_min(value, seq) AS value, min(seq) AS seq FROM m GROUP BY id, slot
),
done AS (
  SELECT id, max(seq) AS done FROM firsts GROUP BY id HAVING count(*) = 5
)"""


def _slots(result: DataFrame) -> DataFrame:
    rows = result.select(
        "id", "cycle", event_of("completed_seq").alias("completed_event"),
        F.posexplode("vector").alias("slot", "value"),
    )
    return rows


@query(
    "fan_in_first",
    f"""WITH {MESSAGES_SQL}, {FIRST_SQL}
    SELECT f.id, f.slot, f.value, e.event_id AS completed_event
    FROM firsts f JOIN done d ON f.id = d.id JOIN m e ON e.id = d.id AND e.seq = d.done""",
)
def q_fan_in_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fan_in(messages(spark, sf_dir), "id", "slot", "value", ARRIVAL, N)
    return _slots(done).drop("cycle")


LAST_SQL = f"""WITH {MESSAGES_SQL}, {FIRST_SQL}
SELECT m.id, m.slot, arg_max(m.value, m.seq) AS value,
       any_value(e.event_id) AS completed_event
FROM m JOIN done d ON m.id = d.id AND m.seq <= d.done
JOIN m e ON e.id = d.id AND e.seq = d.done
GROUP BY m.id, m.slot"""


@query("fan_in_last", LAST_SQL)
def q_fan_in_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fan_in(messages(spark, sf_dir), "id", "slot", "value", ARRIVAL, N, dup="last")
    return _slots(done).drop("cycle")


CYCLES_SQL = f"""WITH RECURSIVE {MESSAGES_SQL},
ends AS (
  SELECT id, seq, CASE WHEN count(next) = {N} THEN max(next) END AS done
  FROM (SELECT id, seq, k,
               min(CASE WHEN slot = k THEN seq END)
                 OVER (PARTITION BY id, k ORDER BY seq
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next
        FROM m, range({N}) AS s(k))
  GROUP BY id, seq
),
cycles AS (
  SELECT id, CAST(0 AS BIGINT) AS cycle, seq AS start, done FROM ends
  WHERE seq = 1 AND done IS NOT NULL
  UNION ALL
  SELECT e.id, c.cycle + 1, e.seq, e.done FROM cycles c
  JOIN ends e ON e.id = c.id AND e.seq = c.done + 1 WHERE e.done IS NOT NULL
)
SELECT c.id, c.cycle, any_value(d.event_id) AS completed_event, m.slot,
       PICK(m.value, m.seq) AS value
FROM cycles c JOIN m ON m.id = c.id AND m.seq BETWEEN c.start AND c.done
JOIN m d ON d.id = c.id AND d.seq = c.done
GROUP BY c.id, c.cycle, m.slot"""


@query("fan_in_cycles", CYCLES_SQL.replace("PICK", "arg_min"))
def q_fan_in_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every completion by distinct slots, the first write of a slot counting."""
    df = messages(spark, sf_dir)
    return _slots(fan_in(df, "id", "slot", "value", ARRIVAL, N, cycles="all"))


@query("fan_in_cycles_last", CYCLES_SQL.replace("PICK", "arg_max"))
def q_fan_in_cycles_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = messages(spark, sf_dir)
    return _slots(fan_in(df, "id", "slot", "value", ARRIVAL, N, dup="last", cycles="all"))


ARRIVALS_SQL = f"""
filled AS (
  SELECT id, event_id, seq, k AS slot,
         last_value(CASE WHEN slot = k THEN value END IGNORE NULLS)
           OVER (PARTITION BY id, k ORDER BY seq) AS value
  FROM m, range({N}) AS s(k)
),
cycles AS (
  SELECT id, CAST(seq // {N} - 1 AS BIGINT) AS cycle, event_id AS completed_event,
         CAST(slot AS INTEGER) AS slot, value
  FROM filled WHERE seq % {N} = 0
)"""


@query(
    "fan_in_arrivals",
    f"WITH {MESSAGES_SQL}, {ARRIVALS_SQL} "
    "SELECT id, cycle, completed_event, slot, value FROM cycles",
)
def q_fan_in_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cycle of n arrivals; a slot never written is null."""
    return _slots(
        fan_in(messages(spark, sf_dir), "id", "slot", "value", ARRIVAL, N, "last", "arrivals")
    )


@query(
    "fan_in_zero_fill",
    f"WITH {MESSAGES_SQL}, {ARRIVALS_SQL} "
    "SELECT id, cycle, completed_event, slot, coalesce(value, 0) AS value FROM cycles",
)
def q_fan_in_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(
        fan_in(messages(spark, sf_dir), "id", "slot", "value", ARRIVAL, N, "last", "arrivals", fill=0.0)
    )


TTL_SQL = f"""
live AS (
  SELECT * FROM (SELECT *, min(ts) OVER (PARTITION BY id) AS first_ts FROM m)
  WHERE ts < first_ts + INTERVAL 3 DAY
)"""


@query(
    "fan_in_ttl",
    f"""WITH {MESSAGES_SQL}, {TTL_SQL},
    {FIRST_SQL.replace("FROM m ", "FROM live ")}
    SELECT f.id, f.slot, f.value, e.event_id AS completed_event
    FROM firsts f JOIN done d ON f.id = d.id JOIN m e ON e.id = d.id AND e.seq = d.done""",
)
def q_fan_in_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fan_in(
        messages(spark, sf_dir), "id", "slot", "value", ARRIVAL, N, ttl=TTL_MICROS, ttl_col="at"
    )
    return _slots(done).drop("cycle")


# a day without a message ends a round
ROUND_MICROS = 24 * 3600 * 1_000_000
ROUNDS_SQL = f"""WITH {MESSAGES_SQL},
gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY id ORDER BY seq) >= INTERVAL 1 DAY
                 THEN 1 ELSE 0 END AS opens FROM m),
r AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY id ORDER BY seq) AS BIGINT) AS round FROM gaps),
firsts AS (
  SELECT id, round, slot, min(seq) AS seq, arg_min(value, seq) AS value FROM r
  GROUP BY id, round, slot),
done AS (
  SELECT id, round, max(seq) AS done FROM firsts GROUP BY id, round HAVING count(*) = {N})
SELECT f.id, f.round, f.slot, f.value, e.event_id AS completed_event
FROM firsts f JOIN done d ON f.id = d.id AND f.round = d.round
JOIN m e ON e.id = d.id AND e.seq = d.done"""


@query("fan_in_ttl_rounds", ROUNDS_SQL)
def q_fan_in_ttl_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message renews the state of its id; after a day without one it starts anew."""
    done = fan_in(
        messages(spark, sf_dir), "id", "slot", "value", ARRIVAL, N, ttl=ROUND_MICROS,
        ttl_col="at", renew=True,
    )
    return done.select(
        "id", "round", F.posexplode("vector").alias("slot", "value"),
        event_of("completed_seq").alias("completed_event"),
    )


# messages of one day are one group
GROUPED_SQL = f"""WITH RECURSIVE {MESSAGES_SQL},
days AS (SELECT *, CAST(ts AS DATE) AS day FROM m),
g AS (
  SELECT id, day, count(*) AS c, row_number() OVER (PARTITION BY id ORDER BY day) AS k
  FROM days GROUP BY id, day),
walk AS (
  SELECT id, day, k, CAST(0 AS BIGINT) AS cycle, c >= {N} AS full,
         CASE WHEN c >= {N} THEN 0 ELSE c END AS held FROM g WHERE k = 1
  UNION ALL
  SELECT g.id, g.day, g.k, w.cycle + w.full::BIGINT, w.held + g.c >= {N},
         CASE WHEN w.held + g.c >= {N} THEN 0 ELSE w.held + g.c END
  FROM walk w JOIN g ON g.id = w.id AND g.k = w.k + 1),
ends AS (
  SELECT w.id, w.cycle, w.day, arg_max(d.event_id, d.seq) AS completed_event
  FROM walk w JOIN days d ON d.id = w.id AND d.day = w.day WHERE w.full
  GROUP BY w.id, w.cycle, w.day)
SELECT e.id, e.cycle, e.completed_event, CAST(s.slot AS INTEGER) AS slot,
       (SELECT arg_max(d.value, d.seq) FROM days d
        WHERE d.id = e.id AND d.slot = s.slot AND d.day <= e.day) AS value
FROM ends e, range({N}) AS s(slot)"""


@query("fan_in_batch_arrivals", GROUPED_SQL)
def q_fan_in_batch_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals counted once a day, so a cycle can take more messages than it needs."""
    df = messages(spark, sf_dir).withColumn("day", F.expr("at div 86400000000"))
    return _slots(fan_in(
        df, "id", "slot", "value", ARRIVAL, N, "last", "batch_arrivals", group="day"))


@query(
    "fan_in_strict",
    f"""WITH {MESSAGES_SQL}, {TTL_SQL},
    entries AS (SELECT id, slot, arg_max(value, seq) AS value FROM live GROUP BY id, slot)
    SELECT id, 'expected 5 entries, got ' || count(*) AS reason
    FROM entries GROUP BY id HAVING count(*) <> 5""",
)
def q_fan_in_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left out when entries must be exactly the n slots."""
    live = within_ttl(messages(spark, sf_dir), "id", "at", TTL_MICROS)
    entries = live.groupBy("id", "slot").agg(F.max_by("value", "seq").alias("value"))
    checked = strict_check(entries, "id", "slot", "value", N)
    return checked.filter(F.col("reason").isNotNull()).select("id", "reason")


# groups of five events with faults by the group's number
ENTRIES_SQL = f"""entries AS (
  SELECT event_id // {N} AS id,
         CASE WHEN event_id % {N} <> 4 THEN event_id % {N}
              WHEN event_id // {N} % 6 = 2 THEN 9 WHEN event_id // {N} % 6 = 3 THEN 0
              WHEN event_id // {N} % 6 = 5 THEN NULL ELSE 4 END AS slot,
         CASE WHEN event_id // {N} % 6 <> 4 OR event_id % {N} <> 2 THEN value END AS value
  FROM events WHERE event_id // {N} % 6 <> 1 OR event_id % {N} <> 4),
checked AS (
  SELECT id, CASE WHEN count(*) <> {N} THEN 'expected {N} entries, got ' || count(*)
                  WHEN count(slot) < {N} THEN 'bad slot'
                  WHEN max(slot) >= {N} OR min(slot) < 0 THEN 'slot out of range'
                  WHEN count(DISTINCT slot) < {N} THEN 'repeated slot'
                  WHEN count(value) < {N} THEN 'bad value' END AS reason
  FROM entries GROUP BY id)"""


@query(
    "fan_in_strict_reasons",
    f"""WITH {ENTRIES_SQL}
    SELECT id, reason, CAST(NULL AS INTEGER) AS slot, CAST(NULL AS DOUBLE) AS value FROM checked
    WHERE reason IS NOT NULL
    UNION ALL
    SELECT c.id, c.reason, CAST(e.slot AS INTEGER), e.value
    FROM checked c JOIN entries e ON c.id = e.id WHERE c.reason IS NULL""",
)
def q_fan_in_strict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the strict assembly broken somewhere, and the vectors of the good sets."""
    events = table(spark, sf_dir, "events")
    place, group = F.col("event_id") % N, F.expr(f"event_id div {N}")
    fault = group % 6
    last = (
        F.when(fault == 2, 9).when(fault == 3, 0).when(fault == 5, F.lit(None).cast("int"))
        .otherwise(4)
    )
    entries = events.filter(~((fault == 1) & (place == 4))).select(
        group.alias("id"), F.when(place == 4, last).otherwise(place).cast("int").alias("slot"),
        F.when(~((fault == 4) & (place == 2)), F.col("value")).alias("value"),
    )
    checked = strict_check(entries, "id", "slot", "value", N)
    return checked.select(
        "id", "reason", F.posexplode_outer("vector").alias("slot", "value"))


@query(
    "fan_in_completed",
    f"WITH {MESSAGES_SQL}, {ARRIVALS_SQL} SELECT DISTINCT id, cycle FROM cycles",
)
def q_fan_in_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fan_in(messages(spark, sf_dir), "id", "slot", "value", ARRIVAL, N, "last", "arrivals")
    return completed_ids(done, "id")


@query(
    "completeness",
    f"""WITH {MESSAGES_SQL} SELECT id, count(*) AS arrivals, count(DISTINCT slot) AS slots,
    count(DISTINCT slot) = {N} AS is_complete FROM m GROUP BY id""",
)
def q_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(messages(spark, sf_dir), "id", "slot", N)


@query("fan_in_matrix",
       f"WITH {CELLS_SQL} SELECT image_id, slot, x AS value FROM cells")
def q_fan_in_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut into one column message per chunk and element, then stacked again."""
    ids = with_row_id(images(spark, sf_dir).select("image_id", "features"), ["image_id"])
    chunked = chunk(ids, CHUNK)
    cells = chunked.select("chunk_id", "pos", F.posexplode("features").alias("neuron", "x"))
    # at most CHUNK values per message
    columns = cells.groupBy("chunk_id", "neuron").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(
            "outputs"
        )
    )
    width = 64
    # beside the true reports: later ones with other values, and reports that are too long
    late = columns.select("chunk_id", "neuron", F.transform("outputs", lambda x: -x).alias(
        "outputs"), F.lit(2).alias("seq"))
    long = columns.select("chunk_id", "neuron", F.concat("outputs", F.array_repeat(
        F.lit(7.0), CHUNK)).alias("outputs"), F.lit(0).alias("seq"))
    reports = columns.withColumn("seq", F.lit(1)).unionByName(late).unionByName(long)
    matrix = stack_columns(reports, "chunk_id", "neuron", "outputs", width, CHUNK, "seq")
    rows = matrix.select(
        global_id(F.col("chunk_id"), F.col("pos"), CHUNK).alias("row_id"), "vector"
    )
    # row ids equal image ids where these are 0, 1, 2, ...; the id table says so in general
    named = rows.join(ids.select("row_id", "image_id"), "row_id")
    return exploded(named, "image_id", vector="vector")


@query(
    "pending_ids",
    f"""WITH {MESSAGES_SQL}, {TTL_SQL}, {FIRST_SQL.replace("FROM m ", "FROM live ")}
    SELECT event_id, id FROM m WHERE id NOT IN (SELECT id FROM done)""",
)
def q_pending_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ids that did not complete in time; the state of the rest is dropped."""
    df = messages(spark, sf_dir)
    finished = fan_in(df, "id", "slot", "value", ARRIVAL, N, ttl=TTL_MICROS, ttl_col="at")
    return pending(df.select("event_id", "id"), finished, "id")


@query(
    "stream_key_filter",
    f"WITH {MESSAGES_SQL} SELECT event_id, id, slot, value FROM m "
    "WHERE id = (SELECT min(user_id) FROM events)",
)
def q_stream_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer that keeps the messages of one key; here of the lowest id."""
    from fanweave.streaming.io import filter_key

    df = messages(spark, sf_dir)
    key = str(df.agg(F.min("id").alias("k")).first()["k"])
    text = _as_text(df, _text(F.col("slot"), F.col("value")))
    good, _ = parse_messages(filter_key(text, key), "P1", n=N)
    return good.select("event_id", F.col("image_id").alias("id"), "slot", "value")
