"""Latency and accuracy figures."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lectern.operators import sessions
from lectern.shared import checkpointed


def percentiles(rows: DataFrame, key: str, value: str, shares: list[float], steps: int = 64) -> DataFrame:
    """key, n, p0, p1, ... (exact, between neighbouring values in proportion) of the rows' values that aren't null.

    Equal values are counted once, before the shuffle, and written. Bounds that cut these into about equal steps deal a key's distinct values
    over many tasks; which step holds a share's place follows from the steps' counts, and only those steps are sorted.
    """
    each = checkpointed(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(value).cast("double").alias("__value")).agg(F.count("*").alias("__n")))
    bounds = sorted(set(each.approxQuantile("__value", [i / steps for i in range(1, steps)], 0.25 / steps)))
    step = sum((F.when(F.col("__value") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    each = each.withColumn("__step", step)
    totals = each.groupBy("__key", "__step").agg(F.sum("__n").alias("__m"))
    by_key = Window.partitionBy("__key")
    before = F.sum("__m").over(by_key.orderBy("__step").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("__key", "__step", "__m", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__m").over(by_key).alias("n"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(shares)])
    wanted = totals.withColumn("__p", F.explode(places)).select("*", "__p.*").where((F.floor("at") < F.col("__before") + F.col("__m")) & (F.ceil("at") >= F.col("__before")))
    some = each.join(wanted.select("__key", "__step", "__before").distinct(), ["__key", "__step"])
    upto = F.sum("__n").over(Window.partitionBy("__key", "__step").orderBy("__value")) + F.col("__before")
    some = some.select("__key", "__step", "__value", (upto - F.col("__n")).alias("__from"), upto.alias("__to"))
    met = wanted.select("__key", "__step", "n", "i", "at").join(some, ["__key", "__step"])
    holds = lambda x: F.when((x >= F.col("__from")) & (x < F.col("__to")), F.col("__value"))
    ends = met.groupBy("__key", "n", "i", "at").agg(F.max(holds(F.floor("at"))).alias("lo"), F.max(holds(F.ceil("at"))).alias("hi"))
    share = F.col("at") - F.floor("at")
    ends = ends.withColumn("p", F.when(share == 0, F.col("lo")).otherwise((1 - share) * F.col("lo") + share * F.col("hi")))
    return ends.groupBy(F.col("__key").alias(key), "n").agg(*[F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"p{i}") for i in range(len(shares))])


def latency(rows: DataFrame, hop: str, ms: str) -> DataFrame:
    """hop, n, p50, p95, max_ms: exact percentiles, whatever number of rows a hop has."""
    return percentiles(rows, hop, ms, [0.5, 0.95, 1.0]).select(hop, "n", F.col("p0").alias("p50"), F.col("p1").alias("p95"), F.col("p2").alias("max_ms"))


def clock_offset(samples: DataFrame, session: str) -> DataFrame:
    """session, offset: the median over a session's samples (t0 to t3) of half of (t1 - t0) + (t2 - t3); a session without any whole sample has no row."""
    each = ((F.col("t1") - F.col("t0")) + (F.col("t2") - F.col("t3"))) / 2
    return percentiles(samples.select(session, each.alias("__offset")), session, "__offset", [0.5]).select(session, F.col("p0").alias("offset"))


def hops(pings: DataFrame, messages: DataFrame, samples: int = 5) -> DataFrame:
    """event_id, session, hop and ms of messages whose four stamps are of two clocks.

    pings: session, t (when), event_id, t0 and t3 (of the client), t1 and t2 (of the server), all in microseconds. messages: event_id, session, t_client and t_render of
    the client, t_recv and t_sent of the server. The client's offset at a message is the median over the last samples pings of its session before it is received, an as-of
    join over slices of time; messages before a session's first ping have no row. Hops: received (t_client to t_recv), answered (t_recv to t_sent), rendered (t_sent to t_render).
    """
    each = pings.withColumn("__off", ((F.col("t1") - F.col("t0")) + (F.col("t2") - F.col("t3"))) / 2)
    near = sessions.with_last(each, "session", ["t", "event_id"], "__off", samples)
    valid = near.select("session", F.col("t").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("event_id"), _middle(F.col("__last")).alias("__offset"), F.lit(None).cast("struct<t_client: long, t_recv: long, t_sent: long, t_render: long>").alias("m"))
    asked = messages.select("session", F.col("t_recv").alias("__at"), F.lit(1).alias("__kind"), F.col("event_id").cast("long").alias("event_id"), F.lit(None).cast("double").alias("__offset"), F.struct("t_client", "t_recv", "t_sent", "t_render").alias("m"))
    rows = sessions.scanned(sessions.sliced(valid.unionByName(asked), "__at"), "session", ["__at", "__kind", "event_id"], "__offset", "__valid").where("__kind = 1 and __valid is not null")
    ms = lambda x: (x / 1000.0).alias("ms")
    off = F.col("__valid")
    spans = {"received": F.col("m.t_recv") - (F.col("m.t_client") + off), "answered": (F.col("m.t_sent") - F.col("m.t_recv")).cast("double"), "rendered": F.col("m.t_render") + off - F.col("m.t_sent")}
    return rows.select("event_id", "session", F.explode(F.array(*[F.struct(F.lit(h).alias("hop"), ms(x)) for h, x in spans.items()])).alias("h")).select("event_id", "session", "h.*")


def _middle(values: Column) -> Column:
    """The median of an array of numbers."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def report(figures: dict[str, DataFrame]) -> str:
    """A Markdown report with a table for each result, all its rows: figures by mode, hop or session, and no text of any transcript."""
    out = []
    for title, df in figures.items():
        rows = df.collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def top_k(ranked: DataFrame, rank: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row: the share of mentions whose true reference has rank k or better; a null rank is a miss."""
    hit = lambda k: F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double"))
    return ranked.agg(F.count("*").alias("n"), *[hit(k).alias(f"top{k}") for k in ks])


def matched_in_time(labels: DataFrame, candidates: DataFrame, seconds: float = 5.0) -> DataFrame:
    """labels (session, ref, label_ts) with matched: whether a candidate (session, ref, ts) lies within seconds.

    The band is cut into steps of its width: a label meets its own step and the two beside it, so the join is by equality.
    """
    width = int(seconds * 1_000_000)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    step = lambda c: F.floor(at(c) / width)
    left = labels.withColumn("__step", F.explode(F.array(*[step("label_ts") + i for i in (-1, 0, 1)])))
    right = candidates.select("session", "ref", F.col("ts").alias("__ts")).withColumn("__step", step("__ts"))
    near = left.join(right, ["session", "ref", "__step"]).where(F.abs(at("label_ts") - at("__ts")) <= width).select("session", "ref", "label_ts").distinct()
    return labels.join(near.withColumn("__hit", F.lit(True)), ["session", "ref", "label_ts"], "left").select(*labels.columns, F.col("__hit").isNotNull().alias("matched"))


#: A key's rows are dealt over slices of time that are so many times as long as a match may be; a task holds so many rows of a run.
SPAN, HELD = 4096, 100_000


def _with_end(batches: Iterator) -> Iterator:
    """The batches, and None after the last."""
    yield from batches
    yield None


def one_to_one(labels: DataFrame, candidates: DataFrame, seconds: float = 5.0, span: int = SPAN, held: int = HELD) -> DataFrame:
    """side (label or candidate), session, ref, ts, id and other: a matching of labels and candidates (session, ref, ts, id), as many pairs as can be.

    A pair has one session and reference and lies within seconds; each label and each candidate is in one pair at most, the earliest first, and other is the id of
    its partner, or null. Where nothing of a session and reference happens for longer than that, no pair goes across: such runs are dealt over tasks by slices
    of time and matched there. Only those that come so near to a slice's edge that they may go on beyond it, or have more than held rows, are
    dealt again by session and reference and read in order of time; a task holds only what can still be matched then. Both inputs are
    shuffled once. Rows with nulls in session, ref or ts match nothing.
    """
    wait = int(seconds * 1_000_000)
    width = max(1, wait) * span
    kind = lambda df, side: df.select(F.lit(side).alias("side"), "session", "ref", "ts", "id")
    both = kind(labels, "label").unionByName(kind(candidates, "candidate"))
    own = both.columns
    whole = F.col("session").isNotNull() & F.col("ref").isNotNull() & F.col("ts").isNotNull()
    both = both.withColumns({"__at": F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)), "__whole": whole})
    both = both.withColumn("__slice", F.when(F.col("__whole"), F.col("__at") - F.pmod("__at", F.lit(width))).otherwise(F.xxhash64("id")))
    order = ["__at", "side", "id"]
    dealt = both.repartition("session", "ref", "__slice").sortWithinPartitions("__slice", "ref", "session", *order).withColumn("__hash", F.xxhash64("session", "ref", "__slice"))
    out = StructType([*both.select(*own).schema.fields, StructField("other", both.schema["id"].dataType)])

    def match(batches: Iterator) -> Iterator:
        """Rows with other, or with __on for those of runs that may go on elsewhere; what has ended is given at once, the last run waits for the next batch."""
        import numpy as np
        import pyarrow as pa

        rest = beyond = None  # the run that may go on in the next batch; key and time of one that has grown too long to be held
        for batch in _with_end(batches):
            if batch is not None:
                rest = pa.Table.from_batches(([] if rest is None else rest.to_batches()) + [batch])
            if rest is None or not rest.num_rows:
                continue
            table = rest.combine_chunks()
            at, of, begin, known = (table[c].to_numpy() for c in ("__at", "__hash", "__slice", "__whole"))
            label = np.asarray(table["side"].to_numpy() == "label")
            new = np.ones(len(at), bool)
            new[1:] = (of[1:] != of[:-1]) | (at[1:] - at[:-1] > wait) | ~known[1:] | ~known[:-1]
            long = beyond is not None and known[0] and of[0] == beyond[0] and at[0] - beyond[1] <= wait
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(at))
            on = known[starts] & ((at[starts] - begin[starts] < wait) | (begin[starts] + width - at[ends - 1] <= wait))
            on[0] |= long
            upto = len(at)
            if batch is not None:  # the last run may go on
                if upto - starts[-1] > held or long and len(starts) == 1:
                    on[-1], beyond = True, (of[-1], at[-1])
                else:
                    upto, starts, ends, on, beyond = starts[-1], starts[:-1], ends[:-1], on[:-1], (beyond if len(starts) == 1 else None)
            rest = table.slice(upto)
            if not upto:
                continue
            partner = np.full(upto, -1)
            size = np.where(on, 0, ends - starts)
            two = starts[size == 2]
            two = two[label[two] != label[two + 1]]
            partner[two], partner[two + 1] = two + 1, two
            for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                free = {False: deque(), True: deque()}
                for i in range(a, b):
                    others = free[not label[i]]
                    while others and at[i] - at[others[0]] > wait:
                        others.popleft()
                    if others:
                        partner[i] = others.popleft()
                        partner[partner[i]] = i
                    else:
                        free[bool(label[i])].append(i)
            done = table.slice(0, upto)
            other = done["id"].take(pa.array(partner, mask=partner < 0))
            goes = pa.array(np.repeat(on, ends - starts))
            yield from done.select(own).append_column("other", other).append_column("__on", goes).combine_chunks().to_batches()

    def across(batches: Iterator) -> Iterator:
        """The same for rows of long runs, in order of time; a row is given when it is matched or can't be any more."""
        import pyarrow as pa

        key, free, schema = None, {"label": deque(), "candidate": deque()}, None
        for batch in _with_end(batches):
            out = []
            if batch is None:
                if schema is None:
                    return
                out += [(x, None) for q in free.values() for _, x in q]
            else:
                schema = batch.schema
                for x, k, at in zip(batch.select(own).to_pylist(), batch["__hash"].to_pylist(), batch["__at"].to_pylist()):
                    if k != key:
                        out += [(y, None) for q in free.values() for _, y in q]
                        key, free = k, {"label": deque(), "candidate": deque()}
                    for q in free.values():
                        while q and at - q[0][0] > wait:
                            out.append((q.popleft()[1], None))
                    others = free["label" if x["side"] == "candidate" else "candidate"]
                    if others:
                        y = others.popleft()[1]
                        out += [(x, y["id"]), (y, x["id"])]
                    else:
                        free[x["side"]].append((at, x))
            if out:
                columns = [pa.array([x[c] for x, _ in out], schema.field(c).type) for c in own] + [pa.array([o for _, o in out], schema.field("id").type)]
                yield pa.RecordBatch.from_arrays(columns, [*own, "other"])

    matched = dealt.mapInArrow(match, StructType([*out.fields, StructField("__on", BooleanType())]))
    on = matched.where("__on").select(*own, F.unix_micros(F.col("ts").cast("timestamp")).alias("__at"))
    on = on.repartition("session", "ref").sortWithinPartitions("session", "ref", *order).withColumn("__hash", F.xxhash64("session", "ref"))
    return matched.where("not __on").drop("__on").unionByName(on.mapInArrow(across, out))


def scored(matched: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 from the rows of one_to_one() with the columns by; ratios without a base are null."""
    found = F.col("other").isNotNull()
    out = matched.groupBy(*by).agg(
        F.count_if((F.col("side") == "label") & found).alias("tp"), F.count_if((F.col("side") == "candidate") & ~found).alias("fp"), F.count_if((F.col("side") == "label") & ~found).alias("fn")
    )
    ratio = lambda a, b: F.col(a) / F.nullif(F.expr(b).cast("double"), F.lit(0.0))
    return out.select(*by, "tp", "fp", "fn", ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"), (2 * ratio("tp", "2 * tp + fp + fn")).alias("f1"))


def modes_compared(rows: DataFrame, mode: str, base: str, false: Column, ts: str) -> DataFrame:
    """mode, false_positives, hours, per_hour, and over_base: false positives an hour more than in the mode base."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    each = rows.groupBy(mode).agg(F.count_if(F.coalesce(false, F.lit(False))).alias("false_positives"), ((F.max(micros) - F.min(micros)) / 3.6e9).alias("hours"))
    each = each.withColumn("per_hour", F.col("false_positives") / F.nullif("hours", F.lit(0.0)))
    own = F.max(F.when(F.col(mode) == base, F.col("per_hour"))).over(Window.partitionBy(F.lit(0)))  # a row a mode
    return each.withColumn("over_base", F.col("per_hour") - own)


def drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with how often and which side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
