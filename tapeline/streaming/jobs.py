"""Structured Streaming twins of the batch operators.

Each job is a function of a streaming DataFrame; ``drain`` runs it to completion over what the source holds.
State and outputs live below the shared checkpoint folder.
"""

from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import times as tm
from ..session import run_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark, path, schema, files_per_trigger=None):
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def as_stream(df, order, parts=4, files=4):
    """Write a frame as ``parts`` consecutive ranges of a numeric column and read it back as a stream, one range per
    trigger. Each range is ``files`` files, so writing stays parallel; later ranges have later file times."""
    spark = df.sparkSession
    path = run_dir(spark, "source")
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.filter(F.col(order) > lo)
        part = part if hi is None else part.filter(F.col(order) <= hi)
        # every range writes ``files`` files (rows are dealt out evenly), which is what a trigger takes
        part.repartition(files).write.mode("append").parquet(path)
    return source(spark, path, df.schema, files)


def drain(stream, name, mode="append"):
    """Run a streaming frame into Parquet with availableNow and return the result as a batch frame."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = run_dir(spark, name)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", run_dir(spark, name + "-ck")).format("parquet").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream, name, fn, mode="append", checkpoint=None):
    """Run ``fn(batch, epoch)`` per micro-batch with availableNow. A named ``checkpoint`` lets a later run go on where this one ended."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or run_dir(spark, name + "-ck")).foreachBatch(fn).trigger(availableNow=True).start()
    q.awaitTermination()


class Store:
    """A keyed table in files that outlives the process: ``epoch=E/part=P`` folders, found by listing.

    Keys are dealt over PARTS by hash, and a batch touches only the parts it has keys of. ``read`` gives all rows ever written (insert-only
    tables), ``latest`` the newest version of each part (upserts rewrite the parts they hit). A replayed epoch rewrites its own folder and
    reads only earlier ones, so retries add nothing; an epoch counts once it is complete.
    """

    PARTS = 16

    def __init__(self, spark, name, schema, keys, path=None):
        self.spark, self.keys, self.path = spark, [keys] if isinstance(keys, str) else list(keys), path or run_dir(spark, name)
        self.schema = spark.createDataFrame([], schema).schema

    def _names(self, *below):
        """Folder entries below the store's path; none if it isn't there."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _versions(self, before):
        """{part: epochs} of complete epochs."""
        out = {}
        for e in sorted(int(n[6:]) for n in self._names() if n.startswith("epoch=")):
            names = self._names(f"epoch={e}") if before is None or e < before else []
            if "_SUCCESS" in names:
                for n in names:
                    if n.startswith("part="):
                        out.setdefault(int(n[5:]), []).append(e)
        return out

    def _load(self, at):
        paths = [f"{self.path}/epoch={e}/part={p}" for p, e in at]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before=None, parts=None):
        return self._load([(p, e) for p, es in self._versions(before).items() for e in es if parts is None or p in parts])

    def latest(self, before=None, parts=None):
        return self._load([(p, max(es)) for p, es in self._versions(before).items() if parts is None or p in parts])

    def part(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.PARTS)).cast("int")

    def hit(self, batch):
        """Parts that a batch has keys of; at most PARTS numbers."""
        return {r[0] for r in batch.select(self.part().alias("part")).distinct().collect()}

    def write(self, df, epoch):
        df.select(*self.schema.names).withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/epoch={epoch}")


def _earliest(keys, observed, step=1 << 17):
    """For ``mapInArrow``: of each key in a partition the row observed first (nulls last, among equals the one that came first). Rows are folded
    whenever they are twice as many as were kept, so memory follows the partition's keys."""

    def fold(batches):
        import pyarrow as pa

        t = pa.Table.from_batches(batches)
        place = lambda n: pa.array(range(n), pa.int64())
        order = pa.table({"o": t[observed], "i": place(len(t))}).sort_by([("o", "ascending"), ("i", "ascending")])["i"]
        own = pa.table([*(t[k].take(order) for k in keys), place(len(t))], [*map(str, range(len(keys))), "at"])
        at = own.group_by([*map(str, range(len(keys)))], use_threads=False).aggregate([("at", "min")])["at_min"]
        return t.take(order.take(at)).combine_chunks().to_batches()

    def first(batches):
        kept, n, most = [], 0, step
        for b in batches:
            kept, n = [*kept, b], n + b.num_rows
            if n >= most:
                kept = fold(kept)
                n = sum(x.num_rows for x in kept)
                most = max(step, 2 * n)
        for x in fold(kept) if n else []:
            yield from (x.slice(i, 10_000) for i in range(0, x.num_rows, 10_000))

    return first


def ingest_first_seen(stream, key="event_id", observed="observed_time", path=None, ttl=None):
    """Insert-or-ignore by key: the first observation stays, and inside a batch the earliest row.

    Whether a key has been seen is state of that key in the state store, so a batch reads the state of its own keys and no earlier output, however
    many batches there were. A batch is cut down to a row a key in whole columns, and the state store is asked in the JVM. ``ttl``: forget a key
    that long (in seconds) after it was first observed, by the watermark of ``observed``; a later copy would then count as new (such keys have
    timers, and Python is called once a key). ``path`` keeps the table, the state and the progress over restarts.
    """
    spark, columns = stream.sparkSession, stream.columns
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def first(k, rows, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for pdf in rows:
            top = pdf.loc[[pdf[observed].idxmin()]]
            if best is None or top[observed].iloc[0] < best[observed].iloc[0]:
                best = top
        if not state.exists:
            state.update((True,))
            state.setTimeoutTimestamp(int(pd.Timestamp(best[observed].iloc[0]).timestamp() * 1000) + ttl * 1000)
            yield best[columns]

    if ttl:
        keyed = stream.withColumn("_t", F.col(observed).cast("timestamp")).withWatermark("_t", "0 seconds")
        new = keyed.groupBy(key).applyInPandasWithState(first, stream.schema, "seen boolean", "append", "EventTimeTimeout")
    else:
        new = stream.repartition(F.col(key)).mapInArrow(_earliest([key], observed), stream.schema).dropDuplicates([key])
    out = f"{path}/table" if path else run_dir(spark, "events")
    q = new.writeStream.outputMode("append").option("checkpointLocation", f"{path}/progress" if path else run_dir(spark, "events-ck")).format("parquet").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def live_bars(ticks, minutes=15, delay="10 minutes"):
    """Closed bars from ticks: tumbling windows in append mode, so a bucket in progress and late ticks never show."""
    o = F.struct("t", "event_id")
    w = ticks.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", delay)
    g = w.groupBy("symbol", F.window("t", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


class _Sorted(StatefulProcessor):
    """Rows of one key in time order, whatever batches they arrive in; subclasses keep their own value state."""

    STATE = ""

    def init(self, handle):
        self.state = handle.getValueState("s", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values(self.ORDER)
        s = self.state.get() if self.state.exists() else None
        out, s = self.walk(key[0], pdf, s)
        if s is not None:
            self.state.update(s)
        yield pd.DataFrame(out, columns=self.OUT)

    def close(self):
        pass


class GapMonitor(_Sorted):
    """Missing buckets inside an ET day and receipt lag per bar; duplicates and older starts are ignored."""

    STATE, ORDER, OUT = "last_us long, day int", "us", ["symbol", "us", "missing", "lag_s"]
    SCHEMA = "symbol string, us long, missing long, lag_s double"

    def __init__(self, width_us):
        self.width = width_us

    def walk(self, key, pdf, s):
        last, day = (s[0], s[1]) if s else (None, None)
        out = []
        for us, d, rec in zip(pdf["us"].tolist(), pdf["day"].tolist(), pdf["received_us"].tolist()):
            if last is not None and us <= last:
                continue
            gap = (us - last) // self.width - 1 if last is not None and d == day else 0
            out.append((key, us, gap, None if rec is None else (rec - us - self.width) / 1e6))
            last, day = us, d
        return out, (last, day)


class MomentumSignal(_Sorted):
    """Signal at the end of each completed bar: its intraday return against a trigger."""

    STATE, ORDER, OUT = "close double, day int", "us", ["symbol", "us", "ret", "direction"]
    SCHEMA = "symbol string, us long, ret double, direction int"

    def __init__(self, trigger):
        self.trigger = trigger

    def walk(self, key, pdf, s):
        close, day = (s[0], s[1]) if s else (None, None)
        out = []
        for us, d, c in zip(pdf["us"].tolist(), pdf["day"].tolist(), pdf["close"].tolist()):
            if close is not None and d == day:
                r = c / close - 1
                if abs(r) >= self.trigger:
                    out.append((key, us, r, 1 if r > 0 else -1))
            close, day = c, d
        return out, (close, day)


class DetectorMachine(_Sorted):
    """CALIBRATING / RISK_ON / RISK_OFF per day; one row per switch."""

    STATE, ORDER, OUT = "n_eff long, until long, state string", "d", ["symbol", "d", "state"]
    SCHEMA = "symbol string, d long, state string"

    def __init__(self, calib=20, persist=20):
        self.calib, self.persist = calib, persist

    def due(self):
        """The first day on which an off state has run out, if nothing comes before."""
        s = self.state.get() if self.state.exists() else None
        return s[1] + 1 if s and s[2] == "RISK_OFF" else None

    def aged(self, key, passed):
        day = self.due()
        if day is None or not passed(day):
            return []
        n_eff, until, _ = self.state.get()
        self.state.update((n_eff, until, "RISK_ON"))
        return [(key, day, "RISK_ON")]

    def walk(self, key, pdf, s):
        n_eff, until, state = (s[0], s[1], s[2]) if s else (0, -1, "")
        out = []
        for d, valid, hit in zip(pdf["d"].tolist(), pdf["valid"].tolist(), pdf["hit"].tolist()):
            active = n_eff >= self.calib
            if active and hit:
                until = max(until, d + self.persist - 1)
            new = "CALIBRATING" if not active else ("RISK_OFF" if until >= d else "RISK_ON")
            if new != state:
                out.append((key, d, new))
            state, n_eff = new, n_eff + (1 if valid else 0)
        return out, (n_eff, until, state)


class TroughConfirm(StatefulProcessor):
    """The newest lb + lf + 1 bars per symbol, each with its day's high so far; a trough counts when its last confirming bar arrives."""

    SCHEMA = "symbol string, trough_us long, confirm_us long, drop double"
    OUT = ["symbol", "trough_us", "confirm_us", "drop"]

    def __init__(self, lb=3, lf=2, drop=0.3):
        self.lb, self.lf, self.drop = lb, lf, drop

    def init(self, handle):
        self.ring = handle.getListState("ring", "us long, day int, close double, high double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        buf = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        pdf = pd.concat(list(rows)).sort_values("us")
        n, out = self.lb + self.lf + 1, []
        for us, d, c in zip(pdf["us"].tolist(), pdf["day"].tolist(), pdf["close"].tolist()):
            high = max(c, buf[-1][3]) if buf and buf[-1][1] == d else c
            buf = (buf + [(us, d, c, high)])[-n:]
            if len(buf) < n:
                continue
            t_us, _, low, top = buf[self.lb]
            if low <= min(b[2] for b in buf) and (top - low) / top >= self.drop:
                out.append((key[0], t_us, us, (top - low) / top))
        self.ring.put(buf)
        yield pd.DataFrame(out, columns=["symbol", "trough_us", "confirm_us", "drop"])

    def close(self):
        pass


class Reordered(StatefulProcessor):
    """Hands a key's rows to another processor in event-time order, however batches bring them.

    Rows wait in map state by time slot. A slot's timer fires when the watermark has passed its end, so nothing on time can still come; the slot's
    rows then go on, sorted. Memory follows one slot of one key. Rows that come when their slot is done are later than the watermark allows and
    go unused. A processor that ages without input says when it is due (``due``), and is asked then (``aged``) if time, driven by any key, gets there.
    """

    def __init__(self, inner, row, time, per_ms, slot_ms, base_ms):
        self.inner, self.row, self.time, self.per_ms, self.slot_ms, self.base_ms = inner, row, time, per_ms, slot_ms, base_ms

    def init(self, handle):
        self.handle = handle
        self.names = [c.split(":")[0].strip() for c in self.row.split(",")]
        self.at = self.names.index(self.time)
        self.wait = handle.getMapState("wait", "slot long", f"rows array<struct<{self.row}>>")
        self.inner.init(handle)

    def ms(self, value):
        return self.base_ms + int(value // self.per_ms if self.per_ms >= 1 else value * round(1 / self.per_ms))

    def end(self, value):
        return (self.ms(value) // self.slot_ms + 1) * self.slot_ms

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        slots, now = {}, timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for *values, nulls in pdf[[*self.names, "nulls"]].itertuples(index=False, name=None):
                r = tuple(None if nulls >> i & 1 else x for i, x in enumerate(values))
                slots.setdefault(self.end(r[self.at]), []).append(r)
        for end, new in slots.items():
            if end <= now:
                continue
            old = []
            if self.wait.containsKey((end,)):
                old = [tuple(r) for r in self.wait.getValue((end,))[0]]
            else:
                self.handle.registerTimer(end)
            self.wait.updateValue((end,), (old + new,))
        yield pd.DataFrame([], columns=self.inner.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs()
        if at % self.slot_ms:  # a due time lies a millisecond behind the end of its slot
            yield pd.DataFrame(self.inner.aged(key[0], lambda value: self.end(value) + 1 <= at), columns=self.inner.OUT)
            return
        if not self.wait.containsKey((at,)):
            return
        whole = lambda r: [(x is not None, x) for x in r]
        rows = sorted((tuple(r) for r in self.wait.getValue((at,))[0]), key=whole if self.at == 0 else lambda r: r[self.at])
        self.wait.removeKey((at,))
        yield from self.inner.handleInputRows(key, iter([pd.DataFrame(rows, columns=self.names, dtype=object)]), timerValues)
        due = getattr(self.inner, "due", lambda: None)()
        if due is not None:
            self.handle.registerTimer(self.end(due) + 1)

    def close(self):
        self.inner.close()


#: Key of rows that carry nothing but time.
CLOCK = "~"


def in_order(stream, processor, row, time="us", per_ms=1000, slot_ms=86_400_000, delay_ms=0, base_ms=0, key="symbol"):
    """Run a processor over rows in event-time order. ``row``: the columns it takes (name:type, ...); ``time``: one of them, ``per_ms`` units a
    millisecond, from ``base_ms`` on (a whole number of slots; a watermark begins at 0, and what isn't behind it is late). Rows may come up to
    ``delay_ms`` late."""
    ms = F.floor(F.col(time) / per_ms) if per_ms >= 1 else F.col(time) * round(1 / per_ms)
    s = stream.withColumn("_t", F.timestamp_millis(ms.cast("bigint") + base_ms)).withWatermark("_t", f"{delay_ms} milliseconds")
    # one null in a batch would make doubles of a whole column of integers, which the state then reads as nulls: integers are without nulls, a mask tells
    names, kinds = [c.split(":")[0].strip() for c in row.split(",")], dict(s.dtypes)
    mask = F.lit(0).cast("bigint")
    for i, c in enumerate(names):
        mask = mask + F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    whole = [F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) if kinds[c] in ("tinyint", "smallint", "int", "bigint") else F.col(c) for c in names]
    s = s.select(key, "_t", *whole, mask.alias("nulls"))
    wrapped = Reordered(processor, row, time, per_ms, slot_ms, base_ms)
    return s.groupBy(key).transformWithStateInPandas(statefulProcessor=wrapped, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="EventTime")


def with_clock(df, time="us", per_ms=1000, slot_ms=86_400_000, delay_ms=0, base_ms=0, key="symbol", **others):
    """Rows and one of the clock's key that takes the watermark to the end of the last slot. ``others``: its values in further columns."""
    last = df.agg(F.max(time)).first()[0] or 0
    ms = last // per_ms if per_ms >= 1 else last * round(1 / per_ms)
    tick = ((ms // slot_ms + 1) * slot_ms + delay_ms) * per_ms
    row = {key: CLOCK, time: int(tick), **others}
    return df.unionByName(df.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]))


class Heartbeat(StatefulProcessor):
    """A row for each time a component has been silent for longer than its threshold, found by a timer: no row of its own is needed."""

    SCHEMA, OUT = "component string, last_us long, stale_us long", ["component", "last_us", "stale_us"]

    def __init__(self, limits_ms, default_ms):
        self.limits, self.default = limits_ms, default_ms

    def init(self, handle):
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def due(self, component, us):
        return us // 1000 + self.limits.get(component, self.default) + 1

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        old = self.last.get()[0] if self.last.exists() else None
        new = max([int(pdf["us"].max()) for pdf in rows] + ([old] if old is not None else []))
        if new != old and key[0] != CLOCK:
            if old is not None:
                self.handle.deleteTimer(self.due(key[0], old))
            self.last.update((new,))
            self.handle.registerTimer(self.due(key[0], new))
        yield pd.DataFrame([], columns=self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        (last,), at = self.last.get(), expiredTimerInfo.getExpiryTimeInMs()
        rows = [(key[0], last, at * 1000)] if self.due(key[0], last) <= at else []
        yield pd.DataFrame(rows, columns=self.OUT)

    def close(self):
        pass


def stateful(stream, processor, key="symbol"):
    """Run a processor over rows that come in order."""
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="None")


def silences(stream, thresholds, default, delay="0 seconds"):
    """(component, last_us, stale_us) of each silence longer than its threshold (minutes). Time goes on with any component's rows."""
    s = stream.select("component", tm.micros("ts").alias("us"), F.col("ts").cast("timestamp").alias("_t")).withWatermark("_t", delay)
    p = Heartbeat({c: int(m * 60_000) for c, m in thresholds.items()}, int(default * 60_000))
    return s.groupBy("component").transformWithStateInPandas(statefulProcessor=p, outputStructType=p.SCHEMA, outputMode="Append", timeMode="EventTime")


def heartbeats(stream, now, open_now, thresholds, default):
    """Last activity per component from a heartbeat stream, its age at ``now`` against the open or closed threshold, and whether its timer has
    gone off since. A clock row takes time to ``now``, so components that fall silent turn stale without rows of their own."""
    spark = stream.sparkSession
    store = Store(spark, "beats", "component string, last_ts timestamp_ntz", "component")
    # complete mode: the state is one row per component
    drain_batches(stream.groupBy("component").agg(F.max("ts").alias("last_ts")), "beats", lambda b, e: store.write(b, e), mode="complete")
    pick = 0 if open_now else 1
    tick = as_stream(spark.range(1).select(F.lit(CLOCK).alias("component"), F.lit(now).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("n")), "n", 1, 1)
    gone = drain(silences(stream.select("component", "ts").unionByName(tick.select("component", "ts")), {c: t[pick] for c, t in thresholds.items()}, default[pick]), "silences")
    thr = F.lit(float(default[pick]))
    for comp, t in thresholds.items():
        thr = F.when(F.col("component") == comp, float(t[pick])).otherwise(thr)
    age = (tm.micros(F.lit(now).cast("timestamp_ntz")) - tm.micros("last_ts")) / 60_000_000
    last = gone.groupBy("component").agg(F.max("last_us").alias("_us"))
    b = store.latest().join(last, "component", "left")
    stale = F.coalesce(F.col("_us") == tm.micros("last_ts"), F.lit(False))
    return b.select("component", "last_ts", age.alias("age_min"), thr.alias("threshold_min"), stale.alias("stale"))


def posts_per_day(stream, delay="1 hour"):
    """Posts per ET day from closed one-day windows on ET wall time."""
    w = stream.withColumn("t", tm.to_et("ts").cast("timestamp")).withWatermark("t", delay)
    return w.groupBy(F.window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("et_date"), "n")


def with_coverage(counts, polls, source_id):
    """NULL count on days without a successful poll of the source."""
    cov = polls.filter((F.col("source_id") == source_id) & F.col("ok")).select(tm.et_date("polled_at").alias("et_date")).distinct().withColumn("_c", F.lit(True))
    return counts.join(cov, "et_date", "left").withColumn("n", F.when(F.col("_c"), F.col("n"))).drop("_c")


def upsert_sources(stream, path=None):
    """Source dimension: attributes follow the newest row, the weight stays as first inserted."""
    store = Store(stream.sparkSession, "sources", "source_id string, tier string, weight double, updated timestamp_ntz", "source_id", path and f"{path}/table")

    def step(batch, epoch):
        b = batch.groupBy("source_id").agg(
            F.max_by("tier", F.struct("ts", "event_id")).alias("tier"), F.min_by("weight", F.struct("ts", "event_id")).alias("weight"), F.max("ts").alias("updated"))
        old = store.latest(epoch, store.hit(batch))
        j = b.alias("n").join(old.alias("o"), "source_id", "full_outer")
        store.write(j.select("source_id", F.coalesce("n.tier", "o.tier").alias("tier"), F.coalesce("o.weight", "n.weight").alias("weight"), F.coalesce("n.updated", "o.updated").alias("updated")), epoch)

    drain_batches(stream, "sources", step, checkpoint=path and f"{path}/progress")
    return store.latest()


def upsert_latest(stream, keys, order, path=None):
    """Insert-or-replace by key: the newest row of a key stays."""
    rest = [c for c in stream.columns if c not in keys]
    store = Store(stream.sparkSession, "latest", stream.schema, keys, path and f"{path}/table")

    def step(batch, epoch):
        u = batch.unionByName(store.latest(epoch, store.hit(batch)))
        store.write(u.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*stream.columns), epoch)

    drain_batches(stream, "latest", step, checkpoint=path and f"{path}/progress")
    return store.latest()
