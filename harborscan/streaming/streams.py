"""Findings and events as streams: the same operators, with watermarks and state that Spark keeps."""

from __future__ import annotations

from bisect import bisect_right
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from harborscan.functions.exprs import fingerprint
from harborscan.functions.scratch import folder
from harborscan.operators.long_lines import LEFT, RIGHT


def drained(spark: SparkSession, streamed: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream gives for what its source holds now, read from the sink that it wrote.

    Each micro-batch is committed to a table below the checkpoint folder, with the query's own checkpoint beside it.
    """
    path = folder(spark, "stream")
    query = streamed.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streamed.schema).parquet(f"{path}/rows")


def arrivals(spark: SparkSession, parts: list[DataFrame], build, mode: str = "append") -> DataFrame:
    """What a stream gives whose source grows: each part is written to the source's folder, and the query goes on from its
    own checkpoint, with its state and watermark, until it has read the part."""
    path = folder(spark, "arrivals")
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        streamed = build(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
        query = streamed.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(streamed.schema).parquet(f"{path}/rows")


def key_blocks(lines: DataFrame) -> DataFrame:
    """path, line, inside_key of lines (path, line, text) that arrive in order: whether a file is inside a private key block
    is the state kept for it between arrivals."""
    import re

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from harborscan.operators.secret_rules import PEM_BEGIN, PEM_END

    begin, end = re.compile(PEM_BEGIN), re.compile(PEM_END)

    def follow(key, frames, state):
        inside = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values("line")
        told = []
        for text in rows["text"]:
            told.append(inside)
            opened = begin.search(text)
            closed = end.search(text, opened.end() if opened else 0)
            inside = not closed if inside else bool(opened) and not closed
        state.update((inside,))
        yield pd.DataFrame({"path": key[0], "line": rows["line"].to_numpy(), "inside_key": told})

    return lines.groupBy("path").applyInPandasWithState(follow, "path string, line long, inside_key boolean", "inside boolean", "append", GroupStateTimeout.NoTimeout)


WINDOW_SCHEMA = "path string, line long, chunk long, lead int, own int, text string"


def grown(parts: DataFrame, chunk: int = 1 << 16, left: int = LEFT, right: int = RIGHT, idle_ms: int | None = None) -> DataFrame:
    """Windows (as ``long_lines.windows`` makes them) of files that arrive in parts: path, seq (0, 1, ...), text, last.

    The state of a file is the text that no window owns yet with some context before it, the place it has reached, and the
    parts that came before their turn. A chunk is committed once ``right`` characters after it are known, or its line has
    ended; so a window is emitted once, and the state stays within ``chunk`` + ``left`` + ``right`` characters and what is
    out of turn. ``last`` ends the last line; so does a pause of ``idle_ms`` of processing time, if that is given.
    """
    session = parts.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "ProcessingTime" if idle_ms else "None"
    class Grown(StatefulProcessor):  # here, so that it is sent as it is to wherever Spark runs it
        def __init__(self, chunk: int, left: int, right: int, idle_ms: int | None):
            self.chunk, self.left, self.right, self.idle_ms = chunk, left, right, idle_ms

        def init(self, handle) -> None:
            self.handle = handle
            self.reached = handle.getValueState("reached", "seq long, line long, chunk long, lead int, text string")
            self.early = handle.getMapState("early", "seq long", "text string, last boolean")

        def handleInputRows(self, key, rows, timerValues):
            seq, *at = self.reached.get() if self.reached.exists() else (0, 1, 0, 0, "")
            waiting = self.early.exists()
            while some := sorted(islice(rows, 1000), key=lambda row: row.seq):  # in turn they need no state of their own
                for row in some:
                    if row.seq != seq:
                        if row.seq > seq:  # one that was seen before says nothing new
                            self.early.updateValue((row.seq,), (row.text or "", bool(row.last)))
                            waiting = True
                        continue
                    part = (row.text or "", bool(row.last))
                    while part:
                        at, done = yield from self._taken(key[0], at, *part)
                        seq += 1
                        part = self.early.getValue((seq,)) if waiting else None
                        if part:
                            self.early.removeKey((seq,))
            self.reached.update((seq, *at))
            if self.idle_ms:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            seq, *at = self.reached.get()
            at, _ = yield from self._taken(key[0], at, "", True)
            self.reached.update((seq, *at))

        def close(self) -> None:
            pass

        def _taken(self, path, at, text, last):
            """The windows that a part completes, and the place after it."""
            line, chunk, lead, kept = at
            pieces = (kept + text).split("\n")
            for i, piece in enumerate(pieces):
                ended = last or i < len(pieces) - 1
                begin = lead
                while len(piece) > begin and (ended or len(piece) - begin >= self.chunk + self.right):
                    own, low = min(self.chunk, len(piece) - begin), max(0, begin - self.left)
                    yield Row(path=path, line=line, chunk=chunk, lead=begin - low, own=own, text=piece[low : begin + own + self.right])
                    begin, chunk = begin + own, chunk + 1
                if ended:
                    line, chunk, lead, kept = line + 1, 0, 0, ""
                else:
                    low = max(0, begin - self.left)
                    lead, kept = begin - low, piece[low:]
            return (line, chunk, lead, kept), last

    return parts.groupBy("path").transformWithState(Grown(chunk, left, right, idle_ms), T._parse_datatype_string(WINDOW_SCHEMA), "Append", mode)


ANSWER_SCHEMA = "ecosystem string, name string, version string, asked_at timestamp, state string, age_seconds long"


def answered_from_cache(rows: DataFrame, ttl_seconds: int, keep_seconds: int) -> DataFrame:
    """Lookups answered by what a cache knew when they were asked, from one stream of both.

    rows: ecosystem, name, version, at (with a watermark), status; a row with a status is an answer that a provider gave
    then, one without is a lookup. A lookup is answered once the watermark has passed it, as only then all that was known
    has come: by the latest status up to its time (of several at one time the greatest), with STALE_ before it if it is
    older than ``ttl_seconds``, and OFFLINE_NO_CACHE if there is none or it is older than ``keep_seconds``. Rows behind the
    watermark are dropped by the engine.

    The state of a key is a list of statuses and one of lookups, each with its time, and the one timer that stands at the
    earliest of its lookups or at the end of its earliest status. When it expires, all lookups that the watermark has
    passed are answered in one merge of both lists, so a micro-batch takes time in proportion to a key's rows. Statuses
    that a later one below the watermark replaces are removed, so the state stays within what came during the watermark's
    delay.
    """
    session = rows.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    class Cached(StatefulProcessor):  # here, so that it is sent as it is to wherever Spark runs it
        def __init__(self, ttl: int, keep: int):
            self.ttl, self.keep = ttl * 1_000_000, keep * 1_000_000

        def init(self, handle) -> None:
            self.handle = handle
            self.known = handle.getListState("known", "micros long, status string")
            self.asked = handle.getListState("asked", "micros long, n long")
            self.timer = handle.getValueState("timer", "millis long")

        def handleInputRows(self, key, rows, timerValues):
            timer = self.timer.get()[0] if self.timer.exists() else None
            due = timer
            for part in iter(lambda: list(islice(rows, 10_000)), []):
                known, asked = {}, {}
                for row in part:
                    at = int(row.micros)
                    if row.status is None:
                        asked[at] = asked.get(at, 0) + 1
                    else:
                        known[at] = max(known.get(at, ""), row.status)
                if known:
                    self.known.appendList(list(known.items()))
                if asked:
                    self.asked.appendList(list(asked.items()))
                due = self._due(due, known, asked)
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self._wait(due)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs()
            floor = (mark - 1) * 1000  # what is still to be answered or to come is not before it
            statuses, lookups = {}, {}
            for at, status in self.known.get() if self.known.exists() else ():
                statuses[at] = max(statuses.get(at, ""), status)
            for at, n in self.asked.get() if self.asked.exists() else ():
                lookups[at] = lookups.get(at, 0) + n
            times = sorted(statuses)
            for at in sorted(t for t in lookups if t < floor):
                i = bisect_right(times, at)
                since, status = (times[i - 1], statuses[times[i - 1]]) if i else (None, None)
                age = None if since is None else at - since
                gone = age is None or age > self.keep
                state = "OFFLINE_NO_CACHE" if gone else f"STALE_{status}" if age > self.ttl else status
                for _ in range(lookups.pop(at)):
                    yield Row(ecosystem=key[0], name=key[1], version=key[2], micros=at, state=state, age_seconds=None if gone else age // 1_000_000)
            first = max(bisect_right(times, floor) - 1, 0)
            left = {t: statuses[t] for t in times[first:] if t + self.keep >= floor}
            for kept, state in ((left, self.known), (lookups, self.asked)):
                state.put(list(kept.items())) if kept else state.clear()
            self._wait(self._due(None, left, lookups))

        def close(self) -> None:
            pass

        def _due(self, due, known, asked):
            """When the key is next looked at, in milliseconds."""
            ends = [(min(known) + self.keep) // 1000 + 1] if known else []
            asks = [min(asked) // 1000 + 1] if asked else []
            return min([*ends, *asks, *([] if due is None else [due])], default=None)

        def _wait(self, due):
            if due is None:
                self.timer.clear()
            else:
                self.timer.update((due,))
                self.handle.registerTimer(due)

    micros = rows.withColumn("micros", F.unix_micros("at"))
    made = micros.groupBy("ecosystem", "name", "version").transformWithState(Cached(ttl_seconds, keep_seconds), T._parse_datatype_string(ANSWER_SCHEMA.replace("asked_at timestamp", "micros long")), "Append", "EventTime")
    return made.select("ecosystem", "name", "version", F.timestamp_micros("micros").alias("asked_at"), "state", "age_seconds")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    rows = stream.parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total: tumbling windows; rows later than the watermark are dropped, by the engine's rule."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct_findings(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Fingerprints of (user, type) once each within the watermark."""
    marked = events.select("ts", fingerprint("stream-v1", F.col("user_id"), F.col("event_type")).alias("fingerprint"))
    return marked.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"]).select("fingerprint")
