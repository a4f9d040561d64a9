"""Token buckets of many callers, replayed over a log of requests.

A request finds min(cap, max(tokens, 1) - 1 + refill) tokens, where tokens are what the caller's request before it found;
where it finds under one, the caller waits for the rest. In doubles too a run of requests ends with no fewer tokens for
finding more at its first one. So where a run ends alike for a first request that finds one and one that finds a full
bucket, as it does once a request waits or a bucket is full whatever came before, it ends so for all. Runs are replayed
on their own from there, bit for bit as one after another, and no caller's requests are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.running import each_run, in_runs


def token_bucket(requests: DataFrame, per_minute: int, caller: str = "caller", at: str = "ts", request: str = "id") -> DataFrame:
    """(caller, request, wait_ms): how long each request waits for a token of its caller.

    Buckets hold ``per_minute`` tokens, are full at first and refill evenly. Requests count in the order of time and id;
    a wait doesn't move the request that follows, as time is taken at arrival. A null caller is one of its own; rows
    without a time are left out. Three narrow passes: requests in runs of the whole order, one row per run with its two
    ends, and the runs again with what their first requests find. A run that neither waits nor fills the bucket is
    replayed before the next one in one stream.
    """
    cap = float(per_minute)
    rows = requests.filter(F.col(at).isNotNull()).select(F.coalesce(F.col(caller).cast("string"), F.lit("\0")).alias("caller"), F.col(request).alias("request"), (F.unix_micros(F.col(at).cast("timestamp")) / 1000).alias("ms"))
    rows = in_runs(rows, "caller", "ms", "request")

    def after(tokens: float, ms: float) -> float:
        """Tokens that a request finds so many milliseconds after one that found ``tokens``."""
        return min(cap, max(tokens, 1.0) - 1 + ms * per_minute / 60000.0)

    def ends(run: pa.Table) -> pa.RecordBatch:
        low, high = 1.0, cap
        ms = run["ms"].to_pylist()
        for last, now in zip(ms, ms[1:], strict=False):
            # Once both are equal, they stay so.
            high = after(high, now - last)
            low = after(low, now - last) if low != high else high
        return pa.RecordBatch.from_pydict({"caller": [run["caller"][0].as_py()], "_run": [run["_run"][0].as_py()], "first": [ms[0]], "last": [ms[-1]], "low": [low], "high": [high]})

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ends of runs in order -> the tokens that the first request of each finds, or the run from which to replay."""
        of, last, found, lead = None, 0.0, None, 0
        for batch in batches:
            out: dict[str, list] = {"caller": [], "_run": [], "lead": [], "begins": []}
            for r in batch.to_pylist():
                first = r["caller"] != of
                begins = cap if first else None if found is None else after(found, r["first"] - last)
                lead = lead if begins is None else r["_run"]
                for name, value in zip(out, (r["caller"], r["_run"], lead, begins), strict=True):
                    out[name].append(value)
                of, last = r["caller"], r["last"]
                if r["low"] == r["high"] or begins == cap:
                    found = r["high"]
                else:
                    found = r["low"] if begins is not None and begins <= 1 else None
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("caller", pa.string()), ("_run", pa.int64()), ("lead", pa.int64()), ("begins", pa.float64())]))

    def waited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests in order, those of a caller and lead one stream -> their waits."""
        of, last, tokens = None, 0.0, cap
        for batch in batches:
            waits = []
            for name, lead, ms, begins in zip(*(batch.column(c).to_pylist() for c in ("caller", "lead", "ms", "begins")), strict=True):
                tokens = after(tokens, ms - last) if (name, lead) == of else begins
                of, last = (name, lead), ms
                waits.append(max(1 - tokens, 0.0) / per_minute * 60000)
            yield pa.RecordBatch.from_arrays([batch.column("caller"), batch.column("request"), pa.array(waits, pa.float64())], names=["caller", "request", "wait_ms"])

    # One short row per run; the runs of a caller are as many as its requests over those of a run.
    runs = rows.mapInArrow(each_run(ends, "caller"), "caller string, _run long, first double, last double, low double, high double")
    leads = runs.repartition("caller").sortWithinPartitions("caller", "_run").mapInArrow(begun, "caller string, _run long, lead long, begins double")
    kind = rows.schema["request"].dataType.simpleString()
    placed = rows.join(leads, ["caller", "_run"]).repartition("caller", "lead").sortWithinPartitions("caller", "lead", "ms", "request")
    out = placed.select("caller", "lead", "ms", "request", "begins").mapInArrow(waited, f"caller string, request {kind}, wait_ms double")
    return out.withColumn("caller", F.nullif("caller", F.lit("\0")))
