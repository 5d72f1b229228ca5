"""Per-strategy portfolio state carried between runs (ST-04..ST-07), sharing the batch decision rule."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.selection import advance, decisions, hysteresis_step

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "symbols array<string>, days array<int>, last_period int, config string"
OUTPUT = "kind string, combo string, period int, symbol string, hold_days int, note string"


class PortfolioProcessor(StatefulProcessor):
    """Holdings and hold days of one (kind, combo). A changed configuration clears the state and says why."""

    def __init__(self, k: int, freq: int, delta: float, min_days: int, version: str = "1"):
        self.k, self.freq, self.delta, self.min_days = k, freq, delta, min_days
        self.config = f"v{version}|k={k}|freq={freq}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("portfolio", STATE)

    def handleInputRows(self, key, rows, timerValues):
        held, last, out = {}, None, []
        if self.state.exists():
            s = self.state.get()
            if s[3] == self.config:
                held, last = dict(zip(s[0], s[1])), s[2]
            else:
                out.append((key[0], key[1], -1, None, 0, f"cold start: {s[3]} -> {self.config}"))
        data = pd.concat(list(rows))
        for period, enough, top, r01 in decisions(data, self.k):
            if last is not None and period <= last:
                out.append((key[0], key[1], period, None, 0, "rejected: not after the last decision"))
                continue
            # trading bars that passed since the last decision, also over missed ones
            held = {s: d + self.freq * (period - last if last is not None else 1) for s, d in held.items()}
            last = period
            if enough:
                held = advance(held, hysteresis_step(held, top, r01, self.k, self.delta, self.min_days))
                out += [(key[0], key[1], period, s, int(d), "") for s, d in held.items()]
        self.state.update((list(held), [int(v) for v in held.values()], -1 if last is None else last, self.config))
        yield pd.DataFrame(out, columns=["kind", "combo", "period", "symbol", "hold_days", "note"])

    def close(self) -> None:
        pass


def run_portfolio(spark: SparkSession, source: str, schema, root: str, processor: PortfolioProcessor) -> None:
    """Feed the candidates that have arrived through the state operator; results go to an append-only log."""
    spark.conf.set(*PROVIDER)
    s = spark.readStream.schema(schema).parquet(source)
    d = s.groupBy("kind", "combo").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    q = d.writeStream.format("parquet").option("path", f"{root}/log").option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(f"{root}/log")
