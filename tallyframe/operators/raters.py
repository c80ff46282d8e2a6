"""Collecting judgments from an injected rater: batches, retries, budget, resuming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import parse_votes
from tallyframe.operators.calls import SHARDS, Gate, Log, by_shard
from tallyframe.operators.judgments import batches, remaining
from tallyframe.sources.readers import exists
from tallyframe.storage import fresh_path

#: A rater answers a prompt with text, or with an Answer that has tokens too.
Rater = Callable[[str], "str | Answer"]


def mock_rater(prompt: str) -> str:
    """Answers O to odd items: the offline default."""
    lines = [x for x in prompt.split("\n")[1:] if x[:1].isdigit()]
    return "\n".join(f"{i}. {'O' if i % 2 else 'X'}" for i in range(1, len(lines) + 1))


def fallback(*raters: Rater) -> Rater:
    """A rater that passes to the next one when one fails, and stays with it."""
    at = [0]

    def call(prompt: str) -> str:
        while True:
            try:
                return raters[at[0]](prompt)
            except Exception:  # noqa: BLE001  a rater may fail in any way
                if at[0] + 1 == len(raters):
                    raise
                at[0] += 1

    return call


def question(state: Column, ask: str, choices: tuple[str, ...] = ("yes", "no"), framing: str = "pos") -> Column:
    """One probability question: state, question, choices, framing."""
    return F.struct(state.alias("state"), F.lit(ask).alias("question"), F.array(*map(F.lit, choices)).alias("choices"), F.lit(framing).alias("framing"))


def plan(items: DataFrame, text: str, order: list[str], size: int = 20, arm: str = "arm", instruction: str = "Mark each line O or X.") -> DataFrame:
    """Prompts of `size` items of one arm: arm, batch, keys, prompt."""
    rows = batches(items, size, order, arm)
    docs = rows.groupBy(arm, "batch").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("text_")))).alias("items"))
    lines = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x["text_"], F.lit(""))))
    return docs.withColumn("prompt", F.concat(F.lit(instruction + "\n"), F.array_join(lines, "\n")))


class Throttled(Exception):
    """The service asks for a pause: all tasks of the run wait together, longer each time."""


class Refused(Exception):
    """The service will not answer this prompt; it is not tried again."""


class Unavailable(Exception):
    """The provider is out of service: all tasks of the run go on with the next one, if there is one."""


class Answer(NamedTuple):
    """An answer with the tokens that it took; a rater may also return its text alone."""

    text: str
    tokens_in: int = 0
    tokens_out: int = 0


def classified(status: int | None, detail: str = "") -> type[Exception]:
    """The kind of error that an HTTP status means.

    429 and 529 ask for a pause, as does a 401 whose text names a 429 (a wrapper's way to pass it on);
    no status (no connection) and the server's own errors are tried again; any other is final.
    """
    if status in (429, 529) or (status == 401 and "429" in detail):
        return Throttled
    return OSError if status is None or status in (500, 502, 503, 504, 520, 522, 524) else Refused


def keyed(prompts: DataFrame, model: str = "") -> DataFrame:
    """prompts with key_, a digest of model and prompt, and shard_, the part of the log that it belongs to."""
    key = F.sha2(F.concat(F.lit(model), F.lit("\n"), F.coalesce("prompt", F.lit(""))), 256)
    return prompts.withColumn("key_", key).withColumn("shard_", F.pmod(F.xxhash64("key_"), F.lit(SHARDS)).cast("string"))


_RECORD = "status string, answer string, calls int, tokens_in long, tokens_out long"


def ask(
    prompts: DataFrame,
    rater: Rater | Sequence[Rater],
    gate: Gate | int,
    log: str | None = None,
    tries: int = 3,
    wait: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
    model: str = "",
) -> DataFrame:
    """prompts with answer, status, calls, tokens_in and tokens_out; no prompt that has an answer is asked again.

    The plan is counted before any call: with more distinct prompts to ask than the gate has calls
    left, none is asked. Every try takes a call from the gate's budget, which all tasks share, so a retry
    may use what another prompt saved; when it is spent the rest has status "stopped". An error waits
    and doubles its wait; Throttled makes all tasks wait; Refused is final; Unavailable moves all tasks
    to the next of several raters and is tried there at once. What fails has a null answer and status
    "error" or "refused", so it is never mistaken for a judgment.

    Each answer is written to the log before the next call. A task that runs again, a second action on
    the result, and a later run with the same log take answers from there; errors are asked again by a
    later run only. Equal prompts are asked once; the first row of them has the calls. What can be lost
    is an answer whose task dies between call and log. log is a folder that driver and executors
    reach (a URI that Arrow can write); without it the run has one of its own. With a number for a gate
    the run has a budget of its own. Null prompts are asked as empty ones.
    """
    spark = prompts.sparkSession
    gate = gate if isinstance(gate, Gate) else Gate(spark, gate)
    store = Log(log or f"{fresh_path(spark)}/answers")
    many = list(rater) if isinstance(rater, Sequence) else [rater]
    rows = keyed(prompts, model)
    final = store.table(spark, _RECORD).where("status in ('ok', 'refused')").select(F.col("key").alias("key_"))
    n = rows.select("key_").distinct().join(final.distinct(), "key_", "left_anti").count()
    if n > gate.left:
        raise ValueError(f"the plan has {n} calls, the budget {gate.left}")
    client = gate.client()
    order = [c for c in ("arm", "batch") if c in prompts.columns]
    dealt = rows.repartition(SHARDS, "shard_").sortWithinPartitions("shard_", "key_", *order)
    kept = prompts.columns

    def one(prompt: str) -> dict:
        used, pauses = 0, wait
        while used < tries:
            provider = client.take(sleep)
            if provider is None:
                return {"status": "stopped", "calls": used}
            used += 1
            try:
                answer = many[provider](prompt)
                answer = answer if isinstance(answer, Answer) else Answer(answer)
                client.answered(answer.tokens_in, answer.tokens_out)
                return {"status": "ok", "answer": answer.text, "calls": used, "tokens_in": answer.tokens_in, "tokens_out": answer.tokens_out}
            except Refused:
                client("failed")
                return {"status": "refused", "calls": used}
            except Throttled:
                client("throttled")
            except Unavailable:
                if client("switch", provider, len(many)) == provider:
                    break
            except ConnectionError as lost:
                if "gate" in str(lost):
                    raise
                sleep(pauses)
                pauses *= 2
            except Exception:  # noqa: BLE001  a rater may fail in any way
                sleep(pauses)
                pauses *= 2
        client("failed")
        return {"status": "error", "calls": used}

    def call(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client.open()
        counted: set[str] = set()
        try:
            for batch in batches_:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                shards, keys, texts = (columns[c].to_pylist() for c in ("shard_", "key_", "prompt"))
                out = []
                for key, text, known, writer in by_shard(zip(shards, keys, texts, strict=True), store, client):
                    record = known.get(key)
                    if record is None or (record["status"] not in ("ok", "refused") and record["run"] != client.run):
                        record = {"key": key, "run": client.run, **one(text or "")}
                        if record["status"] != "stopped":
                            writer.add([record])
                        known[key] = record
                    out.append(record if key not in counted else {**record, "calls": 0, "tokens_in": 0, "tokens_out": 0})
                    counted.add(key)
                of = lambda name, empty=None: [r.get(name, empty) for r in out]
                made = [pa.array(of("answer"), pa.string()), pa.array(of("status"), pa.string()), pa.array(of("calls"), pa.int32())]
                made += [pa.array(of(c, 0), pa.int64()) for c in ("tokens_in", "tokens_out")]
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in kept), *made], [*kept, "answer", "status", "calls", "tokens_in", "tokens_out"])
        finally:
            client.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return dealt.mapInArrow(call, schema + ", answer string, status string, calls int, tokens_in long, tokens_out long")


def usage(asked: DataFrame, price: float = 0.0, per_million: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Prompts, calls, failures, tokens and cost of a run, by arm where there is one.

    The cost is calls times a price and tokens in and out at their prices per million. Calls of tasks
    that were lost are in Gate.usage() only.
    """
    by = [c for c in ("arm",) if c in asked.columns]
    sums = asked.groupBy(*by).agg(
        F.count("*").alias("prompts"),
        F.sum("calls").alias("calls"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out")),
    )
    tokens = F.col("tokens_in") * F.lit(float(per_million[0])) + F.col("tokens_out") * F.lit(float(per_million[1]))
    return sums.withColumn("cost", F.col("calls") * F.lit(float(price)) + tokens / 1_000_000)


def freeze(plan_: DataFrame, path: str) -> DataFrame:
    """The plan as it was first written to a path: written if nothing is there, else read back.

    A rerun with frozen inputs asks exactly these prompts. A plan that has other prompts than the frozen
    one is refused before any call.
    """
    spark = plan_.sparkSession
    if not exists(spark, path):
        plan_.write.parquet(path)
        return spark.read.parquet(path)
    frozen = spark.read.parquet(path)
    each = lambda df, sign: df.select("arm", "batch", F.sha2("prompt", 256).alias("prompt"), F.lit(sign).alias("side"))
    unlike = each(frozen, 1).union(each(plan_, -1)).groupBy("arm", "batch", "prompt").agg(F.sum("side").alias("side")).where("side <> 0")
    if unlike.head(1):
        raise ValueError(f"the plan differs from the frozen one in {path}")
    return frozen


def judgments(asked: DataFrame, key: list[str], size: int = 20, arm: str = "arm", strict: bool = False) -> DataFrame:
    """One row per item with its judgment; null where the call failed."""
    rows = asked.withColumn("votes_", parse_votes("answer", size, strict))
    rows = rows.select(arm, "status", F.posexplode("items").alias("at_", "item_"), "votes_")
    vote = F.when(F.col("status") == "ok", F.get("votes_", F.col("at_")))
    return rows.select(*(F.col("item_")[k].alias(k) for k in key if k != arm), arm, vote.alias("judgment"))


def resume(items: DataFrame, done: list[DataFrame], key: list[str]) -> DataFrame:
    """Items without a judgment yet; those with a null judgment are asked again."""
    return remaining(items, [d.where(F.col("judgment").isNotNull()) for d in done], key)
