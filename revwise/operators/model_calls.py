"""Model calls as rounds over request tables (the batch hook of the L-series).

A run makes its requests in order, and each may be tried twice.  Round by round, every
run that is still going makes its next request: the requests of all runs are one table,
the caller's function gets them in Arrow batches, the answers are written as a stage
table (so that no later step calls the model again), parsed, and only failed ones are
called a second time.  Before each request the run's spend is compared with the cap: at
or above it the request is refused and the run ends, as it does when both tries fail.

The number of rounds is that of one run's requests (two a cluster and two), not that of
the table.  A task that is lost calls the model again for its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revwise.operators.themes import COST_PER_COMPLETION_TOKEN, COST_PER_PROMPT_TOKEN, DEFAULT_COST_CAP_USD
from revwise.session import materialize_table

#: Requests that the caller's function gets at a time.
BATCH = 256
MAX_ATTEMPTS = 2

#: An answer: its text, prompt tokens and completion tokens; None where no answer came.
Answer = tuple[str | None, int, int] | None
Model = Callable[[list[str], int], list[Answer]]


def is_object(response: Column) -> Column:
    """Whether an answer is a JSON object (what a request asks for)."""
    return F.coalesce(F.try_parse_json(response).isNotNull() & response.rlike(r"^\s*\{"), F.lit(False))


def call_model(requests: DataFrame, model: Model, attempt: int, batch: int = BATCH) -> DataFrame:
    """``requests`` (prompt, ...) with response, prompt_tokens, completion_tokens and answered.

    ``model(prompts, attempt)`` gives an answer for each prompt.  If it raises, none of its
    batch is answered.
    """
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                prompts = part.column("prompt").to_pylist()
                try:
                    answers = list(model(prompts, attempt))
                except Exception:  # noqa: BLE001 - a failed call is a failed attempt, whatever its reason
                    answers = [None] * len(prompts)
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(prompts)} prompts, {len(answers)} answers")
                columns = [[(a or (None, 0, 0))[i] for a in answers] for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(columns[0], pa.string()), pa.array([n or 0 for n in columns[1]], pa.int64()),
                     pa.array([n or 0 for n in columns[2]], pa.int64()), pa.array([a is not None for a in answers], pa.bool_())],
                    [*names, "response", "prompt_tokens", "completion_tokens", "answered"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInArrow(run, f"{schema}, response string, prompt_tokens long, completion_tokens long, answered boolean")


def run_requests(requests: DataFrame, model: Model, cap: float = DEFAULT_COST_CAP_USD, good: Callable[[Column], Column] = is_object,
                 max_attempts: int = MAX_ATTEMPTS, batch: int = BATCH) -> DataFrame:
    """The call log of ``requests`` (run_id, seq, prompt): one row for each call, and one for a refusal.

    Columns: run_id, seq, attempt (0: refused), response, ok, answered, prompt_tokens,
    completion_tokens, cost, spent_before (of the request), refused.  Requests of a run are
    made by seq (which doesn't repeat in a run); those after a refusal or a request whose
    ``max_attempts`` tries all failed are not made.
    """
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    requests = materialize_table(requests.select("run_id", "seq", "prompt").withColumn("turn", turn))
    going = materialize_table(requests.select("run_id").distinct().withColumn("spent", F.lit(0.0)))
    cost = F.col("prompt_tokens") * COST_PER_PROMPT_TOKEN + F.col("completion_tokens") * COST_PER_COMPLETION_TOKEN
    log, step = [], 0
    while True:
        step += 1
        due = materialize_table(requests.where(F.col("turn") == step).join(going, "run_id"))
        if due.isEmpty():
            break
        refused = due.where(F.col("spent") >= cap)
        log.append(refused.select(
            "run_id", "seq", F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("response"), F.lit(False).alias("ok"),
            F.lit(False).alias("answered"), F.lit(0).cast("long").alias("prompt_tokens"),
            F.lit(0).cast("long").alias("completion_tokens"), F.lit(0.0).alias("cost"), F.col("spent").alias("spent_before"),
            F.lit(True).alias("refused")))
        ask, calls = due.where(F.col("spent") < cap), []
        for attempt in range(1, max_attempts + 1):
            made = materialize_table(call_model(ask.select("run_id", "seq", "prompt", "spent"), model, attempt, batch)
                                     .withColumn("ok", F.col("answered") & good(F.col("response"))))
            calls.append(made.select("run_id", "seq", F.lit(attempt).alias("attempt"), "response", "ok", "answered",
                                     "prompt_tokens", "completion_tokens", cost.alias("cost"),
                                     F.col("spent").alias("spent_before"), F.lit(False).alias("refused")))
            ask = made.where("not ok").select("run_id", "seq", "prompt", "spent")
            if ask.isEmpty():
                break
        log += calls
        paid = reduce(DataFrame.union, calls).groupBy("run_id").agg(F.sum("cost").alias("paid"), F.bool_or("ok").alias("done"))
        going = materialize_table(going.join(paid.where("done"), "run_id").select("run_id", (F.col("spent") + F.col("paid")).alias("spent")))
    if not log:
        return requests.sparkSession.createDataFrame([], (
            f"run_id {requests.schema['run_id'].dataType.simpleString()}, seq {requests.schema['seq'].dataType.simpleString()}, "
            "attempt int, response string, ok boolean, answered boolean, prompt_tokens long, completion_tokens long, cost double, "
            "spent_before double, refused boolean"))
    return reduce(DataFrame.union, log)


def call_metrics(log: DataFrame) -> DataFrame:
    """A7 of a call log: tokens, cost, answered calls, failed tries; whether the run was refused a call."""
    return log.groupBy("run_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("llm_cost_usd"), F.count_if("answered").alias("llm_calls"),
        F.count_if(~F.col("ok") & ~F.col("refused")).alias("retries"), F.bool_or("refused").alias("refused"))
