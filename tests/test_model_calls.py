"""Rounds of model calls against one request after the other in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from revwise.operators import model_calls as M
from revwise.operators import themes as TH


def scripted(script):
    """A model that answers from ``script[prompt][attempt - 1]``; "raise" fails the whole batch."""
    def model(prompts, attempt):
        out = []
        for p in prompts:
            kind, tokens = script[p][attempt - 1]
            if kind == "raise":
                raise RuntimeError("model is down")
            out.append(None if kind == "none" else ('{"label": "x"}' if kind == "good" else "not json", tokens, 2 * tokens))
        return out
    return model


def one_by_one(requests, script, cap):
    """{(run, seq, attempt): (ok, tokens, spent before, refused)}: a run's requests in order."""
    log = {}
    for run in {r for r, _, _ in requests}:
        spent = 0.0
        for _, seq, prompt in sorted(x for x in requests if x[0] == run):
            if spent >= cap:
                log[run, seq, 0] = (False, 0, spent, True)
                break
            before, done = spent, False
            for attempt in (1, 2):
                kind, tokens = script[prompt][attempt - 1]
                tokens = tokens if kind in ("good", "bad") else 0
                spent += tokens * TH.COST_PER_PROMPT_TOKEN + 2 * tokens * TH.COST_PER_COMPLETION_TOKEN
                log[run, seq, attempt] = (kind == "good", tokens, before, False)
                if kind == "good":
                    done = True
                    break
            if not done:
                break
    return log


@pytest.mark.parametrize("batch", [256, 1])
def test_rounds_equal_one_call_after_the_other(spark, batch):
    rng = random.Random(batch)
    requests, script = [], {}
    for run in range(30):
        for seq in range(rng.randint(1, 7)):
            prompt = f"{run}/{seq}"
            requests.append((f"run-{run}", 10 * seq, prompt))
            kinds = ["good"] * 6 + ["bad", "none"] + (["raise"] if batch == 1 else [])
            script[prompt] = [(rng.choice(kinds), rng.randint(0, 60_000)) for _ in range(2)]
    df = spark.createDataFrame(requests, "run_id string, seq int, prompt string").repartition(3)
    cap = 0.25
    want = one_by_one(requests, script, cap)
    got = M.run_requests(df, scripted(script), cap=cap, batch=batch)
    rows = {(r["run_id"], r["seq"], r["attempt"]): r for r in got.collect()}
    assert rows.keys() == want.keys()
    for key, (ok, tokens, spent, refused) in want.items():
        r = rows[key]
        assert (r["ok"], r["prompt_tokens"], r["refused"]) == (ok, tokens, refused)
        assert abs(r["spent_before"] - spent) < 1e-9
    assert any(r[3] for r in want.values()) and any(k[2] == 2 for k in want)
    # The log's spend is that of W6 over the calls, and its metrics those of A7.
    metrics = {r["run_id"]: r for r in M.call_metrics(got).collect()}
    costs = {r["run_id"]: r for r in TH.llm_cost(got.where("not refused")).collect()}
    for run, m in metrics.items():
        mine = {k: v for k, v in want.items() if k[0] == run}
        assert m["retries"] == sum(not v[0] and not v[3] for v in mine.values()) == costs[run]["retries"]
        assert m["refused"] == any(v[3] for v in mine.values())
        assert m["llm_calls"] == sum(script[f"{run[4:]}/{k[1] // 10}"][k[2] - 1][0] in ("good", "bad") for k in mine if k[2])
        assert abs(m["llm_cost_usd"] - costs[run]["llm_cost_usd"]) < 1e-9


def test_model_that_raises_fails_its_batch(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")], "run_id string, seq int, prompt string").coalesce(1)
    script = {"x": [("raise", 1), ("good", 1)], "y": [("good", 1), ("bad", 5)], "z": [("good", 1), ("good", 1)]}
    rows = {(r["run_id"], r["seq"], r["attempt"]): (r["ok"], r["answered"]) for r in M.run_requests(df, scripted(script)).collect()}
    assert rows == {("a", 1, 1): (False, False), ("b", 1, 1): (False, False), ("a", 1, 2): (True, True), ("b", 1, 2): (False, True)}


def test_no_requests_and_wrong_number_of_answers(spark):
    df = spark.createDataFrame([("a", 1, "x")], "run_id string, seq int, prompt string")
    log = M.run_requests(df.limit(0), scripted({}))
    assert log.count() == 0 and M.call_metrics(log).count() == 0
    with pytest.raises(Exception, match="answers"):
        M.run_requests(df, lambda prompts, attempt: [])


def test_requests_to_themes(spark):
    """Label requests through a model to parsed themes: the log is what L4 reads."""
    req = spark.createDataFrame([("r", f"c{k}", k, f"phrases {k}") for k in range(5)], "run_id string, cluster_id string, seq int, prompt string")
    log = M.run_requests(req, lambda ps, a: [('{"label": "L%s"}' % p[-1] if a == 2 or p[-1] != "3" else "oops", 10, 5) for p in ps])
    answers = log.join(req.select("run_id", "seq", "cluster_id"), ["run_id", "seq"])
    themes = TH.first_good_attempt(TH.parse_label_responses(answers.drop("ok")), ["run_id", "cluster_id"])
    assert {(r["cluster_id"], r["label"], r["attempt"]) for r in themes.collect()} == {
        (f"c{k}", f"L{k}", 2 if k == 3 else 1) for k in range(5)}
    assert log.agg(F.sum("cost")).first()[0] > 0
