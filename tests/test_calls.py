"""External calls: shared budget, pause and provider, answers that are never asked for twice."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import calls, raters, vectors


def prompts(spark, n):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "batch int, prompt string")


def notes(path):
    return [line.split() for line in path.read_text().split("\n") if line]


def test_a_throttle_of_one_task_delays_the_others(spark, tmp_path):
    log, flag = str(tmp_path / "calls"), str(tmp_path / "throttled")

    def rater(prompt):
        with open(log, "a") as out:
            out.write(f"{prompt} {time.time()} {os.getpid()}\n")
        time.sleep(0.05)
        if prompt == "p7" and not os.path.exists(flag):
            open(flag, "w").write(str(time.time()))
            raise raters.Throttled
        return "1. O"

    with calls.Gate(spark, 1000, pause=(2.0, 8.0)) as gate:
        got = raters.ask(prompts(spark, 200), rater, gate, wait=0).collect()
        assert {r.status for r in got} == {"ok"} and gate.usage()["throttled"] == 1 and gate.left == 1000 - 201
    began = float(open(flag).read())
    after = [float(t) for _, t, _ in notes(tmp_path / "calls")]
    assert not [t for t in after if began + 0.2 < t < began + 1.9] and max(after) > began + 1.9
    assert len({p for *_, p in notes(tmp_path / "calls")}) > 1  # several tasks were asking
    assert {r.prompt: r.calls for r in got}["p7"] == 2


def test_pauses_grow_until_an_answer(spark, tmp_path):
    log = str(tmp_path / "waits")

    def rater(prompt):
        raise raters.Throttled

    def sleep(seconds):
        with open(log, "a") as out:
            out.write(f"{seconds}\n")
        time.sleep(seconds)

    with calls.Gate(spark, 10, pause=(0.2, 0.5)) as gate:
        asked = raters.ask(prompts(spark, 1), rater, gate, tries=4, sleep=sleep).collect()
        assert [(r.status, r.calls, r.answer) for r in asked] == [("error", 4, None)]
    waits = [float(w) for (w,) in notes(tmp_path / "waits")]
    assert [round(w, 1) for w in waits if w > 0.05] == [0.2, 0.4, 0.5]


def test_a_retry_uses_a_call_that_another_prompt_saved(spark):
    def rater(prompt):
        if prompt in ("p1", "p2"):
            raise OSError
        return "1. O"

    with calls.Gate(spark, 12) as gate:  # ten prompts; each of two takes three calls, and the last ones find none
        got = raters.ask(prompts(spark, 10), rater, gate, tries=3, wait=0).collect()
        assert sum(r.calls for r in got) == 12 and gate.left == 0
        assert {r.status for r in got} == {"ok", "error", "stopped"} and sum(r.status == "stopped" for r in got) <= 2
    with calls.Gate(spark, 30) as gate:
        with pytest.raises(ValueError, match="budget"):
            raters.ask(prompts(spark, 31), rater, gate)
        assert gate.left == 30 and gate.usage() == {}
        raters.ask(prompts(spark, 10), rater, gate, wait=0).collect()
        assert gate.left == 30 - 14
        with pytest.raises(ValueError, match="17 calls, the budget 16"):  # the next plan of the same run
            raters.ask(prompts(spark, 17), rater, gate)


def test_a_task_that_dies_asks_no_prompt_twice(spark, tmp_path):
    log, flag, seen = f"file://{tmp_path}/answers", str(tmp_path / "died"), str(tmp_path / "seen")

    def dying(prompt):
        if os.path.exists(seen) and len(open(seen).readlines()) >= 30 and not os.path.exists(flag):
            open(flag, "w").write("x")
            os._exit(1)
        with open(seen, "a") as out:
            out.write(prompt + "\n")
        return raters.Answer("1. X", 10, 2)

    with calls.Gate(spark, 1000) as gate:
        with pytest.raises(Exception):
            raters.ask(prompts(spark, 80), dying, gate, log=log).collect()
        asked = raters.ask(prompts(spark, 80), dying, gate, log=log)
        first, second = asked.collect(), asked.collect()  # a second action asks nothing
        assert sorted(first) == sorted(second) and {r.status for r in first} == {"ok"}
        assert gate.usage()["calls"] == 81 and gate.usage()["answered"] == 80  # one call died with its task
        row = raters.usage(asked, per_million=(1.0, 5.0)).first()
    every = [p for (p,) in notes(tmp_path / "seen")]
    assert len(every) == len(set(every)) == 80
    assert (row.prompts, row.calls, row.failed, row.tokens_in, row.tokens_out, round(row.cost * 1e6)) == (80, 80, 0, 800, 160, 1600)
    # A later run finds all answers; it has no calls to spend.
    again = raters.ask(prompts(spark, 80), dying, 0, log=log)
    assert again.where("status = 'ok'").count() == 80
    assert calls.Log(log).table(spark, "status string").count() == 80


def test_equal_prompts_are_asked_once_and_errors_by_a_later_run(spark, tmp_path):
    log, seen = f"file://{tmp_path}/answers", str(tmp_path / "seen")

    def failing(prompt):
        with open(seen, "a") as out:
            out.write("x\n")
        raise OSError

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a"] * 5 + ["b", None, ""])], "batch int, prompt string")
    with calls.Gate(spark, 100) as gate:
        bad = raters.ask(rows, failing, gate, log=log, tries=2, wait=0)
        assert bad.agg(F.sum("calls")).first()[0] == 6 and bad.where("status = 'error' and answer is null").count() == 8
    assert len(notes(tmp_path / "seen")) == 6
    good = raters.ask(rows, raters.mock_rater, 3, log=log).collect()
    assert {r.status for r in good} == {"ok"} and sum(r.calls for r in good) == 3
    assert raters.ask(rows.limit(0), raters.mock_rater, 0).count() == 0
    # Torn lines are passed over.
    part = next(p for p in (tmp_path / "answers").rglob("*.jsonl"))
    part.write_text(part.read_text() + '{"key": "torn')
    assert raters.ask(rows, failing, 0, log=log).where("status = 'ok'").count() == 8
    # Another model's answers are others.
    with pytest.raises(ValueError, match="3 calls"):
        raters.ask(rows, raters.mock_rater, 2, log=log, model="other")


def test_all_tasks_move_to_the_next_provider(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def down(prompt):
        with open(seen, "a") as out:
            out.write("x\n")
        time.sleep(0.02)
        raise raters.Unavailable

    with calls.Gate(spark, 1000) as gate:
        got = raters.ask(prompts(spark, 300), [down, raters.mock_rater], gate).collect()
        assert {r.status for r in got} == {"ok"} and gate.usage()["switched"] == 1
    assert len(notes(tmp_path / "seen")) <= 8  # the calls that were under way when the first failed
    with calls.Gate(spark, 1000) as gate:
        got = raters.ask(prompts(spark, 3), [down, down], gate).collect()
        assert {r.status for r in got} == {"error"}


def test_kinds_of_errors():
    kind = raters.classified
    assert {kind(429), kind(529), kind(401, "HTTP 429: limit")} == {raters.Throttled}
    assert {kind(401, "invalid key"), kind(400), kind(404)} == {raters.Refused}
    assert {kind(None), kind(500), kind(503), kind(520)} == {OSError}


def test_usage_is_read_while_tasks_run(spark):
    import threading

    def slow(prompt):
        time.sleep(0.1)
        return raters.Answer("1. O", 3, 1)

    with calls.Gate(spark, 1000) as gate:
        work = threading.Thread(target=lambda: raters.ask(prompts(spark, 60), slow, gate).collect())
        work.start()
        deadline = time.time() + 60
        while not gate.usage().get("tokens_in") and time.time() < deadline:
            time.sleep(0.05)
        assert 0 < gate.usage()["tokens_in"] < 180
        work.join()
        assert gate.usage() == {"calls": 60, "answered": 60, "tokens_in": 180, "tokens_out": 60}


def test_frozen_inputs(spark, tmp_path):
    items = spark.createDataFrame([(i, "O" if i % 2 else "F", f"t{i}") for i in range(50)], "k int, arm string, text string")
    path = f"file://{tmp_path}/plan"
    frozen = raters.freeze(raters.plan(items, "text", ["k"]), path)
    rerun = raters.freeze(raters.plan(items.repartition(3), "text", ["k"]), path)
    assert sorted(r.prompt for r in frozen.collect()) == sorted(r.prompt for r in rerun.collect())
    votes = [raters.judgments(raters.ask(p, raters.mock_rater, 4), ["k", "arm"]) for p in (frozen, rerun)]
    assert votes[1].columns == ["k", "arm", "judgment"] and sorted(votes[0].collect()) == sorted(votes[1].collect())
    with pytest.raises(ValueError, match="differs"):
        raters.freeze(raters.plan(items.where("k <> 7"), "text", ["k"]), path)


def test_embed_commits_each_call(spark, tmp_path):
    log, seen, flag = f"file://{tmp_path}/vectors", str(tmp_path / "seen"), str(tmp_path / "died")

    def embedder(texts):
        if os.path.exists(seen) and len(open(seen).readlines()) >= 8 and not os.path.exists(flag):
            open(flag, "w").write("x")
            os._exit(1)
        with open(seen, "a") as out:
            out.write(" ".join(texts) + "\n")
        return [[float(t[1:]), 1.0] for t in texts]

    df = spark.createDataFrame([(i, f"t{i % 150}") for i in range(200)], "k int, t string")
    run = lambda: vectors.embed(df, "k", "t", embedder, size=10, log=log, shards=3)
    with pytest.raises(Exception):
        run().collect()
    got = run().collect()
    assert sorted((r.k, *r.vector) for r in got) == [(i, float(i % 150), 1.0) for i in range(200)]
    asked = [t for line in notes(tmp_path / "seen") for t in line]
    assert len(asked) == len(set(asked)) == 150 and max(map(len, notes(tmp_path / "seen"))) == 10


def test_quick_calls_are_taken_several_at_once(spark, monkeypatch):
    """Few turns at the gate, no call more than the budget, and none of it left while prompts wait."""
    prompts = spark.range(3000).selectExpr("concat('p', id) as prompt")
    turns, turn = [], calls.Gate._turn
    monkeypatch.setattr(calls.Gate, "_turn", lambda self, *given: turns.append(1) or turn(self, *given))
    with calls.Gate(spark, 100_000) as gate:
        assert {r.status for r in raters.ask(prompts, str.upper, gate).collect()} == {"ok"}
        assert gate.usage() == {"calls": 3000, "answered": 3000, "tokens_in": 0, "tokens_out": 0} and gate.left == 97_000
    assert len(turns) < 1500

    def fails(prompt: str) -> str:
        if prompt.endswith("7"):
            raise OSError
        return prompt

    with calls.Gate(spark, 3100) as gate:  # 300 prompts want three calls each
        got = raters.ask(prompts, fails, gate, sleep=lambda s: None).collect()
        assert gate.left == 0 and gate.usage()["calls"] == 3100 == sum(r.calls for r in got)
