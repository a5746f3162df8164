import pytest
from pyspark.sql import functions as F

from scriptloom.functions.prompts import TEMPLATES, build_prompt
from scriptloom.operators.complete import complete, equal_shares, read_ledger

ASKED = "asked.txt"


def counting_backend(folder, fail=()):
    """Answers in upper case and notes each prompt in a file."""

    def factory():
        def answer(prompts):
            if any(p in fail for p in prompts):
                raise RuntimeError("no")
            with open(f"{folder}/{ASKED}", "a") as log:
                log.writelines(f"{p}\n" for p in prompts)
            return [p.upper() for p in prompts]

        return answer

    return factory


def asked(folder):
    path = folder / ASKED
    return sorted(path.read_text().split()) if path.exists() else []


def rows(spark, *prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string")


def answers(frame):
    return [(r.response, r.error) for r in sorted(frame.collect(), key=lambda r: r.id)]


def test_each_prompt_is_asked_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    backend = counting_backend(tmp_path)
    result = complete(rows(spark, "a", "b", "a", None, "a"), backend, ledger)
    assert result.columns == ["id", "prompt", "response", "error"]
    assert answers(result) == [("A", None), ("B", None), ("A", None), (None, None), ("A", None)]
    assert answers(result)[0] == ("A", None)
    assert asked(tmp_path) == ["a", "b"]
    assert answers(complete(rows(spark, "b", "c"), backend, ledger)) == [("B", None), ("C", None)]
    assert asked(tmp_path) == ["a", "b", "c"]


def test_failures_stay_with_their_row_and_are_retried(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    frame = rows(spark, "a", "bad", "c", "bad")
    first = complete(frame, counting_backend(tmp_path, fail=("bad",)), ledger, parallelism=1)
    assert answers(first) == [("A", None), (None, "RuntimeError: no"), ("C", None), (None, "RuntimeError: no")]
    second = complete(frame, counting_backend(tmp_path), ledger)
    assert answers(second) == [("A", None), ("BAD", None), ("C", None), ("BAD", None)]
    assert asked(tmp_path) == ["a", "bad", "c"]
    assert read_ledger(spark, ledger).count() == 3


def test_wrong_number_of_replies_is_an_error(spark, tmp_path):
    def short():
        return lambda prompts: []

    result = answers(complete(rows(spark, "a", "b"), short, str(tmp_path / "l")))
    assert all(r[0] is None and "0 replies" in r[1] for r in result)


def test_hot_prompt_reaches_every_row(spark, tmp_path):
    frame = spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("prompt"),
    )
    result = complete(frame, counting_backend(tmp_path), str(tmp_path / "l"), hot_rows=1000)
    assert "__salt" in result._jdf.queryExecution().optimizedPlan().toString()
    assert result.count() == 6000
    assert result.where(F.col("response") == F.upper("prompt")).count() == 6000
    assert len(asked(tmp_path)) == 51


def test_models_do_not_share_answers(spark, tmp_path):
    ledger = str(tmp_path / "ledger")

    def says(word):
        return lambda: lambda prompts: [f"{word} {p}" for p in prompts]

    frame = rows(spark, "a", "b")
    assert answers(complete(frame, says("one"), ledger, model="m1")) == [("one a", None), ("one b", None)]
    assert answers(complete(frame, says("two"), ledger, model="m2")) == [("two a", None), ("two b", None)]
    assert answers(complete(frame, says("three"), ledger, model="m1")) == [("one a", None), ("one b", None)]
    assert answers(complete(frame, says("four"), ledger)) == [("four a", None), ("four b", None)]


def test_a_frame_of_prompts_alone(spark, tmp_path):
    frame = rows(spark, "a", None, "a").select("prompt")
    found = complete(frame, counting_backend(tmp_path), str(tmp_path / "l")).collect()
    assert sorted(str(r.response) for r in found) == ["A", "A", "None"]


@pytest.mark.parametrize("task", sorted(TEMPLATES))
def test_prompts_hold_the_script_between_tags(spark, task):
    body = "SELECT 1 -- <b>\n"
    text = spark.createDataFrame([(body,)], "b string").select(build_prompt(task, F.col("b"))).first()[0]
    assert f"<context>\n{body}\n</context>" in text
    assert len(TEMPLATES) == 10


def test_slow_and_flaky_calls_are_answered_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def factory():
        import random
        import threading
        import time

        lock, tries, now = threading.Lock(), {}, [0]

        def answer(prompts):
            with lock:
                now[0] += 1
                busiest = now[0]
                for p in prompts:
                    tries[p] = tries.get(p, 0) + 1
            time.sleep(random.random() / 200)
            with lock:
                now[0] -= 1
            if any(hash(p) % 3 == 0 and tries[p] < 3 for p in prompts):
                raise TimeoutError("busy")
            with lock, open(log / "answered", "a") as file:
                file.writelines(f"{busiest} {p}\n" for p in prompts)
            return [p.upper() for p in prompts]

        return answer

    frame = spark.createDataFrame([(k, f"prompt{k % 150}") for k in range(300)], "id int, prompt string")
    options = dict(parallelism=2, batch_size=1, in_flight=4, attempts=4, backoff=0.001)
    got = complete(frame, factory, str(tmp_path / "l"), **options).collect()
    assert len(got) == 300 and all(r.response == r.prompt.upper() and r.error is None for r in got)
    lines = [line.split() for line in (log / "answered").read_text().splitlines()]
    assert sorted(p for _, p in lines) == sorted(f"prompt{k}" for k in range(150))
    assert 2 <= max(int(b) for b, _ in lines) <= 4


def test_tasks_get_shares_of_equal_cost(spark):
    import random

    rng = random.Random(2)
    rows = [(f"{rng.getrandbits(64):016x}", "x" * int(rng.paretovariate(1.2) * 20 % 4000)) for _ in range(2000)]
    prompts = spark.createDataFrame(rows, "prompt_hash string, prompt string")
    dealt = equal_shares(prompts, 8).withColumn("task", F.spark_partition_id())
    costs = [r.cost for r in dealt.groupBy("task").agg(F.sum(F.length("prompt") + 200).alias("cost")).collect()]
    assert len(costs) == 8 and dealt.count() == 2000
    assert max(costs) < 1.1 * sum(costs) / 8
    one = equal_shares(prompts.limit(1), 8)
    assert one.count() == 1 and equal_shares(prompts.limit(0), 3).count() == 0
