"""Accuracy of a generator on gold records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duecall.operators.clean import clean_answers
from duecall.operators.evaluate import align_gold, match_fields
from duecall.operators.generate import GeneratorFactory
from duecall.operators.parse import parse_generations
from duecall.plans.predict import predict

def align_generations(gold: DataFrame, generations: DataFrame, on: str | list[str]) -> DataFrame:
    """Every gold row with the outcome of its generation; ``failed`` where there is none.

    Only generations of gold records are parsed and cleaned: their keys are met with those of the
    gold rows before the first parsing step. Gold sets are small beside a log of generations, and
    the planner then sends their keys to the tasks that read it.
    """
    keys = [on] if isinstance(on, str) else on
    wanted = generations.join(gold.select(*keys).distinct(), keys, "left_semi")
    return align_gold(gold, clean_answers(parse_generations(wanted)), keys)


GOLD_COLUMNS = [
    "language", "id", "transcript", "expected_disposition", "expected_payment_disposition",
    "expected_reason_for_not_paying", "expected_amount", "expected_date",
]


def evaluate(
    gold: DataFrame, factory: GeneratorFactory, name: str, run_date: str
) -> DataFrame:
    """Matched gold rows, ready for every report.

    The predictions carry their gold columns along, so nothing is joined; write the result to a
    table when several reports are made from it, since it holds the generations.
    """
    predicted = predict(gold, "transcript", factory, name, run_date, keep=GOLD_COLUMNS)
    return match_fields(predicted)
