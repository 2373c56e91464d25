"""Text generation as a distributed batch step: the only place where Python sees rows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generator = Callable[[list[str]], list[str]]
GeneratorFactory = Callable[[], Generator]

_loaded: dict[object, Generator] = {}
_loading = threading.Lock()


def _load_once(key: object, factory: GeneratorFactory) -> Generator:
    """A Python worker is reused by many tasks; it builds its generator for the first one."""
    with _loading:
        if key not in _loaded:
            _loaded[key] = factory()
        return _loaded[key]


def _answer(generator: Generator, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(text, error) per prompt. A failing batch is retried row by row to isolate the bad rows."""
    try:
        texts = generator(prompts)
        if len(texts) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts gave {len(texts)} texts")
        return [(text, None) for text in texts]
    except Exception as failure:
        if len(prompts) == 1:
            return [(None, str(failure))]
        return [_answer(generator, [prompt])[0] for prompt in prompts]


def generate(
    df: DataFrame,
    factory: GeneratorFactory,
    name: str,
    prompt: str = "prompt",
    batch_size: int = 64,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``generation`` and ``generate_error``; rows with a null prompt are passed by.

    ``name`` identifies the generator within a worker. Only the prompt column crosses to Python;
    the other columns stay in the JVM and are neither shuffled nor joined back. ``partitions``
    spreads the rows evenly over the devices when the input has fewer or uneven partitions.
    The result is expensive: write it to a table before running several actions on it.
    """

    @F.pandas_udf("generation string, generate_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generator = _load_once(name, factory)
        for prompts in batches:
            asked = [row for row, text in enumerate(prompts) if text is not None]
            texts: list[str | None] = [None] * len(prompts)
            errors: list[str | None] = [None] * len(prompts)
            for start in range(0, len(asked), batch_size):
                rows = asked[start : start + batch_size]
                answers = _answer(generator, [prompts.iloc[row] for row in rows])
                for row, (text, error) in zip(rows, answers, strict=True):
                    texts[row], errors[row] = text, error
            yield pd.DataFrame({"generation": texts, "generate_error": errors}, dtype=object)

    # Nondeterministic for the optimizer: it must neither repeat the call nor move filters past it.
    run = run.asNondeterministic()
    if partitions:
        df = df.repartition(partitions)
    return (
        df.withColumn("_generated", run(F.col(prompt)))
        .withColumns(
            {
                "generation": F.col("_generated.generation"),
                "generate_error": F.col("_generated.generate_error"),
            }
        )
        .drop("_generated")
    )
