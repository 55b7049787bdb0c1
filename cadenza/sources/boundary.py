"""What lies outside the engine, as functions handed in.

Media decoding, speech recognition and language models are no part of Spark.
Each comes in as a plain function that Arrow batches of rows pass through, and
what it returns is an ordinary table that the operators take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def provided(rows: DataFrame, call: Callable[[dict], list[dict]], schema: StructType | str) -> DataFrame:
    """``call`` on each row, its records as rows: segments of a sound, boxes of a frame, fields of a probe."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_pylist([x for r in batch.to_pylist() for x in call(r)], schema=arrow)

    return rows.mapInArrow(run, kind)


def completed(prompts: DataFrame, model: Callable[[str], str], fallback: Callable[[str], str] | None = None) -> DataFrame:
    """``prompts`` (``prompt`` and more) with ``reply`` and ``error``: the model's, else the fallback's, else none."""
    columns = prompts.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            replies, errors = [], []
            for prompt in batch.column(columns.index("prompt")).to_pylist():
                reply, error = None, None
                for one in (model, fallback):
                    if one is None:
                        continue
                    try:
                        reply = one(prompt or "")
                        break
                    except Exception as e:  # noqa: BLE001  whatever the model raises is data here
                        error = error or str(e)
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*columns, "reply", "error"])

    types = dict(prompts.dtypes)
    return prompts.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", reply string, error string")


def echo(prompt: str) -> str:
    """A model for tests: what stands after the prompt's first blank line."""
    return prompt.split("\n\n", 1)[-1]
