"""User code on rows (U1) and per-worker initialisation (U4).

Both run on Arrow batches: ``map_rows`` through ``mapInArrow``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from vqaframe.session import ship_package

_WORKER_OBJECTS: dict = {}


def factory_key(factory: Callable) -> str:
    """Digest of the factory as it is sent to the workers."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def per_worker(factory: Callable, key=None):
    """U4: build ``factory()`` once per Python worker process and reuse it.

    Spark reuses Python workers across tasks, so an expensive object (a
    model, a tokenizer) is loaded once per worker, not once per row. The
    cache key is a digest of the pickled factory, captured values and partial
    arguments included, so two factories never share an object; callers work
    it out once on the driver (``factory_key``).
    """
    if key is None:
        key = factory_key(factory)
    obj = _WORKER_OBJECTS.get(key)
    if obj is None:
        obj = factory()
        _WORKER_OBJECTS[key] = obj
    return obj


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema,
             init: Callable | None = None) -> DataFrame:
    """Apply ``fn(row_dict[, state]) -> dict`` to every row.

    Values reach ``fn`` as Python objects of their exact type (nulls as
    None); keys it leaves out become null. Prefer column
    expressions; use this only for code that has no JVM equivalent.
    """
    ship_package(df.sparkSession)
    st = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(st)
    key = factory_key(init) if init is not None else None

    def run(batches):
        state = per_worker(init, key) if init is not None else None
        for batch in batches:
            out = [fn(r, state) if init is not None else fn(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
    return df.mapInArrow(run, st)
