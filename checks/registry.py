"""All registered queries by operator id."""

from __future__ import annotations

from functools import partial

from checks import answers, quality, storage, structure, workload_sql
from orderlore.plans import workload


def queries() -> dict:
    return {
        **{key: partial(workload.answer, key) for key in workload.QUESTIONS},
        **quality.queries(),
        **answers.queries(),
        **structure.queries(),
        **storage.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {**workload_sql.SQL, **quality.SQL, **answers.SQL, **structure.SQL, **storage.SQL}
