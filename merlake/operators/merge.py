"""Merging indexes side by side, and renaming samples."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .index import Index


def renamed(samples: tuple[str, ...], form: str | None = None, ids: list[str] | None = None, start: int = 0) -> tuple[str, ...]:
    """New ids for samples: ``form`` with ``{}`` for the number, from ``start``; or ``ids`` in order."""
    if ids is not None:
        if len(ids) != len(samples):
            raise ValueError(f"{len(ids)} ids for {len(samples)} samples")
        out = tuple(ids)
    elif form is not None:
        if "{}" not in form:
            raise ValueError("the form needs a {}")
        out = tuple(form.replace("{}", str(start + k)) for k in range(len(samples)))
    else:
        out = samples
    if len(set(out)) < len(out):
        raise ValueError("sample ids must differ")
    return out


def conflicts(indexes: list[Index]) -> list[str]:
    """Sample ids that occur in more than one place."""
    seen: dict[str, int] = {}
    for index in indexes:
        for s in index.samples:
            seen[s] = seen.get(s, 0) + 1
    return sorted(s for s, n in seen.items() if n > 1)


def merge(indexes: list[Index], form: str | None = None, ids: list[str] | None = None) -> Index:
    """All samples of indexes with equal parameters in one index.

    Samples keep their order; rows only get a higher sample number, so nothing is joined.
    Ids that clash are an error unless the samples are renamed.
    """
    if not indexes:
        raise ValueError("nothing to merge")
    if len({i.params for i in indexes}) > 1:
        raise ValueError("indexes of different parameters can't be merged")
    samples = tuple(s for i in indexes for s in i.samples)
    if form is None and ids is None and (same := conflicts(indexes)):
        raise ValueError(f"sample ids in several indexes: {', '.join(same[:5])}; rename them")
    rows, offset = None, 0
    for index in indexes:
        own = index.rows.withColumn("sample_idx", (F.col("sample_idx") + offset).cast("int"))
        rows = own if rows is None else rows.unionByName(own)
        offset += len(index.samples)
    order = "split" if all(i.order for i in indexes) else ""
    return replace(indexes[0], samples=renamed(samples, form, ids), rows=rows, order=order)
