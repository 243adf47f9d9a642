"""Saved tables of the operators."""

from __future__ import annotations

import os

from folioforge.llm.workspace import Workspace


def test_saved_tables_have_data_files_only(spark):
    """A marker file would make the driver start processes, which count as its memory."""
    ws = Workspace(spark, "test")
    saved = ws.save(spark.range(5), "numbers")
    names = os.listdir(saved._folio_path.removeprefix("file:"))
    assert sorted(r["id"] for r in saved.collect()) == list(range(5))
    assert all(n.strip(".").startswith("part-") for n in names)
