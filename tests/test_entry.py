"""The entry module works with and without the training-data subpackage."""

from __future__ import annotations

import importlib
import sys
import warnings

import __spark_entry__ as entry
from framewright import queries as own


def names(gone: dict[str, None]) -> set[str]:
    """Queries where modules can't be imported."""
    before = {k: v for k, v in sys.modules.items() if k == "corpus_pipeline" or k.startswith("framewright.llm") or k in gone}
    for k in before:
        del sys.modules[k]
    sys.modules.update(gone)
    package = sys.modules["framewright"]
    held = package.__dict__.pop("llm", None)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return set(importlib.reload(entry).queries())
    finally:
        for k in gone:
            sys.modules.pop(k, None)
        sys.modules.update(before)
        if held is not None:
            package.llm = held
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            importlib.reload(entry)


def test_other_queries_do_without_the_subpackage():
    for gone in ("framewright.llm", "framewright.llm.queries", "public_tokenizers", "ahocorasick"):
        assert names({gone: None}) == set(own.QUERIES)


def test_a_missing_pipeline_takes_nothing_else():
    assert set(own.QUERIES) <= names({"corpus_pipeline": None})
