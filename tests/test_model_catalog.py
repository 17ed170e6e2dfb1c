"""The registered model queries run at the published settings and folds."""

import inspect

from catalog import model as C
from hazardframe.operators import model as L
from hazardframe.plans.training import train_models


class Called(Exception):
    """Carries what a fitting function was called with, in place of its work."""


def called(monkeypatch, query, owner, name):
    signature = inspect.signature(getattr(owner, name))

    def note(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(owner, name, note)
    for loader in ("trainable", "_train"):
        monkeypatch.setattr(C, loader, lambda spark, sf_dir: "rows")
    try:
        query(None, "")
    except Called as call:
        return call.args[0]
    raise AssertionError(f"{name} was not called")


def test_published_settings(spark, monkeypatch):
    got = called(monkeypatch, C.model_comparison, C, "train_models")
    assert (got["folds"], got["settings"]) == (5, None) and train_models is not C.train_models
    got = called(monkeypatch, C.search_results, L, "search")
    assert (got["space"], got["trials"], got["folds"]) == (L.SEARCH_SPACES["level_wise"], 30, 5)
    got = called(monkeypatch, C.learning_curve, L, "learning_curve")
    assert (len(got["sizes"]), got["folds"]) == (8, 3)
    assert got["classifier"].getNumTrees() == L.FOREST["numTrees"] == 300


def test_comparison_fits_on_all_training_rows(spark, monkeypatch):
    got = called(monkeypatch, C.model_comparison, C, "train_models")
    assert (got["labelled_rows"], got["leak_free"]) == (None, True)
