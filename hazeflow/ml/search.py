"""Grid search in shared passes over the training blocks.

Settings are models that grow together, boosters those of all folds: each in a task, or a level of all of them as one aggregate (see ``trees``). What is the same is grown once:

* Boosting's first n rounds are the model of n rounds, so one model per (rate, depth, share) serves every number of rounds.
* A forest's splits do not depend on how deep its trees may go or which nodes are too small to split: one forest per fold, grown to the loosest limits, serves
  all settings by stopping its trees earlier. Its first n trees are the forest of n trees.
* The fit on all training rows is one more "fold" that holds nothing out, so the best setting needs no fit of its own.

Trees do not care about the scale of an input; nothing is standardised here.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame

from ..schema import LABEL_COL
from .forest import held_out_errors, write_forest
from .metrics import METRICS, regression_metrics
from .scaling import model_columns
from .split import with_fold
from .trees import NO_FOLD, Growth, Spec, TreeModel, bin_edges, blocks
from .tuning import ALONG, BOOSTED_GRID, FOLDS, FOREST_GRID

# Settings that a grid does not name.
DEFAULTS = {
    "forest": {"numTrees": 100, "maxDepth": None, "minSamplesSplit": 2},
    "boosted": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 1.0},
}


def _settings(kind: str, grid: dict) -> list[dict]:
    unknown = set(grid) - set(DEFAULTS[kind])
    if unknown:
        raise ValueError(f"no settings of this search: {sorted(unknown)}")
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _plan(kind: str, settings: list[dict], folds: list[int]) -> tuple[list[Spec], dict[tuple[int, int], tuple[int, int, int | None, int]]]:
    """(models to grow, (setting, fold) -> variant of one of them)."""
    full = [{**DEFAULTS[kind], **s} for s in settings]
    most = max(s[ALONG[kind]] for s in full)
    specs: dict[tuple, int] = {}
    variants = {}
    for i, s in enumerate(full):
        for fold in folds:
            if kind == "forest":
                depths = [x["maxDepth"] for x in full]
                spec = Spec(most, None if None in depths else max(depths), least_rows=min(x["minSamplesSplit"] for x in full), forest=True, fold=fold)
                rest = (s["maxDepth"], s["minSamplesSplit"])
            else:
                spec = Spec(most, s["maxDepth"], s["stepSize"], s["subsamplingRate"], fold=fold)
                rest = (None, 2)
            variants[i, fold] = (specs.setdefault(spec, len(specs)), s[ALONG[kind]], *rest)
    return list(specs), variants


def r2_of(sse: float, sy: float, syy: float, n: int) -> float:
    """1.0 or 0.0 for a label that does not vary, as in ``regression_metrics``; NaN without rows."""
    spread = syy - sy * sy / n if n else float("nan")
    return 1.0 - sse / spread if spread > 0 else float("nan") if not n else float(sse == 0)


def grid_search(train: DataFrame, test: DataFrame, kind: str, grid: dict | None = None, folds: int = FOLDS) -> tuple[TreeModel, dict, list]:
    """(best model, metrics on test, results): results has (setting, mean R2 over the folds), best first among equals.

    Rows with a missing input or label are left out of training and measuring.
    """
    cols = model_columns()
    settings = _settings(kind, grid or (FOREST_GRID if kind == "forest" else BOOSTED_GRID))
    usable = train.dropna(subset=[*cols, LABEL_COL])
    edges = bin_edges(usable, cols)
    stored = blocks(with_fold(usable, folds), cols, edges, "fold")
    specs, variants = _plan(kind, settings, [*range(folds), NO_FOLD])
    scores = {}
    # Forests are grown in a few jobs, so one fold's after the other: their nodes need not be held together, those of large ones not at all. Boosters all grow in one job, or share many.
    for some in [[i] for i in range(len(specs))] if kind == "forest" else [[*range(len(specs))]]:
        grown = Growth(stored, [specs[i] for i in some], len(cols))
        own = {k: (some.index(v[0]), *v[1:]) for k, v in variants.items() if v[0] in some}
        measured = [k for k in own if k[1] != NO_FOLD]
        if not (large := grown.is_large_forest()):
            grown = grown.grow_apart() if grown.fits_apart() else grown.grow()
        if measured:
            wanted = [own[k] for k in measured]
            errors = held_out_errors(grown, wanted) if large else grown.squared_errors(stored, wanted)
            scores.update(zip(measured, (r2_of(*e) for e in errors)))
    # The models of all training rows came last, or with all others.
    results = [(s, sum(scores[i, f] for f in range(folds)) / folds) for i, s in enumerate(settings)]
    best = max(range(len(settings)), key=lambda i: results[i][1])
    index, trees, depth, least = own[best, NO_FOLD]
    model = write_forest(grown, cols, edges, trees, depth, least) if large else grown.model(index, cols, edges, trees, depth, least)
    row = regression_metrics(model.transform(test), LABEL_COL).first()
    return model, {m: row[m] for m in METRICS}, results
