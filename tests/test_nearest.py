import math
import random

import pytest

from paperloom.sources.pdf import nearest_labels

FAR, NAN = float("inf"), float("nan")


def brute(marks, labels, reach):
    out = {}
    for page, mark, x in marks:
        for p, label, lx in labels:
            if page is not None and p == page and x is not None and lx is not None and math.isfinite(x) and math.isfinite(lx) and abs(x - lx) <= reach:
                out[mark] = min(out.get(mark, (FAR, 0)), (abs(x - lx), label))
    return {m: (label, gap) for m, (gap, label) in out.items()}


def tables():
    rng = random.Random(3)
    places = [round(rng.uniform(-1000, 1000), 1) for _ in range(300)]
    # Next to the reach and to a strip's edge, beyond all strips, tiny ones whose gaps are the same double, equal ones, and none at all.
    odd = [300.0, -1e-20, 0.0, 1e-20, 3e-20, -0.0, 290.0, 375.0, 375.0, 1e300, 1e300, -FAR, FAR, NAN, None, 74.99999999999999, 374.99999999999994]
    sides = [[(page, n, x) for n, (page, x) in enumerate([(rng.choice([1, 2, None]), rng.choice(places)) for _ in range(150)] + [(p, x) for p in (3, 4) for x in some])] for some in (odd, odd[::-1])]
    sides[0] += [(5, 1000, 290.0), (6, 1001, 300.0)]
    sides[1] += [(5, 2000, 3e-20), (5, 1999, 1e-20), (5, 2001, 600.0), (6, 2002, -1e-20)]
    return sides


@pytest.mark.parametrize("reach", [300.0, 0.0, 0.1])
def test_nearest_label_agrees_with_all_pairs(spark, reach):
    marks, labels = tables()
    found = nearest_labels(spark.createDataFrame(marks, "page int, mark long, x double"), spark.createDataFrame(labels, "page int, label long, x double"), reach)
    assert {r.mark: (r.label, r.gap) for r in found.collect()} == brute(marks, labels, reach)


def test_nearest_label_makes_no_pairs(spark):
    marks, labels = tables()
    found = nearest_labels(spark.createDataFrame(marks, "page int, mark long, x double"), spark.createDataFrame(labels, "page int, label long, x double"), 300.0)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
