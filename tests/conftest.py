import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_spark
    s = get_spark("local[*]", app="cohortlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


# Golden calibrated test-set scores of the reference (distinct score, positives, negatives),
# typed from its shipped score and label files: 879 rows, 22 distinct values.
GOLDEN_HIST = [
    (0.0, 0, 10), (0.1, 16, 16), (0.2222222222222222, 18, 27), (0.390777461256887, 1, 0),
    (0.3977272727272727, 23, 49), (0.4695652173913044, 12, 33), (0.5189003436426115, 39, 49),
    (0.5215311004784688, 23, 32), (0.5267791178261774, 0, 1), (0.530011211840625, 0, 1),
    (0.5306122448979592, 1, 4), (0.5575757575757576, 10, 12), (0.5615097853480784, 1, 0),
    (0.6060512886836019, 1, 0), (0.6794871794871794, 21, 13), (0.6831683168316832, 16, 11),
    (0.68504621494981, 1, 0), (0.7678571428571429, 35, 12), (0.7747440273037544, 47, 21),
    (0.7845528455284553, 254, 60), (0.989843519811404, 0, 1), (1.0, 5, 3),
]


@pytest.fixture(scope="session")
def golden_rows(spark):
    rows = []
    i = 0
    for s, pos, neg in GOLDEN_HIST:
        for _ in range(pos):
            rows.append((i, 1, s))
            i += 1
        for _ in range(neg):
            rows.append((i, 0, s))
            i += 1
    return spark.createDataFrame(rows, "row_id long, y_true int, y_prob double")
