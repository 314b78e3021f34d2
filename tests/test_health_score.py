import itertools

from lodestrata.operators import equipment

#: Their mean is 48; as doubles added from the left it is 47.99999999999999.
VALUES = [46.56, 96.27, 1.17]


def test_whole_mean_in_every_order(spark):
    rows = [(k, v) for k, order in enumerate(itertools.permutations(VALUES)) for v in order]
    found = equipment.health_score(spark.createDataFrame(rows, "equipment_id long, value double").coalesce(1)).collect()
    assert {r.equipment_id: r.score for r in found} == dict.fromkeys(range(6), 48)


def test_other_values(spark):
    rows = [(1, 1e30), (1, 2.0), (2, None), (3, -0.5), (3, -0.25), (4, 202.5), (5, 7.0), (5, None)]
    found = equipment.health_score(spark.createDataFrame(rows, "equipment_id long, value double")).collect()
    assert {r.equipment_id: r.score for r in found if r.equipment_id != 1} == {2: None, 3: -1, 4: 0, 5: 7}
