"""Boxes at the same place meet once."""

from casewright.operators import intervals

BOXES = "form long, id long, x0 double, y0 double, x1 double, y1 double"


def test_boxes_at_one_place_meet_once(spark, monkeypatch):
    asked = [(1, i, 0.0, 0.0, 40.0, 10.0) for i in range(30)] + [(1, 90, 0.0, 200.0, 40.0, 210.0), (2, 91, 0.0, 0.0, 40.0, 10.0), (1, 92, None, 0.0, 40.0, 10.0)]
    given = [(1, i, 60.0, 0.0, 100.0, 10.0) for i in range(30)]
    met, near = [], intervals._near

    def counted(left, right, *more):
        met.append((left.count(), right.count()))
        return near(left, right, *more)

    monkeypatch.setattr(intervals, "_near", counted)
    out = intervals.without_near_answer(spark.createDataFrame(asked, BOXES), spark.createDataFrame(given, BOXES))
    assert sorted(r["id"] for r in out.collect()) == [90, 91, 92]
    assert met == [(4, 1), (4, 1)]
