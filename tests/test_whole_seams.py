"""The seams of joint_context come from the whole tally, also of joints that are no multiple of four."""

from integrity_spark.operators import joints as J
from integrity_spark.plans.dig_queries import joint_context, seam_matrix
from integrity_spark.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def test_context_takes_the_whole_tally(spark):
    assert seam_matrix(spark, SF).count() == view(spark, SF, "pipe_tally").count()
    hours = {}
    for r in view(spark, SF, "pipe_tally").collect():
        h, m = r.seam_raw.split(":")
        at = hours.setdefault(r.line_id, {})
        at[r.joint_number] = min(at.get(r.joint_number, 99.0), int(h) + int(m) / 60)
    rows = [r for r in joint_context(spark, SF).collect() if r.joint_source is not None]
    assert any(r.gwd % 4 and r.gwd in hours[r.program_id] for r in rows)
    for r in rows:
        near = min(hours[r.program_id], key=lambda j: (abs(j - r.gwd), j))
        assert r.seam_hours == (hours[r.program_id][near] if abs(near - r.gwd) <= J.GWD_REACH else None)
