"""Every query of this subpackage over empty tables, and over rows of nulls beside columns with clashing names."""

from datetime import UTC, datetime

import pytest

from lakemill.llm.queries import R
from tests.conftest import rows
from tests.tables import SCHEMAS, write


@pytest.mark.parametrize("nulls", [False, True], ids=["empty", "nulls"])
def test_queries_on_bare_tables(spark, tmp_path, nulls):
    sf = write(spark, tmp_path / "sf", nulls)
    for name, q in R.queries.items():
        n = q(spark, sf).count()
        # documents of nulls are items of size 0, in one container
        assert n == ({"p8_pieces": 2, "p8_containers": 1}.get(name, 0) * nulls + (name in ("p8_rules", "p10_rules"))), name


def test_batches_through_history_are_like_all_at_once(spark, tmp_path):
    at = lambda i: 1_704_067_200 + (i * 7919) % 90
    data = [(i, i // 40 or None, f"sensor-{i % 2 + 1}", at(i), 20.0, 50.0, None, datetime.fromtimestamp(at(i), UTC).replace(tzinfo=None)) for i in range(160)]
    spark.createDataFrame(data, SCHEMAS["sensor_reading"]).write.parquet(str(tmp_path / "sensor_reading.parquet"))
    found = rows(R.queries["p5_found"](spark, str(tmp_path)), "kept_id", "duplicate_id")
    assert len(found) > 60 and rows(R.queries["p5_history"](spark, str(tmp_path)), "kept_id", "duplicate_id") == found
