"""Wide tables take their columns from the data."""

import pytest

from vigil.operators import shape


def test_wide_keeps_every_series(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 2.0), (2, "new", 3.0), (2, None, 9.0)], "ts int, sensor string, value double")
    names = shape.series_names(df)
    assert names == ["a", "b", "new"]
    wide = shape.to_wide(df, names)
    assert wide.columns == ["ts", "a", "b", "new"]
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 2.0, 1.0, None), (2, None, None, 3.0)]
    assert shape.series_names(df.limit(0)) == []
    with pytest.raises(ValueError):
        shape.series_names(df, most=2)
