"""Samples bounded by a hash keep their size whatever the size of the table."""

import pytest

from arealis.llm.common import HASHES, bounded_sample, sample_bound


@pytest.mark.parametrize("n", [1_000, 10**9, 10**12])
def test_bound_keeps_the_wanted_share_at_every_size(n):
    assert sample_bound(128, n) / HASHES == pytest.approx(128 / n)


def test_sample_has_about_the_wanted_rows(spark):
    df = spark.range(200_000)
    assert 800 < bounded_sample(df, "id", 1_000).count() < 1_200
    assert bounded_sample(df, "id", 200_000).count() == 200_000
