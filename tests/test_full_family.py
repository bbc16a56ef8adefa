"""The incremental index uses the full family of sketches."""

import os

import pytest

from tests.conftest import TESTDATA

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")


def test_stream_has_the_full_family(spark, monkeypatch):
    from wordmosaic.plans import catalogue
    from wordmosaic.streaming.sketch_index import SketchIndex

    made = []

    class Spy(SketchIndex):
        def __init__(self, folder, family):
            made.append(family)
            super().__init__(folder, family)

    monkeypatch.setattr(catalogue, "SketchIndex", Spy)
    assert catalogue.seen_before_stream(spark, TESTDATA).count() > 0
    assert made == [catalogue.FULL]
