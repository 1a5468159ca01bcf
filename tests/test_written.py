"""What queries write on the way, and how much their plans send to the driver."""

from pathlib import Path

from quotalens.operators import ranking
from quotalens.plans import bindings
from quotalens.session import shared_folder


def test_rendered_lines_are_written_compressed(spark, monkeypatch):
    monkeypatch.setattr(bindings, "LINES_PER_FILE", 100)
    before = set(Path(shared_folder(spark)).glob("lines-*"))
    lines = bindings.rendered_lines(spark, "/root/testdata/sf0.001")
    made = (set(Path(shared_folder(spark)).glob("lines-*")) - before).pop()
    count, parts = lines.count(), list(made.glob("part-*"))
    assert sum(p.stat().st_size for p in parts) < count * 1330 / 8
    assert len(parts) >= count / 100  # a compressed file is read by one task, so none grows with the input
    assert lines.select("pos").distinct().count() == count


def test_slices_of_a_ranking_are_bounded():
    assert ranking.slices_for(108_000_000, 1_000) <= 2_000
    assert ranking.slices_for(50_000, 1_000) == 50
