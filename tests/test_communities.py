"""The community command on CSV files with text ids."""

import csv
import glob

import pytest

from citeloom import communities
from citeloom.cli import LogFormat


def test_command(spark, tmp_path):
    def write(name, rows):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f).writerows(rows)

    a, b = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    edges = [(x, y) for part in (a, b) for i, x in enumerate(part) for y in part[:i]]
    write("nodes.csv", [("id", "x"), *((n, 1) for n in [*a, *b, "lone"])])
    write("edges.csv", [("s", "t"), *edges, ("a0", "b0"), ("a1", "nobody")])
    args = ["--nodelist", str(tmp_path / "nodes.csv"), "--edgelist", str(tmp_path / "edges.csv"), "--output", str(tmp_path / "out"), "--node_col", "id", "--source_col", "s", "--target_col", "t", "--resolution", "0.3"]
    assert communities.main(args) == 0
    rows = {r["node_id"]: r["cluster_id"] for p in glob.glob(f"{tmp_path}/out/part*") for r in csv.DictReader(open(p))}
    assert len({rows[x] for x in a}) == len({rows[x] for x in b}) == 1 and len({*rows.values()}) == 3 and len(rows) == 11
    with pytest.raises(ValueError, match="no column"):
        communities.main([*args[:6], "--node_col", "nope"])


def test_log_lines_show_elapsed_time():
    import logging

    record = logging.LogRecord("x", logging.INFO, "f", 1, "hello", None, None)
    record.relativeCreated = 3_661_000
    assert LogFormat().format(record) == "[INFO][0-1:1:1](t=3661s) hello"
