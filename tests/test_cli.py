import os
import sys

from pathloom.cli import main

sys.path.insert(0, os.path.dirname(__file__))
from worked_example import lines  # noqa: E402


def test_build_query_count_describe_convert(spark, tmp_path, capsys):
    name = str(tmp_path / "g")
    (tmp_path / "g.kmers").write_text(lines())
    assert main(["convert", name + ".kmers"], spark) == 0 and (tmp_path / "g.graph").exists()
    for options in (["-t"], []):
        assert main(["build", *options, "-d", "1", "-v", "-o", name + ".index", name], spark) == 0
    (tmp_path / "p").write_text("CAT\nGG\nNN\nAT\nGCATC\n")
    assert main(["query", name + ".index", str(tmp_path / "p")], spark) == 0
    out = capsys.readouterr().out
    assert "patterns 4, found 3, occurrences 5, located 5, inconsistent 0" in out
    assert main(["count", "-k", "3", name + ".index"], spark) == 0
    assert capsys.readouterr().out.strip() == "12"
    assert main(["count", "-k", "3", name + ".index", name + ".index"], spark) == 0
    assert main(["describe", name + ".index"], spark) == 0
    assert "pathloom-index" in capsys.readouterr().out
    assert main(["fanout", "-t", name], spark) == 0
