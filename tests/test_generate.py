"""Generators and the benchmark grid."""

import random

from fuzzscan import benchmarks
from fuzzscan.functions import generate
from fuzzscan.operators.search import Options, ends_of


def test_generators():
    rng = random.Random(1)
    for _ in range(50):
        seq = generate.sequence(rng, 30)
        copy, edits = generate.mutated(rng, seq, 0, 4)
        assert generate.edit_distance(seq, copy) <= edits <= 4
        text, more, places = generate.planted(rng, seq, 400, 3, 2)
        assert len(text) == len(more) == 400 and more.endswith(seq)
        (e,) = ends_of([text], [seq], Options(2, "dna", "all"))
        assert all(any(abs(end - (at + 30)) <= 2 for end in e.end.tolist()) for at in places)
    assert ("A", "n") in generate.equal_pairs() and ("A", "C") not in generate.equal_pairs()


def test_grid(spark):
    cases = benchmarks.grid((20, 50), (1000,), (0, 0.05, 20), (0, 0.001))
    assert all(c.pattern_length > 3 * c.k for c in cases) and {c.k for c in cases if c.pattern_length == 20} == {0, 1} and {c.matches for c in cases} == {0, 1}
    rows = [r for c in cases[:2] for r in benchmarks.timed(c, 4)]
    got = benchmarks.summary(spark.createDataFrame(rows)).collect()
    assert len(got) == 2 and all(r.gb_per_s > 0 for r in got)
    profile = benchmarks.overhang_profile()
    assert {a for a, _, _ in profile} == {0.0, 0.5, 1.0} and (0.5, 50, 0) in profile and (0.5, 10, 5) in profile
    assert benchmarks.main(["--rounds", "1"]) == 0


def test_config_files(tmp_path, capsys):
    files = {
        "grid": 'query_lengths = [20, 100]\ntext_lengths = [1000]\nk = [0.05, 5]\nmatches = [0]\nbench_iter = [2]\nalphabet = ["dna"]\nprofile = ["dna"]\nrc = ["withoutrc", "withrc"]\n',
        "profiles": "q_lens = [20]\nt_lens = [1000]\nk = 2\niterations = 3\n",
        "overhang": "alphas = [0.0, 1.0]\n",
    }
    lines = {}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        assert benchmarks.main([f"--{name}", str(tmp_path / name)]) == 0
        lines[name] = capsys.readouterr().out.splitlines()
    assert len(lines["grid"]) == 2 * 2 * 4 and len(lines["profiles"]) == 4  # of 20 characters those with k = 1 and 5, of 100 with 5 and 5
    assert lines["overhang"][0] == "alpha,end_pos,cost" and {x.split(",")[0] for x in lines["overhang"][1:]} == {"0.0", "1.0"}
