"""Command lines, end to end on small files."""

import json

import pytest

from parley import __main__ as cli


@pytest.fixture
def corpus(tmp_path):
    turns = [{"speaker": "A", "text": "one two three", "start_time": 0.0, "end_time": 1.0}, {"speaker": "B", "text": "four five", "start_time": 1.0, "end_time": 2.0}]
    swapped = [dict(t, speaker="A") for t in turns]
    samples = [{"sample_id": f"s{i}", "duration_seconds": 50.0 + 30 * i, "num_speakers": 2, "overlap_ratio": 15.0 + i, "ground_truth_turns": turns, "odd": 1} for i in range(4)]
    said = [{"sample_id": f"s{i}", "strategy": name, "latency_seconds": 2.0 if name == "baseline" else 1.0, "predicted_turns": swapped if name == "baseline" else turns} for i in range(3) for name in ("baseline", "new")]
    said += [{"sample_id": "s3", "strategy": "new", "latency_seconds": 1.0, "predicted_turns": []}, {"sample_id": "unknown", "strategy": "new", "predicted_turns": turns}]
    for name, rows in (("metadata", samples), ("predictions", said)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    return tmp_path


def test_score_then_compile(spark, corpus, capsys):
    p = lambda name: str(corpus / name)
    with pytest.raises(SystemExit):
        cli.main(["compile", "--store", p("store"), "--out", p("out")])
    score = ["--buckets", "4", "score", "--metadata", p("metadata.json"), "--predictions", p("predictions.json"), "--store", p("store"), "--version", "1"]
    cli.main(score)
    cli.main(score)
    cli.main(["compile", "--store", p("store"), "--out", p("out")])
    out = capsys.readouterr().out
    assert "version 1: stored, 7 scores" in out and "version 1: there already, 7 scores" in out and "2 strategies" in out
    (written,) = [f for f in (corpus / "out").iterdir() if f.name.startswith("part-")]
    doc = json.loads(written.read_text())
    assert doc["overall"]["baseline"]["mean_wer"] == 0.0 and doc["overall"]["baseline"]["mean_saa"] == 0.6 and doc["overall"]["new"]["n"] == 4
    assert doc["overall"]["new"]["speedup"] == 2.0 and doc["overall"]["new"]["mean_wer"] == 0.25
    assert {k: v["new"]["n"] for k, v in doc["by_bucket"].items()} == {"<70s": 1, "70s-180s": 3}


def test_missing_and_queries(spark, corpus, capsys):
    cli.main(["missing", "--metadata", str(corpus / "metadata.json"), "--predictions", str(corpus / "predictions.json")])
    assert capsys.readouterr().out.split() == ["s3"]
    cli.main(["queries"])
    assert "flagship" in capsys.readouterr().out.split()
    cli.main(["queries", "--name", "a10_get_sample", "--data", "/root/testdata/sf0.001"])
    assert "duration_ms" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["queries", "--name", "no_such_query"])


def test_settings(monkeypatch):
    args = cli.parser().parse_args(["--keep", "5", "queries"])
    monkeypatch.setenv("PARLEY_BUCKETS", "7")
    monkeypatch.setenv("PARLEY_KEEP", "9")
    assert cli.Settings.of(args) == cli.Settings(None, 7, 5)
