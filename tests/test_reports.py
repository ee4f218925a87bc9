from dataclasses import dataclass, replace

import pytest

from actlake.plans import reports as r


def test_containment():
    full = r.Layout()
    assert full.within(full) and r.PROMPT_LAYOUT.within(full) and not full.within(r.PROMPT_LAYOUT)
    assert not replace(full, activations=r.Histogram(40)).within(full)
    assert replace(full, sequences=None).within(full) and not full.within(replace(full, logits=None))
    assert not r.Sequences(before=None).within(r.Sequences())


def test_deep_union():
    layers = [{"sae": {"rows": [f"f{i}"], f"layer{i}": {"width": 16 * i}}} for i in range(3)]
    assert r.deep_union(*layers) == {"sae": {"rows": ["f0", "f1", "f2"], "layer0": {"width": 0}, "layer1": {"width": 16}, "layer2": {"width": 32}}}
    assert r.deep_union() == {}
    with pytest.raises(ValueError, match="two values"):
        r.deep_union(layers[1], {"sae": {"layer1": {"width": 16}}})


def test_paths():
    @dataclass
    class C:
        n: int

    assert r.cache_path("/x/", "tokens", C(1)) == r.cache_path("/x", "tokens", C(1)) != r.cache_path("/x", "tokens", C(2))
    assert r.output_folder("/x/", "m", "s", "h", 128, "z") == "/x/m_s_h_128_z"


def test_command_line(spark, tmp_path):
    r.main(["feature_batches", "--tables", "/root/testdata/sf0.001", "--out", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_differences():
    assert r.differences({"a": [1.0, float("nan")], "b": "x"}, {"a": [1.0 + 1e-9, float("nan")], "b": "x"}) == []
    assert r.differences({"a": [1.0, 2.0], "b": 1, "c": True}, {"a": [1.0, 2.1], "d": 1, "c": False}) == ["/a/1", "/b", "/c", "/d"]
    assert r.differences([1], [1, 2]) == ["/"] and r.differences(1, "1") == ["/"]


def test_output_folder_must_not_be_a_file(tmp_path):
    (tmp_path / "m_s_h_1").write_text("x")
    with pytest.raises(NotADirectoryError):
        r.output_folder(str(tmp_path), "m", "s", "h", 1)
