import pytest

from codeloom.settings import Settings, read_settings


def test_settings(tmp_path):
    f = tmp_path / "config.toml"
    assert read_settings(f) == Settings() and Settings().pooling == "mean"
    f.write_text('[project]\nname = "p"\n[embedding]\nmodel = "x/bge-small"\ndevice = "cuda"\n[index]\nexclude_patterns = ["**/gen/**"]\n')
    got = read_settings(f)
    assert (got.name, got.model, got.device, got.reranker, got.exclude_patterns, got.pooling) == ("p", "x/bge-small", "cuda", None, ("**/gen/**",), "cls")
    for broken in ("[project", '[embedding]\nmodel = "x"\n', "[project]\n", '[index]\nexclude_patterns = "x"\n'):
        f.write_text(broken if broken != "[project]\n" else "[project]\nother = 1\n")
        with pytest.raises(ValueError):
            read_settings(f)
